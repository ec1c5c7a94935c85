"""Contexts, abilities and authorizers. All of it runs on the driver and fails closed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ForbiddenOperation, MissingContext
from ..functions.digest import scope_hash


class Ability(Enum):
    REVIEW = "review"
    DISMISS = "dismiss"
    SCAN = "scan"
    MERGE = "merge"
    VIEW_AUDIT = "view-audit"


@dataclass(frozen=True)
class Context:
    """Six primitives; the scope of it excludes actor and panel."""

    definition: str
    connection: str
    scope: str
    actor: str
    panel: str
    tenant: str | None = None


class NullContextResolver:
    """Knows nobody, so nothing is permitted."""

    def actor(self) -> str:
        raise MissingContext("no actor")

    def panel(self) -> str:
        raise MissingContext("no panel")

    def tenant(self) -> str | None:
        raise MissingContext("no tenant")


@dataclass(frozen=True)
class ServiceContextResolver:
    """An explicit identity, as of a scheduled job."""

    actor_id: str
    panel_id: str = "service"
    tenant_id: str | None = None

    def actor(self) -> str:
        if not self.actor_id:
            raise MissingContext("no actor")
        return self.actor_id

    def panel(self) -> str:
        return self.panel_id

    def tenant(self) -> str | None:
        return self.tenant_id


def resolve(definition, resolver, key: bytes) -> Context:
    """The context of a definition for the resolver's identity."""
    tenant = resolver.tenant()
    return Context(definition.id, definition.connection, scope_hash(key, definition.id, definition.connection, definition.domain, tenant), resolver.actor(), resolver.panel(), tenant)


class DenyAll:
    def can(self, ability: Ability, context: Context) -> bool:
        return False

    def view(self) -> Column:
        return F.lit(False)

    pair = child = view


@dataclass(frozen=True)
class AbilityMap:
    """Fixed grants, with boolean Columns over records, pairs and children."""

    granted: frozenset[Ability] = frozenset()
    view_column: Column | None = None
    pair_column: Column | None = None
    child_column: Column | None = None

    def can(self, ability: Ability, context: Context) -> bool:
        return ability in self.granted

    def view(self) -> Column:
        return F.lit(True) if self.view_column is None else self.view_column

    def pair(self) -> Column:
        return F.lit(True) if self.pair_column is None else self.pair_column

    def child(self) -> Column:
        return F.lit(True) if self.child_column is None else self.child_column


@dataclass(frozen=True)
class Gate:
    """A policy function decides each ability; records as in AbilityMap."""

    policy: Callable[[Ability, Context], bool]
    records: AbilityMap = field(default_factory=AbilityMap)

    def can(self, ability: Ability, context: Context) -> bool:
        return bool(self.policy(ability, context))

    def view(self) -> Column:
        return self.records.view()

    def pair(self) -> Column:
        return self.records.pair()

    def child(self) -> Column:
        return self.records.child()


def require(definition, ability: Ability, context: Context) -> None:
    if not definition.authorizer.can(ability, context):
        raise ForbiddenOperation(f"{context.actor} may not {ability.value}")
