"""Definitions of what is deduplicated, their registry and their validation."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidConfiguration
from ..functions.values import _WHOLE
from .context import DenyAll
from .rules import ExactRule

#: A definition's id.
ID_PATTERN = "[a-z0-9]+(?:[-_][a-z0-9]+)*"
#: Kinds of relation that can be declared; only the first can be moved.
RELATION_KINDS = ("has_many", "has_one", "belongs_to", "belongs_to_many", "morph_many", "morph_one", "morph_to_many", "through", "media_library")
#: Logical types whose name contains one of these cannot be merged.
UNSAFE_LOGICAL = ("json", "array", "object", "collection", "encrypted", "hashed", "float", "double", "real")


@dataclass(frozen=True)
class MergeField:
    name: str
    label: str = ""
    audited: bool = True
    blank_is_missing: bool = False


@dataclass(frozen=True)
class Relation:
    """Children that a merge moves to the survivor."""

    name: str
    table: str
    foreign_key: str
    key: str
    kind: str = "has_many"
    parent_key: str | None = None  #: None: the parent's primary key
    complete: bool = True  #: the declared inventory is all there is
    includes_trashed: bool = False
    deleted_at: str | None = None
    unique_keys: tuple[tuple[str, ...], ...] = ()
    cap: int | None = None
    connection: str = "default"


@dataclass(frozen=True)
class Retirement:
    id: str = "soft-delete"
    requires_soft_deletes: bool = True


@dataclass(frozen=True)
class Definition:
    """The source of truth about one table. Callables take and give DataFrames or Columns."""

    id: str
    table: str
    key: str
    rules: tuple[ExactRule, ...]
    revision: str = "1"
    label: str = ""
    title: str | None = None
    domain: str = "default"
    connection: str = "default"
    fields: tuple[MergeField, ...] = ()
    relations: tuple[Relation, ...] = ()
    logical: Mapping[str, str] = field(default_factory=dict)  #: column to logical type
    unique_keys: tuple[tuple[str, ...], ...] = ()
    scope_keys: tuple[str, ...] = ()
    forbidden: frozenset[str] = frozenset()
    tenant: str | None = None  #: column; with it, no tenant means no row
    deleted_at: str | None = None
    created_at: str | None = None
    updated_at: str | None = None
    constrain: Callable[[DataFrame, object], DataFrame] | None = None
    visible: Callable[[DataFrame, object], DataFrame] | None = None
    authorizer: object = field(default_factory=DenyAll)
    validator: Callable[[], Column] | None = None  #: array of errors over proposed values
    retirement: Retirement | None = None
    guards_writes: bool = False
    inventory_acknowledged: bool = False

    def rule(self, rule_id: str) -> ExactRule:
        for r in self.rules:
            if r.id == rule_id:
                return r
        raise InvalidConfiguration(f"{self.id} has no rule {rule_id}")


@dataclass(frozen=True)
class Issue:
    capability: str  #: detection or merge
    severity: str  #: blocker or warning
    message: str


@dataclass(frozen=True)
class Report:
    issues: tuple[Issue, ...]

    def can(self, capability: str) -> bool:
        needs = ("detection",) if capability == "detection" else ("detection", "merge")
        return not any(i.severity == "blocker" and i.capability in needs for i in self.issues)


class Registry:
    """Definitions by their unique ids."""

    def __init__(self, *definitions: Definition):
        self._by_id: dict[str, Definition] = {}
        for d in definitions:
            self.add(d)

    def add(self, d: Definition) -> None:
        if not d.id:
            raise InvalidConfiguration("a definition needs an id")
        if d.id in self._by_id:
            raise InvalidConfiguration(f"two definitions are called {d.id}")
        self._by_id[d.id] = d

    def get(self, definition_id: str) -> Definition:
        if definition_id not in self._by_id:
            raise InvalidConfiguration(f"no definition {definition_id}")
        return self._by_id[definition_id]

    def all(self) -> list[Definition]:
        return list(self._by_id.values())


def _refused(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StringType, T.BooleanType, T.DecimalType, T.TimestampType, T.TimestampNTZType, T.DateType, *_WHOLE))


def forbidden_fields(d: Definition) -> set[str]:
    """Columns that a merge never writes: keys, times, scope and foreign keys, and the named ones."""
    return {x for x in (d.key, d.created_at, d.updated_at, d.deleted_at, d.tenant) if x} | set(d.scope_keys) | set(d.forbidden)


def validate(d: Definition, schemas: Mapping[str, T.StructType], supported: tuple[str, ...] = ("default",)) -> Report:
    """Every issue of a definition; merging is only looked at where detection has no blocker."""
    found: list[Issue] = []

    def block(message: str, capability: str = "detection") -> None:
        found.append(Issue(capability, "blocker", message))

    if not re.fullmatch(ID_PATTERN, d.id):
        block(f"the id {d.id!r} is not a lower-case slug")
    for name in ("revision", "domain"):
        if not getattr(d, name):
            block(f"{name} is empty")
    schema = schemas.get(d.table)
    columns = {f.name: f.dataType for f in schema.fields} if schema else {}
    if schema is None:
        block(f"there is no table {d.table}")
    elif not isinstance(d.key, str):
        block("composite keys are not supported")
    elif d.key not in columns:
        block(f"the key {d.key} is not a column")
    elif not isinstance(columns[d.key], (T.StringType, T.DecimalType, *_WHOLE)):
        block(f"the key {d.key} has type {columns[d.key].simpleString()}")
    if not d.rules:
        block("there is no rule")
    seen: set[str] = set()
    for r in d.rules:
        if not r.id or r.id in seen:
            block(f"rule id {r.id!r} is empty or used twice")
        seen.add(r.id)
        if not r.fields:
            block(f"rule {r.id} has no field")
        for f in r.fields:
            if columns and f not in columns:
                block(f"rule {r.id}: no column {f}")
            elif columns and _refused(columns[f]):
                block(f"rule {r.id}: {f} has type {columns[f].simpleString()}")
        try:
            r.signature  # noqa: B018
        except Exception as e:
            block(f"rule {r.id} cannot be signed: {e}")
    for c in (*d.scope_keys, *(x for x in (d.tenant, d.title) if x)):
        if columns and c not in columns:
            block(f"no column {c}")
    if d.connection not in supported:
        found.append(Issue("merge", "warning", f"connection {d.connection} is not among the supported ones"))
    if not any(i.severity == "blocker" for i in found):
        _validate_merge(d, columns, schemas, block)
    return Report(tuple(found))


def _validate_merge(d: Definition, columns: Mapping[str, T.DataType], schemas: Mapping[str, T.StructType], block) -> None:
    def no(message: str) -> None:
        block(message, "merge")

    forbidden, seen = forbidden_fields(d), set()
    for f in d.fields:
        if f.name in seen:
            no(f"field {f.name} is declared twice")
        seen.add(f.name)
        if f.name in forbidden:
            no(f"field {f.name} is never merged")
        elif f.name not in columns:
            no(f"field {f.name} is not a column")
        elif _refused(columns[f.name]):
            no(f"field {f.name} has type {columns[f.name].simpleString()}")
        elif any(x in d.logical.get(f.name, "") for x in UNSAFE_LOGICAL):
            no(f"field {f.name} is stored as {d.logical[f.name]}")
    names: set[str] = set()
    for r in d.relations:
        if r.name in names:
            no(f"relation {r.name} is declared twice")
        names.add(r.name)
        if r.kind not in RELATION_KINDS:
            no(f"relation {r.name}: unknown kind {r.kind}")
        elif r.kind != "has_many":
            no(f"relation {r.name}: {r.kind} cannot be moved")
        if not r.complete:
            no(f"relation {r.name} is not declared complete")
        if r.parent_key not in (None, d.key):
            no(f"relation {r.name} does not refer to the primary key")
        if r.connection != d.connection:
            no(f"relation {r.name} is on another connection")
        child = schemas.get(r.table)
        if child is None:
            no(f"relation {r.name}: no table {r.table}")
        elif missing := [c for c in (r.foreign_key, r.key) if c not in child.fieldNames()]:
            no(f"relation {r.name}: no column {missing[0]}")
    if isinstance(d.authorizer, DenyAll):
        no("there is no record authorizer")
    if d.retirement is None:
        no("there is no retirement strategy")
    elif d.retirement.requires_soft_deletes and not d.deleted_at:
        no("the retirement strategy needs a deleted_at column")
    if not d.inventory_acknowledged:
        no("the inventory of relations is not acknowledged")
    if d.validator is None:
        no("there is no validator")
    if not d.guards_writes:
        no("there is no writer guard")


def scoped(d: Definition, df: DataFrame, context, trashed: bool = False) -> DataFrame:
    """Rows of the tenant and scope; soft-deleted ones only on request."""
    if d.tenant:
        df = df.where(F.lit(False)) if context.tenant is None else df.where(F.col(d.tenant) == F.lit(context.tenant))
    if d.constrain:
        df = d.constrain(df, context)
    if d.deleted_at and not trashed:
        df = df.where(F.col(d.deleted_at).isNull())
    return df


def visible(d: Definition, df: DataFrame, context, trashed: bool = False) -> DataFrame:
    """Rows of the scope that the actor may see. It narrows before anything is counted."""
    df = scoped(d, df, context, trashed)
    return d.visible(df, context) if d.visible else df
