"""The review desk: reviews, dismissals, merges and audits of one definition over a store.

Every step asks for its ability first. What a step writes becomes visible in one commit, or
not at all: a merge swaps records, children and ledger together, is made again where
another commit came between, and tells its listeners afterwards.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError, ForbiddenOperation, RecordUnavailable, RetryExhausted
from ..functions.digest import retirement_domain
from ..plans.context import Ability, Context, require
from ..plans.definition import Definition, visible
from ..sources.store import ATTEMPTS, Stale, Store
from . import apply, compare, dismiss, keys, resolve, review, suggest
from .compare import PAIR

LEDGER_TABLE, DISMISSALS = "ledger", "dismissals"


class Desk:
    """``schemas`` are those of the definition's table and of its relations' tables, by name of the table."""

    def __init__(self, store: Store, d: Definition, schemas: dict[str, Any], key: bytes, audit_key: bytes, clock: Callable[[], dt.datetime] | None = None, listeners: Iterable[Callable[[str, dict], None]] = ()):
        self.store, self.d, self.schemas, self.key, self.audit_key, self.listeners = store, d, schemas, key, audit_key, list(listeners)
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.domain = retirement_domain(d.connection, d.table, d.domain)

    def _tell(self, event: str, **about: Any) -> None:
        """Listeners run after the commit; one that fails does not undo it."""
        for f in self.listeners:
            try:
                f(event, about)
            except Exception:  # noqa: S110 - the commit stands whatever a listener does
                pass

    # -- tables -----------------------------------------------------------------------------

    def load(self, **tables: DataFrame) -> None:
        """Bring host tables into the store."""
        new = {n: self.store.files(self.store.write(n, df)) for n, df in tables.items()}
        self.store.commit(lambda state: state["tables"].update(new))

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        return self.store.read(name, self.schemas[name], state)

    def ledger(self, state: dict | None = None) -> DataFrame:
        return self.store.read(LEDGER_TABLE, resolve.LEDGER, state)

    def dismissals(self, state: dict | None = None) -> DataFrame:
        return self.store.read(DISMISSALS, dismiss.SCHEMA, state)

    def visible(self, context: Context, state: dict | None = None, trashed: bool = False) -> DataFrame:
        return visible(self.d, self.table(self.d.table, state), context, trashed)

    # -- review -----------------------------------------------------------------------------

    def review_page(self, context: Context, memberships: DataFrame, number: int = 1, size: int = 20, shown: int = 10) -> tuple[DataFrame, int, int]:
        """The groups of one page, live, with the number of buckets in all and of pages."""
        require(self.d, Ability.REVIEW, context)
        state, d = self.store.state(), self.d
        seen, ledger = self.visible(context, state), self.ledger(state)
        ids = keys.with_record_id(d, seen).select("record_id")
        members = suggest.visible_members(memberships, ids, ledger, self.domain)
        hidden = suggest.suppressed(members, keys.signatures(members), self.dismissals(state), self.key, context.scope, d.revision)
        found = suggest.without(suggest.buckets(members, {r.id: r.label for r in d.rules}), hidden)
        total = found.count()
        page = suggest.page(found, number, size)
        rows = suggest.first_members(members.join(page.select(*suggest.BUCKET), suggest.BUCKET, "left_semi"), page, shown)
        return review.groups(review.members(d, rows, seen, ledger, self.domain, self.key)), total, suggest.page_count(total, size)

    def survivors(self, context: Context, ids: DataFrame) -> DataFrame:
        """Where records (record_id, record_id_type) ended, as far as the actor may see it."""
        require(self.d, Ability.REVIEW, context)
        state = self.store.state()
        seen = keys.with_record_id(self.d, self.visible(context, state)).select("record_id", "record_id_type")
        return resolve.survivors(ids, self.ledger(state), self.domain, seen)

    def _dismissals(self, change: Callable[[DataFrame], DataFrame]) -> None:
        for _ in range(ATTEMPTS):
            state = self.store.state()
            folder = self.store.write(DISMISSALS, change(self.dismissals(state)))
            try:
                self.store.swap(state, {DISMISSALS: self.store.files(folder)})
                return
            except Stale:
                self.store.drop(folder)
        raise RetryExhausted("the dismissals kept changing")

    def dismiss(self, context: Context, pairs: DataFrame) -> None:
        """Record that the pairs (a, b) of encoded ids, which the actor sees, are no duplicates."""
        require(self.d, Ability.DISMISS, context)
        sig = keys.signatures(keys.build_keys(self.d, self.visible(context), self.key))
        fresh = dismiss.rows(pairs, sig, self.key, context.scope, self.d.revision, context.actor, self.clock())
        self._dismissals(lambda held: dismiss.upsert(held, fresh))

    def reopen(self, context: Context, hashes: list[str]) -> None:
        require(self.d, Ability.DISMISS, context)
        self._dismissals(lambda held: dismiss.reopen(held, hashes, context.scope, self.clock()))

    # -- merges -----------------------------------------------------------------------------

    def plan(self, context: Context, pairs: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
        require(self.d, Ability.REVIEW, context)
        state = self.store.state()
        return self._plan(context, pairs, self._memberships(context, memberships, state), state)

    def _memberships(self, context: Context, given: DataFrame | None, state: dict) -> DataFrame:
        return keys.build_keys(self.d, self.visible(context, state), self.key) if given is None else given

    def _children(self, state: dict) -> dict[str, DataFrame]:
        return {r.name: self.table(r.table, state) for r in self.d.relations}

    def _plan(self, context, pairs, memberships, state) -> DataFrame:
        return compare.plan(self.d, pairs, self.visible(context, state), self._children(state), self.ledger(state), self.domain, self.key, memberships)

    def merge(self, context: Context, plans: DataFrame, memberships: DataFrame | None = None) -> DataFrame:
        """Commit a batch of plans (PAIR, operation_id, fingerprint, choices); what each operation wrote, the replayed ones too.

        Operations that are in the ledger are not done again. MergeCompleted or MergeFailed tells of the batch.
        """
        tries = 0
        try:
            require(self.d, Ability.MERGE, context)
            for tries in range(1, ATTEMPTS + 1):
                state = self.store.state()
                own, new = self._write(context, plans, memberships, state)
                try:
                    after = self.store.swap(state, new) if new else state
                    break
                except Stale:
                    continue
            else:
                raise RetryExhausted("other merges kept coming first")
        except EngineError as e:
            self._tell("MergeFailed", definition=self.d.id, code=e.code, attempts=tries)
            raise
        done = apply.results(plans, self.ledger(after), self.audit_key).join(own.select("operation_id", F.lit(False).alias("replayed")), "operation_id", "left")
        self._tell("MergeCompleted", definition=self.d.id, context=context, attempts=tries)
        return done.withColumn("replayed", F.coalesce("replayed", F.lit(True)))

    def _write(self, context, plans, memberships, state) -> tuple[DataFrame, dict[str, list[str]]]:
        """The plans to do and the files of the next version, which nothing names yet."""
        d, now = self.d, self.clock()
        records, ledger, children = self.table(d.table, state), self.ledger(state), self._children(state)
        todo = apply.pending(d, plans, self.visible(context, state, trashed=True), ledger, context, self.audit_key)
        own = apply.checked(d, todo, self.visible(context, state), children, ledger, self._memberships(context, memberships, state), context, self.domain, self.key)
        if own.isEmpty():
            return own, {}
        ends = own.select(F.explode(F.array(*PAIR)).alias("id")).distinct()
        paths = {n: self.store.files(*state["tables"][n]) for n in {d.table, *(r.table for r in d.relations)}}
        new = {d.table: self.store.rewritten(d.table, paths[d.table], self.schemas[d.table], ends, d.key, lambda df: apply.merged_records(d, df, own, now))}
        for r in d.relations:
            new[r.table] = self.store.rewritten(r.table, new.get(r.table, paths[r.table]), self.schemas[r.table], own.select(F.col("source_id").alias("id")), r.foreign_key, lambda df, r=r: apply.moved_children(r, df, own))
        rows = apply.ledger_rows(d, records, own, context, self.domain, now, self.audit_key)
        held = state["tables"].get(LEDGER_TABLE, [])
        new[LEDGER_TABLE] = list(held) + self.store.files(self.store.write(LEDGER_TABLE, rows.select(*ledger.columns)))
        version = {"tables": {**state["tables"], **new}}
        if wrong := apply.postconditions(d, own, records, self.table(d.table, version), self._children(version), self.ledger(version), self.domain).limit(1).collect():
            raise apply.DomainConflict(f"{wrong[0]['source_id']}: {wrong[0]['violation']}")
        return own, new

    # -- audit ------------------------------------------------------------------------------

    def audit_read(self, context: Context, operation_id: str) -> dict[str, Any]:
        """The audit of an operation. Checks: ability, there, of this scope and definition, readable; in this order."""
        require(self.d, Ability.VIEW_AUDIT, context)
        row = self.ledger().where(F.col("operation_id") == operation_id).select("scope_id", "retirement_domain", apply.decrypt(F.col("audit_payload"), self.audit_key).alias("body")).limit(1).collect()
        if not row:
            raise RecordUnavailable("no such operation")
        if row[0]["scope_id"] != context.scope or row[0]["retirement_domain"] != self.domain:
            raise ForbiddenOperation("the operation is of another scope")
        if row[0]["body"] is None:
            raise RecordUnavailable("the audit cannot be read")
        body = json.loads(row[0]["body"])
        if body.get("definition_id") != self.d.id or body.get("connection") != self.d.connection:
            raise ForbiddenOperation("the operation is of another definition")
        return body
