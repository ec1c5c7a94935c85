"""Applying reviewed merges as new versions of every touched table.

A batch holds pairs whose records are disjoint, each with explicit choices. Nothing is
merged on its own: a batch only writes what its plans and choices say.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DomainConflict, ForbiddenOperation, MergeTooLarge, RecordUnavailable, StalePreview
from ..functions.values import encode_id, id_order, key_domain, record_id, typed
from ..plans.context import Ability, require
from ..plans.definition import Definition, Relation
from ..sources.work import cut
from . import compare
from .compare import PAIR


def lock_order(ids: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    """Encoded ids in the canonical order: by type, then by typed value."""
    rid = record_id(F.col(column), kind)
    return ids.select(encode_id(rid).alias("encoded"), id_order(rid).alias("_o")).distinct().orderBy("_o").drop("_o")


def assert_disjoint(plans: DataFrame) -> None:
    """No record may stand in two pairs of a batch."""
    ends = plans.select(F.explode(F.array("source_id", "survivor_id")).alias("id"))
    twice = ends.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise DomainConflict(f"record {twice[0]['id']} is in more than one pair of the batch")


def chosen(d: Definition, schema: T.StructType) -> dict[str, Column]:
    """What each merge field of the survivor becomes: an explicit choice wins over the policy.

    Over a joined pair with a ``choices`` map. Without a choice a missing survivor takes the
    source's value where that is there; everything else stays.
    """
    out = {}
    for f in d.fields:
        a, b = F.col(f"`source__{f.name}`"), F.col(f"`survivor__{f.name}`")
        how = compare.resolution(f, a, b, schema[f.name].dataType, d.logical.get(f.name))
        pick = F.element_at("choices", F.lit(f.name))
        out[f.name] = F.when(pick == "source", a).when(pick == "survivor", b).when(how == "take_source", a).otherwise(b)
    return out


def merged_records(d: Definition, records: DataFrame, plans: DataFrame, now: dt.datetime) -> DataFrame:
    """The records' next version: survivors with their chosen values, sources soft-deleted."""
    schema, at = records.schema, F.lit(now).cast("timestamp")
    both = compare.joined(d, plans.select(*PAIR, "choices"), records)
    values = both.select(F.col("survivor_id").alias("_sid"), *[c.alias(f"_new_{n}") for n, c in chosen(d, schema).items()])
    gone = plans.select(F.col("source_id").alias("_gone"))
    key = F.col(f"`{d.key}`").cast("string")
    out = records.join(values, key == F.col("_sid"), "left").join(gone, key == F.col("_gone"), "left")
    columns = []
    for c in records.columns:
        col = F.col(f"`{c}`")
        if any(f.name == c for f in d.fields):
            col = F.when(F.col("_sid").isNotNull(), F.col(f"_new_{c}")).otherwise(col)
        elif c == d.deleted_at:
            col = F.when(F.col("_gone").isNotNull(), at.cast(schema[c].dataType)).otherwise(col)
        elif c == d.updated_at:
            col = F.when(F.col("_sid").isNotNull() | F.col("_gone").isNotNull(), at.cast(schema[c].dataType)).otherwise(col)
        columns.append(col.alias(c))
    return out.select(*columns)


def moved_children(r: Relation, children: DataFrame, plans: DataFrame) -> DataFrame:
    """The children's next version: those of the declared inventory follow the survivor."""
    p = plans.select(F.col("source_id").alias("_from"), F.col("survivor_id").alias("_to"))
    fk, kind = F.col(f"`{r.foreign_key}`"), children.schema[r.foreign_key].dataType
    counted = F.lit(True) if not r.deleted_at or r.includes_trashed else F.col(r.deleted_at).isNull()
    out = children.join(p, fk.cast("string") == F.col("_from"), "left")
    new = F.when(F.col("_to").isNotNull() & counted, F.col("_to").cast(kind)).otherwise(fk)
    return out.select(*[new.alias(c) if c == r.foreign_key else F.col(f"`{c}`") for c in children.columns])


_VALUE = "struct<type:string,value:string>"
_MOVED = "array<struct<relation:string,count:bigint,child_ids:array<string>>>"
#: What an audit payload holds.
PAYLOAD = f"""operation_id string, definition_id string, revision string, connection string, scope string, actor string, panel string, tenant string,
source_id string, survivor_id string, fingerprint string, reasons array<string>, config map<string,string>,
fields array<struct<field:string,label:string,resolution:string,choice:string,audited:boolean,before:struct<survivor:{_VALUE},source:{_VALUE}>,after:{_VALUE}>>, relations {_MOVED}"""


def audit_payload(d: Definition, schema: T.StructType, context=None, columns: Mapping[str, Column] | None = None) -> Column:
    """JSON of a joined pair: who merged what and why, per field resolution and choice with the values
    where the field is audited (after only where it was written), and the children that moved.

    ``columns`` has what is known of operation_id, fingerprint, reasons and moved.
    """
    parts, known = [], columns or {}
    for f in d.fields:
        a, b, kind = F.col(f"`source__{f.name}`"), F.col(f"`survivor__{f.name}`"), schema[f.name].dataType
        how, pick = compare.resolution(f, a, b, kind, d.logical.get(f.name)), F.element_at("choices", F.lit(f.name))
        written = (pick == "source") | (pick.isNull() & (how == "take_source"))
        show = lambda c, f=f, kind=kind: typed(c, kind, d.logical.get(f.name)) if f.audited else F.lit(None).cast(_VALUE)
        before = F.struct(show(b).alias("survivor"), show(a).alias("source")) if f.audited else F.lit(None).cast(f"struct<survivor:{_VALUE},source:{_VALUE}>")
        parts.append(F.struct(F.lit(f.name).alias("field"), F.lit(f.label).alias("label"), how.alias("resolution"), pick.alias("choice"), F.lit(f.audited).alias("audited"), before.alias("before"), F.when(written, show(a)).alias("after")))
    fields = F.array(*parts) if parts else F.array()
    kind = schema[d.key].dataType
    caps = F.create_map(*[F.lit(x) for r in d.relations for x in (f"cap:{r.name}", str(r.cap))]) if d.relations else F.create_map().cast("map<string,string>")
    about = {"definition_id": d.id, "revision": d.revision, "connection": d.connection, "scope": getattr(context, "scope", None), "actor": getattr(context, "actor", None), "panel": getattr(context, "panel", None), "tenant": getattr(context, "tenant", None)}
    return F.to_json(
        F.struct(
            known.get("operation_id", F.lit(None).cast("string")).alias("operation_id"),
            *[F.lit(v).cast("string").alias(k) for k, v in about.items()],
            encode_id(record_id(F.col(f"source__{d.key}"), kind)).alias("source_id"),
            encode_id(record_id(F.col(f"survivor__{d.key}"), kind)).alias("survivor_id"),
            known.get("fingerprint", F.lit(None).cast("string")).alias("fingerprint"),
            known.get("reasons", F.lit(None).cast("array<string>")).alias("reasons"),
            caps.alias("config"),
            fields.alias("fields"),
            known.get("moved", F.lit(None).cast(_MOVED)).alias("relations"),
        )
    )


def payload(c: Column, key: bytes) -> Column:
    """The struct of an encrypted audit payload, or null where it cannot be read."""
    return F.from_json(decrypt(c, key), PAYLOAD)


def encrypt(text: Column, key: bytes) -> Column:
    """Authenticated encryption (GCM) with a key of 16, 24 or 32 bytes."""
    return F.aes_encrypt(text, F.lit(key), F.lit("GCM"))


def decrypt(payload: Column, key: bytes) -> Column:
    """The text, or null where the payload or the key is not the right one."""
    return F.try_aes_decrypt(payload, F.lit(key), F.lit("GCM")).cast("string")


def ledger_rows(d: Definition, records: DataFrame, plans: DataFrame, context, domain: str, now: dt.datetime, audit_key: bytes) -> DataFrame:
    """One terminal edge per merge. ``plans`` has operation_id; fingerprint, reasons and moved go to the audit where it has them."""
    kind, at = records.schema[d.key].dataType, F.lit(now).cast("timestamp")
    more = [c for c in ("fingerprint", "reasons", "moved") if c in plans.columns]
    both = compare.joined(d, plans.select(*PAIR, "choices", "operation_id", *more), records)
    audit = audit_payload(d, records.schema, context, {c: F.col(c) for c in ("operation_id", *more)})
    return both.select(
        F.col("operation_id").alias("id"),
        "operation_id",
        F.lit(context.scope).alias("scope_id"),
        F.lit(domain).alias("retirement_domain"),
        "source_id",
        key_domain(F.col(f"source__{d.key}"), kind).alias("source_id_type"),
        "survivor_id",
        key_domain(F.col(f"survivor__{d.key}"), kind).alias("survivor_id_type"),
        F.lit(context.actor).alias("actor_ref"),
        F.lit(d.revision).alias("definition_revision"),
        encrypt(audit, audit_key).alias("audit_payload"),
        at.alias("committed_at"),
        F.lit(2).alias("retirement_domain_version"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def append_ledger(ledger: DataFrame, fresh: DataFrame) -> DataFrame:
    """The ledger with the new edges; an operation already recorded is not recorded again."""
    new = fresh.join(ledger.select("operation_id"), "operation_id", "left_anti")
    taken = new.join(ledger.select("retirement_domain", "source_id_type", "source_id"), ["retirement_domain", "source_id_type", "source_id"], "left_semi").limit(1).collect()
    if taken:
        raise DomainConflict(f"record {taken[0]['source_id']} was merged before")
    return ledger.unionByName(new.select(*ledger.columns))


def _picked(choices: Column) -> Column:
    """A choices map as a sorted list, without fields that have none."""
    return F.array_sort(F.filter(F.map_entries(F.coalesce(choices, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()))


def replays(plans: DataFrame, ledger: DataFrame, context, audit_key: bytes | None = None) -> DataFrame:
    """The plans whose operation is in the ledger already, with ``problem``: null where it is the same merge,
    else actor, scope, pair or choices. Choices are compared where the key to the audit is given."""
    held = ledger.select("operation_id", "scope_id", "actor_ref", *[F.col(c).alias(f"_{c}") for c in PAIR], "audit_payload")
    both = plans.join(held, "operation_id")
    problem = F.when(F.col("actor_ref") != context.actor, "actor").when(F.col("scope_id") != context.scope, "scope").when((F.col("source_id") != F.col("_source_id")) | (F.col("survivor_id") != F.col("_survivor_id")), "pair")
    if audit_key is not None:
        fields = payload(F.col("audit_payload"), audit_key)["fields"]
        entries = F.transform(fields, lambda f: F.struct(f["field"].alias("key"), f["choice"].alias("value")))
        recorded = F.array_sort(F.filter(entries, lambda e: e["value"].isNotNull()))
        problem = problem.when(fields.isNull(), "audit").when(~recorded.eqNullSafe(_picked(F.col("choices"))), "choices")
    return both.withColumn("problem", problem).drop("scope_id", "actor_ref", *[f"_{c}" for c in PAIR], "audit_payload")


def replayed(plans: DataFrame, ledger: DataFrame, context, audit_key: bytes | None = None) -> DataFrame:
    """Plans whose operation was committed by the same actor in the same scope for the same pair, with the same choices."""
    return replays(plans, ledger, context, audit_key).where("problem is null").drop("problem")


def native(value: Column) -> Column:
    """The text of a typed value as its own JSON value: numbers and booleans bare, all else quoted, null as null."""
    bare = F.when(value["type"] == "integer", value["value"]).when(value["type"] == "boolean", F.when(value["value"] == "1", "true").otherwise("false"))
    quoted = F.regexp_replace(F.to_json(F.array(value["value"])), r"^\[|\]$", "")
    return F.when(value.isNull(), "null").otherwise(F.coalesce(bare, quoted))


def results(operations: DataFrame, ledger: DataFrame, audit_key: bytes) -> DataFrame:
    """operation_id, source_id, survivor_id, written (field to JSON value), moved and moved_total of recorded operations."""
    held = ledger.join(operations.select("operation_id").distinct(), "operation_id", "left_semi")
    held = held.select("operation_id", *PAIR, payload(F.col("audit_payload"), audit_key).alias("a"))
    written = F.filter("a.fields", lambda f: f["after"].isNotNull())
    entries = F.transform(written, lambda f: F.struct(f["field"].alias("key"), native(f["after"]).alias("value")))
    moved = F.coalesce("a.relations", F.array().cast(_MOVED))
    total = F.aggregate(moved, F.lit(0).cast("long"), lambda n, m: n + m["count"])
    return held.select("operation_id", *PAIR, F.map_from_entries(entries).alias("written"), moved.alias("moved"), total.alias("moved_total"))


def postconditions(d: Definition, plans: DataFrame, records: DataFrame, after: DataFrame, children_after: Mapping[str, DataFrame], ledger_after: DataFrame, domain: str) -> DataFrame:
    """Violations after a batch; empty when all holds."""
    kinds = []
    gone = plans.select("source_id")
    key = F.col(d.key).cast("string")
    alive = after.where(F.col(d.deleted_at).isNull()).select(key.alias("source_id"))
    kinds.append(gone.join(alive, "source_id", "left_semi").select("source_id", F.lit("source_not_retired").alias("violation")))
    on = ["source_id"] + (["source_id_type"] if "source_id_type" in ledger_after.columns else [])
    edges = ledger_after.where(F.col("retirement_domain") == domain).groupBy(*on).agg(F.count("*").alias("n"))
    named = gone.withColumn("source_id_type", key_domain(F.col("source_id"), records.schema[d.key].dataType))
    kinds.append(named.join(edges, on, "left").where(F.coalesce("n", F.lit(0)) != 1).select("source_id", F.lit("not_one_ledger_row").alias("violation")))
    for r in d.relations:
        left = compare.inventory(r, children_after[r.name]).select(F.col(r.foreign_key).cast("string").alias("source_id"))
        kinds.append(gone.join(left, "source_id", "left_semi").select("source_id", F.lit(f"children_left:{r.name}").alias("violation")))
    both = compare.joined(d, plans.select(*PAIR, "choices"), records)
    want = both.select("source_id", F.col("survivor_id").alias("_s"), *[c.alias(f"_w_{n}") for n, c in chosen(d, records.schema).items()])
    have = after.select(key.alias("_s"), *[F.col(f"`{f.name}`").alias(f"_h_{f.name}") for f in d.fields])
    if d.fields:
        wrong = F.lit(False)
        for f in d.fields:
            wrong = wrong | ~F.col(f"_w_{f.name}").eqNullSafe(F.col(f"_h_{f.name}"))
        kinds.append(want.join(have, "_s").where(wrong).select("source_id", F.lit("survivor_differs").alias("violation")))
    for k in d.unique_keys:
        live = after.where(F.col(d.deleted_at).isNull()) if d.deleted_at else after
        known = F.lit(True)
        for c in k:
            known = known & F.col(c).isNotNull()
        twice = live.where(known).groupBy(*k).agg(F.count("*").alias("n"), F.min(key).alias("source_id")).where("n > 1")
        kinds.append(twice.select("source_id", F.lit("unique:" + ",".join(k)).alias("violation")))
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out


def _refuse(plans: DataFrame) -> None:
    """Raise for the first fatal blocker, in the order of the checks."""
    bad = plans.where(F.size(compare.fatal(F.col("blockers"))) > 0).select(*PAIR, compare.fatal(F.col("blockers"))[0].alias("b")).limit(1).collect()
    if not bad:
        return
    code = bad[0]["b"].split(":")[0]
    kind = {"record_unavailable": RecordUnavailable, "source_retired": RecordUnavailable, "survivor_retired": RecordUnavailable, "forbidden_operation": ForbiddenOperation, "merge_too_large": MergeTooLarge}.get(code, DomainConflict)
    raise kind(f"{bad[0]['source_id']} into {bad[0]['survivor_id']}: {bad[0]['b']}")


def pending(d: Definition, plans: DataFrame, records: DataFrame, ledger: DataFrame, context, audit_key: bytes) -> DataFrame:
    """The plans that were not committed before. An operation that was, but as another merge, refuses the batch.

    ``records`` are those the actor may see, retired ones included: who may not see a record any
    more is not told of its merge either.
    """
    seen = cut(replays(plans, ledger, context, audit_key))
    if bad := seen.where("problem is not null").limit(1).collect():
        kind = ForbiddenOperation if bad[0]["problem"] in ("actor", "scope") else DomainConflict
        raise kind(f"operation {bad[0]['operation_id']} was committed before with another {bad[0]['problem']}")
    may = records.where(d.authorizer.view()).select(F.col(d.key).cast("string").alias("id"))
    ends = seen.select("operation_id", F.explode(F.array(*PAIR)).alias("id"))
    if hidden := ends.join(may, "id", "left_anti").limit(1).collect():
        raise ForbiddenOperation(f"a record of operation {hidden[0]['operation_id']} is no longer visible")
    return plans.join(seen.select("operation_id"), "operation_id", "left_anti")


def checked(d: Definition, plans: DataFrame, visible: DataFrame, children: Mapping[str, DataFrame], ledger: DataFrame, memberships: DataFrame, context, domain: str, key: bytes) -> DataFrame:
    """The plans, made again from what is there now and found fit to be written.

    A different fingerprint is stale; a fatal blocker, a pair without a shared key or a missing
    choice refuses the whole batch.
    """
    require(d, Ability.MERGE, context)
    assert_disjoint(plans)
    fresh = compare.plan(d, plans, visible, children, ledger, domain, key, memberships)
    out = cut(fresh.join(plans.select(*PAIR, "operation_id", "choices", F.col("fingerprint").alias("_reviewed")), PAIR))
    _refuse(out)
    if stale := out.where(~F.col("fingerprint").eqNullSafe(F.col("_reviewed"))).limit(1).collect():
        raise StalePreview(f"{stale[0]['source_id']} or {stale[0]['survivor_id']} changed since the review")
    if loose := out.where(F.col("reasons").isNull() | (F.size("reasons") == 0)).limit(1).collect():
        raise DomainConflict(f"{loose[0]['source_id']} and {loose[0]['survivor_id']} share no key")
    if open_ := out.where(~compare.can_confirm(F.col("blockers"), F.col("choices"))).limit(1).collect():
        raise DomainConflict(f"{open_[0]['source_id']} into {open_[0]['survivor_id']}: a choice is missing")
    known = [f.name for f in d.fields]
    if odd := out.select(F.explode(F.map_keys("choices")).alias("f")).where(~F.col("f").isin(known)).limit(1).collect():
        raise DomainConflict(f"{odd[0]['f']} is not a merge field")
    return out.select(*PAIR, "operation_id", "choices", "fingerprint", "reasons", "moved")


def execute(d: Definition, plans: DataFrame, records: DataFrame, visible: DataFrame, children: Mapping[str, DataFrame], ledger: DataFrame, memberships: DataFrame, context, domain: str, key: bytes, audit_key: bytes, now: dt.datetime) -> dict[str, DataFrame]:
    """The next version of records, children and ledger; :class:`kinfold.operators.desk.Desk` commits one.

    ``plans`` has PAIR, operation_id, fingerprint (as reviewed) and choices (map).
    """
    own = checked(d, pending(d, plans, records, ledger, context, audit_key), visible, children, ledger, memberships, context, domain, key)
    after = merged_records(d, records, own, now)
    moved = {r.name: moved_children(r, children[r.name], own) for r in d.relations}
    book = append_ledger(ledger, ledger_rows(d, records, own, context, domain, now, audit_key))
    if wrong := postconditions(d, own, records, after, moved, book, domain).limit(1).collect():
        raise DomainConflict(f"{wrong[0]['source_id']}: {wrong[0]['violation']}")
    return {"records": after, "ledger": book, **{f"children:{n}": x for n, x in moved.items()}}
