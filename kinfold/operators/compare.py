"""Comparing the two records of each pair, and planning their merge.

A pair has source_id and survivor_id (keys as text). Joined to its records it has every
column twice: source__<column> and survivor__<column>.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import keyed
from ..functions.normalize import ascii_trim
from ..functions.values import encode_id, id_order, key_domain, record_id, typed, typed_equal
from ..plans.definition import Definition, MergeField, Relation, validate
from ..sources.work import cut
from .keys import rule_digest
from .review import plan_title

PAIR = ["source_id", "survivor_id"]


def joined(d: Definition, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs whose two records are both there, with the columns of both."""
    out = pairs
    for side in ("source", "survivor"):
        own = records.select(*[F.col(f"`{c}`").alias(f"{side}__{c}") for c in records.columns], F.col(f"`{d.key}`").cast("string").alias("_key"))
        out = out.join(own, F.col(f"{side}_id") == F.col("_key")).drop("_key")
    return out


def recommend(d: Definition, candidates: DataFrame, records: DataFrame) -> DataFrame:
    """source_id, survivor_id and reason for unordered pairs (a, b).

    The record created first (to the second) survives, else the one with the lower id; of equal ids the first.
    """
    c, kind = candidates, records.schema[d.key].dataType
    for side in ("a", "b"):
        created = F.unix_timestamp(d.created_at) if d.created_at else F.lit(None).cast("long")
        own = records.select(F.col(d.key).cast("string").alias(f"_{side}"), id_order(record_id(F.col(d.key), kind)).alias(f"{side}_order"), created.alias(f"{side}_made"))
        c = c.join(own, F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    older = F.when(F.col("a_made") < F.col("b_made"), "a").when(F.col("b_made") < F.col("a_made"), "b")
    lower = F.when(F.col("b_order") < F.col("a_order"), "b").otherwise("a")
    keep = F.coalesce(older, lower)
    return c.select(F.when(keep == "a", F.col("b")).otherwise(F.col("a")).alias("source_id"), F.when(keep == "a", F.col("a")).otherwise(F.col("b")).alias("survivor_id"), F.when(older.isNotNull(), "older").otherwise("lower-id").alias("reason"))


def missing(f: MergeField, c: Column, kind: T.DataType) -> Column:
    if f.blank_is_missing and isinstance(kind, T.StringType):
        return c.isNull() | (ascii_trim(c) == "")
    return c.isNull()


def resolution(f: MergeField, source: Column, survivor: Column, kind: T.DataType, logical: str | None = None) -> Column:
    """both_missing, take_source, retain_survivor or choice_required."""
    no_source, no_survivor = missing(f, source, kind), missing(f, survivor, kind)
    return F.when(no_source & no_survivor, "both_missing").when(no_survivor, "take_source").when(no_source, "retain_survivor").when(typed_equal(typed(source, kind, logical), typed(survivor, kind, logical)), "retain_survivor").otherwise("choice_required")


def comparison(source: Column, survivor: Column) -> Column:
    """identical, different, source_only, survivor_only or empty, for two typed values."""
    return F.when(source.isNull() & survivor.isNull(), "empty").when(survivor.isNull(), "source_only").when(source.isNull(), "survivor_only").when(source == survivor, "identical").otherwise("different")


def _difference(d: Definition, f: MergeField, kind: T.DataType) -> Column:
    a, b, logical = F.col(f"`source__{f.name}`"), F.col(f"`survivor__{f.name}`"), d.logical.get(f.name)
    how = resolution(f, a, b, kind, logical)
    ta, tb = typed(a, kind, logical), typed(b, kind, logical)
    proposed = F.when(how.isin("both_missing", "take_source"), ta).otherwise(tb)
    return F.struct(F.lit(f.name).alias("field"), how.alias("resolution"), ta.alias("source"), tb.alias("survivor"), proposed.alias("proposed"), (how != "retain_survivor").alias("differs"), comparison(ta, tb).alias("comparison"))


def differences(d: Definition, schema: T.StructType) -> Column:
    """array<struct> over the merge fields of a joined pair."""
    return F.array(*[_difference(d, f, schema[f.name].dataType) for f in d.fields])


def field_diff(d: Definition, both: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per pair and field."""
    return both.select(*PAIR, F.explode(differences(d, schema)).alias("x")).select(*PAIR, "x.*")


def diff_summary(rows: DataFrame) -> DataFrame:
    """Counts per pair: total, identical, different, one_sided, empty."""
    c = F.col("comparison")
    return rows.groupBy(*PAIR).agg(F.count("*").alias("total"), F.count_if(c == "identical").alias("identical"), F.count_if(c == "different").alias("different"), F.count_if(c.isin("source_only", "survivor_only")).alias("one_sided"), F.count_if(c == "empty").alias("empty"))


def unique_blockers(d: Definition, rows: DataFrame) -> DataFrame:
    """Fields of any unique key whose values need a choice: both values cannot be kept apart after it."""
    columns = sorted({c for k in d.unique_keys for c in k})
    return rows.where(F.col("field").isin(columns) & (F.col("resolution") == "choice_required")).select(*PAIR, "field")


# -- children -----------------------------------------------------------------------------


def inventory(r: Relation, children: DataFrame) -> DataFrame:
    """The declared children; trashed ones only where the relation includes them."""
    if r.deleted_at and not r.includes_trashed:
        return children.where(F.col(r.deleted_at).isNull())
    return children


def _of(r: Relation, pairs: DataFrame, children: DataFrame, side: str) -> DataFrame:
    own = inventory(r, children)
    return pairs.select(*PAIR).join(own, own[r.foreign_key].cast("string") == F.col(f"{side}_id"))


def impacts(d: Definition, r: Relation, pairs: DataFrame, children: DataFrame, labels: bool = True) -> DataFrame:
    """moving, current, resulting, too_large and a sentence, per pair."""
    out = pairs.select(*PAIR)
    for side, name in (("source", "moving"), ("survivor", "current")):
        # Counted once a parent, then looked up: children are not multiplied by pairs.
        n = inventory(r, children).groupBy(F.col(r.foreign_key).cast("string").alias(f"{side}_id")).agg(F.count("*").alias(name))
        out = out.join(n, f"{side}_id", "left")
    out = out.select(*PAIR, F.coalesce("moving", F.lit(0)).alias("moving"), F.coalesce("current", F.lit(0)).alias("current"))
    out = out.withColumn("resulting", F.col("moving") + F.col("current")).withColumn("relation", F.lit(r.name))
    out = out.withColumn("too_large", F.lit(False) if r.cap is None else F.col("moving") > r.cap)
    return out.withColumn("summary", F.format_string("Move %d %s to %s; resulting total %d.", "moving", F.lit(r.name), "survivor_id", "resulting")) if labels else out


def child_ids(r: Relation, pairs: DataFrame, children: DataFrame) -> DataFrame:
    """Sorted encoded ids of the children that each pair would move."""
    rid = record_id(F.col(r.key), children.schema[r.key].dataType)
    rows = _of(r, pairs, children, "source").withColumn("_id", F.struct(id_order(rid).alias("o"), encode_id(rid).alias("id")))
    return rows.groupBy(*PAIR).agg(F.array_sort(F.collect_list("_id")).alias("x")).select(*PAIR, F.col("x.id").alias("child_ids"))


def collisions(r: Relation, pairs: DataFrame, children: DataFrame) -> DataFrame:
    """Pairs whose move would break a unique key of the children, with the columns of the key.

    A moving child collides with a child of the survivor that is equal in the other columns
    (null equals null), or with another moving child (null equals the empty text there).
    A key of the foreign key alone allows one child in all.
    """
    side = lambda name, source: pairs.select(F.col(name).alias("_parent"), *PAIR, F.lit(source).alias("_source"))
    ends = side("source_id", True).unionByName(side("survivor_id", False))
    found = None
    for key in r.unique_keys:
        if r.foreign_key not in key:
            continue
        others = [c for c in key if c != r.foreign_key]
        own = inventory(r, children).select(F.col(r.foreign_key).cast("string").alias("_parent"), *[F.col(f"`{c}`") for c in others])
        # Children that are equal with null as empty text meet in a group; which of them are null tells them apart against the survivor's.
        nulls = F.concat_ws("", F.lit("-"), *[F.col(f"`{c}`").isNull().cast("string") for c in others]).alias("_nulls")
        rows = own.join(ends, "_parent").select(*PAIR, "_source", nulls, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_k{i}") for i, c in enumerate(others)])
        kinds = [F.collect_set(F.when(F.col("_source") == x, F.col("_nulls"))).alias(n) for x, n in ((True, "_moving"), (False, "_held"))]
        met = rows.groupBy(*PAIR, *[f"_k{i}" for i in range(len(others))]).agg(F.count_if("_source").alias("_n"), *kinds)
        hit = met.where((F.col("_n") > 1) | F.arrays_overlap("_moving", "_held")).select(*PAIR).distinct()
        hit = hit.withColumn("relation", F.lit(r.name)).withColumn("unique_key", F.lit(",".join(key)))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return pairs.select(*PAIR).limit(0).withColumn("relation", F.lit(r.name)).withColumn("unique_key", F.lit(""))
    return found


# -- fingerprints and plans ----------------------------------------------------------------


def record_print(d: Definition, schema: T.StructType, key: bytes) -> Column:
    """JSON list of a record's merge fields and keys; it does not depend on updated_at."""
    parts = [F.lit("record")]
    for f in d.fields:
        t = typed(F.col(f"`{f.name}`"), schema[f.name].dataType, d.logical.get(f.name))
        parts.append(F.concat(F.lit(f"{f.name}="), F.coalesce(F.to_json(F.array(t["type"], t["value"])), F.lit("null"))))
    for r in sorted(d.rules, key=lambda r: r.id):
        parts.append(F.concat(F.lit(f"key:{r.id}="), F.coalesce(rule_digest(d, r, key, schema), F.lit(""))))
    return F.to_json(F.array(*parts))


def _pair_print(d: Definition, key: bytes, retired: Column, ids: Column) -> Column:
    """Digest of a pair with encoded ids _source_e, _survivor_e and record prints _source_p, _survivor_p."""
    swap = F.col("_source_e") > F.col("_survivor_e")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    body = F.to_json(F.array(pick("_source_e", "_survivor_e"), pick("_survivor_e", "_source_e"), pick("_source_p", "_survivor_p"), pick("_survivor_p", "_source_p"), F.lit(d.revision), retired.cast("string"), ids))
    return keyed(key, ["pair", d.id], body)


def _sorted_ids(c: Column) -> Column:
    return F.array_join(F.array_sort(F.coalesce(c, no_texts())), ",")


def fingerprints(d: Definition, pairs: DataFrame, records: DataFrame, key: bytes, children: DataFrame | None = None, retired: Column | None = None) -> DataFrame:
    """One digest per pair over both records, the revision, whether the source is retired, and the children.

    ``children`` has PAIR and child_ids.
    """
    prints = records.select(F.col(d.key).cast("string").alias("_k"), encode_id(record_id(F.col(d.key), records.schema[d.key].dataType)).alias("_e"), record_print(d, records.schema, key).alias("_p"))
    p = pairs
    for side in ("source", "survivor"):
        p = p.join(prints.select(F.col("_k").alias(f"{side}_id"), F.col("_e").alias(f"_{side}_e"), F.col("_p").alias(f"_{side}_p")), f"{side}_id")
    if children is not None:
        p = p.join(children, PAIR, "left")
    ids = F.lit("") if children is None else _sorted_ids(F.col("child_ids"))
    return p.select(*PAIR, _pair_print(d, key, F.lit(False) if retired is None else retired, ids).alias("fingerprint"))


def _is_field(name: str):
    return lambda x: x["field"] == name


def _prefixed(text: str):
    return lambda x: F.concat(F.lit(text), x)


def _compared(d: Definition, pairs: DataFrame, records: DataFrame, key: bytes) -> DataFrame:
    """Pairs of two visible records: title, permission, differences, errors and prints, from one join with each side."""
    schema, names = records.schema, set(records.columns)
    own = records.withColumn("_p", record_print(d, schema, key)).withColumn("_e", encode_id(record_id(F.col(d.key), schema[d.key].dataType))).withColumn("_may", d.authorizer.view())
    p = joined(d, pairs.where("source_id <> survivor_id"), own)
    p = p.withColumn("differences", differences(d, schema))
    title = F.col(f"survivor__{d.title}") if d.title else None
    permitted = F.coalesce(d.authorizer.pair() & F.col("source___may") & F.col("survivor___may"), F.lit(False))
    held = F.struct(*PAIR, plan_title(title, F.col(f"survivor__{d.key}")).alias("survivor_title"), permitted.alias("permitted"), "differences", *[F.col(f"{side}__{c}").alias(f"_{side}{c}") for side in ("source", "survivor") for c in ("_e", "_p")])
    if d.validator is None:
        return p.select(held.alias("_held")).select("_held.*", no_texts().alias("errors"))
    taken = {f.name: F.when(F.element_at(F.filter("differences", _is_field(f.name)), 1)["resolution"].isin("both_missing", "take_source"), F.col(f"source__{f.name}")).otherwise(F.col(f"survivor__{f.name}")) for f in d.fields if f.name in names}
    p = p.select(held.alias("_held"), *[c.alias(n) for n, c in taken.items()])
    return p.select("_held.*", d.validator().alias("errors"))


def _per_parent(d: Definition, r: Relation, ends: DataFrame, children: DataFrame) -> DataFrame:
    """Children of the parents in ``ends`` (parent, is_source), counted once a parent: n, may, and of sources their encoded ids in order."""
    rid = record_id(F.col(r.key), children.schema[r.key].dataType)
    own = inventory(r, children).select(F.col(r.foreign_key).cast("string").alias("parent"), F.struct(id_order(rid).alias("o"), encode_id(rid).alias("id")).alias("_id"), d.authorizer.child().alias("_may"))
    own = own.join(ends, "parent")
    ids = F.array_sort(F.collect_list(F.when(F.col("is_source"), F.col("_id"))))
    return own.groupBy("parent").agg(F.count("*").alias("n"), F.bool_and("_may").alias("may"), ids.alias("x")).select("parent", "n", "may", F.col("x.id").alias("ids"))


def _related(d: Definition, r: Relation, p: DataFrame, pairs: DataFrame, children: DataFrame) -> DataFrame:
    """Adds the impact, the moved children and the blockers of a relation, as _i, _m and _b with its name."""
    sources = pairs.select(F.col("source_id").alias("parent"), F.lit(True).alias("is_source"))
    ends = sources.unionByName(pairs.select(F.col("survivor_id").alias("parent"), F.lit(False).alias("is_source"))).groupBy("parent").agg(F.bool_or("is_source").alias("is_source"))
    per = cut(_per_parent(d, r, ends, children))
    hit = collisions(r, pairs, children).select(*PAIR, F.lit(True).alias("_hit")).distinct()
    source = per.select(F.col("parent").alias("source_id"), F.col("n").alias("_moving"), "may", "ids")
    survivor = per.select(F.col("parent").alias("survivor_id"), F.col("n").alias("_current"))
    p = p.join(source, "source_id", "left").join(survivor, "survivor_id", "left").join(hit, PAIR, "left")
    moving, current = F.coalesce("_moving", F.lit(0)), F.coalesce("_current", F.lit(0))
    summary = F.format_string("Move %d %s to %s; resulting total %d.", moving, F.lit(r.name), F.col("survivor_id"), moving + current)
    impact = F.struct(F.lit(r.name).alias("relation"), moving.alias("moving"), current.alias("current"), (moving + current).alias("resulting"), summary.alias("summary"))
    moved = F.struct(F.lit(r.name).alias("relation"), moving.alias("count"), F.coalesce("ids", no_texts()).alias("child_ids"))
    blockers = F.concat(
        _one(~F.coalesce("may", F.lit(True)), f"forbidden_operation:{r.name}"),
        _one(F.lit(False) if r.cap is None else moving > r.cap, f"merge_too_large:{r.name}"),
        _one(F.coalesce("_hit", F.lit(False)), f"collision:{r.name}"),
    )
    p = p.withColumn(f"_i_{r.name}", impact).withColumn(f"_m_{r.name}", moved).withColumn(f"_b_{r.name}", blockers)
    return p.drop("_moving", "_current", "may", "ids", "_hit")


def no_texts() -> Column:
    return F.array().cast("array<string>")


def _one(c: Column, text: str) -> Column:
    return F.when(c, F.array(F.lit(text))).otherwise(no_texts())


def _retired(d: Definition, p: DataFrame, ledger: DataFrame | None, domain: str, kind: T.DataType) -> DataFrame:
    """Adds source_retired and survivor_retired, by id and, where the ledger has it, type of id."""
    for side in ("source", "survivor"):
        if ledger is None:
            p = p.withColumn(f"{side}_retired", F.lit(False))
            continue
        on = [f"{side}_id"] + ([f"{side}_type"] if "source_id_type" in ledger.columns else [])
        gone = ledger.where(F.col("retirement_domain") == domain).select(F.col("source_id").alias(f"{side}_id"), *[F.col("source_id_type").alias(f"{side}_type") for _ in on[1:]]).distinct()
        p = p.withColumn(f"{side}_type", key_domain(F.col(f"{side}_id"), kind)).join(gone.withColumn("_gone", F.lit(True)), on, "left")
        p = p.withColumn(f"{side}_retired", F.coalesce("_gone", F.lit(False))).drop("_gone", f"{side}_type")
    return p


def plan(d: Definition, pairs: DataFrame, records: DataFrame, children: Mapping[str, DataFrame], ledger: DataFrame | None, domain: str, key: bytes, memberships: DataFrame | None = None) -> DataFrame:
    """One plan per pair: differences, impacts, blockers, reasons, fingerprint and what would move.

    ``records`` are the visible ones, ``children`` the tables of the relations by name.
    Blockers come in the order of the checks; choice_required ones can be answered, the
    others are fatal. A pair with a record that is not visible gets only that blocker.
    Pairs and compared records are computed once; each relation is read once to count its
    children by parent and once for its unique keys.
    """
    schema = records.schema
    report = validate(d, {d.table: schema, **{r.table: children[r.name].schema for r in d.relations}})
    config = [i.message for i in report.issues if i.severity == "blocker"]
    pairs = cut(pairs.select(*PAIR).distinct())
    p = cut(pairs.join(_compared(d, pairs, records, key), PAIR, "left"))
    p = _retired(d, p, ledger, domain, schema[d.key].dataType)
    for r in d.relations:
        p = _related(d, r, p, pairs, children[r.name])
    if memberships is not None:
        from .suggest import direct_matches

        p = p.join(direct_matches(pairs, memberships).withColumnRenamed("rules", "reasons"), PAIR, "left")
    else:
        p = p.withColumn("reasons", F.lit(None).cast("array<string>"))
    unique = sorted({c for k in d.unique_keys for c in k})
    choices = F.transform(F.filter("differences", lambda x: x["resolution"] == "choice_required"), lambda x: F.concat(F.lit("choice_required:"), x["field"]))
    on_unique = F.transform(F.filter("differences", lambda x: (x["resolution"] == "choice_required") & x["field"].isin(unique)), lambda x: F.concat(F.lit("unique_field:"), x["field"]))
    seen, same = F.col("differences").isNotNull(), F.col("source_id") == F.col("survivor_id")
    blockers = F.concat(
        F.array(*[F.lit(f"invalid_configuration:{m}") for m in config]).cast("array<string>"),
        _one(same, "same_record"),
        _one(~seen & ~same, "record_unavailable"),
        _one(seen & ~F.coalesce("permitted", F.lit(False)), "forbidden_operation"),
        _one(F.col("source_retired"), "source_retired"),
        _one(F.col("survivor_retired"), "survivor_retired"),
        *[F.col(f"_b_{r.name}") for r in d.relations],
        F.coalesce(choices, no_texts()),
        F.coalesce(on_unique, no_texts()),
        F.coalesce(F.transform("errors", lambda x: F.concat(F.lit("invalid:"), x)), no_texts()),
    )
    impacts_of = F.array(*[F.col(f"_i_{r.name}") for r in d.relations]) if d.relations else F.array().cast("array<struct<relation:string,moving:bigint,current:bigint,resulting:bigint,summary:string>>")
    moved = F.array(*[F.col(f"_m_{r.name}") for r in d.relations]) if d.relations else F.array().cast("array<struct<relation:string,count:bigint,child_ids:array<string>>>")
    ids = F.concat(no_texts(), *[F.transform(F.col(f"_m_{r.name}.child_ids"), _prefixed(f"{r.name}/")) for r in d.relations])
    print_ = F.when(F.col("_source_e").isNotNull(), _pair_print(d, key, F.col("source_retired"), _sorted_ids(ids)))
    return p.select(*PAIR, "survivor_title", "differences", impacts_of.alias("impacts"), F.array_distinct(blockers).alias("blockers"), "reasons", print_.alias("fingerprint"), moved.alias("moved"))


def fatal(blockers: Column) -> Column:
    """Blockers that no choice can answer."""
    return F.array_except(blockers, F.filter(blockers, lambda x: x.startswith("choice_required:")))


def confirmable(blockers: Column) -> Column:
    """No blocker at all."""
    return F.size(blockers) == 0


def can_confirm(blockers: Column, choices: Column) -> Column:
    """No fatal blocker, and a choice for every field that needs one. ``choices`` maps field to source or survivor."""
    needed = F.transform(F.filter(blockers, lambda x: x.startswith("choice_required:")), lambda x: F.substring_index(x, ":", -1))
    return (F.size(fatal(blockers)) == 0) & F.forall(needed, lambda f: F.coalesce(choices[f].isin("source", "survivor"), F.lit(False)))
