"""The merge ledger: retired records, chains to the surviving record, guards and migration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DomainConflict
from ..functions.values import key_domain
from ..sources.work import cut

#: Fixed value: hops after which a chain counts as unresolvable.
MAX_HOPS = 10

LEDGER = "id string, operation_id string, scope_id string, retirement_domain string, source_id string, source_id_type string, survivor_id string, survivor_id_type string, actor_ref string, definition_revision string, audit_payload binary, committed_at timestamp, retirement_domain_version int, created_at timestamp, updated_at timestamp"


def is_retired(rows: DataFrame, ledger: DataFrame, domain: str) -> DataFrame:
    """Adds retired: whether (record_id, record_id_type) is a source in the domain."""
    gone = ledger.where(F.col("retirement_domain") == domain).select(F.col("source_id").alias("record_id"), F.col("source_id_type").alias("record_id_type"), F.lit(True).alias("_g")).distinct()
    return rows.join(gone, ["record_id", "record_id_type"], "left").withColumn("retired", F.coalesce("_g", F.lit(False))).drop("_g")


def survivors(ids: DataFrame, ledger: DataFrame, domain: str, visible: DataFrame | None = None, max_hops: int = MAX_HOPS) -> DataFrame:
    """record_id, survivor_id, hops, status for each record_id.

    Ids are told apart by their type too, where ledger and ids have types; then record_id_type
    and survivor_id_type come out as well. The ledger is composed with itself until its steps
    span more than ``max_hops`` hops: each of the few compositions is one join of the ledger,
    computed once. status: resolved; unresolvable for a loop or more than ``max_hops`` hops;
    invisible where the survivor is not in ``visible`` (record_id).
    """
    typed = {"source_id_type", "survivor_id_type"} <= set(ledger.columns) and "record_id_type" in ids.columns

    def name(x: str):
        return F.struct((F.col(f"{x}_type") if typed else F.lit("")).alias("type"), F.col(x).alias("id"))

    steps = ledger.where(F.col("retirement_domain") == domain).select(name("source_id").alias("_s"), name("survivor_id").alias("_t"), F.lit(1).alias("_h"))
    for _ in range(max_hops.bit_length()):
        on = steps.select(F.col("_s").alias("_t"), F.col("_t").alias("_t2"), F.col("_h").alias("_h2"))
        steps = cut(steps.join(on, "_t", "left").select("_s", F.coalesce("_t2", "_t").alias("_t"), (F.col("_h") + F.coalesce("_h2", F.lit(0))).alias("_h")))
    out = ids.select(name("record_id").alias("_r")).distinct().join(steps, F.col("_r") == F.col("_s"), "left")
    out = out.select("_r", F.coalesce("_t", "_r").alias("at"), F.coalesce("_h", F.lit(0)).alias("hops"))
    status = F.when(F.col("hops") > max_hops, "unresolvable")
    if visible is not None:
        on = ["_v"] + (["_vt"] if typed and "record_id_type" in visible.columns else [])
        seen = visible.select(F.col("record_id").alias("_v"), *[F.col("record_id_type").alias("_vt") for _ in on[1:]]).distinct()
        out = out.withColumn("_v", F.col("at.id")).withColumn("_vt", F.col("at.type")).join(seen.withColumn("_seen", F.lit(True)), on, "left")
        status = status.when(F.col("_seen").isNull(), "invisible")
    status = status.otherwise("resolved")
    kept = F.when(status == "resolved", F.col("at"))
    shown = [F.col("_r.id").alias("record_id"), kept["id"].alias("survivor_id"), F.least("hops", F.lit(max_hops)).alias("hops"), status.alias("status")]
    return out.select(*shown, *([F.col("_r.type").alias("record_id_type"), kept["type"].alias("survivor_id_type")] if typed else []))


def mappings(ledger: DataFrame, domain: str) -> DataFrame:
    """Edges of the domain in order of their commit."""
    return ledger.where(F.col("retirement_domain") == domain).select("source_id", "survivor_id", "committed_at", "operation_id").orderBy("committed_at", "operation_id")


def guard_new_children(incoming: DataFrame, foreign_key: str, live_parents: DataFrame, ledger: DataFrame, domain: str) -> DataFrame:
    """Incoming child rows whose parent is live and not retired; null foreign keys pass.

    ``live_parents`` has record_id. Types of ids count where parents or ledger have them.
    """
    own = incoming.withColumn("_id", F.col(foreign_key).cast("string")).withColumn("_type", key_domain(F.col(foreign_key), incoming.schema[foreign_key].dataType))

    def side(rows: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
        kinds = [F.col(f"{name}_type").alias("_type")] if f"{name}_type" in rows.columns else []
        return rows.select(F.col(name).alias("_id"), *kinds).distinct(), ["_id", "_type"][: 1 + len(kinds)]

    gone, on_gone = side(ledger.where(F.col("retirement_domain") == domain), "source_id")
    parents, on_parents = side(live_parents, "record_id")
    bound = own.where(F.col("_id").isNotNull()).join(parents, on_parents, "left_semi").join(gone, on_gone, "left_anti")
    return bound.select(*incoming.columns).unionByName(incoming.where(F.col(foreign_key).isNull()))


def migrate(ledger: DataFrame, to: Mapping[str, str]) -> DataFrame:
    """Rewrite version 1 domains by a mapping old -> new; one unknown domain aborts all of it.

    Domains are few (one per definition), so the check runs on the driver.
    """
    old = [r[0] for r in ledger.where("retirement_domain_version = 1").select("retirement_domain").distinct().collect()]
    if unknown := sorted(set(old) - set(to)):
        raise DomainConflict(f"no definition owns the ledger domain {unknown[0]}")
    if not old:
        return ledger
    new = F.create_map(*[F.lit(x) for k in old for x in (k, to[k])])[F.col("retirement_domain")]
    first = F.col("retirement_domain_version") == 1
    return ledger.withColumn("retirement_domain", F.when(first, new).otherwise(F.col("retirement_domain"))).withColumn("retirement_domain_version", F.lit(2))


def duplicate_sources(ledger: DataFrame) -> DataFrame:
    """Violations of the terminal guard: a source that was merged twice in a domain. Must be empty."""
    return ledger.groupBy("retirement_domain", "source_id_type", "source_id").agg(F.count("*").alias("n")).where("n > 1")
