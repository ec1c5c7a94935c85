"""Dismissals: pairs that reviewers declared not to be duplicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digest import pair_hash

SCHEMA = "scope_id string, pair_hash string, record_ids array<string>, signatures struct<low:map<string,string>,high:map<string,string>>, config_revision string, definition_revision string, actor_ref string, reopened_at timestamp, created_at timestamp, updated_at timestamp"


def rows(pairs: DataFrame, signature_maps: DataFrame, key: bytes, scope: str, revision: str, actor: str, now: dt.datetime, config_revision: str = "1") -> DataFrame:
    """Dismissal rows for pairs (a, b) of encoded ids that both have keys now."""
    p = pairs.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    sig = signature_maps.select(F.concat("record_id_type", F.lit(":"), "record_id").alias("id"), "signatures")
    p = p.join(sig.select(F.col("id").alias("low"), F.col("signatures").alias("ls")), "low").join(sig.select(F.col("id").alias("high"), F.col("signatures").alias("hs")), "high")
    at = F.lit(now).cast("timestamp")
    return p.select(
        F.lit(scope).alias("scope_id"),
        pair_hash(key, scope, F.col("low"), F.col("high")).alias("pair_hash"),
        F.array("low", "high").alias("record_ids"),
        F.struct(F.col("ls").alias("low"), F.col("hs").alias("high")).alias("signatures"),
        F.lit(config_revision).alias("config_revision"),
        F.lit(revision).alias("definition_revision"),
        F.lit(actor).alias("actor_ref"),
        F.lit(None).cast("timestamp").alias("reopened_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def upsert(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row per (scope, pair): the fresh one where there is one, with the older created_at; it is open again."""
    both = held.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("scope_id", "pair_hash")
    latest = both.withColumn("created_at", F.min("created_at").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc("_new"), F.desc("updated_at"))))
    return latest.where("_rn = 1").drop("_rn", "_new")


def reopen(held: DataFrame, hashes: list[str], scope: str, now: dt.datetime) -> DataFrame:
    hit = (F.col("scope_id") == scope) & F.col("pair_hash").isin(hashes)
    at = F.lit(now).cast("timestamp")
    return held.withColumn("reopened_at", F.when(hit, at).otherwise(F.col("reopened_at"))).withColumn("updated_at", F.when(hit, at).otherwise(F.col("updated_at")))


def dismissed(pairs: DataFrame, signature_maps: DataFrame, held: DataFrame, key: bytes, scope: str, revision: str) -> DataFrame:
    """The pairs (low, high) that are dismissed: not reopened, same revision, same keys on both sides."""
    now = rows(pairs, signature_maps, key, scope, revision, "", dt.datetime(1970, 1, 1))
    now = now.select(F.col("record_ids")[0].alias("low"), F.col("record_ids")[1].alias("high"), "pair_hash", F.to_json("signatures").alias("sig"))
    live = held.where((F.col("scope_id") == scope) & F.col("reopened_at").isNull() & (F.col("definition_revision") == revision)).select("pair_hash", F.to_json("signatures").alias("sig"))
    return now.join(live, ["pair_hash", "sig"], "left_semi").select("low", "high")
