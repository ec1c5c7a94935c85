"""From records to memberships: one digest per record and rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import keyed
from ..functions.values import record_id
from ..plans.definition import Definition


def rule_digest(d: Definition, rule, key: bytes, schema) -> Column:
    """Keyed digest of a rule's tuple; null where the rule gives no key."""
    return keyed(key, [d.id, rule.id, rule.signature, d.revision], rule.components(schema, dict(d.logical)))


def with_record_id(d: Definition, df: DataFrame) -> DataFrame:
    """Adds record_id and record_id_type, both text."""
    rid = record_id(F.col(f"`{d.key}`"), df.schema[d.key].dataType)
    return df.withColumn("_rid", rid).withColumn("record_id", F.col("_rid.value")).withColumn("record_id_type", F.col("_rid.type")).drop("_rid")


def build_keys(d: Definition, df: DataFrame, key: bytes) -> DataFrame:
    """rule_id, digest, record_id, record_id_type: up to one row per record and rule.

    The records are read once; the rules of a row are an array that is exploded.
    """
    rows = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), rule_digest(d, r, key, df.schema).alias("digest")) for r in d.rules])
    out = with_record_id(d, df).select("record_id", "record_id_type", F.explode(rows).alias("k"))
    return out.select("k.rule_id", "k.digest", "record_id", "record_id_type").where(F.col("digest").isNotNull() & F.col("record_id").isNotNull())


def signatures(memberships: DataFrame) -> DataFrame:
    """record_id, record_id_type and the map rule -> digest in order of the rules."""
    entries = F.array_sort(F.collect_list(F.struct("rule_id", "digest")))
    return memberships.groupBy("record_id", "record_id_type").agg(F.map_from_entries(entries).alias("signatures"))
