"""Resumable scans over files that keep arriving.

The stream's checkpoint is the cursor. Every micro-batch overwrites a folder named by its
number, so a batch that runs again leaves the same rows; memberships and cursor therefore
advance together. A late change is seen by the next scan and by live review.

A batch leaves one row for every record it saw and every rule, with a null digest where the
record has no key under the rule or has left the scope. So the latest batch of a record
says all about it, and a key that disappeared is gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keys import build_keys, with_record_id
from ..plans.definition import Definition, scoped

RECORD = ["record_id", "record_id_type"]
_SCHEMA = "rule_id string, digest string, record_id string, record_id_type string"


def batch_rows(d: Definition, context, batch: DataFrame, key: bytes) -> DataFrame:
    """rule_id, digest (null for none) of every record of a batch and every rule.

    Of a record that comes several times in one batch the row updated last counts, if the
    definition has such a column, else the one with the largest values.
    """
    order = [F.desc(d.updated_at)] if d.updated_at else []
    w = Window.partitionBy(*RECORD).orderBy(*order, F.desc(F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns]))))
    last = with_record_id(d, batch).where("record_id is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    rules = last.select(*RECORD, F.explode(F.array(*[F.lit(r.id) for r in d.rules])).alias("rule_id"))
    own = build_keys(d, scoped(d, last.select(*batch.columns), context), key)
    return rules.join(own, ["rule_id", *RECORD], "left").select("rule_id", "digest", *RECORD)


def start(spark: SparkSession, d: Definition, context, source: str, schema, out: str, checkpoint: str, key: bytes, files_per_batch: int = 64) -> StreamingQuery:
    """Index all files of ``source`` (a folder or a pattern of files) that the checkpoint has not seen, then stop."""

    def index(batch: DataFrame, number: int) -> None:
        batch_rows(d, context, batch, key).write.mode("overwrite").parquet(f"{out}/batch_id={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def memberships(spark: SparkSession, out: str) -> DataFrame:
    """What the latest batch of each record says of it; nothing where no batch has been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.isDirectory() and s.getPath().getName().startswith("batch_id=") for s in fs.listStatus(path)):
        return spark.createDataFrame([], _SCHEMA)
    rows = spark.read.schema(f"{_SCHEMA}, batch_id long").parquet(out)
    latest = rows.groupBy("rule_id", *RECORD).agg(F.max_by("digest", "batch_id").alias("digest"))
    return latest.where("digest is not null").select("rule_id", "digest", *RECORD)
