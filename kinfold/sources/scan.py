"""Reads of host tables. Predicates and projections reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..errors import RecordUnavailable
from ..plans.definition import Definition, scoped, visible


def host(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a relational database, read in ranges of its key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.options(**options).load()


def by_key(d: Definition, df: DataFrame, context, value, trashed: bool = False) -> Row:
    """One visible record, or RecordUnavailable."""
    rows = visible(d, df, context, trashed).where(F.col(d.key) == F.lit(value)).limit(1).collect()
    if not rows:
        raise RecordUnavailable(f"no record {value}")
    return rows[0]


def by_keys(d: Definition, df: DataFrame, context, keys: DataFrame) -> DataFrame:
    """The wanted keys (record_id, text) with their visible records, null where there is none."""
    own = visible(d, df, context)
    return keys.join(own, own[d.key].cast("string") == keys["record_id"], "left")


def keyset_chunk(d: Definition, df: DataFrame, context, after, size: int) -> DataFrame:
    """The next rows of the scope by key; there may be more exactly when it has ``size`` rows."""
    own = scoped(d, df, context)
    if after is not None:
        own = own.where(F.col(d.key) > F.lit(after))
    return own.orderBy(d.key).limit(size)


def stream_rows(df: DataFrame) -> Iterator[Row]:
    """Rows one partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)
