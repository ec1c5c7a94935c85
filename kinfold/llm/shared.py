"""The shared working folder, folds of documents, and bounded samples for training."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where the setting is absent and all of Spark runs on one machine (tests) a temporary
    folder is set; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="kinfold-"))
    return sc.getCheckpointDir()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(path: str) -> str | None:
    """The plain path of a file: URI or an absolute path, else None."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    return path if os.path.isabs(path) else None


def filesystem(path: str):
    """A pyarrow file system and the path in it, for any URI that pyarrow knows."""
    from pyarrow import fs

    local = local_path(path)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with a short lineage, kept in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True for rows of the fold that no model learns from; a null id is not of it."""
    return F.coalesce(fold(doc_id, parts) == F.lit(part), F.lit(False))


def unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a text up to which it may be learned from: with the rows of a sample this bounds the driver's memory.
SAMPLE_TEXT_BYTES = 256 << 10


def learnable(text: Column) -> Column:
    """Texts that may come to the driver in a sample. Scores are of texts of any length."""
    return text.isNotNull() & (F.octet_length(text) <= SAMPLE_TEXT_BYTES)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, parts: int, part: int) -> tuple[list[str], list[int]]:
    """About ``bound`` labelled texts outside the held-out fold, for training on the driver.

    Rows are chosen by a hash of the id at the rate bound / labelled rows, so the sample
    does not grow with the corpus and every text is whole. Rows with a null id, label or
    text and texts beyond ``SAMPLE_TEXT_BYTES`` are left out. Of an id with several rows all take part.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), parts, part))
    known = known.select("doc_id", F.col(label).cast("int").alias("y"))
    total = known.count()
    rate = min(1.0, bound / max(1, total))
    # The sampled labels are bounded by construction, so this side may be broadcast.
    picked = known.where(unit(F.col("doc_id"), F.lit(label)) < F.lit(rate))
    rows = docs.select("doc_id", "text").where(learnable(F.col("text"))).join(F.broadcast(picked), "doc_id").toPandas()
    rows = rows.sort_values(["doc_id", "text", "y"], kind="stable")
    return rows["text"].tolist(), rows["y"].astype(int).tolist()


def map_texts(docs: DataFrame, make, columns: str) -> DataFrame:
    """doc_id and the Arrow arrays ``make(texts)`` gives for a batch of whole texts.

    Arrow keeps ids exact where some are null.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *(cols := make(b.column(1).to_pylist()))], names=["doc_id", *map(str, range(len(cols)))])

    names = [c.strip().split(" ")[0] for c in columns.split(";")]
    raw = "doc_id long, " + ", ".join(f"`{i}` {c.strip().split(' ', 1)[1]}" for i, c in enumerate(columns.split(";")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, raw).toDF("doc_id", *names)


def keep_texts(docs: DataFrame, wanted) -> DataFrame:
    """The rows, with all their columns as they are, for whose texts ``wanted(texts)`` is true."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.filter(pa.array(wanted(b.column(b.schema.get_field_index("text")).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def per_process(key, make):
    """What ``make()`` gave in this process first, kept for later tasks of the same Python worker.

    Functions of this package arrive by value, so their own module globals last one task only.
    """
    import sys
    import types

    held = sys.modules.setdefault("_kinfold_process", types.ModuleType("_kinfold_process")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
