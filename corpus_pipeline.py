"""A corpus pipeline of five stages over documents: run(spark, sf_dir).

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import decontaminate, mixture, setjoin, shared, tokenids, toxicity
from kinfold.llm.queries import bound_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model of the labels table."""
    bound_batches(spark)
    return toxicity.reject(docs, shared.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    bound_batches(spark)
    return setjoin.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bound_batches(spark)
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the production mix, each as often as it is taken."""
    return mixture.mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, and a row per document read back from them."""
    bound_batches(spark)
    folder = shared.work_dir(spark, "pipeline-ids")
    manifest = tokenids.write(docs, tokenids.public_vocabulary, folder)
    return tokenids.read(spark, folder, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixture", mix_sources),
    ("token_ids", write_token_ids),
]

#: Stages learn models and write files, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what is between them is Parquet in the shared folder."""
    folder = shared.work_dir(spark, "pipeline")
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
