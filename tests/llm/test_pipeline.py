"""The pipeline's stages on a small table, against plain versions."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from kinfold.llm import mixture, tokenids, toxicity

from .brute import classes, shingles

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = docs, docs.columns
    tables = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, kept, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        kept = spark.read.parquet(f"file://{tmp_path}/{k}")
        tables[name] = [tuple(r) for r in kept.collect()]
        if k < len(cp.STAGES) - 1:
            assert kept.columns == columns
    before = [tuple(r) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    p = toxicity.probabilities([r[1] for r in before], model)[0]
    mild = [r for r, x in zip(before, p) if x < 0.3]
    assert sorted(tables["toxicity"]) == sorted(mild) and len(mild) < len(before)
    named = classes([(r[0], r[1]) for r in mild])
    single = [r for r, c in zip(mild, named) if c[0] == c[1]]
    assert sorted(tables["ngram_jaccard_join"]) == sorted(single) and len(single) < len(mild)
    items = [shingles_alnum(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r for r in single if not any(len(shingles_alnum(r[1]) & i) >= 0.8 * len(i) for i in items)]
    assert sorted(tables["benchmark_decontamination"]) == sorted(clean)
    mixed = tables["source_mixture"]
    assert set(mixed) <= set(clean) and mixed
    size = lambda t: t.count(" ") + t.count("\n") + 1
    assert sum(size(r[1]) for r in mixed) <= mixture.PRODUCTION.share * sum(size(r[1]) for r in clean)
    t, start, want = Tokenizer.from_file(tokenids.public_vocabulary()), 0, []
    for r in sorted(mixed, key=lambda r: (r[0], r[1])):
        ids = np.array(t.encode(r[1], add_special_tokens=False).ids + [2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tables["token_ids"]) == want


def shingles_alnum(text):
    return shingles("".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text))


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
