import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import shared, tokenids

PATH = tokenids.public_vocabulary()


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(-(2**63) + 1, 2**63 - 1), min_size=1, max_size=300))
def test_minimal_perfect_hash(keys):
    keys = np.array(sorted(keys), np.int64)
    pilots, seed = tokenids.build_mph(keys)
    assert sorted(tokenids.find(keys, pilots, seed, len(keys))) == list(range(len(keys)))


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(max_size=60), max_size=5))
def test_words_apart_are_the_library_on_whole_texts(texts):
    assert tokenids.splits_at_blanks(PATH)
    got = tokenids.Encoder(PATH, 2, True, keep=7).encode(texts)
    want = [np.asarray(x.ids, "<u2").tobytes() for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_other_vocabularies_go_whole():
    import public_tokenizers

    assert not tokenids.splits_at_blanks(public_tokenizers.path("byte_bpe_50k.json"))


def test_round_trip(spark):
    rows = [(3, "Hello there, world"), (None, "no id"), (1, ""), (2, None), (3, "Hello again"), (3, "Hello again"), (-5, "naïve café <|endoftext|> 's 123"), (2**62, "x " * 5000)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, start string, n_tokens int")
    folder = shared.work_dir(spark, "t")
    manifest = tokenids.write(df, PATH, folder, shards=3)
    t = Tokenizer.from_file(PATH)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, x in ordered:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r)[:4] for r in tokenids.read(spark, folder, manifest).orderBy("start").collect()]
    assert got == want
    assert len(tokenids.lookup(folder, manifest, 3)) == 3 and len(tokenids.lookup(folder, manifest, None)) == 1
    assert tokenids.lookup(folder, manifest, 4) == [] and tokenids.lookup(folder, manifest, 2)[0].tolist() == [2]
    # A four-byte shard gives the same ids.
    wide = shared.work_dir(spark, "t4")
    m4 = tokenids.write(df, PATH, wide, end_id=70_000, shards=2)
    assert tokenids.lookup(wide, m4, 2)[0].tolist() == [70_000]


def test_empty_table_and_strangers(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = shared.work_dir(spark, "t")
    assert tokenids.write(df, PATH, folder) == []
    assert tokenids.read(spark, folder, []).count() == 0
    keys = np.arange(1000, dtype=np.int64)
    pilots, seed = tokenids.build_mph(keys)
    at = tokenids.find(keys, pilots, seed, 1000)
    prints = np.zeros(1000, np.uint32)
    prints[at] = tokenids.fingerprint(keys)
    strangers = np.arange(10**6, 2 * 10**6, dtype=np.int64)
    assert (prints[tokenids.find(strangers, pilots, seed, 1000)] == tokenids.fingerprint(strangers)).mean() < 1e-4
    with pytest.raises(ValueError):
        tokenids.build_mph(np.array([1, 1], np.int64))


def test_a_lookup_reads_a_few_bytes_of_a_reopened_folder(spark, monkeypatch):
    n = 20_000
    df = spark.range(n).selectExpr("id * 3 as doc_id", "concat('word ', id, ' and more') as text")
    folder = shared.work_dir(spark, "t")
    tokenids.write(df, PATH, folder, shards=4)
    manifest, read, total = tokenids.load_manifest(folder), tokenids.Shard._read, []
    assert [r["rows"] for r in manifest] and sum(r["rows"] for r in manifest) == n

    def counted(self, offset, size):
        total.append(size)
        return read(self, offset, size)

    monkeypatch.setattr(tokenids.Shard, "_read", counted)
    t = Tokenizer.from_file(PATH)
    for i in (0, 7, 12_345, n - 1):
        total.clear()
        (ids,) = tokenids.lookup(folder, None, 3 * i)
        assert ids.tolist() == t.encode(f"word {i} and more", add_special_tokens=False).ids + [2]
        assert sum(total) <= tokenids.TRAILER + 4 + 12 + 1 + 8 + 16 + 2 * len(ids) and len(total) <= 7
    assert tokenids.lookup(folder, None, 1) == [] and tokenids.lookup(folder, None, 3 * n) == []
    assert tokenids.read(spark, folder).count() == n


def test_an_id_of_many_rows_spans_shards(spark):
    rows = [(5, f"{k:05d} text") for k in range(3000)] + [(None, f"{k:05d} none") for k in range(3000)] + [(i, "x") for i in range(10, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = shared.work_dir(spark, "t")
    manifest = tokenids.write(df, PATH, folder, shards=12)
    assert max(r["rows"] for r in manifest) < 1500
    assert len(tokenids.lookup(folder, None, 5)) == 3000 and len(tokenids.lookup(folder, None, None)) == 3000 and len(tokenids.lookup(folder, None, 11)) == 1
    got = [(r["doc_id"], r["n_tokens"]) for r in tokenids.read(spark, folder).orderBy("start").collect()]
    t = Tokenizer.from_file(PATH)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(i, len(t.encode(x, add_special_tokens=False).ids) + 1) for i, x in want]


def test_letters_are_parted_from_stops_only_where_the_pattern_does():
    from tokenizers import Regex, Tokenizer as T, models, pre_tokenizers

    assert tokenids.parts_stops(T.from_file(PATH), tokenids.Encoder._STOPS)
    t = T(models.BPE())
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[^\s]+"), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    assert not tokenids.parts_stops(t, tokenids.Encoder._STOPS)
