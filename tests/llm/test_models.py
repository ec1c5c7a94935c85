"""Quality, toxicity and language: held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest

from kinfold.llm import langid, quality, shared, toxicity
from kinfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "   \n"), (None, "word"), (5, "12 34 !!"), (5, "12 34 !!"), (7, "idiot " * 3), (2**60 + 1, "x" * 300_000)]


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return docs, labels


def odd(spark):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in ODD], "doc_id long, text string, lang string, score double")


def test_quality_holds_out(spark, labelled):
    rows = {r["doc_id"]: r for r in QUERIES["op1_quality"](spark, SF).collect()}
    docs, labels = labelled
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [(x.quality, rows[x.doc_id]["score"]) for x in labels.itertuples() if fold(x.doc_id, 4) == 2]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.85


def test_toxicity_holds_out_and_locates(spark, labelled):
    rows = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, SF).collect()}
    docs, labels = labelled
    assert len(rows) == len(docs) and all(r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    held = [(x.toxic, rows[x.doc_id]["score"]) for x in labels.itertuples() if fold(x.doc_id, 4) == 2 and docs.lang[x.doc_id] == "en"]
    good, bad = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_noisy_or_blames_the_sentence(spark):
    rng = np.random.default_rng(0)
    plain = [" ".join(rng.choice(["the", "of", "and", "tree", "house", "river"], 8)) + "." for _ in range(400)]
    texts, labels = [], []
    for i in range(200):
        own = [plain[j] for j in rng.integers(0, 400, 6)]
        if i % 4 == 0:
            own[3] = "You blithering nitwit there."
        texts.append(" ".join(own))
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(texts, labels)
    p, per, span = toxicity.probabilities(texts[:4], model)
    assert p[0] > 0.9 and p[1:].max() < 0.1 and int(np.argmax(per[0])) == 3
    a, b = span[0][3]
    assert "nitwit" in texts[0].lower().encode()[a:b].decode()
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels))], "doc_id long, text string, other int")
    scored = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert len(scored[0]["offending"]) == 1 and not scored[1]["offending"]


def test_language_holds_out(spark, labelled):
    rows = {r["doc_id"]: r for r in QUERIES["op4_language"](spark, SF).collect()}
    docs, _ = labelled
    held = [rows[i]["lang_pred"] == docs.lang[i] for i in docs.index if fold(i, 3) == 1]
    assert np.mean(held) > 0.97 and all(rows[i]["held_out"] == (fold(i, 3) == 1) for i in docs.index)


def test_bloom_masks_name_every_language():
    texts = ["aaaa bbbb cccc " * 20, "dddd bbbb eeee " * 20, "ffff gggg " * 20]
    f = langid.fit(texts, ["x", "y", "z"])
    g, _ = langid.grams(["bbbb"])
    at = langid._places(g, f.settings)
    masks = f.masks[at[0]] & f.masks[at[1]]
    assert (masks[:, 0] & np.uint64(0b011) == np.uint64(0b011)).all()
    many = langid.fit([f"{chr(97 + i % 26) * 4}{chr(97 + i // 26) * 4} " * 9 for i in range(70)], [f"l{i:02d}" for i in range(70)])
    assert many.masks.shape[1] == 2 and langid.predict(["ffffcccc"], many)[0] == ["l57"]


@pytest.mark.parametrize("n_labels", [0, 3])
def test_odd_rows(spark, n_labels):
    docs = odd(spark)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (3, 5, 7)][:n_labels], "doc_id long, quality int, toxic int")
    ids = sorted(str(i) for i, _ in ODD)
    for out in (quality.score(docs, quality.train(docs, labels)), toxicity.score(docs, toxicity.train(docs, labels)), langid.identify(docs, langid.train(docs))):
        rows = out.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == ids and all(0 <= r["score"] <= 1 for r in rows)
    langs = {(r["doc_id"]): r["lang_pred"] for r in langid.identify(docs, langid.train(docs)).collect()}
    assert langs[1] == langs[2] == langs[3] == langs[5] == "und" and langs[7] == "clash"
    kept = toxicity.reject(docs, labels, 1.1)
    assert kept.schema == docs.schema and kept.count() == len(ODD)
    none = docs.where("false")
    assert quality.score(none, quality.train(none, labels)).count() == 0 and toxicity.reject(none, labels).count() == 0 and langid.identify(none, langid.train(none)).count() == 0


def test_a_text_without_a_character_has_no_quality(spark):
    """Whatever a fit makes of padding, empty texts score 0."""
    for seed in (1, 2):
        net = quality.fit(["good " * 20, "bad " * 20] * 10, [1, 0] * 10, quality.Settings(seed=seed, epochs=2))
        p = quality.probabilities([None, "", " ", "good " * 20], net)
        assert p[0] == p[1] == 0 and (p[2:] > 0).all()


def test_samples_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(shared, "SAMPLE_TEXT_BYTES", 100)
    docs = spark.createDataFrame([(i, "x" * (50 + i), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    texts, y = shared.labelled_sample(docs, labels, "quality", 1000, 4, 2)
    assert texts and max(map(len, texts)) <= 100 and len(texts) == len(y)
