import random

import duckdb

from kinfold.llm import decontaminate as dc
from kinfold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES["op2_decontaminate"](spark, SF)
    cols = ", ".join(sorted(df.columns))
    want = con.sql(f"select {cols} from ({ORACLE_SQL['op2_decontaminate']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect()) and want


def test_short_items_in_long_documents(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 20, 60])))) for i in range(60)]
    docs, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.choice([5, 300, 4000]))]
        if d % 2:
            i, text = rng.choice(items)
            at = rng.randrange(len(body))
            own = text.upper().split() if d % 4 == 1 else text.split()
            if d % 6 == 5 and len(own) >= 60:
                own[0] = "changed"  # still 0.8 of its shingles
            body[at:at] = own
            if len(own) >= 5:
                want.add((d, i))
            elif len(body) == len(own):
                want.add((d, i))
        docs.append((d, ", ".join(body)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(d, b).collect()}
    assert got == want
    blocks = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(d, b, dc.Settings(block_items=7)).collect()}
    assert blocks == want
    assert {r["doc_id"] for r in dc.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_items_of_few_shingles_at_any_place():
    """An item of one shingle fills one bin, which a neighbouring shingle may undercut."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    items = [words(5 + k % 4) for k in range(1500)]
    docs = [(f"{x} {words(40)}", f"{words(40)} {x}", f"{words(30)} {x} {words(30)}")[k % 3] for k, x in enumerate(items)]
    found = {(d, i) for d, i, _ in dc.search(docs, dc.prepare(list(range(len(items))), items, dc.Settings()))}
    assert found == {(k, k) for k in range(len(items))}


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "one two three four five six", "c"), (4, "One two", "d"), (4, "One two", "d")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(1, None), (2, ""), (3, "two three four five six"), (3, "two three four five six"), (None, "one, TWO")], "item_id long, text string")
    rows = sorted((str(r["doc_id"]), str(r["item_id"])) for r in dc.contaminated(d, b).collect())
    assert rows == [("4", "None"), ("4", "None"), ("None", "3"), ("None", "3")]
    kept = dc.clean(d, b)
    assert kept.schema == d.schema and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]
    assert dc.contaminated(d, b.where("false")).count() == 0 and dc.clean(d.where("false"), b).count() == 0


def test_blocks_come_back_and_count_repeated_items(spark):
    texts = ["one two three four five six", "a b", "x " * 60 + "end", ""]
    made = dc.prepare([5, None, 7, 8], texts, dc.Settings(), [1, 2, 1, 1])
    back = dc._loaded(dc._saved(made), dc.Settings())
    docs = ["zero one two three four five six", "a b", "x " * 60 + "end of it"]
    assert list(dc.search(docs, back)) == list(dc.search(docs, made)) and back.ids.tolist() == [5, None, 7, 8]
    b = spark.createDataFrame([(5, texts[0])] * 3 + [(None, texts[1])] * 2 + [(9, texts[0])] + [(k, f"never seen item number {k} at all") for k in range(10, 60)], "item_id long, text string")
    d = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    for s in (dc.Settings(), dc.Settings(block_items=3)):
        got = sorted((r["doc_id"], str(r["item_id"])) for r in dc.contaminated(d, b, s).collect())
        assert got == [(0, "5")] * 3 + [(0, "9"), (1, "None"), (1, "None")]
        assert [r["doc_id"] for r in dc.clean(d, b, s).collect()] == [2]


def test_items_of_five_words_in_documents_of_six():
    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    items = [words(5) for _ in range(6000)]
    docs = [f"{x} {words(1)}" if k % 2 else f"{words(1)} {x}" for k, x in enumerate(items)]
    found = {(d, i) for d, i, _ in dc.search(docs, dc.prepare(range(len(items)), items, dc.Settings()))}
    assert found == {(k, k) for k in range(len(items))}
