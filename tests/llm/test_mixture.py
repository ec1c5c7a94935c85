import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixture
from kinfold.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, copies string"


def filled(budget, children):
    """Water-filling by rounds: {name: (weight, cap)} to real budgets."""
    got = {k: 0.0 for k in children}
    open_ = {k for k, (w, c) in children.items() if w > 0 and c > 0}
    left = float(budget)
    while open_ and left > 1e-9:
        total = sum(children[k][0] for k in open_)
        share = {k: left * children[k][0] / total for k in open_}
        left = 0.0
        for k in list(open_):
            room = children[k][1] - got[k]
            take = min(room, share[k])
            got[k] += take
            left += share[k] - take
            if take >= room:
                open_.discard(k)
    return got


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = QUERIES["op10_mixture"](spark, SF)
    cols = ", ".join(sorted(df.columns))
    want = con.sql(f"select {cols} from ({ORACLE_SQL['op10_mixture']})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op10_mixture"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_shortage_goes_to_siblings_first(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    how = mixture.Mix(domains={"d0": 9, "d1": 1, "d2": 1, "d3": 1}, langs={"en": 1, "es": 20}, share=0.9, max_epochs=1)
    rows = mixture._rows(docs, None)
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixture.budgets(rows, how).collect()}
    have = {}
    for r in rows.groupBy(*mixture.LEAF).agg(F.sum("n_tokens").alias("n")).collect():
        have.setdefault(r["domain"], {}).setdefault(r["lang"], {})[r["source"]] = r["n"]
    total = int(sum(n for d in have.values() for x in d.values() for n in x.values()) * how.share)
    top = filled(total, {d: (how.domains[d], sum(n for x in v.values() for n in x.values())) for d, v in have.items()})
    for d, v in have.items():
        mid = filled(top[d], {x: (how.langs.get(x, 1), sum(s.values())) for x, s in v.items()})
        for x, s in v.items():
            low = filled(mid[x], {k: (1, n) for k, n in s.items()})
            for k, n in low.items():
                assert got.get((d, x, k), 0) == pytest.approx(n, abs=4)


def test_leaves_of_weight_0_are_no_supply(spark):
    """What a shut leaf or language cannot spend goes to the siblings of its ancestors."""
    rows = [(1, "src0", "en", 10), (2, "src4", "en", 90), (3, "src8", "de", 90), (4, "src1", "en", 200)]
    docs = spark.createDataFrame([(i, " ".join("w" * n), lang, source, "x") for i, source, lang, n in rows], SCHEMA)
    how = mixture.Mix(langs={"de": 0}, sources={"src4": 0}, share=0.4, max_epochs=1)
    got = {r["source"]: r["budget"] for r in mixture.budgets(mixture._rows(docs, None), how).collect()}
    assert got == {"src0": 10, "src1": 390 * 4 // 10 - 10}


@pytest.mark.parametrize("salted", [False, True])
def test_prefix_over_many_buckets(spark, monkeypatch, salted):
    monkeypatch.setattr(mixture, "BUCKET_ROWS", 7)
    monkeypatch.setattr(mixture, "RANGE", 5)
    if salted:
        monkeypatch.setattr(mixture, "BROADCAST_LEAVES", 0)
    docs = spark.createDataFrame([(i, "w " * (i % 9 + 1), "en", "src0", "x") for i in range(500)], SCHEMA)
    how = mixture.Mix(share=0.63, max_epochs=1)
    out = mixture.select(docs, how).collect()
    total = sum(i % 9 + 2 for i in range(500))
    import hashlib

    order = sorted((hashlib.md5(f"{how.seed}:0:{i}".encode()).hexdigest(), i) for i in range(500))
    want, used = set(), 0
    for _, i in order:
        used += i % 9 + 2
        if used > int(total * how.share):
            break
        want.add(i)
    assert {r["doc_id"] for r in out} == want


def test_epochs_and_odd_rows(spark):
    rows = [(1, "a b c d", "en", "src0", "x"), (2, "a b", "en", "src1", "x"), (3, None, None, None, "x"), (4, "", "en", "src0", "x"), (None, "a b c", None, "odd", "x"), (2, "a b", "en", "src1", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixture.select(docs, mixture.Mix(share=9.0, max_epochs=3))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["copies"]) for r in out.collect())
    assert got == [("1", 4, 3), ("2", 2, 3), ("2", 2, 3), ("4", 0, 3), ("None", 3, 3)]
    mixed = mixture.mix(docs, mixture.Mix(share=9.0, max_epochs=3))
    assert mixed.columns == docs.columns and mixed.count() == 15
    assert mixture.mix(docs.where("false")).count() == 0
    assert mixture.mix(docs, mixture.Mix(domains={f"d{i}": 0 for i in range(4)})).count() == 0


def test_rows_of_one_id_are_taken_together(spark):
    """A hot id is one place in the order, and the budget is never passed."""
    docs = spark.createDataFrame([(7, "w w w", "en", "src0", "x")] * 300 + [(i, "w w", "en", "src0", "x") for i in range(10, 210)], SCHEMA)
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        how = mixture.Mix(share=share, max_epochs=1)
        out = mixture.select(docs, how).collect()
        assert sum(r["n_tokens"] for r in out) <= int(1300 * share)
        assert sum(r["doc_id"] == 7 for r in out) in (0, 300)
        assert mixture.mix(docs, how).count() == len(out)


def test_texts_are_read_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixture.select(docs)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan
