import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm import setjoin as sj

from .brute import classes, shingles


def table(spark, rows):
    return spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, class_id string, node int")


def got(df, s=sj.Settings()):
    return sorted(map(str, (tuple(r) for r in sj.join(df, s).select("doc_id", "class_id", "n_links", "n_copies").collect())))


def corpus(n_groups, seed, size=80):
    rng = random.Random(seed)
    rows = []
    for _ in range(n_groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"w{rng.randrange(3000)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus(60, 3)
    assert got(table(spark, rows)) == sorted(map(str, classes(rows)))


def test_large_groups_and_frequent_passages(spark):
    """Small buckets force splits, blocks and families of several blocks."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(120)] = f"v{rng.randrange(9000)}"
        rows.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [passage + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(60)) for _ in range(80)]
    rows = list(enumerate(rows))
    assert got(table(spark, rows), sj.Settings(bucket=8, block=24, family=40)) == sorted(map(str, classes(rows)))


def test_links_are_listed(spark):
    rows = corpus(20, 8)
    df = table(spark, rows)
    text = {bytes(r["node"]): r["text"] for r in sj.node_keys(df).collect()}
    got_ = {text[bytes(r["node"])]: {text[bytes(x)] for x in r["links"]} for r in sj.links(df, sj.Settings(family=8)).collect()}
    want = {}
    for a in set(text.values()):
        for b in set(text.values()) - {a}:
            both = len(shingles(a) & shingles(b))
            if both >= 0.8 * len(shingles(a) | shingles(b)) - 1e-9:
                want.setdefault(a, set()).add(b)
    assert got_ == want and want


def test_recall_plan():
    s = sj.Settings()
    p = 1.0
    for _ in range(s.depth):
        p = 1 - (1 - s.similarity * p) ** s.branch
    assert 1 - (1 - p) ** s.runs >= s.recall


def test_sketches_and_paths_together_reach_the_recall():
    """The loss of the sketches counts, and coordinates are never drawn twice, so runs are independent."""
    s = sj.Settings()
    p = 1.0
    for _ in range(s.depth):
        p = 1 - (1 - s.similarity * p) ** s.branch
    assert s.sketch_loss < 1e-5 and (1 - p) ** s.runs + s.sketch_loss <= 1 - s.recall
    with pytest.raises(ValueError):
        sj.Settings(slack=0.1).runs


def sketch_rows(spark, differ):
    """Two nodes a case, whose sketches differ in the coordinates of the case only."""
    rows = []
    for k, at in enumerate(differ):
        sketch = np.arange(64, dtype=np.uint32) + np.uint32(1000 * k)
        rows.append((0, f"{k}a".encode(), sketch.tobytes()))
        sketch[list(at)] += np.uint32(1 << 20)
        rows.append((0, f"{k}b".encode(), sketch.tobytes()))
    return spark.createDataFrame(rows, "path long, node binary, sketch binary")


def test_no_five_coordinates_part_a_pair_at_the_first_level(spark):
    """Three runs of two branches are six coordinates; two of them were once the same."""
    s = sj.Settings()
    rng = random.Random(4)
    differ = [(52, 17, 42, 49, 61), (0, 1, 2, 3, 4), *(rng.sample(range(6), 5) for _ in range(20)), *(rng.sample(range(64), 5) for _ in range(200))]
    met = {}
    for r in sj._children(sketch_rows(spark, differ), s.runs, s, 1).collect():
        met.setdefault(r["path"], set()).add(bytes(r["node"]))
    together = {next(iter(x))[:-1] for x in met.values() if len(x) > 1}
    assert s.runs * s.branch == 6 and len(together) == len(differ)


def test_coordinates_are_distinct_in_all_trees(spark):
    """A path's coordinate is the one whose change moves the node to another path."""
    s = sj.Settings()
    level, used = sketch_rows(spark, [()]).where(F.col("node") == b"0a"), []
    for depth in range(1, s.depth + 1):
        runs = s.runs if depth == 1 else 1
        rows = [tuple(r) for r in level.collect()]
        base = [r["path"] for r in sj._children(level, runs, s, depth).collect()]
        moved = []
        for c in range(64):
            sketch = np.frombuffer(rows[0][2], np.uint32).copy()
            sketch[c] += 7
            moved += [(path, f"{c:02d}".encode(), sketch.tobytes()) for path, _, _ in rows]
        moved = spark.createDataFrame(moved, "path long, node binary, sketch binary")
        out = {}
        for r in sj._children(moved, runs, s, depth).collect():
            out.setdefault(bytes(r["node"]), set()).add(r["path"])
        used += [c for c in range(64) for p in base if p not in out[f"{c:02d}".encode()]]
        level = spark.createDataFrame([(p, b"0a", rows[0][2]) for p in base], "path long, node binary, sketch binary")
    assert len(used) == len(set(used)) == s.runs * (2 + 4 + 8)


def test_a_pair_well_below_the_mean_is_proposed(spark):
    s = sj.Settings()
    rows = sketch_rows(spark, [range(25), range(40)]).groupBy(F.substring("node", 1, 1).alias("k")).agg(F.collect_list("node").alias("nodes"), F.collect_list("sketch").alias("sketches"))
    assert [(bytes(r["a"]), bytes(r["b"])) for r in sj._proposals(rows, s).collect()] == [(b"0a", b"0b")]


def test_exact_threshold():
    import numpy as np

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(0, 50, dtype=np.uint64), np.arange(5, 95, dtype=np.uint64)]
    common = sj._common(sets, np.array([len(x) for x in sets]))
    assert common.tolist() == [[len(set(a) & set(b)) for b in map(np.ndarray.tolist, sets)] for a in map(np.ndarray.tolist, sets)]


def test_odd_rows(spark):
    long = " ".join(f"z{i}" for i in range(40_000))
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "Hi there"), (6, "hi  there"), (7, "hi there"), (7, "hi there"), (None, "hi there"), (9, long), (10, long + " end"), (None, "alone here now and then"), (12, "other")]
    df = table(spark, rows)
    assert got(df) == sorted(map(str, classes(rows)))
    kept = sj.one_of_each(df)
    assert kept.schema == df.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "9", "12", "None", "None"])
    none = df.where("false")
    assert sj.join(none).count() == 0 and sj.one_of_each(none).count() == 0


def test_repeated_ids_with_different_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    df = table(spark, [(5, a), (5, b), (2, a), (5, b)])
    assert sorted((r["doc_id"], r["text"][0]) for r in sj.one_of_each(df).collect()) == [(2, "a"), (5, "b")]


def test_near_copies_under_one_id(spark):
    """Different texts of one class under the same smallest id, beside another class under that id."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = table(spark, [(5, a), (5, a + " end"), (5, a + " stop"), (6, a), (5, b), (None, a)])
    kept = sj.one_of_each(df).collect()
    assert sorted((str(r["doc_id"]), r["text"][0]) for r in kept) == [("5", "a"), ("5", "b"), ("None", "a")]


def test_components_of_a_path_a_star_and_a_ring(spark):
    rng = random.Random(2)
    edges = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(60)] + [("s000", f"s{i:03d}") for i in range(1, 50)] + [(f"r{i:03d}", f"r{(i + 1) % 40:03d}") for i in range(40)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string").select(F.encode("a", "UTF-8").alias("a"), F.encode("b", "UTF-8").alias("b"))
    out = {bytes(r["node"]).decode(): bytes(r["root"]).decode() for r in sj.classes(df).collect()}
    assert len(out) == 61 + 50 + 40 and all(root == k[0] + "000" for k, root in out.items())
    assert shingles("a b") == {("a", "b")}


def test_common_keys_are_spread(spark, monkeypatch):
    """Hot paths, copies and families go by salts and give the same rows."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"v{k}"] + base[k:]) for k in range(14)] + [" ".join(base)] * 20
    texts += [" ".join(f"q{rng.randrange(99)}" for _ in range(30)) for _ in range(5)]
    rows = list(enumerate(texts))
    want = sorted(map(str, classes(rows)))
    monkeypatch.setattr(sj, "HOT_ROWS", 5)
    small = sj.Settings(bucket=8, block=24, family=10)
    monkeypatch.setattr(sj, "BROADCAST_KEYS", 0)
    assert got(table(spark, rows), small) == want


def test_rows_of_a_hot_key_meet_its_row_once(spark, monkeypatch):
    monkeypatch.setattr(sj, "HOT_ROWS", 7)
    rows = spark.createDataFrame([(k, "a" if k % 3 else f"b{k}") for k in range(300)], "id long, k string")
    for bound in (100, 0):
        monkeypatch.setattr(sj, "BROADCAST_KEYS", bound)
        table, seen = sj._kept(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "n")
        assert seen == {"hot": 1}
        out = sj._meet(rows, table, "k", "n", seen["hot"]).collect()
        assert sorted((r["id"], r["k"], r["n"], r["top"]) for r in out) == sorted((k, "a", 200, 299) if k % 3 else (k, f"b{k}", 1, k) for k in range(300))


def test_bands_of_sizes_lose_no_pair(spark):
    """Of a family with sets of many sizes every pair that can be similar shares exactly one group."""
    rng = random.Random(9)
    sizes = [rng.randrange(1, 400) for _ in range(300)]
    family = spark.createDataFrame([(f"{k:04d}".encode(), b"0000" if k < 290 else b"0290") for k in range(300)], "node binary, root binary").coalesce(1)
    sized = spark.createDataFrame([(f"{k:04d}".encode(), n) for k, n in enumerate(sizes)], "node binary, n_shingles long").coalesce(1)
    for s in (sj.Settings(family=12), sj.Settings(group_bytes=20_000)):
        groups, met = {}, {}
        for r in sj._banded(family, sized, s).collect():
            groups.setdefault(r["key"], []).append((int(bytes(r["node"])), r["side"]))
        for key, own in groups.items():
            across = key["across"] or key["a"] != key["b"]
            for i, (x, sx) in enumerate(own):
                for y, sy in own[:i]:
                    if not across or sx != sy:
                        met[min(x, y), max(x, y)] = met.get((min(x, y), max(x, y)), 0) + 1
        assert max(met.values()) == 1
        similar = {(x, y) for y in range(300) for x in range(y) if (x < 290) == (y < 290) and min(sizes[x], sizes[y]) >= 0.8 * max(sizes[x], sizes[y])}
        assert similar <= met.keys() and len(met) < 0.6 * 300 * 299 / 2
        assert max(len(own) for own in groups.values()) <= (40 if s.family == 12 else 100)


def test_one_of_each_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two", "x", "y"), (2, "one two", "z", "w")], "doc_id long, text string, _node string, _node_ string")
    kept = sj.one_of_each(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "one two", "x", "y")]
