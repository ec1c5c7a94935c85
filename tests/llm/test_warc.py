import hashlib
import os

from pyspark.sql import functions as F

from kinfold.llm import shared, warc

SF = "/root/testdata/sf0.01"


def test_audit_finds_exactly_the_decay(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = shared.work_dir(spark, "w")
    out = warc.fixity(pages, folder, warc.damaged_share(7)).collect()
    assert len(out) == pages.count()
    assert all(r["sound"] != warc.decays(r["page_id"], r["url"], 7) for r in out)
    assert {r["sound"] for r in out} == {True, False}
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in out:
        with open(os.path.join(shared.local_path(folder), "a", warc.segment_name(r["segment"])), "rb") as f:
            f.seek(r["offset"])
            stored = f.read(r["length"])
        fields, block = warc.parse(stored)
        assert hashlib.sha256(stored).hexdigest() == r["sha256"] and block.decode() == html[r["page_id"]] and fields["WARC-Target-URI"] == r["url"]


def test_tree_against_plain_python(spark):
    n, fan = 70, 4
    rows = [(0, i, i * 10, i * 10 + 10, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    df = spark.createDataFrame(rows, "segment int, idx long, first long, last long, digest string")
    level = [r[4] for r in rows]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    levels = warc.tree(df, fan)
    root = levels[-1].collect()
    assert len(root) == 1 and root[0]["digest"] == level[0] and (root[0]["first"], root[0]["last"]) == (0, 700)
    worse = df.withColumn("digest", F.when(F.col("idx").isin(3, 69), "x").otherwise(F.col("digest"))).where("idx <> 40")
    bad = warc.audit(levels, warc.tree(worse, fan), fan).collect()
    assert sorted(r["idx"] for r in bad) == [3, 40, 69]
    assert warc.audit(levels, levels, fan).count() == 0


def test_truncated_and_missing_files(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    folder = shared.work_dir(spark, "w")
    a, b = f"{folder}/a", f"{folder}/b"
    index = warc.write(pages, [a, b])
    segments = sorted(r[0] for r in index.select("segment").distinct().collect())
    first, second = (os.path.join(shared.local_path(b), warc.segment_name(s)) for s in segments[:2])
    os.remove(first)
    os.truncate(second, os.path.getsize(second) - 5)
    bad = warc.audit(warc.tree(warc.leaves(index, a)), warc.tree(warc.leaves(index, b))).collect()
    gone = index.where(F.col("segment") == segments[0]).count()
    assert sum(r["segment"] == segments[0] for r in bad) == gone and sum(r["segment"] == segments[1] for r in bad) == 1


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, "a\r\nb", "é" * 10, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, segment string")
    out = warc.fixity(pages, shared.work_dir(spark, "w")).collect()
    assert len(out) == 4 and all(r["sound"] for r in out)
    assert warc.fixity(pages.where("false"), shared.work_dir(spark, "w")).count() == 0


def test_the_index_convicts_either_replica(spark):
    """Decay of the first, of both alike, an appended and a lost file, over segments of bounded size."""
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(200)], "page_id long, url string, html string").repartition(3)
    folder = shared.work_dir(spark, "w")
    folders = [f"{folder}/a", f"{folder}/b"]
    index = warc.write(pages, folders, segment_bytes=4000)
    rows = index.collect()
    by = {}
    for r in rows:
        by.setdefault(r["segment"], []).append(r)
    assert len(by) > 6 and all(sum(r["length"] for r in own[:-1]) < 4000 for own in by.values())
    assert warc.check(index, folders).count() == 0
    first, both, longer, lost = sorted(by)[:4]

    def path(k, segment):
        return os.path.join(shared.local_path(folders[k]), warc.segment_name(segment))

    def flip(k, segment, r):
        with open(path(k, segment), "r+b") as f:
            f.seek(r["offset"] + 5)
            old = f.read(1)
            f.seek(r["offset"] + 5)
            f.write(bytes([old[0] ^ 1]))

    flip(0, first, by[first][2])
    for k in (0, 1):
        flip(k, both, by[both][0])
    with open(path(1, longer), "ab") as f:
        f.write(b"tail")
    os.remove(path(0, lost))
    bad = {(r["replica"], r["segment"], r["idx"]) for r in warc.check(index, folders, 4).collect()}
    want = {(0, first, 2), (0, both, 0), (1, both, 0), (1, longer, len(by[longer]))} | {(0, lost, i) for i in range(len(by[lost]) + 1)}
    assert bad == want
    out = {(r["segment"], r["ordinal"]): r for r in warc.report(index, warc.check(index, folders)).collect()}
    assert len(out) == len(rows)
    for r in rows:
        got, key = out[r["segment"], r["ordinal"]], (r["segment"], r["ordinal"])
        assert got["bad_replicas"] == [k for k in (0, 1) if (k, *key) in want] and got["sound"] == (not got["bad_replicas"])
        assert got["segment_whole"] == (r["segment"] not in (longer, lost))


def test_very_long_page(spark):
    pages = spark.createDataFrame([(1, "u", "é<p>" * 2_000_000), (2, "v", "x")], "page_id long, url string, html string").coalesce(1)
    folder = shared.work_dir(spark, "w")
    out = {r["page_id"]: r for r in warc.fixity(pages, folder).collect()}
    assert all(r["sound"] and r["segment_whole"] for r in out.values())
    with open(os.path.join(shared.local_path(folder), "b", warc.segment_name(out[1]["segment"])), "rb") as f:
        fields, block = warc.parse(f.read(out[1]["length"]))
    assert len(block) == 10_000_000 == int(fields["Content-Length"])
