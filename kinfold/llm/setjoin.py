"""N-gram Jaccard self-join by chosen paths, and the classes its links form.

Documents are sets of shingles of five words (runs between white space, lower case). The
join finds all pairs of different texts with Jaccard similarity of at least 0.8:

1. Equal texts are one node, found by their digest; copies never meet in a join.
2. Each node has a MinHash sketch. A run of the chosen-path recursion starts with all
   nodes; a step takes ``branch`` coordinates of the sketch, which no other place in the
   trees of any run uses, and splits a bucket by the values (each value is one sampled token
   of the set), so nodes that share the token stay together. Buckets of up to ``bucket`` nodes stop and
   are compared by brute force; larger ones split further, ``depth`` times at most.
3. A pair of similarity s survives a step with s in each branch, so a run finds it with
   probability at least p(s) = 1 - (1 - s p')**branch, whatever the other runs find. A pair
   that meets is still lost if its sketches agree too little to be proposed, in every run
   alike; runs repeat until (1 - p(0.8))**runs and that loss together stay within the
   target recall.
4. Buckets still large after the last split (large true groups) are cut in blocks and
   every pair of blocks is compared, which is exact.
5. Brute force over sketches proposes edges. Nodes connected by proposals of any run form a
   family; the pairs of a family that can be similar are verified once with their full
   shingle sets. Families are cut by set size: a set meets sets of its own band of sizes (a
   band spans a factor of 1 / similarity) and of the next, and no others, as sets of more
   different sizes cannot reach the similarity. Bands are cut in blocks bounded in nodes and
   bytes. So no bucket or run verifies a pair again, and nothing is reported on an estimate.
6. Links become classes by alternating large-star and small-star steps over an edge
   table, cut by checkpoints in the shared folder; nothing is gathered on the driver.

Rows meet the table of their bucket, family or text in :func:`_meet`, which spreads the rows
of a key that many rows share (a very common path, a text copied many times) over tasks by
salts, so no task sees all rows of a key.

Edge cases: null texts and texts without words have no links, each row is its own class
with one copy; a text of 1 to 4 words is one shingle; repeated rows and ids count as
copies; ties and order do not matter, a class is named by its smallest id (null if all
ids are null); an empty table gives an empty result; extra columns do not take part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import shared
from .textbytes import mix, shingles, slices


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    recall: float = 0.999
    coordinates: int = 64  #: of a sketch
    branch: int = 2
    bucket: int = 96  #: nodes compared by brute force
    depth: int = 3
    slack: float = 0.26  #: sketches propose pairs estimated at similarity - slack; over 5 standard deviations
    block: int = 2048  #: nodes of a bucket that cannot be split, compared by sketches in one group
    family: int = 256  #: nodes of a family verified in one group; larger families are cut in blocks
    group_bytes: int = 32 << 20  #: and bytes of their shingles; a single set may be larger

    @property
    def agree(self) -> int:
        """Equal coordinates from which sketches propose a pair."""
        return math.ceil((self.similarity - self.slack) * self.coordinates - 1e-9)

    @property
    def sketch_loss(self) -> float:
        """Probability that the sketches of a pair just at the threshold agree in fewer."""
        n, p = self.coordinates, self.similarity
        return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(self.agree))

    @property
    def runs(self) -> int:
        """Runs until the target recall, for a pair just at the threshold that is split to the last."""
        p = 1.0
        for _ in range(self.depth):
            p = 1 - (1 - self.similarity * p) ** self.branch
        left = 1 - self.recall - self.sketch_loss
        if left <= 0:
            raise ValueError("the sketches alone lose more than the target recall allows")
        runs = max(1, math.ceil(math.log(left) / math.log(1 - p)))
        if runs * sum(self.branch**d for d in range(1, self.depth + 1)) > self.coordinates:
            raise ValueError("the runs need more coordinates than a sketch has")
        return runs


def sketches(texts, t: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash sketches (uint32, texts x t) and the number of shingles, repeats included."""
    out, sizes = np.zeros((len(texts), t), np.uint32), np.zeros(len(texts), np.int64)
    seeds = mix(np.arange(1, t + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for lo, hi in slices(texts, 1 << 20):
        h, bounds = shingles(texts[lo:hi])
        full = np.flatnonzero(np.diff(bounds))
        sizes[lo:hi] = np.diff(bounds)
        if not len(full):
            continue
        start = bounds[full]
        for j in range(t):
            v = h * seeds[j]
            out[lo + full, j] = np.minimum.reduceat((v ^ (v >> np.uint64(29))) >> np.uint64(32), start)
    return out, sizes


def node_keys(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the text as node; null texts have a null node."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("node", F.unhex(F.md5(F.encode("text", "UTF-8"))))


def _sketched(nodes: DataFrame, t: int) -> DataFrame:
    """node, sketch; without nodes that have no words."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            s, n = sketches(b.column(1).to_pylist(), t)
            kept = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.array([s[i].tobytes() for i in kept], pa.binary())], names=["node", "sketch"])

    return nodes.select("node", "text").mapInArrow(run, "node binary, sketch binary")


def _children(level: DataFrame, runs: int, s: Settings, depth: int) -> DataFrame:
    """path and node of the next level: each bucket's nodes, by the values of its sampled coordinates.

    The low bits of a path are its place among the buckets of its level in the trees of all
    runs, so each place has coordinates of its own.
    """
    first = s.runs * sum(s.branch**d for d in range(1, depth))
    low = np.uint64((1 << (s.runs * s.branch**s.depth).bit_length()) - 1)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            sketch = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(b.num_rows, -1)
            path = b.column(0).to_numpy().view(np.uint64)
            rows, paths = [], []
            for r in range(runs):
                for j in range(s.branch):
                    place = ((path & low) + np.uint64(r)) * np.uint64(s.branch) + np.uint64(j)
                    c = place + np.uint64(first)
                    value = sketch[np.arange(b.num_rows), c.astype(np.int64)]
                    key = mix(mix(path + (c + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) ^ (value.astype(np.uint64) << np.uint64(8)) ^ np.uint64(depth))
                    paths.append((key & ~low) | place)
                    rows.append(np.arange(b.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths).view(np.int64)), b.column(1).take(pa.array(np.concatenate(rows)))], names=["path", "node"])

    return level.select("path", "node", "sketch").mapInArrow(run, "path long, node binary")


def _components(near: np.ndarray) -> np.ndarray:
    """The component of each row of a boolean adjacency matrix, named by its smallest member."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(1)
        low = np.minimum(low, label)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _proposals(buckets: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) from the smallest node of each component that the sketches of a bucket propose."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            heads, tails = [], []
            for nodes, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sketch = np.frombuffer(b"".join(raw), np.uint32).reshape(len(nodes), -1)
                near = np.zeros((len(nodes), len(nodes)), bool)
                for i in range(len(nodes)):
                    near[i] = (sketch == sketch[i]).sum(1) >= s.agree
                label = _components(near)
                for root in np.unique(label):
                    own = sorted({nodes[i] for i in np.flatnonzero(label == root)})
                    heads += own[:1] * (len(own) - 1)
                    tails += own[1:]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(tails, pa.binary())], names=["a", "b"])

    return buckets.select("nodes", "sketches").mapInArrow(run, "a binary, b binary")


def _verified(groups: DataFrame, s: Settings, listed: bool) -> DataFrame:
    """node, n_links, head and links: the exact neighbours of each member of a family that has any.

    A group is one block of a family, whose pairs are compared, or two (``across``), of which only
    pairs of different sides are, so every pair of a family is compared once. ``head`` is the smallest node that
    the group's links connect it to; ``links`` is empty unless they are to be ``listed``.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            nodes, counts, heads, links = [], [], [], []
            for own, raw, block, across in zip(*(b.column(c).to_pylist() for c in range(4))):
                sets = [np.frombuffer(x, np.uint64) for x in raw]
                sizes, side = np.array([len(x) for x in sets]), np.array(block)
                common = _common(sets, sizes)
                near = common >= s.similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9
                if across:
                    near &= side[:, None] != side[None, :]
                np.fill_diagonal(near, False)
                linked = np.flatnonzero(near.any(1))
                label, least = _components(near), {}
                for i in linked:
                    least[label[i]] = min(own[i], least.get(label[i], own[i]))
                for i in linked:
                    nodes.append(own[i])
                    counts.append(int(near[i].sum()))
                    heads.append(least[label[i]])
                    links.append([own[j] for j in np.flatnonzero(near[i])] if listed else [])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(counts, pa.int64()), pa.array(heads, pa.binary()), pa.array(links, pa.list_(pa.binary()))], names=["node", "n_links", "head", "links"])

    return groups.select("nodes", "sets", "sides", "across").mapInArrow(run, "node binary, n_links long, head binary, links array<binary>")


def _common(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The number of shingles that each two sets share."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[sizes[0], k], [k, sizes[1]]])
    out = np.diag(sizes).astype(np.int64)
    pool, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(n), sizes)
    often = np.bincount(at, minlength=len(pool))
    kept = often[at] > 1  # a shingle of one set is in no pair
    column = np.cumsum(often > 1) - 1
    at, who, width = column[at[kept]], who[kept], int((often > 1).sum())
    # Products of 0/1 matrices over a block of shingles at a time, so memory stays bounded.
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    for lo in range(0, width, 8192):
        a, z = np.searchsorted(at, [lo, lo + 8192])
        m = np.zeros((n, min(8192, width - lo)), np.float32)
        m[who[a:z], at[a:z] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = sizes
    return out


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """node and the sorted distinct shingles of its text, as bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, sets = b.column(1).to_pylist(), []
            for lo, hi in slices(texts, 1 << 20):
                h, bounds = shingles(texts[lo:hi])
                sets += [np.unique(h[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node binary, shingles binary")


#: Rows of a key up to which they may stand in one task, and keys up to which those with more are broadcast.
HOT_ROWS, BROADCAST_KEYS = 1024, 50_000


def _kept(table: DataFrame, n: str, **counted) -> tuple[DataFrame, dict[str, int]]:
    """The table, kept, and counted on the way: ``hot``, its keys with more than ``HOT_ROWS`` rows by column ``n``, and what else is asked."""
    seen = Observation()
    wanted = {"hot": F.col(n) > HOT_ROWS, **counted}
    kept = shared.cut(table.observe(seen, *[F.count_if(c).alias(k) for k, c in wanted.items()]))
    return kept, {k: int(v or 0) for k, v in seen.get.items()}


def _meet(rows: DataFrame, table: DataFrame, key: str, n: str, many: int) -> DataFrame:
    """Inner join with a kept table of one row a key, whose column ``n`` is the number of rows of the key.

    The rows of the ``many`` keys with more than ``HOT_ROWS`` are dealt over as many salts as that takes.
    """
    if not many:
        return rows.join(table, key)
    parts = F.greatest(F.lit(1), F.ceil(F.col(n) / HOT_ROWS)).cast("int")
    hot = table.where(F.col(n) > HOT_ROWS).select(key, parts.alias("_parts"))
    if many <= BROADCAST_KEYS:
        marked = rows.join(F.broadcast(hot), key, "left")
    else:
        first = 64
        hot = hot.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(first - 1))))
        marked = rows.withColumn("_first", F.pmod(F.xxhash64(*rows.columns), F.lit(first)).cast("int")).join(hot, [key, "_first"], "left").drop("_first")
    marked = marked.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns, F.lit(7)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return marked.join(spread, [key, "_salt"]).drop("_salt")


def _blocked(rows: DataFrame, group: str, n: str, size: int) -> DataFrame:
    """Rows with key (group, a, b) and side: groups of up to ``size`` rows stay whole, larger ones
    are cut in blocks by a hash of the node, and each two blocks make a key."""
    blocks = F.when(F.col(n) <= size, 1).otherwise(F.ceil(F.col(n) / F.lit(size / 2))).cast("int")
    out = rows.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumn("key", F.struct(group, F.least("side", "_o").alias("a"), F.greatest("side", "_o").alias("b"))).drop("_o")


def _banded(family: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """node, key and side for the groups in which the pairs of a family are verified.

    ``family`` has node and root, ``sizes`` node and n_shingles. Families within the bounds are one
    group. Of others a side is (band of sizes, block): each two blocks of a band make a key, and
    each block with each of the next band.
    """
    volume = F.sum("n_shingles").alias("volume")
    large = (F.col("n") > s.family) | (F.col("volume") * 8 > s.group_bytes)
    sized = family.join(sizes, "node")
    table, seen = _kept(sized.groupBy("root").agg(F.count("*").alias("n"), volume), "n", large=large)
    whole = _meet(sized, table, "root", "n", seen["hot"])
    small = whole.where(~large).select("node", F.struct("root", F.lit(0).alias("band"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("across")).alias("key"), F.lit(0).alias("side"))
    if not seen["large"]:
        return small
    # One band spans a factor of 1 / similarity, with a little to spare for rounding.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(s.similarity) * (1 + 1e-9))).cast("int")
    rest = whole.where(large).select("node", "root", "n_shingles", band.alias("band"))
    parts = F.greatest(F.ceil(F.count("*") / F.lit(s.family / 2)), F.ceil(F.sum("n_shingles") * 8 / F.lit(s.group_bytes / 2))).cast("int")
    bands = rest.groupBy("root", "band").agg(parts.alias("parts"), F.count("*").alias("n"))
    # The bands of a family are few (they grow with the logarithm of the sizes), so they fit in a map.
    maps, seen = _kept(bands.groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"), F.sum("n").alias("n")), "n")
    rest = _meet(rest, maps, "root", "n", seen["hot"])
    own, up, down = (F.coalesce(F.try_element_at("parts", F.col("band") + F.lit(d)), F.lit(0)) for d in (0, 1, -1))
    block = F.pmod(F.xxhash64("node"), own).cast("int")
    rest = rest.withColumn("block", block).withColumn("up", up).withColumn("down", down).withColumn("own", own)

    def keys(count: str, make):
        return F.transform(F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>")), make)

    def key(band, a, b, across: bool, side):
        return F.struct(F.struct("root", band.alias("band"), a.alias("a"), b.alias("b"), F.lit(across).alias("across")).alias("key"), side.alias("side"))

    here, mine = F.col("band"), F.col("block")
    groups = F.concat(
        keys("own", lambda j: key(here, F.least(mine, j), F.greatest(mine, j), False, mine)),
        keys("up", lambda j: key(here, mine, j, True, F.lit(0))),
        keys("down", lambda j: key(here - 1, j, mine, True, F.lit(1))),
    )
    rest = rest.select("node", F.explode(groups).alias("g")).select("node", "g.key", "g.side")
    return small.unionByName(rest)


def links(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """node and links (array of nodes): the different texts within the similarity, for nodes that have any."""
    return _joined(docs, settings, True).groupBy("node").agg(F.flatten(F.collect_list("links")).alias("links"))


def _joined(docs: DataFrame, s: Settings, listed: bool) -> DataFrame:
    """The verified rows of all families; a node of a family of several blocks has several."""
    nodes = node_keys(docs).where(F.col("node").isNotNull())
    # One row a text: the sketch is a function of it, so any copy's will do.
    sketch = shared.cut(_sketched(nodes, s.coordinates).groupBy("node").agg(F.max("sketch").alias("sketch")))
    level, found = sketch.withColumn("path", F.lit(0).cast("long")), None
    for depth in range(1, s.depth + 1):
        # Only paths and nodes are dealt by path; sketches follow where two nodes meet.
        keyed = _children(level, s.runs if depth == 1 else 1, s, depth)
        count, seen = _kept(keyed.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "n")
        met = shared.cut(_meet(keyed, count, "path", "n", seen["hot"]))
        small = met if depth == s.depth else met.where(F.col("n") <= s.bucket)
        packed = _blocked(small, "path", "n", s.block if depth == s.depth else s.bucket).join(sketch, "node").groupBy("key").agg(F.collect_list(F.struct("node", "sketch")).alias("m"))
        edges = _proposals(packed.select(F.col("m.node").alias("nodes"), F.col("m.sketch").alias("sketches")), s).distinct()
        found = edges if found is None else found.unionByName(edges)
        level = met.where(F.col("n") > s.bucket).join(sketch, "node")
    # Families of nodes that proposals connect, whatever the run or bucket: verified once.
    family = shared.cut(classes(found))
    # Copies of a text become one row before they meet the families.
    text = nodes.groupBy("node").agg(F.max("text").alias("text")).join(family.select("node"), "node")
    sets = shared.cut(_shingle_sets(text))
    groups = _banded(family, sets.select("node", (F.length("shingles") / 8).cast("long").alias("n_shingles")), s)
    packed = groups.join(sets, "node").groupBy("key").agg(F.collect_list(F.struct("node", "shingles", "side")).alias("m"))
    packed = packed.select(F.col("m.node").alias("nodes"), F.col("m.shingles").alias("sets"), F.col("m.side").alias("sides"), (F.col("key.across") | (F.col("key.a") != F.col("key.b"))).alias("across"))
    return _verified(packed, s, listed)


def classes(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for edges (a, b).

    Alternates large-star and small-star until nothing changes; each round's edge table is
    checkpointed. Every node of an edge comes out once.
    """
    e = shared.cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now a > b in each edge: the smaller neighbours of a node all go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        seen = Observation()
        e = shared.cut(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        state = seen.get
        if state == before:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _has_words(text):
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0b\\f]+", " ")) != ""


def _classed(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, node, class_id, kept (the node whose row stands for the class), n_links, n_copies of every row; node is null for rows without words."""
    found = shared.cut(_joined(docs, s, False).drop("links"))
    # One edge a node and group keeps what the links connect; the links themselves are only counted.
    edges = found.select(F.col("node").alias("a"), F.col("head").alias("b"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    keyed = shared.cut(node_keys(docs).select("doc_id", F.when(_has_words(F.col("text")), F.col("node")).alias("node")))
    known = keyed.where(F.col("node").isNotNull())
    per_node = known.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"))
    per_node = per_node.join(counts, "node", "left").join(classes(edges), "node", "left")
    per_node, seen = _kept(per_node.withColumn("root", F.coalesce("root", "node")), "n_copies")
    named = per_node.groupBy("root").agg(F.min("first_id").alias("class_id"), F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "node"))).alias("k"))
    per_node = per_node.join(named, "root").select("node", "class_id", F.col("k.node").alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    linked = _meet(known, per_node, "node", "n_copies", seen["hot"]).select("doc_id", "node", "class_id", "kept", "n_links", "n_copies")
    alone = keyed.where(F.col("node").isNull()).select("doc_id", "node", F.col("doc_id").alias("class_id"), F.col("node").alias("kept"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return linked.unionByName(alone)


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links (different texts within the similarity), n_copies (rows with this very text)."""
    return _classed(docs, settings).drop("node", "kept")


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents with one of each class, all columns kept: the row with the smallest id, and of
    different texts under that id the one with the smallest node.

    Of rows that repeat an id and its text one stays. Rows with a null id and rows without
    words all stay.
    """
    name = "_node"
    while name in docs.columns:
        name += "_"
    gone = _classed(docs, settings).where("doc_id <> class_id or node <> kept").select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone_node")).distinct()
    keyed = docs.withColumn(name, F.when(_has_words(F.col("text")), F.unhex(F.md5(F.encode("text", "UTF-8")))))
    fixed = keyed.where(F.col("doc_id").isNull() | F.col(name).isNull())
    rest = keyed.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    rest = rest.join(gone, (F.col("doc_id") == F.col("_gone_id")) & (F.col(name) == F.col("_gone_node")), "left_anti").dropDuplicates(["doc_id", name])
    return rest.unionByName(fixed).drop(name)
