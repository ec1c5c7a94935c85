"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Equal vectors are one node that keeps its smallest ids (one more than the neighbours asked
for, which is all a top-k can show of them). Nodes are dealt to shards of bounded size by
a hash. In a shard, every node's greedy search from the medoid proposes neighbours; robust
pruning keeps the nearest and drops each candidate that a kept neighbour is nearer to by
the factor alpha, so long diverse edges survive; reverse edges are added and pruned in the
same way. Queries run a beam search in every shard and the best of all shards win.
Distances are Euclidean, in double precision, on the original vectors (floats stay floats,
all other numbers are doubles); ties go to the smaller id.

Queries are rows of a table too, packed in blocks of bounded size. Every block meets every
shard on the executors (the stated queries against all rows), a pair at a time in a task.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of different lengths never meet; rows that repeat an id and its vector are
one candidate; a null id takes no part; with fewer candidates than k all are returned; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared


@dataclass(frozen=True)
class Settings:
    k: int = 10
    shard_rows: int = 4096
    degree: int = 32
    build_beam: int = 40
    search_beam: int = 64
    alpha: float = 1.2
    block_queries: int = 8192
    seed: int = 11


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of each row's query to the rows its ids name."""
    d = x[ids] - q[:, None, :]
    return np.einsum("qrd,qrd->qr", d, d)


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: int, beam: int, trail: bool = False):
    """Node numbers and squared distances of the beam of each query, nearest first.

    All queries advance together, one expanded node each a step. With ``trail`` also the
    expanded nodes, -1 where a query had ended.
    """
    n, beam = len(q), min(beam, len(x))
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, x.dtype)
    done = np.ones((n, beam), bool)
    ids[:, 0] = entry
    dist[:, 0] = ((x[entry] - q) ** 2).sum(1)
    done[:, 0] = False
    steps, live = [], np.arange(n)
    while len(live):
        at = np.argmin(done[live], 1)  # the nearest that is not expanded
        node = ids[live, at]
        done[live, at] = True
        if trail:
            step = np.full(n, -1, np.int64)
            step[live] = node
            steps.append(step)
        near = graph[node]
        d = _distances(x, np.maximum(near, 0), q[live]).astype(x.dtype)
        known = (near[:, :, None] == ids[live][:, None, :]).any(2)
        d[known | (near < 0) | (d >= dist[live, -1:])] = np.inf
        all_d = np.concatenate([dist[live], d], 1)
        all_i = np.concatenate([ids[live], near], 1)
        all_done = np.concatenate([done[live], ~np.isfinite(d)], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.where(np.isfinite(dist[live]), np.take_along_axis(all_i, order, 1), -1)
        done[live] = np.take_along_axis(all_done, order, 1) | (ids[live] < 0)
        live = live[~done[live].all(1)]
    return (ids, dist, np.stack(steps, 1)) if trail else (ids, dist)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Out-neighbours of each point (points x degree, -1 padded) from its candidates (-1 padded)."""
    c = np.sort(candidates, 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == points[:, None]] = -1
    d = np.where(c >= 0, _distances(x, np.maximum(c, 0), x[points]), np.inf)
    order = np.argsort(d, 1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    width = max(1, int((c >= 0).sum(1).max(initial=0)))
    c, d = c[:, :width], d[:, :width]
    v = x[np.maximum(c, 0)]
    norm = (v * v).sum(2)
    pair = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1)), 0)
    alive, out, row = c >= 0, np.full((len(points), degree), -1, np.int64), np.arange(len(points))
    for j in range(degree):
        if not alive.any():
            break
        pick = np.argmax(alive, 1)
        some = alive[row, pick]
        out[some, j] = c[row, pick][some]
        alive &= ~(some[:, None] & (alpha * alpha * pair[row, pick] <= d))
        alive[row, pick] = False
    return out


def build(x: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """The graph (nodes x degree, -1 padded) and the entry node of one shard."""
    n, rng = len(x), np.random.default_rng(s.seed)
    entry = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    r = min(s.degree, max(1, n - 1))
    graph = np.full((n, s.degree), -1, np.int64)
    if n == 1:
        return graph, 0
    graph[:, :r] = (np.arange(n)[:, None] + rng.integers(1, n, (n, r))) % n if n > r + 1 else (np.arange(n)[:, None] + np.arange(1, n)[None, :]) % n
    if n <= r + 1:
        return graph, entry  # everything is a neighbour of everything
    for alpha in (1.0, s.alpha):
        order = rng.permutation(n)
        for lo in range(0, n, 256):
            p = order[lo : lo + 256]
            ids, _, trail = beam_search(x, graph, x[p], entry, s.build_beam, trail=True)
            graph[p] = robust_prune(x, p, np.concatenate([ids, trail, graph[p]], 1), s.degree, alpha)
            # Reverse edges: each new neighbour j of p gets p, and is pruned if it has too many.
            j, source = graph[p].ravel(), np.repeat(p, s.degree)
            j, source = j[j >= 0], source[j >= 0]
            by = np.argsort(j, kind="stable")
            target, first, many = np.unique(j[by], return_index=True, return_counts=True)
            extra = np.full((len(target), many.max()), -1, np.int64)
            extra[np.repeat(np.arange(len(target)), many), np.arange(len(j)) - np.repeat(first, many)] = source[by]
            both = np.sort(np.concatenate([graph[target], extra], 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, 1)
            fits = (both >= 0).sum(1) <= s.degree
            keep = np.full((len(target), s.degree), -1, np.int64)
            w = min(s.degree, both.shape[1])
            keep[:, :w] = both[:, :w]
            graph[target[fits]] = keep[fits]
            if (~fits).any():
                graph[target[~fits]] = robust_prune(x, target[~fits], both[~fits], s.degree, alpha)
    return graph, entry


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v of the rows that take part. Vectors of floats stay so, others are of doubles."""
    v = F.col(vector_col)
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    v = v.cast(f"array<{kind}>")
    fine = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine")).where("fine").select("vec_id", "v")


def _kind(df: DataFrame) -> str:
    return "<f4" if isinstance(df.schema["v"].dataType.elementType, T.FloatType) else "<f8"


def _dealt(rows: DataFrame, size: int, *by: str) -> tuple[DataFrame, int]:
    """Rows with ``part``, by a hash of ``by``, of each length about ``size`` rows a part; and the number of parts."""
    sizes = {r["dims"]: r["n"] for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # one row a length
    if not sizes:
        return rows.withColumn("part", F.lit(0).cast("long")), 1
    parts = {d: -(-n // size) for d, n in sizes.items()}
    many = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])[F.col("dims")]
    # A part is bounded, so its rows may stand in one.
    total = sum(parts.values())
    return rows.withColumn("part", F.pmod(F.xxhash64(*by), many)).repartition(total, "dims", "part"), total


def index(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per shard: dims, part, vectors, graph, entry, ids and where each node's ids end."""
    w, kind = Window.partitionBy("v").orderBy("vec_id"), _kind(rows)
    nodes = rows.withColumn("r", F.dense_rank().over(w)).where(F.col("r") <= s.k + 1)
    nodes = nodes.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    dealt, total = _dealt(shared.cut(nodes.withColumn("dims", F.size("v"))), s.shard_rows, "v")
    packed = dealt.groupBy("dims", "part").agg(F.array_sort(F.collect_list(F.struct("ids", "v"))).alias("m"))
    packed = packed.select("dims", "part", F.col("m.ids").alias("ids"), F.flatten("m.v").alias("flat"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                dims, ids = b.column(0)[k].as_py(), b.column(2)[k].as_py()
                x = np.asarray(b.column(3)[k].values, kind).reshape(-1, dims)
                graph, entry = build(x, s)
                ends = np.cumsum([len(i) for i in ids])
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([b.column(1)[k].as_py()], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([graph.astype(np.int32).tobytes()], pa.binary()), pa.array([entry], pa.int32()), pa.array([np.concatenate(ids).astype(np.int64).tobytes()], pa.binary()), pa.array([ends.astype(np.int64).tobytes()], pa.binary())], names=["dims", "part", "vectors", "graph", "entry", "ids", "ends"])

    return packed.coalesce(total).mapInArrow(run, "dims int, part long, vectors binary, graph binary, entry int, ids binary, ends binary")


def query_blocks(queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per block of queries: q_dims, q_ids and q_flat, its vectors one after the other."""
    dealt, total = _dealt(queries.withColumn("dims", F.size("v")), s.block_queries, "vec_id", "v")
    packed = dealt.groupBy("dims", "part").agg(F.collect_list(F.struct("vec_id", "v")).alias("m"))
    return packed.select(F.col("dims").alias("q_dims"), F.col("m.vec_id").alias("q_ids"), F.flatten("m.v").alias("q_flat")).coalesce(total)


def search(shards: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows but its own."""
    kind = _kind(queries)
    blocks = shared.cut(query_blocks(queries, s))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                dims, entry = b.column("dims")[r].as_py(), b.column("entry")[r].as_py()
                if dims != b.column("q_dims")[r].as_py():
                    continue
                x = np.frombuffer(b.column("vectors")[r].as_py(), kind).reshape(-1, dims)
                graph = np.frombuffer(b.column("graph")[r].as_py(), np.int32).reshape(len(x), -1).astype(np.int64)
                ids, ends = (np.frombuffer(b.column(c)[r].as_py(), np.int64) for c in ("ids", "ends"))
                qid = np.asarray(b.column("q_ids")[r].values, np.int64)
                q = np.asarray(b.column("q_flat")[r].values, kind).reshape(-1, dims)
                for lo in range(0, len(q), 256):
                    found, _ = beam_search(x, graph, q[lo : lo + 256], entry, s.search_beam)
                    rows = _nearest(x, ids, ends, qid[lo : lo + 256], q[lo : lo + 256], found, s.k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["query_id", "vec_id", "score"])

    # No key: the few blocks of the stated queries meet each shard once, as rows of bounded size. A task
    # takes some shards and some blocks, so tasks grow neither with the product of both nor too long.
    n, m = shards.rdd.getNumPartitions(), blocks.rdd.getNumPartitions()
    few = shards.drop("part").coalesce(max(1, min(n, max(4096, -(-n // 16)))))
    pairs = few.crossJoin(blocks.coalesce(max(1, -(-m // 64))))
    out = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")


def _nearest(x, ids, ends, qid, q, found, k):
    """Rows of the beam's nodes, by exact distance and id, at most k a query."""
    out_q, out_v, out_d = [], [], []
    for i in range(len(q)):
        node = found[i][found[i] >= 0]
        d = np.sqrt(((x[node].astype(np.float64) - q[i].astype(np.float64)) ** 2).sum(1))
        who = [ids[ends[n - 1] if n else 0 : ends[n]] for n in node]
        vec, dist = np.concatenate(who), np.repeat(d, [len(w) for w in who])
        dist, vec = dist[vec != qid[i]], vec[vec != qid[i]]
        best = np.lexsort((vec, dist))[:k]
        out_q.append(np.full(len(best), qid[i]))
        out_v.append(vec[best])
        out_d.append(dist[best])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_d)


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index every usable row of ``vectors`` and search the rows for which ``is_query`` holds."""
    rows = usable(vectors, id_col, vector_col)
    queries = usable(vectors.where(is_query), id_col, vector_col).distinct()
    return search(shared.cut(index(rows, settings)), queries, settings)
