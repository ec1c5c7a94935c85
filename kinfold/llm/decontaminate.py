"""Benchmark decontamination: MinHash containment search, verified exactly.

Texts are sets of shingles of five lower-case words (letters and digits; everything else
separates). An item is found in a document when at least ``threshold`` of the item's
shingles occur in it.

A short item inside a long document has almost no Jaccard similarity with the whole, so
both sides are partitioned by size. Items fall into classes by their number of shingles
(powers of two). For the class up to u, a document is a row of overlapping windows of 2u
shingles, u apart, so that any passage of u shingles lies whole in one window; MinHash
(one permutation, ``bins`` bins) compares windows and items of like size. In a window that
holds an item to the threshold the two share a minimum in a bin with probability about
0.2 a bin at worst, so with 64 bins the chance to miss it is below 1e-6. That takes items
that fill many bins: in the classes up to ``short`` shingles any shingle of an item that
occurs in a document makes it a candidate, so none is missed. Otherwise a document that
shares a minimum with an item is a candidate. Candidates are verified with all shingles of
the whole document, so nothing false is reported.

Items are prepared on the executors in blocks of bounded size, each a file in the shared
folder. Documents are read once and not shuffled: a task searches each batch of them for
one block after the other and keeps few blocks in memory, so a benchmark of any size works
and the driver knows only the names of the blocks.

Edge cases: null and empty items or documents have no shingle and never match; a text of
1 to 4 words is one shingle; repeated rows are reported each; equal items are all
reported; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textbytes import ALPHANUMERIC, mix, shingles, slices


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    bins: int = 64
    short: int = 16  #: size classes up to so many shingles have every shingle as a signature value
    block_items: int = 20_000  #: items of a block, about
    block_chars: int = 16_000_000  #: and their characters
    kept_blocks: int = 2  #: blocks that a Python worker keeps in memory


@dataclass(frozen=True)
class Items:
    """A block of items, ready to search."""

    ids: np.ndarray
    times: np.ndarray  #: rows of the benchmark with this id and text
    sizes: np.ndarray  #: distinct shingles of each item
    shingle: np.ndarray  #: sorted distinct shingles of all items
    holders: np.ndarray  #: items by shingle, owned as bounds say
    bounds: np.ndarray
    classes: list[tuple[int, np.ndarray, np.ndarray]]  #: size limit, sorted signature values, their items
    settings: Settings


def _bins(h: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each shingle and its rank value there."""
    v = mix(h + np.uint64(0x1F83D9ABFB41BD6B))
    return (v % np.uint64(bins)).astype(np.int64), v


def prepare(ids: Sequence, texts: Sequence[str | None], s: Settings, times: Sequence[int] | None = None) -> Items:
    h, bounds = shingles(texts, ALPHANUMERIC)
    own = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(x) for x in own], np.int64)
    pairs = np.concatenate(own) if own else np.zeros(0, np.uint64)
    who = np.repeat(np.arange(len(own)), sizes)
    order = np.argsort(pairs, kind="stable")
    distinct, first = np.unique(pairs[order], return_index=True)
    classes = []
    for e in sorted({int(n - 1).bit_length() for n in sizes if n}):
        values, items = [], []
        for i in np.flatnonzero((sizes > (1 << e >> 1 if e else 0)) & (sizes <= 1 << e)):
            b, v = _bins(own[i], s.bins)
            if 1 << e <= s.short:
                values.append(v)
                items.append(np.full(len(v), i))
                continue
            low = np.full(s.bins, np.iinfo(np.uint64).max)
            np.minimum.at(low, b, v)
            low = low[low < np.iinfo(np.uint64).max]
            values.append(low)
            items.append(np.full(len(low), i))
        values, items = np.concatenate(values), np.concatenate(items)
        by = np.argsort(values, kind="stable")
        classes.append((1 << e, values[by], items[by]))
    return Items(np.array(ids, dtype=object), np.ones(len(own), np.int64) if times is None else np.asarray(times, np.int64), sizes, distinct, who[order], np.append(first, len(pairs)), classes, s)


def _window_minima(b: np.ndarray, v: np.ndarray, u: int, bins: int, hits: np.ndarray) -> np.ndarray:
    """Which of the shingles at ``hits`` are the minimum of their bin in a window that holds them.

    Windows are pairs of neighbouring blocks of u shingles. Only blocks near a hit are worked out.
    """
    last = (len(v) - 1) // u
    kept = np.zeros(len(hits), bool)
    near = {}

    def low(block: int) -> np.ndarray:
        if block not in near:
            out = np.full(bins, np.iinfo(np.uint64).max)
            np.minimum.at(out, b[block * u : block * u + u], v[block * u : block * u + u])
            near[block] = out
        return near[block]

    for k, i in enumerate(hits):
        at = i // u
        if v[i] > low(at)[b[i]]:
            continue
        sides = [x for x in (at - 1, at + 1) if 0 <= x <= last]
        kept[k] = not sides or any(v[i] <= low(x)[b[i]] for x in sides)
    return kept


def search(texts: list[str | None], items: Items) -> Iterator[tuple[int, int, int]]:
    """(text number, item number, shared shingles) of every verified pair."""
    s = items.settings
    if not len(items.shingle):
        return
    for lo, hi in slices(texts):
        h, bounds = shingles(texts[lo:hi], ALPHANUMERIC)
        if not len(h):
            continue
        b, v = _bins(h, s.bins)
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
        candidates: set[tuple[int, int]] = set()
        for u, values, members in items.classes:
            at = np.minimum(np.searchsorted(values, v), len(values) - 1)
            found = np.flatnonzero(values[at] == v)
            for doc in np.unique(owner[found]):
                a, z = bounds[doc], bounds[doc + 1]
                own = found[(found >= a) & (found < z)] - a
                if z - a > u > s.short:
                    own = own[_window_minima(b[a:z], v[a:z], u, s.bins, own)]
                for x in np.unique(v[a:z][own]):
                    candidates.update((int(doc), int(i)) for i in members[np.searchsorted(values, x) : np.searchsorted(values, x, side="right")])
        by_doc: dict[int, list[int]] = {}
        for doc, i in candidates:
            by_doc.setdefault(doc, []).append(i)
        for doc, wanted in sorted(by_doc.items()):
            own = np.unique(h[bounds[doc] : bounds[doc + 1]])
            at = np.minimum(np.searchsorted(items.shingle, own), len(items.shingle) - 1)
            at = at[items.shingle[at] == own]
            common = np.zeros(len(items.sizes), np.int64)
            for k in at:
                common[items.holders[items.bounds[k] : items.bounds[k + 1]]] += 1
            for i in sorted(wanted):
                if common[i] >= s.threshold * items.sizes[i] - 1e-9:
                    yield lo + doc, i, int(common[i])


def _saved(items: Items) -> bytes:
    """A block as the bytes of plain arrays."""
    null = np.array([i is None for i in items.ids], bool)
    ids = np.array([0 if i is None else i for i in items.ids], np.int64)
    classes = {f"{kind}{u}": x for u, values, members in items.classes for kind, x in (("values", values), ("members", members))}
    out = io.BytesIO()
    np.savez(out, ids=ids, null=null, times=items.times, sizes=items.sizes, shingle=items.shingle, holders=items.holders, bounds=items.bounds, limits=[u for u, _, _ in items.classes], **classes)
    return out.getvalue()


def _loaded(raw: bytes, s: Settings) -> Items:
    z = np.load(io.BytesIO(raw))
    ids = np.array([None if n else int(i) for i, n in zip(z["ids"], z["null"])], dtype=object)
    classes = [(int(u), z[f"values{int(u)}"], z[f"members{int(u)}"]) for u in z["limits"]]
    return Items(ids, z["times"], z["sizes"], z["shingle"], z["holders"], z["bounds"], classes, s)


def _block(folder: str, name: str, s: Settings) -> Items:
    """A block from the shared folder, or from this process's memory of the last few."""
    held = shared.per_process("decontaminate-blocks", dict)
    key = (folder, name, s)
    if key not in held:
        while len(held) >= s.kept_blocks:
            held.pop(next(iter(held)))
        fs, path = shared.filesystem(f"{folder}/{name}")
        with fs.open_input_file(path) as f:
            held[key] = _loaded(f.read(), s)
    return held[key]


def store_blocks(benchmark: DataFrame, folder: str, s: Settings = Settings()) -> list[str]:
    """Prepare the items as blocks below ``folder``, one task a block; the names of the files.

    Rows with equal id and text are one item that knows how often it comes.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    rows = shared.cut(rows.groupBy("item_id", "text").agg(F.count("*").alias("times")))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return []
    many = max(-(-n // s.block_items), -(-chars // s.block_chars))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        ids, texts, times = [], [], []
        for b in batches:
            for own, column in ((ids, 0), (texts, 1), (times, 2)):
                own += b.column(column).to_pylist()
        if ids:
            task = TaskContext.get()
            name = f"block-{task.partitionId():06d}.npz"
            fs, path = shared.filesystem(folder)
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/.{name}-{task.taskAttemptId()}") as f:
                f.write(_saved(prepare(ids, texts, s, times)))
            fs.move(f"{path}/.{name}-{task.taskAttemptId()}", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    dealt = rows.repartitionById(many, F.pmod(F.xxhash64("item_id", "text"), F.lit(many)).cast("int"))
    return sorted(r[0] for r in dealt.mapInArrow(run, "name string").collect())  # one row a block


def contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every document that holds an item."""
    folder = shared.work_dir(docs.sparkSession, "benchmark")
    names = store_blocks(benchmark, folder, settings)

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in names:
                block = _block(folder, name, settings)
                rows = [(ids[d], block.ids[i], n, int(block.sizes[i]), n / block.sizes[i]) for d, i, n in search(texts, block) for _ in range(block.times[i])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item_id", "shared", "item_shingles", "containment"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, shared long, item_shingles long, containment double")


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold no item, with all their columns and no shuffle."""
    folder = shared.work_dir(docs.sparkSession, "benchmark")
    names = store_blocks(benchmark, folder, settings)

    def wanted(texts):
        bad = np.zeros(len(texts), bool)
        for name in names:
            left = np.flatnonzero(~bad)
            for d, _, _ in search([texts[i] for i in left], _block(folder, name, settings)):
                bad[left[d]] = True
        return ~bad

    return shared.keep_texts(docs, wanted)
