"""Token ids in binary shards with a minimal perfect hash index.

A shard is one file: a fixed header, the raw ids of all its documents back to back, then
the index. The index maps a document key to the rows that hold it in constant time: a
hash-and-displace minimal perfect hash sends the n distinct keys of the shard to n slots,
a stored 32-bit fingerprint of the key rejects strangers, and the slot names the first row
and the number of rows of that key. Shards hold ascending, disjoint key ranges, so the
manifest finds the shard of a key by bisection.

    header   magic "KFIDS1\\0\\0", then 6 little-endian uint64: id bytes, rows, keys,
             buckets, byte offset of the index, seed
    payload  ids, 2 or 4 bytes each (2 where the vocabulary fits), little-endian
    index    row keys int64[rows], row nulls uint8[rows], row ends uint64[rows],
             pilots uint32[buckets], fingerprints uint32[keys], first row uint32[keys],
             row count uint32[keys]

Edge cases: a null or empty text has only the end id; a null id is kept, sorts first and is
found by the key None; repeated ids keep all their rows, in order of their text; an empty
table writes no shard; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .textbytes import mix

MAGIC = b"KFIDS2\0\0"
TRAILER = len(MAGIC) + 48
MANIFEST = "manifest.json"
#: Bytes of text and rows of a shard, about.
SHARD_BYTES, SHARD_ROWS = 64 << 20, 1 << 20
_SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("many", "<u4")])
_NULL_KEY = np.int64(-(1 << 63))


# -- minimal perfect hash -------------------------------------------------------------


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1)))


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ mix(pilot.astype(np.uint64) + np.uint64(0x51))) % np.uint64(n)).astype(np.int64)


def build_mph(keys: np.ndarray, load: int = 4) -> tuple[np.ndarray, int]:
    """Pilots of each bucket and the seed, such that :func:`find` is a bijection of keys to range(n)."""
    n = len(keys)
    buckets = max(1, n // load)
    for seed in range(64):
        h = _hash(keys, seed)
        b = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        sizes = np.bincount(b, minlength=buckets)
        first = np.cumsum(sizes) - sizes
        taken, pilots, fine = np.zeros(n, bool), np.zeros(buckets, np.uint32), True
        for k in np.argsort(-sizes, kind="stable"):
            if not sizes[k]:
                break
            own = h[order[first[k] : first[k] + sizes[k]]]
            lo = 0
            while lo < 1 << 22:
                step = 64 if lo == 0 else 4096
                at = _slot(own[None, :], np.arange(lo, lo + step)[:, None], n)
                free = ~taken[at].any(1)
                if sizes[k] > 1:
                    srt = np.sort(at, 1)
                    free &= (srt[:, 1:] != srt[:, :-1]).all(1)
                hit = np.flatnonzero(free)
                if len(hit):
                    taken[at[hit[0]]] = True
                    pilots[k] = lo + hit[0]
                    break
                lo += step
            else:
                fine = False
                break
        if fine:
            return pilots, seed
    raise ValueError("keys must be distinct")


def find(keys: np.ndarray, pilots: np.ndarray, seed: int, n: int) -> np.ndarray:
    h = _hash(keys, seed)
    return _slot(h, pilots[(h % np.uint64(len(pilots))).astype(np.int64)], n)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)


# -- shards ------------------------------------------------------------------------------


def index_bytes(keys: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int, int]:
    """The index of a shard, its keys, buckets and seed. Equal keys stand together."""
    distinct, first, count = np.unique(np.where(nulls, _NULL_KEY, keys), return_index=True, return_counts=True)
    pilots, seed = build_mph(distinct)
    slots = np.zeros(len(distinct), _SLOT)
    at = find(distinct, pilots, seed, len(distinct))
    slots["print"][at], slots["first"][at], slots["many"][at] = fingerprint(distinct), first, count
    parts = (keys.astype("<i8"), nulls.astype(np.uint8), ends.astype("<u8"), pilots.astype("<u4"), slots)
    return b"".join(p.tobytes() for p in parts), len(distinct), len(pilots), seed


def trailer(id_bytes: int, rows: int, keys: int, buckets: int, offset: int, seed: int) -> bytes:
    return np.array([id_bytes, rows, keys, buckets, offset, seed], "<u8").tobytes() + MAGIC


class Shard:
    """Access to one shard file. Only the trailer is read at once, everything else by its offset."""

    def __init__(self, path: str):
        fs, name = shared.filesystem(path)
        self._file = fs.open_input_file(name)
        size = self._file.size()
        tail = self._read(max(0, size - TRAILER), min(size, TRAILER))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"not a token shard: {path}")
        self.id_bytes, self.rows, self.n, self.buckets, at, self.seed = map(int, np.frombuffer(tail[: -len(MAGIC)], "<u8"))
        self._at = {}
        for part, width in (("key", 8 * self.rows), ("null", self.rows), ("end", 8 * self.rows), ("pilot", 4 * self.buckets), ("slot", _SLOT.itemsize * self.n)):
            self._at[part], at = at, at + width

    def _read(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def _entries(self, part: str, kind, first: int, count: int) -> np.ndarray:
        kind = np.dtype(kind)
        return np.frombuffer(self._read(self._at[part] + first * kind.itemsize, count * kind.itemsize), kind)

    def rows_of(self, key: int | None) -> range:
        """The rows of a document key, in constant time; an unknown key has none."""
        k = np.array([_NULL_KEY if key is None else key], np.int64)
        h = _hash(k, self.seed)
        pilot = self._entries("pilot", "<u4", int(h[0] % np.uint64(self.buckets)), 1)
        slot = self._entries("slot", _SLOT, int(_slot(h, pilot, self.n)[0]), 1)[0]
        if slot["print"] != fingerprint(k)[0]:
            return range(0)
        first = int(slot["first"])
        own = None if self._entries("null", "u1", first, 1)[0] else int(self._entries("key", "<i8", first, 1)[0])
        return range(first, first + int(slot["many"])) if own == key else range(0)  # exact, after the fingerprint

    def ids(self, row: int) -> np.ndarray:
        lo = max(0, row - 1)
        ends = self._entries("end", "<u8", lo, row - lo + 1)
        a, b = int(ends[0]) if row else 0, int(ends[-1])
        return self.payload(a, b)

    def payload(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the shard."""
        return np.frombuffer(self._read(a * self.id_bytes, (b - a) * self.id_bytes), f"<u{self.id_bytes}").astype("<u4")

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, nulls and ends of all rows, once the index has been found to lead to each of them."""
        keys, nulls, ends = self._entries("key", "<i8", 0, self.rows), self._entries("null", "u1", 0, self.rows), self._entries("end", "<u8", 0, self.rows)
        wanted = np.where(nulls, _NULL_KEY, keys)
        at = find(wanted, self._entries("pilot", "<u4", 0, self.buckets), self.seed, self.n)
        slots = self._entries("slot", _SLOT, 0, self.n)[at]
        row = np.arange(self.rows)
        fine = (slots["print"] == fingerprint(wanted)) & (slots["first"] <= row) & (row < slots["first"].astype(np.int64) + slots["many"])
        if not fine.all():
            raise ValueError(f"the index loses row {int(np.argmin(fine))}")
        return keys, nulls, ends

    def close(self) -> None:
        self._file.close()


# -- encoding ----------------------------------------------------------------------------


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte.

    Printable Latin-1 bytes stand for themselves, the others for U+0100 and on, in order.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


#: The first character after the Latin letters that words are parted here for.
_LATIN_END = "\u0250"


def parts_stops(tokenizer, stops: str) -> bool:
    """Whether the tokenizer itself parts every Latin letter from every stop, and letters or stops from nothing else.

    The pattern is asked about each letter before each stop, and about runs of both.
    """
    letters = [chr(c) for c in range(ord(_LATIN_END)) if chr(c).isalpha() and chr(c) != "\u0130"]
    letters = [c for c in letters if unicodedata.is_normalized("NFC", c)]
    runs = [a + b for a in stops for b in stops]
    probes = [(c.lower(), s) for c in letters for s in stops] + [("ab", r) for r in runs] + [(x + y, stops) for x in "azé\u00df" for y in letters]
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str
    table = str.maketrans({chr(b): c for b, c in _byte_characters().items()})
    shown = lambda t: t.encode().decode("latin-1").translate(table)
    return all([p for p, _ in pieces(word + stop)] == [shown(word), shown(stop)] for word, stop in probes)


class Encoder:
    """Text to the bytes of its ids, through the tokenizers library.

    Where the tokenizer's own rules split at blanks and line feeds and nothing it does looks
    across them, equal words between blanks have equal ids, so each distinct word goes to
    the library once and its ids are kept, in two generations of at most ``keep`` words:
    words in use move to the younger one, the others go. Of a word that is Latin letters and
    stops, letters and stops are parted and lower-cased here, as the tokenizer would, and go
    straight to its model; all other words go through the whole tokenizer.
    """

    _STOPS = ".,;:!?"

    def __init__(self, path: str, id_bytes: int, by_word: bool, keep: int = 250_000):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        self._encode = getattr(t, "encode_batch_fast", t.encode_batch)
        self._model, self._tokenizer = t.model, t  # the model lives with its tokenizer
        self._kind, self._by_word, self._keep = f"<u{id_bytes}", by_word, keep
        self._parts = by_word and parts_stops(t, self._STOPS)
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._table = str.maketrans({chr(b): c for b, c in _byte_characters().items()})

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, self._kind).tobytes() for x in self._encode(texts, add_special_tokens=False)]

    def _piece(self, text: str) -> bytes:
        found = self._young.get(text)
        if found is None:
            found = self._old.get(text)
            if found is None:
                mapped = text.encode().decode("latin-1").translate(self._table)
                found = np.array([x.id for x in self._model.tokenize(mapped)], self._kind).tobytes()
            self._young[text] = found
        return found

    def _word(self, word: str) -> bytes | None:
        """The ids of a simple word, or None."""
        core = word.rstrip(self._STOPS)
        simple = core.isalpha() and (core.isascii() or max(core) < _LATIN_END and "\u0130" not in core and unicodedata.is_normalized("NFC", core))
        if not simple:
            return None
        tail = word[len(core) :]
        return self._piece(core.lower()) + (self._piece(tail) if tail else b"")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self._by_word:
            return self._library([t or "" for t in texts])
        out = []
        for t in texts:
            parts = (t or "").replace("\n", " ").split(" ")
            young, odd = self._young, []
            for w in dict.fromkeys(parts):
                if w in young:
                    continue
                ids = self._old.get(w)
                if ids is None and self._parts:
                    ids = self._word(w)
                if ids is None:
                    odd.append(w)
                else:
                    young[w] = ids
            for lo in range(0, len(odd), 1024):
                young.update(zip(odd[lo : lo + 1024], self._library(odd[lo : lo + 1024])))
            out.append(b"".join(map(young.__getitem__, parts)))
            if len(young) > self._keep:
                self._old, self._young = young, {}
        return out


def _encoder(path: str, end_id: int) -> tuple[int, Encoder]:
    from tokenizers import Tokenizer

    id_bytes = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    return id_bytes, Encoder(path, id_bytes, splits_at_blanks(path))


def splits_at_blanks(path: str) -> bool:
    """Whether the tokenizer file provably treats words between blanks on their own.

    It must drop white space in its pre-tokenizer's pattern and then only map bytes, normalise
    only by steps that do not look across blanks (NFC, lower case, white-space folding), and
    have no post-processor or added token with a blank in it.
    """
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    norm = t.get("normalizer") or {}
    steps = norm.get("normalizers", [norm] if norm else [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    pre = t.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and "[^\\s" in pattern and not any(x in pattern for x in ("(?", " ?", "\\s+", "\\s*", "$", "\\b"))
    tokens = all(not any(c.isspace() for c in a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] for a in t.get("added_tokens", []))
    rest = pre.get("pretokenizers", [])[1:]
    bytes_only = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex")
    return bool(plain and drops and tokens and bytes_only and any(s["type"] == "Lowercase" for s in steps) and not t.get("post_processor"))


def _shards(rows: DataFrame) -> int:
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES), -(-n // SHARD_ROWS))


def write(docs: DataFrame, tokenizer: str | Callable[[], str], out_dir: str, end_id: int = 2, shards: int | None = None) -> list[dict]:
    """Write the shards of all documents below ``out_dir`` with their manifest, and return that, in order of ids.

    ``tokenizer`` is the path of a vocabulary file, or a function that finds it on the executor.
    ``out_dir`` must be a folder that all executors share. Each task writes one shard under a
    name of its own attempt and renames it when whole, so a task that runs again leaves one
    complete file. Rows are dealt by ranges of ids, and of the beginnings of texts where an id
    has many rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = shards or _shards(rows)

    def run(batches: Iterable):
        import pandas as pd

        path = tokenizer if isinstance(tokenizer, str) else tokenizer()
        fs, folder = shared.filesystem(out_dir)
        encoder, task, stream = None, TaskContext.get(), None
        keys, nulls, sizes = [], [], []
        for pdf in batches:
            if not len(pdf):
                continue
            if encoder is None:
                os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
                id_bytes, encoder = shared.per_process(("encoder", path, end_id), lambda: _encoder(path, end_id))
                end = np.array([end_id], f"<u{id_bytes}").tobytes()
                fs.create_dir(folder, recursive=True)
                name = f"shard-{task.partitionId():06d}.ids"
                draft = f"{folder}/.{name}-{task.taskAttemptId()}"
                stream = fs.open_output_stream(draft)
            texts = pdf["text"].tolist()
            for lo in range(0, len(texts), 64):
                made = [x + end for x in encoder.encode(texts[lo : lo + 64])]
                stream.write(b"".join(made))
                sizes.append(np.fromiter((len(x) // id_bytes for x in made), np.int64, len(made)))
            nulls.append(pdf["null"].to_numpy(bool))
            keys.append(pdf["doc_id"].to_numpy(np.int64))
        if stream is None:
            return
        ends = np.cumsum(np.concatenate(sizes))
        key, null = np.concatenate(keys), np.concatenate(nulls)
        index, n, buckets, seed = index_bytes(key, null, ends)
        stream.write(index)
        stream.write(trailer(id_bytes, len(key), n, buckets, int(ends[-1]) * id_bytes, seed))
        stream.close()
        fs.move(draft, f"{folder}/{name}")
        yield pd.DataFrame({"shard": [task.partitionId()], "name": [name], "rows": [len(key)], "ids": [int(ends[-1])], "has_null": [bool(null.any())], "low": [int(key[~null].min()) if (~null).any() else None], "high": [int(key[~null].max()) if (~null).any() else None]}).astype({"low": "Int64", "high": "Int64"})

    rows = rows.withColumn("null", F.col("doc_id").isNull())
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = rows.repartitionByRange(shards, order[0], F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order)
    ordered = ordered.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    made = ordered.mapInPandas(run, "shard int, name string, rows long, ids long, has_null boolean, low long, high long")
    manifest = sorted((r.asDict() for r in made.collect()), key=lambda r: r["shard"])  # one row a shard
    before = 0
    for r in manifest:
        r["start"] = before
        before += r["ids"]
    fs, folder = shared.filesystem(out_dir)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/.{MANIFEST}") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{folder}/.{MANIFEST}", f"{folder}/{MANIFEST}")
    return manifest


def load_manifest(out_dir: str) -> list[dict]:
    """The manifest that :func:`write` left in the folder."""
    fs, folder = shared.filesystem(out_dir)
    with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def read(spark: SparkSession, out_dir: str, manifest: list[dict] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document, as the files hold them and the index finds them."""
    manifest = load_manifest(out_dir) if manifest is None else manifest
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
    todo = spark.createDataFrame([(r["shard"], r["name"], r["start"]) for r in manifest], "shard int, name string, start long").repartition(len(manifest), "shard")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for n, name, start in zip(pdf["shard"], pdf["name"], pdf["start"]):
                shard = Shard(f"{out_dir}/{name}")
                keys, nulls, ends = shard.table()
                ends = ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                lo = 0
                while lo < shard.rows:  # about a million ids at a time
                    hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + (1 << 20), side="right")))
                    ids = shard.payload(int(starts[lo]), int(ends[hi - 1]))
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])]
                    doc_id = pd.array(keys[lo:hi], "Int64")
                    doc_id[nulls[lo:hi].astype(bool)] = pd.NA
                    yield pd.DataFrame({"doc_id": doc_id, "start": start + starts[lo:hi], "n_tokens": ends[lo:hi] - starts[lo:hi], "ids_crc32": crc, "shard": n})
                    lo = hi
                shard.close()

    return todo.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(out_dir: str, manifest: list[dict] | None, key: int | None) -> list[np.ndarray]:
    """The id arrays of one document key: bisect the manifest, then one probe of the shard's index."""
    manifest = load_manifest(out_dir) if manifest is None else manifest
    if key is None:
        held = [r for r in manifest if r["has_null"]]
    else:
        known = [r for r in manifest if r["low"] is not None] if manifest and manifest[0]["low"] is None else manifest
        at, held = bisect_left(known, key, key=lambda r: r["high"]), []
        while at < len(known) and known[at]["low"] <= key:
            held.append(known[at])
            at += 1
    found = []
    for r in held:
        shard = Shard(f"{out_dir}/{r['name']}")
        found += [shard.ids(i) for i in shard.rows_of(key)]
        shard.close()
    return found


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)
