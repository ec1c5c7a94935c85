"""WARC archives and Merkle fixity audits of their replicas.

:func:`write` stores pages as WARC 1.1 resource records, each its own gzip member, in
segments (files of bounded size) of one or more replicas, and returns the index: one row
per record with its byte range and SHA-256. :func:`leaves` hashes those ranges as a replica
holds them now, :func:`recorded` as the index remembers them; :func:`ends` adds a leaf for
the length of each file. :func:`tree` hashes the leaves, in order of their offsets, into
trees of fixed fan-out; a node covers a contiguous byte range. :func:`audit` compares two
sets of trees from the roots down and follows only branches that differ, so sound segments
cost one comparison. :func:`fixity` audits every replica against the index, so decay that
both share, decay of the first and bytes behind the last record are all found.

Edge cases: null or empty html is a record with an empty block; a null url has an empty
target; a null id is kept; repeated rows are repeated records; a page of any length is one
record; a truncated or absent file gives leaves that differ from the index; an empty table
has no segment; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

FAN_OUT = 16
#: Stored bytes from which a segment takes no further record.
SEGMENT_BYTES = 256 << 20
#: Segments that one task may write.
_ROLLS = 1 << 20
_INDEX = "segment long, ordinal long, page_id long, url string, offset long, length long, sha256 string"
_LEAF = "segment long, idx long, first long, last long, digest string"


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """One WARC record as a gzip member; the same input gives the same bytes."""
    block = (html or "").encode("utf-8", "replace")
    name = hashlib.sha256(f"{page_id}\n{url}\n".encode() + block).hexdigest()
    uuid = f"{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}"
    target = (url or "").replace("\r", "").replace("\n", "")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(block)}\r\n\r\n"
    gzip = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gzip.compress(head.encode() + block + b"\r\n\r\n") + gzip.flush()


def parse(stored: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one stored record."""
    raw = zlib.decompress(stored, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def segment_name(segment: int) -> str:
    return f"segment-{segment:06d}.warc.gz"


def write(pages: DataFrame, folders: list[str], date: str = "2024-01-01T00:00:00Z", damage: Callable[[int, str | None, bytes], bytes] | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write every page to each replica folder; the index, in the shared folder.

    A partition of the input, in its order, becomes one segment or, above ``segment_bytes``,
    several, so nothing is shuffled. Files are renamed when whole, so a task that runs again
    leaves complete files. ``damage(page_id, url, stored)`` may change the bytes that go
    to the folders after the first: it stands for decay when an audit is exercised.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")

    def run(batches):
        import pyarrow as pa

        task = TaskContext.get()
        segment, attempt, files, offset, ordinal = task.partitionId() * _ROLLS, task.taskAttemptId(), [], 0, 0
        places = [shared.filesystem(f) for f in folders]

        def finish():
            for f, (fs, folder) in zip(files, places):
                f.close()
                fs.move(f"{folder}/.{segment_name(segment)}-{attempt}", f"{folder}/{segment_name(segment)}")
            files.clear()

        for b in batches:
            out = []
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in range(3))):
                if files and offset >= segment_bytes:
                    finish()
                    segment, offset, ordinal = segment + 1, 0, 0
                if not files:
                    for fs, folder in places:
                        fs.create_dir(folder, recursive=True)
                        files.append(fs.open_output_stream(f"{folder}/.{segment_name(segment)}-{attempt}", compression=None))
                stored = record(page_id, url, html, date)
                for k, f in enumerate(files):
                    f.write(damage(page_id, url, stored) if k and damage else stored)
                out.append((segment, ordinal, page_id, url, offset, len(stored), hashlib.sha256(stored).hexdigest()))
                offset += len(stored)
                ordinal += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["segment", "ordinal", "page_id", "url", "offset", "length", "sha256"])
        finish()

    return shared.cut(rows.mapInArrow(run, _INDEX))


def _open(folder: str, segment: int):
    """The file of a segment, or None where it is absent."""
    fs, base = shared.filesystem(folder)
    try:
        return fs.open_input_file(f"{base}/{segment_name(segment)}")
    except FileNotFoundError:
        return None


def leaves(index: DataFrame, folder: str) -> DataFrame:
    """A leaf per record: the hash of its byte range as the replica in ``folder`` holds it now."""

    def run(batches):
        import pyarrow as pa

        handle, held = None, None
        for b in batches:
            segments, ordinals, offsets, lengths = (b.column(c).to_pylist() for c in range(4))
            digests = []
            for s, o, n in zip(segments, offsets, lengths):
                if s != held:
                    handle, held = _open(folder, s), s
                raw = handle.read_at(n, o) if handle is not None and o < handle.size() else b""
                digests.append(hashlib.sha256(f"{o}:{n}:".encode() + hashlib.sha256(raw).digest()).hexdigest())
            last = [o + n for o, n in zip(offsets, lengths)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(last, pa.int64()), pa.array(digests)], names=["segment", "idx", "first", "last", "digest"])

    return index.select("segment", "ordinal", "offset", "length").sortWithinPartitions("segment", "offset").mapInArrow(run, _LEAF)


def _bare_ends(index: DataFrame) -> DataFrame:
    """segment, idx, first, last of a leaf behind the last record of each segment."""
    end = F.max(F.col("offset") + F.col("length"))
    return index.groupBy("segment").agg((F.max("ordinal") + 1).alias("idx"), end.alias("first"), end.alias("last"))


def ends(index: DataFrame, folder: str) -> DataFrame:
    """A leaf per segment behind its records: the length of its file as the replica in ``folder`` holds it now."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes = []
            for s in b.column(0).to_pylist():
                handle = _open(folder, s)
                sizes.append("none" if handle is None else str(handle.size()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array([hashlib.sha256(f"end:{n}".encode()).hexdigest() for n in sizes], pa.string())], names=["segment", "idx", "first", "last", "digest"])

    return _bare_ends(index).mapInArrow(run, _LEAF)


def recorded(index: DataFrame) -> DataFrame:
    """The leaves and ends of a replica that is as it was written, from the hashes in the index."""
    head = F.encode(F.concat_ws(":", "offset", "length", F.lit("")), "UTF-8")
    digest = F.sha2(F.concat(head, F.unhex("sha256")), 256)
    own = index.select("segment", F.col("ordinal").alias("idx"), F.col("offset").alias("first"), (F.col("offset") + F.col("length")).alias("last"), digest.alias("digest"))
    return own.unionByName(_bare_ends(index).withColumn("digest", F.sha2(F.concat(F.lit("end:"), F.col("last").cast("string")), 256)))


def tree(leaf: DataFrame, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Levels of each segment's tree, leaves first; the last level has the roots.

    A node's digest is the SHA-256 of its children's digests in order of their ranges.
    """
    levels = [shared.cut(leaf)]
    top = levels[0].agg(F.max("idx")).first()[0]
    while top:
        own = levels[-1].withColumn("up", F.floor(F.col("idx") / fan_out).cast("long"))
        made = own.groupBy("segment", "up").agg(F.array_sort(F.collect_list(F.struct("first", "last", "digest"))).alias("c"))
        made = made.select("segment", F.col("up").alias("idx"), F.col("c")[0]["first"].alias("first"), F.element_at("c", -1)["last"].alias("last"), F.sha2(F.array_join(F.col("c.digest"), ""), 256).alias("digest"))
        levels.append(shared.cut(made))
        top //= fan_out
    return levels


def audit(good: list[DataFrame], replica: list[DataFrame], fan_out: int = FAN_OUT) -> DataFrame:
    """segment, idx, first, last, expected, found of the leaves that differ.

    Starts at the roots; at each level only children of nodes that differ are compared.
    """
    bad = None
    for a, b in zip(reversed(good), reversed(replica)):
        if bad is not None:
            parent = bad.select(F.col("segment").alias("s"), F.col("idx").alias("p"))
            a, b = (x.join(parent, (x["segment"] == F.col("s")) & (F.floor(x["idx"] / fan_out) == F.col("p")), "left_semi") for x in (a, b))
        both = a.select("segment", "idx", "first", "last", F.col("digest").alias("expected")).join(b.select("segment", "idx", F.col("digest").alias("found")), ["segment", "idx"], "full")
        bad = shared.cut(both.where(~F.col("expected").eqNullSafe(F.col("found"))))
    return bad


def damaged_share(share: int) -> Callable[[int, str | None, bytes], bytes]:
    """Decay for exercises: one byte of each record whose crc32 of (id, url) is 0 modulo ``share`` is flipped."""

    def damage(page_id, url, stored: bytes) -> bytes:
        if decays(page_id, url, share):
            at = len(stored) // 2
            return stored[:at] + bytes([stored[at] ^ 0x20]) + stored[at + 1 :]
        return stored

    return damage


def decays(page_id, url, share: int) -> bool:
    return zlib.crc32(f"{page_id}|{url}".encode()) % share == 0


def check(index: DataFrame, folders: list[str], fan_out: int = FAN_OUT) -> DataFrame:
    """replica (its place in ``folders``) and segment, idx, first, last, expected, found of every leaf
    that is not as the index remembers it. The last idx of a segment stands for the length of its file."""
    many, found = len(folders), None
    for k, folder in enumerate(folders):
        # The trees of all replicas are built and compared together: a tree is one segment of one replica.
        own = leaves(index, folder).unionByName(ends(index, folder)).withColumn("segment", F.col("segment") * many + k)
        found = own if found is None else found.unionByName(own)
    good = recorded(index).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    good = good.withColumn("segment", F.col("segment") * many + F.col("replica")).drop("replica")
    bad = audit(tree(good, fan_out), tree(found, fan_out), fan_out)
    return bad.withColumn("replica", (F.col("segment") % many).cast("int")).withColumn("segment", F.floor(F.col("segment") / many))


def fixity(pages: DataFrame, folder: str, damage: Callable[[int, str | None, bytes], bytes] | None = None) -> DataFrame:
    """Archive the pages in two replicas below ``folder``, audit both against the index, and report each record.

    page_id, url, segment, ordinal, offset, length, sha256 (of the stored record), sound (in both
    replicas), bad_replicas, and segment_whole: both files have the length that was written.
    """
    folders = [os.path.join(folder, "a"), os.path.join(folder, "b")]
    index = write(pages, folders, damage=damage)
    return report(index, check(index, folders))


def report(index: DataFrame, bad: DataFrame) -> DataFrame:
    """The records of the index with what a check found of them."""
    bad = bad.select("segment", F.col("idx").alias("ordinal"), "replica")
    per = bad.groupBy("segment", "ordinal").agg(F.array_sort(F.collect_set("replica")).alias("bad_replicas"))
    torn = bad.join(_bare_ends(index).select("segment", F.col("idx").alias("ordinal")), ["segment", "ordinal"], "left_semi")
    torn = torn.select("segment", F.lit(False).alias("segment_whole")).distinct()
    out = index.join(per, ["segment", "ordinal"], "left").join(torn, "segment", "left")
    return out.withColumn("sound", F.col("bad_replicas").isNull()).withColumn("bad_replicas", F.coalesce("bad_replicas", F.array().cast("array<int>"))).withColumn("segment_whole", F.coalesce("segment_whole", F.lit(True)))
