"""Scans: reserve, run, publish, cancel, fail, recover and prune.

A scan writes its memberships to a folder of its own generation; publishing moves the
scope's pointer to it in one commit, and only if the scan is still active and its revision
is still the definition's. Nothing half done is ever visible.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..errors import DomainConflict, RetryExhausted
from ..plans.context import Ability, Context, require
from ..plans.definition import Definition, scoped
from ..sources.store import Store
from .keys import build_keys, with_record_id
from .review import ACTIVE, TERMINAL
from .suggest import not_retired

MEMBERSHIP = "rule_id string, digest string, record_id string, record_id_type string, generation_id string"
#: What a failed scan says of itself.
FAILED, ABANDONED = "scan_failed", "scan_abandoned"

_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(now: dt.datetime | None = None) -> str:
    """A sortable unique id of 26 characters."""
    ms = int((now.timestamp() if now else time.time()) * 1000)
    n = ms << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(_CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


class Scans:
    """The scan lifecycle over a store. ``clock`` gives aware UTC times; ``listeners`` get (event, dict) after a commit.

    A scan that runs renews its heartbeat every ``heartbeat`` seconds, so recovery tells long scans from dead ones.
    """

    def __init__(self, store: Store, key: bytes, clock: Callable[[], dt.datetime] | None = None, listeners: Iterable[Callable[[str, dict], None]] = (), heartbeat: float = 60.0):
        self.store, self.key, self.listeners, self.heartbeat = store, key, list(listeners), heartbeat
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))

    def _tell(self, event: str, **about: Any) -> bool:
        """Listeners run after the commit; one that fails does not undo it."""
        fine = True
        for f in self.listeners:
            try:
                f(event, about)
            except Exception:
                fine = False
        return fine

    def ensure_scope(self, d: Definition, context: Context) -> None:
        """First or create: an existing scope stays as it is."""

        def change(state):
            state["scopes"].setdefault(context.scope, {"id": context.scope, "definition_id": d.id, "definition_revision": d.revision, "scope_hash": context.scope, "connection": d.connection, "model_alias": d.table, "current_generation_id": None, "created_at": self.clock().isoformat(), "updated_at": self.clock().isoformat()})

        if context.scope not in self.store.state()["scopes"]:
            self.store.commit(change)

    def start(self, d: Definition, context: Context) -> str:
        """Reserve a scan; a scope has at most one that is queued or running."""
        require(d, Ability.SCAN, context)
        self.ensure_scope(d, context)
        scan_id, now = ulid(self.clock()), self.clock().isoformat()

        def change(state):
            if any(s["scope_id"] == context.scope and s["state"] in ACTIVE for s in state["scans"].values()):
                raise DomainConflict("a scan of this scope is under way")
            state["scans"][scan_id] = {"id": scan_id, "scope_id": context.scope, "generation_id": scan_id, "config_revision": d.revision, "state": "queued", "cursor": None, "counters": {}, "failure_code": None, "heartbeat_at": None, "started_at": None, "finished_at": None, "created_at": now, "updated_at": now}

        self.store.commit(change)
        return scan_id

    def _move(self, scan_id: str, to: str, **fields: Any) -> None:
        def change(state):
            scan = state["scans"].get(scan_id)
            if scan is None or scan["state"] not in ACTIVE:
                raise DomainConflict(f"scan {scan_id} is not active")
            scan.update(state=to, updated_at=self.clock().isoformat(), **fields)

        self.store.commit(change)

    def _beat(self, scan_id: str, done: threading.Event) -> None:
        """Renew the heartbeat until the work is done or the scan is not active any more."""

        def change(state):
            scan = state["scans"].get(scan_id)
            if scan is None or scan["state"] not in ACTIVE:
                raise DomainConflict("the scan is no longer active")
            scan["heartbeat_at"] = self.clock().isoformat()

        while not done.wait(self.heartbeat):
            try:
                self.store.commit(change)
            except RetryExhausted:
                continue  # others were busy; the next beat will do
            except DomainConflict:
                return

    def run(self, d: Definition, context: Context, scan_id: str, records: DataFrame, ledger: DataFrame | None = None, domain: str = "", keys_unique: bool = True) -> dict[str, int]:
        """Index the scope's records as one batch job and publish; counters are of rows read, indexed and skipped.

        The job reads the records once and counts on the way. With ``keys_unique`` the declared
        primary key is trusted, so a record comes once and nothing is shuffled; otherwise
        repeated records are dropped at the cost of a shuffle by rule and record.
        """
        scan = self.store.state()["scans"][scan_id]
        if scan["scope_id"] != context.scope or scan["config_revision"] != d.revision:
            raise DomainConflict("the scan belongs to another scope or revision")
        now = self.clock().isoformat()
        self._move(scan_id, "running", started_at=now, heartbeat_at=now)
        done = threading.Event()
        beating = threading.Thread(target=self._beat, args=(scan_id, done), daemon=True)
        beating.start()
        try:
            read, kept, made = Observation("read"), Observation("kept"), Observation("made")
            own = with_record_id(d, scoped(d, records, context)).observe(read, F.count(F.lit(1)).alias("n"))
            live = not_retired(own, ledger, domain).observe(kept, F.count(F.lit(1)).alias("n"))
            rows = build_keys(d, live.select(*records.columns), self.key).observe(made, F.count(F.lit(1)).alias("n"))
            if not keys_unique:
                rows = rows.dropDuplicates(["rule_id", "record_id", "record_id_type"])
            path = f"{self.store.root}/memberships/generation_id={scan['generation_id']}"
            rows.write.mode("overwrite").partitionBy("rule_id").parquet(path)
            scanned, left, indexed = (int(o.get["n"]) for o in (read, kept, made))
            counters = {"chunks": 1, "scanned": scanned, "indexed": indexed, "skipped_retired": scanned - left}
            done.set()
            beating.join()
            self.publish(d, scan_id, counters)
            return counters
        except DomainConflict:
            raise
        except Exception:
            self.fail(scan_id, FAILED)
            raise
        finally:
            done.set()

    def _has_rows(self, path: str) -> bool:
        fs, p = self.store._fs, self.store._path
        return any(s.isDirectory() for s in fs.listStatus(p(path)))

    def publish(self, d: Definition, scan_id: str, counters: dict[str, int]) -> None:
        now = self.clock().isoformat()

        def change(state):
            scan = state["scans"][scan_id]
            if scan["state"] not in ACTIVE:
                raise DomainConflict("the scan is no longer active")
            if scan["config_revision"] != d.revision:
                raise DomainConflict("the definition changed during the scan")
            scan.update(state="succeeded", finished_at=now, updated_at=now, counters=counters)
            scope = state["scopes"][scan["scope_id"]]
            scope.update(current_generation_id=scan["generation_id"], definition_revision=d.revision, updated_at=now)

        self.store.commit(change)
        self._tell("ScanCompleted", scan_id=scan_id, counters=counters)

    def cancel(self, scan_id: str) -> None:
        self._move(scan_id, "cancelled", finished_at=self.clock().isoformat())

    def fail(self, scan_id: str, code: str = FAILED) -> None:
        self._move(scan_id, "failed", failure_code=code, finished_at=self.clock().isoformat())
        self._tell("ScanFailed", scan_id=scan_id, code=code)

    def memberships(self, context: Context) -> DataFrame:
        """The published generation of the scope; partitions by rule are pruned."""
        generation = self.store.state()["scopes"].get(context.scope, {}).get("current_generation_id")
        spark = self.store.spark
        path = f"{self.store.root}/memberships/generation_id={generation}"
        if generation is None or not self._has_rows(path):
            return spark.createDataFrame([], MEMBERSHIP)
        return spark.read.schema("digest string, record_id string, record_id_type string, rule_id string").parquet(path).withColumn("generation_id", F.lit(generation))

    def frames(self) -> tuple[DataFrame, DataFrame]:
        """Scopes and scans as DataFrames."""
        state, spark = self.store.state(), self.store.spark
        scopes = spark.createDataFrame([(json.dumps(x),) for x in state["scopes"].values()], "j string")
        scans = spark.createDataFrame([(json.dumps(x),) for x in state["scans"].values()], "j string")
        a = "id string, definition_id string, definition_revision string, scope_hash string, connection string, model_alias string, current_generation_id string, created_at timestamp, updated_at timestamp"
        b = "id string, scope_id string, generation_id string, config_revision string, state string, cursor string, counters map<string,bigint>, failure_code string, heartbeat_at timestamp, started_at timestamp, finished_at timestamp, created_at timestamp, updated_at timestamp"
        return scopes.select(F.from_json("j", a).alias("x")).select("x.*"), scans.select(F.from_json("j", b).alias("x")).select("x.*")

    def recover_stalled(self, minutes: int) -> int:
        """Fail queued and running scans without a sign of life for so long (at least one minute)."""
        cutoff = (self.clock() - dt.timedelta(minutes=max(1, minutes))).isoformat()
        count = 0

        def change(state):
            nonlocal count
            count = 0
            for s in state["scans"].values():
                beat = s["heartbeat_at"] or s["created_at"]
                if s["state"] == "queued" and s["created_at"] < cutoff or s["state"] == "running" and beat < cutoff:
                    now = self.clock().isoformat()
                    s.update(state="failed", failure_code=ABANDONED, finished_at=now, updated_at=now)
                    count += 1

        self.store.commit(change)
        return count

    def prune(self, days: int) -> int:
        """Forget old terminal scans and drop their memberships, but never the published generation."""
        cutoff = (self.clock() - dt.timedelta(days=max(1, days))).isoformat()
        gone: list[str] = []

        def change(state):
            gone.clear()
            held = {s["current_generation_id"] for s in state["scopes"].values()}
            for k, s in list(state["scans"].items()):
                if s["state"] in TERMINAL and s["finished_at"] < cutoff and s["generation_id"] not in held:
                    gone.append(s["generation_id"])
                    del state["scans"][k]

        self.store.commit(change)
        for g in gone:
            self.store.drop(f"{self.store.root}/memberships/generation_id={g}")
        return len(gone)
