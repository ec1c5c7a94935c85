"""Command line: python -m kinfold scan|recover|prune --definition module:name --store PATH ...

scan needs --actor and --input (a folder of Parquet tables). Records that were merged are skipped: by the
ledger of the store, or by the one at --ledger (Parquet).
"""

from __future__ import annotations

import argparse
import importlib
import os
import sys

from pyspark.sql import SparkSession

from .errors import EngineError
from .functions.digest import retirement_domain
from .operators.desk import LEDGER_TABLE
from .operators.lifecycle import Scans
from .operators.resolve import LEDGER
from .plans.context import ServiceContextResolver, resolve
from .sources.scan import host
from .sources.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    scan, recover, prune = (sub.add_parser(n) for n in ("scan", "recover", "prune"))
    for s in (scan, recover, prune):
        s.add_argument("--store", required=True)
    scan.add_argument("--definition", required=True, help="module:attribute")
    scan.add_argument("--input", required=True)
    scan.add_argument("--actor", required=True)
    scan.add_argument("--tenant")
    scan.add_argument("--ledger")
    recover.add_argument("--minutes", type=int, default=15)
    prune.add_argument("--days", type=int, default=30)
    a = p.parse_args(argv)
    key = os.environ.get("KINFOLD_KEY", "").encode()
    spark = SparkSession.builder.appName("kinfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    scans = Scans(Store(spark, a.store), key)
    try:
        if a.command == "recover":
            print(f"recovered {scans.recover_stalled(a.minutes)}")
        elif a.command == "prune":
            print(f"pruned {scans.prune(a.days)}")
        else:
            if not key:
                raise SystemExit("KINFOLD_KEY is not set")
            module, _, name = a.definition.partition(":")
            d = getattr(importlib.import_module(module), name)
            context = resolve(d, ServiceContextResolver(a.actor, "cli", a.tenant), key)
            scan_id = scans.start(d, context)
            ledger = spark.read.parquet(a.ledger) if a.ledger else scans.store.read(LEDGER_TABLE, LEDGER)
            print(scans.run(d, context, scan_id, host(spark, a.input, d.table), ledger, retirement_domain(d.connection, d.table, d.domain)))
    except EngineError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
