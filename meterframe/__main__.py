"""Command line jobs.

    python -m meterframe land     --source S --side consumption --landing L
    python -m meterframe ingest   --landing L --contracts C.yaml --prices P [--points PP] --root R
    python -m meterframe backfill --landing L --contracts C.yaml --prices P [--points PP] --root R \\
                                  --start 2024-01-01T00:00:00 --stop 2024-01-08T00:00:00 [--resolution PT15M]
    python -m meterframe refresh  --root R
    python -m meterframe report   --root R (--out O | --point MP) [--from 2024-01-01] [--to 2024-01-31]

``R`` holds ``energies/``, ``rollups/``, ``wide/``, the stream's ``_checkpoint``,
``_rejects`` and the ``_outbox`` of loads that a sink has yet to take.  ``land``
puts received documents (one a line) into the landing by the local days they
cover; a flat landing (``measure_type=1``, ``measure_type=6``) can be read too.
Prices are a Parquet table ``(time, price)``.  Price points (``--points``, a
table of ``schemas.PRICE_POINTS``) are put into ``R/price_points`` by time and
tags; once there are any, they price the wide points.  Paths are whatever the
cluster's file system accepts (shared storage on a cluster).
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meterframe.config import SIDES, Settings
from meterframe.operators.contracts import ContractTable, fee_violations, violations
from meterframe.operators.report import daily_report
from meterframe.plans import jobs
from meterframe.session import build_session
from meterframe.sinks.energies_table import EnergiesTable
from meterframe.sinks.price_points import PricePointStore
from meterframe.sinks.rollup_store import RollupStore
from meterframe.sources import contracts as SC
from meterframe.sources.landing import land
from meterframe.sources.prices import read_day_ahead_prices, read_price_points
from meterframe.sinks.wide_table import WideTable
from meterframe.streaming.ingest import run_ingest
from meterframe.streaming.loads import Loads


def _contracts(spark, path: str, tz: str):
    config = SC.config_from_yaml(spark, path) if path.endswith((".yaml", ".yml")) \
        else SC.read_contract_config(spark, path)
    problems = SC.bound_problems(config, tz).collect()
    if problems:
        raise SystemExit(f"contract bounds rejected: {[r.asDict() for r in problems]}")
    lost = SC.unusable(config).collect()
    if lost:
        raise SystemExit(f"contracts rejected: {[r.asDict(recursive=True) for r in lost]}")
    table = SC.flatten(config, tz)
    wrong = [r.asDict() for found in (violations(table), fee_violations(table)) for r in found.collect()]
    if wrong:
        raise SystemExit(f"contracts rejected: {wrong}")
    return ContractTable(table)


def _points(spark, root: str, path: str | None):
    """The root's stored points, with those of ``path`` put in first; None if it has none."""
    store = PricePointStore(spark, f"{root}/price_points")
    if path:
        store.upsert(read_price_points(spark, path))
    return store if store.publisher.files.exists(store.path) else None


def _table(spark, root: str, tz: str) -> EnergiesTable:
    table = EnergiesTable(spark, f"{root}/energies", tz)
    try:
        table.read()  # lists the folder; raises when the table does not exist yet
    except AnalysisException as e:  # first run: create the empty table
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table.create()
    return table


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="meterframe")
    ap.add_argument("command", choices=["land", "ingest", "backfill", "refresh", "report"])
    ap.add_argument("--root")
    ap.add_argument("--source")
    ap.add_argument("--side", choices=sorted(SIDES), default="consumption")
    ap.add_argument("--landing")
    ap.add_argument("--contracts")
    ap.add_argument("--prices")
    ap.add_argument("--points")
    ap.add_argument("--start")
    ap.add_argument("--stop")
    ap.add_argument("--resolution", default="PT1H")
    ap.add_argument("--from", dest="date_from")
    ap.add_argument("--to", dest="date_to")
    ap.add_argument("--point")
    ap.add_argument("--out")
    ap.add_argument("--tz", default=Settings().tz)
    ap.add_argument("--master")
    a = ap.parse_args(argv)
    if a.command != "land" and not a.root:
        ap.error("--root is required")
    if a.command == "report" and not (a.out or a.point):
        ap.error("a report of all meters goes to --out; one --point is printed")
    settings = Settings(tz=a.tz)
    spark = build_session(a.master)
    if a.command == "land":
        land(spark.read.text(a.source).withColumn("measure_type", F.lit(SIDES[a.side])), a.landing.rstrip("/"))
        spark.stop()
        return
    root = a.root.rstrip("/")
    rollups = RollupStore(spark, f"{root}/rollups", settings)

    if a.command == "ingest":
        table = _table(spark, root, a.tz)
        report = run_ingest(spark, a.landing, table, rollups, _contracts(spark, a.contracts, a.tz),
                            read_day_ahead_prices(spark, a.prices), f"{root}/_checkpoint",
                            f"{root}/_rejects", settings, wide_path=f"{root}/wide",
                            points=_points(spark, root, a.points), outbox=f"{root}/_outbox")
        print(json.dumps({"batches": report.batches, "rejected_documents": report.rejected_documents,
                          "readings": report.readings, "empty": report.empty, "errors": report.errors,
                          "waiting": report.waiting}))
    elif a.command == "backfill":
        table = _table(spark, root, a.tz)
        loads = Loads(spark, f"{root}/_outbox", f"{root}/_rejects", table, rollups, _contracts(spark, a.contracts, a.tz),
                      read_day_ahead_prices(spark, a.prices), settings, WideTable(spark, f"{root}/wide"),
                      _points(spark, root, a.points))
        done = jobs.run_backfill(loads, a.landing, a.start, a.stop, a.resolution)
        days = sorted(done.days)
        print(json.dumps({"days": len(days), "first": days[0] if days else None, "last": days[-1] if days else None,
                          "errors": done.errors, "waiting": done.waiting}))
    elif a.command == "refresh":
        rollups.refresh_full(EnergiesTable(spark, f"{root}/energies", a.tz).read())
    else:
        lo = dt.datetime.fromisoformat(a.date_from) if a.date_from else None
        hi = dt.datetime.fromisoformat(a.date_to) if a.date_to else None
        rep = daily_report(rollups.read("consumption", "day", lo, hi), lo, hi, a.point)
        if a.out:
            rep.write.mode("overwrite").parquet(a.out)
        else:
            for r in rep.toLocalIterator():  # one meter: a row a day
                print(json.dumps({k: (v.isoformat() if hasattr(v, "isoformat") else v)
                                  for k, v in r.asDict().items()}))
    spark.stop()


if __name__ == "__main__":
    main()
