"""Command line: python -m oddsloom.cli COMMAND; results are JSON lines."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .operators import edges, outcome, research, swing
from .plans import operations, reports
from .sources import lake, sessions
from .streaming import live


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="oddsloom")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=about)

    on_lake = {
        "ingest": "raw files to the lake", "compute-features": "features of the lake's trades", "find-edges": "edges of the default grid, or out of sample with --split-date",
        "backtest": "one strategy's summary", "status": "counts of the lake", "audit-data": "repeated trade ids", "outcome-gate": "is there enough evidence",
    }
    p = {name: command(name, about) for name, about in on_lake.items()}
    for x in p.values():
        x.add_argument("--lake", required=True)
    for kind in ("trades", "markets"):
        p["ingest"].add_argument(f"--{kind}", nargs="*", default=[])
    p["find-edges"].add_argument("--split-date")
    p["find-edges"].add_argument("--min-samples", type=int)
    p["find-edges"].add_argument("--min-ev-pct", type=float)
    p["find-edges"].add_argument("--top-k", type=int, default=50)
    p["outcome-gate"].add_argument("--train-end", required=True)
    b = p["backtest"]
    b.add_argument("--price-bucket")
    for name in ("spike", "whale", "ttr"):
        b.add_argument(f"--{name}", type=float)
    for name in ("momentum-1h", "momentum-6h"):
        b.add_argument(f"--{name}", choices=("any", "pos", "neg"), default="any")
    b.add_argument("--side", default="BUY", help="empty: both sides")
    b.add_argument("--slip-bps", type=float, default=0.0)
    b.add_argument("--category", help="charges its fees")
    for name in ("find-edges", "backtest"):
        p[name].add_argument("--start")
        p[name].add_argument("--end")
    ready = command("readiness", "exit code 0 only if the coverage suffices")
    ready.add_argument("--coverage", required=True, help="JSON file")
    watch = command("watchdog-check", "exit code 0 only if collection is healthy")
    watch.add_argument("--runs", required=True, help="JSON file, a list of runs")
    for name, about in {"build-outcome-lake": "canonical trades and features from Parquet trades and markets", "merge-expanded": "the same from a lake and further years, with fees"}.items():
        x = command(name, about)
        x.add_argument("--trades", nargs="+", required=True, help="Parquet; the first is the lake's")
        x.add_argument("--markets", required=True)
        x.add_argument("--out", required=True)
    s = command("sweep-outcomes", "walk-forward sweep of the coarse grid over features with events")
    s.add_argument("--features", required=True)
    s.add_argument("--train-end", required=True)
    s.add_argument("--out", required=True)
    for name, about in {"paper-trade": "price-band profiles on a folder of captured frames", "swing-trade": "indicator profiles on a folder of Parquet bars"}.items():
        x = command(name, about)
        x.add_argument("--input", required=True)
        x.add_argument("--out", required=True)
    c = command("compact-day", "archive of a day's sessions; exit code 0 only if all are valid")
    c.add_argument("--sessions", required=True)
    c.add_argument("--date", required=True)
    c.add_argument("--out", required=True)
    command("diagnostics", "checks of one session; exit code 0 only if they pass").add_argument("--session", required=True)
    return out


def finish(rows: DataFrame, out: str) -> None:
    """Run a finite stream to its end, with its state beside its output."""
    query = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{out}_state").start(out, format="parquet")
    query.awaitTermination()


def research_command(spark: SparkSession, a: argparse.Namespace) -> int:
    read = spark.read.parquet
    if a.command in ("build-outcome-lake", "merge-expanded"):
        first, *years = map(read, a.trades)
        trades, made = outcome.merge_lakes(first, years, read(a.markets)) if a.command == "merge-expanded" else outcome.canonical(first, read(a.markets))
        trades.write.mode("overwrite").parquet(f"{a.out}/trades")
        made.write.mode("overwrite").parquet(f"{a.out}/features")
        print(json.dumps({"trades": read(f"{a.out}/trades").count(), "features": read(f"{a.out}/features").count()}))
    elif a.command == "sweep-outcomes":
        got = outcome.sweep(read(a.features), a.train_end)
        for name in ("attempts", "folds", "final"):
            if name in got:
                got[name].write.mode("overwrite").parquet(f"{a.out}/{name}")
        print(json.dumps({"status": got["status"], "reason": got.get("reason")}))
        return 0 if got["status"] == "ok" else 1
    elif a.command == "swing-trade":
        finish(swing.swing_trade(spark.readStream.schema(read(a.input).schema).parquet(a.input)), a.out)
        print(reports.dashboard([r.asDict() for r in reports.journal(read(a.out)).collect()]))  # a row a profile
    elif a.command == "paper-trade":
        finish(live.live_features(live.parse_events(spark.readStream.text(a.input)), expire=False), f"{a.out}_features")
        finish(live.paper_trade(spark.readStream.schema(live.FEATURES).parquet(f"{a.out}_features")), a.out)
        print(reports.dashboard([r.asDict() for r in reports.journal(read(a.out)).collect()]))  # a row a profile
    else:
        report = sessions.diagnostics(spark, a.session)
        print(json.dumps(report, default=str))
        return 0 if report["ok"] else 1
    return 0


def show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():  # reports of a few rows
        print(row)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "ingest":
        print(json.dumps(lake.ingest(spark, a.lake, a.trades, a.markets)))
        return
    if a.command == "compute-features":
        print(json.dumps({"rows": lake.compute_features(spark, a.lake).count()}))
        return
    lake.views(spark, a.lake)
    if a.command == "status":
        show(lake.status(spark))
    elif a.command == "audit-data":
        show(research.audit_duplicates(spark.table("v_trades")))
    elif a.command == "outcome-gate":
        show(research.gate(spark.table("v_trade_features"), a.train_end))
    else:
        rows = edges.in_time(spark.table("v_trade_features"), a.start, a.end)
        if a.command == "backtest":
            one = edges.Strategy(a.price_bucket, a.spike, a.whale, a.ttr, a.momentum_1h, a.momentum_6h, False, a.side or None)
            show(edges.simulate(rows, [one], a.slip_bps, a.category))
        elif a.split_date:
            show(edges.oos_edges(rows, a.split_date, None, a.min_samples or 20, a.top_k))
        else:
            show(edges.find_edges(rows, None, a.min_samples or 5, a.min_ev_pct).limit(a.top_k))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "readiness":
        verdict = operations.readiness(json.loads(Path(a.coverage).read_text()))
        print(json.dumps(verdict))
        return 0 if verdict["research_authorized"] else 1
    if a.command == "watchdog-check":
        verdict = operations.watchdog(json.loads(Path(a.runs).read_text()))
        print(json.dumps(verdict))
        return 0 if verdict["healthy"] else 1
    if a.command == "compact-day":
        done = sessions.bundle_day(a.sessions, a.date, a.out)
        print(json.dumps(done))
        return 0 if done["ok"] else 1
    if a.command in ("build-outcome-lake", "merge-expanded", "sweep-outcomes", "swing-trade", "paper-trade", "diagnostics"):
        return research_command(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)
    run(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
