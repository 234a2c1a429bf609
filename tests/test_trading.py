"""Swing trader, sweeps, sessions on disk, catalogue and reports."""

import gzip
import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from oddsloom import cli
from oddsloom.operators import edges, outcome, research, swing
from oddsloom.plans import catalog, reports
from oddsloom.sources import sessions

FLAT = swing.Swing(take_profit=0.10, least_edge=0.02, cooldown=0.0)


def test_trader_exits_and_limits():
    t = swing.SwingTrader(FLAT)
    bar = {"bid_depth": 9.0, "ask_depth": 1.0}
    opened = t.on_bar("a", 0.0, 0.50, bar)
    assert [x[3:5] for x in opened] == [("open", "book_imbalance")] and abs(t.cash - 9_500) < 1e-9
    assert t.on_bar("a", 60.0, 0.50, bar) == []  # one position a token
    assert [x[3] for x in t.on_bar("a", 120.0, 0.60)] == ["take_profit"] and t.cash > 10_000
    t.on_bar("a", 180.0, 0.50, bar)
    assert [x[3] for x in t.on_bar("a", 240.0, 0.40)] == ["stop_loss"]
    t.on_bar("a", 300.0, 0.50, bar)
    assert [x[3] for x in t.on_bar("b", 300.0 + 37 * 3600, 0.1)] == ["time_decay"]
    t.on_bar("a", 1e6, 0.50, bar)
    assert [x[5] for x in t.resolve("a", 1e6 + 1, True)] == [1.0] and not t.open
    full = swing.SwingTrader(swing.Swing(most_open=1, cooldown=0.0, least_edge=0.02))
    assert len(full.on_bar("a", 0.0, 0.5, bar)) == 1 and full.on_bar("b", 1.0, 0.5, bar) == []


def test_trader_agrees_with_the_expressions(spark):
    """What a trader would open on each bar, if it never held anything, is what signals() says."""
    rng, price, rows = random.Random(4), 0.4, []
    for i in range(120):
        price = min(max(price + rng.uniform(-0.05, 0.05), 0.05), 0.95)
        rows.append(("x", i, float(60 * i), round(price, 4), rng.choice([0.0, 40_000.0]), float(rng.randrange(1, 9)), float(rng.randrange(1, 4)), 60_000.0, rng.choice([1.0, 3.0])))
    cfg = swing.Swing(oversold=40.0, least_hurst=-9.0, least_move=0.05, least_edge=0.01, history=1000)
    df = spark.createDataFrame(rows, "token_id string, trade_id long, ts double, price double, volume double, bid_depth double, ask_depth double, liquidity_usd double, whale_ratio double").withColumn("traded_at", F.timestamp_seconds("ts")).withColumn("hurst", F.lit(1.0))
    got = {r["trade_id"]: r["signal"] for r in swing.signals(swing.indicators(df, cfg), cfg).collect()}
    trader, seen = swing.SwingTrader(cfg), set()
    for r in rows:
        trader.bars["x"] = [*trader.bars.get("x", []), r[3]]
        state = trader.state("x", r[3]) | {"hurst": 1.0}
        best = max(trader.candidates(r[3], state, {"volume": r[4], "bid_depth": r[5], "ask_depth": r[6], "liquidity_usd": r[7], "whale_ratio": r[8]}), default=None)
        best = best if best and best[0] >= cfg.least_edge else None
        assert (best is None) == (got[r[1]] is None), r
        if best:
            assert best[2] == got[r[1]]["strategy"] and abs(best[3] - got[r[1]]["target"]) < 1e-9 and abs(best[4] - got[r[1]]["stop"]) < 1e-9
            seen.add(best[2])
    assert len(seen) >= 3


def test_swing_stream_ends(spark, tmp_path):
    bars = [(*b, 60_000.0, None, None) for b in swing.demo_bars()] + [("climb", 1_800_000_000.0, None, None, None, None, None, None, True)]
    schema = "token_id string, ts double, price double, volume double, bid_depth double, ask_depth double, liquidity_usd double, whale_ratio double, won boolean"
    spark.createDataFrame(bars, schema).coalesce(1).write.parquet(str(tmp_path / "bars"))
    q = swing.swing_trade(spark.readStream.schema(schema).parquet(str(tmp_path / "bars"))).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "fills"), format="parquet")
    ended = q.awaitTermination(90)
    q.stop()
    assert ended
    fills = spark.read.parquet(str(tmp_path / "fills"))
    assert fills.where("action = 'open'").count() > 0
    rows = [r.asDict() for r in reports.journal(fills).collect()]
    assert rows and "fills" in reports.dashboard(rows) and all(r["n_open"] >= 0 for r in rows)


def test_sweep(spark):
    rng, rows = random.Random(1), []
    for i in range(4000):
        price = 0.2 + 0.05 * (i % 10)
        rows.append((i, f"e{i % 400 if i < 3000 else 1000 + i % 60}", "t", price, rng.random() < price + 0.15, "BUY", 1_672_531_200 + i * 3600 * 2))
    df = spark.createDataFrame(rows, "trade_id long, event_id string, token_id string, price double, token_won boolean, side string, s long").withColumn("traded_at", F.timestamp_seconds("s"))
    df = df.withColumns({c: F.lit(2.5) for c in ("volume_spike_1h_24h", "whale_ratio", "time_to_resolution_hours", "momentum_1h", "momentum_6h")} | {"price_volume_divergence": F.lit(False), "price_bucket": outcome.X.price_bucket(F.col("price"))})
    few = [edges.Strategy(b, side="BUY") for b in ("0.20-0.30", "0.40-0.50", "0.90-0.95")]
    got = outcome.sweep(df, "2023-08-20", few, train_days=30, test_days=40)
    assert got["status"] == "ok"
    final = {r["label"]: r for r in got["final"].collect()}
    assert set(final) <= {s.label() for s in few[:2]} and final
    for r in final.values():
        assert r["test_n"] > 50 and r["ev_slip_0"] > r["ev_slip_200"] and r["robustness"] in ("rejected", "fragile", "promising_underpowered", "robust_candidate") and 0 <= r["p_positive"] <= 1
    assert outcome.sweep(df.drop("event_id"), "2023-08-20")["status"] == "BLOCKED"
    assert outcome.sweep(df.withColumn("event_id", F.lit(None).cast("string")), "2023-08-20")["status"] == "BLOCKED"
    gate = research.gate(df.drop("event_id"), "2023-08-20").first()
    assert gate["verdict"] == "BLOCKED"
    assert outcome.fingerprint(df, ["trade_id"]) == outcome.fingerprint(df.repartition(3), ["trade_id"]) != outcome.fingerprint(df.limit(10), ["trade_id"])


def session(root, spark, day="2024-01-10"):
    folder = root / f"s{day[-2:]}"
    sessions.layout(folder)
    raw = [{"event_type": "book", "asset_id": "7" * 77, "market": "m", "timestamp": "1704880000000", "bids": [{"price": "0.4", "size": "2"}], "asks": [{"price": "0.6", "size": "1"}]}, {"event_type": "last_trade_price", "asset_id": "7" * 77, "market": "m", "price": "0.5", "size": "3", "timestamp": "1704880100000"}]
    sessions.write_lines(raw, folder / "raw" / "a.jsonl.gz")
    rows = sessions.rebuild(spark, str(folder / "raw" / "a.jsonl.gz"), str(folder / "normalized"), "s")
    assert {r["token_id"] for r in rows.collect()} == {"7" * 77} and rows.count() == 2
    health = {"emitting_tokens": ["7" * 77], "duration_sec_actual": 100.0, "gaps_detected": 1}
    sessions.write_record(folder, "health.json", health)
    sessions.metadata(folder, ["7" * 77])
    sessions.gap_report(folder, "s", health)
    sessions.fingerprint(folder)
    sessions.manifest(folder, "s", datetime.fromisoformat(day).replace(tzinfo=timezone.utc), None, 100.0, ["7" * 77], ["7" * 77], 2, 2)
    return folder, rows


def test_sessions(spark, tmp_path):
    folder, rows = session(tmp_path, spark)
    assert sessions.validate(folder, 100.0)["ok"] and sessions.diagnostics(spark, folder)["ok"]
    assert "ended early" in sessions.validate(folder, 1000.0)["errors"][0]
    h = sessions.health_of(rows).first()
    assert (h["normalized_rows"], h["trades"], h["duration_sec_actual"]) == (2, 1, 100.0)
    assert sessions.failure({}, 10) == "no raw rows" and sessions.failure({"raw_rows": 2} | h.asDict(), 100) is None and "early" in sessions.failure({"raw_rows": 2} | h.asDict(), 1000)
    done = sessions.bundle_day(tmp_path, "2024-01-10", tmp_path / "out")
    assert done["ok"] and done["n_sessions"] == 1 and not sessions.bundle_day(tmp_path, "2024-01-11", tmp_path / "out")["ok"]
    with gzip.open(folder / "raw" / "a.jsonl.gz", "at") as f:
        f.write("{}\n")
    assert any(e.startswith("hash differs") for e in sessions.validate(folder)["errors"]) and not sessions.bundle_day(tmp_path, "2024-01-10", tmp_path / "out")["ok"]
    (folder / "fingerprints.json").write_text(json.dumps({"files": {"a": "b"}, "at": "/Users/x"}))
    assert any("one machine" in e for e in sessions.validate(folder)["errors"])
    with pytest.raises(ValueError):
        sessions.refuse_test_paths("x/fixtures/y")
    assert not sessions.validate(tmp_path / "none")["ok"]


def test_catalogue_and_settings(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 3.0)], "token_id string, trade_id long, price double, time_to_resolution_hours double").withColumn("traded_at", F.current_timestamp())
    out = catalog.apply(df, ["logit_price", "arcsine_price", "ttr_info_hazard", "unknown", "calibration_residual", "logit_technicals"]).first()
    assert out["logit_price"] == 0.0 and out["ttr_info_hazard"] == 0.25 and out["logit_rsi"] is None
    with pytest.raises(ValueError):
        catalog.apply(df, ["microprice"])
    assert catalog.summary()["total"] == len(catalog.FEATURES) and all(f.category == "book_state" for f in catalog.listed("book_state"))
    assert catalog.coverage_of(catalog.apply(df, ["logit_price"])).first()["logit_price"] == 1.0
    assert catalog.staged_search(1, {})["status"] == "diagnostic_only" and catalog.staged_search(4, {})["status"] == "blocked"
    config = {"global": {"a": 1, "x": {"y": 1, "z": 2}}, "families": {"f": {"x": {"y": 5}}}, "regimes": {"ttr": {"day": {"a": 9}}}}
    assert catalog.settings(config, family="f", ttr="day") == {"a": 9, "x": {"y": 5, "z": 2}}
    assert reports.oos_table([{"label": "l", "train_n": 3, "train_ev_pct": 1.0, "test_n": None, "test_ev_pct": 2.0, "ev_decay": 0.5, "persists": True}]).count("|") == 12
    s = edges.Strategy("0.40-0.50", 2.0, None, 48.0, "pos", side="BUY")
    assert edges.strategy_of(s.label()) == s and edges.strategy_of("all") == edges.Strategy(side=None)


def test_commands(spark, tmp_path, capsys):
    t = [(f"t{i}", "c1" if i % 2 else "c2", str(11 + i % 2), "h", "BUY", 0.4, 2.0, 0.8, 1_700_000_000 + 60 * i) for i in range(30)]
    df = spark.createDataFrame(t, "trade_id string, condition_id string, token_id string, tx_hash string, side string, price double, size double, notional double, s long").withColumn("traded_at", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "trades"))
    m = [("c1", "e1", '["12","13"]', '["1","0"]', "2023-12-01"), ("c2", "e2", '["11","14"]', '["0.5","0.5"]', "2023-12-01")]
    spark.createDataFrame(m, "condition_id string, event_id string, clob_token_ids string, outcome_prices string, end_date string").write.parquet(str(tmp_path / "markets"))
    where = ["--trades", str(tmp_path / "trades"), "--markets", str(tmp_path / "markets")]
    assert cli.main(["build-outcome-lake", *where, "--out", str(tmp_path / "lake")]) == 0
    assert json.loads(capsys.readouterr().out) == {"trades": 15, "features": 15}
    assert cli.main(["merge-expanded", *where[:2], str(tmp_path / "trades"), *where[2:], "--out", str(tmp_path / "merged")]) == 0
    assert json.loads(capsys.readouterr().out) == {"trades": 30, "features": 30}
    assert spark.read.parquet(str(tmp_path / "merged" / "features")).where("event_id is null").count() == 0
    assert cli.main(["sweep-outcomes", "--features", str(tmp_path / "lake" / "features"), "--train-end", "2023-11-14", "--out", str(tmp_path / "sweep")]) == 1
    (tmp_path / "in").mkdir()
    frames = [{"event_type": "last_trade_price", "asset_id": "a", "market": "m", "price": str(p), "size": "10", "timestamp": str(1_700_000_000 + i * 100)} for i, p in enumerate((0.30, 0.35, 0.5))]
    (tmp_path / "in" / "e.txt").write_text("\n".join(map(json.dumps, frames)))
    assert cli.main(["paper-trade", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "paper")]) == 0
    assert "profiles" in capsys.readouterr().out
    assert cli.main(["compact-day", "--sessions", str(tmp_path / "none"), "--date", "2024-01-10", "--out", str(tmp_path / "o")]) == 1
