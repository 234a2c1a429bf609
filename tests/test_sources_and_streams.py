import json
import math
import os

import pandas as pd

from oddsloom.functions import expressions as X
from oddsloom.operators import books, edges, features, research
from oddsloom.sources import lake, normalize
from oddsloom.streaming import live
from pyspark.sql import functions as F

TRADES = [
    {"proxyWallet": "w", "side": "buy", "asset": "11", "conditionId": "c1", "size": 10, "price": 0.4, "timestamp": 1700000000, "transactionHash": "a"},
    {"proxyWallet": "w", "side": "SELL", "asset": "11", "conditionId": "c1", "size": 10, "price": 0.5, "timestamp": 1700000000000, "transactionHash": "b"},
    {"proxyWallet": "w", "side": "BUY", "asset": "12", "conditionId": "c1", "size": 10, "price": 0.5, "timestamp": "2023-11-14T22:13:20Z", "transactionHash": "c"},
    {"proxyWallet": "w", "side": "BUY", "asset": "12", "conditionId": "c1", "size": 10, "price": 1.5, "timestamp": 1700000000, "transactionHash": "bad"},
]
MARKETS = [
    {"conditionId": "c1", "clobTokenIds": '["11", "12"]', "outcomePrices": '["1", "0"]', "resolvedAt": "2023-11-20T00:00:00Z"},
    {"conditionId": "c2", "clobTokenIds": '["21", "22"]', "outcomePrices": '["0.5", "0.5"]'},
]


def test_ingest_and_features(spark, tmp_path):
    raw, out = tmp_path / "t.json", str(tmp_path / "lake")
    raw.write_text(json.dumps(TRADES))
    (tmp_path / "m.json").write_text(json.dumps({"data": MARKETS}))
    for _ in range(2):  # the second time replaces the first
        counts = lake.ingest(spark, out, [str(raw)], [str(tmp_path / "m.json")])
    assert counts == {"trades": 3, "markets": 2, "market_tokens": 4}
    times = {r["traded_at"] for r in spark.table("v_trades").collect()}
    assert len(times) == 1
    won = {r["tx_hash"]: r["token_won"] for r in spark.table("v_resolved_trades").collect()}
    assert won == {"a": True, "b": True, "c": False}
    assert lake.compute_features(spark, out).count() == 3
    assert lake.status(spark).first()["resolved_trades"] == 3
    good, bad = normalize.normalize_trades(spark.read.json(str(raw), multiLine=True))
    assert (good.count(), bad.count()) == (3, 1)


def test_empty_strategy_and_unknown_momentum(spark):
    df = spark.createDataFrame([(0.4, True)], "price double, token_won boolean")
    assert edges.strategy_filter(df, edges.Strategy(spike=1.0)).count() == 0
    assert edges.edge_stats(df, edges.Strategy(side="BUY")).first()["n"] == 0
    assert len(edges.grid()) == 1872 and len(edges.coarse_grid()) == 270


def test_book_replay_marks_gaps(spark):
    schema = "asset_id string, exchange_time double, seq long, event_type string, side string, price double, size double, bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
    m = [("a", 1.0, 1, "snapshot", None, None, None, [(0.4, 5.0)], [(0.6, 5.0)]), ("a", 2.0, 5, "delta", "BUY", 0.45, 2.0, None, None), ("a", 3.0, 6, "snapshot", None, None, None, [(0.4, 1.0)], [(0.5, 1.0)])]
    m += [("a", 4.0, None, "reconnect", None, None, None, None, None), ("a", 5.0, 7, "delta", "SELL", 0.5, 0.0, None, None), ("a", 6.0, 8, "book", None, None, None, [], []), ("a", 7.0, 9, "book", None, None, None, [(0.6, 3.0)], [(0.5, 1.0)])]
    got = books.replay(spark.createDataFrame(m, schema)).orderBy("exchange_time").collect()
    assert [(r["exchange_time"], r["uncertain"]) for r in got] == [(1.0, False), (2.0, True), (3.0, False), (5.0, True), (7.0, False)]
    assert got[1]["best_bid"] == 0.45 and got[1]["gaps"] == 1 and abs(got[2]["spread"] - 0.1) < 1e-12
    assert got[3]["best_ask"] == 0.5 and got[4]["crossed"]  # a delta on an uncertain book changes nothing


def test_scalars(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("v")).first()["v"]
    assert v(X.price_bucket(F.lit(0.95))) == "0.95-1.00" and v(X.price_bucket(F.lit(0.05))) == "0.05-0.10"
    assert abs(v(X.sigmoid(X.logit(F.lit(0.3)))) - 0.3) < 1e-12
    assert v(X.taker_fee(F.lit(100.0), F.lit(0.5), X.fee_rate(F.lit("Crypto")))) == 1.75
    assert v(X.fee_rate(F.lit("nothing"))) == 0.07 and v(X.fee_rate(F.lit("geopolitics"))) == 0.0
    assert v(X.winner_from_prices(F.lit("['0', '1']"))) == 1 and v(X.winner_from_prices(F.lit("x"))) is None
    assert abs(v(X.kelly(F.lit(0.6))) - 0.05) < 1e-12 and v(X.round_to_tick(F.lit(0.125))) == 0.12
    assert v(X.tp_sl_tick(F.lit(0.5), F.lit(0.6), 0.05, 0.03)) == "take_profit"


def test_research_helpers():
    folds = research.purged_folds("2023-01-01", "2023-06-01")
    assert len(folds) == 3 and folds[1]["train_start"] == "2023-01-08"
    assert research.bootstrap_ci([1.0] * 5)["p_positive"] == 1.0
    assert 0 < research.deflated_sharpe(0.2, 500, 10) < 1e-100 and 0.4 < research.deflated_sharpe(1.3, 50, 10) < 0.6
    assert research.pbo([1, 2, 3], [3, 2, 1]) == 1 / 3
    assert research.classify(40, 1.0, 2.0, 0.9, 1.0) == "robust_candidate"


def test_streamed_features_equal_the_window(spark, tmp_path):
    raw = [json.dumps({"event_type": "last_trade_price", "asset_id": t, "price": str(0.40 + 0.01 * i), "size": str(10 + i), "timestamp": str(1_700_000_000_000 + i * 600_000), "side": "BUY"}) for i in range(12) for t in ("x", "y")]
    raw.append(json.dumps([{"event_type": "book", "asset_id": "x", "timestamp": "1699999999000", "bids": [{"price": "0.3", "size": "1"}], "asks": [{"price": "0.6", "size": "1"}]}]))
    for k in range(3):  # three files, three micro-batches, in order of time
        f = tmp_path / f"{k}.txt"
        f.write_text("\n".join(raw[-1:] + raw[k * 8 : k * 8 + 8]))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path))
    q = live.live_features(live.parse_events(stream), expire=False).writeStream.format("memory").queryName("live_f").outputMode("append").trigger(availableNow=True).start()
    ended = q.awaitTermination(120)
    q.stop()
    assert ended
    got = spark.table("live_f").toPandas().sort_values(["token_id", "ts"])
    assert len(got) == 24 and got[got.token_id == "x"]["best_bid"].eq(0.3).all()
    batch = live.parse_events(spark.createDataFrame([(x,) for x in raw], "value string")).where("kind = 'trade'")
    trades = batch.withColumn("traded_at", F.timestamp_seconds("ts")).withColumn("trade_id", F.monotonically_increasing_id())
    want = features.live_window(trades).toPandas().sort_values(["token_id", "ts"])
    for a, b in (("momentum_1h", "live_momentum_1h"), ("whale_ratio", "live_whale_ratio")):
        for x, y in zip(got[a], want[b]):
            assert (pd.isna(x) and pd.isna(y)) or math.isclose(x, y, rel_tol=1e-9)


def test_paper_trader_opens_and_takes_profit():
    t = live.PaperTrader(live.Profile("p", whale=None))
    assert [x[3] for x in t.on("trade", "a", 0.0, 0.45, None, None)] == ["open"]
    assert [x[3] for x in t.on("trade", "a", 10.0, 0.60, None, None)] == ["take_profit"]
    assert t.on("trade", "a", 20.0, 0.45, None, None) == [] and t.cash > 10_000


def test_paper_streams_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frames = [{"event_type": "last_trade_price", "asset_id": "a", "market": "m", "price": str(p), "size": "10", "timestamp": str(1700000000 + i * 100)} for i, p in enumerate((0.3, 0.35, 0.5))]
    (tmp_path / "in" / "e.txt").write_text("\n".join(map(json.dumps, frames)))

    def ends(rows, name):
        q = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}_state")).start(str(tmp_path / name), format="parquet")
        ended = q.awaitTermination(60)
        q.stop()
        return ended

    assert ends(live.live_features(live.parse_events(spark.readStream.text(str(tmp_path / "in"))), expire=False), "features")
    assert ends(live.paper_trade(spark.readStream.schema(live.FEATURES).parquet(str(tmp_path / "features")), [live.Profile("p", whale=None, low=0.2)]), "fills")
    fills = spark.read.parquet(str(tmp_path / "fills"))
    assert [r["action"] for r in fills.orderBy("ts").collect()] == ["open", "take_profit"]
    best = live.leaderboard(fills).first()
    assert best["closed"] == 1 and best["total_pnl"] > 0


def test_positions_close_on_resolution(spark, tmp_path):
    (tmp_path / "in").mkdir()
    frames = [{"event_type": "last_trade_price", "asset_id": t, "market": m, "price": "0.45", "size": "10", "timestamp": str(1700000000 + i)} for i, (t, m) in enumerate((("a", "m"), ("b", "m"), ("c", "other")))]
    frames.append({"event_type": "market_resolved", "market": "m", "winning_asset_id": "b", "timestamp": "1700000100"})
    (tmp_path / "in" / "e.txt").write_text("\n".join(map(json.dumps, frames)))

    def run(rows, name):
        q = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}_state")).start(str(tmp_path / name), format="parquet")
        assert q.awaitTermination(60)

    run(live.live_features(live.parse_events(spark.readStream.text(str(tmp_path / "in"))), expire=False), "features")
    run(live.paper_trade(spark.readStream.schema(live.FEATURES).parquet(str(tmp_path / "features")), [live.Profile("p", whale=None)]), "fills")
    fills = spark.read.parquet(str(tmp_path / "fills")).where("action <> 'open'").orderBy("token_id").collect()
    assert [(r["token_id"], r["action"], r["price"]) for r in fills] == [("a", "resolved", 0.0), ("b", "resolved", 1.0)]
    assert fills[0]["pnl"] < 0 < fills[1]["pnl"]
    assert not any(x in p.name for p in live.PROFILES for x in ("rsi", "drift", "confluence"))
