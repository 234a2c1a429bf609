"""Queries by name, and their SQL.

Floating results are rounded to six places on both sides, with NUDGE added: sums of a few decimals lie on the edge
between two roundings, where the engines' last bits would decide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import books, edges, features, lifecycle, research
from .tape import TAPE_SQL, bucket_sql, markets, rolling_sql, tape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


NUDGE = 3e-9


def query(name: str, sql: str | None = None, base: str = "tape"):
    def register(f):
        QUERIES[name] = f
        if sql:
            head = {"tape": f"WITH {TAPE_SQL}", "features": f"WITH {TAPE_SQL}, {rolling_sql()}", "": ""}[base]
            ORACLE_SQL[name] = head + ("," if sql.lstrip().startswith("+") else "") + sql.lstrip().removeprefix("+")
            ORACLE_SQL[name] = ORACLE_SQL[name].replace(", 6)", f" + {NUDGE}::DOUBLE, 6)").replace(", 4)", f" + {NUDGE}::DOUBLE, 4)")
        return f

    return register


def r6(*columns: str) -> list[Column]:
    return [F.round(F.col(c) + NUDGE, 6).alias(c) for c in columns]


def r6_sql(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def resolved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = tape(spark, sf)
    m = markets(t)
    return features.resolved_trades(t, m).drop("winning_token_id", "resolved_at"), m


def featured(spark: SparkSession, sf: str) -> DataFrame:
    t, m = resolved(spark, sf)
    return features.trade_features(t, m)


ROLLED = [f"{c}_{w}" for w in ("1h", "6h", "24h") for c in ("price_delta", "momentum", "volatility", "volume", "size_mean", "size_median")]
GRID = edges.grid(spikes=(None, 1.5), whales=(None, 2.0), ttrs=(None, 48.0), momentum_1h=("any", "pos", "neg"))


def grid_sql() -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return "+ grid(label, b, spike, whale, ttr, m1) AS (VALUES " + ", ".join(f"({q(s.label())}, {q(s.price_bucket)}, {q(s.spike)}, {q(s.whale)}, {q(s.ttr)}, {q(s.momentum_1h)})" for s in GRID) + """),
g AS (SELECT label, f.* FROM features f JOIN grid ON price_bucket = b AND (spike IS NULL OR volume_spike_1h_24h > spike) AND (whale IS NULL OR whale_ratio > whale)
  AND (ttr IS NULL OR time_to_resolution_hours < ttr) AND (m1 = 'any' OR m1 = 'pos' AND momentum_1h > 0 OR m1 = 'neg' AND momentum_1h < 0) AND side = 'BUY')"""


EDGE_SQL = "count(*) AS n, round(avg(token_won::INT), 6) AS empirical, round(avg(price), 6) AS implied, round(100 * (avg(token_won::INT) - avg(price)), 6) AS ev_pct"


@query("w01_rolling_features", f"SELECT trade_id, {r6_sql(*ROLLED)} FROM features", "features")
def w01(spark, sf):
    return features.rolling_features(resolved(spark, sf)[0]).select("trade_id", *r6(*ROLLED))


@query("w01_rolling_sliced", f"SELECT trade_id, {r6_sql(*ROLLED)} FROM features", "features")
def w01s(spark, sf):
    """The same by slices of two days."""
    return features.rolling_features(resolved(spark, sf)[0], slice_hours=48).select("trade_id", *r6(*ROLLED))


@query("w03_trade_features", f"SELECT trade_id, price_bucket, price_volume_divergence, {r6_sql('volume_spike_1h_24h', 'whale_ratio', 'time_to_resolution_hours', 'decay_adjusted_velocity')} FROM features", "features")
def w03(spark, sf):
    return featured(spark, sf).select("trade_id", "price_bucket", "price_volume_divergence", *r6("volume_spike_1h_24h", "whale_ratio", "time_to_resolution_hours", "decay_adjusted_velocity"))


@query("j01_resolved_trades", "SELECT trade_id, token_id, condition_id, token_won FROM resolved")
def j01(spark, sf):
    return resolved(spark, sf)[0].select("trade_id", "token_id", "condition_id", "token_won")


@query("j03_time_to_resolution", "SELECT trade_id, round(((epoch_us(resolved_at) - epoch_us(traded_at)) // 1000000) / 3600.0, 6) AS hours FROM tape JOIN markets USING (condition_id)")
def j03(spark, sf):
    t = tape(spark, sf)
    return features.time_to_resolution(t, markets(t)).select("trade_id", F.round(F.col("time_to_resolution_hours") + NUDGE, 6).alias("hours"))


@query("p09_price_buckets", f"SELECT {bucket_sql('price')} AS price_bucket, count(*) AS n FROM tape GROUP BY 1")
def p09(spark, sf):
    return tape(spark, sf).groupBy(X.price_bucket(F.col("price")).alias("price_bucket")).agg(F.count("*").alias("n"))


@query("a01_edge_by_bucket", f"SELECT {bucket_sql('price')} AS price_bucket, {EDGE_SQL} FROM resolved GROUP BY 1")
def a01(spark, sf):
    return resolved(spark, sf)[0].groupBy(X.price_bucket(F.col("price")).alias("price_bucket")).agg(*edges.edge_columns()).select("price_bucket", "n", *r6("empirical", "implied", "ev_pct"))


@query("a02_edge_grid", grid_sql() + f" SELECT label, {EDGE_SQL} FROM g GROUP BY 1 HAVING count(*) >= 5", "features")
def a02(spark, sf):
    return edges.find_edges(featured(spark, sf), GRID).select("label", "n", *r6("empirical", "implied", "ev_pct"))


@query("o03_top_edges", grid_sql() + f" SELECT label, {EDGE_SQL} FROM g GROUP BY 1 HAVING count(*) >= 20 ORDER BY 100 * (avg(token_won::INT) - avg(price)) DESC, n DESC, label LIMIT 10", "features")
def o03(spark, sf):
    return edges.find_edges(featured(spark, sf), GRID, min_samples=20).limit(10).select("label", "n", *r6("empirical", "implied", "ev_pct"))


SPLIT = "2024-01-15"


@query("x14_oos_edges", grid_sql() + f""", o AS (SELECT label, count(*) FILTER (traded_at < '{SPLIT}') AS train_n, count(*) FILTER (traded_at >= '{SPLIT}') AS test_n,
  100 * (avg(token_won::INT) FILTER (traded_at < '{SPLIT}') - avg(price) FILTER (traded_at < '{SPLIT}')) AS train_ev,
  coalesce(100 * (avg(token_won::INT) FILTER (traded_at >= '{SPLIT}') - avg(price) FILTER (traded_at >= '{SPLIT}')), 0) AS test_ev FROM g GROUP BY 1)
  SELECT label, train_n, test_n, round(train_ev, 6) AS train_ev_pct, round(test_ev, 6) AS test_ev_pct, round(train_ev - test_ev, 6) AS ev_decay, test_n >= 20 AND test_ev > 0 AS persists
  FROM o WHERE train_n >= 20 ORDER BY train_ev DESC, train_n DESC, label LIMIT 20""", "features")  # fmt: skip
def x14(spark, sf):
    return edges.oos_edges(featured(spark, sf), SPLIT, GRID).select("label", "train_n", "test_n", *r6("train_ev_pct", "test_ev_pct", "ev_decay"), "persists")


@query("a03_simulate_grid", grid_sql() + """, p AS (SELECT *, token_won::INT - price AS pnl, (token_won::INT - price) / greatest(price, 1e-12) AS roi FROM g),
  e AS (SELECT *, sum(pnl) OVER (PARTITION BY label ORDER BY traded_at, trade_id ROWS UNBOUNDED PRECEDING) AS equity FROM p),
  d AS (SELECT *, max(equity) OVER (PARTITION BY label ORDER BY traded_at, trade_id ROWS UNBOUNDED PRECEDING) - equity AS fall FROM e)
  SELECT label, count(*) AS n, round(avg(token_won::INT), 6) AS win_rate, round(sum(pnl), 6) AS total_pnl, round(avg(pnl), 6) AS mean_pnl,
  round(CASE WHEN count(*) < 2 OR stddev_samp(roi) <= 1e-15 THEN 0 ELSE avg(roi) / stddev_samp(roi) * sqrt(count(*)) END, 6) AS sharpe, round(max(fall), 6) AS max_drawdown FROM d GROUP BY 1""", "features")  # fmt: skip
def a03(spark, sf):
    return edges.simulate(featured(spark, sf), GRID).select("label", "n", *r6("win_rate", "total_pnl", "mean_pnl", "sharpe", "max_drawdown"))


@query("w08_equity_curve", """+ p AS (SELECT trade_id, traded_at, token_won::INT - price AS pnl FROM resolved),
  e AS (SELECT *, sum(pnl) OVER o AS equity FROM p WINDOW o AS (ORDER BY traded_at, trade_id ROWS UNBOUNDED PRECEDING))
  SELECT trade_id, round(equity, 6) AS equity, round(max(equity) OVER (ORDER BY traded_at, trade_id ROWS UNBOUNDED PRECEDING), 6) AS peak FROM e""")  # fmt: skip
def w08(spark, sf):
    return edges.equity_curve(edges.with_pnl(resolved(spark, sf)[0])).select("trade_id", *r6("equity", "peak"))


@query("m26_fee_aware_pnl", """SELECT trade_id, round(fill, 6) AS fill_price, round(round(0.07::DOUBLE * fill * (1 - fill),6), 6) AS fee, round(token_won::INT - fill - round(0.07::DOUBLE * fill * (1 - fill),6), 6) AS pnl
  FROM (SELECT trade_id, token_won, least(greatest(price * 1.005::DOUBLE, 0.01), 0.99) AS fill FROM resolved)""")  # fmt: skip
def m26(spark, sf):
    return edges.with_pnl(resolved(spark, sf)[0], 50.0, "crypto").select("trade_id", *r6("fill_price", "fee", "pnl"))


def repeated(spark, sf) -> DataFrame:
    t = tape(spark, sf)
    return t.unionByName(t.where("trade_id % 7 = 0")).unionByName(t.where("trade_id % 91 = 0").withColumn("size", F.col("size") + 1))


REPEATED_SQL = "+ rep AS (SELECT * FROM tape UNION ALL SELECT * FROM tape WHERE trade_id % 7 = 0 UNION ALL SELECT * REPLACE (size + 1 AS size) FROM tape WHERE trade_id % 91 = 0), keyed AS (SELECT *, concat_ws('|', trade_id, token_id, size::BIGINT, epoch_us(traded_at), side) AS k FROM rep) "


def repeated_key() -> Column:
    return X.fill_key(F.col("trade_id"), F.col("token_id"), F.col("size").cast("bigint"), features.micros(F.col("traded_at")), F.col("side"))


@query("a07_duplicate_audit", REPEATED_SQL + "SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_ids, count(*) FILTER (n > 1 AND d = 1) AS exact_ids, count(*) FILTER (n > 1 AND d > 1) AS divergent_ids, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_involved FROM (SELECT trade_id, count(*) AS n, count(DISTINCT k) AS d FROM keyed GROUP BY 1)")
def a07(spark, sf):
    return research.audit_duplicates(repeated(spark, sf), repeated_key())


@query("a08_canonical_fills", REPEATED_SQL + "SELECT DISTINCT trade_id, substr(sha256(k), 1, 32) AS fill_id FROM keyed")
def a08(spark, sf):
    return research.canonical_fills(repeated(spark, sf), repeated_key()).select("trade_id", "fill_id")


@query("j07_next_print", """+ h AS (SELECT s.trade_id, arg_min(p.price, epoch_us(p.traded_at)::HUGEINT * 1000000 + p.trade_id) AS price FROM tape s JOIN tape p ON s.token_id = p.token_id
  AND epoch_us(p.traded_at) > epoch_us(s.traded_at) + 1000000 AND epoch_us(p.traded_at) <= epoch_us(s.traded_at) + 3601000000 GROUP BY 1)
  SELECT tape.trade_id, round(h.price, 6) AS print_price FROM tape LEFT JOIN h USING (trade_id)""")  # fmt: skip
def j07(spark, sf):
    t = tape(spark, sf)
    return research.next_prints(t, t, 1.0, 3600.0).select("trade_id", *r6("print_price"))


@query("x08_outcome_fills", """+ h AS (SELECT s.trade_id, arg_min(p.price, epoch_us(p.traded_at)::HUGEINT * 1000000 + p.trade_id) AS pp FROM tape s JOIN tape p ON s.token_id = p.token_id
  AND epoch_us(p.traded_at) > epoch_us(s.traded_at) + 1000000 AND epoch_us(p.traded_at) <= epoch_us(s.traded_at) + 86401000000 GROUP BY 1)
  SELECT t.trade_id, round(least(greatest(CASE WHEN side = 'BUY' THEN greatest(price, pp) * 1.005::DOUBLE ELSE least(price, pp) * 0.995::DOUBLE END, 0.01), 0.99), 6) AS fill_price, CASE WHEN pp IS NULL THEN 'no_print_within_timeout' END AS reject
  FROM (SELECT tape.*, pp FROM tape JOIN h USING (trade_id) UNION ALL SELECT tape.*, NULL FROM tape WHERE trade_id NOT IN (SELECT trade_id FROM h)) t""")  # fmt: skip
def x08(spark, sf):
    t = tape(spark, sf)
    df = research.outcome_fills(t, t, 1.0, 86400.0, 50.0, "crypto")
    return df.select("trade_id", F.when(F.col("reject").isNotNull(), F.when(F.upper("side") == "BUY", X.clip_price(F.col("price") * 1.005)).otherwise(X.clip_price(F.col("price") * 0.995))).otherwise(F.col("fill_price")).alias("fill_price"), "reject").select("trade_id", *r6("fill_price"), "reject")


@query("f06_purged_test", f"SELECT trade_id FROM tape WHERE traded_at >= '{SPLIT}' AND trade_id // 3 NOT IN (SELECT trade_id // 3 FROM tape WHERE traded_at < '2024-01-04')")
def f06(spark, sf):
    """Events of three trades each: those with a trade before the test's start are not in it."""
    t = tape(spark, sf).withColumn("event_id", F.floor(F.col("trade_id") / 3))
    return research.purge(edges.in_time(t, start=SPLIT), edges.in_time(t, end="2024-01-04"), "event_id").select("trade_id")


FOLDS = research.purged_folds("2024-01-01", "2024-03-31", 3, 3, 7, 2)


@query("a28_purged_folds", "+ f(fold, a, b, c, d) AS (VALUES " + ", ".join(f"({x['fold']}, TIMESTAMP '{x['train_start']}', TIMESTAMP '{x['train_end']}', TIMESTAMP '{x['test_start']}', TIMESTAMP '{x['test_end']}')" for x in FOLDS) + """),
  tr AS (SELECT fold, trade_id, token_id FROM tape JOIN f ON traded_at >= a AND traded_at < b), te AS (SELECT fold, trade_id, token_id FROM tape JOIN f ON traded_at >= c AND traded_at < d)
  SELECT fold, 'train' AS role, count(*) AS n FROM tr GROUP BY 1 UNION ALL SELECT fold, 'test', count(*) FROM te WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.fold = te.fold AND tr.token_id = te.token_id) GROUP BY 1""")  # fmt: skip
def a28(spark, sf):
    return research.on_folds(tape(spark, sf), FOLDS, "token_id").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("a15_calibrator", "SELECT bin, count(price) AS n, count(price) FILTER (token_won) AS wins, round(avg(token_won::INT), 6) AS freq FROM range(10) b(bin) LEFT JOIN resolved ON least(floor(price * 10), 9) = bin GROUP BY 1")
def a15(spark, sf):
    return research.calibrator(resolved(spark, sf)[0]).select("bin", "n", "wins", *r6("freq"))


@query("a26_calibration_residuals", "+ b AS (SELECT *, least(floor(price * 10), 9) AS bin FROM resolved) SELECT trade_id, round(token_won::INT - avg(token_won::INT) OVER (PARTITION BY bin), 6) AS residual FROM b")
def a26(spark, sf):
    return research.calibration_residuals(resolved(spark, sf)[0]).select("trade_id", *r6("residual"))


@query("a06_event_clustered", "SELECT condition_id, round(sum(token_won::INT - price), 6) AS pnl, count(*) AS n FROM resolved GROUP BY 1")
def a06(spark, sf):
    return research.by_event(edges.with_pnl(resolved(spark, sf)[0])).select("condition_id", *r6("pnl"), "n")


@query("a17_leave_five_out", "+ e AS (SELECT condition_id, sum(token_won::INT - price) AS pnl FROM resolved GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY pnl DESC, condition_id) AS rn FROM e) SELECT count(*) AS n, round(CASE WHEN count(*) > 5 THEN avg(pnl) FILTER (rn > 5) END, 6) AS mean_without FROM k")
def a17(spark, sf):
    return research.leave_largest_out(research.by_event(edges.with_pnl(resolved(spark, sf)[0]))).select("n", *r6("mean_without"))


@query("a20_bh_fdr", "+ p AS (SELECT trade_id, price * price * price AS p FROM tape), r AS (SELECT *, count(*) OVER (ORDER BY p) AS rk, count(*) OVER () AS m FROM p), c AS (SELECT max(p) AS cut FROM r WHERE p <= rk / m * 0.2) SELECT trade_id, coalesce(p <= cut, false) AS discovery FROM p, c")
def a20(spark, sf):
    p = tape(spark, sf).select("trade_id", (F.col("price") * F.col("price") * F.col("price")).alias("p"))
    return research.benjamini_hochberg(p, alpha=0.2).select("trade_id", "discovery")


LOGIT_SQL = "ln(least(greatest(price, 0.005), 0.995) / (1 - least(greatest(price, 0.005), 0.995)))"


@query("w04_logit", f"+ l AS (SELECT *, {LOGIT_SQL} AS x FROM tape) SELECT trade_id, round(x, 6) AS logit_price, round(x - lag(x) OVER (PARTITION BY token_id ORDER BY traded_at, trade_id), 6) AS delta_logit_1bar FROM l")
def w04(spark, sf):
    return features.logit_columns(tape(spark, sf)).select("trade_id", *r6("logit_price", "delta_logit_1bar"))


@query("w18_logit_rsi", f"""+ l AS (SELECT *, {LOGIT_SQL} AS x FROM tape), d AS (SELECT *, x - lag(x) OVER o AS d, row_number() OVER o AS i FROM l WINDOW o AS (PARTITION BY token_id ORDER BY traded_at, trade_id)),
  s AS (SELECT trade_id, i, sum(greatest(coalesce(d, 0), 0)) OVER f / 14 AS gain, sum(greatest(-coalesce(d, 0), 0)) OVER f / 14 AS loss FROM d WINDOW f AS (PARTITION BY token_id ORDER BY traded_at, trade_id ROWS 13 PRECEDING))
  SELECT trade_id, round(CASE WHEN i > 14 THEN CASE WHEN loss <= 1e-12 THEN CASE WHEN gain <= 1e-12 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + gain / loss) END END, 6) AS rsi FROM s""")  # fmt: skip
def w18(spark, sf):
    t = tape(spark, sf)
    return features.rsi(t, X.logit(F.col("price")), flat=50.0).select("trade_id", *r6("rsi"))


@query("w12_bollinger", "+ b AS (SELECT trade_id, count(*) OVER f AS n, avg(price) OVER f AS mid, stddev_pop(price) OVER f AS sd FROM tape WINDOW f AS (PARTITION BY token_id ORDER BY traded_at, trade_id ROWS 19 PRECEDING)) SELECT trade_id, round(CASE WHEN n = 20 THEN mid END, 6) AS bb_mid, round(CASE WHEN n = 20 THEN mid - 2.5 * sd END, 6) AS bb_low, round(CASE WHEN n = 20 THEN mid + 2.5 * sd END, 6) AS bb_high FROM b")
def w12(spark, sf):
    return features.bollinger(tape(spark, sf), F.col("price")).select("trade_id", *r6("bb_mid", "bb_low", "bb_high"))


@query("w13_atr", "+ d AS (SELECT *, abs(price - lag(price) OVER (PARTITION BY token_id ORDER BY traded_at, trade_id)) AS tr FROM tape) SELECT trade_id, round(CASE WHEN count(tr) OVER f = 14 THEN avg(tr) OVER f END, 6) AS atr FROM d WINDOW f AS (PARTITION BY token_id ORDER BY traded_at, trade_id ROWS 13 PRECEDING)")
def w13(spark, sf):
    return features.atr(tape(spark, sf)).select("trade_id", *r6("atr"))


@query("w21_robust_bands", f"""+ l AS (SELECT trade_id, list_sort(list({LOGIT_SQL}) OVER (PARTITION BY token_id ORDER BY traded_at, trade_id ROWS 47 PRECEDING)) AS v FROM tape),
  u AS (SELECT trade_id, v[25] AS mid, unnest(v) AS x FROM l WHERE len(v) = 48), m AS (SELECT trade_id, any_value(mid) AS mid, list_sort(list(abs(x - mid)))[25] AS mad FROM u GROUP BY 1)
  SELECT trade_id, round(mid, 6) AS band_mid, round(mid - 2.5 * mad, 6) AS band_low, round(mid + 2.5 * mad, 6) AS band_high FROM tape LEFT JOIN m USING (trade_id)""")  # fmt: skip
def w21(spark, sf):
    return features.robust_bands(tape(spark, sf)).select("trade_id", *r6("band_mid", "band_low", "band_high"))


@query("w10_live_window", """+ u AS (SELECT *, epoch_us(traded_at) AS us, CASE WHEN size > 0 THEN size END AS s FROM tape)
  SELECT trade_id, round((arg_max(price, us::HUGEINT * 1000000 + trade_id) OVER h - arg_min(price, us::HUGEINT * 1000000 + trade_id) OVER h) / greatest((max(us) OVER h - min(us) OVER h) / 3600000000.0, 1e-6), 6) AS live_momentum_1h,
  round(avg(s) OVER h / median(s) OVER d, 6) AS live_whale_ratio, count(*) OVER h AS live_trades_1h FROM u
  WINDOW h AS (PARTITION BY token_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), d AS (PARTITION BY token_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def w10(spark, sf):
    return features.live_window(tape(spark, sf)).select("trade_id", *r6("live_momentum_1h", "live_whale_ratio"), "live_trades_1h")


@query("w25_forward_labels", """+ h(h) AS (VALUES (900), (3600), (14400)), j AS (SELECT e.trade_id, h AS horizon, epoch_us(m.traded_at) - epoch_us(e.traded_at) AS dt, m.price AS mid, m.price / e.price - 1 AS mv FROM tape e, h, tape m
  WHERE m.token_id = e.token_id AND m.traded_at > e.traded_at AND epoch_us(m.traded_at) <= epoch_us(e.traded_at) + h::BIGINT * 1000000)
  SELECT trade_id, horizon, round(arg_max(mid, dt), 6) AS exit_mid, round(arg_max(mv, dt), 6) AS mid_return, round(max(mv), 6) AS mfe, round(min(mv), 6) AS mae,
  round(min(dt / 1e6) FILTER (mv >= 0.05), 6) AS tp_seconds, round(min(dt / 1e6) FILTER (mv <= -0.03), 6) AS sl_seconds FROM j GROUP BY 1, 2""")  # fmt: skip
def w25(spark, sf):
    t = tape(spark, sf)
    return research.forward_labels(t, t, (900, 3600, 14400)).select("trade_id", "horizon", *r6("exit_mid", "mid_return", "mfe", "mae", "tp_seconds", "sl_seconds"))


def levels(spark, sf) -> DataFrame:
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("asset_id"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("size"), "l_linenumber")


@query("x01_walk_book", """WITH l AS (SELECT l_orderkey AS asset_id, (l_extendedprice / l_quantity)::DOUBLE AS price, l_quantity::DOUBLE AS size FROM lineitem),
  t AS (SELECT *, greatest(least(size, 60 - coalesce(sum(size) OVER (PARTITION BY asset_id ORDER BY price, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS take FROM l)
  SELECT asset_id, round(sum(take), 6) AS filled, round(sum(take * price) / nullif(sum(take), 0), 4) AS avg_price, count(*) FILTER (take > 0) AS levels_used, round(60 - sum(take), 6) AS residual FROM t GROUP BY 1""", "")  # fmt: skip
def x01(spark, sf):
    return books.walk_levels(levels(spark, sf), ("asset_id",), F.lit(60.0)).select("asset_id", *r6("filled"), F.round(F.col("avg_price") + NUDGE, 4).alias("avg_price"), "levels_used", *r6("residual"))


@query("l04_book_shape", """WITH l AS (SELECT l_orderkey AS asset_id, l_quantity::DOUBLE AS size, l_linenumber AS n FROM lineitem), s AS (SELECT asset_id, sum(size) AS t, arg_min(size, n * 1000 + size) AS first, max(size) AS top, count(*) AS c FROM l GROUP BY 1)
  SELECT asset_id, round(first / t, 6) AS concentration, round(e, 6) AS entropy, round(top * c / t, 6) AS wall FROM s JOIN (SELECT asset_id, sum(-(size / t) * ln(size / t)) AS e FROM l JOIN s USING (asset_id) GROUP BY 1) USING (asset_id)""", "")  # fmt: skip
def l04(spark, sf):
    by = levels(spark, sf).groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "size"))), lambda x: x["size"]).alias("sizes"))
    sizes = F.col("sizes")
    return by.select("asset_id", X.depth_concentration(sizes).alias("concentration"), X.depth_entropy(sizes).alias("entropy"), X.liquidity_wall(sizes).alias("wall")).select("asset_id", *r6("concentration", "entropy", "wall"))


@query("l12_order_flow", "SELECT trade_id, round((size - lag(size) OVER o) - (trade_id % 9 - lag(trade_id % 9) OVER o), 6) AS ofi FROM tape WINDOW o AS (PARTITION BY token_id ORDER BY traded_at, trade_id)")
def l12(spark, sf):
    """A trade's size stands for the bid's, its id's remainder by nine for the ask's."""
    w, ask = features.by_time(), (F.col("trade_id") % 9).cast("double")
    t = tape(spark, sf).withColumn("ask", ask)
    return t.select("trade_id", X.flow_delta(F.col("size"), F.col("ask"), F.lag("size").over(w), F.lag("ask").over(w)).alias("ofi")).select("trade_id", *r6("ofi"))


@query("t05_sequence_gaps", "SELECT trade_id, coalesce(trade_id - lag(trade_id) OVER (PARTITION BY token_id ORDER BY traded_at, trade_id) > 1, false) AS gap FROM tape")
def t05(spark, sf):
    m = tape(spark, sf).select("trade_id", F.col("token_id").alias("asset_id"), F.col("traded_at").alias("exchange_time"), F.col("trade_id").alias("seq"))
    return books.sequence_gaps(m).select("trade_id", "gap")


def t04(spark, sf):
    t = tape(spark, sf)
    first = F.row_number().over(features.by_time()) == 1
    level = lambda shift: F.array(F.struct((F.col("price") + shift).alias("price"), F.col("size").alias("size")))
    m = t.select(F.col("token_id").cast("string").alias("asset_id"), F.unix_micros("traded_at").cast("double").alias("exchange_time"), F.row_number().over(features.by_time()).cast("long").alias("seq"),
                 F.when(first, "snapshot").otherwise("delta").alias("event_type"), "side", (F.col("price") + F.when(F.col("side") == "BUY", 0.0).otherwise(1.0)).alias("price"), "size", F.when(first, level(0.0)).alias("bids"), F.when(first, level(1.0)).alias("asks"))
    return books.replay(m).select("asset_id", "seq", "uncertain", "crossed", *r6("best_bid", "best_ask", "mid", "bid_depth", "ask_depth"))


@query("a36_lake_summary", "+ d AS (SELECT *, traded_at < lag(traded_at) OVER (PARTITION BY token_id ORDER BY trade_id) AS inv FROM tape) SELECT count(*) AS n, count(DISTINCT condition_id) AS events, count(DISTINCT token_id) AS tokens, count(*) FILTER (inv) AS inversions, epoch_us(min(traded_at)) AS first_us, epoch_us(max(traded_at)) AS last_us FROM d")
def a36(spark, sf):
    inv = F.col("traded_at") < F.lag("traded_at").over(W.partitionBy("token_id").orderBy("trade_id"))
    us = features.micros(F.col("traded_at"))
    return tape(spark, sf).withColumn("inv", inv).agg(F.count("*").alias("n"), F.countDistinct("condition_id").alias("events"), F.countDistinct("token_id").alias("tokens"), F.count_if("inv").alias("inversions"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))


@query("a14_outcome_gate", f"""+ g AS (SELECT *, CASE WHEN trade_id % 40 > 0 THEN 'e' || (trade_id // 5) END AS event_id FROM resolved), s AS (SELECT event_id, bool_or(traded_at < '{SPLIT}') AS tr, bool_or(traded_at >= '{SPLIT}') AS te, count(*) FILTER (traded_at >= '{SPLIT}') AS late FROM g WHERE event_id IS NOT NULL GROUP BY 1),
  e AS (SELECT count(*) AS events, count(*) FILTER (tr) AS train_events, count(*) FILTER (te AND NOT tr) AS test_events, coalesce(sum(late) FILTER (te AND NOT tr), 0)::BIGINT AS test_rows FROM s)
  SELECT (SELECT count(*) FROM g) AS n, round((SELECT avg((event_id IS NOT NULL)::INT) FROM g), 6) AS event_share, events, train_events, test_events, test_rows, concat_ws(',', CASE WHEN (SELECT avg((event_id IS NOT NULL)::INT) FROM g) < 0.95 THEN 'event ids' END, CASE WHEN events < 100 THEN 'events' END, CASE WHEN train_events < 50 THEN 'train events' END, CASE WHEN test_events < 20 THEN 'test events' END, CASE WHEN test_rows = 0 THEN 'test rows' END) AS reasons FROM e""")  # fmt: skip
def a14(spark, sf):
    """Events of five trades, one in forty without; fees known."""
    n = F.col("trade_id")
    rows = resolved(spark, sf)[0].withColumns({"event_id": F.when(n % 40 > 0, F.concat(F.lit("e"), F.floor(n / 5))), "fee_confidence": F.lit("exact")})
    return research.gate(rows, SPLIT).select("n", *r6("event_share"), "events", "train_events", "test_events", "test_rows", "reasons")


@query("u01_upsert", "SELECT o_orderkey, max(total) AS total FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1.0 ELSE o_totalprice END::DOUBLE AS total FROM orders) GROUP BY 1", "")
def u01(spark, sf):
    from ..sources.lake import upsert

    old = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_totalprice").cast("double").alias("total"), F.lit(0).alias("seq"))
    new = old.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(-1.0).alias("total"), F.lit(1).alias("seq"))
    return upsert(old, new, ["o_orderkey"], "seq").select("o_orderkey", "total")


@query("p08_market_tokens", "SELECT 'c' || p_partkey AS condition_id, 't' || p_partkey AS token_id, 'Yes' AS outcome_label, 0 AS outcome_index FROM part UNION ALL SELECT 'c' || p_partkey, 'n' || p_partkey, 'No', 1 FROM part WHERE p_partkey % 4 <> 0", "")
def p08(spark, sf):
    from ..sources.normalize import market_tokens

    p = spark.read.parquet(f"{sf}/part.parquet")
    m = p.select(F.concat(F.lit("c"), "p_partkey").alias("condition_id"), F.concat(F.lit("t"), "p_partkey").alias("token_yes"), F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("n"), "p_partkey")).alias("token_no"))
    return market_tokens(m)


EXITS = lifecycle.Exits(take_profit=1.0, stop_loss=0.9, trailing=1.2, partial=1.5, max_hold_s=20 * 86_400.0, least_ttr_hours=None)


@query("x09_lifecycle", f"""+ t AS (SELECT *, epoch_us(traded_at) / 1e6 AS tick, first(price) OVER o AS entry, first(epoch_us(traded_at)) OVER o / 1e6 AS since FROM tape WINDOW o AS (PARTITION BY token_id ORDER BY traded_at, trade_id)),
  r AS (SELECT *, CASE WHEN entry > 0 THEN (price - entry) / entry ELSE 0 END AS ret FROM t),
  b AS (SELECT *, max(ret) OVER o AS best, min(ret) OVER o AS worst, count(*) FILTER (ret >= {EXITS.partial}) OVER o AS parts FROM r WINDOW o AS (PARTITION BY token_id ORDER BY traded_at, trade_id)),
  x AS (SELECT *, CASE WHEN ret >= {EXITS.take_profit} AND NOT (ret >= {EXITS.partial} AND parts = 1) THEN 'take_profit' WHEN best - ret >= {EXITS.trailing} THEN 'trailing' WHEN ret <= -{EXITS.stop_loss} THEN 'stop_loss'
    WHEN tick - since >= {EXITS.max_hold_s} THEN 'time_stop' END AS reason FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY reason IS NULL, CASE WHEN reason IS NULL THEN -epoch_us(traded_at) ELSE epoch_us(traded_at) END, CASE WHEN reason IS NULL THEN -trade_id ELSE trade_id END) AS rn FROM x)
  SELECT token_id, coalesce(reason, 'open') AS reason, round(CASE WHEN reason IS NOT NULL THEN price END, 6) AS exit_price, round(greatest(best, 0), 6) AS mfe, round(least(worst, 0), 6) AS mae, parts > 0 AS partial_taken, CASE WHEN parts > 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS remaining FROM k WHERE rn = 1""")  # fmt: skip
def x09(spark, sf):
    """A token's first trade opens a position, its trades mark it."""
    at = F.unix_micros("traded_at") / 1e6
    t = tape(spark, sf).select("token_id", "trade_id", "traded_at", at.alias("at"), F.col("price").alias("mark"), F.first("price").over(features.by_time()).alias("entry_price"), F.first(at).over(features.by_time()).alias("entry_time"))
    return lifecycle.exits(t, EXITS, "token_id", ("traded_at", "trade_id")).select("token_id", "reason", *r6("exit_price", "mfe", "mae"), "partial_taken", "remaining")


@query("x10_entry_gate", """+ s AS (SELECT *, coalesce(sum(price) OVER (PARTITION BY token_id ORDER BY traded_at, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gross,
    epoch_us(traded_at) / 1e6 - coalesce(lag(epoch_us(traded_at)) OVER (PARTITION BY token_id ORDER BY traded_at, trade_id) / 1e6, 0) AS waited FROM tape)
  SELECT trade_id, CASE WHEN waited < 60 THEN 'cooldown' WHEN price / 16.0 > 0.05 THEN 'max_position_pct' WHEN (gross + price) / 16.0 > 0.5 THEN 'max_gross_exposure' ELSE 'ok' END AS verdict FROM s""")  # fmt: skip
def x10(spark, sf):
    """Each trade as an entry on an account of its token that never sells."""
    at, w = F.unix_micros("traded_at") / 1e6, features.by_time()
    s = tape(spark, sf).withColumns({"equity": F.lit(16.0), "peak_equity": F.lit(16.0), "n_open": F.lit(0), "notional": F.col("price"), "event_exposure": F.lit(None).cast("double"), "now": at, "last_entry": F.coalesce(F.lag(at).over(w), F.lit(0.0)), "gross": F.coalesce(F.sum("price").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))})
    return s.select("trade_id", lifecycle.entry_gate(s).alias("verdict"))


def load() -> None:
    """Registers the queries of the other modules, which use this one."""
    from . import measures, outcomes  # noqa: F401


load()
