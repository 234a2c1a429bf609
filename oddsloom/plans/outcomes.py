"""Queries over outcome research: canonical and merged trades, fees, walk-forward tests and their controls, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import edges, outcome, research
from . import operations
from .registry import FOLDS, GRID, featured, grid_sql, query, r6
from .tape import tape

# Walk-forward tests

FEW = [s for s in GRID if s.ttr is None and s.whale is None]
LABELS = ", ".join(f"'{s.label()}'" for s in FEW)
FOLD_SQL = "f(fold, a, b, c, d) AS (VALUES " + ", ".join(f"({x['fold']}, TIMESTAMP '{x['train_start']}', TIMESTAMP '{x['train_end']}', TIMESTAMP '{x['test_start']}', TIMESTAMP '{x['test_end']}')" for x in FOLDS) + ")"
FILL = lambda bps: f"least(greatest(price * {1 + bps / 10_000}::DOUBLE, 0.01), 0.99)"
SHARPE = lambda when: f"CASE WHEN count(*) FILTER ({when}) < 2 OR coalesce(stddev_samp(pnl) FILTER ({when}), 0) <= 1e-15 THEN 0 ELSE avg(pnl) FILTER ({when}) / stddev_samp(pnl) FILTER ({when}) * sqrt(count(*) FILTER ({when})) END"
WALK_SQL = grid_sql() + f""", {FOLD_SQL}, q AS (SELECT g.*, trade_id // 3 AS event_id FROM g WHERE label IN ({LABELS})), ev AS (SELECT *, trade_id // 3 AS event_id FROM features),
  tr AS (SELECT fold, event_id FROM ev JOIN f ON traded_at >= a AND traded_at < b GROUP BY 1, 2),
  w AS (SELECT label, fold, event_id, 'train' AS role, token_won, price FROM q JOIN f ON traded_at >= a AND traded_at < b UNION ALL SELECT label, f.fold, q.event_id, 'test', token_won, price FROM q JOIN f ON traded_at >= c AND traded_at < d WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.fold = f.fold AND tr.event_id = q.event_id)),
  p AS (SELECT *, token_won::INT - {FILL(50)} AS pnl FROM w),
  wf AS (SELECT label, fold, count(*) FILTER (role = 'test') AS n_test, {SHARPE("role = 'train'")} AS is_sharpe, {SHARPE("role = 'test'")} AS oos_sharpe, coalesce(100 * avg(pnl) FILTER (role = 'test'), 0) AS oos_ev_pct FROM p GROUP BY 1, 2)"""


def with_events(spark, sf) -> DataFrame:
    return featured(spark, sf).withColumn("event_id", F.floor(F.col("trade_id") / 3))


def walked(spark, sf) -> DataFrame:
    return outcome.walk_forward(with_events(spark, sf), FEW, FOLDS)


@query("a29_walk_forward", WALK_SQL + " SELECT label, fold, n_test, round(is_sharpe, 6) AS is_sharpe, round(oos_sharpe, 6) AS oos_sharpe, round(oos_ev_pct, 6) AS oos_ev_pct FROM wf", "features")
def walk_forward(spark, sf):
    return walked(spark, sf).select("label", "fold", "n_test", *r6("is_sharpe", "oos_sharpe", "oos_ev_pct"))


@query("a29_promoted", WALK_SQL + f" SELECT label, round(count(*) FILTER (oos_ev_pct > 0) / {len(FOLDS)}, 6) AS positive_folds, round(sum(oos_ev_pct) / {len(FOLDS)}, 6) AS mean_oos_ev FROM wf GROUP BY 1 HAVING count(*) FILTER (oos_ev_pct > 0) / {len(FOLDS)} >= 0.5", "features")
def promoted(spark, sf):
    return outcome.promoted(walked(spark, sf), len(FOLDS)).select("label", *r6("positive_folds", "mean_oos_ev"))


@query("a29_attempts", grid_sql() + " SELECT label, count(*) AS n_train, count(DISTINCT trade_id // 3) AS n_train_events, CASE WHEN count(*) >= 30 AND count(DISTINCT trade_id // 3) >= 5 THEN 'ok' ELSE 'insufficient_sample' END AS status FROM g GROUP BY 1", "features")
def attempts(spark, sf):
    return outcome.attempts(with_events(spark, sf), GRID)


@query("a30_candidate_ledger", grid_sql() + f" SELECT label, trade_id, round({FILL(50)}, 6) AS fill_price, round(token_won::INT - {FILL(50)}, 6) AS pnl FROM g WHERE label IN ({LABELS})", "features")
def candidate_ledger(spark, sf):
    return outcome.candidate_ledger(with_events(spark, sf), FEW, 50.0).select("label", "trade_id", *r6("fill_price", "pnl"))


@query("a29_slippage", grid_sql() + f" SELECT label, " + ", ".join(f"round(100 * avg(token_won::INT - {FILL(b)}), 6) AS ev_slip_{b}" for b in (0, 100, 200)) + " FROM g GROUP BY 1", "features")
def slippage(spark, sf):
    rows = edges.on_grid(featured(spark, sf), GRID)
    return rows.groupBy("label").agg(*[(100 * F.avg(outcome.won_less_fill(float(b)))).alias(f"ev_slip_{b}") for b in (0, 100, 200)]).select("label", *r6("ev_slip_0", "ev_slip_100", "ev_slip_200"))


@query("a19_pbo_folds", WALK_SQL + """, full_ AS (SELECT label FROM wf GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM f)), z AS (SELECT wf.* FROM wf JOIN full_ USING (label)), md AS (SELECT fold, list_sort(list(oos_sharpe))[len(list(oos_sharpe)) // 2 + 1] AS md FROM z GROUP BY 1),
  t AS (SELECT label, arg_max(md, is_sharpe * 1e6 - fold) AS md, list(oos_sharpe) AS o FROM z JOIN md USING (fold) GROUP BY 1) SELECT CASE WHEN count(*) >= 2 THEN round(avg((len(list_filter(o, lambda x: x < md)) / len(o) > 0.5)::INT), 6) END AS pbo, count(*) AS n_trials FROM t""", "features")  # fmt: skip
def pbo_folds(spark, sf):
    wf = walked(spark, sf)
    full = wf.groupBy("label").count().where(F.col("count") == len(FOLDS)).select("label")
    rows = wf.join(full, "label").select(F.col("label").alias("trial"), "fold", F.col("is_sharpe").alias("is_score"), F.col("oos_sharpe").alias("oos_score"))
    return research.pbo_of_folds(rows).select(*r6("pbo"), "n_trials")


def exact_mean(column: str) -> Column:
    """Mean of decimals of twelve places, which no order of rows changes; sums of doubles would decide the sign of a mean of exactly 0.1."""
    return F.avg(F.col(column).cast("decimal(28,12)")).cast("double")


@query("a24_neighbourhood", "+ s AS (SELECT token_id AS label, 0.1 - avg(price) AS score FROM tape WHERE token_id % 9 > 0 GROUP BY 1), p AS (SELECT DISTINCT token_id AS center, token_id + d AS neighbour FROM tape, (VALUES (1), (2), (-1)) x(d)) SELECT center, round(CASE WHEN any_value(c.score) <> 0 THEN avg(coalesce((n.score * c.score > 0)::INT, 0)) END, 6) AS stability FROM p LEFT JOIN s c ON c.label = center LEFT JOIN s n ON n.label = neighbour GROUP BY 1")
def neighbourhood(spark, sf):
    t = tape(spark, sf)
    scores = t.where("token_id % 9 > 0").groupBy(F.col("token_id").alias("label")).agg((0.1 - exact_mean("price")).alias("score"))
    pairs = t.select(F.col("token_id").alias("center")).distinct().select("center", F.explode(F.array(F.col("center") + 1, F.col("center") + 2, F.col("center") - 1)).alias("neighbour"))
    return research.neighbourhood_stability(scores, pairs).select("center", *r6("stability"))


@query("a25_multiple_testing", """+ s AS (SELECT token_id, avg(price) AS sharpe, avg(size) AS oos, min(price) AS p FROM tape GROUP BY 1), m AS (SELECT count(*) AS n, max(sharpe) AS best, list_sort(list(sharpe))[count(*) // 2 + 1] AS a, list_sort(list(oos))[count(*) // 2 + 1] AS b FROM s),
  r AS (SELECT p, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS rk FROM s), c AS (SELECT max(p) AS cut FROM r, m WHERE p <= rk / n * 0.05)
  SELECT n AS n_trials, round(best, 6) AS best_sharpe, round((SELECT avg((sharpe >= a AND oos < b)::INT) FROM s, m), 6) AS pbo, (SELECT count(*) FROM s, c WHERE p <= cut) AS n_discoveries FROM m""")  # fmt: skip
def multiple_testing(spark, sf):
    s = tape(spark, sf).groupBy(F.col("token_id").alias("label")).agg(F.avg("price").alias("sharpe"), F.avg("size").alias("oos_sharpe"), F.min("price").alias("p"))
    return research.multiple_testing(s).select("n_trials", *r6("best_sharpe", "pbo"), "n_discoveries")


# Canonical and merged lakes

DAYS = "(trade_id % 1000) * INTERVAL 1 DAY"
CATEGORY_SQL = "CASE trade_id % 4 WHEN 0 THEN ' Sports' WHEN 1 THEN 'politics' WHEN 2 THEN 'chess' END"


def categorised(spark, sf) -> DataFrame:
    n = F.col("trade_id")
    return tape(spark, sf).withColumns({"traded_at": F.col("traded_at") + F.expr("make_dt_interval(cast(trade_id % 1000 as int))"), "category": F.when(n % 4 == 0, " Sports").when(n % 4 == 1, "politics").when(n % 4 == 2, "chess")})


@query("p16_attached_fees", f"""+ t AS (SELECT trade_id, traded_at + {DAYS} AS moment, {CATEGORY_SQL} AS category FROM tape), k AS (SELECT *, moment::DATE <= DATE '2026-01-05' AS free, lower(trim(category)) AS c FROM t)
  SELECT trade_id, CASE WHEN free THEN 'zero_fee_historical' WHEN c IN ('sports', 'politics') THEN 'category_taker_fee' ELSE 'unknown_category_fallback' END AS fee_regime, CASE WHEN free THEN 'exact' WHEN c IN ('sports', 'politics') THEN 'strongly_evidenced' ELSE 'fallback' END AS fee_confidence,
  CASE WHEN free THEN 0 WHEN c = 'sports' THEN 0.05 WHEN c = 'politics' THEN 0.04 ELSE 0.07 END::DOUBLE AS fee_rate, CASE WHEN free THEN coalesce(c, 'unknown') WHEN c IN ('sports', 'politics') THEN c ELSE 'unknown:' || coalesce(c, 'crypto') END AS fee_category FROM k""")  # fmt: skip
def attached_fees(spark, sf):
    return outcome.with_fees(categorised(spark, sf)).select("trade_id", "fee_regime", "fee_confidence", "fee_rate", "fee_category")


@query("a35_fee_counts", f"+ t AS (SELECT (traded_at + {DAYS})::DATE <= DATE '2026-01-05' AS free, lower(trim({CATEGORY_SQL})) AS c FROM tape) SELECT CASE WHEN free THEN 'zero_fee_historical' WHEN c IN ('sports', 'politics') THEN 'category_taker_fee' ELSE 'unknown_category_fallback' END AS fee_regime, count(*) AS n FROM t GROUP BY 1")
def fee_counts(spark, sf):
    return outcome.fee_counts(outcome.with_fees(categorised(spark, sf)))


def raw_markets(spark, sf) -> DataFrame:
    """Markets of the tape as they are downloaded: token lists and final prices as text; every fifth isn't decided."""
    ids = tape(spark, sf).groupBy("condition_id").agg(F.min("token_id").alias("a"), F.max("token_id").alias("b"), F.max("traded_at").alias("last"))
    prices = F.when(F.col("condition_id") % 5 == 0, '["0.5", "0.5"]').when(F.col("condition_id") % 2 == 0, '["1", "0"]').otherwise('["0", "1"]')
    return ids.select("condition_id", F.concat(F.lit('["'), "a", F.lit('","'), "b", F.lit('"]')).alias("clob_token_ids"), prices.alias("outcome_prices"), F.concat(F.lit("e"), F.floor(F.col("condition_id") / 2)).alias("event_id"), (F.col("last") + F.expr("interval 1 day")).alias("end_date"))


RAW_SQL = """+ m0 AS (SELECT condition_id, min(token_id)::VARCHAR AS yes, max(token_id)::VARCHAR AS no_, 'e' || (condition_id // 2) AS event_id, max(traded_at) + INTERVAL 1 DAY AS end_date FROM tape GROUP BY 1),
  m1 AS (SELECT *, CASE WHEN condition_id % 5 = 0 THEN NULL WHEN condition_id % 2 = 0 THEN 'Yes' ELSE 'No' END AS winning_outcome FROM m0), m AS (SELECT *, CASE winning_outcome WHEN 'Yes' THEN yes WHEN 'No' THEN no_ END AS winning_token_id FROM m1)"""


@query("p13_enriched_markets", RAW_SQL + " SELECT condition_id, yes AS token_yes, no_ AS token_no, winning_outcome, winning_token_id, winning_token_id IS NOT NULL AS resolved, epoch_us(end_date) AS resolved_us FROM m")
def enriched(spark, sf):
    return outcome.enriched_markets(raw_markets(spark, sf)).select("condition_id", "token_yes", "token_no", "winning_outcome", "winning_token_id", "resolved", F.unix_micros(F.col("resolved_at").cast("timestamp")).alias("resolved_us"))


def doubled(spark, sf) -> DataFrame:
    t = tape(spark, sf).withColumn("token_id", F.col("token_id").cast("string"))
    return t.unionByName(t.where("trade_id % 7 = 0"))


@query("a12_canonical_trades", RAW_SQL + " SELECT t.trade_id, t.token_id::VARCHAR AS token_id, m.event_id, t.token_id::VARCHAR = m.winning_token_id AS token_won FROM tape t JOIN m USING (condition_id) WHERE m.winning_token_id IS NOT NULL")
def canonical_trades(spark, sf):
    return outcome.canonical(doubled(spark, sf), raw_markets(spark, sf))[0].select("trade_id", "token_id", "event_id", "token_won")


@query("a12_canonical_features", RAW_SQL + ", k AS (SELECT t.*, m.end_date, t.token_id::VARCHAR = m.winning_token_id AS won FROM tape t JOIN m USING (condition_id) WHERE m.winning_token_id IS NOT NULL) SELECT trade_id, won AS token_won, round(((epoch_us(end_date) - epoch_us(traded_at)) // 1000000) / 3600.0, 6) AS hours, round(sum(notional) OVER (PARTITION BY token_id ORDER BY epoch_us(traded_at) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 6) AS volume_1h FROM k")
def canonical_features(spark, sf):
    return outcome.canonical(doubled(spark, sf), raw_markets(spark, sf))[1].select("trade_id", "token_won", F.col("time_to_resolution_hours").alias("hours"), "volume_1h").select("trade_id", "token_won", *r6("hours", "volume_1h"))


def parts(spark, sf) -> tuple[DataFrame, list[DataFrame]]:
    t = doubled(spark, sf).withColumn("event_id", F.when(F.col("trade_id") % 3 == 0, "kept"))
    return t.where("trade_id % 2 = 0"), [t.where("trade_id % 2 = 1").drop("event_id"), t.where("trade_id % 4 = 0")]


@query("a13_merged_trades", RAW_SQL + " SELECT t.trade_id, CASE WHEN trade_id % 6 = 0 THEN 'kept' ELSE m.event_id END AS event_id, t.token_id::VARCHAR = m.winning_token_id AS token_won, 'zero_fee_historical' AS fee_regime FROM tape t LEFT JOIN m USING (condition_id)")
def merged_trades(spark, sf):
    base, years = parts(spark, sf)
    return outcome.merge_lakes(base, years, raw_markets(spark, sf))[0].select("trade_id", "event_id", "token_won", "fee_regime")


@query("a13_merged_coverage", RAW_SQL + ", j AS (SELECT t.*, CASE WHEN trade_id % 6 = 0 THEN 'kept' ELSE m.event_id END AS event_id FROM tape t LEFT JOIN m USING (condition_id)) SELECT count(*) AS n_trades, count(DISTINCT event_id) AS n_events, 1.0::DOUBLE AS event_share, count(DISTINCT condition_id) AS n_markets, count(*) AS n_free FROM j")
def merged_coverage(spark, sf):
    base, years = parts(spark, sf)
    return outcome.coverage(outcome.merge_lakes(base, years, raw_markets(spark, sf))[0]).select("n_trades", "n_events", *r6("event_share"), "n_markets", "n_free")


@query("j05_coalesce_join", "SELECT trade_id, CASE WHEN trade_id % 2 = 0 THEN price ELSE 0.5 END::DOUBLE AS price, condition_id % 7 AS extra FROM tape")
def coalesce_join(spark, sf):
    t = tape(spark, sf)
    base = t.select("trade_id", "condition_id", F.when(F.col("trade_id") % 2 == 0, F.col("price")).alias("price"))
    incoming = t.select("condition_id").distinct().select("condition_id", F.lit(0.5).alias("price"), (F.col("condition_id") % 7).alias("extra"))
    return outcome.coalesce_join(base, incoming, "condition_id").select("trade_id", "price", "extra")


@query("p12_sample_trades", "SELECT event_id || '_' || user_id AS trade_id, epoch_us(ts) // 1000000 AS s, round(value / 500.0 * 2, 6) AS notional, 'B' AS side FROM events", "")
def sample_trades(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    raw = e.select(F.col("event_id").cast("string").alias("transaction_hash"), F.col("user_id").alias("log_index"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("timestamp"), (F.col("value") / 500.0).alias("price"), F.lit(2.0).alias("token_amount"), F.lit("B").alias("taker_direction"), F.lit("w").alias("taker"))
    return outcome.sample_trades(raw).select("trade_id", F.unix_seconds("traded_at").alias("s"), *r6("notional"), "side")


@query("x27_coverage", "+ t AS (SELECT *, epoch_us(traded_at) / 1e6 AS moment FROM tape) SELECT round((max(moment) - min(moment)) / 86400, 6) AS calendar_days, count(DISTINCT token_id) AS emitting_tokens, count(DISTINCT condition_id) AS independent_events, round(avg((trade_id % 10 = 0)::INT), 6) AS gap_rate FROM t")
def collection_coverage(spark, sf):
    m = tape(spark, sf).select(F.col("token_id").alias("asset_id"), "condition_id", (F.unix_micros("traded_at") / 1e6).alias("exchange_time"), F.col("price").alias("mid"), F.lit(30.0).alias("ttr_hours"), (F.col("trade_id") % 10 == 0).alias("gap"))
    return operations.coverage(m).select(*r6("calendar_days"), "emitting_tokens", "independent_events", *r6("gap_rate"))


@query("b03_compact_day", "+ t AS (SELECT token_id::VARCHAR AS asset_id, trade_id AS seq, price FROM tape WHERE traded_at::DATE = DATE '2024-01-10') SELECT asset_id, seq, 's0' AS session_id, round(price, 6) AS price FROM t")
def compact_day(spark, sf):
    t = tape(spark, sf).select(F.col("token_id").cast("string").alias("asset_id"), (F.unix_micros("traded_at") / 1e6).alias("exchange_time"), F.col("trade_id").alias("seq"), F.lit("delta").alias("event_type"), "price")
    both = t.withColumn("session_id", F.lit("s1")).unionByName(t.withColumn("session_id", F.lit("s0")))
    return operations.compact_day(both, "2024-01-10").select("asset_id", "seq", "session_id", *r6("price"))
