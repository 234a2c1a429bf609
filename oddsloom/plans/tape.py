"""A trade tape and its markets, projected from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: one row an event; the user is the token, its remainder by 50 the market."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    price, size = F.col("value") / 500.0, 1 + F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_id").alias("trade_id"), F.col("user_id").alias("token_id"), (F.col("user_id") % 50).alias("condition_id"), F.col("ts").cast("timestamp").alias("traded_at"),
        price.alias("price"), size.alias("size"), (price * size).alias("notional"), F.when(F.col("event_type").isin("purchase", "signup", "view"), "BUY").otherwise("SELL").alias("side"),
    )


def markets(trades: DataFrame) -> DataFrame:
    """Four markets in five are resolved; the least token wins, a day after the last trade."""
    return trades.groupBy("condition_id").agg(F.min("token_id").alias("winning_token_id"), (F.max("traded_at") + F.expr("interval 1 day")).alias("resolved_at")).withColumn("resolved", F.col("condition_id") % 5 != 0)


TAPE_SQL = """
tape AS (SELECT event_id AS trade_id, user_id AS token_id, user_id % 50 AS condition_id, ts AS traded_at, value / 500.0 AS price,
  1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, value / 500.0 * (1 + CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS notional,
  CASE WHEN event_type IN ('purchase', 'signup', 'view') THEN 'BUY' ELSE 'SELL' END AS side FROM events),
markets AS (SELECT condition_id, min(token_id) AS winning_token_id, max(traded_at) + INTERVAL 1 DAY AS resolved_at, condition_id % 5 <> 0 AS resolved FROM tape GROUP BY 1),
resolved AS (SELECT t.*, token_id = winning_token_id AS token_won, resolved_at FROM tape t JOIN markets m USING (condition_id) WHERE resolved)
"""

_WINDOWS = {"1h": 3_600_000_000, "6h": 21_600_000_000, "24h": 86_400_000_000}


def rolling_sql() -> str:
    cols, wins = [], []
    for n, p in _WINDOWS.items():
        wins.append(f"w{n} AS (PARTITION BY token_id ORDER BY us RANGE BETWEEN {p - 1} PRECEDING AND CURRENT ROW)")
        first, last = f"arg_min(price, us::HUGEINT * 1000000 + trade_id) OVER w{n}", f"arg_max(price, us::HUGEINT * 1000000 + trade_id) OVER w{n}"
        cols += [
            f"{last} - {first} AS price_delta_{n}",
            f"({last} - {first}) / greatest(((max(us) OVER w{n} - min(us) OVER w{n}) // 1000000) / 3600.0, 1e-6) AS momentum_{n}",
            f"stddev_samp(price) OVER w{n} AS volatility_{n}", f"sum(notional) OVER w{n} AS volume_{n}", f"avg(size) OVER w{n} AS size_mean_{n}", f"median(size) OVER w{n} AS size_median_{n}",
        ]
    return f"""
rolled AS (SELECT *, {', '.join(cols)} FROM (SELECT *, epoch_us(traded_at) AS us FROM resolved) WINDOW {', '.join(wins)}),
feat AS (SELECT *, CASE WHEN volume_24h > 0 THEN 24 * volume_1h / volume_24h END AS volume_spike_1h_24h,
  CASE WHEN size_median_24h > 0 THEN size_mean_1h / size_median_24h END AS whale_ratio, {bucket_sql('price')} AS price_bucket,
  ((epoch_us(resolved_at) - us) // 1000000) / 3600.0 AS time_to_resolution_hours FROM rolled),
features AS (SELECT *, price_delta_1h / sqrt(greatest(time_to_resolution_hours, 0) + 0.1) AS decay_adjusted_velocity, coalesce(price_delta_1h < 0 AND whale_ratio > 3, false) AS price_volume_divergence FROM feat)
"""


def bucket_sql(column: str) -> str:
    from ..functions.expressions import PRICE_BREAKS, PRICE_LABELS

    return "CASE " + " ".join(f"WHEN {column} < {b} THEN '{label}'" for b, label in zip(PRICE_BREAKS, PRICE_LABELS)) + f" ELSE '{PRICE_LABELS[-1]}' END"
