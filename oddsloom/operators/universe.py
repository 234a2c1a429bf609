"""Tokens to collect: markets ranked by liquidity, with a rotation over strata of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X


def market_rows(markets: DataFrame, as_of: Column) -> DataFrame:
    """A row for each market with tokens: its first token, probability, hours to resolution, spread, volume, depth, and whether it is under eight days old or changed within a day."""
    has = set(markets.columns)

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.col(n).cast("string") for n in names if n in has], F.lit(None).cast("string"))

    tokens = X.json_list(pick("clobTokenIds", "clob_token_ids"))
    created, ends = X.utc_timestamp(pick("createdAt", "created_at")), X.utc_timestamp(pick("endDate", "end_date", "resolutionDate"))
    number = lambda *n: pick(*n).try_cast("double")
    out = markets.select(
        F.get(tokens, F.lit(0)).alias("token_id"), tokens.alias("all_token_ids"), pick("conditionId", "condition_id").alias("condition_id"), pick("eventId", "event_id", "id").alias("event_id"), F.coalesce(pick("category", "groupItemTitle"), F.lit("other")).alias("category"),
        number("lastTradePrice", "bestBid", "bestAsk").alias("probability"), F.greatest(F.lit(0.0), (F.unix_micros(ends) - F.unix_micros(as_of)) / 3.6e9).alias("ttr_hours"), number("spread").alias("spread"), number("volume", "volumeNum", "volume24hr").alias("volume"), number("liquidity", "liquidityNum").alias("depth"),
        (F.floor((F.unix_micros(as_of) - F.unix_micros(created)) / 8.64e10) <= 7).alias("recently_created"), pick("oneDayPriceChange", "one_day_price_change").isNotNull().alias("changed"),
    )
    return out.where("token_id is not null")


def liquid_order() -> list[Column]:
    """Most volume, then most depth, then the least spread; the token decides between equals."""
    return [F.desc(F.coalesce("volume", F.lit(0.0))), F.desc(F.coalesce("depth", F.lit(0.0))), F.asc(F.coalesce("spread", F.lit(1.0))), F.asc("token_id")]


def stratum() -> Column:
    known = lambda c: F.col(c).isNotNull().cast("string")
    label = lambda c: F.coalesce(c, F.lit("unknown"))
    return F.concat_ws("|", label(X.prob_bucket(F.col("probability"))), label(X.ttr_bucket(F.col("ttr_hours"))), "category", known("spread"), known("volume"), known("depth"), label(F.col("recently_created").cast("string")), F.col("changed").cast("string"))


def token_universe(rows: DataFrame, n_core: int = 60, n_rotate: int = 40, seed: str = "0") -> DataFrame:
    """(token_id, role, place): the n_core most liquid tokens, and n_rotate of the others in turns of one a stratum.

    Within a stratum and among strata the order is that of a digest of seed and name, so a seed always gives the same
    tokens. rows: market_rows; a token counts once, by its most liquid row.
    """
    best = rows.withColumn("_n", F.row_number().over(W.partitionBy("token_id").orderBy(*liquid_order()))).where("_n = 1").drop("_n")
    core = best.orderBy(*liquid_order()).limit(n_core)
    core = core.select("token_id", F.lit("core").alias("role"), F.row_number().over(W.orderBy(*liquid_order())).alias("place"))  # n_core rows
    rest = best.join(F.broadcast(core.select("token_id")), "token_id", "left_anti").withColumn("_stratum", stratum())
    digest = lambda c: F.sha2(F.concat_ws("|", F.lit(seed), c), 256)
    turns = rest.withColumn("_turn", F.row_number().over(W.partitionBy("_stratum").orderBy(digest(F.col("token_id")))))
    order = ["_turn", digest(F.col("_stratum")), "token_id"]
    rotate = turns.where(F.col("_turn") <= n_rotate).withColumns({"_d": order[1]}).orderBy("_turn", "_d", "token_id").limit(n_rotate)
    return core.unionByName(rotate.select("token_id", F.lit("rotate").alias("role"), F.row_number().over(W.orderBy("_turn", "_d", "token_id")).alias("place")))


def subscribed(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """Market rows that have one of some tokens (token_id), with those that they have."""
    each = rows.withColumn("_t", F.explode("all_token_ids")).join(tokens.select(F.col("token_id").alias("_t")).distinct(), "_t")
    found = each.groupBy("condition_id").agg(F.array_sort(F.collect_set("_t")).alias("subscribed_token_ids"))
    return rows.join(found, "condition_id")
