"""Raw trades and markets to the fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import schemas


def rename(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Aliases to their names; a name that is there wins, else the first alias that is."""
    found = {}
    for name, others in aliases.items():
        if name not in df.columns and (hit := next((o for o in others if o in df.columns and o not in found), None)):
            found[hit] = name
    return df.withColumnsRenamed(found)


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """Adds the schema's missing columns as nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in schemas.types(schema).items() if c not in df.columns})


def as_time(df: DataFrame, column: str):
    kind = dict(df.dtypes)[column]
    return F.col(column).cast("timestamp") if kind.startswith(("timestamp", "date")) else X.utc_timestamp(F.col(column))


def normalize_trades(df: DataFrame, source_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid trades, rejected rows). Valid: ids, price in [0, 1], size over 0, a time, and side BUY or SELL. A missing id is a digest of the fill."""
    df = with_columns(rename(df, schemas.TRADE_ALIASES), schemas.TRADES)
    t = schemas.types(schemas.TRADES)
    df = df.withColumns({c: F.col(c).cast("string").try_cast(t[c]) for c in schemas.names(schemas.TRADES) if c not in ("traded_at", "ingest_at")} | {"traded_at": as_time(df, "traded_at"), "ingest_at": F.current_timestamp()})
    df = df.withColumns({"side": F.upper("side"), "source_file": F.coalesce(F.lit(source_file), "source_file") if source_file else F.col("source_file")})
    key = F.sha2(X.fill_key(*[F.col(c) for c in ("tx_hash", "token_id", "traded_at", "price", "size", "side")]), 256)
    df = df.withColumns({"trade_id": F.coalesce("trade_id", key), "notional": F.col("price") * F.col("size")})
    filled = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    valid = X.all_of([filled("condition_id"), filled("token_id"), F.col("price").between(0, 1), F.col("size") > 0, F.col("traded_at").isNotNull(), F.col("side").isin("BUY", "SELL")])
    valid = F.coalesce(valid, F.lit(False))
    rows = df.select(*schemas.names(schemas.TRADES))
    return rows.where(valid), rows.where(~valid)


def normalize_markets(df: DataFrame) -> DataFrame:
    """Markets with yes and no tokens, winner and times. The winner is given, or the outcome priced at 0.99 or more."""
    df = rename(df, schemas.MARKET_ALIASES)
    if "token_ids" in df.columns:
        ids = F.col("token_ids") if dict(df.dtypes)["token_ids"].startswith("array") else X.json_list(F.col("token_ids"))
        df = df.withColumns({c: F.coalesce(F.col(c), F.get(ids, F.lit(i))) if c in df.columns else F.get(ids, F.lit(i)) for i, c in enumerate(("token_yes", "token_no"))})
    won = X.winner_from_prices(F.col("outcome_prices")) if "outcome_prices" in df.columns else F.lit(None).cast("int")
    df = with_columns(df.withColumn("_won", won), schemas.MARKETS)
    t = schemas.types(schemas.MARKETS)
    times = ("resolved_at", "closed_at", "end_date")
    df = df.withColumns({c: F.col(c).cast("string").try_cast(t[c]) for c in t if t[c] != "timestamp"} | {c: as_time(df, c) for c in times} | {"ingest_at": F.current_timestamp()})
    label = F.coalesce("winning_outcome", F.when(F.col("_won") == 0, "Yes").when(F.col("_won") == 1, "No"))
    df = df.withColumn("winning_outcome", label)
    token = F.when(F.lower(label) == "yes", F.col("token_yes")).when(F.lower(label) == "no", F.col("token_no"))
    df = df.withColumn("winning_token_id", F.coalesce("winning_token_id", token))
    df = df.withColumn("resolved", F.coalesce("resolved", F.col("winning_token_id").isNotNull()))
    return df.where("condition_id is not null and condition_id <> ''").select(*schemas.names(schemas.MARKETS))


def market_tokens(markets: DataFrame) -> DataFrame:
    """(condition_id, token_id, outcome_label, outcome_index): yes and no tokens that are there."""
    pair = lambda c, label, i: F.struct(F.col(c).alias("token_id"), F.lit(label).alias("outcome_label"), F.lit(i).alias("outcome_index"))
    out = markets.select("condition_id", F.inline(F.array(pair("token_yes", "Yes", 0), pair("token_no", "No", 1))))
    return out.where("token_id is not null and token_id <> ''")
