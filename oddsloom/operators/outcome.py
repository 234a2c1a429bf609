"""Outcome research: canonical trades with their markets, merged lakes, and walk-forward sweeps over strategy grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import edges, features, research

#: Columns of a market that trades take over.
MARKET_COLUMNS = ("condition_id", "event_id", "event_slug", "winning_token_id", "winning_outcome", "resolved", "resolved_at", "end_date", "closed_at", "closed_time", "volume", "question", "slug", "neg_risk", "token_yes", "token_no", "category")
CLOSES = ("resolved_at", "closed_at", "end_date")
#: Names in downloaded samples, by the lake's.
SAMPLE_NAMES = {"tx_hash": ("transaction_hash", "transactionHash"), "token_id": ("asset_id", "asset"), "size": ("token_amount", "amount"), "condition_id": ("conditionId",)}


def sample_trades(raw: DataFrame) -> DataFrame:
    """Trades of a downloaded sample under the lake's names: time from epoch seconds, an id from the log's place or the fill, notional, side and wallet of the taker."""
    out = raw
    for name, others in SAMPLE_NAMES.items():
        found = next((c for c in others if c in out.columns), None)
        if name not in out.columns and found:
            out = out.withColumnRenamed(found, name)
    has = set(out.columns)
    add: dict[str, Column] = {}
    if "traded_at" not in has and "timestamp" in has:
        add["traded_at"] = F.timestamp_seconds(F.col("timestamp").cast("bigint"))
    if "trade_id" not in has:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        add["trade_id"] = F.concat(text("tx_hash"), F.lit("_"), text("log_index")) if "log_index" in has else F.concat(text("tx_hash"), F.lit("|"), text("token_id"), F.lit("|"), F.sha2(F.to_json(F.struct(*out.columns)), 256))
    if "notional" not in has:
        add["notional"] = F.col("usd_amount").cast("double") if "usd_amount" in has else F.col("size") * F.col("price")
    direction = next((c for c in ("taker_direction", "maker_direction") if c in has), None)
    if "side" not in has and direction:
        add["side"] = F.col(direction).cast("string")
    if "wallet" not in has and "taker" in has:
        add["wallet"] = F.col("taker")
    if "ingest_at" not in has:
        add["ingest_at"] = F.current_timestamp()
    return out.withColumns(add | {"source_file": F.lit("sample")})


def enriched_markets(markets: DataFrame) -> DataFrame:
    """Markets with tokens, winner and resolution: from token lists and final prices where they don't say so themselves."""
    out = markets
    if "clob_token_ids" in out.columns:
        ids = X.json_list(F.col("clob_token_ids")) if dict(out.dtypes)["clob_token_ids"] == "string" else F.col("clob_token_ids")
        out = out.withColumns({"token_yes": F.get(ids, F.lit(0)), "token_no": F.get(ids, F.lit(1))})
    for name, other in (("token_yes", "token1"), ("token_no", "token2")):
        if name not in out.columns:
            out = out.withColumn(name, F.col(other) if other in out.columns else F.lit(None).cast("string"))
    if "winning_outcome" not in out.columns:
        at = X.winner_from_prices(F.col("outcome_prices")) if "outcome_prices" in out.columns else F.lit(None).cast("int")
        out = out.withColumn("winning_outcome", F.when(at == 0, "Yes").when(at == 1, "No"))
    if "winning_token_id" not in out.columns:
        out = out.withColumn("winning_token_id", F.when(F.col("winning_outcome") == "Yes", F.col("token_yes")).when(F.col("winning_outcome") == "No", F.col("token_no")))
    if "resolved" not in out.columns:
        out = out.withColumn("resolved", F.col("winning_token_id").isNotNull())
    if "resolved_at" not in out.columns:
        out = out.withColumn("resolved_at", F.col("end_date").cast("timestamp") if "end_date" in out.columns else F.lit(None).cast("timestamp"))
    return out


def closes(markets: DataFrame) -> DataFrame:
    """(condition_id, resolved_at, closed_at, end_date), one row a market; closed_time stands in for closed_at."""
    has = set(markets.columns)
    column = lambda c: F.col(c).cast("timestamp") if c in has else F.lit(None).cast("timestamp")
    closed = F.coalesce(column("closed_at"), column("closed_time"))
    return markets.select("condition_id", column("resolved_at").alias("resolved_at"), closed.alias("closed_at"), column("end_date").alias("end_date")).groupBy("condition_id").agg(*[F.max(c).alias(c) for c in CLOSES])


def one_a_market(markets: DataFrame) -> DataFrame:
    """The row of each market that comes last by its columns, so that reruns agree."""
    cols = [c for c in MARKET_COLUMNS if c in markets.columns]
    return markets.select(*cols).groupBy("condition_id").agg(F.max(F.struct(*[c for c in cols if c != "condition_id"])).alias("_m")).select("condition_id", "_m.*")


def coalesce_join(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Left join on key; of columns that both have, base's value, or incoming's where it is null. One row of incoming a key."""
    both = [c for c in incoming.columns if c != key and c in base.columns]
    joined = base.join(incoming.withColumnsRenamed({c: f"{c}__new" for c in both}), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__new")) for c in both}).drop(*[f"{c}__new" for c in both])


def with_winner(trades: DataFrame) -> DataFrame:
    return trades.withColumn("token_won", F.col("token_id") == F.col("winning_token_id"))


def canonical(trades: DataFrame, markets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, features): one row a fill, with its market's columns, of markets with a known winner; and their features with winner, event and side."""
    fills = research.canonical_fills(trades)
    known = one_a_market(enriched_markets(markets))
    fills = fills.drop(*[c for c in known.columns if c != "condition_id" and c in fills.columns]).join(known, "condition_id", "left")
    resolved = with_winner(fills).where("token_won is not null")
    return resolved, canonical_features(resolved, markets)


def canonical_features(trades: DataFrame, markets: DataFrame) -> DataFrame:
    own = [c for c in ("trade_id", "condition_id", "token_id", "traded_at", "price", "size", "notional", "side", "token_won", "event_id", "fee_regime", "fee_confidence", "category") if c in trades.columns]
    return features.trade_features(trades.select(*own), closes(enriched_markets(markets)))


def with_fees(trades: DataFrame) -> DataFrame:
    """fee_regime, fee_confidence, fee_rate and fee_category by day and category; null categories are unknown and charged as crypto."""
    category = F.col("category") if "category" in trades.columns else F.lit(None).cast("string")
    free = F.to_date("traded_at") <= F.lit(X.LAST_FREE_DAY).cast("date")
    known = F.coalesce(F.lower(F.trim(category)).isin(*X.FEE_RATES), F.lit(False))
    name = F.coalesce(F.nullif(F.lower(F.trim(category)), F.lit("")), F.lit("crypto"))
    given = F.coalesce(F.trim(category) != "", F.lit(False))
    return trades.withColumns({
        "fee_regime": F.when(free, "zero_fee_historical").when(known, "category_taker_fee").otherwise("unknown_category_fallback"), "fee_confidence": X.fee_confidence(F.col("traded_at"), category),
        "fee_rate": F.when(free, 0.0).otherwise(X.fee_rate(name)), "fee_category": F.when(free, F.when(given, name).otherwise("unknown")).when(known, name).otherwise(F.concat(F.lit("unknown:"), name)),
    })


def merge_lakes(baseline: DataFrame, years: list[DataFrame], markets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trades, features) of a lake and further years: fills once, nulls of markets' columns filled from markets, fees attached. A market never stands for an event."""
    rows = baseline
    for y in years:
        rows = rows.unionByName(y, allowMissingColumns=True)
    out = with_winner(coalesce_join(research.canonical_fills(rows), one_a_market(enriched_markets(markets)), "condition_id"))
    if "event_id" not in out.columns:
        out = out.withColumn("event_id", F.lit(None).cast("string"))
    out = with_fees(out)
    return out, canonical_features(out, markets)


def coverage(trades: DataFrame) -> DataFrame:
    """One row on a lake: trades, events, share of trades with an event, markets, first and last time, and trades without fees."""
    return trades.agg(
        F.count("*").alias("n_trades"), F.countDistinct("event_id").alias("n_events"), F.coalesce(F.avg(F.col("event_id").isNotNull().cast("double")), F.lit(0.0)).alias("event_share"), F.countDistinct("condition_id").alias("n_markets"),
        F.min("traded_at").alias("first_at"), F.max("traded_at").alias("last_at"), F.count_if(F.col("fee_regime") == "zero_fee_historical").alias("n_free"),
    )


def fee_counts(trades: DataFrame) -> DataFrame:
    return trades.groupBy("fee_regime").agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """Digest of all rows' values of some columns, whatever their order: the sum of the rows' 64-bit hashes, with their number."""
    use = [c for c in columns if c in df.columns]
    r = df.agg(F.sum(F.xxhash64(*use).cast("decimal(38,0)")), F.count("*")).first() if use else (None, 0)
    return f"{r[1]}:{int(r[0] or 0) % (1 << 64):016x}"


def sharpe(c: str, n: Column | None = None) -> Column:
    n = F.count(c) if n is None else n
    sd = F.stddev_samp(c)
    return F.when((n < 2) | sd.isNull() | (sd <= 1e-15), 0.0).otherwise(F.avg(c) / F.nullif(sd, F.lit(0.0)) * F.sqrt(n))


def candidate_ledger(df: DataFrame, strategies: list[edges.Strategy], slip_bps: float) -> DataFrame:
    """Every strategy's fills, with the fees of their time: label, event_id, trade_id, traded_at, token_won, fill_price, fee, pnl."""
    matched = edges.on_grid(df.where("token_won is not null"), strategies)
    return edges.with_pnl(matched, slip_bps, "crypto", historical=True).select("label", "event_id", "trade_id", "traded_at", "price", "token_won", "fill_price", "fee", "pnl", "roi")


def attempts(train: DataFrame, strategies: list[edges.Strategy], min_rows: int = 30, min_events: int = 5) -> DataFrame:
    """(label, n_train, n_train_events, status) of every strategy; those without rows are not in it."""
    by = edges.on_grid(train, strategies).groupBy("label").agg(F.count("*").alias("n_train"), F.countDistinct("event_id").alias("n_train_events"))
    return by.withColumn("status", F.when((F.col("n_train") >= min_rows) & (F.col("n_train_events") >= min_events), "ok").otherwise("insufficient_sample"))


def walk_forward(train: DataFrame, strategies: list[edges.Strategy], folds: list[dict], slip_bps: float = 50.0) -> DataFrame:
    """(label, fold, n_test, is_sharpe, oos_sharpe, oos_ev_pct) by strategy and fold, events of a fold's training rows left out of its test; a strategy without rows in a fold isn't in it."""
    ledger = candidate_ledger_with_roles(train, strategies, folds, slip_bps)
    is_test = F.col("role") == "test"
    out = ledger.groupBy("label", "fold").agg(F.count_if(is_test).alias("n_test"), sharpe_of(~is_test).alias("is_sharpe"), sharpe_of(is_test).alias("oos_sharpe"), F.coalesce(100 * F.avg(F.when(is_test, F.col("pnl"))), F.lit(0.0)).alias("oos_ev_pct"))
    return out


def candidate_ledger_with_roles(df: DataFrame, strategies: list[edges.Strategy], folds: list[dict], slip_bps: float) -> DataFrame:
    rows = research.on_folds(df.where("token_won is not null"), folds, "event_id")
    return edges.with_pnl(edges.on_grid(rows, strategies), slip_bps, "crypto", historical=True).select("label", "fold", "role", "event_id", "pnl")


def sharpe_of(when: Column) -> Column:
    x = F.when(when, F.col("pnl"))
    sd = F.stddev_samp(x)
    return F.when((F.count(x) < 2) | sd.isNull() | (sd <= 1e-15), 0.0).otherwise(F.avg(x) / F.nullif(sd, F.lit(0.0)) * F.sqrt(F.count(x)))


def promoted(folds: DataFrame, n_folds: int) -> DataFrame:
    """(label, positive_folds, mean_oos_ev): strategies that gain in half of the folds or more; a fold without rows counts as no gain."""
    by = folds.groupBy("label").agg((F.count_if(F.col("oos_ev_pct") > 0) / max(n_folds, 1)).alias("positive_folds"), (F.sum("oos_ev_pct") / max(n_folds, 1)).alias("mean_oos_ev"))
    return by.where("positive_folds >= 0.5")


def bootstrap(events: DataFrame, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """(label, mean, lo, hi, p_positive) over the events of each label (label, event_id, pnl), resampled n_boot times.

    A strategy's events are one group; each event counts once, so it has as many rows as a strategy has events.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("event_id")["pnl"].to_numpy()
        rng = np.random.default_rng(seed)
        means = np.sort(np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(n_boot)]))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "mean": [x.mean()], "lo": [means[int(0.025 * n_boot)]], "hi": [means[max(0, int(0.975 * n_boot) - 1)]], "p_positive": [(means > 0).mean()]})

    return events.groupBy("label").applyInPandas(run, "label string, mean double, lo double, hi double, p_positive double")


def final_test(test: DataFrame, strategies: list[edges.Strategy], chosen: DataFrame, slips: tuple[float, ...] = (0.0, 25.0, 50.0, 100.0, 200.0), slip_bps: float = 50.0) -> DataFrame:
    """Statistics of the promoted strategies (chosen) on the locked test rows, with the expected value at each slippage and a verdict."""
    matched = edges.on_grid(test.where("token_won is not null"), strategies).join(chosen.select("label"), "label", "left_semi")
    ledger = edges.with_pnl(matched, slip_bps, "crypto", historical=True)
    sums = ledger.groupBy("label").agg(F.count("*").alias("test_n"), F.countDistinct("event_id").alias("test_events"), (100 * F.avg("pnl")).alias("test_ev_pct"), F.sum("pnl").alias("test_pnl"), sharpe("pnl").alias("test_sharpe"), F.avg(F.col("token_won").cast("double")).alias("hit_rate"))
    falls = edges.equity_curve(ledger, ("label",)).groupBy("label").agg(F.max(F.col("peak") - F.col("equity")).alias("max_drawdown"))
    slip = [(100 * F.avg(won_less_fill(s))).alias(f"ev_slip_{int(s)}") for s in slips]
    events = ledger.groupBy("label", "event_id").agg(F.sum("pnl").alias("pnl"))
    five = W.partitionBy("label").orderBy(F.desc("pnl"), "event_id")
    leave = events.withColumn("_n", F.row_number().over(five)).groupBy("label").agg(F.avg(F.when(F.col("_n") > 5, F.col("pnl"))).alias("leave5_mean"))
    out = chosen
    for part in (sums, falls, matched.groupBy("label").agg(*slip), leave, bootstrap(events).select("label", "p_positive")):
        out = out.join(part, "label", "left")
    return out.withColumn("robustness", verdict())


def won_less_fill(slip_bps: float) -> Column:
    fill = X.clip_price(F.col("price") * (1 + slip_bps / 10_000))
    return F.col("token_won").cast("double") - fill - X.historical_fee(F.lit(1.0), fill, F.col("traded_at"), F.lit("crypto"))


def verdict() -> Column:
    """Of columns test_events, positive_folds, test_ev_pct, p_positive, leave5_mean."""
    p, folds, n = F.col("p_positive"), F.col("positive_folds"), F.coalesce("test_events", F.lit(0))
    bad = F.col("test_ev_pct").isNull() | (n < 5) | (F.col("test_ev_pct") <= 0) | F.coalesce(p < 0.55, F.lit(False))
    weak = (folds < 0.5) | F.coalesce(F.col("leave5_mean") <= 0, F.lit(False))
    few = (n < 30) | (folds < 0.67) | F.coalesce(p < 0.8, F.lit(True))
    return F.when(bad, "rejected").when(weak, "fragile").when(few, "promising_underpowered").otherwise("robust_candidate")


def sweep(df: DataFrame, train_end: str, strategies: list[edges.Strategy] | None = None, min_train_events: int = 50, min_test_events: int = 20, n_folds: int = 3, train_days: int = 60, test_days: int = 21, embargo_days: int = 2) -> dict:
    """{status, reason} if blocked, else also attempts, folds, promoted, final (frames). A frame of features without event ids is blocked; the test rows are purged of training events and used once."""
    if "event_id" not in df.columns or "token_won" not in df.columns:
        return {"status": "BLOCKED", "reason": "event_id or token_won missing"}
    counts = df.agg(F.count("*"), F.count("event_id"), F.min("traded_at")).first()
    if not counts[0] or counts[1] < 0.95 * counts[0]:
        return {"status": "BLOCKED", "reason": "empty, or under 95 % of rows with an event"}
    strategies = edges.coarse_grid() if strategies is None else strategies
    train = edges.in_time(df, end=train_end)
    test = research.purge(edges.in_time(df, start=train_end), train, "event_id")
    n_train, n_test = (x.select(F.countDistinct("event_id")).first()[0] for x in (train, test))
    if n_train < min_train_events or n_test < min_test_events:
        return {"status": "BLOCKED", "reason": f"events: {n_train} to train, {n_test} to test"}
    folds = research.purged_folds(str(counts[2]), train_end, n_folds, train_days, test_days, embargo_days)
    tried = attempts(train, strategies)
    enough = tried.where("status = 'ok'").select("label")
    walked = walk_forward(train, strategies, folds).join(enough, "label", "left_semi")
    chosen = promoted(walked, len(folds))
    return {"status": "ok", "attempts": tried, "folds": walked, "promoted": chosen, "final": final_test(test, strategies, chosen)}
