"""Fill identity, as-of fills, purged validation, calibration, multiple testing and forward labels."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from .features import micros

IDENTITY = ("tx_hash", "token_id", "price", "size", "traded_at", "side")


def identity(df: DataFrame, columns: tuple[str, ...] = IDENTITY) -> Column:
    return X.fill_key(*[F.col(c) for c in columns if c in df.columns])


def audit_duplicates(trades: DataFrame, key: Column | None = None) -> DataFrame:
    """One row: rows, distinct ids, ids that repeat with one fill (exact) or several (divergent), and the rows of these."""
    key = identity(trades) if key is None else key
    by = trades.select("trade_id", key.alias("_k")).groupBy("trade_id").agg(F.count("*").alias("n"), F.countDistinct("_k").alias("k"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_ids"), F.count_if((F.col("n") > 1) & (F.col("k") == 1)).alias("exact_ids"),
        F.count_if((F.col("n") > 1) & (F.col("k") > 1)).alias("divergent_ids"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_involved"),
    )


def duplicate_details(trades: DataFrame) -> DataFrame:
    twice = trades.groupBy("trade_id").count().where("count > 1").select("trade_id")
    return trades.withColumn("_fill_key", identity(trades)).join(twice, "trade_id", "left_semi")


def canonical_fills(trades: DataFrame, key: Column | None = None) -> DataFrame:
    """The first row of each fill by ingestion, time and id, with fill_id, a digest of its identity."""
    order = [F.col(c) for c in ("ingest_at", "traded_at", "trade_id") if c in trades.columns]
    df = trades.withColumn("_k", identity(trades) if key is None else key)
    first = W.partitionBy("_k").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("fill_id", F.substring(F.sha2("_k", 256), 1, 32)).drop("_n", "_k")


def next_prints(signals: DataFrame, prints: DataFrame, latency_s: float = 1.0, timeout_s: float = 300.0) -> DataFrame:
    """Forward as-of join: each signal with the first print of its token after latency, up to timeout later.

    Signals and prints are sorted together, latest first, by token and cell of time as long as the timeout, and a signal
    takes the print seen last: no pairs are made, and a token with very many prints is spread over its cells. A print is
    in its cell and in the one before, so a signal looks in one.
    """
    lat, out = int(latency_s * 1e6), int(timeout_s * 1e6)
    key = micros(F.col("traded_at")) + lat
    s = signals.select(F.struct(*signals.columns).alias("_row"), F.col("token_id").alias("_token"), key.alias("_key"), F.floor(key / out).alias("_cell"), F.lit(0).alias("_kind"), F.lit(None).cast(dict(prints.dtypes)["trade_id"]).alias("_id"), F.lit(None).cast(f"struct<us:bigint,price:double,id:{dict(prints.dtypes)['trade_id']}>").alias("_print"))
    us = micros(F.col("traded_at"))
    p = prints.where(F.upper("side").isin("BUY", "SELL"))
    cells = F.explode(F.array(F.floor(us / out), F.floor(us / out) - 1))
    p = p.select(F.lit(None).cast(s.schema["_row"].dataType).alias("_row"), F.col("token_id").alias("_token"), us.alias("_key"), cells.alias("_cell"), F.lit(1).alias("_kind"), F.col("trade_id").alias("_id"), F.struct(us.alias("us"), F.col("price").cast("double").alias("price"), F.col("trade_id").alias("id")).alias("_print"))
    seen = W.partitionBy("_token", "_cell").orderBy(F.desc("_key"), "_kind", F.desc("_id")).rowsBetween(W.unboundedPreceding, 0)
    hit = s.unionByName(p).withColumn("_hit", F.last("_print", ignorenulls=True).over(seen)).where("_kind = 0")
    found = F.when(F.col("_hit.us") <= F.col("_key") + out, F.col("_hit"))
    return hit.select("_row.*", found["price"].alias("print_price"), found["id"].alias("print_id"))


def as_of(rows: DataFrame, series: DataFrame, on: str = "key", at: str = "ts", series_at: str = "ts", value: str = "value") -> DataFrame:
    """Backward as-of join: rows with the last value of their key's series at or before their time, null if none.

    Both are sorted together by key, so no pairs are made. Of equal times in the series the greatest value counts.
    """
    kind = series.schema[value].dataType
    left = rows.select(F.struct(*rows.columns).alias("_row"), F.col(on).alias("_on"), F.col(at).cast("timestamp").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_value"))
    right = series.where(F.col(value).isNotNull()).select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(on).alias("_on"), F.col(series_at).cast("timestamp").alias("_at"), F.lit(0).alias("_kind"), F.col(value).alias("_value"))
    seen = W.partitionBy("_on").orderBy("_at", "_kind", "_value").rowsBetween(W.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("_last", F.last("_value", ignorenulls=True).over(seen)).where("_kind = 1").select("_row.*", F.col("_last").alias(f"asof_{value}"))


def outcome_fills(signals: DataFrame, prints: DataFrame, latency_s: float = 1.0, timeout_s: float = 300.0, slip_bps: float = 50.0, category: str | None = None) -> DataFrame:
    """next_prints with fill price, fee and a reason where there is no fill."""
    df = next_prints(signals, prints, latency_s, timeout_s)
    fill = X.adverse_fill(F.col("price"), F.col("print_price"), X.normal_side(F.col("side")), slip_bps)
    df = df.withColumn("fill_price", F.when(F.col("print_price").isNotNull(), fill))
    fee = X.historical_fee(F.lit(1.0), F.col("fill_price"), F.col("traded_at"), F.lit(category))
    return df.withColumns({"fee": F.when(F.col("fill_price").isNotNull(), fee), "reject": F.when(F.col("fill_price").isNull(), "no_print_within_timeout")})


def purge(test: DataFrame, train: DataFrame, event: str = "condition_id") -> DataFrame:
    """Test rows whose event isn't in train; rows without an event go."""
    return test.where(F.col(event).isNotNull()).join(train.select(event).distinct(), event, "left_anti")


def purged_folds(start: str, end: str, n_folds: int = 3, train_days: int = 30, test_days: int = 7, embargo_days: int = 2) -> list[dict]:
    """Walk-forward folds as ISO dates: train, embargo, test; each starts test_days after the one before."""
    t0, last, out = date.fromisoformat(start[:10]), date.fromisoformat(end[:10]) + timedelta(days=1), []
    for i in range(n_folds):
        a = t0 + timedelta(days=i * test_days)
        b = a + timedelta(days=train_days)
        c = b + timedelta(days=embargo_days)
        d = c + timedelta(days=test_days)
        if d > last:
            break
        out.append({"fold": i, "train_start": a.isoformat(), "train_end": b.isoformat(), "test_start": c.isoformat(), "test_end": d.isoformat()})
    return out


def on_folds(df: DataFrame, folds: list[dict], event: str = "condition_id") -> DataFrame:
    """Rows by fold and role (train, test), test rows purged of train events. Folds are a parameter of a few rows."""
    spark = df.sparkSession
    f = spark.createDataFrame([(x["fold"], role, x[f"{role}_start"], x[f"{role}_end"]) for x in folds for role in ("train", "test")], "fold int, role string, a string, b string")
    ts = F.col("traded_at")
    rows = df.join(F.broadcast(f), (ts >= F.col("a").cast("timestamp")) & (ts < F.col("b").cast("timestamp"))).drop("a", "b")
    seen = rows.where("role = 'train'").select("fold", F.col(event).alias("_e"), F.lit(True).alias("_seen")).distinct().withColumnRenamed("fold", "_f")
    joined = rows.where(F.col(event).isNotNull()).join(seen, (F.col("fold") == F.col("_f")) & (F.col(event) == F.col("_e")), "left")
    return joined.where("role = 'train' or _seen is null").drop("_f", "_e", "_seen")


def calibrator(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """(bin, n, wins, freq) for every bin of equal width on [0, 1]; freq null without rows."""
    b = F.least(F.floor(F.col("price") * n_bins), F.lit(n_bins - 1)).cast("int")
    got = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("token_won").cast("int")).alias("wins"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wins", F.lit(0)).alias("wins"), (F.col("wins") / F.col("n")).alias("freq"))


def calibration_residuals(df: DataFrame, n_bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("price") * n_bins), F.lit(n_bins - 1)).cast("int")
    table = calibrator(df, n_bins).select("bin", "freq")
    return df.withColumn("bin", b).join(F.broadcast(table), "bin", "left").withColumn("residual", F.col("token_won").cast("double") - F.col("freq"))


def by_event(ledger: DataFrame, event: str = "condition_id") -> DataFrame:
    for c in (event, "pnl"):
        if c not in ledger.columns:
            raise KeyError(c)
    return ledger.groupBy(event).agg(F.sum("pnl").alias("pnl"), F.count("*").alias("n"))


def leave_largest_out(events: DataFrame, k: int = 5) -> DataFrame:
    """Mean pnl without the k largest events; null with k or fewer. Top k by a limit, so nothing is gathered."""
    top = events.orderBy(F.desc("pnl"), "condition_id").limit(k).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("top"), F.count("*").alias("k"))
    all_ = events.agg(F.sum("pnl").alias("total"), F.count("*").alias("n"))
    return all_.crossJoin(top).select("n", F.when(F.col("n") > k, (F.col("total") - F.col("top")) / F.nullif(F.col("n") - F.col("k"), F.lit(0))).alias("mean_without"))


def benjamini_hochberg(df: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """df with `discovery`. Ranks come from counts of p values by range of p, so no task sorts them all."""
    cells = df.where(F.col(p).isNotNull()).withColumn("_cell", F.least(F.floor(F.col(p) * 1024), F.lit(1023)))
    counts = cells.groupBy("_cell").count()
    before = W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # 1,024 rows
    offsets = counts.select("_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    m = cells.agg(F.count("*").alias("_m"))
    upto = F.count("*").over(W.partitionBy("_cell").orderBy(p).rangeBetween(W.unboundedPreceding, 0))
    ranked = cells.withColumn("_r", upto).join(F.broadcast(offsets), "_cell").crossJoin(F.broadcast(m))
    cut = ranked.where(F.col(p) <= (F.col("_r") + F.col("_off")) / F.col("_m") * alpha).agg(F.max(p).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("discovery", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def deflated_sharpe(sharpe: float, n_obs: int, n_trials: int, skew: float = 0.0, kurt: float = 3.0) -> float | None:
    """Probability that the ratio beats what the best of n_trials would show by chance."""
    if n_obs < 2 or n_trials < 1:
        return None
    gamma = 0.5772156649015329
    floor = (1 - gamma) * math.sqrt(math.pi / 6 / n_trials) + gamma * math.sqrt(2 * math.log(max(n_trials, 2)))
    var = (1 + 0.5 * sharpe**2 - skew * sharpe + (kurt - 3) / 4 * sharpe**2) / (n_obs - 1)
    return 0.5 * math.erfc((floor - sharpe) / math.sqrt(2 * var)) if var > 0 else None


def bootstrap_ci(pnls: list[float], n_boot: int = 1000, seed: int = 42, alpha: float = 0.05) -> dict:
    """Means of resampled events: mean, bounds and the share above zero. pnls: one an event, of one strategy."""
    if not pnls:
        return {"mean": None, "lo": None, "hi": None, "p_positive": None}
    rng, n = random.Random(seed), len(pnls)
    means = sorted(sum(pnls[rng.randrange(n)] for _ in range(n)) / n for _ in range(n_boot))
    at = lambda q: means[min(n_boot - 1, max(0, int(q * n_boot)))]
    return {"mean": sum(pnls) / n, "lo": at(alpha / 2), "hi": at(1 - alpha / 2), "p_positive": sum(m > 0 for m in means) / n_boot}


def pbo(in_sample: list[float], out_sample: list[float]) -> float | None:
    """Share of all candidates that are at or above the median in sample and below it out of sample."""
    if len(in_sample) != len(out_sample) or len(in_sample) < 2:
        return None
    a, b = sorted(in_sample)[len(in_sample) // 2], sorted(out_sample)[len(out_sample) // 2]
    return sum(x >= a and y < b for x, y in zip(in_sample, out_sample)) / len(in_sample)


def pbo_of_folds(scores: DataFrame, most_folds: int = 8) -> DataFrame:
    """One row (pbo, n_trials, n_folds, method) from (trial, fold, is_score, oos_score), each trial in each fold.

    With up to most_folds folds a trial counts if more than half of its out-of-sample scores are below the median of
    the fold in which it did best in sample; with more, if its best score in sample is at or above its median and its
    worst one out of sample below its median. Medians are the upper ones. Null under two trials.
    """
    upper = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int"))
    medians = scores.groupBy("fold").agg(upper("oos_score").alias("median"))
    best = F.max_by(F.struct("median", "fold"), F.struct("is_score", (-F.col("fold")).alias("first")))
    by = scores.join(medians, "fold").groupBy("trial").agg(best["median"].alias("median"), F.collect_list("oos_score").alias("oos"), F.max("is_score").alias("top"), upper("is_score").alias("mid"), F.min("oos_score").alias("worst"), upper("oos_score").alias("oos_mid"), F.count("*").alias("folds"))
    below = F.size(F.filter("oos", lambda x: x < F.col("median"))) / F.col("folds")
    few = F.max("folds") <= most_folds
    share = F.when(few, F.avg((below > 0.5).cast("double"))).otherwise(F.avg(((F.col("top") >= F.col("mid")) & (F.col("worst") < F.col("oos_mid"))).cast("double")))
    return by.agg(F.when(F.count("*") >= 2, share).alias("pbo"), F.count("*").alias("n_trials"), F.max("folds").alias("n_folds"), F.when(few, "combinatorial_cscv").otherwise("rank_proxy").alias("method"))


def neighbourhood_stability(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """(center, stability): of the neighbours that pairs (center, neighbour) give, the share whose score has the center's sign.

    scores: (label, score). Null where the center has no score or scores 0; neighbours without a score count as different.
    """
    c = scores.select(F.col("label").alias("center"), F.col("score").alias("_c"))
    n = scores.select(F.col("label").alias("neighbour"), F.col("score").alias("_n"))
    joined = pairs.join(c, "center", "left").join(n, "neighbour", "left")
    same = F.coalesce((F.col("_n") * F.col("_c") > 0).cast("double"), F.lit(0.0))
    return joined.groupBy("center").agg(F.when(F.coalesce(F.max("_c"), F.lit(0.0)) != 0, F.avg(same)).alias("stability"))


def multiple_testing(scores: DataFrame, n_obs: int = 100, alpha: float = 0.05) -> DataFrame:
    """One row on the candidates of (label, sharpe, oos_sharpe, p): n_trials, best_sharpe, pbo and discoveries at a false discovery rate of alpha, with dsr, the best ratio deflated."""
    middle = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))
    base = scores.agg(F.count("*").alias("n_trials"), F.coalesce(F.max("sharpe"), F.lit(0.0)).alias("best_sharpe"), middle("sharpe").alias("_a"), middle("oos_sharpe").alias("_b"))
    bad = scores.crossJoin(F.broadcast(base.select("_a", "_b"))).agg(F.avg(F.coalesce((F.col("sharpe") >= F.col("_a")) & (F.col("oos_sharpe") < F.col("_b")), F.lit(False)).cast("double")).alias("pbo"))
    found = benjamini_hochberg(scores.where("p is not null"), alpha=alpha).agg(F.count_if("discovery").alias("n_discoveries"))
    one = base.drop("_a", "_b").crossJoin(bad).crossJoin(found)
    n = F.greatest(F.col("n_trials"), F.lit(1)).cast("double")
    gamma, best = 0.5772156649015329, F.col("best_sharpe")
    floor = (1 - gamma) * F.sqrt(float(math.pi / 6) / n) + gamma * F.sqrt(2 * F.log(F.greatest(n, F.lit(2.0))))
    z = (best - floor) / F.sqrt((1 + 0.5 * best * best) / max(n_obs - 1, 1))
    return one.withColumn("z", z).withColumn("alpha", F.lit(alpha))


def forward_labels(entries: DataFrame, mids: DataFrame, horizons: tuple[int, ...] = (5, 30, 60, 300, 900, 3600, 14400), tp: float = 0.05, sl: float = 0.03) -> DataFrame:
    """For each entry and horizon h: the last mid in (t, t + h], its return, extreme returns and first times of take profit and stop.

    A range join by cells of time as long as the longest horizon. Returns of an entry at 0 are infinite, or NaN to a mid of 0.
    """
    return _signed_labels(entries, mids, horizons, tp, sl, F.lit(1.0))


def _signed_labels(entries: DataFrame, mids: DataFrame, horizons: tuple[int, ...], tp: float, sl: float, sign: Column) -> DataFrame:
    """forward_labels of returns times sign, a column of entries: -1 for short ones."""
    cell = max(horizons) * 1_000_000
    e = entries.select("trade_id", "token_id", F.col("price").alias("entry"), sign.alias("_sign"), micros(F.col("traded_at")).alias("_t"))
    e = e.withColumn("_cell", F.explode(F.array(F.floor(F.col("_t") / cell), F.floor(F.col("_t") / cell) + 1)))
    m = mids.select(F.col("token_id").alias("_token"), F.col("price").alias("_mid"), micros(F.col("traded_at")).alias("_u"), F.floor(micros(F.col("traded_at")) / cell).alias("_c"))
    hit = e.join(m, (F.col("token_id") == F.col("_token")) & (F.col("_cell") == F.col("_c")) & (F.col("_u") > F.col("_t")) & (F.col("_u") <= F.col("_t") + cell))
    hit = hit.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).where(F.col("_u") <= F.col("_t") + F.col("horizon").cast("long") * 1_000_000)
    move = F.col("_sign") * (X.ieee_ratio(F.col("_mid"), F.col("entry")) - 1)
    after = (F.col("_u") - F.col("_t")) / 1e6
    return hit.groupBy("trade_id", "horizon").agg(
        F.max_by("_mid", "_u").alias("exit_mid"), F.max_by(move, F.col("_u")).alias("mid_return"), F.max(move).alias("mfe"), F.min(move).alias("mae"),
        F.min(F.when(move >= tp, after)).alias("tp_seconds"), F.min(F.when(move <= -sl, after)).alias("sl_seconds"),
    )


def label_paths(entries: DataFrame, mids: DataFrame, horizons: tuple[int, ...] = (5, 30, 60, 300, 900, 3600, 14400), tp: float = 0.05, sl: float = 0.03) -> DataFrame:
    """Forward labels in full: a row for each entry and horizon, with skip_reason where there is none.

    entries: trade_id, token_id, price, traded_at, and if they have them direction (long or short), taker_price, maker_low,
    maker_high, and gaps and invalid, arrays of (start, end) in seconds. A horizon is skipped if it meets a gap (gap), if
    it begins or ends in an invalid interval (invalid_book), or if there is no mid in it (no_data). Returns are of the
    entry's direction; those of a maker are the mid's, scaled by the bounds. first_hit: tp or sl, whichever came first.
    """
    has = set(entries.columns)
    column = lambda c, kind: F.col(c) if c in has else F.lit(None).cast(kind)
    spans = "array<struct<start:double,end:double>>"
    t = micros(F.col("traded_at")) / 1e6
    e = entries.select("trade_id", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"), F.col("price").alias("entry"), F.coalesce(column("direction", "string"), F.lit("long")).alias("direction"), column("taker_price", "double").alias("taker_price"), column("maker_low", "double").alias("maker_low"), column("maker_high", "double").alias("maker_high"), t.alias("_t"), column("gaps", spans).alias("gaps"), column("invalid", spans).alias("invalid"))
    end = F.col("_t") + F.col("horizon")
    gap = F.exists("gaps", lambda g: (g["start"] <= end) & (g["end"] >= F.col("_t")))
    bad = F.exists("invalid", lambda g: F.col("_t").between(g["start"], g["end"]) | end.between(g["start"], g["end"]))
    sign = F.when(F.col("direction") == "short", -1.0).otherwise(1.0)
    side = F.when(column("direction", "string") == "short", -1.0).otherwise(1.0)
    out = e.join(_signed_labels(entries, mids, horizons, tp, sl, side).drop("mid_return"), ["trade_id", "horizon"], "left")
    reason = F.when(F.coalesce(gap, F.lit(False)), "gap").when(F.coalesce(bad, F.lit(False)), "invalid_book").when(F.col("exit_mid").isNull(), "no_data")
    ok = reason.isNull()
    mid = X.ieee_ratio(sign * (F.col("exit_mid") - F.col("entry")), F.col("entry"))
    taker = X.ieee_ratio(sign * (F.col("exit_mid") - F.col("taker_price")), F.col("taker_price"))
    hit_tp, hit_sl = F.col("tp_seconds"), F.col("sl_seconds")
    when = lambda c: F.when(ok, c)
    return out.select(
        "trade_id", "horizon", reason.alias("skip_reason"), when(F.col("exit_mid")).alias("exit_mid"), when(mid).alias("mid_return"), when(X.logit(F.col("exit_mid")) - X.logit(F.col("entry"))).alias("logit_return"),
        when(F.col("mfe")).alias("mfe"), when(F.col("mae")).alias("mae"), when(taker).alias("taker_return"), when(taker - mid).alias("adverse_selection"),
        when(mid * F.col("maker_low")).alias("maker_low_return"), when(mid * F.col("maker_high")).alias("maker_high_return"), when(hit_tp).alias("tp_seconds"), when(hit_sl).alias("sl_seconds"),
        when(F.when(hit_tp.isNotNull() & (hit_sl.isNull() | (hit_tp <= hit_sl)), "tp").when(hit_sl.isNotNull(), "sl")).alias("first_hit"),
    )


def gate(features: DataFrame, train_end: str = "2025-01-01", min_events: int = 100, min_train: int = 50, min_test: int = 20, baseline_rows: int | None = None, fallback: bool = False) -> DataFrame:
    """One row of evidence on a dataset, and PASS-BOUNDED or BLOCKED with reasons. Events are event_id alone; a market never stands for one."""
    if "event_id" not in features.columns:
        return features.sparkSession.range(1).select(F.lit("event_id missing").alias("reasons"), F.lit("BLOCKED").alias("verdict"))
    has = set(features.columns)
    early = F.col("traded_at") < F.lit(train_end).cast("timestamp")
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    spans = features.where("event_id is not null").groupBy("event_id").agg(F.max(early).alias("train"), F.max(~early).alias("test"), F.count_if(~early).alias("late"))
    fresh = F.col("test") & ~F.col("train")
    events = spans.agg(F.count("*").alias("events"), F.count_if("train").alias("train_events"), F.count_if(fresh).alias("test_events"), F.coalesce(F.sum(F.when(fresh, F.col("late"))), F.lit(0)).alias("test_rows"))
    key = "trade_id" if "trade_id" in has else "fill_id" if "fill_id" in has else None
    rows = features.agg(
        F.count("*").alias("n"), share(F.col("event_id").isNotNull()).alias("event_share"), (share(F.col("token_won").isNotNull()) if "token_won" in has else F.lit(0.0)).alias("label_share"),
        (share(F.coalesce(F.col("fee_confidence").isin("exact", "strongly_evidenced"), F.lit(False))) if "fee_confidence" in has else F.lit(0.0)).alias("fee_share"),
        (F.countDistinct(key) if key else F.lit(-1)).alias("ids"), F.max(F.year("traded_at")).alias("last_year"),
    )
    checks = [
        (F.lit(fallback), "baseline fallback"), (F.col("n") == 0, "empty"), (F.col("event_share") < 0.95, "event ids"), (F.col("label_share") < 0.95, "labels"), (F.col("fee_share") < 0.5, "fee evidence"), (F.col("ids") != F.col("n"), "ids"),
        (F.coalesce(F.col("last_year"), F.lit(0)) < 2024, "years"), (F.lit(baseline_rows is not None) & (F.col("n") <= (baseline_rows or 0)), "no expansion"), (F.col("events") < min_events, "events"), (F.col("train_events") < min_train, "train events"),
        (F.col("test_events") < min_test, "test events"), (F.col("test_rows") == 0, "test rows"),
    ]
    df = rows.crossJoin(events).withColumn("reasons", F.concat_ws(",", *[F.when(c, r) for c, r in checks]))
    return df.withColumn("verdict", F.when(F.col("reasons") == "", "PASS-BOUNDED").otherwise("BLOCKED"))


def classify(n_events: int, positive_folds: float, test_ev: float, p_positive: float, leave5: float | None) -> str:
    if test_ev <= 0 or p_positive < 0.55 or n_events < 5:
        return "rejected"
    if positive_folds < 0.5 or (leave5 is not None and leave5 <= 0):
        return "fragile"
    if n_events < 30 or positive_folds < 0.67:
        return "promising_underpowered"
    return "robust_candidate" if p_positive >= 0.8 else "promising_underpowered"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
