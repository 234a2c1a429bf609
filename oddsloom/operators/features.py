"""Per-token features over time: rolling windows, time to resolution, composites, technical indicators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X

HOUR = 3_600_000_000
WINDOWS = {"1h": HOUR, "6h": 6 * HOUR, "24h": 24 * HOUR}
WHALE = 3.0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def resolved_trades(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Trades of resolved markets with a winner, and whether their token won."""
    m = markets.where("resolved and winning_token_id is not null").select("condition_id", "winning_token_id", "resolved_at")
    return trades.join(m, "condition_id").withColumn("token_won", F.col("token_id") == F.col("winning_token_id"))


def rolling_features(trades: DataFrame, slice_hours: int | None = None) -> DataFrame:
    """Momentum, volatility, volume and size measures over (t - period, t] for each trade of a token.

    slice_hours (24 or more) deals a token's trades into slices of time, each with the slice before it as context,
    so that a token with a large part of all trades is spread over tasks; results are the same.
    """
    df = trades.withColumn("_us", micros(F.col("traded_at")))
    keys = ["token_id"]
    if slice_hours:
        if slice_hours * HOUR < max(WINDOWS.values()):
            raise ValueError("slices must be as long as the longest window")
        own = F.floor(F.col("_us") / (slice_hours * HOUR))
        df = df.withColumn("_own", own).withColumn("_slice", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
        keys.append("_slice")
    for name, period in WINDOWS.items():
        w = W.partitionBy(*keys).orderBy("_us").rangeBetween(-(period - 1), 0)
        at = F.struct("_us", "trade_id")
        p0, p1 = F.min_by("price", at).over(w), F.max_by("price", at).over(w)
        hours = F.floor((F.max("_us").over(w) - F.min("_us").over(w)) / 1_000_000) / 3600
        df = df.withColumns({
            f"price_delta_{name}": p1 - p0,
            f"momentum_{name}": (p1 - p0) / F.greatest(hours, F.lit(1e-6)),
            f"volatility_{name}": F.stddev_samp("price").over(w),
            f"volume_{name}": F.sum("notional").over(w),
            f"size_mean_{name}": F.avg("size").over(w),
            f"size_median_{name}": F.percentile("size", F.lit(0.5)).over(w),
        })
    df = df.withColumns({
        "volume_spike_1h_24h": F.when(F.col("volume_24h") > 0, 24 * F.col("volume_1h") / F.col("volume_24h")),
        "whale_ratio": F.when(F.col("size_median_24h") > 0, F.col("size_mean_1h") / F.col("size_median_24h")),
    })
    if slice_hours:
        df = df.where("_own = _slice").drop("_own", "_slice")
    return df.drop("_us")


def time_to_resolution(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Hours, from whole seconds, to the market's close; negative after it, null without one."""
    cols = [c for c in ("resolved_at", "closed_at", "closed_time", "end_date") if c in markets.columns]
    close = markets.select("condition_id", F.coalesce(*[F.col(c) for c in cols]).alias("_close")).dropDuplicates(["condition_id"])
    us = micros(F.col("_close")) - micros(F.col("traded_at"))
    return trades.join(close, "condition_id", "left").withColumn("time_to_resolution_hours", (us / 1_000_000).cast("bigint") / 3600.0).drop("_close")


def composites(df: DataFrame) -> DataFrame:
    ttr = F.greatest(F.coalesce("time_to_resolution_hours", F.lit(0.0)), F.lit(0.0))
    return df.withColumns({
        "decay_adjusted_velocity": F.col("price_delta_1h") / F.sqrt(ttr + 0.1),
        "price_volume_divergence": F.coalesce((F.col("price_delta_1h") < 0) & (F.col("whale_ratio") > WHALE), F.lit(False)),
    })


def trade_features(trades: DataFrame, markets: DataFrame, slice_hours: int | None = None) -> DataFrame:
    """All features of trades after the first day of 1970, one row a trade_id."""
    df = rolling_features(trades.where(F.col("traded_at") > F.lit("1970-01-02").cast("timestamp")), slice_hours)
    df = composites(time_to_resolution(df.withColumn("price_bucket", X.price_bucket(F.col("price"))), markets))
    last = W.partitionBy("trade_id").orderBy(F.col("traded_at").desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def by_time(key: str = "token_id") -> W:
    return W.partitionBy(key).orderBy("traded_at", "trade_id")


def logit_columns(df: DataFrame) -> DataFrame:
    x = X.logit(F.col("price"))
    return df.withColumns({"logit_price": x, "delta_logit_1bar": x - F.lag(x).over(by_time())})


def rsi(df: DataFrame, value: Column, period: int = 14, name: str = "rsi", flat: float = 100.0) -> DataFrame:
    """Simple-average RSI over the last changes; null before there are enough. flat: without loss or gain."""
    w = by_time()
    d = value - F.lag(value).over(w)
    df = df.withColumn("_d", d).withColumn("_i", F.row_number().over(w))
    frame = w.rowsBetween(1 - period, 0)
    gain, loss = F.sum(F.greatest("_d", F.lit(0.0))).over(frame) / period, F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).over(frame) / period
    calm = F.when(gain <= 1e-12, flat).otherwise(100.0)
    out = F.when(F.col("_i") > period, F.when(loss <= 1e-12, calm).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0)))))
    return df.withColumn(name, out).drop("_d", "_i")


def bollinger(df: DataFrame, value: Column, period: int = 20, k: float = 2.5) -> DataFrame:
    w = by_time()
    frame = w.rowsBetween(1 - period, 0)
    ready = F.count(value).over(frame) == period
    mid, sd = F.when(ready, F.avg(value).over(frame)), F.when(ready, F.stddev_pop(value).over(frame))
    return df.withColumns({"bb_mid": mid, "bb_low": mid - k * sd, "bb_high": mid + k * sd})


def atr(df: DataFrame, period: int = 14) -> DataFrame:
    """Mean true range of bars whose high and low come from the price and the one before."""
    w = by_time()
    prev = F.lag("price").over(w)
    df = df.withColumn("_tr", F.abs(F.col("price") - prev))
    frame = w.rowsBetween(1 - period, 0)
    return df.withColumn("atr", F.when(F.count("_tr").over(frame) == period, F.avg("_tr").over(frame))).drop("_tr")


def robust_bands(df: DataFrame, window: int = 48, k: float = 2.5) -> DataFrame:
    """Upper-middle median of log odds and bands of k times the median deviation from it."""
    frame = by_time().rowsBetween(1 - window, 0)
    values = F.sort_array(F.collect_list(X.logit(F.col("price"))).over(frame))
    df = df.withColumn("_v", values).withColumn("band_mid", F.when(F.size("_v") == window, F.get("_v", F.lit(window // 2))))
    mad = F.get(F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("band_mid")))), F.lit(window // 2))
    return df.withColumn("band_mad", F.when(F.col("band_mid").isNotNull(), mad)).withColumns({"band_low": F.col("band_mid") - k * F.col("band_mad"), "band_high": F.col("band_mid") + k * F.col("band_mad")}).drop("_v")


def numbered(df: DataFrame) -> DataFrame:
    """df by token in time order, with _row from 1, for functions that walk a token's rows from batch to batch (starts)."""
    return df.withColumn("_row", F.row_number().over(by_time()))


def starts() -> Callable:
    """A function of a batch of numbered rows and the last number before it: where a token starts; an error if rows aren't in order. Made here, so that workers need not import this module."""
    import numpy as np

    def started(row: np.ndarray, last: int) -> np.ndarray:
        first = row == 1
        if not np.all(first | (row == np.concatenate(([last], row[:-1])) + 1)):
            raise ValueError("rows of a token are not in order")
        return first

    return started


def ema(df: DataFrame, spans: tuple[int, ...] = (5, 20), value: str = "price", seed: str = "first", before: bool = False) -> DataFrame:
    """Exponential averages by token in time order. A recursion, so by walking sorted rows in batches; no token is gathered.

    seed: first, from the first value on; or mean, from the span-th value on with the mean of the first span, null before.
    Each step is a + (x - a) * 2 / (span + 1); a null keeps the average, and weighs down what was before it. before: also
    the averages of the row before, as ema_<span>_before.
    """
    import numpy as np
    import pyarrow as pa

    from pyspark.sql import types as T

    started = starts()
    names = [n for s in spans for n in ([f"ema_{s}", f"ema_{s}_before"] if before else [f"ema_{s}"])]
    kept = [n for n in df.columns if n not in names]
    schema = T.StructType([*[df.schema[n] for n in kept], *[T.StructField(n, T.DoubleType()) for n in names]])

    def walk(row: list[int], values: list[float | None], span: int, state: tuple) -> tuple[list, list, tuple]:
        average, total, known, missed = state
        now, was = [], []
        decay, seeding = 1 - 2 / (span + 1), span if seed == "mean" else 0
        for i, x in zip(row, values):
            if i == 1:
                average, total, known, missed = None, 0.0, 0, 0
            was.append(average)
            if x is not None and x != x:
                x = None
            if i <= seeding:
                if x is not None:
                    total, known = total + x, known + 1
                if i == seeding and known:
                    average = total / known
            elif x is None:
                missed += average is not None
            elif average is None:
                average = x
            elif missed:
                average += (x - average) * (1 - decay) / (decay ** (missed + 1) + 1 - decay)
                missed = 0
            else:
                average = average + (x - average) * 2 / (span + 1)
            now.append(average)
        return now, was, (average, total, known, missed)

    def run(batches):
        last, states = 0, [(None, 0.0, 0, 0)] * len(spans)
        for b in batches:
            if not b.num_rows:
                continue
            row = np.asarray(b.column("_row"))
            started(row, last)
            last, out = row[-1], []
            steps, values = row.tolist(), b.column(value).cast(pa.float64()).to_pylist()
            for k, span in enumerate(spans):
                now, was, states[k] = walk(steps, values, span, states[k])
                out += [now, was] if before else [now]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in kept], *[pa.array(x, pa.float64()) for x in out]], names=[*kept, *names])

    return numbered(df).mapInArrow(run, schema)


def ema_cross(df: DataFrame, fast: str = "ema_5", slow: str = "ema_20") -> DataFrame:
    f, s, w = F.col(fast), F.col(slow), by_time()
    was = lambda c: F.col(f"{c}_before") if f"{c}_before" in df.columns else F.lag(c).over(w)
    return df.withColumns({"bullish_cross": F.coalesce((was(fast) <= was(slow)) & (f > s), F.lit(False)), "bullish_stack": f > s})


def hurst(df: DataFrame, value: str = "price", least: int = 8, most: int = 32, skip_zeros: bool = True) -> DataFrame:
    """(token_id, hurst): slope of log rescaled range on log chunk size over log returns between positive prices.

    Null with fewer than `least` returns (or least + 2 prices), or fewer than three sizes of chunk with a spread. Without
    skip_zeros, returns from or to a price of 0 are infinite, or NaN between two, and so is what they are part of. Sorted
    rows are walked in batches, with less than a chunk of each size kept for the next, so no token is gathered.
    """
    import numpy as np
    import pyarrow as pa

    from pyspark.sql import types as T

    sizes, started = list(range(4, most + 1)), starts()
    schema = T.StructType([df.schema["token_id"], T.StructField("hurst", T.DoubleType())])

    def slopes(rows, n, sums, counts):
        k = np.array(sizes, float)
        rs = sums / counts
        used = (counts > 0) & (k <= (n // 2)[:, None]) & ~(rs <= 0)
        points = used.sum(1)
        x, y = np.where(used, np.log(k), 0.0), np.where(used, np.log(np.where(used, rs, 1.0)), 0.0)
        dx, dy = np.where(used, x - (x.sum(1) / points)[:, None], 0.0), np.where(used, y - (y.sum(1) / points)[:, None], 0.0)
        known = (rows >= least + 2) & (n >= least) & (points >= 3)
        return pa.array((dx * dy).sum(1) / (dx * dx).sum(1), pa.float64(), mask=~known)

    def run(batches):
        # Of the token whose rows may go on: its name, last number and price, rows, returns, and by size ratios' sums and counts and the returns of an open chunk.
        token, last, price, seen, moves = None, 0, np.nan, 0, 0
        sums, counts, tails = np.zeros(len(sizes)), np.zeros(len(sizes)), [np.empty(0)] * len(sizes)
        for b in batches:
            if not b.num_rows:
                continue
            row = np.asarray(b.column("_row"))
            first = started(row, last)
            x = np.array(b.column("_x").to_numpy(zero_copy_only=False), float)
            was = np.concatenate(([price], x[:-1]))
            at = np.cumsum(first)  # 0: the token of the batch before
            keep = ~first & ~np.isnan(x) & ~np.isnan(was)
            keep &= (x > 0) & (was > 0) if skip_zeros else True
            tokens = at[-1] + 1
            r, t = np.log(x[keep] / was[keep]), at[keep]
            new = np.bincount(t, minlength=tokens)
            n, rows = new.copy(), np.bincount(at, minlength=tokens)
            n[0], rows[0] = n[0] + moves, rows[0] + seen
            place = np.arange(len(r)) - (np.cumsum(new) - new)[t] + np.where(t == 0, moves, 0)
            total, number = np.zeros((tokens, len(sizes))), np.zeros((tokens, len(sizes)))
            total[0], number[0] = sums, counts
            for i, k in enumerate(sizes):
                tail = tails[i]
                rr, tt = np.concatenate((tail, r)), np.concatenate((np.zeros(len(tail), int), t))
                start = np.flatnonzero(np.concatenate((moves - len(tail) + np.arange(len(tail)), place)) % k == 0)
                start = start[start + k <= len(rr)]
                start = start[tt[start + k - 1] == tt[start]]
                part = rr[start[:, None] + np.arange(k)]
                d = part - np.cumsum(part, 1)[:, -1:] / k
                path, sd = np.cumsum(d, 1), np.sqrt(np.cumsum(d * d, 1)[:, -1] / k)
                wide = ~(sd <= 1e-12)
                ratio, of = ((path.max(1) - path.min(1)) / sd)[wide], tt[start[wide]]
                total[:, i] += np.bincount(of, ratio, tokens)
                number[:, i] += np.bincount(of, minlength=tokens)
                tails[i] = rr[len(rr) - n[-1] % k :]
            names = b.column("token_id").filter(pa.array(first))
            done = [*([token] if last else []), names.slice(0, max(0, len(names) - 1))] if len(names) else []
            skip = 0 if last else 1
            if tokens - 1 > skip:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(done), slopes(rows[skip:-1], n[skip:-1], total[skip:-1], number[skip:-1])], names=["token_id", "hurst"])
            token = names.slice(len(names) - 1) if len(names) else token
            last, price, seen, moves, sums, counts = row[-1], x[-1], rows[-1], n[-1], total[-1], number[-1]
        if last:
            yield pa.RecordBatch.from_arrays([token, slopes(np.array([seen]), np.array([moves]), sums[None], counts[None])], names=["token_id", "hurst"])

    def quiet(batches):
        with np.errstate(all="ignore"):
            yield from run(batches)

    return numbered(df.select("token_id", "traded_at", "trade_id", F.col(value).cast("double").alias("_x"))).select("token_id", "_x", "_row").mapInArrow(quiet, schema)


def live_window(trades: DataFrame) -> DataFrame:
    """What a live feed knows at each trade: momentum and trades of [t - 1 h, t], and its mean size by the median size of [t - 24 h, t].

    Trades of the same instant count as known. The time that a momentum is divided by is at least 1e-6 h, so that of a single trade is 0.
    """
    df = trades.withColumn("_us", micros(F.col("traded_at")))
    hour, day = (W.partitionBy("token_id").orderBy("_us").rangeBetween(-h * HOUR, 0) for h in (1, 24))
    at = F.struct("_us", "trade_id")
    p0, p1 = F.min_by("price", at).over(hour), F.max_by("price", at).over(hour)
    hours = (F.max("_us").over(hour) - F.min("_us").over(hour)) / HOUR
    positive = F.when(F.col("size") > 0, F.col("size"))
    median = F.percentile(positive, F.lit(0.5)).over(day)
    return df.withColumns({
        "live_momentum_1h": (p1 - p0) / F.greatest(hours, F.lit(1e-6)),
        "live_whale_ratio": F.when(median > 0, F.avg(positive).over(hour) / median),
        "live_trades_1h": F.count("*").over(hour),
    }).drop("_us")


def logit_technicals(df: DataFrame, rsi_period: int = 14, fast: int = 5, slow: int = 20, window: int = 48, k: float = 2.5) -> DataFrame:
    """arcsine_price, and of log odds by token: logit_rsi, EMAs and their upward cross (null before slow + 1 rows), and bands of median deviation."""
    x = df.withColumns({"arcsine_price": X.arcsine(F.col("price")), "_x": X.logit(F.col("price"))})
    x = ema(rsi(x, F.col("_x"), rsi_period, "logit_rsi", flat=50.0), (fast, slow), "_x")
    x = robust_bands(ema_cross(x, f"ema_{fast}", f"ema_{slow}"), window, k).withColumn("_i", F.row_number().over(by_time()))
    known = lambda c: F.when(F.col("_i") > slow, F.col(c))
    out = x.withColumns({"logit_ema_fast": known(f"ema_{fast}"), "logit_ema_slow": known(f"ema_{slow}"), "logit_ema_bullish_cross": known("bullish_cross"), "logit_mad_upper": F.col("band_high"), "logit_mad_lower": F.col("band_low")})
    return out.drop("_x", "_i", f"ema_{fast}", f"ema_{slow}", "bullish_cross", "bullish_stack", "band_mid", "band_mad", "band_low", "band_high")


def book_columns(df: DataFrame) -> DataFrame:
    """book_imbalance (bid depth by ask depth) and trade_aggression, null and unknown where a column is missing."""
    has = set(df.columns)
    ratio = F.when(F.col("ask_depth") > 0, F.col("bid_depth") / F.col("ask_depth")) if {"bid_depth", "ask_depth"} <= has else F.lit(None).cast("double")
    kind = X.trade_aggression(F.col("price"), F.col("best_bid"), F.col("best_ask")) if {"price", "best_bid", "best_ask"} <= has else F.lit("unknown")
    return df.withColumns({"book_imbalance": ratio, "trade_aggression": kind})
