"""Column expressions: prices and buckets, log odds, fees, fills, order-book measures, text and time parsing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Left-closed price buckets.
PRICE_BREAKS = (0.05, 0.10, 0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95)
PRICE_LABELS = ("0.00-0.05", "0.05-0.10", "0.10-0.20", "0.20-0.30", "0.30-0.40", "0.40-0.50", "0.50-0.60", "0.60-0.70", "0.70-0.80", "0.80-0.85", "0.85-0.90", "0.90-0.95", "0.95-1.00")
HALF_TICK = 0.005
#: Taker fee rates by category, and the last day without fees.
FEE_RATES = {"crypto": 0.07, "sports": 0.05, "economics": 0.05, "culture": 0.05, "weather": 0.05, "other": 0.05, "general": 0.05, "finance": 0.04, "politics": 0.04, "mentions": 0.04, "tech": 0.04, "geopolitics": 0.0}
LAST_FREE_DAY = "2026-01-05"


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cut(x: Column, breaks: tuple[float, ...], labels: tuple[str, ...]) -> Column:
    """Label of the left-closed range that x is in; null stays null."""
    out = F.lit(labels[-1])
    for b, label in reversed(list(zip(breaks, labels))):
        out = F.when(x < b, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def price_bucket(price: Column) -> Column:
    return cut(price, PRICE_BREAKS, PRICE_LABELS)


def prob_bucket(p: Column) -> Column:
    return cut(p, (0.2, 0.4, 0.6, 0.8), ("low", "mid_low", "mid", "mid_high", "high"))


def ttr_bucket(hours: Column) -> Column:
    return cut(hours, (24.0, 168.0, 720.0), ("lt_1d", "lt_1w", "lt_1m", "gt_1m"))


# Log odds


def clamp_prob(p: Column, half_tick: float = HALF_TICK) -> Column:
    if half_tick >= 0.5:
        raise ValueError("half_tick must be below 0.5")
    return clip(p, half_tick, 1 - half_tick)


def logit(p: Column, half_tick: float = HALF_TICK) -> Column:
    x = clamp_prob(p, half_tick)
    return F.log(x / (1 - x))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit_edge(model: Column, market: Column, half_tick: float = HALF_TICK) -> Column:
    return logit(model, half_tick) - logit(market, half_tick)


def arcsine(p: Column, half_tick: float = HALF_TICK) -> Column:
    return 2 * F.asin(F.sqrt(clamp_prob(p, half_tick)))


def ttr_hazard(hours: Column) -> Column:
    return 1 / (1 + F.greatest(F.coalesce(hours, F.lit(0.0)), F.lit(0.0)))


# Fees and fills


def fee_rate(category: Column) -> Column:
    """Rate of a category; unknown ones count as crypto."""
    rates = F.create_map(*[F.lit(x) for kv in FEE_RATES.items() for x in kv])
    return F.coalesce(F.get(F.array(F.try_element_at(rates, F.lower(F.trim(category)))), F.lit(0)), F.lit(FEE_RATES["crypto"]))


def round_scaled(x: Column, decimals: int) -> Column:
    """The scaled value rounded to a whole number, half away from 0, as databases round doubles; F.round rounds the shortest decimal that x prints as."""
    return F.round(x * float(10**decimals)) / float(10**decimals)


def ieee_ratio(a: Column, b: Column) -> Column:
    """a / b by IEEE 754: infinite for b = 0, NaN for 0 / 0; null only for nulls."""
    return F.when(b == 0, F.when(a == 0, float("nan")).otherwise(F.signum(a) * float("inf"))).otherwise(a / F.nullif(b, F.lit(0.0)))


def parabolic_fee(shares: Column, price: Column, rate: Column, bounded: bool = True) -> Column:
    """bounded: prices count as 0 to 1; otherwise a price above 1 has a negative fee."""
    p = clip(price, 0.0, 1.0) if bounded else price
    return F.greatest(shares, F.lit(0.0)) * F.greatest(rate, F.lit(0.0)) * p * (1 - p)


def taker_fee(shares: Column, price: Column, rate: Column, decimals: int = 6) -> Column:
    return F.round(parabolic_fee(shares, price, rate), decimals)


def maker_fee(shares: Column, price: Column, rate: Column, multiplier: float = 0.0, decimals: int = 6, bounded: bool = True, rounding: Callable[[Column, int], Column] = F.round) -> Column:
    return rounding(parabolic_fee(shares, price, rate, bounded) * multiplier, decimals)


def relative_fee_rate(price: Column, rate: Column) -> Column:
    """Fee as a share of the notional."""
    return F.greatest(rate, F.lit(0.0)) * (1 - clip(price, 1e-12, 1.0))


def fee_regime(ts: Column) -> Column:
    return F.when(F.to_date(ts) <= F.lit(LAST_FREE_DAY).cast("date"), "zero_fee_historical").otherwise("category_taker_fee")


def historical_fee(shares: Column, price: Column, ts: Column, category: Column) -> Column:
    """Taker fee by regime: none through LAST_FREE_DAY, then by category."""
    return F.when(F.to_date(ts) <= F.lit(LAST_FREE_DAY).cast("date"), 0.0).otherwise(taker_fee(shares, price, fee_rate(category)))


def clip_price(p: Column) -> Column:
    return clip(p, 0.01, 0.99)


def adverse_fill(signal: Column, printed: Column, side: Column, slip_bps: float) -> Column:
    s = slip_bps / 10_000
    return clip_price(F.when(side == "buy", F.greatest(signal, printed) * (1 + s)).otherwise(F.least(signal, printed) * (1 - s)))


def kelly(win_rate: Column, odds: float = 1.0, fraction: float = 0.25, most: float = 0.05) -> Column:
    p, b = clip(win_rate, 0.0, 1.0), max(odds, 1e-9)
    full = (b * p - (1 - p)) / b
    return F.when(full <= 0, 0.0).otherwise(F.least(full * fraction, F.lit(most)))


def normal_side(raw: Column, default: str = "buy") -> Column:
    s = F.upper(F.trim(raw))
    return F.when(s.isin("BUY", "B", "BID"), "buy").when(s.isin("SELL", "S", "ASK"), "sell").otherwise(default)


def tp_sl_levels(entry: Column, atr: Column, tp_atr: float = 2.0, sl_atr: float = 1.0, tp: float = 0.20, sl: float = 0.10) -> tuple[Column, Column]:
    target = F.least(F.greatest(entry + tp_atr * atr, entry * (1 + tp)), F.lit(0.99))
    return target, F.greatest(F.least(entry - sl_atr * atr, entry * (1 - sl)), F.lit(0.01))


def queue_fill_probability(ahead: Column, through: Column, touch_fills: bool = False) -> Column:
    """Share of the queue that trades reached beyond it; 0 on touch, unless touch_fills."""
    none = (through <= 0) | (ahead < 0)
    none = none if touch_fills else none | (through <= ahead)
    return F.when(none, 0.0).otherwise(clip((through - ahead) / F.greatest(ahead, F.lit(1e-9)), 0.0, 1.0))


def maker_fill_bounds(ahead: Column, through: Column, depth: Column) -> tuple[Column, Column, Column]:
    """Lower, base and upper probability that a resting order fills; all 0 if trades don't go beyond the queue."""
    queue, traded = F.greatest(ahead, F.lit(0.0)), F.greatest(through, F.lit(0.0))
    base = clip((traded - queue) / F.greatest(depth, F.lit(1e-9)), 0.0, 1.0)
    beyond = traded > queue
    return tuple(F.when(beyond, x).otherwise(0.0) for x in (0.5 * base, base, F.least(F.lit(1.0), 1.25 * base + 0.1)))


def tp_sl_tick(entry: Column, mark: Column, tp: float | None, sl: float | None, prefer: str = "stop_first") -> Column:
    ret = (mark - entry) / F.nullif(entry, F.lit(0.0))
    gain = ret >= tp if tp is not None else F.lit(False)
    stop = ret <= -sl if sl is not None else F.lit(False)
    first, second = ((stop, "stop_loss"), (gain, "take_profit")) if prefer == "stop_first" else ((gain, "take_profit"), (stop, "stop_loss"))
    return F.when(entry <= 0, "none").when(first[0], first[1]).when(second[0], second[1]).otherwise("none")


def round_to_tick(price: Column, tick: float = 0.01) -> Column:
    return F.bround(price / tick) * tick if tick > 0 else price


def round_size(size: Column, least: float = 1.0) -> Column:
    return F.greatest(F.bround(size / least) * least, F.lit(0.0)) if least > 0 else size


# Order books


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once a row; inside another lambda it would be once an element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def abs_spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def rel_spread(bid: Column, ask: Column) -> Column:
    mid = (bid + ask) / 2
    return F.when(mid > 0, (ask - bid) / mid)


def logit_spread(bid: Column, ask: Column) -> Column:
    return logit(ask) - logit(bid)


def multi_level_imbalance(bids: Column, asks: Column) -> Column:
    n = F.least(F.size(bids), F.size(asks))
    b, a = total(F.slice(bids, 1, n)), total(F.slice(asks, 1, n))
    return F.when((n <= 0) | (a + b == 0), 0.0).otherwise((b - a) / F.nullif(a + b, F.lit(0.0)))


def distance_weighted_imbalance(bids: Column, asks: Column, mid: Column, decay: float = 0.5) -> Column:
    """bids and asks: arrays of structs of price and size; weights fall with the distance to mid."""
    weigh = lambda levels: total(F.transform(levels, lambda x: x["size"] * F.exp(-decay * F.abs(mid - x["price"]))))
    b, a = weigh(bids), weigh(asks)
    return F.when(a + b == 0, 0.0).otherwise((b - a) / F.nullif(a + b, F.lit(0.0)))


def book_slope(levels: Column, side: str, depth: int = 5) -> Column:
    """Least-squares slope of size on price over the first levels, negated for bids; null if under two levels or one price."""
    x = F.slice(levels, 1, depth)
    n = F.size(x)
    mean = lambda c: total(F.transform(x, lambda v: v[c])) / F.nullif(n, F.lit(0))
    top = lambda m: total(F.transform(x, lambda v: (v["price"] - m["price"]) * (v["size"] - m["size"])))
    low = lambda m: total(F.transform(x, lambda v: (v["price"] - m["price"]) * (v["price"] - m["price"])))
    sums = let(F.struct(mean("price").alias("price"), mean("size").alias("size")), lambda m: F.struct(top(m).alias("top"), low(m).alias("low")))
    slope = F.when(n >= 2, let(sums, lambda s: F.when(s["low"] > 0, s["top"] / F.nullif(s["low"], F.lit(0.0)))))
    return -slope if side == "bid" else slope


def depth_concentration(sizes: Column) -> Column:
    """Share of the first level; null without depth."""
    return F.when(total(sizes) > 0, F.get(sizes, F.lit(0)) / total(sizes))


def depth_entropy(sizes: Column) -> Column:
    """Entropy of the levels' shares in nats; null without depth."""
    share = lambda x, all_: F.when(x > 0, -(x / all_) * F.log(x / all_)).otherwise(0.0)
    return let(total(F.filter(sizes, lambda x: x > 0)), lambda all_: F.when(all_ > 0, total(F.transform(sizes, lambda x: share(x, all_)))))


def liquidity_wall(sizes: Column) -> Column:
    return F.when(total(sizes) > 0, F.array_max(sizes) * F.size(sizes) / total(sizes)).otherwise(0.0)


def deep_divergence(top: Column, deep: Column) -> Column:
    """Imbalance at the top of the book less that of its depth."""
    return top - deep


def p_variance(p: Column) -> Column:
    """p (1 - p) of a probability kept half a tick from 0 and 1."""
    x = clamp_prob(p)
    return x * (1 - x)


def scaled_by_p(x: Column, p: Column) -> Column:
    """Depth, volatility or imbalance by the variance of the outcome."""
    return x * p_variance(p)


def flow_delta(bid: Column, ask: Column, bid_before: Column, ask_before: Column) -> Column:
    """Order flow at the top of the book: change of the bid's size less that of the ask's."""
    return (bid - bid_before) - (ask - ask_before)


def multi_level_flow(bids: Column, asks: Column, bids_before: Column | None = None, asks_before: Column | None = None) -> Column:
    """Order flow over the levels that all books have (arrays of sizes); without a book before, their imbalance."""
    if bids_before is None or asks_before is None:
        return multi_level_imbalance(bids, asks)
    n = F.least(F.size(bids), F.size(asks))
    m = F.least(n, F.size(bids_before), F.size(asks_before))
    change = lambda now, before: total(F.slice(now, 1, m)) - total(F.slice(before, 1, m))
    known = bids_before.isNotNull() & asks_before.isNotNull()
    return F.when(n <= 0, 0.0).when(known & (m > 0), change(bids, bids_before) - change(asks, asks_before)).when(known, 0.0).otherwise(multi_level_imbalance(bids, asks))


def autocorrelation(series: Column, lag: int = 1) -> Column:
    """Of an array; null if it is no longer than lag, or flat."""
    n = F.size(series)
    rest = F.greatest(n - lag, F.lit(0))
    both = lambda dev: total(F.zip_with(F.slice(dev, lag + 1, rest), F.slice(dev, 1, rest), lambda a, b: a * b))
    ratio = lambda dev: let(total(F.transform(dev, lambda x: x * x)), lambda low: F.when(low > 0, both(dev) / F.nullif(low, F.lit(0.0))))
    return F.when(n > lag, let(let(total(series) / F.nullif(n, F.lit(0)), lambda mean: F.transform(series, lambda x: x - mean)), ratio))


def steps_until(series: Column, start: int, done) -> Column:
    """Steps from place start (from 0) of an array to the first later value of which done(value) is true; null if none."""
    after = F.slice(series, start + 2, F.greatest(F.size(series) - start - 1, F.lit(0)))
    at = F.array_position(F.transform(after, lambda x: F.coalesce(done(x), F.lit(False))), True)
    return F.when((F.size(series) > start) & (at > 0), at.cast("double"))


def spread_recovery(spreads: Column, shock: int, baseline: Column | None = None) -> Column:
    """Steps until a spread is back within 5 % of the baseline, by default that before the shock."""
    if shock < 0:
        return F.lit(None).cast("double")
    base = F.get(spreads, F.lit(max(0, shock - 1))) if baseline is None else baseline
    return steps_until(spreads, shock, lambda x: x <= base * 1.05)


def imbalance_reversion(series: Column, shock: int) -> Column:
    """Steps until an imbalance is at most half of the shock."""
    if shock < 0:
        return F.lit(None).cast("double")
    return steps_until(series, shock, lambda x: F.abs(x) <= 0.5 * F.abs(F.get(series, F.lit(shock))))


def ratio_or(top: Column, low: Column, otherwise: float = 0.0) -> Column:
    return F.when(low != 0, top / low).otherwise(otherwise)


def signed_trade_imbalance(buy: Column, sell: Column) -> Column:
    return F.when(buy + sell > 0, (buy - sell) / (buy + sell)).otherwise(0.0)


def vpin(buy: Column, sell: Column, volume: Column) -> Column:
    return F.when(volume > 0, F.abs(buy - sell) / volume)


def kyle_lambda(change: Column, volume: Column) -> Column:
    return F.when(volume != 0, change / volume)


def amihud(change: Column, dollars: Column) -> Column:
    return F.when(dollars > 0, F.abs(change) / dollars)


def arrival_intensity(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(0.0)


def cancel_trade_ratio(cancels: Column, trades: Column) -> Column:
    return F.when(trades > 0, cancels / trades)


def refill_rate(before: Column, after: Column, seconds: Column) -> Column:
    return F.when((before > 0) & (seconds > 0), F.greatest(F.lit(0.0), (after - before) / before) / seconds)


def depletion_velocity(before: Column, after: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, (before - after) / seconds)


def complete_set_residual(yes: Column, no: Column) -> Column:
    return 1 - (yes + no)


def complement_deviation(yes: Column, no: Column) -> Column:
    return yes + no - 1


def ttr_decay(hours: Column, half_life: float = 168.0) -> Column:
    return F.when(hours <= 0, 1.0).otherwise(F.exp(-F.log(F.lit(2.0)) * hours / half_life))


def resolution_proximity(hours: Column, most: float = 720.0) -> Column:
    return clip(1 - hours / most, 0.0, 1.0)


def spread_upside(spread: Column, p: Column, side: str = "buy") -> Column:
    x = clamp_prob(p)
    return spread / (1 - x if side == "buy" else x)


def cancel_or_trade(before: Column, after: Column, traded: Column) -> Column:
    """A fall of a level by at least half of what was traded is a trade."""
    change = after - before
    return F.when((traded > 0) & (change <= -0.5 * traded), "trade").when(change < 0, "cancel").when(change > 0, "add").otherwise("unchanged")


def logit_stop_distance(p: Column, stop: Column) -> Column:
    return F.abs(logit(p) - stop)


def microprice(bid: Column, bid_size: Column, ask: Column, ask_size: Column) -> Column:
    return F.when(bid_size + ask_size > 0, (ask * bid_size + bid * ask_size) / (bid_size + ask_size))


def book_resilience(before: Column, after: Column, eps: float = 1e-9) -> Column:
    return F.when(before <= eps, 1.0).otherwise(clip(after / before, 0.0, 1.0))


def trade_aggression(price: Column, bid: Column, ask: Column) -> Column:
    return F.when(bid.isNull() | ask.isNull(), "unknown").when(price >= ask, "buy_aggressive").when(price <= bid, "sell_aggressive").otherwise("mid")


def return_pct(entry: Column, mark: Column, side: Column) -> Column:
    move = F.when(entry > 0, (mark - entry) / entry).otherwise(0.0)
    return F.when(side == "sell", -move).otherwise(move)


def fee_confidence(ts: Column, category: Column) -> Column:
    """How well a fee is known: exact in the free days, strongly_evidenced for known categories, else fallback."""
    known = F.lower(F.trim(category)).isin(*FEE_RATES)
    return F.when(F.to_date(ts) <= F.lit(LAST_FREE_DAY).cast("date"), "exact").when(known, "strongly_evidenced").otherwise("fallback")


# Text and time


def year_bounds(year: int) -> tuple[Column, Column]:
    """First instant of a year and of the next."""
    return F.lit(f"{year}-01-01").cast("timestamp"), F.lit(f"{year + 1}-01-01").cast("timestamp")


def canonical_json(*columns: str) -> Column:
    """JSON of some columns by name, without spaces, so that equal contents have equal text."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def content_digest(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def json_list(s: Column) -> Column:
    """Array of a JSON list's strings; null for other text."""
    return F.when(F.startswith(F.trim(s), F.lit("[")), F.from_json(s, "array<string>", {"allowSingleQuotes": "true"}))


def winner_from_prices(prices: Column, least: float = 0.99) -> Column:
    """Index of the first highest price of a JSON list, if at least `least`, else null."""
    values = F.transform(json_list(prices), lambda x: x.try_cast("double"))
    return F.when(F.array_max(values) >= least, F.array_position(values, F.array_max(values)).cast("int") - 1)


def utc_timestamp(raw: Column) -> Column:
    """Epoch seconds, milli- or microseconds by size, or ISO text with Z, fraction or offset; null if neither."""
    text = F.trim(raw.cast("string"))
    n = text.try_cast("double")
    seconds = F.when(F.abs(n) > 1e14, n / 1e6).when(F.abs(n) > 1e11, n / 1e3).otherwise(n)
    formats = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    return F.coalesce(F.timestamp_seconds(seconds.cast("bigint")), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def fill_key(*columns: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
