"""Swing trading: indicators of bars, entry signals as expressions, and a trader that keeps positions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import features

SIGNAL = "struct<strategy:string,target:double,stop:double,reason:string>"
EXITS = "profile string, token_id string, ts double, action string, strategy string, price double, shares double, pnl double, cash double"


@dataclass(frozen=True)
class Swing:
    """Entry and exit rules. Prices are of binary outcomes, so targets stay under 0.99 and stops over 0.01."""

    name: str = "swing"
    bankroll: float = 10_000.0
    position_share: float = 0.05
    least_liquidity: float = 50_000.0
    least_edge: float = 0.08  # of target over entry
    rsi_period: int = 14
    oversold: float = 25.0
    band_period: int = 20
    band_width: float = 2.5
    least_hurst: float = 0.55
    fast: int = 5
    slow: int = 20
    least_move: float = 0.10
    whale: float = 2.0
    imbalance: float = 3.0
    book_low: float = 0.20
    book_high: float = 0.80
    take_profit: float = 0.20
    take_profit_atr: float = 2.0
    stop_loss: float = 0.10
    stop_loss_atr: float = 1.0
    atr_period: int = 14
    trailing_atr: float = 2.0
    stall_hours: float = 36.0
    band_target: bool = True
    most_open: int = 15
    cooldown: float = 300.0
    history: int = 200
    only_confluence: bool = False
    least_legs: int = 2
    leg_rsi: float = 30.0
    leg_volume: float = 25_000.0
    leg_imbalance: float = 2.5
    strategies: tuple[str, ...] = ("confluence", "mean_reversion", "momentum", "book_imbalance")


PROFILES = [
    Swing("rsi_mean_reversion", least_edge=0.05, cooldown=120.0, strategies=("mean_reversion",)),
    Swing("momentum_drift", least_edge=0.05, least_move=0.08, cooldown=120.0, strategies=("momentum",)),
    Swing("swing_confluence", least_edge=0.05, least_liquidity=25_000.0, oversold=30.0, imbalance=2.5, only_confluence=True, cooldown=120.0, strategies=("confluence",)),
]


def indicators(bars: DataFrame, cfg: Swing | None = None) -> DataFrame:
    """bars (token_id, traded_at, trade_id, price, ...) with rsi, bb_*, atr, ema_fast and ema_slow (seeded by a mean), their values a bar before, move over the slow span, and n_bars."""
    cfg = cfg or Swing()
    w = features.by_time()
    x = features.rsi(bars, F.col("price"), cfg.rsi_period)
    x = features.atr(features.bollinger(x, F.col("price"), cfg.band_period, cfg.band_width), cfg.atr_period)
    x = x.withColumns({"n_bars": F.row_number().over(w), "move": F.col("price") - F.lag("price", cfg.slow - 1).over(w)})
    x = features.ema(x, (cfg.fast, cfg.slow), seed="mean", before=True)
    return x.withColumnsRenamed({f"ema_{cfg.fast}": "ema_fast", f"ema_{cfg.slow}": "ema_slow", f"ema_{cfg.fast}_before": "prev_fast", f"ema_{cfg.slow}_before": "prev_slow"})


def levels(cfg: Swing) -> tuple[Column, Column]:
    """Target and stop by the wider of a share of the price and multiples of the true range, which is 3 % of the price if unknown."""
    range_ = F.coalesce("atr", 0.03 * F.col("price"))
    return X.tp_sl_levels(F.col("price"), range_, cfg.take_profit_atr, cfg.stop_loss_atr, cfg.take_profit, cfg.stop_loss)


def signal(strategy: str, when: Column, target: Column, stop: Column, reason: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(strategy).alias("strategy"), target.alias("target"), stop.alias("stop"), reason.alias("reason")))


def mean_reversion(cfg: Swing) -> Column:
    """Oversold by RSI or under the lower band, in a liquid market; toward the slow average."""
    target, stop = levels(cfg)
    low_rsi = F.coalesce(F.col("rsi") < cfg.oversold, F.lit(False))
    low_band = F.coalesce((F.col("price") < F.col("bb_low")) & (F.col("bb_low") > 0), F.lit(False))
    target = F.when(F.col("ema_slow").isNotNull(), F.greatest(target, F.least("ema_slow", F.lit(0.99)))).otherwise(target)
    target = F.when(target <= F.col("price"), F.least(F.col("price") * (1 + cfg.take_profit), F.lit(0.99))).otherwise(target)
    liquid = F.coalesce("liquidity_usd", F.lit(cfg.least_liquidity)) >= cfg.least_liquidity
    return signal("mean_reversion", liquid & (low_rsi | low_band), target, stop, F.when(low_rsi, "oversold").otherwise("below band"))


def crossed() -> Column:
    return F.coalesce((F.col("prev_fast") <= F.col("prev_slow")) & (F.col("ema_fast") > F.col("ema_slow")), F.lit(False))


def momentum(cfg: Swing) -> Column:
    """A trend by the Hurst exponent and averages that cross, or a large move on volume."""
    target, stop = levels(cfg)
    if cfg.band_target:
        target = F.when(F.col("bb_high").isNotNull(), F.greatest(target, F.least("bb_high", F.lit(0.99)))).otherwise(target)
    backed = F.coalesce(F.col("whale_ratio") >= cfg.whale, F.lit(False)) | F.coalesce(F.col("volume") > 0, F.lit(False))
    moved = F.coalesce(F.col("move") >= cfg.least_move, F.lit(False)) & backed
    trend = (F.col("hurst") >= cfg.least_hurst) & (F.col("ema_fast") > F.col("ema_slow")) & (F.col("n_bars") >= cfg.slow + 2)
    return signal("momentum", trend & (crossed() | moved), target, stop, F.when(crossed(), "cross").otherwise("move"))


def in_book_range(cfg: Swing, least: float) -> Column:
    return F.coalesce((F.col("ask_depth") > 0) & F.col("price").between(cfg.book_low, cfg.book_high) & (F.col("bid_depth") / F.nullif(F.col("ask_depth"), F.lit(0.0)) >= least), F.lit(False))


def book_imbalance(cfg: Swing) -> Column:
    """Much more depth on the bid than on the ask, at middle prices."""
    return signal("book_imbalance", in_book_range(cfg, cfg.imbalance), *levels(cfg), F.lit("depth"))


def confluence_legs(cfg: Swing) -> Column:
    """Names of the confirming signals that hold: depth, averages that cross or stay apart, oversold on volume."""
    stacked = F.coalesce((F.col("ema_fast") > F.col("ema_slow")) & (F.col("n_bars") >= cfg.slow + 2) & (crossed() | (F.col("ema_fast") > F.col("ema_slow") * 1.001)), F.lit(False))
    volume = (F.coalesce("liquidity_usd", F.lit(0.0)) >= cfg.leg_volume) | (F.coalesce("volume", F.lit(0.0)) >= cfg.leg_volume)
    legs = {"signal_liquidity": in_book_range(cfg, cfg.leg_imbalance), "signal_ema_cross": stacked, "signal_rsi": F.coalesce(F.col("rsi") < cfg.leg_rsi, F.lit(False)) & volume}
    return F.array_compact(F.array(*[F.when(c, n) for n, c in legs.items()]))


def confluence(cfg: Swing) -> Column:
    legs = confluence_legs(cfg)
    return signal("confluence", F.size(legs) >= cfg.least_legs, *levels(cfg), F.array_join(legs, ";"))


EVALUATE = {"confluence": confluence, "mean_reversion": mean_reversion, "momentum": momentum, "book_imbalance": book_imbalance}


def signals(bars: DataFrame, cfg: Swing | None = None) -> DataFrame:
    """indicators' rows with a column a strategy, and signal: that of the largest way to its target, if it is least_edge or more; the first listed of equal ones."""
    cfg = cfg or Swing()
    names = [n for n in EVALUATE if n in cfg.strategies and (n == "confluence" or not cfg.only_confluence)]
    out = bars.withColumns({n: EVALUATE[n](cfg) for n in names})
    ranked = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct((F.col(f"{n}.target") - F.col("price")).alias("edge"), F.lit(-i).alias("order"), F.col(n).alias("s"))) for i, n in enumerate(names)]))
    best = F.array_max(ranked)
    return out.withColumn("signal", F.when(best["edge"] >= cfg.least_edge, best["s"]))


# The trader. It works bar by bar, so its indicators are of plain numbers.


def rsi_of(x: list[float], period: int) -> float | None:
    if len(x) <= period:
        return None
    moves = [b - a for a, b in zip(x[-period - 1 :], x[-period:])]
    gain, loss = sum(m for m in moves if m > 0) / period, -sum(m for m in moves if m < 0) / period
    return 100.0 if loss <= 1e-12 else 100 - 100 / (1 + gain / loss)


def ema_of(x: list[float], span: int) -> float | None:
    if len(x) < span:
        return None
    out, k = fmean(x[:span]), 2 / (span + 1)
    for v in x[span:]:
        out += k * (v - out)
    return out


def hurst_of(x: list[float], least: int = 8, most: int = 32) -> float | None:
    moves = [math.log(b / a) for a, b in zip(x, x[1:]) if a > 0 and b > 0]
    if len(x) < least + 2 or len(moves) < least:
        return None
    points = []
    for k in range(4, min(len(moves) // 2, most) + 1):
        ratios = []
        for at in range(0, len(moves) - k + 1, k):
            part = moves[at : at + k]
            mean, y, path = fmean(part), 0.0, []
            for r in part:
                y += r - mean
                path.append(y)
            sd = pstdev(part)
            if sd > 1e-12:
                ratios.append((max(path) - min(path)) / sd)
        if ratios and fmean(ratios) > 0:
            points.append((math.log(k), math.log(fmean(ratios))))
    if len(points) < 3:
        return None
    mx, my = fmean(a for a, _ in points), fmean(b for _, b in points)
    return sum((a - mx) * (b - my) for a, b in points) / sum((a - mx) ** 2 for a, _ in points)


@dataclass
class Position:
    strategy: str
    since: float
    entry: float
    shares: float
    target: float
    stop: float
    trail: float


@dataclass
class SwingTrader:
    """One account: marks and exits first, then at most one entry a bar. The rules are those of the expressions above."""

    cfg: Swing
    cash: float | None = None
    bars: dict[str, list[float]] = field(default_factory=dict)
    marks: dict[str, float] = field(default_factory=dict)
    open: dict[str, Position] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.cash = self.cfg.bankroll if self.cash is None else self.cash

    def equity(self) -> float:
        return self.cash + sum(p.shares * self.marks[t] for t, p in self.open.items())

    def state(self, token: str, price: float) -> dict:
        """Indicators of a token whose bar with this price was added."""
        x, c = self.bars[token], self.cfg
        ranges = [abs(b - a) for a, b in zip(x[-c.atr_period - 1 :], x[-c.atr_period :])] if len(x) > c.atr_period else []
        band = x[-c.band_period :] if len(x) >= c.band_period else []
        mid, sd = (fmean(band), pstdev(band)) if band else (None, None)
        return {
            "rsi": rsi_of(x, c.rsi_period), "atr": fmean(ranges) if ranges else None, "bb_low": mid - c.band_width * sd if band else None, "bb_high": mid + c.band_width * sd if band else None,
            "fast": ema_of(x, c.fast), "slow": ema_of(x, c.slow), "prev_fast": ema_of(x[:-1], c.fast), "prev_slow": ema_of(x[:-1], c.slow), "hurst": hurst_of(x), "move": price - x[-c.slow] if len(x) >= c.slow else price - x[0], "n": len(x),
        }

    def candidates(self, price: float, s: dict, bar: dict) -> list[tuple[float, int, str, float, float]]:
        c, out = self.cfg, []
        range_ = s["atr"] if s["atr"] is not None else 0.03 * price
        target = min(max(price + c.take_profit_atr * range_, price * (1 + c.take_profit)), 0.99)
        stop = max(min(price - c.stop_loss_atr * range_, price * (1 - c.stop_loss)), 0.01)
        stacked = s["fast"] is not None and s["slow"] is not None and s["fast"] > s["slow"] and s["n"] >= c.slow + 2
        cross = stacked and s["prev_fast"] is not None and s["prev_slow"] is not None and s["prev_fast"] <= s["prev_slow"]
        bid, ask, liquidity, volume = bar.get("bid_depth"), bar.get("ask_depth"), bar.get("liquidity_usd"), bar.get("volume") or 0.0
        depth = bid / ask if bid is not None and ask and ask > 0 and c.book_low <= price <= c.book_high else 0.0
        whale = bar.get("whale_ratio")
        legs = [depth >= c.leg_imbalance, cross or stacked and s["fast"] > s["slow"] * 1.001, s["rsi"] is not None and s["rsi"] < c.leg_rsi and max(liquidity or 0.0, volume) >= c.leg_volume]
        low = s["rsi"] is not None and s["rsi"] < c.oversold or s["bb_low"] is not None and 0 < s["bb_low"] and price < s["bb_low"]
        back = max(target, min(s["slow"], 0.99)) if s["slow"] is not None else target
        back = back if back > price else min(price * (1 + c.take_profit), 0.99)
        moved = s["move"] >= c.least_move and (whale is not None and whale >= c.whale or volume > 0)
        far = max(target, min(s["bb_high"], 0.99)) if c.band_target and s["bb_high"] is not None else target
        found = {
            "confluence": (sum(map(bool, legs)) >= c.least_legs, target),
            "mean_reversion": ((liquidity if liquidity is not None else c.least_liquidity) >= c.least_liquidity and low, back),
            "momentum": (stacked and s["hurst"] is not None and s["hurst"] >= c.least_hurst and (cross or moved), far),
            "book_imbalance": (depth >= c.imbalance, target),
        }
        for i, name in enumerate(EVALUATE):
            if name in c.strategies and (name == "confluence" or not c.only_confluence) and found[name][0]:
                out.append((found[name][1] - price, -i, name, found[name][1], stop))
        return out

    def close(self, token: str, ts: float, price: float, action: str) -> tuple:
        p = self.open.pop(token)
        price = min(max(price, 0.0), 1.0)
        self.cash += p.shares * price
        return self.cfg.name, token, ts, action, p.strategy, price, p.shares, p.shares * (price - p.entry), self.cash

    def on_bar(self, token: str, ts: float, price: float, bar: dict | None = None) -> list[tuple]:
        c = self.cfg
        self.bars[token] = [*self.bars.get(token, []), price][-c.history :]
        self.marks[token] = price
        s, out = self.state(token, price), []
        if token in self.open:
            p = self.open[token]
            p.trail = max(p.trail, price - c.trailing_atr * (s["atr"] if s["atr"] is not None else 0.03 * p.entry), p.stop)
        for t, p in list(self.open.items()):
            mark = self.marks[t]
            action = "take_profit" if mark >= p.target else "stop_loss" if mark <= max(p.stop, p.trail) else "time_decay" if ts - p.since >= 3600 * c.stall_hours else None
            if action:
                out.append(self.close(t, ts, mark, action))
        if token in self.open or len(self.open) >= c.most_open or ts - self.last.get(token, 0.0) < c.cooldown:
            return out
        best = max(self.candidates(price, s, bar or {}), default=None)
        budget = self.equity() * c.position_share
        if best and best[0] >= c.least_edge and price > 0 and 1 <= budget <= self.cash:
            self.cash -= budget
            self.open[token] = Position(best[2], ts, price, budget / price, best[3], best[4], best[4])
            self.last[token] = ts
            out.append((c.name, token, ts, "open", best[2], price, budget / price, 0.0, self.cash))
        return out

    def resolve(self, token: str, ts: float, won: bool) -> list[tuple]:
        return [self.close(token, ts, float(won), "resolved")] if token in self.open else []


def swing_trade(bars: DataFrame, profiles: list[Swing] | None = None) -> DataFrame:
    """Entries and exits of every profile on a stream of bars (token_id, ts, price, volume, whale_ratio, bid_depth, ask_depth, liquidity_usd, won).

    A row with won set resolves its token. An account is one state, so profiles are the parallel unit.
    """
    import pandas as pd

    profiles = profiles or PROFILES
    by_name = {p.name: p for p in profiles}
    names = [c.split()[0] for c in EXITS.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        trader = SwingTrader(by_name[key[0]])
        if state.exists:
            cash, tokens, series, marks, last, held, kinds, numbers = state.get
            trader.cash, trader.bars, trader.marks, trader.last = cash, {t: list(x) for t, x in zip(tokens, series)}, dict(zip(tokens, marks)), {t: v for t, v in zip(tokens, last) if v >= 0}
            trader.open = {t: Position(k, *n) for t, k, n in zip(held, kinds, numbers)}
        out = []
        for e in pd.concat(list(batches)).sort_values(["ts", "token_id"], kind="stable").to_dict("records"):
            known = {k: v for k, v in e.items() if not pd.isna(v)}
            out += trader.resolve(e["token_id"], e["ts"], bool(known["won"])) if "won" in known else trader.on_bar(e["token_id"], e["ts"], e["price"], known)
        tokens = list(trader.bars)
        numbers = [[p.since, p.entry, p.shares, p.target, p.stop, p.trail] for p in trader.open.values()]
        state.update((trader.cash, tokens, [trader.bars[t] for t in tokens], [trader.marks[t] for t in tokens], [trader.last.get(t, -1.0) for t in tokens], list(trader.open), [p.strategy for p in trader.open.values()], numbers))
        yield pd.DataFrame(out, columns=names)

    fanned = bars.withColumn("profile", F.explode(F.array(*[F.lit(p.name) for p in profiles])))
    schema = "cash double, tokens array<string>, series array<array<double>>, marks array<double>, last array<double>, held array<string>, kinds array<string>, numbers array<array<double>>"
    return fanned.groupBy("profile").applyInPandasWithState(run, EXITS, schema, "append", "NoTimeout")


def demo_bars(n: int = 60, start: float = 1_700_000_000.0, step: float = 600.0) -> list[tuple]:
    """(token_id, ts, price, volume, bid_depth, ask_depth): a fall and recovery, and a climb, for trying the trader."""
    dip = [0.50 - 0.20 * math.exp(-(((i - n / 2) / 4) ** 2)) for i in range(n)]
    climb = [0.30 + 0.30 * i / n + 0.01 * math.sin(i) for i in range(n)]
    return [(t, start + step * i, round(p[i], 4), 30_000.0, 300.0, 100.0) for i in range(n) for t, p in (("dip", dip), ("climb", climb))]

