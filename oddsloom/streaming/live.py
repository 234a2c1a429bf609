"""Streams: market events parsed from JSON, features of live trades, and paper traders by profile."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

DAY, HOUR = 86_400.0, 3_600.0
EVENT = "event_type string, asset_id string, market string, price string, size string, side string, timestamp string, bids array<struct<price:string,size:string>>, asks array<struct<price:string,size:string>>, price_changes array<struct<asset_id:string,price:string,size:string,side:string,best_bid:string,best_ask:string>>, winning_asset_id string"
FEATURES = "token_id string, ts double, price double, size double, momentum_1h double, whale_ratio double, trades_1h long, best_bid double, best_ask double, kind string, condition_id string, winner string"
FILLS = "profile string, token_id string, ts double, action string, price double, shares double, fee double, pnl double, cash double"


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """(kind, token_id, condition_id, ts, price, size, side, best_bid, best_ask, winner) from JSON frames: a list or one object each.

    Kinds: trade (price in [0, 1]), book (top of book), resolved. price_change frames fan out by asset.
    """
    text = F.trim(column)
    listed = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    e = raw.select(F.explode(F.from_json(listed, f"array<struct<{EVENT}>>")).alias("e")).select("e.*")
    n = F.col("timestamp").try_cast("double")
    ts = F.when(n > 1e10, n / 1000).otherwise(n)
    side = lambda c, best: best(F.transform(c, lambda x: x["price"].try_cast("double")))
    base = e.withColumn("ts", ts)
    change = F.when(F.col("event_type") == "price_change", F.col("price_changes"))
    rows = base.select("*", F.explode_outer(change).alias("c"))
    price = F.col("price").try_cast("double")
    kind = F.when(F.col("event_type").isin("last_trade_price", "trade") & price.between(0, 1), "trade").when(F.col("event_type").isin("book", "price_change"), "book").when(F.col("event_type") == "market_resolved", "resolved")
    return rows.select(
        kind.alias("kind"), F.coalesce("c.asset_id", "asset_id", "winning_asset_id").alias("token_id"), F.col("market").alias("condition_id"), "ts", price.alias("price"), F.col("size").try_cast("double").alias("size"), X.normal_side(F.col("side")).alias("side"),
        F.coalesce(F.col("c.best_bid").try_cast("double"), side(F.col("bids"), F.array_max)).alias("best_bid"), F.coalesce(F.col("c.best_ask").try_cast("double"), side(F.col("asks"), F.array_min)).alias("best_ask"), F.col("winning_asset_id").alias("winner"),
    ).where("kind is not null")


@dataclass
class TokenWindow:
    """Trades of a token over the last day, and its last top of book."""

    trades: list[tuple[float, float, float]] = field(default_factory=list)
    bid: float | None = None
    ask: float | None = None

    def add(self, ts: float, price: float, size: float) -> tuple[float | None, float | None, int]:
        """Momentum over the last hour, its mean size by the median size of the day, and its trades.

        Trades are kept by time, and a trade sees those up to its own time. One that comes late counts for those after it,
        but doesn't change what was said of them.
        """
        insort(self.trades, (ts, price, size), key=lambda t: t[0])
        self.trades = [t for t in self.trades if t[0] >= self.trades[-1][0] - DAY or t[0] >= ts - DAY]
        day = [t for t in self.trades if ts - DAY <= t[0] <= ts]
        hour = [t for t in day if t[0] >= ts - HOUR]
        sizes, mine = [t[2] for t in day if t[2] > 0], [t[2] for t in hour if t[2] > 0]
        mid = median(sizes) if sizes else 0.0
        return (hour[-1][1] - hour[0][1]) / max((hour[-1][0] - hour[0][0]) / HOUR, 1e-6), sum(mine) / len(mine) / mid if mine and mid else None, len(hour)


def live_features(events: DataFrame, expire: bool = True) -> DataFrame:
    """A row of features for each trade of a stream of parse_events rows, and a row without features for each resolution; state by token, kept for a day after its last event.

    With expire, a stream of availableNow runs empty batches without end, as a timeout may always come; False keeps state for good.
    """
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        w = TokenWindow()
        if state.exists:
            ts, prices, sizes, w.bid, w.ask = state.get
            w.trades = list(zip(ts, prices, sizes))
        out = []
        for e in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            if e.kind == "book":
                w.bid, w.ask = (None if pd.isna(x) else float(x) for x in (e.best_bid, e.best_ask))
            elif e.kind == "trade":
                size = 0.0 if pd.isna(e.size) else float(e.size)
                out.append((key[0], e.ts, e.price, size, *w.add(e.ts, e.price, size), w.bid, w.ask, e.kind, e.condition_id, None))
            elif e.kind == "resolved":
                out.append((key[0], e.ts, e.price, None, None, None, None, w.bid, w.ask, e.kind, e.condition_id, e.winner))
        cols = [list(c) for c in zip(*w.trades)] or [[], [], []]
        state.update((*cols, w.bid, w.ask))
        if expire:
            state.setTimeoutDuration(int(DAY * 1000))
        yield pd.DataFrame(out, columns=names).astype({"trades_1h": "Int64"})

    return events.groupBy("token_id").applyInPandasWithState(run, FEATURES, "ts array<double>, prices array<double>, sizes array<double>, bid double, ask double", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")


@dataclass
class Profile:
    """Entry and exit rules of a paper trader."""

    name: str
    low: float = 0.40
    high: float = 0.50
    whale: float | None = 3.0
    momentum: str = "any"
    take_profit: float = 0.05
    stop_loss: float = 0.03
    bankroll: float = 10_000.0
    kelly_fraction: float = 0.25
    most_position: float = 0.05
    most_open: int = 25
    cooldown: float = 60.0
    drawdown_halt: float = 0.20
    win_rate: float = 0.6
    slip_bps: float = 50.0
    category: str = "crypto"


PROFILES = [
    Profile("whale_midbucket"),
    Profile("band_momentum_up", 0.20, 0.80, None, "pos"),
    Profile("band_momentum_down", 0.10, 0.60, None, "neg"),
    Profile("band_whale_momentum_up", 0.20, 0.80, 2.0, "pos", 0.20, 0.10),
]


class PaperTrader:
    """One profile's portfolio: exits on take profit, stop and resolution; entries sized by Kelly within limits."""

    def __init__(self, profile: Profile, cash: float | None = None, peak: float | None = None, positions: dict | None = None, last: dict | None = None, markets: dict | None = None):
        self.p = profile
        self.cash = profile.bankroll if cash is None else cash
        self.peak = self.cash if peak is None else peak
        self.positions, self.last, self.markets = positions or {}, last or {}, markets or {}

    def fee(self, shares: float, price: float) -> float:
        return round(shares * X.FEE_RATES.get(self.p.category, X.FEE_RATES["crypto"]) * price * (1 - price), 6)

    def equity(self) -> float:
        return self.cash + sum(s * m for s, _, m in self.positions.values())

    def allowed(self, token: str, ts: float) -> bool:
        self.peak = max(self.peak, self.equity())
        return len(self.positions) < self.p.most_open and token not in self.positions and ts - self.last.get(token, -1e18) >= self.p.cooldown and self.equity() >= self.peak * (1 - self.p.drawdown_halt)

    def close(self, token: str, ts: float, price: float, action: str) -> tuple:
        shares, cost, _ = self.positions.pop(token)
        self.markets.pop(token, None)
        fee = 0.0 if action == "resolved" else self.fee(shares, price)
        self.cash += shares * price - fee
        self.last[token] = ts
        return self.p.name, token, ts, action, price, shares, fee, shares * price - fee - cost, self.cash

    def resolve(self, token: str, ts: float, winner: str | None, market: str | None) -> list[tuple]:
        """Close what is held of the market: at 1 the winner, at 0 the others. Without a winner, nothing is known to close at."""
        held = [t for t in self.positions if t == token or market is not None and self.markets.get(t) == market]
        return [self.close(t, ts, float(t == winner), "resolved") for t in held] if winner else []

    def on(self, kind: str, token: str, ts: float, price: float, momentum: float | None, whale: float | None, market: str | None = None) -> list[tuple]:
        out, p = [], self.p
        if token in self.positions:
            shares, cost, _ = self.positions[token]
            self.positions[token] = (shares, cost, price)
            entry = cost / shares
            if kind == "resolved":
                return [self.close(token, ts, price, "resolved")]
            if price <= entry * (1 - p.stop_loss):
                return [self.close(token, ts, price, "stop_loss")]
            if price >= entry * (1 + p.take_profit):
                return [self.close(token, ts, price, "take_profit")]
        signs = {"any": True, "pos": momentum is not None and momentum > 0, "neg": momentum is not None and momentum < 0}
        if kind == "trade" and p.low <= price < p.high and signs[p.momentum] and (p.whale is None or whale is not None and whale > p.whale) and self.allowed(token, ts):
            fill = min(max(price * (1 + p.slip_bps / 10_000), 0.01), 0.99)
            odds = (1 - fill) / fill
            full = (odds * p.win_rate - (1 - p.win_rate)) / odds
            stake = self.equity() * min(max(full, 0.0) * p.kelly_fraction, p.most_position)
            shares = stake / fill
            fee = self.fee(shares, fill)
            if shares > 0 and stake + fee <= self.cash:
                self.cash -= stake + fee
                self.positions[token], self.markets[token] = (shares, stake + fee, price), market
                out.append((p.name, token, ts, "open", fill, shares, fee, 0.0, self.cash))
        return out


def paper_trade(features: DataFrame, profiles: list[Profile] | None = None) -> DataFrame:
    """Fills of every profile on a stream of live features. A portfolio is one state, so profiles are the parallel unit."""
    profiles = profiles or PROFILES
    by_name = {p.name: p for p in profiles}
    names = [c.split()[0] for c in FILLS.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        trader = PaperTrader(by_name[key[0]])
        if state.exists:
            cash, peak, tokens, shares, costs, marks, seen, times, markets = state.get
            trader = PaperTrader(by_name[key[0]], cash, peak, dict(zip(tokens, zip(shares, costs, marks))), dict(zip(seen, times)), dict(zip(tokens, markets)))
        out = []
        none = lambda x: None if pd.isna(x) else float(x)
        for e in pd.concat(list(batches)).sort_values(["ts", "token_id"], kind="stable").itertuples():
            text = lambda x: x if isinstance(x, str) else None
            if e.kind == "resolved":
                out += trader.resolve(e.token_id, e.ts, text(e.winner), text(e.condition_id))
            else:
                out += trader.on("trade", e.token_id, e.ts, e.price, none(e.momentum_1h), none(e.whale_ratio), text(e.condition_id))
        held = trader.positions
        state.update((trader.cash, trader.peak, list(held), *([v[i] for v in held.values()] for i in range(3)), list(trader.last), list(trader.last.values()), [trader.markets.get(t) for t in held]))
        yield pd.DataFrame(out, columns=names)

    fanned = features.withColumn("profile", F.explode(F.array(*[F.lit(p.name) for p in profiles])))
    return fanned.groupBy("profile").applyInPandasWithState(run, FILLS, "cash double, peak double, tokens array<string>, shares array<double>, costs array<double>, marks array<double>, seen array<string>, times array<double>, markets array<string>", "append", "NoTimeout")


def leaderboard(fills: DataFrame) -> DataFrame:
    closed = F.col("action") != "open"
    return fills.groupBy("profile").agg(F.count_if(closed).alias("closed"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), F.avg(F.when(closed, (F.col("pnl") > 0).cast("double"))).alias("win_rate"), F.sum("fee").alias("fees")).orderBy(F.desc("total_pnl"), "profile")
