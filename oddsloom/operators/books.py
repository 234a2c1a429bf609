"""Order books: walking levels, replaying messages, sequence gaps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from .features import starts

BOOK_SCHEMA = "asset_id string, exchange_time double, seq long, event_type string, best_bid double, best_ask double, mid double, spread double, bid_depth double, ask_depth double, microprice double, uncertain boolean, crossed boolean, inversions long, gaps long"


def walk_levels(levels: DataFrame, keys: tuple[str, ...], size: Column, side: str = "buy", partial: bool = True, tick: float = 0.0, lot: float = 0.0) -> DataFrame:
    """Fill of an order of `size` on each group's levels (price, size), best price first: filled, average price, levels used, residual.

    Without partial, an order that one level can't fill fills nothing. With a tick and a lot, prices and sizes are
    rounded to them. Where nothing fills, the average price is 0.
    """
    order = F.asc("price") if side == "buy" else F.desc("price")
    rounded = levels.withColumns({"size": F.greatest(X.round_size(F.col("size"), lot), F.lit(0.0)), "price": X.round_to_tick(F.col("price"), tick)})
    want = F.greatest(X.round_size(size, lot), F.lit(0.0))
    w = W.partitionBy(*keys).orderBy(order, "size").rowsBetween(W.unboundedPreceding, -1)
    take = F.greatest(F.least(F.col("size"), want - F.coalesce(F.sum("size").over(w), F.lit(0.0))), F.lit(0.0))
    got = rounded.withColumns({"_take": take, "_want": want, "_asked": size})
    filled = F.sum("_take")
    out = got.groupBy(*keys).agg(
        filled.alias("filled"), F.coalesce(F.sum(F.col("_take") * F.col("price")) / F.nullif(filled, F.lit(0.0)), F.lit(0.0)).alias("avg_price"),
        F.count_if(F.col("_take") > 0).alias("levels_used"), F.max("_want").alias("_want"), F.max("_asked").alias("_asked"), F.first(F.when(F.col("_take") > 0, F.col("_take")), ignorenulls=True).alias("_first"), F.max("_take").alias("_most"),
    ).withColumn("residual", F.col("_want") - F.col("filled"))
    if not partial:
        whole = (F.col("levels_used") <= 1) & (F.col("residual") <= 0)
        out = out.withColumns({"residual": F.when(whole, F.col("residual")).otherwise(F.col("_asked")), **{c: F.when(whole, F.col(c)).otherwise(F.lit(0)) for c in ("filled", "avg_price", "levels_used")}})
    return out.drop("_want", "_asked", "_first", "_most")


def aggressive_fills(fills: DataFrame, side: Column, category: str = "crypto", mid_after: Column | None = None, role: str = "taker") -> DataFrame:
    """walk_levels' rows with fee, and markout: how far the mid went against the fill, if a later mid is known. A maker pays no fee."""
    fee = F.lit(0.0) if role == "maker" else X.taker_fee(F.col("filled"), F.when(F.col("avg_price") > 0, F.col("avg_price")).otherwise(0.5), X.fee_rate(F.lit(category)))
    out = fills.withColumns({"fee": fee, "role": F.lit(role)})
    if mid_after is None:
        return out.withColumn("markout", F.lit(None).cast("double"))
    move = F.when(side == "buy", F.col("avg_price") - mid_after).otherwise(mid_after - F.col("avg_price"))
    return out.withColumn("markout", F.when((F.col("filled") > 0) & (F.col("avg_price") > 0), move))


def taker_executions(fills: DataFrame, side: Column, mid: Column, mid_after: Column, uncertain: Column, age_ms: Column, category: str = "crypto", latency_ms: float = 250.0, max_age_ms: float = 5_000.0) -> DataFrame:
    """walk_levels' rows with fee, realized spread and adverse selection; orders on an uncertain or stale book are rejected with zeros."""
    reject = F.when(uncertain, "uncertain_book").when(age_ms > max_age_ms + latency_ms, "stale_book")
    done = aggressive_fills(fills, side, category, mid_after)
    ok = reject.isNull() & (F.col("filled") > 0) & (F.col("avg_price") > 0)
    out = done.withColumns({"reject": reject, "realized_spread": F.when(ok, 2 * F.abs(F.col("avg_price") - mid)), "adverse_selection": F.when(ok & mid.isNotNull(), F.col("markout"))})
    return out.withColumns({c: F.when(F.col("reject").isNull(), F.col(c)).otherwise(F.lit(0)) for c in ("filled", "avg_price", "fee", "levels_used", "residual")}).drop("markout", "role")


def sequence_gaps(messages: DataFrame) -> DataFrame:
    """Messages with gap: the sequence number jumped by more than one since the asset's message before."""
    w = W.partitionBy("asset_id").orderBy("exchange_time", "seq")
    return messages.withColumn("gap", F.coalesce(F.col("seq") - F.lag("seq").over(w) > 1, F.lit(False)))


class Side:
    """Levels of one side of a book: sizes by price, the best price by a heap, and the depth by whole numbers of 2**-1074, exact in any order. A change costs no walk over the levels."""

    UNIT = 1 << 1074

    def __init__(self, levels: Iterable[tuple[float, float]] = (), highest: bool = True) -> None:
        self.levels: dict[float, float] = {}
        self.sign = -1 if highest else 1
        self.heap: list[float] = []
        self.units = self.endless = 0
        for price, size in levels:
            self.put(price, size)

    def count(self, size: float, times: int) -> None:
        if math.isinf(size):
            self.endless += times
        else:
            n, d = size.as_integer_ratio()
            self.units += times * n * (self.UNIT // d)

    def put(self, price: float, size: float) -> None:
        old = self.levels.pop(price, None)
        if old is not None:
            self.count(old, -1)
        if size > 0:
            self.levels[price] = size
            self.count(size, 1)
            if old is None:
                heapq.heappush(self.heap, self.sign * price)

    def best(self) -> float | None:
        while self.heap and self.sign * self.heap[0] not in self.levels:
            heapq.heappop(self.heap)
        return self.sign * self.heap[0] if self.heap else None

    def depth(self) -> float:
        return math.inf if self.endless else self.units / self.UNIT


class Book:
    """State of one asset's book.

    Snapshots reset it. Deltas set or remove a level, unless it is uncertain: after a gap in the sequence, or a gap or
    reconnect event, until the next snapshot. Every snapshot with levels and every delta gives a record, other events none.
    """

    def __init__(self) -> None:
        self.bids, self.asks = Side(), Side(highest=False)
        self.uncertain, self.seq, self.time = False, None, None
        self.gaps = self.inversions = 0

    def seen(self, m: dict) -> None:
        time = m["exchange_time"]
        if time is not None:
            self.inversions += self.time is not None and time < self.time
            self.time = time

    def apply(self, m: dict) -> tuple | None:
        kind = m["event_type"]
        if kind in ("reconnect", "gap"):
            self.uncertain = True
            return None
        sides = [list(m[s]) if m[s] is not None else [] for s in ("bids", "asks")]
        if kind in ("snapshot", "book") or any(sides):
            if not any(sides):
                return None
            self.bids, self.asks = (Side(((float(x["price"]), float(x["size"])) for x in side if x["size"] > 0), high) for side, high in zip(sides, (True, False)))
            self.uncertain = False
            self.seq = m["seq"] if m["seq"] is not None else self.seq
            self.seen(m)
            return self.record(m, "snapshot")
        if not m["side"] or m["price"] is None or m["size"] is None:
            return None
        if not self.uncertain:
            side = self.bids if str(m["side"]).lower() in ("bid", "buy", "b") else self.asks
            side.put(float(m["price"]), float(m["size"]))
            if m["seq"] is not None:
                if self.seq is not None and m["seq"] - self.seq > 1:
                    self.gaps += 1
                    self.uncertain = True
                self.seq = m["seq"]
            self.seen(m)
        return self.record(m, "delta")

    def record(self, m: dict, kind: str) -> tuple:
        bid, ask = self.bids.best(), self.asks.best()
        both = bid is not None and ask is not None
        sizes = (self.bids.levels.get(bid, 0.0), self.asks.levels.get(ask, 0.0))
        micro = (ask * sizes[0] + bid * sizes[1]) / sum(sizes) if bid and ask and sum(sizes) > 0 else None
        return (m["asset_id"], m["exchange_time"], m["seq"], kind, bid, ask, (bid + ask) / 2 if both else None, ask - bid if both else None, self.bids.depth(), self.asks.depth(), micro, self.uncertain, bool(both and bid >= ask), self.inversions, self.gaps)


def replay(messages: DataFrame) -> DataFrame:
    """The book after each message of an asset, in order of exchange time and sequence. Sequential by asset, so sorted messages are walked in batches with one book, and no asset is gathered."""
    import numpy as np
    import pyarrow as pa

    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in BOOK_SCHEMA.split(", "))])
    started = starts()
    used = ["asset_id", "exchange_time", "seq", "event_type", "side", "price", "size", "bids", "asks"]
    number = F.row_number().over(W.partitionBy("asset_id").orderBy(F.asc_nulls_last("exchange_time"), F.asc_nulls_last("seq")))
    typed = {"asset_id": "string", "exchange_time": "double", "seq": "bigint", "price": "double", "size": "double"}
    known = lambda c: F.when(~F.isnan(c), c)
    ready = messages.select(*[F.col(c).cast(typed[c]).alias(c) if c in typed else c for c in used], number.alias("_row"))
    ready = ready.withColumns({c: known(F.col(c)) for c in ("price", "size", "exchange_time")})

    def run(batches):
        last, book = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            row = np.asarray(b.column("_row"))
            first, last, out = started(row, last).tolist(), row[-1], []
            for new, *values in zip(first, *[b.column(c).to_pylist() for c in used]):
                book = Book() if new else book
                record = book.apply(dict(zip(used, values)))
                if record:
                    out.append(record)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return ready.mapInArrow(run, BOOK_SCHEMA)
