"""Exits of open positions and gates of new ones, as expressions over running windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Exits:
    """Thresholds of returns as fractions of the entry price; None: the rule is off."""

    take_profit: float | None = 0.05
    stop_loss: float | None = 0.03
    trailing: float | None = None
    break_even: float | None = None
    partial: float | None = None
    partial_fraction: float = 0.5
    max_hold_s: float | None = None
    spread_multiple: float = 3.0
    imbalance_drop: float = 0.5
    least_ttr_hours: float | None = 1.0
    hold_in_gaps: bool = False
    scale_by_volatility: bool = False


def optional(df: DataFrame, column: str, kind: str = "double") -> Column:
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def exits(ticks: DataFrame, rules: Exits = Exits(), key: str = "position_id", order: tuple[str, ...] = ("at", "mark")) -> DataFrame:
    """One row a position: reason ('open' without one), exit_price, exit_time, mfe, mae, partial_taken, remaining.

    ticks: key, at (seconds), mark, entry_price, entry_time, and where there is one: side (long or short),
    spread, entry_spread, imbalance, entry_imbalance, ttr_hours, in_gap, logit_vol. The first tick on which a
    rule holds ends the position; of several rules the first counts: gap, take profit, trailing, stop, time,
    spread, imbalance, time to resolution. The first take profit above `partial` only sells a part. Once past
    break_even, a tick's own stop is the entry. Positions meet in their key's window, one shuffle in all.
    """
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    off = F.lit(False)
    short = F.coalesce(optional(ticks, "side", "string") == "short", off)
    raw = F.when(F.col("entry_price") > 0, (F.col("mark") - F.col("entry_price")) / F.col("entry_price")).otherwise(0.0)
    gap = off if rules.hold_in_gaps else F.coalesce(optional(ticks, "in_gap", "boolean"), off)
    volatility = optional(ticks, "logit_vol")
    scaled = (volatility > 0) if rules.scale_by_volatility else off
    limit = lambda x, default: F.when(scaled, volatility * (x or default)).otherwise(F.lit(x).cast("double"))

    df = ticks.withColumns({"_gap": gap, "_ret": F.when(~gap, F.when(short, -raw).otherwise(raw)), "_take": limit(rules.take_profit, 0.05), "_stop": limit(rules.stop_loss, 0.03)})
    if rules.break_even is not None:
        df = df.withColumn("_stop", F.when(F.col("_ret") >= rules.break_even, 0.0).otherwise(F.col("_stop")))
    ret, take = F.col("_ret"), F.coalesce(F.col("_ret") >= F.col("_take"), off)
    enough = take & (ret >= rules.partial) if rules.partial is not None else off
    df = df.withColumns({"_take_hit": take, "_enough": F.coalesce(enough, off)})
    df = df.withColumns({"_best": F.max("_ret").over(w), "_worst": F.min("_ret").over(w), "_part_before": F.coalesce(F.max("_enough").over(before), off)})
    part_now = F.col("_enough") & ~F.col("_part_before")
    rule = [
        ("gap_forced", F.col("_gap")),
        ("take_profit", F.col("_take_hit") & ~part_now),
        ("trailing", F.col("_best") - ret >= rules.trailing if rules.trailing is not None else off),
        ("stop_loss", ret <= -F.abs("_stop")),
        ("time_stop", F.col("at") - F.col("entry_time") >= rules.max_hold_s if rules.max_hold_s is not None else off),
        ("spread_blowout", optional(ticks, "spread") > optional(ticks, "entry_spread") * rules.spread_multiple),
        ("imbalance_reversal", ~short & (optional(ticks, "imbalance") < optional(ticks, "entry_imbalance") - rules.imbalance_drop)),
        ("ttr_forced", optional(ticks, "ttr_hours") <= rules.least_ttr_hours if rules.least_ttr_hours is not None else off),
    ]
    reason = F.coalesce(*[F.when(hit, name) for name, hit in rule])
    taken = F.col("_part_before") | F.col("_enough")
    state = F.struct(
        reason.alias("reason"), F.when(reason.isNotNull(), F.col("mark")).alias("exit_price"), F.when(reason.isNotNull(), F.col("at")).alias("exit_time"),
        F.greatest("_best", F.lit(0.0)).alias("mfe"), F.least("_worst", F.lit(0.0)).alias("mae"), taken.alias("partial_taken"), F.when(taken, 1 - rules.partial_fraction).otherwise(1.0).alias("remaining"),
    )
    place = F.struct(*order)
    ended = df.withColumn("_state", state).groupBy(key).agg(F.coalesce(F.min_by("_state", F.when(F.col("_state.reason").isNotNull(), place)), F.max_by("_state", place)).alias("s"))
    return ended.select(key, F.coalesce("s.reason", F.lit("open")).alias("reason"), "s.exit_price", "s.exit_time", "s.mfe", "s.mae", "s.partial_taken", "s.remaining")


@dataclass(frozen=True)
class RiskLimits:
    position: float = 0.05  # of equity, as are gross and event
    open_positions: int = 25
    gross: float = 0.50
    event: float = 0.10
    drawdown_pct: float = 20.0
    cooldown_s: float = 60.0
    least_ttr_hours: float | None = None
    most_ttr_hours: float | None = None


def entry_gate(df: DataFrame, limits: RiskLimits = RiskLimits()) -> Column:
    """'ok' or the first limit that an entry breaks.

    df: notional, now, equity, peak_equity, n_open, gross, event_exposure, last_entry, and ttr_hours where known.
    Shares of equity don't bind while equity is zero or less; nulls break no limit.
    """
    equity, ttr = F.col("equity"), optional(df, "ttr_hours")
    share = lambda x: F.when(equity > 0, x / equity)
    broken = [
        ("max_drawdown_halt", F.when(F.col("peak_equity") > 0, 100 * (F.col("peak_equity") - equity) / F.col("peak_equity")).otherwise(0.0) >= limits.drawdown_pct),
        ("max_open_positions", F.col("n_open") >= limits.open_positions),
        ("cooldown", F.col("now") - F.col("last_entry") < limits.cooldown_s),
        ("max_position_pct", share(F.col("notional")) > limits.position),
        ("max_gross_exposure", share(F.col("gross") + F.col("notional")) > limits.gross),
        ("per_event_cap", share(F.coalesce("event_exposure", F.lit(0.0)) + F.col("notional")) > limits.event),
    ]
    broken += [("ttr_too_low", ttr < limits.least_ttr_hours)] if limits.least_ttr_hours is not None else []
    broken += [("ttr_too_high", ttr > limits.most_ttr_hours)] if limits.most_ttr_hours is not None else []
    return F.coalesce(*[F.when(hit, name) for name, hit in broken], F.lit("ok"))
