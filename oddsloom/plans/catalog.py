"""Features by name: what each needs and how it is computed, with reports on them; staged searches and layered settings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import features
from . import operations


@dataclass(frozen=True)
class Feature:
    """columns: what the frame must have; compute adds the feature's columns. Without compute it is a name to be filled."""

    name: str
    category: str
    columns: tuple[str, ...] = ()
    compute: Callable[[DataFrame], DataFrame] | None = None
    safe: bool = True  # known at the time of the row

    @property
    def status(self) -> str:
        return "implemented" if self.compute else "stub"


def column(name: str, category: str, columns: str, make: Callable[..., Column]) -> Feature:
    needed = tuple(columns.split())
    return Feature(name, category, needed, lambda df: df.withColumn(name, make(*map(F.col, needed))))


def sizes(levels: Column) -> Column:
    return F.transform(levels, lambda x: x["size"])


FEATURES = {f.name: f for f in (
    column("logit_price", "prediction_market", "price", X.logit), column("logit_edge_vs_half", "prediction_market", "price", lambda p: -X.logit(p)), column("arcsine_price", "technical", "price", X.arcsine),
    column("ttr_info_hazard", "prediction_market", "time_to_resolution_hours", X.ttr_hazard), column("complete_set_residual", "prediction_market", "yes_mid no_mid", lambda y, n: X.complement_deviation(y, n)),
    Feature("delta_logit", "prediction_market", ("token_id", "traded_at", "trade_id", "price"), features.logit_columns), Feature("logit_technicals", "technical", ("token_id", "traded_at", "trade_id", "price"), features.logit_technicals),
    Feature("rolling", "legacy", ("token_id", "traded_at", "trade_id", "price", "size", "notional"), features.rolling_features), Feature("composites", "legacy", ("price_delta_1h", "whale_ratio", "time_to_resolution_hours"), features.composites),
    column("abs_spread", "book_state", "best_bid best_ask", X.abs_spread), column("rel_spread", "book_state", "best_bid best_ask", X.rel_spread), column("logit_spread", "book_state", "best_bid best_ask", X.logit_spread),
    column("microprice", "book_state", "best_bid bid_size best_ask ask_size", X.microprice), column("multi_level_imbalance", "book_state", "bids asks", lambda b, a: X.multi_level_imbalance(sizes(b), sizes(a))),
    column("distance_weighted_imbalance", "book_state", "bids asks mid", X.distance_weighted_imbalance), column("book_slope_bid", "book_state", "bids", lambda b: X.book_slope(b, "bid")), column("book_slope_ask", "book_state", "asks", lambda a: X.book_slope(a, "ask")),
    column("depth_concentration", "book_state", "bids", lambda b: X.depth_concentration(sizes(b))), column("depth_entropy", "book_state", "bids", lambda b: X.depth_entropy(sizes(b))), column("liquidity_walls", "book_state", "bids", lambda b: X.liquidity_wall(sizes(b))),
    column("boundary_adjusted_depth", "book_state", "bid_depth mid", X.scaled_by_p), column("trade_aggression", "microstructure", "price best_bid best_ask", X.trade_aggression), Feature("book_columns", "microstructure", ("price",), features.book_columns),
    column("resolution_proximity", "pm_structure", "time_to_resolution_hours", X.resolution_proximity), column("ttr_decay", "pm_structure", "time_to_resolution_hours", X.ttr_decay), column("probability_bucket", "pm_structure", "price", X.prob_bucket),
    Feature("calibration_residual", "prediction_market", ("price", "token_won"), safe=False), Feature("inventory_risk_cap", "risk"), Feature("news_sentiment", "exogenous", safe=False),
)}


def feature(name: str) -> Feature:
    """KeyError for a name that isn't known."""
    return FEATURES[name]


def listed(category: str | None = None, status: str | None = None) -> list[Feature]:
    return sorted((f for f in FEATURES.values() if category in (None, f.category) and status in (None, f.status)), key=lambda f: (f.category, f.name))


def apply(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the named features, in order; those that aren't known or computed change nothing, a missing column is an error."""
    for n in names:
        f = FEATURES.get(n)
        if f is None or f.compute is None:
            continue
        missing = [c for c in f.columns if c not in df.columns]
        if missing:
            raise ValueError(f"{n} needs {', '.join(missing)}")
        df = f.compute(df)
    return df


def summary() -> dict[str, Any]:
    """Features by category and status."""
    out: dict[str, Any] = {"total": len(FEATURES), "by_status": {}, "by_category": {}}
    for f in FEATURES.values():
        out["by_status"][f.status] = out["by_status"].get(f.status, 0) + 1
        by = out["by_category"].setdefault(f.category, {"total": 0})
        by["total"] += 1
        by[f.status] = by.get(f.status, 0) + 1
    return out


def coverage_of(df: DataFrame) -> DataFrame:
    """One row: for every feature column that df has, the share of rows with a value."""
    have = [n for n in FEATURES if n in df.columns]
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(F.col(c).isNotNull().cast("double")), F.lit(0.0)).alias(c) for c in have])


#: Stages of a search that only describe, and those that decide.
DESCRIBING, DECIDING = (1, 2), (3, 4, 5)


def staged_search(stage: int, found: dict, thin_diagnostics: bool = True) -> dict:
    """Whether a stage may run on a collection with this coverage (operations.readiness): deciding stages only on a ready one."""
    verdict = operations.readiness(found)
    ready = verdict["decision"] == "RESEARCH_READY"
    status = "completed" if stage in DECIDING and ready else "diagnostic_only" if stage in DESCRIBING and (ready or thin_diagnostics) else "blocked"
    return {"stage": stage, "status": status, "research_authorized": status == "completed", "paper_authorized": False, "non_definitive": status == "diagnostic_only", "reasons": verdict["reasons"]}


def merged(base: Mapping, over: Mapping) -> dict:
    return dict(base) | {k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}


def settings(config: Mapping, family: str | None = None, category: str | None = None, liquidity: str | None = None, ttr: str | None = None) -> dict:
    """The global layer, with those of a family, a category, and regimes of liquidity and time to resolution over it, in that order."""
    regimes = config.get("regimes") or {}
    out = dict(config.get("global") or {})
    for layers, key in ((config.get("families"), family), (config.get("categories"), category), (regimes.get("liquidity"), liquidity), (regimes.get("ttr"), ttr)):
        layer = layers.get(key) if isinstance(layers, Mapping) and key else None
        out = merged(out, layer) if isinstance(layer, Mapping) else out
    return out
