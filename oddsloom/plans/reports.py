"""Reports as text: tables of a few rows that a terminal shows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(rows: Sequence[Mapping], columns: Mapping[str, str], title: str | None = None) -> str:
    """Lines of aligned cells. columns: name to format, such as {"pnl": "+.2f"}; a missing value is a dash."""

    def cell(row: Mapping, name: str, how: str) -> str:
        v = row.get(name)
        return "-" if v is None else str(v)[: int(how[1:])] if how.startswith("s") else format(v, how)

    cells = [list(columns), *[[cell(r, n, how) for n, how in columns.items()] for r in rows]]
    widths = [max(len(line[i]) for line in cells) for i in range(len(columns))]
    lines = [" | ".join(x.rjust(w) for x, w in zip(line, widths)) for line in cells]
    lines.insert(1, "-+-".join("-" * w for w in widths))
    return "\n".join(([title] if title else []) + lines)


def oos_table(rows: Sequence[Mapping]) -> str:
    return table(rows, {"label": "s48", "train_n": "d", "train_ev_pct": "+.2f", "test_n": "d", "test_ev_pct": "+.2f", "ev_decay": "+.2f", "persists": "s5"}, "in sample and out of sample")


def leaderboard_table(rows: Sequence[Mapping]) -> str:
    best = sorted(rows, key=lambda r: -(r.get("total_pnl") or 0.0))
    return table(best, {"profile": "s24", "total_pnl": "+.2f", "roi_pct": "+.2f", "win_rate_pct": ".1f", "fills": "d", "fees": ".4f", "max_drawdown_pct": ".2f", "equity": ".2f"}, "profiles")


def journal(fills: DataFrame, bankroll: float = 10_000.0) -> DataFrame:
    """A row a profile of a log of fills (profile, ts, action, pnl, fee, cash): what a journal says of it. Equity is cash; open positions are counted apart."""
    has_fee = "fee" in fills.columns
    closed = F.col("action") != "open"
    won = F.count_if(closed & (F.col("pnl") > 0))
    n = F.count_if(closed)
    by = fills.groupBy("profile").agg(
        F.count_if(~closed).alias("fills"), n.alias("n_closed"), (F.count_if(~closed) - n).alias("n_open"), F.coalesce(F.sum(F.when(closed, F.col("pnl"))), F.lit(0.0)).alias("realized_pnl"),
        (F.sum("fee") if has_fee else F.lit(0.0)).alias("fees"), F.when(n > 0, 100.0 * won / n).otherwise(0.0).alias("win_rate_pct"), F.max_by("cash", "ts").alias("cash"),
    )
    return by.withColumns({"total_pnl": F.col("realized_pnl"), "roi_pct": 100 * F.col("realized_pnl") / bankroll, "equity": F.col("cash"), "bankroll": F.lit(bankroll)})


def dashboard(rows: Sequence[Mapping], recent: Sequence[Mapping] = ()) -> str:
    """Profiles, and the last fills under them."""
    out = leaderboard_table(rows)
    return out + ("\n\n" + table(recent, {"ts": ".0f", "profile": "s24", "token_id": "s16", "action": "s12", "price": ".3f", "pnl": "+.2f"}, "last fills") if recent else "")
