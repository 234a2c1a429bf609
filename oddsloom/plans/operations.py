"""Running a collection: sessions' fingerprints and compaction, coverage and readiness, and a watchdog over runs."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The least coverage that a study needs.
LEAST_DAYS, LEAST_TOKENS, LEAST_EVENTS, MOST_GAPS = 7, 50, 20, 0.05
SPLITS = ("train", "val", "locked_test")


def coverage(messages: DataFrame) -> DataFrame:
    """One row over book messages (asset_id, condition_id, exchange_time in seconds, mid, ttr_hours, gap): what readiness() asks for.

    Day parts are quarters of a UTC day, probability buckets tenths of mid, regimes of time to resolution a day, a week, longer.
    """
    at, day = F.col("exchange_time"), 86_400
    distinct = lambda c: F.array_sort(F.collect_set(c))  # noqa: E731  of four, ten and three values
    regime = F.when(F.col("ttr_hours") < 24, "day").when(F.col("ttr_hours") < 168, "week").when(F.col("ttr_hours").isNotNull(), "longer")
    return messages.agg(
        F.coalesce((F.max(at) - F.min(at)) / day, F.lit(0.0)).alias("calendar_days"), F.countDistinct("asset_id").alias("emitting_tokens"), F.countDistinct("condition_id").alias("independent_events"),
        distinct(F.floor(F.pmod(at, F.lit(day)) / (day / 4)).cast("int")).alias("utc_dayparts"), distinct(F.least(F.floor(F.col("mid") * 10), F.lit(9)).cast("int")).alias("probability_buckets"),
        distinct(regime).alias("ttr_regimes"), F.avg(F.col("gap").cast("double")).alias("gap_rate"),
    )


def readiness(found: dict) -> dict:
    """RESEARCH_READY, or NOT_READY with a reason for each requirement that the coverage misses.

    Asks besides coverage() for pit_metadata_ok, fees_valid and splits (name: size). What is missing counts as zero or
    false, but a missing gap_rate breaks nothing. A study is never allowed to trade.
    """
    least = {"calendar_days": LEAST_DAYS, "emitting_tokens": LEAST_TOKENS, "independent_events": LEAST_EVENTS}
    reasons = [f"{name} is {found.get(name) or 0:g}, under {n}" for name, n in least.items() if (found.get(name) or 0) < n]
    reasons += [f"fewer than two {name}" for name in ("utc_dayparts", "probability_buckets", "ttr_regimes") if len(found.get(name) or []) < 2]
    if (found.get("gap_rate") or 0) > found.get("max_gap_rate", MOST_GAPS):
        reasons.append(f"gap_rate is {found['gap_rate']:.4f}")
    reasons += [f"{name} is not true" for name in ("pit_metadata_ok", "fees_valid") if not found.get(name)]
    reasons += [f"split {name} is empty" for name in SPLITS if not (found.get("splits") or {}).get(name)]
    thin = (found.get("calendar_days") or 0) < LEAST_DAYS
    return {"decision": "NOT_READY" if reasons else "RESEARCH_READY", "research_authorized": not reasons, "paper_authorized": False, "diagnostic_only": thin, "reasons": reasons}


def require_days(hours: float) -> None:
    """PermissionError for a sample of under LEAST_DAYS days."""
    if hours / 24 < LEAST_DAYS:
        raise PermissionError(f"{hours:g} hours are under {LEAST_DAYS} days: diagnostics only")


def watchdog(runs: list[dict], now: datetime | None = None, slack_minutes: int = 90, window_hours: float = 7.0, most_redispatches: int = 2, state: dict | None = None) -> dict:
    """Health of collection runs (id, status, conclusion, created_at, duration_seconds), and whether to start another.

    Healthy: a success within the window, or a run that is queued or going and not over its duration and slack.
    At most so many restarts in twelve hours; state holds their count and window_start.
    """
    time = lambda s: datetime.fromisoformat(s.replace("Z", "+00:00"))
    now, state = now or datetime.now(timezone.utc), state or {}
    known = sorted((r for r in runs if r.get("created_at")), key=lambda r: r["created_at"], reverse=True)
    won = [r for r in known if r.get("status") == "completed" and r.get("conclusion") == "success"]
    going = [r for r in known if r.get("status") in ("in_progress", "queued")]
    late = [r for r in going if now > time(r["created_at"]) + timedelta(seconds=float(r.get("duration_seconds") or 18_000), minutes=slack_minutes)]
    failed = [r for r in known if r.get("status") in ("failure", "cancelled", "timed_out") or r.get("status") == "completed" and r.get("conclusion") not in (None, "success")]
    healthy = bool(won and time(won[0]["created_at"]) >= now - timedelta(hours=window_hours)) or len(late) < len(going)
    start = state.get("window_start")
    count = 0 if start and now - time(start) > timedelta(hours=12) else int(state.get("count") or 0)
    return {
        "healthy": healthy, "issues": [f"run {r.get('id')} is overdue" for r in late] + [f"run {r.get('id')} failed" for r in failed], "latest_success_run_id": won[0].get("id") if won else None,
        "should_dispatch_replacement": not healthy and count < most_redispatches, "redispatch_count": count,
    }


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a session's folder; executors read and digest them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    return files.select(F.regexp_replace("path", F.concat(F.lit(r"^.*\Q"), F.lit(root), F.lit(r"\E/")), F.lit("")).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def one_session(rows: DataFrame, column: str = "session_id") -> None:
    """ValueError unless all rows have the same session."""
    got = rows.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    if got["a"] is None or got["a"] != got["b"] or got["nulls"]:
        raise ValueError(f"rows are not of one {column}")


def compact_day(sessions: DataFrame, utc_date: str, identity: tuple[str, ...] = ("asset_id", "exchange_time", "seq", "event_type")) -> DataFrame:
    """A day's rows of all sessions with utc_date, each identity once: the one of the least session_id."""
    day = F.to_date(F.timestamp_seconds("exchange_time"))
    rest = [c for c in sessions.columns if c not in identity]
    kept = sessions.where(day == F.lit(utc_date).cast("date")).groupBy(*identity).agg(F.min_by(F.struct(*rest), F.struct("session_id", *[c for c in rest if c != "session_id"])).alias("_r"))
    return kept.select(*identity, *[F.col("_r")[c].alias(c) for c in rest]).withColumn("utc_date", F.lit(utc_date).cast("date"))
