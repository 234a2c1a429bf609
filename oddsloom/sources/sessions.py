"""Collected sessions on disk: their layout, records, normalised rows, validation and day bundles.

A session's own files are small records written by one process; rows of messages are read and written by Spark.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import tarfile
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.live import parse_events

#: Folders and records of a session.
FOLDERS = ("raw", "normalized", "metadata", "reports")
RECORDS = ("health.json", "validation.json", "gap_report.json", "session_manifest.json", "fingerprints.json")
HEALTH = ("health.json", "reports/collector_health.json", "collector_health.json")
#: What a path of test data looks like, and paths that only one machine has.
TEST_PATHS = ("fixtures", "books_smoke", "sample_trades", "sample_markets")
LOCAL_PATHS = re.compile(r"/Users/|C:\\|tests/fixtures", re.IGNORECASE)
LEAST_SHARE = 0.85  # of the time asked for that a session must last
SCHEMA = 1


def refuse_test_paths(*paths: str | Path) -> None:
    for p in paths:
        if any(x in str(p).replace("\\", "/").lower() for x in TEST_PATHS):
            raise ValueError(f"looks like a path of test data: {p}")


def layout(folder: str | Path) -> dict[str, Path]:
    out = {name: Path(folder) / name for name in FOLDERS}
    for p in out.values():
        p.mkdir(parents=True, exist_ok=True)
    return out


def write_record(folder: str | Path, name: str, record: Mapping) -> Path:
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(record, indent=1, default=str))
    return path


def read_record(folder: str | Path, *names: str) -> dict:
    """The first of some records that there is; empty if none is."""
    return next((json.loads((Path(folder) / n).read_text()) for n in names if (Path(folder) / n).is_file()), {})


def write_lines(rows: Iterable[Mapping], path: str | Path) -> None:
    """JSON lines, gzipped."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(r, default=str) + "\n" for r in rows)


def digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def metadata(folder: str | Path, tokens: list[str], markets: list[dict] | None = None) -> None:
    write_record(folder, "metadata/tokens.json", {"token_ids": list(map(str, tokens)), "count": len(tokens)})
    write_record(folder, "metadata/markets.json", {"markets": markets or [], "count": len(markets or [])})


def gap_report(folder: str | Path, session_id: str, health: Mapping, gaps: list[dict] | None = None, reconnects: list[dict] | None = None) -> Path:
    return write_record(folder, "gap_report.json", {"session_id": session_id, "gaps_detected": health.get("gaps_detected", 0), "reconnects": health.get("reconnects", 0), "gap_events": gaps or [], "reconnect_events": reconnects or []})


def hashes(folder: str | Path, folders: tuple[str, ...] = FOLDERS) -> dict[str, str]:
    root = Path(folder)
    return {str(p.relative_to(root)): digest(p) for name in folders for p in sorted((root / name).rglob("*")) if p.is_file()}


def fingerprint(folder: str | Path) -> dict:
    files = hashes(folder, ("raw", "normalized"))
    whole = hashlib.sha256("".join(f"{k}:{v}" for k, v in sorted(files.items())).encode()).hexdigest()
    record = {"session_id": Path(folder).name, "schema_version": SCHEMA, "files": files, "aggregate_hash": whole}
    write_record(folder, "fingerprints.json", record)
    return record


def manifest(folder: str | Path, session_id: str, start: datetime, end: datetime | None, seconds: float, selected: list[str], emitting: list[str], raw_rows: int, rows: int, extra: dict | None = None) -> dict:
    """The session's record, with a digest of every file; written as session_manifest.json."""
    found = hashes(folder) | {n: digest(Path(folder) / n) for n in ("gap_report.json", "fingerprints.json") if (Path(folder) / n).is_file()}
    utc = lambda t: t.astimezone(timezone.utc).isoformat() if t else None
    record = {
        "session_id": session_id, "start_utc": utc(start), "end_utc": utc(end), "duration_sec": float(seconds), "tokens_selected": selected, "tokens_emitting": emitting, "raw_row_count": raw_rows, "normalized_row_count": rows,
        "artifacts": {k: k for k in found}, "artifact_hashes": found, "schema_version": SCHEMA, "extra": extra or {},
    }
    write_record(folder, "session_manifest.json", record)
    return record


def strings(x) -> Iterable[str]:
    if isinstance(x, str):
        yield x
    for v in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from strings(v)


def validate(folder: str | Path, asked_seconds: float | None = None, local_paths: bool = False) -> dict:
    """{ok, errors, ...}: whether a session has what it must, its files are those of its manifest, and it lasted long enough."""
    root = Path(folder)
    files = {n: [p for p in (root / n).rglob("*") if p.is_file()] for n in ("raw", "normalized")}
    tables = [p for p in files["normalized"] if p.suffix == ".parquet"]
    health, record, prints = read_record(root, *HEALTH), read_record(root, "session_manifest.json"), read_record(root, "fingerprints.json")
    inner = health.get("health") or {}
    emitting = health.get("emitting_tokens") or inner.get("emitting_tokens") or []
    lasted = health.get("duration_sec_actual") or inner.get("duration_sec_actual")
    if lasted is None and inner.get("started_at") is not None and (inner.get("ended_at") or inner.get("last_message_at")) is not None:
        lasted = float(inner.get("ended_at") or inner["last_message_at"]) - float(inner["started_at"])
    lasted = record.get("duration_sec") if lasted is None else lasted
    errors = [f"missing {n}" for n in ("session_manifest.json", "fingerprints.json") if not (root / n).is_file()]
    errors += ["no raw files"] * (not files["raw"]) + ["no normalised tables"] * (not tables) + ["no emitting tokens"] * (not emitting)
    if lasted is not None and (asked_seconds or 0) >= 30 and float(lasted) < LEAST_SHARE * asked_seconds:
        errors.append(f"ended early: {lasted:g} of {asked_seconds:g} s")
    if record and not record.get("artifact_hashes"):
        errors.append("manifest without hashes")
    errors += [f"hash differs: {n}" for n, h in (record.get("artifact_hashes") or {}).items() if (root / n).is_file() and digest(root / n) != h]
    if prints and not prints.get("files"):
        errors.append("fingerprints without files")
    if not local_paths:
        errors += [f"path of one machine: {s[:80]}" for r in (health, record, prints) for s in strings(r) if LOCAL_PATHS.search(s)]
    return {"ok": not errors, "errors": errors, "raw_files": len(files["raw"]), "normalized_files": len(tables), "emitting_tokens": len(emitting), "manifest": record}


def partition_path(base: str | Path, utc_date: str, token_id: str) -> Path:
    return Path(base) / f"utc_date={utc_date}" / f"token_id={token_id}"


def normalized(spark: SparkSession, raw: str, session_id: str) -> DataFrame:
    """Rows of a session's raw lines (JSON, plain or gzipped): parse_events' columns with session_id and utc_date. Token ids stay text; lines that can't be read give no row."""
    rows = parse_events(spark.read.text(raw).where(F.trim("value") != ""))
    return rows.withColumns({"session_id": F.lit(session_id), "utc_date": F.to_date(F.timestamp_seconds("ts"))})


def rebuild(spark: SparkSession, raw: str, out: str, session_id: str) -> DataFrame:
    """Write normalized() anew, a folder a day and token."""
    normalized(spark, raw, session_id).write.mode("overwrite").partitionBy("utc_date", "token_id").parquet(out)
    return spark.read.option("basePath", out).schema("kind string, condition_id string, ts double, price double, size double, side string, best_bid double, best_ask double, winner string, session_id string, utc_date date, token_id string").parquet(out)


def health_of(rows: DataFrame, gap: Column | None = None) -> DataFrame:
    """One row on a session's normalised rows: rows, trades, gaps, first and last time, seconds, tokens that sent something."""
    return rows.agg(
        F.count("*").alias("normalized_rows"), F.count_if(F.col("kind") == "trade").alias("trades"), (F.count_if(gap) if gap is not None else F.lit(0)).alias("gaps_detected"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.coalesce(F.max("ts") - F.min("ts"), F.lit(0.0)).alias("duration_sec_actual"), F.countDistinct("token_id").alias("n_emitting"),
    )


def failure(health: Mapping, asked_seconds: float) -> str | None:
    """Why a session counts as failed, if it does: what is missing counts against it."""
    if not health.get("raw_rows"):
        return health.get("terminal_error") or "no raw rows"
    if not health.get("normalized_rows"):
        return "no normalised rows"
    if not (health.get("emitting_tokens") or health.get("n_emitting")):
        return "no emitting tokens"
    lasted = health.get("duration_sec_actual") or 0.0
    return f"ended early: {lasted:g} of {asked_seconds:g} s" if asked_seconds >= 30 and lasted < LEAST_SHARE * asked_seconds else None


def session_date(folder: str | Path) -> str | None:
    r = read_record(folder, "session_manifest.json")
    return r.get("utc_date") or (r.get("extra") or {}).get("utc_date") or (str(r.get("start_utc") or r.get("started_at") or "")[:10] or None)


def sessions_of(folder: str | Path, utc_date: str) -> list[Path]:
    root = Path(folder)
    return [p for p in sorted(root.iterdir()) if p.is_dir() and session_date(p) == utc_date] if root.is_dir() else []


def bundle_day(folder: str | Path, utc_date: str, out: str | Path, check: bool = True) -> dict:
    """A gzipped archive of a day's sessions and a record of what is in it; fails if a session is not valid, or none is there."""
    found = sessions_of(folder, utc_date)
    reports = [validate(p) for p in found] if check else []
    bad = next((p.name for p, r in zip(found, reports) if not r["ok"]), None)
    if not found or bad:
        return {"ok": False, "utc_date": utc_date, "error": f"session {bad} is not valid" if bad else "no sessions"}
    Path(out).mkdir(parents=True, exist_ok=True)
    path = Path(out) / f"daily-{utc_date}.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for p in found:
            tar.add(p, arcname=f"sessions/{p.name}")
    tokens = {str(t) for p in found for t in read_record(p, *HEALTH).get("emitting_tokens") or []}
    raw = sum(f.stat().st_size for p in found for f in (p / "raw").rglob("*") if f.is_file())
    record = {"ok": True, "utc_date": utc_date, "session_ids": [p.name for p in found], "n_sessions": len(found), "raw_bytes": raw, "bundle_bytes": path.stat().st_size, "bundle_sha256": digest(path), "n_emitting": len(tokens)}
    write_record(out, f"coverage_{utc_date}.json", record)
    return record


def diagnostics(spark: SparkSession, folder: str | Path) -> dict:
    """Checks of one session, which never allow a study: whether it is valid, and whether its raw lines can be read."""
    report = validate(folder)
    raw = sorted(str(p) for p in (Path(folder) / "raw").glob("*.jsonl*"))
    rows = normalized(spark, raw[0], Path(folder).name).count() if raw else 0
    return {"ok": report["ok"] and rows > 0, "session_id": Path(folder).name, "validation": report, "rows": rows, "diagnostic_only": True, "research_authorized": False, "paper_authorized": False}
