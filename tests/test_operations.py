import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from oddsloom import cli
from oddsloom.operators import lifecycle
from oddsloom.plans import operations
from test_sources_and_streams import MARKETS, TRADES

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)


def test_exits(spark):
    rows = [("a", 1.0, 0.50), ("a", 2.0, 0.60), ("a", 3.0, 0.51), ("b", 1.0, 0.48), ("b", 2.0, 0.90), ("c", 1.0, 0.51), ("d", 1.0, 0.45)]
    ticks = spark.createDataFrame(rows, "position_id string, at double, mark double").withColumns({"entry_price": F.lit(0.5), "entry_time": F.lit(0.0), "side": F.when(F.col("position_id") == "d", "short"), "in_gap": F.col("mark") == 0.9})
    got = {r["position_id"]: r for r in lifecycle.exits(ticks).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {"a": "take_profit", "b": "stop_loss", "c": "open", "d": "take_profit"}
    assert (got["a"]["exit_price"], got["a"]["exit_time"]) == (0.6, 2.0) and got["c"]["exit_price"] is None
    part = {r["position_id"]: r for r in lifecycle.exits(ticks, lifecycle.Exits(stop_loss=None, trailing=0.1, partial=0.1)).collect()}
    assert (part["a"]["reason"], part["a"]["exit_time"], part["a"]["remaining"]) == ("trailing", 3.0, 0.5)
    assert part["b"]["reason"] == "gap_forced" and part["b"]["mfe"] == 0.0
    assert lifecycle.exits(ticks.where("false")).count() == 0


def test_readiness_and_watchdog(spark):
    m = spark.range(0, 80).select(F.col("id").alias("asset_id"), (F.col("id") % 20).alias("condition_id"), (F.col("id") * 9000.0).alias("exchange_time"), (F.col("id") / 80).alias("mid"), (F.col("id") * 3.0).alias("ttr_hours"), F.lit(False).alias("gap"))
    found = operations.coverage(m).first().asDict() | {"pit_metadata_ok": True, "fees_valid": True, "splits": {"train": 1, "val": 1, "locked_test": 1}}
    assert operations.readiness(found)["decision"] == "RESEARCH_READY"
    assert operations.readiness(found | {"gap_rate": 0.06, "emitting_tokens": 3, "splits": {}})["reasons"] == ["emitting_tokens is 3, under 50", "gap_rate is 0.0600", "split train is empty", "split val is empty", "split locked_test is empty"]
    assert operations.readiness(operations.coverage(m.where("false")).first().asDict())["decision"] == "NOT_READY"
    with pytest.raises(PermissionError):
        operations.require_days(100)
    late = {"id": 1, "status": "in_progress", "created_at": "2024-01-01T00:00:00Z"}
    assert operations.watchdog([late], NOW)["should_dispatch_replacement"]
    assert not operations.watchdog([late], NOW, state={"count": 2, "window_start": "2024-01-01T20:00:00Z"})["should_dispatch_replacement"]
    assert operations.watchdog([late | {"created_at": "2024-01-01T22:00:00Z"}], NOW)["healthy"]
    assert operations.watchdog([late | {"status": "completed", "conclusion": "success", "created_at": "2024-01-01T22:00:00Z"}], NOW)["latest_success_run_id"] == 1


def test_sessions(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.txt").write_text("abc")
    got = operations.fingerprints(spark, str(tmp_path)).collect()
    assert [(r["path"], r["bytes"], r["sha256"][:8]) for r in got] == [("raw/x.txt", 3, "ba7816bf")]
    rows = spark.createDataFrame([("s2", "a", 5.0, 1, "delta", 2.0), ("s1", "a", 5.0, 1, "delta", 1.0), ("s1", "a", 90000.0, 2, "delta", 1.0)], "session_id string, asset_id string, exchange_time double, seq long, event_type string, price double")
    assert [(r["session_id"], r["price"], str(r["utc_date"])) for r in operations.compact_day(rows, "1970-01-01").collect()] == [("s1", 1.0, "1970-01-01")]
    operations.one_session(rows.where("session_id = 's1'"))
    for bad in (rows, rows.where("false")):
        with pytest.raises(ValueError):
            operations.one_session(bad)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.json").write_text(json.dumps(TRADES))
    (tmp_path / "m.json").write_text(json.dumps({"data": MARKETS}))
    out = ["--lake", str(tmp_path / "lake")]

    def call(*argv):
        assert cli.main(list(argv)) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert call("ingest", *out, "--trades", str(tmp_path / "t.json"), "--markets", str(tmp_path / "m.json"))[0]["trades"] == 3
    assert call("compute-features", *out) == [{"rows": 3}]
    assert call("status", *out)[0]["resolved_trades"] == 3
    assert call("audit-data", *out)[0]["n_rows"] == 3
    assert call("outcome-gate", *out, "--train-end", "2023-11-15")[0]["verdict"] == "BLOCKED"
    assert call("backtest", *out, "--side", "")[0]["n"] == 3
    assert call("find-edges", *out, "--min-samples", "1")
    call("find-edges", *out, "--split-date", "2023-11-15", "--min-samples", "1")
    (tmp_path / "c.json").write_text("{}")
    assert cli.main(["readiness", "--coverage", str(tmp_path / "c.json")]) == 1
