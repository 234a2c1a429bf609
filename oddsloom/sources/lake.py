"""Raw files to a partitioned Parquet lake, and the lake's views."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import normalize, schemas

SEED_DATE = "1970-01-01"


def read_raw(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A file or folder of csv, json (a list, {"data": [...]} or one object), ndjson, jsonl or parquet, with source_file."""
    kind = kind or path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        df = spark.read.csv(path, header=True, mode="PERMISSIVE")
    elif kind in ("ndjson", "jsonl"):
        df = spark.read.json(path)
    elif kind == "json":
        df = spark.read.json(path, multiLine=True)
        wrapped = next((c for c in ("data", "results", "trades", "markets") if len(df.columns) == 1 and c in df.columns), None)
        if wrapped:
            df = df.select(F.explode(wrapped).alias("_r")).select("_r.*")
            return df.withColumn("source_file", F.lit(path))
    elif kind == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(path)
    else:
        raise ValueError(f"no reader for {kind}")
    return df if "source_file" in df.columns else df.withColumn("source_file", F.col("_metadata.file_path"))


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union by name; of rows with the same keys the one with the greatest order stays."""
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    latest = W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
    return both.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside the path, then take its place, as the path may be read from meanwhile."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(fs_path(path), True)
    fs.rename(fs_path(staged), fs_path(path))


def write_trades(trades: DataFrame, lake: str) -> None:
    """Upsert by trade_id into date partitions; partitions without new rows stay as they are."""
    spark, path = trades.sparkSession, f"{lake}/trades"
    new = trades.withColumn("date", F.to_date("traded_at"))
    if not exists(spark, path):
        upsert(None, new, ["date", "trade_id"], "ingest_at").repartition("date").write.partitionBy("date").parquet(path)
        return
    old = spark.read.parquet(path).join(F.broadcast(new.select("date").distinct()), "date", "left_semi")  # days
    merged = upsert(old, new, ["date", "trade_id"], "ingest_at")
    staged = f"{path}.{uuid.uuid4().hex}"
    merged.write.partitionBy("date").parquet(staged)
    spark.read.parquet(staged).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs_path(staged).getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path(staged), True)


def write_markets(markets: DataFrame, lake: str) -> None:
    spark = markets.sparkSession
    for name, new, keys in (("markets", markets, ["condition_id"]), ("market_tokens", normalize.market_tokens(markets).withColumn("ingest_at", F.current_timestamp()), ["condition_id", "token_id"])):
        path = f"{lake}/{name}"
        old = spark.read.parquet(path) if exists(spark, path) else None
        swap_in(upsert(old, new, keys, "ingest_at"), path)


def ingest(spark: SparkSession, lake: str, trades: list[str] = (), markets: list[str] = ()) -> dict[str, int]:
    """Read, normalise and upsert raw files; counts of distinct trades, markets and tokens in the lake."""
    for path in trades:
        write_trades(normalize.normalize_trades(read_raw(spark, path))[0], lake)
    for path in markets:
        write_markets(normalize.normalize_markets(read_raw(spark, path)), lake)
    views(spark, lake)
    return {"trades": spark.table("v_trades").select("trade_id").distinct().count(), "markets": spark.table("v_markets").count(), "market_tokens": spark.table("v_market_tokens").count()}


def views(spark: SparkSession, lake: str) -> None:
    """v_trades, v_markets, v_market_tokens, v_resolved_trades, and with features v_features and v_trade_features."""
    from ..operators.features import resolved_trades

    for name, schema in (("trades", schemas.TRADES), ("markets", schemas.MARKETS), ("market_tokens", schemas.MARKET_TOKENS)):
        path = f"{lake}/{name}"
        df = spark.read.option("mergeSchema", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        if "date" in df.columns:
            df = df.where(F.col("date") != F.lit(SEED_DATE).cast("date")).drop("date")
        df.createOrReplaceTempView(f"v_{name}")
    resolved = resolved_trades(spark.table("v_trades"), spark.table("v_markets"))
    resolved.createOrReplaceTempView("v_resolved_trades")
    if exists(spark, f"{lake}/features"):
        spark.read.parquet(f"{lake}/features").createOrReplaceTempView("v_features")
        f = spark.table("v_features")
        extra = [c for c in f.columns if c not in resolved.columns]
        resolved.join(f.select("trade_id", *extra), "trade_id").createOrReplaceTempView("v_trade_features")


def compute_features(spark: SparkSession, lake: str) -> DataFrame:
    """Features of the lake's trades, written as its features table."""
    from ..operators.features import trade_features

    views(spark, lake)
    swap_in(trade_features(spark.table("v_trades"), spark.table("v_markets")), f"{lake}/features")
    views(spark, lake)
    return spark.table("v_trade_features")


def status(spark: SparkSession) -> DataFrame:
    """One row of counts, share of resolved markets, time range and resolved trades."""
    t = spark.table("v_trades").agg(F.count("*").alias("trades"), F.min("traded_at").alias("first_trade"), F.max("traded_at").alias("last_trade"))
    m = spark.table("v_markets").agg(F.count("*").alias("markets"), F.coalesce(100 * F.avg(F.col("resolved").cast("double")), F.lit(0.0)).alias("resolved_pct"))
    return t.crossJoin(m).crossJoin(spark.table("v_resolved_trades").agg(F.count("*").alias("resolved_trades")))
