"""Shared helpers: materialised intermediates in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh local one in local mode; on a cluster, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="oddsloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/oddsloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def trim_driver(spark: SparkSession) -> str | None:
    """What the driver's JVM says of returning the native memory that it has freed to the system; None where it can't.

    Its compiler threads free much of that after each plan, which the C library would keep.
    """
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    call = gateway.new_array(jvm.java.lang.Object, 4)  # the bean, the command, and no arguments
    try:
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:
        return None


BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts that go to Python workers and back, in the session; what it has set itself stays."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def fresh(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to clash with none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


HOT = 1_000  # keys that are broadcast at most


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of rows with a table that has one row a key and n, the rows of that key among total.

    Keys with over a HOT-th of total are broadcast, of which there are under HOT, so no task gathers the rows of one;
    all others are joined by key.
    """
    often = F.col("n") * HOT > total
    hot = table.where(often)
    rest = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(table.where(~often), keys))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SMALL = 1 << 17  # different edges of a graph that one task takes as a whole, at 16 bytes each


def roots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of the nodes of all edges (u, v) of batches, by union and find."""
    parts = [pdf[["u", "v"]].to_numpy(dtype=np.int64) for pdf in batches]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate(parts), return_inverse=True)
    up = list(range(len(nodes)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in ends.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": nodes, "component": nodes[[find(x) for x in range(len(nodes))]]})


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as edges (u, v) of longs.

    A graph of up to SMALL different edges is solved by one task on an executor, as rounds would cost the driver a few
    plans and stages each. A larger one alternates large-star and small-star steps; every step is an aggregation by node
    and a join, so a node with very many neighbours is pre-aggregated before the shuffle and its join can be split.
    Returns (node, component), one row per node with an edge; component is the smallest node of its component. No
    edges: no rows.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if edges.count() <= SMALL:
        return materialize(edges.coalesce(1).mapInPandas(roots_of, "node long, component long"), "roots")
    return star_rounds(edges)


def star_rounds(edges: DataFrame) -> DataFrame:
    """connected_components of different edges (u, v), v the smaller, however many."""
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
