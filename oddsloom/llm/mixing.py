"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates r of documents that stay closest in entropy to one copy each, under the constraint that each source's
tokens sum to its target, have the form r = min(2, exp(lambda * size / mean size)) with one lambda a source: the
solution of a convex dual, found by Newton steps whose sums are aggregations over (source, size) counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import documents, fresh, materialize

WEIGHTS = (3, 1, 2)  # of the sources by code point, null last, repeating
SHARE = 1.5  # of all tokens
MOST = 2  # copies
STEPS = 200
TOLERANCE = 1e-7
BUCKET = 1_000  # documents of a source that are rounded together


def words_of(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: (source, source_size). Adds target: shares by weight, none above most times its size, the excess reshared.

    One level theta makes them all, target = min(most * size, weight * theta); it rises until no more sources are full.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())  # a row a source
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    by = materialize(sizes.withColumn("weight", pick.cast("double")).withColumn("full", F.lit(False)), "targets")
    while True:
        cap = most * F.col("source_size")
        left = F.sum("source_size") * share - F.sum(F.when(F.col("full"), cap).otherwise(0))
        theta = by.agg((left / F.sum(F.when(~F.col("full"), F.col("weight")))).alias("theta"))  # one row
        now = by.crossJoin(F.broadcast(theta)).withColumn("over", ~F.col("full") & (F.col("weight") * F.col("theta") >= cap))
        if not now.agg(F.max("over")).first()[0]:
            return materialize(now.select("source", "source_size", F.when(F.col("full"), cap).otherwise(F.col("weight") * F.col("theta")).cast("double").alias("target")), "targets")
        by = materialize(now.select("source", "source_size", "weight", (F.col("full") | F.col("over")).alias("full")), "targets")


def multipliers(counts: DataFrame, most: int = MOST) -> DataFrame:
    """The dual's solution: (source, lam) from counts (source, size, n, mean, target).

    Newton steps of all sources at once, kept inside a bracket that each step narrows; a step that leaves it is
    replaced by a bisection. A source whose target is most times its size has no finite solution; its lam is null.
    """
    state = counts.groupBy("source").agg(F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(1.0).alias("gap"))
    state = materialize(state, "dual")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(5.0)))
        free = tilt < most
        sums = counts.join(state.drop("gap").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source", "lam", "lo", "hi", "target").agg(
            F.sum(F.col("n") * F.col("size") * F.least(tilt, F.lit(float(most)))).alias("f"),
            F.sum(F.when(free, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"),
        )
        over = F.col("f") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - (F.col("f") - F.col("target")) / F.col("slope"))
        bounded = sums.select("source", "lam", lo.alias("lo"), hi.alias("hi"), newton.alias("step"), (F.abs(F.col("f") - F.col("target")) / F.greatest("target", F.lit(1.0))).alias("gap"))
        middle = F.when(F.abs("lo") + F.abs("hi") < 1e4, (F.col("lo") + F.col("hi")) / 2).when(F.col("lo") > -1e4, F.col("lo") * 2 + 1).otherwise(F.col("hi") * 2 - 1)
        moved = F.when(F.col("gap") < TOLERANCE, F.col("lam")).when((F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi")), F.col("step")).otherwise(middle)
        state = materialize(bounded.select("source", moved.alias("lam"), "lo", "hi", "gap"), "dual")
        if (state.agg(F.max("gap")).first()[0] or 0.0) < TOLERANCE:
            break
    else:
        raise ArithmeticError(f"a source's rates are not within {TOLERANCE} of its target after {STEPS} steps")
    return state.select("source", F.round("lam", 9).alias("lam"))  # so that the order of sums decides nothing


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Copies of each document: (id_col, size, source_size, target, copies, taken), one row per input row.

    size: words of the text, null 0. Targets: see targets(). Rates are rounded to 0, 1 or 2 copies by running sums
    over documents of like size, then single copies of short documents close what is left. taken = copies * size.
    A null source is a source; documents without words have one copy and take nothing; rows that repeat an id are
    rounded on their own; a table without words has targets of 0; an empty table gives no rows. Reruns agree: order
    among equal sizes is by hash of the id, then the id. A source's documents are rounded in buckets of about BUCKET.
    """
    words = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(source_col).cast("string").alias("source"), words_of(F.col(text_col)).alias("size"))
    rows = materialize(words, "sizes")
    counts = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("docs"))
    goal = targets(sizes.select("source", "source_size"), weights, share)
    goal = materialize(sizes.select("source", "docs").join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "goal")
    mean = F.col("source_size") / F.col("docs")
    open_ = goal.where(F.col("target") < MOST * F.col("source_size")).select(F.col("source").alias("s"), mean.alias("mean"), "target")
    dual = multipliers(materialize(counts.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "dual_counts"))
    solved = materialize(goal.join(dual.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("mean", mean), "solved")
    solved = solved.withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(MOST)).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(5.0)))))
    rated = rows.join(solved, F.col("source").eqNullSafe(F.col("s"))).drop("s").select(
        "_id", "source", "size", "source_size", "target", rate.alias("rate"), F.xxhash64("_id").alias("h"),
        F.pmod(F.xxhash64("_id", F.lit(1)), F.ceil(F.col("docs") / BUCKET)).alias("bucket"),
    )
    by = W.partitionBy("source", "bucket")
    order = by.orderBy(F.col("size").desc(), "h", "_id").rowsBetween(W.unboundedPreceding, 0)
    part = F.col("rate") - F.floor("rate")
    passed = F.sum(part).over(order)
    extra = F.floor(passed + 0.5 + 1e-9) - F.floor(passed - part + 0.5 + 1e-9)
    rounded = rated.withColumn("copies", F.least(F.floor("rate") + extra, F.lit(MOST)).cast("long"))
    gap = F.sum(F.col("rate") * F.col("size")).over(by) - F.sum(F.col("copies") * F.col("size")).over(by)
    able = (F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
    rounded = rounded.withColumn("gap", gap)
    fits = able & (F.col("size") <= F.abs("gap"))
    used = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(by.orderBy("size", "h", "_id").rowsBetween(W.unboundedPreceding, 0))
    copies = F.when(fits & (used <= F.abs("gap")), F.col("copies") + F.signum("gap").cast("long")).otherwise(F.col("copies"))
    return rounded.withColumn("copies", copies).select(F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has copies of it. An id's rows have the most copies of any of them; null ids are one id."""
    key, copies, copy = (fresh(docs.columns, c) for c in ("_id", "_copies", "_copy"))
    mixed = mix(docs).groupBy("doc_id").agg(F.max("copies").alias(copies)).withColumnRenamed("doc_id", key)
    joined = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(key)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)
