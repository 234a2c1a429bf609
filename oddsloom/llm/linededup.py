"""Line dedup: later copies of runs of lines go, found by prefix doubling over the suffixes of line-ID sequences.

A document is its sequence of line IDs, a suffix all lines from one on. Round 0 sorts the different lines and gives
each suffix the place of its first line; round k sorts the different pairs of a place and the place 2 ** (k - 1)
lines on, which orders the suffixes by their first 2 ** k lines. Suffixes of equal place are an interval of the
suffix array with a longest common prefix of 2 ** k lines or more; those alone in their place leave the array. Two
overlapping prefixes name an interval of any length in between. Only different keys are sorted, so a line that very
many documents share is a row of that sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, fresh, join_hot, materialize, text_batches

MIN_WORDS = 3  # of a repeated run; shorter ones, such as a closing bracket or a single word, stay unless they are part of a longer one


def line_rows(texts: list[str | None], min_words: int = MIN_WORDS) -> pd.DataFrame:
    """A row for each line with a word: text number n, line number i among those, name (a, b), and two lengths.

    ahead: lines of the shortest run from here that has min_words words, back: of the shortest run that ends here; 0
    if the text has too few.
    """
    out = []
    for n, text in enumerate(texts):
        lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x and not x.isspace()]
        if not lines:
            continue
        words = np.cumsum([0] + [len(x.split()) for x in lines])
        at = np.arange(len(lines))
        stop = np.searchsorted(words, words[:-1] + min_words, side="left")
        ahead = np.where(stop <= len(lines), stop - at, 0)
        start = np.searchsorted(words, words[1:] - min_words, side="right") - 1
        back = np.where(words[1:] >= min_words, at - start + 1, 0)
        names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), dtype=">i8").astype(np.int64).reshape(-1, 2)
        out.append((np.full(len(lines), n), at, names[:, 0], names[:, 1], ahead, back))
    parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6
    return pd.DataFrame(dict(zip(("n", "i", "a", "b", "ahead", "back"), parts)))


def kept_lines(text: str, starts: list[int], sizes: list[int]) -> tuple[str, int, int]:
    """The text without the runs (start, size in lines with a word), its lines with a word, and how many of them go."""
    lines = text.split("\n")
    real = [j for j, x in enumerate(lines) if x.encode("utf-8", "surrogatepass").strip()]
    gone = {real[i] for s, n in zip(starts, sizes) for i in range(s, s + n)}
    return "\n".join(x for j, x in enumerate(lines) if j not in gone), len(real), len(gone)


def placed(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows whose keys another row has too, with r, the place of their keys in the order of keys (ascending, with gaps)."""
    total = rows.count()
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    order = materialize(twice.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id()), f"order{k}")
    return join_hot(rows, order, keys, total).drop(*keys, "n")


def later_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, h, start, size): runs of lines of which an earlier copy exists, by (id, h, start), h a hash of the text.

    The runs are the shortest ones of min_words words from a line on or up to a line. Every line of a longer
    repeated run lies in one of these, so their union is the union of all maximal repeated runs of min_words words,
    and the doubling ends at the longest of them. The first copy stays: a later one in the same document counts from
    where the first ends.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                block = pdf.iloc[at : at + 1000]
                rows = line_rows(block["_text"].tolist(), min_words)
                n = rows.pop("n").to_numpy(dtype=np.int64)
                yield pd.concat([block[["id", "h"]].iloc[n].reset_index(drop=True), rows], axis=1)

    text_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("_text")).where("_text is not null")
    lines = materialize(given.mapInPandas(run, "id long, h long, i int, a long, b long, ahead int, back int"), "lines")
    first = materialize(placed(materialize(lines.dropDuplicates(["id", "h", "i"]), "different_lines"), ["a", "b"], 0), "suffixes0")
    longest = first.agg(F.max(F.greatest("ahead", "back"))).first()[0] or 0
    level = first.select("id", "h", "i", "r")
    suffixes = level.withColumn("k", F.lit(0))
    k = 0
    while 2 << k <= longest:
        after = level.select(F.col("id").alias("id2"), F.col("h").alias("h2"), (F.col("i") - (1 << k)).alias("i2"), F.col("r").alias("r2"))
        pairs = level.withColumnRenamed("r", "r1").join(after, F.expr("id <=> id2 and h = h2 and i = i2")).select("id", "h", "i", "r1", "r2")
        k += 1
        level = materialize(placed(materialize(pairs, f"pairs{k}"), ["r1", "r2"], k), f"suffixes{k}")
        suffixes = suffixes.unionByName(level.withColumn("k", F.lit(k)))
    ends = [F.struct(F.col("i").alias("start"), F.col("ahead").alias("size")), F.struct((F.col("i") - F.col("back") + 1).alias("start"), F.col("back").alias("size"))]
    runs = first.select("id", "h", F.inline(F.array(*ends))).where("size > 0").distinct()
    runs = runs.withColumn("k", F.floor(F.log2(F.col("size") + 0.5)).cast("int"))
    runs = runs.withColumn("tail", F.expr("start + size - shiftleft(1, k)"))
    head, tail = (suffixes.select(*[F.col(c).alias(f"{c}{j}") for c in ("id", "h", "i", "k", "r")]) for j in (1, 2))
    runs = runs.join(head, F.expr("id <=> id1 and h = h1 and start = i1 and k = k1")).join(tail, F.expr("id <=> id2 and h = h2 and tail = i2 and k = k2"))
    runs = materialize(runs.select("id", "h", "start", "size", "r1", "r2"), "runs")
    name = ["size", "r1", "r2"]
    least = materialize(runs.groupBy(*name).agg(F.min(F.struct("id", "h", "start")).alias("least"), F.count("*").alias("n")).where("n > 1"), "intervals")
    same = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))
    found = join_hot(runs, least, name, runs.count())
    return found.where(~same | (F.col("start") >= F.col("least.start") + F.col("size"))).select("id", "h", "start", "size")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_col rid of later copies, and _n_lines, _n_deleted (lines with a word: all, and those that went).

    A line goes if it lies in a run of whole consecutive lines, lines without a word apart, that has min_words words
    or more and of which a copy starts earlier: in a document with a smaller (id, hash of the text), nulls first, or
    further up in the same one, where the first copy has ended. Rows that repeat id and text are the same document and
    keep the same lines. Null texts stay null with 0 lines; empty texts stay empty; an empty table gives no rows; other
    columns pass through, but for any that are named _n_lines or _n_deleted, which are replaced.
    """
    sid, sh, starts, sizes, cut = (fresh(docs.columns, f"_{x}") for x in ("span_id", "span_h", "starts", "sizes", "cut"))
    spans = later_copies(docs, id_col, text_col, min_words).groupBy("id", "h").agg(F.collect_list("start").alias(starts), F.collect_list("size").alias(sizes))
    spans = spans.withColumnsRenamed({"id": sid, "h": sh})
    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(sid)) & (F.xxhash64(F.col(text_col)) == F.col(sh)), "left")
    once = F.pandas_udf(cut_text, "text string, n_lines long, n_deleted long").asNondeterministic()  # so that a filter of what it gives doesn't run it again
    out = joined.withColumn(cut, once(F.col(text_col), F.col(starts), F.col(sizes)))
    others = [F.col(f"{cut}.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c.lower() not in ("_n_lines", "_n_deleted")]
    return out.select(*others, F.col(f"{cut}.n_lines").alias("_n_lines"), F.col(f"{cut}.n_deleted").alias("_n_deleted"))


def cut_text(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    got = [(None, 0, 0) if t is None else kept_lines(t, *(((), ()) if s is None else (s, z))) for t, s, z in zip(texts, starts, sizes)]
    return pd.DataFrame(got, columns=["text", "n_lines", "n_deleted"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_chars and SHA-256 of what is left of every document's text."""
    out = dedup_lines(documents(spark, sf_dir))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_deleted").alias("n_deleted"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that are left, n_chars counted anew; a document goes if lines went and none is left."""
    own = [c for c in docs.columns if c.lower() in ("_n_lines", "_n_deleted")]
    kept = {c: fresh(docs.columns, f"{c}_") for c in own}  # columns that dedup_lines would replace
    out = dedup_lines(docs.withColumnsRenamed(kept)).where("_n_deleted = 0 or _n_deleted < _n_lines")
    chars = F.when(F.col("_n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select(*[chars.alias(c) if c == "n_chars" else F.col(kept.get(c, c)).alias(c) for c in docs.columns])
