"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes by learned rotations (iterative quantisation). A code is cut into substrings, each with an
index of its own. Codes within Hamming radius r = m * s + a of a query agree with it in one of the first a + 1 of m
substrings to within s bits, or in one of the others to within s - 1: probing these buckets finds them all. The
radius grows until enough codes lie within it; their vectors are then ranked by exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

K = 20
CODE_BITS = 256
SUB = 8  # bits of a substring
RERANK = 0.08  # of a block's codes, at least, are ranked by floats
RERANK_LEAST = 200  # of them in a small block
SAMPLE = 20_000  # vectors that the rotations are learned from, in expectation
ROUNDS = 20
BLOCK = 65_536  # vectors of a block, in expectation
QUERY_BLOCK = 512


def usable(vec: str) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class Codes:
    """Centre and rotations. Inner products become angles by one more coordinate: the root of most norm squared less norm squared."""

    def __init__(self, sample: np.ndarray, most: float, bits: int = CODE_BITS, seed: int = 7):
        self.most = most
        lifted = self.lift(sample)
        self.centre = lifted.mean(axis=0)
        x, rng = lifted - self.centre, np.random.default_rng(seed)
        self.rotations = []
        for _ in range(-(-bits // x.shape[1])):
            r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
            for _ in range(ROUNDS):
                u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
                r = (u @ vt).T
            self.rotations.append(r)
        self.projection = np.concatenate(self.rotations, axis=1)[:, :bits]

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Scaled to at most length 1, with the coordinate that makes all lengths equal."""
        x = x / self.most
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Bytes of the codes. A query has length 1 and no further coordinate."""
        lifted = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1) if query else self.lift(x)
        return np.packbits((lifted - self.centre) @ self.projection >= 0, axis=1)


class Index:
    """Postings by substring: the rows of a block in order of each substring's value."""

    def __init__(self, codes: np.ndarray):
        pad = -codes.shape[1] % 8
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, pad)))).view(np.uint64)
        self.m = codes.shape[1]
        self.order = [np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(self.m)]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(SUB), d)], dtype=np.int64) for d in range(SUB + 1)]

    def probe(self, code: np.ndarray, want: int) -> np.ndarray:
        """Rows within the least Hamming radius that has want of them, found by growing it a substring at a time."""
        n = len(self.words)
        word = np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        distance = np.full(n, -1, dtype=np.int16)
        within = np.zeros(self.m * SUB + 2, dtype=np.int64)
        for s in range(SUB + 1):
            for a in range(self.m):
                order, starts = self.order[a], self.starts[a]
                rows = np.concatenate([order[starts[v] : starts[v + 1]] for v in (int(code[a]) ^ self.masks[s])])
                new = rows[distance[rows] < 0]
                if len(new):
                    d = np.bitwise_count(self.words[new] ^ word).sum(axis=1, dtype=np.int16)
                    distance[new] = d
                    within[: self.m * SUB + 1] += np.bincount(d, minlength=self.m * SUB + 1)
                radius = self.m * s + a
                if within[: radius + 1].sum() >= want:
                    return np.flatnonzero((distance >= 0) & (distance <= radius))
        return np.flatnonzero(distance >= 0)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= cut)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rerank: float = RERANK) -> DataFrame:
    """The k rows of vectors with the largest inner product for each query: (query_id, rank, vec_id, score), approximate.

    score is the inner product in double precision; ranks from 1, ties to the smaller id. A row isn't a candidate for
    a query of its own id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do
    null ids, nor vectors of another length than most of vectors have (the shorter, if two are as frequent). Each row of
    vectors is a candidate of its own, also if it repeats an id; of queries that repeat an id the greatest vector
    counts. Fewer candidates than k: all of them; none, or an empty table: no rows. Other columns are not read.
    Vectors are dealt into blocks of about BLOCK by hash, and every block of queries meets every block of vectors, so
    a task holds one block of each; within, the index retrieves a share rerank of the codes for the floats.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return rows.where(F.col("id").isNotNull() & usable("vec"))

    all_ = materialize(clean(vectors), "vectors")
    length = all_.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fits = F.size("vec") == length["size"]
    base, asked = all_.where(fits), materialize(clean(queries).where(fits).groupBy("id").agg(F.max("vec").alias("vec")), "queries")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    n, most = base.agg(F.count("*"), F.max(norm)).first()
    n_asked = asked.count()
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = base.where(share * n <= SAMPLE).orderBy("id").toPandas()  # about SAMPLE rows
    if sample.empty:
        sample = base.orderBy("id").limit(1).toPandas()
    codes = spark.sparkContext.broadcast(Codes(np.stack(sample["vec"]), most))

    def encode(query: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    pdf = pdf.assign(code=list(map(bytes, codes.value.encode(np.stack(pdf["vec"]), query))))
                    yield pdf[["id", "vec", "code"]]

        return run

    blocks, query_blocks = -(-n // BLOCK), -(-n_asked // QUERY_BLOCK)
    deal = lambda parts: F.pmod(F.xxhash64("id", "vec"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    schema = "id long, vec array<double>, code binary"
    right = base.mapInPandas(encode(False), schema).withColumn("block", deal(blocks)).withColumn("part", each(query_blocks))
    left = asked.mapInPandas(encode(True), schema).withColumn("part", deal(query_blocks)).withColumn("block", each(blocks))

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(v):
            v = v.sort_values("id")
            ids, x = v["id"].to_numpy(), np.stack(v["vec"])
            index = Index(np.frombuffer(b"".join(v["code"]), dtype=np.uint8).reshape(len(v), -1))
            for qid, y, code in zip(q["id"], q["vec"], q["code"]):
                rows = index.probe(np.frombuffer(code, dtype=np.uint8), min(len(v), max(RERANK_LEAST, int(np.ceil(rerank * len(v))))))
                rows = rows[ids[rows] != qid]
                scores = (x[rows] * y).sum(axis=1)
                for at in best(ids[rows], scores, k):
                    out.append((qid, ids[rows[at]], scores[at]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score double")
    top = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("top"))  # k rows a block
    ranked = top.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
