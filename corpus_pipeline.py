"""From raw documents to token digests: language ID, line dedup, near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddsloom.llm import bpe, language, linededup, mixing, simhash
from oddsloom.llm._common import documents, materialize

#: (name, function of (spark, docs, sf_dir)); each works on all that the one before it kept.
STAGES = [
    ("language_id", language.stage),
    ("line_dedup", linededup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("source_mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = materialize(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
