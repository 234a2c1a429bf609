"""Byte-level BPE encoding and decoding with DuckDB's recursive queries, one database in each Python worker.

A block of whole texts is cut into the pattern's matches by arrays of its characters' kinds, and matches are told
apart by Arrow's dictionary encoding, so that no text is taken apart into Python strings. New matches go into a
token-position table: each round joins neighbours with the merge table and contracts, in every word, the pair of least
rank from its leftmost place on, until no pair is left. All of a word's places of that pair that don't overlap go in one
round: a merge makes only pairs of higher ranks, as each token of the vocabulary is its own encoding, so the next
rounds would take them anyhow. Decoding aggregates token bytes in order; a block's ids are decoded by rows of the
vocabulary and must give its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, text_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Unicode's White_Space, which the pattern's \s stands for.
SPACE = "\t-\r \x85\xa0  -     　"
#: What cuts() follows, and what it has after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, WHITE = 1, 2, 3  # kinds of characters; others have 0
KEPT = 64 << 20  # bytes of the matches and their ids that a worker keeps
BLOCK = 1 << 20  # bytes of the texts that are encoded together
WORDS = 10_000  # matches of a recursive query
DATABASE = "150MB"  # most memory of a worker's DuckDB

# nxt: the place of the next token in the word, or -1. Rows are sorted by word and place, so the next row is the next token; an error says if it is not.
# c: places of the word's least pair; follows: it begins where the one before ends. k: every other place of a run of these, from its first.
ENCODE = """
WITH RECURSIVE s(w, pos, tok, nxt, done) AS (
  SELECT w, pos, tok, nxt, false FROM bytes
  UNION ALL
  (WITH n AS (
    SELECT w, pos, tok, nxt, lead(nxt) OVER () AS nxt2,
      CASE WHEN nxt >= 0 THEN CASE WHEN lead(w) OVER () = w AND lead(pos) OVER () = nxt THEN tok::BIGINT * 65536 + lead(tok) OVER () ELSE error('rows out of order') END END AS pair
    FROM (SELECT * FROM s WHERE NOT done ORDER BY w, pos)
  ), p AS MATERIALIZED (
    SELECT w, pos, tok, nxt, nxt2, m.id FROM n LEFT JOIN merges m USING (pair)
  ), least AS MATERIALIZED (
    SELECT w, min(id) AS best FROM p GROUP BY w
  ), c AS (
    SELECT w, pos, nxt, lag(nxt) OVER o IS NOT DISTINCT FROM pos AS follows, row_number() OVER o AS i FROM p JOIN least USING (w) WHERE id = best WINDOW o AS (PARTITION BY w ORDER BY pos)
  ), k AS MATERIALIZED (
    SELECT w, pos, nxt FROM (SELECT *, i - max(CASE WHEN NOT follows THEN i END) OVER (PARTITION BY w ORDER BY i) AS turn FROM c) WHERE turn % 2 = 0
  ), t AS (SELECT w, pos, true AS merged FROM k UNION ALL SELECT w, nxt, false FROM k)
  SELECT w, pos, CASE WHEN merged THEN best ELSE tok END, CASE WHEN merged THEN nxt2 ELSE nxt END, best IS NULL
  FROM p JOIN least USING (w) LEFT JOIN t USING (w, pos) WHERE merged IS NOT FALSE))
SELECT w, pos, tok FROM s WHERE done
"""
DECODE = """
SELECT w, array_to_string(list(tok ORDER BY pos), ' ') AS ids, unhex(array_to_string(list(hex ORDER BY pos), '')) AS raw
FROM tokens JOIN vocabulary ON tok = id GROUP BY w ORDER BY w
"""


class Encoded(NamedTuple):
    """Of several texts: where each one's tokens begin in the others, and the end; ids; ids in decimals with a space after each; bytes of each."""

    at: np.ndarray
    ids: np.ndarray
    decimal: pa.Array
    raw: pa.Array


def places(strings: pa.Array) -> np.ndarray:
    """Where large strings begin in flat(), and the end."""
    return np.frombuffer(strings.buffers()[1], np.int64)[: len(strings) + 1] if len(strings) else np.zeros(1, np.int64)


def flat(strings: pa.Array) -> pa.Buffer:
    """The bytes of large strings, one after the other."""
    return (strings.buffers()[2] or pa.py_buffer(b""))[: int(places(strings)[-1])]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """Encodes and decodes words; vocabulary is a file of public_tokenizers, or a path that every worker can read."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import duckdb
        import public_tokenizers
        import regex

        self.ranks = read_ranks(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        if public_tokenizers.PATTERN != PATTERN:
            raise ValueError("cuts() follows another pattern")
        every = "".join(map(chr, range(0x110000)))
        self.kinds = np.zeros(len(every), np.uint8)
        for kind, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, f"[{SPACE}]+")):
            for m in regex.finditer(of, every):
                self.kinds[m.start() : m.end()] = kind
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DATABASE, "temp_directory": ""})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        merges = pa.table({"pair": pa.array([left * 65536 + right for left, right, _ in pairs], pa.int64()), "id": pa.array([r for *_, r in pairs], pa.int32())})  # noqa: F841
        known = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM known")
        self.size = max(self.ranks.values()) + 1
        self.forget()
        by_id = {r: t for t, r in self.ranks.items()}
        self.vocabulary = pa.array([by_id.get(i, b"") for i in range(self.size)], pa.large_binary())
        self.decimal = pa.array([b"%d " % i for i in range(self.size)], pa.large_binary())
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def tokens(self, words: list[bytes]) -> pa.Table:
        """(w, pos, tok): the tokens of words[w] in order."""
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        ends = np.cumsum(sizes, dtype=np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        pos = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
        nxt = np.where(pos + 1 < np.repeat(sizes, sizes), pos + 1, -1)
        bytes_ = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": pos.astype(np.int32), "tok": self.single[raw], "nxt": nxt.astype(np.int32)})  # noqa: F841
        return self.con.sql(ENCODE.replace("FROM bytes", "FROM bytes_")).to_arrow_table()

    def decode(self, tokens: pa.Table) -> list[tuple[str, bytes]]:
        """By w, which tokens have from 0 on: ids joined by spaces, bytes."""
        got = self.con.sql(DECODE).to_arrow_table()
        return list(zip(got["ids"].to_pylist(), got["raw"].to_pylist()))

    def forget(self) -> None:
        """Of kept matches, by name in order: two halves of the name, where the ids begin in self.ids, and how many they are."""
        self.high, self.low = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.counts, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint16 if self.size <= 1 << 16 else np.uint32)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(starts, counts) in self.ids of different matches. New ones are encoded, and kept by a 128-bit name if they decode to themselves."""
        names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)
        if self.high.nbytes * 3 + self.ids.nbytes > KEPT:
            self.forget()
        at = np.searchsorted(self.high, names[:, 0])
        found = np.append(self.high, np.uint64(0))[at] == names[:, 0]
        found &= np.append(self.low, np.uint64(0))[at] == names[:, 1]
        found &= at < len(self.high)
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[found], counts[found] = self.starts[at[found]], self.counts[at[found]]
        new = np.flatnonzero(~found)
        for first in range(0, len(new), WORDS):
            mine = new[first : first + WORDS]
            tokens = self.tokens([words[i] for i in mine])
            if [raw for _, raw in self.decode(tokens)] != [words[i] for i in mine]:
                raise ValueError("ids do not decode to their text")
            w, pos, tok = (tokens[c].to_numpy() for c in ("w", "pos", "tok"))
            counts[mine] = np.bincount(w, minlength=len(mine))
            starts[mine] = len(self.ids) + np.cumsum(counts[mine]) - counts[mine]
            self.ids = np.concatenate([self.ids, tok[np.lexsort((pos, w))].astype(self.ids.dtype)])
        order = new[np.argsort(names[new, 0], kind="stable")]
        self.low, self.starts, self.counts, self.high = (np.insert(x, at[order], y[order]) for x, y in ((self.low, names[:, 1]), (self.starts, starts), (self.counts, counts), (self.high, names[:, 0])))
        return starts, counts

    def cuts(self, data: pa.Buffer, starts: np.ndarray) -> np.ndarray:
        """Bytes of data at which the pattern's matches begin; starts: those at which texts begin."""
        lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # a character's first byte
        marks = np.zeros(len(lead) + 1, bool)
        marks[starts] = True
        first = marks[:-1][lead]
        chars = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        last = np.append(first[1:], True)
        kind = self.kinds[chars]
        space = kind == WHITE
        change = kind[1:] != kind[:-1]
        begins = first.copy()
        begins[1:] |= change & (space[1:] | (chars[:-1] != ord(" ")))  # a blank goes with what follows it
        begins[1:-1] |= space[:-2] & space[1:-1] & ~space[2:] & ~last[1:-1]  # the last of several spaces stands alone, or goes with what follows
        quote = np.flatnonzero((chars == ord("'")) & begins & ~last)
        for ending in ENDINGS:
            end = quote + len(ending)
            fits = end < len(chars)
            for k, c in enumerate(ending):
                fits[fits] = (chars[quote[fits] + k + 1] == ord(c)) & ~first[quote[fits] + k + 1]
            begins[quote[fits] + 1] = False
            begins[end[fits & (end + 1 < len(chars))] + 1] = True
        out = np.zeros(len(lead), bool)
        out[lead] = begins
        return np.flatnonzero(out)

    def encode(self, texts: pa.Array) -> Encoded:
        """Tokens of strings, of which null ones count as empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = (texts.buffers()[2] or pa.py_buffer(b""))[int(at[0]) : int(at[-1])]
        at = at - at[0]
        cuts = np.append(self.cuts(data, at), len(data)) if len(data) else np.zeros(1, np.int64)
        matches = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), data]).dictionary_encode()
        starts, counts = self.learn(matches.dictionary.to_pylist())
        word = matches.indices.to_numpy()
        ends = np.append(0, np.cumsum(counts[word]))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], counts[word])]
        raw = self.vocabulary.take(pa.array(ids))
        if not flat(raw).equals(data):
            raise ValueError("ids do not decode to their text")
        return Encoded(ends[np.searchsorted(cuts, at)], ids, self.decimal.take(pa.array(ids)), raw)


@lru_cache(1)
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens, ids array<int>, decoded binary) of each row's whole text, one row per input row.

    ids: byte-level BPE without special tokens; decoded: the bytes that the ids stand for. Null texts count as
    empty, which have no ids. Repeated rows and null ids each keep their row; an empty table gives no rows; other
    columns are not read.
    """

    def finish(got: Encoded) -> list[pa.Array]:
        decoded = pa.Array.from_buffers(pa.large_binary(), len(got.at) - 1, [None, pa.py_buffer(places(got.raw)[got.at]), flat(got.raw)])
        return [pa.ListArray.from_arrays(got.at.astype(np.int32), got.ids.astype(np.int32)), decoded.cast(pa.binary())]

    return per_text(docs, id_col, text_col, vocabulary, finish, "n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): as encode(), with SHA-256 of the decimal ids joined by spaces and of the decoded bytes."""

    def sha256(strings: pa.Array, at: np.ndarray, after: int) -> pa.Array:
        data, ends = memoryview(flat(strings)), places(strings)[at].tolist()
        return pa.array([hashlib.sha256(data[a : max(a, b - after)]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())

    def finish(got: Encoded) -> list[pa.Array]:
        return [sha256(got.decimal, got.at, 1), sha256(got.raw, got.at, 0)]

    return per_text(docs, id_col, text_col, vocabulary, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def per_text(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, finish, schema: str) -> DataFrame:
    names = ["_id", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(vocabulary)
        for rows in batches:
            block = np.cumsum(pc.binary_length(rows["_text"]).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), rows.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    got = model.encode(rows["_text"][a:b])
                    yield pa.RecordBatch.from_arrays([rows["_id"][a:b], pa.array(np.diff(got.at), pa.int64()), *finish(got)], names)
        pa.default_memory_pool().release_unused()  # else the worker holds it during other queries and stages

    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"_id long, {schema}").withColumnRenamed("_id", id_col)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, decoded binary): the bytes of each row's ids, in order. Null and empty lists decode to no bytes; an unknown id raises an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = tokenizer(vocabulary)
        for pdf in batches:
            lists = [[] if x is None else list(x) for x in pdf["_ids"]]
            flat = [(w, p, t) for w, x in enumerate(lists) for p, t in enumerate(x)]
            tokens = pa.table(dict(zip(("w", "pos", "tok"), (pa.array(x, pa.int32()) for x in (zip(*flat) if flat else ((), (), ()))))))
            if any(min(x) < 0 or max(x) >= model.size for x in lists if len(x)):
                raise ValueError("an id is not in the vocabulary")
            got = dict(zip((w for w, x in enumerate(lists) if x), model.decode(tokens)))
            yield pd.DataFrame({"_id": pdf["_id"], "decoded": [got[w][1] if x else b"" for w, x in enumerate(lists)]})

    given = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).alias("_ids"))
    return given.mapInPandas(run, "_id long, decoded binary").withColumnRenamed("_id", id_col)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document."""
    return digests(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return digests(docs)
