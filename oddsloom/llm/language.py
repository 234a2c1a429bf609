"""Language identification by cross-parsing entropy.

For each language, the suffix automaton of labelled text. A text is cut from left to right into the longest
phrases that the automaton knows, a character that it lacks being a phrase of its own. A phrase costs a place in the
N characters of the language's labelled text and the symbol that ends it, one of A symbols of all languages, or of all
code points if the language lacks it: the language that needs the fewest bits wins.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, text_batches

SAMPLE_TEXTS = 24  # labelled texts that an automaton is made of, in expectation; whole ones
PIECE = 512  # characters that are parsed in step with other pieces
BLOCK = 1 << 20  # characters of the texts that are parsed together, at some 50 bytes each
HELD_OUT = 2


@lru_cache(1)
def folded() -> np.ndarray:
    """By code point: itself for letters and marks, 1 for digits, 0 for all else."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = c if kind[0] in "LM" else kind == "Nd"
    return out


def symbols(text: str) -> np.ndarray:
    """The lower-cased text as numbers: letters and marks as code points, digits alike, all other characters as white space."""
    return folded()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


class Automaton:
    """Suffix automaton of texts, each with white space after it, as a double array.

    The step from state s on column c stands in slot base[s] + c, if that slot's owner is s. A missing step begins a
    phrase, in state first[c]; state 0 has no steps: the start, and after a column that the texts lack.
    """

    def __init__(self, texts: list[np.ndarray], columns: np.ndarray):
        """columns: all symbols in order; the place of one plus one is its column, and 0 is the column of those that it lacks."""
        joined = np.concatenate([np.append(t, np.uint32(0)) for t in texts])
        self.size = len(joined)
        nexts: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in (np.searchsorted(columns, joined) + 1).tolist():
            now = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = now
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now
        self.first = np.zeros(len(columns) + 1, dtype=np.int32)
        self.first[list(nexts[0])] = list(nexts[0].values())
        nexts[0] = {}
        self.pack(nexts, len(columns) + 1)

    def pack(self, nexts: list[dict[int, int]], width: int) -> None:
        """States with the most steps first, each where its steps fit; those with one step fill what is free."""
        slots = sum(map(len, nexts)) + 2 * width
        used = bytearray(2 * slots)
        base = np.zeros(len(nexts), dtype=np.int32)
        owner, target = np.full(2 * slots, -1, dtype=np.int32), np.zeros(2 * slots, dtype=np.int32)
        several = sorted((s for s, x in enumerate(nexts) if len(x) > 1), key=lambda s: -len(nexts[s]))
        start, tries, many = width, 0, 0
        for s in several:
            steps = sorted(nexts[s])
            if len(steps) != many:
                start, many = width, len(steps)
            low, rest, at, tries = steps[0], [c - steps[0] for c in steps[1:]], start, 0
            while True:
                at = used.find(0, at)
                if at < 0 or at + width >= len(used):
                    at = len(used)
                    used.extend(bytes(2 * slots))
                if not any(used[at + c] for c in rest):
                    break
                at, tries = at + 1, tries + 1
            if tries > 32:
                start = at
            base[s] = at - low
            for c in steps:
                used[at + c - low] = 1
        if len(used) > len(owner):
            owner, target = np.full(len(used), -1, dtype=np.int32), np.zeros(len(used), dtype=np.int32)
        single = [s for s, x in enumerate(nexts) if len(x) == 1]
        free = np.flatnonzero(np.frombuffer(used, np.uint8)[width:] == 0) + width
        if len(free) < len(single):
            free = np.append(free, np.arange(len(single)) + len(used))
        base[single] = free[: len(single)] - [next(iter(nexts[s])) for s in single]
        s = np.repeat(np.arange(len(nexts)), list(map(len, nexts)))
        slot = base[s] + np.array([c for x in nexts for c in x], dtype=np.int32)
        size = max(int(slot.max(initial=0)), int(base.max(initial=0)) + width) + 1
        owner, target = (np.pad(x[:size], (0, max(0, size - len(x))), constant_values=-1) for x in (owner, target))
        owner[slot], target[slot] = s, np.array([t for x in nexts for t in x.values()], dtype=np.int32)
        self.base, self.owner, self.target = base, owner, target

    def step(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins)."""
        slot = self.base[state] + column
        begins = self.owner[slot] != state
        return np.where(begins, self.first[column], self.target[slot]), begins


class Parser:
    def __init__(self, automata: dict[str, Automaton], columns: np.ndarray):
        self.languages = sorted(automata)
        self.automata = [automata[x] for x in self.languages]
        self.phrase_bits = np.log2([a.size for a in self.automata]) + np.log2(len(columns) + 1)
        self.lacking_bits = np.log2(0x110000 / (len(columns) + 1))
        table = np.zeros(0x110000, dtype=np.int32)
        table[columns] = np.arange(len(columns)) + 1
        self.table = table

    def bits(self, texts: list[str]) -> np.ndarray:
        phrases, lacking = self.phrases(texts)
        return phrases * self.phrase_bits + lacking * self.lacking_bits

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text and language, phrases, and how many of them are characters that the language lacks.

        Pieces of PIECE characters go in step, each from a fresh phrase. Then each goes on into the following ones until
        it begins a phrase where that piece did, from where on both are alike; so the parse of the whole text is put
        together of the pieces' parses, and is the same as in one go.
        """
        codes = [self.table[symbols(t)] for t in texts]
        lengths = np.array(list(map(len, codes)), dtype=np.int64)
        flat = np.concatenate([*codes, np.zeros(PIECE, np.int32)])
        text_start = np.cumsum(lengths) - lengths
        pieces = -(-lengths // PIECE)
        first_piece = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(texts)), pieces)
        begin = text_start[owner] + (np.arange(len(owner)) - first_piece[owner]) * PIECE
        stop = text_start[owner] + lengths[owner]
        size = np.minimum(PIECE, stop - begin)
        order = np.argsort(-size, kind="stable")
        grid = flat[begin[order][None, :] + np.arange(PIECE)[:, None]]
        live = np.searchsorted(-size[order], -np.arange(PIECE), side="left")
        lane = np.empty(len(order), dtype=np.int64)
        lane[order] = np.arange(len(order))
        out, lacks = (np.zeros((len(texts), len(self.languages)), dtype=np.int64) for _ in range(2))
        for j, automaton in enumerate(self.automata):
            state, begins = np.zeros(len(order), dtype=np.int32), np.zeros(grid.shape, dtype=bool)
            for t, n in enumerate(live):
                state[:n], begins[t, :n] = automaton.step(state[:n], grid[t, :n])
            more, meets = np.zeros(len(order), dtype=np.int64), stop.copy()  # phrases begun beyond the piece, and where it meets another
            going = np.flatnonzero(begin + size < stop)
            at, now = (begin + size)[going], state[lane[going]]
            while len(going):
                now, new = automaton.step(now, flat[at])
                offset = at - text_start[owner[going]]
                met = new & begins[offset % PIECE, lane[first_piece[owner[going]] + offset // PIECE]]
                meets[going[met]] = at[met]
                more[going[new & ~met]] += 1
                at = at + 1
                keep = ~met & (at < stop[going])
                going, at, now = going[keep], at[keep], now[keep]
            lacks[:, j] = np.diff(np.append(0, np.cumsum(automaton.first[flat] == 0))[np.append(text_start, lengths.sum())])
            whole = begins.sum(axis=0)[lane]
            alone = np.flatnonzero(pieces == 1)
            out[alone, j] = whole[first_piece[alone]]
            for i in np.flatnonzero(pieces > 1):
                p, skip, total = first_piece[i], 0, 0
                while True:
                    total += whole[p] + more[p] - (begins[:skip, lane[p]].sum() if skip else 0)
                    if meets[p] >= stop[p]:
                        break
                    p, skip = first_piece[i] + (meets[p] - text_start[i]) // PIECE, (meets[p] - text_start[i]) % PIECE
                out[i, j] = total
        return out, lacks


def train(spark: SparkSession, sample: dict[str, list[str]]) -> Parser:
    """Automata of a sample, each made in a task of its own."""
    columns = np.unique(np.concatenate([[0], *[symbols(t) for ts in sample.values() for t in ts]])).astype(np.uint32)
    shared = spark.sparkContext.broadcast(columns)  # the different symbols of the sample

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        a = Automaton([symbols(t) for t in pdf["text"]], shared.value)
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "size": [a.size], **{c: [getattr(a, c).tobytes()] for c in ("first", "base", "owner", "target")}})

    if not sample:
        return Parser({}, columns)
    texts = spark.createDataFrame([(x, t) for x, ts in sample.items() for t in ts], "lang string, text string")
    made = texts.groupBy("lang").applyInPandas(make, "lang string, size long, first binary, base binary, owner binary, target binary")
    automata = {}
    for r in made.collect():  # some 50 bytes a sampled character
        a = automata[r["lang"]] = Automaton.__new__(Automaton)
        a.size = r["size"]
        a.first, a.base, a.owner, a.target = (np.frombuffer(r[c], dtype=np.int32) for c in ("first", "base", "owner", "target"))
    return Parser(automata, columns)


def sample_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Training text: of each language about SAMPLE_TEXTS different labelled texts that aren't held out, one at least, chosen by hash of the text.

    A bound on rows: languages * SAMPLE_TEXTS whole texts reach the driver, in expectation.
    """
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held, F.lit(False)))
    key = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)
    different = rows.select(F.col(lang_col).alias("_l"), key.alias("_key")).distinct()
    counts = different.groupBy("_l").agg(F.count("*").alias("count"), F.min("_key").alias("first")).collect()  # a row a language
    bounds = [(F.col(lang_col) == r["_l"]) & (key <= max(SAMPLE_TEXTS / r["count"], r["first"])) for r in counts]
    near = rows.where(reduce(or_, bounds, F.lit(False))).select(F.col(lang_col).alias("_l"), F.col(text_col).alias("_text")).distinct()
    out: dict[str, list[str]] = {}
    for r in near.orderBy("_l", "_text").collect():
        out.setdefault(r["_l"], []).append(r["_text"])
    return out


def predictions(parser: Parser, given: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    texts = given.fillna("").tolist()
    known = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
    pred, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    at = np.flatnonzero(known)
    if len(at) and parser.languages:
        bits = parser.bits([texts[i] for i in at])
        best = bits.argmin(axis=1)
        pred[at] = np.array(parser.languages, dtype=object)[best]
        low = bits[np.arange(len(at)), best]
        bits[np.arange(len(at)), best] = np.inf
        score[at] = 1 - low / bits.min(axis=1)
    return pred, score


def blocks(texts: pd.Series) -> np.ndarray:
    """Numbers of the blocks of texts that are parsed together; a text counts PIECE at least."""
    sizes = np.maximum(texts.str.len().fillna(0).to_numpy(dtype=np.int64), PIECE)
    return np.cumsum(sizes) // BLOCK


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: dict[str, list[str]] | None = None) -> DataFrame:
    """Language of each row: (id_col, held_out, lang_pred, score), one row per input row.

    Learns from text and lang_col of rows whose crc32(id) mod 4 isn't 2 (held_out), or from sample. A prediction
    sees the text alone, the whole of it. score: the winner's lead, one less the ratio of its bits to the runner-up's,
    from 0 to 1; 1 if a single language was learned. und with score 0: null and empty texts, texts without a letter
    (str.isalpha), and all texts if no language was learned. Equal bits go to the first language by name. A null id
    isn't held out; repeated rows each keep their row; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    given = spark.sparkContext.broadcast(train(spark, sample_of(docs, id_col, text_col, lang_col) if sample is None else sample))  # some 50 bytes a sampled character

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, block in pdf.groupby(blocks(pdf["_text"]), sort=False):
                pred, score = predictions(given.value, block["_text"])
                yield pd.DataFrame({"_id": block["_id"], "held_out": block["_held"], "lang_pred": pred, "score": score}).astype({"_id": "Int64"})

    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), held.alias("_held"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id long, held_out boolean, lang_pred string, score double").withColumnRenamed("_id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (und: null, empty or letterless texts) go; all others stay as they are. Where no language was learned, all stay."""
    text_batches(spark)
    parser = train(spark, sample_of(docs, "doc_id", "text", "lang"))
    if not parser.languages:
        return docs
    given = spark.sparkContext.broadcast(parser)  # some 50 bytes a sampled character

    @F.pandas_udf("string")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([predictions(given.value, x)[0] for _, x in texts.groupby(blocks(texts), sort=False)] or [np.zeros(0, object)]), dtype=object)

    return docs.where(predicted("text") != "und")
