"""Quality rules: simple counts of a text, and how well a public vocabulary covers it (tokeniser fertility)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, text_batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 8

#: Accepted ranges by script: letters and digits a token, most of the tokens that are bytes of unknown characters,
#: and least token entropy in bits as a share of the most that so many tokens (2,000 at most) can have.
BANDS = {
    "latin": ((1.5, 8.0), 0.10, 0.50),
    "greek": ((0.7, 6.0), 0.25, 0.40),
    "cyrillic": ((0.7, 6.0), 0.25, 0.40),
    "han": ((0.3, 3.0), 0.60, 0.30),
    "other": ((0.2, 8.0), 0.80, 0.25),
}
#: Letters of the scripts that BANDS names, as ranges of code points.
SCRIPTS = {"latin": "A-Za-zªºÀ-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿", "cyrillic": "Ѐ-ԯ", "han": "぀-ヿ㐀-䶿一-鿿"}
NAMES = [*SCRIPTS, "other"]
SCRIPT_PATTERNS = [re.compile(f"[{v}]") for v in SCRIPTS.values()]
OTHER_PATTERN = re.compile(rf"[^\W\d_{''.join(SCRIPTS.values())}]")
LEAST_TOKENS = 20  # below, a text says too little about its tokens
CACHED = 400_000  # words whose tokens a worker keeps
BLOCK = 1 << 21  # characters of the texts that are measured together
MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Text:
    """Words of a text, named by their place among its distinct words, and its base counts."""

    def __init__(self, text: str | None):
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()  # on ASCII white space alone
        ids: dict[bytes, int] = {}
        self.names = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
        self.words = list(ids)
        self.n = len(words)
        self.chars = len(text) - sum(map(text.count, SPACES)) if text else 0
        self.symbols = sum(map(text.count, SYMBOLS)) if text else 0
        lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
        self.dup_lines = len(lines) - len(set(lines))
        self.repeats = repeat_words(self.names)


def repeat_words(names: np.ndarray) -> int:
    """Words that stand in a window of eight words which the text has twice or more. names: equal words have equal numbers."""
    n = len(names) - WINDOW + 1
    if n < 2:
        return 0
    x = names.astype(np.uint64) + np.uint64(1)
    x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ (x << np.uint64(32))
    windows = sum(x[j : j + n] * MULTIPLIERS[j] for j in range(WINDOW))
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(windows, twice))
    cover = np.bincount(at, minlength=len(names) + 1) - np.bincount(at + WINDOW, minlength=len(names) + 1)
    return int((np.cumsum(cover) > 0).sum())


def script_traits(word: str) -> list[int]:
    """Letters and digits, then letters by NAMES: a letter in none of SCRIPTS is other."""
    return [sum(map(str.isalnum, word)), *(len(p.findall(word)) for p in SCRIPT_PATTERNS), sum(map(str.isalpha, OTHER_PATTERN.findall(word)))]


class Fertility:
    """Measures of whole texts by a sentencepiece vocabulary with byte fallback.

    Words are encoded one by one; their tokens are kept in flat arrays, which start anew beyond CACHED words.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.traits = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, 1 + len(NAMES)), np.int64)

    def learn(self, texts: list[Text]) -> None:
        """Encode the words of texts that aren't kept yet. traits: letters and digits, then letters by script, those outside SCRIPTS last."""
        if len(self.place) > CACHED:
            self.clear()
        new = list(dict.fromkeys(w for t in texts for w in t.words if w not in self.place))
        if not new:
            return
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        strings = [w.decode("utf-8", "replace") for w in new]
        pieces = self.model.encode(strings, num_threads=1)
        ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.ids = np.concatenate([self.ids, np.fromiter((i for p in pieces for i in p), np.int32)])
        self.starts = np.concatenate([self.starts, ends])
        traits = [[len(w), len(w), 0, 0, 0, 0] if w.isascii() and w.isalpha() else script_traits(w) for w in strings]
        self.traits = np.concatenate([self.traits, np.array(traits, np.int64)])

    def measure(self, text: Text) -> tuple[str, int, float, float, float]:
        """Script with the most letters, tokens, letters and digits a token, share of byte tokens, token entropy in bits."""
        if not text.n:
            return "other", 0, 0.0, 0.0, 0.0
        at = np.fromiter((self.place[w] for w in text.words), np.int64, len(text.words))
        counts = np.bincount(text.names)
        traits = counts @ self.traits[at]
        script = NAMES[int(np.argmax(traits[1:]))] if traits[1:].any() else "other"
        sizes = self.starts[at + 1] - self.starts[at]
        weights = np.repeat(counts, sizes)
        total = int(weights.sum())
        if not total:
            return script, 0, 0.0, 0.0, 0.0
        flat = np.arange(len(weights)) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        ids = self.ids[flat]
        where, inverse = np.unique(ids, return_inverse=True)
        p = np.bincount(inverse, weights=weights, minlength=len(where)) / total
        return script, total, float(traits[0] / total), float(weights[self.is_byte[ids]].sum() / total), float(-(p * np.log2(p)).sum())


def accepted(script: str, tokens: int, per_token: float, byte_share: float, entropy: float, bands: dict = BANDS) -> bool:
    """Whether the measures lie in the script's bands. Under LEAST_TOKENS tokens, they are not held against a text."""
    if tokens < LEAST_TOKENS:
        return True
    (low, high), most_bytes, least = bands.get(script, bands["other"])
    return bool(low <= per_token <= high and byte_share <= most_bytes and entropy >= least * np.log2(min(tokens, 2000)))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "piece_bpe_32k.model", bands: dict | None = None) -> DataFrame:
    """Counts, fertility measures and a verdict for each row, in no set order.

    Returns (id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script,
    n_tokens, chars_per_token, byte_share, token_entropy). vocabulary: a file of public_tokenizers, or a path that
    workers can read. Null and empty texts have no words, so base_failed is true and kept false; chars_per_token is
    0 without tokens. Repeated rows and ids each give a row, null ids stay null, an empty table gives no rows, and
    other columns are not read. Each text is read whole; a word's tokens are those that it has on its own.
    """
    bands = bands or BANDS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fertility = Fertility(vocabulary)
        for pdf in batches:
            sizes = pdf["_text"].str.len().fillna(0).to_numpy(dtype=np.int64)
            for _, block in pdf.groupby(np.cumsum(sizes) // BLOCK, sort=False):
                texts = [Text(t) for t in block["_text"]]
                fertility.learn(texts)
                out = []
                for i, t in zip(block["_id"], texts):
                    failed = t.n < 20 or 100 * t.repeats > 30 * t.n
                    measures = fertility.measure(t)
                    out.append((i, t.n, t.chars, t.symbols, t.dup_lines, t.repeats, failed, not failed and accepted(*measures, bands=bands), *measures))
                yield pd.DataFrame(out, columns=names).astype({"_id": "Int64"})

    schema = "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
    names = [x.split()[0] for x in schema.split(", ")]
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("_id", id_col)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    return quality(documents(spark, sf_dir))
