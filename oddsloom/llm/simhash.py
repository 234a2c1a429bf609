"""SimHash near-duplicates by the general pigeonhole principle.

Fingerprints within tau bits of each other agree, in at least one of m bit groups, to within a threshold that
may differ by group and by fingerprint, as long as the thresholds sum to tau - m + 1 (a threshold of -1 leaves
a group out). Correlated bits share a group, and each fingerprint gets the thresholds with the fewest estimated
candidates by dynamic programming over the groups. A bucket of very many fingerprints is dealt again by the other
groups: what is left of tau is allocated over these, down to whole fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import connected_components, documents, materialize, text_batches

BITS = 64
CHUNK = 11  # bits of a histogram; 2 ** CHUNK counts each
BUCKET = 32  # indexed members of a bucket that are compared with each that meets it; a larger bucket is dealt again
SEED = 42
SHINGLE = 5  # words of a shingle in the pipeline's stage
LEAST = (4, 5)  # least Jaccard similarity there
RADIUS = 2  # bits that fingerprints differ in at most, where the bit groups search for similar sets there
CELL = 1.02  # ratio of the sizes that bound a cell of sizes
WORDS = 16  # 64-bit words of a set's parities
COMMON = 32  # different texts that a shingle must be met in to be compared last
MARKS = 1 << 24  # bits of the map that tells which texts to read again


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text: XXH64 (seed 42) of its word shingles, a bit set where over half the hashes have it.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Fewer words than a shingle: the whole
    sequence is the one shingle. No words, or null: 0.
    """
    return majority(shingle_hashes(text, shingle))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's word shingles in their order, by the rules of fingerprint; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, joined = max(1, len(words) - shingle + 1), b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], stops[: n - 1]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (stops[-n:] - 1).tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    n = len(hashes)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 15):
        block = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id_col, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["_text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"_id": pdf["_id"], "fp": fps})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(run, "_id long, fp long").withColumnRenamed("_id", id_col)


def bit_rows(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(gram: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of the 64 bits, each grown from a seed by the bit most correlated with it. gram: counts of common set bits."""
    p = np.diag(gram) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((gram / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [max(sorted(free), key=lambda b: corr[b, list(free)].sum())]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def values_of(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (np.int64(1) << np.arange(len(group), dtype=np.int64))


def near(hist: np.ndarray, width: int, most: int) -> np.ndarray:
    """Row d: the mass at distance d of each value of a chunk, d from 0 to most."""
    v, out = np.arange(1 << width), [hist]
    for d in range(1, most + 1):
        out.append(sum((hist[v ^ sum(1 << b for b in c)] for c in combinations(range(width), d)), np.zeros(len(v))))
    return np.stack(out)


class Plan:
    """Bit groups, histograms of their chunks and the allocation of thresholds. Of a fixed size whatever the corpus."""

    def __init__(self, groups: list[list[int]], hists: dict[tuple[int, ...], np.ndarray], n: int, tau: int):
        self.groups, self.n, self.tau = groups, n, tau
        self.chunks = [[g[a : a + CHUNK] for a in range(0, len(g), CHUNK)] for g in groups]
        self.near = [[near(hists[tuple(c)], len(c), tau) for c in cs] for cs in self.chunks]
        self.masks = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(g)), d)], dtype=np.int64) for d in range(tau + 1)] for g in groups]

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """(group, threshold + 1, fingerprint): probes plus estimated candidates; chunks of a group count as independent."""
        out = np.zeros((len(self.groups), self.tau + 2, len(bits)))
        for i, chunks in enumerate(self.chunks):
            mass = np.zeros((self.tau + 1, len(bits)))
            mass[0] = 1
            for c, table in zip(chunks, self.near[i]):
                part = table[:, values_of(bits, c)]
                mass = np.stack([sum(mass[a] * part[d - a] for a in range(d + 1)) for d in range(self.tau + 1)])
            probes = np.cumsum([len(x) for x in self.masks[i]])
            out[i, 1:] = probes[:, None] + self.n * np.cumsum(mass, axis=0)
        return out

    def allocate(self, bits: np.ndarray, groups: list[int] | None = None, left: int | None = None) -> np.ndarray:
        """Thresholds of each fingerprint by group: over groups, the cheapest of at least -1 that sum to left less their number plus 1; -1 for the others."""
        groups, total = list(range(len(self.groups))) if groups is None else groups, (self.tau if left is None else left) + 1
        cost = self.costs(bits)
        best, picks = np.full((total + 1, len(bits)), np.inf), []
        best[0] = 0  # thresholds plus one sum to total
        for i in groups:
            now, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
            for s in range(total + 1):
                for t in range(s + 1):
                    x = best[s - t] + cost[i, t]
                    pick[s] = np.where(x < now[s], t, pick[s])
                    now[s] = np.minimum(x, now[s])
            best = now
            picks.append(pick)
        rest, out, at = np.full(len(bits), total), np.zeros((len(self.groups), len(bits)), dtype=np.int8), np.arange(len(bits))
        for i, pick in zip(groups[::-1], picks[::-1]):
            out[i] = pick[rest, at]
            rest = rest - out[i]
        return out - 1

    def deal(self, rows: pd.DataFrame) -> pd.DataFrame:
        """From rows (key, fp, used, left, indexed), rows by a further group each: its value if indexed, else the values that are probed.

        used: bits of the groups that key stands for; left: bits that may still differ in the others. Keys are sums of
        mixed group values, so that the order of groups does not matter; keys that are equal by chance cost a comparison.
        """
        parts = []
        for (used, left, indexed), part in rows.groupby(["used", "left", "indexed"]):
            groups = [i for i in range(len(self.groups)) if not used >> i & 1]
            fps, keys = part["fp"].to_numpy(), part["key"].to_numpy()
            bits = bit_rows(fps)
            taus = np.zeros((len(self.groups), len(fps)), dtype=np.int8) if indexed else self.allocate(bits, groups, left)
            for i in groups:
                value = values_of(bits, self.groups[i])
                for d in range(1 if indexed else left + 1):
                    at = np.flatnonzero(taus[i] >= d)
                    masks = self.masks[i][d]
                    probed = (value[at][:, None] ^ masks[None, :]).ravel()
                    parts.append((np.repeat(keys[at], len(masks)) + mixed(probed + (np.int64(i) << np.int64(48))), np.repeat(fps[at], len(masks)), used | 1 << i, left - d, indexed))
        sizes = [len(x[0]) for x in parts]
        join = lambda j, kind: np.concatenate([x[j] for x in parts] or [np.zeros(0, kind)]).astype(kind)
        each = lambda j, kind: np.repeat(np.array([x[j] for x in parts], kind), sizes)
        return pd.DataFrame({"key": join(0, np.int64), "fp": join(1, np.int64), "used": each(2, np.int32), "left": each(3, np.int32), "indexed": each(4, bool)})


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits that look random, by splitmix64's rule."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).view(np.int64)


def close_pairs(fps: DataFrame, plan: Plan) -> DataFrame:
    """(u, v): pairs of fingerprints of fps (fp) that differ in plan.tau bits or fewer, u <> v, each at least one way round.

    Buckets of up to BUCKET indexed fingerprints are verified; larger ones go to the next level, where a key has one
    group more. The last level's keys are whole fingerprints, so there are at most as many levels as groups, and no
    fingerprint is compared with more than BUCKET others of a bucket.
    """
    schema = "key long, fp long, used int, left int, indexed boolean"

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                yield plan.deal(pdf.iloc[at : at + 2000])

    rows = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("used"), F.lit(plan.tau).alias("left"), F.explode(F.array(F.lit(True), F.lit(False))).alias("indexed"))
    pairs = None
    for level in range(len(plan.groups)):
        dealt = rows.mapInPandas(deal, schema)
        table = materialize(dealt.dropDuplicates(["key", "fp", "indexed"]) if level else dealt, f"keys{level}")
        hot = table.where("indexed").groupBy("key").count().where(F.col("count") > BUCKET).select("key")
        hot = materialize(hot if level < len(plan.groups) - 1 else hot.where("false"), "hot_keys")
        cold = table.join(hot, "key", "left_anti")
        a, b = cold.where("not indexed").select("key", F.col("fp").alias("u")), cold.where("indexed").select("key", F.col("fp").alias("v"))
        found = a.join(b, "key").where("u <> v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= plan.tau).select("u", "v")
        pairs = found if pairs is None else pairs.unionByName(found)
        if hot.isEmpty():
            break
        rows = table.join(hot, "key", "left_semi").select(*table.columns)
    return pairs


def make_plan(fps: DataFrame, tau: int) -> Plan:
    """Count bits and chunk values over all fingerprints, group the bits, and pick the number of groups with the least expected cost."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((BITS, BITS)), 0
        for pdf in batches:
            bits = bit_rows(pdf["fp"].to_numpy()).astype(np.float32)
            total, n = total + bits.T @ bits, n + len(pdf)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "c": np.append(total.ravel(), n)})

    cells = np.zeros(BITS * BITS + 1)
    for r in fps.select("fp").mapInPandas(gram, "cell int, c double").groupBy("cell").agg(F.sum("c").alias("c")).collect():  # 4,097 rows
        cells[r["cell"]] = r["c"]
    n, matrix = int(cells[-1]), cells[:-1].reshape(BITS, BITS)
    options = {m: group_bits(matrix, n, m) for m in (2, 3)}
    chunks = sorted({tuple(g[a : a + CHUNK]) for groups in options.values() for g in groups for a in range(0, len(g), CHUNK)})

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(1 << len(c), dtype=np.int64) for c in chunks]
        for pdf in batches:
            bits = bit_rows(pdf["fp"].to_numpy())
            for t, c in zip(total, chunks):
                t += np.bincount(values_of(bits, list(c)), minlength=len(t))
        for i, t in enumerate(total):
            at = np.flatnonzero(t)
            yield pd.DataFrame({"chunk": np.full(len(at), i, dtype=np.int32), "value": at.astype(np.int32), "c": t[at]})

    hists = {c: np.zeros(1 << len(c)) for c in chunks}
    for r in fps.select("fp").mapInPandas(counts, "chunk int, value int, c long").groupBy("chunk", "value").agg(F.sum("c").alias("c")).collect():  # under 2 ** CHUNK rows a chunk
        hists[chunks[r["chunk"]]][r["value"]] = r["c"] / max(n, 1)

    def expected(plan: Plan) -> float:
        """Of a pair drawn at random, by group and threshold, and from these the cheapest thresholds alike for all."""
        best = np.array([0.0] + [np.inf] * (tau + 1))
        for i, cs in enumerate(plan.chunks):
            mass = np.array([1.0] + [0.0] * tau)
            for c, table in zip(cs, plan.near[i]):
                part = table @ hists[tuple(c)]
                mass = np.array([sum(mass[a] * part[d - a] for a in range(d + 1)) for d in range(tau + 1)])
            cost = np.append(0, np.cumsum([len(x) for x in plan.masks[i]]) + n * np.cumsum(mass))
            best = np.array([min(best[s - t] + cost[t] for t in range(s + 1)) for s in range(tau + 2)])
        return best[tau + 1]

    return min((Plan(g, hists, n, tau) for g in options.values()), key=expected)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tau: int = 2) -> DataFrame:
    """Class of each row under chains of fingerprints that differ in tau bits or fewer.

    Returns (id_col, fingerprint, component_id), one row per input row: 16 lower-case hex digits, and the
    smallest id that can be reached, the row's own included. Null and wordless texts have fingerprint zero and
    are linked like others; rows that repeat an id each keep their row, and are linked by their own texts; a row with
    a null id links others, but component_id is null only where no id can be reached; an empty table gives no rows.
    Other columns are not read.

    Work is on distinct fingerprints, which are the graph's nodes, so exact copies cost a row of an aggregation, and
    rows with null or repeated ids link like any others.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("id")), "distinct_fingerprints")
    found = materialize(connected_components(close_pairs(fps.select("fp"), make_plan(fps, tau))), "components")
    labelled = fps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("c"))
    least = materialize(labelled.groupBy("c").agg(F.min("id").alias("component_id")), "least_ids")
    classes = materialize(labelled.join(least, "c").select("fp", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(classes, "fp").select(id_col, hexed, "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    return near_duplicates(documents(spark, sf_dir))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's different word shingles, ascending, by the rules of fingerprint; none without words."""
    return np.unique(shingle_hashes(text, shingle))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Of 64 * WORDS cells that a set's shingles are dealt into, whether each holds an odd number, as bits.

    A shingle that one of two sets lacks changes one bit, so two sets differ in as many shingles as bits, or more.
    """
    odd = np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles of a set, those in common (ascending) last: of two sets with a Jaccard similarity of LEAST or more, these share one."""
    num, den = LEAST
    size = len(hashes) - -(-num * len(hashes) // den) + 1 if len(hashes) else 0
    if len(common):
        at = np.searchsorted(common, hashes)  # not np.isin, which sorts all of common anew for each set
        last = common[np.minimum(at, len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    return hashes[:size]


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Of rows (id, h, ...) those whose (id, h) is in keys, and a few others, by a map of MARKS bits: whole texts aren't shuffled for it."""
    mark = F.pmod(F.xxhash64("id", "h"), F.lit(MARKS))
    place = [F.shiftright("mark", 6).alias("place"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bit")]
    marks = keys.select(mark.alias("mark")).select(*place).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    marks = F.broadcast(materialize(marks, "marks"))  # MARKS / 64 rows at most
    return rows.select("*", mark.alias("mark")).select(*rows.columns, *place).join(marks, "place").where("bits & bit <> 0").select(*rows.columns)


def fingerprint_pairs(sets: DataFrame, tau: int = RADIUS) -> DataFrame:
    """(u, v): nodes of sets (node, fp) whose fingerprints differ in tau bits or fewer, by the index of bit groups.

    Of nodes with one fingerprint, the least stands for all: it is in a pair with each of them, and in those with others.
    """
    least = materialize(sets.groupBy("fp").agg(F.min("node").alias("node")), "distinct_fingerprints")
    same = sets.join(least.withColumnRenamed("node", "u"), "fp").where("u <> node").select("u", F.col("node").alias("v"))
    near = close_pairs(least.select("fp"), make_plan(least, tau))
    for w in "uv":
        near = near.join(least.select(F.col("fp").alias(w), F.col("node").alias(f"node_{w}")), w)
    return same.unionByName(near.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct())


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, h, component_id), a row for each different id and h, the hash of a text: its class under chains of texts whose
    sets of word shingles have a Jaccard similarity of LEAST or more.

    component_id is the smallest id of the class. Equal sets are one class, so all wordless and null texts are one. A row
    with a null id is in no class. SimHash comes first: sets whose fingerprints (of different shingles, each once) are
    within RADIUS bits are compared by whole sets, which makes classes. Similar sets can be further apart, and the rest is
    exact: every such pair is found or joined by a chain, as each set is met by its prefix, and what meets and is in no
    class yet is compared by whole sets. Of a bucket with over BUCKET sets, all are first compared with four of them, and
    then only those that no chain joins yet, by cells of the sizes that they can be similar to, and by their parities, which
    tell apart those that surely differ in too many shingles.
    """
    num, den = LEAST
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("_text"))

    def sets(rows: DataFrame, known=None) -> DataFrame:
        """With prefixes, or, for the nodes that are known, whole sets."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            common = known.value if known else np.zeros(0, np.uint64)
            for pdf in batches:
                whole = [shingle_set(t, shingle) for t in pdf["_text"]]
                out = pdf.drop(columns="_text")
                out["node"] = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in whole], dtype=np.uint64).view(np.int64)
                out["n"] = [len(x) for x in whole]
                out["shingles"] = [(prefix(x, common) if known else x).view(np.int64) for x in whole]
                if known:
                    out["bits"] = [parities(x) for x in whole]
                    out["fp"] = np.array([majority(x) for x in whole], dtype=np.uint64).view(np.int64)
                yield out

        return rows.mapInPandas(run, "id long, h long, node long, n int, shingles array<long>" + ", bits array<long>, fp long" * bool(known))

    text_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    rows = materialize(sets(given, context.broadcast(np.zeros(0, np.uint64))), "shingle_prefixes")
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("id", "h")).alias("first")).select("node", "first.*"), "shingle_nodes")
    one = materialize(rows.dropDuplicates(["node"]).select("node", "n", "shingles", "bits", "fp"), "prefixes")
    known_bits = one.select("node", "n", "bits", "fp")
    listed = one.select("node", F.explode("shingles").alias("s"))
    common = materialize(listed.groupBy("s").count().where(F.col("count") > COMMON).select("s"), "common")
    hot = np.array([r["s"] for r in common.collect()], dtype=np.int64).view(np.uint64)  # a COMMON-th of the shingles in prefixes at most
    if len(hot):
        again = materialize(listed.join(common, "s", "left_semi").select("node").distinct(), "met_common")
        texts = materialize(nodes.join(again, "node", "left_semi").select("id", "h"), "texts_again")
        changed = sets(marked(given, texts), context.broadcast(np.sort(hot))).dropDuplicates(["node"])
        changed = materialize(changed.select("node", "n", "shingles"), "prefixes_again")  # where nothing common was met, as before
        one = one.select("node", "n", "shingles").join(changed.select("node"), "node", "left_anti").unionByName(changed)
    heads = one.select("node", "n", F.size("shingles").alias("p"), F.posexplode("shingles").alias("pos", "s"))
    met = materialize(heads.groupBy("s").agg(F.count("*").alias("size")).where("size > 1"), "met")
    heads = materialize(heads.join(met, "s"), "heads")

    known = materialize(heads.groupBy("node").agg(F.count("*").alias("t")), "met_by_node")  # t: shingles of the prefix that another prefix has
    cell = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(CELL)) + 1e-9).cast("int")
    enough = lambda shared: (num + den) * shared >= num * (F.col("n_u") + F.col("n_v"))
    differ = reduce(add, [F.bit_count(F.col("bits_u")[i].bitwiseXOR(F.col("bits_v")[i])) for i in range(WORDS)])
    near = (num + den) * differ <= (den - num) * (F.col("n_u") + F.col("n_v"))
    alike = (den * F.col("n_v") >= num * F.col("n_u")) & ((F.col("n_v") < F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("v") < F.col("u"))))

    def small_pairs(part: DataFrame) -> DataFrame:
        """Pairs (u, v) of a bucket in part, of two classes, whose sets can be similar by their sizes and by what their prefixes share.

        A shared shingle is in both prefixes, or beyond the one that ends first.
        """
        here = part.groupBy("node").agg(F.count("*").alias("k")).join(known, "node").join(label, "node", "left")
        here = materialize(here.select("node", (F.col("t") - F.col("k")).alias("o"), F.coalesce("component", "node").alias("c")), "elsewhere")
        part = materialize(part.join(here, "node"), "sides")
        sides = [part.select("s", F.col("node").alias(w), *[F.col(c).alias(f"{c}_{w}") for c in ("n", "p", "o", "c")]) for w in "uv"]
        both = sides[0].join(sides[1], "s").where((F.col("c_u") != F.col("c_v")) & alike).groupBy("u", "v", "n_u", "n_v", "p_u", "p_v", "o_u", "o_v").agg(F.count("*").alias("shared"))
        return both.where(enough(F.col("shared") + F.least("o_u", "o_v") + F.greatest(F.col("n_u") - F.col("p_u"), F.col("n_v") - F.col("p_v")))).select("u", "v")

    def large_pairs(part: DataFrame) -> DataFrame:
        """Pairs (u, v) of a bucket in part of which its shingle may be the first that both sets have, v's the smaller.

        Then they share at most what comes from it on in either, which leaves each set a range of sizes to be similar to.
        Common shingles come last, so sets of which much is their own meet few others: the join is by bucket and cells of
        both sizes.
        """
        part = part.join(known_bits.select("node", "bits"), "node")
        rest = F.col("n") - F.col("pos")
        larger = part.withColumns({"low": F.ceil(F.col("n") * num / den), "high": F.least(F.col("n"), F.floor(((num + den) * rest - num * F.col("n")) / num))})
        smaller = part.withColumns({"low": F.col("n"), "high": F.least(F.floor(F.col("n") * den / num), F.floor(((num + den) * rest - num * F.col("n")) / num))})
        sides = []
        for w, side in (("u", larger), ("v", smaller)):
            side = side.where("low <= high").withColumns({f"own_{w}": cell(F.col("n")), f"other_{w}": F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))})
            sides.append(side.select(F.col("s").alias(f"s_{w}"), F.col("node").alias(w), *[F.col(c).alias(f"{c}_{w}") for c in ("n", "pos", "c", "bits")], f"own_{w}", f"other_{w}"))
        on = (F.col("s_u") == F.col("s_v")) & (F.col("own_u") == F.col("other_v")) & (F.col("other_u") == F.col("own_v"))
        left = F.least(F.col("n_u") - F.col("pos_u"), F.col("n_v") - F.col("pos_v"))
        return sides[0].join(sides[1], on).where((F.col("c_u") != F.col("c_v")) & alike & enough(left) & near).select("u", "v").distinct()

    def close(pairs: DataFrame) -> DataFrame:
        """Of (u, v), those with similar sets. Parities tell most others apart before texts are read again for whole sets."""
        ends = [known_bits.select(F.col("node").alias(w), F.col("n").alias(f"n_{w}"), F.col("bits").alias(f"bits_{w}")) for w in "uv"]
        pairs = materialize(pairs.distinct().join(ends[0], "u").join(ends[1], "v").where(near).select("u", "v"), "candidates")
        texts = materialize(nodes.join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi").select("id", "h"), "texts")
        whole = materialize(sets(marked(given, texts).join(texts, ["id", "h"], "left_semi")).dropDuplicates(["node"]).select("node", "n", "shingles"), "shingle_sets")
        a = whole.select(F.col("node").alias("u"), F.col("n").alias("n_u"), F.col("shingles").alias("x"))
        b = whole.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return materialize(pairs.join(a, "u").join(b, "v").where((num + den) * both >= num * (F.col("n_u") + F.col("n_v"))).select("u", "v"), "similar")

    small, large = heads.where(F.col("size") <= BUCKET), heads.where(F.col("size") > BUCKET)
    order = F.struct("n", "node")
    least_own = F.struct(F.col("t") - F.col("p"), "node")  # the set with the fewest shingles that it has alone
    pivots = large.join(known, "node").groupBy("s").agg(F.array(F.min("node"), F.max_by("node", least_own), F.min_by("node", order), F.max_by("node", order)).alias("pivots"))
    stars = large.join(materialize(pivots, "pivots"), "s").select(F.col("node").alias("v"), F.explode("pivots").alias("u")).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    found = close(fingerprint_pairs(known_bits.select("node", "fp")))
    label = materialize(connected_components(found), "labels")
    found = found.unionByName(close(small_pairs(small).unionByName(stars)))
    label = materialize(connected_components(found), "labels")
    left = large.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    split = left.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("s")
    rest = large_pairs(materialize(left.join(materialize(split, "split"), "s", "left_semi"), "not_joined"))
    label = materialize(connected_components(found.unionByName(close(rest))), "labels")
    classes = nodes.join(label, "node", "left").select("node", "id", F.coalesce("component", "node").alias("c"))
    least = materialize(classes.groupBy("c").agg(F.min("id").alias("component_id")), "least_ids")
    classes = materialize(classes.join(least, "c").select("node", "component_id"), "classes")
    return rows.select("id", "h", "node").distinct().join(classes, "node").select("id", "h", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each class of similar_texts stays, that with the smallest doc_id (rows that repeat it stay with it). A null doc_id stays."""
    found = materialize(similar_texts(docs).where("id = component_id").groupBy("id", "component_id").agg(F.min("h").alias("h")).select("id", "h"), "kept")
    joined = docs.join(found, (F.col("doc_id").cast("long") == found["id"]) & (F.xxhash64("text") == found["h"]), "left_semi")
    return joined.unionByName(docs.where("doc_id is null"))
