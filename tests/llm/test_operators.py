"""Operators against brute force, an exact round trip or held-out accuracy, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from oddsloom.llm import _common, ann, bpe, html, language, licenses, linededup, mixing, quality, queries, simhash, urls
from oddsloom.llm._common import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, words string"


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"s{k % 3}" if k % 4 else None, None if t is None else len(t), "clash", "clash") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \n ", "one", "a b c d e", "a b c d e", "x" * 5000, "Ünïcode ÉÉ é\tb\x0bc", "mit License\n" * 3, "word " * 3000]


def near_words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(300)) for _ in range(n)]


def brute_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    label = {i: i for i in range(len(fps))}
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket", [32])
def test_simhash(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = list(ODD)
    for s in range(6):
        words = near_words(150, s)
        for k in range(12):
            texts.append(" ".join(words[:k] + ["edit"] + words[k + 1 :]) if k else " ".join(words))
    fps = [brute_simhash(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == components(fps)
    assert len(set(components(fps))) < len(texts) - 10


def test_simhash_plan_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    flips = np.array([base[i % 300] ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for i in range(300)])
    fps = np.unique(np.concatenate([base, flips]))
    bits = simhash.bit_rows(fps).astype(float)
    for m in (2, 3):
        groups = simhash.group_bits(bits.T @ bits, len(fps), m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        chunks = {tuple(g[a : a + simhash.CHUNK]) for g in groups for a in range(0, len(g), simhash.CHUNK)}
        hists = {c: np.bincount(simhash.values_of(simhash.bit_rows(fps), list(c)), minlength=1 << len(c)) / len(fps) for c in chunks}
        plan = simhash.Plan(groups, hists, len(fps), 2)
        taus = plan.allocate(simhash.bit_rows(fps))
        assert (taus.sum(axis=0) == 2 - m + 1).all() and (taus >= -1).all()
        want = {(a, b) for i, a in enumerate(fps.tolist()) for b in fps.tolist()[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
        rows = pd.concat([pd.DataFrame({"key": np.int64(0), "fp": fps, "used": 0, "left": 2, "indexed": x}) for x in (True, False)])
        for _ in range(m):  # each level finds every pair by itself
            rows = plan.deal(rows).drop_duplicates(["key", "fp", "indexed"])
            pairs = rows[~rows.indexed].merge(rows[rows.indexed], on="key")
            found = {(min(a, b), max(a, b)) for a, b in zip(pairs.fp_x, pairs.fp_y) if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
            assert found == want and len(want) > 200
        assert rows[rows.indexed].groupby("key").size().max() == 1


def test_simhash_of_null_and_repeated_ids(spark, monkeypatch):
    fps = [0, 0b11, 0b1111, 0xFF << 40, (0xFF << 40) + (1 << 50), 0xFFF << 20]
    ids = [5, None, 9, 7, 7, None]
    rows = spark.createDataFrame([(i, str(f)) for i, f in zip(ids, fps)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprint", lambda t, shingle=3: int(t))
    direct = rows.selectExpr("doc_id", "cast(text as long) as fp")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: direct)
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(rows).collect()}
    assert [got[i, f"{f:016x}"] for i, f in zip(ids, fps)] == [5, 5, 5, 7, 7, None]
    monkeypatch.undo()
    assert simhash.near_duplicates(rows.where("false")).count() == 0
    twice = spark.createDataFrame([(5, " ".join(near_words(40, 1))), (8, " ".join(near_words(40, 1))), (8, " ".join(near_words(40, 2))), (3, " ".join(near_words(40, 2)))], "doc_id long, text string")
    assert sorted(r["component_id"] for r in simhash.near_duplicates(twice).collect()) == [3, 3, 5, 5]


def test_simhash_dense_cluster(spark, monkeypatch):
    rng = np.random.default_rng(0)
    fps = sorted({int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False))) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 60)})
    direct = spark.createDataFrame([(i, f if f < 1 << 63 else f - (1 << 64)) for i, f in enumerate(fps)], "doc_id long, fp long")
    for bucket in (2,):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        monkeypatch.setattr(simhash, "fingerprints", lambda *a: direct)
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(direct).collect()}
        assert [got[i] for i in range(len(fps))] == components(fps)


@pytest.mark.parametrize("bucket, common", [(2, 3)])
def test_similar_texts(spark, monkeypatch, bucket, common):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "COMMON", common)
    rng, texts = random.Random(9), list(ODD)
    for s in range(6):
        words = near_words((6, 14, 60, 150, 150, 400)[s], 40 + s)
        for k in range(14):
            edited = list(words)
            for at in rng.sample(range(len(words)), k * len(words) // 200):
                edited[at] = f"edit{k}"
            texts.append(" ".join(edited[: len(words) - k % 3]))
    texts += [" ".join(near_words(12, 600 + k) + near_words(20, 77)) for k in range(12)]  # a passage in texts that are not alike
    texts += [texts[30], texts[40].upper()]
    ids = [*range(len(texts) - 1), 5]  # an id with two texts

    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label, close = list(range(len(texts))), set()
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                close.add((j, i))
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {c: min(i for i, x in zip(ids, label) if x == c) for c in label}
    df = frame(spark, texts, ids)
    got = simhash.similar_texts(df).join(df.selectExpr("doc_id as id", "xxhash64(text) as h", "text"), ["id", "h"]).collect()
    assert len(got) == len(texts) and {(r["id"], r["text"]): r["component_id"] for r in got} == {(i, t): least[c] for i, t, c in zip(ids, texts, label)}
    fps = [brute_simhash(t) for t in texts]
    far = [(i, j) for i, j in close if bin(fps[i] ^ fps[j]).count("1") > 2]
    assert len(far) > 30 and len(set(label)) < len(texts) - 30  # pairs that two bits miss
    kept = simhash.stage(spark, frame(spark, texts + [texts[0], "null id"], ids + [None, None]), SF).collect()
    assert len([r for r in kept if r["doc_id"] is not None]) == len(set(label)) and sum(r["doc_id"] is None for r in kept) == 2


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200)] + [(300, k) for k in range(301, 340)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and got[339] == 300 and 200 not in got


def test_components_of_small_graphs_take_few_plans(spark, monkeypatch):
    """A chain, for which rounds grow with its length, is two tables; rounds, for larger graphs, find the same."""
    rng, keep, written = random.Random(8), _common.materialize, []
    edges = [(i, i + 1) for i in range(-40, 60)] + [(i + 1, i) for i in range(5)] + [(100, 100)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)] + [(1 << 62, -(1 << 62))]
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    monkeypatch.setattr(_common, "materialize", lambda df, name: written.append(name) or keep(df, name))
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for small in (_common.SMALL, 0):
        monkeypatch.setattr(_common, "SMALL", small)
        written.clear()
        assert sorted(map(tuple, connected_components(df).collect())) == sorted(label.items())
        assert (len(written) == 2) == bool(small)
        assert connected_components(df.where("u = v")).count() == 0


def test_driver_returns_freed_memory(spark, monkeypatch):
    """After each table, as the JVM says."""
    said, keep = [], _common.trim_driver
    monkeypatch.setattr(_common, "trim_driver", lambda s: said.append(keep(s)))
    assert _common.materialize(spark.range(5), "five").count() == 5
    assert len(said) == 1 and said[0].startswith("Trim native heap")


def brute_quality(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    texts = ODD + [" ".join(near_words(60, 1)), " ".join(near_words(30, 2) * 3), "a|b #x\n" * 30, "\n".join(near_words(25, 3) * 2)]
    got = quality.quality(frame(spark, texts)).toPandas().sort_values("doc_id")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(r) for r in got[cols].itertuples(index=False)] == [brute_quality(t) for t in texts]
    assert got["base_failed"].tolist() == [n < 20 or 100 * r > 30 * n for n, _, _, _, r in map(brute_quality, texts)]
    assert not (got["base_failed"] & got["kept"]).any() and got["kept"].any()
    f = quality.Fertility("piece_bpe_32k.model")
    t = quality.Text(" ".join(near_words(60, 1)) + " 漢字 " * 30)
    f.learn([t])
    script, tokens, per_token, byte_share, entropy = f.measure(t)
    ids = [i for w in (" ".join(near_words(60, 1)) + " 漢字 " * 30).split() for i in f.model.encode(w)]
    p = np.array(list(Counter(ids).values())) / len(ids)
    assert tokens == len(ids) and abs(entropy + (p * np.log2(p)).sum()) < 1e-9 and script == "latin"
    assert abs(byte_share - sum(f.model.is_byte(i) for i in ids) / len(ids)) < 1e-12


def test_quality_of_mixed_scripts(spark):
    words = {
        "arabic": "ذهب الولد إلى المدرسة صباح اليوم مع أخيه الصغير وقرأ كتابا جديدا عن تاريخ المدينة القديمة ثم عاد مساء إلى بيته البعيد قرب النهر الكبير",
        "hebrew": "הילד הלך בבוקר אל בית הספר עם אחיו הקטן וקרא ספר חדש על תולדות העיר העתיקה ואחר כך שב בערב אל ביתו הרחוק ליד הנהר הגדול",
        "korean": "아이는 오늘 아침에 동생과 함께 학교에 갔다 그리고 오래된 도시의 역사에 대한 새로운 책을 읽고 저녁에 강가에 있는 먼 집으로 다시 돌아왔다 정말 즐거운 하루였다",
        "hindi": "लड़का आज सुबह अपने छोटे भाई के साथ विद्यालय गया और उसने पुराने नगर के इतिहास पर एक नई पुस्तक पढ़ी फिर शाम को नदी के पास अपने घर लौट आया",
    }
    mixed = [f"{w} NATO" for w in words.values()]
    latin = " ".join(near_words(40, 1)) + " שלום"
    got = quality.quality(frame(spark, [*words.values(), *mixed, latin])).toPandas().sort_values("doc_id")
    assert got["script"].tolist() == ["other"] * 8 + ["latin"]
    assert not got["base_failed"].any() and got["kept"].all(), got


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, size=(3000, 1))
    x[7] = 0
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)] + [(5000, None, ""), (5001, [float("nan")] * 24, ""), (5002, [1.0] * 23 + [None], ""), (None, x[4].tolist(), ""), (5003, [1.0, 2.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    hit = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        ok = [i for i in range(3000) if i not in (q, 7)]
        want = sorted(ok, key=lambda i: (-s[i], i))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], atol=1e-9, rtol=0)
        hit += len(set(want) & set(g["vec_id"]))
    assert got["query_id"].nunique() == 30 and hit / 600 >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).toPandas()
    assert len(few) == 4
    assert ann.nearest(df.where("false"), df.where("false")).count() == 0 and ann.nearest(df, df.where("false")).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [1.0, 0.0]), (1, [9.0, 9.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(twice, twice.where("vec_id = 1")).orderBy("rank").collect()] == [(1, 2, 9.0), (2, 3, 9.0), (3, 2, 4.5)]


def test_recall_of_a_full_block():
    """Of the test vectors' kind, at the share that is ranked by floats: 0.9 of the true neighbours are among the retrieved codes."""
    import pyarrow.parquet as pq

    x = np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), dtype=float)
    rng = np.random.default_rng(0)
    x = np.concatenate([x, *[rng.permuted(x, axis=0) for _ in range(15)]])  # 32,000: the same components, mixed
    codes = ann.Codes(x[:20_000], float(np.sqrt((x * x).sum(axis=1)).max()))
    index = ann.Index(codes.encode(x))
    hits = 0
    for q in range(0, 2000, 50):
        rows = index.probe(codes.encode(x[q : q + 1], True)[0], int(ann.RERANK * len(x)))
        want = np.argsort(-(x @ x[q]))[:21]
        hits += len(set(want[want != q][:20]) & set(rows))
    assert hits / 800 >= 0.9, hits / 800


def test_index_finds_all_within_the_radius():
    codes = np.random.default_rng(1).integers(0, 256, size=(500, 4), dtype=np.uint8)
    index = ann.Index(codes)
    for q in codes[:20]:
        d = np.unpackbits(codes ^ q, axis=1).sum(axis=1)
        rows = index.probe(q, 25)
        assert len(rows) >= 25 and set(rows) == set(np.flatnonzero(d <= d[rows].max()))


def test_licenses(spark):
    full = dict((a, b) for a, b in reversed(licenses.TEMPLATES))  # the first of each label
    broken = full["bsd"].split()
    broken = " ".join(broken[:6] + ["new", "words"] + broken[6:])
    texts = ODD + [full["mit"], broken, "The MIT license, Apache-License; GNU General\nPublic LICENSE", "general public", full["mpl"][:20], "mit license " * 4, "mit licenseK", "MIT licenſe"]
    got = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts) and got[0]["n_words"] == 0 and got[8]["n_base"] == 3
    n = len(ODD)
    assert got[n]["labels"] == "mit" and got[n]["base_labels"] == "" and got[n]["score"] == 1.0
    assert got[n + 1]["labels"] == "bsd" and 0.5 <= got[n + 1]["score"] < 1
    r = got[n + 2]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (3, 1, 6, "apache,gpl,mit", 1.0)
    assert got[n + 3]["n_base"] == 0 and got[n + 3]["first_word"] is None and got[n + 4]["labels"] == ""
    assert got[n + 5]["n_base"] == 4 and got[n + 6]["n_base"] == 0 and got[n + 7]["n_base"] == 0


def test_license_spans(spark):
    """Verified spans with some words added and left out, and templates whose words are scattered."""
    bsd = licenses.TEMPLATES[9][1].split()
    edited = bsd[:40] + ["an", "added", "word"] + bsd[40:90] + bsd[92:]
    scattered = " ".join(" ".join(bsd[i : i + 4]) + " " + " ".join(near_words(12, i)) for i in range(0, len(bsd) - 4, 4))
    texts = [" ".join(["intro"] * 5 + edited + ["end"]), scattered, None, " ".join(bsd), " ".join(bsd)]
    got = sorted(licenses.scan(frame(spark, texts, [0, 1, 2, 3, 3]).withColumnsRenamed({"words": "labels", "n_chars": "rid"})).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3, 3]
    assert f"bsd:5-{len(edited) + 4}" in got[0]["spans"].split(",") and got[0]["labels"] == "bsd" and 0.9 < got[0]["score"] <= 1
    assert got[1]["labels"] == "" and got[1]["spans"] == "" and got[2]["spans"] == "" and got[3]["spans"] == got[4]["spans"] and f"bsd:0-{len(bsd) - 1}" in got[3]["spans"]
    nulls = frame(spark, ["mit license", "mit license", None], [None, None, None])
    assert sorted(r["n_base"] for r in licenses.scan(nulls).collect()) == [0, 1, 1] and licenses.scan(nulls.where("false")).count() == 0


def test_urls(spark):
    u = [None, "no scheme", "http://A.Example.NET/en/x?y", "http://example.net", "https://example.com/de/1#t", "http://x.org/fr/", "http://good.example.com/en/", "http://bad.example.com/en/", "://h/p://q"]
    pages = spark.createDataFrame([(i, x, "c") for i, x in enumerate(u)] + [(100 + i, "http://bad.example.com/a", "c") for i in range(40)] + [(200 + i, "http://good.example.com/a", "c") for i in range(400)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, True) for i in range(40)] + [(200 + i, False) for i in range(400)] + [(None, True)], "id long, bad boolean")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, labels).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("", "", None)
    assert (got[2]["host"], got[2]["rule"], got[2]["verdict"]) == ("a.example.net", "example.net/en/", "allow")
    assert got[3]["rule"] is None and got[4]["verdict"] == "block" and got[5]["rule"] == "org/fr/"
    assert got[6]["verdict"] == "allow" and got[7]["verdict"] == "block" and (got[8]["host"], got[8]["path"]) == ("h", "/p://q")
    assert urls.filter_urls(pages.where("false"), labels).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages.where("page_id = 7"), labels.where("false")).collect()} == {"allow"}


def test_reputation(spark):
    """Against the same sums by hand; hosts either side of the threshold; levels of hosts."""
    n = {"a.b.co.uk": (40, 8), "c.b.co.uk": (40, 10), "d.e.co.uk": (40, 33), "u:p@x.com:80": (60, 12), "x.com": (60, 14), "y.com": (60, 13), "10.0.0.1:9": (20, 3), "new.b.co.uk": (0, 0), "z.org": (0, 0)}
    pages, labels = [], []
    for h, (count, bad) in n.items():
        for j in range(max(count, 2)):
            pages.append((len(pages), f"http://{h}/p"))
            if j < count:
                labels.append((len(pages) - 1, j < bad))
    df = spark.createDataFrame(pages + [(None, "http://y.com/"), (0, "http://y.com/")], "page_id long, url string")
    out = spark.createDataFrame(labels + [(0, True), (0, False)], "id long, bad boolean")
    rows = df.select("page_id", urls.url_parts(df.url)[0].alias("host"))
    got = {r["host"]: r for r in urls.reputation(rows, out).collect()}
    assert (got["a.b.co.uk"]["domain"], got["a.b.co.uk"]["suffix"]) == ("b.co.uk", "co.uk") and got["u:p@x.com:80"]["domain"] == "x.com" and got["10.0.0.1:9"]["suffix"] == "10.0.0.1"
    n["y.com"] = (61, 14)  # page 0 has a second row there
    level = {h: (got[h]["suffix"], got[h]["domain"], h) for h in n}
    total, bad = sum(x for x, _ in n.values()), sum(b for _, b in n.values())
    mean = {(): (bad + 0.5) / (total + 1)}
    for i in range(3):
        units = {}
        for h, (x, b) in n.items():
            key = level[h][: i + 1]
            units[key] = tuple(map(sum, zip(units.get(key, (0, 0)), (x, b))))
        m = {k: mean[k[:i]] for k in units}
        top = sum(x * (m[k] * (1 - m[k]) - (b / x - m[k]) ** 2) for k, (x, b) in units.items() if x)
        low = sum(x * (b / x - m[k]) ** 2 - m[k] * (1 - m[k]) for k, (x, b) in units.items() if x)
        strength = 1000.0 if low <= 0 else min(1000.0, max(1.0, top / low))
        ab = {k: (strength * m[k] + b, strength * (1 - m[k]) + x - b) for k, (x, b) in units.items()}
        mean |= {k: a / (a + b) for k, (a, b) in ab.items()}
    for h in n:
        a, b = ab[level[h]]
        assert abs(got[h]["mean"] - a / (a + b)) < 1e-12
        assert abs(got[h]["bound"] - (a / (a + b) - urls.Z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)) < 1e-12
    verdicts = {r["host"]: r["verdict"] for r in urls.filter_urls(df, out).collect()}
    assert {h for h, v in verdicts.items() if v == "block"} == {h for h in n if got[h]["bound"] > got[h]["overall"]} == {"d.e.co.uk"}
    assert urls.filter_urls(df, out).count() == len(pages) + 2


def test_html(spark):
    page = "<html><head><title>x</title><script>if(a<b)'</p>'</script></head><body><header>Site</header><div class='cookie-notice'>Cookies</div><nav><a href=/>Home</a></nav><article><h1>T{i}</h1><p>Fish &amp; <b>chi</b>ps {i}<p>two<br>lines<aside>side</aside><section class=comments>bad</section></article><footer>&copy; f</footer></body></html>"
    bare = "<html><body><div id=top>Same words on every page here</div><div><p>Own text {i} of the page</p></div></body></html>"
    rows = [(i, "http://h/a", page.format(i=i)) for i in range(8)] + [(10 + i, "http://b/a", bare.format(i="abcdefgh"[i])) for i in range(8)] + [(20, None, None), (21, "x", ""), (22, "http://c/", "cut &amp text <b"), (0, "http://h/a", page.format(i=0))]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    by = got.drop_duplicates("page_id").set_index("page_id")["text"]
    assert len(got) == len(rows) and by[3] == "T3 Fish & chips 3 two lines" and by[20] == by[21] == ""
    assert by[22] == "cut & text" and by[12] == "Own text c of the page"
    assert (got["n_chars"] == got["text"].str.len()).all()


def test_html_template_in_article(spark):
    page = "<html><body><article><h1>Title {i}</h1><div>Subscribe to the daily letter now</div><p>{own}</p><p>The notice that we print below the text of each story</p></article></body></html>"
    own = [" ".join(near_words(20, i)) + " the of to story" * (i % 3) for i in range(8)]
    same = "<html><body><article><p>One story at eight addresses</p></article><footer>{i} views</footer></body></html>"
    rows = [(i, "http://h/a", page.format(i=i, own=own[i])) for i in range(8)] + [(20 + i, "http://s/a", same.format(i=i)) for i in range(8)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().set_index("page_id")["text"]
    assert [got[i] for i in range(8)] == [f"Title {i} {own[i]}" for i in range(8)]
    assert all(got[20 + i] == "One story at eight addresses" for i in range(8))


def test_html_slots_without_article_tags():
    """Generated sites: the article is told by the template's slots, not by its tags."""
    rng = random.Random(7)
    line = lambda n: " ".join(near_words(n, rng.random()))
    pages, want = [], []
    for i in range(12):
        body = [line(rng.randrange(8, 40)) for _ in range(rng.randrange(2, 6))]
        menu = "".join(f"<div><a href=x>{line(2)}</a></div>" for _ in range(rng.randrange(3, 7)))
        pages.append(f"<html><body><div><div>{menu}</div></div><table><tr><td class=story><h2>{line(4)} {i}</h2>" + "".join(f"<p>{x}</p>" for x in body) + f"<p>Written by our own staff</p></td><td class=more><p>Latest {line(3)}</p></td></tr></table><div><p>Imprint and terms {line(2)}</p></div></body></html>")
        want.append(body)
    got = html.main_texts(pages)
    for text, body, page in zip(got, want, pages):
        title = page.split("<h2>")[1].split("</h2>")[0]
        assert text == " ".join([title, *body])
    real = html.template
    try:
        html.template = lambda pages: set()
        assert sum(a != b for a, b in zip(html.main_texts(pages), got)) == 12
    finally:
        html.template = real


def test_html_classes_against_brute_force():
    rng = random.Random(3)
    for _ in range(20):
        pages = [[("a", ""), *rng.choices([("b", ""), ("c", ""), ("/b", ""), ("p", "x y"), ("q", "z w")], k=rng.randrange(4)), ("/a", "")] for _ in range(6)]
        shared = html.template(pages)
        vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
        for t in shared:
            assert sum(map(bool, vectors[t])) >= 3  # support
            mates = {u for u in shared if vectors[u] == vectors[t]}
            turns = [[u for u in p if u in mates] for p in pages]
            size = len(mates)
            assert len({tuple(x[i : i + size]) for x in turns for i in range(0, len(x), size)}) == 1  # one order
        assert {("a", ""), ("/a", "")} <= shared


def test_html_edges(spark):
    page = "<html><body><article><h1>News</h1><div class='share-price'>Beta rose.</div><div class='share-buttons'>Tweet</div><p>{}</p></article></body></html>"
    long = " ".join(near_words(60_000, 1))
    rows = [(None, "http://x/1", page.format("Alpha fell."), 1), (1, "http://x/2", page.format(long), 1), (1, "http://x/2", page.format(long), 1), (2, "http://only/", page.format("One."), 1), (3, "http://e/", "<p></p>", 1), (4, None, "<ul><li><a>Home</a></ul>plain", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in html.extract(df).collect()), key=lambda x: (x[0], len(x[1])))
    assert got == [(0, "News Beta rose. Alpha fell."), (1, f"News Beta rose. {long}"), (1, f"News Beta rose. {long}"), (2, "News Beta rose. One."), (3, ""), (4, "plain")]
    assert html.extract(df.where("false")).count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    sizes = [rng.choice([0, 1, 5, 20, 80, 300]) for _ in range(600)]
    rows = [(i, " ".join(["w"] * n) if n else (None if i % 2 else ""), [None, "a", "b", "c"][min(i % 7, 3)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas().sort_values("doc_id")
    assert got["size"].tolist() == sizes
    total, by = sum(sizes), Counter()
    for i, n, s in zip(range(600), sizes, [r[2] for r in rows]):
        by[s] += n
    order, weight = ["a", "b", "c", None], [3, 1, 2, 3]
    want, full = {}, set()
    while True:
        left = 1.5 * total - sum(2 * by[s] for s in full)
        w = sum(x for s, x in zip(order, weight) if s not in full)
        over = {s for s, x in zip(order, weight) if s not in full and left * x / w >= 2 * by[s]}
        if not over:
            want = {s: 2 * by[s] if s in full else left * x / w for s, x in zip(order, weight)}
            break
        full |= over
    got["source"] = [r[2] for r in rows]
    for s, g in got.groupby(got["source"].fillna("none")):
        target = want[None if s == "none" else s]
        assert np.allclose(g["target"], target) and abs(g["taken"].sum() - target) <= 0.02 * target + 5
    assert (got["taken"] <= 2 * got["size"]).all() and (got["copies"].between(0, 2)).all()
    again = mixing.mix(df.repartition(3)).toPandas().sort_values("doc_id")
    assert again["taken"].tolist() == got["taken"].tolist()
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mix(df.where("text is null or text = ''")).agg({"taken": "sum"}).first()[0] == 0


def test_bpe_round_trip(spark):
    import public_tokenizers as P
    import tiktoken

    texts = ODD + ["a\t b  c\r\n\r\n  d", "foo\x1cbar\x85 z", "don't I'll 12345 ½", "日本語 😀😀 ", "ab" * 300, "  lead\n\n\ntrail  "]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    out = bpe.encode(frame(spark, texts))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == enc.encode_ordinary(t or "") and bytes(got[i]["decoded"]) == (t or "").encode()
    assert all(bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode() for r in bpe.decode(out).collect())
    d = {r["doc_id"]: r for r in bpe.digests(frame(spark, texts)).collect()}
    ids = enc.encode_ordinary(texts[9])
    assert d[9]["n_tokens"] == len(ids) and d[9]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_cuts_as_the_pattern():
    import public_tokenizers as P
    import pyarrow as pa
    import regex

    pattern = regex.compile(P.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^{bpe.SPACE}\p{{L}}\p{{N}}]").replace(r"\S", rf"[^{bpe.SPACE}]").replace(r"\s", f"[{bpe.SPACE}]"))
    pieces = [*"'  \n\t\x1c\x85\u3000strevmldSx1½é日😀!-", "'s", "'re", "'ll", " '", "''", "  ", "\u0301", "\0"]
    rng, model = random.Random(5), bpe.Tokenizer()
    for n in (1, 2, 3, 9, 60):
        texts = ["".join(rng.choices(pieces, k=rng.randint(0, n))) for _ in range(4000)]
        raws = [t.encode() for t in texts]
        data, ends = b"".join(raws), np.cumsum([0, *map(len, raws)])
        if data:
            cuts = [*model.cuts(pa.py_buffer(data), ends).tolist(), len(data)]
            assert [data[a:b].decode() for a, b in zip(cuts, cuts[1:])] == [w for t in texts for w in pattern.findall(t)]


def test_bpe_known_matches_cost_less_than_a_regex():
    """CPU time of texts all of whose matches are kept, against the pattern's own over the same texts."""
    import time

    import public_tokenizers as P
    import pyarrow as pa
    import regex

    rng = random.Random(6)
    known = ["".join(rng.choices("aeinorstü", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = ["".join(w + rng.choice([" ", " ", ", ", ".\n"]) for w in rng.choices(known, k=1500)) for _ in range(100)]
    model, pattern = bpe.Tokenizer(), regex.compile(P.PATTERN)

    def least(f) -> float:
        took = []
        for _ in range(5):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: list(model.encode(pa.array(texts)))) < 0.8 * least(lambda: [pattern.findall(t) for t in texts])


def test_language(spark):
    df = queries.language.documents(spark, SF)
    got = language.identify(df).toPandas().merge(df.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    assert (held.lang == held.lang_pred).mean() > 0.97 and got["score"].between(0, 1).all()
    sample = {"aa": ["the cat sat on the mat " * 9], "bb": ["der hund lief durch den wald " * 9]}
    odd = {r["doc_id"]: r for r in language.identify(frame(spark, ODD + ["the cat", "der wald", "12 34", "the cat sat " * 4000]), sample=sample).collect()}
    n = len(ODD)
    assert [odd[i]["lang_pred"] for i in (0, 1, 2, n, n + 1, n + 2, n + 3)] == ["und", "und", "und", "aa", "bb", "und", "aa"]


def test_cross_parsing(spark, monkeypatch):
    sample = {"aa": ["the cat sat on the mat " * 9, "naïve 漢字漢語 हिन्दी"], "bb": ["der hund lief durch den wald " * 9], "cc": ["x"]}
    rng = random.Random(5)
    texts = ["the cat ran der hund q the mat", "½ ²", "漢字 naïve हिन्दी 99"] + ["".join(rng.choice(["the cat ", "hund ", "mat", "q", "漢", " ", "der hund lief "]) for _ in range(n)) for n in (1, 40, 300, 900)]
    known = {x: "".join("".join(map(chr, language.symbols(t))) + "\0" for t in ts) for x, ts in sample.items()}
    for piece in (1, 3, 7, 64, 512):
        monkeypatch.setattr(language, "PIECE", piece)
        p = language.train(spark, sample)
        got, lacks = p.phrases(texts)
        for i, t in enumerate(texts):
            t = "".join(map(chr, language.symbols(t)))
            for j, name in enumerate(p.languages):  # brute force: longest phrases that are substrings
                count, at = 0, 0
                while at < len(t):
                    end = at + 1
                    while end < len(t) and t[at : end + 1] in known[name]:
                        end += 1
                    count, at = count + 1, end
                assert got[i, j] == count and lacks[i, j] == sum(c not in known[name] for c in t), (piece, name, t)
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, ["½ ² Ⅷ", "漢", "tie ʰ"]), sample=sample).collect()}
    assert odd[0] == "und" and odd[1] == "aa" and odd[2] != "und"
    same = {"bb": ["abc"], "aa": ["abc"]}
    rows = frame(spark, ["abc", "abc", None], [4, 4, None])
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in language.identify(rows, sample=same).collect()) == [(0, "und"), (4, "aa"), (4, "aa")]  # ties go by name
    assert language.identify(rows.where("false")).count() == 0 and language.stage(spark, rows.where("false"), SF).count() == 0


def test_language_of_copies_and_own_rows(spark):
    rows = [(i, "der hund lief durch den wald", "de") for i in range(4000)] + [(5000 + i, f"the cat sat on the mat {w}", "en") for i, w in enumerate("abcdefgh")]
    sample = language.sample_of(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert sample["de"] == ["der hund lief durch den wald"] and len(sample["en"]) > 3
    df = frame(spark, ["the cat sat", "12 34", None, "wald", "...", None], [1, 1, 2, None, None, 3])
    assert sorted(r["text"] for r in language.stage(spark, df, SF).collect()) == ["the cat sat", "wald"]


@pytest.mark.parametrize("floor", [3, 50])
def test_line_dedup(spark, floor):
    rng = random.Random(4)
    line = lambda k: " ".join(near_words(k, rng.random()))
    passage = [line(20) for _ in range(4)]
    texts = [None, "", "\n\n"] + ["\n".join([line(9), *passage[: 2 + i % 3], "}", line(7)]) for i in range(9)] + [" short\nline", " short\nline", "\n".join(["x y"] * 60), "\n".join([line(60)] * 2), "}"]
    texts += [texts[4], "\n".join(["a", "b", "a", "b", "a", "b c", "a", "b", "a", "b"])]
    rows = [(i, t, "en", "s", 1, "clash", "clash", 7, 8, 9, 10) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS + ", _starts int, _cut int, _n_lines int, _span_id int")
    got = {r["doc_id"]: r for r in linededup.dedup_lines(df, min_words=floor).collect()}

    docs = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    seen, gone = {}, {}
    for d, lines in enumerate(docs):  # brute force over runs of any length
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(len(x.split()) for x in lines[a:b]) >= floor:
                    d0, a0 = seen.setdefault(tuple(lines[a:b]), (d, a))
                    if d0 != d or a >= a0 + b - a:
                        gone.setdefault(d, set()).update(range(a, b))
    for d, t in enumerate(texts):
        assert got[d]["_n_lines"] == len(docs[d]) and got[d]["_n_deleted"] == len(gone.get(d, ())), (d, t)
        if t is not None:
            assert [x for x in got[d]["text"].split("\n") if x.strip()] == [x for i, x in enumerate(docs[d]) if i not in gone.get(d, ())]
    assert got[0]["text"] is None and sum(map(len, gone.values())) > 20 and got[1]["words"] == "clash" and got[1]["_starts"] == 7 and got[1]["_cut"] == 8
    if floor == 50:
        assert len(got[14]["text"].split()) >= 50  # the first copy of a run that overlaps itself stays
    if floor == 3:
        assert linededup.dedup_lines(df.where("false")).count() == 0
        kept = linededup.stage(spark, df, SF)
        assert kept.columns == df.columns and {r["_n_lines"] for r in kept.collect()} == {9}
        nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (1, "q")], "doc_id long, text string")
        assert sorted((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(nulls).collect()) == [(0, "a b c d"), (0, "a b c d"), (1, ""), (1, ""), (1, "q")]


def test_line_dedup_short_lines_and_joined_ends(spark, tmp_path):
    own = lambda k: " ".join(near_words(30, k))
    passage = [" ".join(near_words(24, 100 + k)) for k in range(3)]
    texts = [f"{own(k)}\nAll rights reserved.\n{own(50 + k)}" for k in range(20)]
    texts += ["\n".join([f"{own(200 + k)} {passage[0]}", passage[1], f"{passage[2]} {own(300 + k)}"]) for k in range(4)] + ["All rights reserved.", None]
    df = frame(spark, texts)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in linededup.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[i]["n_deleted"] for i in range(26)] == [0] + [1] * 19 + [0] + [1] * 3 + [1, 0] and len(got) == 26
    kept = {r["doc_id"]: r["text"] for r in linededup.stage(spark, df, str(tmp_path)).collect()}
    assert kept[0] == texts[0] and kept[5] == f"{own(5)}\n{own(55)}" and 24 not in kept and kept[25] is None
    assert kept[20] == texts[20] and kept[22] == "\n".join([f"{own(202)} {passage[0]}", f"{passage[2]} {own(302)}"])


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_url_filter"])
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda x: "null" if pd.isna(x) else x if isinstance(x, str) else f"{float(x):.6f}"
    key = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(got) == key(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs, before = corpus_pipeline.documents(spark, SF), None
    for name, f in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(f(spark, docs, SF), name)
        n = out.count()
        if name != "byte_bpe":
            assert out.columns == docs.columns
        if name == "language_id":
            assert n == docs.count()
        if name == "simhash_near_dedup":
            fps = [brute_simhash(r["text"]) for r in docs.orderBy("doc_id").collect()]
            assert n == len(set(components(fps)))
        if name == "source_mixing":
            assert out.select("doc_id").distinct().count() <= before
        if name == "byte_bpe":
            assert n == before
        docs, before = out, n


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows and ids, empty tables and clashing columns in every stage."""
    import corpus_pipeline

    texts = [*ODD, " ".join(near_words(40, 1)), " ".join(near_words(40, 1)), "other text of its own"]
    ids = [*range(len(ODD)), 50, 50, None]
    names = ["_copies", "_copy", "_id", "id", "h", "_cut", "_span_h", "node"]
    docs = frame(spark, texts, ids)
    docs = docs.withColumnsRenamed({"fingerprint": names[0], "words": names[1]}).selectExpr("*", *[f"7 as {n}" for n in names[2:]])
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        rows = out.collect()
        assert f(spark, docs.where("false"), SF).count() == 0, name
        if name == "byte_bpe":
            assert len(rows) == len(texts)
            continue
        assert out.columns == docs.columns and {r["_copies"] for r in rows} <= {"clash"} and {r["id"] for r in rows} <= {7}, name
        got = [r["doc_id"] for r in rows]
        if name == "language_id":
            assert sorted(x for x in got if x is not None) == [x for x in ids if x is not None and any(map(str.isalpha, texts[ids.index(x)] or ""))]
        if name == "line_dedup":
            assert None in got and 3 in got and 0 in got
        if name == "simhash_near_dedup":
            assert got.count(50) == 2 and None in got and got.count(4) == 1 and 5 not in got
        if name == "source_mixing":
            assert set(got) <= set(ids) and len(rows) <= 2 * len(texts) + 4


def test_simhash_and_others_on_empty_tables(spark):
    empty = frame(spark, [], [])
    assert quality.quality(empty).count() == bpe.digests(empty).count() == licenses.scan(empty).count() == simhash.fingerprints(empty).count() == 0
    twice = frame(spark, ["one two", "one two", None], [1, 1, None])
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in quality.quality(twice).collect()) == [(0, 0), (1, 2), (1, 2)]
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.digests(twice).collect()) == [(0, 0), (1, 2), (1, 2)]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 40, 900, 5000):
        base = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        a, b = np.unique(base[rng.random(n) < 0.9]), np.unique(base[rng.random(n) < 0.9])
        bits = sum(int(x).bit_count() for x in (simhash.parities(a) ^ simhash.parities(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
        assert not (simhash.parities(a) ^ simhash.parities(a)).any()


def test_prefix_with_very_many_common_shingles():
    import time

    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 2**63, 300_000).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.integers(0, 2**63, 400).astype(np.uint64), rng.choice(common, 40)])) for _ in range(100)]
    began = time.process_time()
    got = [simhash.prefix(x, common) for x in sets]
    assert time.process_time() - began < 2  # 9 s where each set sorts all of common
    for x, p in list(zip(sets, got))[:3]:
        assert p.tolist() == sorted(x.tolist(), key=lambda s: (s in set(common[np.searchsorted(common, x) % len(common)].tolist()), s))[: len(p)]
    assert simhash.prefix(sets[0][:0], common).size == 0 and simhash.prefix(common[-3:], common[:5]).tolist() == common[-3:-2].tolist()


def test_similar_texts_shuffle_no_texts(spark, monkeypatch):
    """Where tables are too large to be broadcast, only marked texts are read again; parities tell sets apart before."""
    plans, sizes, keep = [], {}, simhash.materialize

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        out = keep(df, name)
        sizes.setdefault(name, out.count())
        return out

    texts = [" ".join(near_words(200, s)) for s in range(40)]
    texts += [" ".join([*t.split()[:100], "edit", *t.split()[101:]]) for t in texts[:3]]
    texts += [" ".join(near_words(150, 900) + near_words(200, 950 + s)) for s in range(30)]  # alike in much, but not enough
    df = frame(spark, texts)
    rows = df.selectExpr("doc_id as id", "xxhash64(text) as h", "text")
    assert {r["id"] for r in simhash.marked(rows, rows.where("id % 7 = 3").select("id", "h")).collect()} == {i for i in range(len(texts)) if i % 7 == 3}
    monkeypatch.setattr(simhash, "COMMON", 3)
    monkeypatch.setattr(simhash, "materialize", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["id"]: r["component_id"] for r in simhash.similar_texts(df).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {i: i - 40 if 40 <= i < 43 else i for i in range(len(texts))}
    again = [p for name, p in plans if name in ("prefixes_again", "shingle_sets")]
    assert len(again) > 1 and all("BroadcastHashJoin" in p for p in again)
    assert all("SortMergeJoin" not in p for name, p in plans if name == "prefixes_again")
    assert sizes["candidates"] < 10


def test_similar_texts_by_fingerprints_first(spark, monkeypatch):
    """The bit groups find all sets within a radius; what lies further apart is found all the same."""
    rng, radius = np.random.default_rng(5), 3
    fps = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    fps += [f ^ sum(1 << int(b) for b in rng.choice(62, k % 6, replace=False)) for k, f in enumerate(fps)]  # 0 to 5 bits apart
    least = {}
    for node, f in enumerate(fps):
        least.setdefault(f, node)
    want = {(least[f], node) for node, f in enumerate(fps) if least[f] != node}
    want |= {(least[a], least[b]) for a in least for b in least if least[a] < least[b] and (a ^ b).bit_count() <= radius}
    sets = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    assert {tuple(r) for r in simhash.fingerprint_pairs(sets, radius).collect()} == want and len(want) >= 40

    texts = [" ".join(near_words(300, s)) for s in range(12)]
    texts += [" ".join([*t.split()[:-k], *["edit"] * k]) for t in texts for k in (1, 30)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    bits = [(simhash.majority(sets[i]) ^ simhash.majority(sets[12 + 2 * i + j])).bit_count() for i in range(12) for j in (0, 1)]
    assert sum(b <= radius for b in bits) > 8 and sum(b > radius for b in bits) > 8
    found, keep, pairs = [], simhash.connected_components, simhash.fingerprint_pairs
    monkeypatch.setattr(simhash, "connected_components", lambda edges: found.append(edges.count()) or keep(edges))
    label = {i: i if i < 12 else (i - 12) // 2 for i in range(len(texts))}
    for each, n in ((lambda x: pairs(x, radius), sum(b <= radius for b in bits)), (lambda *a: pairs(*a).where("false"), 0)):
        monkeypatch.setattr(simhash, "fingerprint_pairs", each)
        found.clear()
        assert {r["id"]: r["component_id"] for r in simhash.similar_texts(frame(spark, texts)).collect()} == label
        assert n <= found[0] <= n + 12 and found[-1] >= 24  # links by fingerprints; all
