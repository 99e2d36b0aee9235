"""Ranked search, toxicity and periodic runs: against brute force and held-out labels, on edges and hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strataspark.llm")
from strataspark.llm import lexical, periodic, queries, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, n int, score string, item_id int, toxic string, key int, rank int"
LONG = " ".join(f"w{i % 97}" for i in range(40_000))


def docs(spark, rows, parts=3):
    """Documents with columns whose names are also names of the results."""
    return spark.createDataFrame([(i, t, 1, "s", 2, "t", 3, 4) for i, t in rows], SCHEMA).repartition(parts)


# --- ranked search ---------------------------------------------------------------------------------------------------


def tokens(t):
    return re.findall(lexical.PATTERN, (t or "").translate({i: i + 32 for i in range(65, 91)}))


def ranked(rows, items, k=10):
    bags = [(i, Counter(tokens(t))) for i, t in rows if tokens(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(tokens(t))
    df = Counter(t for _, b in bags for t in b)
    w = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
    out = []
    for item, terms in of.items():
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // total
            s = sum(w(t) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def searched(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "日本", "X9"]
    rows = [(i, " ,".join(rng.choices(words, weights=[1 / (j + 1) for j in range(64)], k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies: ties by id
    rows += [(7, rows[7][1]), (None, rows[7][1]), (2000, None), (2001, ""), (2002, ".,-"), (2003, LONG), (-5, "w1 W1 w1")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(50)] + [(3, "w5 zzz"), (None, "w1 w2"), (60, None), (61, "..."), (62, "unknown"), (63, " ".join(words))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = ranked(rows, items)
    assert searched(lexical.top_documents(docs(spark, rows, 5), table)) == want
    # Small trees, and items in several blocks.
    monkeypatch.setattr(lexical, "LEAF", 4)
    assert searched(lexical.top_documents(docs(spark, rows, 2), table, block_bytes=900)) == want
    assert searched(lexical.top_documents(docs(spark, rows), table, k=3)) == ranked(rows, items, 3)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert searched(lexical.top_documents(docs(spark, [(1, "a b")]), none)) == []
    assert searched(lexical.top_documents(docs(spark, [(1, "a b")]).limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string"))) == []


def test_bounds_prune_most_pairs(spark):
    """Items whose words few documents have: most pairs of leaves are never scored, and the result is whole."""
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(f"t{g}w{rng.randrange(30)}" for _ in range(20)) + " the of" for g in range(40) for _ in range(64)]
    items = [[f"t{g}w{j}" for j in range(8)] + ["the"] for g in range(40)]
    words = sorted({t for i in items for t in i})
    number = {t: i for i, t in enumerate(words)}
    bags = [Counter(number[t] for t in x.split() if t in number) for x in texts]
    w = np.array([math.floor(1000 * math.log((2 * len(texts) + 2) / (2 * sum(i in b for b in bags) + 1))) for i in range(len(words))])
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array([22] * len(texts), pa.int64()), pa.array([np.array(sorted(b), np.int32).tobytes() for b in bags], pa.binary()), pa.array([np.array([b[t] for t in sorted(b)], np.int32).tobytes() for b in bags], pa.binary())],
        names=["doc_id", "n", "terms", "tf"])

    class Sent:
        value = w

    class Frame:
        def mapInArrow(self, run, schema):
            return next(iter(run([batch])))

    kept = lexical.bounded
    try:
        lexical.bounded = lambda df: df
        tree = lexical._Leaves(lexical.leaves(Frame(), len(texts), 22 * len(texts), Sent))
    finally:
        lexical.bounded = kept
    terms = [np.array(sorted(number[t] for t in i), dtype=np.int32) for i in items]
    nodes = [lexical._Node(n, terms, w) for n in lexical.item_nodes(terms, w)]
    found, seen = lexical._Found(np.zeros(len(items)), 10), [0, 0]
    for node in nodes:
        lexical._seed(tree, node, found)
    first = found.need.copy()
    found = lexical._Found(first, 10)
    for node in nodes:
        lexical._search(tree, node, found, seen)
    assert seen[1] < 0.4 * seen[0]
    scores = np.zeros((len(texts), len(items)))
    for j, t in enumerate(terms):
        for i, b in enumerate(bags):
            scores[i, j] = sum(int(w[x]) * (10**9 * b[x] // (1000 * b[x] + 8 * 100)) for x in t if b[x])
    for j in range(len(items)):
        assert sorted(found.rows[j][0].tolist(), reverse=True) == sorted(scores[:, j], reverse=True)[:10]


# --- toxicity --------------------------------------------------------------------------------------------------------


def labelled(spark, n, seed=2, parts=4):
    """Documents of random words, a tenth of them with one of six insults."""
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "ne", "lu", "so", "ke", "pi"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 60))]
        bad = i % 10 == 3
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Blockhead", "dunce", "grubface", "Vexlout", "vexlouta", "oafish."])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_of_held_out_documents(spark):
    rows, labels = labelled(spark, 3000)
    more = [(90_001, None), (90_002, ""), (90_003, "ta ro mi " * 30_000), (90_004, "ta ro mi " * 30_000 + "blockhead"), (None, "a dunce"), (3, rows[3][1])]
    got = toxicity.toxicity(docs(spark, rows + more), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    got = got.collect()
    assert len(got) == len(rows) + len(more)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    of = {r.doc_id: r.predicted for r in got}
    out = [i for i, _ in rows if held_out(i)]
    assert sum(of[i] for i in out if i % 10 == 3) >= 0.97 * sum(i % 10 == 3 for i in out)
    assert sum(of[i] for i in out if i % 10 != 3) <= 0.01 * len(out)
    assert (of[90_001], of[90_002], of[90_003], of[90_004], of[None]) == (0, 0, 0, 1, 1)
    assert len({r.score for r in got if r.doc_id == 3}) == 1


def test_labels_of_held_out_documents_are_not_learned(spark):
    rows, labels = labelled(spark, 600)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs(spark, rows), x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels_of_both_kinds(spark):
    rows, labels = labelled(spark, 50)
    for some, score in ((labels.limit(0), 0), (labels.where("toxic = 0"), 0), (labels.where("toxic = 1").union(labels.where("toxic = 1")), 1), (labels.withColumn("toxic", F.lit(None).cast("int")), 0)):
        assert {round(r.score, 6) for r in toxicity.toxicity(docs(spark, rows), some).collect()} == {score}
    assert toxicity.toxicity(docs(spark, rows).limit(0), labels).collect() == []


def test_ratios_and_grams():
    texts = [b"ab Abc\tx", b"", b"abc"]
    got = list(toxicity.grams(texts))
    assert [len(g) for g in got] == [9, 0, 6]  # each n-gram of " ab ", " abc " and " x ", once
    assert set(got[2]) <= set(got[0])
    wanted = np.zeros(toxicity.DIM, dtype=bool)
    wanted[got[2][:2]] = True
    assert [len(g) for g in toxicity.grams(texts, wanted)] == [2, 0, 2]
    clean, toxic = np.array([90.0, 5.0, 50.0]), np.array([10.0, 60.0, 1.0])
    r = toxicity.ratios(clean, toxic, (100, 100))
    assert r == pytest.approx([math.log(11 / 74) - math.log(91 / 148), math.log(61 / 74) - math.log(6 / 148), math.log(2 / 74) - math.log(51 / 148)])


# --- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(w):
    """Every (start, period, length) by comparing words q apart, smallest period first."""
    n, out, seen = len(w), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, q, j + q - i))
            i = j + 1
    return sorted(out)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, q, m in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[2], r[1]), r[0], r[1]), default=None)
    top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, q, m in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def run_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tiles_find_all_runs():
    rng = random.Random(3)
    for _ in range(600):
        n, k = rng.randint(0, 130), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.7 and n:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
            w = w[:a] + [w[a + i % p] if a + i % p < n else 0 for i in range(n - a)] + [rng.randrange(k + 1) for _ in range(rng.randrange(20))]
        w = np.array(w, dtype=np.int64)
        want = brute_runs(w.tolist())
        assert sorted((s, q, e - s) for q, s, e in periodic.whole(periodic.fragments(w, 0, periodic.octaves(len(w)))).tolist()) == want
        for span in (16, 32):
            if len(w) > span:
                parts = []
                for at, low, high, first, last, x in periodic.pieces(w, span):
                    part = periodic.fragments(x, low, high, first, last)
                    part[:, 1:] += at
                    parts.append(part)
                assert sorted((s, q, e - s) for q, s, e in periodic.whole(periodic.stitched(np.concatenate(parts))).tolist()) == want


def test_runs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 90)))) for i in range(150)]
    rows += [(i, " ".join(f"u{j}" for j in range(rng.randint(1, 400)))) for i in range(200, 300)]
    rows += [(None, "a b " * 40), (500, None), (501, ""), (502, " \n\t\x0b\x0c\r "), (503, "É é" * 30), (504, "x\x00y " * 20), (505, "a " * 700), (505, "a " * 700), (506, "a b c " * 9), (9_007_199_254_740_993, "q w e " * 5)]
    want = sorted((expected(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in want) > 20
    for span in (16, 64, periodic.SPAN):
        got = periodic.periodic_runs(docs(spark, rows), span)
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert run_rows(got) == want
    assert periodic.periodic_runs(docs(spark, rows).limit(0)).collect() == []


def test_runs_of_very_long_and_repeated_documents(spark):
    block = " ".join(f"v{i}" for i in range(9000))
    rows = [(1, " ".join([block] * 5)), (2, "z " * 60_000)] + [(3, "k l " * 9000)] * 20
    got = {r.doc_id: r for r in periodic.periodic_runs(docs(spark, rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    h = {i: zlib.crc32(str(i).encode()) % 10 for i in (1, 2, 3)}
    assert 0 not in h.values()
    assert (got[1].start, got[1].period, got[1].length, got[1].collapsed_sha256) == (0, 9000, 45_000, sha(block))
    assert (got[2].n_runs, got[2].period, got[2].exponent_milli, got[2].collapsed_sha256) == (1, 1, 60_000_000, sha("z"))
    assert (got[3].n_runs, got[3].period, got[3].length) == (1, 2, 18_000)
    assert periodic.periodic_runs(docs(spark, rows)).count() == 22


def test_registered_queries_equal_brute_force(spark, sf):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert run_rows(queries.op13_periodic_runs(spark, sf)) == sorted((expected(i, t) for i, t in text.items()), key=repr)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert searched(queries.op11_dual_tree_search(spark, sf)) == ranked(list(text.items()), items)
