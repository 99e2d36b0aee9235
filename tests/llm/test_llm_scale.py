"""The training-data operators at their borders: hot groups, mixed lengths, very long texts, held-out formats, and the whole pipeline."""

import hashlib
import itertools
import json
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("strataspark.llm")
from strataspark.llm import ann, chat, embed_dedup, mixing, ngram_join, pieces, quality, queries, secret_scan, token_count, warc  # noqa: E402

from .test_llm import docs, shingles  # noqa: E402


# --- n-gram join -----------------------------------------------------------------------------------------------------


def linked(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def classes_of(sets):
    comp = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and comp[i] != comp[j] and linked(sets[i], sets[j]):
            a, b = comp[i], comp[j]
            comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def test_linked_sets_share_a_signature():
    """Pairs at the threshold of every size, all kinds of difference: some signature is common."""
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5, 6, 7, 9, 12, 18, 30, 45, 80, 150, 400, 1500):
        for _ in range(12):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            for mine, yours in ((0, n // 4), (n // 4, 0), (n // 8, n // 8)):
                a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, mine, dtype=np.uint64)]))
                b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, yours, dtype=np.uint64)]))
                if 100 * n >= 80 * (n + mine + yours):
                    sig, of = ngram_join.signatures([a, np.zeros(0, np.uint64), b])
                    assert set(sig[of == 0]) & set(sig[of == 2]) and not (of == 1).any()


def test_unlinked_sets_rarely_share_a_signature():
    """No bucket fills with what sets don't hold."""
    rng = np.random.default_rng(3)
    for n in (6, 20, 60, 300, 1000):
        sig, of = ngram_join.signatures([np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for _ in range(400)])
        assert np.unique(sig, return_counts=True)[1].max() <= 8


def test_hot_signatures_meet_in_their_batch(spark):
    """With a limit of two sets a batch, all candidate pairs of a bucket stay joined: by pairs with its first set, or as members."""
    base = [f"v{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 80, 4)]
    d = docs(spark, texts).repartition(3)
    blobs = ngram_join._signature_blobs(d, 32, 2)
    assert blobs.where("part < 0").count() > 0
    rows = pd.concat([ngram_join._buckets(3)(g) for _, g in blobs.toPandas().groupby("part")])
    members, seen = {}, {}
    for sets in [list(ngram_join.shingle_sets([t.encode()]))[0] for t in texts]:
        for s in np.unique(ngram_join.signatures([sets])[0]).astype(np.int64).tolist():
            seen.setdefault(s, set()).add(ngram_join.set_key(sets)[0])
    for s, k in rows.loc[rows.kind == 1, ["a", "b"]].itertuples(index=False):
        members.setdefault(s, set()).add(k)
    pairs = set(map(tuple, rows.loc[rows.kind == 0, ["a", "b"]].to_numpy().tolist()))
    for s, own in seen.items():
        if s in members:
            assert members[s] == own  # the whole bucket is there
        else:
            assert all((min(x), max(x)) in {(min(p), max(p)) for p in pairs} for x in itertools.combinations(own, 2))


def test_one_id_on_several_texts(spark):
    a, b = "the old mill by the river runs and nobody minds the wheel at all", "some other text of quite different words that stands under one id as well here"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " x"), (None, a), (5, ""), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.similarity_classes(d).collect())
    n = len(shingles(a)), len(shingles(b)), len(shingles(a + " x"))
    assert got == sorted([(1, n[0], 1), (1, n[1], 1), (2, n[0], 1), (3, n[1], 1), (4, n[2], 1), (0, n[0], 0), (5, 0, 5), (5, 0, 5)])
    assert sorted((r.doc_id or 0, r.text) for r in ngram_join.deduplicated(d).collect()) == sorted([(0, a), (1, a), (1, b), (5, "")])


# --- vectors ---------------------------------------------------------------------------------------------------------


def test_vectors_of_several_lengths(spark):
    """One odd row excludes only itself."""
    rng = np.random.default_rng(5)
    v = [[1.0, 2.0, 3.0 + i / 100] for i in range(9)] + [[1.0, 2.0, 3.0, 4.0]] + rng.standard_normal((3, 5)).tolist()
    d = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(d).collect()}
    assert [got[i] for i in range(10)] == [8] * 9 + [0]
    near = ann.nearest(d, F.col("vec_id").isin(0, 9, 10), k=3).collect()
    assert {(r.query_id, r.vec_id) for r in near} == {(0, 8), (0, 7), (0, 6), (10, 11), (10, 12)}


def test_nearest_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 16))
    x[100:140] = x[3]  # ties go to the smaller id
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(d, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q, rows in got.items():
        score = (x * x[q]).sum(1)
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, 11))
        assert all(s == pytest.approx(score[i], abs=1e-12) for _, i, s in rows)
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(rows, rows[1:]))
        want = sorted((-score[i], i) for i in range(400) if i != q)[:10]
        hits += len({i for _, i in want} & {i for _, i, _ in rows})
    assert hits >= 0.97 * 200


def test_dense_groups_count_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PAIR_LIMIT", 3)
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal((3, 12))
    x = np.concatenate([centre[i % 3] + rng.standard_normal((30, 12)) * s for i, s in enumerate((0.05, 0.12, 0.25, 0.3))])
    x = np.concatenate([x, x[:5], rng.standard_normal((20, 12))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    n = np.sqrt((x * x).sum(1))
    links = (x @ x.T / n / n[:, None] >= 0.95) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    for _ in x:
        comp = np.array([min(comp[i], *comp[links[i]]) if links[i].any() else comp[i] for i in range(len(x))])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(d).collect()}
    assert got == {i: (int(links[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(x))}


def test_signatures_are_written_in_six_bytes(spark):
    """Six bytes a signature and one a count give back the signatures and keys."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (4, 9, 40, 300, 9000)]
    got = set()
    rows = [r for r in ngram_join._signature_blobs(docs(spark, texts), 32, 64).collect()]
    for r in rows:
        assert len(r.sigs) == 6 * sum(r.times)
        sig = ngram_join._unpacked_signatures([bytes(r.sigs)])
        assert ((sig.view(np.uint64) >> np.uint64(59)) == r.part).all()
        got |= set(zip(sig.tolist(), np.repeat(np.frombuffer(r["keys"], np.int64), np.frombuffer(r.times, np.uint8)).tolist()))
    sets = [s for t in texts for s in ngram_join.shingle_sets([t.encode()])]
    sig, of = ngram_join.signatures(sets)
    keys = [ngram_join.set_key(s)[0] for s in sets]
    assert got == {(int(s), keys[o]) for s, o in zip(sig.view(np.int64), of)}


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_formats_of_held_out_credentials(spark):
    """Precision and recall of the method's spans: formats learnt from labelled values, keys and ordinary tokens never seen."""
    rng = np.random.default_rng(8)
    of = lambda chars, n: "".join(rng.choice(list(chars), n))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    makers = [lambda: "ghp_" + of(lower + upper + digit, 36), lambda: "sk-" + of(upper + digit, 32), lambda: of("0123456789ABCDEF", 40), lambda: "xoxb-" + of(digit, 12) + "-" + of(lower + upper + digit, 24)]
    labelled = [f"token = {m()} end" for m in makers for _ in range(25)]
    keys = [m() for m in makers for _ in range(25)]
    word = lambda: of("etaoinshrdlucmfwyp", int(rng.integers(16, 26)))
    plain = [f() for _ in range(60) for f in (word, lambda: word().capitalize(), lambda: word().upper(), lambda: f"www.{word()}.com/a-b", lambda: of(digit, 17), lambda: f"{word()[:8]}_{word()[:9]}_id", lambda: word()[:9] + word()[:9].capitalize(), lambda: "ghp_" + of(lower, 14))]
    texts = labelled + [f"see {k} there" for k in keys] + [f"a {w} b" for w in plain]
    got = secret_scan.findings(docs(spark, texts)).collect()
    found = {texts[r.doc_id][int(a) : int(b)] for r in got for x in r.spans.split(",") if x.startswith("format") for a, b in [x.split(":")[1:]]}
    assert len(found & set(keys)) >= 0.9 * len(keys) and len(found - set(keys)) <= 0.02 * len(found)


def test_formats_have_states_for_their_places():
    values = ["".join(np.random.default_rng(i).choice(list("0123456789abcdef"), 40)) for i in range(11)]
    (f,) = secret_scan.formats_of([secret_scan.sketch(v) for v in values])
    assert len(f.automaton.moves) == 41
    assert f.accepts(values[0][::-1], "x" * 40) and not f.accepts("a1" * 12, "x" * 24) and not f.accepts("LAAITIONELLEELLE", "U" * 16)


@pytest.mark.parametrize("n,chars,labelled", [(12, "ABCDEFGHJKMNPQRSTUVWXYZ0123456789", 60), (9, "abcdefghjkmnpqrstuvwxyzABCDEFGHJKMN0123456789", 60), (603, "abcdefghjkmnpqrstuvwxyzABCDEFGHJKMN0123456789", 60), (28, "abcdefghjkmnpqrstuvwxyz0123456789", 3)])
def test_formats_of_any_length_and_of_few_values(spark, n, chars, labelled):
    """Bare keys of 9, 12 or 603 characters, and such as three labelled values show, among ordinary words of all lengths."""
    rng = np.random.default_rng(n)
    start = "k9" if labelled > 3 else "zq_"
    key = lambda: start + "0a" * (chars[0] == "a") + "".join(rng.choice(list(chars), n - len(start) - 2 * (chars[0] == "a")))
    keys = [key() for _ in range(20)]
    word = lambda: "".join(rng.choice(list("etaoinshrdlucmfwyp"), int(rng.integers(3, 24))))
    words = [f() for _ in range(150) for f in (word, word, lambda: word().capitalize(), lambda: f"{word()}-{word()}", lambda: str(rng.integers(10**9)))]
    texts = [f"token = {key()} end" for _ in range(labelled)] + [f"see {k} there" for k in keys] + [f"a {w} b" for w in words] + ["secret = everything", "password: something"]
    got = secret_scan.findings(docs(spark, texts)).collect()
    found = {texts[r.doc_id][int(a) : int(b)] for r in got for x in r.spans.split(",") if x.startswith("format") for a, b in [x.split(":")[1:]]}
    assert set(keys) <= found and len(found & set(words)) <= 2


def test_every_value_and_token_counts_in_the_fit(spark, monkeypatch):
    """No sample: 9,000 values of one format leave three of another, and 17,000 tokens are all of the background; what Spark counts is what plain Python does."""
    rng = np.random.default_rng(12)
    of = lambda chars, n: "".join(rng.choice(list(chars), n))
    values = [of("0123456789ABCDEF", 40) for _ in range(9000)] + ["zq_" + of("abcdefghjk0123456789", 25) for _ in range(3)]
    tokens = [of("etaoinshrdlu", int(rng.integers(16, 24))) for _ in range(17_000)]
    d = docs(spark, [" ".join(f"token = {v} ." for v in values[i::50]) + " " + " ".join(tokens[i::50]) for i in range(50)])
    held = secret_scan._labelled(d)
    assert len(held["assign"]) == 9003 and len(held[""]) == len(set(tokens))
    got, want = secret_scan.fit(d), secret_scan.formats_of([secret_scan.sketch(v) for v in values])
    assert {tuple(sorted(f.starts.items())) for f in got.formats} == {tuple(sorted(f.starts.items())) for f in want}
    words = {secret_scan.symbols(v) for v in [*values[-3:], values[0], "x" * 40]}
    assert [[f.automaton.bits(w) for w in words] for f in got.formats] == [[f.automaton.bits(w) for w in words] for f in sorted(want, key=lambda f: min(secret_scan.pool(w) for w in map(secret_scan.symbols, values) if f.automaton.accepts(w)))]
    plain = sum(r.n for r in secret_scan._judged(secret_scan._tokens(d).where("kind = ''"), got.formats))
    assert plain == len(set(tokens))
    monkeypatch.setattr(secret_scan, "FORMS", 4)
    rows = secret_scan._judged(secret_scan._tokens(d).where("kind = ''"), got.formats)
    assert sum(r.n for r in rows) == plain and any(r.rare and r.word.startswith("W") for r in rows) and secret_scan._length_word("l" * 40 + "12-d") == "W" * 40 + "14"


def test_starts_count_by_chance():
    share = secret_scan.starts_of
    upper = list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    assert set(share(["AKIA" + "".join(np.random.default_rng(i).choice(upper, 16)) for i in range(600)])) == {"AKIA"}
    assert share(["AKIA12", "AKIA34", "AKIA56"])["AKIA"] == 0 and set(share(["sk_live_a1", "sk_live_b2", "sk_live_c3", "sk_test_d4", "sk_test_e5", "sk_test_f6"])) == {"sk_live", "sk_test"}
    assert share(["a1b2", "a9c3"]) == {"": 0.0} and share(["sk-a1b2"]) == {"sk-": 0.0} and share(["x" * 63] * 2) == {"x" * 63: 0.0}


def test_words_of_tokens_are_short():
    assert secret_scan.symbols("x9" * 5000) == "a" * 40 + "9960" and secret_scan.symbols("a9-" * 5000) == "W" * 40 + "14960"
    assert secret_scan.pool(secret_scan.symbols("Ab9" * 200)) == secret_scan.pool(secret_scan.symbols("Ab9")) == "M"


# --- quality ---------------------------------------------------------------------------------------------------------


def test_cumulative_link_fit_is_a_maximum():
    """Thresholds are ordered, and small moves of any of them or of the weights don't raise the penalised likelihood much."""
    rng = np.random.default_rng(9)
    n, k = 900, 12
    x = rng.random((n, k)) < 0.4
    score = x @ np.linspace(-2, 2, k) + rng.logistic(size=n)
    grade = np.digitize(score, [-0.7, 0.9])
    idx = [np.flatnonzero(r) for r in x]
    w, cuts = quality._fit(idx, [np.ones(len(i)) for i in idx], grade)
    assert cuts[0] < cuts[1]
    used = np.flatnonzero(w[:k])

    def loss(w, cuts):
        tail = 1 / (1 + np.exp(-((x[:, used] @ w)[:, None] - cuts)))
        p = np.concatenate([np.ones((n, 1)), tail], 1) - np.concatenate([tail, np.zeros((n, 1))], 1)
        return -np.log(p[np.arange(n), grade]).mean() + quality.RIDGE / 2 * (w * w).sum()

    at = loss(w[used], cuts)
    for step in (1e-2, -1e-2):
        for j in range(len(used)):
            assert loss(w[used] + step * (np.arange(len(used)) == j), cuts) > at - 1e-5
        for j in range(2):
            assert loss(w[used], cuts + step * (np.arange(2) == j)) > at - 1e-5


def test_fit_takes_every_labelled_document(spark):
    """Telling words that only a few of 9,000 labelled documents hold are learned, and the model is the one that the rows at hand give, however they are dealt."""
    rows = [(i, f"plain words of row r{i % 7} and " + ("junk!! offer" if i % 3 == 0 else "river mill")) for i in range(9000)]
    rows += [(9000 + i, f"rare zzyzx{i} qvortex") for i in range(60)]
    labels = [(i, int(i % 3 > 0 and i < 9000), 0) for i in range(9060)]
    d, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    few = [(i, t, q) for (i, t), (_, q, _) in zip(rows, labels)]
    idx, val = zip(*(quality._scaled(r) for r in quality.features([t.encode() for _, t, _ in few])))
    grade = np.array([2 * q for *_, q in few])
    w, cuts = quality._fit(list(idx), list(val), grade)
    one, two = quality.train(d.repartition(3), marks), quality.train(d.repartition(5), marks.repartition(2))
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1])
    assert np.abs(one[0] - w).max() < 1e-3 and np.abs(one[1] - cuts).max() < 1e-2


def test_features_take_little_memory():
    """A worker's arrays stay under 30 MB over 4 MB of texts in one batch, and compressed repeats of 64 MB are not opened at once; the features are the same either way."""
    rng = np.random.default_rng(4)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 5000, 700)) for _ in range(1200)]
    quality.word_hashes(*quality.word_spans(texts[:1])[:3])  # the tables of powers
    packed = [zlib.compress(b"all work and no play " * 6000)] * 500
    for rows in (lambda: quality.features(texts), lambda: quality.packed_features(packed)):
        tracemalloc.start()
        assert sum(map(len, rows())) > 0
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30e6
    both = zip(quality.features(texts), quality.packed_features(map(zlib.compress, texts)), strict=True)
    assert all(np.array_equal(a, b) for a, b in both)


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_pivotal_step_keeps_mass_and_expectation(spark):
    """One step of the fold, drawn many times: the sum of both fractions stays, and each one's mean is what it was."""
    df = spark.range(20_000).selectExpr("named_struct('doc_id', id, 'size', 1L, 'p', 0.3D + (id % 5) / 10) as a", "named_struct('doc_id', id + 1000000, 'size', 2L, 'p', 0.45D) as b")
    start = F.struct(F.col("a").cast(mixing.UNIT).alias("c"), F.array().cast(mixing.TOOK).alias("out"))
    got = df.select("a", "b", start.alias("s")).select("a", "b", mixing._pair(F.col("s"), F.col("b")).alias("s"))
    rows = got.select("a.p", "a.doc_id", F.col("s.c.doc_id").alias("left"), F.col("s.c.p").alias("rest"), F.col("s.out")[0]["doc_id"].alias("done"), F.col("s.out")[0]["took"].alias("took")).toPandas()
    assert np.allclose(rows.rest + rows.took, rows.p + 0.45) and ((rows.rest >= 0) & (rows.rest < 1)).all() and (rows.left != rows.done).all()
    mine = np.where(rows.done == rows.doc_id, rows.took, rows.rest)
    for p, g in pd.DataFrame({"p": rows.p.round(1), "m": mine}).groupby("p"):
        assert g.m.mean() == pytest.approx(p, abs=0.03)


def test_mix_of_one_hot_source(spark):
    """A source with most rows, one of a single huge document, and one of none: targets and the cap hold."""
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "hot") for i in range(800)] + [(900, " ".join(["v"] * 500), "one"), (901, None, "none"), (902, "", "none")]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {s: sum(r.size for r in got if r.source == s) for s in ("hot", "one", "none")}
    target = {r.source: r.target for r in got}
    assert target["none"] == 0 and target["one"] <= 3 * 500
    taken = {s: sum(r.taken for r in got if r.source == s) for s in size}
    assert taken["hot"] == pytest.approx(target["hot"], rel=0.01) and taken["none"] == 0 and all(r.taken <= 3 * r.size for r in got)
    assert abs(taken["one"] - target["one"]) <= 500


# --- very long texts -------------------------------------------------------------------------------------------------


def test_very_long_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(words, 250_000))
    texts = ["x" * 100_000 + " y", long, long + " end", "0123456789abcdef" * 6000, "password=" + "A1b2" * 9000]
    d = docs(spark, texts)
    tok = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(d, queries.tokenizer_path("byte_bpe_50k.json")).collect()}
    assert got == {i: (len(t), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    model = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = {r.doc_id: r for r in pieces.coded(d, model).collect()}
    assert all(list(rows[i].ids) == sp.encode(t) and rows[i].lossless for i, t in enumerate(texts))
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_classes(d).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
    found = {r.doc_id: r for r in secret_scan.findings(d).collect()}
    assert (found[3].n_hex, found[4].n_assign) == (1, 1)
    assert quality.grades(d, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 5
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    assert {r.page_id: r.payload_digest for r in warc.round_trip(pages).collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r.conv_id: r.loss_chars for r in chat.digests(turns).collect()} == {i: len(t) for i, t in enumerate(texts)}
    assert {r.size for r in mixing.mixture(d).collect()} == {len(t.split()) for t in texts}


def test_selected_records_are_read(spark, tmp_path):
    """A part of the index gives its records alone."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(60)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(pages, folder)
    got = warc.read_records(index.where("page_id % 7 = 0"), folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {i: f"page {i} " * 50 for i in range(0, 60, 7)}


def test_broken_formatted_texts_raise(spark):
    with pytest.raises(Exception, match="grammar"):
        chat.read_back(spark.createDataFrame([(1, "<turn>user\nno end")], "conv_id long, formatted string")).collect()


# --- pipeline --------------------------------------------------------------------------------------------------------


def _folder(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Nulls, repeated rows, copies, poor documents and a secret through run(), each stage against plain Python."""
    import corpus_pipeline
    import sentencepiece

    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(400)]
    good = [" ".join(rng.choice(words, 60)) for _ in range(80)]
    poor = [" ".join(f"{w}!!!$$$" for w in rng.choice(words, 40)) for _ in range(40)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in enumerate(good)]
    rows += [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(poor)]
    rows += [(200 + i, good[i], "en", "b", len(good[i])) for i in range(20)]  # copies under other ids
    rows += [rows[5], (300, good[7] + " extra", None, "b", None), (301, good[9] + " token = 0123abcd0123abcd0123abcd0123abcd", "en", "a", 1), (None, good[70][:-9] + "tail", None, None, None), (302, None, "en", "a", 0), (303, "", "en", "b", 0)]
    labels = [(i, 1, 0) for i in range(0, 80, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)] + [(7, None, None)]
    sf = _folder(spark, tmp_path, rows, labels)
    stages = dict(corpus_pipeline.STAGES)
    d0 = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in stages["quality"](spark, d0, sf).collect()}
    assert kept == {(r[0], r[1]) for r in rows if r[1] and "!!!" not in r[1]}
    d1 = spark.createDataFrame([r for r in rows if (r[0], r[1]) in kept], d0.schema)
    sets = {(r[0], r[1]): shingles(r[1]) for r in rows if (r[0], r[1]) in kept and r[0] is not None}
    names = sorted(sets)
    comp = classes_of([sets[n] for n in names])
    single = {names[c] for c in set(comp)} | {n for n in kept if n[0] is None}
    assert sorted((r.doc_id or 0, r.text) for r in stages["near_duplicates"](spark, d1, sf).collect()) == sorted((a or 0, t) for a, t in single)
    d2 = spark.createDataFrame([r for i, r in enumerate(rows) if (r[0], r[1]) in single and r not in rows[:i]], d0.schema)
    clean = {r.doc_id: r.text for r in stages["secrets"](spark, d2, sf).collect()}
    assert clean == {a: re.sub(r"token = \w+", "[secret]", t) for a, t in single}
    out = corpus_pipeline.run(spark, sf).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    texts = {a: model.encode(t) for a, t in clean.items()}
    assert out and all(r.lossless and list(r.ids) == texts[r.doc_id] for r in out)
    assert max(np.unique([r.doc_id or 0 for r in out], return_counts=True)[1]) <= 3


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    sf = _folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
