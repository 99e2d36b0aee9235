"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct five-word shingles. Two sets A, B with Jaccard >= 0.8 differ in at most
(|A|+|B|)/9 elements. The pair's level is fixed by |A|+|B|; a level deals the feature domain to m partitions. A document
emits, at each level that a partner of 0.8 to 1.25 times its size can have with it, one signature for each of its first
k+1 strong partitions, k being the most differing elements of any such partner. At most k of A's first k+1 strong
partitions differ in B, so some partition agrees; the first one that agrees has at most k strong partitions before it in
B too (any of those differs, else it would agree earlier), so B emits it as well: no linked pair is lost. A strong
partition holds two or more of the shingles, or at levels of small sets one or more. Levels grow by an eighth, and each
has the fewest partitions with which sets of its sizes have SAFE standard deviations more strong ones than they need, if
any number does. A document with fewer than k+1 strong partitions also signs its first k+1 partitions whatever they
hold, apart from the others' signatures; of two such documents, at least one of those partitions agrees. They are rare,
so what all of them share (partitions that hold nothing) stays small.

Exact copies carry the same set key and so count once. Buckets of up to PAIR_LIMIT sets give all their pairs; of larger
ones, first the pairs with the smallest set are verified, and then, in blocks, those that these links leave in different
components: pairs whose parity sketches allow the similarity are verified too, in the block's task, which gives only the
links that join components. No bucket is capped.

Defined results: null or empty text and text of white space: n_shingles 0, linked with nothing. Fewer than five words:
one shingle, the whole sequence. Repeated rows: each stays a row and has the same class. Rows of one id with different
texts are classes of their own, with that id. A null doc_id stays a row whose component_id is null, linked with nothing.
A text of any length is one row's work. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunks, components, discard, fresh, joined, mapped, mix, stored, word_hashes, word_spans

WORDS = 5
#: Links: NUM * union <= DEN * intersection.
NUM, DEN = 80, 100
PAIR_LIMIT = 24
BLOCK = 1024
#: Signatures that one bucket task sorts, about, and the most such tasks.
PER_PART, MOST_TASKS = 1_500_000, 20_000
#: A signature of so many sets of a batch is large at once.
HEAVY = 64
#: Bytes that tell a signature: its level and 40 bits. Fewer bits may only bring more candidates, which are verified.
KEPT = 6
#: Standard deviations by which a level's sets have more strong partitions than they need.
SAFE = 3.0
_COEF = np.array([0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct shingles."""
    for lo, hi in chunks(texts):
        raw, starts, ends, first = word_spans(texts[lo:hi])
        w = word_hashes(raw, starts, ends)
        if len(w) >= WORDS:
            rows = len(w) - WORDS + 1
            s = w[:rows] * _COEF[0]
            for j in range(1, WORDS):
                s = s + w[j : j + rows] * _COEF[j]
            s = mix(s)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= WORDS:
                yield np.unique(s[a : b - WORDS + 1])
            elif b > a:
                yield mix((w[a:b] * _COEF[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    return int(mix(s).sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _strong_share(mean: float, least: int) -> float:
    """How many of partitions with so many shingles on average hold the least, if they fall at random."""
    return 1 - math.exp(-mean) * (1 + mean if least == 2 else 1)


def _partitions(prev: int, top: int, least: int) -> tuple[float, int]:
    """For sets of a level: how many standard deviations the strong partitions exceed the needed ones, at the worst size, and the fewest partitions that reach SAFE, else those that come nearest."""
    best = (-math.inf, 1)
    sizes = [max(1, round((prev + 1) / (1 + DEN / NUM) + f * (top / (1 + NUM / DEN) - (prev + 1) / (1 + DEN / NUM)))) for f in (0, 0.25, 0.5, 0.75, 1)]
    for mean in np.arange(4.0, 1.0, -0.1):
        m = max(1, round(top / 2 / mean))
        gap = math.inf
        for n in sizes:
            p = _strong_share(n / m, least)
            need = _need(n, top)
            gap = min(gap, (m * p - need) / math.sqrt(max(1e-9, m * p * (1 - p)))) if m >= need else -math.inf
        if gap >= SAFE:
            return gap, m
        best = max(best, (gap, m))
    return best


def _need(n, top):
    """One more than the most differing elements of a set of n shingles and a partner at a level."""
    return np.minimum(top, n + n * DEN // NUM) * (DEN - NUM) // (DEN + NUM) + 1


def _levels() -> list[tuple[int, int, int]]:
    """(largest |A|+|B|, partitions, shingles that make one strong) by level. Sets of the first level are equal or not linked: one partition."""
    out, prev, top = [(8, 1, 1)], 8, 9
    while top < 1 << 40:
        ways = [(*_partitions(prev, top, least), least) for least in (2, 1)]
        gap, m, least = next((w for w in ways if w[0] >= SAFE), max(ways))
        out.append((top, m, least))
        prev, top = top, top + top // 8 + 1
    return out


LEVELS = _levels()
_TOPS, _PARTS, _STRONG = (np.array(x, dtype=np.int64) for x in zip(*LEVELS))


def _spread(sig: np.ndarray) -> np.ndarray:
    """Signatures of which the first bytes, by which they are dealt to parts, follow from the last KEPT."""
    low = sig & np.uint64((1 << 8 * KEPT) - 1)
    return low | mix(low) & ~np.uint64((1 << 8 * KEPT) - 1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of sets, and for each the number of its set; all sets of a batch at a time. A signature's last byte is its level."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    if not n.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    salted = mix(s ^ np.uint64(0x2545F4914F6CDD1D))
    halves = (salted & np.uint64(0xFFFFFFFF)).astype(float), (salted >> np.uint64(32)).astype(float)
    low, high = np.searchsorted(_TOPS, n + -(-n * NUM // DEN)), np.searchsorted(_TOPS, n + n * DEN // NUM)
    out, owner = [], []
    for step in range(int((high - low)[n > 0].max()) + 1):
        level = low + step
        here = (n > 0) & (level <= high)
        level = np.where(here, level, 0)
        parts = np.where(here, _PARTS[level], 0)
        base = np.cumsum(parts) - parts
        some = here[of]
        unit = (base[of] + (s % np.maximum(parts, 1).astype(np.uint64)[of]).astype(np.int64))[some]
        held = np.bincount(unit, minlength=int(parts.sum()))
        # The sum of a partition's hashes, by halves, which stay whole numbers in a double.
        a, b = (np.bincount(unit, weights=h[some], minlength=len(held)).astype(np.uint64) for h in halves)
        sums = mix(a) + b
        owns = np.repeat(np.arange(len(sets)), parts)
        place = np.arange(len(held)) - base[owns]
        need = np.where(here, _need(n, _TOPS[level]), 0)
        strong = held >= _STRONG[level][owns]
        rank = np.cumsum(strong)
        rank = rank - np.concatenate([[0], rank])[base][owns]
        total = np.bincount(owns[strong], minlength=len(sets))
        tag = (2 * level).astype(np.uint64)[owns]
        for keep, odd in ((strong & (rank <= need[owns]), 0), ((total < need)[owns] & (place < need[owns]), 1)):
            at = np.flatnonzero(keep)
            sig = mix(mix(sums[at] + tag[at] + np.uint64(odd)) + place[at].astype(np.uint64))
            out.append(_spread(sig & ~np.uint64(255) | level[owns[at]].astype(np.uint64)))
            owner.append(owns[at])
    return np.concatenate(out), np.concatenate(owner)


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t or b"" for t in pdf["text"]]


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, th (a hash of the text), n_shingles, and the two hashes of the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(len(s), *set_key(s)) for s in shingle_sets(_texts(pdf))]
            n, k1, k2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "n_shingles": np.array(n, np.int64), "k1": np.array(k1, np.int64), "k2": np.array(k2, np.int64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("th"), F.col("text").cast("binary").alias("text"))
    return mapped(rows, run, "doc_id long, th long, n_shingles long, k1 long, k2 long", "doc_id")


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])), [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _signature_blobs(docs: DataFrame, parts: int, most: int) -> DataFrame:
    """Signatures with set keys, packed by bucket part: a row for each part and batch. keys holds each set once for up to 255 signatures, times how many follow for it; heavy the signatures that are large already.

    Of a signature KEPT bytes are written, from which the others follow.

    A signature of over `most` sets of a batch leaves one of them in its part; all of them go, as pairs with that one and
    as members, to a part of the batch's own (a negative number), so a signature that a third of all sets holds isn't
    gathered.
    """
    shift = np.uint64(64 - int(parts).bit_length() + 1)

    def packed(part: int, sig: np.ndarray, key: np.ndarray, heavy: np.ndarray) -> tuple:
        at = _runs(key)
        n = np.diff(at)
        more = -(-n // 255)
        times = np.full(int(more.sum()), 255, dtype=np.uint8)
        times[np.cumsum(more) - 1] = n - 255 * (more - 1)
        return part, sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes(), np.repeat(key[at[:-1]], more).tobytes(), times.tobytes(), heavy.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets, keys, seen = [], [], set()
            for s in shingle_sets(_texts(pdf)):
                key = set_key(s)[0]
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    keys.append(key)
            if not sets:
                continue
            sig, of = signatures(sets)
            key = np.array(keys, dtype=np.int64)[of]
            order = np.lexsort((key, sig))
            at = _runs(sig[order])
            many = np.flatnonzero(np.diff(at) > most)
            drop, rows = np.zeros(len(sig), dtype=bool), []
            heavy = sig[order[at[many]]]
            if len(many):
                own = np.concatenate([order[at[i] : at[i + 1]] for i in many])
                rows.append(packed(-1 - int(mix(sig[own[:1]])[0] % np.uint64(4 * parts)), sig[own], key[own], heavy[:0]))
                drop[np.concatenate([order[at[i] + 1 : at[i + 1]] for i in many])] = True
            sig, key = sig[~drop], key[~drop]
            part = (sig >> shift).astype(np.int64) if parts > 1 else np.zeros(len(sig), np.int64)
            order = np.lexsort((key, part))
            sig, key, part = sig[order], key[order], part[order]
            at = _runs(part)
            where = (heavy >> shift).astype(np.int64) if parts > 1 else np.zeros(len(heavy), np.int64)
            rows += [packed(int(part[a]), sig[a:b], key[a:b], heavy[where == part[a]]) for a, b in zip(at[:-1], at[1:])]
            yield pd.DataFrame(rows, columns=["part", "sigs", "keys", "times", "heavy"])

    texts = bounded(docs.select(F.col("text").cast("binary").alias("text")))
    return texts.mapInPandas(run, "part long, sigs binary, keys binary, times binary, heavy binary")


def _joined(column: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def _unpacked_signatures(column: pd.Series) -> np.ndarray:
    held = _joined(column, np.uint8).reshape(-1, KEPT)
    out = np.zeros((len(held), 8), dtype=np.uint8)
    out[:, :KEPT] = held
    return _spread(out.view("<u8").ravel()).view(np.int64)


def _buckets(limit: int):
    """The job of a part: candidate pairs (kind 0: a, b) of buckets of up to the limit and with the first set of larger ones; members of larger ones (kind 1: signature, key)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig, heavy = _unpacked_signatures(pdf["sigs"]), _joined(pdf["heavy"], np.int64)
        key = np.repeat(_joined(pdf["keys"], np.int64), _joined(pdf["times"], np.uint8))
        own = pdf["part"].iloc[0] < 0  # signatures that batches found to be large
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        keep = np.ones(len(sig), dtype=bool)
        keep[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[keep], key[keep]
        at = _runs(sig)
        length, first = np.diff(at), at[:-1]
        large = own | (length > limit) | np.isin(sig[first], heavy)
        a, b = [], []
        for n in np.unique(length[~large & (length > 1)]):
            rows = key[first[~large & (length == n)][:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            a.append(rows[:, i].ravel())
            b.append(rows[:, j].ravel())
        inside = np.repeat(large, length)
        lead = np.repeat(key[first], length)
        star = inside & (key != lead)
        a, b = np.concatenate([*a, lead[star]]).astype(np.int64), np.concatenate([*b, key[star]]).astype(np.int64)
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        out = np.concatenate([pairs, np.stack([sig[inside], key[inside]], 1)])
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(pairs), int(inside.sum())]).astype(np.int32), "a": out[:, 0], "b": out[:, 1]})

    return run


def _unpacked(column: pd.Series) -> list[bytes]:
    un = zstandard.ZstdDecompressor()
    return [un.decompress(z) for z in column]


def _class_texts(docs: DataFrame, needed: DataFrame, classes: DataFrame) -> DataFrame:
    """cid, z (compressed text), n of the classes that the named documents (doc_id) hold; their keys are taken from the texts, as an id may stand on several."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=1)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "z": [packer.compress(t) for t in _texts(pdf)]})

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                z = pdf["z"].iloc[lo : lo + 256]
                rows = [(len(s), *set_key(s)) for s in shingle_sets(_unpacked(z))]
                n, k1, k2 = zip(*rows, strict=True)
                yield pd.DataFrame({"k1": k1, "k2": k2, "n_shingles": n, "z": list(z)})

    texts = bounded(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")))
    packed = texts.mapInPandas(pack, "doc_id long, z binary").join(needed, "doc_id", "left_semi")
    found = packed.mapInPandas(keyed, "k1 long, k2 long, n_shingles long, z binary").join(classes.select("k1", "k2", "n_shingles", "cid"), ["k1", "k2", "n_shingles"])
    return found.groupBy("cid").agg(F.any_value("z").alias("z"), F.any_value("n_shingles").alias("n"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of classes, those that link, by their whole sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for lo in range(0, len(pdf), 256):
                some = pdf.iloc[lo : lo + 256]
                for x, y in zip(shingle_sets(_unpacked(some["za"])), shingle_sets(_unpacked(some["zb"]))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]

    held = pairs.join(texts.select(F.col("cid").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("cid").alias("b"), F.col("z").alias("zb")), "b")
    return bounded(held.select("a", "b", "za", "zb")).mapInPandas(run, "a long, b long")


def _sketch(s: np.ndarray, bits: int) -> bytes:
    """Parities of the set's elements in so many cells: two sets' sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def _sketches(texts: DataFrame) -> DataFrame:
    """The texts with their sets' sketches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                some = pdf.iloc[lo : lo + 256]
                yield some.assign(sets=[_sketch(s, 1 << max(8, int(2 * len(s)).bit_length())) for s in shingle_sets(_unpacked(some["z"]))])

    return bounded(texts).mapInPandas(run, "cid long, z binary, n long, sets binary")


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    """A sketch of more bits brought to fewer: the cells' number modulo the lesser power of two."""
    return np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of two blocks of a bucket, links (a, b) that join different components: pairs of the bucket's level whose sizes and sketches allow a link are checked by their whole sets, unless links found here already join them."""
    own = pdf[pdf["side"] == 2]  # a block with itself: each pair once
    left, right = (own, own) if len(own) else (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1])
    out, parent, sets = [], {}, {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    def set_of(d: int, z: bytes) -> np.ndarray:
        if d not in sets:
            sets[d] = next(shingle_sets([zstandard.ZstdDecompressor().decompress(z)]))
        return sets[d]

    if len(right) and len(left):
        packed = [np.frombuffer(z, np.uint8) for z in right["sets"]]
        rn, rc, rw = right["n"].to_numpy(), right["c"].to_numpy(), np.array([len(p) for p in packed])
        folded = {}
        level = int(pdf["bucket"].iloc[0]) & 255
        least, most = (int(_TOPS[level - 1]) if level else 0), int(_TOPS[level])
        rd, rz = right["cid"].tolist(), list(right["z"])
        for k, (d, n, c, z, sk) in enumerate(zip(left["cid"].tolist(), left["n"], left["c"].tolist(), left["z"], left["sets"])):
            x = np.frombuffer(sk, np.uint8)
            fresh_ = np.arange(len(right)) > k if len(own) else np.ones(len(right), dtype=bool)
            for w in np.unique(rw):
                width = min(int(w), len(x))
                here = np.flatnonzero(fresh_ & (rw == w) & (rc != c) & (rn + n > least) & (rn + n <= most) & (DEN * np.minimum(rn, n) >= NUM * np.maximum(rn, n)))
                if not len(here):
                    continue
                if (w, width) not in folded:
                    folded[w, width] = {"at": np.cumsum(rw == w) - 1, "bits": np.stack([_fold(p, width) for p in packed if len(p) == w])}
                f = folded[w, width]
                apart = np.bitwise_count(f["bits"][f["at"][here]] ^ _fold(x, width)).sum(axis=1, dtype=np.int64)
                for i in here[apart * (DEN + NUM) <= (rn[here] + n) * (DEN - NUM)].tolist():
                    p, q = root(c), root(int(rc[i]))
                    if p == q:
                        continue
                    s, t = set_of(d, z), set_of(rd[i], rz[i])
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if DEN * both >= NUM * (len(s) + len(t) - both):
                        parent[max(p, q)] = min(p, q)
                        out.append((min(d, rd[i]), max(d, rd[i])))
    return pd.DataFrame(np.array(out, dtype=np.int64).reshape(-1, 2), columns=["a", "b"])


def _remaining_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join what members (bucket, cid, n, c) of one bucket have in different components c.

    A pair has one level, by the sum of its sizes, and is sought in buckets of that level alone: a set without a partner
    in another component and of a size that fits is left out of a bucket. The rest is dealt to blocks, and a task
    compares two of them, or one with itself: each set goes to as many tasks as there are blocks. Where a large bucket
    has one component of most sets, which need not meet each other, the others are dealt to blocks of their own, and
    those meet the blocks of all.
    """
    tops = F.array(*(F.lit(t) for t in (0, *_TOPS.tolist())))
    low, high = (F.element_at(tops, (F.col("bucket").bitwiseAND(255) + i).cast("int")) for i in (1, 2))
    # A bucket has no more sizes than its level allows.
    sizes = members.groupBy("bucket", "n").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("bucket").agg(F.collect_list(F.struct("n", "lo", "hi")).alias("sizes"), F.sum("k").alias("k"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    sizes = stored(sizes.where("lo < hi").select("bucket", "sizes", "k", low.alias("low"), high.alias("high")), "sizes")
    fits = F.exists("sizes", lambda s: (s["n"] + F.col("n") > F.col("low")) & (s["n"] + F.col("n") <= F.col("high")) & ((s["lo"] != F.col("c")) | (s["hi"] != F.col("c"))))
    members = joined(members, sizes, ("bucket",), f"k * 1000 > {members.count()}").where(fits).select("bucket", "cid", "c")
    members = stored(members, "members")
    total = members.count()
    parts = members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.max("k").alias("most"), F.sum("k").alias("size"))
    parts = stored(parts.where("most < size"), "open")
    held = joined(members, parts, ("bucket",), f"size * 1000 > {total}").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    held = held.withColumn("at", F.expr("pmod(xxhash64(cid, 7), blocks)")).withColumn("few", F.ceil((F.col("size") - F.col("most")) / BLOCK))
    split = "blocks > 1 and 4 * (size - most) <= size"
    way = lambda i, j, side: f"struct({i} as i, {j} as j, {side} as side)"
    alike = F.expr(f"concat(array({way('at', 'at', 2)}), transform(filter(sequence(0L, blocks - 1), b -> b > at), b -> {way('at', 'b', 0)}), transform(filter(sequence(0L, blocks - 1), b -> b < at), b -> {way('b', 'at', 1)}))")
    every = F.expr(f"transform(sequence(0L, few - 1), b -> {way('b', 'at', 1)})")
    minor = F.expr(f"transform(sequence(0L, blocks - 1), b -> {way('pmod(xxhash64(cid, 8), few)', 'b', 0)})")
    ways = F.when(F.expr(f"not ({split})"), alike).otherwise(F.concat(every, F.when(F.expr("c <> major"), minor).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,side:int>>"))))
    dealt = held.select("bucket", "cid", "c", F.explode(ways).alias("w"))
    sketched = stored(_sketches(texts.join(dealt.select("cid").distinct(), "cid", "left_semi")), "sketches")
    dealt = dealt.select("bucket", "w.i", "w.j", "w.side", "cid", "c").join(sketched, "cid").select("bucket", "i", "j", "side", "cid", "n", "c", "z", "sets")
    return dealt.groupBy("bucket", "i", "j").applyInPandas(_block_links, "a long, b long").distinct()


def _classified(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, node (the component, null for rows without id or shingles), component_id of every row."""
    sets = stored(document_sets(docs), "sets")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    parts = 1 << max(5, int(0.8 * total / PER_PART).bit_length())
    blobs = _signature_blobs(docs, parts, HEAVY).repartition(min(parts, MOST_TASKS), "part")
    found = stored(blobs.groupBy("part").applyInPandas(_buckets(PAIR_LIMIT), "kind int, a long, b long"), "buckets")

    classes = sets.where("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    n, rows = classes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    by = lambda s: classes.select(F.col("k1").alias(f"k{s}"), F.col("cid").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("rep").alias(f"r{s}"))
    pairs = found.where("kind = 0").select(F.col("a").alias("ka"), F.col("b").alias("kb")).distinct().join(by("a"), "ka").join(by("b"), "kb")
    pairs = stored(pairs.where(f"{DEN} * least(na, nb) >= {NUM} * greatest(na, nb)").select("a", "b", "ra", "rb"), "pairs")
    large = found.where("kind = 1").select(F.col("a").alias("bucket"), F.col("b").alias("k1"))
    members = stored(large.distinct().join(classes.select("k1", "cid", "rep", F.col("n_shingles").alias("n")), "k1").select("bucket", "cid", "rep", "n"), "members")
    discard(found)

    needed = pairs.select(F.col("ra").alias("doc_id")).union(pairs.select("rb")).union(members.select("rep")).distinct()
    texts = stored(_class_texts(docs, needed, classes), "texts")
    links = stored(_verified(pairs, texts), "links")
    discard(pairs)
    comp = components(links)
    if not members.isEmpty():
        open_ = members.join(comp.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "n", F.coalesce("component", "cid").alias("c"))
        extra = stored(_remaining_links(stored(open_, "members"), texts), "extra")
        if not extra.isEmpty():
            comp = components(links.union(extra))
    discard(members, texts)
    named = classes.join(comp, classes.cid == comp.node, "left").select("k1", "k2", "n_shingles", "rows", "rep", F.coalesce("component", "cid").alias("node"))
    named = stored(named, "named")
    labels = stored(named.groupBy("node").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("k")), "labels")
    named = stored(joined(named, labels, ("node",), f"k * 1000 > {n}").select("k1", "k2", "n_shingles", "rows", "node", "component_id"), "classes")
    known = sets.where("n_shingles > 0 and doc_id is not null")
    done = joined(known, named, ("k1", "k2", "n_shingles"), f"rows * 1000 > {rows or 0}").select("doc_id", "th", "n_shingles", "node", "component_id")
    rest = sets.where("n_shingles = 0 or doc_id is null").select("doc_id", "th", "n_shingles", F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"))
    return done.union(rest)


def similarity_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= 0.8, itself included)."""
    return _classified(docs).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest doc_id (of equal ids, the text of smallest hash), and all documents without shingles, with all their columns; those without a doc_id stay. Repeated rows become one."""
    th, doc = fresh(docs, "th", "of_doc")
    rows = _classified(docs).where("doc_id is not null")
    first = rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("x.doc_id", "x.th")
    kept = first.union(rows.where("node is null").select("doc_id", "th")).distinct().select(F.col("doc_id").alias(doc), F.col("th").alias(th))
    held = docs.where("doc_id is not null").withColumn(th, _text_hash())
    held = held.join(kept.withColumnRenamed(th, th + "_"), (F.col("doc_id") == F.col(doc)) & (F.col(th) == F.col(th + "_")), "left_semi")
    return held.dropDuplicates(["doc_id", th]).drop(th).unionByName(docs.where("doc_id is null"))
