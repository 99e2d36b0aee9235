"""Toxicity: a linear classifier of character n-grams that are scaled by naive Bayes log-count ratios.

The n-grams are those of SIZES bytes inside words (A-Z lower-cased, a mark at both ends), hashed into DIM numbers; a text
has each or hasn't. Over the sample's documents, r = log of (share of n-gram f among the n-grams of toxic documents) /
(its share among those of clean ones), both smoothed. A document is the vector of r of the n-grams it has, and a logistic
regression on it gives the score, from 0 to 1. N-grams in fewer than LEAST_DOCS documents, or whose shares in both
classes differ by less than LEAST_Z standard errors, are left out.

The fit takes at most about SAMPLE labelled documents of each class that are not held out, by a hash of the id, and
weighs them back to the classes' shares; counts are summed per task before they are shuffled, and the fit itself is one
task of that bounded size. Scores cover every row and whole texts. Labels, language, source and id are no inputs of a
score.

Defined results: null or empty text has no n-grams; its score is that of the intercept. Held out are ids whose CRC-32 of
the decimal text leaves 1 by 3; a null id isn't. Labels with a null toxic or id are ignored; of several labels of one
document the highest counts. Repeated rows are scored alike; the fit takes the smallest text of each doc_id. Without
labels of both classes every score is the share of toxic labels, 0 without any. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunks, mix, stored

SAMPLE = 6_000
SIZES = (3, 4, 5, 6)
DIM = 1 << 20
ALPHA = 1.0
LEAST_DOCS, LEAST_Z = 4, 4.0
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 300, 0.05, 1e-3
#: Counts are shuffled in blocks of so many n-gram numbers.
BLOCK = 1 << 14
_SMALL = np.arange(256, dtype=np.uint64)
_SMALL[65:91] += np.uint64(32)
_SMALL[[9, 10, 11, 12, 13]] = 32


def grams(texts: list[bytes], wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each text its n-gram numbers, each once; of those `wanted` (a row of DIM) alone, if given."""
    for lo, hi in chunks(texts):
        part = texts[lo:hi]
        raw = _SMALL[np.frombuffer(b" " + b" ".join([*part, b""]), dtype=np.uint8)]
        space = raw == 32
        before = np.concatenate([[0], np.cumsum(space)])
        bounds = np.cumsum([0, *(len(t) + 1 for t in part)])
        at, found = [], []
        value = np.zeros(len(raw), dtype=np.uint64)
        for n in range(1, max(SIZES) + 1):
            value = value[: len(raw) - n + 1] * np.uint64(256) + raw[n - 1 :] if n > 1 else raw
            if n not in SIZES or len(value) == 0:
                continue
            # White space may stand at the n-gram's ends, not inside it.
            inner = before[n - 1 : len(raw)] - before[1 : len(raw) - n + 2]
            spot = np.flatnonzero(inner == 0)
            number = (mix(value[spot] + (np.uint64(n) << np.uint64(56))) % np.uint64(DIM)).astype(np.int64)
            if wanted is not None:
                held = wanted[number]
                spot, number = spot[held], number[held]
            at.append(spot)
            found.append(number)
        # An n-gram belongs to the text that its second byte is in, for a mark stands before each text.
        at, found = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, found))
        own = np.searchsorted(bounds, at, side="right") - 1
        key = np.unique(own * DIM + found)
        own, found = key // DIM, (key % DIM).astype(np.int32)
        cut = np.searchsorted(own, np.arange(len(part) + 1))
        for i in range(len(part)):
            yield found[cut[i] : cut[i + 1]]


def marks(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of documents that aren't held out."""
    held = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    held = held.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    return held.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of documents with each n-gram by class, in blocks; one row a block and task."""
    n = np.zeros((2, DIM), dtype=np.int32)
    for pdf in batches:
        for toxic, found in zip(pdf["toxic"], grams(list(pdf["text"]))):
            n[toxic, found] += 1
    for b in range(0, DIM, BLOCK):
        if n[:, b : b + BLOCK].any():
            yield pd.DataFrame({"block": [b // BLOCK], "n": [n[:, b : b + BLOCK].tobytes()]})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The counts of a block, of n-grams that occur in LEAST_DOCS documents."""
    n = np.zeros((2, BLOCK), dtype=np.int64)
    for data in pdf["n"]:
        n += np.frombuffer(data, np.int32).reshape(2, BLOCK)
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "clean": [n[0].tobytes()], "toxic": [n[1].tobytes()]})


def ratios(clean: np.ndarray, toxic: np.ndarray, docs: tuple[int, int]) -> np.ndarray:
    """The naive Bayes log-count ratio of each n-gram; 0 of those that are left out."""
    p, q = ALPHA + toxic, ALPHA + clean
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    share = (clean + toxic) / sum(docs)
    z = np.abs(toxic / docs[1] - clean / docs[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / docs[0] + 1 / docs[1]))
    return np.where((clean + toxic >= LEAST_DOCS) & (z >= LEAST_Z), r, 0.0)


def _fit(found: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight for each n-gram of a logistic regression on r, and the intercept, by full-batch Adam; deterministic."""
    used = np.flatnonzero(r)
    place = np.zeros(DIM, dtype=np.int64)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    col = place[np.concatenate([np.zeros(0, np.int32), *found])]
    x = r[used][col]
    theta = np.zeros(len(used) + 1)
    share = (weight * toxic).sum() / weight.sum()
    theta[-1] = np.log(share / (1 - share))
    weight = weight / weight.sum()
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        score = np.bincount(row, x * theta[col], minlength=len(found)) + theta[-1]
        off = weight * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - toxic)
        grad = np.concatenate([np.bincount(col, x * off[row], minlength=len(used)) + RIDGE * theta[:-1] / max(1, len(found)), [off.sum()]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-10)
    out = np.zeros(DIM)
    out[used] = theta[:-1] * r[used]
    return out, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """What each n-gram adds to the log-odds, and the intercept."""
    held = marks(labels)
    n = {int(r.toxic): r.n for r in held.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    if len(n) < 2:
        share = 1.0 if n.get(1) else 0.0
        return np.zeros(DIM), 40.0 if share else -40.0
    part = {k: 1_000_000 if v <= most else int(1_000_000 * most / v) for k, v in n.items()}
    pick = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, part[1]).otherwise(part[0])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("octet_length(text) > 0")
    rows = rows.join(F.broadcast(held.where(pick)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = bounded(stored(rows, "toxic-sample"))
    seen = {int(r.toxic): r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return np.zeros(DIM), 40.0 if seen.get(1) else -40.0
    summed = sample.select("toxic", "text").mapInPandas(_counts, "block int, n binary").groupBy("block").applyInPandas(_summed, "block int, clean binary, toxic binary")
    clean, toxic = np.zeros(DIM), np.zeros(DIM)
    for got in summed.toLocalIterator():  # at most DIM / BLOCK rows
        at = slice(got.block * BLOCK, (got.block + 1) * BLOCK)
        clean[at], toxic[at] = np.frombuffer(got.clean, np.int64), np.frombuffer(got.toxic, np.int64)
    r = ratios(clean, toxic, (seen[0], seen[1]))
    wanted = docs.sparkSession.sparkContext.broadcast(r != 0)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "found": [f.tobytes() for f in grams(list(pdf["text"]), wanted.value)]})

    share = {k: n[k] / seen[k] for k in (0, 1)}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        mark = pdf["toxic"].to_numpy()
        w, intercept = _fit([np.frombuffer(b, np.int32) for b in pdf["found"]], mark, np.where(mark == 1, share[1], share[0]), r)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "w": [w[at].tobytes()], "intercept": [intercept]})

    got = sample.mapInPandas(vectors, "doc_id long, toxic int, found binary").groupBy(F.lit(1).alias("one")).applyInPandas(fit, "at binary, w binary, intercept double").first()
    out = np.zeros(DIM)
    out[np.frombuffer(got.at, np.int32)] = np.frombuffer(got.w)
    return out, got.intercept


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score of every row."""
    weights, intercept = model
    sent = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), weights != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, wanted = sent.value
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            odds = np.array([w[f].sum(dtype=np.float64) for f in grams(texts, wanted)]) + intercept
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return bounded(rows).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    s = scored(docs, train(docs, labels))
    return s.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
