"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are ordered: 0 poor, 1 sound but toxic, 2 sound. Each word of a text gives five hashed features (the word, its
first five and seven bytes, its ending, its shape by character classes), and the text's share of different words gives one, valued by 1 + log of their count (in sixteenths); those whose frequency does not tell the grades
apart are left out. One weight per feature is shared by all
grades, and ordered thresholds cut the score: P(grade >= j) = logistic(score - threshold_j). The expected grade is the
sum of these tails; documents whose tail at the best grade falls under TAIL are rejected.

The fit uses every labelled document; texts are compressed before they meet their labels. One pass counts, by feature and
grade, the documents that hold it; a second one stores each labelled document's values of the kept features. The likelihood and its slope are sums over those rows: tasks
add up their rows, Spark adds the tasks' sums, and the driver, which sees one number a kept feature, takes the step
(L-BFGS). Values are whole sixteenths and summands whole multiples of 2^-28, so that sums don't depend on how rows are dealt to tasks.
Scores cover every row and whole texts.

Defined results: null or empty text, or white space only, has no features: its score is 0, its tails are 0, its expected
grade is 0, and it is rejected. Labels with a null quality are ignored; a null toxic counts as 0; of several labels of
one document the lowest grade counts. Repeated rows are scored alike; the fit takes of each doc_id the text of least MD5.
Without labels of two grades nothing is rejected: tails are 1. Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, bounded, chunks, discard, fresh, mix, stored, word_hashes, word_spans

DIM = 1 << 18
GRADES = 3
TAIL = 0.5
RESULTS = ("score", "expected_grade", "p_tail", "keep")
#: Bytes of a word's beginnings.
HEADS = (5, 7)
#: Steps of the fit at most, the slope at which it ends, and the least gain of a step, that must be missed twice.
STEPS, SLOPE, GAIN, RIDGE = 40, 1e-5, 1e-7, 1e-4
#: Summands of the fit are whole multiples of 1 / UNIT; sums of a batch are exact, and so are a task's.
UNIT = float(1 << 28)
#: A feature is kept if it is in so many labelled documents, and its share of a lower grade's documents is so many standard errors, and so much, off that of the best grade's.
LEAST_DOCS, LEAST_Z, LEAST_OFF = 5, 5.0, 0.05
#: Counts of so many features are added up at a place.
SHARE = 1 << 14
#: Documents whose summands of the fit a task holds at once.
SUMMED = 1024
#: Bytes, A-Z lower-cased, from 1 on.
_SMALL = np.arange(1, 257, dtype=np.uint64)
_SMALL[65:91] += np.uint64(32)
#: Character classes of shapes: lower case and bytes of other letters, upper case, digits, sentence marks, other marks.
_CLASS = np.full(256, 5, dtype=np.uint64)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4


def features(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text its hashed feature numbers: five for each word, and one for its share of different words."""
    for lo, hi in chunks(texts):
        raw, starts, ends, first = word_spans(texts[lo:hi])
        word = word_hashes(raw, starts, ends)
        tail = np.zeros(len(word), dtype=np.uint64)
        for k in (1, 2, 3):
            at = ends - k
            tail = tail * np.uint64(257) + np.where(at >= starts, raw[np.maximum(at, 0)], 0).astype(np.uint64)
        cls = _CLASS[raw]
        run = np.ones(len(raw), dtype=bool)
        run[1:] = cls[1:] != cls[:-1]
        place = np.concatenate([[0], np.cumsum(run)])
        shape = np.zeros(len(word), dtype=np.uint64)
        for k in range(4):  # first and last classes, number of class runs, length
            shape = shape * np.uint64(1009) + (cls[starts], cls[ends - 1], (place[ends] - place[starts]).astype(np.uint64), np.minimum(ends - starts, 12).astype(np.uint64))[k]
        head, heads = np.zeros(len(word), dtype=np.uint64), []
        for k in range(max(HEADS)):
            at = starts + k
            head = head * np.uint64(257) + np.where(at < ends, _SMALL[raw[np.minimum(at, len(raw) - 1)]], 0).astype(np.uint64)
            if k + 1 in HEADS:
                heads.append(mix(head + (np.uint64(k + 1) << np.uint64(44))))
        rows = np.stack([*heads, mix(word), mix(tail + np.uint64(1) << np.uint64(32)), mix(shape + np.uint64(3) << np.uint64(40))]) % np.uint64(DIM)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            own = np.zeros(0, dtype=np.int32)
            if b > a:  # how much of it is repetition, by the text's length
                again = 1 + 16 * (10 * len(np.unique(word[a:b])) // (b - a)) + int(b - a).bit_length() // 2
                own = (mix(np.array([again], dtype=np.uint64) << np.uint64(48)) % np.uint64(DIM)).astype(np.int32)
            yield np.concatenate([rows[:, a:b].ravel().astype(np.int32), own])


def packed_features(packed: Iterable[bytes]) -> Iterator[np.ndarray]:
    """features() of compressed texts, opened about CHUNK_BYTES at a time: repeated lines open to hundreds of times their bytes."""
    held, size = [], 0
    for p in packed:
        text = zlib.decompress(p)
        if held and size + len(text) > CHUNK_BYTES:
            yield from features(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield from features(held)


def _scaled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their values, 1 + log of the count, in sixteenths."""
    idx, n = np.unique(rows, return_counts=True)
    return idx, np.rint(16 + 16 * np.log(n)) / 16


def _telling(held: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The numbers of the features that are kept, ascending, from the documents that hold them (by feature and grade) and all documents (by grade)."""
    keep, best, nb = np.zeros(len(held), dtype=bool), held[:, -1], total[-1]
    for g in range(GRADES - 1):
        a, na = held[:, g], total[g]
        if na and nb:
            p, off = (a + best) / (na + nb), np.abs(a / na - best / nb)
            z = off / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / na + 1 / nb))
            keep |= (a + best >= LEAST_DOCS) & (z >= LEAST_Z) & (off >= LEAST_OFF)
    return np.flatnonzero(keep)


def _sums(theta: np.ndarray, row: np.ndarray, col: np.ndarray, v: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """Of some documents the slope of the negative log-likelihood by each parameter, and last its value, in whole multiples of 1 / UNIT.

    Parameters: weights of kept features, first threshold, logs of the gaps between thresholds.
    """
    k, n = len(theta) - GRADES + 1, len(grade)
    gaps = np.exp(theta[k + 1 :])
    cuts = theta[k] + np.concatenate([[0.0], np.cumsum(gaps)])
    score = np.bincount(row, v * theta[col], minlength=n)
    tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -40, 40)))
    upper = np.concatenate([np.ones((n, 1)), tail], 1)[np.arange(n), grade]
    lower = np.concatenate([tail, np.zeros((n, 1))], 1)[np.arange(n), grade]
    # d log(upper - lower) / d score = 1 - upper - lower for the logistic link.
    gs = -(1 - upper - lower)
    p = np.maximum(upper - lower, 1e-12)
    gc = np.stack([tail[:, j] * (1 - tail[:, j]) / p * ((grade == j + 1).astype(float) - (grade == j)) for j in range(GRADES - 1)], 1)
    by_cut = np.stack([gc.sum(1), *(gc[:, j + 1 :].sum(1) * gaps[j] for j in range(GRADES - 2))], 1)
    whole = lambda a: np.rint(a * UNIT)
    return np.concatenate([np.bincount(col, v * (whole(gs / 16) * 16)[row], minlength=k), whole(by_cut).sum(0), [whole(-np.log(p)).sum()]]).astype(np.int64)


def _least(sums: Callable[[np.ndarray], np.ndarray], held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds at the least mean loss of n documents with its penalty, by L-BFGS; deterministic.

    held: how many documents hold each feature. Steps are taken in weights times the root of that share, for a rare
    feature's weight moves the loss less.
    """
    k = len(held)
    unit = np.concatenate([1 / np.sqrt(np.maximum(held / n, 1e-4)), np.ones(GRADES - 1)])

    def at(theta: np.ndarray) -> tuple[float, np.ndarray]:
        got = sums(theta * unit) / UNIT / n
        own = np.where(np.arange(len(theta)) < k, theta * unit, 0.0)
        return got[-1] + RIDGE / 2 * (own @ own), (got[:-1] + RIDGE * own) * unit

    theta = np.zeros(k + GRADES - 1)
    theta[k] = -1.0
    value, grad = at(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    missed = 0
    for _ in range(STEPS):
        if np.abs(grad).max() <= SLOPE or missed == 2:
            break
        way, shares = -grad, []
        for d, g in reversed(past):
            shares.append((d @ way) / (d @ g))
            way = way - shares[-1] * g
        if past:
            way = way * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (d, g), share in zip(past, reversed(shares)):
            way = way + (share - (g @ way) / (d @ g)) * d
        step = 1.0 if past else min(1.0, 1 / np.abs(grad).sum())
        while step > 1e-6:
            new = theta + step * way
            new[k + 1 :] = np.clip(new[k + 1 :], -20, 20)
            got, slope = at(new)
            if got <= value + 1e-4 * step * (grad @ way):
                break
            step /= 2
        else:
            break
        missed = missed + 1 if value - got < GAIN else 0
        d, g = new - theta, slope - grad
        if d @ g > 1e-12:
            past = [*past, (d, g)][-10:]
        theta, value, grad = new, got, slope
    return theta[:k] * unit[:k], theta[k] + np.concatenate([[0.0], np.cumsum(np.exp(theta[k + 1 :]))])


def _fit(idx: list[np.ndarray], val: list[np.ndarray], grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all features and ordered thresholds for documents at hand: what train() finds of a table."""
    held = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *(i for i, s in zip(idx, grade == g) if s)]), minlength=DIM) for g in range(GRADES)], 1)
    keep = _telling(held, np.bincount(grade, minlength=GRADES))
    place = np.full(DIM, -1)
    place[keep] = np.arange(len(keep))
    row, col, v = np.repeat(np.arange(len(idx)), [len(i) for i in idx]), place[np.concatenate(idx)], np.concatenate(val)
    own, cuts = _least(lambda theta: _sums(theta, row[col >= 0], col[col >= 0], v[col >= 0], grade), held[keep].sum(1), len(grade))
    w = np.zeros(DIM)
    w[keep] = own
    return w, cuts


def graded(labels: DataFrame) -> DataFrame:
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    held = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
    return held.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights and thresholds from all labelled documents; None without two grades."""
    marks = graded(labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null and octet_length(text) > 0")

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "md5": pdf["md5"], "packed": [zlib.compress(t, 3) for t in pdf["text"]]})

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = np.zeros((DIM, GRADES), dtype=np.int32), np.zeros((1, GRADES), dtype=np.int32)
        for pdf in batches:
            for g, r in zip(pdf["grade"], packed_features(pdf["packed"])):
                held[np.unique(r), g] += 1
                total[0, g] += 1
        parts = [*np.split(held, DIM // SHARE), total]
        yield pd.DataFrame({"part": np.arange(len(parts)), "held": [zlib.compress(p.tobytes(), 3) for p in parts]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(h), np.int32).reshape(-1, GRADES).astype(np.int64) for h in pdf["held"])
        at = np.flatnonzero(total.any(1))
        return pd.DataFrame({"feature": int(pdf["part"].iloc[0]) * SHARE + at, **{f"n{g}": total[at, g] for g in range(GRADES)}})

    squeezed = bounded(rows.select("doc_id", F.md5("text").alias("md5"), "text")).mapInPandas(squeeze, "doc_id long, md5 string, packed binary")
    # By doc_id alone, as the join has ordered the texts: they are not sorted again.
    one = squeezed.join(marks, "doc_id").groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min(F.struct("md5", "packed")).alias("least"))
    one = stored(one.select("grade", "least.packed"), "labelled")
    counts = bounded(one).mapInPandas(tally, "part int, held binary").groupBy("part")
    counts = counts.applyInPandas(add, ", ".join(["feature long", *(f"n{g} long" for g in range(GRADES))])).toPandas()
    held = np.zeros((DIM + 1, GRADES), dtype=np.int64)
    held[counts["feature"].to_numpy(dtype=np.int64)] = counts[[f"n{g}" for g in range(GRADES)]].to_numpy(dtype=np.int64)
    total = held[DIM]
    if (total > 0).sum() < 2:
        discard(one)
        return None
    keep = _telling(held[:DIM], total)
    place = np.full(DIM, -1, dtype=np.int32)
    place[keep] = np.arange(len(keep))

    number = np.dtype(np.uint16 if len(keep) < 1 << 16 else np.int32)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [_scaled(own[own >= 0]) for own in (place[r] for r in packed_features(pdf["packed"]))]
            yield pd.DataFrame({"grade": pdf["grade"], "idx": [i.astype(number).tobytes() for i, _ in pairs], "val": [(16 * v).astype(np.uint8).tobytes() for _, v in pairs]})

    def sums(theta: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(theta) + 1, dtype=np.int64)
            for batch in (b.slice(lo, SUMMED) for b in batches for lo in range(0, b.num_rows, SUMMED)):
                idx, val = (batch.column(c).to_pylist() for c in ("idx", "val"))
                row = np.repeat(np.arange(len(val)), [len(v) for v in val])
                total += _sums(theta, row, np.frombuffer(b"".join(idx), number), np.frombuffer(b"".join(val), np.uint8) / 16, batch.column("grade").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "total"])

        got = bounded(table).mapInArrow(run, "i long, total long").groupBy("i").agg(F.sum("total").alias("total")).toPandas()
        return got.sort_values("i")["total"].to_numpy(dtype=float)

    table = stored(bounded(one).mapInPandas(vectors, "grade int, idx binary, val binary"), "quality")
    discard(one)
    own, cuts = _least(sums, held[keep].sum(1), int(total.sum()))
    discard(table)
    w = np.zeros(DIM)
    w[keep] = own.astype(np.float32)
    return w, cuts


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, names: tuple[str, ...] = RESULTS) -> DataFrame:
    """The documents' columns with score, expected_grade, p_tail (of the best grade) and keep, under the given names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            score, tails = np.zeros(len(texts)), np.zeros((len(texts), GRADES - 1))
            for i, rows in enumerate(features(texts)):
                if model is None:
                    tails[i] = 1
                elif rows.size:
                    idx, val = _scaled(rows)
                    score[i] = (model[0][idx] * val).sum()
                    tails[i] = 1 / (1 + np.exp(-np.clip(score[i] - model[1], -40, 40)))
            own = [pa.array(x) for x in (score, tails.sum(1), tails[:, -1], tails[:, -1] >= TAIL)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), *(f"`{c}` {t}" for c, t in zip(names, ("double", "double", "double", "boolean")))])
    return bounded(docs).mapInArrow(run, schema)


def grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, expected_grade, p_tail, keep for every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, train(docs, labels)).drop("text")


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    own = fresh(docs, *RESULTS)
    return scored(docs, train(docs, labels), tuple(own)).where(F.col(own[-1])).drop(*own)
