"""Ranked lexical search by a dual tree: node pairs of an item tree and a document tree are pruned by coordinate maxima, exactly.

Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A term of an item
weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document gives it (10^9 tf) div (1000 tf + 8m), m = 10 + (90 n N) div
L. A score is the sum of their products, a whole number under 2^53, so that sums of doubles are exact.

Documents become sparse vectors over the items' terms (a pass over all texts), and then leaves of LEAF documents whose
heaviest terms are the same or near; a leaf, and a node of FAN leaves, holds the greatest impact of each term. Items
become leaves of ITEM_LEAF and nodes of ITEM_NODE items, with the greatest weight of each term. The product of two nodes'
maxima bounds the score of all their pairs: a pair of nodes is left out if that is under the least k-th score known of the
items, and never at equality, for equal scores rank by id. A first round scores the leaves of greatest bound and gives
every item a k-th score; the second goes down both trees in every task with those, which rise as it finds documents.

Items are a stated query set: they are taken in blocks of about BLOCK_BYTES of terms by a hash of their id, each a pass
over all documents; a block's terms, trees and k-th scores are what is broadcast. No task holds more than a batch of
leaves beside a block.

Defined results: null texts have no terms; documents and items without terms are in no result. Repeated rows of documents
are documents of their own; a null doc_id ranks last among equal scores. Items of one id (null is one) are one item with
all their terms. Empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, stored

TOP = 10
LEAF, FAN = 64, 8
ITEM_LEAF, ITEM_NODE, NODE_TERMS = 8, 64, 8192
BLOCK_BYTES = 8 << 20
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms as they are, A-Z lower-cased; all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_VECTOR = "doc_id long, n long, terms binary, tf binary"
_LEAF = "doc_ids array<long>, cuts binary, terms binary, impacts binary, top_terms binary, top_impacts binary"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: each item's terms, once."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _UP, _LOW)
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("term")).distinct()


def vectors(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), and numbers and counts of the vocabulary's terms in each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary.value.get
        for batch in batches:
            ids, n, terms, tf = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = (text or b"").translate(_TABLE).split()
                if tokens:
                    t, c = np.unique(np.array([v for v in map(of, tokens) if v is not None], dtype=np.int32), return_counts=True)
                    ids.append(doc_id)
                    n.append(len(tokens))
                    terms.append(t.tobytes())
                    tf.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return bounded(rows).mapInArrow(run, _VECTOR)


def document_counts(vecs: DataFrame, size: int) -> np.ndarray:
    """The number of documents of each of the vocabulary's terms; tasks sum their own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(size, dtype=np.int64)
        for pdf in batches:
            df += np.bincount(np.frombuffer(b"".join(pdf["terms"]), np.int32), minlength=size)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    out = np.zeros(size, dtype=np.int64)
    for r in vecs.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def leaves(vecs: DataFrame, n_docs: int, n_terms: int, weights) -> DataFrame:
    """The document tree's leaves: documents of like heaviest terms with their impacts, and the greatest impact of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            docs = []
            for doc_id, n, t, c in zip(*(col.to_pylist() for col in batch.columns)):
                t, c = np.frombuffer(t, np.int32), np.frombuffer(c, np.int32).astype(np.int64)
                if len(t):
                    m = 10 + 90 * n * n_docs // n_terms
                    impact = (1_000_000_000 * c) // (1000 * c + 8 * m)
                    own = w[t] * impact
                    docs.append((int(t[own.argmax()]), -int(own.max()), doc_id, t, impact.astype(np.int32)))
            docs.sort(key=lambda d: d[:2])
            out: list[list] = [[] for _ in range(6)]
            for i in range(0, len(docs), LEAF):
                part = docs[i : i + LEAF]
                t, v = np.concatenate([d[3] for d in part]), np.concatenate([d[4] for d in part])
                top, at = np.unique(t, return_inverse=True)
                most = np.zeros(len(top), dtype=np.int32)
                np.maximum.at(most, at, v)
                cuts = np.cumsum([0, *(len(d[3]) for d in part)]).astype(np.int32)
                for col, x in zip(out, ([d[2] for d in part], cuts.tobytes(), t.tobytes(), v.tobytes(), top.astype(np.int32).tobytes(), most.tobytes())):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.int64())), *(pa.array(c, pa.binary()) for c in out[1:])], names=["doc_ids", "cuts", "terms", "impacts", "top_terms", "top_impacts"])

    return bounded(vecs).mapInArrow(run, _LEAF)


def item_nodes(terms: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
    """The item tree's nodes: places of items, those of like heaviest terms together; a node's leaves are its runs of ITEM_LEAF."""
    heavy = [int(t[w[t].argmax()]) for t in terms]
    nodes, now, size = [], [], 0
    for i in sorted(range(len(terms)), key=lambda i: (heavy[i], i)):
        if now and (len(now) == ITEM_NODE or size + len(terms[i]) > NODE_TERMS):
            nodes.append(np.array(now))
            now, size = [], 0
        now.append(i)
        size += len(terms[i])
    return [*nodes, np.array(now)] if now else nodes


class _Found:
    """The best documents found of each item: score, whether the id is null, id; and the score that a document must reach."""

    def __init__(self, need: np.ndarray, k: int):
        self.need, self.k = need.astype(np.float64), k
        self.rows: dict[int, np.ndarray] = {}

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        rows = np.stack([scores.astype(np.int64), null.astype(np.int64), ids])
        if item in self.rows:
            rows = np.concatenate([self.rows[item], rows], axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]
        self.rows[item] = rows
        if rows.shape[1] == self.k:
            self.need[item] = max(self.need[item], rows[0, -1])


class _Node:
    """A node of the item tree over its own terms: weights of items, and their maxima by leaf and over the node."""

    def __init__(self, items: np.ndarray, terms: list[np.ndarray], w: np.ndarray):
        self.items = items
        self.terms = np.unique(np.concatenate([terms[i] for i in items]))
        kind = np.float64 if len(self.terms) * int(w.max(initial=0)) * 1_000_000 < 1 << 53 else np.int64
        self.w = np.zeros((len(self.terms), len(items)), dtype=kind)
        for j, i in enumerate(items):
            at = np.searchsorted(self.terms, terms[i])
            self.w[at, j] = w[terms[i]]
        self.cuts = np.arange(0, len(items), ITEM_LEAF)
        self.leaf_w = np.maximum.reduceat(self.w, self.cuts, axis=1)
        self.top_w = self.leaf_w.max(1)


def _dense(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int, node: _Node) -> np.ndarray:
    """A table of n rows over the node's terms."""
    at = np.minimum(np.searchsorted(node.terms, terms), len(node.terms) - 1)
    own = node.terms[at] == terms
    out = np.zeros((n, len(node.terms)), dtype=node.w.dtype)
    out[rows[own], at[own]] = values[own]
    return out


class _Leaves:
    """A batch of leaves of the document tree."""

    def __init__(self, batch: pa.RecordBatch):
        ids, *data = (c.to_pylist() for c in batch.columns)
        cuts, terms, impacts, top, most = ([np.frombuffer(x, np.int32) for x in c] for c in data)
        self.null = [np.array([i is None for i in x]) for x in ids]
        self.ids = [np.array([i or 0 for i in x], dtype=np.int64) for x in ids]
        self.docs = [(np.repeat(np.arange(len(c) - 1), np.diff(c)), t, v) for c, t, v in zip(cuts, terms, impacts)]
        self.n = len(ids)
        self.leaf = np.repeat(np.arange(self.n), [len(t) for t in top])
        self.top, self.most = np.concatenate([np.zeros(0, np.int32), *top]), np.concatenate([np.zeros(0, np.int32), *most])

    def score(self, leaf: int, node: _Node, at: np.ndarray, found: _Found) -> None:
        """Scores the leaf's documents against the node's items at these places."""
        rows, terms, impacts = self.docs[leaf]
        scores = _dense(rows, terms, impacts, len(self.ids[leaf]), node) @ node.w[:, at]
        good = (scores > 0) & (scores >= found.need[node.items[at]])
        for j in np.flatnonzero(good.any(0)):
            g = good[:, j]
            found.add(int(node.items[at[j]]), scores[g, j], self.ids[leaf][g], self.null[leaf][g])


def _seed(held: _Leaves, node: _Node, found: _Found) -> None:
    """Scores, for each leaf of the node's items, the document leaf of greatest bound."""
    bound = _dense(held.leaf, held.top, held.most, held.n, node) @ node.leaf_w
    for g, leaf in enumerate(bound.argmax(0)):
        if bound[leaf, g] > 0:
            held.score(int(leaf), node, np.arange(node.cuts[g], min(node.cuts[g] + ITEM_LEAF, len(node.items))), found)


def _search(held: _Leaves, node: _Node, found: _Found, seen: list[int]) -> None:
    """Goes down both trees; what a bound excludes is left out. seen counts leaf pairs: all, and scored ones."""
    most = _dense(held.leaf, held.top, held.most, held.n, node)
    starts = np.arange(0, held.n, FAN)
    need = lambda: np.minimum.reduceat(found.need[node.items], node.cuts)
    bound = np.maximum.reduceat(most, starts, axis=0) @ node.top_w
    seen[0] += held.n * len(node.cuts)
    for s in np.argsort(-bound, kind="stable"):
        if bound[s] <= 0 or bound[s] < need().min():
            continue
        part = most[starts[s] : starts[s] + FAN] @ node.leaf_w
        for leaf in np.argsort(-part.max(1), kind="stable"):
            open_ = np.flatnonzero((part[leaf] > 0) & (part[leaf] >= need()))
            if len(open_):
                seen[1] += len(open_)
                at = np.concatenate([np.arange(node.cuts[g], min(node.cuts[g] + ITEM_LEAF, len(node.items))) for g in open_])
                held.score(int(starts[s] + leaf), node, at, found)


def _round(tree: DataFrame, sent, need: np.ndarray, k: int, seed: bool) -> DataFrame:
    """item (place), doc_id, score of the best documents of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, nodes, w = sent.value
        nodes = [_Node(n, terms, w) for n in nodes]
        found, seen = _Found(need, k), [0, 0]
        for batch in batches:
            held = _Leaves(batch)
            for node in nodes if held.n else ():
                if seed:
                    _seed(held, node, found)
                else:
                    _search(held, node, found, seen)
        rows = [(item, None if null else int(i), int(s)) for item, r in found.rows.items() for s, null, i in r.T]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "doc_id", "score"])

    return bounded(tree).mapInArrow(run, "item long, doc_id long, score long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(docs: DataFrame, held: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score of a block of items (rows of item_id and term)."""
    spark = docs.sparkSession
    words = sorted({r.term for r in held})
    number = {t: i for i, t in enumerate(words)}
    of: dict[int | None, list[int]] = {}
    for r in held:
        of.setdefault(r.item_id, []).append(number[r.term])
    ids = sorted(of, key=lambda i: (i is None, i))
    terms = [np.array(sorted(of[i]), dtype=np.int32) for i in ids]

    vecs = stored(vectors(docs, spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})), "vectors")
    total = vecs.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("terms")).first()
    df = document_counts(vecs, len(words))
    w = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    tree = stored(leaves(vecs, total.n, total.terms or 1, spark.sparkContext.broadcast(w)), "leaves")
    discard(vecs)

    sent = spark.sparkContext.broadcast((terms, item_nodes(terms, w), w))
    first = _best(_round(tree, sent, np.zeros(len(ids)), k, True), k)
    need = np.zeros(len(ids), dtype=np.int64)
    for r in first.where(F.col("rank") == k).select("item", "score").toLocalIterator():  # a row an item of the block
        need[r.item] = r.score
    got = _best(_round(tree, sent, need, k, False), k)
    names = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "item long, item_id long")
    return got.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k documents of highest score above 0."""
    terms = stored(item_terms(items), "items")
    size = terms.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        held = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_bytes
        if held:
            got = _searched(docs, held, k)
            out = got if out is None else out.union(got)
    discard(terms)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
