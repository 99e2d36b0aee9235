"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is rotated by one fixed random orthogonal matrix and kept as its sign bits, packed to 64-bit words, with two
correction scalars: its norm and the inner product of its unit vector with its code. A query is rotated too and quantised
to four bit planes, so AND and popcount give an estimate of each inner product and a bound of its error. In a block of
codes a query first reranks exactly the vectors of highest estimate; every other one whose estimate plus bound reaches
the k-th exact score so far is reranked too. The codes are fit on nothing, and every row is indexed.

A stated query set meets all rows in blocks: both sides are dealt by hash of the id to blocks of bounded size, and a
task holds one pair of blocks, so neither side is ever whole in a task, broadcast or on the driver.

The vectors go with their codes: with 64 dimensions the bounds leave about a sixth of the rows open until exact scores
of the block close them, and one row for each of those would outweigh the vectors.

Defined results: vectors that are null, zero or hold null or non-finite components take no part. Vectors of different
lengths have no inner product: each length is a table of its own, and a vector meets only those of its length. Repeated
rows of one id count once (the smallest vector, if they differ). Equal scores go to the smaller id. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, stored

#: Rows of a data block and of a query block, and the values that a block of long vectors holds.
DATA_BLOCK, QUERY_BLOCK, BLOCK_VALUES = 4096, 4096, 1 << 20
#: So many different lengths at most are broadcast, a row each.
LENGTHS = 10_000
#: Standard errors that an estimate may be off before a candidate is passed over.
EPSILON = 2.5
PLANES = 4
SEED = 20


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec, dim (the vector's length) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    finite = "forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    return v.where(f"id is not null and vec is not null and {finite}").withColumn("dim", F.size("vec"))


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """(..., dim) booleans to (..., words) 64-bit words."""
    pad = -bits.shape[-1] % 64
    return np.packbits(np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bool)], -1), axis=-1).view(np.uint64)


def index(vectors: DataFrame) -> DataFrame:
    """id, vec, dim, ask, code (packed sign bits of the rotated vector), norm, align (unit vector times code)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turns = {}
        for batch in batches:
            for dim, pdf in batch.groupby("dim"):
                turns[dim] = turns[dim] if dim in turns else rotation(dim)
                x = np.stack(pdf["vec"]).astype(np.float64)
                norm = np.sqrt((x * x).sum(1))
                y = (x / norm[:, None]) @ turns[dim]
                yield pdf.assign(code=[c.tobytes() for c in _pack(y > 0)], norm=norm, align=np.abs(y).sum(1) / np.sqrt(dim))

    kind = dict(vectors.dtypes)["vec"]
    return bounded(vectors).mapInPandas(run, f"id long, vec {kind}, dim int, ask boolean, code binary, norm double, align double")


def _once(pdf: pd.DataFrame) -> pd.DataFrame:
    if pdf["id"].is_unique:
        return pdf
    return pdf.assign(_v=[tuple(v) for v in pdf["vec"]]).sort_values(["id", "_v"]).drop_duplicates("id").drop(columns="_v")


def _scan(data: pd.DataFrame, queries: pd.DataFrame, dim: int, k: int) -> pd.DataFrame:
    x, ids = np.stack(data["vec"]).astype(np.float64), data["id"].to_numpy()
    codes = np.frombuffer(b"".join(data["code"]), np.uint64).reshape(len(data), -1)
    norm, align = data["norm"].to_numpy(), data["align"].to_numpy()
    q, qid = np.stack(queries["vec"]).astype(np.float64), queries["id"].to_numpy()
    y = q @ rotation(dim)
    low = y.min(1, keepdims=True)
    step = np.maximum((y.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((y - low) / step).astype(np.uint8)
    planes = [_pack((level >> j) & 1 == 1) for j in range(PLANES)]
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    total = (low * dim + step * level.sum(1, keepdims=True, dtype=np.int64))[:, 0]
    spread = np.sqrt(np.maximum(1 - align**2, 0)) / align / np.sqrt(max(dim - 1, 1))
    qnorm = np.sqrt((q * q).sum(1))
    found = []
    for a in range(0, len(q), 64):
        z = slice(a, min(a + 64, len(q)))
        dots = np.zeros((z.stop - a, len(x)))
        for j in range(PLANES):
            dots += np.bitwise_count(codes[None] & planes[j][z, None]).sum(2, dtype=np.int64) << j
        est = (2 * (step[z] * dots + low[z] * ones) - total[z, None]) / np.sqrt(dim) * (norm / align)
        best = est + EPSILON * norm * (qnorm[z, None] * spread + step[z] / np.sqrt(12) / align)
        for i in range(z.stop - a):
            own = ids == qid[a + i]
            e = np.where(own, -np.inf, est[i])
            first = np.argpartition(-e, min(2 * k, len(e) - 1))[: 2 * k] if len(e) > 2 * k else np.arange(len(e))
            first = first[~own[first]]
            floor = np.sort((x[first] * q[a + i]).sum(1))[-k] if len(first) >= k else -np.inf
            rerank = np.flatnonzero((best[i] >= floor) & ~own)
            rerank = np.union1d(rerank, first)
            near = (x[rerank] * q[a + i]).sum(1)
            if len(near) > k:  # what rounding can't lift among the k best goes
                rerank = rerank[~(near < np.partition(near, -k)[-k] - 1e-14 * dim * qnorm[a + i] * norm.max())]
            score = np.cumsum(x[rerank] * q[a + i], axis=1)[:, -1]  # added from left to right, as a plain loop adds
            top = np.lexsort((ids[rerank], -score))[:k]
            found.append(pd.DataFrame({"query_id": qid[a + i], "vec_id": ids[rerank][top], "score": score[top]}))
    return pd.concat(found)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where is_query (over the id column) holds, its k rows of largest inner product among all others of its length."""
    v = usable(vectors, id_col, vec_col).withColumn(id_col, F.col("id")).withColumn("ask", F.coalesce(is_query, F.lit(False))).select("id", "vec", "dim", "ask")
    counts = v.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("ask").alias("m")).where("m > 0")
    rows_of = lambda most: F.least(F.lit(most), F.greatest(F.lit(256), F.floor(BLOCK_VALUES / F.col("dim"))))
    blocks = stored(counts.select("dim", F.ceil(F.col("n") / rows_of(DATA_BLOCK)).alias("nb"), F.ceil(F.col("m") / rows_of(QUERY_BLOCK)).alias("nq")), "blocks")
    # One row a length: a shuffle by length would put most rows in one task, so few lengths are sent to the rows.
    blocks = F.broadcast(blocks) if blocks.count() <= LENGTHS else blocks
    held = index(v).join(blocks, "dim")
    data = held.select("*", F.expr("pmod(xxhash64(id), nb)").alias("b"), F.explode(F.expr("sequence(0L, nq - 1)")).alias("q"), F.lit(False).alias("asks"))
    asked = held.where("ask").select("*", F.explode(F.expr("sequence(0L, nb - 1)")).alias("b"), F.expr("pmod(xxhash64(id, 1), nq)").alias("q"), F.lit(True).alias("asks"))
    columns = ("id", "vec", "dim", "code", "norm", "align", "b", "q", "asks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queries, rows = _once(pdf[pdf["asks"]]), _once(pdf[~pdf["asks"]])
        if queries.empty or rows.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        return _scan(rows, queries, int(pdf["dim"].iloc[0]), k)

    found = data.select(*columns).union(asked.select(*columns)).groupBy("dim", "q", "b").applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
