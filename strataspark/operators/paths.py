"""Paths over images of any height: blocks of rows are tasks, and what a path knows at a block's border is handed on through a stored table.

A path is one ordered pass over its image's rows. The rows are packed, one array of values a row, and cut into blocks of
BLOCK rows. An image of one block is one task. Taller images go block by block, all images' blocks of one number in one
round: a forward round takes the totals of the row above (and, for the bend, the step that led there), writes the block's
back-pointers and its last totals; backward rounds read the path out of the back-pointers; rounds downwards follow what
lies below the path's end. Each round's table is stored in the shared folder, so that a lost executor costs a block, and
no task holds more than a block of an image. Results don't depend on the size of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import discard, stored

BLOCK = 2048
#: What a round gives for each image: the rows from `first` on, a block's back-pointers, and the state for the next block.
ROUND = "image_id string, block int, first int, x array<double>, conf array<double>, back binary, n int, y int, at double, total binary, last binary, value double"
STATE = ("n", "y", "at", "total", "last", "value")
_COLUMNS = [c.split()[0] for c in ROUND.split(", ")]
_NONE = pd.DataFrame({c: pd.Series(dtype=object) for c in _COLUMNS})
#: A row's argument columns beside its arrays.
ARGS = ("step", "smooth", "bend")
Run = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


def packed(table: DataFrame, block: int, **values: Column) -> DataFrame:
    """image_id, block, y, for each name the array of a row's values by x, and the image's step, smooth and bend if the table has them. One shuffle, by image and block."""
    args = [a for a in ARGS if a in table.columns]
    held = table.select("image_id", F.floor(F.col("y") / block).cast("int").alias("block"), "y", "x", *(v.cast("double").alias(n) for n, v in values.items()), *args)
    held = held.repartition("image_id", "block").groupBy("image_id", "block", "y").agg(F.array_sort(F.collect_list(F.struct("x", *values))).alias("c"), *(F.first(a).alias(a) for a in args))
    return held.select("image_id", "block", "y", *(F.col("c").getField(n).alias(n) for n in values), *args)


def _swept(of_block: Callable[[int], DataFrame], entering: DataFrame, order: Iterable[int], run: Run) -> list[DataFrame]:
    """A stored table for each block number, in order: run(an image's rows of the block, its state), the state being handed on or that with which the image enters at this block."""
    done, handed = [], None
    for b in order:
        state = entering.where(F.col("block") == b).select("image_id", *STATE)
        state = state if handed is None else state.union(handed)
        got = of_block(b).groupBy("image_id").cogroup(state.groupBy("image_id")).applyInPandas(run, ROUND)
        done.append(stored(got, f"round{b}"))
        handed = done[-1].select("image_id", *STATE)
    return done


def _row(image_id, block, first, x=(), conf=None, back=None, n=0, y=-1, at=0.0, total=None, last=None, value=np.inf) -> pd.DataFrame:
    return pd.DataFrame([[image_id, int(block), int(first), [float(v) for v in x], conf, back, int(n), int(y), float(at), total, last, float(value)]], columns=_COLUMNS)


def _entering(images: DataFrame, block: Column, **known: Column) -> DataFrame:
    """States with which images(image_id, n, ...) enter at a block."""
    kinds = {"n": "int", "y": "int", "at": "double", "total": "binary", "last": "binary", "value": "double"}
    start = {"n": F.col("n"), "y": F.lit(-1), "at": F.lit(0.0), "total": F.lit(None), "last": F.lit(None), "value": F.lit(float("inf"))} | known
    return images.select("image_id", block.cast("int").alias("block"), *(start[k].cast(kinds[k]).alias(k) for k in STATE))


def _exploded(tables: list[DataFrame]) -> DataFrame:
    """image_id, row_idx, x, conf of the rows in the rounds' tables."""
    out = None
    for t in tables:
        t = t.select("image_id", "first", F.arrays_zip(F.col("x").alias("x"), F.coalesce("conf", F.transform("x", lambda _: F.lit(None).cast("double"))).alias("conf")).alias("c"))
        t = t.select("image_id", "first", F.posexplode("c").alias("i", "c")).select("image_id", (F.col("first") + F.col("i")).alias("row_idx"), "c.x", "c.conf")
        out = t if out is None else out.union(t)
    return out


# --- least-cost paths ------------------------------------------------------------------------------------------------


class Moves:
    """The steps to the left and right that a row allows, in the order that decides ties, with their costs."""

    def __init__(self, width: int, step: int, smooth: float, bend: float, near_first: bool):
        moves = np.arange(step, -step - 1, -1)
        if near_first:  # the same column, then from the left
            moves = np.array(sorted(moves, key=lambda m: (abs(m), -m)))
        self.at, self.bend = np.arange(width), bend
        came = self.at - moves[:, None]
        inside = (came >= 0) & (came < width)
        self.came = np.where(inside, came, 0)
        self.base = np.where(inside, smooth * moves[:, None].astype(float) ** 2, np.inf)

    def forward(self, cost: np.ndarray, first: int, total: np.ndarray | None, last: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's best predecessors (columns), the rows' least totals with their places, and the last totals.

        Rows start at `first` of their image, after the totals and the predecessors of the row before.
        """
        back = np.zeros(cost.shape, dtype=np.int32)
        least = np.empty((len(cost), 2))
        for i, own in enumerate(cost):
            y = first + i
            if y == 0:
                total = own
            else:
                ways = total[self.came] + self.base
                if self.bend > 0 and y >= 2:
                    ways = ways + self.bend * (self.at - 2 * self.came + (back[i - 1] if i else last)[self.came]).astype(float) ** 2
                pick = ways.argmin(0)
                back[i] = self.came[pick, self.at]
                total = own + ways[pick, self.at]
            least[i] = total.min(), total.argmin()
        return back, least, total


def _end_rows(n: int, whole: bool) -> int:
    """The first row in which a path may end: the last one, or any of the last fifth."""
    return n - 1 if whole else int(n * 0.8)


def _below(p: np.ndarray, x: int, step: int) -> list[int]:
    """The strongest place within the step of the row before, row by row."""
    out = []
    for row in p:
        low = max(0, x - step)
        x = low + int(row[low : x + step + 1].argmax())
        out.append(x)
    return out


def _args(rows: pd.DataFrame) -> tuple[int, float, float]:
    r = rows.iloc[0]
    return (int(r["step"]), float(r["smooth"]), float(r["bend"])) if "step" in rows else (1, 0.0, 0.0)


def _ended(least: np.ndarray, first: int, n: int, whole: bool, best: tuple[float, int, int]) -> tuple[float, int, int]:
    """The cheapest end so far: total, row, column; the first on ties."""
    for i in range(max(0, _end_rows(n, whole) - first), len(least)):
        if least[i, 0] < best[0]:
            best = least[i, 0], first + i, int(least[i, 1])
    return best


def least_path(rows: DataFrame, whole: bool, block: int) -> DataFrame:
    """image_id, row_idx, x (whole columns) of each image's path of least cost; rows as packed() gives them, stored.

    whole: it ends in the last row, and ties keep the column, then come from the left. Else it ends at the cheapest place
    of the last fifth of rows and follows the strongest places below; ties come from the left.
    """

    def moves(pdf: pd.DataFrame) -> Moves:
        return Moves(len(pdf["cost"].iloc[0]), *_args(pdf), whole)

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("y")
        n, cost = len(pdf), np.stack(pdf["cost"])
        back, least, _ = moves(pdf).forward(cost, 0, None, None)
        _, end, at = _ended(least, 0, n, whole, (np.inf, -1, 0))
        x = np.empty(n, dtype=np.int64)
        x[end] = at
        for y in range(end, 0, -1):
            x[y - 1] = back[y, x[y]]
        x[end + 1 :] = _below(np.stack(pdf["p"])[end + 1 :], at, _args(pdf)[0])
        return _row(pdf["image_id"].iloc[0], 0, 0, x)

    def forward(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or state.empty:
            return _NONE
        pdf, s = pdf.sort_values("y"), state.iloc[0]
        first, n = int(pdf["y"].iloc[0]), int(s["n"])
        total, last = (None, None) if first == 0 else (np.frombuffer(s["total"]), np.frombuffer(s["last"], np.int32))
        back, least, total = moves(pdf).forward(np.stack(pdf["cost"]), first, total, last)
        value, y, at = _ended(least, first, n, whole, (float(s["value"]), int(s["y"]), int(s["at"])))
        return _row(pdf["image_id"].iloc[0], pdf["block"].iloc[0], first, back=back.tobytes(), n=n, y=y, at=at, total=total.tobytes(), last=back[-1].tobytes(), value=value)

    def backward(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or state.empty:
            return _NONE
        r, s = pdf.iloc[0], state.iloc[0]
        back = np.frombuffer(r["back"], np.int32).reshape(-1, len(r["total"]) // 8)
        first, x, out = int(r["first"]), int(s["at"]), []
        for y in range(int(s["y"]) - first, -1, -1):
            out.append(x)
            x = int(back[y, x])
        return _row(r["image_id"], r["block"], first, out[::-1], n=s["n"], y=first - 1, at=x)

    def downward(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or state.empty:
            return _NONE
        s = state.iloc[0]
        pdf = pdf[pdf["y"] > s["y"]].sort_values("y")
        image_id = state["image_id"].iloc[0]
        if pdf.empty:
            return _row(image_id, 0, s["y"] + 1, n=s["n"], y=s["y"], at=s["at"])
        x = _below(np.stack(pdf["p"]), int(s["at"]), _args(pdf)[0])
        return _row(image_id, pdf["block"].iloc[0], pdf["y"].iloc[0], x, n=s["n"], y=pdf["y"].iloc[-1], at=x[-1])

    sizes = stored(rows.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("n")), "heights")
    short = rows.join(sizes.where(F.col("n") <= block).select("image_id"), "image_id", "left_semi")
    out = [short.groupBy("image_id").applyInPandas(alone, ROUND)]
    tall = sizes.where(F.col("n") > block)
    most = tall.agg(F.max("n")).first()[0]
    if most:
        last, of_block = (most - 1) // block, lambda b: rows.where(F.col("block") == b)
        tables = _swept(of_block, _entering(tall, F.lit(0)), range(last + 1), forward)
        ends = None
        for b, t in enumerate(tables):
            own = t.join(tall.where(F.floor((F.col("n") - 1) / block) == b).select("image_id"), "image_id", "left_semi").select("image_id", "n", "y", "at")
            ends = own if ends is None else ends.union(own)
        enters = stored(_entering(ends, F.floor(F.col("y") / block), y=F.col("y"), at=F.col("at")), "ends")
        out += _swept(lambda b: tables[b], enters, range(last, -1, -1), backward)
        if not whole:
            out += _swept(of_block, enters, range(enters.agg(F.min("block")).first()[0], last + 1), downward)
        discard(*tables, enters)
    return _exploded(out).select("image_id", "row_idx", F.col("x").cast("int").alias("x"))


# --- following -------------------------------------------------------------------------------------------------------


def followed_path(rows: DataFrame, block: int, next_place: Callable[[np.ndarray, np.ndarray, float], tuple[float, float]]) -> DataFrame:
    """image_id, row_idx, x, conf: from the strongest place of the row of most ink down and up, next_place(ridge, p, place before) giving each row's place and strength.

    Rows as packed() gives them (p and ridge), stored. A row without a place (NaN) leaves the place before as it is.
    """

    def one_way(pdf: pd.DataFrame, before: float) -> tuple[list[float], list[float], float]:
        x, conf = [], []
        for ridge, p in zip(pdf["ridge"], pdf["p"]):
            at, strength = next_place(np.asarray(ridge), np.asarray(p), before)
            x.append(at)
            conf.append(strength)
            before = at if np.isfinite(at) else before
        return x, conf, before

    def sweep(down: bool) -> Run:
        def run(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
            if pdf.empty or state.empty:
                return _NONE
            s = state.iloc[0]
            # y is the row where the image enters, and -1 later.
            pdf = pdf if s["y"] < 0 else pdf[pdf["y"] > s["y"]] if down else pdf[pdf["y"] < s["y"]]
            pdf = pdf.sort_values("y", ascending=down)
            x, conf, before = one_way(pdf, float(s["at"]))
            first = s["y"] + 1 if pdf.empty else pdf["y"].min()
            return _row(state["image_id"].iloc[0], 0, first, x if down else x[::-1], [float(c) for c in (conf if down else conf[::-1])], n=s["n"], at=before)

        return run

    def ink(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            rows_ = [np.asarray(r) for r in pdf["ridge"]]
            yield pd.DataFrame({"image_id": pdf["image_id"], "y": pdf["y"], "ink": [r.sum() for r in rows_], "at": [float(r.argmax()) for r in rows_], "top": [r.max() for r in rows_]})

    seen = rows.select("image_id", "y", "ridge").mapInPandas(ink, "image_id string, y int, ink double, at double, top double")
    start = seen.groupBy("image_id").agg((F.max("y") + 1).cast("int").alias("n"), F.min_by(F.struct("y", "at", "top"), F.struct(-F.col("ink"), F.col("y"))).alias("s"))
    start = stored(start.select("image_id", "n", "s.*"), "starts")
    enters = _entering(start, F.floor(F.col("y") / block), y=F.col("y"), at=F.col("at"))
    last = (start.agg(F.max("n")).first()[0] or 1) - 1
    of_block, order = lambda b: rows.where(F.col("block") == b), range(last // block + 1)
    out = _exploded([*_swept(of_block, enters, order, sweep(True)), *_swept(of_block, enters, reversed(order), sweep(False))])
    out = out.union(start.select("image_id", F.col("y").alias("row_idx"), F.col("at").alias("x"), F.col("top").alias("conf")))
    return out.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
