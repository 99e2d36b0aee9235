"""Exact percentiles of groups of any size.

A group of up to MOST values is one aggregation buffer. Larger ones are narrowed: SPLITS approximate quantiles cut a
group, exact counts tell in which part each wanted rank lies, and only those parts' values are kept for the next pass. A
rank at a splitter's own value is found at once, so every pass leaves less than before; parts are about 1/SPLITS of a
group, so 10^12 values take about four passes, each a shuffle of counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import discard, stored

MOST = 1_000_000
SPLITS = 100


def percentiles(rows: DataFrame, keys: tuple[str, ...], value: str, shares: tuple[float, ...], most: int = MOST) -> DataFrame:
    """keys, p: the linear percentiles of each group's values that aren't null, as an array; groups without a value have none (null)."""
    largest = rows.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return rows.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("p"))
    same = lambda a, b, *ks: F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in ks))
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("n"))
    wanted = sizes.where("n > 0").select(*keys, F.explode(F.array(*(F.array(F.floor(F.lit(s) * (F.col("n") - 1)), F.ceil(F.lit(s) * (F.col("n") - 1))) for s in shares))).alias("two"))
    wanted = wanted.select(*keys, F.explode("two").alias("rank")).distinct().withColumn("left", F.col("rank")).withColumn("part", F.lit(0).cast("long"))
    wanted, found = stored(wanted, "ranks"), None
    held = stored(rows.where(F.col(value).isNotNull()).select(*keys, F.lit(0).cast("long").alias("part"), F.col(value).cast("double").alias("v")), "values")
    while largest > most:
        cuts = held.groupBy(*keys, "part").agg(F.array_distinct(F.percentile_approx("v", F.array(*(F.lit(i / (SPLITS + 1)) for i in range(1, SPLITS + 1))), F.lit(10 * SPLITS))).alias("cuts"))
        h = held.alias("h").join(cuts.alias("c"), same("h", "c", *keys, "part")).select("h.*", "cuts")
        below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        # Twice the number of splitters below, and one more at a splitter.
        h = stored(h.withColumn("to", (2 * below + F.array_contains("cuts", F.col("v")).cast("int")).cast("long")).drop("cuts"), "dealt")
        counts = h.groupBy(*keys, "part", "to").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("one"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("to")))
        at = wanted.alias("w").join(counts.alias("c"), same("w", "c", *keys, "part") & F.expr("left >= upto - n and left < upto"))
        at = stored(at.select(*(F.col(f"w.{k}") for k in keys), "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.col("w.part").alias("part"), "to", "one", "n"), "places")
        done = at.where("to % 2 = 1").select(*keys, "rank", F.col("one").alias("v"))
        found = done if found is None else found.union(done)
        # Parts are named by what they were cut from and their place.
        name = (F.col("part") * (2 * SPLITS + 2) + F.col("to") + 1).alias("part")
        next_ = stored(h.alias("h").join(at.where("to % 2 = 0").select(*keys, "part", "to").distinct().alias("w"), same("h", "w", *keys, "part", "to"), "left_semi").select(*keys, name, "v"), "values")
        last, wanted = wanted, stored(at.where("to % 2 = 0").select(*keys, "rank", "left", name), "ranks")
        discard(held, h, last)
        held = next_
        largest = held.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    few = held.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # up to `most` values
    rest = wanted.alias("w").join(few.alias("f"), same("w", "f", *keys, "part")).select(*(F.col(f"w.{k}") for k in keys), "rank", F.get("vs", F.col("left").cast("int")).alias("v"))
    found = rest if found is None else found.union(rest)
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a share
    j = sizes.alias("s").join(values.alias("a"), same("s", "a", *keys), "left").select(*(F.col(f"s.{k}") for k in keys), "n", "at")

    def read(share: float):
        place = F.lit(share) * (F.col("n") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    return j.select(*keys, F.when(F.col("at").isNotNull(), F.array(*map(read, shares))).alias("p"))
