"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source's target is its weight's share of all words, at most CAP times its own words, the excess shared again by weight
until none is above. Every document of a source is due target / words copies: the whole part is certain, the fraction is
rounded by the pivotal method. Documents of one source and of like size are dealt by hash to leaves of a tree; each leaf
folds its documents: of two fractions, mass moves at random from one to the other until one of them is 0 or 1, which
keeps every document's expected copies and the sum of both. What a leaf has left, at most one fraction, goes to the leaf
above, whose 64 children are folded in the same way, until one fraction is left for each source and size class, then
for each source, and that one is drawn. So the copies of a size class come out as its target rounded, whatever the
source's size, and no task sees more than a leaf.

Draws are hashes of a seed and the two documents: reruns agree. Defined results: null text counts 0 words; null sources
are one source, last in the order. Documents without words are never taken. Repeated rows (same id, source and size)
get the same number of copies. An empty table gives no rows.
The mix keeps other columns as they are, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored

WEIGHTS = (5, 2, 1)
CAP = 3
FAN, LEAF = 64, 48
#: Documents of over 1/8, 1/64 and 1/512 of their source's target are rounded first, in this order, and what their rounding gives or takes is spread over the smaller ones.
TIERS = (8, 64, 512)
SEED = 5
UNIT = "struct<doc_id:bigint,size:bigint,p:double>"
TOOK = "array<struct<doc_id:bigint,size:bigint,took:int>>"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target from rows of source and size. The table has a row for each source, which is what a mix names."""
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    src = stored(src.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int")).cast("double")), "sources")
    total = float(src.agg(F.sum("source_size")).first()[0] or 0)
    rate = 0.0
    while True:
        above = F.col("w") * F.lit(rate) > F.col("source_size") * float(CAP)
        capped, free = src.agg(F.sum(F.when(above, F.col("source_size") * float(CAP)).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if not free or (now := (total - capped) / free) <= rate:
            break
        rate = now
    return src.select("source", "source_size", F.least(F.col("w") * F.lit(rate), F.col("source_size") * float(CAP)).alias("target"))


def _draw(*by: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *by), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _pair(state: Column, x: Column) -> Column:
    """One step of the fold: what is carried meets the next document."""
    c, out = state["c"], state["out"]
    both = c["p"] + x["p"]
    wins = _draw(c["doc_id"], c["size"], x["doc_id"], x["size"]) < F.when(both < 1, c["p"] / F.greatest(both, F.lit(1e-300))).otherwise((1 - x["p"]) / F.greatest(2 - both, F.lit(1e-300)))
    unit = lambda u, p: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), p.alias("p"))
    settled = lambda u, took: F.concat(out, F.array(F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), F.lit(took).alias("took"))))
    state_ = lambda a, b: F.struct(a.alias("c"), b.alias("out"))
    return (
        F.when(c.isNull(), state_(x, out))
        .when((both < 1) & wins, state_(unit(c, both), settled(x, 0)))
        .when(both < 1, state_(unit(x, both), settled(c, 0)))
        .when(wins, state_(unit(x, both - 1), settled(c, 1)))
        .otherwise(state_(unit(c, both - 1), settled(x, 1)))
    )


def _folded(units: DataFrame, *keys: str) -> DataFrame:
    """For each group: done (the settled documents) and left (the carried one)."""
    start = F.struct(F.lit(None).cast(UNIT).alias("c"), F.array().cast(TOOK).alias("out"))
    held = units.groupBy("source", *keys).agg(F.sort_array(F.collect_list(F.struct("at", F.struct("doc_id", "size", "p").alias("u")))).alias("units"))
    folded = held.select("source", *keys, F.aggregate(F.transform("units", lambda x: x["u"]), start, _pair).alias("s"))
    return folded.select("source", *keys, F.col("s.out").alias("done"), F.col("s.c").alias("left"))


def _settled(units: DataFrame, depth: int, tier: int) -> DataFrame:
    """source, doc_id, size, took for the fractions p of units that have source, doc_id, size, p, stratum and path."""
    units = units.withColumn("at", F.col("size"))
    parts = []
    for step in range(depth + 1):
        folded = stored(_folded(units, "stratum", "path"), f"fold{tier}-{step}")
        parts.append(folded.select("source", F.explode("done").alias("x")))
        units = folded.select("source", "stratum", F.expr(f"path div {FAN}").alias("path"), F.col("path").alias("at"), "left.doc_id", "left.size", "left.p")
    folded = stored(_folded(units.withColumn("at", -F.col("stratum"))), f"fold{tier}")
    parts.append(folded.select("source", F.explode("done").alias("x")))
    took = folded.select("source", F.struct("left.doc_id", "left.size", (_draw(F.col("left.doc_id"), F.lit(-1)) < F.col("left.p")).cast("int").alias("took")).alias("x"))
    for part in parts:
        took = took.union(part)
    return took.select("source", "x.doc_id", "x.size", "x.took")


def copies(sized: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: a row for each row of (doc_id, source, size)."""
    sized = stored(sized, "sized")
    src = stored(source_targets(sized), "targets")
    tier = F.lit(len(TIERS))
    for i, share in reversed(list(enumerate(TIERS))):
        tier = F.when(F.col("size") * share > F.col("target"), i).otherwise(tier)
    named = sized.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("repeats")).alias("d").join(src.alias("s"), F.expr("d.source <=> s.source"))
    named = named.select("doc_id", "d.source", "size", "repeats", tier.alias("tier"), F.floor(F.log2("size") * 2).alias("stratum"))
    counts = stored(named.groupBy("source", "tier", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("repeats")).alias("words")), "counts")
    steps = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / float(LEAF)) / math.log(FAN)))
    leaves = counts.select(F.col("source").alias("cs"), F.col("tier").alias("cr"), F.col("stratum").alias("ct"), F.pow(F.lit(float(FAN)), steps).cast("long").alias("leaves"))
    named = named.join(leaves, F.expr("source <=> cs and tier = cr and stratum = ct")).select("doc_id", "source", "size", "repeats", "tier", "stratum", F.expr(f"pmod(xxhash64({SEED}, doc_id, size), leaves)").alias("path"))
    named = stored(named, "units")
    most = dict(counts.groupBy("tier").agg(F.max("n")).collect())
    left = src.select("source", F.col("target").alias("rest"), F.col("source_size").cast("double").alias("words"))
    decided = None
    for t in sorted(most):
        due = F.when(F.col("words") > 0.5, F.least(F.lit(float(CAP)), F.greatest(F.lit(0.0), F.col("rest") / F.col("words")))).otherwise(0.0)
        here = named.where(F.col("tier") == t).alias("d").join(left.select("source", due.alias("due")).alias("s"), F.expr("d.source <=> s.source"))
        here = here.select("doc_id", "d.source", "size", "repeats", "stratum", "path", "due", (F.col("due") - F.floor("due")).alias("p"))
        depth = max(0, math.ceil(math.log(max(1, most[t] / LEAF), FAN)))
        took = _settled(here.where("p > 0").select("source", "doc_id", "size", "p", "stratum", "path"), depth, t)
        took = took.select(F.col("source").alias("ts"), F.col("doc_id").alias("ti"), F.col("size").alias("tz"), "took")
        here = here.join(took, F.expr("doc_id <=> ti and size = tz and source <=> ts"), "left").select("doc_id", "source", "size", "repeats", (F.floor("due") + F.coalesce("took", F.lit(0))).cast("long").alias("copies"))
        here = stored(here, f"tier{t}")
        decided = here if decided is None else decided.union(here)
        spent = here.groupBy("source").agg(F.sum(F.col("copies") * F.col("size") * F.col("repeats")).alias("spent"), F.sum(F.col("size") * F.col("repeats")).alias("seen"))
        left = stored(left.alias("l").join(spent.alias("e"), F.expr("l.source <=> e.source"), "left").select("l.source", (F.col("rest") - F.coalesce("spent", F.lit(0))).alias("rest"), (F.col("words") - F.coalesce("seen", F.lit(0))).alias("words")), f"left{t}")
    rows = sized.alias("d").join(src.alias("s"), F.expr("d.source <=> s.source")).select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target")
    if decided is None:
        return rows.withColumn("copies", F.lit(0).cast("long"))
    decided = decided.select(F.col("doc_id").alias("ti"), F.col("size").alias("tz"), F.col("source").alias("ts"), "copies")
    rows = rows.join(decided, F.expr("doc_id <=> ti and size = tz and source <=> ts"), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words().alias("size"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words, repeats counted)."""
    return copies(sizes(docs)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix repeats them, with all their columns; those without copies are left out."""
    words, doc, source, size, times, copy = fresh(docs, "words", "of_doc", "of_source", "of_size", "times", "copy")
    n = copies(sizes(docs)).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    n = n.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), F.col("copies").cast("int").alias(times))
    held = docs.withColumn(words, n_words()).join(n, F.expr(f"doc_id <=> {doc} and source <=> {source} and {words} = {size}"))
    return held.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(words, doc, source, size, times, copy)
