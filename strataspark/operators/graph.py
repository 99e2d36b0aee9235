"""Tables in the shared folder, and connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid
import warnings

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where it is unset, one is made on a local master, as in tests; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "cut", *by: str) -> DataFrame:
    """The same rows, computed once, written as Parquet in the shared folder (in folders by some columns) and read back: what is lost later starts from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.select(*df.columns) if by else out
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing will read again; where the folder's store isn't one that can be reached from here, they stay."""
    for df in tables:
        path = getattr(df, "_stored_path", None)
        if path:
            try:
                store, top = fs.FileSystem.from_uri(path)
                store.delete_dir(top)
            except (OSError, ValueError, NotImplementedError) as error:
                warnings.warn(f"{path} stays: {error}", stacklevel=2)


def cut(df: DataFrame) -> DataFrame:
    return stored(df)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the edges: component is the smallest node reachable.

    Alternating large-star and small-star rounds of joins and grouped minima until a round changes nothing; each round is
    a table in the shared folder, and the round before it goes. No group is gathered: a hub's neighbours meet only a
    one-row minimum. Null ends and loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, before, now = stored(e, "edges"), None, ()
    while now != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, now = now, e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        discard(last)
    own = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_anti")
    return own.union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))
