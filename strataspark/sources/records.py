"""JSON records, correction and capture logs, pair folders, images, and the append-only tables' sinks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRECTION = """event_id STRING, ts_utc TIMESTAMP, type STRING, curve_id STRING, curve_index INT, mode STRING,
  track STRUCT<leftX: DOUBLE, rightX: DOUBLE, leftValue: DOUBLE, rightValue: DOUBLE>, depth_index INT, depth DOUBLE,
  before STRUCT<x: DOUBLE, y: DOUBLE>, after STRUCT<x: DOUBLE, y: DOUBLE>, refine STRING, fallback STRUCT<reason: STRING>, notes STRING, image_path STRING"""


#: What stands round the documents of a JSON text sequence (RFC 7464), and in no JSON document.
SEPARATOR = "\x1e"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_documents(spark: SparkSession, path: str, schema: str, separator: str | None = None) -> DataFrame:
    """Records of whole JSON documents: an array, or the first of items, data and results that is one, else the document itself; else its lines.

    A file is a document, or with a separator as many as that separates (SEPARATOR in JSON text sequences): files of many
    small documents are read in byte ranges, and their number doesn't grow with that of the documents.
    """
    return _documents(spark.read.text(path, wholetext=True) if separator is None else spark.read.text(path, lineSep=separator), schema)


def _documents(t: DataFrame, schema: str) -> DataFrame:
    arr = F.from_json("value", f"array<struct<{schema}>>")
    wrap = F.from_json("value", f"struct<items: array<struct<{schema}>>, data: array<struct<{schema}>>, results: array<struct<{schema}>>>")
    one = F.from_json("value", f"struct<{schema}>")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x).startswith("{") & F.try_parse_json(x).isNotNull())
    by_line = F.transform(lines, lambda x: F.from_json(x, f"struct<{schema}>"))
    whole = F.when(F.try_parse_json("value").isNotNull(), F.array(one))
    rows = F.when(F.substring(F.trim("value"), 1, 1) == "[", arr).when(F.size(lines) > 1, by_line).otherwise(F.coalesce(wrap["items"], wrap["data"], wrap["results"], whole, by_line))
    return t.select(F.explode(rows).alias("r")).select("r.*")


def corrections(spark: SparkSession, root: str) -> DataFrame:
    r = spark.read.schema(CORRECTION).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "corrections.jsonl").json(root)
    return r.select("*", F.to_date(F.regexp_extract("_metadata.file_path", r"(\d{4}-\d{2}-\d{2})/(?:[^/]+/)?[^/]+$", 1)).alias("day"))


def write_logs(lines: DataFrame, root: str, name: str) -> None:
    """Lines (day, value) as logs of one name, root/day/nnnnn/name: tasks write a day's lines side by side, then every file is renamed, so that readers which look for the name find whole files only.

    What exists stays: a number that is taken is passed over. No line passes the driver, only the names of files.
    """
    store, top = fs.FileSystem.from_uri(root)
    stage = f"_{uuid.uuid4().hex}"
    lines.select("day", "value").write.partitionBy("day").text(f"{root}/{stage}")
    held = {f.path for f in store.get_file_info(fs.FileSelector(top, recursive=True))}
    number = {}
    for path in sorted(p for p in held if f"/{stage}/" in p and re.search(r"/day=[^/]+/part-[^/]+$", p)):
        day = re.search(r"/day=([^/]+)/", path)[1]
        n = number.get(day, 0)
        while f"{top}/{day}/{n:05d}" in held:
            n += 1
        number[day] = n + 1
        store.create_dir(f"{top}/{day}/{n:05d}", recursive=True)
        store.move(path, f"{top}/{day}/{n:05d}/{name}")
    store.delete_dir(f"{top}/{stage}")


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")


def captures(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All captures.jsonl below the root; only where there is none, every JSON document, read as json_documents() reads one."""
    if not _files(spark, root, "captures.jsonl").isEmpty():
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", "captures.jsonl").json(root)
    return _documents(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True), schema)


def pair_files(paths: DataFrame, sources: list[str] | None = None, max_pairs: int | None = None, max_scans: int | None = None) -> DataFrame:
    """source, pair_id, las, scan from a listing (path): root/source/pairs/pair_id/file. First LAS by name, every TIFF, capped where asked."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/pairs/([^/]+)/([^/]+)$", i)
    f = paths.select(F.lower(part(1)).alias("source"), part(2).alias("pair_id"), part(3).alias("name")).where("pair_id <> ''")
    if sources is not None:
        f = f.where(F.col("source").isin([s.lower() for s in sources]))
    las = f.where(F.lower("name").endswith(".las")).groupBy("source", "pair_id").agg(F.min("name").alias("las"))
    scan = f.where(F.lower("name").rlike(r"\.tiff?$")).withColumn("n", F.row_number().over(Window.partitionBy("source", "pair_id").orderBy("name")))
    if max_scans is not None:
        scan = scan.where(F.col("n") <= max_scans)
    pairs = f.select("source", "pair_id").distinct()
    if max_pairs is not None:
        pairs = pairs.orderBy("source", "pair_id").limit(max_pairs)
    return pairs.join(las, ["source", "pair_id"], "left").join(scan.select("source", "pair_id", F.col("name").alias("scan")), ["source", "pair_id"], "left")


def pair_folders(spark: SparkSession, root: str, sources: list[str] | None = None, max_pairs: int | None = None, max_scans: int | None = None) -> DataFrame:
    """pair_files() of all files below the root; only their names are read."""
    return pair_files(_files(spark, root, "*"), sources, max_pairs, max_scans)


def pixels(spark: SparkSession, path: str) -> DataFrame:
    """image_id, y, x, b, g, r of every image; grey is repeated, alpha left out."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, h, w, n, data in pdf.itertuples(index=False):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int32)
                a = np.repeat(a, 3, 2) if n == 1 else a[:, :, :3]
                step = max(1, 200_000 // w)
                for top in range(0, h, step):
                    part = a[top : top + step]
                    y, x = np.mgrid[top : top + len(part), 0:w]
                    yield pd.DataFrame({"image_id": name, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "b": part[:, :, 0].ravel(), "g": part[:, :, 1].ravel(), "r": part[:, :, 2].ravel()})

    img = spark.read.format("image").option("dropInvalid", True).load(path)
    return img.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "image_id string, y int, x int, b int, g int, r int")


#: Curve types that adjustments are kept by; others are OTHER.
KNOWN_TYPES = ("GR", "RHOB", "NPHI", "DT", "CALI", "SP", "OTHER")


def append_adjustments(rows: DataFrame, path: str, known: tuple[str, ...] = KNOWN_TYPES) -> None:
    """Appends rows that have their required fields; unknown curve types become OTHER, a missing quality 1."""
    good = rows.where("curve_type is not null and original_params is not null and user_params is not null")
    if "quality_score" in rows.columns:
        good = good.withColumn("quality_score", F.coalesce("quality_score", F.lit(1.0)))
    kind = F.when(F.col("curve_type").isin(*known), F.col("curve_type")).otherwise("OTHER")
    good.withColumn("curve_type", kind).write.mode("append").partitionBy("curve_type").parquet(path)


def clear_adjustments(spark: SparkSession, path: str, curve_type: str | None = None) -> int:
    """Overwrites the partitions of one type, or all, by empty ones; gives the rows left.

    A partition is replaced by the commit of one write; nothing else of the table is touched, so a stop leaves the
    partition as it was or empty.
    """
    held = spark.read.parquet(path)
    kinds = [r[0] for r in held.select("curve_type").distinct().collect() if curve_type in (None, r[0])]  # at most one row a known type
    for kind in kinds:
        empty = held.drop("curve_type").limit(0)
        empty.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/curve_type={kind}")
    return spark.read.schema(held.schema).parquet(path).count()


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_summary(pairs: DataFrame, path: str, curve: str, sources: tuple[str, ...] = ()) -> None:
    """The export's summary: totals beside a row a pair (pairing.pair_summary()), as one JSON document; it has a row a pair."""
    rows = F.array_sort(F.collect_list(F.struct(*pairs.columns)))
    one = pairs.agg(F.lit(curve.strip().upper()).alias("curve"), F.lit(",".join(sorted(sources))).alias("sources"), F.count(F.lit(1)).alias("pair_count"), F.coalesce(F.sum("example_count"), F.lit(0)).alias("example_count"), rows.alias("processed"))
    one.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
