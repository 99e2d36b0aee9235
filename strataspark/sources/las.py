"""LAS text: scan to header, curve and sample tables, and sink from samples in the LAS 1.2 layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import NULL_MARKER, first_metadata
from ..operators.curves import around
from ..operators.graph import stored
from .lines import numbered, ordinals

#: mnemonic, unit, value and description of a header line; the description follows the last colon.
_HEADER = r"^\s*([^.\s]+)\s*\.(\S*)(?:\s+(.*?))?\s*(?::\s*([^:]*))?$"
# The lines of the LAS 1.2 layout, and the fields that are written only where they are known.
_VERSION = (
    "~VERSION INFORMATION",
    " VERS.                 1.20:   CWLS LOG ASCII STANDARD -VERSION 1.20",
    " WRAP.                   NO:   ONE LINE PER DEPTH STEP",
    "~WELL INFORMATION BLOCK",
    "#MNEM.UNIT       DATA TYPE    INFORMATION",
    "#---------     -----------    ---------------------------",
)
_PARAMETERS = (
    "~PARAMETER INFORMATION BLOCK",
    "#MNEM.UNIT       VALUE        DESCRIPTION",
    "#---------     -----------    ---------------------------",
    " EKB .               0.0000:  ELEVATION OF KELLY BUSHING",
    "~CURVE INFORMATION BLOCK",
    "#MNEM.UNIT                 API CODE     CURVE DESCRIPTION",
    "#---------               -----------    ---------------------------",
)
_DEPTH_LINE = ".{unit}                 00 000 000 000:  DEPTH"
_FIELDS = ("COMP", "WELL", "FLD", "LOC", "CNTY", "STAT", "PROV", "SRVC", "DATE", "API", "UWI")
_DEFAULT_WELL = "DIGITIZED_LOG"
#: What stands before a text's name where a file holds many texts: the control character that separates files.
SEPARATOR = "\x1c"
#: Texts a file.
RECORDS = 4096
#: Well fields whose value stands before the colon in LAS 1.2, whatever follows it.
_NUMBERS = ("STRT", "STOP", "STEP", "NULL")


def lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """file, bucket, line_no, line, section (first letter of the last ~ line). Large files are read in byte ranges, over whose borders the section is carried.

    A file is a well's text, or with a separator (SEPARATOR, as write_las_files() has it) as many as it separates: then file
    is the name behind the separator, and carried over borders like a section. The lines are stored, for header, curves
    and samples all read them.
    """
    t = numbered(spark, path)
    if separator is not None:
        own = F.startswith("line", F.lit(separator))
        t = around(t, ("file",), F.col("line_no"), F.when(own, F.substr("line", F.lit(len(separator) + 1))), ("_name", "_next"))
        t = t.where(~own).select(F.col("_name").alias("file"), "bucket", "line_no", "line")
    return stored(_sections(t), "las-lines")


def split_lines(files: DataFrame) -> DataFrame:
    """The same from rows of file and text, each text one bucket."""
    return _sections(files.select("file", F.lit(0).cast("long").alias("bucket"), F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")))


def _sections(t: DataFrame) -> DataFrame:
    mark = F.when(F.col("line").startswith("~"), F.upper(F.substring("line", 2, 1)))
    t = around(t, ("file",), F.col("line_no"), mark, ("section", "_next")).drop("_next")
    return t.where("not startswith(line, '~') and not startswith(line, '#') and trim(line) <> ''")


def header(text: DataFrame) -> DataFrame:
    """file, line_no, section, mnemonic, unit, value, descr of every header line.

    A well field other than start, stop, step and null has its value behind the colon where something stands there, as
    LAS 1.2 has it, else before it.
    """
    part = lambda i: F.trim(F.regexp_extract("line", _HEADER, i))
    h = text.where("section <> 'A'").select("file", "line_no", "section", part(1).alias("mnemonic"), part(2).alias("unit"), part(3).alias("a"), part(4).alias("b"))
    turned = (F.col("section") == "W") & ~F.upper("mnemonic").isin(*_NUMBERS) & (F.col("b") != "")
    value, descr = (F.when(turned, F.col(x)).otherwise(F.col(y)) for x, y in (("b", "a"), ("a", "b")))
    return h.where("mnemonic <> ''").select("file", "line_no", "section", "mnemonic", "unit", value.alias("value"), descr.alias("descr"))


def curves(text: DataFrame) -> DataFrame:
    w = Window.partitionBy("file").orderBy("line_no")
    return header(text).where("section = 'C'").select("file", (F.row_number().over(w) - 1).alias("pos"), "mnemonic", "unit", "descr")


def samples(text: DataFrame) -> DataFrame:
    """file, idx, depth, mnemonic, value; the depth curve is the first DEPT or DEPTH; files without one give none. The header's NULL is null."""
    c = curves(text)
    depth = c.where("upper(mnemonic) in ('DEPT', 'DEPTH')").groupBy("file").agg(F.min("pos").alias("at"))
    null = header(text).where("section = 'W' and upper(mnemonic) = 'NULL'").groupBy("file").agg(F.first(F.expr("try_cast(value as double)")).alias("null"))
    rows = ordinals(text.where("section = 'A'"), ("file",), ("line_no",), "idx").select("file", "idx", F.split(F.trim("line"), r"\s+").alias("v"))
    rows = rows.join(depth, "file").join(null, "file", "left")
    rows = rows.select("file", "idx", "null", "at", F.expr("try_cast(get(v, at) as double)").alias("depth"), F.posexplode("v").alias("pos", "v")).where("pos <> at")
    value = F.expr("try_cast(v as double)")
    held = rows.join(c.select("file", "pos", "mnemonic"), ["file", "pos"])
    return held.select("file", "idx", "depth", "mnemonic", F.when(value != F.coalesce("null", F.lit(NULL_MARKER)), value).alias("value"))


def unit_token(unit: Column) -> Column:
    return F.when(F.upper(unit).startswith("F"), "F").otherwise(F.upper(unit))


def las_text(samples_: DataFrame, wells: DataFrame) -> DataFrame:
    """file, text from samples (file, idx, depth, mnemonic, value) and wells (file, unit, metadata map, curves array of name and unit, in the order of the columns).

    Lines end by CRLF; missing values are written as -999.25, whatever marker a job has. A well's text is one value, so a
    well's rows are gathered; wells are independent.
    """
    cells = samples_.groupBy("file", "idx", "depth").agg(F.map_from_entries(F.collect_list(F.struct("mnemonic", "value"))).alias("m"))
    row = cells.join(wells.select("file", "curves"), "file")
    number = lambda v: F.format_string("%10.4f", v)
    values = F.transform("curves", lambda c: number(F.coalesce(F.element_at("m", c["name"]), F.lit(NULL_MARKER))))
    line = F.concat_ws(" ", number("depth"), F.array_join(values, " "))
    body = row.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("idx", "depth", line.alias("t")))).alias("r")).join(wells, "file")

    unit, md = unit_token(F.col("unit")), F.col("metadata")
    short = lambda c: F.format_string("%.4f", c)
    depth = lambda i: F.get("r", F.lit(i))["depth"]
    place = lambda name, v: F.concat(F.lit(f" {name}."), unit, F.lit("               "), short(v), F.lit(":"))
    named = []
    for field in _FIELDS:
        value = first_metadata(md, field)
        if field == "WELL":
            value = F.when(value == "", _DEFAULT_WELL).otherwise(value)
        named.append(F.when(value != "", F.concat(F.lit(f" {field:<4}.       "), value, F.lit(":"))))
    up = F.transform("curves", lambda c: F.upper(c["name"]))
    curve_lines = F.transform("curves", lambda c: F.concat(F.lit(" "), F.upper(c["name"]), F.lit("."), F.coalesce(c["unit"], F.lit("")), F.lit(" :  "), F.upper(c["name"])))
    titles = F.array_join(F.transform(F.concat(F.array(F.lit("DEPTH")), up), lambda n: F.format_string("%10s", n)), " ")
    before, after = _DEPTH_LINE.split("{unit}")
    parts = [
        *map(F.lit, _VERSION),
        place("STRT", depth(0)),
        place("STOP", F.element_at("r", -1)["depth"]),
        place("STEP", F.coalesce(depth(1) - depth(0), F.lit(0.0))),
        F.lit(f" NULL.               {NULL_MARKER:.4f}:"),
        *named,
        *map(F.lit, _PARAMETERS),
        F.concat(F.lit(f" DEPT{before}"), unit, F.lit(after)),
        F.when(F.size("curves") > 0, F.array_join(curve_lines, "\r\n")),
        F.concat(F.lit("~A "), titles),
        F.array_join(F.transform("r", lambda x: x["t"]), "\r\n"),
        F.lit(""),
    ]
    return body.select("file", F.concat_ws("\r\n", *parts).alias("text"))


def write_las(samples_: DataFrame, wells: DataFrame, path: str) -> None:
    """One folder a well with its text; the last line end is the writer's own."""
    held = las_text(samples_, wells).select("file", F.expr("rtrim('\r\n', text)").alias("text"))
    held.write.partitionBy("file").option("lineSep", "\r\n").text(path)


def write_las_files(samples_: DataFrame, wells: DataFrame, path: str) -> None:
    """The texts of many wells a file, each behind a line of SEPARATOR and the well's name, so that the number of files doesn't grow with each well."""
    text = F.concat(F.lit(SEPARATOR), "file", F.lit("\r\n"), F.expr("rtrim('\r\n', text)"))
    las_text(samples_, wells).select(text.alias("value")).write.option("lineSep", "\r\n").option("maxRecordsPerFile", RECORDS).text(path)
