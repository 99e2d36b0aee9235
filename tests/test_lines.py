"""Files read in byte ranges against the same files read whole."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strataspark.operators import evaluation, training
from strataspark.operators.graph import shared_dir
from strataspark.plans.queries import QUERIES
from strataspark.sources import las, lines, records


@pytest.fixture
def small_ranges(spark):
    """Ranges of a hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "0"}
    was = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_line_numbers(spark, tmp_path, small_ranges):
    want = {}
    for name, n in (("a.txt", 200), ("b.txt", 1), ("c.txt", 37)):
        held = [f"{name} {i} " + "x" * (i * 7 % 150) for i in range(n)]
        (tmp_path / name).write_text("\n".join(held) + "\n")
        want |= {(name, i): v for i, v in enumerate(held)}
    rows = lines.numbered(spark, str(tmp_path)).collect()
    assert {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in rows} == want and len(rows) == len(want)
    assert len({r.bucket for r in rows if "a.txt" in r.file}) > 50


def test_places_of_json_lines(spark, tmp_path, small_ranges):
    good = [{"k": i, "s": "y" * (i % 90)} for i in range(120)]
    held = [json.dumps(g) for g in good]
    for i in (0, 1, 30, 77, 119):
        held.insert(i, "{oops" if i % 2 else "[1")
    (tmp_path / "f.jsonl").write_text("\n".join(held))
    got = lines.json_places(spark, str(tmp_path), "k int, s string").collect()
    assert sorted((r.ord, r.record.k) for r in got) == [(i, i) for i in range(120)]


def test_las_in_ranges(spark, tmp_path, small_ranges):
    head = ["~V", "VERS. 2.0:", "~W", "NULL. -9:", "WELL. : one", "~C", "DEPT.F : depth", "GR.API : gamma", "RES. : res", "~A"]
    body = [f"{i * 0.5:.2f}  {i % 13}  {-9 if i % 5 == 0 else i}" for i in range(300)]
    body.insert(40, "# a remark")
    (tmp_path / "w.las").write_text("\r\n".join(head + body) + "\r\n")
    text = las.lines(spark, str(tmp_path))
    assert text.select("bucket").distinct().count() > 20
    got = sorted((r.idx, r.depth, r.mnemonic, r.value) for r in las.samples(text).collect())
    assert got == sorted((i, i * 0.5, m, v) for i in range(300) for m, v in (("GR", float(i % 13)), ("RES", None if i % 5 == 0 else float(i))))
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.lit("w").alias("file"), F.col("value").alias("text"))
    assert sorted((r.idx, r.mnemonic, r.value or 0) for r in las.samples(las.split_lines(whole)).collect()) == sorted((i, m, v or 0) for i, _, m, v in got)
    assert {(r.mnemonic, r.value) for r in las.header(text).collect() if r.section == "W"} == {("NULL", "-9"), ("WELL", "one")}


def test_lengths_stand_for_traces(spark):
    """Selection and windows are the same from traces and from their lengths."""
    item = "struct<source:string,result:struct<success:boolean,curve_traces:map<string,array<double>>>,success:boolean,curve_traces:map<string,array<double>>>"
    lines = [
        (0, '{"source": "x", "result": {"success": true, "curve_traces": {"GR": [1, 2, 3, null, 5], "N": []}}}'),
        (1, '{"success": true, "curve_traces": {"GR": [1, 2], "N": null}}'), (2, '{"success": false, "curve_traces": {"GR": [1]}}'), (3, '{"source": "x", "result": {"success": true, "curve_traces": null}}')]
    results = spark.createDataFrame(lines, "ord long, line string").select("ord", F.from_json("line", item).alias("item"))
    curve = "struct<name:string,las_mnemonic:string,type:string,mode:string,hot_side:string,left_px:int,right_px:int,left_value:double,right_value:double>"
    kind = f"struct<image:string,image_path:string,header_metadata:map<string,string>,config:struct<depth:struct<top_px:int,bottom_px:int>,curves:array<{curve}>,global_options:struct<`null`:double>>>"
    job = '{"image_path": "a/b", "config": {"depth": {"top_px": 1, "bottom_px": 8}, "curves": [{"name": "GR", "mode": "black", "right_px": 9}, {"name": "N", "mode": "black", "right_px": 9}]}}'
    configs = spark.range(4).select(F.col("id").alias("ord"), F.from_json(F.lit(job), kind).alias("job"))
    whole, short = training.zipped(configs, results), training.zipped(configs, results.select("ord", training.lengths(F.col("item")).alias("item")))
    items = [{(r.ord, r.curve_name, r.n) for r in training.curve_items(j).withColumn("n", n).collect()} for j, n in ((whole, F.size("trace")), (short, F.col("trace")))]
    assert items[0] == items[1] == {(0, "GR", 5), (0, "N", 0), (1, "GR", 2)}
    windows = [{(r.ord, r.pos, r.row0, r.row1, r.n) for r in evaluation.holdout_samples(j, 100.0, 3).withColumn("n", n).collect()} for j, n in ((whole, F.size("trace")), (short, F.col("trace")))]
    assert windows[0] == windows[1] == {(0, 0, 0, 3, 3), (0, 0, 3, 6, 2), (1, 0, 0, 3, 2)}


def test_results_leave_little_on_disk(spark, sf):
    """Results whose traces hold 16 kB a part as text are neither stored nor moved at that length."""
    before = set(Path(shared_dir(spark).removeprefix("file://")).rglob("*.txt*"))
    assert QUERIES["trn_items"](spark, sf).count()
    files = [f for f in Path(shared_dir(spark).removeprefix("file://")).rglob("*.txt*") if f not in before]
    assert files and sum(f.stat().st_size for f in files) < 2000 * spark.read.parquet(f"{sf}/part.parquet").count()


def test_documents_of_a_sequence(spark, tmp_path, small_ranges):
    """Documents of every form in one file, read in byte ranges; no record is lost and no number of files grows with them."""
    held, n = [], 0
    for i in range(60):
        r = [json.dumps({"k": n + j, "s": "z" * (i % 9)}) for j in range(i % 5)]
        n += len(r)
        many = "[" + ", ".join(r) + "]"
        held.append((many, f'{{"items": {many}}}', f'{{"data": {many}}}', f'{{"results": {many}}}', "\n".join(r))[i % 5])
    (tmp_path / "f.json-seq").write_text("".join(records.SEPARATOR + d + "\n" for d in held))
    got = records.json_documents(spark, str(tmp_path), "k int, s string", records.SEPARATOR)
    assert sorted(r.k for r in got.collect() if r.k is not None) == list(range(n))


def test_documents_make_few_files(spark, sf):
    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.rglob("part-*"))
    rows = QUERIES["src_json_documents"](spark, sf).count()
    assert rows == spark.read.parquet(f"{sf}/events.parquet").count() and len(set(folder.rglob("part-*")) - before) < rows / 70


def test_las_texts_of_many_wells_share_files(spark, tmp_path):
    """A file holds many wells' texts, and they are read as if each were a file of its own, also where a byte range begins inside one."""
    s = spark.range(600).select((F.col("id") % 40).cast("string").alias("file"), F.floor(F.col("id") / 40).alias("idx"), (F.col("id") / 40).alias("depth"), F.lit("gr").alias("mnemonic"), F.when(F.col("id") % 7 > 0, F.col("id") * 1.0).alias("value"))
    wells = s.select("file").distinct().select("file", F.lit("m").alias("unit"), F.create_map(F.lit("well"), F.concat(F.lit("W"), "file")).alias("metadata"), F.array(F.struct(F.lit("gr").alias("name"), F.lit("API").alias("unit"))).alias("curves"))
    las.write_las(s, wells, f"{tmp_path}/apart")
    las.write_las_files(s, wells, f"{tmp_path}/together")
    assert len(list((tmp_path / "together").glob("part-*"))) <= 4 and len(list((tmp_path / "apart").glob("file=*"))) == 40
    want = las.samples(las.lines(spark, f"{tmp_path}/apart/*")).withColumn("file", F.regexp_extract("file", "file=([^/]*)/", 1))
    want = sorted(map(str, want.select("file", "idx", "depth", "mnemonic", "value").collect()))
    assert len(want) == 600
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "1000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = las.samples(las.lines(spark, f"{tmp_path}/together", las.SEPARATOR))
            assert sorted(map(str, got.select("file", "idx", "depth", "mnemonic", "value").collect())) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
