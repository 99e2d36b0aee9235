"""Operators without an SQL twin: brute force, round trips, and streams against batches."""

import itertools
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions import columns as C
from strataspark.operators import accounts, curves, pairing, pixels, traces
from strataspark.plans.queries import QUERIES
from strataspark.sources import las, records
from strataspark.streaming import feeds


def image(spark, a, name="p", on=False):
    rows = [("i", y, x, bool(v) if on else float(v)) for y, r in enumerate(a) for x, v in enumerate(r)]
    return spark.createDataFrame(rows, f"image_id string, y int, x int, {'on boolean' if on else name + ' double'}")


def test_seam_is_no_dearer_than_any_path(spark):
    p = np.random.default_rng(1).random((6, 5))
    got = {r.row_idx: int(r.x) for r in traces.seam(image(spark, p)).collect()}
    cost = sum(1 - p[y, x] for y, x in got.items())
    best = min(sum(1 - p[y, x] for y, x in enumerate(path)) for path in itertools.product(range(5), repeat=6) if all(abs(a - b) <= 1 for a, b in zip(path, path[1:])))
    assert cost == pytest.approx(best)


def test_paths_cross_whole_images(spark):
    """Least-cost seams of 2600 rows, held against sums over all rows."""
    p = np.random.default_rng(9).random((2600, 6)) / 2
    p[:2500, 0], p[2500:, 5] = 0.9, 1.0
    x = {r.row_idx: int(r.x) for r in traces.seam(image(spark, p)).collect()}
    total = 1 - p[0]
    for row in p[1:]:
        side = np.pad(total, 1, constant_values=np.inf)
        total = 1 - row + np.minimum(np.minimum(side[1:-1], side[:-2]), side[2:])
    assert all(abs(x[y] - x[y - 1]) <= 1 for y in range(1, 2600))
    assert sum(1 - p[y, x[y]] for y in range(2600)) == pytest.approx(total.min())


def costs(spark, cost, p, step, smooth, bend):
    rows = [("i", y, x, float(cost[y, x]), float(p[y, x]), step, smooth, bend) for y in range(len(p)) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "image_id string, y int, x int, cost double, p double, step int, smooth double, bend double")


@pytest.mark.parametrize("smooth,bend", [(0.1, 0.0), (0.05, 0.0), (0.0, 0.0)])
def test_viterbi_against_all_paths(spark, smooth, bend):
    rng = np.random.default_rng(4)
    p, step = rng.random((6, 4)), 2
    cost = -np.log(p)
    got = {r.row_idx: (r.x, r.conf) for r in traces.viterbi(costs(spark, cost, p, step, smooth, bend)).collect()}
    best = {}
    for n in (5, 6):  # the end may be in the last fifth: rows 4 and 5
        for path in itertools.product(range(4), repeat=n):
            if all(abs(a - b) <= step for a, b in zip(path, path[1:])):
                best[path] = sum(cost[y, x] for y, x in enumerate(path)) + smooth * sum((b - a) ** 2 for a, b in zip(path, path[1:]))
    path = list(min(best, key=best.get))
    while len(path) < 6:
        y, low = len(path), max(0, path[-1] - step)
        path.append(low + int(p[y, low : path[-1] + step + 1].argmax()))
    assert [got[y][0] for y in range(6)] == path
    for y, x in enumerate(path):
        window = sorted(p[y, max(0, x - step) : x + step + 1])
        assert got[y][1] == pytest.approx(p[y, x] - window[-2])


def test_viterbi_bends_cost_by_the_path_that_reached_a_place(spark):
    """The second difference counts from the third row on, along each place's own best way."""
    rng = np.random.default_rng(11)
    p, step, smooth, bend = rng.random((12, 7)), 2, 0.02, 0.3
    cost = -np.log(p)
    total, back = list(cost[0]), []
    for y in range(1, 12):
        new, came = [], []
        for x in range(7):
            ways = [(total[u] + cost[y, x] + smooth * (x - u) ** 2 + (bend * (x - 2 * u + back[-1][u]) ** 2 if y >= 2 else 0), u) for u in range(max(0, x - step), min(7, x + step + 1))]
            value, u = min(ways)
            new.append(value)
            came.append(u)
        total = new
        back.append(came)
        if y == 9:
            end = total.index(min(total))
            low = min(total)
        if y > 9:
            assert min(total) >= low
    path = [end]
    for y in range(9, 0, -1):
        path.append(back[y - 1][path[-1]])
    got = [r.x for r in traces.viterbi(costs(spark, cost, p, step, smooth, bend)).orderBy("row_idx").collect()]
    assert got[:10] == path[::-1]


def drawn(height=120, width=60, rail=None):
    """A mask of a swinging stroke three columns wide; its middle."""
    middle = 30 + 18 * np.sin(np.arange(height) / 20)  # under a column a row, as the seam steps
    a = np.zeros((height, width))
    for y in range(height):
        c = int(round(middle[y]))
        a[y, c - 1 : c + 2] = 255
    if rail is not None:
        a[:, rail - 1 : rail + 3] = 255
    return a, middle


def off(got, middle):
    x = {r.row_idx: r.x for r in got.collect() if r.x is not None}
    return len(x) / len(middle), np.mean([abs(x[y] - middle[y]) for y in x])


def test_tracers_follow_a_stroke(spark):
    a, middle = drawn()
    mask = image(spark, a, "value")
    prob = mask.selectExpr("image_id", "y", "x", "value / 255 as p")
    setting = traces.settings(mask.select("image_id").distinct(), step=6, smooth=0.01)
    for got in (traces.dp_tracer(prob, setting), traces.dot_print_tracer(mask), traces.multiscale_tracer(mask, setting), traces.ridge_tracer(mask)):
        share, error = off(got, middle)
        assert share > 0.95 and error < 1.6


def test_dp_tracer_leaves_a_solid_rail(spark):
    a, middle = drawn(rail=55)
    prob = image(spark, a / 255, "p")
    share, error = off(traces.dp_tracer(prob, traces.settings(prob.select("image_id").distinct(), step=6, smooth=0.01)), middle)
    assert share > 0.95 and error < 1.6


def test_followed_crosses_faint_rows_and_starts_at_most_ink(spark):
    p = np.zeros((40, 90))
    p[:, 20] = 0.5
    p[10, 60:64] = 0.4  # the row of most ink has its strongest place on the line
    p[25] = 0.0
    got = {r.row_idx: (r.x, r.conf) for r in traces.followed(image(spark, p)).collect()}
    assert got[25] == (None, 0.0) and {got[y][0] for y in range(40) if y != 25} == {20.0}
    p[30:, 20], p[30:, 22] = 0.5, 0.5000001  # a peak's strength outweighs two columns of distance only by more than that costs
    got = {r.row_idx: r.x for r in traces.followed(image(spark, p)).collect()}
    assert got[35] == 20.0


def test_pair_windows_are_thinned_to_eighteen(spark, sf):
    """The reference's default of windows a panel, as it picks them."""
    got = {r.p_partkey: r.starts for r in QUERIES["pair_windows"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/part.parquet").collect():
        last = max(0, r.p_size * 90 + 100 - 256)
        starts = sorted({*range(0, last + 1, 128), last})
        if len(starts) > 18:
            starts = sorted({starts[i] for i in np.linspace(0, len(starts) - 1, 18, dtype=int)})
        assert got[r.p_partkey] == ",".join(map(str, starts))


def test_largest_component(spark):
    a = np.random.default_rng(3).random((12, 12)) < 0.45
    seen, best = set(), set()
    for s in zip(*np.nonzero(a)):
        if s not in seen:
            todo, comp = [s], set()
            while todo:
                y, x = todo.pop()
                if (y, x) in comp or not (0 <= y < 12 and 0 <= x < 12) or not a[y, x]:
                    continue
                comp.add((y, x))
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            seen |= comp
            best = max(best, comp, key=len)
    assert {(r.y, r.x) for r in pixels.largest_component(image(spark, a, on=True)).collect()} == best


def test_interpolation_limit(spark):
    x = [None, None, None, 1.0, None, None, None, None, None, 7.0, None, None, None]
    df = spark.createDataFrame([("i", i, v) for i, v in enumerate(x)], "image_id string, row_idx int, x double")
    got = [r.x for r in curves.interpolated(df, ("image_id",), 2).orderBy("row_idx").collect()]
    assert got == [None, 1, 1, 1, 2, 3, None, 5, 6, 7, 7, 7, None]


LAS = """~VERSION INFORMATION
 VERS.                 1.20:   CWLS LOG ASCII STANDARD -VERSION 1.20
 WRAP.                   NO:   ONE LINE PER DEPTH STEP
~WELL INFORMATION BLOCK
#MNEM.UNIT       DATA TYPE    INFORMATION
#---------     -----------    ---------------------------
 STRT.F               100.0000:
 STOP.F               101.0000:
 STEP.F               0.5000:
 NULL.               -999.2500:
 COMP.       Acme Oil:
 WELL.       A-1:
 FLD .       West:
 CNTY.       White Pine:
 STAT.       NV:
 DATE.       1-2-96:
 API .       42:
~PARAMETER INFORMATION BLOCK
#MNEM.UNIT       VALUE        DESCRIPTION
#---------     -----------    ---------------------------
 EKB .               0.0000:  ELEVATION OF KELLY BUSHING
~CURVE INFORMATION BLOCK
#MNEM.UNIT                 API CODE     CURVE DESCRIPTION
#---------               -----------    ---------------------------
 DEPT.F                 00 000 000 000:  DEPTH
 RHOB.G/C3 :  RHOB
 GR.API :  GR
~A      DEPTH       RHOB         GR
  100.0000     2.2500     0.0000
  100.5000     4.5000  -999.2500
  101.0000     6.7500     3.0000
"""


def test_las_text_and_back(spark, tmp_path):
    rows = [("w", i, 100 + i / 2, m, None if (i, m) == (1, "gr") else v) for i in range(3) for m, v in (("gr", i * 1.5), ("rhob", (i + 1) * 2.25))]
    s = spark.createDataFrame(rows, "file string, idx int, depth double, mnemonic string, value double")
    md = {"company": " Acme Oil", "well": "A-1", "field": "West", "county": "White Pine", "state": "NV", "date": "1-2-96", "api": "42", "uwi": " "}
    w = spark.createDataFrame([("w", "ft", md, [("rhob", "G/C3"), ("gr", "API")])], "file string, unit string, metadata map<string,string>, curves array<struct<name:string,unit:string>>")
    assert las.las_text(s, w).first().text == LAS.replace("\n", "\r\n")
    las.write_las(s, w, str(tmp_path / "out"))
    back = las.samples(las.lines(spark, str(tmp_path / "out/file=w")))
    assert {(r.idx, r.mnemonic): (r.depth, r.value) for r in back.collect()} == {(i, m.upper()): (d, v) for _, i, d, m, v in rows}


def test_las_scan_of_labelled_values(spark, tmp_path):
    """Files with parameters and with a well field's label before the colon; lines without a depth curve give nothing."""
    text = LAS.replace(" COMP.       Acme Oil:", " COMP.            COMPANY NAME:  NEWARK OIL CO.").replace(" DEPT.F                 00 000 000 000:  DEPTH", " DEPT.F                 00 000 000 000:  ")
    (tmp_path / "a.las").write_text(text.replace(" EKB .", " BHT .                 85.0000:  BOTTOMHOLE TEMPERATURE\n EKB ."))
    (tmp_path / "b.las").write_text(LAS.replace("DEPT.F", "TIME.S"))
    lines = las.lines(spark, str(tmp_path))
    h = {(r.mnemonic, r.section): (r.unit, r.value, r.descr) for r in las.header(lines).where("file like '%a.las'").collect()}
    assert h["COMP", "W"] == ("", "NEWARK OIL CO.", "COMPANY NAME") and h["WELL", "W"][1] == "A-1" and h["STRT", "W"][:2] == ("F", "100.0000")
    assert h["BHT", "P"] == ("", "85.0000", "BOTTOMHOLE TEMPERATURE") and h["RHOB", "C"] == ("G/C3", "", "RHOB")
    got = las.samples(lines)
    assert {r.file.rsplit("/", 1)[1] for r in got.collect()} == {"a.las"} and got.count() == 6
    assert [r.mnemonic for r in las.curves(lines).where("file like '%a.las'").orderBy("pos").collect()] == ["DEPT", "RHOB", "GR"]


def png(a):
    h, w, _ = a.shape
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + a[y, :, ::-1].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def test_image_scan(spark, tmp_path):
    a = np.random.default_rng(8).integers(0, 256, (7, 5, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(a))
    got = {(r.y, r.x): (r.b, r.g, r.r) for r in records.pixels(spark, str(tmp_path)).collect()}
    assert got == {(y, x): tuple(map(int, a[y, x])) for y in range(7) for x in range(5)}


def test_digitize_a_drawn_scan(spark):
    """A dark stroke on white between rails becomes values at its places."""
    a, middle = drawn(height=80, width=64)
    white = np.where(a > 0, 20, 250)
    white[:, :2] = 10
    rows = [("s", y, x, int(v), int(v), int(v)) for y, r in enumerate(white) for x, v in enumerate(r)]
    pix = spark.createDataFrame(rows, "image_id string, y int, x int, b int, g int, r int")
    jobs = spark.createDataFrame(
        [("s", 0, "GR", "API", "black", 0, 64, 0, 500, 0.0, 63.0, 1000.0, 1079.0, "ft", {"well": "x y"})],
        "image_id string, pos int, name string, unit string, mode string, left_px int, right_px int, top_px int, bottom_px int, left_value double, right_value double, top_depth double, bottom_depth double, depth_unit string, metadata map<string,string>")
    values, points, texts = traces.digitize(pix, jobs, blur=0)
    got = {r.idx: (r.depth, r.value) for r in values.collect()}
    assert len(got) == 80 and all(got[y][0] == pytest.approx(1000 + y) for y in got)
    assert np.mean([abs(got[y][1] - middle[y]) for y in range(80)]) < 1.0
    text = texts.first()
    assert text.name == "x_y.las" and " STOP.F               1079.0000:" in text.text and len(points.first().points) == 80


def edges_by_loops(v, low, high):
    h, w = v.shape
    pad = np.pad(v, 1, mode="edge")
    gx, gy = np.zeros((h, w)), np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            n = pad[y : y + 3, x : x + 3]
            gx[y, x] = (n[:, 2] - n[:, 0]) @ [1, 2, 1]
            gy[y, x] = (n[2] - n[0]) @ [1, 2, 1]
    m = np.pad(abs(gx) + abs(gy), 1)
    keep = np.zeros((h, w), dtype=bool)
    for y in range(h):
        for x in range(w):
            c = m[y + 1, x + 1]
            if c <= low:
                continue
            angle = np.degrees(np.arctan2(abs(gy[y, x]), abs(gx[y, x])))
            if angle < 22.5:
                keep[y, x] = c > m[y + 1, x] and c >= m[y + 1, x + 2]
            elif angle > 67.5:
                keep[y, x] = c > m[y, x + 1] and c >= m[y + 2, x + 1]
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                keep[y, x] = c > m[y, x + 1 - s] and c > m[y + 2, x + 1 + s]
    todo = [(y, x) for y in range(h) for x in range(w) if keep[y, x] and m[y + 1, x + 1] > high]
    found = set(todo)
    while todo:
        y, x = todo.pop()
        for i, j in itertools.product((-1, 0, 1), repeat=2):
            q = (y + i, x + j)
            if q not in found and 0 <= q[0] < h and 0 <= q[1] < w and keep[q]:
                found.add(q)
                todo.append(q)
    return found


def test_edges(spark):
    v = np.random.default_rng(12).integers(0, 120, (16, 14)).astype(float)
    v[:, 6:] += 100
    assert {(r.y, r.x) for r in pixels.edges(image(spark, v, "value"), 150.0, 420.0).collect()} == edges_by_loops(v, 150.0, 420.0)


def test_tracks_fall_back_to_thirds(spark):
    size = spark.createDataFrame([("i", 65, 10)], "image_id string, width int, height int")
    none = spark.createDataFrame([], "image_id string, y int, x int")
    assert [(r.left_px, r.right_px) for r in pixels.tracks(none, size).orderBy("left_px").collect()] == [(0, 21), (21, 42), (42, 63)]


def test_pixel_rules_at_their_borders(spark):
    hue = lambda h, n=400: spark.createDataFrame([("i", y, x, h, 200, 200) for y in range(20) for x in range(n // 20)], "image_id string, y int, x int, h int, s int, v int")
    got = {h: pixels.dominant_hue(hue(h)).first().colour for h in (5, 15, 35, 45, 85, 95, 135, 145, 165, 175)}
    assert got == {5: "red", 15: None, 35: None, 45: "green", 85: "green", 95: "blue", 135: "blue", 145: None, 165: None, 175: "red"}
    white = image(spark, np.full((30, 20), 255), "value")
    assert tuple(pixels.content_bounds(white).first()) == ("i", 0, 30)
    a = np.full((60, 100), 255)
    a[20:40, :3] = 0  # exactly 3 % is not over it
    assert tuple(pixels.content_bounds(image(spark, a, "value")).first()) == ("i", 0, 60)
    a[20:40, :4] = 0
    assert tuple(pixels.content_bounds(image(spark, a, "value")).first()) == ("i", 12, 48)
    full = image(spark, np.ones((50, 5), dtype=bool), on=True)
    assert pixels.without_spines(full, pixels.sizes_of(full)).count() == 0
    low = image(spark, np.ones((39, 5), dtype=bool), on=True)
    assert pixels.without_spines(low, pixels.sizes_of(low)).count() == 39 * 5


def test_tall_images_are_scaled_for_recognition(spark):
    a = np.repeat(np.arange(40.0)[:, None], 10, axis=1)
    p = image(spark, a, "value")
    got = pixels.ocr_scaled(p, pixels.sizes_of(p), 20)
    assert {(r.y, r.x) for r in got.collect()} == set(itertools.product(range(20), range(5)))
    assert pixels.ocr_scaled(p, pixels.sizes_of(p), 40).count() == 400


def test_hints_by_lone_letters(spark):
    from strataspark.operators import pairing

    names = ["run_i_2", "abc_t_1", "it", "x dgc", "NGC-1", "ilz", "plain", "9i9"]
    got = {r.n: r.c for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", pairing.hinted_curves(F.col("n")).alias("c")).collect()}
    assert got == {"run_i_2": ["RILD"], "abc_t_1": ["TEMP"], "it": None, "x dgc": ["BD", "CAL", "GR"], "NGC-1": ["CAL", "DPHI", "GR"], "ilz": ["RILD"], "plain": None, "9i9": ["RILD"]}


def test_window_examples_against_numpy(spark, sf):
    """Every window of some pairs: scores, depths and traces by NumPy."""
    from strataspark.plans.pairing_queries import windows_of

    got = {(r.pair_id, int(r.roi_image_path[-9:-4])): r for r in QUERIES["pair_examples"](spark, sf).collect()}
    panel, trace, measured = (d.where("pair_id in ('p1', 'p2', 'p7')").toPandas() for d in windows_of(spark, sf))
    seen = 0
    for pid, pn in panel.groupby("pair_id"):
        n = int(pn["rows"].iloc[0])
        m = measured[measured.pair_id == pid].sort_values("at")
        for start, t in trace[trace.pair_id == pid].groupby("start_row"):
            end = min(n, start + 256)
            x = t.sort_values("row")["x"].to_numpy(float)[: end - start]
            a, b = (100 + r / (n - 1) * (n - 1) * 0.5 for r in (start, end - 1))
            v = np.interp(np.linspace(a, b, len(x)), m["at"], m["value"])
            ok = np.isfinite(x)
            u, w = x[ok], v[ok]
            (p, q), (c, d) = np.percentile(u, [2, 98]), np.percentile(w, [2, 98])
            r = abs(np.corrcoef(np.clip((u - p) / (q - p), 0, 1), np.clip((w - c) / (d - c), 0, 1))[0, 1])
            score = r * max(0.25, ok.mean()) * max(0.25, min(1, (q - p) / 59 / 0.25))
            fits = end - start >= 128 and ok.mean() >= 0.7 and score >= 0.08 and ok.sum() >= 100
            assert ((pid, int(start)) in got) == fits
            if fits:
                e = got[pid, int(start)]
                assert (e.depth_start, e.depth_end, e.window_match_score) == pytest.approx((a, b, score), abs=2e-6)
                assert e.trace == [-999.25 if np.isnan(z) else z for z in x]
                seen += 1
    assert seen > 3


def test_metrics_count_every_target(spark):
    from strataspark.operators import evaluation

    target = spark.createDataFrame([("i", y, 5.0) for y in range(10)], "image_id string, row_idx int, t double")
    pred = spark.createDataFrame([("m", "i", 0, 6.0, 2.0), ("m", "i", 1, None, 0.1), ("none", "i", 3, None, 1.0)], "method string, image_id string, row_idx int, x double, conf double")
    got = {r.method: r for r in evaluation.trace_metrics(pred, target, 10).collect()}
    assert (got["m"].samples, got["m"].target_rows, got["m"].coverage, got["m"].mae_px, got["m"].hit_1, got["m"].mean_conf) == (1, 10, 0.1, 1.0, 1.0, 1.0)
    assert (got["none"].target_rows, got["none"].coverage, got["none"].mae_px, got["none"].mean_conf) == (10, 0.0, None, None)


def test_learning_rules_at_their_borders(spark):
    from strataspark.operators import learning

    now = "2024-02-01 00:00:00"
    fresh, old = "2024-01-20 00:00:00", "2024-01-01 23:00:00"  # the second is over 30 days old, by an hour
    p = ({"max_step": 10.0, "mode": 1.0}, {"max_step": 20.0, "mode": 2.0})
    rows = [(i, "GR", fresh if i < 3 else old, *p, 1.0) for i in range(5)] + [(9, "SP", fresh, *p, 0.5), (10, "DT", fresh, {"mode": 1.0}, {"mode": 2.0}, 0.6), (11, "DT", old, {}, {}, 0.6), (12, "DT", old, {}, {}, 0.6)]
    a = spark.createDataFrame(rows, "id long, curve_type string, timestamp string, original_params map<string,double>, user_params map<string,double>, quality_score double").withColumn("timestamp", F.to_timestamp("timestamp"))
    got = {r.curve_type: r for r in learning.learned(a, F.to_timestamp(F.lit(now))).collect()}
    assert got["GR"].param == "max_step" and got["GR"].value == pytest.approx(100 + 10 * (1 - 12 / 30)) and got["GR"].confidence == pytest.approx(0.3) and got["GR"].sample_size == 5
    assert (got["SP"].param, got["SP"].confidence, got["SP"].sample_size) == (None, 0.0, 1)
    assert got["DT"].param is None and got["DT"].confidence == pytest.approx(0.3 * 0.6 * 0.5)


def test_countdown_without_an_end(spark):
    df = spark.createDataFrame([(None,), ("2024-01-01 00:00:00",), ("2024-01-03 05:30:00",)], "e string").select(F.to_timestamp("e").alias("e"))
    got = [r.c for r in df.select(accounts.countdown(F.col("e"), F.to_timestamp(F.lit("2024-01-02 00:00:00"))).alias("c")).collect()]
    assert got[0] is None and tuple(got[1]) == (0, 0, True) and tuple(got[2]) == (1, 5, False)


def test_subscriptions_find_their_user(spark):
    users = spark.createDataFrame([(1, "s1", "c1"), (2, None, "c2")], "id long, subscription_id string, customer_id string")
    events = spark.createDataFrame([(None, "s1", None, "updated"), (None, "s9", "c2", "updated"), (None, "s9", "c2", "deleted"), (None, "s9", None, "updated"), (7, None, None, "updated")], "user_id long, subscription_id string, customer_id string, event_type string")
    assert sorted(r.user_id for r in accounts.owned(events, users).collect()) == [1, 2, 7]


def test_label_rows_of_one_column_and_gaps(spark):
    from strataspark.operators import training

    t = spark.createDataFrame([("a", [0.0, 4.0, -999.25, None], 5, -999.25), ("b", [0.0], 1, -999.25)], "key string, trace array<double>, width int, null_value double")
    got = {(r.key, r.row): (r.valid, r.centre, max(r.target)) for r in training.label_rows(t, 9, 4).collect()}
    assert got["a", 0] == (True, 0.0, 1.0) and got["a", 1] == (True, 1.0, 1.0) and not got["a", 2][0] and not got["a", 3][0] and got["a", 3][2] == 0.0
    assert got["b", 3] == (True, 0.0, 1.0)


def test_export_summary_and_examples(spark, tmp_path):
    rows = spark.createDataFrame([("s", "p", "ok", None, 2, [("a.tif", "no_panel_match")])], "source string, pair_id string, status string, reason string, example_count long, skipped_scans array<struct<scan:string,reason:string>>")
    records.write_summary(rows, str(tmp_path / "summary"), " gr", ("s",))
    got = json.loads(next((tmp_path / "summary").glob("part-*.json")).read_text())
    assert (got["curve"], got["pair_count"], got["example_count"], got["processed"][0]["skipped_scans"][0]["scan"]) == ("GR", 1, 2, "a.tif")
    records.write_examples(QUERIES["pair_examples"](spark, "/root/testdata/sf0.001").limit(3), str(tmp_path / "examples"))
    assert all(json.loads(x)["schema"] == "log_pair_bootstrap_v1" for f in (tmp_path / "examples").glob("part-*.json") for x in f.read_text().splitlines())


def test_scan_examples_tell_why_scans_have_none(spark):
    from strataspark.plans.pairing_queries import strokes

    pixels_, scans, measured = strokes(spark, "/root/testdata/sf0.001")
    pixels_ = pixels_.where("y < 300")
    e, why = pairing.scan_examples(pixels_, scans, measured.where("at < 250"), "gr", F.to_timestamp(F.lit("2024-02-01 00:00:00")), 256, 200, score_rows=300)
    assert {r.scan: r.reason for r in why.collect()} == {"p0.tif": None, "p0_t.tif": "curve_hint_excludes_target", "p0_x.tif": "image_read_failed"}
    got = e.orderBy("depth_start").collect()
    assert [(r.panel_index, r.panel_left_px, r.panel_right_px, len(r.trace), r.depth_start) for r in got] == [(0, 0, 64, 256, 100.0), (0, 0, 64, 256, 122.0)]
    assert got[0].panel_match_score > 0.5
    places = {r.y: r.x for r in pixels_.where("image_id = 'p0/' and b = 30").collect()}
    assert got[1].trace == [places[y] for y in range(44, 300)]
    assert pairing.scan_examples(pixels_.limit(0), scans, measured, "gr", F.current_timestamp(), 256, 200)[0].isEmpty()


def test_pair_folders(spark, tmp_path):
    for name in ("Wvgs/pairs/p1/b.las", "Wvgs/pairs/p1/a.LAS", "Wvgs/pairs/p1/y.tif", "Wvgs/pairs/p1/x.TIFF", "Wvgs/pairs/p1/z.png", "Wvgs/pairs/p2/k.tif", "kgs/pairs/p3/c.las", "kgs/other/p4/c.las"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rows = lambda **how: sorted((tuple(r) for r in records.pair_folders(spark, str(tmp_path), **how).collect()), key=repr)
    first, second, third = [("wvgs", "p1", "a.LAS", "x.TIFF"), ("wvgs", "p1", "a.LAS", "y.tif")], [("wvgs", "p2", None, "k.tif")], [("kgs", "p3", "c.las", None)]
    assert rows() == third + first + second
    assert rows(sources=["WVGS"], max_scans=1) == first[:1] + second
    assert rows(max_pairs=2) == third + first


def test_captures_prefer_their_logs(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text('[{"k": 1}, {"k": 2}]')
    assert sorted(r.k for r in records.captures(spark, str(tmp_path), "k int").collect()) == [1, 2]
    (tmp_path / "a/captures.jsonl").write_text('{"k": 5}\nbad\n')
    assert [r.k for r in records.captures(spark, str(tmp_path), "k int").collect()] == [5]


def test_logs_are_written_beside_what_exists(spark, tmp_path):
    rows = spark.createDataFrame([("2025-12-14", '{"k": 1}'), ("2025-12-15", '{"k": 2}'), ("2025-12-15", "bad")], "day string, value string").coalesce(1)
    for _ in range(2):
        records.write_logs(rows, str(tmp_path), "captures.jsonl")
    assert sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*.jsonl")) == [f"2025-12-{d}/0000{n}/captures.jsonl" for d in (14, 15) for n in (0, 1)]
    assert not list(tmp_path.glob("_*"))
    assert sorted(r.k for r in records.captures(spark, str(tmp_path), "k int").collect()) == [1, 1, 2, 2]
    records.write_logs(rows.limit(0), str(tmp_path / "none"), "captures.jsonl")
    assert not list((tmp_path / "none").rglob("*.jsonl"))


def test_json_documents(spark, tmp_path):
    for name, text in {"a.json": '[{"k": 1}, {"k": 2}]', "b.json": '{"data": [{"k": 3}]}', "c.json": '{"k": 4}', "d.json": '{"k": 5}\n{"k": 6}'}.items():
        (tmp_path / name).write_text(text)
    assert sorted(r.k for r in records.json_documents(spark, str(tmp_path), "k int").collect() if r.k is not None) == [1, 2, 3, 4, 5, 6]


def test_json_lines_skip_bad_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"k": 1}\nnot json\n{"k": 2}\n')
    assert sorted(r.k for r in records.json_lines(spark, str(tmp_path), "k int").collect()) == [1, 2]


def events(tmp_path):
    day = tmp_path / "corrections/2025-12-14"
    day.mkdir(parents=True)
    rows = [{"event_id": f"e{i % 3}", "ts_utc": f"2025-12-14T0{i}:00:00Z", "mode": " Red", "image_path": "c.png", "track": {"leftX": 1.0, "rightX": 5.0}, "after": {"x": 2.0 + i, "y": 90.0}} for i in range(3)]
    rows.append({"event_id": "bad", "ts_utc": "2025-12-14T03:00:00Z", "track": {"leftX": 5.0, "rightX": 1.0}, "after": {"x": 1.0, "y": 1.0}})
    (day / "corrections.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path / "corrections")


def test_correction_stream_equals_batch(spark, tmp_path):
    root = events(tmp_path)
    from strataspark.operators.training import corrections

    q = feeds.correction_stream(spark, root).writeStream.format("memory").queryName("corr").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.event_id, r.mode) for r in corrections(records.corrections(spark, root)).collect()}
    assert {(r.event_id, r.mode) for r in spark.table("corr").collect()} == want == {("e0", "red"), ("e1", "red"), ("e2", "red")}


def test_adjustment_table(spark, tmp_path):
    path = str(tmp_path / "adj")
    rows = spark.createDataFrame([("GR", {"a": 1.0}, {"a": 2.0}, "s"), ("xx", {"a": 1.0}, {"a": 2.0}, "s"), ("GR", None, {"a": 2.0}, "s")], "curve_type string, original_params map<string,double>, user_params map<string,double>, session_id string")
    records.append_adjustments(rows, path)
    assert sorted(r.curve_type for r in spark.read.parquet(path).collect()) == ["GR", "OTHER"]
    assert records.clear_adjustments(spark, path, "GR") == 1
    assert [r.curve_type for r in spark.read.parquet(path).collect()] == ["OTHER"]


def test_holdout_share(spark):
    import hashlib

    keys = ["a", "b/c", "é"]
    got = {r.k: r.s for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", C.holdout_share(F.col("k")).alias("s")).collect()}
    assert got == {k: int(hashlib.sha1(k.encode()).hexdigest()[:8], 16) % 10000 / 100 for k in keys}
