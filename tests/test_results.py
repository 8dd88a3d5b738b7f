"""Views of results, line zones, traps, outlines, colour functions and composed rasters."""

import math

import numpy as np
from pyspark.sql import functions as F

from platewright.operators import geometry, plates, raster, results


def grid(spark, text):
    return spark.createDataFrame([(1, x, y, int(c)) for y, line in enumerate(text.split()) for x, c in enumerate(line)], "page int, x int, y int, label int")


def checkpoints(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))


def test_source_kinds(spark):
    base = {"suffix": ".jpg", "format": "JPEG", "width": 1000, "height": 700, "dpi": 72, "camera": False, "software": "", "quality": 80.0, "framed": False, "lit": False, "perspective": False}
    cases = [({}, "export"), ({"width": 1280}, "chat"), ({"width": 1280, "quality": 90.0}, "export"), ({"width": 1280, "quality": None}, "chat"), ({"width": 1920, "height": 1080}, "capture"), ({"framed": True, "camera": True}, "capture"), ({"camera": True, "dpi": 300}, "photo"), ({"dpi": 300}, "scan"), ({"software": "EPSON Scan"}, "scan"), ({"format": None, "camera": True}, "export")]
    rows = [tuple({**base, **c}.values()) for c, _ in cases]
    df = spark.createDataFrame(rows, "suffix string, format string, width int, height int, dpi int, camera boolean, software string, quality double, framed boolean, lit boolean, perspective boolean")
    assert [r.source_kind for r in results.source_kind(df).collect()] == [k for _, k in cases]
    art = spark.createDataFrame([(0, 0, 0, False), (2, 0, 1, True)], "images int, shadings int, patterns int, transparency boolean")
    assert [(r.flat, r.reasons) for r in results.flat_art(art).collect()] == [(True, []), (False, ["images", "patterns", "transparency"])]


def test_views(spark):
    i = spark.createDataFrame([(1, "text", False, None), (1, "text", True, None), (1, "color", False, "fixed"), (2, "font", False, "not_applicable")], "page int, cat string, ignored boolean, status string")
    assert results.visible(i, ["text"]).count() == 1 and results.visible(i, ["text"], True).count() == 2
    assert {tuple(r) for r in results.category_counts(i).collect()} == {("text", 2, 1), ("color", 1, 1), ("font", 1, 1)}
    assert {tuple(r) for r in results.checklist(i).collect()} == {(1, 1, 1, 0, False), (2, 0, 0, 1, True)}
    f = spark.createDataFrame([(1, (1, 1, 2, 2)), (1, None), (2, (1, 1, 2, 2))], "page int, box struct<x:int,y:int,w:int,h:int>")
    assert results.on_page(f, 1).count() == 1
    inks = spark.createDataFrame([("a", 0.0, 1), ("w", 1.0, 2), ("b", 0.0, 3)], "ink string, opacity double, pos int")
    assert [r.ink for r in results.opaque_first(inks).collect()] == ["w", "a", "b"]
    c = spark.createDataFrame([(1, "text", 3, 1, 0), (2, "text", 1, 0, 1)], "page int, cat string, tp int, fp int, fn int")
    assert {r.type: (r.precision, r.recall) for r in results.by_type(c, spark.createDataFrame([(1, "photo"), (2, "chat")], "page int, type string")).collect()} == {"photo": (75.0, 100.0), "chat": (100.0, 50.0)}
    s = results.symbol_rows(spark.createDataFrame([(1, " EAN13 ", "400638133393", None), (2, "nope", "1", "x")], "pos int, type string, data string, name string")).orderBy("pos").collect()
    assert [(r.name, r.code, r.problem) for r in s] == [("code_1", "4006381333931", None), ("x", None, "unknown symbology")]


def test_line_zones(spark):
    lines = spark.createDataFrame([(1, 1, 100.0, 100.0, 100.0, 20.0), (1, 2, 210.0, 102.0, 50.0, 20.0), (1, 3, 100.0, 300.0, 100.0, 20.0)], "page int, line int, x double, y double, w double, h double")
    z = {r.line: (r.x0, r.x1) for r in results.line_margins(lines).collect()}
    assert z[3] == (65.0, 235.0) and z[1] == (65.0, 206.0) and z[2] == (210 - 6.0, 260 + 17.5)


def test_trap_strokes(spark):
    edges = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 1, 0), (1, 3, 1, 2), (1, 4, 2, 2), (1, 5, -1, 1)], "page int, chain int, a int, b int")
    d = plates.trap_decisions(spark.createDataFrame([(1, 0, 90.0, "spot", 0.0), (1, 1, 30.0, "spot", 0.0), (1, 2, 33.0, "spot", 0.0)], "page int, id int, lightness double, kind string, opacity double"))
    s = results.trap_strokes(edges, d, 0.2)
    assert {tuple(r) for r in results.trap_summary(s).collect()} == {(1, 0, 1, "R4", 2, 0.46), (1, 1, 2, "R5", 1, 0.23), (1, 2, 1, "R5", 1, 0.23)}
    assert results.trap_strokes(edges, d, 0.0).count() == 0 and results.trap_strokes(edges, d, 0.2, spark.createDataFrame([(1, 0)], "page int, label int")).count() == 2


def test_outlines(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    arc = one(geometry.arc_cubics(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(0.3), F.lit(4.0)))
    assert len(arc) == 3
    for p in arc:
        for t in np.linspace(0, 1, 9):
            x, y = (sum(w * p[f"{c}{j}"] for j, w in enumerate(((1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3))) for c in "xy")
            assert abs(math.hypot(x - 1, y - 2) - 3) < 2e-3
    assert abs(arc[-1].x3 - (1 + 3 * math.cos(4.3))) < 1e-9
    segments = F.array(*(F.struct(F.lit(k).alias("kind"), *(F.lit(float(v)).alias(c) for v, c in zip(p, ("x0", "y0", "x1", "y1"), strict=True))) for k, p in (("L", (0, 0, 0, 0)), ("L", (0, 0, 1, 1)), ("C", (1, 1, 1, 1)))))
    assert [s.kind for s in one(geometry.without_empty_segments(segments))] == ["L", "C"]
    pts = spark.createDataFrame([(1, i, 5 + 2 * math.cos(i), -3 + 2 * math.sin(i)) for i in range(9)] + [(2, i, float(i), float(i)) for i in range(4)], "chain int, pos int, x double, y double")
    got = {r.chain: r for r in geometry.fitted_circles(pts).collect()}
    assert np.allclose([got[1].cx, got[1].cy, got[1].r, got[1].error], [5, -3, 2, 0], atol=1e-8) and got[2].r is None
    t = [r.t for r in geometry.chord_parameters(pts.where("chain = 2")).orderBy("pos").collect()]
    assert np.allclose(t, [0, 1 / 3, 2 / 3, 1])
    assert one(geometry.calculated(F.lit(3.0), F.array(*map(F.lit, "dup 2 exch sub abs".split())))) == [3.0, 1.0]


def test_composed_pixels_follow_the_order_of_printing(spark):
    p = spark.createDataFrame([(1, 0, 0, "white", 255), (1, 0, 0, "cyan", 255), (1, 1, 0, "cyan", 0)], "page int, x int, y int, ink string, cov int")
    inks = spark.createDataFrame([("cyan", 55.0, -37.0, -50.0, 0.0, 1), ("white", 94.0, 0.0, -2.0, 1.0, 9)], "ink string, L double, a double, b double, opacity double, rank int")
    got = {r.x: (r.L, r.a, r.b) for r in raster.composed(p, inks, (40.0, 10.0, 10.0)).collect()}
    assert np.allclose(got[1], (40, 10, 10), atol=1e-6) and abs(got[0][0] - 55) < 1.5  # opaque white below, though it has the later rank
    flat = raster.textured(p.select("page", "x", "y"), 0.05).select("factor")
    assert flat.collect() == raster.textured(p.select("page", "x", "y"), 0.05).select("factor").collect() and all(0.85 <= r.factor <= 1.1 for r in flat.collect())


def test_traps_close_what_movement_opens(spark):
    rows = [(1, x, y, 1 if x < 6 else 2, 255) for x in range(12) for y in range(12)]
    df = spark.createDataFrame(rows, "page int, x int, y int, ink int, cov int")
    assert plates.movement_check(df.drop("page"), 1.0, 1.0, 128).count() > 0
    d = plates.trap_decisions(spark.createDataFrame([(1, 1, 90.0, "spot", 0.0), (1, 2, 30.0, "spot", 0.0)], "page int, id int, lightness double, kind string, opacity double"))
    out = raster.trapped(df, d, 1, 1)
    assert {(r.x, r.ink) for r in out.collect()} == {(x, 1) for x in range(7)} | {(x, 2) for x in range(6, 12)}
    assert plates.movement_check(out.drop("page"), 1.0, 1.0, 128).count() == 0
    white = spark.createDataFrame([(1, x, y, "w", 255) for x in range(5) for y in range(5)] + [(1, 0, 0, "c", 9)], "page int, x int, y int, ink string, cov int")
    left = raster.choked(white, "w", 1, 1)
    assert {(r.x, r.y) for r in left.where("ink = 'w'").collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} and left.where("ink = 'c'").count() == 1


def test_masks_and_boxes(spark):
    checkpoints(spark)
    gaps = spark.createDataFrame([(1, 10, 10), (1, 14, 10), (1, 60, 60)], "page int, x int, y int")
    assert [(r.x, r.y, r.w, r.h, round(r.mm2, 6)) for r in raster.gap_boxes(gaps, 254.0).orderBy("y").collect()] == [(6, 6, 13, 9, 0.02), (56, 56, 9, 9, 0.01)]
    spans = spark.createDataFrame([(1, 0, 0, 3, 2, 5.0), (1, 9, 9, 3, 2, 8.0)], "page int, x int, y int, w int, h int, pt double")
    assert raster.text_mask(spans, 6.0).count() == 6
    p = spark.createDataFrame([(1, "c", x, y, 255) for x in range(4) for y in range(4)], "page int, ink string, x int, y int, cov int")
    r = raster.probed(p, 0, 0, 1, 100, 100).first()
    assert (r.inks, r.total, r.outside) == ({"c": 100.0}, 100.0, False) and raster.probed(p, 500, 500, 1, 100, 100).first().outside
    cells = spark.createDataFrame([(1, 0, 0, 20.0, 0.0, 1.0, 1.0), (1, 1, 1, 16.0, 0.0, 1.0, 1.0), (1, 5, 5, 15.0, 0.0, 1.0, 1.0), (1, 9, 9, 25.0, 0.0, 1.0, 1.0), (1, 7, 7, 90.0, 0.5, 1.0, 1.0)], "page int, x int, y int, de double, text double, spread double, valid double")
    assert {(r.x, r.y, r.w, r.h, r.de, r.n) for r in raster.colour_cells(cells, 10.0).collect()} == {(0, 0, 2, 2, 18.0, 2), (9, 9, 1, 1, 25.0, 1)}
    h = spark.createDataFrame([(1, x, y, x) for x in range(8) for y in range(8)], "page int, cx int, cy int, value int")
    assert bin(raster.mean_hash(h).first().hash & (2**64 - 1)).count("1") == 32


def test_labels_of_outlines(spark):
    checkpoints(spark)
    s = raster.symmetrized(grid(spark, "0000000 0110110 0111110 0111010 0111110"), 0, 0.8)
    assert {(r.x, r.y) for r in s.where("label = 1").collect()} == {(1, 1), (2, 1), (4, 1), (5, 1), *((x, 2) for x in range(1, 6)), *((x, 3) for x in range(1, 6)), *((x, 4) for x in range(1, 6))}
    t = raster.thickened(grid(spark, "000000 011110 000000 222222"), 2, 0)
    assert {(r.x, r.y) for r in t.where("label = 1").collect()} >= {(x, y) for x in range(1, 5) for y in (0, 1, 2)} and t.count() == 24
    px = spark.createDataFrame([(1, x, y, 50.0 if x < 3 else 90.0, 0.0, 0.0) for x in range(6) for y in range(3)] + [(1, 6, 0, 52.0, 0.0, 0.0)], "page int, x int, y int, L double, a double, b double")
    pal = spark.createDataFrame([(1, 4, 50.0, 0.0, 0.0), (1, 7, 90.0, 0.0, 0.0)], "page int, i int, L double, a double, b double")
    assert {(r.label, r["count"]) for r in raster.separated_flat(px, pal, 2).groupBy("label").count().collect()} == {(0, 9), (1, 10)}


def test_similarity_and_colours(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (12, 12))
    frame = lambda m: spark.createDataFrame([(1, x, y, int(m[y, x])) for y in range(len(m)) for x in range(m.shape[1])], "page int, x int, y int, value int")
    same = raster.structural_similarity(frame(a), frame(a)).first().similarity
    noise = raster.structural_similarity(frame(a), frame(rng.integers(0, 256, (12, 12)))).first().similarity
    assert abs(same - 1) < 1e-9 and noise < 0.3 and raster.structural_similarity(frame(a), frame(a[:8])).first().similarity == 0.0
    spans = spark.createDataFrame([(1, 1, 24.0, 255, 0, 0, 0, 0, 255), (1, 2, 24.0, 100, 100, 100, 104, 104, 104), (1, 3, 4.0, 100, 100, 100, 140, 140, 140)], "page int, id int, pt double, cr int, cg int, cb int, dr int, dg int, db int")
    assert [(r.id, r.severity) for r in raster.text_colours(spans, 10.0).collect()] == [(1, "high")]
