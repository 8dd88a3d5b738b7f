"""Inks, colours, codes, braille, presses, sheets: cases written out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewright.functions import braille, codes, colour, names, press, units
from platewright.operators import inventory, layout


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names_and_kinds(spark):
    raw = ["Pantone 485C", "PANTONE 485 C", "pms485c", "P 485 C", "  Pantone®  485  C ", "Blanco", "Die-cut", "lackierung", "Black", "k", "Rosa", "Glass black"]
    rows = spark.createDataFrame([(r,) for r in raw], "n string").select("n", names.normalized(F.col("n")).alias("k"), names.kind_of(F.col("n")).alias("kind")).collect()
    assert {r.k for r in rows[:5]} == {"PANTONE 485 C"}
    assert [r.kind for r in rows[5:]] == ["white", "technical", "varnish", "process", "process", "spot", "spot"]
    r = one(spark, names.safe_name(F.lit(" ../a<b>ñ.csv. ")).alias("s"), names.safe_name(F.lit("???")).alias("n"), names.version_key(F.lit("gs9.56.1")).alias("v"), names.variant_map(F.lit("A"), F.array(F.lit("a"), F.lit("A"))).alias("m"), names.translated(F.lit("x: file not found"), [("not found", "no file"), ("x", "other")]).alias("t"), names.rewritten(F.lit("a b"), [("a", "b"), ("b", "c")]).alias("w"))
    assert (r.s, r.n, r.v, r.m, r.t, r.w) == ("ab" + "ñ.csv", None, [9, 56, 1], {"a": "A"}, "no file", "c c")


def lab_of(x):
    f = [v ** (1 / 3) if v > 216 / 24389 else (24389 / 27 * v + 16) / 116 for v in np.array(x) / np.array(colour.WHITE)]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lin_of(lab):
    fy = (lab[0] + 16) / 116
    f = [fy + lab[1] / 500, fy, fy - lab[2] / 200]
    x = [v**3 if v**3 > 216 / 24389 else (116 * v - 16) * 27 / 24389 for v in f]
    return np.clip(np.linalg.inv(np.array(colour.WIDE_XYZ)) @ (np.array(x) * colour.WHITE), 1e-4, 1.5)


def mixed(substrate, inks, n=1.7):
    cur, paper = lin_of(substrate) ** (1 / n), lin_of(colour.PAPER) ** (1 / n)
    for lab, o, t in inks:
        solid = lin_of(lab) ** (1 / n)
        clear = cur * (1 - t * (1 - np.clip(solid / paper, 0, 1.5)))
        cover = t * o * solid + (1 - t * o) * cur
        cur = clear if o <= 0 else cover if o >= 0.999 else (1 - o) * clear + o * cover
    return lab_of(np.array(colour.WIDE_XYZ) @ cur**n)


@pytest.mark.parametrize("inks", [[], [((55, -37, -50), 0.0, 1.0)], [((55, -37, -50), 0.0, 0.4), ((48, 74, -3), 0.0, 0.7)], [((94, 0, -2), 1.0, 0.8), ((16, 0, 0), 0.0, 0.5)], [((70, 10, 60), 0.6, 0.5), ((48, 74, -3), 0.0, 0.3)]])
def test_mixture(spark, inks):
    rows = [[float(x) for x in lab] + [o, t] for lab, o, t in inks]
    df = spark.createDataFrame([([tuple(r) for r in rows],)], "inks array<struct<L:double,a:double,b:double,opacity:double,cov:double>>")
    for substrate in (colour.PAPER, (50.0, 20.0, 10.0)):
        r = colour.with_mixture(df, "inks", substrate).first()
        assert np.allclose([r.mL, r.ma, r.mb_], mixed(substrate, inks), atol=1e-6)
    if len(inks) == 1:  # a solid on paper is its own colour
        assert np.allclose([r.mL for r in colour.with_mixture(df, "inks").collect()], [55], atol=0.05)


def test_colours_and_back(spark):
    df = spark.createDataFrame([(255, 0, 0), (255, 255, 255), (0, 0, 0), (12, 200, 77)], "r int, g int, b int")
    back = colour.with_hex_of_lab(colour.with_lab(df), ("L", "a", "b_"))
    assert [r.hex for r in back.collect()] == ["#FF0000", "#FFFFFF", "#000000", "#0CC84D"]
    red = colour.with_lab(df).first()
    assert abs(red.L - 54.29) < 0.1 and abs(red.a - 80.81) < 0.2 and abs(red.b_ - 69.89) < 0.3
    d65 = colour.with_lab_d65(df, "r", "g", "b").first()
    assert abs(d65.L - 53.24) < 0.05 and abs(d65.a - 80.09) < 0.05
    lab = spark.createDataFrame([(50.0, 2.5, 0.0, 50.0, 0.0, -2.5)], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    full, half = (colour.with_delta_e2000(lab, ("l1", "a1", "b1"), ("l2", "a2", "b2"), weights=w).first().de for w in ((1.0, 1.0, 1.0), (1.0, 1.0, 2.0)))
    assert abs(full - 4.3065) < 1e-4 and half < full
    papers = spark.createDataFrame([(94.0, 1.0, -1.0), (60.0, 0.0, 0.0)], "L double, a double, b double")
    assert [r.paper for r in colour.with_paper_flag(papers, ("L", "a", "b")).collect()] == [True, False]
    r = one(spark, colour.luminance_density(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("w"), colour.luminance_density(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("k"), colour.red_contrast(F.lit(0.0), F.lit(1.0)).alias("c"), colour.swatch(F.lit(None).cast("string"), F.array(*map(F.lit, (0.0, 1.0, 1.0, 0.0)))).alias("s"), colour.swatch(F.lit("#111111"), F.lit(None).cast("array<double>")).alias("l"))
    assert abs(r.w) < 1e-6 and abs(r.k - 4) < 1e-6 and r.c == 1 and (r.s, r.l) == ("#FF0000", "#111111")
    q = one(spark, colour.jpeg_quality(F.array(*([F.lit(57.625)] * 64))).alias("a"), colour.jpeg_quality(F.array(*([F.lit(5.7625)] * 64))).alias("b"), colour.jpeg_quality_of_mean(F.array(F.lit(57.6))).alias("c"), colour.jpeg_quality_of_mean(F.array().cast("array<double>")).alias("d"))
    assert (q.a, q.b, q.c, q.d) == (50.0, 95.0, 50.0, None)
    held = one(spark, F.array(*colour.limited([F.lit(100.0)] * 4, 300.0)).alias("v")).v
    assert abs(sum(held) - 300) < 1e-9 and held[3] == 100


@pytest.mark.parametrize(("kind", "data", "code", "problem"), [
    ("ean13", "400638133393", "4006381333931", None), ("ean13", "4006381333931", "4006381333931", None), ("ean13", "4006381333932", None, "wrong check digit"), ("ean13", "12", None, "wrong length"), ("ean8", "9638507", "96385074", None),
    ("upce", "0123456", "01234565", None), ("upce", "01234565", "01234565", None), ("upce", "9123456", None, "seven or eight digits, the first 0 or 1"), ("gs1_128", "(01)09501101530003(17)250100(10)AB12", "(01)09501101530003(17)250100(10)AB12", None),
    ("gs1_128", "(17)251301", "(17)251301", "no such date"), ("gs1_128", "(01)09501101530004", "(01)09501101530004", "wrong check digit"), ("gs1_128", "x(10)A", "x(10)A", "no identifiers"), ("gs1_128", "(99)1", "(99)1", "unknown identifier"), ("gs1_128", "(3102)001234", "(3102)001234", None),
    ("databar", "0950110153000", "(01)09501101530003", None), ("code39", "ab-1", "AB-1", None), ("code39", "ñ", "Ñ", "characters out of the set"), ("qr", " any ", "any", None), ("qr", "", None, "no data"), ("zz", "1", None, "unknown symbology")])
def test_code_texts(spark, kind, data, code, problem):
    r = one(spark, codes.normalized(F.lit(kind), F.lit(data)).alias("n")).n
    assert (r.code, r.problem) == (code, problem)


def test_symbol_geometry(spark):
    runs = spark.createDataFrame([(1, s, n, 0.33, 20.0) for s, n in ((2, 1), (4, 2), (8, 1))], "code int, start int, length int, x_mm double, height double")
    bars = codes.layout_bars(runs, 11, 7, 0.03).orderBy("x").collect()
    assert [round(b.x, 4) for b in bars] == [3.645, 4.305, 5.625] and [round(b.w, 4) for b in bars] == [0.3, 0.63, 0.3] and all(abs(b.width - 25 * 0.33) < 1e-9 for b in bars)
    assert codes.path_of(codes.layout_bars(runs, 11, 7)).first().path.startswith("M3.6300 0.0000h0.3300v20.0000h-0.3300z")
    modules = spark.createDataFrame([(1, i, i in (4, 9), 2.0) for i in range(15)] + [(2, 0, False, 1.0)], "code int, i int, dark boolean, x_px double")
    assert {(r.code, r.left, r.right) for r in codes.quiet_zones(modules).collect()} == {(1, 2.0, 2.5), (2, 0.0, 0.0)}


def test_braille(spark):
    df = spark.createDataFrame([(1, "Hola 12,5 ABC"), (2, "€"), (3, "aaaaaaaaaaaaaaaaaaaa"), (4, "ab cd ef")], "id int, text string")
    rows = {r.id: r for r in braille.laid_out(df, "text", 120.0).collect()}
    assert rows[1].lines == [["6", "125", "135", "123", "1", "", "3456", "1", "12", "2", "15", "", "6", "6", "1", "12", "14"]] and rows[1].unicode[:2] == "⠠⠓" and rows[2].problem == "character without a cell"
    narrow = {r.id: r for r in braille.laid_out(df, "text", 30.0).collect()}
    assert narrow[3].problem == "word too long" and narrow[4].lines == [["1", "12", "", "14", "145"], ["15", "124"]]
    assert (narrow[4].width_mm, narrow[4].height_mm) == (28.1, 16.6)
    dots = braille.dots(braille.laid_out(df.where("id = 4"), "text", 30.0)).orderBy("y", "x").collect()
    assert len(dots) == 13 and (dots[0].x, dots[0].y) == (0.8, 0.8)


def test_press_and_units(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    r = one(spark, press.tolerance_ok(a(0.2, 0.3)).alias("ok"), press.tolerance_ok(a(6.0)).alias("no"), press.tolerance_ok(a(1.0, 1.0, 1.0)).alias("many"), press.trap_xy(a(0.2, 0.4), F.lit(1.5)).alias("t"), press.choke_mm(a(0.2, 0.4), F.lit(None).cast("double")).alias("c"), press.choke_mm(a(0.2), F.lit(0.1)).alias("own"), press.tolerance_xy(a(0.2)).alias("xy"))
    assert (r.ok, r.no, r.many, r.c, r.own, r.xy.x, r.xy.y) == (True, False, False, 0.4, 0.1, 0.2, 0.2) and (round(r.t.x, 6), round(r.t.y, 6)) == (0.3, 0.6)
    u = one(spark, units.pt_to_mm(units.mm_to_pt(F.lit(7.5))).alias("a"), units.px_to_mm(units.mm_to_px(F.lit(10.0), F.lit(300.0)), F.lit(300.0)).alias("b"), units.px_to_pt(units.pt_to_px(F.lit(9.0), F.lit(150.0)), F.lit(150.0)).alias("c"), units.in_to_mm(units.mm_to_in(F.lit(5.0))).alias("d"), units.mm_per_px(F.lit(None).cast("double"), F.lit(100), F.lit(254.0)).alias("e"), units.mm_per_px(F.lit(50.0), F.lit(100), F.lit(254.0)).alias("f"), units.ppi_at_size(F.lit(100.0), F.lit(0.0)).alias("g"), units.scaled_dpi(F.lit(300.0), F.lit(0.5)).alias("h"))
    assert [round(v, 6) for v in u] == [7.5, 10.0, 9.0, 5.0, 0.1, 0.5, 0.0, 150.0]
    rect = lambda *v: F.struct(*(F.lit(float(x)).alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)))
    back = units.document_to_page(units.page_to_document(rect(5, 40, 15, 20), rect(10, 500, 600, 0), 1.0, 2.0), rect(10, 500, 600, 0), 1.0, 2.0)
    g = one(spark, back.alias("b"), units.bleed_mm(rect(10, 10, 90, 90), rect(0, 1.5, 100, 100)).alias("m"))
    assert tuple(g.b) == (5.0, 20.0, 15.0, 40.0) and {k: round(v, 3) for k, v in g.m.items()} == {"left": 3.528, "bottom": 2.999, "right": 3.528, "top": 3.528}


def test_sheets(spark):
    jobs = spark.createDataFrame([(1, 40.0, 30.0, 3, 2, 3.0, 3.0, 10.0, 10.0, [0, 90], [0], 0.0, 0.0, 300.0, 200.0, 10.0, 10.0), (2, 200.0, 30.0, 2, 1, 3.0, 3.0, 10.0, 10.0, [0], [0], 0.0, 0.0, 300.0, 200.0, 10.0, 10.0), (3, 40.0, 30.0, 0, 0, 3.0, 3.0, 10.0, 10.0, [0], [0], 0.0, 0.0, 300.0, 200.0, 10.0, 10.0)], "job int, trim_w double, trim_h double, cols int, rows int, gap_x double, gap_y double, left double, top double, row_turns array<int>, col_turns array<int>, row_shift double, col_shift double, sheet_w double, sheet_h double, right double, bottom double")
    placed = layout.cells(jobs)
    assert [(r.row, r.col, r.x, r.y, r.w, r.h, r.rot) for r in placed.where("job = 1").orderBy("row", "col").collect()] == [(0, 0, 10.0, 10.0, 40.0, 30.0, 0), (0, 1, 53.0, 10.0, 40.0, 30.0, 0), (0, 2, 96.0, 10.0, 40.0, 30.0, 0), (1, 0, 10.0, 43.0, 30.0, 40.0, 90), (1, 1, 43.0, 43.0, 30.0, 40.0, 90), (1, 2, 76.0, 43.0, 30.0, 40.0, 90)]
    assert {r.job: (r.cells, r.use_pct, r.problem) for r in layout.sheets(jobs, placed).collect()} == {1: (6, 12.0, None), 2: (2, 20.0, "larger than the sheet"), 3: (0, 0.0, "nothing fits")}
    assert layout.crop_marks(placed.where("job = 1 and row = 0 and col = 0")).count() == 8
    assert abs(one(spark, layout.distortion_pct(F.lit(1.14), F.lit(400.0)).alias("d")).d - 2 * math.pi * 1.14 / 400 * 100) < 1e-12 and one(spark, layout.distortion_pct(F.lit(1.0), F.lit(0.0)).alias("d")).d is None


def test_inventory_edits(spark):
    d = spark.createDataFrame([("f", "Pantone 1 C"), ("f", "PANTONE 1C"), ("f", "Unused"), ("f", "All"), ("f", "Cyan")], "file string, name string")
    used = spark.createDataFrame([("f", "Pantone 1 C", 1), ("f", "Pantone 1 C", 2), ("f", "PANTONE 1C", 2)], "file string, name string, page int")
    inks = inventory.inventory(d, used)
    assert {(r.ink, r.name, r.objects, tuple(r.pages), tuple(r.variants)) for r in inks.where("objects > 0").collect()} == {("PANTONE 1 C", "Pantone 1 C", 3, (1, 2), ("PANTONE 1C", "Pantone 1 C"))}
    assert {r.ink for r in inventory.unused(inks).collect()} == {"UNUSED", "ALL"} and inventory.duplicated(inks).count() == 1
    assert [(r.old, r.new) for r in inventory.rename_map(inks).collect()] == [("PANTONE 1C", "Pantone 1 C")]
    out, counts = inventory.renamed(d, inventory.rename_map(inks))
    assert sorted(r.name for r in out.collect()) == ["All", "Cyan", "Pantone 1 C", "Pantone 1 C", "Unused"] and counts.first().changed == 1
    live = used.select("file", names.normalized(F.col("name")).alias("ink"))
    assert sorted(r.name for r in inventory.without_unused(d, live).collect()) == ["All", "Cyan", "PANTONE 1C", "Pantone 1 C"]
    objects = spark.createDataFrame([("f", 1, "pms 1c", 0.5), ("f", 2, "Gold", 1.0)], "file string, id int, name string, tint double")
    values = spark.createDataFrame([("Pantone 1 C", 0.0, 1.0, 0.8, 0.0)], "name string, c double, m double, y double, k double")
    defs, objs = inventory.edited(d, objects, convert=values, delete_unused=True)
    assert {r.id: (r.converted, r.m) for r in objs.collect()} == {1: (True, 0.5), 2: (False, None)} and sorted(r.name for r in defs.collect()) == ["All", "Cyan"]


def test_paints_fold(spark):
    ops = [("q", []), ("cs", ["Spot1"]), ("gs", ["OP=true"]), ("f", []), ("q", []), ("k", []), ("B", []), ("Q", []), ("Tj", []), ("Q", []), ("S", []), ("Q", []), ("f", [])]
    stream = spark.createDataFrame([("a", 1, i, op, args) for i, (op, args) in enumerate(ops)], "file string, page int, seq long, op string, args array<string>")
    got = [(r.what, r.space, r.overprint) for r in inventory.paints(stream).orderBy("seq", "what").collect()]
    assert got == [("fill", "Spot1", True), ("fill", "DeviceCMYK", True), ("stroke", "DeviceGray", True), ("text", "Spot1", True), ("stroke", "DeviceGray", False), ("fill", "DeviceGray", False)]
    named = inventory.ink_paints(inventory.paints(stream), spark.createDataFrame([("a", "Spot1", ["Barniz", "Cyan"])], "file string, space string, inks array<string>"))
    assert {(r.ink, r.kind) for r in named.collect()} == {("BARNIZ", "varnish"), ("CYAN", "process")} and named.count() == 4
    assert {(r.space, r.objects) for r in inventory.space_uses(inventory.paints(stream)).collect()} == {("Spot1", 2), ("DeviceCMYK", 1), ("DeviceGray", 3)}


def test_document_items(spark):
    items = spark.createDataFrame([("d", 1, "Barniz", None, False, False), ("d", 2, None, "BARNIZ", False, False), ("d", 3, "Rojo", "Rojo", False, True)], "file string, id int, fill_spot string, stroke_spot string, fill_over boolean, stroke_over boolean")
    out, counts = inventory.overprinted(items, ["barniz"])
    assert {r.id: (r.fill_over, r.stroke_over) for r in out.collect()} == {1: (True, False), 2: (False, True), 3: (False, True)} and counts.first().objects == 2
    assert inventory.overprinted(items, ["barniz"], dry=True)[0] is items
    merged, changes = inventory.spots_merged(items, spark.createDataFrame([("rojo", "Red")], "old string, new string"))
    assert changes.first().objects == 2 and {r.fill_spot for r in merged.collect()} == {"Barniz", None, "Red"}
    hits = spark.createDataFrame([("d", i, i % 2 == 0, i == 2, False) for i in range(6)], "file string, seq int, hits boolean, locked boolean, hidden boolean")
    assert tuple(inventory.selected(hits, 5).first()) == ("d", 2, 5, True)
    plates = lambda c: spark.createDataFrame([("Cyan", x, 0, 100 + c * x) for x in range(4)] + [("Rojo", 0, 0, 9 * c)], "ink string, x int, y int, cov int")
    assert [(r.ink, r.percent) for r in inventory.plate_changes(plates(0), plates(2), ["rojo"]).collect()] == [("Cyan", round(3 / 255 * 100, 4))]
