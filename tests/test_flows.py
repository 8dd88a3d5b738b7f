"""Rules, recipes, history, readers, writers, watched folders, rasters and fits."""

import datetime as dt
import json
import struct

import pytest
from pyspark.sql import functions as F

from platewright.operators import fitting, plates, preflight, raster
from platewright.plans import history, recipes
from platewright.sinks import exports
from platewright.sources import landing
from platewright.streaming import watch

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def facts(spark):
    f = lambda rows, schema: spark.createDataFrame([("a.pdf", "p", *r) for r in rows], f"file string, profile string, {schema}")
    return {
        "fonts": f([(1, 7, "Arial", "TrueType", False), (2, 7, "Arial", "TrueType", False), (1, 8, "T3", "Type3", False)], "page int, xref int, name string, type string, embedded boolean"),
        "images": f([(1, 5, 100.0, 100.0, 0.0, 0.0, 72.0, 36.0, 3, 8, 40.0), (2, 5, 100.0, 100.0, 0.0, 0.0, 7.2, 7.2, 3, 8, 40.0), (1, 6, 100.0, 100.0, 0.0, 0.0, 0.5, 0.5, 3, 8, None)], "page int, xref int, width double, height double, x0 double, y0 double, x1 double, y1 double, channels int, bits int, quality double"),
        "spaces": f([("DeviceRGB", 3), ("Lab", 0), ("DeviceCMYK", 9)], "space string, objects int"), "inks": f([("A", "spot", ["A", "a"]), ("B", "spot", ["B"])], "ink string, kind string, variants array<string>"),
        "pages": f([(1, (10.0, 10.0, 90.0, 90.0), (5.0, 0.0, 100.0, 100.0), (0.0, 0.0, 100.0, 100.0)), (2, None, None, (0.0, 0.0, 100.0, 100.0))], f"page int, trim {BOX}, bleed {BOX}, rect {BOX}").withColumns({"crop": F.lit(None).cast(BOX), "media": F.col("rect")}),
        "blocks": f([(1, "near", 11.0, 40.0, 50.0, 50.0), (1, "far", 30.0, 40.0, 50.0, 50.0), (1, "over", 0.0, 40.0, 50.0, 50.0), (1, " ", 11.0, 40.0, 50.0, 50.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double"),
        "files": f([([2], None, [])], "transparent_pages array<int>, pdfx string, intents array<string>"), "layers": f([("guides", False), ("art", True)], "name string, visible boolean"),
        "annotations": f([(1, 0.0, 0.0, 10.0, 10.0)], "page int, x0 double, y0 double, x1 double, y1 double"), "regions": f([(1, 1, 2, 3, 4, 320.0), (1, 1, 2, 3, 4, 290.0), (21, 1, 2, 3, 4, 390.0)], "page int, x int, y int, w int, h int, greatest double"),
        "paints": f([(1, "BARNIZ", "varnish", False), (1, "BARNIZ", "varnish", True), (1, "BLANCO", "white", True), (1, "TROQUEL", "technical", True), (1, "ALL", "technical", False)], "page int, ink string, kind string, overprint boolean"),
        "texts": f([(1, "tiny", 5.0, 0, 0, 9, 9, 30.0, 2), (1, "black", 10.0, 0, 0, 9, 9, 25.0, 1), (1, "large", 20.0, 0, 0, 9, 9, 90.0, 4)], "page int, text string, pt double, x int, y int, w int, h int, black_cmy double, inks int"),
        "strokes": f([(1, i, 0.1, 0, 0, 9, 9, 2) for i in range(60)] + [(1, 99, 0.1, 0, 0, 9, 9, 1), (1, 98, 2.0, 0, 0, 9, 9, 3)], "page int, id int, width_pt double, x int, y int, w int, h int, inks int"),
    }


def profile(spark, **own):
    base = {"fonts_not_embedded": ("error", {}), "fonts_type3": ("warning", {}), "resolution": ("warning", {"color_min": "250"}), "jpeg_quality": ("info", {"min": "60"}), "color_spaces": ("warning", {"forbidden": "RGB,Lab"}), "spot_inks_max": ("warning", {"max": "1"}), "duplicate_inks": ("warning", {}), "trim_box": ("error", {}), "bleed": ("error", {"min_mm": "3"}), "safe_zone": ("warning", {"mm": "3"}), "transparency": ("info", {}), "hidden_layers": ("warning", {}), "annotations": ("warning", {}), "pdfx": ("error", {"required": "PDF/X-4"}), "output_intent": ("warning", {}), "total_coverage": ("error", {"limit": "300"}), "overprint": ("warning", {}), "small_text": ("warning", {"min_pt": "6"}), "rich_black_text": ("warning", {"max_pt": "12"}), "thin_line": ("warning", {"min_mm": "0.1"})}
    rows = [("p", r, own.get(r, True), s, m) for r, (s, m) in base.items()]
    return spark.createDataFrame(rows, preflight.PROFILE)


def test_every_rule(spark):
    found = preflight.checked(facts(spark), profile(spark))
    n = {}
    for r in found.collect():
        n[r.rule] = n.get(r.rule, 0) + 1
    assert n == {"fonts_not_embedded": 1, "fonts_type3": 1, "resolution": 1, "jpeg_quality": 1, "color_spaces": 1, "spot_inks_max": 1, "duplicate_inks": 1, "trim_box": 1, "bleed": 2, "safe_zone": 1, "transparency": 1, "hidden_layers": 1, "annotations": 1, "pdfx": 1, "output_intent": 1, "total_coverage": 1, "overprint": 3, "rich_black_text": 2, "small_text": 2, "thin_line": 50}
    errors = [r for r in found.where("rule = 'overprint'").collect() if r.severity == "error"]
    assert len(errors) == 1 and "varnish" in errors[0].message
    box = found.where("rule = 'safe_zone'").first().box
    assert tuple(box) == (22, 83, 81, 20)
    order = [r.severity for r in preflight.ordered(found).collect()]
    assert order == sorted(order, key=preflight.SEVERITIES.index)
    files = spark.createDataFrame([("a.pdf",), ("clean.pdf",)], "file string")
    assert {r.file: (r.error, r.info) for r in preflight.summary(files, found).collect()} == {"a.pdf": (7, 2), "clean.pdf": (0, 0)}
    assert preflight.report(found, 10, 4).groupBy("severity").count().collect() and preflight.report(found, 10, 4).agg(F.max("sheet")).first()[0] == 3


def test_profiles_and_switched_off_rules(spark):
    assert preflight.checked(facts(spark), profile(spark, thin_line=False, overprint=False)).where("rule in ('thin_line', 'overprint')").count() == 0
    builtin, own = profile(spark), profile(spark).limit(1)
    assert preflight.effective(builtin, own).count() == 1 and preflight.upserted(builtin, own.withColumn("profile", F.lit("bad name!"))).count() == builtin.count()


def test_fixes(spark):
    after, counts = preflight.fixed(facts(spark), profile(spark), {"annotations": True, "boxes": 5, "overprint": True, "merge_inks": True})
    left = preflight.checked(after, profile(spark))
    gone = {r.rule for r in preflight.checked(facts(spark), profile(spark)).select("rule").distinct().collect()} - {r.rule for r in left.select("rule").distinct().collect()}
    assert gone == {"annotations", "trim_box", "bleed", "duplicate_inks", "safe_zone"} or gone >= {"annotations", "trim_box", "bleed", "duplicate_inks"}
    got = {r.severity: (r.before, r.after) for r in counts.collect()}
    assert got["error"][1] < got["error"][0]
    with pytest.raises(ValueError):
        preflight.fixed(facts(spark), profile(spark), {"paint_it": True})


FILES = "file string, kind string, errors int, warnings int, annotations int, inks int, names int, unused int, gaps int, width double, height double"


def test_recipes(spark):
    files = spark.createDataFrame([("good.pdf", "pdf", 0, 1, 1, 3, 4, 1, 2, 50.0, 60.0), ("bad.pdf", "pdf", 2, 0, 0, 3, 3, 0, 0, 50.0, 60.0), ("pic.png", "image", 0, 0, 0, 1, 1, 0, 0, 50.0, 60.0), ("huge.pdf", "pdf", 0, 0, 0, 1, 1, 0, 0, 5000.0, 60.0)], FILES)
    recipe = recipes.Recipe("r", [("preflight", {}), ("preflight.fix", {}), ("separate.delete_unused", {}), ("trap.auto", {"stop_on_gaps": True}), ("trap.movement_test", {}), ("tools.distortion", {"pct": 10}), ("tools.step_repeat", {}), ("report", {})])
    out = {r.file: r for r in recipes.routed(recipes.run(recipe, files)).collect()}
    assert {f: r.state for f, r in out.items()} == {"good.pdf": "ok", "bad.pdf": "stopped", "pic.png": "error", "huge.pdf": "error"}
    assert (out["good.pdf"].target, out["bad.pdf"].target, out["good.pdf"].log_file) == ("output/good", "errors", "reports/good.txt") and out["good.pdf"].height == 54.0 and out["good.pdf"].inks == 2
    assert len(out["good.pdf"].log) == 9 and len(out["bad.pdf"].log) == 1
    assert tuple(recipes.outcome(recipes.run(recipe, files)).first()) == (4, 1, 1, 2)
    assert "- bad.pdf: stopped - 2 errors" in {r.line for r in recipes.summary_lines(recipes.run(recipe, files)).collect()}
    wrong = recipes.Recipe("", [("nope", {}), ("report", {"x": 1})])
    assert wrong.problems() == ["no name", "no such step: nope", "no such parameter: x"] and recipes.outcome(recipes.run(wrong, files)).first().error == 4
    assert {r.state for r in recipes.run(recipes.Recipe("c", [("separate.to_process", {})]), files.limit(1)).collect()} == {"error"}
    assert recipes.catalog(spark).count() == len(recipes.CATALOG)
    r = spark.createDataFrame([("a", "n", [(None, "report", {})]), ("b", "", [])], recipes.RECIPE)
    assert {x.recipe for x in recipes.stored(r.limit(0), r).collect()} == {"a"}


def test_history(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    h = spark.createDataFrame([(f"j{i}", t(i), "x") for i in range(5)], "job_id string, at timestamp, v string")
    got = history.added(h, spark.createDataFrame([("j1", t(99), "new")], h.schema), 3).collect()
    assert [(r.job_id, r.v) for r in got] == [("j1", "new"), ("j4", "x"), ("j3", "x")]
    w = spark.createDataFrame([("sol", 2)], "word string, n long")
    words = history.added_words(w, spark.createDataFrame([(x,) for x in ("Sol", "ab", "luna", "a1bc")], "word string"), 3)
    assert {tuple(r) for r in words.collect()} == {("sol", 5), ("luna", 3)} and [r.word for r in history.removed(words, spark.createDataFrame([(" SOL ",)], "word string"), "word").collect()] == ["luna"]
    p = history.added_patterns(spark.createDataFrame([("99",)], "pattern string"), spark.createDataFrame([("$10.000,",), ("no",), ("$12.345",)], "token string"))
    assert {r.pattern for r in p.collect()} == {"99", "$99.999"}
    tune = "kind string, cer double, params string"
    assert {tuple(r) for r in history.merged_tuning(spark.createDataFrame([("a", 0.1, "own"), ("b", 0.3, "own")], tune), spark.createDataFrame([("a", 0.1, "other"), ("b", 0.2, "other"), ("c", 0.9, "other")], tune)).collect()} == {("a", 0.1, "own"), ("b", 0.2, "other"), ("c", 0.9, "other")}
    state = spark.createDataFrame([("v", "x"), ("p", "")], "name string, content string")
    assert len(history.fingerprint(state).first()[0]) == 8 and history.fingerprint(state.limit(0)).first()[0] is None
    layer = lambda *kv: spark.createDataFrame(list(kv), "key string, value string")
    assert {tuple(r) for r in history.layered(layer(("a", "1"), ("b", "2")), layer(("b", "3")), layer(("b", "4"), ("c", "5"))).collect()} == {("a", "1"), ("b", "4"), ("c", "5")}
    checks = spark.createDataFrame([("a", None), ("b", t(0)), ("c", t(80_000))], "name string, last timestamp")
    assert {r.name for r in history.due(checks, F.lit(t(90_000))).collect()} == {"a", "b"}
    stages = spark.createDataFrame([("j", "read", t(0)), ("j", "compare", t(3)), ("j", "end", t(10))], "job string, stage string, at timestamp")
    assert {tuple(r) for r in history.stage_times(stages).collect()} == {("j", "read", 3.0), ("j", "compare", 7.0)}
    runs = spark.createDataFrame([(1, "s", 5), (2, "s", 9), (3, "t", 1)], "run int, scope string, at int")
    assert {(r.scope, r.run) for r in history.latest(runs, ["scope"]).collect()} == {("s", 2), ("t", 3)} and history.next_number(runs, "run").first()[0] == 4 and history.next_number(runs.limit(0), "run").first()[0] == 1


def ase(*blocks):
    out = b"ASEF" + struct.pack(">HHI", 1, 0, len(blocks))
    for name, model, values, kind in blocks:
        n = name + "\0"
        body = struct.pack(">H", len(n)) + n.encode("utf-16-be") + model.encode() + struct.pack(f">{len(values)}f", *values) + struct.pack(">H", kind)
        out += struct.pack(">HI", 1, len(body)) + body
    return out


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("nombre;L;a;b;tipo;opacidad\nRojo;50,5;60;40;;\n# note;1;1;1\nBlanco;94;0;-2\nMal;x;1;1\nCorto;1\nLejos;150;0;0\nOro;60;5;50;spot;0,7\n")
    (tmp_path / "b.tsv").write_text("Azul\t30\t10\t-50\tvarnish\n")
    rows = {r.name: r for r in landing.ink_text(spark, str(tmp_path / "a.csv")).collect()}
    assert {k: r.problem for k, r in rows.items()} == {"Rojo": None, "Blanco": None, "Mal": "no numbers", "Corto": "columns are missing", "Lejos": "Lab out of range", "Oro": None}
    assert (rows["Rojo"].L, rows["Blanco"].kind, rows["Blanco"].opacity, rows["Oro"].opacity) == (50.5, "white", 1.0, 0.7)
    assert [(r.name, r.kind) for r in landing.ink_library(spark, str(tmp_path / "b.tsv")).collect()] == [("Azul", "varnish")]
    (tmp_path / "c.cxf").write_text('<?xml version="1.0"?><cc:CxF xmlns:cc="x"><cc:Resources><cc:ObjectCollection><cc:Object Name="Verde" Id="1"><cc:ColorValues><cc:ColorCIELab><cc:L>60</cc:L><cc:A>-40,5</cc:A><cc:B>30</cc:B></cc:ColorCIELab></cc:ColorValues></cc:Object><cc:Object Name="Nada" Id="2"></cc:Object></cc:ObjectCollection></cc:Resources></cc:CxF>')
    assert [(r.name, r.L, r.a, r.b) for r in landing.ink_library(spark, str(tmp_path / "c.cxf")).collect()] == [("Verde", 60.0, -40.5, 30.0)]
    (tmp_path / "d.ase").write_bytes(ase(("Lab uno", "LAB ", (0.5, 10.0, -20.0), 1), ("rojo", "RGB ", (1.0, 0.0, 0.0), 2), ("Cyan", "CMYK", (1.0, 0.0, 0.0, 0.0), 0), ("gris", "Gray", (1.0,), 2)))
    got = {r.name: r for r in landing.ink_library(spark, str(tmp_path / "d.ase")).collect()}
    assert (got["Lab uno"].L, got["Lab uno"].a) == (50.0, 10.0) and abs(got["rojo"].L - 54.29) < 0.1 and abs(got["Cyan"].L - 55) < 0.1 and got["Cyan"].kind == "process" and abs(got["gris"].L - 100) < 0.1
    (tmp_path / "bad.ase").write_bytes(b"ASEF\0\1\0\0\0\0\0\5xx")
    assert landing.ink_library(spark, str(tmp_path / "bad.ase")).count() == 0
    with pytest.raises(ValueError):
        landing.ink_library(spark, "x.doc")
    (tmp_path / "m.csv").write_text("id;L;a;b\nCyan|0;95;0;-2\nCyan|50;70,5;-20;-30\nCyan|100;;;\nBad|1;x;1;1\n")
    assert {(r.id, r.ink, r.step, r.L, r.problem) for r in landing.measurements(spark, str(tmp_path / "m.csv")).collect()} == {("Cyan|0", "Cyan", 0, 95.0, None), ("Cyan|50", "Cyan", 50, 70.5, None), ("Bad|1", "Bad", 1, None, "no numbers")}
    case = tmp_path / "cases" / "c_01"
    case.mkdir(parents=True)
    (case / "esperado.json").write_text(json.dumps({"caso": "c", "errores": [{"categoria": "text", "bbox": [1, 2, 3, 4]}]}, indent=1))
    assert [(r.folder, r.errores[0].bbox) for r in landing.cases(spark, str(tmp_path / "cases"), "01").collect()] == [("c_01", [1, 2, 3, 4])] and landing.cases(spark, str(tmp_path / "cases"), "zz").count() == 0
    files = spark.createDataFrame([("a.PDF", 10), ("b.exe", 10), ("c.png", 0), ("d.tif", 99 << 20), ("a.txt", 1)], "name string, length long")
    assert {r.name: r.problem for r in landing.validated(files).collect()} == {"a.PDF": None, "b.exe": "file type", "c.png": "empty", "d.tif": "too large", "a.txt": "file type"}
    assert landing.named(files, "a").first().name == "a.PDF" and [r.key for r in landing.missing(spark.createDataFrame([("x",), ("y",)], "key string"), spark.createDataFrame([("x",)], "key string")).collect()] == ["y"]


def test_writers(spark, tmp_path):
    inks = spark.createDataFrame([("Rojo", 50.0, 60.0, 40.0, "spot", 0.0), ("Barniz", None, None, None, "varnish", 0.0)], "name string, L double, a double, b double, kind string, opacity double")
    exports.library_csv(inks, str(tmp_path / "csv")), exports.library_json(inks, str(tmp_path / "json")), exports.library(inks, str(tmp_path / "lib"), "own")
    assert sorted(line for r in spark.read.text(str(tmp_path / "csv")).collect() for line in [r.value])[:1] == ["Barniz,,,,varnish,0.0"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and spark.read.parquet(str(tmp_path / "lib")).select("library").distinct().first()[0] == "own"
    with pytest.raises(ValueError):
        exports.library(inks, str(tmp_path / "lib"), exports.BUILTIN)
    exports.report_csv(inks, ["name", "L"], ["name"], str(tmp_path / "rep"))
    (part,) = (tmp_path / "rep").glob("part-*")
    assert part.read_text().split() == ["﻿name;L", "Barniz;", "Rojo;50.0"]
    exports.vocabulary(spark.createDataFrame([("b", 2), ("a", 2), ("c", 9)], "word string, n long"), str(tmp_path / "voc"))
    assert [r.value for r in spark.read.text(str(tmp_path / "voc")).collect()] == ["c\t9", "a\t2", "b\t2"]
    points = spark.createDataFrame([(1, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2)])], "label int, loop int, pos int, x double, y double")
    assert exports.region_paths(points).first().path == "M0.000 0.000L2.000 0.000L2.000 2.000Z"
    cov = spark.createDataFrame([("Rojo", 5.0, False), ("Black", 1.0, False), ("Cyan", 0.0, True)], "ink string, percent double, empty boolean")
    assert [r.ink for r in exports.plate_rows(cov, spark.createDataFrame([("Rojo", "spot")], "ink string, kind string")).collect()] == ["Cyan", "Black", "Rojo"]
    exports.summary(spark.createDataFrame([("a", "ok", ["x"])], "file string, state string, log array<string>"), str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).columns == ["file", "state"]
    assert exports.separation_text(spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0)], "page int, ink string, percent double")).first().text == "a: 1.0 %\nb: 2.0 %"


def test_watched_folder(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    recipe = recipes.Recipe("w", [("tools.distortion", {"pct": 5}), ("report", {})])
    def facts_(df):
        return df.select("file", "kind", *(F.lit(0).alias(c) for c in "errors warnings annotations inks names unused gaps".split()), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    for k, name in enumerate(("a.pdf", "b.png", "c.txt", "d.pdf")):
        (box / name).write_bytes(b"x")
        if k == 2 or k == 3:
            watch.watch(watch.files(spark, str(box)), recipe, facts_, str(tmp_path / "out"), str(tmp_path / "cp"))
    done = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.file, r.state) for r in done.collect()} == {("a.pdf", "ok"), ("b.png", "error"), ("d.pdf", "ok")} and done.count() == 3
    assert {tuple(r) for r in watch.status(spark, str(tmp_path / "out")).collect()} == {("ok", 2), ("error", 1)}
    with pytest.raises(ValueError):
        watch.watch(watch.files(spark, str(box)), recipes.Recipe("", []), facts_, "x", "y")


def test_settling_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "obs")
    seen = [[("a", 0), ("b", 5)], [("a", 0), ("b", 5)], [("a", 7), ("b", 9)], [("a", 7)]]
    rows, got = [], {}
    schema = "file string, length long"
    spark.createDataFrame([], schema).write.parquet(src)
    for k, look in enumerate(seen):
        spark.createDataFrame(look, schema).coalesce(1).write.mode("append").parquet(src)
        rows += [(f, k, n) for f, n in look]
        stream = watch.settling(spark.readStream.schema(schema).parquet(src))
        stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.update({r.file: r.stable for r in df.collect()})).trigger(availableNow=True).start().awaitTermination()
    batch = {r.file: r.state == "stable" for r in watch.settled(spark.createDataFrame(rows, "file string, at int, length long")).collect()}
    assert got == batch == {"a": True, "b": True}


def test_jobs_and_reviews(spark):
    e = spark.createDataFrame([("a", 1, "progress", "read", 0.3, None), ("a", 2, "done", None, None, None), ("a", 3, "progress", "late", 0.9, None), ("b", 1, "progress", "read", 0.12345, None), ("c", 1, "cancel", None, None, None), ("d", 1, "error", None, None, "boom"), ("d", 2, "done", None, None, None)], "job string, at int, kind string, stage string, pct double, error string")
    assert {r.job: (r.status, r.stage, r.pct, r.error) for r in watch.job_states(e).collect()} == {"a": ("done", "read", 1.0, None), "b": ("running", "read", 0.123, None), "c": ("error", None, None, "cancelled"), "d": ("error", None, None, "boom")}
    assert watch.reviews_due(spark.createDataFrame([("k",)] * 12, "kind string")).first().tunings == 2
    r = spark.createDataFrame([("t", "1", 0.0, 5.0), ("t", "2", 3.0, 9.0), ("t", "3", 5.0, 6.0)], "task string, id string, at double, ends double")
    assert sorted(x.id for x in watch.single_flight(r).collect()) == ["1", "3"]


def grid(spark, text, column="value"):
    return spark.createDataFrame([(1, x, y, c) for y, line in enumerate(text.split()) for x, c in enumerate(line)], f"page int, x int, y int, {column} string")


def test_components(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    picture = "##..#. #...## ..#... .#.... ######"
    mask = grid(spark, picture).where("value = '#'").select("page", "x", "y")
    for diagonal in (True, False):
        pixels = {(r.x, r.y) for r in mask.collect()}
        groups = []
        while pixels:
            todo, part = [pixels.pop()], set()
            while todo:
                x, y = todo.pop()
                part.add((x, y))
                for dx, dy in raster.NEAR8 if diagonal else raster.NEAR4:
                    if (x + dx, y + dy) in pixels:
                        pixels.remove((x + dx, y + dy))
                        todo.append((x + dx, y + dy))
            groups.append(frozenset(part))
        got = {}
        for r in raster.pixels_of(raster.components(mask, diagonal=diagonal)).collect():
            got.setdefault(r.component, set()).add((r.x, r.y))
        assert set(map(frozenset, got.values())) == set(groups)
    left = raster.without_specks(mask, 3, 3)
    assert left.count() < mask.count()


def test_labels(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    labels = grid(spark, "aaaab aabab aaaab bbbbb").select("page", "x", "y", F.when(F.col("value") == "a", 0).otherwise(5).alias("label"))
    clean = raster.without_islands(labels, 2)
    assert {(r.x, r.y) for r in clean.where("label = 5").collect()} == {(4, 0), (4, 1), (4, 2), *((x, 3) for x in range(5))} and clean.count() == 20
    assert {r.label for r in raster.compacted(labels).collect()} == {0, 1} and {r.label for r in raster.without_label(labels, 5).collect()} == {0}
    m = raster.mirror_share(grid(spark, "..##.. .####. .#..#.").select("page", "x", "y", F.when(F.col("value") == "#", 1).otherwise(0).alias("label")), 0).first()
    assert m.vertical == 1.0 and m.horizontal < 1
    assert raster.opening_loss(grid(spark, "aaab aaab aaab").select("page", "x", "y", "value").withColumnRenamed("value", "label"), 3).count() == 3
    pal = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.5), (1, 1, 100.0, 0.0, 0.0, 0.4), (1, 2, 50.0, 3.0, 0.0, 0.02), (1, 3, 50.0, 60.0, 0.0, 0.02), (1, 4, 1.0, 1.0, 1.0, 0.001)], "page int, i int, L double, a double, b double, area double")
    assert sorted(r.i for r in raster.pruned(pal).collect()) == [0, 1, 3]
    px = spark.createDataFrame([(1, 0, 0, 50.0, 0.0, 0.0), (1, 1, 0, 90.0, 0.0, 0.0)], "page int, x int, y int, L double, a double, b double")
    assert {r.x: r.label for r in raster.nearest(px, pal.where("i < 2")).collect()} == {0: 0, 1: 1}


def test_screens_and_measures(spark):
    flat = lambda c: spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"), F.lit(c).alias("cov"))
    for c in (0, 64, 128, 255):
        # turned, so that places of a cell are not all symmetric to each other
        share = raster.am_screen(flat(c), 300.0, 20.0, 22.5).agg(F.avg(F.col("on").cast("int"))).first()[0]
        assert abs(share - c / 255) < 0.04
    held = spark.range(1).select(raster.held_coverage(F.lit(5), 0.05, 0.9).alias("a"), raster.held_coverage(F.lit(250), 0.05, 0.9).alias("b"), raster.spot(F.lit(0.5), F.lit(0.5)).alias("s"), raster.spot(F.lit(0.5), F.lit(0.5), "square").alias("q"), raster.hash_distance(F.lit(5).cast("long"), F.lit(6).cast("long")).alias("h")).first()
    assert tuple(held) == (0.0, 1.0, 2.0, 0.0, 2)
    d = spark.createDataFrame([(1, x, y, 10 * x) for x in range(6) for y in range(6)], "page int, x int, y int, value int")
    c = d.withColumn("value", F.when((F.col("x") == 3) & (F.col("y") == 3), 200).otherwise(F.col("value") + 10))
    assert [(r.x, r.y, r.excess) for r in raster.tolerant_excess(d, c, 3).where("excess > 0 and x < 5").collect()] == [(3, 3, 160)]
    lines = spark.createDataFrame([(1, i, 200.0, 0.99) for i in range(7)] + [(1, 7, 200.0, 0.2), (1, 8, 200.0, 0.99), (2, 0, 20.0, 0.99)], "page int, i int, median double, share double")
    assert {(r.page, r.bar) for r in raster.leading_bar(lines, F.lit(10.0)).collect()} == {(1, 7), (2, 0)}
    box = spark.createDataFrame([(1, i, True, 250.0, 250.0, 250.0) for i in range(20)] + [(1, 20 + i, False, 250.0, 250.0, 250.0) for i in range(12)] + [(1, 40 + i, False, 20.0, 10.0 * i, 30.0) for i in range(4)] + [(2, 0, True, 0.0, 0.0, 0.0), (2, 1, False, 9.0, 0.0, 0.0)], "page int, id int, ring boolean, r double, g double, b double")
    assert [(r.page, r.r, r.g, r.b, r.br) for r in raster.ink_colour(box).collect()] == [(1, 20.0, 15.0, 30.0, 250.0)]
    ch = spark.createDataFrame([(1, c, v) for c, vs in (("r", (0, 100)), ("g", (0, 250)), ("b", (0, 250))) for v in vs], "page int, channel string, value int")
    assert raster.best_channel(ch).first().channel == "b" or raster.best_channel(ch).first().channel == "g"
    px = spark.createDataFrame([(1, v) for v in [10] * 30 + [12] * 10 + [200] * 20], "page int, value int")
    assert raster.otsu(px).first().threshold == 12 and raster.binarized(px, raster.otsu(px)).groupBy("value", "on").count().count() == 3
    reg = spark.createDataFrame([(1.0, 20.0, 0, 0.0), (20.0, 1.0, 0, 0.0), (20.0, 20.0, 11, 0.0), (20.0, 20.0, 3, 30.0), (20.0, 20.0, 3, 3.0)], "design_sd double, client_sd double, hash_distance int, median_change double")
    assert [r.subtype for r in raster.region_kind(reg).collect()] == ["element_missing", "element_extra", "element_changed", "recoloured", "visual_difference"]


def test_slits_need_ink_on_both_sides(spark):
    # two inks that abut: moving one away opens a slit; the outer rim opens none
    rows = [(x, y, 1 if x < 6 else 2, 255) for x in range(12) for y in range(12)]
    df = spark.createDataFrame(rows, "x int, y int, ink int, cov int")
    got = {(r.ink, r.dx, r.dy): r.slits for r in plates.movement_check(df, 1.0, 1.0, 128).collect()}
    assert got[1, -1, 0] == 12 and got[2, 1, 0] == 12 and (1, 1, 0) not in got and (1, 0, 1) not in got
    # the second ink spread under the first: nothing opens
    spread = df.unionByName(spark.createDataFrame([(x, y, 2, 255) for x in (4, 5) for y in range(12)], df.schema))
    assert plates.movement_check(spread, 1.0, 1.0, 128).count() == 0


def test_fits(spark):
    truth = spark.createDataFrame([("c", 55.0, -37.0, -50.0, 0.16), ("m", 48.0, 74.0, -3.0, 0.08)], "ink string, L double, a double, b double, gain double")
    measured = fitting.ramp(truth, 2.0).select("ink", "step", F.col("mL").alias("L"), F.col("ma").alias("a"), F.col("mb_").alias("b"))
    assert {(r.ink, r.n, r.gain) for r in fitting.fitted(measured).collect()} == {("c", 2.0, 0.16), ("m", 2.0, 0.08)}
    assert {(r.ink, r.gain) for r in fitting.calibrated(truth, truth.where("ink = 'c'").withColumn("gain", F.lit(0.3))).collect()} == {("c", 0.3), ("m", 0.0)}
    inks = [("Cyan", 55.0, -37.0, -50.0), ("Magenta", 48.0, 74.0, -3.0), ("Yellow", 89.0, -5.0, 93.0)]
    targets = spark.createDataFrame([("cyan", 55.0, -37.0, -50.0), ("never", 30.0, 90.0, -90.0)], "name string, L double, a double, b double")
    got = {r.name: r for r in fitting.recipes(targets, inks, 2).collect()}
    assert got["cyan"].recipe == {"Cyan": 100.0} and got["cyan"].de < 0.1 and got["cyan"].light == "green" and got["never"].light == "red"
    s = fitting.ink_samples(2, 5, 50, 1, spark)
    assert s.count() == 75 and s.collect() == fitting.ink_samples(2, 5, 50, 1, spark).collect()
    px = spark.createDataFrame([(1, 0, 0, 255, 255, 255), (1, 1, 0, 0, 130, 200)], "page int, x int, y int, r int, g int, b int")
    sep = {r.x: r for r in fitting.separated(px, inks[:2], s).collect()}
    assert sum(sep[0].t) < 0.1 and sep[1].t[0] > 0.7
    scores = spark.createDataFrame([("a", False, 0.2), ("b", False, 0.1), ("a", True, 0.2), ("b", True, 0.15)], "params string, held boolean, cer double")
    assert [(r.params, r.base) for r in fitting.adopted(scores, "a").collect()] == [("b", 0.2)] and fitting.adopted(scores, "b").count() == 0
    held = fitting.holdout(spark.createDataFrame([(f"case {i % 300}", i) for i in range(900)], "case string, i int"))
    assert held.select("case", "held").distinct().count() == 300 and 70 <= held.where("held").select("case").distinct().count() <= 130
    points = spark.createDataFrame([(50.0 + i % 3, 0.0, 0.0) for i in range(300)] + [(20.0, 60.0, 0.0 + i % 2) for i in range(100)], "L double, a double, b double")
    assert [round(r.share, 2) for r in fitting.palette(points, 6).collect()] == [0.75, 0.25]
