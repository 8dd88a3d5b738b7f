"""Thinning, centre lines, straightened lines and the guarded search against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewright.operators import fitting, raster, strokes


def thinned_by_hand(mask):
    m = np.pad(mask.astype(int), 1)
    while True:
        before = m.sum()
        for half in (0, 1):
            gone = []
            for y, x in np.argwhere(m):
                p = [m[y - 1, x], m[y - 1, x + 1], m[y, x + 1], m[y + 1, x + 1], m[y + 1, x], m[y + 1, x - 1], m[y, x - 1], m[y - 1, x - 1]]
                turns = sum(a == 0 and b == 1 for a, b in zip(p, p[1:] + p[:1], strict=True))
                first, second = (p[0] * p[2] * p[4], p[2] * p[4] * p[6]) if half == 0 else (p[0] * p[2] * p[6], p[0] * p[4] * p[6])
                if 2 <= sum(p) <= 6 and turns == 1 and first == 0 and second == 0:
                    gone.append((y, x))
            for q in gone:
                m[q] = 0
        if m.sum() == before:
            return m[1:-1, 1:-1].astype(bool)


def pixels_of(spark, pages):
    return spark.createDataFrame([(p, int(x), int(y)) for p, a in pages.items() for y, x in np.argwhere(a)], "page int, x int, y int")


def drawn():
    y, x = np.mgrid[:40, :60]
    bar = (abs(y - 20) <= 2) & (x > 4) & (x < 55)
    ring = abs(np.hypot(x - 30, y - 20) - 14) <= 1.6
    cross = ((abs(y - 20) <= 1) & (x > 4) & (x < 55)) | ((abs(x - 30) <= 1) & (y > 4) & (y < 36))
    wedge = (abs(y - 20) * 8 <= x - 4) & (x < 55)
    slope = abs((y - 5) - (x - 5) * 0.5) <= 1.8
    slope &= (x > 5) & (x < 55)
    return {1: bar, 2: ring, 3: cross, 4: wedge, 5: slope}


def test_thinning(spark):
    pages = drawn() | {9: np.random.default_rng(1).random((20, 24)) < 0.6}
    got = {}
    for r in strokes.thinned(pixels_of(spark, pages)).collect():
        got.setdefault(r.page, set()).add((r.y, r.x))
    for p, a in pages.items():
        assert got[p] == set(map(tuple, np.argwhere(thinned_by_hand(a)).tolist())), p


def test_strokes_across_tiles(spark):
    """Thinning, parts and neighbourhoods in tiles of eight places are those of one tile."""
    rng = np.random.default_rng(2)
    pages = drawn() | {8: np.kron(rng.random((6, 9)) < 0.6, np.ones((5, 4), bool)), 9: rng.random((30, 33)) < 0.6}
    mask = pixels_of(spark, pages)
    for made in (strokes.thinned, strokes.neighbourhoods, lambda m, bits: raster.pixels_of(raster.components(m, bits=bits)).select("page", "x", "y", "component")):
        one, many = (sorted(map(tuple, made(mask, bits=bits).collect())) for bits in (8, 3))
        assert one == many and len(one) > 500


def test_centre_lines(spark):
    rows = strokes.centre_lines(pixels_of(spark, drawn())).collect()
    pages = {}
    for r in rows:
        pages.setdefault(r.page, []).append(r)
    assert set(pages) == {1, 2, 5}  # a cross branches, a wedge has no width of its own
    for own in pages.values():
        own.sort(key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(len(own)))
        assert all(max(abs(a.x - b.x), abs(a.y - b.y)) == 1 for a, b in zip(own, own[1:], strict=False))
    assert all(r.y == 20 and 4.5 < r.width < 5.8 and not r.closed for r in pages[1])
    assert all(abs(np.hypot(r.x - 30, r.y - 20) - 14) < 1.6 and r.closed and 2.4 < r.width < 4.2 for r in pages[2])
    assert all(abs((r.y - 5) - (r.x - 5) * 0.5) < 1.5 for r in pages[5])


def test_straightened(spark):
    # a frame that leans a little, a line that is tied to its corner, a slanted one, and a group that would move too far
    lines = [
        (1, 1, 1, 2, 0.0, 0.0, 100.0, 1.0), (1, 2, 2, 3, 100.0, 1.0, 100.6, 60.0), (1, 3, 3, 4, 100.6, 60.0, 0.4, 60.4), (1, 4, 4, 1, 0.4, 60.4, 0.0, 0.0),
        (1, 5, 1, 5, 0.0, 0.0, -30.0, -20.0), (1, 6, 6, 7, 0.0, 200.0, 300.0, 206.0), (2, 1, 1, 2, 5.0, 5.0, 6.0, 5.01),
    ]
    got = {(r.page, r.line): r for r in strokes.straightened(spark.createDataFrame(lines, "page int, line int, a int, b int, x0 double, y0 double, x1 double, y1 double")).collect()}
    assert got[1, 1].y0 == got[1, 1].y1 == pytest.approx(0.5, abs=1e-9) and got[1, 3].y0 == got[1, 3].y1 == pytest.approx(60.2)
    assert got[1, 2].x0 == got[1, 2].x1 and got[1, 4].x0 == got[1, 4].x1
    for (page, line), (_, _, a, b, x0, y0, x1, y1) in zip([r[:2] for r in lines], lines, strict=True):
        r = got[page, line]
        assert max(abs(r.x0 - x0), abs(r.y0 - y0), abs(r.x1 - x1), abs(r.y1 - y1)) <= 1.5
        for other in got.values():  # nodes stay shared
            if other.page == page:
                for n, p in ((other.a, (other.x0, other.y0)), (other.b, (other.x1, other.y1))):
                    if n == a:
                        assert p == (r.x0, r.y0)
                    if n == b:
                        assert p == (r.x1, r.y1)
    assert (got[1, 6].y0, got[1, 6].y1) == (200.0, 206.0) and (got[2, 1].y0, got[2, 1].y1) == (5.0, 5.01)


OPTIONS = {"scale": [1, 2, 3, 4, 5, 6], "block": [11, 15, 21, 31, 41], "blur": [0, 1, 2, 3]}


def planted(settings, samples):
    """Costs that are least at scale 4, block 21, blur 1, more or less by case."""
    away = F.abs(F.element_at("params", "scale").cast("int") - 4) * 0.03 + F.abs(F.element_at("params", "block").cast("int") - 21) * 0.004 + F.abs(F.element_at("params", "blur").cast("int") - 1) * 0.02
    return samples.crossJoin(F.broadcast(settings)).select("setting", (0.05 + away + F.pmod(F.xxhash64("case"), F.lit(100)) / 5000.0).alias("cost"))


def test_guarded_search(spark):
    samples = spark.createDataFrame([(f"case {i % 60}", i) for i in range(240)], "case string, line int")
    now = {"scale": 2, "block": 31, "blur": 0}
    best, cost, first, runs = fitting.searched(samples, OPTIONS, now, planted, rounds=6)
    assert best == {"scale": 4, "block": 21, "blur": 1} and cost < first
    calm = lambda settings, held: planted(settings, held).select("setting", F.lit(1).alias("errors"), "cost")
    worse = lambda settings, held: planted(settings, held).select("setting", F.col("setting").alias("errors"), "cost")
    good = fitting.tuned(samples, OPTIONS, now, planted, calm)
    assert good["adopted"] and good["held_after"] < good["held_before"]
    assert not fitting.tuned(samples, OPTIONS, now, planted, worse)["adopted"]
    # half of the settings see all samples at most, less than the whole grid does
    assert runs < 6 * 5 * 4
    same = fitting.tuned(samples, OPTIONS, best, planted, calm)
    assert same["params"] == best and not same["adopted"]


def test_settings_are_scored_and_lines_sampled(spark):
    scores = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.1), ("c", None)], "params string, cer double")
    assert {r.params: r.cer for r in fitting.evaluated(scores).collect()} == {"a": pytest.approx(0.3), "b": 0.1, "c": 1.0}
    lines = [(f"case {i % 5}", f"kind {i % 2}", 1, i, 100 * (i % 10), 20 * (i // 10), 50, 10) for i in range(100)]
    boxes = [(1, 1, 0, 0, 60, 200), (2, 2, 0, 0, 1000, 1000)]  # covers the first column of page 1; page 2 has no lines
    frame = spark.createDataFrame(lines, "case string, kind string, page int, id int, x int, y int, w int, h int")
    errors = spark.createDataFrame(boxes, "page int, id int, x int, y int, w int, h int")
    got = fitting.sampled(frame, errors, per_case=6, per_kind=12).collect()
    free = {r[3] for r in lines if r[4] != 0}
    assert {r.id for r in got} <= free and 18 <= len({r.id for r in got}) == len(got) <= 24
    for key, most in (("case", 6), ("kind", 12)):
        assert max(sum(getattr(r, key) == v for r in got) for v in {getattr(r, key) for r in got}) <= most
    assert sorted(map(tuple, got)) == sorted(map(tuple, fitting.sampled(frame.repartition(7), errors, per_case=6, per_kind=12).collect()))
