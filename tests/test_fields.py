"""Distances, windows, illumination, diffusion, contours and visual comparison against plain arrays."""

import random

import numpy as np
import pytest

from platewright.operators import contours, diffusion, distance, illumination, raster, tiles, visual, windows


def pages_of(spark, pages, names="value"):
    rows = [(p, x, y, *np.atleast_1d(a[y, x]).tolist()) for p, a in pages.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    kinds = ", ".join(f"{n} long" for n in names.split())
    return spark.createDataFrame(rows, f"page long, x long, y long, {kinds}")


def test_nearest_seeds_by_hand(spark):
    rng = np.random.default_rng(1)
    places, seeds, want = [], [], {}
    for page in range(12):
        h, w = rng.integers(1, 30, 2)
        own = [(int(x), int(y), int(rng.integers(-3, 4))) for x in range(w) for y in range(h) if rng.random() < (0, 0.02, 0.3)[page % 3]]
        asked = [(x, y) for x in range(w) for y in range(h) if rng.random() < 0.7]
        seeds += [(page, *s) for s in own]
        for x, y in asked:
            places.append((page, x, y))
            want[page, x, y] = min((((x - a) ** 2 + (y - b) ** 2, k) for a, b, k in own), default=(None, None))
    got = distance.nearest_seeds(spark.createDataFrame(places, "page long, x int, y int"), spark.createDataFrame(seeds, "page long, x int, y int, label int")).collect()
    assert {(r.page, r.x, r.y): (r.square, r.label) for r in got} == want and len(got) == len(want)


def test_filled_gives_every_pixel_back(spark):
    label = np.zeros((60, 7), int)
    label[0], label[-1] = 1, 2
    labels = pages_of(spark, {1: label, 2: np.full((3, 3), 5)}, "label")
    got = {(r.page, r.x, r.y): r.label for r in raster.filled(labels, labels.where("label = 0 or label = 5").select("page", "x", "y")).collect()}
    assert len(got) == 60 * 7 + 9 and all(got[2, x, y] == 5 for x in range(3) for y in range(3))
    assert all(got[1, x, y] == (1 if y < 30 else 2) for x in range(7) for y in range(60))


def test_depths(spark):
    mask = [(1, "a", x, y) for x in range(9) for y in range(5)] + [(1, "b", 3, 3)]
    got = {(r.ink, r.x, r.y): r.square for r in distance.depths(spark.createDataFrame(mask, "page int, ink string, x int, y int"), ("page", "ink")).collect()}
    assert got == {("b", 3, 3): 1} | {("a", x, y): min(x + 1, 9 - x, y + 1, 5 - y) ** 2 for x in range(9) for y in range(5)}


@pytest.mark.parametrize("radius", [1, 3])
def test_windows_of_pages_with_gaps(spark, radius):
    rng = random.Random(radius)
    pixels = {(p, x, y): rng.randrange(256) for p in range(3) for x in range(14) for y in range(9) if rng.random() < (1, 0.5, 0.1)[p]}
    df = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "page long, x int, y int, value int")
    from pyspark.sql import functions as F

    got = windows.windowed(df, radius, {"n": (F.lit(1), F.sum), "s": (F.col("value"), F.sum), "low": (F.col("value"), F.min), "high": (F.col("value"), F.max)}).collect()
    assert len(got) == len(pixels)
    for r in got:
        near = [v for (p, x, y), v in pixels.items() if p == r.page and abs(x - r.x) <= radius and abs(y - r.y) <= radius]
        assert (r.n, r.s, r.low, r.high, r.value) == (len(near), sum(near), min(near), max(near), pixels[r.page, r.x, r.y])


def test_blurred(spark):
    a = np.random.default_rng(3).integers(0, 256, (6, 8))
    wide = np.pad(a, 1, mode="reflect")
    want = sum(k * m * wide[i : i + 6, j : j + 8] for i, k in enumerate((1, 2, 1)) for j, m in enumerate((1, 2, 1)))
    got = {(r.x, r.y): r.value for r in windows.blurred(pages_of(spark, {1: a}), ["value"]).collect()}
    assert all(got[x, y] == (want[y, x] + 8) // 16 for x in range(8) for y in range(6))


def serial(colours, palette):
    h, w, _ = colours.shape
    errors, index = np.zeros((h + 1, w + 2, 3)), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            e = 7 * errors[y + 1, x] + 3 * errors[y, x + 2] + 5 * errors[y, x + 1] + errors[y, x]
            wanted = np.clip(colours[y, x] + e / 16, 0, 255)
            index[y, x] = ((wanted - palette) ** 2).sum(1).argmin()
            errors[y + 1, x + 1] = wanted - palette[index[y, x]]
    return index


def test_diffusion_is_the_serial_one(spark):
    rng = np.random.default_rng(5)
    palette = [(0, 0, 0), (255, 255, 255), (200, 30, 30), (20, 90, 180), (250, 220, 60)]
    pages = {p: rng.integers(0, 256, (*rng.integers(1, 24, 2), 3)) for p in range(6)} | {9: np.stack([np.linspace(0, 255, 40).astype(int)[None].repeat(30, 0)] * 3, -1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = diffusion.diffused(pages_of(spark, pages, "r g b"), palette).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {p: serial(a, np.array(palette, float)) for p, a in pages.items()}
    assert len(got) == sum(a.size for a in want.values()) and all(r["index"] == want[r.page][r.y, r.x] for r in got)


def test_gradient_is_removed(spark):
    """A sheet with text, lit from white to four fifths across and to nine tenths down."""
    rng = np.random.default_rng(2)
    h, w = 64, 96
    design = np.full((h, w, 3), 240)
    design[rng.random((h, w)) < 0.15] = 20
    design[20:44, 30:60] = (200, 40, 40)  # no paper here
    light = (1 - 0.2 * np.arange(w)[None, :] / w) * (1 - 0.1 * np.arange(h)[:, None] / h)
    client = np.floor(design * light[..., None] + 0.5).astype(int)
    even = np.full((h, w, 3), 240)
    d, c = pages_of(spark, {1: design, 2: even}, "r g b"), pages_of(spark, {1: client, 2: even - 3}, "r g b")
    rows = illumination.normalized(d, c).collect()
    assert len(rows) == 2 * h * w and {r.page for r in rows if r.changed} == {1}
    out = np.zeros((h, w, 3))
    for r in rows:
        if r.page == 1:
            out[r.y, r.x] = (r.r, r.g, r.b)
        else:
            assert (r.r, r.g, r.b) == (237, 237, 237)
    sheet = out[(design == 240).all(-1)]
    assert sheet.max() - sheet.min() <= 3 and abs(sheet - np.median(sheet)).mean() < 1
    before = client[(design == 240).all(-1)]
    assert before.max() - before.min() > 50


def traced(label):
    """Loops of a label map by walking, as (label, cracks, area)."""
    h, w = label.shape
    at = lambda x, y: label[y, x] if 0 <= x < w and 0 <= y < h else None
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    sides = [((0, -1), (0, 0)), ((0, 0), (-1, 0)), ((-1, 0), (-1, -1)), ((-1, -1), (0, -1))]
    edges = {}
    for y in range(h + 1):
        for x in range(w + 1):
            for d, ((ax, ay), (bx, by)) in enumerate(sides):
                left, right = at(x + ax, y + ay), at(x + bx, y + by)
                if left is not None and left != right and 0 <= x + steps[d][0] <= w and 0 <= y + steps[d][1] <= h:
                    edges[x, y, d] = left
    out = []
    while edges:
        (x, y, d), own = next(iter(edges.items()))
        n = area = 0
        while edges.get((x, y, d)) == own:
            del edges[x, y, d]
            x1, y1 = x + steps[d][0], y + steps[d][1]
            n, area = n + 1, area + x1 * y - x * y1
            x, y = x1, y1
            d = next((k for k in ((d + 3) % 4, d, (d + 1) % 4) if edges.get((x, y, k)) == own), -1)
        out.append((own, n, area / 2))
    return sorted(out)


def test_loops_by_walking(spark):
    rng = np.random.default_rng(4)
    pages = {p: rng.integers(0, (2, 3, 5)[p % 3], rng.integers(1, 14, 2)) for p in range(9)}
    pages[9] = np.kron(rng.integers(0, 2, (3, 3)), np.ones((5, 5), int))
    got = contours.loops(pages_of(spark, pages, "label")).cache()
    found = contours.loop_areas(got).collect()
    for p, label in pages.items():
        assert sorted((r.label, r.length, r.area) for r in found if r.page == p) == traced(label)
        for k in np.unique(label):
            assert sum(r.area for r in found if r.page == p and r.label == k) == (label == k).sum()
    rows = {(r.page, r.loop, r.pos): r for r in got.collect()}
    assert all((r.x1, r.y1) == (rows[p, k, (i + 1) % r.length].x0, rows[p, k, (i + 1) % r.length].y0) for (p, k, i), r in rows.items())


def test_chains_meet_at_nodes(spark):
    rng = np.random.default_rng(6)
    pages = {p: np.kron(rng.integers(0, 3, (4, 4)), np.ones((3, 3), int)) for p in range(4)}
    ring = np.zeros((9, 9), int)
    ring[2:6, 3:7] = 1
    pages[7] = ring
    rows = contours.chains(pages_of(spark, pages, "label")).collect()
    by = {}
    for r in rows:
        by.setdefault((r.page, r.chain), []).append(r)
    degree = {}
    for r in rows:
        for v in ((r.x0, r.y0), (r.x1, r.y1)):
            degree[r.page, *v] = degree.get((r.page, *v), 0) + 1
    for (page, _), own in by.items():
        own.sort(key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(own[0].length)) and len({(r.left, r.right) for r in own}) == 1
        assert all((a.x1, a.y1) == (b.x0, b.y0) for a, b in zip(own, own[1:], strict=False))
        ends = [(own[0].x0, own[0].y0), (own[-1].x1, own[-1].y1)]
        assert (ends[0] == ends[1] and degree[page, *ends[0]] == 2) if own[0].closed else all(degree[page, *v] != 2 for v in ends)
        assert all(degree[page, r.x1, r.y1] == 2 for r in own[:-1])
    assert sum(len(own) for (page, _), own in by.items() if page == 7) == 16 + 36 and sum(own[0].closed for own in by.values() if own[0].page == 7) == 2


def test_loops_across_tiles(spark):
    """Tiles of eight places give the outlines that one tile gives, and pages of one tile need no rounds."""
    rng = np.random.default_rng(11)
    blocks = np.kron(rng.integers(0, 3, (6, 7)), np.ones((4, 5), int))
    frame = np.zeros((8, 8), int)  # its outline lies in four tiles, as its right and lower sides count
    pages = {1: blocks, 2: rng.integers(0, 2, (19, 21)), 3: np.where(rng.random((40, 9)) < 0.8, 1, 0), 4: frame}
    d = pages_of(spark, pages, "label")
    one, many = (sorted(map(tuple, contours.loops(d, bits).collect())) for bits in (8, 3))
    assert one == many and len(one) > 1000
    assert not tiles.several(d) and tiles.several(d.where("page = 4"), 3)


def test_chains_across_tiles(spark):
    """Tiles of eight places give the chains that one tile gives; lists given by their links alone too."""
    rng = np.random.default_rng(12)
    spiral = np.zeros((30, 30), int)
    for k in range(1, 14, 4):
        spiral[k, k : 29 - k] = spiral[k : 29 - k, 28 - k] = spiral[28 - k, k + 2 : 29 - k] = spiral[k + 4 : 29 - k, k + 2] = 1
    pages = {1: np.kron(rng.integers(0, 3, (6, 7)), np.ones((4, 5), int)), 2: rng.integers(0, 2, (19, 21)), 3: spiral}
    d = pages_of(spark, pages, "label")
    one, many = (sorted(map(tuple, contours.chains(d, bits).collect())) for bits in (8, 3))
    assert one == many and len(one) > 1000
    # a ring and a line over many tiles, by their links
    ring = [(x, 0) for x in range(30)] + [(29 - x, 9) for x in range(30)]
    ids = [(y << 29) + x << 2 for x, y in ring]
    links = [(1, a, b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)] + [(2, a, b) for a, b in zip(ids, [*ids[1:], None], strict=True)]
    got = contours.ranked(spark.createDataFrame(links, "page int, id long, next long"), bits=3).collect()
    assert {(r.page, r.id): (r.list, r.pos, r.length, r.closed) for r in got} == {(1, i): (0, k, 60, True) for k, i in enumerate(ids)} | {(2, i): (ids[-1], k, 60, False) for k, i in enumerate(ids)}


def test_compared_pages(spark):
    """A removed, a recoloured and a moved element, an untouched one, and a page that is equal."""
    h, w = 130, 300
    design = np.full((h, w, 3), 250)
    for x in (20, 90, 160, 240):
        design[20:50, x : x + 20] = (30, 60, 120)
        design[26:32, x + 4 : x + 16] = 250
    client = design.copy()
    client[20:50, 20:40] = 250
    client[20:50, 90:110] = np.where((design[20:50, 90:110] == 250).all(-1)[..., None], 250, np.array([190, 40, 40]))
    client[90:104, 160:180] = (0, 0, 0)
    client = np.clip(client + np.random.default_rng(0).integers(-2, 3, client.shape), 0, 255)
    d, c = pages_of(spark, {1: design, 2: design}, "r g b"), pages_of(spark, {1: client, 2: design}, "r g b")
    scores, boxes = visual.compared(d, c)
    s = {r.page: r.similarity for r in scores.collect()}
    assert s[2] == pytest.approx(1.0) and s[1] < 0.97
    found = sorted((r.x, r.subtype, r.severity, r.y) for r in boxes.collect())
    assert {r.page for r in boxes.collect()} == {1} and [(k, s) for _, k, s, _ in found] == [("element_extra", "high"), ("recoloured", "high"), ("element_missing", "high")]
    assert all(abs(x - want) <= 16 for (x, *_), want in zip(found, (20, 90, 160), strict=True))
    strong = {(r.page, r.x, r.y): r.strength for r in visual.strengths(visual.differences(d, c)).collect()}
    assert strong[1, 30, 40] > 0.5 and strong[1, 250, 40] < 0.2 and max(v for (p, _, _), v in strong.items() if p == 2) == 0.0


def test_cosine_hash(spark):
    """Against the transform written out as a matrix product."""
    rng = np.random.default_rng(8)
    boxes = {1: rng.integers(0, 256, (32, 32)), 2: rng.integers(0, 256, (64, 96)), 3: rng.integers(0, 256, (5, 9))}
    rows = [(k, x, y, a.shape[1], a.shape[0], int(a[y, x])) for k, a in boxes.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    got = {r.box: r.hash for r in visual.cosine_hash(spark.createDataFrame(rows, "box int, px long, py long, w long, h long, value long"), ("box",)).collect()}
    waves = np.cos(np.pi / 32 * np.outer(np.arange(8), np.arange(32) + 0.5))
    for k, a in boxes.items():
        h, w = a.shape
        if k == 3:
            n, s = np.zeros((32, 32)), np.zeros((32, 32))
            for y in range(h):
                for x in range(w):
                    ys, xs = slice(y * 32 // h, max(y * 32 // h, -(-(y + 1) * 32 // h) - 1) + 1), slice(x * 32 // w, max(x * 32 // w, -(-(x + 1) * 32 // w) - 1) + 1)
                    n[ys, xs] += 1
                    s[ys, xs] += a[y, x]
            cells = s / n
        else:
            cells = a.reshape(32, h // 32, 32, w // 32).mean((1, 3))
        c = (waves @ cells @ waves.T).ravel()
        want = sum(1 << i for i in range(64) if c[i] > np.median(c))
        assert got[k] % (1 << 64) == want


def test_differences_across_tiles(spark):
    """Tiles of eight places see what one tile sees, on pages with gaps too."""
    rng = np.random.default_rng(13)
    rasters = [{p: np.kron(rng.integers(0, 256, (5, 6, 3)), np.ones((5, 4, 1), int)) for p in (1, 2)} for _ in "dc"]
    d, c = (pages_of(spark, r, "r g b") for r in rasters)
    d = d.where("page = 1 or (x % 7 <> 3 and y % 11 <> 5)")
    one, many = (sorted(map(str, visual.differences(d, c, bits).collect())) for bits in (8, 3))
    assert one == many and len(one) > 900


def test_hash_of_an_even_box(spark):
    """Where coefficients are zero but for the rounding of sums, the bits do not depend on the order of these."""
    a = np.full((32, 32), 250)
    a[9:23, 5:27] = np.where(np.arange(22) % 3, 60, 71)
    rows = [(k, x, y, 32, 32, int(v)) for k, b in ((1, a), (2, a[::-1]), (3, a[:, ::-1])) for y in range(32) for x, v in enumerate(b[y])]
    df = spark.createDataFrame(rows, "box int, px long, py long, w long, h long, value long")
    got = {r.box: r.hash for r in visual.cosine_hash(df, ("box",)).collect()}
    assert got[1] == got[2]  # level mirror images of an image that is its own
    assert {r.box: r.hash for r in visual.cosine_hash(df.repartition(7, "py"), ("box",)).collect()} == got
