"""Rewritten streams and what plates print under boxes."""

import random

import pytest

from platewright.operators import inventory, streams

STREAM = "file string, page int, seq long, op string, args array<string>"
SPACES = [("f", "Die", ["Dieline"]), ("f", "Both", ["Dieline", "PANTONE 185 C"]), ("f", "Spot", ["PANTONE 185 C"]), ("f", "Lack", ["Barniz"]), ("f", "None", [])]


def spaces(spark):
    return spark.createDataFrame(SPACES, "file string, space string, inks array<string>")


def random_stream(rng, page, n):
    rows, depth = [], 0
    for i in range(n):
        op = rng.choice(["q", "Q", "cs", "CS", "scn", "SCN", "k", "K", "g", "rg", "f", "S", "B", "Tj"])
        if op == "Q" and not depth:
            op = "q"
        depth += (op == "q") - (op == "Q")
        args = {"cs": lambda: [rng.choice(SPACES)[1]], "CS": lambda: [rng.choice(SPACES)[1]], "scn": lambda: ["0.5"], "SCN": lambda: ["0.25"], "k": lambda: rng.choice([["0", "0", "0", "1"], ["0.2", "0", "0", "1"]]), "K": lambda: ["0", "0", "0", "1"], "g": lambda: ["0"], "rg": lambda: ["1", "0", "0"]}.get(op, list)()
        rows.append(("f", page, i, op, args))
    return rows


def test_overprint_is_set_with_the_state(spark):
    rng = random.Random(3)
    rows = [r for page in range(20) for r in random_stream(rng, page, 60)]
    got = streams.overprinted(spark.createDataFrame(rows, STREAM), spaces(spark)).collect()
    pages = {}
    for r in sorted(got, key=lambda r: (r.page, r.seq)):
        pages.setdefault(r.page, []).append(r)
    assert [(r.page, r.op, r.args) for p in range(20) for r in pages[p] if not r.made] == [(p, op, args) for _, p, _, op, args in rows]
    made = 0
    for own in pages.values():
        assert [r.seq for r in own] == list(range(1, len(own) + 1))
        # the last colour set in the state decides
        over, wanted, saved = False, False, []
        tech = {"cs": False, "CS": False}
        for i, r in enumerate(own):
            if r.op == "q":
                saved.append((over, wanted, dict(tech)))
            elif r.op == "Q":
                over, wanted, tech = saved.pop() if saved else (over, wanted, tech)
            elif r.made:
                assert r.op == "gs"
                over, made = "OP=true" in r.args, made + 1
            elif r.op in ("cs", "CS"):
                tech[r.op] = wanted = r.args[0] in ("Die", "Lack")
            elif r.op in ("scn", "SCN"):
                wanted = tech["cs" if r.op == "scn" else "CS"]
            elif r.op in ("k", "K"):
                tech["cs" if r.op == "k" else "CS"] = False
                wanted = [float(a) for a in r.args] == [0, 0, 0, 1]
            elif r.op in ("g", "rg"):
                tech["cs"] = wanted = False
            if r.op in ("f", "S", "B", "Tj"):
                assert over == wanted
            if r.made:
                assert not own[i - 1].made
    assert made > 50
    # the fold over paints sees it
    stream = spark.createDataFrame([("f", 1, 1, "cs", ["Die"]), ("f", 1, 2, "f", []), ("f", 1, 3, "q", []), ("f", 1, 4, "cs", ["Spot"]), ("f", 1, 5, "f", []), ("f", 1, 6, "Q", []), ("f", 1, 7, "f", [])], STREAM)
    after = streams.overprinted(stream, spaces(spark)).select("file", "page", "seq", "op", "args")
    assert [(r.space, r.overprint) for r in inventory.paints(after).orderBy("seq").collect()] == [("Die", True), ("Spot", False), ("Die", True)]


def test_spots_become_process(spark):
    rows = [
        ("f", 1, 1, "cs", ["Spot"]), ("f", 1, 2, "scn", ["0.5"]), ("f", 1, 3, "f", []), ("f", 1, 4, "q", []), ("f", 1, 5, "CS", ["Die"]), ("f", 1, 6, "SCN", ["1"]), ("f", 1, 7, "g", ["0"]), ("f", 1, 8, "scn", ["0.3"]),
        ("f", 1, 9, "Q", []), ("f", 1, 10, "scn", ["2"]), ("f", 1, 11, "f", []), ("g", 1, 1, "cs", ["Spot"]), ("f", 2, 1, "CS", ["Spot"]), ("f", 2, 2, "S", []),
    ]
    values = spark.createDataFrame([("pantone 185c", 0.0, 0.9, 0.8, 0.1)], "name string, c double, m double, y double, k double")
    got = {(r.file, r.page): [] for r in spark.createDataFrame(rows, STREAM).collect()}
    for r in streams.as_process(spark.createDataFrame(rows, STREAM), spaces(spark), values).orderBy("file", "page", "seq").collect():
        got[r.file, r.page].append((r.op, r.args, r.made))
    half, full = ["0.0000", "0.4500", "0.4000", "0.0500"], ["0.0000", "0.9000", "0.8000", "0.1000"]
    assert got["f", 1] == [
        ("k", full, True), ("k", half, True), ("f", [], False), ("q", [], False), ("CS", ["Die"], False), ("SCN", ["1"], False), ("g", ["0"], False), ("scn", ["0.3"], False),
        ("Q", [], False), ("k", ["0.0000", "1.0000", "1.0000", "0.2000"], True), ("f", [], False)]
    assert got["g", 1] == [("cs", ["Spot"], False)] and got["f", 2] == [("K", full, True), ("S", [], False)]


def test_plates_under_boxes(spark):
    rng = random.Random(5)
    inks = ["Black", "Cyan", "Magenta", "Yellow", "Spot"]
    cov = {(p, i, x, y): rng.choice([0, 40, 90, 200, 255]) for p in (1, 2) for i in inks for x in range(150) for y in range(20) if rng.random() < 0.3}
    boxes = [(p, k, rng.randrange(140), rng.randrange(15), rng.randint(1, 90), rng.randint(1, 12)) for p in (1, 2, 3) for k in range(12)] + [(1, 99, 5, 5, 1, 1)]
    plates = spark.createDataFrame([(*k, v) for k, v in cov.items()], "page int, ink string, x int, y int, cov int")
    got = {(r.page, r.id): r for r in streams.under_boxes(plates, spark.createDataFrame(boxes, "page int, id int, x int, y int, w int, h int")).collect()}
    assert len(got) == len(boxes)
    for p, k, x, y, w, h in boxes:
        places = [(a, b) for a in range(x, x + w) for b in range(y, y + h)]
        dark = [q for q in places if cov.get((p, "Black", *q), 0) >= 127.5]
        mean = sum(cov.get((p, i, *q), 0) for q in dark for i in inks[1:4]) / len(dark) / 255 * 100 / 3 if len(dark) >= 4 else None
        assert got[p, k].inks == sum(any(cov.get((p, i, *q), 0) > 63.75 for q in places) for i in inks)
        assert got[p, k].black_cmy == (mean if mean is None else pytest.approx(mean))
