"""Calculator programs, tables of samples, ellipses, scan profiles and trapping against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewright.functions import calculator
from platewright.operators import geometry, profiles, trapping


def interpreted(words, stack):
    """A stack machine, word by word."""
    words = list(words)
    while words:
        w = words.pop(0)
        if w == "{":
            blocks = []
            while w == "{":
                depth, block = 1, []
                while depth:
                    x = words.pop(0)
                    depth += (x == "{") - (x == "}")
                    block.append(x)
                blocks.append(block[:-1])
                w = words.pop(0)
            test = stack.pop()
            if test:
                interpreted(blocks[0], stack)
            elif w == "ifelse":
                interpreted(blocks[1], stack)
            continue
        two = {
            "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0,
            "idiv": lambda a, b: float(int(a) // int(b)) if int(b) else 0.0, "mod": lambda a, b: float(int(a) % int(b)) if int(b) else 0.0,
            "exp": lambda a, b: a**b, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
            "eq": lambda a, b: float(a == b), "ne": lambda a, b: float(a != b), "gt": lambda a, b: float(a > b), "ge": lambda a, b: float(a >= b), "lt": lambda a, b: float(a < b), "le": lambda a, b: float(a <= b),
            "and": lambda a, b: float(int(a) & int(b)), "or": lambda a, b: float(int(a) | int(b)), "xor": lambda a, b: float(int(a) ^ int(b)), "bitshift": lambda a, b: float(int(a) << int(b) if b >= 0 else int(a) >> int(-b)),
        }
        one = {
            "neg": lambda a: -a, "abs": abs, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "cvi": math.trunc, "cvr": float, "sqrt": lambda a: math.sqrt(max(a, 0)),
            "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(max(a, 1e-12)), "log": lambda a: math.log10(max(a, 1e-12)), "not": lambda a: float(not a) if a in (0, 1) else float(~int(a)),
        }
        if w in two:
            b, a = stack.pop(), stack.pop()
            stack.append(two[w](a, b))
        elif w in one:
            stack.append(float(one[w](stack.pop())))
        elif w == "pop":
            stack.pop()
        elif w == "dup":
            stack.append(stack[-1])
        elif w == "exch":
            stack[-1], stack[-2] = stack[-2], stack[-1]
        elif w in ("true", "false"):
            stack.append(float(w == "true"))
        elif w == "copy":
            n = int(stack.pop())
            stack += stack[len(stack) - n :]
        elif w == "index":
            stack.append(stack[-1 - int(stack.pop())])
        elif w == "roll":
            j, n = int(stack.pop()), int(stack.pop())
            part = stack[len(stack) - n :]
            stack[len(stack) - n :] = part[-j % n :] + part[: -j % n] if n else []
        else:
            stack.append(float(w))
    return stack


PROGRAMS = [
    "{ dup 0.5 gt { 1 exch sub } { 2 mul } ifelse exch 360 mul sin abs add exch }",
    "3 1 roll 2 copy add 2 div 4 1 roll pop pop sub abs",
    "{ 255 mul cvi 16 idiv exch 255 mul 7 mod add exch 100 mul truncate 3 and or }",
    "2 index 2 index mul sqrt exch neg exch atan exch pop exch 2 exp add",
    "{ 2 copy lt { exch } if sub 2 -1 roll 10 mul floor not add }",
    "{ 20 mul round 2 bitshift exch 9 mul ceiling -1 bitshift xor exch 0.2 le { true } { false } ifelse sub }",
    "0 div exch ln add exch log mul 5 0 idiv add 4 0 mod add",
    "{ 0.3 ge { 0.7 lt { 1 } { 2 } ifelse } { pop 3 } ifelse exch pop }",
    "1.5 2 3 3 copy pop pop pop eq { 4 } { 5 } ifelse 5 3 roll",
]


def test_calculator_programs(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.choice([0.0, 0.25, 0.5, 1.0]), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    wide = [(-1e6, 1e6)]
    made = [calculator.calculated(p, [F.col(c) for c in "abc"], [(0, 1)] * 3, wide)[-1].alias(f"p{k}") for k, p in enumerate(PROGRAMS)]
    for r, (_, a, b, c) in zip(df.select("id", *made).orderBy("id").collect(), rows, strict=True):
        for k, p in enumerate(PROGRAMS):
            words = p.replace("{", " { ").replace("}", " } ").split()
            words = words[1:-1] if words[0] == "{" and words[-1] == "}" else words
            assert r[f"p{k}"] == pytest.approx(interpreted(words, [a, b, c])[-1], abs=1e-9), (p, a, b, c)


def test_programs_that_have_no_value(spark):
    x = [F.lit(0.5)]
    for p in ("add", "{ 1", "1 }", "{ 1 } 2", "what", "0.5 gt { 1 } { 1 2 } ifelse", "dup copy", "1 { 2 }"):
        with pytest.raises(calculator.ProgramError):
            calculator.calculated(p, x, [(0, 1)], [(0, 1)])
    with pytest.raises(calculator.ProgramError):
        calculator.calculated("pop", x, [(0, 1)], [(0, 1)])
    (r,) = spark.range(1).select(*(c.alias(f"v{i}") for i, c in enumerate(calculator.calculated("4 exch", [F.lit(7.0)], [(0, 1)], [(0, 3), (0, 0.25)])))).collect()
    assert (r.v0, r.v1) == (3.0, 0.25)


def test_tables_of_samples(spark):
    rng = random.Random(2)
    sizes, outputs = [3, 4, 2], 2
    table = [float(rng.randrange(256)) for _ in range(math.prod(sizes) * outputs)]
    domain, range_ = [(0, 1), (-1, 1), (0, 2)], [(0, 1), (-5, 5)]
    rows = [(i, rng.uniform(-0.2, 1.2), rng.uniform(-1.2, 1.2), rng.uniform(0, 2)) for i in range(40)] + [(40, 0.5, 1.0, 2.0), (41, 1.0, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    made = calculator.tabulated(F.array(*map(F.lit, table)), [F.col(c) for c in "abc"], sizes, domain, range_)
    for r, row in zip(df.select("id", *(c.alias(f"v{k}") for k, c in enumerate(made))).orderBy("id").collect(), rows, strict=True):
        at = [min(max((min(max(v, lo), hi) - lo) / (hi - lo), 0), 1) * (n - 1) for v, (lo, hi), n in zip(row[1:], domain, sizes, strict=True)]
        for k in range(outputs):
            total = 0.0
            for x in range(3):
                for y in range(4):
                    for z in range(2):
                        w = max(0, 1 - abs(at[0] - x)) * max(0, 1 - abs(at[1] - y)) * max(0, 1 - abs(at[2] - z))
                        total += w * table[(x + 3 * y + 12 * z) * outputs + k]
            lo, hi = range_[k]
            assert r[f"v{k}"] == pytest.approx(lo + total * (hi - lo) / 255, abs=1e-9)


def test_ellipses(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k in range(8):
        a, b, angle, cx, cy = rng.uniform(20, 40), rng.uniform(5, 18), rng.uniform(0, math.pi), *rng.uniform(-50, 50, 2)
        t = rng.uniform(0, 2 * math.pi, 60)
        off = rng.normal(0, (0, 0.3)[k % 2], (60, 2))
        x, y = cx + a * np.cos(t) * math.cos(angle) - b * np.sin(t) * math.sin(angle) + off[:, 0], cy + a * np.cos(t) * math.sin(angle) + b * np.sin(t) * math.cos(angle) + off[:, 1]
        rows += [(k, i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))]
        want[k] = (cx, cy, a, b, angle, np.stack([x, y], 1))
    rows += [(20, i, float(i), 2.0 * i + 1) for i in range(30)] + [(21, i, float(i), 0.0) for i in range(5)] + [(22, i, i * 0.1, float(i % 2)) for i in range(11)]
    got = {r.chain: r for r in geometry.fitted_ellipses(spark.createDataFrame(rows, "chain int, pos int, x double, y double")).collect()}
    assert set(got) == set(want)
    for k, (cx, cy, a, b, angle, pts) in want.items():
        r = got[k]
        near = 1e-6 if k % 2 == 0 else 1.0
        assert (r.cx, r.cy, r.a, r.b) == pytest.approx((cx, cy, a, b), abs=near)
        assert abs(math.sin(r.angle - angle)) < (1e-6 if k % 2 == 0 else 0.05)
        t = np.linspace(0, 2 * math.pi, 20000)
        ring = np.stack([r.cx + r.a * np.cos(t) * math.cos(r.angle) - r.b * np.sin(t) * math.sin(r.angle), r.cy + r.a * np.cos(t) * math.sin(r.angle) + r.b * np.sin(t) * math.cos(r.angle)], 1)
        far = max(np.hypot(*(ring - p).T).min() for p in pts)
        assert r.error == pytest.approx(far, abs=0.01)


def bars(widths, module, light, dark, blur, quiet):
    """A band of a bar code as values 0 to 255, bars first, with edges between pixels."""
    edges = np.cumsum([quiet * module, *(w * module for w in widths), quiet * module])
    n = math.ceil(edges[-1])
    fine = np.full(n * 10, light, float)
    for i in range(0, len(widths), 2):
        fine[round(edges[i] * 10) : round(edges[i + 1] * 10)] = dark
    kernel = np.ones(max(1, round(blur * 10)))
    return np.convolve(np.pad(fine, 50, mode="edge"), kernel / len(kernel), mode="same")[50:-50].reshape(-1, 10).mean(1)


def test_scan_profiles(spark):
    rng = random.Random(4)
    widths = [rng.choice([1, 1, 2, 3, 4]) for _ in range(58)]
    widths.append(95 - sum(widths) if 0 < 95 - sum(widths) < 5 else 1)
    total = sum(widths)
    cases = {"a": (3.3, 250, 10, 1.0), "b": (3.3, 250, 120, 1.0), "c": (2.6, 250, 10, 3.0)}
    rows = []
    for code, (module, light, dark, blur) in cases.items():
        band = bars(widths, module, light, dark, blur, 10)
        rows += [(code, x, y, float(v)) for x, v in enumerate(band) for y in range(3)]
    rows += [("even", x, 0, 200.0) for x in range(50)]
    pixels = spark.createDataFrame(rows, "code string, x int, y int, value double")
    kinds = spark.createDataFrame([("a", "none"), ("b", "none"), ("c", "none"), ("even", "none")], "code string, kind string")
    got = {r.code: r for r in profiles.graded(profiles.figures(pixels, kinds)).collect()}
    assert set(got) == set(cases) | {"even"} and got["even"].contrast == 0 and got["even"].grade == "F"
    for code, (module, *_) in cases.items():
        assert got[code].left == pytest.approx(10 * module / got[code].module, rel=0.1) and got[code].right == pytest.approx(got[code].left, rel=0.1)
    assert got["a"].module == pytest.approx(3.3, rel=0.2) and got["a"].modulation > 0.75 and got["a"].grade in "AB"
    assert got["b"].contrast < got["a"].contrast - 0.1 and got["c"].modulation < 0.7 < got["a"].modulation and got["c"].grade > got["a"].grade
    # a known symbol takes the module from its whole width
    whole = profiles.figures(pixels.where("code = 'a'"), spark.createDataFrame([("a", "ean13")], "code string, kind string")).first()
    assert whole.module == pytest.approx(3.3 * total / 95, abs=0.02)
    # elements end between pixels
    parts = profiles.elements(profiles.marked(profiles.profile(pixels.where("code = 'a'")))).orderBy("part").collect()
    assert len(parts) == len(widths) + 2 and [p.on for p in parts[1:-1]] == [i % 2 == 0 for i in range(len(widths))]
    assert all(p.end - p.start == pytest.approx(w * 3.3, abs=0.75) for p, w in zip(parts[1:-1], widths, strict=True))


def ellipse_offsets(rx, ry):
    ax, ay = rx + 0.5, ry + 0.5
    return [(x, y) for x in range(-math.ceil(ax), math.ceil(ax) + 1) for y in range(-math.ceil(ay), math.ceil(ay) + 1) if (x / ax) ** 2 + (y / ay) ** 2 <= 1 + 1e-9]


def trapped_by_hand(plates, rules, r, thin, text, cap, factor):
    """Plates as {ink: array} after the rules in order, and the log."""
    h, w = next(iter(plates.values())).shape
    solid = {i: a >= 128 for i, a in plates.items()}
    now, log = {i: a.astype(float) for i, a in plates.items()}, {}
    ys, xs = np.mgrid[:h, :w]

    def depth(m):
        inside = np.pad(m, 1)
        out = np.argwhere(~inside) - 1
        return np.array([[math.sqrt(((out - (y, x)) ** 2).sum(1).min()) if m[y, x] else 0 for x in range(w)] for y in range(h)])

    window = math.ceil(r / thin) + 2 if thin else 0
    deep = {i: depth(m) for i, m in solid.items()} if thin else {}
    thick = {i: np.array([[2 * d[max(0, y - window) : y + window + 1, max(0, x - window) : x + window + 1].max() for x in range(w)] for y in range(h)]) for i, d in deep.items()}
    for a, b, fraction, rule in rules:
        k = math.ceil(r * fraction)
        offsets = ellipse_offsets(k, k)
        changed = 0
        for y, x in zip(ys.ravel(), xs.ravel(), strict=True):
            near = [(y - dy, x - dx) for dx, dy in offsets if 0 <= y - dy < h and 0 <= x - dx < w]
            if not (solid[b][y, x] and not solid[a][y, x] and any(solid[a][q] for q in near)) or (x, y) in text:
                continue
            if thin:
                away = math.sqrt(min(((y - q[0]) ** 2 + (x - q[1]) ** 2) for q in np.argwhere(solid[a])))
                most = thick[a][y, x] if rule in ("R3", "R4") else min(thick[a][y, x], thick[b][y, x])
                if away > max(thin * most, 1):
                    continue
            value = math.floor(max(plates[a][q] for q in near) * factor)
            room = max(cap - sum(v[y, x] for i, v in now.items() if i != a) / 255 * 100, 0) / 100 * 255
            new = max(now[a][y, x], math.floor(min(value, room)))
            changed += new != now[a][y, x]
            now[a][y, x] = new
        if changed:
            log[a, b, rule] = changed
    return now, log


@pytest.mark.parametrize(("r", "thin", "with_text", "cap", "factor"), [(1, None, False, 300.0, 1.0), (3, None, True, 170.0, 0.8), (3, 0.5, False, 250.0, 1.0)])
def test_trapping(spark, r, thin, with_text, cap, factor):
    n = 22
    y, x = np.mgrid[:n, :n]
    yellow = np.where((x < 11) & (y > 3), 255, 0)
    blue = np.where((x >= 11) & (y > 3), 240, 0)
    black = np.where((y <= 3) | ((abs(x - 16) < 1) & (y > 8)), 255, 0)
    pale = np.where((y > 14) & (x < 8), 130 + 4 * x, 0)
    plates = {"Black": black, "Blue": blue, "Pale": pale, "Yellow": yellow}
    rows = [(1, i, int(q), int(p), int(a[p, q])) for i, a in plates.items() for p in range(n) for q in range(n) if a[p, q] or (p + q) % 3 == 0]
    inks = [(1, "Black", 5.0, "process", 0.0), (1, "Blue", 40.0, "spot", 0.0), (1, "Pale", 86.0, "spot", 0.0), (1, "Yellow", 90.0, "spot", 0.0)]
    # R3: the other under black; R4: the lighter under the darker; R5: yellow and pale share
    rules = [("Blue", "Black", 1.0, "R3"), ("Pale", "Black", 1.0, "R3"), ("Yellow", "Black", 1.0, "R3"), ("Pale", "Blue", 1.0, "R4"), ("Yellow", "Blue", 1.0, "R4"), ("Pale", "Yellow", 0.5, "R5"), ("Yellow", "Pale", 0.5, "R5")]
    text = {(a, b) for a in range(9, 14) for b in range(6, 9)} if with_text else set()
    want, log = trapped_by_hand(plates, rules, r, thin, text, cap, factor)
    df = spark.createDataFrame(rows, "page int, ink string, x int, y int, cov int")
    marks = spark.createDataFrame([(1, a, b) for a, b in text], "page int, x int, y int") if text else None
    out, said = trapping.trapped(df, spark.createDataFrame(inks, "page int, ink string, lightness double, kind string, opacity double"), r, r, thin=thin, text=marks, cap=cap, factor=factor)
    got = {i: np.zeros((n, n)) for i in plates}
    for row in out.collect():
        got[row.ink][row.y, row.x] = row.cov
    assert all((got[i] == want[i]).all() for i in plates)
    assert {(s.spread, s.under, s.rule): s.pixels for s in said.collect()} == log and log


def test_choke_and_pullback(spark):
    n = 12
    rows = [(1, i, x, y, c) for x in range(n) for y in range(n) for i, c in (("White", 255), ("Black", 255 if 2 <= x <= 9 else 0), ("Cyan", 200), ("Spot", 10))]
    inks = [(1, "White", 96.0, "white", 1.0), (1, "Black", 5.0, "process", 0.0), (1, "Cyan", 55.0, "process", 0.0), (1, "Spot", 60.0, "spot", 0.0)]
    out, log = trapping.trapped(spark.createDataFrame(rows, "page int, ink string, x int, y int, cov int"), spark.createDataFrame(inks, "page int, ink string, lightness double, kind string, opacity double"), 1, 1, choke=1, pullback=1)
    got = {(r.ink, r.x, r.y): r.cov for r in out.collect()}
    assert all(got["White", x, y] == (255 if 0 < x < n - 1 and 0 < y < n - 1 else 0) for x in range(n) for y in range(n))
    edge = {(x, y) for x in range(2, 10) for y in range(n) if x in (2, 9) or y in (0, n - 1)}
    assert all((got["Cyan", x, y] == 0) == ((x, y) in edge) for x in range(n) for y in range(n))
    assert {(r.spread, r.under, r.rule): r.pixels for r in log.collect() if r.rule in ("R2", "R7")} == {("White", "white drawn in", "R2"): 44, ("Cyan", "edge of rich black", "R7"): len(edge)}
    assert trapping.pixels_of(0, 300) == 0 and trapping.pixels_of(0.01, 300) == 1 and trapping.pixels_of(0.2, 254) == 2


def test_nearest_samples_are_those_of_the_full_search(spark):
    from platewright.operators import fitting

    rng = np.random.default_rng(6)
    samples = [([float(i)], *map(float, rng.normal((60, 0, 0), (15, 20, 30)))) for i in range(400)]
    wanted = [(i, *map(float, rng.uniform((0, -120, -120), (100, 120, 120)))) for i in range(60)]
    df = spark.createDataFrame(samples, "t array<double>, mL double, ma double, mb_ double")
    for top in (5, 500):
        got = {}
        for r in fitting.nearest_samples(spark.createDataFrame(wanted, "code int, L double, a double, b_ double"), df, top).collect():
            got.setdefault(r.code, []).append((r.k, r.t, r.d))
        for code, *lab in wanted:
            order = sorted((math.dist(lab, s[1:]), s[0]) for s in samples)[:top]
            own = sorted(got[code])
            assert [t for _, t, _ in own] == [t for _, t in order] and [d for *_, d in own] == pytest.approx([d for d, _ in order])
