"""Fits by grids and clustering: calibration of inks, recipes of a colour, palettes, parameter searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import colour

STEPS = [10, 20, 30, 40, 50, 60, 70, 80, 90]


def ramp(inks: DataFrame, n: float | Column) -> DataFrame:
    """Lab of the steps of inks (ink, L, a, b of the solid, gain) printed on paper: adds step, mL, ma, mb_."""
    t = F.col("step") / 100.0
    held = F.least(F.greatest(t + F.col("gain") * 4 * t * (1 - t), F.lit(0.0)), F.lit(1.0))
    rows = inks.select("*", F.explode(F.array(*map(F.lit, [*STEPS, 100]))).alias("step"))
    rows = rows.withColumn("_inks", F.array(F.struct("L", "a", "b", F.lit(0.0).alias("opacity"), held.alias("cov"))))
    return colour.with_mixture(rows, "_inks", n=n).drop("_inks")


def fitted(measured: DataFrame, exponents: list[float] | None = None, gains: list[float] | None = None) -> DataFrame:
    """(ink, n, gain, error) of measured ramps (ink, step, L, a, b): the common exponent and each ink's gain of least mean CIEDE2000.

    A grid of both is crossed with the few patches; `measured` has the solids at step 100.
    """
    exponents, gains = exponents or [1.0 + 0.2 * i for i in range(11)], gains or [round(-0.2 + 0.02 * i, 4) for i in range(31)]
    solids = measured.where("step = 100").select("ink", "L", "a", "b")
    grid = solids.select("*", F.explode(F.array(*map(F.lit, gains))).alias("gain")).select("*", F.explode(F.array(*(F.lit(round(n, 3)) for n in exponents))).alias("n"))
    seen = measured.where("step between 1 and 99").select("ink", "step", F.col("L").alias("L2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    made = ramp(grid, F.col("n")).join(seen, ["ink", "step"])
    parts = colour.with_delta_e2000(made, ("mL", "ma", "mb_"), ("L2", "a2", "b2")).groupBy("ink", "n", "gain").agg(F.avg("de").alias("error"))
    best = parts.groupBy("ink", "n").agg(F.min_by("gain", F.struct("error", "gain")).alias("gain"), F.min("error").alias("error"))
    common = best.groupBy("n").agg(F.avg("error").alias("mean")).agg(F.min_by("n", F.struct("mean", "n")).alias("n"))
    return best.join(F.broadcast(common), "n").select("ink", "n", "gain", "error")  # one row


def calibrated(inks: DataFrame, profile: DataFrame) -> DataFrame:
    """Inks (ink, L, a, b) with the Lab and gain of a profile where it has them."""
    p = profile.select("ink", *(F.col(c).alias(f"_{c}") for c in ("L", "a", "b", "gain")))
    return inks.join(p, "ink", "left").select("ink", *(F.coalesce(f"_{c}", c).alias(c) for c in ("L", "a", "b")), F.coalesce("_gain", F.lit(0.0)).alias("gain"))


def recipes(targets: DataFrame, inks: list[tuple[str, float, float, float]], most: int = 3, levels: list[float] | None = None, penalty: float = 0.4) -> DataFrame:
    """(name, recipe map of percentages, de, light) of targets (name, L, a, b): the best mixture of at most `most` inks.

    Two passes over a grid: coverages in steps of a fifth, then finer steps around the best of each choice
    of inks.  Every ink beyond the first costs `penalty`.  A full grid of coverages is an array of each
    target, so nothing is joined and a target stays one task's row.
    """
    import itertools

    levels = levels or [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    choices = [c for k in range(1, min(most, len(inks)) + 1) for c in itertools.combinations(range(len(inks)), k)]

    def mixed(df: DataFrame) -> DataFrame:
        at = F.array(*(F.struct(F.lit(float(L)).alias("L"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(0.0).alias("opacity"), F.coalesce(F.try_element_at("t", F.lit(i + 1)), F.lit(0.0)).alias("cov")) for i, (_, L, a, b) in enumerate(inks)))
        df = colour.with_mixture(df.withColumn("_inks", at), "_inks")
        active = F.size(F.filter("t", lambda v: v > 0.02))
        return colour.with_delta_e2000(df, ("mL", "ma", "mb_"), ("L", "a", "b")).withColumn("score", F.col("de") + penalty * F.greatest(active - 1, F.lit(0)))

    def best(df: DataFrame) -> DataFrame:
        return df.groupBy("name", "L", "a", "b").agg(F.min_by(F.struct("t", "de"), F.struct("score", "t")).alias("m")).select("name", "L", "a", "b", "m.t", "m.de")

    grids = [tuple(x) for c in choices for x in itertools.product(*[levels[1:] if i in c else [0.0] for i in range(len(inks))])]
    first = best(mixed(targets.select("name", "L", "a", "b", F.explode(F.array(*(F.array(*map(F.lit, g)) for g in grids))).alias("t"))))
    for width in (0.1, 0.05, 0.025, 0.01):
        moves = list(itertools.product((-width, 0.0, width), repeat=len(inks)))
        near = F.transform(F.array(*(F.array(*map(F.lit, m)) for m in moves)), lambda m: F.zip_with("t", m, lambda t, d: F.when(t > 0, F.least(F.greatest(t + d, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)))
        first = best(mixed(first.select("name", "L", "a", "b", F.explode(F.array_distinct(near)).alias("t"))).drop("de_"))
    names = F.array(*(F.lit(n) for n, *_ in inks))
    shown = F.map_filter(F.map_from_arrays(names, F.transform("t", lambda v: F.round(v * 100, 1))), lambda _, v: v > 2)
    return first.select("name", shown.alias("recipe"), F.round("de", 2).alias("de"), colour.light(F.col("de")).alias("light"))


def palette(points: DataFrame, k: int = 12, merge: float = 6.0, least: float = 0.004, seed: int = 0) -> DataFrame:
    """(i, L, a, b, share) of points (L, a, b): k-means centres, those closer than `merge` put together by weight, small ones left out.

    The clustering is distributed; its dozen centres are merged on the driver.
    """
    vectors = VectorAssembler(inputCols=["L", "a", "b"], outputCol="v").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="v", maxIter=30).fit(vectors)
    sizes = {r["prediction"]: float(r["count"]) for r in model.transform(vectors).groupBy("prediction").count().collect()}
    spark, total = points.sparkSession, sum(sizes.values())
    held = [(sizes[i], *map(float, c)) for i, c in enumerate(model.clusterCenters()) if i in sizes]
    while len(held) > 1:
        rows = [(i, j, *held[i][1:], *held[j][1:]) for i in range(len(held)) for j in range(i + 1, len(held))]
        pairs = spark.createDataFrame(rows, "i int, j int, L double, a double, b double, L2 double, a2 double, b2 double")
        near = colour.with_delta_e2000(pairs, ("L", "a", "b"), ("L2", "a2", "b2")).where(F.col("de") < merge).orderBy("i", "j").first()
        if near is None:
            break
        one, two = held[near["i"]], held.pop(near["j"])
        n = one[0] + two[0]
        held[near["i"]] = (n, *((x * one[0] + y * two[0]) / n for x, y in zip(one[1:], two[1:], strict=True)))
    kept = sorted((h for h in held if h[0] / total >= least), reverse=True)
    return spark.createDataFrame([(i, *h[1:], h[0] / total) for i, h in enumerate(kept)], "i int, L double, a double, b double, share double")


def ink_samples(inks: int, levels: int, extra: int, seed: int, spark) -> DataFrame:
    """(id, t array): a regular grid of coverages and sparse random ones, the same for a seed."""
    total = levels**inks
    place = lambda i: (F.floor(F.col("id") / levels ** (inks - 1 - i)) % levels) / float(levels - 1)
    grid = spark.range(total).select("id", F.array(*(place(i) for i in range(inks))).alias("t"))
    draw = lambda i, salt: (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i), F.lit(salt)), F.lit(1 << 20))) / float(1 << 20)
    sparse = spark.range(extra).select((F.col("id") + total).alias("id"), F.array(*(F.when(draw(i, 1) < 0.6, F.pow(draw(i, 0), F.lit(1.5))).otherwise(0.0) for i in range(inks))).alias("t"))
    return grid.unionByName(sparse)


def quantised(pixels: DataFrame) -> DataFrame:
    """Adds `code`, five bits of each channel, so that each colour is solved once."""
    five = lambda c: F.shiftright(c, 3)
    return pixels.withColumn("code", F.shiftleft(five("r"), 10) + F.shiftleft(five("g"), 5) + five("b"))


def nearest_samples(wanted: DataFrame, mixed: DataFrame, top: int, cell: float = 4.0) -> DataFrame:
    """(code, t, d, k): the `top` samples (t, mL, ma, mb_) nearest to each colour (code, L, a, b_), by distance and t.

    Samples lie in cells; a colour looks at its own and the 26 around it, which hold every sample within
    a cell's side.  Colours that have not found `top` within that go on with cells of twice the side.
    """
    axes = (("L", "mL"), ("a", "ma"), ("b_", "mb_"))
    size, open_, done = float(cell), wanted.checkpoint(), None
    mixed = mixed.checkpoint()
    while True:
        place = lambda c: F.floor(F.col(c) / size).cast("int")  # noqa: E731, B023
        cells = mixed.withColumns({f"_{k}": place(m) for k, (_, m) in enumerate(axes)})
        steps = F.explode(F.sequence(F.lit(-1), F.lit(1)))
        asked = open_
        for k, (c, _) in enumerate(axes):
            asked = asked.withColumn("_s", steps).withColumn(f"_{k}", place(c) + F.col("_s")).drop("_s")
        d = F.sqrt(sum((F.pow(F.col(c) - F.col(m), F.lit(2)) for c, m in axes[1:]), F.pow(F.col("L") - F.col("mL"), F.lit(2))))
        near = asked.join(cells, ["_0", "_1", "_2"]).select("code", "t", d.alias("d"))
        found = near.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("d", "t"))).where(F.col("k") <= top).checkpoint()
        last = size > 1024  # no two colours are that far from each other
        whole = found.groupBy("code").agg(F.count_if(F.lit(last) | (F.col("d") <= size)).alias("n")).where((F.col("n") >= top) | F.lit(last)).select("code")
        kept = found.join(whole, "code", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        open_ = open_.join(whole, "code", "left_anti").checkpoint()
        if last or not open_.take(1):
            return done
        size *= 2


def separated(pixels: DataFrame, inks: list[tuple[str, float, float, float]], samples: DataFrame, cost: float = 4.0, top: int = 24) -> DataFrame:
    """Pixels (page, x, y, r, g, b) with coverages `t` of inks: the mixture of samples (id, t) near their colour that takes least ink.

    Distinct colours (at most 32,768) look for samples in the cells around them.
    """
    at = F.array(*(F.struct(F.lit(float(L)).alias("L"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(0.0).alias("opacity"), F.element_at("t", i + 1).alias("cov")) for i, (_, L, a, b) in enumerate(inks)))
    mixed = colour.with_mixture(samples.withColumn("_inks", at), "_inks").select("t", "mL", "ma", "mb_")
    coded = quantised(pixels)
    middle = lambda shift: (F.pmod(F.shiftright("code", shift), F.lit(32)) * 8 + 4)
    wanted = colour.with_lab(coded.select("code").distinct().withColumns({"_r": middle(10), "_g": middle(5), "_b": middle(0)}), "_r", "_g", "_b").select("code", "L", "a", "b_")
    ink = F.aggregate("t", F.lit(0.0), lambda s, v: s + v)
    ranked = nearest_samples(wanted, mixed, top)
    best = ranked.groupBy("code").agg(F.min_by(F.struct("t", "d"), F.struct(F.col("d") + cost * ink * 0.5, F.col("k"))).alias("m"))
    return coded.join(best, "code").select("page", "x", "y", "m.t", F.col("m.d").alias("de"))


def evaluated(scores: DataFrame) -> DataFrame:
    """(params, cer): mean error of each setting over its samples (params, cer), 1 without any."""
    return scores.groupBy("params").agg(F.coalesce(F.avg("cer"), F.lit(1.0)).alias("cer"))


def holdout(samples: DataFrame, every: int = 3) -> DataFrame:
    """Samples (case, ...) with `held` for one in `every` cases, by a hash of the case: a case is wholly held or not."""
    return samples.withColumn("held", F.pmod(F.xxhash64("case"), F.lit(every)) == 0)


def adopted(scores: DataFrame, current: str, relative: float = 0.05, absolute: float = 0.003) -> DataFrame:
    """(params, cer, base): the best setting on held-out samples (params, held, cer), if it gains enough over the current one."""
    best = evaluated(scores.where("not held")).agg(F.min_by("params", F.struct("cer", "params")).alias("params"))
    test = evaluated(scores.where("held"))
    base = test.where(F.col("params") == current).select(F.col("cer").alias("base"))
    one = test.join(F.broadcast(best), "params").join(F.broadcast(base))  # one row each
    gain = F.col("base") - F.col("cer")
    return one.where((gain >= absolute) & (gain >= relative * F.col("base")))


def sampled(lines: DataFrame, boxes: DataFrame, per_case: int = 8, per_kind: int = 45) -> DataFrame:
    """Lines (case, kind, page, id, x, y, w, h) free of error boxes: some of each case and kind, in order of hash.

    The numbers are the feature: tuning takes a fixed sample.
    """
    from platewright.operators import spatial

    hit = spatial.overlaps(lines, boxes).select("l.page", F.col("l.id").alias("id")).distinct()
    free = lines.join(hit, ["page", "id"], "left_anti").withColumn("_h", F.xxhash64("case", "page", "id"))
    a = free.withColumn("_k", F.row_number().over(Window.partitionBy("case").orderBy("_h", "id"))).where(F.col("_k") <= per_case)
    return a.withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy("_h", "id"))).where(F.col("_k") <= per_kind).drop("_h", "_k")


def trials(options: dict[str, list], current: dict) -> list[dict]:
    """Settings that differ from `current` in one option."""
    return [{**current, key: v} for key, values in options.items() for v in values if v != current[key]]


def searched(samples: DataFrame, options: dict[str, list], current: dict, score: Callable[[DataFrame, DataFrame], DataFrame], *, rounds: int = 2, gain: float = 0.002, rungs: int = 3) -> tuple[dict, float, float, int]:
    """The best setting by coordinates, its mean cost, that of `current`, and how many settings met samples.

    `score(settings, samples)` gives (setting, cost) of every setting (setting, params map) on every sample
    (case, ...); settings are a few dozen.  A round tries all settings that differ from the best one in
    one option, by successive halving: on each rung all that are left are scored in one job, on a share of
    the cases (by hash) that doubles up to all of them, and the better half goes on.
    """
    spark, runs = samples.sparkSession, 0
    draw = F.pmod(F.xxhash64("case", F.lit(7)), F.lit(1 << rungs))

    def costs(settings: list[dict], part: DataFrame) -> list[float]:
        nonlocal runs
        runs += len(settings)
        rows = spark.createDataFrame([(i, {k: str(v) for k, v in s.items()}) for i, s in enumerate(settings)], "setting int, params map<string,string>")
        mean = {r.setting: r.cost for r in score(rows, part).groupBy("setting").agg(F.avg("cost").alias("cost")).collect()}  # a row for each setting
        return [mean.get(i, 1.0) for i in range(len(settings))]

    best, (cost,) = dict(current), costs([current], samples)
    first = cost
    for _ in range(rounds):
        left = trials(options, best)
        for rung in range(rungs, 0, -1):
            part = samples.where(draw < (1 << rungs >> rung))
            order = sorted(range(len(left)), key=costs(left, part).__getitem__) if len(left) > 1 else range(len(left))
            left = [left[i] for i in list(order)[: max(1, -(-len(left) // 2))]]
        if not left:
            break
        found = costs(left, samples)
        at = min(range(len(left)), key=found.__getitem__)
        if found[at] >= cost - gain:
            break
        best, cost = left[at], found[at]
    return best, cost, first, runs


def tuned(samples: DataFrame, options: dict[str, list], current: dict, score: Callable[[DataFrame, DataFrame], DataFrame], guard: Callable[[DataFrame, DataFrame], DataFrame], *, every: int = 3, relative: float = 0.05, absolute: float = 0.003, slack: float = 0.02) -> dict:
    """Search on two thirds of the cases, and what the held-out third says: adopted or not, with all figures.

    A setting is adopted if it gains enough on cases that the search did not see, and if the second
    metric, `guard(settings, samples)` with (setting, errors, cost), has no more errors there and no cost
    beyond `slack` more: both settings are scored in one job.
    """
    parted = holdout(samples, every)
    train, held = parted.where(~F.col("held")).drop("held"), parted.where("held").drop("held")
    best, cost, first, runs = searched(train, options, current, score)
    out = {"params": best, "train_before": first, "train_after": cost, "runs": runs, "adopted": False, "guard": None}
    if best == current:
        return out
    rows = held.sparkSession.createDataFrame([(i, {k: str(v) for k, v in s.items()}) for i, s in enumerate((current, best))], "setting int, params map<string,string>")
    mean = {r.setting: r.cost for r in score(rows, held).groupBy("setting").agg(F.avg("cost").alias("cost")).collect()}
    before, after = mean.get(0, 1.0), mean.get(1, 1.0)
    out |= {"held_before": before, "held_after": after}
    if after > before * (1 - relative) or before - after < absolute:
        return out
    both = {r.setting: (r.errors, r.cost) for r in guard(rows, held).groupBy("setting").agg(F.sum("errors").alias("errors"), F.avg("cost").alias("cost")).collect()}
    worse = 0 not in both or 1 not in both or both[1][0] > both[0][0] or (both[0][1] is not None and both[1][1] is not None and both[1][1] > both[0][1] * (1 + slack))
    return out | {"guard": both, "adopted": not worse}
