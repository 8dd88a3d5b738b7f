"""Trapping of plates: who spreads under whom (R1 to R6), how far and how much (R7 to R11), and a log of what changed.

Every pair of a page's inks is worked at once: zones of possible traps are rows (page, pair, x, y), and
what limits them, distance, thickness, text, is joined by pixel.  Only the last rule, the cap on total
coverage, depends on the order of traps; it folds over the few traps that meet in one pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.operators import distance, plates as plate_rules, raster, windows

#: Coverage that is solid, share of colour under rich black, inks of the process, greatest lightness of a dark ink.
SOLID, RICH, COLOURS, DARK = 128, 0.3 * 255, ("Cyan", "Magenta", "Yellow"), 25.0


def pixels_of(mm: float, dpi: float) -> int:
    """Pixels that cover `mm`: none for nothing, one at least."""
    return 0 if mm <= 0 else max(math.ceil(mm * dpi / 25.4 - 1e-6), 1)


def _spread(rows: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in offsets))).alias("d")
    return rows.select("*", each).withColumns({"x": F.col("x") + F.col("d.dx"), "y": F.col("y") + F.col("d.dy")}).drop("d")


def zones(plates: DataFrame, decisions: DataFrame, rx: float, ry: float) -> DataFrame:
    """(page, spread, under, rule, reach, x, y, cov): where a pair's trap may lie, and the greatest coverage of the spreading ink in reach.

    `rx` and `ry` are pixels of a whole trap; a centred one has its share, rounded up.
    """
    on = plates.where(F.col("cov") >= SOLID).select("page", "ink", "x", "y")
    parts = []
    for fraction in (1.0, 0.5):
        kx, ky = (math.ceil(r * fraction - 1e-6) for r in (rx, ry))
        if max(kx, ky) < 1:
            continue
        some = decisions.where(F.col("fraction") == fraction).select("page", F.col("spread"), "under", "rule")
        kernel = raster.ellipse(kx, ky)
        reached = _spread(on.withColumnRenamed("ink", "spread"), kernel).distinct()
        under = on.select("page", F.col("ink").alias("under"), "x", "y")
        zone = some.join(reached, ["page", "spread"]).join(under, ["page", "under", "x", "y"])
        zone = zone.join(on.withColumnRenamed("ink", "spread"), ["page", "spread", "x", "y"], "left_anti")
        most = _spread(plates.select("page", F.col("ink").alias("spread"), "x", "y", "cov"), kernel).groupBy("page", "spread", "x", "y").agg(F.max("cov").alias("cov"))
        parts.append(zone.join(most, ["page", "spread", "x", "y"]).select("page", "spread", "under", "rule", F.lit(max(kx, ky)).alias("reach"), "x", "y", "cov"))
    if not parts:
        raise ValueError("a trap has a pixel at least")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def thin_limited(zone: DataFrame, plates: DataFrame, share: float, radius: int) -> DataFrame:
    """R8: a trap is at most `share` of the local thickness of the objects at the border, but a pixel.

    Under a thin dark object (R3, R4) only the spreading one counts, as the dark one covers the trap.
    Thickness is twice the greatest depth within `radius` pixels.
    """
    key = lambda ink: F.to_json(F.struct("page", F.col(ink).cast("string").alias("ink")))
    solid = plates.where(F.col("cov") >= SOLID).select("page", "ink", "x", "y")
    place = lambda df, ink: df.select(key(ink).alias("page"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    seeds = place(solid, "ink").withColumn("label", F.lit(0))
    away = distance.nearest_seeds(place(zone, "spread"), seeds).select(F.col("page").alias("_spread"), "x", "y", F.sqrt("square").alias("_away"))
    depth = distance.depths(place(solid, "ink"), ("page",)).select("page", "x", "y", F.sqrt("square").alias("depth"))
    asked = place(zone, "spread").unionByName(place(zone, "under")).distinct()
    both = asked.withColumn("_asked", F.lit(True)).join(depth, ["page", "x", "y"], "full")
    thick = windows.windowed(both, radius, {"_thick": (F.col("depth"), F.max)}).where("_asked").select("page", "x", "y", (2 * F.coalesce("_thick", F.lit(0.0))).alias("_thick"))
    of = lambda name: thick.select(F.col("page").alias(f"_{name}"), "x", "y", F.col("_thick").alias(f"_t{name}"))
    d = zone.withColumns({"_spread": key("spread"), "_under": key("under"), "x": F.col("x").cast("long"), "y": F.col("y").cast("long")})
    d = d.join(away, ["_spread", "x", "y"]).join(of("spread"), ["_spread", "x", "y"]).join(of("under"), ["_under", "x", "y"])
    most = F.when(F.col("rule").isin("R3", "R4"), F.col("_tspread")).otherwise(F.least("_tspread", "_tunder"))
    return d.where(F.col("_away") <= F.greatest(share * most, F.lit(1.0))).select(zone.columns)


def _folded(traps: Column, held: Column, cap: float | None) -> Column:
    """Coverages `held` of a pixel's inks and the traps that changed one, in the order of `traps`."""

    def step(s: Column, t: Column) -> Column:
        own = F.element_at(F.filter(s["held"], lambda h: h["ink"] == t["spread"]), 1)["cov"]
        total = F.aggregate(s["held"], F.lit(0.0), lambda n, h: n + F.when(h["ink"] == t["spread"], 0.0).otherwise(h["cov"]))
        room = F.lit(255.0) if cap is None else F.greatest(F.lit(cap) - total / 255.0 * 100.0, F.lit(0.0)) / 100.0 * 255.0
        new = F.greatest(own, F.floor(F.least(t["cov"], room)).cast("double"))
        held_ = F.transform(s["held"], lambda h: F.struct(h["ink"].alias("ink"), F.when(h["ink"] == t["spread"], new).otherwise(h["cov"]).alias("cov")))
        return F.struct(held_.alias("held"), F.when(new != own, F.concat(s["done"], F.array(t["order"]))).otherwise(s["done"]).alias("done"))

    return F.aggregate(traps, F.struct(held.alias("held"), F.array().cast("array<int>").alias("done")), step)


def trapped(plates: DataFrame, inks: DataFrame, rx: float, ry: float, *, factor: float = 1.0, thin: float | None = None, text: DataFrame | None = None, cap: float | None = 300.0, choke: int = 0, pullback: int = 0, centred_below: float = 8.0, opaque_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Plates (page, ink, x, y, cov) with traps, and the log (page, spread, under, rule, pixels).

    `inks` has page, ink, lightness, kind and opacity.  `thin` is the greatest share of an object's
    thickness (R8), `text` pixels (page, x, y) without traps (R9), `factor` the share of the spreading
    ink's own tone, so that gradients stay gradients (R10), `cap` the greatest total coverage in percent
    (R11), `choke` pixels by which white is drawn in (R2), and `pullback` pixels by which colours are
    drawn in under the edge of rich black (R7).
    """
    rules = plate_rules.trap_decisions(inks.withColumnRenamed("ink", "id"), centred_below, opaque_only)
    zone = zones(plates, rules, rx, ry)
    if thin:
        zone = thin_limited(zone, plates, thin, math.ceil(max(rx, ry) / thin) + 2)
    if text is not None:
        zone = zone.join(text.select("page", "x", "y").distinct(), ["page", "x", "y"], "left_anti")
    # traps of a page in order of their inks
    order = F.array_position("_all", F.struct("spread", "under")).cast("int")
    listed = rules.groupBy("page").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.least("spread", "under"), F.greatest("spread", "under"), "spread", "under"))), lambda r: F.struct(r["spread"].alias("spread"), r["under"].alias("under"))).alias("_all"))
    numbered = zone.join(listed, "page").select("page", "x", "y", F.struct(order.alias("order"), "spread", "under", "rule", F.floor(F.col("cov") * factor).cast("double").alias("cov")).alias("t"))
    meeting = numbered.groupBy("page", "x", "y").agg(F.array_sort(F.collect_list("t")).alias("_traps"))  # the traps of a pixel
    here = plates.groupBy("page", "x", "y").agg(F.collect_list(F.struct("ink", F.col("cov").cast("double").alias("cov"))).alias("_held"))
    with_all = meeting.join(here, ["page", "x", "y"])
    absent = F.filter(F.array_distinct(F.transform("_traps", lambda t: t["spread"])), lambda i: ~F.exists("_held", lambda h: h["ink"] == i))
    held = F.concat("_held", F.transform(absent, lambda i: F.struct(i.alias("ink"), F.lit(0.0).alias("cov"))))
    done = with_all.select("page", "x", "y", "_traps", _folded(F.col("_traps"), held, cap).alias("s")).checkpoint()
    kind = dict(plates.dtypes)["cov"]
    changed = done.select("page", "x", "y", F.explode("s.held").alias("h")).select("page", F.col("h.ink").alias("ink"), "x", "y", F.col("h.cov").cast(kind).alias("_new"))
    out = plates.select("page", "ink", "x", "y", "cov").join(changed, ["page", "ink", "x", "y"], "full").select("page", "ink", "x", "y", F.coalesce("_new", "cov").alias("cov"))
    made = done.select("page", F.explode(F.filter("_traps", lambda t: F.array_contains("s.done", t["order"]))).alias("t"))
    log = made.groupBy("page", F.col("t.spread").alias("spread"), F.col("t.under").alias("under"), F.col("t.rule").alias("rule")).agg(F.count("*").alias("pixels"))
    if choke:
        whites = plates.join(inks.where(F.col("kind") == "white").select("page", "ink"), ["page", "ink"])
        kept = raster.eroded(whites.where(F.col("cov") >= SOLID).select("page", "ink", "x", "y"), raster.ellipse(choke - 0.5, choke - 0.5), ("page", "ink"))
        gone = whites.where(F.col("cov") > 0).join(kept, ["page", "ink", "x", "y"], "left_anti").select("page", "ink", "x", "y")
        out, log = _without(out, gone, log, "white drawn in", "R2")
    if pullback and not opaque_only:
        out, log = _without(out, _edge_of_black(plates, inks, pullback), log, "edge of rich black", "R7")
    return out, log


def _edge_of_black(plates: DataFrame, inks: DataFrame, r: int) -> DataFrame:
    """(page, ink, x, y) of process colours along the edge of the black of pages that print colours under it."""
    black = inks.where((F.col("ink") == "Black") | ((F.col("kind") == "process") & (F.col("lightness") < DARK))).groupBy("page").agg(F.min_by("ink", F.struct(F.col("ink") != "Black", "ink")).alias("ink"))
    solid = plates.join(black, ["page", "ink"]).where(F.col("cov") >= SOLID).select("page", "x", "y")
    colours = plates.where(F.col("ink").isin(*COLOURS)).join(black.withColumnRenamed("ink", "_k"), "page").where("ink <> _k").drop("_k")
    rich = colours.join(solid, ["page", "x", "y"]).groupBy("page", "x", "y").agg(F.sum("cov").alias("n")).where(F.col("n") >= RICH).select("page").distinct()
    edge = solid.join(raster.eroded(solid, raster.ellipse(r - 0.5, r - 0.5)), ["page", "x", "y"], "left_anti").join(rich, "page", "left_semi")
    return colours.where(F.col("cov") > 0).join(edge, ["page", "x", "y"]).select("page", "ink", "x", "y")


def _without(plates: DataFrame, gone: DataFrame, log: DataFrame, under: str, rule: str) -> tuple[DataFrame, DataFrame]:
    """Plates with nothing at the places (page, ink, x, y) of `gone`, and the log with a row for each ink of a page."""
    d = plates.join(gone.withColumn("_gone", F.lit(True)), ["page", "ink", "x", "y"], "left")
    kinds = dict(log.dtypes)
    more = gone.groupBy("page", F.col("ink").alias("spread")).agg(F.count("*").alias("pixels")).select("page", F.col("spread").cast(kinds["spread"]).alias("spread"), F.lit(under).alias("under"), F.lit(rule).alias("rule"), "pixels")
    return d.withColumn("cov", F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("cov")).cast(dict(plates.dtypes)["cov"])).drop("_gone"), log.withColumn("under", F.col("under").cast("string")).unionByName(more)
