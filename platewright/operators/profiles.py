"""Scan profiles of bar codes: reflectance along the bars, its elements, and the figures that grade a symbol.

A profile is the mean of a band's pixels at each place, and an element a stretch above or below the
middle between light and dark.  Elements come from windows over the places of a code; what is asked of
an element, its middle level and how uneven it is, and of a code are aggregates, so codes of any
number are graded at once and no pixel is seen twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions import codes, colour

#: Modules of a whole symbol.
MODULES = {"ean13": 95, "ean8": 67, "upca": 95, "upce": 51}


def profile(pixels: DataFrame) -> DataFrame:
    """(code, x, level): mean reflectance, 0 to 1, of a band's pixels (code, x, y, value 0 to 255) at each place."""
    mean = F.avg("value") / 255.0
    return pixels.groupBy("code", "x").agg(colour.linear(mean).alias("level"))


def limits(profiled: DataFrame) -> DataFrame:
    """(code, light, dark, middle): 97th and 3rd percentile of a profile, and the middle between them."""
    ends = profiled.groupBy("code").agg(F.percentile("level", F.lit(0.97)).alias("light"), F.percentile("level", F.lit(0.03)).alias("dark"))
    return ends.withColumn("middle", (F.col("light") + F.col("dark")) / 2)


def marked(profiled: DataFrame) -> DataFrame:
    """Profile places with the code's limits, `on` (dark), the number `part` of their element, and `edge`, where the profile crosses the middle before the element's first place."""
    w = Window.partitionBy("code").orderBy("x")
    d = profiled.join(limits(profiled), "code").withColumn("on", F.col("level") < F.col("middle"))
    d = d.withColumns({"_before": F.lag("level").over(w), "_px": F.lag("x").over(w), "_new": F.coalesce((F.col("on") != F.lag("on").over(w)).cast("int"), F.lit(0))})
    crossing = F.col("_px") + (F.col("middle") - F.col("_before")) / (F.col("level") - F.col("_before")) * (F.col("x") - F.col("_px"))
    return d.withColumns({"part": F.sum("_new").over(w), "edge": F.when(F.col("_new") == 1, crossing)}).drop("_before", "_px", "_new")


def elements(marks: DataFrame) -> DataFrame:
    """(code, part, on, x0, n, start, end, level, spread): elements in order, between their crossings; the level is the median of the middle half, `spread` that half's range.

    The first and the last element are cut by the band's ends: they have no start or end.
    """
    one = Window.partitionBy("code", "part").orderBy("x")
    d = marks.withColumns({"_i": F.row_number().over(one) - 1, "_n": F.count("*").over(Window.partitionBy("code", "part"))})
    quarter = F.floor(F.col("_n") / 4)
    core = (F.col("_i") >= quarter) & (F.col("_i") < F.greatest(F.floor(F.col("_n") * 3 / 4), quarter + 1))
    level = F.when(core, F.col("level"))
    by = d.groupBy("code", "part", "on").agg(F.min("x").alias("x0"), F.count("*").alias("n"), F.max("edge").alias("start"), F.percentile(level, F.lit(0.5)).alias("level"), (F.max(level) - F.min(level)).alias("spread"))
    return by.withColumn("end", F.lead("start").over(Window.partitionBy("code").orderBy("part")))


def figures(pixels: DataFrame, kinds: DataFrame) -> DataFrame:
    """(code, contrast, light, dark, modulation, defects, module, left, right) of bands of pixels (code, x, y, value) and symbologies (code, kind).

    Modulation is the least step between neighbouring elements, defects the greatest unevenness within
    one, both as shares of the contrast; `module` is the width of a module in pixels, by the whole symbol
    where its modules are known and by its narrow elements otherwise; left and right are quiet modules.
    """
    profiled = profile(pixels)
    marks = marked(profiled)
    parts = elements(marks)
    w = Window.partitionBy("code")
    order = w.orderBy("part")
    inner = F.when(F.max("part").over(w) > 3, F.col("start").isNotNull() & F.col("end").isNotNull()).otherwise(True)
    inside = parts.withColumn("_in", inner).where("_in").withColumn("_step", F.abs(F.col("level") - F.lag("level").over(order)))
    inside = inside.withColumns({"_wide": F.coalesce(F.col("end") - F.col("start"), F.col("n").cast("double")), "_p30": F.percentile(F.coalesce(F.col("end") - F.col("start"), F.col("n").cast("double")), F.lit(0.3)).over(w)})
    narrow = F.percentile(F.when(F.col("_wide") <= 1.5 * F.col("_p30"), F.col("_wide")), F.lit(0.5))
    each = inside.groupBy("code").agg(F.min("_step").alias("_least"), F.max(F.when(F.col("n") > 3, F.col("spread"))).alias("_most"), narrow.alias("_narrow"))
    dark = parts.where("on").groupBy("code").agg(F.min(F.coalesce("start", F.col("x0").cast("double"))).alias("_first"), F.max(F.coalesce("end", (F.col("x0") + F.col("n")).cast("double"))).alias("_last"))
    band = profiled.groupBy("code").agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    known = F.coalesce(*(F.when(F.col("kind") == k, n) for k, n in MODULES.items()))
    d = limits(profiled).join(each, "code").join(band, "code").join(dark, "code", "left").join(kinds.select("code", "kind"), "code", "left")
    contrast = F.col("light") - F.col("dark")
    share = lambda c, none: F.when(contrast > 1e-6, F.coalesce(F.col(c), contrast if none else F.lit(0.0)) / contrast).otherwise(0.0 if none else 1.0)
    module = F.greatest(F.coalesce((F.col("_last") - F.col("_first")) / known, "_narrow", F.lit(1.0)), F.lit(1.0))
    quiet = lambda c: F.coalesce(c / F.col("module"), F.lit(0.0))
    d = d.select("*", contrast.alias("contrast"), share("_least", True).alias("modulation"), share("_most", False).alias("defects"), module.alias("module"))
    return d.select("code", "contrast", "light", "dark", "modulation", "defects", "module", quiet(F.col("_first") - F.col("_x0")).alias("left"), quiet(F.col("_x1") + 1 - F.col("_last")).alias("right"))


def graded(measured: DataFrame) -> DataFrame:
    """`figures` with the letter of the worst of them."""
    return measured.withColumn("grade", codes.symbol_grade(F.col("contrast") * 100, F.col("modulation"), F.col("defects"), F.col("dark"), F.col("light")))
