"""Zones of a page in relative coordinates: clamping, masks, issues they ignore, and issues that explain each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.operators import spatial

# Modes of a zone.
MODES = ["all", "color", "text"]


def clamped(zones: DataFrame) -> DataFrame:
    """x, y, w, h held in the unit square; an unknown mode is `all`."""
    hold = lambda c, high: F.least(F.greatest(c, F.lit(0.0)), high)
    z = zones.withColumns({k: hold(F.col(k), F.lit(1.0)) for k in ("x", "y")})
    z = z.withColumns({"w": hold(F.col("w"), 1 - F.col("x")), "h": hold(F.col("h"), 1 - F.col("y"))})
    return z.withColumn("mode", F.when(F.col("mode").isin(MODES), F.col("mode")).otherwise("all"))


def pixels(zones: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Zones scaled to pixels of their page."""
    return zones.withColumns({"x": F.col("x") * F.col(width), "w": F.col("w") * F.col(width), "y": F.col("y") * F.col(height), "h": F.col("h") * F.col(height)})


def inside(zone: str, box: str) -> Column:
    """The box's centre is in the zone, or half of it is."""
    return spatial.centre_in(box, zone) | (spatial.common(zone, box) * 2 >= F.greatest(F.col(f"{box}.w") * F.col(f"{box}.h"), F.lit(1)))


def ignored(issues: DataFrame, zones: DataFrame) -> DataFrame:
    """`issues` (page, id, x, y, w, h, cat, subtype) that a zone of pixels (page, id, ..., mode) hides, by its mode."""
    pairs = spatial.overlaps(issues, zones).where(inside("r", "l"))
    mode, cat, sub = F.col("r.mode"), F.col("l.cat"), F.col("l.subtype")
    hides = (mode == "all") | ((mode == "color") & ((cat == "color") | sub.isin("recoloured", "zone"))) | ((mode == "text") & cat.isin("text", "spelling", "font"))
    hit = pairs.where(hides).select("l.page", F.col("l.id").alias("id")).distinct()
    return issues.join(hit, ["page", "id"], "left_semi")


def mask(zones: DataFrame, width: int, height: int, modes: list[str]) -> DataFrame:
    """Pixels (page, x, y) of a width by height page that a relative zone of these modes covers."""
    z = zones.where(F.col("mode").isin(modes))
    span = lambda at, size, n: F.explode(F.sequence((F.col(at) * n).cast("int"), F.least(((F.col(at) + F.col(size)) * n).cast("int"), F.lit(n - 1))))
    return z.select("page", "y", "h", span("x", "w", width).alias("px")).select("page", F.col("px").alias("x"), span("y", "h", height).alias("y")).distinct()


def suggested(files: DataFrame, templates: DataFrame, near: float = 0.03) -> DataFrame:
    """(file, template): the template's name is in the file's, or both sides are within three percent."""
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) < near * F.col(b)
    named = F.contains(F.lower("file"), F.lower("template"))
    sized = F.coalesce(close("t_width", "width") & close("t_height", "height") & (F.col("t_width") > 0) & (F.col("t_height") > 0) & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    return files.join(F.broadcast(templates), named | sized).select("file", "template")  # templates are a hand-made list


def touched(boxes: DataFrame, others: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Boxes of which more than `fraction` lies in one of the others (0: any contact)."""
    hit = spatial.overlaps(boxes, others).where(spatial.common("l", "r") > fraction * F.greatest(F.col("l.w") * F.col("l.h"), F.lit(1)))
    return boxes.join(hit.select("l.page", F.col("l.id").alias("id")).distinct(), ["page", "id"], "left_semi")


def covered_share(boxes: DataFrame, others: DataFrame, name: str) -> DataFrame:
    """Adds the share of each box that lies in the union of the others; each point counts once."""
    edge = lambda low, at, size: (F.greatest(f"l.{at}", f"r.{at}") if low else F.least(F.col(f"l.{at}") + F.col(f"l.{size}"), F.col(f"r.{at}") + F.col(f"r.{size}"))).cast("double")
    part = F.struct(edge(True, "x", "w").alias("x0"), edge(False, "x", "w").alias("x1"), edge(True, "y", "h").alias("y0"), edge(False, "y", "h").alias("y1"))
    met = spatial.overlaps(boxes, others).groupBy(F.col("l.page").alias("page"), F.col("l.id").alias("id")).agg(F.first(F.col("l.w") * F.col("l.h")).alias("_area"), F.collect_list(part).alias("_parts"))  # what overlaps one box
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform("_parts", lambda r: r["x0"]), F.transform("_parts", lambda r: r["x1"]))))
    met = met.withColumn("_cuts", cuts)

    def strip(i: Column) -> Column:
        """Length that the parts cover between two cuts next to each other."""
        low, high = F.get("_cuts", i - 1), F.get("_cuts", i)
        inside = F.array_sort(F.transform(F.filter("_parts", lambda r: (r["x0"] <= low) & (r["x1"] >= high)), lambda r: F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"))))
        covered = F.aggregate(inside, F.struct(F.lit(0.0).alias("n"), F.lit(float("-inf")).alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(r["y1"] - F.greatest(r["y0"], s["end"]), F.lit(0.0))).alias("n"), F.greatest(s["end"], r["y1"]).alias("end")))
        return covered["n"] * (high - low)

    area = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("_cuts") - 1), strip), F.lit(0.0), lambda s, v: s + v)
    shares = met.select("page", "id", (area / F.greatest("_area", F.lit(1))).alias("_share"))
    return boxes.join(shares, ["page", "id"], "left").withColumn(name, F.coalesce("_share", F.lit(0.0))).drop("_share")


def unexplained(visual: DataFrame, others: DataFrame, colours: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visual regions and colour issues that nothing else explains; all have (page, id, x, y, w, h, subtype).

    A visual region goes if 40 % of it is covered by other issues, or 60 % by text and it is slight or
    meets one, or 40 % by text and on an issue's line, or it is slight and meets a colour zone.  A colour
    zone goes if half of it lies in one kept element.
    """
    slight = F.col("subtype").isin("visual_difference", "recoloured")
    ids = lambda pairs: pairs.select("l.page", F.col("l.id").alias("id")).distinct().withColumn("_hit", F.lit(True))

    def flagged(df: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        return df.join(ids(pairs), ["page", "id"], "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")

    v = covered_share(covered_share(visual, others, "by_issue"), texts, "by_text")
    v = flagged(v, spatial.overlaps(visual, others), "meets")
    # an issue on the same line: bands of the page are the bucket of this join on y
    band = lambda df, s: df.select(F.struct(*df.columns).alias(s), F.col("page").alias(f"{s}p"), F.explode(F.sequence(F.floor(F.col("y") / spatial.TILE), F.floor((F.col("y") + F.col("h")) / spatial.TILE))).alias(f"{s}b"))
    lines = band(visual, "l").join(band(others, "r"), (F.col("lp") == F.col("rp")) & (F.col("lb") == F.col("rb"))).where(spatial.side("l", "r", "y", "h") >= 0.5 * F.least("l.h", "r.h"))
    v = flagged(v, lines, "in_line")
    v = flagged(v, spatial.overlaps(visual, colours.where("subtype = 'zone'")), "on_zone")
    v = flagged(v, spatial.overlaps(visual, colours), "on_colour")
    gone = (F.col("by_issue") >= 0.4) | ((F.col("by_text") >= 0.6) & (slight | F.col("meets"))) | ((F.col("by_text") >= 0.4) & F.col("in_line")) | (slight & F.col("on_zone")) | ((F.col("subtype") == "recoloured") & F.col("on_colour"))
    kept = v.where(~gone).select(*visual.columns)
    elements = kept.where(F.col("subtype").isin("element_extra", "element_missing", "element_changed"))
    held = spatial.overlaps(colours.where("subtype = 'zone'"), elements).where(spatial.common("l", "r") * 2 >= F.greatest(F.col("l.w") * F.col("l.h"), F.lit(1)))
    return kept, colours.join(ids(held).drop("_hit"), ["page", "id"], "left_anti")


def next_to_line(words: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, word, line): the word shares half of the line's band and is less than 2.5 heights away."""
    band = lambda df, s: df.select(F.struct(*df.columns).alias(s), F.col("page").alias(f"{s}p"), F.explode(F.sequence(F.floor(F.col("y") / spatial.TILE), F.floor((F.col("y") + F.col("h")) / spatial.TILE))).alias(f"{s}b"))
    pairs = band(words, "l").join(band(lines, "r"), (F.col("lp") == F.col("rp")) & (F.col("lb") == F.col("rb")))
    gap = F.greatest(F.col("l.x") - F.col("r.x") - F.col("r.w"), F.col("r.x") - F.col("l.x") - F.col("l.w"))
    near = (spatial.side("l", "r", "y", "h") >= 0.5 * F.least("l.h", "r.h")) & (gap < 2.5 * F.greatest(F.col("r.h"), F.lit(8.0)))
    return pairs.where(near).select(F.col("l.page").alias("page"), F.col("l.id").alias("word"), F.col("r.id").alias("line")).distinct()


def reread(issues: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Issues that a second reading did not settle: confirmed ones (page, id) go, and missing words over their boxes."""
    settled = issues.join(confirmed.select("page", "id"), ["page", "id"], "left_semi")
    rest = issues.join(confirmed.select("page", "id"), ["page", "id"], "left_anti")
    over = spatial.overlaps(rest.where("subtype = 'missing'"), settled).select("l.page", F.col("l.id").alias("id")).distinct()
    return rest.join(over, ["page", "id"], "left_anti")


def line_boxes(words: DataFrame) -> DataFrame:
    """Boxes of lines of words (page, line, x0, y0, x1, y1, text, pos), in reading order (bands of four, then from the left)."""
    by = words.groupBy("page", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]).alias("words"))  # a line's words
    return by.withColumn("band", F.rint(F.col("y0") / 4))
