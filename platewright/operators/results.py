"""What a viewer shows of results, kinds of sources, and summaries of runs and traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest sides of pictures that messengers send, and sizes of screens.
CHAT_SIDES = [1600, 1280, 1024, 960, 800, 640]
SCREENS = [(1920, 1080), (1366, 768), (2560, 1440), (1536, 864), (1440, 900), (1280, 720), (3840, 2160), (1080, 1920), (1170, 2532), (1284, 2778), (1080, 2340), (1080, 2400), (750, 1334), (828, 1792), (1125, 2436), (1242, 2688), (1179, 2556), (1290, 2796)]


def source_kind(files: DataFrame) -> DataFrame:
    """Adds `source_kind` (capture, photo, scan, chat, export) to files (suffix, format, width, height, dpi, camera, software, quality, framed, lit, perspective).

    The first rule that holds decides; a file that could not be read has no format and is an export.
    """
    c = F.col
    size = F.concat_ws("x", c("width").cast("string"), c("height").cast("string"))
    screens = [f"{a}x{b}" for w, h in SCREENS for a, b in ((w, h), (h, w))]
    scan = F.contains(F.lower(F.coalesce("software", F.lit(""))), F.lit("scan")) | c("suffix").isin(".tif", ".tiff") | (c("dpi").between(150, 600) & c("format").isin("JPEG", "TIFF", "PNG"))
    chat = (c("format") == "JPEG") & F.greatest("width", "height").isin(CHAT_SIDES) & (c("quality").isNull() | (c("quality") <= 85))
    yes = lambda test: F.coalesce(test, F.lit(False))
    kind = F.when(c("format").isNull(), "export").when(yes(c("framed") | size.isin(screens)), "capture").when(yes(c("camera") | c("perspective") | c("lit")), "photo").when(yes(scan), "scan").when(yes(chat), "chat")
    return files.withColumn("source_kind", kind.otherwise("export"))


def flat_art(pages: DataFrame) -> DataFrame:
    """Adds `reasons` (sorted) why a page (images, shadings, patterns: numbers, transparency) is no flat art, and `flat`."""
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("images") > 0, "images"), F.when(F.col("shadings") > 0, "shadings"), F.when(F.col("patterns") > 0, "patterns"), F.when(F.col("transparency"), "transparency"))))
    return pages.withColumn("reasons", reasons).withColumn("flat", F.size("reasons") == 0)


def visible(issues: DataFrame, categories: list[str], show_ignored: bool = False) -> DataFrame:
    return issues.where(F.col("cat").isin(categories) & (F.lit(show_ignored) | ~F.col("ignored")))


def category_counts(issues: DataFrame) -> DataFrame:
    """Issues of each category, ignored ones included, and the number that counts."""
    return issues.groupBy("cat").agg(F.count("*").alias("n"), F.count_if(~F.col("ignored")).alias("counted"))


def checklist(issues: DataFrame, by: str = "page") -> DataFrame:
    """(by, pending, fixed, not_applicable, ready) over issues that are not ignored; no status is pending."""
    s = F.coalesce("status", F.lit("pending"))
    live = ~F.col("ignored")
    return issues.groupBy(by).agg(*(F.count_if(live & (s == k)).alias(k) for k in ("pending", "fixed", "not_applicable"))).withColumn("ready", F.col("pending") == 0)


def on_page(findings: DataFrame, page: int) -> DataFrame:
    """Findings with a place on a page."""
    return findings.where(F.col("box").isNotNull() & (F.col("page") == page))


def opaque_first(inks: DataFrame) -> DataFrame:
    return inks.orderBy(F.col("opacity").desc(), "pos")


def batch_totals(pages: DataFrame) -> DataFrame:
    """(batch, pages, mean, least, status) of pages (batch, total): the worst page decides."""
    from platewright.operators import rules

    by = pages.groupBy("batch").agg(F.count("*").alias("pages"), F.round(F.avg("total"), 1).alias("mean"), F.min("total").alias("least"))
    return by.withColumn("status", rules.status(F.col("least")))


def by_type(counts: DataFrame, cases: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each type of case (page, type)."""
    from platewright.operators import rules

    return rules.prf(counts.join(cases.select("page", "type"), "page").groupBy("type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def trap_summary(strokes: DataFrame) -> DataFrame:
    """(page, spread, under, rule, chains, width_mm) of trap strokes (page, chain, spread, under, rule, width_mm)."""
    return strokes.groupBy("page", "spread", "under", "rule").agg(F.count("*").alias("chains"), F.round(F.max("width_mm"), 3).alias("width_mm"))


def trap_strokes(edges: DataFrame, decisions: DataFrame, trap_mm: float, paper: DataFrame | None = None, margin_mm: float = 0.03) -> DataFrame:
    """Strokes along shared edges (page, chain, a, b): who spreads under whom by `decisions` (page, a, b, spread, under, fraction, rule), twice the trap wide.

    Edges of paper (page, label) have none, nor has a press without tolerance.
    """
    live = edges.where((F.col("a") != F.col("b")) & (F.col("a") >= 0) & (F.col("b") >= 0) & F.lit(trap_mm > 0))
    if paper is not None:
        for side in ("a", "b"):
            live = live.join(paper.select("page", F.col("label").alias(side)), ["page", side], "left_anti")
    pairs = live.select("page", "chain", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(decisions, ["page", "a", "b"])
    return pairs.select("page", "chain", "spread", "under", "rule", (2 * (trap_mm + margin_mm) * F.col("fraction")).alias("width_mm"))


def line_margins(lines: DataFrame, quality: Column | float = 1.0, base: float = 0.25) -> DataFrame:
    """(page, line, x0, y0, x1, y1): reading zones of lines (page, line, x, y, w, h), as wide as the neighbours in their band allow.

    A side grows to a third of the line's width where nothing stands in its way, else to 0.6 of the gap.
    """
    from platewright.operators import spatial

    q = F.lit(quality) if isinstance(quality, float) else quality
    band = lambda df, s: df.select(F.struct(*df.columns).alias(s), F.col("page").alias(f"{s}p"), F.explode(F.sequence(F.floor(F.col("y") / spatial.TILE), F.floor((F.col("y") + F.col("h")) / spatial.TILE))).alias(f"{s}b"))
    pairs = band(lines, "l").join(band(lines, "r"), (F.col("lp") == F.col("rp")) & (F.col("lb") == F.col("rb")) & (F.col("l.line") != F.col("r.line"))).where(spatial.side("l", "r", "y", "h") >= 0.3 * F.least("l.h", "r.h"))
    right, left = F.col("r.x") - F.col("l.x") - F.col("l.w"), F.col("l.x") - F.col("r.x") - F.col("r.w")
    gaps = pairs.groupBy(F.col("l.page").alias("page"), F.col("l.line").alias("line")).agg(F.min(F.when(right >= 0, right)).alias("_r"), F.min(F.when(left >= 0, left)).alias("_l"))
    d = lines.join(gaps, ["page", "line"], "left")
    h = F.greatest(F.col("h"), F.lit(8.0))
    slack = (F.lit(base) + F.when(q < 0.9, 0.5 * (1 - F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)))).otherwise(0.0)) * h
    free = 0.35 * F.col("w")
    grown = lambda gap: F.when(gap.isNull() | (gap >= free), F.greatest(slack, free)).otherwise(F.least(F.greatest(slack, free), F.greatest(slack, 0.6 * gap)))
    zone = d.select("page", "line", (F.col("x") - grown(F.col("_l"))).alias("x0"), (F.col("y") - base * h).alias("y0"), (F.col("x") + F.col("w") + grown(F.col("_r"))).alias("x1"), (F.col("y") + F.col("h") + base * h).alias("y1"))
    return zone.withColumns({"x0": F.greatest("x0", F.lit(0.0)), "y0": F.greatest("y0", F.lit(0.0))})


def symbol_rows(codes_: DataFrame) -> DataFrame:
    """A batch of codes (pos, type, data, name): its text or what is wrong, each row by itself."""
    from platewright.functions import codes

    n = codes_.withColumn("_n", codes.normalized(F.lower(F.trim("type")), F.col("data")))
    return n.select("pos", "type", F.coalesce("name", F.concat(F.lit("code_"), F.col("pos").cast("string"))).alias("name"), "_n.code", "_n.problem")
