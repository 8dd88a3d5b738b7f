"""Rules driven by profiles: facts of a file's pages in, findings out.

A profile is rows (profile, rule, active, severity, params map<string,string>).  Every rule is a
function of fact tables that all have `file` and `profile`; `checked` unites them.  Facts meet the
profile by a broadcast of its rows, which are a few dozen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions.units import box_px, mm_to_pt, pt_to_mm

# Severities in order.
SEVERITIES = ["error", "warning", "info"]
PROFILE = "profile string, rule string, active boolean, severity string, params map<string,string>"
COLUMNS = ["file", "rule", "severity", "message", "page", "box"]


def effective(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """Rules of the built-in profiles; a user's profile of the same name takes the place of the whole."""
    return builtin.join(own.select("profile").distinct(), "profile", "left_anti").unionByName(own)


def upserted(profiles: DataFrame, new: DataFrame, key: str = "profile") -> DataFrame:
    """Stored rows with those of `new` in place of what had their key; names of letters, digits, _ and - only."""
    good = new.where(F.col(key).rlike(r"^[\w-]+$"))
    return profiles.join(good.select(key).distinct(), key, "left_anti").unionByName(good)


def ruled(facts: DataFrame, rules: DataFrame, rule: str) -> DataFrame:
    """Facts with `severity` and `params` of an active rule."""
    r = rules.where((F.col("rule") == rule) & F.col("active")).select("profile", F.coalesce("severity", F.lit("warning")).alias("severity"), F.coalesce("params", F.create_map().cast("map<string,string>")).alias("params"))
    return facts.join(r, "profile")


def param(name: str, default: float) -> Column:
    return F.coalesce(F.try_element_at("params", F.lit(name)).cast("double"), F.lit(float(default)))


def finding(facts: DataFrame, rule: str, message: Column, page: Column | None = None, box: Column | None = None, severity: Column | None = None) -> DataFrame:
    kind = "struct<x:int,y:int,w:int,h:int>"
    return facts.select("file", F.lit(rule).alias("rule"), (severity if severity is not None else F.col("severity")).alias("severity"), message.alias("message"), (page if page is not None else F.lit(1)).cast("int").alias("page"), (box if box is not None else F.lit(None)).cast(kind).alias("box"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fonts(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`fonts` (page, xref, name, type, embedded): each object once, where it occurs first."""
    first = facts["fonts"].groupBy("file", "profile", "xref").agg(F.min_by(F.struct("page", "name", "type", "embedded"), "page").alias("f")).select("file", "profile", "f.*")
    missing = ruled(first.where("not embedded and type <> 'Type3'"), rules, "fonts_not_embedded")
    type3 = ruled(first.where("type = 'Type3'"), rules, "fonts_type3")
    return _united([finding(missing, "fonts_not_embedded", F.format_string("font %s is not embedded", "name"), F.col("page")), finding(type3, "fonts_type3", F.format_string("font %s is of type 3", "name"), F.col("page"))])


def images(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`images` (page, xref, width, height, x0, y0, x1, y1, channels, bits, quality): resolution as placed, strong compression."""
    placed = facts["images"].where("x1 - x0 >= 1 and y1 - y0 >= 1").withColumn("ppi", F.least(F.col("width") / (F.col("x1") - F.col("x0")), F.col("height") / (F.col("y1") - F.col("y0"))) * 72)
    need = F.when(F.col("bits") == 1, param("line_min", 800)).when(F.col("channels") == 1, param("grey_min", 250)).otherwise(param("color_min", 250))
    low = ruled(placed, rules, "resolution").withColumn("need", need).where("ppi < need")
    box = box_px(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    once = facts["images"].where("quality is not null").groupBy("file", "profile", "xref").agg(F.min_by(F.struct("page", "quality", "x0", "y0", "x1", "y1"), "page").alias("f")).select("file", "profile", "f.*")
    strong = ruled(once, rules, "jpeg_quality").where(F.col("quality") < param("min", 60))
    return _united([finding(low, "resolution", F.format_string("image of %.0f ppi, %.0f wanted", "ppi", "need"), F.col("page"), box), finding(strong, "jpeg_quality", F.format_string("compression of quality %.0f", "quality"), F.col("page"), box)])


def inks(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`spaces` (space, objects) and `inks` (ink, kind, variants array): forbidden spaces, too many spot inks, names of one ink."""
    label = F.when(F.col("space") == "DeviceRGB", "RGB").when(F.col("space") == "ICC-RGB", "RGB").when(F.col("space") == "Lab", "Lab")
    used = ruled(facts["spaces"].where("objects > 0").withColumn("label", label).where("label is not null"), rules, "color_spaces")
    forbidden = used.where(F.array_contains(F.split(F.coalesce(F.try_element_at("params", F.lit("forbidden")), F.lit("")), ","), F.col("label")))
    spots = facts["inks"].where("kind = 'spot'").groupBy("file", "profile").agg(F.count("*").alias("n"))
    many = ruled(spots, rules, "spot_inks_max").where(F.col("n") > param("max", 4))
    twice = ruled(facts["inks"].where("size(variants) > 1"), rules, "duplicate_inks")
    return _united([
        finding(forbidden, "color_spaces", F.format_string("%d objects in %s", F.col("objects").cast("long"), "space")), finding(many, "spot_inks_max", F.format_string("%d spot inks", F.col("n"))),
        finding(twice, "duplicate_inks", F.concat(F.col("ink"), F.lit(" has several names: "), F.array_join(F.array_sort("variants"), ", ")))])


def boxes(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`pages` (page, trim, bleed: struct or null, rect) and `blocks` (page, text, x0, y0, x1, y1): trim, bleed, text near the cut."""
    pages = facts["pages"]
    no_trim = ruled(pages.where("trim is null"), rules, "trim_box")
    rule = ruled(pages, rules, "bleed")
    none = rule.where("bleed is null")
    side = pt_to_mm(F.least(F.col("trim.x0") - F.col("bleed.x0"), F.col("trim.y0") - F.col("bleed.y0"), F.col("bleed.x1") - F.col("trim.x1"), F.col("bleed.y1") - F.col("trim.y1")))
    short = rule.where("bleed is not null and trim is not null").withColumn("mm", side).where(F.col("mm") < param("min_mm", 3) - 0.01)
    text = facts["blocks"].where("trim(text) <> ''").select("file", "page", "text", "x0", "y0", "x1", "y1").join(pages.where("trim is not null and trim <> rect").select("file", "profile", "page", "trim"), ["file", "page"])
    at = lambda k: F.col(k)
    within = lambda m: (at("x0") >= at("trim.x0") + m) & (at("y0") >= at("trim.y0") + m) & (at("x1") <= at("trim.x1") - m) & (at("y1") <= at("trim.y1") - m)
    near = ruled(text, rules, "safe_zone").where(within(F.lit(0.0)) & ~within(mm_to_pt(param("mm", 3))))
    return _united([
        finding(no_trim, "trim_box", F.lit("the page has no trim box"), at("page")), finding(none, "bleed", F.lit("the page has no bleed box"), at("page")), finding(short, "bleed", F.format_string("bleed of %.1f mm", "mm"), at("page")),
        finding(near, "safe_zone", F.concat(F.lit("text near the cut: "), F.left(F.trim("text"), F.lit(30))), at("page"), box_px(at("x0"), at("y0"), at("x1"), at("y1")))])


def structure(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`files` (transparent_pages array, pdfx, intents array), `layers` (name, visible) and `annotations` (page, x0, y0, x1, y1)."""
    files = facts["files"]
    clear = ruled(files.where("size(transparent_pages) > 0"), rules, "transparency")
    hidden = ruled(facts["layers"].where("not visible"), rules, "hidden_layers")
    notes = ruled(facts["annotations"], rules, "annotations")
    wanted = F.regexp_replace(F.try_element_at("params", F.lit("required")), "PDF/", "")
    level = ruled(files, rules, "pdfx").where(wanted.isNotNull() & ~F.coalesce(F.contains(F.regexp_replace("pdfx", "PDF/", ""), wanted), F.lit(False)))
    intent = ruled(files.where("coalesce(size(intents), 0) = 0"), rules, "output_intent")
    return _united([
        finding(clear, "transparency", F.concat(F.lit("transparency on pages "), F.array_join(F.col("transparent_pages").cast("array<string>"), ", "))), finding(hidden, "hidden_layers", F.concat(F.lit("hidden layer "), F.col("name"))),
        finding(notes, "annotations", F.lit("annotation or form field"), F.col("page"), box_px(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))),
        finding(level, "pdfx", F.concat(F.lit("PDF/X level: "), F.coalesce("pdfx", F.lit("none")))), finding(intent, "output_intent", F.lit("no output intent"))])


def plate_totals(facts: dict[str, DataFrame], rules: DataFrame, pages: int = 20) -> DataFrame:
    """`regions` (page, x, y, w, h, greatest) of total coverage: those above the profile's limit, of the first pages."""
    high = ruled(facts["regions"].where(F.col("page") <= pages), rules, "total_coverage").where(F.col("greatest") > param("limit", 300))
    return finding(high, "total_coverage", F.format_string("total coverage of %.0f %%", F.col("greatest").cast("double")), F.col("page"), F.struct(*(F.col(k).cast("int").alias(k) for k in "xywh")))


def overprints(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`paints` (page, ink, kind, overprint), one row for each paint and ink: varnish and technical inks must overprint, white must not."""
    by = facts["paints"].groupBy("file", "profile", "page", "ink").agg(F.first("kind").alias("kind"), F.bool_or(~F.col("overprint")).alias("knock"), F.bool_or("overprint").alias("over"))
    c = F.col
    problems = F.array_compact(F.array(
        F.when((c("kind") == "varnish") & c("knock"), F.struct(F.lit("varnish knocks out").alias("what"), F.lit("error").alias("own"))),
        F.when((c("kind") == "white") & c("over"), F.struct(F.lit("white overprints").alias("what"), F.lit(None).cast("string").alias("own"))),
        F.when((c("kind") == "technical") & (c("ink") != "ALL") & c("knock"), F.struct(F.lit("technical ink does not overprint").alias("what"), F.lit("error").alias("own"))),
        F.when(c("ink") == "ALL", F.struct(F.lit("registration colour in the art").alias("what"), F.lit(None).cast("string").alias("own")))))
    rows = ruled(by.withColumn("p", F.explode(problems)), rules, "overprint")
    return finding(rows, "overprint", F.concat_ws(": ", "ink", "p.what"), c("page"), severity=F.coalesce("p.own", "severity"))


def small_text(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """`texts` (page, text, pt, x, y, w, h, black_cmy, inks): rich black below a size, small text in several inks, small text.

    black_cmy is the mean of the coloured inks in percent where black prints under the span (null without
    four such pixels), inks the number of inks above a quarter under it.
    """
    box = F.struct(*(F.col(k).cast("int").alias(k) for k in "xywh"))
    short = F.left("text", F.lit(30))
    rich = ruled(facts["texts"], rules, "rich_black_text").where((F.col("pt") < param("max_pt", 12)) & (F.col("black_cmy") > 20))
    tiny = ruled(facts["texts"], rules, "small_text").where(F.col("pt") < param("min_pt", 6))
    several = tiny.where("inks >= 2")
    return _united([
        finding(rich, "rich_black_text", F.concat(F.lit("rich black: "), short), F.col("page"), box), finding(several, "small_text", F.format_string("%.1f pt in %d inks", "pt", F.col("inks").cast("int")), F.col("page"), box),
        finding(tiny, "small_text", F.format_string("%.1f pt", "pt"), F.col("page"), box)])


def thin_lines(facts: dict[str, DataFrame], rules: DataFrame, most: int = 50) -> DataFrame:
    """`strokes` (page, id, width_pt, x, y, w, h, inks): strokes below a width in two inks or more, the first of a page."""
    thin = ruled(facts["strokes"].where("width_pt > 0 and inks >= 2"), rules, "thin_line").where(pt_to_mm(F.col("width_pt")) < param("min_mm", 0.1))
    ranked = thin.withColumn("k", F.row_number().over(Window.partitionBy("file", "page").orderBy("id"))).where(F.col("k") <= most)
    return finding(ranked, "thin_line", F.format_string("line of %.3f mm in %d inks", pt_to_mm(F.col("width_pt")), F.col("inks").cast("int")), F.col("page"), F.struct(*(F.col(k).cast("int").alias(k) for k in "xywh")))


#: Rules and the fact tables they read.
RULES: list[tuple[Callable[[dict[str, DataFrame], DataFrame], DataFrame], list[str]]] = [
    (fonts, ["fonts"]), (images, ["images"]), (inks, ["spaces", "inks"]), (boxes, ["pages", "blocks"]), (structure, ["files", "layers", "annotations"]),
    (plate_totals, ["regions"]), (overprints, ["paints"]), (small_text, ["texts"]), (thin_lines, ["strokes"]),
]


def checked(facts: dict[str, DataFrame], rules: DataFrame) -> DataFrame:
    """Findings of all rules whose facts are there: rows of COLUMNS."""
    parts = [rule(facts, rules) for rule, needs in RULES if all(n in facts for n in needs)]
    return _united(parts).select(*COLUMNS)


def severity_rank(severity: Column) -> Column:
    out = F.when(F.lit(False), 9)
    for i, s in enumerate(SEVERITIES):
        out = out.when(severity == s, i)
    return out.otherwise(9)


def ordered(findings: DataFrame) -> DataFrame:
    """By severity, page and rule."""
    return findings.orderBy(severity_rank(F.col("severity")), "page", "rule", "message")


def summary(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(file, error, warning, info) of every file; 0 where it has none."""
    by = findings.groupBy("file").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return files.select("file").distinct().join(by, "file", "left").select("file", *(F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in SEVERITIES))


def report(findings: DataFrame, most: int = 200, per_page: int = 20) -> DataFrame:
    """Findings of a report: the first of each severity of a file, with their number and sheet."""
    w = Window.partitionBy("file", "severity").orderBy("page", "rule", "message")
    rows = findings.withColumn("number", F.row_number().over(w)).where(F.col("number") <= most)
    return rows.withColumn("sheet", F.floor((F.col("number") - 1) / per_page).cast("int") + 1)


# ---------------------------------------------------------------- fixes


def without_annotations(annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No annotations, and how many went of each file."""
    return annotations.limit(0), annotations.groupBy("file").agg(F.count("*").alias("removed"))


def with_boxes(pages: DataFrame, bleed_mm: float, inset_mm: float | None = None) -> DataFrame:
    """Pages (crop or media box) with bleed = crop and trim = crop less an inset, the bleed by default."""
    inset = (bleed_mm if inset_mm is None else inset_mm) * 72 / 25.4
    crop = F.coalesce("crop", "media")
    trim = F.struct((crop["x0"] + inset).alias("x0"), (crop["y0"] + inset).alias("y0"), (crop["x1"] - inset).alias("x1"), (crop["y1"] - inset).alias("y1"))
    return pages.withColumns({"bleed": crop, "trim": trim})


def with_overprint(paints: DataFrame, black: bool = True) -> DataFrame:
    """Paints of technical inks and varnish (and of pure black) overprint."""
    on = F.col("kind").isin("technical", "varnish")
    return paints.withColumn("overprint", F.col("overprint") | on | ((F.col("ink") == "BLACK") if black else F.lit(False)))


def with_merged_inks(inks: DataFrame) -> DataFrame:
    """Inks with their canonical name as the only one."""
    return inks.withColumn("variants", F.array("ink"))


def fixed(facts: dict[str, DataFrame], rules: DataFrame, fixes: dict[str, object]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Facts after the chosen fixes (annotations, boxes: mm, overprint, merge_inks), and counts before and after.

    Counts are rows (file, severity, before, after).
    """
    unknown = set(fixes) - {"annotations", "boxes", "overprint", "merge_inks"}
    if unknown:
        raise ValueError(f"unknown fixes: {', '.join(sorted(unknown))}")
    after = dict(facts)
    if fixes.get("annotations") and "annotations" in facts:
        after["annotations"] = without_annotations(facts["annotations"])[0]
    if fixes.get("boxes") and "pages" in facts:
        after["pages"] = with_boxes(facts["pages"], float(fixes["boxes"]))
    if fixes.get("overprint") and "paints" in facts:
        after["paints"] = with_overprint(facts["paints"])
    if fixes.get("merge_inks") and "inks" in facts:
        after["inks"] = with_merged_inks(facts["inks"])
    count = lambda f, name: checked(f, rules).groupBy("file", "severity").agg(F.count("*").alias(name))
    both = count(facts, "before").join(count(after, "after"), ["file", "severity"], "full")
    return after, both.select("file", "severity", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("before", "after")))
