"""Text of bar codes: check digits, application identifiers, symbologies, grades and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewright.functions.text import check_digit

# Application identifiers (fixed length or null, greatest length, digits only), those with a
# check digit and those with a date.
IDENTIFIERS = {
    "00": (18, 18, True), "01": (14, 14, True), "02": (14, 14, True), "10": (None, 20, False), "11": (6, 6, True), "13": (6, 6, True),
    "15": (6, 6, True), "17": (6, 6, True), "20": (2, 2, True), "21": (None, 20, False), "30": (None, 8, True), "37": (None, 8, True),
    "310": (6, 6, True), "320": (6, 6, True), "400": (None, 30, False), "410": (13, 13, True), "414": (13, 13, True), "8004": (None, 30, False),
}
CHECKED, DATED = ["00", "01", "02"], ["11", "13", "15", "17"]
# Digits of the codes that have a check digit; module width, bar height in millimetres and quiet modules left and right.
DIGITS = {"ean13": 13, "ean8": 8, "upca": 12, "itf14": 14}
SYMBOLS = {
    "ean13": (0.33, 22.85, 11, 7), "ean8": (0.33, 18.23, 7, 7), "upca": (0.33, 22.85, 9, 9), "upce": (0.33, 22.85, 9, 7), "itf14": (0.495, 31.75, 10, 10),
    "code128": (0.33, 15.0, 10, 10), "gs1_128": (0.495, 20.0, 10, 10), "code39": (0.33, 15.0, 10, 10), "databar": (0.264, 13.0, 1, 1),
    "datamatrix": (0.5, 0.0, 1, 1), "gs1_datamatrix": (0.5, 0.0, 1, 1), "qr": (0.5, 0.0, 4, 4),
}


def _numeric(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def _less(c: Column, n: int = 1) -> Column:
    return F.left(c, F.length(c) - n)


def valid_check(code: Column) -> Column:
    """More than one digit, and the last is the others' check digit."""
    ok = _numeric(code) & (F.length(code) > 1)
    return F.when(ok, check_digit(_less(F.when(ok, code).otherwise("00"))) == F.right(code, F.lit(1)).try_cast("int")).otherwise(False)


def ensured(digits: Column, total: int) -> Column:
    """(code, computed, problem): one digit short gets its check digit, a full code is verified, the rest is refused."""
    d = F.regexp_replace(digits, r"\s", "")
    number = F.when(_numeric(d), d).otherwise("0")
    digit = check_digit(number).cast("string")
    problem = F.when(~_numeric(d), "digits only").when(F.length(d) == total - 1, F.lit(None).cast("string")).when(F.length(d) != total, "wrong length").when(~valid_check(d), "wrong check digit")
    short = _numeric(d) & (F.length(d) == total - 1)
    return F.struct(F.when(short, F.concat(d, digit)).when(problem.isNull(), d).alias("code"), short.alias("computed"), problem.alias("problem"))


def upce_expanded(code: Column) -> Column:
    """Twelve digits of an eight-digit zero-suppressed code."""
    at = lambda i, n=1: F.substring(code, i, n)
    last = at(7)
    body = (
        F.when(last.isin("0", "1", "2"), F.concat(at(1), at(2, 2), last, F.lit("0000"), at(4, 3)))
        .when(last == "3", F.concat(at(1), at(2, 3), F.lit("00000"), at(5, 2)))
        .when(last == "4", F.concat(at(1), at(2, 4), F.lit("00000"), at(6)))
        .otherwise(F.concat(at(1), at(2, 5), F.lit("0000"), last))
    )
    return F.concat(body, at(8))


def upce_ensured(digits: Column) -> Column:
    """(code, computed, problem) of seven or eight digits that begin with 0 or 1."""
    d = F.regexp_replace(digits, r"\s", "")
    ok = d.rlike("^[01][0-9]{6,7}$")
    eight = F.when(ok, F.rpad(d, 8, "0")).otherwise("00000000")
    wide = upce_expanded(eight)
    digit = check_digit(_less(wide)).cast("string")
    problem = F.when(~ok, "seven or eight digits, the first 0 or 1").when((F.length(d) == 8) & (digit != F.right(d, F.lit(1))), "wrong check digit")
    return F.struct(F.when(problem.isNull(), F.concat(F.left(eight, F.lit(7)), digit)).alias("code"), (ok & (F.length(d) == 7)).alias("computed"), problem.alias("problem"))


def pairs_of(data: Column) -> Column:
    """Pairs (ai, value) of `(01)...(17)...`; null if the text is anything else."""
    whole = F.trim(data).rlike(r"^(\(\d{2,4}\)[^(]*)+$")
    found = F.arrays_zip(F.regexp_extract_all(F.trim(data), F.lit(r"\((\d{2,4})\)([^(]*)"), 1).alias("ai"), F.regexp_extract_all(F.trim(data), F.lit(r"\((\d{2,4})\)([^(]*)"), 2).alias("value"))
    return F.when(whole, found)


def pair_problem(ai: Column, value: Column) -> Column:
    """What is wrong with a pair, or null: unknown identifier, digits, length, check digit, date (day 00 is the month)."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    table = F.create_map(*(x for k in IDENTIFIERS for x in (F.lit(k), F.lit(k))))
    key = F.coalesce(F.try_element_at(table, ai), F.try_element_at(table, F.left(ai, F.lit(3))))
    out = out.when(key.isNull(), "unknown identifier")
    out = out.when(key.isin([k for k, v in IDENTIFIERS.items() if v[2]]) & ~_numeric(value), "digits only")
    for size in sorted({v[0] for v in IDENTIFIERS.values() if v[0]}):
        out = out.when(key.isin([k for k, v in IDENTIFIERS.items() if v[0] == size]) & (F.length(value) != size), "wrong length")
    for size in sorted({v[1] for v in IDENTIFIERS.values()}):
        out = out.when(key.isin([k for k, v in IDENTIFIERS.items() if v[1] == size]) & ((F.length(value) > size) | (value == "")), "wrong length")
    out = out.when(ai.isin(CHECKED) & ~valid_check(value), "wrong check digit")
    day = F.when(F.right(value, F.lit(2)) == "00", "01").otherwise(F.right(value, F.lit(2)))
    date = F.try_to_date(F.concat(F.lit("20"), F.left(value, F.lit(4)), day), "yyyyMMdd")
    return out.when(ai.isin(DATED) & date.isNull(), "no such date")


def parsed(df: DataFrame, data: str = "data") -> DataFrame:
    """Rows of `df` and each pair of `data` with its problem; a text without pairs has one row with a problem."""
    rows = df.select("*", F.posexplode_outer(pairs_of(F.col(data))).alias("pos", "_p"))
    rows = rows.select(*df.columns, "pos", F.col("_p.ai").alias("ai"), F.col("_p.value").alias("value"))
    return rows.withColumn("problem", F.when(F.col("ai").isNull(), "no identifiers").otherwise(pair_problem(F.col("ai"), F.col("value"))))


def normalized(kind: Column, data: Column) -> Column:
    """(code, computed, problem) of the text for a symbology."""
    d = F.trim(F.coalesce(data, F.lit("")))
    as_is = lambda code, problem=None: F.struct(code.alias("code"), F.lit(False).alias("computed"), (problem if problem is not None else F.lit(None).cast("string")).alias("problem"))
    problems = F.filter(F.transform(F.coalesce(pairs_of(d), F.array()), lambda p: pair_problem(p["ai"], p["value"])), lambda p: p.isNotNull())
    pairs = F.when(pairs_of(d).isNull(), "no identifiers").otherwise(F.get(problems, F.lit(0)))
    with_gtin = ensured(d, 14)
    databar = F.when(d.startswith("("), as_is(d, pairs)).otherwise(F.struct(F.concat(F.lit("(01)"), with_gtin["code"]).alias("code"), with_gtin["computed"].alias("computed"), with_gtin["problem"].alias("problem")))
    out = F.when(~kind.isin(list(SYMBOLS)), as_is(F.lit(None).cast("string"), F.lit("unknown symbology"))).when(d == "", as_is(F.lit(None).cast("string"), F.lit("no data")))
    for k, n in DIGITS.items():
        out = out.when(kind == k, ensured(d, n))
    out = out.when(kind == "upce", upce_ensured(d)).when(kind.isin("gs1_128", "gs1_datamatrix"), as_is(d, pairs)).when(kind == "databar", databar)
    return out.when(kind == "code39", as_is(F.upper(d), F.when(~F.upper(d).rlike(r"^[0-9A-Z\-. $/+%]*$"), "characters out of the set"))).otherwise(as_is(d))


def grade(value: Column, thresholds: list[float], higher_better: bool = True) -> Column:
    """4 to 0 by descending thresholds (ascending if lower is better)."""
    out = F.when(F.lit(False), 0)
    for i, t in enumerate(thresholds):
        out = out.when((value >= t) if higher_better else (value <= t), 4 - i)
    return out.otherwise(0)


def symbol_grade(contrast: Column, modulation: Column, defects: Column, darkest: Column, lightest: Column) -> Column:
    """Letter of the worst partial grade of a scan profile."""
    parts = [grade(contrast, [70, 55, 40, 20]), grade(modulation, [0.7, 0.6, 0.5, 0.4]), grade(defects, [0.15, 0.2, 0.25, 0.3], False), F.when(darkest <= 0.5 * lightest, 4).otherwise(0)]
    return F.element_at(F.array(*map(F.lit, "FDCBA")), F.least(*parts) + 1)


def module_width(kind: Column, magnification: Column, own: Column | None = None) -> Column:
    table = F.create_map(*(x for k, v in SYMBOLS.items() for x in (F.lit(k), F.lit(v[0]))))
    nominal = F.try_element_at(table, kind)
    return (nominal if own is None else F.coalesce(own, nominal)) * magnification


def layout_bars(runs: DataFrame, left_quiet: float, right_quiet: float, reduction: float = 0.0) -> DataFrame:
    """Bars in millimetres of dark runs (code, start, length, x_mm, height): each loses `reduction`, centred, and 0.02 stays."""
    first, last = F.min("start"), F.max(F.col("start") + F.col("length"))
    ends = runs.groupBy("code").agg(first.alias("first"), last.alias("last"))
    bars = runs.join(ends, "code")
    x = F.col("x_mm")
    return bars.select("code", (left_quiet * x + (F.col("start") - F.col("first")) * x + reduction / 2).alias("x"), F.lit(0.0).alias("y"), F.greatest(F.col("length") * x - reduction, F.lit(0.02)).alias("w"), F.col("height").alias("h"), ((left_quiet + right_quiet + F.col("last") - F.col("first")) * x).alias("width"))


def path_of(bars: DataFrame, by: str = "code") -> DataFrame:
    """One vector path for each symbol, bars in order."""
    bar = F.format_string("M%.4f %.4fh%.4fv%.4fh%.4fz", "x", "y", "w", "h", -F.col("w"))
    listed = bars.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("x", "y", bar.alias("d")))).alias("all"))  # a symbol has some hundred bars
    return listed.select(by, F.array_join(F.transform("all", lambda b: b["d"]), "").alias("path"))


def quiet_zones(modules: DataFrame, by: str = "code") -> DataFrame:
    """Light modules before the first and after the last dark one of (code, i, dark, x_px); 0 and 0 if none is dark."""
    dark = F.when(F.col("dark"), F.col("i"))
    each = modules.groupBy(by).agg(F.min(dark).alias("first"), F.max(dark).alias("last"), F.max("i").alias("end"), F.first("x_px").alias("x_px"))
    return each.select(by, F.coalesce(F.col("first") / F.col("x_px"), F.lit(0.0)).alias("left"), F.coalesce((F.col("end") - F.col("last")) / F.col("x_px"), F.lit(0.0)).alias("right"))
