"""Names of inks, files and versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of process inks, and words that tell the other kinds.
PROCESS = ["cyan", "cian", "magenta", "yellow", "amarillo", "black", "negro", "key", "c", "m", "y", "k"]
KEYWORDS = {
    "white": ["white", "blanco", "weiss", "weiß"],
    "varnish": ["varnish", "barniz", "lack"],
    "technical": ["die", "cut", "troquel", "stanz", "dieline", "braille", "dimension", "cota", "crease", "perf"],
}
KINDS = ["process", "spot", "white", "varnish", "technical"]


def normalized(name: Column) -> Column:
    """One spelling of an ink's name: capitals, single blanks, one brand prefix, the paper suffix set apart."""
    n = F.upper(F.trim(F.regexp_replace(F.replace(F.coalesce(name, F.lit("")), F.lit("®"), F.lit("")), r"\s+", " ")))
    n = F.regexp_replace(n, r"^(?:PANTONE|PMS|P)\s*[-_ ]?(\d)", "PANTONE $1")
    n = F.regexp_replace(n, r"(\d)\s*(CP|UP|C|U|M)$", "$1 $2")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def kind_of(name: Column, keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """Kind of ink by its name; keywords count where a word begins."""
    n = F.lower(normalized(name))
    kind = F.when(n.isin(PROCESS), "process")
    for k, words in keywords.items():
        kind = kind.when(n.rlike("(^|[^a-zñáéíóú])(" + "|".join(re.escape(w) for w in words) + ")"), k)
    return kind.otherwise("spot")


def safe_name(name: Column, forbidden: str = r"[^\w\- .()áéíóúñÁÉÍÓÚÑ]") -> Column:
    """File name without forbidden characters and outer dots, 80 characters at most; null if nothing is left."""
    n = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), forbidden, "")), r"^\.+|\.+$", "")
    return F.nullif(F.substring(n, 1, 80), F.lit(""))


def file_key(content: Column, page: Column, dpi: Column) -> Column:
    """Content key of a rendered page."""
    return F.concat_ws("_", F.substring(F.sha1(content), 1, 20), page.cast("string"), dpi.cast("int").cast("string"))


def version_key(path: Column) -> Column:
    """Numbers of a version, as an array that sorts like the version."""
    return F.transform(F.regexp_extract_all(path, F.lit(r"(\d+)"), 1), lambda d: d.cast("int"))


def variant_map(canonical: Column, variants: Column) -> Column:
    """Other spellings of an ink, each to its canonical name."""
    others = F.filter(F.array_sort(F.array_distinct(variants)), lambda v: v != canonical)
    return F.map_from_arrays(others, F.transform(others, lambda _: canonical))


def translated(text: Column, table: list[tuple[str, str]], fallback: str | None = None) -> Column:
    """The message of the first pattern that is found in `text`."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, message in table:
        out = out.when(text.rlike(pattern), message)
    return out.otherwise(F.lit(fallback) if fallback is not None else text)


def rewritten(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Phrases replaced one after another."""
    for old, new in phrases:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
