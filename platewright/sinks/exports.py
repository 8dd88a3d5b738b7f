"""Writers: ink libraries, reports, summaries and vector paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUILTIN = "builtin"
HEADING = ["name", "L", "a", "b", "kind", "opacity"]


def library_json(inks: DataFrame, path: str) -> None:
    inks.write.mode("overwrite").json(path)


def library_csv(inks: DataFrame, path: str) -> None:
    """Inks with a heading; no Lab is empty."""
    inks.select(*HEADING).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def library(inks: DataFrame, root: str, name: str) -> None:
    """A named library in place of what it held; the built-in one is read-only.  Parquet commits by rename."""
    if name == BUILTIN:
        raise ValueError("the built-in library is read-only")
    inks.write.mode("overwrite").parquet(f"{root}/library={name}")


def report_lines(rows: DataFrame, columns: list[str], order: list[str], separator: str = ";") -> DataFrame:
    """Lines of a report (pos, value), heading first, with the mark that spreadsheets want at its beginning."""
    body = rows.select(*order, F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))
    heading = rows.sparkSession.range(1).select(F.lit("﻿" + separator.join(columns)).alias("value"))
    lines = body.orderBy(*order).select("value").withColumn("pos", F.monotonically_increasing_id() + 1)
    return heading.select(F.lit(0).cast("long").alias("pos"), "value").unionByName(lines.select("pos", "value"))


def report_csv(rows: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """A small report as one file; its lines stay in order."""
    report_lines(rows, columns, order).orderBy("pos").coalesce(1).select("value").write.mode("overwrite").text(path)


def plate_rows(coverage: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ink, kind, percent, empty): process inks in their order, then the others by name."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(x for i, n in enumerate(("Cyan", "Magenta", "Yellow", "Black")) for x in (F.lit(n), F.lit(i)))), F.col("ink")), F.lit(9))
    return coverage.join(kinds, "ink", "left").select("ink", F.coalesce("kind", F.lit("spot")).alias("kind"), "percent", "empty", rank.alias("rank")).orderBy("rank", "ink")


def summary(results: DataFrame, path: str) -> None:
    """A batch's files without their logs."""
    results.drop("log").write.mode("overwrite").json(path)


def table(rows: DataFrame, path: str) -> None:
    """Learned state: replaced as a whole."""
    rows.write.mode("overwrite").parquet(path)


def vocabulary(words: DataFrame, path: str) -> None:
    """Words by falling count, then by the alphabet, as `word<tab>count` lines."""
    words.orderBy(F.col("n").desc(), "word").select(F.concat_ws("\t", "word", F.col("n").cast("string"))).write.mode("overwrite").text(path)


def region_paths(points: DataFrame) -> DataFrame:
    """(label, path) of loops (label, loop, pos, x, y): one path a label, a closed part for each loop."""
    loops = points.groupBy("label", "loop").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("p"))  # the points of one outline
    one = F.concat(F.lit("M"), F.array_join(F.transform("p", lambda q: F.format_string("%.3f %.3f", q["x"].cast("double"), q["y"].cast("double"))), "L"), F.lit("Z"))
    return loops.select("label", "loop", one.alias("d")).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("loop", "d"))), lambda s: s["d"]), "").alias("path"))


def separation_text(stats: DataFrame) -> DataFrame:
    """(page, text): statistics (page, ink, percent) of a separation as lines."""
    line = F.format_string("%s: %.1f %%", "ink", "percent")
    return stats.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ink", line.alias("t")))), lambda s: s["t"]), "\n").alias("text"))  # a page's inks
