"""Rules, findings, scores and accuracy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, rules: list[tuple[str, str, Column]], keep: list[str]) -> DataFrame:
    """A row (keep, rule, severity) for each row and rule that holds; one pass over the rows."""
    hits = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, test in rules))
    return rows.select(*keep, F.explode(F.array_compact(hits)).alias("f")).select(*keep, "f.rule", "f.severity")


def share_score(bad: Column, total: Column) -> Column:
    """100 less the bad share in percent, held in 0..100; nothing to judge gives 100."""
    return F.when(total <= 0, 100.0).otherwise(F.least(F.greatest(100.0 * (1 - bad / total), F.lit(0.0)), F.lit(100.0)))


def status(score: Column) -> Column:
    return F.when(score >= 98, "approved").when(score >= 90, "review").otherwise("errors")


def percent(part: Column, whole: Column) -> Column:
    """Ratio in percent; an empty whole gives 100."""
    return F.when(whole == 0, 100.0).otherwise(100.0 * part / whole)


def prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 (percent, one decimal) of tp, fp, fn."""
    df = df.withColumn("_p", percent(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("_r", percent(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.when(F.col("_p") + F.col("_r") == 0, 0.0).otherwise(2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return df.withColumns({"precision": F.round("_p", 1), "recall": F.round("_r", 1), "f1": F.round(f1, 1)}).drop("_p", "_r")
