"""State kept from events: latest values, top lists, eviction, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(events: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """The latest row of each key; ties go to the greater id.  One pre-aggregated shuffle."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, id_)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def top(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def counters(parts: list[DataFrame], key: str, value: str) -> DataFrame:
    """Sums of several counter tables."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.sum(value).alias(value))


def added(history: DataFrame, entries: DataFrame, keep: int = 50, key: str = "job_id", at: str = "at") -> DataFrame:
    """The newest `keep` entries; a new one takes the place of its id's old one."""
    both = history.join(entries.select(key).distinct(), key, "left_anti").unionByName(entries)
    return listed(both.dropDuplicates([key]), keep, key, at)


def listed(history: DataFrame, keep: int = 50, key: str = "job_id", at: str = "at") -> DataFrame:
    """Newest first; ties by id.  The limit is the feature."""
    return history.orderBy(F.col(at).desc(), key).limit(keep)


def overlaid(history: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """Entries with the fields of their changes that are not null; changes of unknown ids have no effect."""
    fields = [c for c in changes.columns if c != key]
    joined = history.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in fields)), key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*(f"_{c}" for c in fields)).select(*history.columns)


def evicted(jobs: DataFrame, keep: int = 60) -> DataFrame:
    """Jobs (id, started, status) that go: neither among the `keep` newest nor running.

    A bounded top list finds the newest, so no window sorts all jobs in one task.
    """
    newest = jobs.orderBy(F.col("started").desc(), F.col("id").desc()).limit(keep).select("id")
    return jobs.where("status <> 'running'").join(F.broadcast(newest), "id", "left_anti")


def aged(files: DataFrame, now: Column, days: int = 30, at: str = "modified") -> DataFrame:
    """Files older than `days`, to be deleted."""
    return files.where(F.col(at) < now - F.expr(f"interval {days} days"))


def due(checks: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """Checks (name, last) that may run again: never run, or a day ago."""
    return checks.where(F.col("last").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last") >= seconds))


def latest(runs: DataFrame, by: list[str], at: str = "at") -> DataFrame:
    """The newest run of each group."""
    rest = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at][:1])).alias("r")).select(*by, *(F.col(f"r.{c}").alias(c) for c in rest))


def previous(runs: DataFrame, at: str = "at") -> DataFrame:
    """Runs (run, scope, label, at) with the newest earlier one of the same scope and label."""
    w = Window.partitionBy("scope", "label").orderBy(at, "run")
    return runs.withColumn("previous", F.lag("run").over(w))


def next_number(cases: DataFrame, column: str = "n") -> DataFrame:
    return cases.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next"))


def stage_times(events: DataFrame) -> DataFrame:
    """(job, stage, seconds) of (job, stage, at): a stage lasts until the next begins."""
    w = Window.partitionBy("job").orderBy("at")
    span = F.lead("at").over(w).cast("double") - F.col("at").cast("double")
    return events.withColumn("_s", span).where("_s is not null").groupBy("job", "stage").agg(F.round(F.sum("_s"), 3).alias("seconds"))


def added_words(vocabulary: DataFrame, words: DataFrame, weight: int = 1) -> DataFrame:
    """Counts (word, n) with new words (word) of three letters or more and without digits."""
    new = words.select(F.lower(F.trim("word")).alias("word")).where((F.length("word") >= 3) & ~F.col("word").rlike("[0-9]")).groupBy("word").agg((F.count("*") * weight).alias("n"))
    return counters([vocabulary, new], "word", "n")


def removed(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(F.lower(F.trim(F.col(key))).alias(key)).distinct(), key, "left_anti")


def added_patterns(patterns: DataFrame, tokens: DataFrame) -> DataFrame:
    """Patterns (pattern) and those of new tokens (token), each once."""
    from platewright.functions.text import pattern_of

    new = tokens.select(pattern_of(F.regexp_replace("token", r"^[.,;:]+|[.,;:]+$", "")).alias("pattern")).where("pattern is not null")
    return patterns.select("pattern").union(new).distinct()


def merged_tuning(own: DataFrame, other: DataFrame) -> DataFrame:
    """Tunings (kind, cer, params): the one of lower error of each kind, our own on ties."""
    both = own.withColumn("_o", F.lit(0)).unionByName(other.withColumn("_o", F.lit(1)))
    return both.groupBy("kind").agg(F.min_by(F.struct("cer", "params"), F.struct("cer", "_o")).alias("r")).select("kind", "r.*")


def fingerprint(state: DataFrame) -> DataFrame:
    """First eight hex digits of learned state (name, content); null when nothing was learned.

    Files are few; each is hashed where it is, and hashes are joined in order of name.
    """
    each = state.where("content <> ''").select("name", F.sha1("content").alias("h"))
    return each.agg(F.when(F.count("*") > 0, F.left(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda s: s["h"]), "")), F.lit(8))).alias("fingerprint"))


def layered(defaults: DataFrame, *layers: DataFrame) -> DataFrame:
    """Settings (key, value): a later layer's value counts."""
    out = defaults.withColumn("_l", F.lit(0))
    for i, layer in enumerate(layers, 1):
        out = out.unionByName(layer.withColumn("_l", F.lit(i)))
    return out.groupBy("key").agg(F.max_by("value", "_l").alias("value"))
