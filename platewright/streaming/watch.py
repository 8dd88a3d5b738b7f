"""A watched folder: files settle, run through a recipe and are routed; state of jobs and reviews.

The stream is of file listings (Structured Streaming's file source has exactly-once by checkpoint); a file is
taken when two observations agree on a size that is not 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.plans import recipes

SUFFIXES = [".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"]


def files(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Stream of new files of a folder, not of folders in it: file, kind, length, modified."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).load(folder)
    return named(raw.select("path", "length", F.col("modificationTime").alias("modified")))


def named(listing: DataFrame) -> DataFrame:
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return listing.where(suffix.isin(SUFFIXES)).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.when(suffix == ".pdf", "pdf").otherwise("image").alias("kind"), "length", "modified")


def settled(observations: DataFrame, tries: int = 20) -> DataFrame:
    """(file, length, seen, state) of sizes seen one after another (file, at, length).

    A file is stable when two observations in a row have the same size, not 0; it is given up after `tries`.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("at")
    o = observations.withColumns({"_k": F.row_number().over(w), "_same": F.col("length") == F.lag("length").over(w)}).where(F.col("_k") <= tries)
    first = F.min(F.when(F.col("_same") & (F.col("length") > 0), F.col("_k")))
    by = o.groupBy("file").agg(first.alias("_f"), F.max("_k").alias("seen"), F.max_by("length", "_k").alias("length"))
    return by.select("file", "length", "seen", F.when(F.col("_f").isNotNull(), "stable").when(F.col("seen") >= tries, "given up").otherwise("waiting").alias("state"))


SIZES = "file string, length long, n int, stable boolean"


def settling(observations: DataFrame, tries: int = 20) -> DataFrame:
    """The streaming form: SIZES rows of a stream of (file, length), by a state of the last size and number of looks."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def look(key, batches, state):
        last, n, stable = state.get if state.exists else (-1, 0, False)
        for pdf in batches:
            for length in pdf.length:
                if not stable and n < tries:
                    stable, last, n = bool(length == last and length > 0), int(length), n + 1
        state.update((last, n, stable))
        yield pd.DataFrame({"file": [key[0]], "length": [last], "n": [n], "stable": [stable]})

    return observations.groupBy("file").applyInPandasWithState(look, SIZES, "length long, n int, stable boolean", "update", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, recipe: recipes.Recipe, facts: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Run a recipe on every file that is there now and add its outcome to `out`, by state; a rerun takes up where it ended.

    A batch is written under its number, so that a repeated one takes the place of its first try.
    """
    if wrong := recipe.problems():
        raise ValueError("; ".join(wrong))
    if out.rstrip("/") == checkpoint.rstrip("/"):
        raise ValueError("output and checkpoint must differ")

    def take(batch: DataFrame, number: int) -> None:
        done = recipes.routed(recipes.run(recipe, facts(batch)))
        done.write.mode("overwrite").partitionBy("state").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()


def status(spark: SparkSession, out: str) -> DataFrame:
    """(state, files) of what a watcher has done so far."""
    return spark.read.parquet(out).groupBy("state").agg(F.count("*").alias("files"))


def job_states(events: DataFrame) -> DataFrame:
    """(job, status, stage, pct, error) of events (job, at, kind, stage, pct, error), the last state of each.

    A job runs until it is done or in error; a cancelled one is an error.  What comes after the end does not count.
    """
    end = events.where("kind in ('done', 'error', 'cancel')").groupBy("job").agg(F.min(F.struct("at", "kind", "error")).alias("end"))
    progress = events.where("kind = 'progress'").join(end.select("job", F.col("end.at").alias("_e")), "job", "left").where("_e is null or at <= _e")
    last = progress.groupBy("job").agg(F.max_by(F.struct("stage", "pct"), "at").alias("p"))
    every = events.select("job").distinct().join(last, "job", "left").join(end, "job", "left")
    kind = F.col("end.kind")
    return every.select("job", F.when(kind.isNull(), "running").when(kind == "done", "done").otherwise("error").alias("status"), F.col("p.stage").alias("stage"), F.when(kind == "done", 1.0).otherwise(F.round(F.col("p.pct"), 3)).alias("pct"), F.when(kind == "cancel", "cancelled").otherwise(F.col("end.error")).alias("error"))


def reviews_due(reviews: DataFrame, every: int = 5) -> DataFrame:
    """(kind, reviews, tunings): how often tuning was due after reviews (kind), one for each `every`."""
    return reviews.groupBy("kind").agg(F.count("*").alias("reviews")).withColumn("tunings", F.floor(F.col("reviews") / every))


def single_flight(requests: DataFrame) -> DataFrame:
    """Requests (id, at, ends) that start a task: one that begins while another runs does not.

    Requests of a task are few and their order matters, so a fold over the sorted list decides.
    """
    listed = requests.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("at", "ends", "id"))).alias("r"))
    step = lambda s, r: F.when(r["at"] >= s["free"], F.struct(r["ends"].alias("free"), F.concat(s["ids"], F.array(r["id"])).alias("ids"))).otherwise(s)
    start = F.struct(F.lit(float("-inf")).alias("free"), F.array().cast("array<string>").alias("ids"))
    return listed.select("task", F.explode(F.aggregate("r", start, step)["ids"]).alias("id"))


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts of events (ts, event_type) in tumbling or sliding windows; events later than the watermark are dropped from a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of a user's events in sessions that end after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
