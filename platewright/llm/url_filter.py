"""URL filters by a temporal list join.  Native: DataFrame operations only.

Dated list entries ("added", "removed") become validity intervals, and an as-of join tests every
capture against the entries that were active when it was fetched.

An entry blocks a `host` (that host alone), a `domain` (it and all below it) or a `prefix` (host and
leading path directories).  A capture gives one key for each host suffix and each leading
directory, so matching is an equality join with an interval condition.

Defined results: an interval holds its start and not its end; an entry never removed holds on; an
entry removed before it was added, added twice or removed twice changes nothing; of two changes at
one instant the removal wins.  A capture without url, host or time matches nothing and stays in the
result.  Repeated captures each give a row.  Hosts compare in lower case, without port, user and
final dot; paths as they are, without query and fragment.  Columns of the results' names give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.llm._shared import small


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, kind, pattern, starts, ends) of (list, kind, pattern, action, at)."""
    key = ["list", "kind", "pattern"]
    # of an instant's changes the removal decides
    states = entries.where("at is not null and pattern is not null").groupBy(*key, "at").agg(F.min(F.col("action") == "added").alias("active"))
    w = Window.partitionBy(*key).orderBy("at")
    turns = states.withColumn("before", F.coalesce(F.lag("active").over(w), F.lit(False))).where("active <> before")
    return turns.withColumn("ends", F.lead("at").over(w)).where("active").select(*key, F.col("at").alias("starts"), "ends")


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.$", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """Array of struct(kind, pattern): what could block `url`."""
    host, labels, steps = host_of(url), F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    # directories end with a slash; the last step is the page itself
    directories = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/"), F.lit("/")).alias("pattern")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host != "", F.array_distinct(F.concat(own, suffixes, directories)))


def check(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """`captures` with n_hits, lists (sorted, comma-joined) and blocked."""
    captures, valid = captures.drop("n_hits", "lists", "blocked"), intervals(entries)
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).where(F.col(url).isNotNull() & F.col(fetched).isNotNull()).distinct()
    keyed = asked.select("_url", "_at", F.explode(keys_of(F.col("_url"))).alias("k")).select("_url", "_at", "k.kind", "k.pattern")
    active = (F.col("starts") <= F.col("_at")) & (F.col("ends").isNull() | (F.col("_at") < F.col("ends")))
    # intervals of a checked size go to the captures' keys, which then need no shuffle; larger lists meet them in one
    hits = keyed.join(small(valid), ["kind", "pattern"]).where(active).groupBy("_url", "_at").agg(F.count("*").alias("n_hits"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("lists"))
    joined = captures.join(hits, (F.col(url) == F.col("_url")) & (F.col(fetched) == F.col("_at")), "left").drop("_url", "_at")
    return joined.withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("long"))).withColumn("lists", F.coalesce("lists", F.lit(""))).withColumn("blocked", F.col("n_hits") > 0)
