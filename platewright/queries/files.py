"""Queries of history, jobs, recipes and watched files over `events` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.plans import history, recipes
from platewright.registry import query, table
from platewright.streaming import watch


@query("""
with j as (select event_id as id, ts, case when event_id % 17 = 0 then 'running' else 'done' end as status from events), n as (select id from j order by ts desc, id desc limit 60)
select id, status from j where status <> 'running' and id not in (select id from n)
""")
def job_evicted(spark, sf_dir):
    """Jobs that go: neither running nor among the 60 newest."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started"), F.when(F.col("event_id") % 17 == 0, "running").otherwise("done").alias("status"))
    return history.evicted(jobs).select("id", "status")


@query("""
with h as (select event_id as job_id, ts as t, value from events where event_id % 2 = 0), n as (select event_id as job_id, ts + interval 1 hour as t, value from events where event_id % 50 = 0),
b as (select * from h where job_id not in (select job_id from n) union all select * from n)
select job_id, round(value, 6) as value from b order by t desc, job_id limit 50
""")
def history_newest(spark, sf_dir):
    """The 50 newest entries after new ones took their ids' places."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("at"), "value")
    new = e.where("job_id % 50 = 0").withColumn("at", F.col("at") + F.expr("interval 1 hour"))
    return history.added(e.where("job_id % 2 = 0"), new).select("job_id", F.round("value", 6).alias("value"))


@query("""
with c as (select event_id, case when event_id % 3 = 0 then 'seen' end as event_type, case when event_id % 4 = 0 then value * 2 end as value from events where event_id % 5 = 0)
select e.event_id, coalesce(c.event_type, e.event_type) as event_type, round(coalesce(c.value, e.value), 6) as value from events e left join c using (event_id)
""")
def history_overlay(spark, sf_dir):
    """Entries with the fields that a change gives."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    k = F.col("event_id")
    changes = e.where("event_id % 5 = 0").select("event_id", F.when(k % 3 == 0, "seen").alias("event_type"), F.when(k % 4 == 0, F.col("value") * 2).alias("value"))
    return history.overlaid(e, changes, "event_id").select("event_id", "event_type", F.round("value", 6).alias("value"))


@query("select count(*) as old from events where ts < timestamp '2024-01-31' - interval 20 day")
def files_aged(spark, sf_dir):
    """Files older than 20 days."""
    return history.aged(table(spark, sf_dir, "events"), F.lit("2024-01-31").cast("timestamp"), 20, "ts").agg(F.count("*").alias("old"))


@query("""
select event_id, lag(event_id) over (partition by event_type, user_id order by ts, event_id) as previous from events
""")
def runs_previous(spark, sf_dir):
    """The newest earlier run of the same scope and label."""
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("run"), F.col("event_type").alias("scope"), F.col("user_id").alias("label"), F.col("ts").alias("at"))
    return history.previous(r).select(F.col("run").alias("event_id"), "previous")


FACTS = """select event_id, event_type, case when event_id % 9 = 0 then 'image' else 'pdf' end as kind, event_id % 5 = 0 as bad, 40.0 + event_id % 300 as width from events"""


@query(f"""
with f as ({FACTS}), r as (select *, case when kind <> 'pdf' then 'error' when bad then 'stopped' when floor((400 - 20 + 3) / (width + 3)) < 1 then 'error' else 'ok' end as state from f)
select event_type, count(*) as files, count(*) filter (state = 'ok') as ok, count(*) filter (state = 'stopped') as stopped, count(*) filter (state = 'error') as error from r group by 1
""")
def recipe_run(spark, sf_dir):
    """A recipe over files: checks, merges inks, distorts and repeats; counts by state."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    zero = {c: F.lit(0) for c in ("warnings", "annotations", "unused", "gaps")}
    files = e.select("event_type", k.cast("string").alias("file"), F.when(k % 9 == 0, "image").otherwise("pdf").alias("kind"), F.when(k % 5 == 0, 1).otherwise(0).alias("errors"), (F.lit(40.0) + k % 300).alias("width"), F.lit(50.0).alias("height"), F.lit(3).alias("inks"), F.lit(4).alias("names"), *(v.alias(c) for c, v in zero.items()))
    recipe = recipes.Recipe("labels", [("preflight", {}), ("separate.merge_duplicates", {}), ("tools.distortion", {"k": 1.14, "repeat": 400}), ("tools.step_repeat", {"sheet_w": 400, "sheet_h": 300}), ("report", {})])
    done = recipes.run(recipe, files)
    return done.groupBy("event_type").agg(F.count("*").alias("files"), *(F.count_if(F.col("state") == s).alias(s) for s in ("ok", "stopped", "error")))


@query("""
with s as (select o_orderkey as recipe, case o_orderkey % 5 when 0 then 'preflight' when 1 then 'tools.step_repeat' when 2 then 'separate.explode' when 3 then 'report' end as key, o_orderkey % 7 = 0 as extra, o_orderkey % 11 = 0 as nameless from orders)
select recipe, 'no name' as problem from s where nameless union all select recipe, 'no steps' from s where key is null
union all select recipe, 'no such step: separate.explode' from s where key = 'separate.explode' union all select recipe, 'no such parameter: colour' from s where extra and key in ('preflight', 'tools.step_repeat', 'report')
""")
def recipe_problems(spark, sf_dir):
    """What is wrong with recipes: names, steps and parameters."""
    k = F.col("o_orderkey")
    named = lambda m, a: F.struct(F.lit(m).cast("string").alias("module"), F.lit(a).alias("action"))
    step = F.when(k % 5 == 0, named(None, "preflight")).when(k % 5 == 1, named("tools", "step_repeat")).when(k % 5 == 2, named("separate", "explode")).when(k % 5 == 3, named(None, "report"))
    params = F.when(k % 7 == 0, F.create_map(F.lit("colour"), F.lit("red"))).otherwise(F.create_map().cast("map<string,string>"))
    steps = F.when(step.isNotNull(), F.array(F.struct(step["module"].alias("module"), step["action"].alias("action"), params.alias("params")))).otherwise(F.array().cast("array<struct<module:string,action:string,params:map<string,string>>>"))
    r = table(spark, sf_dir, "orders").select(k.alias("recipe"), F.when(k % 11 == 0, " ").otherwise("r").alias("name"), steps.alias("steps"))
    return recipes.problems(r).select("recipe", "problem")


@query("""
with o as (select user_id as file, ts, floor(value * 10)::bigint % 4 as length, event_id, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (select *, length = lag(length) over (partition by file order by k) and length > 0 as same from o where k <= 20)
select file, count(*) as seen, case when bool_or(same) then 'stable' when count(*) >= 20 then 'given up' else 'waiting' end as state from s group by 1
""")
def files_settled(spark, sf_dir):
    """Files whose size was seen twice in a row."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.struct("ts", "event_id").alias("at"), (F.floor(F.col("value") * 10) % 4).alias("length"))
    return watch.settled(e).select("file", F.col("seen").cast("long").alias("seen"), "state")


@query("""
with e as (select user_id as job, ts, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i, value from events), x as (select job, min(i) as ends from e where event_type in ('purchase', 'error') group by 1)
select e.job, case when min(x.ends) is null then 'running' when bool_or(e.i = x.ends and event_type = 'purchase') then 'done' else 'error' end as status from e left join x using (job) group by 1
""")
def job_states(spark, sf_dir):
    """The state of jobs from their events: the first end counts."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").otherwise("progress")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.row_number().over(w).alias("at"), kind.alias("kind"), F.col("event_type").alias("stage"), (F.col("value") / 100).alias("pct"), F.lit("failed").alias("error"))
    return watch.job_states(e).select("job", "status")


@query("select count(*) as n, start from (select time_bucket(interval 1 hour, ts) as start from events) group by start")
def hourly_events(spark, sf_dir):
    """Events in hourly windows, the batch form of the stream's."""
    return watch.windowed(table(spark, sf_dir, "events")).groupBy("window.start").agg(F.sum("n").alias("n")).select("n", "start")


@query("""
with d as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from d)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k
""")
def user_sessions(spark, sf_dir):
    """Events of a user in sessions."""
    return watch.sessions(table(spark, sf_dir, "events")).select("user_id", F.col("session_window.start").alias("start"), "n")
