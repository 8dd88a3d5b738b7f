"""Queries of matching, zones and scores over the boxes of `lineitem` and over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.operators import matching, zones
from platewright.registry import BOXES_SQL, _boxes, _sides, query, table

CATS = ["text", "color", "visual"]
CAT_SQL = "case {0} when 'A' then 'text' when 'N' then 'color' else 'visual' end"


def _named(df):
    return df.withColumn("cat", F.when(F.col("cat") == "A", "text").when(F.col("cat") == "N", "color").otherwise("visual"))


def _cased(spark, sf_dir):
    found, expected = _sides(spark, sf_dir)
    return _named(found), _named(expected)


GOOD_SQL = f"""{BOXES_SQL}, good as (select page, a, b, common::double / (la + ra - common) as iou from pairs where (common::double / (la + ra - common) >= 0.3 or centred)
 and ({CAT_SQL.format('cat')} = {CAT_SQL.format('rcat')} or ({CAT_SQL.format('cat')} <> 'text' and {CAT_SQL.format('rcat')} <> 'text')))"""


@query(f"with {GOOD_SQL} select page, a, b, round(iou, 6) as iou from good")
def match_candidates(spark, sf_dir):
    """Compatible boxes that may be one issue."""
    return matching.candidates(*_cased(spark, sf_dir)).select("l.page", F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round("iou", 6).alias("iou"))


@query()
def match_optimal(spark, sf_dir):
    """The one-to-one assignment of greatest total score on each page."""
    return matching.matched(*_cased(spark, sf_dir)).select("page", "a", "b", F.round("score", 6).alias("score"))


@query()
def match_totals(spark, sf_dir):
    """Precision, recall and F1 by category, of colour and visual together and of all, from the assignment."""
    found, expected = _cased(spark, sf_dir)
    return matching.totals(matching.case_counts(found, expected, matching.matched(found, expected)))


@query()
def revision_states(spark, sf_dir):
    """Issues of one revision that are fixed, persist or are new in the next, and how many."""
    found, expected = _cased(spark, sf_dir)
    extra = {"ignored": F.col("id") % 7 == 0, "status": F.when(F.col("id") % 5 == 0, "not_applicable").otherwise("pending"), "review": F.lit("none")}
    return matching.verified(found.withColumns(extra), expected.withColumns(extra)).groupBy("state").agg(F.count("*").alias("n"))


@query("""
with c as (select o_orderkey as page, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as r, sum(case when l_linestatus = 'F' then 1 else 0 end) as f, sum(l_quantity) as q, max(l_discount) as d from orders join lineitem on l_orderkey = o_orderkey group by 1), p as (
 select page, greatest(0.0, least(100.0, (1 - d) * 100.0))::double as visual, case when n <= 0 then 100.0 else greatest(0.0, least(100.0, 100.0 * f / n)) end::double as text, case when q <= 0 then 100.0 else greatest(0.0, least(100.0, 100.0 * (q - r) / q)) end::double as color,
  case when f <= 0 then 100.0 else greatest(0.0, least(100.0, 100.0 * (f - r) / f)) end::double as spelling, case when n <= 0 then 100.0 else greatest(0.0, least(100.0, 100.0 * (n - r) / n)) end::double as font from c), t as (
 select *, (visual * 0.30 + text * 0.35 + color * 0.15 + spelling * 0.10 + font * 0.10) / (0.30 + 0.35 + 0.15 + 0.10 + 0.10) as total from p)
select case when total >= 98 then 'approved' when total >= 90 then 'review' else 'errors' end as status, count(*) as pages, round(avg(total), 4) as total, round(avg(visual), 4) as visual, round(avg(text), 4) as text, round(avg(color), 4) as color, round(avg(spelling), 4) as spelling, round(avg(font), 4) as font from t group by 1
""")
def weighted_scores(spark, sf_dir):
    """Five scores of a page, their weighted total and status."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.sum("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    c = F.col
    rows = li.select("page", (1 - c("d")).alias("similarity"), c("f").alias("text_matched"), c("n").alias("text_total"), c("r").alias("colour_area"), c("q").alias("area"), c("r").alias("misspelled"), c("f").alias("spelled"), c("r").alias("fonts_bad"), c("n").alias("fonts"))
    exact = matching.scored(rows, digits=None)
    return exact.groupBy("status").agg(F.count("*").alias("pages"), *(F.round(F.avg(k), 4).alias(k) for k in ("total", "visual", "text", "color", "spelling", "font")))


@query("""
with c as (select conv_id, count(*) as turns, sum(case when role = 'user' then 1 else 0 end) as fp, avg(length(text)) / 1000.0 as cer, max(length(text)) / 10.0 as elapsed, bool_or(length(text) > 900) as bad from conversations group by 1)
select count(*) as cases, round(sum(fp) / count(*), 2) as fp_per_case, count(*) filter (turns % 2 = 0) as clean, round(100.0 * count(*) filter (turns % 2 = 0 and not bad) / nullif(count(*) filter (turns % 2 = 0), 0), 1) as clean_approved_pct,
 round(100 * avg(cer), 2) as cer_pct, round(avg(elapsed), 2) as mean_s, round(max(elapsed), 2) as max_s from c
""")
def global_stats(spark, sf_dir):
    """One row over all cases of a run: false ones, clean ones approved, error rate and times."""
    n = F.length("text")
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("page")).agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("fp"), (F.avg(n) / 1000.0).alias("cer"), (F.max(n) / 10.0).alias("elapsed"), F.bool_or(n > 900).alias("bad"))
    cases = c.select("page", (F.col("turns") % 2).alias("n_expected"), F.when(F.col("bad"), "errors").otherwise("approved").alias("status"), "cer", "elapsed")
    return matching.run_statistics(cases, c.select("page", "fp"))


@query("""
with z as (select s_suppkey as id, s_nationkey::bigint as page, least(greatest(s_acctbal / 8000.0::double, 0), 1) as x, least(greatest((s_suppkey % 13) / 10.0::double, 0), 1) as y, s_suppkey % 7 / 5.0::double as w0, (s_suppkey % 5 - 1) / 3.0::double as h0, case s_suppkey % 4 when 0 then 'color' when 1 then 'text' when 2 then 'all' else 'odd' end as m from supplier)
select id, x, y, least(greatest(w0, 0), 1 - x) as w, least(greatest(h0, 0), 1 - y) as h, case when m = 'odd' then 'all' else m end as mode from z
""")
def zones_clamped(spark, sf_dir):
    """Zones held in the unit square."""
    k = F.col("s_suppkey")
    mode = F.when(k % 4 == 0, "color").when(k % 4 == 1, "text").when(k % 4 == 2, "all").otherwise("odd")
    z = table(spark, sf_dir, "supplier").select(k.alias("id"), (F.col("s_acctbal") / 8000.0).alias("x"), ((k % 13) / F.lit(10.0)).alias("y"), (k % 7 / F.lit(5.0)).alias("w"), ((k % 5 - 1) / F.lit(3.0)).alias("h"), mode.alias("mode"))
    return zones.clamped(z).select("id", *"xywh", "mode")


@query(f"""with {BOXES_SQL}, z as (select page, id as zid, x, y, w, h, case when cat = 'A' then 'all' when cat = 'N' then 'color' else 'text' end as mode from boxes where side = 'O'),
i as (select page, id, x, y, w, h, {CAT_SQL.format('cat')} as cat from boxes where side = 'F')
select cat, count(distinct (i.page, i.id)) as n from i join z on i.page = z.page and least(i.x + i.w, z.x + z.w) > greatest(i.x, z.x) and least(i.y + i.h, z.y + z.h) > greatest(i.y, z.y)
 and ((i.x + i.w / 2.0 between z.x and z.x + z.w and i.y + i.h / 2.0 between z.y and z.y + z.h) or (least(i.x + i.w, z.x + z.w) - greatest(i.x, z.x)) * (least(i.y + i.h, z.y + z.h) - greatest(i.y, z.y)) * 2 >= greatest(i.w * i.h, 1))
 where mode = 'all' or (mode = 'color' and cat = 'color') or (mode = 'text' and cat = 'text') group by 1""")
def zones_ignored(spark, sf_dir):
    """Issues that a zone hides by its mode, by category."""
    found, other = _sides(spark, sf_dir)
    mode = F.when(F.col("cat") == "A", "all").when(F.col("cat") == "N", "color").otherwise("text")
    hidden = zones.ignored(_named(found).withColumn("subtype", F.lit("x")), other.withColumn("mode", mode))
    return hidden.select("page", "id", "cat").distinct().groupBy("cat").agg(F.count("*").alias("n"))


@query(f"""
with {BOXES_SQL}, f as (select page, id, any_value(x) as x, any_value(y) as y, any_value(w) as w, any_value(h) as h from boxes where side = 'F' group by all),
r as (select f.page, f.id, f.w * f.h as area, greatest(f.x, o.x) as x0, least(f.x + f.w, o.x + o.w) as x1, greatest(f.y, o.y) as y0, least(f.y + f.h, o.y + o.h) as y1 from f join boxes o on o.page = f.page and o.side = 'O'
  and least(f.x + f.w, o.x + o.w) > greatest(f.x, o.x) and least(f.y + f.h, o.y + o.h) > greatest(f.y, o.y)),
cuts as (select page, id, v, lead(v) over (partition by page, id order by v) as after from (select page, id, x0 as v from r union select page, id, x1 from r)),
strips as (select r.page, r.id, v, after - v as wide, y0, y1, max(y1) over (partition by r.page, r.id, v order by y0, y1 rows between unbounded preceding and 1 preceding) as high from r join cuts c on c.page = r.page and c.id = r.id and r.x0 <= v and r.x1 >= after),
shares as (select page, id, sum(wide * greatest(y1 - greatest(y0, coalesce(high, y0)), 0)) as common from strips group by all)
select f.page, f.id, round(coalesce(common, 0)::double / greatest(f.w * f.h, 1), 6) as share from f left join shares using (page, id)
""")
def covered_shares(spark, sf_dir):
    """How much of a box lies in the union of the other side's boxes."""
    found, expected = _sides(spark, sf_dir)
    once = found.dropDuplicates(["page", "id"])
    return zones.covered_share(once, expected, "share").select("page", "id", F.round("share", 6).alias("share"))


@query("""
with m as (select s_suppkey as id, s_nationkey, (s_suppkey % 10) / 10.0 as x, 0.1 as y, 0.25 as w, 0.2 as h from supplier where s_suppkey <= 40)
select id as page, count(*) as pixels, min(px) as x0, max(px) as x1 from m, unnest(range(0, 64)) t(px), unnest(range(0, 48)) u(py) where px between floor(x * 64) and floor((x + w) * 64) and py between floor(y * 48) and floor((y + h) * 48) group by 1
""")
def zone_mask_grid(spark, sf_dir):
    """Pixels of a grid that zones cover."""
    k = F.col("s_suppkey")
    z = table(spark, sf_dir, "supplier").where("s_suppkey <= 40").select(k.alias("page"), ((k % 10) / F.lit(10.0)).alias("x"), F.lit(0.1).alias("y"), F.lit(0.25).alias("w"), F.lit(0.2).alias("h"), F.lit("all").alias("mode"))
    return zones.mask(z, 64, 48, ["all"]).groupBy("page").agg(F.count("*").alias("pixels"), F.min("x").cast("long").alias("x0"), F.max("x").cast("long").alias("x1"))
