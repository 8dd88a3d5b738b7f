"""Queries of results' views, source kinds, outlines, colour functions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.operators import geometry, raster, results
from platewright.registry import PLATES_SQL, _plates, query, table

SCREENS_SQL = ", ".join(f"'{a}x{b}'" for w, h in results.SCREENS for a, b in ((w, h), (h, w)))


@query(f"""
with f as (select p_partkey, 600 + p_partkey % 7 * 160 as width, 400 + p_size * 8 as height, p_partkey % 41 = 0 as framed, p_partkey % 23 = 0 as camera, case when p_partkey % 5 = 0 then 300 else 72 end as dpi, case when p_partkey % 3 = 0 then 'PNG' when p_partkey % 3 = 1 then 'JPEG' end as format,
 case when p_partkey % 19 = 0 then '.tif' else '.jpg' end as suffix, 50.0 + p_partkey % 50 as quality from part)
select p_partkey, case when format is null then 'export' when framed or width || 'x' || height in ({SCREENS_SQL}) then 'capture' when camera then 'photo' when suffix = '.tif' or dpi between 150 and 600 then 'scan'
 when format = 'JPEG' and greatest(width, height) in (1600, 1280, 1024, 960, 800, 640) and quality <= 85 then 'chat' else 'export' end as source_kind from f
""")
def source_kinds(spark, sf_dir):
    """Captures, photos, scans, chat pictures and exports by ordered rules."""
    k = F.col("p_partkey")
    no = F.lit(False)
    files = table(spark, sf_dir, "part").select("p_partkey", (600 + k % 7 * 160).alias("width"), (400 + F.col("p_size") * 8).alias("height"), (k % 41 == 0).alias("framed"), (k % 23 == 0).alias("camera"), F.when(k % 5 == 0, 300).otherwise(72).alias("dpi"), F.when(k % 3 == 0, "PNG").when(k % 3 == 1, "JPEG").alias("format"), F.when(k % 19 == 0, ".tif").otherwise(".jpg").alias("suffix"), (50.0 + k % 50).alias("quality"), F.lit("").alias("software"), no.alias("lit"), no.alias("perspective"))
    return results.source_kind(files).select("p_partkey", "source_kind")


@query("""
with i as (select l_orderkey, case l_returnflag when 'A' then 'text' when 'N' then 'color' else 'visual' end as cat, l_linenumber = 1 as ignored, case l_linestatus when 'O' then 'fixed' end as status from lineitem)
select cat, count(*) as n, count(*) filter (not ignored) as counted, count(*) filter (not ignored and coalesce(status, 'pending') = 'pending') as pending from i group by 1
""")
def issue_counts(spark, sf_dir):
    """Issues by category with ignored ones, those that count, and those still pending."""
    i = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "color").otherwise("visual").alias("cat"), (F.col("l_linenumber") == 1).alias("ignored"), F.when(F.col("l_linestatus") == "O", "fixed").alias("status"))
    return results.category_counts(i).join(results.checklist(i, "cat").select("cat", "pending"), "cat")


@query("select o_orderpriority as batch, count(*) as pages, min(o_totalprice / 5000) as least, case when min(o_totalprice / 5000) >= 98 then 'approved' when min(o_totalprice / 5000) >= 90 then 'review' else 'errors' end as status from orders group by 1")
def batch_worst_page(spark, sf_dir):
    """A batch's status is that of its worst page."""
    return results.batch_totals(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("batch"), (F.col("o_totalprice") / 5000).alias("total"))).drop("mean")


@query("""
with p as (select p_partkey, (p_partkey % 11)::double as a, (p_partkey % 7)::double as b, p_size::double as c from part)
select p_partkey, round((0 * 0 - c * a + c * b - (c + 1) * 0 + (c + 1) * a - b * b + b * a - 0 * a) / 2, 6) as area from (select p_partkey, a, b, c from p)
""")
def outline_areas(spark, sf_dir):
    """Signed areas of outlines of four points."""
    a, b, c = (F.col("p_partkey") % 11).cast("double"), (F.col("p_partkey") % 7).cast("double"), F.col("p_size").cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(point(F.lit(0.0), a), point(c, F.lit(0.0)), point(c + 1, b), point(b, a))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(geometry.signed_area(points), 6).alias("area"))


@query("""
with p as (select p_partkey, (p_partkey % 101) / 100.0::double as x, (p_size % 3 + 1)::double as n from part)
select p_partkey, round(0.1 + power(x, n) * (0.9 - 0.1), 6) as spot, round(case when x >= 1 then 3.0 when x * 3 < 1 then 0.0 + x * 3 * 2 when x * 3 < 2 then 2.0 + (x * 3 - 1) * -1 else 1.0 + (x * 3 - 2) * 2 end, 6) as table_value,
 round(case when x < 0.5 then x / 0.5 else 1 - power((x - 0.5) / 0.5, 2) end, 6) as stitched, round(sqrt(x * x + 2), 6) as program from p
""")
def colour_functions(spark, sf_dir):
    """Exponential, sampled, stitched and calculated functions of a tint."""
    d = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 101) / F.lit(100.0)).alias("x"), (F.col("p_size") % 3 + 1).cast("double").alias("n"))
    a = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    piece = lambda c0, c1, n: F.struct(a(c0).alias("c0"), a(c1).alias("c1"), F.lit(float(n)).alias("n"))
    spot = geometry.exponential(F.col("x"), a(0.1), a(0.9), F.col("n"))
    stitched = geometry.stitched(F.col("x"), a(0.5), F.array(piece(0, 1, 1), piece(1, 0, 2)))
    program = geometry.calculated(F.col("x"), F.array(*map(F.lit, "dup mul 2 add sqrt".split())))
    return d.select("p_partkey", F.round(spot[0], 6).alias("spot"), F.round(geometry.sampled(F.col("x"), a(0, 2, 1, 3)), 6).alias("table_value"), F.round(stitched[0], 6).alias("stitched"), F.round(program[0], 6).alias("program"))


@query("""
with e as (select user_id as chain, value as x, (event_id % 97)::double as y from events),
m as (select chain, avg(x) as mx, avg(y) as my from e group by 1),
d as (select e.chain, mx, my, x - mx as u, y - my as v from e join m using (chain)),
s as (select chain, mx, my, count(*) as n, sum(u * u) as uu, sum(u * v) as uv, sum(v * v) as vv, sum(u * u * u) as uuu, sum(v * v * v) as vvv, sum(u * v * v) as uvv, sum(v * u * u) as vuu from d group by all),
t as (select *, case when abs(uu * vv - uv * uv) > 1e-9 then uu * vv - uv * uv end as det, (uuu + uvv) / 2 as bu, (vvv + vuu) / 2 as bv from s),
c as (select chain, mx + (bu * vv - bv * uv) / det as cx, my + (bv * uu - bu * uv) / det as cy, sqrt(power((bu * vv - bv * uv) / det, 2) + power((bv * uu - bu * uv) / det, 2) + (uu + vv) / n) as r from t)
select chain, round(any_value(cx), 4) as cx, round(any_value(cy), 4) as cy, round(any_value(r), 4) as r, round(max(abs(sqrt(power(x - cx, 2) + power(y - cy, 2)) - r)), 4) as error from e join c using (chain) group by chain
""")
def fitted_circles(spark, sf_dir):
    """Least-squares circles through the events of each user, taken as points."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chain"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return geometry.fitted_circles(e).select("chain", *(F.round(c, 4).alias(c) for c in ("cx", "cy", "r", "error")))


@query("""
with o as (select distinct user_id from events where event_type = 'purchase'), s as (select distinct user_id from events where event_type = 'search')
select 'both' as side, count(*) as users from (select * from o intersect select * from s) union all select 'first', count(*) from (select * from o except select * from s) union all select 'second', count(*) from (select * from s except select * from o)
""")
def set_operations(spark, sf_dir):
    """Users of two event types: in both, and in one alone."""
    e = table(spark, sf_dir, "events")
    one, two = (e.where(F.col("event_type") == t).select("user_id").distinct() for t in ("purchase", "search"))
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("users"))
    return n(one.intersect(two), "both").unionByName(n(one.exceptAll(two), "first")).unionByName(n(two.exceptAll(one), "second"))


@query(f"""
with p as (select x, y, ink, cov from {PLATES_SQL} where ink = 1), s as (select a.x, a.y, a.cov, avg(b.cov) as m, stddev_pop(b.cov) as d from p a join p b on abs(a.x - b.x) <= 2 and abs(a.y - b.y) <= 2 group by all)
select cov > m * (1 + 0.2::double * (d / 128.0::double - 1)) as "on", count(*) as pixels from s group by 1
""")
def local_threshold(spark, sf_dir):
    """A plate against a threshold of each pixel's neighbourhood."""
    p = _plates(spark, sf_dir).where("ink = 1").select(F.lit(1).alias("page"), "x", "y", F.col("cov").alias("value"))
    return raster.local_threshold(p, 5).groupBy("on").agg(F.count("*").alias("pixels"))


@query(f"""
with p as (select x, y, sum(case when ink <= 3 then cov else 0 end)::bigint as p, sum(cov)::bigint as q from {PLATES_SQL} group by 1, 2),
w as (select a.x, a.y, sum(b.p)::double as sp, sum(b.q)::double as sq, sum(b.p * b.p)::double as pp, sum(b.q * b.q)::double as qq, sum(b.p * b.q)::double as pq
  from p a, (values (-1), (0), (1)) i(dx), (values (-1), (0), (1)) j(dy) join p b on b.x = a.x + dx and b.y = a.y + dy group by all having count(*) = 9),
s as (select (2 * (sp / 9) * (sq / 9) + power(17.85, 2)) * (2 * (pq - sp * sq / 9) / 8 + power(53.55, 2)) / ((power(sp / 9, 2) + power(sq / 9, 2) + power(17.85, 2)) * ((pp - sp * sp / 9) / 8 + (qq - sq * sq / 9) / 8 + power(53.55, 2))) as s from w)
select 1 as page, round(coalesce(avg(s), 1.0), 6) as similarity from s
""")
def plate_similarity(spark, sf_dir):
    """Structural similarity of the total coverage of three inks and of all."""
    p = _plates(spark, sf_dir).groupBy("x", "y").agg(F.sum("cov").alias("all"), F.sum(F.when(F.col("ink") <= 3, F.col("cov")).otherwise(0)).alias("three"))
    side = lambda c: p.select(F.lit(1).alias("page"), "x", "y", F.col(c).alias("value"))
    r = raster.structural_similarity(side("three"), side("all"), 3, 1785.0)
    return r.select("page", F.round("similarity", 6).alias("similarity"))


@query()
def plates_composed(spark, sf_dir):
    """Mean colour of plates printed over each other on paper."""
    inks = spark.createDataFrame([(1, 55.0, -37.0, -50.0, 0.0, 1), (2, 48.0, 74.0, -3.0, 0.0, 2), (3, 89.0, -5.0, 93.0, 0.0, 3), (4, 16.0, 0.0, 0.0, 0.0, 4), (5, 94.0, 0.0, -2.0, 1.0, 5)], "ink int, L double, a double, b double, opacity double, rank int")
    made = raster.composed(_plates(spark, sf_dir).withColumn("page", F.lit(1)), inks)
    return made.groupBy("page").agg(F.count("*").alias("pixels"), *(F.round(F.avg(c), 4).alias(f"{c.lower()}_star") for c in ("L", "a", "b")))


@query(f"""
with p as (select x, y, ink, cov from {PLATES_SQL}), s as (select ink, round(sum(cov) / 121.0 / 255 * 100, 1) as v from p where x between 20 and 30 and y between 10 and 20 group by 1)
select round(sum(v), 1) as total, false as outside, count(*) as inks from s
""")
def densitometer(spark, sf_dir):
    """Percentages of a window on the page and their total."""
    r = raster.probed(_plates(spark, sf_dir).withColumn("page", F.lit(1)), 25, 15, 5, 64, 64)
    return r.select("total", "outside", F.size("inks").cast("long").alias("inks"))
