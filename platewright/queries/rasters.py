"""Queries of rasters over the plates of `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.operators import plates, raster
from platewright.registry import DIRECTIONS_SQL, PLATES_SQL, _plates, query


def _page(spark, sf_dir):
    return _plates(spark, sf_dir).withColumn("page", F.lit(1))


@query(f"select ink, x, y, sum(c)::double as cov from (select ink, x + 1 as x, y - 1 as y, cov * 0.5 as c from {PLATES_SQL} union all select ink, x + 2, y - 1, cov * 0.5 from {PLATES_SQL}) group by all")
def misregistration(spark, sf_dir):
    """Every plate moved by one and a half pixels to the right and one up."""
    return raster.shifted(_plates(spark, sf_dir), 1.5, -1.0).select("ink", "x", "y", F.col("cov").cast("double").alias("cov"))


@query(f"""
with m as (select distinct x, y from {PLATES_SQL} where cov > 230), d as (select distinct m.x + a.i as x, m.y + b.i as y from m, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i))
select 'dilated' as step, count(*) as pixels from d union all select 'closed', count(*) from (select x - a.i as x, y - b.i as y from d, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i) group by 1, 2 having count(*) = 9)
union all select 'eroded', count(*) from (select m.x - a.i as x, m.y - b.i as y from m, (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i) group by 1, 2 having count(*) = 9)
""")
def morphology(spark, sf_dir):
    """Pixels of a mask after growing, closing and shrinking."""
    m = _page(spark, sf_dir).where("cov > 230").select("page", "x", "y").distinct()
    box = raster.square(3)
    count = lambda df, name: df.agg(F.lit(name).alias("step"), F.count("*").alias("pixels"))
    return count(raster.dilated(m, box), "dilated").unionByName(count(raster.closed(m, box), "closed")).unionByName(count(raster.eroded(m, box), "eroded"))


@query(f"""
with recursive t as (select x, y, sum(cov) * 100 / 255.0::double as total from {PLATES_SQL} where ink in (1, 2, 3, 4) group by 1, 2),
o as (select a, b from (values (-1), (0), (1)) s(a), (values (-1), (0), (1)) u(b)),
grown as (select distinct x + a as x, y + b as y from t, o where total > 250), mask as (select x - a as x, y - b as y from grown, o group by 1, 2 having count(*) = 9),
walk(i, x, y, l) as (
  select 0, x, y, y * 1000 + x from mask
  union all select any_value(v.i) + 1, v.x, v.y, min(n.l) from (select i, x, y, x + a as u, y + b as v from walk, o where i < 300) v join walk n on n.x = v.u and n.y = v.v group by v.x, v.y),
parts as (select x, y, l from walk where i = 300),
boxes as (select l, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from parts group by l having (max(x) - min(x) + 1) * (max(y) - min(y) + 1) * (25.4::double / 50) ** 2 >= 0.1::double)
select 1 as page, any_value(b.x) as x, any_value(b.y) as y, any_value(w) as w, any_value(h) as h, round(max(total), 1) as greatest from boxes b join parts p using (l) join t on t.x = p.x and t.y = p.y group by l
""")
def high_coverage_regions(spark, sf_dir):
    """Connected regions of total coverage above a limit."""
    t = plates.totals(_plates(spark, sf_dir), [1, 2, 3, 4]).withColumn("page", F.lit(1))
    return raster.high_regions(t, 250.0, 50.0, 0.1)


@query(f"select cov > mod(x * 7 + y * 13, 64) * 4 + 2 as on, count(*) as pixels from {PLATES_SQL} group by 1")
def fm_screen(spark, sf_dir):
    """Plates through a tiled threshold mask."""
    mask = spark.range(64 * 64).select((F.col("id") % 64).alias("mx"), F.floor(F.col("id") / 64).alias("my")).withColumn("threshold", (F.pmod(F.col("mx") * 7 + F.col("my") * 13, F.lit(64)) * 4 + 2) / 255.0)
    return raster.fm_screen(_plates(spark, sf_dir), mask).groupBy("on").agg(F.count("*").alias("pixels"))


@query(f"""
with h as (select cos(2 * pi() * ((a + 0.5) / 256 - 0.5)) + cos(2 * pi() * ((b + 0.5) / 256 - 0.5)) as h from range(256) s(a), range(256) t(b)),
ranked as (select h, row_number() over (order by h) - 1 as k from h), levels as (select h, k // 64 as i from ranked where k % 64 = 0),
p as (select ink, x, y, cov / 255.0::double as c, (x * cos(radians(22.5)) + y * sin(radians(22.5))) * 55 / 300 as u, (y * cos(radians(22.5)) - x * sin(radians(22.5))) * 55 / 300 as v from {PLATES_SQL}),
g as (select *, cos(2 * pi() * (u - floor(u) - 0.5)) + cos(2 * pi() * (v - floor(v) - 0.5)) as g from p),
t as (select ink, c, (select count(*) from levels where i < 1023 and h < g.g) as below from g)
select ink, c > 1 - below / 1024.0::double and c > 0 as "on", count(*) as pixels from t group by all
""")
def am_screen(spark, sf_dir):
    """Plates through a turned clustered-dot screen."""
    return raster.am_screen(_plates(spark, sf_dir), 300.0).groupBy("ink", "on").agg(F.count("*").alias("pixels"))


@query(f"""
with l as (select x, y, min(struct_pack(c := -cov, i := ink)).i as ink from {PLATES_SQL} group by all)
select least(a.ink, b.ink) as a, greatest(a.ink, b.ink) as b, count(*) as length from l a join l b on (b.x = a.x + 1 and b.y = a.y or b.x = a.x and b.y = a.y + 1) and a.ink <> b.ink group by 1, 2
""")
def label_borders(spark, sf_dir):
    """How long the areas of two inks border on each other."""
    labels = raster.dominant(_page(spark, sf_dir)).withColumnRenamed("ink", "label")
    return raster.label_edges(labels).select("a", "b", "length")


@query(f"""
with l as (select x, y, min(struct_pack(c := -cov, i := ink)).i as ink from {PLATES_SQL} group by all), m as (select x, y, case when ink = 3 then 1 else ink end as ink from l), r as (select ink, row_number() over (order by ink) - 1 as label from (select distinct ink from m))
select label, count(*) as pixels from m join r using (ink) group by 1
""")
def labels_merged(spark, sf_dir):
    """Two labels made one, all numbered without gaps."""
    labels = raster.dominant(_page(spark, sf_dir)).withColumnRenamed("ink", "label")
    return raster.merged(labels, 1, 3).groupBy(F.col("label").cast("long").alias("label")).agg(F.count("*").alias("pixels"))


@query(f"""
with b as (select ink as page, cov as value, count(*) as n from {PLATES_SQL} group by all), c as (select *, sum(n) over (partition by page order by value) as w0, sum(n * value) over (partition by page order by value) as s0, sum(n) over (partition by page) as w, sum(n * value) over (partition by page) as s from b),
d as (select page, value, w0 * (w - w0) * power(s0 / w0::double - (s - s0) / (w - w0)::double, 2) as v from c where w0 < w)
select page, value as threshold from (select *, row_number() over (partition by page order by round(v, 3) desc, value) as k from d) where k = 1
""")
def histogram_threshold(spark, sf_dir):
    """The level that parts a plate's histogram best."""
    return raster.otsu(_plates(spark, sf_dir).select(F.col("ink").alias("page"), F.col("cov").alias("value")))


@query(f"""
with p as (select distinct x, y, ink from {PLATES_SQL} where cov >= 128), cell as (select x, y, list_sort(list(ink)) as inks from p group by all),
d(dx, dy) as (values {DIRECTIONS_SQL}), disc as (select a, b from range(-2, 3) s(a), range(-2, 3) t(b) where a * a + b * b <= 4),
border as (select distinct c.x, c.y from cell c, (values (1, 0), (-1, 0), (0, 1), (0, -1)) n(a, b) join cell o on o.x = c.x + n.a and o.y = c.y + n.b where o.inks <> c.inks),
band as (select distinct x + a as x, y + b as y from border, disc),
opened as (select c.x, c.y, c.inks[1] as ink, dx, dy from band join cell c using (x, y), d where len(c.inks) = 1 and not exists (select 1 from p where p.ink = c.inks[1] and p.x = c.x - dx and p.y = c.y - dy)),
probes as (select o.x as px, o.y as py, ink, dx, dy, s, cast(o.x + s * round(dx / sqrt(dx * dx + dy * dy) * k) as bigint) as x, cast(o.y + s * round(dy / sqrt(dx * dx + dy * dy) * k) as bigint) as y from opened o, (values (1), (-1)) t(s), (values (1), (2)) u(k)),
sides as (select ink, px, py, dx, dy from probes q where exists (select 1 from p where p.x = q.x and p.y = q.y and p.ink <> q.ink) or exists (select 1 from p where p.ink = q.ink and p.x = q.x - dx and p.y = q.y - dy)
  group by all having count(distinct s) = 2)
select ink, dx, dy, count(*) as slits from sides group by all
""")
def movement_check(spark, sf_dir):
    """Slits that open when an ink moves: inks, worst direction and pixels."""
    return plates.movement_check(_plates(spark, sf_dir), 1.0, 1.0, 128)
