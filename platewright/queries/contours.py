"""Queries of contours, curves, distances and comparisons over pages of discs, made of `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.operators import contours, curves, diffusion, distance, illumination, raster, visual
from platewright.registry import query, table

#: A page is 64 by 64 pixels in 16 tiles with a disc each; its label and radius come from the quantities of the lines on it.
DISCS_SQL = """
tiles as (select l_orderkey // 512 as page, l_partkey % 4 as tx, l_suppkey % 4 as ty, cast(sum(l_quantity) as bigint) as s from lineitem group by all),
pixels as (
  select p.page, x, y, case when (2 * (x % 16) - 15) ** 2 + (2 * (y % 16) - 15) ** 2 <= 4 * (9 + s % 56) then 1 + s % 2 else 0 end as label
  from (select distinct page from tiles) p, range(64) a(x), range(64) b(y) left join tiles t on t.page = p.page and tx = x // 16 and ty = y // 16)"""

CRACKS_SQL = DISCS_SQL + """,
sides as (select page, 0 as o, x, y, 2 as k, coalesce(label, 0) as l from pixels union all select page, 0, x, y + 1, 1, coalesce(label, 0) from pixels
  union all select page, 1, x, y, 2, coalesce(label, 0) from pixels union all select page, 1, x + 1, y, 1, coalesce(label, 0) from pixels),
cut as (select page, o, x, y, coalesce(max(l) filter (k = 1), -1) as a, coalesce(max(l) filter (k = 2), -1) as b from sides group by all having a <> b),
ways as (
  select page, ((y << 29) + x) * 4 + o * 2 + d as id, o + 2 * d as dir, case when d = 0 then x else x + 1 - o end as x0, case when d = 0 then y else y + o end as y0,
         case when d = 1 then x else x + 1 - o end as x1, case when d = 1 then y else y + o end as y1, case when o = d then a else b end as l, case when o = d then b else a end as r
  from cut, (values (0), (1)) t(d))"""


def disc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels (page, x, y, label) of 64 by 64 pixels, as DISCS_SQL has them."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy(F.floor(c("l_orderkey") / 512).alias("page"), (c("l_partkey") % 4).alias("tx"), (c("l_suppkey") % 4).alias("ty")).agg(F.sum("l_quantity").cast("long").alias("s"))
    sixteen = F.explode(F.sequence(F.lit(0), F.lit(15)))
    tiles = lines.select("page").distinct().select("page", sixteen.alias("k")).select("page", (c("k") % 4).cast("long").alias("tx"), F.floor(c("k") / 4).alias("ty")).join(lines, ["page", "tx", "ty"], "left")
    inside = tiles.select("page", "tx", "ty", "s", sixteen.alias("i")).select("*", sixteen.alias("j"))
    far = F.pow(2 * c("i") - 15, F.lit(2)) + F.pow(2 * c("j") - 15, F.lit(2))
    return inside.select("page", (c("tx") * 16 + c("i")).alias("x"), (c("ty") * 16 + c("j")).alias("y"), F.when(far <= 4 * (9 + c("s") % 56), 1 + c("s") % 2).otherwise(0).cast("long").alias("label"))


@query(f"""
with recursive {CRACKS_SQL},
links as (
  select p.page, xor(p.id, 1) as id, p.r as label, arg_min(q.id, (q.dir - p.dir + 7) % 4) as nxt, any_value(p.x1) as hx, any_value(p.y1) as hy, any_value(p.x0) as tx, any_value(p.y0) as ty
  from ways p join ways q on q.page = p.page and q.x0 = p.x0 and q.y0 = p.y0 and q.l = p.r and q.id <> p.id where p.r >= 0 group by all),
walk(k, page, id, nxt, low) as (
  select 0, page, id, nxt, id from links
  union all select s.k + 1, s.page, s.id, t.nxt, least(s.low, t.low) from walk s join walk t on t.page = s.page and t.id = s.nxt where s.k < 12),
outlines as (select l.page, label, low, sum(tx * hy - hx * ty) / 2 as area, count(*) as n from links l join walk w on w.page = l.page and w.id = l.id and w.k = 12 group by all)
select page, label, count(*) filter (area > 0) as outlines, count(*) filter (area < 0) as holes, cast(sum(area) as bigint) as area, max(n) as longest from outlines group by all
""")
def contour_regions(spark, sf_dir):
    """Outlines and holes of each label of a page of discs; the areas are the numbers of pixels."""
    return contours.regions(contours.loops(disc_pages(spark, sf_dir)))


@query(f"""
with recursive {CRACKS_SQL},
corners as (select page, x0, y0, count(*) as n from ways group by all),
links as (
  select p.page, xor(p.id, 1) as id, case when n = 2 then q.id end as nxt, least(p.l, p.r) as a, greatest(p.l, p.r) as b
  from ways p join corners c on c.page = p.page and c.x0 = p.x0 and c.y0 = p.y0 left join ways q on q.page = p.page and q.x0 = p.x0 and q.y0 = p.y0 and q.id <> p.id and n = 2),
walk(k, page, id, nxt, low, last) as (
  select 0, page, id, nxt, id, id from links
  union all select s.k + 1, s.page, s.id, t.nxt, least(s.low, coalesce(t.low, s.low)), coalesce(t.last, s.last) from walk s left join walk t on t.page = s.page and t.id = s.nxt where s.k < 12),
lists as (select l.page, a, b, coalesce(case when w.nxt is not null then low end, last) as list, w.nxt is not null as closed, count(*) as n from links l join walk w on w.page = l.page and w.id = l.id and w.k = 12 group by all)
select page, nullif(a, -1) as a, b, cast(count(*) / 2 as bigint) as chains, cast(count(*) filter (closed) / 2 as bigint) as rings, cast(sum(n) / 2 as bigint) as length, max(n) as longest from lists group by all
""")
def contour_chains(spark, sf_dir):
    """Chains between nodes by the two labels that they part."""
    c = contours.chains(disc_pages(spark, sf_dir))
    outside = F.col("left").isNull() | F.col("right").isNull()
    each = c.select("page", F.when(~outside, F.least("left", "right")).alias("a"), F.greatest("left", "right").alias("b"), "chain", "length", "closed").distinct()
    return each.groupBy("page", "a", "b").agg(F.count("*").alias("chains"), F.count_if("closed").alias("rings"), F.sum("length").alias("length"), F.max("length").alias("longest"))


#: Discs that the client's page lacks, and those in the other colour.
CLIENT_SQL = DISCS_SQL.replace("then 1 + s % 2 else 0 end as label", "then 1 + s % 2 else 0 end as label, coalesce(s, 0) as s") + """,
painted as (select *, case when s % 7 = 0 then 0 when s % 11 = 1 and label > 0 then 3 - label else label end as other from pixels)"""

#: Red, green and blue of a label.
COLOURS = ((245, 200, 30), (245, 40, 70), (240, 60, 160))


def two_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Design and client (page, x, y, r, g, b): the client's pages lack discs, have others in the other colour, and darken to the right."""
    c = F.col
    lines = table(spark, sf_dir, "lineitem").groupBy(F.floor(c("l_orderkey") / 512).alias("page"), (c("l_partkey") % 4).alias("_tx"), (c("l_suppkey") % 4).alias("_ty")).agg(F.sum("l_quantity").cast("long").alias("_s"))
    pixels = disc_pages(spark, sf_dir).withColumns({"_tx": F.floor(c("x") / 16), "_ty": F.floor(c("y") / 16)}).join(lines, ["page", "_tx", "_ty"], "left").withColumn("_s", F.coalesce("_s", F.lit(0)))
    other = F.when(c("_s") % 7 == 0, 0).when((c("_s") % 11 == 1) & (c("label") > 0), 3 - c("label")).otherwise(c("label"))
    paint = lambda label, k: F.when(label == 0, COLOURS[k][0]).when(label == 1, COLOURS[k][1]).otherwise(COLOURS[k][2])
    design = pixels.select("page", "x", "y", *(paint(c("label"), k).alias(b) for k, b in enumerate("rgb")))
    return design, pixels.select("page", "x", "y", *(F.floor(paint(other, k) * (320 - c("x")) / 320).alias(b) for k, b in enumerate("rgb")))


@query(f"""
with {DISCS_SQL}, seeds as (select * from pixels where label > 0),
near as (select p.page, p.x, p.y, min((p.x - s.x) ** 2 + (p.y - s.y) ** 2) as square, arg_min(s.label, ((p.x - s.x) ** 2 + (p.y - s.y) ** 2) * 4 + s.label) as label from pixels p join seeds s using (page) where p.label = 0 group by all)
select page, label, count(*) as pixels, cast(max(square) as bigint) as farthest, cast(sum(square) as bigint) as squares from near group by all
""")
def nearest_discs(spark, sf_dir):
    """The nearest disc of every pixel of the ground, and how far it is, squared."""
    labels = disc_pages(spark, sf_dir)
    found = distance.nearest_seeds(labels.where("label = 0").select("page", "x", "y"), labels.where("label > 0")).where("label is not null")
    return found.groupBy("page", "label").agg(F.count("*").alias("pixels"), F.max("square").alias("farthest"), F.sum("square").alias("squares"))


@query(f"""
with {CLIENT_SQL}, green as (select page, x, y, [245, 40, 70][label + 1] as design, floor([245, 40, 70][other + 1] * (320 - x) / 320) as client from painted),
ranges as (select a.page, a.x, a.y, a.client, min(b.design) as low, max(b.design) as high from green a, (values (-2), (-1), (0), (1), (2)) i(dx), (values (-2), (-1), (0), (1), (2)) j(dy) join green b on b.page = a.page and b.x = a.x + dx and b.y = a.y + dy group by all)
select page, cast(sum(greatest(client - high, low - client, 0)) as bigint) as excess, count(*) filter (greatest(client - high, low - client, 0) > 40) as marked from ranges group by all
""")
def window_excess(spark, sf_dir):
    """How far a client's green leaves the range of the design's 5 by 5 window."""
    design, client = two_pages(spark, sf_dir)
    d = raster.tolerant_excess(design.select("page", "x", "y", F.col("g").alias("value")), client.select("page", "x", "y", F.col("g").alias("value")), 5)
    return d.groupBy("page").agg(F.sum("excess").cast("long").alias("excess"), F.count_if(F.col("excess") > 40).alias("marked"))


@query()
def visual_boxes(spark, sf_dir):
    """Differences of two pages as boxes with severity and kind; SQL has no components of pixels, tests compare small pages."""
    design, client = two_pages(spark, sf_dir)
    return visual.compared(design, illumination.normalized(design, client).drop("changed"))[1]


@query()
def light_evened(spark, sf_dir):
    """Light on the client's paper before and after it is evened, by page; tests remove a known gradient."""
    design, client = two_pages(spark, sf_dir)
    paper = design.where(F.col("g") == COLOURS[1][0]).select("page", "x", "y")
    spread = lambda df, name: df.join(paper, ["page", "x", "y"]).groupBy("page").agg(F.round(F.stddev_pop("g"), 4).alias(name))
    return spread(client, "before").join(spread(illumination.normalized(design, client), "after"), "page")


@query()
def index_separation(spark, sf_dir):
    """Pages in five inks by error diffusion: pixels of each; every pixel waits for its neighbours, tests hold a serial version."""
    _, client = two_pages(spark, sf_dir)
    inks = [(245, 245, 240), (200, 40, 60), (30, 70, 160), (20, 20, 20), (240, 190, 60)]
    return diffusion.diffused(client, inks).groupBy("page", "index").agg(F.count("*").alias("pixels"))


@query()
def fitted_outlines(spark, sf_dir):
    """Cubics through the outlines of the discs, by page: how many, and the greatest distance; tests hold a plain recursion."""
    made = curves.outlined(contours.points(contours.chains(disc_pages(spark, sf_dir))))
    return made.groupBy("page").agg(F.count("*").alias("cubics"), F.count_distinct("chain").alias("chains"), F.round(F.max("error"), 4).alias("farthest"))
