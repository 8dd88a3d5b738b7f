"""Queries of colour functions, traps, scan profiles, ellipses, strokes and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import calculator
from platewright.operators import contours, distance, fitting, geometry, profiles, streams, strokes, trapping
from platewright.queries.contours import DISCS_SQL, disc_pages
from platewright.registry import PLATES_SQL, RGB_SQL, _colours, _plates, query, table

#: Programs over red, green and blue of 0 to 1, and a table of three by three samples over red and green.
PROGRAMS = {
    "branched": "{ add exch dup 0.5 gt { sub } { mul } ifelse }",
    "rolled": "{ 3 1 roll 2 copy add 2 div 4 1 roll pop pop sub abs }",
    "counted": "{ pop 360 mul exch 255 mul cvi 16 idiv 5 mod exch sin add }",
}
SAMPLES = [0.0, 64.0, 255.0, 32.0, 128.0, 200.0, 255.0, 16.0, 99.0]


@query(f"""
with c as (select p_partkey, r / 255.0::double as r, g / 255.0::double as g, b / 255.0::double as b from {RGB_SQL}),
t as (select *, least(floor(r * 2), 1)::int as i, least(floor(g * 2), 1)::int as j, {SAMPLES}::double[] as s from c)
select p_partkey, round(case when r > 0.5 then g + b - r else (g + b) * r end, 6) as branched, round(abs((r + g) / 2 - b), 6) as rolled, round(floor(trunc(r * 255) / 16) % 5 + sin(radians(g * 360)), 6) as counted,
  round(((s[i + 3 * j + 1] * (1 - (r * 2 - i)) + s[i + 3 * j + 2] * (r * 2 - i)) * (1 - (g * 2 - j)) + (s[i + 3 * j + 4] * (1 - (r * 2 - i)) + s[i + 3 * j + 5] * (r * 2 - i)) * (g * 2 - j)) / 255, 6) as tabulated from t
""")
def colour_programs(spark, sf_dir):
    """Calculator programs and a table of samples over the colours of parts."""
    c = _colours(spark, sf_dir)
    inputs = [F.col(k) / F.lit(255.0) for k in "rgb"]
    made = {name: calculator.calculated(p, inputs, [(0, 1)] * 3, [(-1000, 1000)])[0] for name, p in PROGRAMS.items()}
    made["tabulated"] = calculator.tabulated(F.array(*map(F.lit, SAMPLES)), inputs[:2], [3, 3], [(0, 1)] * 2, [(0, 1)])[0]
    return c.select("p_partkey", *(F.round(v, 6).alias(k) for k, v in made.items()))


@query(f"""
with {DISCS_SQL}, on_ as (select page, x, y, case label when 0 then 'Pale' when 1 then 'Yellow' else 'Blue' end as ink from pixels),
rules(spread, under, rule) as (values ('Pale', 'Blue', 'R4'), ('Yellow', 'Blue', 'R4'), ('Pale', 'Yellow', 'R5'), ('Yellow', 'Pale', 'R5')),
zone as (select distinct a.page, a.x, a.y, spread, under, rule from on_ a join rules on a.ink = under, (values (-1), (0), (1)) i(dx), (values (-1), (0), (1)) j(dy) join on_ b on b.page = a.page and b.x = a.x + dx and b.y = a.y + dy where b.ink = spread)
select page, spread, under, rule, count(*) as pixels from zone group by all
""")
def trap_log(spark, sf_dir):
    """Traps of a pixel between discs in two inks and a pale ground: pixels of each pair of inks."""
    c = F.col("label")
    plates = disc_pages(spark, sf_dir).select("page", F.when(c == 0, "Pale").when(c == 1, "Yellow").otherwise("Blue").alias("ink"), "x", "y", F.when(c == 0, 180).when(c == 1, 255).otherwise(240).alias("cov"))
    inks = spark.createDataFrame([("Pale", 86.0, "spot", 0.0), ("Yellow", 90.0, "spot", 0.0), ("Blue", 40.0, "spot", 0.0)], "ink string, lightness double, kind string, opacity double")
    pages = plates.select("page").distinct()
    return trapping.trapped(plates, pages.join(F.broadcast(inks)), 1, 1)[1]  # three inks on each page


@query("""
with p as (select l_suppkey as code, l_partkey % 120 as x, avg(l_quantity * 5) / 255 as v from lineitem group by all),
q as (select code, x, case when v <= 0.04045 then v / 12.92 else power((v + 0.055) / 1.055, 2.4) end as level from p),
e as (select code, quantile_cont(level, 0.97) as light, quantile_cont(level, 0.03) as dark from q group by 1),
m as (select q.*, light, dark, level < (light + dark) / 2 as dim from q join e using (code)),
n as (select *, coalesce(cast(dim <> lag(dim) over (partition by code order by x) as int), 0) as new from m),
s as (select *, sum(new) over (partition by code order by x) as part from n),
i as (select *, row_number() over (partition by code, part order by x) - 1 as i, count(*) over (partition by code, part) as n from s),
k as (select *, i >= n // 4 and i < greatest(n * 3 // 4, n // 4 + 1) as core, max(part) over (partition by code) as last from i),
g as (select code, part, any_value(last) as last, any_value(light - dark) as contrast, count(*) as n, quantile_cont(level, 0.5) filter (core) as level, max(level) filter (core) - min(level) filter (core) as spread from k group by code, part),
h as (select *, abs(level - lag(level) over (partition by code order by part)) as step from g where last <= 3 or (part > 0 and part < last))
select code, round(any_value(contrast), 6) as contrast, round(coalesce(min(step), any_value(contrast)) / any_value(contrast), 6) as modulation, round(coalesce(max(spread) filter (n > 3), 0) / any_value(contrast), 6) as defects from h group by code having any_value(contrast) > 1e-6
""")
def scan_figures(spark, sf_dir):
    """Contrast, modulation and defects of a profile for each supplier's lines, taken as a band of a bar code."""
    lines = table(spark, sf_dir, "lineitem")
    pixels = lines.select(F.col("l_suppkey").alias("code"), (F.col("l_partkey") % 120).alias("x"), F.lit(0).alias("y"), (F.col("l_quantity") * 5).alias("value"))
    kinds = lines.select(F.col("l_suppkey").alias("code"), F.lit("code39").alias("kind")).distinct()
    return profiles.figures(pixels, kinds).where(F.col("contrast") > 1e-6).select("code", *(F.round(c, 6).alias(c) for c in ("contrast", "modulation", "defects")))


@query()
def disc_ellipses(spark, sf_dir):
    """Ellipses through the rings of a page of discs: how many, and the greatest distance; tests hold a direct search."""
    rings = contours.points(contours.chains(disc_pages(spark, sf_dir)).where("closed")).where(F.col("pos") < F.col("length"))
    return geometry.fitted_ellipses(rings, ("page", "chain")).groupBy("page").agg(F.count("*").alias("rings"), F.round(F.max("error"), 4).alias("farthest"))


@query()
def ring_strokes(spark, sf_dir):
    """Rims of discs as strokes: how many of a page have one width, their mean width and the longest; tests hold a serial thinning."""
    discs = disc_pages(spark, sf_dir).where("label > 0")
    rims = distance.depths(discs.select("page", "x", "y")).where("square <= 5").select("page", "x", "y")
    lines = strokes.centre_lines(rims)
    return lines.groupBy("page", "stroke").agg(F.first("width").alias("width"), F.first("length").alias("length")).groupBy("page").agg(F.count("*").alias("strokes"), F.round(F.avg("width"), 4).alias("width"), F.max("length").alias("longest"))


@query()
def settings_tuned(spark, sf_dir):
    """Settings searched on two thirds of the conversations and held against the others; the search is iterative, tests plant its optimum."""
    samples = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("case"), F.length("text").alias("n"))
    number = lambda k: F.element_at("params", k).cast("int")
    cost = F.abs(F.coalesce("n", F.lit(0)) / 100.0 - number("window") * number("weight")) / 200.0
    score = lambda settings, part: part.join(F.broadcast(settings)).select("setting", cost.alias("cost"))  # noqa: E731  some dozen settings
    guard = lambda settings, part: part.join(F.broadcast(settings)).select("setting", (cost > 0.2).cast("int").alias("errors"), cost.alias("cost"))
    found = fitting.tuned(samples, {"window": [1, 2, 4, 8], "weight": [1, 2, 3]}, {"window": 8, "weight": 3}, score, guard)
    rows = [(k, v, found["adopted"]) for k, v in sorted(found["params"].items())]
    return spark.createDataFrame(rows, "option string, value int, adopted boolean")


@query(f"""
with p as (select x, y, case ink when 1 then 'Cyan' when 2 then 'Magenta' when 3 then 'Yellow' when 4 then 'Black' else 'Spot' || ink end as ink, cov from {PLATES_SQL}),
b as (select s_suppkey as id, s_suppkey * 7 % 60 as x, s_suppkey * 11 % 60 as y, 1 + s_suppkey % 9 as w, 1 + s_suppkey % 5 as h from supplier),
m as (select b.id, p.* from b join p on p.x between b.x and b.x + b.w - 1 and p.y between b.y and b.y + b.h - 1 where cov > 0),
d as (select id, x, y, max(case when ink = 'Black' then cov end) as k, sum(case when ink in ('Cyan', 'Magenta', 'Yellow') then cov else 0 end) as cmy from m group by all),
r as (select id, case when count(*) >= 4 then avg(cmy) / 255 * 100 / 3 end as black_cmy from d where k >= 127.5 group by 1),
s as (select id, count(distinct ink) as inks from m where cov > 63.75 group by 1)
select b.id, round(black_cmy, 6) as black_cmy, coalesce(inks, 0) as inks from b left join r using (id) left join s using (id)
""")
def boxes_on_plates(spark, sf_dir):
    """What plates print under boxes: coloured inks beneath solid black, and how many inks."""
    names = F.create_map(*(F.lit(v) for kv in {1: "Cyan", 2: "Magenta", 3: "Yellow", 4: "Black"}.items() for v in kv))
    plates = _plates(spark, sf_dir).select(F.lit(1).alias("page"), F.coalesce(F.try_element_at(names, F.col("ink").cast("int")), F.concat(F.lit("Spot"), F.col("ink").cast("string"))).alias("ink"), "x", "y", "cov")
    k = F.col("s_suppkey")
    boxes = table(spark, sf_dir, "supplier").select(F.lit(1).alias("page"), k.alias("id"), (k * 7 % 60).alias("x"), (k * 11 % 60).alias("y"), (1 + k % 9).alias("w"), (1 + k % 5).alias("h"))
    return streams.under_boxes(plates, boxes, tile=16).select("id", F.round("black_cmy", 6).alias("black_cmy"), "inks")
