"""Queries of names, codes, units, presses and sheets over `part`, `supplier` and `orders`."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import braille, codes, names, press, units
from platewright.operators import layout
from platewright.registry import query, table

NAME_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(upper(trim(regexp_replace(replace({0}, '®', ''), '\s+', ' ', 'g'))), '^(?:PANTONE|PMS|P)\s*[-_ ]?(\d)', 'PANTONE \1'), '(\d)\s*(CP|UP|C|U|M)$', '\1 \2'), '\s+', ' ', 'g'))"""
RAW_SQL = "(select p_partkey, case p_partkey % 6 when 0 then 'pms ' || p_partkey || 'c' when 1 then 'Pantone  ' || p_partkey || ' U' when 2 then 'P-' || p_partkey || 'CP' when 3 then p_name when 4 then 'Blanco ' || p_brand else ' die  cut ' || p_size end as raw from part)"
KIND_SQL = r"""case when n in ('cyan', 'cian', 'magenta', 'yellow', 'amarillo', 'black', 'negro', 'key', 'c', 'm', 'y', 'k') then 'process'
 when regexp_matches(n, '(^|[^a-zñáéíóú])(white|blanco|weiss|weiß)') then 'white' when regexp_matches(n, '(^|[^a-zñáéíóú])(varnish|barniz|lack)') then 'varnish'
 when regexp_matches(n, '(^|[^a-zñáéíóú])(die|cut|troquel|stanz|dieline|braille|dimension|cota|crease|perf)') then 'technical' else 'spot' end"""


def _raw(spark, sf_dir):
    k = F.col("p_partkey")
    s = k.cast("string")
    raw = F.when(k % 6 == 0, F.concat(F.lit("pms "), s, F.lit("c"))).when(k % 6 == 1, F.concat(F.lit("Pantone  "), s, F.lit(" U"))).when(k % 6 == 2, F.concat(F.lit("P-"), s, F.lit("CP"))).when(k % 6 == 3, F.col("p_name")).when(k % 6 == 4, F.concat(F.lit("Blanco "), F.col("p_brand"))).otherwise(F.concat(F.lit(" die  cut "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))


@query(f"select p_partkey, name, {KIND_SQL} as kind from (select *, lower(name) as n from (select p_partkey, {NAME_SQL.format('raw')} as name from {RAW_SQL}))")
def ink_names(spark, sf_dir):
    """Names of inks in one spelling, and the kind that they tell."""
    return _raw(spark, sf_dir).select("p_partkey", names.normalized(F.col("raw")).alias("name"), names.kind_of(F.col("raw")).alias("kind"))


@query(r"""select p_partkey, nullif(substr(regexp_replace(trim(regexp_replace('.' || p_name || '/*' || p_brand || '?.', '[^\w\- .()áéíóúñÁÉÍÓÚÑ]', '', 'g')), '^\.+|\.+$', '', 'g'), 1, 80), '') as safe,
 substr(sha1(p_name), 1, 20) || '_' || p_size || '_300' as key from part""")
def file_names(spark, sf_dir):
    """Safe file names, and content keys of pages."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("."), "p_name", F.lit("/*"), "p_brand", F.lit("?."))
    return p.select("p_partkey", names.safe_name(raw).alias("safe"), names.file_key(F.col("p_name").cast("binary"), F.col("p_size"), F.lit(300.0)).alias("key"))


@query("""
with p as (select p_partkey, p_size * 3.5::double as v, 50.0::double + p_size * 7 as dpi, p_size * 40.0::double as w, (p_partkey % 90) * 60.0::double as h from part)
select p_partkey, round(v * 72 / 25.4, 6) as pt, round(v / 25.4, 6) as inch, round(v * dpi / 25.4, 6) as px, round(case when v = 0 then 0 else p_partkey / (v / 25.4) end, 4) as ppi,
 round(case when greatest(w, h) / 72 * dpi > 6000 then dpi * 6000 / (greatest(w, h) / 72 * dpi) else dpi end, 6) as effective,
 case when (w / 72 * dpi) * (h / 72 * dpi) / 1e6 <= 5 then dpi else floor(dpi * sqrt(5 / ((w / 72 * dpi) * (h / 72 * dpi) / 1e6))) end as planned,
 case when v <= 3.5 then 0 else greatest(ceil((v - 3.5) * 0.3::double - 1e-6), 1)::integer end as over from p
""")
def unit_conversions(spark, sf_dir):
    """Lengths and resolutions of placed pages."""
    v, dpi, w, h = F.col("p_size") * F.lit(3.5), F.col("p_size") * 7 + F.lit(50.0), F.col("p_size") * F.lit(40.0), (F.col("p_partkey") % 90) * F.lit(60.0)
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(units.mm_to_pt(v), 6).alias("pt"), F.round(units.mm_to_in(v), 6).alias("inch"), F.round(units.mm_to_px(v, dpi), 6).alias("px"), F.round(units.ppi_at_size(F.col("p_partkey"), v), 4).alias("ppi"),
        F.round(units.effective_dpi(w, h, dpi), 6).alias("effective"), units.planned_dpi(w, h, dpi, 5.0).alias("planned"), units.pixels_over(v - 3.5, F.lit(0.3)).alias("over"))


@query("""
with c as (select p_partkey, p_size::double as s, (p_partkey % 97)::double as t from part)
select p_partkey, floor(s * 150 / 72)::integer as x, greatest(2, floor(t * 150 / 72)::integer) as w, round(10 + s - 1.5, 6) as "left", round(5 + s + t - 2.5, 6) as top, s + 1.5 >= t and s <= 50 as touch,
 round(case when t <= 0 then 1.0 else greatest(0.01, least(64.0, 800 / t)) end, 6) as zoom from c
""")
def page_geometry(spark, sf_dir):
    """Boxes in pixels, in document coordinates, in touch, and zoomed to."""
    s, t = F.col("p_size").cast("double"), (F.col("p_partkey") % 97).cast("double")
    box = F.struct(s.alias("x0"), (s + t).alias("y0"), (s + t).alias("x1"), s.alias("y1"))
    board = F.struct(F.lit(10.0).alias("x0"), F.lit(500.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(5.0).alias("y1"))
    document = units.page_to_document(box, board, 1.5, 2.5)
    a = F.struct(s.alias("left"), F.lit(10.0).alias("top"), (s + 1.5).alias("right"), F.lit(0.0).alias("bottom"))
    b = F.struct(t.alias("left"), F.lit(20.0).alias("top"), F.lit(50.0).alias("right"), F.lit(10.0).alias("bottom"))
    zoom = units.fit_zoom(F.struct(F.lit(0.0).alias("left"), t.alias("top"), t.alias("right"), F.lit(0.0).alias("bottom")), F.lit(800.0), F.lit(800.0))
    px = units.box_px(s, s, s + t, s + t)
    return table(spark, sf_dir, "part").select("p_partkey", px["x"].alias("x"), px["w"].alias("w"), F.round(document["left"], 6).alias("left"), F.round(document["top"], 6).alias("top"), units.touches(a, b).alias("touch"), F.round(zoom, 6).alias("zoom"))


DIGIT_SQL = "(10 - (list_sum(list_transform(range(1, length({0}) + 1), lambda i: cast(substr(reverse({0}), i, 1) as integer) * case when i % 2 = 1 then 3 else 1 end)) % 10)) % 10"


@query(f"""
with d as (select p_partkey, lpad(cast(p_partkey * 7919 as varchar), 12, '0') as body, p_partkey % 4 as m from part), c as (
 select *, {DIGIT_SQL.format('body')} as digit from d), t as (
 select p_partkey, case m when 0 then body when 1 then body || digit when 2 then body || ((digit + 1) % 10) else substr(body, 1, 7) || 'x' end as text, body, digit, m from c)
select p_partkey, case m when 0 then body || digit when 1 then body || digit end as code, m = 0 as computed, case m when 2 then 'wrong check digit' when 3 then 'digits only' end as problem, m = 1 as valid from t
""")
def code_checks(spark, sf_dir):
    """Codes one digit short, whole, wrong, and no digits at all."""
    body = F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0")
    digit = codes.check_digit(body)
    m = F.col("p_partkey") % 4
    text = F.when(m == 0, body).when(m == 1, F.concat(body, digit.cast("string"))).when(m == 2, F.concat(body, ((digit + 1) % 10).cast("string"))).otherwise(F.concat(F.left(body, F.lit(7)), F.lit("x")))
    p = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), m.alias("m")).withColumn("e", codes.ensured(F.col("text"), 13))
    return p.select("p_partkey", "e.code", "e.computed", "e.problem", ((F.col("m") != 0) & codes.valid_check(F.col("text"))).alias("valid"))


@query(f"""
with d as (select p_partkey, (p_partkey % 2)::varchar || lpad(cast(p_partkey * 37 % 1000000 as varchar), 6, '0') as d from part), x as (
 select p_partkey, d, case when substr(d, 7, 1) in ('0', '1', '2') then substr(d, 1, 3) || substr(d, 7, 1) || '0000' || substr(d, 4, 3) when substr(d, 7, 1) = '3' then substr(d, 1, 4) || '00000' || substr(d, 5, 2)
  when substr(d, 7, 1) = '4' then substr(d, 1, 5) || '00000' || substr(d, 6, 1) else substr(d, 1, 6) || '0000' || substr(d, 7, 1) end as body from d)
select p_partkey, d || ({DIGIT_SQL.format('body')}) as code, body || ({DIGIT_SQL.format('body')}) as wide from x
""")
def code_expansion(spark, sf_dir):
    """Seven digits of a zero-suppressed code with their check digit, and the twelve they stand for."""
    d = F.concat((F.col("p_partkey") % 2).cast("string"), F.lpad((F.col("p_partkey") * 37 % 1000000).cast("string"), 6, "0"))
    p = table(spark, sf_dir, "part").select("p_partkey", codes.upce_ensured(d)["code"].alias("code"))
    return p.select("p_partkey", "code", codes.upce_expanded(F.col("code")).alias("wide"))


AI_SQL = "(select s_suppkey, '(17)' || lpad(cast(20 + s_suppkey % 9 as varchar), 2, '0') || lpad(cast(1 + s_suppkey % 14 as varchar), 2, '0') || lpad(cast(s_suppkey % 32 as varchar), 2, '0') || '(10)' || s_name || '(99)x(37)' || s_nationkey as data from supplier)"


@query(f"""
with p as (select s_suppkey, unnest(regexp_extract_all(data, '\\((\\d+)\\)([^(]*)', 1)) as ai, unnest(regexp_extract_all(data, '\\((\\d+)\\)([^(]*)', 2)) as value from {AI_SQL})
select s_suppkey, ai, value, case when ai = '99' then 'unknown identifier' when ai = '10' and length(value) > 20 then 'wrong length'
 when ai = '17' and try_strptime('20' || substr(value, 1, 4) || case when substr(value, 5) = '00' then '01' else substr(value, 5) end, '%Y%m%d') is null then 'no such date' end as problem from p
""")
def code_identifiers(spark, sf_dir):
    """Pairs of application identifiers, each with what is wrong with it."""
    k = F.col("s_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    data = F.concat(F.lit("(17)"), two(20 + k % 9), two(1 + k % 14), two(k % 32), F.lit("(10)"), "s_name", F.lit("(99)x(37)"), F.col("s_nationkey").cast("string"))
    return codes.parsed(table(spark, sf_dir, "supplier").select("s_suppkey", data.alias("data"))).select("s_suppkey", "ai", "value", "problem")


@query("""
with m as (select p_partkey, p_size * 2.0::double as c, (p_partkey % 100) / 100.0::double as m, (p_partkey % 37) / 100.0::double as d, (p_partkey % 11) / 10.0::double as dark from part), g as (
 select *, case when c >= 70 then 4 when c >= 55 then 3 when c >= 40 then 2 when c >= 20 then 1 else 0 end as gc, case when m >= 0.7 then 4 when m >= 0.6 then 3 when m >= 0.5 then 2 when m >= 0.4 then 1 else 0 end as gm,
  case when d <= 0.15 then 4 when d <= 0.2 then 3 when d <= 0.25 then 2 when d <= 0.3 then 1 else 0 end as gd, case when dark <= 0.45 then 4 else 0 end as gr from m)
select p_partkey, substr('FDCBA', least(gc, gm, gd, gr) + 1, 1) as grade from g
""")
def code_grades(spark, sf_dir):
    """Letter of the worst partial grade of a scan profile."""
    c, k = F.col("p_size") * F.lit(2.0), F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", codes.symbol_grade(c, (k % 100) / F.lit(100.0), (k % 37) / F.lit(100.0), (k % 11) / F.lit(10.0), F.lit(0.9)).alias("grade"))


@query("""
with j as (select o_orderkey as job, case o_orderkey % 4 when 0 then 'flexo1' when 1 then 'nowhere' end as profile, case o_orderkey % 3 when 0 then 'offset' when 1 then 'digital' end as process, case when o_orderkey % 5 = 0 then 0.5::double end as tolerance from orders)
select job, case when profile = 'flexo1' then 'flexo' when profile is null then coalesce(process, 'serigrafia') end as process, case when profile = 'nowhere' and tolerance is null then null else
  coalesce(tolerance, case when profile = 'flexo1' then 0.3::double when process = 'offset' then 0.08::double when process = 'digital' then 0.0::double else 0.2::double end) * case when profile = 'flexo1' then 1.5::double else 1.0::double end end as trap,
  case when profile = 'nowhere' then 'no such profile' end as problem from j
""")
def press_resolve(spark, sf_dir):
    """Which press profile a job gets, and its widest trap."""
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(k.alias("job"), F.when(k % 4 == 0, "flexo1").when(k % 4 == 1, "nowhere").alias("profile"), F.when(k % 3 == 0, "offset").when(k % 3 == 1, "digital").alias("process"), F.when(k % 5 == 0, 0.5).alias("tolerance"))
    profiles = spark.createDataFrame([("flexo1", "flexo", [0.2, 0.3], 1.5)], "id string, process string, tolerance array<double>, factor double")
    got = press.resolved(jobs, profiles)
    return got.select("job", "process", press.trap_mm(F.col("tolerance"), F.col("factor")).alias("trap"), "problem")


@query("""
with j as (select p_partkey as job, 20.0::double + p_size as w, 10.0::double + p_partkey % 7 as h, 1 + p_size % 4 as cols, 1 + p_partkey % 3 as rows from part),
c as (select job, w, h, cols, rows, r::integer as row, c::integer as col, (case when r % 2 = 1 then 90 else 0 end)::integer as rot from j, unnest(range(rows)) t(r), unnest(range(cols)) u(c))
select job, row, col, round(10 + case when row % 2 = 1 then 2.5 else 0 end + col * (case when rot = 90 then h else w end + 3), 6) as x,
  round(12 + case when col % 2 = 1 then 1.5 else 0 end + (row + 1) // 2 * (h + 4) + row // 2 * (w + 4), 6) as y, case when rot = 90 then h else w end as w, case when rot = 90 then w else h end as h, rot from c
""")
def imposition_cells(spark, sf_dir):
    """Places of labels on a sheet: every other row turned and shifted."""
    k, s = F.col("p_partkey"), F.col("p_size")
    jobs = table(spark, sf_dir, "part").select(
        k.alias("job"), (s + F.lit(20.0)).alias("trim_w"), (k % 7 + F.lit(10.0)).alias("trim_h"), (1 + s % 4).cast("int").alias("cols"), (1 + k % 3).cast("int").alias("rows"), F.lit(3.0).alias("gap_x"), F.lit(4.0).alias("gap_y"),
        F.lit(10.0).alias("left"), F.lit(12.0).alias("top"), F.array(F.lit(0), F.lit(90)).alias("row_turns"), F.array(F.lit(0)).alias("col_turns"), F.lit(2.5).alias("row_shift"), F.lit(1.5).alias("col_shift"))
    return layout.cells(jobs).select("job", "row", "col", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "w", "h", "rot")


@query("""
with p as (select p_partkey, p_size * 10.0::double as w, (p_partkey % 300)::double as h, (p_partkey % 25) - 2.0::double as pct, case p_partkey % 3 when 0 then 'vertical' when 1 then 'horizontal' else 'other' end as direction from part)
select p_partkey, case when direction = 'other' then 'unknown direction' when pct < 0 or pct >= 20 then 'distortion out of range' end as problem,
 round(case when direction = 'other' or pct < 0 or pct >= 20 then null when direction = 'horizontal' then w * (1 - pct / 100) else w end, 6) as width, round(case when direction = 'other' or pct < 0 or pct >= 20 then null when direction = 'vertical' then h * (1 - pct / 100) else h end, 6) as height from p
""")
def page_distortion(spark, sf_dir):
    """Pages made shorter in printing direction."""
    k = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * F.lit(10.0)).alias("width"), (k % 300).cast("double").alias("height"), ((k % 25) - F.lit(2.0)).alias("pct"), F.when(k % 3 == 0, "vertical").when(k % 3 == 1, "horizontal").otherwise("other").alias("direction"))
    return layout.distorted(pages).select("p_partkey", "problem", F.round("new_width", 6).alias("width"), F.round("new_height", 6).alias("height"))


@query()
def braille_names(spark, sf_dir):
    """Names of parts as lines of six-dot cells."""
    text = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))
    return braille.laid_out(table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", 120.0).select("p_partkey", "unicode", "width_mm", "height_mm", "problem")


@query()
def symbol_texts(spark, sf_dir):
    """Texts of every symbology from parts' numbers."""
    k = F.col("p_partkey")
    kinds = [*codes.SYMBOLS]
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, kinds)), (k % len(kinds) + 1).cast("int")).alias("kind"), F.when(k % 2 == 0, F.lpad((k * 7919).cast("string"), 12, "0")).otherwise(F.concat(F.lit("(10)"), F.col("p_brand"))).alias("data"))
    return p.withColumn("n", codes.normalized(F.col("kind"), F.col("data"))).select("p_partkey", "kind", "n.code", "n.computed", "n.problem")
