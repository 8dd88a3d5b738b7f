"""Queries of colours and inks over `part` and `supplier`."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import colour
from platewright.operators import inventory, layout
from platewright.queries.codes import NAME_SQL, RAW_SQL, _raw
from platewright.registry import LAB_SQL, _colours, query, table

BACK = colour.FROM_XYZ


def _back_sql() -> str:
    e, k = f"{colour.EPSILON!r}::double", f"{colour.KAPPA!r}::double"
    cube = lambda f: f"case when {f} * {f} * {f} > {e} then {f} * {f} * {f} else (116 * {f} - 16) / {k} end"
    rows = ", ".join(f"least(greatest(x * {BACK[i][0]!r}::double + y * {BACK[i][1]!r}::double + z * {BACK[i][2]!r}::double, 0), 1) as v{i}" for i in range(3))
    byte = lambda i: f"round_even(255 * case when v{i} <= 0.0031308 then v{i} * 12.92 else 1.055 * power(v{i}, 1 / 2.4::double) - 0.055 end, 0)::integer"
    return f"""t as (select p_partkey, (l + 16) / 116 + a / 500 as fx, (l + 16) / 116 as fy, (l + 16) / 116 - b / 200 as fz, l from q),
u as (select p_partkey, ({cube('fx')}) * {colour.WHITE[0]!r}::double as x, case when l > {k} * {e} then fy * fy * fy else l / {k} end * {colour.WHITE[1]!r}::double as y, ({cube('fz')}) * {colour.WHITE[2]!r}::double as z from t),
w as (select p_partkey, {rows} from u) select p_partkey, upper(printf('#%02x%02x%02x', {byte(0)}, {byte(1)}, {byte(2)})) as hex from w"""


@query(f"with q as (select p_partkey, (p_partkey % 101)::double as l, (p_partkey * 7 % 161) - 80.0::double as a, (p_partkey * 13 % 161) - 80.0::double as b from part), {_back_sql()}")
def lab_to_hex(spark, sf_dir):
    """Lab colours as sRGB, clamped and rounded."""
    k = F.col("p_partkey")
    lab = table(spark, sf_dir, "part").select("p_partkey", (k % 101).cast("double").alias("L"), ((k * 7 % 161) - F.lit(80.0)).alias("a"), ((k * 13 % 161) - F.lit(80.0)).alias("b"))
    return colour.with_hex_of_lab(lab, ("L", "a", "b")).select("p_partkey", "hex")


@query(f"with {LAB_SQL} select p_partkey, round(sqrt(power(\"L\" - 95, 2) + power(a, 2) + power(b_ + 2, 2)), 4) as de from lab")
def paper_distance(spark, sf_dir):
    """Distance of colours from the reference paper."""
    lab = colour.with_lab(_colours(spark, sf_dir)).withColumns({f"_p{i}": F.lit(v) for i, v in enumerate(colour.PAPER)})
    return lab.select("p_partkey", F.round(colour.delta_e76(("L", "a", "b_"), ("_p0", "_p1", "_p2")), 4).alias("de"))


@query()
def ink_mixtures(spark, sf_dir):
    """Colours of two transparent inks and an opaque one over another on paper."""
    c = F.col
    ink = lambda L, a, b, o, cov: F.struct(F.lit(float(L)).alias("L"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(o)).alias("opacity"), (cov / F.lit(255.0)).alias("cov"))
    df = _colours(spark, sf_dir).withColumn("inks", F.array(ink(94, 0, -2, 1, F.when(c("p_partkey") % 3 == 0, c("b")).otherwise(0)), ink(55, -37, -50, 0, c("r")), ink(48, 74, -3, 0, c("g"))))
    return colour.with_mixture(df, "inks").select("p_partkey", F.round("mL", 4).alias("l_star"), F.round("ma", 4).alias("a_star"), F.round("mb_", 4).alias("b_star"))


@query(f"""
with n as (select p_partkey as pos, {NAME_SQL.format('raw')} as ink, raw as name, case when p_partkey % 3 = 0 then (p_partkey % 101)::double end as l from {RAW_SQL})
select ink, name, l, pos from (select *, row_number() over (partition by ink order by l is null, pos) as k from n) where k = 1
""")
def ink_first_with_colour(spark, sf_dir):
    """One row of each ink: the first that has a colour."""
    k = F.col("p_partkey")
    rows = _raw(spark, sf_dir).select(k.alias("pos"), F.col("raw").alias("name"), F.when(k % 3 == 0, (k % 101).cast("double")).alias("L"))
    return inventory.deduplicated(rows).select("ink", "name", F.col("L").alias("l"), "pos")


@query(f"""
with n as (select p_partkey, raw, {NAME_SQL.format('raw')} as ink from {RAW_SQL}), lib as (select {NAME_SQL.format('raw')} as ink, p_partkey % 4 as rank, p_partkey as pos from {RAW_SQL} where p_partkey % 5 < 3),
f as (select ink, rank, pos from (select *, row_number() over (partition by ink order by rank, pos) as k from lib) where k = 1)
select p_partkey, f.rank, f.pos from n left join f using (ink)
""")
def ink_lookup(spark, sf_dir):
    """The first library that has an ink."""
    raw = _raw(spark, sf_dir)
    k = F.col("p_partkey")
    libraries = raw.where(k % 5 < 3).select(F.col("raw").alias("name"), (k % 4).alias("rank"), k.alias("pos"))
    return inventory.looked_up(raw.select("p_partkey", F.col("raw").alias("name")), libraries).select("p_partkey", "found.rank", "found.pos")


@query(f"""
with d as (select p_partkey % 20 as file, {NAME_SQL.format('raw')} as ink, raw as name, p_partkey % 3 as n from {RAW_SQL})
select file, ink, sum(n)::bigint as objects, count(distinct name) as variants from d group by all
""")
def ink_inventory(spark, sf_dir):
    """Inks of files with their spellings and uses."""
    k = F.col("p_partkey")
    raw = _raw(spark, sf_dir).select((k % 20).alias("file"), F.col("raw").alias("name"), (k % 3).alias("n"))
    used = raw.select("file", "name", F.lit(1).alias("page"), F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>"))).alias("_u"))
    return inventory.inventory(raw.select("file", "name"), used).select("file", "ink", "objects", F.size("variants").cast("long").alias("variants"))


@query(f"""
with d as (select p_partkey % 20 as file, {NAME_SQL.format('raw')} as ink, raw as name from {RAW_SQL} where p_partkey % 6 < 3), m as (select {NAME_SQL.format('raw')} as ink, min('Spot ' || (p_partkey % 50)) as new from {RAW_SQL} where p_partkey % 6 = 1 group by 1)
select file, count(*) filter (new <> name) as changed from d left join m using (ink) group by 1
""")
def ink_renames(spark, sf_dir):
    """Inks renamed by a mapping of normalised names, and how many changed in a file."""
    k = F.col("p_partkey")
    raw = _raw(spark, sf_dir)
    mapping = raw.where(k % 6 == 1).select(F.col("raw").alias("old"), F.concat(F.lit("Spot "), (k % 50).cast("string")).alias("new"))
    return inventory.renamed(raw.where(k % 6 < 3).select((k % 20).alias("file"), F.col("raw").alias("name")), mapping)[1]


@query("""
with t as (select p_partkey, (p_partkey % 101)::double as k, (p_partkey % 7) * 5.0::double as c, (p_partkey % 5) * 5.0::double as m, (p_partkey % 3) * 5.0::double as y, p_size / 2.0::double as pt from part)
select p_partkey, case when k > 85 and c + m + y > 30 and pt < 12 then 100.0 else k end as k, case when k > 85 and c + m + y > 30 and pt < 12 then 0.0 else c end as c, k > 85 and c + m + y > 30 and pt < 12 as overprint from t
""")
def black_text(spark, sf_dir):
    """Small rich-black text as pure black."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", (k % 101).cast("double").alias("k"), (k % 7 * F.lit(5.0)).alias("c"), (k % 5 * F.lit(5.0)).alias("m"), (k % 3 * F.lit(5.0)).alias("y"), (F.col("p_size") / F.lit(2.0)).alias("pt"), F.lit(False).alias("overprint"))
    return inventory.black_text(t).select("p_partkey", "k", "c", "overprint")


@query("""
with s as (select s_suppkey as pos, s_name as name from supplier where s_suppkey <= 12)
select name || '|' || step as id, 1 as inks from s, unnest(range(0, 101, 10)) t(step) union all select a.name || '+' || b.name || '|100', 2 from s a join s b on a.pos < b.pos
""")
def chart_patches(spark, sf_dir):
    """Patches of a test chart: ramps of each ink and all pairs."""
    inks = table(spark, sf_dir, "supplier").where("s_suppkey <= 12").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"))
    return layout.ramp_patches(inks).select("id", F.size("inks").alias("inks"))


@query()
def calibration_grid(spark, sf_dir):
    """For each ink the exponent and dot gain of a grid that fit its measured ramp best."""
    from platewright.operators import fitting

    k = F.col("s_suppkey")
    truth = table(spark, sf_dir, "supplier").where("s_suppkey <= 4").select(k.cast("string").alias("ink"), (F.lit(50.0) - k * 2).alias("L"), (k * 12.0 - 30).alias("a"), (F.lit(20.0) - k * 9).alias("b"), (k * 0.04).alias("gain"))
    measured = fitting.ramp(truth, 1.8).select("ink", "step", F.col("mL").alias("L"), F.col("ma").alias("a"), F.col("mb_").alias("b"))
    return fitting.fitted(measured).select("ink", "n", "gain", F.round("error", 3).alias("error"))


@query()
def palette_of_points(spark, sf_dir):
    """Palette of points by k-means, near centres merged and small ones left out."""
    from platewright.operators import fitting

    e = F.col("embedding")
    points = table(spark, sf_dir, "embeddings").select((F.lit(50.0) + 40 * F.get(e, F.lit(0))).cast("double").alias("L"), (80 * F.get(e, F.lit(1))).cast("double").alias("a"), (80 * F.get(e, F.lit(2))).cast("double").alias("b"))
    return fitting.palette(points, 8).select("i", F.round("L", 3).alias("l_star"), F.round("a", 3).alias("a_star"), F.round("b", 3).alias("b_star"), F.round("share", 4).alias("share"))
