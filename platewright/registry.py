"""Queries of the library's operators over the driver's tables, and their SQL.

The tables are stand-ins: boxes and plates are projections of `lineitem`, colours and inks of
`part`, words and pages of `documents`, job events of `events`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewright.functions import colour, text, units
from platewright.operators import layout, matching, plates, raster, rules, spatial
from platewright.plans import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- rules and scores

RULES = [
    ("short_text", "error", "n_chars < 100"),
    ("toxic", "error", "toxic = 1"),
    ("long_text", "warning", "n_chars > 10000"),
    ("low_quality", "warning", "quality = 0"),
    ("language", "info", "lang not in ('en', 'es')"),
    ("unlabelled", "info", "quality is null"),
]
RULES_SQL = " union all ".join(f"select source, lang, doc_id, '{r}' as rule, '{s}' as severity from documents left join labels using (doc_id) where {test}" for r, s, test in RULES)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rules.findings(docs, [(r, s, F.expr(test)) for r, s, test in RULES], ["source", "lang", "doc_id"])


@query(f"select source, rule, severity, count(*) as n from ({RULES_SQL}) group by all")
def rule_findings(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("source", "rule", "severity").agg(F.count("*").alias("n"))


@query(f"""
with f as ({RULES_SQL}), c as (
  select d.source, count(distinct d.doc_id) as docs from documents d group by 1), k as (
  select source, count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warning') as n_warning,
         count(*) filter (severity = 'info') as n_info, count(distinct case when severity = 'error' then doc_id end) as bad from f group by 1), s as (
  select c.source, docs, coalesce(n_error, 0) as n_error, coalesce(n_warning, 0) as n_warning, coalesce(n_info, 0) as n_info,
         100.0::double * (1 - coalesce(bad, 0)::double / docs) as score from c left join k using (source))
select source, docs, n_error, n_warning, n_info, round(score, 1) as score,
       case when score >= 98 then 'approved' when score >= 90 then 'review' else 'errors' end as status from s
""")
def severity_summary(spark, sf_dir):
    # findings of a document are counted before the sources are: one shuffle on the source
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flag = lambda severity: sum((F.coalesce(F.expr(t), F.lit(False)).cast("int") for _, s, t in RULES if s == severity), F.lit(0))
    each = docs.select("source", *(flag(s).alias(s) for s in ("error", "warning", "info")))
    by = each.groupBy("source").agg(F.count("*").alias("docs"), *(F.sum(s).alias(f"n_{s}") for s in ("error", "warning", "info")), F.sum((F.col("error") > 0).cast("int")).alias("bad"))
    scored = by.withColumn("_s", rules.share_score(F.col("bad"), F.col("docs")))
    return scored.select("source", "docs", "n_error", "n_warning", "n_info", F.round("_s", 1).alias("score"), rules.status(F.col("_s")).alias("status"))


@query(f"select lang, rule, case when rule = 'language' and lang = 'fr' then 'warning' else severity end as severity, count(*) as n from ({RULES_SQL}) where not (rule = 'unlabelled' and lang = 'de') group by all")
def profile_override(spark, sf_dir):
    """Findings under a profile that raises one rule and switches another off."""
    f = _findings(spark, sf_dir)
    profile = spark.createDataFrame([("language", "fr", True, "warning"), ("unlabelled", "de", False, None)], "rule string, lang string, active boolean, own string")
    joined = f.join(F.broadcast(profile), ["rule", "lang"], "left").where("coalesce(active, true)")
    return joined.groupBy("lang", "rule", F.coalesce("own", "severity").alias("severity")).agg(F.count("*").alias("n"))


@query("""
with b as (select source, count(*) filter (n_chars < 100) as before, count(*) filter (n_chars < 60) as after from documents group by 1)
select source, before, after, greatest(before - after, 0) as fixed from b
""")
def rules_before_after(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count_if(F.col("n_chars") < 100).alias("before"), F.count_if(F.col("n_chars") < 60).alias("after")).withColumn("fixed", F.greatest(F.col("before") - F.col("after"), F.lit(0)))


@query("""
with p as (
  select d.lang as category, count(*) filter (n_chars < 400 and quality = 0) as tp, count(*) filter (n_chars < 400 and quality = 1) as fp,
         count(*) filter (n_chars >= 400 and quality = 0) as fn from documents d join labels using (doc_id) group by 1), g as (
  select category, tp, fp, fn from p union all select 'all', sum(tp)::bigint, sum(fp)::bigint, sum(fn)::bigint from p), r as (
  select *, case when tp + fp = 0 then 100.0::double else 100.0::double * tp / (tp + fp) end as p, case when tp + fn = 0 then 100.0::double else 100.0::double * tp / (tp + fn) end as r from g)
select category, tp, fp, fn, round(p, 1) as precision, round(r, 1) as recall, round(case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end, 1) as f1 from r
""")
def prf_rollup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    hit, bad = F.col("n_chars") < 400, F.col("quality") == 0
    by = d.rollup(F.col("lang").alias("category")).agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & bad).alias("fn"))
    return rules.prf(by.withColumn("category", F.coalesce("category", F.lit("all"))))


@query("""
with p as (
  select d.lang as category, count(*) filter (n_chars < 400 and quality = 0) as tp, count(*) filter (n_chars < 400 and quality = 1) as fp,
         count(*) filter (n_chars >= 400 and quality = 0) as fn from documents d join labels using (doc_id) group by 1), r as (
  select category, case when tp + fp = 0 then 100.0::double else 100.0::double * tp / (tp + fp) end as p, case when tp + fn = 0 then 100.0::double else 100.0::double * tp / (tp + fn) end as r from p), f as (
  select category, round(case when p + r = 0 then 0.0::double else 2 * p * r / (p + r) end, 1) as f1 from r)
select category, f1, least_f1, f1 < least_f1 - 2 as fails from f join (values ('de', 10.0::double), ('en', 20.0), ('es', 30.0), ('fr', 5.0)) g(category, least_f1) using (category)
""")
def f1_gate(spark, sf_dir):
    """Categories against stored thresholds: two points below fails."""
    got = prf_rollup(spark, sf_dir).select("category", "f1")
    gate = spark.createDataFrame([("de", 10.0), ("en", 20.0), ("es", 30.0), ("fr", 5.0)], "category string, f1 double")
    failing = matching.regressions(got, gate).select("category", F.lit(True).alias("fails"))
    return got.join(gate.withColumnRenamed("f1", "least_f1"), "category").join(failing, "category", "left").withColumn("fails", F.coalesce("fails", F.lit(False)))


@query("""
select o_orderpriority as batch, count(*) as pages, round(avg(o_totalprice), 4) as mean_total, min(o_totalprice) as least_total,
       case when min(o_totalprice) >= 2000 then 'approved' when min(o_totalprice) >= 1000 then 'review' else 'errors' end as status from orders group by 1
""")
def batch_min_status(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = o.groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count("*").alias("pages"), F.round(F.avg("o_totalprice"), 4).alias("mean_total"), F.min("o_totalprice").alias("least_total"))
    return by.withColumn("status", F.when(F.col("least_total") >= 2000, "approved").when(F.col("least_total") >= 1000, "review").otherwise("errors"))


@query("""
select o_orderstatus as status, count(*) as items, count(*) filter (o_orderpriority <> '5-LOW') as counted, bool_and(o_orderstatus <> 'P') as ready from orders group by 1
""")
def checklist_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("items"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("counted"), F.bool_and(F.col("o_orderstatus") != "P").alias("ready"))


# ---------------------------------------------------------------- boxes

BOXES_SQL = """
boxes as (
  select l_orderkey as page, l_linenumber::bigint * 1000000000000 + l_partkey * 100000 + l_suppkey as id, l_partkey * 37 % 1000 as x, l_suppkey * 91 % 1000 as y,
         cast(l_quantity * 8 as bigint) as w, l_linenumber::bigint * 12 as h, l_returnflag as cat, l_linestatus as side from lineitem),
pairs as (
  select l.page, l.id as a, r.id as b,
         (least(l.x + l.w, r.x + r.w) - greatest(l.x, r.x)) * (least(l.y + l.h, r.y + r.h) - greatest(l.y, r.y)) as common,
         l.w * l.h as la, r.w * r.h as ra, l.cat, r.cat as rcat,
         (l.x + l.w / 2.0::double between r.x and r.x + r.w and l.y + l.h / 2.0::double between r.y and r.y + r.h)
         or (r.x + r.w / 2.0::double between l.x and l.x + l.w and r.y + r.h / 2.0::double between l.y and l.y + l.h) as centred
  from boxes l join boxes r on l.page = r.page and l.side = 'F' and r.side = 'O'
   and least(l.x + l.w, r.x + r.w) > greatest(l.x, r.x) and least(l.y + l.h, r.y + r.h) > greatest(l.y, r.y))
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page"), (c("l_linenumber").cast("bigint") * 1000000000000 + c("l_partkey") * 100000 + c("l_suppkey")).alias("id"), (c("l_partkey") * 37 % 1000).alias("x"), (c("l_suppkey") * 91 % 1000).alias("y"),
        (c("l_quantity") * 8).cast("bigint").alias("w"), (c("l_linenumber").cast("bigint") * 12).alias("h"), c("l_returnflag").alias("cat"), c("l_linestatus").alias("side"))


def _sides(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    return b.where("side = 'F'"), b.where("side = 'O'")


@query(f"with {BOXES_SQL} select page, a, b, common, round(common::double / (la + ra - common), 6) as iou from pairs")
def box_overlap_iou(spark, sf_dir):
    return spatial.overlaps(*_sides(spark, sf_dir)).select("l.page", F.col("l.id").alias("a"), F.col("r.id").alias("b"), spatial.common("l", "r").alias("common"), F.round(spatial.iou("l", "r"), 6).alias("iou"))


@query(f"""with {BOXES_SQL}, good as (select *, round(common::double / (la + ra - common), 9) as iou from pairs where common::double / (la + ra - common) >= 0.3 or centred),
ranked as (select *, row_number() over (partition by page, a order by iou desc, b) as i, row_number() over (partition by page, b order by iou desc, a) as j from good)
select page, a, b, iou from ranked where i = 1 and j = 1""")
def box_matches(spark, sf_dir):
    return spatial.matches(*_sides(spark, sf_dir)).select("l.page", F.col("l.id").alias("a"), F.col("r.id").alias("b"), "iou")


@query(f"""with {BOXES_SQL}, good as (select *, round(common::double / (la + ra - common), 9) as iou from pairs where common::double / (la + ra - common) >= 0.3 or centred),
m as (select a, b, page from (select *, row_number() over (partition by page, a order by iou desc, b) as i, row_number() over (partition by page, b order by iou desc, a) as j from good) where i = 1 and j = 1)
select cat, count(*) filter (side = 'O' and hit) as tp, count(*) filter (side = 'F' and not hit) as fp, count(*) filter (side = 'O' and not hit) as fn from (
  select x.cat, x.side, exists (select 1 from m where m.page = x.page and (x.side = 'F' and m.a = x.id or x.side = 'O' and m.b = x.id)) as hit from boxes x) group by 1""")
def case_counts(spark, sf_dir):
    """True and false positives and misses by category, from the match join."""
    found, expected = _sides(spark, sf_dir)
    m = spatial.matches(found, expected).select("l.page", F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()
    return matching.case_counts(found, expected, m).groupBy("cat").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


@query(f"with {BOXES_SQL} select side, case when side = 'F' and exists (select 1 from pairs p where p.page = x.page and p.a = x.id and p.common * 2 >= p.la) then 'covered' else 'free' end as state, count(*) as n from boxes x group by all")
def zones_semi(spark, sf_dir):
    """Boxes at least half covered by one box of the other side."""
    b = _boxes(spark, sf_dir)
    covered = spatial.overlaps(*_sides(spark, sf_dir)).where(spatial.common("l", "r") * 2 >= F.col("l.w") * F.col("l.h")).select("l.page", F.col("l.id").alias("id"), F.lit("F").alias("side")).distinct().withColumn("state", F.lit("covered"))
    return b.join(covered, ["page", "id", "side"], "left").groupBy("side", F.coalesce("state", F.lit("free")).alias("state")).agg(F.count("*").alias("n"))


@query(f"with {BOXES_SQL} select page, id, round(x * 0.72::double, 3) as x0, round(842 - (y + h) * 0.72::double, 3) as y0, round((x + w) * 0.72::double, 3) as x1, round(842 - y * 0.72::double, 3) as y1 from boxes")
def box_unit_convert(spark, sf_dir):
    """Pixels from the top left (100 dpi) to points from the bottom left of a page of 842 points."""
    c, dpi = F.col, F.lit(100.0)
    pt = lambda v: units.px_to_pt(v, dpi)
    return _boxes(spark, sf_dir).select("page", "id", F.round(pt(c("x")), 3).alias("x0"), F.round(842 - pt(c("y") + c("h")), 3).alias("y0"), F.round(pt(c("x") + c("w")), 3).alias("x1"), F.round(842 - pt(c("y")), 3).alias("y1"))


# ---------------------------------------------------------------- text

SPLIT_SQL = r"unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))"


@query(rf"select word, count(*) as n from (select lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')) as word from (select {SPLIT_SQL} as w from documents)) where word <> '' group by 1")
def word_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # raw words are counted first, so that the key is made once for each
    raw = d.select(F.explode(text.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    return raw.groupBy(text.word_key(F.col("w")).alias("word")).agg(F.sum("c").alias("n")).where("word <> ''")


@query(f"select lang, count(*) as docs, sum(length(translate(text, '{text.ACCENTED}', '{text.PLAIN}')))::bigint as chars, count(*) filter (translate(text, '{text.ACCENTED}', '{text.PLAIN}') <> text) as accented from documents group by 1")
def accents_stripped(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "text", text.strip_accents(F.col("text")).alias("plain"))
    return d.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("plain")).alias("chars"), F.count_if(F.col("plain") != F.col("text")).alias("accented"))


@query(r"""
with w as (select conv_id, turn, lower(w) as word from (select conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) as w from conversations)),
a as (select conv_id, turn, word, count(*) as n from w group by all)
select coalesce(x.conv_id, y.conv_id) as conv_id, coalesce(x.turn, y.turn - 1) as turn, sum(least(coalesce(x.n, 0), coalesce(y.n, 0)))::bigint as same, sum(greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0))::bigint as missing,
       sum(greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0))::bigint as extra
from a x full join a y on x.conv_id = y.conv_id and y.turn = x.turn + 1 and x.word = y.word group by all
""")
def word_multiset_diff(spark, sf_dir):
    """Words of a turn against those of the next one, as multisets."""
    c = table(spark, sf_dir, "conversations")
    counts = c.select("conv_id", "turn", F.explode(text.words(F.col("text"))).alias("w")).groupBy("conv_id", "turn", F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    # one aggregation in place of a full outer join: each count goes to its own turn and to the turn before
    sides = counts.select("conv_id", "turn", "word", F.col("n").alias("a"), F.lit(0).alias("b")).unionByName(counts.select("conv_id", (F.col("turn") - 1).alias("turn"), "word", F.lit(0).alias("a"), F.col("n").alias("b")))
    each = sides.groupBy("conv_id", "turn", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return each.groupBy("conv_id", "turn").agg(F.sum(F.least("a", "b")).alias("same"), F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("missing"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("extra"))


@query(rf"""
with good as (select distinct lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')) as word from (select {SPLIT_SQL} as w from documents join labels using (doc_id) where quality = 1)),
seen as (select lower(regexp_replace(w, '[^\p{{L}}]', '', 'g')) as word, count(*) as n from (select {SPLIT_SQL} as w from documents left join labels using (doc_id) where quality is distinct from 1) group by 1)
select word, n from seen where length(word) >= 3 and word not in (select word from good)
""")
def unknown_words(spark, sf_dir):
    """Words of three letters or more that no good document has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    word = F.lower(F.regexp_replace("w", r"[^\p{L}]", "")).alias("word")
    raw = d.select(F.col("quality").eqNullSafe(F.lit(1)).alias("good"), F.explode(text.words(F.col("text"))).alias("w")).groupBy("w").agg(F.bool_or("good").alias("good"), F.count("*").alias("c"))
    by = raw.select("good", "c", word).groupBy("word").agg(F.bool_or("good").alias("known"), F.sum("c").alias("n"))
    return by.where("not known and length(word) >= 3").select("word", "n")


@query(rf"""
with c as (select lang, word, count(*) as n from (select lang, lower(w) as word from (select lang, {SPLIT_SQL} as w from documents)) where length(word) >= 3 and not regexp_matches(word, '[0-9]') group by all)
select lang, word, n, rank from (select *, cast(row_number() over (partition by lang order by n desc, word) as integer) as rank from c) where rank <= 20
""")
def vocabulary_top(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    c = d.select("lang", F.explode(text.words(F.col("text"))).alias("w")).groupBy("lang", F.lower("w").alias("word")).agg(F.count("*").alias("n")).where(r"length(word) >= 3 and not word rlike '[0-9]'")
    return history.top(c, "lang", [F.col("n").desc(), F.col("word")], 20)


@query(rf"""
select pattern, count(*) as n from (
  select case when regexp_matches(w, '[0-9]') and length(w) between 3 and 24 then regexp_replace(regexp_replace(regexp_replace(w, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') end as pattern from (select {SPLIT_SQL} as w from documents))
where pattern is not null group by 1
""")
def token_patterns(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(text.words(F.col("text"))).alias("w")).groupBy(text.pattern_of(F.col("w")).alias("pattern")).agg(F.count("*").alias("n")).where("pattern is not null")


@query(f"""
with t as (select conv_id, turn, regexp_replace(trim(regexp_replace(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[ \t\n\r]+', ' ', 'g')), '[^ -~]', '', 'g') as s from conversations)
select a.conv_id, a.turn, round(case when length(a.s) = 0 then 0.0::double else least(1.0::double, levenshtein(a.s, b.s)::double / length(a.s)) end, 6) as rate from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1
""")
def char_error_rate(spark, sf_dir):
    """Error rate of each turn's plain characters read as the next turn's, whole turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(text.plain_text(F.col("text")), "[^ -~]", "").alias("s"))
    after = F.lead(F.struct("turn", "s")).over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = c.withColumn("next", after).where("next.turn = turn + 1")
    return pairs.select("conv_id", "turn", F.round(text.error_rate(F.col("s"), F.col("next.s")), 6).alias("rate"))


@query("""
select p_partkey, digits, ((10 - (list_sum(list_transform(range(1, length(digits) + 1), lambda i: cast(substr(reverse(digits), i, 1) as integer) * case when i % 2 = 1 then 3 else 1 end)) % 10)) % 10)::bigint as digit
from (select p_partkey, lpad(cast(p_partkey * 7919 as varchar), 12, '0') as digits from part)
""")
def check_digit_mod10(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0").alias("digits"))
    return p.withColumn("digit", text.check_digit(F.col("digits")).cast("bigint"))


# ---------------------------------------------------------------- colours and inks

RGB_SQL = "(select p_partkey, (p_partkey * 67 % 256)::integer as r, (p_partkey // 7 * 131 % 256)::integer as g, (p_partkey // 31 * 29 % 256)::integer as b from part)"
LAB_SQL = f"""
lin as (select p_partkey, r, g, b, {', '.join(f"case when {c} / 255.0::double <= 0.04045 then {c} / 255.0::double / 12.92 else power(({c} / 255.0::double + 0.055) / 1.055, 2.4) end as l{i}" for i, c in enumerate('rgb'))} from {RGB_SQL}),
xyz as (select p_partkey, r, g, b, {', '.join('(' + ' + '.join(f'l{j} * {colour.TO_XYZ[i][j]!r}::double' for j in range(3)) + f') / {colour.WHITE[i]!r}::double as x{i}' for i in range(3))} from lin),
f as (select p_partkey, r, g, b, {', '.join(f"case when x{i} > {colour.EPSILON!r}::double then cbrt(x{i}) else (x{i} * {colour.KAPPA!r}::double + 16) / 116 end as f{i}" for i in range(3))} from xyz),
lab as (select p_partkey, r, g, b, f1 * 116 - 16 as "L", (f0 - f1) * 500 as a, (f1 - f2) * 200 as b_ from f)
"""


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (k * 67 % 256).cast("int").alias("r"), (F.floor(k / 7) * 131 % 256).cast("int").alias("g"), (F.floor(k / 31) * 29 % 256).cast("int").alias("b"))


@query(f'with {LAB_SQL} select p_partkey, round("L", 5) as l_star, round(a, 5) as a_star, round(b_, 5) as b_star from lab')
def srgb_to_lab(spark, sf_dir):
    return colour.with_lab(_colours(spark, sf_dir)).select("p_partkey", F.round("L", 5).alias("l_star"), F.round("a", 5).alias("a_star"), F.round("b_", 5).alias("b_star"))


@query(f'with {LAB_SQL} select p_partkey, round(sqrt(power("L" - 50, 2) + power(a - 20, 2) + power(b_ + 10, 2)), 5) as de, case when sqrt(power("L" - 50, 2) + power(a - 20, 2) + power(b_ + 10, 2)) <= 2 then \'green\' when sqrt(power("L" - 50, 2) + power(a - 20, 2) + power(b_ + 10, 2)) <= 4 then \'yellow\' else \'red\' end as light from lab')
def delta_e76_light(spark, sf_dir):
    lab = colour.with_lab(_colours(spark, sf_dir)).withColumns({"L0": F.lit(50.0), "a0": F.lit(20.0), "b0": F.lit(-10.0)})
    return lab.withColumn("d", colour.delta_e76(("L", "a", "b_"), ("L0", "a0", "b0"))).select("p_partkey", F.round("d", 5).alias("de"), colour.light(F.col("d")).alias("light"))


DE2000_SQL = f"""with {LAB_SQL},
c as (select p_partkey, "L" as l1, a as a1, b_ as b1, 50.0::double as l2, 20.0::double as a2, -10.0::double as b2, sqrt(a * a + b_ * b_) as c1, sqrt(500.0::double) as c2 from lab),
g as (select *, 0.5 * (1 - sqrt(power((c1 + c2) / 2, 7) / (power((c1 + c2) / 2, 7) + power(25.0::double, 7)))) as g from c),
p as (select *, a1 * (1 + g) as p1, a2 * (1 + g) as p2 from g),
q as (select *, sqrt(p1 * p1 + b1 * b1) as q1, sqrt(p2 * p2 + b2 * b2) as q2, case when p1 = 0 and b1 = 0 then 0.0::double else (degrees(atan2(b1, p1)) + 720) % 360 end as h1, (degrees(atan2(b2, p2)) + 720) % 360 as h2 from p),
d as (select *, case when q1 * q2 = 0 then 0.0::double when h2 - h1 > 180 then h2 - h1 - 360 when h2 - h1 < -180 then h2 - h1 + 360 else h2 - h1 end as dh, (l1 + l2) / 2 as lm, (q1 + q2) / 2 as cm,
  case when q1 * q2 = 0 then h1 + h2 when abs(h1 - h2) <= 180 then (h1 + h2) / 2 when h1 + h2 < 360 then (h1 + h2 + 360) / 2 else (h1 + h2 - 360) / 2 end as hm from q),
t as (select *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) as t,
  -sin(radians(60 * exp(-power((hm - 275) / 25, 2)))) * 2 * sqrt(power(cm, 7) / (power(cm, 7) + power(25.0::double, 7))) as rt from d),
u as (select *, (l2 - l1) / (1 + 0.015 * power(lm - 50, 2) / sqrt(20 + power(lm - 50, 2))) as u, (q2 - q1) / (1 + 0.045 * cm) as v, 2 * sqrt(q1 * q2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) as w from t)
select p_partkey, round(sqrt(greatest(u * u + v * v + w * w + rt * v * w, 0)), 4) as de from u"""


@query(DE2000_SQL)
def delta_e2000(spark, sf_dir):
    lab = colour.with_lab(_colours(spark, sf_dir)).withColumns({"L0": F.lit(50.0), "a0": F.lit(20.0), "b0": F.lit(-10.0)})
    return colour.with_delta_e2000(lab, ("L", "a", "b_"), ("L0", "a0", "b0")).select("p_partkey", F.round("de", 4).alias("de"))


PALETTE = [(0, 200, 30, 30), (1, 30, 160, 60), (2, 40, 60, 190), (3, 240, 220, 20), (4, 20, 20, 20), (5, 245, 245, 245)]


@query(f"""with pal(i, pr, pg, pb) as (values {', '.join(map(str, PALETTE))}), d as (select p_partkey, i, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) as d from {RGB_SQL}, pal)
select i as ink, count(*) as n, sum(d)::bigint as distance from (select *, row_number() over (partition by p_partkey order by d, i) as k from d) where k = 1 group by 1""")
def nearest_palette(spark, sf_dir):
    """Nearest palette entry of each colour, lowest index on ties."""
    names = {"r": "L", "g": "a", "b": "b"}
    c = _colours(spark, sf_dir).select(F.lit(1).alias("page"), *(F.col(k).alias(v) for k, v in names.items()))
    palette = spark.createDataFrame([(1, *p) for p in PALETTE], "page int, i int, L int, a int, b int")
    near = raster.nearest(c, palette).join(F.broadcast(palette.select(F.col("i").alias("label"), *(F.col(k).alias(f"p{k}") for k in names.values()))), "label")  # the palette
    d = sum((F.pow(F.col(k) - F.col(f"p{k}"), F.lit(2)) for k in ("a", "b")), F.pow(F.col("L") - F.col("pL"), F.lit(2)))
    return near.groupBy(F.col("label").alias("ink")).agg(F.count("*").alias("n"), F.sum(d.cast("bigint")).alias("distance"))


@query(f"""with k as (select p_partkey, r, g, b, 1 - greatest(r, g, b) / 255.0::double as k from {RGB_SQL}), c as (
select p_partkey, k, case when k >= 1 then 0.0::double else (1 - r / 255.0::double - k) / (1 - k) end as c, case when k >= 1 then 0.0::double else (1 - g / 255.0::double - k) / (1 - k) end as m, case when k >= 1 then 0.0::double else (1 - b / 255.0::double - k) / (1 - k) end as y,
       '#' || upper(printf('%02x%02x%02x', r, g, b)) as hex from k)
select p_partkey, hex, round(case when c + m + y + k > 2.4 and c + m + y > 0 then c * (2.4 - k) / (c + m + y) else c end, 5) as c, round(case when c + m + y + k > 2.4 and c + m + y > 0 then m * (2.4 - k) / (c + m + y) else m end, 5) as m,
       round(case when c + m + y + k > 2.4 and c + m + y > 0 then y * (2.4 - k) / (c + m + y) else y end, 5) as y, round(k, 5) as k from c""")
def cmyk_limited(spark, sf_dir):
    """CMYK by the greatest black, coloured inks scaled down to a total of 240 percent."""
    c = _colours(spark, sf_dir).withColumn("k", 1 - F.greatest("r", "g", "b") / 255.0)
    c = c.withColumns({n: F.when(F.col("k") >= 1, 0.0).otherwise((1 - F.col(x) / 255.0 - F.col("k")) / (1 - F.col("k"))) for n, x in (("c", "r"), ("m", "g"), ("y", "b"))} | {"hex": colour.hex_of(F.col("r"), F.col("g"), F.col("b"))})
    held = colour.limited([F.col(n) for n in "cmyk"], 2.4)
    return c.select("p_partkey", "hex", *(F.round(v, 5).alias(n) for n, v in zip("cmyk", held, strict=True)))


@query("""
select p_partkey, trim(regexp_replace(upper(p_name), ' +', ' ', 'g')) as name,
       case when regexp_matches(lower(p_name), 'white|ivory|snow') then 'white' when regexp_matches(lower(p_name), 'gold|silver|metal') then 'metallic' when regexp_matches(lower(p_name), 'black|cyan|magenta|yellow') then 'process' else 'spot' end as kind from part
""")
def ink_classify(spark, sf_dir):
    p, low = table(spark, sf_dir, "part"), F.lower("p_name")
    kind = F.when(low.rlike("white|ivory|snow"), "white").when(low.rlike("gold|silver|metal"), "metallic").when(low.rlike("black|cyan|magenta|yellow"), "process").otherwise("spot")
    return p.select("p_partkey", F.trim(F.regexp_replace(F.upper("p_name"), " +", " ")).alias("name"), kind.alias("kind"))


@query("select upper(p_brand) as name, count(*) as uses, count(distinct p_type) as variants, min(p_partkey) as first_part from part group by 1")
def ink_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.upper("p_brand").alias("name")).agg(F.count("*").alias("uses"), F.count_distinct("p_type").alias("variants"), F.min("p_partkey").alias("first_part"))


@query(f"""select p_partkey, cast(floor(least(greatest(r / 255.0::double + 0.18::double * 4 * (r / 255.0::double) * (1 - r / 255.0::double), 0), 1) * 255) as integer) as gained, round(-log10(greatest(g / 255.0::double, 1e-4)), 5) as density from {RGB_SQL}""")
def dot_gain_density(spark, sf_dir):
    c = _colours(spark, sf_dir)
    return c.select("p_partkey", colour.gained(F.col("r") / 255.0, 0.18).alias("gained"), F.round(colour.density(F.col("g") / 255.0), 5).alias("density"))


# ---------------------------------------------------------------- plates

PLATES_SQL = "(select (l_partkey % 64)::bigint as x, (l_orderkey % 64)::bigint as y, l_linenumber as ink, max(least(255, cast(l_quantity * 5 as integer))) as cov from lineitem group by all)"


def _plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").groupBy((c("l_partkey") % 64).alias("x"), (c("l_orderkey") % 64).alias("y"), c("l_linenumber").alias("ink")).agg(F.max(F.least(F.lit(255), (c("l_quantity") * 5).cast("int"))).alias("cov"))


@query(f"select ink, round(avg(cov) * 100 / 255, 5) as percent, max(cov) = 0 as empty, count(*) as pixels from {PLATES_SQL} group by 1")
def plate_coverage(spark, sf_dir):
    return plates.coverage(_plates(spark, sf_dir)).withColumn("percent", F.round("percent", 5))


@query(f"with t as (select x, y, sum(cov) * 100 / 255.0::double as total from {PLATES_SQL} where ink in (1, 2, 3, 4) group by all) select round(max(total), 5) as greatest, round(quantile_cont(total, 0.995), 5) as p995, round(avg(total), 5) as mean from t")
def total_stats(spark, sf_dir):
    return plates.totals(_plates(spark, sf_dir), [1, 2, 3, 4]).agg(F.round(F.max("total"), 5).alias("greatest"), F.round(F.percentile("total", F.lit(0.995)), 5).alias("p995"), F.round(F.avg("total"), 5).alias("mean"))


@query(f"select ink, round(avg(cov), 5) as mean, count(*) as pixels from {PLATES_SQL} where x between 20 and 30 and y between 10 and 20 group by 1")
def probe_window(spark, sf_dir):
    return plates.probe(_plates(spark, sf_dir), 25, 15, 5).withColumn("mean", F.round("mean", 5))


@query(f"select ink, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from {PLATES_SQL} where cov > 200 group by 1")
def plate_bbox(spark, sf_dir):
    return plates.boxes(_plates(spark, sf_dir), 200)


@query(f"select x // 8 as cx, y // 8 as cy, ink, quantile_cont(cov, 0.5)::double as median from {PLATES_SQL} group by all")
def cell_medians(spark, sf_dir):
    return plates.cell_medians(_plates(spark, sf_dir), 8)


@query(f"select ink, y, min(x) as x0, count(*) as length from (select ink, y, x, x - row_number() over (partition by ink, y order by x) as i from {PLATES_SQL} where cov > 100) group by ink, y, i")
def run_lengths(spark, sf_dir):
    return plates.runs(_plates(spark, sf_dir), 100)


@query(f"select signature, count(*) as pixels from (select x, y, sum(1::bigint << ink)::bigint as signature from {PLATES_SQL} where cov > 120 group by all) group by 1")
def bit_signature(spark, sf_dir):
    return plates.signatures(_plates(spark, sf_dir), 120).groupBy("signature").agg(F.count("*").alias("pixels"))


@query(f"""with p as {PLATES_SQL}, s as (select a.x, a.y, a.ink, b.cov as moved, a.cov from p a left join p b on b.ink = a.ink and b.x = a.x - 1 and b.y = a.y where a.ink = 2)
select count(*) filter (coalesce(moved, 0) < 100 and cov >= 100) as gaps, count(*) filter (coalesce(moved, 0) >= 100 and cov < 100) as overlaps, count(*) as pixels from s""")
def movement_test(spark, sf_dir):
    """Ink 2 moved one pixel to the right against its own place; movement_gaps moves every ink in 8 directions."""
    p = _plates(spark, sf_dir).where("ink = 2")
    w = Window.partitionBy("y").orderBy("x")
    left = F.when(F.lag("x").over(w) == F.col("x") - 1, F.lag("cov").over(w)).otherwise(0)
    return p.withColumn("moved", F.coalesce(left, F.lit(0))).agg(F.count_if((F.col("moved") < 100) & (F.col("cov") >= 100)).alias("gaps"), F.count_if((F.col("moved") >= 100) & (F.col("cov") < 100)).alias("overlaps"), F.count("*").alias("pixels"))


DIRECTIONS_SQL = ", ".join(map(str, plates.DIRECTIONS))


@query(f"""with p as (select x, y, ink from {PLATES_SQL} where cov >= 128), d(dx, dy) as (values {DIRECTIONS_SQL}),
lost as (select a.ink, dx, dy, count(*) as gaps from p a, d where not exists (select 1 from p o where o.x = a.x and o.y = a.y and o.ink <> a.ink)
  and not exists (select 1 from p m where m.ink = a.ink and m.x = a.x - dx and m.y = a.y - dy) group by all)
select i.ink, d.dx, d.dy, coalesce(gaps, 0) as gaps from (select distinct ink from p) i cross join d left join lost l on l.ink = i.ink and l.dx = d.dx and l.dy = d.dy""")
def movement_gaps(spark, sf_dir):
    """Every ink moved one pixel in 8 directions: pixels that no ink covers any more."""
    return plates.movement_gaps(_plates(spark, sf_dir), 128)


@query("""
select a.s_suppkey as a, b.s_suppkey as b, case when a.s_nationkey = b.s_nationkey then 'none' when a.s_acctbal < b.s_acctbal then 'a under b' else 'b under a' end as spread
from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey
union all select s_suppkey, null, case when s_acctbal < 0 then 'choke' else 'spread' end from supplier
""")
def trap_decide(spark, sf_dir):
    """The default of each ink alone; pairs of one group are never trapped here, trap_decisions applies the rules."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = s.alias("a"), s.alias("b")
    pairs = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey")))
    spread = F.when(F.col("a.s_nationkey") == F.col("b.s_nationkey"), "none").when(F.col("a.s_acctbal") < F.col("b.s_acctbal"), "a under b").otherwise("b under a")
    alone = s.select(F.col("s_suppkey").alias("a"), F.lit(None).cast("bigint").alias("b"), F.when(F.col("s_acctbal") < 0, "choke").otherwise("spread").alias("spread"))
    return pairs.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), spread.alias("spread")).unionByName(alone)


INKS_SQL = """(select s_nationkey::bigint as page, s_suppkey as id, (s_acctbal + 1000) / 110.0::double as lightness, (s_suppkey * 37 % 11) / 10.0::double as opacity,
  case s_suppkey % 10 when 0 then 'varnish' when 1 then 'technical' when 2 then 'white' when 3 then 'process' else 'spot' end as kind from supplier)"""


@query(f"""
with i as {INKS_SQL}, p as (select a.page, a.id as a, b.id as b, a.lightness as la, b.lightness as lb, a.opacity >= 0.8::double as oa, b.opacity >= 0.8::double as ob
  from i a join i b on a.page = b.page and a.id < b.id where a.kind in ('process', 'spot') and b.kind in ('process', 'spot')),
r as (select *, case when oa <> ob then 'R6' when (la < 25) <> (lb < 25) then 'R3' when abs(la - lb) >= 8 and not (la < 25 and lb < 25) then 'R4' else 'R5' end as rule from p),
s as (select *, case rule when 'R6' then ob when 'R3' then lb < 25 when 'R4' then la > lb end as a_spreads from r)
select page, a, b, case when a_spreads then a else b end as spread, case when a_spreads then b else a end as under, 1.0::double as fraction, rule from s where rule <> 'R5'
union all select page, a, b, a, b, 0.5::double, rule from s where rule = 'R5' union all select page, a, b, b, a, 0.5::double, rule from s where rule = 'R5'
""")
def trap_decisions(spark, sf_dir):
    """Rules R1 to R6 on the pairs of each nation's suppliers, taken as a page of inks."""
    k = F.col("s_suppkey")
    kind = F.when(k % 10 == 0, "varnish").when(k % 10 == 1, "technical").when(k % 10 == 2, "white").when(k % 10 == 3, "process").otherwise("spot")
    inks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("bigint").alias("page"), k.alias("id"), ((F.col("s_acctbal") + 1000) / F.lit(110.0)).alias("lightness"), kind.alias("kind"), ((k * 37 % 11) / F.lit(10.0)).alias("opacity"))
    return plates.trap_decisions(inks)


@query("""
select p_partkey, greatest(0, cast(floor((1000 - 20 + 4) / (p_size * 3 + 10.0::double + 4)) as integer)) as columns, greatest(0, cast(floor((700 - 20 + 4) / (p_size * 2 + 15.0::double + 4)) as integer)) as rows,
       round(2 * 3.141592653589793 * 1.7 / (p_size * 10 + 200) * 100, 6) as distortion from part
""")
def fill_grid_distortion(spark, sf_dir):
    """How many labels fit on a sheet, and a plate's shortening on a cylinder."""
    fit = lambda sheet, side: layout.fitting(F.lit(sheet), side, F.lit(4), F.lit(10), F.lit(10))
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", fit(1000, size * 3 + 10.0).alias("columns"), fit(700, size * 2 + 15.0).alias("rows"), F.round(layout.distortion_pct(F.lit(1.7), size * 10 + 200), 6).alias("distortion"))


# ---------------------------------------------------------------- jobs and history

EVENT_COLUMNS = "user_id, event_id, event_type, round(value, 6) as value"


@query(f"select {EVENT_COLUMNS} from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k = 1")
def history_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return history.upsert(e, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


@query("select event_type, event_id, rank from (select event_type, event_id, cast(row_number() over (partition by event_type order by ts desc, event_id) as integer) as rank from events) where rank <= 30")
def history_top(spark, sf_dir):
    return history.top(table(spark, sf_dir, "events"), "event_type", [F.col("ts").desc(), F.col("event_id")], 30).select("event_type", "event_id", "rank")


@query("select event_type, count(*) filter (ts < m - interval 20 day) as evicted, count(*) filter (ts >= m - interval 20 day) as kept from events, (select max(ts) as m from events) group by 1")
def job_eviction(spark, sf_dir):
    """Events more than 20 days older than the last one go."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("m"))  # one row
    old = F.col("ts") < F.col("m") - F.expr("interval 20 days")
    return e.join(F.broadcast(last)).groupBy("event_type").agg(F.count_if(old).alias("evicted"), F.count_if(~old).alias("kept"))


@query("select event_type, count(*) filter (value >= 50) as ok, count(*) filter (value >= 10 and value < 50) as stopped, count(*) filter (value < 10 or value is null) as error from events group by 1")
def recipe_outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("value") >= 50, "ok").when(F.col("value") >= 10, "stopped").otherwise("error")
    return e.groupBy("event_type").agg(*(F.count_if(state == s).alias(s) for s in ("ok", "stopped", "error")))


@query("select role, sum(n)::bigint as n from (select role, count(*) as n from conversations group by 1 union all select 'document' as role, count(*) from documents union all select 'user', 0) group by 1")
def counter_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("n")).select(F.lit("document").alias("role"), "n")
    return history.counters([c, d, spark.createDataFrame([("user", 0)], "role string, n long")], "role", "n")
