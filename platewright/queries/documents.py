"""Queries of words, spelling, learned edits and rules over `documents`, `conversations` and `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewright.functions import text
from platewright.operators import inventory, preflight, streams, words
from platewright.registry import SPLIT_SQL, query, table


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.words(F.col("text"))).alias("pos", "text"))
    key = lambda shift: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string"))
    first = c.withColumn("page", key(0)).select("page", "pos", "text")
    return first, c.where("turn > 0").withColumn("page", key(1)).select("page", "pos", "text")


@query()
def word_diff(spark, sf_dir):
    """Words of each turn against those of the next, aligned in order: how many match, change, miss, come in."""
    pairs = words.classified(words.aligned_words(*_turns(spark, sf_dir)))
    return pairs.groupBy("page", "subtype").agg(F.count("*").alias("n"))


@query()
def learned_edits(spark, sf_dir):
    """Character edits of changed words, as learned from reviews."""
    pairs = words.classified(words.aligned_words(*_turns(spark, sf_dir))).where("subtype = 'changed'")
    return words.learned_edits(pairs.select(F.col("expected").alias("read"), F.col("found").alias("true"))).select("edit", "n", F.size("examples").alias("examples"))


@query()
def spelling(spark, sf_dir):
    """Words of documents that were not good, with what they may have been; the dictionary is good documents' words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    w = words.tokens(d.select("quality", F.explode(text.words(F.col("text"))).alias("text"))).groupBy("word").agg(F.count_if(F.col("quality") == 1).alias("n"), F.count("*").alias("uses"))
    dictionary = w.where("n > 0").select("word", "n")
    found = words.misspelled(w.where("n = 0").select("word"), dictionary)
    return found.select("word", "subtype", F.array_join("suggestions", ",").alias("suggestions"))


@query(rf"""
with w as (select {SPLIT_SQL} as raw from documents)
select regexp_matches(raw, '\p{{Nd}}') or raw like '%@%' or lower(raw) like '%http%' or lower(raw) like '%www%' or lower(raw) like '%.com%' or length(raw) <= 2 or (raw = upper(raw) and raw <> lower(raw) and length(raw) <= 4) as skipped,
 length(raw) >= 2 and length(regexp_replace(raw, '[^\p{{L}}\p{{N}}]', '', 'g')) >= greatest(2, length(raw) * 0.6) as readable, count(*) as n from w group by all
""")
def token_filters(spark, sf_dir):
    """Tokens that spelling skips and that a reader may trust; each distinct token is judged once."""
    w = table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("raw")).groupBy("raw").agg(F.count("*").alias("c"))
    return w.groupBy(words.skipped(F.col("raw")).alias("skipped"), text.alnum_ok(F.col("raw")).alias("readable")).agg(F.sum("c").alias("n"))


@query(rf"""
with w as (select distinct lower(w) as word from (select {SPLIT_SQL} as w from documents where lang = 'es') where regexp_matches(lower(w), '^[a-z]{{3,12}}$'))
select word, length(word) - length(translate(word, 'aeiou', '')) as variants from w
""")
def accent_forms(spark, sf_dir):
    """How many forms with one accent a word has."""
    w = table(spark, sf_dir, "documents").where("lang = 'es'").select(F.explode(text.words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).where("word rlike '^[a-z]{3,12}$'").distinct()
    return w.select("word", F.size(text.accent_variants(F.col("word"))).cast("long").alias("variants"))


@query("""
with p as (select doc_id, source, n_chars, lang, doc_id % 40 + 1 as page, doc_id % 50 + 100 as ppi, doc_id % 3 as q from documents), f as (
 select source as file, 'resolution' as rule, 'warning' as severity from p where ppi * 1.0 < 130 union all
 select source, 'jpeg_quality', 'info' from p where n_chars % 100 < 40 union all
 select source, 'safe_zone', 'warning' from p where doc_id % 7 = 0 union all
 select source, 'annotations', 'error' from p where lang = 'fr')
select file, rule, severity, count(*) as n from f group by all
""")
def preflight_findings(spark, sf_dir):
    """The rules engine: images, text near the cut and annotations of a file's pages under a profile."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.lit("sheet").alias("profile"), (F.col("doc_id") % 40 + 1).alias("page"), "n_chars", "lang")
    k = F.col("doc_id")
    at = {"x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(72.0), "y1": F.lit(72.0)}
    images = d.select("file", "profile", "page", k.alias("xref"), (k % 50 + 100).cast("double").alias("width"), (k % 50 + 100).cast("double").alias("height"), *(v.alias(c) for c, v in at.items()), F.lit(3).alias("channels"), F.lit(8).alias("bits"), (F.col("n_chars") % 100).cast("double").alias("quality"))
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(c) for c, x in zip(("x0", "y0", "x1", "y1"), v, strict=True)))
    pages = d.select("file", "page", "profile").distinct().select("file", "profile", "page", box(10, 10, 500, 700).alias("trim"), box(0, 0, 510, 710).alias("bleed"), box(0, 0, 510, 710).alias("rect"))
    near = F.when(k % 7 == 0, 12.0).otherwise(100.0)
    blocks = d.select("file", "page", F.lit("t").alias("text"), near.alias("x0"), F.lit(100.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(120.0).alias("y1"))
    notes = d.where("lang = 'fr'").select("file", "profile", "page", *(v.alias(c) for c, v in at.items()))
    files = d.select("file", "profile").distinct().select("file", "profile", F.array(F.lit(1)).alias("transparent_pages"), F.lit(None).cast("string").alias("pdfx"), F.array(F.lit("x")).alias("intents"))
    layers = d.limit(0).select("file", "profile", F.lit("l").alias("name"), F.lit(True).alias("visible"))
    rules = spark.createDataFrame([("sheet", "resolution", True, None, {"color_min": "130"}), ("sheet", "jpeg_quality", True, "info", {"min": "40"}), ("sheet", "safe_zone", True, "warning", {"mm": "3"}), ("sheet", "annotations", True, "error", {}), ("sheet", "transparency", False, "error", {}), ("sheet", "bleed", True, "error", {"min_mm": "3"})], preflight.PROFILE)
    found = preflight.checked({"images": images, "pages": pages, "blocks": blocks, "files": files, "layers": layers, "annotations": notes}, rules)
    return found.groupBy("file", "rule", "severity").agg(F.count("*").alias("n"))


def _tag_stream(spark, sf_dir):
    """A page's tags as paint operators (file, page, seq, op, args): tags save and restore the state, letters paint."""
    tags = F.regexp_extract_all("html", F.lit(r"<(/?)([a-zA-Z0-9]+)"), 0)
    t = table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("file"), F.posexplode(tags).alias("seq", "tag"))
    name = F.lower(F.regexp_replace("tag", "[</]", ""))
    closing = F.col("tag").startswith("</")
    op = F.when(name == "div", F.when(closing, "Q").otherwise("q")).when(name == "a", F.when(closing, "f").otherwise("cs")).when(name == "p", F.when(closing, "S").otherwise("gs")).otherwise("Tj")
    args = F.when(op == "cs", F.array(F.lit("Spot"))).when(op == "gs", F.array(F.lit("OP=true"))).otherwise(F.array().cast("array<string>"))
    return t.select("file", F.lit(1).alias("page"), F.col("seq").cast("long").alias("seq"), op.alias("op"), args.alias("args"))


@query()
def markup_paints(spark, sf_dir):
    """The fold over a page's tags as paint operators: tags save and restore the state, letters paint."""
    return inventory.paints(_tag_stream(spark, sf_dir)).groupBy("file", "what", "space", "overprint").agg(F.count("*").alias("n"))


@query()
def stream_overprints(spark, sf_dir):
    """Operators put in where technical spaces paint with overprint and others do not; the fold is sequential, tests walk random streams."""
    stream = _tag_stream(spark, sf_dir)
    spaces = stream.select("file", F.lit("Spot").alias("space"), F.array(F.when(F.col("file") % 2 == 0, "Dieline").otherwise("PANTONE 185 C")).alias("inks")).distinct()
    made = streams.overprinted(stream, spaces)
    return made.groupBy("file").agg(F.count("*").alias("operators"), F.count_if("made").alias("put_in"))
