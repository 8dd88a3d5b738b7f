"""The queries of this subpackage: operators with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.llm import alignment, ann, bpe, decontaminate, html_extract, jaccard_join, packing, pii, quality, source_audit, token_counts, url_filter, webp


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_line_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, sections=None)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda m: m["k"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_features(webp.to_media(_table(spark, sf_dir, "documents")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"))


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _share(host: Column, at: int) -> Column:
    """A number below 65,536 that depends on the host."""
    return F.conv(F.substring(F.md5(host), at, 4), 16, 10).cast("int")


def _day(n: Column | int) -> Column:
    return F.timestamp_seconds(F.lit(1704067200) + (F.lit(n) if isinstance(n, int) else n) * 86400)


def blocklists(captures: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of `captures`; the tables hold no lists, so a rule makes them."""
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("h")).distinct().withColumn("x", _share(F.col("h"), 1)).withColumn("y", _share(F.col("h"), 5))
    h, x, y = F.col("h"), F.col("x"), F.col("y")
    bare = F.regexp_replace(h, r"^(?:www|m|blog)\.", "")

    def entry(test: Column, name: str, kind: str, pattern: Column, action: str, at: Column) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), _day(at).alias("at")))

    entries = F.array_compact(F.array(
        entry(x % 3 == 0, "hosts", "host", h, "added", x % 200),
        entry(x % 6 == 0, "hosts", "host", h, "removed", x % 200 + 40 + y % 60),
        entry(x % 12 == 0, "hosts", "host", h, "added", x % 200 + 120),
        entry(x % 5 == 0, "sections", "prefix", F.concat(h, F.lit("/en/")), "added", y % 300),
        entry(y % 4 == 0, "domains", "domain", bare, "added", y % 250),
        entry(y % 8 == 0, "domains", "domain", bare, "removed", y % 250 + 50)))
    return hosts.select(F.explode(entries).alias("e")).select("e.*").distinct()


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", _day(F.col("page_id") * 7919 % 366).alias("fetched"))
    return url_filter.check(captures, blocklists(captures)).select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "n_hits", "lists", "blocked")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(_table(spark, sf_dir, "documents"), least=3, ranks=200)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), words=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP9_SQL = """
with good as (
  select vec_id, embedding::double[] as v,
         list_reduce(list_prepend(0.0::double, list_transform(embedding::double[], lambda x: x * x)), lambda a, b: a + b) as sq
  from embeddings where embedding is not null),
usable as (select * from good where sq > 0 and sq < 'infinity'::double),
scored as (
  select q.vec_id as query_id, c.vec_id,
         list_reduce(list_prepend(0.0::double, list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), lambda a, b: a + b) / (sqrt(q.sq) * sqrt(c.sq)) as score
  from usable q join usable c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored qualify rank <= 5
"""

OP10_SQL = r"""
with captures as (
  select page_id, url, timestamp '2024-01-01' + to_days(cast(page_id * 7919 % 366 as integer)) as fetched,
         regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path
  from pages),
hosts as (
  select host as h, cast('0x' || substr(md5(host), 1, 4) as integer) as x, cast('0x' || substr(md5(host), 5, 4) as integer) as y
  from (select distinct host from captures)),
entries as (
  select distinct list, kind, pattern, action, timestamp '2024-01-01' + to_days(cast(d as integer)) as changed from (
    select 'hosts' as list, 'host' as kind, h as pattern, 'added' as action, x % 200 as d from hosts where x % 3 = 0
    union all select 'hosts', 'host', h, 'removed', x % 200 + 40 + y % 60 from hosts where x % 3 = 0 and x % 2 = 0
    union all select 'hosts', 'host', h, 'added', x % 200 + 120 from hosts where x % 3 = 0 and x % 4 = 0
    union all select 'sections', 'prefix', h || '/en/', 'added', y % 300 from hosts where x % 5 = 0
    union all select 'domains', 'domain', regexp_replace(h, '^(?:www|m|blog)\.', ''), 'added', y % 250 from hosts where y % 4 = 0
    union all select 'domains', 'domain', regexp_replace(h, '^(?:www|m|blog)\.', ''), 'removed', y % 250 + 50 from hosts where y % 8 = 0)),
states as (select list, kind, pattern, changed, bool_and(action = 'added') as active from entries group by all),
turns as (
  select *, coalesce(lag(active) over w, false) as before from states window w as (partition by list, kind, pattern order by changed)),
kept as (select * from turns where active <> before),
intervals as (
  select list, kind, pattern, changed as starts, ends, active
  from (select *, lead(changed) over (partition by list, kind, pattern order by changed) as ends from kept)),
keyed as (
  select distinct page_id, url, fetched, kind, pattern from (
    select page_id, url, fetched, 'host' as kind, host as pattern from captures
    union all
    select page_id, url, fetched, 'domain', array_to_string(list_slice(string_split(host, '.'), i, 99), '.')
    from captures, unnest(range(1, len(string_split(host, '.')) + 1)) as t(i)
    union all
    select page_id, url, fetched, 'prefix', host || array_to_string(list_slice(string_split(path, '/'), 1, i), '/') || '/'
    from captures, unnest(range(1, greatest(len(string_split(path, '/')), 2))) as t(i))
  where pattern <> ''),
hits as (
  select page_id, url, fetched, count(*) as n_hits, array_to_string(list_sort(list(distinct list)), ',') as lists
  from keyed join intervals using (kind, pattern)
  where active and starts <= fetched and (ends is null or fetched < ends)
  group by all)
select c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d %H:%M:%S') as fetched, coalesce(n_hits, 0) as n_hits, coalesce(lists, '') as lists, coalesce(n_hits, 0) > 0 as blocked
from captures c left join hits h on c.page_id = h.page_id and c.url = h.url
"""

OP11_SQL = r"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
groups as (select distinct lang, source from d),
found as (select rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from found group by lang, term having count(distinct rid) >= 3),
counts as (select lang, source, term, count(*) as c from found semi join kept using (lang, term) group by all),
sizes as (select lang, count(*) as v from kept group by lang),
sums as (select g.lang, g.source, coalesce(sum(c), 0) as n from groups g left join counts using (lang, source) group by all),
shares as (
  select k.lang, k.term, s.source, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)::hugeint) // (s.n + z.v)::hugeint as p
  from kept k join sizes z using (lang) join sums s using (lang) left join counts c on c.lang = k.lang and c.term = k.term and c.source = s.source),
whole as (
  select c.lang, c.term, 1 + (1000000000::hugeint * (sum(c.c) + 1)::hugeint) // (any_value(t.n) + any_value(z.v))::hugeint as q
  from counts c join sizes z using (lang) join (select lang, sum(n) as n from sums group by lang) t using (lang) group by c.lang, c.term),
pairs as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(value, 0) as value
  from groups g join groups h on h.lang = g.lang and h.source <> g.source
  left join (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
             from shares a join shares b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all) x
    on x.lang = g.lang and x.source = g.source and x.item = h.source),
terms as (
  select s.lang, s.source, 'term' as part, s.term as item, ((p - q) * (p - q)) // q as value
  from shares s join whole w using (lang, term) where s.c > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 200
"""

OP12_SQL = r"""
with d as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as words
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(i) where len(w) > 0),
places as (
  select rid, k, i, array_to_string(w[i:i + k - 1], ' ') as words
  from d, (select distinct k from windows) s, unnest(range(1, len(w) - k + 2)) as t(i) where len(w) >= k),
met as (select rid, p.k, i, item_id from places p join windows x on x.k = p.k and x.words = p.words),
hits as (select rid, count(distinct i + j) as n_hit from (select distinct rid, k, i from met), unnest(range(0, k)) as t(j) group by rid),
items as (select rid, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',') as ids from met group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (rid) left join items using (rid)
"""

QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_line_token_counts, op3_main_text, op4_packed_documents, op5_personal_data, op6_jaccard_components, op7_media_features, op8_quality, op9_nearest_vectors, op10_url_filter, op11_source_divergence, op12_decontamination, op13_token_alignment)}
ORACLES = {"op9_nearest_vectors": OP9_SQL, "op10_url_filter": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_decontamination": OP12_SQL}
