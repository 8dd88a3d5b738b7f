"""Ordered words of two readings: reading order, sequence difference, character edits and spelling.

Alignment is sequential within a page, so a page's words meet in one task by a cogroup; what a pair
means is decided by column expressions afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewright.functions.text import strip_accents, strip_punct, word_key

WORD = "text string, x0 double, y0 double, x1 double, y1 double, conf double"


def reading_order(words: DataFrame, page: str = "page") -> DataFrame:
    """Adds `line` and `pos`: lines from top to bottom, words from left to right.

    A word begins a line when its centre is more than 0.6 median heights from the line's mean so far.
    """
    kind = words.schema[page].dataType.simpleString()

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(cy=(pdf.y0 + pdf.y1) / 2).sort_values(["cy", "x0"], kind="stable", ignore_index=True)
        reach = 0.6 * (float((pdf.y1 - pdf.y0).median()) or 10.0)
        line, total, n, out = 0, 0.0, 0, []
        for cy in pdf.cy:
            if n and abs(cy - total / n) > reach:
                line, total, n = line + 1, 0.0, 0
            total, n = total + cy, n + 1
            out.append(line)
        pdf = pdf.assign(line=out).sort_values(["line", "x0"], kind="stable", ignore_index=True)
        return pdf.assign(pos=range(len(pdf)))[[page, "text", "x0", "y0", "x1", "y1", "conf", "line", "pos"]]

    return words.select(page, "text", "x0", "y0", "x1", "y1", "conf").groupBy(page).applyInPandas(order, f"`{page}` {kind}, {WORD}, line int, pos int")


def similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence, in percent of both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def best_first(left: list[str], right: list[str], least: float = 50.0) -> list[tuple[int, int]]:
    """Pairs by falling similarity, each side used once; ties go to the later pair."""
    ranked = sorted(((r, i, j) for i, a in enumerate(left) for j, b in enumerate(right) if (r := similarity(a, b)) >= least), reverse=True)
    used_left, used_right, pairs = set(), set(), []
    for _, i, j in ranked:
        if i not in used_left and j not in used_right:
            used_left.add(i), used_right.add(j)
            pairs.append((i, j))
    return pairs


def aligned(left: list[str], right: list[str]) -> Iterator[tuple[int | None, int | None, bool]]:
    """(left, right, equal keys) of the sequence difference of two lists of keys."""
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if tag == "equal":
            yield from ((i, j, True) for i, j in zip(range(i1, i2), range(j1, j2), strict=True))
            continue
        same = i2 - i1 == j2 - j1
        pairs = [(k, k) for k in range(i2 - i1)] if same else best_first(left[i1:i2], right[j1:j2]) if tag == "replace" else []
        yield from ((i1 + i, j1 + j, False) for i, j in pairs)
        yield from ((i, None, False) for i in range(i1, i2) if i - i1 not in {p for p, _ in pairs})
        yield from ((None, j, False) for j in range(j1, j2) if j - j1 not in {q for _, q in pairs})


def aligned_words(wanted: DataFrame, found: DataFrame, page: str = "page") -> DataFrame:
    """(page, expected, found, equal): both sides' words of (page, pos, text), aligned; words without a key take no part.

    A full outer join by position: one side is null where a word is missing or extra.
    """
    kind = wanted.schema[page].dataType.simpleString()
    # new names for all columns: both sides may come from one table
    keyed = lambda df: df.select(F.col(page).alias("_page"), F.col("pos").alias("_pos"), F.col("text").alias("_text"), word_key(F.col("text")).alias("_key")).where("_key <> ''")

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = ((side.sort_values("_pos")[["_text", "_key"]].values.tolist() if len(side) else []) for side in (left, right))
        key = (left if len(left) else right)["_page"].iloc[0]
        rows = [(key, None if i is None else a[i][0], None if j is None else b[j][0], e) for i, j, e in aligned([k for _, k in a], [k for _, k in b])]
        return pd.DataFrame(rows, columns=[page, "expected", "found", "equal"])

    return keyed(wanted).groupBy("_page").cogroup(keyed(found).groupBy("_page")).applyInPandas(join, f"`{page}` {kind}, expected string, found string, equal boolean")


def accents_lost(expected: Column, found: Column) -> Column:
    """Only `found` has accents and nothing else differs: the reading lost them."""
    a, b = word_key(expected), word_key(found)
    return (a != b) & (strip_accents(a) == strip_accents(b)) & (strip_accents(b) != b) & (strip_accents(a) == a)


def pair_subtype(expected: Column, found: Column) -> Column:
    """punctuation or case where the keys are equal, else changed."""
    return F.when(word_key(expected) != word_key(found), "changed").when(strip_punct(expected) == strip_punct(found), "punctuation").otherwise("case")


def classified(pairs: DataFrame) -> DataFrame:
    """Adds subtype (matched, punctuation, case, changed, missing, extra) and severity to aligned words."""
    e, f = F.col("expected"), F.col("found")
    bare = lambda c: F.regexp_replace(c, r"^[.,;:]+|[.,;:]+$", "")
    subtype = (
        F.when(f.isNull(), "missing")
        .when(e.isNull(), "extra")
        .when(F.col("equal") & (bare(e) == bare(f)), "matched")
        .when(~F.col("equal") & accents_lost(e, f), "matched")
        .otherwise(pair_subtype(e, f))
    )
    severity = F.when(F.col("subtype").isin("missing", "changed"), "high").when(F.col("subtype") == "extra", "medium").when(F.col("subtype") != "matched", "low")
    return pairs.withColumn("subtype", subtype).withColumn("severity", severity)


def diff_totals(pairs: DataFrame, page: str = "page") -> DataFrame:
    """Matched words and the greater number of both sides' words, for the text score."""
    return pairs.groupBy(page).agg(F.count_if(F.col("subtype") == "matched").alias("matched"), F.greatest(F.count("expected"), F.count("found")).alias("total"))


def tilde_missing(expected: Column, found: Column) -> Column:
    """Found lacks an accent that expected has, and nothing else."""
    plain = strip_accents(F.lower(expected)) == strip_accents(F.lower(found))
    return F.coalesce((expected != "") & (found != "") & (expected != found) & plain & (strip_accents(found) == found) & (strip_accents(expected) != expected), F.lit(False))


# ---------------------------------------------------------------- learned edits


EDITS = T.ArrayType(T.StructType([T.StructField("read", T.StringType()), T.StructField("true", T.StringType())]))


@F.pandas_udf(EDITS)
def char_edits(read: pd.Series, true: pd.Series) -> pd.Series:
    """Replacements that turn `read` into `true`."""
    def edits(a, b):
        if a is None or b is None:
            return None
        return [{"read": a[i1:i2], "true": b[j1:j2]} for tag, i1, i2, j1, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if tag != "equal"]

    return pd.Series([edits(a, b) for a, b in zip(read, true, strict=True)])


def digits_only_swap(edit: Column) -> Column:
    """A digit read as another digit is never a misreading."""
    return edit["read"].rlike("[0-9]") & edit["true"].rlike("[0-9]")


def learned_edits(pairs: DataFrame, examples: int = 3) -> DataFrame:
    """(edit, read, true, n, examples) of reviewed pairs (read, true): at most three edits in a pair, no digit for a digit."""
    each = pairs.select("read", "true", char_edits("read", "true").alias("e")).where(F.size("e").between(1, 3))
    each = each.select(F.explode("e").alias("e"), F.col("read").alias("from"), F.col("true").alias("to")).where(~digits_only_swap(F.col("e"))).select("e.read", "e.true", "from", "to")
    counted = each.groupBy("read", "true", "from", "to").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("k", F.row_number().over(Window.partitionBy("read", "true").orderBy("from", "to")))
    shown = F.array_sort(F.collect_list(F.when(F.col("k") <= examples, F.struct("from", "to"))))
    out = ranked.groupBy("read", "true").agg(F.sum("n").alias("n"), shown.alias("examples"))
    return out.select(F.concat_ws(">", "read", "true").alias("edit"), "read", "true", "n", "examples")


def explained(pairs: DataFrame, learned: DataFrame, least: int = 3) -> DataFrame:
    """Adds `explained`: every edit of the pair (id, read, true) was seen `least` times or more."""
    edits = pairs.select("id", char_edits("read", "true").alias("e"))
    each = edits.select("id", F.size("e").alias("size"), F.explode("e").alias("e"))
    known = learned.where(F.col("n") >= least).select(F.struct("read", "true").alias("e"), F.lit(True).alias("known"))
    judged = each.join(known, "e", "left").groupBy("id").agg((F.bool_and(F.coalesce("known", F.lit(False)) & ~digits_only_swap(F.col("e"))) & (F.max("size") <= 3)).alias("explained"))
    return pairs.join(judged, "id", "left").withColumn("explained", F.coalesce("explained", F.lit(False)) & (F.col("read") != "") & (F.col("true") != ""))


# ---------------------------------------------------------------- spelling

# Regular endings of the three conjugations, pronouns that hang on a verb, endings of plurals and genders.
ENDINGS = {
    "ar": "a as amos áis an o é aste ó aron ando ado ada ados adas aba abas aban ábamos aré arás ará arán aría arías arían e es emos en ar",
    "er": "e es emos éis en o í iste ió ieron iendo ido ida idos idas ía ías ían eré erá erán ería a as an er",
    "ir": "e es imos ís en o í iste ió ieron iendo ido ida idos idas ía ías ían iré irá irán iría a as an ir",
}
PRONOUNS = "selos selas selo sela nos les los las me te se le lo la os".split()
FORMS = [("es", ""), ("s", ""), ("a", "o"), ("as", "o"), ("os", "o"), ("as", "a"), ("ísima", "o"), ("ísimo", "o")]


def _swapped(word: Column, rules: list[tuple[str, str]], left: int) -> Column:
    """`word` with each suffix that it has replaced, where at least `left` characters stay."""
    table = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(r).alias("r")) for s, r in rules))
    fits = F.filter(table, lambda t: word.endswith(t["s"]) & (F.length(word) - F.length(t["s"]) >= left))
    return F.transform(fits, lambda t: F.concat(F.left(word, F.length(word) - F.length(t["s"])), t["r"]))


def base_forms(word: Column) -> Column:
    """Dictionary forms that `word` may come from: itself, singular, masculine, infinitive, also without a pronoun."""
    verbs = [(e, inf) for inf, all_ in ENDINGS.items() for e in all_.split()]
    plural = F.transform(F.filter(_swapped(word, [("es", ""), ("s", "")], 3), lambda f: f.endswith("c")), lambda f: F.concat(F.left(f, F.length(f) - 1), F.lit("z")))
    stems = F.transform(_swapped(word, [(p, "") for p in PRONOUNS], 3), strip_accents)
    hung = F.flatten(F.transform(stems, lambda s: F.concat(F.array(s, F.concat(s, F.lit("r"))), _swapped(s, verbs, 3))))
    return F.array_distinct(F.concat(F.array(word), _swapped(word, FORMS, 3), plural, _swapped(word, [("ces", "z")], 0), _swapped(word, verbs, 3), hung))


def skipped(raw: Column) -> Column:
    """Tokens that spelling does not judge: digits, addresses, two letters or fewer, short runs of capitals."""
    low = F.lower(raw)
    return raw.rlike(r"\p{Nd}") | raw.contains("@") | low.contains("http") | low.contains("www") | low.contains(".com") | (F.length(raw) <= 2) | ((raw == F.upper(raw)) & (raw != low) & (F.length(raw) <= 4))


def tokens(words: DataFrame, text: str = "text") -> DataFrame:
    """Adds `raw` and `word` of the parts of compound words that spelling judges."""
    parts = words.select("*", F.explode(F.split(text, "[-–/]")).alias("_p"))
    trimmed = parts.withColumn("raw", F.regexp_replace("_p", r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")).drop("_p")
    return trimmed.where((F.col("raw") != "") & ~skipped(F.col("raw"))).withColumn("word", F.lower("raw"))


def known(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`words` (word, distinct) that are in the dictionary (word) or derived from it."""
    forms = words.select("word", F.explode(base_forms(F.col("word"))).alias("form"))
    return forms.join(dictionary.select(F.col("word").alias("form")).distinct(), "form", "left_semi").select("word").distinct()


def deletions(word: Column, most: int = 2) -> Column:
    """`word` with up to two characters left out."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    first = one(word)
    return F.array_distinct(F.concat(F.array(word), first, F.flatten(F.transform(first, one)) if most > 1 else F.array().cast("array<string>")))


def suggestions(unknown: DataFrame, dictionary: DataFrame, most: int = 3) -> DataFrame:
    """(word, suggestions): dictionary words within two edits, the more frequent first.

    Words within two edits have a form in common from which each lacks two characters at most: an
    equality join in place of all pairs.  `dictionary` has word and n.
    """
    left = unknown.select("word", F.explode(deletions(F.col("word"))).alias("d"))
    right = dictionary.select(F.col("word").alias("candidate"), "n", F.explode(deletions(F.col("word"))).alias("d"))
    near = left.join(right, "d").select("word", "candidate", "n").distinct().withColumn("edits", F.levenshtein("word", "candidate")).where("edits between 1 and 2")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("edits", F.col("n").desc(), "candidate"))).where(F.col("k") <= most)
    return ranked.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "candidate"))), lambda s: s["candidate"]).alias("suggestions"))


def misspelled(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, subtype, suggestions) of distinct words that the dictionary (word, n) does not know.

    One accented variant that it knows is a missing accent; other words get ranked suggestions.
    """
    from platewright.functions.text import accent_variants

    unknown = words.select("word").distinct().join(known(words.select("word").distinct(), dictionary), "word", "left_anti")
    variants = unknown.select(F.col("word").alias("plain"), F.explode(accent_variants(F.col("word"))).alias("word"))
    fits = variants.join(known(variants.select("word").distinct(), dictionary), "word", "left_semi").groupBy("plain").agg(F.count("*").alias("n"), F.min("word").alias("fix")).where("n = 1")
    accented = fits.select(F.col("plain").alias("word"), F.lit("accent").alias("subtype"), F.array("fix").alias("suggestions"))
    rest = unknown.join(accented, "word", "left_anti")
    return accented.unionByName(rest.join(suggestions(rest, dictionary), "word", "left").select("word", F.lit("spelling").alias("subtype"), F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions")))
