"""Ordered words: reading order, alignment, what pairs mean, learned edits, spelling."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from platewright.functions import text
from platewright.operators import words


def lines(spark, page, *texts, shift=0.0):
    rows = [(page, w, 20.0 * i + shift, 30.0 * n, 20.0 * i + 15 + shift, 30.0 * n + 10, 90.0) for n, t in enumerate(texts) for i, w in enumerate(t.split())]
    return spark.createDataFrame(rows, "page int, text string, x0 double, y0 double, x1 double, y1 double, conf double")


def found(spark, a, b):
    one, two = (words.reading_order(lines(spark, 1, *t)) for t in (a, b))
    return sorted((r.subtype, r.expected or "", r.found or "") for r in words.classified(words.aligned_words(one, two)).collect() if r.subtype != "matched")


def test_reading_order_follows_the_line_mean(spark):
    rows = [(1, "c", 40.0, 4.0), (1, "a", 0.0, 0.0), (1, "b", 20.0, 2.0), (1, "e", 20.0, 21.0), (1, "d", 0.0, 20.0)]
    df = spark.createDataFrame([(p, t, x, y, x + 10, y + 10, 100.0) for p, t, x, y in rows], "page int, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    assert [(r.text, r.line, r.pos) for r in words.reading_order(df).orderBy("pos").collect()] == [("a", 0, 0), ("b", 0, 1), ("c", 0, 2), ("d", 1, 3), ("e", 1, 4)]


def test_word_differences(spark):
    assert found(spark, ["precio 10.000 hoy"], ["precio 12.000 hoy"]) == [("changed", "10.000", "12.000")]
    assert found(spark, ["uno dos tres"], ["uno tres"]) == [("missing", "dos", "")]
    assert found(spark, ["uno tres"], ["uno dos tres"]) == [("extra", "", "dos")]
    assert found(spark, ["Hola mundo"], ["hola mun-do"]) == [("case", "Hola", "hola"), ("punctuation", "mundo", "mun-do")]
    # the reading lost an accent that the design has; the other way round is an error
    assert found(spark, ["informacion"], ["información"]) == [] and found(spark, ["información"], ["informacion"]) == [("changed", "información", "informacion")]
    assert found(spark, ["fin."], ["fin"]) == []
    # blocks of different size pair by similarity
    assert found(spark, ["a camisa roja z"], ["a camiza z"]) == [("changed", "camisa", "camiza"), ("missing", "roja", "")]


def test_alignment_of_keys():
    a, b = "x a b c d y".split(), "x b c q d z y".split()
    assert sum(e for _, _, e in words.aligned(a, b)) == sum(n for *_, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert words.similarity("kitten", "sitting") == 200 * 4 / 13 and words.similarity("", "") == 100
    assert words.best_first(["camisa", "rojo"], ["rojos", "camisas", "x"]) == [(0, 1), (1, 0)]


def test_one_side_empty(spark):
    empty = lines(spark, 1, "a").limit(0)
    one = words.reading_order(lines(spark, 1, "a b"))
    assert sorted(r.expected for r in words.aligned_words(one, words.reading_order(empty)).collect()) == ["a", "b"]
    assert words.aligned_words(words.reading_order(empty), words.reading_order(empty)).count() == 0


def test_learned_edits(spark):
    pairs = spark.createDataFrame([("rnesa", "mesa")] * 3 + [("10", "12")] * 5 + [("abcdefgh", "zbydxfwh")] + [("l0", "lo")], "read string, true string")
    learned = words.learned_edits(pairs)
    # no digit for a digit, no pair with more than three edits
    assert {(r.edit, r.n) for r in learned.collect()} == {("rn>m", 3), ("0>o", 1)}
    tests = spark.createDataFrame([(1, "carne", "came"), (2, "1000", "1200"), (3, "l0s", "los"), (4, "", "a"), (5, "same", "same")], "id int, read string, true string")
    assert {r.id: r.explained for r in words.explained(tests, learned).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.id: r.explained for r in words.explained(tests, learned, 1).collect()}[3]


def test_spelling(spark):
    dictionary = spark.createDataFrame([("información", 9), ("perro", 5), ("pez", 3), ("hablar", 4), ("visitar", 2), ("cerro", 1)], "word string, n long")
    raw = spark.createDataFrame([(w,) for w in "Informacion perros peces hablando visítanos perra perrx EAN 12a a@b ok zzzzzz hablar-perro".split()], "text string")
    judged = words.tokens(raw)
    assert {r.word for r in judged.collect()} == {"informacion", "perros", "peces", "hablando", "visítanos", "perra", "perrx", "zzzzzz", "hablar", "perro"}
    got = {r.word: (r.subtype, r.suggestions) for r in words.misspelled(judged, dictionary).collect()}
    assert got == {"informacion": ("accent", ["información"]), "perrx": ("spelling", ["perro", "cerro"]), "zzzzzz": ("spelling", [])}


def test_keys_of_composed_and_decomposed_accents(spark):
    r = spark.range(1).select(text.word_key(F.lit("Niño_!")).alias("k"), text.strip_accents(F.lit("Niño Árbol")).alias("p"), words.tilde_missing(F.lit("Más"), F.lit("Mas")).alias("t"), words.tilde_missing(F.lit("Mas"), F.lit("Más")).alias("u"), text.clean_glyphs(F.lit("ΔE 2")).alias("g")).first()
    assert (r.k, r.p, r.t, r.u, r.g) == ("niño", "Nino Arbol", True, False, "dE 2")
