"""Text keys, patterns, check digits and error rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"


#: Letters that take accents, with the accents of `ACCENTED`, in their decomposed form.
MARKS = {"\u0300": "àèìòùÀÈÌÒÙ", "\u0301": "áéíóúÁÉÍÓÚ", "\u0302": "âêîôûÂÊÎÔÛ", "\u0303": "ãõñÃÕÑ", "\u0308": "äëïöüÄËÏÖÜ", "\u0327": "çÇ"}


def composed(text: Column) -> Column:
    """Decomposed accents of `ACCENTED` as single characters."""
    made = text
    for mark, letters in MARKS.items():
        plain = letters.translate(str.maketrans(ACCENTED, PLAIN))
        for c, p in zip(letters, plain, strict=True):
            made = F.replace(made, F.lit(p + mark), F.lit(c))
    # most texts have no combining mark
    return F.when(text.rlike("[\u0300-\u036f]"), made).otherwise(text)


def strip_punct(word: Column) -> Column:
    """Letters, marks and digits only."""
    return F.regexp_replace(word, r"[^\p{L}\p{M}\p{N}]", "")


def word_key(word: Column) -> Column:
    """Letters and digits in small letters, accents composed: what two words are compared by."""
    return F.lower(F.regexp_replace(composed(word), r"[^\p{L}\p{N}]", ""))


def strip_accents(text: Column) -> Column:
    """Without accents, single or combining."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[\u0300-\u036f]", "")


def alnum_ok(token: Column) -> Column:
    """Two characters or more, most of them letters or digits."""
    n = F.length(F.regexp_replace(token, r"[^\p{L}\p{N}]", ""))
    return (F.length(token) >= 2) & (n >= F.greatest(F.lit(2.0), F.length(token) * 0.6))


def clean_glyphs(text: Column) -> Column:
    """Without the glyph that report fonts lack; null is empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("Δ"), F.lit("d"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def accent_variants(word: Column) -> Column:
    """All strings with exactly one of the vowels of `word` accented."""
    def at(i: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), i - 1), F.translate(F.substring(word, i, F.lit(1)), "aeiou", "áéíóú"), F.substring(word, i + 1, F.length(word)))

    return F.filter(F.transform(F.sequence(F.lit(1), F.length(word)), at), lambda v: v != word)


def pattern_of(token: Column) -> Column:
    """Digits 9, capitals A, small letters a; null without a digit or out of 3 to 24 characters."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    return F.when(token.rlike("[0-9]") & F.length(token).between(3, 24), shape)


def check_digit(digits: Column) -> Column:
    """Modulo-10 check digit with weights 3 and 1 from the right."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.element_at(d, i).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.pmod(10 - total % 10, F.lit(10))


def error_rate(reference: Column, read: Column) -> Column:
    """Character error rate, capped at 1; an empty reference gives 0."""
    return F.when(F.length(reference) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.levenshtein(reference, read) / F.greatest(F.length(reference), F.lit(1))))


def plain_text(text: Column) -> Column:
    """Small letters, single blanks, no accents."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(text)), r"[ \t\n\r]+", " "))
