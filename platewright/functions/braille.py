"""Text to six-dot cells, with capital and number signs, and their places on the sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dots of letters, signs and punctuation; sizes of the usual pharmaceutical geometry in millimetres.
LETTERS = {
    "a": "1", "b": "12", "c": "14", "d": "145", "e": "15", "f": "124", "g": "1245", "h": "125", "i": "24", "j": "245", "k": "13", "l": "123", "m": "134", "n": "1345", "o": "135",
    "p": "1234", "q": "12345", "r": "1235", "s": "234", "t": "2345", "u": "136", "v": "1236", "w": "2456", "x": "1346", "y": "13456", "z": "1356",
    "ñ": "12456", "á": "12356", "é": "2346", "í": "34", "ó": "346", "ú": "23456", "ü": "1256",
}
PUNCTUATION = {",": "2", ".": "3", ";": "23", ":": "25", "-": "36", "?": "26", "¿": "26", "!": "235", "¡": "235", "(": "236", ")": "356", "/": "34", "%": "456"}
DIGITS = dict(zip("1234567890", "abcdefghij", strict=True))
CAPITAL, NUMBER = "6", "3456"
DIAMETER, DOT, CELL, LINE = 1.6, 2.5, 6.0, 10.0


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def word_cells(word: Column) -> Column:
    """Cells of a word as strings of dots; a character without a cell gives null.

    A word of capitals has the capital sign twice; digits follow one number sign until another
    character than a point or comma comes.
    """
    characters = F.filter(F.split(word, ""), lambda c: c != "")
    letters = F.filter(characters, lambda c: c.rlike(r"^\p{L}$"))
    shout = (F.size(letters) > 1) & F.forall(letters, lambda c: c.rlike(r"^\p{Lu}$"))
    digits = {k: LETTERS[v] for k, v in DIGITS.items()}

    def step(s: Column, c: Column) -> Column:
        number = c.rlike("^[0-9]$")
        letter = _lookup(LETTERS, F.lower(c))
        signs = F.when(number & ~s["number"], F.array(F.lit(NUMBER))).when(letter.isNotNull() & c.rlike(r"^\p{Lu}$") & ~shout, F.array(F.lit(CAPITAL))).otherwise(F.array().cast("array<string>"))
        cell = F.when(number, _lookup(digits, c)).otherwise(F.coalesce(letter, _lookup(PUNCTUATION, c)))
        return F.struct(F.concat(s["cells"], signs, F.array(cell)).alias("cells"), F.when(number, True).when(c.isin(".", ","), s["number"]).otherwise(False).alias("number"))

    start = F.struct(F.when(shout, F.array(F.lit(CAPITAL), F.lit(CAPITAL))).otherwise(F.array().cast("array<string>")).alias("cells"), F.lit(False).alias("number"))
    made = F.aggregate(characters, start, step)["cells"]
    return F.when(~F.exists(made, lambda c: c.isNull()), made)


def cell_character(dots: Column) -> Column:
    """Unicode cell of a string of dots."""
    bits = F.aggregate(F.filter(F.split(dots, ""), lambda d: d != ""), F.lit(0), lambda s, d: s + F.pow(F.lit(2), d.cast("int") - 1).cast("int"))
    return F.decode(F.unhex(F.lpad(F.hex((bits + 0x2800).cast("long")), 4, "0")), "UTF-16BE")


def lines_of(words: Column, most: int) -> Column:
    """Words (arrays of cells) put into lines of `most` cells, greedily, an empty cell between two."""
    empty = F.array().cast("array<array<string>>")

    def step(s: Column, w: Column) -> Column:
        fits = F.size(s["line"]) + F.size(w) + 1 <= most
        joined = F.concat(s["line"], F.array(F.lit("")), w)
        return (
            F.when(F.size(s["line"]) == 0, F.struct(s["lines"].alias("lines"), w.alias("line")))
            .when(fits, F.struct(s["lines"].alias("lines"), joined.alias("line")))
            .otherwise(F.struct(F.concat(s["lines"], F.array(s["line"])).alias("lines"), w.alias("line")))
        )

    start = F.struct(empty.alias("lines"), F.array().cast("array<string>").alias("line"))
    return F.aggregate(words, start, step, lambda s: F.when(F.size(s["line"]) > 0, F.concat(s["lines"], F.array(s["line"]))).otherwise(s["lines"]))


def laid_out(df: DataFrame, text: str, width_mm: float = 60.0) -> DataFrame:
    """Adds cells' lines, their characters, size in millimetres and a `problem` (unknown character, word too long)."""
    most = max(int((width_mm + CELL - DOT) // CELL), 1)
    df = df.withColumn("_words", F.transform(F.split(text, " "), word_cells))
    bad, long_ = F.exists("_words", lambda w: w.isNull()), F.exists("_words", lambda w: F.size(w) > most)
    df = df.withColumn("problem", F.when(bad, "character without a cell").when(long_, "word too long"))
    df = df.withColumn("lines", F.when(F.col("problem").isNull(), lines_of(F.filter("_words", lambda w: w.isNotNull()), most)))
    df = df.withColumns({
        "unicode": F.array_join(F.transform("lines", lambda ln: F.array_join(F.transform(ln, lambda c: F.when(c == "", " ").otherwise(cell_character(c))), "")), "\n"),
        "width_mm": F.round((F.array_max(F.transform("lines", F.size)) - 1) * CELL + DOT + DIAMETER, 2), "height_mm": F.round((F.size("lines") - 1) * LINE + 2 * DOT + DIAMETER, 2)})
    return df.drop("_words")


def dots(df: DataFrame) -> DataFrame:
    """A row (x, y in millimetres) for every dot of `laid_out` rows."""
    cells = df.select("*", F.posexplode("lines").alias("li", "line")).select("*", F.posexplode("line").alias("ci", "cell"))
    each = cells.select("*", F.explode(F.filter(F.split("cell", ""), lambda d: d != "")).alias("d")).withColumn("d", F.col("d").cast("int") - 1)
    return each.select(*[c for c in df.columns if c != "lines"], (F.col("ci") * CELL + F.floor(F.col("d") / 3) * DOT + DIAMETER / 2).alias("x"), (F.col("li") * LINE + F.pmod("d", F.lit(3)) * DOT + DIAMETER / 2).alias("y"))
