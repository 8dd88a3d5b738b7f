"""Content streams rewritten: overprint set where technical inks or pure black paint, spot inks painted as process colour.

Streams are rows (file, page, seq, op, args array<string>) as in `inventory`.  A page's operators come in
order and meet a state that `q` saves and `Q` brings back; what is written is again such rows, with
numbers of their own.  Spaces are marked by a join beforehand, so a task holds the state and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewright.functions.names import kind_of, normalized
from platewright.operators.lines import folded

FIELDS = "seq long, op string, args array<string>, made boolean"
ON, OFF = ["op=true", "OP=true"], ["op=false", "OP=false"]


def _marked(stream: DataFrame, spaces: DataFrame, columns: list[str]) -> DataFrame:
    """`stream` with `columns` of the space (file, space, ...) that a row of cs or CS names."""
    name = F.when(F.col("op").isin("cs", "CS"), F.get("args", F.lit(0)))
    return stream.withColumn("space", name).join(spaces.select("file", "space", *columns), ["file", "space"], "left").drop("space")


class _State:
    """The current space of fills and strokes, what it brings with it, and the states saved."""

    def __init__(self):
        self.now, self.saved, self.seq = {"cs": None, "CS": None, "over": False}, [], 0

    def save(self) -> None:
        self.saved.append(dict(self.now))

    def restore(self) -> None:
        if self.saved:
            self.now = self.saved.pop()

    def put(self, op: str, args: list[str], made: bool) -> tuple:
        self.seq += 1
        return self.seq, op, args, made


def overprinted(stream: DataFrame, spaces: DataFrame, black: bool = True) -> DataFrame:
    """(file, page, seq, op, args, made): a stream in which technical inks and varnish (and pure black) paint with overprint, all else without.

    `spaces` (file, space, inks array) lists the colourants of each space; a space of technical inks alone
    counts.  A `gs` is put in where the wanted overprint changes (`made`), and only there.
    """
    kinds = F.transform("inks", lambda i: kind_of(i))
    technical = spaces.select("file", "space", (F.size("inks") > 0).alias("_some"), F.forall(kinds, lambda k: k.isin("technical", "varnish")).alias("_all")).select("file", "space", (F.col("_some") & F.col("_all")).alias("technical"))

    def step(state: _State, row: dict) -> list[tuple]:
        op, args = row["op"], row["args"] or []
        if op == "q":
            state.save()
        elif op == "Q":
            state.restore()
        out, want = [state.put(op, args, False)], None
        if op in ("cs", "CS"):
            state.now[op] = want = bool(row["technical"])
        elif op in ("scn", "sc", "SCN", "SC"):
            want = bool(state.now["cs" if op.islower() else "CS"])
        elif op in ("g", "rg", "G", "RG"):
            state.now["cs" if op.islower() else "CS"] = want = False
        elif op in ("k", "K"):
            state.now["cs" if op == "k" else "CS"] = False
            want = black and [float(a) for a in args] == [0.0, 0.0, 0.0, 1.0]
        if want is not None and want != state.now["over"]:
            state.now["over"] = want
            out.append(state.put("gs", ON if want else OFF, True))
        return out

    return folded(_marked(stream, technical, ["technical"]), ["file", "page"], ["seq"], _State, step, FIELDS)


def as_process(stream: DataFrame, spaces: DataFrame, values: DataFrame) -> DataFrame:
    """(file, page, seq, op, args, made): a stream in which the inks of `values` (name, c, m, y, k) are painted in process colours.

    Spaces of one such ink are left out, and each tint becomes `k` or `K` with the ink's values times the
    tint (a linear tint, the usual one of a spot ink); full colour where no tint is given before a paint.
    """
    one = spaces.where(F.size("inks") == 1).select("file", "space", normalized(F.get("inks", F.lit(0))).alias("_ink"))
    known = values.select(normalized(F.col("name")).alias("_ink"), F.array(*(F.col(c).cast("double") for c in "cmyk")).alias("cmyk"))
    process = one.join(known, "_ink").select("file", "space", "cmyk")

    def painted(cmyk: list[float], tint: float, op: str, state: _State) -> tuple:
        return state.put("k" if op.islower() else "K", [f"{min(max(v * tint, 0.0), 1.0):.4f}" for v in cmyk], True)

    def step(state: _State, row: dict) -> list[tuple]:
        op, args = row["op"], row["args"] or []
        if op == "q":
            state.save()
        elif op == "Q":
            state.restore()
        elif op in ("cs", "CS"):
            state.now[op] = row["cmyk"]
            if row["cmyk"]:
                return [painted(row["cmyk"], 1.0, op, state)]
        elif op in ("scn", "sc", "SCN", "SC"):
            cmyk = state.now["cs" if op.islower() else "CS"]
            if cmyk:
                return [painted(cmyk, float(args[0]) if args else 1.0, op, state)]
        elif op.lower() in ("g", "rg", "k"):
            state.now["cs" if op.islower() else "CS"] = None
        return [state.put(op, args, False)]

    return folded(_marked(stream, process, ["cmyk"]), ["file", "page"], ["seq"], _State, step, FIELDS)


def under_boxes(plates: DataFrame, boxes: DataFrame, black: str = "Black", colours: tuple[str, ...] = ("Cyan", "Magenta", "Yellow"), solid: float = 0.5, printed: float = 0.25, least: int = 4, tile: int = 64) -> DataFrame:
    """`boxes` (page, id, x, y, w, h, ...) with what plates (page, ink, x, y, cov 0..255) print under them.

    Adds black_cmy, the mean of the coloured inks in percent where black is solid (null with fewer than
    `least` such pixels), and inks, the number of inks that cover a pixel by more than `printed`.  Boxes
    and pixels meet by page and tile; a box takes a row for each tile it touches.
    """
    span = lambda at, size: F.explode(F.sequence(F.floor(F.col(at) / tile), F.floor((F.col(at) + F.greatest(F.col(size), F.lit(1)) - 1) / tile)))
    tiled = boxes.select("page", "id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("w").alias("_w"), F.col("h").alias("_h"), span("x", "w").alias("_tx"), "y", "h").select("page", "id", "_x", "_y", "_w", "_h", "_tx", span("y", "h").alias("_ty"))
    placed = plates.where(F.col("cov") > 0).withColumns({"_tx": F.floor(F.col("x") / tile), "_ty": F.floor(F.col("y") / tile)})
    inside = F.col("x").between(F.col("_x"), F.col("_x") + F.col("_w") - 1) & F.col("y").between(F.col("_y"), F.col("_y") + F.col("_h") - 1)
    met = placed.join(tiled, ["page", "_tx", "_ty"]).where(inside).select("page", "id", "x", "y", "ink", "cov")
    pixel = met.groupBy("page", "id", "x", "y").agg(F.max(F.when(F.col("ink") == black, F.col("cov"))).alias("_k"), F.sum(F.when(F.col("ink").isin(*colours), F.col("cov")).otherwise(0)).alias("_cmy"))
    dark = pixel.where(F.col("_k") >= 255 * solid).groupBy("page", "id").agg(F.when(F.count("*") >= least, F.avg("_cmy") / 255 * 100 / len(colours)).alias("black_cmy"))
    several = met.where(F.col("cov") > 255 * printed).groupBy("page", "id").agg(F.count_distinct("ink").alias("inks"))
    return boxes.join(dark, ["page", "id"], "left").join(several, ["page", "id"], "left").withColumn("inks", F.coalesce("inks", F.lit(0).cast("long")))
