"""Inks of documents: uses, spellings, edits, and the fold over a page's paint operators.

Content streams are rows (file, page, seq, op, args array<string>).  The fold keeps a stack of graphics
states and is sequential within a page; everything after it is relational.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewright.functions.names import kind_of, normalized

# Operators that paint fills, strokes and text; operators that set a device space.
FILL, STROKE, TEXT = {"f", "F", "f*", "B", "B*", "b", "b*", "sh"}, {"S", "s", "B", "B*", "b", "b*"}, {"Tj", "TJ", "'", '"'}
DEVICE = {"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}
PAINTS = "seq long, what string, space string, overprint boolean"


def paints(stream: DataFrame) -> DataFrame:
    """(file, page, seq, what, space, overprint): a row for each paint, with the space and overprint it happens in.

    `q` saves the state and `Q` brings it back; `gs` takes op and OP from its arguments (OP counts for
    both where op is not given); `cs` and `CS` name a space.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        state, saved, out = {"fill": "DeviceGray", "stroke": "DeviceGray", "op": False, "OP": False}, [], []
        for seq, op, args in zip(pdf.seq, pdf.op, pdf.args, strict=True):
            if op == "q":
                saved.append(dict(state))
            elif op == "Q":
                state = saved.pop() if saved else state
            elif op == "gs":
                given = dict(a.split("=") for a in args)
                state.update({k: v == "true" for k, v in given.items() if k in ("op", "OP")})
                if "OP" in given and "op" not in given:
                    state["op"] = given["OP"] == "true"
            elif op in ("cs", "CS"):
                state["fill" if op == "cs" else "stroke"] = args[0]
            elif op.lower() in DEVICE:
                state["fill" if op.islower() else "stroke"] = DEVICE[op.lower()]
            else:
                if op in FILL | TEXT:
                    out.append((seq, "text" if op in TEXT else "fill", state["fill"], state["op"]))
                if op in STROKE:
                    out.append((seq, "stroke", state["stroke"], state["OP"]))
        rows = pd.DataFrame(out, columns=["seq", "what", "space", "overprint"])
        return rows.assign(file=pdf.file.iloc[0], page=pdf.page.iloc[0])[["file", "page", "seq", "what", "space", "overprint"]]

    return stream.groupBy("file", "page").applyInPandas(fold, f"file {kinds['file']}, page {kinds['page']}, {PAINTS}")


def ink_paints(painted: DataFrame, spaces: DataFrame) -> DataFrame:
    """Paints of named inks: `spaces` (file, space, inks array) lists each space's colourants."""
    named = painted.join(spaces, ["file", "space"]).select("file", "page", "seq", "what", "overprint", F.explode("inks").alias("name"))
    return named.withColumns({"ink": normalized(F.col("name")), "kind": kind_of(F.col("name"))})


def space_uses(painted: DataFrame) -> DataFrame:
    return painted.groupBy("file", "space").agg(F.count("*").alias("objects"))


def inventory(definitions: DataFrame, used: DataFrame) -> DataFrame:
    """(file, ink, name, kind, variants, objects, pages): inks that are defined (file, name) or painted, by normalised name.

    The name is the most used spelling, ties by the alphabet.
    """
    both = definitions.select("file", "name", F.lit(None).cast("int").alias("page"), F.lit(0).alias("n")).unionByName(used.select("file", "name", F.col("page").cast("int").alias("page"), F.lit(1).alias("n")))
    spelled = both.groupBy("file", normalized(F.col("name")).alias("ink"), "name").agg(F.sum("n").alias("n"), F.collect_set("page").alias("pages"))
    by = spelled.groupBy("file", "ink").agg(F.max_by("name", F.struct("n", F.transform(F.split("name", ""), lambda c: -F.ascii(c)))).alias("name"), F.array_sort(F.collect_set("name")).alias("variants"), F.sum("n").alias("objects"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    return by.withColumn("kind", kind_of(F.col("name")))


def duplicated(inks: DataFrame) -> DataFrame:
    return inks.where(F.size("variants") > 1)


def unused(inks: DataFrame) -> DataFrame:
    return inks.where((F.col("objects") == 0) & (F.col("kind") != "process"))


def rename_map(inks: DataFrame) -> DataFrame:
    """(file, old, new) of the spellings that are not the canonical name."""
    return duplicated(inks).select("file", F.explode("variants").alias("old"), F.col("name").alias("new")).where("old <> new")


def renamed(definitions: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions (file, name, ...) with the names of a mapping (old, new) by normalised name, and changes by file."""
    m = mapping.select(normalized(F.col("old")).alias("_k"), F.col("new").alias("_new")).groupBy("_k").agg(F.min("_new").alias("_new"))
    joined = definitions.withColumn("_k", normalized(F.col("name"))).join(m, "_k", "left")
    out = joined.withColumn("_changed", F.coalesce(F.col("_new") != F.col("name"), F.lit(False))).withColumn("name", F.coalesce("_new", "name"))
    return out.drop("_k", "_new", "_changed"), out.groupBy("file").agg(F.count_if("_changed").alias("changed"))


def without_unused(definitions: DataFrame, used: DataFrame, only: list[str] | None = None, keep: tuple[str, ...] = ("ALL", "NONE", "[REGISTRATION]", "[NONE]")) -> DataFrame:
    """Definitions (file, name) that something paints with; registration and none stay, process inks too, and what is not in `only`."""
    d = definitions.withColumn("_ink", normalized(F.col("name")))
    stay = d.where(F.col("_ink").isin(list(keep)) | (kind_of(F.col("name")) == "process") | (~F.col("_ink").isin(only) if only else F.lit(False)))
    rest = d.where(~(F.col("_ink").isin(list(keep)) | (kind_of(F.col("name")) == "process") | (~F.col("_ink").isin(only) if only else F.lit(False))))
    live = used.select("file", F.col("ink").alias("_ink")).distinct()
    return stay.unionByName(rest.join(live, ["file", "_ink"], "left_semi").select(*rest.columns)).drop("_ink")


def to_process(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Objects (file, id, name, tint) with the process values of their ink (name, c, m, y, k) times the tint; others keep their name.

    A linear tint, the usual function of a spot ink; `converted` tells.
    """
    v = values.select(normalized(F.col("name")).alias("_k"), *(F.col(i).alias(f"_{i}_") for i in "cmyk"))
    joined = objects.withColumn("_k", normalized(F.col("name"))).join(v, "_k", "left")
    held = {i: F.when(F.col(f"_{i}_").isNotNull(), F.least(F.greatest(F.col(f"_{i}_") * F.col("tint"), F.lit(0.0)), F.lit(1.0))) for i in "cmyk"}
    return joined.withColumns(held | {"converted": F.col("_c_").isNotNull()}).drop("_k", *(f"_{i}_" for i in "cmyk"))


def edited(definitions: DataFrame, objects: DataFrame, rename: DataFrame | None = None, convert: DataFrame | None = None, delete_unused: bool = False) -> tuple[DataFrame, DataFrame]:
    """(definitions, objects) after an edit script: convert, then rename, then delete what nothing uses; the input stays as it is."""
    if convert is not None:
        objects = to_process(objects, convert)
    if rename is not None:
        definitions, objects = renamed(definitions, rename)[0], renamed(objects, rename)[0]
    if delete_unused:
        live = objects.where(~F.col("converted")) if "converted" in objects.columns else objects
        definitions = without_unused(definitions, live.select("file", normalized(F.col("name")).alias("ink")))
    return definitions, objects


def plate_changes(before: DataFrame, after: DataFrame, touched: list[str]) -> DataFrame:
    """(ink, percent): mean difference of plates (ink, x, y, cov) of inks that were not to change."""
    a, b = before.where(~F.upper("ink").isin([t.upper() for t in touched])), after.select("ink", "x", "y", F.col("cov").alias("now"))
    return a.join(b, ["ink", "x", "y"]).groupBy("ink").agg(F.round(F.avg(F.abs(F.col("cov") - F.col("now"))) / 255 * 100, 4).alias("percent"))


def deduplicated(inks: DataFrame, pos: str = "pos") -> DataFrame:
    """One row of each normalised name: the first that has a Lab, else the first."""
    keyed = inks.withColumn("ink", normalized(F.col("name")))
    rest = [c for c in keyed.columns if c != "ink"]
    by = keyed.groupBy("ink").agg(F.min_by(F.struct(*rest), F.struct(F.col("L").isNull(), F.col(pos))).alias("r"))
    return by.select("ink", *(F.col(f"r.{c}").alias(c) for c in rest))


def looked_up(names: DataFrame, libraries: DataFrame) -> DataFrame:
    """`names` (name) with the ink of the first library (rank, pos) that has it, null without."""
    keyed = libraries.withColumn("_k", normalized(F.col("name")))
    rest = [c for c in libraries.columns if c != "name"]
    first = keyed.groupBy("_k").agg(F.min_by(F.struct(*rest), F.struct("rank", "pos")).alias("found"))
    return names.withColumn("_k", normalized(F.col("name"))).join(first, "_k", "left").drop("_k")


def spots(document: DataFrame) -> DataFrame:
    """Spot inks of documents' swatches (file, name, kind)."""
    return document.where("kind = 'spot'").select("file", "name").distinct()


def selected(items: DataFrame, limit: int = 20_000) -> DataFrame:
    """(file, selected, examined, truncated): items (file, seq, hits, locked, hidden) that meet a box, of the first `limit`.

    A limit is the feature here: an editor looks at so many items and says if there are more.
    """
    w = Window.partitionBy("file").orderBy("seq")
    ranked = items.withColumn("_k", F.row_number().over(w))
    seen = F.col("_k") <= limit
    return ranked.groupBy("file").agg(F.count_if(seen & F.col("hits") & ~F.col("locked") & ~F.col("hidden")).alias("selected"), F.count_if(seen).alias("examined"), (F.count("*") > limit).alias("truncated"))


def overprinted(items: DataFrame, names: list[str], dry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items (file, id, fill_spot, stroke_spot, fill_over, stroke_over) with overprint on the listed inks, and how many; `dry` only counts."""
    wanted = lambda c: F.coalesce(normalized(F.col(c)).isin([n.upper() for n in names]) & F.col(c).isNotNull(), F.lit(False))
    fill, stroke = wanted("fill_spot"), wanted("stroke_spot")
    counts = items.groupBy("file").agg(F.count_if(fill | stroke).alias("objects"))
    if dry:
        return items, counts
    return items.withColumns({"fill_over": F.col("fill_over") | fill, "stroke_over": F.col("stroke_over") | stroke}), counts


def rich_black(c: Column, m: Column, y: Column, k: Column, pt: Column, most: float = 12.0) -> Column:
    """Black text below a size with more than a little of the coloured inks."""
    return (k > 85) & (c + m + y > 30) & (pt < most)


def black_text(texts: DataFrame, most: float = 12.0) -> DataFrame:
    """Texts (c, m, y, k, pt, overprint): rich black becomes pure and overprints."""
    rich = rich_black(*(F.col(i) for i in "cmyk"), F.col("pt"), most)
    return texts.withColumns({i: F.when(rich, 100.0 if i == "k" else 0.0).otherwise(F.col(i)) for i in "cmyk"} | {"overprint": F.col("overprint") | rich})


def spots_merged(items: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (file, id, fill_spot, stroke_spot) with duplicates' canonical names, and changes by file."""
    m = mapping.select(normalized(F.col("old")).alias("_k"), F.col("new").alias("_new")).groupBy("_k").agg(F.min("_new").alias("_new"))
    out = items
    for side in ("fill_spot", "stroke_spot"):
        out = out.withColumn("_k", normalized(F.col(side))).join(m, "_k", "left").withColumn(f"_c_{side}", F.coalesce(F.col("_new") != F.col(side), F.lit(False))).withColumn(side, F.coalesce("_new", side)).drop("_k", "_new")
    changes = out.groupBy("file").agg(F.sum(F.col("_c_fill_spot").cast("int") + F.col("_c_stroke_spot").cast("int")).alias("objects"))
    return out.drop("_c_fill_spot", "_c_stroke_spot"), changes
