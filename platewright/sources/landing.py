"""Readers: golden cases (JSON), ink libraries (text, XML, swatch binary, JSON), measurements, landing zones.

Readers keep what they cannot use: a line or object without a usable colour comes with its `problem`.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewright.functions.names import KINDS, kind_of

CASES = "caso string, tipo string, variante string, cliente string, diseno string, pagina_cliente int, pagina_diseno int, errores array<struct<categoria:string,bbox:array<int>,subtipo:string,cliente_dice:string,diseno_dice:string,delta_e:double>>, texto_cliente string, notas string"
# File types that are taken.
ALLOWED = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff", ".pdf"]
INKS = "name string, kind string, L double, a double, b double, opacity double, source string, line int, problem string"


def cases(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """One row a case with its folder; the schema is given, never inferred; `only` is a part of the folder's name."""
    rows = spark.read.schema(CASES).option("multiLine", True).option("recursiveFileLookup", True).json(path).withColumn("folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    return rows.where(F.contains("folder", F.lit(only))) if only else rows


def number(text: Column) -> Column:
    """A number with point or comma; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def _ranged(L: Column, a: Column, b: Column) -> Column:
    return L.between(0, 100) & a.between(-200, 200) & b.between(-200, 200)


def ink_lines(lines: DataFrame) -> DataFrame:
    """INKS rows of text lines (source, line, value): name, L, a, b[, kind][, opacity].

    A file's separator is that of its first line with text: semicolon, tab or comma.  Comments, empty lines
    and a heading in line 1 are left out; other lines without a colour keep a problem.
    """
    first = lines.where("trim(value) <> ''").groupBy("source").agg(F.min_by("value", "line").alias("_f"))
    separator = F.when(F.contains("_f", F.lit(";")), ";").when(F.contains("_f", F.lit("\t")), "\t").otherwise(",")
    cut = lines.join(first, "source").withColumn("_p", F.transform(F.split(F.regexp_replace("value", "^﻿", ""), separator), lambda v: F.trim(v)))
    at = lambda i: F.nullif(F.get("_p", F.lit(i)), F.lit(""))
    rows = cut.where(at(0).isNotNull() & ~at(0).startswith("#")).select("source", "line", at(0).alias("name"), *(number(at(i + 1)).alias(c) for i, c in enumerate(("L", "a", "b"))), F.lower(at(4)).alias("_k"), number(at(5)).alias("_o"), (F.size("_p") < 4).alias("_few"))
    none = F.col("L").isNull() | F.col("a").isNull() | F.col("b").isNull()
    rows = rows.where(~(none & ~F.col("_few") & (F.col("line") == 1)))
    problem = F.when(F.col("_few"), "columns are missing").when(none, "no numbers").when(~_ranged(F.col("L"), F.col("a"), F.col("b")), "Lab out of range")
    kind = F.when(F.col("_k").isin(KINDS), F.col("_k")).otherwise(kind_of(F.col("name")))
    opacity = F.least(F.greatest(F.coalesce("_o", F.when(kind == "white", 1.0).otherwise(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.select("name", kind.alias("kind"), "L", "a", "b", opacity.alias("opacity"), "source", F.col("line").cast("int").alias("line"), problem.alias("problem"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # libraries are small files: each is one row, and its lines are numbered by an array
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return whole.withColumn("line", F.col("line") + 1)


def ink_text(spark: SparkSession, path: str) -> DataFrame:
    return ink_lines(_lines(spark, path))


def inks(spark: SparkSession, path: str) -> DataFrame:
    """Usable inks of text libraries."""
    return ink_text(spark, path).where("problem is null")


def ink_xml(spark: SparkSession, path: str, row: str = "cc:Object") -> DataFrame:
    """INKS rows of the objects of an XML colour exchange file that have a Lab colour; prefixes as in the file."""
    prefix = row.split(":")[0] + ":" if ":" in row else ""
    lab = f"struct<`{prefix}L`:string,`{prefix}A`:string,`{prefix}B`:string>"
    schema = f"_Name string, _Id string, `{prefix}ColorValues` struct<`{prefix}ColorCIELab`:{lab}>"
    rows = spark.read.format("xml").schema(schema).option("rowTag", row).load(path)
    at = lambda c: number(F.col(f"`{prefix}ColorValues`.`{prefix}ColorCIELab`.`{prefix}{c}`"))
    made = rows.select(F.coalesce("_Name", "_Id").alias("name"), at("L").alias("L"), at("A").alias("a"), at("B").alias("b")).where("name is not null and L is not null and a is not null and b is not null")
    return made.select("name", kind_of(F.col("name")).alias("kind"), "L", "a", "b", F.when(kind_of(F.col("name")) == "white", 1.0).otherwise(0.0).alias("opacity"), F.lit("xml").alias("source"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("problem"))


SWATCH = "source string, name string, model string, v array<double>, spot boolean"


def swatches(files: DataFrame) -> DataFrame:
    """SWATCH rows of binary swatch files (path, content): big-endian blocks, colour models LAB, RGB, CMYK and Gray."""

    def blocks(data: bytes) -> Iterator[tuple[str, str, list[float], bool]]:
        if data[:4] != b"ASEF":
            return
        (number_,), at = struct.unpack(">I", data[8:12]), 12
        for _ in range(number_):
            kind, size = struct.unpack(">HI", data[at : at + 6])
            body, at = data[at + 6 : at + 6 + size], at + 6 + size
            if kind == 1:
                (n,) = struct.unpack(">H", body[:2])
                model, rest = body[2 + 2 * n : 6 + 2 * n].decode("ascii", "replace").strip(), body[6 + 2 * n :]
                count = {"LAB": 3, "RGB": 3, "CMYK": 4, "Gray": 1}.get(model)
                if count:
                    values = list(struct.unpack(f">{count}f", rest[: 4 * count]))
                    if model == "LAB" and values[0] <= 1:
                        values[0] *= 100
                    yield body[2 : 2 + 2 * n].decode("utf-16-be").rstrip("\0"), model, values, struct.unpack(">H", body[-2:])[0] == 1

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf.path, pdf.content, strict=True):
                try:
                    rows += [(path, *b) for b in blocks(bytes(data))]
                except (struct.error, UnicodeDecodeError):
                    rows.append((path, None, "damaged", None, None))
            yield pd.DataFrame(rows, columns=["source", "name", "model", "v", "spot"])

    return files.select("path", "content").mapInPandas(parse, SWATCH)


def ink_swatches(spark: SparkSession, path: str) -> DataFrame:
    """INKS rows of swatch files: Lab as given, RGB and grey by way of sRGB, CMYK by mixing the process inks."""
    from platewright.functions import colour

    s = swatches(spark.read.format("binaryFile").load(path)).where("v is not null")
    v = lambda i: F.get("v", F.lit(i))
    grey = F.col("model") == "Gray"
    s = s.withColumns({"_r": v(0) * 255, "_g": F.when(grey, v(0)).otherwise(v(1)) * 255, "_b": F.when(grey, v(0)).otherwise(v(2)) * 255})
    s = colour.with_lab(s, "_r", "_g", "_b", "_s")
    process = [(55.0, -37.0, -50.0), (48.0, 74.0, -3.0), (89.0, -5.0, 93.0), (16.0, 0.0, 0.0)]  # Fixed values: Lab of the reference process inks
    inks_ = F.array(*(F.struct(F.lit(L).alias("L"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(0.0).alias("opacity"), F.coalesce(v(i), F.lit(0.0)).alias("cov")) for i, (L, a, b) in enumerate(process)))
    s = colour.with_mixture(s.withColumn("_inks", inks_), "_inks", prefix="_m")
    pick = lambda i, c: F.when(F.col("model") == "LAB", v(i)).when(F.col("model") == "CMYK", F.col(f"_m{c}")).otherwise(F.col(f"_s{c}"))
    process_name = F.upper(F.trim("name")).isin("CYAN", "MAGENTA", "YELLOW", "BLACK")
    kind = F.when(F.col("spot"), kind_of(F.col("name"))).when(process_name, "process").otherwise("spot")
    return s.select("name", kind.alias("kind"), pick(0, "L").alias("L"), pick(1, "a").alias("a"), pick(2, "b_").alias("b"), F.when(kind == "white", 1.0).otherwise(0.0).alias("opacity"), "source", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("problem"))


def ink_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("name string, kind string, L double, a double, b double, opacity double").json(path)
    return rows.withColumns({"source": F.lit("json"), "line": F.lit(None).cast("int"), "problem": F.lit(None).cast("string")})


def ink_library(spark: SparkSession, path: str) -> DataFrame:
    """INKS rows of a library by its suffix."""
    suffix = path.lower().rsplit(".", 1)[-1]
    readers = {"ase": ink_swatches, "cxf": ink_xml, "cxf3": ink_xml, "xml": ink_xml, "csv": ink_text, "txt": ink_text, "tsv": ink_text, "json": ink_json}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix}")
    return readers[suffix](spark, path)


def measurements(spark: SparkSession, path: str) -> DataFrame:
    """(id, ink, step, L, a, b, problem) of measured patches `ink|step`; the heading and patches without a value are left out."""
    rows = _lines(spark, path).where("line > 1")
    first = _lines(spark, path).where("line = 1").select("source", F.when(F.contains("value", F.lit(";")), ";").otherwise(",").alias("_s"))
    p = rows.join(first, "source").withColumn("_p", F.split("value", F.col("_s"))).where((F.size("_p") >= 4) & (F.trim(F.get("_p", F.lit(1))) != ""))
    lab = {c: number(F.get("_p", F.lit(i + 1))) for i, c in enumerate(("L", "a", "b"))}
    id_ = F.trim(F.get("_p", F.lit(0)))
    out = p.select(id_.alias("id"), F.element_at(F.split(id_, r"\|"), 1).alias("ink"), F.element_at(F.split(id_, r"\|"), -1).try_cast("int").alias("step"), *(v.alias(c) for c, v in lab.items()))
    return out.withColumn("problem", F.when(F.col("L").isNull() | F.col("a").isNull() | F.col("b").isNull(), "no numbers"))


def landing(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with name, size, time and digest; contents stay lazy."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", F.sha1("content").alias("digest"))


def validated(files: DataFrame, most_mb: float = 50.0, allowed: list[str] | None = None) -> DataFrame:
    """Adds `problem` to files (name, length): type, size, nothing in it."""
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    return files.withColumn("problem", F.when(~suffix.isin(allowed or ALLOWED), "file type").when(F.col("length") > most_mb * 1024 * 1024, "too large").when(F.col("length") == 0, "empty"))


def named(files: DataFrame, stem: str) -> DataFrame:
    """The first file, by name, whose name without suffix is `stem`."""
    return files.where(F.regexp_replace("name", r"\.[^.]*$", "") == stem).orderBy("name").limit(1)


def missing(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys that a cache does not hold."""
    return keys.join(cache.select("key"), "key", "left_anti")
