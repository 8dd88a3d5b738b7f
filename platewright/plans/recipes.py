"""Recipes: named steps over files, as a chain of DataFrame transforms with a state for each file.

A file's row has `state` (ok, stopped, error), `reason` and `log`.  A step changes rows that are still ok;
it stops them where a condition of the recipe holds and fails them where it cannot run.  Files never
fail each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECIPE = "recipe string, name string, steps array<struct<module:string,action:string,params:map<string,string>>>"


@dataclass
class Step:
    """A step of the catalogue: what kind of file it needs (null: any), its parameters with defaults, and what it does."""

    needs: str | None
    params: dict[str, Any]
    apply: Callable[[DataFrame, dict[str, Any]], DataFrame]
    about: str = ""


CATALOG: dict[str, Step] = {}


def step(name: str, needs: str | None = None, about: str = "", **params: Any):
    def add(f: Callable[..., DataFrame]):
        CATALOG[name] = Step(needs, params, f, about)
        return f

    return add


def started(files: DataFrame) -> DataFrame:
    """Files (file, kind, ...) ready for a recipe."""
    return files.withColumns({"state": F.lit("ok"), "reason": F.lit(None).cast("string"), "log": F.array().cast("array<string>")})


def ended(files: DataFrame, test: Column, state: str, reason: Column) -> DataFrame:
    """Files that are ok and fulfil `test` end with a state and a reason."""
    hit = (F.col("state") == "ok") & F.coalesce(test, F.lit(False))
    return files.withColumns({"state": F.when(hit, state).otherwise(F.col("state")), "reason": F.when(hit, reason).otherwise(F.col("reason"))})


def said(files: DataFrame, message: Column) -> DataFrame:
    return files.withColumn("log", F.when(F.col("state") == "ok", F.concat("log", F.array(message))).otherwise(F.col("log")))


def changed(files: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return files.withColumns({k: F.when(F.col("state") == "ok", v).otherwise(F.col(k)) for k, v in columns.items()})


# ---------------------------------------------------------------- steps


@step("preflight", "pdf", "check with a rule profile", profile="offset", stop_on_errors=True, stop_on_warnings=False)
def _preflight(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    out = said(files, F.format_string("checked: %d errors, %d warnings", "errors", "warnings"))
    if p["stop_on_errors"]:
        out = ended(out, F.col("errors") > 0, "stopped", F.format_string("%d errors", "errors"))
    return ended(out, F.col("warnings") > 0, "stopped", F.format_string("%d warnings", "warnings")) if p["stop_on_warnings"] else out


@step("preflight.fix", "pdf", "apply safe fixes", annotations=True, merge_inks=True)
def _fix(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    out = files
    if p["annotations"]:
        out = said(changed(out, {"warnings": F.greatest(F.col("warnings") - F.col("annotations"), F.lit(0)), "annotations": F.lit(0)}), F.lit("annotations removed"))
    return _merge(out, {}) if p["merge_inks"] else out


@step("separate.merge_duplicates", "pdf", "one name for each ink")
def _merge(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    return changed(said(files, F.format_string("%d ink names merged", F.greatest(F.col("names") - F.col("inks"), F.lit(0)))), {"names": F.col("inks")})


@step("separate.delete_unused", "pdf", "definitions without a use go")
def _delete(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    return changed(said(files, F.format_string("%d unused inks deleted", "unused")), {"inks": F.col("inks") - F.col("unused"), "names": F.least("names", F.col("inks") - F.col("unused")), "unused": F.lit(0)})


@step("separate.to_process", "pdf", "spot inks as process values", inks=None)
def _to_process(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    out = ended(files, F.lit(not p["inks"]), "error", F.lit("no inks are named"))
    n = len(p["inks"].split(",")) if p["inks"] else 0
    return changed(said(out, F.lit(f"{n} inks converted")), {"inks": F.greatest(F.col("inks") - n, F.lit(0))})


@step("trap.auto", "pdf", "trap with a press profile", press="screen", tolerance_mm=0.2, stop_on_gaps=False)
def _trap(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    # a trap as wide as the tolerance covers every gap of that movement
    out = changed(said(files, F.format_string("trapped, %d gaps before", "gaps")), {"gaps": F.when(F.lit(float(p["tolerance_mm"])) > 0, 0).otherwise(F.col("gaps"))})
    return ended(out, F.col("gaps") > 0, "stopped", F.lit("gaps remain")) if p["stop_on_gaps"] else out


@step("trap.movement_test", "pdf", "gaps under movement", press="screen", tolerance_mm=0.2, stop_on_gaps=True)
def _movement(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    out = said(files, F.format_string("%d gaps", "gaps"))
    return ended(out, F.col("gaps") > 0, "stopped", F.format_string("%d gaps", "gaps")) if p["stop_on_gaps"] else out


@step("tools.distortion", "pdf", "shorten one side", pct=None, k=None, repeat=None, direction="vertical")
def _distort(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    pct = float(p["pct"]) if p["pct"] is not None else 628.318530718 * float(p["k"]) / float(p["repeat"]) if p["k"] and p["repeat"] else None
    out = ended(files, F.lit(pct is None or not 0 <= pct < 20), "error", F.lit("no distortion, or out of range"))
    side = "height" if p["direction"] == "vertical" else "width"
    return changed(said(out, F.lit(f"distorted by {pct or 0:.2f} %")), {side: F.col(side) * (1 - (pct or 0) / 100)})


@step("tools.step_repeat", "pdf", "repeat on a sheet", sheet_w=300.0, sheet_h=200.0, gap_x=3.0, gap_y=3.0, margin=10.0)
def _step_repeat(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    from platewright.operators.layout import fitting

    n = lambda sheet, side, gap: fitting(F.lit(float(p[sheet])), F.col(side), F.lit(float(p[gap])), F.lit(float(p["margin"])), F.lit(float(p["margin"])))
    cells = n("sheet_w", "width", "gap_x") * n("sheet_h", "height", "gap_y")
    out = ended(files, cells == 0, "error", F.lit("nothing fits on the sheet"))
    return said(out, F.format_string("%d cells", cells.cast("long")))


@step("report", None, "write the log")
def _report(files: DataFrame, p: dict[str, Any]) -> DataFrame:
    return said(files, F.lit("report written"))


def catalog(spark: SparkSession) -> DataFrame:
    """(step, needs, about, params map of defaults)."""
    rows = [(k, s.needs, s.about, {n: None if v is None else str(v) for n, v in s.params.items()}) for k, s in CATALOG.items()]
    return spark.createDataFrame(rows, "step string, needs string, about string, params map<string,string>")


# ---------------------------------------------------------------- validation


def key_of(module: Column, action: Column) -> Column:
    """`module.action`, or the action alone if it has a point or there is no module."""
    a, m = F.trim(F.coalesce(action, F.lit(""))), F.trim(F.coalesce(module, F.lit("")))
    return F.when(a.contains(".") | (m == ""), a).otherwise(F.concat_ws(".", m, a))


def problems(recipes: DataFrame) -> DataFrame:
    """(recipe, pos, problem) of what is wrong with recipes (RECIPE): no name, no steps, unknown steps and parameters."""
    whole = recipes.select("recipe", F.explode(F.array_compact(F.array(F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "no name"), F.when(F.coalesce(F.size("steps"), F.lit(0)) <= 0, "no steps")))).alias("problem"))
    steps = recipes.select("recipe", F.posexplode("steps").alias("pos", "s")).select("recipe", F.col("pos") + 1, key_of(F.col("s.module"), F.col("s.action")).alias("key"), F.col("s.params").alias("params")).toDF("recipe", "pos", "key", "params")
    known = catalog(recipes.sparkSession).select(F.col("step").alias("key"), F.map_keys("params").alias("allowed"))
    joined = steps.join(F.broadcast(known), "key", "left")  # the catalogue
    unknown = joined.where("allowed is null").select("recipe", "pos", F.concat(F.lit("no such step: "), "key").alias("problem"))
    extra = joined.where("allowed is not null").select("recipe", "pos", F.explode(F.array_except(F.coalesce(F.map_keys("params"), F.array().cast("array<string>")), "allowed")).alias("p"))
    return whole.select("recipe", F.lit(0).alias("pos"), "problem").unionByName(unknown).unionByName(extra.select("recipe", "pos", F.concat(F.lit("no such parameter: "), "p").alias("problem")))


def stored(recipes: DataFrame, new: DataFrame) -> DataFrame:
    """Recipes with valid new ones in place of those of their id."""
    good = new.join(problems(new).select("recipe").distinct(), "recipe", "left_anti").where(F.col("recipe").rlike(r"^[\w\- ]{1,60}$"))
    return recipes.join(good.select("recipe"), "recipe", "left_anti").unionByName(good)


# ---------------------------------------------------------------- runs


@dataclass
class Recipe:
    name: str
    steps: list[tuple[str, dict[str, Any]]] = field(default_factory=list)

    def problems(self) -> list[str]:
        out = [] if self.name.strip() else ["no name"]
        out += [] if self.steps else ["no steps"]
        for key, params in self.steps:
            out += [f"no such step: {key}"] if key not in CATALOG else [f"no such parameter: {p}" for p in params if p not in CATALOG[key].params]
        return out


def run(recipe: Recipe, files: DataFrame) -> DataFrame:
    """Files after a recipe's steps; an invalid recipe is an error of every file."""
    out = started(files)
    if wrong := recipe.problems():
        return ended(out, F.lit(True), "error", F.lit("; ".join(wrong)))
    for key, params in recipe.steps:
        s = CATALOG[key]
        if s.needs:
            out = ended(out, F.col("kind") != s.needs, "error", F.concat(F.lit(f"{key} needs a {s.needs}, not a "), "kind"))
        out = s.apply(out, {**s.params, **params})
    return out


def routed(results: DataFrame) -> DataFrame:
    """Where a file's output goes: `output/<name>` if ok, else `errors`; its log always to `reports`."""
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    return results.withColumns({"target": F.when(F.col("state") == "ok", F.concat(F.lit("output/"), stem)).otherwise("errors"), "log_file": F.concat(F.lit("reports/"), stem, F.lit(".txt"))})


def outcome(results: DataFrame) -> DataFrame:
    """One row: files, ok, stopped, error."""
    return results.agg(F.count("*").alias("files"), *(F.count_if(F.col("state") == s).alias(s) for s in ("ok", "stopped", "error")))


def summary_lines(results: DataFrame) -> DataFrame:
    """(file, line) of a batch summary, without logs."""
    return results.select("file", F.concat_ws(" - ", F.concat_ws(": ", F.concat(F.lit("- "), "file"), "state"), "reason").alias("line"))
