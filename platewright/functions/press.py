"""Press profiles: register tolerance, trap widths, and which profile a job gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tolerance in millimetres of a process without a profile.
DEFAULT_TOLERANCE = {"serigrafia": 0.20, "flexo": 0.15, "offset": 0.08, "digital": 0.0}


def tolerance_ok(values: Column) -> Column:
    """One or two numbers from 0 to 5."""
    return F.size(values).isin(1, 2) & F.forall(values, lambda v: v.between(0, 5))


def tolerance_xy(values: Column) -> Column:
    return F.struct(F.element_at(values, 1).alias("x"), F.element_at(values, -1).alias("y"))


def trap_xy(values: Column, factor: Column) -> Column:
    return F.struct((F.element_at(values, 1) * factor).alias("x"), (F.element_at(values, -1) * factor).alias("y"))


def trap_mm(values: Column, factor: Column) -> Column:
    return F.array_max(values) * factor


def choke_mm(values: Column, own: Column) -> Column:
    """A profile's own choke (or pull-back), else its greatest tolerance."""
    return F.coalesce(own, F.array_max(values))


def resolved(jobs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Jobs (job, profile, process, tolerance) with the profile that counts.

    A named profile of `profiles` (id, process, tolerance array, factor); without a name the defaults of
    the process; then the job's own tolerance.  A named profile that does not exist is a `problem`.
    """
    known = profiles.select(F.col("id").alias("profile"), F.col("process").alias("_process"), F.col("tolerance").alias("_tolerance"), F.col("factor").alias("_factor"))
    joined = jobs.join(known, "profile", "left")
    table = F.create_map(*(F.lit(x) for kv in DEFAULT_TOLERANCE.items() for x in kv))
    process = F.when(F.col("profile").isNotNull(), F.col("_process")).otherwise(F.coalesce("process", F.lit("serigrafia")))
    default = F.array(F.coalesce(F.try_element_at(table, process), F.lit(0.2)))
    held = F.when(F.col("profile").isNotNull(), F.col("_tolerance")).otherwise(default)
    return joined.select(
        "job", process.alias("process"), F.coalesce(F.when(F.col("tolerance").isNotNull(), F.array("tolerance")), held).alias("tolerance"),
        F.coalesce("_factor", F.lit(1.0)).alias("factor"), F.when(F.col("profile").isNotNull() & F.col("_process").isNull(), "no such profile").alias("problem"))
