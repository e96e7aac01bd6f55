"""Running sums that do not gather a partition in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SPAN = 1 << 14


def running_sum(df: DataFrame, by: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: the sum of value over the rows of its group before this one (order: a unique integer column).

    Rows are summed within runs of ``span`` order values; one row a run then gets the sum of the runs before it.
    """
    tagged = df.withColumn("_run", F.floor(F.col(order) / span)).withColumn("_value", value.cast("bigint"))
    runs = tagged.groupBy(*by, "_run").agg(F.sum("_value").alias("_total"))
    ahead = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_run").alias("_run2"), F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    joined = tagged.join(runs, [F.col("_run") == F.col("_run2"), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)])
    inside = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined.withColumn(name, (F.col("_ahead") + F.coalesce(F.sum("_value").over(inside), F.lit(0))).cast("bigint"))
    return out.drop("_run", "_run2", "_value", "_ahead", *(f"_by_{c}" for c in by))


def ranked(df: DataFrame, by: list[str], run: Column, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in its group from 1, in the order of ``order``.

    ``run`` divides a group into runs that follow each other in that order; no task gets more than a run and the groups' run counts."""
    tagged = df.withColumn("_run", run)
    runs = tagged.groupBy(*by, "_run").agg(F.count("*").alias("_total"))
    ahead = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_run").alias("_run2"), F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    joined = tagged.join(runs, [F.col("_run").eqNullSafe(F.col("_run2")), *(F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by)])
    place = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order))
    return joined.withColumn(name, F.col("_ahead") + place).drop("_run", "_run2", "_ahead", *(f"_by_{c}" for c in by))
