"""Operators over ordered rows: context, extents, states, islands and versions. `by` partitions and `order` orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AHEAD = (1, Window.unboundedFollowing)
_SO_FAR = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def fill_context(rows: DataFrame, by: list[str], order: list[str], level: str, number: str, levels: list[str]) -> DataFrame:
    """A column for each level with the number in force: a label of a level sets it and clears the deeper ones."""
    start = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_SO_FAR)
    for k, name in enumerate(levels):
        if k:
            rows = rows.withColumn(f"__g{k}", F.sum((F.col(level) < k).cast("int")).over(start))
        inside = Window.partitionBy(*by, *([f"__g{k}"] if k else [])).orderBy(*order).rowsBetween(*_SO_FAR)
        rows = rows.withColumn(name, F.last(F.when(F.col(level) == k, F.col(number)), ignorenulls=True).over(inside))
    return rows.drop(*(f"__g{k}" for k in range(1, len(levels))))


def next_not_deeper(rows: DataFrame, by: list[str], order: str, level: str, levels: int, name: str = "end") -> DataFrame:
    """The place of the next row of the same level or a higher one: where a provision ends; null to the end."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(*_AHEAD)
    cases = F.coalesce(*(F.when(F.col(level) == k, F.min(F.when(F.col(level) <= k, F.col(order))).over(ahead)) for k in range(levels)))
    return rows.withColumn(name, cases)


def inside_state(rows: DataFrame, by: list[str], order: list[str], opens: Column, closes: Column, name: str = "inside") -> DataFrame:
    """Whether a row opens, or the last event before it was an opening. Repeated openings and stray closings change nothing."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_BEFORE)
    last = F.last(F.when(closes, 0).when(opens, 1), ignorenulls=True).over(before)
    return rows.withColumn(name, opens | (F.coalesce(last, F.lit(0)) == 1))


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row that starts a run begins a new one."""
    return rows.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*_SO_FAR)).cast("long"))


def close_versions(rows: DataFrame, by: list[str], effects: str, name: str = "until") -> DataFrame:
    """Each version holds until the day before the next one of its key takes effect; the last has no end."""
    return rows.withColumn(name, F.date_sub(F.lead(effects).over(Window.partitionBy(*by).orderBy(effects)), 1))


def fill_from_next(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """A missing value comes from the next row that has one, else from the last."""
    ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_AHEAD)
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_BEFORE)
    return rows.withColumn(name, F.coalesce(value, F.first(value, ignorenulls=True).over(ahead), F.last(value, ignorenulls=True).over(before)))


def nearest_before(rows: DataFrame, events: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """The value of the last event before each row, within its key: one union and one window, so no pairs are made."""
    mixed = rows.withColumn("__event", F.lit(False)).unionByName(events.withColumn("__event", F.lit(True)), allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy(order, F.col("__event").asc()).rowsBetween(*_BEFORE)
    out = mixed.withColumn(name, F.last(F.when(F.col("__event"), F.col(value)), ignorenulls=True).over(before))
    return out.where(~F.col("__event")).drop("__event", *([value] if value not in rows.columns else []))


def votes(rows: DataFrame, by: list[str], order: list[Column], choice: Column, most: int) -> DataFrame:
    """The choice of a strict majority of the `most` latest rows of each key; null without one."""
    late = rows.withColumn("__choice", choice).withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= most)
    counted = late.groupBy(*by).agg(F.sum(F.col("__choice").cast("int")).alias("yes"), F.count(F.lit(1)).alias("n"))
    return counted.select(*by, F.col("n").cast("long").alias("n"), F.col("yes").cast("long").alias("yes"), (F.col("yes") * 2 > F.col("n")).alias("majority"))


def most_frequent(rows: DataFrame, by: list[str], value: str, order: str, name: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones, the first seen."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return counted.groupBy(*by).agg(F.max_by(value, F.struct(F.col("__n"), -F.col("__first"))).alias(name), F.max("__n").alias("n"))
