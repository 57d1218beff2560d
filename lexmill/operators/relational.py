"""Lookups with explicit ambiguity, containment joins, bags, and history-keeping changes."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def unique_or_nothing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key only they have."""
    only = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    return rows.join(only, keys, "left_semi")


def by_precedence(tables: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """One value a key, from the first table that has it, and of several there the least: partial aggregation, no window."""
    ranked = [t.select(*keys, value).withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)]
    best = reduce(DataFrame.unionByName, ranked).groupBy(*keys).agg(F.min(F.struct("__rank", value)).alias("__best"))
    return best.select(*keys, F.col("__best")[value].alias(value), F.col("__best.__rank").alias("source"))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same key, the last."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def tiered_lookup(rows: DataFrame, table: DataFrame, tiers: list[list[str]], value: str, row_key: list[str]) -> DataFrame:
    """For each row, the candidates of the first tier of keys that has any: status, value (only if there is just one) and tier."""
    found = None
    for i, keys in enumerate(tiers):
        hit = rows.join(table.select(*keys, F.col(value).alias("__v")), keys).select(*[rows[c] if c not in keys else F.col(c) for c in row_key], F.lit(i).alias("__tier"), "__v")
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(*row_key, "__tier").agg(F.countDistinct("__v").alias("n"), F.min("__v").alias("__v"))
    best = best.groupBy(*row_key).agg(F.min_by(F.struct("__tier", "n", "__v"), "__tier").alias("b"))
    out = rows.select(*row_key).distinct().join(best, row_key, "left")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("b.n") > 1, "ambiguous").otherwise("found")
    return out.select(*row_key, status.alias("status"), F.when(status == "found", F.col("b.__v")).alias(value), F.col("b.__tier").alias("tier"))


def contained_in(outer: DataFrame, inner: DataFrame, equal: list[str], prefix: list[str]) -> DataFrame:
    """Pairs of rows where the outer key holds the inner: equal on `equal`, and each of `prefix` equal or null in outer.

    Any part of an outer key may be null: article 5, inciso II without a paragraph holds the inciso of each paragraph. Outer
    keys with the same parts set join by equality on those, one hash join for each set that occurs (few), instead of a
    comparison of all pairs.
    """
    outer = outer.withColumn("__mask", sum((F.when(F.col(f"o_{p}").isNotNull(), 1 << i).otherwise(0) for i, p in enumerate(prefix)), F.lit(0)))
    out = None
    for mask in sorted(r[0] for r in outer.select("__mask").distinct().collect()) or [0]:
        on = [F.col(f"o_{k}") == F.col(f"i_{k}") for k in [*equal, *(p for i, p in enumerate(prefix) if mask >> i & 1)]]
        hit = outer.where(F.col("__mask") == mask).drop("__mask").join(inner, reduce(lambda a, b: a & b, on))
        out = hit if out is None else out.unionByName(hit)
    return out


def overlapping_keys(ops: DataFrame, equal: list[str], prefix: list[str]) -> DataFrame:
    """Pairs (a_id < b_id) of operations on the same key, or where one has its subtree in scope and contains the other."""
    side = lambda x: ops.select(*[F.col(c).alias(f"{x}_{c}") for c in ops.columns])
    hit = contained_in(side("o"), side("i"), equal, prefix).where("o_id != i_id")
    same = reduce(lambda a, b: a & b, [F.col(f"o_{p}").eqNullSafe(F.col(f"i_{p}")) for p in prefix])
    hit = hit.where(same | (F.col("o_scope") == "subtree"))
    return hit.select(F.least("o_id", "i_id").alias("a_id"), F.greatest("o_id", "i_id").alias("b_id")).distinct()


def bag(rows: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias(name))


def bag_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Where two bags differ: the keys with both counts."""
    both = bag(left, keys, "n_left").join(bag(right, keys, "n_right"), keys, "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_left", "n_right")})
    return both.where("n_left != n_right")


def first_failing(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The code of the first rule that a row breaks."""
    out = F.when(rules[0][1], rules[0][0])
    for code, test in rules[1:]:
        out = out.when(test, code)
    return out.otherwise(otherwise)


def fill_single_valued(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A missing value is filled if all rows of the key that have one agree."""
    known = rows.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    out = rows.join(known, keys, "left")
    return out.withColumn(name, F.coalesce(value, F.when(F.col("__low") == F.col("__high"), F.col("__low")))).drop("__low", "__high")


def apply_changes(current: DataFrame, changes: DataFrame, key: str, text: str, effects: str) -> DataFrame:
    """All wordings of each key with the days they hold: (key, text, effects, until, current). A revocation is a wording of null."""
    every = current.select(key, text, effects).unionByName(changes.select(key, text, effects))
    later = F.lead(effects).over(Window.partitionBy(key).orderBy(effects))
    return every.withColumn("until", F.date_sub(later, 1)).withColumn("is_current", later.isNull() & F.col(text).isNotNull())


def closure(edges: DataFrame, start: str, end: str, most: int | None = None) -> DataFrame:
    """All (start, end) that links join, or only up to `most` links, with the fewest links.

    A round doubles the depth reached, d: a shortest way of d + k links, k up to d, has a node after d links, so the pairs exactly
    d apart are joined to all that are up to d apart. Where no pair is exactly d apart, none is farther.
    """
    spark: SparkSession = edges.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        conf = sc.getConf().get("spark.checkpoint.dir")
        if not conf and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="lexmill-checkpoint-"))
    links = edges.select(F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    reached = links.withColumn("depth", F.lit(1)).checkpoint()
    depth, front = 1, reached
    while (most is None or depth < most) and not front.isEmpty():
        step = front.select("s", F.col("e").alias("m")).join(reached.select(F.col("s").alias("m"), "e", F.col("depth").alias("k")), "m")
        step = step.groupBy("s", "e").agg((F.min("k") + depth).alias("depth"))
        if most is not None:
            step = step.where(F.col("depth") <= most)
        found = step.join(reached, ["s", "e"], "left_anti").checkpoint()
        depth *= 2
        front = found.where(F.col("depth") == depth)
        reached = reached.unionByName(found)
    return reached
