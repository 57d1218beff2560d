"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_words

#: Rows that a cell of one source and one range of keys holds on average, at most.
CELL_ROWS = 4096
EPOCHS = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in order of code points, null last, take the weights in turn and share `share` times all sizes by weight. No
    target passes `epochs` times its source's size: with the sources in order of cap / weight, the level that the capped
    ones leave to the rest rises while sources are capped and falls after, so its maximum is the final level. The windows
    run over one row a source; a source is a category of the corpus, so that is few rows, however many documents there are.
    """
    turn = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    ranked = (
        sizes.withColumn("__i", F.row_number().over(turn) - 1)
        .withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (F.col("__i") % len(weights) + 1).cast("int")).cast("double"))
        .withColumn("__cap", F.col("source_size") * F.lit(float(epochs)))
    )
    below = Window.orderBy(F.col("__cap") / F.col("__w"), "__i").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(below), F.lit(0.0))
    weight = F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(below), F.lit(0.0))
    return (
        ranked.withColumn("__level", left / weight)
        .withColumn("target", F.least("__cap", F.col("__w") * F.max("__level").over(every)))
        .select("source", "source_size", "target")
    )


def mix_sources(
    docs: DataFrame, size: Column, source: Column, key: list[Column], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
) -> DataFrame:
    """Adds __size, __source_size, __target and __taken (of the size, repeats counted) to every row.

    Rows get a hash-random key and stand in its order within their source. A source's budget gives each row as many whole
    epochs as fit; of the last epoch, rows are taken in order of the key up to the exact budget, so that the last one may be
    taken in part. Prefix sums are in two steps, so that no source lands in one task: sums of cells (source and range of
    keys) are added up over the cells of a source, and each row adds the rows before it in its own cell. The number of
    ranges grows with the rows.

    Nulls: a null source is a source of its own, the last; a null size is 0. Rows of equal keys are told apart by the size;
    rows that agree in that too are alike, so it makes no difference which of them comes first. Rows of size 0 take 0. An
    empty table gives an empty result.
    """
    # a null source as a flag beside an empty name, so that joins and windows agree on plain keys and share a shuffle
    group = ["__none", "__source"]
    rows = docs.withColumns(
        {"__size": F.coalesce(size, F.lit(0)).cast("long"), "__none": source.isNull(), "__source": F.coalesce(source, F.lit("")), "__key": F.md5(F.concat_ws(",", *key).cast("binary"))}
    )
    by_source = checkpoint(rows.groupBy(*group).agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__n")))
    most = by_source.agg(F.max("__n")).first()[0] or 1
    ranges = 1
    while ranges * CELL_ROWS < most:
        ranges *= 2
    # the upper 32 bits of the key: a range of equal width for each cell
    rows = rows.withColumn("__cell", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * ranges).cast("int"))
    cells = rows.groupBy(*group, "__cell").agg(F.sum("__size").alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*group, "__cell", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    targets = source_targets(by_source.select(F.when(~F.col("__none"), F.col("__source")).alias("source"), "source_size"), weights, share, epochs)
    targets = targets.select(
        F.col("source").isNull().alias("__none"), F.coalesce("source", F.lit("")).alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")
    )
    # one shuffle serves the join and the window: both go by source and cell
    placed = rows.join(cells.join(targets, group), [*group, "__cell"])
    inside = Window.partitionBy(*group, "__cell").orderBy("__key", *key, "__size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__offset") + F.coalesce(F.sum("__size").over(inside), F.lit(0))
    budget = F.floor(F.col("__target") + 1e-6).cast("long")
    whole = F.when(F.col("__source_size") > 0, F.floor(budget / F.greatest(F.col("__source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = F.col("__budget") - F.col("__whole") * F.col("__source_size")
    taken = F.col("__whole") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), rest - F.col("__start")))
    return (
        placed.withColumn("__start", start)
        .withColumns({"__budget": budget, "__whole": whole})
        .withColumn("__taken", taken.cast("long"))
        .drop(*group, "__key", "__cell", "__offset", "__start", "__budget", "__whole")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix of documents by words: doc_id, size, source_size, target, taken. The text is measured in the scan and not shuffled."""
    lean = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix_sources(lean, F.col("size"), F.col("source"), [F.col("doc_id")])
    return out.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves, with their columns: one row for each epoch that takes words of a document.

    The document that a budget ends in stays whole, so a source passes its budget by less than one document.
    """
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    out = mix_sources(rows, F.col("size"), F.col("source"), [F.col("doc_id")])
    copies = F.ceil(F.col("__taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return out.where("__taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*")


#: What mix_documents gives, for another engine.
SQL = f"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, '')) as key from documents
), sources as (
  select source, sum(size)::bigint as s, row_number() over (order by source nulls last) - 1 as i from rows group by source
), weighed as (
  select source, s, i, ([{", ".join(f"{w}.0::double" for w in WEIGHTS)}])[i % {len(WEIGHTS)} + 1] as w, {EPOCHS}.0::double * s as cap from sources
), levels as (
  select source, s, w, cap, (sum(s) over () * {SHARE}::double - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from weighed window before as (order by cap / w, i rows between unbounded preceding and 1 preceding)
), targets as (
  select source, s, least(cap, w * max(level) over ()) as target from levels
), placed as (
  select r.doc_id, r.size, t.s, t.target, floor(t.target + 1e-6)::bigint as budget,
    coalesce(sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from rows r join targets t on r.source is not distinct from t.source
)
select doc_id, size, s as source_size, target::double as target,
  (case when s > 0 then budget // greatest(s, 1) else 0 end * size + greatest(0, least(size, budget - case when s > 0 then budget // greatest(s, 1) else 0 end * s - start)))::bigint as taken
from placed
"""
