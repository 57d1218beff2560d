"""Joins and sums over boxes on pages: words to cells, letters to letters, lines above, coverage, rows of words, reading order.

Boxes have x0, top, x1, bottom, in points from the upper left. Joins have the page as their equality, so a page is the unit
of work and no pairs of pages are made; sides bring their columns under the names given.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points by which a box is widened for what lies on its edge.
EDGE = 0.15


def words_inside(words: DataFrame, boxes: DataFrame, page: list[str], box: str, band: float = 200.0) -> DataFrame:
    """(words' columns, box) for each word whose middle is in a box of its page and whose top is between the box's edges.

    Boxes are filed under each band of height that they reach, and a word looks in its own band only, so that a long page
    compares a word with few boxes.
    """
    at = lambda y: F.floor(y / F.lit(band)).cast("long")
    filed = boxes.select(*page, F.col(box), *(F.col(c).alias(f"__{c}") for c in ("x0", "top", "x1", "bottom")))
    filed = filed.withColumn("__band", F.explode(F.sequence(at(F.col("__top") - EDGE), at(F.col("__bottom") + EDGE))))
    mid = (F.col("x0") + F.col("x1")) / 2
    inside = (F.col("top") >= F.col("__top") - EDGE) & (F.col("top") < F.col("__bottom") + EDGE) & (mid >= F.col("__x0") - EDGE) & (mid < F.col("__x1") + EDGE)
    return words.withColumn("__band", at(F.col("top"))).join(filed, [*page, "__band"]).where(inside).select(*[F.col(c) for c in words.columns], box)


def cell_text(words: DataFrame, boxes: DataFrame, page: list[str], box: str, text: str) -> DataFrame:
    """(page, box, text): the words of each box in reading order."""
    hit = words_inside(words, boxes, page, box)
    ordered = F.array_sort(F.collect_list(F.struct("top", "x0", text)))
    return hit.groupBy(*page, box).agg(F.array_join(F.transform(ordered, lambda w: w[text]), " ").alias(text))


def nearest_in_band(left: DataFrame, right: DataFrame, page: list[str], key: list[str], value: str, x: float = 0.5, y: float = 1.0) -> DataFrame:
    """For each row of left, the value of the nearest row of right within x and y of its x0 and bottom; null without one.

    Places are filed by whole points; a row of right stands in its own bucket and the two beside it, so the join is by equality.
    """
    bucket = lambda c: F.floor(c).cast("long")
    filed = right.select(*page, F.col("x0").alias("__x0"), F.col("bottom").alias("__bottom"), F.col(value).alias("__value"), F.explode(F.expr("sequence(cast(floor(x0) as bigint) - 1, cast(floor(x0) as bigint) + 1)")).alias("__bucket"))
    near = (F.abs(F.col("x0") - F.col("__x0")) < x) & (F.abs(F.col("bottom") - F.col("__bottom")) < y)
    hit = left.withColumn("__bucket", bucket(F.col("x0"))).join(filed, [*page, "__bucket"]).where(near)
    order = F.struct(F.abs(F.col("x0") - F.col("__x0")), F.abs(F.col("bottom") - F.col("__bottom")), F.col("__value"))
    best = hit.groupBy(*page, *key).agg(F.min_by("__value", order).alias(value))
    return left.select(*page, *key).join(best, [*page, *key], "left")


def line_above(lines: DataFrame, boxes: DataFrame, page: list[str], box: str, text: str, most: float) -> DataFrame:
    """(page, box, text): the lowest line that ends above a box, at most `most` points from it, and overlaps it from side to side."""
    above = boxes.select(*page, F.col(box), F.col("top").alias("__top"), F.col("x0").alias("__x0"), F.col("x1").alias("__x1"))
    fits = (F.col("bottom") <= F.col("__top")) & (F.col("__top") - F.col("bottom") <= most) & (F.col("x0") < F.col("__x1")) & (F.col("__x0") < F.col("x1"))
    hit = lines.join(above, page).where(fits)
    return hit.groupBy(*page, box).agg(F.max_by(text, F.struct("bottom", -F.col("x0"), text)).alias(text))


def clipped_area(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    """The part of a box that lies on its page."""
    side = lambda a, b, most: F.greatest(F.least(b, most) - F.greatest(a, F.lit(0.0)), F.lit(0.0))
    return side(x0, x1, width) * side(top, bottom, height)


def coverage(images: DataFrame, pages: DataFrame, page: list[str]) -> DataFrame:
    """(page, coverage): what share of each page its images cover, 1 at most; 0 without images."""
    area = images.join(pages.select(*page, "width", "height"), page).select(*page, clipped_area(*(F.col(c) for c in ("x0", "top", "x1", "bottom", "width", "height"))).alias("__area"))
    total = area.groupBy(*page).agg(F.sum("__area").alias("__area"))
    share = F.least(F.coalesce("__area", F.lit(0.0)) / (F.col("width") * F.col("height")), F.lit(1.0))
    return pages.join(total, page, "left").select(*page, F.when(F.col("width") * F.col("height") > 0, share).otherwise(0.0).alias("coverage"))


def glyph_widths(letters: DataFrame, by: list[str], width: str, least: int = 2) -> DataFrame:
    """The median width of each letter of a font and size that occurs `least` times."""
    return letters.groupBy(*by).agg(F.median(width).alias(width), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def column_weights(cells: DataFrame, by: list[str], text: str, low: int, high: int) -> DataFrame:
    """How wide each column of a table is to be: its longest line, between two limits."""
    longest = F.array_max(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), F.length))
    return cells.groupBy(*by).agg(F.greatest(F.least(F.max(longest), F.lit(high)), F.lit(low)).alias("weight"))


def best_area(areas: DataFrame, by: list[str], area: str, score: list[Column]) -> DataFrame:
    """The area with the highest score, compared part by part; of equal ones the first by name."""
    ranked = F.row_number().over(Window.partitionBy(*by).orderBy(*[s.desc_nulls_last() for s in score], F.col(area)))
    return areas.withColumn("__rank", ranked).where("__rank = 1").drop("__rank")


def side_shares(lines: DataFrame, by: list[str], middle: Column) -> DataFrame:
    """How many lines of each page stand wholly left or right of a line down its middle: two columns have most of them on one side."""
    return lines.groupBy(*by).agg(
        F.avg((F.col("x1") <= middle).cast("int")).alias("left"), F.avg((F.col("x0") >= middle).cast("int")).alias("right"), F.count(F.lit(1)).cast("long").alias("n")
    )


def reading_order(rows: DataFrame, page: list[str], name: str = "at") -> DataFrame:
    """Numbers the rows of a page from the top and, at the same height, from the left."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*page).orderBy("top", "x0")))


def word_rows(words: DataFrame, page: str, tolerance: float = 1.8, name: str = "row") -> DataFrame:
    """Numbers the rows that words stand in: a row begins with a word that is more than `tolerance` below the first one of the row before.

    The height of a row is that of its first word, so rows cannot be told by the gaps between neighbours. Pages are sorted
    within a task and read word by word with two numbers of state, so a page of any size fits.
    """
    columns = [c for c in words.columns if c != page]

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, first, row = object(), 0.0, -1
        for part in parts:
            rows = []
            for p, top in zip(part[page], part["top"], strict=True):
                if p != here:
                    here, first, row = p, top, 0
                elif top - first > tolerance:
                    first, row = top, row + 1
                rows.append(row)
            yield part.assign(**{name: rows})

    dealt = words.select(page, *columns).repartition(page).sortWithinPartitions(page, "top", "x0")
    return dealt.mapInPandas(numbered, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in dealt.schema.fields)}, {name} int")
