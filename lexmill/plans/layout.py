"""Queries over boxes on pages. The boxes are made from columns: a page for each order or part, a word for each line of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry
from .registry import query, table

_WORDS = (
    "select l_orderkey % 500 as page, l_orderkey, l_linenumber, (l_partkey % 580)::double as x0, (l_partkey % 580 + 4 + l_suppkey % 20)::double as x1, (l_orderkey // 500 * 13 % 800 + l_linenumber * 0.5)::double as top,"
    " (l_orderkey // 500 * 13 % 800 + l_linenumber * 0.5 + 9)::double as bottom, l_orderkey * 10 + l_linenumber as word from lineitem"
)
_BOXES = "select b::bigint as page, box, (box % 6 * 100)::double as x0, (box % 6 * 100 + 90)::double as x1, (box // 6 * 80)::double as top, (box // 6 * 80 + 70)::double as bottom from range(500) p(b), range(60) q(box)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    top = "cast(div(l_orderkey, 500L) * 13 % 800 + l_linenumber * 0.5 as double)"
    return li.select(
        F.expr("l_orderkey % 500").alias("page"), "l_orderkey", "l_linenumber", F.expr("cast(l_partkey % 580 as double)").alias("x0"), F.expr("cast(l_partkey % 580 + 4 + l_suppkey % 20 as double)").alias("x1"),
        F.expr(top).alias("top"), F.expr(f"{top} + 9").alias("bottom"), F.expr("l_orderkey * 10 + l_linenumber").alias("word"),
    )


def boxes(spark: SparkSession) -> DataFrame:
    b = spark.range(500).select(F.col("id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("n"))
    return b.select("page", F.col("n").cast("long").alias("box"), F.expr("double(n % 6 * 100)").alias("x0"), F.expr("double(n % 6 * 100 + 90)").alias("x1"), F.expr("double(n div 6 * 80)").alias("top"), F.expr("double(n div 6 * 80 + 70)").alias("bottom"))


@query(f"""
with w as ({_WORDS}), b as ({_BOXES})
select w.page::bigint as page, b.box::bigint as box, count(*)::bigint as n, min(w.word)::bigint as first from w join b on w.page = b.page and w.top >= b.top - 0.15 and w.top < b.bottom + 0.15
 and (w.x0 + w.x1) / 2 >= b.x0 - 0.15 and (w.x0 + w.x1) / 2 < b.x1 + 0.15 group by 1, 2
""")
def bbox_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = geometry.words_inside(words(spark, sf_dir), boxes(spark), ["page"], "box")
    return hit.groupBy("page", "box").agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("word").cast("long").alias("first"))


@query(f"""
with w as ({_WORDS}), b as ({_BOXES}),
h as (select w.page, b.box, w.top, w.x0, w.word from w join b on w.page = b.page and w.top >= b.top - 0.15 and w.top < b.bottom + 0.15 and (w.x0 + w.x1) / 2 >= b.x0 - 0.15 and (w.x0 + w.x1) / 2 < b.x1 + 0.15)
select page::bigint as page, box::bigint as box, string_agg(word::varchar, ' ' order by top, x0, word::varchar) as word from h group by 1, 2
""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each cell of a page in reading order."""
    w = words(spark, sf_dir).withColumn("word", F.col("word").cast("string"))
    return geometry.cell_text(w, boxes(spark), ["page"], "box", "word")


@query(f"""
with w as ({_WORDS}), r as (select page, x0 + case when word % 3 = 0 then 0.3 when word % 3 = 1 then -0.4 else 0.6 end as x0, bottom + 0.5 as bottom, word from w where word % 7 < 6),
h as (select w.word as id, r.word, abs(w.x0 - r.x0) as dx, abs(w.bottom - r.bottom) as dy from w join r on w.page = r.page and abs(w.x0 - r.x0) < 0.5 and abs(w.bottom - r.bottom) < 1),
k as (select id, word from (select *, row_number() over (partition by id order by dx, dy, word) as n from h) where n = 1)
select w.word::bigint as id, k.word::bigint as word from w left join k on w.word = k.id
""")
def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each letter with the one at the same place in another reading of the page."""
    w = words(spark, sf_dir)
    shift = F.when(F.col("word") % 3 == 0, 0.3).when(F.col("word") % 3 == 1, -0.4).otherwise(0.6)
    other = w.where("word % 7 < 6").select("page", (F.col("x0") + shift).alias("x0"), (F.col("bottom") + 0.5).alias("bottom"), "word")
    return geometry.nearest_in_band(w.withColumn("id", F.col("word")).drop("word"), other, ["page"], ["id"], "word").select("id", "word")


@query(f"""
with w as ({_WORDS}), b as ({_BOXES})
select b.page::bigint as page, b.box::bigint as box, (max(row(w.bottom, -w.x0, w.word)))[3]::bigint as word from w join b on w.page = b.page and w.bottom <= b.top and b.top - w.bottom <= 60 and w.x0 < b.x1 and b.x0 < w.x1 group by 1, 2
""")
def lines_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line above each table, which may be its title."""
    return geometry.line_above(words(spark, sf_dir), boxes(spark), ["page"], "box", "word", 60.0)


@query("""
with p as (select p_partkey, (400 + p_size)::double w, 600.0::double h from part), i as (select l_partkey, l_quantity * 12 - 60 as x0, l_quantity * 12 + l_linenumber * 40 as x1, l_discount * 5000 as top, l_discount * 5000 + 300 as bottom from lineitem where l_linenumber < 3)
select p_partkey, round(least(coalesce(sum(greatest(least(x1, w) - greatest(x0, 0), 0) * greatest(least(bottom, h) - greatest(top, 0), 0)) filter (l_partkey is not null), 0) / (w * h), 1), 6) as coverage from p left join i on p_partkey = l_partkey group by p_partkey, w, h
""")
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "part").select("p_partkey", F.expr("double(400 + p_size)").alias("width"), F.lit(600.0).alias("height"))
    images = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").selectExpr(
        "l_partkey as p_partkey", "l_quantity * 12 - 60 as x0", "l_quantity * 12 + l_linenumber * 40 as x1", "l_discount * 5000 as top", "l_discount * 5000 + 300 as bottom"
    )
    return geometry.coverage(images, pages, ["p_partkey"]).select("p_partkey", F.round("coverage", 6).alias("coverage"))


@query("select l_suppkey, l_linenumber, median(l_quantity) as width, count(*)::bigint as n from lineitem group by 1, 2 having count(*) >= 2")
def median_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").alias("width"))
    return geometry.glyph_widths(letters, ["l_suppkey", "l_linenumber"], "width")


@query("select source, lang, greatest(least(max(list_max(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: length(x)))), 120), 12)::int as weight from documents group by 1, 2")
def column_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.column_weights(table(spark, sf_dir, "documents").select("source", "lang", "text"), ["source", "lang"], "text", 12, 120)


@query("""
with r as (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_discount desc, l_linenumber) k from lineitem) select l_orderkey, l_linenumber from r where k = 1
""")
def best_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a page's areas by a score of several parts."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return geometry.best_area(li, ["l_orderkey"], "l_linenumber", [F.col("l_quantity"), F.col("l_discount")]).select("l_orderkey", "l_linenumber")


@query(f"""with w as ({_WORDS}) select page::bigint as page, round(avg((x1 <= 290)::int), 9) as "left", round(avg((x0 >= 290)::int), 9) as "right", count(*)::bigint as n from w group by 1""")
def column_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.side_shares(words(spark, sf_dir), ["page"], F.lit(290.0))
    return out.select("page", F.round("left", 9).alias("left"), F.round("right", 9).alias("right"), "n")


@query(f"with w as ({_WORDS}) select word::bigint as word, row_number() over (partition by page order by top, x0, word)::int as at from w")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words at the same place stand in the order of their numbers
    w = words(spark, sf_dir).withColumn("x0", F.struct("x0", "word"))
    return geometry.reading_order(w, ["page"]).select("word", "at")


@query(f"""
with recursive w as (select *, row_number() over (partition by page order by top, x0, word) i from ({_WORDS})),
r as (select page, i, word, top as first, 0 as row from w where i = 1 union all select w.page, w.i, w.word, case when w.top - r.first > 1.8 then w.top else r.first end, r.row + (w.top - r.first > 1.8)::int from r join w on w.page = r.page and w.i = r.i + 1)
select word::bigint as word, row::int as row from r
""")
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of words of a page, by the height of each row's first word."""
    return geometry.word_rows(words(spark, sf_dir).select("page", "top", "x0", "word"), "page").select("word", "row")
