"""Operators over acts: roles of lines, references to provisions, dates of effect and notes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import brazilian
from ..functions.keys import PARTS, expand
from .sequence import fill_from_next, islands

# Words for the levels of a reference, small to large.
UNITS = [("item", r"ite(?:m|ns)"), ("alinea", r"al[íi]neas?"), ("inciso", r"incisos?"), ("paragraph", r"§§?|par[áa]grafos?"), ("article", r"arts?\.|artigos?")]
# What a number of each level looks like.
VALUES = {"item": r"\d+(?:\.\d+)*", "alinea": r"[“\"']?[a-z][”\"']?", "inciso": r"[IVXLCDM]+(?:-[A-Z])?", "paragraph": r"(?:\d+º?(?:-[A-Z])?|[úu]nico)", "article": r"\d+º?(?:-[A-Z])?"}
_UNIT = re.compile("|".join(rf"(?:\b(?:{w})|{w})\s*(?P<{k}_v>{VALUES[k]}(?:\s*(?:,|\be\b|\ba\b|\bà\b|\bao\b|\baté\b)\s*{VALUES[k]}(?![\w]))*)(?!\w)" for k, w in UNITS))

# The patterns by which a line's role is known, in order; the first that fits counts.
ROLES = [
    ("epigraph", r"(?iuU)^(?:LEI|DECRETO|PORTARIA|RESOLUÇÃO)(?:\s+COMPLEMENTAR)?\s+N[º°.]*\s*[\d.]+"),
    ("publication", r"(?iuU)^Publicad[oa]\s+n[oa]\b"),
    ("command", r"(?iuU)^(?:DECRETA|RESOLVE|Faço\s+saber)\b"),
    ("article", r"(?iuU)^Art\.\s*\d+"),
    ("paragraph", r"(?iuU)^(?:§\s*\d+|Parágrafo\s+único)"),
    ("inciso", r"^[IVXLCDM]+\s*[-–—]"),
    ("alinea", r"^[a-z]\s*\)"),
    ("closing", r"(?iuU)^[\w\s]+,\s*(?:em\s+)?\d{1,2}º?\s+de\s+\w+\s+de\s+\d{4}"),
]


def rendered(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """An act for each order: epigraph, summary, command, an article for each line, a quotation, closing and signature."""
    o = orders.select("o_orderkey", F.col("o_orderdate").alias("d"))
    head = o.select("o_orderkey", F.posexplode(F.array(
        F.concat(F.lit("LEI Nº "), F.col("o_orderkey").cast("string"), F.lit(", DE "), F.year("d").cast("string")), F.lit("Altera a legislação que menciona."), F.lit("DECRETA:"),
    )).alias("seq", "text"))
    n = F.col("l_linenumber")
    said = F.when(n % 3 == 0, F.concat(F.lit("“Art. "), F.col("l_partkey").cast("string"), F.lit(". Nova redação.”"))).otherwise(F.concat(F.lit("Art. "), n.cast("string"), F.lit("º O valor passa a ser outro.")))
    body = lines.select(F.col("l_orderkey").alias("o_orderkey"), (n + 2).cast("int").alias("seq"), said.alias("text"))
    tail = o.select("o_orderkey", F.posexplode(F.array(F.concat(F.lit("Belém, 3 de março de "), F.year("d").cast("string")), F.lit("FULANO DE TAL"), F.lit("Governador do Estado"))).alias("p", "text"))
    return head.union(body).union(tail.select("o_orderkey", (F.col("p") + 1000).alias("seq"), "text"))


def classify(lines: DataFrame, key: str) -> DataFrame:
    """(key, seq, text) to (key, seq, role). What a line is depends on what came before it, so the lines of an act are read in order.

    Acts are dealt out by their key and sorted within a task; the state goes on from batch to batch, so an act of any length
    needs no more memory than a batch.
    """
    patterns = [(role, re.compile(p.replace("(?iuU)", ""), re.I if "(?iuU)" in p else 0)) for role, p in ROLES]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        act, front, quoted, last = object(), True, False, ""
        for part in parts:
            out = []
            for k, text in zip(part[key], part["text"], strict=True):
                if k != act:
                    act, front, quoted, last = k, True, False, ""
                line = (text or "").strip()
                if quoted or line[:1] in "“\"" and line:
                    role, quoted = "quotation", not re.search("[”\"][.;]?$", line)
                else:
                    role = next((r for r, p in patterns if p.search(line)), "text")
                    if role == "text" and last in ("closing", "name") and line:
                        role = "name" if line == line.upper() and last == "closing" else "post"
                    elif role == "text" and front and last == "epigraph":
                        role = "summary"
                    elif role == "publication" and not front:
                        role = "text"
                    if role in ("command", "article"):
                        front = False
                last = role
                out.append(role)
            yield part[[key, "seq"]].assign(role=out)

    kind = lines.schema[key].dataType.simpleString()
    dealt = lines.select(key, F.col("seq").cast("int").alias("seq"), "text").repartition(key).sortWithinPartitions(key, "seq")
    return dealt.mapInPandas(read, f"{key} {kind}, seq int, role string")


UNIT_SCHEMA = "array<struct<kind:string,level:int,said:string,gap:string>>"


def units(text: Column) -> Column:
    """array<struct<kind, level, said, gap>>: the units of references in order, what is said of each, and the text since the one before."""

    @F.pandas_udf(UNIT_SCHEMA)
    def found(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[dict]:
            out, end = [], 0
            for m in _UNIT.finditer(t or ""):
                kind = m.lastgroup.removesuffix("_v")
                out.append({"kind": kind, "level": PARTS.index(kind), "said": m[f"{kind}_v"], "gap": t[end : m.start()]})
                end = m.end()
            return out

        return pd.Series([of(t) for t in texts], dtype=object)

    return found(text)


def unit_values(said: Column) -> Column:
    """array<string>: the numbers of a list, ranges expanded; a range that is none gives both its ends."""
    parts = F.split(F.regexp_replace(said, r"\s*,\s*|\s+e\s+", ","), ",")
    clean = lambda v: F.when(F.lower(v).isin("único", "unico"), "UNICO").otherwise(F.regexp_replace(v, "[“”\"'º]", ""))

    def of(part: Column) -> Column:
        ends = F.transform(F.split(part, r"\s+(?:a|à|ao|até)\s+"), lambda x: clean(F.trim(x)))
        return F.when(F.size(ends) == 2, F.coalesce(expand(ends[0], ends[1]), ends)).otherwise(ends)

    return F.flatten(F.transform(parts, of))


def references(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, article, paragraph, inciso, alinea, item): the targets that a text refers to.

    A unit goes on with the reference of the one before if it is larger and joined by of or in, or smaller and after a comma,
    and if that has no unit of its kind; runs of such units are islands. Lists within a reference multiply. One without an
    article takes that of the next reference of the text that has one, else of the last.
    """
    rows = rows.select(*key, F.posexplode(units(F.col(text))).alias("at", "u")).select(*key, "at", "u.*")
    order = Window.partitionBy(*key).orderBy("at")
    before = F.lag("level").over(order)
    larger = (F.col("level") < before) & F.col("gap").rlike(r"^\s*,?\s*(?:d[oae]s?|n[oa]s?)\s*$")
    smaller = (F.col("level") > before) & F.col("gap").rlike(r"^\s*,?\s*$")
    joined = F.coalesce(larger | smaller, F.lit(False))
    # within a run that goes up and then down a kind may come again: there a reference begins
    runs = islands(rows.withColumn("__joined", joined), key, ["at"], ~joined, "__run")
    again = F.row_number().over(Window.partitionBy(*key, "__run", "kind").orderBy("at")) > 1
    runs = islands(runs.withColumn("__again", again), key, ["at"], ~F.col("__joined") | F.col("__again"), "__ref")
    pick = lambda p: F.first(F.when(F.col("kind") == p, unit_values(F.col("said"))), ignorenulls=True).alias(p)
    refs = runs.groupBy(*key, "__ref").agg(*map(pick, PARTS))
    refs = refs.withColumn("__first", F.when(F.col("article").isNotNull(), F.slice("article", 1, 1)))
    refs = fill_from_next(refs, key, ["__ref"], "__first", "__donor").withColumn("article", F.coalesce("article", "__donor"))
    for p in PARTS:
        refs = refs.withColumn(p, F.explode(F.coalesce(p, F.array(F.lit("")))))
    return refs.select(*key, *PARTS)


def assign_effects(ops: DataFrame, rules: DataFrame, key: str, default: str, fallback: Column) -> DataFrame:
    """The date of effect of each operation and the rule that gives it. Several specific dates assign none."""
    own = rules.groupBy(key).agg(F.countDistinct("date").alias("__n"), F.min("date").alias("__date"))
    rows = ops.join(own, key, "left")
    rule = F.when(F.col("__n") > 1, "ambiguous").when(F.col("__n") == 1, "specific").when(F.col(default).isNotNull(), "default").otherwise("fallback")
    date = F.when(rule == "specific", F.col("__date")).when(rule == "default", F.col(default)).when(rule == "fallback", fallback)
    return rows.select(key, date.alias("effects"), rule.alias("rule"))


def close_note(note: Column, start: Column, effects: Column, published_before: Column) -> Column:
    """A note 'efeitos a partir de X' closed by a later wording: until the day before, or never in force if that comes first."""
    closed = F.concat(F.lit("efeitos de "), brazilian(start), F.lit(" a "), brazilian(F.date_sub(effects, 1)))
    return F.when(effects.isNull(), note).when((effects <= start) & published_before, F.regexp_replace(note, "efeitos a partir de [\\d.]+", "sem efeitos")).otherwise(
        F.regexp_replace(note, "efeitos a partir de [\\d.]+", closed)
    )
