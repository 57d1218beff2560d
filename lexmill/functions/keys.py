"""Keys of provisions: corpus, article, paragraph, inciso, alinea, item. An empty part stands for none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import roman, roman_value

PARTS = ["article", "paragraph", "inciso", "alinea", "item"]


def level(key: Column) -> Column:
    """The deepest part that is not empty; -1 for the whole corpus."""
    return F.greatest(F.lit(-1), *(F.when(F.coalesce(key[p], F.lit("")) != "", i) for i, p in enumerate(PARTS)))


def contains(outer: Column, inner: Column, parts: list[str] | None = None) -> Column:
    """Whether a key is the other or an ancestor of it."""
    tests = [(outer[p] == "") | outer[p].isNull() | (outer[p] == inner[p]) for p in parts or PARTS]
    return reduce(lambda a, b: a & b, tests, outer["corpus"].eqNullSafe(inner["corpus"]))


def parent(key: Column) -> Column:
    """The key less its deepest part."""
    at = level(key)
    return F.struct(key["corpus"].alias("corpus"), *(F.when(at > i, key[p]).otherwise("").alias(p) for i, p in enumerate(PARTS)))


def sort_key(number: Column) -> Column:
    """struct<n, suffix> by which numbers of provisions stand in order: UNICO is 1, single letters and roman numerals count, 39-A follows 39."""
    main, suffix = F.regexp_extract(number, r"^([^-]*)", 1), F.regexp_extract(number, r"-(.*)$", 1)
    n = (
        F.when(F.upper(number) == "UNICO", 1)
        .when(main.rlike(r"^\d+$"), main.cast("int"))
        .when(main.rlike("^[a-z]$"), F.ascii(main) - 96)
        .otherwise(roman_value(main))
    )
    return F.struct(n.cast("int").alias("n"), suffix.alias("suffix"))


def expand(first: Column, last: Column, most: int = 100) -> Column:
    """array<string>, the numbers of a range: 3 to 7, I to III, a to d, 39-A to 39-C; null for one that is backwards, of `most` or more, or of mixed kinds."""
    both = lambda p: first.rlike(p) & last.rlike(p)
    head, tail = (lambda x: F.regexp_extract(x, "^(.*)-[^-]*$", 1)), (lambda x: F.regexp_extract(x, "-([^-]*)$", 1))

    def span(low: Column, high: Column, name) -> Column:  # noqa: ANN001
        fits = (high >= low) & (high - low < most)
        return F.when(fits, F.transform(F.sequence(low, F.when(fits, high).otherwise(low)), name))

    letters = span(F.ascii(first), F.ascii(last), F.char)
    suffixes = F.when(head(first) == head(last), span(F.ascii(tail(first)), F.ascii(tail(last)), lambda c: F.concat(head(first), F.lit("-"), F.char(c))))
    return (
        F.when(both(r"^\d{1,9}$"), span(first.cast("int"), last.cast("int"), lambda n: n.cast("string")))
        .when(both("^[IVXLCDM]+$"), span(roman_value(first), roman_value(last), roman))
        .when(both("^[a-z]$"), letters)
        .when(both("^.*-[A-Z]$"), suffixes)
    )
