"""Column functions over Portuguese legal text. Patterns take Unicode letters and cases by (?iuU)."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
FOLDED = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
# All letters that are one letter with marks, and what they are without; letters that come apart in several stay.
PLAIN = {c: p for c in map(chr, range(0x80, sys.maxunicode + 1)) if len(p := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) == 1 and p != c}
# Roman numerals, and those of each digit by its place.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN_PLACES = [
    ["", "M", "MM", "MMM"],
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
]
# Label patterns with their levels, tried in order.
LABELS = [
    ("article", 0, r"^Art(?:igo)?\.?\s*(\d+)[º°o]?(?:[-–]([A-Z]{1,3})(?![A-Za-zÀ-ÿ]))?\s*\.?\s*(?:[-–]\s*)?"),
    ("paragraph", 1, r"^§\s*(\d+)[º°o]?(?:[-–]([A-Z]{1,3})(?![A-Za-zÀ-ÿ]))?\s*\.?\s*(?:[-–]\s*)?"),
    ("sole", 1, r"^Par[aá]grafo\s+[uú]nico\s*[.:-]?\s*"),
    ("inciso", 2, r"^([IVXLCDM]+)(?:-([A-Z]))?\s*[-–—]\s*"),
    ("alinea", 3, r"^([a-z])\s*\)\s*"),
    ("item", 4, r"^(\d+(?:\.\d+)*)\s*[.)]\s+"),
]
# Kinds of acts and the name each spelling has in a key.
ACTS = {
    "lei complementar": "Lei Complementar", "decreto-lei": "Decreto-Lei", "lei": "Lei", "decreto": "Decreto", "portaria": "Portaria", "resolucao": "Resolução",
    "instrucao normativa": "Instrução Normativa", "emenda constitucional": "Emenda Constitucional", "medida provisoria": "Medida Provisória",
}
# Fixed value: a citation of an act by kind, number and year or date.
CITATION = (
    r"(?iuU)\b(Lei\s+Complementar|Decreto-Lei|Lei|Decreto|Portaria|Resolução|Instrução\s+Normativa|Emenda\s+Constitucional|Medida\s+Provisória)"
    r"\s+(?:n[º°.o]*\s*)?(\d{1,3}(?:\.\d{3})+|\d+)(?:\s*/\s*(\d{4}|\d{2})|,?\s+de\s+\d{1,2}º?\s+de\s+\w+\s+de\s+(\d{4}))?"
)
# A word with its hyphens, and one that a hyphen cuts at a line's end.
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*"
CUT_WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]-[\p{IsWhite_Space}\x1c-\x1f]*\z"
# An amount after the sign of the currency, and one with two decimals; a percentage.
MONEY = r"R\$\s*(-?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d{2})?)|((?<!\d)-?(?:\d{1,3}(?:\.\d{3})+|\d+),\d{2}(?![\d%]))"
PERCENT = r"-?\d+(?:\.\d{3})*,\d+\s*%"


def fold(text: Column) -> Column:
    """Without accents."""
    return F.translate(text, ACCENTED, FOLDED)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def norm(text: Column) -> Column:
    """For comparing text: no accents, lower case, single blanks; signs for paragraphs fall away and ordinal signs become o."""
    return squeeze(F.lower(fold(F.regexp_replace(F.regexp_replace(text, "[º]", "o"), "[§°]", ""))))


def norm_upper(text: Column) -> Column:
    """For keys: single blanks, upper case (a sharp s becomes SS), no marks on any letter; ordinal signs stay."""
    return F.regexp_replace(F.translate(F.upper(squeeze(text)), "".join(PLAIN), "".join(PLAIN.values())), r"\p{Mn}", "")


def is_upper(text: Column, most: int = 140) -> Column:
    return (text == F.upper(text)) & text.rlike(r"\p{L}") & (F.length(text) <= most)


def mostly_upper(text: Column) -> Column:
    """At least 8 letters, of which 85 in 100 are upper case."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (letters >= 8) & (F.regexp_count(text, F.lit(r"\p{Lu}")) >= letters * 0.85)


def act_number(number: Column) -> Column:
    """Without dots and leading zeros."""
    return F.regexp_replace(F.regexp_replace(number, r"\.", ""), "^0+(?=.)", "")


def full_year(year: Column, pivot: int = 70) -> Column:
    """Two-digit years below the pivot are of this century; others stay."""
    n = year.cast("int")
    return F.when(F.length(year) == 2, F.when(n < pivot, n + 2000).otherwise(n + 1900)).otherwise(n).cast("string")


def act_kind(kind: Column) -> Column:
    names = F.create_map(*(x for k, v in ACTS.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.element_at(names, norm(kind)), squeeze(kind))


def citation(text: Column) -> Column:
    """struct<kind, number, year, key> of the first citation; key is kind|number|year. See citations for all of a text."""

    def made(p: Column) -> Column:
        year = full_year(F.coalesce(F.nullif(p["y"], F.lit("")), F.nullif(p["z"], F.lit(""))))
        known = F.struct(act_kind(p["kind"]).alias("kind"), act_number(p["n"]).alias("number"), year.alias("year"))
        whole = lambda k: F.struct(k["kind"].alias("kind"), k["number"].alias("number"), k["year"].alias("year"), F.concat_ws("|", k["kind"], k["number"], k["year"]).alias("key"))
        return F.when(p["n"] != "", F.transform(F.array(known), whole)[0])

    # the pattern is matched once a group, whatever use is made of the parts
    parts = F.struct(*(F.regexp_extract(text, CITATION, i).alias(n) for i, n in enumerate(("kind", "n", "y", "z"), 1)))
    return F.transform(F.array(parts), made)[0]


def ordinal(number: Column) -> Column:
    """Up to 9, numbers of provisions have an ordinal sign, which comes before a letter."""
    digits, suffix = F.regexp_extract(number, r"^(\d+)", 1), F.regexp_extract(number, r"^\d+(.*)$", 1)
    return F.when(digits == "", number).when(digits.cast("int") <= 9, F.concat(digits, F.lit("º"), suffix)).otherwise(number)


def roman_value(text: Column) -> Column:
    """The number of a roman numeral; null for others. A sign before a larger one counts negative."""
    values = F.transform(F.split(F.upper(text), ""), lambda c: F.element_at(F.create_map(*(x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v)))), c))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.get(values, i + 1), F.lit(0)), -v).otherwise(v))
    return F.when(text.rlike("(?i)^[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def roman(n: Column) -> Column:
    """The roman numeral of 1 to 3999, place by place."""
    digit = lambda k: (F.floor(n / 10 ** (3 - k)).cast("int") % 10) + 1
    return F.concat(*(F.element_at(F.array(*map(F.lit, signs)), digit(k)) for k, signs in enumerate(ROMAN_PLACES)))


def label(text: Column) -> Column:
    """struct<kind, level, number, prefix, end> of the label that a line begins with, the first pattern that fits; null without one.

    prefix is the label as it stands and end the characters that it takes, with what divides it from the text, of the line
    without the blanks and quotation marks before it.
    """
    line = F.regexp_replace(F.trim(text), "^[\"“”]+\\s*", "")
    out = None
    for kind, level, pattern in LABELS:
        flagged = f"(?u){pattern}" if kind in ("inciso", "alinea") else f"(?iu){pattern}"
        if kind == "sole":
            number = F.lit("UNICO")
        else:
            main, suffix = F.regexp_extract(line, flagged, 1), F.regexp_extract(line, flagged, 2) if level < 3 else F.lit("")
            main = F.regexp_replace(main, "^0+(?=.)", "") if level < 2 else main
            number = F.concat(main, F.when(suffix != "", F.concat(F.lit("-"), F.upper(suffix))).otherwise(""))
        whole = F.regexp_extract(line, flagged, 0)
        found = F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), number.alias("number"), F.trim(whole).alias("prefix"), F.length(whole).alias("end"))
        out = F.when(line.rlike(flagged), found) if out is None else out.when(line.rlike(flagged), found)
    return out


def money(text: Column) -> Column:
    """The amounts of a text, as they are written with their signs, line by line; a line that is a percentage has none."""

    def of(line: Column) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(line, F.lit(MONEY), 1).alias("a"), F.regexp_extract_all(line, F.lit(MONEY), 2).alias("b"))
        return F.when(line.rlike(rf"^\s*{PERCENT}\s*$"), F.array().cast("array<string>")).otherwise(F.transform(both, lambda x: F.when(x["a"] != "", x["a"]).otherwise(x["b"])))

    return F.flatten(F.transform(F.split(text, "\r\n|\r|\n"), of))


def title_case(text: Column) -> Column:
    """Each run of letters begins upper case, also after dots and hyphens."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(p.substr(1, 1)), F.lower(p.substr(F.lit(2), F.length(p))))), "")


def join_line(text: Column, following: Column) -> Column:
    """The hyphen at a line's end goes if a small letter follows and what stands before is no clitic's host."""
    clitic = following.rlike("^(?:se|lhe|lhes|o|a|os|as|nos|me|te|vos)\\b")
    broken = text.rlike("(?u)\\p{L}-$") & following.rlike("(?u)^\\p{Ll}")
    glued = F.concat(F.when(clitic, text).otherwise(F.regexp_replace(text, "-$", "")), following)
    return F.when(broken, glued).otherwise(F.concat(text, F.lit(" "), following))


def whole_words(lines: Column) -> Column:
    """The words of successive lines in lower case, hyphenated ones whole, less the pieces of a word that a hyphen cuts at a line's end."""

    let = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731 - computes the value once
    cut = lambda line: F.coalesce(line.rlike(CUT_WORD), F.lit(False)).cast("int")

    def words(all_lines: Column) -> Column:
        def whole(line: Column, i: Column) -> Column:
            ahead, behind = cut(F.get(all_lines, i - 1)), cut(line)
            return let(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), lambda x: F.slice(x, ahead + 1, F.greatest(F.size(x) - ahead - behind, F.lit(0))))

        return F.flatten(F.transform(all_lines, whole))

    return F.transform(let(lines, words), F.lower)
