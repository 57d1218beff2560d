"""Column functions over dates as legal text gives them."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of months.
MONTHS = "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split()
# Number words of terms in days, and of months after the publication.
DAYS = {
    "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "quinze": 15, "trinta": 30,
    "quarenta e cinco": 45, "sessenta": 60, "noventa": 90, "cento e vinte": 120, "cento e oitenta": 180,
}
MONTHS_AFTER = {"": 1, "segundo": 2, "terceiro": 3, "quarto": 4}
# How clauses name a date or count it from the publication; text is without accents and in lower case.
NAMED = r"\b(\d{1,2})[ºo°]?\s+de\s+([a-z]+)\s+de\s+(\d{4})\b|\b(\d{1,2})[./](\d{1,2})[./](\d{4}|\d{2})\b"
DAYS_AFTER = r"(\d+|[a-z ]+?)\s*(?:\([^)]*\)\s*)?dias\s+(?:apos|depois\s+d[ae]|contados\s+d[ae]|a\s+partir\s+d[ae])\s+(?:a\s+|da\s+)?(?:data\s+d[ae]\s+)?(?:sua\s+)?publicacao"
FIRST_DAY = r"primeiro\s+dia\s+do\s+(?:(segundo|terceiro|quarto)\s+)?mes\s+(?:subsequente|seguinte)\s+ao\s+d[ae]\s+(?:sua\s+)?publicacao"
NEXT_YEAR = r"1[ºo°]?\s+de\s+janeiro\s+do\s+(?:ano|exercicio)(?:\s+financeiro)?\s+(?:subsequente|seguinte)\s+ao\s+d[ae]\s+(?:sua\s+)?publicacao"
ON_PUBLICATION = r"\b(?:d?a\s+)?data\s+(?:de\s+|da\s+)?(?:sua\s+)?publicacao\b|\bpublicacao\s+dest[ae]\s+\w+"
NOT_FROM = r"(?:ate|antes\s+d[ae]|anteriormente\s+[a])\s*$"


def parse_date(text: Column) -> Column:
    """By the first format that fits; null if none does or there is no such day."""
    t = F.trim(text)
    return F.coalesce(*(F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for p, f in (
        (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
        (r"^\d{2}/\d{2}/\d{2}$", "dd/MM/yy"), (r"^\d{2}\.\d{2}\.\d{2}$", "dd.MM.yy"))))


def long_date(text: Column) -> Column:
    """A date with the month's name: 1º de março de 2026."""
    p = r"(?iuU)(\d{1,2})º?\s+de\s+(" + "|".join(MONTHS) + r")\s+de\s+(\d{4})"
    part = lambda i: F.regexp_extract(text, p, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(2)))
    return F.when(part(1) != "", F.try_make_timestamp(part(3).cast("int"), month.cast("int"), part(1).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date"))


def _plain(text: str) -> str:
    """Lower case without accents, sign for sign, so that places stay."""
    return "".join(unicodedata.normalize("NFD", c)[0] if c.isalpha() else c for c in text.lower())


def _made(year: int, month: int, day: int) -> dt.date | None:
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def read_dates(text: str | None, publication: dt.date | None) -> list[tuple[int, int, dt.date, dt.date | None]]:
    """(start, end, date, until) of the dates of a clause in order: those named, and with a publication those counted from it.

    A start and an end joined as one period are one entry. A day that does not exist is left out. "On the publication" counts
    only outside the other terms, and not after "until" or "before".
    """
    said = _plain(text or "")
    months = {_plain(m): i for i, m in enumerate(MONTHS, 1)}
    found: list[tuple[int, int, dt.date | None]] = []
    for m in re.finditer(NAMED, said):
        year = int(m[3] or m[6])
        year += 0 if year > 99 else 2000 if year < 69 else 1900
        found.append((*m.span(), _made(year, int(m[5]) if m[5] else months.get(m[2], 0), int(m[1] or m[4]))))
    if publication:
        terms = [(*m.span(), publication + dt.timedelta(days=n)) for m in re.finditer(DAYS_AFTER, said) if (n := int(m[1]) if m[1].isdigit() else DAYS.get(" ".join(m[1].split()), 0))]
        after = lambda k: _made(publication.year + (publication.month + k - 1) // 12, (publication.month + k - 1) % 12 + 1, 1)
        terms += [(*m.span(), after(MONTHS_AFTER[m[1] or ""])) for m in re.finditer(FIRST_DAY, said)]
        terms += [(*m.span(), _made(publication.year + 1, 1, 1)) for m in re.finditer(NEXT_YEAR, said)]
        free = lambda at: not any(a <= at < b for a, b, _ in terms)
        found += terms + [(*m.span(), publication) for m in re.finditer(ON_PUBLICATION, said) if free(m.start()) and not re.search(NOT_FROM, said[: m.start()])]
    out = sorted((a, b, d) for a, b, d in found if d)
    if len(out) == 2 and out[0][2] < out[1][2]:
        (a, b, start), (c, d, end) = out
        before, between = said[max(0, a - 30) : a].rstrip(), said[b:c].strip()
        if between in ("a", "ate") and re.search(r"\b(?:de|desde)$", before) or between == "e" and before.endswith("entre"):
            return [(a, d, start, end)]
    return [(*x, None) for x in out]


def dates_in(text: Column, publication: Column) -> Column:
    """array<struct<start, end, date, until>> by read_dates."""

    @F.pandas_udf("array<struct<start:int,end:int,date:date,until:date>>")
    def found(texts: pd.Series, days: pd.Series) -> pd.Series:
        names = ("start", "end", "date", "until")
        return pd.Series([[dict(zip(names, x, strict=True)) for x in read_dates(t, d)] for t, d in zip(texts, days, strict=True)], dtype=object)

    return found(text, publication)


def effect_date(text: Column, publication: Column) -> Column:
    """The first date from which a clause has effect: named, or counted from the publication; null without one."""
    return F.get(dates_in(text, publication), F.lit(0))["date"]


def brazilian(date: Column, digits: int = 4) -> Column:
    return F.date_format(date, "dd.MM.yyyy" if digits == 4 else "dd.MM.yy")


def until(next_effects: Column, digits: int = 4) -> Column:
    """The day before the next wording takes effect, as it is printed."""
    return brazilian(F.date_sub(next_effects, 1), digits)
