"""All citations of a text with their spans: lists in the plural, single acts and constitutions, in that order of precedence."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of acts as they are cited, in the singular and in the plural, and the name each has in a key.
SINGULAR = {
    "lei complementar": "Lei Complementar", "lei ordinária": "Lei", "decreto-lei": "Decreto-Lei", "decreto legislativo": "Decreto Legislativo", "lei": "Lei", "decreto": "Decreto",
    "instrução normativa conjunta": "Instrução Normativa Conjunta", "instrução normativa": "Instrução Normativa", "portaria conjunta": "Portaria Conjunta", "portaria": "Portaria",
    "resolução": "Resolução", "convênio icms": "Convênio ICMS", "convênio": "Convênio", "ajuste sinief": "Ajuste SINIEF", "protocolo icms": "Protocolo ICMS", "protocolo": "Protocolo",
    "ato cotepe/icms": "Ato COTEPE/ICMS", "ato cotepe": "Ato COTEPE/ICMS", "emenda constitucional": "Emenda Constitucional", "medida provisória": "Medida Provisória",
    "ordem de serviço": "Ordem de Serviço", "norma de execução": "Norma de Execução", "ato": "Ato", "lc": "Lei Complementar", "in": "Instrução Normativa",
}
PLURAL = {
    "leis complementares": "Lei Complementar", "leis": "Lei", "decretos-leis": "Decreto-Lei", "decretos": "Decreto", "instruções normativas": "Instrução Normativa", "portarias": "Portaria",
    "resoluções": "Resolução", "convênios icms": "Convênio ICMS", "convênios": "Convênio", "protocolos icms": "Protocolo ICMS", "protocolos": "Protocolo", "emendas constitucionais": "Emenda Constitucional",
    "medidas provisórias": "Medida Provisória", "ajustes sinief": "Ajuste SINIEF", "atos": "Ato",
}
_SPHERE = r"(?:\s+(?P<sphere>federa(?:l|is)|estadua(?:l|is)|CG[ /-]?IBS))?"
_ITEM = (
    r"(?P<number>\d{1,3}(?:\.\d{3})+|\d+)(?:\s*/\s*(?P<y1>\d{4}|\d{2})(?!\d)|,?\s+de\s+\d{1,2}º?\s+de\s+[a-zç]+\s+de\s+(?P<y2>\d{4})|,?\s+de\s+(?P<y3>\d{4})(?!\d))?"
)
_names = lambda t: "|".join(re.escape(k).replace(r"\ ", r"\s+") for k in t)
_LIST = re.compile(rf"\b(?P<kind>{_names(PLURAL)}){_SPHERE}\s+(?:n[º°.o]*s?[º°.]*\s*)?{_ITEM}", re.I)
_MORE = re.compile(rf"\s*(?:,\s*(?:e\s+)?|\s+e\s+)(?:n[º°.o]*\s*)?{_ITEM}(?=\s*(?:[,;.:)(]|e\s|$))", re.I)
_ONE = re.compile(rf"\b(?P<kind>{_names(SINGULAR)}){_SPHERE}\s+(?:n[º°.o]*\s*)?{_ITEM}", re.I)
_CONSTITUTION = re.compile(
    r"\b(?:(?P<federal>Constitui[çc][ãa]o\s+(?:Federal|da\s+Rep[úu]blica(?:\s+Federativa\s+do\s+Brasil)?)(?:,?\s+de\s+1988)?|CF\s*/\s*(?:19)?88\b)"
    r"|(?P<state>Constitui[çc][ãa]o\s+(?:Estadual|do\s+Estado(?:\s+do\s+Par[áa])?)(?:,?\s+de\s+1989)?))",
    re.I,
)
_DRAFT = re.compile(r"\b(?:ante)?projetos?\s+de\s*$", re.I)


def full_year(year: str | None, pivot: int) -> str:
    if not year or len(year) == 4:
        return year or ""
    return ("20" if int(year) < pivot else "19") + year


def read_citations(text: str | None, pivot: int = 70) -> list[dict]:
    """The citations of a text in order, none overlapping: start, end, kind, number, year, sphere, key, said.

    Each number of a list in the plural is one. A bill ("Projeto de Lei") is no act. A constitution has no number.
    """
    text = text or ""
    taken: list[tuple[int, int]] = []
    out: list[dict] = []

    def add(start: int, end: int, kind: str, m: re.Match | None, sphere: str) -> None:
        number = re.sub(r"^0+(?=.)", "", m["number"].replace(".", "")) if m else ""
        year = full_year(m["y1"] or m["y2"] or m["y3"], pivot) if m else ""
        out.append({"start": start, "end": end, "kind": kind, "number": number, "year": year, "sphere": sphere, "key": "|".join(x for x in (kind, number, year) if x), "said": text[start:end]})
        taken.append((start, end))

    free = lambda a, b: not any(x < b and a < y for x, y in taken) and not _DRAFT.search(text[max(0, a - 25) : a])
    tidy = lambda s: " ".join(s.lower().split())

    def named(m: re.Match) -> str:
        said = unicodedata.normalize("NFC", (m["sphere"] or "").upper())
        return "FEDERAL" if said.startswith("FED") else "ESTADUAL" if said.startswith("EST") else "CGIBS" if said else ""

    for m in _LIST.finditer(text):
        if free(*m.span()):
            kind, sphere = PLURAL[tidy(m["kind"])], named(m)
            add(*m.span(), kind, m, sphere)
            at = m.end()
            while more := _MORE.match(text, at):
                add(more.start("number"), more.end(), kind, more, sphere)
                at = more.end()
    for m in _ONE.finditer(text):
        if free(*m.span()):
            add(*m.span(), SINGULAR[tidy(m["kind"])], m, named(m))
    for m in _CONSTITUTION.finditer(text):
        if free(*m.span()):
            add(*m.span(), "Constituição", None, "FEDERAL" if m["federal"] else "ESTADUAL")
    return sorted(out, key=lambda c: c["start"])


def citations(text: Column) -> Column:
    """array<struct<start, end, kind, number, year, sphere, key, said>> by read_citations; null has none."""

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,number:string,year:string,sphere:string,key:string,said:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([read_citations(t) for t in texts], dtype=object)

    return found(text)
