"""Word files, saved web pages, plans, link tables and reports: reading and writing them whole."""

from __future__ import annotations

import email
import email.policy
import hashlib
import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from difflib import unified_diff
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# Fixed value: the name space of Word's markup.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Fixed value: the version of plans that are written and read.
PLAN_VERSION = 1


def read_docx(data: bytes | None) -> list[dict]:
    """(seq, style, text, in_table) of the paragraphs of a Word file in order, as they read with all tracked changes made.

    What a change has deleted or moved away is left out and what it has added is there. A file that is no Word file has none.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    out: list[dict] = []

    def text_of(node: ElementTree.Element) -> Iterator[str]:
        for x in node:
            if x.tag in (_W + "del", _W + "moveFrom", _W + "pPr", _W + "rPr"):
                continue
            if x.tag == _W + "t":
                yield x.text or ""
            elif x.tag in (_W + "tab", _W + "br", _W + "cr"):
                yield "\t" if x.tag == _W + "tab" else "\n"
            elif x.tag == _W + "noBreakHyphen":
                yield "-"
            else:
                yield from text_of(x)

    def walk(node: ElementTree.Element, table: bool) -> None:
        for x in node:
            if x.tag == _W + "p":
                style = x.find(f"{_W}pPr/{_W}pStyle")
                out.append({"seq": len(out), "style": style.get(_W + "val") if style is not None else None, "text": "".join(text_of(x)), "in_table": table})
            elif x.tag not in (_W + "del", _W + "moveFrom"):
                walk(x, table or x.tag == _W + "tbl")

    walk(root, False)
    return out


def docx_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, style, text, in_table): the paragraphs of Word files."""

    @F.pandas_udf("array<struct<seq:int,style:string,text:string,in_table:boolean>>")
    def read(parts: pd.Series) -> pd.Series:
        return pd.Series([read_docx(None if x is None else bytes(x)) for x in parts], dtype=object)

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return raw.select("path", F.explode(read("content")).alias("p")).select("path", "p.*")


def read_mhtml(data: bytes | None) -> dict | None:
    """(url, html, images): the page of a web archive and the addresses of its pictures; None if it has no page."""
    message = email.message_from_bytes(data or b"", policy=email.policy.default)
    page, url, images = None, message.get("Snapshot-Content-Location") or "", []
    for part in message.walk():
        kind = part.get_content_type()
        if kind == "text/html" and page is None:
            page, url = part.get_content(), url or part.get("Content-Location") or ""
        elif kind.startswith("image/"):
            images.append(part.get("Content-Location") or "")
    return None if page is None else {"url": str(url), "html": str(page), "images": [str(i) for i in images]}


def web_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, url, html, images) of MHTML files; files without a page go."""

    @F.pandas_udf("url string, html string, images array<string>")
    def read(parts: pd.Series) -> pd.DataFrame:
        found = [read_mhtml(None if x is None else bytes(x)) or {} for x in parts]
        return pd.DataFrame({c: pd.Series([f.get(c) for f in found], dtype=object) for c in ("url", "html", "images")})

    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", read("content").alias("p")).select("path", "p.*").where("html is not null")


def slim(page: Column) -> Column:
    """A page without scripts, styles, comments, drawings and data addresses, which no reader needs."""
    out = F.regexp_replace(page, r"(?is)<(script|style|noscript|svg|iframe|template)\b[^>]*>.*?</\1\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(out, r"(?i)\s(?:src|href)\s*=\s*([\"'])data:[^\"']*\1", "")


def save_plan(ops: DataFrame, path: str, base: str, act: str) -> None:
    """A plan as lines of JSON: a head with the version and the digests of both texts, and an operation a line. The target must not exist."""
    head = {"version": PLAN_VERSION, "base": hashlib.sha256(base.encode()).hexdigest(), "act": hashlib.sha256(act.encode()).hexdigest()}
    rows = ops.select(F.to_json(F.struct(*ops.columns)).alias("value"))
    first = ops.sparkSession.createDataFrame([(json.dumps({"plan": head}),)], "value string")
    first.union(rows).write.mode("errorifexists").text(path)


def load_plan(spark: SparkSession, path: str, schema: str, base: str | None = None, act: str | None = None) -> DataFrame:
    """The operations of a saved plan. A plan of another version, or for texts other than those given, is an error; a field that the schema does not have is ignored."""
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith('{"plan"')).take(2)
    if len(heads) != 1:
        raise ValueError(f"{path} is no plan")
    head = json.loads(heads[0][0])["plan"]
    if head.get("version") != PLAN_VERSION:
        raise ValueError(f"{path} has version {head.get('version')}, not {PLAN_VERSION}")
    for name, given in (("base", base), ("act", act)):
        if given is not None and head.get(name) != hashlib.sha256(given.encode()).hexdigest():
            raise ValueError(f"{path} was made for another {name}")
    rows = lines.where(~F.col("value").startswith('{"plan"'))
    return rows.select(F.from_json("value", schema).alias("o")).select("o.*")


def append_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value): a link table with more links. A key that it has keeps its value; of new ones for the same key, the least."""
    first = new.where("trim(key) != '' and trim(value) != ''").groupBy(F.trim("key").alias("key")).agg(F.min(F.trim("value")).alias("value"))
    return old.select("key", "value").unionByName(first.join(old, "key", "left_anti"))


def write_links(links: DataFrame, path: str) -> None:
    """Tab-separated lines in the order of their keys. The target must not exist."""
    links.orderBy("key").select(F.concat_ws("\t", "key", "value").alias("value")).write.mode("errorifexists").text(path)


def report_row(cells: list[str]) -> Column:
    """A row of an HTML table with the cells' signs escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def report_html(rows: DataFrame, path: str, title: str) -> None:
    """A report as pages of HTML, one for each partition: a table with a row for each row. The target must not exist."""
    head = f"<html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns) + "</tr>"

    def paged(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for part in parts:
            yield pd.DataFrame({"value": ([] if begun else [head]) + list(part["value"])})
            begun = True
        if begun:
            yield pd.DataFrame({"value": ["</table></body></html>"]})

    rows.select(report_row(rows.columns).alias("value")).mapInPandas(paged, "value string").write.mode("errorifexists").text(path)


def diff(old: Column, new: Column) -> Column:
    """The lines by which two texts differ, as a unified diff; empty for equal texts."""

    @F.pandas_udf("string")
    def made(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(unified_diff((x or "").splitlines(), (y or "").splitlines(), "antes", "depois", lineterm="")) for x, y in zip(a, b, strict=True)], dtype=object)

    return made(old, new)


def guarded(target: str, inputs: list[str]) -> str:
    """The target, unless it is an input, holds one or lies in one: what is read is never written over."""
    plain = lambda p: re.sub("/+", "/", p.removeprefix("file:")).rstrip("/")
    t = plain(target)
    for i in map(plain, inputs):
        if t == i or t.startswith(i + "/") or i.startswith(t + "/"):
            raise ValueError(f"{target} would be written over an input")
    return target


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: legal_citations(text) gives a row for each citation, legal_dates(text, publication) one for each date."""
    from ..functions.citations import read_citations
    from ..functions.dates import read_dates

    @udtf(returnType="at int, kind string, number string, year string, sphere string, key string, said string")
    class Citations:
        def eval(self, text: str) -> Iterator[tuple]:
            for c in read_citations(text):
                yield c["start"], c["kind"], c["number"], c["year"], c["sphere"], c["key"], c["said"]

    @udtf(returnType="at int, day date, until date")
    class Dates:
        def eval(self, text: str, publication) -> Iterator[tuple]:  # noqa: ANN001
            for start, _, day, until in read_dates(text, publication):
                yield start, day, until

    spark.udtf.register("legal_citations", Citations)
    spark.udtf.register("legal_dates", Dates)
