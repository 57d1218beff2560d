"""Queries that write notes and names of provisions, and that read all citations of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, notes, text
from .registry import query, table

_ROMANS = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII','XIII','XIV','XV','XVI','XVII','XVIII','XIX','XX']"
_KINDS = ("Lei", "Decreto", "LC", "Portaria")

_NOTES = f"""
with o as (select o_orderkey k, o_orderdate::date d, (o_orderkey % 4)::int lev, 1 + o_orderkey % 150 a, (1 + o_orderkey % 8)::int n, (1 + o_orderkey // 4 % 4)::int c, (o_orderkey // 16 % 2)::int gap,
  (['add', 'replace', 'revoke', 'suppress'])[(1 + o_orderkey // 7 % 4)::int] verb, (['Lei', 'Decreto', 'LC', 'Portaria'])[(1 + o_orderkey % 4)::int] kind from orders),
v as (select *, list_transform(range(0, c), lambda i: n + i + case when i = c - 1 and c > 1 then gap else 0 end) vs from o),
s as (select *, list_transform(vs, lambda x: case lev when 2 then {_ROMANS}[x] when 3 then '“' || chr((96 + x)::int) || '”' else x || case when x <= 9 then 'º' else '' end end) shown from v),
e as (select *, case when c = 1 then shown[1] when c >= 3 and gap = 0 then shown[1] || ' a ' || shown[c] else array_to_string(shown[:-2], ', ') || ' e ' || shown[c] end said,
  'art. ' || a || case when a <= 9 then 'º' else '' end art from s),
g as (select *, case lev when 0 then case when c > 1 then 'arts. ' else 'art. ' end || said
  else (case lev when 1 then case when c > 1 then '§§ ' else '§ ' end when 2 then case when c > 1 then 'incisos ' else 'inciso ' end else case when c > 1 then 'alíneas ' else 'alínea ' end end) || said
   || case when verb = 'add' then ' ao ' else ' do ' end || case when lev = 3 then 'inciso II do ' else '' end || art end as what from e),
p as (select *, (case when lev = 3 then 'a' else 'o' end) || (case when c > 1 then 's' else '' end) ending from g)
select k as o_orderkey, case verb when 'add' then 'Acrescid' || ending || ' ' || ending || ' ' when 'revoke' then 'Revogad' || ending || ' ' || ending || ' ' when 'suppress' then 'Suprimid' || ending || ' ' || ending || ' '
  else 'Redação dada ' || case when lev = 3 then 'à' else 'ao' end || (case when c > 1 then 's' else '' end) || ' ' end || what
 || case when kind = 'Decreto' then ' pelo ' else ' pela ' end || kind || ' ' || (k % 9000 + 1) || '/' || strftime(d, '%y')
 || case when k % 5 = 0 then '.' when k % 5 = 1 then ', efeitos de ' || strftime(d, '%d.%m.%y') || ' a ' || strftime((d + 100)::date, '%d.%m.%y') || '.' else ', efeitos a partir de ' || strftime(d, '%d.%m.%y') || '.' end as note from p
"""


@query(_NOTES)
def notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note of each change: one provision or several siblings, added, replaced, revoked or suppressed."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    o = o.select("*", (k % 4).cast("int").alias("lev"), (k % 150 + 1).cast("string").alias("a"), (k % 8 + 1).cast("int").alias("n"), F.expr("int(div(o_orderkey, 4L) % 4) + 1").alias("c"), F.expr("int(div(o_orderkey, 16L) % 2)").alias("gap"))
    numbers = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.col("n") + i + F.when((i == F.col("c") - 1) & (F.col("c") > 1), F.col("gap")).otherwise(0))
    shown = F.transform(numbers, lambda x: F.when(F.col("lev") == 2, text.roman(x)).when(F.col("lev") == 3, F.char(x + 96)).otherwise(x.cast("string")))
    o = o.withColumn("values", shown)
    at = lambda i: F.when(F.col("lev") == i, F.col("values")[0])
    key = F.struct(
        F.lit("PRINCIPAL").alias("corpus"), F.coalesce(at(0), F.col("a")).alias("article"), F.coalesce(at(1), F.lit("")).alias("paragraph"),
        F.coalesce(at(2), F.when(F.col("lev") == 3, "II"), F.lit("")).alias("inciso"), F.coalesce(at(3), F.lit("")).alias("alinea"), F.lit("").alias("item"),
    )
    verb = F.element_at(F.array(*map(F.lit, ("add", "replace", "revoke", "suppress"))), F.expr("int(div(o_orderkey, 7L) % 4) + 1"))
    cite = F.concat(F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int")), F.lit(" "), (k % 9000 + 1).cast("string"), F.lit("/"), F.year("d").cast("string"))
    effects, until = F.when(k % 5 != 0, F.col("d")), F.when(k % 5 == 1, F.date_add("d", 100))
    return o.withColumn("key", key).select("o_orderkey", notes.new_note(verb, F.col("key"), F.col("values"), cite, effects, until, 2).alias("note"))


@query("""
select o_orderkey, case o_orderkey % 3 when 0 then 'Renumerado o parágrafo único para § ' || (2 + o_orderkey % 12) || case when 2 + o_orderkey % 12 <= 9 then 'º' else '' end || ' do art. ' || (10 + o_orderkey % 90)
 when 1 then 'Renumerada a alínea “a” para alínea “' || chr((98 + o_orderkey % 20)::int) || '” do inciso IV do art. ' || (10 + o_orderkey % 90)
 else 'Renumerado o item 1 para item ' || (2 + o_orderkey % 12) || ' da alínea “c” do § 2º do art. ' || (10 + o_orderkey % 90) end || ' pelo Ato ' || o_orderkey || '/' || year(o_orderdate) || ', efeitos a partir de ' || strftime(o_orderdate, '%d.%m.%Y') || '.' as note,
 case o_orderkey % 3 when 0 then '§ ' || (2 + o_orderkey % 12) || case when 2 + o_orderkey % 12 <= 9 then 'º ' else '. ' end when 1 then chr((98 + o_orderkey % 20)::int) || ') ' else (2 + o_orderkey % 12) || '. ' end as label from orders
""")
def rename_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note and the label of a provision that gets another number."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (k % 3).alias("r"))
    of = lambda r, v: F.when(F.col("r") == r, v).otherwise("")
    key = F.struct(
        F.lit("PRINCIPAL").alias("corpus"), (k % 90 + 10).cast("string").alias("article"), F.when(F.col("r") == 0, "UNICO").when(F.col("r") == 2, "2").otherwise("").alias("paragraph"), of(1, "IV").alias("inciso"),
        F.when(F.col("r") == 1, "a").when(F.col("r") == 2, "c").otherwise("").alias("alinea"), of(2, "1").alias("item"),
    )
    new = F.when(F.col("r") == 1, F.char((k % 20 + 98).cast("int"))).otherwise((k % 12 + 2).cast("string"))
    o = o.select("o_orderkey", "d", key.alias("key"), new.alias("new"), F.when(F.col("r") == 0, 1).when(F.col("r") == 1, 3).otherwise(4).alias("lev"))
    cite = F.concat(F.lit("Ato "), k.cast("string"), F.lit("/"), F.year("d").cast("string"))
    note = notes.rename_note(F.col("key"), F.col("new"), cite, F.col("d"), F.lit(None).cast("date"))
    return o.select("o_orderkey", note.alias("note"), notes.new_label(F.col("lev"), F.col("new")).alias("label"))


@query("""
select p_partkey, (1 + p_partkey % 200)::varchar || case when p_partkey % 5 = 0 then '-A' else '' end as article, case when p_partkey % 3 = 0 then 'UNICO' when p_partkey % 3 = 1 then (1 + p_partkey % 20)::varchar else '' end as paragraph,
 case when p_partkey % 2 = 0 then 'XIV' else '' end as inciso, case when p_partkey % 4 = 0 then 'b' else '' end as alinea,
 'art. ' || (1 + p_partkey % 200)::varchar || case when p_partkey % 5 = 0 then '-A' else '' end || case when p_partkey % 3 = 0 then ' / parágrafo único' when p_partkey % 3 = 1 then ' / § ' || (1 + p_partkey % 20) else '' end
 || case when p_partkey % 2 = 0 then ' / inciso XIV' else '' end || case when p_partkey % 4 = 0 then ' / alínea b' else '' end as label from part
""")
def key_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as a person writes them, read and listed again."""
    k = F.col("p_partkey")
    said = F.concat_ws(
        " / ", F.concat(F.lit("Art. "), (k % 200 + 1).cast("string"), F.when(k % 5 == 0, F.lit("-a")).otherwise("")), F.when(k % 3 == 0, "parágrafo único").when(k % 3 == 1, F.concat(F.lit("§ "), (k % 20 + 1).cast("string"), F.lit("º"))),
        F.when(k % 2 == 0, "inciso XIV"), F.when(k % 4 == 0, "alínea “b”"),
    )
    p = table(spark, sf_dir, "part").select("p_partkey", notes.parse_key(said).alias("x"))
    return p.select("p_partkey", "x.article", "x.paragraph", "x.inciso", "x.alinea", notes.key_label(F.col("x")).alias("label"))


@query("""
select o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey || '/' || o_custkey else 'LC 238/' || case when o_orderkey % 4 = 1 then '26' else right(year(o_orderdate)::varchar, 2) end || ' e 3/1999' end as short,
 case when o_orderkey % 4 = 0 then 'Redação original, efeitos até ' || strftime((o_orderdate::date - 1)::date, '%d.%m.%Y') || '.' else 'Redação anterior.' end as closed,
 case o_orderkey % 3 when 0 then 'FEDERAL' when 1 then 'ESTADUAL' else '' end as sphere, case o_orderkey % 2 when 0 then 'LEI_COMPLEMENTAR:' || (1000 + o_orderkey) else 'DECRETO:' || (1000 + o_orderkey) end as law,
 case o_orderkey % 3 when 0 then 'site?idStatus=3&numeroAto=' || o_orderkey || '&ano=2006&ordenacao=MAIS_RECENTES&idAto=101' when 1 then 'http://x/' || o_orderkey end as link,
 year(o_orderdate)::varchar as year from orders
""".replace("o_orderkey || '/' || o_custkey else", "'Lei sem número' else"))
def act_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations, closed notes, spheres, identities, links and years as they are derived from what is said."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    cite = F.when(k % 4 == 0, " Lei sem número").otherwise(F.concat(F.lit("LC 238/"), F.when(k % 4 == 1, "26").otherwise(F.year("d").cast("string")), F.lit(" e 3/1999")))
    kind = F.when(k % 2 == 0, "Lei  Complementar").otherwise("Decreto")
    value = F.when(k % 3 == 0, "=101").when(k % 3 == 1, F.concat(F.lit("http://x/"), k.cast("string"))).otherwise("-")
    return o.select(
        "o_orderkey",
        notes.format_citation(cite, 2).alias("short"),
        notes.fallback_note(k % 4 == 0, F.when(k % 4 == 0, F.col("d"))).alias("closed"),
        notes.sphere(F.when(k % 3 == 0, "Leis Complementares Federais nº 1").when(k % 3 == 1, "Lei Estadual nº 2").otherwise("Lei nº 3")).alias("sphere"),
        notes.identify(F.concat(kind, F.lit(" nº "), F.translate(F.format_number(k + 1000, 0), ",", "."), F.lit(", que dispõe"))).alias("law"),
        notes.act_link(value, k.cast("string"), F.lit("2006"), "site").alias("link"),
        notes.epigraph_year(F.concat(F.lit("LEI Nº 5, DE 3 DE MAIO DE "), F.year("d").cast("string"))).alias("year"),
    )


@query("""
with o as (select o_orderkey k, year(o_orderdate) y, o_custkey c from orders),
t as (select k, 1 as i, 'Lei' as kind, (1000 + k)::varchar as number, '' as year, '' as sphere from o union all select k, 2, 'Lei', c::varchar, y::varchar, '' from o union all select k, 3, 'Lei', '30', '1999', '' from o
 union all select k, 4, 'Decreto', c::varchar, y::varchar, 'ESTADUAL' from o where k % 2 = 0 union all select k, 5, 'Constituição', '', '', 'FEDERAL' from o)
select k as o_orderkey, row_number() over (partition by k order by i)::int - 1 as at, kind, number, year, sphere from t
""")
def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All citations of a line: a list in the plural, a single act, a bill that is none, and a constitution."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    year = F.year("o_orderdate").cast("string")
    single = F.when(k % 2 == 0, F.concat(F.lit(" e no Decreto Estadual nº "), F.col("o_custkey").cast("string"), F.lit(", de 3 de maio de "), year)).otherwise("")
    line = F.concat(
        F.lit("Nos termos das Leis nºs "), F.translate(F.format_number(k + 1000, 0), ",", "."), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("/"), year, F.lit(" e 30, de 5 de março de 1999,"), single,
        F.lit(", do Projeto de Lei nº 7/2020 e da Constituição Federal, por 3 dias."),
    )
    got = o.select("o_orderkey", line.alias("line")).select("o_orderkey", "line", F.posexplode(citations.citations(F.col("line"))).alias("at", "c"))
    # a span is where the citation stands
    return got.where(F.col("c.said") == F.expr("substring(line, c.start + 1, c.end - c.start)")).select("o_orderkey", "at", "c.kind", "c.number", "c.year", "c.sphere")


@query("""
select doc_id, length(p)::int as start, substr(text, length(p) + 1, 5) as removed, 'xyz' as added from
 (select doc_id, text, left(text, (length(text) // 2)::int) as p from documents where length(text) > 20 and not contains('xyz', substr(text, length(text) // 2 + 1, 1)) and not contains('xyz', substr(text, length(text) // 2 + 5, 1)))
""")
def minimal_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least stretch that changes a text into another, where five characters in its middle become three others."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 20).withColumn("half", F.expr("int(length(text) div 2)"))
    docs = docs.where("not contains('xyz', substring(text, half + 1, 1)) and not contains('xyz', substring(text, half + 5, 1))")
    new = F.expr("concat(left(text, half), 'xyz', substring(text, half + 6))")
    return docs.select("doc_id", notes.minimal_edit(F.col("text"), new).alias("e")).select("doc_id", "e.*")
