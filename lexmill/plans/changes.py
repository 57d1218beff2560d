"""Queries that read, check and apply changes to a law. Its provisions are made from orders (articles) and their lines (paragraphs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import acts, changes
from .registry import query, table

_BASE = """
base as (select o_orderkey::varchar as article, '' as paragraph, 'Art. ' || o_orderkey || '. Texto ' || o_orderstatus as text from orders
 union all select l_orderkey::varchar, l_linenumber::varchar, '§ ' || l_linenumber || 'º Prazo de ' || l_quantity::int || ' dias' || case when l_linestatus = 'F' and l_returnflag = 'N' then ' REVOGADO' else '' end from lineitem)
"""


def law(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    none = [F.lit("").alias(p) for p in ("inciso", "alinea", "item")]
    k = F.col("o_orderkey").cast("string")
    articles = o.select(F.lit("PRINCIPAL").alias("corpus"), k.alias("article"), F.lit("").alias("paragraph"), *none, F.concat(F.lit("Art. "), k, F.lit(". Texto "), "o_orderstatus").alias("text"))
    n = F.col("l_linenumber").cast("string")
    said = F.concat(F.lit("§ "), n, F.lit("º Prazo de "), F.col("l_quantity").cast("int").cast("string"), F.lit(" dias"), F.expr("if(l_linestatus = 'F' and l_returnflag = 'N', ' REVOGADO', '')"))
    return articles.union(li.select(F.lit("PRINCIPAL"), F.col("l_orderkey").cast("string"), n, *none, said))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements, revocations and suppressions of lines by their flags, an added line for some orders, and others with new numbers."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    empty = {p: F.lit("") for p in ("inciso", "alinea", "item")}
    action = F.when(F.col("l_returnflag") == "R", "revoke").when(F.col("l_returnflag") == "A", "replace").otherwise("suppress")
    lines = li.where("l_returnflag != 'N' or l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("article"), F.col("l_linenumber").cast("string").alias("paragraph"), action.alias("action"), F.when(action == "replace", F.concat(F.lit("§ novo "), F.col("l_suppkey").cast("string"))).alias("text"))
    added = o.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").cast("string").alias("article"), F.lit("99").alias("paragraph"), F.lit("add").alias("action"), F.lit("§ 99. Novo").alias("text"))
    moved = o.where("o_orderkey % 10 = 1").select(F.col("o_orderkey").cast("string").alias("article"), F.lit("").alias("paragraph"), F.lit("rename").alias("action"), F.lit(None).cast("string").alias("text"))
    ops = lines.union(added).union(moved).withColumns({"corpus": F.lit("PRINCIPAL"), **empty, "note": F.concat(F.lit("nota "), "action")})
    return ops.withColumn("new", F.when(F.col("action") == "rename", F.concat("article", F.lit("-A"))))


@query(f"""
with {_BASE},
ops as (select l_orderkey::varchar as article, l_linenumber::varchar as paragraph, case l_returnflag when 'R' then 'revoke' when 'A' then 'replace' else 'suppress' end as action, '§ novo ' || l_suppkey as text from lineitem where l_returnflag <> 'N' or l_quantity > 45),
done as (select b.article, b.paragraph, case action when 'replace' then o.text when 'revoke' then '§ ' || b.paragraph || 'º REVOGADO' when 'suppress' then '§ ' || b.paragraph || 'º SUPRIMIDO' else b.text end as text,
 'nota ' || action as note from base b left join ops o on b.article = o.article and b.paragraph = o.paragraph)
select case when article::bigint % 10 = 1 then article || '-A' else article end as article, paragraph, text, case when article::bigint % 10 = 1 and paragraph = '' then 'nota rename' else note end as note from done
union all select o_orderkey::varchar, '99', '§ 99. Novo', 'nota add' from orders where o_orderkey % 10 = 0
""")
def apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law after a plan: wordings replaced, revoked, suppressed and added, and articles renumbered with what stands under them."""
    return changes.apply_plan(law(spark, sf_dir), plan(spark, sf_dir)).select("article", "paragraph", "text", "note")


@query(f"""
with {_BASE},
ops as (select o_orderkey k, case o_orderkey % 9 when 0 then '' when 1 then (o_orderkey + 100000000)::varchar else o_orderkey::varchar end as article, case when o_orderkey % 9 in (2, 3, 7, 8) then '1' when o_orderkey % 9 = 4 then '98' else '' end as paragraph,
 case o_orderkey % 9 when 3 then 'add' when 4 then 'add' when 5 then 'rename' when 6 then 'rename' when 2 then 'revoke' else 'replace' end as action, case when o_orderkey % 9 = 7 then ' ' else 'x' end as text from orders),
there as (select article, paragraph, count(*) n, max(regexp_matches(upper(text), '\\bREVOGAD[OA]\\b')::int) gone from base group by 1, 2)
select k as o_orderkey, case when o.article = '' then 'sem artigo' when k % 9 = 8 then 'fim antes do início' when action = 'replace' and trim(o.text) = '' then 'texto vazio' when action <> 'add' and n is null then 'destino não existe' when action <> 'add' and n > 1 then 'destino não é único'
 when action = 'add' and n is not null then 'já existe' when action = 'revoke' and gone = 1 then 'já revogado' when k % 9 = 5 and exists (select 1 from orders x where x.o_orderkey = k + 1) and (k + 1) % 9 not in (5, 6) then 'número ocupado' else '' end as reason
from ops o left join there t on o.article = t.article and o.paragraph = t.paragraph
""")
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason for which a change cannot be made; empty where it can."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("effects"))
    k = F.col("o_orderkey")
    m = k % 9
    ops = o.select(
        "o_orderkey", "effects", F.lit("PRINCIPAL").alias("corpus"), F.when(m == 0, "").when(m == 1, (k + 100000000).cast("string")).otherwise(k.cast("string")).alias("article"),
        F.when(m.isin(2, 3, 7, 8), "1").when(m == 4, "98").otherwise("").alias("paragraph"), F.lit("").alias("inciso"), F.lit("").alias("alinea"), F.lit("").alias("item"),
        F.when(m.isin(3, 4), "add").when(m.isin(5, 6), "rename").when(m == 2, "revoke").otherwise("replace").alias("action"), F.when(m == 7, " ").otherwise("x").alias("text"),
        F.when(m == 8, F.date_sub("effects", 1)).alias("until"), F.when(m == 5, (k + 1).cast("string")).when(m == 6, (k + 500000000).cast("string")).alias("new"),
    )
    return changes.check(ops, law(spark, sf_dir)).select("o_orderkey", "reason")


@query("""
with o as (select o_orderkey k, 1 + o_orderkey % 200 a, (1 + o_orderkey % 9)::varchar p from orders)
select k as o_orderkey, 1 as command, 'replace' as verb, a::varchar as article, '' as paragraph, '' as inciso, 2 as lines from o union all select k, 2, 'revoke', (a + 1)::varchar, p, '', 0 from o
union all select k, 3, 'add', (a + 2)::varchar, '', i, 3 from o, (select unnest(['I', 'II', 'III']) i) union all select k, 4, 'rename', (a + 3)::varchar, 'UNICO', '', 0 from o where k % 2 = 0
""")
def operations_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of an amending act: what each command does, to which provisions, and how many lines of new wording it has."""
    k = F.col("o_orderkey")
    a = lambda i: (k % 200 + 1 + i).cast("string")
    lit, cat = F.lit, F.concat
    said = F.array(
        cat(lit("Art. 1º O art. "), a(0), lit(" da Lei nº 5.530, de 13 de janeiro de 1989, passa a vigorar com a seguinte redação:")), cat(lit("“Art. "), a(0), lit(". O prazo é outro.")), lit("Parágrafo único. O resto fica.” (NR)"),
        cat(lit("Art. 2º Fica revogado o § "), (k % 9 + 1).cast("string"), lit("º do art. "), a(1), lit(" da Lei nº 5.530.")),
        cat(lit("Art. 3º Ficam acrescidos os incisos I a III ao art. "), a(2), lit(" da mesma Lei:")), lit("“I - um;"), lit("II - dois;"), lit("III - três.” (AC)"),
        F.when(k % 2 == 0, cat(lit("Art. 4º Fica renumerado o parágrafo único do art. "), a(3), lit(" para § 1º."))).otherwise("Art. 4º Nada mais muda."), lit("Art. 5º Esta Lei entra em vigor na data de sua publicação."),
    )
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(said).alias("seq", "line"))
    found = changes.commands(lines, "o_orderkey", "seq", "line").select("o_orderkey", "command", "verb", F.size("body").alias("lines"), F.regexp_replace("head", r"^Art\. \d+º ", "").alias("head"))
    # what a provision becomes is no target
    heads = found.withColumn("head", F.regexp_replace("head", r" para § \d+º", ""))
    # "ao art." goes on with a reference as "do art." does
    heads = heads.withColumn("head", F.regexp_replace("head", r" ao art\.", " do art."))
    targets = acts.references(heads, ["o_orderkey", "command"], "head")
    return targets.join(found, ["o_orderkey", "command"]).select("o_orderkey", "command", "verb", "article", "paragraph", "inciso", "lines")


@query("""
with d as (select distinct p_brand, p_size from part), r as (select *, p_size - row_number() over (partition by p_brand order by p_size) g from d)
select p_brand, min(p_size)::varchar as first, max(p_size)::varchar as last, count(*)::int as n from r group by p_brand, g
""")
def siblings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("place"), F.col("p_size").cast("string").alias("number")).distinct()
    return changes.merge_siblings(part, ["p_brand"], "number", "place").select("p_brand", "first", "last", "n")


@query("""
select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) else '' end as article, case when count(distinct l_returnflag) = 1 and count(distinct l_linestatus) = 1 then min(l_linestatus) else '' end as paragraph,
 case when count(distinct l_returnflag) = 1 and count(distinct l_linestatus) = 1 and count(distinct l_linenumber) = 1 then min(l_linenumber)::varchar else '' end as inciso from lineitem group by 1
""")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", F.lit("P").alias("corpus"), F.col("l_returnflag").alias("article"), F.col("l_linestatus").alias("paragraph"), F.col("l_linenumber").cast("string").alias("inciso"), F.lit("").alias("alinea"), F.lit("").alias("item"))
    return changes.common_prefix(rows, ["l_orderkey"]).select("l_orderkey", "article", "paragraph", "inciso")


@query("""
select o_orderkey as article, (select max(l_linenumber) from lineitem where l_orderkey = o_orderkey and l_linenumber * 2 <= o_custkey % 15)::int as after, (select min(l_linenumber) from lineitem where l_orderkey = o_orderkey and l_linenumber * 2 > o_custkey % 15)::int as before from orders
""")
def insertion_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a new roman-numbered provision goes among those that there are."""
    there = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article"), text.roman(F.col("l_linenumber") * 2).alias("number"), F.col("l_linenumber").alias("at"))
    number = F.col("o_custkey") % 15
    # 0 goes before all, and an equal number goes after the one that has it
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article"), F.when(number == 0, "0").otherwise(text.roman(number)).alias("number"))
    return changes.insertion_place(new, there, ["article"], "number", "at").select("article", "after", "before")


@query("""
with n as (select l_orderkey k, count(*) c from lineitem group by 1)
select k::varchar as article, 'UNICO' as paragraph, '1' as new from n where c = 1 and k % 2 = 0 and k % 6 <> 0
""")
def implied_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sole paragraph becomes § 1º where another is added and the act does not say so itself."""
    base = law(spark, sf_dir)
    alone = F.count(F.when(F.col("paragraph") != "", 1)).over(Window.partitionBy("article")) == 1
    base = base.withColumn("__alone", alone).withColumn("paragraph", F.when(F.col("__alone") & (F.col("paragraph") != ""), "UNICO").otherwise(F.col("paragraph"))).drop("__alone")
    o = table(spark, sf_dir, "orders")
    some = lambda cond, number, action: o.where(cond).select(F.lit("PRINCIPAL").alias("corpus"), F.col("o_orderkey").cast("string").alias("article"), F.lit(number).alias("paragraph"), F.lit("").alias("inciso"), F.lit(action).alias("action"))
    ops = some("o_orderkey % 2 = 0", "2", "add").union(some("o_orderkey % 6 = 0", "UNICO", "rename"))
    return changes.implied_renumbering(ops, base).select("article", "paragraph", "new")


@query("""
select o_orderkey, 'A' || lpad(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::varchar, 3, '0') as id,
 row_number() over (partition by o_custkey order by case when o_orderkey % 3 > 0 then 0 else 1 end, case when o_orderkey % 3 > 0 then -(o_orderkey % 50) else o_orderkey % 50 end, o_orderkey)::int as turn from orders
""")
def change_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of an act's changes, and the order in which renumberings are made so that none takes a number in use."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", (F.col("o_orderkey") % 50).alias("old"), (F.col("o_orderkey") % 50 + F.when(F.col("o_orderkey") % 3 > 0, 2).otherwise(-2)).alias("new"))
    o = changes.with_ids(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(*changes.rename_order(F.col("old"), F.col("new")), "o_orderkey"))
    return o.select("o_orderkey", "id", turn.alias("turn"))


@query(f"with {_BASE} select article, paragraph, case when article::bigint % 3 = 0 then replace(replace(text, 'Prazo', 'Termo'), 'dias', 'meses') else text end as text, article::bigint % 3 = 0 and paragraph <> '' as changed from base")
def replace_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression that a command puts for another, in all provisions of an article."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("article"))
    said = F.explode(F.array(F.lit("No art. 5º, a expressão “Prazo” fica substituída por “Termo”."), F.lit("A expressão “dias” passa a ser “meses”.")))
    swaps = o.select("article", said.alias("said")).select("article", changes.word_change(F.col("said")).alias("c")).select("article", "c.old", "c.new")
    return changes.replace_words(law(spark, sf_dir), swaps, ["article"]).select("article", "paragraph", "text", "changed")


@query(f"with {_BASE} select b.article, paragraph from base b where paragraph <> '' and b.article::bigint % 4 = 0")
def descendant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provisions under each of some articles."""
    base = law(spark, sf_dir)
    targets = base.where("paragraph = '' and cast(article as bigint) % 4 = 0").select(F.col("article").alias("target"), *changes.KEY)
    return changes.descendants_of(base, targets).select("article", "paragraph")


@query("""
with m as (select l_orderkey, l_linenumber, l_partkey % 20 n, case when l_linenumber % 2 = 0 then year(l_shipdate)::varchar else '' end y, case when l_suppkey % 3 = 0 then 'FEDERAL' when l_suppkey % 3 = 1 then 'ESTADUAL' else '' end s from lineitem)
select l_orderkey, l_linenumber from m where not exists (select 1 from orders o where o.o_orderkey = m.l_orderkey and o.o_custkey % 20 = m.n and (m.y = '' or m.y = year(o_orderdate)::varchar) and (m.s = '' or m.s = 'ESTADUAL'))
""")
def self_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions less those of the act itself, by kind, number, year and sphere."""
    s = F.col("l_suppkey") % 3
    m = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("act"), "l_linenumber", F.lit("Lei").alias("kind"), (F.col("l_partkey") % 20).alias("number"), F.when(F.col("l_linenumber") % 2 == 0, F.year("l_shipdate").cast("string")).otherwise("").alias("year"),
        F.when(s == 0, "FEDERAL").when(s == 1, "ESTADUAL").otherwise("").alias("sphere"),
    )
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("act"), F.lit("Lei").alias("kind"), (F.col("o_custkey") % 20).alias("number"), F.year("o_orderdate").cast("string").alias("year"), F.lit("ESTADUAL").alias("sphere"))
    return changes.self_citations(m, own, ["act"]).select(F.col("act").alias("l_orderkey"), "l_linenumber")
