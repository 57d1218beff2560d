"""All queries of the document engine and their SQL.

Where an operator parses text, the query renders the text from columns and the SQL computes the result from the columns, so that the
two have nothing in common.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, keys, text
from ..operators import acts, relational, sequence
from ..sources import documents as scan
from ..sources import pages as html
from .registry import QUERIES, SQL, query, table  # noqa: F401

def _grouped(number: F.Column) -> F.Column:
    return F.translate(F.format_number(number, 0), ",", ".")


def rendered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation for each order line: kind by line number, number by part, year by ship date, in two styles."""
    kinds = F.array(*map(F.lit, ("Lei", "Decreto", "Portaria", "Lei Complementar", "Resolução", "Medida Provisória", "Decreto-Lei")))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    kind = F.element_at(kinds, F.col("l_linenumber") % 7 + 1)
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month("l_shipdate"))
    long = F.concat(F.lit("conforme a "), kind, F.lit(" nº "), _grouped(F.col("l_partkey")), F.lit(", de "), F.dayofmonth("l_shipdate").cast("string"), F.lit(" de "), month, F.lit(" de "), F.year("l_shipdate").cast("string"), F.lit(", art. 2º"))
    short = F.concat(F.lit("nos termos do(a) "), F.upper(kind), F.lit(" "), F.col("l_partkey").cast("string"), F.lit("/"), F.year("l_shipdate").cast("string"), F.lit("."))
    return li.withColumn("line", F.when(F.col("l_orderkey") % 2 == 0, long).otherwise(short))


_KIND = "(['Lei','Decreto','Portaria','Lei Complementar','Resolução','Medida Provisória','Decreto-Lei'])[l_linenumber % 7 + 1]"


@query(f"""
with m as (select {_KIND} as kind, l_partkey as p, year(l_shipdate) as y, {_KIND} || '|' || l_partkey || '|' || year(l_shipdate) as key from lineitem),
links as (select p_partkey as p, case when p_partkey % 5 = 0 then '-' when p_partkey % 3 = 0 then 'user/' || p_partkey when p_partkey % 2 = 0 then 'site/' || p_partkey end as url from part),
r as (select m.kind, m.key, case when url is null then 'missing' when url = '-' then 'no link' else 'linked' end as status, url from m left join links on m.p = links.p)
select kind, status, count(*)::bigint as mentions, count(distinct key)::bigint as acts, count(distinct case when status = 'linked' then url end)::bigint as targets from r group by kind, status
""")
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions to keys to links: a user's table and then a registry; '-' says that there is no link."""
    mentions = rendered_citations(spark, sf_dir).select(text.citation(F.col("line")).alias("c")).select("c.*")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"))
    user = part.where("number % 3 = 0 or number % 5 = 0").withColumn("url", F.when(F.col("number") % 5 == 0, "-").otherwise(F.concat(F.lit("user/"), "number")))
    site = part.where("number % 2 = 0").withColumn("url", F.concat(F.lit("site/"), "number"))
    links = relational.by_precedence([t.withColumn("number", F.col("number").cast("string")) for t in (user, site)], ["number"], "url")
    status = F.when(F.col("url").isNull(), "missing").when(F.col("url") == "-", "no link").otherwise("linked")
    # mentions become keys with counts before the links are joined
    counted = mentions.groupBy("kind", "number", "key").agg(F.count(F.lit(1)).alias("n"))
    out = counted.join(links, "number", "left").withColumn("status", status)
    return out.groupBy("kind", "status").agg(
        F.sum("n").cast("long").alias("mentions"), F.count("key").cast("long").alias("acts"), F.countDistinct(F.when(F.col("status") == "linked", F.col("url"))).cast("long").alias("targets")
    )


@query("""
select p_partkey, case when p_partkey % 3 = 0 then 'u' || p_size else 's' || p_brand end as url, case when p_partkey % 3 = 0 then 0 else 1 end as source
from part where p_partkey % 3 = 0 or p_partkey % 2 = 0
""")
def link_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    user = part.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("u"), "p_size").alias("url"))
    site = part.where("p_partkey % 2 = 0").select("p_partkey", F.concat(F.lit("s"), "p_brand").alias("url"))
    return relational.by_precedence([user, site], ["p_partkey"], "url")


@query("""
with t1 as (select p_brand b, p_size s, count(distinct p_type) n, min(p_type) v from part where p_partkey % 4 = 0 group by 1, 2),
t2 as (select p_brand b, count(distinct p_type) n, min(p_type) v from part where p_partkey % 4 = 0 group by 1)
select p_partkey, case when t1.n is null and t2.n is null then 'missing' when coalesce(t1.n, t2.n) > 1 then 'ambiguous' else 'found' end as status,
case when coalesce(t1.n, t2.n) = 1 then coalesce(t1.v, t2.v) end as p_type, case when t1.n is not null then 0 when t2.n is not null then 1 end::int as tier
from part left join t1 on p_brand = t1.b and p_size = t1.s left join t2 on p_brand = t2.b
""")
def tiered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    registry = part.where("p_partkey % 4 = 0").select("p_brand", "p_size", "p_type").distinct()
    return relational.tiered_lookup(part.select("p_partkey", "p_brand", "p_size"), registry, [["p_brand", "p_size"], ["p_brand"]], "p_type", ["p_partkey"])


@query("""
with k as (select p_brand, p_size, count(distinct p_type) c, min(p_type) m from part where p_partkey % 3 > 0 group by 1, 2)
select p_partkey, case when p_partkey % 3 > 0 then p_type when c = 1 then m end as filled from part p left join k on p.p_brand = k.p_brand and p.p_size = k.p_size
""")
def fill_missing_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing attribute is filled where all mentions of the key that state it agree."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("stated"))
    return relational.fill_single_valued(part, ["p_brand", "p_size"], "stated", "filled").select("p_partkey", "filled")


@query("select min(p_partkey) as p_partkey, p_brand, p_size, p_type from part group by p_brand, p_size, p_type having count(*) = 1")
def unique_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    return relational.unique_or_nothing(part, ["p_brand", "p_size", "p_type"])


@query("""
select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and (year(o.o_orderdate) = year(l.l_shipdate) or o.o_orderstatus = 'P') and l.l_linenumber % 2 = 0)
""")
def self_citation_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions less those of the act itself: same number, and the year equal or unknown."""
    mentions = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.year("l_shipdate").alias("y"))
    acts = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate")).alias("oy"))
    own = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("oy").isNull() | (F.col("oy") == F.col("y"))) & (F.col("l_linenumber") % 2 == 0)
    return mentions.join(acts, own, "left_anti").select("l_orderkey", "l_linenumber")


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer")
    inner = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("i_id"), F.lit("W").alias("i_corpus"), F.col("n_regionkey").alias("i_a"), F.col("n_nationkey").alias("i_b"), F.col("c_mktsegment").alias("i_c"))
    none = lambda t: F.lit(None).cast(t)
    rules = r.select(F.col("r_regionkey").alias("o_id"), F.lit("W").alias("o_corpus"), F.col("r_regionkey").alias("o_a"), none("int").alias("o_b"), none("string").alias("o_c"))
    rules = rules.union(n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey") + 100, F.lit("W"), "n_regionkey", "n_nationkey", none("string")))
    # a part may be open between two that are set, or before one
    rules = rules.union(r.select(F.col("r_regionkey") + 200, F.lit("W"), "r_regionkey", none("int"), F.lit("BUILDING")))
    return rules.union(r.where("r_regionkey = 0").select(F.lit(300), F.lit("W"), none("int"), none("int"), F.lit("MACHINERY"))), inner


@query("""
with c as (select c_custkey, n_regionkey a, n_nationkey b, c_mktsegment s from customer join nation on c_nationkey = n_nationkey),
r as (select r_regionkey id, r_regionkey a, null::int b, null::varchar s from region union all select n_nationkey + 100, n_regionkey, n_nationkey, null from nation where n_nationkey % 2 = 0
 union all select r_regionkey + 200, r_regionkey, null, 'BUILDING' from region union all select 300, null, null, 'MACHINERY')
select r.id::int as rule, count(*)::bigint as customers, min(c_custkey)::bigint as first from r join c on (r.a is null or r.a = c.a) and (r.b is null or r.b = c.b) and (r.s is null or r.s = c.s) group by 1
""")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules, inner = _places(spark, sf_dir)
    hit = relational.contained_in(rules, inner, ["corpus"], ["a", "b", "c"])
    return hit.groupBy(F.col("o_id").cast("int").alias("rule")).agg(F.count(F.lit(1)).cast("long").alias("customers"), F.min("i_id").cast("long").alias("first"))


@query("""
with o as (select o_orderkey id, o_custkey c, case when o_orderpriority like '1%' or o_orderkey % 5 = 0 then null else o_orderstatus end s, case when o_orderpriority like '1%' or o_orderkey % 3 = 0 then null else o_orderpriority end p,
 case when o_orderkey % 2 = 0 then 'subtree' else 'head' end scope from orders)
select least(a.id, b.id)::bigint as a_id, greatest(a.id, b.id)::bigint as b_id from o a join o b on a.c = b.c and a.id < b.id
where (a.s is not distinct from b.s and a.p is not distinct from b.p) or (a.scope = 'subtree' and (a.s is null or a.s = b.s) and (a.p is null or a.p = b.p))
 or (b.scope = 'subtree' and (b.s is null or b.s = a.s) and (b.p is null or b.p = a.p))
""")
def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = F.col("o_orderpriority").like("1%")
    ops = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.when(~first & (F.col("o_orderkey") % 5 != 0), F.col("o_orderstatus")).alias("s"),
        F.when(~first & (F.col("o_orderkey") % 3 != 0), F.col("o_orderpriority")).alias("p"), F.when(F.col("o_orderkey") % 2 == 0, "subtree").otherwise("head").alias("scope"),
    )
    return relational.overlapping_keys(ops, ["c"], ["s", "p"])


@query("""
select l.l_orderkey, l.l_linenumber, (select max(o2.o_orderdate) from orders o2 where o2.o_custkey = o.o_custkey and o2.o_orderdate < l.l_shipdate)::date as note_date
from lineitem l join orders o on l.l_orderkey = o.o_orderkey """)
def origin_note_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of the key before each row, without a join by range."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("t"))
    rows = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "t")
    notes = o.select("o_custkey", F.col("o_orderdate").alias("t"), F.to_date("o_orderdate").alias("noted"))
    return sequence.nearest_before(rows, notes, ["o_custkey"], "t", "noted", "note_date").select("l_orderkey", "l_linenumber", "note_date")


@query("""
select e.event_id, (select min(x.event_id) from events x where x.user_id = e.user_id and x.event_type = 'purchase' and (x.ts, x.event_id) >= (e.ts, e.event_id)
 and (x.ts, x.event_id) = (select min((y.ts, y.event_id)) from events y where y.user_id = e.user_id and y.event_type = 'purchase' and (y.ts, y.event_id) >= (e.ts, e.event_id)))::bigint as anchor from events e
""")
def next_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first anchor at or after each row."""
    ahead = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, Window.unboundedFollowing)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return e.select("event_id", F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(ahead).cast("long").alias("anchor"))


_LEVELS = "case event_type when 'purchase' then 0 when 'signup' then 0 when 'click' then 1 when 'search' then 2 else 2 end"


def _leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", place.alias("i"), F.expr(_LEVELS).alias("level"), F.col("event_id").cast("string").alias("number"))


_LEVELED = f"with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) i, {_LEVELS} as level, event_id::varchar as number from events)"


@query(f"""{_LEVELED},
a as (select *, max(case when level = 0 then i end) over (partition by user_id order by i) a0, max(case when level <= 1 then i end) over (partition by user_id order by i) b0 from e),
b as (select *, max(case when level = 1 then i end) over (partition by user_id order by i) a1, max(case when level = 2 then i end) over (partition by user_id order by i) a2 from a)
select b.event_id, x.number as article, y.number as paragraph, z.number as inciso from b
left join e x on x.user_id = b.user_id and x.i = b.a0 left join e y on y.user_id = b.user_id and y.i = b.a1 and b.a1 > coalesce(b.a0, 0) left join e z on z.user_id = b.user_id and z.i = b.a2 and b.a2 > coalesce(b.b0, 0)
""")
def hierarchy_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.fill_context(_leveled(spark, sf_dir), ["user_id"], ["i"], "level", "number", ["article", "paragraph", "inciso"]).select("event_id", "article", "paragraph", "inciso")


@query(f"""{_LEVELED}
select a.event_id, (select min(b.i) from e b where b.user_id = a.user_id and b.i > a.i and b.level <= a.level)::int as "end" from e a
""")
def next_same_or_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.next_not_deeper(_leveled(spark, sf_dir), ["user_id"], "i", "level", 3).select("event_id", "end")


@query(f"""{_LEVELED},
spans as (select user_id, i, coalesce((select min(b.i) from e b where b.user_id = a.user_id and b.i > a.i and b.level <= a.level), 1000000000) as e, event_id, level from e a)
select s.event_id, count(c.event_id)::bigint as descendants from spans s left join e c on c.user_id = s.user_id and c.i > s.i and c.i < s.e where s.level = 0 group by 1
""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows stand within each top provision: an extent is a run, so no join is needed."""
    rows = sequence.next_not_deeper(_leveled(spark, sf_dir), ["user_id"], "i", "level", 3)
    last = F.max("i").over(Window.partitionBy("user_id"))
    return rows.withColumn("__last", last).where("level = 0").select("event_id", (F.coalesce("end", F.col("__last") + 1) - F.col("i") - 1).cast("long").alias("descendants"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def missing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(children, "o_orderkey", "left_anti")


@query("""
with e as (select *, case event_type when 'purchase' then 0 when 'signup' then 0 when 'click' then 1 end as evt from events),
p as (select event_id, event_type, max(case when evt is not null then (ts, event_id) end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last from e)
select p.event_id, (p.event_type = 'click' or coalesce(x.evt, 0) = 1) as inside from p left join e x on x.event_id = p.last[2]
""".replace("(ts, event_id) end", "row(ts, event_id) end"))
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = sequence.inside_state(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type").isin("purchase", "signup"))
    return out.select("event_id", "inside")


@query("""
with f as (select user_id, event_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w > interval 6 hour then 1 else 0 end s from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(s) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)::bigint island from f)
select user_id, island, count(*)::bigint as n, min(event_id)::bigint as first from g group by 1, 2
""")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) > F.expr("interval 6 hours")
    out = sequence.islands(e, ["user_id"], ["ts", "event_id"], gap)
    return out.groupBy("user_id", "island").agg(F.count(F.lit(1)).cast("long").alias("n"), F.min("event_id").cast("long").alias("first"))


@query("""
select o_orderkey, o_orderdate::date as effects, (lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey) - 1)::date as until,
strftime((lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey) - 1)::date, '%d.%m.%y') as printed from orders
""")
def version_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.to_date("o_orderdate").alias("effects"))
    after = F.lead("effects").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select("o_orderkey", "effects", F.date_sub(after, 1).alias("until"), dates.until(after, 2).alias("printed"))


@query("""
with o as (select o_orderkey, o_orderdate::date s, lead(o_orderdate::date) over (partition by o_custkey order by o_orderdate, o_orderkey) - (o_orderkey % 200)::int as d from orders)
select o_orderkey, case when d is null then 'efeitos a partir de ' || strftime(s, '%d.%m.%Y') when d <= s then 'sem efeitos' else 'efeitos de ' || strftime(s, '%d.%m.%Y') || ' a ' || strftime((d - 1)::date, '%d.%m.%Y') end as note from o
""")
def never_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a note is closed by a later change: with the day before, or as never in force if the change takes effect first."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.to_date("o_orderdate").alias("s"))
    after = F.lead("s").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = o.withColumn("d", F.date_sub(after, (F.col("o_orderkey") % 200).cast("int")))
    note = F.concat(F.lit("efeitos a partir de "), dates.brazilian(F.col("s")))
    return o.select("o_orderkey", acts.close_note(note, F.col("s"), F.col("d"), F.lit(True)).alias("note"))


@query("""
with taken as (select distinct l_orderkey k, l_linenumber n from lineitem where l_returnflag = 'R'),
free as (select l_orderkey k, l_linenumber n, row_number() over (partition by l_orderkey order by l_linenumber) r from lineitem l where not exists (select 1 from taken t where t.k = l.l_orderkey and t.n = l.l_linenumber)),
moved as (select l_orderkey k, l_linenumber n, row_number() over (partition by l_orderkey order by l_linenumber) r from lineitem where l_linestatus = 'O')
select m.k as l_orderkey, m.n as l_linenumber, f.n as new_number from moved m left join free f on m.k = f.k and m.r = f.r
""")
def shift_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to renumber get the free numbers in order, those taken being skipped."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    taken = li.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    free = li.join(taken, ["l_orderkey", "l_linenumber"], "left_anti").select("l_orderkey", F.col("l_linenumber").alias("new_number"), rank.alias("r"))
    return li.where("l_linestatus = 'O'").withColumn("r", rank).join(free, ["l_orderkey", "r"], "left").select("l_orderkey", "l_linenumber", "new_number")


@query("select p_partkey, n::varchar as number from (select p_partkey, unnest(range(p_size, p_size + 1 + p_partkey % 7)) n from part)")
def range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman ranges such as III a VII, expanded and read back."""
    part = table(spark, sf_dir, "part").select("p_partkey", text.roman(F.col("p_size")).alias("a"), text.roman((F.col("p_size") + F.col("p_partkey") % 7).cast("int")).alias("b"))
    return part.select("p_partkey", F.explode(keys.expand(F.col("a"), F.col("b"))).alias("n")).select("p_partkey", text.roman_value(F.col("n")).cast("string").alias("number"))


@query("select p_brand, string_agg(s, ',' order by p_size, p_partkey % 3) as ordered from (select distinct p_brand, p_size, p_partkey % 3 as p_partkey, p_size || case p_partkey % 3 when 1 then '-A' when 2 then '-B' else '' end s from part) group by 1")
def legal_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with suffixes in legal order: 2, 2-A, 2-B, 10."""
    number = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("", "-A", "-B"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    part = table(spark, sf_dir, "part").select("p_brand", number.alias("s")).distinct()
    ordered = F.sort_array(F.collect_list(F.struct(keys.sort_key(F.col("s")).alias("k"), "s")))
    return part.groupBy("p_brand").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), ",").alias("ordered"))


@query("select source, ch, count(*)::bigint as n from (select source, unnest(string_split(regexp_replace(text, '\\s+', '', 'g'), '')) as ch from documents) where ch <> '' group by 1, 2")
def char_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = F.explode(F.split(F.regexp_replace("text", r"\s+", ""), "")).alias("ch")
    return relational.bag(table(spark, sf_dir, "documents").select("source", chars).where("ch != ''"), ["source", "ch"])


@query("""
with a as (select l_partkey k, count(*)::bigint n from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey k, count(*)::bigint n from lineitem where l_returnflag = 'R' group by 1)
select coalesce(a.k, b.k) as l_partkey, coalesce(a.n, 0)::bigint as n_left, coalesce(b.n, 0)::bigint as n_right from a full join b on a.k = b.k where coalesce(a.n, 0) <> coalesce(b.n, 0)
""")
def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return relational.bag_difference(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), ["l_partkey"])


@query("""
select c_mktsegment, (case when c_acctbal < 0 then '-' else '' end || case when c_custkey % 2 = 0 then replace(format('{:,}', a // 100), ',', '.') else (a // 100)::varchar end || ',' || lpad((a % 100)::varchar, 2, '0')) as amount,
count(*)::bigint as n from (select *, round(abs(c_acctbal) * 100)::bigint as a from customer) group by 1, 2
""")
def money_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole amounts as they are written, with and without dots and signs, found among percentages and other numbers."""
    c = table(spark, sf_dir, "customer")
    cents = F.round(F.abs("c_acctbal") * 100).cast("long")
    whole = F.expr("div(cents, 100L)")
    c = c.withColumn("cents", cents)
    said = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""), F.when(F.col("c_custkey") % 2 == 0, _grouped(whole)).otherwise(whole.cast("string")), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("10,00%\nem 2024 sobre "), F.when(F.col("c_custkey") % 3 == 0, "R$ ").otherwise(""), said, F.lit(" e 7,5 ou 12,25% em 3 dias"))
    return relational.bag(c.select("c_mktsegment", F.explode(text.money(line)).alias("amount")), ["c_mktsegment", "amount"])


@query(r"""
with t as (select lang, regexp_split_to_array(text, '\r\n|\r|\n') as ls from documents where text is not null),
l as (select lang, unnest(ls) as line, unnest(list_concat([''], ls[:-2])) as before from t),
w as (select lang, regexp_extract_all(line, '[A-Za-zÀ-ÖØ-öø-ÿ]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*') as ws, regexp_matches(line, '[A-Za-zÀ-ÖØ-öø-ÿ]-\s*$') as behind, regexp_matches(before, '[A-Za-zÀ-ÖØ-öø-ÿ]-\s*$') as ahead from l)
select lang, word, count(*)::bigint as n from (select lang, lower(unnest(ws[1 + ahead::int : len(ws) - behind::int])) as word from w) group by 1, 2
""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each whole word occurs in each language, without the fragments at a line-end hyphen."""
    words = F.explode(text.whole_words(F.split("text", "\r\n|\r|\n"))).alias("word")
    return relational.bag(table(spark, sf_dir, "documents").select("lang", words), ["lang", "word"])


@query("""
with c as (select user_id, event_type, count(*) n, min(event_id) f from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, f) k from c)
select user_id, event_type as style, n::bigint as n from r where k = 1
""")
def mode_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.most_frequent(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id", "style")


@query("""
with r as (select o_custkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders)
select o_custkey, count(*)::bigint as n, count(*) filter (o_orderstatus = 'F')::bigint as yes, count(*) filter (o_orderstatus = 'F') * 2 > count(*) as majority from r where k <= 5 group by 1
""")
def recent_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return sequence.votes(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_orderstatus") == "F", 5)


@query("select p_brand, p_size, arg_max(p_type, p_partkey) as p_type from part group by 1, 2")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type", "p_partkey")
    return relational.keep_last(part, ["p_brand", "p_size"], "p_partkey").select("p_brand", "p_size", "p_type")


@query("""
with o as (select o_orderkey, o_orderdate::date as d, o_orderkey % 8 as k from orders)
select o_orderkey, (case k when 0 then d + (o_orderkey % 120 + 1)::int when 1 then (date_trunc('month', d) + to_months((o_orderkey % 4 + 1)::int))::date when 2 then make_date(year(d) + 1, 1, 1) when 3 then d
 when 4 then d + 90 when 5 then null when 6 then d when 7 then d end)::date as effects, case when k = 6 then (d + 100)::date end::date as until from o
""")
def dates_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of effect in figures and words, counted from the publication, as a period, or not from it at all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("pub"))
    k = F.col("o_orderkey") % 8
    nth = F.element_at(F.array(*map(F.lit, ("", "segundo ", "terceiro ", "quarto "))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    clause = (
        F.when(k == 0, F.concat(F.lit("produz efeitos em "), (F.col("o_orderkey") % 120 + 1).cast("string"), F.lit(" (tantos) dias após a publicação")))
        .when(k == 1, F.concat(F.lit("no primeiro dia do "), nth, F.lit("mês subsequente ao da publicação")))
        .when(k == 2, "a partir de 1º de janeiro do ano subsequente ao da publicação")
        .when(k == 3, "entra em vigor na data de sua publicação")
        .when(k == 4, "noventa dias contados da data de sua publicação")
        .when(k == 5, "até a data de sua publicação")
        .when(k == 6, F.concat(F.lit("efeitos de "), dates.brazilian(F.col("pub")), F.lit(" a "), dates.brazilian(F.date_add("pub", 100))))
        .otherwise(F.concat(F.lit("efeitos a partir de "), F.date_format("pub", "d/MM/yyyy"), F.lit(", ou de 31.02.2020")))
    )
    found = F.get(dates.dates_in(clause, F.col("pub")), F.lit(0))
    return o.select("o_orderkey", found.alias("x")).select("o_orderkey", F.col("x.date").alias("effects"), F.col("x.until").alias("until"))


@query("select o_orderkey, o_orderdate::date as read from orders")
def dates_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the formats that acts use, read back."""
    o = table(spark, sf_dir, "orders")
    formats = ["dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy"]
    written = F.element_at(F.array(*(F.date_format("o_orderdate", f) for f in formats)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    month = F.element_at(F.array(*map(F.lit, dates.MONTHS)), F.month("o_orderdate"))
    named = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit("º de "), month, F.lit(" de "), F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, dates.long_date(named)).otherwise(dates.parse_date(written)).alias("read"))


@query("select n::int as n, n::int as read from range(1, 4000) t(n)")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 4000).select(F.col("id").cast("int").alias("n"), text.roman_value(text.roman(F.col("id"))).cast("int").alias("read"))


@query("select doc_id, upper(strip_accents(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g')))) as folded from documents")
def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_upper(F.col("text")).alias("folded"))


@query("select doc_id, sha256(text) as digest from documents")
def doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)
select doc_id, line_no::int as line_no, length(line)::int as chars, line = upper(line) and regexp_matches(line, '[A-Za-zÀ-ÿ]') and length(line) <= 140 as is_upper from l
""")
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = scan.lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_no", F.length("line").alias("chars"), text.is_upper(F.col("line")).alias("is_upper"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, (len(html) - len(replace(html, '<a ', '')))::bigint // 3 as links, (len(html) - len(replace(html, '<li>', '')))::bigint // 4 as items from pages")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    count = lambda tag: F.regexp_count("html", F.lit(tag)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", got.alias("title"), count("<a ").alias("links"), count("<li>").alias("items"))


@query()
def html_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, tables and pictures of each page in document order."""
    return html.elements(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""
select l_orderkey, l_linenumber, case when l_shipdate < o_orderdate then 'until before effects' when l_quantity <= 0 then 'empty text' when p_partkey is null then 'target missing' when l_discount > 0.08 then 'label differs'
 when l_returnflag = 'R' then 'already revoked' else 'pronto' end as status from lineitem join orders on l_orderkey = o_orderkey left join part on p_partkey = l_partkey and p_partkey % 10 > 0
""")
def validation_first_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    base = table(spark, sf_dir, "part").where("p_partkey % 10 > 0").select("p_partkey")
    rows = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(base, li["l_partkey"] == base["p_partkey"], "left")
    rules = [
        ("until before effects", F.col("l_shipdate") < F.col("o_orderdate")), ("empty text", F.col("l_quantity") <= 0), ("target missing", F.col("p_partkey").isNull()),
        ("label differs", F.col("l_discount") > 0.08), ("already revoked", F.col("l_returnflag") == "R"),
    ]
    return rows.select("l_orderkey", "l_linenumber", relational.first_failing(rules, "pronto").alias("status"))


@query("""
with s as (select l_orderkey k, count(distinct l_shipdate::date) c, min(l_shipdate::date) d from lineitem where l_returnflag = 'A' group by 1)
select o_orderkey, case when s.c > 1 then null when s.c = 1 then s.d when o_orderpriority like '1%' then o_orderdate::date else date '1999-01-01' end::date as effects,
case when s.c > 1 then 'ambiguous' when s.c = 1 then 'specific' when o_orderpriority like '1%' then 'default' else 'fallback' end as rule from orders left join s on s.k = o_orderkey
""")
def effects_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for the key itself come first, and several dates assign none; then the act's default; then the user's date."""
    rules = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("date"))
    ops = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").like("1%"), F.to_date("o_orderdate")).alias("default"))
    return acts.assign_effects(ops, rules, "o_orderkey", "default", F.lit("1999-01-01").cast("date"))


@query("select o_orderstatus, count(*)::bigint as n, count(*) filter (o_orderpriority like '1%')::bigint as ready, count(*) filter (o_totalprice > 200000)::bigint as review from orders group by 1")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.count_if(c).cast("long")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(n(F.lit(True)).alias("n"), n(F.col("o_orderpriority").like("1%")).alias("ready"), n(F.col("o_totalprice") > 200000).alias("review"))


@query("""
with recursive e as (select p_partkey s, (p_partkey * 7 + 3) % 1000 + 1 e from part),
r as (select s, e, 1 as d, [e] as seen from e union all select r.s, e.e, r.d + 1, list_append(r.seen, e.e) from r join e on r.e = e.s where not list_contains(r.seen, e.e))
select s, e, min(d)::int as depth from r group by 1, 2
""")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 3) % 1000 + 1).alias("b"))
    return relational.closure(edges, "a", "b")


@query("""
with v as (select p_partkey k, p_type t, date '1990-01-01' d from part union all select l_partkey, max_by(case when l_returnflag = 'R' then null else l_linestatus || l_linenumber end, row(l_orderkey, l_linenumber)), l_shipdate::date from lineitem group by l_partkey, l_shipdate::date)
select k as p_partkey, t as wording, d as effects, (lead(d) over (partition by k order by d) - 1)::date as until, lead(d) over (partition by k order by d) is null and t is not null as is_current from v
""".replace("max_by(case when l_returnflag = 'R' then null else l_linestatus || l_linenumber end, row(l_orderkey, l_linenumber))", "(max(row(l_orderkey, l_linenumber, case when l_returnflag = 'R' then null else l_linestatus || l_linenumber end)))[3]"))
def scd2_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements and revocations (a null wording) close what was in force and keep it as history."""
    base = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("wording"), F.lit("1990-01-01").cast("date").alias("effects"))
    li = table(spark, sf_dir, "lineitem")
    wording = F.when(F.col("l_returnflag") != "R", F.concat("l_linestatus", F.col("l_linenumber").cast("string")))
    last = F.max(F.struct("l_orderkey", "l_linenumber", wording.alias("w")))["w"]
    changes = li.groupBy(F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("effects")).agg(last.alias("wording"))
    return relational.apply_changes(base, changes, "p_partkey", "wording", "effects")


@query("""
select 'both' as part, count(*)::bigint as n from (select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R')
union all select 'first', count(*)::bigint from (select l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_returnflag = 'R')
union all select 'bag', count(*)::bigint from (select l_partkey from lineitem where l_returnflag = 'A' except all select l_partkey from lineitem where l_returnflag = 'R')
""")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    a, r = (li.where(F.col("l_returnflag") == f).select("l_partkey") for f in "AR")
    parts = {"both": a.intersect(r), "first": a.subtract(r), "bag": a.exceptAll(r)}
    out = [p.agg(F.count(F.lit(1)).cast("long").alias("n")).select(F.lit(k).alias("part"), "n") for k, p in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("""
with e as (select event_id, user_id, ts, case when event_type = 'purchase' then event_id end as v from events)
select event_id, coalesce(v, (select x.v from e x where x.user_id = e.user_id and x.v is not null and (x.ts, x.event_id) > (e.ts, e.event_id) order by x.ts, x.event_id limit 1),
 (select x.v from e x where x.user_id = e.user_id and x.v is not null and (x.ts, x.event_id) < (e.ts, e.event_id) order by x.ts desc, x.event_id desc limit 1))::bigint as donor from e
""")
def reference_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id")).cast("long").alias("v"))
    return sequence.fill_from_next(e, ["user_id"], ["ts", "event_id"], "v", "donor").select("event_id", "donor")


@query("""
select l_orderkey, l_linenumber, 0 as level, l_partkey::varchar || case when l_linenumber % 2 = 0 then case when l_orderkey % 2 = 0 then '-B' else '-AA' end else '' end as number from lineitem where l_linenumber < 3
union all select l_orderkey, l_linenumber, 1, case when l_orderkey % 3 = 0 then 'UNICO' else l_linenumber::varchar end from lineitem where l_linenumber = 3
union all select l_orderkey, l_linenumber, 3, chr((97 + l_orderkey % 26)::int) from lineitem where l_linenumber = 4
union all select l_orderkey, l_linenumber, 4, l_linenumber || '.' || (l_orderkey % 9) from lineitem where l_linenumber in (5, 6)
union all select l_orderkey, l_linenumber, 2, case when l_orderkey % 2 = 0 then 'XIV-A' else 'XLIV' end from lineitem where l_linenumber > 6
""")
def provision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of provisions, rendered in legal style and read back."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = F.col("l_linenumber")
    line = (
        F.when(n < 3, F.concat(F.lit("“Art. 0"), F.col("l_partkey").cast("string"), F.when((n % 2 == 0) & (F.col("l_orderkey") % 2 == 0), "-b").when(n % 2 == 0, "-AA").otherwise(F.lit("")), F.lit(". Texto")))
        .when((n == 3) & (F.col("l_orderkey") % 3 == 0), "Parágrafo único. Texto")
        .when(n == 3, F.concat(F.lit("§ "), n.cast("string"), F.lit("º - Texto")))
        .when(n == 4, F.concat(F.char((F.lit(97) + F.col("l_orderkey") % 26).cast("int")), F.lit(") texto")))
        .when(n > 6, F.when(F.col("l_orderkey") % 2 == 0, "XIV-A - texto").otherwise("XLIV – texto"))
        .otherwise(F.concat(n.cast("string"), F.lit("."), (F.col("l_orderkey") % 9).cast("string"), F.lit(". texto")))
    )
    return li.select("l_orderkey", "l_linenumber", text.label(line).alias("x")).select("l_orderkey", "l_linenumber", "x.level", "x.number")


@query()
def paragraph_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the lines of acts rendered from orders, by a state machine that runs within an act."""
    return acts.classify(acts.rendered(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")), "o_orderkey")


@query("""
select o_orderkey, (1 + o_orderkey % 150)::varchar as article, (1 + o_orderkey % 9)::varchar as paragraph, i.n as inciso, chr((97 + o_orderkey % 5)::int) as alinea from orders,
 (select unnest(['I', 'II', 'III']) n) i
""")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of references, small to large, expanded to their targets."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    said = F.concat(
        F.lit("a alínea “"), F.char((F.lit(97) + k % 5).cast("int")), F.lit("” dos incisos I a III do § "), (k % 9 + 1).cast("string"), F.lit("º do art. "), (k % 150 + 1).cast("string"), F.lit(" da Lei nº 5.530")
    )
    got = acts.references(o.select("o_orderkey", said.alias("said")), ["o_orderkey"], "said")
    return got.select("o_orderkey", "article", "paragraph", "inciso", "alinea")


# the modules that follow add their queries to the same catalogue
from . import changes, drafting, layout  # noqa: E402, F401
