"""Queries over whole tables, against brute force or SQL that leaves no row out."""

import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import relational
from lexmill.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "documents"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def got(spark, name):
    return Counter(map(tuple, catalog.QUERIES[name](spark, DIR).collect()))


def test_accent_fold_has_all_documents(spark, duck):
    sql = "select doc_id, upper(strip_accents(trim(regexp_replace(replace(text, 'ß', 'ss'), '\\s+', ' ', 'g')))) as folded from documents"
    rows = got(spark, "accent_fold")
    assert rows == Counter(duck.sql(sql).fetchall())
    assert len(rows) == duck.sql("select count(*) from documents").fetchall()[0][0]


def test_norm_upper_as_the_reference(spark):
    said = ["Straße  ẞ", "ŝōşž Ÿẽ", "é́ ë", "ΐ Άλφα й", "nº 5ª", None]

    def reference(s):
        s = unicodedata.normalize("NFD", re.sub(r"[\s\xA0]+", " ", s).strip().upper())
        return "".join(c for c in s if unicodedata.category(c) != "Mn")

    rows = spark.createDataFrame([(s,) for s in said], "s string").select(text.norm_upper(F.col("s"))).collect()
    assert [r[0] for r in rows] == [s and reference(s) for s in said]


def reference_words(lines):
    word, cut = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*"), re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]-$")
    out, broken = [], False
    for line in lines:
        words = word.findall(line)[1 if broken else 0 :]
        broken = bool(cut.search(line.rstrip()))
        out += [w.lower() for w in (words[:-1] if broken else words)]
    return out


def test_whole_words(spark):
    said = ["O Se-\ncretário cumpra-se À\nfim", "a um-\n\ntres", "só-\nele-\nvado nos- \x1c \n1 b-2 c", "x-\n-y z-\n", "", None]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select(text.whole_words(F.split("s", "\n"))).collect()
    assert [r[0] for r in rows] == [s if s is None else reference_words(s.split("\n")) for s in said]
    assert rows[0][0] == ["o", "cumpra-se", "à", "fim"]


def test_vocabulary_has_every_word(spark, duck):
    want = Counter()
    for lang, body in duck.sql("select lang, text from documents where text is not null").fetchall():
        want.update((lang, w) for w in reference_words(re.split("\r\n|\r|\n", body)))
    rows = {(r["lang"], r["word"]): r["n"] for r in catalog.QUERIES["vocabulary"](spark, DIR).collect()}
    assert rows == want and 1 in rows.values()


def walked(edges, most=None):
    """(start, end, fewest links), by a walk from each start."""
    ends = defaultdict(set)
    for a, b in edges:
        ends[a].add(b)
    out = set()
    for s in list(ends):
        seen, front, depth = set(), {s}, 0
        while front and depth != most:
            depth += 1
            front = {e for m in front for e in ends.get(m, ())} - seen
            seen |= front
            out |= {(s, e, depth) for e in front}
    return out


@pytest.mark.parametrize("most", [None, 1, 3, 5, 8])
def test_closure_by_brute_force(spark, most):
    edges = [(i, i + 1) for i in range(11)] + [(11, 3), (2, 9), (20, 21), (21, 20), (30, 30), (5, 40), (40, 7), (2, 9)]
    rows = relational.closure(spark.createDataFrame(edges, "a int, b int"), "a", "b", most).collect()
    assert sorted(map(tuple, rows)) == sorted(walked(edges, most))


def test_dependency_closure_has_no_depth_limit(spark, duck):
    edges = duck.sql("select p_partkey, (p_partkey * 7 + 3) % 1000 + 1 from part").fetchall()
    assert got(spark, "dependency_closure") == Counter(walked(edges))


def test_origin_note_asof_has_every_line(spark, duck):
    want = """
    select l.l_orderkey, l.l_linenumber, (select max(o2.o_orderdate) from orders o2 where o2.o_custkey = o.o_custkey and o2.o_orderdate < l.l_shipdate)::date as note_date
    from lineitem l join orders o on l.l_orderkey = o.o_orderkey"""
    assert got(spark, "origin_note_asof") == Counter(duck.sql(want).fetchall())


def test_scd2_apply_has_every_change(spark, duck):
    base = [(k, t, None) for k, t in duck.sql("select p_partkey, p_type from part").fetchall()]
    last = {}
    for part, day, order, line, flag, status in duck.sql("select l_partkey, l_shipdate::date, l_orderkey, l_linenumber, l_returnflag, l_linestatus from lineitem").fetchall():
        last[part, day] = max(last.get((part, day), (0, 0, None)), (order, line, None if flag == "R" else f"{status}{line}"), key=lambda x: x[:2])
    want = Counter((k, t) for k, t, _ in base) + Counter((part, x[2]) for (part, _), x in last.items())
    rows = catalog.QUERIES["scd2_apply"](spark, DIR).collect()
    assert Counter((r["p_partkey"], r["wording"]) for r in rows) == want
    days = defaultdict(list)
    for r in rows:
        days[r["p_partkey"]].append(r)
    for part, chain in days.items():
        chain.sort(key=lambda r: r["effects"])
        assert [(r["until"] and (b["effects"] - r["until"]).days) for r, b in zip(chain, chain[1:] + [None])] == [1] * (len(chain) - 1) + [None]
        assert [r["is_current"] for r in chain] == [False] * (len(chain) - 1) + [chain[-1]["wording"] is not None]
        assert {r["effects"] for r in chain[1:]} == {d for p, d in last if p == part}
