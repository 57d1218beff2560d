import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.functions import dates, keys, text
from lexmill.operators import acts, relational, sequence
from lexmill.sources import documents, pages
from lexmill.streaming import ingest


def values(spark, said, f):
    return [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(f(F.col("s"))).collect()]


def test_dates(spark):
    day = dt.date(2026, 10, 22)
    assert values(spark, ["22/10/2026", "22.10.26", "2026-10-22", "31/02/2026", "", None], dates.parse_date) == [day, day, day, None, None, None]
    said = ["90 dias após a publicação", "primeiro dia do segundo mês subsequente ao da publicação", "1º de janeiro do ano subsequente ao da publicação", "1º de outubro de 2025", "nada"]
    made = values(spark, said, lambda c: dates.effect_date(c, F.lit(day)))
    assert made == [dt.date(2027, 1, 20), dt.date(2026, 12, 1), dt.date(2027, 1, 1), dt.date(2025, 10, 1), None]
    assert values(spark, ["2027-01-01"], lambda c: dates.until(c.cast("date"), 2)) == ["31.12.26"]


def test_labels(spark):
    said = ["Art. 5º-A. Texto", "Parágrafo único. X", "§ 2º - X", "IV - X", "b) X", "1.2. X", "texto"]
    got = [r and (r["level"], r["number"]) for r in values(spark, said, text.label)]
    assert got == [(0, "5-A"), (1, "UNICO"), (1, "2"), (2, "IV"), (3, "b"), (4, "1.2"), None]


def test_text(spark):
    assert values(spark, ["9", "10", "2-A"], text.ordinal) == ["9º", "10", "2º-A"]
    assert values(spark, ["XIV", "XLIV", "ABC"], text.roman_value) == [14, 44, None]
    assert values(spark, ["1.234,56", "10,00%", "R$ 7"], text.money) == [["1.234,56"], [], ["7"]]
    assert values(spark, ["BREJO GRAN.ARAGUAIA"], text.title_case) == ["Brejo Gran.Araguaia"]
    assert [c and c["key"] for c in values(spark, ["Lei nº 5.530, de 13 de janeiro de 1989", "Portaria nº 293/2026-SEFA/GS", "nada", None], text.citation)] == ["Lei|5530|1989", "Portaria|293|2026", None, None]
    assert values(spark, ["  SEÇÃO  única º"], text.norm_upper) == ["SECAO UNICA º"]


def test_join_line(spark):
    rows = spark.createDataFrame([("cumpra-", "se"), ("Se-", "cretário"), ("fim", "novo")], "a string, b string")
    assert [r[0] for r in rows.select(text.join_line(F.col("a"), F.col("b"))).collect()] == ["cumpra-se", "Secretário", "fim novo"]


@pytest.mark.parametrize(
    "first, last, made",
    [("39-A", "39-C", ["39-A", "39-B", "39-C"]), ("I", "III", ["I", "II", "III"]), ("a", "d", list("abcd")), ("3", "5", ["3", "4", "5"]), ("5", "3", None), ("1", "200", None), ("a", "3", None), (None, "3", None)],
)
def test_ranges(spark, first, last, made):
    row = spark.createDataFrame([(first, last)], "a string, b string").select(keys.expand(F.col("a"), F.col("b"))).first()
    assert row[0] == made


def test_references(spark):
    def of(said):
        rows = spark.createDataFrame([(1, said)], "k long, said string")
        return sorted(acts.references(rows, ["k"], "said").collect())

    one = of("alínea “a” do inciso II do § 1º do art. 5º")
    assert [(r["article"], r["paragraph"], r["inciso"], r["alinea"]) for r in one] == [("5", "1", "II", "a")]
    assert [r["article"] for r in of("arts. 39-A a 39-C")] == ["39-A", "39-B", "39-C"]
    assert [(r["article"], r["paragraph"]) for r in of("art. 5º, § 1º")] == [("5", "1")]
    assert of(None) == []


def test_grid():
    page = "<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C</td></tr></table>"
    (seq, kind, _, cells, merges, _), *rest = pages.read(page)
    assert (kind, cells, merges, rest) == ("table", [["A", "B"], ["", "C"]], [(0, 0, 1, 0)], [])
    assert pages.read(None) == []


def test_state_and_context(spark):
    rows = spark.createDataFrame([(1, i, e) for i, e in enumerate("xooxcxc")], "k int, i int, e string")
    got = sequence.inside_state(rows, ["k"], ["i"], F.col("e") == "o", F.col("e") == "c").orderBy("i").collect()
    assert [r["inside"] for r in got] == [False, True, True, True, True, False, False]
    rows = spark.createDataFrame([(1, 1, 0, "1"), (1, 2, 1, "1"), (1, 3, 2, "I"), (1, 4, 0, "2"), (1, 5, 2, "I")], "k int, i int, l int, n string")
    got = sequence.fill_context(rows, ["k"], ["i"], "l", "n", ["a", "p", "x"]).orderBy("i").collect()
    assert [(r["a"], r["p"], r["x"]) for r in got] == [("1", None, None), ("1", "1", None), ("1", "1", "I"), ("2", None, None), ("2", None, "I")]


def test_bags_and_empty(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    assert relational.bag_difference(left, left, ["c"]).count() == 0
    assert relational.bag_difference(left, left.limit(0), ["c"]).count() == 2


def test_roles_carry_state(spark):
    lines = ["LEI Nº 1, DE 2020", "Altera a lei.", "DECRETA:", "Art. 1º Muda:", "“Art. 9. Novo", "texto.”", "Art. 2º Fim.", "Belém, 3 de março de 2020", "FULANO", "Governador", None]
    rows = spark.createDataFrame([(k, i, t) for k in (1, 2) for i, t in enumerate(lines)], "k int, seq int, text string")
    got = acts.classify(rows, "k").orderBy("k", "seq").collect()
    want = ["epigraph", "summary", "command", "article", "quotation", "quotation", "article", "closing", "name", "post", "text"]
    assert [r["role"] for r in got] == want * 2


def test_links_and_writes(spark, tmp_path):
    (tmp_path / "links.tsv").write_text("# c\nLei|1|2000\tu\nLei|1|2000\t=7\nLei|2|2001\t-\n")
    got = {r["key"]: r["value"] for r in documents.link_table(spark, str(tmp_path / "links.tsv")).collect()}
    assert got == {"Lei|1|2000": "=7", "Lei|2|2001": "-"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes("ação".encode())
    (tmp_path / "t/b.txt").write_bytes("“ação”".encode("cp1252"))
    assert sorted(r["text"] for r in documents.text_files(spark, str(tmp_path / "t")).collect()) == ["ação", "“ação”"]
    rows = spark.range(5)
    documents.write_checked(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    with pytest.raises(FileExistsError):
        documents.write_checked(rows, str(tmp_path / "out"))


def test_ingest_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        docs = ingest.new_documents(spark, str(tmp_path / "in"), "id long, text string")
        ingest.ingest(docs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
