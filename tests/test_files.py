"""Files that are read and written, table functions, and golden cases of notes, dates, labels and grids."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.functions import citations, dates, keys, notes, text
from lexmill.operators import changes, geometry
from lexmill.sources import files, pages


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="Artigo"/></w:pPr><w:r><w:t>Art. 1º</w:t><w:tab/><w:t>Texto</w:t></w:r><w:del><w:r><w:delText>x</w:delText></w:r></w:del><w:ins><w:r><w:t> novo</w:t></w:r></w:ins></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>célula</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    (tmp_path / "a.docx").write_bytes(docx(body))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    rows = files.docx_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["style"], r["text"], r["in_table"]) for r in rows] == [("Artigo", "Art. 1º\tTexto novo", False), (None, "célula", True), (None, "", False)]
    assert files.read_docx(None) == []


def test_web_archive(spark, tmp_path):
    parts = 'Snapshot-Content-Location: http://x/p\r\nMIME-Version: 1.0\r\nContent-Type: multipart/related; boundary="B"\r\n\r\n--B\r\nContent-Type: text/html; charset="utf-8"\r\n\r\n<p>Texto</p>\r\n--B\r\nContent-Type: image/png\r\nContent-Location: http://x/i.png\r\n\r\nabc\r\n--B--\r\n'
    (tmp_path / "a.mhtml").write_bytes(parts.encode())
    (tmp_path / "b.mhtml").write_bytes(b"nothing")
    row = files.web_archives(spark, str(tmp_path)).collect()
    assert [(r["url"], r["html"].strip(), r["images"]) for r in row] == [("http://x/p", "<p>Texto</p>", ["http://x/i.png"])]


def test_slim(spark):
    page = "<p>a</p><script>x</script><!-- y --><style>\nz</style><img src='data:abc' alt=q><svg><g/></svg>b"
    assert spark.createDataFrame([(page,)], "h string").select(files.slim(F.col("h"))).first()[0] == "<p>a</p><img alt=q>b"


def test_plan_round_trip(spark, tmp_path):
    ops = spark.createDataFrame([("A001", "add", 'x "y"', None), ("A002", "revoke", None, dt.date(2026, 1, 2))], "id string, action string, text string, effects date")
    where = str(tmp_path / "plan")
    files.save_plan(ops, where, "base", "act")
    got = files.load_plan(spark, where, "id string, action string, text string, effects date", "base", "act")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ops.collect()))
    with pytest.raises(ValueError, match="another base"):
        files.load_plan(spark, where, "id string", "other")
    with pytest.raises(Exception, match="exist"):
        files.save_plan(ops, where, "base", "act")


def test_links_and_reports(spark, tmp_path):
    old = spark.createDataFrame([("Lei|1|2000", "=1")], "key string, value string")
    new = spark.createDataFrame([("Lei|1|2000", "=9"), (" Lei|2 ", "u"), ("Lei|2", "t"), ("", "x")], "key string, value string")
    links = files.append_links(old, new)
    assert sorted(map(tuple, links.collect())) == [("Lei|1|2000", "=1"), ("Lei|2", "t")]
    files.write_links(links, str(tmp_path / "links"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "links")).collect()) == ["Lei|1|2000\t=1", "Lei|2\tt"]
    files.report_html(links.withColumn("value", F.lit("<a> & b")), str(tmp_path / "report"), "A & B")
    assert "<td>&lt;a&gt; &amp; b</td>" in "".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())
    for target in ("/a/b", "/a/b/c", "/a", "file:/a//b/"):
        with pytest.raises(ValueError, match="input"):
            files.guarded(target, ["/a/b"])
    assert files.guarded("/a/bc", ["/a/b"]) == "/a/bc"


def test_diff(spark):
    got = [r[0] for r in spark.createDataFrame([("a\nb", "a\nc"), ("a", "a"), (None, "x")], "a string, b string").select(files.diff(F.col("a"), F.col("b"))).collect()]
    assert got[0].endswith("-b\n+c") and got[1] == "" and got[2].endswith("+x")


def test_table_functions(spark):
    files.register_functions(spark)
    said = "A Lei nº 5.530, de 13 de janeiro de 1989, e o Decreto 10/26"
    assert [tuple(r) for r in spark.sql(f"select number, year from legal_citations('{said}') order by at").collect()] == [("5530", "1989"), ("10", "2026")]
    assert [tuple(r) for r in spark.sql("select day, until from legal_dates('90 dias após a publicação', date '2026-10-22')").collect()] == [(dt.date(2027, 1, 20), None)]


P = dt.date(2026, 10, 22)


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("90 dias após a publicação", [(dt.date(2027, 1, 20), None)]),
        ("noventa dias após a publicação", [(dt.date(2027, 1, 20), None)]),
        ("primeiro dia do segundo mês subsequente ao da publicação", [(dt.date(2026, 12, 1), None)]),
        ("1º de janeiro do ano subsequente ao da publicação", [(dt.date(2027, 1, 1), None)]),
        ("efeitos de 1º de outubro de 2025 a 31 de dezembro de 2025", [(dt.date(2025, 10, 1), dt.date(2025, 12, 31))]),
        ("até a data de sua publicação", []),
        ("em 31.02.2020", []),
        (None, []),
    ],
)
def test_dates_of_clauses(said, want):
    assert [(d, u) for _, _, d, u in dates.read_dates(said, P)] == want


def test_golden_notes(spark):
    def key(**parts):
        return F.struct(F.lit(parts.get("corpus", "PRINCIPAL")).alias("corpus"), *(F.lit(parts.get(p, "")).alias(p) for p in keys.PARTS))

    values = lambda *v: F.array(*map(F.lit, v))
    day, none, ec = F.lit(dt.date(2025, 9, 10)), F.lit(None).cast("date"), F.lit("EC 136/2025")
    row = spark.range(1).select(
        notes.new_note(F.lit("replace"), key(article="100", paragraph="1"), values("1"), ec, day, none, 2),
        notes.new_note(F.lit("add"), key(article="100", paragraph="23"), values(*map(str, range(23, 31))), ec, day, none, 2),
        notes.enumerated(values("4", "5"), F.lit(1)), notes.enumerated(values("IV", "V"), F.lit(2)), notes.enumerated(values("a", "c", "d"), F.lit(3)), notes.enumerated(values("39-A", "39-B", "39-C"), F.lit(0)),
        notes.description(key(article="5", paragraph="1", inciso="II", alinea="a")), notes.format_citation(F.lit("Lei 1/89"), 4), notes.new_label(F.lit(1), F.lit("3-A")),
        notes.new_note(F.lit("add"), key(corpus="ADCT", article="2"), values("2"), F.lit("EC 1/1990"), none, none), notes.preview(F.lit("palavra " * 40)),
    ).first()
    assert row[0] == "Redação dada ao § 1º do art. 100 pela EC 136/25, efeitos a partir de 10.09.25."
    assert row[1] == "Acrescidos os §§ 23 a 30 ao art. 100 pela EC 136/25, efeitos a partir de 10.09.25."
    assert list(row[2:6]) == ["4º e 5º", "IV e V", "“a”, “c” e “d”", "39-A a 39-C"]
    assert row[6] == "alínea “a” do inciso II do § 1º do art. 5º" and row[7] == "Lei 1/1989" and row[8] == "§ 3º-A "
    assert row[9] == "Acrescido o art. 2º ao ADCT pela EC 1/1990." and len(row[10]) <= 171 and row[10].endswith("palavra…")


def test_labels_money_and_grid(spark):
    said = ["Art. 5º-A. Texto", "§ 2º-AA Texto", "Parágrafo único. X", "IV - X", "b) X", "1.2. X", "Texto"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(text.label(F.col("s"))).collect()]
    assert [(g["level"], g["number"]) if g else None for g in got] == [(0, "5-A"), (1, "2-AA"), (1, "UNICO"), (2, "IV"), (3, "b"), (4, "1.2"), None]
    assert got[0]["prefix"] == "Art. 5º-A." and said[0][got[0]["end"] :] == "Texto"
    row = spark.createDataFrame([("1.234,56\n10,00%\nR$ 7\n1234,56 e -5,00",)], "s string").select(text.money(F.col("s"))).first()
    assert row[0] == ["1.234,56", "7", "1234,56", "-5,00"]
    assert pages.grid([[("A", 2, 1), ("B", 1, 1)], [("C", 1, 1)]]) == ([["A", "B"], ["", "C"]], [(0, 0, 1, 0)])
    assert pages.grid([[], [("A", 1, 1)]]) == ([["A"]], []) and len(pages.grid([[("A", 1, 10**9)]])[0][0]) == pages.MOST_ACROSS


def test_citations_of_a_text():
    of = lambda s: [(c["key"], c["sphere"]) for c in citations.read_citations(s)]
    assert of("Portaria nº 293/2026-SEFA/GS e Lei Complementar Federal nº 87/96") == [("Portaria|293|2026", ""), ("Lei Complementar|87|1996", "FEDERAL")]
    assert of("Projeto de Lei nº 7/2020") == [] and of(None) == [] and of("CF/88") == [("Constituição", "FEDERAL")]
    assert [k for k, _ in of("os Decretos nºs 1, 2/2001 e 3, de 4 de maio de 2005, em 5 dias")] == ["Decreto|1", "Decreto|2|2001", "Decreto|3|2005"]


def test_empty_tables(spark):
    words = spark.createDataFrame([], "page long, x0 double, x1 double, top double, bottom double, word long")
    assert geometry.word_rows(words, "page").count() == 0 and geometry.words_inside(words, words.withColumnRenamed("word", "box"), ["page"], "box").count() == 0
    lines = spark.createDataFrame([], "act long, seq int, line string")
    assert changes.commands(lines, "act", "seq", "line").count() == 0
