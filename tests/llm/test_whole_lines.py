"""Line dedup over lines of every length: short equal lines go as long ones do."""

from pyspark.sql import functions as F

from lexmill.llm import linededup

TEXTS = ["All rights reserved.\n}\n\nAnd ornd.", "All rights reserved.\n}\n\nAnd ornd!", "And ornd.\n \n" + "x" * 30 + "\n}", "x" * 29 + "y\nAll rights reserved", None]


def docs_frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_short_equal_lines_go(spark):
    got = {x["doc_id"]: (x["n_lines"], x["n_removed"], x["chars_removed"]) for x in linededup.line_counts(docs_frame(spark)).collect()}
    # lines of fewer than MIN_CHARS code points go only where an equal one stands before; blank ones stay
    assert got == {0: (4, 0, 0), 1: (4, 2, 21), 2: (4, 2, 10), 3: (2, 1, 30), 4: (1, 0, 0)}
    left = {x["doc_id"]: x["text"] for x in linededup.without_repeated_lines(docs_frame(spark)).collect()}
    assert left == {0: TEXTS[0], 1: "\nAnd ornd!", 2: " \n" + "x" * 30, 3: "All rights reserved"}


def test_no_equal_line_stays_twice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = linededup.without_repeated_lines(docs).select(F.explode(F.split("text", "\n")).alias("line")).where(linededup.eligible(F.col("line")))
    assert left.groupBy("line").count().where("count > 1").count() == 0


def test_edits_are_of_code_points(spark):
    a = "uma linha com é e à que é bem longa"
    texts = [a, a.replace("é", "e").replace("à", "à"), a.replace("à", "\U0001f600"), "𝒳𝒴𝒵" * 10, "𝒳𝒴𝒵" * 9 + "𝒳𝒳", "z" * 30 + "\n" + "z" * 31]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_removed"], x["n_links"]) for x in linededup.line_counts(docs).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (1, 1), 3: (0, 1), 4: (1, 1), 5: (1, 2)}


def test_a_line_that_stands_very_often_and_a_very_long_one(spark):
    common, long = "this line stands in every document there is", "ab" * 20_000
    texts = [f"{common}\n{i % 10} its own line" for i in range(400)] + [common[:-1], long, long[:-1] + "c", f"{common}\n{common}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in linededup.line_counts(docs).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["n_links"] == 441
    assert all(got[i]["n_removed"] == 1 + (i >= 10) for i in range(1, 400)) and got[400]["n_removed"] == 1 and got[401]["n_removed"] == 0 and got[402]["n_removed"] == 1 and got[403]["n_removed"] == 2


def test_rows_given_twice_and_clashing_names(spark):
    rows = [(1, "the same line of some length here", "x"), (1, "the same line of some length here", "x"), (None, "the same line of some length here", "y"), (2, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").withColumnsRenamed({"h": "line"})
    got = sorted((x["doc_id"] or 99, x["n_removed"]) for x in linededup.line_counts(docs).collect())
    assert got == [(1, 0), (1, 0), (2, 0), (99, 1)]
    assert sorted(tuple(x) for x in linededup.without_repeated_lines(docs).collect()) == [rows[0], rows[1]]
    assert linededup.line_counts(docs.limit(0)).count() == 0 and linededup.without_repeated_lines(docs.limit(0)).count() == 0
