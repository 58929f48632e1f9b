"""Header rules, part headings, question numbers and provider errors on literals."""

import pytest
from pyspark.sql import functions as F

from quaestor.functions import headers, text


def ask(spark, column, values, schema="t string"):
    rows = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [r["x"] for r in rows.select(column.alias("x")).collect()]


def test_part_headings(spark):
    lines = ["PART - A (10 x 2 = 20 Marks)", "PART - B (5 x 13)", "PART B", "Part C (2x816)", "partial credit", "PART-A (4 x 0 = 0)", "x" * 91, "(PART A", "PART B (5x1365)"]
    got = [tuple(r) if r else None for r in ask(spark, text.part_header(F.col("t")), lines)]
    assert got == [("A", 10, 2, 20, False), ("B", 5, 13, 65, True), ("B", 0, 0, 0, True), ("C", 2, 8, 16, True), None, ("A", 4, 0, 0, False), None, ("A", 0, 0, 0, True), ("B", 5, 13, 65, True)]


def test_question_numbers(spark):
    got = [tuple(r) for r in ask(spark, text.question_number(F.col("a"), F.col("b")), [("11(a)(i)", None), ("11(a)", "(a)"), ("11(a)(2)", None), (" x1 ", None), (None, None), ("7", "(ii)")], "a string, b string")]
    assert got == [("11", "a-i"), ("11", "a"), ("11", "a"), ("x1", "x"), ("", None), ("7", "ii")]
    rows = [("12", "(B)", "A", 3, "a \t b\n c "), ("12", None, "B", 3, "x")]
    got = [tuple(r) for r in ask(spark, text.normal_question(*map(F.col, "abcde")), rows, "a string, b string, c string, d int, e string")]
    assert got == [("12", "b", None, "a b\n c"), ("12", None, 3, "x")]


def test_trailing_marks(spark):
    got = [tuple(r) for r in ask(spark, text.trailing_marks(F.col("t")), ["  Prove it.\n (5)", "Why? [10 Marks] ", "f(0)", "g (101)", "no marks", "h (7m)"])]
    assert got == [("Prove it.", 5), ("Why?", 10), ("f(0)", None), ("g (101)", None), ("no marks", None), ("h", 7)]


def test_lines(spark):
    lines = [("OR", 300.0), ("OR", 20.0), ("o.r.", 200.0), ("(Answer all Questions)", 50.0), ("(i) Explain this", 50.0), ("Q. No Question Marks CO BL", 40.0), ("Page 1 of 3", 10.0), ("----", 10.0), ("Roll No. ____", 5.0), ("Explain a heap", 60.0), ("PART A", 10.0)]
    assert ask(spark, text.line_class(F.col("t"), F.col("x0"), F.lit(600.0)), lines, "t string, x0 double") == ["or", "body", "or", "note", "body", "header", "furniture", "furniture", "furniture", "body", "part"]


def test_provider_errors(spark):
    rows = [(429, None), (400, "generate failed"), (None, "model is Overloaded"), (None, "deadline exceeded, retryDelay: \"7s\""), (503, "Retry-After: 12"), (None, "rate limit"), (None, None)]
    got = [tuple(r) for r in ask(spark, text.retry_advice(F.col("s"), F.col("m")), rows, "s int, m string")]
    assert got == [(True, 60000), (False, None), (True, 60000), (True, 7000), (True, 12000), (True, 60000), (False, None)]


HEADERS = [
    ("ANNA UNIVERSITY\nB.E. END SEMESTER EXAMINATIONS, NOV/DEC 2023\nSemester V\nCS23501 - Computer Networks (Common to IT)\n(Regulation 2019)\nTime: 3 hrs  Max. Marks: 100", ("CS23501", "Computer Networks", "R2019", 2023, "nov-dec", "endsem", None, None, 5, 100, [])),
    ("Madras Institute of Technology\nQuiz 2, 12th September 2022\nIII semester\nCS6111: Graph Theory, and Uses / Sem\nmarks - 20", ("CS6111", "Graph Theory, and Uses / Sem", None, 2022, "sep", "quiz", "MIT", None, 3, 20, ["single month"])),
    ("Regulation 2018 RUSA\nsupplementary examinations DEC2021\nSemester 14", (None, None, "R2018", None, None, "supplementary", None, None, None, None, [])),
    ("Regulation: 2018\nnothing else", (None, None, "R2018", 2018, None, None, None, None, None, None, [])),
    ("CEG mid-sem retest 1890 2024 AB12 XY 1234", ("XY1234", None, None, 2024, None, "retest", "CEG", None, None, None, [])),
]


@pytest.mark.parametrize("header,want", HEADERS)
def test_metadata(spark, header, want):
    got = ask(spark, headers.metadata(F.col("t")), [header])[0]
    assert tuple(got) == want


def test_hints_fill_year_and_type_only(spark):
    rows = [("CS6111 - Networks", "CS6111-CEG-22S5-Quiz-BT.pdf", 50), ("end semester 2020 max marks: 60", "x-22S5-supplementary.pdf", 50), ("MIT 2021", "y-MIT.pdf", None)]
    names = spark.createDataFrame(rows, "h string, n string, t int").withColumn("hints", text.filename_hints(F.col("n"), text.WORKER_COLLEGE))
    got = [r["x"] for r in names.select(headers.metadata(F.col("h"), F.col("hints"), F.col("t")).alias("x")).collect()]
    assert [(g["exam_year"], g["exam_type"], g["college"], g["paper_set"], g["total_marks"], g["warnings"]) for g in got] == [
        (2022, "quiz", None, "BT", 50, ["year from file name", "file name has a college"]),
        (2020, "endsem", None, None, 60, ["file name has another year", "total differs from the parts"]),
        (2021, None, "MIT", None, None, []),
    ]


def test_rules_and_checks(spark):
    rows = spark.createDataFrame([("1", "x", 5, "A"), ("", "", 101, "D"), ("q" * 21, None, None, None)], "q_number string, text string, marks int, part string")
    assert [r[0] for r in rows.select(text.violations(rows.columns)).collect()] == [[], ["marks", "q_number", "text"], ["q_number"]]
    assert [r[0] for r in rows.select(text.broken_checks({"part": "part"}, ("q_number", "part"))).collect()] == [[], ["part"], []]
