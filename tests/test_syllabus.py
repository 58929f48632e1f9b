"""Syllabus documents, of our own wording."""

from quaestor.operators import syllabus

DOC = """CS23501 COMPUTER NETWORKS is named here, without units
something else
CS23501   COMPUTER NETWORKS   3
OBJECTIVES
UNIT I   FIRST  LAYERS   9L, 6P
Wires \u2013 waves - a topic that
wraps - x
12
PRACTICALS:
not a topic
UNIT - II NAMES AND PLACES   8L
Names - places
TOTAL : 17
COURSE OUTCOMES:
Upon completion one can
1. Build a network
   of wires
2) Name it
HoD someone
99. Far too high
REFERENCES:
1. A book,
   second edition
2. Another book
CO-PO Mapping
1. not a book
MA23102   GRAPHS AND TREES  4
UNIT I   TREES   5L
Leaves
"""


def test_documents(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc long, text string")
    subjects = spark.createDataFrame([(1, "CS23501"), (1, "MA23102"), (1, "PH1111")], "doc long, code string")
    found = syllabus.sections(docs, subjects)
    rows = [(r["code"], r["unit_no"], r["title"], r["lecture_hours"], r["practical_hours"], r["topics"]) for r in syllabus.units(found).orderBy("code", "unit_no").collect()]
    assert rows == [("CS23501", 1, "FIRST LAYERS", 9, 6, ["Wires", "waves", "a topic that wraps"]), ("CS23501", 2, "NAMES AND PLACES", 8, None, ["Names", "places"]), ("MA23102", 1, "TREES", 5, None, ["Leaves"])]
    assert [(r["number"], r["text"]) for r in syllabus.outcomes(found).orderBy("number").collect()] == [(1, "Build a network of wires"), (2, "Name it")]
    assert [(r["number"], r["text"]) for r in syllabus.references(found).orderBy("number").collect()] == [(1, "A book, second edition"), (2, "Another book")]
    assert sorted((r["code"], r["name"]) for r in syllabus.subject_names(found).collect()) == [("CS23501", "COMPUTER NETWORKS"), ("MA23102", "GRAPHS AND TREES")]
