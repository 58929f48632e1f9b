"""Syllabus documents to units, topics, outcomes and references, as columns and gaps-and-islands over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dashes and blanks that documents use, lines of furniture, and the headings of a subject's sections.
DASHES, BLANKS = "�‐‑‒–—―−", " \t"
FURNITURE = (r"(?i)^\s*Prepared by\b.*$", r"(?i)^\s*\(Name & Signature\)\s*$", r"(?i)^\s*\^?\s*Applicable to only courses Offered by other Departments\s*$", r"(?i)^\s*HoD\b.*$", r"^\s*\d{1,3}\s*$")
UNIT, NEXT = r"^\s*UNIT\s*[-\s]*\s*([IVX]+)\s+(.+?)\s{2,}(\d+)L(?:\s*,\s*(\d+)P)?\s*$", r"^\s*[A-Z]{2}\d{5}\s+[A-Z][A-Z\s&,-]{6,}"
ENDS, OUTCOMES, REFERENCES, MAPPING = r"^\s*(?:PRACTICALS?\s*:|TOTAL\s*:|COURSE OUTCOMES)", r"^\s*COURSE\s+OUTCOMES?\s*:?", r"^\s*(?:REFERENCES?|TEXT\s*BOOKS?)\s*:?", r"^\s*CO\s*-?\s*PO Mapping"
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")
NEAR, HEAD = 3000, 200  # where the first unit must stand after a heading, and what belongs to a heading


def normal(text: Column) -> Column:
    return F.translate(text, DASHES + BLANKS, "-" * len(DASHES) + " " * len(BLANKS))


def furniture(line: Column) -> Column:
    return F.exists(F.array(*map(F.lit, FURNITURE)), lambda p: F.regexp(line, p))


def sections(documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc, code, section: of each subject (doc, code) the text from its heading with a first unit near it, to the next subject.

    documents: doc, text. Subjects without such a heading have no row.
    """
    both = subjects.join(documents.select("doc", normal(F.col("text")).alias("text")), "doc")
    # A heading is the code at the start of a line: the text is cut there, and a cut with a first unit near its start is it.
    cuts = F.split("text", F.concat(F.lit(r"(?m)(?=^[ ]*"), F.col("code"), F.lit(r"\b)")))
    rows = both.select("doc", "code", F.posexplode(cuts).alias("i", "cut"), "text")
    starts = F.col("cut").rlike(r"^\s*[A-Z]{2,3}\d") & F.regexp_like(F.trim("cut"), F.concat(F.lit("^"), F.col("code"), F.lit(r"\b"))) & F.substring("cut", 1, NEAR).rlike(r"UNIT\s*[-\s]*\s*I\b")
    first = rows.where(starts).groupBy("doc", "code").agg(F.min_by("cut", "i").alias("cut"))
    rest = F.expr(f"substring(cut, {HEAD + 1})")
    tail = F.element_at(F.split(rest, f"(?m)(?={NEXT})", 2), 1)
    return first.select("doc", "code", F.concat(F.substring("cut", 1, HEAD), tail).alias("section"))


def lines(found: DataFrame) -> DataFrame:
    """doc, code, at, line of sections, without furniture."""
    rows = found.select("doc", "code", F.posexplode(F.split("section", "\n")).alias("at", "line"))
    return rows.where(~furniture(F.col("line")))


def units(found: DataFrame) -> DataFrame:
    """doc, code, unit_no, title, lecture_hours, practical_hours, topics, raw_text of the sections' units."""
    rows = lines(found)
    part = lambda i: F.regexp_extract("line", UNIT, i)
    rows = rows.withColumn("head", F.when(F.col("line").rlike(UNIT), F.struct(part(1).alias("roman"), F.trim(F.regexp_replace(part(2), r"\s+", " ")).alias("title"), part(3).try_cast("int").alias("lecture"), part(4).try_cast("int").alias("practical"))))
    order = Window.partitionBy("doc", "code").orderBy("at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.count("head").over(upto)).where("nth > 0")
    inside = Window.partitionBy("doc", "code", "nth").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("over", F.count_if(F.col("line").rlike(ENDS)).over(inside)).where("over = 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("at", "line")))), lambda x: x["line"]), " ")
    out = rows.groupBy("doc", "code", "nth").agg(F.first("head", True).alias("head"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("raw_text"))
    place = F.nullif(F.array_position(F.array(*map(F.lit, ROMAN)), F.col("head.roman")), F.lit(0))
    topics = F.filter(F.transform(F.split("raw_text", r"\s+-\s+"), lambda t: F.regexp_replace(t, r"^[-\s]+|[-\s]+$", "")), lambda t: F.length(t) > 1)
    return out.select("doc", "code", F.coalesce(place, F.col("nth")).cast("int").alias("unit_no"), "head.title", F.col("head.lecture").alias("lecture_hours"), F.col("head.practical").alias("practical_hours"), topics.alias("topics"), "raw_text")


def numbered(found: DataFrame, begin: str, ends: tuple[str, ...], without: str | None = None) -> DataFrame:
    """doc, code, number, text of the numbered list that begins after the first line `begin`; other lines go on the entry before."""
    rows = lines(found)
    order = Window.partitionBy("doc", "code").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("begun", F.count_if(F.col("line").rlike(begin)).over(order)).where("begun > 0")
    closed = F.exists(F.array(*map(F.lit, ends)), lambda p: F.regexp(F.col("line"), p))
    rows = rows.withColumn("closed", F.count_if(closed).over(order)).where("closed = 0").where(~F.col("line").rlike(begin) & (F.trim("line") != ""))
    rows = rows.where(~F.col("line").rlike(without)) if without else rows
    entry = r"^\s*(\d{1,2})[.)]\s+(.*)$"
    rows = rows.withColumn("number", F.regexp_extract("line", entry, 1).try_cast("int")).withColumn("text", F.when(F.col("number").isNotNull(), F.regexp_extract("line", entry, 2)).otherwise(F.col("line")))
    rows = rows.withColumn("island", F.count("number").over(order)).where("island > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    return rows.groupBy("doc", "code", "island").agg(F.first("number", True).alias("number"), F.trim(F.regexp_replace(joined, r"\s+", " ")).alias("text")).drop("island")


def outcomes(found: DataFrame) -> DataFrame:
    """doc, code, number, text of course outcomes 1 to 12."""
    return numbered(found, OUTCOMES, (r"^\s*REFERENCES?\s*:?", MAPPING), r"^\s*Upon completion").where(F.col("number").between(1, 12) & (F.length("text") > 3))


def references(found: DataFrame) -> DataFrame:
    return numbered(found, REFERENCES, (MAPPING,))


def subject_names(found: DataFrame) -> DataFrame:
    """doc, code, name: what stands after the code on the heading's line, before its number."""
    line = F.get(F.split("section", "\n"), F.lit(0))
    name = F.regexp_extract(line, r"^\s*\S+\s+(.+?)\s{2,}\d*\s*$", 1)
    return found.select("doc", "code", F.trim(F.regexp_replace(name, r"\s+", " ")).alias("name"))
