"""Labels for people: marks, exams, colleges, years, sizes and the order of ingest stages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How exams are named, and the place of each stage's two names in the order of the pipeline.
EXAMS = {"endsem": "End semester", "assessment": "Assessment", "quiz": "Quiz", "supplementary": "Supplementary", "retest": "Retest"}
STAGES = {
    "queued": 0, "extracting": 0, "extracted": 1, "segmenting": 1, "segmented": 2, "embedding": 2, "embedded": 3, "clustering": 3,
    "clustered": 4, "enriching": 4, "enriched": 5, "ready": 6, "failed": -1,
}


def _named(key: Column, names: dict) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in names.items()])


def marks(n: Column) -> Column:
    return F.coalesce(F.concat(n.cast("string"), F.lit("m")), F.lit("-"))


def exam(kind: Column) -> Column:
    return _named(kind, EXAMS)


def college(name: Column) -> Column:
    """No college is one that sets its papers centrally."""
    return F.coalesce(name, F.lit("Centrally set"))


def years(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "no sittings").when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def share(value: Column) -> Column:
    return F.concat(F.floor(value * 100 + 0.5).cast("string"), F.lit("%"))


def file_size(size: Column) -> Column:
    kilo, mega = F.lit(1024), F.lit(1024 * 1024)
    tenths = F.format_string("%.1f MB", size / mega)
    return F.when(size < kilo, F.concat(size.cast("string"), F.lit(" B"))).when(size < mega, F.concat(F.floor(size / kilo + 0.5).cast("string"), F.lit(" KB"))).otherwise(tenths)


def stage(name: Column) -> Column:
    """The index of a stage, by its finished or its running name; -1 for failed and unknown ones."""
    return F.coalesce(_named(name, STAGES), F.lit(-1))
