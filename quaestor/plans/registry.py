"""Queries by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators import ranking, recurrence
from quaestor.plans import binding
from quaestor.plans.saving import tabled

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str, bound: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (binding.SQL if bound else "") + sql
        return f

    return add


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters; one not seen since 1998 counts half, as evidence from before a revision of the syllabus."""
    before = F.when(F.col("last_year") < 1998, 0.5).otherwise(1.0)
    return recurrence.cluster_stats(binding.questions(spark, sf_dir), discount=before)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), ((F.col("p_size") - 1) % 5 + 1).alias("unit_no"))
    return recurrence.scored(clusters(spark, sf_dir).join(part, "part_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_scores(spark, sf_dir).orderBy(F.desc("expected_marks"), "subject_id", "part_id").limit(20)


@query("SELECT subject_id, part_id, round(freq, 6) AS freq FROM clusters")
def cluster_decayed_frequency(spark, sf_dir):
    return clusters(spark, sf_dir).select("subject_id", "part_id", F.round("freq", 6).alias("freq"))


@query("SELECT subject_id, part_id, round(CAST(overdue AS DOUBLE), 6) AS overdue FROM clusters")
def cluster_overdue(spark, sf_dir):
    return clusters(spark, sf_dir).select("subject_id", "part_id", F.round("overdue", 6).alias("overdue"))


@query("SELECT subject_id, part_id, CASE WHEN n >= 2 THEN round((last_year - first_year) / CAST(n - 1 AS DOUBLE), 6) END AS mean_gap FROM clusters")
def cluster_mean_gap(spark, sf_dir):
    gap = F.when(F.col("n") >= 2, F.round(F.try_divide((F.col("last_year") - F.col("first_year")).cast("double"), F.col("n") - 1), 6))
    return clusters(spark, sf_dir).select("subject_id", "part_id", gap.alias("mean_gap"))


@query("SELECT subject_id, part_id, unit_no, round(CAST(quota AS DOUBLE), 6) AS quota FROM scored")
def unit_quota_pressure(spark, sf_dir):
    return scores(spark, sf_dir).select("subject_id", "part_id", "unit_no", F.round("quota", 6).alias("quota"))


@query("SELECT subject_id, part_id, round(score, 6) AS score, round(expected_marks, 6) AS expected_marks FROM expected")
def cluster_scores(spark, sf_dir):
    return scores(spark, sf_dir).select("subject_id", "part_id", F.round("score", 6).alias("score"), F.round("expected_marks", 6).alias("expected_marks"))


@query("SELECT subject_id, part_id, row_number() OVER (PARTITION BY subject_id ORDER BY round(expected_marks, 6) DESC, part_id) AS place, row_number() OVER (ORDER BY round(expected_marks, 6) DESC, subject_id, part_id) AS overall FROM expected")
def cluster_ranks(spark, sf_dir):
    """Places of clusters in their subject and among all, by expected marks: sorted by ranges, so no task holds a subject, let alone all."""
    rows = scores(spark, sf_dir).select("subject_id", "part_id", F.round("expected_marks", 6).alias("worth"))
    rows = ranking.ranked(rows, ["subject_id"], [F.desc("worth"), F.col("part_id")], tabled)
    rows = ranking.ranked(rows, [], [F.desc("worth"), F.col("subject_id"), F.col("part_id")], tabled, "overall")
    return rows.select("subject_id", "part_id", "place", "overall")


_RATED = "(SELECT subject_id, avg(CASE WHEN years >= 2 THEN 1.0 ELSE 0.0 END) AS rate FROM clusters GROUP BY 1)"


@query(f"""SELECT c.subject_id, round(rate, 6) AS repetition_rate, CASE WHEN papers < 3 THEN 'low' WHEN rate >= 0.25 THEN 'high' WHEN rate >= 0.1 THEN 'medium' ELSE 'low' END AS regime
FROM {_RATED} c JOIN (SELECT subject_id, count(*) AS papers FROM papers GROUP BY 1) p USING (subject_id)""")
def subject_regime(spark, sf_dir):
    rate = clusters(spark, sf_dir).groupBy("subject_id").agg(F.avg((F.col("years") >= 2).cast("double")).alias("rate"))
    papers = binding.papers(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("papers"))
    regime = F.when(F.col("papers") < 3, "low").when(F.col("rate") >= 0.25, "high").when(F.col("rate") >= 0.1, "medium").otherwise("low")
    return rate.join(papers, "subject_id").select("subject_id", F.round("rate", 6).alias("repetition_rate"), regime.alias("regime"))


# What is said of a subject that repeats much, somewhat or hardly, and of one with too few papers.
STATEMENTS = {
    "few": "Only {papers} paper(s) for this subject so far. Guidance here is topic-level, from the syllabus, until more papers are contributed.",
    "high": "{repeated} questions have repeated across {papers} papers.",
    "medium": "Some questions repeat; topic-level guidance is stronger here.",
    "low": "Questions rarely repeat in this subject. Guidance here is topic-level.",
}
_SAID = {k: "'" + v.replace("{papers}", "' || papers || '").replace("{repeated}", "' || repeated || '") + "'" for k, v in STATEMENTS.items()}


@query(f"""SELECT subject_id, exam_type, papers, CASE WHEN papers < 3 THEN {_SAID["few"]} WHEN repeated / CAST(found AS DOUBLE) >= 0.25 THEN {_SAID["high"]} WHEN repeated / CAST(found AS DOUBLE) >= 0.1 THEN {_SAID["medium"]} ELSE {_SAID["low"]} END AS statement
FROM (SELECT subject_id, exam_type, count(*) AS papers FROM papers GROUP BY 1, 2) JOIN (SELECT subject_id, exam_type, count(*) AS found, count(*) FILTER (years > 1) AS repeated FROM (SELECT subject_id, exam_type, part_id, count(DISTINCT exam_year) AS years FROM questions GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (subject_id, exam_type)""")
def regime_statements(spark, sf_dir):
    """What is said about how much a subject repeats, for each kind of exam."""
    keys = ["subject_id", "exam_type"]
    years = binding.questions(spark, sf_dir).groupBy(*keys, "part_id").agg(F.size(F.collect_set("exam_year")).alias("years"))
    rate = years.groupBy(*keys).agg(F.count("*").alias("found"), F.count_if(F.col("years") > 1).alias("repeated"))
    rows = binding.papers(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("papers")).join(rate, keys)
    share = F.col("repeated") / F.col("found")
    said = lambda k: F.replace(F.replace(F.lit(STATEMENTS[k]), F.lit("{papers}"), F.col("papers").cast("string")), F.lit("{repeated}"), F.col("repeated").cast("string"))
    statement = F.when(F.col("papers") < 3, said("few")).when(share >= 0.25, said("high")).when(share >= 0.1, said("medium")).otherwise(said("low"))
    return rows.select(*keys, "papers", statement.alias("statement"))


@query(""", picked AS (SELECT * FROM questions WHERE exam_type IN ('endsem', 'supplementary') AND college = 'CEG'),
k AS (SELECT subject_id, part_id, sum(pow(0.9, greatest(0, 2002 - exam_year))) AS freq, max(marks) AS marks, CASE WHEN count(*) = 1 THEN least(greatest(0, 2002 - max(exam_year)), 3.0) WHEN max(exam_year) = min(exam_year) THEN 1.0
  ELSE least(greatest(0, 2002 - max(exam_year)) * (count(*) - 1.0) / nullif(max(exam_year) - min(exam_year), 0), 3.0) END AS overdue FROM picked GROUP BY 1, 2),
u AS (SELECT k.*, CASE WHEN p_size > 20 THEN (p_size - 1) % 5 + 1 END AS unit_no FROM k JOIN part ON part_id = p_partkey),
c AS (SELECT subject_id, unit_no, count(*) AS competitors FROM u WHERE unit_no IS NOT NULL GROUP BY 1, 2),
w AS (SELECT u.subject_id, part_id, u.marks, 0.4 * freq + 0.3 * overdue + 0.2 * CASE WHEN competitors IS NULL THEN 0.0 ELSE least(2.0 / competitors, 1.0) END + 0.1 * u.marks / greatest(1, max(u.marks) OVER (PARTITION BY u.subject_id)) AS score FROM u LEFT JOIN c ON c.subject_id = u.subject_id AND c.unit_no = u.unit_no)
SELECT subject_id, part_id, round(score, 6) AS score, round(score / sum(score) OVER (PARTITION BY subject_id) * marks, 6) AS expected_marks FROM w""")
def weighted_scores(spark, sf_dir):
    """Scores of a slice with weights and decay of the caller's own; most of the parts here have no unit."""
    found = recurrence.cluster_stats(recurrence.sliced(binding.questions(spark, sf_dir), ("endsem", "supplementary"), "CEG"), decay=0.9)
    unit = F.when(F.col("p_size") > 20, (F.col("p_size") - 1) % 5 + 1)
    part = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), unit.alias("unit_no"))
    rows = recurrence.scored(found.join(part, "part_id"), (0.4, 0.3, 0.2, 0.1))
    return rows.select("subject_id", "part_id", F.round("score", 6).alias("score"), F.round("expected_marks", 6).alias("expected_marks"))


@query(f"""SELECT n_nationkey AS subject_id, coalesce(p.papers, 0) AS papers, coalesce(q.questions, 0) AS questions, coalesce(k.clusters, 0) AS clusters, coalesce(c.concepts, 0) AS concepts, p.first_year, p.last_year,
round(r.rate, 6) AS repetition_rate, CASE WHEN r.rate IS NULL THEN NULL WHEN papers < 3 THEN 'low' WHEN rate >= 0.25 THEN 'high' WHEN rate >= 0.1 THEN 'medium' ELSE 'low' END AS regime
FROM nation LEFT JOIN (SELECT subject_id, count(*) AS papers, min(exam_year) AS first_year, max(exam_year) AS last_year FROM papers GROUP BY 1) p ON p.subject_id = n_nationkey
LEFT JOIN (SELECT subject_id, count(*) AS questions FROM questions GROUP BY 1) q ON q.subject_id = n_nationkey LEFT JOIN (SELECT subject_id, count(*) AS clusters FROM clusters GROUP BY 1) k ON k.subject_id = n_nationkey
LEFT JOIN (SELECT subject_id, count(DISTINCT p_type) AS concepts FROM clusters JOIN part ON p_partkey = part_id GROUP BY 1) c ON c.subject_id = n_nationkey LEFT JOIN {_RATED} r ON r.subject_id = n_nationkey""")
def subject_summary(spark, sf_dir):
    """Subjects with their counts, years and regime, null until there is one; each child is counted before it is joined."""
    p = binding.papers(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("papers"), F.min("exam_year").alias("first_year"), F.max("exam_year").alias("last_year"))
    found = clusters(spark, sf_dir).select("subject_id", "part_id", "n", "years")
    q = found.groupBy("subject_id").agg(F.sum("n").alias("questions"), F.count("*").alias("clusters"), F.avg((F.col("years") >= 2).cast("double")).alias("rate"))
    part = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_type")
    c = found.join(part, "part_id").select("subject_id", "p_type").distinct().groupBy("subject_id").agg(F.count("*").alias("concepts"))
    subjects = binding.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject_id"))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    regime = F.when(F.col("rate").isNull(), None).when(F.col("papers") < 3, "low").when(F.col("rate") >= 0.25, "high").when(F.col("rate") >= 0.1, "medium").otherwise("low")
    out = subjects.join(p, "subject_id", "left").join(q, "subject_id", "left").join(c, "subject_id", "left")
    return out.select("subject_id", zero("papers"), zero("questions"), zero("clusters"), zero("concepts"), "first_year", "last_year", F.round("rate", 6).alias("repetition_rate"), regime.alias("regime"))


@query(""", u AS (SELECT c.subject_id, part_id, CASE WHEN p_size > 5 THEN (p_size - 1) % 5 + 1 END AS unit_no FROM clusters c JOIN part ON p_partkey = part_id),
s AS (SELECT DISTINCT subject_id, unit_no, 2 * unit_no AS slots FROM u WHERE unit_no < 5), n AS (SELECT subject_id, unit_no, count(*) AS k FROM u WHERE unit_no IS NOT NULL GROUP BY 1, 2)
SELECT u.subject_id, part_id, round(CASE WHEN u.unit_no IS NULL THEN 0.0 ELSE least(coalesce(slots, 0) / CAST(k AS DOUBLE), 1.0) END, 6) AS quota FROM u LEFT JOIN n ON n.subject_id = u.subject_id AND n.unit_no = u.unit_no LEFT JOIN s ON s.subject_id = u.subject_id AND s.unit_no = u.unit_no""")
def slot_pressure(spark, sf_dir):
    """Quota pressure from a table of slots: clusters without a unit and units without slots have none."""
    unit = F.when(F.col("p_size") > 5, (F.col("p_size") - 1) % 5 + 1)
    part = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), unit.alias("unit_no"))
    rows = clusters(spark, sf_dir).select("subject_id", "part_id").join(part, "part_id")
    slots = rows.where("unit_no < 5").select("subject_id", "unit_no").distinct().withColumn("slots", 2 * F.col("unit_no"))
    return recurrence.pressure(rows, slots).select("subject_id", "part_id", F.round("quota", 6).alias("quota"))


@query(""", r AS (SELECT subject_id, part_id, sum(pow(0.75, greatest(0, 2002 - exam_year))) AS raw FROM questions GROUP BY 1, 2), l AS (SELECT n_nationkey AS subject_id, 0.25 * (1 + n_regionkey % 3) AS discount FROM nation WHERE n_nationkey % 4 > 0)
SELECT subject_id, part_id, round(raw * coalesce(discount, 1.0), 6) AS freq FROM r LEFT JOIN l USING (subject_id)""")
def inherited_frequency(spark, sf_dir):
    """Decayed frequency times the discount of the subject's lineage."""
    decay = F.pow(F.lit(0.75), F.greatest(F.lit(0), 2002 - F.col("exam_year")).cast("double"))
    raw = binding.questions(spark, sf_dir).groupBy("subject_id", "part_id").agg(F.sum(decay).alias("raw"))
    lineage = binding.table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("subject_id"), (0.25 * (1 + F.col("n_regionkey") % 3)).alias("discount"))
    return recurrence.inherited(raw, lineage).select("subject_id", "part_id", F.round("freq", 6).alias("freq"))


def lineage_scores(spark, sf_dir):
    """Evidence of a subject and of all its ancestors, over several revisions, each discounted along its path."""
    decay = F.pow(F.lit(0.75), F.greatest(F.lit(0), 2002 - F.col("exam_year")).cast("double"))
    raw = binding.questions(spark, sf_dir).groupBy("subject_id", "part_id").agg(F.sum(decay).alias("raw"))
    nation = binding.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("subject_id"), (0.25 * (1 + F.col("n_regionkey") % 3)).cast("double").alias("discount"))
    edges = nation.select("subject_id", F.explode(F.array(F.col("subject_id") - 4, F.col("subject_id") - 9)).alias("ancestor"), "discount").where("ancestor >= 0")
    found = recurrence.with_ancestors(raw.withColumn("subject_id", F.col("subject_id").cast("long")), recurrence.lineages(edges, tabled))
    return found.select("subject_id", "part_id", F.round("raw", 6).alias("raw"), F.round("freq", 6).alias("freq"))


QUERIES["lineage_scores"] = lineage_scores
SQL["lineage_scores"] = binding.SQL.replace("WITH papers", "WITH RECURSIVE papers", 1) + """, r AS (SELECT subject_id, part_id, sum(pow(0.75, greatest(0, 2002 - exam_year))) AS raw FROM questions GROUP BY 1, 2),
edges AS (SELECT n_nationkey AS subject_id, n_nationkey - d AS ancestor, 0.25::DOUBLE * (1 + n_regionkey % 3) AS discount FROM nation, (VALUES (4), (9)) AS v(d) WHERE n_nationkey >= d),
paths AS (SELECT subject_id, ancestor, discount AS weight FROM edges UNION SELECT p.subject_id, e.ancestor, p.weight * e.discount FROM paths p JOIN edges e ON e.subject_id = p.ancestor),
best AS (SELECT subject_id, ancestor, max(weight) AS weight FROM paths GROUP BY 1, 2),
joined AS (SELECT subject_id, part_id, raw AS own, raw AS part FROM r UNION ALL SELECT b.subject_id, part_id, 0, raw * weight FROM r JOIN best b ON r.subject_id = b.ancestor)
SELECT subject_id, part_id, round(sum(own), 6) AS raw, round(sum(part), 6) AS freq FROM joined GROUP BY 1, 2"""


@query("SELECT paper_id, subject_id, exam_year FROM papers WHERE exam_type = 'endsem' AND college IS NULL")
def stats_slice(spark, sf_dir):
    return binding.papers(spark, sf_dir).where("exam_type = 'endsem' AND college IS NULL").select("paper_id", "subject_id", "exam_year")


@query("""SELECT paper_id, CAST(sum(CASE WHEN n = 1 THEN s ELSE floor(s / 2.0 + 0.5) END) AS BIGINT) AS obtainable
FROM (SELECT paper_id, number, count(*) AS n, sum(marks) AS s FROM questions GROUP BY 1, 2) GROUP BY 1""")
def obtainable_marks(spark, sf_dir):
    groups = binding.questions(spark, sf_dir).groupBy("paper_id", "number").agg(F.count("*").alias("n"), F.sum("marks").alias("s"))
    return groups.groupBy("paper_id").agg(F.sum(F.when(F.col("n") == 1, F.col("s")).otherwise(F.floor(F.col("s") / 2 + 0.5))).cast("long").alias("obtainable"))
