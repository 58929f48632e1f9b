"""Queries of reads: projections, scopes, queues, candidates, merges and evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators import graph, reads, scope, similar, tables
from quaestor.plans import binding, registry, relations, statistics
from quaestor.plans.binding import LABELLED, table
from quaestor.plans.registry import query
from quaestor.plans.saving import saved, tabled


@query("""SELECT CAST(paper_id AS VARCHAR) AS paper_id, CAST(subject_id AS VARCHAR) AS subject_id, session AS exam_session, exam_year, exam_type, college, CASE WHEN paper_id % 4 = 0 THEN 'BT' END AS paper_set,
sha256('paper ' || CAST(paper_id AS VARCHAR)) AS content_hash, CASE paper_id % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'vision' ELSE 'dirty_ocr_recovered' END AS text_source, CAST(NULL AS VARCHAR) AS blob_url, 1 + paper_id % 6 AS page_count, 'ready' AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at
FROM (SELECT papers.*, o_orderdate, CASE WHEN month(o_orderdate) <= 6 THEN 'apr-may' ELSE 'nov-dec' END AS session FROM papers JOIN orders ON o_orderkey = paper_id)""")
def paper_projection(spark, sf_dir):
    """What is shown of a paper; where its file is stored never is."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))
    p = F.col("paper_id")
    return binding.papers(spark, sf_dir).join(days, "paper_id").select(
        p.cast("string").alias("paper_id"), F.col("subject_id").cast("string").alias("subject_id"), F.col("session").alias("exam_session"), "exam_year", "exam_type", "college", F.when(p % 4 == 0, "BT").alias("paper_set"),
        F.sha2(F.concat(F.lit("paper "), p.cast("string")), 256).alias("content_hash"), F.when(p % 3 == 0, "digital").when(p % 3 == 1, "vision").otherwise("dirty_ocr_recovered").alias("text_source"),
        F.lit(None).cast("string").alias("blob_url"), (1 + p % 6).alias("page_count"), F.lit("ready").alias("status"), "created_at",
    )


_Q = "CASE number % 4 WHEN 0 THEN CAST(number AS VARCHAR) WHEN 1 THEN 'Q' || CAST(number AS VARCHAR) || 'x' WHEN 2 THEN 'appendix' ELSE '1' || CAST(number AS VARCHAR) END"
_P = "CASE part_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END"


def _numbered(spark, sf_dir):
    n = F.col("number").cast("string")
    number = F.when(F.col("number") % 4 == 0, n).when(F.col("number") % 4 == 1, F.concat(F.lit("Q"), n, F.lit("x"))).when(F.col("number") % 4 == 2, "appendix").otherwise(F.concat(F.lit("1"), n))
    part = F.when(F.col("part_id") % 4 == 0, "A").when(F.col("part_id") % 4 == 1, "B").when(F.col("part_id") % 4 == 2, "C")
    return binding.labelled(spark, sf_dir).withColumn("q_number", number).withColumn("part", part)


@query(LABELLED + f"""SELECT paper_id, number, nth, row_number() OVER (PARTITION BY paper_id ORDER BY {_P} NULLS LAST, CAST(nullif(regexp_replace({_Q}, '[^0-9]', '', 'g'), '') AS INT) NULLS LAST, {_Q}, label NULLS FIRST, number, nth) AS place FROM labelled""")
def paper_order(spark, sf_dir):
    rows = _numbered(spark, sf_dir)
    digits = F.nullif(F.regexp_replace("q_number", r"\D", ""), F.lit("")).try_cast("int")
    order = Window.partitionBy("paper_id").orderBy(F.asc_nulls_last("part"), digits.asc_nulls_last(), "q_number", F.asc_nulls_first("label"), "number", "nth")
    return rows.select("paper_id", "number", F.col("nth").cast("long").alias("nth"), F.row_number().over(order).cast("long").alias("place"))


@query(LABELLED + f"""SELECT CAST(paper_id AS VARCHAR) || '-' || CAST(number AS VARCHAR) || '-' || CAST(nth AS VARCHAR) AS question_id, paper_id, {_Q} AS q_number, label AS part_label, p_name AS text, marks, or_group AS or_group_id, (p_size - 1) % 5 + 1 AS unit_hint,
1 + number % 3 AS page_no, round(0.5 + number / 16.0, 4) AS seg_confidence, {_P} AS part, 'CO' || CAST(1 + number % 5 AS VARCHAR) AS co_code, 1 + number % 6 AS bl_level FROM labelled JOIN part ON p_partkey = part_id""")
def question_projection(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("text"), ((F.col("p_size") - 1) % 5 + 1).alias("unit_hint"))
    number = F.col("number")
    return _numbered(spark, sf_dir).join(part, "part_id").select(
        F.concat_ws("-", F.col("paper_id").cast("string"), number.cast("string"), F.col("nth").cast("string")).alias("question_id"), "paper_id", "q_number", F.col("label").alias("part_label"), "text", "marks", F.col("or_group").alias("or_group_id"),
        "unit_hint", (1 + number % 3).alias("page_no"), F.round(0.5 + number / 16.0, 4).alias("seg_confidence"), "part", F.concat(F.lit("CO"), (1 + number % 5).cast("string")).alias("co_code"), (1 + number % 6).alias("bl_level"),
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7", bound=False)
def paper_lookup(spark, sf_dir):
    return reads.lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", "7")


@query("SELECT event_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 10", bound=False)
def user_latest(spark, sf_dir):
    return reads.Private(table(spark, sf_dir, "events")).latest(7, "ts", "event_id", 10).select("event_id", "ts", "event_type")


@query("SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1", bound=False)
def user_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


@query("""WITH k AS (SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS concept, event_type, value FROM events),
done AS (SELECT DISTINCT user_id, concept FROM k WHERE event_type = 'purchase' AND concept < 20), plan AS (SELECT unnest(range(20)) AS concept)
SELECT u.user_id, coalesce(done, 0) AS done, CAST(20 AS BIGINT) AS total, coalesce(marks_done, 0) AS marks_done, CAST(210 AS BIGINT) AS marks_total, minutes
FROM (SELECT user_id, round(sum(value) / 10, 4) AS minutes FROM k GROUP BY 1) u LEFT JOIN (SELECT user_id, count(*) AS done, CAST(sum(concept + 1) AS BIGINT) AS marks_done FROM done GROUP BY 1) d ON u.user_id = d.user_id""", bound=False)
def session_progress(spark, sf_dir):
    """A plan of twenty concepts, concept k worth k + 1 marks: what each user has mastered of it, and the minutes."""
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("concept"), "event_type", "value")
    minutes = rows.groupBy("user_id").agg(F.round(F.sum("value") / 10, 4).alias("minutes"))
    done = rows.where("event_type = 'purchase' and concept < 20").select("user_id", "concept").distinct().groupBy("user_id").agg(F.count("*").alias("done"), F.sum(F.col("concept") + 1).alias("marks_done"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return minutes.join(done, "user_id", "left").select("user_id", zero("done"), F.lit(20).cast("long").alias("total"), zero("marks_done"), F.lit(210).cast("long").alias("marks_total"), "minutes")


@query(statistics.CONCEPTS + """, syllabus AS (SELECT n_nationkey AS subject_id, p_type AS concept_id FROM nation JOIN (SELECT DISTINCT p_type FROM part) ON length(p_type) % 5 = n_nationkey % 5)
SELECT CASE WHEN s.concept_id IS NULL THEN 'out' ELSE 'in' END AS syllabus, count(*) FILTER (evidence >= 40) AS often, count(*) FILTER (evidence < 40) AS rarely, count(*) FILTER (evidence IS NULL) AS never
FROM syllabus s FULL JOIN concept_rows c ON s.subject_id = c.subject_id AND s.concept_id = c.concept_id GROUP BY 1""")
def syllabus_coverage(spark, sf_dir):
    """Concepts in the syllabus and out of it, by how often papers ask for them."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("concept_id")).distinct().withColumn("k", F.length("concept_id") % 5)
    syllabus = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject_id"), (F.col("n_nationkey") % 5).alias("k")).join(kinds, "k").select("subject_id", "concept_id", F.lit(True).alias("listed"))
    both = syllabus.join(statistics.concept_rows(spark, sf_dir).select("subject_id", "concept_id", "evidence"), ["subject_id", "concept_id"], "full")
    e = F.col("evidence")
    return both.groupBy(F.when(F.col("listed"), "in").otherwise("out").alias("syllabus")).agg(F.count_if(e >= 40).alias("often"), F.count_if(e < 40).alias("rarely"), F.count_if(e.isNull()).alias("never"))


_GRAMS = "SELECT p_partkey, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram, len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS n FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)"


@query(f"""WITH g AS ({_GRAMS}), c AS (SELECT x.p_partkey AS a, y.p_partkey AS b, count(*) AS both_, any_value(x.n) + any_value(y.n) - count(*) AS either FROM g x JOIN g y ON x.gram = y.gram AND x.p_partkey < y.p_partkey GROUP BY 1, 2)
SELECT a, b, round(CAST(both_ AS DOUBLE) / either, 6) AS similarity FROM c WHERE 2 * both_ >= either""", bound=False)
def lexical_candidates(spark, sf_dir):
    """Pairs of question texts with half of their word pairs in common: what stands in for vectors where there are none."""
    words = F.split("p_name", " ")
    pairs = F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    rows = table(spark, sf_dir, "part").where("p_name like '% %'").select(F.col("p_partkey").alias("id"), F.array_sort(pairs).alias("grams"))
    return similar.pairs(rows, tabled).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(""", j AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN user_id % 25 END AS subject_id, CASE WHEN event_id % 6 IN (0, 1) THEN user_id * 4 + event_id % 7 END AS paper_id,
CASE WHEN event_id % 6 = 2 THEN user_id * 4 + 1 WHEN event_id % 6 = 3 THEN user_id * 4 + 2 END AS question_paper, CASE WHEN event_id % 6 = 4 THEN user_id % 30 END AS cluster_id FROM events)
SELECT event_id, CASE WHEN j.subject_id IS NOT NULL THEN j.subject_id WHEN j.paper_id IS NOT NULL THEN p.subject_id WHEN question_paper IS NOT NULL THEN q.subject_id ELSE s_nationkey END AS subject
FROM j LEFT JOIN papers p ON p.paper_id = j.paper_id LEFT JOIN papers q ON q.paper_id = question_paper AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = question_paper AND l_linenumber = 1) LEFT JOIN supplier ON s_suppkey = cluster_id""")
def job_subjects(spark, sf_dir):
    k, user = F.col("event_id") % 6, F.col("user_id")
    jobs = table(spark, sf_dir, "events").select(
        "event_id", F.when(k == 0, user % 25).alias("subject_id"), F.when(k.isin(0, 1), user * 4 + F.col("event_id") % 7).alias("paper_id"), F.when(k == 2, F.concat((user * 4 + 1).cast("string"), F.lit("-1"))).alias("question_id"),
        F.when(k == 3, F.array(F.concat((user * 4 + 2).cast("string"), F.lit("-1")), F.lit("9-9"))).alias("question_ids"), F.when(k == 4, F.array(user % 30)).alias("cluster_ids"),
    )
    papers = binding.papers(spark, sf_dir)
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("paper_id")).distinct()
    questions = first.join(papers, "paper_id").select(F.concat(F.col("paper_id").cast("string"), F.lit("-1")).alias("question_id"), "subject_id")
    clusters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cluster_id"), F.col("s_nationkey").alias("subject_id"))
    return reads.attributed(jobs, papers, questions, clusters).select("event_id", "subject")


@query("""SELECT o_orderkey AS review_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'dismissed' END, o_totalprice, o_orderkey) AS place FROM orders""", bound=False)
def review_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("dismissed")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(status, "o_totalprice", "o_orderkey"))
    return rows.select(F.col("o_orderkey").alias("review_id"), place.cast("long").alias("place"))


_MASTERY = "SELECT user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS concept, count(*) FILTER (event_type = 'purchase') AS passed, max(ts) AS last_at FROM events GROUP BY 1, 2"


@query(f"WITH m AS ({_MASTERY}) SELECT user_id, concept, last_at + to_days(CAST(1 + 2 * passed AS INT)) AS due_at FROM m WHERE last_at + to_days(CAST(1 + 2 * passed AS INT)) <= (SELECT max(ts) FROM events)", bound=False)
def due_sweep(spark, sf_dir):
    """What each user should see again by the end of the events: a day after the last time, two more for each test passed."""
    events = table(spark, sf_dir, "events")
    rows = events.groupBy("user_id", F.get_json_object("props", "$.k").cast("long").alias("concept")).agg(F.count_if(F.col("event_type") == "purchase").alias("passed"), F.max("ts").alias("last_at"))
    end = events.agg(F.max("ts").alias("end"))  # one row
    days = F.make_dt_interval((1 + 2 * F.col("passed")).cast("int"))
    return reads.due(rows.withColumn("due_at", F.col("last_at") + days).join(F.broadcast(end)), F.col("end")).select("user_id", "concept", "due_at")


@query("SELECT DISTINCT CASE WHEN k % 10 = 0 THEN k + 1 ELSE k END AS paper_id, user_id FROM (SELECT CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, user_id FROM events)", bound=False)
def rehash_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("long").alias("paper_id"), "user_id")
    winners = rows.select("paper_id").distinct().where("paper_id % 10 = 0").select(F.col("paper_id").alias("loser"), (F.col("paper_id") + 1).alias("winner"))
    return reads.rehashed(rows, winners)


_CHAINED = "SELECT lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS a, vec_id AS b, round((list_dot_product(CAST(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]), CAST(embedding AS DOUBLE[])) + 1) / 2, 6) AS confidence FROM embeddings"


@query(f"WITH c AS ({_CHAINED}) SELECT a, b, confidence, CASE WHEN confidence > 0.85 THEN 'auto' WHEN confidence >= 0.6 THEN 'review' ELSE 'reject' END AS action FROM c WHERE a IS NOT NULL", bound=False)
def confidence_gate(spark, sf_dir):
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.select(F.lag("vec_id").over(order).alias("a"), F.col("vec_id").alias("b"), F.lag("e").over(order).alias("x"), "e").where("a is not null")
    dot = F.aggregate(F.zip_with("x", "e", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.select("a", "b", F.round((dot + 1) / 2, 6).alias("confidence"))
    return rows.withColumn("action", reads.gate(F.col("confidence")))


_PAIRED = "SELECT p_partkey AS cluster, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN p_partkey - 1 ELSE p_partkey END AS survivor FROM part"


@query(f"WITH s AS ({_PAIRED}) SELECT l_orderkey, l_linenumber, l_partkey AS was, survivor AS cluster_id, CASE WHEN survivor <> l_partkey THEN 'agent' ELSE 'rule' END AS decided_by, CASE WHEN survivor <> l_partkey THEN 0.9 ELSE 0.5 END AS confidence FROM lineitem JOIN s ON cluster = l_partkey", bound=False)
def merge_moves(spark, sf_dir):
    """Memberships after merges."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    members = table(spark, sf_dir, "lineitem").select(key.alias("question_id"), F.col("l_partkey").alias("cluster_id"), F.lit("rule").alias("decided_by"), F.lit(0.5).alias("confidence"))
    out = reads.moved(members, _survivors(spark, sf_dir), "agent", 0.9)
    return out.select("question_id.l_orderkey", "question_id.l_linenumber", F.col("question_id.l_partkey").alias("was"), "cluster_id", "decided_by", "confidence")


def _survivors(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("cluster"), F.when((F.col("p_size") > 25) & (k % 2 == 0), k - 1).otherwise(k).alias("survivor"))


@query(f"WITH s AS ({_PAIRED}) SELECT p_partkey AS cluster_id, p_size + CASE WHEN p_partkey IN (SELECT survivor FROM s WHERE cluster <> survivor) THEN 1 ELSE 0 END AS version, p_name AS canonical FROM part WHERE p_partkey IN (SELECT cluster FROM s WHERE cluster = survivor)", bound=False)
def merged_clusters(spark, sf_dir):
    """Clusters after merges: survivors keep their text and get the next version."""
    clusters = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster_id"), F.col("p_size").alias("version"), F.col("p_name").alias("canonical"))
    return reads.after_merges(clusters, _survivors(spark, sf_dir))


@query("SELECT p_partkey AS cluster_id, p_size + CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) THEN 1 ELSE 0 END AS version FROM part", bound=False)
def split_clusters(spark, sf_dir):
    """Versions of clusters after every seventh question has left for a cluster of its own."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    members = table(spark, sf_dir, "lineitem").select(key.alias("question_id"), F.col("l_partkey").alias("cluster_id")).distinct()
    mapping = members.where("question_id.l_linenumber = 7").select("question_id", (F.col("cluster_id") + 10_000_000).alias("to_cluster"))
    clusters = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster_id"), F.col("p_size").alias("version"))
    return reads.split(members, clusters, mapping)[1]


@query(relations._EDGES + """, d AS (SELECT p_type, p_size, CAST(coalesce(max(hops), 0) AS BIGINT) AS depth FROM nodes LEFT JOIN walk ON origin = p_type || '/' || p_size GROUP BY 1, 2),
r AS (SELECT p_type, p_size, round(avg(p_retailprice), 4) AS roi FROM part GROUP BY 1, 2)
SELECT p_type || '/' || p_size AS node, row_number() OVER (PARTITION BY p_type ORDER BY depth, roi DESC, p_type || '/' || p_size) AS place FROM d JOIN r USING (p_type, p_size)""", bound=False)
def mastery_order(spark, sf_dir):
    """Prerequisites first; of concepts as deep, what pays most."""
    edges, nodes = relations.prerequisites(spark, sf_dir)
    node = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    roi = table(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("roi")).select("p_type", node.alias("node"), "roi")
    order = Window.partitionBy("p_type").orderBy("depth", F.desc("roi"), "node")
    return graph.depths(tabled(edges), nodes, tabled).join(roi, "node").select("node", F.row_number().over(order).cast("long").alias("place"))


@query(statistics.CONCEPTS + """, c AS (SELECT subject_id, unit_no, concept_id, count(*) AS n, round(sum(CAST(expected_marks AS DOUBLE)), 4) AS m FROM linked WHERE n >= 3 GROUP BY ALL)
SELECT subject_id, unit_no, count(*) AS concepts, CAST(sum(n) AS BIGINT) AS clusters, string_agg(concept_id || ':' || CAST(n AS VARCHAR), ';' ORDER BY concept_id) AS listing FROM c GROUP BY ALL""")
def atlas(spark, sf_dir):
    """A subject's units with their concepts and how many clusters each has, nested, then written out."""
    rows = statistics.concepts.linked(statistics.evidence(spark, sf_dir)).where("n >= 3").groupBy("subject_id", "unit_no", "concept_id").agg(F.count("*").alias("n"))
    nested = rows.groupBy("subject_id", "unit_no").agg(F.array_sort(F.collect_list(F.struct("concept_id", "n"))).alias("concepts"))
    listing = F.array_join(F.transform("concepts", lambda c: F.concat_ws(":", c["concept_id"], c["n"].cast("string"))), ";")
    total = F.aggregate("concepts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return nested.select("subject_id", "unit_no", F.size("concepts").cast("long").alias("concepts"), total.alias("clusters"), listing.alias("listing"))


@query(relations._EDGES + """, m AS (SELECT p_type || '/' || p_size AS node, round(sum(p_retailprice), 4) AS marks, bool_or(p_partkey % 3 = 0) AS mastered FROM part GROUP BY 1),
below AS (SELECT node, count(*) AS dependents FROM (SELECT DISTINCT origin, node FROM walk) GROUP BY 1)
SELECT m.node, mastered, CASE WHEN mastered THEN 0 ELSE marks END AS gap, coalesce(dependents, 0) AS dependents FROM m LEFT JOIN below USING (node)""", bound=False)
def gap_map(spark, sf_dir):
    """Marks that a learner still misses by concept, and how many concepts wait for it."""
    edges, nodes = relations.prerequisites(spark, sf_dir)
    node = F.concat_ws("/", "p_type", F.col("p_size").cast("string"))
    marks = table(spark, sf_dir, "part").groupBy(node.alias("node")).agg(F.round(F.sum("p_retailprice"), 4).alias("marks"), F.bool_or(F.col("p_partkey") % 3 == 0).alias("mastered"))
    below = graph.ancestors(saved(edges), nodes, saved).groupBy("node").agg(F.count("*").alias("dependents"))
    return marks.join(below, "node", "left").select("node", "mastered", F.when(F.col("mastered"), 0.0).otherwise(F.col("marks")).alias("gap"), F.coalesce("dependents", F.lit(0).cast("long")).alias("dependents"))


@query("SELECT event_type, count(*) AS mine, (SELECT count(*) FROM events y WHERE y.user_id = 8 AND y.event_type = x.event_type) AS theirs FROM events x WHERE user_id = 7 GROUP BY 1", bound=False)
def compared_users(spark, sf_dir):
    """What two users did, by kind: each side of the join is read for its user, or the guard refuses the plan."""
    rows = table(spark, sf_dir, "events")
    of = lambda user, name: rows.where(F.col("user_id") == user).groupBy("event_type").agg(F.count("*").alias(name))
    both = of(7, "mine").join(of(8, "theirs"), "event_type", "left")
    return scope.guarded(both.select("event_type", "mine", F.coalesce("theirs", F.lit(0).cast("long")).alias("theirs")), {"events"})


_U = "(CAST(('0x' || substr(md5(CAST(subject_id AS VARCHAR) || '/' || CAST(part_id AS VARCHAR)), 1, 8)) AS BIGINT) + 1) / 4294967297.0"


@query(f"""SELECT subject_id, unit_no, part_id, place FROM (SELECT subject_id, unit_no, part_id, row_number() OVER (PARTITION BY subject_id, unit_no ORDER BY round(-ln({_U}) / (2.0 + n), 9), part_id) AS place
FROM (SELECT c.*, (p_size - 1) % 5 + 1 AS unit_no FROM clusters c JOIN part ON p_partkey = part_id)) WHERE place <= unit_no + 1""")
def exam_simulation(spark, sf_dir):
    """A made-up paper for each subject: of every unit, unit + 1 clusters drawn by weight, the same on every run."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), ((F.col("p_size") - 1) % 5 + 1).alias("unit_no"))
    pool = registry.clusters(spark, sf_dir).join(part, "part_id").select("subject_id", "unit_no", F.col("part_id").alias("id"), (2.0 + F.col("n")).alias("p"))
    slots = pool.select("subject_id", "unit_no").distinct().withColumn("slots", F.col("unit_no") + 1)
    seen = F.substring(F.md5(F.concat_ws("/", F.col("subject_id").cast("string"), F.col("id").cast("string"))), 1, 8)
    u = (F.conv(seen, 16, 10).cast("long") + 1) / F.lit(4294967297.0)
    return reads.sampled(slots, pool, ["subject_id", "unit_no"], u).select("subject_id", "unit_no", F.col("id").alias("part_id"), "place")


_BASE = {"frequency": "n DESC", "syllabus": "unit_no", "hours": "CASE unit_no WHEN 1 THEN 8 WHEN 2 THEN 9 WHEN 5 THEN 8 ELSE 10 END DESC", "random": "md5(CAST(part_id AS VARCHAR))"}
_TRAIN = ", t AS (SELECT subject_id, part_id, count(*) AS n, (any_value(p_size) - 1) % 5 + 1 AS unit_no FROM questions JOIN part ON p_partkey = part_id WHERE exam_year < 2001 GROUP BY 1, 2), test AS (SELECT subject_id, part_id, sum(marks) AS m FROM questions WHERE exam_year = 2001 GROUP BY 1, 2) "


@query(_TRAIN + " UNION ALL ".join(f"""SELECT '{k}' AS baseline, x.subject_id, round(coalesce(sum(m) FILTER (place <= 20), 0) / sum(m), 6) AS coverage
FROM test x LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {o}, part_id) AS place FROM t) r ON r.subject_id = x.subject_id AND r.part_id = x.part_id GROUP BY 1, 2""" for k, o in _BASE.items()))
def baseline_coverage(spark, sf_dir):
    """Marks of 2001 that simple orders of the clusters before it cover with twenty places."""
    rows = binding.questions(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), ((F.col("p_size") - 1) % 5 + 1).alias("unit_no"))
    train = rows.where("exam_year < 2001").groupBy("subject_id", "part_id").agg(F.count("*").alias("n")).join(part, "part_id")
    test = rows.where("exam_year = 2001").groupBy("subject_id", "part_id").agg(F.sum("marks").alias("m"))
    hours = F.when(F.col("unit_no").isin(1, 5), 8).when(F.col("unit_no") == 2, 9).otherwise(10)
    orders = {"frequency": F.desc("n"), "syllabus": F.asc("unit_no"), "hours": hours.desc(), "random": F.md5(F.col("part_id").cast("string")).asc()}
    out = None
    for name, order in orders.items():
        placed = train.withColumn("place", F.row_number().over(Window.partitionBy("subject_id").orderBy(order, "part_id")))
        found = reads.coverage(placed, test, ["subject_id"], "part_id", 20).select(F.lit(name).alias("baseline"), "subject_id", "coverage")
        out = found if out is None else out.unionByName(found)
    return out


@query(""", y AS (SELECT subject_id, part_id, exam_year, sum(marks) AS m, count(*) AS n FROM questions GROUP BY ALL), a AS (SELECT subject_id, part_id, sum(n) AS n FROM y GROUP BY ALL),
f AS (SELECT h.exam_year, a.subject_id, a.part_id, a.n - coalesce(y.n, 0) AS left_n FROM a JOIN (SELECT DISTINCT subject_id, exam_year FROM y) h USING (subject_id) LEFT JOIN y ON y.subject_id = a.subject_id AND y.part_id = a.part_id AND y.exam_year = h.exam_year),
r AS (SELECT *, row_number() OVER (PARTITION BY exam_year, subject_id ORDER BY left_n DESC, part_id) AS place FROM f WHERE left_n > 0)
SELECT y.subject_id, y.exam_year, round(coalesce(sum(m) FILTER (place <= 20), 0) / sum(m), 6) AS coverage FROM y LEFT JOIN r USING (subject_id, part_id, exam_year) GROUP BY ALL""")
def leave_one_year_out(spark, sf_dir):
    """Each year's marks that the clusters' counts in all other years cover with twenty places: totals less the year's own, one pass."""
    years = saved(binding.questions(spark, sf_dir).groupBy("subject_id", "part_id", "exam_year").agg(F.sum("marks").alias("m"), F.count("*").alias("own")))
    totals = years.groupBy("subject_id", "part_id").agg(F.sum("own").alias("n"))
    folds = years.select("subject_id", "exam_year").distinct()
    left = totals.join(folds, "subject_id").join(years.drop("m"), ["subject_id", "part_id", "exam_year"], "left").withColumn("left_n", F.col("n") - F.coalesce("own", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("exam_year", "subject_id").orderBy(F.desc("left_n"), "part_id"))
    return reads.coverage(left.where("left_n > 0").withColumn("place", place), years, ["subject_id", "exam_year"], "part_id", 20)


@query("""WITH g AS (SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT sum(n * (n - 1) / 2) AS p FROM g), s AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM g GROUP BY p_brand, p_size)), t AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM g GROUP BY p_type))
SELECT round(b.p / s.p, 6) AS precision, round(b.p / t.p, 6) AS recall FROM b, s, t""", bound=False)
def pair_quality(spark, sf_dir):
    return reads.pair_quality(table(spark, sf_dir, "part"), ["p_brand", "p_size"], ["p_type"])


@query("""WITH c AS (SELECT p_type AS concept, (length(p_type) % 5) + 1 AS unit FROM part GROUP BY 1), w AS (SELECT concept, unit, unnest(string_split(concept, ' ')) AS word FROM c)
SELECT x.concept AS from_concept, y.concept AS to_concept, count(*) AS shared FROM w x JOIN w y ON x.word = y.word AND x.unit < y.unit GROUP BY ALL HAVING count(*) >= 2""", bound=False)
def induced_prerequisites(spark, sf_dir):
    """A concept of an earlier unit leads to one of a later unit with which it shares two words or more."""
    words = table(spark, sf_dir, "part").select(F.col("p_type").alias("concept")).distinct().select("concept", (F.length("concept") % 5 + 1).alias("unit"), F.explode(F.split("concept", " ")).alias("word"))
    later = words.select("word", F.col("concept").alias("to_concept"), F.col("unit").alias("later"))
    return words.join(later, "word").where("unit < later").groupBy(F.col("concept").alias("from_concept"), "to_concept").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("""WITH q AS (SELECT l_orderkey AS paper_id, l_linenumber AS number, l_partkey % 3 AS part, l_quantity / 64.0 AS confidence FROM lineitem),
a AS (SELECT paper_id, round(round(avg(confidence), 9), 3) AS mean, count(DISTINCT CAST(part AS VARCHAR) || ':' || CAST(number AS VARCHAR)) AS found, 1 + paper_id % 6 AS expected FROM q GROUP BY 1, 4)
SELECT paper_id, found, expected, round(greatest(0, mean - CASE WHEN found / CAST(expected AS DOUBLE) < 0.8 OR found / CAST(expected AS DOUBLE) > 1.6 THEN 0.2 ELSE 0 END), 3) AS confidence FROM a""", bound=False)
def paper_confidence(spark, sf_dir):
    """The mean confidence of a paper's questions, less a fifth where the numbers found are far from those its parts announce."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat_ws(":", (F.col("l_partkey") % 3).cast("string"), F.col("l_linenumber").cast("string")).alias("slot"), (F.col("l_quantity") / 64.0).alias("confidence"))
    rows = rows.groupBy("paper_id").agg(F.round(F.round(F.avg("confidence"), 9), 3).alias("mean"), F.countDistinct("slot").alias("found")).withColumn("expected", 1 + F.col("paper_id") % 6)
    ratio = F.col("found") / F.col("expected")
    return rows.select("paper_id", "found", "expected", F.round(F.greatest(F.lit(0.0), F.col("mean") - F.when((ratio < 0.8) | (ratio > 1.6), 0.2).otherwise(0.0)), 3).alias("confidence"))


@query("""WITH u AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 150000 THEN 'big' ELSE 'small' END AS size FROM orders) SELECT size, count(*) AS written FROM u WHERE o_orderkey % 5 <> 0 GROUP BY 1""", bound=False)
def put_if_absent(spark, sf_dir):
    """How many blobs a sink that holds every fifth key has still to write."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 150000, "big").otherwise("small").alias("size"))
    return tables.absent(rows, rows.where("o_orderkey % 5 = 0"), ["o_orderkey"]).groupBy("size").agg(F.count("*").alias("written"))


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error')
SELECT event_id, attempt, attempt < 5 AS again FROM a""", bound=False)
def retry_schedule(spark, sf_dir):
    """Which failures are tried again: of five attempts, all but the last."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("attempt", F.row_number().over(order).cast("long"))
    return rows.select("event_id", "attempt", (F.col("attempt") < 5).alias("again"))


@query("""SELECT 'university' AS kind, r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'regulation', n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'revised' ELSE n_name END FROM nation
UNION ALL SELECT 'subject', s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' ELSE s_name END FROM supplier UNION ALL SELECT 'unit', p_partkey, p_name FROM part UNION ALL SELECT 'unit', -1, 'a new unit'""", bound=False)
def seed_corpus(spark, sf_dir):
    """The four tables of a corpus after a seed: nothing new, changed rows, renamed ones, and one more."""
    of = lambda name, key, value: table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"), F.col(value).alias("name"))
    region, nation, supplier, part = of("region", "r_regionkey", "r_name"), of("nation", "n_nationkey", "n_name"), of("supplier", "s_suppkey", "s_name"), of("part", "p_partkey", "p_name")
    seeds = {"university": (region, region.limit(0)), "regulation": (nation, nation.where("id % 4 = 0").select("id", F.lit("revised").alias("name"))), "subject": (supplier, supplier.where("id % 3 = 0").select("id", F.lit("renamed").alias("name"))), "unit": (part, spark.range(1).select((F.col("id") - 1).alias("id"), F.lit("a new unit").alias("name")))}
    out = None
    for kind, (rows, seed) in seeds.items():
        done = tables.upsert(rows, seed, ["id"]).select(F.lit(kind).alias("kind"), "id", "name")
        out = done if out is None else out.unionByName(done)
    return out


@query(LABELLED + """, c AS (SELECT subject_id, part_id, CAST(exam_year AS VARCHAR) || ' ' || upper(session) || ' Q' || CAST(number AS VARCHAR) || coalesce('(' || label || ')', '') AS citation FROM labelled)
SELECT subject_id, part_id, count(*) AS n, string_agg(citation, ';' ORDER BY citation) AS evidence FROM c GROUP BY ALL""")
def cluster_evidence(spark, sf_dir):
    """Each cluster with the citations of its questions, nested, then written out."""
    rows = binding.labelled(spark, sf_dir)
    cited = rows.select("subject_id", "part_id", text.citation(F.col("exam_year"), F.col("session"), F.col("number").cast("string"), F.col("label")).alias("citation"))
    nested = cited.groupBy("subject_id", "part_id").agg(F.array_sort(F.collect_list("citation")).alias("evidence"))
    return nested.select("subject_id", "part_id", F.size("evidence").cast("long").alias("n"), F.array_join("evidence", ";").alias("evidence"))


@query(statistics.CONCEPTS + """, l AS (SELECT subject_id, concept_id, string_agg(CAST(part_id AS VARCHAR), ';' ORDER BY part_id) AS clusters FROM linked WHERE n >= 3 GROUP BY ALL)
SELECT subject_id, concept_id, cost AS study_cost_min, place, clusters FROM ranked LEFT JOIN l USING (subject_id, concept_id)""")
def concept_detail(spark, sf_dir):
    """Each concept with its cost and rank and the clusters that ask for it often; null where none does."""
    often = statistics.concepts.linked(statistics.evidence(spark, sf_dir)).where("n >= 3").groupBy("subject_id", "concept_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part_id")), lambda p: p.cast("string")), ";").alias("clusters"))
    rows = statistics.ranked(spark, sf_dir).select("subject_id", "concept_id", F.col("cost").alias("study_cost_min"), "place")
    return rows.join(often, ["subject_id", "concept_id"], "left")
