"""Relational reads, the OR rule, merges, graph walks and neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaestor.functions import text
from quaestor.operators import graph, neighbours, tables
from quaestor.plans import binding, registry
from quaestor.plans.binding import LABELLED, table
from quaestor.plans.registry import query
from quaestor.plans.saving import saved, tabled


@query(LABELLED + "SELECT paper_id, number, label, part_id, marks, row_number() OVER (PARTITION BY paper_id ORDER BY number, label NULLS FIRST) AS place FROM labelled")
def paper_question_order(spark, sf_dir):
    rows = binding.labelled(spark, sf_dir)
    digits = F.nullif(F.regexp_replace(F.col("number").cast("string"), r"\D", ""), F.lit("")).try_cast("int")
    order = Window.partitionBy("paper_id").orderBy(digits.asc_nulls_last(), F.col("number").cast("string"), F.col("label").asc_nulls_first())
    return rows.select("paper_id", "number", "label", "part_id", "marks", F.row_number().over(order).cast("long").alias("place"))


@query(LABELLED + "SELECT paper_id, number, label, CAST(exam_year AS VARCHAR) || ' ' || upper(session) || ' Q' || CAST(number AS VARCHAR) || coalesce('(' || label || ')', '') AS citation FROM labelled")
def citation_trail(spark, sf_dir):
    rows = binding.labelled(spark, sf_dir)
    return rows.select("paper_id", "number", "label", text.citation(F.col("exam_year"), F.col("session"), F.col("number").cast("string"), F.col("label")).alias("citation"))


_BLOCKED = LABELLED + """, blocked AS (SELECT x.part_id AS a, y.part_id AS b, min(x.paper_id) AS paper_id FROM labelled x JOIN labelled y
  ON x.paper_id = y.paper_id AND x.or_group = y.or_group AND x.part_id < y.part_id GROUP BY 1, 2),
chain AS (SELECT a, b FROM (SELECT lag(p_partkey) OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS a, p_partkey AS b FROM part) WHERE a IS NOT NULL)
"""


def members(spark, sf_dir):
    return binding.labelled(spark, sf_dir).select(F.col("part_id").alias("cluster"), "paper_id", "or_group")


def chain(spark, sf_dir):
    """Candidate merges: parts of one brand, type and size, each with the one before it."""
    before = F.lag("p_partkey").over(Window.partitionBy("p_brand", "p_type", "p_size").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select(before.alias("a"), F.col("p_partkey").alias("b")).where("a is not null")


@query(_BLOCKED + "SELECT a, b, paper_id FROM blocked")
def or_rule_blocked_pairs(spark, sf_dir):
    return graph.blocking_pairs(members(spark, sf_dir)).select("a", "b", "paper_id")


@query(_BLOCKED + "SELECT a, b FROM chain ANTI JOIN blocked USING (a, b)")
def or_rule_allowed_pairs(spark, sf_dir):
    return chain(spark, sf_dir).join(graph.blocking_pairs(members(spark, sf_dir)), ["a", "b"], "left_anti")


def merge_components(spark, sf_dir):
    return graph.merged(chain(spark, sf_dir), members(spark, sf_dir), saved)


registry.QUERIES["merge_components"] = merge_components
registry.SQL["merge_components"] = binding.SQL.replace("WITH papers", "WITH RECURSIVE papers", 1) + _BLOCKED + """,
legal AS (SELECT a, b FROM chain ANTI JOIN blocked USING (a, b)),
ends AS (SELECT a, b FROM legal UNION SELECT b, a FROM legal),
reach AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1),
broken AS (SELECT DISTINCT x.component FROM blocked JOIN comp x ON a = x.id JOIN comp y ON b = y.id WHERE x.component = y.component)
SELECT id AS cluster, CASE WHEN k.component IS NULL THEN c.component ELSE id END AS survivor, k.component IS NOT NULL AS rejected FROM comp c LEFT JOIN broken k ON c.component = k.component"""


@query("SELECT l_orderkey AS paper_id, l_linenumber AS number, l_partkey AS part_id FROM lineitem ANTI JOIN (SELECT p_partkey AS l_partkey FROM part WHERE p_size > 10) USING (l_partkey)", bound=False)
def orphan_membership(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("part_id"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part_id"))
    return rows.join(known, "part_id", "left_anti").select("paper_id", "number", "part_id")


@query("SELECT p_partkey AS cluster, p_size % 3 AS expected_version, p_size % 2 AS version FROM part WHERE p_size % 7 <> 0 AND p_size % 3 <> p_size % 2", bound=False)
def version_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster"), F.when(F.col("p_size") % 7 != 0, F.col("p_size") % 3).alias("expected_version"), (F.col("p_size") % 2).alias("version"))
    return graph.version_conflicts(rows)


def prerequisites(spark, sf_dir):
    """(edges upper -> lower, nodes): a size of a type leads to those 7 and 10 above it, where the type has them."""
    nodes = table(spark, sf_dir, "part").select("p_type", "p_size").distinct()
    name = lambda size: F.concat_ws("/", "p_type", size.cast("string"))
    there = nodes.withColumn("up", F.explode(F.array(F.col("p_size") - 7, F.col("p_size") - 10)))
    have = nodes.select("p_type", F.col("p_size").alias("up"))
    return there.join(have, ["p_type", "up"]).select(name(F.col("up")).alias("upper"), name(F.col("p_size")).alias("lower")), nodes.select(name(F.col("p_size")).alias("node"))


_EDGES = """WITH RECURSIVE nodes AS (SELECT DISTINCT p_type, p_size FROM part),
edges AS (SELECT x.p_type || '/' || x.p_size AS upper, y.p_type || '/' || y.p_size AS lower FROM nodes x JOIN nodes y ON x.p_type = y.p_type AND y.p_size - x.p_size IN (7, 10)),
walk AS (SELECT lower AS origin, upper AS node, 1 AS hops FROM edges UNION SELECT origin, upper, hops + 1 FROM walk JOIN edges ON node = lower WHERE hops < 64)
"""


@query(_EDGES + "SELECT p_type || '/' || p_size AS node, CAST(coalesce(max(hops), 0) AS BIGINT) AS depth FROM nodes LEFT JOIN walk ON origin = p_type || '/' || p_size GROUP BY 1", bound=False)
def prerequisite_depth(spark, sf_dir):
    edges, nodes = prerequisites(spark, sf_dir)
    return graph.depths(tabled(edges), nodes, tabled)


@query(_EDGES + """SELECT p_type || '/' || p_size AS node, coalesce(n, 0) AS dependents, TRUE AS exact FROM nodes LEFT JOIN (SELECT node, count(DISTINCT origin) AS n FROM walk GROUP BY 1) w ON w.node = p_type || '/' || p_size""", bound=False)
def dependents_sketched(spark, sf_dir):
    """How many concepts wait for each, from sketches: exact while they are fewer than a sketch holds, as here."""
    edges, nodes = prerequisites(spark, sf_dir)
    return graph.dependents(edges, nodes, tabled)


def _rings(spark, sf_dir):
    """(edges upper -> lower, nodes) with cycles: a size of a brand leads to two others, where the brand has them."""
    nodes = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("long").alias("size")).distinct()
    to = F.explode(F.array((F.col("size") * 3 + 1) % 50 + 1, (F.col("size") + 12) % 50 + 1))
    there = nodes.withColumn("to", to).join(nodes.select("p_brand", F.col("size").alias("to")), ["p_brand", "to"])
    name = lambda size: F.concat_ws("/", "p_brand", F.lpad(size.cast("string"), 2, "0"))
    return there.where("to % 4 > 0 or size > to").select(name(F.col("size")).alias("upper"), name(F.col("to")).alias("lower")), nodes.select(name(F.col("size")).alias("node"))


@query("""WITH RECURSIVE sizes AS (SELECT DISTINCT p_brand, p_size FROM part), nodes AS (SELECT p_brand || '/' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS node FROM sizes),
edges AS (SELECT DISTINCT x.p_brand || '/' || lpad(CAST(x.p_size AS VARCHAR), 2, '0') AS upper, y.p_brand || '/' || lpad(CAST(y.p_size AS VARCHAR), 2, '0') AS lower FROM sizes x JOIN sizes y ON x.p_brand = y.p_brand AND (y.p_size = (x.p_size * 3 + 1) % 50 + 1 OR y.p_size = (x.p_size + 12) % 50 + 1) AND (y.p_size % 4 > 0 OR x.p_size > y.p_size)),
reach AS (SELECT upper AS a, lower AS b FROM edges UNION SELECT r.a, e.lower FROM reach r JOIN edges e ON r.b = e.upper),
comp AS (SELECT r.a AS node, min(r.b) AS component FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a GROUP BY 1),
below AS (SELECT DISTINCT b AS node FROM reach WHERE a IN (SELECT node FROM comp)),
free AS (SELECT upper, lower FROM edges WHERE lower NOT IN (SELECT node FROM below)),
walk AS (SELECT node, 0::BIGINT AS h FROM nodes UNION SELECT lower, h + 1 FROM walk JOIN free ON node = upper)
SELECT node, component, CASE WHEN below.node IS NULL THEN depth END AS depth FROM (SELECT node, max(h) AS depth FROM walk GROUP BY 1) LEFT JOIN comp USING (node) LEFT JOIN below USING (node)""", bound=False)
def prerequisite_cycles(spark, sf_dir):
    """Nodes with the cycle they are on, and the depth of those that are on none and below none."""
    edges, nodes = _rings(spark, sf_dir)
    edges = tabled(edges)
    layers, _ = graph.peeled(edges, nodes, tabled)
    return nodes.join(graph.cycles(edges, tabled), "node", "left").join(layers, "node", "left").select("node", "component", "depth")


@query(_EDGES + "SELECT origin, node, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY 1, 2", bound=False)
def prerequisite_walk(spark, sf_dir):
    edges, nodes = prerequisites(spark, sf_dir)
    return graph.ancestors(saved(edges), nodes, saved)


_NEAREST = """WITH p AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 3 <> b.vec_id // 3 WHERE a.vec_id % 50 = 0),
t AS (SELECT vec_id, place, other, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other) AS place FROM p) WHERE place <= 5)
"""


def _neighbours(spark, sf_dir, exact):
    """The stated query set (ids divisible by 50) against every vector of its label in other papers (three vectors are one paper)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.floor(F.col("vec_id") / 3).alias("apart"), F.col("embedding").alias("e"))
    found = neighbours.nearest(rows, rows.where("id % 50 = 0"), 5, saved, exact=exact)
    return found.withColumnRenamed("q", "vec_id")


@query(_NEAREST + "SELECT vec_id, place, other, similarity FROM t", bound=False)
def vector_topk(spark, sf_dir):
    """Exact: lists that could hold a better neighbour are read in a second round."""
    return _neighbours(spark, sf_dir, True)


def vector_topk_indexed(spark, sf_dir):
    """The scale form: the nearest lists only."""
    return _neighbours(spark, sf_dir, False)


@query(_NEAREST + "SELECT count(*) AS wanted, TRUE AS enough FROM t", bound=False)
def vector_recall(spark, sf_dir):
    """The neighbours there are, and whether the scale form finds nine tenths of them."""
    got = vector_topk_indexed(spark, sf_dir).select("vec_id", "other", F.lit(1).alias("hit"))
    both = vector_topk(spark, sf_dir).join(got, ["vec_id", "other"], "left")
    return both.agg(F.count("*").alias("wanted"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("enough"))


registry.QUERIES["vector_topk_indexed"] = vector_topk_indexed


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owing' ELSE c_mktsegment END AS c_mktsegment FROM customer", bound=False)
def seed_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    changed = rows.where("c_acctbal < 0").select("c_custkey", F.lit("owing").alias("c_mktsegment"))
    return tables.upsert(rows.select("c_custkey", "c_mktsegment"), changed, ["c_custkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders ANTI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal >= 0) USING (o_custkey)) USING (l_orderkey)", bound=False)
def cascade_delete(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kept = tables.cascade(orders, "o_custkey", customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))
    gone = tables.cascade(orders, "o_orderkey", kept).select(F.col("o_orderkey").alias("l_orderkey"))
    return tables.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", gone)
