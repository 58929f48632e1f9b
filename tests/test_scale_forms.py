"""Ranks over sorted runs, and the guard of private tables."""

import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators import ranking, scope
from quaestor.plans.saving import tabled


def drawn(groups, n=2000):
    rng = random.Random(n)
    return [(rng.choice(groups), rng.randrange(50), i) for i in range(n)]


@pytest.mark.parametrize("groups", [["one"], ["a", "b", None, "c"], [None]])
def test_ranks(spark, groups):
    rows = drawn(groups)
    frame = spark.createDataFrame(rows, "g string, v long, i long")
    order = [F.desc("v"), F.col("i")]
    got = {r["i"]: (r["place"], r["overall"]) for r in ranking.ranked(ranking.ranked(frame, ["g"], order, tabled, parts=7), [], order, tabled, "overall", 5).collect()}
    place = {}
    for g in groups:
        place |= {r[2]: n + 1 for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])))}
    overall = {r[2]: n + 1 for n, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2])))}
    assert got == {i: (place[i], overall[i]) for i in place}


def test_a_group_is_sorted_by_many_tasks(spark):
    frame = spark.createDataFrame(drawn(["one"]), "g string, v long, i long")
    parts = ranking.runs(frame, ["g"], [F.desc("v"), F.col("i")], tabled, 8).groupBy("_run").count().collect()
    assert len(parts) >= 6 and max(r["count"] for r in parts) < 700


def test_no_rows_to_rank(spark):
    assert ranking.ranked(spark.createDataFrame([], "g string, v long"), ["g"], [F.col("v")], tabled, parts=3).count() == 0


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows.createOrReplaceTempView("mastery")
    spark.createDataFrame([(1, 2)], "user_id long, x long").createOrReplaceTempView("attempts")
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").createOrReplaceTempView("part")
    return rows


PRIVATE = {"events", "mastery", "attempts"}


def test_scoped_frames_pass(spark, events):
    mine = events.where("user_id = 7 and value > 1")
    renamed = events.select(F.col("user_id").alias("who"), "value").orderBy("value").where(F.lit(7) == F.col("who"))
    other = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for df in (mine, renamed, mine.join(renamed, "value"), mine.select("value").union(renamed.select("value")), events.alias("e").where("e.user_id = 7"), events.withColumn("x", F.lit(1)).where("user_id = 7").groupBy("x").count(), other, mine.alias("events").limit(3)):
        assert scope.guarded(df, PRIVATE) is df
    for sql in ("SELECT * FROM mastery WHERE user_id = 7", "SELECT x FROM attempts a WHERE a.user_id = 1", "SELECT * FROM part WHERE p_partkey IN (SELECT event_id FROM mastery WHERE user_id = 7)", "WITH m AS (SELECT * FROM mastery WHERE user_id = 7) SELECT count(*) FROM m"):
        assert scope.refused(spark.sql(sql), PRIVATE) == []


def test_unscoped_frames_are_refused(spark, events):
    mine = events.where("user_id = 7")
    cases = [events, events.where("user_id > 7"), events.where("user_id = 7 or value > 1"), events.where("user_id = event_id"), events.where("user_id = cast(null as long)"), mine.join(events.select("event_id"), "event_id"), mine.union(events), events.groupBy("user_id").count().where("user_id = 7"), events.limit(5).where("user_id = 7"), events.select(F.col("event_id").alias("user_id")).where("user_id = 7")]
    for df in cases:
        with pytest.raises(scope.Unscoped, match="events"):
            scope.guarded(df, PRIVATE)
    sql = ["SELECT * FROM mastery", "SELECT x FROM attempts", "SELECT * FROM part WHERE p_partkey IN (SELECT event_id FROM mastery)", "WITH m AS (SELECT * FROM mastery) SELECT * FROM m WHERE user_id = 7", "SELECT * FROM attempts a JOIN attempts b USING (x) WHERE a.user_id = 1"]
    for text in sql:
        assert scope.refused(spark.sql(text), PRIVATE), text
