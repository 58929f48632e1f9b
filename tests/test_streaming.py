"""Streams in several micro-batches: order, ends of state, watermarks."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quaestor.operators import tables
from quaestor.plans.saving import shared_dir
from quaestor.streaming import stateful, windows

ROWS = "who long, at long, event_id long, v double"
OUT = "who long, event_id long, total double, n int"
DAY = 86_400_000


def step(state, row):
    total, seen = state[0] + row.v, [*state[1], int(row.event_id)]
    return (total, seen), (int(row.who), int(row.event_id), float(total), len(seen))


def batches(spark, parts, schema, build, mode="append"):
    """The rows of a stream that gets each part as a micro-batch of its own, and the progress of its batches."""
    home = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(f"{home}/in")
    out, progress = build(spark.readStream.schema(schema).parquet(f"{home}/in")), []

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    with stateful.rocks(spark):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
            q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/log").foreachBatch(keep).trigger(availableNow=True).start()
            q.awaitTermination()
            progress += q.recentProgress
    return spark.read.schema(out.schema).parquet(f"{home}/out").select(*out.columns), progress


def test_shuffled_batches_give_the_batch_fold(spark):
    rng = random.Random(2)
    rows = [(u, DAY * (1 + rng.randrange(20)) + rng.randrange(5) * 3_600_000, 100 * u + i, float(i)) for u in range(4) for i in range(25)]
    rows += [(3, 200 * DAY, 999, 1.0), (None, 5 * DAY, 1000, 1.0)]  # one that comes after a rest, one of nobody
    mixed = rows[:-2]
    rng.shuffle(mixed)
    parts = [mixed[:30], mixed[30:70], mixed[70:] + rows[-1:], rows[-2:-1], [(77, 9000 * DAY, 1, 0.0)]]
    build = lambda s: stateful.folded(s, "who", ["at", "event_id"], lambda _: (0.0, []), step, OUT, "total double, seen array<long>", 30 * DAY, "40 days")
    got, progress = batches(spark, parts, ROWS, build)
    start, stepped = stateful.restarting(lambda _: (0.0, []), step, "at", 30 * DAY, "who")
    want = tables.folded(spark.createDataFrame(rows, ROWS).where("who is not null"), "who", ["at", "event_id"], start, stepped, OUT)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(held) > held[-1]  # what has rested has left the state store


def test_dead_letters_once(spark):
    rows = [(1, DAY * d, d, 0.0) for d in (5, 1, 3, 2, 4, 6, 7)] + [(2, DAY * d, 10 + d, 0.0) for d in range(1, 5)]
    build = lambda s: stateful.dead_letters(s, "who", ["at", "event_id"], "who long, event_id long", 90 * DAY, "30 days")
    got, _ = batches(spark, [rows[:4], rows[4:], [(77, 9000 * DAY, 1, 0.0)]], ROWS, build)
    assert [tuple(r) for r in got.collect()] == [(1, 5)]


@pytest.fixture(scope="module")
def steps():
    day = datetime(2024, 1, 1)
    at = lambda d, h=0: day + timedelta(days=d, hours=h)
    served = [("s", u, 1, at(0, u)) for u in range(1, 5)] + [("s", 9, 2, at(1))]
    escalated = [("e", 1, 1, at(3)), ("e", 1, 1, at(4)), ("e", 2, 1, at(15)), ("e", 3, 2, at(1)), ("e", 9, 2, at(0))]
    return served, escalated, at


def test_escalations_within_their_time(spark, steps):
    served, escalated, at = steps
    build = lambda s: windows.escalations(*[s.where(f"kind in ('{k}', 'z')").drop("kind") for k in "se"])
    late = [("s", 8, 1, at(0)), ("e", 4, 1, at(1))]  # after the watermark has passed their day
    got, progress = batches(spark, [served + escalated[:2], escalated[2:] + [("z", -1, -1, at(60))], late, [("z", -1, -1, at(400))]], "kind string, user_id long, concept_id long, ts timestamp", build)
    rows = {(r["window_start"], r["concept_id"]): (r["served"], r["escalated"], r["rate"]) for r in got.where("concept_id > 0").collect()}
    assert rows == {(at(0), 1): (4, 1, 0.25), (at(1), 2): (1, 0, 0.0)}  # none of the late rows, no escalation before or long after
    assert any(o.numRowsDroppedByWatermark > 0 for p in progress for o in p.stateOperators)
    assert progress[-1].eventTime["watermark"] > "2024-02"
