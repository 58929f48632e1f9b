"""Literal cases of functions, planner, state machines and merges."""

import random

from pyspark.sql import functions as F

from quaestor.functions import headers, text
from quaestor.operators import concepts, graph, planner, state, tables
from quaestor.plans.saving import saved


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


def test_hash_normal(spark):
    same = [("What is a heap?", "  what IS a\nheap? "), ("Page 1 of 3\nDefine a tree", "define a tree"), ("Reg. No: 12AB Explain", "explain"), ("the ‘best’ one", "the 'best' one"), ("a b", "a b")]
    for a, b in same:
        assert one(spark, a, text.content_hash(F.col("x")))[0] == one(spark, b, text.content_hash(F.col("x")))[0]
    assert one(spark, "Define a tree", text.content_hash(F.col("x")))[0] != one(spark, "Define a heap", text.content_hash(F.col("x")))[0]
    assert one(spark, None, text.content_hash(F.col("x")))[0] is None


def test_quality_branches(spark):
    good = "the cost of a tree is to be found with that rule and it is for all by an order on which this or that stands as from " * 3
    cases = {None: "short", "a" * 300: "few words", good: None, "1234 " * 80 + good[:20]: "letters", ("plain wood words " * 40): "stop words", good + "@@@@ " * 4: "punctuation"}
    for value, reason in cases.items():
        got = one(spark, value, text.quality(F.col("x")).alias("q"))["q"]
        assert (got["reason"], got["usable"]) == (reason, reason is None)
    words = good.split() * 2
    mixed = " ".join(words + ["qu1z~"] * (len(words) // 4))
    assert one(spark, mixed, text.quality(F.col("x")).alias("q"))["q"]["reason"] == "garbled"


def test_marks_headers_codes(spark):
    marks = lambda s: tuple(one(spark, s, text.trailing_marks(F.col("x")).alias("m"))["m"])
    assert marks("Prove it. (5)") == ("Prove it.", 5) and marks("Prove it. [8 marks]") == ("Prove it.", 8)
    assert marks("Prove it (with examples)") == ("Prove it (with examples)", None) and marks("x (0)") == ("x (0)", None)
    head = lambda s: one(spark, s, text.part_header(F.col("x")).alias("p"))["p"]
    assert tuple(head("PART - A (10 x 2 = 20 Marks)")) == ("A", 10, 2, 20, False)
    assert tuple(head("PART- C(2x816marks)")) == ("C", 2, 8, 16, True)
    assert head("PARTIAL fractions") is None and head("Part " + "b" * 90) is None and head(None) is None
    number = lambda s: tuple(one(spark, s, text.question_number(F.col("x")).alias("n"))["n"])
    assert number("11(a)") == ("11", "a") and number("12 (a)(i)") == ("12", "a-i") and number("7") == ("7", None)
    row = one(spark, "22S5-CEG-ASSESS-BT.pdf", text.filename_hints(F.col("x")).alias("h"))["h"]
    assert tuple(row) == ("assessment", "CEG", "BT", 2022)
    assert one(spark, "cs 23_501", text.subject_code(F.col("x")))[0] == "CS23501"
    assert one(spark, "Regulation 2023, Nov 2024", headers.year(F.col("x")))[0] == 2024
    assert [one(spark, s, text.band(F.col("x").cast("int")))[0] for s in ("1", "3", "4", "16", "10")] == [2, 2, 5, 15, 8]
    assert one(spark, 'Sure: ```json\n{"a": 3}\n```', text.json_body(F.col("x"), "a int").alias("j"))["j"]["a"] == 3
    assert tuple(one(spark, "quota: retryDelay: 7s", text.retry_advice(F.lit(429), F.col("x")).alias("r"))["r"]) == (True, 7000)


def test_study_cost_and_prior(spark):
    row = spark.range(1).select(concepts.study_cost(F.lit(4), F.lit(None).cast("double")).alias("a"), concepts.study_cost(F.lit(0), F.lit(1.0)).alias("b"), concepts.prior(F.array().cast("array<int>")).alias("c"), concepts.prior(F.array(F.lit(1), F.lit(9))).alias("d")).first()
    assert (row["a"], row["b"], row["c"]) == (36, 24, 0.0) and abs(row["d"] - 20 * 8 / 45 / 2) < 1e-9


def test_planner_keeps_its_limits():
    assert planner.reserve_of(600) == 90
    rng = random.Random(4)
    for _ in range(200):
        cs = [{"concept_id": f"c{i}", "units": rng.sample([1, 2, 3, 4, 5], rng.randint(0, 2)), "cost": rng.randint(5, 40), "expected_marks": rng.random()} for i in range(rng.randint(0, 15))]
        budget = rng.randint(0, 300)
        got = planner.plan(cs, budget, [1, 2, 3, 4, 5])
        left = budget - planner.reserve_of(budget) - sum(c["cost"] for c in got)
        names = {c["concept_id"] for c in got}
        assert left >= 0 and len(names) == len(got)
        assert all(c["cost"] > left for c in cs if c["concept_id"] not in names)
    cs = [{"concept_id": f"a{i}", "units": [1], "cost": 20, "expected_marks": 2.0} for i in range(8)] + [{"concept_id": f"b{u}", "units": [u], "cost": 20, "expected_marks": 0.4} for u in (2, 3, 4, 5) for _ in (0,)]
    assert {s["concept_id"] for s in planner.plan(cs, 240, [1, 2, 3, 4, 5])} >= {"b2", "b3", "b4", "b5"}


def test_loop_transitions():
    s = state.advance(state.Session(plan=("a", "b"), reserve=20.0), "START")
    assert (s.state, s.current, s.effects) == ("TEACH", "a", ("serve_lesson:a:cram",))
    hop = state.advance(s, "TEST_FAILED", "a", missed=("p",))
    assert (hop.stack, hop.state) == (("p",), "TEACH")
    deep = state.advance(hop, "TEST_FAILED", "p", missed=("q",))
    assert (deep.index, deep.stack) == (1, ()) and state.advance(hop, "TEST_FAILED", "p", missed=("q",), policy=state.POLICIES["mastery"]).stack == ("p", "q")
    assert state.advance(hop, "TEST_FAILED", "p", missed=("p",), policy=state.POLICIES["mastery"]).index == 1
    back = state.advance(hop, "TEST_PASSED", "p")
    assert (back.stack, back.current, back.index) == ((), "a", 0)
    broke = state.advance(state.Session(plan=("a", "b"), budget=10.0, spent=5.0), "TEST_PASSED", "a", minutes=6)
    assert (broke.state, broke.index) == ("DONE", 0)
    assert state.advance(state.Session(plan=("a",)), "ABANDON_CONCEPT").state == "DONE" and state.advance(s, "ESCALATE").state == "STUCK"


def test_token_bucket():
    tokens, last, seen = 0.0, None, []
    for now in (0.0, 0.0, 0.0, 0.0, 4.0):
        tokens, allowed, wait = state.take(tokens, last, now, 1.0, 3.0, 0.25)
        last = now
        seen.append((allowed, wait))
    assert seen == [(True, 0)] * 3 + [(False, 4000), (True, 0)]


def test_folded_streams_a_key(spark):
    rows = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(50)], "key long, i long").repartition(7)
    step = lambda s, r: (s + r.i, (r.key, r.i, s + r.i))
    got = {(r["key"], r["i"]): r["s"] for r in tables.folded(rows, "key", ["i"], lambda k: 0, step, "key long,i long,s long").collect()}
    assert got == {(k, i): i * (i + 1) // 2 for k in (1, 2) for i in range(50)}


def test_merge_and_the_or_rule(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (8, 9)], "a long, b long")
    members = spark.createDataFrame([(1, 10, 1), (3, 10, 1), (5, 10, None), (6, 10, None), (8, 11, 2), (9, 11, 2), (7, 12, 2)], "cluster long, paper_id long, or_group int")
    got = {r["cluster"]: (r["survivor"], r["rejected"]) for r in graph.merged(pairs, members, saved).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 5: (5, False), 6: (5, False), 7: (5, False)}


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in graph.components(edges, saved).collect()} == {0}


def test_walks_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "upper string, lower string")
    got = {(r["node"], r["hops"]) for r in graph.ancestors(edges, spark.createDataFrame([("d",)], "node string"), saved).collect()}
    assert got == {("c", 1), ("b", 2), ("a", 3)}


def test_first_writer_wins(spark):
    up = spark.createDataFrame([(i, 1, u, "h") for i, u in enumerate([7, 8, 9, 9, 7])], "upload_id long, subject long, user long, hash string")
    got = tables.arrivals(up, "upload_id")
    assert got.where("created").count() == 1 and {r["user"] for r in tables.credits(got).collect()} == {7, 8, 9}
    assert tables.absent(up, up.where("user = 100"), ["hash"]).count() == 1


def test_only_lessons_and_tests_spend():
    s = state.Session(plan=("a", "b"), budget=10.0)
    for event in ("START", "ESCALATE", "TUTOR_RESOLVED", "ABANDON_CONCEPT"):
        assert state.advance(s, event, "a", minutes=5).spent == 0
    for event in ("LESSON_SERVED", "TEST_PASSED", "TEST_FAILED"):
        assert state.advance(s, event, "a", minutes=5).spent == 5


def test_refusals_in_order():
    full, poor = state.POLICIES["mastery"], state.Session(plan=("a", "b"), reserve=0.0)
    rich = state.Session(plan=("a", "b"), reserve=50.0, stack=("p",))
    why = lambda s, missed, policy=full: state.advance(s, "TEST_FAILED", "a", missed=missed, policy=policy).reason
    assert why(rich, ("p",)).startswith(state.REASONS["cycle"]) and why(rich, ("q",), state.POLICIES["night_before"]).startswith(state.REASONS["deep"])
    assert why(rich, ()).startswith(state.REASONS["none"]) and why(poor, ("q",)).startswith(state.REASONS["poor"]) and why(rich, ("q",)) == state.REASONS["hop"]
    assert state.advance(rich, "TEST_FAILED", "a", missed=("q",), policy=full).effects == ("record_mastery:a:false", "serve_lesson:q:full")
    done = state.advance(state.Session(plan=("a",), current="a"), "TEST_FAILED", "a")
    assert (done.state, done.index, done.current) == ("DONE", 1, "a")


def test_stream_of_sessions_equals_the_fold(spark):
    from quaestor.plans import streams

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(streams.loop_stream(spark, "/root/testdata/sf0.001")) == rows(streams.loop_fold(spark, "/root/testdata/sf0.001"))


def test_lookups_scopes_and_retries(spark):
    import pytest

    from quaestor.operators import reads

    rows = spark.createDataFrame([(1, 7, 1.0), (2, 8, 2.0)], "event_id long, user_id long, ts double")
    assert reads.lookup(rows, "event_id", "2").first()["user_id"] == 8
    for raw, error in (("x", ValueError), ("-1", ValueError), ("3", reads.NotFound)):
        with pytest.raises(error):
            reads.lookup(rows, "event_id", raw)
    private = reads.Private(rows)
    assert private.of(7).count() == 1 and private.added(rows.select("event_id", "ts"), 9).of(9).count() == 2
    for bad in (lambda: private.of(None), lambda: reads.Private(rows.drop("user_id"))):
        with pytest.raises(ValueError):
            bad()
    waits, tries = [], iter([reads.VersionConflict(), reads.VersionConflict(), None])

    def commit():
        if e := next(tries):
            raise e
        return "done"

    assert reads.retried(commit, sleep=waits.append) == "done" and len(waits) == 2 and 0.01 <= waits[0] <= 0.03 and 0.02 <= waits[1] <= 0.06
    with pytest.raises(KeyError):
        reads.retried(lambda: {}["x"], sleep=waits.append)


def test_retries_wait_longer(spark):
    from quaestor.operators import reads

    rows = spark.createDataFrame([(a, k) for a in (1, 2, 3) for k in range(40)], "a int, k long")
    for r in rows.select("a", reads.retry_after_ms(F.col("a"), F.col("k")).alias("ms")).collect():
        assert 1000 * 2 ** (r["a"] - 1) <= r["ms"] <= 3000 * 2 ** (r["a"] - 1)
