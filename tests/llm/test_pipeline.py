"""The corpus pipeline, each stage on its own input against brute force, and the run as a whole."""

import random
import re
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quaestor.llm import toxicity
from quaestor.llm.common import ARROW_ROWS, cut
from tests.llm.test_neardup import brute

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxic string, _lost int"


def rows():
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    texts = [fresh(rng.randrange(1, 160)) for _ in range(90)]
    texts += [t.replace("w1", "v", 1) + " tail" for t in texts[:25]] + texts[30:50] + ["we will kill you today. " + fresh(30), "They kill time. " + fresh(30), None, "", fresh(3000)]
    return [(i, t, "en", f"s{i % 4}", len(t or ""), "own", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("sf"))
    data = rows()
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(0, 100, 3)], "doc_id long, toxic int").write.parquet(f"{home}/labels.parquet")
    docs, out = spark.read.parquet(f"{home}/documents.parquet"), [data]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, home)
        assert name == "packing" or got.columns == docs.columns
        got.write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        out.append([tuple(r) for r in docs.collect()])
    return home, out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    before, after = stages[1][:2]
    gone = {r[1] for r in before} - {r[1] for r in after}
    assert len(gone) == 1 and gone.pop().startswith("we will kill you") and len(after) == len(before) - 1


def test_one_row_of_each_text_stays(stages):
    before, after = stages[1][1:3]
    want = {}
    for r in before:
        want[r[1] or ""] = max(r[0], want.get(r[1] or "", -1))
    assert sorted((r[1] or "", r[0]) for r in after) == sorted(want.items())


def test_one_row_of_each_near_group_stays(stages):
    before, after = stages[1][2:4]
    assert sorted(r[0] for r in after) == sorted({c for _, _, c in brute([r[:2] for r in before])})


def test_mix_takes_words_of_the_documents(stages):
    before, after = stages[1][3:5]
    own = {r[0]: Counter(WORDS.findall(r[1] or "")) for r in before}
    for r in after:
        got = Counter(WORDS.findall(r[1]))
        assert r[4] == len(r[1]) and set(got) <= set(own[r[0]]) and all(n <= 3 * own[r[0]][w] for w, n in got.items())
    assert abs(sum(len(WORDS.findall(r[1])) for r in after) - sum(sum(c.values()) for c in own.values())) <= 4


def test_packing_holds_each_token_once(stages):
    before, after = stages[1][4:6]
    coder = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {r[0]: len(coder.encode(r[1], add_special_tokens=False).ids) + 1 for r in before}
    got = Counter()
    for r in after:
        got[r[0]] += r[2]
        assert r[4] == want[r[0]]
    assert got == want


def test_run_equals_its_stages(spark, stages):
    home, out = stages
    assert sorted(map(tuple, corpus_pipeline.run(spark, home).collect())) == sorted(out[-1])


def test_no_labels_reject_nobody_without_a_clause(spark):
    docs = spark.createDataFrame(rows()[:40], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(docs, docs, labels, "score", "hit").where("hit = 1").count() == 0


@pytest.mark.parametrize(("stage", "operator"), [("drop_toxic", "toxicity.scored"), ("drop_near_copies", "neardup.deduplicate"), ("pack", "packing.packed")])
def test_stages_hand_python_short_batches(spark, tmp_path, monkeypatch, stage, operator):
    docs = spark.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    @F.pandas_udf("int")
    def rows_in_batch(text: pd.Series) -> pd.Series:
        return pd.Series([len(text)] * len(text), dtype="int32")

    n = rows_in_batch("text").alias("n")
    probe = (lambda d, *_: d.select(F.struct(n).alias("doc"), F.lit(0).alias("predicted"))) if stage == "drop_toxic" else lambda d, *_: cut(d.select(n))
    monkeypatch.setattr(f"corpus_pipeline.{operator}", probe)
    before = spark.conf.get(ARROW_ROWS)
    got = [r["n"] for r in getattr(corpus_pipeline, stage)(spark, docs, str(tmp_path)).collect()]
    assert len(got) == 2500 and max(got) <= corpus_pipeline.TEXTS and spark.conf.get(ARROW_ROWS) == before
