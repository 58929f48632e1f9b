"""Queries against their SQL on rows that the given tables do not have: large keys, large groups, odd texts."""

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quaestor.operators import similar
from quaestor.plans import catalog as registry

SF = "/root/testdata/sf0.001"
ALL = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture
def matches(spark, tmp_path):
    """Asserts that a query over changed tables gives its SQL's rows, and gives them back."""

    def check(name, **changed):
        con, folder = duckdb.connect(), str(tmp_path)
        for t in ALL:
            pq.write_table(changed[t].toArrow() if t in changed else pq.read_table(f"{SF}/{t}.parquet"), f"{folder}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want, got = con.execute(registry.SQL[name]).df(), registry.QUERIES[name](spark, folder).toPandas()
        cols = sorted(want.columns)
        rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).map(lambda v: round(float(v), 5) if isinstance(v, (int, float)) else v).itertuples(index=False)))
        assert sorted(got.columns) == cols and rows(got) == rows(want)
        return got

    return check


def test_labels_of_large_keys(spark, matches):
    keys = spark.createDataFrame([(k, i) for i, k in enumerate((0, 1023, 1024, 1048063, 1048064, 1048575, 1048576, 1 << 40))], "o_orderkey long, i long")
    rows = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 8").withColumnRenamed("o_orderkey", "i")
    got = matches("display_labels", orders=rows.join(keys, "i").drop("i"))
    assert sorted(got["size"]) == ["0 B", "1 KB", "1023 B", "1023 KB", "1024 KB", "1024 KB", "large", "large"]


def test_escalations_of_many_people(spark, matches):
    views = spark.range(4000).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 10:00:00' AS ts", "id AS user_id", "'view' AS event_type")
    clicks = views.where("user_id % 2 = 0").selectExpr("event_id + 4000 AS event_id", "ts + INTERVAL 1 DAY AS ts", "user_id", "'click' AS event_type")
    rows = views.union(views.limit(100)).union(clicks).union(clicks.limit(100)).selectExpr("event_id", "ts", "user_id", "event_type", "1.0D AS value", """'{"k": 7}' AS props""")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    got = matches("stream_escalation_rate", events=rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]))
    assert got[["served", "escalated", "rate"]].values.tolist() == [[4000, 2000, 0.5]]


def test_candidates_of_odd_and_frequent_texts(spark, matches):
    names = ["big red ring", "red ring", "big red ring of steel", "a b a b", "a b a", "b a", "one", "", " ", "x  y", "of steel big red ring", None, "red ring of", "p q r s t u v", "q r s t u v w", "t u v w x y z"]
    rows = spark.createDataFrame([(7 * k + 3, names[k % len(names)]) for k in range(200)], "p_partkey long, p_name string")
    part = spark.read.parquet(f"{SF}/part.parquet").limit(1).drop("p_partkey", "p_name").crossJoin(rows)
    got = matches("lexical_candidates", part=part)
    assert len(got) > 1000 and got["similarity"].nunique() > 3


def test_pairs_of_one_large_class_come_in_tiles(spark):
    rows = spark.range(2 * similar.CHUNK + 100).select("id", F.array(F.lit("a b")).alias("grams"))
    kept = []
    found = similar.pairs(rows, lambda df: kept.append(df.cache()) or kept[-1])
    n = 2 * similar.CHUNK + 100
    assert found.agg(F.count("*"), F.sum("a") + F.sum("b"), F.count_if(F.col("a") < F.col("b"))).first()[:] == (n * (n - 1) // 2, n * (n - 1) * (n - 1) // 2, n * (n - 1) // 2)
    assert kept[1].agg(F.max(F.size("ids"))).first()[0] < 2 * similar.CHUNK


@pytest.mark.parametrize("name", ["text_quality_gate", "s1_routing"])
def test_texts_at_the_edges(spark, matches, name):
    plain = "the and of to in is for with that a " * 20
    texts = ["abcde " * 33 + " \x85", plain.strip(), plain + "a1 " * 300, "a^b, 12 x-1 ~ ab " * 40, "....", None, "", " \n", "KK İa THE\nAND " * 40, "x" * 20000]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(matches(name, documents=docs)) == len(texts)
