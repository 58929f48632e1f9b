"""Nulls, empty and repeated rows, clashing columns and empty tables, for each operator."""

import pytest

from quaestor.llm import exact_dedup, html_text, licences, mixing, neardup, packing, pii, sharding, topk

ROWS = [(1, "a b c d e f g", "x", 0.5), (2, None, None, None), (3, "", "x", 1.0), (4, "a b c d e f g", "y", 0.1), (5, "one two", "y", 0.2), (6, "w " * 5000, "x", 0.3), (6, "w " * 5000, "x", 0.3), (7, "card 4111111111111111 on 2020-02-29 from 10.0.0.1\nReleased under the MIT License.", None, 0.0)]
SCHEMA = "doc_id long, text string, source string, score double"


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)


def path():
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("f", [exact_dedup.verdicts, sharding.sharded, mixing.mixed, neardup.near_duplicates, lambda d: pii.pseudonymised(d, "k"), licences.scanned])
def test_one_row_each(docs, f):
    assert f(docs).count() == docs.count()


def test_packing_covers_each_token_once(docs):
    rows = packing.packed(docs, path()).collect()
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert all(r["offset"] + r["length"] <= packing.WINDOW for r in rows)


def test_exact_and_near_groups(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = {r["doc_id"]: r["keep_id"] for r in exact_dedup.verdicts(docs).collect()}
    assert kept == {1: 4, 2: 3, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert near[4] == (3, 1) and near[2] == (0, 2) and near[3] == (0, 3) and near[5] == (1, 5)


def test_pii_and_licence(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    row = pii.pseudonymised(docs, "k").where("doc_id = 7").first()
    assert row["kinds"] == ["card", "date", "ipv4"] and "4111111111111111" not in row["text"] and "2020-02-29" not in row["text"]
    number = row["text"].split()[1]
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0
    assert licences.scanned(docs).where("doc_id = 7").first()["license"] == "MIT"


def test_top_k_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(300, 8)).tolist()
    vectors = spark.createDataFrame([*enumerate(x), (300, None), (301, [float("nan")] * 8)], "vec_id long, embedding array<float>")
    e = np.floor(256 * np.array(x, np.float32).astype(float))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(vectors).collect()}
    for q in range(0, 300, 50):
        best = sorted((-int(e[q] @ e[j]), j) for j in range(300) if j != q)[:5]
        assert [got[q, i + 1] for i in range(5)] == [(j, -s) for s, j in best]


def test_pages():
    fitted = html_text.model()
    for html, want in (("", ""), (None, ""), ("<body><nav><ul><li><a>x</a></li></ul></nav><article><h1>T</h1><p>One &amp;\n two<p>three</article><footer>f</footer>", "T\nOne & two\nthree")):
        nodes = html_text.parse(html)
        assert html_text.decoded(nodes, html_text.log_odds(html_text.features(nodes), fitted)) == want
