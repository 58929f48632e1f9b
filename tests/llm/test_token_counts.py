"""Token counts against the tokenizer's own."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaestor.llm import token_counts

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
POOL = ["a", "The", " the", "ΟΔΟΣ", "é", "é", "ÿ", "×", "'s", "don't", "'S", "'re", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "\x85", "　", "<|endoftext|>", "<|", "1234", "²", "½", "ß", "☃☃", "...", "-", "x" * 70, "\x00", "\x0b", "µ", "ª", "🙂", "_", "日本語", "aaaa"]


@pytest.fixture(scope="module")
def whole():
    coder = Tokenizer.from_file(PATH)
    return lambda t: len(coder.encode(t or "", add_special_tokens=False).ids)


@pytest.fixture
def texts():
    rng = random.Random(1)
    return ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 25))) for _ in range(3000)]


@pytest.mark.parametrize(("memo", "portion", "most"), [(1_000_000, 100_000, 1 << 20), (40, 7, 3)])
def test_counts_equal_the_library(monkeypatch, whole, texts, memo, portion, most):
    for name, value in (("MEMO", memo), ("PORTION", portion), ("WHOLE", most)):
        monkeypatch.setattr(token_counts, name, value)
    counter = token_counts.Counter(PATH)
    assert [counter.count(t) for t in texts] == [whole(t) for t in texts]


def test_every_character(whole):
    counter = token_counts.Counter(PATH)
    marks = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert [counter.count(f"a{c} {c}1{c}{c} ") for c in marks] == [whole(f"a{c} {c}1{c}{c} ") for c in marks]


def test_pieces_without_a_break(whole):
    counter = token_counts.Counter(PATH)
    for t in ("a" * 200_000, "ab" * 60_000, "é" * 30_000, " " * 30_000):
        assert counter.count(t) == whole(t)


def test_documents(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (-4, "<|endoftext|>" * 513), (None, "no id"), (None, "no id")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), whole(r["text"]), whole(r["text"]) > 512) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, lambda: PATH).collect()) == want


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two", 5, "x")], "doc_id long, text string, n_tokens int, over_limit string")
    assert [tuple(r) for r in token_counts.token_counts(docs, PATH, 1).collect()] == [(1, 7, 2, True)]
    assert token_counts.token_counts(docs.where("doc_id = 2"), PATH).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(str(public_tokenizers.path("word_bpe_49k.json")))
