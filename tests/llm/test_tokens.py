"""Packing: ids as the tokenizer's own over whole texts, pieces and their places by brute force."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quaestor.llm import packing

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
POOL = ["a", "The", "ΟΔΟΣ", "é", "e\u0301", "É", "ÿ", "×", "'s", "don't", "'S", "...'", "'re", " ", "\n", "\t", "\r\n", "\u00a0", "\x1c", "\x85", "\u3000", "<|endoftext|>", "<|startoftext|>", "<|", "1234", "\u0301", "ß", "İ", "☃☃", "...", "-", "x" * 70, "\x00", "\x0b", "\x0c", "µ", "ª", "²", "🙂", "_", "Zeitung,"]


@pytest.fixture(scope="module")
def whole():
    coder = Tokenizer.from_file(PATH)
    return lambda t: coder.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("part", [7, 1 << 20])
def test_pieces_equal_whole(monkeypatch, whole, part):
    monkeypatch.setattr(packing, "PART", part)
    monkeypatch.setattr(packing, "MEMO", 60)
    rng = random.Random(1)
    coder = packing.Coder(PATH)
    assert coder.known
    for _ in range(60):
        texts = ["".join(rng.choice(POOL) for _ in range(rng.randint(0, 25))) for _ in range(50)]
        assert [x.tolist() for x in coder.encode(texts)] == [whole(t) for t in texts]


def test_other_tokenizers_code_whole_texts(whole):
    coder = packing.Coder(PATH)
    coder.known = False
    texts = ["one Two  three", "", "x" * 500]
    assert [x.tolist() for x in coder.encode(texts)] == [whole(t) for t in texts]


def test_documents_and_pieces_by_brute_force(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (None, "no id")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    ids = {r["doc_id"]: np.array([*whole(r["text"] or ""), 1], "<u4") for r in docs.collect()}
    rows = packing.packed(docs, lambda: PATH).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            part = ids[d][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(map(len, ids.values())) > 0.97 * 2048 * (len(by_sequence) - 1)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, coder):
        self.coder, self.texts = coder, 0

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.coder.encode_batch_fast(texts, **options)


def test_the_tokenizer_is_called_for_many_pieces_at_once_and_not_again(whole):
    coder = packing.Coder(PATH)
    used = {name: Counted(getattr(coder, name)) for name in ("coder", "model") if hasattr(coder, name)}
    vars(coder).update(used)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdeéÀß") for _ in range(6)) + rng.choice(["", ",", "'s", "7"]) for _ in range(200)) for _ in range(20)]
    assert [x.tolist() for x in coder.encode(texts)] == [whole(t) for t in texts]
    first = sum(u.texts for u in used.values())
    assert [x.tolist() for x in coder.encode(texts[::-1])] == [whole(t) for t in texts[::-1]]
    assert first <= 40 and sum(u.texts for u in used.values()) - first <= 5

def test_what_a_worker_keeps_is_small():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(5000)) for _ in range(60)]
    coder = packing.Coder(PATH)
    list(coder.encode(["imports what is imported late"]))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        assert sum(map(len, coder.encode(texts))) > 300_000
        assert tracemalloc.get_traced_memory()[0] - before < 8_000_000  # 300,000 strings and their ids take 38 MB
    finally:
        tracemalloc.stop()
