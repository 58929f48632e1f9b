"""How many tokens texts have: byte-pair merging with a heap over a linked list of symbols; no ids are put out.

A text is cut at the tokenizer's special strings (one token each), then into pieces by its splitter. A piece starts as one
symbol a byte. The lowest-rank adjacent pair (of equal ones the leftmost) is popped from a heap and merged, its neighbours
make new pairs, and entries that a merge has overtaken are passed over when popped. The count of a piece is its bytes
minus its merges. A worker remembers the counts of short pieces, so a piece is merged once for each time it is forgotten.

Null and empty texts have 0 tokens and 0 bytes. A null doc_id stays; repeated rows are counted each; an empty table gives
no rows. A text of any length is read in portions of PORTION pieces; a single piece without a break takes memory in
proportion to its own length. Other columns of the input are passed over, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The splitter of byte-level pair encoding, and how its vocabulary writes bytes that are no visible characters.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII and the letters, digits and blanks of Latin-1, for which `re` is twice as fast.
LATIN, DIGIT, BLANK = r"A-Za-zªµºÀ-ÖØ-öø-ÿ", r"0-9²³¹¼-¾", r"\t-\r\x20\x85\xa0"
NEAR = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{DIGIT}]+| ?[^{BLANK}{LATIN}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

MEMO, LONGEST, PORTION, WHOLE = 1_000_000, 48, 100_000, 1 << 20
SHIFT, PLACE, GONE = 32, (1 << 32) - 1, -1


def letters() -> dict[int, str]:
    """The character that stands for each byte: visible ones for themselves, the others for those from 256 on, in order."""
    hidden = [b for b in range(256) if b not in set(VISIBLE)]
    return {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Counts tokens by a tokenizers file of plain byte-level pairs; a ValueError for any other kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        model, split = rules["model"], rules.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not rules.get("normalizer")
        if not plain or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level pair encoding")
        special = rules.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in special):
            raise ValueError(f"{path} has special strings that take in what stands around them")
        names = model["vocab"]
        self.first = [names[c] for _, c in sorted(letters().items())]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(names[a] << SHIFT | names[b], rank)
            self.made.append(names[a + b])
        strings = sorted((t["content"] for t in special), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.piece, self.near, self.far = regex.compile(PIECE), re.compile(NEAR), re.compile(r"[^\x00-\xff]")
        self.memo: dict[str, int] = {}

    def merged(self, piece: bytes) -> int:
        """The tokens of one piece."""
        first, get, made = self.first, self.ranks.get, self.made
        symbols = [first[b] for b in piece]
        left = n = len(symbols)
        found = [(get(a << SHIFT | b), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
        heap = [rank << SHIFT | i for rank, i in found if rank is not None]
        if not heap:
            return n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            top = heappop(heap)
            rank, i = top >> SHIFT, top & PLACE
            j = after[i]
            if j == n or get(symbols[i] << SHIFT | symbols[j]) != rank:
                continue  # a merge since has changed one of the two
            symbols[i] = new = made[rank]
            symbols[j] = GONE
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = get(new << SHIFT | symbols[k])
                if rank is not None:
                    heappush(heap, rank << SHIFT | i)
            h = before[i]
            if h >= 0:
                rank = get(symbols[h] << SHIFT | new)
                if rank is not None:
                    heappush(heap, rank << SHIFT | h)
        return left

    def portion(self, pieces: list[str]) -> int:
        memo = self.memo
        unseen = set(pieces).difference(memo)
        if len(memo) + len(unseen) > MEMO:
            memo = self.memo = {}
            unseen = set(pieces)
        long = {}
        for p in unseen:
            (memo if len(p) <= LONGEST else long)[p] = self.merged(p.encode())
        if long:
            return sum(long[p] if p in long else memo[p] for p in pieces)
        return sum(map(memo.__getitem__, pieces))

    def stretch(self, text: str) -> int:
        """The tokens of a text without special strings."""
        piece = self.piece if self.far.search(text) else self.near
        if len(text) <= WHOLE:
            return self.portion(piece.findall(text))
        found = (m.group() for m in piece.finditer(text))
        return sum(map(self.portion, iter(lambda: list(islice(found, PORTION)), [])))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.stretch(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.stretch(text[at : m.start()]) + 1
            at = m.end()
        return total + self.stretch(text[at:] if at else text)


@lru_cache(2)
def counter(path: str) -> Counter:
    """The worker's counter: what it remembers serves its later tasks too."""
    return Counter(path)


def token_count(text: Column, tokenizer: str | Callable[[], str]) -> Column:
    """The tokens of a text; the file is named by its path, or by a function that finds it where the task runs."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(tokenizer() if callable(tokenizer) else tokenizer)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return tokens(text)


def token_counts(docs: DataFrame, tokenizer: str | Callable[[], str], limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, tokenizer).alias("n_tokens"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
