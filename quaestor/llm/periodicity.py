"""Periodic runs of words: Lyndon stacks scanned from right to left under both orders of the words.

For each place, the stack gives the longest Lyndon word that starts there: it ends at the next smaller suffix. Every run
has a root that is such a word under one of the two orders, so the pairs (place, end of its Lyndon word) are all
candidates. Suffixes are compared, and candidates extended to both sides, by the length that two places have in common:
a few words directly, then a rolling hash with doubling steps and a binary search. What the hash calls equal is compared
word by word too, once for each distance and place, and what was compared is remembered. No suffix array is built.

A document is worked on by itself, in memory in proportion to its words. Null and empty texts and texts of white space
have no words and no runs, and an empty collapsed text; without a run the words are joined by single blanks. A null
doc_id stays; repeated rows are worked on each; an empty table gives no rows. Ties cannot occur: runs differ in start,
length or period. Other columns of the input are passed over, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULUS, BASE = (1 << 61) - 1, 1_000_003 * 998_244_353  # of the rolling hash
NEAR, BATCH = 8, 8 << 20  # words compared directly before the hash; bytes of texts put out at once
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Common:
    """Lengths that two places of a text have in common, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words, self.n = words, len(words)
        self.known: dict[int, tuple[int, int]] = {}  # distance d: words x and x + d are equal for all x of this range, and differ at its end
        self.sums: list[int] = []
        self.powers: list[int] = []

    def same(self, i: int, j: int, length: int) -> bool:
        """Whether `length` words from i and from j have the same hash."""
        if not self.sums:
            total, power, self.sums, self.powers = 0, 1, [0], [1]
            for w in self.words:
                total, power = (total * BASE + w + 1) % MODULUS, power * BASE % MODULUS
                self.sums.append(total)
                self.powers.append(power)
        s, p = self.sums, self.powers[length]
        return (s[i + length] - s[i] * p - s[j + length] + s[j] * p) % MODULUS == 0

    @staticmethod
    def reach(equal, most: int) -> int:
        """The greatest length up to `most` for which equal(at, length) holds: doubling steps, then a binary search in the last."""
        at, step = 0, NEAR
        while at < most:
            step = min(step, most - at)
            if not equal(at, step):
                low, high = 0, step - 1
                while low < high:
                    half = (low + high + 1) // 2
                    low, high = (half, high) if equal(at, half) else (low, half - 1)
                return at + low
            at, step = at + step, 2 * step
        return at

    def right(self, i: int, j: int) -> int:
        """How many words from i and from j > i on are the same."""
        w, n, d = self.words, self.n, j - i
        start, stop = self.known.get(d, (n, -1))
        k, most = 0, n - j
        while k < most and k < NEAR and w[i + k] == w[j + k]:
            if start <= i + k < stop:  # compared before: it ends there
                self.known[d] = (min(i, start), stop)
                return stop - i
            k += 1
        if k < NEAR or k == most:
            return k
        length = k + self.reach(lambda at, m: self.same(i + k + at, j + k + at, m), most - k)
        first, last = i, i + length
        if start < last and stop >= last:
            last = max(i, start)
        if w[first:last] != w[first + d : last + d]:  # the hash met two different words: word by word
            length = next((x for x in range(most) if w[i + x] != w[j + x]), most)
        self.known[d] = (i, i + length)
        return length

    def left(self, i: int, j: int) -> int:
        """How many words before i and before j > i are the same."""
        w, k = self.words, 0
        while k < i and k < NEAR and w[i - 1 - k] == w[j - 1 - k]:
            k += 1
        if k < NEAR or k == i:
            return k
        length = k + self.reach(lambda at, m: self.same(i - k - at - m, j - k - at - m, m), i - k)
        if w[i - length : i] != w[j - length : j]:
            length = next((x for x in range(i) if w[i - 1 - x] != w[j - 1 - x]), i)
        return length


def roots(keys: list[int], common: Common, side: bool) -> list[tuple[int, int]]:
    """(place, end of its longest Lyndon word) by the order of keys, for places that can start a root of a run.

    Places whose word is that of the end: a run of three periods or more holds two whole roots side by side. With `side`,
    also those where the words before the two are the same, as shorter runs need.
    """
    n = len(keys)
    smaller = [n] * n  # the stack: from each place to the next suffix that is smaller
    found = []
    top = n
    for i in range(n - 1, -1, -1):
        key = keys[i]
        while top < n:
            other = keys[top]
            if other < key:
                break
            if other == key:
                length = common.right(i, top)
                if top + length == n or keys[top + length] < keys[i + length]:  # an end is smaller than any word
                    break
            top = smaller[top]
        smaller[i] = top
        if top < n and (keys[top] == key or (side and i and keys[i - 1] == keys[top - 1])):
            found.append((i, top))
        top = i
    return found


def runs(words: list[int], least: int = 6, repeats: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` words and `repeats` (2 or more) smallest periods."""
    if repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    common, out = Common(words), set()
    for keys in (words, [-w for w in words]):
        last: dict[int, tuple[int, int]] = {}  # by period, the run seen last: its further roots give it again
        for i, j in roots(keys, common, repeats < 3):
            p = j - i
            start, end = last.get(p, (0, 0))
            if start <= i and j <= end:
                continue
            start, end = i - common.left(i, j), j + common.right(i, j)
            if end - start >= 2 * p:
                last[p] = (start, end)
                if end - start >= max(least, repeats * p):
                    out.add((start, end - start, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> bytearray:
    """For each word, 1 if no run has it after its own first period."""
    keep = bytearray(b"\x01") * n
    for start, length, period in found:
        keep[start + period : start + length] = bytes(length - period)
    return keep


def scanned(text: str | None, least: int = 6, repeats: int = 4) -> tuple[int, list[tuple[int, int, int]], str]:
    """The number of words of a text, its runs, and its words without repeats."""
    words = (text or "").encode().split()  # bytes part at the six ASCII blanks only
    ids: dict[bytes, int] = {}
    found = runs([ids.setdefault(w, len(ids)) for w in words], least, repeats)
    return len(words), found, b" ".join(compress(words, kept(len(words), found)) if found else words).decode()


def periodic_runs(docs: DataFrame, least: int = 6, repeats: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period) and collapsed, the text with each run cut to its first period."""
    runs_type = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", runs_type), ("collapsed", pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                n, found, collapsed = scanned(text.as_py(), least, repeats)
                rows.append((doc_id.as_py(), n, [dict(zip(("start", "length", "period"), r)) for r in found], collapsed))
                size += len(collapsed) + 24 * len(found)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[x for x, _ in fields])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[x for x, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FOUND)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text, where one document in ten (by the CRC of its id) ends in a repeated stretch: rows that are sure to hold runs.

    With h the CRC, g = floor(h / 10), n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), word i >= a becomes word
    a + (i - a) % p. A null id leaves the text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, words).alias("_w"))
    rows = rows.select("doc_id", "text", "_g", "_w", F.when(F.size("_w") > 0, F.size("_w").cast("long")).alias("_n"))
    rows = rows.select("*", (F.col("_g") % F.col("_n")).alias("_a"))
    rows = rows.select("*", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).alias("_p"))
    place = lambda i: (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    tail = F.transform(F.sequence("_a", F.col("_n") - 1), lambda i: F.get(F.col("_w"), place(i)))
    whole = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when(F.col("_n").isNotNull(), whole).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period) and SHA-256 of all runs and of the collapsed text."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).alias("_lines"), "collapsed")
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    share = F.floor(F.lit(1000).cast("long") * length / period)
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), share.alias("exponent_milli"), sha("_lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"))
