"""Packing token pieces into windows by non-negative least squares.

Each document is cut into full windows, then a tail that is a multiple of GRID tokens, then a rest of under GRID. Full
windows stand alone. For tails, every combination of at most DEPTH grid lengths that fills a window is a column, the
histogram of tails the right-hand side: non-negative least squares gives repeat counts, rounded down to what is there.
What is left, and all rests, is packed greedily, longest first, on the histogram. Only the histogram (one row per
length) reaches the driver. A piece finds its place by its rank among the pieces of its length.

Null text is empty: its document is the one closing id. Repeated rows are packed each. An empty table packs nothing.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import buckets_for, cut, numbered

WINDOW, GRID, DEPTH, CLOSING = 2048, 64, 4, 1
PIECES = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
# The normaliser and splitter of word_bpe_49k.json, for which pieces can be cut here as it cuts them.
KNOWN = ("Sequence", "NFC", "Replace", r"\s+", "Lowercase"), r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+", re.ASCII)
#: Places for pieces, ids kept with one, bytes of the longest piece kept, bytes coded at a time, pieces given to the tokenizer at a time.
MEMO, IDS, LONGEST, PART, AT_ONCE = 1 << 19, 7, 16, 1 << 18, 256
_BYTES = np.arange(256, dtype=np.uint8)
WHITE = np.isin(_BYTES, list(b" \t\n\r"))
LOWER = _BYTES + np.uint8(32) * ((_BYTES >= 65) & (_BYTES <= 90)).astype(np.uint8)
#: Kinds of bytes between which the splitter cuts: letters (of UTF-8 beyond ASCII, C3 and what follows it), blanks that are in runs, other.
KIND = np.full(256, 2, np.uint8)
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = 1
KIND[[0x0B, 0x0C]] = 3
DIGIT, QUOTE = np.isin(_BYTES, list(b"0123456789")), ord("'")
#: Bytes on which this module and the tokenizer's own code might differ: NUL, and of UTF-8 beyond ASCII all but C3 and what follows it.
ODD = (_BYTES == 0) | (_BYTES >= 0xC0) & (_BYTES != 0xC3)
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX, SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 with A-Z and the capitals from À to Þ made small."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E)]
    out[after] += np.uint8(32)
    return out


class Coder:
    """ids of texts by a tokenizer file; pieces are coded once, the unseen ones of a batch together.

    For the known splitter, tokens never span white space: text is cut at it into runs. A run without odd bytes is cut
    further where the splitter cuts, and the model codes many pieces in one call: each piece ends with the one token that
    has the model's suffix. Other runs go whole through the tokenizer's own code. A piece of at most LONGEST bytes and IDS ids is kept at a place found by
    its hash, beside its own bytes, which are compared, so places that two pieces share cost time only. What is kept
    takes no more than MEMO places, in arrays. Any other tokenizer codes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.coder = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            kinds = json.load(f)
        rule, norm = kinds.get("pre_tokenizer") or {}, kinds.get("normalizer") or {}
        split = (rule.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        steps = [x for n in norm.get("normalizers", []) for x in (n.get("type"), *([n["pattern"].get("Regex")] if "pattern" in n else []))]
        suffix, names = kinds["model"].get("end_of_word_suffix"), kinds["model"].get("vocab", {})
        self.known = ((norm.get("type"), *steps), split) == KNOWN and bool(suffix) and max(names.values()) < 1 << 16 and all(t["content"].startswith("<|") for t in kinds.get("added_tokens", []))
        if self.known:
            self.model = Tokenizer(self.coder.model)  # shares the model; its pieces come cut and lowered
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(names.values()) + 1, bool)
            self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
            self.kept = np.zeros((MEMO, 4), np.uint64)  # a row: the piece's bytes in two numbers, its ids in 16 bits each, how many

    def own(self, texts: list[str]) -> list[np.ndarray]:
        """ids by the tokenizer's whole code."""
        return [np.array(e.ids, "<u4") for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, pieces: list[str]) -> list[np.ndarray]:
        """ids of lowered pieces, or of several that hang together by quotation marks."""
        out: list[np.ndarray] = []
        for i in range(0, len(pieces), AT_ONCE):
            part = pieces[i : i + AT_ONCE]
            cut_up = [[p] if p.isalpha() else PLAIN.findall(p) for p in part]
            ids = np.array(self.model.encode_batch_fast([" ".join(chain.from_iterable(cut_up))], add_special_tokens=False)[0].ids, "<u4")
            ends, upto = np.append(0, np.flatnonzero(self.ends[ids]) + 1), np.cumsum([0, *map(len, cut_up)])
            if len(ends) != upto[-1] + 1:  # a model without a token for every byte
                out += self.own(part)
                continue
            stops = ends[upto].tolist()
            out += [ids[a:b] for a, b in zip(stops, stops[1:])]
        return out

    def group(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after another in UTF-8, and where those of each text begin."""
        filled = ~WHITE[data]
        fresh = filled.copy()  # where pieces begin
        fresh[1:] &= ~filled[:-1]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        fresh[inner] = filled[inner]
        kind, quote = KIND[data], data == QUOTE
        cuts = (kind[1:] != kind[:-1]) | DIGIT[data[1:]] | DIGIT[data[:-1]]
        cuts &= filled[1:] & filled[:-1] & ~(quote[1:] | quote[:-1])  # 's and the like are left to PLAIN
        odd = ODD[data]
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        odd[1:] |= (pairs == 0x3C7C) | (pairs == 0xC397) | (pairs == 0xC3B7)  # <| of the added tokens, signs among the letters
        if strange := bool(odd.any()):  # runs with such bytes stay whole
            run = np.cumsum(fresh) - 1
            odd_run = np.zeros(run[-1] + 2, bool)
            odd_run[run[odd]] = True
            cuts &= ~odd_run[run[1:]]
        fresh[1:] |= cuts
        starts = np.flatnonzero(fresh)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), int)
        filled[:-1] &= ~filled[1:] | fresh[1:]  # where they end
        stops = np.flatnonzero(filled) + 1
        sizes = stops - starts
        whole = odd_run[run[starts]] if strange else np.zeros(len(starts), bool)
        usable = ~whole & (sizes <= LONGEST)
        low = lowered(data)
        padded = np.append(low, np.zeros(16, np.uint8))
        wide = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))
        head, rest = wide[starts] & MASKS[np.minimum(sizes, 8)], wide[starts + 8] & MASKS[np.clip(sizes - 8, 0, 8)]
        place = (head ^ (rest * MIX)) * MIX
        place = ((place ^ (place >> SHIFT)) * MIX >> SHIFT) % np.uint64(len(self.kept))
        rows = self.kept.take(place.astype(np.int64), axis=0)
        hit = usable & (rows[:, 0] == head) & (rows[:, 1] == rest)
        parts = rows[:, 2:].copy().view(np.uint16)
        counts = np.where(hit, parts[:, IDS], 0).astype(np.int64)
        known = parts[:, :IDS][np.arange(IDS) < counts[:, None]]
        missing = np.flatnonzero(~hit)
        if not len(missing):
            ids = known.astype("<u4")
        else:
            coded = self.missed(data.tobytes(), low.tobytes(), starts[missing].tolist(), stops[missing].tolist(), whole[missing].tolist())
            counts[missing] = list(map(len, coded))
            ids = np.empty(counts.sum(), "<u4")
            kept = np.repeat(hit, counts)
            ids[kept], ids[~kept] = known, np.concatenate(coded)
            keep = np.flatnonzero(usable[missing] & (counts[missing] <= IDS))
            keep = keep[np.unique(place[missing[keep]], return_index=True)[1]]  # one piece for a place
            at, parts = missing[keep], np.zeros((len(keep), IDS + 1), np.uint16)
            parts[:, IDS] = counts[at]
            parts[:, :IDS][np.arange(IDS) < counts[at, None]] = np.concatenate([np.zeros(0, "<u4"), *(coded[i] for i in keep.tolist())])
            self.kept[place[at]] = np.column_stack([head[at], rest[at], parts.view(np.uint64)])
        return ids, np.append(0, np.cumsum(counts))[np.searchsorted(starts, bounds)]

    def missed(self, data: bytes, low: bytes, starts: list[int], stops: list[int], whole: list[bool]) -> list[np.ndarray]:
        """ids of pieces that are not kept, and of whole runs with odd bytes, each distinct one coded once."""
        names = [(data if w else low)[a:b] for a, b, w in zip(starts, stops, whole)]
        runs = list({x for x, w in zip(names, whole) if w})
        found = dict(zip(runs, self.own([r.decode() for r in runs])))  # no piece equals a run with odd bytes
        pieces = list(set(names).difference(found))
        found.update(zip(pieces, self.plain([p.decode() for p in pieces])))
        return list(map(found.__getitem__, names))

    def long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of a long text, cut at white space into parts of about PART bytes."""
        at = 0
        while at < len(data):
            end = min(at + PART, len(data))
            while end < len(data) and not (there := np.flatnonzero(WHITE[data[end : end + PART]])).size:
                end = min(end + PART, len(data))
            if end < len(data):
                end += int(there[0])
            yield self.group(data[at:end], np.array([0]))[0]
            at = end

    def encode(self, texts: list[str] | pa.Array) -> Iterator[np.ndarray]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()).fill_null("")
        if not self.known:
            for text in texts:
                yield self.own([text.as_py()])[0]
            return
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + PART, "right")) - 1)
            part = data[bounds[i] : bounds[j]]
            if len(part) > PART:  # one text
                yield np.concatenate(list(self.long(part)))
            else:
                ids, first = self.group(part, bounds[i : j + 1] - bounds[i])
                yield from (ids[a:b] for a, b in zip(first[:-1], first[1:]))
            i = j


@lru_cache(2)
def coder(path: str) -> Coder:
    """The worker's coder: what it keeps serves its later tasks too."""
    return Coder(path)


def tokenised(docs: DataFrame, tokenizer: str | Callable[[], str]) -> DataFrame:
    """The pieces of each document; the file is named by its path, or by a function that finds it where the task runs."""

    def pieces(batches):
        own = coder(tokenizer() if callable(tokenizer) else tokenizer)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), own.encode(batch["text"])):
                ids = np.append(ids, np.array([CLOSING], "<u4"))
                n, at = len(ids), 0
                tail = n % WINDOW
                for length in [*[WINDOW] * (n // WINDOW), tail - tail % GRID, tail % GRID]:
                    if length:
                        out.append((doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), n))
                        at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * len(PIECES), schema=PIECES)

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(pieces, ", ".join(f"{n} long" for n in PIECES.names))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-6 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 0)
            if not bad.any():
                x = s
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-12))
            x = x + step * (s - x)
            active &= x > 1e-9
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(histogram: dict[int, int]) -> list[tuple[list[int], int]]:
    """(lengths of one window, repeats): uses every piece of the histogram exactly once."""
    left = Counter({k: v for k, v in histogram.items() if v})
    out = [([WINDOW], left.pop(WINDOW))] if left.get(WINDOW) else []
    lengths = sorted(x for x in left if x % GRID == 0)
    units = {x // GRID for x in lengths}
    combos = [c for d in range(2, DEPTH + 1) for c in combinations_with_replacement(sorted(units), d) if sum(c) == WINDOW // GRID]
    if combos:
        row = {u: i for i, u in enumerate(sorted(units))}
        a = np.zeros((len(row), len(combos)))
        for j, c in enumerate(combos):
            for u in c:
                a[row[u], j] += 1
        x = nnls(a, np.array([left[u * GRID] for u in sorted(units)], float))
        for j in np.argsort(-x):
            need = Counter(u * GRID for u in combos[j])
            times = min(int(x[j]), *(left[k] // m for k, m in need.items()))
            if times > 0:
                out.append(([u * GRID for u in combos[j]], times))
                left.subtract({k: m * times for k, m in need.items()})
    left = +left
    while left:
        room, window = WINDOW, Counter()
        for k in sorted(left, reverse=True):
            if m := min(left[k], room // k):
                window[k], room = m, room - m * k
        times = min(left[k] // m for k, m in window.items())
        out.append((list(window.elements()), times))
        left.subtract({k: m * times for k, m in window.items()})
        left = +left
    return out


def packed(docs: DataFrame, tokenizer: str | Callable[[], str]) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    pieces = cut(tokenised(docs, tokenizer))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most WINDOW rows
    spans, used, sequence = [], Counter(), 0
    for lengths, times in patterns(histogram):
        offset = 0
        for x in lengths:
            spans.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    places = docs.sparkSession.createDataFrame(spans, "_l long, lo long, hi long, base long, offset long")
    ranked = numbered(pieces, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.lit(1), "rank", buckets_for(sum(histogram.values())))
    # A few hundred windows' worth of rows, bounded by WINDOW and DEPTH and not by the input.
    found = ranked.join(F.broadcast(places), (F.col("length") == F.col("_l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
