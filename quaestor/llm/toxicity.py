"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (CLASSES), and five transducers, each a table of (state, symbol) to (state, symbol), are composed into one:
negation and reported speech turn insults and threats in their scope (SCOPE words, the rest of the clause) into weak
ones; a threat turns a target within SCOPE words after it into a menace; an object turns a threat verb within SCOPE words
after it, where a language puts the verb last, into one; a target turns later insults into aimed ones. What the composition
emits has weights, of which a clause keeps the greatest: an insult its learned weight, an aimed one TARGETED times as much, a
menace THREAT times what a document needs to be rejected, at any base rate. Weak matches and threats without target
weigh nothing: all of them in a document add WEAK of that need at most, so they never reject one. A document's
score is a logistic function of its clauses' weights. Quotation marks are not read: reported speech needs its verb.

The terminals' weights are log odds by document frequency, learned from labelled rows outside the held-out fold: all of
them, or beyond `max_labels` a share by hash that is expected to hold as many. Rows of equal text count once (toxic if one of them is). A terminal stands
for a term that comes again within NEAR words, `term+`, or for one that does not: a syllable met by chance stands alone,
an insult's stem comes again. A terminal must be in at least SUPPORT toxic texts, whatever their number or language,
have log odds above ODDS by one standard error, and stand in at least SUPPORT surroundings and VARIETY of them for each
toxic text that has it, so that near copies of one text do not make its words terminals. A word weighs as itself or by its
leading letters (STEMS of them), so
inflected insults in any language are met; a stem whose texts are nearly those of a longer terminal of more weight gives
way to it. Every entry above these fixed bounds is kept; the bound on labelled rows is what bounds the table. Text is read whole. The base rate
is that of the labels, PRIOR at most (also without labels, when only threats match): no document is rejected without a
matched clause. Null and empty texts have no clauses and score the base rate. Rows without doc_id are
held in and scored like any other. Repeated rows are scored each, and rows of one id with equal text are learned once. An empty table gives an
empty result. Columns of docs pass through; only names given for the score and the prediction are taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.common import cut

LABELS, NARROW, STEMS, SUPPORT, ODDS, VARIETY, NEAR, THRESHOLD = 1_000_000, 500_000, (4, 5, 6, 7), 8, 3.0, 0.5, 100, 0.3
SCOPE, TARGETED, THREAT, WEAK, PRIOR = 3, 1.1, 1.5, 0.5, 0.1
SENTENCE, TOKEN = re.compile(r"[.!?;\n]+"), re.compile(r"\w+")

# The closed classes of the grammar, in order of precedence. Threats of LAST follow their object.
THREATS = {"kill", "hurt", "destroy", "murder", "burn", "attack", "beat", "shoot"}
LAST = {"töten", "umbringen", "erschlagen", "verprügeln", "tuer", "tuerai", "frapper", "frapperai", "matar", "mataré", "golpear", "golpearé"}
NEGATIONS = {"not", "never", "no", "nicht", "kein", "ne", "pas", "nunca"}
REPORTS = {"said", "says", "quoted", "wrote", "called", "claimed", "sagte", "dit", "dijo"}
OBJECTS = {"dich", "euch", "te", "vous"}
TARGETS = {"you", "your", "he", "she", "they", "him", "her", "them", "people", "du", "ihr", "tu", "usted"}
CLASSES = {"threat": THREATS, "last": LAST, "negation": NEGATIONS, "report": REPORTS, "object": OBJECTS, "target": TARGETS}
SYMBOLS = {word: name for name, words in reversed(CLASSES.items()) for word in words}
ALPHABET = ("insult", *CLASSES, "other")

Transducer = dict[tuple, tuple]  # (state, symbol) to (state, symbol); a pair without entry keeps both


def fading(opens: str, turns: dict[str, str]) -> Transducer:
    """A symbol opens a scope of SCOPE words, in which the symbols of `turns` become others."""
    return {(k, x): (SCOPE if x == opens else max(k - 1, 0), turns.get(x, x) if k else x) for k in range(SCOPE + 1) for x in (*ALPHABET, "weak", "menace")}


def lasting(opens: tuple[str, ...], turns: dict[str, str]) -> Transducer:
    """Any symbol of `opens` opens a scope to the end of the clause."""
    return {**{(0, x): (1, x) for x in opens}, **{(1, x): (1, y) for x, y in turns.items()}}


HELD = {"insult": "weak", "threat": "weak", "last": "weak"}
CASCADE = (fading("negation", HELD), lasting(("report",), HELD), fading("threat", {"target": "menace", "object": "menace"}), fading("object", {"last": "menace"}), lasting(("target", "object", "menace"), {"insult": "aimed"}))


def composed(cascade: tuple[Transducer, ...]) -> dict[tuple[int, str], tuple[int, str]]:
    """The composition: what one transducer emits is what the next one reads; states are numbered as they are reached."""
    numbers, found, table = {(0,) * len(cascade): 0}, [(0,) * len(cascade)], {}
    for state in found:
        for symbol in ALPHABET:
            now, x = [], symbol
            for t, q in zip(cascade, state):
                q, x = t.get((q, x), (q, x))
                now.append(q)
            if tuple(now) not in numbers:
                numbers[tuple(now)] = len(found)
                found.append(tuple(now))
            table[numbers[state], symbol] = numbers[tuple(now)], x
    return table


GRAMMAR = composed(CASCADE)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def stems(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def terminals(text: str) -> list[str]:
    """The terms of a text, with a plus where one comes again within NEAR words."""
    last: dict[str, int] = {}
    again = set()
    for i, word in enumerate(TOKEN.findall(text.lower())):
        for t in stems(word):
            if i - last.get(t, -NEAR - 1) <= NEAR:
                again.add(t)
            last[t] = i
    return [t + "+" if t in again else t for t in last]


def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """term, p, n: toxic and other texts that have a terminal, added up in part."""
    found: tuple[Counter, Counter] = (Counter(), Counter())

    def part() -> pd.DataFrame:
        names = list(found[0].keys() | found[1].keys())
        out = pd.DataFrame({"term": pd.Series(names, dtype=object), "p": [found[1][t] for t in names], "n": [found[0][t] for t in names]})
        for f in found:
            f.clear()
        return out.astype({"p": "int64", "n": "int64"})

    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            found[int(toxic)].update(terminals(text))
            if len(found[0]) + len(found[1]) > 500_000:
                yield part()
    yield part()


def longest(found: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights without the stems that only repeat, with less weight, a longer terminal: 'lose*' beside 'loser'."""
    longer = defaultdict(list)
    for t, p, w in found:
        word, plus = t.rstrip("+*"), "+" * t.endswith("+")
        for n in STEMS:
            if len(word) > n or (len(word) == n and "*" not in t):
                longer[word[:n] + "*" + plus].append((p, w))
    return {t: w for t, p, w in found if not any(v > w + 1e-9 and q >= 0.9 * p for q, v in longer.get(t, ()))}


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = LABELS) -> tuple[dict[str, float], float]:
    """(weight of each terminal, base log odds) from labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    open_ = docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("h"))
    rows = cut(open_.select("doc_id", "h").join(known, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")))
    if (known_texts := rows.count()) > max_labels:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_labels / known_texts * (1 << 30)))
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    p, n = total["p"] or 0, total["n"] - (total["p"] or 0)
    base = min(math.log((p + 1) / (n + 1)), math.log(PRIOR / (1 - PRIOR)))
    # The merge join deals equal ids to one task, where one of equal rows is taken without another exchange.
    texts = open_.join(rows.hint("merge"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sums = texts.select("text", "toxic").mapInPandas(counted, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") >= SUPPORT)
    odds = F.log((F.col("p") + 0.5) / (p + 1)) - F.log((F.col("n") + 0.5) / (n + 1))
    sums = sums.withColumn("w", odds).where(F.col("w") - F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5)) > ODDS)
    found = sums.orderBy(F.desc("w"), "term").collect()
    marked = rows.where("toxic = 1").select("doc_id", "h")  # p rows of 16 bytes
    toxic = open_.join(F.broadcast(marked) if p <= NARROW else marked.hint("merge"), ["doc_id", "h"])
    varied = contexts(toxic, sorted({r["term"].rstrip("+") for r in found}))
    return longest([(r["term"], r["p"], r["w"]) for r in found if varied.get(r["term"].rstrip("+"), 0) >= max(SUPPORT, VARIETY * r["p"])]), base


def contexts(rows: DataFrame, candidates: list[str]) -> dict[str, int]:
    """In how many surroundings (the words before and after) rows have each candidate: few, where copies repeat one text."""
    if not candidates:
        return {}
    known = rows.sparkSession.createDataFrame([(t,) for t in candidates], "term string")  # terminals of at most LABELS texts
    words = rows.select(F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"(?U)\w+"), F.lit(0)).alias("words"))
    places = words.select(F.explode(F.transform("words", lambda w, i: F.struct(w.alias("w"), F.xxhash64(F.get("words", i - 1), F.get("words", i + 1)).alias("c")))).alias("x"))
    short = [F.when(F.length("x.w") > n, F.concat(F.substring("x.w", 1, n), F.lit("*"))) for n in STEMS]
    each = places.select("x.c", F.explode(F.array(F.col("x.w"), *short)).alias("term")).join(F.broadcast(known), "term")
    return {r["term"]: r["n"] for r in each.groupBy("term").agg(F.approx_count_distinct("c", 0.02).alias("n")).collect()}


class Grammar:
    """The composed transducers with the learned insults."""

    def __init__(self, weights: dict[str, float], base: float):
        self.weights, self.base, self.memo = weights, base, {}
        self.heads = {t.rstrip("+*")[: STEMS[0]] for t in weights}  # a word that begins otherwise has no learned term
        self.need = math.log(THRESHOLD / (1 - THRESHOLD)) - base
        self.place, self.last = 0, {}  # the word's place in the document, and each term's last one

    def known(self, word: str) -> list[tuple[str, float, float]]:
        """The learned terms of a word, with their weights once and again."""
        if word[: STEMS[0]] not in self.heads:
            return []
        got = self.memo.get(word)
        if got is None:
            pairs = [(t, self.weights.get(t, 0.0), self.weights.get(t + "+", 0.0)) for t in stems(word)]
            got = [(t, w, max(w, v)) for t, w, v in pairs if w or v]
            if len(self.memo) < 100_000:
                self.memo[word] = got
        return got

    def insult(self, word: str) -> float:
        most = 0.0
        for t, once, again in self.known(word):
            most = max(most, again if self.place - self.last.get(t, -NEAR - 1) <= NEAR else once)
            self.last[t] = self.place
        return most

    def clause(self, text: str) -> tuple[float, bool]:
        """The weight of a matched clause, 0 if nothing is matched, and whether it has a weak match."""
        state, most, weak = 0, 0.0, False
        for word in TOKEN.findall(text):
            self.place += 1
            w = self.insult(word)
            state, out = GRAMMAR[state, "insult" if w else SYMBOLS.get(word, "other")]
            if out == "insult":
                most = max(most, w)
            elif out == "aimed":
                most = max(most, w * TARGETED)
            elif out == "menace":
                most = max(most, THREAT * self.need)
            elif out in ("weak", "threat", "last"):
                weak = True
        return most, weak

    def score(self, text: str | None) -> float:
        self.place, self.last = 0, {}
        found = [self.clause(c) for c in SENTENCE.split((text or "").lower())]
        weights = sorted((w for w, _ in found if w), reverse=True)
        x = self.base + sum(w * 0.5**i for i, w in enumerate(weights))
        if any(weak for _, weak in found):
            x += WEAK * self.need if not weights else 0.0
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def scored(docs: DataFrame, train: DataFrame, labels: DataFrame, score_name: str = "score", predicted_name: str = "predicted") -> DataFrame:
    """docs with a score (double) and a prediction (int) added under the names given; learned from train and labels."""
    weights, base = learn(train, labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        grammar = Grammar(weights, base)
        return text.map(grammar.score).astype(float)

    out = docs.withColumn(score_name, score(F.coalesce("text", F.lit(""))))
    return out.withColumn(predicted_name, (F.col(score_name) >= THRESHOLD).cast("int"))
