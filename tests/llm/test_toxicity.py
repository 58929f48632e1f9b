"""Toxicity: learning in small languages, clauses that decide, and label tables without a usable base rate."""

import math
import random

from quaestor.llm import toxicity

LABELS, DOCS = "doc_id long, toxic int", "doc_id long, text string"


def corpus():
    """300 toxic English texts, 16 toxic Spanish ones with an inflected insult and clean texts of both with chance hits."""
    rng, out = random.Random(3), []
    words = lambda k, n: [k + "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(n)]
    for i in range(1800):
        lang, toxic = ("e", i < 400) if i < 1500 else ("s", i < 1524)
        text = words(lang, 40)
        if toxic:
            for at in (5, 15, 25):
                text[at] = rng.choice(("bozzo", "grimlet")) if lang == "e" else "bomente" + rng.choice(("co", "ra", "lla", "do", "ja", "mi"))
        elif i % 40 == 0:
            text[7] = "bomente" + rng.choice(("co", "ra", "lla", "do", "ja", "mi"))
        out.append((i, " ".join(text), int(toxic)))
    return out


def test_insults_of_a_small_language_are_learned(spark):
    rows = corpus()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, docs, labels).collect()}
    assert got == {i: toxic for i, _, toxic in rows}


def test_copies_count_once(spark):
    rows = [(i, "one text with oddword in it and oddword too", 1) for i in range(200)] + [(i, f"clean text {i} of words", 0) for i in range(200, 600)]
    weights, base = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS))
    assert not weights and base < math.log(2 / 250)


def test_clauses_decide():
    """At base rates from 1 in 1,000 to 3 in 10, with the weights learned there."""
    for share in (0.001, 0.1, 0.29):
        grammar = toxicity.Grammar({"idiot": 9.0, "idiot+": 9.0}, math.log(share / (1 - share)))
        rejected = lambda t: grammar.score(t) >= toxicity.THRESHOLD
        assert rejected("You are an idiot.") and rejected("Such an idiot") and rejected("We will kill you.") and rejected("She is not tall but an idiot")
        assert not rejected("He is not an idiot. " * 50) and not rejected("She said that he was an idiot. " * 50)
        assert not rejected("They kill time. We will not kill you. He said we will kill you. " * 50) and not rejected("A calm text") and not rejected(None)


def test_no_match_no_rejection(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(40)] + [(40, None), (41, ""), (42, "we will kill you")], DOCS)
    for labels in ([], [(i, 1) for i in range(40)], [(i, int(i % 4 > 0)) for i in range(40)]):
        got = toxicity.scored(docs, docs, spark.createDataFrame(labels, LABELS)).collect()
        assert {r["doc_id"] for r in got if r["predicted"]} == {42} and len(got) == 43


def test_threats_of_four_languages():
    grammar = toxicity.Grammar({}, math.log(0.1 / 0.9))
    rejected = lambda t: grammar.score(t) >= toxicity.THRESHOLD
    assert all(map(rejected, ("They will shoot you.", "Ich werde dich umbringen!", "Je vais te tuer.", "Te voy a matar.")))
    assert not any(map(rejected, ("Ich werde dich nicht töten.", "Er sagte, er werde dich töten.", "Nunca te mataré.", "Sie töten Zeit.", "You kill time.")))


def test_composition_equals_the_cascade():
    """Reading symbols through the composed table gives what the transducers give one after another."""
    rng = random.Random(7)
    for _ in range(300):
        word = [rng.choice(toxicity.ALPHABET) for _ in range(rng.randrange(1, 25))]
        state, got = 0, []
        for x in word:
            state, y = toxicity.GRAMMAR[state, x]
            got.append(y)
        for t in toxicity.CASCADE:
            q, out = 0, []
            for x in word:
                q, y = t.get((q, x), (q, x))
                out.append(y)
            word = out
        assert got == word


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [(None, "you idiot"), (1, None), (1, None), (2, "we will kill you"), (2, "we will kill you"), (3, "")]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0)], LABELS)
    got = sorted(((r["doc_id"] or 0, r["predicted"]) for r in toxicity.scored(docs, docs, labels).collect()))
    assert got == [(0, 0), (1, 0), (1, 0), (2, 1), (2, 1), (3, 0)]
    assert toxicity.scored(docs.limit(0), docs.limit(0), labels.limit(0)).count() == 0


def test_a_bound_on_labelled_rows(spark):
    rows = corpus()
    docs, labels = spark.createDataFrame([r[:2] for r in rows], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    assert toxicity.learn(docs, labels, 600)[0].keys() & {"bozzo", "bozzo+", "grimlet", "grimlet+", "bozzo*", "grim*", "grim*+"}
