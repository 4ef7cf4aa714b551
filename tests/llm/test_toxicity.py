import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import toxicity
from quire.llm.common import held_out


def brute_segments(scores):
    """Maximal segments by definition: take the best segment (the longest of equals
    is no issue with real numbers), then both sides of it."""
    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (found is None or total > found[2]):
                    found = (i, j, total)
        return found

    def part(a, b):
        found = best(a, b)
        return [] if found is None else part(a, found[0]) + [found] + part(found[1] + 1, b)

    return part(0, len(scores))


def test_segments_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        n, drift = rng.randint(1, 40), rng.choice([0.11, 0.53])
        odds = [rng.choice([0, 0, 0, rng.uniform(-3, 5)]) for _ in range(n)]
        places = [i for i, x in enumerate(odds) if x]
        found = toxicity.maximal_segments(places, [odds[i] for i in places], drift)
        wanted = brute_segments([x - drift for x in odds])
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in wanted]
        assert [s for *_, s in found] == pytest.approx([s for *_, s in wanted])


def test_decay_solves_the_moment_equation():
    p, s = np.array([0.01, 0.04, 0.95]), np.array([3.0, 1.0, -0.5])
    assert (p * np.exp(toxicity.decay_root(p, s) * s)).sum() == pytest.approx(1)


def _table(spark, n=600):
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["vile", "Rotten", "filthy"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 1
        for _ in range(max(2, len(words) // 20) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "ish", "!"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "vile rotten filthy vile", "x"), (0, docs[0][1], "x")]
    labels += [(None, 1), (2, None), (n + 5, 1), (0, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, toxic string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"), n)


def test_learns_and_keeps_clean_documents(spark):
    docs, labels, n = _table(spark)
    fold = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, train=~fold)
    out = docs.select("doc_id", fold.alias("h"), toxicity.score(model, F.col("text")).alias("score")).collect()
    assert len(out) == n + 4 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["h"] and r["doc_id"] < n]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 1) for r in held]) > 0.95
    assert all(r["score"] < 0.5 for r in out if r["doc_id"] in (n, n + 1))
    found = toxicity.passages(docs, model).collect()
    assert {r["id"] for r in found if r["id"] is not None} <= set(range(n))
    assert all(any(w in r["words"] for w in ("vile", "rotten", "filthy")) for r in found if r["id"] and r["id"] % 5 == 1)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in out)


def test_without_labels_nothing_is_toxic(spark):
    docs, labels, _ = _table(spark, 30)
    model = toxicity.fit(docs, labels.where("false"), train=F.lit(True))
    assert toxicity.without_toxic(docs, model).count() == docs.count()
    empty = docs.where("false")
    assert toxicity.passages(empty, toxicity.fit(empty, labels, train=F.lit(True))).count() == 0


def test_repeated_passages_are_all_found():
    model = toxicity.Model({"vile": 6.0, "rotten": 5.0}, 0.5, 1.0, 0.001, 0.05, 1.0, 0.0)
    once = ["plain"] * 300 + ["vile", "rotten"]
    for copies in (1, 2, 50):
        found, n = model.passages(" ".join(once * copies + ["plain"] * 300))
        assert n == 302 * copies + 300
        assert [(a, b) for a, b, *_ in found] == [(302 * k + 300, 302 * k + 301) for k in range(copies)]
        assert {s for _, _, s, _ in found} == {10.0}
    surprises = [model.surprise(" ".join((once * k + ["plain"] * 302 * (3 - k)))) for k in (0, 1, 2, 3)]
    assert surprises[0] == 0 and surprises == sorted(set(surprises))


def test_score_by_brute_force(spark):
    """Probability of a document, from segments by definition."""
    docs, labels, _ = _table(spark)
    model = toxicity.fit(docs, labels, train=F.lit(True))
    rows = docs.select("text", toxicity.score(model, F.col("text")).alias("s")).collect()
    scored = 0
    for text, s in rows[::9] + rows[-4:]:
        words = toxicity.tokens(text)
        odds = [max((model.odds[x] for x in toxicity.stems(w) if x in model.odds), default=0.0) for w in words]
        total, times = 0.0, {}
        for a, b, gain in brute_segments([x - model.drift for x in odds]):
            e = model.rate * len(words) * math.exp(-model.decay * gain)
            if e < model.e_value:
                whole = fresh = 0.0
                for w, x in zip(words[a:b + 1], odds[a:b + 1]):
                    if x > 0:
                        times[w] = times.get(w, 0) + 1
                        whole, fresh = whole + x, fresh + x / times[w]
                total -= math.log(max(e, 1e-300)) * fresh / whole
        scored += total > 0
        assert s == pytest.approx(1 / (1 + math.exp(-(model.slope * math.log1p(total) + model.offset))), abs=1e-9)
    assert scored > 5


def test_clean_text_has_as_many_passages_as_its_limit_says(spark):
    """Mild words that clean text uses too: about 0.05 chance passages a clean document
    that the model hasn't seen."""
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    mild = ["ugly", "nasty", "dumb", "stinking"]
    docs, labels = [], []
    for i in range(3000):
        toxic = i % 5 == 1
        share = 0.12 if toxic else 0.006
        words = [rng.choice(mild) if rng.random() < share else rng.choice(plain) for _ in range(rng.randint(40, 120))]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    fold = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, train=~fold)
    found = {r["id"]: r["count"] for r in toxicity.passages(docs.where(fold), model).groupBy("id").count().collect()}
    held = [r["doc_id"] for r in docs.where(fold).select("doc_id").collect()]
    clean = [i for i in held if i % 5 != 1]
    assert sum(found.get(i, 0) for i in clean) / len(clean) < 0.1
    assert sum(i in found for i in held if i % 5 == 1) > 0.8 * (len(held) - len(clean))
