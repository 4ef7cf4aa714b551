import math
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from quire.llm import langid, quality
from quire.llm.common import held_out

LANGS = {"aa": ["the", "thing", "ation", "er"], "bb": ["des", "eaux", "é", "ment"], "cc": ["sch", "ung", "ü", "der"]}


def _text(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_windows_hold_every_byte():
    for n in (0, 1, 255, 256, 257, 1000):
        raw = bytes(i % 251 for i in range(n))
        rows, lengths = langid.windows(raw)
        assert lengths.sum() == n and rows.shape[1] == langid.WINDOW
        assert bytes(rows.reshape(-1)[:n].astype(np.uint8)) == raw and (rows.reshape(-1)[n:] == 256).all()


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], 1)
    for name in ("embedding", "dense"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    symbols = langid.windows(bytes(rng.integers(0, 256, 700, dtype=np.uint8)))[0]
    goal = np.eye(2)[[0, 1, 1]]

    def loss():
        out = net.pooled(symbols)[0] @ net.dense + net.dense_bias
        out = out - out.max(axis=1, keepdims=True)
        return float(-(goal * (out - np.log(np.exp(out).sum(axis=1, keepdims=True)))).sum() / len(symbols))

    grads = net.gradients(symbols, goal)
    for weight, grad in ((net.dense, grads[-2]), (net.embedding, grads[0])):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        before, step = weight[at], 1e-4
        weight[at] = before + step
        up = loss()
        weight[at] = before - step
        down = loss()
        weight[at] = before
        assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.02)


def test_tables_give_the_same_responses():
    net = langid.Network.fresh(["a", "b"], 3)
    symbols = langid.windows("some text, größer als ein Fenster ".encode() * 20)[0]
    assert np.allclose(net.pooled(symbols)[0], net.tables_pooled(symbols), atol=1e-5)


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, _text(rng, lang, rng.randint(3, 120)), lang, "s") for i in range(360) for lang in [list(LANGS)[i % 3]]]
    rows += [(1000, None, "aa", "s"), (1001, "12 34 - !", "aa", "s"), (1002, "", None, "s"), (None, _text(rng, "bb", 30), "bb", "s"),
             (1003, _text(rng, "cc", 20_000), None, "s"), (0, rows[0][1], "aa", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    fold = held_out(F.col("doc_id"), 4, 2)
    net = langid.fit(docs, train_rows=~fold)
    assert net.languages == ["aa", "bb", "cc"]
    out = docs.select("doc_id", "lang", fold.alias("h"), langid.predict(net, F.col("text")).alias("p")).collect()
    assert len(out) == len(rows) and all(0 <= r["p"]["score"] <= 1 for r in out)
    assert np.mean([r["p"]["lang"] == r["lang"] for r in out if r["h"] and r["doc_id"] < 1000]) > 0.95
    by_id = {r["doc_id"]: r["p"]["lang"] for r in out}
    assert [by_id[i] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "cc"]
    nobody = langid.fit(docs.where("false"), train_rows=~fold)
    assert {r["p"]["lang"] for r in docs.select(langid.predict(nobody, F.col("text")).alias("p")).collect()} == {"und"}


def _pages(spark, n=500):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 1
        text = _text(rng, "aa", rng.randint(20, 150))
        if bad:
            text = " ".join([_text(rng, "aa", 1)] * 80) if i % 8 == 1 else text.upper().replace(" ", "!! ")
        rows.append((i, text, f"s{i % 3}", "aa", len(text), 0.1))
        labels.append((i, int(not bad)))
    rows += [(n, None, None, None, None, 0.1), (n + 1, "", "s1", "aa", 0, 0.1), (None, "some text", None, "aa", -5, 0.1),
             (n + 2, _text(rng, "aa", 30_000), "s1", "aa", 10, 0.1), (0, rows[0][1], "s0", "aa", 3, 0.1)]
    labels += [(None, 1), (3, None), (0, 1), (n + 50, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, quality double"),
            spark.createDataFrame(labels, "doc_id long, quality int"), n)


def test_quality_of_held_out_pages(spark):
    docs, labels, n = _pages(spark)
    fold = held_out(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels, train=~fold)
    out = docs.select("doc_id", fold.alias("h"), quality.score(docs, model).alias("score")).collect()
    assert len(out) == n + 5 and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["h"] and r["doc_id"] < n]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 != 1) for r in held]) > 0.95
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] >= 0.5 for r in out)


def test_no_model_keeps_everything(spark):
    docs, labels, _ = _pages(spark, 20)
    assert quality.fit(docs, labels.where("quality = 1"), train=F.lit(True)) is None
    assert quality.good_documents(docs, None).count() == docs.count()
    empty = docs.where("false")
    assert quality.fit(empty, labels, train=F.lit(True)) is None
    assert quality.good_documents(empty, None).count() == 0


def test_pseudo_labels_help_the_other_view():
    rng = np.random.default_rng(0)

    def sample(n):
        y = rng.integers(0, 2, n)
        a = rng.normal(0, 1, (n, 20)) + 1.5 * (y[:, None] - 0.5) * (np.arange(20) < 8)
        b = rng.normal(0, 1, (n, 15)) + 1.5 * (y[:, None] - 0.5) * (np.arange(15) < 6)
        return (a, b), y.astype(float)

    (labelled, y), (pool, _), (test, t) = sample(60), sample(2000), sample(2000)
    right = [((quality.co_train(labelled, y, pool, rounds=r).probability(*test) >= 0.5) == t).mean() for r in (0, 4)]
    assert right[1] > right[0] and right[1] > 0.93


def test_gifts_come_from_the_whole_table(spark):
    """What the table pool draws: only documents that the giver is sure of and the
    taker hasn't got, equal ones once, the wanted number where there are enough."""
    docs, _, _ = _pages(spark)
    fields = quality._columns(docs, "text", "source", "lang", "n_chars")
    packed = quality._packed(docs.union(docs).select(F.lit(0).alias("label"), *fields)).select("key", "a", "b")
    pool = quality.TablePool(packed)
    rows = {r["key"]: r for r in packed.collect()}
    rng = np.random.default_rng(4)
    weights = [rng.normal(0, 3, quality._TEXT + 1), rng.normal(0, 3, quality._PAGE + 1)]
    sizes = (quality._TEXT, quality._PAGE)

    def p(giver, key):
        x = np.frombuffer(rows[key]["ab"[giver]], np.float16).astype(float)
        return 1 / (1 + np.exp(-np.clip(x @ weights[giver][:-1] + weights[giver][-1], -30, 30)))

    expected = {(g, c): {k for k in rows if (p(g, k) >= quality.SURE if c else p(g, k) <= 1 - quality.SURE)}
                for g in (0, 1) for c in (0, 1)}
    taken = [set(list(expected[1, 1])[:5]), set(list(expected[0, 1])[:5])]
    counts, picks = pool.sure(weights, taken, 0, {0: 8, 1: 8})
    assert any(len(v) > 20 for v in expected.values())
    for (giver, label), keys in picks.items():
        free = expected[giver, label] - taken[1 - giver]
        assert set(keys) <= free and len(set(keys)) == len(keys) == min(8, len(free))
        assert abs(counts[giver, label] - len(free)) <= 0.1 * len(free) + 1
    assert pool.sure(weights, taken, 0, {0: 8, 1: 8})[1] == picks
    fetched = pool.rows(set(picks[0, 1]) if (0, 1) in picks else set())
    assert all(len(a) == sizes[0] and len(b) == sizes[1] for a, b in fetched.values())


def test_views_are_separate():
    assert len(quality.page_view("s", "aa", 12)) == quality._PAGE and len(quality.text_view(None)) == quality._TEXT
    assert (quality.text_view("") == quality.text_view(None)).all()
    for chars in (None, float("nan"), -3):
        assert quality.page_view(None, None, chars)[-1] == 1
    assert np.isfinite(quality.page_view(None, None, 1e300)).all()


def test_document_score_by_hand(spark):
    docs, labels, n = _pages(spark, 120)
    model = quality.fit(docs, labels, train=F.lit(True))
    rows = docs.select("doc_id", "text", "source", "lang", "n_chars", quality.score(docs, model).alias("s")).collect()
    for r in rows:
        total = 0.0
        for x, w, (slope, offset) in ((quality.text_view(r["text"]), model.text, model.text_scale),
                                      (quality.page_view(r["source"], r["lang"], r["n_chars"]), model.page, model.page_scale)):
            odds = min(30.0, max(-30.0, float(x @ w[:-1] + w[-1])))
            total += min(8.0, max(-8.0, odds * slope + offset))
        assert r["s"] == pytest.approx(1 / (1 + math.exp(-(total * model.joint[0] + model.joint[1]))), abs=1e-9)


def test_texts_together_or_alone():
    """A text's language is the mean of its windows, whatever shares its batch."""
    rng = random.Random(5)
    net = langid.Network.fresh(["a", "b", "c"], 2)
    texts = [_text(rng, rng.choice(list(LANGS)), rng.choice([1, 5, 60, 3000])) for _ in range(150)] + [None, "", "1 2"]
    together = langid.predict_texts(net, texts)
    assert together[::-1] == langid.predict_texts(net, texts[::-1])
    for text, (lang, score) in zip(texts, together):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0.0)
            continue
        rows, lengths = langid.windows(text.encode())
        out = net.pooled(rows)[0] @ net.dense + net.dense_bias
        logs = out - np.log(np.exp(out).sum(axis=1, keepdims=True))
        mean = lengths @ logs / lengths.sum()
        q = np.exp(mean) / np.exp(mean).sum()
        assert lang == net.languages[q.argmax()] and score == pytest.approx(q.max(), abs=1e-4)


def test_training_windows_reach_the_end():
    text = "x" * 100_000 + "y" * 100_000
    made = langid._training_windows(text)
    assert len(made) == langid.FIT_WINDOWS * langid.EPOCHS and all(len(m) <= langid.WINDOW for m in made)
    assert any(b"y" in m for m in made) and any(b"x" in m for m in made)
    assert all(m == b"" or m in b"ab" for m in langid._training_windows("ab"))
