import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from quire.llm import lattice

PIECES = {b"a": 0.2, b"b": 0.3, b"ab": 0.15, b"aba": 0.1, b"bb": 0.25}


def enumerated(text):
    if not text:
        return 1.0
    return sum(p * enumerated(text[len(k):]) for k, p in PIECES.items() if text.startswith(k))


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=10))
def test_marginal_is_the_sum_over_all_segmentations(text):
    model = lattice.Lattice({k: math.log(p) for k, p in PIECES.items()})
    assert model.log_probability(text.encode()) == pytest.approx(math.log(enumerated(text.encode())))


def test_unreachable_text():
    assert lattice.Lattice({b"a": -1.0}).log_probability(b"ax") == -math.inf


def test_word_model_sums_to_one_over_known_mass():
    scores, word_end = lattice.piece_scores({1: 5, 2: 3}, {1: b"a", 2: b"b"}, 2)
    assert math.exp(word_end) + sum(map(math.exp, scores.values())) == pytest.approx(1)
    model = lattice.WordModel(scores, word_end, kinds=2, tokens=9, once=1, twice=0)
    counts = {"a": 5, "b": 3}
    less = 2 / 3
    freed = (less * 2 + 1) / 11
    for w, c in counts.items():
        spelled = math.exp(word_end + lattice.Lattice(scores).log_probability("▁".encode() + w.encode())) \
            if "▁".encode() in scores else 0.0
        assert 10 ** model.log10(w.encode(), c) == pytest.approx((c - less) / 11 + freed * spelled)
    assert 10 ** model.end_log10(1) == pytest.approx(2 / 11)


def _docs(spark):
    rows = [(1, "The cat  sat"), (2, "the dog\tsat sat"), (3, None), (4, ""), (5, "unseen zebra é " * 200),
            (6, "the cat"), (6, "the cat"), (None, "a dog"), (7, "x" * 50_000)]
    return spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")


def test_base_scores_and_both_ways_of_looking_words_up(spark):
    docs = _docs(spark)
    train = F.coalesce(F.col("doc_id"), F.lit(0)) != 5
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    c = Counter()
    for i, t in rows:
        if i != 5:
            c.update((t or "").encode().lower().split() + [None])
    n, v = sum(c.values()), len(c)
    wanted = sorted((str(i), len(w), sum(c[x] > 0 for x in w),
                     round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))
                    for i, t in rows for w in [(t or "").encode().lower().split() + [None]])
    results = []
    for frequent in (1, 1 << 20):  # all words joined; all but single ones in the table
        out = lattice.score_documents(docs, train=train, frequent=frequent).collect()
        assert {r["train_tokens"] for r in out} == {n}
        assert sorted((str(r["id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == wanted
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
        results.append(sorted((str(r["id"]), round(r["score"], 6), r["trained"]) for r in out))
    assert results[0] == results[1]


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.score_documents(docs).count() == 0
    one = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = lattice.score_documents(one, train=F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)
    assert math.isfinite(r["score"]) and r["score"] < 0
