"""The replaceable calls: token counts, answers kept by prompt, term vectors."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.operators import answers, tokens, udfs
from quire.plans.q_models import RANKS
from tests.conftest import rows


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_token_counts_agree_with_whole_texts(spark):
    import base64

    import tiktoken
    texts = ["Hello  world, it's\n\n  fine 123 \t", None, "", " ", "été naïve — 日本語 😀", "a" * 300 + " a" * 50, "x  y", "Hello  world, it's"]
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    whole = tiktoken.Encoding("whole", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, " again", "x"), (None, "two words", "x")],
                               "k long, body string, piece string")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(df, RANKS, "k", "body").collect()}
    want = {i: len(whole.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    want[0] += len(whole.encode_ordinary(" again"))
    assert got == {**want, None: len(whole.encode_ordinary("two words"))}
    assert tokens.token_counts(df.where("false"), RANKS, "k", "body").count() == 0


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_pieces_are_counted_without_a_sort(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(tokens, "shared_table", lambda df: kept.append(df) or df)
    df = spark.createDataFrame([(1, "one two one"), (2, "two " + "x" * 70), (3, None), (1, " one")], "id long, text string")
    assert rows(tokens.token_counts(df, RANKS, "id"), "id") == [(1,), (2,), (3,)]
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan and plan.count("Exchange") == 1
    assert sorted((len(k), w) for k, w in kept[0].select("key", "w").collect()) == [(3, 1), (3, 1), (4, 1), (4, 2), (128, 1)]


def test_answers_are_asked_once(spark, tmp_dir):
    log, store = os.path.join(tmp_dir, "asked"), os.path.join(tmp_dir, "answers")
    os.makedirs(log)

    def model(prompts):
        for p in prompts:
            if p == "bad":
                raise ValueError("no answer")
            with open(os.path.join(log, p), "a") as f:
                f.write("1")
        return [p.upper() for p in prompts]

    asked = lambda: {p: os.path.getsize(os.path.join(log, p)) for p in os.listdir(log)}
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(["a", "b", "a", None, "a", "b"])], "k long, prompt string, digest string")
    got = rows(answers.answer_once(df, model, store), "k", "prompt", "answer", "error", "digest")
    assert got == [(i, p, p and p.upper(), None, "x") for i, p in enumerate(["a", "b", "a", None, "a", "b"])]
    assert asked() == {"a": 1, "b": 1}
    more = df.select("k", "prompt").unionByName(spark.createDataFrame([(9, "c"), (10, "bad")], "k long, prompt string"))
    again = {r["k"]: (r["answer"], r["error"]) for r in answers.answer_once(more, model, store).collect()}
    assert again[0] == ("A", None) and again[9] == ("C", None) and again[10] == (None, "no answer")
    seen = asked()
    assert (seen["a"], seen["b"]) == (1, 1)
    assert answers.answer_once(more.where("false"), model, store).count() == 0 and asked() == seen
    assert answers.kept_answers(spark, store).where("error IS NULL").count() == 3


def test_term_vectors_by_hand(spark):
    texts = {1: "a b B", 2: "b c", 3: "c c d_1", 4: "", 5: None, 6: "a b b"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: r["embedding"] for r in udfs.embed(df, "text", num_features=16).collect()}
    import hashlib
    slot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16
    counts = {i: Counter(slot(w) for w in re.findall(r"\w+", (t or "").lower())) for i, t in texts.items()}
    held = Counter(s for c in counts.values() for s in c)
    for i, c in counts.items():
        x = [c[s] * math.log(7 / (held[s] + 1)) if s in c else 0.0 for s in range(16)]
        length = math.sqrt(sum(v * v for v in x)) or 1.0
        assert len(got[i]) == 16 and all(abs(a - b / length) < 1e-6 for a, b in zip(got[i], x)), i
    assert got[1] == got[6] and not any(got[4])
    assert udfs.embed(df.where("false"), "text").count() == 0


def test_selection_by_rank_is_exact(spark):
    from quire.plans.product import product
    from quire.plans.select import by_rank
    ids = spark.range(3000).select(F.col("id").alias("k"))
    groups = spark.createDataFrame([("g",), ("h",), ("i",)], "grp string")
    pairs = product(ids, groups, "k")
    assert pairs.count() == 9000 and pairs.distinct().count() == 9000
    assert product(ids, groups.where("false"), "k").count() == 0
    # hashes that collide in their first digits put a boundary inside a bucket
    keyed = pairs.withColumn("key", F.when(F.col("grp") == "h", F.concat(F.lit("00000"), F.md5(F.col("k").cast("string"))))
                             .otherwise(F.md5(F.concat("grp", F.col("k").cast("string")))))
    bounds = spark.createDataFrame([("g", "x", 0, 10), ("g", "y", 10, 1999), ("h", "x", 5, 700), ("h", "y", 700, 701), ("i", "x", 2990, 5000)],
                                   "grp string, what string, above long, upto long")
    got = {(r["grp"], r["k"]): r["what"] for r in by_rank(keyed, bounds, "grp", "k", "key", "what").collect()}
    want = {}
    for g in "ghi":
        order = [r["k"] for r in keyed.where(F.col("grp") == g).orderBy("key", "k").collect()]
        for b in bounds.where(F.col("grp") == g).collect():
            want.update({(g, k): b["what"] for k in order[b["above"]:b["upto"]]})
    assert got == want
    plan = by_rank(keyed, bounds, "grp", "k", "key", "what")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_term_slots_are_counted_in_one_shuffle(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(udfs, "shared_table", lambda df: kept.append(df) or df)
    df = spark.createDataFrame([(1, "a b a"), (1, "B"), (2, None), (3, "c")], "id long, text string")
    assert rows(udfs.term_vectors(df, "id", "text", 16), "id") == [(1,), (3,)]
    assert {n for i, n in kept[0].groupBy("id").sum("n").collect()} == {4, 1}
    plan = kept[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortAggregate" not in plan
