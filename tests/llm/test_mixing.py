import random

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing


def water_filled(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = min(share, cap) * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            return {**out, **{s: level * w[s] for s in free}}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def _docs(spark, n=400, seed=3):
    rng = random.Random(seed)
    names = ["hot"] * 6 + ["b", "Z", "é", "a", None, "none-left"]
    rows = [(i, rng.choice(names), rng.choice([0, 1, 5, 80, 300])) for i in range(n)]
    return spark.createDataFrame([(i, s, " ".join(["w"] * k) if k else (None if i % 2 else " \t"), k) for i, s, k in rows],
                                 "doc_id long, source string, text string, mix int")


def test_targets_by_brute_force(spark):
    rng = random.Random(5)
    for _ in range(3):
        sizes = {**{f"s{i}": rng.choice([0, 3, 50, 1000, 20_000]) for i in range(9)}, None: 70}
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
        assert found == pytest.approx(water_filled(sizes))


def test_quotas_split_exactly_and_evenly(spark):
    quotas = {"a": 1000, "b": 10, "c": 0, "d": 333}
    table = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = mixing.split_quotas(table, shards=6, seed=1).collect()
    assert rows == mixing.split_quotas(table, shards=6, seed=1).collect() or \
        sorted(map(tuple, rows)) == sorted(map(tuple, mixing.split_quotas(table, shards=6, seed=1).collect()))
    for s, q in quotas.items():
        own = sorted((r["shard"], r["start"], r["copies"]) for r in rows if r["source"] == s)
        assert sum(c for *_, c in own) == q and len(own) == 6
        at = 0
        for _, start, c in own:
            assert start == at
            at += c
    total = [sum(r["copies"] for r in rows if r["shard"] == k) for k in range(6)]
    assert max(total) - min(total) <= 2
    a = [r["copies"] for r in rows if r["source"] == "a"]
    assert max(a) - min(a) < 60  # a draw without replacement stays near its share


def test_words_taken(spark):
    docs = _docs(spark)
    out = mixing.mix(docs, shards=4, blocks=32)
    assert out.columns == ["doc_id", "source", "text", "mix"]
    rows = out.select("doc_id", "source", "mix.*").collect()
    assert len(rows) == 400
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["mix"]
    wanted = water_filled(sizes)
    for s, t in wanted.items():
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {sizes[s]}
        assert own[0]["target"] == pytest.approx(t)
        assert abs(sum(r["taken"] for r in own) - t) <= 300
    assert all(r["taken"] == r["size"] * len(r["copies"]) and r["taken"] <= 2 * r["size"] for r in rows)
    again = mixing.mix(docs.repartition(7), shards=4, blocks=32).select("doc_id", "mix.taken", "mix.copies").collect()
    assert sorted((r["doc_id"], r["taken"], str(r["copies"])) for r in again) == \
        sorted((r["doc_id"], r["taken"], str(r["copies"])) for r in rows)
    each = mixing.shard_rows(out)
    assert each.count() == sum(len(r["copies"]) for r in rows)
    blocks = each.groupBy("mix_shard").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(blocks) == 4


def test_repeated_rows_and_empty_table(spark):
    twice = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, None, None)], "doc_id long, text string, source string")
    rows = mixing.mix(twice).select("mix.*").collect()
    assert len(rows) == 4 and sum(r["taken"] for r in rows) in (8, 10)
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    wordless = spark.createDataFrame([(1, "", "s"), (2, None, "t")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(wordless).select("mix.taken").collect()] == [0, 0]


def test_null_ids_and_block_sizes(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(None, " ".join(f"w{rng.random()}" for _ in range(5)), "s") for _ in range(300)]
                                 + [(i, "a b c", "t") for i in range(300)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, blocks=2, block_rows=20).select("source", "mix.*").collect()
    assert len(rows) == 600
    for s, target in water_filled({"s": 1500, "t": 900}).items():
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(target) and abs(sum(r["taken"] for r in own) - target) <= 5
        assert len({c["shard"] for r in own for c in r["copies"]}) > 8
    window = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in window  # texts meet their block's row, and are in no window
