import math
import os
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quire.llm import queries
from quire.llm.common import read

SF = "/root/testdata/sf0.001"


def _words(text):
    return (text or "").encode().lower().split()


def _normal(text):
    return " ".join(re.findall(r"\w+", (text or "").lower()))


def _stages(spark, docs):
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        kept.append(spark.createDataFrame(out.toArrow()))
    return kept


def _brute_groups(rows):
    """Smallest id of each document's SimHash group, by all pairs."""
    def fp(text):
        w = _words(text)
        shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t in rows}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if group[a] > group[b] and bin(fps[a] ^ fps[b]).count("1") <= 2:
                    group[a], changed = group[b], True
    return group


def test_stages_in_order_against_brute_force(spark):
    start = read(spark, SF, "documents")
    a = _stages(spark, start)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixing"]
    for before, after in zip(a[:-2], a[1:-1]):
        assert after.columns == start.columns
        assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
    labels = {r["doc_id"]: r for r in read(spark, SF, "labels").collect()}
    kept = [{r["doc_id"]: r["text"] for r in x.collect()} for x in a]
    clean = [i for i, r in labels.items() if r["toxic"] == 0 and i in kept[0]]
    assert sum(i in kept[1] for i in clean) >= 0.95 * len(clean)
    good = [i for i, r in labels.items() if r["quality"] == 1 and i in kept[1]]
    assert sum(i in kept[2] for i in good) >= 0.95 * len(good)
    group = _brute_groups(list(kept[2].items()))
    assert sorted(kept[3]) == sorted(set(group.values()))
    items = [_normal(r["text"]) for r in read(spark, SF, "benchmark").collect()]
    held = {i for i, t in kept[3].items() if any(x in _normal(t) for x in items)}
    assert held.isdisjoint(kept[4]) and len(kept[4]) >= 0.98 * (len(kept[3]) - len(held))
    mixed = a[5].collect()
    assert len({r["doc_id"] for r in mixed}) == len(mixed)
    for r in mixed:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", kept[4][r["doc_id"]] or ""))
        assert (r["size"], r["taken"]) == (n, n * len(r["shards"])) and 1 <= len(r["shards"]) <= 2
    total = sum(len(_words(t)) for t in kept[4].values())
    assert abs(sum(r["taken"] for r in mixed) - 1.5 * total) < 0.05 * total


def test_odd_rows_and_columns_pass_through(spark):
    base = read(spark, SF, "documents").limit(30)
    rows = [(None, None, None, None, None), (1_000_001, "", "en", None, -1), (1_000_002, "word " * 30_000, None, "src1", None),
            (1_000_003, None, "en", "new", 5), (1_000_003, None, "en", "new", 5)]
    docs = base.unionByName(spark.createDataFrame(rows, base.schema))
    for c in ("score", "size", "mix", "id", "fp", "label"):
        docs = docs.withColumn(c, F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert {r["mix"] for r in out.collect()} <= {"mine"}
    last = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert {"doc_id", "text", "taken", "shards", "label"} <= set(last.columns)
    assert all(r["taken"] <= 2 * r["size"] for r in last.collect())


def test_empty_documents(spark):
    none = read(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_all_are_registered():
    found = entry.queries()
    assert "pipeline" in found and set(queries.QUERIES) <= set(found)
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_by_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{os.path.join(SF, table)}.parquet')")
    wanted = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)

    def plain(rows):
        return sorted(([None if isinstance(v, float) and math.isnan(v) else v for v in r] for r in rows), key=str)

    assert plain(found.select(*columns).collect()) == plain(wanted.fetchall())
