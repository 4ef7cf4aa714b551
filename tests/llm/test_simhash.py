import random

import xxhash

from quire.llm import simhash
from quire.operators.graph import connected_components


def brute_components(values, linked):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_majority_of_the_hashes():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 40, 400):
        text = " ".join(rng.choice("ab CD é ff\tg".split(" ")) for _ in range(n))
        assert simhash.fingerprint(text.encode().lower().split()) == brute_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three é') AS h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("one two three é".encode(), 42)


def _clustered(rng, clusters, size):
    out = set()
    for _ in range(clusters):
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            base = x if rng.random() < 0.3 else base
    return [simhash._signed(v) for v in out]


def test_links_connect_what_brute_force_connects(spark):
    values = _clustered(random.Random(7), 12, 25)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    wanted = brute_components(values, lambda a, b: bin((a ^ b) % (1 << 64)).count("1") <= 2)
    for limit in (128, 3):  # 3: nearly every bucket takes the two-wildcard way
        edges = simhash.links(table, 2, bucket_pairs=limit)
        for r in edges.collect():
            assert bin((r["a"] ^ r["b"]) % (1 << 64)).count("1") <= 2
        found = {r["v"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
        assert {v: found.get(v, v) for v in values} == wanted


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)],
                                  "a long, b long")
    found = {r["v"]: r["root"] for r in connected_components(edges, "a", "b").collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_rows_of_all_kinds(spark):
    long = "w1 w2 w3 " * 5000
    rows = [(5, "a b c d", 1), (3, "A b C\td", 1), (9, None, 1), (8, "", 1), (8, "", 1), (None, "a b c d", 1),
            (None, "x y z", 1), (12, long, 1), (11, long + " ", 1), (20, "q r", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by_id = {r["id"]: r["component"] for r in found if r["id"] is not None}
    assert by_id == {5: 3, 3: 3, 9: 8, 8: 8, 12: 11, 11: 11, 20: 20}
    assert sorted(str(r["component"]) for r in found if r["id"] is None) == ["3", "None"]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["fp"]) for r in kept.collect()) == [(-1, 1), (3, 1), (8, 1), (11, 1), (20, 2)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0
