import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from quire.llm import periodic
from quire.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _brute(words):
    """Maximal stretches with their smallest period, by comparing at every lag."""
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def _random_words(rng):
    words = []
    for _ in range(rng.randrange(1, 7)):
        kind = rng.random()
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
        if kind < 0.55:
            words += (block * 9)[:rng.randrange(1, 9 * len(block))]
        elif kind < 0.7:  # a repeat of repeats
            inner = block[:2] * rng.randrange(1, 5) + block[2:]
            words += inner * rng.randrange(1, 6)
        else:
            words += [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
    return words


def test_runs_by_brute_force():
    rng = random.Random(3)
    hit = 0
    for _ in range(3000):
        words = _random_words(rng)
        found = periodic.find_runs(words)
        assert found == _brute(words), words
        hit += len(found)
    assert hit > 2000


def test_small_alphabets_by_brute_force():
    rng = random.Random(4)
    for size in (1, 2, 2, 3):
        for n in list(range(40)) + [200, 700]:
            words = [rng.choice("abc"[:size]) for _ in range(n)]
            assert periodic.find_runs(words) == _brute(words)


def test_rare_words_split_until_nothing_changes():
    codes = np.array([0, 0, 1, 0, 0, 2, 0, 0, 0, 0, 0, 0, 1, 1, 1, 9, 3, 3, 3, 3])
    # 2 and 9 are rare; then 1 is rare in every piece; 3 makes too short a piece
    assert periodic.frequent_segments(codes) == [(6, 12)]
    assert periodic.frequent_segments(np.array([-1] * 5)) == []
    assert periodic.frequent_segments(np.array([], dtype=np.int64)) == []
    assert periodic.frequent_segments(np.array([5, 7] * 4)) == [(0, 8)]


def test_long_texts_take_about_linear_work():
    words = ["x"] * 200_000 + ["a", "b", "c"] * 60_000 + [str(i % 30_000) for i in range(130_000)]
    assert periodic.find_runs(words) == [(0, 200_000, 1), (200_000, 180_000, 3), (380_000, 130_000, 30_000)]


def test_collapse_keeps_first_periods():
    words = list("aaaaaaXababababY")
    runs = periodic.find_runs(words)
    assert runs == [(0, 6, 1), (7, 8, 2)]
    assert "".join(periodic.collapse(words, runs)) == "aXabY"
    assert periodic.collapse(words, []) == words


def test_defined_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a a  A", "x"), (4, "a a  A", "x"), (None, "é é\té é é\x0bé b", "x")],
        "doc_id long, text string, runs string")
    found = {(r["id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"])
             for r in periodic.periodic_runs(docs).collect()}
    assert found == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 3, (), "a a  A"), (None, 7, ((0, 6, 1),), "é b")}
    assert periodic.periodic_runs(docs).count() == 6
    assert periodic.periodic_runs(docs.where("false")).count() == 0


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _expected(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _brute(words) if n < 3000 else periodic.find_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            _sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            _sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_brute_force(spark, tmp_dir):
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(
        [None, "", "one", "b a " * 9, "x " * 50] + ["w%d" % (k % 5) for k in range(4)] + ["p q r s t u v w x y " * 3] * 60)],
        "doc_id long, text string").selectExpr("doc_id + 100000 AS doc_id", "text")
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra) \
        .write.parquet(f"{tmp_dir}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet").collect()
    found = QUERIES["op12_periodic_runs"](spark, tmp_dir).collect()
    wanted = {_expected(r["doc_id"], r["text"]) for r in docs}
    assert {tuple(r) for r in found} == wanted and len(found) == len(docs)
    assert sum(w[1] > 0 for w in wanted) >= 5
