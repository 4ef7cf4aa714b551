import random

import numpy as np

from quire.llm import decontaminate as dec


def edits_in(item, text):
    """Fewest edits between the item and any stretch of the text (plain recurrence)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def _words(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "th", "on", "é", "st"]) for _ in range(rng.randint(1, 3)))
                    for _ in range(n))


def _edited(rng, text, k):
    for _ in range(k):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1:], text[:at] + rng.choice("abc") + text[at:],
                           text[:at] + rng.choice("abc") + text[at + 1:]])
    return text


def test_gram_hashes_tell_grams_apart():
    chars = dec.codes("hello world, hello worlds again and again")
    for q in (1, 2, 3, 7, 8, 10, 13):
        h = dec.gram_hashes(chars, q)
        grams = [tuple(chars[i:i + q]) for i in range(len(chars) - q + 1)]
        assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams))
    assert len(dec.gram_hashes(chars[:4], 10)) == 0


def test_matches_are_those_of_brute_force():
    rng = random.Random(11)
    items = [(i, dec.normal(_words(rng, n))) for i, n in enumerate([14, 20, 30, 45, 6])]
    index = dec.Index.build(items, q=6, budget=0.1)
    for trial in range(60):
        parts = [_words(rng, rng.randint(0, 40)), _words(rng, rng.randint(0, 20))]
        item = rng.choice(items)[1]
        held = _edited(rng, item, rng.randint(0, max(1, len(item) // 8)))
        text = f"{parts[0]} {held} {parts[1]}"
        found = {i: e for i, e, *_ in index.matches(text)}
        for (i, wanted), (_, _, k) in zip(items, index.items):
            best = edits_in(wanted, dec.normal(text))
            assert found.get(i) == (best if best <= k else None), (trial, i, best, k)


def test_items_of_every_length_at_the_full_budget():
    rng = random.Random(23)
    for n in range(1, 61):
        item = dec.normal(_words(rng, 40))[:n].strip()
        index = dec.Index.build([(n, item)])
        (_, _, k), = index.items
        assert k == len(item) * 8 // 100
        for edits in {0, max(0, k - 1), k, k + 1, k + 2}:
            for _ in range(6):
                held = _edited(rng, item, edits) if len(item) > edits else item
                text = dec.normal(f"{_words(rng, rng.randint(0, 6))} {held} {_words(rng, rng.randint(0, 6))}")
                best = edits_in(item, text)
                wanted = f" {item} " in f" {text} " if len(item) < dec.Q else best <= k
                assert [(i, e) for i, e, *_ in index.matches(text)] == ([(n, best)] if wanted else []), (n, edits)


def test_short_items_count_as_whole_words():
    index = dec.Index.build([(1, "what is x"), (2, "aa"), (3, "é")])
    assert [m[0] for m in index.matches("So: WHAT is x?")] == [1]
    assert index.matches("somewhat is xy, aaa aaaa") == []
    assert [(m[0], m[3]) for m in index.matches("aaa aa é")] == [(2, 4), (3, 7)]


def test_grams_common_to_many_items(monkeypatch):
    rng = random.Random(8)
    common = dec.normal(_words(rng, 12))
    items = [(i, dec.normal(f"{common} {_words(rng, 14)}")) for i in range(60)]
    index = dec.Index.build(items)
    assert index.matches(f"{common} " * 20) == []
    assert [(i, e) for i, e, *_ in index.matches(f"{common} " * 5 + items[7][1] + " end")] == [(7, 0)]


def test_long_text_is_read_in_pieces(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(dec, "_PIECE", 500)
    item = dec.normal(_words(rng, 30))
    index = dec.Index.build([(7, item)])
    filler = "zyx " * 1000
    for cut in range(0, 600, 37):
        text = filler[:cut * 4] + " " + item.upper().replace(" ", ", ") + "! " + filler
        assert [(i, e) for i, e, *_ in index.matches(text)] == [(7, 0)]


def test_alignment_stays_in_its_band():
    a, b = dec.codes("abcdefgh"), dec.codes("xxabcdfghyy")
    assert dec.banded_alignment(a, b, 1, 4, 3)[0] == 1
    assert dec.banded_alignment(a, b, 6, 2, 3)[0] == 4  # most + 1
    assert dec.banded_alignment(a, dec.codes(""), 0, 2, 3)[0] == 4
    assert isinstance(dec.codes("é"), np.ndarray)


def test_documents_of_all_kinds(spark):
    rng = random.Random(5)
    item = _words(rng, 30)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item), (3, "shortest"), (4, ""), (5, "?!")],
                                  "item_id long, text string")
    rows = [(1, item, 1), (2, _words(rng, 60), 2), (3, None, 3), (4, "", 4), (5, "pre " + item.upper() + " post", 5),
            (5, "pre " + item.upper() + " post", 5), (None, item, 6), (7, _words(rng, 20_000) + item, 7),
            (8, "the SHORTEST one", 8), (9, "theshortest one", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    for size in (100, 2_000_000):
        indexes = dec.blocks(bench, block_chars=size)
        found = sorted((str(r["id"]), r["item"], r["edits"]) for r in dec.leaks(docs, indexes).collect())
        assert found == [("1", 1, 0), ("5", 1, 0), ("5", 1, 0), ("7", 1, 0), ("8", 3, 0), ("None", 1, 0)]
        clean = dec.clean_documents(docs, indexes)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 9]
    none = dec.blocks(bench.where("false"))
    assert dec.leaks(docs, none).count() == 0 and dec.clean_documents(docs, none).count() == len(rows)
    assert dec.leaks(docs.where("false"), dec.blocks(bench)).count() == 0
