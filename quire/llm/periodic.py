"""Periodic runs of words: recursive frequency splitting and a lag scan.

A run is a maximal stretch of words whose smallest period q repeats at least
``repeats`` times (and that has at least ``shortest`` words).  Every word of a
run occurs ``repeats`` times in it or more, so a word that occurs less often
within a segment is in no run of that segment and splits it.  The pieces are
counted anew, until no segment changes.

A surviving segment is scanned for each lag q at every q-th word only: a run
of period q makes a row of equal pairs there.  Rows that a run of a divisor of q
explains are passed over; around the others the words are compared one by one.
That takes about n log n comparisons for n words, also where one word or phrase
is repeated throughout.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, record_batches

REPEATS = 4  # least length of a run, in periods
SHORTEST = 6  # least length of a run, in words

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def frequent_segments(codes: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Segments ``[start, stop)`` in which every word occurs ``repeats`` times
    or more.  ``codes`` numbers the words; a negative code splits."""
    done: list[tuple[int, int]] = []
    width = int(codes.max(initial=-1)) + 1
    place = np.flatnonzero(codes >= 0)
    while len(place):
        # words in a row make a segment (two segments never touch)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place) != 1) + 1])
        length = np.diff(np.append(first, len(place)))
        enough = length >= shortest
        place, length = place[np.repeat(enough, length)], length[enough]
        if not len(place):
            break
        owner = np.repeat(np.arange(len(length)), length)
        _, which, count = np.unique(owner * width + codes[place], return_inverse=True, return_counts=True)
        common = count[which] >= repeats
        changed = np.bincount(owner, weights=~common, minlength=len(length)) > 0
        stop = np.cumsum(length)
        done += [(int(place[e - n]), int(place[e - 1]) + 1) for e, n in zip(stop[~changed], length[~changed])]
        place = place[common & changed[owner]]
    return sorted(done)


def _stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches ``[i, j)`` of true flags with at least ``least`` of them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(i), int(j)) for i, j in zip(edge[::2], edge[1::2]) if j - i >= least]


def lag_scan(w: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a segment of word numbers."""
    m, found, active = len(w), [], []
    for q in range(1, m // repeats + 1):
        least = max(shortest, repeats * q) - q  # equal pairs of a run
        equal = w[0:m - q:q] == w[q::q]
        need = max(1, least // q)
        if np.count_nonzero(equal) < need:
            continue
        active = [run for run in active if run[1] > q]
        for start, length, period in active:
            if q % period == 0:
                equal[-(-start // q):(start + length - 1) // q] = False
        for i, j in _stretches(equal, need):
            low, high = max(0, (i - 1) * q + 1), min(m - q, j * q)
            for a, b in _stretches(w[low:high] == w[low + q:high + q], least):
                a, b = a + low, b + low
                if (a and w[a - 1] == w[a - 1 + q]) or (b < m - q and w[b] == w[b + q]):
                    continue  # goes on into what a shorter period explains
                found.append((a, b - a + q, q))
                active.append(found[-1])
    return found


def find_runs(words: list, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a list of words, by start, then period."""
    if len(words) < max(shortest, repeats):
        return []
    often = [w for w, n in Counter(words).items() if n >= repeats]
    if not often:
        return []
    number = dict(zip(often, range(len(often))))
    codes = np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    runs = []
    for start, stop in frequent_segments(codes, repeats, shortest):
        runs += [(start + a, n, q) for a, n, q in lag_scan(codes[start:stop], repeats, shortest)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS,
                  shortest: int = SHORTEST) -> DataFrame:
    """``(id, n_words, runs, collapsed)`` for every row of ``docs``.

    ``runs`` holds ``(start, length, period)`` by start, then period, counted in
    words (separated by ASCII white space, upper and lower case differ);
    ``collapsed`` is the text with every run cut to its first period, words
    joined by one space.  Null and empty texts have no words, no runs and an
    empty ``collapsed``; null and repeated ids are rows like others, and extra
    columns are ignored.  A text is scanned whole, in one task.
    """
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)),
                        ("collapsed", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, text in batch_rows(batches):
            words = text.split() if text else []
            runs = find_runs(words, repeats, shortest)
            yield (key, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs],
                   b" ".join(collapse(words, runs)).decode("utf-8", "replace"))

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(lambda batches: record_batches(rows(batches), schema, 256),
                             f"id long, n_words long, runs {_RUN_DDL}, collapsed string")
