"""Benchmark decontamination by q-gram counting and banded alignment.

A document holds a benchmark item if some stretch of it is within the item's
edit budget (a share of its length) of the item; case, punctuation and white
space don't count.  By the q-gram lemma such a stretch shares at least
``n + 1 - q * (k + 1)`` q-grams with an item of n characters at k edits, all on
k + 1 neighbouring diagonals.  Shared q-grams are counted in bands of twice that
width that overlap by half; bands that reach the bound are verified by an
alignment that stays inside the band.  Short items have a smaller q, so that the
bound is positive at their full budget; those that allow no edit are searched
exactly.  No true match is lost, no other is kept.

The benchmark is the query set: it is cut into blocks of about ``BLOCK_CHARS``
characters.  Tasks build every block's q-gram index and write it into the shared
folder; blocks then go to the tasks one after the other, so that neither the
driver nor a task has more than one.  Documents stay where they are; whole texts
are read, long ones in overlapping pieces.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, record_batches, shared_table

Q = 10  # at most
BUDGET = 0.08  # edits for each character of an item
BLOCK_CHARS = 2_000_000
_PIECE = 1 << 18
_BASE = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)  # an array: products wrap around
_BITS = 20
_WORD = re.compile(r"\w+")
_SPACE = ord(" ")


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall(text.lower())) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(chars: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64) of every q-gram, put together from the
    hashes of grams whose length is a power of two."""
    n = len(chars) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total, done, part, width, factor = np.zeros(n, np.uint64), 0, chars, 1, _BASE
    while width <= q:
        if q & width:
            total = total * factor + part[done:done + n]
            done += width
        if 2 * width <= q:
            part = part[:len(part) - width] * factor + part[width:]
        factor, width = factor * factor, width * 2
    return total


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)


@dataclass
class Grams:
    """The q-grams of those items of a block that have one q in common;
    ``first[g]:first[g + 1]`` are the places of gram g."""

    q: int
    values: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    present: np.ndarray
    least: int  # fewest shared q-grams that any of the items asks for

    @classmethod
    def build(cls, q: int, numbers: list[int], items: list[tuple[int, np.ndarray, int]], least: int) -> Grams:
        hashes = [gram_hashes(items[n][1], q) for n in numbers]
        flat = np.concatenate(hashes)
        owner = np.repeat(numbers, [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        present = np.zeros(1 << _BITS, dtype=bool)
        present[_slots(values)] = True
        return cls(q, values, np.append(first, len(flat)), owner[order], place[order], present, least)

    def shared(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram) of every q-gram of the text that an item has."""
        h = gram_hashes(chars, self.q)
        at = np.flatnonzero(self.present[_slots(h)])
        gram = np.searchsorted(self.values, h[at])
        gram[gram == len(self.values)] = 0
        same = self.values[gram] == h[at]
        return at[same], gram[same]


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``count[i]`` numbers) for each i in turn."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(count.sum())


@dataclass
class Index:
    """The items of a block, and their grams by q."""

    items: list[tuple[int, np.ndarray, int]]  # item id, characters, edit budget
    grams: list[Grams]
    need: np.ndarray  # shared q-grams that an item asks for
    step: np.ndarray  # budget + 1
    whole: np.ndarray  # counts as whole words only

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int = Q, budget: float = BUDGET) -> Index:
        """``rows`` are (item id, normal text); items without a letter or digit
        are left out.  An item's q is the largest, ``q`` at most, that leaves the
        lemma's bound positive at the item's full budget."""
        items, of = [], {}
        for item_id, text in rows:
            chars = codes(text)
            if len(chars):
                k = int(budget * len(chars) + 1e-9)
                of.setdefault(min(q, len(chars) // (k + 1)), []).append(len(items))
                items.append((item_id, chars, k))
        lengths = np.array([len(c) for _, c, _ in items], dtype=np.int64)
        budgets = np.array([k for *_, k in items], dtype=np.int64)
        need = np.zeros(len(items), dtype=np.int64)
        for own, numbers in of.items():
            need[numbers] = lengths[numbers] + 1 - own * (budgets[numbers] + 1)
        grams = [Grams.build(own, numbers, items, int(need[numbers].min())) for own, numbers in sorted(of.items())]
        return cls(items, grams, need, budgets + 1, (lengths < q) & (budgets == 0))

    def _candidates(self, grams: Grams, chars: np.ndarray) -> list[tuple[int, int]]:
        """(item, first diagonal) of bands that share enough q-grams."""
        at, gram = grams.shared(chars)
        if len(at) < grams.least:
            return []
        # first without places: what each item shares at most, each gram once however often it comes
        different, which, often = np.unique(gram, return_inverse=True, return_counts=True)
        times = grams.first[different + 1] - grams.first[different]
        entry = _ranges(grams.first[different], times)
        item = grams.item[entry]
        most = np.bincount(item, weights=np.repeat(often, times), minlength=len(self.items))
        kept = (most >= self.need)[item]
        left = np.bincount(np.repeat(np.arange(len(different)), times)[kept], minlength=len(different))
        entry, begin = entry[kept], np.cumsum(left) - left
        if not len(entry):
            return []
        # then every place of the items that are left
        entry = entry[_ranges(begin[which], left[which])]
        item, diagonal = grams.item[entry], np.repeat(at, left[which]) - grams.place[entry]
        band = diagonal // self.step[item]
        low = int(band.min()) - 1
        span = int(band.max()) - low + 1
        key, count = np.unique(np.concatenate([item * span + band - low, item * span + band - 1 - low]),
                               return_counts=True)
        key = key[count >= self.need[key // span]]
        return [(int(k // span), int((k % span + low) * self.step[k // span])) for k in key]

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, budget, place in the normal text) of every item held;
        of several alignments that with the fewest edits, then the first."""
        if not self.items or not text:
            return []
        chars = codes(normal(text))
        reach = max(len(c) + 2 * (k + 1) for _, c, k in self.items)
        best: dict[int, tuple[int, int]] = {}
        for start in range(0, max(1, len(chars)), _PIECE):
            piece = chars[start:start + _PIECE + reach]
            for item, diagonal in (c for g in self.grams for c in self._candidates(g, piece)):
                _, wanted, k = self.items[item]
                if self.whole[item]:
                    found = (0, start + diagonal) if _as_words(wanted, chars, start + diagonal) else (k + 1, 0)
                else:
                    edits, place = banded_alignment(wanted, piece, diagonal, 2 * (k + 1), k)
                    found = (edits, start + place)
                if found[0] <= k:
                    best[item] = min(best.get(item, found), found)
        return [(self.items[i][0], edits, self.items[i][2], place) for i, (edits, place) in sorted(best.items())]


def _as_words(item: np.ndarray, text: np.ndarray, place: int) -> bool:
    """Whether the item stands at a place of the text, between spaces or the text's ends."""
    end = place + len(item)
    return (place >= 0 and end <= len(text) and bool((text[place:end] == item).all())
            and (place == 0 or text[place - 1] == _SPACE) and (end == len(text) or text[end] == _SPACE))


def banded_alignment(item: np.ndarray, text: np.ndarray, diagonal: int, width: int, most: int) -> tuple[int, int]:
    """Fewest edits between the whole item and a stretch of the text, on the
    diagonals ``diagonal .. diagonal + width - 1``, and about where it begins;
    more than ``most`` edits are given as ``most + 1``."""
    n = len(item)
    # text under row i and diagonal b is text[diagonal + i + b]; outside it nothing matches
    inside = np.arange(diagonal, diagonal + n + width)
    ok = (inside >= 0) & (inside < len(text))
    shown = np.full(n + width, np.uint64(0xFFFFFFFF))
    shown[ok] = text[inside[ok]]
    steps = np.arange(width)
    edits = np.zeros(width, dtype=np.int64)
    for i in range(n):
        here = edits + (shown[i:i + width] != item[i])
        here[:-1] = np.minimum(here[:-1], edits[1:] + 1)  # a character of the item is missing
        edits = np.minimum.accumulate(here - steps) + steps  # characters of the text are extra
        if edits.min() > most:
            return most + 1, 0
    return int(edits.min()), max(0, diagonal + int(edits.argmin()))


@dataclass(frozen=True)
class Blocks:
    """Indexes over all items of a benchmark, in the shared folder: one row
    ``(block, index)`` for each block."""

    table: DataFrame
    count: int

    def load(self, block: int) -> Index:
        row = self.table.where(F.col("block") == block).select("index").first()  # about block_chars characters
        return pickle.loads(row[0]) if row else Index.build([])


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", q: int = Q,
           budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> Blocks:
    """Indexes over all items, each built in a task (null ids and texts are no
    items, repeated rows are one)."""
    items = shared_table(benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
                         .select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).distinct())
    count = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        found = sorted((int(i), normal(t)) for i, t in zip(rows["id"], rows["text"]))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "index": [pickle.dumps(Index.build(found, q, budget))]})

    numbered = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    return Blocks(shared_table(numbered.groupBy("block").applyInPandas(build, "block long, index binary")), count)


def _by_block(docs: DataFrame, indexes: Blocks, find: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """``find`` for each block in turn: only one index is with the tasks at a time."""
    context = docs.sparkSession.sparkContext
    result = None
    for block in range(indexes.count):
        index = context.broadcast(indexes.load(block))
        found = find(index)
        if indexes.count > 1:
            found = shared_table(found)
            index.destroy()
        result = found if result is None else result.union(found)
    return result


def leaks(docs: DataFrame, indexes: Blocks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item, edits, budget, place)``: each item that each row of ``docs``
    holds, with its best alignment (fewest edits, then first place).  Null and
    empty texts hold none; repeated rows each come out; a null id stays null;
    other columns aren't read.  Items of fewer than ``q`` characters, which allow
    no edit, count where they stand as whole words; all others wherever they occur."""
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("edits", pa.int32()), ("budget", pa.int32()),
                        ("place", pa.int64())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def found(shared: Broadcast) -> DataFrame:
        def run(batches):
            return record_batches(((i, *m) for i, t in batch_rows(batches) for m in shared.value.matches(t)), schema)

        return rows.mapInArrow(run, "id long, item long, edits int, budget int, place long")

    return _by_block(docs, indexes, found)


def _holds_item(index: Broadcast, text: Column) -> Column:
    """Whether a text holds an item of the block."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(index.value.matches(t)) for t in texts], dtype="bool")

    return run(text)


def clean_documents(docs: DataFrame, indexes: Blocks, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns;
    repeated rows and rows with null or empty texts stay.  With several blocks
    the digests of texts that hold an item are gathered block by block."""
    text = F.col(text_col)
    if indexes.count == 1:
        index = docs.sparkSession.sparkContext.broadcast(indexes.load(0))
        return docs.where(~_holds_item(index, text))
    digest = F.sha2(text, 256)
    held = _by_block(docs, indexes, lambda index: docs.where(_holds_item(index, text)).select(
        digest.alias("_quire_digest"))).distinct()
    return docs.join(held, digest == F.col("_quire_digest"), "left_anti")
