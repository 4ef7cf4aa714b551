"""Document quality by co-training two views.

The text view sees what is written: hashed pairs of neighbouring letters, how
much words repeat, and the form of the lines.  The page view sees what is known
about the page without its text: source, language and length.  Each view has a
logistic classifier, fitted on labelled documents.  Over a few rounds both score
the whole unlabelled table, and each gives documents that it is sure of, with its
labels, to the other's training set.  The views are then calibrated on labelled
documents that neither has learned from, and their calibrated odds are combined
and calibrated once more.  All documents are scored in whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_sample, hash_fraction, shared_table

FIT_DOCUMENTS = 3_000  # labelled documents of each class that a fit may use
ROUNDS = 4
# Pseudo-labels of the larger class that a view gives away in a round: different
# documents, drawn from all that it is sure of, whatever the table's size.
GIVEN = 300
SURE = 0.95
_PAIRS, _SOURCES, _LANGS, _SIZES = 256, 64, 16, 24
_TEXT, _PAGE = _PAIRS + 11, _SOURCES + _LANGS + _SIZES + 2
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_PAIR_BUCKET = ((np.arange(256)[:, None] * 40503 + np.arange(256)[None] * 2654435) >> 5) % _PAIRS


def text_view(text: str | None) -> np.ndarray:
    """Letter pairs (root of their share), word repetition, lines and kinds of characters."""
    out = np.zeros(_TEXT)
    text = text or ""
    whole = text.encode()
    raw = text.lower().encode()
    codes = np.frombuffer(raw, dtype=np.uint8)
    both = _LETTER[codes[:-1]] & _LETTER[codes[1:]] if len(codes) > 1 else np.zeros(0, bool)
    if both.any():
        pairs = np.bincount(_PAIR_BUCKET[codes[:-1][both], codes[1:][both]], minlength=_PAIRS)
        out[:_PAIRS] = np.sqrt(pairs / pairs.sum())
    words = raw.split()
    if words:
        different = set(words)
        out[_PAIRS:_PAIRS + 4] = (
            len(different) / len(words), math.log1p(len(words) / len(different)),
            sum(map(len, words)) / len(words) / 10, sum(a == b for a, b in zip(words, words[1:])) / len(words))
    kinds = np.bincount(np.frombuffer(whole, dtype=np.uint8), minlength=256) / max(1, len(whole))
    lines = text.count("\n") + 1
    out[_PAIRS + 4:] = (
        math.log1p(lines) / 5, math.log1p(len(whole) / lines) / 10, kinds[65:91].sum(), kinds[48:58].sum(),
        kinds[[33, 63]].sum(), kinds[[35, 36, 37, 38, 42, 124]].sum(), kinds[[9, 10, 13, 32]].sum())
    return out


def page_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Metadata only: source and language by hash, length as a number and as a power of two."""
    out = np.zeros(_PAGE)
    if source is not None:
        out[zlib.crc32(str(source).encode()) % _SOURCES] = 1
    if lang is not None:
        out[_SOURCES + zlib.crc32(str(lang).encode()) % _LANGS] = 1
    if n_chars is None or n_chars != n_chars or n_chars < 0:
        out[-1] = 1
    else:
        size = math.log2(1 + min(float(n_chars), 1e18))
        out[_SOURCES + _LANGS + min(_SIZES - 1, int(size))] = 1
        out[-2] = size / 15
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 12) -> np.ndarray:
    """Weights (the last one the offset) by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * w
        penalty[-1] = 1e-3 * w[-1]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + penalty)
        w -= step * min(1.0, 10.0 / max(1e-9, np.abs(step).max()))
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def calibration(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that turn a view's odds into calibrated ones."""
    yes, no = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    return logistic(odds[:, None] / 5, soft, ridge=1e-2) / np.array([5.0, 1.0])


@dataclass(frozen=True)
class Model:
    text: np.ndarray
    page: np.ndarray
    text_scale: np.ndarray
    page_scale: np.ndarray
    joint: np.ndarray

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of the calibrated odds of both views, bounded each."""
        return sum(np.clip(_odds(x, w) * s[0] + s[1], -8, 8)
                   for x, w, s in ((a, self.text, self.text_scale), (b, self.page, self.page_scale)))

    def probability(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.combined(a, b) * self.joint[0] + self.joint[1], -700, 700)))


class ArrayPool:
    """Unlabelled documents in memory, for small data and tests."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views = views

    def sure(self, weights: list[np.ndarray], taken: list[set], turn: int, wanted: dict[int, int]):
        """``(counts, picks)`` by (giver, label): how many documents the giver is
        sure of that the taker hasn't got, and the keys of some of them."""
        counts, picks = {}, {}
        for giver in (0, 1):
            p = 1 / (1 + np.exp(-_odds(self.views[giver], weights[giver])))
            free = ~np.isin(np.arange(len(p)), list(taken[1 - giver]))
            for label, mine in ((1, p >= SURE), (0, p <= 1 - SURE)):
                keys = np.flatnonzero(mine & free)
                counts[giver, label] = len(keys)
                picks[giver, label] = np.random.default_rng(turn).permutation(keys)[:wanted[label]].tolist()
        return counts, picks

    def rows(self, keys: set) -> dict:
        return {k: (self.views[0][k], self.views[1][k]) for k in keys}


class TablePool:
    """All unlabelled documents as a table ``(key, a, b)`` of both views in half
    precision; documents with equal views are one key."""

    def __init__(self, views: DataFrame):
        self.views = shared_table(views)

    def sure(self, weights: list[np.ndarray], taken: list[set], turn: int, wanted: dict[int, int]):
        """As in ``ArrayPool``: one pass scores the table, one counts what a view is
        sure of, one draws by hash at the rate that gives twice the wanted number.
        What comes to the driver is bounded by ``wanted``."""
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                p = [1 / (1 + np.exp(-_odds(_unpack(rows[name], size), w)))
                     for name, size, w in (("a", _TEXT, weights[0]), ("b", _PAGE, weights[1]))]
                yield pd.DataFrame({"key": rows["key"], "p0": p[0], "p1": p[1]})

        scored = shared_table(self.views.mapInPandas(run, "key long, p0 double, p1 double"))
        sides = None
        for giver in (0, 1):
            p = F.col(f"p{giver}")
            side = scored.select("key", F.lit(giver).alias("giver"),
                                 F.when(p >= SURE, 1).when(p <= 1 - SURE, 0).alias("label")).where("label IS NOT NULL")
            if taken[1 - giver]:
                side = side.where(~F.col("key").isin(list(taken[1 - giver])))
            sides = side if sides is None else sides.union(side)
        counts = {(r["giver"], r["label"]): r["n"] for r in sides.groupBy("giver", "label").agg(
            F.approx_count_distinct("key").alias("n")).collect()}
        rate = F.lit(0.0)
        for (giver, label), n in counts.items():
            rate = F.when((F.col("giver") == giver) & (F.col("label") == label),
                          F.lit((2 * wanted[label] + 20) / max(1, n))).otherwise(rate)
        order = hash_fraction(F.col("key"), salt=f"gift{turn}")
        drawn = sides.withColumn("order", order).where(F.col("order") < rate).distinct().toPandas()
        picks = {}
        for (giver, label), part in drawn.sort_values(["order", "key"]).groupby(["giver", "label"]):
            picks[giver, label] = part["key"].tolist()[:wanted[label]]
        return counts, picks

    def rows(self, keys: set) -> dict:
        if not keys:
            return {}
        found = self.views.where(F.col("key").isin(list(keys))).dropDuplicates(["key"]).toPandas()
        return dict(zip(found["key"], zip(_unpack(found["a"], _TEXT), _unpack(found["b"], _PAGE))))


def _unpack(packed: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, packed)), dtype=np.float16).reshape(-1, size).astype(np.float64)


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: ArrayPool | TablePool | tuple,
             rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """Fit both views; every fifth labelled row is kept for calibration only.

    In a round a view gives away up to ``given`` documents of the larger class and
    as many of the other as keeps the labelled rows' shares; it gives fewer of both
    where it is sure of too few of one.
    """
    pool = ArrayPool(pool) if isinstance(pool, tuple) else pool
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    check = aside if aside.any() else ~aside
    x, labels = [v[~aside] for v in views], [y[~aside], y[~aside]]
    share = {1: y.mean(), 0: 1 - y.mean()}
    wanted = {c: max(1, round(given * s / max(share.values()))) for c, s in share.items()}
    taken: list[set] = [set(), set()]  # keys that a view has got
    weights = [logistic(v, t) for v, t in zip(x, labels)]
    for turn in range(rounds):
        counts, picks = pool.sure(weights, taken, turn, wanted)
        gifts = {}
        for giver in (0, 1):
            part = min(min(1.0, counts.get((giver, c), 0) / wanted[c]) for c in (0, 1))
            gifts[1 - giver] = [(k, c) for c in (0, 1) for k in picks.get((giver, c), [])[:int(wanted[c] * part)]]
        rows = pool.rows({k for chosen in gifts.values() for k, _ in chosen})
        for taker, chosen in gifts.items():
            if chosen:
                x[taker] = np.vstack([x[taker], *[rows[k][taker][None] for k, _ in chosen]])
                labels[taker] = np.concatenate([labels[taker], [float(c) for _, c in chosen]])
                taken[taker].update(k for k, _ in chosen)
        if not any(gifts.values()):
            break
        weights = [logistic(v, t) for v, t in zip(x, labels)]
    scales = [calibration(_odds(v[check], w), y[check]) for v, w in zip(views, weights)]
    model = Model(*weights, *scales, np.array([1.0, 0.0]))
    both = model.combined(views[0][check], views[1][check])
    return Model(*weights, *scales, calibration(both, y[check]))


def _columns(docs: DataFrame, text_col: str, source_col: str, lang_col: str, chars_col: str) -> list[Column]:
    return [docs[text_col].cast("string").alias("text"), docs[source_col].cast("string").alias("source"),
            docs[lang_col].cast("string").alias("lang"), docs[chars_col].cast("double").alias("n_chars")]


def _features(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    if rows.empty:
        return np.zeros((0, _TEXT)), np.zeros((0, _PAGE))
    return (np.array([text_view(t) for t in rows["text"]]),
            np.array([page_view(*r) for r in rows[["source", "lang", "n_chars"]].itertuples(index=False)]))


def _packed(docs: DataFrame) -> DataFrame:
    """``(key, label, a, b)``: both views of every row, and a hash of them."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), 512):
                part = rows.iloc[start:start + 512]
                a, b = (v.astype(np.float16) for v in _features(part))
                yield pd.DataFrame({"label": part["label"], "a": [r.tobytes() for r in a], "b": [r.tobytes() for r in b]})

    return (docs.mapInPandas(run, "label int, a binary, b binary")
            .select(F.xxhash64("a", "b").alias("key"), "label", "a", "b"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars",
        label_col: str = "quality", rows: int = FIT_DOCUMENTS, rounds: int = ROUNDS) -> Model | None:
    """Learn from labelled documents whose id passes ``train``, at most about
    ``rows`` of each class, and from all others without their labels.  An id that
    is labelled twice counts as good if any row says so; null labels and ids
    teach nothing.  Without both classes there is no model."""
    key = F.col(id_col)
    marked = (labels.where(F.col(label_col).isNotNull() & key.isNotNull() & train)
              .groupBy(key.alias("_quire_id")).agg((F.max(label_col) > 0).cast("int").alias("label")))
    some = [bounded_sample(marked.where(F.col("label") == c), F.col("_quire_id"), rows, f"quality{c}") for c in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # bounded by ``rows``
    texts = docs.select(key.alias("_quire_id"), *_columns(docs, text_col, source_col, lang_col, chars_col))
    fields = ["text", "source", "lang", "n_chars"]
    known = (_packed(texts.join(chosen, "_quire_id").select("label", *fields))
             .toPandas().sort_values(["key", "label"], kind="stable"))
    y = known["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    others = texts.join(chosen, "_quire_id", "left_anti").select(F.lit(0).alias("label"), *fields)
    pool = TablePool(_packed(others).select("key", "a", "b"))
    return co_train((_unpack(known["a"], _TEXT), _unpack(known["b"], _PAGE)), y, pool, rounds)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", source_col: str = "source",
          lang_col: str = "lang", chars_col: str = "n_chars") -> Column:
    """Probability that a document is good; 1 where there is no model.  Null
    texts, sources, languages and lengths are scored as such, an empty text as a
    null one, a very long one in whole; repeated rows score alike, and a tie is
    what the caller's limit makes of it.  No other column is read."""
    if model is None:
        return F.lit(1.0)

    @F.pandas_udf("double")
    def run(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        rows = pd.DataFrame({"text": text, "source": source, "lang": lang, "n_chars": n_chars})
        parts = [model.probability(*_features(rows.iloc[s:s + 512])) for s in range(0, len(rows), 512)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return run(*_columns(docs, text_col, source_col, lang_col, chars_col))


def good_documents(docs: DataFrame, model: Model | None, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``at`` or more, with all their columns."""
    return docs.where(score(docs, model) >= at)
