"""Language identification by a byte-level convolutional network.

A text is its UTF-8 bytes, cut into windows of ``WINDOW`` bytes (the last one
padded); every window of every text is read.  Byte embeddings go through
filters of several widths, each filter's largest response in the window is kept,
and a softmax gives the window's languages.  The windows' log-probabilities
are averaged, weighted by their length.  The network is trained here in numpy,
by Adam on cross entropy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import hash_fraction

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# Labelled documents of each language that a fit may use, and windows of each in
# an epoch: every epoch has windows of its own, from anywhere in the whole text.
FIT_DOCUMENTS = 400
FIT_WINDOWS = 3
EPOCHS = 12
NONE = "und"  # fixed value: no language
_BATCH = 64
_PAD = 256  # a symbol of its own, embedded as zero


def windows(raw: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a byte string as rows of symbols, and their lengths."""
    n = max(1, -(-len(raw) // size))
    rows = np.full(n * size, _PAD, dtype=np.int16)
    rows[:len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    lengths = np.full(n, size)
    lengths[-1] = len(raw) - (n - 1) * size
    return rows.reshape(n, size), lengths


@dataclass
class Network:
    """Weights; ``filters[w]`` has one (width * embedding) row of weights a filter."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.5, (257, EMBEDDING)).astype(np.float32)
        table[_PAD] = 0
        return cls(languages, table,
                   {w: rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32)
                    for w in WIDTHS},
                   {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
                   rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
                   np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters.values(), *self.bias.values(), self.dense, self.dense_bias]

    def _patches(self, symbols: np.ndarray, width: int) -> np.ndarray:
        """(window, place, width * embedding): the embedded bytes under a filter."""
        e = self.embedding[symbols]
        places = symbols.shape[1] - width + 1
        return np.concatenate([e[:, k:k + places] for k in range(width)], axis=2)

    def pooled(self, symbols: np.ndarray) -> tuple[np.ndarray, dict]:
        """Largest response of every filter (at least 0), and where it was."""
        best, where = [], {}
        for w in WIDTHS:
            patches = self._patches(symbols, w)
            response = (patches.reshape(-1, patches.shape[2]) @ self.filters[w]).reshape(*patches.shape[:2], FILTERS)
            at = response.argmax(axis=1)
            top = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + self.bias[w]
            where[w] = (at, top > 0)
            best.append(np.maximum(top, 0))
        return np.concatenate(best, axis=1), where

    def log_probabilities(self, symbols: np.ndarray) -> np.ndarray:
        out = self.tables_pooled(symbols) @ self.dense + self.dense_bias
        out -= out.max(axis=1, keepdims=True)
        return out - np.log(np.exp(out).sum(axis=1, keepdims=True))

    def tables_pooled(self, symbols: np.ndarray) -> np.ndarray:
        """``pooled`` for prediction: a filter's response to a byte pair is
        looked up instead of multiplied out."""
        if not hasattr(self, "_pairs"):
            self._pairs = self._pair_tables()
        index = symbols.astype(np.int32)
        pair = index[:, :-1] * 257 + index[:, 1:]
        best = []
        for w in WIDTHS:
            places = symbols.shape[1] - w + 1
            tables = self._pairs[w]
            total = tables[0][pair[:, :places]]
            for k in range(1, w // 2):
                total += tables[k][pair[:, 2 * k:2 * k + places]]
            if w % 2:
                total += tables[-1][index[:, w - 1:w - 1 + places]]
            best.append(np.maximum(total.max(axis=1) + self.bias[w], 0))
        return np.concatenate(best, axis=1)

    def _pair_tables(self) -> dict[int, list[np.ndarray]]:
        made = {}
        for w in WIDTHS:
            parts = self.filters[w].reshape(w, EMBEDDING, FILTERS)
            single = [self.embedding @ p for p in parts]
            tables = [(single[2 * k][:, None] + single[2 * k + 1][None]).reshape(257 * 257, FILTERS)
                      for k in range(w // 2)]
            made[w] = tables + ([single[-1]] if w % 2 else [])
        return made

    def gradients(self, symbols: np.ndarray, goal: np.ndarray) -> list[np.ndarray]:
        """Cross-entropy gradients, in the order of ``weights``."""
        pooled, where = self.pooled(symbols)
        out = pooled @ self.dense + self.dense_bias
        p = np.exp(out - out.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - goal) / len(symbols)
        into = error @ self.dense.T
        d_embedding = np.zeros_like(self.embedding)
        d_filters, d_bias = [], []
        rows = np.arange(len(symbols))[:, None]
        for n, w in enumerate(WIDTHS):
            at, alive = where[w]
            d = into[:, n * FILTERS:(n + 1) * FILTERS] * alive
            # only the place of the largest response gets a gradient
            under = symbols[rows[:, :, None], at[:, :, None] + np.arange(w)]  # window, filter, width
            patch = self.embedding[under].reshape(len(symbols), FILTERS, w * EMBEDDING)
            d_filters.append(np.einsum("bf,bfk->kf", d, patch))
            d_bias.append(d.sum(axis=0))
            back = (d[:, :, None] * self.filters[w].T[None]).reshape(-1, EMBEDDING)
            np.add.at(d_embedding, under.reshape(-1), back)
        d_embedding[_PAD] = 0
        return [d_embedding, *d_filters, *d_bias, pooled.T @ error, error.sum(axis=0)]


def train(network: Network, symbols: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01,
          seed: int = 42) -> Network:
    """Adam over shuffled batches, in place; rows are dealt to the epochs in turn."""
    rng = np.random.default_rng(seed)
    goal = np.eye(len(network.languages), dtype=np.float32)[label]
    weights = network.weights()
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(np.arange(epoch, len(symbols), epochs))
        for start in range(0, len(order), _BATCH):
            part = order[start:start + _BATCH]
            step += 1
            pace = rate * (1 - epoch / epochs) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for w, m, v, g in zip(weights, first, second, network.gradients(symbols[part], goal[part])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= pace * m / (np.sqrt(v) + 1e-8)
    return network


def _training_windows(text: str) -> list[bytes]:
    """Windows of a document for all epochs, from anywhere in its whole text;
    some are cut short, so that short texts are met too.  They depend on the
    text alone."""
    raw = text.encode()
    rng = np.random.default_rng(zlib.crc32(raw))
    made = []
    for _ in range(FIT_WINDOWS * EPOCHS):
        size = WINDOW if rng.random() < 0.5 else int(rng.integers(4, WINDOW))
        start = int(rng.integers(0, max(1, len(raw) - size + 1)))
        made.append(raw[start:start + size])
    return made


def _draw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"]):
            made = _training_windows(text)
            yield pd.DataFrame({"lang": lang, "text": zlib.crc32(text.encode()), "place": range(len(made)), "raw": made})


def fit(docs: DataFrame, train_rows: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        per_language: int = FIT_DOCUMENTS, seed: int = 42) -> Network:
    """Train on at most about ``per_language`` labelled documents of each
    language that pass ``train_rows``.  Windows are drawn in the tasks, from whole
    texts; only they come to the driver.  Null languages, null texts and texts without letters teach nothing; the
    result knows no language if there are none."""
    usable = docs.where(train_rows & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return Network.fresh([], seed)
    share = F.lit(None).cast("double")
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == F.lit(lang), F.lit(per_language / n)).otherwise(share)
    order = hash_fraction(F.col(id_col).cast("string"), F.col(text_col), salt="langid")
    sample = (usable.where(order < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
              .mapInPandas(_draw, "lang string, text long, place int, raw binary")
              .toPandas().sort_values(["lang", "text", "place"], kind="stable"))
    languages = sorted(sizes)
    network = Network.fresh(languages, seed)
    if sample.empty:
        return network
    symbols = np.concatenate([windows(bytes(raw))[0][:1] for raw in sample["raw"]])
    return train(network, symbols, sample["lang"].map(languages.index).to_numpy(), seed=seed)


def predict_texts(network: Network, texts: Iterable[str | None]) -> list[tuple[str, float]]:
    """Language and its probability of each text; ``und`` for one without letters.

    Windows of all texts run through the network in batches of one fixed size, so
    that a text's result doesn't depend on its neighbours.
    """
    texts = list(texts)
    n = len(network.languages)
    total, length = np.zeros((len(texts), n)), np.zeros(len(texts))
    batch = np.full((_BATCH, WINDOW), _PAD, dtype=np.int16)
    owner, weight = np.zeros(_BATCH, dtype=np.int64), np.zeros(_BATCH)
    filled = 0

    def run() -> None:
        np.add.at(total, owner[:filled], (network.log_probabilities(batch) * weight[:, None])[:filled])

    for place, text in enumerate(texts):
        if not text or not n or not any(map(str.isalpha, text)):
            continue
        rows, lengths = windows(text.encode())
        length[place] = lengths.sum()
        start = 0
        while start < len(rows):
            size = min(_BATCH - filled, len(rows) - start)
            batch[filled:filled + size], weight[filled:filled + size] = rows[start:start + size], lengths[start:start + size]
            owner[filled:filled + size] = place
            start, filled = start + size, filled + size
            if filled == _BATCH:
                run()
                filled = 0
    if filled:
        run()
    out = []
    for logs, size in zip(total, length):
        if not size:
            out.append((NONE, 0.0))
            continue
        mean = logs / size
        p = np.exp(mean - mean.max())
        p /= p.sum()
        out.append((network.languages[int(p.argmax())], float(p.max())))
    return out


def predict(network: Network, text: Column) -> Column:
    """Struct ``(lang, score)`` for whole texts of any length, null and empty ones
    too.  Of languages with equal probability the first by name counts; repeated
    rows get equal results; no column but ``text`` is read."""

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(predict_texts(network, texts), columns=["lang", "score"])

    return run(text)
