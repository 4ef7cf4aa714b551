"""Toxic passages by maximum-scoring segment search.

Words and their stems (leading letters), counted once a document, get log-odds
between toxic and clean training documents under a Dirichlet prior (the pooled
counts, ``prior`` pseudo-tokens) and keep what is beyond ``z`` standard errors
of them.  A token scores the highest odds of its stems, wherever and however
often it occurs, and every token costs ``drift``, so that clean text drifts
downwards.  A linear scan finds all maximal scoring
segments of a document.  The scale of their scores under clean text (the
positive root of the moment equation, over the scores that the scan gives to the
tokens of clean text) and their rate turn a score into an E-value for the
document's length; segments with E below ``e_value`` are significant passages.
The summed surprise of a document's passages, in which a word's k-th mention
weighs a k-th, is calibrated to a probability.  Scale, rate and probability are
taken from labelled documents that the odds haven't seen.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, bounded_sample, hash_fraction, record_batches, shared_table

# Labelled documents that a fit may use (of each class; a hash picks them).
FIT_DOCUMENTS = 10_000
# Leading letters that count as a stem, besides the whole word.
STEMS = range(3, 9)
# Share of them kept from the odds, and the fewest of a class that will do: with
# fewer, all documents serve for both.
ASIDE, ASIDE_LEAST = 0.3, 20
_TOKEN = re.compile(r"[^\W\d_]+")
_REMEMBER = 200_000


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return _TOKEN.findall(text.lower()) if text else []


def stems(token: str) -> list[str]:
    """A word itself and, marked, its leading letters."""
    return [token, *(token[:n] + "*" for n in STEMS if n <= len(token))]


def maximal_segments(places: Iterable[int], scores: Iterable[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence whose token at ``places[k]``
    scores ``scores[k] - drift`` and every other one ``-drift``: ``(first,
    last, score)``, in order.  Linear in the number of places, since only a
    token with a positive score can open or close a segment.

    The stack holds candidates with the cumulative sums before and after them.
    A new one joins the last candidate that starts lower, if it ends higher.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # ..., index of the last candidate starting lower
    gain = 0.0
    for place, score in zip(places, scores):
        first, before = place, gain - drift * place
        gain += score
        after = gain - drift * (place + 1)
        if after <= before:
            continue
        lower = len(stack) - 1
        while True:
            while lower >= 0 and stack[lower][2] >= before:
                lower = stack[lower][4]
            if lower < 0 or stack[lower][3] >= after:
                stack.append((first, place, before, after, lower))
                break
            first, _, before, _, further = stack[lower]
            del stack[lower:]
            lower = further
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass(frozen=True)
class Model:
    """Scores of the significant tokens and the calibration of their segments."""

    odds: dict[str, float]  # of significant words and stems
    drift: float
    decay: float  # of segment scores under clean text
    rate: float  # segments per token of clean text
    e_value: float
    slope: float
    offset: float
    _known: dict = field(default_factory=dict, compare=False, repr=False)  # odds of tokens met before

    def _token_odds(self, token: str, known: dict[str, float]) -> float:
        if token not in known:
            if len(known) > _REMEMBER:
                known.clear()
            known[token] = max((self.odds[x] for x in stems(token) if x in self.odds), default=0.0)
        return known[token]

    def scores(self, text: str | None) -> list[float]:
        """Odds of a text's tokens, as the scan sees them."""
        return [self._token_odds(t, self._known) for t in tokens(text)]

    def _scan(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], list[str], list[float]]:
        """Significant ``(first, last, score, e_value)`` by token, the tokens and their odds."""
        found, known = tokens(text), self._known
        odds = [known[t] if t in known else self._token_odds(t, known) for t in found]
        places = [k for k, x in enumerate(odds) if x]
        segments = maximal_segments(places, [odds[k] for k in places], self.drift)
        expected = ((a, b, s, self.rate * len(found) * math.exp(-self.decay * s)) for a, b, s in segments)
        return [x for x in expected if x[3] < self.e_value], found, odds

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], int]:
        """Significant ``(first, last, score, e_value)`` by token, and the number of tokens."""
        significant, found, _ = self._scan(text)
        return significant, len(found)

    def surprise(self, text: str | None) -> float:
        """Logarithm of the summed -ln E of the passages (0: none).

        Odds are of documents, so a passage weighs as much as its words are new:
        a word's k-th mention in the passages counts a k-th of its odds.
        """
        significant, found, odds = self._scan(text)
        times: Counter = Counter()
        total = 0.0
        for first, last, _, e in significant:
            whole = fresh = 0.0
            for k in range(first, last + 1):
                if odds[k] > 0:
                    times[found[k]] += 1
                    whole += odds[k]
                    fresh += odds[k] / times[found[k]]
            total -= math.log(max(e, 1e-300)) * fresh / whole
        return math.log1p(total)

    def probability(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.slope * self.surprise(text) + self.offset))))


def decay_root(probabilities: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(p * exp(x * score)) = 1 (mean score negative,
    some score positive); 1.0 where there is none."""
    if not len(scores) or scores.max() <= 0 or (probabilities * scores).sum() >= 0:
        return 1.0

    def above(x: float) -> bool:
        return float(np.logaddexp.reduce(np.log(probabilities) + x * scores)) > 0

    low, high = 0.0, 1.0
    while not above(high):
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if above(middle) else (middle, high)
    return high


def calibrate(surprise: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps, with softened
    labels (so that separable data keep finite values)."""
    yes, no = float(toxic.sum()), float(len(toxic) - toxic.sum())
    goal = np.where(toxic > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    scale = float(surprise.max()) if len(surprise) and surprise.max() > 0 else 1.0
    x = np.column_stack([surprise / scale, np.ones(len(surprise))])
    w = np.array([0.0, math.log((yes + 1) / (no + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - goal) + 1e-3 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return float(w[0] / scale), float(w[1])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
              train: Column, rows: int) -> DataFrame:
    """``(text, toxic)`` of at most about ``rows`` training documents a class;
    their ids, bounded by that parameter, are broadcast."""
    marked = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & train)
              .groupBy(F.col(id_col).alias("_quire_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic")))
    some = [bounded_sample(marked.where(F.col("toxic") == c), F.col("_quire_id"), rows, f"toxic{c}") for c in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_quire_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(some[0].union(some[1])), "_quire_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = FIT_DOCUMENTS, prior: float = 10_000.0, z: float = 3.5,
        drift: float = 0.5, e_value: float = 0.05) -> Model:
    """Learn from the labelled documents whose id passes ``train`` (a condition
    on the id column).  Ids that repeat in ``labels`` are toxic if any row says
    so; null labels and ids teach nothing.  Without labels of both kinds nothing
    is toxic.  Equal texts fall on one side of the split between odds and calibration."""
    every = shared_table(_labelled(docs, labels, id_col, text_col, label_col, train, rows).select("text", "toxic"))
    kept = hash_fraction(F.coalesce("text", F.lit("")), salt="aside") < ASIDE
    enough = {r["toxic"] for r in every.where(kept).groupBy("toxic").count().collect() if r["count"] >= ASIDE_LEAST}
    learned, aside = (every.where(~kept), every.where(kept)) if len(enough) == 2 else (every, every)
    counts = pa.schema([("token", pa.string()), ("t", pa.int64()), ("c", pa.int64())])

    def count(batches):
        seen = Counter(), Counter()
        for text, toxic in batch_rows(batches):
            seen[toxic].update(set(tokens(text)))
        by_stem = Counter(), Counter()
        for words_, stems_ in zip(seen, by_stem):
            for word, k in words_.items():
                for stem in stems(word):
                    stems_[stem] += k
        return record_batches(((k, by_stem[1][k], by_stem[0][k]) for k in by_stem[0].keys() | by_stem[1].keys()),
                              counts)

    by_token = shared_table(learned.mapInArrow(count, "token string, t long, c long")
                            .groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    in_toxic, in_clean = (x or 0 for x in by_token.where(~F.endswith(F.col("token"), F.lit("*")))
                          .agg(F.sum("t"), F.sum("c")).first())
    if not in_toxic or not in_clean:
        return Model({}, drift, 1.0, 1.0, e_value, 1.0, -10.0)
    alpha = F.lit(prior) * (F.col("t") + F.col("c")) / F.lit(in_toxic + in_clean)

    def logit(k: str, total: int) -> Column:
        return F.log((F.col(k) + alpha) / (F.lit(total + prior) - F.col(k) - alpha))

    odds = logit("t", in_toxic) - logit("c", in_clean)
    spread = F.sqrt(1 / (F.col("t") + alpha) + 1 / (F.col("c") + alpha))
    sure = F.greatest(F.abs(odds) - z * spread, F.lit(0.0)) * F.signum(odds)
    strong = by_token.select("token", sure.alias("odds")).where(F.col("odds") != 0).collect()  # as bounded as the sample
    lexicon = {r["token"]: r["odds"] for r in strong}
    clean = aside.where("toxic = 0").select("text")
    decay = _decay(clean, Model(lexicon, drift, 1.0, 1.0, math.inf, 1.0, 0.0))
    rate = _rate(clean, Model(lexicon, drift, decay, 1.0, math.inf, 1.0, 0.0), e_value)
    seen = aside.select("toxic", _surprise(Model(lexicon, drift, decay, rate, e_value, 1.0, 0.0))(F.col("text")).alias("x")).toPandas()
    slope, offset = calibrate(seen["x"].to_numpy(float), seen["toxic"].to_numpy(float))
    return Model(lexicon, drift, decay, rate, e_value, max(0.0, slope), offset)


def _decay(clean: DataFrame, model: Model) -> float:
    """Root of the moment equation for the scores that the scan gives to the
    tokens of clean text; one token of the highest score is added to them."""
    def weigh(batches):
        seen: Counter = Counter()
        for (text,) in batch_rows(batches):
            seen.update(model.scores(text))
        return record_batches(seen.items(), pa.schema([("score", pa.float64()), ("n", pa.int64())]))

    by_score = (clean.mapInArrow(weigh, "score double, n long").groupBy("score").agg(F.sum("n").alias("n"))
                .toPandas().sort_values("score"))  # no more rows than the lexicon has scores
    top = max(model.odds.values(), default=0.0)
    n = np.append(by_score["n"].to_numpy(float), 1.0)
    return decay_root(n / n.sum(), np.append(by_score["score"].to_numpy(float), top) - model.drift)


def _rate(clean: DataFrame, raw: Model, e_value: float) -> float:
    """Segments per token of clean text, such that ``e_value`` of them a document
    fall below that E-value (all of them where there are fewer).  ``raw`` has rate
    one and no limit."""
    def expect(batches):
        found = (raw.passages(t) for (t,) in batch_rows(batches))
        return record_batches(((n, [x[3] for x in p]) for p, n in found),
                              pa.schema([("n", pa.int64()), ("e", pa.list_(pa.float64()))]))

    segments = shared_table(clean.mapInArrow(expect, "n long, e array<double>"))
    documents, n, count = segments.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("e"))).first()
    allowed = int(e_value * documents) + 1
    if (count or 0) < allowed:
        return ((count or 0) + 1) / ((n or 0) + 1)
    lowest = segments.select(F.explode("e").alias("e")).orderBy("e").limit(allowed).agg(F.max("e")).first()[0]
    return e_value / max(lowest, 1e-300)


def _surprise(model: Model):
    @F.pandas_udf("double")
    def surprise(text: pd.Series) -> pd.Series:
        return pd.Series([model.surprise(t) for t in text], dtype="float64")

    return surprise


def score(model: Model, text: Column) -> Column:
    """Probability that a text is toxic; a null or empty text has no passage, a
    very long one is scanned in whole, and repeated rows score alike.  No other
    column is read."""
    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        return pd.Series([model.probability(t) for t in texts], dtype="float64")

    return probability(text)


def passages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: ``(id, first, last, score, e_value, words)``,
    positions counted in tokens of the document."""
    schema = pa.schema([("id", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()),
                        ("e_value", pa.float64()), ("words", pa.string())])

    def run(batches):
        rows = ((i, a, b, s, e, " ".join(tokens(t)[a:b + 1]))
                for i, t in batch_rows(batches) for a, b, s, e in model.passages(t)[0])
        return record_batches(rows, schema)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, first long, last long, score double, e_value double, words string"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at``, with all their columns."""
    return docs.where(score(model, F.col(text_col)) < at)
