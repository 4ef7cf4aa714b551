"""Subword-lattice language model: marginal document probability.

The vocabulary of an existing subword tokenizer is fixed; its pieces get
unigram scores from the training words (add-one smoothed).  A text is its words
and one end.  The probability that a word is spelled is the sum over all its
segmentations into pieces, closed by a word end, computed by a forward
recursion in log space over the bytes of the word.  A training word is also a
piece as a whole, with its discounted count; what the discount frees goes to
spelling.  Pieces never cross words, so the marginal probability of a text is
the product over its words, and every distinct word is scored once, wherever it
occurs:

    P(word) = (max(c - d, 0) + (d * V + 1) * spelled(word)) / (N + 2)
    P(end)  = (ends + 1) / (N + 2)

with c the word's count, V the number of words, N the number of tokens in the
training documents, and d the usual discount from the words seen once and twice.

Words are counted over all documents.  Words that make up at least one in
``FREQUENT`` of all tokens number ``FREQUENT`` at most: they go to the tasks as
a table.  All other words are joined, and by that bound none of them is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, record_batches, shared_table, words

# Vocabulary file of a public tokenizer (sentencepiece model with byte pieces).
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# At most this many words can each make up one FREQUENT-th of all tokens.
FREQUENT = 1 << 20
# Longer words are joined even when they are frequent (bounds the table's bytes).
FREQUENT_BYTES = 64
_MARK = "▁"  # fixed value: the word mark of the vocabulary
_FLUSH = 200_000


def load_pieces(path: str = PIECES) -> tuple[bytes, dict[int, bytes]]:
    """The serialized tokenizer, and the byte string of each usable piece by
    number.  Single bytes are pieces too (some equal a one-letter piece)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[int, bytes] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        text = sp.id_to_piece(i)
        pieces[i] = bytes([int(text[3:5], 16)]) if sp.is_byte(i) else text.encode()
    return sp.serialized_model_proto(), pieces


def piece_scores(used: dict[int, int], pieces: dict[int, bytes], kinds: int) -> tuple[dict[bytes, float], float]:
    """Natural-log scores of all pieces, and of the word end, for ``kinds``
    words; one is added to each count."""
    counts = dict.fromkeys(pieces.values(), 1)
    for i, k in used.items():
        if i in pieces:
            counts[pieces[i]] += k
    total = math.log(sum(counts.values()) + kinds + 1)
    return {p: math.log(k) - total for p, k in counts.items()}, math.log(kinds + 1) - total


class Lattice:
    """Marginal natural-log probability of byte strings under piece scores."""

    def __init__(self, scores: dict[bytes, float]):
        self._next: dict[bytes, float | None] = {}
        for piece in scores:
            for stop in range(1, len(piece)):
                self._next.setdefault(piece[:stop], None)
        self._next.update(scores)

    def log_probability(self, text: bytes) -> float:
        """Forward recursion: ``forward[j]`` sums over all segmentations of
        ``text[:j]``.  Byte pieces make every position reachable."""
        n, look, exp, log1p = len(text), self._next, math.exp, math.log1p
        forward: list[float | None] = [None] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            if here is None:
                continue
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece not in look:
                    break
                score = look[piece]
                if score is None:
                    continue
                new, old = here + score, forward[j]
                if old is None:
                    forward[j] = new
                elif new > old:
                    forward[j] = new + log1p(exp(old - new))
                else:
                    forward[j] = old + log1p(exp(new - old))
        return forward[n] if forward[n] is not None else -math.inf


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """``(word, c, n)``: every word with its count in the training documents
    and in all documents, over whole texts."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches):
        def rows() -> Iterator[tuple]:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, learn in batch_rows(batches):
                seen[bool(learn)].update(words(text))
                if len(seen[0]) + len(seen[1]) > _FLUSH:
                    yield from flush(seen)
            yield from flush(seen)

        def flush(seen):
            rest, learned = seen
            for w, k in learned.items():
                yield w, k, k + rest.pop(w, 0)
            for w, k in rest.items():
                yield w, 0, k
            learned.clear()
            rest.clear()

        return record_batches(rows(), schema, 16384)

    return (docs.select(F.col(text_col).cast("binary").alias("text"), train.alias("learn"))
            .mapInArrow(run, "word binary, c long, n long")
            .groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n")))


def count_pieces(vocabulary: DataFrame, model: bytes) -> dict[int, int]:
    """How often the tokenizer uses each piece in the training words, each word
    once (one row per piece of the fixed vocabulary comes back)."""
    schema = pa.schema([("piece", pa.int32()), ("k", pa.int64())])

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        used: Counter = Counter()
        for (word,) in batch_rows(batches):
            used.update(sp.encode(word.decode("utf-8", "replace")))
        return record_batches(iter(used.items()), schema)

    found = (vocabulary.where(F.col("c") > 0).select("word")
             .mapInArrow(run, "piece int, k long").groupBy("piece").agg(F.sum("k").alias("k")))
    return {r["piece"]: r["k"] for r in found.collect()}


class WordModel:
    """Log10 probability of a word from its count and its spellings."""

    def __init__(self, scores: dict[bytes, float], word_end: float, kinds: int, tokens: int,
                 once: int, twice: int):
        self._lattice, self._mark, self._word_end = Lattice(scores), _MARK.encode(), word_end
        self._less = (once + 1) / (once + 2 * twice + 2)
        self._spell = math.log(self._less * kinds + 1)
        self._total = math.log(tokens + 2)

    def log10(self, word: bytes, count: int) -> float:
        spelled = self._spell + self._lattice.log_probability(self._mark + word) + self._word_end
        if count > 0:
            whole = math.log(count - self._less)
            low, high = sorted((whole, spelled))
            spelled = high + math.log1p(math.exp(low - high))
        return (spelled - self._total) / math.log(10)

    def end_log10(self, ends: int) -> float:
        return (math.log(ends + 1) - self._total) / math.log(10)


def score_words(vocabulary: DataFrame, model: WordModel) -> DataFrame:
    """``(word, c, n, s)`` with the word's marginal log10 probability."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64()), ("s", pa.float64())])

    def run(batches):
        rows = ((w, c, n, model.log10(w, c)) for w, c, n in batch_rows(batches))
        return record_batches(rows, schema)

    return vocabulary.select("word", "c", "n").mapInArrow(run, "word binary, c long, n long, s double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    train: Column | None = None, pieces_path: str = PIECES,
                    frequent: int = FREQUENT) -> DataFrame:
    """``(id, trained, n_tokens, n_known, train_tokens, base_score, score)`` per row.

    ``train`` marks the rows that the counts come from (all rows by default).
    A null text is an empty one: its only token is the end.  Repeated rows each
    come out; ids may be null; columns not named here are not read.  Without
    training rows every count is zero.
    """
    learn = F.coalesce(train, F.lit(False)) if train is not None else F.lit(True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       learn.alias("trained"))
    model, pieces = load_pieces(pieces_path)
    counted = shared_table(word_counts(rows, "text", F.col("trained")))
    ends, all_ends = rows.agg(F.count(F.when(F.col("trained"), 1)), F.count(F.lit(1))).first()
    known, kinds, once, twice, tokens = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)), *[F.count(F.when(t, 1)) for t in (
            F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)],
        F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, types = known + ends, kinds + bool(ends)
    scores, word_end = piece_scores(count_pieces(counted, model), pieces, kinds)
    word_model = WordModel(scores, word_end, kinds, train_tokens, once, twice)
    vocabulary = shared_table(score_words(counted, word_model))

    at_least = max(2, -(-(tokens + all_ends) // frequent))
    top = {bytes(r["word"]): (r["c"], r["s"]) for r in vocabulary.where(
        (F.col("n") >= at_least) & (F.octet_length("word") <= FREQUENT_BYTES)).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(top)
    end10 = word_model.end_log10(ends)
    schema = pa.schema([("id", pa.int64()), ("trained", pa.bool_()), ("digest", pa.int64()),
                        ("word", pa.binary()), ("k", pa.int64()), ("copies", pa.int64()),
                        ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base", pa.float64()), ("score", pa.float64())])

    def run(batches):
        table = shared.value

        def one(i, text, trained, digest):
            own = Counter(words(text))
            n_known, base, score, rare = int(ends > 0), math.log10(ends + 1), end10, []
            for w, k in own.items():
                hit = table.get(w)
                if hit is None:
                    rare.append((w, k))
                else:
                    c, s = hit
                    n_known += k if c else 0
                    base += k * math.log10(c + 1)
                    score += k * s
            # the first row carries what the task's table gave; no word holds a space
            (w, k), *more = rare or [(b" %d %d" % (i or 0, digest), 0)]
            yield i, trained, digest, w, k, 1, sum(own.values()) + 1, n_known, base, score
            for w, k in more:
                yield i, trained, digest, w, k, 0, 0, 0, 0.0, 0.0

        return record_batches((r for row in batch_rows(batches) for r in one(*row)), schema, 16384)

    parts = (rows.select("id", F.col("text").cast("binary").alias("text"), "trained",
                         F.xxhash64("text").alias("digest"))
             .mapInArrow(run, "id long, trained boolean, digest long, word binary, k long, copies long, "
                              "n_tokens long, n_known long, base double, score double"))
    vocab = vocabulary.select(F.col("word").alias("w"), "c", "s")
    k, c = F.col("k"), F.col("c")
    joined = parts.join(vocab, parts["word"] == vocab["w"], "left").select(
        "id", "digest", "trained", "copies", "n_tokens",
        (F.col("n_known") + F.when(c > 0, k).otherwise(0)).alias("n_known"),
        (F.col("base") + F.coalesce(k * F.log10(c + 1), F.lit(0.0))).alias("base"),
        (F.col("score") + F.coalesce(k * F.col("s"), F.lit(0.0))).alias("score"))
    per_text = joined.groupBy("id", "digest").agg(
        F.max("trained").alias("trained"), *[F.sum(x).alias(x) for x in
                                             ("copies", "n_tokens", "n_known", "base", "score")])
    copies = F.col("copies")
    n_tokens = (F.col("n_tokens") / copies).cast("long")
    return per_text.select(
        "id", "trained", n_tokens.alias("n_tokens"),
        (F.col("n_known") / copies).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / copies - n_tokens * F.lit(math.log10(train_tokens + types + 1))).alias("base_score"),
        (F.col("score") / copies).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).drop("copy")
