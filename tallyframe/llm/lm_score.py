"""Language-model scores: masked pseudo-likelihood of a small bidirectional window network.

Words are in classes: the most frequent have one of their own, all others share
hashed ones. A network with one hidden layer predicts the class of each token
from the two tokens at either side; counts over the whole corpus split a class
into its words, each by its own count. Those of frequent words go to every task,
those of all others meet the documents' words in a join. A document's score is
the sum of the log-probabilities of all its tokens, each given what stands
around it.

The network is trained where the documents lie: every task walks its own texts
with gradient steps, and the tasks' networks are averaged, by their number of
trained positions, in a tree of grouped aggregates. Every token of every
document is a target once: the rounds share the positions out among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.hashing import slices, word_hashes
from tallyframe.session import materialise

OWN_CLASSES = 192
SHARED_CLASSES = 64
CLASSES = OWN_CLASSES + SHARED_CLASSES
PAD = CLASSES  # stands for what lies before and behind a document
KNOWN = 1 << 16  # words with at least one of so many tokens, so at most as many words, are known to every task
SIDE = 2
WIDTH, HIDDEN = 12, 16
ROUNDS = 2  # a round trains on every ROUNDS-th position of each document, and the next one on the positions behind them
BATCH = 256
RATE = 0.15
BLOCK = 1024
FAN_IN = 64  # networks averaged by one group
PREFIX = 18  # known words are looked up by the first so many bits of their hash

_SHAPES = (
    (CLASSES + 1, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,),
)
_CELLS = np.arange((CLASSES + 1) * WIDTH).reshape(CLASSES + 1, WIDTH)
_ONES = np.ones(CLASSES, np.float32)


@dataclass(frozen=True)
class Vocabulary:
    """Sorted hashes of the frequent words with their classes and shares, the rows of all others, and the classes' counts."""

    known: np.ndarray
    known_class: np.ndarray
    log_in_class: np.ndarray  # by known word: log-share of the word in its class
    class_counts: np.ndarray
    others: DataFrame  # word, inside: log-share of every word that is not known

    def __getstate__(self) -> dict:  # tasks get what they look up; the others are for joins
        return {**self.__dict__, "others": None}

    def classes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and log-probability within the class of every word; the latter is NaN for words that are not known."""
        out = OWN_CLASSES + (hashes & np.uint64(SHARED_CLASSES - 1)).astype(np.int64)
        inside = np.full(len(hashes), np.nan)
        if len(self.known):
            first = (hashes >> np.uint64(64 - PREFIX)).astype(np.int64)
            at, end = self._firsts.take(first), self._firsts.take(first + 1)
            left = np.flatnonzero(at < end)
            at, end = at[left], end[left]
            while len(left):  # as often as the fullest prefix has words
                hit = self.known.take(at) == hashes[left]
                out[left[hit]], inside[left[hit]] = self.known_class.take(at[hit]), self.log_in_class.take(at[hit])
                go = ~hit & (at + 1 < end)
                left, at, end = left[go], at[go] + 1, end[go]
        return out, inside

    @cached_property
    def _firsts(self) -> np.ndarray:
        """The place of the first known word of each prefix, and the end."""
        counts = np.bincount((self.known >> np.uint64(64 - PREFIX)).astype(np.int64), minlength=1 << PREFIX)
        return np.concatenate(([0], np.cumsum(counts))).astype(np.int32)

    def unseen(self, word: Column) -> Column:
        """The log-share of a word that was never seen: it is worth half a count."""
        counts = F.array(*[F.lit(float(c)) for c in self.class_counts[OWN_CLASSES:]])
        return -F.log(2 * F.get(counts, word.bitwiseAND(SHARED_CLASSES - 1).cast("int")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words, counts = np.unique(word_hashes(part.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.view(np.int64)), pa.array(counts)], names=["word", "n"]
            )


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Counts of all words of all documents, grouped in Spark; the driver gets the counts of at most ``KNOWN`` words and of the classes."""
    counts = docs.select("text").mapInArrow(_counted, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lm-words")
    top = counts.orderBy(F.col("n").desc(), "word").limit(OWN_CLASSES).collect()
    own = [r["word"] for r in top]
    rest = counts.where(~F.col("word").isin(own)) if own else counts
    place = F.col("word").bitwiseAND(SHARED_CLASSES - 1).cast("int")
    class_counts = np.full(CLASSES, 0.5)  # words that were never seen are worth half a count in each class
    class_counts[: len(top)] += [r["n"] for r in top]
    for r in rest.groupBy(place.alias("c")).agg(F.sum("n").alias("n")).collect():
        class_counts[OWN_CLASSES + r["c"]] += r["n"]
    least = -(-(counts.agg(F.sum("n")).first()[0] or 0) // KNOWN)
    frequent = rest.where(F.col("n") >= least).toPandas()
    words = np.concatenate([np.array(own, np.int64), frequent["word"].to_numpy(np.int64)])
    classes = np.concatenate([np.arange(len(own)), OWN_CLASSES + (frequent["word"].to_numpy(np.int64) & (SHARED_CLASSES - 1))])
    inside = np.concatenate([
        np.zeros(len(own)), np.log(frequent["n"].to_numpy(np.float64)) - np.log(class_counts[classes[len(own):]])
    ])
    order = np.argsort(words.view(np.uint64))
    totals = F.array(*[F.lit(float(c)) for c in class_counts[OWN_CLASSES:]])
    others = rest.where(F.col("n") < least).select("word", F.log(F.col("n") / F.get(totals, place)).alias("inside"))
    return Vocabulary(words.view(np.uint64)[order], classes[order], inside[order], class_counts, others)


class Network:
    """Embedding, one hidden layer and a softmax over the classes, in 32-bit floats."""

    def __init__(self, values: np.ndarray) -> None:
        flat = values.astype(np.float32)
        self.parts, at = [], 0
        for shape in _SHAPES:
            size = int(np.prod(shape))
            self.parts.append(flat[at : at + size].reshape(shape))
            at += size
        self.top = flat[-(HIDDEN + 1) * CLASSES :].reshape(HIDDEN + 1, CLASSES)  # the outer weights and, below them, their bias
        self.room = np.empty((0, CLASSES), np.float32)  # for the logits of one call

    @staticmethod
    def initial(class_counts: np.ndarray) -> "Network":
        """Small random weights; the bias is the unigram law."""
        rng = np.random.default_rng(1)
        flat = [rng.normal(0, 0.1, int(np.prod(s))) for s in _SHAPES[:4]]
        return Network(np.concatenate([*flat, np.log(class_counts / class_counts.sum())]))

    def values(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def _forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is seen, the hidden values with a one behind them, and the logits, which the next call overwrites."""
        table, inner, inner_bias, _, _ = self.parts
        n = len(around)
        if len(self.room) < n:
            self.room = np.empty((n, CLASSES), np.float32)
        seen = table.take(around, axis=0).reshape(n, -1)
        hidden = np.ones((n, HIDDEN + 1), np.float32)
        np.tanh(seen @ inner + inner_bias, out=hidden[:, :-1])
        logits = np.matmul(hidden, self.top, out=self.room[:n])
        # No hidden value is above 1, so most networks cannot overflow, also not in sums of weighted classes; the
        # others are shifted.
        if np.abs(self.top).sum(axis=0).max() > 40:
            logits -= logits.max(axis=1, keepdims=True)
        return seen, hidden, logits

    def log_probability(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, _, logits = self._forward(around)
        hit = logits[np.arange(len(target)), target]
        np.exp(logits, out=logits)
        return hit - np.log(logits @ _ONES)

    def step(self, around: np.ndarray, target: np.ndarray, memory: list[np.ndarray], rate: float = RATE) -> None:
        """One gradient step with rates that shrink by each weight's past gradients."""
        table, inner, _, outer, _ = self.parts
        seen, hidden, logits = self._forward(around)
        # The slope of each row, not yet divided by the row's total: that is done where the rows are short.
        slope = np.exp(logits, out=logits)
        totals = slope @ _ONES
        slope[np.arange(len(target)), target] -= totals
        scale = (1 / (len(target) * totals))[:, None]
        back = (slope @ outer.T) * scale * (1 - hidden[:, :-1] ** 2)
        in_top = (hidden * scale).T @ slope
        cells = _CELLS.take(around.ravel(), axis=0)
        in_table = np.bincount(cells.ravel(), (back @ inner.T).ravel(), table.size).reshape(table.shape)
        for part, past, change in zip(
            self.parts, memory, (in_table, seen.T @ back, back.sum(axis=0), in_top[:-1], in_top[-1])
        ):
            past += change**2
            part -= rate * change / (np.sqrt(past) + 1e-6)


def _around(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The tokens at either side of every position, none from another document."""
    n = len(tokens)
    padded = np.full(n + 2 * SIDE, PAD, dtype=np.int16)
    padded[SIDE : SIDE + n] = tokens
    out = np.empty((n, 2 * SIDE), dtype=np.int16)
    for column, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        out[:, column] = padded[SIDE + shift : SIDE + shift + n]
        # As many positions as the shift reaches over a document's edge see nothing there.
        for k in range(abs(shift)):
            edge = offsets[:-1] + k if shift < 0 else offsets[1:] - 1 - k
            out[edge[(edge >= 0) & (edge < n)], column] = PAD
    return out


def _targets(offsets: np.ndarray, number: int) -> np.ndarray:
    """The positions that a round trains on, counted from the start of each document; ROUNDS rounds cover all."""
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    return np.flatnonzero(place % ROUNDS == number % ROUNDS)


def _trainer(shared, number: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, values = shared.value
        network, memory, trained = Network(values), [np.full(s, 1e-4, np.float32) for s in _SHAPES], 0
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = word_hashes(part.column("text"))
                tokens = words.classes(hashes)[0]
                around = _around(tokens, offsets)
                chosen = np.random.default_rng(number).permutation(_targets(offsets, number))
                for at in range(0, len(chosen), BATCH):
                    places = chosen[at : at + BATCH]
                    network.step(around[places], tokens[places], memory)
                trained += len(chosen)
        if trained:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(trained)]),
                 pa.array([network.values().astype(np.float64).tobytes()], pa.binary())],
                names=["id", "weight", "network"],
            )

    return train


def _averaged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    weights = rows["weight"].to_numpy()
    # Rows in a fixed order, so that sums are the same at every run.
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    total = sum(weights[k] * np.frombuffer(rows["network"].iloc[k]) for k in order)
    return pd.DataFrame(
        {"id": [int(key[0])], "weight": [float(weights[order].sum())], "network": [(total / weights.sum()).tobytes()]}
    )


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Network:
    schema = "id bigint, weight double, network binary"
    network = Network.initial(words.class_counts)
    for number in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast((words, network.values()))
        made = materialise(docs.select("text").mapInArrow(_trainer(shared, number), schema), "lm-networks")
        # One network per task; FAN_IN of them meet in a group until FAN_IN are left for the driver.
        last = (made.agg(F.max("id")).first()[0] or 0) + 1
        while last > FAN_IN:
            made = materialise(
                made.groupBy(F.floor(F.col("id") / FAN_IN).alias("g")).applyInPandas(_averaged, schema), "lm-networks"
            )
            last = -(-last // FAN_IN)
        rows = made.toPandas()
        if len(rows):
            network = Network(np.frombuffer(_averaged((0,), rows)["network"].iloc[0]))
    return network


def score_texts(
    texts: pa.Array, words: Vocabulary, network: Network
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and summed log-probabilities of whole texts, without the shares of the words that are not known.

    Those words come with the number of their text, one for each occurrence.
    """
    hashes, offsets = word_hashes(texts)
    tokens, inside = words.classes(hashes)
    around = _around(tokens, offsets)
    value = np.empty(len(tokens))
    for at in range(0, len(tokens), BLOCK):
        value[at : at + BLOCK] = network.log_probability(around[at : at + BLOCK], tokens[at : at + BLOCK])
    other = np.isnan(inside)
    value += np.where(other, 0.0, inside)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    return np.diff(offsets), np.bincount(row, value, len(texts)), hashes[other], row[other]


def scored(docs: DataFrame, words: Vocabulary, network: Network) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((words, network.values()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = shared.value
        model = Network(values)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, sums, others, row = score_texts(part.column("text"), known, model)
                ends = np.searchsorted(row, np.arange(len(counts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(sums),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(others.view(np.int64)))],
                    names=["doc_id", "n_tokens", "log_probability", "others"],
                )

    schema = "doc_id bigint, n_tokens bigint, log_probability double, others array<bigint>"
    found = materialise(
        docs.select("doc_id", "text").mapInArrow(score, schema).withColumn("rid", F.monotonically_increasing_id()), "lm-scores"
    )
    # A word that is not known to the tasks is less than one of KNOWN tokens, so none of these keys is hot.
    told = found.select("rid", F.explode("others").alias("word")).join(words.others, "word", "left")
    shares = told.groupBy("rid").agg(F.sum(F.coalesce("inside", words.unseen(F.col("word")))).alias("shares"))
    rows = found.join(shares, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("log_probability") + F.coalesce("shares", F.lit(0.0))).alias("log_probability")
    )
    return rows.withColumn(
        "per_token", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens"))
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text) and score every row: doc_id, n_tokens, log_probability, per_token.

    Null and empty texts have no tokens, the score 0 and a null per_token. Rows
    with null or repeated ids are scored each; equal rows count as often as
    they are there. Other columns are not read; no rows give no rows. Texts of
    any length are scored whole.
    """
    words = vocabulary(docs)
    return scored(docs, words, train(docs, words))
