"""Benchmark decontamination: BM25 over an inverted index of test items, pruned by block maxima.

Items are cut into parts of bounded length, and impacts are divided by what a
part scores against itself, so a passage that holds a whole part scores 1 and
one threshold serves all parts. For each passage the terms with the smallest
upper bounds, which cannot reach the threshold together, open no postings;
what the others retrieve is bounded by the maxima of its block before it is
scored in full. No passage above the threshold is lost. Whole documents are
read in their own partition; only the index travels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.hashing import slices, spread, word_hashes
from tallyframe.session import materialise

PART_WORDS = 64
PASSAGE_WORDS = 128  # passages begin every PART_WORDS words, so each run of PART_WORDS words lies in one whole
SCORE = 0.6
COVERED = 0.75  # share of an item's words that lie in five-word windows found in the document
VERIFIED = 0.5  # share that question and answer must each have, where the item has both
WINDOW = 5
K1, B = 1.2, 0.75
SHARD_PARTS = 4_096  # parts in one index shard
SHARD_GROUP = 16  # shards sent to the tasks at once; more go in further passes
BLOCKS = 32  # blocks of parts in a shard that keep term maxima

_LAST = re.compile(r"(?:\n\s*(?:answer|a)\s*:|[.!?])\s+(?=\S[^.!?]*[.!?]*\s*$)", re.I)


def question_length(text: str) -> int:
    """Where the answer begins: behind the last ``Answer:`` or sentence end before the final sentence."""
    ends = list(_LAST.finditer(text))
    return ends[-1].end() if ends else len(text)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    n_question: int


@dataclass(frozen=True)
class Shard:
    """Terms by rising upper bound with their postings of (part, impact), and block maxima."""

    terms: np.ndarray  # sorted hashes ...
    term_of: np.ndarray  # ... and the term's number
    bound: np.ndarray
    starts: np.ndarray
    parts: np.ndarray
    impacts: np.ndarray
    block_max: np.ndarray
    block_size: int
    item_of: np.ndarray
    items: dict[int, Item]


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Term counts of all parts: item, part, term, tf, length of the part."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, offsets = word_hashes(part.column("text"))
            ids = part.column("item_id").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for k, item in enumerate(ids):
                words = hashes[offsets[k] : offsets[k + 1]]
                for p in range(0, len(words), PART_WORDS):
                    terms, tf = np.unique(words[p : p + PART_WORDS], return_counts=True)
                    for column, value in zip(rows, (
                        np.full(len(terms), item), np.full(len(terms), p // PART_WORDS), terms.view(np.int64), tf,
                        np.full(len(terms), tf.sum()),
                    )):
                        column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in rows],
                    names=["item_id", "part", "term", "tf", "length"],
                )


def _shard(rows: list, items: dict[int, Item]) -> Shard:
    """An index of the given posting rows, which carry an idf and the mean length of all parts."""
    item, part, term, tf, length, idf, mean = (np.array(c) for c in zip(*rows))
    keys, number = np.unique(np.stack([item, part]), axis=1, return_inverse=True)
    number = number.reshape(-1)
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    weight = weight / np.bincount(number, weight)[number]
    hashes, place = np.unique(term.astype(np.int64).view(np.uint64), return_inverse=True)
    bound = np.zeros(len(hashes))
    np.maximum.at(bound, place, weight)
    order = np.argsort(bound, kind="stable")
    term_of = np.empty(len(hashes), dtype=np.int64)
    term_of[order] = np.arange(len(hashes))
    posting = np.lexsort((number, term_of[place]))
    own = term_of[place][posting]
    block_size = -(-keys.shape[1] // BLOCKS)
    block_max = np.zeros((len(hashes), BLOCKS), dtype=np.float32)
    np.maximum.at(block_max, (own, number[posting] // block_size), weight[posting])
    return Shard(
        hashes, term_of, bound[order], np.searchsorted(own, np.arange(len(hashes) + 1)),
        number[posting], weight[posting], np.nextafter(block_max, np.float32(2)), block_size, keys[0].astype(np.int64),
        items,
    )


def retrieve(hashes: np.ndarray, offsets: np.ndarray, index: Shard, score: float = SCORE) -> list[tuple[int, int, float]]:
    """(row, item, best score) of all passages of all rows that score at least ``score`` against a part."""
    n_terms, n_parts = len(index.terms), len(index.item_of)
    if not n_terms or not len(hashes):
        return []
    at = np.minimum(np.searchsorted(index.terms, hashes), n_terms - 1)
    known = np.flatnonzero(index.terms[at] == hashes)
    row = np.searchsorted(offsets, known, side="right") - 1
    chunks = np.maximum(-(-np.diff(offsets) // PART_WORDS), 1)
    first_passage = np.concatenate(([0], np.cumsum(chunks)))
    chunk = (known - offsets[row]) // PART_WORDS
    passage = first_passage[row] + chunk
    term = index.term_of[at[known]]
    # A word belongs to the passage that begins in its chunk and to the one before.
    both = np.concatenate((passage, (passage - 1)[chunk > 0])) * n_terms
    keys = np.unique(both + np.concatenate((term, term[chunk > 0])))
    passage, term = keys // n_terms, keys % n_terms
    # Terms of a passage come by rising bound: those whose bounds add up to less than the score open nothing.
    total = np.cumsum(index.bound[term])
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    before = np.concatenate(([0.0], total))[heads]
    own = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(passage))))
    opens = (total - before[own]) * (1 + 1e-9) >= score
    at_posting, owner = spread(index.starts[term[opens]], index.starts[term[opens] + 1])
    pair, inverse = np.unique(own[opens][owner] * n_parts + index.parts[at_posting], return_inverse=True)
    if not len(pair):
        return []
    partial = np.bincount(inverse, index.impacts[at_posting])
    group, part = pair // n_parts, pair % n_parts
    # What the unopened terms can add within the block of the part.
    closed = np.where(opens[:, None], np.float32(0), index.block_max[term])
    rest = np.add.reduceat(closed, heads, axis=0)
    likely = partial + rest[group, part // index.block_size] * (1 + 1e-5) >= score
    group, part = group[likely], part[likely]
    # Full scores of what is left.
    ends = np.append(heads, len(passage))
    place, owner = spread(heads[group], ends[group + 1])
    posting_key = np.repeat(np.arange(n_terms), np.diff(index.starts)) * n_parts + index.parts
    wanted = term[place] * n_parts + part[owner]
    found = np.minimum(np.searchsorted(posting_key, wanted), len(posting_key) - 1)
    value = np.where(posting_key[found] == wanted, index.impacts[found], 0.0)
    full = np.bincount(owner, value, len(group))
    rows = np.searchsorted(first_passage, passage[heads[group]], side="right") - 1
    best: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(full >= score):
        hit = (int(rows[k]), int(index.item_of[part[k]]))
        best[hit] = max(best.get(hit, 0.0), float(full[k]))
    return [(r, i, s) for (r, i), s in sorted(best.items())]


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return out


def overlaps(words: np.ndarray, item: Item) -> tuple[float, float, float]:
    """Shares of the words of question, answer and whole item in five-word windows that the document has too."""
    size = min(WINDOW, len(item.words))
    shared = np.flatnonzero(np.isin(_windows(item.words, size), _windows(words, size)))
    covered = np.zeros(len(item.words), dtype=bool)
    for k in range(size):
        covered[shared + k] = True
    question, answer = covered[: item.n_question], covered[item.n_question :]
    share = [float(part.mean()) if len(part) else 0.0 for part in (question, answer, covered)]
    return share[0], share[1], share[2]


def holds(shares: tuple[float, float, float], item: Item, covered: float, verified: float) -> bool:
    """Whether the shares of ``overlaps`` say that the document holds the item: the whole, and question and answer."""
    both = 0 < item.n_question < len(item.words)
    return shares[2] >= covered and (not both or min(shares[:2]) >= verified)


def _shards(benchmark: DataFrame) -> Iterator[list[Shard]]:
    """Groups of index shards. Document frequencies and the mean length are those of all items."""
    items = benchmark.select("item_id", "text").where("item_id is not null and trim(text) <> ''")
    items = materialise(items.groupBy("item_id").agg(F.max("text").alias("text")), "bench-items")
    rows = materialise(
        items.mapInArrow(_item_rows, "item_id bigint, part bigint, term bigint, tf bigint, length bigint"), "bench-terms"
    )
    parts = rows.select("item_id", "part", "length").distinct()
    n_parts, mean = parts.agg(F.count(F.lit(1)), F.avg("length")).first()
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_parts - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = rows.join(df, "term").select("item_id", "part", "term", "tf", "length", idf, F.lit(mean))
    n_shards = -(-n_parts // SHARD_PARTS)
    group: list[Shard] = []
    for k in range(n_shards):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(n_shards)) == k
        # About SHARD_PARTS parts of PART_WORDS words at most.
        texts = items.where(mine).collect()
        known: dict[int, Item] = {}
        for r in texts:
            cut = question_length(r["text"])
            words, ends = word_hashes(pa.array([r["text"], r["text"][:cut]]))
            known[r["item_id"]] = Item(r["item_id"], words[: ends[1]], int(ends[2] - ends[1]))
        postings = weighed.where(mine).collect()
        if postings:
            group.append(_shard(sorted(postings), known))
        if len(group) == SHARD_GROUP:
            yield group
            group = []
    if group:
        yield group


def contaminated(
    docs: DataFrame, benchmark: DataFrame, score: float = SCORE, covered: float = COVERED, verified: float = VERIFIED
) -> DataFrame:
    """Pairs of documents and test items that they hold: ``docs`` (doc_id, text), ``benchmark`` (item_id, text).

    Result: doc_id, item_id, score (of the best passage), question_overlap,
    answer_overlap, overlap; only pairs whose words are covered to ``covered``
    and, where the item has a question and an answer, each of them to ``verified``.
    A repeated item_id counts with its greatest text; items without id or words
    match nothing, and neither do null or empty texts. Rows that repeat a doc_id
    give their own pairs; a null doc_id comes back as null. Other columns are
    not read. Without items or documents there are no rows.
    """
    schema = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, overlap double"
    result = docs.sparkSession.createDataFrame([], schema)
    for number, group in enumerate(_shards(benchmark)):
        # At most SHARD_GROUP * SHARD_PARTS parts of PART_WORDS words: some 100 MB.
        index = docs.sparkSession.sparkContext.broadcast(group)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    hashes, offsets = word_hashes(part.column("text"))
                    ids = part.column("doc_id")
                    out = []
                    for shard in index.value:
                        for row, item, value in retrieve(hashes, offsets, shard, score):
                            shares = overlaps(hashes[offsets[row] : offsets[row + 1]], shard.items[item])
                            if holds(shares, shard.items[item], covered, verified):
                                out.append((ids[row].as_py(), item, round(value, 6), *shares))
                    if out:
                        columns = list(zip(*out))
                        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(columns, kinds)],
                            names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"],
                        )

        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        result = found if number == 0 else result.unionByName(found)
    return result


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item; rows without doc_id stay."""
    gone = materialise(contaminated(docs, benchmark).select("doc_id").distinct(), "bench-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
