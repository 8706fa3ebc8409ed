"""Alignment of two tokenizers: which ids overlap, how often corpus-wide, and how each document fares by these counts.

Both encoders run once and the ids are written to a table. A first pass aligns
every document and writes the link counts of its task's id pairs. A minimal
perfect hash is built over the distinct pairs, shard by shard: on every level a
key whose position no other key shares takes a bit, the others go on to the next
level, and the number of bits before its own is a key's index. With it the tasks
turn their counts into dense vectors that are summed in a tree. The second pass
aligns the documents again from their ids and looks the counts up by index;
each index is verified by the key stored there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import vocabulary
from tallyframe.llm.hashing import mix, slices, spread
from tallyframe.session import materialise

SLICE_TOKENS = 200_000  # tokens aligned at once; a longer document is a slice of its own
HELD_PAIRS = 1_000_000  # distinct pairs a task counts before it writes them
SHARD_KEYS = 50_000  # pairs hashed by one task
ROUND_KEYS = 2_000_000  # pairs whose index and counts (some 40 MB) are broadcast at once; more take further rounds
SEGMENT = 65_536  # entries of a vector summed as one row
FAN_IN = 16  # vectors summed by one task

_TOKENS = pa.schema([("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_COUNTS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
_SHARD = pa.schema([
    ("shard", pa.int64()), ("n", pa.int64()), ("levels", pa.list_(pa.int32())), ("words", pa.binary()), ("keys", pa.binary()),
])
_VECTOR = pa.schema([("segment", pa.int64()), ("part", pa.int64()), ("counts", pa.binary())])


def id_type(size: int) -> np.dtype:
    """The narrowest number that holds the ids of a vocabulary."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def _ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows one after the other, and how many each row has."""
    kind = id_type(size)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int32)[[column.offset, column.offset + len(column)]]
    raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
    return raw.view(kind).astype(np.int32), sizes


class Decimals:
    """Every id below ``size`` in decimal and a byte for the mark behind it."""

    def __init__(self, size: int) -> None:
        made = [b"%d," % k for k in range(size)]
        self.sizes = np.array([len(d) for d in made], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(made), dtype=np.uint8)


def joined(ids: np.ndarray, vocab: vocabulary.Vocabulary) -> np.ndarray:
    """The bytes of the ids one after the other."""
    return vocab.flat[spread(vocab.starts[ids], vocab.starts[ids + 1])[0]]


def _encoded(batches: Iterator[pa.RecordBatch], file_a, file_b) -> Iterator[pa.RecordBatch]:
    vocab_a, vocab_b = vocabulary.loaded(file_a.value), vocabulary.loaded(file_b.value)
    none = np.zeros(0, np.int32)
    for batch in batches:
        for part in slices(batch, "text"):
            found: tuple[list, list] = ([], [])
            for text in part.column("text").to_pylist():
                a = b = none
                if text:
                    want = (" " + text).encode()
                    a, b = vocab_a.encode(" " + text), vocab_b.encode(text)
                    if joined(a, vocab_a).tobytes() != want or joined(b, vocab_b).tobytes() != want:
                        a = b = none
                found[0].append(a)
                found[1].append(b)
            packed = [
                pa.array([ids.astype(id_type(len(v.lengths))).tobytes() for ids in own], pa.binary())
                for own, v in zip(found, (vocab_a, vocab_b))
            ]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *packed], schema=_TOKENS)


class Aligned:
    """Groups and links of the documents of a slice, computed together: their bytes follow one another."""

    def __init__(self, batch: pa.RecordBatch, lengths_a: np.ndarray, lengths_b: np.ndarray) -> None:
        self.a, self.n_a = _ids(batch.column("a"), len(lengths_a))
        self.b, self.n_b = _ids(batch.column("b"), len(lengths_b))
        ends_a, ends_b = np.cumsum(lengths_a[self.a]), np.cumsum(lengths_b[self.b])
        size = int(ends_a[-1]) if len(ends_a) else 0
        at_a, at_b = np.zeros(size + 1, dtype=bool), np.zeros(size + 1, dtype=bool)
        at_a[ends_a] = at_b[ends_b] = True
        ends = np.flatnonzero(at_a | at_b)
        # Two tokens that overlap share exactly one stretch between neighbouring ends of either side.
        self.link_a = np.cumsum(at_a)[ends] - at_a[ends]
        self.link_b = np.cumsum(at_b)[ends] - at_b[ends]
        common = np.flatnonzero(at_a & at_b)
        before = np.cumsum(at_a & at_b)
        self.group_a, self.group_b = before[ends_a - 1], before[ends_b - 1]
        doc_ends = np.concatenate(([0], ends_a))[np.cumsum(self.n_a)]
        self.link_stops = np.searchsorted(ends, doc_ends, side="right")
        self.group_stops = np.searchsorted(common, doc_ends, side="right")

    def pairs(self) -> np.ndarray:
        """The ids of every link as one number."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b]

    def n_links(self) -> np.ndarray:
        return np.diff(self.link_stops, prepend=0)

    def n_groups(self) -> np.ndarray:
        return np.diff(self.group_stops, prepend=0)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of the links."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[self.link_stops]
        return np.diff(total, prepend=0)

    def texts(self, words_a: Decimals, words_b: Decimals) -> list[bytes]:
        """The groups of every document: ids of one side, ``|``, ids of the other, ``;`` between groups."""
        groups = int(self.group_stops[-1]) if len(self.group_stops) else 0
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        # A token's place: the tokens of its own side before it, and those of the other side in the groups before.
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        count = len(self.a) + len(self.b)
        starts, sizes = np.empty(count, np.int64), np.empty(count, np.int64)
        starts[place_a], starts[place_b] = words_a.starts[self.a], words_b.starts[self.b] + len(words_a.flat)
        sizes[place_a], sizes[place_b] = words_a.sizes[self.a], words_b.sizes[self.b]
        out = np.concatenate((words_a.flat, words_b.flat))[spread(starts, starts + sizes)[0]]
        stops = np.cumsum(sizes)
        last_a = np.cumsum(in_a) + np.cumsum(in_b) - in_b - 1
        out[stops[last_a] - 1] = ord("|")
        out[stops[np.cumsum(in_a) + np.cumsum(in_b) - 1] - 1] = ord(";")
        doc_stops = np.concatenate(([0], stops))[np.cumsum(self.n_a + self.n_b)]
        raw, start, found = out.tobytes(), 0, []
        for stop in doc_stops.tolist():
            found.append(raw[start : max(start, stop - 1)])
            start = stop
        return found


def _token_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = pc.add(pc.binary_length(batch.column("a")), pc.binary_length(batch.column("b")))
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + 2 * SLICE_TOKENS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return found, total


def _pair_counts(batches: Iterator[pa.RecordBatch], lengths) -> Iterator[pa.RecordBatch]:
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for part in _token_slices(batch):
            found, n = np.unique(Aligned(part, *lengths.value).pairs(), return_counts=True)
            keys.append(found)
            counts.append(n)
            if sum(map(len, keys)) > HELD_PAIRS:
                merged = _merged(keys, counts)
                if len(merged[0]) > HELD_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged], schema=_COUNTS)
                    merged = merged[0][:0], merged[1][:0]
                keys, counts = [merged[0]], [merged[1]]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(keys, counts)], schema=_COUNTS)


def _position(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(keys.view(np.uint64) ^ salt) % np.uint64(sizes) if np.isscalar(sizes) else
            mix(keys.view(np.uint64) ^ salt) % sizes.astype(np.uint64)).astype(np.int64)


def hash_shard(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: words of each level, all words, and the keys in the order of their index."""
    left, levels, words, order = np.sort(keys), [], [], []
    while len(left):
        n_words = -(-2 * len(left) // 64)
        at = _position(left, len(levels), n_words * 64)
        single = np.bincount(at, minlength=n_words * 64) == 1
        placed = single[at]
        order.append(left[placed][np.argsort(at[placed])])
        words.append(np.packbits(single, bitorder="little").view(np.uint64))
        levels.append(n_words)
        left = left[~placed]
    none = [np.zeros(0, np.int64)]
    return levels, np.concatenate(words or [np.zeros(0, np.uint64)]), np.concatenate(order or none)


def _hashed(key: tuple, table: pa.Table) -> pa.Table:
    levels, words, keys = hash_shard(table.column("pair").to_numpy())
    row = {"shard": key[0].as_py(), "n": len(keys), "levels": levels, "words": words.tobytes(), "keys": keys.tobytes()}
    return pa.Table.from_pylist([row], schema=_SHARD)


class PairIndex:
    """The minimal perfect hash of some shards, with the keys and, once known, the counts."""

    def __init__(self, shards: list[dict], n_shards: int) -> None:
        self.n_shards = n_shards
        self.slot = np.full(n_shards, -1, np.int32)
        depth = max(len(s["levels"]) for s in shards)
        self.start = np.zeros((depth, len(shards)), np.int64)
        self.size = np.zeros((depth, len(shards)), np.int64)
        at = 0
        for k, shard in enumerate(shards):
            self.slot[shard["shard"]] = k
            for level, n_words in enumerate(shard["levels"]):
                self.start[level, k], self.size[level, k] = at, n_words * 64
                at += n_words
        self.words = np.frombuffer(b"".join(s["words"] for s in shards), np.uint64)
        self.keys = np.frombuffer(b"".join(s["keys"] for s in shards), np.int64)
        bits = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(bits) - bits
        self.counts: np.ndarray | None = None
        self.best: np.ndarray | None = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key; -1 for a key that is not here."""
        out = np.full(len(keys), -1, np.int64)
        slot = self.slot[keys % self.n_shards].astype(np.int64)
        open_ = np.flatnonzero(slot >= 0)
        for level in range(len(self.start)):
            open_ = open_[self.size[level, slot[open_]] > 0]
            if not len(open_):
                break
            own = slot[open_]
            at = _position(keys[open_], level, self.size[level, own])
            word = self.start[level, own] + (at >> 6)
            bit = np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word[hit]] & (bit[hit] - np.uint64(1)))
            out[open_[hit]] = self.before[word[hit]] + below
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[self.keys[out[found]] != keys[found]]] = -1
        return out


def _vectors(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    own = index.value
    vector = np.zeros(len(own.keys), np.int64)
    for batch in batches:
        at = own.find(batch.column("pair").to_numpy())
        np.add.at(vector, at[at >= 0], batch.column("n").to_numpy()[at >= 0])
    part = TaskContext.get().partitionId()
    for segment in range(-(-len(vector) // SEGMENT)):
        piece = vector[segment * SEGMENT : (segment + 1) * SEGMENT]
        if piece.any():
            yield pa.RecordBatch.from_pylist([{"segment": segment, "part": part, "counts": piece.tobytes()}], schema=_VECTOR)


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = None
    for counts in table.column("counts"):
        own = np.frombuffer(counts.as_buffer(), np.int64)
        total = own.copy() if total is None else total + own
    row = {"segment": key[0].as_py(), "part": key[1].as_py(), "counts": total.tobytes()}
    return pa.Table.from_pylist([row], schema=_VECTOR)


def _tree_sum(partial: DataFrame, index) -> DataFrame:
    """The dense vector of all counts, in segments: one vector for each task, summed ``FAN_IN`` at a time."""
    parts = partial.rdd.getNumPartitions()
    vectors = partial.mapInArrow(lambda batches: _vectors(batches, index), "segment bigint, part bigint, counts binary")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("segment", "part").applyInArrow(
            _added, "segment bigint, part bigint, counts binary"
        )
    return materialise(vectors, "align-counts")


def _looked_up(
    batches: Iterator[pa.RecordBatch], index, lengths, with_texts: bool, with_groups: bool
) -> Iterator[pa.RecordBatch]:
    own = index.value
    words = [Decimals(len(x)) for x in lengths.value] if with_texts else []
    for batch in batches:
        for part in _token_slices(batch):
            found = Aligned(part, *lengths.value)
            at = own.find(found.pairs())
            here = at >= 0
            counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
            counts[here], best[here] = own.counts[at[here]], own.best[at[here]]
            columns = {
                "row": part.column("row"), "doc_id": part.column("doc_id"),
                "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups(), "n_links": found.n_links(),
                "n_best": found.per_document(best), "count_sum": found.per_document(counts),
            }
            if words:
                texts = found.texts(*words)
                columns["groups_sha256"] = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                if with_groups:
                    columns["groups"] = [t.decode() for t in texts]
            yield pa.RecordBatch.from_pydict(columns)


def _encode(docs: DataFrame, path_a: str | None, path_b: str | None):
    spark = docs.sparkSession
    files = tuple(
        spark.sparkContext.broadcast(vocabulary.file_bytes(path or vocabulary.public_path(name)))
        for path, name in ((path_a, "byte_bpe_50k.json"), (path_b, "piece_bpe_32k.model"))
    )
    vocabs = [vocabulary.loaded(f.value) for f in files]
    lengths = spark.sparkContext.broadcast(tuple(v.lengths for v in vocabs))
    tokens = docs.select("doc_id", "text").mapInArrow(
        lambda batches: _encoded(batches, *files), "doc_id bigint, a binary, b binary"
    )
    tokens = materialise(tokens.withColumn("row", F.monotonically_increasing_id()), "align-tokens")
    partial = materialise(
        tokens.select("a", "b").mapInArrow(lambda batches: _pair_counts(batches, lengths), "pair bigint, n bigint"),
        "align-pairs",
    )
    return vocabs, lengths, tokens, partial


def _shards(partial: DataFrame) -> tuple[DataFrame, Column, int]:
    distinct = materialise(partial.select("pair").distinct(), "align-distinct")
    n_shards = max(1, distinct.count() // SHARD_KEYS) | 1  # odd, so that both ids of a pair decide
    shard = F.pmod(F.col("pair"), F.lit(n_shards))
    hashed = distinct.withColumn("shard", shard).groupBy("shard").applyInArrow(
        _hashed, "shard bigint, n bigint, levels array<int>, words binary, keys binary"
    )
    return materialise(hashed, "align-hash"), shard, n_shards


def _rounds(hashed: DataFrame) -> list[tuple[int, int]]:
    """First and last of the shards that are broadcast together, by their number of keys."""
    rounds: list[tuple[int, int]] = []
    held = 0
    for row in hashed.select("shard", "n").orderBy("shard").toLocalIterator():  # a row for each SHARD_KEYS pairs
        if rounds and held + row.n <= ROUND_KEYS:
            rounds[-1] = rounds[-1][0], row.shard
            held += row.n
        else:
            rounds.append((row.shard, row.shard))
            held = row.n
    return rounds


class _Counts:
    """The corpus-wide counts of all pairs, held in tables and loaded a round of shards at a time."""

    def __init__(self, partial: DataFrame) -> None:
        self.spark: SparkSession = partial.sparkSession
        self.hashed, shard, self.n_shards = _shards(partial)
        # A vector is as long as its round has pairs, so a task should have some times as many counts to put in.
        wide = min(partial.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism)
        tasks = max(1, wide, partial.count() // (4 * ROUND_KEYS))
        self.rounds = []
        for first, last in _rounds(self.hashed):
            shared = self.spark.sparkContext.broadcast(self._index(first, last))
            own = partial.where((shard >= first) & (shard <= last)).coalesce(tasks)
            self.rounds.append((first, last, _tree_sum(own, shared)))
            shared.unpersist()

    def _index(self, first: int, last: int) -> PairIndex:
        rows = self.hashed.where((F.col("shard") >= first) & (F.col("shard") <= last)).orderBy("shard")
        return PairIndex(rows.toArrow().to_pylist(), self.n_shards)

    def load(self) -> Iterator[PairIndex]:
        for first, last, vectors in self.rounds:
            index = self._index(first, last)
            index.counts = np.zeros(len(index.keys), np.int64)
            for row in vectors.toLocalIterator():  # at most ROUND_KEYS numbers
                piece = np.frombuffer(row.counts, np.int64)
                index.counts[row.segment * SEGMENT : row.segment * SEGMENT + len(piece)] = piece
            yield index


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """How many links of the corpus hold each pair of ids: a_id, b_id, a_bytes, b_bytes, n_links.

    The plain sum of the first pass; no link is left out.
    """
    vocabs, _, _, partial = _encode(docs, path_a, path_b)
    names = [
        docs.sparkSession.createDataFrame([(k, t) for k, t in enumerate(v.tokens)], f"{s}_id bigint, {s}_bytes binary")
        for v, s in zip(vocabs, "ab")
    ]
    total = partial.groupBy(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"))
    return total.agg(F.sum("n").alias("n_links")).join(names[0], "a_id").join(names[1], "b_id").select(
        "a_id", "b_id", "a_bytes", "b_bytes", "n_links"
    )


def aligned(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """How the ids of two tokenizers cover each row of ``docs`` (doc_id, text).

    ``path_a`` names a byte-level vocabulary, ``path_b`` one of pieces. Result:
    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and
    with ``with_groups`` the groups themselves (``a1,a2|b1;a3|b2``). A null or
    empty text, and one whose bytes either side does not give back, has no
    tokens: zeros and an empty string. Rows that repeat a doc_id, or have none,
    are rows of their own and their links count; of equal counts of a B id all
    are highest. A very long text is aligned whole. An empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    vocabs, lengths, tokens, partial = _encode(docs, path_a, path_b)
    counts = _Counts(partial)
    highest = np.zeros(len(vocabs[1].lengths), np.int64)
    for index in counts.load():
        np.maximum.at(highest, index.keys & 0xFFFFFFFF, index.counts)
    text = ", groups_sha256 string" + (", groups string" if with_groups else "")
    sums = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups]
    if not counts.rounds:  # no document has tokens
        none = [F.lit(0).cast("bigint").alias(n) for n in names[1:7]]
        return tokens.select("doc_id", *none, *[F.lit("").alias(n) for n in names[7:]])
    out: DataFrame | None = None
    for index in counts.load():
        index.best = index.counts == highest[index.keys & 0xFFFFFFFF]
        shared = spark.sparkContext.broadcast(index)
        with_texts = out is None
        found = tokens.mapInArrow(
            lambda batches, shared=shared, with_texts=with_texts: _looked_up(batches, shared, lengths, with_texts, with_groups),
            sums + (text if with_texts else ""),
        )
        if len(counts.rounds) == 1:
            return found.select(*names)
        # Every link is counted in the round of its pair.
        found = materialise(found, "align-round")
        shared.unpersist()
        if out is None:
            out = found
        else:
            more = found.select("row", F.col("n_best").alias("more_best"), F.col("count_sum").alias("more_sum"))
            out = out.join(more, "row").withColumn("n_best", F.col("n_best") + F.col("more_best")).withColumn(
                "count_sum", F.col("count_sum") + F.col("more_sum")
            ).drop("more_best", "more_sum")
            out = materialise(out, "align-round")
    return out.select(*names)
