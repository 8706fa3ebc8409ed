"""Harmonic packing of tokenised documents into sequences of bounded length.

Lengths fall into reciprocal classes: a piece of class k is at most 1/k and more
than 1/(k+1) of the capacity, and a bin of class k holds exactly k pieces. Every
worker fills bins of its own from the documents it reads, so no document moves.
Only the pieces of bins that stayed open, at most k - 1 for each class and
worker, move on: cells of them are filled in the same way in ever fewer groups,
until one small group is left, which is closed by cutting at the capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import vocabulary
from tallyframe.llm.hashing import slices
from tallyframe.session import materialise

CAPACITY = 1024
END = 0  # the id after each document
WASTE = 10  # tokens of a bin that may stay empty before a piece is rather cut to its class
CELL_ROWS = 200_000  # pieces of open bins filled by one task; they average some tens of tokens
EMIT_ROWS = 20_000

Piece = tuple  # doc_id, start, length, ids_crc32, doc_tokens, ids (bytes)

_COLUMNS = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary, sequence_id bigint, offset bigint"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


@lru_cache(maxsize=8)
def cuts(capacity: int, waste: int) -> list[tuple[int, ...]]:
    """For each length below the capacity the lengths it is cut into.

    A length stays whole if a bin of its class is filled but for ``waste``;
    otherwise the largest reciprocal share that it holds is cut off first.
    """
    made: list[tuple[int, ...]] = [()]
    for length in range(1, capacity):
        k = capacity // length
        share = capacity // (k + 1)
        whole = capacity - k * length <= waste or share == 0
        made.append((length,) if whole else (share, *made[length - share]))
    return made


def pieces_of(ids: np.ndarray, capacity: int, waste: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces of one document."""
    start, whole = 0, len(ids) // capacity * capacity
    while start < whole:
        yield start, ids[start : start + capacity]
        start += capacity
    for length in cuts(capacity, waste)[len(ids) - whole]:
        yield start, ids[start : start + length]
        start += length


def open_pieces(capacity: int) -> int:
    """The most pieces that the open bins of one worker hold: a class is short of one at least."""
    return sum(k - 1 for k in {capacity // length for length in range(1, capacity + 1)})


class Bins:
    """One open bin for each class; ``add`` gives back a bin that is full."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.open = capacity, {}

    def add(self, piece: Piece) -> list[Piece] | None:
        k = self.capacity // piece[2]
        held = self.open.setdefault(k, [])
        held.append(piece)
        return self.open.pop(k) if len(held) == k else None

    def rest(self) -> Iterator[Piece]:
        for held in self.open.values():
            yield from held


def _placed(pieces: list[Piece], sequence_id: int, with_ids: bool) -> Iterator[tuple]:
    offset = 0
    for piece in pieces:
        yield (*(piece if with_ids else (*piece[:5], None)), sequence_id, offset)
        offset += piece[2]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def _piece(doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> Piece:
    raw = ids.tobytes()
    return doc_id, start, len(ids), zlib.crc32(raw), doc_tokens, raw


def _first_fill(batches: Iterator[pa.RecordBatch], file, capacity: int, waste: int, with_ids: bool):
    encode = vocabulary.loaded(file.value).encode
    bins, rows = Bins(capacity), []
    next_id = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in slices(batch, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.append(encode(text or ""), END).astype("<u4")
                for start, own in pieces_of(ids, capacity, waste):
                    full = bins.add(_piece(doc_id, start, own, len(ids)))
                    if full:
                        rows.extend(_placed(full, next_id, with_ids))
                        next_id += 1
                        if len(rows) >= EMIT_ROWS:
                            yield _batch(rows)
                            rows = []
    rows.extend((*piece, None, None) for piece in bins.rest())
    yield _batch(rows)


def closed(pieces: list[Piece], capacity: int) -> Iterator[list[Piece]]:
    """The last few pieces joined and cut at the capacity; what is left over is cut into powers of two."""
    left = sum(p[2] for p in pieces)
    sizes = [capacity] * (left // capacity)
    sizes += [1 << k for k in range((left % capacity).bit_length() - 1, -1, -1) if left % capacity >> k & 1]
    queue = list(reversed(pieces))
    for size in sizes:
        held: list[Piece] = []
        while size:
            piece = queue.pop()
            if piece[2] > size:
                ids = np.frombuffer(piece[5], "<u4")
                queue.append(_piece(piece[0], piece[1] + size, ids[size:], piece[4]))
                piece = _piece(piece[0], piece[1], ids[:size], piece[4])
            held.append(piece)
            size -= piece[2]
        yield held


def _next_fill(turn: int, capacity: int, with_ids: bool, last: bool):
    def fill(key: tuple, table: pa.Table) -> pa.Table:
        """Bins of one cell; in a fixed order, so a task that runs again gives the same bins."""
        own = zip(*(table.column(name).to_pylist() for name in _SCHEMA.names[:6]))
        pieces = sorted(own, key=lambda p: (-p[2], p[0] is None, p[0] or 0, *p[1:]))
        bins, rows = Bins(capacity), []
        next_id = (turn << 58) | (key[0].as_py() << 33)
        for piece in pieces:
            full = bins.add(piece)
            if full:
                rows.extend(_placed(full, next_id, with_ids))
                next_id += 1
        if last:
            for held in closed(list(bins.rest()), capacity):
                rows.extend(_placed(held, next_id, with_ids))
                next_id += 1
        else:
            rows.extend((*piece, None, None) for piece in bins.rest())
        return pa.Table.from_batches([_batch(rows)])

    return fill


def pack(
    docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, waste: int = WASTE, with_ids: bool = False
) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    ``path`` names a vocabulary file. A document's ids are those of its whole
    text and an end id. Result, a row for each piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and with ``with_ids`` the piece's
    ids (little-endian unsigned 32-bit). Sequence ids are unique but not dense.
    A null or empty text is a document of the end id alone; rows that repeat a
    doc_id, or have none, are documents of their own; pieces of equal length may
    take each other's place, but each id is in exactly one piece. An empty table
    has no pieces. A very long text is many pieces of the whole capacity. Other
    columns are not read.
    """
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(vocabulary.file_bytes(path or vocabulary.public_path("byte_bpe_50k.json")))
    made = materialise(
        docs.select("doc_id", "text").mapInArrow(
            lambda batches: _first_fill(batches, file, capacity, waste, with_ids), _COLUMNS
        ),
        "pack-pieces",
    )
    # A cell leaves at most so many pieces open, so every round shrinks them.
    cell_rows = max(CELL_ROWS, 4 * open_pieces(capacity))
    parts, turn, cells = [made.where("sequence_id is not null")], 0, 0
    while cells != 1:
        turn += 1
        rest = made.where("sequence_id is null")
        left = rest.count()
        cells = max(1, -(-left // cell_rows))
        cell = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(turn)), F.lit(cells))
        fill = _next_fill(turn, capacity, with_ids, cells == 1)
        made = materialise(
            rest.withColumn("cell", cell).groupBy("cell").applyInArrow(fill, _COLUMNS), "pack-pieces"
        )
        parts.append(made.where("sequence_id is not null"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if with_ids else out.drop("ids")


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, waste: int = WASTE) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, n_pieces, ids (as in ``pack``), doc_ids in order."""
    pieces = pack(docs, path, capacity, waste, with_ids=True)
    # At most ``capacity`` pieces in a sequence.
    held = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), held.alias("held"))
    return grouped.select(
        "sequence_id", "n_tokens", F.size("held").alias("n_pieces"),
        F.aggregate("held", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])).alias("ids"),
        F.transform("held", lambda p: p["doc_id"]).alias("doc_ids"),
    )
