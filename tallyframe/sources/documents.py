"""XML and JSON documents as records, each file by its own structure.

XML is cut behind every ``>`` and read block by block, many pieces at once by one
expression, and those it does not take one by one. A block does not know what
is open where it begins, so it gives a summary that holds whatever comes before:
for every lexical state at its start the state at its end, the elements it closes
beyond its own, those it leaves open, and how often each path starts in it. The
summaries of a file, taken in order, say where every block begins; the path
counts then say which elements are records, and a second scan cuts these out.
A file that is no larger than a block is one row instead, and one pass over its
text both counts the paths and keeps where their elements lie.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import few_listing_tasks, materialise, scratch_path, small_batches

# Fixed value: element names that stand for rows, the first of them first.
RECORD_TAGS = ("record", "row", "item", "entry")
FEW_BLOCKS = 100_000  # up to so many rows of one per block or file are broadcast
WHOLE_FILE = 8 << 20  # bytes of a file that is read as one row, at most
MANY_SHAPES = 10_000  # a task keeps so many shapes of records in mind
FILE = "__file"  # the attribute, and then the column, that holds a record's file

Path = tuple[str, ...]

# -- Lexing XML ------------------------------------------------------------

TEXT, COMMENT, CDATA, INSTRUCTION, DOUBLE, SINGLE = STATES = "t", "c", "d", "p", '"', "'"
_CLOSERS = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?"}
_NAMESPACE = re.compile(r"""\s+xmlns(:[^\s=]*)?\s*=\s*("[^"]*"|'[^']*')""", re.ASCII)
_OPEN_QUOTE = re.compile(r"""[^"']*+(?:(?:"[^"]*+"|'[^']*+')[^"']*+)*+(["'])?""")
_INSIDE = r"""[^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+"""  # of a tag, with quoted values
_TAG_END = re.compile(f"{_INSIDE}>")
# What begins with "<" and is whole: an end tag (1), a tag (2) with its inside (3), a comment, a section or an
# instruction. Anything else matches with all the text behind it (4) and is left to ``step``.
_TOKEN = re.compile(
    rf"""(?s)<(?:/([^\s/<>]++)[^<>]*+>|([^\s/<>!?"'][^\s/<>"']*+)(?=[\s/>])({_INSIDE})>"""
    r"|!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>|(.*))"
)


def _open_quote(tag: str) -> str:
    """The quote that is open at the end of a tag's text, or TEXT."""
    return _OPEN_QUOTE.match(tag)[1] or TEXT


def local_name(tag: str) -> str:
    return re.split(r"[\s/]", tag, maxsplit=1)[0].split(":")[-1]


def step(state: str, piece: str) -> tuple[str, str, str]:
    """The state behind a piece, what happened, and the element's name.

    Happenings: ``open``, ``empty`` (opened and closed), ``close``, ``shut`` (an
    element opened in an earlier piece turns out empty), ``bad``, or nothing.
    """
    if state in _CLOSERS:
        return (TEXT if piece.endswith(_CLOSERS[state]) else state), "", ""
    if state in (DOUBLE, SINGLE):
        end = piece.find(state)
        after = _open_quote(piece[end + 1:]) if end >= 0 else state
        return after, ("shut" if after == TEXT and piece.endswith("/") else ""), ""
    at = piece.find("<")
    if at < 0:
        return TEXT, "", ""
    tag = piece[at + 1:]
    if tag.startswith("!--"):
        return (TEXT if tag[3:].endswith("--") else COMMENT), "", ""
    if tag.startswith("![CDATA["):
        return (TEXT if tag[8:].endswith("]]") else CDATA), "", ""
    if tag.startswith("?"):
        return (TEXT if tag[1:].endswith("?") else INSTRUCTION), "", ""
    if tag.startswith("!") or not tag:
        return TEXT, "bad", tag
    if tag.startswith("/"):
        return TEXT, "close", local_name(tag[1:])
    after = _open_quote(tag)
    return after, ("empty" if after == TEXT and tag.endswith("/") else "open"), local_name(tag)


def leave(state: str, text: str, at: int) -> tuple[str, int]:
    """Where whole pieces leave a state that is not TEXT, or their end and the state there."""
    if state in _CLOSERS:
        closer = _CLOSERS[state] + ">"
        end = text.find(closer, at)
        return (TEXT, end + len(closer)) if end >= 0 else (state, len(text))
    end = text.find(state, at)
    if end < 0:
        return state, len(text)
    if found := _TAG_END.match(text, end + 1):
        return TEXT, found.end()
    return _open_quote(text[end + 1:]), len(text)


def state_after(state: str, text: str) -> str:
    """The state behind whole pieces."""
    at = 0
    while at < len(text):
        if state != TEXT:
            state, at = leave(state, text, at)
            continue
        found = _TOKEN.findall(text, at)
        if not found or not found[-1][3]:
            return TEXT
        at = len(text) - len(found[-1][3]) - 1
        end = text.find(">", at)
        state, at = step(TEXT, text[at:end])[0], end + 1
    return state


class Summary:
    """What a block does, for one state at its start and any elements open there."""

    def __init__(self, state: str) -> None:
        self.ends = {s: s for s in STATES}
        self.start = self.state = state
        self.closed: list[str] = []
        self.open: list[str] = []
        self.paths: Counter[tuple[int, Path]] = Counter()
        self.problem: str | None = None

    def read(self, piece: str) -> None:
        reached = {s: step(s, piece)[0] for s in set(self.ends.values())}
        self.ends = {s: reached[now] for s, now in self.ends.items()}
        self.state, happened, name = step(self.state, piece)
        self._note(happened, name)

    def read_text(self, text: str) -> None:
        """Whole pieces at once, each with its ``>``."""
        reached = {s: state_after(s, text) for s in set(self.ends.values()) - {self.state}}
        began = self.state
        self._read_text(text)
        reached[began] = self.state
        self.ends = {s: reached[now] for s, now in self.ends.items()}

    def _read_text(self, text: str) -> None:
        at = 0
        while at < len(text):
            if self.state != TEXT:
                was = self.state
                self.state, at = leave(was, text, at)
                if self.state == TEXT and was not in _CLOSERS and text[at - 2] == "/":
                    self._note("shut", "")
                continue
            found = _TOKEN.findall(text, at)
            rest = found.pop()[3] if found and found[-1][3] else ""
            for end_tag, tag, inside, _ in found:
                if end_tag:
                    self._note("close", end_tag.rpartition(":")[2])
                elif tag:
                    self._note("empty" if inside.endswith("/") else "open", tag.rpartition(":")[2])
            if not rest:
                return
            at = len(text) - len(rest) - 1
            end = text.find(">", at)
            self.state, happened, name = step(TEXT, text[at:end])
            self._note(happened, name)
            at = end + 1

    def row(self, file: str, start: int, first: int) -> dict:
        return {
            "file": file, "start": start, "first": first, "state": self.start, "ends": "".join(self.ends[s] for s in STATES),
            "closed": self.closed, "open": self.open, "problem": self.problem,
            "paths": [{"closed": c, "path": list(p), "n": n} for (c, p), n in self.paths.items()],
        }

    def _note(self, happened: str, name: str) -> None:
        if happened in ("open", "empty"):
            self.paths[len(self.closed), (*self.open, name)] += 1
        if happened == "open":
            self.open.append(name)
        elif happened in ("close", "shut"):
            if not self.open:
                self.closed.append(name)
            elif self.open.pop() != name and happened == "close":
                self.problem = self.problem or f"end of {name} does not match"
        elif happened == "bad":
            self.problem = self.problem or "DTD or entity declarations are not supported"


_PATH = pa.struct([("closed", pa.int64()), ("path", pa.list_(pa.string())), ("n", pa.int64())])
_BLOCK = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("first", pa.int64()), ("state", pa.string()), ("ends", pa.string()),
    ("closed", pa.list_(pa.string())), ("open", pa.list_(pa.string())), ("paths", pa.list_(_PATH)), ("problem", pa.string()),
])
_BLOCK_DDL = (
    "file string, start bigint, first bigint, state string, ends string, closed array<string>, open array<string>,"
    " paths array<struct<closed: bigint, path: array<string>, n: bigint>>, problem string"
)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, str]]:
    """File and start of each block in a batch, its first row there and its text there, whole pieces."""
    n = batch.num_rows
    if not n:
        return
    file, start = batch.column("file"), batch.column("start")
    other = pc.or_(
        pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1))
    ).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(other) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        pieces = batch.column("value").slice(a, b - a).to_pylist()
        yield (file[a].as_py(), start[a].as_py()), a, ">".join([*pieces, ""])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block; a block's pieces come one after the other."""
    at, first, own = None, 0, Summary(TEXT)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([own.row(*at, first)], schema=_BLOCK)

    for batch in batches:
        for block, row_at, text in _runs(batch):
            if block != at:
                if at:
                    yield row()
                at, first = block, batch.column("line")[row_at].as_py()
                own = Summary(batch.column("state")[row_at].as_py())
            own.read_text(text)
    if at:
        yield row()


def _is_whole(spark: SparkSession) -> Column:
    """Whether a file is read as one row: no larger than a block, and of a size that its name does not hide."""
    block = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    packed = F.col("_metadata.file_name").rlike(r"(?i)\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|lzo|xz)$")
    return (F.col("_metadata.file_size") <= min(block, WHOLE_FILE)) & ~packed


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The text of larger files cut behind every ``>``, with its file, block and place; the low bits of the number count
    a scan's rows."""
    with few_listing_tasks(spark):
        read = spark.read.option("lineSep", ">").text(path)
    return read.where(~_is_whole(spark)).select(
        F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("line"),
    )


def _at_blocks(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces with what is known of their block, in their order."""
    if blocks.count() <= FEW_BLOCKS:
        return pieces.join(F.broadcast(blocks), ["file", "start"])  # keeps the order of the scan
    return pieces.join(blocks, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "line")


def _states(table: pa.Table) -> pa.Table:
    """The state at the start of each block of a file."""
    rows = sorted(table.to_pylist(), key=lambda r: r["start"])
    state, out = TEXT, []
    for r in rows:
        out.append({"file": r["file"], "start": r["start"], "true_state": state})
        state = r["ends"][STATES.index(state)]
    return pa.Table.from_pylist(out, schema=pa.schema([("file", pa.string()), ("start", pa.int64()), ("true_state", pa.string())]))


def record_paths(counts: dict[Path, int], tag: str | None = None) -> list[Path]:
    """The paths whose elements are the records of a file, from how often each path occurs.

    Rows below an element are its children of a record name, else all that
    repeat, else those below its only child with children. A child of the root
    that repeats stands for itself, another for the rows below it. Of all these
    the record names win, then the names that occur more than once. With ``tag``
    all elements of that name are records.
    """
    below: dict[Path, list[Path]] = {}
    for path in counts:
        below.setdefault(path[:-1], []).append(path)
    roots = below.get((), [])
    if not roots:
        return []
    if tag:
        found = [p for p in counts if p[-1] == tag]
    else:
        def rows(at: Path) -> list[Path]:
            while at:
                inner = below.get(at, [])
                ranks = [RECORD_TAGS.index(p[-1].lower()) for p in inner if p[-1].lower() in RECORD_TAGS]
                if ranks:
                    return [p for p in inner if p[-1].lower() == RECORD_TAGS[min(ranks)]]
                if many := [p for p in inner if counts[p] > 1]:
                    return many
                holders = [p for p in inner if p in below]
                at = holders[0] if len(holders) == 1 else ()
            return []

        root = roots[0]
        offered = [p for c in below.get(root, []) for p in ([c] if counts[c] > 1 else rows(c) or [c])]
        totals: Counter[str] = Counter()
        for p in offered:
            totals[p[-1]] += counts[p]
        named = [t for t in RECORD_TAGS if any(p[-1].lower() == t for p in offered)]
        if named:
            found = [p for p in offered if p[-1].lower() == named[0]]
        else:
            found = [p for p in offered if totals[p[-1]] > 1] or rows(root) or [root]
    chosen = set(found)
    return sorted(p for p in chosen if not any(p[:k] in chosen for k in range(1, len(p))))


_PLACED = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("first", pa.int64()), ("state", pa.string()), ("open", pa.list_(pa.string())),
    ("records", pa.list_(pa.list_(pa.string()))), ("problem", pa.string()),
])
_PLACED_DDL = (
    "file string, start bigint, first bigint, state string, open array<string>, records array<array<string>>, problem string"
)


def _placed(tag: str | None):
    def placed(table: pa.Table) -> pa.Table:
        """The elements open at the start of each block of a file, and the paths of the file's records."""
        blocks = sorted(table.to_pylist(), key=lambda r: r["start"])
        stack: list[str] = []
        counts: Counter[Path] = Counter()
        problem, state = None, TEXT
        for b in blocks:
            b["stack"] = list(stack)
            problem = problem or b["problem"]
            for p in b["paths"]:
                counts[(*stack[: len(stack) - p["closed"]], *p["path"])] += p["n"]
            for name in b["closed"]:
                if not stack or stack.pop() != name and name:
                    problem = problem or f"end of {name} does not match"
            stack += b["open"]
            state = b["ends"][STATES.index(b["state"])]
        if not problem and (stack or state != TEXT or not counts):
            problem = "not XML, or cut off"
        found = [] if problem else record_paths(counts, tag)
        return pa.Table.from_pylist([
            {**{c: b[c] for c in ("file", "start", "first", "state")}, "open": b["stack"], "records": [list(p) for p in found],
             "problem": problem} for b in blocks
        ], schema=_PLACED)

    return placed


def _no_rows(spark: SparkSession, ddl: str) -> DataFrame:
    """An empty table that plans leave out."""
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)])


def scan_xml(spark: SparkSession, path: str | Sequence[str], tag: str | None = None) -> DataFrame:
    """Blocks of the files that are not read whole: file, start, first, state, open elements, record paths, and the file's
    problem if it has one."""
    pieces = _pieces(spark, path)
    if pieces.isEmpty():
        return _no_rows(spark, _PLACED_DDL)
    found = materialise(
        pieces.withColumn("state", F.lit(TEXT)).mapInArrow(_summaries, _BLOCK_DDL), "xml-blocks"
    )
    states = found.select("file", "start", "ends").groupBy("file").applyInArrow(
        _states, "file string, start bigint, true_state string"
    )
    # Few blocks begin inside a comment, a section or a quoted value; those are summarised again.
    inside = materialise(states.where(F.col("true_state") != TEXT), "xml-states")
    if inside.limit(1).count():
        again = _at_blocks(pieces, inside.withColumnRenamed("true_state", "state")).mapInArrow(_summaries, _BLOCK_DDL)
        found = materialise(found.join(inside, ["file", "start"], "left_anti").unionByName(again), "xml-blocks")
    return materialise(found.groupBy("file").applyInArrow(_placed(tag), _PLACED_DDL), "xml-places")


# -- Cutting records out ---------------------------------------------------

WHOLE, HEAD, MIDDLE, TAIL = "w", "h", "m", "t"
_PART = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("body", pa.string()), ("new", pa.bool_())
])


class Cutter:
    """Cuts the records out of one block: the attributes, ``>`` and the content of each."""

    def __init__(self, place: dict) -> None:
        self.state, self.open = place["state"], list(place["open"])
        self.records = {tuple(p) for p in place["records"]}
        self.depth = next((k for k in range(1, len(self.open) + 1) if tuple(self.open[:k]) in self.records), 0)
        self.kind = TAIL if self.depth else WHOLE
        self.text: list[str] = []

    def read(self, piece: str) -> Iterator[tuple[str, str]]:
        was = self.state
        self.state, happened, name = step(was, piece)
        if self.depth:
            closing = happened == "close" and len(self.open) == self.depth
            shut = happened == "shut" and len(self.open) == self.depth
            self.text.append(piece[: piece.rfind("<")] if closing else (piece[:-1] if shut else piece) + ">")
        if happened in ("open", "empty"):
            self.open.append(name)
            if not self.depth and tuple(self.open) in self.records:
                tag = piece[piece.find("<") + 1:]
                attributes = tag[len(re.split(r"[\s/]", tag, maxsplit=1)[0]):]
                self.text = [(attributes[:-1] if happened == "empty" else attributes) + ">"]
                self.depth, self.kind = len(self.open), WHOLE
        if happened in ("empty", "close", "shut"):
            if len(self.open) == self.depth:
                yield self.kind, "".join(self.text)
                self.depth, self.text = 0, []
            self.open.pop()

    def read_text(self, text: str) -> Iterator[tuple[str, str]]:
        """Whole pieces at once, each with its ``>``."""
        at = begin = 0  # where to go on, and where the text of an open record that is not yet kept begins
        while at < len(text):
            if self.state != TEXT:
                was = self.state
                self.state, at = leave(was, text, at)
                if self.state == TEXT and was not in _CLOSERS and text[at - 2] == "/":
                    if len(self.open) == self.depth:
                        yield self.kind, "".join([*self.text, text[begin:at - 2], ">"])
                        self.depth, self.text = 0, []
                    self.open.pop()
                continue
            rest = None
            for found in _TOKEN.finditer(text, at):
                which = found.lastindex
                if which == 1:
                    if len(self.open) == self.depth:
                        yield self.kind, "".join([*self.text, text[begin:found.start()]])
                        self.depth, self.text = 0, []
                    self.open.pop()
                elif which == 3:
                    empty = text[found.end() - 2] == "/"
                    if self.depth:
                        if not empty:
                            self.open.append("")  # below a record, names say nothing
                        continue
                    self.open.append(found[2].rpartition(":")[2])
                    if tuple(self.open) in self.records:
                        if empty:
                            yield WHOLE, found[3][:-1] + ">"
                        else:
                            begin, self.text, self.depth, self.kind = found.start(3), [], len(self.open), WHOLE
                    if empty:
                        self.open.pop()
                elif which == 4:
                    rest = found.start()
            if rest is None:
                break
            if self.depth:
                self.text.append(text[begin:rest])
            end = text.find(">", rest)
            yield from self.read(text[rest:end])
            at = begin = end + 1
        if self.depth:
            self.text.append(text[begin:])

    def rest(self) -> Iterator[tuple[str, str]]:
        if self.depth:
            yield (MIDDLE if self.kind == TAIL else HEAD), "".join(self.text)


_ODD = r"\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff"  # not allowed in XML


def _plain(end: str) -> str:
    """Any characters up to one of ``end``, with the entities that every document knows."""
    return rf"[^&{end}{_ODD}]*+(?:&(?:amp|lt|gt|quot|apos);[^&{end}{_ODD}]*+)*+"


# What a record's structure does not depend on, by the character before it: values, comments, sections and texts that are
# plain and, but for comments, not blank.
_PLAIN = {
    '"': rf"""(?![ \t\r\n]*+"){_plain('"<')}(?=")""",
    "'": rf"""(?![ \t\r\n]*+'){_plain("'<")}(?=')""",
    "-": rf"[^\-{_ODD}]*+(?:-(?!-)[^\-{_ODD}]*+)*+(?=-->)",
    "[": rf"(?![ \t\r\n]*+\]\]>)[^\]{_ODD}]*+(?:\](?!\]>)[^\]{_ODD}]*+)*+(?=\]\]>)",
    ">": rf"(?=[ \t\r\n]*+[^< \t\r\n]){_plain(r'<\]')}(?=<|\Z)",
}
# What stands before a plain part (1), which follows, or any other part whole (2), so that nothing in it is taken for more.
_PART_OF_RECORD = re.compile(
    rf"""(?s)([^=<>]*+(?:=[ \t\r\n]*+["']|<!--|<!\[CDATA\[|>))(?:{'|'.join(f'(?<={re.escape(k)}){v}' for k, v in _PLAIN.items())})"""
    r"""|([^=<>]*+(?:=[ \t\r\n]*+(?:"[^"<]*+"|'[^'<]*+')|<!--.*?--(?=>)|<!\[CDATA\[.*?\]\](?=>)|<\?.*?\?(?=>)|>[^<]*+|[=<]))"""
)


def record_shape(body: str) -> str:
    """A record with marks in place of its plain parts; records of one shape have the same structure, but for what
    ``_without_namespaces`` leaves of them."""
    return _PART_OF_RECORD.sub(r"\1\0\2", body)


def _of_one_shape(body: str) -> re.Pattern:
    """Matches the records of a record's shape, in less time than it takes to find that."""
    out, at = ["(?s)"], 0
    for found in _PART_OF_RECORD.finditer(body):
        out += [re.escape(found[1]), _PLAIN[found[1][-1]]] if found[1] else [re.escape(found[2])]
        at = found.end()
    return re.compile("".join([*out, re.escape(body[at:])]))


class Shapes:
    """Tells the first record of each structure; after many structures some are told again."""

    def __init__(self) -> None:
        self.seen: Counter[str] = Counter()
        self.common: list[re.Pattern] = []

    def is_new(self, body: str) -> bool:
        if "xmlns" in body:  # as _without_namespaces has it
            end = body.find(">") + 1
            body = _NAMESPACE.sub("", body[:end]) + body[end:]
        for known in self.common:
            if known.fullmatch(body):
                return False
        shape = record_shape(body)
        if len(self.seen) >= MANY_SHAPES and shape not in self.seen:
            self.seen.clear()
        self.seen[shape] += 1
        if self.seen[shape] == 100 and len(self.common) < 8:
            self.common.append(_of_one_shape(body))
        return self.seen[shape] == 1


# As above, but an element without elements in it is one match with its content (4), and the rest comes as (5).
_ELEMENT = re.compile(
    rf"""(?s)<(?:/([^\s/<>]++)[^<>]*+>|([^\s/<>!?"'][^\s/<>"']*+)(?=[\s/>])({_INSIDE})>"""
    r"(?:(?<!/>)((?:[^<]++|<!\[CDATA\[.*?\]\]>|<!--.*?-->)*+)</\2\s*+>)?+"
    r"|!--.*?-->|!\[CDATA\[.*?\]\]>|\?.*?\?>|(.*))"
)


class Element:
    """A path of a file: the elements below it by name, and where its own elements begin and end."""

    __slots__ = ("path", "below", "begins", "ends")

    def __init__(self, path: Path) -> None:
        self.path, self.below, self.begins, self.ends = path, {}, [], []


def _elements(text: str) -> list[Element] | None:
    """All paths of a text in the order in which they first occur, or nothing if it needs to be read in steps.

    An element begins behind its name. An empty one ends at its slash, given as a negative number.
    """
    at, outer, all_of = Element(()), [], []
    for found in _ELEMENT.finditer(text):
        which = found.lastindex
        if which == 3 or which == 4:
            inner = at.below.get(found[2])
            if inner is None:
                name = found[2].rpartition(":")[2]
                inner = at.below.get(name)
                if inner is None:
                    inner = at.below[name] = Element((*at.path, name))
                    all_of.append(inner)
                at.below[found[2]] = inner  # with its prefix
            inner.begins.append(found.start(3))
            if which == 4:
                inner.ends.append(found.end(4))
            elif text[found.end() - 2] == "/":
                inner.ends.append(2 - found.end())
            else:
                outer.append(at)
                at = inner
        elif which == 1:
            if not outer or at.path[-1] != found[1].rpartition(":")[2]:
                return None
            at.ends.append(found.start())
            at = outer.pop()
        elif which == 5:
            return None
    return None if outer else all_of


def read_whole(text: str, tag: str | None = None) -> tuple[str | None, list[str]]:
    """A file's problem, or its records."""
    text = text if text.endswith(">") else text + ">"
    if elements := _elements(text):
        by_path = {e.path: e for e in elements}
        chosen = [by_path[p] for p in record_paths({p: len(e.begins) for p, e in by_path.items()}, tag)]
        spans = sorted((a, b) for e in chosen for a, b in zip(e.begins, e.ends))
        return None, [text[a:b] if b > 0 else text[a:-b] + ">" for a, b in spans]
    own = Summary(TEXT)
    own.read_text(text)
    place = _placed(tag)(pa.Table.from_pylist([own.row("", 0, 0)], schema=_BLOCK)).to_pylist()[0]
    return place["problem"], [] if place["problem"] else [b for _, b in Cutter(place).read_text(text)]


_WHOLE = pa.schema([("file", pa.string()), ("problem", pa.string()), ("body", pa.string()), ("new", pa.bool_())])


def _read_whole(tag: str | None, problems_only: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            for file, value in zip(batch.column("file"), batch.column("value")):
                problem, found = read_whole(value.as_py(), tag)
                if problem:
                    yield pa.RecordBatch.from_pylist([{"file": file.as_py(), "problem": problem}], schema=_WHOLE)
                elif found and not problems_only:
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([file.as_py()] * n), pa.nulls(n, pa.string()), pa.array(found), pa.array(map(shapes.is_new, found))
                    ], schema=_WHOLE)

    return read


def whole_xml(spark: SparkSession, path: str | Sequence[str], tag: str | None = None, problems_only: bool = False) -> DataFrame:
    """Files that are read whole: file, and either its problem or one of its records, which may be the first of its structure."""
    with few_listing_tasks(spark):
        read = spark.read.text(path, wholetext=True)
    # A mark of the byte order goes where it went when pieces were read: at the start of any of them.
    texts = read.where((F.col("_metadata.file_size") > 0) & _is_whole(spark)).select(
        F.regexp_replace("value", "\ufeff(?<=(?:^|>)\ufeff)", "").alias("value"), F.col("_metadata.file_path").alias("file")
    )
    with small_batches(spark):
        return materialise(
            texts.mapInArrow(_read_whole(tag, problems_only), "file string, problem string, body string, new boolean"),
            "xml-whole", compression="none",
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, own, shapes = None, None, Shapes()

    def rows(block: tuple[str, int], found: list[tuple[str, str]]) -> pa.RecordBatch:
        n = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([block[0]] * n), pa.array([block[1]] * n, pa.int64()), pa.array([k for k, _ in found]), pa.array([b for _, b in found]),
             pa.array([k != WHOLE or shapes.is_new(b) for k, b in found])],
            schema=_PART,
        )

    for batch in batches:
        for block, row_at, text in _runs(batch):
            if block != at:
                if own and (found := list(own.rest())):
                    yield rows(at, found)
                at, own = block, Cutter(json.loads(batch.column("place")[row_at].as_py()))
            if found := list(own.read_text(text)):
                yield rows(block, found)
    if own and (found := list(own.rest())):
        yield rows(at, found)


def _without_namespaces(body: Column) -> Column:
    end = F.locate(">", body)
    bare = F.concat(F.regexp_replace(F.substring(body, F.lit(1), end), _NAMESPACE.pattern, ""), F.substring(body, end + 1, F.length(body)))
    return F.when(F.contains(body, F.lit("xmlns")), bare).otherwise(body)


def as_element(body: Column) -> Column:
    """A record as an element of one name, with an attribute for its file."""
    return F.concat(F.lit(f'<__record {FILE}="-"'), _without_namespaces(body), F.lit("</__record>"))


def xml_shapes(spark: SparkSession, records: DataFrame) -> str | None:
    """Write records of all structures that occur, each in a line; gives the folder, or nothing without records."""
    new = records.where("new").select(F.regexp_replace(as_element(F.col("body")), r"[\r\n]+", " ").alias("value"))
    if new.isEmpty():
        return None
    out = scratch_path(spark, "xml-shapes")
    new.hint("rebalance").write.text(out)
    return out


def xml_records(spark: SparkSession, path: str | Sequence[str], places: DataFrame) -> DataFrame:
    """All records of the files without problem: file, body, and whether it may be the first of its structure.

    A record that reaches over blocks is put together from one part of each.
    """
    known = places.where("problem is null and size(records) > 0").select(
        "file", "start", "first", F.to_json(F.struct("state", "open", "records")).alias("place")
    )
    if known.isEmpty():
        return _no_rows(spark, "file string, body string, new boolean")
    pieces = _at_blocks(_pieces(spark, path), known)
    # Only a block's first piece carries what is known of it, as text: a nested column, null in almost every row, is
    # many times slower on its way to Python.
    parts = materialise(
        pieces.withColumn("place", F.when(F.col("line") == F.col("first"), F.col("place")))
        .select("file", "start", "value", "place")
        .mapInArrow(_cut, "file string, start bigint, kind string, body string, new boolean"),
        "xml-parts", compression="none",
    )
    # At most two rows for each block: the end of a record from before it, and the start of one that goes on behind it.
    crossing = parts.where(F.col("kind") != WHOLE).withColumn("is_head", F.col("kind") == HEAD)
    order = Window.partitionBy("file").orderBy("start", "is_head").rowsBetween(Window.unboundedPreceding, 0)
    crossing = crossing.withColumn("from", F.last(F.when(F.col("is_head"), F.col("start")), True).over(order))
    pieces_of = F.array_sort(F.collect_list(F.struct("start", "is_head", "body")))
    joined = materialise(
        crossing.groupBy("file", "from").agg(F.array_join(F.transform(pieces_of, lambda p: p["body"]), "").alias("body"))
        .select("file", "body", F.lit(True).alias("new")), "xml-joined")
    return parts.where(F.col("kind") == WHOLE).select("file", "body", "new").unionByName(joined)


# -- JSON documents --------------------------------------------------------


def record_place(text: str | None) -> tuple[str, list[str]]:
    """What a document is, and the keys that lead to its first list of records, in the document's own order.

    Kinds: ``records`` (a list of objects at the keys), ``values`` (a list of
    anything else), ``object``, ``value``, ``bad``.
    """
    try:
        # A constant is no JSON to a strict reader.
        made = json.loads((text or "").lstrip("﻿"))
    except (ValueError, RecursionError):
        return "bad", []

    def is_records(value: object) -> bool:
        return isinstance(value, list) and all(isinstance(x, dict) for x in value)

    if isinstance(made, list):
        return ("records" if is_records(made) else "values"), []
    if not isinstance(made, dict):
        return "value", []
    # Depth first without recursion: the pairs still to look at, the next one last.
    left = [([k], v) for k, v in reversed(made.items())]
    while left:
        keys, value = left.pop()
        if is_records(value):
            return "records", keys
        if isinstance(value, dict):
            left += [([*keys, k], v) for k, v in reversed(value.items())]
    return "object", []


@F.pandas_udf(T.StructType([T.StructField("kind", T.StringType()), T.StructField("keys", T.ArrayType(T.StringType()))]))
def _places(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([record_place(t) for t in texts], columns=["kind", "keys"])


def scan_json(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row for each document: file, value (its text), kind, keys."""
    with few_listing_tasks(spark):
        read = spark.read.text(path, wholetext=True)
    whole = read.select(
        F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("file")
    )
    found = whole.withColumn("place", _places("value")).select("file", "value", "place.kind", "place.keys")
    return materialise(found, "json-documents")


def json_records(spark: SparkSession, documents: DataFrame) -> str:
    """Write the records of all documents as JSON lines ``{"f": file, "r": record}``; gives the folder."""
    listed = documents.where("kind in ('records', 'values')")
    at = F.aggregate("keys", F.col("value"), lambda text, key: F.element_at(F.from_json(text, "map<string,string>"), key))
    # A list of values keeps its elements as they stand, strings in quotes, by way of VARIANT.
    records = listed.where("kind = 'records'").select("file", F.explode(F.from_json(at, "array<string>")).alias("r"))
    values = listed.where("kind = 'values'").select(
        "file", F.explode(F.from_json("value", "array<variant>")).alias("v")).select("file", F.to_json("v").alias("r"))
    single = documents.where("kind in ('object', 'value')").select("file", F.col("value").alias("r"))
    out = scratch_path(spark, "json-records")
    quoted = F.to_json(F.struct(F.col("file").alias("f")))
    # A line holds one record, so breaks between its parts become blanks.
    line = F.concat(F.rtrim(quoted, F.lit("}")), F.lit(',"r":'), F.regexp_replace("r", r"[\r\n]+", " "), F.lit("}"))
    records.unionByName(values).unionByName(single).select(line.alias("value")).write.text(out)
    return out
