"""Secret scan: fixed patterns, and literals judged by the names that they are assigned to.

A small lexer reads whatever looks like an assignment in source code or
configuration (``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``name := other``, joined strings) into name-literal pairs, follows names that
are assigned to other names, and scores each literal by the most sensitive name
that it reaches.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyframe.llm.hashing import slices

# Fixed patterns; the letters of the first group's words match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "literal")

# How strongly a part of a name says that its value is secret.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "secrets": 3.0, "token": 2.5,
    "apikey": 3.0, "privatekey": 3.0, "accesskey": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 1.5,
    "bearer": 2.0, "private": 1.0, "access": 0.5, "api": 1.0, "key": 1.5, "salt": 1.5, "signature": 1.0, "pin": 1.0,
}
STRONG_NAME = 2.5  # names from this weight on stand for secrets by themselves
_HEX_LONG = re.compile(r"[0-9a-f]{32,}")
# A name with an operator behind it. Names start where no name character stands before, or after the dashes of a
# command-line option, -D or the dot of a field, and the quantifiers are possessive, so text without assignments
# is passed over in one walk.
_TARGET = re.compile(
    r"""(?<![A-Za-z0-9_$.-])(?:-D(?=[A-Za-z_$])|[.-]++)?+(["'])?([A-Za-z_$][A-Za-z0-9_$.-]*+)(?(1)\1\]?+)[\x20\t]*+"""
    r"""(:=|=>|\?\?=|\|\|=|=(?!=)|:(?![:/]))[\x20\t]*+"""
)
# A type between the colon and the literal of a declaration, ``name: type = literal``.
_TYPE = re.compile(
    r"""([A-Za-z_$][A-Za-z0-9_$.]*+)(?:[\[<][^\[\]<>\n"'=]*+[\]>])?(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_$][A-Za-z0-9_$.]*+)*+[\x20\t]*+=(?![=>])[\x20\t]*+"""
)
# Values without an operator: XML elements, and the settings of container files.
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*+)(?:\s[^<>]*+)?>\s*+([^<>\s](?:[^<>]*[^<>\s])?)\s*+</\1\s*>")
_SETTING = re.compile(r"""^[\x20\t]*+(?:ENV|setenv)[\x20\t]++([A-Za-z_][A-Za-z0-9_]*+)[\x20\t]++["']?+([^\s"'=][^\s"']*+)""", re.M)
# Triple quotes come first: what they hold may have line breaks and single quotes.
_TRIPLE = r"{q}{q}{q}([^{q}\\]*+(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*+)*+){q}{q}{q}"
_STRING = re.compile(
    r"""(?:[A-Za-z]{1,2}(?=["'`]))?(?:""" + _TRIPLE.format(q='"') + "|" + _TRIPLE.format(q="'") + r"""|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`)"""
)
_JOIN = re.compile(r"[\x20\t]*+[+][\x20\t]*+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*+")
_BARE = re.compile(r"[^\s\"'`,;&|{}()\[\]<>]++")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class Pair:
    """A target name, and where the literal or the name at its right side stands."""

    name: str
    start: int
    end: int
    is_name: bool


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns. Matches that are too short are dropped, not tried again."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_LONG.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def _strings(text: str, name: str, string: re.Match) -> Iterator[Pair]:
    """Strings and names joined by plus signs: "a" + "b" + other."""
    while string is not None:
        group = string.lastindex
        begin, end = string.span(group)
        if group <= 2:  # triple quotes: the line breaks beside the quotes are layout
            value = string[group]
            begin += len(value) - len(value.lstrip())
            end = begin + len(value.strip())
        yield Pair(name, begin, end, False)
        plus = _JOIN.match(text, string.end())
        if plus is None:
            return
        string = _STRING.match(text, plus.end())
        other = _NAME.match(text, plus.end()) if string is None else None
        if other:
            yield Pair(name, other.start(), other.end(), True)


def pairs(text: str) -> list[Pair]:
    """All name-literal and name-name pairs. The type of a declaration is no value that names share."""
    found, declared, types = [], [], set()
    first = run = stop = 0  # the run of bare characters read last, and where it ends without its last dots

    def values(name: str, at: int) -> list[Pair]:
        nonlocal first, run, stop
        string = _STRING.match(text, at)
        if string:
            return list(_strings(text, name, string))
        if not first <= at < run:
            bare = _BARE.match(text, at)
            if not bare:
                return []
            first, run = bare.span()
            stop = run
            while stop > at and text[stop - 1] == ".":
                stop -= 1
        end = max(at, stop)
        word = _NAME.match(text, at, end)
        return [Pair(name, at, end, bool(word) and word.end() == end)]

    for m in _TARGET.finditer(text):
        here = values(m[2], m.end())
        if m[3] != ":":
            found += here
            continue
        declared += here
        kind = _TYPE.match(text, m.end())
        if kind:
            types.add(kind[1])
            found += values(m[2], kind.end())
    found += [p for p in declared if not (p.is_name and text[p.start : p.end] in types)]
    for pattern in (_ELEMENT, _SETTING):
        found += [Pair(m[1], *m.span(2), False) for m in pattern.finditer(text)]
    return found


def sensitivity(name: str) -> float:
    """Sum of the weights of a name's parts, of single ones and of neighbours written together."""
    parts = [p.lower() for p in _CAMEL.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    return sum(NAME_WEIGHTS.get(p, 0.0) for p in parts) + sum(NAME_WEIGHTS.get(p, 0.0) for p in joined)


def bits(value: str) -> float:
    """Shannon bits per character."""
    if not value:
        return 0.0
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def score(value: str, name_score: float) -> float:
    """Name sensitivity plus how random the literal looks; short and plain-word literals lose.

    Blanks count against a literal only where the name alone does not say that it is secret.
    """
    if not value or name_score <= 0:
        return 0.0
    mixed = any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    lost = 0.5 * max(0, 6 - len(value)) + (1.5 if value.isalpha() else 0.0)
    if " " in value and name_score < STRONG_NAME:
        lost += 2.0
    return name_score + 0.5 * (bits(value) - 2.5) + 0.4 * mixed - lost


def literal_spans(text: str, threshold: float = 2.5) -> list[tuple[int, int, str]]:
    """Literals whose best-scoring target, after constants are propagated, reaches the threshold."""
    found = pairs(text)
    if not found:
        return []
    # A literal given to a name also belongs to every name that this name is given to. From the most
    # sensitive name on, each name settles those that lead to it, so every name is visited once.
    givers: dict[str, list[str]] = {}
    weights: dict[str, float] = {}
    for p in found:
        if p.is_name:
            givers.setdefault(p.name, []).append(text[p.start : p.end])
        if p.name not in weights:
            weights[p.name] = sensitivity(p.name)
    best: dict[str, float] = {}
    for name in sorted(weights, key=weights.__getitem__, reverse=True):
        todo = [name]
        while todo:
            here = todo.pop()
            if here not in best:
                best[here] = weights[name]
                todo += givers.get(here, ())
    literals = (p for p in found if best[p.name] > 0 and not (p.is_name and text[p.start : p.end] in weights))
    return sorted(
        {(p.start, p.end, "literal") for p in literals if score(text[p.start : p.end], best[p.name]) >= threshold}
    )


def _joined(spans: list[tuple[int, int, str]]) -> str:
    spans = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str, int]:
    """Base counts, digest of the base spans, all spans, and the number of added literals."""
    text = text or ""
    base = base_spans(text)
    added = literal_spans(text)
    counts = Counter(kind for _, _, kind in base)
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    return counts["assign"], counts["access"], counts["hex"], digest, _joined(base + added), len(added)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [scan(text.as_py()) for text in part.column("text")]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])


def secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every row of ``docs`` (doc_id, text), each text read whole where it lies.

    ``spans`` lists kind:start:end in code points by start, then kind; the base
    kinds are always there, ``literal`` spans are the ones that the lexer adds.
    A null text is empty and has no spans; null and repeated doc_ids come back
    row by row; other columns are not read; no rows give no rows. A chain of
    names is followed inside one text only, and a cycle of names ends.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _scanned,
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_literal bigint",
    )
