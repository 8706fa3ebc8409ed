"""Components against all pairs, with hot groups and with bounds so small that large nodes branch."""

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

from tallyframe.llm import hashing, near_dup


def edited(text, n, seed):
    rng = random.Random(str(seed))
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture
def texts(prose):
    rng = random.Random(3)
    passage = prose("passage", 40)
    out = [None, "", "  ", "One two", "one TWO", "one two three", "a b c d e", "a b c d e", "É b c d e", "é b c d e"]
    out += [prose(("own", k), rng.randrange(5, 120)) for k in range(40)]
    out += [passage + " " + prose(("with", k), 60) for k in range(60)]
    base = prose("base", 150)
    out += [edited(base, rng.randrange(0, 9), ("edit", k)) for k in range(120)]
    out += [prose("copy", 80)] * 50
    chain = prose("chain", 100).split(" ")
    out += [" ".join(chain[k : k + 60]) for k in range(0, 40, 4)]
    return dict(enumerate(out, 100))


@pytest.mark.parametrize("bounds", [(8, 4096), (1, 20), (1, 0)])
def test_components(spark, texts, monkeypatch, bounds):
    monkeypatch.setattr(near_dup, "PER_ROW", bounds[0])
    monkeypatch.setattr(near_dup, "NODE_DOCS", bounds[1])
    docs = spark.createDataFrame(
        [(d, t, d % 7, "x") for d, t in texts.items()], "doc_id bigint, text string, node int, comp string"
    )
    want = plain.components(texts)
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_shingles == len(plain.shingles(texts[r.doc_id]))
        assert (r.doc_id, r.component_id) == (r.doc_id, want[r.doc_id])
        assert r.kept == (r.doc_id == want[r.doc_id])


def test_odd_rows(spark):
    text = "one two three four five six"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()),
                 key=str)
    assert got == sorted(
        [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 2, None, True), (None, 0, None, True)], key=str)
    kept = near_dup.keep_firsts(docs.selectExpr("*", "1 as kept")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted(
        (str(d), str(t)) for d, t in rows if d != 2)
    empty = docs.limit(0)
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_firsts(empty).count() == 0


def test_contracted(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(1000, 1040)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(7, 7)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in near_dup.contracted(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got.get(n, n) == r for n, r in label.items())


def test_long_words_and_blocks(monkeypatch):
    """Block cuts change no hash: any block size gives the words of plain Python."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \t\nÉ") for _ in range(rng.randrange(0, 300))) for _ in range(50)] + ["x" * 999, None]
    whole = hashing.word_hashes(pa.array(texts))
    assert list(np.diff(whole[1])) == [len(plain.words(t)) for t in texts]
    names = {}
    for h, w in zip(whole[0], [w for t in texts for w in plain.words(t)]):
        assert names.setdefault(h, w) == w
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(hashing, "BLOCK_BYTES", 37)
    again = hashing.word_hashes(pa.array(texts))
    assert (again[0] == whole[0]).all() and (again[1] == whole[1]).all()
