"""Alignment, packing and the prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyframe.llm import alignment, packing, queries, trie, vocabulary

ODD = [
    None, "", " ", "a", "word", "<|endoftext|> <s> </s> <0x41>", "tab\tand\n\nlines  two", "naïve café 中文字 😀", "a▁b", "ﬁ ½",
    "x" * 5_000, "same text twice", "same text twice", "don't I'll be 123 4567!!", "\x00 \x01", " é",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(vocabulary.public_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary.public_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def vocabs():
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    return [vocabulary.loaded(vocabulary.file_bytes(vocabulary.public_path(n))) for n in names]


def test_encoders(libraries, vocabs, prose, monkeypatch):
    """Ids are those of the libraries, also where a long text is handed over in pieces."""
    rng = random.Random(2)
    texts = [t for t in ODD if t] + [prose(k, 60) for k in range(5)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0xD7FF), 32])) for _ in range(300)) for _ in range(40)]
    for small in (False, True):
        if small:
            monkeypatch.setattr(vocabulary, "LONG_TEXT", 20)
        for text in texts:
            assert vocabs[0].encode(text).tolist() == libraries[0].encode(text, add_special_tokens=False).ids
            assert vocabs[1].encode(text).tolist() == libraries[1].encode(text)
            assert "".join(vocabulary.cut_long(text)) == text
    assert vocabs[1].cuttable and len(list(vocabulary.cut_long(prose(1, 60)))) > 5


def plain_alignment(texts, libraries, vocabs):
    """Every pair of tokens of a document is compared."""
    rows, counts, links = [], Counter(), []
    for text in texts:
        ids, spans = [], []
        if text:
            for lib, vocab, given in zip(libraries, vocabs, (" " + text, text)):
                found = lib.encode(given, add_special_tokens=False).ids if vocab is vocabs[0] else lib.encode(given)
                ids.append(found)
                at, own = 0, []
                for k in found:
                    own.append((at, at + len(vocab.tokens[k])))
                    at = own[-1][1]
                spans.append(own)
            if any(b"".join(v.tokens[k] for k in own) != (" " + text).encode() for v, own in zip(vocabs, ids)):
                ids = []
        if not ids:
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        own = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (t, f) in zip(ids[1], spans[1]) if s < f and t < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        start, groups = 0, []
        for end in ends:
            groups.append("|".join(
                ",".join(str(k) for k, (s, e) in zip(i, sp) if start <= s and e <= end) for i, sp in zip(ids, spans)))
            start = end
        rows.append((len(ids[0]), len(ids[1]), len(ends), ";".join(groups)))
        links.append(own)
        counts.update(own)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (*r[:3], len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own),
         hashlib.sha256(r[3].encode()).hexdigest() if r[3] else "", r[3]) for r, own in zip(rows, links)
    ], counts


@pytest.mark.parametrize("many_rounds", [False, True])
def test_alignment(spark, libraries, vocabs, prose, monkeypatch, many_rounds):
    if many_rounds:
        monkeypatch.setattr(alignment, "SHARD_KEYS", 20)
        monkeypatch.setattr(alignment, "ROUND_KEYS", 90)
        monkeypatch.setattr(alignment, "FAN_IN", 2)
    texts = ODD + [prose(k, 40) for k in range(6)] + ["the cat sat on the mat. " * 9]
    docs = spark.createDataFrame([(k % 9, t, 1, 2) for k, t in enumerate(texts)], "doc_id bigint, text string, row int, a int")
    want, counts = plain_alignment(texts, libraries, vocabs)
    got = alignment.aligned(docs.repartition(5), with_groups=True).collect()
    assert sorted(tuple(r) for r in got) == sorted((k % 9, *r) for k, r in enumerate(want))
    assert want[8][0] == 0 and sum(r[0] > 0 for r in want) > 15
    if not many_rounds:
        table = alignment.pair_counts(docs).collect()
        assert {(r.a_id, r.b_id): r.n_links for r in table} == counts
        assert all(r.a_bytes == vocabs[0].tokens[r.a_id] for r in table)
        empty = alignment.aligned(docs.where("text is null or text = ''")).collect()
        assert len(empty) == 2 and {tuple(r)[1:] for r in empty} == {(0, 0, 0, 0, 0, 0, "")}
        assert alignment.aligned(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 48, n))
    shards = []
    for s in range(3):
        levels, words, order = alignment.hash_shard(keys[keys % 3 == s])
        shards.append({"shard": s, "n": len(order), "levels": levels, "words": words.tobytes(), "keys": order.tobytes()})
    index = alignment.PairIndex(shards, 3)
    assert sorted(index.find(keys)) == list(range(len(keys)))  # minimal and perfect
    other = np.setdiff1d(rng.integers(0, 1 << 48, 1000), keys)
    assert (index.find(other) == -1).all()  # the key at an index is verified
    part = alignment.PairIndex(shards[1:2], 3)
    assert ((part.find(keys) >= 0) == (keys % 3 == 1)).all()


def padding(pieces, capacity):
    total = Counter()
    for p in pieces:
        total[p.sequence_id] += p.length
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in total.values()), sum(total.values())


@pytest.mark.parametrize(("capacity", "cell_rows"), [(1024, 200_000), (16, 1)])
def test_packing(spark, libraries, prose, monkeypatch, capacity, cell_rows):
    """The second case takes several rounds to close its bins."""
    monkeypatch.setattr(packing, "CELL_ROWS", cell_rows)
    workers = 6 if capacity == 1024 else 120
    rng = random.Random(5)
    texts = ODD + [prose(k, rng.randrange(1, 900)) for k in range(60)] + [prose(99, 9_000), prose(1, 7), prose(1, 7)]
    texts += [prose(k, 5) for k in range(300 if capacity == 16 else 0)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id bigint, text string, offset int").repartition(workers)
    pieces = packing.pack(docs, capacity=capacity, waste=capacity // 100, with_ids=True).collect()
    ids = {k: [*libraries[0].encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
        own = np.frombuffer(p.ids, "<u4")
        assert len(own) == p.length > 0 and zlib.crc32(p.ids) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        assert own.tolist() == ids[p.doc_id][p.start : p.start + p.length]
    assert set(of_doc) == set(ids)
    for k, own in of_doc.items():
        assert sum(p.length for p in own) == len(ids[k])
        assert [p.start for p in sorted(own, key=lambda p: p.start)] == np.cumsum([0, *[p.length for p in sorted(own, key=lambda p: p.start)]])[:-1].tolist()
    for own in of_sequence.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= capacity
    lost, total = padding(pieces, capacity)
    assert lost < 0.02 * total
    if capacity == 16:
        assert len({p.sequence_id >> 58 for p in pieces}) >= 3
        whole = packing.sequences(docs, capacity=16, waste=0).collect()
        assert sorted(r.n_tokens for r in whole) == sorted(sum(p.length for p in own) for own in of_sequence.values())
        assert all(len(r.ids) == 4 * r.n_tokens and r.n_pieces == len(r.doc_ids) for r in whole)
        assert packing.pack(docs.limit(0)).count() == 0
        again = spark.createDataFrame([(None, "x"), (1, "x"), (1, "x"), (1, None)], "doc_id bigint, text string")
        assert Counter((r.doc_id, r.length) for r in packing.pack(again).collect()) == {(None, 2): 1, (1, 2): 2, (1, 1): 1}


def test_classes():
    for capacity, waste in ((1024, 10), (1024, 0), (100, 3), (7, 0)):
        for length, made in enumerate(packing.cuts(capacity, waste)):
            assert sum(made) == length
            assert all(capacity - capacity // x * x <= waste or capacity // (capacity // x) == x for x in made)


def plain_trie(sequences):
    nodes = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for node in nodes:
        if node:
            kids[node[:-1]].add(node)
    rows = []
    for node, members in nodes.items():
        under = [x for x in nodes if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in members if len(sequences[c]) == len(node))))
        rows.append((
            min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), len(kids[node]),
            sum(not kids[x] for x in under), sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in under if x),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(rows, key=repr)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        made[c] = own.get(base, [])[:h] + turns[h:]
    return made


@pytest.mark.parametrize("in_task", [50_000, 9, 1])
def test_prefix_trie(spark, monkeypatch, in_task):
    monkeypatch.setattr(trie, "IN_TASK", in_task)
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "CELL", 4)
    rng = random.Random(in_task)
    rows = []
    for c in [*range(0, 24), *range(100, 112), 207, 301, 302, -5, -101]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, "ua"[turn % 2], rng.choice(["hi", "ho", "", "é😀"])))
    rows += [(7, 3, None, None), (None, 1, "u", "lost"), (305, 0, "u", "x"), (306, 5, "u", "hi")] + [(8, 40 + k, "u", "deep") for k in range(12)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int")
    turns, members = queries.with_shared_heads(trie.numbered(frame.repartition(3)))
    got = sorted((tuple(r) for r in trie.prefix_trie(turns, members, in_task).collect()), key=repr)
    assert got == plain_trie(plain_rebuilt(rows))
    if in_task == 1:
        assert trie.prefix_trie(*queries.with_shared_heads(trie.numbered(frame.limit(0)))).count() == 0


def test_repeated_turns(spark):
    """Two equal rows of a conversation are two turns; equal conversations share all nodes."""
    rows = [(c, 1, "u", "again") for c in (1, 1, 2, 2, 3)]
    turns = trie.numbered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    nodes = turns.withColumnRenamed("place", "depth")
    got = trie.prefix_trie(nodes, turns.select("conv_id").distinct()).collect()
    assert sorted((r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got) == [(0, 3, 1, 15), (1, 3, 1, 15), (2, 2, 1, 5)]


@pytest.mark.parametrize("shape", ["chain", "star", "random", "forest"])
def test_split_in_task(shape):
    rng, n = np.random.default_rng(3), 3_000
    parent = {
        "chain": np.arange(-1, n - 1), "star": np.array([-1] + [0] * (n - 1)),
        "random": np.array([-1] + [rng.integers(0, k) for k in range(1, n)]),
        "forest": np.array([-1 if k % 50 == 0 else rng.integers(k - k % 50, k) for k in range(n)]),
    }[shape]
    values = rng.integers(0, 100, (n, 2))
    members = rng.integers(1, 9, n)
    depth, want, weight = np.zeros(n, np.int64), values.copy(), members.copy()
    for k in range(n):
        depth[k] = 0 if parent[k] < 0 else depth[parent[k]] + 1
    for k in range(n - 1, -1, -1):
        if parent[k] >= 0:
            want[parent[k]] += want[k]
            weight[parent[k]] += weight[k]
    assert (trie.split_in_task(parent, depth, weight, values) == want).all()
