"""Quality rules, URL filter, mixing, toxicity, scores, chat and decontamination on small tables."""

import json
import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

from tallyframe.llm import chat, decontaminate, lm_score, mixing, quality, toxicity, url_filter
from tallyframe.llm.hashing import word_hashes


def test_quality(spark, prose):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a\u00a0b", "one two three four five " * 3, "x\n\nx\ny\nx", "a b c d e a b c d e f g h i j k l",
             "w " * 3000, prose(1, 12)]
    texts += ["".join(rng.choice("ab #|\n!A") for _ in range(rng.randrange(0, 90))) for _ in range(150)]
    docs = spark.createDataFrame([(k, t, True) for k, t in enumerate(texts)], "doc_id bigint, text string, kept boolean")
    rows = quality.quality(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain.quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    kept = quality.keep_good(docs.unionByName(docs)).collect()
    assert sorted(r.doc_id for r in kept) == sorted([r.doc_id for r in rows if r.kept] * 2)
    assert set(kept[0].asDict()) == {"doc_id", "text", "kept"} and quality.quality(docs.limit(0)).count() == 0


def test_url_rules(spark):
    urls = {
        "http://A.Net/x": ("a.net", "/x", "net/", "block"), "https://example.net/en/1?q#f": (
            "example.net", "/en/1", "example.net/en/", "allow"),
        "http://net": ("net", "", None, "allow"), "http://b.example.com/de/9": (
            "b.example.com", "/de/9", "example.com/de/", "block"),
        "http://x.org/fr/a#b": ("x.org", "/fr/a", "org/fr/", "allow"), "xnet/": ("", "", None, "allow"),
        "x://y?://z/": ("y", "", None, "allow"), None: ("", "", None, "allow"), "http://example.network/": (
            "example.network", "/", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id bigint, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_url_templates(spark):
    """Labelled pages of one template spread to its other pages, not to the siblings that differ."""
    rows = [(k, f"http://h.org/spam/{k}") for k in range(40)] + [(k, f"http://h.org/news/{k}") for k in range(40, 80)]
    labels = [(k, 1) for k in range(20)] + [(k, 0) for k in range(40, 60)] + [(3, None), (None, 1), (3, 1)]
    got = url_filter.url_filter(
        spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, bad int")
    ).collect()
    assert len(got) == 80
    assert {r.verdict for r in got if "spam" in r.path} == {"block"}
    assert {r.verdict for r in got if "news" in r.path} == {"allow"}
    assert {r.template for r in got} == {"h.org/spam/*", "h.org/news/*"}


def plain_templates(rows, o=url_filter.TreeOptions()):
    """page_id -> (template, purity) by recursion, from (page_id, host, segments, bad)."""
    out = {}

    def split(rows, template, level):
        groups, n = {}, Counter(r[2][level] if level < len(r[2]) else "/" for r in rows)
        for r in rows:
            seg = r[2][level] if level < len(r[2]) else "/"
            literal = seg == "/" or n[seg] >= o.min_rows and n[seg] >= o.min_share * len(rows)
            groups.setdefault(seg if literal else "*", []).append(r)
        facts = []
        for name, members in groups.items():
            known = [r[3] for r in members if r[3] is not None]
            facts.append(((sum(known) + 1) / (len(known) + 2), name, len(known), sum(known)))
        runs = []
        for share, name, n_known, n_bad in sorted(facts):
            if runs:
                last_share, _, n0, k0 = runs[-1][-1]
                p = (n_bad + k0 + 1) / (n_known + n0 + 2)
                near = abs(share - last_share) <= o.z * math.sqrt(p * (1 - p) * (1 / (n_known + 2) + 1 / (n0 + 2)))
                if near:
                    runs[-1].append((share, name, n_known, n_bad))
                    continue
            runs.append([(share, name, n_known, n_bad)])
        for run in runs:
            names = sorted(f[1] for f in run)
            members = [r for name in names for r in groups[name]]
            purity = (sum(f[3] for f in run) + 1) / (sum(f[2] for f in run) + 2)
            shown = [name.replace("/", "") for name in names]
            here = template + ("/{" + "|".join(shown) + "}" if len(names) > 1 else "/" + shown[0] if shown[0] else "")
            going = []
            for r in members:
                if level >= len(r[2]) or len(members) < o.min_rows:
                    out[r[0]] = (here, purity)
                else:
                    going.append(r)
            if going:
                split(going, here, level + 1)

    for host in {r[1] for r in rows}:
        split([r for r in rows if r[1] == host], host, 0)
    return out


def test_url_tree_at_every_depth(spark):
    """Branches merge at each level and urls that differ in their sixth segment are told apart, as by plain recursion."""
    rng = random.Random(8)
    rows, labels = [], []

    def add(host, path, bad):
        rows.append((len(rows), f"http://{host}{path}"))
        if bad is not None:
            labels.append((len(rows) - 1, bad))

    for k in range(60):
        for branch in ("ads", "promo"):  # alike in all labels: one branch, so what one lacks the other gives
            add("a.org", f"/{branch}/x/{k}", 1 if branch == "ads" or k < 20 else None)
        add("a.org", f"/news/x/{k}/", 0)
        add("a.org", f"/b/c/d/e/{k}/{'spam' if k % 2 else 'ok'}", k % 2 if k < 40 else None)
    for k in range(300):
        path = "/".join(rng.choice(["p", "q", "r", "", str(rng.randrange(50))]) for _ in range(rng.randrange(8)))
        add(rng.choice(["b.org", "c.org"]), "/" + path, rng.choice([0, 1, 1, None]))
    pages = spark.createDataFrame(rows + rows[:5], "page_id bigint, url string")
    got = url_filter.url_filter(pages, spark.createDataFrame(labels, "page_id bigint, bad int"), rules=()).collect()
    known = dict(labels)
    listed = [
        (i, url.split("/")[2], path.split("/") if (path := re.sub("^/|/+$", "", url.split(".org")[1])) else [], known.get(i))
        for i, url in rows + rows[:5]
    ]
    want = plain_templates(listed)
    assert len(got) == len(rows) + 5
    assert {(r.page_id, r.template) for r in got} == {(i, t) for i, (t, _) in want.items()}
    assert all(abs(r.purity - want[r.page_id][1]) < 1e-12 for r in got)
    assert {r.template for r in got if "/promo/" in r.path} == {"a.org/{ads|promo}/x/*"}
    deep = {(r.path.endswith("spam"), r.verdict) for r in got if r.path.startswith("/b/c/d") and r.host == "a.org"}
    assert deep == {(True, "block"), (False, "allow")}


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, fixed = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in fixed)
        open_weight = sum(weight[s] for s in names if s not in fixed)
        target = {s: 3.0 * sizes[s] if s in fixed else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in fixed and target[s] > 3 * sizes[s]}
        if not above:
            return target
        fixed |= above


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 7)
    rng = random.Random(2)
    rows = [(k, "w " * rng.choice([1, 3, 40, 200]), rng.choice(["a", "b", "é", "tiny", None])) for k in range(400)]
    rows = [(d, t, s if s != "tiny" or d < 30 else "a") for d, t, s in rows] + [(1000, None, "a"), (1001, "", "void")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, target int")
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {d: len(plain.words(t)) for d, t, _ in rows}
    sizes = {}
    for d, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[d]
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for d, _, s in rows:
        r = got[d]
        assert (r.size, r.source_size) == (size[d], sizes[s]) and math.isclose(r.target, want[s], abs_tol=1e-6)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3, s
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {d: r.taken for d, r in got.items()}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id bigint, text string, source string")
    assert sorted((str(r.doc_id), r.size, r.target, r.taken) for r in mixing.mix(docs).collect()) == [
        ("1", 0, 0.0, 0), ("None", 0, 0.0, 0)]


def test_toxicity(spark, prose):
    import zlib

    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        bad = rng.random() < 0.3
        words = prose(k, 40).split(" ")
        if bad:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(["Grumblor", "snarkwit"])
        rows.append((k, " ".join(words), bad))
        labels.append((k, 1, int(bad)))
    labels += [(1, 1, None), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame(rows + [(None, None, False), (7777, "", False)], "doc_id bigint, text string, score boolean")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == 402
    right = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is None or r.doc_id == 7777:
            assert r.predicted == 0
            continue
        held = zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held
        right += held and rows[r.doc_id][2] == bool(r.predicted)
    assert right >= 0.97 * sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(400))
    # Without labels of both classes nothing is toxic.
    assert toxicity.toxicity(docs, known.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.toxicity(docs.limit(0), known).count() == 0


def test_toxicity_features():
    """Hits are the distinct n-grams within each text, whatever the neighbours."""
    texts = ["abcdefgh", None, "Abcdéx", "", "ab", "abcdefgh"]
    rows, features = toxicity._hits(pa.array(texts), None)
    assert np.bincount(rows, minlength=6).tolist() == [12, 0, 9, 0, 0, 12]
    assert (features[rows == 0] == features[rows == 5]).all()
    alone = toxicity._hits(pa.array(["Abcdéx"]), None)[1]
    assert sorted(alone) == sorted(features[rows == 2])


def test_lm_scores(spark, prose):
    rng = random.Random(8)
    cycle = "red green blue white black ".split(" ")[:5]
    rows = [(k, " ".join(cycle[(k + i) % 5] for i in range(60))) for k in range(120)]
    shuffled = rows[0][1].split(" ")
    rng.shuffle(shuffled)
    rows += [(500, " ".join(shuffled)), (501, None), (502, ""), (None, "red"), (503, prose(1, 30))]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, per_token double").repartition(4)
    words = lm_score.vocabulary(docs)
    network = lm_score.train(docs, words, rounds=4)
    got = {r.doc_id: r for r in lm_score.scored(docs, words, network).collect()}
    assert len(got) == len(rows)
    for d, text in rows:  # the sum over tokens, one at a time
        hashes, _ = word_hashes(pa.array([text]))
        tokens, inside = words.classes(hashes)
        total = 0.0
        for k, token in enumerate(tokens):
            around = [tokens[j] if 0 <= j < len(tokens) else lm_score.PAD for j in (k - 2, k - 1, k + 1, k + 2)]
            total += network.log_probability(np.array([around]), np.array([token]))[0] + inside[k]
        assert got[d].n_tokens == len(tokens) and math.isclose(got[d].log_probability, total, rel_tol=1e-3, abs_tol=1e-3)
    assert got[0].per_token > got[500].per_token  # order counts
    assert got[501].per_token is None and got[502].log_probability == 0
    assert lm_score.lm_scores(docs.limit(0)).count() == 0


def test_lm_counts_every_word_by_itself(spark, monkeypatch):
    """Words that are not known to every task are scored by their own counts, and one that was never seen by half a count."""
    texts = [" ".join(f"w{k}" for k in range(j, 700, j + 1)) for j in range(5)] + [None, "w1 w1 w699"]
    docs = spark.createDataFrame([(k % 6, t) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    counts = Counter(w for t in texts if t for w in t.split(" "))
    few = lm_score.vocabulary(docs)
    monkeypatch.setattr(lm_score, "KNOWN", 300)
    cut = lm_score.vocabulary(docs)
    network = lm_score.Network.initial(few.class_counts)
    others = {r.word: r.inside for r in cut.others.collect()}
    assert len(others) > 100 and few.others.count() == 0 and (few.class_counts == cut.class_counts).all()
    for word, n in counts.items():
        hashes = word_hashes(pa.array([word]))[0]
        (place,), (inside,) = few.classes(hashes)
        assert (place,) == tuple(cut.classes(hashes)[0])
        want = math.log(n / few.class_counts[place]) if place >= lm_score.OWN_CLASSES else 0.0
        found = others[int(hashes.view(np.int64)[0])] if n * 300 < sum(counts.values()) and place >= lm_score.OWN_CLASSES else inside
        assert math.isclose(inside, want, abs_tol=1e-12) and math.isclose(found, want, abs_tol=1e-12)
    more = docs.unionByName(spark.createDataFrame([(9, "never-seen")], "doc_id bigint, text string"))
    whole, parted = (
        sorted((str(r.doc_id), r.n_tokens, round(r.log_probability, 6)) for r in lm_score.scored(more, w, network).collect())
        for w in (few, cut)
    )
    assert whole == parted and len(whole) == len(texts) + 1


def test_lm_trains_on_every_token(spark, prose, monkeypatch):
    """Over the rounds of one training, each token of each document is a target once, with its own neighbours."""
    from types import SimpleNamespace

    texts = ["red", None, "", "green blue", prose(1, 3), *[prose(("t", k), k) for k in range(1, 80)]]
    words = lm_score.vocabulary(spark.createDataFrame([(t,) for t in texts], "text string"))
    met = []
    monkeypatch.setattr(lm_score.Network, "step", lambda self, around, target, memory: met.extend(
        (*a, t) for a, t in zip(np.asarray(around).tolist(), target.tolist())))
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    shared = SimpleNamespace(value=(words, lm_score.Network.initial(words.class_counts).values()))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    trained = sum(
        out.column("weight")[0].as_py()
        for number in range(lm_score.ROUNDS) for out in lm_score._trainer(shared, number)(iter([batch]))
    )
    want = []
    for text in texts:
        tokens = words.classes(word_hashes(pa.array([text], pa.string()))[0])[0].tolist()
        row = [lm_score.PAD] * 2 + tokens + [lm_score.PAD] * 2
        want += [(row[k], row[k + 1], row[k + 3], row[k + 4], row[k + 2]) for k in range(len(tokens))]
    assert sorted(met) == sorted(want) and trained == len(want)


def test_network_learns():
    """Gradients by finite differences."""
    counts = np.ones(lm_score.CLASSES)
    net = lm_score.Network.initial(counts)
    around, target = np.array([[1, 2, 3, 4], [5, 6, 7, lm_score.PAD]]), np.array([9, 11])
    before = net.log_probability(around, target).sum()
    memory = [np.full(s, 1e-4, np.float32) for s in lm_score._SHAPES]
    for _ in range(30):
        net.step(around, target, memory)
    assert net.log_probability(around, target).sum() > before + 5



@pytest.mark.parametrize("size", [0.1, 3.0])
def test_network_step_is_the_softmax_gradient(size):
    """One step against the gradient in 64 bits, for weights below and above the limit of sums of exponentials."""
    rng = np.random.default_rng(5)
    start = rng.normal(0, size, sum(int(np.prod(s)) for s in lm_score._SHAPES))
    net = lm_score.Network(start)
    assert (np.abs(net.top).sum(axis=0).max() > 40) == (size > 1) and np.shares_memory(net.top, net.parts[3])
    around, target = rng.integers(0, lm_score.CLASSES + 1, (40, 4)), rng.integers(0, lm_score.CLASSES, 40)
    table, inner, inner_bias, outer, outer_bias = (p.astype(np.float64) for p in net.parts)
    seen = table[around].reshape(40, -1)
    hidden = np.tanh(seen @ inner + inner_bias)
    logits = hidden @ outer + outer_bias
    slope = np.exp(logits - logits.max(axis=1, keepdims=True))
    slope /= slope.sum(axis=1, keepdims=True)
    slope[np.arange(40), target] -= 1
    slope /= 40
    back = (slope @ outer.T) * (1 - hidden**2)
    in_table = np.zeros_like(table)
    np.add.at(in_table, around, (back @ inner.T).reshape(40, 4, -1))
    memory = [np.full(s, 1e-4, np.float32) for s in lm_score._SHAPES]
    net.step(around, target, memory)
    for past, want in zip(memory, (in_table, seen.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
        assert np.allclose(past, 1e-4 + want**2, rtol=1e-3, atol=1e-7)


def test_lm_known_words_of_one_prefix():
    """Words whose hashes begin alike are told apart, the last prefix and its end included."""
    top = (1 << 64) - 1
    known = np.array([1, 2, 5, 1 << 63, (1 << 63) + 7, top - 1, top], np.uint64)
    words = lm_score.Vocabulary(known, np.arange(7), -np.arange(7.0), np.ones(lm_score.CLASSES), None)
    asked = np.array([5, 2, 1, 0, 3, (1 << 63) + 7, 1 << 63, top, top - 1, top - 2, 5], np.uint64)
    classes, inside = words.classes(asked)
    for word, c, share in zip(asked.tolist(), classes, inside):
        at = known.tolist().index(word) if word in known.tolist() else None
        assert c == (lm_score.OWN_CLASSES + word % lm_score.SHARED_CLASSES if at is None else at)
        assert np.isnan(share) if at is None else share == -at
    assert len(words.classes(asked[:0])[0]) == 0


TOOLS = {"add": {"type": "object", "properties": {"x": {"type": "integer"}, "y": {}}, "required": ["x"],
                 "additionalProperties": False}}


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(of, content="ok"):
    return json.dumps({"content": content, "tool_call_id": of})


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "add", {"x": 1}))), (1, 7, "tool", result("a")),
        (1, 3, "assistant", call(("b", "add", {"x": 2, "y": {"$ref": "a"}}))), (1, 4, "tool", result("b")),
        (1, 5, "assistant", call(("c", "sub", {}), ("d", "add", {"x": "1", "z": 0}))), (1, 6, "tool", result("zz")),
        (2, 1, "tool", result("a")), (2, 2, "assistant", call(("a", "add", {"x": 1}))),
        (2, 3, "assistant", call(("a", "add", {"x": {"$ref": "q"}}))),
        (None, 1, "assistant", call(("a", "add", {"x": 1}))), (3, None, None, None), (3, 1, "assistant", "{not json"),
        (3, 1, "assistant", "{not json"), (4, 1, "assistant", '{"tool_calls": [3, {"id": "k", "name": "add", "arguments": "{\\"x\\": 1}"}]}'),
        (4, 2, "assistant", '{"tool_calls": [], "x": 1e999}'), (4, 3, "tool", '{"tool_call_id": "\\ud800"}'),
    ]
    messages = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, at int")
    got = chat.format_chat(messages, TOOLS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    order = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.at, r.depth, r.turn))
    assert [r.turn for r in order] == [0, 1, 5, 6, 7, 3, 4]  # b uses a's late result
    assert by[1, 1].n_linked == 1 and by[1, 1].errors == ""
    assert by[1, 5].n_calls == 2 and "0: unknown tool; no result" in by[1, 5].errors and "$.z: unknown" in by[1, 5].errors
    assert by[1, 6].errors == "no call" and by[1, 6].n_linked == 0
    assert (by[2, 1].at, by[2, 1].depth) == (2, 1)  # a result before its call goes behind it
    assert "repeated id" in by[2, 3].errors and "reference to no earlier call" in by[2, 3].errors
    assert by[None, 1].n_linked == 0 and by[3, None].at is None and by[3, 1].kind == "message"
    assert "no id" in by[4, 1].errors and by[4, 2].kind == by[4, 3].kind == "message"
    for r in got:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert chat.format_chat(messages.limit(0), TOOLS).count() == 0


@pytest.mark.parametrize("parts", [4096, 2])
def test_decontaminate(spark, prose, monkeypatch, parts):
    monkeypatch.setattr(decontaminate, "SHARD_PARTS", parts)
    monkeypatch.setattr(decontaminate, "SHARD_GROUP", 2)
    items = {k: prose(("item", k), n) + ". " + prose(("answer", k), 6) for k, n in enumerate([10, 30, 50, 150, 60, 20])}
    items[10] = "tiny item"
    rows = [(k, prose(("doc", k), 200)) for k in range(30)]
    rows += [(100 + k, prose(("a", k), 37 * k) + " " + t.upper() + "\n" + prose(("b", k), 90)) for k, t in items.items()]
    words = items[1].split(" ")
    words[12] = "changed"
    rows += [(200, " ".join(words)), (201, " ".join(words[:12])), (202, None), (203, ""), (None, items[2])]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, item_id int")
    bench = [(k, t) for k, t in items.items()] + [(20, None), (None, "x y z"), (21, " "), (0, items[0])]
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(100 + k, k) for k in items} | {(200, 1), (None, 2)}
    clean = decontaminate.without_leaks(docs, benchmark).collect()
    assert sorted(str(r.doc_id) for r in clean) == sorted(
        str(d) for d, _ in rows if d is None or d < 100 or d > 200)
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0


def test_question_without_answer(spark, prose):
    """A question that stands without its answer, or with another one, is no leak; nor is the answer alone."""
    question, answer, other = prose(("q", 1), 40), prose(("a", 1), 8), prose(("a", 2), 8)
    docs = spark.createDataFrame([
        (1, f"{prose(1, 30)} {question}. {answer}"), (2, f"{question}. {other}"), (3, f"{question} {prose(3, 90)}"),
        (4, f"{answer} {prose(4, 90)}"), (5, f"{question}. {answer} {question}. {other}"),
    ], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, f"{question}. {answer}"), (8, prose("other", 30))], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(1, 7), (5, 7)}
    loose = decontaminate.contaminated(docs, benchmark, verified=0.0).where("item_id = 7").collect()
    assert {r.doc_id for r in loose} == {1, 2, 3, 5}


def test_retrieval_is_whole(prose):
    """Every passage and part above the score, as by scoring all against all."""
    from collections import Counter

    rng = random.Random(9)
    pool = [prose(("w", k), 1) for k in range(60)]
    items = [[rng.choice(pool) for _ in range(rng.randrange(3, 64))] for _ in range(40)]
    hashed = [word_hashes(pa.array([" ".join(t)]))[0] for t in items]
    df = Counter(t for h in hashed for t in set(h.view(np.int64)))
    mean = float(np.mean([len(h) for h in hashed]))
    rows = []
    for k, h in enumerate(hashed):
        for term, tf in zip(*np.unique(h.view(np.int64), return_counts=True)):
            rows.append((k, 0, int(term), int(tf), len(h), math.log(1 + (40 - df[term] + 0.5) / (df[term] + 0.5)), mean))
    index = decontaminate._shard(sorted(rows), {})
    texts = pa.array([" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 400))) for _ in range(60)])
    hashes, offsets = word_hashes(texts)
    want = {}
    weight = {}
    for k, _, term, tf, length, idf, _ in rows:
        weight[k, term] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    own = Counter()
    for (k, _), w in weight.items():
        own[k] += w
    for r in range(60):
        text = hashes[offsets[r] : offsets[r + 1]].view(np.int64)
        for at in range(0, len(text), 64):
            terms = set(text[at : at + 128])
            for k in range(40):
                s = sum(weight.get((k, t), 0) for t in terms) / own[k]
                if s >= 0.6:
                    want[r, k] = max(want.get((r, k), 0), s)
    got = {(r, k): s for r, k, s in decontaminate.retrieve(hashes, offsets, index)}
    assert got.keys() == want.keys() and want and all(math.isclose(got[x], want[x]) for x in want)


@pytest.mark.parametrize("around", [chat.DEPTH, 5_000, 10_000])
def test_chat_depth(around):
    """Depth never ends a job: beyond the limit an object is plain text, as a message and as a string of arguments."""
    for depth in range(around - 4, around + 5):
        deep = '{"a":' + "[" * (depth - 1) + "]" * (depth - 1) + "}"
        for arguments in (json.dumps(deep), deep):
            text = '{"tool_calls": [{"id": "c", "name": "f", "arguments": ' + arguments + "}]}"
            kind, _, content, calls = chat.parse("assistant", text, {"f": {"type": "object"}})
            assert json.dumps(text)[:9] and chat.canonical(content)
            if arguments == deep:  # three levels around the arguments
                assert kind == ("call" if depth + 3 <= chat.DEPTH else "message")
            else:
                assert (calls[0]["error"] is None) == (depth <= chat.DEPTH)
    assert chat._object('{"a": "[[[[{{{{ \\\\ \\" [["}') == {"a": '[[[[{{{{ \\ " [['}
