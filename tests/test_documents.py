"""XML and JSON documents against the parsers of the standard library."""

import copy
import json
import random
from collections import Counter
from xml.etree import ElementTree

import pyarrow as pa
import pytest

from tallyframe.sources import documents as D
from tallyframe.sources import readers as R


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def counted(text):
    counts = Counter()

    def walk(element, path):
        path = (*path, element.tag.split("}")[-1])
        counts[path] += 1
        for child in element:
            walk(child, path)

    walk(ElementTree.fromstring(text), ())
    return counts


def random_xml(rng, size):
    """Nested elements with all that may hide a ``>``."""
    def element(depth):
        name = rng.choice("abc")
        attribute = rng.choice(["", " k='x>y'", ' k="1" m = "&lt;/a> \'q\'"', " n='\"'"])
        if rng.random() < 0.3:
            return f"<{name}{attribute}/>"
        inner = "".join(content(depth + 1) for _ in range(rng.randrange(0, 5))) if depth < 5 else "t"
        return f"<{name}{attribute}>{inner}</{name} >"

    def content(depth):
        kind = rng.random()
        if kind < 0.6:
            return element(depth)
        return rng.choice(["x > y", "<!-- <a> > -> -->", "<![CDATA[ <b> ]] > ]]>", "<?p a > b?>", "\n word ", "<!---->"])

    return "<?xml version='1.0'?>\n<!-- > --><root>" + "".join(content(1) for _ in range(size)) + "</root>\n"


def in_blocks(text, cuts):
    pieces = text.split(">")
    if not pieces[-1]:
        pieces.pop()
    bounds = [0, *sorted(cuts), len(pieces)]
    return [pieces[a:b] for a, b in zip(bounds, bounds[1:]) if a < b]


@pytest.mark.parametrize("seed", range(25))
def test_blocks_compose(seed):
    """Wherever a text is cut into blocks, their summaries give its path counts and its records."""
    rng = random.Random(seed)
    text = random_xml(rng, 12)
    n = text.count(">")
    blocks = in_blocks(text, rng.sample(range(n), rng.randrange(0, min(n, 9))))
    state, rows = D.TEXT, []
    for k, pieces in enumerate(blocks):
        for start in D.STATES:
            own, other = D.Summary(state), D.Summary(start)
            for piece in pieces:
                own.read(piece)
                other.read(piece)
            assert other.state == own.ends[start]
        rows.append({
            "file": "f", "start": k, "first": 0, "state": state, "ends": "".join(own.ends[s] for s in D.STATES),
            "closed": own.closed, "open": own.open, "problem": own.problem,
            "paths": [{"closed": c, "path": list(p), "n": m} for (c, p), m in own.paths.items()],
        })
        state = own.state
    rng.shuffle(rows)
    table = pa.Table.from_pylist(rows, schema=D._BLOCK)
    assert {r["start"]: r["true_state"] for r in D._states(table).to_pylist()} == {r["start"]: r["state"] for r in rows}
    placed = sorted(D._placed(None)(table).to_pylist(), key=lambda r: r["start"])
    want = counted(text)
    assert {r["problem"] for r in placed} == {None}
    records = D.record_paths(dict(want))
    assert all(sorted(map(tuple, r["records"])) == records for r in placed)
    parts, bodies = [], []
    for place, pieces in zip(placed, blocks):
        cutter = D.Cutter(place)
        parts += [x for piece in pieces for x in cutter.read(piece)] + list(cutter.rest())
    for kind, body in parts:
        if kind in (D.WHOLE, D.HEAD):
            bodies.append(body)
        else:
            bodies[-1] += body
    found = Counter(ElementTree.tostring(ElementTree.fromstring(f"<r{b}</r>")) for b in bodies)
    root, expected = ElementTree.fromstring(text), Counter()

    def walk(element, path):
        path = (*path, element.tag)
        if path in records:
            own = copy.deepcopy(element)
            own.tag, own.tail = "r", None
            expected[ElementTree.tostring(own)] += 1
            return
        for child in element:
            walk(child, path)

    walk(root, ())
    assert found == expected


@pytest.mark.parametrize("seed", range(25))
def test_many_pieces_are_read_as_one_by_one(seed):
    """Whole texts by one expression give what their pieces give, wherever they are cut; also in texts that are no XML."""
    rng = random.Random(seed)
    text = random_xml(rng, 12)
    if seed % 3 == 2:
        parts = ["<", ">", "</", "/>", '"', "'", "a", " ", "b:c", "<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "<!X", "<a k='", "</a", "<a"]
        text = "".join(rng.choice(parts) for _ in range(200)) + ">"
    n = text.count(">")
    blocks = in_blocks(text, rng.sample(range(n), rng.randrange(0, min(n, 9))))
    for pieces in blocks:
        for start in D.STATES:
            own, other = D.Summary(start), D.Summary(start)
            for piece in pieces:
                own.read(piece)
            cuts = [0, *sorted(rng.sample(range(len(pieces)), min(2, len(pieces)))), len(pieces)]
            for a, b in zip(cuts, cuts[1:]):
                other.read_text("".join(p + ">" for p in pieces[a:b]))
            assert vars(own) == vars(other)
    if seed % 3 == 2:
        return
    records = [list(p) for p in D.record_paths(dict(counted(text)))]
    for cut in range(0, n, max(1, n // 9)):
        pieces = text.split(">")[:n]
        before = D.Summary(D.TEXT)
        for piece in pieces[:cut]:
            before.read(piece)
        place = {"state": before.state, "open": before.open, "records": records}
        one, many = D.Cutter(place), D.Cutter(place)
        found = [x for piece in pieces[cut:] for x in one.read(piece)] + list(one.rest())
        middle = rng.randrange(cut, n)
        read = [x for a, b in ((cut, middle), (middle, n)) for x in many.read_text("".join(p + ">" for p in pieces[a:b]))]
        assert read + list(many.rest()) == found


def test_plain_pieces_take_no_steps(monkeypatch):
    """Elements, comments and sections of a block are read at once, in both scans."""
    monkeypatch.setattr(D, "step", lambda *_: pytest.fail("read piece by piece"))
    text = "<x:a>" + "<r k='1>2'><!-- > --><n><![CDATA[ > ]]></n><e/></r>\n" * 100 + "</x:a>"
    pieces = text.split(">")[:-1]
    columns = {"file": ["f"] * len(pieces), "start": [0] * len(pieces), "line": list(range(len(pieces))), "value": pieces}
    rows = [b.to_pylist()[0] for b in D._summaries(iter([pa.RecordBatch.from_pydict({**columns, "state": ["t"] * len(pieces)})]))]
    placed = D._placed(None)(pa.Table.from_pylist(rows, schema=D._BLOCK)).to_pylist()
    assert placed[0]["records"] == [["a", "r"]] and placed[0]["problem"] is None
    batch = pa.RecordBatch.from_pydict({**columns, "place": [json.dumps(placed[0]), *[None] * (len(pieces) - 1)]})
    found = [r for b in D._cut(iter([batch])) for r in b.to_pylist()]
    assert [(r["kind"], r["body"]) for r in found] == [
        (D.WHOLE, " k='1>2'><!-- > --><n><![CDATA[ > ]]></n><e/>")] * 100


@pytest.mark.parametrize("seed", range(20))
def test_whole_files_are_read_as_their_pieces(seed):
    """One pass over a whole text gives the records and problems of a summary and a cut by pieces; also where it is no XML."""
    rng = random.Random(seed)
    parts = ["<", ">", "</", '"', "'", "a", " ", "<!--", "-->", "<![CDATA[", "]]>", "<?", "?>", "<!X", "<a k='", "<a", "<a>", "</a>", "<x:b/>", "<b>t</b >"]
    texts = [random_xml(rng, 8), "<r>" + "".join(rng.choice(parts) for _ in range(9)) + "</r>\n", "<r><a>1</a><a/><x:a k='>'>2</x:a></r>"]
    for text, tag in [(t, tag) for t in texts for tag in (None, "a")]:
        pieces = text.split(">") if not text.endswith(">") else text.split(">")[:-1]
        own = D.Summary(D.TEXT)
        for piece in pieces:
            own.read(piece)
        place = D._placed(tag)(pa.Table.from_pylist([own.row("f", 0, 0)], schema=D._BLOCK)).to_pylist()[0]
        cutter = D.Cutter(place)
        found = [] if place["problem"] else [b for piece in pieces for _, b in cutter.read(piece)]
        assert D.read_whole(text, tag) == (place["problem"], found)


def test_shapes():
    """Records of one shape differ in plain values, texts, comments and sections only."""
    alike = [
        [" k='1'><n>2</n>", " k='a > b'><n>say x=\"5\" &amp; go</n>"], ["><!-- <h> -->t", "><!---->u v"],
        ["><![CDATA[ <b> ]]>", "><![CDATA[x]]>"], [">t<b/>", ">  u\n<b/>"],
        [" k='=\"' m='1'><n>2</n>", " k='2' m='=\"'><n>3</n>"],
    ]
    apart = [
        " k='1'><n></n>", " k='1'><n> </n>", " k=''><n>2</n>", " k='1'><m>2</m>", " k='1'><n>2</n><n>2</n>",
        "><![CDATA[ ]]>", "><![CDATA[]]>", ">", "><b/>", " k='&none;'><n>2</n>", "><n x=\"5\"> </n>", "><n>x=\"5\" </n>",
    ]
    for a, b in alike:
        assert D.record_shape(a) == D.record_shape(b) and D._of_one_shape(a).fullmatch(b) and D._of_one_shape(b).fullmatch(a)
    kinds = [a for a, _ in alike] + apart
    assert len({D.record_shape(k) for k in kinds}) == len(kinds)
    for a in kinds:
        assert [k for k in kinds if D._of_one_shape(a).fullmatch(k)] == [a]
    shapes = D.Shapes()
    assert [shapes.is_new(f" k='{k}'><n>{k}</n>") or shapes.is_new(f"><n>{k}</n>") for k in range(250)] == [True] * 2 + [False] * 248


def test_small_files_are_read_once(spark, tmp_path, monkeypatch):
    """Files of one block need no second scan, and columns follow from one record of each structure."""
    monkeypatch.setattr(D, "_at_blocks", lambda *_: pytest.fail("scanned again"))
    for name in "ab":
        put(tmp_path / "in", f"{name}.xml", "<e>" + "".join(f"<r k='{k}'><n>{name} &lt; {k}</n></r>" for k in range(300)) + "<s><n>0</n><n>1</n></s><s/></e>")
    rows = R.read_xml(spark, str(tmp_path / "in"), path_column="place").collect()
    assert Counter(r.place[-5:] for r in rows) == {"a.xml": 302, "b.xml": 302}
    assert {(r.k, r.n, r.n_2) for r in rows if r.place.endswith("b.xml")} == {
        *[(str(k), f"b < {k}", None) for k in range(300)], (None, "0", "1"), (None, None, None)}
    put(tmp_path / "odd", "a.xml", "<e><r><n>1</n></r><r><n>&none;</n></r><r><m>2</m></r></e>")
    odd = R.read_xml(spark, str(tmp_path / "odd")).collect()
    assert {(r.n, r.m) for r in odd} == {("1", None), (None, "2"), (None, None)}  # a record that is no XML stands alone
    whole = D.whole_xml(spark, str(tmp_path / "in"))
    assert whole.count() == 604 and 3 <= whole.where("new").count() <= 6


def test_record_paths():
    def paths(text, tag=None):
        return ["/".join(p) for p in D.record_paths(dict(counted(text)), tag)]

    assert paths("<a><row/><row/></a>") == ["a/row"]
    assert paths("<a><meta><x>1</x></meta><list><order><n>1</n></order><order/></list></a>") == ["a/list/order"]
    assert paths("<env><body><list><item><n>1</n></item></list></body></env>") == ["env/body/list/item"]
    assert paths("<order><n>1</n><m>2</m></order>") == ["order"]
    assert paths("<a><h/><h/><o/><o/><z/></a>") == ["a/h", "a/o"]
    assert paths("<a><x><item/></x><y><item/></y></a>") == ["a/x/item", "a/y/item"]
    deep = "<w>" * 30 + "<o/><o/>" + "</w>" * 30
    assert paths(f"<a>{deep}</a>") == ["a/" + "w/" * 30 + "o"]
    assert paths("<a><b><c><x/></c></b></a>", "c") == ["a/b/c"]
    assert D.record_paths({}) == []


def test_xml_files(spark, tmp_path):
    """Files of different shapes, read in blocks of some 200 bytes."""
    orders = "".join(f'<x:order id="{k}" note="a&gt;b > c"><n>{k * 7}</n><!-- <order> --><t><![CDATA[<{k}>]]></t></x:order>\n' for k in range(40))
    put(tmp_path / "in", "a.xml", f'﻿<?xml version="1.0"?><e xmlns:x="urn:x"><h><k>1</k></h><list>{orders}</list></e>')
    mixed = "".join(f"<h>{k}</h>" for k in range(60)) + "<order id='900'><n>1</n></order><order id='901'/>"
    put(tmp_path / "in", "b.xml", f"<e>{mixed}</e>")
    put(tmp_path / "in", "c.xml", "<only><n>5</n></only>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("200", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = R.read_files(spark, str(tmp_path / "in"), "xml", path_column="place").collect()
            by_file = Counter(r.place.rsplit("/", 1)[1] for r in rows)
            assert by_file == {"a.xml": 40, "b.xml": 62, "c.xml": 1}
            own = {r.id: r for r in rows if r.place.endswith("a.xml")}
            assert len(own) == 40 and all(r.n == str(int(k) * 7) and r.t == f"<{k}>" and r.note == "a>b > c" for k, r in own.items())
            assert {(r.id, r.n) for r in rows if r.place.endswith("b.xml") and r.id} == {("900", "1"), ("901", None)}
            assert [r.n for r in rows if r.place.endswith("c.xml")] == ["5"]
            if size == "200":
                assert D.scan_xml(spark, str(tmp_path / "in")).groupBy("file").count().agg({"count": "max"}).first()[0] > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_xml_problems(spark, tmp_path):
    bad = {"dtd": '<?xml version="1.0"?><!DOCTYPE a><a><row/></a>', "cut": "<a><b>", "crossed": "<a><b></a></b>", "words": "no xml"}
    for name, text in bad.items():
        path = put(tmp_path / name, "x.xml", text)
        with pytest.raises(ValueError):
            R.read_xml(spark, path)
        assert R.unreadable_files(spark, path, "xml").count() == 1, name


def test_json_files(spark, tmp_path):
    """Every file by its own list, whatever its key and its place among the keys."""
    folder = tmp_path / "in"
    put(folder, "a.json", '{"orders": [{"id": 1, "p": 1.50}, {"id": 2}]}')
    put(folder, "b.json", '{"z": {"text": "[{}]", "n": 3}, "items": [{"p": 2, "id": 3},\n {"id": 4},{"id": 5}], "after": [{"x": 1}]}')
    put(folder, "c.json", '[{"id": 6, "deep": {"a.b": "q\\"}"}}]')
    put(folder, "d.json", '{"id": 7, "tags": [1, 2]}')
    put(folder, "e.json", '{"rows": [], "more": [{"id": 99}]}')
    rows = R.read_files(spark, str(folder), "json", path_column="place").collect()
    got = sorted((r.place[-6], r.id, r.p) for r in rows)
    assert got == [("a", 1, 1.5), ("a", 2, None), ("b", 3, 2.0), ("b", 4, None), ("b", 5, None), ("c", 6, None), ("d", 7, None)]
    assert [r["deep.a.b"] for r in rows if r.id == 6] == ['q"}']
    put(tmp_path / "list", "a.json", '["x", "1", null]')
    put(tmp_path / "numbers", "a.json", "[3, 4]")
    assert sorted(str(r.value) for r in R.read_json(spark, str(tmp_path / "list")).collect()) == ["1", "None", "x"]
    assert sorted(r.value for r in R.read_json(spark, str(tmp_path / "numbers")).collect()) == [3, 4]
    put(tmp_path / "bad", "a.json", '{"a": ')
    with pytest.raises(ValueError):
        R.read_json(spark, str(tmp_path / "bad"))


def test_record_place():
    assert D.record_place('{"a": {"b": {"c": [{"x": 1}]}}, "d": [{"y": 1}]}') == ("records", ["a", "b", "c"])
    assert D.record_place('{"a": [1], "d": [{"y": 1}]}') == ("records", ["d"])
    assert D.record_place("[1, 2]") == ("values", []) and D.record_place("3") == ("value", [])
    assert D.record_place('{"a": 1}') == ("object", []) and D.record_place("") == D.record_place(None) == ("bad", [])
    deep = '{"a":' * 500 + "[{}]" + "}" * 500
    assert D.record_place(deep) == ("records", ["a"] * 500)
    assert json.loads(deep)
