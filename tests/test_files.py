import csv
import difflib
import io
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import pairing as P
from tallyframe.sources import discovery as D
from tallyframe.sources import logs as L
from tallyframe.sources import readers as R


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_token_patterns(spark):
    cases = [
        ("sales_{region}_{day:%Y%m%d}.csv", "sales_east_20240105.csv", {"region": "east", "day": "20240105"}),
        ("sales_{region}.csv", "sales_a_b.csv", None),
        ("{n:num}-{w:alpha}-{m:alnum}.*", "12-ab-c3.txt", {"n": "12", "w": "ab", "m": "c3"}),
        ("x{v:regex((a|b){2})}_{t:any}?", "xab_q.9z", {"v": "ab", "t": "q.9"}),
        ("part+{i:num}.csv", "part+7.csv", {"i": "7"}),
        ("*.csv", "any.csv", {}),
    ]
    for pattern, name, expected in cases:
        p = D.token_pattern(pattern)
        row = spark.range(1).select(F.lit(name).rlike(p.regex).alias("hit"), p.tokens(F.lit(name)).alias("t")).first()
        assert row.hit is (expected is not None)
        if expected is not None:
            assert row.t == expected
    for bad in ("{a:regex(()}.csv", "{a:regex()}.csv", "{a:regex((?P<x>b))}.csv", "{a}{a}"):
        with pytest.raises(ValueError):
            D.token_pattern(bad)


def test_sniffing():
    assert R.sniff_header(["Report", "", "a|b|c", "-----", "1|2|3"]) == (2, "|")
    assert R.sniff_header(["a,b", "1,2"]) == (0, ",")
    assert R.sniff_header(["alone"]) is None
    assert R.is_ragged(["title", "a,b", "1,2"]) and not R.is_ragged(["a,b", "1,2", "3"])


def test_delimited_with_preamble(spark, tmp_path):
    put(tmp_path, "a.csv", "Monthly\nreport, all, regions\n\nid;name;amount\n---\n1;x;2.5\n2;NA;3\n")
    df = R.read_files(spark, str(tmp_path), "csv")
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("amount", "double")]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x", 2.5), (2, None, 3.0)]


def test_each_file_by_its_own_header(spark, tmp_path):
    """Column order, extra columns, preambles and delimiters may differ from file to file."""
    put(tmp_path, "a.csv", "\ufeffid,amount\n1,300\n2,400\n")
    put(tmp_path, "b.csv", "amount,id\n500,3\n\n600,4\n")
    put(tmp_path, "c.csv", "id,amount,note\n5,700,\"x, y\"\n")
    put(tmp_path, "d.csv", "Export\nof, all, days\n\nid|amount\n-----\n6|800\n")
    put(tmp_path, "e.csv", "Title\n" + "lead\n" * 1500 + "the, lead\nid;amount\n7;900\n8;1000\n")
    put(tmp_path, "f.csv", "id,amount\n")
    df = R.read_files(spark, str(tmp_path), "csv", path_column="from")
    rows = {(r.id, r.amount, r.note) for r in df.collect()}
    assert rows == {
        (1, 300, None), (2, 400, None), (3, 500, None), (4, 600, None), (5, 700, "x, y"), (6, 800, None),
        (7, 900, None), (8, 1000, None)}
    assert R.read_delimited(spark, str(tmp_path / "a.csv"), schema="amount int, id string, more date").first() == (300, "1", None)


def test_ragged_late_and_line_breaks(spark, tmp_path):
    """A line with too many fields fails or is sniffed wherever it stands; line breaks in quotes belong to the field."""
    late = tmp_path / "late.csv"
    put(tmp_path, "late.csv", "Report\n" + "".join(f"line {k}\n" for k in range(1200)) + "id,name\n1,x\n2,y\n")
    got = R.read_files(spark, str(late), "csv")
    assert got.columns == ["id", "name"] and got.count() == 2
    lines = late.read_text().split("\n")
    assert R.sniff_header(lines) == (1201, ",")
    put(tmp_path, "broken.csv", 'id,note\n1,"two\nlines"\n2,one\n')
    whole = R.read_delimited(spark, str(tmp_path / "broken.csv"))
    assert {tuple(r) for r in whole.collect()} == {(1, "two\nlines"), (2, "one")}
    with pytest.raises(Exception):
        R.read_delimited(spark, str(tmp_path / "broken.csv"), multi_line=False).collect()
    put(tmp_path, "none.csv", "x\ny,z\n")
    with pytest.raises(ValueError):
        R.read_delimited(spark, str(tmp_path / "none.csv"))


def test_quoted_line_breaks_across_blocks(spark, tmp_path):
    """Blocks that begin inside quotes, doubled quotes, inches, blank lines and delimiters in fields; csv as the measure."""
    rng = random.Random(5)
    parts = ['a, b', 'say ""yes""', "line\nbreak", "\n\n", ";", "|x", "plain", '""', "-", "\n-----\n", "word " * 9, '"",""\n']
    rows = [(str(k), "".join(rng.choice(parts) for _ in range(rng.randrange(5))), f'{k}" wide') for k in range(400)]
    text = "id,note,size\n" + "".join(f'{k},"{note}",{size}\n' for k, note, size in rows)
    put(tmp_path, "a.csv", text)
    put(tmp_path, "b.csv", 'id,"size\nin inch"\n900,4\n')
    expected = {(int(r["id"]), r["note"] or None, r["size"]) for r in csv.DictReader(io.StringIO(text))}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "701b", "97b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            df = R.read_files(spark, str(tmp_path), "csv")
            got = df.collect()
            assert {(r.id, r.note, r.size) for r in got if r.id != 900} == expected and len(got) == 401
            assert [r["size\nin inch"] for r in got if r.id == 900] == [4]
            assert R.unreadable_files(spark, str(tmp_path), "csv").count() == 0
        lines = R._numbered_lines(spark, str(tmp_path / "a.csv"))
        assert lines.rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cut = put(tmp_path / "..", "cut.csv", 'id,note\n1,"open\n2,x\n')
    assert [r.problem for r in R.unreadable_files(spark, cut, "csv").collect()] == ["malformed line"]
    assert R.read_delimited(spark, cut).count() == 2


def test_many_headers_one_scan(spark, tmp_path):
    for k in range(30):
        put(tmp_path, f"f{k}.csv", f"id,c{k},{'x;y' if k % 3 else 'z'}\n{k},v{k},1\n")
    df = R.read_files(spark, str(tmp_path), "csv")
    assert {(r.id, r[f"c{r.id}"]) for r in df.collect()} == {(k, f"v{k}") for k in range(30)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text") <= 2 and "Union" not in plan


def test_json_shapes(spark, tmp_path):
    cases = {
        "list": ('[{"a": 1, "b": {"c": "x"}}, {"a": 2}]', [(1, "x"), (2, None)], ["a", "b.c"]),
        "scalars": ("[1, 2, 3]", [(1,), (2,), (3,)], ["value"]),
        "object": ('{"a": 1, "b": {"c": 2}}', [(1, 2)], ["a", "b.c"]),
        "inner": ('{"n": 2, "z": {"rows": [{"a": 1}]}, "b": [{"q": 1}, {"q": 2}]}', [(1,)], ["a"]),
    }
    for name, (text, rows, columns) in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        put(folder, "x.json", text)
        df = R.read_files(spark, str(folder), "json")
        assert df.columns == columns, name
        assert sorted(tuple(r) for r in df.collect()) == rows, name


def test_log_blocks(spark, tmp_path):
    rng = random.Random(4)
    lines = []
    for i in range(300):
        lines.append(rng.choice([f"2024-01-01 10:00:{i % 60:02d} x{i}", f"INFO y{i}", f"a | ERROR z{i}", "  more", "tail WARN here"]))
    put(tmp_path, "a.log", "\n".join(lines) + "\n")
    put(tmp_path, "b.log", "head\nsecond\nDEBUG q\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opened = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    try:
        found = L.log_events(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", opened)
    expected, level = [], {"INFO": "INFO", "a | E": "ERROR", "tail ": "WARN"}
    for n, line in enumerate(lines, 1):
        known = next((v for k, v in level.items() if line.startswith(k)), "")
        if known or line.startswith("2024") or not expected:
            expected.append([n, known or "TRACE", line])
        else:
            expected[-1][2] += "\n" + line
    mine = sorted([r.number, r.level, r.text] for r in found if r.file.endswith("a.log"))
    assert mine == sorted(expected)
    assert sorted((r.number, r.level, r.text) for r in found if r.file.endswith("b.log")) == [
        (1, "TRACE", "head\nsecond"), (3, "DEBUG", "DEBUG q")]


def greedy(source, target, threshold, signals):
    """The sorted walk over all scored pairs."""
    scored = []
    for s, t in itertools.product(source, target):
        a, b = set(s[2]), set(t[2])
        values = {
            "filename_tokens": difflib.SequenceMatcher(None, s[1].rsplit(".", 1)[0], t[1].rsplit(".", 1)[0]).ratio(),
            "column_signature": 1.0 if not a | b else len(a & b) / len(a | b),
            "row_count_ratio": 1.0 if s[3] == t[3] == 0 else min(s[3], t[3]) / max(s[3], t[3]),
        }
        scored.append((-sum(values[n] for n in signals) / len(signals), s[1], t[1]))
    used_s, used_t, out = set(), set(), set()
    for score, s, t in sorted(scored):
        if -score >= threshold and s not in used_s and t not in used_t:
            used_s.add(s)
            used_t.add(t)
            out.add((s, t))
    return out


@pytest.mark.parametrize("signals,threshold", [
    (P.SIGNALS, 0.7), (P.SIGNALS, 0.45), (("row_count_ratio",), 0.9), (("filename_tokens",), 0.6),
    (("filename_tokens", "column_signature"), 0.75),
])
def test_likeness_pairs(spark, signals, threshold):
    rng = random.Random(11)

    def files(prefix):
        return [
            (f"/{prefix}/{i}", f"{prefix}_{rng.choice('abc')}{rng.choice('xyz')}{i}.csv",
             sorted(rng.sample(["id", "name", "amount", "day", "note"], rng.randint(0, 4))), rng.choice([0, 1, 9, 10, 11, 80, 100]))
            for i in range(9)
        ]

    s, t = files("sales"), files("sale")
    schema = "path string, file_name string, columns array<string>, rows bigint"
    pairs = P.pair_by_likeness(spark.createDataFrame(s, schema), spark.createDataFrame(t, schema), threshold, signals)
    assert {(r.source_file, r.target_file) for r in pairs.collect()} == greedy(s, t, threshold, signals)


def test_empty_match_on(spark):
    files = spark.createDataFrame([("/a/1", "1", {}), ("/a/2", "2", {})], "path string, file_name string, tokens map<string,string>")
    row = P.pair_by_tokens(files, files, []).first()
    assert (row.status, len(row.source_files), len(row.target_files)) == ("paired", 2, 2)
    with pytest.raises(ValueError):
        P.pair_by_tokens(files, files, ["region"])


def test_broken_files_do_not_validate(spark, tmp_path):
    put(tmp_path, "a.json", '{"a": 1}\n{"a": \n')
    row = R.validate_files(spark, str(tmp_path), "json").first()
    assert row.problem == "parse_error"
    with pytest.raises(ValueError):
        R.validate_files(spark, str(tmp_path), "xlsx")


def test_a_pair_fails_alone(spark, tmp_path):
    """A broken file makes its own pair an ERROR; formats may differ within a job."""
    from tallyframe.operators.reconcile import CompareOptions
    from tallyframe.plans import jobs as J

    left, right = tmp_path / "left", tmp_path / "right"
    left.mkdir(), right.mkdir()
    for name in ("east", "west", "north", "south"):
        put(left, f"s_{name}.csv", "id,amount\n1,10\n2,20\n")
    put(right, "t_east.csv", "amount,id\n10,1\n20,2\n")
    put(right, "t_west.csv", "id,amount\n1,10\n2\n3,30\n")
    put(right, "t_north.jsonl", '{"id": 1, "amount": 10}\n{"id": 2, "amount": 25}\n')
    put(right, "t_south.jsonl", '{"id": 1, "amount": 10}\n{"id": 2,\n')
    mapping, found = J.compare_many_files(
        spark, str(left), "s_{side}.csv", str(right), "t_{side}.{ext}", ["side"], CompareOptions(key_columns=["id"])
    )
    results = P.pair_results(found, mapping)
    got = {r["__pair__"]: (r.status, r.matched_count, r.value_mismatch_count) for r in results.collect()}
    assert {k.split('"')[3]: v for k, v in got.items()} == {
        "east": ("PASSED", 2, 0), "west": ("ERROR", 0, 0), "north": ("FAILED", 2, 1), "south": ("ERROR", 0, 0)}
    whole = P.rolled_up(results).first()
    assert (whole.pairs_total, whole.pairs_passed, whole.pairs_failed, whole.pairs_errored) == (4, 1, 1, 2)
    assert whole.status == "ERROR" and mapping.where("error is not null").count() == 2


def test_long_events_are_cut(spark, tmp_path, monkeypatch):
    """A log without event starts comes in rows of bounded length that make up the whole again."""
    monkeypatch.setattr(L, "EVENT_LINES", 3)
    lines = [f"just text {k}" for k in range(10)]
    put(tmp_path, "plain.log", "\n".join(lines))
    rows = L.log_events(spark, str(tmp_path)).orderBy("number").collect()
    assert [r.number for r in rows] == [1, 4, 7, 10] and {r.level for r in rows} == {"TRACE"}
    assert "\n".join(r.text for r in rows).split("\n") == lines
    assert {r.event for r in rows} == {1} and [r.part for r in rows] == [0, 1, 2, 3]


def test_a_long_event_is_one_event(spark, tmp_path):
    """25,000 lines: one event in counts, and found by words of different parts or across two of them."""
    lines = ["INFO begin"] + [f"  step {k}" for k in range(1, 25_000)] + ["ERROR other", "  step 3"]
    lines[2] += " Apple"
    lines[24_990] += " pear"
    put(tmp_path, "a.log", "\n".join(lines) + "\n")
    put(tmp_path, "b.log", "DEBUG apple and pear\nWARN only apple\n")
    events = L.log_events(spark, str(tmp_path)).cache()
    heads = {(r.file[-5:], r.event): (r.level, r.lines, r.head) for r in L.event_heads(events).collect()}
    assert heads == {
        ("a.log", 1): ("INFO", 25_000, "INFO begin"), ("a.log", 25_001): ("ERROR", 2, "ERROR other"),
        ("b.log", 1): ("DEBUG", 1, "DEBUG apple and pear"), ("b.log", 2): ("WARN", 1, "WARN only apple"),
    }

    def found(**options):
        return [(r.file[-5:], r.event, r.part) for r in L.filter_log_events(events, **options).collect()]

    long = [("a.log", 1, 2), ("a.log", 1, 1), ("a.log", 1, 0)]
    assert found(run_id="apple", query="pear") == [("b.log", 1, 0), *long]
    assert found(run_id="apple", query="pear", limit=1) == [("b.log", 1, 0)]
    assert found(run_id="apple", query="pear", level="info") == long
    assert found(query="step 9999\n  step 10000\n  step 10001") == long
    assert found(query="step 9999\n  step 10001") == []
    assert found(limit=3) == [("b.log", 2, 0), ("b.log", 1, 0), ("a.log", 25_001, 0)]
    assert len(found(limit=None)) == 6


def test_log_lines_are_dealt_by_their_text(spark, tmp_path, monkeypatch):
    """As many tasks sort lines as the text read asks for, whatever the session's number of shuffle partitions."""
    from tallyframe.sources import logs

    (tmp_path / "a.log").write_text("2024-01-01 00:00:00 | INFO | a\n  more\n2024-01-01 00:00:01 | ERROR | b\n")
    monkeypatch.setattr(logs, "TASKS_PER_READ", 7)
    events = logs.log_events(spark, str(tmp_path))
    assert events.rdd.getNumPartitions() == 7 * spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    assert [(r.number, r.level) for r in events.orderBy("number").collect()] == [(1, "INFO"), (3, "ERROR")]


def test_many_paths_are_listed_in_few_tasks(spark, tmp_path):
    paths = []
    for k in range(200):
        (tmp_path / f"f{k}.csv").write_text(f"id,name\n{k},n{k}\n")
        paths.append(str(tmp_path / f"f{k}.csv"))
    key, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(key)
    context.setJobGroup("listing", "listing")
    lines = R._numbered_lines(spark, paths)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert sum(tasks) <= 4 * context.defaultParallelism < 200 and spark.conf.get(key) == before
    assert lines.where("value <> 'id,name'").count() == 200
    with pytest.raises(Exception):
        R.read_files(spark, str(tmp_path / "none.parquet"))
    assert spark.conf.get(key) == before
