"""Every stage of the pipeline on its own input against plain Python, and the queries that SQL can express."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import plain

import corpus_pipeline
from crosscheck import compare, connect
from tallyframe.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # One benchmark text for certain, and rows that the quality rules must not lose.
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    long = docs.where("length(text) between 2000 and 4000").orderBy("doc_id").first()
    more = [(9001, long.text + "\n" + item, "en", "extra", 1), (9002, long.text + " mail a@b.org now", "en", None, 1)]
    out = [docs.unionByName(spark.createDataFrame(more, docs.schema))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], FOLDER).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [df.collect() for df in out], [df.columns for df in out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dup", "decontaminate", "pii", "mixing"]
    assert all(c == stages[1][0] for c in stages[1][:-1])


def test_quality_stage(spark, stages):
    before, after = stages[0][0], {r.doc_id for r in stages[0][1]}
    for r in before:
        if plain.quality(r.text)[-1]:
            assert r.doc_id not in after
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 1 and not plain.quality(r.text)[-1]]
    assert sum(d in after for d in clean) >= 0.95 * len(clean)


def test_near_dup_stage(stages):
    before, after = stages[0][1], {r.doc_id for r in stages[0][2]}
    root = plain.components({r.doc_id: r.text for r in before})
    assert after == {d for d, r in root.items() if d == r}


def test_decontaminate_stage(spark, stages):
    before, after = stages[0][2], {r.doc_id for r in stages[0][3]}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    held = {r.doc_id for r in before if any(t in r.text for t in items)}
    assert held and not held & after
    windows = {w for t in items for w in plain.shingles(t)}
    assert {r.doc_id for r in before if not plain.shingles(r.text) & windows} <= after


def test_pii_stage(stages):
    before, after = {r.doc_id: r for r in stages[0][3]}, {r.doc_id: r for r in stages[0][4]}
    assert before.keys() == after.keys()
    for d, r in before.items():
        assert not plain.pii(after[d].text)
        if not plain.pii(r.text):
            assert r == after[d]


def test_mixing_stage(stages):
    before, after = {r.doc_id: r for r in stages[0][4]}, stages[0][5]
    assert len(before) == len(after)
    taken, target, least = {}, {}, {}
    for r in after:
        source = before[r.doc_id].source
        assert r.size == len(plain.words(before[r.doc_id].text)) and r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
        target[source] = r.target
        least[source] = min(least.get(source, r.size), r.size)
    # Whole copies leave at most half the smallest document of a source.
    for source, t in target.items():
        assert abs(taken[source] - t) <= 0.5 * least[source] + 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name]) is None
