"""Findings of round 4: tables that grow with the input aren't gathered by the driver, documents in volumes."""

import gzip
import json
from pathlib import Path

import pytest

from factloom.operators.facts import normalize_facts
from factloom.plans import catalog
from factloom.sources import corpora, documents

SMALL = "/root/testdata/sf0.001"


def joins(df):
    """Names of the joins of the plan that has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [name for name in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if name in plan]


def test_correlated_tables_are_not_broadcast(spark):
    """however small their files are."""
    c = catalog._part_links(spark, SMALL)
    assert joins(c.members) == joins(c.links) == joins(c.metrics) == ["SortMergeJoin"]


def plans(spark, since, written):
    """Plans of jobs, after so many, that have written a table of that name."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    told = [ran.apply(i).physicalPlanDescription() for i in range(since, ran.size())]
    return [p.split("== Initial Plan ==")[0] for p in told if f"/factloom/{written}-" in p and "InsertIntoHadoopFsRelationCommand" in p]


def jobs(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsList().size()


@pytest.fixture(scope="module")
def normalized(spark):
    return normalize_facts(corpora.customer_observations(spark, SMALL))


def test_facts_and_documents_are_not_broadcast(spark, tmp_path):
    """ends, facts and payloads meet by sorting; one row for each provider goes round."""
    since = jobs(spark)
    n = normalize_facts(corpora.customer_observations(spark, SMALL))
    documents.export_facts(n, str(tmp_path / "facts.json"))
    facts, entities, fragments = (plans(spark, since, name) for name in ("facts", "entities", "fragments"))
    assert facts and entities and fragments
    for kind in (facts, entities, fragments):
        assert any("SortMergeJoin" in plan for plan in kind)
    for plan in (*facts, *entities):
        assert "BroadcastHashJoin Inner" not in plan and "BroadcastHashJoin LeftOuter" not in plan


def test_volumes_are_the_document(spark, normalized, tmp_path):
    """the same bytes as in one file, in a fraction of the room, and the same tables when read."""
    one, many = str(tmp_path / "one.json"), str(tmp_path / "many.json")
    documents.export_facts(normalized, one, 40)
    documents.export_facts(normalized, many, 40, volumes=True)
    files = [f.removeprefix("file:") for f in documents.volumes_of(spark, many)]
    assert len(files) > 14 and sorted(files) == sorted(str(f) for f in Path(many).rglob("*.gz"))
    said = b"".join(gzip.decompress(Path(f).read_bytes()) for f in files)
    assert said == Path(one).read_bytes() and json.loads(said)["facts"]
    assert sum(Path(f).stat().st_size for f in files) * 3 < len(said)
    got, want = documents.import_facts(spark, many), documents.import_facts(spark, one)
    for name in want:
        rows = [sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in t[name].collect()) for t in (got, want)]
        assert rows[0] == rows[1] != [], name


def test_a_task_may_write_more_files_than_a_thousand():
    """files of a task were put in the order of their names, where 1000 comes before 101."""
    name = "file:/d/00/data/part-{:05d}-0a1b-2c3d-c{:03d}.txt.gz"
    files = [name.format(t, i) for t in (0, 1) for i in range(1100)]
    assert sorted(sorted(files), key=documents._place) == files != sorted(files)
