import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import matrix as M
from factloom.operators.facts import normalize_facts, require_valid, validate_facts, validate_observations
from factloom.plans import workflow
from factloom.schemas import OBSERVATION
from factloom.sources import readers
from factloom.streaming.ingest import ingest, observation_stream

REPO = ("r", "a" * 40)
VERSIONS = {"ada": "4.2.0", "bob": "0.9.1", "cy": "7.0.0"}


def said(provider, predicate, subject, path, value, span="L20C5-L24C2", kind="method"):
    native = json.dumps({"node": {"id": subject, "kind": kind, "name": subject.split("/")[-1], "path": path, "span": span}, "seen": value})
    return (1, (subject, kind), predicate, (None, value), (provider, VERSIONS[provider], "deterministic"), REPO, (path, span), "deterministic", native)


#: Two providers agree on one fact, differ on another, and say some things alone; one of these about a place of their own.
COMPARABLE = [
    said("ada", "writes", "a/pay", "shop/cart.py", "ledger"), said("bob", "writes", "b/pay", "shop/cart.py", "ledger"), said("ada", "depends-on", "a/pay", "shop/cart.py", "shop/tax.py"), said("bob", "exports", "b/pay", "shop/cart.py", "api"),
    said("ada", "type-of", "a/pay", "shop/cart.py", "Decimal"), said("bob", "type-of", "b/pay", "shop/cart.py", "float"), said("ada", "mentions", "a/pay", "shop/cart.py", "own words"),
    said("bob", "writes", "b/log", "shop/log.py", "file"), said("bob", "reads", "b/log", "shop/log.py", "clock")]


@pytest.fixture(scope="module")
def normalized(spark):
    return normalize_facts(spark.createDataFrame(COMPARABLE, OBSERVATION))


@pytest.fixture(scope="module")
def views(spark, normalized):
    facts, unsupported = normalized.descriptors()
    registry = spark.createDataFrame([((p, v, "deterministic"), i) for i, (p, v) in enumerate(VERSIONS.items())], "provider struct<id:string,version:string,determinism:string>, ord int")
    return workflow.build_matrix(facts, unsupported, registry, ["bob", "ada", "cy"], normalized.correlation.metrics)


def test_states_of_rows(views):
    assert sorted(r.state for r in views["rows"].collect()) == ["conflict", "overlap", "provider-only", "provider-only", "unmatched", "unmatched", "unsupported"]
    conflict = views["conflicts"].first()
    assert (conflict.fact_class, conflict.n_variants) == ("type-of", 2)
    states = {r.provider.id: r.state for r in views["states"].where(F.col("fact_class") == "type-of").collect()}
    assert states == {"ada": "present", "bob": "present", "cy": "missing"}


def test_coverage_and_overlap(views):
    cover = {r.provider.id: r for r in views["coverage"].where("fact_class = '__all__'").collect()}
    assert (cover["ada"].normalized, cover["ada"].unsupported, cover["ada"].raw) == (3, 1, 4)
    assert (cover["bob"].normalized, cover["bob"].unmatched, cover["bob"].unique, cover["bob"].comparable) == (5, 2, 1, 3)
    assert cover["cy"].raw == 0 and cover["cy"].normalization_coverage is None
    pair = {r.fact_class: r for r in views["pairwise"].where("left.id = 'ada' and right.id = 'bob'").collect()}
    assert (pair["writes"].overlap, pair["writes"].conflicts, pair["writes"].right_only) == (1, 0, 0)
    assert (pair["type-of"].compared, pair["type-of"].overlap, pair["type-of"].conflicts) == (1, 0, 1)
    assert pair["depends-on"].left_only == 1 and pair["depends-on"].overlap_coverage is None
    assert {r.overlap for r in views["all_providers"].collect()} == {0}
    entities = {r.provider.id: (r.total, r.matched, r.unmatched) for r in views["entities"].collect()}
    assert entities == {"ada": (1, 1, 0), "bob": (2, 1, 1), "cy": (0, 0, 0)}


def test_information_gain(views):
    gain = {r.provider.id: r for r in views["gain"].collect()}
    assert gain["bob"].gain_coverage == 1 and gain["bob"].unmatched == 2 and gain["bob"].existing == []
    assert (gain["ada"].new_facts, gain["ada"].own_facts, gain["ada"].unsupported, [p.id for p in gain["ada"].existing]) == (2, 3, 1, ["bob"])
    assert gain["cy"].gain_coverage is None and [p.id for p in gain["cy"].existing] == ["bob", "ada"]
    assert views["new_keys"].groupBy("provider.id").count().collect() and views["new_keys"].where("provider.id = 'ada'").count() == 2


def test_order_of_rows_does_not_matter(spark, normalized):
    back = normalize_facts(spark.createDataFrame(COMPARABLE[::-1], OBSERVATION).repartition(5))
    keys = lambda n: sorted((r.exact_key, r.fact_id, r.status) for r in n.facts.collect())
    assert keys(back) == keys(normalized)


def test_definitions_read_one_way(spark):
    def defines(provider, subject, object_):
        return (1, subject, "defines", object_, (provider, VERSIONS[provider], "deterministic"), REPO, ("src/a.ts", "L3C1-L3C9"), "deterministic", "{}")

    rows = [defines("ada", ("src/a.ts", "module"), (("f", "function"), None)), defines("bob", ("sym f", "symbol"), (None, "src/a.ts"))]
    n = normalize_facts(spark.createDataFrame(rows, OBSERVATION))
    assert n.facts.select("exact_key").distinct().count() == 1 and {r.status for r in n.facts.collect()} == {"matched"}
    facts, unsupported = n.descriptors()
    assert M.compare_fact_sets(facts, unsupported).first().state == "equivalent"
    assert M.compare_fact_sets(facts, unsupported, [(p, v, "deterministic") for p, v in VERSIONS.items()]).first().state == "provider-only"
    two = [(p, VERSIONS[p], "deterministic") for p in ("ada", "bob")]
    assert M.compare_fact_sets(facts, unsupported, two).first().state == "equivalent"
    assert M.compare_normalized_facts(facts, unsupported, [two[0], ("bob", "0.0.0", "deterministic")]).first().state == "provider-only"


def test_ambiguity_stays_visible(spark):
    def one(provider, id):
        return (1, ("m", "module"), "defines", ((id, "function"), None), (provider, VERSIONS[provider], "deterministic"), REPO, ("src/a.ts", "L3C1-L3C9"), "deterministic", "{}")

    n = normalize_facts(spark.createDataFrame([one("ada", "x"), one("bob", "y"), one("bob", "z")], OBSERVATION))
    rows = n.facts.collect()
    assert {r.status for r in rows} == {"ambiguous"} and all(r.logical_key is None for r in rows)
    assert {r.state for r in M.fact_rows(*n.descriptors()).collect()} == {"ambiguous"}


def test_one_ambiguous_subject_with_two_values_is_a_conflict(spark):
    def one(provider, id, predicate, object_):
        return (1, (id, "function"), predicate, object_, (provider, VERSIONS[provider], "deterministic"), REPO, ("lib/q.py", "L8C1-L8C9"), "deterministic", "{}")

    rows = [one("ada", "x", "defines", (None, "lib/q.py")), one("bob", "y", "defines", (None, "lib/q.py")), one("bob", "z", "defines", (None, "lib/q.py")), one("ada", "x", "reads", (None, "1")), one("ada", "x", "reads", (None, "2"))]
    n = normalize_facts(spark.createDataFrame(rows, OBSERVATION))
    got = {(r.fact_class, r.state, r.variants) for r in M.compare_fact_sets(*n.descriptors()).where("fact_class = 'reads'").collect()}
    assert got == {("reads", "conflict", 2)}


def test_validation(spark, normalized):
    good = COMPARABLE[0]
    rows = [good, (2, *good[1:]), (*good[:7], "sometimes", good[8]), (*good[:8], None), (*good[:3], (None, None), *good[4:])]
    errors = [r.errors for r in validate_observations(spark.createDataFrame(rows, OBSERVATION).coalesce(1)).collect()]
    assert [len(e) for e in errors] == [0, 1, 1, 1, 1]
    assert {len(r.errors) for r in validate_facts(normalized.facts).collect()} == {0} and require_valid(normalized.facts).count() == 8
    assert {len(r.errors) for r in validate_facts(normalized.unsupported).collect()} == {3}
    with pytest.raises(ValueError):
        require_valid(normalized.unsupported)


def as_json(row):
    _, s, p, (entity, value), prov, repo, source, det, native = row
    return {"schemaVersion": 1, "subject": dict(zip(("id", "kind"), s)), "predicate": p, "object": dict(zip(("id", "kind"), entity)) if entity else {"value": value}, "provider": dict(zip(("id", "version", "determinism"), prov)),
            "repository": dict(zip(("source", "commitSha"), repo)), "source": dict(zip(("path", "span"), source)), "determinism": det, "providerNative": native}


def test_workflow_end_to_end(spark, tmp_path):
    for p in ("ada", "bob"):
        rows = [as_json(r) for r in COMPARABLE if r[4][0] == p]
        (tmp_path / f"{p}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "ada.json").write_text(json.dumps([as_json(r) for r in COMPARABLE if r[4][0] == "ada"]))
    assert readers.read_artifact(spark, str(tmp_path / "ada.json")).count() == readers.read_artifact(spark, str(tmp_path / "ada.jsonl")).count() == 4
    assert readers.read_artifacts(spark, str(tmp_path), ["ada.jsonl", "bob.jsonl"]).count() == 9
    with pytest.raises(ValueError):
        readers.read_artifacts(spark, str(tmp_path), ["../ada.jsonl"])
    out = tmp_path / "out"
    args = ["matrix", "r", "--revision", "a" * 40, "--out", str(out), *[x for p in ("ada", "bob", "cy") for x in ("--artifact", f"{p}@{VERSIONS[p]}={tmp_path}/{p}.jsonl")]]
    assert workflow.main(args) == 0
    report = (out / "report.md").read_text()
    assert "ada@4.2.0" in report and "0/0 (n/a)" in report and "bob@0.9.1 => " in report and "- unmatched: 2" in report and "| bob@0.9.1 | ada@4.2.0 |" in report
    manifest = json.loads((out / "manifest.json").read_text())
    assert [p["status"] for p in manifest["providers"]] == ["ok", "ok", "failed"]
    assert spark.read.text(manifest["providers"][0]["raw"]).count() == 4 and list((out / "raw" / "ada").glob("*.gz"))
    facts, unsupported = workflow.read_descriptors(spark, str(out))
    assert (facts.count(), unsupported.count()) == (8, 1)
    assert {r.name: r.n for r in spark.read.json(str(out / "matrix" / "counts")).collect()}["rows"] == 7
    assert workflow.main(["matrix", "r", "--revision", "main", "--out", str(out)]) == 1
    (tmp_path / "c.json").write_text(json.dumps({"source": "r", "revision": "a" * 40, "providers": ["ada"], "additionOrder": ["nobody"]}))
    assert workflow.main(["matrix", "--config", str(tmp_path / "c.json"), "--out", str(out), "--artifact", f"ada@4.2.0={tmp_path}/ada.jsonl"]) == 1


def test_another_revision_fails_the_provider(spark):
    class Late:
        identity = ("ada", "4.2.0", "deterministic")

        def is_available(self):
            return True

        def execute(self, spark):
            return spark.createDataFrame(COMPARABLE[:1], OBSERVATION)

    got = workflow.run(spark, [Late()], "r", "b" * 40)
    assert got.manifest["providers"][0]["status"] == "failed" and "asked for" in got.manifest["providers"][0]["error"] and got.observations.count() == 0


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_facts_are_read_back(spark, normalized, tmp_path, form):
    workflow.write_facts(normalized, str(tmp_path), form)
    back = workflow.read_facts(spark, str(tmp_path))
    assert back["facts"].schema.simpleString() == normalized.facts.schema.simpleString()
    assert sorted(map(str, back["facts"].collect())) == sorted(map(str, normalized.facts.collect())) and back["evidence"].count() == 9
    views = workflow.matrix_from_artifact(spark, str(tmp_path))
    assert views["rows"].count() == 7 and "entities" in views
    (tmp_path / "normalized" / "envelope").rename(tmp_path / "gone")
    spark.createDataFrame([(json.dumps({"schemaVersion": 2}),)], "value string").coalesce(1).write.text(f"{tmp_path}/normalized/envelope")
    with pytest.raises(ValueError):
        workflow.read_facts(spark, str(tmp_path))


def test_wiring_and_scip(spark, tmp_path):
    node = lambda i, p: {"id": i, "name": i, "kind": "function", "path": p, "span": "L1C1-L1C2", "exported": True, "origin": "x"}
    graph = {"nodes": [node("a", "x.ts"), node("b", "y.ts")], "edges": [{"source": "a", "target": t, "relation": r, "confidence": "high"} for t, r in (("b", "calls"), ("b", "contains"), ("gone", "calls"))], "meta": {}}
    (tmp_path / "w.json").write_text(json.dumps(graph))
    got = readers.wiring_observations(*readers.read_wiring(spark, str(tmp_path / "w.json")), ("wiring", "1", "deterministic"), REPO).collect()
    assert [(r.subject.id, r.predicate, r.object.entity.id) for r in got] == [("a", "calls", "b")]
    index = {"documents": [{"relative_path": "g.ts", "occurrences": [{"range": [1, 2, 5], "symbol": "S", "symbol_roles": 1}, {"range": [3, 0, 4, 2], "symbol": "S"}, {"range": [1, 1, 1], "symbol": ""}],
                            "symbols": [{"symbol": "S", "relationships": [{"symbol": "I", "is_implementation": True, "is_type_definition": True}, {"symbol": "J"}]}]}]}
    (tmp_path / "s.json").write_text(json.dumps(index))
    got = readers.scip_observations(readers.read_scip(spark, str(tmp_path / "s.json")), ("scip", "1", "deterministic"), REPO).collect()
    assert sorted((r.predicate, r.source.span, r.object.value, r.object.entity.id if r.object.entity else None) for r in got) == [("defines", "1:2-1:5", "g.ts", None), ("implements", "1:2-1:5", None, "I"), ("references", "3:0-4:2", "g.ts", None)]


def test_stream_ingest(spark, tmp_path):
    src, good, bad, state = (str(tmp_path / x) for x in ("in", "good", "bad", "state"))
    spark.createDataFrame([COMPARABLE[0], (2, *COMPARABLE[1][1:])], OBSERVATION).write.parquet(src)
    for _ in range(2):
        q = ingest(observation_stream(spark, src), good, bad, state)
        q.awaitTermination()
    assert spark.read.parquet(good).count() == 1 and spark.read.parquet(bad).count() == 1
