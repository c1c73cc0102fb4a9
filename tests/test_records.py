"""Full records, key lists, ordered sinks, documents, plug-ins, Protobuf indexes, the limit on all pairs and states kept up to date."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates as C
from factloom.operators import matrix as M
from factloom.operators.entities import extract_entities
from factloom.operators.facts import normalize_facts
from factloom.operators.records import claims, matrix_records
from factloom.plans import record_queries, workflow
from factloom.schemas import DESCRIPTOR, OBSERVATION
from factloom.sources import corpora, documents, ordered, plugins, scip
from factloom.streaming import incremental

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def normalized(spark):
    return normalize_facts(corpora.customer_observations(spark, SMALL))


# -- records and key lists ----------------------------------------------------------------------------------------------------


def test_records_agree_with_rows_and_side_tables(spark):
    f, u = corpora.claims(spark, SMALL)
    full = matrix_records(f, u, record_queries.registry(spark), 2)
    rows = {r.key: r for r in M.fact_rows(f, u).collect()}
    records = full.records.collect()
    assert {r.key: (r.state, r.comparison_possible, r.fact_class) for r in records} == {k: (r.state, r.comparison_possible, r.fact_class) for k, r in rows.items()}
    assert {r.state for r in records} == {"overlap", "provider-only", "conflict", "unsupported", "ambiguous", "unmatched"}
    n_variants = {r.key: r["count"] for r in full.variants.groupBy("key").count().collect()}
    listed = {(r.key, r.variant): sorted(x.id for x in r.ids) for r in full.ids.where("kind = 'evidence'").groupBy("key", "variant").agg(F.collect_list(F.struct("id")).alias("ids")).collect()}
    cut = 0
    for r in records:
        assert r.n_variants == n_variants[r.key] and len(r.variants) == min(2, r.n_variants)
        assert {tuple(p) for p in r.observed} | {tuple(p) for p in r.missing} == {tuple(s.provider) for s in r.provider_states} and len(r.provider_states) == 7
        assert [s.state == "missing" for s in r.provider_states] == [s.n_evidence == 0 for s in r.provider_states]
        for v in r.variants:
            every = listed[r.key, v.variant]
            assert v.n_evidence == len(every) and v.evidence_ids == every[:2]
            cut += len(every) > 2
    assert cut > 0


def test_records_of_hot_facts_and_empty_tables(spark):
    f, u = corpora.claims(spark, SMALL)
    one = f.where("provider.id = 'ledger'").limit(1).crossJoin(spark.range(5000)).withColumns({"fact_id": F.concat(F.lit("f"), F.lpad("id", 5, "0")), "exact_key": F.concat(F.lit("v"), F.lpad((F.col("id") % 700).cast("string"), 3, "0"))}).drop("id")
    r = matrix_records(one, u.limit(0), record_queries.registry(spark), 4).records.collect()
    assert len(r) == 1 and r[0].state == "conflict" and r[0].n_variants == 700 and [v.variant for v in r[0].variants] == ["v000", "v001", "v002", "v003"]
    cell = next(s for s in r[0].provider_states if s.provider.id == "ledger")
    assert (cell.n_facts, cell.fact_ids) == (5000, ["f00000", "f00001", "f00002", "f00003"])
    assert matrix_records(f.limit(0), u.limit(0), record_queries.registry(spark)).records.count() == 0 and claims(f.limit(0), u.limit(0)).count() == 0
    twice = matrix_records(one.limit(3).union(one.limit(3)), u.limit(0), record_queries.registry(spark)).records.first()
    assert next(s for s in twice.provider_states if s.provider.id == "ledger").n_facts == 3


def test_top_ids_are_cut_before_the_shuffle(spark):
    f, u = corpora.claims(spark, SMALL)
    plan = matrix_records(f, u, record_queries.registry(spark)).records._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "CartesianProduct" not in plan


def test_key_lists_have_as_many_keys_as_are_counted(spark):
    f, u = corpora.claims(spark, SMALL)
    p = record_queries.registry(spark)
    pairs = {(r.left.id, r.right.id, r.fact_class): r for r in M.pairwise_overlap(f, p, f.select("fact_class").distinct()).collect()}
    for lists, name in ((M.overlap_keys(f, p), "overlap"), (M.conflict_keys(f, p), "conflicts")):
        got = {(r.l, r.r, r.fact_class): r["count"] for r in lists.groupBy(F.col("left.id").alias("l"), F.col("right.id").alias("r"), "fact_class").count().collect()}
        assert got == {k: r[name] for k, r in pairs.items() if r[name]}
    gain = {r.provider.id: r for r in M.information_gain(f, u, p).collect()}
    got = {(r.p, r.kind): r["count"] for r in M.gain_ids(f, u, p).groupBy(F.col("provider.id").alias("p"), "kind").count().collect()}
    want = {(i, k): r[c] for i, r in gain.items() for k, c in (("new", "new_facts"), ("unique", "unique"), ("ambiguous", "ambiguous"), ("unmatched", "unmatched"), ("unsupported", "unsupported")) if r[c]}
    assert got == want


def test_a_null_node_is_no_node(spark):
    def row(native):
        return (1, ("e1", "function"), "reads", (None, "x"), ("p", "1", "deterministic"), ("r", "a" * 40), ("a.ts", None), "deterministic", native)

    natives = ['{"node":null,"id":"e1","name":"N","signature":"S"}', '{"node":"e1","id":"e1","name":"N","signature":"S"}', '{"node":[1],"id":"e1","name":"N","signature":"S"}', '{"id":"e1","name":"N","signature":"S"}',
               '{"node":{},"id":"e1","name":"N"}', '{"node":{"id":"e1","name":"M"},"id":"e1","name":"N"}', '{"sourceNode":null,"targetNode":{"id":"e1","name":"T"},"node":null,"id":"e1","name":"N"}', "[]", "not json"]
    got = {r.providerNative: (r.name, r.signature) for r in extract_entities(spark.createDataFrame([row(n) for n in natives], OBSERVATION)).collect()}
    assert [got[n] for n in natives] == [("N", "S")] * 4 + [("e1", None), ("M", None), ("T", None), ("e1", None), ("e1", None)]


# -- ordered sinks ------------------------------------------------------------------------------------------------------------


def files(folder):
    return {p.parent.name: p.read_bytes() for p in sorted(Path(folder, "data").glob("part_no=*/part-*"))}


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_other_orders_give_the_same_bytes(spark, tmp_path, form):
    rows = [(i % 7, f"k{i % 50:02d}", "é" * (i % 3), None if i % 5 else i) for i in range(2000)]
    random.Random(1).shuffle(rows)
    kind = "a int, k string, nth string, v int"
    one = ordered.write_ordered(spark.createDataFrame(rows, kind).repartition(3), str(tmp_path / "one"), ("a", "k"), 300, form)
    two = ordered.write_ordered(spark.createDataFrame(rows[::-1], kind).repartition(7), str(tmp_path / "two"), ("a", "k"), 300, form)
    assert files(tmp_path / "one") == files(tmp_path / "two") and len(files(tmp_path / "one")) == 7
    assert one.collect() == two.collect() and [r.n for r in one.orderBy("part_no").collect()] == [300] * 6 + [200]
    told = spark.read.schema(kind).format(form)
    back = [r for p in ordered.parts(spark, str(tmp_path / "one")) for r in told.load(p).collect()]
    assert [(r.a, r.k) for r in back] == sorted((r[0], r[1]) for r in rows) and sorted(map(str, map(tuple, back))) == sorted(map(str, rows))


def test_tables_are_written_in_their_orders(spark, normalized, tmp_path):
    c = normalized.correlation
    found = ordered.write_tables({"facts": normalized.facts, "links": c.links, "members": c.members, "canonical": c.canonical, "unknown": c.links}, str(tmp_path), 100)
    assert set(found) == {"facts", "links", "members", "canonical"}
    assert sum(r.n for r in found["facts"].collect()) == normalized.facts.count()
    back = [json.loads(x) for p in ordered.parts(spark, f"{tmp_path}/links") for x in Path(p.removeprefix("file:")).read_text().splitlines()]
    assert [(r["left"], r["right"], -r["score"]) for r in back] == sorted((r["left"], r["right"], -r["score"]) for r in back) and back
    empty = ordered.write_ordered(normalized.facts.limit(0), str(tmp_path / "none"), ordered.ORDERS["facts"])
    assert empty.count() == 0 and ordered.parts(spark, str(tmp_path / "none")) == []


# -- documents ----------------------------------------------------------------------------------------------------------------


def plain(df):
    return sorted(json.dumps(r.asDict(True), sort_keys=True, default=str) for r in df.collect())


def test_a_document_is_read_back_as_it_was(spark, normalized, tmp_path):
    path = str(tmp_path / "facts.json")
    documents.export_facts(normalized, path, 40)
    doc = json.loads(Path(path).read_text())
    assert list(doc) == ["schemaVersion", "facts", "unsupported", "correlation"] and list(doc["correlation"]) == ["canonicalEntities", "links", "metrics", "diagnostics"]
    assert len(doc["facts"]) == normalized.facts.count() and len(doc["unsupported"]) == normalized.unsupported.count()
    e = doc["facts"][0]
    assert e["providerNative"] == {"$ref": f"nativeEvidence:{e['nativeEvidence']['id']}/providerNative"} == e["nativeEvidence"]["observation"]["providerNative"] and "p" in e["nativeEvidence"]["providerNative"]
    keys = [(r.exact_key, r.fact_id) for r in normalized.facts.orderBy("exact_key", "fact_id").collect()]
    assert [f["factId"] for f in doc["facts"]] == [k[1] for k in keys]
    back = documents.import_facts(spark, path)
    (tmp_path / "flat.json").write_text(json.dumps(doc))  # the same document in another layout
    flat = documents.import_facts(spark, str(tmp_path / "flat.json"))
    c = normalized.correlation
    for name, df in (("facts", normalized.facts), ("unsupported", normalized.unsupported), ("evidence", normalized.evidence), ("canonical", c.canonical), ("links", c.links), ("metrics", c.metrics), ("diagnostics", c.diagnostics)):
        assert plain(back[name].select(*df.columns)) == plain(df), name
        if name != "evidence":  # its payloads' spaces and order of keys may differ
            assert plain(flat[name].select(*df.columns)) == plain(df), name
    assert back["members"].count() == flat["members"].count() == c.members.count()
    views, want = workflow.matrix_from_document(spark, path), workflow.build_matrix(*normalized.descriptors(), metrics=c.metrics)
    for name in ("rows", "coverage"):
        assert plain(views[name]) == plain(want[name]), name
    assert views["records"].count() == want["rows"].count()


def test_documents_of_another_version_and_without_rows(spark, normalized, tmp_path):
    (tmp_path / "v2.json").write_text('{"schemaVersion": 2, "facts": []}')
    with pytest.raises(ValueError):
        documents.import_facts(spark, str(tmp_path / "v2.json"))
    none = normalize_facts(spark.createDataFrame([], OBSERVATION))
    documents.export_facts(none, str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["facts"] == []
    assert documents.import_facts(spark, str(tmp_path / "none.json"))["facts"].count() == 0


def test_payloads_of_any_kind_are_kept(spark, tmp_path):
    natives = ['{"b":1,"a":"x"}', '"text"', "17", "[1,2]", "not json", '{"q":"a\\"b\\nc"}']
    rows = [(1, (f"s{i}", "function"), "reads", (None, "v\n,\""), ("p", "1", "deterministic"), ("r", "a" * 40), ("a.ts", None), "deterministic", n) for i, n in enumerate(natives)]
    documents.export_facts(normalize_facts(spark.createDataFrame(rows, OBSERVATION)), str(tmp_path / "d.json"))
    back = documents.import_facts(spark, str(tmp_path / "d.json"))
    got = {r.observation.subject.id: r.providerNative for r in back["evidence"].collect()}
    assert [got[f"s{i}"] for i in range(6)] == [*natives[:4], '"not json"', natives[5]]
    assert {r.value for r in back["facts"].collect()} == {'v\n,"'}


# -- plug-ins -----------------------------------------------------------------------------------------------------------------


def telling():
    """A plug-in that says which predicate it was asked for (made here, so that it is sent to workers by value)."""

    class Telling(plugins.ProviderPlugin):
        identity = ("telling", "2.0.0", "deterministic")

        def partitions(self, options):
            return [1, 2, 3]

        def observe(self, partition, options):
            for p in ("reads", "calls"):
                yield {"subject": (f"s{partition}", "function"), "predicate": p, "object": options.get("predicate", "all"), "path": "a.ts", "span": "L1C1-L1C2"}

    return Telling


def test_plugin_filters_are_pushed_down(spark):
    Telling = telling()  # noqa: N806
    plugins.register(spark, Telling)
    df = spark.read.format("telling").option("revision", "a" * 40).option("source", "r").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 6
    assert df.where(F.col("repository.commitSha") == "b" * 40).count() == 0 and df.where(F.col("provider.id") == "another").count() == 0
    wanted = df.where("predicate = 'reads'").collect()
    assert len(wanted) == 3 and {r.object.value for r in wanted} == {"reads"} and {r.repository.commitSha for r in wanted} == {"a" * 40}
    reader = plugins._Reader(Telling, {"revision": "a" * 40})
    from pyspark.sql.datasource import EqualTo

    given = [EqualTo(("repository", "commitSha"), "c" * 40), EqualTo(("predicate",), "reads"), EqualTo(("determinism",), "x")]
    assert list(reader.pushFilters(given)) == given[1:] and [p.value for p in reader.partitions()] == [plugins._NOTHING] and list(reader.read(reader.partitions()[0])) == []


# -- Protobuf -----------------------------------------------------------------------------------------------------------------


def test_scip_bytes(spark, tmp_path):
    doc = {"relative_path": "g/é.ts", "occurrences": [{"range": [1, 2, 300], "symbol": "S", "symbol_roles": 1}, {"range": [3, 0, 4, 2], "symbol": "", "symbol_roles": 0}],
           "symbols": [{"symbol": "S", "relationships": [{"symbol": "I", "is_implementation": True, "is_type_definition": False}]}]}
    tool = scip._bytes_field(1, scip._bytes_field(2, scip._bytes_field(1, b"tool") + scip._bytes_field(2, b"9.9")))
    unknown = scip._number(9 << 3 | 5) + b"abcd" + scip._number(10 << 3 | 1) + b"abcdefgh" + scip._number(11 << 3) + scip._number(5)
    unpacked = scip._bytes_field(2, scip._bytes_field(1, b"u.ts") + scip._bytes_field(2, scip._number(1 << 3) + scip._number(7) + scip._number(1 << 3) + scip._number(8) + scip._bytes_field(2, b"T")))
    (tmp_path / "a.scip").write_bytes(tool + unknown + scip.encode_document(doc) + unpacked)
    (tmp_path / "b.scip").write_bytes(b"")
    got = {r.documents[0].relative_path: r.documents[0].asDict(True) for r in scip.read_index(spark, str(tmp_path)).collect()}
    assert got["g/é.ts"] == doc and got["u.ts"]["occurrences"] == [{"range": [7, 8], "symbol": "T", "symbol_roles": 0}] and len(got) == 2
    assert scip.tool_version(spark, str(tmp_path / "a.scip"), "none") == "9.9" and scip.tool_version(spark, str(tmp_path / "b.scip"), "none") == "none"
    (tmp_path / "c.scip").write_bytes(scip.encode_document(doc)[:-3])
    with pytest.raises(Exception, match="cut off"):
        scip.read_index(spark, str(tmp_path)).collect()


# -- the limit on all pairs ----------------------------------------------------------------------------------------------------


def test_first_pairs_are_those_of_one_sort(spark):
    rng = random.Random(3)
    ids = [f"{rng.randrange(16**6):06x}{'0' * 58}" for _ in range(40)] + [f"abcd1234{i:056x}" for i in range(40)]
    rows = list({(a, b): ((rng.choice(ids), rng.choice("xy"), str(rng.randrange(9))), a, b) for a in ids for b in ids if a < b and rng.random() < 0.3}.values())
    df = spark.createDataFrame(rows, "rank struct<first:string,class:string,key:string>, left string, right string")
    order = [r[1:] for r in sorted(rows)]
    for n in (0, 1, 17, len(rows) // 2, len(rows) - 1, len(rows), len(rows) + 9):
        assert sorted((r.left, r.right) for r in C.first_pairs(df, n).collect()) == sorted(order[:n]), n


# -- states kept up to date ----------------------------------------------------------------------------------------------------


def test_batches_in_any_order_give_the_same_states(spark, tmp_path):
    f = corpora.facts(spark, SMALL).where("pmod(xxhash64(logical_key), 20) = 0")
    late = f.withColumn("logical_key", F.when(F.pmod(F.xxhash64("logical_key"), F.lit(60)) != 0, F.col("logical_key")))
    rows = late.collect()
    want = {(r.key, r.state, r.n_variants, len(r.providers)) for r in M.fact_rows(spark.createDataFrame(rows, DESCRIPTOR), spark.createDataFrame([], DESCRIPTOR)).where("comparison_possible").collect()}
    for turn in range(2):
        folder, out, state = (str(tmp_path / f"{x}{turn}") for x in ("in", "out", "state"))
        batches = [rows[i::3] for i in range(3)] if turn else [rows[::-1][:50], rows, rows[5:40]]
        for n, b in enumerate(batches):
            spark.createDataFrame(b, DESCRIPTOR).coalesce(1).write.mode("append").parquet(folder)
            incremental.follow(spark, folder, out, state, 1).awaitTermination()
        got = incremental.latest(spark.read.parquet(out)).collect()
        assert {(r.logical_key, r.state, r.n_variants, r.n_providers) for r in got} == want
        changes = spark.read.parquet(out)
        assert changes.groupBy("logical_key", "version").count().where("count > 1").count() == 0
