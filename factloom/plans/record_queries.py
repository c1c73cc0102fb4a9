"""Named queries over full records, key lists and documents, and SQL that gives the same rows."""

from __future__ import annotations

import pathlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import matrix as M
from ..operators.entities import extract_entities
from ..operators.facts import normalize_facts
from ..operators.records import Records, matrix_records
from ..sources import corpora, documents, ordered, plugins, readers, scip
from ..streaming import incremental
from . import workflow

#: Providers of the records' registry in order; the last says nothing.
PROVIDERS = ("ledger", "rollup", "master", "history", "stream", "lines", "silent")
#: Ids and variants that a record of these queries lists.
LISTED = 3


def registry(spark: SparkSession, names: tuple[str, ...] = PROVIDERS) -> DataFrame:
    listed = F.array(*[F.struct(corpora.provider(n).alias("provider"), F.lit(i + 1).alias("ord")) for i, n in enumerate(names)])
    return spark.range(1).select(F.explode(listed).alias("x")).select("x.*")


def _names(providers: Column) -> Column:
    return F.array_join(F.transform(providers, lambda p: p.id), ",")


def _counted(x: Column) -> Column:
    """Numbers of ids, and the ids that are listed."""
    return F.concat(x.n_facts.cast("string"), F.lit(":"), F.array_join(x.fact_ids, ","), F.lit(";"), x.n_evidence.cast("string"), F.lit(":"), F.array_join(x.evidence_ids, ","))


def _records(spark: SparkSession, sf_dir: str) -> Records:
    return matrix_records(*corpora.claims(spark, sf_dir), registry(spark), LISTED)


def full_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable, unresolved and unsupported records: their variants with ends and ids, and a cell for each provider of the registry."""
    variant = lambda v: F.concat(v.variant, F.lit("["), _names(v.providers), F.lit("]("), _counted(v), F.lit(")"), v.subject.native_id, F.lit(">"), v.value)
    cell = lambda s: F.concat(s.provider.id, F.lit("="), s.state, F.lit("("), _counted(s), F.lit(")"))
    return _records(spark, sf_dir).records.select(
        "key", "logical_key", "fact_class", "state", "comparison_possible", "correlation_status", "n_variants", F.array_join(F.transform("variants", variant), "|").alias("variants"),
        F.array_join(F.transform("provider_states", cell), "|").alias("cells"), _names(F.col("observed")).alias("observed"), _names(F.col("missing")).alias("missing"))


def record_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every variant of every record, beyond those that records list."""
    return _records(spark, sf_dir).variants.select("key", "variant", "predicate", _names(F.col("providers")).alias("providers"), F.col("subject.native_id").alias("native_id"), F.size("subject.candidate_ids").alias("candidates"), "value", "n_facts", "n_evidence")


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of every record, beyond those that records list."""
    return _records(spark, sf_dir).ids.groupBy("key", "variant", F.col("provider.id").alias("provider"), "kind").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is comparable, and what isn't, with a registry of those who say it."""
    return *corpora.claims(spark, sf_dir), registry(spark)


def overlap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, p = _facts(spark, sf_dir)
    return M.overlap_keys(f, p).select(F.col("left.id").alias("left"), F.col("right.id").alias("right"), "fact_class", "exact_key")


def conflict_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, p = _facts(spark, sf_dir)
    return M.conflict_keys(f, p).select(F.col("left.id").alias("left"), F.col("right.id").alias("right"), "fact_class", "logical_key")


def all_provider_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact keys of the three providers of customers that all three have."""
    f, _, _ = _facts(spark, sf_dir)
    return M.all_provider_keys(f, registry(spark, ("master", "history", "stream")))


def gain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, u, p = _facts(spark, sf_dir)
    return M.gain_ids(f, u, p).select(F.col("provider.id").alias("provider"), "kind", "fact_class", "id")


def comparisons_all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in all five states: orders and customers, events without a common meaning, and nations, of whom nobody says anything."""
    f, u = corpora.facts(spark, sf_dir), corpora.unsupported(spark, sf_dir)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("nation:"), "n_nationkey").alias("key"), F.lit("defines").alias("fact_class"))
    wanted = f.select(F.col("group_key").alias("key"), "fact_class").union(nations)
    return M.compare_fact_sets(f, u, groups=wanted).groupBy("fact_class", "state", "variants", "n_providers").agg(F.count("*").alias("n"))


def null_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native records whose node is absent, null, a string, a list, an object of another id, or of their own id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id is not null and user_id is not null").withColumn("id", F.concat(F.lit("u"), "user_id")).withColumn("k", F.col("event_id") % 6)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    node = F.when(F.col("k") == 1, "null").when(F.col("k") == 2, '"text"').when(F.col("k") == 3, '["a"]').when(F.col("k") == 4, '{"id":"other"}').when(F.col("k") == 5, F.concat(F.lit('{"name":"inner","id":'), quoted(F.col("id")), F.lit("}")))
    native = F.concat(F.lit('{"id":'), quoted(F.col("id")), F.lit(',"name":"own","signature":"S"'), F.coalesce(F.concat(F.lit(',"node":'), node), F.lit("")), F.lit("}"))
    none = F.lit(None).cast("struct<id:string,kind:string>")
    o = e.select(
        F.lit(1).alias("schemaVersion"), F.struct("id", F.lit("function").alias("kind")).alias("subject"), F.lit("reads").alias("predicate"), F.struct(none.alias("entity"), F.lit("x").alias("value")).alias("object"),
        corpora.provider("stream").alias("provider"), corpora.repository().alias("repository"), F.struct(F.lit("events.ts").alias("path"), F.lit(None).cast("string").alias("span")).alias("source"), F.lit("deterministic").alias("determinism"), native.alias("providerNative"))
    said = F.when(F.col("name") == F.col("id"), "id").otherwise(F.col("name"))
    return extract_entities(o).groupBy(said.alias("name"), "signature").agg(F.count("*").alias("n"))


def ordered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logical facts in sorted files of 1000 rows, read back with the number of their file."""
    folder = storage.scratch_path(spark, "rows")
    ordered.write_ordered(M.fact_rows(corpora.facts(spark, sf_dir), corpora.unsupported(spark, sf_dir)), folder, ordered.ORDERS["rows"], 1000)
    return spark.read.schema("key string, state string, part_no int").json(f"{folder}/data")


def ordered_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and ranges of those files."""
    folder = storage.scratch_path(spark, "rows")
    found = ordered.write_ordered(M.fact_rows(corpora.facts(spark, sf_dir), corpora.unsupported(spark, sf_dir)), folder, ordered.ORDERS["rows"], 1000)
    return found.select("part_no", "n", F.get_json_object("first", "$.k2").alias("first"), F.get_json_object("last", "$.k2").alias("last"))


def _document(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """What three providers observe about customers, normalized, written as one document, in volumes, and read again."""
    path = storage.scratch_path(spark, "facts") + ".json"
    documents.export_facts(normalize_facts(corpora.customer_observations(spark, sf_dir)), path, 500, volumes=True)
    return documents.import_facts(spark, path)


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _document(spark, sf_dir)
    cols = ("provider", "predicate", "status", "fact_status", "value")
    both = d["facts"].select(*cols).unionByName(d["unsupported"].select(*cols))
    return both.groupBy(F.col("provider.id").alias("provider"), "predicate", "status", "fact_status").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))


def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that the document's references lead to, and the observations kept beside them."""
    d = _document(spark, sf_dir)
    named = d["facts"].select("evidence_id", "predicate").unionByName(d["unsupported"].select("evidence_id", "predicate"))
    said = F.try_variant_get(F.try_parse_json("providerNative"), "$.p", "string")
    return named.join(d["evidence"], "evidence_id", "left").groupBy(named.predicate.alias("predicate"), ((said == named.predicate) & (F.col("observation.predicate") == named.predicate)).alias("same")).agg(F.count("*").alias("n"), F.count_distinct("evidence_id").alias("ids"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of an index: a line is an occurrence, its part a symbol; the first line of a part defines it."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct(
        F.array(*[c.cast("long") for c in (F.col("l_linenumber"), F.lit(0), F.lit(4))]).alias("range"), F.when(F.col("l_linenumber") != 7, F.concat(F.lit("part "), "l_partkey")).otherwise("").alias("symbol"), F.when(F.col("l_linenumber") == 1, 1).otherwise(8).cast("long").alias("symbol_roles")).alias("o"),
        F.struct(F.concat(F.lit("part "), "l_partkey").alias("symbol"), F.array(F.struct(F.concat(F.lit("supplier "), "l_suppkey").alias("symbol"), (F.col("l_suppkey") % 2 == 0).alias("is_implementation"), (F.col("l_suppkey") % 3 == 0).alias("is_type_definition"))).alias("relationships")).alias("s"))
    docs = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("o")).alias("occurrences"), F.collect_list("s").alias("symbols"))
    return docs.select(F.concat(F.lit("orders/"), "l_orderkey").alias("relative_path"), "occurrences", "symbols")


def scip_protobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of Protobuf indexes, one for each batch of a task's rows: the same observations as of their JSON form."""
    docs = order_documents(spark, sf_dir)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(map(scip.encode_document, b.to_pylist()))], pa.binary())], ["content"])

    indexes = docs.mapInArrow(encode, "content binary")
    # read three times below, decoded once
    index = storage.materialize(scip.documents(indexes), "documents").select(F.array(F.struct("relative_path", "occurrences", "symbols")).alias("documents"))
    o = readers.scip_observations(index, ("scip", "1.0.0", "deterministic"), ("sample", "a" * 40))
    return o.groupBy("predicate", F.col("object.entity").isNotNull().alias("to_entity"), F.col("source.span").isNotNull().alias("placed")).agg(F.count("*").alias("n"), F.count_distinct("subject.id").alias("subjects"))


class _Table(plugins.ProviderPlugin):
    """Observes a Parquet table's customers, a row group at a time: their market segment, and whom they come before."""

    identity = ("segments", "1.0.0", "deterministic")

    def partitions(self, options):
        files = _files(options["path"])
        return [(f, g) for f in files for g in range(pq.ParquetFile(f).num_row_groups)]

    def observe(self, partition, options):
        rows = pq.ParquetFile(partition[0]).read_row_group(partition[1], columns=["c_custkey", "c_mktsegment"]).to_pylist()
        for r in rows:
            k = r["c_custkey"]
            if k is not None:
                about = {"subject": (f"c{k}", "function"), "path": f"customers/{k}.ts"}
                yield about | {"predicate": "reads", "object": r["c_mktsegment"] or ""}
                yield about | {"predicate": "calls", "object": (f"c{k + 1}", "function")}


class _Broken(_Table):
    """Fails in the midst of its work."""

    identity = ("broken", "1.0.0", "deterministic")

    def observe(self, partition, options):
        for n, o in enumerate(super().observe(partition, options)):
            if n == 5:
                raise RuntimeError("the provider's tool has ended")
            yield o


class _Elsewhere(_Table):
    """Has analysed another revision, so nothing of it may be read."""

    identity = ("elsewhere", "1.0.0", "deterministic")

    def revision(self, options):
        return "b" * 40


def _files(path: str) -> list[str]:
    found = pathlib.Path(path.removeprefix("file://"))
    return sorted(map(str, found.glob("*.parquet"))) if found.is_dir() else [str(found)]


def plugin_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over three plug-ins over the customers: one is read, one fails and leaves nothing, one has another revision."""
    kinds = (_Table, _Broken, _Elsewhere)
    plugins.register(spark, *kinds)
    options = {"source": "sample", "path": f"{sf_dir}/customer.parquet"}
    result = workflow.run(spark, [plugins.PluginProvider(k.identity, "a" * 40, options) for k in kinds], "sample", "a" * 40)
    told = spark.createDataFrame([(e["identity"]["id"], e["status"]) for e in result.manifest["providers"]], "provider string, status string")
    rows = result.observations.groupBy(F.col("provider.id").alias("provider")).agg(
        F.count("*").alias("n"), F.count_if(F.col("predicate") == "reads").alias("reads"), F.count_distinct("subject.id").alias("subjects"), F.count_if(F.col("object.value").isNull()).alias("to_entity"))
    return told.join(rows, "provider", "left").fillna(0)


def incremental_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that arrive in five files, one batch for each: the last state of every logical key."""
    root = storage.scratch_path(spark, "stream")
    corpora.facts(spark, sf_dir).repartition(5, F.xxhash64("evidence_id")).write.parquet(f"{root}/in")
    incremental.follow(spark, f"{root}/in", f"{root}/out", f"{root}/state", 1).awaitTermination()
    return incremental.latest(spark.read.parquet(f"{root}/out")).select(F.col("logical_key").alias("key"), "fact_class", "state", "correlation_status", "n_variants", "n_providers")


_QUERIES = (scip_protobuf, plugin_run, incremental_states, ordered_rows, ordered_manifest, document_facts, document_references, full_records, record_variants, record_ids, overlap_keys, conflict_keys, all_provider_keys, gain_ids, comparisons_all_states, null_nodes)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


#: What every provider claims, with the key of its record and variant.
_CLAIMS = """
g AS (SELECT provider, fact_class, logical_key, logical_key || '=' || value AS exact_key, value, provider || '/' || logical_key || '=' || value AS fact_id, provider || '#' || logical_key || '=' || value AS evidence_id FROM f
  UNION ALL SELECT 'lines', 'reads', 'order:' || l_orderkey, 'order:' || l_orderkey || '=' || coalesce(l_linestatus, ''), coalesce(l_linestatus, ''), 'lines/' || l_orderkey || '/' || l_linenumber, 'lines#' || l_orderkey || '/' || l_linenumber FROM lineitem),
h AS (SELECT *, CASE WHEN provider = 'history' AND split_part(logical_key, ':', 2)::BIGINT % 7 = 0 THEN 'ambiguous' WHEN provider = 'history' AND split_part(logical_key, ':', 2)::BIGINT % 11 = 0 THEN 'unmatched' ELSE 'matched' END AS status FROM g),
e0 AS (SELECT 'stream' AS provider, event_type AS fact_class, 'customer:' || user_id || ':' || event_type AS logical_key, concat_ws('/', event_id, props->>'$.k') AS value FROM events),
cl AS (SELECT CASE WHEN status = 'matched' THEN logical_key ELSE 'unresolved:{"id":"' || provider || '","version":"1.0.0","determinism":"deterministic"}:' || fact_id END AS key,
    CASE WHEN status = 'matched' THEN logical_key ELSE 'unresolved:' || exact_key END AS logical, exact_key AS variant, CASE WHEN status = 'matched' THEN 'c' ELSE 'r' END AS kind, status, provider, fact_class, fact_id, evidence_id, logical_key AS about, exact_key, value FROM h
  UNION ALL SELECT 'unsupported:' || logical_key, 'unsupported:' || logical_key, 'unsupported:stream#' || logical_key || '=' || value, 'u', 'not-applicable', provider, fact_class, NULL, 'stream#' || logical_key || '=' || value, logical_key, NULL, value FROM e0),
pr AS (SELECT * FROM (VALUES ('ledger', 1), ('rollup', 2), ('master', 3), ('history', 4), ('stream', 5), ('lines', 6), ('silent', 7)) AS x(provider, ord)),
cs AS (SELECT DISTINCT provider, ord, fact_class, about AS logical_key, exact_key FROM cl JOIN pr USING (provider) WHERE kind = 'c')
"""
_ids = "count(DISTINCT fact_id) || ':' || coalesce(array_to_string(list_sort(list(DISTINCT fact_id) FILTER (fact_id IS NOT NULL))[:3], ','), '') || ';' || count(DISTINCT evidence_id) || ':' || array_to_string(list_sort(list(DISTINCT evidence_id))[:3], ',')"
_VARIANTS = f"""
va AS (SELECT key, variant, min(fact_class) AS predicate, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, {_ids} AS ids, min(provider) || '/' || any_value(about) AS native_id, any_value(value) AS value,
    min(CASE WHEN status = 'ambiguous' THEN 2 ELSE 0 END)::INT AS candidates, count(DISTINCT fact_id) AS n_facts, count(DISTINCT evidence_id) AS n_evidence FROM cl GROUP BY key, variant)
"""
_RECORDS = f"""
ce AS (SELECT key, provider, {_ids} AS ids FROM cl GROUP BY key, provider),
ro AS (SELECT key, min(logical) AS logical_key, min(fact_class) AS fact_class, min(kind) AS kind, min(status) AS status, count(DISTINCT provider) AS np, string_agg(DISTINCT provider, ',' ORDER BY provider) AS observed FROM cl GROUP BY key),
vs AS (SELECT key, count(*) AS n_variants, array_to_string(list(variant || '[' || providers || '](' || ids || ')' || native_id || '>' || value ORDER BY variant)[:3], '|') AS variants FROM va GROUP BY key),
rs AS (SELECT *, CASE kind WHEN 'u' THEN 'unsupported' WHEN 'r' THEN status ELSE CASE WHEN n_variants > 1 THEN 'conflict' WHEN np > 1 THEN 'overlap' ELSE 'provider-only' END END AS state FROM ro JOIN vs USING (key)),
cx AS (SELECT rs.key, string_agg(pr.provider || '=' || CASE WHEN ce.key IS NULL THEN 'missing' WHEN kind = 'c' THEN 'present' ELSE state END || '(' || coalesce(ce.ids, '0:;0:') || ')', '|' ORDER BY ord) AS cells,
    coalesce(string_agg(pr.provider, ',' ORDER BY ord) FILTER (ce.key IS NULL), '') AS missing FROM rs CROSS JOIN pr LEFT JOIN ce ON ce.key = rs.key AND ce.provider = pr.provider GROUP BY rs.key)
"""


def oracle_sql(facts: str, same_as: dict[str, str]) -> dict[str, str]:
    """``facts``: common table expressions that give f; ``same_as``: SQL of queries that documents must not change."""
    over = lambda sql, *more: f"WITH {', '.join(x.strip() for x in (facts, _CLAIMS, *more))} {sql}"
    met = """(SELECT a.provider AS "left", b.provider AS "right", a.fact_class, logical_key FROM (SELECT provider, ord, fact_class, logical_key, list_sort(list(exact_key)) AS v FROM cs GROUP BY ALL) a
        JOIN (SELECT provider, ord, fact_class, logical_key, list_sort(list(exact_key)) AS v FROM cs GROUP BY ALL) b USING (logical_key) WHERE a.ord < b.ord AND a.fact_class = b.fact_class AND a.v <> b.v)"""
    return {
        "scip_protobuf": same_as["scip_observations"],
        "plugin_run": """SELECT 'segments' AS provider, 'ok' AS status, 2 * count(*) AS n, count(*) AS reads, count(DISTINCT c_custkey) AS subjects, count(*) AS to_entity FROM customer WHERE c_custkey IS NOT NULL
            UNION ALL SELECT 'broken', 'failed', 0, 0, 0, 0 UNION ALL SELECT 'elsewhere', 'ok', 0, 0, 0, 0""",
        "incremental_states": f"WITH {facts.strip()} SELECT key, fact_class, state, correlation_status, n_variants, n_providers FROM r WHERE comparison_possible",
        "document_facts": same_as["normalized_facts"], "document_references": same_as["evidence_payloads"],
        "full_records": over("SELECT rs.key, logical_key, fact_class, state, kind = 'c' AS comparison_possible, status AS correlation_status, n_variants, variants, cells, observed, missing FROM rs JOIN cx USING (key)", _VARIANTS, _RECORDS),
        "record_variants": over("SELECT key, variant, predicate, providers, native_id, candidates, value, n_facts, n_evidence FROM va", _VARIANTS),
        "record_ids": over("SELECT key, variant, provider, kind, count(DISTINCT id) AS n, min(id) AS first, max(id) AS last FROM (SELECT key, variant, provider, 'fact' AS kind, fact_id AS id FROM cl WHERE fact_id IS NOT NULL UNION ALL SELECT key, variant, provider, 'evidence', evidence_id FROM cl) GROUP BY ALL"),
        "overlap_keys": over('SELECT a.provider AS "left", b.provider AS "right", a.fact_class, a.exact_key FROM cs a JOIN cs b ON a.exact_key = b.exact_key AND a.fact_class = b.fact_class AND a.ord < b.ord'),
        "conflict_keys": over(f"SELECT * FROM {met}"),
        "all_provider_keys": over("SELECT fact_class, exact_key FROM cs WHERE provider IN ('master', 'history', 'stream') GROUP BY ALL HAVING count(DISTINCT provider) = 3"),
        "gain_ids": over("""SELECT provider, 'new' AS kind, fact_class, exact_key AS id FROM (SELECT *, min(ord) OVER (PARTITION BY exact_key) AS m FROM cs) WHERE ord = m
            UNION ALL SELECT min(provider), 'unique', min(fact_class), logical_key FROM cs GROUP BY logical_key HAVING count(DISTINCT provider) = 1
            UNION ALL SELECT provider, status, fact_class, fact_id FROM cl WHERE kind = 'r' UNION ALL SELECT provider, 'unsupported', fact_class, evidence_id FROM cl WHERE kind = 'u'"""),
        "comparisons_all_states": f"""WITH {facts.strip()}, x AS (SELECT logical_key, any_value(fact_class) AS fact_class, count(DISTINCT value) AS variants, count(DISTINCT provider) AS n_providers FROM f GROUP BY logical_key)
            SELECT fact_class, CASE WHEN variants > 1 THEN 'conflict' WHEN n_providers > 1 THEN 'equivalent' ELSE 'provider-only' END AS state, variants, n_providers, count(*) AS n FROM x GROUP BY ALL
            UNION ALL SELECT fact_class, 'unsupported', 0, 1, count(DISTINCT key) FROM u GROUP BY fact_class
            UNION ALL SELECT 'defines', 'absent', 0, 0, count(DISTINCT n_nationkey) FROM nation""",
        "ordered_rows": f"WITH {facts.strip()} SELECT key, state, ((row_number() OVER (ORDER BY fact_class, key) - 1) // 1000)::INT AS part_no FROM r",
        "ordered_manifest": f"""WITH {facts.strip()}, o AS (SELECT key, row_number() OVER (ORDER BY fact_class, key) - 1 AS nth FROM r)
            SELECT (nth // 1000)::INT AS part_no, count(*) AS n, arg_min(key, nth) AS first, arg_max(key, nth) AS last FROM o GROUP BY nth // 1000""",
        "null_nodes": """SELECT CASE WHEN event_id % 6 = 4 THEN 'id' WHEN event_id % 6 = 5 THEN 'inner' ELSE 'own' END AS name, CASE WHEN event_id % 6 < 4 THEN 'S' END AS signature, count(*) AS n
            FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL""",
    }
