"""From provider artifacts to a written provider matrix: sources, facts, views, report and manifest.

The set-oriented work is DataFrames throughout; only the small JSON envelopes and the report are written by the driver.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import matrix as M
from ..operators.facts import NormalizedFacts, normalize_facts, validate_observations
from ..operators.records import matrix_records
from ..schemas import OBSERVATION, VERSION
from ..sources import documents
from ..storage import materialize, write_text
from . import report


class Provider(Protocol):
    """A source of observations; ``identity`` is (id, version, determinism)."""

    identity: tuple[str, str, str]

    def is_available(self) -> bool: ...

    def execute(self, spark: SparkSession) -> DataFrame: ...


@dataclass
class ArtifactProvider:
    """Reads a JSON or JSON-lines artifact that the provider's own tool has written."""

    identity: tuple[str, str, str]
    path: str

    def is_available(self) -> bool:
        return True

    def execute(self, spark: SparkSession) -> DataFrame:
        from ..sources.readers import read_artifact

        return read_artifact(spark, self.path)


@dataclass
class RunResult:
    manifest: dict
    observations: DataFrame
    views: dict[str, DataFrame] = field(default_factory=dict)


def check_revision(revision: str) -> str:
    if not re.fullmatch(r"[0-9a-fA-F]{40}", revision):
        raise ValueError("revision must be a 40-character commit SHA")
    return revision.lower()


def run(spark: SparkSession, providers: list[Provider], source: str, revision: str) -> RunResult:
    """Every provider in order; one that is unavailable or fails is recorded and doesn't stop the others."""
    began, entries, out = time.time(), [], spark.createDataFrame([], OBSERVATION)
    for p in providers:
        entry = {"identity": dict(zip(("id", "version", "determinism"), p.identity)), "status": "ok", "error": None}
        try:
            if not p.is_available():
                entry["status"] = "unavailable"
            else:
                rows = p.execute(spark)
                bad = validate_observations(rows, tolerate_predicate=True).where(F.size("errors") > 0).select("errors").head(1)
                if bad:
                    raise ValueError(f"invalid observation: {', '.join(bad[0].errors)}")
                other = rows.where(F.lower("repository.commitSha") != revision.lower()).select("repository").head(1)
                if other:
                    raise ValueError(f"revision {other[0].repository.commitSha} was read, {revision} was asked for")
                # read once and whole, so that what fails later on is this provider alone
                out = out.unionByName(materialize(rows.select(*out.columns), "provider"))
        except Exception as e:  # a provider's failure is a result of the run
            entry |= {"status": "failed", "error": str(e).split("\n")[0]}
        entries.append(entry)
    iso = lambda t: time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(t))
    manifest = {
        "runId": uuid.uuid4().hex, "startedAt": iso(began), "finishedAt": iso(time.time()), "repository": {"source": source, "commitSha": revision},
        "toolchain": {"spark": spark.version, "python": sys.version.split()[0], "factloom": VERSION}, "providers": entries}
    return RunResult(manifest, out)


def build_matrix(facts: DataFrame, unsupported: DataFrame, providers: DataFrame | None = None, addition_order: list[str] | None = None, metrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """All views over DESCRIPTOR rows by name; ``providers``: the registry, where more are expected than are seen;
    ``metrics``: of the entities, from their correlation. Rows of normalized facts, which have their ends, give full records, too."""
    registry = providers if providers is not None else M.provider_registry(facts, unsupported)
    classes, rows = M.fact_classes(facts, unsupported), M.fact_rows(facts, unsupported)
    order = M.addition_order(registry, addition_order or [])
    slices = {name: rows.where(F.col("state") == state) for name, state in (("conflicts", "conflict"), ("ambiguous", "ambiguous"), ("unmatched", "unmatched"), ("unsupported", "unsupported"), ("overlaps", "overlap"))}
    entities = {} if metrics is None else {"entities": M.entity_coverage(metrics, registry)}
    keys = {
        "overlap_keys": M.overlap_keys(facts, registry), "conflict_keys": M.conflict_keys(facts, registry), "all_provider_keys": M.all_provider_keys(facts, registry),
        "gain_ids": M.gain_ids(facts, unsupported, order)}
    if "subject" in facts.columns:
        full = matrix_records(facts, unsupported, registry)
        keys |= {"records": full.records, "record_variants": full.variants, "record_ids": full.ids}
    return {
        "rows": rows, "variants": M.fact_variants(facts), "states": M.provider_states(rows, registry), "coverage": M.coverage(facts, unsupported, registry), "pairwise": M.pairwise_overlap(facts, registry, classes),
        "all_providers": M.all_provider_overlap(facts, registry, classes), "gain": M.information_gain(facts, unsupported, order).join(M.existing_providers(order).drop("ord"), "provider"), "gain_by_class": M.gain_by_class(facts, order),
        "new_keys": M.new_keys(facts, order), "unique": M.unique_logical(facts), "comparisons": M.compare_fact_sets(facts, unsupported), **keys, **entities, **slices}


TABLES = ("facts", "unsupported", "evidence", "canonical", "members", "links", "metrics", "diagnostics")


def _tables(n: NormalizedFacts) -> dict[str, DataFrame]:
    c = n.correlation
    return dict(zip(TABLES, (n.facts, n.unsupported, n.evidence, c.canonical, c.members, c.links, c.metrics, c.diagnostics)))


def write_facts(normalized: NormalizedFacts, root: str, form: str = "parquet") -> None:
    """Facts, unsupported evidence, payloads and correlation; a payload is stored once, under its evidence id.

    ``form``: parquet, or json for JSON lines. Both are written and read by all executors.
    """
    for name, df in _tables(normalized).items():
        df.write.mode("overwrite").format(form).option("ignoreNullFields", "false").save(f"{root}/normalized/{name}")
    schemas = {name: df.schema.jsonValue() for name, df in _tables(normalized).items()}
    normalized.facts.sparkSession.createDataFrame([(json.dumps({"schemaVersion": 1, "form": form, "schemas": schemas}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/normalized/envelope")


def read_facts(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables that :func:`write_facts` has written, by name; another schema version is an error."""
    envelope = json.loads(spark.read.text(f"{root}/normalized/envelope").first()[0])
    if envelope.get("schemaVersion") != 1:
        raise ValueError(f"facts of schema version {envelope.get('schemaVersion')} can't be read")
    return {name: spark.read.schema(StructType.fromJson(envelope["schemas"][name])).format(envelope["form"]).load(f"{root}/normalized/{name}") for name in TABLES}


def read_descriptors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_facts` has written, as the matrix wants it."""
    cols = ("repository", "provider", F.col("predicate").alias("fact_class"), "group_key", "logical_key", "exact_key", "status", "fact_id", "evidence_id")
    tables = read_facts(spark, root)
    return tuple(tables[n].select(*cols) for n in ("facts", "unsupported"))  # type: ignore[return-value]


def matrix_from_artifact(spark: SparkSession, root: str, providers: DataFrame | None = None, addition_order: list[str] | None = None) -> dict[str, DataFrame]:
    """All views from stored facts."""
    return matrix_from_tables(read_facts(spark, root), providers, addition_order)


def matrix_from_document(spark: SparkSession, path: str, providers: DataFrame | None = None, addition_order: list[str] | None = None) -> dict[str, DataFrame]:
    """All views from facts in one JSON document."""
    tables = {name: materialize(df, f"document-{name}") for name, df in documents.import_facts(spark, path).items()}
    return matrix_from_tables(tables, providers, addition_order)


def matrix_from_tables(tables: dict[str, DataFrame], providers: DataFrame | None = None, addition_order: list[str] | None = None) -> dict[str, DataFrame]:
    facts, unsupported = (tables[n].withColumn("fact_class", F.col("predicate")) for n in ("facts", "unsupported"))
    return build_matrix(facts, unsupported, providers, addition_order, tables["metrics"])


def retain_raw(spark: SparkSession, artifact: str, root: str, provider: str) -> str:
    """A compressed copy of a provider's artifact beside the result; returns its folder."""
    folder = f"{root}/raw/{provider}"
    spark.read.text(artifact).write.mode("overwrite").option("compression", "gzip").text(folder)
    return folder


def write_matrix(views: dict[str, DataFrame], root: str, form: str = "parquet") -> Iterator[str]:
    """Every view, and the counts of their rows; returns the lines of the report, which list everything."""
    spark = next(iter(views.values())).sparkSession
    schemas = {name: df.schema for name, df in views.items()}
    for name, df in views.items():
        df.write.mode("overwrite").format(form).option("ignoreNullFields", "false").save(f"{root}/matrix/{name}")
    back = {name: spark.read.schema(schemas[name]).format(form).load(f"{root}/matrix/{name}") for name in views}
    M.artifact_counts(back).coalesce(1).write.mode("overwrite").json(f"{root}/matrix/counts")
    counts = {r.state: r.n for r in back["rows"].groupBy("state").agg(F.count("*").alias("n")).collect()}
    variants = back["variants"].groupBy("logical_key").agg(F.sort_array(F.collect_list(F.struct("exact_key", "providers"))).alias("variants"))
    conflicts = back["conflicts"].select("key", "fact_class").join(variants, F.col("key") == F.col("logical_key")).orderBy("fact_class", "key")
    return report.lines(
        back["rows"].select("repository.source", "repository.commitSha").distinct().orderBy("source", "commitSha").toLocalIterator(),
        back["coverage"].orderBy("provider", "fact_class").collect(), back["pairwise"].orderBy("left", "right", "fact_class").collect(), back["all_providers"].orderBy("fact_class").collect(),
        back["gain"].orderBy("ord").collect(), conflicts.toLocalIterator(), counts)


def run_matrix(spark: SparkSession, providers: list[Provider], source: str, revision: str, root: str, addition_order: list[str] | None = None) -> RunResult:
    """The whole job. ``root`` is a folder in any file system that Spark knows: tables and small files both go through it."""
    revision = check_revision(revision)
    result = run(spark, providers, source, revision)
    normalized = normalize_facts(result.observations)
    write_facts(normalized, root)
    for p, entry in zip(providers, result.manifest["providers"]):
        if entry["status"] == "ok" and isinstance(p, ArtifactProvider):
            entry["raw"] = retain_raw(spark, p.path, root, p.identity[0])
    identities = [p.identity for p in providers]
    expected = spark.createDataFrame([(i, n + 1) for n, i in enumerate(sorted(identities))], "provider struct<id:string,version:string,determinism:string>, ord int")
    result.views = matrix_from_artifact(spark, root, expected, addition_order or [i[0] for i in identities])
    text = write_matrix(result.views, root)
    write_text(spark, f"{root}/report.md", text)
    write_text(spark, f"{root}/manifest.json", [json.dumps(result.manifest, indent=2)])
    config = {"schemaVersion": 1, "command": "matrix", "source": source, "revision": revision, "providers": [i[0] for i in identities], "additionOrder": addition_order or [i[0] for i in identities]}
    write_text(spark, f"{root}/config.json", [json.dumps(config, indent=2)])
    return result


def main(argv: list[str] | None = None) -> int:
    """``matrix SOURCE --revision SHA --out DIR --artifact ID@VERSION=PATH ...``; ``--config FILE`` instead of source and revision."""
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("command", choices=["run", "matrix"])
    parser.add_argument("source", nargs="?")
    parser.add_argument("--revision")
    parser.add_argument("--out", required=True)
    parser.add_argument("--config")
    parser.add_argument("--artifact", action="append", default=[])
    a = parser.parse_args(argv)
    providers = [ArtifactProvider((*x.split("=", 1)[0].split("@", 1), "deterministic"), x.split("=", 1)[1]) for x in a.artifact]  # type: ignore[arg-type]
    order = None
    try:
        if a.config:
            config = json.loads(Path(a.config).read_text())
            a.source, a.revision, order = config["source"], config["revision"], config["additionOrder"]
            if config["providers"] != [p.identity[0] for p in providers]:
                raise ValueError("the config's providers aren't the registered ones")
            if unknown := set(order) - set(config["providers"]):
                raise ValueError(f"the config names unknown providers: {sorted(unknown)}")
        if not a.source or not a.revision:
            raise ValueError("source and revision are required")
        spark = SparkSession.builder.appName("factloom").getOrCreate()
        if a.command == "matrix":
            run_matrix(spark, providers, a.source, a.revision, a.out, order)
            print(f"{a.out}/report.md")
        else:
            result = run(spark, providers, a.source, check_revision(a.revision))
            write_text(spark, f"{a.out}/manifest.json", [json.dumps(result.manifest, indent=2)])
            result.observations.write.mode("overwrite").parquet(f"{a.out}/observations")
        return 0
    except (ValueError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
