"""Readers of provider artifacts, and adapters from a provider's own form to observations."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import validate_observations
from ..schemas import OBSERVATION, OBSERVATION_JSON, RELATIONS, SCIP, WIRING

_OBJECT = "struct<entity:struct<id:string,kind:string>,value:string>"


def _from_json(df: DataFrame) -> DataFrame:
    o = F.col("object")
    entity = F.when(o.id.isNotNull() & o.kind.isNotNull(), F.struct(o.id.alias("id"), o.kind.alias("kind")))
    return df.withColumn("object", F.struct(entity.alias("entity"), F.when(entity.isNull(), o.value).alias("value")).cast(_OBJECT))


def read_artifact(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Observations of one artifact: JSON lines (``.jsonl``), or one JSON array. A malformed file is an error."""
    by_line = path.endswith((".jsonl", ".jsonl.gz")) if lines is None else lines
    return _from_json(spark.read.schema(OBSERVATION_JSON).option("mode", "FAILFAST").option("multiLine", not by_line).json(path))


def read_artifacts(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """All artifacts of a run; paths are relative and stay below the root. Structural errors end the scan."""
    out = spark.createDataFrame([], OBSERVATION)
    for p in paths:
        if PurePosixPath(p).is_absolute() or ".." in PurePosixPath(p).parts:
            raise ValueError(f"artifact path leaves the run: {p}")
        out = out.unionByName(read_artifact(spark, f"{root}/{p}"))
    bad = validate_observations(out, tolerate_predicate=True).where(F.size("errors") > 0).select("errors").head(1)
    if bad:
        raise ValueError(f"invalid observation: {', '.join(bad[0].errors)}")
    return out


def read_wiring(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a wiring graph."""
    g = spark.read.schema(WIRING).option("multiLine", True).json(path)
    return g.select(F.explode("nodes").alias("n")).select("n.*"), g.select(F.explode("edges").alias("e")).select("e.*")


def wiring_observations(nodes: DataFrame, edges: DataFrame, provider: tuple[str, str, str], repository: tuple[str, str]) -> DataFrame:
    """Edges of known relations whose two ends are nodes, as observations; others are dropped."""
    lit = lambda names, values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    end = lambda name, key: nodes.select(F.col("id").alias(key), F.struct(*nodes.columns).alias(name))
    met = edges.where(F.col("relation").isin(*RELATIONS)).join(end("s", "source"), "source").join(end("t", "target"), "target")
    native = F.to_json(F.struct(F.col("s").alias("node"), F.col("s").alias("sourceNode"), F.col("t").alias("targetNode"), F.struct("source", "target", "relation", "confidence").alias("edge")))
    entity = lambda n: F.struct(F.col(f"{n}.id").alias("id"), F.col(f"{n}.kind").alias("kind"))
    return met.select(
        F.lit(1).alias("schemaVersion"), entity("s").alias("subject"), F.col("relation").alias("predicate"), F.struct(entity("t").alias("entity"), F.lit(None).cast("string").alias("value")).alias("object"),
        lit(("id", "version", "determinism"), provider).alias("provider"), lit(("source", "commitSha"), repository).alias("repository"), F.struct(F.col("s.path").alias("path"), F.col("s.span").alias("span")).alias("source"),
        F.lit(provider[2]).alias("determinism"), native.alias("providerNative"))


def scip_observations(index: DataFrame, provider: tuple[str, str, str], repository: tuple[str, str]) -> DataFrame:
    """A SCIP index as JSON (schema SCIP) to observations: occurrences, then relationships of symbols."""
    lit = lambda names, values: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
    docs = index.select(F.explode("documents").alias("d")).select("d.*")
    at = lambda i: F.get("o.range", F.lit(i)).cast("string")
    three = F.size("o.range") == 3
    span = F.when(F.size("o.range").isin(3, 4), F.concat(at(0), F.lit(":"), at(1), F.lit("-"), F.when(three, at(0)).otherwise(at(2)), F.lit(":"), F.when(three, at(2)).otherwise(at(3))))
    occ = docs.select("relative_path", F.posexplode("occurrences").alias("pos", "o")).where(F.length("o.symbol") > 0)
    occ = occ.select("relative_path", "pos", F.col("o.symbol").alias("symbol"), F.when(F.coalesce("o.symbol_roles", F.lit(0)).bitwiseAND(1) == 1, "defines").otherwise("references").alias("predicate"), span.alias("span"), F.to_json("o").alias("native"))
    first = occ.where("predicate = 'defines'").groupBy("relative_path", "symbol").agg(F.min_by("span", "pos").alias("span"))
    rel = docs.select("relative_path", F.explode("symbols").alias("s")).select("relative_path", F.col("s.symbol").alias("symbol"), F.explode("s.relationships").alias("r"))
    kind = F.when(F.col("r.is_implementation"), "implements").when(F.col("r.is_type_definition"), "type-of")
    rel = rel.select("relative_path", "symbol", kind.alias("predicate"), F.col("r.symbol").alias("to"), F.to_json("r").alias("native")).where("predicate is not null").join(first, ["relative_path", "symbol"], "left")
    both = occ.select("relative_path", "symbol", "predicate", F.lit(None).cast("string").alias("to"), "native", "span").unionByName(rel)
    entity = lambda c: F.struct(c.alias("id"), F.lit("symbol").alias("kind"))
    object_ = F.struct(F.when(F.col("to").isNotNull(), entity(F.col("to"))).alias("entity"), F.when(F.col("to").isNull(), F.col("relative_path")).alias("value")).cast(_OBJECT)
    return both.select(
        F.lit(1).alias("schemaVersion"), entity(F.col("symbol")).alias("subject"), "predicate", object_.alias("object"), lit(("id", "version", "determinism"), provider).alias("provider"),
        lit(("source", "commitSha"), repository).alias("repository"), F.struct(F.col("relative_path").alias("path"), "span").alias("source"), F.lit(provider[2]).alias("determinism"), F.col("native").alias("providerNative"))


def read_scip(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCIP).option("multiLine", True).json(path)
