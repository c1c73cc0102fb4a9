"""Findings of round 3, second part: what rows hold while they are grouped."""

from pyspark.sql import functions as F

from factloom.operators import facts, matrix as M
from factloom.operators.entities import extract_entities
from factloom.plans import record_queries
from factloom.sources import corpora


def test_sets_hold_providers_as_numbers(spark):
    """Rows that are grouped to sets have a number in place of a provider, and a set's digest is two longs."""
    rows = [("order:1", "a", "ledger"), ("order:1", "a", "ledger"), ("order:1", "b", "ledger"), ("order:1", "b", "rollup"), ("order:1", "a", "rollup"), ("order:2", "a", "ledger"), ("order:2", "b", "rollup"), ("order:3", "a", "ledger"), (None, "a", "rollup"), ("order:3", "c", "nobody")]
    said = spark.createDataFrame(rows, "logical_key string, exact_key string, who string")
    told = said.select(corpora.provider("x").withField("id", said.who).alias("provider"), M.F.lit("reads").alias("fact_class"), "logical_key", "exact_key")
    providers = record_queries.registry(spark)
    base = M._ordered_sets(told, providers)
    assert sorted(base.columns) == ["exact_key", "fact_class", "logical_key", "ord"] and base.count() == 7
    who = M._held_keys(base).schema["who"].dataType.elementType
    assert [who[x].dataType.typeName() for x in ("n", "h", "g")] == ["long"] * 3
    # the same two values of both in any order are no conflict
    assert [(r.left.id, r.right.id, r.logical_key) for r in M.conflict_keys(told, providers).collect()] == [("ledger", "rollup", "order:2")]


def test_ends_meet_by_short_keys(spark):
    """Ends meet by 16 bytes, and ids that went as bytes are spelt as those of the entities and the evidence."""
    o = corpora.customer_observations(spark, "/root/testdata/sf0.001")
    met = facts._print(facts._native(extract_entities(o.limit(20), False)))
    assert {(r.a, r.b) for r in met.select(F.length("fp").alias("a"), F.length("nk").alias("b")).collect()} == {(16, 16)}
    n = facts.normalize_facts(o)
    ends = n.facts.select(F.explode(F.array("subject", "object")).alias("r")).where("r is not null").select("r.*")
    named = ends.select(F.explode(F.concat(F.filter(F.array("canonical_id"), lambda x: x.isNotNull()), "candidate_ids")).alias("canonical_id"))
    assert named.count() > 0 and named.join(n.correlation.canonical, "canonical_id", "left_anti").count() == 0
    assert n.facts.count() > 0 and n.facts.join(n.evidence, "evidence_id", "left_anti").count() == 0
