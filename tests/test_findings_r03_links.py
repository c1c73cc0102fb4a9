"""Findings of round 3, third part: links without groups, groups of single edges, keys that are worked out once."""

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import candidates, components, correlate
from factloom.operators.entities import normalize_entities
from factloom.plans import catalog
from factloom.sources import corpora

SMALL = "/root/testdata/sf0.001"


def test_links_need_no_groups(spark, monkeypatch):
    """F24"""
    monkeypatch.setattr(correlate, "build_groups", lambda *_: (_ for _ in ()).throw(KeyError))
    assert catalog.links_by_score(spark, SMALL).count() > 0


def test_single_edges_are_groups_as_they_stand(spark, monkeypatch):
    """only edges that share an entity go through rounds of scores and steps of components."""
    asked = []
    real = components.best_edges
    monkeypatch.setattr(components, "best_edges", lambda edges: asked.append(edges.count()) or real(edges))
    entities = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(8)], "eid long, provider string")
    edges = spark.createDataFrame([(0, 1, 48), (3, 4, 100), (4, 5, 100), (3, 5, 90)], "left long, right long, score int")
    got = {r.eid: (r.members, r.strength) for r in components.build_groups(entities, edges).collect()}
    assert asked == [3]
    assert got == {0: ([0, 1], "probable"), 1: ([0, 1], "probable"), 2: ([2], "probable"), **{i: ([3, 4, 5], "matched") for i in (3, 4, 5)}, 6: ([6], "probable"), 7: ([7], "probable")}


def test_keys_are_shuffled_once(spark):
    """keys are counted and joined where they have met, and only those of different providers."""
    e = normalize_entities(corpora.part_entities(spark, SMALL)).withColumns({"eid": F.xxhash64("eid"), "provider": F.col("provider.id")})
    pairs = candidates.candidate_pairs(candidates.candidate_keys(e, True)).pairs
    who = lambda end: e.select(F.col("eid").alias(end), F.col("provider").alias(f"{end}_provider"))
    assert pairs.count() > 0 and pairs.join(who("left"), "left").join(who("right"), "right").where("left_provider >= right_provider").count() == 0
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("ReusedExchange") == 1 and final.count("Generate explode(array_distinct") == 1


def test_shortcuts_of_scalars(spark):
    """What needs no work is passed by, and gives what the long way gives."""
    paths = ["a/b", "a//b", "/a", "a/", ".", "..", "a/../b", "a/..b/c.", "...", "./a", "a\\b", " a/b ", "", "﻿", ".a/.b", "a/./b", None]
    want = ["a/b", "a/b", "a", "a", ".", ".", "b", "a/..b/c.", "...", "a", "a/b", "a/b", ".", ".", ".a/.b", "a/b", None]
    rows = spark.createDataFrame(list(enumerate(paths)), "i int, x string")
    assert [r.v for r in rows.select("i", S.normalize_path(F.col("x")).alias("v")).orderBy("i").collect()] == want
    spans = ["L1C2-L3C4", "l7", "L5-9", "L3C1-L2C1", "1:2-3:4", " 1:2-1:1", "L1C1\u0085", "x", "", None]
    want = [(1, 2, 3, 4), (7, None, 7, None), (5, None, 9, None), None, (1, 2, 3, 4), None, (1, 1, 1, None), None, None, None]
    rows = spark.createDataFrame(list(enumerate(spans)), "i int, x string")
    got = [r.v for r in rows.select("i", S.parse_span(F.col("x"), F.lit("other")).alias("v")).orderBy("i").collect()]
    assert [tuple(v) if v else None for v in got] == want
