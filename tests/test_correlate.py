import random

from factloom.operators.candidates import candidate_keys, candidate_pairs
from factloom.operators.components import best_edges, bounded_components
from factloom.operators.correlate import correlate
from factloom.operators.entities import normalize_entities
from factloom.schemas import ENTITY_INPUT

REPO = ("r", "a" * 40)
VERSIONS = {"parser": "2.1.0", "scip": "0.3.3", "wiring": "5.0.1"}


def entity(provider, id, kind, path="src/x.ts", span=None, name=None, qualified=None, signature=None, aliases=None, commit="a" * 40):
    return ((provider, VERSIONS[provider], "deterministic"), ("r", commit), id, kind, path, span, None, None, name, qualified, signature, aliases or [], None)


def outcome(spark, rows, **options):
    c = correlate(spark.createDataFrame(rows, ENTITY_INPUT).repartition(3), **options)
    groups = sorted((r.status, r.n_members, tuple(r.rules), r.cardinality) for r in c.canonical.collect())
    return c, groups


THREE = [entity("parser", "t1", "FunctionDeclaration", span="L10C1-L10C4"), entity("scip", "s1", "symbol", span="9:0-9:3"), entity("wiring", "g1", "function", span="L10C1-L10C4")]


def test_three_way_match_in_any_order(spark):
    c, groups = outcome(spark, THREE)
    assert [g[:2] for g in groups] == [("matched", 3)] and "same-range" in groups[0][2]
    assert {r.cardinality for r in c.links.collect()} == {"one-to-one"}
    again = correlate(spark.createDataFrame(THREE[::-1], ENTITY_INPUT))
    assert {r.canonical_id for r in c.canonical.collect()} == {r.canonical_id for r in again.canonical.collect()}


def test_revisions_never_mix(spark):
    rows = [THREE[0], entity("wiring", "g1", "function", span="L10C1-L10C4", commit="b" * 40)]
    assert [g[0] for g in outcome(spark, rows)[1]] == ["unmatched", "unmatched"]


def test_alias(spark):
    rows = [entity("parser", "t", "InterfaceDeclaration", span="L1C1-L1C2", name="Point", qualified="Point", aliases=["PointLike"]), entity("scip", "s", "symbol", span="5:0-5:3", name="PointLike", qualified="PointLike")]
    _, groups = outcome(spark, rows)
    assert groups[0][:2] == ("matched", 2) and "same-alias" in groups[0][2] and "same-range" not in groups[0][2]


def test_weak_evidence_is_probable(spark):
    rows = [entity("parser", "t", "function", span="L1C1-L1C2", name="helper"), entity("wiring", "g", "function", span="L5C1-L5C2", name="helper")]
    c, groups = outcome(spark, rows)
    assert groups[0][:2] == ("probable", 2) and c.links.first().score == 68


def test_overloads_stay_apart(spark):
    rows = [entity(p, f"{p}{i}", "function", span=f"L{i}C1-L{i}C9", name="f", qualified="m.f", signature=f"(x:{i})") for p in ("parser", "wiring") for i in (1, 2)]
    assert [g[:2] for g in outcome(spark, rows)[1]] == [("matched", 2), ("matched", 2)]


def test_one_to_many_is_ambiguous(spark):
    rows = [entity("parser", "t", "function", span="L1C1-L1C9"), entity("scip", "s1", "symbol", span="0:0-0:8"), entity("scip", "s2", "symbol", span="0:0-0:8"), entity("wiring", "g", "class", path="src/other.ts")]
    c, groups = outcome(spark, rows)
    assert [g[0] for g in groups] == ["ambiguous"] * 3 + ["unmatched"]
    metrics = {r.provider.id: r for r in c.metrics.collect()}
    assert metrics["scip"].ambiguous == 2 and metrics["wiring"].unmatched == 1 and metrics["parser"].candidates == 2


def test_large_keys_are_skipped_and_reported(spark):
    rows = [entity(p, f"{p}{i}", "function", name="same", qualified="same") for p in ("parser", "wiring") for i in range(225)]
    e = normalize_entities(spark.createDataFrame(rows, ENTITY_INPUT))
    c = candidate_pairs(candidate_keys(e))
    assert c.pairs.count() == 0
    assert all(r.largest_skipped_pairs > 100_000 and not r.complete for r in c.diagnostics.where("skipped_keys > 0").collect())
    assert candidate_pairs(candidate_keys(e), pairs_per_key=200_000, pairs_total=50).pairs.count() == 50


def test_duplicates_are_one_entity(spark):
    assert normalize_entities(spark.createDataFrame(THREE + THREE, ENTITY_INPUT)).count() == 3


def test_components_beyond_the_bound(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("a", "b"), ("b", "c"), ("hub", "x0")] + [("hub", f"x{i}") for i in range(1, 8)]
    got = {r.node: r.members for r in bounded_components(spark.createDataFrame(chain, "left string, right string"), 3).collect()}
    assert got["a"] == got["c"] == ["a", "b", "c"]
    assert all(got[f"n{i}"] is None for i in range(7)) and got["hub"] is None and got["x3"] is None


def taken_in_turn(edges):
    """Edges that count, score after score."""
    done, kept = set(), set()
    for s in sorted({e[2] for e in edges}, reverse=True):
        tier = [e for e in edges if e[2] == s and not {e[0], e[1]} & done]
        kept.update(tier)
        done |= {n for e in tier for n in e[:2]}
    return kept


def test_edges_that_count_are_those_taken_score_after_score(spark):
    draw = random.Random(5)
    for nodes, n, scores in ((12, 20, (45, 48, 58, 68)), (40, 60, range(90, 100)), (300, 500, (100, 82, 45))):
        pairs = {tuple(sorted(draw.sample(range(nodes), 2))) for _ in range(n)}
        edges = [(f"n{a}", f"n{b}", draw.choice(list(scores))) for a, b in pairs]
        got = best_edges(spark.createDataFrame(edges, "left string, right string, score int"))
        assert {tuple(r) for r in got.collect()} == taken_in_turn(edges)
    # scores that fall along a path need a round for every second edge
    path = [(f"p{i}", f"p{i + 1}", 100 - i) for i in range(9)]
    assert {tuple(r) for r in best_edges(spark.createDataFrame(path, "left string, right string, score int")).collect()} == set(path[::2])
    # a node taken at a score still counts for another that comes to this score later
    late = [("a", "b", 50), ("b", "c", 50), ("c", "d", 60), ("d", "e", 70)]
    assert {tuple(r) for r in best_edges(spark.createDataFrame(late, "left string, right string, score int")).collect()} == {late[0], late[1], late[3]}


def test_empty(spark):
    c, groups = outcome(spark, [THREE[0]])
    assert groups == [("unmatched", 1, (), "unmatched")]
    assert correlate(spark.createDataFrame([], ENTITY_INPUT)).canonical.count() == 0
