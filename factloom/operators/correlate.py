"""Entity correlation: canonical entities, links, and metrics of each provider."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import RULES
from ..storage import discard, large, materialize
from .candidates import PAIRS_PER_KEY, candidate_keys, candidate_pairs, scored_edges
from .components import build_groups
from .entities import extract_entities, normalize_entities


class Correlation:
    """Entities, their numbered edges, and what follows from them; each view is worked out when it is first asked for.

    ``edges``: left, right (numbers of ``entities``), turned, score, strength, rules, cardinality; ``turned`` says whether the
    right end has the smaller digest, and so is the left one of the link.
    """

    def __init__(self, entities: DataFrame, edges: DataFrame, diagnostics: DataFrame):
        self.entities, self.edges, self.diagnostics = entities, edges, diagnostics

    @cached_property
    def links(self) -> DataFrame:
        """left, right, score, strength, rules, cardinality"""
        named = lambda end: self.entities.select(F.col("no").alias(end), F.col("eid").alias(f"{end}_id"))
        end = lambda a, b, name: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(name)
        met = self.edges.join(named("left"), "left").join(named("right"), "right")
        return met.select(end("left_id", "right_id", "left"), end("right_id", "left_id", "right"), "score", "strength", "rules", "cardinality")

    @cached_property
    def groups(self) -> DataFrame:
        """eid (number), provider, repository, family, digest, g (the group: its first member), strength"""
        e = self.entities.select(F.col("no").alias("eid"), "provider", "repository", "family", F.unhex("eid").alias("digest"))
        return large(materialize(build_groups(e, self.edges).withColumn("g", F.get("members", F.lit(0))).drop("members"), "assigned"))

    @cached_property
    def _canonical(self) -> DataFrame:
        # every edge, seen from the group of each end
        group = lambda end: self.groups.select(F.col("eid").alias(end), F.col("g").alias(f"{end}_g"))
        met = self.edges.join(group("left"), "left").join(group("right"), "right")
        side = lambda own, other, first: F.struct(F.col(own).alias("g"), F.col(other).alias("other"), F.when(first, "left").otherwise("right").alias("side"))
        seen = met.select(F.explode(F.array(side("left_g", "right_g", ~F.col("turned")), side("right_g", "left_g", F.col("turned")))).alias("x"), "cardinality", "rules").select("x.*", "cardinality", "rules")
        inner = F.col("g") == F.col("other")
        wide = F.col("cardinality")
        facts = large(materialize(seen.groupBy("g").agg(
            F.collect_set(F.when(~inner, F.col("other"))).alias("others"), F.bool_or(wide == "many-to-many").alias("mm"),
            F.bool_or(wide.isin("one-to-many", "many-to-one") & (F.col("side") == "left")).alias("l"), F.bool_or(wide.isin("one-to-many", "many-to-one") & (F.col("side") == "right")).alias("r"),
            F.array_distinct(F.flatten(F.collect_set(F.when(inner, F.col("rules"))))).alias("inner_rules"), F.array_distinct(F.flatten(F.collect_set("rules"))).alias("all_rules"), F.lit(True).alias("linked")), "seen"))
        # an id is made of the digests of its members, of which there is one for each provider at most
        spelt = F.transform(F.array_sort(F.collect_list("digest")), lambda d: F.lower(F.hex(d)))
        shape = large(materialize(self.groups.groupBy("g").agg(
            F.concat(F.lit("ce_"), S.digest(spelt)).alias("canonical_id"), F.first("repository").alias("repository"), F.collect_set("family").alias("kinds"), F.count("*").alias("n_members"), F.first("strength").alias("strength")), "shapes"))
        none = F.array().cast("array<string>")
        candidates = facts.select("g", F.explode("others").alias("other")).join(shape.select(F.col("g").alias("other"), "canonical_id"), "other").groupBy("g").agg(F.sort_array(F.collect_list("canonical_id")).alias("candidate_ids"))
        some = F.coalesce("linked", F.lit(False))
        status = F.when(F.col("n_members") > 1, F.col("strength")).when(some, "ambiguous").otherwise("unmatched")
        cardinality = F.when(~some, "unmatched").when(F.col("mm") | (F.col("l") & F.col("r")), "many-to-many").when(F.col("l"), "one-to-many").when(F.col("r"), "many-to-one").otherwise("one-to-one")
        order = F.array(*[F.lit(x) for x in RULES])
        rules = F.when(F.size("inner_rules") > 0, F.col("inner_rules")).otherwise(F.coalesce("all_rules", none))
        c = shape.join(facts.drop("others"), "g", "left").join(candidates, "g", "left").select(
            "g", "canonical_id", "repository", S.canonical_kind(F.col("kinds")).alias("kind"), status.alias("status"), cardinality.alias("cardinality"), F.filter(order, lambda x: F.array_contains(rules, x)).alias("rules"), "n_members", F.coalesce("candidate_ids", none).alias("candidate_ids"))
        conflict = F.col("cardinality").isin("one-to-many", "many-to-one", "many-to-many")
        reason = F.when(F.col("status") == "unmatched", "no-cross-provider-evidence").when(F.col("status") == "ambiguous", F.when(conflict, "provider-cardinality-conflict").otherwise("competing-evidence"))
        c = large(materialize(c.withColumn("reason", reason.when(F.col("status") == "probable", "probable-evidence").otherwise("deterministic-evidence")), "canonical"))
        discard(facts, shape)
        return c

    @cached_property
    def canonical(self) -> DataFrame:
        """canonical_id, repository, kind, status, cardinality, rules, n_members, candidate_ids, reason"""
        return self._canonical.drop("g")

    @cached_property
    def members(self) -> DataFrame:
        """canonical_id, status, candidate_ids, eid and the entity's columns"""
        own = self.groups.select(F.col("eid").alias("no"), "g").join(self.entities.drop("p", "r"), "no")
        told = own.join(self._canonical.select("g", "canonical_id", "status", "candidate_ids"), "g")
        return told.select("canonical_id", "status", "candidate_ids", *[c for c in own.columns if c not in ("no", "g")])

    @cached_property
    def metrics(self) -> DataFrame:
        """provider, total, canonical, candidates and four statuses"""
        count = lambda s: F.count_if(F.col("status") == s).alias(s)
        incident = self.edges.select(F.explode(F.array("left", "right")).alias("eid")).groupBy("eid").agg(F.count("*").alias("n"))
        return self.groups.select("eid", "provider", "g").join(self._canonical.select("g", "status"), "g").join(incident, "eid", "left").groupBy("provider").agg(
            F.count("*").alias("total"), F.count_distinct("g").alias("canonical"), F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), *[count(s) for s in ("matched", "probable", "ambiguous", "unmatched")])


def edge_cardinality(edges: DataFrame) -> DataFrame:
    """Edges with the cardinality seen from both ends, by how many entities of the other provider each end links to.

    An edge goes from the smaller provider to the larger, so those of an entity to another provider have it at one end.
    """
    many = lambda end, other: F.count("*").over(W.partitionBy(end, other)) > 1
    edges = edges.withColumn("r", many("right", "left_provider")).withColumn("l", many("left", "right_provider"))
    l, r, turned = F.col("l"), F.col("r"), F.col("turned")  # noqa: E741
    kind = F.when(l & r, "many-to-many").when(l | r, F.when(l != turned, "one-to-many").otherwise("many-to-one")).otherwise("one-to-one")
    return edges.withColumn("cardinality", kind).drop("l", "r")


def correlate(entities: DataFrame, pairs_per_key: int | None = PAIRS_PER_KEY, pairs_total: int | None = None) -> Correlation:
    """Correlate ENTITY_INPUT rows by deterministic rules; the order of the input doesn't matter."""
    e = normalize_entities(entities).withColumns({"no": F.monotonically_increasing_id(), "p": S.short_digest(F.col("provider")), "r": S.short_digest(F.col("repository"))})
    e = large(materialize(e, "entities"))
    # entities go by number from here on, an eighth of a digest, and providers and repositories by a short one. Which end of an edge is
    # left follows the order of digests, which the first 8 bytes tell
    by_no = e.withColumns({"digest": F.substring(F.unhex("eid"), 1, 8), "eid": F.col("no"), "provider": F.col("p"), "repository": F.col("r")}).drop("no", "p", "r")
    if pairs_total is None:
        found = candidate_pairs(candidate_keys(by_no, True), pairs_per_key)
        pairs = found.pairs
    else:  # this limit goes by digests
        found = candidate_pairs(candidate_keys(e), pairs_per_key, pairs_total)
        number = lambda end: e.select(F.col("eid").alias(end), F.struct("p", "no").alias(f"{end}_no"))
        met = found.pairs.join(number("left"), "left").join(number("right"), "right")
        pairs = met.select(F.least("left_no", "right_no").alias("left"), F.greatest("left_no", "right_no").alias("right")).select("left.no", "right.no").toDF("left", "right")
    edges = edge_cardinality(scored_edges(by_no, pairs)).select("left", "right", "turned", "score", "strength", "rules", "cardinality")
    return Correlation(e, large(materialize(edges, "links")), found.diagnostics)


def correlate_observations(observations: DataFrame, **options) -> Correlation:
    return correlate(extract_entities(observations), **options)
