"""Candidate pairs by blocking keys, and their scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import RULES

#: A key whose entities make more pairs than this is skipped: this many links say nothing, and a hot key would be all pairs.
PAIRS_PER_KEY = 100_000


def candidate_keys(entities: DataFrame, numbered: bool = False) -> DataFrame:
    """(repository, class, key, eid), one row per blocking key of an entity; keys are distinct for an entity.

    Where entities are ``numbered`` their provider goes with them.
    """
    c, none = F.col, F.array().cast("array<struct<class:string,key:string>>")
    one = lambda name, ok, *key: F.when(ok, F.array(F.struct(F.lit(name).alias("class"), F.to_json(F.array(*key)).alias("key")))).otherwise(none)
    each = lambda name, keys, *pre: F.transform(keys, lambda k: F.struct(F.lit(name).alias("class"), F.to_json(F.array(*pre, k)).alias("key")))
    path, bare = c("path").isNotNull(), c("name").isNull() & c("qualifiedName").isNull() & (F.size("aliases") == 0)
    keys = F.concat(
        one("path-range", path & c("range").isNotNull(), c("path"), F.to_json("range", {"ignoreNullFields": "false"})), one("path-signature", path & c("s_key").isNotNull(), c("path"), c("s_key")),
        one("signature", c("s_key").isNotNull(), c("s_key")), one("qualified-exact", c("qualifiedName").isNotNull(), c("qualifiedName")),
        one("alias-match-exact", c("qualifiedName").isNotNull(), c("qualifiedName")), each("qualified-normalized", c("q_keys")), each("alias-match-exact", c("aliases")), each("alias-normalized", c("a_keys")),
        F.when(path, each("path-name-normalized", c("n_keys"), c("path"))).otherwise(none), one("path-name-exact", path & c("name").isNotNull(), c("path"), c("name")), one("path-kind", path & bare, c("path"), c("family")))
    who = ["provider"] if numbered else []
    return entities.select("repository", "eid", *who, F.explode(F.array_distinct(keys)).alias("k")).select("repository", "k.class", "k.key", "eid", *who)


@dataclass
class Candidates:
    pairs: DataFrame  # left, right
    diagnostics: DataFrame  # class, keys, skipped keys, pairs in the largest skipped key, complete


def candidate_pairs(keys: DataFrame, pairs_per_key: int | None = PAIRS_PER_KEY, pairs_total: int | None = None) -> Candidates:
    """Distinct pairs (left < right) of entities that share a key in one repository, and what was skipped.

    Sizes are counted before the join, so no skipped key is ever expanded; without ``pairs_per_key`` none is skipped. Keys meet
    by a digest of 16 bytes, shuffled once for counting and joining. Keys with a provider give pairs of different providers alone,
    from the smaller provider to the larger. ``pairs_total`` reproduces a global limit: pairs
    rank by their first key (smallest entity, then key), then by themselves; it is off by default and then nothing is lost.
    """
    n = F.col("n")
    who = ["provider"] if "provider" in keys.columns else []
    keys = keys.select(F.unhex(F.md5(F.to_json(F.struct("repository", "class", "key")))).alias("k"), "class", "key", "eid", *who)
    buckets = keys.groupBy("k", "class").agg(F.count("*").alias("n"), F.min("eid").alias("first"))
    over = n * (n - 1) / 2 > pairs_per_key if pairs_per_key is not None else F.lit(False)
    if pairs_total is None:
        used = keys.select("k", "eid", *who).withColumn("n", F.count("*").over(W.partitionBy("k"))).where((n > 1) & ~over)
        ends = lambda end: used.select("k", F.col("eid").alias(end), *[F.col(p).alias(f"{end}_{p}") for p in who])
        apart = "left_provider < right_provider" if who else "left < right"
        pairs, cut = ends("left").join(ends("right"), "k").where(apart).select("left", "right").distinct(), F.lit(True)
    else:
        used = keys.select("k", "eid", "class", "key").join(buckets.where((n > 1) & ~over).select("k", "first"), "k")
        met = used.withColumnRenamed("eid", "left").join(used.select("k", F.col("eid").alias("right")), "k").where("left < right")
        ranked = met.groupBy("left", "right").agg(F.min(F.struct("first", "class", "key")).alias("rank"))
        pairs = first_pairs(ranked, pairs_total)
        cut = F.lit(False)
    diagnostics = buckets.groupBy("class").agg(
        F.count("*").alias("keys"), F.count_if(over).alias("skipped_keys"), F.coalesce(F.max(F.when(over, (n * (n - 1) / 2).cast("long"))), F.lit(0)).alias("largest_skipped_pairs"))
    return Candidates(pairs, diagnostics.withColumn("complete", (F.col("skipped_keys") == 0) & cut))


def first_pairs(ranked: DataFrame, most: int) -> DataFrame:
    """The first ``most`` pairs (left, right) in the order of rank, left and right.

    A rank begins with a digest. The pairs for each of its first four digits are counted, 65,536 numbers at most; where the limit
    falls among them, those for the next four; and only what shares these eight digits with the pair at the limit, pairs of one
    entity as a rule, is numbered.
    """
    some = ranked.withColumn("room", F.lit(most).cast("long"))
    kept, by = [], []
    for level in range(2):
        by = [*by, f"d{level}"]
        some = some.withColumn(f"d{level}", F.substring("rank.first", 4 * level + 1, 4))
        sizes = some.groupBy(*by).agg(F.count("*").alias("n"))
        # the counts of one level are few, and of the second there are those of one bucket alone
        before = W.partitionBy(F.lit(0)).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        met = some.join(F.broadcast(sizes), by).where("before < room")
        kept.append(met.where("before + n <= room").select("left", "right"))
        some = met.where("before + n > room").withColumn("room", F.col("room") - F.col("before")).drop("n", "before")
    nth = F.row_number().over(W.partitionBy(*by).orderBy("rank", "left", "right"))
    last = some.withColumn("nth", nth).where("nth <= room").select("left", "right")
    return kept[0].unionByName(kept[1]).unionByName(last)


def score(l: Column, r: Column) -> tuple[Column, Column]:  # noqa: E741
    """(score, rules) of two entities; the score is null where there is no link."""
    path, rng = F.coalesce(l.path == r.path, F.lit(False)), S.same_range(l.range, r.range)
    kind, name = l.family == r.family, S.intersects(l.n_keys, r.n_keys)
    qualified = S.intersects(l.q_keys, r.q_keys)
    alias = S.intersects(l.a_keys, r.a_keys) | S.intersects(l.a_keys, r.q_keys) | S.intersects(l.q_keys, r.a_keys)
    signature = F.coalesce(l.s_key == r.s_key, F.lit(False))
    held = (F.lit(True), path, rng, kind, qualified, alias, name, signature)
    rules = F.filter(F.array(*[F.when(ok, rule) for ok, rule in zip(held, RULES)]), lambda x: x.isNotNull())
    nameless = (F.size(l.n_keys) == 0) & (F.size(r.n_keys) == 0)
    # The scores, by the rules that hold.
    value = F.when(path & rng, 100).when(qualified | alias, 86 + F.when(path, 4).otherwise(0) + F.when(signature, 3).otherwise(0)).when(path & signature, 82)
    value = value.when(path & name, 68).when(signature, 58).when(path & kind & nameless, 45).when(name, 48)
    return value, rules


def scored_edges(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left, right, left_provider, right_provider, score, strength, rules) of the pairs that may link.

    Where entities have a ``digest`` beside a number as ``eid``, ``turned`` says whether the right end has the smaller one.
    """
    by = ["digest"] if "digest" in entities.columns else []
    body = F.struct("provider", "repository", "family", "path", "range", "q_keys", "a_keys", "n_keys", "s_key", *by)
    l, r = entities.select(F.col("eid").alias("left"), body.alias("l")), entities.select(F.col("eid").alias("right"), body.alias("r"))  # noqa: E741
    met = pairs.join(l, "left").join(r, "right").where((F.col("l.provider") != F.col("r.provider")) & (F.col("l.repository") == F.col("r.repository")) & S.kinds_agree(F.col("l.family"), F.col("r.family")))
    value, rules = score(F.col("l"), F.col("r"))
    turned = [(F.col("l.digest") > F.col("r.digest")).alias("turned")] if by else []
    ends = ["left", "right", F.col("l.provider").alias("left_provider"), F.col("r.provider").alias("right_provider"), *turned]
    return met.select(*ends, value.alias("score"), rules.alias("rules")).where("score is not null").withColumn("strength", F.when(F.col("score") >= 80, "matched").otherwise("probable"))
