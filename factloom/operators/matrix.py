"""Views that compare providers over DESCRIPTOR rows: states, coverage, overlap, conflicts and information gain.

Every view is grouped or joined on keys; registries of providers and fact classes are small by nature and come as
DataFrames of (provider, ord) and (fact_class).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio

ALL = "__all__"


def provider_registry(*parts: DataFrame) -> DataFrame:
    """(provider, ord): all providers of some tables by id, version and determinism."""
    from pyspark.sql import Window as W

    every = parts[0].select("provider")
    for p in parts[1:]:
        every = every.union(p.select("provider"))
    return every.distinct().withColumn("ord", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("provider")))


def fact_classes(facts: DataFrame, unsupported: DataFrame) -> DataFrame:
    return facts.select("fact_class").union(unsupported.select("fact_class")).distinct()


def fact_rows(facts: DataFrame, unsupported: DataFrame) -> DataFrame:
    """One row per logical fact: key, repository, fact_class, state, comparison_possible, correlation_status, n_variants, providers."""
    shape = lambda df, state, possible, status, n: df.select("key", "repository", "fact_class", state.alias("state"), F.lit(possible).alias("comparison_possible"), status.alias("correlation_status"), n.alias("n_variants"), "providers")
    c = facts.where("logical_key is not null").groupBy(F.col("logical_key").alias("key")).agg(
        F.first("repository").alias("repository"), F.first("fact_class").alias("fact_class"), F.count_distinct("exact_key").alias("n"), F.collect_set("provider").alias("providers"), F.bool_or(F.col("status") == "probable").alias("probable"))
    state = F.when(F.col("n") > 1, "conflict").when(F.size("providers") > 1, "overlap").otherwise("provider-only")
    comparable = shape(c, state, True, F.when(F.col("probable"), "probable").otherwise("matched"), F.col("n"))
    u = facts.where("logical_key is null").withColumns({"key": F.concat_ws(":", F.lit("unresolved"), F.to_json("provider"), "fact_id"), "providers": F.array("provider")})
    unresolved = shape(u, F.when(F.col("status") == "ambiguous", "ambiguous").otherwise("unmatched"), False, F.col("status"), F.lit(1).cast("long"))
    key = F.concat(F.lit("unsupported:"), F.coalesce("logical_key", F.concat_ws(":", F.to_json("provider"), "evidence_id")))
    s = unsupported.withColumn("key", key).groupBy("key").agg(
        F.first("repository").alias("repository"), F.min("fact_class").alias("fact_class"), F.count("*").alias("n"), F.collect_set("provider").alias("providers"), F.bool_or(F.col("logical_key").isNotNull()).alias("known"), F.min("status").alias("status"))
    return comparable.unionByName(unresolved).unionByName(shape(s, F.lit("unsupported"), False, F.when(F.col("known"), "not-applicable").otherwise(F.col("status")), F.col("n")))


def fact_variants(facts: DataFrame) -> DataFrame:
    """(logical_key, exact_key, providers, fact_ids, evidence_ids) of comparable facts."""
    ids = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}s")
    return facts.where("logical_key is not null").groupBy("logical_key", "exact_key").agg(ids("provider"), ids("fact_id"), ids("evidence_id"))


def provider_states(rows: DataFrame, providers: DataFrame) -> DataFrame:
    """(key, fact_class, provider, state) for every row and every provider; those that don't observe it are ``missing``."""
    stated = F.when(F.array_contains("providers", F.col("provider")), F.when(F.col("comparison_possible"), "present").otherwise(F.col("state"))).otherwise("missing")
    listed = providers.agg(F.collect_list("provider").alias("listed"))  # one row
    return rows.crossJoin(F.broadcast(listed)).select("*", F.explode("listed").alias("provider")).select("key", "fact_class", "provider", stated.alias("state"))


def unique_logical(facts: DataFrame) -> DataFrame:
    """(logical_key, fact_class, provider) of keys that exactly one provider has."""
    one = facts.where("logical_key is not null").groupBy("logical_key").agg(F.count_distinct("provider").alias("n"), F.first("provider").alias("provider"), F.first("fact_class").alias("fact_class"))
    return one.where("n = 1").select("logical_key", "fact_class", "provider")


def coverage(facts: DataFrame, unsupported: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per provider and fact class, and one per provider for ``__all__``; a dense grid with zeros."""
    grid = providers.select("provider").crossJoin(F.broadcast(fact_classes(facts, unsupported).union(facts.sparkSession.sql(f"SELECT '{ALL}'"))))
    both = facts.withColumn("ok", F.lit(True)).unionByName(unsupported.withColumn("ok", F.lit(False)))
    is_ = lambda s: F.count_if(F.col("ok") & (F.col("status") == s)).alias(s)
    counts = both.groupingSets([[F.col("provider"), F.col("fact_class")], [F.col("provider")]], "provider", "fact_class").agg(
        F.count("*").alias("raw"), F.count_if("ok").alias("normalized"), F.count_if(~F.col("ok")).alias("unsupported"), *[is_(s) for s in ("matched", "probable", "ambiguous", "unmatched")], F.grouping("fact_class").alias("g"))
    counts = counts.withColumn("fact_class", F.when(F.col("g") == 1, ALL).otherwise(F.col("fact_class"))).drop("g")
    # distinct logical keys are counted apart, each from rows already reduced to one per key
    keys = facts.where("logical_key is not null").groupBy("provider", "fact_class", "logical_key").agg(F.lit(1).alias("x"))
    known = keys.groupingSets([[F.col("provider"), F.col("fact_class")], [F.col("provider")]], "provider", "fact_class").agg(F.count_distinct("logical_key").alias("comparable"), F.grouping("fact_class").alias("g"))
    alone = unique_logical(facts).groupingSets([[F.col("provider"), F.col("fact_class")], [F.col("provider")]], "provider", "fact_class").agg(F.count("*").alias("unique"), F.grouping("fact_class").alias("g"))
    name = lambda df: df.withColumn("fact_class", F.when(F.col("g") == 1, ALL).otherwise(F.col("fact_class"))).drop("g")
    out = grid.join(counts, ["provider", "fact_class"], "left").join(name(known), ["provider", "fact_class"], "left").join(name(alone), ["provider", "fact_class"], "left")
    out = out.fillna(0, ["raw", "normalized", "unsupported", "matched", "probable", "ambiguous", "unmatched", "comparable", "unique"])
    return out.withColumns({"correlated": F.col("matched") + F.col("probable"), "correlated_coverage": ratio(F.col("matched") + F.col("probable"), F.col("normalized")), "normalization_coverage": ratio(F.col("normalized"), F.col("raw")), "unique_coverage": ratio(F.col("unique"), F.col("comparable")), "matched_coverage": ratio(F.col("matched"), F.col("normalized"))})


def comparable_sets(facts: DataFrame) -> DataFrame:
    """Distinct (provider, fact_class, logical_key, exact_key): what overlap and gain are counted on."""
    return facts.where("logical_key is not null").select("provider", "fact_class", "logical_key", "exact_key").distinct()


def _ordered_sets(facts: DataFrame, providers: DataFrame) -> DataFrame:
    """Distinct (ord, fact_class, logical_key, exact_key); a provider is a number before rows are held and shuffled."""
    told = facts.where("logical_key is not null").join(F.broadcast(providers.select("provider", "ord")), "provider")
    return told.select("ord", "fact_class", "logical_key", "exact_key").distinct()


def _pairs(who: Column, ord_: Callable[[Column], Column]) -> Column:
    """Every pair (a, b) of a list of providers in the order of the registry; a list is as long as the registry at most."""
    both = F.flatten(F.transform(who, lambda a: F.transform(who, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.explode(F.filter(both, lambda p: ord_(p.a) < ord_(p.b)))


def _shared_pairs(base: DataFrame) -> DataFrame:
    """(l, r, fact_class, exact_key) for every pair of providers that has an exact key."""
    exact = base.groupBy("fact_class", "exact_key").agg(F.collect_set("ord").alias("who")).where(F.size("who") > 1)
    return exact.select("fact_class", "exact_key", _pairs(F.col("who"), lambda x: x).alias("p")).select(F.col("p.a").alias("l"), F.col("p.b").alias("r"), "fact_class", "exact_key")


def _held_keys(base: DataFrame) -> DataFrame:
    """Logical keys with their providers; a provider's values, which are distinct, are told by their number and two xors of digests."""
    own = base.groupBy("fact_class", "logical_key", "ord").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("exact_key")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "exact_key")).alias("g"))
    return own.groupBy("fact_class", "logical_key").agg(F.collect_list(F.struct("ord", "n", "h", "g")).alias("who"))


def _met_pairs(logical: DataFrame) -> DataFrame:
    """(l, r, fact_class, logical_key, same) for every pair of providers that has a logical key."""
    met = logical.where(F.size("who") > 1).select("fact_class", "logical_key", _pairs(F.col("who"), lambda x: x.ord).alias("p"))
    same = (F.col("p.a.n") == F.col("p.b.n")) & (F.col("p.a.h") == F.col("p.b.h")) & (F.col("p.a.g") == F.col("p.b.g"))
    return met.select(F.col("p.a.ord").alias("l"), F.col("p.b.ord").alias("r"), "fact_class", "logical_key", same.alias("same"))


def _named_pairs(pairs: DataFrame, providers: DataFrame) -> DataFrame:
    p = providers.select("provider", "ord")
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    return pairs.join(F.broadcast(p.toDF("left", "l")), "l").join(F.broadcast(p.toDF("right", "r")), "r").select("left", "right", *rest)


def overlap_keys(facts: DataFrame, providers: DataFrame) -> DataFrame:
    """(left, right, fact_class, exact_key): what :func:`pairwise_overlap` counts as overlap, one row per key."""
    return _named_pairs(_shared_pairs(_ordered_sets(facts, providers)), providers)


def conflict_keys(facts: DataFrame, providers: DataFrame) -> DataFrame:
    """(left, right, fact_class, logical_key): what :func:`pairwise_overlap` counts as conflicts, one row per key."""
    met = _met_pairs(_held_keys(_ordered_sets(facts, providers)))
    return _named_pairs(met.where(~F.col("same")).drop("same"), providers)


def all_provider_keys(facts: DataFrame, providers: DataFrame) -> DataFrame:
    """(fact_class, exact_key): what :func:`all_provider_overlap` counts, one row per key."""
    total = providers.agg(F.count("*").alias("providers"))
    held = _ordered_sets(facts, providers).groupBy("fact_class", "exact_key").agg(F.count_distinct("ord").alias("n"))
    return held.crossJoin(F.broadcast(total)).where("n = providers").select("fact_class", "exact_key")


def gain_ids(facts: DataFrame, unsupported: DataFrame, order: DataFrame) -> DataFrame:
    """(provider, kind, fact_class, id): all that :func:`information_gain` counts, one row per id.

    ``new``: exact keys no provider before it has; ``unique``: logical keys of it alone; ``ambiguous`` and ``unmatched``: fact ids
    without a usable identity; ``unsupported``: evidence ids. Rows that repeat an id are listed as often as they are counted.
    """
    shape = lambda df, kind, id_: df.select("provider", kind.alias("kind"), "fact_class", F.col(id_).alias("id"))
    known = lambda df: df.join(F.broadcast(order.select("provider")), "provider", "left_semi")
    open_ = known(facts).where(F.col("status").isin("ambiguous", "unmatched"))
    parts = [shape(open_, F.col("status"), "fact_id"), shape(known(unsupported), F.lit("unsupported"), "evidence_id"), shape(known(unique_logical(facts)), F.lit("unique"), "logical_key")]
    out = shape(new_keys(facts, order), F.lit("new"), "exact_key")
    for p in parts:
        out = out.unionByName(p)
    return out


def pairwise_overlap(facts: DataFrame, providers: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per pair of providers and fact class, in the order of the registry.

    Keys are grouped once and pairs are made of the providers that have a key, so nothing is joined with itself.
    """
    base = _ordered_sets(facts, providers)
    logical = _held_keys(base)
    shared = _shared_pairs(base).groupBy("l", "r", "fact_class").agg(F.count("*").alias("overlap"))
    met = _met_pairs(logical).groupBy("l", "r", "fact_class").agg(F.count("*").alias("compared"), F.count_if(~F.col("same")).alias("conflicts"))
    own = logical.select("fact_class", F.explode("who").alias("w")).groupBy("w.ord", "fact_class").agg(F.sum("w.n").alias("n"), F.count("*").alias("k"))
    p = providers.select("provider", "ord")
    grid = p.toDF("left", "l").join(p.toDF("right", "r"), F.col("l") < F.col("r")).crossJoin(F.broadcast(classes.select("fact_class")))
    for name in ("l", "r"):
        grid = grid.join(own.toDF(name, "fact_class", f"{name}_n", f"{name}_k"), [name, "fact_class"], "left")
    grid = grid.join(shared, ["l", "r", "fact_class"], "left").join(met, ["l", "r", "fact_class"], "left").fillna(0)
    return grid.select("left", "right", "fact_class", F.col("l_n").alias("left_count"), F.col("r_n").alias("right_count"), "compared", "overlap", (F.col("l_k") - F.col("compared")).alias("left_only"), (F.col("r_k") - F.col("compared")).alias("right_only"), "conflicts", ratio(F.col("overlap"), F.least("l_n", "r_n")).alias("overlap_coverage"))


def only_keys(facts: DataFrame, one: str, other: str) -> DataFrame:
    """Logical keys of the provider with id ``one`` that the provider with id ``other`` doesn't have."""
    keys = lambda id_: facts.where((F.col("provider.id") == id_) & F.col("logical_key").isNotNull()).select("fact_class", "logical_key").distinct()
    return keys(one).join(keys(other), ["fact_class", "logical_key"], "left_anti")


def all_provider_overlap(facts: DataFrame, providers: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per fact class: how many exact keys there are, and how many every provider of the registry has."""
    total = providers.agg(F.count("*").alias("providers"))
    each = comparable_sets(facts).groupBy("fact_class", "exact_key").agg(F.count_distinct("provider").alias("n"))
    counted = each.crossJoin(F.broadcast(total)).groupBy("fact_class").agg(F.count("*").alias("union_count"), F.count_if(F.col("n") == F.col("providers")).alias("overlap"))
    out = classes.select("fact_class").crossJoin(F.broadcast(total)).join(counted, "fact_class", "left").fillna(0)
    return out.withColumn("overlap_coverage", ratio(F.col("overlap"), F.col("union_count")))


def information_gain(facts: DataFrame, unsupported: DataFrame, order: DataFrame) -> DataFrame:
    """One row per provider in the order (provider, ord): new exact keys over all providers before it, and its totals.

    A key is new for the provider of the smallest order that has it, so no step depends on the one before.
    """
    base = comparable_sets(facts).join(F.broadcast(order), "provider").select("ord", "exact_key").distinct()
    first = base.groupBy("exact_key").agg(F.min("ord").alias("ord")).groupBy("ord").agg(F.count("*").alias("new_facts"))
    own = base.groupBy("ord").agg(F.count("*").alias("own_facts"))
    open_ = facts.groupBy("provider").agg(F.count_if(F.col("status") == "ambiguous").alias("ambiguous"), F.count_if(F.col("status") == "unmatched").alias("unmatched"))
    left = unsupported.groupBy("provider").agg(F.count("*").alias("unsupported"))
    alone = unique_logical(facts).groupBy("provider").agg(F.count("*").alias("unique"))
    out = order.select("provider", "ord").join(first, "ord", "left").join(own, "ord", "left").join(open_, "provider", "left").join(left, "provider", "left").join(alone, "provider", "left").fillna(0)
    return out.withColumn("gain_coverage", ratio(F.col("new_facts"), F.col("own_facts")))


def gain_by_class(facts: DataFrame, order: DataFrame) -> DataFrame:
    """(provider, fact_class, new_facts) where there is anything new."""
    return new_keys(facts, order).groupBy("provider", "fact_class").agg(F.count("*").alias("new_facts"))


def addition_order(providers: DataFrame, ids: list[str]) -> DataFrame:
    """(provider, ord): the requested ids that are known, each once, then all others by registry order."""
    wanted = list(dict.fromkeys(ids))
    from pyspark.sql import Window as W

    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in wanted]).cast("array<string>"), F.col("provider.id")), F.lit(0)), F.lit(len(wanted) + 1))
    return providers.withColumn("ord", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(rank, "ord")))


def compare_fact_sets(facts: DataFrame, unsupported: DataFrame, expected: list[tuple[str, str, str]] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(group key, fact class, state, variants, n_providers) of every comparison group: repository, subject and predicate.

    equivalent, provider-only, conflict, unsupported or absent; ``expected``: identities (id, version, determinism) of the
    providers that should agree; ``groups`` (key, fact_class): groups that should be there, ``absent`` where nobody says anything.
    A group whose subject isn't resolved is a group all the same, so its values can conflict.
    """
    both = facts.withColumn("ok", F.lit(True)).unionByName(unsupported.withColumn("ok", F.lit(False)))
    identity = lambda x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("id", "version", "determinism"), x)])
    want = F.array(*[identity(x) for x in expected or []]).cast("array<struct<id:string,version:string,determinism:string>>")
    g = both.groupBy(F.col("group_key").alias("key"), "fact_class").agg(
        F.count_distinct(F.when(F.col("ok"), F.col("exact_key"))).alias("variants"), F.collect_set(F.when(F.col("ok"), F.col("provider"))).alias("seen"),
        F.bool_or(~F.col("ok") & F.array_contains(want, F.col("provider"))).alias("missed"), F.count_distinct("provider").alias("n_providers"))
    covers = F.size(F.array_except(want, "seen")) == 0 if expected else F.size("seen") > 1
    state = F.when(F.col("variants") == 0, "unsupported").when(F.col("variants") > 1, "conflict").when(covers & ~F.col("missed"), "equivalent").otherwise("provider-only")
    out = g.select("key", "fact_class", state.alias("state"), "variants", "n_providers")
    if groups is None:
        return out
    zero = F.lit(0).cast("long")
    silent = groups.select("key", "fact_class").distinct().join(out.select("key", "fact_class"), ["key", "fact_class"], "left_anti")
    return out.unionByName(silent.select("key", "fact_class", F.lit("absent").alias("state"), zero.alias("variants"), zero.alias("n_providers")))


#: The same under the name that callers of normalized facts know.
compare_normalized_facts = compare_fact_sets


def entity_coverage(metrics: DataFrame, providers: DataFrame) -> DataFrame:
    """One row per provider of the registry: its entities by correlation status, and their shares; zeros where it has none."""
    out = providers.select("provider").join(metrics, "provider", "left").fillna(0).withColumn("correlated", F.col("matched") + F.col("probable"))
    return out.select("provider", "total", "matched", "probable", "correlated", "ambiguous", "unmatched", ratio(F.col("matched"), F.col("total")).alias("matched_coverage"), ratio(F.col("correlated"), F.col("total")).alias("correlated_coverage"))


def new_keys(facts: DataFrame, order: DataFrame) -> DataFrame:
    """(provider, fact_class, exact_key): the exact keys that a provider adds to those before it in the order."""
    base = comparable_sets(facts).join(F.broadcast(order.select("provider", "ord")), "provider").select("provider", "ord", "fact_class", "exact_key").distinct()
    first = base.groupBy("exact_key").agg(F.min("ord").alias("first"))
    return base.join(first, "exact_key").where("ord = first").select("provider", "fact_class", "exact_key")


def existing_providers(order: DataFrame) -> DataFrame:
    """(provider, existing): the providers before each one in the order; a registry is small."""
    listed = order.agg(F.sort_array(F.collect_list(F.struct("ord", "provider"))).alias("listed"))
    return order.crossJoin(F.broadcast(listed)).select("provider", "ord", F.transform(F.filter("listed", lambda x: x.ord < F.col("ord")), lambda x: x.provider).alias("existing"))


def artifact_counts(views: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of every view."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in sorted(views.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
