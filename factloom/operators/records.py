"""Full records of logical facts: nested variants with their ends, what every provider of the registry says, and whole id lists.

A record is assembled in two levels, variants of a fact and cells of a provider, each from one grouping. Lists inside
a record are bounded, since a hot fact may have any number of ids and variants: a record keeps the first ``limit`` of each
list in order and counts all, and the tables beside it hold every one. Claims are written once. Records of up to ``HOT``
claims are gathered from one shuffle by their key; for larger ones ids are counted and cut over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

#: Claims of a record that one task may gather.
HOT = 4096
#: Ids of a variant or cell, and variants of a record, that a record lists.
LIMIT = 32
_COMPARABLE, _UNRESOLVED, _UNSUPPORTED = "comparable", "unresolved", "unsupported"


@dataclass
class Records:
    """``records``: one row per logical fact. ``variants``: one per variant, whole. ``ids``: (key, variant, provider, kind, id), whole."""

    records: DataFrame
    variants: DataFrame
    ids: DataFrame


def claims(facts: DataFrame, unsupported: DataFrame) -> DataFrame:
    """Facts and unsupported evidence with the key of their record and of their variant, and the kind of the record."""
    who = F.to_json("provider")
    body = ["repository", "provider", F.col("predicate").alias("fact_class"), "status", "fact_id", "evidence_id", "subject", "object", "value"]
    known = F.col("logical_key").isNotNull()
    f = facts.select(
        F.when(known, F.col("logical_key")).otherwise(F.concat_ws(":", F.lit("unresolved"), who, "fact_id")).alias("key"), F.when(known, F.col("logical_key")).otherwise(F.concat(F.lit("unresolved:"), "exact_key")).alias("logical"),
        F.col("exact_key").alias("variant"), F.when(known, _COMPARABLE).otherwise(_UNRESOLVED).alias("kind"), known.alias("known"), *body)
    key = F.concat(F.lit("unsupported:"), F.coalesce("logical_key", F.concat_ws(":", who, "evidence_id")))
    u = unsupported.withColumn("fact_id", F.lit(None).cast("string")).select(
        key.alias("key"), key.alias("logical"), F.concat(F.lit("unsupported:"), "evidence_id").alias("variant"), F.lit(_UNSUPPORTED).alias("kind"), known.alias("known"), *body)
    return f.unionByName(u)


def first_of(rows: DataFrame, by: list[str], order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of every group; each task drops what can't be among them before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("nth") <= limit).drop("nth")


def _id_lists(ids: DataFrame, by: list[str], limit: int) -> DataFrame:
    """For every group n_facts, n_evidence, and the first ids of both."""
    each = ids.select(*by, "kind", "id").distinct()
    counts = each.groupBy(*by).agg(F.count_if(F.col("kind") == "fact").alias("n_facts"), F.count_if(F.col("kind") == "evidence").alias("n_evidence"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("id"))))
    lists = first_of(each, [*by, "kind"], "id", limit).groupBy(*by).agg(of("fact").alias("fact_ids"), of("evidence").alias("evidence_ids"))
    return counts.join(lists, by)


_FIRST = ("subject", "object", "value")


def _first() -> Column:
    return F.min_by(F.struct(*_FIRST), F.struct("provider", F.coalesce("fact_id", "evidence_id"))).alias("first")


def _own() -> list[Column]:
    """What a provider's claims tell of a record."""
    return [*[F.min(c).alias(a) for c, a in (("logical", "logical_key"), ("repository", "repository"), ("fact_class", "fact_class"), ("kind", "kind"))], F.bool_or("known").alias("known"), F.min("status").alias("status"), F.bool_or(F.col("status") == "probable").alias("probable")]


_VARIANT = ("key", "variant", "predicate", "providers", *[f"first.{c}" for c in _FIRST], "n_facts", "n_evidence", "fact_ids", "evidence_ids")
_IDS = ("key", "variant", "provider", "kind", "id")


def _nested(variants: DataFrame) -> Column:
    return F.array_sort(F.collect_list(F.struct(*[x for x in variants.columns if x != "key"])))


def _gathered(c: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(variants, cells, listed variants, ids) of records that are small; every grouping is within one shuffle by key."""
    c = c.repartition("key")
    n = lambda name: F.size(F.collect_set(f"{name}_id")).cast("long")
    some = lambda name: F.slice(F.array_sort(F.collect_set(f"{name}_id")), 1, limit)
    sets = [n("fact").alias("n_facts"), n("evidence").alias("n_evidence"), some("fact").alias("fact_ids"), some("evidence").alias("evidence_ids")]
    variants = c.groupBy("key", "variant").agg(F.min("fact_class").alias("predicate"), F.sort_array(F.collect_set("provider")).alias("providers"), _first(), *sets).select(*_VARIANT)
    counted = variants.withColumn("n_variants", F.count("*").over(W.partitionBy("key")))
    listed = first_of(counted, ["key"], "variant", limit).groupBy("key").agg(F.first("n_variants").alias("n_variants"), _nested(variants).alias("variants"))
    of = lambda kind: F.transform(F.collect_set(f"{kind}_id"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
    ids = c.groupBy("key", "variant", "provider").agg(F.concat(of("fact"), of("evidence")).alias("x")).select("key", "variant", "provider", F.explode("x").alias("x")).select("key", "variant", "provider", "x.*")
    return variants, c.groupBy("key", "provider").agg(*_own(), *sets), listed, ids.select(*_IDS)


def _spread_out(c: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same of records of any size."""
    pair = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).alias("id"))
    ids = c.select("key", "variant", "provider", F.explode(F.filter(F.array(pair("fact", "fact_id"), pair("evidence", "evidence_id")), lambda x: x.id.isNotNull())).alias("x")).select("key", "variant", "provider", "x.kind", "x.id").distinct()
    shown = c.groupBy("key", "variant").agg(F.min("fact_class").alias("predicate"), F.sort_array(F.collect_set("provider")).alias("providers"), _first())
    variants = shown.join(_id_lists(ids, ["key", "variant"], limit), ["key", "variant"]).select(*_VARIANT)
    cells = c.groupBy("key", "provider").agg(*_own()).join(_id_lists(ids, ["key", "provider"], limit), ["key", "provider"])
    listed = first_of(variants, ["key"], "variant", limit).groupBy("key").agg(_nested(variants).alias("variants"))
    listed = shown.groupBy("key").agg(F.count("*").alias("n_variants")).join(listed, "key")
    return variants, cells, listed, ids.select(*_IDS)


def matrix_records(facts: DataFrame, unsupported: DataFrame, providers: DataFrame, limit: int = LIMIT, hot: int = HOT) -> Records:
    """Records of all three kinds.

    ``facts`` and ``unsupported`` are rows of normalized facts; ``providers`` (provider, ord) is the registry. A record has key,
    logical_key, repository, fact_class, state, comparison_possible, correlation_status, n_variants, variants, provider_states
    (one per provider of the registry, ``missing`` where it says nothing), observed and missing. Unsupported evidence
    has a variant per evidence id. A variant's subject, object and value are those of its first provider and fact id. Empty
    tables give no rows; rows that repeat all columns count once in every list.
    """
    c = materialize(claims(facts, unsupported), "claims")
    large = materialize(c.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key"), "large")
    # there is a key in ``large`` for so many claims at most; where there is none, the second way reads nothing
    ways = (_gathered(c.join(F.broadcast(large), "key", "left_anti"), limit), _spread_out(c.join(F.broadcast(large), "key", "left_semi"), limit))
    cell = F.struct("provider", "n_facts", "n_evidence", "fact_ids", "evidence_ids")
    whole = lambda cells, listed: cells.groupBy("key").agg(
        F.min("logical_key").alias("logical_key"), F.min("repository").alias("repository"), F.min("fact_class").alias("fact_class"), F.min("kind").alias("kind"),
        F.bool_or("known").alias("known"), F.min("status").alias("status"), F.bool_or("probable").alias("probable"), F.sort_array(F.collect_list(cell)).alias("cells")).join(listed, "key")
    rows = whole(*ways[0][1:3]).unionByName(whole(*ways[1][1:3]))
    variants, ids = (ways[0][i].unionByName(ways[1][i]) for i in (0, 3))

    registry = providers.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "provider"))), lambda x: x.provider).alias("registry"))  # one row
    rows = rows.crossJoin(F.broadcast(registry))
    comparable, state = F.col("kind") == _COMPARABLE, _state()
    said = lambda p: F.get(F.filter("cells", lambda x: x.provider == p), F.lit(0))
    none = F.array().cast("array<string>")
    entry = lambda p, s: F.struct(
        p.alias("provider"), F.when(s.isNull(), "missing").when(comparable, "present").otherwise(state).alias("state"), F.coalesce(s.n_facts, F.lit(0)).alias("n_facts"), F.coalesce(s.n_evidence, F.lit(0)).alias("n_evidence"),
        F.coalesce(s.fact_ids, none).alias("fact_ids"), F.coalesce(s.evidence_ids, none).alias("evidence_ids"))
    observed = F.transform("cells", lambda x: x.provider)
    correlation = F.when(comparable, F.when(F.col("probable"), "probable").otherwise("matched")).when((F.col("kind") == _UNSUPPORTED) & F.col("known"), "not-applicable").otherwise(F.col("status"))
    records = rows.select(
        "key", "logical_key", "repository", "fact_class", state.alias("state"), comparable.alias("comparison_possible"), correlation.alias("correlation_status"), "n_variants", "variants",
        F.transform("registry", lambda p: entry(p, said(p))).alias("provider_states"), observed.alias("observed"), F.filter("registry", lambda p: ~F.array_contains(observed, p)).alias("missing"))
    return Records(records, variants, ids)


def _state() -> Column:
    n, many = F.col("n_variants"), F.size("cells") > 1
    comparable = F.when(n > 1, "conflict").when(many, "overlap").otherwise("provider-only")
    open_ = F.when(F.col("status") == "ambiguous", "ambiguous").otherwise("unmatched")
    return F.when(F.col("kind") == _COMPARABLE, comparable).when(F.col("kind") == _UNRESOLVED, open_).otherwise("unsupported")
