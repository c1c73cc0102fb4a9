"""Entities from observations: extraction, attributes, normal form, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def extract_entities(observations: DataFrame, prefer_definitions: bool = True) -> DataFrame:
    """Entity candidates (ENTITY_INPUT) of observations.

    ``defines`` gives its object entity, or else its subject; other predicates give their subject and object entity. With
    ``prefer_definitions`` a provider that has any definition gives entities of definitions alone. A native record counts
    for an endpoint only if it carries the endpoint's id: sourceNode, then targetNode, then node, then the record itself.
    """
    o = observations
    if prefer_definitions:
        # one row per provider meets the observations, which stay where they are
        is_definition = F.col("predicate").eqNullSafe("defines")
        defining = o.where(is_definition).select("provider").distinct()
        o = o.where(is_definition).unionByName(o.where(~is_definition).join(F.broadcast(defining), "provider", "left_anti").select(*o.columns))
    entity, defines = F.col("object.entity"), F.col("predicate") == "defines"
    both = F.when(defines, F.array(F.coalesce(entity, F.col("subject")))).when(entity.isNotNull(), F.array("subject", entity)).otherwise(F.array("subject"))
    o = o.select("provider", "repository", "source", "providerNative", F.explode(both).alias("e")).withColumn("v", F.try_parse_json("providerNative"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    places = ("$.sourceNode", "$.targetNode", "$.node", "$")
    # a node that is null, or no object, is no node: the record itself counts then
    has_node = F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("v", "$.node", "variant")), F.lit("OBJECT<")), F.lit(False))

    def found(place: str):
        ok = get(f"{place}.id") == F.col("e.id")
        return ok & ~has_node if place == "$" else ok

    # the node that counts is looked for once, and its attributes are read from it
    node = F.lit(None).cast("variant")
    for p in reversed(places):
        node = F.when(found(p), get(p, "variant")).otherwise(node)
    o = o.withColumn("own", node)
    attribute = lambda name, kind="string": F.try_variant_get("own", f"$.{name}", kind)

    qualified = attribute("qualifiedName")
    return o.select(
        "provider", "repository", F.col("e.id").alias("id"), F.col("e.kind").alias("kind"),
        F.coalesce(attribute("path"), F.col("source.path")).alias("path"), F.coalesce(attribute("span"), F.col("source.span")).alias("span"),
        F.lit(None).cast("struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>").alias("range"), F.lit(None).cast("string").alias("rangeBase"),
        F.coalesce(attribute("name"), S.last_symbol_part(F.coalesce(qualified, F.col("e.id")))).alias("name"),
        F.coalesce(qualified, F.col("e.id")).alias("qualifiedName"), F.coalesce(attribute("signature"), attribute("type")).alias("signature"),
        F.coalesce(attribute("aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"), "providerNative")


def normalize_entities(entities: DataFrame) -> DataFrame:
    """ENTITY_INPUT to normal form with derived keys; of rows with one key the one with the smallest payload stays.

    Columns: eid (digest of the key), provider, repository, id, kind, family, path, range, name, qualifiedName, signature,
    aliases, q_keys, a_keys, n_keys, s_key, providerNative.
    """
    none = F.array().cast("array<string>")
    e = entities.select(
        "provider", "repository", S.trim(F.col("id")).alias("id"), F.coalesce(S.clean(F.col("kind")), F.lit("unknown")).alias("kind"), S.normalize_path(F.col("path")).alias("path"),
        F.coalesce(S.given_range(F.col("range")), S.parse_span(F.col("span"), F.col("provider.id"), F.col("rangeBase"))).alias("range"),
        S.clean(F.col("name")).alias("name"), S.clean(F.col("qualifiedName")).alias("qualifiedName"), S.clean(F.col("signature")).alias("signature"),
        F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("aliases", none), S.trim), lambda a: a != ""))).alias("aliases"), "providerNative")
    keys = lambda c: F.coalesce(S.symbol_keys(c), none)
    ordered = lambda c: F.array_sort(F.array_distinct(c))
    e = e.withColumns({"family": S.kind_family(F.col("kind")), "q_keys": ordered(keys(F.col("qualifiedName"))), "a_keys": ordered(F.flatten(F.transform("aliases", S.symbol_keys))), "s_key": S.normalize_signature(F.col("signature"))})
    e = e.withColumn("n_keys", ordered(F.concat(keys(F.col("name")), "q_keys", "a_keys")))
    e = e.withColumn("eid", S.digest(*[F.col(c) for c in ("provider", "repository", "id", "family", "path", "range", "n_keys", "q_keys", "a_keys", "s_key")]))
    rest = [c for c in e.columns if c != "eid"]
    # rows of one key are few, so they are sorted once, where they have met
    first = e.repartition("eid").groupBy("eid").agg(F.min_by(F.struct(*rest), F.struct(F.coalesce("providerNative", F.lit("undefined")), "kind", F.to_json("aliases"))).alias("x"))
    return first.select("eid", "x.*")
