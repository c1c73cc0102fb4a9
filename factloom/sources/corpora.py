"""Evidence corpora over the sample tables: who says what about orders, customers, documents and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DESCRIPTOR, RANGE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows of what may be one small file, dealt to all cores before anything is worked out from them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def provider(name: str) -> Column:
    return F.struct(F.lit(name).alias("id"), F.lit("1.0.0").alias("version"), F.lit("deterministic").alias("determinism"))


def repository() -> Column:
    return F.struct(F.lit("sample").alias("source"), F.lit("a" * 40).alias("commitSha"))


def _rows(df: DataFrame, name: str, fact_class: Column, logical: Column, value: Column, status: str = "matched", fact: bool = True) -> DataFrame:
    key = F.concat_ws("=", logical, value)
    return df.select(
        repository().alias("repository"), provider(name).alias("provider"), fact_class.alias("fact_class"), logical.alias("group_key"), logical.alias("logical_key"), key.alias("exact_key"), F.lit(status).alias("status"),
        (F.concat(F.lit(f"{name}/"), key) if fact else F.lit(None).cast("string")).alias("fact_id"), F.concat(F.lit(f"{name}#"), key).alias("evidence_id"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of five providers: order statuses twice, customers three times."""
    order = lambda c: F.concat(F.lit("order:"), F.col(c))
    person = lambda c: F.concat(F.lit("customer:"), F.col(c))
    lo, hi = F.min("l_linestatus"), F.max("l_linestatus")
    rolled = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(lo == hi, lo).otherwise("P").alias("s"))
    reads, refs = F.lit("reads"), F.lit("references")
    out = _rows(_table(spark, sf_dir, "orders"), "ledger", reads, order("o_orderkey"), F.col("o_orderstatus"))
    out = out.union(_rows(rolled, "rollup", reads, order("l_orderkey"), F.col("s")))
    out = out.union(_rows(_table(spark, sf_dir, "customer"), "master", refs, person("c_custkey"), F.col("c_custkey").cast("string")))
    out = out.union(_rows(_table(spark, sf_dir, "orders").select("o_custkey").distinct(), "history", refs, person("o_custkey"), F.col("o_custkey").cast("string")))
    return out.union(_rows(_table(spark, sf_dir, "events").select("user_id").distinct(), "stream", refs, person("user_id"), F.col("user_id").cast("string")))


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facts and unsupported evidence with their ends, as normalized facts have them.

    Beside the five providers of :func:`facts`, ``lines`` observes an order's status on each of its lines, so it has many facts
    of one value. What ``history`` says of customers whose number 7 divides is ambiguous; of those 11 divides, unmatched.
    """
    line = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order:"), "l_orderkey").alias("logical"), F.coalesce("l_linestatus", F.lit("")).alias("value"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("line")).where("logical is not null")
    lines = line.select(
        repository().alias("repository"), provider("lines").alias("provider"), F.lit("reads").alias("fact_class"), F.col("logical").alias("group_key"), F.col("logical").alias("logical_key"), F.concat_ws("=", "logical", "value").alias("exact_key"), F.lit("matched").alias("status"),
        F.concat(F.lit("lines/"), "line").alias("fact_id"), F.concat(F.lit("lines#"), "line").alias("evidence_id"))
    said = facts(spark, sf_dir).unionByName(lines)
    n = F.split_part("logical_key", F.lit(":"), F.lit(2)).try_cast("long")
    open_ = F.when((F.col("provider.id") == "history") & (n % 7 == 0), "ambiguous").when((F.col("provider.id") == "history") & (n % 11 == 0), "unmatched")
    none = F.array().cast("array<string>")

    def ends(df: DataFrame) -> DataFrame:
        clear = F.col("status").isin("matched", "probable")
        subject = F.struct(
            F.when(clear, F.col("group_key")).alias("canonical_id"), F.when(F.col("status") == "ambiguous", F.array(F.concat("group_key", F.lit("/a")), F.concat("group_key", F.lit("/b")))).otherwise(none).alias("candidate_ids"),
            F.concat_ws("/", "provider.id", "group_key").alias("native_id"), F.lit("record").alias("kind"), F.col("status").alias("status"))
        return df.withColumns({"predicate": F.col("fact_class"), "subject": subject, "object": F.lit(None).cast(subject_type), "value": F.split_part("exact_key", F.lit("="), F.lit(2))})

    subject_type = "struct<canonical_id:string,candidate_ids:array<string>,native_id:string,kind:string,status:string>"
    said = said.withColumn("status", F.coalesce(open_, "status"))
    said = said.withColumn("logical_key", F.when(F.col("status") == "matched", F.col("logical_key")))
    return ends(said), ends(unsupported(spark, sf_dir))


def unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence of predicates that have no common meaning."""
    e = _table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "string")
    return _rows(e, "stream", F.col("event_type"), F.concat_ws(":", F.lit("customer"), "user_id", "event_type"), F.concat_ws("/", "event_id", k), "unmatched", fact=False)


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities of two providers (by parity of the id) that agree where their whole text does.

    A document without an id is one of the odd ones, named by its text.
    """
    d = _table(spark, sf_dir, "documents").withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    side = F.when(F.col("doc_id").try_cast("long") % 2 == 0, "even").otherwise("odd")
    who = F.struct(side.alias("id"), F.lit("1.0.0").alias("version"), F.lit("deterministic").alias("determinism"))
    text = lambda x: F.lit(None).cast(x)
    return d.select(
        who.alias("provider"), repository().alias("repository"), F.concat(side, F.lit("_d"), "doc_id").alias("id"), F.lit("symbol").alias("kind"), F.concat(F.lit("docs/"), F.coalesce("source", F.lit("-")), F.lit("/"), "doc_id").alias("path"), text("string").alias("span"),
        text("struct<startLine:bigint,startColumn:bigint,endLine:bigint,endColumn:bigint>").alias("range"), text("string").alias("rangeBase"), F.concat(side, F.lit("_d"), "doc_id").alias("name"), F.concat(side, F.lit("_d"), "doc_id").alias("qualifiedName"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("signature"), text("array<string>").alias("aliases"), text("string").alias("providerNative"))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of two providers (three for some) that agree in another way for each remainder over 11.

    0: place; 1: qualified name, path and signature; 2: qualified name and path; 3: qualified name and signature;
    4: qualified name; 5: path and signature; 6: path and name; 7: signature; 8: alias; 9: path and kind, without names;
    10: place, but the other provider has two there. Parts of remainder 0 over 33 are known to a third provider, too.
    """
    p = _table(spark, sf_dir, "part").where("p_partkey is not null").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 11).alias("c"))
    p = _spread(p)
    sides = p.select("k", "c", F.explode(F.expr("CASE WHEN c = 10 THEN array('north', 'south', 'south2') WHEN k % 33 = 0 THEN array('north', 'south', 'west') ELSE array('north', 'south') END")).alias("who"))
    both = lambda *cs: F.col("c").isin(*cs)
    is_north, own = F.col("who") == "north", F.concat(F.col("who"), F.lit("_"), "k")
    one = lambda prefix: F.concat(F.lit(prefix), "k")
    none = F.lit(None).cast("string")
    same_place = both(0, 10)
    return sides.select(
        F.struct(F.substring_index("who", "2", 1).alias("id"), F.lit("1.0.0").alias("version"), F.lit("deterministic").alias("determinism")).alias("provider"), repository().alias("repository"), own.alias("id"),
        F.when(both(9), "widget").when(is_north, "FunctionDeclaration").when(F.col("k") % 2 == 0, "symbol").otherwise("method").alias("kind"),
        F.when(both(0, 1, 2, 5, 6, 9, 10), one("parts/p")).otherwise(F.concat(F.lit("parts/"), own)).alias("path"),
        F.when(same_place | is_north, "L1C1-L1C9").otherwise("L7C1-L7C9").alias("span"), F.lit(None).cast(RANGE).alias("range"), none.alias("rangeBase"),
        F.when(both(6), one("n_")).when(~both(9), F.concat(F.lit("own_"), own)).alias("name"),
        F.when(both(1, 2, 3, 4), one("q_")).when(both(8) & ~is_north, one("alias_")).when(~both(6, 9), F.concat(F.lit("full_"), own)).alias("qualifiedName"),
        F.when(both(1, 3, 5, 7), one("sig ")).alias("signature"), F.when(both(8) & is_north, F.array(one("alias_"))).otherwise(F.array().cast("array<string>")).alias("aliases"), none.alias("providerNative"))


def customer_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three providers observe about customers: definitions both ways round, values, calls, and a predicate of their own.

    ``table`` defines every customer, with one-based spans; ``scip`` those whose number isn't a multiple of 5, with zero-based spans
    and the definition the other way round, multiples of 7 twice; ``third`` defines nothing and reads multiples of 4.
    """
    c = _table(spark, sf_dir, "customer").where("c_custkey is not null").select(F.col("c_custkey").alias("k"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"))
    c = _spread(c)
    who = lambda n: provider(n).alias("provider")
    thing = lambda prefix, kind, by=0: F.struct(F.concat(F.lit(prefix), F.col("k") + by).alias("id"), F.lit(kind).alias("kind"))
    entity = lambda e: F.struct(e.alias("entity"), F.lit(None).cast("string").alias("value")).cast("struct<entity:struct<id:string,kind:string>,value:string>")
    value = lambda v: F.struct(F.lit(None).cast("struct<id:string,kind:string>").alias("entity"), v.alias("value"))
    path = F.concat(F.lit("customers/"), F.col("k"), F.lit(".ts"))

    def rows(df: DataFrame, name: str, subject: Column, predicate: str, object_: Column, span: str, path: Column = path) -> DataFrame:
        return df.select(
            F.lit(1).alias("schemaVersion"), subject.alias("subject"), F.lit(predicate).alias("predicate"), object_.alias("object"), who(name), repository().alias("repository"),
            F.struct(path.alias("path"), F.lit(span).alias("span")).alias("source"), F.lit("deterministic").alias("determinism"), F.to_json(F.struct(F.lit(predicate).alias("p"), F.col("k"))).alias("providerNative"))

    there, twice, read = c.where("k % 5 <> 0"), c.where("k % 5 <> 0 and k % 7 = 0"), c.where("k % 4 = 0")
    other = F.concat(F.lit("./customers//"), F.col("k"), F.lit(".ts"))
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" "), F.col("segment"), F.lit("?"))).otherwise(F.concat(F.col("segment"), F.lit("  ")))
    parts = [
        rows(c, "table", thing("m", "module"), "defines", entity(thing("c", "function")), "L1C1-L1C9"), rows(c, "table", thing("c", "function"), "reads", value(F.col("segment")), "L3C1-L3C9"),
        rows(c, "table", thing("c", "function"), "calls", entity(thing("c", "function", 1)), "L5C1-L5C9"), rows(c, "table", thing("c", "function"), "wires-into", value(F.lit("x")), "L6C1-L6C9"),
        rows(there, "scip", thing("sym_", "symbol"), "defines", value(path), "0:0-0:8", other), rows(twice, "scip", thing("dup_", "symbol"), "defines", value(path), "0:0-0:8", other),
        rows(there, "scip", thing("sym_", "symbol"), "reads", value(said), "2:0-2:8", other), rows(read, "third", thing("t", "function"), "reads", value(F.col("segment")), "L1C1-L1C9")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def descriptors(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, DESCRIPTOR)
