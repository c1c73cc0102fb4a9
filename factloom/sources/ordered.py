"""Ordered sinks: sorted files of a fixed number of rows, with a manifest of their ranges.

What is in a file depends on the rows alone, not on their order or partitions: rows are sorted by ranges, numbered through by
the sizes of the ranges before, and a row's number decides its file. So the same rows in another order give the same bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, materialize

ROWS_PER_FILE = 1 << 20
#: Orders of the library's tables, by name: keys that sort ascending in binary order, ties by the whole row.
ORDERS: dict[str, tuple[str, ...]] = {
    "facts": ("exact_key", "fact_id"), "unsupported": ("group_key", "evidence_id"), "evidence": ("evidence_id",), "canonical": ("canonical_id",), "members": ("canonical_id", "to_json(provider)", "id"),
    "links": ("left", "right", "-score"), "metrics": ("to_json(provider)",), "diagnostics": ("class",), "rows": ("to_json(repository)", "fact_class", "key"), "variants": ("logical_key", "exact_key"),
    "records": ("to_json(repository)", "fact_class", "key"), "pairwise": ("to_json(left)", "to_json(right)", "fact_class"), "coverage": ("to_json(provider)", "fact_class"), "comparisons": ("key", "fact_class"),
    "entities": ("to_json(provider)",), "gain": ("ord",)}
_LOW = (1 << 33) - 1
_DIGEST, _AT = "ordered by this digest", "ordered at"


def _columns(keys: tuple[str, ...] | list[str]) -> list[Column]:
    return [F.expr(k) if any(c in k for c in "(-.") else F.col(f"`{k}`") for k in keys]


def numbered(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """``row`` (struct of all columns), ``first`` (struct of the keys), ``tie`` and ``nth``, the row's place from 0 on.

    Rows alike in all columns may change places. One shuffle by ranges of the keys and the whole row, so no key is one task;
    numbers come from the sizes of the sorted parts, one row per part.
    """
    names = [f"k{i}" for i in range(len(keys))]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = F.struct(*[k.alias(n) for k, n in zip(_columns(keys), names)])
    tie = F.to_json(row, {"ignoreNullFields": "false"})
    # a digest deals out rows that are alike up to a long text; keys and ties aren't written, as they follow from the row
    order = [*[k.asc_nulls_first() for k in _columns(keys)], F.col(_DIGEST)]
    dealt = df.withColumn(_DIGEST, F.unhex(F.md5(tie.cast("binary")))).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(dealt.drop(_DIGEST).withColumn(_AT, F.monotonically_increasing_id()), "ordered")
    placed = placed.select(row.alias("row"), first.alias("first"), tie.alias("tie"), F.col(_AT).alias("at"))
    part = F.shiftright("at", 33)
    before = W.partitionBy(F.lit(0)).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(sizes), part == F.col("p")).select("row", "first", "tie", (F.col("start") + F.col("at").bitwiseAND(F.lit(_LOW))).alias("nth"))


def write_ordered(df: DataFrame, root: str, keys: tuple[str, ...] | list[str], rows_per_file: int = ROWS_PER_FILE, form: str = "json") -> DataFrame:
    """Write ``root/data/part_no=N/`` in the order of ``keys``, one file each, and ``root/manifest``; returns the manifest.

    The manifest has for each file its number, rows, first and last keys (JSON) and a checksum of its rows. A table without rows
    gives an empty manifest and no file. ``form``: json, parquet or text (one string column).
    """
    rows = numbered(df, keys).withColumn("part_no", F.floor(F.col("nth") / rows_per_file).cast("int"))
    out = rows.repartition("part_no").sortWithinPartitions("part_no", "nth").select("part_no", "row.*")
    out.write.mode("overwrite").partitionBy("part_no").format(form).option("ignoreNullFields", "false").save(f"{root}/data")
    key = F.to_json("first", {"ignoreNullFields": "false"})
    manifest = rows.groupBy("part_no").agg(
        F.count("*").alias("n"), F.min_by(key, "nth").alias("first"), F.max_by(key, "nth").alias("last"), F.sum(F.xxhash64("tie").cast("decimal(38,0)")).cast("string").alias("checksum"))
    manifest.coalesce(1).sortWithinPartitions("part_no").write.mode("overwrite").json(f"{root}/manifest")
    discard(rows)
    return df.sparkSession.read.schema("part_no int, n long, first string, last string, checksum string").json(f"{root}/manifest")


def write_tables(tables: dict[str, DataFrame], root: str, rows_per_file: int = ROWS_PER_FILE, form: str = "json") -> dict[str, DataFrame]:
    """Every table that :data:`ORDERS` knows, each in its own folder; returns the manifests by name."""
    return {name: write_ordered(df, f"{root}/{name}", ORDERS[name], rows_per_file, form) for name, df in tables.items() if name in ORDERS}


def parts(spark: SparkSession, root: str) -> list[str]:
    """Files of an ordered table in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/*/part-*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((str(s.getPath()) for s in found or []), key=lambda p: int(p.split("part_no=")[1].split("/")[0]))
