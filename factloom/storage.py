"""Scratch tables in the shared folder: how long lineages are cut."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a row group of scratch tables. A writer holds one in the JVM's heap for each task, and a reader the columns of one.
ROW_GROUP = 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of our own, but only if driver and executors are one process (tests): on a
    cluster executors would write to disks that nobody else sees, so there it is an error.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = spark.conf.get("spark.factloom.scratch", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.factloom.scratch", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    # digests in hexadecimal, which most of these tables consist of, take half the room with an entropy coder
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df``, whose joins sort both sides where they lie.

    Spark goes by the bytes of a table's files, which are a small part of what its rows take in memory, and would have the driver gather
    and send round a table that grows with the input. What is made of ``df`` by selecting, grouping and the like is joined so as well, up to
    its first join or union.
    """
    return df.hint("merge")


def release_shuffles(spark: SparkSession) -> None:
    """Have the files of finished shuffles deleted: Spark does so when the driver collects its garbage, which may be long after they are of use."""
    spark._jvm.System.gc()


def write_text(spark: SparkSession, path: str, lines: Iterable[str]) -> None:
    """A small text file in any file system that Spark knows; lines are written as they come."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    held: list[str] = []
    try:
        for line in lines:
            held.append(line + "\n")
            if len(held) == 1000:
                out.write(bytearray("".join(held).encode()))
                held = []
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`materialize` wrote, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/factloom/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
