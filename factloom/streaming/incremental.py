"""The matrix kept up to date: states of logical facts as facts arrive.

A fact says up to three things of its logical key: a variant, a provider, and that something about it is only probable. The state
store holds each of these once, so a hot key needs no more memory of a task than any other, and only what is new leaves a
batch. What is new is counted for every key and appended to a table of changes; states are sums over it. Facts that repeat change
nothing, and the last state of a key is the same in whatever order and batches its facts come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import DESCRIPTOR

CHANGES = "logical_key string, fact_class string, new_variants long, new_providers long, probable boolean, version long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def news(facts: DataFrame) -> DataFrame:
    """(logical_key, fact_class, what, said): what a stream of DESCRIPTOR rows says for the first time. Facts that can't be compared say nothing."""
    mark = lambda what, c: F.struct(F.lit(what).alias("what"), c.alias("said"))
    marks = F.array(mark("variant", F.col("exact_key")), mark("provider", F.to_json("provider")), mark("probable", F.when(F.col("status") == "probable", "")))
    told = facts.where("logical_key is not null").select("logical_key", "fact_class", F.explode(marks).alias("m")).select("logical_key", "fact_class", "m.*").where("said is not null")
    return told.dropDuplicates(["logical_key", "what", "said"])


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Changes (CHANGES) from the Parquet files (DESCRIPTOR) of a folder, as they are there, to the table ``out``; also after a restart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(DESCRIPTOR).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def write(batch: DataFrame, epoch: int) -> None:
        count = lambda what: F.count_if(F.col("what") == what)
        changes = batch.groupBy("logical_key").agg(
            F.min("fact_class").alias("fact_class"), count("variant").alias("new_variants"), count("provider").alias("new_providers"), F.bool_or(F.col("what") == "probable").alias("probable"), F.lit(epoch).cast("long").alias("version"))
        # a batch that is repeated replaces its own folder
        changes.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return news(stream).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The last state of every key of a table that :func:`follow` writes."""
    held = table.groupBy("logical_key").agg(
        F.min_by("fact_class", "version").alias("fact_class"), F.sum("new_variants").alias("n_variants"), F.sum("new_providers").alias("n_providers"), F.bool_or("probable").alias("probable"))
    state = F.when(F.col("n_variants") > 1, "conflict").when(F.col("n_providers") > 1, "overlap").otherwise("provider-only")
    return held.select("logical_key", "fact_class", state.alias("state"), F.when(F.col("probable"), "probable").otherwise("matched").alias("correlation_status"), "n_variants", "n_providers")
