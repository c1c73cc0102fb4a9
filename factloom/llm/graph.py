"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u long, v long) to rows (node, root), root being the smallest node of the component.

    Nodes without an edge don't occur. Each round writes the edges to the shared folder, so lineage stays short and lost
    executors cost one round at most. The minimum of a hub's neighbours is aggregated before the shuffle; the join that
    follows is a plain equi-join, whose hot keys adaptive execution splits. Rounds grow with the logarithm of the longest
    path. Nulls are dropped and loops ignored; an empty table gives an empty result.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        # large star: every larger neighbour moves to the smallest node in sight
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node itself, moves to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, edges = edges, materialize(small, "edges")
        discard(old)
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
