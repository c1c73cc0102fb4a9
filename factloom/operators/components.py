"""Tiered grouping of entities: strongest evidence first, components of bounded size.

A group has one member of each provider at most, so with P providers a component of more than P nodes can't be one. Each
node gathers what lies within P steps, at most P + 1 ids: up to P ids are its whole component, more mean it is too large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import discard, large, materialize


#: After so many steps the lineage is cut, and no more are taken once no ball grows.
CUT = 3


def bounded_components(edges: DataFrame, bound: int) -> DataFrame:
    """Edges (left, right) to (node, members): the sorted component of a node, or null if it has more than ``bound`` nodes."""
    both = large(edges.select(F.col("left").alias("u"), F.col("right").alias("v")).union(edges.select(F.col("right").alias("u"), F.col("left").alias("v"))).distinct())
    degree = both.groupBy("u").agg(F.count("*").alias("n"))
    # a node with more neighbours than the bound needs no list of them
    ball = degree.select("u", (F.col("n") > bound).alias("big"), F.array("u").alias("ball"))
    narrow = large(both.join(degree.where(F.col("n") <= bound).select("u"), "u"))
    for step in range(bound):
        seen = narrow.join(ball.withColumnsRenamed({"u": "v", "big": "b", "ball": "near"}), "v").groupBy("u").agg(F.bool_or("b").alias("b"), F.flatten(F.collect_list("near")).alias("near"))
        joined = ball.join(seen, "u", "left")
        all_ = F.array_distinct(F.concat("ball", F.coalesce("near", F.array().cast(ball.schema["ball"].dataType))))
        ball = joined.select("u", F.col("big") | F.coalesce("b", F.lit(False)) | (F.size(all_) > bound), F.slice(F.array_sort(all_), 1, bound + 1), F.size(all_) > F.size("ball")).toDF("u", "big", "ball", "grew")
        if step % CUT == CUT - 1 and step + 1 < bound:
            ball = large(materialize(ball, "balls"))
            if not ball.where("grew and not big").head(1):
                break
        ball = ball.drop("grew")
    ball = ball.select("u", "big", "ball")
    return ball.select(F.col("u").alias("node"), F.when(~F.col("big"), F.col("ball")).alias("members"))


def best_edges(edges: DataFrame) -> DataFrame:
    """Edges (left, right, score) that count when scores are taken from the highest and every node takes part at one score only.

    A node takes part at the highest score at which it has an edge to a node that no higher score has taken. So an edge is dead
    once one of its ends is taken above its score, and an end is taken as soon as one of its edges is the best of both its ends.
    Each round settles the best score that is left anywhere at least, so there are no more rounds than distinct scores; as
    most nodes settle in the first, there are two or three.
    """
    alive = large(materialize(edges.select("left", "right", "score"), "alive"))
    while True:
        best = alive.select(F.explode(F.array("left", "right")).alias("node"), "score").groupBy("node").agg(F.max("score").alias("best"))
        seen = alive
        for side in ("left", "right"):
            seen = seen.join(best.withColumnsRenamed({"node": side, "best": f"{side}_best"}), side)
        seen = large(materialize(seen, "seen"))
        top = F.greatest("left_best", "right_best")
        if not seen.where(F.col("score") < top).head(1):
            discard(seen)
            return alive
        taken = seen.where(F.col("score") == F.least("left_best", "right_best")).where(F.col("score") == top).select(F.explode(F.array("left", "right")).alias("node")).distinct()
        rest = seen
        for side in ("left", "right"):
            rest = rest.join(taken.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_taken")), side, "left")
        dead = [F.coalesce(f"{side}_taken", F.lit(False)) & (F.col("score") < F.col(f"{side}_best")) for side in ("left", "right")]
        before, alive = alive, large(materialize(rest.where(~(dead[0] | dead[1])).select("left", "right", "score"), "alive"))
        discard(before, seen)


def build_groups(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with (members, strength): the group of each; a group of one has its own id and strength ``probable``.

    At each score, from the highest, only entities neither grouped nor blocked take part; a component with two members of
    one provider is blocked as a whole. Which edges count is found first, for all scores at once, and as no entity takes part at two
    scores their components are those of one graph. An edge whose ends have no other is a group as it stands: its ends are of two
    providers. The entity's other columns stay with it.
    """
    bound = entities.select("provider").distinct().count()
    ends = edges.select("left", "right", "score", F.explode(F.array("left", "right")).alias("node")).withColumn("n", F.count("*").over(W.partitionBy("node")))
    told = large(materialize(ends.groupBy("left", "right").agg(F.first("score").alias("score"), F.max("n").alias("n")), "told"))
    label = F.when(F.max("score") >= 80, "matched").otherwise("probable").alias("strength")
    alone = told.where("n = 1").select(F.explode(F.array("left", "right")).alias("eid"), F.array_sort(F.array("left", "right")).alias("members"), F.when(F.col("score") >= 80, "matched").otherwise("probable").alias("strength"))
    live = best_edges(told.where("n > 1"))
    strength = live.select(F.explode(F.array("left", "right")).alias("node"), "score").groupBy("node").agg(label)
    found = large(materialize(bounded_components(live, bound).join(strength, "node"), "components"))
    whole = found.where("members is not null").select("node", F.explode("members").alias("eid")).join(entities.select("eid", "provider"), "eid")
    clash = whole.groupBy("node").agg((F.count_distinct("provider") < F.count("*")).alias("clash"))
    judged = found.join(clash, "node", "left").select(F.col("node").alias("eid"), F.when(~F.coalesce("clash", F.lit(True)), F.col("members")).alias("members"), "strength")
    got = entities.join(judged.unionByName(alone), "eid", "left")
    own = F.col("members").isNull()
    return got.select(*entities.columns, F.when(own, F.array("eid")).otherwise(F.col("members")).alias("members"), F.when(own, F.lit("probable")).otherwise(F.col("strength")).alias("strength"))
