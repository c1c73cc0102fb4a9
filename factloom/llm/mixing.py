"""Mixing sources to target weights by Pareto order sampling.

Within a source a document is due copies in proportion to its size, at most ``cap`` of them, so that the expected words are
the source's target. The whole copies that a document is due are certain and allocated outright. The fraction p that is left
is its inclusion probability: documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the
first in this order are taken, a sample whose size is fixed in words: what the source has left. The logarithm of the order statistic is binned
twice, so that only a few thousandths of a percent of a source are ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, n_words

WEIGHTS = (3.0, 1.0, 2.0)
#: Bins of one unit of the logarithm of the order statistic, and parts of a bin.
BINS, PARTS = 256, 4096


def uniform(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) from a digest of the columns: equal on every run and in every engine that has md5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols], F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over the sources by code point, null last.

    A target stops at ``cap`` times its source's size; the excess goes to the others by weight until none is above. With
    sources ordered by size over weight this is one level for all that aren't capped. One row per source is ordered here.
    """
    one = F.lit(0)
    order = W.partitionBy(one).orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    by = [F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source")]
    before = W.partitionBy(one).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy(one).orderBy(*by).rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy(one)) * share
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("most"), F.col("level"))).over(W.partitionBy(one)))
    return s.select("source", "source_size", F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def rates(counts: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    """(k, rate): the copies that a word of size makes a document due, before the cap; null if all documents are at the cap.

    ``counts``: (k, size, n), documents by source and size. With documents above a size at the cap, the rate is what is left
    of the target over the squares of the other sizes; the largest size that this rate leaves below the cap is the right one.
    A source's distinct sizes are few, whatever the number of its documents. Sums are exact.
    """
    exact = "decimal(38,0)"
    size, n = F.col("size").cast(exact), F.col("n").cast("decimal(18,0)")
    words, square = (size * n).cast(exact), (size * size).cast(exact)
    above = W.partitionBy("k").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy("k").orderBy(F.desc("size")).rowsBetween(0, W.unboundedFollowing)
    c = counts.where("size > 0").join(plan.select("k", "target"), "k")
    c = c.withColumns({"words": words, "squares": (square * n).cast(exact)})
    left = F.col("target") - cap * F.coalesce(F.sum("words").over(above), F.lit(0).cast(exact)).cast("double")
    c = c.select("k", "size", (left / F.sum("squares").over(rest).cast("double")).alias("rate"))
    return c.where(F.col("rate") * F.col("size") <= cap).groupBy("k").agg(F.max_by("rate", "size").alias("rate"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 3, keep_row: bool = False) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken (size times copies); ``keep_row``: and row.

    The words that a source gives differ from its target by half a document at most, or because its documents are too
    few. Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in order. Rows that
    repeat an id and a text are told apart by nothing, so any of them may be the one taken: the rows of the result are the
    same. An empty table gives no rows. Reruns agree, whatever the partitions. Texts are read once and never shuffled.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if keep_row else []
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), source.alias("source"), n_words(text).alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), *row)
    rows = rows.withColumns({"u": uniform(F.col("id"), F.col("size"), F.col("digest"), seed=seed), "k": F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")), "at": F.monotonically_increasing_id()}).drop("digest")
    rows = materialize(rows, "sizes")
    counts = materialize(rows.groupBy("k", "source", "size").agg(F.count("*").alias("n")), "counts")
    sums = counts.groupBy("k", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    plan = targets(sums.drop("k"), weights, share, cap).withColumn("k", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).drop("source")
    # one row per source each: written, so that the next step reads it in place of working it out again
    plan = materialize(plan, "targets")
    plan = materialize(plan.join(rates(counts, plan, cap), "k", "left"), "rates")
    due = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce(F.least(F.lit(float(cap)), F.col("rate") * F.col("size")), F.lit(float(cap))))
    certain = counts.join(plan, "k").groupBy("k").agg(F.sum(F.floor(due) * F.col("size") * F.col("n")).alias("certain"))
    plan = materialize(plan.join(certain, "k").withColumn("rest", F.col("target") - F.col("certain")).drop("certain"), "plan")
    p, u = F.col("p"), F.col("u")
    ranked = rows.join(plan, "k").withColumn("due", due).withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.col("whole"))
    ranked = ranked.withColumn("q", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))))
    fine = F.floor(F.log("q") * (BINS * PARTS))
    drawn = ranked.where("q is not null and rest > 0").withColumns({"bin": F.floor(fine / PARTS), "fine": fine})
    bins = drawn.groupBy("k", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    edge = materialize(_edge(bins, "bin", F.lit(0)).select("k", F.col("bin").alias("edge_bin"), "before"), "edges")
    parts = drawn.join(edge, "k").where("bin = edge_bin").groupBy("k", "fine").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("start"))
    edge = materialize(_edge(parts, "fine", F.col("start")).select("k", F.col("fine").alias("edge_fine"), "before"), "edges")
    across = materialize(drawn.join(edge, "k").where("fine = edge_fine").select("k", "q", "id", "size", "at", "rest", "before"), "across")
    last = materialize(_last(across), "last")
    place = F.struct(*_order(), F.col("at").alias("at"))
    # without an edge all that could be drawn is
    more = F.when(F.col("q").isNull() | (F.col("rest") <= 0), 0).when(F.col("last").isNull() | (place <= F.col("last")), 1).otherwise(0)
    out = ranked.join(last, "k", "left").withColumn("copies", (F.col("whole") + more).cast("long"))
    return out.select("id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *["row"] * keep_row)


def _edge(bins: DataFrame, name: str, start: Column) -> DataFrame:
    """The bin of each source in which the words that are left run out, and the words before it."""
    upto = W.partitionBy("k").orderBy(name).rowsBetween(W.unboundedPreceding, -1)
    return bins.withColumn("before", start + F.coalesce(F.sum("words").over(upto), F.lit(0))).where("before < rest and before + words >= rest")


def _order() -> list[Column]:
    return [F.col("q").alias("q"), F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), F.col("size").alias("size")]


def _last(rows: DataFrame) -> DataFrame:
    """(k, last): the last row of each source that is taken, by order statistic, id, size and number of the row.

    Rows that are alike but for their number are counted, not sorted: the words run out in one such group of a source. Within it rows
    are counted by partition, and only the partition in which the last one lies is numbered.
    """
    alike = rows.groupBy("k", *_order()).agg(F.count("*").alias("m"), F.first("rest").alias("rest"), F.first("before").alias("start"))
    upto = W.partitionBy("k").orderBy("q", "known", "id").rowsBetween(W.unboundedPreceding, -1)
    alike = alike.withColumn("open", F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(upto), F.lit(0)))
    # the document that lies across the limit is taken if more than half of it is within
    alike = alike.withColumn("some", F.least(F.col("m"), F.greatest(F.lit(0), F.floor(F.col("open") / F.col("size") + 0.5))).cast("long"))
    none = alike.groupBy("k").agg(F.struct(F.min("q").alias("q"), F.lit(False).alias("known"), F.lit(-(1 << 63)).cast("long").alias("id"), F.lit(-1).cast("long").alias("size"), F.lit(-1).cast("long").alias("at")).alias("none"))
    taken = alike.where("some > 0").groupBy("k").agg(F.max(F.struct("q", "known", "id", "size", F.col("m"), F.col("some"))).alias("x")).select("k", "x.*")
    pid = F.shiftright("at", 33)
    group = rows.join(taken.select("k", F.col("q").alias("gq"), F.col("known").alias("gk"), F.col("id").alias("gi"), "some"), "k")
    group = group.where((F.col("q") == F.col("gq")) & (F.col("id").isNotNull() == F.col("gk")) & (F.coalesce("id", F.lit(0).cast("long")) == F.col("gi"))).withColumn("pid", pid)
    by_part = group.groupBy("k", "pid").agg(F.count("*").alias("n"), F.first("some").alias("some"))
    by_part = by_part.withColumn("ahead", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    by_part = by_part.where("ahead < some and ahead + n >= some").select("k", "pid", "ahead")
    inside = group.join(by_part, ["k", "pid"]).withColumn("nth", F.col("ahead") + F.row_number().over(W.partitionBy("k", "pid").orderBy("at")))
    at = inside.where("nth = some").select("k", "at")
    last = taken.join(at, "k").select("k", F.struct("q", "known", "id", "size", "at").alias("last"))
    return none.join(last, "k", "left").select("k", F.coalesce("last", "none").alias("last"))


def repeat(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, as often as it takes them, with the same columns."""
    taken = mix(df, keep_row=True, **options)
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
