"""URL filters: list rules, and association rules that FP-growth mines from labelled urls.

A url's tokens are the labels of its host and the parts of its path and query. Transactions are the distinct tokens of
the labelled urls plus one class token. Rules "tokens -> class" are kept by support and by the lower bound of their confidence,
which must also beat the class's own share, and only if no rule on fewer of the same tokens is as good. Tokens that are always
together are mined as one item, which loses nothing. Rules match through an inverted index: each rule is posted under its
rarest token, and a url that has that token is compared with the whole rule.

Labels are a table of urls and verdicts. Without one the list's own decisions are the labels; then all tokens that a list rule
names are left out, because they would only restate the list.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: (verdict, host, path) of the standing list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def list_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, verdict) of the longest rule that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens_of(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: host labels (h:), path parts (p:, numbers as p:#), query keys (q:); a digest of what is over 64 characters."""
    mark = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.when(x.rlike("^[0-9]+$"), F.lit("#")).when(F.length(x) > 64, F.concat(F.lit("~"), F.sha2(x, 256))).otherwise(x)))
    query = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)(=[^&]*)?"), F.lit(1))
    return F.coalesce(F.array_distinct(F.concat(mark("h:", F.split(host, r"\.")), mark("p:", F.split(path, "[/.]")), mark("q:", query))), F.array().cast("array<string>"))


#: A rule must hold for this share of the labelled urls and for so many of them.
SUPPORT, LEAST = 0.01, 10
#: The lower end of the 95 % interval of a rule's confidence must be above this, and above LIFT times the class's share.
CONFIDENCE, Z, LIFT = 0.7, 1.96, 1.1


def lower_bound(confidence: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of a share that was seen in ``n`` cases."""
    z2 = z * z
    return (confidence + z2 / (2 * n) - z * F.sqrt((confidence * (1 - confidence) + z2 / (4 * n)) / n)) / (1 + z2 / n)


def named_by(rules) -> list[str]:
    """The tokens that list rules name."""
    hosts = [f"h:{x}" for _, h, _ in rules for x in h.split(".") if x]
    return sorted({*hosts, *[f"p:{x}" for _, _, p in rules for x in p.replace(".", "/").split("/") if x]})


def together(labelled: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame]:
    """Tokens that are always together become one item: (members, baskets), both written.

    ``members``: token, rep, freq of each token on ``at_least`` urls; tokens that the same urls have share ``rep``, the first of
    them. Which do is told by their counts and by two digests of all their distinct urls, so no pairs of tokens are made.
    ``baskets``: items, the distinct reps of each labelled url and its class. As all sets that differ only within such a group
    have the same urls, nothing is lost; a template's 30 tokens are one item in place of 2^30 sets.
    """
    kinds = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n"))
    marks = kinds.select(F.explode("tokens").alias("token"), "n", F.xxhash64("tokens", "verdict").alias("a"), F.xxhash64(F.lit(1), "tokens", "verdict").alias("b"))
    often = marks.groupBy("token").agg(F.sum("n").alias("freq"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b")).where(F.col("freq") >= at_least)
    # a group is no larger than the tokens of one url
    members = often.groupBy("freq", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("all")).select(F.explode("all").alias("token"), F.col("all")[0].alias("rep"), "freq")
    members = materialize(members, "members")
    merged = kinds.select("tokens").distinct().select("tokens", F.explode("tokens").alias("token")).join(members, "token").groupBy("tokens").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    # urls of one kind, which may be most of them, are counted before and counted out behind the join, by thousands
    some = kinds.join(merged, "tokens", "left").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(1000).cast("long"))))
    some = some.select("tokens", "verdict", "at", F.coalesce("reps", F.array().cast("array<string>")).alias("reps"), F.least(F.lit(1000).cast("long"), F.col("n") - F.col("at")).alias("n"))
    each = some.repartition("tokens", "at").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return members, materialize(each.select(F.concat("reps", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items")), "baskets")


def mine_groups(labelled: DataFrame, min_support: float = SUPPORT, min_confidence: float = CONFIDENCE, least: int = LEAST, lift: float = LIFT) -> tuple[DataFrame, DataFrame] | None:
    """Rules on groups of tokens: (rules, members), or None where too few urls are labelled.

    ``rules``: antecedent (reps), verdict, confidence, bound, support, first (the rarest rep); see :func:`together` for ``members``.
    A url has a group if it has any of its tokens. Any number of classes may be given: they are counted, joined, never gathered.
    """
    tokens = F.array_sort(F.array_distinct(F.array_compact("tokens"))).alias("tokens")
    labelled = materialize(labelled.where("verdict is not null and size(tokens) > 0").select(tokens, "verdict"), "labelled")
    total = labelled.count()
    if total < least:
        discard(labelled)
        return None
    # half a url less, so that rounding never asks for one more
    at_least = max(least, min_support * total) - 0.5
    members, baskets = together(labelled, at_least)
    model = FPGrowth(itemsCol="items", minSupport=at_least / total, minConfidence=min_confidence).fit(baskets)
    sets = materialize(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    class_ = F.filter("items", lambda x: F.startswith(x, F.lit("=")))
    whole = sets.where(F.size(class_) == 1).select(F.array_except("items", class_).alias("antecedent"), F.substring(class_[0], 2, 1 << 20).alias("verdict"), F.col("freq").alias("both")).where("size(antecedent) > 0")
    rules = whole.join(sets.select(F.col("items").alias("antecedent"), F.col("freq").alias("n")), "antecedent")
    rules = rules.withColumn("confidence", F.col("both") / F.col("n")).withColumn("bound", lower_bound(F.col("confidence"), F.col("n")))
    shares = labelled.groupBy("verdict").agg((F.count("*") / total).alias("own"))
    rules = rules.where(F.col("bound") >= min_confidence).join(shares, "verdict").where(F.col("bound") >= lift * F.col("own"))
    rare = members.where("token = rep").select("token", "freq")
    posted = rules.withColumn("token", F.explode("antecedent")).join(rare, "token")
    cols = ("antecedent", "verdict", "confidence", "bound", (F.col("both") / total).alias("support"))
    first = materialize(posted.select(*cols, F.struct("freq", "token").alias("f")).groupBy("antecedent", "verdict", "confidence", "bound", "support").agg(F.min("f").alias("f")).select("antecedent", "verdict", "confidence", "bound", "support", F.col("f.token").alias("first")), "rules")
    # a rule on fewer of the same groups that is as sure makes a longer one idle; the same index finds the shorter ones
    less = first.select(F.col("antecedent").alias("a"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("first").alias("token"))
    met = first.withColumn("token", F.explode("antecedent")).join(less, "token")
    idle = met.where((F.col("v") == F.col("verdict")) & (F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))).select("antecedent", "verdict").distinct()
    kept = materialize(first.join(idle, ["antecedent", "verdict"], "left_anti"), "rules")
    discard(labelled, baskets, sets, first)
    return kept, members


def mine(labelled: DataFrame, min_support: float = SUPPORT, min_confidence: float = CONFIDENCE, least: int = LEAST, lift: float = LIFT) -> DataFrame:
    """``labelled`` (tokens, verdict) to rules: antecedent array<string>, verdict, confidence, bound, support, first (rarest token).

    Rows with a null verdict or no tokens are left out. Mining is distributed, over groups of tokens that are always together
    (see :func:`together`); the support, a share of the labelled urls, bounds how many sets are frequent (1 / support times
    the sets of a url's groups). A url with very many tokens that come and go one by one still has very many sets. Rules on
    any number of tokens are kept. This listing names single tokens, one of each group in all ways, and so can be long;
    :func:`judge` matches the groups themselves.
    """
    found = mine_groups(labelled, min_support, min_confidence, least, lift)
    if found is None:
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, verdict string, confidence double, bound double, support double, first string")
    rules, members = found
    named = members.groupBy("rep").agg(F.collect_list(F.struct("freq", "token")).alias("some"))
    key = ("antecedent", "verdict", "confidence", "bound", "support")
    parts = rules.select(*key, F.explode("antecedent").alias("rep")).join(named, "rep").groupBy(*key).agg(F.collect_list("some").alias("parts"))
    none = F.array(F.array().cast("array<struct<freq:bigint,token:string>>"))
    ways = F.aggregate("parts", none, lambda acc, some: F.flatten(F.transform(acc, lambda one: F.transform(some, lambda x: F.concat(one, F.array(x))))))
    each = parts.select("verdict", "confidence", "bound", "support", F.explode(ways).alias("way"))
    return each.select(F.array_sort(F.col("way.token")).alias("antecedent"), "verdict", "confidence", "bound", "support", F.array_min("way")["token"].alias("first"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, default: str = "allow", labels: DataFrame | None = None, **mining) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, confidence (null where a list rule or the default decides).

    ``labels``: (url, verdict), a table of its own to mine from; without it the list's decisions are the labels (see above).
    Null urls, and urls without ://, have empty host and path, no tokens and the default verdict. Of several mined rules that
    match, the surest decides, then the one of more support, then the verdict that comes last by code point (block before
    allow). Urls of any length are judged whole, repeated ones once. Other columns aren't read; an empty table gives no rows.
    """
    url = F.col("url")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    # urls are decided once each; null is one of them
    urls = rows.groupBy("url").agg(F.count("*").alias("n")).select("url", host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = list_rule(F.col("host"), F.col("path"), rules)
    urls = materialize(urls.select("url", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens_of(F.col("host"), F.col("path"), url).alias("tokens")), "urls")
    if labels is None:
        out = F.array(*[F.lit(x) for x in named_by(rules)]).cast("array<string>")
        found = mine_groups(urls.select(F.array_except("tokens", out).alias("tokens"), F.col("listed").alias("verdict")), **mining)
    else:
        given = labels.select(F.col("url").alias("url"), "verdict")
        found = mine_groups(given.select(tokens_of(host_of(url), path_of(url), url).alias("tokens"), "verdict"), **mining)
    if found is None:
        none = "antecedent array<string>, verdict string, confidence double, support double, first string"
        found = df.sparkSession.createDataFrame([], none), df.sparkSession.createDataFrame([], "token string, rep string")
    mined, members = found
    open_ = urls.where("listed is null").select("url", F.explode("tokens").alias("token")).join(members.select("token", "rep"), "token")
    open_ = open_.groupBy("url").agg(F.collect_set("rep").alias("reps")).select("url", "reps", F.explode("reps").alias("first"))
    hits = open_.join(mined, "first").where(F.size(F.array_except("antecedent", "reps")) == 0)
    best = hits.groupBy("url").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
    told = urls.select("url", "host", "path", "rule", "listed").join(best, "url", "left")
    told = told.select("url", "host", "path", "rule", F.coalesce("listed", "best.verdict", F.lit(default)).alias("verdict"), F.when(F.col("listed").isNull(), F.col("best.confidence")).alias("confidence"))
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return rows.select("id", key(url).alias("k")).join(told.select(key(url).alias("k"), "host", "path", "rule", "verdict", "confidence"), "k").drop("k")
