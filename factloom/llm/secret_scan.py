"""Secret scans in SQL functions alone, judged by corpus-wide ownership.

Three kinds of base spans (assign, access, hex) are found by fixed patterns. The method adds spans of kind ``owned``:
long mixed tokens outside the base spans whose digest few owners have in the whole corpus. A digest that many owners
share is a copied example, and so is one that a large part of its owners' repositories hold, like a line of a site's template.
Copies of one text are one repository, so a live value doesn't become an example by being copied. Base spans are judged in
the same way, but always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key

#: kind -> (pattern, group that holds the value, fewest characters of the value)
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Same result as the plain pattern (a run of a class is matched whole, and a shorter one fails), fewer matches to drop.
FAST = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: What the method looks at beside the base kinds: tokens of 20 characters and more with a digit and a letter.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: A value that more owners have is a copied example; so is one in more than so many repositories, if they are more than
#: this share of all repositories of its owners.
MAX_OWNERS, MAX_REPOS, MAX_SHARE = 2, 8, 0.01
#: Matches whose offsets are summed up in one go; the sums of these groups are summed up again, so that work grows with the matches.
GROUP = 256


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of the leftmost non-overlapping matches; offsets in code points.

    Matches and the gaps between them come from the same pattern, so running lengths give the offsets.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.zip_with(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), values, lambda s, v: F.struct(s.g.alias("g"), s.m.alias("m"), v.alias("v")))
    kind_of = "array<struct<start:bigint,kind:string,end:bigint,value:string>>"
    empty = F.array().cast(kind_of)
    first = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start, end = acc.at + s.g, acc.at + s.g + s.m
        one = F.array(F.struct(start.cast("long").alias("start"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), s.v.alias("value")))
        return F.struct(end.cast("long").alias("at"), F.when(F.length(s.v) >= least, F.concat(acc.out, one)).otherwise(acc.out).alias("out"))

    def groups(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), lambda c: F.aggregate(F.slice(all_, c * GROUP + 1, F.lit(GROUP)), first, step))

    def shifted(parts: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        starts = F.aggregate(parts, none, lambda acc, c: F.struct((acc.at + c.at).alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out")), lambda acc: acc.out)
        move = lambda x, by: F.struct((x.start + by).alias("start"), x.kind.alias("kind"), (x.end + by).alias("end"), x.value.alias("value"))
        return F.flatten(F.zip_with(parts, starts, lambda c, by: F.transform(c.out, lambda x: move(x, by)))).cast(kind_of)

    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return F.when(text.rlike(pattern), once(steps, lambda all_: once(groups(all_), shifted))).otherwise(empty)


def _outside(tokens: Column, base: Column) -> Column:
    """Tokens that no base span overlaps.

    Tokens are in order, so those of one group lie between its first and its last one's ends, and only base spans there are
    compared with them. Groups have the square root of all, which keeps work well below the product of the two numbers.
    """
    overlaps = lambda a, b: (a.start < b.end) & (b.start < a.end)
    most = F.ceil(F.sqrt(F.size(tokens))).cast("int")

    # what a lambda variable holds is worked out once, an expression wherever it stands
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def group(c: Column) -> Column:
        ends = lambda part: F.struct(F.get(part, F.lit(0)).start.alias("start"), F.element_at(part, -1).end.alias("end"))
        near = lambda part: once(ends(part), lambda e: F.filter(base, lambda b: overlaps(b, e)))
        return once(F.slice(tokens, c * most + 1, most), lambda part: once(near(part), lambda n: F.filter(part, lambda t: ~F.exists(n, lambda b: overlaps(b, t)))))

    groups = F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / most).cast("int"))
    return F.when(F.size(tokens) > 0, F.flatten(F.transform(groups, group))).otherwise(tokens)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda k: F.when(k == "assign", 0).when(k == "access", 1).when(k == "hex", 2).otherwise(3)
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), rank(s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind"), s.value.alias("value")))
    return F.array_sort(keyed)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base (spans), added (spans with owners), n_live, n_example.

    ``repo_col``: what tells repositories of an owner apart; without it each distinct text is one. Null and empty texts have
    no spans. A null repository or owner counts as one of its own. Texts of any length are scanned whole. Repeated rows get
    equal results. Only the named columns are read. The texts are read once and never shuffled: what crosses the network
    is one row per distinct (digest, owner, repository), counted before the shuffle, and one row per document.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    repo = F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("\x00")) if repo_col else F.xxhash64(text).cast("string")
    base = [_spans(text, k, FAST.get(k, p), g, n) for k, (p, g, n) in BASE.items()]
    tokens = _spans(text, "owned", TOKEN, 0, 20)
    docs = df.select(
        F.col(f"`{id_col}`").alias("id"), repo.alias("repo"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("\x00")).alias("owner"),
        *[b.alias(k) for b, k in zip(base, BASE)], tokens.alias("tokens"))
    digest = lambda s: F.struct(s.start, s.kind, s.end, F.sha2(s.value, 256).alias("value"))
    docs = docs.withColumn("base", F.concat(*BASE))
    docs = docs.withColumn("tokens", F.filter("tokens", lambda t: t.value.rlike("[A-Za-z]")))
    docs = docs.withColumn("tokens", _outside(F.col("tokens"), F.col("base")))
    docs = docs.select("id", "repo", "owner", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.transform("base", digest).alias("base"), F.transform("tokens", digest).alias("tokens"))
    # a row's key: documents with equal id, owner, repository and spans have equal results
    spans = F.concat("base", "tokens")
    docs = materialize(docs.withColumn("key", row_key(F.col("id"), F.col("repo"), F.col("owner"), F.to_json(spans))), "spans")
    each = docs.where(F.size(spans) > 0).select("key", "repo", "owner", F.explode(spans).alias("s"))
    each = each.select("key", "repo", "owner", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"))
    held = each.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(F.count("*").alias("repos"))
    owned = docs.groupBy("owner", "repo").agg(F.lit(1).alias("one")).groupBy("owner").agg(F.count("*").alias("all"))
    held = held.join(owned, "owner").groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("all").alias("n_all"))
    live = (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repos") <= F.greatest(F.lit(float(MAX_REPOS)), MAX_SHARE * F.col("n_all")))
    judged = each.select("key", "start", "kind", "end", "value").distinct().join(held, "value").withColumn("live", live)
    by_key = judged.groupBy("key").agg(
        F.collect_list(F.when((F.col("kind") == "owned") & F.col("live"), F.struct("start", "kind", "end", "value"))).alias("added"),
        F.count_if("live").alias("n_live"), F.count_if((F.col("kind") != "owned") & ~F.col("live")).alias("n_example"))
    out = docs.join(by_key, "key", "left")
    none = F.array().cast("array<struct<start:bigint,kind:string,end:bigint,value:string>>")
    return out.select("id", *[f"n_{k}" for k in BASE], "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def digest_rows(found: DataFrame) -> DataFrame:
    """The digest columns of a scan's rows."""
    return found.select(
        F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(_joined(_ordered(F.col("base"))), 256).alias("base_sha256"),
        _joined(_ordered(F.concat("base", "added"))).alias("spans"), "n_live", "n_example")
