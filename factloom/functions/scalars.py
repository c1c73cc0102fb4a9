"""Scalar functions over columns: paths, ranges, kinds, symbols, signatures, keys. All stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PREDICATES, RANGE

_BLANK = r"[\s ﻿  -     　]"


#: The same characters, listed.
_BLANKS = "".join(x for x in map(chr, range(0x10000)) if re.match(_BLANK, x, re.ASCII))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x worked out once for a row, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def trim(c: Column) -> Column:
    """Trim all Unicode white space, as well as the byte-order mark."""
    return F.btrim(c, F.lit(_BLANKS))


def clean(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def normalize_path(c: Column) -> Column:
    """Separators to /, ``.`` and empty parts dropped, ``..`` takes the part before; nothing left: ``.``."""
    text = trim(c)
    # most paths have nothing to normalize
    plain = ~text.rlike(r"\\|(^|/)\.{0,2}(/|$)")
    parts = F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/")
    none = F.array().cast("array<string>")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    return F.when(plain, text).when(c.isNotNull(), F.coalesce(F.nullif(F.array_join(F.aggregate(parts, none, step), "/"), F.lit("")), F.lit(".")))


def make_range(start_line: Column, start_column: Column, end_line: Column, end_column: Column, zero_based: Column) -> Column:
    """One-based range; null if it ends before it starts."""
    shift = F.when(zero_based, 1).otherwise(0)
    sl, sc, el, ec = (c.cast("long") + shift for c in (start_line, start_column, end_line, end_column))
    wrong = (sl > el) | ((sl == el) & F.coalesce(sc > ec, F.lit(False)))
    return F.when(sl.isNotNull() & el.isNotNull() & ~wrong, F.struct(sl.alias("startLine"), sc.alias("startColumn"), el.alias("endLine"), ec.alias("endColumn"))).cast(RANGE)


def zero_based(provider_id: Column, base: Column | None = None) -> Column:
    own = F.coalesce(provider_id, F.lit("")).isin("scip-typescript", "scip")
    return own if base is None else F.coalesce(base == "zero-based", own)


def parse_span(span: Column, provider_id: Column, base: Column | None = None) -> Column:
    """``L1C2-L3C4`` (always one-based) or ``1:2-3:4`` (by base) to a range; null for anything else."""
    return let(trim(span), lambda text: _span(text, zero_based(provider_id, base)))


def _span(text: Column, from_zero: Column) -> Column:
    # The two forms of a span.
    labelled = r"(?i)^L(\d+)(?:C(\d+))?(?:-L?(\d+)(?:C(\d+))?)?$"
    numeric = r"^(\d+):(\d+)-(\d+):(\d+)$"
    # a pattern is matched once for all its parts; what may stand behind $, a line's end, goes with the rest
    parts = lambda pattern, f: let(F.split(F.regexp_replace(text, pattern + r"[\s\S]*", "$1,$2,$3,$4"), ","), lambda a: f(*[F.nullif(F.get(a, F.lit(i)), F.lit("")) for i in range(4)]))
    first = parts(labelled, lambda a, b, c, d: make_range(a, b, F.coalesce(c, a), d, F.lit(False)))
    second = parts(numeric, lambda a, b, c, d: make_range(a, b, c, d, from_zero))
    return F.when(text.rlike(labelled), first).when(text.rlike(numeric), second)


def packed_range(numbers: Column, provider_id: Column, base: Column | None = None) -> Column:
    """Three or four non-negative integers to a range."""
    n, at = F.size(numbers), lambda i: F.get(numbers, F.lit(i))
    ok = n.isin(3, 4) & ~F.exists(numbers, lambda x: x.isNull() | (x < 0))
    return F.when(ok, make_range(at(0), at(1), F.when(n == 3, at(0)).otherwise(at(2)), F.when(n == 3, at(2)).otherwise(at(3)), zero_based(provider_id, base)))


def given_range(r: Column) -> Column:
    """A range object, if its lines (and columns, where there are any) are 1 or more."""
    low = lambda c: F.coalesce(c < 1, F.lit(False))
    return F.when((r.startLine >= 1) & (r.endLine >= 1) & ~low(r.startColumn) & ~low(r.endColumn), r)


# The first family whose pattern a kind matches.
KINDS = (
    ("callable", "function|method|callable"),
    ("class", "class|constructor"),
    ("interface", "interface"),
    ("type", "typealias|typedef|type"),
    ("enum", "enum"),
    ("variable", "variable|constant|const"),
    ("property", "property|field|member"),
    ("module", "module|file|sourcefile"),
    ("symbol", "symbol|declaration|unknown"),
)


def kind_family(kind: Column) -> Column:
    k = F.regexp_replace(F.lower(kind), r"[\s_-]", "")
    families = reduce(lambda acc, x: acc.when(k.rlike(x[1]), x[0]), KINDS[1:], F.when(k.rlike(KINDS[0][1]), KINDS[0][0]))
    return families.otherwise(F.when(k == "", "symbol").otherwise(k))


def canonical_kind(kinds: Column) -> Column:
    """The only family beside ``symbol``, or the only one; else ``symbol``."""
    one = F.array_remove(F.array_distinct(kinds), "symbol")
    return F.when(F.size(one) == 1, F.get(one, F.lit(0))).otherwise("symbol")


def kinds_agree(a: Column, b: Column) -> Column:
    return (a == b) | (a == "symbol") | (b == "symbol")


def normalize_signature(c: Column) -> Column:
    # White space, and the marks around which it is dropped.
    return F.regexp_replace(F.regexp_replace(trim(c), r"\s+", " "), r"\s*([(),:;<>\[\]{}|&=])\s*", "$1")


def symbol_keys(c: Column) -> Column:
    """The unquoted symbol, then its distinct tokens of letters, digits, _ and $, in order."""
    # Quotes, and what separates tokens.
    tokens = lambda q: F.regexp_extract_all(q, F.lit("[A-Za-z0-9_$]+"), F.lit(0))
    return let(F.translate(trim(c), "\"'", ""), lambda q: F.when(q == "", F.array().cast("array<string>")).when(q.isNotNull(), F.array_distinct(F.concat(F.array(q), tokens(q)))))


def last_symbol_part(c: Column) -> Column:
    return F.element_at(F.nullif(symbol_keys(c), F.array().cast("array<string>")), -1)


def intersects(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def same_range(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & a.eqNullSafe(b)


def ratio(n: Column, d: Column) -> Column:
    """Null on a zero denominator."""
    return (n / F.nullif(d.cast("double"), F.lit(0.0))).cast("double")


def digest(*cols: Column) -> Column:
    """SHA-256 of a canonical serialisation that keeps nulls apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def short_digest(*cols: Column) -> Column:
    """MD5 of the same serialisation as 16 bytes: what rows of one run meet by."""
    return F.unhex(F.md5(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})))


def is_common(predicate: Column) -> Column:
    return predicate.isin(*PREDICATES)


def correlation_status(subject: Column, object_: Column) -> Column:
    """Of a fact, from the statuses of its subject and its object (null: a value)."""
    any_ = lambda s: (subject == s) | F.coalesce(object_ == s, F.lit(False))
    both = (subject == "matched") & (F.coalesce(object_, F.lit("matched")) == "matched")
    return F.when(any_("ambiguous"), "ambiguous").when(any_("unmatched") | subject.isNull(), "unmatched").when(both, "matched").otherwise("probable")
