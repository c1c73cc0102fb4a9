"""Markdown report of a provider matrix, rendered on the driver line by line: lists of any length are never held."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

METRICS = (
    ("normalization_coverage", "normalized facts", "observed facts", "share of what a provider says that has a common meaning"),
    ("matched_coverage", "facts on matched entities", "normalized facts", "share of facts whose entities are matched"),
    ("unique_coverage", "logical facts of one provider alone", "its logical facts", "what would be missing without it"),
    ("overlap_coverage", "exact facts of both", "the fewer exact facts of the two", "agreement of two providers"),
    ("all_overlap_coverage", "exact facts of every provider", "exact facts of any", "agreement of all providers"),
    ("gain_coverage", "exact facts new to the providers before", "exact facts of the provider", "what it adds in this order"),
    ("conflict_count", "logical facts with several values", "-", "differences that are kept, not settled"),
)


def escape(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def label(provider) -> str:
    return f"{provider['id']}@{provider['version']}"


def ratio(n: int, d: int) -> str:
    """Three decimals, halves away from zero on the binary value; ``n/d (n/a)`` on a zero denominator."""
    return f"{n}/{d} (n/a)" if d == 0 else f"{n}/{d} ({Decimal(n / d).quantize(Decimal('0.001'), ROUND_HALF_UP)})"


def _table(head: tuple[str, ...], rows: Iterable) -> Iterator[str]:
    yield "| " + " | ".join(head) + " |"
    yield "|" + " --- |" * len(head)
    for r in rows:
        yield "| " + " | ".join(escape(c) for c in r) + " |"
    yield ""


def _list(items: Iterable[str]) -> Iterator[str]:
    n = 0
    for x in items:
        n += 1
        yield f"- {escape(x)}"
    if not n:
        yield "Nothing."
    yield ""


def _variant(v) -> str:
    return f"{', '.join(label(p) for p in v['providers'])} => {v['exact_key']}"


def lines(repositories: Iterable, coverage: list, pairs: list, everyone: list, gain: list, conflicts: Iterable, counts: dict[str, int]) -> Iterator[str]:
    """``coverage``, ``pairs``, ``everyone`` and ``gain`` are rows of views whose number doesn't grow with the facts.

    ``repositories`` and ``conflicts`` (key, fact_class, variants) may be iterators; all that they give is listed.
    """
    yield from ("# Provider comparison", "", "Counted by fixed rules from the stored facts.", "", "## Revisions", "")
    yield from _list(f"{r['source']} @ `{r['commitSha']}`" for r in repositories)
    yield from ("## Metrics", "", *_table(("Metric", "Numerator", "Denominator", "Meaning"), METRICS))
    total, by_class = ([r for r in coverage if (r.fact_class == "__all__") == whole] for whole in (True, False))
    yield from ("## Coverage", "")
    yield from _table(("Provider", "Raw", "Normalized", "Unsupported", "Normalization", "Correlated", "Ambiguous", "Unmatched"), (
        (label(r.provider), r.raw, r.normalized, r.unsupported, ratio(r.normalized, r.raw), ratio(r.correlated, r.normalized), r.ambiguous, r.unmatched) for r in total))
    yield from ("### By fact class", "")
    yield from _table(("Provider", "Class", "Raw", "Normalized", "Unsupported", "Correlated", "Unique", "Unique share"), (
        (label(r.provider), r.fact_class, r.raw, r.normalized, r.unsupported, ratio(r.correlated, r.normalized), r.unique, ratio(r.unique, r.comparable)) for r in by_class))
    yield from ("## Information gain", "", "Unique: a comparable logical fact that one provider alone has. It says nothing about quality.", "")
    yield from _table(("Provider", "Before it", "New", "Gain", "Unique", "Ambiguous", "Unmatched", "Unsupported"), (
        (label(r.provider), ", ".join(map(label, r.existing)) or "none", r.new_facts, ratio(r.new_facts, r.own_facts), r.unique, r.ambiguous, r.unmatched, r.unsupported) for r in gain))
    yield from ("## Overlap", "", f"Rows in agreement: {counts.get('overlap', 0)}", f"Rows in conflict: {counts.get('conflict', 0)}", "")
    yield from _table(("Left", "Right", "Class", "Compared", "Overlap", "Left only", "Right only", "Conflicts", "Coverage"), (
        (label(r.left), label(r.right), r.fact_class, r.compared, r.overlap, r.left_only, r.right_only, r.conflicts, ratio(r.overlap, min(r.left_count, r.right_count))) for r in pairs))
    yield from ("### All providers", "", *_table(("Class", "Overlap"), ((r.fact_class, ratio(r.overlap, r.union_count)) for r in everyone)))
    yield from ("### What one provider alone has", "")
    yield from _list(f"{label(r.provider)} / {r.fact_class}: {r.unique}" for r in by_class if r.unique)
    yield from ("## Conflicts", "")
    yield from _list(f"{c['fact_class']} {c['key']}: {'; '.join(_variant(v) for v in c['variants'])}" for c in conflicts)
    yield from ("## What can't be compared", "")
    yield from _list(f"{k}: {counts.get(k, 0)}" for k in ("ambiguous", "unmatched", "unsupported"))
