"""Fill-in-the-middle over ropes: a text's lines are cut at two ranks and the parts put in another order between sentinels.

A rope is a balanced tree of slices whose nodes keep the number of code points and of line ends below them. Splitting at a
rank goes down one path and shares all subtrees beside it; joining makes one node. The way back splits the tree of the
output behind its sentinels and joins the parts in their old order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Code points of a leaf.
LEAF = 4096


class Rope:
    """A leaf (``text``) or a node of two ropes, with the code points (``chars``) and line ends (``ends``) in it."""

    __slots__ = ("text", "left", "right", "chars", "ends")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if left is None:
            self.chars, self.ends = len(text), text.count("\n")
        else:
            self.chars, self.ends = left.chars + right.chars, left.ends + right.ends

    @staticmethod
    def of(text: str, leaf: int = LEAF) -> Rope:
        row = [Rope(text[i : i + leaf]) for i in range(0, len(text), leaf)] or [Rope("")]
        while len(row) > 1:
            row = [join(*row[i : i + 2]) for i in range(0, len(row), 2)]
        return row[0]

    def units(self) -> int:
        """Number of lines; what stands behind the last line end is one, too."""
        node = self
        while node.left is not None:
            node = node.right if node.right.chars else node.left
        return self.ends + (node.text != "" and node.text[-1] != "\n")

    def split(self, chars: int) -> tuple[Rope, Rope]:
        """Before and behind so many code points."""
        if self.left is None:
            return Rope(self.text[:chars]), Rope(self.text[chars:])
        if chars <= self.left.chars:
            a, b = self.left.split(chars)
            return a, join(b, self.right)
        a, b = self.right.split(chars - self.left.chars)
        return join(self.left, a), b

    def split_units(self, units: int) -> tuple[Rope, Rope]:
        """Before and behind so many lines."""
        return self.split(self.chars if units > self.ends else self._end_of(units))

    def _end_of(self, units: int) -> int:
        node, at = self, 0
        if not units:
            return 0
        while node.left is not None:
            if units <= node.left.ends:
                node = node.left
            else:
                at, units, node = at + node.left.chars, units - node.left.ends, node.right
        where = -1
        for _ in range(units):
            where = node.text.index("\n", where + 1)
        return at + where + 1

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.left is None:
                yield node.text
            else:
                todo += node.right, node.left

    def __str__(self) -> str:
        return "".join(self.leaves())


def join(*ropes: Rope) -> Rope:
    out = ropes[0]
    for r in ropes[1:]:
        out = out if not r.chars else r if not out.chars else Rope(None, out, r)
    return out


@dataclass(frozen=True)
class Plan:
    """``seed`` and a document's id decide all: form and cuts. ``rate``, ``spm``: percent of texts transformed, and of those in suffix-first order."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.marks()
        overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
        if not all(marks) or overlap or any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j):
            raise ValueError("sentinels must not be empty, hold one another or end as one of them begins: a text beside one could make up another")

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def transform_text(doc_id: int | None, text: str, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, code points of prefix and of middle, output)."""
    said = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(said[i : i + 8], 16) for i in (0, 8, 16, 24))
    rope = Rope.of(text)
    n = rope.units()
    if not text or any(m in text for m in plan.marks()) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = rope.split_units(second)
    prefix, middle = head.split_units(first)
    p, s, m = map(Rope, plan.marks())
    form = "spm" if h4 % 100 < plan.spm else "psm"
    out = join(s, suffix, p, prefix, m, middle) if form == "spm" else join(p, prefix, s, suffix, m, middle)
    return n, form, prefix.chars, middle.chars, str(out)


def restore_text(output: str, form: str, plan: Plan) -> str:
    """The text that ``output`` was made of."""
    if form == "plain":
        return output
    (one, first), (two, second) = (("p", plan.prefix), ("s", plan.suffix)) if form == "psm" else (("s", plan.suffix), ("p", plan.prefix))
    middle_at = output.rindex(plan.middle)
    second_at = output.index(second, len(first))
    if not output.startswith(first) or second_at > middle_at:
        raise ValueError(f"this is no text of form {form}")
    head, middle = Rope.of(output).split(middle_at)
    a, b = head.split(second_at)
    parts = {one: a.split(len(first))[1], two: b.split(len(second))[1], "m": middle.split(len(plan.middle))[1]}
    return str(join(parts["p"], parts["m"], parts["s"]))


def transform(df: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n (lines), form, prefix_chars, middle_chars, output.

    A null text is empty; empty texts and texts that hold a sentinel stay as they are (``plain``, null counts). A null id is
    written as nothing behind the seed. Repeated rows give the same row each. No shuffle: a text is one unit of work, of any
    length, and other columns aren't read. An empty table gives no rows.
    """
    p = plan or Plan()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _parts(b):
                done = [transform_text(i, t or "", p) for i, t in zip(ids, texts)]
                cols = list(zip(*done)) or [()] * 5
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(df: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Rows of :func:`transform` (output, form and any others but ``restored``) with the column ``restored``."""
    p = plan or Plan()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(1, b.num_rows), 256):
                part = b.slice(at, 256)
                out = [restore_text(o, f, p) for o, f in zip(part.column("output").to_pylist(), part.column("form").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "restored"])

    return df.mapInArrow(run, StructType([*df.schema, StructField("restored", StringType())]))


def _parts(b: pa.RecordBatch, most: int = 256) -> Iterator[tuple[list, list]]:
    for at in range(0, b.num_rows, most):
        part = b.slice(at, most)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()
