"""Texts as sequences of 32-bit word hashes, and sums of binary blocks over partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, settle
from .textnp import word_hashes


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode()


def hashed_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words) for every row, written once: lower-cased words of letters and digits as little-endian 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < b.num_rows:  # a few MB of text at a time
                part: list[bytes] = []
                held = 0
                while at + len(part) < b.num_rows and held < 1 << 21:
                    part.append(normal(texts[at + len(part)].as_py()))
                    held += len(part[-1])
                words = pa.array([w.astype("<u4").tobytes() for w in word_hashes(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), words], ["id", "words"])
                at += len(part)
        settle()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(rows.mapInArrow(run, "id long, words binary"), "words")


def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 17) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Rows (id, words) in groups of about ``most`` words; one text is never split."""
    ids: list[int | None] = []
    words: list[np.ndarray] = []
    held = 0
    for b in batches:
        for i, w in zip(b.column(0), b.column(1)):
            a = np.frombuffer(w.as_buffer() if w.is_valid else b"", "<u4")
            if words and held + len(a) > most:
                yield ids, words
                ids, words, held = [], [], 0
            ids.append(i.as_py())
            words.append(a)
            held += len(a)
    if words:
        yield ids, words


def sum_blocks(parts: DataFrame, kind: str, n_parts: int) -> list[tuple[int, bytes]]:
    """(part int, block int, data binary) summed by block, as doubles, in order of part.

    Sums are made in two steps, of about the root of ``n_parts`` each, so that no task gets the blocks of all parts. The
    number of blocks and their size are fixed by the caller's parameters; so is what comes to the driver.
    """
    groups = max(1, round(n_parts**0.5))

    def add(kind: str):
        def run(table: pa.Table) -> pa.Table:
            lean()
            table, total = table.sort_by("part"), None
            for x in table.column("data"):
                a = np.frombuffer(x.as_buffer(), kind)
                if total is None:
                    total = a.astype(np.float64)
                else:
                    total += a
            return pa.table({"part": pa.array([table.column("part")[0].as_py() % groups], pa.int32()), "block": table.column("block").slice(0, 1).cast(pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

        return run

    schema = "part int, block int, data binary"
    some = parts.groupBy((F.col("part") % groups).alias("group"), "block").applyInArrow(add(kind), schema)
    return sorted((r.block, bytes(r.data)) for r in some.groupBy("block").applyInArrow(add("<f8"), schema).collect())
