"""Scratch tables, memory of Python workers and small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, scratch_path

__all__ = ["WORD", "discard", "free_name", "lean", "materialize", "n_words", "row_key", "scratch_path", "settle", "table"]

#: The white space that separates words wherever a contract speaks of words: space and TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_settled = False


def lean() -> None:
    """Called at the start of a task in a Python worker: its allocator keeps arrays of up to 8 MB for the next ones, and no larger.

    Left alone it raises this limit to 32 MB by itself, and a worker holds far more than it uses; with a low limit each
    array of a numerical loop is fetched from the system anew. :func:`settle` gives back what is kept.
    """
    global _settled
    if not _settled:
        _settled = True
        try:
            c = ctypes.CDLL(None)
            c.mallopt(-3, 1 << 23)  # M_MMAP_THRESHOLD
            c.mallopt(-1, 1 << 25)  # M_TRIM_THRESHOLD
        except (AttributeError, OSError):  # another C library: it has ways of its own
            pass


def settle() -> None:
    """Called at the end of a task in a Python worker: what it no longer uses goes back to the system."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def n_words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*cols: Column) -> Column:
    """Digest that tells rows apart by the given columns; nulls differ from empty strings."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols]).cast("binary"))
