"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints at distance 4 or less are at distance 2 or less in one
segment, and then the Hamming balls of radius 1 around both segment values meet. So every distinct fingerprint enters a
table under the 33 values of the ball around each of its segments; rows that meet under a value are candidates, and their
complete distance is verified. Rows in a table grow with the number of distinct fingerprints only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, materialize, settle
from .graph import connected_components

MAX_DISTANCE = 4
#: A bucket with more fingerprints is dealt out as pairs of tiles of about this size.
TILE = 1024


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of lower-cased word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1])
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65536):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + 65536].tolist(), ends[shingle - 1 :][at : at + 65536].tolist())], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, digest: bool = False) -> DataFrame:
    """(id, fp), or (id, fp, digest of the text), for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])
        settle()

    also = [F.xxhash64(F.col(f"`{text_col}`")).alias("digest")] if digest else []
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *also)
    return rows.mapInArrow(run, "id long, fp long, digest long" if digest else "id long, fp long")


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among some fingerprints: breadth first, so that each meets only those not yet reached."""
    left, right = [], []
    rest = np.unique(fps.view(np.uint64))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            found = np.full(len(rest), -1)
            for at in range(0, len(front), 256):
                open_ = np.flatnonzero(found < 0)
                near = np.bitwise_count(front[at : at + 256, None] ^ rest[None, open_]) <= MAX_DISTANCE
                hit = near.any(axis=0)
                found[open_[hit]] = at + near[:, hit].argmax(axis=0)
            got = found >= 0
            left.append(front[found[got]])
            right.append(rest[got])
            front, rest = rest[got], rest[~got]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def _bucket_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, fp) sorted by bucket and tile pair to links; holds one tile pair at a time."""
    lean()
    held: list[np.ndarray] = []
    at, u, v, n = None, [], [], 0

    def close() -> None:
        nonlocal held, n
        if held:
            a, b = forest(np.concatenate(held))
            u.append(a), v.append(b)
            n += len(a)
        held = []

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(4)]
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
        for s, e in zip([0, *cut], [*cut, batch.num_rows]):
            key = (cols[0][s], cols[1][s], cols[2][s])
            if key != at:
                close()
                at = key
            held.append(cols[3][s:e])
        if n > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
            u, v, n = [], [], 0
    close()
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``nodes.fp`` at distance 4 or less, without all pairs of a group.

    Every two linked fingerprints meet in some bucket and end in one component of that bucket's links. Buckets of two are
    verified by an aggregate of fixed size; larger ones as spanning forests of tile pairs, a hot bucket in many tasks.
    """
    # few bytes a row here, many rows after the balls are enumerated: deal them out first
    nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    keys = nodes.select("fp", F.explode(F.concat(
        F.transform(masks, lambda m: high.bitwiseXOR(m)), F.transform(masks, lambda m: low.bitwiseXOR(m) + F.lit(1 << 32)))).alias("bucket"))
    met = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    met = materialize(met, "buckets")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE
    pairs = met.where((F.col("n") == 2) & close).select("u", "v").distinct()
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    rows = keys.join(met.where("n > 2").select("bucket", "n"), "bucket").select("bucket", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return pairs.union(rows.mapInArrow(_bucket_forests, "u long, v long").distinct())


def _rooted(nodes: DataFrame) -> DataFrame:
    """``nodes``, one row per fingerprint fp, with the smallest fingerprint of their component as root."""
    nodes = materialize(nodes, "nodes")
    found = connected_components(links(nodes))
    return nodes.join(found, nodes.fp == found.node, "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row (id, fp, component) per input row; component is the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id are kept; they never name a
    component unless it has no other id (then it is null). Repeated rows share a fingerprint and a component. Other
    columns are not read, so their names can't clash. An empty table gives no rows.
    """
    docs = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    named = _rooted(docs.groupBy("fp").agg(F.min("id").alias("least")))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return docs.join(named, "fp").select("id", "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``df`` with one row of each component: the one that has the smallest id, or no id where none has one.

    Components are told by their root, so rows without an id, and different texts under one id, are judged by their own
    components. Of a component's rows with the smallest id, the one with the smallest text digest stays, once if it is
    repeated. Repeats are dropped before and after the one shuffle of the texts, so that none of them is a hot key.
    """
    docs = materialize(fingerprints(df, id_col, text_col, shingle, True), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.coalesce("id", F.lit(0).cast("long")).alias("k"), F.col("digest").alias("d")))
    named = _rooted(docs.groupBy("fp").agg(first.alias("first")))
    # inner columns that no column of the table is named like
    names = [free_name(df, n) for n in ("no_id", "id_or_0", "text_digest")]
    found = named.groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{x}").alias(n) for x, n in zip("zkd", names)])
    key = F.col(f"`{id_col}`").cast("long")
    keyed = df.withColumns(dict(zip(names, (key.isNull(), F.coalesce(key, F.lit(0).cast("long")), F.xxhash64(F.col(f"`{text_col}`"))))))
    kept = keyed.dropDuplicates(names).join(found, names, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
