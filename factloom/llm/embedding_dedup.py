"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with one scale each. With x = sx*qx + ex and y = sy*qy + ey the product of the
quantised parts differs from the cosine by at most |ex| + |sx*qx| * |ey|, both norms being measured for each vector.
Pairs whose upper bound stays below the threshold are done; the others are computed again in double precision.

Copies of a vector are one class with a count. The classes of a large label are dealt to their nearest pivots. A class is
compared within its own cell, and visits those of the later cells that can hold a partner: with r the largest angle of a
cell's members to its pivot, and t the angle of the threshold, a class whose angle to the pivot is above r + t has none
there (angles obey the triangle inequality). Members and visitors of a cell are cut into tiles of bounded size, and each pair
of tiles is one group: its task returns a count of links for each class and edges that connect what is linked, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize
from .graph import connected_components

TILE = 2048
#: Dimensions whose products of int8 codes are summed exactly in float32 (127 * 127 * 1024 < 2**24); blocks add up as doubles.
DIMENSIONS = 1024
#: Rounding of the double sums and norms that make the bound.
SLACK = 1e-9
#: So many labels, the largest, have pivots; other labels are one cell. A label has one pivot for half a tile, up to PIVOTS or to the
#: square root of its size, whichever is more, and all pivots together PIVOT_FLOATS numbers, shared out by the labels' sizes.
PIVOTED, PIVOTS, PIVOT_FLOATS = 256, 128, 4_000_000
#: Angles, of rows to pivots, that are held at once.
ANGLES = 1 << 21
#: Rounding of angles.
ANGLE_SLACK = 1e-6


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as doubles, times the power of two that brings the largest component near 1: squares can't over- or underflow."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors to int8 codes, scales, norms of the quantised parts and norms of the errors."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127.0
    code = np.rint(x / scale).astype(np.int8)
    part = code * scale
    return code, scale[:, 0], np.linalg.norm(part, axis=1), np.linalg.norm(x - part, axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a, b) with cosine >= threshold, a block of rows at a time; ``same``: only a < b."""
    lx, rx = scaled(left), scaled(right)
    ln, rn = np.linalg.norm(lx, axis=1), np.linalg.norm(rx, axis=1)
    qa, sa, pa_, ea = quantise(lx / ln[:, None])
    qb, sb, _, eb = quantise(rx / rn[:, None])
    parts = [(slice(k, k + DIMENSIONS), qb[:, k : k + DIMENSIONS].T.astype(np.float32)) for k in range(0, lx.shape[1], DIMENSIONS)]
    for at in range(0, len(lx), 256):
        to = min(len(lx), at + 256)
        product = sum((qa[at:to, k].astype(np.float32) @ q).astype(np.float64) for k, q in parts)
        approx = product * sa[at:to, None] * sb[None]
        bound = approx + ea[at:to, None] + pa_[at:to, None] * eb[None] + SLACK
        a, b = np.nonzero(bound >= threshold)
        a += at
        if same:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 65536):
            i, j = a[k : k + 65536], b[k : k + 65536]
            sure = np.einsum("ij,ij->i", lx[i], rx[j]) / (ln[i] * rn[j]) >= threshold
            if sure.any():
                yield i[sure], j[sure]


def connect(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``root`` (place to the smallest place known to be connected to it) after the links (p, q)."""
    while True:
        a, b = root[p], root[q]
        open_ = a != b
        if not open_.any():
            return root
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _tile_task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        lean()
        i, j, kind = (table.column(k)[0].as_py() for k in ("i", "j", "kind"))
        tile, visitor = np.asarray(table.column("tile")), np.asarray(table.column("visitor"))
        ids, count = np.asarray(table.column("cls")), np.asarray(table.column("n"))
        vec = table.column("vec").combine_chunks()
        x = np.asarray(vec.flatten()).reshape(len(ids), -1)
        same = kind == 0 and i == j
        a = np.flatnonzero((tile == i) & ~visitor)
        b = a if same else np.flatnonzero((tile == j) & (visitor if kind else ~visitor))
        got, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(a) and len(b):
            for p, q in tile_links(x[a], x[b], threshold, same):
                p, q = a[p], b[q]
                got += np.bincount(p, count[q], len(ids)).astype(np.int64) + np.bincount(q, count[p], len(ids)).astype(np.int64)
                root = connect(root, p, q)
        some, below = np.flatnonzero(got), np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({
            "u": pa.array(np.concatenate([ids[some], ids[below]]), pa.int64()),
            "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[root[below]], pa.int64())]),
            "n": pa.array(np.concatenate([got[some], np.zeros(len(below), np.int64)]), pa.int64())})

    return run


def pivot_count(n: int, dim: int, total: int) -> int:
    """Pivots of a label with ``n`` classes of ``dim`` numbers, where the labels that have pivots hold ``total`` classes."""
    return min(max(PIVOTS, math.isqrt(n)), -(-2 * n // TILE), max(1, PIVOT_FLOATS * n // total // dim))


def pivots(classes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """(label, dimension) to unit pivots: random classes of the largest labels. How many there are is bounded by parameters."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > TILE).orderBy(F.desc("n"), "label", "dim").limit(PIVOTED).collect()
    if not sizes:
        return {}
    total = sum(r.n for r in sizes)
    k = {(r.label, r.dim): pivot_count(r.n, r.dim, total) for r in sizes}
    # digests are uniform: a bound on them leaves a few more classes than are wanted
    upto = [(r.label, r.dim, float((k[r.label, r.dim] + 4 * k[r.label, r.dim] ** 0.5 + 4) / r.n * 2.0**63)) for r in sizes]
    limit = classes.sparkSession.createDataFrame(upto, "label string, dim int, upto double")
    h = F.shiftrightunsigned(F.xxhash64("cls", F.lit(11)), 1)
    found = classes.join(F.broadcast(limit), ["label", "dim"]).where(h <= F.col("upto")).select("label", "dim", h.alias("h"), "vec").collect()
    by: dict[tuple[str, int], list] = {}
    for r in sorted(found, key=lambda r: r.h):
        if len(by.setdefault((r.label, r.dim), [])) < k[r.label, r.dim]:
            by[r.label, r.dim].append(r.vec)
    return {key: unit(np.array(v)) for key, v in by.items()}


def _angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(x) @ p.T, -1, 1))


def _groups(batch: pa.RecordBatch, centres: dict[tuple[str, int], np.ndarray]) -> Iterator[tuple[tuple[str, int], np.ndarray, np.ndarray]]:
    """((label, dimension), rows, vectors) of a batch with columns label, dim and vec, so many rows at once as ANGLES allows."""
    keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist()))
    for key in dict.fromkeys(keys):
        all_, most = np.array([n for n, k in enumerate(keys) if k == key]), max(1, ANGLES // len(centres[key]))
        for at in range(0, len(all_), most):
            rows = all_[at : at + most]
            yield key, rows, np.asarray(batch.column("vec").take(pa.array(rows)).flatten()).reshape(len(rows), -1)


def dealt(classes: DataFrame, threshold: float) -> DataFrame:
    """(label, dim, cell, visitor, cls, n, vec): every class in its own cell, and as a visitor in later cells."""
    spark, centres = classes.sparkSession, pivots(classes)
    if not centres:
        return classes.select("label", "dim", F.lit(0).alias("cell"), F.lit(False).alias("visitor"), "cls", "n", "vec")
    shared, reach = spark.sparkContext.broadcast(centres), math.acos(threshold) + ANGLE_SLACK

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        most: dict[tuple, float] = {}
        for b in batches:
            for key, _, x in _groups(b, shared.value):
                angle = _angles(x, shared.value[key])
                home = angle.argmin(axis=1)
                for c in np.unique(home).tolist():
                    most[(*key, c)] = max(most.get((*key, c), 0.0), float(angle[home == c, c].max()))
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([k[n] for k in most], t) for n, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array(list(most.values()))], ["label", "dim", "cell", "r"])

    large = F.struct("label", "dim").isin([F.struct(F.lit(lab), F.lit(d)) for lab, d in centres])
    found = classes.where(large).select("label", "dim", "vec").mapInArrow(widths, "label string, dim int, cell int, r double").groupBy("label", "dim", "cell").agg(F.max("r").alias("r"))
    width = {key: np.full(len(p), -10.0) for key, p in centres.items()}  # nobody visits an empty cell
    for r in found.collect():  # one row per pivot
        width[r.label, r.dim][r.cell] = r.r

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for key, rows, x in _groups(b, shared.value):
                angle = _angles(x, shared.value[key])
                home = angle.argmin(axis=1)
                own = np.arange(len(rows))
                who, cell = np.nonzero((angle <= width[key] + reach) & (np.arange(angle.shape[1]) > home[:, None]))
                who, cell, visitor = np.concatenate([own, who]), np.concatenate([home, cell]), np.repeat([False, True], [len(own), len(who)])
                for k in range(0, len(who), 4096):
                    s = slice(k, k + 4096)
                    part = b.take(pa.array(rows[who[s]]))
                    yield pa.RecordBatch.from_arrays([part.column("label"), part.column("dim"), pa.array(cell[s].astype(np.int32)), pa.array(visitor[s]), part.column("cls"), part.column("n"), part.column("vec")], ["label", "dim", "cell", "visitor", "cls", "n", "vec"])

    kind = dict(classes.dtypes)["vec"]
    moved = classes.where(large).select("label", "dim", "cls", "n", "vec").mapInArrow(visits, f"label string, dim int, cell int, visitor boolean, cls long, n long, vec {kind}")
    return moved.unionByName(classes.where(~large).select("label", "dim", F.lit(0).alias("cell"), F.lit(False).alias("visitor"), "cls", "n", "vec"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row (id, n_links, component) per input row.

    Vectors are compared only under equal labels that aren't null, and only with vectors of the same dimension. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing: they
    have n_links 0 and their own id as component. Repeated vectors link with each other; rows that repeat an id count as
    rows of their own. Rows with a null id are kept and never name a component that has another id. An empty table gives
    no rows; other columns aren't read. Components of any finite size are compared, whatever their scale, and vectors of any
    dimension.
    """
    vec, bad = F.col("vec"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    single = df.select(F.col(f"`{vec_col}`")).dtypes[0][1] == "array<float>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<float>" if single else "array<double>").alias("vec"), F.col(f"`{label_col}`").cast("string").alias("label"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0.0), F.lit(False))
    rows = rows.select("id", F.when(usable, F.col("label")).alias("label"), F.when(usable, F.transform(vec, lambda x: (x + F.lit(0.0)).cast("float" if single else "double"))).alias("vec"), F.monotonically_increasing_id().alias("at"))
    # two digests tell vectors apart where rows meet their class; a class is named by the number of one of its rows
    rows = materialize(rows.withColumns({"h": F.xxhash64("label", "vec"), "g": F.xxhash64(F.lit(5), "vec", "label")}), "vectors")
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("at").alias("cls"), F.count("*").alias("n"), F.min("id").alias("least"), F.first("h").alias("h"), F.first("g").alias("g"))
    classes = materialize(classes.withColumn("dim", F.size("vec")), "classes")
    cells = materialize(dealt(classes, threshold), "cells")
    tiles_of = lambda n: F.ceil(n / TILE).cast("int")
    sizes = cells.groupBy("label", "dim", "cell").agg(tiles_of(F.count_if(~F.col("visitor"))).alias("own"), tiles_of(F.count_if("visitor")).alias("guests"))
    tile = F.pmod(F.xxhash64("cls", F.lit(7)), F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("own"))).cast("int")
    tiles = cells.join(sizes, ["label", "dim", "cell"]).withColumn("tile", tile)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda i, j, kind: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"))
    t = F.col("tile")
    with_own = F.transform(upto(F.col("own")), lambda o: pair(F.least(t, o), F.greatest(t, o), 0))
    with_guests, as_guest = F.transform(upto(F.col("guests")), lambda o: pair(t, o, 1)), F.transform(upto(F.col("own")), lambda o: pair(o, t, 1))
    tiles = tiles.select("label", "dim", "cell", "visitor", "tile", "cls", "n", "vec", F.explode(F.when(F.col("visitor"), as_guest).otherwise(F.concat(with_own, with_guests))).alias("p"))
    tiles = tiles.select("label", "dim", "cell", "p.i", "p.j", "p.kind", "visitor", "tile", "cls", "n", "vec")
    found = tiles.groupBy("label", "dim", "cell", "i", "j", "kind").applyInArrow(_tile_task(threshold), "u long, v long, n long")
    found = materialize(found, "links")
    discard(cells)
    counts = found.where("v is null").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("linked"))
    parts = connected_components(found.where("v is not null").select("u", "v")).select(F.col("node").alias("cls"), "root")
    named = classes.select("cls", "h", "g", "n", "least").join(counts, "cls", "left").join(parts, "cls", "left")
    named = named.select("h", "g", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "cls").alias("root"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("h", "g", "n_links", "component")
    linked = rows.where("vec is not null").select("id", "h", "g").join(named, ["h", "g"])
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.select("id", "n_links", "component").union(alone)
