"""Token ids in binary segments, by patched frame-of-reference blocks.

A block holds 128 ids: their minimum, a width that a percentile of the differences chooses, the differences packed at that
width, and a list of exceptions (position, difference) for those that don't fit. A segment holds whole documents, the
blocks, and an index of where each block starts, so any id is found without reading what is before it. Segments are rows
of a Parquet container, in ascending order of document: Spark commits them, and a task that is lost is simply run again.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, scratch_path, settle

BLOCK, PERCENTILE, SEGMENT = 128, 0.9, 1 << 16
SCHEMA = "shard int, seq int, start long, n_ids long, doc_ids array<long>, doc_lengths array<long>, block_index binary, payload binary"
HEAD = 6  # minimum: 4 bytes, width: 1, number of exceptions: 1


def _pack_narrow(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below 2**w, w at most 16, packed from the highest bit on: eight of them are w bytes of two 64-bit words."""
    v = values.reshape(-1, 2, 4).astype(np.uint64)
    four = v[:, :, 0] << 3 * w | v[:, :, 1] << 2 * w | v[:, :, 2] << w | v[:, :, 3]
    two = np.empty((len(v), 2), ">u8")
    two[:, 0] = four[:, 0] << 64 - 4 * w | (four[:, 1] >> 8 * w - 64 if w > 8 else four[:, 1] << 64 - 8 * w)
    two[:, 1] = four[:, 1] << 128 - 8 * w
    return two.view(np.uint8)[:, :w].reshape(len(values), -1)


def _unpack_narrow(packed: np.ndarray, w: int) -> np.ndarray:
    """The inverse of :func:`_pack_narrow`."""
    raw = np.zeros((len(packed) * BLOCK // 8, 16), np.uint8)
    raw[:, :w] = packed.reshape(-1, w)
    two = raw.view(">u8").astype(np.uint64)
    four = np.empty_like(two)
    four[:, 0] = two[:, 0] >> 64 - 4 * w
    four[:, 1] = two[:, 1] >> 128 - 8 * w | two[:, 0] << 8 * w - 64 if w > 8 else two[:, 0] >> 64 - 8 * w
    mask = np.uint64((1 << w) - 1)
    return np.stack([four >> k * w & mask for k in (3, 2, 1, 0)], axis=2).reshape(len(packed), BLOCK).astype(np.uint32)


def pack(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Ids (unsigned 32-bit) to (where each block starts, bytes)."""
    if not len(ids):
        return np.zeros(0, "<u4"), b""
    nb = -(-len(ids) // BLOCK)
    full = np.full(nb * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    full = full.reshape(nb, BLOCK)
    base = full.min(axis=1)
    diff = full - base[:, None]
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    most = np.partition(diff, rank, axis=1)[:, rank]
    width = np.frexp(most.astype(np.float64))[1].astype(np.int64)
    over = (diff >> width[:, None].astype(np.uint32)) > 0
    n_over = over.sum(axis=1)
    sizes = HEAD + width * (BLOCK // 8) + 5 * n_over
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(at[-1], np.uint8)
    starts = at[:-1]
    out[starts[:, None] + np.arange(4)] = base.astype("<u4").view(np.uint8).reshape(nb, 4)
    out[starts + 4], out[starts + 5] = width, n_over
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        if w <= 16:
            packed = _pack_narrow(diff[rows] & np.uint32((1 << w) - 1), w)
        else:
            be = diff[rows].astype(">u4").view(np.uint8).reshape(len(rows), BLOCK, 4)[:, :, 4 - (w + 7) // 8 :]
            packed = np.packbits(np.unpackbits(be, axis=2)[:, :, -w:].reshape(len(rows), -1), axis=1)
        out[starts[rows][:, None] + HEAD + np.arange(w * BLOCK // 8)] = packed
    r, pos = np.nonzero(over)
    nth = np.arange(len(r)) - np.concatenate([[0], np.cumsum(n_over)])[r]
    where = starts[r] + HEAD + width[r] * (BLOCK // 8) + 5 * nth
    out[where] = pos
    out[where[:, None] + np.arange(1, 5)] = diff[r, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype("<u4"), out.tobytes()


def unpack(index: np.ndarray, payload: bytes, n: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    if not n:
        return np.zeros(0, np.uint32)
    data, starts = np.frombuffer(payload, np.uint8), index.astype(np.int64)
    base = data[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0].astype(np.uint32)
    width, n_over = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    diff = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = data[starts[rows][:, None] + HEAD + np.arange(w * BLOCK // 8)]
        if w <= 16:
            diff[rows] = _unpack_narrow(packed, w)
            continue
        wide = np.zeros((len(rows), BLOCK, 32), np.uint8)
        wide[:, :, -w:] = np.unpackbits(packed, axis=1).reshape(len(rows), BLOCK, w)
        diff[rows] = np.packbits(wide, axis=2).view(">u4")[:, :, 0]
    r = np.repeat(np.arange(len(starts)), n_over)
    nth = np.arange(len(r)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    where = starts[r] + HEAD + width[r] * (BLOCK // 8) + 5 * nth
    diff[r, data[where]] = data[where[:, None] + np.arange(1, 5)].copy().view("<u4")[:, 0]
    return (diff + base[:, None]).reshape(-1)[:n]


#: Encodings of pieces that a worker keeps, the first that it meets; frequent ones come early. Others, and longer pieces, are
#: encoded once in each group of texts.
KEPT, LONG = 500_000, 64
#: The first of those kept are looked up before the others: few, so near at hand, and most of what texts hold.
HOT = 1 << 15
#: Characters of texts that are encoded together (one text at least).
GROUP = 1 << 23
_encoders: dict[tuple[str, int], Encoder] = {}
#: Latin letters, as long as they have been in Unicode: one pre-token.
_latin = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_own = {*range(33, 127), *range(161, 173), *range(174, 256)}
_alphabet = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _own)}
_space = chr(_alphabet[32])


def _runs(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs that start at ``at``, one run behind the other."""
    end = np.cumsum(size, dtype=at.dtype)
    return np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0, dtype=at.dtype)


class _Pieces:
    """Ids of pieces, in columns: those of the first pieces that are met are kept while there is room."""

    def __init__(self, tokenizer, room: int):
        self.room, self.tokenizer, self.model = room, tokenizer, tokenizer.model
        self.model._resize_cache(0)  # this one takes its place
        self.line = self.whole("\n")
        self.words, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int32)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def fresh(self, piece: str) -> list[int]:
        """Ids of a piece that is not kept."""
        lead = piece[0] if piece[0] in " \n" else ""
        said = piece[len(lead) :]
        if said.isascii():
            letters = said.isalpha()
        else:
            letters = _latin.fullmatch(said)
            said = said.encode().decode("latin-1").translate(_alphabet) if letters else said
        if not letters:
            return self.whole(piece)
        # one pre-token: no need to look for more
        ids = [t.id for t in self.model.tokenize(_space + said if lead == " " else said)]
        return self.line + ids if lead == "\n" else ids

    def ids(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. Each distinct piece that is not kept is encoded once."""
        which = np.array(pc.index_in(pieces, value_set=self.words[:HOT]).fill_null(-1))
        if len(self.words) > HOT:
            rest = np.flatnonzero(which < 0)
            which[rest] = np.asarray(pc.index_in(pieces.take(pa.array(rest)), value_set=self.words).fill_null(-1))
        lacks = np.flatnonzero(which < 0)
        new = pieces.take(pa.array(lacks)).dictionary_encode()
        flat, sizes = array("I"), array("i")
        for piece in new.dictionary.to_numpy(zero_copy_only=False).tolist():
            ids = self.fresh(piece)
            flat.extend(ids)
            sizes.append(len(ids))
        which[lacks] = np.asarray(new.indices) + len(self.words)
        flat, sizes = np.concatenate([self.flat, np.array(flat, "<u4")]), np.concatenate([self.sizes, np.array(sizes, np.int32)])
        size = sizes[which]
        narrow = max(len(flat), size.sum(dtype=np.int64)) < 1 << 31
        at = (np.cumsum(sizes, dtype=np.int64) - sizes).astype(np.int32 if narrow else np.int64)
        self._keep(new.dictionary, flat, at, sizes)
        return flat[_runs(at[which], size)], size

    def _keep(self, new: pa.LargeStringArray, flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.words)
        short = np.flatnonzero(np.asarray(pc.binary_length(new)) <= LONG)[: self.room - n]
        if len(short):
            self.words = pa.concat_arrays([self.words, new.take(pa.array(short))])
            self.flat = np.concatenate([self.flat, flat[_runs(at[n + short], sizes[n + short])]])
            self.sizes = np.concatenate([self.sizes, sizes[n + short]])


def standard(tokenizer) -> bool:
    """Whether texts may be cut as :class:`Encoder` does: byte-level BPE, the standard pattern, texts taken as they are.

    A file that drops pieces at random, or pads or truncates, is not standard either.
    """
    said = json.loads(tokenizer.to_str())
    pre, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
    pattern = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(pattern and not said.get("normalizer") and not said.get("truncation") and not said.get("padding") and model.get("type") == "BPE" and not model.get("dropout"))


class Encoder:
    """Encodes texts with a tokenizers file, by pieces whose encodings are kept.

    Pre-tokens of this byte-level pattern are runs of letters, of digits, of white space or of other characters, the
    space before a run belonging to it. So a text may be cut, without a change of its ids, before a single space or line
    end between other characters, and before an ASCII mark behind a letter or digit. A mark that is part of an added token
    cuts nothing, so such a token stays whole. With a file that is not of this kind (:func:`standard`) no text is cut.
    """

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.plain = None if standard(tokenizer) else tokenizer
        if self.plain:
            return
        self.kept = _Pieces(tokenizer, kept)
        self.white, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.white[[10, 32]] = True
        self.mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
        for added in tokenizer.get_added_tokens_decoder().values():
            for b in added.content.encode():
                self.white[b] = self.mark[b] = False

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers. Each distinct piece of all these texts is looked up in one go."""
        if self.plain:
            return [array("I", x.ids).tobytes() for x in self.plain.encode_batch(texts, add_special_tokens=False)]
        pieces, of_text = self.cut(texts)
        ids, size = self.kept.ids(pieces)
        ends = np.append(0, np.cumsum(size, dtype=np.int64))[of_text].tolist()
        raw = memoryview(ids.tobytes())
        return [bytes(raw[4 * s : 4 * e]) for s, e in zip(ends, ends[1:])]

    def cut(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Pieces of all texts in a row, and how many of them are before each text, and in all."""
        column = pa.array(texts, pa.large_string())
        data = column.buffers()[2]
        starts = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        # three line ends before, one behind: neighbours of any byte can be looked at
        near = np.full(starts[-1] + 4, 10, np.uint8)
        near[3:-1] = np.frombuffer(data, np.uint8)[: starts[-1]] if data else 0
        first = np.zeros(starts[-1] + 1, bool)
        at = np.flatnonzero(self.white[near[3:-1]])
        first[at[~self._may_be_white(near, at) & (near[at + 4] > 32) & ~np.isin(near[at + 4], (0x7F, 0xC2, 0xE1, 0xE2, 0xE3))]] = True
        # a line end or space that ends a text is not between other characters
        ends = starts[1:][starts[1:] > starts[:-1]] - 1
        first[ends[self.white[near[ends + 3]]]] = False
        at = np.flatnonzero(self.mark[near[3:-1]])
        first[at[self._is_letter_or_digit(near, at)]] = True
        first[starts] = True
        offsets = np.flatnonzero(first)
        pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data or pa.py_buffer(b""))
        return pieces, np.searchsorted(offsets, starts)

    @staticmethod
    def _may_be_white(near: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the character before may be white space: ASCII up to the space, or its bytes begin as those of white space do."""
        last = near[at + 2]
        return (last <= 32) | (last == 0x7F) | (last > 0x7F) & ((near[at + 1] == 0xC2) | np.isin(near[at], (0xE1, 0xE2, 0xE3)))

    @staticmethod
    def _is_letter_or_digit(near: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the character before is an ASCII digit or a Latin letter."""
        last, lead = near[at + 2], near[at + 1]
        ascii_ = (last >= 48) & (last <= 57) | (last | 32 >= 97) & (last | 32 <= 122) & (last < 128)
        code = (lead.astype(np.int32) & 31) << 6 | last & 63
        wide = (last >> 6 == 2) & (lead >> 5 == 6) & (code >= 0xC0) & (code < 0x250) & (code != 0xD7) & (code != 0xF7)
        return ascii_ | wide


def _texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int | None, str]]]:
    group, held = [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            t = t.as_py() or ""
            group.append((i.as_py(), t))
            held += len(t)
            if held > most:
                yield group
                group, held = [], 0
    if group:
        yield group


def write(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None, kept: int = KEPT, group: int = GROUP) -> None:
    """Encode every text (null: empty), append ``end_id`` to each, and write segments in ascending order of id.

    Null ids come first, ties are ordered by a digest of the text, so rows that repeat an id are dealt over many tasks. A
    text is one unit of work; a segment closes at the first document that fills it. ``kept`` and ``group`` trade a
    worker's memory for time; results are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        enc = _encoders.get((tokenizer, kept)) or _encoders.setdefault((tokenizer, kept), Encoder(tokenizer, kept))
        shard, seq, start = TaskContext.get().partitionId(), 0, 0
        tail = np.array([end_id], "<u4").tobytes()
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            index, payload = pack(ids)
            cols = [[shard], [seq], [start], [len(ids)], [docs], [[len(p) // 4 for p in parts]], [index.tobytes()], [payload]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in re.split(r", (?=\w+ )", SCHEMA)])

        for rows in _texts(batches, group):
            for (i, _), ids in zip(rows, enc.encode([t for _, t in rows])):
                docs.append(i)
                parts.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= SEGMENT:
                    yield segment()
                    seq, start, docs, parts, held = seq + 1, start + held, [], [], 0
        if docs:
            yield segment()
        settle()

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("tie", F.xxhash64("text"))
    # rows that repeat an id and a text are alike, so any of their orders will do: a number deals them over many tasks, too
    rows = rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie", "deal").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")
    rows.select("id", "text").mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32, shard, seq.

    ``start`` adds the ids of the shards before, one number per shard, which come from the small columns alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(np.frombuffer(row["block_index"], "<u4"), row["payload"], row["n_ids"]).astype("<u4")
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = np.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths.tolist(), ends.tolist())], np.int64)
                k = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crc), pa.array(np.full(k, row["shard"], np.int32)), pa.array(np.full(k, row["seq"], np.int32))],
                    ["doc_id", "at", "n_tokens", "ids_crc32", "shard", "seq"])

    store = spark.read.schema(SCHEMA).parquet(path)
    sizes = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    docs = store.mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, shard int, seq int")
    return docs.join(sizes, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard", "seq")


def write_and_read(df: DataFrame, tokenizer: str, name: str = "tokens", **options) -> DataFrame:
    """Write into the shared folder and return what the files hold. An empty table gives no rows."""
    path = scratch_path(df.sparkSession, name)
    write(df, path, tokenizer, **options)
    return read(df.sparkSession, path)
