"""SCIP indexes as the indexers write them: Protobuf bytes to the same rows as their JSON dump.

An index is scanned once for where its documents lie, each document becomes a row of its own, and these are decoded by all
tasks; so one large index isn't one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field numbers of the format.
_INDEX = {"metadata": 1, "documents": 2}
_METADATA = {"tool_info": 2}
_TOOL = {"name": 1, "version": 2}
_DOCUMENT = {"relative_path": 1, "occurrences": 2, "symbols": 3}
_OCCURRENCE = {"range": 1, "symbol": 2, "symbol_roles": 3}
_SYMBOL = {"symbol": 1, "relationships": 4}
_RELATIONSHIP = {"symbol": 1, "is_implementation": 3, "is_type_definition": 4}
_DOCUMENTS = (
    "relative_path string, occurrences array<struct<range:array<bigint>,symbol:string,symbol_roles:bigint>>, "
    "symbols array<struct<symbol:string,relationships:array<struct<symbol:string,is_implementation:boolean,is_type_definition:boolean>>>>")


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at += 1
        if b < 128:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("a number is too long")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of every field of a message: an integer, or the bytes of a string, message or packed list."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield number, value
            continue
        if kind == 2:
            size, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind} isn't known")
        if at + size > len(data):
            raise ValueError("the message is cut off")
        yield number, data[at : at + size]
        at += size


def _message(data: memoryview, names: dict[str, int], lists: tuple[str, ...] = ()) -> dict:
    out: dict = {n: [] for n in lists}
    by_number = {v: k for k, v in names.items()}
    for number, value in fields(data):
        name = by_number.get(number)
        if name in lists:
            out[name].append(value)
        elif name:
            out[name] = value
    return out


def _text(value) -> str:
    return bytes(value).decode() if value is not None else ""


def _numbers(values: list) -> list[int]:
    """A repeated 32-bit number, packed or not."""
    out = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
            continue
        at = 0
        while at < len(v):
            n, at = _varint(v, at)
            out.append(n)
    return [n - (1 << 64) if n >> 63 else n for n in out]


def decode_document(data: bytes) -> dict:
    d = _message(memoryview(data), _DOCUMENT, ("occurrences", "symbols"))
    occurrences, symbols = [], []
    for raw in d["occurrences"]:
        o = _message(raw, _OCCURRENCE, ("range",))
        occurrences.append({"range": _numbers(o["range"]), "symbol": _text(o.get("symbol")), "symbol_roles": o.get("symbol_roles", 0)})
    for raw in d["symbols"]:
        s = _message(raw, _SYMBOL, ("relationships",))
        related = [_message(r, _RELATIONSHIP) for r in s["relationships"]]
        symbols.append({"symbol": _text(s.get("symbol")), "relationships": [
            {"symbol": _text(r.get("symbol")), "is_implementation": bool(r.get("is_implementation")), "is_type_definition": bool(r.get("is_type_definition"))} for r in related]})
    return {"relative_path": _text(d.get("relative_path")), "occurrences": occurrences, "symbols": symbols}


def documents(indexes: DataFrame, content_col: str = "content") -> DataFrame:
    """Documents (relative_path, occurrences, symbols) of indexes (binary); null and empty indexes have none. Broken bytes are an error."""
    schema = _arrow(_DOCUMENTS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                held, size = [], 0
                for number, value in fields(memoryview(raw.as_buffer() or b"").cast("B")):
                    if number == _INDEX["documents"]:
                        held.append(bytes(value))
                        size += len(value)
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["document"])
                            held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["document"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield pa.RecordBatch.from_pylist([decode_document(x.as_py()) for x in b.slice(at, 64).column(0)], schema=schema)

    found = indexes.select(F.coalesce(F.col(content_col), F.lit(b""))).mapInArrow(split, "document binary")
    return found.repartition(F.xxhash64("document")).mapInArrow(decode, _DOCUMENTS)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Documents of all ``.scip`` files below a path, in the form that :func:`readers.scip_observations` reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.scip").option("recursiveFileLookup", True).load(path)
    return documents(files).select(F.array(F.struct("relative_path", "occurrences", "symbols")).alias("documents"))


def tool_version(spark: SparkSession, path: str, default: str) -> str:
    """Version of the indexer that wrote a file, told by its first bytes' metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                for number, value in fields(memoryview(raw.as_buffer()).cast("B")):
                    if number == _INDEX["metadata"]:
                        tool = _message(_message(value, _METADATA).get("tool_info", memoryview(b"")), _TOOL)
                        yield pa.RecordBatch.from_arrays([pa.array([_text(tool.get("version"))])], ["version"])
                        break

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "version string").where("version <> ''").first()
    return found[0] if found else default


# -- the way back, for samples and tests --------------------------------------------------------------------------------------


def _number(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, value: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(value)) + value


def encode_document(d: dict) -> bytes:
    """A document's bytes, as an entry of an index."""
    parts = [_bytes_field(_DOCUMENT["relative_path"], d["relative_path"].encode())]
    for o in d["occurrences"]:
        body = _bytes_field(_OCCURRENCE["range"], b"".join(map(_number, o["range"]))) + _bytes_field(_OCCURRENCE["symbol"], o["symbol"].encode())
        body += _number(_OCCURRENCE["symbol_roles"] << 3) + _number(o.get("symbol_roles") or 0)
        parts.append(_bytes_field(_DOCUMENT["occurrences"], body))
    for s in d["symbols"]:
        body = _bytes_field(_SYMBOL["symbol"], s["symbol"].encode())
        for r in s["relationships"]:
            told = _bytes_field(_RELATIONSHIP["symbol"], r["symbol"].encode())
            for name in ("is_implementation", "is_type_definition"):
                told += _number(_RELATIONSHIP[name] << 3) + _number(1) if r.get(name) else b""
            body += _bytes_field(_SYMBOL["relationships"], told)
        parts.append(_bytes_field(_DOCUMENT["symbols"], body))
    return _bytes_field(_INDEX["documents"], b"".join(parts))


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
