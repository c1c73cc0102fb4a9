"""Repair of conversations' structure by a min-plus scan over matrices of turns.

The roles of a sound conversation are read by four states: nothing yet (0), after system (1), after user (2), after assistant
(3); it ends in 0 or 3. A turn is a 4 x 4 matrix whose element from i to j is the cheapest (cost, audit) of taking the turn in
state i and leaving it in state j, inserts before it included. Sums and concatenation multiply elements, the least of two
by cost, then audit, adds them. All audits of one element consume the same turns and end in one of them, so none is a prefix
of another, and the product is associative: blocks of turns are multiplied where they lie, blocks by a tree. One
conversation may therefore reach over many partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lean, materialize

#: Turns, and code points of text, of a block at most (one turn at least); matrices that one step of the tree multiplies.
BLOCK, BLOCK_CHARS, FAN = 256, 1 << 20, 256
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Role initial -> state after it, and the states it may follow.
MOVES = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}
SOUND_PAIRS = ("su", "ua", "au")
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3

Element = tuple[int, str]
Matrix = list[dict[int, Element]]


def _insert_closure() -> Matrix:
    """Cheapest inserts alone from each state to each: a state of its own costs nothing."""
    out: Matrix = []
    for i in range(4):
        row: dict[int, Element] = {i: (0, "")}
        for _ in range(3):
            for j, (cost, audit) in list(row.items()):
                for c in "ua":
                    to, ok = MOVES[c]
                    if j in ok:
                        row[to] = min(row.get(to, (cost + INSERT, audit + "I")), (cost + INSERT, audit + "I"))
        out.append(row)
    return out


CLOSURE = _insert_closure()


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        to: dict[int, Element] = {}
        for j, (cost, audit) in row.items():
            for k, (more, said) in b[j].items():
                e = (cost + more, audit + said)
                if k not in to or e < to[k]:
                    to[k] = e
        out.append(to)
    return out


def turn_matrix(initial: str, fault: int) -> Matrix:
    """Inserts, then keep, rerole or delete one turn."""
    own: Matrix = [{i: (DELETE, "D")} for i in range(4)]
    if fault in (NONE, CUT):
        extra = TRUNCATED if fault == CUT else 0
        for c in "ua":
            to, ok = MOVES[c]
            for i in ok:
                own[i][to] = min(own[i].get(to, (REROLE + extra, "R")), (REROLE + extra, "R"))
        if initial in MOVES:
            to, ok = MOVES[initial]
            for i in ok:
                own[i][to] = min(own[i].get(to, (extra, "K")), (extra, "K"))
    return times(CLOSURE, own)


_turns: dict[tuple[str, int], Matrix] = {}


def block_matrix(initials: list[str], faults: list[int]) -> Matrix:
    out: Matrix = [{i: (0, "")} for i in range(4)]
    for c, f in zip(initials, faults):
        key = (c if c in MOVES else "", f)
        out = times(out, _turns.get(key) or _turns.setdefault(key, turn_matrix(*key)))
    return out


# -- blocks -----------------------------------------------------------------------------------------------------------------

_KEY = "conv long, part int, seq long, at long"
_BLOCKS = f"{_KEY}, turns array<long>, roles array<string>, texts array<string>, faults array<int>, digests array<binary>"
_NODE = ("n long, n_blank long, n_duplicate long, n_truncated long, illegal long, opens string, closes string, low long, high long, distinct_turns long, "
         "first_turn long, last_turn long, costs array<long>, audits array<string>, blocks array<struct<part:int,at:long,n:long>>")


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _small(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[dict]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pylist()


def _blocks(rows: DataFrame, partitions: int) -> DataFrame:
    """Turns in order, in blocks that hold turns of one conversation. Each row's fault is right but for copies in other partitions."""
    schema = _arrow(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        part, at, seq, chars, first = TaskContext.get().partitionId(), 0, 0, 0, True
        conv, seen, held = None, set(), []

        def block() -> pa.RecordBatch:
            cols = {k: [[r[n] for r in held]] for k, n in (("turns", "turn"), ("roles", "role"), ("texts", "text"), ("faults", "fault"), ("digests", "digest"))}
            return pa.RecordBatch.from_pydict({"conv": [conv], "part": [part], "seq": [seq], "at": [at]} | cols, schema=schema)

        for some in _small(batches, 512):
            for r in some:
                if held and (first is False and r["conv"] != conv or len(held) >= BLOCK or chars >= BLOCK_CHARS):
                    yield block()
                    at, seq, held, chars = at + 1, seq + 1, [], 0
                if first or r["conv"] != conv:
                    conv, seen, seq, first = r["conv"], set(), 0, False
                if r["fault"] != BLANK:
                    if r["digest"] in seen:
                        r["fault"] = DUPLICATE
                    seen.add(r["digest"])
                held.append(r)
                chars += len(r["text"])
        if held:
            yield block()

    # rows that are alike in all of these are dealt out by a number
    deal = F.xxhash64(F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.md5(F.col("text").cast("binary"))]
    fault = F.when(~F.rlike("text", F.lit(WORD)), BLANK).when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z")), CUT).otherwise(NONE)
    rows = rows.select("conv", "turn", "role", "text", fault.alias("fault"), F.unhex(F.md5(F.concat_ws("\n", "role", "text").cast("binary"))).alias("digest"), deal.alias("deal"))
    return rows.repartitionByRange(partitions, *order, "deal").sortWithinPartitions(*order).drop("deal").mapInArrow(run, _BLOCKS)


def _far_copies(blocks: DataFrame) -> DataFrame:
    """(part, at, places): turns whose role and text an earlier partition holds in the same conversation.

    Only conversations that reach over a boundary between partitions can have such, one for each boundary at most, so that
    list is broadcast; within a partition copies are already told, so a text occurs once for each partition here.
    """
    spread = blocks.groupBy("conv").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select(F.col("conv").alias("spread"))
    here = blocks.join(F.broadcast(spread), F.col("conv").eqNullSafe(F.col("spread")), "left_semi")
    lone = here.select("conv", "part", "at", F.posexplode(F.arrays_zip("faults", "digests")).alias("place", "x")).where(f"x.faults not in ({BLANK}, {DUPLICATE})")
    met = lone.groupBy("conv", "x.digests").agg(F.min("part").alias("least"), F.collect_list(F.struct("part", "at", "place")).alias("all")).where("size(all) > 1")
    late = met.select(F.explode(F.filter("all", lambda x: x.part > F.col("least"))).alias("x"))
    return late.groupBy(F.col("x.part").alias("far_part"), F.col("x.at").alias("far_at")).agg(F.collect_list("x.place").alias("places"))


def _leaves(blocks: DataFrame) -> DataFrame:
    """A node of the tree for each block."""
    ddl = f"conv long, part int, seq long, {_NODE}"
    schema = _arrow(ddl)

    def node(r: dict) -> dict:
        faults, initials, turns = r["faults"], r["initials"], [t for t in r["turns"] if t is not None]
        for p in r["places"] or ():
            faults[p] = DUPLICATE
        m = block_matrix(initials, faults)
        return {k: r[k] for k in ("conv", "part", "seq")} | {
            "n": len(faults), "n_blank": faults.count(BLANK), "n_duplicate": faults.count(DUPLICATE), "n_truncated": faults.count(CUT),
            "illegal": sum(a + b not in SOUND_PAIRS for a, b in zip(initials, initials[1:])), "opens": initials[0], "closes": initials[-1],
            "low": min(turns, default=None), "high": max(turns, default=None), "distinct_turns": len(set(turns)), "first_turn": r["turns"][0], "last_turn": r["turns"][-1],
            **_flat(m), "blocks": [{"part": r["part"], "at": r["at"], "n": len(faults)}]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for some in _small(batches, 128):
            yield _batch([node(r) for r in some], schema)

    far = _far_copies(blocks)
    light = blocks.select("conv", "part", "seq", "at", "turns", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults")
    both = light.join(far, (F.col("part") == F.col("far_part")) & (F.col("at") == F.col("far_at")), "left").drop("far_part", "far_at")
    return both.mapInArrow(run, ddl)


def _flat(m: Matrix) -> dict:
    return {"costs": [m[i][j][0] if j in m[i] else None for i in range(4) for j in range(4)], "audits": [m[i][j][1] if j in m[i] else None for i in range(4) for j in range(4)]}


def _matrix(r: dict) -> Matrix:
    return [{j: (r["costs"][4 * i + j], r["audits"][4 * i + j]) for j in range(4) if r["costs"][4 * i + j] is not None} for i in range(4)]


def _joined(nodes: list[dict]) -> dict:
    """One node of neighbours in order."""
    out, m = dict(nodes[0]), _matrix(nodes[0])
    out["blocks"] = list(out["blocks"])
    for r in nodes[1:]:
        m = times(m, _matrix(r))
        for k in ("n", "n_blank", "n_duplicate", "n_truncated", "illegal", "distinct_turns"):
            out[k] += r[k]
        out["illegal"] += out["closes"] + r["opens"] not in SOUND_PAIRS
        out["distinct_turns"] -= r["first_turn"] is not None and out["last_turn"] == r["first_turn"]
        for k, f in (("low", min), ("high", max)):
            out[k] = f((x for x in (out[k], r[k]) if x is not None), default=None)
        out["closes"], out["last_turn"] = r["closes"], r["last_turn"]
        out["blocks"] += r["blocks"]
    return out | _flat(m)


def _up(nodes: DataFrame, part: Column, seq: Column) -> DataFrame:
    """Nodes of a conversation that have the same ``part`` and ``seq`` become one."""
    ddl = f"conv long, part int, seq long, {_NODE}"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for some in _small(batches, 16):
            yield _batch([{k: r[k] for k in ("conv", "part", "seq")} | _joined(r["nodes"]) for r in some], schema)

    names = [c for c in nodes.columns if c not in ("conv", "part", "seq")]
    groups = nodes.select("conv", part.cast("int").alias("part"), seq.cast("long").alias("seq"), F.struct(F.col("part").alias("p"), F.col("seq").alias("s"), *names).alias("x"))
    return groups.groupBy("conv", "part", "seq").agg(F.array_sort(F.collect_list("x")).alias("nodes")).mapInArrow(run, ddl)


def _root(nodes: DataFrame) -> DataFrame:
    """One node for each conversation, by a tree whose steps multiply FAN nodes at most."""
    top = nodes.agg(F.max("seq"), F.max("part")).first()
    seqs, parts = (top[0] or 0) + 1, (top[1] or 0) + 1
    part, seq, none = F.col("part"), F.col("seq"), F.lit(0)
    while seqs > FAN:
        nodes, seqs = materialize(_up(nodes, part, F.floor(seq / FAN)), "repair-tree"), -(-seqs // FAN)
    if seqs > 1:
        nodes = _up(nodes, part, none)
    while parts > FAN:
        nodes, parts = materialize(_up(nodes, F.floor(part / FAN), none), "repair-tree"), -(-parts // FAN)
    return _up(nodes, none, none)


# -- results ----------------------------------------------------------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repaired(NamedTuple):
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: conv, part, seq (their order),
    roles, texts: what stays of a block of turns, inserts included, in order; blocks that lose all turns are there, too."""

    conversations: DataFrame
    turns: DataFrame


def best(m: Matrix) -> Element:
    """The cheapest way through a whole conversation, trailing inserts included."""
    return min((cost + more, audit + said) for j, (cost, audit) in m[0].items() for k, (more, said) in CLOSURE[j].items() if k in (0, 3))


def apply_edits(audit: str, roles: list[str], texts: list[str], written: int, system: bool) -> tuple[list[str], list[str]]:
    """Roles and texts that edits leave of some turns, after ``written`` turns of output; ``system``: the first of these is a system turn."""
    out_roles, out_texts, k = [], [], 0
    for c in audit:
        if c == "I" or c == "R":
            out_roles.append("assistant" if (written + len(out_roles) - system) % 2 else "user")
            out_texts.append("" if c == "I" else texts[k])
        elif c == "K":
            out_roles.append(roles[k])
            out_texts.append(texts[k])
        k += c != "I"
    return out_roles, out_texts


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest edits that make each conversation an optional system turn and pairs of user and assistant, or nothing.

    Rows are ordered by turn (nulls first), ties by role and digest of the text. A null role or text is one space; an empty
    role has no initial, so its turn is reroled or deleted. Rows without a conversation form one. Faults: blank, else duplicate
    (role and text stand earlier in the conversation), else truncated (last character not of ``.!?``). Repeated rows are
    turns of their own; an empty table gives no rows; other columns aren't read. ``conversations`` has those with a row.
    A conversation may be of any length: its turns lie in order over as many partitions as they fill.
    """
    rows = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                     F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))
    blocks = materialize(_blocks(rows, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "repair-blocks")
    root = materialize(_judged(_root(_leaves(blocks))), "repair-conversations")
    return Repaired(root.drop("blocks"), _repaired(blocks, root))


def _judged(root: DataFrame) -> DataFrame:
    ddl = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, blocks array<struct<part:int,at:long,n:long>>"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _small(batches, 64):
            out = []
            for r in some:
                cost, audit = best(_matrix(r))
                gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["distinct_turns"]
                out.append({"conv": r["conv"], "gaps": gaps, "blank": r["n_blank"], "duplicate": r["n_duplicate"], "truncated": r["n_truncated"], "illegal": r["illegal"], "cost": cost, "audit": audit, "blocks": r["blocks"]})
            yield _batch(out, schema)

    return root.mapInArrow(run, ddl)


def _repaired(blocks: DataFrame, root: DataFrame) -> DataFrame:
    """Each block with its share of the audit: first the audits are cut at the blocks' ends, then blocks are edited where they lie.

    A share carries the number of turns written before it, and whether a system turn opens the conversation, which it does
    exactly if an odd number of turns is written.
    """
    shares, edited = "part int, at long, share string, written long, system boolean", "conv long, part int, seq long, roles array<string>, texts array<string>"
    share_schema, edited_schema = _arrow(shares), _arrow(edited)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _small(batches, 64):
            out: list[dict] = []
            for r in some:
                audit, at, written = r["audit"], 0, 0
                system = (len(audit) - audit.count("D")) % 2 == 1
                for k, b in enumerate(r["blocks"]):
                    end, left = at, b["n"]
                    while left:
                        left -= audit[end] != "I"
                        end += 1
                    end = len(audit) if k == len(r["blocks"]) - 1 else end
                    share = audit[at:end]
                    out.append({"part": b["part"], "at": b["at"], "share": share, "written": written, "system": system})
                    at, written = end, written + len(share) - share.count("D")
                    if len(out) >= 4096:
                        yield _batch(out, share_schema)
                        out = []
            yield _batch(out, share_schema)

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for some in _small(batches, 64):
            out = []
            for r in some:
                roles, texts = apply_edits(r["share"], r["roles"], r["texts"], r["written"], r["system"])
                out.append({"conv": r["conv"], "part": r["part"], "seq": r["seq"], "roles": roles, "texts": texts})
            yield _batch(out, edited_schema)

    cuts = root.select("audit", "blocks").mapInArrow(cut, shares).withColumnsRenamed({"part": "to_part", "at": "to_at"})
    both = blocks.select("conv", "part", "seq", "at", "roles", "texts").join(cuts, (F.col("part") == F.col("to_part")) & (F.col("at") == F.col("to_at")))
    return both.select("conv", "part", "seq", "roles", "texts", "share", "written", "system").mapInArrow(edit, edited)


def digest_rows(found: Repaired, all_convs: DataFrame) -> DataFrame:
    """One row for each of ``all_convs`` (conv): counts, cost, audit, and the SHA-256 of the repaired ``role:text`` lines.

    A digest of one conversation is sequential: its blocks, not its turns, pass through one task in order, and only the state
    of the hash is held. Conversations without a row have zeros, an empty audit and the digest of nothing.
    """
    stats = list(_COUNTS)
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x.roles, F.lit(":"), x.texts)), "\n")
    nothing = [F.lit(None).cast("long").alias(c) for c in stats] + [F.lit(None).cast("string").alias("audit")]
    wanted = all_convs.select("conv").distinct().select("conv", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), *nothing, F.lit(None).cast("string").alias("lines"))
    judged = found.conversations.select("conv", F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), *stats, "audit", F.lit(None).cast("string").alias("lines"))
    pieces = found.turns.where("size(roles) > 0").select("conv", F.lit(2).alias("kind"), "part", "seq", *nothing, lines.alias("lines"))
    ddl = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        row: dict | None = None
        sha, some = hashlib.sha256(), False

        def every() -> Iterator[dict]:
            for part in _small(batches, 64):
                yield from part

        for conv, rows in groupby(every(), key=lambda r: (r["conv"],)):
            row, sha, some = {"conv": conv[0], "audit": ""} | dict.fromkeys(stats, 0), hashlib.sha256(), False
            for r in rows:
                if r["kind"] == 1:
                    row |= {k: r[k] for k in (*stats, "audit")}
                elif r["kind"] == 2:
                    sha.update((("\n" if some else "") + r["lines"]).encode())
                    some = True
            yield _batch([row | {"repaired_sha256": sha.hexdigest()}], schema)

    rows = wanted.unionByName(judged).unionByName(pieces)
    return rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "kind", "part", "seq").mapInArrow(run, ddl)


def damage(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table of conversations (null roles and texts: one space), damaged by the CRC of conversation and turn (null: one space)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
