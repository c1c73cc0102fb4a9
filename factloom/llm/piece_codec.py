"""SentencePiece BPE in Spark: exact encoding by backtracking over longest matches, and decoding.

The encoding of a text is the only sequence of pieces in which each piece, and each pair of neighbours, is what merging makes
of its own characters again. So the encoder goes from left to right, takes the longest piece that an Aho-Corasick automaton
finds at its place, falls back to shorter prefixes while the pair with the piece before doesn't merge into itself, and goes
one piece back where nothing fits. A bitfield keeps the places from which nothing follows, so none is tried twice.
No merge crosses two neighbouring characters that stand side by side in no piece of the vocabulary. Texts are cut there, and
each distinct part of a group of texts is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle

#: Encodings of parts, and answers about pairs, that a worker keeps; others are found each time.
KEPT = 400_000
#: Code points that are encoded together; longer texts go slice by slice.
GROUP = 1 << 21
#: How the library's identity normaliser must treat a text; models that don't are refused.
PROBE = "  a\tb  é é ﬁ Ａ c\nd  "
SPACE = "▁"


class _Parts(dict):
    """Part of a text to its ids, found on demand and kept while there is room."""

    def __init__(self, find, room: int):
        super().__init__()
        self.find, self.room = find, room

    def __missing__(self, text: str) -> bytes:
        found = self.find(text)
        if len(self) < self.room and len(text) <= 64:
            self[text] = found
        return found


class Codec:
    """A model file of type BPE with byte fallback and no normalisation but the leading space and spaces as U+2581."""

    def __init__(self, path: str, kept: int = KEPT):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kept = kept
        n = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(n)) or sp.normalize(PROBE) != SPACE + PROBE.replace(" ", SPACE):
            raise ValueError("a model with unused pieces or with normalisation can't be encoded exactly here")
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_of = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_of) != 256:
            raise ValueError("the model has no byte fallback")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.score = {names[i]: sp.get_score(i) for i in plain}
        if sp.encode("ab ab") != sp.encode("ab ab", enable_sampling=False) or _is_unigram(sp):
            raise ValueError("the model isn't of type BPE")
        self._tables_for_decoding(sp, names)
        # pieces that merging can make; single characters of pieces that aren't pieces themselves go to bytes at the end
        self.names = dict(zip(plain, (names[i] for i in plain)))
        made = {names[i]: i for i in plain if len(names[i]) == 1 or self.merge(names[i]) == [names[i]]}
        for c in sorted({c for p in self.score if len(p) > 1 for c in p} - made.keys()):
            made[c] = n + len(self.names)
            self.names[made[c]] = c
        self.size = {i: len(p) for p, i in made.items()}
        self.shorter = {i: next((made[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in made), -1) for p, i in made.items()}
        self.first_extra, self.made = n, made
        self.longest = ahocorasick.Automaton()
        for p, i in made.items():
            self.longest.add_word(p, i)
        self.longest.make_automaton()
        # classes of characters, and which classes stand side by side in a piece
        chars = sorted({c for p in self.score if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.beside = np.zeros(self.kinds * self.kinds, bool)
        pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        if pairs:
            a, b = (self.kind[[ord(x[k]) for x in pairs]].astype(np.int64) for k in (0, 1))
            self.beside[a * self.kinds + b] = True
        self.pairs: dict[int, bool] = {}
        self.parts = _Parts(self.part, kept)

    def _tables_for_decoding(self, sp, names: list[str]) -> None:
        raw = []
        self.is_byte, self.is_control = np.zeros(len(names), bool), np.zeros(len(names), bool)
        for i, p in enumerate(names):
            self.is_byte[i], self.is_control[i] = sp.is_byte(i), sp.is_control(i)
            raw.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
        self.opens = np.array([p.startswith(SPACE) and not c for p, c in zip(names, self.is_control)])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    # -- encoding ---------------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Plain merging: again and again the neighbours that make the piece of the highest score, the leftmost of equals."""
        parts, score = list(text), self.score.get
        joined = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, s in enumerate(joined):
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            joined.pop(at)
            if at:
                joined[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = score(parts[at] + parts[at + 1])

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the characters of two pieces gives these two pieces again."""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            a, b = self.names[left], self.names[right]
            found = self.merge(a + b) == [a, b]
            if len(self.pairs) >= self.kept:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def part(self, text: str) -> bytes:
        """Ids (32-bit) of a part of a text that no piece reaches beyond; white space is U+2581 in it."""
        size, shorter, fits = self.size, self.shorter, self.fits
        n = len(text)
        at_start = [-1] * n
        for end, i in self.longest.iter(text):
            at_start[end + 1 - size[i]] = i  # ends come in order, so the longest stays
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        pos, piece = 0, at_start[0]
        if piece < 0:  # a character of no piece stands alone
            return np.array([self.bytes_of[b] for b in text.encode()], "<u4").tobytes()
        while pos < n:
            end = pos + size[piece]
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or fits(out[-1], piece)):
                out.append(piece)
                pos = end
                piece = at_start[pos] if pos < n else -1
            elif shorter[piece] >= 0:
                piece = shorter[piece]
            else:  # nothing fits here: one piece back, and a shorter one there
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                pos -= size[piece]
        if out and max(out) >= self.first_extra:
            out = [x for i in out for x in ([i] if i < self.first_extra else [self.bytes_of[b] for b in self.names[i].encode()])]
        return np.array(out, "<u4").tobytes()

    def _cuts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Code points of a text, and behind which of them it may be cut."""
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kind[points].astype(np.int32)
        return points, ~self.beside[kind[:-1] * self.kinds + kind[1:]]

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that end where they may be cut; white space is U+2581 in them, none is empty."""
        whole = "".join(texts)
        points, cut = self._cuts(whole)
        ends = np.cumsum([len(t) for t in texts])
        cut[ends[:-1] - 1] = True
        at = np.append(np.flatnonzero(cut) + 1, len(points))
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        offsets = np.append(0, np.cumsum(width)[at - 1])
        parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(whole.encode())).dictionary_encode()
        ids = list(map(self.parts.__getitem__, parts.dictionary.to_pylist()))
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, flat = np.cumsum(n) - n, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        which = np.asarray(parts.indices)
        size = n[which]
        end = np.cumsum(size)
        out = flat[np.repeat(start[which] - (end - size), size) + np.arange(end[-1])]
        return np.split(out, end[np.searchsorted(at, ends[:-1])])

    def _slices(self, text: str) -> Iterator[str]:
        """A long text in slices of about GROUP code points that end where it may be cut (or wherever it first may be, later)."""
        at = 0
        while at < len(text):
            to, look = min(len(text), at + GROUP), 1024
            while to < len(text):
                where = np.flatnonzero(self._cuts(text[to - 1 : to + look])[1])
                if len(where):
                    to += int(where[0])
                    break
                to, look = min(len(text), to + look), look * 2
            yield text[at:to]
            at = to

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's ``encode`` gives them; an empty text has none."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, str]] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                for (k, _), ids in zip(group, self._group([t for _, t in group])):
                    out[k].append(ids)
            group, held = [], 0

        for k, t in enumerate(texts):
            if not t:
                continue
            for s in self._slices(SPACE + t.replace(" ", SPACE)):
                if held and held + len(s) > GROUP:
                    flush()
                group.append((k, s))
                held += len(s)
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    # -- decoding ---------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, as the library's ``decode`` gives it: without the leading space, bytes that are no UTF-8 as U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.is_control[ids]]
        if not len(ids):
            return ""
        out = self._bytes(ids)
        skip = 1 if self.opens[ids[0]] else 0
        try:
            return out[skip:].decode()
        except UnicodeDecodeError:  # runs of bytes one by one
            edges = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
            said = [_bytes_as_text(self._bytes(run)) if self.is_byte[run[0]] else self._bytes(run).decode() for run in np.split(ids, edges)]
            return "".join(said)[skip:]

    def _bytes(self, ids: np.ndarray) -> bytes:
        size = self.raw_size[ids]
        end = np.cumsum(size)
        return self.raw[np.repeat(self.raw_at[ids] - (end - size), size) + np.arange(end[-1])].tobytes()


def _is_unigram(sp) -> bool:
    """Only unigram models can rank whole segmentations."""
    try:
        return len(sp.nbest_encode_as_ids("ab ab", 2)) > 0
    except Exception:  # noqa: BLE001 - the library says so in its own way
        return False


def _bytes_as_text(raw: bytes) -> str:
    """Each byte that starts no whole character is one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                n = 0
        at += n or 1
        if not n:
            out.append("�")
    return "".join(out)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(path: str, kept: int = KEPT) -> Codec:
    return _codecs.get((path, kept)) or _codecs.setdefault((path, kept), Codec(path, kept))


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", kept: int = KEPT) -> DataFrame:
    """One row per row: id, ids array<int>.

    A null text is empty and has no ids; ids of rows may be null or repeat. No shuffle: texts are encoded where they are
    read, long ones slice by slice, and other columns aren't read. A run of characters that can nowhere be cut is one unit of
    work, linear in its length. ``model`` is a path that every executor can open. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        c = codec(model, kept)
        for b in batches:
            for ids, texts in _groups(b):
                found = c.encode(texts)
                offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["id", "ids"])
        settle()

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(df: DataFrame, model: str, kept: int = KEPT) -> DataFrame:
    """Rows of :func:`encode` (id, ids; null ids: no text) with the column ``decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        c = codec(model, kept)
        for b in batches:
            lists = b.column("ids")
            flat, at = np.asarray(lists.values), np.asarray(lists.offsets)
            said = pa.array([c.decode(flat[s:e]) for s, e in zip(at, at[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), lists, said], ["id", "ids", "decoded"])
        settle()

    return df.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "id long, ids array<int>, decoded string")


def _groups(b: pa.RecordBatch) -> Iterator[tuple[list, list]]:
    """Rows of a batch, about GROUP code points at a time."""
    ids, texts, held = [], [], 0
    for i, t in zip(b.column(0), b.column(1)):
        ids.append(i.as_py())
        texts.append(t.as_py())
        held += len(texts[-1])
        if held >= GROUP:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts
