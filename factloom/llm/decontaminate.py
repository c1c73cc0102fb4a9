"""Benchmark decontamination by latent semantic retrieval.

1. The corpus is hashed to words once. Document frequencies count, for each hashed term, the passages of 32 words it is in.
2. A distributed randomised decomposition: with A the TF-IDF matrix of all passages of the corpus (its columns are the terms
   of the benchmark; no other term can add to a product with an item) and of the benchmark's items, every partition adds its
   rows' share of A'(A R) for a random R; the driver gets this sum, of fixed size, and takes the singular vectors from it (a
   Nystrom factorisation of A'A). There is one decomposition, and one search, for a benchmark of up to ITEM_WORDS words.
3. Windows of each item's own length, up to half as long again, are projected, and the cosines of their TF-IDF vectors (over
   all terms) with the items, taken in the latent space, give the candidates. So does, whatever it weighs, every place in a
   text where a run of an item's words stands in the item's order: runs are so short that a copy in which words are replaced,
   but few enough to be sure (see SURE), always keeps one.
4. Each candidate is checked on the words themselves: the longest common subsequence of item and passage, and for
   paraphrases also that of the item's answer (what follows "Answer:", or its last sentence).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, lean, materialize, settle
from .textnp import word_hashes
from .wordstore import chunks, hashed_words, normal, sum_blocks

TERM_BITS, PASSAGE, BLOCK = 17, 32, 8
#: Dimensions of the latent space, and random directions beyond them.
RANK, EXTRA = 96, 16
#: A benchmark of more words is looked for in sets of so many, so that each set fits in memory.
ITEM_WORDS = 1 << 16
#: Least cosine of a window with an item.
COSINE = 0.4
#: An item of fewer words is looked for as it stands, word by word; around shorter items than SHORT less is searched.
LEAST_WORDS, SHORT = 5, 16
#: Candidates that are held at once.
HELD = 1 << 18
#: Common subsequence over item length: enough alone, or together with the answer's.
SURE, PARAPHRASE, ANSWER = 0.75, 0.55, 0.6


def span_of(n: int) -> int:
    """Words of the windows in which an item of ``n`` words is looked for: 16, 24, 32, 48, 64, 96, ..."""
    size = 2 * BLOCK
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def run_length(n: int) -> int:
    """Words of the runs by which an item of ``n`` words is looked for.

    A copy that is sure has all but ``n - ceil(SURE * n)`` words; these part the item into one run more, the longest of
    which has at least so many words. Three are enough for all lengths but 5 and 8. Items of fewer than five are one run.
    """
    if n < LEAST_WORDS:
        return n
    missing = n - int(np.ceil(SURE * n))
    return min(3, n // (missing + 1))


def lcs_length(item_masks: dict[int, int], n: int, words: list[int]) -> int:
    """Longest common subsequence by bit-parallel dynamic programming; ``item_masks``: word to the bits of its places."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = item_masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def answer_of(text: str) -> str:
    said = re.split(r"(?i)\banswer\s*:", text)
    if len(said) > 1:
        return said[-1]
    sentences = [s for s in re.split(r"[.!?\n]+", text) if len(s.split()) >= 3]
    return sentences[-1] if sentences else text


def segment_sums(table: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``table[at]`` over segments of ``at``, none of them empty; a few hundred rows are held at a time.

    Segments are cut in pieces of 32, and pieces of like length are added up together, one place after the other.
    """
    lengths = np.diff(np.append(starts, len(at)))
    pieces = -(-lengths // 32)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    begin = np.repeat(starts - 32 * first, pieces) + 32 * np.arange(int(pieces.sum()))
    size = np.minimum(32, np.repeat(starts + lengths, pieces) - begin)
    out, order, row = np.empty((len(begin), table.shape[1]), table.dtype), np.argsort(-size, kind="stable"), np.empty((256, table.shape[1]), table.dtype)
    for k in range(0, len(order), 256):
        some = order[k : k + 256]
        total = np.take(table, at[begin[some]], axis=0)
        for place in range(1, int(size[some[0]])):
            n = int((size[some] > place).sum())
            np.take(table, at[begin[some[:n]] + place], axis=0, out=row[:n], mode="clip")
            total[:n] += row[:n]
        out[some] = total
    return out if len(out) == len(starts) else segment_sums(out, np.arange(len(out)), first)


def document_frequencies(store: DataFrame) -> tuple[np.ndarray, int]:
    """(number of passages each hashed term is in, number of passages), over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        n, total = np.zeros(1 << TERM_BITS, np.int64), 0
        for _, words in chunks(batches):
            passage, seen = [], 0
            for w in words:
                passage.append(seen + np.arange(len(w)) // PASSAGE)
                seen += -(-len(w) // PASSAGE)
            kind = np.uint32 if seen < 1 << (32 - TERM_BITS) else np.int64
            key = np.concatenate(passage).astype(kind) << TERM_BITS | (np.concatenate(words) >> (32 - TERM_BITS)).astype(kind)
            key.sort()
            n += np.bincount(key[np.flatnonzero(np.diff(key, prepend=~key[:1]))] & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
            total += seen
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], total))], ["term", "n"])

    out, total = np.zeros(1 << TERM_BITS, np.int64), 0
    for r in store.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a fixed number of terms
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Digests of the runs of ``k`` words."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ words[i : i + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Items:
    """A set of benchmark items with their terms and latent vectors."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, least_words: int = 1):
        self.ids, self.idf = [r[0] for r in rows], idf.astype(np.float32)
        self.words = [w.tolist() for w in word_hashes([normal(t) for _, t in rows])]
        self.answers = [w.tolist() for w in word_hashes([normal(answer_of(t or "")) for _, t in rows])]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.terms = np.unique(np.array([w for ws in self.words for w in ws], np.uint32))
        self.slot = np.full(1 << 20, -1, np.int32)
        self.slot[(self.terms >> 12)[::-1]] = np.arange(len(self.terms), dtype=np.int32)[::-1]
        self.weight = self.idf[self.terms >> (32 - TERM_BITS)]
        self.rank, self.basis, self.latent = min(RANK, len(self.terms)), None, None
        self.wanted = [i for i, ws in enumerate(self.words) if len(ws) >= max(1, least_words)]
        self.places = [np.searchsorted(self.terms, np.array(ws, np.uint32)) for ws in self.words]
        self.runs = {}
        for k in sorted({run_length(len(self.words[i])) for i in self.wanted}):
            found = sorted((int(h), i, at) for i in self.wanted if run_length(len(self.words[i])) == k for at, h in enumerate(runs(np.array(self.words[i], np.uint32), k)))
            h, item, at = (np.array([f[c] for f in found], t) for c, t in enumerate((np.uint64, np.int64, np.int64)))
            met = np.zeros(1 << 20, bool)
            met[(h >> np.uint64(44)).astype(np.int64)] = True
            self.runs[k] = (h, item, at, met)
        self.spans: dict[int, np.ndarray] = {}
        for i in (i for i in self.wanted if len(self.words[i]) >= LEAST_WORDS):
            self.spans.setdefault(span_of(len(self.words[i])), []).append(i)
        self.spans = {k: np.array(v) for k, v in self.spans.items()}
        # whether an item has a term, by a digest of both: never no where the answer is yes
        self.has = np.zeros(1 << 22, bool)
        for i, ws in enumerate(self.words):
            self.has[_pair(np.searchsorted(self.terms, np.array(ws, np.uint32)), i)] = True
        self.masks, self.answer_masks = [masks(w) for w in self.words], [masks(w) for w in self.answers]

    def index(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the terms, -1 for others."""
        at = self.slot[words >> 12]
        # two terms in one slot: the later one is looked up
        known = np.flatnonzero(at >= 0)
        miss = known[self.terms[at[known]] != words[known]]
        if len(miss):
            w = words[miss]
            p = np.minimum(np.searchsorted(self.terms, w), len(self.terms) - 1)
            at[miss] = np.where(self.terms[p] == w, p, -1)
        return at

    def power(self, words: np.ndarray) -> np.ndarray:
        """Squared weights of words, terms of the benchmark or not."""
        return self.idf[words >> (32 - TERM_BITS)] ** 2

    def cosine(self, words: np.ndarray, item: int) -> float:
        at = self.index(words)
        return float(self.basis[at[at >= 0]].sum(axis=0) @ self.latent[item] / max(float(self.power(words).sum()) ** 0.5, 1e-9))

    def own_rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each item's row of the matrix."""
        for ws in self.words:
            at, n = np.unique(np.searchsorted(self.terms, np.array(ws, np.uint32)), return_counts=True)
            yield at, n * self.weight[at].astype(np.float64)

    def settle(self, sketch: np.ndarray, probes: np.ndarray) -> None:
        """Latent basis from the sketch A'A R of the corpus. The items are rows too, in weight equal to all of the corpus."""
        own, mine = np.zeros(probes.shape), 0.0
        for at, w in self.own_rows():
            own[at] += w[:, None] * (w @ probes[at])[None]
            mine += float(w @ w)
        energy = float((sketch * probes).sum() / probes.shape[1])
        y = sketch + max(1.0, energy / max(mine, 1e-9)) * own
        core = probes.T @ y
        value, vector = np.linalg.eigh((core + core.T) / 2)
        good = value > 1e-9 * max(value.max(), 1e-12)
        left = np.linalg.svd(y @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)[0]
        self.basis = np.ascontiguousarray(left[:, : self.rank] * self.weight[:, None]).astype(np.float32)
        raw = np.zeros((len(self.words), self.basis.shape[1]), np.float32)
        for i, ws in enumerate(self.words):
            if ws:
                raw[i] = self.basis[np.searchsorted(self.terms, np.array(ws, np.uint32))].sum(axis=0)
        self.latent = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)


def _pair(term: np.ndarray, item: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (np.asarray(term).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(item).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        h *= np.uint64(0xFF51AFD7ED558CCD)
    return (h >> np.uint64(42)).astype(np.int64)


def _probes(items: Items, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(len(items.terms), min(items.rank + EXTRA, max(1, len(items.terms))))).astype(np.float32)


def _sketch(store: DataFrame, items: Items) -> np.ndarray:
    """A'(A R) over all passages of the corpus."""
    shared, rows = store.sparkSession.sparkContext.broadcast(items), 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        it = shared.value
        probes = _probes(it) * it.weight[:, None]
        total = np.zeros(probes.shape, np.float64)
        for _, words in chunks(batches, 1 << 15):
            at = it.index(np.concatenate(words))
            first = np.cumsum([0, *[-(-len(w) // PASSAGE) for w in words[:-1]]])
            tile = np.concatenate([f + np.arange(len(w)) // PASSAGE for f, w in zip(first, words)])
            ok = at >= 0
            at, tile = at[ok], tile[ok]
            if not len(at):
                continue
            starts = np.flatnonzero(np.diff(tile, prepend=-1))
            y, place = segment_sums(probes, at, starts), np.cumsum(np.diff(tile, prepend=tile[0]) > 0)
            order = np.argsort(at, kind="stable")
            by = np.flatnonzero(np.diff(at[order], prepend=-1))
            total[at[order][by]] += segment_sums(y, place[order], by) * it.weight[at[order][by]][:, None]
        part, blocks = TaskContext.get().partitionId(), range(0, len(total), rows)
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array([total[k : k + rows].tobytes() for k in blocks], pa.binary())], ["part", "block", "data"])
        settle()

    got = sum_blocks(store.mapInArrow(run, "part int, block int, data binary"), "<f8", store.rdd.getNumPartitions())
    shared.unpersist()
    probes = _probes(items)
    return np.concatenate([np.frombuffer(b, "<f8").reshape(-1, probes.shape[1]) for _, b in got]) if got else np.zeros(probes.shape)


class Chunk:
    """Some texts, their words one after the other, and the places of these among the terms."""

    def __init__(self, words: list[np.ndarray], items: Items):
        self.items, self.flat = items, np.concatenate(words)
        self.end = np.cumsum([len(w) for w in words])
        self.start = self.end - [len(w) for w in words]
        self.at = items.index(self.flat)
        self.present: np.ndarray | None = None

    def by_runs(self) -> Iterator[np.ndarray]:
        """Candidates (text, item, first word) where runs of an item's words are; the first word may be before the text.

        Where a run that many items have is at many places, they come a bounded number at a time, and only of items that the
        text has enough words of.
        """
        for k, (known, item, place, met) in self.items.runs.items():
            h = runs(self.flat, k)
            at = np.flatnonzero(met[(h >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(known, h[at]), np.searchsorted(known, h[at], "right")
            text = np.searchsorted(self.end, at, "right")
            ok = (high > low) & (at + k <= self.end[np.minimum(text, len(self.end) - 1)])
            at, low, n, text = at[ok], low[ok], (high - low)[ok], text[ok]
            if not len(at):
                continue
            total = np.cumsum(n)
            cuts = np.flatnonzero(np.diff((total - 1) // HELD, prepend=-1)).tolist()
            for s, e in zip(cuts, [*cuts[1:], len(at)]):
                m, t = n[s:e], np.repeat(text[s:e], n[s:e])
                j = np.repeat(low[s:e] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
                c = np.stack([t, item[j], np.repeat(at[s:e], m) - place[j] - self.start[t]], axis=1)
                yield c if total[-1] <= HELD else c[self.enough(c)]

    def enough(self, c: np.ndarray) -> np.ndarray:
        """Whether the whole text of a candidate has as many of its item's words as a copy must have."""
        it, kinds = self.items, len(self.items.terms)
        if self.present is None:
            ok = np.flatnonzero(self.at >= 0)
            self.present = np.unique(np.searchsorted(self.end, ok, "right") * kinds + self.at[ok])
        pairs, which = np.unique(c[:, 0] * len(it.n) + c[:, 1], return_inverse=True)
        text, item = np.divmod(pairs, len(it.n))
        n = it.n[item]
        key = np.repeat(text, n) * kinds + np.concatenate([it.places[i] for i in item.tolist()])
        has = self.present[np.minimum(np.searchsorted(self.present, key), len(self.present) - 1)] == key
        return (np.add.reduceat(has.astype(np.int64), np.cumsum(n) - n) >= PARAPHRASE * n)[which]

    def by_cosine(self) -> Iterator[np.ndarray]:
        """Candidates (text, item, first word): of overlapping windows that are like an item, the one most like it."""
        it, length = self.items, self.end - self.start
        blocks = -(-length // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(length)), blocks)
        block = np.repeat(first[:-1], length) + (np.arange(len(self.flat)) - np.repeat(self.start, length)) // BLOCK
        ok = np.flatnonzero(self.at >= 0)
        if not len(ok):
            return
        # single precision: of the sums over a hundred thousand words a thousandth of a cosine is lost at most
        sums = np.zeros((int(first[-1]) + 1, it.basis.shape[1]), np.float32)
        starts = np.flatnonzero(np.diff(block[ok], prepend=-1))
        sums[block[ok][starts] + 1] = segment_sums(it.basis, self.at[ok], starts)
        np.cumsum(sums, axis=0, out=sums)
        power = np.concatenate([[0], np.cumsum(np.bincount(block, it.power(self.flat), int(first[-1])))])
        last = first[text + 1]
        for span, own in it.spans.items():
            size, latent = span // BLOCK, np.ascontiguousarray(it.latent[own].T)
            step = max(1, size // 4)
            begin = np.flatnonzero((np.arange(len(text)) - first[text]) % step == 0) if step > 1 else np.arange(len(text))
            # a bounded number of cosines at a time; windows that overlap over the end of such a block give two candidates in place of one
            for b in np.array_split(begin, -(-len(begin) // min(4096, max(64, (1 << 20) // len(own))))):
                e = np.minimum(b + size, last[b])
                vec = sums[e]
                vec -= sums[b[0] : b[-1] + 1 : step] if step == 1 else sums[b]
                cosine = vec @ latent
                cosine *= (1 / np.sqrt(np.maximum(power[e] - power[b], 1e-9))).astype(np.float32)[:, None]
                w, i = np.divmod(np.flatnonzero(cosine.ravel() >= COSINE), len(own))
                if not len(w):
                    continue
                f = np.stack([text[b[w]], own[i], (b[w] - first[text[b[w]]]) * BLOCK, -cosine[w, i] * 1e6], axis=1).astype(np.int64)
                f = f[np.lexsort((f[:, 2], f[:, 1], f[:, 0]))]
                # windows of one text and item that overlap
                cut = (np.diff(f[:, 0], prepend=-1) != 0) | (np.diff(f[:, 1], prepend=-1) != 0) | (np.diff(f[:, 2], prepend=0) > span // 2)
                group = np.cumsum(cut) - 1
                best = f[np.lexsort((f[:, 3], group))]
                yield best[np.concatenate([[0], np.flatnonzero(np.diff(np.sort(group))) + 1]), :3]

    def candidates(self) -> np.ndarray:
        """Distinct candidates (text, item, first word) whose window has enough of the item's words to be one."""
        good, held, size = [np.zeros((0, 3), np.int64)], [], 0
        for c in chain(self.by_runs(), self.by_cosine()):
            held.append(c)
            size += len(c)
            if size >= HELD:
                good.append(self._likely(held))
                held, size = [], 0
        if held:
            good.append(self._likely(held))
        return np.unique(np.concatenate(good), axis=0)

    def _likely(self, found: list[np.ndarray]) -> np.ndarray:
        c = np.unique(np.concatenate(found), axis=0)
        c = c[self.enough(c)] if len(c) > 4096 else c
        good = np.zeros(len(c), bool)
        n = self.items.n[c[:, 1]]
        for span in np.unique(n).tolist():
            which = np.flatnonzero(n == span)
            for k in range(0, len(which), max(1, (1 << 20) // (4 * span))):
                some = which[k : k + max(1, (1 << 20) // (4 * span))]
                low, high = self.window(*c[some].T)
                at = low[:, None] + np.arange(int((high - low).max()))
                term = np.where(at < high[:, None], self.at[np.minimum(at, len(self.at) - 1)], -1)
                has = self.items.has[_pair(np.maximum(term, 0), c[some, 1][:, None])] & (term >= 0)
                good[some] = has.sum(axis=1) >= PARAPHRASE * span
        return c[good]

    def window(self, text: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place + 1, in all words, of what is compared with the item: the window, and as much around it."""
        n = self.items.n[item]
        wide, span = np.where(n < SHORT, n // 2, n), np.where(n < SHORT, n, n + n // 2)
        at = self.start[text] + begin
        return np.maximum(at - wide, self.start[text]), np.minimum(at + span + wide, self.end[text])


def check(words: list[int], item: int, items: Items) -> tuple[float, float]:
    """Shares of the item and of its answer that some words have in order."""
    n, a = len(items.words[item]), len(items.answers[item])
    return lcs_length(items.masks[item], n, words) / n, lcs_length(items.answer_masks[item], a, words) / a if a else 0.0


def is_copy(share: float, answer: float) -> bool:
    return share >= SURE or share >= PARAPHRASE and answer >= ANSWER


def _search(store: DataFrame, items: Items) -> DataFrame:
    shared = store.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        it = shared.value
        for ids, words in chunks(batches):
            chunk, best = Chunk(words, it), {}
            found = chunk.candidates()
            low, high = chunk.window(*found.T) if len(found) else ((), ())
            for (t, i, _), s, e in zip(found.tolist(), low, high):
                if best.get((t, i), (0,))[0] < 1.0:
                    share, answer = check(chunk.flat[s:e].tolist(), i, it)
                    if is_copy(share, answer) and (share, answer) > best.get((t, i), (0.0, 0.0))[:2]:
                        best[t, i] = (share, answer, s, e)
            if best:
                rows = [(ids[t], it.ids[i], share, answer, it.cosine(chunk.flat[s:e], i)) for (t, i), (share, answer, s, e) in best.items()]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]], ["id", "item_id", "lcs_share", "answer_share", "cosine"])
        settle()

    return store.mapInArrow(run, "id long, item_id long, lcs_share double, answer_share double, cosine double")


def find(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_words: int = 1) -> DataFrame:
    """(id, item_id, lcs_share, answer_share, cosine): one row for each document row and item that it contains.

    Null and empty texts contain nothing; items that are null, or have fewer than ``least_words`` words, are not looked for;
    those of one to four words are found where all of them stand one after the other. Texts of any length are searched whole. Rows that repeat a document each get their rows; a repeated item is one item per row. Only
    the named columns are read. An empty table on either side gives no rows. The benchmark is read in sets of bounded
    size, one decomposition and one search each, so no broadcast grows with it.
    """
    spark, schema = df.sparkSession, "id long, item_id long, lcs_share double, answer_share double, cosine double"
    store = hashed_words(df, id_col, text_col)
    n, total = document_frequencies(store)
    idf = np.log((1.0 + total) / (1.0 + n))
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{item_text_col}`").alias("t")).where("t is not null").orderBy("i", "t")
    out, group, held = spark.createDataFrame([], schema), [], 0

    def flush(out: DataFrame) -> DataFrame:
        items = Items(group, idf, least_words)
        if not items.wanted:
            return out
        items.settle(_sketch(store, items), _probes(items))
        return out.union(_search(store, items))

    for r in rows.toLocalIterator():
        group.append((r.i, r.t))
        held += len(r.t.split())
        if held >= ITEM_WORDS:
            out, group, held = flush(out), [], 0
    found = materialize(flush(out) if group else out, "contaminated")
    discard(store)  # as large as the words of the corpus; what was found is written
    return found


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text contains no item, with the same columns.

    Rows are judged by their texts, told apart by a digest, so neither null nor repeated ids matter. Null texts stay.
    """
    name = free_name(df, "text_digest")
    keyed = df.withColumn(name, F.xxhash64(F.col(f"`{text_col}`")))
    found = find(keyed, benchmark, name, text_col).select(F.col("id").alias(name)).distinct()
    return keyed.where(F.col(f"`{text_col}`").isNull()).unionByName(keyed.where(F.col(f"`{text_col}`").isNotNull()).join(found, name, "left_anti")).select(*[F.col(f"`{c}`") for c in df.columns])
