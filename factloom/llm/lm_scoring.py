"""Language-model scores by masked pseudo-likelihood.

A window network predicts a masked word from the two words on either side: a hidden layer sums one learned row per position
and word; the output is a softmax over classes of words and one over the words of the class, with a learned row for each class
and each word, whose biases start at the corpus' own frequencies. The corpus is dealt into shards by
digests of its documents. Each round masks its own part of the positions, and the rounds together predict every position of
every document: each shard trains from the common parameters, and the results are averaged by number of targets. Scoring then
predicts every word of every text from both sides and sums the log-probabilities.

The MOST frequent words have ids of their own, down to those that the corpus has LEAST times: the number of ids is bounded by
what each shard's parameters may weigh. Other words share hashed buckets, and have a probability of their own in the
bucket: their share of its words in the whole corpus. This table has all such words, is never gathered, and is joined to
the distinct words of pieces of the corpus, so every word is scored with its own probability.

Shards, their order and what is masked come from digests of the documents alone, so neither partitions nor the order of rows
change the parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, settle
from .textnp import word_hashes
from .wordstore import chunks, normal, sum_blocks

#: A word that occurs so often (in a corpus of any size; fewer can't fit its rows) has an id of its own, if it is one of the MOST frequent.
LEAST, MOST = 32, 8192
#: Logits below this in size need no shift before they are raised.
SAFE = 60.0
#: Buckets of the other words.
BUCKETS = 512
HIDDEN, SIDE = 16, 2
RATE, FLOOR = 0.1, 1e-9
OFFSETS = (-2, -1, 1, 2)
#: The largest and the smallest batch; a shard that is small has smaller batches, for as many steps.
BATCH, LEAST_BATCH = 8192, 256
#: A corpus of fewer words is gone through several times, at most EPOCHS times.
ENOUGH_WORDS, EPOCHS = 2_000_000, 8
#: Bytes of text of a shard: its share of the root of the corpus, but no more than the second.
SHARD_BYTES, MOST_SHARD_BYTES = 100_000, 50_000_000
#: Words of a piece of the corpus, whose distinct rare words are looked up together.
PIECE = 2_000_000


class Net:
    """Parameters in one flat array; ``n``: number of ids, buckets included. The last column of output rows is the bias."""

    def __init__(self, n: int, flat: np.ndarray | None = None, seed: int = 5):
        self.n, self.side = n, max(2, math.ceil(n**0.5))
        self.classes, self.edge = -(-n // self.side), n
        sizes = {"rows": (len(OFFSETS) * (n + 1), HIDDEN), "bias": (HIDDEN,), "of_class": (self.classes, HIDDEN + 1), "of_word": (self.classes, self.side, HIDDEN + 1)}
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.3, s).ravel() if k == "rows" else np.zeros(math.prod(s)) for k, s in sizes.items()])
        self.flat, at = flat.astype(np.float32), 0
        for k, s in sizes.items():
            size = math.prod(s)
            setattr(self, k, self.flat[at : at + size].reshape(s))
            at += size

    def start(self, counts: np.ndarray) -> None:
        """Biases at the frequencies of the ids."""
        mass = np.full(self.classes * self.side, 1e-3)
        mass[: len(counts)] += counts
        mass = mass.reshape(self.classes, self.side)
        self.of_class[:, -1] = np.log(mass.sum(axis=1) / mass.sum())
        self.of_word[:, :, -1] = np.log(mass / mass.sum(axis=1, keepdims=True))

    def hidden(self, keys: np.ndarray) -> np.ndarray:
        """The hidden layer, and a column of ones behind it; ``keys``: rows by position of the window and target."""
        h = np.ones((keys.shape[1], HIDDEN + 1), np.float32)
        a = self.rows[keys[0]]
        for k in keys[1:]:
            a += self.rows[k]
        a += self.bias
        np.tanh(a, out=h[:, :HIDDEN])
        return h

    def bounded(self) -> bool:
        """Whether no logit can be larger than SAFE: hidden values are between -1 and 1, so a row's absolute sum bounds its logit."""
        return all(float(np.abs(w).sum(axis=-1).max()) <= SAFE for w in (self.of_class, self.of_word))

    def keys(self, context: np.ndarray) -> np.ndarray:
        return context + (np.arange(len(OFFSETS), dtype=np.int32) * (self.n + 1))[:, None]

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target, from its context (positions of the window x targets, as ids)."""
        h, cls, n = self.hidden(self.keys(context)), target // self.side, np.arange(len(target))
        safe = self.bounded()
        z = _shifted(h @ self.of_class.T, safe)
        out = z[n, cls]
        out -= np.log(np.exp(z, out=z).sum(axis=1))
        order, cuts, which = _by_class(cls)
        h, pick, inner = h[order], (target % self.side)[order], np.empty(len(target), np.float32)
        for s, t, c in zip(cuts, cuts[1:], which):
            z = _shifted(h[s:t] @ self.of_word[c].T, safe)
            inner[s:t] = z[n[: t - s], pick[s:t]] - np.log(np.exp(z, out=z).sum(axis=1))
        out[order] += inner
        return out


def _shifted(z: np.ndarray, safe: bool) -> np.ndarray:
    """Logits less the largest of each row, unless they are small anyway; softmax is the same, and never overflows."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    return z


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    k = cls[order]
    cuts = np.flatnonzero(np.diff(k, prepend=-1))
    return order, [*cuts.tolist(), len(k)], k[cuts].tolist()


class Trainer:
    """Adagrad steps on a copy of a net."""

    def __init__(self, net: Net, rate: float = RATE):
        self.net, self.past, self.rate, self.seen = Net(net.n, net.flat.copy()), Net(net.n, np.full(len(net.flat), FLOOR)), rate, 0

    def _step(self, name: str, grad: np.ndarray) -> None:
        past = getattr(self.past, name)
        past += grad * grad
        grad /= np.sqrt(past)
        grad *= self.rate
        here = getattr(self.net, name)
        here -= grad

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        net, m = self.net, len(target)
        keys, cls, n = net.keys(context), target // net.side, np.arange(m)
        h, safe = net.hidden(keys), net.bounded()
        g = _shifted(h @ net.of_class.T, safe)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[n, cls] -= 1
        back, of_class = g @ net.of_class[:, :HIDDEN], g.T @ h
        order, cuts, which = _by_class(cls)
        hs, pick, inner, of_word = h[order], (target % net.side)[order], np.empty((m, HIDDEN), np.float32), np.zeros(net.of_word.shape, np.float32)
        for s, t, c in zip(cuts, cuts[1:], which):
            here, w = hs[s:t], net.of_word[c]
            g = _shifted(here @ w.T, safe)
            np.exp(g, out=g)
            g /= g.sum(axis=1, keepdims=True)
            g[n[: t - s], pick[s:t]] -= 1
            np.matmul(g, w[:, :HIDDEN], out=inner[s:t])
            np.matmul(g.T, here, out=of_word[c])
        back[order] += inner
        back *= 1 - h[:, :HIDDEN] ** 2
        back /= m
        self._step("of_class", of_class / m)
        self._step("of_word", of_word / m)
        self._step("bias", back.sum(axis=0))
        flat = keys.ravel()
        order = np.argsort(flat.astype(np.uint16) if net.rows.shape[0] <= 1 << 16 else flat, kind="stable")
        k = flat[order]
        first = np.flatnonzero(np.diff(k, prepend=-1))
        grad, at = np.add.reduceat(back[order % m], first, axis=0), k[first]
        past = self.past.rows[at] + grad * grad
        self.past.rows[at] = past
        net.rows[at] -= self.rate * grad / np.sqrt(past)
        self.seen += m


class Vocabulary:
    """Ids of word hashes: the rank of a frequent word, or a bucket behind the ranks."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent.astype(np.uint32)
        self.order = np.argsort(self.frequent).astype(np.int32)
        self.sorted = self.frequent[self.order]
        # small enough for a core's cache
        self.slot = np.full(1 << 18, -1, np.int16)
        self.slot[(self.frequent >> 14)[::-1]] = np.arange(len(frequent), dtype=np.int16)[::-1]
        self.n = len(frequent) + BUCKETS

    def ids(self, words: np.ndarray) -> np.ndarray:
        at = self.slot[words >> 14].astype(np.int32)
        met = np.flatnonzero(at >= 0)
        miss = met[self.frequent[at[met]] != words[met]]
        if len(miss):  # two words in one slot: the later one is looked up
            p = np.minimum(np.searchsorted(self.sorted, words[miss]), len(self.sorted) - 1)
            at[miss] = np.where(self.sorted[p] == words[miss], self.order[p], -1)
        rare = at < 0
        at[rare] = len(self.frequent) + (words[rare] % BUCKETS).astype(np.int32)
        return at


def _padded(words: list[np.ndarray], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of some texts with edges before, between and after them; where the words are; the length of each text."""
    lengths = np.array([len(w) for w in words], np.int64)
    padded = np.full(int(lengths.sum()) + SIDE * (len(words) + 1), vocabulary.n, np.int32)
    where = np.repeat(SIDE * np.arange(1, len(words) + 1), lengths) + np.arange(int(lengths.sum()))
    padded[where] = vocabulary.ids(np.concatenate(words))
    return padded, where, lengths


def _context(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([ids[at + o] for o in OFFSETS])


def _masked(digest: int, length: int, r: int, rounds: int) -> np.ndarray:
    """The positions of a document to predict in a round, from its digest: each position is in one round."""
    h = (np.arange(length, dtype=np.uint64) + np.uint64(digest & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)) % np.uint64(rounds) == r


# -- over the corpus ----------------------------------------------------------------------------------------------------


def shards_of(text_bytes: int) -> int:
    """Shards grow with the root of a corpus; from 25 GB on with the corpus."""
    return max(1, math.ceil((text_bytes / SHARD_BYTES) ** 0.5), math.ceil(text_bytes / MOST_SHARD_BYTES))


def dealt_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(shard, digest, id, words) for every row: hashed words, sorted by digest in shards that lie in one file each.

    Rows that repeat id and text more often than an eighth of a shard's even share of the rows are counted first and dealt
    evenly over the shards, so no shard is filled by one row's copies; such rows are fewer than eight to a shard.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    shards = shards_of(size.bytes or 0)
    rows = rows.select(F.xxhash64("id", "text").alias("key"), F.coalesce(F.xxhash64("text"), F.lit(0).cast("long")).alias("digest"), "id", "text", F.lit(1).cast("long").alias("n"))
    if shards > 1:
        hot = materialize(rows.groupBy("key").count().where(F.col("count") > max(1.0, size.rows / (8 * shards))).select("key"), "hot")
        if hot.head(1):
            of = F.broadcast(hot)  # fewer than eight keys to a shard, that is 64 bytes to 50 MB of text of a large corpus
            copies = rows.join(of, "key", "left_semi").groupBy("key", "digest", "id", "text").agg(F.count("*").alias("n"))
            rows = rows.join(of, "key", "left_anti").unionByName(copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            at, texts = 0, b.column(3)
            while at < b.num_rows:  # a few MB of text at a time
                part: list[bytes] = []
                held = 0
                while at + len(part) < b.num_rows and held < 1 << 21:
                    part.append(normal(texts[at + len(part)].as_py()))
                    held += len(part[-1])
                words = pa.array([w.astype("<u4").tobytes() for w in word_hashes(part)], pa.binary())
                kept = [b.column(k).slice(at, len(part)) for k in (0, 1, 2, 4)]
                yield pa.RecordBatch.from_arrays([*kept, words], ["key", "digest", "id", "n", "words"])
                at += len(part)
        settle()

    hashed = rows.mapInArrow(run, "key long, digest long, id long, n long, words binary")
    # copy j of a row is in shard key + j; those of one shard are made after the shuffle
    dealt = hashed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(shards)) - 1)))
    dealt = dealt.select(F.pmod(F.col("key") + F.col("j"), F.lit(shards)).cast("int").alias("shard"), "digest", "id", "words", F.ceil((F.col("n") - F.col("j")) / shards).alias("m"))
    n = max(2 * shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every = dealt.repartition(n, "shard").withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).drop("m")
    store = materialize(every.sortWithinPartitions("shard", "digest", "id"), "words")
    if shards > 1:
        discard(hot)
    return store


def by_shard(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[int, bool, list[int], list[np.ndarray]]]:
    """(shard, whether it ends here, digests, words) of rows that are sorted by shard, about ``most`` words at a time."""
    shard, digests, words, held = None, [], [], 0
    for b in batches:
        for s, d, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
            a = np.frombuffer(w.as_buffer(), "<u4")
            if s != shard or held and held + len(a) > most:
                if shard is not None:
                    yield shard, s != shard, digests, words
                shard, digests, words, held = s, [], [], 0
            digests.append(d), words.append(a)
            held += len(a)
    if shard is not None:
        yield shard, True, digests, words


def word_counts(store: DataFrame) -> DataFrame:
    """(word, n) for every word hash of the whole corpus, counted in every partition and then by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        words, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for _, group in chunks(batches, 1 << 22):
            w, c = np.unique(np.concatenate(group), return_counts=True)
            words, inv = np.unique(np.concatenate([words, w]), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([n, c]), minlength=len(words)).astype(np.int64)
            if len(words) > 1 << 20:  # counts are sums, so they may be given in parts
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int32)), pa.array(n)], ["word", "n"])
                words, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int32)), pa.array(n)], ["word", "n"])
        settle()

    return materialize(store.select("id", "words").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def frequent_words(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, counts) of the words with an id of their own, by count, and behind the counts those of the buckets."""
    often = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "word").limit(MOST).toArrow()
    words, n = np.asarray(often["word"]).astype(np.int32).view(np.uint32), np.asarray(often["n"]).astype(np.int64)
    total = np.zeros(BUCKETS, np.int64)
    every = counts.groupBy(F.col("word").bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.sum("n").alias("n"))
    for r in every.collect():  # a fixed number of buckets
        total[r.bucket] = r.n
    np.subtract.at(total, words % BUCKETS, n)
    return words, np.concatenate([n, total])


def shares(counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """(word, own): the log-probability of each word in its bucket; ``totals``: of the buckets.

    A word with an id of its own has a row, too, which no text asks for.
    """
    each = F.element_at(F.array(*[F.lit(float(max(1, n))) for n in totals.tolist()]), F.col("word").bitwiseAND(BUCKETS - 1) + 1)
    return counts.select("word", (F.log(F.col("n").cast("double")) - F.log(each)).alias("own"))


BLOCK = 1 << 14


def train_shard(net: Net, vocabulary: Vocabulary, parts: Iterator[tuple[list[int], list[np.ndarray]]], r: int, rounds: int, rate: float, epochs: int, batch: int) -> Trainer:
    """Parameters after a round over one shard, given as (digests, words) of its documents in a fixed order."""
    trainer, rng = Trainer(net, rate), np.random.default_rng(r)
    kept = list(parts) if epochs > 1 else parts  # a corpus that is gone through often is small
    for _ in range(epochs):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for digests, words in kept:
            if not sum(map(len, words)):
                continue
            padded, where, lengths = _padded(words, vocabulary)
            at = rng.permutation(where[np.concatenate([_masked(d, int(n), r, rounds) for d, n in zip(digests, lengths)])])
            held.append((_context(padded, at), padded[at]))
            _steps(trainer, held, batch, False)
        _steps(trainer, held, batch, True)
    return trainer


def _steps(trainer: Trainer, held: list[tuple[np.ndarray, np.ndarray]], batch: int, last: bool) -> None:
    if not held:
        return
    context, target = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
    at = 0
    while len(target) - at >= batch or last and at < len(target):
        trainer.step(context[:, at : at + batch], target[at : at + batch])
        at += batch
    held[:] = [(context[:, at:], target[at:])] if at < len(target) else []


def train(store: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, rounds: int = 2) -> Net:
    """Parameters after ``rounds`` of training in every shard, over all documents, and averaging."""
    spark, net, total = store.sparkSession, Net(vocabulary.n), int(counts.sum())
    net.start(counts)
    if not total:
        return net
    shards = store.select("shard").distinct().count()
    epochs = min(EPOCHS, math.ceil(ENOUGH_WORDS / total))
    batch = int(min(BATCH, max(LEAST_BATCH, total / shards / rounds / 64)))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net.flat, vocabulary))
        rate = RATE / (1 + r) ** 0.5

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r, rate=rate) -> Iterator[pa.RecordBatch]:
            lean()
            flat, vocab = shared.value
            rest = by_shard(batches)
            for shard, ends, digests, words in rest:

                def parts(ends=ends, digests=digests, words=words):
                    yield digests, words
                    while not ends:
                        _, ends, digests, words = next(rest)
                        yield digests, words

                trainer = train_shard(Net(vocab.n, flat), vocab, parts(), r, rounds, rate, epochs, batch)
                if trainer.seen:
                    data = np.concatenate([trainer.net.flat * np.float32(trainer.seen), np.array([trainer.seen], np.float32)])
                    blocks = [data[k : k + BLOCK].tobytes() for k in range(0, len(data), BLOCK)]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["part", "block", "data"])
                del trainer
            settle()

        got = sum_blocks(store.mapInArrow(run, "part int, block int, data binary"), "<f4", shards)
        shared.unpersist()
        data = np.concatenate([np.frombuffer(b, "<f8") for _, b in got])
        net = Net(vocabulary.n, data[:-1] / data[-1])
    return net


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """One row per input row: id, n_words, mean (per word; null without words), log_likelihood (sum over all words).

    Null and empty texts, and texts without letters or digits, have no words and a sum of 0. Texts of any length are scored
    whole. Repeated rows get equal scores. Only the two columns are read; an empty table gives no rows. The whole corpus is
    counted and trained on. Scores don't depend on partitions or on the order of rows, but for rounding.
    """
    store = dealt_words(df, id_col, text_col)
    counts = word_counts(store)
    frequent, n = frequent_words(counts)
    vocabulary = Vocabulary(frequent)
    net = train(store, vocabulary, n, rounds)
    shared = df.sparkSession.sparkContext.broadcast((net.flat, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents, with their rare words, and behind those of each piece a row with its distinct rare words."""
        lean()
        flat, vocab = shared.value
        net, piece, held, met = Net(vocab.n, flat), TaskContext.get().partitionId() << 32, 0, []
        names = ["piece", "id", "n_words", "total", "rare", "distinct"]

        def distinct() -> pa.RecordBatch:
            d = np.unique(np.concatenate(met)).view(np.int32)
            cols = [pa.array([piece]), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.array([0.0]), pa.array([b""], pa.binary()), pa.array([d], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, names)

        for doc_ids, words in chunks(batches):
            padded, where, lengths = _padded(words, vocab)
            ids, logp = padded[where], np.zeros(len(where))
            for at in range(0, len(where), BATCH):
                some = slice(at, at + BATCH)
                logp[some] = net.log_probability(_context(padded, where[some]), ids[some])
            text = np.repeat(np.arange(len(lengths)), lengths)
            total = np.bincount(text, weights=logp, minlength=len(lengths)).astype(np.float64)
            flag = ids >= len(vocab.frequent)
            rare, ends = np.concatenate(words)[flag], np.cumsum(np.bincount(text[flag], minlength=len(lengths)))
            blobs = [x.tobytes() for x in np.split(rare, ends[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc_ids), piece)), pa.array(doc_ids, pa.int64()), pa.array(lengths), pa.array(total), pa.array(blobs, pa.binary()), pa.nulls(len(doc_ids), pa.list_(pa.int32()))], names)
            met.append(np.unique(rare))
            held += len(where)
            if held >= PIECE:
                yield distinct()
                piece, held, met = piece + 1, 0, []
        if met:
            yield distinct()
        settle()

    scored = materialize(store.select("id", "words").mapInArrow(run, "piece long, id long, n_words long, total double, rare binary, distinct array<int>"), "scored")
    discard(store)
    own = scored.where("n_words < 0").select(F.col("piece").alias("of"), F.explode("distinct").alias("word")).join(shares(counts, n[len(frequent) :]), "word")
    docs = scored.where("n_words >= 0").select("piece", "id", "n_words", "total", "rare")
    return docs.groupBy("piece").cogroup(own.groupBy("of")).applyInArrow(_with_own, "id long, n_words long, mean double, log_likelihood double")


def _with_own(docs: pa.Table, own: pa.Table) -> pa.Table:
    """The documents of a piece, and the log-probabilities of its distinct rare words in their buckets, to scores."""
    word, value = np.asarray(own.column("word")).view(np.uint32), np.asarray(own.column("own"))
    order = np.argsort(word)
    word, value = word[order], value[order]
    n, blobs = np.asarray(docs.column("n_words")), docs.column("rare").to_pylist()
    rare = np.frombuffer(b"".join(blobs), "<u4")
    text = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
    each = value[np.searchsorted(word, rare)] if len(rare) else np.zeros(0)
    total = np.asarray(docs.column("total")) + np.bincount(text, weights=each, minlength=len(blobs))
    mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
    return pa.table({"id": docs.column("id"), "n_words": docs.column("n_words"), "mean": mean, "log_likelihood": pa.array(total)})
