"""Language identification: averaged hashed subword embeddings with a linear softmax, and calibrated rejection.

A text's byte n-grams are hashed to embeddings, whose mean goes through a linear softmax. The model is trained by
stochastic gradient descent in numpy on a bounded sample of labelled rows. Beside the languages it learns a class of texts
in none of them, from texts made for it: letters of real texts in another order, random words, and scripts that no labelled
text is written in. The sample is parted by digests of the texts before anything is learnt. On passages of many lengths from
the texts that aren't trained on, and on made texts, a temperature makes the score a probability; the rejection
threshold is the score that so many made texts stay below, as long as it rejects few of the others. For prediction
embeddings and weights fold into one table of class scores for each bucket, so a text costs one gather per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialize, settle
from .textnp import ngram_ids

SIZES, BITS, DIM = (2, 3, 4), 15, 12
#: Bounds of the training sample: so many labelled rows of each language, those with the smallest digests of their ids, ...
PER_LANGUAGE = 500
#: ... fewer where there are many languages, so that all have this many at most, ...
ROWS = 8_000
#: ... and of this many classes, one of them for none of the languages, the others for those of the most rows. Rarer languages
#: are not learnt; ``Model.n_languages`` counts all.
LANGUAGES = 200
#: One text in so many is for calibration.
CALIBRATION = 5
#: Rows asked for beyond the sample, in standard deviations, so that a bound on the digests seldom keeps fewer.
SPARE = 2
#: Shares of texts in none of the languages that may be accepted, and of passages of LONG bytes and more that may be rejected.
MAY_ACCEPT, MAY_REJECT, LONG = 0.02, 0.002, 120
#: No threshold is above this score: a text whose language is the likelier one of two is kept.
MOST_THRESHOLD = 0.5
#: Lengths of the passages that calibration looks at beside the whole text.
PASSAGES = (8, 16, 32, 64, 160)
UNKNOWN = "und"
#: The class of texts in none of the languages; no label can sort before it.
NEITHER = ""
# Code points of scripts that texts are made of, where no labelled text has them.
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x531, 0x586), (0x5D0, 0x5EA), (0x621, 0x64A), (0x905, 0x939), (0x985, 0x9B9), (0xB85, 0xBB9), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x1200, 0x1248), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))

_space = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _clean(text: str) -> bytes:
    """Lower-cased, with everything but letters made a space."""
    return b" " + text.lower().encode().translate(_space) + b" "


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket x class, the last one neither of the languages
    bias: np.ndarray
    temperature: float
    threshold: float
    n_languages: int = 0

    def probabilities(self, text: str) -> np.ndarray:
        """Of each language, and last of none of them."""
        total, n = np.zeros(len(self.labels) + 1), 0
        for ids in ngram_ids(_clean(text), SIZES, BITS):
            total += self.table[ids].sum(axis=0)
            n += len(ids)
        return _softmax((total / max(n, 1) + self.bias)[None] / self.temperature)[0]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)[:-1]
        k = int(p.argmax())
        return self.labels[k], float(min(1.0, p[k]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def made_text(text: str, seed: int) -> str:
    """A passage in none of the languages, by turns: a text's letters in another order, random Latin words, or another script's.

    Which script depends on the seed alone; one that the text itself is written in is passed over for the next.
    """
    rng = np.random.default_rng(seed)
    at = int(rng.integers(0, max(1, len(text) - 400)))
    given = text[at : at + int(rng.choice((40, 120, 400)))]
    kind = seed % 3
    if kind == 0:
        letters = [c for c in given.lower() if c.isalpha()]
        rng.shuffle(letters)
        rest = iter(letters)
        return "".join(next(rest) if c.isalpha() else c for c in given.lower())
    first, last = 97, 122
    if kind == 2:
        used = {ord(c) for c in text if ord(c) > 0x2FF}
        for k in rng.permutation(len(SCRIPTS)).tolist():
            first, last = SCRIPTS[k]
            if not any(first <= c <= last for c in used):
                break
    # a text of a script uses some of its letters more than others, so only a part of a large one is drawn from
    some = rng.permutation(np.arange(first, last + 1))[:200]
    share = rng.dirichlet(np.full(len(some), 0.5 if kind == 2 else 5.0))
    said = [chr(c) for c in rng.choice(some, max(20, len(given)), p=share)]
    for i in np.flatnonzero(rng.random(len(said)) < 0.17).tolist():
        said[i] = " "
    return "".join(said)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, cal, text) to the distinct n-gram ids and counts of the text, and of a passage of it or, for one in three, a text made for it."""

    def counted(part: str) -> tuple[bytes, bytes]:
        n = np.zeros(1 << BITS, np.int64)
        for ids in ngram_ids(_clean(part), SIZES, BITS):
            n += np.bincount(ids, minlength=1 << BITS)
        k = np.flatnonzero(n)
        return k.astype("<u2").tobytes(), n[k].astype("<u4").tobytes()

    for b in batches:
        out: list[tuple] = []
        for lang, h, cal, text in zip(*[b.column(i).to_pylist() for i in range(4)]):
            n, turn = PASSAGES[h // 3 % len(PASSAGES)], h % 3
            at = h // 16 % max(1, len(text) - n + 1)
            more = (NEITHER, made_text(text, h // 3)) if turn == 0 else (lang, text[at : at + n])
            if any(c.isalpha() for c in text):
                out += [(of, h, cal, *counted(part)) for of, part in ((lang, text), more) if any(c.isalpha() for c in part)]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["lang", "h", "cal", "ids", "counts"])


def train(rows: list[tuple[str, bool, bytes, bytes]], updates: int = 12_000, rate: float = 0.5, seed: int = 1) -> Model:
    """Rows (language or NEITHER, whether it is for calibration, ids, counts), in a fixed order, to a model.

    Without any row for calibration, or for training, all rows serve for both.
    """
    labels = sorted({r[0] for r in rows} - {NEITHER})
    if not labels:
        return Model([], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, MOST_THRESHOLD)
    rng, place = np.random.default_rng(seed), {x: i for i, x in enumerate([*labels, NEITHER])}
    data = [(place[lang], np.frombuffer(ids, "<u2"), np.frombuffer(counts, "<u4")) for lang, _, ids, counts in rows]  # the sample is held once
    held = [d for d, r in zip(data, rows) if r[1]] or data
    used = [d for d, r in zip(data, rows) if not r[1]] or data
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    w, bias = rng.normal(0, 0.1, (DIM, len(place))), np.zeros(len(place))
    epochs = -(-updates // len(used))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(used)):
            y, ids, counts = used[i]
            share = counts / counts.sum()
            h = share @ emb[ids]
            g = _softmax((h @ w + bias)[None])[0]
            g[y] -= 1
            back = w @ g
            w -= lr * np.outer(h, g)
            bias -= 0.1 * lr * g
            # the step is scaled so that the mean embedding itself moves by the rate, however long the text
            emb[ids] -= (lr / (share @ share)) * share[:, None] * back[None]
    table = emb @ w
    logits = np.array([counts / counts.sum() @ table[ids] + bias for _, ids, counts in held])
    gold = np.array([y for y, _, _ in held])
    t = temperature(logits, gold)
    p = _softmax(logits / t)[:, :-1].max(axis=1)
    neither, long = gold == len(labels), np.array([counts.sum() >= LONG * len(SIZES) for _, _, counts in held])
    # so many made texts stay below it, unless it would reject more than a few real ones
    threshold = np.quantile(p[neither], 1 - MAY_ACCEPT) if neither.any() else 0.0
    own = p[~neither & long]
    most = np.quantile(own, MAY_REJECT) if len(own) else MOST_THRESHOLD
    return Model(labels, table.astype(np.float32), bias, t, float(min(MOST_THRESHOLD, most, max(threshold, MOST_THRESHOLD / 2))))


def temperature(logits: np.ndarray, gold: np.ndarray) -> float:
    """What logits are divided by so that probabilities of rows not trained on are right: least log loss over a wide grid.

    Rows that are all told right would ask for an ever smaller one; a row more that is told wrong, as a rule of succession has it,
    keeps probabilities as far from one as their number warrants.
    """
    grid = np.geomspace(0.01, 100, 161)
    n, right = len(gold), np.arange(len(gold))
    loss = []
    for t in grid:
        p = np.clip(_softmax(logits / t)[right, gold], 1e-12, 1 - 1e-12)
        loss.append(-np.log(p).sum() - np.log(1 - p).sum() / n)
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 over 4; such rows are never learnt from. False for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[tuple[str, bool, bytes, bytes]], int]:
    """(rows as :func:`train` takes them, number of languages in the table)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != NEITHER) & ~held_out(F.col("id"))).withColumn("h", F.shiftrightunsigned(F.xxhash64("id"), 1))
    # digests are uniform, so a bound on them keeps a little more than the sample; languages are counted before the shuffle
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n_languages = counts.count()
    per_language = max(1, min(per_language, ROWS // max(1, min(n_languages, LANGUAGES))))
    part = F.least(F.lit(1.0), (per_language + SPARE * per_language**0.5) / F.col("n"))
    limit = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES - 1).select("lang", (part * float(1 << 63)).alias("upto"))
    chosen = rows.join(F.broadcast(limit), "lang").where(F.col("h") <= F.col("upto"))  # fewer than LANGUAGES rows
    chosen = chosen.groupBy("lang", "h").agg(F.min("text").alias("text"))  # rows that repeat an id are one row of the sample
    chosen = chosen.select("lang", "h", (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(CALIBRATION)) == 0).alias("cal"), "text")
    got = chosen.mapInArrow(_features, "lang string, h long, cal boolean, ids binary, counts binary").toArrow()
    discard(counts)
    order = pc.sort_indices(got.select(["lang", "h"]), [("lang", "ascending"), ("h", "ascending")])
    out, of, ids = [], None, set()
    for r in (got.slice(i, 1).to_pylist()[0] for i in order.to_pylist()):
        if r["lang"] != of:
            of, ids = r["lang"], set()
        if of == NEITHER or r["h"] in ids or len(ids) < per_language:
            ids.add(r["h"])
            out.append((r["lang"], r["cal"], r["ids"], r["counts"]))
    return sorted(out), n_languages


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` labelled rows of each language that aren't held out (see LANGUAGES and ROWS).

    Rows without an id are not used; of rows that repeat an id and a language the one with the smallest text is. A text that
    several rows repeat is trained on or calibrated on, never both.
    """
    rows, n = sample(df, id_col, text_col, lang_col, per_language)
    model = train(rows)
    model.n_languages = n
    del rows
    settle()  # the sample was the driver's
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, accepted.

    Whole texts are read, however long. A text that is null, or has no letter, is ``und`` with score 0 and not accepted. The score is the language's probability beside the
    other languages and none of them. Of
    languages that are equally likely the first by code point is given. Neither ids nor other columns take part. Repeated
    rows get equal results; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # of bounded size: buckets times LANGUAGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(1)]
            lang, score = pa.array([g[0] for g in got], pa.string()), np.array([g[1] for g in got], np.float64)
            ok = np.array([g[0] != UNKNOWN and g[1] >= m.threshold for g in got], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), lang, pa.array(score), pa.array(ok)], ["id", "lang_pred", "score", "accepted"])
        settle()

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "id long, lang_pred string, score double, accepted boolean")


def accepted_only(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose language is accepted, with the same columns, in one pass."""
    shared, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        m = shared.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(at)]
            yield b.filter(pa.array([lang != UNKNOWN and score >= m.threshold for lang, score in got], pa.bool_()))
        settle()

    return df.mapInArrow(run, df.schema)
