"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word, of its first four
characters and of its last four, so that unseen forms of a known stem still count.
Filters of several widths slide over the word vectors; each filter's largest value over
the *whole* text (max pooling), through a ReLU, feeds a logistic output.  Only the text
enters a score.  Thresholds are calibrated by language afterwards, on rows that the
fit did not see.

All labelled rows outside the held-out quarter take part, with their whole texts.  They are dealt to shards
by the hash of their id; in each epoch every shard descends from the same model on its own,
and Spark averages what they changed, by rows (an embedding: over the shards that have met it).

Since a filter is linear before its maximum, its part for each (bucket, offset) is
computed once, and scoring a text is a lookup and a few additions a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, islice
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import Memo, bucket_of, drop_table, kept, without, write_table
from labelframe.llm.contexts import numbers_of, planes, squeezed, unsqueezed

BUCKETS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
PAD = max(WIDTHS) - 1
#: Windows whose embeddings lie in memory at once while a batch is fitted.
BLOCK = 100_000
#: Ranges of buckets whose changes Spark adds up apart, and bins of a log-odds unit that calibration counts.
PIECES, BINS = 64, 256
#: Bits of the bitmap (2 MB) that tells which documents can have a label.
BITS = 1 << 24
STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


@dataclass
class Settings:
    """How the fit descends; a shard holds about so many bytes of text."""

    shard_bytes: int = 16 << 20
    epochs: int = 5
    batch: int = 64
    rate: float = 0.08
    seed: int = 7


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS + 1 rows; the last is the padding's and stays zero
    filters: list[np.ndarray]  # a width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)  # of the calibrated log-odds
    thresholds: dict[str | None, float] = field(default_factory=dict)
    threshold: float = 0.3

    def table(self) -> np.ndarray:
        """Per bucket, what it adds to each filter at each offset: (BUCKETS + 1, sum of widths * FILTERS)."""
        return np.concatenate([self.embedding @ w[o] for w in self.filters for o in range(len(w))], axis=1).astype(np.float32)


def buckets(word: bytes) -> tuple[int, int, int]:
    """Of a lower-case word without the marks around it, of its first four bytes and of its last four."""
    w = word.strip(STRIP) or word
    return crc32(w) % BUCKETS, crc32(w[:4], 1) % BUCKETS, crc32(w[-4:], 2) % BUCKETS


def _words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


class _Numbers(dict):
    """Numbers words from 1 in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Scorer:
    """Scores texts; keeps the filter parts of the words it has met, ``bound`` of them at most."""

    def __init__(self, model: Model, bound: int = 300_000):
        self.model, self.bound = model, bound
        self.parts = model.table()
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((1024, self.parts.shape[1]), np.float32)  # row 0: padding
        self.number = _Numbers()

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        first = len(self.number) + 1
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) >= first:
            new = list(islice(self.number, first - 1, None))
            while len(self.rows) < first + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            found = np.array([buckets(w) for w in new])
            self.rows[first : first + len(new)] = self.parts[found[:, 0]] + self.parts[found[:, 1]] + self.parts[found[:, 2]]
        return ids

    def features(self, texts: Iterable[str | None], block: int = 200_000) -> np.ndarray:
        """Max-pooled filter outputs of each text, whole texts in blocks of about ``block`` words."""
        out, held, n = [], [], 0
        for text in texts:
            held.append(_words(text))
            n += len(held[-1])
            if n >= block:
                out.append(self._pool(held))
                held, n = [], 0
        if held:
            out.append(self._pool(held))
        return np.concatenate(out) if out else np.zeros((0, FILTERS * len(WIDTHS)), np.float32)

    def _pool(self, texts: list[list[bytes]]) -> np.ndarray:
        if len(self.number) > self.bound:
            self.clear()
        lengths = np.array([max(1, len(w)) for w in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + PAD)[:-1]])
        ids = np.zeros(int((lengths + PAD).sum()), np.int64)
        at = np.concatenate([np.arange(len(w)) + s for s, w in zip(starts, texts, strict=True)]).astype(np.int64)
        ids[at] = self._numbers([x for w in texts for x in w])
        inside = np.zeros(len(ids), bool)
        inside[at] = True
        inside[starts] = True  # the one window of an empty text
        return pool(self.rows[ids], starts, inside)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        m = self.model
        z = np.maximum(self.features(texts) + m.bias, 0) @ m.out + m.out_bias
        return sigmoid(m.scale[0] * z + m.scale[1])


def pool(parts: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The largest window sum of each filter in each segment; windows start where ``inside`` holds."""
    out, column, n = [], 0, len(parts)
    for width in WIDTHS:
        total = parts[:, column : column + FILTERS].copy()
        for o in range(1, width):
            c = column + o * FILTERS
            total[: n - o] += parts[o:, c : c + FILTERS]
        total[~inside] = -np.inf
        out.append(np.maximum.reduceat(total, starts, axis=0))
        column += width * FILTERS
    return np.concatenate(out, axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float, rng: np.random.Generator) -> Model:
    """Small random weights; one dimension starts as the smoothed log-odds of a bucket's texts (``pos`` and ``neg`` of each class)."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    e = rng.normal(0, 0.05, (BUCKETS + 1, DIM))
    e[:BUCKETS, 0] = np.clip(odds, -4, 4) / 4
    e[BUCKETS] = 0
    filters = [rng.normal(0, 0.3 / w, (w, DIM, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[:, 0, : FILTERS // 2] += 1 / len(w)
    out = rng.normal(0, 0.1, FILTERS * len(WIDTHS))
    return Model(e, filters, np.zeros(FILTERS * len(WIDTHS)), out, -2.0)


def _ids(text: str | None, known: dict[bytes, tuple[int, int, int]]) -> np.ndarray:
    """The buckets of a text's words and of the padding behind them."""
    rows = [known[w] for w in _words(text)] or [(BUCKETS,) * 3]
    return np.array(rows + [(BUCKETS,) * 3] * PAD, np.int32)


def _met(ids: np.ndarray) -> np.ndarray:
    """The different buckets of a text."""
    found = np.unique(ids)
    return found[found < BUCKETS]


def _dense(m: Model) -> np.ndarray:
    """What every text touches: filters, bias, output."""
    return np.concatenate([*[w.ravel() for w in m.filters], m.bias, m.out, [m.out_bias]])


def _set_dense(m: Model, values: np.ndarray) -> None:
    at = 0
    for w in [*m.filters, m.bias, m.out]:
        w[...] = values[at : at + w.size].reshape(w.shape)
        at += w.size
    m.out_bias = float(values[at])


@dataclass
class State:
    """A model under way, with its squared gradients so far."""

    model: Model
    embedding_squares: np.ndarray
    dense_squares: np.ndarray

    @classmethod
    def of(cls, model: Model) -> State:
        return cls(model, np.full_like(model.embedding, 1e-3), np.full(len(_dense(model)), 1e-3))


def _best(m: Model, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest window sum of each filter in each text and where its window first starts, by blocks of windows."""
    inside = np.ones(len(rows), bool)
    for o in range(1, PAD + 1):
        inside[starts + lengths - o] = False
    top = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf)
    where = np.zeros(top.shape, np.int64)
    for a in range(0, len(rows), BLOCK):
        part = rows[a : a + BLOCK + PAD]
        n = min(BLOCK, len(rows) - a)
        x = m.embedding[part[:, 0]] + m.embedding[part[:, 1]] + m.embedding[part[:, 2]]
        first, last = np.searchsorted(starts, [a, a + n - 1], "right") - 1
        own = np.maximum(starts[first : last + 1] - a, 0)
        for k, w in enumerate(m.filters):
            total = x[:n] @ w[0]
            for o in range(1, len(w)):
                more = x[o : o + n] @ w[o]
                total[: len(more)] += more
            total[~inside[a : a + n]] = -np.inf
            high = np.maximum.reduceat(total, own, axis=0)
            r, c = np.nonzero(total == np.repeat(high, np.diff(np.append(own, n)), axis=0))
            place = np.full(high.shape, len(rows), np.int64)
            np.minimum.at(place, (np.searchsorted(own, r, "right") - 1, c), r + a)
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            better = high > top[first : last + 1, columns]
            where[first : last + 1, columns][better] = place[better]
            top[first : last + 1, columns][better] = high[better]
    return top, where


def _descend(state: State, ids: Callable[[int], np.ndarray], y: np.ndarray, weight: np.ndarray, order: np.ndarray, rate: float, batch: int) -> None:
    """One epoch of Adagrad on mini-batches.  The gradient of a maximum touches its own window alone."""
    m, squares = state.model, state.embedding_squares
    for at in range(0, len(order), batch):
        pick = order[at : at + batch]
        texts = [ids(i) for i in pick]
        rows = np.concatenate(texts)
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        top, where = _best(m, rows, starts, lengths)
        pooled = top + m.bias
        hidden = np.maximum(pooled, 0)
        p = sigmoid(hidden @ m.out + m.out_bias)
        g = (p - y[pick]) * weight[pick] / batch
        gh = g[:, None] * m.out * (pooled > 0)
        dense, gx = [], []
        for k, w in enumerate(m.filters):
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            gk = gh[:, columns]
            gw = np.zeros_like(w)
            for o in range(len(w)):
                own = rows[where[:, columns] + o]
                gw[o] = np.einsum("nfd,nf->df", m.embedding[own].sum(axis=2), gk)
                gx.append((own.reshape(-1, 3), (gk[:, :, None] * w[o].T[None]).reshape(-1, DIM)))
            dense.append(gw.ravel())
        dense = np.concatenate([*dense, gh.sum(axis=0), hidden.T @ g + 1e-4 * m.out, [g.sum()]])
        g_all = np.concatenate([b for _, b in gx])
        touched, inverse = np.unique(np.concatenate([a for a, _ in gx]), return_inverse=True)
        ge = np.zeros((len(touched), DIM))
        for k in range(3):
            np.add.at(ge, inverse.reshape(-1, 3)[:, k], g_all)
        ge[touched == BUCKETS] = 0
        squares[touched] += ge**2
        m.embedding[touched] -= rate * ge / np.sqrt(squares[touched])
        state.dense_squares += dense**2
        _set_dense(m, _dense(m) - rate * dense / np.sqrt(state.dense_squares))


def _rate(s: Settings, epoch: int) -> float:
    return s.rate / (1 + 0.5 * epoch)


def train(texts: list[str], labels: list[int], weights: np.ndarray | None = None, settings: Settings | None = None) -> Model:
    """Fit in one memory."""
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    y = np.array(labels, int)
    weight = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    known = Memo(buckets)
    ids = [_ids(t, known) for t in texts]
    met = np.zeros((2, BUCKETS))
    for row, label, w in zip(ids, y, weight, strict=True):
        met[label][_met(row)] += w
    state = State.of(_start(met[1], met[0], weight[y == 1].sum(), weight[y == 0].sum(), rng))
    for epoch in range(s.epochs if len(y) else 0):
        _descend(state, ids.__getitem__, y, weight, rng.permutation(len(ids)), _rate(s, epoch), s.batch)
    return state.model


# ---- over shards


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """Texts and labels of each shard; a shard's rows lie together."""
    shard, texts, labels = None, [], []
    for batch in batches:
        for own, text, label in zip(*[batch.column(c).to_pylist() for c in ("shard", "text", "toxic")], strict=True):
            if own != shard and texts:
                yield shard, texts, np.array(labels, int)
                texts, labels = [], []
            shard = own
            texts.append(text)
            labels.append(label)
    if texts:
        yield shard, texts, np.array(labels, int)


def _added(rows: DataFrame, run: Callable[[Iterator[tuple[int, list[str], np.ndarray]]], list[np.ndarray]], whole: int) -> list[np.ndarray]:
    """What ``run`` makes of a task's shards, a fixed number of arrays, added up by Spark.

    The driver gets the sums packed: the first ``whole`` arrays as they are, the others as 32-bit floats, as the model
    is sent out.  Tasks without a shard, of which there may be many, send nothing.
    """

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shards(batches)
        if (first := next(shards, None)) is None:
            return
        for piece, values in enumerate(run(chain([first], shards))):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([values.astype(np.float64).tobytes()], pa.binary())], names=["piece", "data"])

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in parts["data"])
        return pd.DataFrame({"piece": [key[0]], "data": [squeezed(planes(total.astype(np.float64 if key[0] < whole else np.float32)))]})

    schema = "piece long, data binary"
    sums = sorted(rows.mapInArrow(mapped, schema).groupBy("piece").applyInPandas(add, schema).collect())
    return [numbers_of(unsqueezed(r["data"]), np.float64 if r["piece"] < whole else np.float32).astype(np.float64) for r in sums]


def _known() -> Memo:
    """A worker's buckets of words."""
    memo = kept("toxicity_fit", lambda: Memo(buckets, 100_000))
    memo.trim()
    return memo


def _counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of each class have a bucket, and how many there are of each."""

    def run(shards: Iterator[tuple[int, list[str], np.ndarray]]) -> list[np.ndarray]:
        met, n = np.zeros((2, BUCKETS)), np.zeros(2)
        for _, texts, y in shards:
            for text, label in zip(texts, y, strict=True):
                met[label][_met(_ids(text, _known()))] += 1
            n += np.bincount(y, minlength=2)
        return [met.ravel(), n]

    met, n = _added(rows, run, 2)
    return met.reshape(2, BUCKETS), n


def _epoch(rows: DataFrame, state: State, epoch: int, s: Settings) -> State:
    """Every shard descends from ``state``; what they changed is averaged, by rows."""
    m = state.model
    shared = rows.sparkSession.sparkContext.broadcast((m.embedding.astype(np.float32), _dense(m), state.embedding_squares.astype(np.float32), state.dense_squares))
    cuts = np.linspace(0, BUCKETS, PIECES + 1).astype(int)

    def run(shards: Iterator[tuple[int, list[str], np.ndarray]]) -> list[np.ndarray]:
        embedding, dense, squares, dense_squares = shared.value
        sums, met, more, n = np.zeros((2, BUCKETS, DIM)), np.zeros(BUCKETS), np.zeros((2, len(dense))), 0
        for shard, texts, y in shards:
            own = State(Model(embedding.astype(float), [np.zeros((w, DIM, FILTERS)) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), np.zeros(FILTERS * len(WIDTHS)), 0.0), squares.astype(float), dense_squares.copy())
            _set_dense(own.model, dense)
            order = np.random.default_rng([s.seed, epoch, shard]).permutation(len(texts))
            _descend(own, lambda i, texts=texts: _ids(texts[i], _known()), y, np.ones(len(y)), order, _rate(s, epoch), s.batch)
            changed = np.flatnonzero((own.embedding_squares != squares).any(axis=1)[:BUCKETS])
            sums[0][changed] += len(y) * (own.model.embedding[changed] - embedding[changed])
            sums[1][changed] += len(y) * (own.embedding_squares[changed] - squares[changed])
            met[changed] += len(y)
            more += len(y) * np.stack([_dense(own.model) - dense, own.dense_squares - dense_squares])
            n += len(y)
        return [np.append(more.ravel(), n), *[np.concatenate([sums[:, a:b].ravel(), met[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]]

    first, *pieces = _added(rows, run, 1)
    shared.destroy()  # the driver's copy too, else each epoch's stays there
    more = first[:-1].reshape(2, -1) / first[-1]
    _set_dense(m, _dense(m) + more[0])
    state.dense_squares += more[1]
    for a, b, piece in zip(cuts, cuts[1:], pieces, strict=False):
        met = np.maximum(piece[-(b - a) :], 1)[:, None]
        sums = piece[: -(b - a)].reshape(2, b - a, DIM)
        m.embedding[a:b] += sums[0] / met
        state.embedding_squares[a:b] += sums[1] / met
    return state


# ---- thresholds


def _bins(rows: DataFrame, m: Model) -> DataFrame:
    """(lang, bin, n, pos, total, low, high): log-odds of unseen rows by bins, as a written table; null languages are empty ones."""
    shared = rows.sparkSession.sparkContext.broadcast(m)
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    @F.pandas_udf("double")
    def odds(text: pd.Series) -> pd.Series:
        p = np.clip(kept("toxicity", lambda: Scorer(shared.value), key).scores(text.tolist()), 1e-9, 1 - 1e-9)
        return pd.Series(np.log(p / (1 - p)), dtype="float64")

    scored = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "toxic", odds("text").alias("z"))
    sums = [F.count("*").alias("n"), F.sum("toxic").alias("pos"), F.sum("z").alias("total"), F.min("z").alias("low"), F.max("z").alias("high")]
    bins = write_table(scored.groupBy("lang", F.floor(F.col("z") * BINS).alias("bin")).agg(*sums), "bins")
    shared.destroy()
    return bins


def calibrate(m: Model, bins: DataFrame, least: int = 40) -> None:
    """Platt's scale on unseen rows, then for each language with enough of them the threshold of the best F1.

    All rows count.  A bin's rows have its mean log-odds for the scale; a threshold lies between two bins.
    """
    sums = [F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")]
    every = bins.groupBy("bin").agg(*sums).toPandas().sort_values("bin", ascending=False)  # as many rows as bins
    n, pos = every["n"].to_numpy(float), every["pos"].to_numpy(float)
    if pos.sum() in (0, n.sum()):
        return
    z = every["total"].to_numpy() / n
    a, b = 1.0, 0.0
    for _ in range(500):
        g = (n * sigmoid(a * z + b) - pos) / n.sum()
        a, b = max(0.05, a - 0.05 * float((g * z).sum()) - 0.0005 * (a - 1)), b - 0.2 * float(g.sum())
    m.scale = (a, b)
    m.threshold = best_threshold(m, every)
    totals = bins.groupBy("lang").agg(F.sum("n").alias("rows"), F.sum("pos").alias("hits")).where((F.col("rows") >= least) & (F.col("hits") >= 5) & (F.col("hits") < F.col("rows")))
    some = bins.join(totals.select("lang"), "lang").toPandas()  # as many rows as bins for each language with enough rows
    for lang, own in some.groupby("lang", sort=True):
        m.thresholds[lang] = best_threshold(m, own.sort_values("bin", ascending=False))


def best_threshold(m: Model, bins: pd.DataFrame) -> float:
    """The score from which on a row is toxic, for the best F1; midway to the next lower score, 0.1 to 0.9.  Bins come from the highest on."""
    n, pos = bins["n"].to_numpy(float), bins["pos"].to_numpy(float)
    k = int(np.argmax(2 * np.cumsum(pos) / (np.cumsum(n) + pos.sum())))
    low, high = (sigmoid(m.scale[0] * bins[c].to_numpy() + m.scale[1]) for c in ("low", "high"))
    below = high[k + 1] if k + 1 < len(n) else 0.0
    return float(np.clip((low[k] + below) / 2, 0.1, 0.9))


def eligible(id_column: str = "doc_id") -> Column:
    """Labels may be learned from rows outside the held-out quarter."""
    return bucket_of(id_column, 4) != 2


def _perhaps(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The rows whose id a bitmap of ``own`` holds: all that have a partner and few others, so that few texts are shuffled for the join."""
    bit = F.xxhash64(F.col("doc_id").cast("string")).bitwiseAND(BITS - 1)
    place = F.pmod(bit, F.lit(64)).cast("int")
    words = own.select(F.shiftright(bit, 6).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), place).alias("_bits"))
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))  # at most BITS / 64 rows
    held = F.call_function("shiftright", F.col("_bits"), place).bitwiseAND(1) == 1
    return rows.join(F.broadcast(words), (F.shiftright(bit, 6) == F.col("_word")) & held).drop("_word", "_bits")


def fit(documents: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    """Fit on all labelled rows outside the held-out quarter, with their whole texts.

    A fifth of them, by the hash of the id, calibrates; the others are learned from.  Rows with a null label or
    a null text have nothing to learn from; repeated rows count each.  Without rows nothing is learned.
    """
    s = settings or Settings()
    own = labels.where(eligible() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = documents.where(eligible() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    h = F.xxhash64("doc_id")
    drawn = h.alias("h"), (F.pmod(F.shiftright(h, 7), F.lit(5)) == 0).alias("unseen"), "text", "lang", "toxic"
    joined = write_table(_perhaps(rows, own).join(own, "doc_id").select(*drawn), "joined", "zstd")
    shards = 1 + (joined.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // s.shard_bytes
    # More partitions than shards, so that most of these have one, and a file, of their own.
    dealt = joined.withColumn("shard", F.pmod("h", F.lit(shards))).repartition(4 * shards, "shard").sortWithinPartitions("shard", "h", "text")
    table = write_table(dealt, "labelled", "zstd")
    drop_table(joined)
    seen = table.where(~F.col("unseen")).select("shard", "text", "toxic")
    if seen.isEmpty():
        m = train([], [], settings=s)
    else:
        met, n = _counted(seen)
        state = State.of(_start(met[1], met[0], n[1], n[0], np.random.default_rng(s.seed)))
        for epoch in range(s.epochs):
            state = _epoch(seen, state, epoch, s)
        m = state.model
    bins = _bins(table.where("unseen"), m)
    calibrate(m, bins)
    for used in (table, bins):
        drop_table(used)
    return m


def score(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``df`` with ``score``, ``threshold`` (of the row's language; of all rows for other languages) and ``toxic``.

    One narrow pass, no shuffle.  Null and empty texts get the score of a text without words; long
    texts are scored whole; repeated rows get the same score.  Input columns named like an output
    give way; an empty table gives an empty result.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    key = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    @F.pandas_udf("double")
    def of_text(text: pd.Series) -> pd.Series:
        return pd.Series(kept("toxicity", lambda: Scorer(shared.value), key).scores(text.tolist()), dtype="float64")

    out = without(df, ["score", "threshold", "toxic"]).withColumn("score", of_text(F.col(f"`{text_col}`")))
    threshold = F.lit(model.threshold)
    if lang_col is not None:
        for lang, t in model.thresholds.items():
            threshold = F.when(F.coalesce(F.col(f"`{lang_col}`"), F.lit("")) == lang, F.lit(t)).otherwise(threshold)
    return out.withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))
