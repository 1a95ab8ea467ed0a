"""Benchmark decontamination by template canonicalisation.

Words become tokens: letters stay (in lower case, without the marks around them), while
numbers, names and units become typed placeholders, the *slots*.  A window of five such
tokens is a template; equal templates, found by a hash join, point from a document to a
benchmark item even if the question's numbers, names or units were exchanged.  A
re-parameterised question exchanges each value for one other value throughout, so the
matched slots of a document and an item must agree with one another; unrelated texts that
share templates rarely do.  A document may hold an item several times, with other values each
time, so slots are compared in the whole document and, where that fails, in each stretch of
about the item's length.

The documents' windows first pass a bitmap of fixed size over the benchmark's windows, so
only those that (nearly all) have a partner are shuffled; the bitmap does not grow with
the benchmark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import Memo, free_name, kept

WINDOW = 5
#: Of the window's tokens, so many must be words, not placeholders.
LEAST_WORDS = 2
#: Bits of the bitmap (2 MB) that tells which windows can have a partner.
BITS = 1 << 24

_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
_JOINED = re.compile(r"([+-]?[$€£]?\d[\d.,]*)([^\W\d]+)")
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%+-") + "“”‘’„«»¿¡…"
_ASCII_MARKS = "".join(c for c in _MARKS if c.isascii()).encode()
_CLOSING = b"\"')]}>"
#: Units after a number become a placeholder.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent kmh mph degree degrees watt watts kw kwh volt volts".split()
)

WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


_PLACEHOLDER = np.array([0, _hash("<number>"), _hash("<name>"), _hash("<unit>")], np.uint64)


class Canon:
    """Numbers raw words and keeps, per number: hash, kind, and whether a sentence ends there."""

    def __init__(self, bound: int = 400_000):
        self.bound = bound
        self.clear()

    def clear(self) -> None:
        self.known = Memo(self._learn, self.bound)
        self.hash: list[int] = []
        self.kind: list[int] = []
        self.ends: list[bool] = []
        self.value: list[str] = []

    def _learn(self, raw: bytes) -> int:
        self.ends.append(raw.rstrip(_CLOSING)[-1:] in (b".", b"!", b"?", b":"))
        body = raw.strip(_ASCII_MARKS)
        if body.isalpha() and body.islower() and body.decode() not in UNITS:  # ASCII letters alone
            kind, value = WORD, body.decode()
        else:
            kind, value = self._kind(raw.decode("utf-8", "replace").strip(_MARKS))
        self.hash.append(_hash(value))
        self.kind.append(kind)
        self.value.append(value)
        return len(self.hash) - 1

    @staticmethod
    def _kind(body: str) -> tuple[int, str]:
        value = body.lower()
        if _NUMBER.fullmatch(body):
            return NUMBER, value
        if m := _JOINED.fullmatch(body):
            return (NUMBER if m[2].lower() in UNITS else WORD), value
        if value in UNITS:
            return UNIT, value
        return (NAME if body[:1].isupper() and not (len(body) > 1 and body.isupper()) else WORD), value

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token hash, kind, word number and text number of each word of whole texts, one after another."""
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        if len(self.hash) > self.bound:
            self.clear()
        ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        hashes, kind, ends = np.array(self.hash, np.uint64)[ids], np.array(self.kind, np.int8)[ids], np.array(self.ends, bool)[ids]
        begins = np.ones(len(ids), bool)
        begins[1:] = ends[:-1] | (owner[1:] != owner[:-1])
        kind[(kind == NAME) & begins] = WORD  # a capital that any first word has
        after = np.zeros(len(ids), bool)
        after[1:] = (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])
        kind[(kind == UNIT) & ~after] = WORD
        return np.where(kind == WORD, hashes, _PLACEHOLDER[kind]), kind, ids, owner


def windows(hashes: np.ndarray, kind: np.ndarray, n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the token windows, and which of them have enough words."""
    count = len(hashes) - n + 1
    total, words = np.full(count, n, np.uint64), np.zeros(count, np.int64)
    for i in range(n):
        total = (total ^ (total >> np.uint64(29))) * _MULTIPLIER + hashes[i : i + count]
        words += kind[i : i + count] == WORD
    total ^= total >> np.uint64(32)
    return total, words >= min(LEAST_WORDS, n)


def _slots(kind: np.ndarray, ids: np.ndarray, value: list[str], at: int, n: int) -> str:
    """The window's slot values, by their place in it."""
    return "\x1f".join(value[ids[at + i]] for i in range(n) if kind[at + i] != WORD)


def _found(batches: Iterable[pa.RecordBatch], lengths: list[int] | None, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A row per window: id, text's hash, window, slot values, window's length and its place in the text.

    With a bitmap, windows of each of ``lengths`` that it holds; without, the windows of an
    item, which for a short one are the item itself.
    """
    canon = kept("decontamination", Canon)
    for batch in batches:
        out: list[tuple] = []
        for first, texts in _blocks(batch.column("text")):
            hashes, kind, ids, owner = canon.tokens(texts)
            count = np.bincount(owner, minlength=len(texts))
            begin = np.cumsum(count) - count
            for n in lengths or range(1, WINDOW + 1):
                if len(hashes) < n:
                    continue
                found, enough = windows(hashes, kind, n)
                mine = owner[: len(found)]
                enough &= mine == owner[n - 1 :]
                if lengths is None:  # of an item: windows of five, or the whole of a shorter one
                    enough &= np.minimum(count[mine], WINDOW) == n
                if bitmap is not None:
                    enough &= bitmap[(found & np.uint64(BITS - 1)).astype(np.int64)]
                for at in np.flatnonzero(enough).tolist():
                    out.append((first + int(mine[at]), int(found[at].astype(np.int64)), _slots(kind, ids, canon.value, at, n), n, at - int(begin[mine[at]])))
        take = pa.array([r[0] for r in out], pa.int64())
        arrays = [batch.column("id").take(take), batch.column("text_hash").take(take), *[pa.array([r[j] for r in out], t) for j, t in ((1, pa.int64()), (2, pa.string()), (3, pa.int32()), (4, pa.int64()))]]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "text_hash", "window", "slots", "n", "place"])


def _blocks(column: pa.Array, chars: int = 4_000_000) -> Iterator[tuple[int, list]]:
    """A column's texts in groups of about ``chars`` characters, with the place of each group's first."""
    first, held, n = 0, [], 0
    for i, text in enumerate(column):
        text = text.as_py()
        held.append(text)
        n += len(text or "")
        if n >= chars:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


#: Lengths of the stretches that are looked at, as shares of the item's.
STRETCHES = (1.0, 1.25, 1.5, 0.75, 0.5)


def _agreement(some: list[tuple], total: int, coverage: float, consistency: float) -> tuple | None:
    """(n_windows, coverage, consistency, same_values) of matches (place, window, item's slots, slots) that tell of a leak."""
    found = {x[1] for x in some}
    if len(found) / total < coverage:
        return None
    stands: dict[str, Counter] = {}
    for _, _, own, other in some:
        if own:
            for a, b in zip(own.split("\x1f"), other.split("\x1f"), strict=True):
                stands.setdefault(a, Counter())[b] += 1
    every = sum(c.total() for c in stands.values())
    top, same = (sum(f(a, c) for a, c in stands.items()) / every if every else 1.0 for f in (lambda a, c: max(c.values()), lambda a, c: c[a]))
    verbatim = found == {x[1] for x in some if x[2] == x[3]}
    return (len(found), len(found) / total, top, same) if verbatim or top >= consistency else None


def leaked(matches: Iterable[tuple], total: int, length: int, coverage: float, consistency: float) -> tuple | None:
    """What ``_agreement`` says of the whole document, or else of its best stretch of about the item's ``length``."""
    rows = sorted(matches)
    if whole := _agreement(rows, total, coverage, consistency):
        return whole
    for share in STRETCHES:
        best, inside, end = None, Counter(), 0
        size = max(1, round(length * share))
        for first, row in enumerate(rows):
            while end < len(rows) and rows[end][0] < row[0] + size:
                inside[rows[end][1]] += 1
                end += 1
            if len(inside) / total >= coverage and (one := _agreement(rows[first:end], total, coverage, consistency)):
                best = max(best or one, one)
            inside[row[1]] -= 1
            if not inside[row[1]]:
                del inside[row[1]]
        if best:
            return best
    return None


def _judged(batches: Iterable[pa.RecordBatch], coverage: float, consistency: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("matches"), batch.column("total").to_pylist(), batch.column("length").to_pylist(), strict=True)
        found = [leaked([tuple(x.values()) for x in m.as_py()], total, length, coverage, consistency) for m, total, length in rows]
        take = pa.array([i for i, x in enumerate(found) if x], pa.int64())
        values = [pa.array([x[j] for x in found if x], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("id", "text_hash", "item")], *values], names=["id", "text_hash", "item", "n_windows", "coverage", "consistency", "same_values"])


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = 0.5, consistency: float = 0.85) -> DataFrame:
    """A row for each document and item that it leaks: id, ``text_hash``, item, ``n_windows``, ``coverage``, ``consistency``, ``same_values``.

    A document leaks an item if at least ``coverage`` of the item's windows occur in it and at
    least ``consistency`` of the item's slot values stand for one value there (both 1 where an
    item has no slots), or both hold in a stretch of about the item's length, or that is so
    covered by windows of the item's very values.  Figures are those of the document or else
    of its best stretch.  ``same_values``: the share of slots that kept their value.  Items of
    fewer than five words are one window; items without a usable window, null and empty texts
    leak nothing.  Repeated rows (same id and text) count once; equal ids with other texts are
    told apart by ``text_hash``.  Other columns, however named, are left out.
    """
    spark = documents.sparkSession
    schema = "id {}, text_hash long, window long, slots string, n int, place long"
    items = _rows(benchmark, item_col, item_text_col).mapInArrow(lambda b: _found(b, None, None), schema.format(dict(benchmark.dtypes)[item_col]))
    items = items.select(F.col("id").alias("item"), F.col("text_hash").alias("item_hash"), "window", F.col("slots").alias("item_slots"), "n", "place")
    total = items.groupBy("item", "item_hash").agg(F.count_distinct("window").alias("total"), (F.max("place") - F.min("place") + 1).alias("length"))
    items = items.drop("place").distinct()
    # At most BITS / 64 rows of two numbers, whatever the benchmark's size.
    bit = F.col("window").bitwiseAND(BITS - 1)
    words = items.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(window & 63 as int))")).alias("bits")).toPandas()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # 1 to WINDOW
    shared = spark.sparkContext.broadcast(bitmap)

    def of_documents(batches):
        return _found(batches, lengths, np.unpackbits(shared.value.view(np.uint8), bitorder="little").astype(bool)) if lengths else iter(())

    hits = _rows(documents, id_col, text_col).mapInArrow(of_documents, schema.format(dict(documents.dtypes)[id_col])).drop("n")
    matched = hits.join(items.drop("n"), "window")
    key = ["id", "text_hash", "item", "item_hash"]
    found = matched.groupBy(*key).agg(F.collect_set(F.struct("place", "window", "item_slots", "slots")).alias("matches"))
    # Ids may be null, so keys are compared null-safely.  No stretch covers more than its document.
    found = found.alias("f").join(total.alias("t"), [F.col(f"f.{k}").eqNullSafe(F.col(f"t.{k}")) for k in ("item", "item_hash")])
    found = found.where(F.size(F.array_distinct("matches.window")) / F.col("total") >= coverage).select("id", "text_hash", F.col("f.item").alias("item"), "matches", "total", "length")
    kinds = dict(found.dtypes)
    out = found.mapInArrow(lambda b: _judged(b, coverage, consistency), f"id {kinds['id']}, text_hash long, item {kinds['item']}, n_windows long, coverage double, consistency double, same_values double")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), "n_windows", "coverage", "consistency", "same_values")


def remove_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` without the rows that leak an item; null ids and texts are told apart from others null-safely."""
    own, hashed = free_name(documents, "_id"), free_name(documents, "_hash")
    bad = leaks(documents, benchmark, id_col, text_col, **options).select(F.col(f"`{id_col}`").alias(own), F.col("text_hash").alias(hashed)).distinct()
    on = documents[f"`{id_col}`"].eqNullSafe(bad[own]) & (F.xxhash64(documents[f"`{text_col}`"]) == bad[hashed])
    return documents.join(bad, on, "left_anti")
