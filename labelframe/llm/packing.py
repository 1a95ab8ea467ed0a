"""Packing: order-preserving windows chosen by dynamic programming.

The documents' token ids, each document closed by an end id, form one stream in the
order of the rows.  A window is a run of at most ``size`` ids, padded to ``size`` unless
its length is a power of two.  Windows may end at any document's or sentence's end, or
at points of a grid; a cut costs its padding plus a penalty for what it cuts through.
``f(j) = penalty(j) + min over i of f(i) + size - (j - i)`` over the ``i`` at most ``size``
before ``j`` is a sliding minimum of ``f(i) + i``, kept by a monotone queue, so a cut point
costs constant time; the windows of a power of two are looked up beside it.

Each task packs the rows of its partition as they come: no shuffle, and one window at
most is cut short at a partition's end (into powers of two, where that wastes less).
The stream is planned in blocks of about a million ids; the plan's last windows of a
block are open until the next block is known.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import kept

END_ID = 2
SIZE = 4096
BLOCK = 1 << 20
GRID = 32
#: What a cut costs, in ids of padding: at a document's end, at a sentence's end, elsewhere.
PENALTIES = (0, 1, 8)

_PLAIN = re.compile(r"[!-~à-öø-ÿ\n]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿ]+|[0-9]|\n|[^a-zà-öø-ÿ0-9\n]+")
_ODD = re.compile(r"[\x00-\x09\x0b-\x20\x7f]|<\|")
_BREAK = b"\xff\xff"  # no id


class Encoder:
    """Ids of texts by a word-end BPE file of the ``tokenizers`` library, with a memo of words.

    That tokenizer drops white space and never joins ids across it, so a text's ids are
    its words' ids in a row.  Words of plain letters and marks are split here and only
    new pieces go through the merges; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, bound: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.mark = np.zeros(len(self.last), bool)  # ids that end a sentence
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
            self.mark[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in printable)
        self.letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # words known lately; at most half of ``bound``, as ``words``
        self.pieces: dict[str, bytes] = {}
        self.bound = bound

    def _learn(self, words: set[bytes]) -> None:
        plain, other = list(words), []
        lower = b"\n".join(plain).decode("utf-8", "replace").lower()
        if not _PLAIN.fullmatch(lower) or "<|" in lower:
            spelt = lower.split("\n")
            odd = _ODD.search(lower) is not None  # else ASCII words are plain
            good = [(s.isascii() and not odd) or (_PLAIN.fullmatch(s) is not None and "<|" not in s) for s in spelt]
            other = [w for w, g in zip(plain, good, strict=True) if not g]
            plain = list(compress(plain, good))
            lower = "\n".join(compress(spelt, good))
        pieces = _PIECE.findall(lower)
        if len(self.pieces) > self.bound // 2:
            self.pieces = {}
        self.pieces["\n"] = _BREAK
        new = list(set(pieces).difference(self.pieces))
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            spelt = [p if p.isascii() else "".join([self.letter[b] for b in p.encode()]) for p in some]
            ids = np.array(self.merges.encode(" ".join(spelt), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark the ends of words")
            raw, cuts = ids.astype("<u2").tobytes(), [0, *(2 * ends).tolist()]
            self.pieces.update(zip(some, [raw[a:b] for a, b in pairwise(cuts)], strict=True))
        raw = b"".join(map(self.pieces.__getitem__, pieces))
        breaks = (2 * np.flatnonzero(np.frombuffer(raw, "<u2") == 0xFFFF)).tolist()
        self.words.update(zip(plain, [raw[a:b] for a, b in zip([0, *[x + 2 for x in breaks]], [*breaks, len(raw)], strict=True)], strict=bool(plain)))
        if other:
            found = self.whole.encode_batch([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
            self.words.update((w, np.array(e.ids, "<u2").tobytes()) for w, e in zip(other, found, strict=True))

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        missing = set().union(*split).difference(self.words)
        if missing:
            if len(self.words) + len(missing) > self.bound // 2:
                self.words, self.before, missing = {}, self.words, set().union(*split)
            if self.before:
                again = missing.intersection(self.before)
                self.words.update(zip(again, map(self.before.__getitem__, again), strict=True))
                missing.difference_update(again)
        if missing:
            self._learn(missing)
        return [np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u2") for words in split]


def blocks(ids: Iterable, texts: Iterable, chars: int = 4_000_000) -> Iterator[tuple[list, list]]:
    """Ids and texts in groups of about ``chars`` characters; a longer text is a group of its own."""
    some, held, n = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        t = t.as_py()
        some.append(i)
        held.append(t)
        n += len(t or "")
        if n >= chars:
            yield some, held
            some, held, n = [], [], 0
    if some:
        yield some, held


def cut_points(doc_ends: np.ndarray, marks: np.ndarray, total: int, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and their penalties; 0 comes first, ``total`` last.

    Points of the grid serve only stretches without a better place: those at least half of ``grid`` from one on either side.
    """
    kind = np.zeros(total + 1, np.int8)
    kind[marks] = 2
    kind[doc_ends] = 3
    better = np.flatnonzero(kind)
    spread = np.arange(grid, total, grid)
    after = np.searchsorted(better, spread)
    before = np.where(after > 0, better[np.maximum(after - 1, 0)], 0)
    behind = np.where(after < len(better), better[np.minimum(after, len(better) - 1)], total)
    kind[spread[(spread - before >= grid // 2) & (behind - spread >= grid // 2)]] = 1
    kind[0] = 3
    kind[total] = max(1, kind[total])
    at = np.flatnonzero(kind)
    return at, np.array(PENALTIES[::-1])[kind[at] - 1]


def plan(at: np.ndarray, penalty: np.ndarray, size: int = SIZE, last: bool = False) -> list[int]:
    """The cut positions of the cheapest windows from the first to the last point; neighbours are at most ``size`` apart.

    With ``last``, the last window costs what its best split into powers of two costs.
    """
    points, cost_at = at.tolist(), penalty.tolist()
    n = len(points)
    total = [0] * n
    back = [0] * n
    # The points a power of two before each, or -1.
    exact = []
    for length in (size, size // 2):
        k = np.minimum(np.searchsorted(at, at - length), n - 1)
        exact.append(np.where(at[k] == at - length, k, -1).tolist())
    whole, half = exact
    queue: deque[tuple[int, int, int]] = deque()  # key, point, its number; keys rise
    last_key = points[0]  # of the point before
    for j in range(1, n):
        p = points[j]
        while queue and queue[-1][0] > last_key:
            queue.pop()
        queue.append((last_key, points[j - 1], j - 1))
        while queue[0][1] < p - size:
            queue.popleft()
        key, _, i = queue[0]
        best = key + size - p
        if (k := whole[j]) >= 0 and total[k] < best:
            best, i = total[k], k
        if (k := half[j]) >= 0 and total[k] < best:
            best, i = total[k], k
        total[j] = best = best + cost_at[j]
        back[j] = i
        last_key = best + p
    if last:
        near = range(bisect_left(points, points[-1] - size), n - 1)
        back[-1] = min(near, key=lambda i: total[i] + tail_cost(points[-1] - points[i], size), default=0)
    cuts, j = [], n - 1
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


def tail_cost(length: int, size: int = SIZE) -> int:
    return min(size - length, (length.bit_count() - 1) * PENALTIES[2])


def split_tail(length: int, size: int = SIZE) -> list[int]:
    """The lengths of the last window: whole and padded, or as powers of two if their cuts cost less."""
    powers = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
    return powers if (len(powers) - 1) * PENALTIES[2] < size - length else [length]


class Packer:
    """Packs a stream of documents; rows are (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, first_sequence: int, size: int = SIZE, block: int = BLOCK):
        self.size, self.block, self.sequence = size, max(block, 4 * size), first_sequence
        self.docs: deque[list] = deque()  # id, ids, how many are placed
        self.marks: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id, ids: np.ndarray, marks: np.ndarray) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.marks.append(marks + self.held)
        self.held += len(ids)
        if self.held >= self.block:
            yield from self._place(last=False)

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self._place(last=True)

    def _place(self, last: bool) -> Iterator[tuple]:
        marks = np.concatenate(self.marks)
        ends = np.cumsum([len(ids) - used for _, ids, used in self.docs])
        cuts = plan(*cut_points(ends, marks, self.held), self.size, last)
        if last:
            before = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + (before + np.cumsum(split_tail(self.held - before, self.size))).tolist()
        else:
            cuts = cuts[: -max(2, len(cuts) // 8)]  # the others may change with what follows
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield from self._window(b - a)
        done = cuts[-1] if cuts else 0
        self.held -= done
        self.marks = [marks[marks > done] - done]

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc_id, ids, used = doc = self.docs[0]
            n = min(length - offset, len(ids) - used)
            yield doc_id, used, n, zlib.crc32(ids[used : used + n].astype("<u4").tobytes()), len(ids), self.sequence, offset
            offset += n
            doc[2] += n
            if doc[2] == len(ids):
                self.docs.popleft()
        self.sequence += 1


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """A row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Null and empty texts are documents of the end id alone.  Repeated rows are packed each
    on their own; ids may be null.  Other columns, however named, are left out.  An empty
    table has no pieces.  ``size`` is a power of two.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("packing", lambda: Encoder(tokenizer), tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, size)
        rows: list[tuple] = []
        for batch in batches:
            for some, texts in blocks(batch.column("id").to_pylist(), batch.column("text")):
                for doc_id, ids in zip(some, encoder.encode(texts), strict=True):
                    marks = np.flatnonzero(encoder.mark[ids]) + 1
                    rows += packer.add(doc_id, np.append(ids, END_ID).astype("<u2"), marks)
            yield _pieces(rows, batch.schema.field("id").type)
            rows, id_type = [], batch.schema.field("id").type
        rows = list(packer.close())
        if rows:
            yield _pieces(rows, id_type)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def _pieces(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], id_type if j == 0 else pa.int64()) for j in range(7)], names=names)
