"""Counts of bytes under contexts, as a distributed table that grows with the corpus.

An entry is 64 bits: 56 of the context's hash and the byte that followed it.  Entries are dealt
to shards by their first bits; a shard is one row of sorted entries and their counts, so the
counts of a byte's first bits under a context are differences of running sums.  Questions come
in chunks, each asking every different entry once, so no shard is hot however frequent a context
is; their number and the table's set the number of shards, so a shard's size is bounded.

What travels and what is kept is packed without loss: sorted entries as their gaps, paths as the
counts that leave them at each bit, both by places of bytes, which compress well.  Questions are
answered in rounds, and a round's questions and shuffles go before the next one begins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import drop_table, write_table

#: Entries or questions of a shard, about, and entries that a task counts before it passes them on.
SHARD, HELD = 1 << 20, 1 << 19
#: Parts of the questions that are asked one after the other.
ROUNDS = 4


@dataclass
class Counts:
    table: DataFrame  # shard, entries, counts
    bits: int  # of an entry, that name its shard


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, ..."""
    return np.ascontiguousarray(numbers.ravel().view(np.uint8).reshape(-1, numbers.itemsize).T).tobytes()


def numbers_of(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def gaps(entries: np.ndarray) -> bytes:
    """Sorted entries, packed."""
    return planes(np.diff(entries, prepend=np.uint64(0)))


def entries_of_gaps(data: bytes) -> np.ndarray:
    return np.cumsum(numbers_of(data, np.uint64), dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: pa.Buffer | bytes) -> bytes:
    data = memoryview(data)
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _cut(entries: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The shards of sorted entries and their places."""
    shard = (entries >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(at, [*at[1:], len(shard)], strict=True):
        yield int(shard[a]), slice(a, b)


def summed(entries: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different entries, sorted, with the sums of their counts."""
    order = np.argsort(entries, kind="stable")
    entries, counts = entries[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]])) if len(entries) else np.zeros(0, np.int64)
    return entries[at], np.add.reduceat(counts, at) if len(at) else counts


def count(rows: DataFrame, entries_of: Callable, size: int) -> Counts:
    """The table of what ``entries_of`` (batches to entries and counts) finds in ``rows``; ``size``: entries before they are combined."""
    bits = max(1, (size // SHARD).bit_length())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            entries, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cuts = list(_cut(entries, bits))
            data = [[packed(x[c]) for _, c in cuts] for packed, x in ((gaps, entries), (planes, counts))]
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in cuts], pa.int64()), *[pa.array(x, pa.binary()) for x in data]], names=["shard", "entries", "counts"])

        for entries, counts in entries_of(batches):
            held.append((entries, counts.astype(np.int64)))
            n += len(entries)
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        entries, counts = summed(np.concatenate([entries_of_gaps(x) for x in parts["entries"]]), np.concatenate([numbers_of(x, np.int64) for x in parts["counts"]]))
        return pd.DataFrame({"shard": [key[0]], "entries": [entries.tobytes()], "counts": [counts.tobytes()]})

    schema = "shard long, entries binary, counts binary"
    return Counts(write_table(rows.mapInArrow(run, schema).groupBy("shard").applyInPandas(add, schema), "contexts", "zstd"), bits)


def steps(asked: np.ndarray, entries: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often a context was followed by a byte that parts from the asked one at its bit 0, 1, ... 7, and by it: nine rows.

    A question that is an entry is found by one search; its row comes from runs of entries with equal first bits, summed
    once for all of them.  A context with one byte needs no runs.
    """
    out = np.zeros((9, len(asked)), np.int64)
    if not len(entries):
        return out
    place = np.minimum(np.searchsorted(entries, asked), len(entries) - 1)
    found = entries[place] == asked
    place = place[found]
    out[8, found] = counts[place]
    parts = np.concatenate([[True], entries[1:] >> np.uint64(8) != entries[:-1] >> np.uint64(8), [True]])
    of, shared = np.cumsum(parts[:-1]), ~(parts[1:] & parts[:-1])
    met = np.zeros(of[-1] + 1, bool)
    met[of[place]] = True
    shared &= met[of]  # contexts of several bytes that are asked about
    at, place = np.flatnonzero(found)[shared[place]], np.cumsum(shared)[place[shared[place]]] - 1
    if len(at):
        some, seen = entries[shared], counts[shared]
        below = seen[place]
        for k in range(7, -1, -1):
            first = np.concatenate([[True], some[1:] >> np.uint64(8 - k) != some[:-1] >> np.uint64(8 - k)])
            here = np.add.reduceat(seen, np.flatnonzero(first))[np.cumsum(first)[place] - 1]
            out[k, at] = here - below
            below = here
    if not found.all():
        out[:, ~found] = _searched(asked[~found], entries, counts)
    return out


def _searched(asked: np.ndarray, entries: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``steps`` by searches alone, for questions that may be no entries."""
    running = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty((9, len(asked)), np.int64)
    for k in range(9):
        mask = np.uint64((1 << (8 - k)) - 1)
        out[k] = running[np.searchsorted(entries, asked | mask, "right")] - running[np.searchsorted(entries, asked & ~mask)]
    out[:-1] -= out[1:].copy()
    return out


def paths(parted: np.ndarray) -> np.ndarray:
    """From ``steps``: how often a context was followed by a byte with the asked one's first 0, 1, ... 8 bits."""
    return np.ascontiguousarray(np.cumsum(parted[::-1], axis=0)[::-1]).astype(np.float32)


def alike(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different column of a table of numbers from 0, and which of these a column equals."""
    key, bound = np.zeros(rows.shape[1], np.int64), 1
    for row in rows:
        more = int(row.max(initial=0)) + 1
        if bound * more >= 1 << 62:
            different, key = np.unique(key, return_inverse=True)
            bound = len(different)
        if bound * more >= 1 << 62:
            different, row = np.unique(row, return_inverse=True)
            more = len(different)
        key, bound = key * more + row, bound * more
    return np.unique(key, return_index=True, return_inverse=True)[1:]


def look_up(rows: DataFrame, questions_of: Callable, counts: Counts, together_by: Column | None = None) -> DataFrame:
    """(chunk, content, answers) of the chunks that ``questions_of`` (batches to contents and entries) makes of ``rows``, as written tables.

    Rows alike in ``together_by`` (in all columns by default) are asked in one round, so that those which share entries meet in a chunk.
    """
    bits = counts.bits

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, (content, entries) in enumerate(questions_of(batches)):
            asked, place = np.unique(entries, return_inverse=True)
            cuts, last = list(_cut(asked, bits)), (asked & np.uint64(255)).astype(np.uint8)
            data = [squeezed(pickle.dumps((content, entries.shape, planes(place.astype(np.int32)), last.tobytes()))), *[gaps(asked[c]) for _, c in cuts]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(data), first + n, np.int64)), pa.array([-1, *[s for s, _ in cuts]], pa.int64()), pa.array(data, pa.binary())], names=["chunk", "shard", "data"])

    def answer(key: tuple, asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        entries, seen = (np.frombuffer(b"".join(table[c]), t) for c, t in (("entries", np.uint64), ("counts", np.int64)))
        # A row per question: rows of one chunk are put together again in the order of shards.
        questions = [entries_of_gaps(x) for x in asked["data"]]
        found = steps(np.concatenate(questions), entries, seen) if questions else np.zeros((9, 0), np.int64)
        data = [planes(x) for x in np.split(found, np.cumsum([len(x) for x in questions[:-1]]), axis=1)] if questions else []
        return pd.DataFrame({"chunk": asked["chunk"], "shard": asked["shard"], "data": data})

    def together(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("shard")
        answers = [numbers_of(x, np.int64).reshape(9, -1) for x in parts["data"].iloc[1:]]
        answers = np.concatenate(answers, axis=1) if answers else np.zeros((9, 0), np.int64)
        content, shape, place, last = pickle.loads(unsqueezed(parts["data"].iloc[0]))
        place = numbers_of(place, np.int32).reshape(shape if len(shape) > 1 else (1, -1))
        # Only different answers are kept, and only different positions: those with another byte or another answer.
        first, answer_of = alike(answers)
        byte, found = np.frombuffer(last, np.uint8)[place[0]], answer_of[place]
        one, position = alike(np.concatenate([byte[None].astype(np.int64), found]))
        kept = (content, len(found), planes(found[:, one].astype(np.int32)), byte[one].tobytes(), planes(position.astype(np.int32)))
        return pd.DataFrame({"chunk": [key[0]], "content": [squeezed(pickle.dumps(kept))], "answers": [squeezed(planes(answers[:, first]))]})

    schema = "chunk long, shard long, data binary"
    part, facts = F.pmod(F.xxhash64(*([F.col(f"`{c}`") for c in rows.columns] if together_by is None else [together_by])), F.lit(ROUNDS)), None
    for n in range(ROUNDS):
        asked = write_table(rows.where(part == n).mapInArrow(ask, schema), "asked", "zstd")
        answers = asked.where("shard >= 0").groupBy("shard").cogroup(counts.table.groupBy("shard")).applyInPandas(answer, schema)
        whole = answers.unionByName(asked.where("shard < 0")).groupBy("chunk").applyInPandas(together, "chunk long, content binary, answers binary")
        done = write_table(whole, "facts")
        facts = done if facts is None else facts.unionByName(done)
        drop_table(asked)
    return facts


@dataclass
class Chunk:
    """A chunk's content and its different positions: a position is a column of entries, alike in the byte and all answers."""

    content: dict
    place: np.ndarray  # of the answers: a row per entry of a position
    byte: np.ndarray
    position: np.ndarray  # which one each of the chunk's columns is
    paths: np.ndarray  # the answers, nine rows


def settled(batches: Iterable[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for content, answers in zip(batch.column("content"), batch.column("answers"), strict=True):
            content, height, place, byte, position = pickle.loads(unsqueezed(content.as_buffer()))
            answers = numbers_of(unsqueezed(answers.as_buffer()), np.int64).reshape(9, -1)
            yield Chunk(content, numbers_of(place, np.int32).reshape(height, -1), np.frombuffer(byte, np.uint8).astype(np.int64), numbers_of(position, np.int32), paths(answers))


def answered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """The chunks' contents, the places of their entries' answers, and these (nine rows)."""
    for chunk in settled(batches):
        yield chunk.content, chunk.place[:, chunk.position].ravel(), chunk.paths
