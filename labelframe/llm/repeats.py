"""Removal of long repeated byte strings, within and across texts.

A byte goes if a string of 200 bytes that covers it also starts anywhere else.  Sorting all
suffixes of all texts would send 200 bytes for each byte, so only suffixes at content-defined
places are sorted:

1. Every 200-byte window has an anchor (``anchors``), about one for 70 bytes; equal windows have
   equal anchors.  The windows of one anchor are its zone.  An anchor whose 64 bytes
   occur once has no repeated window; a join on their hashes leaves it out.
2. Zones of equal bytes are repeated as a whole.
3. The different zones of one anchor are sorted by deep-shallow sorting (``suffixes``): the
   suffixes from the anchors, and the parts before them backwards.  Neighbours in these orders
   tell how far each zone repeats.  Everything is compared byte by byte.

A passage that a third of all texts share is no hot spot: its inner zones are equal, and equal zones
are combined before they are shuffled.  Anchors with very many different zones, as at the ends
of such a passage, are not gathered in one task: their windows are told apart by 128-bit
digests instead, with minima and maxima that Spark combines.

Exact copies of a text are known beforehand: if it has 200 bytes, all of it is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelframe.llm.anchors import GRAM, LENGTH, PART, Hasher, anchors_of
from labelframe.llm.common import drop_table, kept, write_table
from labelframe.llm.minhash import mix, node_of
from labelframe.llm.suffixes import extents

#: Different zones of an anchor (about 270 bytes each) that one task sorts.
SORTED = 20_000
#: Bytes of zones passed on together.
BATCH = 8_000_000


def _hash() -> Hasher:
    return kept("repeats", Hasher)


def _parts(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """A text's bytes in parts that overlap by a window less a byte, so that each window lies in one."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, max(1, len(data) - LENGTH + 1), PART):
        part = data[at : at + PART + LENGTH - 1]
        if len(part) >= LENGTH:
            yield at, part


def zones_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor of a text the hash of its bytes and its place: the first start of its windows,
    how many more there are, and how far behind the first the anchor stands, in one number."""
    h = _hash()
    grams, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for base, part in _parts(raw):
        g = h.windows(h.prefix(part), slice(None), GRAM)
        anchor = anchors_of(g)
        at, begin = np.unique(anchor, return_index=True)
        more = np.append(begin[1:], len(anchor)) - 1 - begin
        grams.append(g[at])
        places.append((begin + base) << 16 | more << 8 | (at - begin))
    return np.concatenate(grams).view(np.int64), np.concatenate(places)


def _anchored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [zones_of(t.as_py().encode("utf-8", "replace")) for t in batch.column("text")]
        cuts = np.concatenate([[0], np.cumsum([len(g) for g, _ in found])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64))) for k in range(2)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "node", "n_bytes", "whole")], *lists], names=["id", "node", "n_bytes", "whole", "grams", "places"])


_ZONES = "node binary, first long, gram long, name binary, at int, more int, body binary, low long, high long"


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' zones with their bytes, each different zone's once for a text, with two places of it there (equal ones, if it has one)."""
    names = [x.split()[0] for x in _ZONES.split(", ")]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    rows: list[list] = []
    held = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    for batch in batches:
        for node, text, zones in zip(batch.column("node").to_pylist(), batch.column("text"), batch.column("zones"), strict=True):
            raw = text.as_py().encode("utf-8", "replace")
            salt = np.uint64(int.from_bytes(node[:8], "little"))
            met: dict[bytes, list] = {}
            for zone in zones.as_py():
                first, more, at = zone["place"] >> 16, zone["place"] >> 8 & 255, zone["place"] & 255
                body = raw[first : first + more + LENGTH]
                name = xxhash.xxh3_128_digest(body, at)
                place = int(mix(np.uint64(first) * np.uint64(0x9E3779B97F4A7C15) + salt).view(np.int64))
                if (known := met.get(name)) is not None:
                    known[7], known[8] = min(known[7], place), max(known[8], place)
                    rows.append([node, first, zone["gram"], name, at, more, None, None, None])
                else:
                    met[name] = row = [node, first, zone["gram"], name, at, more, body, place, place]
                    rows.append(row)
                    held += len(body)
            if held > BATCH or len(rows) > 100_000:
                yield flush()
                rows, held = [], 0
    if rows:
        yield flush()


def _sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, a, b): of each zone that is not repeated as a whole, where its first and last repeated windows start."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for zones in batch.column("zones"):
            zones = sorted(zones.as_py(), key=lambda z: z["name"])
            for zone, found in zip(zones, extents([(z["body"], z["at"]) for z in zones]), strict=True):
                if found and not zone["whole"]:
                    for column, value in zip(out, (zone["name"], *found), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["name", "a", "b"])


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, body, at in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist(), batch.column("at").to_pylist(), strict=True):
            starts = range(len(body) - LENGTH + 1)
            digests = [xxhash.xxh3_128_digest(body[s : s + LENGTH], at - s) for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(digests), pa.binary()), pa.array(list(starts), pa.int64()), pa.array(digests, pa.binary())], names=["name", "start", "window"])


def repeated_parts(kinds: DataFrame) -> DataFrame:
    """(name, a, b): where the first and the last repeated window of a zone start, from its begin.

    ``kinds``: (gram, name, at, more, body, whole), the different zones.
    """
    whole = kinds.where("whole").select("name", F.lit(0).cast("long").alias("a"), F.col("more").cast("long").alias("b"))
    sizes = kinds.groupBy("gram").agg(F.count("*").alias("n"), F.min("whole").alias("all")).where("n > 1 and not all").select("gram", "n")
    open_ = kinds.join(sizes, "gram")
    groups = open_.where(F.col("n") <= SORTED).groupBy("gram").agg(F.collect_list(F.struct("name", "body", "at", "whole")).alias("zones"))
    parts = groups.select("zones").mapInArrow(_sorted_groups, "name binary, a long, b long")
    large = open_.where(F.col("n") > SORTED).select("name", "body", "at").mapInArrow(_windows, "name binary, start long, window binary")
    double = large.groupBy("window").agg(F.min("name").alias("low"), F.max("name").alias("high")).where("low <> high").select("window")
    ends = large.join(double, "window").groupBy("name").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    ends = ends.join(kinds.where("whole").select("name"), "name", "left_anti")
    return whole.unionByName(parts).unionByName(ends)


def _removed(raw: bytes, starts: list[int]) -> tuple[int, int, str]:
    """Bytes removed, removed runs, and the SHA-256 of what is left, for windows that start at ``starts``."""
    s = np.unique(np.array(starts, np.int64))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] - s[:-1] > LENGTH
    begin, end = s[new], s[np.append(new[1:], True)] + LENGTH
    rest, at = hashlib.sha256(), 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        rest.update(raw[at:a])
        at = b
    rest.update(raw[at:])
    return int((end - begin).sum()), len(begin), rest.hexdigest()


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_removed(t.as_py().encode("utf-8", "replace"), s.as_py()) for t, s in zip(batch.column("text"), batch.column("starts"), strict=True)]
        columns = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), *columns], names=["node", "n_removed", "n_spans", "rest"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Null texts are empty; texts under 200 bytes keep everything.  Repeated rows are copies of one
    another, and so lose all bytes if they have 200.  Other columns, however named, are left out;
    an empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))
    told = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("whole", F.sha2(F.col("text"), 256))
    kind = dict(rows.dtypes)["id"]
    texts = told.mapInArrow(_anchored, f"id {kind}, node binary, n_bytes long, whole string, grams array<bigint>, places array<bigint>")
    texts = write_table(texts.withColumn("row", F.monotonically_increasing_id()), "anchored")
    first = write_table(texts.groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.max("n_bytes").alias("size")), "nodes")
    copies = first.where((F.col("n") > 1) & (F.col("size") >= LENGTH)).select("node")

    zones = texts.select("row", F.xxhash64("node").alias("text"), F.explode(F.arrays_zip("grams", "places")).alias("x")).select("row", "text", F.col("x.grams").alias("gram"), F.col("x.places").alias("place"))
    place = F.xxhash64("text", "place")
    twice = zones.groupBy("gram").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("gram")
    hits = zones.select("row", "gram", "place").join(write_table(twice, "grams"), "gram")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("gram", "place")).alias("zones"))
    # Of copies one is looked at; it is found by its id and bytes in the texts, which have no number of their own.
    named = texts.join(first.select("row"), "row", "left_semi").select("row", "node", F.col("id").alias("own"))
    hits = write_table(hits.join(named, "row").select(F.col("node").alias("name"), "own", "zones"), "hits")
    searched = rows.join(hits, (F.col("node") == F.col("name")) & F.col("id").eqNullSafe(F.col("own")))
    cut_out = write_table(searched.select("node", "text", "zones").mapInArrow(_cut_out, _ZONES), "zones")

    kinds = cut_out.where("body is not null").groupBy("gram", "name", "at", "more", "body").agg((F.min("low") != F.max("high")).alias("whole"))
    kinds = write_table(kinds, "kinds")
    ranges = write_table(repeated_parts(kinds), "ranges")
    ends = cut_out.select("node", "first", "name").join(ranges, "name").select("node", F.explode(F.array(F.col("first") + F.col("a"), F.col("first") + F.col("b"))).alias("start"))
    covered = ends.groupBy("node").agg(F.collect_set("start").alias("starts")).join(copies, "node", "left_anti")
    covered = write_table(covered.join(hits.select(F.col("name").alias("node"), "own"), "node").select(F.col("node").alias("name"), "own", "starts"), "covered")
    drop_table(cut_out)
    done = rows.join(covered, (F.col("node") == F.col("name")) & F.col("id").eqNullSafe(F.col("own"))).select("node", "text", "starts")
    done = done.mapInArrow(_cut, "node binary, n_removed long, n_spans long, rest string")
    done = write_table(done, "removed").groupBy("node").agg(F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max("rest").alias("rest"))
    out = texts.select("id", "node", "n_bytes", "whole").join(done, "node", "left").join(copies.withColumn("copied", F.lit(True)), "node", "left")
    copied = F.col("copied").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"),
    )
