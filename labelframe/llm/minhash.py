"""Near duplicates by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles, and two texts are near duplicates if
their weighted Jaccard similarity (sum of smaller counts over sum of larger ones) is at
least 0.8.

Signature.  Each shingle owns Poisson processes over its count's axis, cut into the
dyadic intervals [0,1), [1,2), [2,4), [4,8) ... of discretised weights; a point has a
time, a unit cell of the axis and one of the signature's components.  A text takes the
points whose cell lies below the shingle's count, and a component is the earliest time
that falls on it.  Two texts agree in a component with probability equal to their
weighted Jaccard similarity.  Points come in order of time, so a shingle's stream ends as
soon as it passes the largest component: about ``n + m ln m`` points for ``n`` shingles
and ``m`` components, however large the counts are.

Search.  Signatures are cut into bands; texts that share a band's bucket are candidates.
Only connections matter, so a bucket's candidates are compared in two steps.  First the
tree of the likeliest links, a link less than members, is verified on the texts and joined to
components.  Then the members outside a bucket's largest component, which are few in a group of
copies, are compared with all members of other components, in blocks: by sketches, and on
the texts where these leave a doubt.  No pair of texts that might connect two components goes
unseen, whatever a bucket's size, and a pair is looked at in the first bucket it shares.

Exact copies are collapsed first and never compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.llm.common import Memo, drop_table, kept, write_table
from labelframe.llm.graphs import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6  # at 0.8, a pair shares no band in 6 of 100,000 cases
SIZE = BANDS * ROWS
#: A pair at the threshold looks less similar than ``SIMILARITY - MARGIN`` in its sketches in 2 of 100,000 cases.
MARGIN = 0.12
#: Members of a bucket that one task compares: texts outside the largest component, and texts.
FEW, MANY = 256, 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Memory:
    """What a worker keeps: hashes of words, and the shingles of the texts met lately."""

    def __init__(self, bound: int = 1_500_000):
        self.word = Memo(xxhash.xxh64_intdigest, 500_000)
        self.bags: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held, self.bound = 0, bound

    def bag(self, node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the text named ``node``; all are let go beyond ``bound`` shingles."""
        bag = self.bags.get(node)
        if bag is None:
            if self.held > self.bound:
                self.bags, self.held = {}, 0
            bag = self.bags[node] = shingles(text)
            self.held += len(bag[0])
        return bag


def _memory() -> _Memory:
    return kept("minhash", _Memory)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the whole text (64-bit hashes) and their counts.

    Words are split at white space and lower-cased; a text of one to four words is one shingle.
    """
    words = (text or "").lower().encode("utf-8", "replace").split()
    n = min(WORDS, len(words))
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    memo = _memory().word
    memo.trim()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    count = len(h) - n + 1
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total = mix(total + h[i : i + count])
    return np.unique(total, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets; 0 if either is empty."""
    if len(a[0]) == 0 or len(b[0]) == 0:
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)  # both are sorted
    both = int(np.minimum(a[1][at], b[1])[a[0][at] == b[0]].sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """A row of ``size`` earliest times for each multiset; infinite throughout for an empty one."""
    out = np.full((len(bags), size), np.inf)
    lengths = np.array([len(e) for e, _ in bags])
    if lengths.sum() == 0:
        return out
    element = np.concatenate([e for e, _ in bags])
    weight = np.concatenate([w for _, w in bags]).astype(np.int64)
    owner = np.repeat(np.arange(len(bags)), lengths)
    streams = []
    level, low = 0, 0
    while (inside := weight > low).any():
        width = max(1, low)
        salt = np.uint64(level * int(_GOLDEN) % 2**64)
        streams.append((mix(element[inside] + salt), weight[inside], owner[inside], np.full(int(inside.sum()), low), np.full(int(inside.sum()), width)))
        level, low = level + 1, low + width
    seed, weight, owner, low, width = (np.concatenate(x) for x in zip(*streams, strict=True))
    time, drawn = np.zeros(len(seed)), 0
    flat = out.reshape(-1)
    while len(seed):
        k = int(np.clip(60_000 // len(seed), 1, 64))
        number = np.arange(drawn + 1, drawn + 1 + k, dtype=np.uint64)
        bits = mix(seed[:, None] + number[None, :] * _GOLDEN)
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * width)[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        place = mix(bits + _GOLDEN)
        component = (place & np.uint64(0xFFFFFFFF)) % np.uint64(size)
        cell = low[:, None] + ((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[:, None]).astype(np.int64)
        accept = cell < weight[:, None]
        where = owner[:, None] * size + component.astype(np.int64)
        np.minimum.at(flat, where[accept], at[accept])
        time, drawn = at[:, -1], drawn + k
        open_ = time < out.max(axis=1)[owner]
        seed, weight, owner, low, width, time = (x[open_] for x in (seed, weight, owner, low, width, time))
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit bucket names, a column per band."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * _GOLDEN + bits[:, :, r])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """A byte for each component; two rows agree in a byte as often as in a component, and once in 256 by chance."""
    return (mix(signature.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)


def node_of(text: Column) -> Column:
    """The name of an exact text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        keys: list = []
        marks: list = []
        at = 0
        while at < len(texts):
            bags, held, first = [], 0, at
            while at < len(texts) and held < 100_000:
                bags.append(shingles(texts[at].as_py()))
                held += len(bags[-1][0])
                at += 1
            signature = signatures(bags)
            found, short = band_keys(signature), sketches(signature)
            marks += [x.tobytes() for x in short]
            keys += [found[i].tolist() if len(bags[i][0]) else [] for i in range(at - first)]
        arrays = [batch.column("id"), batch.column("node"), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "node", "bands", "sketch"])


def _members(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    """The row numbers of a batch and their lists of members."""
    lists = batch.column("members")
    flat, cuts = lists.flatten(), lists.offsets.to_numpy()
    for i in range(batch.num_rows):
        yield i, flat.slice(cuts[i] - cuts[0], cuts[i + 1] - cuts[i])


def _fixed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of byte strings of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities as sketches show them, of a row with rows or of rows with rows."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def tree(sketch: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The links of at least ``least`` in the tree of largest estimated similarities that spans all rows (Prim's)."""
    out = []
    near = estimated(sketch, sketch[0])
    source = np.zeros(len(sketch), np.int64)
    near[0] = -2.0
    for _ in range(len(sketch) - 1):
        i = int(near.argmax())
        if near[i] >= least:
            out.append((int(source[i]), i))
        now = estimated(sketch, sketch[i])
        closer = (now > near) & (near > -2.0)
        source[closer] = i
        near[closer] = now[closer]
        near[i] = -2.0
    return out


_PAIRS = "place long, a binary, b binary"


def _trees(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (a < b) of the trees of the batches' (place, members: node, sketch)."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        place = batch.column("place").to_pylist()
        for i, members in _members(batch):
            nodes = members.field("node").to_pylist()
            for x, y in tree(_fixed(members.field("sketch"), np.uint8, SIZE), least):
                for column, value in zip(out, (place[i], min(nodes[x], nodes[y]), max(nodes[x], nodes[y])), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["place", "a", "b"])


def _crossing(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(place, nodes, pairs): the pairs of a row's few members with all its others, of other components, that this bucket is the first to hold.

    Rows: (place, key, members: node, component, few, asks, sketch, bands).  ``pairs``: the names of
    both texts of each pair in a row; ``nodes``: the texts that are needed for them, each once.
    """
    for batch in batches:
        place, key = batch.column("place").to_pylist(), batch.column("key").to_pylist()
        for i, members in _members(batch):
            nodes = members.field("node").to_pylist()
            sketch = _fixed(members.field("sketch"), np.uint8, SIZE)
            bands = members.field("bands").flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), BANDS)
            component = np.unique(np.array(members.field("component").to_pylist(), object), return_inverse=True)[1]
            name = np.unique(np.array(nodes, object), return_inverse=True)[1]
            few = np.flatnonzero(members.field("asks").to_numpy(zero_copy_only=False))
            others = np.flatnonzero(~members.field("asks").to_numpy(zero_copy_only=False))
            among = members.field("few").to_numpy(zero_copy_only=False)[others]
            pairs = []
            for x in few:
                # Two of the few meet twice; the lower one asks.
                open_ = others[(component[others] != component[x]) & (~among | (name[others] > name[x]))]
                hit = open_[estimated(sketch[open_], sketch[x]) >= least]
                same = bands[hit] == bands[x]
                first = same.argmax(axis=1)
                hit = hit[bands[x][first] == key[i]]
                pairs += [(nodes[x], nodes[y]) for y in hit.tolist()]
            if pairs:
                needed = sorted({x for pair in pairs for x in pair})
                arrays = [pa.array([place[i]], pa.int64()), pa.array([needed], pa.list_(pa.binary())), pa.array([b"".join(a + b for a, b in pairs)], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["place", "nodes", "pairs"])


def _compared(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The links among each place's pairs.  Rows come by place, its texts before its pairs."""
    memory = _memory()
    now, bags = None, {}
    for batch in batches:
        node, text, pairs = (batch.column(c) for c in ("node", "text", "pairs"))
        out: tuple[list, list, list] = ([], [], [])
        for i, place in enumerate(batch.column("place").to_pylist()):
            if place != now:
                now, bags = place, {}
            named = pairs[i].as_py()
            if named is None:
                name = node[i].as_py()
                bags[name] = memory.bag(name, text[i].as_py())
                continue
            for at in range(0, len(named), 32):
                a, b = named[at : at + 16], named[at + 16 : at + 32]
                if (found := similarity(bags[a], bags[b])) >= threshold:
                    for column, value in zip(out, (min(a, b), max(a, b), found), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.float64())], names=["a", "b", "similarity"])


def verify(needed: DataFrame, pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of those of the pairs that are similar by their texts.

    ``needed``: (place, node); ``pairs``: (place, pairs), the names of each pair in a row.  A text is
    sent once to each place that has a pair of it, not once for each pair.
    """
    sent = needed.join(texts.select("node", "text"), "node").select("place", "node", "text", F.lit(None).cast("binary").alias("pairs"))
    rows = sent.unionByName(pairs.select("place", F.lit(None).cast("binary").alias("node"), F.lit(None).cast("string").alias("text"), "pairs"))
    rows = rows.repartition("place").sortWithinPartitions("place", F.col("node").asc_nulls_last())
    return rows.mapInArrow(lambda b: _compared(b, threshold), "a binary, b binary, similarity double")


def links(signed: DataFrame, rows: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """The (node, component) of all texts that share a bucket with another, and the verified links (a, b, similarity) that say so.

    ``signed``: (id, node, bands, sketch); ``rows``: (id, node, text).
    """
    least = threshold - MARGIN
    # Rows of one text are alike but for their ids.
    marks = write_table(signed.groupBy("node").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "marks")
    buckets = marks.select("node", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = write_table(buckets.join(sizes, "key").select("key", "node", "n"), "members")
    own = marks.join(members.select("node").distinct(), "node", "left_semi")
    texts = rows.join(own.select(F.col("node").alias("m"), F.col("id").alias("i")), (F.col("node") == F.col("m")) & F.col("id").eqNullSafe(F.col("i")))
    texts = write_table(texts.select("node", "text"), "texts")

    part = lambda n, most: F.pmod(F.xxhash64("node", "key"), F.ceil(n / F.lit(most)))
    sketched = members.join(marks.select("node", "sketch"), "node").select(F.xxhash64("key", part(F.col("n"), MANY)).alias("place"), "node", "sketch")
    groups = sketched.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("node", "sketch"))).alias("members"))
    pairs = groups.mapInArrow(lambda b: _trees(b, least), _PAIRS).groupBy("a", "b").agg(F.min("place").alias("place"))
    pairs = write_table(pairs.select("place", "a", "b"), "pairs")
    needed = pairs.select("place", F.explode(F.array("a", "b")).alias("node")).distinct()
    found = write_table(verify(needed, pairs.select("place", F.concat("a", "b").alias("pairs")), texts, threshold), "found")
    joined = components(found)

    labelled = members.join(joined, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    # Pairs alone in a bucket have been looked at.
    open_ = parts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("n")).where("n > 2 and top.size < n")
    rest = labelled.join(open_.select("key", F.col("top.component").alias("main"), (F.col("n") - F.col("top.size")).alias("rest")), "key")
    rest = rest.withColumn("few", F.col("component") != F.col("main")).join(marks.select("node", "sketch", "bands"), "node")
    one = F.struct("node", "component", "few", "asks", "sketch", "bands").alias("one")
    blocks = lambda n, most: F.sequence(F.lit(0), (F.ceil(n / F.lit(most)) - 1).cast("int"))
    asking = rest.where("few").withColumn("asks", F.lit(True)).select("key", part(F.col("rest"), FEW).cast("int").alias("x"), F.explode(blocks(F.col("n"), MANY)).alias("y"), one)
    asked = rest.withColumn("asks", F.lit(False)).select("key", F.explode(blocks(F.col("rest"), FEW)).alias("x"), part(F.col("n"), MANY).cast("int").alias("y"), one)
    groups = asking.unionByName(asked).groupBy("key", "x", "y").agg(F.collect_list("one").alias("members")).select(F.xxhash64("key", "x", "y").alias("place"), "key", "members")
    more = write_table(groups.mapInArrow(lambda b: _crossing(b, least), "place long, nodes array<binary>, pairs binary"), "crossing")
    if not more.isEmpty():
        new = write_table(verify(more.select("place", F.explode("nodes").alias("node")), more, texts, threshold), "found")
        found = found.unionByName(new)
        joined = components(found)
    for done in (pairs, texts, more):
        drop_table(done)
    return joined, found


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """A row per row: id, ``node`` (name of its exact text), ``class_id``, ``copy_of``.

    ``class_id``: the smallest id in the component of near duplicates; ``copy_of``: the smallest id
    with the very same text.  Null texts
    are empty ones; texts without words are near duplicates of the same text alone.  Repeated rows
    stay, with the same class.  Null ids stay too; a class of null ids alone has a null id.
    Other columns, however named, are left out.  An empty table gives an empty result.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))
    kind = dict(rows.dtypes)["id"]
    signed = write_table(rows.mapInArrow(_signed, f"id {kind}, node binary, bands array<bigint>, sketch binary"), "signed")
    named, _ = links(signed, rows, threshold)
    first = signed.groupBy("node").agg(F.min("id").alias("copy_of"))
    joined = first.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = joined.groupBy("component").agg(F.min("copy_of").alias("class_id"))
    texts = joined.join(lowest, "component").select("node", "class_id", "copy_of")
    return signed.select(F.col("id").alias(id_col), "node").join(texts, "node").select(F.col(f"`{id_col}`"), "node", "class_id", "copy_of")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each class of near duplicates: that of the smallest id (one row, even if it is repeated)."""
    own = F.col(f"`{id_col}`")
    named = near_duplicates(df, id_col, text_col, threshold).where(F.col("class_id").eqNullSafe(own) & F.col("copy_of").eqNullSafe(own))
    # The key spreads copies of one text; it also serves the removal of repeated rows, without another shuffle.
    chosen = named.select(F.xxhash64(own, "node").alias("key"), "node")
    # The row travels as a struct, so its columns clash with none.
    rows = df.select(F.struct("*").alias("row"), node_of(F.col(f"`{text_col}`")).alias("node"), own.alias("id"))
    rows = rows.select("row", F.xxhash64("id", "node").alias("key"), "node")
    return rows.join(chosen, ["key", "node"], "left_semi").dropDuplicates(["key", "node"]).select("row.*")
