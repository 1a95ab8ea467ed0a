"""WARC: a deterministic sharded writer, and a reader.

Writing.  Records are range-sorted by their integer key.  The shards' bounds come
from the bytes counted in fixed bins of the key's range, so they depend on the data
alone.  Each shard is one task's stream: records in key order, one gzip member each,
rolled to the next file when the compressed size passes ``roll_bytes``.  Headers and
digests are made anew from the payload.  A file is written under a temporary name of
its own attempt and renamed when complete; since a retried task makes the same bytes
under the same final name, a lost executor leaves nothing but temporary files.  The
archive consists of the files in the manifest, which Spark's own commit publishes last.

Equal payloads (of at least ``min_bytes``) are stored once: the row with the smallest
key is a ``response``, the others are ``revisit`` records that name it.

Reading.  The manifest's files are read as streams, record by record; payload digests
are checked against the headers.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.llm.common import UPPER, write_table

#: Bins of the key's range whose sizes decide the shards' bounds; as many rows reach the driver at most.
BINS = 16_384
#: Finer bins that a bin with more than a shard is cut into.
CUT = 16
ALPHABET = UPPER + "234567"  # of base32
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, payload binary"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes, by SQL functions."""
    hexed = F.sha1(text.cast("binary"))
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def _numbers(values: list[int]) -> Column:
    """A constant array; as one literal, since thousands of them are slow to analyse."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def shards_of(rows: DataFrame, shard_bytes: int) -> tuple[Column, int]:
    """The shard of each row as a function of its ``key`` and ``digest``, and the number of shards; ``rows``: (key, digest, size).

    Keys are binned; bins that hold more than a shard are cut into ``CUT`` finer ones, again and
    again down to single keys, so keys that lie far apart or close together make no large shard.
    Sizes are exact sums, so the same rows always give the same shards.  Null keys come first,
    dealt by digest.  Above ``BINS`` shards, these grow instead.
    """
    known = rows.where("key is not null")
    least = known.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    bytes_of = {r["null"]: r["n"] for r in rows.groupBy(F.col("key").isNull().alias("null")).agg(F.sum("size").alias("n")).collect()}
    shard_bytes = max(shard_bytes, sum(bytes_of.values()) // BINS)
    lo, hi = least["lo"] or 0, least["hi"] or 0
    width = 1
    while (hi - lo) // width >= BINS:
        width *= CUT
    place = F.col("key").cast("decimal(20,0)") - F.lit(lo)
    step = lambda x, w: ((x - x % F.lit(w)) / F.lit(w)).cast("int")
    slots, tables = [step(place, width)], []
    while True:
        sizes = {r["slot"]: r["n"] for r in known.groupBy(slots[-1].alias("slot")).agg(F.sum("size").alias("n")).where("slot >= 0").collect()}
        heavy = sorted(s for s, n in sizes.items() if n > shard_bytes) if width > 1 else []
        children = {s: k * CUT for k, s in enumerate(heavy)}
        tables.append((sizes, children))
        if not heavy:
            break
        first = [-CUT] * (max(sizes) + 1)  # below 0 with whatever is added
        for s, at in children.items():
            first[s] = at
        slots.append(F.get(_numbers(first), slots[-1]) + step(place % F.lit(width), width // CUT))
        width //= CUT

    nulls = min(1024, -(-bytes_of.get(True, 0) // shard_bytes))
    shard, held = nulls, 0
    lookups = [[-1] * (max(sizes, default=0) + 1) for sizes, _ in tables]

    def deal(level: int, own: list[int]) -> None:
        nonlocal shard, held
        sizes, children = tables[level]
        for s in own:
            if s in children:
                deal(level + 1, [c for c in range(children[s], children[s] + CUT) if c in tables[level + 1][0]])
                continue
            if held and held + sizes[s] > shard_bytes:
                shard, held = shard + 1, 0
            lookups[level][s] = shard
            held += sizes[s]

    deal(0, sorted(tables[0][0]))
    found = [F.get(_numbers(lookup), s) for lookup, s in zip(lookups, slots, strict=True)]
    of_key = F.greatest(*found, F.lit(-1))
    letters = [F.instr(F.lit(ALPHABET), F.substring("digest", i, 1)) - 1 for i in (1, 2)]
    of_null = F.floor((letters[0] * 32 + letters[1]) * nulls / 1024).cast("int")
    return F.when(F.col("key").isNull(), of_null).otherwise(of_key), shard + 1


def _header(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode()


def _clean(value: str) -> str:
    """A header's value can't hold line ends or other control characters."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}/{digest}')}>"


def make_record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record with its block; a revisit's block holds no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("X-Payload-Bytes", str(len(payload))),
    ]
    if url is not None:
        lines.append(("WARC-Target-URI", _clean(url)))
    if key is not None:
        lines.append(("X-Page-ID", str(key)))
    if refers_to is not None:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    return _header(lines) + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _ShardFiles:
    """The files of one shard: written under temporary names, rolled by compressed size, renamed when complete."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.fs, self.dir = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(self.dir, recursive=True)
        self.shard, self.roll_bytes, self.part, self.sink, self.done = shard, roll_bytes, 0, None, []

    def write(self, member: bytes) -> None:
        if self.sink is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temp = f"{self.dir}/.tmp-{uuid.uuid4().hex}-{self.name}"
            self.sink, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp), 0, 0, hashlib.sha256()
        self.sink.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.fs.move(self.temp, f"{self.dir}/{self.name}")
            self.done.append((self.name, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.sink, self.part = None, self.part + 1

    def abort(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.fs.delete_file(self.temp)
            self.sink = None


def write_warc(df: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, shard_bytes: int = 256 << 20, roll_bytes: int = 32 << 20) -> DataFrame:
    """Write ``df`` as WARC files under ``root``; returns the manifest (file, shard, records, bytes, sha256).

    ``key`` is an integer column.  Null payloads are empty; a null URL has no target
    header; rows with a null key come first and are responses.  Rows that share key and
    payload are records of the same type.  An empty table gives an empty manifest.  Other
    columns of ``df``, however named, are left out.

    One wide shuffle: narrow (key, digest) rows are aggregated and joined by digest, where
    Spark may split a hot digest, and only the few marks of revisits travel on to the
    range shuffle that sorts the payloads.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`"), F.lit("")).alias("payload"))
    size = F.octet_length("payload").cast("long")
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    narrow = write_table(rows.select("key", "digest", (size + 600).alias("size"), (size >= min_bytes).alias("large")), "digests")
    shard, shards = shards_of(narrow, shard_bytes)
    ids = narrow.where("large").select("key", "digest")
    firsts = ids.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marks = ids.join(firsts, "digest").where(F.col("key") > F.col("first")).select("key", F.col("digest"), "first").groupBy("key", "digest").agg(F.first("first").alias("first"))
    both = rows.withColumns({"first": F.lit(None).cast("long"), "mark": F.lit(0)}).unionByName(marks.withColumn("mark", F.lit(-1)), allowMissingColumns=True)
    both = both.withColumn("shard", shard).repartitionByRange(shards, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "digest", "mark", "url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, mark = [], None, None
        try:
            for batch in batches:
                cols = [batch.column(n) for n in ("shard", "key", "url", "payload", "digest", "first", "mark")]
                for i in range(batch.num_rows):
                    s, k, u, p, d, first, is_mark = (c[i].as_py() for c in cols)
                    if is_mark:
                        mark = (k, d, first)
                        continue
                    if out is None or out.shard != s:
                        if out:
                            out.close()
                            done += out.done
                        out = _ShardFiles(root, s, roll_bytes)
                    refers_to = mark[2] if mark and mark[:2] == (k, d) else None
                    out.write(gzip_member(make_record(k, u, p.encode(), d, refers_to)))
            if out:
                out.close()
                done += out.done
        except BaseException:
            if out:
                out.abort()
            raise
        names = ["file", "shard", "records", "bytes", "sha256"]
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in done], t) for j, t in enumerate(types)], names=names)

    with _small_batches(spark):
        manifest = both.mapInArrow(write, "file string, shard int, records long, bytes long, sha256 string")
        manifest.write.parquet(f"{root}/_manifest")
    return spark.read.parquet(f"{root}/_manifest")


class _small_batches:
    """Payloads may be long: few rows in an Arrow batch while a plan that reads them runs."""

    def __init__(self, spark: SparkSession, rows: int = 64):
        self.conf, self.rows, self.name = spark.conf, rows, "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __enter__(self):
        self.before = self.conf.get(self.name)
        self.conf.set(self.name, str(self.rows))

    def __exit__(self, *_):
        self.conf.set(self.name, self.before)


def members(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time."""
    unpacker, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(block)
        if not data:
            break
        parts.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the file ends within a gzip member")


def parse_record(record: bytes) -> dict:
    """Headers (as sent) and the payload of a record; wrong digests raise."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError(f"wrong block digest in {headers['WARC-Record-ID']}")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}":
        raise ValueError(f"wrong payload digest in {headers['WARC-Record-ID']}")
    return {"headers": headers, "payload": payload}


def read_warc(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """The records of the archive under ``root``: only files in its manifest count, each checked for its record count."""
    files = spark.read.parquet(f"{root}/_manifest").select("file", "records")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for name, count in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist(), strict=True):
                rows, seen = [], 0
                with fs.open_input_stream(f"{where}/{name}") as stream:
                    for record in members(stream):
                        seen += 1
                        x = parse_record(record)
                        h, key, ref = x["headers"], x["headers"].get("X-Page-ID"), x["headers"].get("X-Refers-To-Page-ID")
                        rows.append((None if key is None else int(key), h.get("WARC-Target-URI"), int(h["X-Payload-Bytes"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], None if ref is None else int(ref), name, x["payload"] if with_payload and h["WARC-Type"] == "response" else None))
                        if len(rows) >= 64:
                            yield _records(rows)
                            rows = []
                if seen != count:
                    raise ValueError(f"{os.path.basename(name)} holds {seen} records; the manifest says {count}")
                yield _records(rows)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(read, RECORD_SCHEMA)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)
