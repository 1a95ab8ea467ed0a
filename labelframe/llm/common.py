"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and \\x09 to \\x0D.  ``bytes.split()`` splits at these very bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_written: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``; only where that is
    unset, as in tests, a temporary folder of this machine stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='labelframe-')}"
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this Python ends."""
    path = f"{shared_dir(spark)}/labelframe/{uuid.uuid4().hex}-{name}"
    if not _written:
        atexit.register(_remove_written)
    _written[path] = spark
    return path


def _remove_written() -> None:
    for path in list(_written):
        try:
            remove(_written.pop(path), path)
        except Exception:  # noqa: BLE001  the session may be gone by then
            return


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


#: With it, Spark removes a query's shuffle files when it has ended: a written table needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that end meanwhile are removed at once, not when the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def write_table(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it from there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with freeing_shuffles(spark):
        df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that ``write_table`` has written and nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        remove(df.sparkSession, path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that an operator is about to add (a clashing input column gives way)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``df`` is named so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket_of(id_column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.crc32(c.cast("string").cast("binary")) % modulus


def sample_texts(texts: DataFrame, n: int, max_chars: int) -> DataFrame:
    """(text) of the ``n`` different texts with the smallest hashes among those of at most ``max_chars`` characters.

    The hashes are chosen alone; texts are then met by a broadcast of those ``n`` and copies
    combined before they are shuffled, so no task gathers texts from many others.
    """
    hashed = texts.where(F.length("text") <= max_chars).select(F.xxhash64("text").alias("_h"), "text")
    chosen = hashed.select("_h").distinct().orderBy("_h").limit(n)
    return hashed.join(F.broadcast(chosen), "_h").groupBy("_h").agg(F.min("text").alias("text")).select("text")


_kept: dict[str, object] = {}


def kept(owner: str, make, key: object = None):
    """What ``make`` gives, kept in this Python process for ``owner``.

    Workers outlive an operator and serve the next one, so only one owner's memory is held at a
    time: that of another owner, or of another ``key``, is let go first.
    """
    if _kept.get("owner") != (owner, key):
        _kept.clear()
        _kept["value"] = make()
        _kept["owner"] = (owner, key)
    return _kept["value"]


class Memo(dict):
    """A dict that computes what it lacks.  ``trim`` empties it beyond ``bound`` entries, so memory is bounded."""

    def __init__(self, of, bound: int = 1_000_000):
        super().__init__()
        self.of, self.bound = of, bound

    def __missing__(self, key):
        value = self[key] = self.of(key)
        return value

    def trim(self) -> None:
        if len(self) > self.bound:
            self.clear()
