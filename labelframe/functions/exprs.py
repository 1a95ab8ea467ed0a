"""Column expressions that give the engine's semantics inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.types import Order, TypeId


def null_nan(c: Column) -> Column:
    """A double with NaN turned into missing."""
    d = c.cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def round53(c: Column) -> Column:
    """Half up (towards plus infinity) to a whole double; infinities stay, huge values saturate at 64 bits."""
    d = c.cast("double")
    low = F.floor(d).cast("double")
    whole = low + F.when(d - low >= F.lit(0.5), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(d.isNull() | F.isnan(d), None).when(F.abs(d) == F.lit(float("inf")), d).otherwise(whole)


def to_type(c: Column, type_id: TypeId) -> Column:
    """A value as a frame holds it for a logical type."""
    match type_id:
        case TypeId.REAL:
            return null_nan(c)
        case TypeId.INTEGER:
            return round53(null_nan(c))
        case TypeId.TIME:
            return c.cast("long")
        case TypeId.DATE_TIME:
            return c.cast("timestamp_ntz")
        case TypeId.TEXT_SET:
            return F.array_distinct(F.array_compact(c))
        case TypeId.TEXT_LIST:
            return F.array_compact(c)
        case _:
            return c.cast("string")


def sort_keys(c: Column, type_id: TypeId, order: Order) -> list[Column]:
    """Missing last ascending and first descending; -0.0 before 0.0; sets by size, then sorted content."""
    keys = [c]
    if type_id in (TypeId.REAL, TypeId.INTEGER):
        keys = [c, F.when(c.cast("string") == "-0.0", 0).otherwise(1)]
    elif type_id is TypeId.TEXT_SET:
        keys = [F.size(c), F.array_sort(c)]
        keys[0] = F.when(c.isNotNull(), keys[0])
    if order is Order.ASCENDING:
        return [k.asc_nulls_last() for k in keys]
    return [k.desc_nulls_first() for k in keys]


def two_valued(condition: Column, when_missing: bool = False) -> Column:
    """A condition that is never null: a missing operand gives ``when_missing``."""
    return F.coalesce(condition, F.lit(when_missing))


def percentile_of(values: Column, p: float) -> Column:
    """The value at rank p (n + 1) of a sorted array without missing values, interpolated; null if it is empty."""
    n = F.size(values)
    rank = F.lit(p) * (n + 1)
    i = F.floor(rank).cast("int")
    at = F.get(values, i - 1)
    between = at + (rank - i) * (F.get(values, i) - at)
    return F.when(n == 0, None).when(i < 1, F.get(values, F.lit(0))).when(i >= n, F.get(values, n - 1)).otherwise(between)


def densify(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, its rows' places 0 .. n-1 in the order of ``keys``, without a single-partition window.

    Rows are range-sorted; a row's place is the size of the partitions before its own plus
    its place in it.  The sorted rows are persisted, since both are read from the same cut;
    one count a partition reaches the driver.  Without keys, the rows' present order counts.
    Keys need a unique last one for a defined order.
    """
    spark = df.sparkSession
    if keys:
        n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    marked = df.withColumns({"__labelframe_part": F.spark_partition_id(), "__labelframe_mono": F.monotonically_increasing_id()}).persist()
    counts = {r["__labelframe_part"]: r["count"] for r in marked.groupBy("__labelframe_part").count().collect()}
    offsets, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(total)
        total += counts.get(part, 0)
    place = F.get(F.lit(offsets or [0]), F.col("__labelframe_part")) + F.col("__labelframe_mono").bitwiseAND((1 << 33) - 1)
    return marked.withColumn(name, place.cast("long")).drop("__labelframe_part", "__labelframe_mono")
