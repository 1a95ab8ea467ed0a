"""Descriptive statistics of a column."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelframe.functions.exprs import densify, percentile_of
from labelframe.types import Category, TypeId


class Statistic(Enum):
    COUNT = "COUNT"
    MIN = "MIN"
    MAX = "MAX"
    MEAN = "MEAN"
    VAR = "VAR"
    SD = "SD"
    P25 = "P25"
    P50 = "P50"
    MEDIAN = "MEDIAN"
    P75 = "P75"
    LEAST = "LEAST"
    MODE = "MODE"
    INDEX_COUNTS = "INDEX_COUNTS"


_NUMERIC = frozenset(Statistic) - {Statistic.LEAST, Statistic.MODE, Statistic.INDEX_COUNTS}
_QUANTILES = {Statistic.P25: 0.25, Statistic.P50: 0.5, Statistic.MEDIAN: 0.5, Statistic.P75: 0.75}
#: Values up to which a percentile sorts one array in one task; beyond, ranks are looked up in a range sort.
ARRAY_VALUES = 1_000_000


@dataclass(frozen=True)
class Result:
    numeric: float = math.nan
    categorical: int = 0
    object: object = None
    counts: tuple[int, ...] = ()

    def get_numeric(self) -> float:
        return self.numeric

    def get_categorical(self) -> int:
        return self.categorical

    def get_object(self, kind: type | None = None):
        if kind is not None and self.object is not None and not isinstance(self.object, kind):
            raise TypeError(f"{self.object!r} is no {kind.__name__}")
        return self.object

    def count_for_index(self, index: int) -> int:
        return self.counts[index] if 0 <= index < len(self.counts) else 0


def supported(type_id: TypeId, statistic: Statistic) -> bool:
    match type_id:
        case TypeId.REAL | TypeId.INTEGER:
            return statistic in _NUMERIC
        case TypeId.TIME:
            return statistic in _NUMERIC - {Statistic.VAR}
        case TypeId.DATE_TIME:
            return statistic in (Statistic.COUNT, Statistic.MIN, Statistic.MAX)
        case TypeId.NOMINAL:
            return statistic in (Statistic.COUNT, Statistic.LEAST, Statistic.MODE, Statistic.INDEX_COUNTS)
    return statistic is Statistic.COUNT


def mean_of(c: Column) -> Column:
    """Never outside the values: clamped where rounding put it there, missing where it is not finite."""
    m, low, high = F.avg(c), F.min(c), F.max(c)
    infinite = F.lit(float("inf"))
    finite = (F.abs(low) != infinite) & (F.abs(high) != infinite)
    inside = F.when(m < low, low).when(m > high, high).otherwise(m)
    return F.when(F.isnan(m) | (F.abs(m) == infinite), None).when(finite, inside).otherwise(None)


def variance_of(c: Column) -> Column:
    """Of the sample; missing below two values or without a finite mean."""
    return F.when((F.count(c) < 2) | mean_of(c).isNull(), None).otherwise(F.var_samp(c))


def aggregates(c: Column, type_id: TypeId, statistics: Iterable[Statistic]) -> dict[Statistic, Column]:
    """The statistics that one pass of plain aggregates gives."""
    time = type_id is TypeId.TIME
    d = c.cast("double") if time else c
    whole = lambda x: F.floor(x).cast("long") if time else x
    made = {
        Statistic.COUNT: lambda: F.count(c),
        Statistic.MIN: lambda: F.min(c),
        Statistic.MAX: lambda: F.max(c),
        Statistic.MEAN: lambda: whole(mean_of(d)),
        Statistic.VAR: lambda: variance_of(d),
        Statistic.SD: lambda: whole(F.sqrt(variance_of(d))),
    }
    return {s: made[s]() for s in statistics if s in made}


def percentiles(df: DataFrame, c: Column, ps: list[float]) -> list[float | None]:
    """Interpolated at rank p (n + 1)."""
    values = df.where(c.isNotNull()).select(c.cast("double").alias("v"))
    n = values.count()
    if n <= ARRAY_VALUES:
        row = values.agg(F.sort_array(F.collect_list("v")).alias("a")).select(*[percentile_of(F.col("a"), p).alias(f"p{i}") for i, p in enumerate(ps)]).first()
        return list(row)
    places = {}
    for p in ps:
        i = math.floor(p * (n + 1))
        places[p] = (min(max(i, 1), n), min(max(i + 1, 1), n))
    wanted = sorted({i - 1 for pair in places.values() for i in pair})
    ranked = densify(values, [F.col("v").asc()], "place").where(F.col("place").isin(wanted)).collect()
    at = {r["place"]: r["v"] for r in ranked}
    out = []
    for p in ps:
        rank = p * (n + 1)
        low, high = (at[i - 1] for i in places[p])
        out.append(low if rank < 1 or rank >= n else low + (rank - math.floor(rank)) * (high - low))
    return out


def compute(column, statistics: Statistic | Iterable[Statistic]):
    """One result, or a dict of them: one pass of aggregates, one of percentiles, one of counts by category."""
    if isinstance(statistics, Statistic):
        return compute(column, [statistics])[statistics]
    statistics = list(statistics)
    type_id = column.type.id
    for s in statistics:
        if not supported(type_id, s):
            raise NotImplementedError(f"{s.value} is not defined for {type_id.value}")
    if not statistics:
        return {}
    table = column.as_table("value")
    df, c = table.df, F.col("value")
    out: dict[Statistic, Result] = {}
    plain = aggregates(c, type_id, statistics)
    if plain:
        row = df.agg(*[e.alias(s.value) for s, e in plain.items()]).first()
        for s in plain:
            out[s] = _result(row[s.value], type_id, s)
    asked = [s for s in statistics if s in _QUANTILES]
    if asked:
        ps = sorted({_QUANTILES[s] for s in asked})
        found = dict(zip(ps, percentiles(df, c, ps), strict=True))
        for s in asked:
            v = found[_QUANTILES[s]]
            out[s] = _result(math.floor(v) if v is not None and type_id is TypeId.TIME else v, type_id, s)
    if column.type.category is Category.CATEGORICAL and set(statistics) - {Statistic.COUNT}:
        out |= _categories(table, df, statistics)
    return {s: out[s] for s in statistics}


def _result(value, type_id: TypeId, statistic: Statistic) -> Result:
    if type_id in (TypeId.REAL, TypeId.INTEGER) or statistic is Statistic.COUNT:
        return Result(math.nan if value is None else float(value))
    return Result(math.nan if value is None or type_id is not TypeId.TIME else float(value), 0, value)


def _categories(table, df: DataFrame, statistics) -> dict[Statistic, Result]:
    """At most as many rows as the dictionary has values reach the driver."""
    dictionary = table.dictionary("value")
    counts = {r["value"]: r["count"] for r in df.groupBy("value").count().collect()}
    used = [(counts[e.value], e.index, e.value) for e in dictionary if counts.get(e.value)]
    out = {}
    for s in statistics:
        if s is Statistic.INDEX_COUNTS:
            by_index = [0] * (dictionary.maximal_index() + 1)
            by_index[0] = counts.get(None, 0)
            for n, i, _ in used:
                by_index[i] = n
            out[s] = Result(counts=tuple(by_index))
        elif s in (Statistic.MODE, Statistic.LEAST):
            sign = -1 if s is Statistic.MODE else 1
            n, i, v = min(used, key=lambda x: (sign * x[0], x[1]), default=(0, 0, None))
            out[s] = Result(float(n), i, v)
    return out
