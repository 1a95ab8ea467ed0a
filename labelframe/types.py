"""Logical column types, their categories and capabilities, and how Spark holds them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class TypeId(Enum):
    REAL = "REAL"
    INTEGER = "INTEGER"
    NOMINAL = "NOMINAL"
    DATE_TIME = "DATE_TIME"
    TIME = "TIME"
    TEXT = "TEXT"
    TEXT_SET = "TEXT_SET"
    TEXT_LIST = "TEXT_LIST"


class Category(Enum):
    NUMERIC = "NUMERIC"
    CATEGORICAL = "CATEGORICAL"
    OBJECT = "OBJECT"


class Capability(Enum):
    NUMERIC_READABLE = "NUMERIC_READABLE"
    OBJECT_READABLE = "OBJECT_READABLE"
    SORTABLE = "SORTABLE"


class Order(Enum):
    ASCENDING = "ASCENDING"
    DESCENDING = "DESCENDING"


NUMERIC, OBJECT, SORTABLE = Capability.NUMERIC_READABLE, Capability.OBJECT_READABLE, Capability.SORTABLE


@dataclass(frozen=True)
class ColumnType:
    """What a logical type is; ``spark`` is how a frame holds it (null is missing)."""

    id: TypeId
    category: Category
    element_type: type
    capabilities: frozenset[Capability]
    spark: T.DataType
    comparator: Callable | None = None

    def has_capability(self, capability: Capability) -> bool:
        return capability in self.capabilities


def _compare(a, b) -> int:
    return (a > b) - (a < b)


def _compare_sets(a, b) -> int:
    """By size, then by sorted content."""
    return _compare((len(a), sorted(a)), (len(b), sorted(b)))


_STRINGS = T.ArrayType(T.StringType(), True)

TYPES: dict[TypeId, ColumnType] = {
    t.id: t
    for t in (
        ColumnType(TypeId.REAL, Category.NUMERIC, float, frozenset({NUMERIC, SORTABLE}), T.DoubleType(), _compare),
        ColumnType(TypeId.INTEGER, Category.NUMERIC, float, frozenset({NUMERIC, SORTABLE}), T.DoubleType(), _compare),
        ColumnType(TypeId.NOMINAL, Category.CATEGORICAL, str, frozenset({NUMERIC, OBJECT, SORTABLE}), T.StringType(), _compare),
        ColumnType(TypeId.DATE_TIME, Category.OBJECT, dt.datetime, frozenset({OBJECT, SORTABLE}), T.TimestampNTZType(), _compare),
        ColumnType(TypeId.TIME, Category.OBJECT, int, frozenset({NUMERIC, OBJECT, SORTABLE}), T.LongType(), _compare),
        ColumnType(TypeId.TEXT, Category.OBJECT, str, frozenset({OBJECT, SORTABLE}), T.StringType(), _compare),
        ColumnType(TypeId.TEXT_SET, Category.OBJECT, list, frozenset({OBJECT, SORTABLE}), _STRINGS, _compare_sets),
        ColumnType(TypeId.TEXT_LIST, Category.OBJECT, list, frozenset({OBJECT, SORTABLE}), _STRINGS, _compare),
    )
}

#: The largest nanosecond of a day.
MAX_TIME = 86_399_999_999_999


def for_id(type_id: TypeId) -> ColumnType:
    return TYPES[type_id]


def infer(data_type: T.DataType) -> TypeId | None:
    """The logical type of a Spark type; None for those that the data model lacks."""
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return TypeId.REAL
    if isinstance(data_type, T.IntegralType):
        return TypeId.INTEGER
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TypeId.DATE_TIME
    if isinstance(data_type, T.StringType):
        return TypeId.TEXT
    if isinstance(data_type, T.ArrayType) and isinstance(data_type.elementType, T.StringType):
        return TypeId.TEXT_LIST
    return None
