"""Append columns and tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import functions as F

from labelframe.dictionary import Dictionary
from labelframe.errors import ColumnsNotAppendableError, IncompatibleTypesError, LabelMismatchError, WidthMismatchError
from labelframe.functions.exprs import densify
from labelframe.table import ROW, Field, Key, Table
from labelframe.types import TypeId


def _common(a: TypeId, b: TypeId) -> TypeId | None:
    if a is b:
        return a
    return TypeId.REAL if {a, b} == {TypeId.REAL, TypeId.INTEGER} else None


def _stacked(tables: Sequence[Table], labels: list[str]):
    """One frame: rows of each table in its order, tables in theirs."""
    parts = []
    for i, t in enumerate(tables):
        t = t.with_rows()
        parts.append(t.df.select(*[t.col(x) for x in labels], F.lit(i).alias("__labelframe_table"), F.col(ROW).alias("__labelframe_in")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _dictionary(tables: Sequence[Table], label: str) -> Dictionary | None:
    """Boolean only if all are, with the same positive and negative value; the positive one is then known even if unused."""
    declared = [t.dictionaries.get(label) for t in tables]
    if not all(d is not None and d.boolean for d in declared):
        return None
    positives = {d.positive for d in declared if d.positive is not None}
    negatives = {d.negative() for d in declared if d.negative() is not None}
    if len(positives) > 1 or len(negatives) > 1 or positives & negatives:
        return None
    values = tuple(sorted(positives)) + tuple(sorted(negatives))
    return Dictionary(values, True, next(iter(positives), None))


def append_tables(tables: Sequence[Table], callback: Callable[[float], None] | None = None) -> Table:
    """Rows of all tables, columns matched by label; the first table gives order and metadata.

    The dictionary of a nominal column is rebuilt from occurring values, in order of appearance.
    """
    if not tables:
        raise ValueError("at least one table is needed")
    first = tables[0]
    types = {f.label: f.type_id for f in first.fields}
    for i, t in enumerate(tables[1:], 1):
        if t.width() != first.width():
            raise WidthMismatchError(f"table {i} has {t.width()} columns, not {first.width()}", i)
        for label in types:
            if label not in t:
                raise LabelMismatchError(f"table {i} has no column {label!r}", i, label)
            other = t.field(label).type_id
            both = _common(types[label], other)
            if both is None:
                raise IncompatibleTypesError(label, types[label].value, other.value, i)
            types[label] = both
    df = _stacked(tables, first.labels)
    dictionaries = {f.label: d for f in first.fields if f.type_id is TypeId.NOMINAL and (d := _dictionary(tables, f.label))}
    if callback:
        callback(1.0)
    fields = [Field(x, types[x]) for x in first.labels]
    return Table(df, fields, [Key("__labelframe_table"), Key("__labelframe_in")], first.metadata, dictionaries)


def append_columns(columns: Sequence, total_length: int, callback: Callable[[float], None] | None = None) -> Table:
    """The columns' cells one after another in a column ``value``, cut or padded with missing cells to ``total_length``."""
    if not columns:
        raise ValueError("at least one column is needed")
    if total_length < 0:
        raise ValueError("the length is not negative")
    kind = columns[0].type.id
    for i, c in enumerate(columns[1:], 1):
        both = _common(kind, c.type.id)
        if both is None:
            raise ColumnsNotAppendableError(kind.value, c.type.id.value, i)
        kind = both
    parts = [c.as_table("value") for c in columns]
    spark = parts[0].df.sparkSession
    df = densify(_stacked(parts, ["value"]), [F.col("__labelframe_table").asc(), F.col("__labelframe_in").asc()], ROW).where(F.col(ROW) < total_length)
    held = df.count()
    if held < total_length:
        pad = spark.range(held, total_length).select(F.lit(None).cast(df.schema["value"].dataType).alias("value"), F.col("id").alias(ROW))
        df = df.select("value", ROW).unionByName(pad)
    if callback:
        callback(1.0)
    dictionary = _dictionary(parts, "value") if kind is TypeId.NOMINAL else None
    return Table(df.select("value", ROW), [Field("value", kind)], [Key(ROW)], None, {"value": dictionary} if dictionary else None)
