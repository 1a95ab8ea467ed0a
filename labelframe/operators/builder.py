"""The table builder: add, replace, remove and rename columns, and edit metadata."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from labelframe import meta
from labelframe.dictionary import Dictionary
from labelframe.errors import TooManyCategoriesError, UnknownLabelError
from labelframe.functions.exprs import to_type
from labelframe.table import ROW, Field, Key, Table, TableColumn
from labelframe.types import TypeId, for_id


class TableBuilder:
    """Starts from a number of rows or a table; ``build`` gives one plan of all pending columns.

    Generators are functions of the row's number: given a Column they may return one, which
    Catalyst plans; any other function runs over Arrow batches.
    """

    def __init__(self, table: Table, numbered: bool = False):
        self._table, self._numbered = table, numbered

    def _rows(self) -> Table:
        return self._table.with_rows()

    # ---- generators

    def _generated(self, label: str, type_id: TypeId, generator: Callable, present: bool, max_values: int | None = None, positive=None, boolean: bool = False) -> TableBuilder:
        if (label in self._table) is not present:
            raise (UnknownLabelError(label) if present else ValueError(f"column {label!r} is there already"))
        t = self._rows()
        try:
            made = generator(F.col(ROW))
            if not isinstance(made, Column):
                raise TypeError
        except (TypeError, ValueError, AttributeError):
            kind = for_id(type_id).spark
            numeric = type_id in (TypeId.REAL, TypeId.INTEGER)

            def run(rows: pd.Series) -> pd.Series:
                values = [generator(i) for i in rows.tolist()]
                return pd.Series([None if v is None or v != v else float(v) if numeric else list(v) if isinstance(v, tuple) else v for v in values], dtype="object")

            made = F.pandas_udf(kind)(run)(F.col(ROW))
        made = to_type(made, type_id)
        shown = [made.alias(x) if x == label else t.col(x) for x in t.labels] + ([] if present else [made.alias(label)])
        fields = [Field(label, type_id) if f.label == label else f for f in t.fields] + ([] if present else [Field(label, type_id)])
        dictionaries = {k: v for k, v in t.dictionaries.items() if k != label}
        out = Table(t.df.select(*shown, F.col(ROW)), fields, [Key(ROW)], t.metadata, dictionaries)
        if max_values is not None and out.dictionary(label).size() > max_values:
            raise TooManyCategoriesError(f"{label!r} has more than {max_values} values")
        if boolean:
            out.dictionaries[label] = out.dictionary(label).to_boolean(positive)
        return TableBuilder(out)

    def add_nominal(self, label, generator, max_values: int | None = None):
        return self._generated(label, TypeId.NOMINAL, generator, False, max_values)

    def replace_nominal(self, label, generator, max_values: int | None = None):
        return self._generated(label, TypeId.NOMINAL, generator, True, max_values)

    def add_boolean(self, label, generator, positive):
        return self._generated(label, TypeId.NOMINAL, generator, False, None, positive, True)

    def replace_boolean(self, label, generator, positive):
        return self._generated(label, TypeId.NOMINAL, generator, True, None, positive, True)

    # ---- columns

    def add(self, label: str, column: TableColumn | Column) -> TableBuilder:
        """A column of these rows, or one of another table of the same height, matched by position."""
        if label in self._table:
            raise ValueError(f"column {label!r} is there already")
        return self._placed(label, column, False)

    def replace(self, label: str, column: TableColumn | Column, type_id: TypeId = TypeId.REAL) -> TableBuilder:
        """In place; metadata stays."""
        self._table.index(label)
        return self._placed(label, column, True, type_id)

    def _placed(self, label: str, column, present: bool, type_id: TypeId = TypeId.REAL) -> TableBuilder:
        t = self._table
        if isinstance(column, Column):
            df, expr, kind, dictionary = t.df, to_type(column, type_id), type_id, None
        elif column.table is t and column.expr is None:
            df, expr, kind, dictionary = t.df, t.col(column.label), column.type.id, t.dictionaries.get(column.label)
        elif column.table is t:
            df, expr, kind, dictionary = (t.df if column.frame is None else column.frame), column.expr, column.type.id, column.declared
        else:
            other = column.as_table("value").with_rows()
            mine = t.with_rows()
            if mine.height() != other.height():
                raise ValueError(f"{other.height()} rows, not {mine.height()}")
            side = other.df.select(F.col("value").alias("__labelframe_value"), F.col(ROW).alias("__labelframe_at"))
            df, expr, kind, dictionary = mine.df.join(side, F.col(ROW) == F.col("__labelframe_at")), F.col("__labelframe_value"), column.type.id, other.dictionaries.get("value")
            t = mine
        shown = [expr.alias(x) if x == label else t.col(x) for x in t.labels] + ([] if present else [expr.alias(label)])
        fields = [Field(label, kind) if f.label == label else f for f in t.fields] + ([] if present else [Field(label, kind)])
        dictionaries = {k: v for k, v in t.dictionaries.items() if k != label} | ({label: dictionary} if dictionary else {})
        return TableBuilder(Table(df.select(*shown, *t._hidden()), fields, t.order, t.metadata, dictionaries))

    def remove(self, label: str) -> TableBuilder:
        """The column and its metadata go; references of others to it stay."""
        self._table.index(label)
        return TableBuilder(self._table.columns([x for x in self._table.labels if x != label]))

    def rename(self, label: str, new_label: str) -> TableBuilder:
        self._table.index(label)
        if new_label in self._table and new_label != label:
            raise ValueError(f"column {new_label!r} is there already")
        return TableBuilder(self._table.rename({label: new_label}))

    # ---- metadata

    def _meta(self, metadata: dict) -> TableBuilder:
        return TableBuilder(self._table._with(metadata=metadata))

    def add_meta_data(self, label: str, items) -> TableBuilder:
        self._table.index(label)
        return self._meta(meta.added(self._table.metadata, label, items if isinstance(items, (list, tuple)) else [items]))

    def remove_meta_data(self, label: str, item) -> TableBuilder:
        """By class or by value."""
        kept = tuple(x for x in self._table.get_meta_data(label) if not (isinstance(x, item) if isinstance(item, type) else x == item))
        return self._meta(self._table.metadata | {label: kept})

    def clear_meta_data(self, label: str) -> TableBuilder:
        self._table.index(label)
        return self._meta({k: v for k, v in self._table.metadata.items() if k != label})

    def get_meta_data(self, label: str, kind: type | None = None) -> list:
        return self._table.get_meta_data(label, kind)

    def get_first_meta_data(self, label: str, kind: type):
        return self._table.get_first_meta_data(label, kind)

    # ---- state

    @property
    def labels(self) -> list[str]:
        return self._table.labels

    def contains(self, label: str) -> bool:
        return label in self._table

    def column_type_id(self, label: str) -> TypeId:
        return self._table.field(label).type_id

    def build(self) -> Table:
        return self._table


def _generator(type_id: TypeId, present: bool) -> Callable:
    def method(self, label: str, generator: Callable) -> TableBuilder:
        return self._generated(label, type_id, generator, present)

    method.__name__ = f"{'replace' if present else 'add'}_{type_id.value.lower()}"
    return method


for _t in TypeId:
    if _t is not TypeId.NOMINAL:
        for _p in (False, True):
            _m = _generator(_t, _p)
            setattr(TableBuilder, _m.__name__, _m)


def new_table_builder(start: int | Table, spark: SparkSession | None = None) -> TableBuilder:
    """From a number of rows, or from a table."""
    if isinstance(start, Table):
        return TableBuilder(start)
    if start < 0:
        raise ValueError("the number of rows is not negative")
    spark = spark or SparkSession.getActiveSession()
    return TableBuilder(Table(spark.range(start).select(F.col("id").alias(ROW)), [], [Key(ROW)]))


def declared(table: Table, label: str, dictionary: Dictionary) -> Table:
    """The table with a dictionary given by hand."""
    return table._with(dictionaries=table.dictionaries | {label: dictionary})
