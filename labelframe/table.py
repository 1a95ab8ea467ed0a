"""The table: an ordered, labelled, typed view of a DataFrame.

A frame has no order of its own, so a table carries order keys in hidden columns.  Lazy
operators (projection, filters, transformations) leave them alone; only operators that need
a row's number ask for it.  Everything is a plan until a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelframe import meta
from labelframe.dictionary import Dictionary
from labelframe.errors import UnknownLabelError
from labelframe.functions.exprs import densify, sort_keys, to_type
from labelframe.types import Category, Order, TypeId, for_id, infer

#: Columns that carry the order or pass between joins; labels may not begin like them.
HIDDEN = "__labelframe_"
ROW = f"{HIDDEN}row"
#: Up to this many values, an index is found by a search in a literal; beyond, by a join.
LITERAL_DICTIONARY = 256
#: Up to this many, the join sends them to the executors; beyond, it shuffles.
BROADCAST_DICTIONARY = 1 << 20


@dataclass(frozen=True)
class Field:
    label: str
    type_id: TypeId

    @property
    def type(self):
        return for_id(self.type_id)


@dataclass(frozen=True)
class Key:
    """A hidden order column and its direction."""

    column: str
    ascending: bool = True
    nulls_first: bool = True

    def expr(self) -> Column:
        c = F.col(self.column)
        if self.ascending:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


class Table:
    def __init__(self, df: DataFrame, fields: Sequence[Field], order: Sequence[Key] = (), metadata: dict[str, tuple] | None = None, dictionaries: dict[str, Dictionary] | None = None):
        labels = [f.label for f in fields]
        for x in labels:
            if not isinstance(x, str):
                raise TypeError("labels are strings")
            if not x:
                raise ValueError("labels are not empty")
            if x.startswith(HIDDEN):
                raise ValueError(f"labels don't begin with {HIDDEN!r}: {x!r}")
        if len(set(labels)) != len(labels):
            raise ValueError(f"labels are unique: {labels}")
        self.df, self.fields, self.order = df, tuple(fields), tuple(order)
        self.metadata = {k: v for k, v in (metadata or {}).items() if k in labels and v}
        self.dictionaries = {k: v for k, v in (dictionaries or {}).items() if k in labels}

    # ---- sources

    @staticmethod
    def from_df(df: DataFrame, types: dict[str, TypeId] | None = None, order_by: Sequence[str] = ()) -> Table:
        """A table over a frame.  Strings are text unless ``types`` says nominal; NaN becomes missing; other Spark types are left out."""
        types = types or {}
        fields = [Field(f.name, types.get(f.name) or infer(f.dataType)) for f in df.schema.fields if f.name in types or infer(f.dataType)]
        keys = [F.col(f"`{c}`").alias(f"__labelframe_o{i}") for i, c in enumerate(order_by)] or [F.monotonically_increasing_id().alias("__labelframe_o0")]
        metadata = {f.name: meta.from_json(f.metadata) for f in df.schema.fields}
        shown = [to_type(F.col(f"`{f.label}`"), f.type_id).alias(f.label) for f in fields]
        return Table(df.select(*shown, *keys), fields, [Key(f"__labelframe_o{i}") for i in range(len(keys))], metadata)

    @staticmethod
    def empty(spark: SparkSession, height: int) -> Table:
        """A table without columns; it has a height all the same."""
        return Table(spark.range(height).select(F.col("id").alias("__labelframe_o0")), [], [Key("__labelframe_o0")])

    # ---- introspection

    @property
    def labels(self) -> list[str]:
        return [f.label for f in self.fields]

    def width(self) -> int:
        return len(self.fields)

    def height(self) -> int:
        return self.df.count()

    def label(self, index: int) -> str:
        if not 0 <= index < len(self.fields):
            raise IndexError(index)
        return self.fields[index].label

    def contains(self, label: str) -> bool:
        return label in self.labels

    def __contains__(self, label: str) -> bool:
        return self.contains(label)

    def index(self, label: str) -> int:
        if label is None:
            raise TypeError("a label is needed")
        for i, f in enumerate(self.fields):
            if f.label == label:
                return i
        raise UnknownLabelError(label)

    def field(self, column: str | int) -> Field:
        return self.fields[self.index(self.label(column) if isinstance(column, int) else column)]

    def type_of(self, column: str | int):
        return self.field(column).type

    def column(self, column: str | int) -> TableColumn:
        return TableColumn(self, self.field(column).label)

    def column_list(self) -> list[TableColumn]:
        return [TableColumn(self, x) for x in self.labels]

    def col(self, column: str | int) -> Column:
        return F.col(f"`{self.field(column).label}`")

    def get_meta_data(self, label: str, kind: type | None = None) -> list:
        self.index(label)
        return [x for x in self.metadata.get(label, ()) if kind is None or isinstance(x, kind)]

    def get_first_meta_data(self, label: str, kind: type):
        return next(iter(self.get_meta_data(label, kind)), None)

    # ---- plans

    def _with(self, df: DataFrame | None = None, fields=None, order=None, metadata=None, dictionaries=None) -> Table:
        return Table(
            self.df if df is None else df, self.fields if fields is None else fields, self.order if order is None else order,
            self.metadata if metadata is None else metadata, self.dictionaries if dictionaries is None else dictionaries,
        )

    def _hidden(self) -> list[Column]:
        return [F.col(k.column) for k in self.order]

    def order_exprs(self) -> list[Column]:
        return [k.expr() for k in self.order]

    def numbered(self) -> DataFrame:
        """The frame with ``_row``, each row's number from 0."""
        if len(self.order) == 1 and self.order[0].column == ROW:
            return self.df
        return densify(self.df, self.order_exprs(), ROW)

    def with_rows(self) -> Table:
        if len(self.order) == 1 and self.order[0].column == ROW:
            return self
        shown = [self.col(x) for x in self.labels]
        return self._with(self.numbered().select(*shown, F.col(ROW)), order=[Key(ROW)])

    def to_df(self, ordered: bool = False) -> DataFrame:
        """The frame without hidden columns, with each column's metadata; sorted only if asked for."""
        df = self.df.orderBy(*self.order_exprs()) if ordered else self.df
        shown = []
        for f in self.fields:
            held = meta.to_json(self.metadata.get(f.label, ())) | {"type": f.type_id.value}
            if (d := self.dictionaries.get(f.label)) and d.positive is not None:
                held["positive"] = d.positive
            shown.append(self.col(f.label).alias(f.label, metadata=held))
        return df.select(*shown)

    def columns(self, columns: Sequence[str | int]) -> Table:
        """Projection and reordering; repeated labels are refused, and none keeps the height."""
        fields = [self.field(c) for c in columns]
        return self._with(self.df.select(*[self.col(f.label) for f in fields], *self._hidden()), fields)

    def rename(self, mapping: dict[str, str]) -> Table:
        """All at once, so swaps are legal; unknown old labels are ignored; references follow."""
        if None in mapping or None in mapping.values():
            raise TypeError("labels are strings")
        own = {k: v for k, v in mapping.items() if k in self.labels}
        fields = [replace(f, label=own.get(f.label, f.label)) for f in self.fields]
        shown = [self.col(f.label).alias(g.label) for f, g in zip(self.fields, fields, strict=True)]
        metadata = {own.get(k, k): meta.renamed(v, own) for k, v in self.metadata.items()}
        return Table(self.df.select(*shown, *self._hidden()), fields, self.order, metadata, {own.get(k, k): v for k, v in self.dictionaries.items()})

    def strip_data(self) -> Table:
        """No rows; schema, metadata and dictionaries stay."""
        kept = {f.label: self.dictionary(f.label) for f in self.fields if f.type.category is Category.CATEGORICAL}
        return self._with(self.df.where(F.lit(False)), dictionaries=kept)

    # ---- rows

    def slice(self, start: int, end: int) -> Table:
        """Rows from ``start`` up to ``end``.  After a sort this is a top-k, which needs no full sort."""
        if start < 0 or end < start:
            raise IndexError((start, end))
        df = self.df.orderBy(*self.order_exprs())
        df = df.limit(end - start) if start == 0 else df.offset(start).limit(end - start)
        return self._with(df)

    def rows(self, positions: Sequence[int] | int, end: int | None = None) -> Table:
        """Rows by position, repeats allowed, positions outside giving missing rows; or ``rows(from, to)``."""
        if isinstance(positions, int):
            return self.slice(positions, end)
        spark = self.df.sparkSession
        wanted = spark.createDataFrame(list(enumerate(map(int, positions))), "__labelframe_pos long, __labelframe_at long")
        # A list of up to 16 MB is sent to the executors; a longer one is joined by a shuffle.
        df = self._picked(wanted) if len(positions) <= 1 << 20 else wanted.join(self.numbered(), F.col("__labelframe_at") == F.col(ROW), "left")
        return self._with(df.select(*[self.col(x) for x in self.labels], F.col("__labelframe_pos").alias(ROW)), order=[Key(ROW)])

    def _picked(self, wanted: DataFrame) -> DataFrame:
        """Only wanted rows leave the large side; then missing positions are filled in."""
        own = self.numbered()
        few = own.join(F.broadcast(wanted.select("__labelframe_at").distinct()), F.col(ROW) == F.col("__labelframe_at"), "left_semi")
        return wanted.join(few, F.col("__labelframe_at") == F.col(ROW), "left")

    def sort(self, columns: str | int | Sequence[str | int], orders: Order | Sequence[Order] = Order.ASCENDING) -> Table:
        """Stable sort; missing last ascending, first descending."""
        columns = [columns] if isinstance(columns, (str, int)) else list(columns)
        orders = [orders] * len(columns) if isinstance(orders, Order) else list(orders)
        if len(orders) != len(columns):
            raise ValueError("one order for each column")
        if not columns:
            return self
        df, keys, seen = self.df, [], set()
        used = {k.column for k in self.order}
        n = 0
        for c, o in zip(columns, orders, strict=True):
            f = self.field(c)
            if f.label in seen:  # a repeated key decides nothing
                continue
            seen.add(f.label)
            for e in _key_values(self.col(f.label), f.type_id):
                while (name := f"__labelframe_s{n}") in used:
                    n += 1
                used.add(name)
                df = df.withColumn(name, e)
                keys.append(Key(name, o is Order.ASCENDING, o is Order.DESCENDING))
        return self._with(df, order=[*keys, *self.order])

    # ---- filters

    def filter(self, condition: Column) -> Table:
        return self._with(self.df.where(F.coalesce(condition, F.lit(False))))

    def filter_numeric(self, columns, predicate: Callable, opaque: bool = False) -> Table:
        return self._filtered(columns, "numeric", predicate, opaque)

    def filter_categorical(self, columns, predicate: Callable, opaque: bool = False) -> Table:
        return self._filtered(columns, "categorical", predicate, opaque)

    def filter_objects(self, columns, predicate: Callable, opaque: bool = False) -> Table:
        return self._filtered(columns, "objects", predicate, opaque)

    def filter_mixed(self, columns, predicate: Callable, opaque: bool = False) -> Table:
        return self._filtered(columns, "mixed", predicate, opaque)

    def _filtered(self, columns, view: str, predicate: Callable, opaque: bool) -> Table:
        from labelframe.operators.views import filter_frame

        return self._with(filter_frame(self, columns, view, predicate, opaque).select(*[self.col(x) for x in self.labels], *self._hidden()))

    # ---- the rest of the surface

    def select(self):
        from labelframe.operators.selector import ColumnSelector

        return ColumnSelector(self)

    def transform(self, *columns):
        from labelframe.operators.transform import RowTransformer, Transformer

        if len(columns) == 1 and isinstance(columns[0], (str, int)):
            return Transformer(self, self.field(columns[0]).label)
        if len(columns) == 1:
            columns = tuple(columns[0])
        return RowTransformer(self, [self.field(c).label for c in columns] or self.labels)

    # ---- dictionaries

    def dictionary(self, label: str) -> Dictionary:
        """Declared, or else the column's values in order of first appearance."""
        f = self.field(label)
        if f.type.category is not Category.CATEGORICAL:
            raise TypeError(f"{label!r} is not categorical")
        if label not in self.dictionaries:
            c = self.col(label)
            if all(k.ascending or isinstance(self.df.schema[k.column].dataType, (T.NumericType, T.DateType, T.TimestampType, T.BooleanType)) for k in self.order):
                df, first = self.df, F.min(F.struct(*[_ascending(k) for k in self.order]))
            else:  # what can't be negated is numbered
                df, first = self.numbered(), F.min(F.struct(F.struct(F.col(ROW).alias("at"))))
            values = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(first.alias("at"))
            self.dictionaries[label] = Dictionary.of(values.orderBy("at").select("v").toArrow()["v"].to_pylist())  # missing keys first
        return self.dictionaries[label]

    def with_indices(self, labels: Iterable[str]) -> tuple[DataFrame, dict[str, Column]]:
        """A frame and the category index (0 for missing) of each nominal column."""
        df, out = self.df, {}
        for n, label in enumerate(labels):
            d = self.dictionary(label)
            if len(d.values) <= LITERAL_DICTIONARY:
                out[label] = F.coalesce(F.array_position(F.lit(list(d.values)), self.col(label)), F.lit(0)).cast("int") if any(v is not None for v in d.values) else F.lit(0)
            else:
                known = d.inverse()
                df = met(df, self.col(label), self._hidden(), f"__labelframe_v{n}", list(known), f"__labelframe_i{n}", pa.array(known.values(), pa.int32()))
                out[label] = F.coalesce(F.col(f"__labelframe_i{n}"), F.lit(0))
        return df, out


def _key_values(c: Column, type_id: TypeId) -> list[Column]:
    """The expressions whose plain order is the type's order."""
    if type_id in (TypeId.REAL, TypeId.INTEGER):
        return [c, F.when(c.isNull(), None).when(c.cast("string") == "-0.0", 0).otherwise(1)]
    if type_id is TypeId.TEXT_SET:
        return [F.when(c.isNotNull(), F.size(c)), F.array_sort(c)]
    return [c]


def _ascending(k: Key) -> Column:
    """A value whose ascending order is the key's, for keys that can be negated; others must ascend."""
    c = F.col(k.column)
    missing = F.when(c.isNull(), 0 if k.nulls_first else 1).otherwise(1 if k.nulls_first else 0).alias(f"{k.column}_m")
    if k.ascending:
        return F.struct(missing, c.alias(k.column))
    return F.struct(missing, (-c.cast("double")).alias(k.column))


def met(df: DataFrame, cell: Column, order: Sequence[Column], key: str, values: Sequence[str], name: str, given: pa.Array) -> DataFrame:
    """``df`` with what is ``given`` for each cell's value as column ``name``, null for other cells; ``key`` names a column for the values."""
    sides = {key: pa.array(values, pa.string()), name: given}
    if len(values) <= BROADCAST_DICTIONARY:
        return df.join(F.broadcast(df.sparkSession.createDataFrame(pa.table(sides))), cell == F.col(key), "left")
    # Missing cells meet nothing, so their rows are dealt out by their order keys and none is hot.
    side = df.sparkSession.createDataFrame(pa.table(sides | {f"{key}_0": pa.array([0] * len(values), pa.int64())}))
    return df.join(side, (cell == F.col(key)) & (F.when(cell.isNull(), F.xxhash64(*order)).otherwise(F.lit(0)) == F.col(f"{key}_0")), "left")


@dataclass(frozen=True)
class TableColumn:
    """One column of a table, or (with ``expr``) one derived from its rows."""

    table: Table
    label: str | None
    expr: Column | None = None
    type_id: TypeId | None = None
    frame: DataFrame | None = None
    positive: str | None = None
    boolean: bool = False
    declared: Dictionary | None = None

    @property
    def type(self):
        return for_id(self.type_id) if self.type_id else self.table.type_of(self.label)

    def as_table(self, label: str | None = None) -> Table:
        """A one-column table of it."""
        name = label or self.label or "value"
        if self.expr is None:
            t = self.table.columns([self.label])
            return t.rename({self.label: name}) if name != self.label else t
        df = (self.table.df if self.frame is None else self.frame).select(self.expr.alias(name), *self.table._hidden())
        return Table(df, [Field(name, self.type.id)], self.table.order, None, {name: self.declared} if self.declared else None)

    def size(self) -> int:
        return self.table.height()

    def get_dictionary(self) -> Dictionary:
        return self.declared or self.as_table("value").dictionary("value")

    def rows(self, positions: Sequence[int]) -> Table:
        return self.as_table().rows(positions)

    def strip_data(self) -> Table:
        return self.as_table().strip_data()

    def sort(self, order: Order = Order.ASCENDING) -> DataFrame:
        """The row numbers that sort the column, in that order (``row``), with their place (``place``)."""
        t = self.as_table("value").with_rows()
        keys = [*sort_keys(F.col("value"), self.type.id, order), F.col(ROW).asc()]
        return densify(t.df.select(F.col(ROW).alias("row"), "value", F.col(ROW)), keys, "place").select("row", "place")

    def fill(self, start: int, count: int, view: str = "objects") -> list:
        """``count`` values from row ``start``, for the client: doubles (NaN), indices (0) or objects (None)."""
        t = self.as_table("value")
        part = t.slice(start, start + count)
        if view == "categorical":
            index = t.dictionary("value").inverse()
            return [index.get(r[0], 0) for r in part.to_df(ordered=True).collect()]
        values = [r[0] for r in part.to_df(ordered=True).collect()]
        return [float("nan") if v is None else float(v) for v in values] if view == "numeric" else values
