"""Apply and reduce over one or several columns.

``apply_<view>_to_<type>`` maps cells to a new column; ``reduce_<view>`` folds them.  What a
function does with missing cells is found by asking it (NaN, 0 or None, by view).
"""

from __future__ import annotations

import operator
import pickle
from collections.abc import Callable
from functools import reduce as fold

import pandas as pd

from pyspark.sql import functions as F

from labelframe.dictionary import MAX_CATEGORIES
from labelframe.errors import TooManyCategoriesError
from labelframe.functions.exprs import to_type
from labelframe.operators.views import RowView, cells, lowered, opaque
from labelframe.types import TypeId, for_id

#: Folds that Spark has as aggregates, by the function given.
KNOWN = {operator.add: F.sum, max: F.max, min: F.min, operator.and_: F.bit_and, operator.or_: F.bit_or}


class _Transformer:
    def __init__(self, table, labels: list[str]):
        if not labels:
            raise ValueError("at least one column is needed")
        self.table, self.columns = table, labels
        self._callback: Callable[[float], None] | None = None

    def workload(self, workload) -> _Transformer:
        """A scheduling hint; Spark plans tasks by size, so nothing changes."""
        return self

    def callback(self, callback: Callable[[float], None]) -> _Transformer:
        """Told 1.0 once an action of this transformer has ended."""
        self._callback = callback
        return self

    def _call(self, function: Callable, labels: list[str]) -> Callable:
        raise NotImplementedError

    def apply(self, view: str, out: TypeId, function: Callable, max_values: int | None = None, is_opaque: bool = False):
        """A new column of type ``out``; with ``max_values``, more distinct values raise."""
        from labelframe.table import TableColumn

        df, labels, seen, missing = cells(self.table, self.columns, view)
        call = self._call(function, labels)
        expr = None if is_opaque else lowered(call, seen, missing)
        if expr is None:
            expr = opaque(call, seen, missing, for_id(out).spark)
        expr = to_type(expr, out)
        made = TableColumn(self.table, None, expr, out, df)
        if max_values is not None and max_values < MAX_CATEGORIES:
            found = df.select(expr.alias("v")).where("v is not null").distinct().limit(max_values + 1).count()
            if found > max_values:
                raise TooManyCategoriesError(f"more than {max_values} values")
        self._done()
        return made

    def _done(self) -> None:
        if self._callback:
            self._callback(1.0)

    def _fold(self, view: str, identity, reducer: Callable, combiner: Callable | None, supplier: Callable | None):
        """Each partition folds its rows in order; the driver combines one state a partition, in order."""
        df, labels, seen, missing = cells(self.table, self.columns, view)
        single = len(labels) == 1 and not isinstance(self, RowTransformer)
        if supplier is None and reducer in KNOWN and single and combiner in (None, reducer):
            value = df.agg(KNOWN[reducer](seen[0]).alias("v")).first()["v"]
            incomplete = missing[0] != missing[0] and not df.where(seen[0].isNull()).isEmpty()
            self._done()
            if incomplete and reducer is operator.add:
                return float("nan")
            return identity if value is None else reducer(identity, value)
        df = df.orderBy(*self.table.order_exprs()) if self.table.order else df
        named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(seen)])

        def run(batches):
            state, any_row = (supplier() if supplier else identity), False
            for batch in batches:
                for row in zip(*[batch[c].tolist() for c in batch.columns], strict=True):
                    any_row = True
                    row = [m if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v, m in zip(row, missing, strict=True)]
                    cell = row[0] if single else RowView(row, labels)
                    if supplier:
                        reducer(state, cell)
                    else:
                        state = reducer(state, cell)
            if any_row:
                yield pd.DataFrame({"state": [pickle.dumps(state)]})

        states = [pickle.loads(r["state"]) for r in named.mapInPandas(run, "state binary").collect()]
        self._done()
        if supplier:
            total = supplier()
            for s in states:
                combiner(total, s)
            return total
        return fold(combiner or reducer, states, identity)


class Transformer(_Transformer):
    """Over one column: functions take its cell."""

    def __init__(self, table, label: str):
        super().__init__(table, [label])

    def _call(self, function, labels):
        return lambda a: function(a[0])

    def reduce_numeric(self, identity_or_supplier, reducer, combiner=None):
        return self._reduce("numeric", identity_or_supplier, reducer, combiner)

    def reduce_categorical(self, identity_or_supplier, reducer, combiner=None):
        return self._reduce("categorical", identity_or_supplier, reducer, combiner)

    def reduce_objects(self, supplier, reducer, combiner):
        return self._reduce("objects", supplier, reducer, combiner)

    def _reduce(self, view, first, reducer, combiner):
        """A neutral identity with a function, or a supplier with an accumulator and a combiner of states."""
        if callable(first):
            return self._fold(view, None, reducer, combiner, first)
        return self._fold(view, first, reducer, combiner, None)


class RowTransformer(_Transformer):
    """Over several columns: functions take a row view."""

    def _call(self, function, labels):
        return lambda a: function(RowView(a, labels))

    def apply_numeric_pair_to_real(self, function, is_opaque: bool = False):
        """Two columns by a function of two numbers."""
        if len(self.columns) != 2:
            raise ValueError("exactly two columns are needed")
        one = _Pair(self.table, self.columns)
        return one.apply("numeric", TypeId.REAL, function, None, is_opaque)

    def reduce_numeric(self, supplier, reducer, combiner):
        return self._fold("numeric", None, reducer, combiner, supplier)

    def reduce_categorical(self, supplier, reducer, combiner):
        return self._fold("categorical", None, reducer, combiner, supplier)

    def reduce_objects(self, supplier, reducer, combiner):
        return self._fold("objects", None, reducer, combiner, supplier)

    def reduce_mixed(self, supplier, reducer, combiner):
        return self._fold("mixed", None, reducer, combiner, supplier)


class _Pair(_Transformer):
    def _call(self, function, labels):
        return lambda a: function(*a)


def _applier(view: str, out: TypeId) -> Callable:
    def method(self, function: Callable, max_values: int | None = None, is_opaque: bool = False):
        return self.apply(view, out, function, max_values, is_opaque)

    method.__name__ = f"apply_{view}_to_{out.value.lower()}"
    method.__doc__ = f"Map cells, in the {view} view, to a column of type {out.value}."
    return method


for _view in ("numeric", "categorical", "objects", "mixed"):
    for _out in TypeId:
        _m = _applier(_view, _out)
        setattr(RowTransformer, _m.__name__, _m)
        if _view != "mixed":
            setattr(Transformer, _m.__name__, _m)


class Filterer:
    """Row numbers of the rows that a predicate keeps, as a frame (``row``) in order of rows."""

    def __init__(self, table, *labels: str):
        if not labels:
            raise ValueError("at least one column is needed")
        self.table, self.columns = table, labels[0] if len(labels) == 1 else list(labels)

    def workload(self, workload) -> Filterer:
        return self

    def _rows(self, view: str, predicate: Callable, is_opaque: bool):
        from labelframe.table import ROW

        t = self.table.with_rows()
        kept = getattr(t, f"filter_{view}")(self.columns, predicate, is_opaque)
        return kept.df.select(F.col(ROW).alias("row"))

    def filter_numeric(self, predicate, is_opaque: bool = False):
        return self._rows("numeric", predicate, is_opaque)

    def filter_categorical(self, predicate, is_opaque: bool = False):
        return self._rows("categorical", predicate, is_opaque)

    def filter_objects(self, predicate, is_opaque: bool = False):
        return self._rows("objects", predicate, is_opaque)

    def filter_mixed(self, predicate, is_opaque: bool = False):
        return self._rows("mixed", predicate, is_opaque)


RowFilterer = Filterer


