"""How predicates and operators see cells, and how they become plans.

Numeric view: doubles, NaN where missing.  Categorical view: indices, 0 where missing.
Object view: values, None where missing.  Rows of mixed cells give a nominal cell in all three.
A function is first tried on Columns; what it returns is planned by Catalyst.  There, a missing cell
compares as NaN and None do: it differs from everything and is neither less nor more.  What else a
function says of missing cells is found by calling it with NaN or None.  A function that can't
take Columns runs over Arrow batches in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.classic.column import Column as ClassicColumn

from labelframe.types import Capability, Category, TypeId

#: Columns up to which functions are called for every combination of missing cells.
MOST_PATTERNS = 4


class Cell(ClassicColumn):
    """A cell of a predicate's plan.  Comparisons are true or false, never null, and can be pushed down to a scan."""

    def __init__(self, c: Column, value: bool):
        super().__init__(c._jc)
        self.value = value  # an object, None where missing; else a number, NaN where missing

    def _present(self, other) -> Column:
        here = self.isNotNull()
        return here & other.isNotNull() if isinstance(other, Column) else here

    def _same(self, other) -> Column:
        if self.value and (other is None or isinstance(other, Cell)):
            return self.eqNullSafe(other)
        return self._present(other) & ClassicColumn.__eq__(self, other)

    def __eq__(self, other):
        return self._same(other)

    def __ne__(self, other):
        if self.value and (other is None or isinstance(other, Cell)):
            return ~self.eqNullSafe(other)
        missing = self.isNull() | other.isNull() if isinstance(other, Column) else self.isNull()
        return missing | ClassicColumn.__ne__(self, other)

    __hash__ = None


def _two_valued(name: str):
    plain = getattr(ClassicColumn, name)
    return lambda self, other: self._present(other) & plain(self, other)


def _numbers(name: str):
    plain = getattr(ClassicColumn, name)
    return lambda self, *other: Cell(plain(self, *other), self.value)


for _name in ("__lt__", "__le__", "__gt__", "__ge__"):
    setattr(Cell, _name, _two_valued(_name))
for _name in ("__add__", "__radd__", "__sub__", "__rsub__", "__mul__", "__rmul__", "__truediv__", "__rtruediv__", "__mod__", "__neg__"):
    setattr(Cell, _name, _numbers(_name))


class Labels(list):
    """Labels of a row's cells; ``indexed``: the places of the nominal ones, whose indices follow after all cells."""

    indexed: tuple[int, ...] = ()


class RowView:
    """A row of cells by position or label."""

    def __init__(self, cells: Sequence, labels: Sequence[str]):
        self._labels = list(labels)
        self._cells = list(cells)[: len(self._labels)]
        self._index = dict(zip(getattr(labels, "indexed", ()), list(cells)[len(self._labels) :], strict=False))

    def _at(self, position: int | str) -> int:
        return self._labels.index(position) if isinstance(position, str) else position

    def get(self, position: int | str):
        return self._cells[self._at(position)]

    __getitem__ = get

    def object(self, position: int | str, kind: type | None = None):
        """The value; with ``kind``, a present one of another class raises."""
        value = self.get(position)
        if kind is not None and value is not None and not isinstance(value, (kind, Column)):
            raise TypeError(f"{value!r} is no {kind.__name__}")
        return value

    def index(self, position: int | str):
        """The category index of a nominal cell, 0 where missing; other cells as they are."""
        return self._index.get(self._at(position), self.get(position))

    def numeric(self, position: int | str):
        """A number; of a nominal cell its category index, NaN where missing."""
        i = self._index.get(self._at(position))
        if i is None:
            return self.get(position)
        return Cell(F.when(i > 0, i.cast("double")), False) if isinstance(i, Column) else float(i) if i else math.nan

    def width(self) -> int:
        return len(self._cells)

    __len__ = width

    def __iter__(self) -> Iterator:
        return iter(self._cells)


def cells(table, columns, view: str) -> tuple[DataFrame, list[str], list[Column], list]:
    """Frame, labels, Columns of the view, and what stands for a missing cell of each."""
    labels = [table.field(c).label for c in ([columns] if isinstance(columns, (str, int)) else columns)]
    if not labels:
        raise ValueError("at least one column is needed")
    kinds = []
    for x in labels:
        t = table.type_of(x)
        if view == "numeric" and not t.has_capability(Capability.NUMERIC_READABLE):
            raise TypeError(f"{x!r} can't be read as numbers")
        if view == "categorical" and t.category is not Category.CATEGORICAL:
            raise TypeError(f"{x!r} is not categorical")
        if view == "objects" and not t.has_capability(Capability.OBJECT_READABLE):
            raise TypeError(f"{x!r} can't be read as objects")
        numeric = t.category is Category.NUMERIC or (view == "numeric" and t.id is TypeId.TIME)
        kinds.append("index" if view in ("numeric", "categorical") and t.category is Category.CATEGORICAL else "double" if numeric else "object")
    df, indices = table.with_indices([x for x, k in zip(labels, kinds, strict=True) if k == "index"])
    seen, missing = [], []
    for x, k in zip(labels, kinds, strict=True):
        c = table.col(x)
        if k == "index":
            c = indices[x].cast("double") if view == "numeric" else indices[x]
            if view == "numeric":
                c = F.when(c > 0, c)
        elif k == "double":
            c = c.cast("double")
        seen.append(c)
        missing.append(0 if k == "index" and view != "numeric" else math.nan if k != "object" else None)
    if view == "mixed":
        labels = Labels(labels)
        labels.indexed = tuple(i for i, x in enumerate(labels) if table.type_of(x).category is Category.CATEGORICAL)
        df, indices = table.with_indices([labels[i] for i in labels.indexed])
        seen += [indices[labels[i]] for i in labels.indexed]
        missing += [0] * len(labels.indexed)
    return df, labels, seen, missing


def lowered(call: Callable, seen: list[Column], missing: list, filters: bool = False) -> Column | None:
    """``call`` as one Column with the right answers for missing cells, or None if it can't take Columns.

    ``filters``: rows without a true answer go, so answers that are false need no case of their own, which scans couldn't use.
    """
    try:
        seen = [c if m == 0 else Cell(c, m is None) for c, m in zip(seen, missing, strict=True)]
        out = call(seen)
        if not isinstance(out, Column):
            out = _lit(out)
        # Category indices are never null.
        holes = [i for i, m in enumerate(missing) if m is None or m != m]
        if len(holes) > MOST_PATTERNS:
            return out
        for n in range(1, len(holes) + 1):
            for some in combinations(holes, n):
                answer = _answer(call, [missing[i] if i in some else c for i, c in enumerate(seen)])
                if answer is not None and not (filters and answer is FALSE):
                    here = reduce(lambda a, b: a & b, [seen[i].isNull() if i in some else seen[i].isNotNull() for i in holes])
                    out = F.when(here, F.lit(False) if answer is FALSE else answer).otherwise(out)
        return out
    except (TypeError, ValueError, AttributeError):
        return None


#: The answer of a function that says no.
FALSE = object()


def _answer(call: Callable, args: list) -> Column | object | None:
    """What the function says about missing cells; None if that is missing, or not a plain value.

    A Column that mixes NaN with present cells is no answer: Spark holds NaN to be the largest
    number, so the plan's own null, which stands for "not true", is the better one.
    """
    try:
        value = call(args)
    except (TypeError, ValueError, AttributeError):
        return None
    if isinstance(value, Column):
        return None
    if value is None or value != value:
        return None
    return FALSE if value is False else _lit(value)


def _lit(value) -> Column:
    if value is None or value != value:
        return F.lit(None)
    return F.lit(list(value)) if isinstance(value, (tuple, list, set)) else F.lit(value)


def opaque(call: Callable, seen: list[Column], missing: list, out: T.DataType) -> Column:
    """``call`` in Python, an Arrow batch at a time."""
    whole = isinstance(out, (T.DoubleType, T.BooleanType, T.LongType))

    def run(*columns: pd.Series) -> pd.Series:
        cells_ = [[m if v is None or v is pd.NaT or v != v else v for v in c.tolist()] if not _arrays(c) else c.tolist() for c, m in zip(columns, missing, strict=True)]
        values = [call(list(row)) for row in zip(*cells_, strict=True)]
        if whole:
            values = [None if v is None or v != v else v for v in values]
        elif isinstance(out, T.ArrayType):
            values = [None if v is None else list(v) for v in values]
        return pd.Series(values, dtype="object")

    return F.pandas_udf(out)(run)(*seen)


def _arrays(c: pd.Series) -> bool:
    return len(c) > 0 and any(hasattr(v, "__len__") and not isinstance(v, str) for v in c.head(3))


def caller(function: Callable, labels: list[str], pair: bool) -> Callable:
    """One column: f(x); two named ones: f(x, y); else f(row)."""
    if len(labels) == 1 and not pair:
        return lambda a: function(a[0])
    if pair:
        return lambda a: function(*a)
    return lambda a: function(RowView(a, labels))


def filter_frame(table, columns, view: str, predicate: Callable, is_opaque: bool) -> DataFrame:
    one = isinstance(columns, (str, int))
    pair = isinstance(columns, tuple) and len(columns) == 2
    df, labels, seen, missing = cells(table, columns, view)
    call = caller(predicate, labels, pair) if one or pair else (lambda a: predicate(RowView(a, labels)))
    condition = None if is_opaque else lowered(call, seen, missing, True)
    if condition is None:
        condition = opaque(lambda a: bool(call(a)), seen, missing, T.BooleanType())
    return df.where(condition)
