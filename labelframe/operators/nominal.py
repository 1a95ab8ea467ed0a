"""Dictionary operators of nominal columns; each returns a table.

Only ``change_dictionary`` and ``replace`` touch data; all others edit the dictionary alone.
"""

from __future__ import annotations

from enum import Enum

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from labelframe.dictionary import Dictionary
from labelframe.table import LITERAL_DICTIONARY, Table, met


class CleanupOption(Enum):
    REMOVE = "REMOVE"
    COMPACT = "COMPACT"


def is_bicategorical(table: Table, label: str) -> bool:
    return table.dictionary(label).size() == 2


def is_at_most_bicategorical(table: Table, label: str) -> bool:
    return table.dictionary(label).size() <= 2


def is_bicategorical_and_boolean(table: Table, label: str) -> bool:
    d = table.dictionary(label)
    return d.boolean and d.size() == 2 and d.has_positive()


def _declared(table: Table, label: str, dictionary: Dictionary) -> Table:
    return table._with(dictionaries=table.dictionaries | {label: dictionary})


def to_boolean(table: Table, label: str, positive: str | None) -> Table:
    return _declared(table, label, table.dictionary(label).to_boolean(positive))


def change_dictionary(table: Table, label: str, target: Dictionary) -> Table:
    """Adopt ``target``; values outside it become missing."""
    values = [e.value for e in target]
    changed = _replace(table, label, _kept(table, label, values))
    return _declared(changed, label, target)


def _kept(table: Table, label: str, values: list[str]) -> Column:
    c = table.col(label)
    return F.when(c.isin(values), c) if values else F.lit(None).cast("string")


def _replace(table: Table, label: str, expr: Column) -> Table:
    shown = [expr.alias(x) if x == label else table.col(x) for x in table.labels]
    return table._with(table.df.select(*shown, *table._hidden()))


def merge_dictionary(table: Table, label: str, target: Dictionary) -> Table:
    """``target``'s values first, then own ones that it lacks."""
    return _declared(table, label, table.dictionary(label).merged_into(target))


def remove_unused(table: Table, label: str, option: CleanupOption = CleanupOption.REMOVE) -> Table:
    """Drop values that do not occur: REMOVE leaves gaps, COMPACT renumbers."""
    d = table.dictionary(label)
    used = {r[0] for r in table.df.select(table.col(label)).distinct().collect()}  # at most the dictionary's size
    return _declared(table, label, d.without({e.value for e in d} - used, option is CleanupOption.COMPACT))


def compact(table: Table, label: str) -> Table:
    return _declared(table, label, table.dictionary(label).compacted())


def replace_single(table: Table, label: str, old: str, new: str) -> Table:
    """Rename one category.  An existing ``new`` raises even where ``old`` is absent."""
    d = table.dictionary(label)
    if new in d.inverse():
        raise ValueError(f"{new!r} is a category already")
    return replace_values(table, label, {old: new}) if old in d.inverse() else table


def replace_values(table: Table, label: str, mapping: dict[str, str]) -> Table:
    """Rename categories at once; absent old values are ignored; two that meet raise."""
    d = table.dictionary(label)
    known = d.inverse()
    own = {k: v for k, v in mapping.items() if k in known}
    after = d.replaced(own)
    c = table.col(label)
    if not own:
        return table
    if len(own) <= LITERAL_DICTIONARY:
        changed = F.coalesce(F.get(F.lit(list(own.values())), (F.array_position(F.lit(list(own)), c) - 1).cast("int")), c)
        return _declared(_replace(table, label, changed), label, after)
    df = met(table.df, c, table._hidden(), "__labelframe_old", list(own), "__labelframe_new", pa.array(own.values(), pa.string()))
    shown = [F.coalesce("__labelframe_new", c).alias(x) if x == label else table.col(x) for x in table.labels]
    return _declared(table._with(df.select(*shown, *table._hidden())), label, after)
