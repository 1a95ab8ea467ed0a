"""Adapt a table to a schema, and report what does not fit."""

from __future__ import annotations

from enum import Enum

from labelframe.operators import nominal
from labelframe.table import Table
from labelframe.types import Category, TypeId


class ColumnHandling(Enum):
    UNCHANGED = "UNCHANGED"
    REORDER = "REORDER"
    REORDER_KEEP_ADDITIONAL = "REORDER_KEEP_ADDITIONAL"


class DictionaryHandling(Enum):
    UNCHANGED = "UNCHANGED"
    CHANGE = "CHANGE"
    MERGE = "MERGE"


class ColumnSetRequirement(Enum):
    EQUAL = "EQUAL"
    SUBSET = "SUBSET"
    SUPERSET = "SUPERSET"


class TypeRequirement(Enum):
    REQUIRE_MATCHING_TYPES = "REQUIRE_MATCHING_TYPES"
    ALLOW_INT_FOR_REAL = "ALLOW_INT_FOR_REAL"
    REQUIRE_SUB_DICTIONARIES = "REQUIRE_SUB_DICTIONARIES"


class Incompatibility(Enum):
    TYPE_MISMATCH = "TYPE_MISMATCH"
    NOT_SUB_DICTIONARY = "NOT_SUB_DICTIONARY"
    MISSING_COLUMN = "MISSING_COLUMN"
    WRONG_COLUMN_PRESENT = "WRONG_COLUMN_PRESENT"


def adapt(table: Table, schema: Table, columns: ColumnHandling = ColumnHandling.REORDER, dictionaries: DictionaryHandling = DictionaryHandling.UNCHANGED) -> Table:
    """Columns in the schema's order (others dropped or kept behind), dictionaries aligned."""
    if not table.fields:
        return table
    if columns is not ColumnHandling.UNCHANGED:
        wanted = [x for x in schema.labels if x in table]
        if columns is ColumnHandling.REORDER_KEEP_ADDITIONAL:
            wanted += [x for x in table.labels if x not in wanted]
        table = table.columns(wanted)
    if dictionaries is not DictionaryHandling.UNCHANGED:
        change = nominal.change_dictionary if dictionaries is DictionaryHandling.CHANGE else nominal.merge_dictionary
        for f in table.fields:
            if f.type.category is Category.CATEGORICAL and f.label in schema and schema.type_of(f.label).category is Category.CATEGORICAL:
                table = change(table, f.label, schema.dictionary(f.label))
    return table


def find_incompatible(table: Table, schema: Table, columns: ColumnSetRequirement = ColumnSetRequirement.EQUAL, *types: TypeRequirement) -> dict[str, Incompatibility]:
    """What is wrong with each column; types count only where matching ones are required."""
    out: dict[str, Incompatibility] = {}
    if columns is not ColumnSetRequirement.SUBSET:
        out |= {x: Incompatibility.MISSING_COLUMN for x in schema.labels if x not in table}
    if columns is not ColumnSetRequirement.SUPERSET:
        out |= {x: Incompatibility.WRONG_COLUMN_PRESENT for x in table.labels if x not in schema}
    if TypeRequirement.REQUIRE_MATCHING_TYPES not in types:
        return out
    for f in table.fields:
        if f.label not in schema:
            continue
        own, other = f.type_id, schema.field(f.label).type_id
        lenient = TypeRequirement.ALLOW_INT_FOR_REAL in types and (own, other) == (TypeId.INTEGER, TypeId.REAL)
        if own is not other and not lenient:
            out[f.label] = Incompatibility.TYPE_MISMATCH
        elif own is TypeId.NOMINAL and TypeRequirement.REQUIRE_SUB_DICTIONARIES in types:
            if not {e.value for e in table.dictionary(f.label)} <= {e.value for e in schema.dictionary(f.label)}:
                out[f.label] = Incompatibility.NOT_SUB_DICTIONARY
    return out


def compact_dictionaries(table: Table) -> Table:
    for f in table.fields:
        d = table.dictionaries.get(f.label)
        if d is not None and None in d.values:
            table = nominal.compact(table, f.label)
    return table
