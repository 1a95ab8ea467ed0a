"""Column selection by conditions on the schema, all of which must hold."""

from __future__ import annotations

from collections.abc import Callable

from labelframe.types import Capability, Category, TypeId


class ColumnSelector:
    def __init__(self, table, tests: tuple[Callable, ...] = ()):
        self._table, self._tests = table, tests

    def _and(self, test: Callable) -> ColumnSelector:
        return ColumnSelector(self._table, (*self._tests, test))

    def of_type_id(self, type_id: TypeId) -> ColumnSelector:
        return self._and(lambda f: f.type_id is type_id)

    def not_of_type_id(self, type_id: TypeId) -> ColumnSelector:
        return self._and(lambda f: f.type_id is not type_id)

    def of_category(self, category: Category) -> ColumnSelector:
        return self._and(lambda f: f.type.category is category)

    def not_of_category(self, category: Category) -> ColumnSelector:
        return self._and(lambda f: f.type.category is not category)

    def with_capability(self, capability: Capability) -> ColumnSelector:
        return self._and(lambda f: f.type.has_capability(capability))

    def without_capability(self, capability: Capability) -> ColumnSelector:
        return self._and(lambda f: not f.type.has_capability(capability))

    def _has(self, label: str, item) -> bool:
        own = self._table.metadata.get(label, ())
        return any(isinstance(x, item) for x in own) if isinstance(item, type) else item in own

    def with_meta_data(self, item) -> ColumnSelector:
        """An item, or a class of items."""
        return self._and(lambda f: self._has(f.label, item))

    def without_meta_data(self, item) -> ColumnSelector:
        return self._and(lambda f: not self._has(f.label, item))

    def matches_predicate(self, predicate: Callable) -> ColumnSelector:
        """``predicate(column, label)``"""
        return self._and(lambda f: predicate(self._table.column(f.label), f.label))

    def labels(self) -> list[str]:
        return [f.label for f in self._table.fields if all(t(f) for t in self._tests)]

    def columns(self) -> list:
        return [self._table.column(x) for x in self.labels()]

    def table(self):
        return self._table.columns(self.labels())

    @staticmethod
    def to_column_list(labels: list[str], table) -> list:
        return [table.column(x) for x in labels]
