"""Lists and sets of strings: values for the client, and the same operations as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


class StringList(tuple):
    """An immutable list of strings without missing ones; a missing collection is empty.

    Tuples bring size (``len``), membership, iteration, slices (``sub_list``), ``index`` and a
    lexicographic order in which a prefix is smaller, and have no mutators.
    """

    __slots__ = ()

    def __new__(cls, items: Iterable[str | None] | None = (), preprocessor: Callable[[str], str] | None = None):
        found = (x for x in items or () if x is not None)
        if preprocessor:
            found = (y for y in map(preprocessor, found) if y is not None)
        return super().__new__(cls, cls._kept(found))

    @staticmethod
    def _kept(found: Iterable[str]) -> Iterable[str]:
        return found

    @classmethod
    def supplied(cls, supplier: Callable[[int], str | None], limit: int):
        return cls(supplier(i) for i in range(limit))

    def is_empty(self) -> bool:
        return not self

    def contains_all(self, others: Iterable[str]) -> bool:
        return all(x in self for x in others)

    def index_of(self, item: str) -> int:
        return self.index(item) if item in self else -1

    def last_index_of(self, item: str) -> int:
        return len(self) - 1 - self[::-1].index(item) if item in self else -1

    def get(self, index: int) -> str:
        if not 0 <= index < len(self):
            raise IndexError(index)
        return self[index]

    def sub_list(self, start: int, end: int):
        if not 0 <= start <= end <= len(self):
            raise IndexError((start, end))
        return type(self)(self[start:end])

    def to_array(self) -> list[str]:
        return list(self)

    def _immutable(self, *_):
        raise TypeError(f"a {type(self).__name__} can't be changed")

    set = add = remove = add_all = retain_all = remove_all = clear = remove_if = _immutable


class StringSet(StringList):
    """An immutable set of strings in order of insertion; smaller sets sort first, then by sorted content."""

    __slots__ = ()

    @staticmethod
    def _kept(found: Iterable[str]) -> Iterable[str]:
        return dict.fromkeys(found)

    def _key(self):
        return len(self), sorted(self)

    def __lt__(self, other):
        return self._key() < StringSet._key(other)

    def __gt__(self, other):
        return self._key() > StringSet._key(other)

    def __le__(self, other):
        return self._key() <= StringSet._key(other)

    def __ge__(self, other):
        return self._key() >= StringSet._key(other)

    def __eq__(self, other):
        return isinstance(other, (StringSet, set, frozenset)) and set(self) == set(other)

    def __hash__(self):
        return hash(frozenset(self))


def list_of(a: Column, preprocessor: Callable[[Column], Column] | None = None) -> Column:
    """A list without missing elements; a missing array is empty."""
    a = F.coalesce(a, F.array().cast("array<string>"))
    return F.array_compact(F.transform(F.array_compact(a), preprocessor) if preprocessor else a)


def set_of(a: Column, preprocessor: Callable[[Column], Column] | None = None) -> Column:
    return F.array_distinct(list_of(a, preprocessor))


def size(a: Column) -> Column:
    return F.size(a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def contains(a: Column, item: Column | str) -> Column:
    return F.array_contains(a, item)


def contains_all(a: Column, others: Column) -> Column:
    return F.size(F.array_except(others, a)) == 0


def get(a: Column, index: Column | int) -> Column:
    return F.get(a, index)


def index_of(a: Column, item: Column | str) -> Column:
    """-1 if absent."""
    return (F.array_position(a, item) - 1).cast("int")


def last_index_of(a: Column, item: Column | str) -> Column:
    back = F.array_position(F.reverse(a), item)
    return F.when(back == 0, -1).otherwise(F.size(a) - back).cast("int")


def sub_list(a: Column, start: int, end: int) -> Column:
    return F.slice(a, start + 1, end - start)


def set_order(a: Column) -> Column:
    """A key that sorts sets by size, then sorted content."""
    return F.struct(F.size(a).alias("size"), F.array_sort(a).alias("items"))
