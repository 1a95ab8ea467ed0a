"""Dictionaries of nominal columns: distinct strings with indices from 1, possible gaps, index 0 for missing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from labelframe.errors import TooManyCategoriesError

#: Indices are 32-bit integers.  A dictionary is state of the driver, so columns of very many values should be text.
MAX_CATEGORIES = (1 << 31) - 1


@dataclass(frozen=True)
class Entry:
    index: int
    value: str


@dataclass(frozen=True)
class Dictionary:
    """``values[i]`` has index i + 1; None is a gap.  ``positive`` is set for boolean ones."""

    values: tuple[str | None, ...] = ()
    boolean: bool = False
    positive: str | None = None

    def __post_init__(self):
        if len(self.values) > MAX_CATEGORIES:
            raise TooManyCategoriesError(f"{len(self.values)} categories; at most {MAX_CATEGORIES}")
        own = [v for v in self.values if v is not None]
        if len(set(own)) != len(own):
            raise ValueError("the values of a dictionary are distinct")
        if self.boolean and (len(own) > 2 or (self.positive is not None and self.positive not in own)):
            raise ValueError("a boolean dictionary has two values at most and its positive one among them")

    @staticmethod
    def of(values: Iterable[str]) -> Dictionary:
        return Dictionary(tuple(values))

    def __iter__(self) -> Iterator[Entry]:
        return (Entry(i, v) for i, v in enumerate(self.values, 1) if v is not None)

    def get(self, index: int) -> str | None:
        return self.values[index - 1] if 1 <= index <= len(self.values) else None

    def inverse(self) -> dict[str, int]:
        return {e.value: e.index for e in self}

    def size(self) -> int:
        return sum(v is not None for v in self.values)

    def maximal_index(self) -> int:
        return max((e.index for e in self), default=0)

    def is_boolean(self) -> bool:
        return self.boolean

    def has_positive(self) -> bool:
        return self.boolean and self.positive is not None

    def has_negative(self) -> bool:
        return self.negative() is not None

    def negative(self) -> str | None:
        return next((e.value for e in self if e.value != self.positive), None) if self.boolean else None

    def positive_index(self) -> int:
        return self.inverse().get(self.positive, -1) if self.boolean else -1

    def negative_index(self) -> int:
        return self.inverse().get(self.negative(), -1) if self.boolean else -1

    def compacted(self) -> Dictionary:
        return Dictionary(tuple(e.value for e in self), self.boolean, self.positive)

    def without(self, unused: set[str], compact: bool) -> Dictionary:
        """Unused values go; a positive value that goes is no longer marked."""
        values = tuple(None if v in unused else v for v in self.values)
        kept = Dictionary(values, self.boolean, None if self.positive in unused else self.positive)
        return kept.compacted() if compact else kept

    def to_boolean(self, positive: str | None) -> Dictionary:
        own = self.compacted()
        if own.size() > 2:
            raise ValueError("more than two values")
        if positive is None or positive in own.values:
            return Dictionary(own.values, True, positive)
        if own.size() == 2:
            raise ValueError(f"{positive!r} is not one of two values")
        return Dictionary((*own.values, positive), True, positive)

    def merged_into(self, target: Dictionary) -> Dictionary:
        """The target's values first, then own others; boolean only where nothing is added."""
        known = set(target.values)
        extra = tuple(e.value for e in self if e.value not in known)
        if not extra:
            return target
        whole = target.compacted().values + extra
        keeps = target.boolean and len(whole) <= 2
        return Dictionary(whole, keeps, target.positive if keeps else None)

    def replaced(self, mapping: dict[str, str]) -> Dictionary:
        """Values renamed at once (swaps are legal); the result must stay distinct."""
        values = tuple(mapping.get(v, v) if v is not None else None for v in self.values)
        return Dictionary(values, self.boolean, mapping.get(self.positive, self.positive))
