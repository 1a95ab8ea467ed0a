"""Predicates with two values, that combine by and, or and negate.

A predicate wraps a function; the function may take Columns (the default path, which Catalyst
plans) or plain values.  Over Columns, a missing operand counts as false *before* a negation,
as it does for NaN in a plain comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from labelframe.functions.exprs import two_valued


class Predicate:
    def __init__(self, test: Callable):
        self._test = test

    def __call__(self, *args):
        result = self._test(*args)
        return two_valued(result) if isinstance(result, Column) else bool(result)

    test = __call__

    def and_(self, other: Predicate) -> Predicate:
        return Predicate(lambda *a: (self(*a) & other(*a)) if _columns(a) else (self(*a) and other(*a)))

    def or_(self, other: Predicate) -> Predicate:
        return Predicate(lambda *a: (self(*a) | other(*a)) if _columns(a) else (self(*a) or other(*a)))

    def negate(self) -> Predicate:
        return Predicate(lambda *a: ~self(*a) if _columns(a) else not self(*a))

    __and__, __or__ = and_, or_

    def __invert__(self):
        return self.negate()


def _columns(args: tuple) -> bool:
    return any(isinstance(a, Column) for a in args)
