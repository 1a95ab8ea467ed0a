"""Gathers and stable index sorts of client-side arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cmp_to_key

import numpy as np

from labelframe.types import Order


def apply(data: Sequence, mapping: Sequence[int], missing=None) -> list:
    """Elements by position; positions outside give ``missing``."""
    return [data[i] if 0 <= i < len(data) else missing for i in mapping]


def merge(f: Sequence[int], g: Sequence[int]) -> list[int]:
    """The gather that does ``f`` and then ``g``; outside positions stay outside."""
    return apply(f, g, -1)


def sort(source: Sequence | int, order: Order = Order.ASCENDING, comparator: Callable[[int, int], int] | None = None) -> list[int]:
    """The stable permutation that sorts numbers (-0.0 before 0.0, NaN last), or indices by a comparator."""
    down = order is Order.DESCENDING
    if comparator is not None:
        n = source if isinstance(source, int) else len(source)
        return sorted(range(n), key=cmp_to_key(comparator), reverse=False) if not down else sorted(range(n), key=cmp_to_key(lambda a, b: comparator(b, a)))
    a = np.asarray(source)
    keys = [a] if a.dtype.kind != "f" else [~np.signbit(a), np.nan_to_num(a, nan=0.0, posinf=np.inf, neginf=-np.inf), np.isnan(a)]
    if down:
        keys = [-k.astype(np.float64) if k.dtype.kind != "i" else -k for k in keys]
    return np.lexsort(keys).tolist()
