"""Checks of single values, and Arrow arrays of them."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

import pyarrow as pa

from labelframe.types import MAX_TIME, TypeId

_SATURATED = 2.0**63


def rounded(value: float) -> float:
    """Half up; NaN and infinities stay, huge values saturate at 64 bits."""
    if math.isnan(value) or math.isinf(value):
        return value
    low = math.floor(value)
    return float(min(max(low + (1 if value - low >= 0.5 else 0), -_SATURATED), _SATURATED))


def nano_of_day(value) -> int | None:
    """Nanoseconds of a time or a number, checked for its range."""
    if value is None:
        return None
    if isinstance(value, dt.time):
        value = ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000_000 + value.microsecond * 1000
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError("a time or nanoseconds of a day")
    if not 0 <= value <= MAX_TIME:
        raise ValueError(f"{value} is no nanosecond of a day")
    return value


def checked(value, type_id: TypeId):
    """A value as columns of a type hold it; None and NaN are missing, wrong classes raise."""
    if value is None:
        return None
    match type_id:
        case TypeId.REAL | TypeId.INTEGER:
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise TypeError(f"{value!r} is no number")
            value = float(value)
            return None if math.isnan(value) else rounded(value) if type_id is TypeId.INTEGER else value
        case TypeId.TIME:
            return nano_of_day(value)
        case TypeId.DATE_TIME:
            if not isinstance(value, dt.datetime):
                raise TypeError(f"{value!r} is no date-time")
            return value if value.tzinfo is None else value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        case TypeId.TEXT_SET | TypeId.TEXT_LIST:
            if isinstance(value, str):
                raise TypeError("a collection of strings is needed")
            kept = [x for x in value if x is not None]
            return list(dict.fromkeys(kept)) if type_id is TypeId.TEXT_SET else kept
        case _:
            if not isinstance(value, str):
                raise TypeError(f"{value!r} is no string")
            return value


def to_arrow(values: Sequence, type_id: TypeId) -> pa.Array:
    match type_id:
        case TypeId.REAL | TypeId.INTEGER:
            return pa.array(values, pa.float64())
        case TypeId.TIME:
            return pa.array(values, pa.int64())
        case TypeId.DATE_TIME:
            return pa.array(values, pa.timestamp("us"))
        case TypeId.TEXT_SET | TypeId.TEXT_LIST:
            return pa.array(values, pa.list_(pa.string()))
    return pa.array(values, pa.string())
