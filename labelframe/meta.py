"""Column metadata: a role, an annotation and a reference, each at most once a column."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from labelframe.errors import MetaDataError


class Uniqueness(Enum):
    NONE = "NONE"
    COLUMN = "COLUMN"
    TABLE = "TABLE"


class ColumnRole(Enum):
    ID = "ID"
    LABEL = "LABEL"
    PREDICTION = "PREDICTION"
    CLUSTER = "CLUSTER"
    OUTLIER = "OUTLIER"
    SCORE = "SCORE"
    WEIGHT = "WEIGHT"
    INTERPRETATION = "INTERPRETATION"
    ENCODING = "ENCODING"
    SOURCE = "SOURCE"
    METADATA = "METADATA"
    BATCH = "BATCH"

    @property
    def type(self) -> str:
        return "role"

    @property
    def uniqueness(self) -> Uniqueness:
        return Uniqueness.COLUMN


@dataclass(frozen=True)
class ColumnAnnotation:
    annotation: str
    type = "annotation"
    uniqueness = Uniqueness.COLUMN


@dataclass(frozen=True)
class ColumnReference:
    column: str | None
    value: str | None = None
    type = "reference"
    uniqueness = Uniqueness.COLUMN


def added(present: dict[str, tuple], label: str, items) -> dict[str, tuple]:
    """Metadata by label with ``items`` added to one column; broken uniqueness raises, exact repeats are dropped."""
    own = list(present.get(label, ()))
    for item in items:
        if item.uniqueness is Uniqueness.NONE:
            if item in own:
                continue
        elif any(x.type == item.type for x in own):
            raise MetaDataError(f"column {label!r} already has a {item.type}")
        elif item.uniqueness is Uniqueness.TABLE and any(x.type == item.type for xs in present.values() for x in xs):
            raise MetaDataError(f"another column already has a {item.type}")
        own.append(item)
    return present | {label: tuple(own)}


def renamed(items: tuple, mapping: dict[str, str]) -> tuple:
    """References follow renamed columns."""
    return tuple(ColumnReference(mapping.get(x.column, x.column), x.value) if isinstance(x, ColumnReference) else x for x in items)


def to_json(items: tuple) -> dict:
    """What a Spark field's metadata holds."""
    out: dict = {}
    for x in items:
        if isinstance(x, ColumnRole):
            out["role"] = x.value
        elif isinstance(x, ColumnAnnotation):
            out["annotation"] = x.annotation
        elif isinstance(x, ColumnReference):
            out["reference"] = {"column": x.column, "value": x.value}
    return out


def from_json(held: dict) -> tuple:
    out: list = []
    if "role" in held:
        out.append(ColumnRole(held["role"]))
    if "annotation" in held:
        out.append(ColumnAnnotation(held["annotation"]))
    if "reference" in held:
        out.append(ColumnReference(held["reference"].get("column"), held["reference"].get("value")))
    return tuple(out)
