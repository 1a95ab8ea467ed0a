"""Errors with the details that callers ask for."""

from __future__ import annotations


class UnknownLabelError(KeyError, ValueError):
    """No column has this label."""


class MetaDataError(RuntimeError):
    """A metadata item breaks its uniqueness rule."""


class TooManyCategoriesError(ValueError):
    """More distinct values than the dictionary may hold."""


class FrozenBufferError(RuntimeError):
    """The buffer was turned into a column and can't change any more."""


class ColumnsNotAppendableError(ValueError):
    """Two columns' types can't be appended; knows the desired and actual type and the column's number."""

    def __init__(self, desired: str, actual: str, index: int):
        super().__init__(f"column {index} is {actual}, not {desired}")
        self.desired_type, self.actual_type, self.index = desired, actual, index


class TableAppendError(ValueError):
    """Base of the reasons why tables can't be appended."""

    def __init__(self, message: str, table_index: int, column_name: str | None = None):
        super().__init__(message)
        self.table_index, self.column_name = table_index, column_name


class IncompatibleTypesError(TableAppendError):
    def __init__(self, column_name: str, desired: str, actual: str, table_index: int):
        super().__init__(f"column {column_name!r} of table {table_index} is {actual}, not {desired}", table_index, column_name)
        self.desired_type, self.actual_type = desired, actual


class WidthMismatchError(TableAppendError):
    pass


class LabelMismatchError(TableAppendError):
    pass
