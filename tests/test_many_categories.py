"""Dictionaries of very many values: no step takes the square of their number, and none is refused that an index can name."""

import pytest
from pyspark.sql import functions as F

from labelframe import table as tables
from labelframe.dictionary import Dictionary
from labelframe.operators import nominal
from labelframe.table import Table
from labelframe.types import TypeId


def _names(spark, n):
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("name"))
    return Table.from_df(df, {"name": TypeId.NOMINAL}, ["id"])


def test_renaming_builds_the_inverse_once(spark, monkeypatch):
    calls, inverse = [], Dictionary.inverse
    monkeypatch.setattr(Dictionary, "inverse", lambda self: calls.append(1) or inverse(self))
    t = _names(spark, 700)
    renamed = nominal.replace_values(t, "name", {f"v{i}": f"w{i}" for i in range(700)})
    assert len(calls) == 1
    assert [r["name"] for r in renamed.to_df(ordered=True).select("name").collect()] == [f"w{i}" if i % 7 else None for i in range(700)]


@pytest.mark.parametrize("bound", [10, 1 << 20])
def test_by_a_shuffle_or_not_the_same(spark, monkeypatch, bound):
    monkeypatch.setattr(tables, "BROADCAST_DICTIONARY", bound)
    t = _names(spark, 700)
    assert t.dictionary("name").values == tuple(f"v{i}" for i in range(700) if i % 7)
    renamed = nominal.replace_values(t, "name", {f"v{i}": f"w{i}" for i in range(690)})
    assert [r["name"] for r in renamed.to_df(ordered=True).collect()] == [None if i % 7 == 0 else f"w{i}" if i < 690 else f"v{i}" for i in range(700)]
    df, index = renamed.with_indices(["name"])
    place = {e.value: e.index for e in renamed.dictionary("name")}
    assert all(r["i"] == place.get(r["name"], 0) for r in df.select("name", index["name"].alias("i")).collect())


def test_more_values_than_before():
    n = (1 << 20) + 1
    many = Dictionary(tuple(map(str, range(n))))
    assert many.maximal_index() == n and many.merged_into(Dictionary(("0", "x"))).size() == n + 1
