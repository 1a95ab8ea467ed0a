"""Statistics, dictionaries, buffers, bytes, readers and client-side helpers."""

import datetime as dt
import math

import pytest

from labelframe.dictionary import Dictionary
from labelframe.errors import FrozenBufferError, TooManyCategoriesError
from labelframe.functions import mapping
from labelframe.functions.collections import StringList, StringSet
from labelframe.functions.predicates import Predicate
from labelframe.operators import adapt, nominal, stats
from labelframe.operators.append import append_columns
from labelframe.operators.stats import Statistic as S
from labelframe.plans.context import Context, parallel, run
from labelframe.sources import buffers, colio, readers
from labelframe.table import Table
from labelframe.types import Order, TypeId

NAN = float("nan")


def real(spark, cells):
    b = buffers.real_buffer(len(cells))
    for i, v in enumerate(cells):
        b.set(i, v)
    return b.to_column(spark)


def cells(column):
    return [r[0] for r in column.as_table("v").to_df(ordered=True).collect()]


def test_numeric_statistics(spark):
    r = stats.compute(real(spark, [float(i + 1) for i in range(100)] + [NAN] * 50), list(stats._NUMERIC))
    assert (r[S.COUNT].numeric, r[S.MIN].numeric, r[S.MAX].numeric, r[S.MEAN].numeric) == (100, 1, 100, 50.5)
    assert r[S.VAR].numeric == pytest.approx(841.666666666666629) and r[S.SD].numeric == pytest.approx(29.011491975882016)
    assert (r[S.P25].numeric, r[S.P50].numeric, r[S.MEDIAN].numeric, r[S.P75].numeric) == (25.25, 50.5, 50.5, 75.75)
    r = stats.compute(real(spark, [float(i + 1) for i in range(403)]), [S.P25, S.P50, S.P75])
    assert [r[s].numeric for s in (S.P25, S.P50, S.P75)] == [101, 202, 303]


def test_percentiles_by_rank(spark, monkeypatch):
    monkeypatch.setattr(stats, "ARRAY_VALUES", 10)
    r = stats.compute(real(spark, [float(i + 1) for i in range(100)]), [S.P25, S.P50, S.P75])
    assert [r[s].numeric for s in (S.P25, S.P50, S.P75)] == [25.25, 50.5, 75.75]


def test_edges_of_statistics(spark):
    r = stats.compute(real(spark, [math.inf, -math.inf, 1.0, NAN]), [S.MIN, S.MAX, S.MEAN, S.VAR, S.SD])
    assert (r[S.MIN].numeric, r[S.MAX].numeric) == (-math.inf, math.inf)
    assert all(math.isnan(r[s].numeric) for s in (S.MEAN, S.VAR, S.SD))
    r = stats.compute(real(spark, [NAN, NAN]), [S.COUNT, S.MIN, S.MEAN, S.P50])
    assert r[S.COUNT].numeric == 0 and all(math.isnan(r[s].numeric) for s in (S.MIN, S.MEAN, S.P50))
    assert math.isnan(stats.compute(real(spark, [42.0]), S.VAR).numeric)
    assert stats.compute(real(spark, [5.0, 10.0]), S.VAR).numeric == 12.5
    big = 1.7976931348623157e308
    mean = stats.compute(real(spark, [big] * 100), S.MEAN).numeric
    assert math.isnan(mean) or mean <= big
    with pytest.raises(NotImplementedError):
        stats.compute(real(spark, [1.0]), S.MODE)
    assert stats.compute(real(spark, [1.0]), []) == {}


def test_nominal_statistics(spark):
    b = buffers.nominal_buffer(80)
    for i in range(70):
        b.set(i, "one" if i < 10 else "two" if i < 30 else "three")
    c = b.to_column(spark)
    r = stats.compute(c, [S.COUNT, S.LEAST, S.MODE, S.INDEX_COUNTS])
    assert r[S.COUNT].numeric == 70
    assert (r[S.LEAST].numeric, r[S.LEAST].categorical, r[S.LEAST].object) == (10, 1, "one")
    assert (r[S.MODE].numeric, r[S.MODE].categorical, r[S.MODE].object) == (40, 3, "three")
    assert r[S.INDEX_COUNTS].counts == (10, 10, 20, 40) and r[S.INDEX_COUNTS].count_for_index(9) == 0
    empty = stats.compute(buffers.nominal_buffer(3).to_column(spark), [S.MODE])[S.MODE]
    assert (empty.numeric, empty.categorical, empty.object) == (0, 0, None)


def test_time_statistics(spark):
    b = buffers.time_buffer(60)
    for i in range(60):
        b.set(i, dt.time(8, i))
    r = stats.compute(b.to_column(spark), [S.P25, S.P50, S.P75, S.MEAN, S.SD])
    second = 1_000_000_000
    assert r[S.P25].object == (8 * 3600 + 14 * 60 + 15) * second
    assert r[S.P75].object == (8 * 3600 + 44 * 60 + 45) * second
    assert r[S.MEAN].object == (8 * 3600 + 29 * 60 + 30) * second
    assert not stats.supported(TypeId.TIME, S.VAR)


def test_dictionaries(spark):
    d = Dictionary.of(["a", "b", "c"])
    assert d.without({"b"}, False).values == ("a", None, "c") and d.without({"b"}, False).size() == 2
    assert d.without({"b"}, True).inverse() == {"a": 1, "c": 2}
    with pytest.raises(ValueError):
        d.to_boolean("a")
    two = Dictionary.of(["y", "n"]).to_boolean("y")
    assert (two.positive_index(), two.negative_index(), two.has_negative()) == (1, 2, True)
    assert not two.without({"y"}, True).has_positive()
    assert Dictionary.of(["n"]).to_boolean("y").values == ("n", "y")
    assert d.replaced({"a": "b", "b": "a"}).values == ("b", "a", "c")
    with pytest.raises(ValueError):
        d.replaced({"a": "c"})
    assert d.merged_into(Dictionary.of(["x", "b"])).values == ("x", "b", "a", "c")
    assert not Dictionary.of(["z"]).merged_into(two).boolean


def test_dictionary_operators(spark):
    b = buffers.nominal_buffer(4)
    for i, v in enumerate(["u", "v", None, "u"]):
        b.set(i, v)
    t = b.to_column(spark).as_table("c")
    assert nominal.is_bicategorical(t, "c")
    changed = nominal.change_dictionary(t, "c", Dictionary.of(["v", "w"]))
    assert [r[0] for r in changed.to_df(ordered=True).collect()] == [None, "v", None, None] and changed.dictionary("c").values == ("v", "w")
    swapped = nominal.replace_values(t, "c", {"u": "v", "v": "u"})
    assert [r[0] for r in swapped.to_df(ordered=True).collect()] == ["v", "u", None, "v"]
    with pytest.raises(ValueError):
        nominal.replace_single(t, "c", "absent", "u")
    assert nominal.replace_single(t, "c", "absent", "new") is t
    few = nominal.remove_unused(t.filter_objects("c", lambda c: c == "v"), "c")
    assert few.dictionary("c").values == (None, "v")
    assert adapt.compact_dictionaries(few).dictionary("c").values == ("v",)


def test_buffers(spark):
    b = buffers.integer_buffer(3)
    b.set(0, 2.5)
    b.set(1, -2.5)
    assert (b.get(0), b.get(1)) == (3, -2) and math.isnan(b.get(2))
    c = b.to_column(spark)
    assert cells(c) == [3, -2, None]
    with pytest.raises(FrozenBufferError):
        b.set(0, 1)
    s = buffers.sparse_real_buffer(7.0, 4)
    s.set_next(1.0)
    s.set_next(2, 5.0)
    with pytest.raises(ValueError):
        s.set_next(1, 0.0)
    assert cells(s.to_column(spark)) == [1, 7, 5, 7]
    n = buffers.nominal_buffer(3, 1)
    n.set(0, "a")
    assert not n.set_save(1, "b") and n.different_values() == 1
    with pytest.raises(TooManyCategoriesError):
        n.set(1, "b")
    with pytest.raises(ValueError):
        buffers.time_buffer(1).set(0, 10**15)
    d = buffers.date_time_buffer(1, sub_second=False)
    d.set(0, 1, 999_999_999)
    assert cells(d.to_column(spark)) == [dt.datetime(1970, 1, 1, 0, 0, 1)]
    again = buffers.real_buffer(real(spark, [1.0, NAN]))
    assert again.get(0) == 1 and math.isnan(again.get(1))


def test_bytes(spark):
    c = real(spark, [1.5, NAN, -3.0])
    data = bytearray(24)
    assert colio.put_numeric_doubles(c, 0, data) == 3
    assert cells(colio.read_real(4).put(data[:8]).put(data[8:]).to_column(spark)) == [1.5, None, -3, None]
    b = buffers.nominal_buffer(3)
    b.set(0, "x")
    b.set(2, "y")
    data = bytearray(6)
    assert colio.put_categorical_shorts(b.to_column(spark), 0, data) == 3
    assert cells(colio.read_nominal([None, "x", "y"], 3).put_shorts(data).to_column(spark)) == ["x", None, "y"]
    with pytest.raises(ValueError):
        colio.read_nominal([None, "x"], 1).put_bytes(b"\x05")
    d = buffers.date_time_buffer(2)
    d.set(0, -5, 250_000_000)
    seconds, nanos = bytearray(16), bytearray(8)
    col = d.to_column(spark)
    colio.put_date_time_longs(col, 0, seconds)
    colio.put_date_time_nano_ints(col, 0, nanos)
    assert cells(colio.read_date_time(2).put_seconds(seconds).put_nanos(nanos).to_column(spark)) == cells(col)


def test_readers(spark):
    r = readers.numeric_reader(real(spark, [1.0, NAN, 3.0]))
    assert r.read() == 1 and math.isnan(r.read()) and r.remaining() == 1
    r.set_position(-1)
    assert r.read() == 1
    t = Table.from_df(spark.createDataFrame([(1, "a"), (2, None)], "n int, s string"), {"s": TypeId.NOMINAL}, ["n"])
    m = readers.mixed_row_reader(t)
    m.move()
    assert (m.get(0), m.get(1)) == (1, "a")
    c = readers.categorical_row_reader(t, ["s"])
    assert [c.read()[0], c.read()[0]] == [1, 0]
    with pytest.raises(IndexError):
        c.move()


def test_append_columns(spark):
    a, b = real(spark, [1.0, 2.0]), real(spark, [3.0])
    assert cells(append_columns([a, b], 2).column("value")) == [1, 2]
    assert cells(append_columns([a, b], 5).column("value")) == [1, 2, 3, None, None]


def test_client_side_helpers(spark):
    assert mapping.apply([1, 2, 3], [2, 9, 0]) == [3, None, 1]
    assert mapping.merge([2, 0], [1, 5]) == [0, -1]
    src = [2.5, -4.0, 9.25, 9.25, 0.5, -7.75, -4.0, 3.125]
    assert mapping.sort(src) == [5, 1, 6, 4, 0, 7, 2, 3]
    assert mapping.sort([0.0, NAN, -0.0]) == [2, 0, 1]
    assert mapping.sort([1, 2, 1], Order.DESCENDING) == [1, 0, 2]
    x = StringList(["a", None, "b", "a"])
    assert (len(x), x.index_of("b"), x.last_index_of("a"), x.index_of("z")) == (3, 1, 2, -1)
    with pytest.raises(TypeError):
        x.add("c")
    assert StringSet(["b", "a", "b"]) == StringSet(["a", "b"]) and StringSet(["z"]) < StringSet(["a", "b"])
    p = Predicate(lambda v: v > 5)
    assert (~p)(NAN) and not p(NAN) and (p | Predicate(lambda v: v < 0))(-1)
    context = Context(spark, 2)
    seen = []
    parallel(0, 3, seen.append, context)
    assert sorted(seen) == [0, 1, 2] and run(lambda: 7, context) == 7
    context.stop()
    with pytest.raises(RuntimeError):
        context.call([lambda: 1])
