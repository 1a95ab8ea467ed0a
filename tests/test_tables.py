import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from labelframe.errors import LabelMismatchError, MetaDataError, TooManyCategoriesError, UnknownLabelError, WidthMismatchError
from labelframe.functions.exprs import round53
from labelframe.meta import ColumnAnnotation, ColumnReference, ColumnRole
from labelframe.operators.append import append_tables
from labelframe.operators.builder import new_table_builder
from labelframe.operators.transform import Filterer
from labelframe.sources.writers import mixed_row_writer, real_row_writer
from labelframe.table import Table
from labelframe.types import Capability, Category, Order, TypeId

ASC, DESC = Order.ASCENDING, Order.DESCENDING
NAN = float("nan")


def made(spark, **columns):
    w = real_row_writer(list(columns))
    for row in zip(*columns.values(), strict=True):
        w.move()
        for i, v in enumerate(row):
            w.set(i, v)
    return w.create(spark)


def values(table, label):
    return [r[label] for r in table.to_df(ordered=True).collect()]


def test_stable_sorts(spark):
    """Rows that tie keep their order, in either direction."""
    rng = random.Random(8)
    n = 40
    one, two = [rng.randrange(4) for _ in range(n)], [rng.randrange(6) / 4 - 0.5 for _ in range(n)]
    t = made(spark, at=range(n), one=one, two=two)
    assert values(t.sort(["one", "two"], [ASC, DESC]), "at") == sorted(range(n), key=lambda i: (one[i], -two[i]))
    assert values(t.sort(["two", "one"], DESC), "at") == sorted(range(n), key=lambda i: (-two[i], -one[i]))
    assert values(t.sort("one", DESC), "at") == sorted(range(n), key=lambda i: -one[i])
    assert values(t.sort(["one", "one"], DESC), "at") == sorted(range(n), key=lambda i: -one[i])
    assert values(t.sort([]), "at") == list(range(n))


def test_missing_and_negative_zero_in_sorts(spark):
    t = made(spark, a=[0.0, NAN, -0.0, math.inf, -math.inf, 1.0])
    assert [str(v) for v in values(t.sort("a"), "a")] == ["-inf", "-0.0", "0.0", "1.0", "inf", "None"]
    assert [str(v) for v in values(t.sort("a", DESC), "a")] == ["None", "inf", "1.0", "0.0", "-0.0", "-inf"]


def test_mixed_type_sort(spark):
    w = mixed_row_writer(["a", "b", "c"], [TypeId.REAL, TypeId.NOMINAL, TypeId.DATE_TIME])
    seconds, names = [9, 5, 9, 5, 7, 9, 7], ["pear", "fig", "fig", "fig", "pear", "pear", "apple"]
    for i, (second, name) in enumerate(zip(seconds, names, strict=True)):
        w.move()
        w.set(0, i)
        w.set(1, name)
        w.set(2, dt.datetime(1970, 1, 1, 0, 0, second))
    assert values(w.create(spark).sort(["c", "b"], [DESC, ASC]), "a") == sorted(range(7), key=lambda i: (-seconds[i], names[i]))


def test_gather_then_sort(spark):
    one, two = [50, 21, 34, 13, 8, 55], [9, 3, 1, 3, 1, 2]
    t = made(spark, one=one, two=two).rows([4, 1, 3, 2, 5])
    assert values(t.sort("two"), "one") == [8, 34, 55, 21, 13]
    t = made(spark, a=[10, 11, 12])
    assert values(t.rows([2, 2, 7, -1, 0]), "a") == [12, 12, None, None, 10]
    assert values(t.rows(1, 3), "a") == [11, 12]
    with pytest.raises(IndexError):
        t.rows(2, 1)


def test_projection_rename_and_errors(spark):
    t = made(spark, a=[1, 2], b=[3, 4], c=[5, 6])
    assert t.columns(["c", "a"]).labels == ["c", "a"]
    assert t.columns([]).height() == 2
    with pytest.raises(ValueError):
        t.columns(["a", "a"])
    with pytest.raises(UnknownLabelError):
        t.column("x")
    with pytest.raises(IndexError):
        t.label(3)
    r = t.rename({"a": "b", "b": "a", "gone": "x"})
    assert r.labels == ["b", "a", "c"] and values(r, "b") == [1, 2]
    with pytest.raises(ValueError):
        t.rename({"a": "b"})
    assert t.strip_data().height() == 0
    assert Table.empty(spark, 5).height() == 5


def test_metadata(spark):
    b = new_table_builder(made(spark, a=[1], b=[2])).add_meta_data("a", [ColumnRole.ID, ColumnReference("b", "v")]).add_meta_data("b", ColumnAnnotation("note"))
    with pytest.raises(MetaDataError):
        b.add_meta_data("a", ColumnRole.LABEL)
    t = b.build()
    assert t.select().with_meta_data(ColumnRole.ID).labels() == ["a"]
    assert t.select().without_meta_data(ColumnRole).labels() == ["b"]
    r = t.rename({"b": "z"}).sort("a").filter_numeric("a", lambda x: x > 0)
    assert r.get_first_meta_data("a", ColumnReference) == ColumnReference("z", "v")
    assert Table.from_df(t.to_df()).get_meta_data("a") == t.get_meta_data("a")
    assert new_table_builder(t).remove_meta_data("a", ColumnRole).build().get_meta_data("a") == [ColumnReference("b", "v")]
    assert new_table_builder(t).clear_meta_data("a").build().get_meta_data("a") == []
    assert new_table_builder(t).replace_real("a", lambda i: i).build().get_meta_data("a") == t.get_meta_data("a")


def test_selector(spark):
    w = mixed_row_writer(["r", "n", "t", "time"], [TypeId.REAL, TypeId.NOMINAL, TypeId.TEXT, TypeId.TIME])
    w.move()
    t = w.create(spark)
    assert t.select().of_category(Category.OBJECT).labels() == ["t", "time"]
    assert t.select().with_capability(Capability.NUMERIC_READABLE).labels() == ["r", "n", "time"]
    assert t.select().not_of_type_id(TypeId.TEXT).without_capability(Capability.OBJECT_READABLE).labels() == ["r"]


@pytest.mark.parametrize(("value", "expected"), [(2.5, 3.0), (-2.5, -2.0), (-0.4, 0.0), (0.49999999999999994, 0.0), (math.inf, math.inf), (1e300, 9223372036854775807.0), (None, None)])
def test_round53(spark, value, expected):
    assert spark.createDataFrame([(value,)], "x double").select(round53(F.col("x"))).first()[0] == expected


def test_missing_in_predicates(spark):
    t = made(spark, a=[1, 7, NAN])
    assert t.filter_numeric("a", lambda x: x > 5).height() == 1
    assert t.filter_numeric("a", lambda x: x != 7).height() == 2
    assert t.filter_numeric("a", lambda x: not x > 5, opaque=True).height() == 2
    assert [r["row"] for r in Filterer(t, "a").filter_numeric(lambda x: x > 0).collect()] == [0, 1]


def test_apply_and_reduce(spark):
    t = made(spark, a=[1, 2, NAN, 4], b=[4, 3, 2, 1])
    half = new_table_builder(t).add("h", t.transform("a").apply_numeric_to_integer(lambda x: x / 2)).build()
    assert values(half, "h") == [1, 1, None, 2]
    named = t.transform("a").apply_numeric_to_nominal(lambda x: "none" if x != x else "many" if x > 1 else "one", is_opaque=True)
    assert values(new_table_builder(t).add("n", named).build(), "n") == ["one", "many", "none", "many"]
    with pytest.raises(TooManyCategoriesError):
        t.transform("b").apply_numeric_to_nominal(lambda x: x.cast("string"), max_values=2)
    assert t.transform("b").reduce_numeric(0.0, lambda x, y: x + y) == 10
    seen = t.transform("a", "b").reduce_mixed(list, lambda s, r: s.append(r[1]), list.extend)
    assert seen == [4, 3, 2, 1]
    assert math.isnan(t.transform("a").reduce_numeric(0.0, lambda x, y: x + y))


def test_append(spark):
    a, b = made(spark, x=[1], y=[2]), made(spark, y=[4], x=[3])
    both = append_tables([a, b])
    assert values(both, "x") == [1, 3] and values(both, "y") == [2, 4]
    with pytest.raises(WidthMismatchError):
        append_tables([a, made(spark, x=[1])])
    with pytest.raises(LabelMismatchError) as e:
        append_tables([a, made(spark, x=[1], z=[1])])
    assert e.value.table_index == 1 and e.value.column_name == "y"


def test_generators(spark):
    t = new_table_builder(3, spark).add_text_set("s", lambda i: ["a", "a", None, "b"] if int(i) >= 0 else None).add_nominal("n", lambda i: None if int(i) == 1 else f"v{int(i)}").build()
    assert values(t, "s") == [["a", "b"]] * 3
    assert values(t, "n") == ["v0", None, "v2"]
    with pytest.raises(TooManyCategoriesError):
        new_table_builder(3, spark).add_nominal("n", lambda i: f"v{int(i)}", 2)
    with pytest.raises(ValueError):
        new_table_builder(t).add_real("n", lambda i: i)


def test_missing_cells_compare_alike_for_any_number_of_columns(spark):
    """A missing cell differs from everything and is neither less nor more, in plans and in Python, with two columns and with five."""
    rows = [(1.0, 5.0, 1.0, 1.0, 1.0), (None, 5.0, 1.0, 1.0, 1.0), (5.0, None, None, 1.0, 1.0), (None, None, None, None, None), (5.0, 1.0, 1.0, 1.0, 1.0)]
    t = Table.from_df(spark.createDataFrame(rows, "a double, b double, c double, d double, e double"))
    for labels in (["a", "b"], ["a", "b", "c", "d", "e"]):
        for some, kept in ((lambda r: (r[0] != 5) | (r[1] > 3), 3), (lambda r: r[0] != 5, 3), (lambda r: (r[0] == 5) & (r[1] < 3), 1)):
            for is_opaque in (False, True):
                assert t.filter_numeric(labels, some, is_opaque).height() == kept


def test_mixed_rows_read_nominal_cells_in_three_ways(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), (None, 3.0), ("x", 4.0)], "n string, a double").coalesce(1)
    t = Table.from_df(df, {"n": TypeId.NOMINAL}).sort("a")
    for is_opaque in (False, True):
        height = lambda some: t.filter_mixed(["n", "a"], some, is_opaque).height()  # noqa: E731, B023
        assert height(lambda r: r.index(0) == 1) == 2
        assert height(lambda r: r.index("n") == 0) == 1
        assert height(lambda r: r.numeric(0) > 1) == 1
        assert height(lambda r: (r.object(0) == "x") & (r.numeric(1) > 1)) == 1


def test_own_columns_named_like_hidden_ones(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "_row string, _o0 long")
    t = Table.from_df(df).with_rows().sort("_row")
    assert [tuple(r) for r in t.df.select("_row", "_o0").collect()] in ([("a", 2), ("b", 1)], [("b", 1), ("a", 2)])
    with pytest.raises(ValueError):
        Table.from_df(spark.createDataFrame([(1,)], "__labelframe_row long"))


def test_dictionary_after_a_descending_text_sort(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q"), ("x", "r")], "n string, s string")
    t = Table.from_df(df, {"n": TypeId.NOMINAL}).sort("s", Order.DESCENDING)
    assert t.dictionary("n").values == ("x", "y")
