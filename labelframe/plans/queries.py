"""A query for each operator of the engine, and the same result in SQL.

Data without missing cells get some from a rule on another column, in both engines alike.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.functions import collections as strings
from labelframe.functions.predicates import Predicate
from labelframe.meta import ColumnAnnotation, ColumnReference, ColumnRole
from labelframe.operators import adapt as adapting
from labelframe.operators import nominal, stats
from labelframe.operators.append import append_columns, append_tables
from labelframe.operators.builder import new_table_builder
from labelframe.operators.stats import Statistic
from labelframe.operators.transform import Filterer
from labelframe.table import ROW, Table
from labelframe.types import Capability, Category, Order, TypeId

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ASC, DESC = Order.ASCENDING, Order.DESCENDING
N = TypeId.NOMINAL


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark, d) -> Table:
    return Table.from_df(read(spark, d, "customer"), {"c_mktsegment": N}, ["c_custkey"])


def orders(spark, d) -> Table:
    return Table.from_df(read(spark, d, "orders"), {"o_orderstatus": N, "o_orderpriority": N}, ["o_orderkey"])


def lineitems(spark, d) -> Table:
    return Table.from_df(read(spark, d, "lineitem"), {"l_returnflag": N, "l_linestatus": N})


def parts(spark, d) -> Table:
    return Table.from_df(read(spark, d, "part"), {"p_brand": N, "p_type": N}, ["p_partkey"])


def events(spark, d) -> Table:
    """Values, types and properties are missing by rules on the user."""
    df = read(spark, d, "events")
    df = df.select(
        "event_id", "user_id", "ts", F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("user_id") % 5 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("user_id") % 11 != 0, F.col("props")).alias("props"), (F.unix_micros(F.col("ts").cast("timestamp")) % 86_400_000_000 * 1000).alias("time"),
    )
    return Table.from_df(df, {"event_type": N, "time": TypeId.TIME}, ["event_id"])


EVENTS = """(SELECT event_id, user_id, ts, CASE WHEN user_id % 7 <> 0 THEN value END AS value, CASE WHEN user_id % 5 <> 0 THEN event_type END AS event_type,
 CASE WHEN user_id % 11 <> 0 THEN props END AS props, CAST(epoch_us(ts) % 86400000000 * 1000 AS BIGINT) AS "time" FROM events)"""
INDEXED = f"""(SELECT e.*, coalesce(i.idx, 0) AS idx FROM {EVENTS} e LEFT JOIN
 (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS idx FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY 1) i USING (event_type))"""


def long(name: str):
    return F.col(name).cast("long").alias(name)


# ---- projection, selection, names


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer")
def q_project_reorder(spark, d):
    return customers(spark, d).columns(["c_mktsegment", "c_acctbal", "c_custkey"]).to_df().withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT count(*) AS height FROM customer")
def q_project_nothing_keeps_height(spark, d):
    return customers(spark, d).columns([]).df.agg(F.count("*").alias("height"))


@query("SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def q_select_numeric(spark, d):
    return parts(spark, d).select().of_category(Category.NUMERIC).table().to_df()


@query("SELECT p_brand, p_type FROM part")
def q_select_nominal(spark, d):
    return parts(spark, d).select().of_type_id(N).with_capability(Capability.SORTABLE).table().to_df()


@query("SELECT p_name FROM part")
def q_select_others(spark, d):
    return parts(spark, d).select().not_of_category(Category.NUMERIC).not_of_type_id(N).matches_predicate(lambda c, x: x.startswith("p_")).table().to_df()


@query("SELECT n_name AS n_nationkey, CAST(n_nationkey AS BIGINT) AS n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def q_rename_swap(spark, d):
    t = Table.from_df(read(spark, d, "nation"), order_by=["n_nationkey"]).rename({"n_name": "n_nationkey", "n_nationkey": "n_name"})
    return t.to_df().select(F.col("n_nationkey"), long("n_name"), long("n_regionkey"))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS price, l_shipdate AS shipped FROM lineitem")
def q_builder_replace_remove_rename(spark, d):
    t = lineitems(spark, d).columns(["l_orderkey", "l_extendedprice", "l_discount", "l_shipdate"])
    b = new_table_builder(t).replace("l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount"))).remove("l_discount")
    df = b.rename("l_extendedprice", "price").rename("l_shipdate", "shipped").build().to_df()
    return df.select(long("l_orderkey"), F.round("price", 4).alias("price"), "shipped")


@query("SELECT CAST(i AS BIGINT) AS i, i / 2.0::DOUBLE AS half, floor(i / 2.0::DOUBLE + 0.5) AS whole, CASE WHEN i % 3 = 0 THEN NULL ELSE 'k' || (i % 3) END AS kind FROM range(1000) t(i)")
def q_generate_index_columns(spark, d):
    b = new_table_builder(1000, spark).add_integer("i", lambda i: i).add_real("half", lambda i: i / F.lit(2.0)).add_integer("whole", lambda i: i / F.lit(2.0))
    b = b.add_nominal("kind", lambda i: F.when(i % 3 != 0, F.concat(F.lit("k"), (i % 3).cast("string"))))
    return b.build().to_df().withColumn("i", F.col("i").cast("long"))


@query("SELECT CAST(i AS BIGINT) AS i, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, i * 1000000000 AS \"time\" FROM range(100) t(i)")
def q_generate_opaque(spark, d):
    b = new_table_builder(100, spark).add_integer("i", lambda i: float(int(i))).add_boolean("parity", lambda i: "even" if int(i) % 2 == 0 else "odd", "even").add_time("time", lambda i: int(i) * 1_000_000_000)
    return b.build().to_df().withColumn("i", F.col("i").cast("long"))


# ---- rows


@query("""SELECT p.pos, CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM (VALUES (0, 5), (1, 5), (2, 0), (3, -1), (4, 99999999), (5, 17)) p(pos, place)
 LEFT JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) o ON o.rn = p.place""")
def q_rows_gather(spark, d):
    t = orders(spark, d).columns(["o_orderkey", "o_totalprice"]).rows([5, 5, 0, -1, 99_999_999, 17])
    return t.df.select(F.col(ROW).cast("int").alias("pos"), long("o_orderkey"), "o_totalprice")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def q_rows_slice(spark, d):
    return orders(spark, d).columns(["o_orderkey"]).rows(100, 150).to_df().select(long("o_orderkey"))


@query("""SELECT CAST(a.o_orderkey AS BIGINT) AS o_orderkey, b.event_type AS kind FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) a
 JOIN (SELECT event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) b USING (n) WHERE n <= 800""")
def q_attach_by_position(spark, d):
    left = orders(spark, d).columns(["o_orderkey"]).rows(0, 800)
    right = Table.from_df(read(spark, d, "events").select("event_id", "event_type"), {"event_type": N}, ["event_id"]).rows(0, 800)
    return new_table_builder(left).add("kind", right.column("event_type")).build().to_df().select(long("o_orderkey"), "kind")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, bal FROM (SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS bal FROM customer) ORDER BY bal DESC NULLS FIRST, c_custkey LIMIT 40")
def q_sort_topk_desc_missing_first(spark, d):
    df = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal")).alias("bal"))
    return Table.from_df(df, order_by=["c_custkey"]).sort("bal", DESC).rows(0, 40).to_df().select(long("c_custkey"), "bal")


@query("""SELECT CAST(row_number() OVER (ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS FIRST, o_orderkey) - 1 AS BIGINT) AS place, CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders""")
def q_sort_multi_mixed(spark, d):
    t = orders(spark, d).columns(["o_orderkey", "o_orderpriority", "o_totalprice"]).sort(["o_orderpriority", "o_totalprice"], [ASC, DESC])
    return t.with_rows().df.select(F.col(ROW).alias("place"), long("o_orderkey"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_acctbal ASC NULLS LAST, c_custkey) - 1 AS BIGINT) AS place, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS \"row\" FROM customer")
def q_column_sort_permutation(spark, d):
    return customers(spark, d).column("c_acctbal").sort(ASC)


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row_number() OVER (ORDER BY s, doc_id) - 1 AS BIGINT) AS place FROM (SELECT doc_id, list_distinct(string_split(lang || ' ' || source, ' ')) AS l, {'n': len(l), 'v': list_sort(l)} AS s FROM documents)")
def q_sort_text_sets(spark, d):
    df = read(spark, d, "documents").select("doc_id", F.split(F.concat_ws(" ", "lang", "source"), " ").alias("tags"))
    t = Table.from_df(df, {"tags": TypeId.TEXT_SET}, ["doc_id"]).sort("tags")
    return t.with_rows().df.select(long("doc_id"), F.col(ROW).alias("place"))


# ---- filters


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def q_filter_numeric(spark, d):
    return lineitems(spark, d).columns(["l_orderkey", "l_quantity"]).filter_numeric("l_quantity", lambda q: q > 45).to_df().select(long("l_orderkey"), "l_quantity")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax + 0.05")
def q_filter_numeric_pair(spark, d):
    t = lineitems(spark, d).columns(["l_orderkey", "l_discount", "l_tax"]).filter_numeric(("l_discount", "l_tax"), lambda a, b: a > b + 0.05)
    return t.to_df().select(long("l_orderkey"), "l_discount", "l_tax")


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey FROM lineitem WHERE l_quantity * l_extendedprice > 2000000 AND l_tax < 0.03")
def q_filter_numeric_row(spark, d):
    t = lineitems(spark, d).columns(["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"])
    return t.filter_numeric(["l_quantity", "l_extendedprice", "l_tax"], lambda r: (r[0] * r[1] > 2000000) & (r["l_tax"] < 0.03)).to_df().select(long("l_orderkey"))


@query(f"SELECT event_id, event_type FROM {INDEXED} WHERE idx = 2 OR idx = 0")
def q_filter_categorical_index(spark, d):
    return events(spark, d).columns(["event_id", "event_type"]).filter_categorical("event_type", lambda i: (i == 2) | (i == 0)).to_df().select(long("event_id"), "event_type")


@query("SELECT CAST(event_id AS BIGINT) AS event_id FROM events WHERE user_id % 11 <> 0 AND contains(props, '1')")
def q_filter_objects(spark, d):
    return events(spark, d).columns(["event_id", "props"]).filter_objects("props", lambda p: p.contains("1")).to_df().select(long("event_id"))


@query("SELECT CAST(event_id AS BIGINT) AS event_id FROM events WHERE user_id % 11 <> 0 AND length(props) % 2 = 0")
def q_filter_objects_opaque(spark, d):
    keep = lambda p: p is not None and len(p) % 2 == 0
    return events(spark, d).columns(["event_id", "props"]).filter_objects("props", keep, opaque=True).to_df().select(long("event_id"))


@query(f"SELECT event_id FROM {EVENTS} WHERE value > 20 AND event_type = 'click'")
def q_filter_mixed(spark, d):
    t = events(spark, d).columns(["event_id", "value", "event_type"]).filter_mixed(["value", "event_type"], lambda r: (r.numeric(0) > 20) & (r.object(1) == "click"))
    return t.to_df().select(long("event_id"))


@query(f"SELECT event_id FROM {INDEXED} WHERE idx <= 1 AND value > 20")
def q_filter_mixed_index(spark, d):
    """A nominal cell of a mixed row is read by its index, 0 where missing."""
    t = events(spark, d).columns(["event_id", "value", "event_type"]).filter_mixed(["value", "event_type"], lambda r: (r.index(1) <= 1) & (r.numeric(0) > 20))
    return t.to_df().select(long("event_id"))


#: Five numbers, four of them missing in some rows.
HOLES = "(SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN value END AS value, CASE WHEN user_id % 5 <> 0 THEN value END AS b, CASE WHEN user_id % 3 <> 0 THEN value END AS c, CASE WHEN user_id % 2 <> 0 THEN value END AS d FROM events)"


def holes(spark, d) -> Table:
    given = read(spark, d, "events")
    some = [F.when(F.col("user_id") % k != 0, F.col("value")).alias(n) for n, k in (("value", 7), ("b", 5), ("c", 3), ("d", 2))]
    return Table.from_df(given.select("event_id", *some), order_by=["event_id"])


@query(f"SELECT event_id FROM {HOLES} WHERE coalesce(value <> 5, TRUE) AND coalesce(b > 10, FALSE) OR coalesce(value < 1, FALSE)")
def q_filter_missing_two_columns(spark, d):
    """A missing cell differs from everything and is neither less nor more."""
    t = holes(spark, d).filter_numeric(["value", "b"], lambda r: (r[0] != 5) & (r[1] > 10) | (r[0] < 1))
    return t.to_df().select(long("event_id"))


@query(f"SELECT event_id FROM {HOLES} WHERE (coalesce(value <> 5, TRUE) AND coalesce(b > 10, FALSE) OR coalesce(c < 1, FALSE)) AND coalesce(d <> 7, TRUE) AND event_id > 3")
def q_filter_missing_five_columns(spark, d):
    t = holes(spark, d).filter_numeric(["value", "b", "c", "d", "event_id"], lambda r: ((r[0] != 5) & (r[1] > 10) | (r[2] < 1)) & (r[3] != 7) & (r[4] > 3))
    return t.to_df().select(long("event_id"))


@query(f"SELECT event_id FROM {EVENTS} WHERE coalesce(NOT (value > 5), TRUE)")
def q_filter_not_missing_logic(spark, d):
    """A missing value is not over 5, so it passes the negation."""
    return events(spark, d).columns(["event_id", "value"]).filter_numeric("value", Predicate(lambda v: v > 5).negate()).to_df().select(long("event_id"))


@query(f"SELECT event_id FROM {EVENTS} WHERE coalesce(value <> 5, TRUE)")
def q_filter_unequal_missing(spark, d):
    """A missing value is unequal to any number."""
    return events(spark, d).columns(["event_id", "value"]).filter_numeric("value", lambda v: v != 5).to_df().select(long("event_id"))


@query(f"SELECT rn AS \"row\" FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM {EVENTS}) WHERE value > 40")
def q_filterer_positions(spark, d):
    return Filterer(events(spark, d), "value").filter_numeric(lambda v: v > 40)


@query(f"SELECT rn AS \"row\" FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM {EVENTS}) WHERE value > 10 AND user_id > 20")
def q_row_filterer_positions(spark, d):
    return Filterer(events(spark, d), "value", "user_id").filter_numeric(lambda r: (r[0] > 10) & (r[1] > 20))


# ---- apply: every view to every type


def _applied(spark, d, columns, view: str, out: TypeId, function) -> DataFrame:
    t = events(spark, d)
    made = getattr(t.transform(columns), f"apply_{view}_to_{out.value.lower()}")(function)
    c = F.array_join("out", "|") if out in (TypeId.TEXT_SET, TypeId.TEXT_LIST) else F.col("out")
    return new_table_builder(t).add("out", made).build().to_df().select(long("event_id"), c.alias("out"))


_FROM = "make_timestamp(CAST({} AS BIGINT) * 1000000)"
#: view: columns, a number of the cells (function, SQL), a string of them (function, SQL).
_VIEWS = {
    "numeric": ("value", lambda v: v / 3, "value / 3", lambda v: F.concat(F.lit("v"), F.floor(v).cast("string")), "'v' || CAST(floor(value) AS BIGINT)"),
    "categorical": ("event_type", lambda i: i / F.lit(2.0), "idx / 2.0::DOUBLE", lambda i: F.concat(F.lit("c"), i.cast("string")), "'c' || idx"),
    "objects": ("props", lambda p: F.length(p) / F.lit(4.0), "length(props) / 4.0::DOUBLE", lambda p: F.substring(p, 1, 9), "substring(props, 1, 9)"),
    "mixed": (["value", "event_type"], lambda r: r.numeric(0) + F.length(r.object(1)), "value + length(event_type)", lambda r: F.concat(r.object(1), F.floor(r.numeric(0)).cast("string")), "event_type || CAST(floor(value) AS BIGINT)"),
}
for _view, (_cols, _num, _num_sql, _text, _text_sql) in _VIEWS.items():
    _outs = {
        TypeId.REAL: (_num, _num_sql),
        TypeId.INTEGER: (_num, f"floor({_num_sql}) + CASE WHEN ({_num_sql}) - floor({_num_sql}) >= 0.5 THEN 1.0 ELSE 0.0 END"),
        TypeId.NOMINAL: (_text, _text_sql),
        TypeId.TEXT: (_text, _text_sql),
        TypeId.TEXT_LIST: (lambda x, f=_text: F.array(f(x), F.lit("a"), f(x)), f"CASE WHEN ({_text_sql}) IS NULL THEN 'a' ELSE concat_ws('|', {_text_sql}, 'a', {_text_sql}) END"),
        TypeId.TEXT_SET: (lambda x, f=_text: F.array(f(x), F.lit("a"), f(x)), f"concat_ws('|', {_text_sql}, 'a')"),
        TypeId.TIME: (lambda x, f=_num: F.floor(f(x)).cast("long") * 1_000_000, f"CAST(floor({_num_sql}) AS BIGINT) * 1000000"),
        TypeId.DATE_TIME: (lambda x, f=_num: F.timestamp_seconds(F.floor(f(x))), _FROM.format(f"floor({_num_sql})")),
    }
    for _out, (_f, _sql) in _outs.items():
        _name = f"q_apply_{_view}_to_{_out.value.lower()}"
        QUERIES[_name] = lambda spark, d, c=_cols, v=_view, o=_out, f=_f: _applied(spark, d, c, v, o, lambda x: f(x))
        ORACLE_SQL[_name] = f"SELECT event_id, {_sql} AS out FROM {INDEXED}"


@query(f"SELECT event_id, value + nullif(idx, 0) AS out FROM {INDEXED}")
def q_apply_mixed_index(spark, d):
    return _applied(spark, d, ["value", "event_type"], "mixed", TypeId.REAL, lambda r: r.numeric(0) + r.numeric(1))


@query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, greatest(l_discount, l_tax) AS out FROM lineitem")
def q_apply_pair_max(spark, d):
    t = lineitems(spark, d).columns(["l_orderkey", "l_discount", "l_tax"])
    made = t.transform("l_discount", "l_tax").apply_numeric_pair_to_real(lambda a, b: F.greatest(a, b))
    return new_table_builder(t).add("out", made).build().to_df().select(long("l_orderkey"), "out")


@query(f"SELECT event_id, value * value - 1 AS out FROM {EVENTS}")
def q_apply_opaque(spark, d):
    t = events(spark, d)
    made = t.transform("value").apply_numeric_to_real(lambda v: v * v - 1, is_opaque=True)
    return new_table_builder(t).add("out", made).build().to_df().select(long("event_id"), "out")


# ---- reduce


def _one(spark, **values) -> DataFrame:
    kinds = {str: "string", int: "long", float: "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


@query("SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
def q_reduce_sum(spark, d):
    return _one(spark, total=round(lineitems(spark, d).transform("l_quantity").reduce_numeric(0.0, operator.add), 2))


@query("SELECT max(l_extendedprice) AS top FROM lineitem")
def q_reduce_max(spark, d):
    return _one(spark, top=float(lineitems(spark, d).transform("l_extendedprice").reduce_numeric(float("-inf"), max)))


@query("SELECT count(*) AS pairs FROM lineitem WHERE l_discount > l_tax")
def q_reduce_count_pair(spark, d):
    def count(state, row):
        state[0] += row[0] > row[1]

    def combine(a, b):
        a[0] += b[0]

    return _one(spark, pairs=int(lineitems(spark, d).transform("l_discount", "l_tax").reduce_numeric(lambda: [0], count, combine)[0]))


@query(f"SELECT CAST(sum(length(props)) AS BIGINT) AS chars FROM {EVENTS}")
def q_reduce_objects(spark, d):
    def add(state, text):
        state[0] += len(text) if text is not None else 0

    def combine(a, b):
        a[0] += b[0]

    return _one(spark, chars=int(events(spark, d).transform("props").reduce_objects(lambda: [0], add, combine)[0]))


@query(f"SELECT CAST(max(idx) AS BIGINT) AS top FROM {INDEXED}")
def q_reduce_categorical(spark, d):
    return _one(spark, top=int(events(spark, d).transform("event_type").reduce_categorical(0, max)))


@query(f"SELECT string_agg(event_id::BIGINT, ',' ORDER BY event_id) AS ids FROM {EVENTS} WHERE value > 95 AND event_type = 'purchase'")
def q_reduce_mixed_in_order(spark, d):
    def add(state, row):
        if row[0] > 95 and row[1] == "purchase":
            state.append(int(row[2]))

    ids = events(spark, d).transform("value", "event_type", "event_id").reduce_mixed(list, add, list.extend)
    return spark.createDataFrame([(",".join(map(str, ids)) or None,)], "ids string")


# ---- statistics


_ALL = [Statistic.COUNT, Statistic.MIN, Statistic.MAX, Statistic.MEAN, Statistic.VAR, Statistic.SD, Statistic.P25, Statistic.P50, Statistic.P75]


def _rank(p: float) -> str:
    r = f"({p} * (n + 1))"
    return f"CASE WHEN n = 0 THEN NULL WHEN floor{r} < 1 THEN a[1] WHEN floor{r} >= n THEN a[n] ELSE a[CAST(floor{r} AS BIGINT)] + ({r} - floor{r}) * (a[CAST(floor{r} AS BIGINT) + 1] - a[CAST(floor{r} AS BIGINT)]) END"


def _stats_sql(column: str, source: str, digits: int = 4) -> str:
    plain = {"COUNT": "CAST(n AS DOUBLE)", "MIN": "a[1]", "MAX": "a[n]", "MEAN": "m", "VAR": "v", "SD": "sqrt(v)", "P25": _rank(0.25), "P50": _rank(0.5), "P75": _rank(0.75)}
    inner = f"SELECT count({column}) AS n, list({column} ORDER BY {column}) FILTER (WHERE {column} IS NOT NULL) AS a, avg({column}) AS m, var_samp({column}) AS v FROM {source}"
    return " UNION ALL ".join(f"SELECT '{k}' AS statistic, round({e}, {digits}) AS value FROM ({inner})" for k, e in plain.items())


def _stats(spark, table: Table, label: str, which=tuple(_ALL), digits: int = 4) -> DataFrame:
    found = stats.compute(table.column(label), which)
    rows = [(s.value, None if (v := r.numeric) != v else round(v, digits)) for s, r in found.items()]
    return spark.createDataFrame(rows, "statistic string, value double")


@query(_stats_sql("c_acctbal", "customer"))
def q_stats_numeric(spark, d):
    return _stats(spark, customers(spark, d), "c_acctbal")


@query(_stats_sql("value", EVENTS))
def q_stats_numeric_missing(spark, d):
    return _stats(spark, events(spark, d), "value")


@query(_stats_sql("l_extendedprice", "lineitem", 2))
def q_stats_large(spark, d):
    return _stats(spark, lineitems(spark, d), "l_extendedprice", digits=2)


@query(f"""SELECT CAST(count(t) AS BIGINT) AS n, min(t) AS low, max(t) AS high, CAST(floor(avg(t)) AS BIGINT) // 1000000 AS mean_ms, CAST(floor(stddev_samp(t)) AS BIGINT) // 1000000 AS sd_ms FROM (SELECT "time" AS t FROM {EVENTS})""")
def q_stats_time(spark, d):
    r = stats.compute(events(spark, d).column("time"), [Statistic.COUNT, Statistic.MIN, Statistic.MAX, Statistic.MEAN, Statistic.SD])
    o = {s: x.object for s, x in r.items()}
    return _one(spark, n=int(r[Statistic.COUNT].numeric), low=o[Statistic.MIN], high=o[Statistic.MAX], mean_ms=o[Statistic.MEAN] // 1_000_000, sd_ms=o[Statistic.SD] // 1_000_000)


@query("SELECT count(o_orderdate) AS n, min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders")
def q_stats_datetime(spark, d):
    r = stats.compute(orders(spark, d).column("o_orderdate"), [Statistic.COUNT, Statistic.MIN, Statistic.MAX])
    row = (int(r[Statistic.COUNT].numeric), r[Statistic.MIN].object, r[Statistic.MAX].object)
    return spark.createDataFrame([row], "n long, low timestamp_ntz, high timestamp_ntz")


def _mode_sql(column: str, key: str, source: str) -> str:
    used = f"SELECT {column} AS value, count(*) AS n, min({key}) AS f FROM {source} WHERE {column} IS NOT NULL GROUP BY 1"
    return f"SELECT 'MODE' AS statistic, value, n FROM (SELECT * FROM ({used}) ORDER BY n DESC, f LIMIT 1) UNION ALL SELECT 'LEAST', value, n FROM (SELECT * FROM ({used}) ORDER BY n, f LIMIT 1)"


def _modes(spark, table: Table, label: str) -> DataFrame:
    r = stats.compute(table.column(label), [Statistic.MODE, Statistic.LEAST])
    return spark.createDataFrame([(s.value, x.object, int(x.numeric)) for s, x in r.items()], "statistic string, value string, n long")


@query(_mode_sql("o_orderstatus", "o_orderkey", "orders"))
def q_stats_nominal_mode_least(spark, d):
    return _modes(spark, orders(spark, d), "o_orderstatus")


@query(_mode_sql("source", "doc_id", "documents"))
def q_stats_nominal_tie(spark, d):
    return _modes(spark, Table.from_df(read(spark, d, "documents").select("doc_id", "source"), {"source": N}, ["doc_id"]), "source")


@query(f"SELECT CAST(idx AS BIGINT) AS idx, count(*) AS n FROM {INDEXED} GROUP BY 1")
def q_stats_index_counts(spark, d):
    r = stats.compute(events(spark, d).column("event_type"), Statistic.INDEX_COUNTS)
    return spark.createDataFrame(list(enumerate(r.counts)), "idx long, n long")


# ---- dictionaries


_PRIORITIES = "(SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) AS idx FROM orders GROUP BY 1)"


def _entries(spark, dictionary) -> DataFrame:
    return spark.createDataFrame([(e.index, e.value) for e in dictionary], "idx long, value string")


@query(f"SELECT idx, value FROM {_PRIORITIES}")
def q_dict_entries(spark, d):
    return _entries(spark, orders(spark, d).dictionary("o_orderpriority"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END AS o_orderpriority FROM orders")
def q_dict_change(spark, d):
    from labelframe.dictionary import Dictionary

    t = nominal.change_dictionary(orders(spark, d).columns(["o_orderkey", "o_orderpriority"]), "o_orderpriority", Dictionary.of(["2-HIGH", "1-URGENT"]))
    return t.to_df().select(long("o_orderkey"), "o_orderpriority")


@query(f"""SELECT * FROM (VALUES (1, 'zero'), (2, '2-HIGH')) v(idx, value) UNION ALL
 SELECT 2 + row_number() OVER (ORDER BY idx), value FROM {_PRIORITIES} WHERE value NOT IN ('zero', '2-HIGH')""")
def q_dict_merge(spark, d):
    from labelframe.dictionary import Dictionary

    return _entries(spark, nominal.merge_dictionary(orders(spark, d), "o_orderpriority", Dictionary.of(["zero", "2-HIGH"])).dictionary("o_orderpriority"))


def _some_used(spark, d, option):
    t = orders(spark, d)
    t.dictionary("o_orderpriority")
    few = t.filter_objects("o_orderpriority", lambda p: (p == "1-URGENT") | (p == "3-MEDIUM"))
    return _entries(spark, nominal.remove_unused(few, "o_orderpriority", option).dictionary("o_orderpriority"))


@query(f"SELECT idx, value FROM {_PRIORITIES} WHERE value IN ('1-URGENT', '3-MEDIUM')")
def q_dict_remove(spark, d):
    return _some_used(spark, d, nominal.CleanupOption.REMOVE)


@query(f"SELECT row_number() OVER (ORDER BY idx) AS idx, value FROM {_PRIORITIES} WHERE value IN ('1-URGENT', '3-MEDIUM')")
def q_dict_compact(spark, d):
    return _some_used(spark, d, nominal.CleanupOption.COMPACT)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' WHEN '2-HIGH' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def q_dict_replace_swap(spark, d):
    t = nominal.replace_values(orders(spark, d).columns(["o_orderkey", "o_orderpriority"]), "o_orderpriority", {"1-URGENT": "2-HIGH", "2-HIGH": "1-URGENT", "absent": "x"})
    return t.to_df().select(long("o_orderkey"), "o_orderpriority")


@query("SELECT 'F' AS positive, 'O' AS negative, count(*) FILTER (WHERE l_linestatus = 'F') AS n_positive FROM lineitem")
def q_dict_boolean(spark, d):
    t = nominal.to_boolean(lineitems(spark, d).columns(["l_linestatus"]), "l_linestatus", "F")
    b = t.dictionary("l_linestatus")
    n = t.filter_categorical("l_linestatus", lambda i: i == b.positive_index()).height()
    return _one(spark, positive=b.get(b.positive_index()), negative=b.negative(), n_positive=n)


# ---- append, adapt, checks


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, s_acctbal AS balance FROM supplier UNION ALL SELECT CAST(c_custkey AS BIGINT), c_acctbal FROM customer")
def q_append_by_label(spark, d):
    a = Table.from_df(read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), order_by=["id"])
    b = Table.from_df(read(spark, d, "customer").select(F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id")), order_by=["id"])
    return append_tables([a, b]).to_df().select(long("id"), "balance")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS v FROM supplier UNION ALL SELECT c_acctbal FROM customer")
def q_append_int_real(spark, d):
    a = Table.from_df(read(spark, d, "supplier").select(F.col("s_suppkey").alias("v")), order_by=["v"])
    b = Table.from_df(read(spark, d, "customer").select(F.col("c_acctbal").alias("v")), order_by=["v"])
    return append_tables([a, b]).to_df()


@query("""SELECT CAST(n - 1 AS BIGINT) AS at, v FROM (SELECT n, v FROM (SELECT row_number() OVER (ORDER BY p, k) AS n, v FROM (SELECT 0 AS p, n_nationkey AS k, n_name AS v FROM nation
 UNION ALL SELECT 1, r_regionkey, r_name FROM region)) WHERE n <= 28 UNION ALL SELECT n, NULL FROM range(31, 35) t(n) WHERE FALSE)""")
def q_append_truncate(spark, d):
    a = Table.from_df(read(spark, d, "nation").select("n_nationkey", "n_name"), order_by=["n_nationkey"]).column("n_name")
    b = Table.from_df(read(spark, d, "region").select("r_regionkey", "r_name"), order_by=["r_regionkey"]).column("r_name")
    return append_columns([a, b], 28).df.select(F.col(ROW).alias("at"), F.col("value").alias("v"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS at, r_name AS v FROM region UNION ALL SELECT n, NULL FROM range(5, 9) t(n)")
def q_append_pad(spark, d):
    b = Table.from_df(read(spark, d, "region").select("r_regionkey", "r_name"), order_by=["r_regionkey"]).column("r_name")
    return append_columns([b], 9).df.select(F.col(ROW).alias("at"), F.col("value").alias("v"))


def _schema(spark, d) -> Table:
    return parts(spark, d).columns(["p_retailprice", "p_brand"])


@query("SELECT p_retailprice, p_brand FROM part")
def q_adapt_reorder(spark, d):
    return adapting.adapt(parts(spark, d), _schema(spark, d)).to_df()


@query("SELECT p_retailprice, p_brand, CAST(p_partkey AS BIGINT) AS p_partkey, p_type FROM part")
def q_adapt_keep_additional(spark, d):
    t = parts(spark, d).columns(["p_partkey", "p_brand", "p_type", "p_retailprice"])
    out = adapting.adapt(t, _schema(spark, d), adapting.ColumnHandling.REORDER_KEEP_ADDITIONAL, adapting.DictionaryHandling.MERGE)
    return out.to_df().withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT * FROM (VALUES ('p_retailprice', 'TYPE_MISMATCH'), ('p_brand', 'NOT_SUB_DICTIONARY'), ('p_size', 'WRONG_COLUMN_PRESENT'), ('p_gone', 'MISSING_COLUMN')) v(label, problem)")
def q_incompatible_report(spark, d):
    own = parts(spark, d).columns(["p_retailprice", "p_brand", "p_size"])
    df = read(spark, d, "part").select(F.col("p_name").alias("p_retailprice"), F.lit("Brand#none").alias("p_brand"), F.lit(1.0).alias("p_gone"))
    found = adapting.find_incompatible(own, Table.from_df(df, {"p_brand": N}), adapting.ColumnSetRequirement.EQUAL, adapting.TypeRequirement.REQUIRE_MATCHING_TYPES, adapting.TypeRequirement.REQUIRE_SUB_DICTIONARIES)
    return spark.createDataFrame([(k, v.value) for k, v in found.items()], "label string, problem string")


# ---- string collections


@query("""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS INTEGER) AS n, CAST(len(list_distinct(w)) AS INTEGER) AS n_set, list_contains(w, 'the') AS has_the,
 CAST(coalesce(list_position(w, 'the'), 0) - 1 AS INTEGER) AS first_the, w[3] AS third, array_to_string(w[2:4], '|') AS sub, list_has_all(w, ['the', 'of']) AS has_both
 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def q_textset_textlist_ops(spark, d):
    w = strings.list_of(F.split("text", " "))
    df = read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), w.alias("w"))
    w = F.col("w")
    return df.select(
        "doc_id", strings.size(w).alias("n"), strings.size(strings.set_of(w)).alias("n_set"), strings.contains(w, "the").alias("has_the"), strings.index_of(w, "the").alias("first_the"),
        strings.get(w, 2).alias("third"), F.array_join(strings.sub_list(w, 1, 4), "|").alias("sub"), strings.contains_all(w, F.array(F.lit("the"), F.lit("of"))).alias("has_both"),
    )


# ---- metadata, formats, the flagship


@query("SELECT * FROM (VALUES ('c_custkey', 'role', 'ID'), ('c_name', 'annotation', 'the name'), ('c_acctbal', 'reference', 'id2')) v(label, kind, held)")
def q_metadata(spark, d):
    b = new_table_builder(customers(spark, d)).add_meta_data("c_custkey", ColumnRole.ID).add_meta_data("c_name", ColumnAnnotation("the name")).add_meta_data("c_acctbal", ColumnReference("c_name"))
    t = b.build().rename({"c_name": "id2"})
    rows = [("c_custkey", "role", t.get_first_meta_data("c_custkey", ColumnRole).value), ("c_name", "annotation", t.get_first_meta_data("id2", ColumnAnnotation).annotation), ("c_acctbal", "reference", t.get_first_meta_data("c_acctbal", ColumnReference).column)]
    return spark.createDataFrame(rows, "label string, kind string, held string")


@query("SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS at, s_acctbal AS v FROM supplier")
def q_binary_round_trip(spark, d):
    from labelframe.sources import colio

    t = Table.from_df(read(spark, d, "supplier").select("s_suppkey", "s_acctbal"), order_by=["s_suppkey"])
    n = t.height()
    data = bytearray(8 * n)
    colio.put_numeric_doubles(t.column("s_acctbal"), 0, data)
    made = colio.read_real(n).put(data).to_column(spark).as_table("v")
    return made.df.select(F.col(ROW).alias("at"), "v")


@query("""SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)
 WHERE l_extendedprice > m ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""")
def q_rows_above_average(spark, d):
    """The flagship: rows above the column's mean, projected, sorted downwards, the first hundred."""
    t = Table.from_df(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), order_by=["l_orderkey", "l_linenumber", "l_partkey"])
    mean = stats.compute(t.column("l_extendedprice"), Statistic.MEAN).numeric
    t = t.filter_numeric("l_extendedprice", lambda v: v > mean).columns(["l_orderkey", "l_linenumber", "l_extendedprice"]).sort("l_extendedprice", DESC).rows(0, 100)
    return t.to_df().select(long("l_orderkey"), long("l_linenumber"), "l_extendedprice")
