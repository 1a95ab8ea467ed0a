"""Queries for what the client does itself: writers, buffers, bytes, readers, gathers, contexts, schema questions.

They run over the small dimension tables, whose size doesn't grow.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelframe.dictionary import Dictionary
from labelframe.functions import collections as strings
from labelframe.functions import mapping
from labelframe.functions.predicates import Predicate
from labelframe.meta import ColumnAnnotation, ColumnReference, ColumnRole
from labelframe.operators import nominal
from labelframe.operators.builder import new_table_builder
from labelframe.operators.transform import Filterer
from labelframe.plans import context as contexts
from labelframe.plans.queries import INDEXED, N, _entries, _one, customers, events, long, orders, parts, query, read
from labelframe.sources import buffers, colio, readers, writers
from labelframe.table import ROW, Table, TableColumn
from labelframe.types import Capability, Order, TypeId


def nations(spark: SparkSession, d: str) -> Table:
    """The 25 nations, numbers doubled as a price that every fifth row lacks."""
    df = read(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") * 1.5).alias("price"), F.substring("n_name", -1, 1).alias("ending"))
    return Table.from_df(df, {"ending": N}, ["n_nationkey"])


NATIONS = "(SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS name, CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey * 1.5::DOUBLE END AS price, right(n_name, 1) AS ending FROM nation)"
_ENDINGS = f"(SELECT ending, row_number() OVER (ORDER BY min(pos)) AS idx FROM {NATIONS} GROUP BY 1)"
START = dt.datetime(2000, 1, 1)


def _rows(spark: SparkSession, d: str) -> list:
    """The nations' rows, for the client."""
    return [(int(r[0]), *r[1:]) for r in nations(spark, d).to_df(ordered=True).collect()]


def _placed(made: dict[str, TableColumn]) -> DataFrame:
    """(kind, pos, value) of several columns."""
    parts_ = [c.as_table("v").df.select(F.lit(k).alias("kind"), F.col(ROW).alias("pos"), F.col("v").alias("value")) for k, c in made.items()]
    return reduce(DataFrame.unionByName, parts_)


# ---- writers


@query(f"""SELECT pos, name, price, floor(coalesce(price, 0) + 0.5) AS whole, ending, ending || '|x' AS tags, ending || '|x|' || ending AS parts,
 pos * 1000000000 AS "time", TIMESTAMP '2000-01-01' + to_days(CAST(pos AS INTEGER)) AS moment, 7 AS width FROM {NATIONS}""")
def q_write_mixed_rows(spark, d):
    labels = ["name", "price", "whole", "ending", "tags", "parts", "time", "moment"]
    types = [TypeId.TEXT, TypeId.REAL, TypeId.INTEGER, N, TypeId.TEXT_SET, TypeId.TEXT_LIST, TypeId.TIME, TypeId.DATE_TIME]
    w = writers.mixed_row_writer(labels, types)
    for pos, name, price, ending in _rows(spark, d):
        w.move()
        for i, v in enumerate([name, price, price or 0.0, ending, [ending, "x", ending], [ending, "x", ending], pos * 1_000_000_000, START + dt.timedelta(days=pos)]):
            w.set(i, v)
    t = w.create(spark)
    shown = [F.array_join(c, "|").alias(c) if c in ("tags", "parts") else F.col(c).cast("timestamp_ntz").alias(c) if c == "moment" else F.col(c) for c in labels]
    return t.df.select(F.col(ROW).alias("pos"), *shown, F.lit(w.width() - 1).alias("width"))


@query(f"SELECT pos, CAST(pos AS DOUBLE) AS a, price AS b, 'numeric' AS writer FROM {NATIONS} UNION ALL SELECT pos, price, pos + 0.25::DOUBLE, 'real' FROM {NATIONS}")
def q_write_numeric_rows(spark, d):
    numbers, reals = writers.numeric_row_writer(["a", "b"], [TypeId.INTEGER, TypeId.REAL]), writers.real_row_writer(["a", "b"])
    for pos, _, price, _ in _rows(spark, d):
        for w, cells in ((numbers, (pos + 0.25, price)), (reals, (price, pos + 0.25))):
            w.move()
            for i in range(w.width()):
                w.set(i, cells[i])
    both = [w.create(spark).df.select(F.col(ROW).alias("pos"), "a", "b", F.lit(k).alias("writer")) for k, w in (("numeric", numbers), ("real", reals))]
    return both[0].unionByName(both[1])


# ---- buffers


@query(f"""SELECT 'real' AS kind, pos, price AS value FROM {NATIONS} UNION ALL SELECT 'integer', pos, floor(price + 0.5) FROM {NATIONS}
 UNION ALL SELECT 'sparse_real', pos, CASE WHEN pos % 3 = 0 THEN price ELSE 7 END FROM {NATIONS} UNION ALL SELECT 'sparse_integer', pos, CASE WHEN pos % 3 = 0 THEN floor(price + 0.5) ELSE 3 END FROM {NATIONS}
 UNION ALL SELECT 'copy', pos, CASE WHEN pos = 1 THEN -1 ELSE price END FROM {NATIONS}""")
def q_buffers_numeric(spark, d):
    rows = _rows(spark, d)
    made = {"real": buffers.real_buffer(len(rows)), "integer": buffers.integer_buffer(len(rows), False), "sparse_real": buffers.sparse_real_buffer(7.0, len(rows)), "sparse_integer": buffers.sparse_integer_buffer(2.5, len(rows))}
    for pos, _, price, _ in rows:
        made["real"].set(pos, price)
        made["integer"].set(pos, made["real"].get(pos))
        if pos % 3 == 0:
            made["sparse_real"].set_next(pos, price)
            made["sparse_integer"].set_next(pos, price)
    made["copy"] = buffers.real_buffer(made["real"].to_column(spark))
    made["copy"].set(1, -1.0)
    return _placed({k: b.to_column(spark) for k, b in made.items()})


@query(f"""SELECT 'text' AS kind, pos, CASE WHEN pos % 2 = 0 THEN name END AS value FROM {NATIONS} UNION ALL SELECT 'set', pos, ending || '|b' FROM {NATIONS} WHERE ending <> 'b'
 UNION ALL SELECT 'list', pos, ending || '|b|' || ending FROM {NATIONS}""")
def q_buffers_texts(spark, d):
    rows = _rows(spark, d)
    text, some, several = buffers.text_buffer(len(rows)), buffers.textset_buffer(len(rows)), buffers.textlist_buffer(len(rows))
    for pos, name, _, ending in rows:
        text.set(pos, name if pos % 2 == 0 else None)
        some.set(pos, [ending, "b", ending, None])
        several.set(pos, [ending, "b", ending])
    joined = [Table(c.as_table("v").df.withColumn("v", F.array_join("v", "|")), c.as_table("v").fields, c.as_table("v").order).column("v") for c in (some.to_column(spark), several.to_column(spark))]
    return _placed({"text": text.to_column(spark), "set": joined[0], "list": joined[1]})


@query(f"""SELECT 'nominal' AS kind, pos, ending AS value FROM {NATIONS} UNION ALL SELECT 'sparse', pos, CASE WHEN pos % 4 = 0 THEN ending ELSE 'none' END FROM {NATIONS}
 UNION ALL SELECT 'few', pos, ending FROM {NATIONS} JOIN {_ENDINGS} USING (ending) WHERE idx <= 3 UNION ALL SELECT 'few', pos, NULL FROM {NATIONS} JOIN {_ENDINGS} USING (ending) WHERE idx > 3
 UNION ALL SELECT 'different', max(idx), 'NOMINAL' FROM {_ENDINGS} UNION ALL SELECT 'boolean', 1, 'no' UNION ALL SELECT 'size', count(*), 'sparse' FROM {NATIONS}""")
def q_buffers_nominal(spark, d):
    rows = _rows(spark, d)
    every, sparse, few = buffers.nominal_buffer(len(rows)), buffers.sparse_nominal_buffer("none", len(rows), 200), buffers.nominal_buffer(len(rows), 3)
    flag = buffers.nominal_buffer(2, 2)
    for i, v in enumerate(("no", "yes")):
        flag.set(i, v)
    for pos, _, _, ending in rows:
        every.set(pos, ending)
        few.set_save(pos, ending)
        if pos % 4 == 0:
            sparse.set_next_save(pos, ending)
    facts = [("different", every.different_values(), every.type().value), ("boolean", flag.to_boolean_column("yes", spark).get_dictionary().negative_index(), flag.get(0)), ("size", sparse.size(), "sparse")]
    cells = _placed({"nominal": every.to_column(spark), "sparse": sparse.to_column(spark), "few": few.to_column(spark)})
    return cells.unionByName(spark.createDataFrame(facts, "kind string, pos long, value string"))


@query(f"""SELECT 'time' AS kind, pos, pos * 1000001 AS value FROM {NATIONS} UNION ALL SELECT 'sparse_time', pos, CASE WHEN pos % 5 = 0 THEN pos ELSE 11 END FROM {NATIONS}
 UNION ALL SELECT 'moment', pos, pos * 86400000000 + 5 FROM {NATIONS} UNION ALL SELECT 'seconds', pos, pos * 86400000000 FROM {NATIONS}
 UNION ALL SELECT 'sparse_moment', pos, CASE WHEN pos % 5 = 0 THEN pos * 1000000 ELSE 60000000 END FROM {NATIONS}""")
def q_buffers_times(spark, d):
    n = nations(spark, d).height()
    time, sparse = buffers.time_buffer(n), buffers.sparse_time_buffer(11, n)
    moment, seconds, some = buffers.date_time_buffer(n), buffers.date_time_buffer(n, False), buffers.sparse_date_time_buffer(60, n)
    for pos in range(n):
        time.set(pos, pos * 1_000_001)
        moment.set(pos, pos * 86400, 5000)
        seconds.set(pos, pos * 86400, 999_999_999)
        if pos % 5 == 0:
            sparse.set_next(pos, pos)
            some.set_next(pos, pos)
    micros = {}
    for k, b in (("moment", moment), ("seconds", seconds), ("sparse_moment", some)):
        t = b.to_column(spark).as_table("v")
        micros[k] = Table(t.df.withColumn("v", F.unix_micros(F.col("v").cast("timestamp"))), t.fields, t.order).column("v")
    return _placed({"time": time.to_column(spark), "sparse_time": sparse.to_column(spark), **micros})


# ---- the byte format


def _put_and_read(column: TableColumn, put, size: int, builder) -> int:
    """Through bytes in two pieces, the second one after the first; the number of cells."""
    n = column.size()
    first, rest = bytearray(size * (n // 2)), bytearray(size * (n - n // 2))
    put(column, 0, first)
    put(column, n // 2, rest)
    for part in (first, rest):
        builder(bytes(part))
    return n


@query(f"""SELECT 'integers' AS kind, pos, ending AS value FROM {NATIONS} UNION ALL SELECT 'shorts', pos, ending FROM {NATIONS} UNION ALL SELECT 'bytes', pos, ending FROM {NATIONS}
 UNION ALL SELECT 'position', count(*), 'all' FROM {NATIONS}""")
def q_bytes_nominal(spark, d):
    column = nations(spark, d).column("ending")
    values = [None, *(e.value for e in column.get_dictionary())]
    made = {}
    for kind, put, size in (("integers", colio.put_categorical_integers, 4), ("shorts", colio.put_categorical_shorts, 2), ("bytes", colio.put_categorical_bytes, 1)):
        b = colio.read_nominal(values, column.size())
        _put_and_read(column, put, size, getattr(b, f"put_{kind}"))
        made[kind] = b.to_column(spark)
    return _placed(made).unionByName(spark.createDataFrame([("position", b.position(), "all")], "kind string, pos long, value string"))


@query(f"SELECT 'real' AS kind, pos, price AS value FROM {NATIONS} UNION ALL SELECT 'integer', pos, floor(price + 0.5) FROM {NATIONS}")
def q_bytes_numeric(spark, d):
    column = nations(spark, d).column("price")
    made = {"real": colio.read_real(column.size()), "integer": colio.read_integer(column.size())}
    for b in made.values():
        _put_and_read(column, colio.put_numeric_doubles, 8, b.put)
    return _placed({k: b.to_column(spark) for k, b in made.items()})


@query("""SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, epoch_us(ts) AS micros, epoch_us(ts) % 86400000000 * 1000 AS "time" FROM events WHERE event_id <= 40""")
def q_bytes_times(spark, d):
    t = events(spark, d).columns(["event_id", "ts", "time"]).filter_numeric("event_id", lambda i: i <= 40)
    when, b = t.column("ts"), colio.read_date_time(t.height())
    n = _put_and_read(when, colio.put_date_time_longs, 8, b.put_seconds)
    _put_and_read(when, colio.put_date_time_nano_ints, 4, b.put_nanos)
    times = colio.read_time(n)
    _put_and_read(t.column("time"), colio.put_time_longs, 8, times.put)
    micros = b.to_column(spark).as_table("ts")
    both = new_table_builder(micros).add("time", times.to_column(spark)).build()
    return both.df.select(F.col(ROW).alias("pos"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "time")


# ---- readers


@query(f"""SELECT reader, pos, value FROM (SELECT *, CAST(idx AS DOUBLE) AS i FROM {NATIONS} JOIN {_ENDINGS} USING (ending)) n,
 LATERAL (SELECT unnest(['numeric', 'small', 'unbuffered', 'categorical', 'length']) AS reader, unnest([price, price, price, i, length(name)]) AS value)""")
def q_read_columns(spark, d):
    t = nations(spark, d)
    open_ = {
        "numeric": readers.numeric_reader(t.column("price")), "small": readers.small_numeric_reader(t.column("price")), "unbuffered": readers.unbuffered_numeric_reader(t.column("price")),
        "categorical": readers.categorical_reader(t.column("ending")),
    }
    out = []
    for kind, r in open_.items():
        while r.has_remaining():
            v = r.read()
            out.append((kind, r.position(), None if v != v else float(v)))
    names = readers.small_object_reader(t.column("n_name"), kind=str)
    while names.remaining():
        out.append(("length", names.position() + 1, float(len(names.read()))))
    return spark.createDataFrame(out, "reader string, pos long, value double")


@query(f"""SELECT pos, name, price, idx, CAST(idx AS DOUBLE) AS number, 2 AS width, pos = (SELECT max(pos) FROM {NATIONS}) AS last, ending, price AS again
 FROM {NATIONS} JOIN {_ENDINGS} USING (ending) WHERE pos >= 3""")
def q_read_rows(spark, d):
    """Mixed, numeric, categorical and object rows side by side, from the fourth row on."""
    t = nations(spark, d)
    mixed, numbers = readers.mixed_row_reader(t), readers.numeric_row_reader(t, ["n_nationkey", "price"])
    categories, objects = readers.categorical_row_reader(t, ["ending"]), readers.object_row_reader(t, ["n_name", "ending"])
    every = (mixed, numbers, categories, objects)
    for r in every:
        r.set_position(4)
        r.set_position(2)
    out = []
    while mixed.has_remaining():
        for r in every:
            r.move()
        row, cells = mixed.get(), numbers.fill([0.0, 0.0])
        price = [None if v != v else v for v in (row.numeric("price"), cells[1])]
        out.append((mixed.position(), row.object("n_name", str), price[0], row.index("ending"), row.numeric(3), objects.width(), not mixed.has_remaining(), objects.get(1), price[1]))
        assert categories.get(0) == row.index(3)
    return spark.createDataFrame(out, "pos long, name string, price double, idx long, number double, width int, last boolean, ending string, again double")


# ---- gathers and contexts


@query(f"""SELECT a.pos, CASE WHEN a.pos < 24 THEN 23 - a.pos ELSE -1 END AS source, b.name AS name,
 row_number() OVER (ORDER BY a.price DESC NULLS FIRST, a.pos) - 1 AS down, row_number() OVER (ORDER BY a.ending, a.pos) - 1 AS by_ending FROM {NATIONS} a LEFT JOIN {NATIONS} b ON a.pos < 24 AND b.pos = 23 - a.pos""")
def q_client_gathers(spark, d):
    """Gathers composed and applied, and stable index sorts."""
    rows = _rows(spark, d)
    n = len(rows)
    source = mapping.merge(list(reversed(range(n))), [*range(1, n), -1])
    names = mapping.apply([r[1] for r in rows], source)
    down = mapping.sort([float("nan") if r[2] is None else r[2] for r in rows], Order.DESCENDING)
    endings = mapping.sort(n, Order.ASCENDING, lambda a, b: (rows[a][3] > rows[b][3]) - (rows[a][3] < rows[b][3]))
    place = [{row: k for k, row in enumerate(order)} for order in (down, endings)]
    return spark.createDataFrame([(i, source[i], names[i], place[0][i], place[1][i]) for i in range(n)], "pos long, source long, name string, down long, by_ending long")


@query("""SELECT (SELECT count(*) FROM nation) AS nations, (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM supplier) AS suppliers, TRUE AS active, 1 AS alone, 'RuntimeError' AS stopped""")
def q_contexts(spark, d):
    c = contexts.Context(spark)
    n, r = contexts.run([lambda: read(spark, d, "nation").count(), lambda: read(spark, d, "region").count()], c)
    held = {}
    contexts.parallel(0, 1, lambda i: held.setdefault(i, read(spark, d, "supplier").count()), c)
    active, alone = c.is_active(), c.single_threaded().get_parallelism()
    c.stop()
    try:
        stopped = str(contexts.run(lambda: 0, c))
    except RuntimeError as error:
        stopped = type(error).__name__
    return spark.createDataFrame([(n, r, held[0], active, alone, stopped)], "nations long, regions long, suppliers long, active boolean, alone int, stopped string")


# ---- schema, metadata, selection


@query("""SELECT * FROM (VALUES ('with role', 'c_custkey'), ('with ID', 'c_custkey'), ('without', 'c_acctbal,c_mktsegment,c_name'), ('not sortable', ''), ('columns', '3'),
 ('first', ''), ('removed', '0'), ('width', '4'), ('label', 'c_mktsegment'), ('index', '2'), ('contains', 'True'), ('list', 'REAL')) v(question, answer)""")
def q_schema_questions(spark, d):
    t = customers(spark, d).columns(["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    b = new_table_builder(t).add_meta_data("c_custkey", [ColumnRole.ID, ColumnAnnotation("key")]).add_meta_data("c_name", ColumnReference("c_custkey"))
    marked = b.build()
    gone = b.remove_meta_data("c_custkey", ColumnRole).clear_meta_data("c_name").remove_meta_data("c_custkey", ColumnAnnotation("key"))
    answers = {
        "with role": ",".join(marked.select().with_meta_data(ColumnRole).labels()), "with ID": ",".join(marked.select().with_meta_data(ColumnRole.ID).labels()),
        "without": ",".join(sorted(marked.select().without_meta_data(ColumnRole).without_meta_data(ColumnRole.LABEL).labels())),
        "not sortable": ",".join(marked.select().without_capability(Capability.SORTABLE).labels()), "columns": str(len(marked.select().without_meta_data(ColumnRole.ID).columns())),
        "first": gone.get_first_meta_data("c_name", ColumnReference) or "", "removed": str(len(gone.get_meta_data("c_custkey"))), "width": str(marked.width()), "label": marked.label(3),
        "index": str(marked.index("c_acctbal")), "contains": str(marked.contains("c_name") and not gone.contains("absent")), "list": marked.column_list()[2].type.id.value,
    }
    return spark.createDataFrame(list(answers.items()), "question string, answer string")


_MADE = """SELECT CAST(i AS BIGINT) AS i, i / 4.0::DOUBLE AS number, floor(i / 4.0::DOUBLE + 0.5) AS whole, 't' || i AS plain, 'a|' || i AS tags, i || '|a|' || i AS parts, i * 1000 AS "time", make_timestamp(i * 1000000) AS moment,
 'n' || (i % 4) AS kind, CASE WHEN i % 2 = 0 THEN 'yes' ELSE 'no' END AS flag"""


def _columns_of(b, verb: str, i):
    """All kinds of columns computed from the row's number ``i`` (a shift added)."""
    text = lambda x: x.cast("string")
    makers = {
        "real": ("number", lambda r: (r + i) / F.lit(4.0)), "integer": ("whole", lambda r: (r + i) / F.lit(4.0)), "text": ("plain", lambda r: F.concat(F.lit("t"), text(r + i))),
        "text_set": ("tags", lambda r: F.array(F.lit("a"), text(r + i), F.lit("a"))), "text_list": ("parts", lambda r: F.array(text(r + i), F.lit("a"), text(r + i))),
        "time": ("time", lambda r: (r + i) * 1000), "date_time": ("moment", lambda r: F.timestamp_seconds(r + i)), "nominal": ("kind", lambda r: F.concat(F.lit("n"), text((r + i) % 4))),
    }
    for kind, (label, make) in makers.items():
        b = getattr(b, f"{verb}_{kind}")(label, make)
    return getattr(b, f"{verb}_boolean")("flag", lambda r: F.when((r + i) % 2 == 0, "yes").otherwise("no"), "yes")


def _shown(t: Table) -> DataFrame:
    return t.df.select(F.col(ROW).alias("i"), *[F.array_join(c, "|").alias(c) if c in ("tags", "parts") else F.col(c) for c in t.labels])


@query(f"{_MADE} FROM range(500) t(i)")
def q_builder_add_all_types(spark, d):
    return _shown(_columns_of(new_table_builder(500, spark), "add", 0).build())


@query(f"SELECT * REPLACE (i - 3 AS i) FROM ({_MADE} FROM range(3, 503) t(i))")
def q_builder_replace_all_types(spark, d):
    b = _columns_of(_columns_of(new_table_builder(500, spark), "add", 0), "replace", 3)
    assert b.contains("kind") and b.column_type_id("kind") is N and len(b.labels) == 9
    return _shown(b.build())


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey FROM part WHERE FALSE")
def q_strip_data(spark, d):
    return parts(spark, d).columns(["p_partkey"]).strip_data().to_df().select(long("p_partkey"))


@query(f"SELECT n.pos, b.name, b.price FROM (VALUES (0, 24), (1, 0), (2, 0), (3, NULL)) n(pos, place) LEFT JOIN {NATIONS} b ON b.pos = n.place")
def q_columns_rows(spark, d):
    """Rows of single columns by position."""
    t = nations(spark, d)
    a, b = (t.column(c).rows([24, 0, 0, -1]).df.select(F.col(ROW).cast("int").alias("pos"), c) for c in ("n_name", "price"))
    return a.join(b, "pos").withColumnRenamed("n_name", "name")


@query(f"SELECT pos, price AS number, idx, name FROM {NATIONS} JOIN {_ENDINGS} USING (ending) WHERE pos BETWEEN 4 AND 13")
def q_column_fill(spark, d):
    t = nations(spark, d)
    numbers, indices, objects = t.column("price").fill(4, 10, "numeric"), t.column("ending").fill(4, 10, "categorical"), t.column("n_name").fill(4, 10)
    rows = [(i + 4, None if x != x else x, k, o) for i, (x, k, o) in enumerate(zip(numbers, indices, objects, strict=True))]
    return spark.createDataFrame(rows, "pos long, number double, idx long, name string")


# ---- filters and predicates


@query(f"SELECT event_id FROM {INDEXED} WHERE coalesce(value > 10 AND value < 60, FALSE) OR coalesce(value > 90, FALSE)")
def q_predicates_combined(spark, d):
    both = Predicate(lambda v: v > 10).and_(Predicate(lambda v: v < 60)).or_(Predicate(lambda v: v > 90))
    return events(spark, d).columns(["event_id", "value"]).filter_numeric("value", both).to_df().select(long("event_id"))


def _positions(kind: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col("row"))


@query(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM {INDEXED})
 SELECT 'categorical' AS kind, n AS "row" FROM e WHERE idx = 2 UNION ALL SELECT 'object', n FROM e WHERE contains(props, '1') UNION ALL SELECT 'categories', n FROM e WHERE idx < 2
 UNION ALL SELECT 'objects', n FROM e WHERE event_type = 'click' AND contains(props, '1') UNION ALL SELECT 'mixed', n FROM e WHERE value > 30 AND idx = 1""")
def q_filterer_kinds(spark, d):
    t = events(spark, d)
    found = {
        "categorical": Filterer(t, "event_type").filter_categorical(lambda i: i == 2), "object": Filterer(t, "props").filter_objects(lambda p: p.contains("1")),
        "categories": Filterer(t, "event_type", "event_type").filter_categorical(lambda r: r[0] < 2),
        "objects": Filterer(t, "event_type", "props").filter_objects(lambda r: (r[0] == "click") & r[1].contains("1")),
        "mixed": Filterer(t, "value", "event_type").filter_mixed(lambda r: (r.numeric(0) > 30) & (r.index(1) == 1)),
    }
    return reduce(DataFrame.unionByName, [_positions(k, df) for k, df in found.items()])


# ---- dictionaries


@query("""SELECT * FROM (VALUES ('bicategorical', TRUE), ('at most', TRUE), ('boolean', TRUE), ('not boolean', FALSE), ('has positive', TRUE), ('has negative', TRUE), ('three', FALSE)) v(question, answer)""")
def q_dict_questions(spark, d):
    t = Table.from_df(read(spark, d, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag"), {"l_linestatus": N, "l_returnflag": N}, ["l_orderkey"])
    made = nominal.to_boolean(t, "l_linestatus", "O")
    flag = made.dictionary("l_linestatus")
    answers = {
        "bicategorical": nominal.is_bicategorical(t, "l_linestatus"), "at most": nominal.is_at_most_bicategorical(t, "l_linestatus"), "boolean": nominal.is_bicategorical_and_boolean(made, "l_linestatus"),
        "not boolean": nominal.is_bicategorical_and_boolean(t, "l_linestatus"), "has positive": flag.is_boolean() and flag.has_positive() and flag.positive_index() != flag.negative_index(),
        "has negative": flag.has_negative(), "three": nominal.is_at_most_bicategorical(t, "l_returnflag"),
    }
    return spark.createDataFrame(list(answers.items()), "question string, answer boolean")


@query("""WITH p AS (SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) AS idx FROM orders GROUP BY 1)
 SELECT idx, CASE value WHEN '5-LOW' THEN 'low' ELSE value END AS value FROM p UNION ALL SELECT count(*), 'size' FROM p UNION ALL SELECT max(idx), 'maximal' FROM p""")
def q_dict_replace_single(spark, d):
    """Renamed, an unused entry after it dropped by compaction."""
    renamed = nominal.replace_single(orders(spark, d).columns(["o_orderkey", "o_orderpriority"]), "o_orderpriority", "5-LOW", "low")
    gapped = Dictionary((*renamed.dictionary("o_orderpriority").values, None))
    whole = nominal.compact(renamed._with(dictionaries={"o_orderpriority": gapped}), "o_orderpriority").dictionary("o_orderpriority")
    facts = [(whole.size(), "size"), (whole.maximal_index(), "maximal"), *((whole.inverse()[e.value], e.value) for e in whole)]
    return spark.createDataFrame(facts, "idx long, value string")


@query("SELECT count(*) AS changed, count(DISTINCT p_name) AS names FROM part")
def q_dict_replace_many(spark, d):
    """Hundreds of categories renamed pos once."""
    t = Table.from_df(read(spark, d, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("p_name")), {"p_name": N}, ["p_partkey"])
    renamed = nominal.replace_values(t, "p_name", {e.value: f"new {e.value}" for e in t.dictionary("p_name")})
    n = renamed.filter_objects("p_name", lambda p: p.startswith("new ")).height()
    return _one(spark, changed=n, names=read(spark, d, "part").select("p_name").distinct().count())


# ---- string collections


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, len(w) = 0 AS empty, list_distinct(w) IS NOT NULL AS there, CAST(len(list_distinct(w)) AS INTEGER) AS n FROM (SELECT doc_id, [lang, source] AS w FROM documents)")
def q_collections_empty(spark, d):
    df = read(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), strings.set_of(F.array("lang", "source")).alias("w"))
    w = F.col("w")
    return df.select("doc_id", strings.is_empty(w).alias("empty"), w.isNotNull().alias("there"), strings.size(w).alias("n"))
