"""The engine's operators as queries over the test tables, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import describe, type_class
from ..operators import export, sink
from ..operators.edits import EditError, EditLog, overlay
from ..operators.ordering import page, sorted_by, sorted_page
from ..operators.predicates import matching
from ..sources.local import local_table
from ..sources.files import numbered
from ..sources.parquet import exists, file_info, row_count, scan
from ..sources.recents import Recents, most_recent
from ..sources.scratch import scratch
from ..streaming.follow import follow
from .view import ViewState
from .workbook import Workbook

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/{name}.parquet")


def _numbered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return numbered(spark, f"{sf_dir}/{name}.parquet")[0]


_ORDERS = "(SELECT CAST(row_number() OVER () AS BIGINT) AS row_number, * FROM orders)"


@query(f"SELECT * FROM {_ORDERS} WHERE contains(lower(o_orderpriority), 'urg') ORDER BY o_totalprice DESC NULLS LAST, row_number LIMIT 50 OFFSET 20")
def explore_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet").filter("o_orderpriority", " URG ").toggle_sort("o_totalprice").toggle_sort("o_totalprice").page(20, 50)
    return book.view()


@query("SELECT * FROM orders")
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders")


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def column_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")


@query(f"SELECT * FROM {_ORDERS}")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, "orders")


@query("SELECT count(*) AS n_rows FROM lineitem")
def row_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_count(_table(spark, sf_dir, "lineitem"))


@query("""SELECT column_name, column_type, "null" = 'YES' AS nullable FROM (DESCRIBE SELECT * FROM lineitem)""")
def describe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(_table(spark, sf_dir, "lineitem"))


@query("""SELECT column_name, column_type, "null" = 'YES' AS nullable FROM (DESCRIBE SELECT * FROM embeddings)""")
def describe_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(_table(spark, sf_dir, "embeddings"))


_CLASS = """CASE WHEN regexp_matches(lower(column_type), 'int|double|float') THEN 'numeric' WHEN regexp_matches(lower(column_type), 'string|varchar') THEN 'text'
  WHEN regexp_matches(lower(column_type), 'date|timestamp') THEN 'temporal' WHEN regexp_matches(lower(column_type), 'bool') THEN 'boolean' ELSE 'other' END"""


@query(f"SELECT column_name, {_CLASS} AS type_class FROM (DESCRIBE SELECT * FROM lineitem)")
def type_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(_table(spark, sf_dir, "lineitem")).select("column_name", type_class(F.col("column_type")).alias("type_class"))


@query(f"""SELECT 'customer.parquet' AS line UNION ALL SELECT format('{{:,}} rows', count(*)) FROM customer UNION ALL SELECT count(*) || ' columns' FROM (DESCRIBE SELECT * FROM customer)
  UNION ALL SELECT '[' || {_CLASS} || '] ' || column_name || ' (' || column_type || ')' FROM (DESCRIBE SELECT * FROM customer)""")
def schema_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/customer.parquet"
    return local_table(spark, [("line", pa.string())], [(x,) for x in file_info(scan(spark, path), path).panel()])


@query("SELECT * FROM lineitem WHERE contains(lower(CAST(l_extendedprice AS VARCHAR)), '99')")
def filter_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "lineitem"), [("l_extendedprice", "99")])


@query("SELECT * FROM orders WHERE o_orderpriority ILIKE '%urg%'")
def filter_string_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "orders"), [("o_orderpriority", "uRg")])


@query("SELECT * FROM orders WHERE contains(CAST(o_orderdate AS VARCHAR), '1995-03')")
def filter_timestamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "orders"), [("o_orderdate", "1995-03")])


@query("SELECT * FROM orders WHERE o_orderpriority ILIKE '%high%' AND contains(CAST(o_totalprice AS VARCHAR), '7')")
def filter_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "orders"), [("o_orderpriority", "*%high*"), ("o_totalprice", "7%")])


@query("SELECT * FROM documents WHERE contains(lower(text), '%')")
def filter_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "documents"), [("text", "[%]")])


@query("SELECT * FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS nation FROM customer) WHERE nation IS NOT NULL")
def filter_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation")), [("nation", "*")])


@query("""SELECT * FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS nation, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
  WHERE coalesce(contains(CAST(c_custkey AS VARCHAR), '1'), FALSE) OR coalesce(contains(CAST(nation AS VARCHAR), '1'), FALSE) OR coalesce(contains(lower(segment), '1'), FALSE)""")
def search_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment")), search="1")


_ANY_77 = " OR ".join(f"contains(lower(CAST({c} AS VARCHAR)), '77')" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))


@query(f"SELECT * FROM lineitem WHERE {_ANY_77}")
def search_anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "lineitem"), search="77")


@query("""SELECT * FROM customer WHERE contains(lower(c_mktsegment), 'bui') AND (contains(CAST(c_custkey AS VARCHAR), '77') OR contains(lower(c_name), '77')
  OR contains(CAST(c_nationkey AS VARCHAR), '77') OR contains(CAST(c_acctbal AS VARCHAR), '77') OR contains(lower(c_mktsegment), '77'))""")
def search_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "customer"), [("c_mktsegment", "bui")], "77")


@query(f"SELECT * FROM {_ORDERS} ORDER BY lower(o_orderpriority) NULLS FIRST, row_number LIMIT 50")
def sort_string_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(sorted_by(_numbered(spark, sf_dir, "orders"), "o_orderpriority", True, "row_number"), 0, 50)


@query(f"SELECT * FROM {_ORDERS} ORDER BY o_totalprice DESC NULLS LAST, row_number LIMIT 25 OFFSET 100")
def sort_desc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ViewState().toggle_sort("o_totalprice").toggle_sort("o_totalprice").page(100, 25).apply(_numbered(spark, sf_dir, "orders"))


_CUSTOMERS = "(SELECT CAST(row_number() OVER () AS BIGINT) AS row_number, nullif(c_nationkey, 3) AS nation FROM customer)"


@query(f"SELECT * FROM {_CUSTOMERS} ORDER BY nation NULLS FIRST, row_number LIMIT 100")
def sort_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(spark, sf_dir, "customer").select("row_number", F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return page(sorted_by(df, "nation", True, "row_number"), 0, 100)


@query(f"SELECT * FROM {_CUSTOMERS} ORDER BY nation DESC NULLS LAST, row_number LIMIT 1450")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(spark, sf_dir, "customer").select("row_number", F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    return page(sorted_by(df, "nation", False, "row_number"), 0, 1450)


@query(f"SELECT * FROM {_ORDERS} WHERE row_number > 200 AND row_number <= 250")
def stored_order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.open(spark, f"{sf_dir}/orders.parquet").page(200, 50).view()


@query(f"SELECT * FROM {_ORDERS}")
def row_numbers_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved as a folder of files, and numbered over them."""
    to = scratch(spark, "folder")
    sink.save(_numbered(spark, sf_dir, "orders").repartitionByRange(5, "row_number"), to, "row_number", layout="directory")
    return numbered(spark, to)[0]


@query("SELECT 1 AS files, count(*) AS n_rows, count(DISTINCT rn) AS row_numbers FROM (SELECT row_number() OVER () AS rn FROM lineitem)")
def row_numbers_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _numbered(spark, sf_dir, "lineitem")
    files = scan(spark, f"{sf_dir}/lineitem.parquet").select(F.col("_metadata.file_path").alias("at")).agg(F.countDistinct("at").cast("int").alias("files"))
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct("row_number").alias("row_numbers")).crossJoin(files).select("files", "n_rows", "row_numbers")  # one row each


@query(f"""SELECT row_number, o_orderkey, o_custkey, CASE WHEN row_number = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN row_number = 3 THEN 12.5 WHEN row_number = 7 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN row_number = 11 THEN TIMESTAMP '2001-02-03 04:05:06' ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM {_ORDERS}""")
def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay(*_edited(spark, sf_dir))


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, EditLog]:
    df = _numbered(spark, sf_dir, "orders")
    log = EditLog(df.schema, "row_number")
    for row, name, value in ((3, "o_totalprice", 99), (3, "o_totalprice", 12.5), (7, "o_orderstatus", "X"), (7, "o_totalprice", None), (11, "o_orderdate", "2001-02-03 04:05:06")):
        log.record(spark, row, name, value)
    return df, log


def _joined(columns: list[str], delimiter: str = "chr(9)", quoted: bool = False) -> str:
    cells = [f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns]
    if quoted:
        cells = [f"""CASE WHEN regexp_matches({c}, '[,"\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END""" for c in cells]
    return f"concat_ws({delimiter}, {', '.join(cells)})"


_ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(f"SELECT {_joined(_ORDER_COLUMNS)} AS line FROM orders")
def export_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.lines(_table(spark, sf_dir, "orders"))


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(f"SELECT {_joined(_EVENT_COLUMNS, chr(39) + ',' + chr(39), True)} AS line FROM events")
def export_csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.lines(_table(spark, sf_dir, "events"), _EVENT_COLUMNS, ",")


@query(f"SELECT {_joined(['doc_id', 'text', 'lang', 'source', 'n_chars'], chr(39) + ',' + chr(39), True)} AS line FROM documents")
def export_csv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.lines(_table(spark, sf_dir, "documents"), delimiter=",")


def _headed(names: list[str], lines: str, delimiter: str = "chr(9)") -> str:
    """SQL for a header line before ``lines``."""
    said = ", ".join(f"'{n}'" for n in names)
    return f"SELECT concat_ws({delimiter}, {said}) AS line UNION ALL {lines}"


@query(_headed(["#", *_ORDER_COLUMNS], f"SELECT {_joined(['row_number', *_ORDER_COLUMNS])} AS line FROM {_ORDERS} WHERE row_number IN (2, 5, 900)"))
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.rows(_numbered(spark, sf_dir, "orders"), "row_number", [900, 2, 5], headers=True).lines()


@query(f"SELECT {_joined(['row_number', 'o_orderpriority', 'o_orderkey'])} AS line FROM {_ORDERS} WHERE row_number <= 40")
def export_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.rows(_numbered(spark, sf_dir, "orders"), "row_number", range(1, 41), visible=["o_orderpriority", "o_orderkey"]).lines()


@query(_headed(["o_orderkey", "o_orderpriority"], f"SELECT {_joined(['o_orderkey', 'o_orderpriority'])} AS line FROM orders WHERE o_orderstatus ILIKE '%o%'"))
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.open(spark, f"{sf_dir}/orders.parquet").filter("o_orderstatus", "o").toggle_sort("o_orderdate").copy_columns(["o_orderpriority", "o_orderkey", "o_orderkey"], headers=True).lines()


@query(_headed(["c_name", "c_acctbal"], f"SELECT {_joined(['c_name', 'c_acctbal'])} AS line FROM (SELECT row_number() OVER () AS rn, * FROM customer) WHERE rn IN (1, 42)"))
def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.open(spark, f"{sf_dir}/customer.parquet").copy_cells([1, 42], ["c_acctbal", "c_name"], headers=True).lines()


@query("SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def save_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "seconds") + ".parquet"
    sink.save(_numbered(spark, sf_dir, "events").select("row_number", "event_id", "ts"), to, "row_number", timestamp_precision="second")
    return scan(spark, to)


@query("""SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,4)) AS price, nullif(o_orderstatus = 'F', o_orderkey % 5 = 0) AS filled, hex(encode(o_orderpriority)) AS said, len([o_custkey, o_orderkey])::INT AS n, o_custkey AS first,
  o_orderstatus AS inner_status, nullif(o_custkey, 10) AS customer FROM orders""")
def save_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals, booleans, bytes, lists, structs and nulls through a save; the parts of what has parts are read back."""
    o = _numbered(spark, sf_dir, "orders")
    made = o.select(
        "row_number",
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(18,4)").alias("price"),
        F.nullif(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 5 == 0).alias("filled"),
        F.col("o_orderpriority").cast("binary").alias("said"),
        F.array("o_custkey", "o_orderkey").alias("keys"),
        F.struct(F.col("o_orderstatus").alias("status")).alias("inner"),
        F.nullif("o_custkey", F.lit(10)).alias("customer"),
    )
    to = scratch(spark, "types") + ".parquet"
    sink.save(made, to, "row_number")
    return scan(spark, to).select("o_orderkey", "price", "filled", F.hex("said").alias("said"), F.size("keys").alias("n"), F.col("keys")[0].alias("first"), F.col("inner.status").alias("inner_status"), "customer")


@query("SELECT * FROM orders")
def save_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "roundtrip") + ".parquet"
    sink.save(_numbered(spark, sf_dir, "orders"), to, "row_number")
    return scan(spark, to)


@query(f"""SELECT row_number, o_orderkey, CASE WHEN row_number = 2 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM {_ORDERS}""")
def save_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet").filter("o_orderstatus", "f")
    book.edit(2, "o_orderstatus", None)
    book.save_as(scratch(spark, "edited") + ".parquet")
    return book.source.numbered.select("row_number", "o_orderkey", "o_orderstatus")


@query("""SELECT event_id, ts, user_id FROM (SELECT event_id, ts, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
  ORDER BY ts DESC, event_id DESC LIMIT 10""")
def mru_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return most_recent(_table(spark, sf_dir, "events").select("event_id", "ts", "user_id"), "user_id", ["ts", "event_id"])


# Tables of many files, as a large table is one: 40 files of orders, in row order.


def _many_files(spark: SparkSession, sf_dir: str, files: int = 40, name: str = "orders") -> str:
    to = scratch(spark, "many")
    df = _numbered(spark, sf_dir, name)
    sink.save(df.repartitionByRange(files, "row_number"), to, "row_number", layout="directory")
    return to


@query(f"""SELECT row_number, o_orderkey, o_custkey, CASE WHEN row_number = 77 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 1 AS files_written FROM {_ORDERS}""")
def save_one_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edit saved over a folder: the rows, and how many files are newer than the others."""
    to = _many_files(spark, sf_dir)
    changed = scan(spark, to).select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_modification_time").alias("time")).distinct()
    before = {(r.at, r.time) for r in changed.collect()}  # one row a file
    book = Workbook.open(spark, to)
    book.edit(77, "o_orderstatus", "Z")
    book.save()
    after = {(r.at, r.time) for r in scan(spark, to).select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_modification_time").alias("time")).distinct().collect()}
    return book.data().withColumn("files_written", F.lit(len(after - before)))


@query(f"SELECT row_number, CASE WHEN row_number IN (1, 900) THEN 0 ELSE o_totalprice END AS o_totalprice, o_orderkey FROM {_ORDERS}")
def save_folder_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder saved as another one, whose row numbers are the same."""
    book = Workbook.open(spark, _many_files(spark, sf_dir))
    for row in (1, 900):
        book.edit(row, "o_totalprice", 0)
    book.save_as(scratch(spark, "again"), layout="directory")
    return book.data().select("row_number", "o_totalprice", "o_orderkey")


@query(f"SELECT row_number, CASE WHEN row_number = 4 THEN NULL ELSE o_custkey END AS o_custkey, o_orderkey FROM {_ORDERS}")
def save_folder_as_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.open(spark, _many_files(spark, sf_dir))
    book.edit(4, "o_custkey", None)
    book.save_as(scratch(spark, "one") + ".parquet")
    return book.data().select("row_number", "o_custkey", "o_orderkey")


@query("SELECT count(*) AS n_rows, 'Saved ' || format('{:,}', count(*)) || ' rows' AS message, FALSE AS dirty FROM orders")
def save_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file saved over itself: its rows, and what the workbook says of it."""
    to = scratch(spark, "place") + ".parquet"
    sink.save(_numbered(spark, sf_dir, "orders"), to, "row_number", layout="file")
    book = Workbook.open(spark, to)
    book.edit(3, "o_orderstatus", "X")
    book.save()
    return scan(spark, to).agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(book.message).alias("message"), F.lit(book.dirty).alias("dirty"))


@query(f"SELECT * FROM {_ORDERS} WHERE row_number > 700 AND row_number <= 750")
def stored_page_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.open(spark, _many_files(spark, sf_dir)).page(700, 50).view()


@query("SELECT * FROM (SELECT CAST(row_number() OVER () AS BIGINT) AS row_number, * FROM lineitem) ORDER BY l_extendedprice DESC NULLS LAST, row_number LIMIT 40 OFFSET 5500")
def deep_sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_page(_numbered(spark, sf_dir, "lineitem"), "l_extendedprice", False, "row_number", 5500, 40, deep=100)


@query("SELECT * FROM (SELECT CAST(row_number() OVER () AS BIGINT) AS row_number, * FROM lineitem) ORDER BY lower(l_returnflag), row_number LIMIT 40 OFFSET 5500")
def deep_page_of_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorted_page(_numbered(spark, sf_dir, "lineitem"), "l_returnflag", True, "row_number", 5500, 40, deep=100)


@query("""SELECT * FROM (SELECT CAST(row_number() OVER () AS BIGINT) AS row_number, * FROM lineitem) WHERE contains(CAST(l_partkey AS VARCHAR), '12') AND contains(CAST(l_extendedprice AS VARCHAR), '57')""")
def narrowed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a longer text finds among the rows that were held for a shorter one."""
    book = Workbook.open(spark, f"{sf_dir}/lineitem.parquet").filter("l_partkey", "1")
    book.hold()
    book.filter("l_partkey", "12").filter("l_extendedprice", "5")
    book.hold()
    return book.filter("l_extendedprice", "57").view()


@query(f"SELECT {_joined(['row_number', *_ORDER_COLUMNS])} AS line FROM {_ORDERS} WHERE row_number % 3 <> 0 AND row_number <= 1000000")
def copy_many_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three row numbers up to a million, most of which the small tables do not have."""
    rows = np.arange(1, 1_000_001)
    return Workbook.open(spark, _many_files(spark, sf_dir)).copy_rows(rows[rows % 3 != 0]).lines()


@query(f"SELECT row_number, o_orderkey, CASE WHEN row_number = 8 THEN 'Q' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN row_number = 9 THEN NULL ELSE o_totalprice END AS o_totalprice FROM {_ORDERS}")
def edits_after_a_crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that one workbook made and never saved, seen by another."""
    to = scratch(spark, "crash") + ".parquet"
    sink.save(_numbered(spark, sf_dir, "orders"), to, "row_number", layout="file")
    book = Workbook.open(spark, to, journal=True)
    book.edit(8, "o_orderstatus", "P")
    book.edit(8, "o_orderstatus", "Q")
    book.edit(9, "o_totalprice", None)
    return Workbook.open(spark, to, journal=True).data().select("row_number", "o_orderkey", "o_orderstatus", "o_totalprice")


_LARGE = "SELECT l_orderkey, l_linenumber, l_extendedprice * 1000 + 0.25 AS price FROM lineitem"


def _large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1000 + 0.25).alias("price"))


@query(f"SELECT * FROM ({_LARGE}) WHERE contains(CAST(price AS VARCHAR), '1234')")
def search_large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of 10,000,000 and more, by their digits."""
    return matching(_large_numbers(spark, sf_dir), [("price", "1234")])


@query(f"SELECT {_joined(['l_orderkey', 'l_linenumber', 'price'])} AS line FROM ({_LARGE})")
def export_large_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.lines(_large_numbers(spark, sf_dir))


@query("SELECT doc_id, lang FROM documents WHERE contains(strip_accents(lower(text)), 'reau')")
def filter_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching(_table(spark, sf_dir, "documents"), [("text", "RÉÂU")], collation="UNICODE_CI_AI").select("doc_id", "lang")


_FIRST_WORDS = "(SELECT CAST(row_number() OVER () AS BIGINT) AS row_number, lang, coalesce(nullif(regexp_extract(text, '^[A-Za-zÀ-ÿ]+'), ''), 'none') AS word FROM documents)"


@query(f"SELECT * FROM {_FIRST_WORDS} WHERE contains(strip_accents(lower(word)), 'e')")
def search_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ViewState().filter("word", "È").collate("UNICODE_CI_AI").apply(_first_words(spark, sf_dir))


@query(f"SELECT * FROM {_FIRST_WORDS} ORDER BY strip_accents(lower(word)), row_number LIMIT 60 OFFSET 20")
def sort_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of letters alone, so that both orders compare the same letters."""
    return ViewState().collate("UNICODE_CI_AI").toggle_sort("word").page(20, 60).apply(_first_words(spark, sf_dir))


def _first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.regexp_extract("text", "^[A-Za-zÀ-ÿ]+", 0)
    return _numbered(spark, sf_dir, "documents").select("row_number", "lang", F.coalesce(F.nullif(word, F.lit("")), F.lit("none")).alias("word"))


@query(_headed(["#", "o_totalprice", "o_orderkey", "o_orderstatus"], f"SELECT {_joined(['row_number', 'o_totalprice', 'o_orderkey', 'o_orderstatus'])} AS line FROM {_ORDERS} WHERE row_number BETWEEN 11 AND 30"))
def copy_arranged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a view shows them: columns moved and hidden."""
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet").hide("o_custkey", "o_orderdate", "o_orderpriority").move("o_totalprice", 0)
    return book.copy_rows(range(11, 31), headers=True).lines()


@query(f"SELECT row_number, o_totalprice, o_orderkey, o_orderstatus FROM {_ORDERS} WHERE contains(CAST(o_custkey AS VARCHAR), '7')")
def arranged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hidden column is still filtered by."""
    return Workbook.open(spark, f"{sf_dir}/orders.parquet").filter("o_custkey", "7").hide("o_custkey", "o_orderdate", "o_orderpriority").move("o_totalprice", 0).view()


@query("""SELECT * FROM (SELECT c_custkey, c_name || '''s "' AS "a `b` c.d" FROM customer) WHERE contains("a `b` c.d", '1''s "') ORDER BY "a `b` c.d" DESC, c_custkey LIMIT 30""")
def quotes_in_names_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text with quotes in a column whose name has some, filtered and sorted by it."""
    df = _table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("'s \"")).alias("a `b` c.d"))
    return ViewState("c_custkey").filter("a `b` c.d", "1'S \"").toggle_sort("a `b` c.d").toggle_sort("a `b` c.d").page(0, 30).apply(df)


@query(f"SELECT 'o_orderpriority' || chr(13) || chr(10) || o_orderpriority AS cell, chr(13) || chr(10) AS newline FROM {_ORDERS} WHERE row_number = 12")
def copy_one_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = export.cell(_numbered(spark, sf_dir, "orders"), "row_number", 12, "o_orderpriority", header=True, newline="\r\n")
    return local_table(spark, [("cell", pa.string()), ("newline", pa.string())], [(said, "\r\n")])


@query("""SELECT 'Loaded orders.parquet - ' || format('{:,}', count(*)) || ' rows, 6 columns' AS loaded, 'Sorted by o_orderdate (ascending)' AS sorted,
  'Copied 2 columns (' || format('{:,}', count(*) FILTER (contains(lower(o_orderstatus), 'f'))) || ' rows)' AS copied FROM orders""")
def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet")
    said = [book.message]
    said.append(book.toggle_sort("o_orderdate").message)
    book.filter("o_orderstatus", "f").copy_columns(["o_orderkey", "o_custkey"])
    return local_table(spark, [(n, pa.string()) for n in ("loaded", "sorted", "copied")], [(*said, book.message)])


# What a workbook says and refuses, beside the rows it has.


@query(f"SELECT *, 'Filter error: wildcard inside the text: ''a*b''' AS message FROM {_ORDERS} WHERE o_orderkey % 5 >= 0")
def filter_error_shows_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter text that cannot be read shows all rows, and says so."""
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet").filter("o_orderpriority", "a*b").search("5-LOW")
    shown = book.view()
    return shown.withColumn("message", F.lit(book.message))


@query(f"""SELECT * FROM (SELECT 'Filtered by 1 column(s)' AS message, count(*) FILTER (contains(lower(o_orderstatus), 'f')) AS n_rows FROM orders
  UNION ALL SELECT 'Filtered by 1 column(s) + global search', count(*) FILTER (contains(lower(o_orderstatus), 'f') AND ({' OR '.join(f"contains(lower(CAST({c} AS VARCHAR)), '11')" for c in _ORDER_COLUMNS)})) FROM orders
  UNION ALL SELECT 'Filtered by global search', count(*) FILTER ({' OR '.join(f"contains(lower(CAST({c} AS VARCHAR)), '11')" for c in _ORDER_COLUMNS)}) FROM orders UNION ALL SELECT 'Ready', count(*) FROM orders)""")
def filter_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change of filter or search is a new view of the rows, with its own status."""
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet")
    seen = []
    for name, text, search in (("o_orderstatus", "f", ""), ("o_orderstatus", "F", "11"), ("o_orderstatus", "  ", "11"), ("o_orderstatus", "", " ")):
        n = book.filter(name, text).search(search).view().count()
        seen.append((book.message, n))
    return local_table(spark, [("message", pa.string()), ("n_rows", pa.int64())], seen)


@query("""SELECT * FROM (VALUES ('opened', 'mine.parquet', FALSE), ('edited', '*mine.parquet', TRUE), ('saved', 'mine.parquet', FALSE)) AS t(step, title, dirty) WHERE (SELECT count(*) FROM orders) > 0""")
def dirty_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{scratch(spark, 'titles')}-of/mine.parquet"
    sink.save(_numbered(spark, sf_dir, "orders"), to, "row_number", layout="file")
    book = Workbook.open(spark, to)
    said = [("opened", book.title, book.dirty)]
    book.edit(1, "o_orderstatus", book.copy_cell(1, "o_orderstatus"))  # an edit that changes nothing is one
    said.append(("edited", book.title, book.dirty))
    book.save()
    said.append(("saved", book.title, book.dirty))
    return local_table(spark, [("step", pa.string()), ("title", pa.string()), ("dirty", pa.bool_())], said)


@query("""SELECT * FROM (SELECT 'row_number' AS name, 'row numbers are read-only' AS refused UNION ALL SELECT 'nope', 'no column ''nope''' UNION ALL SELECT 'o_custkey', '''x'' is no bigint for ''o_custkey'''
  UNION ALL SELECT 'o_orderstatus', 'no row ' || (count(*) + 1) FROM orders)""")
def refused_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet")
    n, said = book.info().rows, []
    for row, name in ((1, "row_number"), (1, "nope"), (1, "o_custkey"), (n + 1, "o_orderstatus")):
        try:
            book.edit(row, name, "x")
        except EditError as e:
            said.append((name, str(e)))
    return local_table(spark, [("name", pa.string()), ("refused", pa.string())], said if not book.dirty else [])


@query("SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM events) UNION ALL SELECT 'nope', 'unknown'")
def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = Workbook.open(spark, f"{sf_dir}/events.parquet").info()
    return local_table(spark, [("column_name", pa.string()), ("column_type", pa.string())], [(n, info.type_of(n)) for n in [*(c for c, _, _ in info.columns), "nope"]])


@query(f"SELECT CASE WHEN row_number = 6 THEN 'closed' ELSE o_orderpriority END AS o_orderpriority, o_orderkey, 0 AS left_beside FROM {_ORDERS}")
def close_with_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing saves what was edited, and leaves nothing beside the file."""
    folder = scratch(spark, "closed")
    to = f"{folder}/odd [1] {{name}}, it's.parquet"
    sink.save(_numbered(spark, sf_dir, "orders"), to, "row_number", layout="file")
    book = Workbook.open(spark, to)
    book.edit(6, "o_orderpriority", "closed")
    book.close(save=True)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    beside = [s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    return scan(spark, to).select("o_orderpriority", "o_orderkey", F.lit(len(beside) - 1).alias("left_beside"))


@query(f"SELECT * FROM {_ORDERS} WHERE row_number > 10 AND row_number <= 30")
def reset_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort that was taken back shows stored order again."""
    return ViewState().toggle_sort("o_totalprice").reset_sort().page(10, 20).apply(_numbered(spark, sf_dir, "orders"))


@query(f"""SELECT {_joined(['c_name', 'c_acctbal'], "';'")} AS line, 'Copied 6 cells' AS message FROM (SELECT row_number() OVER () AS rn, * FROM customer) WHERE rn IN (3, 4, 77)""")
def copy_cells_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells without headers, by a delimiter of one's own."""
    book = Workbook.open(spark, f"{sf_dir}/customer.parquet")
    out = book.copy_cells([77, 3, 4], ["c_acctbal", "c_name"], delimiter=";").lines()
    return out.withColumn("message", F.lit(book.message))


@query(f"SELECT {_joined(['row_number', *_ORDER_COLUMNS])} AS line, 'Copied 2 rows' AS message FROM {_ORDERS} WHERE row_number IN (9, 21)")
def copy_rows_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without headers; of numbers that no row has, nothing is copied or counted."""
    book = Workbook.open(spark, f"{sf_dir}/orders.parquet")
    out = book.copy_rows([21, 9, 10**12]).lines()
    return out.withColumn("message", F.lit(book.message))


@query("SELECT CAST(coalesce(o_orderstatus, '') AS VARCHAR) AS line FROM orders")
def copy_columns_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Workbook.open(spark, f"{sf_dir}/orders.parquet").copy_columns(["o_orderstatus"]).lines()


@query("""SELECT * FROM (SELECT 0 AS place, 'region.parquet' AS name, count(*) AS n_rows FROM region UNION ALL SELECT 1, 'orders.parquet', count(*) FROM orders UNION ALL SELECT 2, 'nation.parquet', count(*) FROM nation)""")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they were opened, the last one first, each once; one that is gone has left the list."""
    there = lambda p: exists(spark, p)
    recents = Recents(exists=there)
    recents.add(f"{sf_dir}/none.parquet")
    for name in ("orders", "nation", "region", "orders", "region"):
        Workbook.open(spark, f"{sf_dir}/{name}.parquet", recents)
    found = []
    for k in range(len(recents.paths) - 1, -1, -1):
        try:
            path = recents.path_at(k)
        except FileNotFoundError:
            continue
        found.append((k, path.rsplit("/", 1)[1], row_count(scan(spark, path)).first()[0]))
    return local_table(spark, [("place", pa.int32()), ("name", pa.string()), ("n_rows", pa.int64())], found)


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE contains(lower(event_type), 'cl')")
def followed_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view's filter over a folder as a stream, whose rows are written as they come."""
    folder, to = scratch(spark, "grows"), scratch(spark, "followed")
    _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").repartition(3).write.parquet(folder)
    rows = follow(spark, folder, ViewState().filter("event_type", "CL"), files_per_batch=1)
    started = rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start()
    started.awaitTermination()
    return scan(spark, to)
