"""Operators and the workbook on small inline tables."""

from __future__ import annotations

import datetime
import math
import os
import random
from decimal import Decimal

import pytest

from gridloom.functions.names import describe
from gridloom.functions.text import whole_seconds
from gridloom.operators import export, sink
from gridloom.operators.edits import EditError, EditLog, overlay
from gridloom.operators.ordering import page, sorted_by
from gridloom.operators.predicates import matching
from gridloom.plans.view import ViewState
from gridloom.plans.workbook import UnsavedError, Workbook
from gridloom.sources.files import numbered
from gridloom.sources.parquet import row_count, scan
from gridloom.sources.recents import Recents, most_recent
from gridloom.streaming.follow import follow
from pyspark.sql import functions as F


def stored(df, path, files=1):
    df.coalesce(files).write.parquet(str(path)) if files > 1 else sink.save(df, str(path), layout="file")
    return str(path)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "B", -1.0)], "id int, s string, d double")


def ids(df):
    return [r[0] for r in df.collect()]


def test_null_filters(nulls):
    assert ids(matching(nulls, [("s", "b")])) == [3]
    assert ids(matching(nulls, search="2")) == [2]
    assert ids(matching(nulls, [("s", "*")])) == [1, 3]
    assert ids(matching(nulls, [("s", "  ")])) == [1, 2, 3]
    assert ids(matching(nulls, [("s", " a ")], "1.5")) == [1]


def test_null_order(nulls):
    assert ids(sorted_by(nulls, "d", True, "id")) == [2, 3, 1]
    assert ids(sorted_by(nulls, "d", False, "id")) == [1, 3, 2]


def test_case_and_ties(spark):
    df = spark.createDataFrame([(1, "apple"), (2, "Apple"), (3, "APPLE"), (4, "banana")], "id int, s string")
    assert ids(matching(df, [("s", "APP")])) == [1, 2, 3]
    assert ids(sorted_by(df, "s", True, "id")) == [1, 2, 3, 4]
    assert ids(page(sorted_by(df, "s", False, "id"), 1, 2)) == [1, 2]
    with pytest.raises(ValueError):
        page(df, -1)


def test_wildcards_and_quotes(spark):
    df = spark.createDataFrame([(1, "100%"), (2, "a*b"), (3, "a_b"), (4, "[x]"), (5, "it's"), (6, None)], "id int, s string")
    assert ids(matching(df, [("s", "[%]")])) == [1]
    assert ids(matching(df, [("s", "a_b")])) == [3]
    assert ids(matching(df, [("s", "[[]x")])) == [4]
    assert ids(matching(df, [("s", "it's")])) == [5]
    assert ids(matching(df, [("s", "a*b")], literal=True)) == [2]


def test_csv_quoting(spark):
    rows = [("it's", 'x"y'), ("a,b", "l1\nl2"), ("t\tt", None), ("''", ""), ("cr\r", "z")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r.line for r in export.lines(df, delimiter=",").collect()] == ["it's,\"x\"\"y\"", '"a,b","l1\nl2"', "t\tt,", "'',", "cr\r,z"]
    assert [r.line for r in export.lines(df).collect()] == ["it's\tx\"y", "a,b\tl1\nl2", "t\tt\t", "''\t", "cr\r\tz"]


def test_number_text(spark):
    values = [5.0, 1e7, 1e-4, -0.0, 12345678.9, -98765432.125, 1.5e-9, 2.5e300, 1e22, -7e-5, 123456789012345.67, 0.001, 1e6, 9999999.0]
    df = spark.createDataFrame([(v,) for v in values], "d double")
    lines = [r.line for r in export.lines(df).collect()]
    assert lines[:5] == ["5.0", "10000000.0", "0.0001", "-0.0", "12345678.9"]
    assert [float(t) for t in lines] == values and not any("E" in t or "e" in t for t in lines)
    assert all(Decimal(t) == Decimal(repr(v)) for t, v in zip(lines, values, strict=True))
    odd = spark.createDataFrame([(math.nan, "1E5"), (math.inf, None), (-math.inf, "")], "d double, s string")
    assert [r.line for r in export.lines(odd).collect()] == ["NaN\t1E5", "Infinity\t", "-Infinity\t"]
    assert export.lines(spark.createDataFrame([(2.0**27,)], "f float")).first().line == "134217728.0"
    assert ids(matching(df, [("d", "12345678")])) == [12345678.9, 123456789012345.67]


def test_odd_names(spark, tmp_path):
    names = ["a b", "a.b", "a]b", "[c]", "a`b", "select"]
    df = spark.createDataFrame([tuple(f"{n}{i}" for n in names) for i in (2, 1)], names)
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "odd[1] it's.parquet")
    pq.write_table(pa.table({n: [f"{n}2", f"{n}1"] for n in names}), path)
    book = Workbook.open(spark, path)
    for n in names:
        book.state = ViewState(book.row_number).filter(n, "1").toggle_sort(n)
        assert book.view().count() == 1
    book.edit(1, "a`b", "new")
    book.state = ViewState(book.row_number)
    assert book.copy_columns(names, headers=True).text().splitlines()[0] == "\t".join(names)
    assert book.save() == 2 and book.copy_cell(1, "a`b") == "new" and not book.dirty
    assert df.count() == 2


def test_reserved_name_survives(spark, tmp_path):
    path = stored(spark.createDataFrame([(99, "x")], "ROW_NUMBER int, v string"), tmp_path / "r.parquet")
    book = Workbook.open(spark, path)
    assert book.row_number == "_row_number" and book.view().first().asDict() == {"_row_number": 1, "ROW_NUMBER": 99, "v": "x"}
    book.edit(1, "ROW_NUMBER", 7)
    book.save()
    assert scan(spark, path).first().ROW_NUMBER == 7


def test_row_numbers_over_files(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, k * 100 + 100 - k, 1, 1).write.parquet(str(tmp_path / "raw" / str(k)))
        part = next((tmp_path / "raw" / str(k)).glob("part-*.parquet"))
        os.makedirs(tmp_path / "many", exist_ok=True)
        part.rename(tmp_path / "many" / f"f{k}.parquet")
    df, name = numbered(spark, str(tmp_path / "many"))
    rows = sorted((r[name], r["id"]) for r in df.collect())
    assert [n for n, _ in rows] == list(range(1, 298)) and [i for _, i in rows] == [k * 100 + j for k in range(3) for j in range(100 - k)]
    assert row_count(scan(spark, str(tmp_path / "many"))).first()[0] == 297


def test_filters_keep_row_numbers(spark, tmp_path):
    path = stored(spark.range(50).select("id", (F.col("id") * 7 % 13).alias("v")), tmp_path / "n.parquet")
    base = {r.row_number: r.id for r in Workbook.open(spark, path).view().collect()}
    rng = random.Random(3)
    for _ in range(5):
        a, b = str(rng.randint(0, 9)), str(rng.randint(0, 12))
        one = Workbook.open(spark, path).filter("id", a).filter("v", b).toggle_sort("v").view().collect()
        two = Workbook.open(spark, path).filter("v", b).filter("id", a).toggle_sort("v").view().collect()
        assert one == two and all(base[r.row_number] == r.id for r in one)
        again = matching(spark.createDataFrame(one, "row_number long, id long, v long"), [("id", a), ("v", b)])
        assert again.count() == len(one)


def test_edits(spark, tmp_path):
    path = stored(spark.createDataFrame([(1, "x", None), (2, "y", [1])], "id int, s string, a array<int>"), tmp_path / "e.parquet")
    df, name = numbered(spark, path)
    log = EditLog(df.schema, name)
    for row, col, value, error in ((1, "id", "zz", True), (1, "id", 2**31, True), (1, "id", "1_0", True), (1, "id", "", True), (1, "id", " 4 ", False), (1, name, 3, True), (1, "nope", 3, True), (0, "id", 3, True), (2, "a", "[2]", True), (1, "id", 5, False), (1, "id", 6, False), (2, "s", None, False), (2, "a", None, False)):
        if error:
            with pytest.raises(EditError):
                log.record(spark, row, col, value)
        else:
            log.record(spark, row, col, value)
    assert len(log) == 3 and log.unsaved
    out = overlay(df, log)
    assert [tuple(r) for r in out.orderBy(name).collect()] == [(1, 6, "x", None), (2, 2, None, None)] and out.schema == df.schema
    assert overlay(df, EditLog(df.schema, name)) is df


def test_types_survive_saving(spark, tmp_path):
    schema = "s string, i int, l long, d double, f float, m decimal(18,6), b boolean, t timestamp_ntz, y binary, z timestamp, w tinyint, h smallint, e date, v interval day to second, a array<int>, r struct<a:int>, p map<string,int>"
    now = datetime.datetime(2024, 1, 2, 3, 4, 5, 600000)
    row = ("a'b", -5, 2**62, 0.1, 1.5, Decimal("1.234567"), True, now, b"\0\xff", now, 1, 2, now.date(), datetime.timedelta(days=3), [1, None], (4,), {"k": 1})
    ext = ("", -(2**31), -(2**63), math.inf, -math.inf, Decimal("-999999999999.999999"), False, datetime.datetime(1, 1, 1), b"", now, -128, -32768, datetime.date(9999, 12, 31), datetime.timedelta(0), [], (None,), {})
    df = spark.createDataFrame([row, tuple([None] * len(row)), ext], schema).coalesce(1)
    path = str(tmp_path / "t.parquet")
    sink.save(df, path)
    back = scan(spark, path)
    assert back.dtypes == df.dtypes and back.collect() == df.collect() and os.path.isfile(path)
    sink.save(spark.createDataFrame([(math.nan,)], "d double"), str(tmp_path / "nan.parquet"))
    assert math.isnan(scan(spark, str(tmp_path / "nan.parquet")).first().d)
    sink.save(df, path, timestamp_precision="second")
    cut = scan(spark, path)
    assert cut.dtypes == df.dtypes and cut.first().t == now.replace(microsecond=0) and cut.first().z == now.replace(microsecond=0)
    assert cut.select(whole_seconds(F.col("t"))).schema[0].dataType.simpleString() == "timestamp_ntz"
    assert [r[1] for r in describe(df).collect()][:9] == ["VARCHAR", "INTEGER", "BIGINT", "DOUBLE", "FLOAT", "DECIMAL(18,6)", "BOOLEAN", "TIMESTAMP", "BLOB"]


def test_save_in_place_keeps_order_and_ignores_the_view(spark, tmp_path):
    path = stored(spark.range(2000).select((F.col("id") * 37 % 2000).alias("v")), tmp_path / "o.parquet")
    before = ids(scan(spark, path))
    book = Workbook.open(spark, path).filter("v", "1").toggle_sort("v")
    book.edit(5, "v", 4242)
    assert book.title == "*o.parquet" and book.save() == 2000 and book.title == "o.parquet"
    before[4] = 4242
    assert ids(scan(spark, path)) == before and book.state.filters == (("v", "1"),)
    assert sorted(os.listdir(tmp_path)) == [".o.parquet.crc", "o.parquet"] or sorted(os.listdir(tmp_path)) == ["o.parquet"]


def test_failed_save_changes_nothing(spark, tmp_path, monkeypatch):
    path = stored(spark.range(10), tmp_path / "f.parquet")
    book = Workbook.open(spark, path)
    book.edit(1, "id", 77)
    monkeypatch.setattr(sink, "_replace_file", lambda *a: (_ for _ in ()).throw(RuntimeError("disk")))
    with pytest.raises(RuntimeError, match="disk"):
        book.save()
    with pytest.raises(RuntimeError, match="disk"):
        book.save_as(str(tmp_path / "g.parquet"))
    assert book.dirty and book.path == path and ids(scan(spark, path)) == list(range(10)) and not [f for f in os.listdir(tmp_path) if ".parquet." in f and not f.endswith(".crc")]


def test_directories_are_replaced_as_such(spark, tmp_path):
    spark.range(0, 100, 1, 4).write.parquet(str(tmp_path / "d"))
    book = Workbook.open(spark, str(tmp_path / "d"))
    book.edit(100, "id", -1)
    assert book.save() == 100 and os.path.isdir(tmp_path / "d")
    assert [r.id for r in book.data().orderBy("row_number").collect()] == [*range(99), -1]
    assert book.save_as(str(tmp_path / "e"), layout="directory") == 100 and os.path.isdir(tmp_path / "e")


def test_workbook_states(spark, tmp_path):
    a, b = stored(spark.range(3), tmp_path / "a.parquet"), stored(spark.range(4), tmp_path / "b.parquet")
    recents = Recents(str(tmp_path / "recents.json"))
    book = Workbook.open(spark, a, recents)
    book.filter("id", "1*1")
    assert book.view().count() == 3 and book.message.startswith("Filter error")
    book.filter("id", "1")
    assert book.view().count() == 1 and book.message == "Filtered by 1 column(s)" and book.info().rows == 3
    book.edit(1, "id", 9)
    with pytest.raises(UnsavedError):
        book.load(b)
    with pytest.raises(UnsavedError):
        book.close()
    with pytest.raises(FileNotFoundError):
        book.load(str(tmp_path / "none.parquet"), discard=True)
    assert book.path == a and book.dirty
    book.load(b, discard=True)
    assert recents.paths == [b, a] and book.state.filters == () and book.view().count() == 4
    book.load_recent(1)
    assert book.path == a and book.copy_cell(2, "id", header=True) == "id\n1"
    assert book.copy_rows([3, 1], headers=True).text() == "#\tid\n1\t0\n3\t2\n"
    assert book.message == "Copied 2 rows" and book.info().panel() == ["a.parquet", "3 rows", "1 columns", "[numeric] id (BIGINT)"] and book.info().type_of("x") == "unknown"
    with pytest.raises(LookupError):
        book.copy_cell(50, "id")
    book.edit(1, "id", 9)
    book.close(save=True)
    assert ids(scan(spark, a)) == [9, 1, 2] and not book.dirty
    assert book.message == "Saved 3 rows"


def test_empty_table(spark, tmp_path):
    path = stored(spark.createDataFrame([], "id int, s string"), tmp_path / "z.parquet")
    book = Workbook.open(spark, path)
    assert book.info().rows == 0 and book.search("x").toggle_sort("s").view().count() == 0
    assert book.save() == 0 and scan(spark, path).dtypes == [("id", "int"), ("s", "string")]


def test_inverse_edit_is_no_change(spark, tmp_path):
    path = stored(spark.createDataFrame([(i, f"v{i}") for i in range(5)], "id int, s string"), tmp_path / "i.parquet")
    book = Workbook.open(spark, path)
    before = book.data().collect()
    book.edit(2, "s", "other")
    book.edit(2, "s", "v1")
    assert book.data().orderBy("row_number").collect() == before


def test_written_export(spark, tmp_path):
    df = spark.createDataFrame([(i, f"x,{i}") for i in range(20)], "id int, s string")
    out = export.cells(df.withColumn("n", F.col("id")), "n", range(3), ["s", "id", "s"], ",", True, "\r\n")
    assert out.text() == 's,id\r\n"x,0",0\r\n"x,1",1\r\n"x,2",2\r\n'
    out.write(str(tmp_path / "w"))
    assert (tmp_path / "w" / "header.txt").read_bytes() == b"s,id\r\n"
    assert sorted(b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*")).split(b"\r\n")) == [b"", b'"x,0",0', b'"x,1",1', b'"x,2",2']


def test_most_recent(spark):
    df = spark.createDataFrame([(i, i % 12, "p") for i in range(40)], "t int, path int, x string")
    assert [(r.t, r.path) for r in most_recent(df, "path", ["t"]).collect()] == [(t, t % 12) for t in range(39, 29, -1)]


def test_follow(spark, tmp_path):
    folder = str(tmp_path / "s")
    spark.range(0, 20, 1, 1).write.parquet(folder)
    rows = follow(spark, folder, ViewState().filter("id", "1"), 1)
    q = rows.writeStream.format("memory").queryName("followed").outputMode("append").start()
    q.processAllAvailable()
    spark.range(100, 120, 1, 1).write.mode("append").parquet(folder)
    q.processAllAvailable()
    q.stop()
    assert sorted(ids(spark.table("followed"))) == [i for i in [*range(20), *range(100, 120)] if "1" in str(i)]
    with pytest.raises(ValueError):
        follow(spark, folder, ViewState().toggle_sort("id"))


def test_edits_beyond_the_last_row_are_refused(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "five.parquet"))
    book = Workbook.open(spark, str(tmp_path / "five.parquet"))
    for row in (0, 6, 999):
        with pytest.raises(EditError):
            book.edit(row, "id", 1)
    assert not book.dirty
    book.copy_rows([1, 999])
    assert book.message == "Copied 1 rows"
    assert [r.id for r in book.page(2, 2).view().collect()] == [2, 3] and [r.id for r in book.page(4, 9).view().collect()] == [4]


def test_long_copies_are_refused_and_written(spark, tmp_path):
    out = export.columns(spark.range(100), ["id"], headers=True)
    with pytest.raises(ValueError, match="write"):
        out.text(most=50)
    assert out.lines().count() == 101 and out.text().startswith("id\n0\n")
