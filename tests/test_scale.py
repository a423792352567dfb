"""Saves, pages, selections and searches that touch what they show or change, and no more."""

from __future__ import annotations

import datetime
import os
import random
import time
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import gridloom.__main__ as command
from gridloom.operators import journal as journals
from gridloom.operators import ordering, selection, sink
from gridloom.operators.ordering import page, sorted_by, sorted_page
from gridloom.operators.selection import runs, selected
from gridloom.plans.view import ViewState
from gridloom.plans.workbook import Workbook
from gridloom.sources import files as files_of
from gridloom.sources.files import Source
from gridloom.sources.parquet import scan
from pyspark.sql import functions as F


def folder(path, files=10, rows=40, name="f"):
    """``files`` files of ``rows`` rows each, with ids in stored order."""
    os.makedirs(path)
    for k in range(files):
        ids = range(k * rows, (k + 1) * rows)
        pq.write_table(pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array([i * 7 % 13 for i in ids], pa.int64()), "s": [f"n{i}" for i in ids]}), f"{path}/{name}{k:03d}.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored_ids(spark, path):
    """Ids in stored order, by the workbook's own numbers."""
    return [r.id for r in Workbook.open(spark, path).data().orderBy("row_number").collect()]


def times(path):
    return {f: os.stat(f"{path}/{f}").st_mtime_ns for f in os.listdir(path) if f.endswith(".parquet")}


def leftovers(path):
    up = os.path.dirname(path)
    return [f for f in os.listdir(up) if f.startswith(f".{os.path.basename(path)}.") and not f.endswith(".crc")]


def test_a_save_writes_the_files_that_have_edits(spark, tmp_path):
    path = folder(tmp_path / "d", 100, 5)
    before = times(path)
    book = Workbook.open(spark, path)
    book.edit(7, "id", -7)
    book.edit(500, "v", -1)
    chosen = book.source.files.holding(book.log.cells)
    assert [os.path.basename(f.path) for f in chosen] == ["f001.parquet", "f099.parquet"]
    done = plan(sink.edited_rows(book.source, book.log, chosen, spark))
    assert "Exchange hashpartitioning" not in done and "Exchange rangepartitioning" not in done and "Sort" not in done
    assert book.save() == 500
    after = times(path)
    assert {f for f in before if before[f] != after[f]} == {"f001.parquet", "f099.parquet"} and set(after) == set(before)
    want = list(range(500))
    want[6] = -7
    assert stored_ids(spark, path) == want and not leftovers(path)
    assert Workbook.open(spark, path).save() == 500 and times(path) == after  # without edits nothing is written


def test_a_save_that_was_cut_short_is_ended(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "d", 6, 10)
    book = Workbook.open(spark, path)
    for row in (1, 15, 60):
        book.edit(row, "id", -row)
    whole = sink._move

    def cut(session, moves):
        whole(session, list(moves)[:1])
        raise OSError("gone")

    monkeypatch.setattr(sink, "_move", cut)
    with pytest.raises(OSError, match="gone"):
        book.save()
    assert book.dirty and len(leftovers(path)) == 1
    monkeypatch.setattr(sink, "_move", whole)
    want = [-(i + 1) if i + 1 in (1, 15, 60) else i for i in range(60)]
    assert stored_ids(spark, path) == want and not leftovers(path)
    assert sink.recover(spark, path) == 0


def test_a_save_that_moved_nothing_changes_nothing(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "d", 3, 10)
    book = Workbook.open(spark, path)
    book.edit(1, "id", -1)
    monkeypatch.setattr(sink, "_move", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        book.save()
    assert book.dirty and not leftovers(path) and [r.id for r in scan(spark, path).orderBy("id").collect()] == list(range(30))


@pytest.mark.parametrize("layout", ["file", "directory"])
def test_saves_keep_the_order_of_many_files(spark, tmp_path, layout):
    path = folder(tmp_path / "d e%20f[1]", 12, 30, "part of ")
    book = Workbook.open(spark, path)
    book.edit(100, "id", -100)
    to = str(tmp_path / f"to.{layout}")
    assert book.save_as(to, layout=layout) == 360 and os.path.isfile(to) == (layout == "file")
    want = list(range(360))
    want[99] = -100
    assert stored_ids(spark, to) == want and book.path == to and not leftovers(to)


def test_large_files_are_written_in_stretches(spark, tmp_path, monkeypatch):
    """A file of several row groups becomes several files, in its place of the order."""
    path = folder(tmp_path / "d", 3, 10)
    spark.range(1000, 61000, 1, 1).select("id", F.col("id").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("s")).write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "raw"))
    part = next((tmp_path / "raw").glob("part-*.parquet"))
    part.rename(f"{path}/f0015.parquet")
    monkeypatch.setattr(sink, "STRETCH_BYTES", 700_000)
    want = [*range(20), *range(1000, 61000), *range(20, 30)]
    assert stored_ids(spark, path) == want
    book = Workbook.open(spark, path)
    book.edit(21, "id", -1)
    book.edit(60_020, "id", -2)
    before = times(path)
    assert book.save() == 60_030
    want[20], want[60_019] = -1, -2
    assert stored_ids(spark, path) == want and not leftovers(path)
    after = times(path)
    made = [f for f in after if f not in before]
    assert len(made) > 1 and all(f.startswith("f0015.parquet.") for f in made) and all(after[f] == before[f] for f in after if f in before)
    book = Workbook.open(spark, path)
    book.edit(60_020, "id", -3)
    assert book.save_as(str(tmp_path / "whole"), layout="directory") == 60_030
    want[60_019] = -3
    assert stored_ids(spark, str(tmp_path / "whole")) == want


def test_a_row_is_compared_with_few_marks(spark):
    """The part of a row, by halves: of every number of marks, with ties and rows beyond both ends."""
    for n in (1, 2, 3, 7, 8, 127):
        marks = sorted([*range(0, 2 * n, 2)][: n - 1] + [0])
        part = ordering._part_of(F.struct(F.col("id").alias("k"), F.lit(0).alias("t")), [F.struct(F.lit(m).cast("long").alias("k"), F.lit(0).alias("t")) for m in marks])
        got = {r.id: r.part for r in spark.range(-2, 2 * n + 2, 1, 1).select("id", part.alias("part")).collect()}
        assert got == {k: sum(m <= k for m in marks) for k in got}


def test_one_file_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task writes, or sorts, all rows of a file: what the tasks wrote are its row groups, in order."""
    groups = lambda p: pq.ParquetFile(p).num_row_groups
    one = str(tmp_path / "one.parquet")
    assert sink.save(spark.range(0, 6000, 1, 4), one, layout="file") == 6000
    assert groups(one) == 4 and stored_ids(spark, one) == list(range(6000))
    monkeypatch.setattr(sink, "STRETCH_BYTES", 8_000)
    book = Workbook.open(spark, one)
    book.edit(4501, "id", -1)
    assert book.save() == 6000
    want = list(range(6000))
    want[4500] = -1
    assert os.path.isfile(one) and groups(one) > 1 and stored_ids(spark, one) == want and not leftovers(one)
    path, to = folder(tmp_path / "d", 12, 30), str(tmp_path / "to.parquet")
    for most in (1000, 3):  # by stretches, and by a sort
        monkeypatch.setattr(sink, "MOST_STRETCHES", most)
        book = Workbook.open(spark, path)
        book.edit(100, "id", -100)
        assert book.save_as(to, layout="file") == 360 and (groups(to) == 12 or most == 3)
        assert stored_ids(spark, to) == [*range(99), -100, *range(100, 360)] and not leftovers(to)


def test_too_large_files_are_refused(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "d", 2, 10)
    one = str(tmp_path / "one.parquet")
    book = Workbook.open(spark, path)
    book.save_as(one, layout="file")
    monkeypatch.setattr(sink, "MOST_FILE_BYTES", 10)
    book.edit(1, "id", 5)
    with pytest.raises(sink.SaveError, match="one file"):
        book.save()
    with pytest.raises(sink.SaveError, match="directory"):
        book.save_as(str(tmp_path / "two.parquet"), layout="file")
    assert stored_ids(spark, one) == list(range(20)) and not leftovers(one)


def test_seconds_touch_all_files_with_timestamps(spark, tmp_path):
    times_ = [datetime.datetime(2024, 1, 1, 0, 0, 0, k) for k in (1, 2, 3, 4)]
    spark.createDataFrame([(t,) for t in times_], "t timestamp_ntz").repartitionByRange(2, "t").write.parquet(str(tmp_path / "t"))
    book = Workbook.open(spark, str(tmp_path / "t"))
    assert book.save(timestamp_precision="second") == 4
    assert {r.t for r in scan(spark, str(tmp_path / "t")).collect()} == {datetime.datetime(2024, 1, 1)}
    with pytest.raises(ValueError):
        book.save(timestamp_precision="minute")


def test_folders_that_name_columns_survive(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(30).select("id", (F.col("id") % 3).cast("int").alias("k")).write.partitionBy("k").parquet(path)
    book = Workbook.open(spark, path)
    rows = [tuple(r) for r in book.data().orderBy("row_number").collect()]
    assert [tuple(r) for r in book.page(4, 3).view().collect()] == rows[4:7]
    assert [r.k for r in book.view().collect()] == [r[2] for r in rows[4:7]]


def test_sessions_of_others_keep_their_settings(spark, tmp_path):
    path = folder(tmp_path / "d", 2, 5)
    before = dict(spark.conf.getAll)
    book = Workbook.open(spark, path)
    book.edit(1, "id", 9)
    book.save()
    assert dict(spark.conf.getAll) == before


def test_pages_in_stored_order_read_their_files_alone(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "d", 20, 50)
    book = Workbook.open(spark, path)
    shown = book.page(495, 10).view()
    assert len(shown.inputFiles()) == 2
    assert [r.id for r in shown.collect()] == list(range(495, 505))
    assert "rangepartitioning" not in plan(shown) and [r.id for r in book.page(998, 10).view().collect()] == [998, 999]
    assert book.page(5000, 10).view().collect() == [] and book.page(0, 0).view().collect() == []
    monkeypatch.setattr(files_of, "PAGE_BYTES", 0)
    assert [r.id for r in book.page(495, 10).view().collect()] == list(range(495, 505))


def test_pages_of_large_files_read_their_splits_alone(spark, tmp_path, monkeypatch):
    spark.range(0, 60000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("s")).write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "raw"))
    monkeypatch.setattr(files_of, "PAGE_BYTES", 0)
    asked = []
    run = type(spark.sparkContext).runJob
    monkeypatch.setattr(type(spark.sparkContext), "runJob", lambda self, rdd, f, partitions=None, *a: asked.append((partitions, rdd.getNumPartitions())) or run(self, rdd, f, partitions, *a))
    part = next((tmp_path / "raw").glob("part-*.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400000")
    try:
        source = Source(spark, str(part))
        got = source.some_rows(30_001, 30_050)
        assert [r.id for r in got.orderBy("row_number").collect()] == list(range(30_000, 30_050))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (splits, all_splits), = asked
    assert len(splits) < all_splits and all_splits > 4


def test_numbers_of_many_files_move_no_rows(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "d", 30, 4)
    df = Source(spark, path).numbered
    assert "Exchange hashpartitioning" not in plan(df) and "BroadcastExchange" in plan(df)
    assert sorted((r.row_number, r.id) for r in df.collect()) == [(i + 1, i) for i in range(120)]
    monkeypatch.setattr(files_of, "BROADCAST_BYTES", 0)
    assert sorted((r.row_number, r.id) for r in Source(spark, path).numbered.collect()) == [(i + 1, i) for i in range(120)]


KEYS = {
    "i": ("int", [3, None, -5, 3, 0]),
    "d": ("double", [1.5, float("nan"), None, float("-inf"), 0.0, 1e300]),
    "s": ("string", ["b", "B", None, "", "é", "z'\"", "a"]),
    "m": ("decimal(20,3)", [Decimal("1.250"), None, Decimal("-99999999999999999.999")]),
    "b": ("boolean", [True, False, None]),
    "t": ("timestamp_ntz", [datetime.datetime(2024, 3, 31, 2, 30), None, datetime.datetime(1, 1, 1), datetime.datetime(2024, 10, 27, 2, 30, 0, 5)]),
    "z": ("timestamp", [datetime.datetime(2024, 3, 31, 1, 30), None, datetime.datetime(1900, 1, 1)]),
    "e": ("date", [datetime.date(2024, 2, 29), None, datetime.date(9999, 12, 31)]),
    "y": ("binary", [b"\x00\xff", b"", None]),
}


@pytest.mark.parametrize("name", list(KEYS))
def test_deep_pages_are_the_sorted_ones(spark, name, monkeypatch):
    monkeypatch.setattr(ordering, "DRAWN", 64)
    monkeypatch.setattr(ordering, "PARTS", 8)
    rng = random.Random(name)
    kind, values = KEYS[name]
    df = spark.createDataFrame([(k, rng.choice(values)) for k in rng.sample(range(5000), 900)], f"row_number long, {name} {kind}").repartition(3)
    for up in (True, False):
        whole = [r.row_number for r in sorted_by(df, name, up, "row_number").collect()]
        for at in (7, 450, 890, 950):
            got = sorted_page(df, name, up, "row_number", at, 25, deep=10)
            assert [r.row_number for r in got.collect()] == whole[at : at + 25]
    assert sorted_page(df.where("row_number < 0"), name, True, "row_number", 50, 5, deep=1).collect() == []


def test_a_deep_page_keeps_few_rows(spark):
    """What is skipped last is below the bound, whatever the offset."""
    df = spark.range(200_000).select(F.col("id").alias("row_number"), (F.col("id") * 7919 % 100_003).alias("v"))
    part, skip = ordering._from_part(df, F.col("v"), True, "row_number", 150_000, 5000)
    assert skip <= 5000
    got = sorted_page(df, "v", True, "row_number", 150_000, 10, deep=5000).collect()
    assert got == page(sorted_by(df, "v", True, "row_number"), 150_000, 10).collect()


def test_runs():
    assert runs([5, 3, 4, 9, 9, 1]).tolist() == [[1, 1], [3, 5], [9, 9]] and runs([]).tolist() == [] and runs(range(3, 3)).tolist() == [] and runs(range(2, 9)).tolist() == [[2, 8]]


def test_selections(spark):
    df = spark.range(1, 20_001).withColumnRenamed("id", "row_number").withColumn("_span", F.lit(1))
    rng = np.random.default_rng(2)
    some = rng.choice(30_000, 5000, replace=False)
    for few in (0, 16, 1 << 20):
        if few < 1 << 20:
            assert sorted(r.row_number for r in selected(df, "row_number", some, few).collect()) == sorted(int(k) for k in some if 1 <= k <= 20_000)
    assert selected(df, "row_number", []).count() == 0 and selected(df, "row_number", range(4000, 9001), 0).count() == 5001
    assert selected(df, "row_number", [3, 9, 10]).columns == ["row_number", "_span"]


def test_a_million_selected_rows_are_planned_at_once(spark, monkeypatch):
    df = spark.range(1, 3000).withColumnRenamed("id", "row_number")
    selected(df, "row_number", range(0, 100, 2)).count()
    for step in (2, 64):  # many rows a word, and one
        rows = np.arange(0, 1_000_000 * step, step)
        began = time.time()
        out = selected(df, "row_number", rows)
        out._jdf.queryExecution().optimizedPlan()
        assert time.time() - began < 1.5 and out.count() == 2999 // step
    monkeypatch.setattr(selection, "BROADCAST_BYTES", 0)
    assert selected(df, "row_number", rows).count() == 2999 // 64
    assert selected(df, "row_number", np.concatenate([rows, np.arange(5, 1_000_000)])).count() == 2995


def test_selections_read_the_files_that_hold_them(spark, tmp_path):
    path = folder(tmp_path / "d", 20, 10)
    book = Workbook.open(spark, path)
    out = book.copy_rows([3, 195, 999], headers=False)
    assert len([f for f in out.body.inputFiles() if "/d/" in f]) == 2
    assert out.text() == "3\t2\t1\tn2\n195\t194\t6\tn194\n" and book.message == "Copied 2 rows"


def test_held_searches(spark, tmp_path):
    path = folder(tmp_path / "d", 20, 100)
    book, plain = Workbook.open(spark, path), Workbook.open(spark, path)
    assert book.search("n77").hold() == 11 and book.message == "11 rows found"  # 77, 770 to 779
    shown = book.search("n777").view()
    assert len([f for f in shown.inputFiles() if "/d/" in f]) == 2
    assert shown.collect() == plain.search("n777").view().collect() and shown.count() == 1
    assert book.filter("v", "1").search("N77").view().count() == plain.filter("v", "1").search("n77").view().count()
    assert book.filter("v", "").hold() == 11 and book.search("n779").hold() == 1
    assert book.search("n7").view().count() == plain.filter("v", "").search("n7").view().count() == 111  # a shorter text starts anew
    book.search("n779").edit(5, "s", "n7790")
    assert book.view().count() == 2
    assert book.search("none of them").hold() == 0 and book.search("none of them at all").view().count() == 0


@pytest.mark.parametrize(
    ("new", "old", "yes"),
    [
        (("abc", {}), ("b", {}), True), (("b", {}), ("abc", {}), False), (("ABC", {}), ("bc", {}), True), (("", {}), ("", {}), True), (("x", {}), ("", {}), True), (("", {}), ("x", {}), False),
        (("", {"a": "xy"}), ("", {"a": "x"}), True), (("", {"a": "x"}), ("", {"b": "x"}), False), (("", {"a": "*xy"}), ("", {"a": "*"}), True), (("", {"a": "*"}), ("", {"a": "x"}), False), (("", {"a": "x*y"}), ("", {"a": "x"}), False),
    ],
)
def test_when_a_view_narrows_another(new, old, yes):
    made = [ViewState(filters=tuple(f.items()), text=t) for t, f in (new, old)]
    assert made[0].narrows(made[1]) is yes
    assert not made[0].collate("UNICODE_CI").narrows(made[1])


def test_journals(spark, tmp_path, monkeypatch):
    path = folder(tmp_path / "d", 3, 10)
    monkeypatch.setattr(journals, "COMPACT", 4)
    book = Workbook.open(spark, path, journal=True)
    for k in range(11):
        book.edit(1 + k % 5, "v", k)
    book.edit(2, "s", None)
    assert len(os.listdir(tmp_path / ".d.edits")) <= 12
    again = Workbook.open(spark, path, journal=True)
    assert again.dirty and again.log.cells == book.log.cells and again.data().collect() == book.data().collect()
    assert not Workbook.open(spark, path).dirty  # without a journal none is read
    again.save()
    assert not leftovers(path) and not Workbook.open(spark, path, journal=True).dirty
    book = Workbook.open(spark, path, journal=True)
    book.edit(30, "id", 1)
    book.close(save=False)
    assert not leftovers(path)
    book = Workbook.open(spark, path, journal=True)
    book.edit(30, "id", 1)
    spark.range(30, 31, 1, 1).select("id", F.col("id").alias("v"), F.lit("x").alias("s")).write.mode("append").parquet(path)
    with pytest.raises(journals.JournalError):
        Workbook.open(spark, path, journal=True)


def test_collations(spark):
    df = spark.createDataFrame([(1, "Élan"), (2, "elan"), (3, "ÉLAN"), (4, "ｅlan"), (5, "zeta"), (6, None), (7, "eLB")], "row_number int, s string")
    found = lambda text, c: [r[0] for r in ViewState().filter("s", text).collate(c).apply(df).orderBy("row_number").collect()]
    assert found("elan", None) == [2] and found("ELAN", "UNICODE_CI") == [2, 4] and found("ÉLAN", "UNICODE_CI_AI") == [1, 2, 3, 4]
    order = [r[0] for r in ViewState().collate("UNICODE_CI_AI").toggle_sort("s").apply(df).collect()]
    assert order == [6, 1, 2, 3, 4, 7, 5]
    down = [r[0] for r in ViewState().collate("UNICODE_CI_AI").toggle_sort("s").toggle_sort("s").page(1, 3).apply(df).collect()]
    assert down == [7, 1, 2]


def test_columns_on_show(spark, tmp_path):
    path = folder(tmp_path / "d", 1, 5)
    book = Workbook.open(spark, path).hide("v").move("s", 0)
    assert book.view().columns == ["row_number", "s", "id"] and book.search("n3").view().collect()[0].asDict() == {"row_number": 4, "s": "n3", "id": 3}
    book.search("")
    assert book.copy_rows([2]).text() == "2\tn1\t1\n" and book.copy_rows([2], visible=["v"]).text() == "2\t7\n"
    assert book.copy_cells([2], ["id", "v", "s"]).text() == "n1\t1\t7\n" and book.copy_columns(["id", "s"]).header is None
    assert book.message == "Copied 2 columns (5 rows)" and book.show().view().columns == ["row_number", "s", "id", "v"] and book.hide("row_number").view().columns[0] == "row_number"
    with pytest.raises(ValueError):
        book.move("nope", 0)


def test_command_line(spark, tmp_path, capsys):
    path = folder(tmp_path / "d", 2, 10)
    book = command.main([path, "--filter", "s=n1", "--sort=-id", "--rows", "3"], spark)
    said = capsys.readouterr().out
    assert said.startswith("Loaded d - 20 rows, 3 columns") and "[numeric] id (BIGINT)" in said and "Filtered by 1 column(s)" in said
    assert [r.id for r in book.view().collect()] == [19, 18, 17]
    assert command.main([str(tmp_path / "none")], spark).path is None and command.main([], spark).message == "Ready"
