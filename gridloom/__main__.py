"""``python -m gridloom PATH``: open a file or folder and show a page of it."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans.workbook import Workbook
from .sources.parquet import exists


def main(said: Sequence[str] | None = None, spark: SparkSession | None = None) -> Workbook:
    """Open the path that is given, if there is something, and print its panel and a page; without one, an empty workbook is returned."""
    known = argparse.ArgumentParser(prog="gridloom", description="Explore a Parquet file or folder.")
    known.add_argument("path", nargs="?", help="file or folder to open; one that is not there is passed over")
    known.add_argument("--filter", action="append", default=[], metavar="COLUMN=TEXT", help="rows whose column holds the text")
    known.add_argument("--search", default="", metavar="TEXT", help="rows in which any column holds the text")
    known.add_argument("--sort", metavar="COLUMN", help="ascending; -COLUMN: descending")
    known.add_argument("--offset", type=int, default=0)
    known.add_argument("--rows", type=int, default=20)
    asked = known.parse_args(said)
    spark = spark or SparkSession.builder.appName("gridloom").getOrCreate()
    if asked.path is None or not exists(spark, asked.path):
        return Workbook(spark)
    book = Workbook.open(spark, asked.path)
    print(book.message)
    for line in book.info().panel():
        print(line)
    for one in asked.filter:
        name, _, text = one.partition("=")
        book.filter(name, text)
    book.search(asked.search)
    if asked.sort:
        down = asked.sort.startswith("-") and asked.sort not in book.columns
        name = asked.sort[1:] if down else asked.sort
        for _ in range(2 if down else 1):
            book.toggle_sort(name)
    book.page(asked.offset, asked.rows).view().show(asked.rows, truncate=40)
    print(book.message)
    return book


if __name__ == "__main__":
    main()
