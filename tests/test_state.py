"""Parts without Spark: wildcard grammar, view states, type names, recent files."""

from __future__ import annotations

import json

import pytest

from gridloom.functions.names import fresh_name, type_class
from gridloom.operators.predicates import FilterError, parse
from gridloom.plans.view import ViewState
from gridloom.sources.parquet import literal_path
from gridloom.sources.recents import Recents


@pytest.mark.parametrize(("text", "wanted"), [("pla", "pla"), ("*pla*", "pla"), ("%%pla", "pla"), ("*", None), ("[%]", "%"), ("a[*]b", "a*b"), ("a_b", "a_b"), ("?", "?"), ("[]]", "]"), ("]", "]"), ("*[*]*", "*")])
def test_grammar(text, wanted):
    assert parse(text) == wanted


@pytest.mark.parametrize("text", ["a*b", "a%b", "[", "a[", "[ab]", "x[a"])
def test_grammar_errors(text):
    with pytest.raises(FilterError):
        parse(text)


def test_sort_toggle_keeps_each_columns_direction():
    s, seen = ViewState(), []
    for name in "aaba":
        s = s.toggle_sort(name)
        seen.append((s.key, s.ascending))
    assert seen == [("a", True), ("a", False), ("b", True), ("a", True)]
    with pytest.raises(ValueError):
        s.toggle_sort("row_number")
    assert s.reset_sort().key is None


def test_status():
    s = ViewState()
    assert s.status() == "Ready"
    assert s.filter("a", "x").status() == "Filtered by 1 column(s)"
    assert s.search("y").status() == "Filtered by global search"
    assert s.filter("a", "x").filter("b", "x").search("y").status() == "Filtered by 2 column(s) + global search"
    assert s.filter("a", "x").filter("a", "  ").search("  ").status() == "Ready"


def test_type_classes():
    # fixed values
    wanted = {
        "INTEGER": "numeric", "BIGINT": "numeric", "DOUBLE": "numeric", "FLOAT": "numeric", "VARCHAR": "text", "DATE": "temporal", "TIMESTAMP": "temporal", "BOOLEAN": "boolean",
        "DECIMAL(18,3)": "other", "INTERVAL": "numeric", "BLOB": "other", "TIME": "other", "UUID": "other", "INTEGER[]": "numeric", "STRUCT(a INTEGER)": "numeric", "MAP(VARCHAR, INTEGER)": "numeric",
    }
    assert {n: type_class(n) for n in wanted} == wanted


def test_names_and_paths():
    assert fresh_name(["a", "ROW_NUMBER", "_row_number"], "row_number") == "__row_number"
    assert literal_path("/x/a[1]*.parquet") == r"/x/a\[1\]\*.parquet"


def test_recents(tmp_path):
    files = [str(tmp_path / f"p{i}") for i in range(12)]
    for f in files:
        open(f, "w").close()
    store = str(tmp_path / "recents.json")
    r = Recents(store)
    for f in files[:11]:
        r.add(f)
    r.add(files[3])
    assert r.paths[0] == files[3] and len(r.paths) == 10 and len(set(r.paths)) == 10 and files[0] not in r.paths
    (tmp_path / "p5").unlink()
    again = Recents(store)
    assert files[5] not in again.paths and again.paths[0] == files[3]
    (tmp_path / "p10").unlink()
    with pytest.raises(FileNotFoundError):
        again.path_at(again.paths.index(files[10]))
    assert files[10] not in again.paths
    again.clear()
    assert json.load(open(store)) == []


@pytest.mark.parametrize("said", ["{not json", '{"a": 1}', "[1, 2]", ""])
def test_recents_survive_bad_settings(tmp_path, said):
    (tmp_path / "r.json").write_text(said)
    assert Recents(str(tmp_path / "r.json")).paths == []
