"""Orphan references and hierarchies on small tables, against what is plainly right."""

from datetime import datetime

import pytest

from corvane.operators.forest import descendants, hierarchy
from corvane.operators.orphans import orphan_references, orphan_report
from corvane.plans import catalogue
from tests.oracle import DATA, differences

T = [datetime(2024, m, 1) for m in range(1, 7)]
REFS = "mb_no bigint, script_guid string, seen_at timestamp_ntz, guid string"
PARENTS = "guid string, added_at timestamp_ntz, removed_at timestamp_ntz, mb_no string"


def orphans(spark, refs, parents):
    made = orphan_references(spark.createDataFrame([(*r, "x") for r in refs], REFS), [spark.createDataFrame([(*p, "x") for p in parents], PARENTS)])
    return made


def test_orphans(spark):
    parents = [("a-1", None, None), ("B2", T[1], T[3]), ("b2", T[4], None), ("b2", T[4], None), (None, None, None), ("c3", T[3], T[2])]
    refs = [
        (1, " A1\n", T[0]), (2, "b2", T[0]), (3, "b2", T[1]), (4, "b2", T[3]), (4, "b2", T[3]), (5, "b2", T[5]), (6, "c3", T[2]),
        (7, None, T[0]), (8, "", T[0]), (9, "0000-00", T[0]), (10, "zz?", T[0]), (11, "a1", None), (12, "b2", None),
    ]
    found = orphans(spark, refs, parents)
    assert sorted((r.mb_no, r.status) for r in found.collect()) == [(2, "late"), (4, "deleted"), (6, "missing"), (10, "missing"), (12, "undated")]
    report = {(r.period, r.status): r.n_refs for r in orphan_report(found, "t").collect()}
    assert report == {("2024-01", "late"): 1, ("2024-04", "deleted"): 1, ("2024-03", "missing"): 1, ("2024-01", "missing"): 1, (None, "undated"): 1}


def test_orphans_hot_key_and_empty_tables(spark):
    refs = [(i, "hot", T[i % 6]) for i in range(600)] + [(1000 + i, f"k{i}", T[0]) for i in range(300)]
    found = {r.mb_no for r in orphans(spark, refs, [("hot", T[2], T[4])]).collect()}
    assert found == {i for i in range(600) if not 2 <= i % 6 < 4} | {1000 + i for i in range(300)}
    assert orphans(spark, [], []).count() == 0
    assert orphans(spark, refs[:5], []).count() == 5


NODES = "asset_path string, file_id string, parent_id string, children_ids array<string>, seen_at timestamp_ntz, depth int"


def test_hierarchy(spark):
    rows = [
        ("a", "1", "0", None, T[0]), ("a", "2", " 1 ", [], T[0]), ("a", "3", None, None, T[0]), ("a", "4", "3", ["5"], T[0]), ("a", "5", "", None, T[0]),
        ("a", "2", "9", None, T[1]), ("a", "1", "0", ["3"], T[2]), ("a", "1", "0", ["3"], T[2]),
        ("b", "x", "y", None, T[0]), ("b", "y", "x", None, T[0]), ("b", "z", "y", None, T[0]), ("b", "w", "w", None, T[0]), (None, "n", None, None, None), ("b", None, "x", None, T[0]),
    ]
    tree = hierarchy(spark.createDataFrame([(*r, 7) for r in rows], NODES))
    found = {(r.asset_path, r.file_id): (r.root_id, r.depth, "/".join(r.path)) for r in tree.collect()}
    assert found == {
        ("a", "1"): ("1", 0, "1"), ("a", "2"): ("2", 0, "2"), ("a", "3"): ("1", 1, "1/3"), ("a", "4"): ("1", 2, "1/3/4"), ("a", "5"): ("1", 3, "1/3/4/5"),
        ("b", "x"): ("", -1, ""), ("b", "y"): ("", -1, ""), ("b", "z"): ("", -1, ""), ("b", "w"): ("", -1, ""), (None, "n"): ("n", 0, "n"),
    }
    below = {(r.file_id, r.descendant_id, r.distance) for r in descendants(tree).collect()}
    assert below == {("1", "3", 1), ("1", "4", 2), ("1", "5", 3), ("3", "4", 1), ("3", "5", 2), ("4", "5", 1)}
    assert hierarchy(spark.createDataFrame([], NODES)).count() == 0


def test_deep_chain(spark):
    rows = [("a", str(i), str(i - 1), None, T[0], 0) for i in range(100, 200)]
    assert {int(r.file_id) - 100: r.depth for r in hierarchy(spark.createDataFrame(rows, NODES), paths=False).collect()} == {i: i for i in range(100)}


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(spark, f"{DATA}/sf0.001", catalogue.queries()[name], catalogue.oracle_sql()[name]) == ""
