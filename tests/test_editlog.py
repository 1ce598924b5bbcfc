"""The edit log against lists in memory."""

import random

import pytest

from facetflow.operators import edits
from facetflow.operators.editlog import EditLog


def _table(spark, n):
    return spark.range(n).selectExpr("id AS row_idx", "concat('n', id) AS name", "CAST(id * 2 AS DOUBLE) AS `a.b`", "CASE WHEN id % 3 = 0 THEN id END AS start")


def _rows(log):
    found = [tuple(r) for r in log.table.collect()]
    assert sorted(r[0] for r in found) == list(range(len(found)))
    return [r[1:] for r in sorted(found, key=lambda r: r[0])]


def _depth(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


def test_random_edits_match_lists(spark):
    pick = random.Random(5)
    log = EditLog(_table(spark, 40), most=200)
    now = [(f"n{i}", i * 2.0, i if i % 3 == 0 else None) for i in range(40)]
    states = [now]
    for step in range(100):
        now, what = list(now), pick.choice(["set", "set", "insert", "delete", "twice", "named"])
        at = pick.randrange(len(now))
        if what == "set":
            log.set_cell(at, "a.b", None if step % 7 == 0 else step)
            now[at] = (now[at][0], None if step % 7 == 0 else float(step), now[at][2])
        elif what == "insert":
            at = pick.choice([0, at, len(now)])
            log.insert_row(at, name=f"s{step}")
            now.insert(at, (f"s{step}", None, None))
        elif what == "delete":
            gone = {at, pick.randrange(len(now))}
            log.delete_rows(list(gone))
            now = [r for i, r in enumerate(now) if i not in gone]
        else:
            log.duplicate_rows([at], "name" if what == "named" else None)
            r = now[at]
            now.insert(at + 1, (r[0] + "_copy", *r[1:]) if what == "named" else r)
        states.append(now)
        if step % 25 == 24:
            assert _rows(log) == now
    deep = _depth(log.table)
    for _ in range(60):
        log.undo()
    assert _rows(log) == states[40]
    for _ in range(30):
        log.redo()
    assert _rows(log) == states[70]
    assert abs(_depth(log.table) - deep) <= 2
    log.set_cell(0, "name", "other")
    assert log.redo().history[-1] == "set name of row 0" and len(log.history) == 71


def test_merging_shuffles_nothing(spark):
    log = EditLog(_table(spark, 100_000)).insert_row(0, name="first").delete_rows([5, 77_777]).duplicate_rows([9], "name")
    plan = log.table._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Broadcast" in plan
    assert log.table.count() == 100_000
    assert len(log.state.pieces) == 7


def test_columns_keep_their_cells(spark):
    log = EditLog(_table(spark, 3)).set_cell(1, "name", "x").rename("name", "title").insert_column("name", "new", 0)
    log.set_cell(2, "name", None).delete_columns(["start"]).toggle_target("a.b").duplicate_rows([2], "name").duplicate_rows([0], "name")
    assert log.table.columns == ["row_idx", "name", "title", "a.b#target"]
    assert _rows(log) == [("new", "n0", 0.0), ("new_copy", "n0", 0.0), ("new", "x", 2.0), (None, "n2", 4.0), (None, "n2", 4.0)]
    assert log.toggle_target("a.b#target").table.columns[-1] == "a.b"


def test_edits_of_whole_columns_go_on_from_a_settled_table(spark):
    log = EditLog(_table(spark, 4).withColumnRenamed("a.b", "v")).insert_row(0)
    log.apply("fill", edits.fill_missing(["v"], "mean")).delete_rows([1])
    assert [r[1] for r in _rows(log)] == [3.0, 2.0, 4.0, 6.0]
    assert [r[1] for r in _rows(log.undo().undo())] == [None, 0.0, 2.0, 4.0, 6.0]


def test_batches_are_whole_or_nothing(spark):
    log = EditLog(_table(spark, 3))
    with pytest.raises(ValueError):
        log.batch("both", [("delete_rows", ([0],)), ("rename", ("nowhere", "x"))])
    assert log.state.rows == 3 and log.history == []
    log.batch("both", [("delete_rows", ([0],)), ("rename", ("name", "x"))])
    assert log.state.rows == 2 and log.history == ["both"] and log.undo().state.rows == 3


@pytest.mark.parametrize("wrong", [("set_cell", (3, "name", "x")), ("delete_rows", ([-1],)), ("insert_row", (4,)), ("rename", ("name", "start")), ("rename", ("name", "row_idx")), ("delete_columns", (["nowhere"],))])
def test_wrong_edits_leave_the_log(spark, wrong):
    log = EditLog(_table(spark, 3))
    with pytest.raises(ValueError):
        getattr(log, wrong[0])(*wrong[1])
    assert log.history == [] and len(_rows(log)) == 3


def test_gaps_repeats_and_empty_tables(spark):
    odd = spark.createDataFrame([(7, "c"), (1, "a"), (3, "b")], "row_idx long, x string")
    assert _rows(EditLog(odd).delete_rows([1])) == [("a",), ("c",)]
    twice = spark.createDataFrame([(0, "a"), (1, "b"), (1, "b"), (3, "d")], "row_idx long, x string")
    assert _rows(EditLog(twice)) == [("a",), ("b",), ("b",), ("d",)]
    none = spark.createDataFrame([], "row_idx long, x string")
    assert _rows(EditLog(none)) == []
    assert _rows(EditLog(none).insert_row(0, x="a").insert_row(1, x="b").duplicate_rows([0], "x")) == [("a",), ("a_copy",), ("b",)]
