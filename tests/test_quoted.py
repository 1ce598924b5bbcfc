"""Quoted newlines, cut from many blocks, against the standard library's reader."""

import csv
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from facetflow.sources import quoted, tables


@pytest.fixture(params=[150, 1 << 20])
def blocks(spark, request):
    """Bytes of a block."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, rng, n, end):
    rows = [["name", "no,te", 'a "b"']]
    for i in range(n):
        long = "x\n" * rng.choice([0, 1, 2, 60])
        rows.append([f"r{i}", rng.choice(["plain", "two\nlines", 'with "quotes"\n\n, and more', "", "é\n\"\"", long + "end"]), str(i)])
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)
    return [[c.strip() for c in r] for r in rows[1:]]


@pytest.mark.parametrize("broadcast_blocks", [quoted.BLOCKS, 0])
def test_records_of_many_blocks(spark, tmp_path, blocks, broadcast_blocks):
    rng = random.Random(blocks)
    want = _write(tmp_path / "a.csv", rng, 30, "\n") + _write(tmp_path / "b.csv", rng, 10, "\r\n")
    (tmp_path / "c.csv").write_text("\n\n")
    found = quoted.records(spark, str(tmp_path), broadcast_blocks).orderBy("row").collect()
    assert [r["row"] for r in found] == list(range(42))
    assert [r["place"] for r in found] == [*range(31), *range(11)]
    assert {r["files"] for r in found[:31]} == {1} and {r["files"] for r in found[31:]} == {2}
    if broadcast_blocks:
        got = quoted.rows(spark, str(tmp_path)).orderBy("row_idx").collect()
        assert [r["row_idx"] for r in got] == list(range(40))
        assert [[x or "" for x in r[1:]] for r in got] == want


def test_options_and_errors(spark, tmp_path, blocks):
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir(), two.mkdir()
    (one / "a.csv").write_text('Title, "of\nthe file"\n\nid;"long\nname";;id\n1;"x\ny";z;7\n2;;;\n3;"only two"\n')
    df = tables.read_wizard(spark, str(one), ";", header_row=1)
    assert df.columns == ["row_idx", "id0", "long\nname", "_c2", "id3"]
    rows = df.orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == [0, 1, 2]
    assert rows[0]["long\nname"] == "x\ny" and rows[1]["_c2"] is None
    marked = quoted.rows(spark, str(one), ";", ragged="bad", header_place=1).where(F.col("bad").isNotNull())
    assert [r["row_idx"] for r in marked.collect()] == [2]
    (two / "a.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(ValueError, match="never closed"):
        quoted.records(spark, str(two))
    (two / "a.csv").write_text("")
    assert quoted.records(spark, str(two)).count() == 0
    assert tables.read_text(spark, str(two), replace(tables.DEFAULT, multi_line=True)).count() == 0
