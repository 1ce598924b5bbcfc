"""The quality report: distinct values, jobs that don't grow with the columns, empty tables."""

import random

from pyspark.sql import functions as F

from facetflow.operators import profile
from facetflow.operators.quantiles import distinct_counts


def test_distinct_values_of_small_sets(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "", "ä"]), rng.randrange(300), None) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b long, c double").repartition(3)
    want = {"a": len({r[0] for r in rows} - {None}), "b": len({r[1] for r in rows})}
    for held in (0, 7, 50_000):
        assert {r["column"]: r["n_distinct"] for r in distinct_counts(df, ["a", "b", "c"], held).collect()} == want
    assert distinct_counts(df.limit(0), ["a", "b"]).count() == 0


def test_roles_of_odd_columns(spark):
    rows = [(None, "", str(i % 30), str(i), str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "`a` string, `b` string, `c` string, `d#Target` string, `x0` string")
    found = {r["column"]: (r["role"], r["n_distinct"]) for r in profile.roles(df, df.columns).collect()}
    assert found == {"a": ("empty", 0), "b": ("empty", 0), "c": ("numeric", 30), "d#Target": ("target", 60), "x0": ("numeric", 60)}
    assert {r["role"] for r in profile.roles(df.limit(0), ["a", "x0"]).collect()} == {"empty"}


def _jobs(spark, n):
    """Jobs of a report on n numeric columns."""
    df = spark.range(500).select("id", *[F.rand(i).alias(f"c{i}") for i in range(n)])
    name = f"report of {n}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        report = profile.quality_report(df, [f"c{i}" for i in range(n)])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(report["profile"]) == n
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_columns(spark):
    _jobs(spark, 8)
    assert _jobs(spark, 24) <= _jobs(spark, 12)


def test_report_of_an_empty_table(spark):
    df = spark.createDataFrame([], "row_idx long, a double, b string")
    report = profile.quality_report(df, ["a"], ["b"])
    assert (report["rows"], report["duplicates"], report["outliers"]) == (0, 0, {})
    assert report["profile"]["a"]["distribution"] == "unknown"
    assert profile.issue_rows(spark, report).columns == ["level", "kind", "columns", "advice"]
