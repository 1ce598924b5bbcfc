"""Named queries over the star-schema tables, each with equivalent SQL where SQL can express it.

Values are rounded here, at the boundary, and nowhere else. Missing cells are made by a rule, as the tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions import numbers, transforms
from facetflow.operators import correlate, edits, kernel, pca, profile, rows, views
from facetflow.operators.preprocess import Preprocess, constant_columns, scale_ratio, variance_rank

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}
PART = ["p_size", "p_retailprice"]
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER = ["qty", "price"]
ORDER_SQL = "(SELECT l_orderkey, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, avg(l_discount) AS disc, count(*) AS n_lines FROM lineitem GROUP BY 1)"
GAPS_SQL = "(SELECT event_id AS row_idx, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _found[f.__name__] = (f, sql)
        return f

    return put


def _t(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.count(F.lit(1)).alias("n_lines"))


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "events").select(F.col("event_id").alias("row_idx"), "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("x"))


def _round(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 most extreme orders by T^2 of two components of four standardised features."""
    df = _orders(spark, folder)
    model = pca.fit(df, ["qty", "price", "disc", "n_lines"], 2, Preprocess(scale="standard"))
    return model.diagnostics(df).select("l_orderkey", "PC1", "PC2", "t2", "rss", "is_outlier").orderBy(F.desc("t2"), "l_orderkey").limit(20)


def _pre(spark: SparkSession, folder: str, pre: Preprocess) -> DataFrame:
    df = _t(spark, folder, "part").select("p_partkey", *PART)
    return _round(pre.fit(df, PART).transform(df), PART)


def _part_sql(f: str) -> str:
    return "SELECT p_partkey, " + ", ".join(f"round({f.format(c=c)}, 6) AS {c}" for c in PART) + " FROM part"


@query(_part_sql("({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"))
def preprocess_standard(spark, folder):
    return _pre(spark, folder, Preprocess(scale="standard"))


@query("WITH m AS (SELECT quantile_disc(p_size, 0.5) AS a, quantile_disc(p_retailprice, 0.5) AS b FROM part), d AS (SELECT 1.4826 * quantile_disc(abs(p_size - a), 0.5) AS da, 1.4826 * quantile_disc(abs(p_retailprice - b), 0.5) AS db FROM part, m) SELECT p_partkey, round((p_size - a) / da, 6) AS p_size, round((p_retailprice - b) / db, 6) AS p_retailprice FROM part, m, d")
def preprocess_robust(spark, folder):
    return _pre(spark, folder, Preprocess(scale="robust"))


@query(_part_sql("{c} / stddev_samp({c}) OVER ()"))
def preprocess_scale_only(spark, folder):
    return _pre(spark, folder, Preprocess(scale_only=True))


@query(_part_sql("{c}"))
def inverse_standard(spark, folder):
    df = _t(spark, folder, "part").select("p_partkey", *PART)
    pre = Preprocess(scale="standard").fit(df, PART)
    return _round(pre.inverse(pre.transform(df)), PART)


def _line_sql(shift: str, divisor: str) -> str:
    cells = ", ".join(f"round(({c} - {shift}) / {divisor}, 6) AS {c}" for c in LINE)
    return f"WITH a AS (SELECT *, ({' + '.join(LINE)}) / 4 AS m, sqrt({' + '.join(f'{c} * {c}' for c in LINE)}) AS norm FROM lineitem), b AS (SELECT *, sqrt(({' + '.join(f'({c} - m) * ({c} - m)' for c in LINE)}) / 3) AS sd FROM a) SELECT l_orderkey, l_linenumber, {cells} FROM b"


def _rowwise(spark, folder, pre):
    df = _t(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return _round(pre.normalised(df, LINE), LINE)


@query(_line_sql("m", "CASE WHEN sd > 1e-8 THEN sd ELSE 1 END"))
def preprocess_snv(spark, folder):
    return _rowwise(spark, folder, Preprocess(snv=True))


@query(_line_sql("0", "CASE WHEN norm > 1e-8 THEN norm ELSE 1 END"))
def preprocess_l2(spark, folder):
    return _rowwise(spark, folder, Preprocess(vector_norm=True))


def _impute(name: str, strategy: str, stat: str, value: float | None = None) -> None:
    def run(spark, folder):
        return _round(transforms.impute(_gaps(spark, folder), ["x"], strategy, value).select("row_idx", "x"), ["x"])

    run.__name__ = name
    query(f"SELECT row_idx, round(coalesce(x, {stat}), 6) AS x FROM {GAPS_SQL}")(run)


_impute("impute_mean", "mean", f"(SELECT avg(x) FROM {GAPS_SQL})")
_impute("impute_median", "median", f"(SELECT quantile_cont(x, 0.5) FROM {GAPS_SQL})")
_impute("impute_median_low", "median_low", f"(SELECT quantile_disc(x, 0.5) FROM {GAPS_SQL})")
_impute("impute_mode", "mode", f"(SELECT x FROM {GAPS_SQL} WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)")
_impute("impute_zero", "zero", "0.0")
_impute("impute_custom", "custom", "-1.5", -1.5)
_impute("impute_forward", "forward", "last_value(x IGNORE NULLS) OVER (ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_impute("impute_backward", "backward", "first_value(x IGNORE NULLS) OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")


@query(f"SELECT row_idx, x FROM {GAPS_SQL} WHERE x IS NOT NULL")
def drop_missing(spark, folder):
    return rows.drop_missing(_gaps(spark, folder), ["x"]).select("row_idx", "x")


@query(f"SELECT 'x' AS \"column\", count(*) FILTER (x IS NULL) AS n_missing, round(100.0 * count(*) FILTER (x IS NULL) / count(*), 6) AS pct_missing FROM {GAPS_SQL} UNION ALL SELECT 'event_type', 0, 0.0")
def missing_profile(spark, folder):
    return _round(profile.missing_profile(_gaps(spark, folder), ["x", "event_type"]), ["pct_missing"])


@query(f"SELECT 'x' AS \"column\", count(*) AS n_missing, 'systematic' AS pattern FROM {GAPS_SQL} WHERE x IS NULL UNION ALL SELECT 'event_type', 0, 'none'")
def missing_pattern(spark, folder):
    return rows.missing_pattern(_gaps(spark, folder), ["x", "event_type"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders) <= 1.5")
def remove_outliers_z(spark, folder):
    return rows.remove_outliers(_t(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1.5)


@query(f"SELECT row_idx, x FROM {GAPS_SQL} WHERE NOT (row_idx = 0 OR row_idx BETWEEN 4 AND 99)")
def filter_exclude(spark, folder):
    return rows.exclude(_gaps(spark, folder), "1,5-100", ["event_type"])


@query("SELECT i AS row_idx, value FROM (VALUES (0, 5), (1, 3), (2, 5)) t(i, r) JOIN events ON event_id = r")
def select_rows_cols(spark, folder):
    df = _t(spark, folder, "events").withColumnRenamed("event_id", "row_idx")
    return rows.select(df, [5, 3, 5], ["value"])


@query("SELECT 'constant' AS \"column\"")
def constant_column_names(spark, folder):
    df = _t(spark, folder, "part").withColumn("constant", F.lit(3.0))
    return spark.createDataFrame([(c,) for c in constant_columns(df, [*PART, "constant"])], "column string")


@query("SELECT \"column\", round(variance, 4) AS variance, row_number() OVER (ORDER BY variance DESC) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM lineitem" for c in LINE) + ")")
def variance_ranks(spark, folder):
    return _round(variance_rank(_t(spark, folder, "lineitem"), LINE), ["variance"], 4)


def _strict(name: str, kind: str, sql: str) -> None:
    def run(spark, folder):
        return _t(spark, folder, "part").select("p_partkey", F.round(transforms.strict(kind, "p_retailprice"), 6).alias("y"))

    run.__name__ = name
    query(f"SELECT p_partkey, round({sql}, 6) AS y FROM part")(run)


_strict("transform_log", "log", "ln(p_retailprice)")
_strict("transform_sqrt", "sqrt", "sqrt(p_retailprice)")
_strict("transform_square", "square", "p_retailprice * p_retailprice")
_strict("transform_reciprocal", "reciprocal", "1 / p_retailprice")


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE c_acctbal END, 6) AS y FROM customer")
def transform_log_lenient(spark, folder):
    return _t(spark, folder, "customer").select("c_custkey", F.round(transforms.lenient("log", "c_acctbal"), 6).alias("y"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def standardize_population(spark, folder):
    return _round(transforms.standardize(_t(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), ["c_acctbal"])


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS c_acctbal FROM customer")
def min_max(spark, folder):
    return _round(transforms.min_max(_t(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), ["c_acctbal"])


@query("SELECT c_custkey, 'Bin_' || CAST(least(floor((c_acctbal - min(c_acctbal) OVER ()) / ((max(c_acctbal) OVER () - min(c_acctbal) OVER ()) / 5)), 4) + 1 AS BIGINT) AS c_acctbal FROM customer")
def bin_equal_width(spark, folder):
    return transforms.bin_equal_width(_t(spark, folder, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], 5)


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INT) AS \"o_orderstatus_O\", CAST(o_orderstatus = 'P' AS INT) AS \"o_orderstatus_P\" FROM orders")
def one_hot(spark, folder):
    return transforms.one_hot(_t(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


_MOMENTS = "count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS s FROM {t}"


def _profile_sql(t: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", max(n) AS "count", count(*) FILTER ({c} IS NULL) AS missing, count(DISTINCT {c}) AS "distinct", round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median,
      round(stddev_pop({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
      round(any_value(n) / ((any_value(n) - 1.0) * (any_value(n) - 2)) * sum(pow(({c} - m) / s, 3)), 4) AS skewness,
      round(any_value(n) * (any_value(n) + 1.0) / ((any_value(n) - 1.0) * (any_value(n) - 2.0) * (any_value(n) - 3.0)) * sum(pow(({c} - m) / s, 4)) - 3 * (any_value(n) - 1.0) * (any_value(n) - 1.0) / ((any_value(n) - 2.0) * (any_value(n) - 3.0)), 4) AS kurtosis,
      round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr
      FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM {t}), (SELECT {_MOMENTS.format(c=c, t=t)})"""


@query(_profile_sql("part", "p_size") + " UNION ALL " + _profile_sql("part", "p_retailprice"))
def numeric_profile(spark, folder):
    return _round(profile.numeric_profile(_t(spark, folder, "part"), PART), ["mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis", "iqr"], 4)


@query("SELECT c_mktsegment AS value, count(*) AS n, c_mktsegment = (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS is_mode FROM customer GROUP BY 1")
def categorical_profile(spark, folder):
    return profile.categorical_profile(_t(spark, folder, "customer"), "c_mktsegment")


@query("WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer), c AS (SELECT least(floor((c_acctbal - a) / ((b - a) / 10)), 9) AS bin, count(*) AS n FROM customer, s GROUP BY 1) SELECT CAST(i AS INT) AS bin, round(a + i * ((b - a) / 10), 4) AS low, round(CASE WHEN i = 9 THEN b + 0.001 ELSE a + (i + 1) * ((b - a) / 10) END, 4) AS high, coalesce(n, 0) AS n FROM range(10) r(i) CROSS JOIN s LEFT JOIN c ON c.bin = i")
def histogram10(spark, folder):
    return _round(profile.histogram(_t(spark, folder, "customer"), "c_acctbal"), ["low", "high"], 4)


@query("WITH s AS (SELECT avg(price) AS m, stddev_pop(price) AS sd, quantile_cont(price, 0.5) AS med, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM " + ORDER_SQL + ") SELECT 'price' AS \"column\", l_orderkey, round(price, 2) AS value, CASE WHEN price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) THEN 'iqr' ELSE 'zscore' END AS method, round(CASE WHEN price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) THEN abs(price - med) / (q3 - q1) ELSE abs(price - m) / sd END, 5) AS score FROM " + ORDER_SQL + ", s WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1) OR abs(price - m) / sd > 3")
def outliers_iqr_z(spark, folder):
    return _round(_round(profile.outliers(_orders(spark, folder), ["price"], "l_orderkey"), ["value"], 2), ["score"], 5)


@query("SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS n_duplicates FROM lineitem")
def duplicates(spark, folder):
    return profile.duplicate_rows(_t(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity"])


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) AS n FROM {ORDER_SQL}" for a, b in (("qty", "price"), ("qty", "disc"), ("price", "disc"))))
def pearson_matrix(spark, folder):
    return _round(correlate.pearson_matrix(_orders(spark, folder), ["qty", "price", "disc"]), ["r"])


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def average_rank(spark, folder):
    return rows.average_rank(_t(spark, folder, "part"), "p_size").select("p_partkey", F.col("rank").cast("double").alias("rank"))


_PAIR = f"z AS (SELECT l_orderkey, disc, (qty - avg(qty) OVER ()) / stddev_samp(qty) OVER () AS a, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS b FROM {ORDER_SQL}), c AS (SELECT corr(a, b) AS r FROM z), t AS (SELECT l_orderkey, disc, r, (a + b) / sqrt(2) AS pc1, (a - b) / sqrt(2) AS pc2 FROM z, c)"


def _pair_model(df: DataFrame, k: int) -> pca.PCAModel:
    return pca.fit(df, ORDER, k, Preprocess(scale="standard"))


@query(f"WITH {_PAIR} SELECT 'PC1' AS pc, round(1 + r, 6) AS eigenvalue, round(50 * (1 + r), 5) AS ratio_pct, round(50 * (1 + r), 5) AS cumulative_pct FROM c UNION ALL SELECT 'PC2', round(1 - r, 6), round(50 * (1 - r), 5), 100.0 FROM c")
def pca2_variance(spark, folder):
    found = _pair_model(_orders(spark, folder), 2).variance(spark)
    return _round(_round(found, ["eigenvalue"]), ["ratio_pct", "cumulative_pct"], 5)


@query(f"WITH {_PAIR} SELECT l_orderkey, round(pc1, 5) AS \"PC1\", round(pc2, 5) AS \"PC2\" FROM t")
def pca2_scores(spark, folder):
    df = _orders(spark, folder)
    return _round(_pair_model(df, 2).transform(df).select("l_orderkey", "PC1", "PC2"), ["PC1", "PC2"], 5)


@query(f"WITH {_PAIR} SELECT l_orderkey, round(pc1 * pc1 / (1 + r + 1e-4), 5) AS t2, round(abs(pc1) / sqrt(1 + r + 1e-4), 5) AS mahalanobis, round(pc2 * pc2, 5) AS rss FROM t")
def pca2_t2_rss(spark, folder):
    df = _orders(spark, folder)
    return _round(_pair_model(df, 1).diagnostics(df).select("l_orderkey", "t2", "mahalanobis", "rss"), ["t2", "mahalanobis", "rss"], 5)


@query("SELECT l_orderkey, round(0.6 * (qty - 101.3) / 47.7 + 0.8 * (price - 200123.4) / 98765.4, 6) AS \"PC1\", round(0.8 * (qty - 101.3) / 47.7 - 0.6 * (price - 200123.4) / 98765.4, 6) AS \"PC2\" FROM " + ORDER_SQL)
def score_frozen(spark, folder):
    import numpy as np

    pre = Preprocess(scale="standard", features=tuple(ORDER), means=(101.3, 200123.4), deviations=(47.7, 98765.4))
    model = pca.PCAModel(pre, np.array([[0.6, 0.8], [0.8, -0.6]]), np.array([1.5, 0.5]), 100)
    return _round(model.transform(_orders(spark, folder)).select("l_orderkey", "PC1", "PC2"), ["PC1", "PC2"])


@query(f"WITH {_PAIR} SELECT 'disc' AS variable, 'PC1' AS pc, round(corr(pc1, disc), 5) AS r, count(*) AS n FROM t UNION ALL SELECT 'disc', 'PC2', round(corr(pc2, disc), 5), count(*) FROM t")
def eigencorr_pearson(spark, folder):
    df = _orders(spark, folder)
    found = correlate.eigencorrelations(_pair_model(df, 2).transform(df), ["PC1", "PC2"], ["disc"])
    return _round(found.drop("p_value"), ["r"], 5)


@query("WITH k AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT 'p_retailprice' AS variable, 'p_size' AS pc, round(corr(a, b), 6) AS r, count(*) AS n FROM k")
def eigencorr_spearman(spark, folder):
    found = correlate.eigencorrelations(_t(spark, folder, "part").select(*PART), ["p_size"], ["p_retailprice"], method="spearman")
    return _round(found.drop("p_value"), ["r"])


@query("WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS cx, avg(l_extendedprice / 1000) AS cy, var_samp(l_quantity) AS vx, var_samp(l_extendedprice / 1000) AS vy, covar_samp(l_quantity, l_extendedprice / 1000) AS c FROM lineitem GROUP BY 1), e AS (SELECT *, (vx + vy) / 2 AS h, sqrt(pow((vx - vy) / 2, 2) + c * c) AS g FROM s) SELECT l_returnflag, n, round(cx, 5) AS center_x, round(cy, 5) AS center_y, round(sqrt(5.991 * (h + g)), 5) AS major, round(sqrt(5.991 * (h - g)), 5) AS minor, round(atan2(2 * c, vx - vy) / 2, 5) AS angle FROM e WHERE n >= 3 AND h - g > 0")
def group_ellipses(spark, folder):
    df = _t(spark, folder, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return _round(correlate.ellipses(df, "l_returnflag", "l_quantity", "price"), ["center_x", "center_y", "major", "minor", "angle"], 5)


_KERNEL = "p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, exp(-0.5 * pow(a.s_acctbal / 1000 - b.s_acctbal / 1000, 2)) AS k FROM supplier a, supplier b)"


def _suppliers(spark, folder):
    return _t(spark, folder, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"))


def _supplier_kernel(spark, folder):
    return kernel.rbf_pairs(_suppliers(spark, folder), "s_suppkey", ["x"], 0.5)


@query(f"WITH {_KERNEL} SELECT i, j, round(k, 6) AS k FROM p WHERE i <= j")
def kernel_rbf_matrix(spark, folder):
    return _round(_supplier_kernel(spark, folder), ["k"])


@query(f"WITH {_KERNEL}, m AS (SELECT i, avg(k) AS m FROM p GROUP BY 1) SELECT p.i, p.j, round(p.k, 6) AS k, round(p.k - a.m - b.m + (SELECT avg(k) FROM p), 6) AS kc FROM p JOIN m a ON a.i = p.i JOIN m b ON b.i = p.j WHERE p.i <= p.j")
def kernel_centered(spark, folder):
    means = kernel.row_means(_suppliers(spark, folder), "s_suppkey", ["x"], gamma=0.5)
    return _round(kernel.centered(_supplier_kernel(spark, folder), means), ["k", "kc"])


@query("SELECT round(var_samp(l_extendedprice) / var_samp(l_quantity), 3) AS ratio FROM lineitem")
def scale_ratios(spark, folder):
    found = scale_ratio(_t(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"])
    return spark.createDataFrame([(found,)], "ratio double").select(F.round("ratio", 3).alias("ratio"))


@query("SELECT 'PC1' AS pc, 'qty' AS feature UNION ALL SELECT 'PC2', 'qty'")
def argmax_loading(spark, folder):
    loadings = _pair_model(_orders(spark, folder), 2).loading_rows(spark).withColumn("value", F.round("value", 9))
    return views.leading_feature(loadings)


@query(f"WITH {_PAIR} SELECT l_orderkey, round(pc1, 5) AS \"PC1\", round(pc2, 5) AS \"PC2\", round(sqrt(pc1 * pc1 + pc2 * pc2), 5) AS distance FROM t ORDER BY pc1 * pc1 + pc2 * pc2 DESC, l_orderkey LIMIT 10")
def smart_labels(spark, folder):
    df = _orders(spark, folder)
    found = views.farthest(_pair_model(df, 2).transform(df), "PC1", "PC2", 10, "l_orderkey")
    return _round(found, ["PC1", "PC2", "distance"], 5)


@query("WITH p AS (SELECT CAST(s_nationkey AS DOUBLE) AS x, s_acctbal / 1000 AS y FROM supplier), s AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -1.0 / 6) AS hx, stddev_samp(y) * pow(count(*), -1.0 / 6) AS hy, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM p), g AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, ax + i * (bx - ax) / 9 AS gx, ay + j * (by_ - ay) / 9 AS gy, s.* FROM range(10) a(i), range(10) b(j), s) SELECT i, j, round(any_value(gx), 5) AS x, round(any_value(gy), 5) AS y, round(sum(exp(-(pow((gx - x) / hx, 2) + pow((gy - y) / hy, 2)) / 2)) / (2 * pi() * any_value(hx) * any_value(hy) * any_value(n)), 6) AS density FROM g, p GROUP BY i, j")
def kde2d(spark, folder):
    df = _t(spark, folder, "supplier").select(F.col("s_nationkey").alias("x"), (F.col("s_acctbal") / 1000).alias("y"))
    return _round(_round(views.density(df, "x", "y", 10), ["x", "y"], 5), ["density"])


@query("SELECT 'c_acctbal' AS \"column\", 'numeric' AS role, count(DISTINCT c_acctbal) AS n_distinct FROM customer UNION ALL SELECT 'c_mktsegment', 'categorical', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_name', 'text', count(DISTINCT c_name) FROM customer")
def role_inference(spark, folder):
    return profile.roles(_t(spark, folder, "customer"), ["c_acctbal", "c_mktsegment", "c_name"])


_TOKENS = "CASE event_id % 6 WHEN 0 THEN ' na ' WHEN 1 THEN '?' WHEN 2 THEN '1,5' WHEN 3 THEN '-2e3' WHEN 4 THEN '1d' ELSE CAST(event_id AS VARCHAR) END"


def _cells(spark, folder):
    k = F.col("event_id") % 6
    cell = F.when(k == 0, " na ").when(k == 1, "?").when(k == 2, "1,5").when(k == 3, "-2e3").when(k == 4, "1d").otherwise(F.col("event_id").cast("string"))
    return _t(spark, folder, "events").select("event_id", cell.alias("cell"))


@query(f"SELECT event_id, lower(trim({_TOKENS})) IN ('', 'na', 'n/a', 'nan', 'null', 'm', '-', '?', 'none', 'missing') AS missing FROM events")
def null_tokens(spark, folder):
    return _cells(spark, folder).select("event_id", numbers.is_missing("cell", numbers.EDITOR_TOKENS).alias("missing"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 1.5 WHEN 3 THEN -2000.0 WHEN 4 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS number FROM events")
def parse_numbers(spark, folder):
    return _cells(spark, folder).select("event_id", numbers.parse_number("cell", ",").alias("number"))


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_idx, value FROM events WHERE event_id NOT IN (2, 5)")
def edit_delete_rows(spark, folder):
    df = _t(spark, folder, "events").select(F.col("event_id").alias("row_idx"), "value")
    return edits.History(df).do("delete", edits.delete_rows([2, 5]))


@query("SELECT row_number() OVER (ORDER BY event_id, c) - 1 AS row_idx, CASE WHEN c = 1 THEN event_type || '_copy' ELSE event_type END AS event_type FROM events, range(2) r(c) WHERE c = 0 OR event_id IN (1, 3)")
def edit_duplicate_rows(spark, folder):
    df = _t(spark, folder, "events").select(F.col("event_id").alias("row_idx"), "event_type")
    return edits.duplicate_rows([1, 3], "event_type")(df)


@query()
def pca_svd_embeddings(spark, folder):
    x = _t(spark, folder, "embeddings")
    df = x.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return pca.fit(df, [f"e{i}" for i in range(64)], 10).variance(spark)


@query()
def nipals_missing(spark, folder):
    df = _orders(spark, folder).withColumn("price", F.when(F.col("l_orderkey") % 11 != 0, F.col("price") / 1000))
    return pca.fit(df, [*ORDER, "n_lines"], 2, method="nipals", missing="native").variance(spark)


@query()
def kernel_pca(spark, folder):
    df = _t(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 1000).alias("x"))
    return kernel.fit(df, ["s_nationkey", "x"], 2).transform(df)


@query()
def quality_report(spark, folder):
    found = profile.quality_report(_gaps(spark, folder), ["x"], ["event_type"])
    return spark.createDataFrame([(k, c, float(found["score"])) for _, k, c in found["issues"]], "category string, affected array<string>, score double")


def queries() -> dict[str, Query]:
    from facetflow.plans import checks, wide  # noqa: F401 (register their queries)

    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    from facetflow.plans import checks, wide  # noqa: F401

    return {k: s for k, (_, s) in _found.items() if s}
