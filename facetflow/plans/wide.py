"""Named queries with SQL on many columns at once, kernel fits, and models that were saved and loaded."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from facetflow.operators import analysis, correlate, document, kernel, pca
from facetflow.operators.preprocess import Preprocess
from facetflow.plans.queries import LINE, ORDER, ORDER_SQL, _PAIR, _orders, _pair_model, _round, _t, query
from facetflow.sources import scratch
from facetflow.streaming import refit

# --- correlations of many columns ---------------------------------------------------------------------------------

MANY = 20


def _gapped(k: int) -> str:
    """Column k of many, each with gaps of its own."""
    return f"CASE WHEN l_orderkey % {k + 5} <> 0 THEN CAST({LINE[k % 4]} AS DOUBLE) * {k + 1} + l_partkey % {k + 7} END"


_GAPPED = "(SELECT " + ", ".join(f"{_gapped(k)} AS c{k}" for k in range(MANY)) + " FROM lineitem)"


def _structs(fields: list[str]) -> str:
    return "unnest([" + ", ".join("{" + f + "}" for f in fields) + "])"


_PAIRS = [f"'a': 'c{i}', 'b': 'c{j}', 'r': round(corr(c{i}, c{j}), 6), 'n': count(*) FILTER (WHERE c{i} IS NOT NULL AND c{j} IS NOT NULL)" for i, j in combinations(range(MANY), 2)]


@query(f"SELECT x.a AS a, x.b AS b, x.r AS r, x.n AS n FROM (SELECT {_structs(_PAIRS)} AS x FROM {_GAPPED})")
def pearson_gapped_columns(spark, folder):
    """All pairs of twenty columns, each pair over the rows that hold both."""
    df = _t(spark, folder, "lineitem").select(*[F.expr(_gapped(k)).alias(f"c{k}") for k in range(MANY)])
    return _round(correlate.pearson_matrix(df, [f"c{k}" for k in range(MANY)]), ["r"])


_RANKS = "(SELECT " + ", ".join(f"CASE WHEN c{k} IS NOT NULL THEN rank() OVER (ORDER BY c{k}) + (count(*) OVER (PARTITION BY c{k}) - 1) / 2.0 END AS c{k}" for k in range(8)) + f" FROM {_GAPPED})"
_RANKED = [f"'variable': 'c{v}', 'pc': 'c{p}', 'r': round(corr(c{v}, c{p}), 6), 'n': count(*) FILTER (WHERE c{v} IS NOT NULL AND c{p} IS NOT NULL)" for v in range(2, 8) for p in range(2)]


@query(f"SELECT x.variable AS variable, x.pc AS pc, x.r AS r, x.n AS n FROM (SELECT {_structs(_RANKED)} AS x FROM {_RANKS})")
def spearman_gapped_columns(spark, folder):
    """Ranks of eight columns over all their own values, ties by their mean."""
    df = _t(spark, folder, "lineitem").select(*[F.expr(_gapped(k)).alias(f"c{k}") for k in range(8)])
    found = correlate.eigencorrelations(df, ["c0", "c1"], [f"c{k}" for k in range(2, 8)], method="spearman")
    return _round(found.drop("p_value"), ["r"])


@query("""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, count(*) AS n FROM orders), v AS (SELECT o_custkey, count(*) AS k, avg(o_totalprice) AS own FROM orders GROUP BY 1)
SELECT 'o_custkey_' || o_custkey AS variable, 'o_totalprice' AS pc, round((k / n) * (own - m) / (sd * sqrt((k / n) * (1 - k / n))), 6) AS r, n FROM v, s""")
def correlations_of_many_levels(spark, folder):
    """Each customer as a 0/1 column: as many as there are, by one grouping."""
    found = correlate.eigencorrelations(_t(spark, folder, "orders"), ["o_totalprice"], [], ["o_custkey"])
    return _round(found.drop("p_value"), ["r"])


# --- kernels ------------------------------------------------------------------------------------------------------

_TWO = "x AS (SELECT s_suppkey, s_acctbal / 1000 - avg(s_acctbal / 1000) OVER () AS a, s_nationkey - avg(s_nationkey) OVER () AS b FROM supplier), g AS (SELECT sum(a * a) AS p, sum(a * b) AS q, sum(b * b) AS s FROM x), e AS (SELECT p, q, s, (p + s) / 2 + sqrt(pow((p - s) / 2, 2) + q * q) AS l1, (p + s) / 2 - sqrt(pow((p - s) / 2, 2) + q * q) AS l2 FROM g)"


def _suppliers(spark, folder):
    return _t(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), (F.col("s_acctbal") / 1000).alias("x"))


@query(f"WITH {_TWO} SELECT s_suppkey, round(abs(a * q + b * (l1 - p)) / sqrt(q * q + pow(l1 - p, 2)), 4) AS pc1, round(abs(a * q + b * (l2 - p)) / sqrt(q * q + pow(l2 - p, 2)), 4) AS pc2 FROM x, e")
def kernel_pca_scores(spark, folder):
    """Scores of a linear kernel of two features, whose directions are those of their 2 x 2 sums of products; the kernel
    is made in blocks by tasks. Signs are free."""
    model = kernel.fit(_suppliers(spark, folder), ["x", "s_nationkey"], 2, kernel="linear", local_rows=10)
    return model.transform(_suppliers(spark, folder)).select("s_suppkey", F.round(F.abs("PC1"), 4).alias("pc1"), F.round(F.abs("PC2"), 4).alias("pc2"))


@query("""WITH x AS (SELECT s_suppkey AS i, s_acctbal / 1000 AS a, s_nationkey AS b FROM supplier), k AS (SELECT sum(exp(-0.5 * (pow(x.a - y.a, 2) + pow(x.b - y.b, 2)))) AS s FROM x, x AS y)
SELECT 'rbf' AS kernel, round(count(*) - min(s) / count(*), 4) AS total FROM x, k""")
def kernel_pca_total(spark, folder):
    """All eigenvalues of a centred rbf kernel add up to its trace."""
    model = kernel.fit(_suppliers(spark, folder), ["x", "s_nationkey"], 2, gamma=0.5, local_rows=10)
    return spark.createDataFrame([("rbf", round(float(model.total), 4))], "kernel string, total double")


# --- saved models -------------------------------------------------------------------------------------------------


@query(f"WITH {_PAIR} SELECT 'qty' AS feature, 'PC1' AS pc, round(sqrt((1 + r) / 2), 5) AS correlation FROM c UNION ALL SELECT 'price', 'PC1', round(sqrt((1 + r) / 2), 5) FROM c")
def reloaded_loadings(spark, folder):
    """Correlations of features with the one component kept, of a model read back from JSON."""
    model = pca.PCAModel.from_json(_pair_model(_orders(spark, folder), 1).to_json())
    return _round(model.loading_rows(spark).select("feature", "pc", "correlation"), ["correlation"], 5)


@query(f"WITH {_PAIR} SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS position, round(abs(pc1), 4) AS PC1, round(abs(pc2), 4) AS PC2 FROM t")
def document_scores(spark, folder):
    """Scores of orders, read back from the document that tasks have written in the order of their keys."""
    df = _orders(spark, folder)
    found = analysis.analyse(df, ORDER, 2, Preprocess(scale="standard"))
    path = scratch.new_folder(spark)
    document.write(found, path, order="l_orderkey", preserved=["disc"])
    model = document.load(spark, path)
    return document.saved_scores(spark, path, model.k).select("position", *[F.round(F.abs(p), 4).alias(p) for p in model.labels])


@query(f"WITH {_PAIR}, l AS (SELECT avg(qty) AS q, avg(price) AS p, stddev_samp(qty) AS sq, stddev_samp(price) AS sp, corr(qty, price) AS r FROM {ORDER_SQL}) SELECT o.l_orderkey, round(pow((z.a + z.b) / sqrt(2), 2) / (1 + l.r + 1e-4) + pow((z.a - z.b) / sqrt(2), 2) / (1 - l.r + 1e-4), 4) AS t2 FROM {ORDER_SQL} o JOIN z USING (l_orderkey), l")
def reloaded_diagnostics(spark, folder):
    """T^2 by a model read back from JSON."""
    df = _orders(spark, folder)
    model = pca.PCAModel.from_json(_pair_model(df, 2).to_json())
    if not np.allclose(model.eigenvalues, _pair_model(df, 2).eigenvalues):
        raise ArithmeticError("eigenvalues changed")
    return _round(model.diagnostics(df).select("l_orderkey", "t2"), ["t2"], 4)


# --- many features with gaps, and more features than rows ----------------------------------------------------------

_RISING = [(k, (k + 1) ** 2) for k in range(MANY)]
_NORM = sum(w for _, w in _RISING)


@query(" UNION ALL ".join(f"SELECT 'c{k}' AS feature, round({k + 1} / sqrt({_NORM}), 6) AS value, round(sum(q * q) * {_NORM} / (count(*) - 1), 2) AS eigenvalue FROM (SELECT CASE WHEN l_orderkey = 0 THEN 0.0 ELSE CAST(l_quantity AS DOUBLE) END AS q FROM lineitem)" for k, _ in _RISING))
def nipals_many_gapped_features(spark, folder):
    """Twenty multiples of one column, each with gaps of its own, hold one component with rising loadings."""
    df = _t(spark, folder, "lineitem").select(*[F.when(F.col("l_orderkey") % (k + 5) != 0, F.col("l_quantity") * float(k + 1)).alias(f"c{k}") for k, _ in _RISING])
    model = pca.fit(df, [f"c{k}" for k, _ in _RISING], 1, Preprocess(center=False), "nipals", "native")
    rows = [(f, round(float(v), 6), round(float(model.eigenvalues[0]), 2)) for f, v in zip(model.features, model.loadings[:, 0], strict=True)]
    return spark.createDataFrame(rows, "feature string, value double, eigenvalue double")


@query("WITH x AS (SELECT n_nationkey * sin(k) + n_regionkey * cos(3 * k) AS v, k, n_nationkey FROM nation, range(9000) r(k)), c AS (SELECT k, var_samp(v) AS s FROM x GROUP BY 1) SELECT 'all' AS eigenvalues, round(sum(s), 3) AS total, 2 AS rank FROM c")
def more_features_than_rows(spark, folder):
    """Nine thousand features of a few rows: eigenvalues add up to the features' variances, and as many as columns were
    mixed differ from zero."""
    df = _t(spark, folder, "nation")
    x = F.transform(F.sequence(F.lit(0), F.lit(8999)), lambda k: F.col("n_nationkey") * F.sin(k.cast("double")) + F.col("n_regionkey") * F.cos(3.0 * k))
    model = pca.fit_array(df.select(x.alias("x")), "x", [f"f{k}" for k in range(9000)], 2)
    return spark.createDataFrame([("all", round(float(model.eigenvalues.sum()), 3), int((model.eigenvalues > 1e-6).sum()))], "eigenvalues string, total double, rank int")


@query("SELECT 'qty' AS feature, round(var_samp(qty) + var_samp(price) , 2) AS total, round((var_samp(qty) + var_samp(price)) / 2 - sqrt(pow((var_samp(qty) - var_samp(price)) / 2, 2) + pow(covar_samp(qty, price), 2)), 3) AS least FROM " + ORDER_SQL.replace("sum(l_extendedprice) AS price", "sum(l_extendedprice) / 1000 AS price"))
def eigenvalues_by_factors(spark, folder):
    """Both eigenvalues of two features from the tree of partial QR factors."""
    df = _orders(spark, folder).withColumn("price", F.col("price") / 1000)
    model = pca.fit(df, ORDER, 2, exact=True)
    return spark.createDataFrame([("qty", round(float(model.eigenvalues.sum()), 2), round(float(model.eigenvalues[1]), 3))], "feature string, total double, least double")


# --- models of streams --------------------------------------------------------------------------------------------


@query(f"WITH {_PAIR} SELECT 'PC1' AS pc, round(1 + r, 6) AS eigenvalue, (SELECT count(*) FROM {ORDER_SQL}) AS n FROM c UNION ALL SELECT 'PC2', round(1 - r, 6), (SELECT count(*) FROM {ORDER_SQL}) FROM c")
def refitted_on_stream(spark, folder):
    """Orders arrive in several batches; the model of the merged moments is that of all of them."""
    arriving, state, checkpoint = (scratch.new_folder(spark) for _ in range(3))
    _orders(spark, folder).select("l_orderkey", *ORDER).repartition(3, "l_orderkey").write.parquet(arriving)
    stream = spark.readStream.schema("l_orderkey long, qty double, price double").option("maxFilesPerTrigger", 1).parquet(arriving)
    refit.learn(stream, ORDER, state, checkpoint).awaitTermination()
    model = refit.model(spark, state, ORDER, 2, Preprocess(scale="standard"))
    return _round(model.variance(spark).select("pc", "eigenvalue", F.lit(int(model.rows)).cast("long").alias("n")), ["eigenvalue"])
