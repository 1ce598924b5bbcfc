"""Further named queries with SQL: sources and sinks, validation, edits, views, and models where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetflow.functions import numbers, transforms
from facetflow.operators import analysis, correlate, edits, kernel, pca, profile, rows, validate, views
from facetflow.operators.editlog import EditLog
from facetflow.operators.preprocess import Preprocess
from facetflow.plans.queries import GAPS_SQL, ORDER, ORDER_SQL, _PAIR, _gaps, _orders, _pair_model, _round, _t, query
from facetflow.sources import scratch, tables

#: 99.9 % quantile of F with 1 and 99 degrees of freedom, from the density of t.
F_LIMIT = 11.50247
CUSTOMER = ["c_custkey", "c_acctbal", "c_mktsegment"]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "events").select(F.col("event_id").alias("row_idx"), "event_type", "value")


# --- validation ---------------------------------------------------------------------------------------------------

_STATS = "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS non_missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, var_samp({c}) < 1e-10 AS zero_variance FROM {t}"


@query(_STATS.format(c="x", t=GAPS_SQL) + " UNION ALL " + _STATS.format(c="flat", t="(SELECT 3.0 AS flat FROM events)"))
def validator_statistics(spark, folder):
    df = _gaps(spark, folder).withColumn("flat", F.lit(3.0))
    return _round(validate.column_statistics(df, ["x", "flat"]), ["missing_pct", "min", "max", "mean", "std"])


@query("SELECT 'warning' AS level, 'column flat has near-zero variance' AS message UNION ALL SELECT 'error', 'column gone holds only missing values'")
def validation_findings(spark, folder):
    df = _gaps(spark, folder).withColumns({"flat": F.lit(3.0), "gone": F.lit(None).cast("double")})
    found = validate.validate(df, ["x", "flat", "gone"])
    return spark.createDataFrame([("error", m) for m in found.errors] + [("warning", m) for m in found.warnings], "level string, message string")


@query("SELECT 'column flat has near-zero variance' AS message")
def validation_strict(spark, folder):
    found = validate.validate(_gaps(spark, folder).withColumn("flat", F.lit(3.0)), ["x", "flat"], strict=True)
    return spark.createDataFrame([(m,) for m in found.errors], "message string")


@query(f"SELECT count(*) AS n_rows, CAST(2 AS INT) AS n_columns, count(*) - count(x) AS n_missing, round(100.0 * (count(*) - count(x)) / (2 * count(*)), 6) AS missing_pct, CASE WHEN 20 * count(*) < 1024 THEN 20 * count(*) || ' B' WHEN 20 * count(*) < 1048576 THEN printf('%.1f KB', 20 * count(*) / 1024.0) ELSE printf('%.1f MB', 20 * count(*) / 1048576.0) END AS memory FROM {GAPS_SQL}")
def data_summary(spark, folder):
    return _round(validate.summary(_gaps(spark, folder), ["x", "event_type"]), ["missing_pct"])


@query(f"SELECT CAST(1 AS INT) AS columns_with_missing, count(*) - count(x) AS rows_affected, count(*) - count(x) AS total_missing, round(100.0 * (count(*) - count(x)) / (2 * count(*)), 6) AS total_pct FROM {GAPS_SQL}")
def missing_info(spark, folder):
    return _round(validate.missing_info(_gaps(spark, folder), ["x", "event_type"]), ["total_pct"])


@query(f"SELECT row_idx, CAST(1 AS INT) AS n_missing, 50.0 AS pct_missing FROM {GAPS_SQL} WHERE x IS NULL")
def missing_by_row(spark, folder):
    return validate.missing_by_row(_gaps(spark, folder), ["x", "event_type"])


@query(f"SELECT 'x' AS \"column\", count(*) - count(x) AS n_missing, round(100.0 * (count(*) - count(x)) / count(*), 6) AS pct_missing, 'systematic' AS pattern FROM {GAPS_SQL} UNION ALL SELECT 'event_type', 0, 0.0, 'none'")
def missing_analysis(spark, folder):
    return _round(validate.missing_analysis(_gaps(spark, folder), ["x", "event_type"]), ["pct_missing"])


@query(f"SELECT 'INFO' AS level, '1 categorical columns are left out of the analysis but available for plots' AS message UNION ALL SELECT 'ERROR', 'at least two numeric columns are needed, not 1' UNION ALL SELECT 'INFO', printf('%.1f%% missing values (%d cells)', 100.0 * (count(*) - count(x)) / (2 * count(*)), count(*) - count(x)) FROM {GAPS_SQL} UNION ALL SELECT 'INFO', 'large table (' || count(*) || ' rows)' FROM events HAVING count(*) > 10000")
def pca_readiness(spark, folder):
    return spark.createDataFrame(validate.readiness(_gaps(spark, folder), ["x"], ["event_type"]), "level string, message string")


@query("SELECT 'components' AS predicate UNION ALL SELECT 'delimiter' UNION ALL SELECT 'kernel' UNION ALL SELECT 'missing' UNION ALL SELECT 'number' UNION ALL SELECT 'structure'")
def rejected_inputs(spark, folder):
    """Predicates that refuse what they should refuse, and accept the rest."""
    df = _gaps(spark, folder)
    wrong = {
        "structure": lambda: validate.check_structure(df, ["nowhere"]), "missing": lambda: validate.check_no_missing(df, ["x"]), "components": lambda: validate.check_components(4, validate.most_components(9, 3)),
        "kernel": lambda: validate.check_kernel("poly", 1.0, 0), "number": lambda: validate.check_number("7.5", 0, 10, whole=True), "delimiter": lambda: validate.check_delimiter("x"),
    }
    validate.check_structure(df, ["x"])
    validate.check_no_missing(df, ["x"], allowed=True)
    validate.check_components(3, 3)
    validate.check_kernel("rbf", 0.5)
    validate.check_number("7", 0, 10, whole=True)
    validate.check_delimiter("\t")
    said = []
    for name, check in wrong.items():
        try:
            check()
        except ValueError:
            said.append((name,))
    return spark.createDataFrame(said, "predicate string")


_FENCE = f"p AS (SELECT * FROM {GAPS_SQL}), s AS (SELECT count(*) AS n, count(x) AS k, avg(x) AS m, stddev_pop(x) AS sd, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM p), o AS (SELECT count(*) AS out FROM p, s WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) OR abs(x - m) / sd > 3), d AS (SELECT sum(c - 1) AS dups FROM (SELECT count(*) AS c FROM p GROUP BY x, event_type))"


@query(f"WITH {_FENCE} SELECT n AS n_rows, round(100.0 * (n - k) / (2 * n), 6) AS missing_pct, CAST(dups AS BIGINT) AS duplicates, out AS outliers, round(least(100, greatest(0, 100 - 0.5 * 100.0 * (n - k) / (2 * n) - 30.0 * dups / n - 20.0 * out / n - 20)), 6) AS score, round(100 - 0.5 * 100.0 * (n - k) / n - 30.0 * out / k, 6) AS x_score FROM s, o, d")
def quality_scores(spark, folder):
    r = profile.quality_report(_gaps(spark, folder), ["x"], ["event_type"])
    row = (r["rows"], r["missing_pct"], r["duplicates"], r["outliers"].get("x", 0), float(r["score"]), float(r["column_scores"]["x"]))
    return _round(spark.createDataFrame([row], "n_rows long, missing_pct double, duplicates long, outliers long, score double, x_score double"), ["missing_pct", "score", "x_score"])


#: Numeric columns of events: the value with gaps, its multiple, one that is mostly missing, and a constant.
_REPORTED = "(SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS x, CASE WHEN event_id % 7 <> 0 THEN 3 * value + 1 END AS y, CASE WHEN event_id % 3 = 0 THEN value END AS rare, 2.5 AS flat FROM events)"
_MOMENTS = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS k, count(*) AS n, avg({c}) AS m, stddev_pop({c}) AS sd, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, min({c}) AS lo, max({c}) AS hi FROM e" for c in ("x", "y", "rare", "flat"))
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v FROM e" for c in ("x", "y", "rare", "flat"))
_ISSUES = f"""WITH e AS MATERIALIZED {_REPORTED}, s AS ({_MOMENTS}), c AS ({_CELLS}),
z AS (SELECT c.name, any_value(k) AS k, any_value(sd) AS sd, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) OR (sd > 0 AND abs(v - m) / sd > 3)) AS far, avg(pow((v - m) / nullif(sd, 0), 3)) AS g3, avg(pow((v - m) / nullif(sd, 0), 4)) AS g4 FROM c JOIN s USING (name) WHERE v IS NOT NULL GROUP BY 1),
b AS (SELECT name, bin, count(*) AS h FROM (SELECT c.name, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS bin FROM c JOIN s USING (name) WHERE v IS NOT NULL AND hi > lo AND k >= 10) GROUP BY 1, 2),
w AS (SELECT name, k, far, sd, CASE WHEN sd > 0 THEN 1.0 * k * k / ((k - 1) * (k - 2)) * g3 END AS skew, CASE WHEN sd > 0 THEN 1.0 * k * k * (k + 1) / ((k - 1.0) * (k - 2) * (k - 3)) * g4 - 3.0 * (k - 1) * (k - 1) / ((k - 2.0) * (k - 3)) END AS kurt FROM z),
full_bins AS (SELECT s.name, i.i AS bin, coalesce(b.h, 0) AS h FROM s CROSS JOIN range(10) i(i) LEFT JOIN b ON b.name = s.name AND b.bin = i.i), peaks AS (SELECT name, count(*) FILTER (WHERE before < h AND h > after) AS n FROM (SELECT name, h, lag(h) OVER (PARTITION BY name ORDER BY bin) AS before, lead(h) OVER (PARTITION BY name ORDER BY bin) AS after FROM full_bins) GROUP BY 1),
shapes AS (SELECT w.name, CASE WHEN skew IS NULL OR kurt IS NULL OR k < 10 THEN 'unknown' WHEN abs(skew) < 0.5 AND abs(kurt) < 1 THEN 'normal' WHEN skew > 1 THEN 'right-skewed' WHEN skew < -1 THEN 'left-skewed' WHEN peaks.n >= 2 THEN 'bimodal' ELSE 'unknown' END AS shape FROM w JOIN peaks USING (name)),
pct AS (SELECT 100.0 * sum(n - k) / (sum(n) + (SELECT count(*) FROM e)) AS p FROM s), dup AS (SELECT sum(n - 1) AS d FROM (SELECT count(*) AS n FROM e GROUP BY x, y, rare, flat, event_type)),
pairs AS (SELECT 'x,y' AS columns, corr(x, y) AS r FROM e UNION ALL SELECT 'x,rare', corr(x, rare) FROM e UNION ALL SELECT 'y,rare', corr(y, rare) FROM e)
SELECT CASE WHEN p > 20 THEN 'error' ELSE 'warning' END AS level, 'missing' AS kind, '' AS columns, 'impute or drop' AS advice FROM pct WHERE p > 10
UNION ALL SELECT 'error', 'missing', name, 'impute or drop' FROM s WHERE 100.0 * (n - k) / n > 50
UNION ALL SELECT 'warning', 'duplicate', '', 'drop duplicates' FROM dup WHERE d > 0
UNION ALL SELECT 'warning', 'outlier', name, 'robust scaling or removal' FROM w WHERE far > 0.1 * k
UNION ALL SELECT 'warning', 'correlation', columns, 'drop one of each pair' FROM pairs WHERE abs(r) > 0.95
UNION ALL SELECT 'info', 'variance', name, 'drop' FROM w WHERE sd < 0.01
UNION ALL SELECT 'info', 'distribution', string_agg(name, ',' ORDER BY CASE name WHEN 'x' THEN 1 WHEN 'y' THEN 2 WHEN 'rare' THEN 3 ELSE 4 END), 'log or square root' FROM shapes WHERE shape <> 'normal' HAVING count(*) > 0"""


@query(_ISSUES)
def report_issues(spark, folder):
    """What the report finds wrong with four numeric columns and a category, and what it advises."""
    gap, value = F.col("event_id") % 7 != 0, F.col("value")
    df = _t(spark, folder, "events").select("event_type", F.when(gap, value).alias("x"), F.when(gap, 3 * value + 1).alias("y"), F.when(F.col("event_id") % 3 == 0, value).alias("rare"), F.lit(2.5).alias("flat"))
    return profile.issue_rows(spark, profile.quality_report(df, ["x", "y", "rare", "flat"], ["event_type"]))


# --- sources and sinks --------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder for files, which all executors share."""
    return scratch.new_folder(spark)


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder, "customer").select(*CUSTOMER)


def _cells(spark: SparkSession, rows_: DataFrame, header: str, cells: list, separator: str) -> str:
    """Delimited files of the rows in order of c_custkey, each with the header."""
    path = _folder(spark)
    named = [(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(cells, header.split(separator), strict=True)]
    rows_.orderBy("c_custkey").select(*named).write.csv(path, header=True, sep=separator)
    return path


def _lines(spark: SparkSession, rows_: DataFrame, top: list[str], cells: list, separator: str) -> str:
    """Text files of the lines ``top`` and the rows in order of c_custkey; null cells leave their rows too narrow. A single
    line on top is a header, which each file has."""
    path = _folder(spark)
    lines = rows_.select(F.col("c_custkey").alias("i"), F.concat_ws(separator, *cells).alias("value"))
    if len(top) == 1:
        lines.orderBy("i").select(F.col("value").alias(top[0])).write.csv(path, header=True, sep="\x01", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return path
    if top:
        lines = lines.unionByName(spark.createDataFrame([(i - len(top), x) for i, x in enumerate(top)], "i long, value string"))
    lines.orderBy("i").select("value").write.text(path)
    return path


def _european(spark: SparkSession, folder: str) -> str:
    balance = F.when(F.col("c_custkey") % 5 == 0, F.lit("NA")).otherwise(F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(",")))
    return _cells(spark, _customers(spark, folder), "name;balance;segment;key#target", [F.concat(F.lit("C"), F.col("c_custkey")), balance, "c_mktsegment", F.col("c_custkey").cast("string")], ";")


_READ = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, 'C' || c_custkey AS row_name, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_acctbal AS DOUBLE) END AS balance, c_mktsegment AS segment, CAST(c_custkey AS DOUBLE) AS \"key#target\" FROM customer"


@query(_READ)
def read_mixed_csv(spark, folder):
    return tables.read_mixed(spark, _european(spark, folder), tables.EUROPEAN)


@query(_READ)
def read_sniffed_csv(spark, folder):
    path = _european(spark, folder)
    return tables.read_mixed(spark, path, tables.sniff(spark, path))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, 'C' || c_custkey AS row_name, c_mktsegment AS segment FROM customer WHERE c_custkey BETWEEN (SELECT min(c_custkey) + 10 FROM customer) AND (SELECT min(c_custkey) + 29 FROM customer)")
def read_part_of_csv(spark, folder):
    from dataclasses import replace

    return tables.read_text(spark, _european(spark, folder), replace(tables.EUROPEAN, skip_rows=10, max_rows=20, columns=("segment",)))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, CAST(c_custkey AS DOUBLE) AS key, CAST(c_acctbal AS DOUBLE) AS balance FROM customer")
def read_numeric_csv(spark, folder):
    from dataclasses import replace

    path = _cells(spark, _customers(spark, folder), "key,balance", [F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string")], ",")
    return tables.read_numeric(spark, path, replace(tables.DEFAULT, row_names=False))


@query("SELECT 'ragged' AS refused UNION ALL SELECT 'text'")
def refused_csv(spark, folder):
    """Rows of another width, and cells that are no numbers, are refused where all must be numbers."""
    from dataclasses import replace

    plain = replace(tables.DEFAULT, row_names=False)
    text = _cells(spark, _customers(spark, folder), "key,segment", [F.col("c_custkey").cast("string"), "c_mktsegment"], ",")
    ragged = _lines(spark, _customers(spark, folder), ["key,balance"], [F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")), F.col("c_acctbal").cast("string")], ",")
    said = []
    for name, path in (("text", text), ("ragged", ragged)):
        try:
            tables.read_numeric(spark, path, plain)
        except ValueError:
            said.append((name,))
    return spark.createDataFrame(said, "refused string")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_mktsegment || chr(10) || '\"x\", y' AS note FROM customer")
def read_quoted_newlines(spark, folder):
    from dataclasses import replace

    path = _folder(spark)
    rows_ = _customers(spark, folder).select("c_custkey", F.concat("c_mktsegment", F.lit('\n"x", y')).alias("note"))
    rows_.orderBy("c_custkey").select("note").write.csv(path, header=True, quoteAll=True, escape='"')
    return tables.read_text(spark, path, replace(tables.DEFAULT, row_names=False, multi_line=True))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, 'C' || c_custkey AS row_name, c_mktsegment AS segment FROM customer WHERE c_custkey < (SELECT min(c_custkey) + 50 FROM customer)")
def wizard_import(spark, folder):
    """A title line above the header, names in a later column, chosen columns, a limit of rows."""
    cells = [F.col("c_acctbal").cast("string"), F.concat(F.lit("C"), F.col("c_custkey")), "c_mktsegment"]
    path = _lines(spark, _customers(spark, folder), ["Customers of the year", "balance\tname\tsegment"], cells, "\t")
    return tables.read_wizard(spark, path, "\t", header_row=1, row_name_column="name", columns=("segment",), max_rows=50)


@query("SELECT f.name AS name, f.format AS format, count(*) AS n_lines FROM customer, (VALUES ('csv file', 'csv'), ('json file', 'json'), ('text of commas', 'csv'), ('text of tabs', 'tsv'), ('text of objects', 'json')) f(name, format) GROUP BY 1, 2")
def file_formats(spark, folder):
    """Formats of the customers' files: two by the names' endings, three by what text files hold."""
    customers = _customers(spark, folder)
    cells = [F.col(c).cast("string") for c in CUSTOMER]
    by_name = {"csv file": _folder(spark), "json file": _folder(spark)}
    customers.write.csv(by_name["csv file"])
    customers.write.json(by_name["json file"])
    objects = F.to_json(F.struct(*CUSTOMER))
    paths = by_name | {"text of commas": _lines(spark, customers, [], cells, ","), "text of tabs": _lines(spark, customers, [], cells, "\t"), "text of objects": _lines(spark, customers, [], [objects], "")}
    found = [(name, tables.file_format(spark, f"{path}/part-*"), spark.read.text(path).count()) for name, path in paths.items()]
    return spark.createDataFrame(found, "name string, format string, n_lines long")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def read_json_records(spark, folder):
    path = _folder(spark)
    _customers(spark, folder).orderBy("c_custkey").write.json(path)
    return tables.read_json(spark, path).select("row_idx", "c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, 'C' || c_custkey AS row_name, CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE replace(CAST(CAST(c_acctbal AS DOUBLE) AS VARCHAR), '.', ',') END AS balance, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS \"key#target\" FROM customer ORDER BY 1 LIMIT 100")
def file_preview(spark, folder):
    found = tables.preview(spark, _european(spark, folder), tables.EUROPEAN)
    return found.rows


@query("SELECT c_custkey AS row_name, CASE c_custkey % 4 WHEN 0 THEN 'Inf' WHEN 1 THEN '-Inf' WHEN 2 THEN 'NaN' ELSE '1,500' END AS x FROM customer")
def written_numbers(spark, folder):
    k = F.col("c_custkey") % 4
    x = F.when(k == 0, float("inf")).when(k == 1, float("-inf")).when(k == 2, float("nan")).otherwise(1.5)
    path = _folder(spark)
    tables.write_csv(_customers(spark, folder).select(F.col("c_custkey").alias("row_name"), x.alias("x")), path, tables.EUROPEAN, digits=3, nan="NaN")
    return spark.read.csv(path, sep=";", header=True, schema="row_name long, x string")


@query("SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS \"PC1\", CAST(c_custkey * 2 AS DOUBLE) AS \"PC2\" FROM customer")
def scores_as_json(spark, folder):
    df = _customers(spark, folder).select(F.concat(F.lit("C"), F.col("c_custkey")).alias("name"), F.when(F.col("c_custkey") % 3 == 0, float("nan")).otherwise(F.col("c_custkey")).cast("double").alias("PC1"), (F.col("c_custkey") * 2).cast("double").alias("PC2"))
    text = tables.scores_json(df, "name", ["PC1", "PC2"])
    return text.select(F.from_json("value", "id string, scores map<string, double>").alias("r")).select("r.id", F.col("r.scores")["PC1"].alias("PC1"), F.col("r.scores")["PC2"].alias("PC2"))


@query("SELECT c_custkey, printf('%.6g', c_acctbal * 1000.0) AS large, printf('%.6g', c_acctbal / 1e7) AS small FROM customer WHERE c_acctbal <> 0")
def general_format(spark, folder):
    df = _t(spark, folder, "customer").where("c_acctbal <> 0")
    return df.select("c_custkey", numbers.general(F.col("c_acctbal") * 1000.0).alias("large"), numbers.general(F.col("c_acctbal") / 1e7).alias("small"))


# --- rows, edits --------------------------------------------------------------------------------------------------


@query(f"SELECT row_idx, x FROM {GAPS_SQL} WHERE row_idx NOT IN (2, 4)")
def exclude_by_number(spark, folder):
    return rows.exclude(_gaps(spark, folder), [2, 4], [1])


@query("SELECT 'columns' AS refused UNION ALL SELECT 'names' UNION ALL SELECT 'rows' UNION ALL SELECT 'selection'")
def refused_selections(spark, folder):
    df = _events(spark, folder)
    wrong = {"rows": lambda: rows.exclude(df, "1,999999999"), "columns": lambda: rows.exclude(df, "", [9]), "names": lambda: rows.exclude(df, "", ["nowhere"]), "selection": lambda: rows.select(df, [0, 999_999_999], ["value"])}
    said = []
    for name, f in wrong.items():
        try:
            f()
        except ValueError:
            said.append((name,))
    return spark.createDataFrame(said, "refused string")


@query("SELECT event_id AS row_idx, event_type, CASE WHEN event_id = 3 THEN -9.5 ELSE value END AS amount FROM events")
def edit_set_and_rename(spark, folder):
    h = edits.History(_events(spark, folder))
    return h.do("both", edits.batch([edits.set_cell(3, "value", -9.5), edits.rename("value", "amount")]))


@query("SELECT event_id AS row_idx, value AS \"value#target\" FROM events")
def edit_columns(spark, folder):
    return edits.batch([edits.delete_columns(["event_type"]), edits.toggle_target("value")])(_events(spark, folder))


@query("SELECT CASE WHEN event_id >= 5 THEN event_id + 1 ELSE event_id END AS row_idx, event_type, value, 'new' AS note FROM events UNION ALL SELECT 5, 'inserted', NULL, 'new'")
def edit_insert(spark, folder):
    return edits.batch([edits.insert_row(5, event_type="inserted"), edits.insert_column("note", "new")])(_events(spark, folder))


@query("SELECT event_id AS row_idx, event_type, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS value FROM events")
def edit_transform(spark, folder):
    return _round(edits.transformed("minmax", ["value"])(_events(spark, folder)), ["value"])


@query(f"SELECT row_idx, event_type, round(coalesce(x, (SELECT avg(x) FROM {GAPS_SQL})), 6) AS x FROM {GAPS_SQL}")
def edit_undo_redo(spark, folder):
    h = edits.History(_gaps(spark, folder))
    h.do("fill", edits.fill_missing(["x"], "mean"))
    h.do("drop", edits.delete_columns(["x"]))
    h.undo()
    h.undo()
    return _round(h.redo(), ["x"])


@query("WITH x AS (SELECT -1 AS e, 0 AS c, 'first' AS event_type, NULL AS amount UNION ALL SELECT event_id, 0, event_type, value FROM events WHERE event_id NOT IN (2, 9) UNION ALL SELECT event_id, 1, event_type || '_copy', -1.5 FROM events WHERE event_id = 5) SELECT row_number() OVER (ORDER BY e, c) - 1 AS row_idx, event_type, amount FROM x")
def edit_log_rows(spark, folder):
    """Rows inserted, deleted and copied near the front of a table, none of whose rows is renumbered for it."""
    log = EditLog(_events(spark, folder)).insert_row(0, event_type="first").delete_rows([3, 10])
    return log.duplicate_rows([5], "event_type").set_cell(6, "value", -1.5).rename("value", "amount").table


@query("SELECT 59 - k AS row_idx, 's' || k AS event_type, NULL AS value FROM range(60) r(k) UNION ALL SELECT event_id + 60, event_type, value FROM events")
def edit_log_undone(spark, folder):
    """A hundred insertions at the front, forty of them taken back: one join at any length of the history."""
    log = EditLog(_events(spark, folder))
    for k in range(100):
        log.insert_row(0, event_type=f"s{k}")
    for _ in range(40):
        log.undo()
    return log.table


@query(f"SELECT row_idx - 2 AS row_idx, event_type, round(coalesce(x, (SELECT avg(x) FROM {GAPS_SQL})), 6) AS x FROM {GAPS_SQL} WHERE row_idx > 1")
def edit_log_filled(spark, folder):
    """A fill of a whole column between edits of rows: means are those of the table as it was then."""
    log = EditLog(_gaps(spark, folder)).apply("fill", edits.fill_missing(["x"], "mean")).delete_rows([0, 1]).delete_columns(["event_type"])
    return _round(log.undo().table, ["x"])


@query("SELECT event_id AS row_idx, value FROM events WHERE event_id < 20 OR event_id >= (SELECT count(*) - 5 FROM events)")
def head_and_tail(spark, folder):
    return rows.head_and_tail(_events(spark, folder).select("row_idx", "value"))


@query("SELECT event_id AS row_idx FROM events, (SELECT count(*) AS n FROM events) WHERE event_id % CAST(ceil(n / 100.0) AS BIGINT) = 0 OR event_id = n - 1")
def decimated(spark, folder):
    return rows.decimate(_events(spark, folder), 100).select("row_idx")


@query("SELECT DISTINCT CAST(floor(i * (n - 1) / 99.0 + 0.5) AS BIGINT) AS row_idx FROM range(100) r(i), (SELECT count(*) AS n FROM events)")
def decimated_evenly(spark, folder):
    return views.evenly(_events(spark, folder), 100).select("row_idx")


@query("SELECT event_id AS row_idx, 'Sample_' || (event_id + 1) AS row_name FROM events")
def sample_names(spark, folder):
    return views.sample_names(_events(spark, folder).select("row_idx"))


@query("SELECT DISTINCT c_mktsegment AS level FROM customer")
def category_levels(spark, folder):
    return spark.createDataFrame([(v,) for v in transforms.levels(_t(spark, folder, "customer"), "c_mktsegment")], "level string")


@query("SELECT 'x: no values' AS refused")
def refused_imputation(spark, folder):
    df = _gaps(spark, folder).withColumn("x", F.lit(None).cast("double"))
    try:
        transforms.impute(df, ["x"], "median_low", strict=True)
        said = []
    except ValueError:
        said = [("x: no values",)]
    return spark.createDataFrame(said, "refused string")


# --- models -------------------------------------------------------------------------------------------------------


@query("SELECT round(sum(v), 6) AS total FROM (SELECT var_samp(x) AS v FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS j FROM embeddings) GROUP BY j)")
def pca_total_variance(spark, folder):
    """The eigenvalues of 64 features add up to the sum of their variances."""
    x = _t(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    model = pca.fit(x, [f"e{i}" for i in range(64)], 10)
    return spark.createDataFrame([(float(model.eigenvalues.sum()),)], "total double").select(F.round("total", 6).alias("total"))


@query(f"WITH {_PAIR} SELECT 'PC1' AS pc, round(1 + r, 6) AS eigenvalue, round(50 * (1 + r), 5) AS ratio_pct FROM c")
def nipals_complete(spark, folder):
    model = pca.fit(_orders(spark, folder), ORDER, 1, Preprocess(scale="standard"), method="nipals")
    return _round(_round(model.variance(spark).drop("cumulative_pct"), ["eigenvalue"]), ["ratio_pct"], 5)


_LINE_GAPS = f"(SELECT l_orderkey, qty AS a, CASE WHEN l_orderkey % 11 <> 0 THEN 2 * qty END AS b FROM {ORDER_SQL})"


def _line_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Points on a line through the origin, some of them incomplete."""
    return _orders(spark, folder).select("l_orderkey", F.col("qty").alias("a"), F.when(F.col("l_orderkey") % 11 != 0, 2 * F.col("qty")).alias("b"))


@query(f"SELECT 'PC1' AS pc, round(5 * sum(a * a) / (count(*) - 1), 4) AS eigenvalue, 100.0 AS ratio_pct, 100.0 AS cumulative_pct FROM {_LINE_GAPS}")
def nipals_incomplete_variance(spark, folder):
    model = pca.fit(_line_gaps(spark, folder), ["a", "b"], 1, Preprocess(center=False), method="nipals", missing="native")
    return _round(_round(model.variance(spark), ["eigenvalue"], 4), ["ratio_pct", "cumulative_pct"])


@query(f"SELECT l_orderkey, round(sqrt(5) * a, 4) AS \"PC1\" FROM {_LINE_GAPS}")
def nipals_incomplete_scores(spark, folder):
    df = _line_gaps(spark, folder)
    model = pca.fit(df, ["a", "b"], 1, Preprocess(center=False), method="nipals", missing="native")
    return _round(model.transform(df).select("l_orderkey", "PC1"), ["PC1"], 4)


@query(f"WITH {_PAIR} SELECT round((1 - r) * pow(1.6448536269514722 * sqrt(2.0 / 3) + 1 - 2.0 / 9, 3), 6) AS q_limit_95 FROM c")
def q_limits(spark, folder):
    """With one residual component the limit's exponent is a third."""
    model = _pair_model(_orders(spark, folder), 1)
    return spark.createDataFrame([(model.q_limit(0.95),)], "q_limit_95 double").select(F.round("q_limit_95", 6).alias("q_limit_95"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_acctbal / 1000 * (c_acctbal / 1000) / 1.0001 > {limit} AS is_outlier FROM customer".format(limit=F_LIMIT))
def outlier_flags(spark, folder):
    import numpy as np

    pre = Preprocess(scale="standard", features=("c_acctbal",), means=(0.0,), deviations=(1000.0,))
    model = pca.PCAModel(pre, np.array([[1.0]]), np.array([1.0]), 100)
    return model.diagnostics(_t(spark, folder, "customer")).select(F.col("c_custkey").cast("long").alias("c_custkey"), "is_outlier")


@query(f"WITH {_PAIR} SELECT 'PC1' AS pc, round(sum(pc1 * pc1) / (count(*) - 1), 6) AS eigenvalue FROM t UNION ALL SELECT 'PC2', round(sum(pc2 * pc2) / (count(*) - 1), 6) FROM t")
def eigenvalues_of_scores(spark, folder):
    df = _orders(spark, folder)
    return _round(analysis.eigenvalues_from_scores(_pair_model(df, 2).transform(df), ["PC1", "PC2"]), ["eigenvalue"])


@query(f"WITH {_PAIR} SELECT 'PC1' AS a, 'PC1' AS b, round(var_samp(pc1) + 1e-4, 6) AS covariance FROM t UNION ALL SELECT 'PC2', 'PC2', round(var_samp(pc2) + 1e-4, 6) FROM t")
def score_covariances(spark, folder):
    df = _orders(spark, folder)
    found = analysis.score_covariance(_pair_model(df, 2).transform(df), ["PC1", "PC2"], 1e-4).where("a = b")
    return _round(found, ["covariance"])


@query(f"WITH {_PAIR} SELECT 1 + (1 - abs(r) >= 1)::INT AS kaiser, CASE WHEN 50 * (1 + r) >= 80 THEN 1 ELSE 2 END AS components_80, 'qty' AS leading FROM c")
def model_overview(spark, folder):
    found = _pair_model(_orders(spark, folder), 2)
    o = found.overview()
    import numpy as np

    leading = found.features[int(np.argmax(np.round(np.abs(found.loadings[:, 0]), 9)))]
    return spark.createDataFrame([(o["kaiser"], o["components_80"], leading)], "kaiser int, components_80 int, leading string")


_SMALL = "x AS (SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation), s AS (SELECT corr(a, b) AS r, count(*) AS n FROM x)"


@query(f"WITH {_SMALL} SELECT 'b' AS variable, 'a' AS pc, round(r, 6) AS r, n, round(pow((n - 2) / ((n - 2) + r * r * (n - 2) / (1 - r * r)), (n - 2) / 2.0), 6) AS p_value FROM s")
def correlation_p_values(spark, folder):
    df = _t(spark, folder, "nation").select(F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b"))
    return _round(correlate.eigencorrelations(df, ["a"], ["b"]), ["r", "p_value"])


_CATEGORY = "SELECT 'n_regionkey_{k}' AS variable, 'a' AS pc, round(corr(n_nationkey * n_nationkey, CASE WHEN n_regionkey = {k} THEN 1.0 ELSE 0.0 END), 6) AS r, count(*) AS n FROM nation"


@query(" UNION ALL ".join(_CATEGORY.format(k=k) for k in range(5)))
def correlations_of_categories(spark, folder):
    a = (F.col("n_nationkey") * F.col("n_nationkey")).cast("double")
    df = _t(spark, folder, "nation").select(a.alias("a"), F.col("n_regionkey").cast("string").alias("n_regionkey"))
    return _round(correlate.eigencorrelations(df, ["a"], [], ["n_regionkey"]).drop("p_value"), ["r"])


@query("WITH c AS (SELECT 'o_totalprice' AS variable, corr(o_custkey, o_totalprice) AS r FROM orders UNION ALL SELECT 'o_orderkey', corr(o_custkey, o_orderkey) FROM orders) SELECT variable, 'PC1' AS pc, round(r, 6) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, variable) AS INT) AS place FROM c")
def correlations_by_strength(spark, folder):
    df = _t(spark, folder, "orders").withColumn("PC1", F.col("o_custkey").cast("double"))
    return _round(views.by_strength(correlate.eigencorrelations(df, ["PC1"], ["o_totalprice", "o_orderkey"])), ["r"])


@query("WITH c AS (SELECT 'o_totalprice' AS variable, corr(o_custkey, o_totalprice) AS r FROM orders UNION ALL SELECT 'o_orderkey', corr(o_custkey, o_orderkey) FROM orders) SELECT variable, round(r, 6) AS r FROM c")
def correlations_by_first(spark, folder):
    df = _t(spark, folder, "orders").withColumn("PC1", F.col("o_custkey").cast("double"))
    return _round(correlate.ordered_by_first(correlate.eigencorrelations(df, ["PC1"], ["o_totalprice", "o_orderkey"])), ["r"])


def _kernels(name: str, kind: str, sql: str, how: dict) -> None:
    def run(spark, folder):
        df = _t(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 1000).alias("x"))
        return _round(kernel.kernel_pairs(df, "s_suppkey", ["s_nationkey", "x"], kind, **how), ["k"], 4)

    run.__name__ = name
    query(f"SELECT a.s_suppkey AS i, b.s_suppkey AS j, round({sql.format(d='(a.s_nationkey * b.s_nationkey + a.s_acctbal / 1000 * (b.s_acctbal / 1000))')}, 4) AS k FROM supplier a, supplier b WHERE a.s_suppkey <= b.s_suppkey")(run)


_kernels("kernel_linear_matrix", "linear", "{d}", {})
_kernels("kernel_poly_matrix", "poly", "pow(0.01 * {d} + 1, 2)", {"gamma": 0.01, "degree": 2, "coef0": 1.0})


@query("SELECT 'linear' AS kernel, round(var_samp(s_acctbal / 1000) * (count(*) - 1), 4) AS eigenvalue FROM supplier")
def kernel_pca_linear(spark, folder):
    """The centred linear kernel of one feature has its sum of squares as only eigenvalue."""
    df = _t(spark, folder, "supplier").select((F.col("s_acctbal") / 1000).alias("x"))
    return spark.createDataFrame([("linear", round(float(kernel.fit(df, ["x"], 1, kernel="linear").eigenvalues[0]), 4))], "kernel string, eigenvalue double")


# --- views --------------------------------------------------------------------------------------------------------

_ELLIPSE = "WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS cx, avg(l_tax) AS cy, var_samp(l_quantity) AS vx, var_samp(l_tax) AS vy, covar_samp(l_quantity, l_tax) AS c FROM lineitem GROUP BY 1), e AS (SELECT *, (vx + vy) / 2 AS h, sqrt(pow((vx - vy) / 2, 2) + c * c) AS g FROM s)"


@query(_ELLIPSE + " SELECT l_returnflag, 'l_quantity' AS x, 'l_tax' AS y, level, n, round(cx, 5) AS center_x, round(cy, 5) AS center_y, round(sqrt(q * (h + g)), 4) AS major FROM e, (VALUES (0.9, 4.605), (0.95, 5.991), (0.99, 9.210)) v(level, q)")
def ellipses_at_levels(spark, folder):
    found = analysis.ellipses_at_levels(_t(spark, folder, "lineitem"), "l_returnflag", [("l_quantity", "l_tax")])
    return _round(_round(found.drop("minor", "angle"), ["center_x", "center_y"], 5), ["major"], 4)


@query(_ELLIPSE + ", a AS (SELECT *, sqrt(5.991 * (h + g)) AS major, sqrt(5.991 * (h - g)) AS minor, atan2(2 * c, vx - vy) / 2 AS angle FROM e) SELECT l_returnflag, CAST(i AS INT) AS i, round(cx + major * cos(2 * pi() * i / 100) * cos(angle) - minor * sin(2 * pi() * i / 100) * sin(angle), 4) AS x, round(cy + major * cos(2 * pi() * i / 100) * sin(angle) + minor * sin(2 * pi() * i / 100) * cos(angle), 4) AS y FROM a, range(101) r(i)")
def ellipse_path(spark, folder):
    """The 95 % ellipses of lines by return flag, point by point."""
    found = correlate.ellipses(_t(spark, folder, "lineitem"), "l_returnflag", "l_quantity", "l_tax")
    return _round(correlate.ellipse_paths(found, "l_returnflag"), ["x", "y"], 4)


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS shade FROM customer")
def colour_shades(spark, folder):
    return _round(views.normalised(_t(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "shade"), ["shade"])


_PRICES = ORDER_SQL.replace("sum(l_extendedprice) AS price", "sum(l_extendedprice) / 1000 AS price")
#: Two centred features: their covariances, eigenvalues, directions (the larger entry positive), loadings and scores.
_LOADED = f"""WITH o AS (SELECT l_orderkey, qty - avg(qty) OVER () AS a, price - avg(price) OVER () AS b FROM {_PRICES}), g AS (SELECT count(*) AS n, var_samp(a) AS p, covar_samp(a, b) AS q, var_samp(b) AS s FROM o),
w AS (SELECT *, (p + s) / 2 + sqrt(pow((p - s) / 2, 2) + q * q) AS l1, (p + s) / 2 - sqrt(pow((p - s) / 2, 2) + q * q) AS l2 FROM g), d AS (SELECT *, sqrt(q * q + pow(l1 - p, 2)) AS n1, sqrt(q * q + pow(l2 - p, 2)) AS n2 FROM w),
u AS (SELECT *, q / n1 AS a1, (l1 - p) / n1 AS b1, q / n2 AS a2, (l2 - p) / n2 AS b2 FROM d), v AS (SELECT n, p, s, l1, l2, a1 * s1 AS a1, b1 * s1 AS b1, a2 * s2 AS a2, b2 * s2 AS b2 FROM (SELECT *, CASE WHEN abs(a1) >= abs(b1) THEN sign(a1) ELSE sign(b1) END AS s1, CASE WHEN abs(a2) >= abs(b2) THEN sign(a2) ELSE sign(b2) END AS s2 FROM u)),
l AS (SELECT 0 AS feature_idx, 'qty' AS feature, a1 AS x, a2 AS y, a1 * sqrt(l1 / p) AS cx, a2 * sqrt(l2 / p) AS cy FROM v UNION ALL SELECT 1, 'price', b1, b2, b1 * sqrt(l1 / s), b2 * sqrt(l2 / s) FROM v),
t AS (SELECT greatest(max(abs(a * a1 + b * b1)), max(abs(a * a2 + b * b2))) AS reach FROM o, v)"""


def _loaded(spark: SparkSession, folder: str) -> tuple[DataFrame, pca.PCAModel]:
    """Orders with prices in thousands, and a model of both components."""
    df = _orders(spark, folder).withColumn("price", F.col("price") / 1000)
    return df, pca.fit(df, ORDER, 2)


@query(_LOADED + " SELECT CAST(feature_idx AS INT) AS feature_idx, feature, 'PC1' AS pc, round(x, 6) AS value, round(cx, 6) AS correlation FROM l ORDER BY abs(x) DESC LIMIT 1")
def largest_loadings(spark, folder):
    return _round(views.largest_loadings(_loaded(spark, folder)[1].loading_rows(spark), "PC1", 1), ["value", "correlation"])


@query(_LOADED + " SELECT feature, round(x, 6) AS x, round(y, 6) AS y, round(sqrt(x * x + y * y), 6) AS magnitude FROM l")
def biplot_arrows(spark, folder):
    return _round(views.biplot_vectors(_loaded(spark, folder)[1].loading_rows(spark)).drop("feature_idx"), ["x", "y", "magnitude"])


@query(_LOADED + " SELECT feature, round(cx, 6) AS x, round(cy, 6) AS y, round(sqrt(cx * cx + cy * cy), 6) AS magnitude FROM l")
def circle_arrows(spark, folder):
    return _round(views.circle_vectors(_loaded(spark, folder)[1].loading_rows(spark)).drop("feature_idx"), ["x", "y", "magnitude"])


@query(_LOADED + ", r AS (SELECT feature, x * sqrt(l1 / (l1 + l2)) AS x, y * sqrt(l2 / (l1 + l2)) AS y FROM l, v), f AS (SELECT least(100, greatest(0.1, 0.65 * max(reach) / greatest(max(abs(x)), max(abs(y))))) AS f FROM r, t) SELECT feature, round(x * f, 4) AS x, round(y * f, 4) AS y FROM r, f")
def biplot_scaling(spark, folder):
    df, model = _loaded(spark, folder)
    return _round(views.scaled_loadings(model.loading_rows(spark), model.variance(spark), model.transform(df)).drop("feature_idx"), ["x", "y"], 4)


@query(_LOADED + ", f AS (SELECT 0.8 * max(reach) / greatest(max(abs(x)), max(abs(y))) AS f FROM l, t) SELECT feature, round(x * f, 4) AS x, round(y * f, 4) AS y FROM l, f")
def gabriel_scaling(spark, folder):
    df, model = _loaded(spark, folder)
    return _round(views.gabriel_loadings(model.loading_rows(spark), model.transform(df)).drop("feature_idx"), ["x", "y"], 4)


@query("WITH d AS (SELECT c_custkey, abs(c_acctbal) AS mahalanobis, CAST(c_custkey AS DOUBLE) AS rss FROM customer), m AS (SELECT max(mahalanobis) AS a, max(rss) AS b FROM d) SELECT c_custkey, mahalanobis, rss, round(sqrt(pow(mahalanobis / a, 2) + pow(rss / b, 2)), 6) AS distance FROM d, m ORDER BY sqrt(pow(mahalanobis / a, 2) + pow(rss / b, 2)) DESC, c_custkey LIMIT 10")
def diagnostic_labels(spark, folder):
    df = _t(spark, folder, "customer").select("c_custkey", F.abs("c_acctbal").alias("mahalanobis"), F.col("c_custkey").cast("double").alias("rss"))
    return _round(views.diagnostic_labels(df, 10, "c_custkey"), ["distance"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 AND c_nationkey > 12 THEN 'bad leverage' WHEN c_acctbal > 5000 THEN 'good leverage' WHEN c_nationkey > 12 THEN 'orthogonal' ELSE 'regular' END AS kind, CASE WHEN c_nationkey >= 12 THEN 'top' ELSE 'bottom' END || ' ' || CASE WHEN c_acctbal >= 0 THEN 'right' ELSE 'left' END AS place FROM customer")
def quadrant_kinds(spark, folder):
    df = _t(spark, folder, "customer").select("c_custkey", F.col("c_acctbal").alias("t2"), F.col("c_nationkey").alias("rss"), (F.col("c_nationkey") - 12).alias("y"))
    return views.quadrants(df, 5000, 12).select("c_custkey", "kind", views.label_place("t2", "y").alias("place"))


@query(f"WITH {_PAIR} SELECT CAST(1 AS INT) AS component, round(50 * (1 + r), 5) AS ratio_pct, round(50 * (1 + r), 5) AS cumulative_pct, printf('PC1 (%.1f%%)', 50 * (1 + r)) AS label FROM c UNION ALL SELECT 2, round(50 * (1 - r), 5), 100.0, printf('PC2 (%.1f%%)', 50 * (1 - r)) FROM c")
def scree_table(spark, folder):
    return _round(views.scree(_pair_model(_orders(spark, folder), 2).variance(spark)), ["ratio_pct", "cumulative_pct"], 5)


@query(_LOADED + " SELECT feature, round(x, 6) AS x, round(y, 6) AS y, CAST(NULL AS DOUBLE) AS z FROM l")
def space_arrows(spark, folder):
    return _round(views.space_vectors(_loaded(spark, folder)[1].loading_rows(spark)).drop("feature_idx", "magnitude"), ["x", "y"])


@query(f"WITH {_PAIR} SELECT l_orderkey, round(pc1, 5) AS \"PC1\", round(pc1 * pc1 / (1 + r + 1e-4), 5) AS t2 FROM t WHERE l_orderkey > 40")
def whole_analysis(spark, folder):
    """The whole analysis in one call; keys below 41 are taken out of its result, not of its input."""
    df = _orders(spark, folder).withColumn("group", F.when(F.col("disc") > 0.05, "high").otherwise("low"))
    found = analysis.analyse(df, ORDER, 1, Preprocess(scale="standard"), numeric=["disc"], group="group")
    return _round(found.scores.where("l_orderkey > 40").select("l_orderkey", "PC1", "t2"), ["PC1", "t2"], 5)


@query("SELECT CASE WHEN event_id % 10 = 9 THEN 'x' ELSE NULL END AS t, count(*) AS n FROM events GROUP BY 1")
def analysis_drops_rows(spark, folder):
    """Rows that are dropped for missing features take their metadata with them."""
    df = _t(spark, folder, "events").select(F.col("event_id").alias("row_idx"), "value", F.col("event_id").cast("double").alias("k"), F.when(F.col("event_id") % 10 == 9, "x").alias("t"))
    found = analysis.analyse(df, ["value", "k"], 2, missing="drop")
    return found.scores.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
