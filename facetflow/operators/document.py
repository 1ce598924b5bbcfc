"""An analysis as one JSON document: model, scores, diagnostics of rows, and preserved columns.

The document is written as ordered lines of text by the tasks that hold the rows: each row gives a line for every array it
has a cell in, lines are put in range order of (array, row), and the texts between arrays are lines of their own. The
part files in order are the document; ``joined`` copies them to one file as a stream.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetflow.operators.analysis import Analysis
from facetflow.operators.pca import PCAModel
from facetflow.sources.scratch import for_a_while

METRICS = {"hotelling_t2": "t2", "mahalanobis": "mahalanobis", "rss": "rss", "is_outlier": "is_outlier"}
_HEAD = '"results": {"samples": {"names": ['


def _text(c: Column) -> Column:
    """A cell as JSON: null for null and for numbers that JSON lacks."""
    inner = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    plain = F.coalesce(F.substr(inner, F.lit(2), F.length(inner) - 2), F.lit("null"))
    return F.when(plain.isin('"NaN"', '"Infinity"', '"-Infinity"'), F.lit("null")).otherwise(plain)


def write(found: Analysis, path: str, names: str | None = None, order: str = "row_idx", metrics: bool = True, preserved: list[str] = (), description: str = "", software: str = "facetflow") -> None:
    """The document as part files below ``path``. names: column of row names (else their numbers); order: column of row
    order. preserved: further columns of the scores, numbers as targets and others as categories."""
    if not isinstance(found.model, PCAModel):
        raise ValueError("documents are of linear models; see analysis.save for kernel models")
    scores, model = found.scores, found.model.document(description, software)
    kinds = dict(scores.dtypes)
    numeric = [c for c in preserved if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")]
    categorical = [c for c in preserved if c not in numeric]
    arrays: list[tuple[str, Column]] = []  # the text before each array, and its cells
    head = ", ".join(f"{json.dumps(k)}: {json.dumps(model[k])}" for k in ("metadata", "preprocessing", "model"))
    arrays.append(("{" + head + ", " + _HEAD, _text(F.coalesce(F.col(f"`{names}`").cast("string"), F.lit("")) if names else F.col(order).cast("string"))))
    row = F.concat(F.lit("["), F.array_join(F.array(*[_text(F.col(p)) for p in found.model.labels]), ", "), F.lit("]"))
    arrays.append(('], "scores": [', row))
    closing = "]}"
    own = {k: c for k, c in METRICS.items() if metrics and c in kinds}
    for i, (k, c) in enumerate(own.items()):
        arrays.append((("]}, " + '"metrics": {' if i == 0 else "], ") + f'"{k}": [', _text(F.col(c))))
    closing = ("]}}" if own else closing + "}") + ', "diagnostics": ' + json.dumps(model["diagnostics"])
    groups = [("categorical", categorical, "string"), ("numericTarget", numeric, "double")]
    opened = False
    for group, columns, kind in groups:
        for i, c in enumerate(columns):
            before = "], " if i else (closing + ', "preservedColumns": {' if not opened else "]}, ") + json.dumps(group) + ": {"
            arrays.append((before + json.dumps(c) + ": [", _text(F.col(f"`{c}`").cast(kind))))
            opened = True
    closing = "]}}}" if opened else closing + "}"
    cells = F.array(*[F.struct(F.lit(2 * i + 1).alias("section"), cell.alias("value")) for i, (_, cell) in enumerate(arrays)])
    # the scores are worked out once, not again for their first row and for the ranges
    with for_a_while(scores.select(*[F.col(f"`{c}`") for c in dict.fromkeys([order, *([names] if names else []), *found.model.labels, *own.values(), *preserved])])) as settled:
        _written(settled, order, cells, arrays, closing, path)


def _written(scores: DataFrame, order: str, cells: Column, arrays: list[tuple[str, Column]], closing: str, path: str) -> None:
    first = scores.agg(F.min(order)).first()[0]
    lines = scores.select(F.col(order).alias("at"), F.explode(cells).alias("c")).select("c.section", "at", F.concat(F.when(F.col("at") > first, ",").otherwise(""), "c.value").alias("value"))
    between = [(2 * i, 0, text) for i, (text, _) in enumerate(arrays)] + [(2 * len(arrays), 0, closing)]
    between = scores.sparkSession.createDataFrame(between, "section int, at long, value string")
    lines.select("section", F.col("at").cast("long").alias("at"), "value").unionByName(between).repartitionByRange("section", "at").sortWithinPartitions("section", "at").select("value").write.text(path)


def joined(spark: SparkSession, path: str, target: str) -> None:
    """The part files below ``path`` as one file; the driver copies a buffer at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, to = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    files = source.getFileSystem(conf)
    parts = sorted(str(f.getPath()) for f in files.listStatus(source) if f.getPath().getName().startswith("part-"))
    out = to.getFileSystem(conf).create(to, True)
    try:
        for part in parts:
            stream = files.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
    finally:
        out.close()


def load(spark: SparkSession, path: str) -> PCAModel:
    """The model of a document that write() has made, from its first line alone."""
    head = spark.read.text(path).where(F.col("value").startswith('{"metadata"') & F.col("value").endswith(_HEAD)).limit(1).collect()
    if not head:
        raise ValueError("no document")
    return PCAModel.from_json(head[0]["value"] + "]}}}")


def saved_scores(spark: SparkSession, path: str, k: int) -> DataFrame:
    """position (from 0), PC1 to PCk of a document that write() has made, read by the tasks: its score lines alone begin
    with a bracket and end with one, and follow each other, so a line's place is told by the first one of its split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    rows = lines.where(F.col("value").rlike(r"^,?\[.*\]$"))
    parts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row a split
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = rows.join(F.broadcast(parts.select("file", "start", (before - F.col("first")).alias("shift"))), ["file", "start"])
    placed = placed.select((F.col("at") + F.col("shift")).alias("position"), F.from_json(F.ltrim("value", F.lit(",")), "array<double>").alias("x"))
    return placed.select("position", *[F.get("x", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)])


def problems(document: dict, software: str | None = None) -> list[str]:
    """What keeps a parsed document from being one: fields that are missing or of another kind."""
    found = []

    def asked(name: str, fields: tuple[str, ...]) -> dict:
        part = document
        for key in name.split(".") if name else ():
            part = part.get(key) if isinstance(part, dict) else None
        if not isinstance(part, dict):
            found.append(f"{name} must be an object")
            return {}
        found.extend(f"{name}.{f} is required".lstrip(".") for f in fields if f not in part)
        return part

    def is_matrix(name: str, x: object) -> None:
        if not isinstance(x, list) or (x and not isinstance(x[0], list)):
            found.append(f"{name} must be a list of lists")

    asked("", ("metadata", "preprocessing", "model", "results"))
    metadata = asked("metadata", ("analysis_id", "software_version", "created_at", "software", "config"))
    if software and metadata.get("software", software) != software:
        found.append(f"metadata.software must be {software}")
    asked("metadata.config", ("method", "n_components"))
    flags = ("mean_center", "standard_scale", "robust_scale", "scale_only", "snv", "vector_norm")
    preprocessing = asked("preprocessing", (*flags, "parameters"))
    found += [f"preprocessing.{f} must be true or false" for f in flags if f in preprocessing and not isinstance(preprocessing[f], bool)]
    model = asked("model", ("loadings", "explained_variance", "explained_variance_ratio", "cumulative_variance", "component_labels", "feature_labels"))
    if "loadings" in model:
        is_matrix("model.loadings", model["loadings"])
    samples = asked("results.samples", ("names", "scores"))
    if "scores" in samples:
        is_matrix("results.samples.scores", samples["scores"])
    return found
