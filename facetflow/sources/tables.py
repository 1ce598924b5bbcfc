"""Delimited text with loose conventions as typed tables, and the ways out.

A table read here has ``row_idx`` (long, from 0, in the order of files by name and lines), ``row_name`` where the first column names rows,
numeric columns as double, others as text. Roles stand in the fields' metadata under ``role``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from facetflow.functions.numbers import READER_TOKENS, finite_or_null, is_missing, is_numeric, parse_number
from facetflow.sources import quoted


#: Blocks of files whose row numbers are broadcast, at most.
BLOCKS = 100_000


@dataclass(frozen=True)
class ReadOptions:
    delimiter: str = ","
    decimal: str = "."
    header: bool = True
    row_names: bool = True
    tokens: tuple[str, ...] = READER_TOKENS
    targets: tuple[str, ...] = ()
    skip_rows: int = 0
    max_rows: int | None = None
    columns: tuple[str, ...] = ()
    sample_rows: int | None = 10
    multi_line: bool = False


DEFAULT = ReadOptions()
EUROPEAN = replace(DEFAULT, delimiter=";", decimal=",")
TAB = replace(DEFAULT, delimiter="\t")


def sniff(spark: SparkSession, path: str) -> ReadOptions:
    """Delimiter by counts in the first five lines; decimal commas with semicolons; a header if row 1 has fewer numbers."""
    lines = [r["value"] for r in spark.read.text(path).limit(5).collect()]
    if len(lines) < 2:
        raise ValueError("too few lines to tell the format")
    counts = {d: sum(x.count(d) for x in lines) for d in (",", ";", "\t")}
    out = DEFAULT
    if counts[";"] > max(counts[","], counts["\t"]):
        out = replace(out, delimiter=";", decimal="," if counts[","] else ".")
    elif counts["\t"] > max(counts[","], counts[";"]):
        out = TAB

    def numbers(line: str) -> int:
        found = 0
        for cell in line.split(out.delimiter):
            try:
                float(cell.strip().replace(",", ".") if out.decimal == "," else cell.strip())
                found += 1
            except ValueError:
                pass
        return found

    return replace(out, header=numbers(lines[0]) < numbers(lines[1]))


def with_row_index(df: DataFrame) -> DataFrame:
    """row_idx for a table read from files: a place within a file's block and the rows of the blocks before it.

    Blocks are read in one go, so ids within them are consecutive. What is summed up is a row a block; these are broadcast
    only up to BLOCKS of them.
    """
    placed = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"))
    blocks = placed.groupBy("__f", "__b").agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    shifts = blocks.select("__f", "__b", (before - F.col("__first")).alias("__shift"))
    few = placed.select("__f", "__b").distinct().limit(BLOCKS + 1).count() <= BLOCKS
    out = placed.join(F.broadcast(shifts) if few else shifts, ["__f", "__b"])
    return out.select((F.col("__i") + F.col("__shift")).alias("row_idx"), *_columns(df.columns))


def _columns(names: list[str]) -> list[Column]:
    """Columns by their names as a whole, which may hold dots."""
    return [_column(c) for c in names]


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_text(spark: SparkSession, path: str, options: ReadOptions = DEFAULT, ragged: str | None = None) -> DataFrame:
    """All cells as trimmed text, with row_idx, and row_name if the first column names rows.

    Rows of another width are padded or cut; ``ragged`` names a column that holds the raw text of such rows, else null.
    """
    how = {"sep": options.delimiter, "header": options.header, "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, }
    if options.multi_line:
        df = quoted.rows(spark, path, options.delimiter, options.header, ragged)
        return _chosen(df, options, ragged)
    df = spark.read.csv(path, inferSchema=False, **how)
    if ragged:
        kind = StructType([*[StructField(c, StringType()) for c in df.columns], StructField(ragged, StringType())])
        df = spark.read.schema(kind).csv(path, columnNameOfCorruptRecord=ragged, enforceSchema=True, **how)
    return _chosen(with_row_index(df), options, ragged)


def _chosen(df: DataFrame, options: ReadOptions, ragged: str | None) -> DataFrame:
    """The rows and columns that the options ask for."""
    names = [c for c in df.columns[1:] if c != ragged]
    if options.row_names and names:
        df = df.withColumnRenamed(names[0], "row_name")
        names = names[1:]
    if options.skip_rows:
        df = df.where(F.col("row_idx") >= options.skip_rows).withColumn("row_idx", F.col("row_idx") - options.skip_rows)
    if options.max_rows is not None:
        df = df.where(F.col("row_idx") < options.max_rows)
    keep = [c for c in names if not options.columns or c in options.columns]
    return df.select("row_idx", *(["row_name"] if options.row_names and "row_name" in df.columns else []), *_columns(keep), *([ragged] if ragged else []))


def read_wizard(spark: SparkSession, path: str, delimiter: str = ",", header_row: int = 0, row_name_column: str | None = None, columns: tuple[str, ...] = (), max_rows: int | None = None) -> DataFrame:
    """Text cells of a file whose header is record ``header_row`` (from 0, empty lines not counted); those above it are left out.

    Quoted cells may hold newlines.
    """
    rows = quoted.rows(spark, path, delimiter, header_place=header_row)
    names = [c for c in rows.columns if c != "row_idx"]
    if row_name_column is not None and row_name_column not in names:
        raise ValueError(f"no such column: {row_name_column}")
    if max_rows is not None:
        rows = rows.where(F.col("row_idx") < max_rows)
    keep = [c for c in names if c != row_name_column and (not columns or c in columns)]
    return rows.select("row_idx", *([_column(row_name_column).alias("row_name")] if row_name_column else []), *_columns(keep))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines, with row_idx."""
    return with_row_index(spark.read.json(path))


def format_of(name: str, head: bytes = b"") -> str:
    """csv, tsv, excel or json, by the name's ending, else by the first bytes."""
    ending = name.rpartition(".")[2].lower() if "." in name else ""
    known = {"csv": "csv", "tsv": "tsv", "xlsx": "excel", "xls": "excel", "json": "json"}
    if ending in known:
        return known[ending]
    if head.startswith((b"\xd0\xcf\x11\xe0", b"PK\x03\x04")):
        return "excel"
    text = head[:512].decode("utf-8", "replace").strip()
    if text.startswith(("{", "[")):
        return "json"
    return "tsv" if text.count("\t") > 2 * text.count(",") else "csv"


def file_format(spark: SparkSession, path: str) -> str:
    """format_of() for one file, by Spark's reader."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 512).alias("head")).first()
    return format_of(path, bytes(head["head"]) if head else b"")


@dataclass
class Preview:
    rows: DataFrame
    roles: dict[str, str]
    n_rows: int
    n_columns: int


def preview(spark: SparkSession, path: str, options: ReadOptions = DEFAULT, most: int = 100) -> Preview:
    """The first rows of a file, the roles of its columns, and its size."""
    text = read_text(spark, path, options)
    data = [c for c in text.columns if c not in ("row_idx", "row_name")]
    return Preview(text.where(F.col("row_idx") < most), infer_roles(text, replace(options, sample_rows=most)), text.count(), len(data))


def is_target(column: str, targets: tuple[str, ...] = ()) -> bool:
    return column.lower().rstrip().endswith("#target") or column in targets


def infer_roles(text: DataFrame, options: ReadOptions = DEFAULT) -> dict[str, str]:
    """numeric, categorical or target by column; from the first ``sample_rows`` rows, or all where that is None."""
    columns = [c for c in text.columns if c not in ("row_idx", "row_name")]
    if not columns:
        return {}
    rows = text if options.sample_rows is None else text.where(F.col("row_idx") < options.sample_rows)
    s = rows.agg(*[F.coalesce(F.every(is_numeric(F.coalesce(_column(c), F.lit("")), options.decimal, options.tokens)), F.lit(True)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: "target" if is_target(c, options.targets) else "numeric" if s[f"c{i}"] else "categorical" for i, c in enumerate(columns)}


def read_mixed(spark: SparkSession, path: str, options: ReadOptions = DEFAULT) -> DataFrame:
    """Typed table with roles; later cells of a numeric column that are no numbers are null."""
    text = read_text(spark, path, options)
    roles = infer_roles(text, options)

    def typed(c: str):
        if roles.get(c) in ("numeric", "target"):
            number = parse_number(_column(c), options.decimal, options.tokens)
            return number.alias(c, metadata={"role": roles[c]})
        if c in roles:
            return F.when(~is_missing(_column(c), options.tokens, any_case=False), _column(c)).alias(c, metadata={"role": roles[c]})
        return _column(c)

    return text.select(*[typed(c) for c in text.columns])


def read_numeric(spark: SparkSession, path: str, options: ReadOptions = DEFAULT) -> DataFrame:
    """All columns as numbers; cells that are neither numbers nor missing, and rows of another width, raise."""
    text = read_text(spark, path, options, ragged="__ragged")
    columns = [c for c in text.columns if c not in ("row_idx", "row_name", "__ragged")]
    ok = lambda c: is_numeric(F.coalesce(_column(c), F.lit("")), options.decimal, options.tokens)
    bad = text.agg(F.count("__ragged").alias("ragged"), F.count("row_idx").alias("n"), *[F.count(F.when(~ok(c), 1)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    if bad["ragged"]:
        raise ValueError(f"{bad['ragged']} rows have another number of cells than the header")
    wrong = [c for i, c in enumerate(columns) if bad[f"c{i}"]]
    if wrong:
        raise ValueError(f"not numeric: {wrong}")
    return text.select(*[parse_number(_column(c), options.decimal, options.tokens).alias(c) if c in columns else _column(c) for c in text.columns if c != "__ragged"])


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The first of default, European and tab conventions that gives numeric columns."""
    for options in (DEFAULT, EUROPEAN, TAB):
        df = read_mixed(spark, path, options)
        if any((f.metadata or {}).get("role") == "numeric" for f in df.schema):
            return df
    raise ValueError("no convention gives numeric columns")


def features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if (f.metadata or {}).get("role") == "numeric"]


def write_csv(df: DataFrame, path: str, options: ReadOptions = DEFAULT, digits: int | None = None, nan: str | None = None) -> None:
    """Rows with missing cells as the first token, infinities as Inf; row_idx is left out, the header over row_name is empty.

    digits: fixed decimals, else the shortest form. nan: text of NaN, which by default counts as missing.
    """

    def cell(c: str, t: str):
        if t not in ("double", "float"):
            return _column(c)
        x = _column(c)
        text = F.format_string(f"%.{digits}f", x) if digits is not None else x.cast("string")
        text = F.replace(text, F.lit("."), F.lit(",")) if options.decimal == "," else text
        return F.when(F.isnan(x), F.lit(nan)).when(x == float("inf"), "Inf").when(x == float("-inf"), "-Inf").otherwise(text).alias(c)

    rows = df.drop("row_idx")
    rows = rows.select(*[cell(c, t) for c, t in rows.dtypes])
    if options.row_names and "row_name" in rows.columns:
        rows = rows.select(F.col("row_name").alias(" "), *[c for c in rows.columns if c != "row_name"])
    rows.write.csv(path, sep=options.delimiter, header=options.header, nullValue=options.tokens[0], emptyValue="", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def scores_json(scored: DataFrame, name: str, components: list[str]) -> DataFrame:
    """One JSON text a row: id and scores by component, NaN and infinities as null."""
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in components]), F.array(*[finite_or_null(F.col(c)) for c in components]))
    return scored.select(F.to_json(F.struct(F.col(name).cast("string").alias("id"), pairs.alias("scores"))).alias("value"))
