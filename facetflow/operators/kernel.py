"""Kernel matrices and kernel PCA.

Up to MOST_ROWS training rows are broadcast, and a model keeps them. The kernel, rows x rows, never
exists as a whole beyond LOCAL_ROWS: tasks make blocks of its rows and multiply them with a few vectors, and the leading
eigenvectors are found in the space of such products (a block Krylov space, a job a step), so the driver holds rows x a
few dozen numbers. New rows are scored in Arrow batches against the training rows.

Beyond MOST_ROWS the kernel is factored by pivots: products of rows' kernels with at most MOST_RANK of the rows stand for
the whole, up to a remainder whose trace all rows are asked for in each round; it bounds the error of every eigenvalue.
Rows stay with the tasks then, work grows with rows x pivots, and the model keeps the pivots alone.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from facetflow.operators.pca import gathered_moments, signed
from facetflow.operators.preprocess import Preprocess
from facetflow.sources.scratch import for_a_while, settled

MOST_ROWS = 10_000
#: Pivots of a factored kernel, at most, the remainder, as a share of the kernel's trace, at which it is factored, and rows
#: that a task proposes as pivots in a round.
MOST_RANK, REMAINDER, PROPOSED, ROUNDS = 2_048, 1e-11, 256, 60
#: Rows of a kernel matrix whose other side is broadcast, and pairs that a task makes, about.
BROADCAST_ROWS, TASK_PAIRS = 500_000, 20_000_000
#: Rows up to which the kernel is made and decomposed at once.
LOCAL_ROWS = 1_000
#: Rows of a block of the kernel, and the residual, as a share of the leading eigenvalue, at which a vector is found.
BLOCK_ROWS, TOLERANCE, STEPS = 512, 1e-10, 60
LEAST_EIGENVALUE = 1e-10


def matrix(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if kernel == "linear":
        return a @ b.T
    if kernel in ("poly", "polynomial"):
        return (gamma * (a @ b.T) + coef0) ** degree
    if kernel == "rbf":
        return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
    raise ValueError("kernel is rbf, linear or poly")


def kernel_pairs(df: DataFrame, key: str, features: list[str], kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0, whole: bool = False) -> DataFrame:
    """i, j, k of all pairs i <= j of a table, as rows of a table, made by as many tasks as their number asks for; whole: of
    all pairs, those of a row i by one task up to BROADCAST_ROWS rows."""
    size = df.count()
    tasks = max(1, -(-size * size // TASK_PAIRS))
    a = df.select(F.col(key).alias("i"), *[F.col(c).alias(f"a{n}") for n, c in enumerate(features)])
    b = df.select(F.col(key).alias("j"), *[F.col(c).alias(f"b{n}") for n, c in enumerate(features)])
    dot = sum((F.col(f"a{n}") * F.col(f"b{n}") for n in range(len(features))), F.lit(0.0))
    apart = sum(((F.col(f"a{n}") - F.col(f"b{n}")) * (F.col(f"a{n}") - F.col(f"b{n}")) for n in range(len(features))), F.lit(0.0))
    value = {"rbf": F.exp(-gamma * apart), "linear": dot, "poly": F.pow(gamma * dot + coef0, F.lit(float(degree)))}[{"polynomial": "poly"}.get(kernel, kernel)]
    which = F.lit(True) if whole else F.col("i") <= F.col("j")
    if size <= BROADCAST_ROWS:
        pairs = (a.repartition(min(tasks, size)) if tasks > 1 else a).join(F.broadcast(b), which)
    else:  # tasks take a part of either side
        side = math.isqrt(tasks - 1) + 1
        pairs = a.repartition(side).join(b.repartition(side).hint("shuffle_replicate_nl"), which)
    return pairs.select("i", "j", value.alias("k"))


def rbf_pairs(df: DataFrame, key: str, features: list[str], gamma: float) -> DataFrame:
    return kernel_pairs(df, key, features, "rbf", gamma)


def row_means(df: DataFrame, key: str, features: list[str], kernel: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 0.0) -> DataFrame:
    """i, m, n: the mean of each row of the kernel matrix and its number of cells. A row's cells are made where they are
    summed up, so what is shuffled grows with the rows, not with rows times tasks."""
    return kernel_pairs(df, key, features, kernel, gamma, degree, coef0, whole=True).groupBy("i").agg(F.avg("k").alias("m"), F.count("k").alias("n"))


def centered(pairs: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """i, j, k, kc: the kernel matrix (upper triangle) and its double centring.

    Means (``row_means``, else taken from the pairs: then a row a task and row of the matrix is shuffled) are settled; pairs
    are made anew for the result and meet broadcast means, so they are never shuffled up to BROADCAST_ROWS rows.
    """
    if means is None:
        sides = F.when(F.col("i") != F.col("j"), F.array("i", "j")).otherwise(F.array("i"))
        means = pairs.select(F.explode(sides).alias("i"), "k").groupBy("i").agg(F.avg("k").alias("m"), F.count("k").alias("n"))
    rows = settled(means)
    total = rows.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("t"))
    few = rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = F.broadcast if few else lambda x: x
    out = pairs.join(own(rows.select("i", F.col("m").alias("mi"))), "i").join(own(rows.select(F.col("i").alias("j"), F.col("m").alias("mj"))), "j")
    return out.crossJoin(F.broadcast(total)).select("i", "j", "k", (F.col("k") - F.col("mi") - F.col("mj") + F.col("t")).alias("kc"))  # one row


@dataclass
class KernelModel:
    preprocess: Preprocess
    train: np.ndarray
    vectors: np.ndarray
    eigenvalues: np.ndarray
    how: tuple[str, float, int, float]
    means: np.ndarray
    #: Sum of all eigenvalues.
    total: float | None = None
    #: Of a factored kernel: what is taken from the products of a row's kernel with the pivots, which stand in ``train``,
    #: and the weights, which stand in ``vectors``; means are of no use then.
    shift: np.ndarray | None = None

    @property
    def ratios(self) -> np.ndarray:
        return 100 * self.eigenvalues[: self.vectors.shape[1]] / (self.total or self.eigenvalues.sum())

    def to_json(self) -> str:
        """All that scoring asks for; the training rows are part of it."""
        return json.dumps({
            "kind": "kernel", "preprocess": asdict(self.preprocess), "train": self.train.tolist(), "vectors": self.vectors.tolist(), "eigenvalues": self.eigenvalues.tolist(),
            "kernel": dict(zip(("type", "gamma", "degree", "coef0"), self.how, strict=True)), "means": self.means.tolist(), "total": self.total,
            "shift": None if self.shift is None else self.shift.tolist(),
        })

    @staticmethod
    def from_json(text: str) -> KernelModel:
        d = json.loads(text)
        missing = [k for k in ("preprocess", "train", "vectors", "eigenvalues", "kernel", "means") if k not in d]
        if missing:
            raise ValueError(f"not a kernel model, without {missing}")
        pre = Preprocess(**{k: tuple(v) if isinstance(v, list) else v for k, v in d["preprocess"].items()})
        train, vectors, values, means = (np.array(d[k], float) for k in ("train", "vectors", "eigenvalues", "means"))
        if train.ndim != 2 or vectors.ndim != 2 or len(vectors) != len(train) or (d.get("shift") is None and len(means) != len(train)) or train.shape[1] != len(pre.features) or len(values) < vectors.shape[1]:
            raise ValueError("training rows, vectors, eigenvalues and features don't match")
        how = d["kernel"]
        return KernelModel(pre, train, vectors, values, (how["type"], how["gamma"], how["degree"], how["coef0"]), means, d.get("total"), None if d.get("shift") is None else np.array(d["shift"], float))

    def variance(self, spark: SparkSession) -> DataFrame:
        """pc, eigenvalue, ratio_pct, cumulative_pct."""
        ratios = self.ratios
        rows = [(f"PC{i + 1}", float(self.eigenvalues[i]), float(r), float(c)) for i, (r, c) in enumerate(zip(ratios, np.cumsum(ratios), strict=True))]
        return spark.createDataFrame(rows, "pc string, eigenvalue double, ratio_pct double, cumulative_pct double")

    def transform(self, df: DataFrame, compat: bool = False) -> DataFrame:
        """``df`` with PC1 to PCk: centred kernel times vector by sqrt(eigenvalue); compat: by eigenvalue again, as some
        implementations give for training rows."""
        k = self.vectors.shape[1]
        again = self.eigenvalues[:k] if compat else 1
        weights = self.vectors / again if self.shift is not None else self.vectors / np.sqrt(self.eigenvalues[:k]) / again
        train, means, how, shift = self.train, self.means, self.how, None if self.shift is None else self.shift / again
        schema = StructType([*df.schema.fields, *[StructField(f"PC{i + 1}", DoubleType()) for i in range(k)]])
        extra = self.preprocess.prepared(df).select(*[F.col(f"`{c}`") for c in df.columns], *[e.alias(f"__k{i}") for i, e in enumerate(self.preprocess.expressions())])
        m, width = train.shape[1], len(df.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    x = np.stack([b.column(width + j).to_numpy(zero_copy_only=False) for j in range(m)], 1)
                    g = matrix(x, train, *how)
                    t = g @ weights - shift if shift is not None else (g - g.mean(1, keepdims=True) - means + means.mean()) @ weights
                    yield pa.RecordBatch.from_arrays([*b.columns[:width], *[pa.array(t[:, i], from_pandas=True) for i in range(k)]], names=schema.names)

        return extra.mapInArrow(run, schema)


def fit(df: DataFrame, features: list[str], k: int = 2, kernel: str = "rbf", gamma: float | None = None, degree: int = 3, coef0: float = 0.0, preprocess: Preprocess | None = None, local_rows: int = LOCAL_ROWS) -> KernelModel:
    """gamma: by default one by the number of features. Of preprocessing only scale_only, snv and vector_norm apply."""
    given = preprocess or Preprocess(center=False)
    pre = Preprocess(center=False, scale_only=given.scale_only, snv=given.snv, vector_norm=given.vector_norm).fit(df, features)
    all_rows = pre.prepared(df).select(*[e.cast("double").alias(f"x{i}") for i, e in enumerate(pre.expressions())]).na.drop()
    rows = all_rows.limit(MOST_ROWS + 1).collect()
    if len(rows) < 2 or not 1 <= k <= len(rows):
        raise ValueError("too few rows")
    if degree < 1 or (gamma is not None and gamma <= 0):
        raise ValueError("gamma and degree must be positive")
    x = np.array(rows, float)
    how = (kernel, gamma or 1 / len(features), degree, coef0)
    if len(x) > MOST_ROWS:
        with for_a_while(all_rows.repartition(df.sparkSession.sparkContext.defaultParallelism)) as table:
            return _factored(table, x, pre, how, k)
    if len(x) > local_rows:
        return KernelModel(pre, x, *_leading(df.sparkSession, x, how, k))
    g = matrix(x, x, *how)
    means = g.mean(0)
    values, vectors = np.linalg.eigh(g - means - means[:, None] + means.mean())
    values, vectors = np.maximum(values[::-1], LEAST_EIGENVALUE), signed(vectors[:, ::-1])
    if not math.isfinite(values.sum()):
        raise ArithmeticError("the kernel isn't finite")
    return KernelModel(pre, x, vectors[:, :k], values, how, means, float(values.sum()))


def _products(spark: SparkSession, x: Broadcast, how: tuple[str, float, int, float], v: np.ndarray) -> tuple[np.ndarray, float]:
    """Kernel times v, and the sum of the kernel's diagonal, from blocks of rows made in tasks."""
    n, width = len(x.value), v.shape[1]
    sent = spark.sparkContext.broadcast(v)
    blocks = -(-n // BLOCK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vectors = x.value, sent.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
                g = matrix(rows[at], rows, *how)
                own = np.arange(len(g))
                yield pa.RecordBatch.from_pydict({"block": [block], "product": [(g @ vectors).tobytes()], "diagonal": [float(g[own, own + at.start].sum())]})

    parts = spark.range(0, blocks, 1, blocks).mapInArrow(run, "block long, product binary, diagonal double").orderBy("block").collect()  # n x width numbers
    sent.destroy()
    return np.concatenate([np.frombuffer(p["product"]).reshape(-1, width) for p in parts]), sum(p["diagonal"] for p in parts)


def _leading(spark: SparkSession, rows: np.ndarray, how: tuple[str, float, int, float], k: int) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray, float]:
    """Vectors, eigenvalues, how, row means and the sum of eigenvalues of the centred kernel.

    A block Krylov space grows by the kernel's product with its newest block until the k leading pairs of the kernel
    within it have settled. The sum is the centred kernel's trace; kernels with negative eigenvalues, which only a
    polynomial one has, count them in it.
    """
    x, n = spark.sparkContext.broadcast(rows), len(rows)
    sums, diagonal = _products(spark, x, how, np.full((n, 1), 1.0 / n))
    means = sums[:, 0]
    whole = float(means.mean())
    trace = diagonal - n * whole
    if not math.isfinite(trace) or not np.isfinite(means).all():
        raise ArithmeticError("the kernel isn't finite")

    def centred(v: np.ndarray) -> np.ndarray:
        g, _ = _products(spark, x, how, v)
        across = v.sum(0)
        return g - means @ v - np.outer(means, across) + whole * across

    width = min(n, max(k + 4, 8))
    block = np.random.Generator(np.random.PCG64(5)).standard_normal((n, width))
    block = np.linalg.qr(block - block.mean(0))[0]
    basis, images = block, centred(block)
    for _ in range(STEPS):
        small = basis.T @ images
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][: min(k, len(values))]
        vectors, values = basis @ turned[:, order], values[order]
        rest = np.linalg.norm(images @ turned[:, order] - vectors * values, axis=0)
        if (rest <= TOLERANCE * max(abs(values[0]), LEAST_EIGENVALUE)).all() or basis.shape[1] + width > n:
            break
        new = images[:, -width:]
        for _ in range(2):  # once more for what rounding has left
            new = new - basis @ (basis.T @ new)
        left, sizes, _ = np.linalg.svd(new, full_matrices=False)
        # what is left of products within the space is rounding, as large as their own size says, and no direction
        block = left[:, sizes > 1e-12 * max(np.linalg.norm(images[:, -width:], 2), LEAST_EIGENVALUE)]
        if not block.shape[1]:
            break
        block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
        width = block.shape[1]
        basis, images = np.hstack([basis, block]), np.hstack([images, centred(block)])
    else:
        raise ArithmeticError("the kernel's vectors did not settle")
    x.destroy()
    return signed(vectors), np.maximum(values, LEAST_EIGENVALUE), how, means, max(trace, LEAST_EIGENVALUE)


def _diagonal(x: np.ndarray, how: tuple[str, float, int, float]) -> np.ndarray:
    kernel, gamma, degree, coef0 = how
    own = (x**2).sum(1)
    return np.ones(len(x)) if kernel == "rbf" else own if kernel == "linear" else (gamma * own + coef0) ** degree


def _coordinates(x: np.ndarray, pivots: np.ndarray, factor: np.ndarray, how: tuple[str, float, int, float]) -> np.ndarray:
    """Rows whose products with each other are the kernel, but for the remainder."""
    return np.linalg.solve(factor, matrix(pivots, x, *how)).T if len(pivots) else np.zeros((len(x), 0))


def _more_pivots(x: np.ndarray, pivots: np.ndarray, factor: np.ndarray, how: tuple[str, float, int, float], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and the triangular factor of their kernel: to the known ones, the row of ``x`` with the largest remainder is
    added again and again, until none is larger than ``least``."""
    r = len(pivots)
    table = np.zeros((len(x), min(MOST_RANK, r + len(x))))
    table[:, :r] = _coordinates(x, pivots, factor, how)
    rest = _diagonal(x, how) - (table[:, :r] ** 2).sum(1)
    new = []
    while rest.size and rest.max() > least:
        if r == MOST_RANK:
            raise ValueError(f"a kernel of more than {MOST_ROWS} rows must have a rank of at most {MOST_RANK}")
        at = int(np.argmax(rest))
        root = math.sqrt(rest[at])
        column = (matrix(x, x[at : at + 1], *how)[:, 0] - table[:, :r] @ table[at, :r]) / root
        column[new] = 0
        column[at] = root
        table[:, r] = column
        rest = rest - column**2
        new.append(at)
        rest[new] = 0
        r += 1
    whole = np.zeros((r, r))
    whole[: len(factor), : len(factor)] = factor
    whole[len(factor) :] = table[new, :r]
    return np.concatenate([pivots, x[new]]), whole


def _factored(table: DataFrame, some: np.ndarray, pre: Preprocess, how: tuple[str, float, int, float], k: int) -> KernelModel:
    """The model of a kernel of any number of rows by pivots of it.

    Pivots come from ``some`` rows first. Then tasks find what the pivots leave of each row of the table, and propose the
    rows of which most is left, until the sum of what is left is REMAINDER of the trace. The kernel's vectors are those of
    the moments of the rows' coordinates.
    """
    spark = table.sparkSession
    if how[0] in ("poly", "polynomial") and (how[3] < 0 or how[2] != int(how[2])):
        raise ValueError(f"such a kernel isn't positive and takes at most {MOST_ROWS} rows")
    least = 1e-12 * float(_diagonal(some, how).mean())
    if not math.isfinite(least):
        raise ArithmeticError("the kernel isn't finite")
    pivots, factor = np.zeros((0, some.shape[1])), np.zeros((0, 0))
    pivots, factor = _more_pivots(some, pivots, factor, how, least)
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast((pivots, factor))

        def remainders(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            left, trace, most, rows = 0.0, 0.0, np.zeros(0), np.zeros((0, sent.value[0].shape[1]))
            for x in _blocks(batches):
                own = _diagonal(x, how)
                rest = np.maximum(own - (_coordinates(x, *sent.value, how) ** 2).sum(1), 0)
                left, trace = left + float(rest.sum()), trace + float(own.sum())
                most, rows = np.concatenate([most, rest]), np.concatenate([rows, x])
                first = np.argsort(-most, kind="stable")[:PROPOSED]
                most, rows = most[first], rows[first]
            yield pa.RecordBatch.from_pydict({"remainder": [left], "trace": [trace], "x": [rows.tobytes()]})

        parts = table.mapInArrow(remainders, "remainder double, trace double, x binary").collect()  # PROPOSED rows a task
        sent.destroy()
        left, trace = (math.fsum(p[c] for p in parts) for c in ("remainder", "trace"))
        if not math.isfinite(trace) or not math.isfinite(left):
            raise ArithmeticError("the kernel isn't finite")
        if left <= REMAINDER * trace:
            break
        found = np.concatenate([np.frombuffer(p["x"]).reshape(-1, some.shape[1]) for p in parts])
        before = len(pivots)
        pivots, factor = _more_pivots(found, pivots, factor, how, least)
        if len(pivots) == before:  # every row is as near as rounding allows
            break
    else:
        raise ArithmeticError("the kernel's pivots did not settle")
    if not len(pivots):
        raise ArithmeticError("the kernel is zero")
    sent = spark.sparkContext.broadcast((pivots, factor))
    moments = gathered_moments(table, len(pivots), lambda batch: (_coordinates(x, *sent.value, how) for x in _blocks([batch])))
    sent.destroy()
    values, vectors = np.linalg.eigh(moments.products)
    k = min(k, len(pivots))
    values, vectors = np.maximum(values[::-1], LEAST_EIGENVALUE), signed(vectors[:, ::-1])[:, :k]
    total = max(trace - moments.rows * float(moments.means @ moments.means), LEAST_EIGENVALUE)
    return KernelModel(pre, pivots, np.linalg.solve(factor.T, vectors), values[:k], how, np.zeros(0), total, moments.means @ vectors)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of batches of columns of numbers, 2,048 at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2_048):
            b = whole.slice(at, 2_048)
            yield np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
