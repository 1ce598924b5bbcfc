"""Decompositions that don't square the features.

``dual``: of tables with fewer rows than features. Rows are cut in slices of CHUNK features and regrouped, so each task has
all rows of some features: their means, deviations and their share of the rows' products with each other, rows x
rows, whose sum has the same eigenvalues; loadings are made slice by slice from its vectors. ``triangular``: of tables with
many rows, whose triangular factor is found by a tree of partial QR factors; its singular values keep what products of
nearly collinear features lose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.sources.scratch import for_a_while

#: Rows that the dual form takes at most, and features of a slice.
DUAL_ROWS, CHUNK = 4_096, 1_024
#: Rows of a block of the products that tasks add up.
BLOCK_ROWS = 64
#: Features up to which factors are small enough to be stacked, and groups of the first level.
FACTOR_FEATURES, GROUPS = 1_024, 32
NEAR_ZERO = 1e-8


def dual(x: DataFrame, m: int, k: int, center: bool, scale: bool, scale_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Loadings (m x k), eigenvalues, means, deviations, rows, and the features' squares after preprocessing of the array
    column ``x``; at most DUAL_ROWS rows. NaNs raise."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                v = batch.column(0).slice(i, 64).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                rows = batch.column(1).slice(i, 64)
                for c in range(0, m, CHUNK):
                    part = np.ascontiguousarray(v[:, c : c + CHUNK])
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([c // CHUNK] * len(part), pa.int32()), "row": rows, "part": pa.array([p.tobytes() for p in part], pa.binary())})

    def whole(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        table = table.sort_by("row")
        v = np.frombuffer(b"".join(table["part"].to_pylist())).reshape(table.num_rows, -1)
        low, mean = v.min(0), v.mean(0)
        mean = np.where(v.max(0) == low, low, mean)
        apart = v - mean
        deviation = np.sqrt((apart * apart).sum(0) / max(len(v) - 1, 1))
        shift = mean if center and not scale_only else np.zeros(v.shape[1])
        by = np.where(deviation > NEAR_ZERO, deviation, 1.0) if scale or scale_only else np.ones(v.shape[1])
        return table["chunk"][0].as_py(), (v - shift) / by, mean, deviation

    def products(table: pa.Table) -> pa.Table:
        _, v, _, _ = whole(table)
        blocks = range(0, len(v), BLOCK_ROWS)
        return pa.table({"block": pa.array([b // BLOCK_ROWS for b in blocks], pa.int32()), "products": pa.array([(v[b : b + BLOCK_ROWS] @ v.T).tobytes() for b in blocks], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"block": table["block"].slice(0, 1), "products": pa.array([sum(np.frombuffer(p.as_py()) for p in table["products"]).tobytes()], pa.binary())})

    rows = x.select(F.col("x"), F.monotonically_increasing_id().alias("row"))
    with for_a_while(rows.mapInArrow(cut, "chunk int, row long, part binary")) as slices:
        n = slices.where("chunk = 0").count()
        if not 2 <= n <= DUAL_ROWS:
            raise ValueError(f"{n} rows of {m} features; with that many features from 2 to {DUAL_ROWS} rows can be fitted")
        met = slices.groupBy("chunk").applyInArrow(products, "block int, products binary")
        blocks = met.groupBy("block").applyInArrow(add, "block int, products binary").orderBy("block").collect()  # rows x rows
        g = np.concatenate([np.frombuffer(b["products"]).reshape(-1, n) for b in blocks])
        if not np.isfinite(g).all():
            raise ValueError("missing values; name a strategy")
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :k]
        turned = vectors / np.sqrt(np.maximum(values[:k], 1e-300))
        sent = x.sparkSession.sparkContext.broadcast(turned)

        def load(table: pa.Table) -> pa.Table:
            chunk, v, mean, deviation = whole(table)
            raw = [(v.T @ sent.value).tobytes(), mean.tobytes(), deviation.tobytes(), (v * v).sum(0).tobytes()]
            return pa.table({"chunk": pa.array([chunk], pa.int32()), **{c: pa.array([r], pa.binary()) for c, r in zip(("loadings", "means", "deviations", "squares"), raw, strict=True)}})

        parts = slices.groupBy("chunk").applyInArrow(load, "chunk int, loadings binary, means binary, deviations binary, squares binary").orderBy("chunk").collect()  # m x k
    of = {c: np.concatenate([np.frombuffer(p[c]) for p in parts]) for c in ("loadings", "means", "deviations", "squares")}
    return of["loadings"].reshape(m, k), values / (n - 1), of["means"], of["deviations"], n, of["squares"]


def triangular(x: DataFrame, m: int) -> np.ndarray:
    """The triangular factor (at most m x m) of the rows of the array column ``x``."""
    if m > FACTOR_FEATURES:
        raise ValueError(f"{m} features; partial factors take at most {FACTOR_FEATURES}")

    def factor(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(parts), mode="r")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((0, m))
        for batch in batches:
            for i in range(0, batch.num_rows, 2_048):
                found = factor([found, batch.column(0).slice(i, 2_048).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)])
        yield pa.RecordBatch.from_pydict({"branch": pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), "factor": [found.tobytes()]})

    def branch(table: pa.Table) -> pa.Table:
        found = np.zeros((0, m))
        for raw in table["factor"]:
            found = factor([found, np.frombuffer(raw.as_py()).reshape(-1, m)])
        return pa.table({"branch": table["branch"].slice(0, 1), "factor": pa.array([found.tobytes()], pa.binary())})

    tree = x.select("x").mapInArrow(leaves, "branch int, factor binary").groupBy("branch").applyInArrow(branch, "branch int, factor binary").orderBy("branch")
    return factor([np.zeros((0, m)), *[np.frombuffer(r["factor"]).reshape(-1, m) for r in tree.collect()]])  # GROUPS factors
