"""Correlations of many columns with gaps, by products of matrices of values and of 0/1 masks.

Over the rows in which both of a pair are there, counts, sums and sums of squares are entries of products such as
values' * mask, so a batch of rows takes six products for all pairs at once. Each batch is shifted by its columns' means;
moments of batches, of tasks and at last of blocks of matrix rows are merged pair by pair, so nothing cancels, and the
result is a table of pairs that doesn't meet at the driver. Columns are taken in tiles of TILE, a pass for each
two tiles, so a task keeps six matrices of a tile's size at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512
BLOCK_ROWS = 64
#: Deviations below this share of the mean are rounding of equal values.
ROUNDING = 4e-15
_BLOCKS = "block int, moments binary"

Moments = tuple[np.ndarray, ...]  # n, mean of a, mean of b, squares of a, squares of b, products


def measured(a: np.ndarray, b: np.ndarray) -> Moments:
    """Moments of each column of a with each of b, over the rows where neither is NaN."""
    out = []
    for x in (a, b):
        there = ~np.isnan(x)
        n = there.sum(0)
        low, high = np.where(there, x, np.inf).min(0, initial=np.inf), np.where(there, x, -np.inf).max(0, initial=-np.inf)
        mean = np.where(there, x, 0.0).sum(0) / np.maximum(n, 1)
        shift = np.where(n == 0, 0.0, np.where(low == high, low, mean))
        out.append((shift, there.astype(float), np.where(there, x - shift, 0.0)))
    (sa, ma, xa), (sb, mb, xb) = out
    n = ma.T @ mb
    d = np.maximum(n, 1)
    qa, qb = (xa * xa).T @ mb, ma.T @ (xb * xb)
    ta, tb = xa.T @ mb, ma.T @ xb
    va, vb = qa - ta * ta / d, qb - tb * tb / d
    va, vb = np.where(va <= 1e-13 * qa, 0.0, va), np.where(vb <= 1e-13 * qb, 0.0, vb)
    return n, sa[:, None] + ta / d, sb + tb / d, va, vb, xa.T @ xb - ta * tb / d


def merged(one: Moments, two: Moments) -> Moments:
    """Moments of two sets of rows together, pair by pair."""
    n = one[0] + two[0]
    share = two[0] / np.maximum(n, 1)
    both = one[0] * share
    da, db = (np.where(both > 0, two[i] - one[i], 0.0) for i in (1, 2))
    means = (np.where(one[0] > 0, one[i] + d * share, two[i]) for i, d in ((1, da), (2, db)))
    return (n, *means, one[3] + two[3] + da * da * both, one[4] + two[4] + db * db * both, one[5] + two[5] + da * db * both)


def correlations(m: Moments) -> np.ndarray:
    """0 where a column is constant or fewer than two rows are left."""
    n = np.maximum(m[0], 1)
    flat = (m[3] <= n * (ROUNDING * m[1]) ** 2) | (m[4] <= n * (ROUNDING * m[2]) ** 2) | (m[0] < 2)
    under = np.sqrt(np.where(flat, 1.0, m[3])) * np.sqrt(np.where(flat, 1.0, m[4]))
    return np.where(flat, 0.0, np.clip(m[5] / np.where(under > 0, under, 1.0), -1, 1))


def _number(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.coalesce(x, F.lit(float("nan")))


def _tile(df: DataFrame, left: list[str], right: list[str], same: bool) -> DataFrame:
    """a, b, r, n of the columns of two tiles; of one with itself each pair once."""
    p, q = len(left), len(right)
    x = df.select(F.array(*map(_number, left if same else [*left, *right])).alias("x"))
    width = p if same else p + q
    steps = list(range(0, p, BLOCK_ROWS))

    def raw(m: Moments, rows: slice) -> bytes:
        return np.stack([part[rows] for part in m]).tobytes()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                v = batch.column(0).slice(at, 2_048).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                own = measured(v[:, :p], v if same else v[:, p:])
                found = own if found is None else merged(found, own)
        if found is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(steps)), pa.int32()), "moments": [raw(found, slice(i, i + BLOCK_ROWS)) for i in steps]})

    def meet(table: pa.Table) -> pa.Table:
        first = steps[table["block"][0].as_py()]
        found = None
        for part in table["moments"]:
            own = tuple(np.frombuffer(part.as_py()).reshape(6, -1, q))
            found = own if found is None else merged(found, own)
        i, j = np.indices(found[0].shape).reshape(2, -1)
        i += first
        keep = i < j if same else np.ones(len(i), bool)
        r = correlations(found).ravel()
        return pa.table({"i": i[keep].astype(np.int32), "j": j[keep].astype(np.int32), "r": r[keep], "n": found[0].ravel()[keep].astype(np.int64)})

    pairs = x.mapInArrow(measure, _BLOCKS).groupBy("block").applyInArrow(meet, "i int, j int, r double, n long")
    name = lambda names, i: F.element_at(F.array(*map(F.lit, names)), F.col(i) + 1)
    return pairs.select(name(left, "i").alias("a"), name(right, "j").alias("b"), "r", "n")


def pairs(df: DataFrame, columns: list[str], others: list[str] | None = None) -> DataFrame:
    """a, b, r, n: the correlation of each two columns (a before b), or of each column with each of the others, over the
    rows in which neither is null or NaN; 0 for constants or fewer than two rows. An empty table gives no rows."""
    cut = lambda c: [c[i : i + TILE] for i in range(0, len(c), TILE)]
    if others is None:
        tiles = cut(columns)
        parts = [_tile(df, a, b, i == j) for i, a in enumerate(tiles) for j, b in enumerate(tiles) if i <= j]
    else:
        parts = [_tile(df, a, b, False) for a in cut(columns) for b in cut(others)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
