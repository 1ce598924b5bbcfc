"""Approximate nearest neighbours with an adaptive dimension scan of inverted lists.

Lists are the cells of k-means centroids fitted on a bounded sample; every vector is filed in the list of its nearest
centroid, and a query probes as many lists as hold ``recall`` of the sample's own neighbours. Within a list vectors are
rotated by a random orthogonal matrix and read in blocks of columns: after each block a candidate whose partial
distance, scaled to all dimensions, exceeds the query's bound by more than the test allows is abandoned; for the others
the exact distance on the original vectors is computed. The bound starts as the k-th distance to the sample's vectors in
the probed lists, which the scan meets there again, and shrinks as neighbours are found. Answers come from the scan alone.

Lists of many vectors are split in blocks of about ``block_rows`` rows, to each of which the queries that probe the
list are sent, so no task holds a whole hot list. The sample (at most ``sample`` vectors), the centroids and the sizes
of the lists are all that reaches the driver; each is bounded by its parameter.

Vectors that are null, zero, hold null or non-finite components, or have another number of components than most of the
sample, take no part, nor do rows without an id. Rows that share an id count once, with the nearest of their vectors,
and are never their own neighbours. Ties go to smaller ids. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.llm._shared import settle

#: Columns read before each test, and the significance of the test: larger abandons later.
COLUMNS, EPSILON = 16, 2.1
CHUNK = 1024


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x: array<double>) of the vectors that take part."""
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, d)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)


def _centroids(sample: np.ndarray, lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = _squares(sample, centres).argmin(1)
        n = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        some = n > 0
        sums = np.add.reduceat(sample[order], (np.cumsum(n) - n)[some])
        centres[some] = sums / n[some][:, None]
        if (~some).any():
            centres[~some] = sample[rng.choice(len(sample), int((~some).sum()))]
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 512) -> int:
    """Lists to probe, so that the sample's vectors find this share of their neighbours in the sample."""
    of = _squares(sample, centres).argmin(1)
    some = np.arange(min(asked, len(sample)))
    distance = _squares(sample[some], sample)
    distance[some, some] = np.inf
    near = np.argsort(distance, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    place = np.argsort(np.argsort(_squares(sample[some], centres), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, of[near], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def scan(query: np.ndarray, turned_query: np.ndarray, rows: np.ndarray, turned: np.ndarray, ids: np.ndarray, own: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k nearest of one block of a list, at most ``bound`` away."""
    d = rows.shape[1]
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    for start in range(0, len(rows), CHUNK):
        live = np.arange(start, min(start + CHUNK, len(rows)))
        part = np.zeros(len(live))
        for a in range(0, d, COLUMNS):
            b = min(a + COLUMNS, d)
            part = part + ((turned[live, a:b] - turned_query[a:b]) ** 2).sum(1)
            slack = 1 + EPSILON / np.sqrt(b) if b < d else 1 + 1e-9
            keep = part * (d / b) <= (slack * bound) ** 2
            live, part = live[keep], part[keep]
            if not len(live):
                break
        live = live[ids[live] != own]
        if not len(live):
            continue
        exact = np.sqrt(((rows[live] - query) ** 2).sum(1))
        best_d, best_i = np.concatenate([best_d, exact]), np.concatenate([best_i, ids[live]])
        order = np.lexsort((best_i, best_d))
        best_d, best_i = best_d[order], best_i[order]
        _, first = np.unique(best_i, return_index=True)
        first = np.sort(first)[:k]
        best_d, best_i = best_d[first], best_i[first]
        if len(best_d) == k:
            bound = min(bound, float(best_d[-1]))
    return best_i, best_d


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    recall: float = 0.97, sample: int = 16_384, lists: int | None = None, block_rows: int = 4_096, seed: int = 11,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest among all rows.

    is_query: condition on the column ``id``. lists: by default about half the square root of the rows, 16 to 1,024.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_column, vector_column)
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).select("id", "x").collect()
    if not drawn:
        return spark.createDataFrame([], schema)
    sizes = np.array([len(r["x"]) for r in drawn])
    d = int(np.bincount(sizes).argmax())
    sample_ids = np.array([r["id"] for r in drawn if len(r["x"]) == d], np.int64)
    sampled = np.array([r["x"] for r in drawn if len(r["x"]) == d], np.float64)
    rows = rows.where(F.size("x") == d)
    rng = np.random.Generator(np.random.PCG64(seed))
    if lists is None:
        lists = int(min(1024, max(16, 0.5 * rows.count() ** 0.5)))
    lists = min(lists, len(sampled))
    centres = _centroids(sampled, lists, 12, rng)
    probes = _probes(sampled, centres, k, recall)
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]

    cells_of = spark.sparkContext.broadcast(centres)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = cells_of.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            cell = np.concatenate([_squares(x[i : i + CHUNK], centres).argmin(1) for i in range(0, len(x), CHUNK)]) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array([v.tobytes() for v in np.ascontiguousarray(x)], pa.binary())], names=["list", "id", "x"])

    filed = settle(rows.mapInArrow(file, "list int, id long, x binary"))
    counts = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows_of = np.array([counts.get(i, 0) for i in range(lists)])
    blocks = -(-rows_of // block_rows)
    held = np.cumsum(np.sort(rows_of))
    probes = max(probes, min(lists, int(np.searchsorted(held, k + 1)) + 1))  # k candidates, if there are as many
    parts = F.element_at(F.array(*[F.lit(max(1, int(b))) for b in blocks]), F.col("list") + 1)
    stored = filed.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))

    # one vector an id: the k-th distance is then one that k rows keep
    _, one = np.unique(sample_ids, return_index=True)
    bounding = spark.sparkContext.broadcast((sample_ids[one], sampled[one], _squares(sampled[one], centres).argmin(1)))  # ``sample`` vectors
    turning = spark.sparkContext.broadcast((centres, rotation))

    def probed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a few queries: vectors, ids, lists, and the k-th distance to the sample in those lists."""
        (known_ids, known_x, known_cells), (places, _) = bounding.value, turning.value
        x, ids = _matrix(part.column(1), d), np.asarray(part.column(0))
        cells = np.argsort(_squares(x, places), axis=1)[:, :probes]
        if len(known_ids) <= k:
            return x, ids, cells, np.full(len(x), np.inf)
        inside = np.zeros((len(x), lists), bool)
        np.put_along_axis(inside, cells, True, 1)
        known = _squares(x, known_x)
        known[(ids[:, None] == known_ids) | ~inside[:, known_cells]] = np.inf
        near = np.argpartition(known, k - 1, axis=1)[:, :k]
        distance = np.sqrt(((known_x[near] - x[:, None]) ** 2).sum(2))
        distance[~np.isfinite(np.take_along_axis(known, near, 1))] = np.inf
        return x, ids, cells, distance.max(1) * (1 + 1e-9)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                x, ids, cells, bound = probed(part)
                times = blocks[cells]
                query = np.repeat(np.arange(len(x)), times.sum(1))
                flat = times.ravel()
                block = np.arange(int(flat.sum())) - np.repeat(np.cumsum(flat) - flat, flat)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(cells.ravel(), flat).astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(ids[query]), part.column(1).take(pa.array(query)), pa.array(bound[query])],
                    names=["list", "block", "id", "x", "bound"],
                )

    queries = filed.where(is_query).select("id", "x").mapInArrow(ask, "list int, block int, id long, x binary, bound double")

    def search(asked: pa.Table, there: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        if asked.num_rows and there.num_rows:
            x, ids = _matrix(there.column("x"), d), there.column("id").to_numpy()
            turn = turning.value[1]
            turned = x @ turn
            queries_x = _matrix(asked.column("x"), d)
            turned_q = queries_x @ turn
            for i, (own, bound) in enumerate(zip(asked.column("id").to_pylist(), asked.column("bound").to_pylist(), strict=True)):
                near, distance = scan(queries_x[i], turned_q[i], x, turned, ids, own, k, bound)
                q += [own] * len(near)
                v += near.tolist()
                s += distance.tolist()
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = queries.groupBy("list", "block").cogroup(stored.select("list", "block", "id", "x").groupBy("list", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
