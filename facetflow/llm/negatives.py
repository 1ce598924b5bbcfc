"""Hard negatives by radix selection over integer scores.

A row's score for an anchor is the inner product of their vectors, whose components become floor(scale * x). A *window*
asks, for one anchor, for the first k rows of an interval of scores, the higher scores first and ties by smaller ids:
the positives of an anchor are a window over the rows of its own label, and each positive opens a window over the rows
of other labels. The k-th row of a window is found digit by digit: tasks count their rows by the leading digit of their
place (distance from the highest score; among equal scores the id), the counts of all tasks are added, the digit in
which the k-th row lies becomes the window's interval, and the next round counts within it. A window is closed as soon
as at most ``gather`` rows are left in front of its interval's end; only those rows are then gathered and ranked. So one
vector that a third of the rows share costs rounds of counting by ids, not a gathered group.

Rows are kept in packed blocks that don't move: blocks of anchors with their windows are sent to them, by broadcast
while they are under ``broadcast_bytes``, else by a join on the blocks' numbers. Of each window a task returns the
digits up to its own k-th row at most.

Rows without an id or a label, with a null or empty vector, null or non-finite components, or another length than most
vectors take no part, nor do rows with a component so large that scores could leave a long. Rows that share an id count
once, with the smallest label and then the smallest vector. An anchor isn't its own positive or negative; without
positives or rows in its windows it gives no rows, like an empty table.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.llm._shared import counted, settle

BLOCK_ROWS, BLOCK_ANCHORS = 4_096, 512
_ROWS = "block long, ids binary, labels binary, q binary, kind string"
_COUNTS = "anchor long, slot long, digit long, n long"
_FOUND = "anchor long, slot long, score long, id long"
_LONG = 2**63 - 1


def usable(vectors: DataFrame, id_column: str, label_column: Column, vector_column: str) -> DataFrame:
    """(id, label, x: array<double>), one row an id, of the vectors that take part."""
    x = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label_column.cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & finite)
    return rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("one")).select("id", "one.label", "one.x")


def _packed(rows: DataFrame, d: int, scale: float) -> DataFrame:
    """Blocks of rows, of the narrowest integers that hold them, and the largest square of a block's vectors."""
    most = int((_LONG // (4 * d)) ** 0.5)
    held = max(1, min(BLOCK_ROWS, (4 << 20) // (8 * d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, held):
                part = batch.slice(i, held)
                with np.errstate(over="ignore"):
                    q = np.floor(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * scale)
                fits = (np.abs(q) <= most).all(1)
                if not fits.any():
                    continue
                q = q[fits].astype(np.int64)
                ids, labels = (part.column(c).to_numpy()[fits] for c in (0, 1))
                top = int(np.abs(q).max())
                kind = np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "labels": [labels.tobytes()], "q": [q.astype(kind).tobytes()], "kind": [np.dtype(kind).str], "square": [int((q * q).sum(1).max())], "low": [int(ids.min())], "high": [int(ids.max())], "n": [len(ids)]})

    return rows.mapInArrow(run, "ids binary, labels binary, q binary, kind string, square long, low long, high long, n long").withColumn("block", F.monotonically_increasing_id())


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; by floating point where no sum can leave its whole numbers."""
    if not len(a) or not len(b) or int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _as_bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _pack_windows(d: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("anchor")
        anchors, first, of = np.unique(rows["anchor"].to_numpy(), return_index=True, return_inverse=True)
        q = np.stack([np.frombuffer(rows["q"][int(i)].as_py(), rows["kind"][int(i)].as_py()).astype(np.int64) for i in first]).reshape(-1, d)
        raw = _as_bytes(anchors=anchors, labels=rows["label"].to_numpy()[first], q=q, of=of, **{c: rows[c].to_numpy() for c in ("slot", "top", "hi", "lo", "ihi", "ilo", "need")})
        return pa.table({"ablock": rows["ablock"].slice(0, 1), "windows": pa.array([raw], pa.binary())})

    return run


def _digits(window: dict, i: int, s: np.ndarray, ids: np.ndarray, base: int) -> np.ndarray:
    """Digits of the rows of a window's interval: of scores while it has several, else of ids."""
    hi, lo, ilo, ihi = (int(window[c][i]) for c in ("hi", "lo", "ilo", "ihi"))
    if hi > lo:
        return (hi - s) // _width(hi, lo, base)
    far = ids.astype(np.uint64) - np.uint64(ilo % 2**64)  # the distance of two longs may leave a long
    return (far // np.uint64(_width(ihi, ilo, base))).astype(np.int64)


def _width(high: int, low: int, base: int) -> int:
    return (high - low) // base + 1


def _next(column: str) -> Column:
    """The bound of a window's next interval, that of its digit ``cut.digit``; in decimals, which no bound leaves."""
    hi, lo, ihi, ilo = (f"cast({c} as decimal(25, 0))" for c in ("hi", "lo", "ihi", "ilo"))
    by_score = {"hi": f"{hi} - cut.digit * w", "lo": f"greatest({lo}, {hi} - cut.digit * w - w + 1)", "ihi": ihi, "ilo": ilo}
    by_id = {"hi": hi, "lo": lo, "ihi": f"least({ihi}, {ilo} + cut.digit * w + w - 1)", "ilo": f"{ilo} + cut.digit * w"}
    return F.expr(f"cast(if(hi > lo, {by_score[column]}, {by_id[column]}) as bigint)").alias(column)


def _meet(meeting: DataFrame, schema: str, d: int, same: bool, base: int | None) -> DataFrame:
    """What the rows of each block are to each window of the anchors it meets: counts of digits, or the rows themselves
    (without ``base``) from the window's top to its interval's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                q = np.frombuffer(row["q"], row["kind"]).reshape(-1, d)
                w = dict(np.load(io.BytesIO(row["windows"]), allow_pickle=False))
                scores = _scores(w["q"], q)
                anchor, slot, first, second = [], [], [], []
                for i, a in enumerate(w["of"].tolist()):
                    s = scores[a]
                    there = (labels == w["labels"][a]) if same else (labels != w["labels"][a])
                    there = there & (s >= w["lo"][i]) & (s <= (w["hi"] if base else w["top"])[i]) & (ids != w["anchors"][a])
                    if base:
                        if w["hi"][i] == w["lo"][i]:
                            there &= (ids >= w["ilo"][i]) & (ids <= w["ihi"][i])
                        at = _digits(w, i, s[there], ids[there], base)
                        need = int(w["need"][i])
                        if len(at) > need:
                            at = at[at <= np.partition(at, need - 1)[need - 1]]
                        one, two = np.unique(at, return_counts=True)
                    else:
                        there &= (s > w["lo"][i]) | (ids <= w["ihi"][i])
                        one, two = s[there], ids[there]
                    first.append(one)
                    second.append(two)
                    anchor.append(np.full(len(one), w["anchors"][a]))
                    slot.append(np.full(len(one), w["slot"][i]))
                columns = [np.concatenate(x).astype(np.int64) for x in (anchor, slot, first, second)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])

    return meeting.mapInArrow(run, schema)


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, label: Column | None = None,
    id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 256.0, base: int = 4_096, gather: int = 64, broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its first
    ``positives`` rows of the same label the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's.

    is_anchor: condition on the column ``id``. label: by default the column of that name.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, F.col("label") if label is None else label, vector_column)
    rows = settle(rows)
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not sizes:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d = sizes["d"]
    blocks = settle(_packed(rows.where(F.size("x") == d), d, scale))
    bounds = blocks.agg(F.max("square"), F.min("low"), F.max("high"), F.count(F.lit(1))).first()
    if not bounds[3]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    reach, least_id, last_id, n_blocks = bounds
    kept = blocks.select("block", "ids", "labels", "q", "kind")

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q"], row["kind"]).reshape(-1, d)
                yield pa.RecordBatch.from_pydict({"id": ids, "label": np.frombuffer(row["labels"], np.int64), "q": pa.array([x.tobytes() for x in q], pa.binary()), "kind": [row["kind"]] * len(ids)})

    # an anchor takes its rows from its block
    anchors, n_anchors = counted(kept.mapInArrow(single, "id long, label long, q binary, kind string").where(is_anchor).withColumnRenamed("id", "anchor"), F.lit(True))
    n_ablocks = max(1, -(-n_anchors // BLOCK_ANCHORS))

    def meeting(windows: DataFrame, a_window: int) -> DataFrame:
        """Each block of rows with each block of anchors and their windows."""
        sent = anchors.join(windows, "anchor").withColumn("ablock", F.pmod(F.xxhash64("anchor"), F.lit(n_ablocks)).cast("int"))
        sent = sent.groupBy("ablock").applyInArrow(_pack_windows(d), "ablock int, windows binary")
        there = kept.withColumn("ablock", F.explode(F.sequence(F.lit(0), F.lit(n_ablocks - 1))))
        if n_anchors * (8 * d + 16 + 64 * a_window) <= broadcast_bytes:
            return there.join(F.broadcast(sent), "ablock")
        salts = max(1, min(n_blocks, 4 * spark.sparkContext.defaultParallelism // n_ablocks))
        there = there.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        return there.join(sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["ablock", "salt"])

    def first_rows(windows: DataFrame, k: int, same: bool, a_window: int) -> DataFrame:
        """anchor, slot, score, id, rank of the first k rows of each window (anchor, slot, lo, hi)."""
        open_ = windows.where("lo <= hi").select("anchor", "slot", F.col("hi").alias("top"), "hi", "lo", F.lit(last_id).cast("long").alias("ihi"), F.lit(least_id).cast("long").alias("ilo"), F.lit(k).cast("long").alias("need"))
        open_, left = counted(open_, F.lit(True))
        closed = None
        while left:
            counts = _meet(meeting(open_, a_window), _COUNTS, d, same, base).groupBy("anchor", "slot", "digit").agg(F.sum("n").alias("n"))
            order = Window.partitionBy("anchor", "slot").orderBy("digit")
            counts = counts.withColumn("upto", F.sum("n").over(order)).join(open_, ["anchor", "slot"])
            # the first digit that reaches the k-th row, or the last one where there are fewer rows
            at = counts.groupBy("anchor", "slot").agg(
                F.min(F.when(F.col("upto") >= F.col("need"), F.struct("digit", "n", "upto"))).alias("cut"), F.max(F.struct("digit", "n", "upto")).alias("end")
            )
            at = at.select("anchor", "slot", F.coalesce("cut", "end").alias("cut")).join(open_, ["anchor", "slot"])
            high, low = "if(hi > lo, hi, ihi)", "if(hi > lo, lo, ilo)"
            at = at.withColumn("w", F.expr(f"cast((cast({high} as decimal(20, 0)) - cast({low} as decimal(20, 0))) div {base} + 1 as decimal(20, 0))"))
            ahead = F.col("cut.upto") - F.col("cut.n")
            step = at.select("anchor", "slot", "top", *map(_next, ("hi", "lo", "ihi", "ilo")), (F.col("need") - ahead).alias("need"), (F.col("cut.n") - F.col("need") + ahead).alias("over"))
            # what is gathered: k rows and those behind them in the interval of the k-th
            done = (F.col("over") + k <= max(gather, k)) | ((F.col("hi") == F.col("lo")) & (F.col("ihi") == F.col("ilo")))
            step, left = counted(step.withColumn("done", done), ~F.col("done"))
            ready = step.where("done").drop("done", "over")
            closed = ready if closed is None else closed.unionByName(ready)
            open_ = step.where("not done").drop("done", "over")
        if closed is None:
            return spark.createDataFrame([], _FOUND + ", rank int")
        found = _meet(meeting(closed, a_window), _FOUND, d, same, None)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        return settle(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

    everything = anchors.select("anchor", F.lit(-1).cast("long").alias("slot"), F.lit(-reach).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi"))
    near = first_rows(everything, positives, True, 1).select("anchor", F.col("id").alias("slot"), F.col("score").alias("p"))
    share = lambda percent: f"({percent} * (p div 100) + ({percent} * (p - 100 * (p div 100))) div 100)"  # noqa: E731  no product leaves a long
    # scores s with low * p <= 100 * s <= high * p; none where p is negative and low < high
    upper = F.expr(f"{share(high)} - if(pmod({high} * pmod(p, 100), 100) <> 0 and p < 0, 1, 0)")
    lower = F.expr(f"{share(low)} + if(pmod({low} * pmod(p, 100), 100) <> 0 and p > 0, 1, 0)")
    windows = settle(near.withColumns({"lo": lower, "hi": upper}))
    found = first_rows(windows, negatives, False, positives)
    out = found.join(near, ["anchor", "slot"])
    return out.select(
        F.col("anchor").alias("anchor_id"), F.col("slot").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p").alias("positive_score"), F.col("score").alias("negative_score"),
    )
