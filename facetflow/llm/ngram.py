"""Log probabilities of texts under a trigram model smoothed by deleted interpolation.

The probability of a token mixes its maximum-likelihood estimates after the last two tokens, after the last one and by
itself, and an equal share of all types and one more, so that unknown words have some. Mixture weights depend on how
often the context was seen (buckets of powers of two of the two tokens' count or, where that is 0, of the one's) and are
learned by expectation maximisation on the counts of a held-out fold of the training documents, whose own occurrences
are deleted from all counts for it.

Counts cover all training documents. Documents are packed to chunks of a few MB of text, settled once. A chunk counts
its own distinct words, bigrams and trigrams as sorted 64-bit hashes (of n-grams the upper 56 bits, of which equal ones
are one in 10^16 pairs) and sends each range of hashes, as one binary row, to the bucket of that range; buckets add up
the counts and send back, for each chunk, the totals in the chunk's order. So a frequent word is one entry a chunk, not
one row an occurrence, no task holds more than a chunk or a bucket, and rows are never more than a chunk's distinct
hashes, so what is moved grows with the input. The driver sees the number of tokens and types, and a histogram of the
fold by context bucket and octaves of the three estimates, all of bounded size.

Null and empty texts hold only the end token. Rows that repeat count and are scored each; null ids belong to training.
An empty table gives no rows; without training documents all counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm._chunks import by_bucket, of_planes, of_steps, packed, planes, steps, texts_of
from facetflow.llm._shared import release, settle
from facetflow.llm._words import blocks, mix

BUCKET_BYTES = 4 << 20
#: Tokens of a chunk that are scored at once, about.
SLICE = 1 << 17
BEGIN, END = np.uint64(0x51ED270B0A1F39C1), np.uint64(0xC2B2AE3D27D4EB4F)
TRAIN, FOLD, HELD_OUT = 0, 1, 2
ORDERS = ("word", "pair", "triple")
#: Counts of 2^i to 2^(i+1)-1 share weights: those of two tokens first, then those of one, then no context at all.
POWERS = 32
CONTEXTS = 2 * POWERS + 1
#: Octaves of an estimate's ratio to the equal share.
LOWEST, OCTAVES = -8, 48
_U = np.uint64


def remainder(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7, F.lit(0))


def _grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of words, bigrams and trigrams that end at each token, each text's end token included; where texts begin)."""
    tokens, sizes = [], []
    for _, _, words in blocks(texts):
        n = np.diff(words.first)
        tokens.append(np.insert(words.hashes(), words.first[1:], END))
        sizes.append(n + 1)
    token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
    begin = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
    pair = mix(_before(token, begin, BEGIN) * _U(0x9FB21C651E98DF25) + token)
    triple = mix(_before(pair, begin, BEGIN) * _U(0xA0761D6478BD642F) + token)
    return [token, pair & ~_U(255), triple & ~_U(255)], begin


def _before(values: np.ndarray, begin: np.ndarray, first: float | np.uint64) -> np.ndarray:
    """What stands before each value in its text; ``first`` at the begin."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[begin[:-1]] = first
    return out


def count(chunks: DataFrame, buckets: int) -> DataFrame:
    """For each chunk and bucket the totals of the chunk's words, bigrams and trigrams, in the order of their hashes."""
    sent_kind = "kind int, chunk long, bucket long, " + ", ".join(f"{x}_keys binary, {x}_n binary" for x in ORDERS)
    binaries = [pa.field(f"{x}_{y}", pa.binary()) for x in ORDERS for y in ("keys", "n")]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams, _ = _grams(texts_of(np.asarray(batch.column(4)[i].values), batch.column(5)[i].as_py()))
                parts = []
                while grams:
                    keys, n = np.unique(grams.pop(0), return_counts=True)
                    parts.append({b: (keys[of], n[of].astype(np.uint32)) for b, of in zip(*by_bucket(keys, buckets), strict=True)})
                own = sorted(set().union(*parts))
                none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
                columns = []
                for part in parts:
                    columns += [pa.array([steps(part.get(b, none)[0]) for b in own], pa.binary()), pa.array([planes(part.get(b, none)[1]) for b in own], pa.binary())]
                fixed = [pa.array([batch.column(0)[i].as_py()] * len(own), pa.int32()), pa.array([batch.column(1)[i].as_py()] * len(own), pa.int64()), pa.array(own, pa.int64())]
                yield pa.RecordBatch.from_arrays([*fixed, *columns], schema=pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), *binaries]))
                del parts, columns, keys, n
                pa.default_memory_pool().release_unused()

    sums = ("tokens", "types", "fold_tokens")
    answer_schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), *[(f"{x}{y}", pa.binary()) for x in ORDERS for y in ("", "_fold")], *[(x, pa.int64()) for x in sums]])

    def answer(table: pa.Table) -> pa.Table:
        kinds = np.array(table.column("kind").to_pylist())
        columns: dict[str, list] = {x: table.column(x).to_pylist() for x in ("kind", "chunk", "bucket")}
        tokens = types = fold_tokens = 0
        for name in ORDERS:
            keys = [of_steps(x) for x in table.column(f"{name}_keys").to_pylist()]
            size = np.array([len(x) for x in keys])
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            known = len(distinct)
            del keys, distinct
            times, kind = np.concatenate([of_planes(x, np.uint32) for x in table.column(f"{name}_n").to_pylist()]), np.repeat(kinds, size)
            total = np.bincount(place, times * (kind != HELD_OUT), known)
            fold = np.bincount(place, times * (kind == FOLD), known)
            if name == "word":
                tokens, types, fold_tokens = int(total.sum()), int((total > 0).sum()), int(fold.sum())
            split = np.cumsum(size)[:-1]
            columns[name] = [planes(x.astype(np.uint32)) for x in np.split(total[place], split)]
            columns[f"{name}_fold"] = [planes(x.astype(np.uint32)) if k == FOLD else b"" for k, x in zip(kinds, np.split(fold[place], split), strict=True)]
        rest = [0] * (len(kinds) - 1)
        columns |= {"tokens": [tokens, *rest], "types": [types, *rest], "fold_tokens": [fold_tokens, *rest]}
        pa.default_memory_pool().release_unused()
        return pa.table(columns, answer_schema)

    out = "kind int, chunk long, bucket long, " + ", ".join(f"{x} binary, {x}_fold binary" for x in ORDERS) + ", " + ", ".join(f"{x} long" for x in sums)
    return chunks.mapInArrow(send, sent_kind).groupBy("bucket").applyInArrow(answer, out)


def _totals(answers: pa.Table, name: str) -> np.ndarray:
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    parts = answers.column(name).to_pylist()
    return np.concatenate([of_planes(parts[i], np.uint32) for i in order]) if parts else np.zeros(0, np.uint32)


def _looked_up(chunk: pa.Table, answers: pa.Table, endings: tuple[str, ...]) -> Iterator[tuple[list[list[np.ndarray]], np.ndarray]]:
    """For each ending the counts of each token's word, bigram and trigram; and where each text's tokens begin: for whole
    texts of about SLICE tokens at a time, so that what is derived of tokens doesn't take a chunk's room many times."""
    pa.default_memory_pool().release_unused()
    grams, begin = _grams(texts_of(chunk.column("sizes")[0].values.to_numpy(), chunk.column("texts")[0].as_py()))
    found: list[list[np.ndarray]] = [[] for _ in endings]
    for name in ORDERS:
        place = np.unique(grams.pop(0), return_inverse=True)[1].astype(np.uint32)
        for own, e in zip(found, endings, strict=True):
            own.append(_totals(answers, f"{name}{e}")[place])
    texts, i = len(begin) - 1, 0
    while i < texts:
        j = max(i + 1, int(np.searchsorted(begin, begin[i] + SLICE, "right")) - 1)
        yield [[x[begin[i] : begin[j]].astype(np.float64) for x in own] for own in found], begin[i : j + 1] - begin[i]
        i = j


def estimates(words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, begin: np.ndarray, tokens: float, documents: float) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, bigram and unigram maximum-likelihood estimates of each token, 0 after an unseen context; context bucket)."""
    two, one = _before(pairs, begin, documents), _before(words, begin, documents)
    share = lambda n, of: np.where(of > 0, n / np.maximum(of, 1), 0.0)
    power = lambda n: np.clip(np.log2(np.maximum(n, 1)).astype(np.int64), 0, POWERS - 1)
    bucket = np.where(two > 0, power(two), np.where(one > 0, POWERS + power(one), 2 * POWERS))
    return np.stack([share(triples, two), share(pairs, one), words / max(tokens, 1)]), bucket


def learn_weights(bucket: np.ndarray, times: np.ndarray, ratios: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights (CONTEXTS x 4) of the three estimates and the equal share, by expectation maximisation.

    times: how often tokens of a context bucket have those ratios (3 x cells) of their estimates to the equal share.
    """
    cells = np.concatenate([ratios, np.ones((1, len(times)))])
    total = np.bincount(bucket, times, CONTEXTS)
    weights = np.full((CONTEXTS, 4), 0.25)
    for _ in range(rounds):
        part = weights[bucket].T * cells
        part *= times / part.sum(0)
        new = np.stack([np.bincount(bucket, x, CONTEXTS) for x in part], 1) / np.maximum(total, 1)[:, None]
        new = np.maximum(new, 1e-6)
        weights = np.where(total[:, None] > 0, new / new.sum(1, keepdims=True), weights)
    # buckets without held-out tokens take the weights of the nearest one
    some = np.flatnonzero(total > 0)
    if len(some):
        weights = weights[some[np.abs(np.arange(CONTEXTS)[:, None] - some).argmin(1)]]
    # an order that the context rules out has no share
    weights[POWERS:, 0] = 0
    weights[2 * POWERS :, 1] = 0
    return weights / weights.sum(1, keepdims=True)


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), remainder().alias("rest"))
    kind = F.when(F.col("rest") == 2, HELD_OUT).when(F.col("rest") == 3, FOLD).otherwise(TRAIN)
    chunks = settle(packed(rows.select("doc_id", F.lit(0).cast("long").alias("rank"), "text", kind.cast("int").alias("kind"))))
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    docs = lambda k: F.coalesce(F.sum(F.when(F.expr(k), F.size("ids"))), F.lit(0))
    found = chunks.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), docs(f"kind <> {HELD_OUT}").alias("train"), docs(f"kind = {FOLD}").alias("fold")).first()
    train_documents, fold_documents = found["train"], found["fold"]
    answers = settle(count(chunks, max(1, -(-found["bytes"] // BUCKET_BYTES))))
    release(spark)
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "fold_tokens")]).first()
    n, v, n_fold = sums["tokens"], sums["types"], sums["fold_tokens"]

    def measure(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        del key
        parts = []
        for (counts, folds), begin in _looked_up(chunk, answers, ("", "_fold")):
            found, bucket = estimates(*[a - b for a, b in zip(counts, folds, strict=True)], begin, n - n_fold, train_documents - fold_documents)
            ratio = found * (v + 1)
            cell = bucket
            for x in ratio:
                octave = np.where(x > 0, 1 + np.clip(np.floor(np.log2(np.maximum(x, 1e-30))).astype(np.int64) - LOWEST, 0, OCTAVES - 1), 0)
                cell = cell * (OCTAVES + 1) + octave
            cell, place, times = np.unique(cell, return_inverse=True, return_counts=True)
            columns = {"cell": pa.array(cell, pa.int64()), "n": pa.array(times, pa.int64())}
            parts.append(pa.table(columns | {f"r{i}": pa.array(np.bincount(place, x, len(cell))) for i, x in enumerate(ratio)}))
        return pa.concat_tables(parts) if parts else pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), **{f"r{i}": pa.array([], pa.float64()) for i in range(3)}})

    needed = ["kind", "chunk", "bucket", *ORDERS]
    fold = chunks.where(f"kind = {FOLD}").groupBy("kind", "chunk").cogroup(answers.where(f"kind = {FOLD}").select(*needed, *[f"{x}_fold" for x in ORDERS]).groupBy("kind", "chunk"))
    cells = fold.applyInArrow(measure, "cell long, n long, r0 double, r1 double, r2 double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("n", "r0", "r1", "r2")]).orderBy("cell").collect()
    times = np.array([r["n"] for r in cells], float)
    ratios = np.array([[r["r0"], r["r1"], r["r2"]] for r in cells], float).reshape(-1, 3).T / times
    weights = learn_weights(np.array([r["cell"] // (OCTAVES + 1) ** 3 for r in cells], np.int64), times, ratios)

    def finish(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        n_tokens, n_known, lows, fulls = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, np.float64))
        for (counts,), begin in _looked_up(chunk, answers, ("",)):
            found, bucket = estimates(*counts, begin, n, train_documents)
            w = weights[bucket].T
            full = (w[:3] * found).sum(0) + w[3] / (v + 1)
            low = (counts[0] + 1) / (n + v + 1)
            start = begin[:-1]
            n_tokens.append(np.diff(begin))
            n_known.append(np.add.reduceat((counts[0] > 0).astype(np.int64), start))
            lows.append(np.add.reduceat(np.log10(low), start))
            fulls.append(np.add.reduceat(np.log10(full), start))
        texts = sum(map(len, n_tokens))
        return pa.table({
            "doc_id": pc.list_flatten(chunk.column("ids")),
            "held_out": pa.array(np.full(texts, key[0].as_py() == HELD_OUT)),
            "n_tokens": pa.array(np.concatenate(n_tokens), pa.int64()),
            "n_known": pa.array(np.concatenate(n_known), pa.int64()),
            "train_tokens": pa.array(np.full(texts, n), pa.int64()),
            "base_score": pa.array(np.concatenate(lows)),
            "score": pa.array(np.concatenate(fulls)),
        })

    both = chunks.groupBy("kind", "chunk").cogroup(answers.select(*needed).groupBy("kind", "chunk"))
    return both.applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity_gain(scored: DataFrame) -> float:
    """How much more log10 probability a held-out token gets from the model than from the base, on average."""
    found = scored.where("held_out").agg(F.sum(F.col("score") - F.col("base_score")).alias("g"), F.sum("n_tokens").alias("n")).first()
    return found["g"] / found["n"] if found["n"] else math.nan
