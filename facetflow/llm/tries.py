"""Term divergence of sources by mergeable radix tries.

A task counts the terms of its rows and keeps them as byte tries, one a language: in UTF-8 order each leaf gives how
many bytes of its path it shares with the leaf before it, the bytes of its own, the number of documents, and a counter for
each source it occurs in. Tries are cut in pieces of PIECE leaves; quantiles of the pieces' first bytes give ranges of
prefixes of about ``range_leaves`` leaves, pieces are dealt by language and range, and the tries of a range are merged.
So a language that holds most of the rows is spread over as many ranges as its tries need, and what is sent is a
leaf a task and term, whatever the number of occurrences. Leaves in too few documents are dropped in the merge. A
traversal of the merged tries in UTF-8 order, with the sums over all ranges at hand, streams each pair of sources' part of
the divergence, and for each source the candidates of its range, which keep UTF-8 order among equal values.

Null text, lang or source are ''. Terms are runs of ASCII letters and of anything beyond ASCII; only A-Z are lower-cased.
Every row is a document, rows that share an id too. A group whose rows hold no term, and a language that keeps none, have
all their pairs (with value 0 if nothing is kept) and no terms. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.llm._shared import settle
from facetflow.llm._words import as_bytes

PIECE = 4_096
SHARED = 24  # bytes at most that a leaf shares with the one before
FLUSH_LEAVES = 1_000_000  # of a task's counters, before they are written as tries
SLICE_BYTES = 4 << 20  # of a long text, cut between terms
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_COUNTED = "lang string, source string, place long, leaves long, trie binary"
_PARTS = "part string, lang string, source string, item binary, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE_BYTES)
        piece = text[at:end].translate(_LETTERS)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # one term that is longer than a slice
                end = min(len(text), end + SLICE_BYTES)
                piece = text[at:end].translate(_LETTERS)
                cut = piece.rfind(b" ")
            if end < len(text):
                piece, end = piece[:cut], at + cut
        yield piece.split()
        at = end


def frozen(terms: list[bytes], documents: np.ndarray, sizes: np.ndarray, source: np.ndarray, counts: np.ndarray, sources: list[str]) -> bytes:
    """A trie of sorted terms in pre-order; sizes: counters a leaf; source, counts: of the counters, leaf by leaf."""
    lengths = np.array([len(t) for t in terms], np.int32)
    heads = np.array(terms, f"S{SHARED}").view(np.uint8).reshape(len(terms), SHARED)
    same = np.logical_and.accumulate(heads[1:] == heads[:-1], axis=1).sum(1)
    shared = np.append(0, np.minimum(same, np.minimum(lengths[1:], lengths[:-1]))).astype(np.int32)
    own = [t[n:] for t, n in zip(terms, shared.tolist(), strict=True)]
    columns = {
        "shared": shared, "own": own, "documents": np.asarray(documents, np.int64), "sizes": np.asarray(sizes, np.int32),
        "source": np.asarray(source, np.int32), "counts": np.asarray(counts, np.int64), "sources": sources,
    }
    batch = pa.record_batch({k: pa.array([v], pa.list_(pa.binary())) if k == "own" else pa.array([v]) for k, v in columns.items()})
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def thawed(raw: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """What frozen() was given."""
    batch = pa.ipc.open_stream(raw).read_next_batch()
    numbers = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("shared", "documents", "sizes", "source", "counts")}
    terms, before = [], b""
    for n, own in zip(numbers["shared"].tolist(), batch.column("own").flatten().to_pylist(), strict=True):
        before = before[:n] + own
        terms.append(before)
    return terms, numbers["documents"], numbers["sizes"], numbers["source"], numbers["counts"], batch.column("sources").flatten().to_pylist()


def place(term: bytes) -> int:
    """The first seven bytes as a number, in the order of terms."""
    return int.from_bytes(term[:7].ljust(7, b"\0"), "big")


def _written(lang: str, documents: Counter, by_source: dict[str, Counter]) -> Iterator[dict]:
    terms, sources = sorted(documents), sorted(by_source)
    at = {t: i for i, t in enumerate(terms)}
    leaf = np.concatenate([np.fromiter(map(at.__getitem__, by_source[s]), np.int64, len(by_source[s])) for s in sources])
    counts = np.concatenate([np.fromiter(by_source[s].values(), np.int64, len(by_source[s])) for s in sources])
    source = np.repeat(np.arange(len(sources), dtype=np.int32), [len(by_source[s]) for s in sources])
    order = np.argsort(leaf, kind="stable")
    leaf, counts, source = leaf[order], counts[order], source[order]
    in_docs = np.fromiter(map(documents.__getitem__, terms), np.int64, len(terms))
    for i in range(0, len(terms), PIECE):
        some = terms[i : i + PIECE]
        a, b = np.searchsorted(leaf, [i, i + len(some)]).tolist()
        yield {"lang": lang, "source": None, "place": place(some[0]), "leaves": len(some), "trie": frozen(some, in_docs[i : i + PIECE], np.bincount(leaf[a:b] - i, minlength=len(some)), source[a:b], counts[a:b], sources)}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return pa.RecordBatch.from_pylist(rows, schema=fields)


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_COUNTED rows of (lang, source, text) batches: pieces of tries, and a row without one for each group."""
    documents: dict[str, Counter] = {}
    counts: dict[str, dict[str, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang in sorted(counts):
            yield _batch([{"lang": lang, "source": source, "leaves": 0} for source in counts[lang]], _COUNTED)
            for piece in _written(lang, documents[lang], counts[lang]):
                yield _batch([piece], _COUNTED)
        documents.clear()
        counts.clear()

    for batch in batches:
        data, at = as_bytes(batch.column(2))
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        leaves = 0
        for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
            of, in_docs = counts.setdefault(lang, {}).setdefault(source, Counter()), documents.setdefault(lang, Counter())
            held: set[bytes] = set()
            for terms in terms_of(data[at[i] : at[i + 1]].tobytes()):
                of.update(terms)
                held.update(terms)
            in_docs.update(held)
            leaves += len(held)
            if leaves >= FLUSH_LEAVES // 4:
                leaves = 0
                if sum(map(len, documents.values())) + sum(len(c) for x in counts.values() for c in x.values()) >= FLUSH_LEAVES:
                    yield from out()
    yield from out()


def merged(raws: list[bytes], least_documents: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """One trie of many, without leaves of fewer documents."""
    tries = [thawed(raw) for raw in raws]
    terms = sorted(set().union(*(t[0] for t in tries)))
    at = {t: i for i, t in enumerate(terms)}
    sources = sorted(set().union(*(t[5] for t in tries)))
    number = {s: i for i, s in enumerate(sources)}
    documents = np.zeros(len(terms), np.int64)
    cells, sums = [], []
    for own, docs, sizes, source, counts, names in tries:
        mine = np.array([at[t] for t in own], np.int64)
        documents[mine] += docs
        cells.append(np.repeat(mine, sizes) * len(sources) + np.array([number[s] for s in names], np.int64)[source])
        sums.append(counts)
    cell, of = np.unique(np.concatenate(cells), return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, of, np.concatenate(sums))
    keep = documents >= least_documents
    leaf = cell // len(sources)
    some = keep[leaf]
    sizes = np.bincount(leaf, minlength=len(terms))[keep]
    return [t for t, k in zip(terms, keep.tolist(), strict=True) if k], documents[keep], sizes, (cell % len(sources))[some], total[some], sources


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * counts / whole), by long division in steps of 1,000, so that no product leaves a long."""
    out, rest = np.zeros_like(counts), counts
    for _ in range(3):
        rest = rest * 1_000
        out, rest = out * 1_000 + rest // whole, rest % whole
    return out + 1


def _streamed(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """_PARTS of merged tries (lang, trie, sources, totals, kept): parts of the pairs' values, and candidates."""
    for batch in batches:
        for row in batch.to_pylist():
            names, whole, kept = row["sources"], np.array(row["totals"], np.int64), row["kept"]
            n = len(names)
            first, second = np.triu_indices(n, 1)
            sums = np.zeros((n, n), np.int64)
            out = []
            if row["trie"] is not None:
                terms, _, sizes, source, counts, own = thawed(row["trie"])
                at = {s: i for i, s in enumerate(names)}
                source = np.array([at[s] for s in own], np.int64)[source]
                ends = np.append(0, np.cumsum(sizes))
                step = max(1, (1 << 20) // max(n, 1))
                for lo in range(0, len(terms), step):
                    hi = min(len(terms), lo + step)
                    cells = slice(int(ends[lo]), int(ends[hi]))
                    c = np.zeros((n, hi - lo), np.int64)
                    c[source[cells], np.repeat(np.arange(hi - lo), sizes[lo:hi])] = counts[cells]
                    p = shares(c + 5, (whole + 5 * kept)[:, None])
                    q = shares(c.sum(0) + 5, int(whole.sum()) + 5 * kept)
                    for s in range(n):
                        sums[s, s + 1 :] += np.abs(p[s + 1 :] - p[s]).sum(1)
                        f = np.where(c[s] > 0, p[s] - q, 0)
                        held = np.flatnonzero(f > 0)
                        if len(held) > top:
                            held = held[f[held] >= np.partition(f[held], len(held) - top)[len(held) - top]]
                        for t in held[np.argsort(-f[held], kind="stable")[:top]].tolist():
                            out.append({"part": "term", "lang": row["lang"], "source": names[s], "item": terms[lo + t], "value": int(f[t])})
            for a, b in zip(first.tolist(), second.tolist(), strict=True):
                for i, j in ((a, b), (b, a)):
                    out.append({"part": "pair", "lang": row["lang"], "source": names[i], "item": names[j].encode(), "value": int(sums[a, b])})
                if len(out) >= 65_536:
                    yield _batch(out, _PARTS)
                    out = []
            yield _batch(out, _PARTS)


def divergence(documents: DataFrame, least_documents: int = 30, top: int = 50, range_leaves: int = 1_000_000) -> DataFrame:
    """lang, source, part, item, value, rank: every source's distance from each other source of its language, and the
    ``top`` terms that it holds more of than its language does."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    tries = settle(rows.mapInArrow(count, _COUNTED))
    groups = settle(tries.where("trie is null").select("lang", "source").distinct())
    pieces = tries.where("trie is not null").select("lang", "place", "leaves", "trie")
    leaves = pieces.agg(F.sum("leaves")).first()[0] or 0
    n = max(1, -(-leaves // range_leaves))
    cuts = {}
    if n > 1:  # a row a language, at most n numbers in it
        quantiles = F.percentile_approx("place", [i / n for i in range(1, n)], max(10_000, 10 * n))
        cuts = {r["lang"]: np.unique(np.array(r["cuts"], np.int64)) for r in pieces.groupBy("lang").agg(quantiles.alias("cuts")).collect()}
    sent = documents.sparkSession.sparkContext.broadcast(cuts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cut = sent.value.get(row["lang"], np.zeros(0, np.int64))
                terms, docs, sizes, source, counts, names = thawed(row["trie"])
                own = np.searchsorted(cut, [place(terms[0]), place(terms[-1])], "right")
                if own[0] == own[1]:
                    yield _batch([{"lang": row["lang"], "range": int(own[0]), "trie": row["trie"]}], "lang string, range int, trie binary")
                    continue
                ranges = np.searchsorted(cut, [place(t) for t in terms], "right")
                ends = np.append(0, np.cumsum(sizes))
                for r in np.unique(ranges).tolist():
                    a, b = np.searchsorted(ranges, [r, r + 1]).tolist()
                    cells = slice(int(ends[a]), int(ends[b]))
                    yield _batch([{"lang": row["lang"], "range": r, "trie": frozen(terms[a:b], docs[a:b], sizes[a:b], source[cells], counts[cells], names)}], "lang string, range int, trie binary")

    def merge(group: pa.Table) -> pa.Table:
        terms, docs, sizes, source, counts, names = merged(group["trie"].to_pylist(), least_documents)
        if not terms:
            return pa.table({"lang": pa.array([], pa.string()), "trie": pa.array([], pa.binary()), "kept": pa.array([], pa.int64()), "sources": pa.array([], pa.list_(pa.string())), "sums": pa.array([], pa.list_(pa.int64()))})
        sums = np.zeros(len(names), np.int64)
        np.add.at(sums, source, counts)
        return pa.table({"lang": group["lang"].slice(0, 1), "trie": pa.array([frozen(terms, docs, sizes, source, counts, names)], pa.binary()), "kept": pa.array([len(terms)]), "sources": pa.array([names]), "sums": pa.array([sums])})

    kept = settle(pieces.mapInArrow(dealt, "lang string, range int, trie binary").groupBy("lang", "range").applyInArrow(merge, "lang string, trie binary, kept long, sources array<string>, sums array<long>"))
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    per_group = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("x"))
    per_lang = per_group.join(kept.groupBy("lang").agg(F.sum("kept").alias("kept")), "lang", "left")
    per_lang = settle(per_lang.select("lang", F.col("x.source").alias("sources"), F.col("x.total").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept")))
    # a row a language without a trie, so that pairs of a language that keeps nothing are there
    walked = kept.select("lang", "trie").unionByName(per_lang.select("lang", F.lit(None).cast("binary").alias("trie")))
    few = groups.count() <= 1_000_000
    parts = walked.join(F.broadcast(per_lang) if few else per_lang, "lang").select("lang", "trie", "sources", "totals", "kept")
    parts = settle(parts.mapInArrow(lambda batches: _streamed(batches, top), _PARTS))
    pairs = parts.where("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = parts.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(32)))
    rank = lambda *more: F.row_number().over(Window.partitionBy("part", "lang", "source", *more).orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", rank("salt")).where(F.col("rank") <= top).drop("salt")
    ranked = terms.withColumn("rank", rank()).where(F.col("rank") <= top).unionByName(pairs.withColumn("rank", rank()))
    return ranked.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
