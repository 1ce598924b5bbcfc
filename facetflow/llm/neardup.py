"""MinHash near-duplicates with tensored banding.

A document's set holds its distinct k-word shingles (fewer words: the whole sequence as one; no words: nothing, and it
is linked with nothing). Two documents are linked when the Jaccard similarity of their full sets is at least
``threshold``; a component is what links connect.

Candidates. Table keys combine pairs from two smaller collections: m left and m right hashes of r minima each give
m * m tables of 2 r minima, for 2 m r minhashes instead of 2 m m r. m is the least for which a pair at the threshold is
missed with a probability of at most ``miss`` (a pair is found when it agrees in some left and in some right hash).
Links. Texts of equal word sequences are one node. Nodes that share buckets, directly or through others, form a
cluster. A cluster of up to GROUP nodes and BYTES of text is compared within one task: counts of shared shingles by
matrix products, of which a star a component comes out. In a larger one all pairs are never compared: a pivot, the
member whose shingles most others hold, is compared with each member. Let x and y be members that are linked, x not
linked with pivot P. Either both hold a shingle that P lacks: members meet again in buckets of (P, shingle that P
lacks), where it is enough that x enters with as many of those shingles, rarest first, as leave no room for the overlap
it needs (prefix filtering; any one order serves, so rarity is that of a table of fixed size). Or all that they share
lies in P: then each has the share ``threshold`` of its own shingles there, and their sizes differ by no more than that
ratio, so they meet in buckets of (P, shingle of P, band of sizes), by the same kind of prefix and in two neighbouring bands.
Buckets of one component are done. Of others, those of up to PAIRED members compare members of different components with
each other; larger ones join their members to smaller clusters, which go the same way with pivots of
their own; beside the central one, some members of the smallest components are pivots, so that a few
strangers among many copies are soon done with. A member that was a pivot has met all others of its cluster and leaves.
Clusters in which the members outside of the largest component fill at most STRANGE blocks of half a GROUP, and all once a
round doesn't halve what is left to compare, have no more rounds: those members are compared with all others of their
cluster, two blocks to a task, of which again a star a component comes out. So
within a cluster no link between components is lost: all ways are exact, and
GROUP, BYTES, PAIRED and STRANGE only choose the cheaper one.
Verification reads both texts and compares the full sets of 64-bit shingle hashes.

Nothing is gathered at the driver; tables between rounds lie in the shared folder. Null and empty texts have
n_shingles 0 and are their own component; a null doc_id is never linked (component_id null, kept false). Rows that
repeat a doc_id are kept; texts that share a doc_id count as one document for linking. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetflow.llm._shared import bucket_components, components, counted, forget_since, release, settle, settled_so_far, with_keys
from facetflow.llm._words import blocks, mix, shingles

#: Minima in each left or right hash.
ROWS = 3
#: Documents and bytes of text that are compared within one task, and shared shingles to a matrix product.
GROUP, BYTES, COLUMNS = 2048, 16 << 20, 2048
#: Pivots of small components in a round, and members of a bucket that are compared with each other.
STRANGERS, PAIRED = 4, 24
#: Blocks of members outside of a cluster's largest component up to which blocks are compared without another round.
STRANGE = 4
#: Size of the table of rarities, as a power of two.
BITS = 21
#: Pairs of ids (16 bytes each) that are broadcast.
SMALL = 100_000
_U = np.uint64


def collections_for(threshold: float, miss: float) -> int:
    """Hashes a side for which a pair at the threshold is missed with at most this probability."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - threshold**ROWS)))


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of texts, shingle hashes in a row, where each text's begin, hashes of whole word sequences)."""
    for i, j, words in blocks(texts):
        h = words.hashes()
        first, n = words.first, np.diff(words.first)
        full = shingles(h, k)
        size = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        begin = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint64)
        long = n >= k
        own = size[long]
        at = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out[np.repeat(begin[long], own) + at] = full[np.repeat(first[:-1][long], own) + at] if len(full) else 0
        # hashes of whole sequences: place-dependent sums over the words
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))])
        whole = mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64))
        out[begin[(n > 0) & ~long]] = whole[(n > 0) & ~long]
        yield j - i, out, np.append(begin, len(out)), whole


def signatures(documents: DataFrame, k: int, m: int, seed: int = 5) -> DataFrame:
    """doc_id, n_shingles, node (hash of the word sequence) and the keys of all m * m tables."""
    rng = np.random.Generator(np.random.PCG64(seed))
    multiply = rng.integers(1, 1 << 63, 2 * m * ROWS, dtype=np.uint64) * _U(2) + _U(1)
    add = rng.integers(1, 1 << 63, 2 * m * ROWS, dtype=np.uint64)
    tables = np.arange(m * m, dtype=np.uint64).reshape(1, m, m) * _U(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, hashes, begin, whole in _sets(batch.column(1), k):
                size = np.diff(begin)
                some = np.flatnonzero(size)
                minima = np.zeros((len(some), 2 * m * ROWS), np.uint64)
                for f in range(2 * m * ROWS if len(some) else 0):
                    minima[:, f] = np.minimum.reduceat((hashes ^ add[f]) * multiply[f], begin[:-1][some])
                sides = np.zeros((len(some), 2 * m), np.uint64)
                for r in range(ROWS):
                    sides = mix(sides + minima[:, r::ROWS])
                keys = mix(mix(sides[:, :m, None] + tables) + sides[:, None, m:]).reshape(len(some), m * m)
                counts = np.zeros(n, np.int64)
                for i in some:
                    counts[i] = len(np.unique(hashes[begin[i] : begin[i + 1]]))
                offsets = np.zeros(n + 1, np.int32)
                offsets[1:] = np.cumsum(np.where(size > 0, m * m, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + n], pa.array(counts), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))],
                    names=["doc_id", "n_shingles", "node", "keys"],
                )
                at += n

    return documents.mapInArrow(run, "doc_id long, n_shingles long, node long, keys array<long>")


def rarity(texts: DataFrame, k: int) -> np.ndarray:
    """About how many of the texts hold a shingle, by its last BITS bits: a table of fixed size."""
    parts = 1 << (BITS - 13)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for _, hashes, _, _ in _sets(batch.column(0), k):
                np.add.at(total, (hashes & _U((1 << BITS) - 1)).astype(np.int64), 1)
        rows = [(i, x.tobytes()) for i, x in enumerate(np.split(total, parts)) if x.any()]
        yield pa.RecordBatch.from_pydict({"part": [i for i, _ in rows], "counts": [x for _, x in rows]}, pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())})

    found = texts.select("text").mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros((parts, 1 << 13), np.uint16)
    for r in found:
        out[r["part"]] = np.frombuffer(r["counts"], np.uint16)
    return out.ravel()


def centrality(texts: DataFrame, rare: np.ndarray, k: int) -> DataFrame:
    """(doc, degree): in how many texts a shingle of the document is found, on average."""
    shared = texts.sparkSession.sparkContext.broadcast(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of, mask = shared.value, _U((1 << BITS) - 1)
        for batch in batches:
            at = 0
            for n, hashes, begin, _ in _sets(batch.column(1), k):
                found = np.add.reduceat(np.append(counts_of[(hashes & mask).astype(np.int64)].astype(np.float64), 0), begin[:-1]) / np.maximum(np.diff(begin), 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + n], pa.array(found)], names=["doc", "degree"])
                at += n

    return texts.select("doc_id", "text").mapInArrow(run, "doc long, degree double").groupBy("doc").agg(F.max("degree").alias("degree"))


def compared(pairs: DataFrame, texts: DataFrame, rare: np.ndarray, k: int, numerator: int, denominator: int) -> DataFrame:
    """For pairs (pivot, doc): sizes of both sets, of what they share, and shingles of doc that the pivot lacks and has.

    Of those shingles as many as prefix filtering asks for, rarest first; of those that the pivot has none where they
    alone could not reach the threshold.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of, mask = shared.value, _U((1 << BITS) - 1)
        for batch in batches:
            sizes, lacking, inside = [], [], []
            for (n, x, bx, _), (_, y, by, _) in _together(batch.column(2), batch.column(3), k):
                for i in range(n):
                    p, q = np.unique(x[bx[i] : bx[i + 1]]), np.unique(y[by[i] : by[i + 1]])
                    q = q[np.lexsort((q, counts_of[(q & mask).astype(np.int64)]))]
                    has = np.isin(q, p, assume_unique=True)
                    both = int(has.sum())
                    least = -(-(numerator * len(q) - denominator * both) // denominator)  # shared beyond the pivot
                    sizes.append((len(p), len(q), both))
                    lacking.append(q[~has][: max(0, len(q) - both - max(1, least) + 1)])
                    inside.append(q[has][: both + 1 - -(-numerator * len(q) // denominator)] if least <= 0 else q[:0])
            counts = np.array(sizes, np.int64).reshape(-1, 3)
            lists = []
            for own in (lacking, inside):
                flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
                lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in own])), pa.int32()), pa.array(flat.view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[:, i]) for i in range(3)], *lists], names=["pivot", "doc", "pivot_size", "size", "both", "lacking", "inside"])

    left = texts.select(F.col("doc_id").alias("pivot"), F.col("text").alias("text_p"))
    right = texts.select(F.col("doc_id").alias("doc"), F.col("text").alias("text_d"))
    if pairs.count() <= SMALL:  # a few MB: the texts need not be shuffled
        pairs = F.broadcast(pairs)
        right = right.join(F.broadcast(pairs.select("doc").distinct()), "doc", "left_semi")
    both = pairs.join(left, "pivot").join(right, "doc").select("pivot", "doc", "text_p", "text_d")
    return both.mapInArrow(run, "pivot long, doc long, pivot_size long, size long, both long, lacking array<long>, inside array<long>")


def _together(left: pa.Array, right: pa.Array, k: int, rows: int = 64) -> Iterator[tuple]:
    """The sets of two columns, a few rows at a time."""
    for i in range(0, len(left), rows):
        yield _joined(left[i : i + rows], k), _joined(right[i : i + rows], k)


def _joined(texts: pa.Array, k: int) -> tuple[int, np.ndarray, np.ndarray, None]:
    parts = list(_sets(texts, k))
    begin, base = [np.zeros(1, np.int64)], 0
    for _, hashes, b, _ in parts:
        begin.append(b[1:] + base)
        base += len(hashes)
    return len(texts), np.concatenate([p[1] for p in parts]), np.concatenate(begin), None


def near_duplicates(documents: DataFrame, k: int = 3, numerator: int = 85, denominator: int = 100, miss: float = 0.001) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and rep_id (the smallest doc_id of equal word sequences) for every row."""
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    m = collections_for(numerator / denominator, miss)
    signed = settle(signatures(documents, k, m))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep_id"))
    classes = settle(classes)
    keyed = signed.select("doc_id", "node", "keys").join(classes, ["node"]).where("doc_id = rep_id")
    keyed = keyed.select(F.col("rep_id").alias("doc"), F.explode("keys").alias("key"))
    # a window, so that the rows of all keys are shuffled once
    several = keyed.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("members > 1")
    buckets = settle(several.select("key", "doc").distinct())
    release(documents.sparkSession)
    among = buckets.select(F.col("doc").alias("doc_id")).distinct()
    texts = settle(documents.join(among, "doc_id"))
    labels = _link(buckets, texts, k, numerator, denominator)

    linked = classes.join(labels, classes.rep_id == labels.node_id, "left").select("node", "rep_id", F.coalesce("label", "rep_id").alias("component_id"))
    has = F.col("n_shingles") > 0
    out = signed.select("doc_id", "n_shingles", F.when(has & F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(linked, "node", "left")
    component = F.when(has, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.coalesce("rep_id", "doc_id").alias("rep_id"))


def _link(buckets: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(node_id, label) of all documents that have links."""
    clusters, large = _clusters(buckets, texts)
    links = settle(_within(clusters.where("together"), texts, k, numerator, denominator))
    if large:
        groups = clusters.where("NOT together").select(F.col("cluster").alias("key"), "doc")
        members = settle(texts.join(groups.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi"))
        rare = rarity(members, k)
        central = settle(centrality(members, rare, k))
        links = _rounds(groups, central, links, members, rare, k, numerator, denominator)
    return components(links).select(F.col("node").alias("node_id"), "label")


def _clusters(buckets: DataFrame, texts: DataFrame) -> tuple[DataFrame, int]:
    """(doc, cluster, whether the cluster is small enough to be compared in one task) of documents that share buckets, and
    how many are in larger ones."""
    clusters = settle(bucket_components(buckets))
    bytes_of = texts.select(F.col("doc_id").alias("doc"), F.octet_length("text").cast("long").alias("bytes"))
    sizes = clusters.join(bytes_of, "doc").groupBy("cluster").agg((F.expr(f"count(1) <= {GROUP} AND sum(bytes) <= {BYTES}")).alias("together"))
    return counted(clusters.join(sizes, "cluster").select("doc", "cluster", "together"), ~F.col("together"))


def _rounds(groups: DataFrame, central: DataFrame, links: DataFrame, texts: DataFrame, rare: np.ndarray, k: int, numerator: int, denominator: int) -> DataFrame:
    """``links`` and those within ``groups`` (key, doc), which are disjoint."""
    linked = f"{denominator} * both >= {numerator} * (size + pivot_size - both)"
    edge = (F.col("pivot").alias("a"), F.col("doc").alias("b"))
    labels = components(links).select(F.col("node").alias("doc"), "label")
    before = math.inf
    while True:
        ranked = groups.join(central, "doc").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        sizes = ranked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("alike"))
        ranked = settle(ranked.join(sizes, ["key", "label"]))
        strangers = [F.min(F.struct("alike", F.xxhash64("doc", F.lit(i)).alias("h"), "doc")).alias(f"p{i}") for i in range(STRANGERS)]
        pivots = ranked.groupBy("key").agg(F.max(F.struct("degree", "doc")).alias("top"), *strangers)
        pivots = settle(pivots.select("key", F.col("top.doc").alias("main"), F.array_distinct(F.array("top.doc", *[f"p{i}.doc" for i in range(STRANGERS)])).alias("pivots")))
        pairs = settle(ranked.join(pivots, "key").select("doc", F.explode("pivots").alias("pivot")).where("doc <> pivot"))
        found = settle(compared(pairs, texts, rare, k, numerator, denominator))
        links = settle(links.union(found.where(linked).select(*edge)))
        labels = components(links).select(F.col("node").alias("doc"), "label")

        done = pivots.select(F.explode("pivots").alias("doc"))
        rest = found.join(pivots.select(F.col("main").alias("pivot")), "pivot", "left_semi").join(done, "doc", "left_anti")
        band = F.floor(F.log(F.col("size").cast("double")) / (max(math.log(denominator / numerator), 1e-9) * 1.000001))
        within = rest.select("doc", "pivot", F.explode("inside").alias("shingle"), F.array(band, band + 1).alias("bands"))
        within = within.select("doc", "pivot", "shingle", F.explode("bands").alias("band")).select(F.xxhash64("pivot", "shingle", "band").alias("key"), "doc")
        met = rest.select("doc", F.explode("lacking").alias("shingle"), "pivot").select(F.xxhash64("pivot", "shingle").alias("key"), "doc").union(within).distinct()
        met = settle(met.join(labels, "doc", "left").select("key", "doc", F.coalesce("label", "doc").alias("label")))
        mixed = met.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        more = met.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
        met, many = counted(met.join(mixed, "key").join(more, "key"), F.col("members") > PAIRED)
        few = met.where(f"members <= {PAIRED}")
        few = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.doc < y.doc AND x.label <> y.label")).select(F.col("x.doc").alias("pivot"), F.col("y.doc").alias("doc"))
        direct = settle(few.distinct())
        links = settle(links.union(compared(direct, texts, rare, k, numerator, denominator).where(linked).select(*edge)))
        if not many:
            return links
        clusters, large = _clusters(met.where(f"members > {PAIRED}"), texts)
        links = settle(links.union(_within(clusters.where("together"), texts, k, numerator, denominator)))
        if not large:
            return links
        groups = clusters.where("NOT together").select(F.col("cluster").alias("key"), "doc")
        members, sides = _sides(groups, labels, texts)
        beyond = F.col("strange") > STRANGE
        tasks = sides.where(beyond).agg(F.sum("tasks").alias("n")).first()["n"] or 0
        if tasks > before / 2:  # another round would hardly help
            tasks, beyond = 0, F.lit(False)
        links = settle(links.union(_within(_block_pairs(members, sides.where(~beyond)), texts, k, numerator, denominator)))
        if not tasks:
            return links
        before, groups = tasks, settle(groups.join(sides.where(beyond), "key", "left_semi"))


def _sides(groups: DataFrame, labels: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``groups`` with labels; and for each key the label of most members, the number of blocks that the others fill, that
    of all blocks, and how many pairs of blocks hold all pairs of members of which one is among those others."""
    half = lambda n, size: F.ceil(F.greatest(n / (GROUP / 2), size / (BYTES / 2))).cast("long")
    bytes_of = texts.groupBy(F.col("doc_id").alias("doc")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    members = settle(groups.join(bytes_of, "doc").join(labels, "doc", "left").select("key", "doc", "bytes", F.coalesce("label", "doc").alias("label")))
    alike = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    whole = alike.groupBy("key").agg(F.max(F.struct("n", "label", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    sides = whole.select("key", F.col("top.label").alias("most"), half(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("strange"), half(F.col("top.n"), F.col("top.bytes")).alias("rest"))
    tasks = F.expr("strange * rest + strange * (strange - 1) div 2").alias("tasks")
    return members, settle(sides.select("key", "most", "strange", (F.col("strange") + F.col("rest")).alias("blocks"), tasks))


def _block_pairs(members: DataFrame, sides: DataFrame) -> DataFrame:
    """(doc, cluster): a cluster a pair of blocks, of which at least one is of members outside of the largest component."""
    turn = F.xxhash64("doc", F.lit(STRANGERS))
    block = F.when(F.col("label") == F.col("most"), F.col("strange") + F.pmod(turn, F.col("blocks") - F.col("strange"))).otherwise(F.pmod(turn, F.col("strange")))
    dealt = members.join(sides.where("strange > 0"), "key").withColumn("block", block)
    others = F.expr("filter(sequence(0L, blocks - 1), x -> x <> block AND least(x, block) < strange)")
    pairs = dealt.select("key", "doc", "block", F.explode(others).alias("other"))
    return pairs.select("doc", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cluster"))


def _smallest(docs: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The smallest of the documents that links lead to, for each one."""
    label, done = docs.copy(), np.zeros(len(docs), bool)
    for start in np.argsort(docs, kind="stable"):
        if not done[start]:
            reached = front = np.arange(len(docs)) == start
            while front.any():
                front = linked[front].any(0) & ~reached
                reached = reached | front
            label[reached], done = docs[start], done | reached
    return label


def _within(clusters: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(a, b): a star a component of clusters that are compared in one task each."""

    def run(table: pa.Table) -> pa.Table:
        docs = table.column("doc_id").to_numpy()
        _, hashes, begin, _ = _joined(table.column("text").combine_chunks(), k)
        sets = [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(docs))]
        size = np.array([len(x) for x in sets])
        owner, flat = np.repeat(np.arange(len(docs)), size), np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        same = np.append(False, flat[1:] == flat[:-1])
        again = same | np.append(same[1:], False)
        code, owner = (np.cumsum(~same) - 1)[again], owner[again]
        both = np.zeros((len(docs), len(docs)), np.float32)
        if len(code):
            code = np.unique(code, return_inverse=True)[1]
            cuts = np.searchsorted(code, np.arange(0, code[-1] + COLUMNS + 1, COLUMNS))
            for c in range(len(cuts) - 1):
                part = slice(cuts[c], cuts[c + 1])
                there = np.zeros((len(docs), COLUMNS), np.float32)
                there[owner[part], code[part] - c * COLUMNS] = 1
                both += there @ there.T
        linked = denominator * both.astype(np.int64) >= numerator * (size[:, None] + size - both.astype(np.int64))
        first = _smallest(docs, linked)
        rest = first != docs
        return pa.table({"a": first[rest], "b": docs[rest]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    members = clusters.select(F.col("doc").alias("doc_id"), "cluster")
    return members.join(texts, "doc_id").groupBy("cluster").applyInArrow(run, "a long, b long")


def kept_documents(documents: DataFrame, **how: int | float) -> DataFrame:
    """The rows of which each component keeps one, that of the smallest doc_id (nulls last), with all their columns.

    Rows are compared by their own texts; those without shingles stay, one of each text (null texts all).
    """
    rows = with_keys(documents)
    text = rows.select(F.col("__key").alias("doc_id"), F.col("text").cast("string").alias("text"))
    mark = settled_so_far()
    found = settle(near_duplicates(text, **how).select(F.col("doc_id").alias("__key"), "n_shingles", F.col("component_id").alias("__group")))
    forget_since(documents.sparkSession, mark, found)
    release(documents.sparkSession)
    bare = rows.join(found.where("coalesce(n_shingles, 0) = 0").select("__key"), "__key", "left_semi").select("__key", "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__key"))
    one = bare.where("text is not null").groupBy("text").agg(first.alias("f")).select("f.__key")
    group = rows.select("__key", "doc_id").join(found.where("n_shingles > 0"), "__key").groupBy("__group").agg(first.alias("f")).select("f.__key")
    keep = group.union(one).union(bare.where("text is null").select("__key"))
    return rows.join(keep, "__key", "left_semi").select(*documents.columns)
