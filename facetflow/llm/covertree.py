"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of one label are compared by cosine; on unit vectors a cosine of at least c is a distance of at most
sqrt(2 - 2c). Trees have nested levels with halving radii: a node's centre is also a centre of the level below. Two
nodes whose centres are farther apart than the distance and both covering radii hold no link and are dropped; two nodes
whose farthest members are near enough are linked as a whole, without a look at their members; else the wider of the two
is replaced by its children, and members of leaves are compared by exact cosine.

The upper levels are built at the driver from a bounded sample (``sample`` vectors); every vector goes down to the
deepest node whose radius holds it, and stays there. So a group of near copies has nodes of its own, whatever its size,
and is set apart from vectors that are near nothing. Pairs of nodes are dropped or linked by radii measured on all
vectors; what is left are blocks of at most about ``block_rows`` vectors of one node and vectors of other nodes that
lie within its reach, in which tasks build the lower levels and traverse them. No task holds a whole label or node.

Equal vectors of a label are one class with a weight. Tasks return a row a class with the number of its links and the
smallest id it is tied to within the block, never pairs. Nothing is missed: only bounds drop pairs, with a margin
for rounding.

Every row is returned. Rows with a null label, a null or zero vector, null or non-finite components link with nothing, nor
do vectors of different lengths with each other, nor rows without an id (component null, kept). Rows that share an
id are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetflow.llm._shared import components, settle

MARGIN = 1e-6
LEAF, FAN = 48, 64
_LINKED = "key long, n long, root long"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their magnitude."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """Nodes as columns: centre (unit vector), covering radius, children from ``child`` on, members from ``start`` on."""

    def __init__(self) -> None:
        self.centre, self.radius, self.child, self.children, self.start, self.members = [], [], [], [], [], []

    def add(self, centre: np.ndarray, radius: float, start: int, members: int) -> int:
        for column, x in zip((self.centre, self.radius, self.child, self.children, self.start, self.members), (centre, radius, -1, 0, start, members), strict=True):
            column.append(x)
        return len(self.radius) - 1

    def done(self) -> Tree:
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.child, self.children, self.start, self.members = (np.array(c, np.int64) for c in (self.child, self.children, self.start, self.members))
        return self


def grow(tree: Tree, u: np.ndarray, offset: int, floor: float) -> tuple[int, np.ndarray]:
    """Adds a tree over the rows of u; its root, and the order of the rows in which members of a node follow each other.

    A node's children are centres at half its radius, its own the first and then the farthest row each time, until all
    are covered or there are FAN of them; a child's radius is that of its members.
    """
    order = np.arange(len(u))
    from_root = distances(u, u[:1])[:, 0]
    root = tree.add(u[0], float(from_root.max()), offset, len(u))
    waiting = [(root, 0, len(u), from_root)]
    while waiting:
        node, lo, hi, near = waiting.pop()
        if hi - lo <= LEAF or tree.radius[node] <= floor:
            continue
        rows, half = order[lo:hi], tree.radius[node] / 2
        mine = u[rows]
        of = np.zeros(len(rows), np.int64)
        centres = [tree.centre[node]]
        while len(centres) < FAN:
            far = int(near.argmax())
            if near[far] <= half:
                break
            apart = distances(mine, mine[far : far + 1])[:, 0]
            of[apart < near] = len(centres)
            near = np.minimum(near, apart)
            centres.append(mine[far])
        by = np.argsort(of, kind="stable")
        order[lo:hi], near = rows[by], near[by]
        ends = np.searchsorted(of[by], np.arange(len(centres) + 1))
        tree.child[node], tree.children[node] = len(tree.radius), 0
        for c, centre in enumerate(centres):
            a, b = int(ends[c]), int(ends[c + 1])
            if a < b:
                tree.children[node] += 1
                waiting.append((tree.add(centre, float(near[a:b].max()), offset + lo + a, b - a), lo + a, lo + b, near[a:b]))
    return root, order


def traverse(tree: Tree, a: np.ndarray, b: np.ndarray, reach: float, ends_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """From the pairs of nodes (a, b): pairs to compare member by member, and pairs that are linked as a whole,
    which are leaves only if asked for."""
    compare, whole = [], []
    while len(a):
        parts = [slice(i, i + 65_536) for i in range(0, len(a), 65_536)]
        apart = np.concatenate([np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", tree.centre[a[p]], tree.centre[b[p]]), 0)) for p in parts])
        both = tree.radius[a] + tree.radius[b]
        near = apart - both <= reach + MARGIN
        a, b, apart, both = a[near], b[near], apart[near], both[near]
        inside = np.where(a == b, 2 * tree.radius[a], apart + both) <= reach - MARGIN
        if ends_only:
            inside &= (tree.children[a] == 0) & (tree.children[b] == 0)
        whole.append(np.stack([a[inside], b[inside]], 1))
        a, b = a[~inside], b[~inside]
        ends = (tree.children[a] == 0) & (tree.children[b] == 0)
        compare.append(np.stack([a[ends], b[ends]], 1))
        a, b = a[~ends], b[~ends]
        same = a == b
        first, second = [], []
        for node in a[same].tolist():
            i, j = np.triu_indices(int(tree.children[node]))
            first.append(i + tree.child[node])
            second.append(j + tree.child[node])
        a, b = a[~same], b[~same]
        left = (tree.children[b] == 0) | ((tree.children[a] > 0) & (tree.radius[a] >= tree.radius[b]))
        for wide, other, side in ((a[left], b[left], 0), (b[~left], a[~left], 1)):
            times = tree.children[wide]
            children = np.repeat(tree.child[wide], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            (second if side else first).append(children)
            (first if side else second).append(np.repeat(other, times))
        a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (first, second))
    empty = np.zeros((0, 2), np.int64)
    return np.concatenate([empty, *compare]), np.concatenate([empty, *whole])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place each of n places is tied to by the edges."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def links(x: np.ndarray, weights: np.ndarray, left: int | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the rows that each row is linked with, and the first row each is tied to; ``left`` rows are compared
    with the rest, or all with each other where it is None."""
    u, reach = unit(x), (2 - 2 * cosine) ** 0.5
    tree, parts = Tree(), [(0, len(x))] if left is None else [(0, left), (left, len(x))]
    roots, orders = zip(*(grow(tree, u[a:b], a, reach / 4) for a, b in parts), strict=True)
    order = np.concatenate([o + a for o, (a, _) in zip(orders, parts, strict=True)])
    tree.done()
    u, x, w = u[order], x[order], weights[order]
    total = np.append(0, np.cumsum(w))
    n = np.zeros(len(u), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    compare, whole = traverse(tree, np.array([roots[0]]), np.array([roots[-1]]), reach)
    span = lambda node: slice(int(tree.start[node]), int(tree.start[node] + tree.members[node]))
    for i, j in whole.tolist():
        one, two = span(i), span(j)
        if i == j:
            n[one] += total[one.stop] - total[one.start] - w[one]
        else:
            n[one] += total[two.stop] - total[two.start]
            n[two] += total[one.stop] - total[one.start]
        both = np.r_[one, two]
        ends.append((both, np.full(len(both), one.start)))
    compare = compare[np.lexsort((compare[:, 1], compare[:, 0]))]
    first = np.unique(compare[:, 0], return_index=True)[1].tolist()
    for lo, hi in itertools.pairwise([*first, len(compare)]):
        rows = np.r_[span(compare[lo, 0])]
        others = np.concatenate([np.r_[span(j)] for j in compare[lo:hi, 1]])
        c = u[rows] @ u[others].T
        hit = c >= cosine
        for r, o in np.argwhere(np.abs(c - cosine) < 1e-9):  # as the definition rounds it
            p, q = x[rows[r]], x[others[o]]
            hit[r, o] = float(p @ q) / (float(p @ p) ** 0.5 * float(q @ q) ** 0.5) >= cosine
        hit &= rows[:, None] != others
        n[rows] += hit @ w[others]
        outside = (others < rows[0]) | (others > rows[-1])
        n[others[outside]] += w[rows] @ hit[:, outside]
        some = hit.any(0)
        ends.append((others[some], rows[hit[:, some].argmax(0)]))
        counts = hit.astype(np.float32)
        r, s = np.nonzero(np.triu(counts @ counts.T, 1))
        ends.append((rows[r], rows[s]))
    tied = _roots(len(u), *(np.concatenate([np.zeros(0, np.int64), *(e[k] for e in ends)]) for k in (0, 1)))
    out_n, out_tied = np.empty_like(n), np.empty_like(tied)
    out_n[order], out_tied[order] = n, order[tied]
    return out_n, out_tied


def upper_levels(labels: list[str], x: np.ndarray, members: int) -> dict[str, np.ndarray]:
    """Nodes of the upper levels as columns, coarse ones first: label, parent, radius, centre. A node below a root holds
    ``members`` of the sample at least, so their number is bounded by the sample's."""
    u = unit(x)
    found: list[tuple[str, int, float, np.ndarray]] = []
    level = []
    for label in sorted(set(labels)):
        rows = np.flatnonzero(np.array(labels, object) == label)
        level.append((len(found), rows))
        found.append((label, -1, 2.0, u[rows[0]]))
    radius = 1.0
    while level and radius > 0.1:
        below = []
        for parent, rows in level:
            open_ = rows
            while len(open_) >= members:
                # the node's own centre first, then rows that no centre covers
                tries = np.concatenate([found[parent][3][None], u[open_[:512]]]) if open_ is rows else u[open_[:512]]
                apart = distances(tries, u[open_])
                free = np.ones(len(open_), bool)
                for k in range(len(tries)):
                    held = free & (apart[k] <= radius)
                    if held.sum() >= members:
                        below.append((len(found), open_[held]))
                        found.append((found[parent][0], parent, radius, tries[k]))
                        free &= ~held
                free[: len(tries)] = False  # tried, and too few around them
                open_ = open_[free]
        level, radius = below, radius / 2
    columns = zip(*found, strict=True)
    return dict(zip(("label", "parent", "radius", "centre"), (np.array(list(c), object if k == 0 else None) for k, c in enumerate(columns)), strict=True))


def _buckets(nodes: dict[str, np.ndarray], measured: dict[int, float], reach: float) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Dual traversal of the upper levels by measured radii: nodes whose vectors may reach each node's (coarser first),
    and pairs of nodes that are linked as a whole."""
    n = len(nodes["parent"])
    tree, children = Tree(), [[] for _ in range(n)]
    for i, p in enumerate(nodes["parent"].tolist()):
        if p >= 0:
            children[p].append(i)
    cover = np.array([measured.get(i, 0.0) for i in range(n)])
    for i in range(n - 1, -1, -1):
        for c in children[i]:
            cover[i] = max(cover[i], cover[c] + float(distances(nodes["centre"][i : i + 1], nodes["centre"][c : c + 1])[0, 0]))
    starts = []
    waiting = []
    for i in np.flatnonzero(nodes["parent"] < 0).tolist():
        at = tree.add(nodes["centre"][i], cover[i], i, 1)
        starts.append(at)
        waiting.append((at, i))
    while waiting:  # a node's own vectors are a leaf beside its children
        at, i = waiting.pop()
        tree.child[at], tree.children[at] = len(tree.radius), 0
        if i in measured:
            tree.add(nodes["centre"][i], measured[i], i, 1)
            tree.children[at] += 1
        for c in children[i]:
            waiting.append((tree.add(nodes["centre"][c], cover[c], c, 1), c))
            tree.children[at] += 1
    tree.done()
    compare, whole = (tree.start[p] for p in traverse(tree, np.array(starts), np.array(starts), reach, True))
    order = lambda p: np.sort(p, 1)  # noqa: E731  coarse nodes have smaller numbers
    compare = order(compare)
    return {int(a): np.unique(compare[(compare[:, 0] == a) & (compare[:, 1] != a), 1]) for a in np.unique(compare[:, 0])}, order(whole)


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
    sample: int = 8_192, members: int = 16, block_rows: int = 4_096, seed: int = 11,
) -> DataFrame:
    """id_column, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    reach = (2 - 2 * cosine) ** 0.5
    x = F.col(vector_column).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    usable = F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & x.isNotNull() & finite
    label = F.when(usable, F.concat_ws(":", F.size(x), F.col(label_column).cast("string")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), label.alias("label"), F.when(usable, x).alias("x"))
    classes = settle(rows.where("label is not null").groupBy("label", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).withColumn("key", F.monotonically_increasing_id()))

    drawn = classes.orderBy(F.xxhash64(F.lit(seed), "id"), "key").limit(sample).select("label", "x").collect()
    by_length: dict[int, list] = {}
    for r in drawn:
        by_length.setdefault(len(r["x"]), []).append(r)
    trees = {d: upper_levels([r["label"] for r in some], np.array([r["x"] for r in some]), members) for d, some in by_length.items()}
    first, at = {}, 0
    for d, nodes in trees.items():
        first[d], at = at, at + len(nodes["parent"])
    sent = spark.sparkContext.broadcast((trees, first))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class at the deepest node that holds it; labels that the sample lacks have one node, -1."""
        trees, first = sent.value
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            node, near = np.full(len(labels), -1), np.full(len(labels), 2.0)
            raw = np.empty(len(labels), object)
            lists = batch.column(1)
            for label in set(labels.tolist()):
                of = np.flatnonzero(labels == label)
                m = lists.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), -1)
                for i, v in zip(of.tolist(), np.ascontiguousarray(m), strict=True):
                    raw[i] = v.tobytes()
                nodes = trees.get(m.shape[1])
                if nodes is None or not (nodes["label"] == label).any():
                    continue
                u, mine = unit(m), np.flatnonzero(nodes["label"] == label)
                at = np.full(len(of), mine[0])
                apart = distances(u, nodes["centre"][mine[:1]])[:, 0]
                for radius in np.unique(nodes["radius"][mine])[::-1][1:]:
                    level = mine[nodes["radius"][mine] == radius]
                    for i in range(0, len(of), 2_048):
                        part = slice(i, i + 2_048)
                        there = distances(u[part], nodes["centre"][level])
                        there[nodes["parent"][level] != at[part][:, None]] = np.inf
                        best = there.argmin(1)
                        far = np.take_along_axis(there, best[:, None], 1)[:, 0]
                        down = far <= radius
                        at[part], apart[part] = np.where(down, level[best], at[part]), np.where(down, far, apart[part])
                node[of], near[of] = at + first[m.shape[1]], apart
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "node": pa.array(node.astype(np.int32)), "near": near, "x": pa.array(raw, pa.binary()), "w": batch.column(2), "key": batch.column(3)})

    filed = settle(classes.select("label", "x", "w", "key").mapInArrow(file, "label string, node int, near double, x binary, w long, key long"))
    sizes = settle(filed.groupBy("label", "node").agg(F.count(F.lit(1)).alias("rows"), F.max("near").alias("radius"), F.sum("w").alias("weight"), F.min("key").alias("least")))
    measured = {r["node"]: r for r in sizes.where("node >= 0").collect()}  # at most as many as nodes, which the sample bounds
    reached: dict[int, np.ndarray] = {}
    wholes = []
    for d, nodes in trees.items():
        a, b = _buckets(nodes, {n - first[d]: r["radius"] for n, r in measured.items() if first[d] <= n < first[d] + len(nodes["parent"])}, reach)
        reached |= {k + first[d]: v + first[d] for k, v in a.items()}
        wholes += (b + first[d]).tolist()

    # nodes linked as a whole: weights for all their classes, ties from class to class only by the smallest id
    alone = {a for a, b in wholes if a == b}
    gain: dict[int, int] = {}
    ties = []
    for a, b in wholes:
        if a == b:
            gain[a] = gain.get(a, 0) + measured[a]["weight"]
        else:
            gain[a] = gain.get(a, 0) + measured[b]["weight"]
            gain[b] = gain.get(b, 0) + measured[a]["weight"]
            ties.append((measured[a]["least"], measured[b]["least"]))
    counted_nodes = [(n, g, n in alone, measured[n]["least"]) for n, g in gain.items()]
    given = F.broadcast(spark.createDataFrame(counted_nodes, "node int, gain long, alone boolean, least long"))
    as_whole = filed.join(given, "node").select("key", (F.col("gain") - F.when(F.col("alone"), F.col("w")).otherwise(0)).alias("n"), F.col("least").alias("root"))

    centres = {n: trees[d]["centre"][n - first[d]] for d in trees for n in range(first[d], first[d] + len(trees[d]["parent"])) if n in measured}
    reaching = spark.sparkContext.broadcast({a: (b, np.array([centres[i] for i in b]), np.array([measured[i]["radius"] for i in b])) for a, b in reached.items() if len(b)})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes once for each other node whose vectors they may be near to."""
        for batch in batches:
            node = batch.column(1).to_numpy()
            for a in np.unique(node).tolist():
                if a not in reaching.value:
                    continue
                others, centre, radius = reaching.value[a]
                of = np.flatnonzero(node == a)
                for i in range(0, len(of), 1_024):
                    some = batch.take(pa.array(of[i : i + 1_024]))
                    u = unit(np.frombuffer(b"".join(some.column(3).to_pylist())).reshape(some.num_rows, -1))
                    r, c = np.nonzero(distances(u, centre) <= radius + reach + MARGIN)
                    if len(r):
                        out = some.take(pa.array(r))
                        yield pa.RecordBatch.from_arrays([out.column(0), pa.array(others[c].astype(np.int32)), *out.columns[3:]], names=["label", "node", "x", "w", "key"])

    probes = settle(filed.mapInArrow(probe, "label string, node int, x binary, w long, key long"))
    asked = settle(probes.groupBy("node").agg(F.count(F.lit(1)).alias("asked")))
    parts = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(0)) / block_rows).cast("int")
    place = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    blocked = sizes.join(asked, "node", "left").select("label", "node", parts("rows").alias("blocks"), parts("asked").alias("askers"))
    single = F.array(*[F.lit(n) for n in sorted(alone)]).cast("array<int>")
    placed = filed.select("label", "node", "x", "w", "key").join(blocked, ["label", "node"]).withColumn("own", place("blocks"))
    sides = ["label", "node", "x", "w", "key", "one", "two", "crossed", "side"]
    within = placed.where(~F.array_contains(single, F.col("node"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    within = within.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other"), "crossed": F.lit(False), "side": (F.col("own") > F.col("other")).cast("int")})
    stored = placed.where("askers > 0").withColumn("two", F.explode(F.sequence(F.lit(0), F.col("askers") - 1))).withColumns({"one": F.col("own"), "crossed": F.lit(True), "side": F.lit(0)})
    asking = probes.join(blocked, ["label", "node"]).withColumn("one", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"two": place("askers"), "crossed": F.lit(True), "side": F.lit(1)})

    def compare(group: pa.Table) -> pa.Table:
        side = group["side"].to_numpy()
        group = group.take(pa.array(np.argsort(side, kind="stable")))
        left = int((side == 0).sum())
        crossed = group["crossed"][0].as_py() or group["one"][0].as_py() != group["two"][0].as_py()
        if crossed and left in (0, group.num_rows):
            return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in _LINKED.split(", ")})
        v = np.frombuffer(b"".join(group["x"].to_pylist())).reshape(group.num_rows, -1)
        n, tied = links(v, group["w"].to_numpy(), left if crossed else None, cosine)
        keys, some = group["key"].to_numpy(), n > 0
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, tied, keys)
        return pa.table({"key": keys[some], "n": n[some], "root": least[tied[some]]})

    met = within.select(*sides).unionByName(stored.select(*sides)).unionByName(asking.select(*sides)).groupBy("label", "node", "crossed", "one", "two").applyInArrow(compare, _LINKED)
    linked = settle(met.unionByName(as_whole))
    edges = linked.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(spark.createDataFrame(ties, "a long, b long")).where("a <> b").distinct()
    tied = settle(components(edges).withColumnRenamed("label", "of").join(classes.select("key", "id"), F.col("node") == F.col("key")).select("key", "of", "id"))
    tied = tied.select("key", "of").join(tied.groupBy("of").agg(F.min("id").alias("component")), "of").select("key", "component")
    per_class = classes.join(linked.groupBy("key").agg(F.sum("n").alias("n")), "key", "left").join(tied, "key", "left")
    per_class = per_class.select("label", "x", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.join(per_class, ["label", "x"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
