"""Linked vectors, mined negatives and term divergence against brute force, on hot, tied, odd and empty tables."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.llm import covertree, negatives, queries, tries

VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors(rng, n, d=12):
    """Unclustered vectors, a group of equal ones, a group of near copies, and scaled copies, over three labels."""
    x = rng.standard_normal((n, d))
    x[: n // 4] = x[0]
    x[n // 4 : n // 2] = x[n // 4] + 0.08 * rng.standard_normal((n // 4, d))
    x[n // 2 : n // 2 + 20] = x[n // 2 + 20 : n // 2 + 40] * 3
    labels = rng.integers(0, 3, n)
    labels[: n // 2] = 1
    return [(int(i), [float(np.float32(v)) for v in row], int(label)) for i, row, label in zip(rng.permutation(n), x, labels, strict=True)]


def _linked(rows, cosine):
    links, label = Counter(), {}
    for group in {r[2] for r in rows}:
        some = sorted((r for r in rows if r[2] == group), key=lambda r: r[0])
        x = np.array([r[1] for r in some])
        x /= np.linalg.norm(x, axis=1)[:, None]
        hit = x @ x.T >= cosine
        np.fill_diagonal(hit, False)
        at = np.arange(len(some))
        while True:
            low = np.minimum(at, np.where(hit, at[None], len(some)).min(1))
            if (low == at).all():
                break
            at = low
        for i, r in enumerate(some):
            links[r[0]], label[r[0]] = int(hit[i].sum()), some[at[i]][0]
    return {(r[0], links[r[0]], label[r[0]], label[r[0]] == r[0]) for r in rows}


@pytest.mark.parametrize("cosine, sample, block_rows", [(0.93, 8_192, 4_096), (0.93, 64, 50), (0.7, 300, 64), (0.5, 1, 40)])
def test_links_against_brute_force(spark, cosine, sample, block_rows):
    """With whole nodes, nodes cut in blocks, nodes that reach each other, and no upper levels."""
    rows = _vectors(np.random.default_rng(sample), 800)
    got = covertree.near_duplicates(spark.createDataFrame(rows, VECTORS), cosine, sample=sample, members=4, block_rows=block_rows)
    assert set(map(tuple, got.collect())) == _linked(rows, cosine)


@pytest.mark.parametrize("left", [None, 150])
def test_a_block_against_its_matrix(left):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((200, 5)), rng.standard_normal((1, 5)) + 0.01 * rng.standard_normal((200, 5))])[rng.permutation(400)]
    w = rng.integers(1, 9, 400)
    n, tied = covertree.links(x, w, left, 0.9)
    u = covertree.unit(x)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    if left:
        hit[:left, :left] = hit[left:, left:] = False
    assert (n == hit @ w).all()
    assert ((hit.sum(1) == 0) == (np.bincount(tied, minlength=400)[tied] == 1)).all() and all(tied[i] == tied[j] for i, j in np.argwhere(hit))


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, float("inf")], 1), (7, [1.0, 0.0], None),
        (None, [1.0, 0.0], 1), (8, [], 1), (9, [1.0], 1), (10, [2.0], 1), (11, [1e30, 1e28], 1), (12, [1e-30, 0.0], 1), (13, [1.0, 0.0], 2),
    ]
    table = spark.createDataFrame(rows, VECTORS).withColumns({"x": F.lit(1), "key": F.lit("k"), "w": F.lit(None), "node": F.lit(0)})
    got = sorted(map(tuple, covertree.near_duplicates(table).collect()), key=str)
    linked = {1: (3, 1), 11: (3, 1), 12: (3, 1), 9: (1, 9), 10: (1, 9)}
    assert got == sorted(((i, *linked.get(i, (0, i)), i is None or linked.get(i, (0, i))[1] == i) for i, *_ in rows), key=str)
    assert covertree.near_duplicates(table.limit(0)).collect() == []
    mined = negatives.mine(table, F.lit(True)).collect()
    assert {r.anchor_id for r in mined} <= {1, 2, 11, 12, 13} and negatives.mine(table.limit(0), F.lit(True)).collect() == []


def _mined(rows, anchors, positives, k, low, high):
    q = {i: [math.floor(256 * v) for v in x] for i, x, _ in rows}
    label = {i: y for i, _, y in rows}
    out = []
    for a in anchors:
        ranked = sorted((-sum(x * y for x, y in zip(q[a], q[i], strict=True)), i) for i in q if i != a)
        for p, i in [r for r in ranked if label[r[1]] == label[a]][:positives]:
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate([r for r in ranked if label[r[1]] != label[a] and -low * p <= -100 * r[0] <= -high * p][:k])]
    return sorted(out)


@pytest.mark.parametrize("base, gather, broadcast_bytes", [(4_096, 64, 64 << 20), (4, 1, 0), (16, 8, 64 << 20)])
def test_negatives_against_brute_force(spark, base, gather, broadcast_bytes, monkeypatch):
    """A vector that a third of the rows share is positive and negative; digits of scores and of ids in several rounds."""
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    rng = np.random.default_rng(9)
    rows = [(int(i) * 1_000_003 - 10**8, x, int(rng.integers(0, 3)) if i % 2 else y) for i, x, y in _vectors(rng, 360)]
    ids = sorted(r[0] for r in rows)[::12]
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = negatives.mine(table, F.col("id").isin(ids), positives=4, negatives=5, low=30, high=100, base=base, gather=gather, broadcast_bytes=broadcast_bytes)
    assert sorted(map(tuple, got.collect())) == _mined(rows, ids, 4, 5, 30, 100)


def test_negatives_of_large_components_and_far_ids(spark):
    """Products beyond the whole numbers of floating point, scores below zero, and ids at the ends of a long."""
    rows = [(-(2**63), [1e5, 2e5 + 1], 1), (2**63 - 1, [1e5 + 0.25, 2e5], 1), (0, [1e5, 1e5], 2), (5, [1e5, 1e5], 2), (2**62, [1e5, 1e5], 3), (7, [-1e5, 1.0], 2), (8, [1e300, 1.0], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    got = negatives.mine(spark.createDataFrame(rows, schema), F.lit(True), gather=1, negatives=2, base=8).collect()
    assert sorted(map(tuple, got)) == _mined(rows[:-1], [r[0] for r in rows[:-1]], 5, 2, 50, 95)


def _divergence(rows, least, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        of = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        of[None] = {t: sum(c[t] for c in of.values()) for t in kept}
        p = {s: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()} for s, c in of.items()}
        for s in p.keys() - {None}:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p.keys() - {None, s})
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if of[s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, part, x.decode(), -v, i + 1) for part, some in (("pair", pairs), ("term", terms)) for i, (v, x) in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("piece, flush, leaves, slice_bytes", [(4_096, 1_000_000, 1_000_000, 4 << 20), (7, 40, 30, 16)])
def test_divergence_against_counters(spark, monkeypatch, piece, flush, leaves, slice_bytes):
    """Null and odd texts, ties in plenty, terms of prefixes of each other and beyond ASCII, and groups without terms."""
    for name, value in (("PIECE", piece), ("FLUSH_LEAVES", flush), ("SLICE_BYTES", slice_bytes)):
        monkeypatch.setattr(tries, name, value)
    rng = np.random.default_rng(2)
    vocabulary = ["a", "aa", "aab", "ÄÖ", "éa", "É", "あい", "x" * 70, "x" * 70 + "y", "Abstand", "\U0001f600"] + [f"{a}{b}" for a in "bcdefgh" for b in "ijklmnopq"]
    rows = [(str(rng.choice(["en", "de"])), str(rng.choice(["s0", "s0", "s1", "ö"])), " ".join(rng.choice(vocabulary, 12)) + "1 2-3_a'b\x00c") for _ in range(300)]
    rows += [("en", "empty", ""), ("en", None, None), (None, None, "one two"), ("fr", "x", "rare"), ("fr", "y", None), ("en", "s1", "A" * 100)]
    table = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"item": F.lit(1), "trie": F.lit(None), "rank": F.lit("r")}).repartition(6)
    got = tries.divergence(table, least_documents=6, top=9, range_leaves=leaves)
    assert sorted(map(tuple, got.collect())) == _divergence(rows, 6, 9)
    assert tries.divergence(table.limit(0)).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    whole = rng.integers(1, 9 * 10**15, 200)
    counts = (whole * rng.random(200)).astype(np.int64)
    assert tries.shares(counts, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(counts, whole, strict=True)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    got = queries.queries()[name](spark, folder)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
