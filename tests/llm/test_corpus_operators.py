"""Operators on texts against brute force, round trips and held-out rows, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from facetflow.llm import ann, bpe, neardup, ngram, packing, passages, quotes, rules, sharding, toxicity

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
P = pytest.importorskip("public_tokenizers")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    same = " ".join(f"same{i}" for i in range(80))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "de", "b", len(long)), (5, same, "en", "a", 1), (5, same, "en", "a", 1), (6, same, "en", None, 1), (None, same, "en", "a", 1), (7, "a b", "en", "a", 3), (7, "other text", "en", "a", 3), (8, "fr33 m0ney $$$ n o w", "en", "b", 3)]
    return spark.createDataFrame([(*r, 0, 0, 0, "x") for r in rows], DOCUMENTS + ", node long, key long, rank int, kept string").cache()


def _runs(labels):
    t = P.path("word_bpe_49k.json")
    return {
        "passages": lambda d: passages.repeated_passages(d), "without": lambda d: passages.without_repeats(d), "rules": lambda d: rules.quality(d, labels)[0], "rules_kept": lambda d: rules.kept_documents(d, labels), "ngram": lambda d: ngram.score(d),
        "packing": lambda d: packing.pack(d, t), "neardup": lambda d: neardup.near_duplicates(d), "bpe": lambda d: bpe.encode_documents(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), "sharding": lambda d: sharding.shard_digest(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, labels)), "toxicity_kept": lambda d: toxicity.kept_documents(d, labels),
    }


PER_ROW = {"rules", "ngram", "neardup", "bpe", "sharding", "toxicity"}


@pytest.mark.parametrize("name", ["passages", "without", "rules", "rules_kept", "ngram", "packing", "neardup", "bpe", "sharding", "toxicity", "toxicity_kept"])
def test_odd_and_empty_tables(spark, odd, labels, name):
    run = _runs(labels)[name]
    got = run(odd).collect()
    if name in PER_ROW:
        assert len(got) == odd.count()
    assert run(odd.limit(0)).collect() == []


def test_passages_whose_shingles_other_documents_hold_first(spark):
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(12):  # all shingles of the passage, but no run of 50 words
        at = rng.integers(1, 9) + np.arange(0, 48, 12)
        pieces = [passage[a : b + 4] for a, b in zip([0, *at], [*at, 50], strict=True)]
        rows.append((i, " ".join(w for x in reversed(pieces) for w in x)))
    rows += [(i, " ".join([*[f"{i}a{j}" for j in range(60)], *passage, *[f"{i}b{j}" for j in range(60)]])) for i in (20, 30)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 30").collect()
    assert [(r.source_id, r.first_word, r.n_words, r.source_first_word) for r in got] == [(20, 60, 50, 60)]


def test_passages_find_every_exact_repeat(documents):
    found = passages.repeated_passages(documents).collect()
    first, missed, total = {}, 0, 0
    spans = {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.first_word, r.first_word + r.n_words))
    for r in documents.orderBy("doc_id").collect():
        w = words(r.text)
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            if first.setdefault(g, r.doc_id) != r.doc_id:
                total += 1
                missed += not any(a <= i and i + 50 <= b for a, b in spans.get(r.doc_id, []))
    assert missed <= 0.01 * total
    assert all(r.source_id < r.doc_id and r.similarity >= 0.8 for r in found)


def test_nearest_against_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    got = {}
    for r in ann.nearest(rows, ann.F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    table = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    hits = total = 0
    for q in (v for v in table if v % 100 == 0):
        exact = sorted((math.sqrt(((table[q] - x) ** 2).sum()), v) for v, x in table.items() if v != q)[:10]
        mine = sorted(got[q])
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1))
        assert all(math.isclose(s, math.sqrt(((table[q] - table[v]) ** 2).sum()), rel_tol=1e-9) for _, v, s in mine)
        hits += len({v for _, v in exact} & {v for _, v, _ in mine})
        total += len(exact)
    assert hits >= 0.9 * total


def test_nearest_leaves_unusable_vectors_out(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(0, [5.0, 1.0]), (100, None), (200, [0.0, 0.0]), (300, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, ann.F.col("id") % 100 == 0, k=3).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 5), (0, 4), (0, 6)]
    assert ann.nearest(df.limit(0), ann.F.col("id") % 100 == 0).collect() == []


def test_base_statistics(documents):
    want = {}
    for r in documents.collect():
        w = WORDS.findall(r.text or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if WORDS.search(x)]
        want[r.doc_id] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(covered))
    got = rules.base_statistics(documents).collect()
    assert {r.doc_id: tuple(r[c] for c in rules.BASE) for r in got} == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)


def test_interpolation_beats_the_base_and_sums_counts(documents):
    got = ngram.score(documents).collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in got}
    assert all(r.held_out == held[r.doc_id] for r in got)
    counts = Counter()
    texts = {r.doc_id: words(r.text) + [""] for r in documents.collect()}
    for d, w in texts.items():
        if not held[d]:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        assert r.train_tokens == n and r.n_tokens == len(texts[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in texts[r.doc_id]), rel_tol=1e-9)
    assert sum(r.score - r.base_score for r in got if r.held_out) > 0


def test_interpolation_with_ranges_that_hold_no_words(documents, monkeypatch):
    """With many buckets some hold bigrams of a chunk and none of its words."""
    few = documents.where("doc_id < 40").select("doc_id", "text")
    want = {r.doc_id: r for r in ngram.score(few).collect()}
    monkeypatch.setattr(ngram, "BUCKET_BYTES", 512)
    got = ngram.score(few).collect()
    assert len(got) == len(want) == 40
    for r in got:
        assert r[:5] == want[r.doc_id][:5] and np.allclose(r[5:], want[r.doc_id][5:], rtol=1e-12)


def test_packing_covers_every_id_once(documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack(documents, P.path("word_bpe_49k.json")).collect()
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for r in documents.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def _components(texts, k=3, numerator=85, denominator=100):
    """Sizes of sets and smallest linked ids by comparing all pairs."""
    sets = {}
    for d, text in texts.items():
        w = words(text)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if denominator * both >= numerator * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates_against_brute_force(documents):
    got = neardup.near_duplicates(documents).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components({r.doc_id: r.text for r in documents.collect()})


@pytest.mark.parametrize("group, strangers, copies", [(256, 4, 257), (12, 1, 60), (20, 4, 90), (256, 4, 120)])
def test_near_duplicates_in_clusters_of_each_size(spark, monkeypatch, group, strangers, copies):
    """Groups that drift apart, lie within longer texts, or share a template that alone is just too little."""
    monkeypatch.setattr(neardup, "GROUP", group)
    monkeypatch.setattr(neardup, "STRANGERS", strangers)
    rng = np.random.default_rng(group + copies)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts, drift = {}, list(base)
    for i in range(copies):
        text = list(base)
        if i % 4 == 1:  # a chain
            drift[int(rng.integers(0, 120))] = f"c{i}"
            text = list(drift)
        elif i % 4 == 2:  # within the base, and alike among themselves
            text = base[: 84 + i % 7] + [f"t{i % 9}"]
        elif i % 4 == 3:  # a template with words of one's own
            text = base[:110] + [f"o{i}-{j}" for j in range(int(rng.integers(1, 14)))]
        texts[i] = " ".join(text)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # one bucket for all: what is tested is what becomes of a cluster
    monkeypatch.setattr(neardup, "signatures", _one_bucket(neardup.signatures))
    got = neardup.near_duplicates(rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(texts)


def test_near_duplicates_of_strangers_take_few_rounds(spark, monkeypatch):
    """Members that share edits with many others but are linked with few: a round with pivots is rid of the pivots alone."""
    for name, value in (("GROUP", 12), ("PAIRED", 4), ("STRANGERS", 1), ("STRANGE", 2)):
        monkeypatch.setattr(neardup, name, value)
    rng = np.random.default_rng(3)
    texts = {}
    for i in range(60):
        text = [f"w{x}" for x in range(100)]
        for at in rng.choice(20, 12, replace=False) if i % 6 else [0, i % 4]:
            text[5 * at] = f"a{at}"
        texts[i] = " ".join(text)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(neardup, "signatures", _one_bucket(neardup.signatures))
    compared, calls = neardup.compared, []
    monkeypatch.setattr(neardup, "compared", lambda *how: calls.append(1) or compared(*how))
    got = neardup.near_duplicates(rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _components(texts)
    assert len({r.component_id for r in got}) > 30
    assert len(calls) <= 6  # two a round


def _one_bucket(signatures):
    from pyspark.sql import functions as F

    return lambda *how: signatures(*how).withColumn("keys", F.array(F.lit(1).cast("long")))


def test_encoding_is_that_of_the_library(documents):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_documents(documents, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    for r in documents.collect():
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_shards_match_the_mixture(documents):
    got = sharding.shard_digest(documents).collect()
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(per[s]))
    mixture = Counter(r.source for r in got)
    for (source, shard), n in Counter((r.source, r.shard) for r in got).items():
        assert abs(n - mixture[source] * per[shard] / len(got)) <= 2


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.learn(docs, labels)).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.9 * len(got)


def test_quotes_are_linked(spark):
    rows = [(1, 0, "a", "Hello there, friend."), (1, 1, "b", "A second thought"), (1, 2, "c", "> hello there,  friend\nI agree"), (1, 3, "d", "> > hello there, friend\n> I agree\nSo do I"), (2, 0, None, None), (None, 0, "a", "x"), (1, 1, "b", "A second thought")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quotes.reply_ordered(quotes.linked_messages(df)).collect()}
    assert len(got) == 6
    assert got[1, 2].parent_turn == 0 and got[1, 3].parent_turn == 2 and got[1, 1].parent_turn is None
    assert got[1, 3].body == "So do I" and [got[1, t].position for t in (0, 2, 3)] == [0, 1, 2] and got[1, 1].position in (3, 4)
    assert quotes.reply_ordered(quotes.linked_messages(df.limit(0))).collect() == []


def test_trimmed_and_attributed_quotes_are_linked(spark):
    lines = ["alpha one", "beta two", "gamma three", "delta four"]
    rows = [(1, 0, "\n".join(lines)), (1, 1, "beta two\nelse"), (1, 2, "gamma three\nmore"), (1, 3, "> beta two\n> gamma three\nYes"), (1, 4, "> On Monday X wrote:\n> alpha one\n> beta two\n> gamma three\n> delta four\nNo"), (1, 5, "> never said\n> by anyone\nWhat")]
    df = spark.createDataFrame([(c, t, "a", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotes.linked_messages(df).collect()}
    # turns 1 and 2 hold one line each later than turn 0, which holds both
    assert [(got[t].n_linked, got[t].parent_turn) for t in (3, 4, 5)] == [(1, 0), (1, 0), (0, None)]


def test_reply_order_of_deep_and_branched_threads(spark):
    rng = np.random.default_rng(5)
    parents = {(1, t): t - 1 if t else None for t in range(150)}  # a chain of 150
    parents |= {(2, t): int(rng.integers(max(0, t - 6), t)) if t and rng.random() < 0.9 else None for t in range(200)}
    rows = [(c, t, p) for (c, t), p in parents.items()] + [(None, 0, None), (3, None, None)]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, parent_turn long")).collect()
    paths = {}
    for c, t in sorted(parents):
        p = parents[c, t]
        paths[c, t] = (*(() if p is None else paths[c, p]), t)
    want = {}
    for c in (1, 2):
        for i, path in enumerate(sorted(v for (x, _), v in paths.items() if x == c)):
            want[c, path[-1]] = (path[0], len(path) - 1, i)
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): (r.thread, r.depth, r.position) for r in got if r.conv_id and r.turn is not None} == want


def test_kept_rows_are_told_apart_by_themselves(spark, labels):
    clean, other = (" ".join(f"{p}{i}" for i in range(80)) for p in ("one", "two"))
    rows = [(None, clean), (1, clean), (1, "bad"), (2, other), (2, other), (None, "third " + other.replace("two", "three")), (3, clean + " and " + other), (3, None), (3, other[::-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bag = lambda x: Counter((r.doc_id, r.text) for r in x.collect())
    assert bag(rules.kept_documents(df, labels)) == Counter(r for r in rows if r[1] not in (None, "bad"))
    assert bag(neardup.kept_documents(df, k=5, numerator=80, denominator=100)) == Counter({*rows} - {(None, clean)})
    got = bag(passages.without_repeats(df))
    assert got[3, None] == got[3, other[::-1]] == got[None, rows[5][1]] == got[1, clean] == got[2, other] == 1


def test_pipeline_stages_keep_their_promises(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() and docs.select("doc_id").subtract(last.select("doc_id")).isEmpty()
