"""Results of the methods against brute force: models, searches, packing limits, decoding, and repeats of all kinds."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from facetflow.llm import ann, bpe, ngram, packing, passages, quotes, rules, sharding, toxicity

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


def _vocabulary(seed, n=3000):
    rng = np.random.default_rng(seed)
    return rng, [f"w{x}" for x in range(n)]


@pytest.mark.parametrize("length, edits, least", [(90, 1, 0.95), (150, 3, 0.95), (50, 1, 0.9)])
def test_near_repeats_are_found(spark, length, edits, least):
    """Passages with words replaced, in texts of their own; those of a similarity below 0.8 don't count."""
    rng, vocabulary = _vocabulary(length)
    rows, planted = [], 0
    for i in range(120):
        passage = rng.choice(vocabulary, length).tolist()
        for d in (0, 1):
            own = list(passage)
            if d:
                for at in (np.arange(edits) + 0.5) * length / edits:
                    own[int(at)] = f"edit{i}"
            rows.append((2 * i + d, " ".join(rng.choice(vocabulary, 80).tolist() + own + rng.choice(vocabulary, 80).tolist())))
        planted += 1
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.doc_id % 2 and r.source_id == r.doc_id - 1 and r.n_words >= 0.8 * length}
    assert len(found) >= least * planted
    assert all(r.similarity >= 0.8 and r.source_id < r.doc_id for r in got)


def test_repeats_behind_boilerplate_are_found(spark):
    """An earlier document holds every shingle of the passage, but never fifty words in a row; later ones repeat it."""
    rng, vocabulary = _vocabulary(7)
    rows = []
    for i in range(40):
        passage = rng.choice(vocabulary, 70).tolist()
        parts = [passage[a : a + 12] for a in range(0, 70, 6)]
        rows.append((3 * i, " ".join(x for j in rng.permutation(len(parts)) for x in parts[j])))
        for d in (1, 2):
            rows.append((3 * i + d, " ".join(rng.choice(vocabulary, 60).tolist() + passage + rng.choice(vocabulary, 60).tolist())))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.source_id == r.doc_id - 1 and r.first_word <= 60 and r.first_word + r.n_words >= 130}
    assert found >= {3 * i + 2 for i in range(40)}


def test_near_repeats_behind_several_holders_are_found(spark):
    """Earlier documents hold pieces of a passage or a common phrase of it; later ones repeat it with a word replaced."""
    rng, vocabulary = _vocabulary(11, 6000)
    rows, wanted = [], set()
    for i in range(40):
        passage = rng.choice(vocabulary, 70).tolist()
        parts = [passage[a : a + 12] for a in range(0, 70, 6)]
        for d in range(12):  # all of its shingles, in another order each
            rows.append((100 * i + d, " ".join(x for j in rng.permutation(len(parts)) for x in parts[j])))
        for d in (50, 51):
            own = [w if j != 35 or d == 50 else f"edit{i}" for j, w in enumerate(passage)]
            rows.append((100 * i + d, " ".join(rng.choice(vocabulary, 60).tolist() + own + rng.choice(vocabulary, 60).tolist())))
        wanted.add(100 * i + 51)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.source_id == r.doc_id - 1 and 60 <= r.first_word + 5 and r.n_words >= 60}
    assert len(found & wanted) >= 0.95 * len(wanted)
    assert all(r.similarity >= 0.8 and r.source_id < r.doc_id for r in got)


@pytest.mark.parametrize("phrases", [1, 2])
def test_near_repeats_around_common_phrases_are_found(spark, phrases):
    """More documents than are compared at once hold the phrases, each among words of its own (1) or both, apart (2)."""
    rng, vocabulary = _vocabulary(13, 30000)
    common = [[f"c{p}x{j}" for j in range(32)] for p in range(phrases)]
    rows = [(i, " ".join(x for p in rng.permutation(phrases) for x in [*rng.choice(vocabulary, 60), *common[p]])) for i in range(80)]
    for i in range(100, 140, 2):
        around = rng.choice(vocabulary, (phrases + 1, 15 if phrases == 1 else 6)).tolist()
        own = [x for b, c in zip(around, [*common, []], strict=True) for x in [*b, *c]]
        for d in (0, 1):
            edited = [w if not d or j != len(own) // 2 else f"edit{i}" for j, w in enumerate(own)]
            rows.append((i + d, " ".join([*rng.choice(vocabulary, 60), *edited, *rng.choice(vocabulary, 60)])))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got if r.source_id == r.doc_id - 1 and r.n_words >= len(own) - 5}
    assert len(found & set(range(101, 140, 2))) >= 19
    assert all(r.similarity >= 0.8 and r.source_id < r.doc_id for r in got)


def test_holders_of_a_passage_near_a_common_line_are_not_compared_pair_by_pair(spark, monkeypatch):
    """The line is too far from the passage for both to be one; each pair of documents shares both."""
    rng, vocabulary = _vocabulary(17, 40000)
    line, passage = [f"l{j}" for j in range(13)], [f"p{j}" for j in range(68)]
    rows = [(i, " ".join([*rng.choice(vocabulary, 20), *line, *rng.choice(vocabulary, 60), *passage, *rng.choice(vocabulary, 40)])) for i in range(150)]
    pairs, later = [], passages.later_holders

    def counting(*args):
        found, tried = later(*args)
        pairs.append(tried.count())
        return found, tried

    monkeypatch.setattr(passages, "later_holders", counting)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.first_word == 93 and r.n_words == 68} == set(range(1, 150))
    assert pairs[0] <= 12 * len(rows)


def test_near_repeats_without_frequent_shingles_among_others(spark):
    """More than four documents hold all shingles of a passage in other orders; no shingle is frequent."""
    rng, vocabulary = _vocabulary(23, 6000)
    passage = rng.choice(vocabulary, 70).tolist()
    parts = [passage[a : a + 12] for a in range(0, 70, 6)]
    rows = [(d, " ".join(x for j in rng.permutation(len(parts)) for x in parts[j])) for d in range(12)]
    rows += [(d, " ".join([*rng.choice(vocabulary, 60), *passage, *rng.choice(vocabulary, 60)])) for d in (50, 51)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(r.doc_id == 51 and r.source_id == 50 and r.n_words >= 70 for r in got)


def test_stretches_against_brute_force():
    rng = np.random.default_rng(19)
    for _ in range(200):
        n, length = int(rng.integers(1, 60)), int(rng.integers(1, 12))
        at = np.unique(rng.integers(0, n, 5))
        marked = np.flatnonzero(rng.random(n) < rng.random())
        inside, low, high = passages._around(at, *passages._passing(n, at, marked, n, length, 0.8))
        yes = np.isin(np.arange(n), marked)
        good = [(a, b) for a in marked for b in marked if b - a + 1 >= length and yes[a : b + 1].sum() >= 0.8 * (b - a + 1) - 1e-9]
        for x, y, a, b in zip(at, inside, low, high, strict=True):
            own = [g for g in good if g[0] <= x <= g[1]]
            assert y == bool(own)
            assert not own or (a, b) == (min(g[0] for g in own), max(g[1] for g in own))


def test_batches_are_worked_on_a_slice_at_a_time():
    import pyarrow as pa

    rows = list(range(3 * passages.SLICE + 7))
    parts = [b.column(0).to_pylist() for b in passages._slices(iter([pa.RecordBatch.from_pydict({"x": rows}), pa.RecordBatch.from_pydict({"x": rows[:0]})]))]
    assert max(map(len, parts)) <= passages.SLICE and [x for p in parts for x in p] == rows


def test_long_repeats_are_whole_whatever_is_moved_at_first(spark):
    rng, vocabulary = _vocabulary(9)
    passage = rng.choice(vocabulary, 3000).tolist()
    edited = [w if i % 61 else "edit" for i, w in enumerate(passage)]
    rows = spark.createDataFrame([(1, " ".join(passage)), (2, "x " + " ".join(edited))], "doc_id long, text string")
    spans = [{(r.first_word, r.n_words) for r in passages.repeated_passages(rows, margin=m).collect()} for m in (0, 128, 5000)]
    assert spans[0] == spans[1] == spans[2]


def test_interpolated_scores_against_dictionaries(spark, documents):
    texts = {r.doc_id: words(r.text) for r in documents.collect()}
    kind = {d: zlib.crc32(str(d).encode()) % 7 for d in texts}
    padded = {d: ["<", "<", *w, ""] for d, w in texts.items()}

    def counted(keep):
        found = [Counter(), Counter(), Counter()]
        for d, w in padded.items():
            if keep(kind[d]):
                for i in range(2, len(w)):
                    for n in range(3):
                        found[n][tuple(w[i - n : i + 1])] += 1
        return found

    def estimates(w, counts, docs):
        one, two, three = counts
        n = sum(one.values())
        for i in range(2, len(w)):
            a, b, c = w[i - 2 : i + 1]
            pair = docs if (a, b) == ("<", "<") else two[a, b]
            single = docs if b == "<" else one[b,]
            power = lambda x: int(math.log2(x))
            bucket = power(pair) if pair else ngram.POWERS + power(single) if single else 2 * ngram.POWERS
            yield bucket, (three[a, b, c] / pair if pair else 0, two[b, c] / single if single else 0, one[c,] / n)

    training, fold = counted(lambda k: k != 2), counted(lambda k: k == 3)
    v = len(training[0])
    rest = [Counter({g: n - f[g] for g, n in t.items()}) for t, f in zip(training, fold, strict=True)]
    docs = sum(k != 2 for k in kind.values())
    cells = Counter()
    sums = {}
    for d, w in padded.items():
        if kind[d] == 3:
            for bucket, found in estimates(w, rest, docs - sum(k == 3 for k in kind.values())):
                ratio = np.array(found) * (v + 1)
                key = (bucket, *[0 if r <= 0 else 1 + min(max(math.floor(math.log2(r)) - ngram.LOWEST, 0), ngram.OCTAVES - 1) for r in ratio])
                cells[key] += 1
                sums[key] = sums.get(key, 0) + ratio
    keys = sorted(cells)
    times = np.array([cells[k] for k in keys], float)
    weights = ngram.learn_weights(np.array([k[0] for k in keys]), times, np.array([sums[k] for k in keys]).T / times)
    assert np.allclose(weights.sum(1), 1)
    got = {r.doc_id: r.score for r in ngram.score(documents).collect()}
    for d, w in padded.items():
        want = sum(math.log10(weights[b, :3] @ np.array(f) + weights[b, 3] / (v + 1)) for b, f in estimates(w, training, docs))
        assert math.isclose(got[d], want, rel_tol=1e-9)


@pytest.mark.parametrize("word", ["5tup1d", "s.t*p", "aab00", "l33t!", "xx", "@bb-a"])
@pytest.mark.parametrize("spaced", [False, True])
def test_readings_against_all_paths(word, spaced):
    text = ["stupid", "stop", "ab", "boo", "leet", "a", "xx", "sip", "about"]
    grams = Counter(f"^^{w}^"[i : i + 3] for w in text for i in range(len(w) + 1))
    model = toxicity.CharacterModel(toxicity.packed(grams))
    runs = [(c, len(list(g))) for c, g in itertools.groupby(word)]

    def score(out):
        total = 0.0
        for w in out:
            w = "^^" + w + "^"
            total += sum(model.log(*w[i : i + 3]) for i in range(len(w) - 2))
        return total

    best = -math.inf
    for path in itertools.product(*[model.readings(c, n) for c, n in runs]):
        for breaks in itertools.product([False, True], repeat=len(path)) if spaced else [(False,) * len(path)]:
            out, cost, fits = [""], 0.0, True
            for (x, c), cut in zip(path, breaks, strict=True):
                if cut:
                    fits &= out[-1] != ""
                    out.append("")
                    cost += toxicity.COST["break"]
                out[-1] += x
                cost += c
            if fits:
                best = max(best, cost + score(out))
    got = model.restore(word, spaced).split(" ")
    costs = [c for path in itertools.product(*[model.readings(c, n) for c, n in runs]) if "".join(x for x, _ in path) == "".join(got) for c in [sum(c for _, c in path)]]
    assert math.isclose(max(costs) + score(got) + toxicity.COST["break"] * (len(got) - 1), best, rel_tol=1e-9)


def test_words_and_runs_of_any_length_are_read():
    model = toxicity.CharacterModel(toxicity.packed(Counter(f"^^{w}^"[i : i + 3] for w in ["stupid", "and", "so"] * 9 for i in range(len(w) + 1))))
    assert model.restore("st" + "u" * 5000 + "p1d") == "stupid"
    assert model.restore("stupid" * 300, True).split(" ").count("stupid") == 300
    assert toxicity.restored_text("stuupid stüpid éé", model).split(" ")[0] == "stupid"


def test_rare_letters_have_a_model(spark):
    """Trigrams of all letters against brute force, with more letters than any one alphabet has; ideographs by ranges."""
    many = "".join(chr(x) for block in (0x61, 0xE0, 0x430, 0x3B1, 0x561, 0x5D0, 0x10D0) for x in range(block, block + 22))
    own = [x for x in many if x.isalpha() and x.lower() == x]
    texts = [" ".join("".join(own[(i * j + k) % len(own)] for k in range(5)) for j in range(1, 40)) for i in range(1, 20)] + ["стоп стоп ст0п", "漢字漢字", None, ""]
    documents = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    fold = lambda x: x if ord(x) < toxicity.SYLLABLES else chr(ord(x) | 255)
    want = Counter()
    for w in " ".join(x or "" for x in texts).split():
        if w.isalpha():
            w = "^^" + "".join(fold(x) for x in w) + "^"
            want.update(w[i : i + 3] for i in range(len(w) - 2))
    assert len(set(own)) > 110
    got = toxicity.character_counts(documents, 1 << 20)
    assert all((a == b).all() for a, b in zip(got, toxicity.packed(want), strict=True))
    with pytest.raises(ValueError):
        toxicity.character_counts(documents, 10)
    model = toxicity.CharacterModel(got)
    assert model.log("о", "п", "^") > model.log("о", "п", "ა") and model.restore("漢漢漢漢") in ("漢", "漢漢")


def test_verdicts_follow_the_list(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    found, learned = rules.quality(documents, labels)
    got = {r.doc_id: r for r in found.collect()}
    assert learned.rules and all(p >= 0.95 for p in learned.precision)
    for r in got.values():
        of = {k: (getattr(r, v.split(" / ")[0]) / getattr(r, v.split(" / ")[1]) if getattr(r, v.split(" / ")[1]) else 0.0) for k, v in rules.FEATURES.items()}
        hit = next((i + 1 for i, rule in enumerate(learned.rules) if all(of[f] > t if sign == ">" else of[f] <= t for f, sign, t in rule)), None)
        assert r.rule == (0 if r.base_failed else hit) and r.kept == (r.rule is None)
    known = {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    judged = [(known[d], r.kept) for d, r in got.items() if d in known and not r.base_failed]
    assert sum(q == k for q, k in judged) >= 0.9 * len(judged)


@pytest.mark.parametrize("segments, loss", [(4, 256), (128, 100), (2, 90)])
def test_packing_keeps_all_limits(spark, documents, segments, loss):
    from pyspark.sql import functions as F

    df = documents.withColumn("prompt", F.pmod(F.xxhash64("doc_id"), F.lit(60)))
    got = packing.pack(df, P.path("word_bpe_49k.json"), length=256, max_segments=segments, max_loss_tokens=loss, loss_column="prompt", window=64).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    padded = 0
    for own in sequences.values():
        assert len(own) <= segments and sum(r.length for r in own) <= 256 and sum(r.loss_tokens for r in own) <= loss
        used = sum(r.length for r in own)
        padded += used != 256 and used & (used - 1) != 0
    assert loss == 256 or any(sum(r.loss_tokens for r in own) == loss for own in sequences.values())
    pieces = {}
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for (_, n), own in pieces.items():
        assert sum(x for _, x in own) % n == 0


def test_full_sequences_or_powers_of_two(documents):
    got = packing.pack(documents, P.path("word_bpe_49k.json")).collect()
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in used.values())


def test_nearest_beyond_the_sample(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)) + rng.normal(size=(12, 32))[rng.integers(0, 12, 3000)] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, (x[i] + 0.01).tolist()) for i in range(0, 3000, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = {}
    for r in ann.nearest(df, F.col("id") % 100 == 0, sample=256, block_rows=500).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = total = 0
    for q in range(0, 3000, 100):
        d = np.minimum(np.linalg.norm(x - x[q], axis=1), np.linalg.norm(x - x[q] - 0.01, axis=1))
        for i in range(0, 3000, 50):
            d[i] = min(d[i], np.linalg.norm(x[i] + 0.01 - x[q]), np.linalg.norm(x[i] - x[q]))
        d[q] = np.inf
        assert len(got[q]) == len(set(got[q])) == 10
        hits += len(set(np.argsort(d)[:10].tolist()) & set(got[q]))
        total += 10
    assert hits >= 0.9 * total


def test_ids_are_kept_and_decoded(documents):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(documents, ranks, P.PATTERN, keep_ids=True)
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode_ids(encoded.select("doc_id", "ids"), ranks, P.PATTERN).collect()}
    assert got == {r.doc_id: (r.text or "").encode() for r in documents.collect()}


def test_null_ids_are_spread_by_their_texts(spark):
    rows = spark.createDataFrame([(None, "a", f"text {i}") for i in range(400)] + [(i, "b", "t") for i in range(200)], "doc_id long, source string, text string")
    got = sharding.shard_digest(rows).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    mixed = Counter((r.shard, r.source) for r in got)
    assert all(49 <= mixed[s, "a"] <= 51 for s in range(8))


def test_long_quotes_and_chats(spark):
    long = "\n".join(f"line {i} of a long message" for i in range(400))
    rows = [(1, 1, "user", long), (1, 2, None, "> " + long.replace("\n", "\n> ") + "\nmy answer"), (2, 1, "user", None)]
    got = {(r.conv_id, r.turn): r for r in quotes.formatted(quotes.reply_ordered(quotes.linked_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[1, 2].parent_turn == 1 and got[1, 2].chat == "<|unknown|>\nmy answer\n" and got[2, 1].chat == "<|user|>\n\n"


def test_odd_quotes_and_vectors(spark):
    from pyspark.sql import functions as F

    rows = [(None, 1, None, "x"), (1, None, "u", None), (1, 1, "u", ">>> "), (1, 1, "u", ">>> "), (1, 2, "u", "a" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"level": F.lit(1), "hash": F.lit("h"), "parent_turn": F.lit(0), "body": F.lit("b")})
    for table in (df, df.limit(0)):
        got = quotes.formatted(quotes.reply_ordered(quotes.linked_messages(table)))
        assert got.count() == table.count()
    x = spark.createDataFrame([(1, [1.0, 2.0], 0), (1, [1.0, 2.1], 0), (None, [1.0, 2.0], 0), (2, None, 0), (100, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, list int").withColumns({"id": F.lit(9), "bound": F.lit(1), "score": F.lit(0.0)})
    got = ann.nearest(x, F.col("id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(100, 1, 1)]
    assert ann.nearest(x.limit(0), F.col("id") % 100 == 0).collect() == []


def test_texts_are_encoded_by_slices(monkeypatch):
    """Ids don't depend on how many texts are split at a time."""
    import numpy as np
    import public_tokenizers
    import pyarrow as pa

    from facetflow.llm import wordbpe

    texts = pa.array(["", None, "One text, and more of it.", "x" * 500 + " tail", " \n\t ", "é’s don't 12 <s>"] * 5)

    def ids(size):
        monkeypatch.setattr(wordbpe, "SLICE", size)
        found = []
        for got, bounds in wordbpe.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(texts.slice(1)):
            found += [got[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return found

    whole = ids(1 << 30)
    assert len(whole) == len(texts) - 1
    assert ids(1) == ids(40) == whole
    assert not np.any([whole[0], whole[3]])


def test_chunks_are_scored_in_slices(spark, monkeypatch):
    """What is derived of a chunk's tokens never takes more room than a slice's, and scores don't depend on slices."""
    import pyarrow as pa

    from facetflow.llm import ngram
    from facetflow.llm._chunks import packed, planes, texts_of

    rows = spark.createDataFrame([(i, 0, "a b c " * (i % 5) + "d", 0) for i in range(40)], "doc_id long, rank long, text string, kind int")
    chunk = packed(rows.coalesce(1)).toArrow()
    grams, begin = ngram._grams(texts_of(chunk.column("sizes")[0].values.to_numpy(), chunk.column("texts")[0].as_py()))
    sizes = [len(np.unique(x)) for x in grams]
    answers = pa.table({"bucket": [0], **{x: [planes(np.arange(n, dtype=np.uint32))] for x, n in zip(ngram.ORDERS, sizes, strict=True)}})
    monkeypatch.setattr(ngram, "SLICE", 20)
    parts = list(ngram._looked_up(chunk, answers, ("",)))
    assert len(parts) > 10 and all(b[-1] <= 20 for _, b in parts)
    for i, x in enumerate(grams):
        assert np.array_equal(np.concatenate([found[0][i] for found, _ in parts]), np.unique(x, return_inverse=True)[1])
    assert np.array_equal(np.concatenate([np.diff(b) for _, b in parts]), np.diff(begin))
