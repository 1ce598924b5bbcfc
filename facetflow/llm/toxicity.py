"""Toxicity of texts after noisy-channel deobfuscation.

Restoring. A word that may be disguised (digits or signs among letters, a letter twice or more in a row, separators
within, or three or more single characters in a row as words) is read as a lattice: each sign stands for the letters
that it resembles, a separator may be nothing, a run of one letter may be shorter, and between spaced-out characters a
word may end. A Viterbi search takes the path of the best sum of channel cost and log probability under a character
trigram model with word boundaries; its states are the last two letters, none is left out, and words and runs of any
length are read in one pass. Other words have one path and stand for themselves.
Scoring. Features are restored words and their first 4, 5 and 6 characters; those that labelled toxic documents hold
far more often than others get weights by logistic regression on their presence, the score is the probability.

The character model counts the words of all documents, rare letters like others. Ideographs and syllables (from U+2E80 on)
count by ranges of 256 code points: no sign stands for one of them, and readings that differ in them differ in the length
of a run only. So the model grows with the trigrams of alphabets, not with the corpus; it is two sorted arrays, gathered
up to ``most`` trigrams (more than alphabets have in use), and raises beyond. The features and their weights come from at most ``sample`` labelled
documents (in order of a hash of doc_id). Scoring is a pass over all whole texts, nothing is shuffled.
Null and empty texts get the score of a text without features. Rows that repeat are scored each; null ids are scored
but never learned from; an empty table gives no rows; without labels of both classes each score is that of the prior.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm._shared import settle
from facetflow.llm._words import trimmed

#: Letters that a character may stand for, besides itself.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = set(".-_*~'`^,:;/\\=")
VOWELS = "aeiou"
#: Signs taken off the ends of a word, and longer runs of signs at its end.
EDGES = ".,;:!?%&#*|\"'()[]{}<>«»…“”‘’=+-_~"
TAIL = re.compile(r"[$@]{3,}$")
COST = {"look": -0.7, "drop": -0.2, "guess": -2.5, "shorten": -0.3, "kept_run": -2.0, "break": -1.0, "sign": -6.0}
ORDINARY = "^\\pL+$"
PREFIXES = (4, 5, 6)
#: Stands for both ends of a word, and for letters that no word holds.
BOUND, OTHER = "^", "\ufffd"
#: From here on letters are ideographs and syllables, of which RANGE count as one; bits of a code point in a trigram.
SYLLABLES, RANGE, BITS = 0x2E80, 256, 21
#: Words and log probabilities that a task remembers.
KNOWN = 60_000


def _doubled(word: str) -> bool:
    return any(a == b for a, b in zip(word, word[1:], strict=False))


Grams = tuple[np.ndarray, np.ndarray]


def packed(counts: dict[str, int]) -> Grams:
    """(trigrams as numbers, ascending; their counts)."""
    of = {(ord(g[0]) << 2 * BITS) | (ord(g[1]) << BITS) | ord(g[2]): n for g, n in counts.items()}
    return np.array(sorted(of), np.int64), np.array([of[k] for k in sorted(of)], np.int64)


def _found(keys: np.ndarray, n: np.ndarray, key: int) -> int:
    i = int(keys.searchsorted(key))
    return int(n[i]) if i < len(keys) and keys[i] == key else 0


@dataclass
class CharacterModel:
    """Trigram log probabilities with additive smoothing; letters that no trigram holds count as one unseen letter."""

    grams: Grams
    known: dict[str, str] = field(default_factory=dict)
    logs: dict[tuple[str, str, str], float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        keys, n = self.grams
        begins = np.flatnonzero(np.diff(keys >> BITS, prepend=-1))
        self.contexts = (keys >> BITS)[begins], np.add.reduceat(n, begins) if len(begins) else n
        low = (1 << BITS) - 1
        self.letters = {ord(BOUND), *np.unique(np.concatenate([keys >> 2 * BITS, (keys >> BITS) & low, keys & low])).tolist()}
        self.size = len(np.unique(keys & low)) + 1

    def _letter(self, x: str) -> int:
        point = ord(x)
        if point >= SYLLABLES:
            point |= RANGE - 1
        return point if point in self.letters else ord(OTHER)

    def log(self, a: str, b: str, c: str) -> float:
        found = self.logs.get((a, b, c))
        if found is None:
            two = (self._letter(a) << BITS) | self._letter(b)
            found = math.log((_found(*self.grams, (two << BITS) | self._letter(c)) + 0.1) / (_found(*self.contexts, two) + 0.1 * self.size))
            if len(self.logs) < KNOWN:
                self.logs[a, b, c] = found
        return found

    def restore(self, word: str, spaced: bool = False) -> str:
        """The best reading of a disguised word; spaced: its characters stood apart, so there may be several words."""
        found = self.known.get(("+" if spaced else "-") + word)
        if found is None:
            found = self._search(word, spaced)
            if len(self.known) < KNOWN and len(word) <= 64:
                self.known[("+" if spaced else "-") + word] = found
        return found

    @staticmethod
    def readings(c: str, n: int) -> list[tuple[str, float]]:
        """What a run of n times c may stand for, with its channel cost."""
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options += [(c * k, COST["shorten"] * (k < n) + COST["kept_run"] * (k == n > 2)) for k in sorted({1, min(2, n), n})]
        for x in LOOKS.get(c, ""):
            options += [(x * k, COST["look"] * n) for k in sorted({min(n, 2), 1})]
        if c in SEPARATORS or not (c.isalnum() or c in LOOKS):
            options.append(("", COST["drop"]))
            if c == "*":
                options += [(x, COST["guess"]) for x in VOWELS]
        if not options or c.isdigit():
            options.append((c * n, COST["sign"] * n))
        return options

    def _search(self, word: str, spaced: bool) -> str:
        """Viterbi over states of the last two letters; each step remembers what it came from, and what it wrote."""
        steps: list[tuple[int, str]] = [(-1, "")]
        states: dict[tuple[str, str], tuple[float, int]] = {(BOUND, BOUND): (0.0, 0)}
        log = self.log
        for c, run in groupby(word):
            options = self.readings(c, len(list(run)))
            new: dict[tuple[str, str], tuple[float, int, str]] = {}
            for (a, b), (score, step) in states.items():
                starts = [(a, b, score, "")]
                if spaced and b != BOUND:
                    starts.append((BOUND, BOUND, score + log(a, b, BOUND) + COST["break"], " "))
                for a1, b1, s1, gap in starts:
                    for out, cost in options:
                        p, q, s = a1, b1, s1 + cost
                        for x in out:
                            s += log(p, q, x)
                            p, q = q, x
                        best = new.get((p, q))
                        if best is None or best[0] < s:
                            new[p, q] = (s, step, gap + out)
            states = {}
            for key, (s, step, out) in new.items():
                states[key] = (s, len(steps))
                steps.append((step, out))
        _, at = max((s + log(a, b, BOUND), -step) for (a, b), (s, step) in states.items())
        at, parts = -at, []
        while at > 0:
            at, out = steps[at]
            parts.append(out)
        return "".join(reversed(parts))


class Reader:
    """Restored words of Arrow arrays of texts."""

    def __init__(self, model: CharacterModel | None):
        self.model = model

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, list[tuple[int, str]]]:
        """(text of each word, its code, the restored words by code, words of spaced-out runs with their texts)."""
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        at = np.asarray(split.offsets) - split.offsets[0].as_py()
        owner = np.repeat(np.arange(len(texts)), np.diff(at))
        code, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        trimmed = pc.utf8_trim(distinct, EDGES)
        plain = np.asarray(pc.match_substring_regex(trimmed, ORDINARY))
        letters = np.asarray(pc.fill_null(pc.utf8_length(trimmed), 0))
        runs = doubled(trimmed)
        restored = trimmed
        if self.model is not None:
            odd = np.flatnonzero((~plain | runs) & (letters > 0))
            mended = []
            for raw in trimmed.take(pa.array(odd)).to_pylist():
                raw = TAIL.sub("", raw)
                count = sum(x.isalpha() for x in raw)
                mended.append(self.model.restore(raw) if count and len(raw) >= 2 and (not raw.isalpha() or _doubled(raw)) else raw)
            if len(odd):
                mask = np.zeros(len(distinct), bool)
                mask[odd] = True
                restored = pc.replace_with_mask(trimmed, pa.array(mask), pa.array(mended, trimmed.type))
        spaced: list[tuple[int, str]] = []
        single = (np.asarray(pc.utf8_length(distinct)) == 1)[code] if len(code) else np.zeros(0, bool)
        if self.model is not None and single.any():
            same = np.append(False, single[1:] & single[:-1] & (owner[1:] == owner[:-1]))
            begins = np.flatnonzero(single & ~same)
            ends = np.append(begins[1:], len(single))
            lengths = np.array([int(np.argmin(same[b + 1 : e])) if not same[b + 1 : e].all() else e - b - 1 for b, e in zip(begins, ends, strict=True)]) + 1 if len(begins) else np.zeros(0, int)
            for b, n in zip(begins[lengths >= 3], lengths[lengths >= 3], strict=True):
                run = "".join(distinct.take(pa.array(code[b : b + n])).to_pylist())
                spaced += [(int(owner[b]), w) for w in self.model.restore(run, True).split(" ")]
        return owner, code, restored, spaced


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words in a row, the word of each)."""
    _, offs, data = words.buffers()
    if not len(words) or data is None:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at = np.frombuffer(offs, np.int64, len(words) + 1, words.offset * 8)
    raw = data[int(at[0]) : int(at[-1])].to_pybytes()
    points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
    begins = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return points, np.searchsorted(at - at[0], begins, "right") - 1


def doubled(words: pa.Array) -> np.ndarray:
    """Which words hold a character twice in a row."""
    points, own = code_points(words)
    found = np.zeros(len(words), bool)
    found[own[1:][(points[1:] == points[:-1]) & (own[1:] == own[:-1])]] = True
    return found


def restored_text(text: str | None, model: CharacterModel) -> str:
    """The words of a text as they are scored, those of spaced-out runs last."""
    _, code, restored, spaced = Reader(model).words(pa.array([text], pa.large_string()))
    own = restored.to_pylist()
    return " ".join([own[c] for c in code if own[c]] + [w for _, w in spaced])


def _features(words: pa.Array) -> list[pa.Array]:
    """Features of each word, column by column: the word and its beginnings, null where it is no longer than those."""
    long = pc.utf8_length(words)
    out = [pc.if_else(pc.greater(long, 1), words, None)]
    for n in PREFIXES:
        begin = pc.binary_join_element_wise(pc.utf8_slice_codeunits(words, 0, n), pa.scalar("-", words.type), pa.scalar("", words.type))
        out.append(pc.if_else(pc.greater(long, n), begin, pa.scalar(None, words.type)))
    return out


@dataclass
class ToxicityModel:
    characters: CharacterModel
    features: list[str]
    weights: np.ndarray
    bias: float

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (text, feature) without repeats."""
        owner, code, restored, spaced = Reader(self.characters).words(texts)
        vocabulary = pa.array(self.features, pa.large_string())
        pairs = []
        for column in _features(restored):
            found = np.asarray(pc.fill_null(pc.index_in(column, value_set=vocabulary), -1))
            hit = found[code] if len(code) else np.zeros(0, np.int64)
            pairs.append(owner[hit >= 0] * len(self.features) + hit[hit >= 0])
        if spaced:
            who = np.array([o for o, _ in spaced])
            for column in _features(pa.array([w for _, w in spaced], pa.large_string())):
                found = np.asarray(pc.fill_null(pc.index_in(column, value_set=vocabulary), -1))
                pairs.append(who[found >= 0] * len(self.features) + found[found >= 0])
        both = np.unique(np.concatenate(pairs)).astype(np.int64)
        return both // max(1, len(self.features)), both % max(1, len(self.features))

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        if self.features:
            text, feature = self.present(texts)
            np.add.at(z, text, self.weights[feature])
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: Rows of a batch that are read at a time.
ROWS = 2048


def _rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, ROWS):
        yield batch.slice(i, ROWS)


def held_out(column: str = "doc_id") -> Column:
    """Whether the row is never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def character_counts(documents: DataFrame, most: int) -> Grams:
    """Character trigrams of the words of letters of all documents, as of packed()."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _rows(whole):
                _, code, words, _ = Reader(None).words(batch.column(0))
                plain = np.asarray(pc.match_substring_regex(words, ORDINARY))
                times = np.bincount(code, minlength=len(words))[plain]
                bound = pa.scalar(BOUND, words.type)
                points, own = code_points(pc.binary_join_element_wise(bound, bound, words.filter(pa.array(plain)), bound, pa.scalar("", words.type)))
                points = np.where(points < SYLLABLES, points, points | (RANGE - 1))
                three = np.stack([points[:-2], points[1:-1], points[2:]], 1)[own[2:] == own[:-2]].astype(np.int64)
                gram, place = np.unique((three[:, 0] << 2 * BITS) | (three[:, 1] << BITS) | three[:, 2], return_inverse=True)
                n = np.bincount(place, times[own[:-2][own[2:] == own[:-2]]], len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

    found = settle(documents.select(F.col("text").cast("string")).mapInArrow(trimmed(grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    size = found.count()
    if size > most:
        raise ValueError(f"the words of letters hold {size} trigrams, more than {most}: give a larger number where tasks have room for 16 bytes of each")
    rows = found.toArrow()  # at most ``most``
    keys, n = rows.column("gram").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def learn(
    documents: DataFrame, labels: DataFrame, sample: int = 20_000, min_toxic: int = 3, min_lift: float = 6.0,
    steps: int = 300, penalty: float = 0.02, most: int = 1 << 23,
) -> ToxicityModel:
    """A model from at most ``sample`` labelled documents, those of held_out() left out; letters come from all documents."""
    characters = CharacterModel(character_counts(documents, most))
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = settle(rows.select("text", "toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of each class by feature; the feature "" counts all."""
        own = CharacterModel(characters.grams)
        for whole in batches:
            for batch in _rows(whole):
                toxic = np.asarray(batch.column(1)).astype(np.int64)
                owner, code, words, spaced = Reader(own).words(batch.column(0))
                parts = [(owner, c.take(pa.array(code))) for c in _features(words)]
                if spaced:
                    who = np.array([o for o, _ in spaced])
                    parts += [(who, c) for c in _features(pa.array([w for _, w in spaced], pa.large_string()))]
                coded = pa.concat_arrays([c for _, c in parts]).dictionary_encode()
                feature, there = np.asarray(coded.indices.fill_null(0)).astype(np.int64), np.asarray(coded.indices.is_valid())
                pair = np.unique((np.concatenate([o for o, _ in parts]) * np.int64(len(coded.dictionary) + 1) + feature)[there])
                cell, n = np.unique((pair % (len(coded.dictionary) + 1)) * 2 + toxic[pair // (len(coded.dictionary) + 1)], return_counts=True)
                names = pa.concat_arrays([coded.dictionary.take(pa.array(cell // 2)), pa.array(["", ""], pa.large_string())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.append(cell % 2, [0, 1]), pa.int32()), pa.array(np.append(n, np.bincount(toxic, minlength=2)), pa.int64())], names=["feature", "toxic", "n"])

    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    counts = settle(rows.mapInArrow(trimmed(count), "feature string, toxic int, n long").groupBy("feature").agg(of(1).alias("t"), of(0).alias("c")))
    size = counts.where("feature = ''").first()
    n_toxic, n_clean = (size["t"], size["c"]) if size else (0, 0)
    prior = math.log((n_toxic + 0.5) / (n_clean + 0.5)) if n_toxic + n_clean else -1.0
    if not n_toxic or not n_clean:
        return ToxicityModel(characters, [], np.zeros(0), min(prior, -0.1) if not n_toxic else max(min(prior, 3.0), -3.0))
    lift = ((F.col("t") - 0.5 * F.sqrt("t")) / n_toxic) / ((F.col("c") + 0.5) / n_clean)
    chosen_features = [r["feature"] for r in counts.where(F.col("feature") != "").where(f"t >= {min_toxic}").where(lift >= min_lift).orderBy("feature").collect()]
    model = ToxicityModel(characters, chosen_features, np.zeros(len(chosen_features)), prior)
    if chosen_features:
        _fit(model, rows, steps, penalty)
    return model


def _fit(model: ToxicityModel, rows: DataFrame, steps: int, penalty: float) -> None:
    """Logistic regression on the features of the sample's texts, which are few a text."""
    bare = ToxicityModel(CharacterModel(model.characters.grams), model.features, np.zeros(0), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _rows(whole):
                text, feature = bare.present(batch.column(0))
                at = np.searchsorted(text, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))], names=["toxic", "features"])

    same = rows.mapInArrow(trimmed(run), "toxic int, features array<int>").groupBy("toxic", "features").agg(F.count(F.lit(1)).alias("n")).orderBy("toxic", "features").collect()
    label, times = np.array([r["toxic"] for r in same], float), np.array([r["n"] for r in same], float)
    sizes = np.array([len(r["features"]) for r in same])
    column, row = np.array([f for r in same for f in r["features"]], np.int64), np.repeat(np.arange(len(same)), sizes)
    w, b, total = np.zeros(len(model.features)), model.bias, times.sum()
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):  # Adam
        z = b + np.bincount(row, w[column], len(same))
        gap = times * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - label)
        slope = np.append(np.bincount(column, gap[row], len(w)) + penalty * w, gap.sum()) / total
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(CharacterModel(model.characters.grams), model.features, model.weights, model.bias)
        for whole in batches:
            for batch in _rows(whole):
                got = own.scores(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def kept_documents(documents: DataFrame, labels: DataFrame, **how: int | float) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    model = learn(documents, labels, **how)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(CharacterModel(model.characters.grams), model.features, model.weights, model.bias)
        for whole in batches:
            for batch in _rows(whole):
                yield batch.filter(pa.array(own.scores(batch.column(text)) < 0.5))

    return documents.mapInArrow(trimmed(run), documents.schema)
