"""Quality rules: base statistics of texts and a learned decision list, all in DataFrame operations.

Base statistics come from the whole text; words are the runs of characters other than space and 0x09-0x0D. The list is
learned by sequential covering: from labelled rows that pass the base rule, a conjunction of thresholds is grown by
FOIL gain on two thirds of the rows, pruned on the other third, kept if it is precise enough there, and the rows that
it covers are set aside before the next one. Only counts by (feature, bin) reach the driver, whose number is bounded by
the parameters, not by the data. The result is one ordered conditional expression; a document is rejected by the
first rule that holds, and a list without rules rejects nothing beyond the base rule.

Null and empty texts have no words and fail the base rule. Rows are independent of each other, so repeated rows get the
same result each, and other columns of the input are ignored. An empty table gives no rows; without labels of both
classes the list is empty. Labels that are null are left out; a document with several labels counts once for each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetflow.llm._shared import settle

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Learned conditions are on these, each a number from the base and the further counts.
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "repeated_words": "n_repeat_words / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "mean_word": "word_chars / n_words",
    "upper_share": "n_upper / word_chars",
    "marks_per_word": "n_marks / n_words",
    "distinct_words": "n_distinct_words / n_words",
    "digit_share": "n_digits / word_chars",
    "words_per_line": "n_words / n_lines",
}

#: Words in windows of five that occur twice or more: equal neighbours among the sorted hashes give the windows'
#: places, and each place in order adds the words that the one before it has not covered.
_REPEATS = """
CASE WHEN size(array_distinct(s)) = size(s) THEN 0L ELSE
  aggregate(
    element_at(transform(array(sort_array(transform(s, (x, i) -> named_struct('x', x, 'i', i)))),
      z -> sort_array(transform(filter(z, (e, j) -> coalesce(get(z, j - 1).x = e.x, false) OR coalesce(get(z, j + 1).x = e.x, false)), e -> e.i))), 1),
    named_struct('last', -5, 'n', 0L),
    (a, p) -> named_struct('last', p, 'n', a.n + least(5, p - a.last)),
    a -> a.n)
END
"""

#: Labelled documents up to which their ids are broadcast.
FEW_LABELS = 2_000_000


def _count(kept: str) -> Column:
    """Characters of the class ``kept`` in the text."""
    return F.length(F.regexp_replace("__text", f"[^{kept}]+", "")).cast("long")


def base_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, the base columns and base_failed, and the further counts that FEATURES use; a column __row stays."""
    row = [c for c in documents.columns if c == "__row"]
    text = documents.select(*row, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    trimmed = F.btrim("__text", F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    hashes = "transform(__words, w -> xxhash64(w))"
    windows = "CASE WHEN size(h) < 5 THEN array() ELSE transform(sequence(0, size(h) - 5), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4))) END"
    inner = f"""
    element_at(transform(array({hashes}), h -> named_struct(
      'distinct', CAST(size(array_distinct(h)) AS long),
      'repeat', element_at(transform(array({windows}), s -> {_REPEATS}), 1))), 1)"""
    found = text.withColumns({"__words": words, "__lines": lines}).select(
        *row,
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__words")).cast("long").alias("word_chars"),
        _count("#*$%&|<>").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _count(r"\p{Lu}").alias("n_upper"),
        _count("!?").alias("n_marks"),
        _count("0-9").alias("n_digits"),
        F.expr(inner).alias("__inner"),
    )
    found = found.select("*", F.col("__inner.distinct").alias("n_distinct_words"), F.col("__inner.repeat").alias("n_repeat_words")).drop("__inner")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def features(statistics: DataFrame) -> DataFrame:
    """``statistics`` with a double column for each of FEATURES; 0 where the divisor is 0."""
    return statistics.withColumns({k: F.coalesce(F.expr(f"try_divide(CAST({v.split(' / ')[0]} AS double), CAST({v.split(' / ')[1]} AS double))"), F.lit(0.0)) for k, v in FEATURES.items()})


@dataclass
class DecisionList:
    """Ordered rules; each is a list of (feature, sign, threshold), sign '>' or '<='. All of a rule must hold."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)
    precision: list[float] = field(default_factory=list)

    @staticmethod
    def holds(rule: list[tuple[str, str, float]]) -> Column:
        found = F.lit(True)
        for feature, sign, threshold in rule:
            found = found & (F.col(feature) > threshold if sign == ">" else F.col(feature) <= threshold)
        return found

    def expression(self) -> Column:
        """Number of the first rule that holds, from 1; null where none does."""
        found = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            found = F.when(self.holds(self.rules[i - 1]), F.lit(i)).otherwise(found)
        return found


def learn(
    labelled: DataFrame, label: str = "quality", max_rules: int = 8, max_conditions: int = 3, bins: int = 32,
    min_precision: float = 0.95, min_covered: int = 5,
) -> DecisionList:
    """A list that rejects rows of label 0. labelled: doc_id, FEATURES, the label (0 or 1)."""
    names = list(FEATURES)
    rows = labelled.where(F.col(label).isin(0, 1)).select("doc_id", (F.col(label) == 0).cast("int").alias("bad"), *names)
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in names]).collect()
    if {r["bad"] for r in cuts} != {0, 1}:
        return DecisionList()
    edges = {c: sorted({x for r in cuts for x in r[c]}) for c in names}
    # a row's bin in a feature: how many edges lie below its value, so "value > edges[i]" is "bin > i"
    binned = settle(rows.select("doc_id", "bad", part, *[_bin(c, edges[c]).alias(c) for c in names]), 4)
    out = DecisionList()
    taken: list[list[tuple[str, str, int]]] = []

    def holds(rule: list[tuple[str, str, int]]) -> Column:
        found = F.lit(True)
        for c, sign, i in rule:
            found = found & (F.col(c) > i if sign == ">" else F.col(c) <= i)
        return found

    while len(out.rules) < max_rules:
        left = binned
        for rule in taken:
            left = left.where(~holds(rule))
        rule: list[tuple[str, str, int]] = []
        grow = left.where("not prune")
        while len(rule) < max_conditions:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("i")) for c in names])).alias("x")
            counts = grow.where(holds(rule)).select("bad", pairs).groupBy("x.c", "x.i").agg(F.sum("bad").alias("p"), F.count(F.lit(1)).alias("n")).collect()
            best = _best(counts, edges, min_covered)
            if not best:
                break
            rule.append(best[:3])
            if best[3] >= 1:
                break
        if not rule:
            break
        prune = left.where("prune").agg(*[F.struct(F.sum(F.when(holds(rule[: i + 1]), F.col("bad"))).alias("p"), F.count(F.when(holds(rule[: i + 1]), 1)).alias("n")).alias(f"r{i}") for i in range(len(rule))]).first()
        score = [((2 * (r["p"] or 0) - r["n"]) / r["n"] if r["n"] else -1.0, (r["p"] or 0) / r["n"] if r["n"] else 0.0, r["n"]) for r in prune]
        at = max(range(len(rule)), key=lambda i: (round(score[i][0], 3), -i))
        if score[at][1] < min_precision or score[at][2] < max(1, min_covered // 2):
            break
        rule = rule[: at + 1]
        taken.append(rule)
        out.rules.append([(c, sign, float(edges[c][i])) for c, sign, i in rule])
        out.precision.append(score[at][1])
    return out


def _bin(feature: str, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(feature)))


def _best(counts: list, edges: dict[str, list[float]], min_covered: int) -> tuple[str, str, int, float] | None:
    """The condition of the largest FOIL gain, and its precision."""
    found, best = None, 1e-9
    for c in edges:
        own = {r["i"]: (r["p"], r["n"] - r["p"]) for r in counts if r["c"] == c}
        p_all, n_all = sum(p for p, _ in own.values()), sum(n for _, n in own.values())
        if not p_all:
            continue
        before, p_low, n_low = math.log2(p_all / (p_all + n_all)), 0, 0
        for i in range(len(edges[c])):
            p, n = own.get(i, (0, 0))
            p_low, n_low = p_low + p, n_low + n
            for sign, q, m in (("<=", p_low, n_low), (">", p_all - p_low, n_all - n_low)):
                if q >= min_covered and (gain := q * (math.log2(q / (q + m)) - before)) > best:
                    found, best = (c, sign, i, q / (q + m)), gain
    return found


def apply(statistics: DataFrame, rules: DecisionList) -> DataFrame:
    """Base columns with ``rule`` (0: the base rule; null: none) and ``kept``; statistics: with FEATURES."""
    rule = F.when(F.col("base_failed"), F.lit(0)).otherwise(rules.expression())
    return statistics.withColumn("rule", rule).withColumn("kept", F.col("rule").isNull())


def quality(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DecisionList]:
    """Statistics and verdicts of all documents, and the list learned from those that are labelled."""
    measured = settle(features(base_statistics(documents)))
    labelled = measured.where("not base_failed").join(labels.select("doc_id", "quality").where("quality is not null"), "doc_id")
    rules = learn(labelled)
    return apply(measured, rules), rules


def kept_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    The list is learned from the labelled documents; each row is judged by its own text, whatever its doc_id is.
    """
    labelled = labels.where("quality is not null").select("doc_id").distinct()
    if labelled.count() <= FEW_LABELS:
        labelled = F.broadcast(labelled)  # so texts aren't shuffled to find theirs
    _, rules = quality(documents.join(labelled, "doc_id", "left_semi").select("doc_id", "text"), labels)
    rows = documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"))
    return apply(features(base_statistics(rows)), rules).where("kept").select("__row.*")
