"""Where quotes come from, against a search of all earlier messages, and joins that don't grow with all who ask."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from facetflow.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(text):
    return re.sub(r"[ \t\r\n]+", " ", text.lower()).strip(quotes.ENDS)


def _runs(text):
    """(level, lines) of a message's passages."""
    out = []
    for line in text.split("\n"):
        marks = re.match(r"^[ \t]*(?:>[ \t]*)+", line)
        level = marks[0].count(">") if marks else 0
        line = line[len(marks[0]) :] if marks else line
        if out and out[-1][0] == level:
            out[-1][1].append(line)
        else:
            out.append((level, [line]))
    return out


def _parents(rows):
    """(conv_id, turn, text) to parent turn, by looking at all earlier messages of each one's conversation."""
    found = defaultdict(list)
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            found[conv, turn, text].append(None)
            continue
        earlier = [(t, _runs(x or "")) for c, t, _, x in rows if c == conv and t is not None and t < turn]
        holds = []
        for t, runs in earlier:
            own = ["\n".join(lines) for level, lines in runs if level == 0]
            holds.append((t, {_plain(x) for x in [*own, *(y for o in own for y in o.split("\n")), "\n".join(own)]} - {""}))
        best = None
        for level, lines in _runs(text or ""):
            passage = _plain("\n".join(lines))
            if not level or not passage:
                continue
            whole = [t for t, h in holds if passage in h]
            lines = {_plain(x) for x in lines} - {""}
            part = [(len(lines & h), t) for t, h in holds if lines & h]
            source = max(whole) if whole else max(part)[1] if part else None
            if source is not None and (best is None or (level, -source) < best):
                best = (level, -source)
        found[conv, turn, text].append(-best[1] if best else None)
    return found


def test_sources_against_a_search_of_all_messages(spark):
    """Random conversations with trimmed, nested and attributed quotes, repeated and null turns, and equal rows."""
    rng = np.random.default_rng(3)
    rows = []
    for conv in range(12):
        for turn in range(25):
            own = [f"line {x}" for x in rng.integers(0, 30, rng.integers(1, 5))]
            text = "\n".join(own)
            if rows and rng.random() < 0.7:
                other = [r for r in rows if r[0] == conv and r[3]]
                if other:
                    lines = other[int(rng.integers(len(other)))][3].split("\n")
                    some = [x for x in lines if rng.random() < 0.8]
                    text = "\n".join(["> " + x for x in some] + (["> someone wrote:"] if rng.random() < 0.3 else []) + [text])
            rows.append((conv, turn if rng.random() < 0.95 else turn - 1, "u", text))
    rows += [(None, 1, "u", "> line 1"), (None, 1, "u", "line 1"), (3, None, None, "line 2"), (3, None, None, "line 2"), (4, 9, "u", None), rows[20], rows[20]]
    got = quotes.formatted(quotes.reply_ordered(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA).repartition(5)))).collect()
    want = _parents(rows)
    assert len(got) == len(rows)
    count = defaultdict(list)
    for r in got:
        count[r.conv_id, r.turn].append((r.parent_turn is not None, r.parent_turn))
    by_turn = defaultdict(list)
    for (conv, turn, _), parents in want.items():
        by_turn[conv, turn] += [(p is not None, p) for p in parents]
    assert {k: sorted(v, key=str) for k, v in count.items()} == {k: sorted(v, key=str) for k, v in by_turn.items()}
    placed = defaultdict(list)
    for r in got:
        if r.conv_id is not None and r.turn is not None:
            placed[r.conv_id].append(r.position)
        else:
            assert r.position is None and r.thread is None
    assert all(sorted(v) == list(range(len(v))) for v in placed.values())


def test_rows_of_one_turn_are_kept_each(spark):
    rows = [(None, None, "a", "x"), (None, None, "a", "y"), (1, 0, "a", "first words"), (1, 0, "b", "other words"), (1, 1, "c", "> other words\nyes"), (1, 1, "c", "> first words\nno")]
    got = quotes.formatted(quotes.reply_ordered(quotes.linked_messages(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert len(got) == 6 and sorted(r.body for r in got) == ["first words", "no", "other words", "x", "y", "yes"]
    place = {r.body: r for r in got}
    assert place["no"].position == place["first words"].position + 1 and place["yes"].position == place["other words"].position + 1
    assert place["x"].position is None and place["yes"].parent_turn == place["no"].parent_turn == 0


def test_common_lines_are_not_joined_with_all_who_quote_them(spark, monkeypatch):
    """Two hundred replies that quote two lines held by four hundred messages: no table of both."""
    sizes = []
    plain = quotes.settle

    def counted(df):
        out = plain(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(quotes, "settle", counted)
    rows = [(1, i, "u", f"stock one\nstock two\nown {i}") for i in range(400)]
    rows += [(1, 400 + i, "u", f"> stock one\n> stock two\n> gone {i}\nanswer {i}") for i in range(200)]
    got = quotes.linked_messages(spark.createDataFrame(rows, SCHEMA))
    assert got.where(F.col("turn") >= 400).select("parent_turn").distinct().collect()[0][0] == 399
    assert got.where("n_linked = 1").count() == 200
    assert max(sizes) <= 2_000
