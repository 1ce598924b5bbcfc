"""Quotation linking of messages.

Lines that begin with ``>`` marks are quotes; the number of marks (blanks between them don't matter) is the level, and
the mark before it may stand after blanks. Runs of lines of one level are passages: those of level 0 are a message's own
words, others quote someone. Passages are normalised (lower case, runs of blanks to one, blanks and ``.,;:!?`` off the
ends) and hashed; a quoted passage is linked to the message of the same conversation that comes latest before the
quoting one among those whose own words hold a passage, a line or the whole of that hash; where there is none, as for
trimmed or attributed quotes, to the one that holds most of its lines (of several, the latest). The message that a reply's
shallowest linked quote comes from is its parent (of several, the latest); a message without one has no parent. A
conversation is ordered by replies: messages follow their parent, thread by thread, each in the order of turns; bodies
are the own words without quotes.

All of it is DataFrame operations. Both sides of a link are keyed by (conversation, hash) and put in ranges of (key,
turn): the latest holder before a turn is the latest of the ranges before and of the rows before in its range, so
neither a passage that thousands of messages share nor a conversation of any size meets in one task, and nothing joins all
who ask with all who hold. For trimmed quotes, the lines that a passage shares with others of its conversation are its
key: holders of its lines are counted once a set of lines, however many messages quote it.

Every row is a message of its own and is returned, rows that repeat (conv_id, turn) or are equal too; a turn isn't before
itself. Null texts are empty messages; null roles stay null; rows with a null conv_id or turn are left out of links and
order (parent, thread and position null). An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetflow.llm._shared import settle

MARKS = r"^[ \t]*(?:>[ \t]*)+"
ENDS = " \t.,;:!?"


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "), F.lit(ENDS))


def messages(conversations: DataFrame) -> DataFrame:
    """One row a message: conv_id, turn, role, text, and ``node``, a number of its own in the order of (conv_id, turn)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", F.xxhash64("text", "role")]
    return settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))


def parsed(rows: DataFrame) -> DataFrame:
    """Messages with ``parts`` (level, text of each passage in order), ``body`` and ``n_quotes``."""
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    level = lambda x: F.length(F.regexp_replace(marks(x), r"[^>]+", ""))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(level(x).alias("level"), F.substr(x, F.length(marks(x)) + 1).alias("line")))
    quoting = F.col("text").rlike(r"(?m)" + MARKS)
    # where runs of one level begin, and the lines from there to the next begin: each line is copied once
    starts = F.expr("filter(sequence(0, size(__lines) - 1), i -> i = 0 OR get(__lines, i).level <> get(__lines, i - 1).level)")
    runs = F.expr("""transform(__starts, (s, j) -> named_struct('level', get(__lines, s).level,
      'text', array_join(transform(slice(__lines, s + 1, coalesce(get(__starts, j + 1), size(__lines)) - s), x -> x.line), '\n')))""")
    rows = rows.withColumn("__lines", F.when(quoting, lines)).withColumn("__starts", starts)
    parts = F.when(F.col("__lines").isNotNull(), runs).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("text"))))
    rows = rows.withColumn("parts", parts).drop("__lines", "__starts")
    own = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"])
    return rows.withColumns({"body": F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n")), "n_quotes": F.size(F.filter("parts", lambda p: p["level"] > 0))})


def links(rows: DataFrame) -> DataFrame:
    """conv_id, node, level, hash, from_node, from_turn for every quoted passage that is found; rows: of parsed().

    A passage comes from the latest earlier message that holds it whole or, where none does, from the one that holds
    most of its lines (of several, the latest).
    """
    keyed = rows.where("conv_id is not null and turn is not null")
    digest = lambda x: F.md5(x.cast("binary"))
    known = lambda x: F.array_distinct(F.transform(F.filter(F.transform(x, normalised), lambda t: t != ""), digest))
    own = F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"])
    single = F.flatten(F.transform(own, lambda t: F.split(t, "\n")))
    quoted = keyed.where("n_quotes > 0").select("conv_id", "turn", "node", F.explode(F.filter("parts", lambda p: p["level"] > 0)).alias("p"))
    quoted = quoted.select("conv_id", "turn", "node", "p.level", normalised(F.col("p.text")).alias("passage"), known(F.split("p.text", "\n")).alias("lines"))
    passages = quoted.where("passage <> ''").groupBy("conv_id", "turn", "node", digest(F.col("passage")).alias("passage")).agg(F.min("level").alias("level"), F.max("lines").alias("lines"))
    passages = settle(passages)
    wanted = passages.select("conv_id", F.explode(F.array_union(F.array("passage"), "lines")).alias("hash")).distinct()
    # only what is quoted somewhere in its conversation goes on
    offered = keyed.select("conv_id", F.explode(known(F.concat(own, single, F.array("body")))).alias("hash"), "turn", "node")
    offered = settle(offered.join(wanted, ["conv_id", "hash"], "left_semi"))
    asked = passages.select("conv_id", F.col("passage").alias("key"), "turn").distinct()
    latest = _latest(offered.select("conv_id", F.col("hash").alias("key"), "turn", F.struct(F.lit(1).cast("long").alias("n"), "node", "turn").alias("holder")), asked)
    whole = settle(passages.join(latest.withColumnRenamed("key", "passage"), ["conv_id", "turn", "passage"]).select("conv_id", "node", "level", F.col("passage").alias("hash"), F.col("holder.node").alias("from_node"), F.col("holder.turn").alias("from_turn")))
    parts = passages.join(whole.select("node", F.col("hash").alias("passage")), ["node", "passage"], "left_anti")
    # the lines of a passage that messages of its conversation hold are its key
    held = offered.select("conv_id", "hash").distinct()
    shared = parts.select("conv_id", "turn", "node", "passage", "level", F.explode("lines").alias("hash")).join(held, ["conv_id", "hash"])
    sets = shared.groupBy("conv_id", "turn", "node", "passage", "level").agg(F.sort_array(F.collect_list("hash")).alias("lines"))  # lines of one quote
    sets = settle(sets.withColumn("key", digest(F.array_join("lines", ""))))
    lines = sets.groupBy("conv_id", "key").agg(F.first("lines").alias("lines")).select("conv_id", "key", F.explode("lines").alias("hash"))
    counts = lines.join(offered, ["conv_id", "hash"]).groupBy("conv_id", "key", "turn", "node").agg(F.count(F.lit(1)).alias("n"))
    best = _latest(counts.select("conv_id", "key", "turn", F.struct("n", "node", "turn").alias("holder")), sets.select("conv_id", "key", "turn").distinct())
    partly = sets.join(best, ["conv_id", "key", "turn"]).select("conv_id", "node", "level", F.col("passage").alias("hash"), F.col("holder.node").alias("from_node"), F.col("holder.turn").alias("from_turn"))
    return whole.unionByName(partly)


def _latest(held: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (conv_id, key, turn) with the largest ``holder`` of the same key in ``held`` at a smaller turn, where there is
    one; by ranges of (key, turn)."""
    key = ["conv_id", "key"]
    both = held.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    ranged = settle(both.repartitionByRange(*key, "turn").withColumn("range", F.spark_partition_id()))
    earlier = F.max("most").over(Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy(*key, "range").agg(F.max("holder").alias("most")).select(*key, "range", earlier.alias("earlier"))  # a row a range
    within = F.max("holder").over(Window.partitionBy(*key, "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    found = ranged.withColumn("within", within).where("asks").join(totals, [*key, "range"])
    return settle(found.select(*key, "turn", F.greatest("within", "earlier").alias("holder")).where("holder is not null"))


def linked_messages(conversations: DataFrame) -> DataFrame:
    """Every message: conv_id, turn, role, body, n_quotes, n_linked, parent_turn, node, parent_node."""
    rows = parsed(messages(conversations))
    best = links(rows).groupBy("node").agg(F.count(F.lit(1)).alias("n_linked"), F.min(F.struct("level", (-F.col("from_node")).alias("late"), "from_turn")).alias("best"))
    best = best.select("node", "n_linked", (-F.col("best.late")).alias("parent_node"), F.col("best.from_turn").alias("parent_turn"))
    out = rows.drop("parts", "text").join(best, "node", "left")
    return out.select("conv_id", "turn", "role", "body", F.col("n_quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_turn", "node", "parent_node")


def reply_ordered(linked: DataFrame) -> DataFrame:
    """``linked`` with ``thread`` (its first turn), ``depth`` and ``position`` (from 0 within the conversation).

    A message's position is the number of messages in the threads before its own, and for it and each message above it
    one more and the messages below older siblings. Sizes, depths and sums along parents are found by doubling the
    distance that is looked up, in as many rounds as the logarithm of the longest chain; sums over siblings and threads
    go by ranges. No conversation is gathered. A table without ``node`` has one message a turn.
    """
    if "node" not in linked.columns:
        linked = linked.withColumns({"node": F.col("turn"), "parent_node": F.col("parent_turn")})
    linked = settle(linked)
    turns = linked.where("conv_id is not null and turn is not null").select("conv_id", "node", "turn", "parent_node", "parent_turn")
    above = turns.select("conv_id", F.col("node").alias("parent_node"))
    replies = settle(turns.where("parent_turn < turn").join(above, ["conv_id", "parent_node"], "left_semi").select("conv_id", "node", "parent_node"))
    roots = turns.join(replies, ["conv_id", "node"], "left_anti").select("conv_id", "node", "turn")

    # messages below each one, those up to a distance at a time: jump is the message at exactly that distance above
    below = replies.select("conv_id", "node", F.lit(0).cast("long").alias("below")).limit(0)
    jumps = replies.withColumnRenamed("parent_node", "jump")
    while not jumps.isEmpty():
        more = jumps.join(below, ["conv_id", "node"], "left").groupBy("conv_id", F.col("jump").alias("node")).agg(F.sum(F.coalesce("below", F.lit(0)) + 1).alias("below"))
        below = settle(below.unionByName(more).groupBy("conv_id", "node").agg(F.sum("below").alias("below")))
        far = jumps.select("conv_id", F.col("node").alias("jump"), F.col("jump").alias("far"))
        jumps = settle(jumps.join(far, ["conv_id", "jump"]).select("conv_id", "node", F.col("far").alias("jump")))

    sized = lambda x: x.join(below, ["conv_id", "node"], "left").withColumn("size", F.coalesce("below", F.lit(0)) + 1).drop("below")
    threads = _before(sized(roots), ["conv_id"]).select("conv_id", F.col("node").alias("thread"), F.col("turn").alias("first_turn"), "before")
    path = _before(sized(replies), ["conv_id", "parent_node"])
    path = settle(path.select("conv_id", "node", F.col("parent_node").alias("up"), F.lit(1).alias("depth"), (F.col("before") + 1).alias("after")))
    while True:
        upper = path.select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("after").alias("after2"))
        step = path.join(upper, ["conv_id", "up"], "left")
        moved = not step.where("up2 is not null").isEmpty()
        if not moved:
            break
        path = settle(step.select("conv_id", "node", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("after") + F.coalesce("after2", F.lit(0))).alias("after")))
    first = roots.select("conv_id", "node", F.col("node").alias("thread"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("after"))
    placed = path.withColumnRenamed("up", "thread").unionByName(first).join(threads, ["conv_id", "thread"])
    placed = placed.select("conv_id", "node", F.col("first_turn").alias("thread"), "depth", (F.col("before") + F.col("after")).alias("position"))
    return linked.join(placed, ["conv_id", "node"], "left")


def _before(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``before``: the sum of ``size`` over the rows of the same group with a smaller node, by ranges."""
    ranged = settle(rows.repartitionByRange(*group, "node").withColumn("range", F.spark_partition_id()))
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = ranged.groupBy(*group, "range").agg(F.sum("size").alias("size"))
    totals = totals.select(*group, "range", earlier(Window.partitionBy(*group).orderBy("range")).alias("base"))
    within = ranged.withColumn("within", earlier(Window.partitionBy(*group, "range").orderBy("node")))
    return within.join(totals, [*group, "range"]).withColumn("before", F.col("base") + F.col("within")).drop("base", "within", "range")


def formatted(ordered: DataFrame) -> DataFrame:
    """``ordered`` with ``chat``, each message as a turn of a chat without quotes; null without a place.

    A conversation's chat is that of its messages by ``position``, one after the other; it isn't gathered into one row.
    """
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return ordered.drop("node", "parent_node").withColumn("chat", F.when(F.col("position").isNotNull(), line))
