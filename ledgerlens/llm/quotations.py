"""Quotation linking: replies find the messages they quote, conversations come out in reply order, unquoted.

A line's quote level is the number of ``>`` before its text. Quoted and own lines are normalised (markers
dropped, lower case, white space joined) and hashed. A message's first-level quotes are its parent's own
lines, its second-level quotes the parent's first-level quotes, and so on, so each level's lines are looked up
among own lines of earlier messages of the conversation. For every quoted line the latest earlier message
that has it is taken, and the message that most first-level words point to (ties: the latest) is the parent.

The lookup is an as-of search without pairs: turns are cut into spans of ``SPAN``; the last own line before a
quote is found within the span by a window, and across spans from one row per span and line, so a line that
a third of all messages quote is neither gathered nor multiplied. Only lines that some message quotes are
looked up. Paths from the root are found by doubling, so deep threads take few rounds.

Defined cases: null and empty texts have no lines; a null conversation is one of its own; messages without
found quotes are roots in turn order; a null turn has no place in the order and comes first, without links;
repeated rows share links and stand next to each other; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import store
from ledgerlens.operators.ranking import exact_rank

SPAN = 1024
MARK = r"^(?:[ \t]*>)+"
KEYS = ["conv_id", "turn", "text_key"]


def lines(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text_key, level, line, words) of every line with a word."""
    raw = messages.where("text is not null").select(*KEYS, F.explode(F.split("text", r"\r?\n")).alias("raw"))
    level = F.length(F.regexp_replace(F.regexp_extract("raw", MARK, 0), "[^>]", ""))
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace("raw", MARK, ""), r"\s+", " ")))
    out = raw.select(*KEYS, level.alias("level"), plain.alias("plain")).where("plain <> ''")
    return out.select(*KEYS, "level", F.xxhash64("plain").alias("line"), F.size(F.split("plain", " ")).alias("words"))


def unquoted():
    """The text without quoted lines, and without the blank lines they leave at its ends."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~x.rlike(MARK))
    return F.when(F.col("text").rlike(r"(?m)" + MARK), F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")).otherwise(F.col("text"))


def quoted_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text_key, level, words, source): for every quoted line the latest earlier turn that has
    it as an own line; null where there is none."""
    numbered = messages.where("turn is not null")
    quotes = store(lines(numbered.where(F.col("text").rlike(r"(?m)" + MARK))).where("level > 0"))
    wanted = quotes.select("conv_id", "line").distinct()
    own = lines(numbered).where("level = 0").select("conv_id", "turn", "line").distinct()
    same = own["conv_id"].eqNullSafe(wanted["conv_id"]) & (own["line"] == wanted["line"])
    own = store(own.join(wanted, same, "left_semi"))
    span = F.floor(F.col("turn") / SPAN)
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    both = own.select("conv_id", "line", "turn", F.col("turn").alias("own"), null("text_key", "long"), null("level", "int"), null("words", "int"), F.lit(False).alias("asks"))
    both = both.unionByName(quotes.select("conv_id", "line", "turn", null("own", "long"), "text_key", "level", "words", F.lit(True).alias("asks"))).withColumn("span", span)
    # Rows of the same turn are no earlier ones.
    near = Window.partitionBy("conv_id", "line", "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("near", F.max("own").over(near)).where("asks")
    spans = own.withColumn("span", span).groupBy("conv_id", "line", "span").agg(F.max("turn").alias("last"))
    # One row per span that asks or has the line.
    axis = spans.unionByName(inside.select("conv_id", "line", "span").distinct().withColumn("last", F.lit(None).cast("long"))).groupBy("conv_id", "line", "span").agg(F.max("last").alias("last"))
    before = Window.partitionBy("conv_id", "line").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = axis.select(F.col("conv_id").alias("c"), F.col("line").alias("l"), F.col("span").alias("s"), F.max("last").over(before).alias("far"))
    out = inside.join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("line") == F.col("l")) & (F.col("span") == F.col("s")), "left")
    return out.select(*KEYS, "level", "words", F.coalesce("near", "far").alias("source"))


def parents(found: DataFrame) -> DataFrame:
    """One row per quoting message: quoted and linked lines, the turn of its parent (null: none found)."""
    votes = found.groupBy(*KEYS, "source").agg(F.sum(F.when(F.col("level") == 1, F.col("words")).otherwise(0)).alias("direct"), F.count("*").alias("n"))
    vote = F.when(F.col("source").isNotNull() & (F.col("direct") > 0), F.struct("direct", "source"))
    return votes.groupBy(*KEYS).agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), F.max(vote).alias("best")).select(*KEYS, "n_quoted", "n_linked", F.col("best.source").alias("parent"))


def paths(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, path): the turns from the root down to every message that replies, by doubling."""
    start = linked.groupBy("conv_id", "turn").agg(F.max("parent").alias("up"))
    now = store(start.select("conv_id", "turn", "up", F.array("turn").alias("path")))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        joined = now.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("t")), "left")
        # A parent that replies to nothing is a root: it is the end of the path.
        done = F.col("up").isNotNull() & F.col("t").isNull()
        path = F.when(done, F.concat(F.array("up"), "path")).when(F.col("t").isNotNull(), F.concat("path2", "path")).otherwise(F.col("path"))
        now = store(joined.select("conv_id", "turn", F.when(done, None).otherwise(F.col("up2")).alias("up"), path.alias("path")))
        if now.where("up is not null").isEmpty():
            return now.select("conv_id", "turn", "path")


def link(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position in reply order (from 1), parent and root turn, depth,
    quoted and linked lines, and the text without quotes."""
    messages = messages.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("text_key"))
    replies = store(parents(quoted_turns(messages)))
    threads = paths(replies.where("parent is not null"))
    own = replies.withColumnsRenamed({k: f"r_{k}" for k in KEYS})
    rows = messages.join(own, [messages[k].eqNullSafe(F.col(f"r_{k}")) for k in KEYS], "left").drop(*(f"r_{k}" for k in KEYS))
    threads = threads.withColumnsRenamed({"conv_id": "c", "turn": "t"})
    rows = rows.join(threads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t")
    rows = rows.withColumn("path", F.coalesce("path", F.array("turn")))
    # Ranked within the conversation, a null one included.
    rows = rows.withColumn("_none", F.col("conv_id").isNull()).withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    placed = exact_rank(rows, ["path", "text_key", "role"], ["_none", "_conv"], "position")
    return placed.select(
        "conv_id", "turn", "role", "position", F.col("parent").alias("parent_turn"), F.element_at("path", 1).alias("root_turn"), (F.size("path") - 1).alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), unquoted().alias("text"),
    )


def query(spark, sf_dir):
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
