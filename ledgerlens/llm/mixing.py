"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement.

Sizes are words. Every source has a weight (3, 1, 2 repeating over the sources by code point, null last); all
targets together are ``SHARE`` of all sizes. A target stops at ``CAP`` times its source's size and the excess
goes to the other sources by weight, until none is above. A source first gives whole epochs; what is then left
of its budget is drawn: each document has the key -ln(u) / w with u a hash of the document and w its quality
weight, and documents are taken by ascending key until their sizes fill the budget. The document that crosses
it gives the words that are left, so every source meets its rounded target exactly.

Prefix sums do not gather a source in one task. Keys are mapped to (0, 1), a histogram of ``BINS`` bins finds
the bin where the budget ends, a second one divides that bin, and only documents of the last bin (about a 16
millionth of a source) are ordered by row.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a source, the last one; a source
without words has the target 0; equal rows have equal keys, so which of them crosses the budget is open while
the rows of the result are the same; an empty table gives an empty result; further columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import boxed, documents, small_side, store, unboxed
from ledgerlens.operators.ranking import exact_rank

WEIGHTS, SHARE, CAP, BINS, SEED = (3, 1, 2), 1.5, 2, 4096, 7
WORD = r"[^\x20\x09-\x0D]+"


def quality_weight():
    """Between 0.1 and 1: the share of a text's characters that are letters or white space."""
    plain = F.length("text") - F.length(F.regexp_replace("text", r"[\p{L}\s]+", ""))
    return F.lit(0.1) + 0.9 * F.coalesce(plain / F.nullif(F.length("text"), F.lit(0)), F.lit(0.0))


def sized(docs: DataFrame, weight=None) -> DataFrame:
    """Add _size (words) and _p, the sampling key mapped to (0, 1) in its order."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    key = -F.log(u) / (quality_weight() if weight is None else weight)
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_p", 1 - F.exp(-key))


def source_targets(rows: DataFrame) -> DataFrame:
    """(source, source_size, target) of every source; a few numbers at a time come to the driver."""
    sources = store(rows.groupBy("source").agg(F.sum("_size").alias("source_size")))
    ranked = exact_rank(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"])
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighted = store(ranked.select("source", "source_size", weight.cast("double").alias("w")))
    level, stopped, above = 0.0, -1, F.lit(False)
    while True:
        row = weighted.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, CAP * F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count_if(above).alias("n")
        ).first()
        if row["n"] == stopped or not row["w"]:
            break
        level, stopped = (SHARE * row["all"] - row["full"]) / row["w"], row["n"]
        above = F.lit(level) * F.col("w") > CAP * F.col("source_size")
    return weighted.select("source", "source_size", F.least(CAP * F.col("source_size").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def _crossing(rows: DataFrame, plan: DataFrame, lo, width: float, name: str) -> DataFrame:
    """The bin in which each source's remainder ends, and what the bins before it hold.

    rows: _p, _size and the plan's columns, inside the bin found so far, which begins at ``lo``.
    """
    at = F.least(F.floor((F.col("_p") - lo) / F.lit(width)), F.lit(BINS - 1)).alias("bin")
    bins = rows.groupBy("source", "rest", "before", at).agg(F.sum("_size").alias("sum"))
    # At most BINS rows a source.
    w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("start", F.col("before") + F.coalesce(F.sum("sum").over(w), F.lit(0)))
    return bins.where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("sum") >= F.col("rest"))).select(F.col("source").alias("_s"), F.col("bin").alias(name), F.col("start").alias(f"{name}_before"))


def _with(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join rows with a table of one row per source."""
    return rows.join(small_side(plan.withColumnRenamed("source", "_s"), 100_000), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def plan_sources(rows: DataFrame) -> DataFrame:
    """One row per source: target, whole epochs, the bins where the remainder ends, what is left there."""
    budget = F.round("target").cast("long")
    epochs = F.coalesce(F.floor(budget / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    plan = store(source_targets(rows).withColumn("epochs", epochs).withColumn("rest", budget - epochs * F.col("source_size")).withColumn("before", F.lit(0).cast("long")))
    # The remainder counts over the full order, so each level starts with what lies before it.
    drawn = _with(rows.select("source", "_size", "_p"), plan.select("source", "rest", "before")).where("rest > 0 and _size > 0")
    first = _crossing(drawn, plan, F.lit(0.0), 1 / BINS, "bin1")
    plan = store(plan.join(first, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    inside = _with(rows.select("source", "_size", "_p"), plan.select("source", "rest", F.col("bin1_before").alias("before"), "bin1")).where("rest > 0 and _size > 0").where(F.least(F.floor(F.col("_p") * BINS), F.lit(BINS - 1)) == F.col("bin1"))
    second = _crossing(inside, plan, F.col("bin1") / F.lit(float(BINS)), 1 / BINS / BINS, "bin2")
    return store(plan.join(second, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "before"))


def take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and taken (words the mix takes, repeats counted) to every row."""
    rows = _with(rows, plan)
    at1 = F.least(F.floor(F.col("_p") * BINS), F.lit(BINS - 1))
    at2 = F.least(F.floor((F.col("_p") - F.col("bin1") / F.lit(float(BINS))) / F.lit(1 / BINS / BINS)), F.lit(BINS - 1))
    place = F.when(F.col("bin1").isNull() | (F.col("_size") == 0), "none").when(at1 < F.col("bin1"), "whole").when(at1 > F.col("bin1"), "none").when(at2 < F.col("bin2"), "whole").when(at2 > F.col("bin2"), "none").otherwise("last")
    rows = rows.withColumn("_place", place)
    easy = rows.where("_place <> 'last'").withColumn("_drawn", F.when(F.col("_place") == "whole", F.col("_size")).otherwise(F.lit(0)))
    w = Window.partitionBy("source").orderBy("_p", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bin2_before") + F.coalesce(F.sum("_size").over(w), F.lit(0))
    last = rows.where("_place = 'last'").withColumn("_drawn", F.greatest(F.lit(0), F.least("_size", F.col("rest") - start)))
    both = easy.unionByName(last)
    return both.withColumn("taken", F.col("epochs") * F.col("_size") + F.col("_drawn")).drop("_place", "epochs", "rest", "bin1", "bin1_before", "bin2", "bin2_before")


def amounts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = store(sized(docs).select("doc_id", "source", "_size", "_p"))
    return take(rows, plan_sources(rows)).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "source")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, columns as given: a row for every whole repeat, and one with the words drawn from the
    document that crosses its source's budget. Documents the mix does not take are absent."""
    rows = sized(boxed(docs, "doc_id", "source", "text"))
    plan = plan_sources(store(rows.select("doc_id", "source", "_size", "_p")))
    taken = take(rows, plan)
    whole = F.floor(F.col("taken") / F.nullif("_size", F.lit(0))).cast("int")
    part = (F.col("taken") - whole * F.col("_size")).cast("int")
    # Words with the white space behind them; the drawn part ends at a word.
    words = F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(words, F.lit(1), part + lead), "")
    copies = F.concat(F.array_repeat(F.col("text"), F.coalesce(whole, F.lit(0))), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    return unboxed(taken.withColumn("_text", F.explode(copies)), docs.columns, text=F.col("_text"))


def query(spark, sf_dir):
    return amounts(documents(spark, sf_dir)).drop("source")
