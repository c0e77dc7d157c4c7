"""Clauses and dated edges under short keys."""

from pyspark.sql import functions as F

from ledgerlens.functions.identity import clause_key, clause_key_of, short_clause_key
from ledgerlens.plans import q_graph


def test_canonical_keys_of_short_clause_keys(spark):
    rows = [("1", "A", "occ1"), (None, "A", "occ1"), ("", "A", "occ1"), ("a/b", "B", "o 2"), ('q"\\', "B", "é"), ("-7", "C", "occ1")]
    df = spark.createDataFrame(rows, "contract string, cls string, occ string")
    c, k, o = F.col("contract"), F.col("cls"), F.col("occ")
    short = df.select("*", short_clause_key(c, k, o).alias("short"), clause_key("ns", c, k, o).alias("want"), clause_key('n"s', c, k, o).alias("odd"))
    assert short.filter((clause_key_of("ns", F.col("short")) == F.col("want")) & (clause_key_of('n"s', F.col("short")) == F.col("odd"))).count() == len(rows)
    assert short.select("short").distinct().count() == len(rows)


def test_dated_edges_are_short(spark, small):
    """What the search stores and shuffles per edge does not hold a digest."""
    longest = q_graph.dated_edges(spark, small).agg(F.max(F.length("src") + F.length("dst"))).first()[0]
    assert longest < 40
