"""Two catalogs are compared part by part only where they differ."""

from pyspark.sql import functions as F

from ledgerlens.operators.catalog import identity
from ledgerlens.session import shared_checkpoint


def test_equal_twigs_are_not_compared(spark):
    """One changed part among many: found, with only the leaves of its twig in the join."""
    leaves = lambda n, changed: shared_checkpoint(spark.range(n).select(F.lit("catalog").alias("branch"), F.concat(F.lit("p"), "id").alias("part"), F.when(F.col("id") == changed, -1).otherwise(F.col("id")).alias("leaf")))
    before, after = leaves(20_000, None), leaves(20_001, 77)
    assert sorted(tuple(r) for r in identity.changes(before, after).collect()) == [("catalog", "p20000", "added"), ("catalog", "p77", "changed")]
    assert identity.branches(before.withColumn("twig", F.pmod(F.xxhash64("part"), F.lit(identity.TWIGS))), "twig").count() > 3000
