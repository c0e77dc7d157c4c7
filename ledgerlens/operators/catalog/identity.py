"""What a catalog is and what has changed in it: a hash tree over its nodes and edges that does not depend on order.

Leaves are single nodes and edges, branches the datasets (and one branch for what belongs to none), the root
is the run ID. Branch and root are folds of sums and exclusive-ors, so they combine on the map side for any
number of leaves, and two catalogs are compared leaf by leaf only where their branches differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import shared_checkpoint

#: Twigs of a branch.
TWIGS = 4096
FOLD = ["parts", "hash_sum", "hash_xor"]


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(branch, part, leaf): every node and edge under its name, with 60 bits of the digest of its branch, name and properties."""
    parts = nodes.select("branch", F.concat_ws(" ", "class_id", "identity").alias("part"), "properties").unionByName(
        edges.select("branch", F.concat_ws(" ", "source_class", "source", "type", "target_class", "target").alias("part"), "properties")
    )
    text = F.to_json(F.array("branch", "part", "properties"))
    return parts.select("branch", "part", F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("leaf"))


def branches(parts: DataFrame, *by: str) -> DataFrame:
    """One row per branch (and ``by``): its number of leaves, and the sum and exclusive-or of their digests."""
    return parts.groupBy("branch", *by).agg(F.count("*").alias("parts"), F.sum(F.col("leaf").cast("decimal(38,0)")).cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("leaf").alias("hash_xor"))


def run_id(folded: DataFrame) -> DataFrame:
    """The identity of the whole catalog, from its branches; equal catalogs have equal IDs, whenever they are harvested."""
    whole = folded.agg(F.coalesce(F.sum("parts"), F.lit(0)).alias("parts"), F.coalesce(F.sum("hash_sum"), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor("hash_xor"), F.lit(0)).alias("hash_xor"))
    return whole.withColumn("run_id", F.concat(F.lit("harvest-"), F.substring(F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in FOLD]), 256), 1, 16)))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(branch, part, change) between two frames of :func:`leaves`: added, removed or changed.

    Branches are compared in twigs, the leaves of which have one remainder of their part's hash. Each frame is read twice,
    once for its twigs and once for the leaves of the twigs that differ, so what is equal in a branch is not shuffled.
    """
    before, after = (parts.withColumn("twig", F.pmod(F.xxhash64("part"), F.lit(TWIGS))) for parts in (before, after))
    old, new = branches(before, "twig"), branches(after, "twig")
    same = [old[c].eqNullSafe(new[c]) for c in FOLD]
    # At most the branches times the twigs of one.
    touched = F.broadcast(shared_checkpoint(old.join(new, ["branch", "twig"], "full").filter(~(same[0] & same[1] & same[2])).select("branch", "twig")))
    inside = lambda parts, name: parts.join(touched, ["branch", "twig"], "left_semi").select("branch", "part", F.col("leaf").alias(name))
    both = inside(before, "was").join(inside(after, "now"), ["branch", "part"], "full").filter("NOT was <=> now")
    return both.select("branch", "part", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))
