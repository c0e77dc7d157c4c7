"""Exact ranks without one task per group, bounded fetches and capped distincts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import shared_checkpoint


def exact_rank(df: DataFrame, order: Sequence[str], group: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based position of each row within its group by the given unique order.

    Rows are range-partitioned on group and order, so a group with a third of all rows spreads over many
    partitions. The partitioned rows are written once to the shared checkpoint, which fixes the partition
    of every row. Ranks inside a partition are then offset by the counts of earlier partitions, a table
    with one row per group and partition.
    """
    keys = [*group, *order]
    placed = shared_checkpoint(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    return (
        placed.withColumn("_local", local)
        .join(offsets, [*group, "_part"])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset", "_part")
    )


def kth(df: DataFrame, identity: str, wanted: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, cut): the identity at the ``wanted`` place (column ``_k``) of each group, by ascending unique identity.

    Only groups and identities are range-partitioned and stored. Counts per partition tell which one holds the
    place, and only rows of that one are ranked.
    """
    keys = [*group, identity]
    placed = shared_checkpoint(df.select(*keys).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    offsets = offsets.join(wanted.select(*group, "_k"), list(group)) if group else offsets.withColumn("_k", wanted.select("_k").scalar())
    holding = offsets.filter((F.col("_offset") < F.col("_k")) & (F.col("_offset") + F.col("_size") >= F.col("_k"))).select(*group, "_part", (F.col("_k") - F.col("_offset")).alias("_at"))
    rows = placed.join(holding, [*group, "_part"]).withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(identity)))
    return rows.filter("_n = _at").select(*group, F.col(identity).alias("_cut"))


def cohort_size(eligible: Column, percent) -> Column:
    """``round_half_up(eligible * percent / 100)`` as a whole number."""
    share = eligible.cast("decimal(20,0)") * F.lit(str(percent)).cast("decimal(9,4)") / F.lit(100).cast("decimal(3,0)")
    return F.round(share.cast("decimal(30,8)"), 0).cast("long")


def percent_cohort(df: DataFrame, identity: str, percent, group: Sequence[str] = ()) -> DataFrame:
    """The first ``round_half_up(n * percent / 100)`` rows of each group by ascending identity.

    Adds the group's eligible count, the unrounded equivalent, the affected count and the effective percent.
    """
    sized = cohort_columns(df.groupBy(*group).agg(F.count("*").alias("eligible_count")), percent)
    cuts = kth(df, identity, sized.withColumn("_k", F.col("affected_count")), group)
    if group:
        return df.join(sized, list(group)).join(cuts, list(group)).filter(F.col(identity) <= F.col("_cut")).drop("_cut")
    return cohort_columns(df.filter(F.col(identity) <= cuts.scalar()).withColumn("eligible_count", sized.select("eligible_count").scalar()), percent)


def cohort_columns(df: DataFrame, percent) -> DataFrame:
    """Affected count, unrounded equivalent and effective percent from ``eligible_count``."""
    n = F.col("eligible_count").cast("decimal(20,0)")
    return (
        df.withColumn("affected_count", cohort_size(F.col("eligible_count"), percent))
        .withColumn("unrounded_equivalent", F.round((n * F.lit(str(percent)).cast("decimal(9,4)") / 100).cast("decimal(30,8)"), 2).cast("decimal(18,2)"))
        .withColumn(
            "effective_percent",
            F.when(n > 0, F.round((F.col("affected_count").cast("decimal(20,0)") * 100 / n).cast("decimal(30,8)"), 2).cast("decimal(18,2)")),
        )
    )


def count_cohort(df: DataFrame, identity: str, count: int) -> DataFrame:
    """The first ``count`` rows by ascending identity; fewer eligible rows is an error, reported when the query runs."""
    eligible = df.agg(F.count("*").alias("n")).scalar()
    enough = F.when(eligible >= count, F.lit(True)).otherwise(F.raise_error(F.lit("requested count exceeds the eligible rows")).cast("boolean"))
    checked = df.filter(enough)
    cut = kth(checked, identity, checked.sparkSession.range(1).select(F.lit(count).alias("_k")))
    return checked.filter(F.col(identity) <= cut.scalar())


def first_per_root(df: DataFrame, root: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per root in order, with a flag telling whether the root has more.

    Spark keeps only ``limit`` + 1 rows per root on the map side before the shuffle, so a root with
    most of the rows does not reach one task whole.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*root).orderBy(*order))).filter(F.col("_rank") <= limit + 1)
    more = F.max("_rank").over(Window.partitionBy(*root)) > limit
    return ranked.withColumn("truncated", more).filter(F.col("_rank") <= limit).drop("_rank")


def bounded_fetch(df: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows in order and whether more exist, from one run over ``limit`` + 1 rows."""
    every = Window.partitionBy(F.lit(0))
    fetched = df.orderBy(*order).limit(limit + 1).withColumn("truncated", F.count("*").over(every) > limit)
    return fetched.withColumn("_rank", F.row_number().over(every.orderBy(*order))).filter(F.col("_rank") <= limit).drop("_rank")


def latest_revision(df: DataFrame, keys: Sequence[str], revision: Sequence[str]) -> DataFrame:
    """The row with the greatest revision per key, combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*revision)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def capped_distinct(pairs: DataFrame, group: Sequence[str], value: str, cap: int) -> DataFrame:
    """Distinct values per group in byte order, at most ``cap`` of them, with the truncation flag."""
    return first_per_root(pairs.select(*group, value).distinct(), group, [value], cap)
