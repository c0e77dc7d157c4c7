"""Movement between two periods: contribution by hierarchy, material contributors, residual, comparability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default weights of the priority score and the explained-ratio bands.
WEIGHTS = {"materiality": 0.40, "temporal_relevance": 0.20, "data_reliability": 0.15, "semantic_relevance": 0.15, "anomaly_severity": 0.10}
EXPLAINED, QUALIFIED = 0.90, 0.70


def contribution(current: DataFrame, prior: DataFrame, hierarchy: Sequence[str], value: str) -> DataFrame:
    """Movement and its ratio to the total movement, at every level of the hierarchy.

    Both periods are reduced to the leaf first; the roll-up then works on leaves, not on facts.
    """
    levels = list(hierarchy)
    leaf = lambda df, name: df.groupBy(*levels).agg(F.sum(value).alias(name))
    both = leaf(current, "_c").join(leaf(prior, "_p"), levels, "full_outer").select(*levels, F.coalesce("_c", F.lit(0)).alias("_c"), F.coalesce("_p", F.lit(0)).alias("_p"))
    total = both.agg(F.abs(F.sum(F.col("_c") - F.col("_p"))).cast("double").alias("t")).scalar()
    rolled = both.rollup(*levels).agg(F.grouping_id().alias("_g"), F.sum("_c").alias("current_value"), F.sum("_p").alias("prior_value"))
    depth = F.coalesce(*[F.when(F.col("_g") == 2 ** (len(levels) - i) - 1, F.lit(level)) for i, level in enumerate(["total", *levels])])
    moved = rolled.withColumn("movement", F.col("current_value") - F.col("prior_value"))
    return moved.select(depth.alias("level"), *levels, "current_value", "prior_value", "movement", F.round(F.try_divide(F.abs("movement").cast("double"), total), 6).alias("contribution_ratio"))


def priority_score(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the five factor columns."""
    return F.round(sum((F.lit(w) * F.col(c) for c, w in list(weights.items())[1:]), F.lit(list(weights.values())[0]) * F.col(list(weights)[0])), 6)


def material_contributors(rows: DataFrame, key: str, minimum_ratio: float = 0.05, top: int = 10, override: str = "control_failure") -> DataFrame:
    """The ``top`` material rows by score, and every row that an override retains whatever its ratio."""
    scored = rows.withColumn("priority_score", priority_score())
    best = scored.filter(F.col("contribution_ratio") >= minimum_ratio).orderBy(F.col("priority_score").desc(), key).limit(top)
    retained = scored.filter(F.col(override)).join(best.select(key), key, "left_anti")
    return best.withColumn("state", F.lit("active")).unionByName(retained.withColumn("state", F.lit("retained")).select(*best.columns, "state"))


def residual(rows: DataFrame, group: str, minimum_ratio: float) -> DataFrame:
    """Explained movement and residual per group from the parts that reach the ratio within their group."""
    observed = rows.groupBy(group).agg(F.sum("movement").alias("observed_movement"))
    parts = rows.join(observed, group).withColumn("share", F.try_divide(F.abs("movement").cast("double"), F.abs("observed_movement").cast("double")))
    explained = parts.groupBy(group).agg(F.max("observed_movement").alias("observed_movement"), F.coalesce(F.sum(F.when(F.col("share") >= minimum_ratio, F.col("movement"))), F.lit(0)).alias("explained_movement"))
    ratio = F.round(F.try_divide(F.abs("explained_movement").cast("double"), F.abs("observed_movement").cast("double")), 6)
    band = F.when(F.col("explained_ratio") >= EXPLAINED, "conclude").when(F.col("explained_ratio") >= QUALIFIED, "qualified").otherwise("expand")
    return explained.withColumn("residual", F.col("observed_movement") - F.col("explained_movement")).withColumn("explained_ratio", ratio).withColumn("band", band)


def comparability(current: DataFrame, prior: DataFrame, key: Sequence[str], attributes: dict[str, float | None]) -> DataFrame:
    """Per key and attribute, whether two runs agree: exactly, or within a relative tolerance where one is given."""
    a = current.select(*key, *[F.col(c).alias(f"c_{c}") for c in attributes])
    b = prior.select(*key, *[F.col(c).alias(f"p_{c}") for c in attributes])

    def agrees(column, tolerance):
        c, p = F.col(f"c_{column}"), F.col(f"p_{column}")
        if tolerance is None:
            return c.eqNullSafe(p)
        return F.coalesce(F.abs(c - p).cast("double") <= F.abs(p).cast("double") * tolerance, F.lit(False))

    checks = F.array(
        *[F.struct(F.lit(c).alias("attribute"), F.col(f"c_{c}").cast("string").alias("current_value"), F.col(f"p_{c}").cast("string").alias("prior_value"), agrees(c, t).alias("comparable")) for c, t in attributes.items()]
    )
    return a.join(b, list(key), "full_outer").select(*key, F.inline(checks))
