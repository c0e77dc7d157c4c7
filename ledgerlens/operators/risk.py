"""Service-level, risk and dependency roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import service


def measured(measurements: DataFrame, target: str) -> DataFrame:
    """Attainment, breach, credit percent and credit of every measurement against its contractual target column."""
    actual = service.attainment(F.col("eligible_units"), F.col("failed_units"))
    return (
        measurements.withColumn("actual", actual)
        .withColumn("breach", service.sla_breach(F.col("actual"), F.col(target), F.lit("higher_is_better")))
        .withColumn("credit_percent", service.credit_percent(F.col("actual"), F.col(target)))
        .withColumn("credit", service.service_credit(F.col("fee_basis"), F.col("credit_percent")))
    )


def breach_rollup(measurements: DataFrame, keys: Sequence[str] = ("vendor_id",)) -> DataFrame:
    return measurements.groupBy(*keys).agg(
        service.any_breach(F.col("breach")).alias("has_breach"), F.count_if("breach").alias("breached_measurements"), F.count("*").alias("measurement_count")
    )


def status_rollup(assessments: DataFrame, keys: Sequence[str]) -> DataFrame:
    return assessments.groupBy(*keys).agg(
        service.single_status(F.col("status")).alias("risk_status"), F.count("*").alias("assessment_count"),
        F.bool_or(F.col("status") == "Stale").alias("has_stale"), F.bool_or(F.col("status") == "Missing").alias("has_missing"),
    )


def open_issues(paths: DataFrame, keys: Sequence[str], issue: str = "issue_id", status: str = "status") -> DataFrame:
    """Distinct open issues per key; an issue reached by many paths counts once."""
    return paths.groupBy(*keys).agg(F.countDistinct(F.when(F.col(status) == "Open", F.col(issue))).alias("open_issue_count"))


def dependency_counts(bridge: DataFrame, keys: Sequence[str] = ("vendor_id",), application: str = "application_id", relation: str = "relation") -> DataFrame:
    """Distinct applications in all, supported ones and used portals.

    The triples are first brought to one row per application, so each count is a plain sum.
    """
    per_application = bridge.groupBy(*keys, application).agg(
        F.max((F.col(relation) == "SUPPORTS").cast("long")).alias("_supports"), F.max((F.col(relation) == "USES_PORTAL").cast("long")).alias("_portal")
    )
    return per_application.groupBy(*keys).agg(
        F.count("*").alias("application_count"), F.sum("_supports").alias("supported_application_count"), F.sum("_portal").alias("used_portal_count")
    )


def bridge_mismatch(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Triples found in one source only, with the side that has them."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    joined = a.join(b, list(keys), "full_outer").filter(F.col("_l").isNull() | F.col("_r").isNull())
    return joined.select(*keys, F.when(F.col("_r").isNull(), "graph_only").otherwise("structured_only").alias("side"))


def concentration(bridge: DataFrame, critical: DataFrame, keys: Sequence[str] = ("vendor_id",), application: str = "application_id") -> DataFrame:
    """Share of the portfolio's critical applications that each key supports; portal use does not count."""
    total = critical.agg(F.countDistinct(application).alias("n")).scalar()
    supported = bridge.filter(F.col("relation") == "SUPPORTS").select(*keys, application).join(critical.select(application), application, "left_semi").distinct()
    counted = supported.groupBy(*keys).agg(F.count("*").alias("critical_supported")).withColumn("critical_total", total)
    share = F.col("critical_supported").cast("decimal(18,0)") * 100 / F.col("critical_total").cast("decimal(18,0)")
    return counted.withColumn("percentage", F.when(F.col("critical_total") > 0, F.round(share.cast("decimal(30,10)"), 4).cast("decimal(9,4)")))


def contradictions(observed: DataFrame, certified: DataFrame, key: str, concepts: dict[str, str]) -> DataFrame:
    """Ad-hoc values that disagree with the certified value of the same key.

    ``concepts`` maps columns of both frames to concept names. Trimmed text is compared; empty values
    on either side say nothing.
    """
    def long(df, name):
        values = F.array(*[F.struct(F.lit(concept).alias("concept"), F.trim(F.col(column).cast("string")).alias(name)) for column, concept in concepts.items()])
        return df.select(key, F.inline(values)).filter(F.col(name) != "")

    joined = long(observed, "observed_value").distinct().join(long(certified, "certified_value"), [key, "concept"])
    return joined.filter(F.col("observed_value") != F.col("certified_value"))
