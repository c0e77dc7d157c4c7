"""Whole-portfolio vendor view, renewal flags and evidence status.

Every input is already at vendor grain; the view only joins, so no amount is ever multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import days_until

# A limitation whose code contains one of these words is an evidence gap.
GAP_WORDS = ("missing", "unavailable", "truncated", "mismatch", "unresolved", "limit", "unknown", "not_found")


def is_gap(code: Column) -> Column:
    return code.rlike("|".join(GAP_WORDS))


def evidence_status(limitations: DataFrame, keys=("vendor_id",), code: str = "code") -> DataFrame:
    """Gap codes per key and the retrieval status. Codes come from a fixed vocabulary, so the set stays small."""
    gaps = F.array_sort(F.collect_set(F.when(is_gap(F.col(code)), F.col(code))))
    return limitations.groupBy(*keys).agg(gaps.alias("gap_codes")).withColumn("retrieval_status", F.when(F.size("gap_codes") > 0, "incomplete").otherwise("no_reported_gaps"))


def vendor_360(identity: DataFrame, sections: Sequence[DataFrame], as_of, key: str = "vendor_id") -> DataFrame:
    """One row per vendor with every section; an absent section stays NULL and becomes a gap code.

    Sections bring contract dates, finance, workforce, dependencies, service levels and risk. Sources that
    share a computation can bring several of them in one frame.
    """
    view = identity
    for section in sections:
        view = view.join(section, key, "left")
    view = view.withColumn("days_to_expiry", days_until(F.col("end_date"), as_of))
    gaps = F.array_compact(
        F.array(
            F.when(F.col("application_count").isNull(), "graph_unavailable"),
            F.when(F.col("budget").isNull() | F.col("forecast").isNull() | F.col("actual_ytd").isNull(), "missing_scenario"),
            F.when(F.coalesce(F.col("assignment_count"), F.lit(0)) == 0, "missing_workforce"),
            F.when(F.coalesce(F.col("has_missing"), F.lit(False)), "risk_missing"),
            F.when(F.col("assessment_count").isNull(), "risk_unavailable"),
            F.when(F.col("measurement_count").isNull(), "sla_unavailable"),
            F.when(F.col("measurement_count").isNotNull() & F.col("has_breach").isNull(), "sla_unknown"),
        )
    )
    return view.withColumn("gap_codes", gaps).withColumn("retrieval_status", F.when(F.size("gap_codes") > 0, "incomplete").otherwise("no_reported_gaps"))


def renewal_flags(view: DataFrame, days: int, high_variance_pct: str | None = None, high_dependency_count: int | None = None, key: str = "vendor_id") -> DataFrame:
    """Review flags as rows. Thresholds are the caller's; a threshold that is not given raises no flag."""
    flags = [("EXPIRING_SOON", F.col("days_to_expiry").between(0, days), F.col("days_to_expiry"))]
    if high_variance_pct is not None:
        flags.append(("HIGH_FORECAST_VARIANCE", F.col("forecast_variance_pct") > F.lit(high_variance_pct).cast("decimal(18,4)"), F.col("forecast_variance_pct")))
    if high_dependency_count is not None:
        flags.append(("HIGH_DEPENDENCY", F.col("application_count") >= high_dependency_count, F.col("application_count")))
    flags += [
        ("SLA_BREACH", F.col("has_breach"), F.lit("true")),
        ("STALE_RISK", F.col("has_stale"), F.lit("Stale")),
        ("MISSING_RISK", F.col("has_missing"), F.lit("Missing")),
        ("INCOMPLETE_EVIDENCE", F.col("retrieval_status") == "incomplete", F.array_join("gap_codes", ",")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(code).alias("flag"), seen.cast("string").alias("observed"))) for code, test, seen in flags]))
    return view.select(key, "end_date", F.inline(found))


def renewal_priorities(view: DataFrame, days: int, high_variance_pct: str | None = None, high_dependency_count: int | None = None, key: str = "vendor_id") -> DataFrame:
    """Flags of the vendors that expire within the window, by end date and then identity; no weighted score."""
    return renewal_flags(view.filter(F.col("days_to_expiry").between(0, days)), days, high_variance_pct, high_dependency_count, key).orderBy("end_date", key)
