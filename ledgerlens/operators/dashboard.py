"""Portfolio dashboard: contract lines, review queue and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import days_until
from ledgerlens.functions.money import CENTS, cents, percent_of
from ledgerlens.functions.service import masked_tier
from ledgerlens.operators.contracts import ATTENTION_DAYS, attention_state

# Tiers that need review and the percent over budget above which spend is reviewed.
HIGH_TIERS = ("High", "Critical")
OVER_BUDGET_PERCENT = 5


def dashboard_contracts(records: DataFrame, terms: DataFrame, as_of, per_vendor: Sequence[DataFrame] = (), contract: str = "contract_id") -> DataFrame:
    """One line per contract with attention state, masked risk, service level and forecast variance.

    Contracts without a renewal clause keep NULL terms. ``per_vendor`` frames (assessments, measurements)
    are joined by vendor after everything that shares the contract key, so that each key is shuffled
    once. Ordered by decision date, else end date.
    """
    joined = records.join(terms.select(contract, "notice_days", "automatic_renewal", F.col("notice_deadline").alias("renewal_decision_date")), contract, "left")
    for frame in per_vendor:
        joined = joined.join(frame, "vendor_id", "left")
    over = F.col("forecast") - F.col("budget")
    usable = F.col("budget").isNotNull() & (F.col("budget") != 0)
    lines = (
        joined.withColumn("days_to_expiry", days_until(F.col("end_date"), as_of))
        .withColumn("days_to_decision", days_until(F.col("renewal_decision_date"), as_of))
        .withColumn("attention", attention_state(F.col("end_date"), F.col("renewal_decision_date"), as_of))
        .withColumn("risk_tier", masked_tier(F.col("risk_status"), F.col("risk_tier")))
        .withColumn("sla_breach", F.coalesce(F.col("sla_breach"), F.lit(False)))
        .withColumn("forecast_variance_amount", F.when(usable, cents(over)))
        .withColumn("forecast_variance_pct", F.when(usable, percent_of(over, F.col("budget"))))
    )
    return lines.orderBy(F.coalesce(F.col("renewal_decision_date"), F.col("end_date")).asc_nulls_last(), contract)


def review_queue(contracts: DataFrame, forecast_label: str = "forecast") -> DataFrame:
    """Why a person should look at a contract: reasons, actions, priority and the first action as headline."""
    c, state = F.col, F.col("attention")
    high = c("risk_tier").isin(*HIGH_TIERS)
    not_current = c("risk_status").isNotNull() & (c("risk_status") != "Current")
    over_budget = c("forecast_variance_pct") > OVER_BUDGET_PERCENT
    # The wording of reasons and of the action each one asks for.
    wording = [
        (state == "past_notice", F.format_string("Renewal notice deadline passed on %s", c("renewal_decision_date").cast("string")), "Confirm the renewal position now that the notice deadline has passed."),
        (state == "notice_due", F.format_string("Renewal decision due %s (%d days)", c("renewal_decision_date").cast("string"), c("days_to_decision")), "Prepare the renewal decision before the notice deadline."),
        (state == "expiring", F.format_string("Contract expires %s (%d days)", c("end_date").cast("string"), c("days_to_expiry")), "Confirm whether the contract should be renewed before it expires."),
        (c("sla_breach"), F.format_string("SLA breach in %s: %s%% against a %s%% target", c("sla_period"), c("sla_actual").cast("string"), c("sla_target").cast("string")), "Start an SLA remediation review."),
        (high, F.format_string("Contract risk tier: %s", c("risk_tier")), "Review the risk position and mitigations."),
        (not_current, F.format_string("Risk assessment is %s", F.lower(c("risk_status"))), "Obtain a current risk assessment; no risk tier is inferred."),
        (over_budget, F.format_string(f"{forecast_label} is %s%% over budget", c("forecast_variance_pct").cast("string")), "Review spend against budget."),
    ]
    urgent = state.isin("past_notice", "expired") | c("sla_breach") | high | (c("risk_status") == "Missing")
    queue = (
        contracts.withColumn("reasons", F.array_compact(F.array(*[F.when(test, reason) for test, reason, _ in wording])))
        .withColumn("actions", F.array_compact(F.array(*[F.when(test, F.lit(action)) for test, _, action in wording])))
        .filter(F.size("reasons") > 0)
        .withColumn("priority", F.when(urgent, "high").otherwise("medium"))
        .withColumn("headline", F.element_at("actions", 1))
    )
    return queue.select("vendor_id", "contract_id", "priority", "reasons", "actions", "headline").orderBy(F.col("priority") != "high", F.size("reasons").desc(), "contract_id")


def dashboard_totals(contracts: DataFrame) -> DataFrame:
    """Portfolio totals in one pass over the contract lines."""
    c = F.col
    money = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast(CENTS).alias(name)
    # Counting vendors by first collapsing to one row each keeps the other totals to a single grouping.
    per_vendor = contracts.groupBy("vendor_id").agg(
        F.count("*").alias("contracts"), *[F.sum(m).alias(m) for m in ("budget", "forecast", "actual_ytd")],
        F.count_if(c("attention") == "past_notice").alias("past_notice"), F.count_if(c("attention") == "notice_due").alias("decisions_due"),
        F.count_if(c("days_to_expiry").between(0, ATTENTION_DAYS)).alias("expiring"), F.count_if(c("risk_tier").isin(*HIGH_TIERS)).alias("high_risk"),
        F.count_if(c("risk_status") == "Missing").alias("missing_assessment"), F.count_if("sla_breach").alias("sla_breaches"),
        F.count_if(c("forecast_variance_pct") > 0).alias("over_budget"),
    )
    counts = ["contracts", "past_notice", "decisions_due", "expiring", "high_risk", "missing_assessment", "sla_breaches", "over_budget"]
    totals = per_vendor.agg(F.count("*").alias("vendors"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts], *[money(m) for m in ("budget", "forecast", "actual_ytd")])
    over = c("forecast") - c("budget")
    return totals.withColumn("forecast_variance_amount", F.when(c("budget") != 0, cents(over))).withColumn("forecast_variance_pct", percent_of(over, c("budget")))
