"""Budget, forecast and actual spend: scenario tables, variances, reconciliation and attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import CENTS, cents, percent_of
from ledgerlens.operators.quality import row_rules

SCENARIOS = ("Budget", "Forecast", "Actual")
MONTHS = tuple(f"m{n:02d}" for n in range(1, 13))


def scenario_rows(lines: DataFrame, comparable: int, vendor: str = "vendor_id") -> DataFrame:
    """Line amounts to one row per vendor, year and scenario with twelve monthly columns.

    One shuffle: all months and scenarios are conditional sums over the same grouping. Actual carries
    only the comparable months; Budget and Forecast the whole year.
    """
    sums = [
        cents(F.sum(F.when(F.col("month") == n, F.col(s.lower())).otherwise(F.lit(0).cast("decimal(18,6)")))).alias(f"{s}_{m}")
        for s in SCENARIOS
        for n, m in enumerate(MONTHS, 1)
    ]
    wide = lines.groupBy(vendor, "year").agg(*sums)

    def total(scenario, count):
        return sum((F.col(f"{scenario}_{m}") for m in MONTHS[1:count]), F.col(f"{scenario}_{MONTHS[0]}")).cast(CENTS)

    rows = []
    for s in SCENARIOS:
        shown = comparable if s == "Actual" else 12
        months = [(F.col(f"{s}_{m}") if n <= shown else F.lit(None).cast(CENTS)).alias(m) for n, m in enumerate(MONTHS, 1)]
        rows.append(
            F.struct(
                F.lit(s).alias("scenario"), *months, total(s, shown).alias("amount"), total(s, comparable).alias("ytd_amount"),
                total("Budget", comparable).alias("budget_ytd_amount"), total(s, shown).alias("fy_amount") if s != "Actual" else F.lit(None).cast(CENTS).alias("fy_amount"),
            )
        )
    return wide.select(vendor, "year", F.inline(F.array(*rows)))


def budget_forecast_actual(records: DataFrame, keys: Sequence[str] = ("vendor_id", "year")) -> DataFrame:
    """Pivot scenario rows to one row per vendor and year with variances.

    A scenario that is absent stays NULL and is named in ``missing_scenarios``; nothing is substituted.
    """
    def pick(scenario, column):
        return F.max(F.when(F.col("scenario") == scenario, F.col(column)))

    wide = records.groupBy(*keys).agg(
        pick("Budget", "amount").alias("budget"), pick("Forecast", "amount").alias("forecast"), pick("Actual", "amount").alias("actual_ytd"),
        pick("Budget", "ytd_amount").alias("comparable_ytd_budget"), pick("Forecast", "ytd_amount").alias("forecast_ytd"),
    )
    missing = F.concat_ws(
        ",", F.when(F.col("budget").isNull(), "Budget"), F.when(F.col("forecast").isNull(), "Forecast"), F.when(F.col("actual_ytd").isNull(), "Actual")
    )
    return wide.select(
        *keys, "budget", "forecast", "actual_ytd", "comparable_ytd_budget", "forecast_ytd",
        cents(F.col("forecast") - F.col("budget")).alias("forecast_variance_amount"),
        percent_of(F.col("forecast") - F.col("budget"), F.col("budget")).alias("forecast_variance_pct"),
        cents(F.col("actual_ytd") - F.col("comparable_ytd_budget")).alias("actual_ytd_variance_amount"),
        percent_of(F.col("actual_ytd") - F.col("comparable_ytd_budget"), F.col("comparable_ytd_budget")).alias("actual_ytd_variance_pct"),
        missing.alias("missing_scenarios"),
    )


def ytd_variance(finance: DataFrame) -> DataFrame:
    """Add actual against comparable forecast to the pivoted table."""
    delta = F.col("actual_ytd") - F.col("forecast_ytd")
    return finance.withColumn("actual_vs_forecast_amount", cents(delta)).withColumn("actual_vs_forecast_pct", percent_of(delta, F.col("forecast_ytd")))


def monthly_profile(records: DataFrame, keys: Sequence[str] = ("vendor_id", "year", "scenario")) -> DataFrame:
    """Twelve monthly columns to (month, amount) rows; absent months give no row."""
    pairs = F.array(*[F.struct(F.lit(n).alias("month"), F.col(m).alias("month_amount")) for n, m in enumerate(MONTHS, 1)])
    return records.select(*keys, F.inline(pairs)).filter("month_amount IS NOT NULL")


def reconcile_months(records: DataFrame, comparable: int, key: Sequence[str] = ("vendor_id", "year", "scenario")) -> DataFrame:
    """Violations of: non-negative months, months add up to the amount and to year-to-date, no future actuals, annual alias."""
    values = [F.coalesce(F.col(m), F.lit(0).cast(CENTS)) for m in MONTHS]
    total = sum(values[1:], values[0])
    ytd = sum(values[1:comparable], values[0])
    future = F.coalesce(*[F.col(m) for m in MONTHS[comparable:]], F.col("fy_amount")).isNotNull()
    actual = F.col("scenario") == "Actual"
    return row_rules(
        records, "financials", key,
        {
            "negative_month": (F.least(*values) < 0, F.least(*values)),
            "months_vs_amount": (total != F.col("amount"), F.col("amount") - total),
            "months_vs_ytd": (ytd != F.col("ytd_amount"), F.col("ytd_amount") - ytd),
            "future_actual": (actual & future, F.lit("future month carries an actual")),
            "annual_alias": (~actual & ~F.col("fy_amount").eqNullSafe(F.col("amount")), F.col("fy_amount")),
        },
    )


def reconcile_scenarios(records: DataFrame, forecast: DataFrame, comparable: int) -> DataFrame:
    """Cross-scenario checks per vendor and year against an independent forecast table.

    ``forecast`` has vendor_id, year, budget_total, forecast_total, actual_total and remaining.
    """
    months = MONTHS[:comparable]
    pick = lambda s, c: F.max(F.when(F.col("scenario") == s, F.col(c)))
    wide = records.groupBy("vendor_id", "year").agg(
        F.min("budget_ytd_amount").alias("ytd_low"), F.max("budget_ytd_amount").alias("ytd_high"), pick("Budget", "ytd_amount").alias("budget_ytd"),
        *[pick(s, "amount").alias(s.lower()) for s in SCENARIOS],
        *[pick(s, m).alias(f"{s}_{m}") for s in ("Forecast", "Actual") for m in months],
    )
    joined = wide.join(forecast, ["vendor_id", "year"], "left")
    unequal = sum((F.when(F.col(f"Forecast_{m}") != F.col(f"Actual_{m}"), 1).otherwise(0) for m in months[1:]),
                  F.when(F.col(f"Forecast_{months[0]}") != F.col(f"Actual_{months[0]}"), 1).otherwise(0))
    rules = {
        "comparable_budget": ((F.col("ytd_low") != F.col("budget_ytd")) | (F.col("ytd_high") != F.col("budget_ytd")), F.col("budget_ytd")),
        "forecast_ytd_vs_actual": (unequal > 0, unequal),
        "remaining_year": (F.col("actual_total") + F.col("remaining") != F.col("forecast_total"), F.col("forecast_total") - F.col("actual_total") - F.col("remaining")),
    }
    for s in SCENARIOS:
        name = s.lower()
        rules[f"{name}_total"] = (F.col(name) != F.col(f"{name}_total"), F.col(f"{name}_total") - F.col(name))
    return row_rules(joined, "forecast", ["vendor_id", "year"], rules)


def posted_spend(lines: DataFrame, keys: Sequence[str], amounts: Sequence[str]) -> DataFrame:
    """Posted lines per key: line count and one sum per amount; equal lines are separate records."""
    return lines.groupBy(*keys).agg(F.count("*").alias("line_count"), *[cents(F.sum(a)).alias(a) for a in amounts])


def commitments(orders: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Open commitments, kept apart from posted actuals."""
    return orders.groupBy(*keys).agg(F.count("*").alias("commitment_count"), cents(F.sum(amount)).alias("open_commitment"))


def driver_attribution(lines: DataFrame, keys: Sequence[str], actual: str, forecast: str, drivers: Sequence[str]) -> DataFrame:
    """Actual minus forecast per key with its drivers; the residual and the unreconciled line count must be zero."""
    parts = sum((F.col(d) for d in drivers[1:]), F.col(drivers[0]))
    residual = F.col(actual) - F.col(forecast) - parts
    return lines.groupBy(*keys).agg(
        cents(F.sum(actual)).alias("actual"), cents(F.sum(forecast)).alias("forecast"), cents(F.sum(F.col(actual) - F.col(forecast))).alias("variance"),
        *[cents(F.sum(d)).alias(d) for d in drivers], cents(F.sum(residual)).alias("residual"), F.count_if(residual != 0).alias("unreconciled_lines"),
    )


def saving_scenario(baseline: DataFrame, amount: str, scope_percent, transition_percent, retained_percent) -> DataFrame:
    """Hypothetical saving: scope of the baseline, less transition and retained cost given as percent of the gross."""
    share = lambda column, pct: cents(column * F.lit(str(pct)).cast("decimal(9,4)") / F.lit(100).cast("decimal(3,0)"))
    return (
        baseline.withColumn("gross_saving", share(F.col(amount), scope_percent))
        .withColumn("transition_cost", share(F.col("gross_saving"), transition_percent))
        .withColumn("retained_cost", share(F.col("gross_saving"), retained_percent))
        .withColumn("net_saving", cents(F.col("gross_saving") - F.col("transition_cost") - F.col("retained_cost")))
        .withColumn("modelled_cost", cents(F.col(amount) - F.col("net_saving")))
    )


def portfolio_records(records: DataFrame, drop: Sequence[str] = (), order: Sequence[str] = ("vendor_id", "contract_id")) -> DataFrame:
    """Every forecast record without lineage and narrative columns, in order."""
    hidden = [c for c in records.columns if c.startswith("_")] + list(drop)
    return records.drop(*hidden).orderBy(*order)
