"""Spend queries: line items of one ship year stand for invoice lines of vendors (suppliers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.money import cents, percent_of
from ledgerlens.operators import spend
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import (
    COMPARABLE_MONTHS,
    CONTRACTS,
    FISCAL_YEAR,
    SPEND,
    cents_sql,
    contracts,
    dec,
    money_sql,
    percent_text_sql,
    spend_lines,
    spend_lines_sql,
    table,
    with_sql,
)

MONTHS = spend.MONTHS


def records(spark, folder):
    return spend.scenario_rows(spend_lines(spark, folder), COMPARABLE_MONTHS)


def _records_sql() -> list[str]:
    sums = ", ".join(
        cents_sql(f"sum(CASE WHEN month = {n} THEN {s.lower()} ELSE 0 END)") + f" AS {s}_{m}" for s in spend.SCENARIOS for n, m in enumerate(MONTHS, 1)
    )
    add = lambda s, count: "CAST(" + " + ".join(f"{s}_{m}" for m in MONTHS[:count]) + " AS DECIMAL(18,2))"
    selects = []
    for s in spend.SCENARIOS:
        shown = COMPARABLE_MONTHS if s == "Actual" else 12
        months = ", ".join((f"{s}_{m}" if n <= shown else "CAST(NULL AS DECIMAL(18,2))") + f" AS {m}" for n, m in enumerate(MONTHS, 1))
        fy = add(s, shown) if s != "Actual" else "CAST(NULL AS DECIMAL(18,2))"
        selects.append(
            f"SELECT vendor_id, year, '{s}' AS scenario, {months}, {add(s, shown)} AS amount, {add(s, COMPARABLE_MONTHS)} AS ytd_amount,"
            f" {add('Budget', COMPARABLE_MONTHS)} AS budget_ytd_amount, {fy} AS fy_amount FROM wide"
        )
    return [SPEND, f"wide AS (SELECT vendor_id, year, {sums} FROM spend_lines GROUP BY vendor_id, year)", "records AS (" + " UNION ALL ".join(selects) + ")"]


RECORDS_SQL = _records_sql()
_pick = lambda s, c: f"max(CASE WHEN scenario = '{s}' THEN {c} END)"
FINANCE_SQL = (
    f"finance AS (SELECT vendor_id, year, {_pick('Budget', 'amount')} AS budget, {_pick('Forecast', 'amount')} AS forecast,"
    f" {_pick('Actual', 'amount')} AS actual_ytd, {_pick('Budget', 'ytd_amount')} AS comparable_ytd_budget, {_pick('Forecast', 'ytd_amount')} AS forecast_ytd"
    " FROM records GROUP BY vendor_id, year)"
)
FINANCE_COLUMNS_SQL = (
    "vendor_id, year, CAST(budget AS VARCHAR) AS budget, CAST(forecast AS VARCHAR) AS forecast, CAST(actual_ytd AS VARCHAR) AS actual_ytd,"
    " CAST(comparable_ytd_budget AS VARCHAR) AS comparable_ytd_budget, CAST(forecast_ytd AS VARCHAR) AS forecast_ytd,"
    f" {money_sql('forecast - budget')} AS forecast_variance_amount, {percent_text_sql('(forecast - budget)', 'budget')} AS forecast_variance_pct,"
    f" {money_sql('actual_ytd - comparable_ytd_budget')} AS actual_ytd_variance_amount,"
    f" {percent_text_sql('(actual_ytd - comparable_ytd_budget)', 'comparable_ytd_budget')} AS actual_ytd_variance_pct,"
    " concat_ws(',', CASE WHEN budget IS NULL THEN 'Budget' END, CASE WHEN forecast IS NULL THEN 'Forecast' END,"
    " CASE WHEN actual_ytd IS NULL THEN 'Actual' END) AS missing_scenarios"
)


def finance(spark, folder):
    return spend.budget_forecast_actual(records(spark, folder))


@query("budget_forecast_actual", with_sql(*RECORDS_SQL, FINANCE_SQL) + f"SELECT {FINANCE_COLUMNS_SQL} FROM finance")
def budget_forecast_actual(spark, folder):
    return finance(spark, folder)


@query(
    "ytd_variance",
    with_sql(*RECORDS_SQL, FINANCE_SQL)
    + f"SELECT {FINANCE_COLUMNS_SQL}, {money_sql('actual_ytd - forecast_ytd')} AS actual_vs_forecast_amount,"
    f" {percent_text_sql('(actual_ytd - forecast_ytd)', 'forecast_ytd')} AS actual_vs_forecast_pct FROM finance",
)
def ytd_variance(spark, folder):
    return spend.ytd_variance(finance(spark, folder))


@query(
    "variance",
    with_sql(
        spend_lines_sql(None, "all_lines"),
        "totals AS (SELECT contract_id, CAST(round(sum(budget), 2) AS DECIMAL(18,2)) AS baseline, CAST(round(sum(forecast), 2) AS DECIMAL(18,2)) AS value FROM all_lines GROUP BY 1)",
    )
    + f"SELECT contract_id, CAST(baseline AS VARCHAR) AS baseline, CAST(value AS VARCHAR) AS value, {money_sql('value - baseline')} AS amount,"
    f" {percent_text_sql('(value - baseline)', 'baseline')} AS percent FROM totals",
)
def variance(spark, folder):
    totals = spend_lines(spark, folder, None).groupBy("contract_id").agg(cents(F.sum("budget")).alias("baseline"), cents(F.sum("forecast")).alias("value"))
    delta = F.col("value") - F.col("baseline")
    return totals.select("contract_id", "baseline", "value", cents(delta).alias("amount"), percent_of(delta, F.col("baseline")).alias("percent"))


# -------------------------------------------------------------- reconciliation
def ordered_records(spark, folder):
    """Contract records whose monthly columns come from lines while the stored amount is the order total."""
    lines = spend_lines(spark, folder, None).withColumn("budget", F.col("budget"))
    sums = [cents(F.sum(F.when(F.col("month") == n, F.col("actual")).otherwise(F.lit(0).cast("decimal(18,6)")))).alias(m) for n, m in enumerate(MONTHS, 1)]
    monthly = lines.groupBy("contract_id").agg(*sums)
    total = sum((F.col(m) for m in MONTHS[1:]), F.col(MONTHS[0])).cast("decimal(18,2)")
    ytd = sum((F.col(m) for m in MONTHS[1:COMPARABLE_MONTHS]), F.col(MONTHS[0])).cast("decimal(18,2)")
    head = contracts(spark, folder).select("contract_id", F.col("contract_value").cast("decimal(18,2)").alias("amount"), F.when(F.col("status") == "F", "Actual").otherwise("Forecast").alias("scenario"))
    return monthly.withColumn("fy_amount", total).withColumn("ytd_amount", ytd).join(head, "contract_id")


@query(
    "monthly_reconcile",
    with_sql(
        spend_lines_sql(None, "all_lines"), CONTRACTS,
        "monthly AS (SELECT contract_id, " + ", ".join(cents_sql(f"sum(CASE WHEN month = {n} THEN actual ELSE 0 END)") + f" AS {m}" for n, m in enumerate(MONTHS, 1)) + " FROM all_lines GROUP BY 1)",
        "stored AS (SELECT m.*, CAST(" + " + ".join(MONTHS) + " AS DECIMAL(18,2)) AS fy_amount, CAST(c.contract_value AS DECIMAL(18,2)) AS amount,"
        " CASE WHEN c.status = 'F' THEN 'Actual' ELSE 'Forecast' END AS scenario FROM monthly m JOIN contracts c USING (contract_id))",
    )
    + "SELECT 'months_vs_amount' AS rule, 'financials' AS table_name, CAST(contract_id AS VARCHAR) AS record_key, CAST(amount - fy_amount AS VARCHAR) AS detail FROM stored WHERE fy_amount <> amount"
    " UNION ALL SELECT 'future_actual', 'financials', CAST(contract_id AS VARCHAR), 'future month carries an actual' FROM stored WHERE scenario = 'Actual'"
    " UNION ALL SELECT 'annual_alias', 'financials', CAST(contract_id AS VARCHAR), CAST(fy_amount AS VARCHAR) FROM stored WHERE scenario <> 'Actual' AND fy_amount <> amount",
)
def monthly_reconcile(spark, folder):
    return spend.reconcile_months(ordered_records(spark, folder), COMPARABLE_MONTHS, ["contract_id"])


def forecast_table(spark, folder):
    """A forecast table computed by another path: totals rounded once per vendor instead of once per month."""
    rows = spend_lines(spark, folder)
    ytd = F.when(F.col("month") <= COMPARABLE_MONTHS, F.col("actual")).otherwise(F.lit(0).cast("decimal(18,6)"))
    totals = rows.groupBy("vendor_id", "year").agg(
        cents(F.sum("budget")).alias("budget_total"), cents(F.sum("forecast")).alias("forecast_total"), cents(F.sum(ytd)).alias("actual_total"),
        cents(F.sum(F.when(F.col("month") > COMPARABLE_MONTHS, F.col("forecast")).otherwise(F.lit(0).cast("decimal(18,6)")))).alias("remaining"),
    )
    return totals


FORECAST_TABLE_SQL = (
    f"forecast_table AS (SELECT vendor_id, year, {cents_sql('sum(budget)')} AS budget_total, {cents_sql('sum(forecast)')} AS forecast_total,"
    f" {cents_sql(f'sum(CASE WHEN month <= {COMPARABLE_MONTHS} THEN actual ELSE 0 END)')} AS actual_total,"
    f" {cents_sql(f'sum(CASE WHEN month > {COMPARABLE_MONTHS} THEN forecast ELSE 0 END)')} AS remaining FROM spend_lines GROUP BY 1, 2)"
)
_months8 = MONTHS[:COMPARABLE_MONTHS]


@query(
    "scenario_reconcile",
    with_sql(
        *RECORDS_SQL, FORECAST_TABLE_SQL,
        "checked AS (SELECT w.vendor_id, w.year, " + " + ".join(f"CASE WHEN Forecast_{m} <> Actual_{m} THEN 1 ELSE 0 END" for m in _months8) + " AS unequal,"
        + ", ".join(f" CAST({' + '.join(f'{s}_{m}' for m in (MONTHS if s != 'Actual' else _months8))} AS DECIMAL(18,2)) AS t_{s}" for s in spend.SCENARIOS)
        + ", f.* EXCLUDE (vendor_id, year) FROM wide w JOIN forecast_table f ON w.vendor_id = f.vendor_id AND w.year = f.year)",
    )
    + "SELECT 'forecast_ytd_vs_actual' AS rule, 'forecast' AS table_name, vendor_id || '|' || year AS record_key, CAST(unequal AS VARCHAR) AS detail FROM checked WHERE unequal > 0"
    " UNION ALL SELECT 'remaining_year', 'forecast', vendor_id || '|' || year, CAST(CAST(forecast_total - actual_total - remaining AS DECIMAL(18,2)) AS VARCHAR) FROM checked WHERE actual_total + remaining <> forecast_total"
    + "".join(
        f" UNION ALL SELECT '{s.lower()}_total', 'forecast', vendor_id || '|' || year, CAST(CAST({s.lower()}_total - t_{s} AS DECIMAL(18,2)) AS VARCHAR) FROM checked WHERE t_{s} <> {s.lower()}_total"
        for s in spend.SCENARIOS
    ),
)
def scenario_reconcile(spark, folder):
    return spend.reconcile_scenarios(records(spark, folder), forecast_table(spark, folder), COMPARABLE_MONTHS)


# ------------------------------------------------------------------ analysis
@query(
    "spend_analysis",
    with_sql(
        *RECORDS_SQL, FINANCE_SQL,
        "profile AS (" + " UNION ALL ".join(f"SELECT vendor_id, year, scenario, {n} AS month, {m} AS month_amount FROM records WHERE {m} IS NOT NULL" for n, m in enumerate(MONTHS, 1)) + ")",
        "s AS (SELECT s_suppkey AS vendor_id, s_nationkey AS organization_id FROM supplier)",
    )
    + "SELECT p.vendor_id, p.year, s.organization_id, p.scenario, p.month, CAST(p.month_amount AS VARCHAR) AS month_amount,"
    f" {money_sql('f.actual_ytd - f.forecast_ytd')} AS actual_vs_forecast_amount, {percent_text_sql('(f.actual_ytd - f.forecast_ytd)', 'f.forecast_ytd')} AS actual_vs_forecast_pct"
    " FROM profile p JOIN finance f USING (vendor_id, year) JOIN s USING (vendor_id)",
)
def spend_analysis(spark, folder):
    """Monthly profile per scenario with its vendor's comparable variance and allocation."""
    rows = records(spark, folder)
    totals = spend.ytd_variance(spend.budget_forecast_actual(rows)).select("vendor_id", "year", "actual_vs_forecast_amount", "actual_vs_forecast_pct")
    allocation = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_nationkey").alias("organization_id"))
    return (
        spend.monthly_profile(rows).join(totals, ["vendor_id", "year"]).join(allocation, "vendor_id")
        .select("vendor_id", "year", "organization_id", "scenario", "month", "month_amount", "actual_vs_forecast_amount", "actual_vs_forecast_pct")
    )


@query(
    "posted_spend",
    with_sql(
        f"posted AS (SELECT l.l_suppkey AS vendor_id, o.o_custkey AS owner_id, l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_linestatus = 'F'"
        f" AND l.l_shipdate >= TIMESTAMP '{FISCAL_YEAR}-12-01' AND l.l_shipdate < TIMESTAMP '{FISCAL_YEAR + 1}-01-01')",
        "net AS (SELECT vendor_id, owner_id, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,6)) AS forecast_usd,"
        " CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS actual_usd FROM posted)",
    )
    + f"SELECT vendor_id, owner_id, count(*) AS line_count, {money_sql('sum(actual_usd)')} AS actual_usd, {money_sql('sum(forecast_usd)')} AS forecast_usd,"
    f" {money_sql('sum(actual_usd - forecast_usd)')} AS variance_usd FROM net GROUP BY 1, 2",
)
def posted_spend(spark, folder):
    month = (F.col("l_shipdate") >= F.lit(f"{FISCAL_YEAR}-12-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{FISCAL_YEAR + 1}-01-01").cast("timestamp_ntz"))
    lines = table(spark, folder, "lineitem").filter(month & (F.col("l_linestatus") == "F")).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("vendor_id"), dec("l_extendedprice").cast("decimal(18,6)").alias("forecast_usd"),
        (dec("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - dec("l_discount", 4))).cast("decimal(18,6)").alias("actual_usd"),
    )
    owned = lines.join(table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id")), "o_orderkey")
    return spend.posted_spend(owned.withColumn("variance_usd", F.col("actual_usd") - F.col("forecast_usd")), ["vendor_id", "owner_id"], ["actual_usd", "forecast_usd", "variance_usd"])


@query(
    "commitments",
    "SELECT o_custkey AS vendor_id, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS commitment_count,"
    f" {money_sql('sum(CAST(o_totalprice AS DECIMAL(12,2)))')} AS open_commitment FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2",
)
def commitments(spark, folder):
    open_orders = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "O").select(
        F.col("o_custkey").alias("vendor_id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), dec("o_totalprice").alias("amount")
    )
    return spend.commitments(open_orders, ["vendor_id", "period"], "amount")


@query(
    "driver_attribution",
    with_sql(
        "lines AS (SELECT l_suppkey AS vendor_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price, CAST(l_discount AS DECIMAL(4,2)) AS disc, CAST(l_tax AS DECIMAL(4,2)) AS tax FROM lineitem)",
        "parts AS (SELECT vendor_id, CAST(price * (1 - disc) * (1 + tax) AS DECIMAL(18,6)) AS actual, CAST(price AS DECIMAL(18,6)) AS forecast, CAST(-(price * disc) AS DECIMAL(18,6)) AS rate_mix,"
        " CAST(price * tax AS DECIMAL(18,6)) AS volume_change, CAST(-(price * disc * tax) AS DECIMAL(18,6)) AS scope_change FROM lines)",
    )
    + f"SELECT vendor_id, {money_sql('sum(actual)')} AS actual, {money_sql('sum(forecast)')} AS forecast, {money_sql('sum(actual - forecast)')} AS variance,"
    f" {money_sql('sum(volume_change)')} AS volume_change, {money_sql('sum(rate_mix)')} AS rate_mix, {money_sql('sum(scope_change)')} AS scope_change,"
    f" {money_sql('sum(actual - forecast - volume_change - rate_mix - scope_change)')} AS residual,"
    " count(*) FILTER (actual - forecast - volume_change - rate_mix - scope_change <> 0) AS unreconciled_lines FROM parts GROUP BY 1",
)
def driver_attribution(spark, folder):
    """Tax stands for volume, discount for rate mix, and their product for scope; they add up to the variance of every line."""
    price, disc, tax = dec("l_extendedprice"), dec("l_discount", 4), dec("l_tax", 4)
    one = F.lit(1).cast("decimal(4,2)")
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("vendor_id"), (price * (one - disc) * (one + tax)).cast("decimal(18,6)").alias("actual"), price.cast("decimal(18,6)").alias("forecast"),
        (price * tax).cast("decimal(18,6)").alias("volume_change"), (-(price * disc)).cast("decimal(18,6)").alias("rate_mix"),
        (-(price * disc * tax)).cast("decimal(18,6)").alias("scope_change"),
    )
    return spend.driver_attribution(lines, ["vendor_id"], "actual", "forecast", ["volume_change", "rate_mix", "scope_change"])


@query(
    "saving_scenario",
    with_sql(
        spend_lines_sql(None, "all_lines"),
        f"base AS (SELECT vendor_id, {cents_sql('sum(actual)')} AS baseline FROM all_lines GROUP BY 1)",
        f"gross AS (SELECT *, {cents_sql('baseline * CAST(25 AS DECIMAL(9,4)) * 0.01')} AS gross_saving FROM base)",
        f"parts AS (SELECT *, {cents_sql('gross_saving * 0.1')} AS transition_cost, {cents_sql('gross_saving * 0.05')} AS retained_cost FROM gross)",
    )
    + "SELECT vendor_id, CAST(baseline AS VARCHAR) AS baseline, CAST(gross_saving AS VARCHAR) AS gross_saving, CAST(transition_cost AS VARCHAR) AS transition_cost,"
    " CAST(retained_cost AS VARCHAR) AS retained_cost, CAST(CAST(gross_saving - transition_cost - retained_cost AS DECIMAL(18,2)) AS VARCHAR) AS net_saving,"
    " CAST(CAST(baseline - (gross_saving - transition_cost - retained_cost) AS DECIMAL(18,2)) AS VARCHAR) AS modelled_cost FROM parts",
)
def saving_scenario(spark, folder):
    baseline = spend_lines(spark, folder, None).groupBy("vendor_id").agg(cents(F.sum("actual")).alias("baseline"))
    return spend.saving_scenario(baseline, "baseline", 25, 10, 5)


@query(
    "portfolio_forecast",
    with_sql(*RECORDS_SQL, FINANCE_SQL) + "SELECT vendor_id, year, CAST(budget AS VARCHAR) AS budget, CAST(forecast AS VARCHAR) AS forecast, CAST(actual_ytd AS VARCHAR) AS actual_ytd FROM finance",
)
def portfolio_forecast(spark, folder):
    rows = finance(spark, folder).select("vendor_id", "year", "budget", "forecast", "actual_ytd", F.lit("narrative").alias("scenario_note"), F.lit("lineitem").alias("_source"))
    return spend.portfolio_records(rows, drop=["scenario_note"], order=["vendor_id", "year"])
