"""Movement queries: net spend of two ship years over region, nation and vendor."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import movement
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import FISCAL_YEAR, spend_lines, spend_lines_sql, table, with_sql

LEVELS = ["region", "nation", "vendor_id"]


def leaves(spark, folder, year):
    """Vendor totals of one year with their place in the hierarchy."""
    totals = spend_lines(spark, folder, year).groupBy("vendor_id").agg(F.sum("actual").cast("decimal(20,6)").alias("actual"))
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("vendor_id"), "s_nationkey")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return totals.join(supplier, "vendor_id").join(nation, "s_nationkey").join(region, "n_regionkey").select(*LEVELS, "actual")


def _leaf_sql(year: int, name: str) -> str:
    return f"{name} AS (SELECT r_name AS region, n_name AS nation, vendor_id, sum(actual) AS actual FROM {name}_lines JOIN supplier ON s_suppkey = vendor_id JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3)"


LEAVES = [
    spend_lines_sql(FISCAL_YEAR, "c_lines"), spend_lines_sql(FISCAL_YEAR - 1, "p_lines"), _leaf_sql(FISCAL_YEAR, "c"), _leaf_sql(FISCAL_YEAR - 1, "p"),
    "both_years AS (SELECT coalesce(c.region, p.region) AS region, coalesce(c.nation, p.nation) AS nation, coalesce(c.vendor_id, p.vendor_id) AS vendor_id, coalesce(c.actual, 0) AS cv, coalesce(p.actual, 0) AS pv FROM c FULL OUTER JOIN p ON c.vendor_id = p.vendor_id)",
    "rolled AS (SELECT CASE grouping_id(region, nation, vendor_id) WHEN 7 THEN 'total' WHEN 3 THEN 'region' WHEN 1 THEN 'nation' ELSE 'vendor_id' END AS level, region, nation, vendor_id, sum(cv) AS cv, sum(pv) AS pv FROM both_years GROUP BY ROLLUP (region, nation, vendor_id))",
    "contrib AS (SELECT level, region, nation, vendor_id, cv, pv, cv - pv AS movement, round(CAST(abs(cv - pv) AS DOUBLE) / (SELECT CAST(abs(sum(cv) - sum(pv)) AS DOUBLE) FROM both_years), 6) AS contribution_ratio FROM rolled)",
]
_D6 = "CAST(CAST({} AS DECIMAL(24,6)) AS VARCHAR)"


def contributions(spark, folder):
    rows = movement.contribution(leaves(spark, folder, FISCAL_YEAR), leaves(spark, folder, FISCAL_YEAR - 1), LEVELS, "actual")
    return rows.select("level", *LEVELS, *[F.col(c).cast("decimal(24,6)").alias(c) for c in ("current_value", "prior_value", "movement")], "contribution_ratio")


@query("contribution", with_sql(*LEAVES) + f"SELECT level, region, nation, vendor_id, {_D6.format('cv')} AS current_value, {_D6.format('pv')} AS prior_value, {_D6.format('movement')} AS movement, contribution_ratio FROM contrib")
def contribution(spark, folder):
    return contributions(spark, folder)


@query(
    "top_contributors",
    with_sql(
        *LEAVES,
        "factors AS (SELECT vendor_id, movement, contribution_ratio, least(contribution_ratio, 1.0) AS materiality, CASE WHEN movement > 0 THEN 1.0 ELSE 0.5 END AS temporal_relevance, CASE WHEN s_acctbal < 0 THEN 0.5 ELSE 0.9 END AS data_reliability, CASE WHEN s_nationkey % 2 = 0 THEN 0.75 ELSE 0.25 END AS semantic_relevance,"
        " CASE WHEN s_acctbal > 9000 THEN 1.0 ELSE 0.0 END AS anomaly_severity, s_acctbal < 0 AS control_failure FROM contrib JOIN supplier ON s_suppkey = vendor_id WHERE level = 'vendor_id')",
        "scored AS (SELECT *, round(0.4::DOUBLE * materiality + 0.2::DOUBLE * temporal_relevance + 0.15::DOUBLE * data_reliability + 0.15::DOUBLE * semantic_relevance + 0.1::DOUBLE * anomaly_severity, 6) AS priority_score FROM factors)",
        "best AS (SELECT * FROM scored WHERE contribution_ratio >= 0.05 ORDER BY priority_score DESC, vendor_id LIMIT 10)",
    )
    + "SELECT vendor_id, contribution_ratio, priority_score, 'active' AS state FROM best UNION ALL SELECT vendor_id, contribution_ratio, priority_score, 'retained' FROM scored WHERE control_failure AND vendor_id NOT IN (SELECT vendor_id FROM best)",
)
def top_contributors(spark, folder):
    """Vendor rows scored by five factors; a negative balance stands for a control failure that retains a branch."""
    rows = contributions(spark, folder).filter("level = 'vendor_id'").select("vendor_id", "movement", "contribution_ratio")
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("vendor_id"), "s_acctbal", "s_nationkey")
    factors = rows.join(supplier, "vendor_id").select(
        "vendor_id", "contribution_ratio", F.least("contribution_ratio", F.lit(1.0)).alias("materiality"), F.when(F.col("movement") > 0, 1.0).otherwise(0.5).alias("temporal_relevance"),
        F.when(F.col("s_acctbal") < 0, 0.5).otherwise(0.9).alias("data_reliability"), F.when(F.col("s_nationkey") % 2 == 0, 0.75).otherwise(0.25).alias("semantic_relevance"),
        F.when(F.col("s_acctbal") > 9000, 1.0).otherwise(0.0).alias("anomaly_severity"), (F.col("s_acctbal") < 0).alias("control_failure"),
    )
    return movement.material_contributors(factors, "vendor_id").select("vendor_id", "contribution_ratio", "priority_score", "state")


@query(
    "movement_residual",
    with_sql(
        *LEAVES, "n AS (SELECT region, movement FROM contrib WHERE level = 'nation')", "o AS (SELECT region, sum(movement) AS observed FROM n GROUP BY 1)",
        "x AS (SELECT region, max(observed) AS observed, coalesce(sum(CASE WHEN CAST(abs(movement) AS DOUBLE) / CAST(abs(observed) AS DOUBLE) >= 0.2 THEN movement END), 0) AS explained FROM n JOIN o USING (region) GROUP BY 1)",
        "r AS (SELECT *, round(CAST(abs(explained) AS DOUBLE) / CAST(abs(observed) AS DOUBLE), 6) AS explained_ratio FROM x)",
    )
    + f"SELECT region, {_D6.format('observed')} AS observed_movement, {_D6.format('explained')} AS explained_movement, {_D6.format('observed - explained')} AS residual, explained_ratio, CASE WHEN explained_ratio >= 0.9 THEN 'conclude' WHEN explained_ratio >= 0.7 THEN 'qualified' ELSE 'expand' END AS band FROM r",
)
def movement_residual(spark, folder):
    rows = contributions(spark, folder).filter("level = 'nation'").select("region", "movement")
    found = movement.residual(rows, "region", 0.2)
    return found.select("region", *[F.col(c).cast("decimal(24,6)").alias(c) for c in ("observed_movement", "explained_movement", "residual")], "explained_ratio", "band")


def _run_sql(year: int, name: str) -> str:
    return (
        f"{name} AS (SELECT l_suppkey AS vendor_id, count(*) AS position_count, count(*) FILTER (l_linestatus = 'F') > 0 AS complete, max(l_linestatus) AS run_status FROM lineitem"
        f" WHERE l_shipdate >= TIMESTAMP '{year}-01-01' AND l_shipdate < TIMESTAMP '{year + 1}-01-01' GROUP BY 1)"
    )


@query(
    "comparability",
    with_sql(_run_sql(FISCAL_YEAR, "c"), _run_sql(FISCAL_YEAR - 1, "p"), "j AS (SELECT coalesce(c.vendor_id, p.vendor_id) AS vendor_id, c.position_count AS cp, p.position_count AS pp, c.complete AS cc, p.complete AS pc, c.run_status AS cs, p.run_status AS ps FROM c FULL OUTER JOIN p ON c.vendor_id = p.vendor_id)")
    + "SELECT vendor_id, 'position_count' AS attribute, CAST(cp AS VARCHAR) AS current_value, CAST(pp AS VARCHAR) AS prior_value, coalesce(abs(cp - pp) <= pp * 0.1::DOUBLE, FALSE) AS comparable FROM j"
    " UNION ALL SELECT vendor_id, 'complete', CAST(cc AS VARCHAR), CAST(pc AS VARCHAR), cc IS NOT DISTINCT FROM pc FROM j UNION ALL SELECT vendor_id, 'run_status', cs, ps, cs IS NOT DISTINCT FROM ps FROM j",
)
def comparability(spark, folder):
    def run(year):
        lines = table(spark, folder, "lineitem").filter((F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))
        return lines.groupBy(F.col("l_suppkey").alias("vendor_id")).agg(F.count("*").alias("position_count"), (F.count_if(F.col("l_linestatus") == "F") > 0).alias("complete"), F.max("l_linestatus").alias("run_status"))

    return movement.comparability(run(FISCAL_YEAR), run(FISCAL_YEAR - 1), ["vendor_id"], {"position_count": 0.1, "complete": None, "run_status": None})
