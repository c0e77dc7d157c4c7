"""Workforce queries: customers stand for representative assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import ranking, workforce
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import ASSIGNMENTS, assignments, table, with_sql

HALF_UP = "CAST(floor((2 * n * {p} + 100) / 200) AS BIGINT)"


@query("workforce_count", "SELECT l_suppkey AS vendor_id, count(DISTINCT o_custkey) AS assignment_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def workforce_count(spark, folder):
    """Customers a vendor delivers to stand for the assignments of that vendor."""
    lines = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("o_orderkey"))
    served = lines.join(table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("assignment_id")), "o_orderkey")
    return workforce.assignment_count(served, ["vendor_id"])


@query(
    "workforce_groups",
    with_sql(ASSIGNMENTS) + "SELECT country, worker_type, billable, count(DISTINCT assignment_id) AS assignment_count FROM assignments GROUP BY 1, 2, 3",
)
def workforce_groups(spark, folder):
    return workforce.group_counts(assignments(spark, folder), ["country", "Worker", "billable"], ["country", "worker_type", "billable"], aliases={"Worker": "worker_type"})


@query(
    "workforce_rollup",
    with_sql(ASSIGNMENTS)
    + "SELECT country, worker_type, count(DISTINCT assignment_id) AS assignment_count FROM assignments GROUP BY country, worker_type UNION ALL SELECT NULL, NULL, count(DISTINCT assignment_id) FROM assignments",
)
def workforce_rollup(spark, folder):
    return workforce.rollup_counts(assignments(spark, folder), "country", "worker_type")


@query("billable_split", with_sql(ASSIGNMENTS) + "SELECT country, count(*) FILTER (billable) AS billable, count(*) FILTER (NOT billable) AS shadow, count(*) AS total FROM assignments GROUP BY 1")
def billable_split(spark, folder):
    return workforce.billable_split(assignments(spark, folder), ["country"])


@query("cohort_filter", with_sql(ASSIGNMENTS) + "SELECT assignment_id, country, worker_type FROM assignments WHERE lower(worker_type) = 'building' AND lower(CAST(country AS VARCHAR)) = '3'")
def cohort_filter(spark, folder):
    return workforce.cohort(assignments(spark, folder), {"worker_type": "Building", "country": "3", "billable": None}).select("assignment_id", "country", "worker_type")


@query(
    "cohort_ids",
    with_sql(ASSIGNMENTS, "chosen AS (SELECT DISTINCT o_custkey AS assignment_id FROM orders WHERE o_orderpriority = '1-URGENT')")
    + "SELECT assignment_id, CASE WHEN worker_type = 'BUILDING' THEN 'in_scope' ELSE 'outside' END AS state FROM chosen JOIN assignments USING (assignment_id)",
)
def cohort_ids(spark, folder):
    """Owners of urgent contracts named as an ID list against the building cohort."""
    selected = workforce.cohort(assignments(spark, folder), {"worker_type": "BUILDING"})
    ids = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("assignment_id")).distinct()
    inside, outside = workforce.ids_in_scope(selected, ids, "assignment_id")
    return inside.select("assignment_id", F.lit("in_scope").alias("state")).unionByName(outside.select("assignment_id", F.lit("outside").alias("state")))


_COHORT_COLUMNS = (
    "n AS eligible_count, k AS affected_count, CAST(CAST(round(n * CAST(12.5 AS DECIMAL(9,4)) / 100, 2) AS DECIMAL(18,2)) AS VARCHAR) AS unrounded_equivalent,"
    " CAST(CAST(round(CAST(k * 100 AS DECIMAL(30,8)) / n, 2) AS DECIMAL(18,2)) AS VARCHAR) AS effective_percent"
)


@query(
    "cohort_percent",
    with_sql(
        ASSIGNMENTS, "counts AS (SELECT worker_type, count(*) AS n FROM assignments GROUP BY 1)", "sized AS (SELECT *, CAST(floor((2 * n * 12.5 + 100) / 200) AS BIGINT) AS k FROM counts)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY worker_type ORDER BY assignment_id) AS r FROM assignments JOIN sized USING (worker_type))",
    )
    + f"SELECT worker_type, assignment_id, {_COHORT_COLUMNS} FROM ranked WHERE r <= k",
)
def cohort_percent(spark, folder):
    rows = assignments(spark, folder).select("worker_type", "assignment_id")
    return ranking.percent_cohort(rows, "assignment_id", 12.5, ["worker_type"])


@query("cohort_count", with_sql(ASSIGNMENTS) + "SELECT assignment_id, country FROM assignments WHERE worker_type = 'MACHINERY' ORDER BY assignment_id LIMIT 25")
def cohort_count(spark, folder):
    eligible = workforce.cohort(assignments(spark, folder), {"worker_type": "machinery"}).select("assignment_id", "country")
    return ranking.count_cohort(eligible, "assignment_id", 25)


def _whatif_sql(selected: str, eligible: str, percent: str, target: str | None) -> str:
    removed = "affected" if target is None else "FALSE"
    after_country = "country" if target is None else f"CASE WHEN affected THEN {target} ELSE country END"
    return with_sql(
        ASSIGNMENTS, f"marked AS (SELECT *, {selected} AS selected, {selected} AND {eligible} AS eligible FROM assignments)", "size AS (SELECT CAST(count(*) FILTER (eligible) AS BIGINT) AS n FROM marked)",
        "ranked AS (SELECT m.*, eligible AND row_number() OVER (PARTITION BY eligible ORDER BY assignment_id)"
        f" <= (SELECT CAST(floor((2 * n * {percent} + 100) / 200) AS BIGINT) FROM size) AS affected FROM marked m)",
        f"moves AS (SELECT CAST(country AS VARCHAR) AS country, worker_type, affected, selected, 1 AS b, 0 AS a FROM ranked UNION ALL SELECT CAST({after_country} AS VARCHAR), worker_type, affected, selected, 0, CASE WHEN {removed} THEN 0 ELSE 1 END FROM ranked)",
    ) + (
        "SELECT country, worker_type, CAST(sum(b) AS BIGINT) AS baseline_count, CAST(sum(a) AS BIGINT) AS resulting_count, CAST(sum(CASE WHEN affected THEN b ELSE 0 END) AS BIGINT) AS affected_from,"
        " CAST(sum(CASE WHEN selected THEN b ELSE 0 END) AS BIGINT) AS selected_baseline, CAST(sum(CASE WHEN selected THEN a ELSE 0 END) AS BIGINT) AS selected_resulting FROM moves GROUP BY 1, 2"
    )


@query("whatif_reduce", _whatif_sql("worker_type = 'BUILDING'", "TRUE", "20", None))
def whatif_reduce(spark, folder):
    overlay = workforce.whatif(assignments(spark, folder), "reduce", 20, filters={"worker_type": "building"})
    return workforce.whatif_counts(overlay, {"country": "country", "worker_type": "worker_type"})


@query("whatif_shift", _whatif_sql("worker_type = 'MACHINERY'", "country <> 5", "50", "5"))
def whatif_shift(spark, folder):
    overlay = workforce.whatif(assignments(spark, folder), "shift", 50, filters={"worker_type": "Machinery"}, targets={"country": 5})
    return workforce.whatif_counts(overlay, {"country": "new_country", "worker_type": "worker_type"})


@query("whatif_ids", _whatif_sql("worker_type = 'BUILDING' AND assignment_id % 9 = 0", "TRUE", "60", None))
def whatif_ids(spark, folder):
    """A scenario over a list of assignments."""
    everyone = assignments(spark, folder)
    ids = everyone.filter("assignment_id % 9 = 0 AND worker_type = 'BUILDING'").select("assignment_id")
    overlay = workforce.whatif(everyone, "reduce", 60, filters={"worker_type": "building"}, ids=ids)
    return workforce.whatif_counts(overlay, {"country": "country", "worker_type": "worker_type"})
