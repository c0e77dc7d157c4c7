"""The portfolio roles played by the test tables, as DataFrames and as SQL.

Money columns are cast to decimals before any arithmetic. Every role selects only the columns it
needs, so that the Parquet readers prune the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FISCAL_YEAR = 2000
COMPARABLE_MONTHS = 8
AS_OF = "2001-06-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dec(column: str, precision: int = 12):
    return F.col(column).cast(f"decimal({precision},2)")


# --------------------------------------------------------------------- vendors
def vendors(spark, folder):
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"), F.col("s_nationkey").alias("organization_id")
    )


VENDORS = "vendors AS (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, s_nationkey AS organization_id FROM supplier)"


# ------------------------------------------------------------------- contracts
def contracts(spark, folder):
    """One row per contract: the order, its owner, value and end date."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("contract_id"), F.col("o_custkey").alias("vendor_id"), dec("o_totalprice").alias("contract_value"),
        F.col("o_orderdate").cast("date").alias("end_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


CONTRACTS = (
    "contracts AS (SELECT o_orderkey AS contract_id, o_custkey AS vendor_id, CAST(o_totalprice AS DECIMAL(12,2)) AS contract_value,"
    " CAST(o_orderdate AS DATE) AS end_date, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"
)

# Days of notice by priority class of a contract; classes not listed carry no renewal clause.
NOTICE_DAYS = {"1-URGENT": 30, "2-HIGH": 60, "3-MEDIUM": 90}


def renewal_terms(spark, folder):
    """Renewal clauses: notice days, deadline and automatic renewal, only for contracts that have the clause."""
    days = F.create_map(*[F.lit(v) for pair in NOTICE_DAYS.items() for v in pair])
    return (
        contracts(spark, folder)
        .filter(F.col("priority").isin(*NOTICE_DAYS))
        .withColumn("notice_days", days[F.col("priority")])
        .select(
            "contract_id", F.lit("RenewalClause").alias("clause_class"), "notice_days",
            F.date_sub("end_date", F.col("notice_days")).alias("notice_deadline"), (F.col("status") == "O").alias("automatic_renewal"),
        )
    )


RENEWAL_TERMS = (
    "renewal_terms AS (SELECT contract_id, 'RenewalClause' AS clause_class, notice_days, end_date - notice_days AS notice_deadline,"
    " status = 'O' AS automatic_renewal FROM (SELECT *, CASE priority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 60 WHEN '3-MEDIUM' THEN 90 END"
    " AS notice_days FROM contracts) WHERE notice_days IS NOT NULL)"
)


# ----------------------------------------------------------------------- spend
def spend_lines(spark, folder, year: int | None = FISCAL_YEAR):
    """Invoice-line grain: vendor, contract, product key, month and the three scenario amounts."""
    lines = table(spark, folder, "lineitem")
    if year is not None:
        lines = lines.filter(
            (F.col("l_shipdate") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz"))
        )
    net = dec("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - dec("l_discount", 4))
    return lines.select(
        F.col("l_suppkey").alias("vendor_id"), F.col("l_orderkey").alias("contract_id"), F.col("l_partkey").alias("application_id"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        dec("l_extendedprice").cast("decimal(18,6)").alias("budget"), net.cast("decimal(18,6)").alias("actual"),
        (net * (F.lit(1).cast("decimal(4,2)") + dec("l_tax", 4))).cast("decimal(18,6)").alias("forecast"),
    )


def spend_lines_sql(year: int | None = FISCAL_YEAR, name: str = "spend_lines") -> str:
    where = f" WHERE l_shipdate >= TIMESTAMP '{year}-01-01' AND l_shipdate < TIMESTAMP '{year + 1}-01-01'" if year is not None else ""
    net = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
    return (
        f"{name} AS (SELECT l_suppkey AS vendor_id, l_orderkey AS contract_id, l_partkey AS application_id, year(l_shipdate) AS year,"
        f" month(l_shipdate) AS month, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,6)) AS budget, CAST({net} AS DECIMAL(18,6)) AS actual,"
        f" CAST({net} * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS forecast FROM lineitem{where})"
    )


SPEND = spend_lines_sql()


# ---------------------------------------------------------------------- bridge
def links(spark, folder):
    """Vendor, application and relation of every line, repeats included; returned goods stand for portal use."""
    relation = F.when(F.col("l_returnflag") == "R", "USES_PORTAL").otherwise("SUPPORTS")
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.col("l_partkey").alias("application_id"), relation.alias("relation"))


def bridge(spark, folder):
    """Distinct vendor, application and relation triples."""
    return links(spark, folder).distinct()


BRIDGE = (
    "bridge AS (SELECT DISTINCT l_suppkey AS vendor_id, l_partkey AS application_id,"
    " CASE WHEN l_returnflag = 'R' THEN 'USES_PORTAL' ELSE 'SUPPORTS' END AS relation FROM lineitem)"
)


# ------------------------------------------------------------------- workforce
def assignments(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("assignment_id"), F.col("c_nationkey").alias("country"), F.col("c_mktsegment").alias("worker_type"),
        (F.col("c_acctbal") >= 0).alias("billable"),
    )


ASSIGNMENTS = (
    "assignments AS (SELECT c_custkey AS assignment_id, c_nationkey AS country, c_mktsegment AS worker_type, c_acctbal >= 0 AS billable FROM customer)"
)


# ------------------------------------------------------------- service levels
def measurements(spark, folder):
    """Daily service measurements per vendor: eligible and failed units and their fee basis."""
    return (
        table(spark, folder, "events")
        .select(
            F.col("user_id").alias("vendor_id"), F.date_format("ts", "yyyy-MM-dd").alias("period"),
            (F.col("event_type") == "error").cast("int").alias("is_failure"), dec("value").alias("value"),
        )
        .groupBy("vendor_id", "period")
        .agg(F.count("*").alias("eligible_units"), F.sum("is_failure").alias("failed_units"), F.sum("value").cast("decimal(18,2)").alias("fee_basis"))
    )


MEASUREMENTS = (
    "measurements AS (SELECT user_id AS vendor_id, strftime(ts, '%Y-%m-%d') AS period, count(*) AS eligible_units,"
    " CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed_units,"
    " CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS fee_basis FROM events GROUP BY ALL)"
)


# ------------------------------------------------------------------------ risk
def assessments(spark, folder):
    """Risk assessments per vendor: unlabelled is Missing, low quality is Stale, the rest Current."""
    status = F.when(F.col("quality").isNull(), "Missing").when(F.col("quality") == 0, "Stale").otherwise("Current")
    return (
        table(spark, folder, "documents").select("doc_id", "source")
        .join(table(spark, folder, "labels"), "doc_id", "left")
        .select(
            F.col("doc_id").alias("vendor_id"), F.concat(F.lit("RA-"), F.col("doc_id").cast("string")).alias("assessment_id"), status.alias("status"),
            F.when(F.col("toxic") == 1, "High").when(F.col("toxic") == 0, "Low").otherwise("Unrated").alias("tier"), F.col("source").alias("assessor"),
        )
    )


ASSESSMENTS = (
    "assessments AS (SELECT d.doc_id AS vendor_id, 'RA-' || d.doc_id AS assessment_id,"
    " CASE WHEN quality IS NULL THEN 'Missing' WHEN quality = 0 THEN 'Stale' ELSE 'Current' END AS status,"
    " CASE WHEN toxic = 1 THEN 'High' WHEN toxic = 0 THEN 'Low' ELSE 'Unrated' END AS tier, d.source AS assessor"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


# ----------------------------------------------------------------- SQL helpers
def money_sql(expr: str) -> str:
    return f"CAST(CAST(round({expr}, 2) AS DECIMAL(18,2)) AS VARCHAR)"


def cents_sql(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DECIMAL(18,2))"


def percent_sql(delta: str, base: str) -> str:
    """Half-up percentage on whole cents, as decimal(18,2)."""
    d, b = f"CAST(abs({delta}) * 100 AS HUGEINT)", f"CAST(abs({base}) * 100 AS HUGEINT)"
    return (
        f"CASE WHEN {base} <> 0 THEN CAST(sign({delta}) * sign({base}) AS DECIMAL(4,0)) *"
        f" CAST(CAST((20000 * {d} + {b}) // (2 * {b}) AS DECIMAL(18,0)) / CAST(100 AS DECIMAL(3,0)) AS DECIMAL(18,2)) END"
    )


def percent_text_sql(delta: str, base: str) -> str:
    return f"CAST(CAST({percent_sql(delta, base)} AS DECIMAL(18,2)) AS VARCHAR)"


def with_sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "
