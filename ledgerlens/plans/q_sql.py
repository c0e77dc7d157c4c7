"""Governed SQL over the test tables: views, functions, windows and unions."""

from __future__ import annotations

from ledgerlens.operators.governed import GovernedDataset, GovernedSession
from ledgerlens.plans.registry import query

MASKED = {"customer": ("c_name",), "supplier": ("s_name",)}
NAMESPACES = {"documents": ("lang", "en")}
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def governed(spark, folder) -> GovernedSession:
    """A governed session over a folder, with names and texts of other languages out of reach."""
    datasets = {n: GovernedDataset(lambda s, n=n: s.read.parquet(f"{folder}/{n}.parquet"), MASKED.get(n, ()), NAMESPACES.get(n)) for n in NAMES}
    return GovernedSession(spark, datasets)


def both(name: str, spark_sql: str, duck_sql: str | None = None):
    @query(name, duck_sql or spark_sql)
    def run(spark, folder):
        return governed(spark, folder).query(spark_sql)

    return run


both(
    "governed_view",
    "SELECT c_mktsegment, count(*) AS customers, count(DISTINCT o_orderkey) AS contracts FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
)
_TOP = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40 ORDER BY l_quantity DESC, l_orderkey, l_linenumber"


@query("governed_capped", f"WITH q AS ({_TOP}) SELECT *, (SELECT count(*) FROM q) > 50 AS truncated FROM q ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 50")
def governed_capped(spark, folder):
    return governed(spark, folder).capped(_TOP)


both("governed_namespace", "SELECT source, count(*) AS documents FROM documents GROUP BY source", "SELECT source, count(*) AS documents FROM documents WHERE lang = 'en' GROUP BY source")
both(
    "sql_union",
    "SELECT s_nationkey AS country, 'vendor' AS party FROM supplier UNION SELECT c_nationkey, 'owner' FROM customer UNION ALL SELECT n_nationkey, 'nation' FROM nation",
)
both(
    "sql_windows",
    "WITH d AS (SELECT event_type, date_format(ts, 'yyyy-MM-dd') AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM events GROUP BY event_type, date_format(ts, 'yyyy-MM-dd'))"
    " SELECT event_type, day, n, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY event_type ORDER BY n) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY n) AS BIGINT) AS drk, lag(n) OVER w AS prior_n, lead(n) OVER w AS next_n,"
    " first_value(n) OVER w AS first_n, last_value(n) OVER w AS last_n, CAST(ntile(4) OVER w AS BIGINT) AS quartile, CAST(CAST(sum(total) OVER w AS DECIMAL(18,2)) AS STRING) AS running FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)",
    "WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total FROM events GROUP BY 1, 2)"
    " SELECT event_type, day, n, row_number() OVER w AS rn, rank() OVER (PARTITION BY event_type ORDER BY n) AS rk, dense_rank() OVER (PARTITION BY event_type ORDER BY n) AS drk, lag(n) OVER w AS prior_n, lead(n) OVER w AS next_n,"
    " first_value(n) OVER w AS first_n, last_value(n) OVER w AS last_n, ntile(4) OVER w AS quartile, CAST(CAST(sum(total) OVER w AS DECIMAL(18,2)) AS VARCHAR) AS running FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)",
)
both(
    "fn_math",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity - 25) AS a, round(l_quantity / 7, 2) AS r, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, greatest(l_quantity, 10.0, NULL) AS g, least(l_quantity, 40.0, NULL) AS l,"
    " CAST(to_number(CAST(l_linenumber AS STRING), '99') AS INT) AS n FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_quantity - 25) AS a, round(l_quantity / 7, 2) AS r, CAST(floor(l_quantity / 7) AS BIGINT) AS f, CAST(ceil(l_quantity / 7) AS BIGINT) AS c, greatest(l_quantity, 10.0, NULL) AS g, least(l_quantity, 40.0, NULL) AS l,"
    " l_linenumber AS n FROM lineitem",
)
both(
    "fn_string",
    "SELECT p_partkey, concat(p_name, '/', p_brand) AS c, concat_ws('-', p_type, p_brand) AS cw, length(p_name) AS len, lower(p_type) AS lo, upper(p_name) AS up, trim(concat(' ', p_name, ' ')) AS tr, btrim(concat('  ', p_type)) AS bt, substring(p_name, 2, 3) AS sub, left(p_name, 3) AS lf, right(p_name, 3) AS rt,"
    " replace(p_name, ' ', '_') AS rep, split_part(p_name, ' ', 2) AS sp, position('e' IN p_name) AS pos, locate('r', p_name) AS loc, initcap(p_name) AS ini, lpad(p_type, 9, '*') AS lp, rpad(p_type, 9, '*') AS rp, startswith(p_name, 's') AS sw, p_name RLIKE '^[a-m]' AS rl, p_type RLIKE '(?i)^pro' AS ri FROM part",
    "SELECT p_partkey, concat(p_name, '/', p_brand) AS c, concat_ws('-', p_type, p_brand) AS cw, length(p_name) AS len, lower(p_type) AS lo, upper(p_name) AS up, trim(concat(' ', p_name, ' ')) AS tr, trim(concat('  ', p_type)) AS bt, substring(p_name, 2, 3) AS sub, left(p_name, 3) AS lf, right(p_name, 3) AS rt,"
    " replace(p_name, ' ', '_') AS rep, split_part(p_name, ' ', 2) AS sp, position('e' IN p_name) AS pos, instr(p_name, 'r') AS loc, upper(left(p_name, 1)) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(left(split_part(p_name, ' ', 2), 1)) || substring(split_part(p_name, ' ', 2), 2) AS ini,"
    " lpad(p_type, 9, '*') AS lp, rpad(p_type, 9, '*') AS rp, starts_with(p_name, 's') AS sw, regexp_matches(p_name, '^[a-m]') AS rl, regexp_matches(p_type, '(?i)^pro') AS ri FROM part",
)
both(
    "fn_date",
    "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(date_part('quarter', o_orderdate) AS BIGINT) AS q, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS m, CAST(datediff(CAST(o_orderdate AS DATE), DATE '2000-01-01') AS BIGINT) AS d, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS a,"
    " CAST(date_sub(CAST(o_orderdate AS DATE), 30) AS STRING) AS s, CAST(date(o_orderdate) AS STRING) AS dt, CAST(to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS STRING) AS td, date_format(o_orderdate, 'yyyy/MM') AS tc, CAST(timestampdiff(YEAR, DATE '1990-06-15', CAST(o_orderdate AS DATE)) AS BIGINT) AS age FROM orders",
    "SELECT o_orderkey, extract(YEAR FROM o_orderdate) AS y, date_part('quarter', o_orderdate) AS q, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS m, date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS d, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS a,"
    " CAST(CAST(o_orderdate AS DATE) - 30 AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS td, strftime(o_orderdate, '%Y/%m') AS tc, date_sub('year', DATE '1990-06-15', CAST(o_orderdate AS DATE)) AS age FROM orders",
)
both(
    "fn_aggregate",
    "SELECT o_orderpriority, count(*) AS n, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS STRING) AS s, round(avg(o_totalprice), 4) AS av, min(o_totalprice) AS mn, max(o_totalprice) AS mx, round(stddev(o_totalprice), 2) AS sd, round(stddev_pop(o_totalprice), 2) AS sp, round(variance(o_totalprice) / 1000000, 2) AS va,"
    " size(collect_set(o_orderstatus)) AS statuses, listagg(DISTINCT o_orderstatus, ',') WITHIN GROUP (ORDER BY o_orderstatus) AS la, count_if(o_orderstatus = 'F') AS closed, any_value(o_orderpriority) AS av1 FROM orders GROUP BY o_orderpriority",
    "SELECT o_orderpriority, count(*) AS n, CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS VARCHAR) AS s, round(avg(o_totalprice), 4) AS av, min(o_totalprice) AS mn, max(o_totalprice) AS mx, round(stddev(o_totalprice), 2) AS sd, round(stddev_pop(o_totalprice), 2) AS sp, round(variance(o_totalprice) / 1000000, 2) AS va,"
    " count(DISTINCT o_orderstatus) AS statuses, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS la, count_if(o_orderstatus = 'F') AS closed, any_value(o_orderpriority) AS av1 FROM orders GROUP BY o_orderpriority",
)
both(
    "fn_array_agg",
    # Only distinct values are collected, so that no list grows with the data.
    "SELECT kind, array_join(array_sort(array_agg(value)), ',') AS vals, string_agg(value, '|') WITHIN GROUP (ORDER BY value) AS piped FROM (SELECT DISTINCT 'status' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders) GROUP BY kind",
    "SELECT kind, string_agg(value, ',' ORDER BY value) AS vals, string_agg(value, '|' ORDER BY value) AS piped FROM (SELECT DISTINCT 'status' AS kind, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders) GROUP BY kind",
)
both(
    "fn_conditional",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS c, if(o_orderstatus = 'F', 1, 0) AS i, coalesce(nullif(o_orderstatus, 'P'), 'none') AS co, nullif(o_orderpriority, '5-LOW') AS nu, CAST(o_custkey AS STRING) AS ca, TRY_CAST(o_orderpriority AS INT) AS tc,"
    " EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS ex FROM orders",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS c, if(o_orderstatus = 'F', 1, 0) AS i, coalesce(nullif(o_orderstatus, 'P'), 'none') AS co, nullif(o_orderpriority, '5-LOW') AS nu, CAST(o_custkey AS VARCHAR) AS ca, TRY_CAST(o_orderpriority AS INT) AS tc,"
    " EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS ex FROM orders",
)
