"""Source queries: admission, nested documents, digests, load planning and copy verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_iso_date
from ledgerlens.functions.money import parse_cents
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import table
from ledgerlens.sources import sinks, tables


@query(
    "scan_required_columns",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice FROM orders",
)
def scan_required_columns(spark, folder):
    """Orders as an all-text table with its required columns; no value is the empty string."""
    checked = tables.require_columns(table(spark, folder, "orders"), "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    rows = checked.select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"), F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice")
    )
    return tables.as_text_table(rows)


@query("scan_namespace", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'")
def scan_namespace(spark, folder):
    """The language of a document stands for its namespace."""
    return tables.admit_namespace(table(spark, folder, "documents"), "en", "lang").select("doc_id", "source", "n_chars")


@query("json_props_extract", "SELECT event_type, count(*) AS events, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS largest FROM events GROUP BY 1")
def json_props_extract(spark, folder):
    parsed = table(spark, folder, "events").select("event_type", F.from_json("props", "k bigint", {"mode": "FAILFAST"}).alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("p.k").alias("total"), F.max("p.k").alias("largest"))


# Every column of every table; (number), [list of numbers] and <time> are spelled as the digest spells them.
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey (c_acctbal) c_mktsegment", "supplier": "s_suppkey s_name s_nationkey (s_acctbal)",
    "part": "p_partkey p_name p_brand p_type p_size (p_retailprice)", "orders": "o_orderkey o_custkey o_orderstatus (o_totalprice) <o_orderdate> o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber (l_quantity) (l_extendedprice) (l_discount) (l_tax) l_returnflag l_linestatus <l_shipdate>",
    "events": "event_id <ts> user_id event_type (value) props", "documents": "doc_id text lang source n_chars", "labels": "doc_id quality toxic", "embeddings": "vec_id [embedding] label",
    "pages": "page_id url html", "benchmark": "item_id text", "conversations": "conv_id turn role text",
}
_SPELLED = {
    "(": "CAST(CAST({} AS DECIMAL(38,6)) AS VARCHAR)", "<": "strftime({}, '%Y-%m-%d %H:%M:%S.%f')", "[": "'[' || array_to_string(list_transform({}, lambda x: CAST(CAST(CAST(x AS DOUBLE) AS DECIMAL(38,6)) AS VARCHAR)), ',') || ']'",
}


def _digest_sql(name: str, condition: str = "TRUE") -> str:
    columns = COLUMNS[name].split()
    values = ", ".join(f"coalesce({_SPELLED.get(c[0], 'CAST({} AS VARCHAR)').format(c.strip('()<>[]'))}, '')" for c in columns)
    header = ", ".join(f"'{c.strip('()<>[]')}'" for c in columns)
    return (
        f"SELECT '{name}' AS table_name, count(*) AS row_count, sha256(CAST(to_json([{header}]) AS VARCHAR)) AS columns_hash, CAST(coalesce(sum(h), 0) AS DECIMAL(38,0)) AS hash_sum, coalesce(bit_xor(h), 0) AS hash_xor"
        f" FROM (SELECT ('0x' || substr(sha256(CAST(to_json([{values}]) AS VARCHAR)), 1, 15))::BIGINT AS h FROM {name} WHERE {condition})"
    )


DIGESTS = "current_digests AS (" + " UNION ALL ".join(_digest_sql(n) for n in COLUMNS) + ")"
# The manifest of an earlier load: fewer closed orders, no error events, everything else as it is now; parts were never loaded.
EARLIER = {"orders": "o_orderstatus <> 'F'", "events": "event_type <> 'error'"}
MANIFEST = "manifest AS (" + " UNION ALL ".join(_digest_sql(n, EARLIER.get(n, "TRUE")) for n in COLUMNS if n != "part") + ")"


def sources(spark, folder, earlier=False):
    found = {n: table(spark, folder, n) for n in COLUMNS}
    if earlier:
        found = {n: df.filter(EARLIER[n]) if n in EARLIER else df for n, df in found.items() if n != "part"}
    return found


@query("content_digest", "WITH " + DIGESTS + " SELECT table_name, row_count, columns_hash, CAST(hash_sum AS VARCHAR) AS hash_sum, hash_xor FROM current_digests")
def content_digest(spark, folder):
    return sinks.digests(sources(spark, folder))


@query("load_plan", "WITH " + DIGESTS + ", " + MANIFEST + " SELECT c.table_name, c.row_count, CASE WHEN c.hash_sum = m.hash_sum AND c.hash_xor = m.hash_xor AND c.row_count = m.row_count THEN 'unchanged' ELSE 'loaded' END AS action FROM current_digests c LEFT JOIN manifest m USING (table_name)")
def load_plan(spark, folder):
    return sinks.load_plan(sinks.digests(sources(spark, folder)), sinks.digests(sources(spark, folder, earlier=True)))


@query(
    "verify_copy",
    "WITH " + DIGESTS + ", " + MANIFEST
    + " SELECT c.table_name, c.row_count AS source_rows, coalesce(m.row_count, 0) AS copy_rows, m.table_name IS NOT NULL AS table_present, coalesce(c.columns_hash = m.columns_hash, FALSE) AS columns_match, coalesce(c.row_count = m.row_count, FALSE) AS row_count_match, coalesce(c.hash_sum = m.hash_sum AND c.hash_xor = m.hash_xor, FALSE) AS content_match FROM current_digests c LEFT JOIN manifest m USING (table_name)",
)
def verify_copy(spark, folder):
    return sinks.verify_copy(sinks.digests(sources(spark, folder)), sinks.digests(sources(spark, folder, earlier=True)))


@query(
    "money_parse",
    "SELECT event_id, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+([.][0-9]*)?') THEN CAST(CAST(round(CAST(t AS DECIMAL(18,6)), 2) AS DECIMAL(18,2)) AS VARCHAR) END AS money FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN '' WHEN 'signup' THEN CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || '5' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS t FROM events)",
)
def money_parse(spark, folder):
    """Event values as text, some of them words, blanks or with a third decimal place that rounds half up."""
    text = F.col("value").cast("decimal(12,2)").cast("string")
    shown = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "").when(F.col("event_type") == "signup", F.concat(text, F.lit("5"))).otherwise(text)
    return table(spark, folder, "events").select("event_id", parse_cents(shown).alias("money"))


_LONG_MONEY = (
    "SELECT o_orderkey, 7 + o_orderkey % 24 AS k, o_orderkey % 3 AS style, o_orderkey % 5 = 0 AS negative, CAST(o_orderkey % 1000 AS VARCHAR) AS whole, lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')"
    " || CASE o_custkey % 4 WHEN 0 THEN '4' || repeat('9', 4 + CAST(o_orderkey % 24 AS INTEGER)) WHEN 1 THEN '5' || repeat('0', 4 + CAST(o_orderkey % 24 AS INTEGER)) WHEN 2 THEN repeat('0', 5 + CAST(o_orderkey % 24 AS INTEGER)) ELSE rpad(CAST(o_orderkey AS VARCHAR), 5 + CAST(o_orderkey % 24 AS INTEGER), '7') END AS decimals FROM orders"
)


@query(
    "money_any_scale",
    f"SELECT o_orderkey, CAST(CAST(CASE WHEN negative THEN -c ELSE c END AS DECIMAL(20,0)) / 100 AS DECIMAL(20,2))::VARCHAR AS money FROM (SELECT *, (CAST(whole || decimals AS HUGEINT) * 2 + CAST('1' || repeat('0', CAST(k AS INTEGER) - 2) AS HUGEINT)) // (2 * CAST('1' || repeat('0', CAST(k AS INTEGER) - 2) AS HUGEINT)) AS c FROM ({_LONG_MONEY}))",
)
def money_any_scale(spark, folder):
    """Amounts of 7 to 30 decimals, some just below or at half a cent, as plain text and with either exponent."""
    places = (7 + F.col("o_orderkey") % 24).cast("int")
    kind, rest = F.col("o_custkey") % 4, places - 2
    tail = F.when(kind == 0, F.concat(F.lit("4"), F.repeat(F.lit("9"), rest - 1))).when(kind == 1, F.concat(F.lit("5"), F.repeat(F.lit("0"), rest - 1)))
    tail = tail.when(kind == 2, F.repeat(F.lit("0"), rest)).otherwise(F.rpad(F.col("o_orderkey").cast("string"), rest, F.lit("7")))
    whole = (F.col("o_orderkey") % 1000).cast("string")
    decimals = F.concat(F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), tail)
    style = F.col("o_orderkey") % 3
    text = F.when(style == 0, F.concat(whole, F.lit("."), decimals)).when(style == 1, F.concat(whole, decimals, F.lit("e-"), places.cast("string")))
    text = text.otherwise(F.concat(F.lit(" ."), F.lit("000"), whole, decimals, F.lit("E+"), (3 + F.length(whole)).cast("string")))
    signed = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(""), F.trim(text))
    return table(spark, folder, "orders").select("o_orderkey", parse_cents(signed).alias("money"))


@query(
    "date_parse",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(TRY_CAST(t AS DATE) AS VARCHAR) END AS parsed FROM (SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-') || '31' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)",
)
def date_parse(spark, folder):
    """Day 31 is no calendar day in some months; pending orders are written with slashes."""
    shown = F.when(F.col("o_orderstatus") == "F", F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lit("31"))).when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, folder, "orders").select("o_orderkey", parse_iso_date(shown).alias("parsed"))


# ------------------------------------------------------------- usage roll-ups
@query("source_usage", "SELECT event_type AS source, string_agg(DISTINCT CASE WHEN value > 50 THEN 'run_sql' ELSE 'certified' END, ',' ORDER BY CASE WHEN value > 50 THEN 'run_sql' ELSE 'certified' END) AS via, count(DISTINCT user_id) AS specialists FROM events GROUP BY 1")
def source_usage(spark, folder):
    """Which source was read through which tool, and by how many specialists."""
    trace = table(spark, folder, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 50, "run_sql").otherwise("certified").alias("via"), "user_id")
    per_user = trace.groupBy("source", "user_id").agg(F.bool_or(F.col("via") == "run_sql").alias("sql"), F.bool_or(F.col("via") == "certified").alias("certified"))
    rolled = per_user.groupBy("source").agg(F.bool_or("sql").alias("sql"), F.bool_or("certified").alias("certified"), F.count("*").alias("specialists"))
    return rolled.select("source", F.concat_ws(",", F.when(F.col("certified"), "certified"), F.when(F.col("sql"), "run_sql")).alias("via"), "specialists")


@query(
    "agent_rollup",
    "SELECT user_id AS agent, CAST(CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS VARCHAR) AS duration, count(*) FILTER (event_type = 'view') AS queries_run, count(*) FILTER (event_type = 'purchase') AS queries_kept, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools, bool_or(event_type = 'error') AS failed FROM events GROUP BY 1",
)
def agent_rollup(spark, folder):
    """Event log per agent: duration, queries run and kept, tools used. Event types are a fixed list."""
    rows = table(spark, folder, "events")
    return rows.groupBy(F.col("user_id").alias("agent")).agg(
        F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(18,2)").alias("duration"), F.count_if(F.col("event_type") == "view").alias("queries_run"), F.count_if(F.col("event_type") == "purchase").alias("queries_kept"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tools"), F.bool_or(F.col("event_type") == "error").alias("failed"),
    )
