"""Catalog queries over all test tables.

The harvest (profiles, classification, references) is stored once per session and state of
the folder's files; catalog questions read it, as they would read a stored catalog.
"""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import value_shape
from ledgerlens.operators import ranking
from ledgerlens.operators.catalog import classify, identity, profile, questions, references
from ledgerlens.plans.registry import query
from ledgerlens.plans.tables import table
from ledgerlens.plans.vocabulary import DATASETS, VOCABULARY, grain
from ledgerlens.session import on_release, shared_checkpoint

DAY_COLUMNS = ("o_orderdate", "l_shipdate")
_HARVESTS: dict = {}
on_release(_HARVESTS.clear)


def tables(spark, folder):
    found = {}
    for dataset_id, (name, *_rest) in DATASETS.items():
        df = table(spark, folder, name)
        for column in DAY_COLUMNS:
            if column in df.columns:
                df = df.withColumn(column, F.col(column).cast("date"))
        found[dataset_id] = df
    return found


def datasets(spark):
    rows = [(d, system, domain, pk[0] if len(pk) == 1 else None, grain(pk)) for d, (_t, system, domain, pk) in DATASETS.items()]
    return spark.createDataFrame(rows, "dataset_id string, system string, domain string, sole_key string, grain string")


def profiled(spark, folder):
    return profile.profile(tables(spark, folder))


class Harvest:
    """A stored catalog: profiles, classified fields, key candidates and references, each worked out when it is first asked for."""

    def __init__(self, spark, folder):
        self.source = tables(spark, folder)
        self.datasets = datasets(spark)
        self.values = partial(profile.values_of, self.source)

    @cached_property
    def profile(self):
        return shared_checkpoint(profile.profile(self.source))

    @cached_property
    def fields(self):
        return classify.classify(self.profile, self.values, VOCABULARY)

    @cached_property
    def candidates(self):
        return shared_checkpoint(references.candidate_fields(self.fields, self.datasets))

    @cached_property
    def references(self):
        return shared_checkpoint(references.discover_references(self.candidates, partial(profile.keyed_values, self.source)))


def version(spark, folder) -> int:
    """A number that changes with the tables' files: their names, sizes and times, from a listing without reading."""
    paths = [f"{folder}/{name}.parquet" for name in sorted({name for name, *_ in DATASETS.values()})]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    return files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()[0]


def harvest(spark, folder) -> Harvest:
    """The catalog of a folder, stored once for each state of its files."""
    key = (spark.sparkContext.applicationId, folder, version(spark, folder))
    if key not in _HARVESTS:
        _HARVESTS[key] = Harvest(spark, folder)
    return _HARVESTS[key]


# ------------------------------------------------------------------ SQL pieces
COLUMNS = {
    "mdm.region": ["r_regionkey int", "r_name string"],
    "mdm.nation": ["n_nationkey int", "n_name string", "n_regionkey int"],
    "mdm.supplier": ["s_suppkey bigint", "s_name string", "s_nationkey int", "s_acctbal double"],
    "mdm.customer": ["c_custkey bigint", "c_name string", "c_nationkey int", "c_acctbal double", "c_mktsegment string"],
    "dependency.part": ["p_partkey bigint", "p_name string", "p_brand string", "p_type string", "p_size int", "p_retailprice double"],
    "clm.orders": ["o_orderkey bigint", "o_custkey bigint", "o_orderstatus string", "o_totalprice double", "o_orderdate date", "o_orderpriority string"],
    "finance.lineitem": [
        "l_orderkey bigint", "l_partkey bigint", "l_suppkey bigint", "l_linenumber int", "l_quantity double", "l_extendedprice double", "l_discount double", "l_tax double", "l_returnflag string", "l_linestatus string", "l_shipdate date",
    ],
    "performance.events": ["event_id bigint", "ts timestamp_ntz", "user_id bigint", "event_type string", "value double", "props string"],
    "risk.documents": ["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint"],
    "risk.labels": ["doc_id bigint", "quality int", "toxic int"],
    "risk.pages": ["page_id bigint", "url string", "html string"],
    "risk.benchmark": ["item_id bigint", "text string"],
    "risk.conversations": ["conv_id bigint", "turn bigint", "role string", "text string"],
    "risk.embeddings": ["vec_id bigint", "label int"],
}


def text_sql(column: str, kind: str) -> str:
    if kind == "double":
        return f"CAST(CAST({column} AS DECIMAL(18,4)) AS VARCHAR)"
    if kind == "timestamp_ntz":
        return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"
    return f"CAST(CAST({column} AS DATE) AS VARCHAR)" if kind == "date" else f"CAST({column} AS VARCHAR)"


def all_columns():
    for dataset_id, columns in COLUMNS.items():
        for position, spec in enumerate(columns, 1):
            yield dataset_id, DATASETS[dataset_id][0], position, *spec.split()


VALUES = "vals AS (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dataset_id, '{c}' AS field, {text_sql(c, k)} AS value FROM {t}" for d, t, _p, c, k in all_columns()
) + ")"
FIELD_ROWS = "meta AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{c}', {p}, '{k}')" for d, _t, p, c, k in all_columns()) + ") m(dataset_id, field, position, data_type))"
PROFILE = (
    VALUES, FIELD_ROWS,
    "stats AS (SELECT dataset_id, field, count(*) AS row_count, count(*) FILTER (value IS NULL OR value = '') AS empty_count, count(DISTINCT nullif(value, '')) AS distinct_count, min(nullif(value, '')) AS min_value, max(nullif(value, '')) AS max_value,"
    " coalesce(max(length(value)), 0) AS max_length, coalesce(bool_and(regexp_full_match(nullif(value, ''), '-?[0-9]+([.][0-9]+)?')), FALSE) AS is_numeric,"
    " coalesce(bool_and(regexp_full_match(nullif(value, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}')), FALSE) AS is_date FROM vals GROUP BY 1, 2)",
    "prof AS (SELECT *, CAST(empty_count * 100 AS DOUBLE) / row_count AS raw_pct, empty_count = 0 AND distinct_count = row_count AS is_unique FROM stats JOIN meta USING (dataset_id, field))",
)


def sql(*extra: str) -> str:
    return "WITH " + ", ".join([*PROFILE, *extra]) + " "


@query(
    "column_profile",
    sql() + "SELECT dataset_id, field, position, data_type, row_count, empty_count, distinct_count, min_value, max_value, max_length, is_numeric, is_date, round(raw_pct, 2) AS null_pct, is_unique FROM prof",
)
def column_profile(spark, folder):
    return profiled(spark, folder).drop("one_shape")


@query(
    "distinct_capped",
    "WITH " + VALUES
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, field ORDER BY value) AS r, count(*) OVER (PARTITION BY dataset_id, field) AS n FROM (SELECT DISTINCT * FROM vals WHERE length(value) > 0"
    " AND (dataset_id, field) IN (('mdm.customer', 'c_mktsegment'), ('dependency.part', 'p_brand'), ('dependency.part', 'p_type'), ('clm.orders', 'o_orderpriority'), ('clm.orders', 'o_orderdate'), ('finance.lineitem', 'l_quantity'), ('risk.documents', 'source'))))"
    " SELECT dataset_id, field, value, n > 20 AS truncated FROM ranked WHERE r <= 20",
)
def distinct_capped(spark, folder):
    chosen = {"mdm.customer": ["c_mktsegment"], "dependency.part": ["p_brand", "p_type"], "clm.orders": ["o_orderpriority", "o_orderdate"], "finance.lineitem": ["l_quantity"], "risk.documents": ["source"]}
    values = profile.distinct_values(tables(spark, folder), chosen)
    return ranking.capped_distinct(values, ["dataset_id", "field"], "value", 20)


@query("masked_sample", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '<masked>' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,4)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5")
def masked_sample(spark, folder):
    return profile.masked_sample(table(spark, folder, "customer"), ["c_custkey"], ["c_name"], 5)


_SHAPE = (
    r"'^' || array_to_string(list_transform(regexp_extract_all(value, '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '\d{' || length(x) || '}'"
    r" ELSE regexp_replace(x, '([.^$*+?{}\[\]\\|()])', '\\\1', 'g') END), '') || '$'"
)


@query(
    "value_shape",
    "WITH " + VALUES + f", shaped AS (SELECT dataset_id, field, {_SHAPE} AS shape FROM vals WHERE length(value) > 0)"
    " SELECT dataset_id, field, CASE WHEN min(shape) = max(shape) AND contains(min(shape), '\\d') THEN min(shape) END AS value_pattern FROM shaped GROUP BY 1, 2",
)
def shapes(spark, folder):
    """The profile tells the shape of numbers and dates; texts are read where the least and the greatest have one mask."""
    source = tables(spark, folder)
    facts = classify.value_facts(partial(profile.values_of, source), shared_checkpoint(profile.profile(source)), VOCABULARY)
    return facts.select("dataset_id", "field", "value_pattern")


@query(
    "identifier_by_values",
    "WITH " + VALUES
    + ", c AS (SELECT dataset_id, field, concat_ws(',', CASE WHEN regexp_full_match(value, 'Brand#[0-9]{1,2}') THEN 'Brand' END, CASE WHEN regexp_full_match(value, 'Customer#[0-9]{9}') THEN 'CustomerAccount' END,"
    " CASE WHEN regexp_full_match(value, 'Supplier#[0-9]{9}') THEN 'SupplierAccount' END) AS cls FROM vals WHERE length(value) > 0)"
    " SELECT dataset_id, field, min(cls) <> '' AS all_identifiers, CASE WHEN min(cls) = max(cls) AND min(cls) <> '' AND NOT contains(min(cls), ',') THEN min(cls) END AS value_class FROM c GROUP BY 1, 2",
)
def identifier_by_values(spark, folder):
    return classify.identifier_by_values(profile.all_values(tables(spark, folder)), VOCABULARY)


# The mapping that names and values must give, as the SQL side states it.
CONCEPTS = {
    "Supplier.supplier_id": ["mdm.supplier.s_suppkey", "finance.lineitem.l_suppkey"], "Customer.customer_id": ["mdm.customer.c_custkey", "clm.orders.o_custkey"],
    "Part.part_id": ["dependency.part.p_partkey", "finance.lineitem.l_partkey"], "Order.order_id": ["clm.orders.o_orderkey", "finance.lineitem.l_orderkey"],
    "Nation.nation_id": ["mdm.nation.n_nationkey", "mdm.supplier.s_nationkey", "mdm.customer.c_nationkey"], "Region.region_id": ["mdm.region.r_regionkey", "mdm.nation.n_regionkey"],
    "Supplier.balance": ["mdm.supplier.s_acctbal"], "Customer.segment": ["mdm.customer.c_mktsegment"], "Part.size": ["dependency.part.p_size"], "Part.price": ["dependency.part.p_retailprice"],
    "Order.status": ["clm.orders.o_orderstatus"], "Order.total": ["clm.orders.o_totalprice"], "Order.date": ["clm.orders.o_orderdate"], "Document.document_id": ["risk.documents.doc_id", "risk.labels.doc_id"],
    "Conversation.conversation_id": ["risk.conversations.conv_id"], "Event.event_id": ["performance.events.event_id"], "User.user_id": ["performance.events.user_id"],
    "SupplierAccount.account_name": ["mdm.supplier.s_name"], "CustomerAccount.account_name": ["mdm.customer.c_name"], "Brand.code": ["dependency.part.p_brand"],
}
_IDENTIFIERS = [c for c in CONCEPTS if c.endswith("_id") or c.endswith("account_name") or c == "Brand.code"]
MAPPING = "mapping AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{f.rsplit('.', 1)[0]}', '{f.rsplit('.', 1)[1]}', '{c}', {c in _IDENTIFIERS})" for c, fs in CONCEPTS.items() for f in fs
) + ") m(dataset_id, field, concept, is_identifier))"
ROLE = (
    "CASE WHEN is_identifier OR upper(field) LIKE '%ID' THEN 'identifier' WHEN is_date THEN 'date' WHEN is_numeric THEN 'measure' WHEN distinct_count > 0 AND distinct_count <= 20 AND max_length <= 40 THEN 'dimension' ELSE 'text' END"
)
CLASSIFIED = (MAPPING, f"classified AS (SELECT p.*, m.concept, {ROLE} AS role, coalesce(m.concept = 'CustomerAccount.account_name', FALSE) AS masked, CASE WHEN m.concept IS NULL THEN 'none' ELSE 'classifier' END AS basis FROM prof p LEFT JOIN mapping m USING (dataset_id, field))")


@query("semantic_role", sql(*CLASSIFIED) + "SELECT dataset_id, field, role FROM classified")
def semantic_role(spark, folder):
    return harvest(spark, folder).fields.select("dataset_id", "field", "role")


@query("name_mapping", "WITH " + MAPPING + " SELECT dataset_id, field, concept FROM mapping WHERE field NOT IN ('s_name', 'c_name', 'p_brand') UNION ALL SELECT 'dependency.part', 'p_type', 'Part.type'")
def name_mapping(spark, folder):
    fields = harvest(spark, folder).profile
    return classify.name_mapping(fields, VOCABULARY).select("dataset_id", "field", F.concat_ws(".", "class_id", "property_id").alias("concept"))


@query(
    "mapping_compat",
    sql("ruled AS (SELECT * FROM (VALUES ('mdm.customer', 'c_mktsegment', 'Customer.segment', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']), ('dependency.part', 'p_type', 'Part.type', ['STANDARD', 'ECONOMY', 'PROMO']), ('clm.orders', 'o_orderstatus', 'Order.status', ['F', 'O', 'P'])) r(dataset_id, field, concept, allowed))")
    + "SELECT dataset_id, field, concept FROM ruled r WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.dataset_id = r.dataset_id AND v.field = r.field AND NOT list_contains(r.allowed, v.value))",
)
def mapping_compat(spark, folder):
    """Part.type loses its mapping because the data holds values outside the vocabulary."""
    rows = [("mdm.customer", "c_mktsegment", "dimension", "Customer", "segment"), ("dependency.part", "p_type", "dimension", "Part", "type"), ("clm.orders", "o_orderstatus", "dimension", "Order", "status"), ("clm.orders", "o_orderpriority", "measure", "Order", "status")]
    candidates = spark.createDataFrame(rows, "dataset_id string, field string, role string, class_id string, property_id string")
    chosen = {"mdm.customer": ["c_mktsegment"], "dependency.part": ["p_type"], "clm.orders": ["o_orderstatus", "o_orderpriority"]}
    fitting = classify.compatible(candidates, profile.distinct_values(tables(spark, folder), chosen), VOCABULARY)
    return fitting.select("dataset_id", "field", F.concat_ws(".", "class_id", "property_id").alias("concept"))


@query(
    "classify_columns",
    sql(*CLASSIFIED, "sets AS (SELECT dataset_id, field, string_agg(value, '|' ORDER BY value) AS value_set FROM (SELECT DISTINCT v.dataset_id, v.field, v.value FROM vals v JOIN classified c ON v.dataset_id = c.dataset_id AND v.field = c.field WHERE c.role = 'dimension' AND length(v.value) > 0) GROUP BY 1, 2)")
    + "SELECT dataset_id, field, role, concept, masked, basis, CASE WHEN concept IS NOT NULL THEN 1.0::DOUBLE END AS confidence, FALSE AS name_collision, value_set FROM classified LEFT JOIN sets USING (dataset_id, field)",
)
def classify_columns(spark, folder):
    fields = harvest(spark, folder).fields
    return fields.select("dataset_id", "field", "role", "concept", "masked", "basis", "confidence", "name_collision", F.array_join("value_set", "|").alias("value_set"))


HOMES = (
    "sole AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{domain}', " + (f"'{pk[0]}'" if len(pk) == 1 else "NULL") + f", '{system}', '{grain(pk)}')" for d, (_t, system, domain, pk) in DATASETS.items()) + ") s(dataset_id, domain, sole_key, system, grain))",
    "classes AS (SELECT * FROM (VALUES " + ", ".join(f"('{c.id}', '{c.domain}')" for c in VOCABULARY.classes) + ") k(class_id, class_domain))",
    "shape AS (SELECT dataset_id, bool_or(role = 'measure') AS is_fact, count(*) AS width FROM classified GROUP BY 1)",
    "described AS (SELECT dataset_id, split_part(concept, '.', 1) AS class_id, count(DISTINCT concept) AS described FROM classified WHERE concept IS NOT NULL GROUP BY 1, 2)",
    "cands AS (SELECT c.*, split_part(concept, '.', 1) AS class_id FROM classified c WHERE role = 'identifier' AND NOT masked AND distinct_count >= 2 AND concept IS NOT NULL)",
    "homes AS (SELECT concept, dataset_id AS home_dataset, field AS home_field FROM (SELECT c.*, row_number() OVER (PARTITION BY concept ORDER BY coalesce(sole_key <> field, TRUE), is_fact, NOT coalesce(class_domain = domain, FALSE), -described, width, dataset_id, field) AS r"
    " FROM cands c JOIN sole USING (dataset_id) JOIN shape USING (dataset_id) JOIN described USING (dataset_id, class_id) JOIN classes USING (class_id) WHERE is_unique) WHERE r = 1)",
    "pairs AS (SELECT c.dataset_id AS child_dataset, c.field AS child_field, home_dataset, home_field FROM cands c JOIN homes USING (concept) WHERE (c.dataset_id, c.field) <> (home_dataset, home_field))",
    "refs AS (SELECT *, 100.0::DOUBLE AS containment_pct, 'concept' AS basis, 1.0::DOUBLE AS confidence, 'auto' AS review_state FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE v.dataset_id = p.child_dataset AND v.field = p.child_field AND length(v.value) > 0"
    " AND NOT EXISTS (SELECT 1 FROM vals h WHERE h.dataset_id = p.home_dataset AND h.field = p.home_field AND h.value = v.value)))",
)


@query("fk_discovery", sql(*CLASSIFIED, *HOMES) + "SELECT * FROM refs")
def fk_discovery(spark, folder):
    return harvest(spark, folder).references


@query("home_key", sql(*CLASSIFIED, *HOMES) + "SELECT concept, home_dataset, home_field FROM homes")
def home_key(spark, folder):
    homes = references.home_keys(harvest(spark, folder).candidates)
    return homes.select(F.expr("substring(key_group, 9)").alias("concept"), F.col("dataset_id").alias("home_dataset"), F.col("field").alias("home_field"))


@query(
    "dataset_links",
    sql(*CLASSIFIED, *HOMES) + "SELECT child_dataset, home_dataset, string_agg(child_field || ' -> ' || home_field, '|' ORDER BY child_field || ' -> ' || home_field) AS keys FROM refs WHERE child_dataset <> home_dataset GROUP BY 1, 2",
)
def dataset_links(spark, folder):
    return references.dataset_links(harvest(spark, folder).references).withColumn("keys", F.array_join("keys", "|"))


def links(spark, folder):
    """Anchors: every supplier and customer key of the masters, searched in all mapped key columns."""
    h = harvest(spark, folder)
    anchors = table(spark, folder, "supplier").select(F.lit("Supplier.supplier_id").alias("concept"), F.col("s_suppkey").cast("string").alias("anchor")).unionByName(
        table(spark, folder, "customer").select(F.lit("Customer.customer_id").alias("concept"), F.col("c_custkey").cast("string").alias("anchor"))
    )
    keys = h.fields.filter(F.col("concept").isin("Supplier.supplier_id", "Customer.customer_id"))
    return references.anchor_links(h.values(keys, distinct=True), h.fields, anchors)


LINKS = (
    "links AS (SELECT DISTINCT 'mdm.supplier' AS dataset_id, 'Supplier.supplier_id' AS concept, CAST(s_suppkey AS VARCHAR) AS anchor, 's_suppkey' AS via_field FROM supplier"
    " UNION ALL SELECT DISTINCT 'finance.lineitem', 'Supplier.supplier_id', CAST(l_suppkey AS VARCHAR), 'l_suppkey' FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)"
    " UNION ALL SELECT DISTINCT 'mdm.customer', 'Customer.customer_id', CAST(c_custkey AS VARCHAR), 'c_custkey' FROM customer"
    " UNION ALL SELECT DISTINCT 'clm.orders', 'Customer.customer_id', CAST(o_custkey AS VARCHAR), 'o_custkey' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"
)


@query("anchor_links", "WITH " + LINKS + " SELECT * FROM links")
def anchor_links(spark, folder):
    return links(spark, folder)


@query("datasets_for_contract", "WITH " + LINKS + ", " + HOMES[0] + " SELECT dataset_id, system, via_field FROM links JOIN sole USING (dataset_id) WHERE concept = 'Customer.customer_id' AND anchor = '7'")
def datasets_for_contract(spark, folder):
    return questions.datasets_for_anchor(links(spark, folder), harvest(spark, folder).datasets, "Customer.customer_id", "7")


_OVERVIEW = (
    "linked AS (SELECT dataset_id, count(*) AS contracts FROM links GROUP BY 1)",
    "over AS (SELECT s.system, c.dataset_id, s.domain, max(c.row_count) AS row_count, count(*) AS fields, count(c.concept) AS mapped, count(*) AS auto, CAST(0 AS BIGINT) AS unreviewed, CAST(0 AS BIGINT) AS collisions, coalesce(max(l.contracts), 0) AS contracts"
    " FROM classified c JOIN sole s USING (dataset_id) LEFT JOIN linked l USING (dataset_id) GROUP BY 1, 2, 3)",
)


@query("catalog_overview", sql(*CLASSIFIED, HOMES[0], LINKS, *_OVERVIEW) + "SELECT * FROM over")
def catalog_overview(spark, folder):
    h = harvest(spark, folder)
    return questions.overview(h.fields, h.datasets, links(spark, folder))


@query("catalog_systems", sql(*CLASSIFIED, HOMES[0], LINKS, *_OVERVIEW) + "SELECT system, count(*) AS datasets, CAST(sum(row_count) AS BIGINT) AS rows, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains FROM over GROUP BY 1")
def catalog_systems(spark, folder):
    h = harvest(spark, folder)
    return questions.system_rollup(questions.overview(h.fields, h.datasets, links(spark, folder)))


ASKED = ["Supplier", "Order.date", "Customer.customer_id", "Contract.end_date", "Brand"]


@query(
    "find_sources",
    sql(*CLASSIFIED, HOMES[0], "asked AS (SELECT unnest(['Supplier', 'Order.date', 'Customer.customer_id', 'Contract.end_date', 'Brand']) AS asked)")
    + "SELECT asked AS concept, dataset_id, system, row_count, field, concept AS mapping, role, 1.0::DOUBLE AS confidence, 'auto' AS review_state FROM classified JOIN sole USING (dataset_id) JOIN asked ON concept = asked OR split_part(concept, '.', 1) = asked",
)
def find_sources(spark, folder):
    h = harvest(spark, folder)
    return questions.find_sources(h.fields, h.datasets, ASKED)[0].drop("business_name")


@query("coverage_gaps", sql(*CLASSIFIED) + "SELECT a AS concept FROM (SELECT unnest(['Supplier', 'Order.date', 'Customer.customer_id', 'Contract.end_date', 'Brand', 'Invoice']) AS a) WHERE a NOT IN (SELECT concept FROM classified WHERE concept IS NOT NULL UNION SELECT split_part(concept, '.', 1) FROM classified WHERE concept IS NOT NULL)")
def coverage_gaps(spark, folder):
    h = harvest(spark, folder)
    return questions.find_sources(h.fields, h.datasets, [*ASKED, "Invoice"])[1]


@query(
    "join_plan",
    sql(*CLASSIFIED, *HOMES)
    + "SELECT r.*, h.row_count AS home_rows, c.row_count AS child_rows, s.grain AS child_grain FROM refs r JOIN classified h ON h.dataset_id = home_dataset AND h.field = home_field JOIN classified c ON c.dataset_id = child_dataset AND c.field = child_field"
    " JOIN sole s ON s.dataset_id = child_dataset WHERE h.concept = 'Nation.nation_id'",
)
def join_plan(spark, folder):
    h = harvest(spark, folder)
    return questions.join_plan(h.fields, h.datasets, h.references, "Nation.nation_id")


_ENTRY = "field || ':' || role || ':' || coalesce(concept, '-') || ':' || CASE WHEN masked THEN 'masked' ELSE 'shown' END || ':' || coalesce(home_dataset || '.' || home_field, '-')"


@query(
    "schema_index",
    sql(*CLASSIFIED, *HOMES) + f"SELECT dataset_id, any_value(grain) AS grain, max(row_count) AS row_count, string_agg({_ENTRY}, '|' ORDER BY position) AS fields FROM classified c LEFT JOIN refs r ON r.child_dataset = c.dataset_id AND r.child_field = c.field JOIN sole USING (dataset_id) GROUP BY 1",
)
def schema_index(spark, folder):
    h = harvest(spark, folder)
    return questions.schema_index(h.fields, h.datasets, h.references).withColumn("fields", F.array_join("fields", "|"))


@query(
    "describe_dataset",
    sql(*CLASSIFIED, *HOMES) + "SELECT field, position, role, concept, distinct_count, home_dataset || '.' || home_field AS refers_to, r.review_state AS reference_state FROM classified c LEFT JOIN refs r ON r.child_dataset = c.dataset_id AND r.child_field = c.field WHERE dataset_id = 'finance.lineitem'",
)
def describe_dataset(spark, folder):
    h = harvest(spark, folder)
    return questions.describe_dataset(h.fields, h.references, "finance.lineitem").select("field", "position", "role", "concept", "distinct_count", "refers_to", "reference_state")


PROPOSALS = [
    ("finance.lineitem", "l_quantity", "Part", "size", 0.7, 1), ("finance.lineitem", "l_quantity", "Order", "total", 0.9, 2), ("finance.lineitem", "l_tax", "Order", "total", 0.5, 3),
    ("clm.orders", "o_orderkey", "Customer", "customer_id", 0.9, 4), ("finance.lineitem", "l_extendedprice", "Order", "total", 1.0, 5), ("dependency.part", "p_type", "Part", "type", 0.8, 6),
    ("performance.events", "value", "Part", "price", 0.6, 7), ("risk.documents", "lang", "Order", "date", 0.9, 8),
]


ACCEPTED = (
    "accepted AS (SELECT * FROM (VALUES ('finance.lineitem', 'l_quantity', 'Part.size', 0.7), ('finance.lineitem', 'l_extendedprice', 'Order.total', 0.95), ('performance.events', 'value', 'Part.price', 0.6)) a(dataset_id, field, p_concept, p_confidence))"
)
MERGED = (
    "SELECT dataset_id, field, role, coalesce(p_concept, concept) AS concept, CAST(CASE WHEN p_concept IS NOT NULL THEN p_confidence WHEN concept IS NOT NULL THEN 1.0 END AS DOUBLE) AS confidence, CASE WHEN p_concept IS NOT NULL THEN 'proposed' ELSE basis END AS basis,"
    " CASE WHEN (dataset_id, field) IN (('finance.lineitem', 'l_quantity'), ('finance.lineitem', 'l_tax'), ('clm.orders', 'o_orderkey'), ('finance.lineitem', 'l_extendedprice'), ('dependency.part', 'p_type'), ('performance.events', 'value'), ('risk.documents', 'lang')) THEN 'unreviewed' ELSE 'auto' END AS review_state, masked"
    " FROM classified LEFT JOIN accepted USING (dataset_id, field)"
)


def reviewed(spark, h):
    """The classified fields after the proposals."""
    proposals = spark.createDataFrame(PROPOSALS, "dataset_id string, field string, class_id string, property_id string, confidence double, seq int")
    return classify.merge_proposals(h.fields, proposals, VOCABULARY, h.values)


@query("merge_proposals", sql(*CLASSIFIED, ACCEPTED) + MERGED)
def merge_proposals(spark, folder):
    return reviewed(spark, harvest(spark, folder)).select("dataset_id", "field", "role", F.expr("CASE WHEN class_id IS NOT NULL THEN concat_ws('.', class_id, property_id) END").alias("concept"), "confidence", "basis", "review_state", "masked")


PARTIES = "parties AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS supplier, CAST(o_custkey AS VARCHAR) AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IS NOT NULL AND o_custkey IS NOT NULL)"


def parts_sql(fields: str, tag: str) -> tuple[str, str]:
    """Nodes and edges of the catalog whose fields the relation ``fields`` holds."""
    day = lambda c: f"CASE WHEN role = 'date' AND {c} IS NOT NULL THEN '\"{c}\":\"' || {c} || '\",' ELSE '' END"
    quoted = "'[' || string_agg('\"' || child_field || ' -> ' || home_field || '\"', ',' ORDER BY child_field || ' -> ' || home_field) || ']'"
    anchors = "SELECT split_part(concept, '.', 1) || 'Anchor' AS cls, anchor FROM links UNION SELECT 'SupplierAnchor', supplier FROM parties UNION SELECT 'CustomerAnchor', customer FROM parties"
    nodes = (
        f"nodes{tag} AS (SELECT DISTINCT 'catalog' AS branch, 'SourceSystem' AS class_id, system AS identity, '{{}}' AS properties FROM sole UNION ALL SELECT DISTINCT 'catalog', 'BusinessDomain', domain, '{{}}' FROM sole"
        f" UNION ALL SELECT dataset_id, 'Dataset', dataset_id, '{{\"grain\":\"' || any_value(grain) || '\",\"row_count\":' || max(row_count) || '}}' FROM {fields} JOIN sole USING (dataset_id) GROUP BY dataset_id"
        f" UNION ALL SELECT dataset_id, 'DataField', dataset_id || '.' || field, '{{\"position\":' || position || ',\"role\":\"' || role || '\",\"distinct_count\":' || distinct_count || ',' || {day('min_value')} || {day('max_value')} || '\"masked\":' || masked || ',\"review_state\":\"' || review_state || '\"}}' FROM {fields}"
        f" UNION ALL SELECT 'catalog', 'Concept', concept, '{{\"is_key\":' || bool_or(concept IN (SELECT m.concept FROM mapping m WHERE m.is_identifier)) || '}}' FROM {fields} WHERE concept IS NOT NULL GROUP BY concept UNION ALL SELECT 'catalog', cls, anchor, '{{}}' FROM ({anchors}))"
    )
    edges = (
        f"edges{tag} AS (SELECT dataset_id AS branch, 'PUBLISHES' AS type, 'SourceSystem' AS source_class, system AS source, 'Dataset' AS target_class, dataset_id AS target, '{{}}' AS properties FROM sole"
        f" UNION ALL SELECT dataset_id, 'IN_DOMAIN', 'Dataset', dataset_id, 'BusinessDomain', domain, '{{\"basis\":\"source_system\"}}' FROM sole UNION ALL SELECT dataset_id, 'HAS_FIELD', 'Dataset', dataset_id, 'DataField', dataset_id || '.' || field, '{{}}' FROM {fields}"
        f" UNION ALL SELECT dataset_id, 'MAPS_TO', 'DataField', dataset_id || '.' || field, 'Concept', concept, '{{\"basis\":\"' || basis || '\"}}' FROM {fields} WHERE concept IS NOT NULL"
        f" UNION ALL SELECT dataset_id, 'HAS_RECORDS_FOR', 'Dataset', dataset_id, split_part(concept, '.', 1) || 'Anchor', anchor, '{{\"via_field\":\"' || via_field || '\"}}' FROM links"
        f" UNION ALL SELECT child_dataset, 'REFERENCES', 'DataField', child_dataset || '.' || child_field, 'DataField', home_dataset || '.' || home_field, '{{\"containment_pct\":' || containment_pct || ',\"basis\":\"' || basis || '\",\"confidence\":' || confidence || ',\"review_state\":\"' || review_state || '\"}}' FROM refs"
        f" UNION ALL SELECT child_dataset, 'JOINABLE_WITH', 'Dataset', child_dataset, 'Dataset', home_dataset, '{{\"keys\":' || {quoted} || '}}' FROM refs WHERE child_dataset <> home_dataset GROUP BY child_dataset, home_dataset"
        " UNION ALL SELECT 'catalog', 'ANCHOR_PARTY_TO', 'SupplierAnchor', supplier, 'CustomerAnchor', customer, '{}' FROM parties)"
    )
    return nodes, edges


def named_parts(tag: str) -> str:
    return f"parts{tag} AS (SELECT branch, class_id || ' ' || identity AS part, properties FROM nodes{tag} UNION ALL SELECT branch, concat_ws(' ', source_class, source, type, target_class, target), properties FROM edges{tag})"


PAYLOAD = (*CLASSIFIED, *HOMES, LINKS, PARTIES, "before AS (SELECT *, 'auto' AS review_state FROM classified)", *parts_sql("before", ""))


def parties(spark, folder):
    """Suppliers as parties to the customers whose orders they deliver."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    served = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).filter("l_suppkey IS NOT NULL AND o_custkey IS NOT NULL").select("l_suppkey", "o_custkey").distinct()
    return served.select(F.lit("SupplierAnchor").alias("source_class"), F.col("l_suppkey").cast("string").alias("source"), F.lit("CustomerAnchor").alias("target_class"), F.col("o_custkey").cast("string").alias("target"))


def payload(spark, folder):
    """Nodes and edges of the catalog."""
    h = harvest(spark, folder)
    return questions.catalog_graph(h.fields, h.datasets, h.references, links(spark, folder), parties(spark, folder))


@query("catalog_graph", sql(*PAYLOAD) + "SELECT type, source_class, source, target_class, target, properties FROM edges")
def catalog_graph(spark, folder):
    return payload(spark, folder)[1].drop("branch")


@query("catalog_nodes", sql(*PAYLOAD) + "SELECT class_id, identity, properties FROM nodes")
def catalog_nodes(spark, folder):
    return payload(spark, folder)[0].drop("branch")


_FOLDED = (
    named_parts(""), "leaves AS (SELECT branch, ('0x' || substr(sha256(CAST(to_json([branch, part, properties]) AS VARCHAR)), 1, 15))::BIGINT AS leaf FROM parts)",
    "folded AS (SELECT branch, count(*) AS parts, CAST(sum(leaf) AS DECIMAL(38,0)) AS hash_sum, bit_xor(leaf) AS hash_xor FROM leaves GROUP BY branch)",
    "root AS (SELECT CAST(sum(parts) AS BIGINT) AS parts, CAST(sum(hash_sum) AS DECIMAL(38,0)) AS hash_sum, bit_xor(hash_xor) AS hash_xor FROM folded)",
)


@query(
    "catalog_identity",
    sql(*PAYLOAD, *_FOLDED) + "SELECT branch, parts, CAST(hash_sum AS VARCHAR) AS hash_sum, hash_xor, NULL AS run_id FROM folded"
    " UNION ALL SELECT NULL, parts, CAST(hash_sum AS VARCHAR), hash_xor, 'harvest-' || substr(sha256(concat_ws(':', CAST(parts AS VARCHAR), CAST(hash_sum AS VARCHAR), CAST(hash_xor AS VARCHAR))), 1, 16) FROM root",
)
def catalog_identity(spark, folder):
    """Every branch of the hash tree and, without a branch, its root with the run ID."""
    folded = shared_checkpoint(identity.branches(identity.leaves(*payload(spark, folder))))
    return folded.withColumn("run_id", F.lit(None).cast("string")).unionByName(identity.run_id(folded).withColumn("branch", F.lit(None).cast("string")))


_AFTER = (
    ACCEPTED, f"merged AS ({MERGED})", "after AS (SELECT c.* REPLACE (m.role AS role, m.concept AS concept, m.basis AS basis, m.masked AS masked), m.review_state FROM classified c JOIN merged m USING (dataset_id, field))",
    *parts_sql("after", "_after"), named_parts(""), named_parts("_after"),
)


@query(
    "catalog_changes",
    sql(*PAYLOAD, *_AFTER) + "SELECT branch, part, CASE WHEN b.properties IS NULL THEN 'added' WHEN a.properties IS NULL THEN 'removed' ELSE 'changed' END AS change FROM parts b FULL JOIN parts_after a USING (branch, part) WHERE b.properties IS DISTINCT FROM a.properties",
)
def catalog_changes(spark, folder):
    """What the proposals change in the catalog."""
    h = harvest(spark, folder)
    decided = reviewed(spark, h).select(*classify.FIELD, "role", "class_id", "property_id", F.expr("CASE WHEN class_id IS NOT NULL THEN concat_ws('.', class_id, property_id) END").alias("concept"), "basis", "review_state", "masked")
    kept = h.fields.drop(*[c for c in decided.columns if c not in classify.FIELD])
    # Both catalogs know the same anchors; nodes and edges read what is stored, and each leaf is digested and stored once.
    known = (shared_checkpoint(df) for df in (links(spark, folder), parties(spark, folder)))
    anchors = shared_checkpoint(identity.leaves(*questions.anchor_parts(*known)))
    own = (shared_checkpoint(identity.leaves(*questions.field_parts(f, h.datasets, h.references))) for f in (h.fields, kept.join(decided, classify.FIELD)))
    before, after = (leaves.unionByName(anchors) for leaves in own)
    return identity.changes(before, after)
