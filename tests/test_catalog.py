"""Profiles, shapes, classification and key discovery on small tables."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.text import digit_mask, humanize, is_sensitive, name_tokens, value_shape
from ledgerlens.operators.catalog import classify, profile, references
from ledgerlens.operators.catalog.ontology import BusinessClass, Ontology, Property
from ledgerlens.session import shared_checkpoint

VOCABULARY = Ontology(
    classes=(
        BusinessClass("Vendor", key="vendor_id", id_pattern="V-[0-9]{3}", domain="ownership", properties=(Property("vendor_id", "identifier"), Property("name", "string"))),
        BusinessClass("Contract", key="contract_id", id_pattern="CTR-[0-9]{3}", domain="contracts", properties=(Property("contract_id", "identifier"), Property("end_date", "date"), Property("annual_fee", "decimal", synonyms=("Yearly_Cost",)))),
    ),
)


def test_shapes(spark):
    df = spark.createDataFrame([("V-001",), ("1.5",), ("Budget",), ("a(2)",)], "v string")
    assert [r[0] for r in df.select(value_shape(F.col("v"))).collect()] == [r"^V-\d{3}$", r"^\d{1}\.\d{1}$", "^Budget$", r"^a\(\d{1}\)$"]
    assert [r[0] for r in df.select(digit_mask(F.col("v"))).collect()] == ["V-000", "0.0", "Budget", "a(0)"]
    values = spark.createDataFrame([("d", "a", "V-001"), ("d", "a", "V-020"), ("d", "b", "Budget"), ("d", "b", "Actual"), ("d", "c", "1.5"), ("d", "c", "2.5"), ("d", "e", "x"), ("d", "f", "1"), ("d", "f", "12")], "dataset_id string, field string, value string")
    assert {r.field: r.value_pattern for r in classify.value_patterns(values).collect()} == {"a": r"^V-\d{3}$", "b": None, "c": r"^\d{1}\.\d{1}$", "e": None, "f": None}


def test_names(spark):
    df = spark.createDataFrame([("VendorID",), ("Contract_End_Date",), ("workEmail",), ("EMPLID",), ("Vendor_Name",), ("Date_of_Birth",)], "n string")
    rows = df.select(F.array_join(name_tokens(F.col("n")), "_").alias("t"), is_sensitive(F.col("n")).alias("s"), humanize(F.col("n")).alias("h")).collect()
    assert [r.t for r in rows] == ["vendor_id", "contract_end_date", "work_email", "emplid", "vendor_name", "date_of_birth"]
    assert [r.s for r in rows] == [False, False, True, True, False, True]
    assert rows[1].h == "Contract end date"


def tables(spark):
    master = spark.createDataFrame([("V-001", "Acme", "CTR-001", "2026-01-31"), ("V-002", "Bolt", "CTR-002", "2026-02-28"), ("V-003", "Core", "CTR-003", "2026-03-31")], "Vendor_ID string, Vendor_Name string, Contract_ID string, Contract_End_Date string")
    facts = spark.createDataFrame(
        [("1", "V-001", "CTR-001", "10.5", "CTR-001", "X-01"), ("2", "V-001", "CTR-002", "11.5", "CTR-002", "X-02"), ("3", "V-002", "CTR-002", "", "CTR-009", "X-01")], "record_id string, Supplier string, Contract_ID string, Yearly_Cost string, Legacy_Contract string, Other_ID string"
    )
    return {"clm.master": master, "fin.facts": facts}


@pytest.fixture(scope="module")
def classified(spark):
    source = tables(spark)
    keyed = shared_checkpoint(profile.keyed_values(source))
    prof = shared_checkpoint(profile.profile(source))
    values = profile.all_values(source)
    return prof, values, classify.classify(prof, values, VOCABULARY), keyed


def test_profile_counts_empty_text(classified):
    prof, *_ = classified
    row = prof.filter("field = 'Yearly_Cost'").first()
    assert (row.row_count, row.empty_count, row.distinct_count, row.is_numeric, row.is_unique, row.null_pct, row.max_length) == (3, 1, 2, True, False, 33.33, 4)
    assert prof.filter("field = 'Contract_End_Date'").first().is_date and prof.filter("field = 'Vendor_ID'").first().is_unique


def test_distinct_counts_are_exact_for_every_kind(spark):
    """Signs, block borders, extremes, half units, times, empty and long texts, against plain distinct texts."""
    from datetime import date, datetime
    from decimal import Decimal

    long_text = "x" * 31
    rows = [
        (i if i % 5 else None, [-(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65][i % 8], (i % 7) / 4 - 0.00005 * (i % 3), date(1969, 12, 1 + i % 28), datetime(2020, 1, 1, 0, 0, 0, i % 6), ["", "a", long_text, long_text + "x", long_text + "y", None][i % 6], i % 3 == 0, Decimal(i % 9) / 10, None)
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "a int, b bigint, c double, d date, e timestamp_ntz, f string, g boolean, h decimal(20,2), nothing string")
    got = {r.field: r.distinct_count for r in profile.distinct_counts({"x": df, "y": df.limit(0)}).collect()}
    want = {f.name: df.select(profile.as_text(f).alias("t")).filter("t <> ''").distinct().count() for f in profile.text_fields(df)}
    assert got == {name: n for name, n in want.items() if n}
    assert profile.profile({"x": df}).filter("field = 'nothing'").first().distinct_count == 0


def test_statistics_of_numbers_and_dates_are_those_of_their_texts(spark):
    """Signs, lengths, half units, extremes and odd years, against plain texts; shapes without a sort of the values."""
    rows = [
        ([-(2**63), 2**63 - 1, -1, 0, 9, 10, -10, -9, 100, None][i % 10], 100 + i, [0.00005, -0.00005, 2.5, 9.99995, 10.0, -0.0, 1e9 + 0.5, 123456.78905, None][i % 9], i / 100, [f"{y:04}-12-{1 + i % 28:02}" for y in (1, 1969, 9999)][i % 3])
        for i in range(270)
    ]
    df = spark.createDataFrame(rows, "a bigint, b int, c double, d double, e string").withColumn("e", F.col("e").cast("date")).withColumn("f", F.make_date(F.lit(9999) + F.col("b"), F.lit(1), F.lit(2)))
    df = df.withColumn("g", F.col("c").cast("float")).withColumn("h", F.lit(None).cast("int"))
    prof = profile.profile({"x": df})
    got = {r.field: r for r in prof.collect()}
    for f in profile.text_fields(df):
        texts = [r.t for r in df.select(profile.as_text(f).alias("t")).collect()]
        some = [t for t in texts if t is not None]
        row = got[f.name]
        want = (len(texts), len(texts) - len(some), len(set(some)), min(some, default=None), max(some, default=None), max(map(len, some), default=0))
        assert (row.row_count, row.empty_count, row.distinct_count, row.min_value, row.max_value, row.max_length) == want, f.name
        masks = {"".join("0" if c.isdigit() else c for c in t) for t in some}
        assert (row.one_shape, row.is_numeric) == ((len(masks) == 1, f.name not in "ef") if some else (None, False)), f.name
    facts = classify.value_facts(partial(profile.values_of, {"x": df.withColumn("v", F.lit("V-001"))}), shared_checkpoint(profile.profile({"x": df.withColumn("v", F.lit("V-001"))})), VOCABULARY)
    day = r"-\d{2}-\d{2}$"
    assert {r.field: r.value_pattern for r in facts.filter("value_pattern IS NOT NULL").collect()} == {"b": r"^\d{3}$", "d": r"^\d{1}\.\d{4}$", "e": r"^\d{4}" + day, "f": r"^\+\d{5}" + day, "v": r"^V-\d{3}$"}
    assert "SortAggregate" not in facts._jdf.queryExecution().sparkPlan().toString()


def test_classification_by_name_then_by_value(classified):
    _, _, fields, _ = classified
    got = {(r.dataset_id, r.field): (r.role, r.concept) for r in fields.collect()}
    assert got[("clm.master", "Vendor_ID")] == ("identifier", "Vendor.vendor_id") and got[("fin.facts", "Supplier")] == ("identifier", "Vendor.vendor_id")
    assert got[("clm.master", "Contract_End_Date")] == ("date", "Contract.end_date")
    assert got[("fin.facts", "Legacy_Contract")] == ("identifier", "Contract.contract_id") and got[("fin.facts", "Yearly_Cost")] == ("measure", "Contract.annual_fee")
    assert got[("fin.facts", "Other_ID")] == ("identifier", None) and got[("fin.facts", "record_id")][0] == "identifier"


def test_references_need_full_containment(spark, classified):
    _, _, fields, keyed = classified
    datasets = spark.createDataFrame([("clm.master", "ownership", "Vendor_ID"), ("fin.facts", "spend", "record_id")], "dataset_id string, domain string, sole_key string")
    refs = references.discover_references(references.candidate_fields(fields, datasets), keyed)
    found = {(r.child_field, r.home_field, r.basis, r.confidence, r.review_state) for r in refs.collect()}
    assert found == {("Supplier", "Vendor_ID", "concept", 1.0, "auto"), ("Contract_ID", "Contract_ID", "concept", 1.0, "auto")}
    assert references.dataset_links(refs).first()["keys"] == ["Contract_ID -> Contract_ID", "Supplier -> Vendor_ID"]


def test_case_collisions_are_unreviewed(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([("Acme", "V-001"), ("Bolt", "V-002")], "Vendor_ID string, VENDOR_ID string")
        source = {"wf.people": df.select("Vendor_ID", "VENDOR_ID")}
        fields = classify.classify(profile.profile(source), profile.all_values(source), VOCABULARY)
        rows = {r.field: (r.name_collision, r.concept, r.confidence, r.review_state) for r in fields.collect()}
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")
    assert rows["VENDOR_ID"] == (True, "Vendor.vendor_id", 0.5, "unreviewed") and rows["Vendor_ID"][:2] == (True, None)


def test_proposals_never_override_and_stay_unreviewed(spark, classified):
    _, values, fields, _ = classified
    rows = [("fin.facts", "Other_ID", "Vendor", "vendor_id", 0.9, 1), ("clm.master", "Vendor_ID", "Contract", "contract_id", 0.9, 2), ("clm.master", "Vendor_Name", "Vendor", "name", 0.99, 3), ("clm.master", "Vendor_Name", "Vendor", "name", 0.7, 4)]
    merged = {r.field: r for r in classify.merge_proposals(fields, spark.createDataFrame(rows, "dataset_id string, field string, class_id string, property_id string, confidence double, seq int"), VOCABULARY, values).filter("dataset_id <> 'fin.facts' OR field = 'Other_ID'").collect()}
    assert merged["Other_ID"].class_id is None and merged["Other_ID"].review_state == "unreviewed"
    assert merged["Vendor_ID"].class_id == "Vendor" and merged["Vendor_ID"].confidence == 1.0


def test_keys_of_any_length_are_found(spark):
    """Keys far longer than a line are shapes, identifiers and references like short ones."""
    for length in (5, 101, 301, 5000):
        key = lambda i: f"V-{i:03d}" + "x" * (length - 5)
        home = spark.createDataFrame([(key(i), f"n{i}") for i in range(20)], "Vendor_ID string, label string")
        child = spark.createDataFrame([(key(i % 7), str(i)) for i in range(30)], "Ref string, n string")
        source = {"clm.master": home, "fin.facts": child}
        keyed = partial(profile.keyed_values, source)
        fields = classify.classify(profile.profile(source), partial(profile.values_of, source), VOCABULARY)
        shapes = {r.field: r.value_pattern for r in fields.collect()}
        assert shapes["Vendor_ID"] == r"^V-\d{3}" + "x" * (length - 5) + "$"
        as_ids = fields.withColumn("role", F.when(F.col("field").isin("Vendor_ID", "Ref"), "identifier").otherwise(F.col("role"))).withColumn("value_pattern", F.when(F.col("field").isin("Vendor_ID", "Ref"), "p")).withColumn("concept", F.lit(None).cast("string"))
        datasets = spark.createDataFrame([("clm.master", "ownership", "Vendor_ID"), ("fin.facts", "spend", None)], "dataset_id string, domain string, sole_key string")
        refs = references.discover_references(references.candidate_fields(as_ids, datasets), keyed).collect()
        assert [(r.child_field, r.home_field) for r in refs] == [("Ref", "Vendor_ID")], length


def test_catalog_queries_work_after_release(spark, small):
    import __spark_entry__ as entry
    from ledgerlens.session import release

    before = sorted(map(str, entry.queries()["describe_dataset"](spark, small).collect()))
    release(spark)
    assert sorted(map(str, entry.queries()["describe_dataset"](spark, small).collect())) == before


def test_catalog_identity_ignores_order_and_finds_changes(spark):
    from ledgerlens.operators.catalog import identity

    node_rows = [("d1", "Dataset", "d1", "{}"), ("d1", "DataField", "d1.a", '{"role":"text"}'), ("d2", "Dataset", "d2", "{}"), ("catalog", "Concept", "C.x", "{}")]
    edge_rows = [("d1", "HAS_FIELD", "Dataset", "d1", "DataField", "d1.a", "{}"), ("catalog", "ANCHOR_PARTY_TO", "A", "1", "B", "1", "{}")]
    as_nodes = lambda rows: spark.createDataFrame(rows, "branch string, class_id string, identity string, properties string")
    as_edges = lambda rows: spark.createDataFrame(rows, "branch string, type string, source_class string, source string, target_class string, target string, properties string")
    run = lambda n, e: identity.run_id(identity.branches(identity.leaves(as_nodes(n), as_edges(e)))).first()
    first = run(node_rows, edge_rows)
    assert first.parts == 6 and first.run_id == run(node_rows[::-1], edge_rows[::-1]).run_id
    changed = [node_rows[0], ("d1", "DataField", "d1.a", '{"role":"date"}'), ("d1", "DataField", "d1.b", "{}"), node_rows[2]]
    assert run(changed, edge_rows).run_id != first.run_id
    before, after = identity.leaves(as_nodes(node_rows), as_edges(edge_rows)), identity.leaves(as_nodes(changed), as_edges(edge_rows))
    found = {(r.branch, r.part, r.change) for r in identity.changes(before, after).collect()}
    assert found == {("d1", "DataField d1.a", "changed"), ("d1", "DataField d1.b", "added"), ("catalog", "Concept C.x", "removed")}
    assert identity.changes(before, before).count() == 0 and run([], []).parts == 0
