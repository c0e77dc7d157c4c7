"""Readers, writers, governed SQL and claim checks on files and texts made here."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import grounding, quality, ranking, risk
from ledgerlens.operators.governed import GovernedDataset, GovernedSession
from ledgerlens.sources import sinks, tables


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_csv_snapshot_keeps_empty_text_lines_and_namespace(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'NS,Vendor_ID,Note\nn1,V-001,"two\nlines"\n\nn1,V-002,\nn2,V-003,x\n', "utf-8-sig")
    df = tables.read_csv_snapshot(spark, path, "master", ["Vendor_ID"], "n1", "NS")
    assert [(r.Vendor_ID, r.Note, r._source_line) for r in df.orderBy("_source_line").collect()] == [("V-001", "two\nlines", 2), ("V-002", "", 3)]


@pytest.mark.parametrize("text", ["a,b\n1\n", "a,b\n1,2,3\n"])
def test_csv_snapshot_fails_on_malformed_rows(spark, tmp_path, text):
    with pytest.raises(Exception):
        tables.read_csv_snapshot(spark, write(tmp_path / "x.csv", text), "x").collect()


@pytest.mark.parametrize("text", ["a,a\n1,2\n", "a,_source_line\n1,2\n", "b\n1\n"])
def test_csv_snapshot_rejects_bad_headers(spark, tmp_path, text):
    with pytest.raises(tables.SnapshotError):
        tables.read_csv_snapshot(spark, write(tmp_path / "x.csv", text), "x", ["a"])


def test_nested_documents_and_payload(spark, tmp_path):
    doc = write(tmp_path / "d.json", json.dumps({"vendor_id": "V-001", "records": [{"line": "a", "cents": 1}, {"line": "b", "cents": 2}]}))
    rows = tables.read_documents(spark, doc, "vendor_id string, records array<struct<line:string,cents:bigint>>", "records", ["vendor_id"]).collect()
    assert [(r.vendor_id, r.line, r.cents) for r in rows] == [("V-001", "a", 1), ("V-001", "b", 2)]
    payload = {"namespace": "n", "ontology_version": "1", "entities": [{"class_id": "Vendor", "properties": {"vendor_id": "V-001"}, "revision": 1}], "relationships": [{"type": "PARTY_TO", "source": {"class_id": "Vendor", "identity": "V-001"}, "target": {"class_id": "Contract", "identity": "C"}}]}
    entities, relationships = tables.read_graph_payload(spark, write(tmp_path / "p.json", json.dumps(payload)))
    assert entities.first().properties == {"vendor_id": "V-001"} and relationships.first().target.identity == "C"


def test_digest_ignores_order_and_counts_duplicates(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None)], "k string, v string")
    b = spark.createDataFrame([("2", None), ("1", "x")], "k string, v string")
    digest = lambda df: tuple(sinks.content_digest(df, "t").first())
    assert digest(a) == digest(b) == digest(a.withColumn("_source_line", F.lit(1)))
    assert digest(a) != digest(a.unionByName(a.limit(1))) and digest(a) != digest(a.withColumnRenamed("v", "w"))


def test_load_is_idempotent_and_repairs_changed_copies(spark, tmp_path):
    source = {"a": spark.range(5).withColumnRenamed("id", "x"), "b": spark.range(3).withColumnRenamed("id", "y")}
    target = str(tmp_path / "t")
    assert sinks.load(spark, source, target) == {"a": "loaded", "b": "loaded"}
    assert sinks.load(spark, source, target) == {"a": "unchanged", "b": "unchanged"}
    source["b"] = spark.range(4).withColumnRenamed("id", "y")
    assert sinks.load(spark, source, target) == {"a": "unchanged", "b": "loaded"}
    spark.range(9).withColumnRenamed("id", "x").write.mode("overwrite").parquet(f"{target}/a")
    assert sinks.load(spark, source, target) == {"a": "loaded", "b": "unchanged"}
    checked = sinks.verify_copy(sinks.digests(source), sinks.digests({n: spark.read.parquet(f"{target}/{n}") for n in source})).collect()
    assert all(r.table_present and r.columns_match and r.row_count_match and r.content_match for r in checked)


def test_replace_namespace_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "g")
    spark.createDataFrame([("business", "k1"), ("catalog-a", "old")], "namespace string, key string").write.partitionBy("namespace").parquet(path)
    sinks.replace_namespace(spark.createDataFrame([("catalog-a", "new")], "namespace string, key string"), path, "catalog-")
    assert sorted((r.namespace, r.key) for r in spark.read.parquet(path).collect()) == [("business", "k1"), ("catalog-a", "new")]
    with pytest.raises(ValueError):
        sinks.replace_namespace(spark.createDataFrame([("business", "x")], "namespace string, key string"), path, "catalog-")


def test_upsert_stops_on_stale_records(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x")], "key string, revision bigint, content string")
    new = spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "key string, revision bigint, content string")
    assert sinks.upsert(old, new, F.col("content"), str(tmp_path / "n")) == {"update": 1, "insert": 1}
    with pytest.raises(ValueError):
        sinks.upsert(spark.read.parquet(str(tmp_path / "n")), old.withColumn("content", F.lit("w")), F.col("content"), str(tmp_path / "m"))


def test_governed_session_hides_and_refuses(spark):
    people = lambda s: s.createDataFrame([("n1", "E1", "US"), ("n2", "E2", "IN")], "ns string, EMPLID string, country string")
    governed = GovernedSession(spark, {"people": GovernedDataset(people, ("EMPLID",), ("ns", "n1"))})
    assert [r.country for r in governed.query("SELECT country FROM people").collect()] == ["US"]
    assert governed.query("SELECT * FROM people").columns == ["ns", "country"]
    for bad in ("SELECT EMPLID FROM people", "SELECT * FROM other", "DROP TABLE people", "CREATE TABLE t AS SELECT 1", "SELECT current_date()", "SELECT now() FROM people"):
        with pytest.raises(Exception):
            governed.query(bad).collect()
    assert governed.query("SELECT 'now' AS word FROM people").first().word == "now"


def test_governed_session_decides_by_what_resolves(spark, small):
    spark.range(3).createOrReplaceGlobalTempView("ungoverned")
    spark.range(3).write.mode("overwrite").saveAsTable("ungoverned_table")
    read = lambda s: s.read.parquet(f"{small}/customer.parquet").withColumn("now", F.lit("x"))
    governed = GovernedSession(spark, {"customer": GovernedDataset(read, ("c_name",))})
    try:
        for bad in (
            f"SELECT c_name FROM parquet.`{small}/customer.parquet`", f"SELECT * FROM parquet.`{small}/documents.parquet`", "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM customer",
            "SELECT unix_timestamp() FROM customer", "SELECT current_date FROM customer", "SELECT current_user FROM customer", "SELECT user FROM customer", "SELECT * FROM global_temp.ungoverned",
            "SELECT * FROM ungoverned_table", "SELECT * FROM default.ungoverned_table", "SELECT * FROM range(5)", "VALUES (1)", "SELECT TRANSFORM(c_custkey) USING 'cat' AS (a) FROM customer",
            "WITH q AS (SELECT c_custkey FROM customer) SELECT * FROM q WHERE EXISTS (SELECT current_timestamp FROM customer)", "WITH q AS (SELECT * FROM ungoverned_table) SELECT * FROM q",
            "SELECT c_name FROM customer", "SELECT input_file_name() FROM customer", "SELECT rand() FROM customer", "SELECT explode(array(1)) FROM customer",
        ):
            with pytest.raises(Exception):
                governed.query(bad).collect()
    finally:
        spark.sql("DROP TABLE ungoverned_table")
        spark.catalog.dropGlobalTempView("ungoverned")
    assert governed.query("SELECT now FROM customer LIMIT 1").first().now == "x"
    assert governed.query("WITH q AS (SELECT c_custkey + 1 AS k FROM customer WHERE c_custkey BETWEEN 1 AND 2) SELECT upper('a') || k AS t FROM q ORDER BY 1").first().t == "A2"
    rows, more = governed.fetch("SELECT c_custkey FROM customer ORDER BY c_custkey DESC", 4)
    assert [r[0] for r in rows] == [149, 148, 147, 146] and more and governed.fetch("SELECT c_custkey FROM customer LIMIT 4", 4)[1] is False
    with pytest.raises(ValueError):
        governed.fetch("SELECT c_custkey FROM customer", 501)


def test_bounded_fetch(spark):
    df = spark.range(20).selectExpr("19 - id AS id", "'x' AS v")
    found = ranking.bounded_fetch(df, ["id"], 5).collect()
    assert [r.id for r in found] == [0, 1, 2, 3, 4] and all(r.truncated for r in found)
    assert [r.truncated for r in ranking.bounded_fetch(df.limit(5), ["id"], 5).collect()] == [False] * 5


def facts(spark):
    cards = [("F1", "V-001: contract expires 2026-12-27 (90 days); USD 1,200.50."), ("F2", "V-002: variance USD -7.00 (5.10%).")]
    return spark.createDataFrame(cards, "card_id string, text string")


CLAIMS = [
    ("V-001 expires on 2026-12-27 in 90 days at 1200.5.", []), ("V-001 ends December 27, 2026 [F1].", []), ("V-001 ends 28th Dec 2026.", [("unsupported_date", "2026-12-28", "")]),
    ("It is worth 1,200.51.", [("unsupported_number", "1200.51", "")]), ("It is down 7.", [("unsupported_number", "7", "F2")]), ("V-009 expires in 90 days.", [("unsupported_id", "V-009", "")]),
    ("V-002 expires in 90 days.", []), ("We recommend V-001.", [("recommendation", "", "")]), ("The year is 2026, month 12.", []), ("It moved -90.", [("unsupported_number", "-90", "")]),
]


def test_claims_are_checked_against_cited_cards(spark):
    claims = spark.createDataFrame([(i, claim) for i, (claim, _) in enumerate(CLAIMS)], "claim_id int, text string")
    cited = spark.createDataFrame([(i, "F1") for i in range(len(CLAIMS))], "claim_id int, card_id string")
    got = {}
    for r in grounding.unsupported_claims(claims, facts(spark), cited).collect():
        got.setdefault(r.claim_id, []).append((r.problem, r.value, r.held_by))
    for i, (claim, problems) in enumerate(CLAIMS):
        assert sorted(got.get(i, [])) == sorted(problems), claim


def test_mentions(spark):
    master = spark.createDataFrame([("V-001", "Aurelix Codeworks"), ("V-002", "Velmora Cloud"), ("V-003", "Aurelix Cloud")], "vendor_id string, vendor_name string")
    mentions = spark.createDataFrame([("v-001",), ("velmora cloud",), ("Aurelix",), ("cloud",), ("nobody",), ("Codework",)], "mention string")
    got = {r.mention: (r.status, r.resolved_id, r.candidate_count) for r in grounding.resolve_mentions(mentions, master).collect()}
    assert got == {
        "v-001": ("resolved", "V-001", 1), "velmora cloud": ("resolved", "V-002", 1), "aurelix": ("clarification", None, 2), "cloud": ("clarification", None, 2), "nobody": ("not_found", None, 0), "codework": ("clarification", None, 1),
    }


def test_record_rules(spark):
    rules = {"id": {"datatype": "identifier", "required": True, "pattern": r"V-\d{3}", "synonyms": ["Vendor"]}, "pct": {"datatype": "percentage"}, "day": {"datatype": "date"}, "month": {"datatype": "year_month"}, "flag": {"datatype": "boolean"}, "fee": {"datatype": "money_cents"}}
    good = ("V-001", "99.5", "2024-02-29", "2024-12", "true", "12")
    bad = ("V-1", "100.1", "2023-02-29", "2024-13", "yes", "1.5")
    df = spark.createDataFrame([good, bad], "Vendor string, pct string, day string, month string, flag string, fee string")
    found = quality.record_validation(df, "Vendor", ["Vendor"], rules).collect()
    assert {r.record_key for r in found} == {"V-1"} and sorted(r.field for r in found) == ["Vendor", "day", "fee", "flag", "month", "pct"]


def test_record_lists_empties_and_ranges(spark):
    rules = {"id": {"datatype": "identifier"}, "note": {"datatype": "text"}, "n": {"datatype": "integer"}, "x": {"datatype": "decimal"}, "tags": {"datatype": "integer", "many": True, "required": True}, "one": {"datatype": "string"}}
    rows = [("a", "ok", "9223372036854775807", "1.5", ["1", "2"], ["x"]), ("", "", "9223372036854775808", "9" * 400, ["1", None], None), ("b", None, "", "1e5", ["1", "z"], None), ("c", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, note string, n string, x string, tags array<string>, one array<string>")
    found = {(r.record_key, r.field): r.error for r in quality.record_validation(df, "Thing", ["id"], rules).collect()}
    assert found == {
        ("a", "one"): "is_a_list", ("", "id"): "empty_value", ("", "note"): "empty_value", ("", "n"): "not_a_whole_number", ("", "x"): "not_a_number", ("", "tags"): "null_element",
        ("b", "x"): "not_a_number", ("b", "tags"): "not_a_whole_number", ("c", "tags"): "missing_value",
    }
    abstract = quality.record_validation(df.select("id"), "Thing", ["id"], {"id": rules["id"]}, abstract=True).collect()
    assert [r.error for r in abstract].count("abstract_class") == 4


def test_contradictions_compare_trimmed_text(spark):
    observed = spark.createDataFrame([("C1", " 2026-01-01 ", "A"), ("C2", "", "B")], "contract_id string, end_date string, owner string")
    certified = spark.createDataFrame([("C1", "2026-01-01", "Z"), ("C2", "2026-02-02", "B")], "contract_id string, end_date string, owner string")
    got = risk.contradictions(observed, certified, "contract_id", {"end_date": "Contract.end_date", "owner": "Contract.owner"}).collect()
    assert [(r.contract_id, r.concept, r.observed_value, r.certified_value) for r in got] == [("C1", "Contract.owner", "A", "Z")]


def test_digest_sees_every_column(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    one = lambda c: F.when(F.col("o_orderkey") == 5, c)
    changed = [
        orders.withColumn("o_totalprice", F.coalesce(one(F.col("o_totalprice") + 0.01), "o_totalprice")),
        orders.withColumn("o_orderdate", F.coalesce(one(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")), "o_orderdate")),
        orders.withColumn("o_orderpriority", F.coalesce(one(F.lit("x")), "o_orderpriority")),
    ]
    digest = lambda df: sinks.content_digest(df, "orders").first()
    before = digest(orders)
    assert digest(orders.repartition(7)) == before and all(digest(df).hash_sum != before.hash_sum for df in changed)
    lists = [spark.createDataFrame([(1, v)], "id int, v array<float>") for v in ([1.0, None], [None, 1.0], [1.0], None)]
    assert len({digest(df).hash_sum for df in lists}) == 4


def test_summaries_and_questions(spark):
    claims = spark.createDataFrame([(1, "Spend was 100."), (2, "Spend was 200."), (3, "Spend was 100 and 200, and 300 is asked.")], "claim_id int, text string")
    cards = spark.createDataFrame([(10, "USD 100"), (20, "USD 200")], "card_id int, text string")
    citations = spark.createDataFrame([(1, 10), (2, 20)], "claim_id int, card_id int")
    answers = spark.createDataFrame([(1, 3), (2, 3)], "claim_id int, summary_id int")
    cited = grounding.summary_citations(citations, answers)
    assert [(r.claim_id, r.value) for r in grounding.unsupported_claims(claims, cards, cited).collect()] == [(3, "300")]
    questions = spark.createDataFrame([(3, "Is 300 right?")], "claim_id int, text string")
    assert grounding.unsupported_claims(claims, cards, cited, questions=questions).count() == 0


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, newline):
    r = random.Random(5)
    pieces = ["plain", "", 'with "quotes"', "a, comma", "two\nlines", 'x\n"\n\n,",\ny', "5 in", 'back\\slash"', "\n" * 40, "Ä ö " * 30]
    rows = [[r.choice(pieces) + str(i) * (i % 3), r.choice(pieces), r.choice(pieces)] for i in range(2000)]
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(["a", "b", "c"])
    for i, row in enumerate(rows):
        writer.writerow(row)
        if i % 50 == 0:
            buffer.write("\n")
    path = tmp_path / "large.csv"
    path.write_bytes(("﻿" + buffer.getvalue()).replace("\n", newline).encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "4k" if n.endswith("maxPartitionBytes") else "0")
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
        got = tables.read_csv_snapshot(spark, str(path), "large").orderBy("_source_line").collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert [[x.a, x.b, x.c] for x in got] == rows
    assert [x._source_line for x in got] == list(range(2, len(rows) + 2))
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)).na.fill("").collect()
    assert sorted((x[0], x[1], x[2]) for x in whole) == sorted(map(tuple, rows))


def test_stray_and_unclosed_quotes(spark, tmp_path):
    df = tables.read_csv_snapshot(spark, write(tmp_path / "stray.csv", 'a,b\n5" pipe,x\n"y\nz",6" pipe\n'), "x").orderBy("_source_line")
    assert [tuple(x)[:2] for x in df.collect()] == [('5" pipe', "x"), ("y\nz", '6" pipe')]
    with pytest.raises(tables.SnapshotError, match="unclosed"):
        tables.read_csv_snapshot(spark, write(tmp_path / "open.csv", 'a,b\n1,"x\n2,y\n'), "x")
