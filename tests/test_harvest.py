"""Steps of the harvest that must not grow with repeated or neighbouring values."""

from functools import partial

from pyspark.sql import functions as F

from ledgerlens.operators.catalog import classify, profile, references
from ledgerlens.session import shared_checkpoint
from tests.test_catalog import VOCABULARY


def test_references_between_whole_columns_come_from_bit_sets(spark):
    """Children of every type against an integral home: found by sets of 64 neighbours or as texts, with the same result as by texts alone."""
    home = spark.range(-70, 200).select(F.col("id").alias("Vendor_ID"))
    child = spark.range(0, 5000).select(
        (F.col("id") % 270 - 70).cast("int").alias("same"), (F.col("id") % 271 - 70).cast("smallint").alias("one_more"), F.when(F.col("id") > 0, -(F.col("id") % 72)).alias("one_less"),
        (F.col("id") % 90).cast("string").alias("as_text"), (F.col("id") % 90).cast("double").alias("as_double"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("as_date"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("with_gaps"),
    )
    source = {"clm.master": home, "fin.facts": child}
    fields = classify.classify(profile.profile(source), partial(profile.values_of, source), VOCABULARY)
    as_ids = fields.withColumn("role", F.lit("identifier")).withColumn("concept", F.lit("Vendor.vendor_id")).withColumn("class_id", F.lit("Vendor")).withColumn("domain", F.lit("ownership")).withColumn("masked", F.lit(False))
    datasets = spark.createDataFrame([("clm.master", "ownership", "Vendor_ID"), ("fin.facts", "spend", None)], "dataset_id string, domain string, sole_key string")
    candidates = shared_checkpoint(references.candidate_fields(as_ids, datasets))
    found = {how: {r.child_field for r in references.discover_references(candidates, values).collect()} for how, values in (("sets", partial(profile.keyed_values, source)), ("texts", profile.keyed_values(source)))}
    assert found["sets"] == found["texts"] == {"same", "as_text", "with_gaps"}
    asked = spark.createDataFrame([("clm.master", "Vendor_ID", True), ("fin.facts", "same", True), ("fin.facts", "as_text", False)], "dataset_id string, field string, marked boolean")
    keyed = profile.keyed_values(source, asked).groupBy("field").agg(F.count("*").alias("rows"), F.sum(F.bit_count("bits")).alias("values")).collect()
    assert {(r.field, r.rows, r["values"]) for r in keyed} == {("Vendor_ID", 6, 270), ("same", 6, 270), ("as_text", 90, None)}


def test_texts_beside_numbers_and_dates_are_told_apart(spark):
    """The first character is looked at before a pattern is tried; what begins like a number is still tried."""
    columns = {"n": ["-5", "0.5", "12"], "m": ["-5", "5-", "1"], "sign": ["-", "1", "2"], "colon": [":1", "1", "2"], "low": ["+1", "1", "2"], "d": ["2020-01-31", "", None], "e": ["2020-01-31", "-2020-01-31", "1"], "t": ["a", "1", "2"]}
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    rows = {r.field: r for r in profile.profile({"x": df}).collect()}
    assert [c for c in columns if rows[c].is_numeric] == ["n"] and [c for c in columns if rows[c].is_date] == ["d"]


def test_values_are_read_once_each(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("a"), F.lit("").alias("b"))
    asked = spark.createDataFrame([("x", "a"), ("x", "b")], "dataset_id string, field string")
    assert sorted(tuple(r) for r in profile.values_of({"x": df}, asked, distinct=True).collect()) == [("x", "a", v) for v in "012"]


def test_name_mapping_reads_no_keys(spark, small):
    """A catalog works out only what is asked for."""
    from ledgerlens.plans import q_catalog

    made = q_catalog.Harvest(spark, small)
    assert made.profile.count() == 62
    assert "references" not in vars(made) and "fields" not in vars(made)
