"""Foreign keys from values: which identifier columns are contained in which key column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.catalog.classify import FIELD, Values, read_values
from ledgerlens.operators.catalog.profile import whole_kind
from ledgerlens.session import shared_checkpoint

MIN_DISTINCT = 2


def candidate_fields(fields: DataFrame, datasets: DataFrame) -> DataFrame:
    """Identifier columns that can take part, with their group (concept, else value pattern) and home ranking.

    ``datasets`` has dataset_id, domain and sole_key (the single primary-key column, or NULL).
    """
    taking_part = fields.filter((F.col("role") == "identifier") & ~F.col("masked") & (F.col("distinct_count") >= MIN_DISTINCT))
    group = F.when(F.col("concept").isNotNull(), F.concat(F.lit("concept:"), F.col("concept"))).when(F.col("value_pattern").isNotNull(), F.concat(F.lit("pattern:"), F.col("value_pattern")))
    shape = fields.groupBy("dataset_id").agg(F.bool_or(F.col("role") == "measure").alias("is_fact"), F.count("*").alias("width"))
    described = fields.filter("class_id IS NOT NULL").select("dataset_id", "class_id", "property_id").distinct().groupBy("dataset_id", "class_id").agg(F.count("*").alias("described"))
    joined = taking_part.withColumn("key_group", group).filter("key_group IS NOT NULL").join(datasets.withColumnRenamed("domain", "dataset_domain"), "dataset_id").join(shape, "dataset_id")
    return joined.join(described, ["dataset_id", "class_id"], "left")


def home_rank() -> list[Column]:
    """The least of these wins: sole primary key, reference table, own domain, most properties, narrowest, stable order."""
    return [
        F.coalesce(F.col("sole_key") != F.col("field"), F.lit(True)), F.col("is_fact"), ~F.coalesce(F.col("domain") == F.col("dataset_domain"), F.lit(False)),
        -F.coalesce(F.col("described"), F.lit(0)), F.col("width"), F.col("dataset_id"), F.col("field"),
    ]


def home_keys(candidates: DataFrame) -> DataFrame:
    """The home key of each group: the best ranked column that is unique in its dataset."""
    best = F.row_number().over(Window.partitionBy("key_group").orderBy(*home_rank()))
    return candidates.filter("is_unique").withColumn("_rank", best).filter("_rank = 1").drop("_rank")


def discover_references(candidates: DataFrame, values: Values) -> DataFrame:
    """Columns whose values all occur in their group's home key. ``values`` has the distinct (dataset_id, field,
    key) of :func:`profile.keyed_values`, or is a function that reads those of the columns named by a frame, so
    that only columns of a group with a home are read. Values of any length take part. A function also gets, in
    ``marked``, which columns it can give as bit sets (key, bits): those whose whole keys are of the home's kind.

    One join on (group, key): each child value meets at most one home value, so the work is linear in
    the distinct values.
    """
    candidates = shared_checkpoint(candidates)
    homes = home_keys(candidates).select("key_group", F.col("dataset_id").alias("home_dataset"), F.col("field").alias("home_field"), F.col("basis").alias("home_basis"), F.col("review_state").alias("home_state"), whole_kind(F.col("data_type")).alias("home_kind"))
    members = candidates.join(homes, "key_group").filter(~((F.col("dataset_id") == F.col("home_dataset")) & (F.col("field") == F.col("home_field"))))
    members = members.withColumn("marked", F.coalesce(whole_kind(F.col("data_type")) == F.col("home_kind"), F.lit(False)))
    if isinstance(values, DataFrame):
        members, keyed = members.withColumn("marked", F.lit(False)), values.select(*FIELD, "key", F.lit(None).cast("long").alias("bits"))
    # Each home once as its members need it. A home without other members is not read.
    home_fields = members.select(F.col("home_dataset").alias("dataset_id"), F.col("home_field").alias("field"), "key_group", "marked").distinct()
    if not isinstance(values, DataFrame):
        # Keys are stored, as children and homes both read them.
        keyed = shared_checkpoint(read_values(values, members.select(*FIELD, "marked").unionByName(home_fields.select(*FIELD, "marked"))))
    keyed = keyed.withColumn("marked", F.col("bits").isNotNull())
    # Columns and homes are as many as the tables have columns.
    child_values = keyed.join(F.broadcast(members.select(*FIELD, "key_group", "marked")), [*FIELD, "marked"])
    home_values = keyed.join(F.broadcast(home_fields), [*FIELD, "marked"]).select("key_group", "marked", "key", F.col("bits").alias("home_bits"))
    common = F.coalesce(F.bit_count(F.col("bits").bitwiseAND(F.col("home_bits"))), F.lit(1))
    matched = child_values.join(home_values, ["key_group", "marked", "key"]).groupBy(*FIELD).agg(F.sum(common).alias("matched"))
    by_concept = F.col("key_group").startswith("concept:")
    auto = (F.col("basis") == "classifier") & (F.col("home_basis") == "classifier") & (F.col("review_state") == "auto") & (F.col("home_state") == "auto")
    return (
        members.join(matched, FIELD).filter(F.col("matched") == F.col("distinct_count"))
        .select(
            F.col("dataset_id").alias("child_dataset"), F.col("field").alias("child_field"), "home_dataset", "home_field", F.lit(100.0).alias("containment_pct"),
            F.when(by_concept, "concept").otherwise("pattern").alias("basis"), F.when(by_concept & auto, 1.0).when(by_concept, 0.9).otherwise(0.8).alias("confidence"),
            F.when(by_concept & auto, "auto").otherwise("unreviewed").alias("review_state"),
        )
    )


def dataset_links(references: DataFrame) -> DataFrame:
    """Dataset pairs joined by references between different datasets, with their "child -> key" pairs in order."""
    across = references.filter(F.col("child_dataset") != F.col("home_dataset"))
    pair = F.concat_ws(" -> ", "child_field", "home_field")
    return across.groupBy("child_dataset", "home_dataset").agg(F.array_sort(F.collect_set(pair)).alias("keys"))


def anchor_links(values: DataFrame, fields: DataFrame, anchors: DataFrame) -> DataFrame:
    """Known keys (concept, anchor) that occur in a dataset, with the earliest field that carries each."""
    mapped = fields.filter("concept IS NOT NULL AND review_state = 'auto'").select(*FIELD, "concept", "position")
    present = values.join(mapped, FIELD).join(anchors.select("concept", F.col("anchor").alias("value")), ["concept", "value"], "left_semi")
    return present.groupBy("dataset_id", "concept", F.col("value").alias("anchor")).agg(F.min_by("field", "position").alias("via_field"))
