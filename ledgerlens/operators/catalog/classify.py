"""Deterministic column classification from names and values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import digit_mask, humanize, is_sensitive, name_tokens, value_shape
from ledgerlens.operators.catalog.ontology import Ontology
from ledgerlens.session import shared_checkpoint

FIELD = ["dataset_id", "field"]
MAX_VALUE_SET = 20
MAX_CATEGORY_LENGTH = 40
# Name tokens of period columns, and the property datatypes each role accepts.
PERIOD_TOKENS = ("year", "month", "quarter", "period")
COMPATIBLE = {
    "identifier": ("identifier",), "date": ("date",), "measure": ("integer", "decimal", "percentage", "money_cents"),
    "dimension": ("string", "boolean", "year_month"), "text": ("string", "text"),
}


#: Values of columns: a frame (dataset_id, field, value), or a function that reads the columns named by a frame, each value once if ``distinct``.
Values = DataFrame | Callable[..., DataFrame]


def read_values(values: Values, fields: DataFrame) -> DataFrame:
    return values if isinstance(values, DataFrame) else values(fields)


def read_distinct(values: Values, fields: DataFrame) -> DataFrame:
    """Every value of the named columns once. There is one name per column of the tables."""
    return values.join(F.broadcast(fields.select(*FIELD)), FIELD, "left_semi").distinct() if isinstance(values, DataFrame) else values(fields, distinct=True)


def value_patterns(values: DataFrame) -> DataFrame:
    """One shape per column, when all its values share it and it has digits; two aggregates decide, no set is built."""
    mask = F.sha2(digit_mask(F.col("value")), 256)
    shaped = values.groupBy(*FIELD).agg((F.min(mask) == F.max(mask)).alias("one"), F.min("value").alias("least"))
    shape = value_shape(F.col("least"))
    return shaped.select(*FIELD, F.when(F.col("one") & F.contains(shape, F.lit(r"\d")), shape).alias("value_pattern"))


def class_tests(value: Column, ontology: Ontology) -> dict[str, Column]:
    """Per class with an identifier pattern: whether the whole value matches it."""
    return {c.id: value.rlike(f"^(?:{c.id_pattern})\\z") for c in ontology.classes if c.id_pattern}


def identifier_aggregates(value: Column, ontology: Ontology) -> tuple[Column, Column]:
    """Aggregates over a column's values: all are some identifier, and the one class they all name and no other.

    Both are built from boolean aggregates, which combine on the map side in a hash table.
    """
    tests = class_tests(value, ontology)
    matches = sum((t.cast("int") for t in tests.values()), F.lit(0))
    only = F.coalesce(*[F.when(F.bool_and(t & (matches == 1)), F.lit(name)) for name, t in tests.items()])
    return F.bool_and(matches > 0), only


def identifier_by_values(values: DataFrame, ontology: Ontology) -> DataFrame:
    """Per column: whether every value is some identifier, and the class when all values name exactly that one."""
    every, only = identifier_aggregates(F.col("value"), ontology)
    return values.groupBy(*FIELD).agg(every.alias("all_identifiers"), only.alias("value_class"))


def value_facts(values: Values, profile: DataFrame, ontology: Ontology) -> DataFrame:
    """Identifier facts and the shared shape of every column that has values, in one pass over its values.

    A column whose least or greatest value is no identifier, and whose two have different digit masks, can
    have neither, so only the other columns are read, and columns whose profile tells the shape only for
    identifiers. Values share a shape if all have the digit mask of the least; truth values combine on the map side.
    Identifier patterns are tried only on columns whose least and greatest value are identifiers.
    """
    identifier = lambda name: reduce(Column.__or__, class_tests(F.col(name), ontology).values(), F.lit(False))
    named = identifier("min_value") & identifier("max_value")
    known = F.col("one_shape") if "one_shape" in profile.columns else F.lit(None).cast("boolean")
    likely = named | (known.isNull() & (digit_mask(F.col("min_value")) == digit_mask(F.col("max_value"))))
    # One row per column: as many as the tables have columns.
    candidates = profile.filter(likely).select(*FIELD, digit_mask(F.col("min_value")).alias("_mask"), F.coalesce(named, F.lit(False)).alias("_named"))
    every, only = identifier_aggregates(F.when(F.col("_named"), F.col("value")), ontology)
    rows = read_values(values, candidates).join(F.broadcast(candidates), FIELD)
    facts = rows.groupBy(*FIELD).agg(every.alias("all_identifiers"), only.alias("value_class"), F.bool_and(digit_mask(F.col("value")) == F.col("_mask")).alias("_one"))
    shape = value_shape(F.col("min_value"))
    joined = profile.filter("distinct_count > 0").select(*FIELD, "min_value", known.alias("_known")).join(F.broadcast(facts), FIELD, "left")
    one = F.coalesce("_known", "_one")
    return joined.select(*FIELD, F.coalesce("all_identifiers", F.lit(False)).alias("all_identifiers"), "value_class", F.when(one & F.contains(shape, F.lit(r"\d")), shape).alias("value_pattern"))


def name_mapping(fields: DataFrame, ontology: Ontology) -> DataFrame:
    """Property named by a column name: longest class prefix and then property or synonym, else a unique full name.

    A name that leads to more than one property maps to none.
    """
    spark = fields.sparkSession
    named = fields.select(*FIELD, name_tokens(F.col("field")).alias("parts"))
    # Every split of the tokens into a class prefix and the rest; the rest may repeat the last prefix token.
    splits = named.filter(F.size("parts") > 1).select("*", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"))
    splits = splits.withColumn("label", F.array_join(F.slice("parts", 1, F.col("n")), "_"))
    joined = splits.join(ontology.class_labels(spark), "label")
    rest = F.array_join(F.slice("parts", F.col("n") + 1, F.size("parts")), "_")
    longer = F.array_join(F.slice("parts", F.col("n"), F.size("parts")), "_")
    ranked = joined.select(*FIELD, "n", "class_id", "key_property", F.posexplode(F.array(rest, longer)).alias("turn", "rest"))
    labels = ontology.property_labels(spark).select("class_id", F.col("label").alias("rest"), "property_id")
    unique_labels = labels.groupBy("class_id", "rest").agg(F.min("property_id").alias("property_id"), F.count("*").alias("k")).filter("k = 1").drop("k")
    by_rest = ranked.join(unique_labels, ["class_id", "rest"], "left").withColumn(
        "found", F.when((F.col("turn") == 0) & (F.col("rest") == "id") & F.col("key_property").isNotNull(), F.col("key_property")).otherwise(F.col("property_id"))
    ).filter("found IS NOT NULL")
    first = by_rest.groupBy(*FIELD, "n", "class_id").agg(F.min_by("found", "turn").alias("property_id"))
    longest = first.groupBy(*FIELD).agg(F.max("n").alias("n"))
    hits = first.join(longest, [*FIELD, "n"])
    qualified = hits.groupBy(*FIELD).agg(F.count("*").alias("k"), F.min("class_id").alias("class_id"), F.min("property_id").alias("property_id"))
    full = named.select(*FIELD, F.array_join("parts", "_").alias("label")).join(ontology.unqualified_labels(spark), "label")
    unqualified = full.groupBy(*FIELD).agg(F.count("*").alias("uk"), F.min("class_id").alias("u_class"), F.min("property_id").alias("u_property"))
    both = named.select(*FIELD).join(qualified, FIELD, "left").join(unqualified, FIELD, "left")
    use_full = F.col("k").isNull() & (F.col("uk") == 1)
    return both.select(
        *FIELD, F.when(F.col("k") == 1, F.col("class_id")).when(use_full, F.col("u_class")).alias("class_id"),
        F.when(F.col("k") == 1, F.col("property_id")).when(use_full, F.col("u_property")).alias("property_id"),
    ).filter("class_id IS NOT NULL")


def semantic_role(mapped_datatype: Column) -> Column:
    """identifier, date, measure, dimension or text from a profile row and the datatype of its mapping, if any."""
    period = F.arrays_overlap(name_tokens(F.col("field")), F.array(*[F.lit(t) for t in PERIOD_TOKENS]))
    return (
        F.when(mapped_datatype == "identifier", "identifier")
        .when(F.upper("field").endswith("ID") | F.coalesce(F.col("all_identifiers"), F.lit(False)), "identifier")
        .when(F.col("is_date"), "date")
        .when(F.col("is_numeric"), F.when(period, "dimension").otherwise("measure"))
        .when((F.col("distinct_count") > 0) & (F.col("distinct_count") <= MAX_VALUE_SET) & (F.col("max_length") <= MAX_CATEGORY_LENGTH), "dimension")
        .otherwise("text")
    )


def compatible(candidates: DataFrame, values: Values, ontology: Ontology) -> DataFrame:
    """Candidates (dataset_id, field, role, class_id, property_id) whose datatype fits the role and whose values all satisfy the property."""
    rules = ontology.property_rules(candidates.sparkSession)
    ruled = candidates.join(rules, ["class_id", "property_id"])
    accepts = None
    for role, datatypes in COMPATIBLE.items():
        test = (F.col("role") == role) & F.col("datatype").isin(*datatypes)
        accepts = test if accepts is None else accepts | test
    ruled = ruled.filter(accepts)
    whole = lambda p: F.concat(F.lit("^(?:"), p, F.lit(")\\z"))
    checked = ruled.filter("pattern IS NOT NULL OR key_pattern IS NOT NULL OR enum_values IS NOT NULL").select(*FIELD, "class_id", "property_id", "pattern", "key_pattern", "enum_values")
    # Rules per column: bounded by columns times properties.
    violating = read_values(values, checked).join(F.broadcast(checked), FIELD).filter(
        ~F.coalesce(F.rlike(F.col("value"), whole(F.col("pattern"))), F.lit(True))
        | ~F.coalesce(F.rlike(F.col("value"), whole(F.col("key_pattern"))), F.lit(True))
        | ~F.coalesce(F.array_contains("enum_values", F.col("value")), F.lit(True))
    )
    return ruled.join(violating.select(*FIELD, "class_id", "property_id").distinct(), [*FIELD, "class_id", "property_id"], "left_anti")


def classify(profile: DataFrame, values: Values, ontology: Ontology) -> DataFrame:
    """Final classification of every column.

    A name match is tried first, then a value match; either must be compatible with the values. Names
    that differ only by case are flagged and never mapped at full confidence.
    """
    spark = profile.sparkSession
    facts = shared_checkpoint(value_facts(values, profile, ontology))
    base = profile.join(facts, FIELD, "left")
    keys = spark.createDataFrame([(c.id, c.key) for c in ontology.classes if c.key], "class_id string, property_id string")
    from_names = name_mapping(profile, ontology).withColumn("turn", F.lit(0))
    from_values = facts.filter("value_class IS NOT NULL").select(*FIELD, F.col("value_class").alias("class_id")).join(keys, "class_id").withColumn("turn", F.lit(1))
    rules = ontology.property_rules(spark)
    candidates = from_names.unionByName(from_values).join(rules.select("class_id", "property_id", "datatype"), ["class_id", "property_id"])
    # Tables of one row per column are stored where several later steps read them.
    with_role = shared_checkpoint(candidates.join(base, FIELD).select(*FIELD, "class_id", "property_id", "turn", semantic_role(F.col("datatype")).alias("role")))
    fitting = shared_checkpoint(compatible(with_role, values, ontology))
    chosen = fitting.groupBy(*FIELD).agg(F.min_by(F.struct("class_id", "property_id", "datatype", "pii", "is_key", "domain", "business_name"), "turn").alias("m")).select(*FIELD, "m.*")
    collision = F.count("*").over(Window.partitionBy("dataset_id", F.lower("field"))) > 1
    joined = base.withColumn("name_collision", collision).join(chosen, FIELD, "left")
    mapped = F.col("class_id").isNotNull()
    result = joined.withColumn("role", semantic_role(F.col("datatype")))
    result = result.withColumn("masked", is_sensitive(F.col("field")) | F.coalesce(F.col("pii"), F.lit(False)))
    shown = ~F.col("masked")
    patterned = shared_checkpoint(result.withColumn("value_pattern", F.when(F.col("role").isin("identifier", "date", "dimension"), F.col("value_pattern"))))
    small = patterned.filter(shown & (F.col("role") == "dimension") & F.col("distinct_count").between(1, MAX_VALUE_SET)).select(*FIELD)
    sets = read_distinct(values, small).groupBy(*FIELD).agg(F.array_sort(F.collect_set("value")).alias("value_set"))
    classified = patterned.join(sets, FIELD, "left").select(
        *FIELD, "position", "data_type", "row_count", "distinct_count", "null_pct", "is_unique", "min_value", "max_value", "role", "class_id", "property_id",
        F.when(mapped, F.concat_ws(".", "class_id", "property_id")).alias("concept"), F.coalesce("is_key", F.lit(False)).alias("is_key"), "domain",
        F.when(mapped, F.when(F.col("name_collision"), 0.5).otherwise(1.0)).alias("confidence"),
        F.when(mapped & F.col("name_collision"), "unreviewed").otherwise("auto").alias("review_state"),
        F.when(mapped, "classifier").otherwise("none").alias("basis"), "name_collision", "masked",
        F.coalesce("business_name", humanize(F.col("field"))).alias("business_name"), F.when(shown, F.col("value_pattern")).alias("value_pattern"), "value_set",
    )
    # One row per column, read by every later catalog step.
    return shared_checkpoint(classified)


def merge_proposals(fields: DataFrame, proposals: DataFrame, ontology: Ontology, values: Values, low: float = 0.6, high: float = 0.95) -> DataFrame:
    """Apply proposed mappings (dataset_id, field, class_id, property_id, confidence, seq).

    The first proposal of a column counts. It never overrides a deterministic mapping, must reach the
    lower confidence bound and be compatible; it is capped at the upper bound and stays unreviewed. A
    mapping to a personal property masks the column and takes its values out of the catalog.
    """
    first = proposals.groupBy(*FIELD).agg(F.min_by(F.struct("class_id", "property_id", "confidence"), "seq").alias("p")).select(*FIELD, "p.*").filter(F.col("confidence").between(low, 1.0))
    open_fields = fields.filter(F.col("basis") != "classifier").select(*FIELD, "role")
    fitting = compatible(first.join(open_fields, FIELD), values, ontology).select(
        *FIELD, F.col("class_id").alias("p_class"), F.col("property_id").alias("p_property"), F.round(F.least(F.col("confidence"), F.lit(high)), 2).alias("p_confidence"), F.col("pii").alias("p_pii")
    )
    accepted = F.col("p_class").isNotNull()
    touched = proposals.select(*FIELD).distinct().withColumn("proposed", F.lit(True))
    masked = F.col("masked") | F.coalesce("p_pii", F.lit(False))
    return fields.join(fitting, FIELD, "left").join(touched, FIELD, "left").select(
        *FIELD, "role", F.coalesce("p_class", "class_id").alias("class_id"), F.coalesce("p_property", "property_id").alias("property_id"),
        F.coalesce("p_confidence", "confidence").alias("confidence"), F.when(accepted, "proposed").otherwise(F.col("basis")).alias("basis"),
        F.when(F.col("proposed"), "unreviewed").otherwise(F.col("review_state")).alias("review_state"),
        masked.alias("masked"), F.when(~masked, F.col("value_set")).alias("value_set"), F.when(~masked, F.col("value_pattern")).alias("value_pattern"),
    )
