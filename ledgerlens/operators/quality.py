"""Data-quality rules. A rule yields one row per violation; an empty report means a valid snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.dates import parse_iso_date


def text_key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def row_rules(df: DataFrame, table: str, key: Sequence[str], rules: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Check rules that need only the row itself, all in one pass: ``{rule: (violated, detail)}``."""
    found = F.array_compact(
        F.array(
            *[
                F.when(violated, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
                for name, (violated, detail) in rules.items()
            ]
        )
    )
    return (
        df.select(text_key(key).alias("record_key"), found.alias("found"))
        .select("record_key", F.inline("found"))
        .select("rule", F.lit(table).alias("table_name"), "record_key", "detail")
    )


def report(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ row rules
def pattern_rule(column: str, pattern: str) -> tuple[Column, Column]:
    """The whole value must match; NULL is a violation."""
    value = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return ~value.rlike(f"^(?:{pattern})\\z"), F.concat(F.lit(f"{column}="), value)


def interval_rule(start: str, end: str) -> tuple[Column, Column]:
    return F.col(start) > F.col(end), F.concat(F.col(start).cast("string"), F.lit(" > "), F.col(end).cast("string"))


def enum_rule(column: str, allowed: Sequence) -> tuple[Column, Column]:
    value = F.col(column)
    return value.isNull() | ~value.isin(*allowed), F.concat(F.lit(f"{column}="), F.coalesce(value.cast("string"), F.lit("")))


def missing_status_rule(status: str, carried: Sequence[str]) -> tuple[Column, Column]:
    """A Missing assessment must not carry a tier or a date."""
    carries = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in carried])
    return (F.col(status) == "Missing") & carries, F.concat_ws(",", *[F.col(c).cast("string") for c in carried])


def nonnegative_rule(columns: Sequence[str]) -> tuple[Column, Column]:
    negative = [F.when(F.col(c) < 0, F.lit(c)) for c in columns]
    return F.coalesce(F.least(*[F.col(c) for c in columns]) < 0 if len(columns) > 1 else F.col(columns[0]) < 0, F.lit(False)), F.concat_ws(",", *negative)


# ---------------------------------------------------------------- table rules
def single_value(df: DataFrame, table: str, column: str) -> DataFrame:
    """One snapshot date over a whole table: a violation row names the two extremes."""
    value = F.col(column).cast("string")
    return (
        df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
        .filter(~F.col("low").eqNullSafe(F.col("high")))
        .select(F.lit("single_snapshot").alias("rule"), F.lit(table).alias("table_name"), F.lit(column).alias("record_key"), F.concat_ws(" .. ", "low", "high").alias("detail"))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def content_hash(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 256)


def dedupe_conflicts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: rows, and whether they are one record or conflicting ones.

    Identical rows count once. Rows that differ under one key are a conflict. The least and greatest
    content hash decide, so no group is ever collected.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.withColumn("_hash", content_hash(rest))
        .groupBy(*keys)
        .agg(F.count("*").alias("row_count"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high"))
        .select(*keys, "row_count", (F.col("_low") != F.col("_high")).alias("conflict"))
    )


# ----------------------------------------------------------------- join rules
def conformance_violations(fact: DataFrame, master: DataFrame, table: str, key: str, record: Sequence[str], shared: Mapping[str, str]) -> DataFrame:
    """Every fact row must meet a master row and agree with it on the shared columns.

    ``shared`` maps fact columns to master columns. Spark broadcasts the master when its size allows.
    """
    right = master.select(F.col(key).alias("_key"), *[F.col(m).alias(f"_m_{m}") for m in sorted(set(shared.values()))])
    joined = fact.join(right, fact[key] == right["_key"], "left")
    rules = {"missing_master": (F.col("_key").isNull(), F.col(key))}
    for mine, theirs in shared.items():
        differs = F.col("_key").isNotNull() & ~F.col(mine).eqNullSafe(F.col(f"_m_{theirs}"))
        rules[f"mismatch_{mine}"] = (differs, F.concat_ws(" <> ", F.col(mine).cast("string"), F.col(f"_m_{theirs}").cast("string")))
    return row_rules(joined, table, record, rules)


def orphans(child: DataFrame, parent: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Child rows whose non-empty reference has no parent."""
    right = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(keys.values())])
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    condition = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(keys)])
    return child.filter(present).join(right, condition, "left_anti")


def keyset_coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return (
        a.join(b, list(keys), "full_outer")
        .filter(F.col("_l").isNull() | F.col("_r").isNull())
        .select(*keys, F.when(F.col("_r").isNull(), "left_only").otherwise("right_only").alias("side"))
    )


# ------------------------------------------------------- typed record checks
def _number(value: Column) -> Column:
    return value.rlike(r"^-?[0-9]+(\.[0-9]+)?\z") & (F.abs(value.try_cast("double")) < float("inf"))


def _whole(value: Column) -> Column:
    """A whole number in the signed 64-bit range."""
    return value.rlike(r"^-?[0-9]+\z") & value.try_cast("long").isNotNull()


#: What a value of each datatype must be, in order, and the code of a value that is not.
DATATYPES: dict[str, tuple] = {
    "string": (),
    "text": ((lambda v: v != "", "empty_value"),),
    "identifier": ((lambda v: v != "", "empty_value"),),
    "integer": ((_whole, "not_a_whole_number"),),
    "money_cents": ((_whole, "not_a_whole_number"),),
    "decimal": ((_number, "not_a_number"),),
    "percentage": ((_number, "not_a_number"), (lambda v: v.try_cast("decimal(38,10)").between(0, 100), "out_of_range")),
    "boolean": ((lambda v: v.isin("true", "false"), "not_a_boolean"),),
    "date": ((lambda v: parse_iso_date(v).isNotNull(), "not_a_date"),),
    "year_month": ((lambda v: v.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])\z"), "not_a_month"),),
}


def property_error(value: Column, rule: Mapping) -> Column:
    """The code of the first condition of a property rule that a textual value misses, else NULL.

    A rule has ``datatype`` and optionally ``required``, ``pattern`` and ``enum``. NULL is no value. Text at
    rest cannot tell an empty string from none, so it is none as well, except for texts and identifiers.
    """
    conditions = list(DATATYPES[rule["datatype"]])
    if rule.get("pattern"):
        conditions.append((lambda v: v.rlike(f"^(?:{rule['pattern']})\\z"), "pattern_mismatch"))
    if rule.get("enum") is not None:
        conditions.append((lambda v: v.isin(*rule["enum"]), "value_not_allowed"))
    missing = value.isNull() if rule["datatype"] in ("text", "identifier") else F.coalesce(value, F.lit("")) == ""
    codes = [F.when(~F.coalesce(holds(value), F.lit(False)), code) for holds, code in conditions]
    return F.when(missing, F.lit("missing_value" if rule.get("required") else None)).otherwise(F.coalesce(*codes, F.lit(None).cast("string")))


def field_error(df: DataFrame, field: str, rule: Mapping) -> Column:
    """``property_error`` of a column that holds one value, or with ``many`` a list of values."""
    value, is_list = F.col(field), df.schema[field].dataType.typeName() == "array"
    if is_list != bool(rule.get("many")):
        return F.when(value.isNotNull(), "not_a_list" if rule.get("many") else "is_a_list")
    if not is_list:
        return property_error(value.cast("string"), rule)
    each = F.transform(value.cast("array<string>"), lambda v: F.when(v.isNull(), "null_element").otherwise(property_error(v, rule)))
    none = F.when(value.isNull(), F.lit("missing_value" if rule.get("required") else None))
    return F.coalesce(none, F.get(F.array_compact(each), F.lit(0)))


def record_validation(df: DataFrame, class_id: str, key: Sequence[str], properties: Mapping[str, Mapping], allow_unmapped: bool = False, abstract: bool = False) -> DataFrame:
    """Validate flat records against property rules; field names may be property names or synonyms.

    An abstract class has no records of its own: each one is an error without a field.
    """
    label_of = {label: name for name, rule in properties.items() for label in (name, *rule.get("synonyms", ()))}
    given = {field: label_of.get(field) for field in df.columns}
    errors = {field: field_error(df, field, properties[name]) for field, name in given.items() if name is not None}
    if not allow_unmapped:
        errors |= {field: F.lit("unknown_field") for field, name in given.items() if name is None and field not in key}
    errors |= {name: F.lit("missing_field") for name, rule in properties.items() if rule.get("required") and name not in given.values()}
    listed = [F.when(error.isNotNull(), F.struct(F.lit(field).alias("field"), error.alias("error"))) for field, error in errors.items()]
    if abstract:
        listed.append(F.struct(F.lit(None).cast("string").alias("field"), F.lit("abstract_class").alias("error")))
    found = df.select(text_key(key).alias("record_key"), F.inline(F.array_compact(F.array(*listed))))
    return found.select(F.lit(class_id).alias("class_id"), "record_key", "field", "error")
