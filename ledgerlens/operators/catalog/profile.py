"""Column profiles and distinct values.

Statistics of texts that combine on the map side (counts, extremes, lengths, all-numeric, all-date) come from one
wide aggregate per table; those of numbers and dates follow from the keys of the distinct count. Exact distinct counts come from a second pass. Whole numbers, dates, times and
fixed-point amounts are marked in bit sets of 64 neighbours, so dense keys shuffle one row per 64 values.
Other values shuffle as themselves while they are short and as their digest beyond that, so values of any
length are counted. Only columns that can be keys are stored value by value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import digit_mask

NUMERIC = "^-?[0-9]+([.][0-9]+)?$"
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
STATS = "struct<empty_count: bigint, min_value: string, max_value: string, max_length: int, all_numeric: boolean, all_dates: boolean>"


def as_text(field: T.StructField) -> Column:
    """The text of a value at rest; fractional numbers carry four places."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.cast("decimal(18,4)").cast("string")
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value.cast("string")


def text_fields(df: DataFrame) -> list[T.StructField]:
    """Fields with a scalar value; arrays, maps and structs have no text at rest."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return [f for f in df.schema if not isinstance(f.dataType, nested) and not f.name.startswith("_source_")]


def long_values(df: DataFrame, dataset_id: str) -> DataFrame:
    """(dataset_id, field, value) for every non-empty value of every scalar column."""
    pairs = F.array(*[F.struct(F.lit(f.name).alias("field"), as_text(f).alias("value")) for f in text_fields(df)])
    return df.select(F.lit(dataset_id).alias("dataset_id"), F.inline(pairs)).filter(F.col("value") != "")


def value_key(value: Column) -> Column:
    """What stands for a value of any length: itself below 32 bytes, else the 32 bytes of its digest."""
    return F.when(F.octet_length(value) < 32, value.cast("binary")).otherwise(F.unhex(F.sha2(value, 256)))


def whole_key(field: T.StructField) -> Column | None:
    """A 64-bit number that two values share exactly if their texts are equal; None where there is no such number."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.IntegralType):
        return value.cast("long")
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        # Most doubles are far from the middle of two steps, where one multiplication rounds as the decimal does.
        scaled = value.cast("double") * 10000
        near = (F.abs(value) < 1e9) & (F.abs(scaled - F.rint(scaled)) < 0.49)
        return F.when(near, F.rint(scaled).cast("long")).otherwise((value.cast("decimal(18,4)") * 10000).cast("long"))
    return None


def whole_class(key: Column, data_type: Column) -> Column:
    """A class of the whole keys of a column, an interval: inside one, texts have one digit mask, and their order is that of the keys or its reverse."""
    day = F.date_from_unix_date(key.cast("int"))
    usual = day.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date"))
    return F.when(data_type == "date", F.when(usual, 1_000_000_000).otherwise(F.year(day))).otherwise(F.length(key.cast("string")) * 2 + (key < 0).cast("int"))


def whole_text(key: Column, data_type: Column) -> Column:
    """The text at rest of a whole key of a column of the named type."""
    fraction = (key.cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)").cast("string")
    day = F.when(data_type == "date", F.date_from_unix_date(key.cast("int")).cast("string"))
    return F.when(data_type.isin("double", "float"), fraction).otherwise(F.coalesce(day, key.cast("string")))


def whole_kind(data_type: Column) -> Column:
    """What the whole keys of a named type count. Inside a kind, keys are equal where texts are; texts of two kinds never are. NULL for other types."""
    integral, fraction = data_type.isin("tinyint", "smallint", "int", "bigint"), data_type.isin("double", "float")
    return F.when(integral, "integral").when(fraction, "fraction").when(data_type == "date", "date")


def key_marks(entries: DataFrame, *more: Column) -> DataFrame:
    """Whole keys (column_no, key) as bit sets of 64 neighbours: column_no, block, bits."""
    return entries.groupBy("column_no", F.shiftright("key", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, CAST(key & 63 AS INT)))").alias("bits"), *more)


def stats_sql(field: T.StructField, text: str) -> str:
    """The statistics of one text column as a struct. Typed columns need no pattern matching, nor do texts with another first character."""
    present = f"nullif({text}, '')"
    numeric, dates = (f"({present} >= '{first}' AND {present} < ':' AND {present} RLIKE '{pattern}')" for first, pattern in (("-", NUMERIC), ("0", ISO_DATE)))
    if isinstance(field.dataType, T.NumericType):
        numeric, dates = f"{present} IS NOT NULL", "false"
    elif isinstance(field.dataType, T.DateType):
        numeric, dates = "false", f"{present} IS NOT NULL"
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        numeric = dates = "false"
    every = lambda test: f"coalesce(bool_and(CASE WHEN {present} IS NOT NULL THEN {test} END), false)"
    return (
        f"struct(count_if({present} IS NULL) AS empty_count, min({present}) AS min_value, max({present}) AS max_value, coalesce(max(length({text})), 0) AS max_length,"
        f" {every(numeric)} AS all_numeric, {every(dates)} AS all_dates)"
    )


def column_stats(df: DataFrame, dataset_id: str) -> DataFrame:
    """One row per column from one aggregate without a shuffle of values; statistics of whole columns are NULL here."""
    fields = text_fields(df)
    read = [(i, f) for i, f in enumerate(fields) if whole_key(f) is None]
    texts = df.select(*[as_text(f).alias(f"t{i}") for i, f in read])
    wide = texts.selectExpr("count(*) AS row_count", *[f"{stats_sql(f, f't{i}')} AS c{i}" for i, f in read])
    wide = wide.selectExpr("*", f"CAST(NULL AS {STATS}) AS c")
    text = {i for i, _ in read}
    rows = ", ".join(f"struct('{f.name}' AS field, {i + 1} AS position, '{f.dataType.simpleString()}' AS data_type, {f'CAST(c{i} AS {STATS})' if i in text else 'c'} AS stats)" for i, f in enumerate(fields))
    return wide.selectExpr(f"'{dataset_id}' AS dataset_id", "row_count", f"inline(array({rows}))").selectExpr("dataset_id", "row_count", "field", "position", "data_type", "stats.*")


def numbered(columns: list[tuple[str, T.StructField]], spark: SparkSession) -> tuple[dict, DataFrame]:
    """A number for each (dataset, field), so that a shuffled row is short, and the frame that names them again."""
    number = {(d, f.name): i for i, (d, f) in enumerate(columns)}
    return number, spark.createDataFrame([(number[d, f.name], d, f.name, f.dataType.simpleString()) for d, f in columns], "column_no int, dataset_id string, field string, _type string")


def all_values(tables: dict[str, DataFrame], fields: dict[str, list[str]] | None = None) -> DataFrame:
    """(dataset_id, field, value) of all tables, or of the chosen columns, as one frame."""
    parts = []
    for dataset_id, df in tables.items():
        if fields is None:
            parts.append(long_values(df, dataset_id))
        elif fields.get(dataset_id):
            parts.append(long_values(df.select(*[f"`{c}`" for c in fields[dataset_id]]), dataset_id))
    return reduce(DataFrame.unionByName, parts)


def keyed_values(tables: dict[str, DataFrame], fields: DataFrame | None = None) -> DataFrame:
    """Distinct (dataset_id, field, key) of all columns, or of those named by a frame with one row per column.

    Where the frame says so in a column ``marked``, whole columns come as bit sets of 64 neighbours: key is then the
    text of the set's number and ``bits`` the set; ``bits`` is NULL for single values.
    """
    if fields is None or "marked" not in fields.columns:
        values = all_values(tables) if fields is None else values_of(tables, fields)
        return values.select("dataset_id", "field", value_key(F.col("value")).alias("key")).distinct()
    single = keyed_values(tables, fields.filter("NOT marked").select("dataset_id", "field")).withColumn("bits", F.lit(None).cast("long"))
    chosen = {(r.dataset_id, r.field) for r in fields.filter("marked").select("dataset_id", "field").distinct().collect()}
    if not chosen:
        return single
    columns = [(d, f) for d, df in tables.items() for f in text_fields(df) if (d, f.name) in chosen]
    number, names = numbered(columns, fields.sparkSession)
    parts = []
    for dataset_id in dict.fromkeys(d for d, _ in columns):
        entries = [F.struct(F.lit(number[d, f.name]).alias("column_no"), whole_key(f).alias("key")) for d, f in columns if d == dataset_id]
        parts.append(tables[dataset_id].select(F.inline(F.array(*entries))).filter("key IS NOT NULL"))
    marks = key_marks(reduce(DataFrame.unionAll, parts)).join(F.broadcast(names), "column_no")
    return single.unionByName(marks.select("dataset_id", "field", F.col("block").cast("string").cast("binary").alias("key"), "bits"))


def distinct_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset_id, field, distinct_count) of every scalar column with a value, exact, with the statistics of whole columns.

    Columns are numbered, so a shuffled row is a number and a key. A whole key is a bit in the set of its 64
    neighbours: a dense column shuffles a 64th of its values, a sparse one as many short rows as it has values.
    The least and the greatest key of each class give the extremes of the texts, so no text is made for a row.
    """
    number, names = numbered([(dataset_id, f) for dataset_id, df in tables.items() for f in text_fields(df)], next(iter(tables.values())).sparkSession)
    whole, other = [], []
    for dataset_id, df in tables.items():
        fields = [(number[dataset_id, f.name], f, whole_key(f)) for f in text_fields(df)]
        numbers = [F.struct(F.lit(n).alias("column_no"), key.alias("key")) for n, f, key in fields if key is not None]
        texts = [F.struct(F.lit(n).alias("column_no"), value_key(F.nullif(as_text(f), F.lit(""))).alias("key")) for n, f, key in fields if key is None]
        for entries, parts in ((numbers, whole), (texts, other)):
            if entries:
                parts.append(df.select(F.inline(F.array(*entries))).filter("key IS NOT NULL"))
    counted = []
    if whole:
        marks = key_marks(reduce(DataFrame.unionAll, whole), F.count("*").alias("n")).join(F.broadcast(names), "column_no")
        # The ends of a set are those of its binary number.
        marks = marks.withColumn("_bin", F.bin("bits")).withColumns(
            {"least": F.shiftleft("block", 6) + (F.length("_bin") - F.length(F.rtrim("_bin", F.lit("0")))), "most": F.shiftleft("block", 6) + (F.length("_bin") - 1)}
        )
        # A set of neighbours is in one class but for the few sets with a border of classes inside; those are taken key by key.
        one = whole_class(F.col("least"), F.col("_type")) == whole_class(F.col("most"), F.col("_type"))
        entry = lambda least, most, n, d: F.struct(least.alias("least"), most.alias("most"), n.alias("n"), d.alias("d"))
        marked = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
        each = F.transform(marked, lambda i, at: entry(F.shiftleft("block", 6) + i, F.shiftleft("block", 6) + i, F.when(at == 0, F.col("n")).otherwise(0), F.lit(1)))
        entries = marks.select("column_no", "_type", F.inline(F.when(one, F.array(entry(F.col("least"), F.col("most"), F.col("n"), F.bit_count("bits")))).otherwise(each)))
        classes = entries.groupBy("column_no", "_type", whole_class(F.col("least"), F.col("_type")).alias("class")).agg(
            F.sum("d").alias("d"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
        )
        ends = classes.select("column_no", "d", "n", whole_text(F.col("least"), F.col("_type")).alias("a"), whole_text(F.col("most"), F.col("_type")).alias("b"))
        counted.append(
            ends.groupBy("column_no").agg(
                F.sum("d").alias("distinct_count"), F.sum("n").alias("_present"), F.min(F.least("a", "b")).alias("_min"), F.max(F.greatest("a", "b")).alias("_max"),
                F.max(F.greatest(F.length("a"), F.length("b"))).alias("_length"), (F.min(digit_mask(F.col("a"))) == F.max(digit_mask(F.col("a")))).alias("one_shape"),
            )
        )
    if other:
        counted.append(reduce(DataFrame.unionAll, other).distinct().groupBy("column_no").agg(F.count("*").alias("distinct_count")))
    for name, kind in (("_present", "long"), ("_min", "string"), ("_max", "string"), ("_length", "int"), ("one_shape", "boolean")):
        counted = [c if name in c.columns else c.withColumn(name, F.lit(None).cast(kind)) for c in counted]
    return reduce(DataFrame.unionByName, counted).join(names, "column_no").drop("column_no", "_type")


def values_of(tables: dict[str, DataFrame], fields: DataFrame, distinct: bool = False) -> DataFrame:
    """(dataset_id, field, value), repeats included unless ``distinct``, of the columns named by a frame with one row per column.

    The names come to the driver: there are as many as the tables have columns.
    """
    chosen: dict[str, list[str]] = {}
    for row in fields.select("dataset_id", "field").distinct().collect():
        chosen.setdefault(row.dataset_id, []).append(row.field)
    if not chosen:
        return all_values(tables).limit(0)
    return (distinct_values if distinct else all_values)({d: tables[d] for d in chosen}, chosen)


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Profile of every column of every table, with null percentage and candidate-key flag.

    ``one_shape`` tells whether all texts of a whole column have one digit mask; for other columns it is NULL.
    """
    stats = reduce(DataFrame.unionByName, [column_stats(df, d) for d, df in tables.items()])
    counts = distinct_counts(tables)
    joined = stats.join(counts, ["dataset_id", "field"], "left").fillna(0, ["distinct_count"])
    has_values = F.col("distinct_count") > 0
    # Whole columns have no statistics from texts: theirs follow from the keys, and from the type.
    joined = joined.withColumns(
        {
            "empty_count": F.coalesce("empty_count", F.col("row_count") - F.coalesce("_present", F.lit(0))), "min_value": F.coalesce("min_value", "_min"), "max_value": F.coalesce("max_value", "_max"),
            "max_length": F.coalesce("max_length", "_length", F.lit(0)), "all_numeric": F.coalesce("all_numeric", F.col("data_type") != "date"), "all_dates": F.coalesce("all_dates", F.col("data_type") == "date"),
        }
    )
    real_dates = F.try_to_date(F.col("min_value"), "yyyy-MM-dd").isNotNull() & F.try_to_date(F.col("max_value"), "yyyy-MM-dd").isNotNull()
    return joined.select(
        "dataset_id", "field", "position", "data_type", "row_count", "empty_count", "distinct_count", "min_value", "max_value", "max_length",
        (F.col("all_numeric") & has_values).alias("is_numeric"), F.when(F.col("all_dates") & has_values, real_dates).otherwise(False).alias("is_date"),
        F.when(F.col("row_count") > 0, F.round(F.col("empty_count") * 100 / F.col("row_count"), 2)).otherwise(0.0).alias("null_pct"),
        ((F.col("row_count") > 0) & (F.col("empty_count") == 0) & (F.col("distinct_count") == F.col("row_count"))).alias("is_unique"),
        "one_shape",
    )


def distinct_values(tables: dict[str, DataFrame], fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Distinct (dataset_id, field, value) of the chosen columns, whole values, in one shuffle of numbered columns."""
    columns = [(d, f) for d, df in tables.items() for f in text_fields(df) if fields is None or f.name in fields.get(d, ())]
    number, names = numbered(columns, next(iter(tables.values())).sparkSession)
    parts = []
    for dataset_id in dict.fromkeys(d for d, _ in columns):
        entries = [F.struct(F.lit(number[d, f.name]).alias("column_no"), as_text(f).alias("value")) for d, f in columns if d == dataset_id]
        parts.append(tables[dataset_id].select(F.inline(F.array(*entries))).filter(F.col("value") != ""))
    return reduce(DataFrame.unionAll, parts).distinct().join(F.broadcast(names), "column_no").select("dataset_id", "field", "value")


def masked_sample(df: DataFrame, order: list[str], masked: list[str], rows: int, text_limit: int = 80) -> DataFrame:
    """A few rows in order for a reader, with masked columns hidden and long text cut for display."""
    shown = [
        F.lit("<masked>").alias(f.name) if f.name in masked else F.substring(as_text(f), 1, text_limit).alias(f.name) if isinstance(f.dataType, T.StringType) else as_text(f).alias(f.name)
        for f in text_fields(df)
    ]
    return df.orderBy(*order).limit(rows).select(*shown)
