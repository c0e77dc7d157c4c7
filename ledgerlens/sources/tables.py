"""Readers: CSV snapshots, database tables, nested JSON documents and graph payloads."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.session import shared_checkpoint


class SnapshotError(ValueError):
    """A source does not have the promised columns. Messages never carry row contents."""


def require_columns(df: DataFrame, name: str, required: Iterable[str]) -> DataFrame:
    """The frame itself when its schema has every required column exactly once."""
    columns = list(df.columns)
    missing = sorted(set(required) - set(columns))
    if missing or len(columns) != len(set(columns)):
        raise SnapshotError(f"invalid columns in {name}: missing {missing}" if missing else f"duplicate columns in {name}")
    return df


def admit_namespace(df: DataFrame, namespace: str, column: str = "Graph_Namespace") -> DataFrame:
    """Only rows of one namespace; the filter reaches the scan, and prunes partitions when stored by namespace."""
    return df.filter(F.col(column) == namespace)


def as_text_table(df: DataFrame) -> DataFrame:
    """Every column as text, with the empty string for "no value"."""
    return df.select(*[F.coalesce(F.col(f"`{f.name}`").cast("string"), F.lit("")).alias(f.name) for f in df.schema])


def read_csv_snapshot(
    spark: SparkSession,
    path: str,
    name: str,
    required: Sequence[str] = (),
    namespace: str | None = None,
    namespace_column: str = "Graph_Namespace",
    with_lineage: bool = True,
) -> DataFrame:
    """A CSV snapshot with a header as an all-text table that fails on malformed rows.

    The header fixes the schema, so that a row with too few or too many values fails the read instead of
    being padded; every file has the same header. Quotes inside quoted values are doubled. Line ends inside
    quoted values are read as ``\\n``. ``_source_line`` is the record number (the header is line 1; blank lines
    do not count) and ``_source_file`` the file. Each split of a file is read by a task of its own, see
    :func:`csv_records`.
    """
    header = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not header:
        raise SnapshotError(f"unable to read {name}")
    first_line = header[0].value.lstrip("\ufeff").rstrip("\r")
    columns = spark.read.option("header", False).csv(spark.sparkContext.parallelize([first_line])).first()
    columns = [c or "" for c in columns]
    if not all(columns) or len(columns) != len(set(columns)) or any(c.startswith("_source_") for c in columns):
        raise SnapshotError(f"invalid columns in {name}")
    missing = sorted(set(required) - set(columns))
    if missing:
        raise SnapshotError(f"invalid columns in {name}: missing {missing}")
    records = csv_records(spark, path, name)
    if not records.where((F.col("_source_line") == 1) & (F.col("value") != first_line)).isEmpty():
        raise SnapshotError(f"files with unlike headers in {name}")
    parsed = F.from_csv("value", _ddl(columns), {"mode": "FAILFAST", "escape": '"', "maxCharsPerColumn": "-1"})
    lineage = ["_source_file", "_source_line"] if with_lineage else []
    rows = records.where("_source_line > 1").select(parsed.alias("_values"), *lineage)
    table = rows.select("_values.*", *lineage).na.fill("", columns)
    return table if namespace is None else admit_namespace(table, namespace, namespace_column)


def _ddl(columns: Sequence[str]) -> str:
    return ", ".join("`" + c.replace("`", "``") + "` STRING" for c in columns)


def _ends_inside(line: Column, inside: bool) -> Column:
    """Whether a line ends inside a quoted value, if it starts inside or outside one.

    A quote opens a value at its start only; an odd number of quotes in a piece between commas changes the state.
    """

    def step(state, piece):
        odd = F.pmod(F.length(piece) - F.length(F.replace(piece, F.lit('"'), F.lit(""))), F.lit(2)) == 1
        return F.when(state, ~odd).otherwise(odd & piece.startswith('"'))

    return F.when(line.contains('"'), F.aggregate(F.split(line, ","), F.lit(inside), step)).otherwise(F.lit(inside))


def _state(start: Column, fixed: Column, flips: Column) -> Column:
    """The state after lines that flip it or set it: from the last one that set it, or else from the start."""
    since = F.when(fixed.isNull(), flips).otherwise(flips - fixed["flips"])
    return F.when(fixed.isNull(), start).otherwise(fixed["inside"]) != (F.pmod(since, F.lit(2)) == 1)


def csv_records(spark: SparkSession, path: str, name: str = "file") -> DataFrame:
    """(_source_file, _source_line, value): the records of CSV files as text, with their numbers, read split by split.

    A line keeps the state (inside a quoted value or not), flips it, or sets it. Running counts within each
    split give the state and the number of records before each line for both states the split may start in;
    a running count over the splits of a file (one row each) then tells the true one. A record of one line
    stays where it is; only lines of records that span lines are brought together, also across splits.
    A quote that is never closed is an error, so no group holds the rest of a file.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"), F.regexp_replace("value", r"\r$", "").alias("value"))
    first = F.col("block") == 0
    within = Window.partitionBy("file", "block").orderBy("row")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("value", F.when(first & (F.row_number().over(within) == 1), F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")))
    lines = lines.withColumn("e0", _ends_inside(F.col("value"), False)).withColumn("e1", _ends_inside(F.col("value"), True))
    lines = lines.withColumn("flips", F.sum((F.col("e0") & ~F.col("e1")).cast("long")).over(within))
    lines = lines.withColumn("fixed", F.when(F.col("e0") == F.col("e1"), F.struct(F.col("e0").alias("inside"), "flips")))
    earlier, fixed = F.coalesce(F.lag("flips").over(within), F.lit(0)), F.last("fixed", ignorenulls=True).over(before)
    lines = lines.withColumn("earlier", earlier).withColumn("last_fixed", fixed)
    for k, start in enumerate((False, True)):
        inside = _state(F.lit(start), F.col("last_fixed"), F.col("earlier"))
        starts = (~inside & (F.col("value") != "")).cast("long")
        lines = lines.withColumn(f"in{k}", inside).withColumn(f"n{k}", F.sum(starts).over(within))
    lines = shared_checkpoint(lines.select("file", "block", "row", "value", "e0", "e1", "flips", "fixed", "in0", "in1", "n0", "n1"))

    last = F.max("flips").alias("all_flips"), F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("row"))).alias("end_fixed")
    splits = lines.groupBy("file", "block").agg(*last, F.max("n0").alias("n0"), F.max("n1").alias("n1"))
    # A split that sets the state does so for those after it; flips are counted through the file.
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("flips", F.coalesce(F.sum("all_flips").over(past), F.lit(0)))
    splits = splits.withColumn("set", F.when(F.col("end_fixed").isNotNull(), F.struct(F.col("end_fixed")["inside"].alias("inside"), (F.col("flips") + F.col("end_fixed")["flips"]).alias("flips"))))
    splits = splits.withColumn("start", _state(F.lit(False), F.last("set", ignorenulls=True).over(past), F.col("flips")))
    records = F.when(F.col("start"), F.col("n1")).otherwise(F.col("n0"))
    end = _state(F.col("start"), F.col("end_fixed"), F.col("all_flips"))
    splits = splits.withColumn("base", F.coalesce(F.sum(records).over(past), F.lit(0))).withColumn("end", end).withColumn("final", F.lead("block").over(order).isNull())
    splits = shared_checkpoint(splits.select("file", "block", "start", "base", "end", "final"))
    if not splits.where("final AND end").isEmpty():
        raise SnapshotError(f"unclosed quote in {name}")

    known = lines.join(splits.drop("end", "final"), ["file", "block"])
    pick = lambda yes, no: F.when(F.col("start"), F.col(yes)).otherwise(F.col(no))
    known = known.withColumn("inside", pick("in1", "in0")).withColumn("number", F.col("base") + pick("n1", "n0"))
    known = known.withColumn("open", F.when(F.col("inside"), F.col("e1")).otherwise(F.col("e0"))).where("inside OR value <> ''")
    columns = F.col("file").alias("_source_file"), F.col("number").alias("_source_line")
    # The text itself depends on the state, so no later filter on parsed values can reach lines that are no records.
    whole = ~F.col("inside") & ~F.col("open")
    single = known.where(whole).select(*columns, F.when(whole, F.col("value")).alias("value"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    spanning = known.where("inside OR open").groupBy("file", "number").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
    return single.unionByName(spanning.select(*columns, "value"))


def read_database_table(spark: SparkSession, url: str, table: str, properties: dict[str, str], partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32) -> DataFrame:
    """A database table, read in parallel ranges of a numeric column where one is given."""
    if partition_column and bounds:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def read_documents(spark: SparkSession, path: str, schema: str | T.StructType | None = None, records: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Nested JSON documents, one per file; with ``records`` its array becomes one row per record next to the kept fields."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema).option("mode", "FAILFAST") if schema is not None else reader).json(path)
    if records is None:
        return df
    return df.select(*keep, F.explode(records).alias("_record")).select(*keep, "_record.*")


REFERENCE = "struct<class_id:string,identity:string,contract_identity:string,occurrence_id:string>"
CITATION = f"struct<document:{REFERENCE},property_id:string,source_ref:string,section:string,page:bigint,chunk_id:string,extraction_run:string,evidence_ref:string,confidence:double,review_state:string,verification_state:string>"
ENTITY = f"struct<class_id:string,properties:map<string,string>,identity:string,contract_identity:string,occurrence_id:string,revision:bigint,provenance:array<{CITATION}>>"
RELATIONSHIP = f"struct<type:string,source:{REFERENCE},target:{REFERENCE},properties:map<string,string>,revision:bigint,provenance:array<{CITATION}>>"
PAYLOAD = f"namespace string, ontology_version string, entities array<{ENTITY}>, relationships array<{RELATIONSHIP}>"


def read_graph_payload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of graph payload files, checked against the fixed envelope."""
    df = spark.read.schema(PAYLOAD).option("multiLine", True).option("mode", "FAILFAST").json(path)
    entities = df.select("namespace", "ontology_version", F.explode("entities").alias("e")).select("namespace", "ontology_version", "e.*")
    relationships = df.select("namespace", "ontology_version", F.explode("relationships").alias("r")).select("namespace", "ontology_version", "r.*")
    return entities, relationships
