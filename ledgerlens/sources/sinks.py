"""Writers: content digests, idempotent loads, verification, namespace replacement and graph upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DecimalType, DoubleType, FloatType, StructField, TimestampNTZType, TimestampType

from ledgerlens.operators.graph.build import apply_merge, merge

DIGEST = ["row_count", "columns_hash", "hash_sum", "hash_xor"]


def digest_text(value: Column, kind: DataType) -> Column:
    """One spelling for each value: fractional numbers to six places, times to the microsecond, lists by element."""
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: F.coalesce(digest_text(v, kind.elementType), F.lit(""))), ","), F.lit("]"))
    if isinstance(kind, (DoubleType, FloatType, DecimalType)):
        number = value.cast("double") if isinstance(kind, FloatType) else value
        # What a decimal cannot hold keeps its own spelling.
        return F.coalesce(number.try_cast("decimal(38,6)").cast("string"), value.cast("string"))
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return value.cast("string")


def row_hash(fields: list[StructField]) -> Column:
    """60 bits of the SHA-256 of the row's values as a JSON array; no value is the empty string."""
    values = F.to_json(F.array(*[F.coalesce(digest_text(F.col(f"`{f.name}`"), f.dataType), F.lit("")) for f in fields]))
    return F.conv(F.substring(F.sha2(values, 256), 1, 15), 16, 10).cast("long")


def content_digest(df: DataFrame, table: str) -> DataFrame:
    """One row that identifies a table's columns and rows whatever their order.

    Sum and exclusive-or of the row hashes combine on the map side, so that a table of any size needs
    one scan and no sort. Equal rows count as often as they occur.
    """
    fields = [f for f in df.schema.fields if not f.name.startswith("_source_")]
    header = F.sha2(F.to_json(F.array(*[F.lit(f.name) for f in fields])), 256)
    return df.select(row_hash(fields).alias("h")).agg(
        F.count("*").alias("row_count"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("hash_sum"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("hash_xor")
    ).select(F.lit(table).alias("table_name"), "row_count", header.alias("columns_hash"), "hash_sum", "hash_xor")


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [content_digest(df, name) for name, df in tables.items()])


def load_plan(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per source table: load it, or leave it because its digest equals the manifest's."""
    known = manifest.select("table_name", F.struct(*DIGEST).alias("_m"))
    return current.join(known, "table_name", "left").select("table_name", "row_count", F.when(F.col("_m").eqNullSafe(F.struct(*DIGEST)), "unchanged").otherwise("loaded").alias("action"))


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """Digest tables side by side: present, same columns, same row count, same content."""
    a = source.select("table_name", *[F.col(c).alias(f"s_{c}") for c in DIGEST])
    b = copy.select("table_name", *[F.col(c).alias(f"c_{c}") for c in DIGEST], F.lit(True).alias("_present"))
    same = lambda c: F.coalesce(F.col(f"s_{c}") == F.col(f"c_{c}"), F.lit(False))
    return a.join(b, "table_name", "full_outer").select(
        "table_name", F.col("s_row_count").alias("source_rows"), F.coalesce("c_row_count", F.lit(0)).alias("copy_rows"), F.coalesce("_present", F.lit(False)).alias("table_present"),
        same("columns_hash").alias("columns_match"), same("row_count").alias("row_count_match"), (same("hash_sum") & same("hash_xor")).alias("content_match"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def load(spark: SparkSession, tables: dict[str, DataFrame], target: str, force: bool = False) -> dict[str, str]:
    """Write the tables whose content differs from the manifest under ``target`` and report each action.

    A stored copy that was changed since its load is written again. The manifest is replaced last, so a
    job lost half-way loads the same tables again.
    """
    current = digests(tables).cache()
    manifest_path = f"{target}/_manifest"
    actions = {name: "loaded" for name in tables}
    if not force and _exists(spark, manifest_path):
        manifest = spark.read.parquet(manifest_path)
        stored = [content_digest(spark.read.parquet(f"{target}/{name}"), name) for name in tables if _exists(spark, f"{target}/{name}")]
        planned = load_plan(current, manifest)
        if stored:
            intact = verify_copy(current, reduce(DataFrame.unionByName, stored)).filter("content_match AND columns_match AND row_count_match").select("table_name")
            # One row per table: the report is as small as the list of tables.
            kept = planned.filter("action = 'unchanged'").join(intact, "table_name", "left_semi").collect()
            actions.update({row.table_name: "unchanged" for row in kept})
    for name, df in tables.items():
        if actions[name] == "loaded":
            df.write.mode("overwrite").parquet(f"{target}/{name}")
    if "loaded" in actions.values():
        current.write.mode("overwrite").parquet(manifest_path)
    current.unpersist()
    return actions


def replace_namespace(df: DataFrame, path: str, namespace_prefix: str, column: str = "namespace") -> None:
    """Replace the partitions of the namespaces in ``df``, which must all start with the derived-data prefix."""
    if not namespace_prefix:
        raise ValueError("give the prefix of the namespaces that may be replaced")
    if not df.filter(~F.col(column).startswith(namespace_prefix)).isEmpty():
        raise ValueError("a namespace lies outside the prefix that may be replaced")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, content: Column, path: str) -> dict[str, int]:
    """Merge by key and revision into a new folder; a stale record stops the write. Returns the counts per action."""
    decided = merge(existing, incoming, content).cache()
    summary = {row.action: row.n for row in decided.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if summary.get("stale"):
        raise ValueError("content changed without a higher revision; nothing was written")
    apply_merge(existing, incoming, decided).write.mode("errorifexists").parquet(path)
    decided.unpersist()
    return summary
