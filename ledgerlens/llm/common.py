"""What the operators of this subpackage share: stored intermediates, worker code, tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="pyfiles-")
    archive = shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def _shared_path(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def store_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``store``, bucketed by a key: what is later grouped by the key with it moves, the stored rows do not."""
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).option("path", _shared_path(spark)).saveAsTable(name)
    stored = spark.table(name)
    # Only the entry in the catalog goes; the files are the table's own.
    spark.sql(f"DROP TABLE {name}")
    return stored


def store(df: DataFrame) -> DataFrame:
    """Write a table into the folder of ``spark.checkpoint.dir`` and read it back.

    Lineage ends there and the files are shared, so a lost executor does not restart the work before it. Only
    where the setting is missing (a local session, tests) a folder below the warehouse is used.
    """
    spark = df.sparkSession
    path = _shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a stored table of at most ``rows`` rows; a larger one is joined by shuffle instead."""
    return F.broadcast(df) if len(df.head(rows + 1)) <= rows else df


def boxed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and the whole row in ``_row``, so no further column can clash with added ones."""
    return docs.select(*columns, F.struct(*docs.columns).alias("_row"))


def unboxed(rows: DataFrame, columns: list[str], *more, **changed) -> DataFrame:
    """The columns of ``_row`` again, some of them changed; n_chars follows a changed text."""
    if "text" in changed and "n_chars" in columns:
        kind = rows.schema["_row"].dataType["n_chars"].dataType
        changed["n_chars"] = F.length(changed["text"]).cast(kind)
    return rows.select(*(changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in columns), *more)
