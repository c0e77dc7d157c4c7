"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerlens", master: str | None = None, shuffle_partitions: int | None = None, storage: str | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC dates and adaptive execution.

    ``storage`` names the folder for intermediates, which every executor must reach.

    On a cluster pass neither ``master`` nor ``shuffle_partitions``: the submit configuration decides.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if storage:
        builder = builder.config("spark.checkpoint.dir", storage)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def storage_folder(spark: SparkSession) -> str:
    """Where this application stores intermediates: below ``spark.checkpoint.dir``, which every executor must reach.

    Only where that is not set, a folder of the warehouse is used. Nothing is stored in a machine-local
    temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.intermediates"
    return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written in the storage folder.

    The rows are computed once, survive lost executors, are read back by column, and their size is known
    to the planner. They are written for a short time and read back whole, so they are packed tightly. The files stay until :func:`release`.
    """
    path = f"{storage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What else refers to stored tables and has to forget them when they are deleted.
_ON_RELEASE: list = []


def on_release(forget) -> None:
    """Call ``forget()`` whenever stored intermediates are deleted."""
    _ON_RELEASE.append(forget)


def release(spark: SparkSession) -> None:
    """Delete this application's stored intermediates, once the results that read them are written.

    Whatever holds on to them (a stored catalog) is made again when it is asked for next.
    """
    for forget in _ON_RELEASE:
        forget()
    path = spark._jvm.org.apache.hadoop.fs.Path(storage_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Spread a scan over ``parts`` partitions before costly per-row work; without a number it stays as it is.

    The caller knows whether a small input comes in too few splits; nothing is decided by its size here.
    """
    return df if parts is None else df.repartition(parts)


def in_parts(rows: DataFrame, *keys: str, per_split: int = 16, scan: DataFrame | None = None) -> DataFrame:
    """The rows of a scan by key, in parts whose size does not grow with the table (``scan``: rows made from it).

    A split of a scan is bounded by ``spark.sql.files.maxPartitionBytes``; there are ``per_split`` parts for each, so a part
    has a small share of a split's rows. For rows that hardly repeat: combining them first would only fill a map per split,
    and reduce tasks put together by adaptive execution up to its advisory size would hold millions of short rows.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, per_split * (rows if scan is None else scan).rdd.getNumPartitions()), *keys)
