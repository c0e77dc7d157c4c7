"""Keys longer than six digits and fees between two cents, as only larger tables hold them, against the SQL."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import TABLES, compare, oracle_connection


@pytest.fixture(scope="module")
def large_keys(spark, small, tmp_path_factory):
    """The smallest tables; order keys pass a million, and fees of some measurements have no exact double."""
    folder = tmp_path_factory.mktemp("large_keys")
    frames = {name: spark.read.parquet(f"{small}/{name}.parquet") for name in TABLES}
    frames["orders"] = frames["orders"].withColumn("o_orderkey", F.col("o_orderkey") + 999_500)
    fees = [244.50, 14.50, 64.50, 67.50, 150.50, 100.00, 0.50]
    rows = [(10_000_000 + i, datetime(2024, 1, 20, 1, i), 900_000 + i, "error", fee, "{}") for i, fee in enumerate(fees)]
    frames["events"] = frames["events"].unionByName(spark.createDataFrame(rows, frames["events"].schema))
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"file://{folder}/{name}.dir")
        next((folder / f"{name}.dir").glob("*.parquet")).rename(folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["claims_with_questions", "extract_card_values", "sla_credit", "text_identifiers", "unsupported_claims"])
def test_query_equals_sql_on_large_keys(spark, large_keys, name):
    problem, _, rows = compare(spark, oracle_connection(large_keys), large_keys, name, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
    assert rows
