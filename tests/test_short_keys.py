"""Short keys stand for canonical ones, whatever the identity holds."""

from pyspark.sql import functions as F

from ledgerlens.functions.identity import entity_key, entity_key_of, order_of, relationship_key, short_key, short_relationship_key, with_canonical


def test_short_keys_give_canonical_keys(spark):
    names = ["1", "a/b", "", None, 'say "x"\\', "line\nbreak", "3|4", "naïve", "Supplier#000000001"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    a, b = short_key("Order", F.col("a")), short_key("Part", F.col("b"))
    whole_a, whole_b = entity_key("ns", "Order", F.col("a")), entity_key("ns", "Part", F.col("b"))
    df = df.select(
        entity_key_of("ns", a).alias("x"), whole_a.alias("y"), short_relationship_key("FUNDS", a, b).alias("u"),
        relationship_key("ns", "FUNDS", whole_a, whole_b).alias("v"), F.lower(F.hex(order_of("ns", a))).alias("o"),
    )
    rows = with_canonical(df, "ns", "u", F.lit(True)).collect()
    assert all(r.x == r.y == r.o and r.u == r.v for r in rows)
    assert len({r.u for r in rows}) == len(names) ** 2
