"""One key with most of the rows: results stay whole and no plan gathers the group."""

from pyspark.sql import functions as F

from ledgerlens.operators import quality, ranking
from ledgerlens.operators.graph import traverse


def skewed(spark, n=30_000):
    """Two thirds of all rows share one group."""
    return spark.range(n).select(F.col("id"), F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("grp"))


def test_exact_rank_equals_sorted_order(spark):
    df = skewed(spark, 5_000)
    got = {(r.grp, r.id): r.rank for r in ranking.exact_rank(df, ["id"], ["grp"]).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.grp, []).append(r.id)
    want = {(g, i): k for g, ids in groups.items() for k, i in enumerate(sorted(ids), 1)}
    assert got == want


def test_global_rank_and_percent_cohort(spark):
    df = spark.range(1_001).select(F.format_string("ASN-%05d", 1_000 - F.col("id")).alias("assignment_id"))
    chosen = ranking.percent_cohort(df, "assignment_id", 12.5)
    rows = chosen.orderBy("assignment_id").collect()
    assert len(rows) == 125 and rows[0].assignment_id == "ASN-00000" and rows[-1].assignment_id == "ASN-00124"
    assert str(rows[0].effective_percent) == "12.49"


def test_cohort_count_beyond_the_eligible_fails(spark):
    df = spark.range(3).withColumnRenamed("id", "assignment_id")
    assert ranking.count_cohort(df, "assignment_id", 3).count() == 3
    try:
        ranking.count_cohort(df, "assignment_id", 4).collect()
    except Exception as error:
        assert "exceeds the eligible rows" in str(error)
    else:
        raise AssertionError("expected an error")


def test_top_rows_per_root_are_cut_before_the_shuffle(spark):
    found = ranking.first_per_root(skewed(spark), ["grp"], ["id"], 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    hot = found.filter("grp = 'hot'").orderBy("id").collect()
    assert [r.id for r in hot] == [1, 2, 4, 5, 7] and all(r.truncated for r in hot)


def test_latest_revision_and_conflicts_need_no_window(spark):
    df = skewed(spark).withColumn("payload", F.col("id") % 7)
    latest = ranking.latest_revision(df, ["grp"], ["id"])
    assert "Window" not in latest._jdf.queryExecution().executedPlan().toString()
    assert latest.filter("grp = 'hot'").first().id == 29_999
    twice = df.unionByName(df)
    checked = quality.dedupe_conflicts(twice, ["id"])
    assert checked.filter("conflict").count() == 0 and checked.filter("row_count <> 2").count() == 0


def test_components_of_a_hub_and_a_long_chain(spark):
    hub = spark.range(1, 3_000).select(F.lit("h").alias("src"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("dst"))
    chain = spark.range(200).select(F.format_string("c%04d", "id").alias("src"), F.format_string("c%04d", F.col("id") + 1).alias("dst"))
    edges = hub.unionByName(chain)
    nodes = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct().unionByName(spark.createDataFrame([("alone",)], "key string"))
    found = {r.component: r.n for r in traverse.connected_components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert found == {"h": 3_000, "c0000": 201, "alone": 1}
