"""Shuffles of scans in parts of bounded size, the vendor keys read from them, and the order of written edges."""

import re

from pyspark.sql import functions as F

from ledgerlens.operators import overlap
from ledgerlens.operators.graph import build, traverse
from ledgerlens.plans import load_all, q_portfolio
from ledgerlens.session import in_parts


def test_parts_follow_the_splits_of_a_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(200_000).repartition(6).write.parquet(path)
    scan = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        splits = scan.rdd.getNumPartitions()
        dealt = in_parts(spark.read.parquet(path), "id", per_split=4)
        assert splits > 12 and dealt.rdd.getNumPartitions() == 4 * splits and dealt.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_the_vendor_view_are_dealt_before_they_are_grouped(spark):
    """Neither the lines of orders nor those of applications are grouped in maps as large as a split."""
    plan = load_all()[0]["vendor_360"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)[^\n]*REPARTITION_BY_NUM", plan)
    assert {"o_orderkey", "vendor_id"} <= set(dealt)


def test_applications_without_a_described_part_are_keys(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 10), (2, 10), (1, 77), (2, 77), (1, 77), (3, None)], "l_suppkey long, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(10, "b", "t")], "p_partkey long, p_brand string, p_type string").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    groups = {(r.kind, r.key, r.vendor_count) for r in overlap.overlap_groups(q_portfolio.keys(spark, folder)).collect()}
    assert groups == {("application", "10", 2), ("application", "77", 2), ("product", "b", 2), ("service", "t", 2)}


def test_edges_of_a_source_are_written_next_to_each_other(spark):
    """A written table then does not repeat the source's key in full for every edge; texts and numbers give the same keys."""
    pairs = spark.range(3000).selectExpr("(id * 7919) % 50 AS s", "id % 400 AS t")
    edges = build.map_edges(pairs, "SUPPORTS", "Supplier", "Part", "s", "t", "portfolio", by_source=True)
    parts = edges.select("src").rdd.mapPartitions(lambda rows: [[r.src for r in rows]]).collect()
    for sources in parts:
        runs = [s for i, s in enumerate(sources) if i == 0 or sources[i - 1] != s]
        assert len(runs) == len(set(runs))
    texts = build.map_edges(pairs.selectExpr("CAST(s AS STRING) AS s", "CAST(t AS STRING) AS t"), "SUPPORTS", "Supplier", "Part", "s", "t", "portfolio")
    assert sorted(edges.collect()) == sorted(texts.collect())


def test_search_on_binary_keys_stores_edges_once(spark, monkeypatch):
    """Binary keys give the nodes, depths and predecessors of their texts; an undirected edge is stored once."""
    pairs = [("aa", "0b"), ("aa", "ff"), ("0b", "c0"), ("ff", "c0"), ("c0", "d1")]
    texts = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([("aa",)], "key string")
    stored = []
    monkeypatch.setattr(traverse, "shared_checkpoint", lambda df: stored.append(df.count()) or df.localCheckpoint())
    plain = {tuple(r) for r in traverse.bfs(start, texts, 3, directed=False).collect()}
    assert stored[0] == len(pairs)
    found = traverse.bfs(start.select(F.unhex("key").alias("key")), texts.select(F.unhex("src").alias("src"), F.unhex("dst").alias("dst")), 3, directed=False)
    assert {tuple(r) for r in found.select(F.lower(F.hex("node")), "depth", F.lower(F.hex("predecessor"))).collect()} == plain
    assert ("c0", 2, "0b") in plain and ("d1", 3, "c0") in plain


def test_ranged_edges_hold_few_sources_and_targets_in_runs(spark):
    """Nearby sources share targets: a written part holds neither key in full for every edge; the edges are the same."""
    pairs = spark.range(0, 60_000, 1, 1).selectExpr("id div 6000 * 40 + (id * 7919) % 40 AS s", "id div 6000 * 1000 + id % 1500 div 3 AS t")
    plain = sorted(build.map_edges(pairs, "DELIVERS", "Supplier", "Order", "s", "t", "portfolio").collect())
    assert sorted(build.map_edges(pairs, "DELIVERS", "Supplier", "Order", "s", "t", "portfolio", ranged="target").collect()) == plain
    edges = build.map_edges(pairs, "DELIVERS", "Supplier", "Order", "s", "t", "portfolio", ranged="source")
    assert sorted(edges.collect()) == plain
    parts = edges.select("src", "dst").rdd.mapPartitions(lambda rows: [[(r.src, r.dst) for r in rows]]).collect()
    assert len(parts) == build.PARTS_PER_SPLIT and max(len({s for s, _ in p}) for p in parts) < 80
    runs = [[t for i, (_, t) in enumerate(p) if i == 0 or p[i - 1][1] != t] for p in parts]
    assert all(len(r) == len(set(r)) for r in runs) and 2 * sum(map(len, runs)) < len(plain)
