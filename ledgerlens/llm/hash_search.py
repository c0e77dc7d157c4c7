"""Nearest neighbours by inner product through multi-index hashing of learned rotated binary codes.

Vectors are scaled by the largest norm and given one more component, so that the largest inner product is the
smallest angle; a random start is rotated to the data (iterative quantisation) until ``BITS`` bits keep most
of the directions. Codes are split into ``BITS`` / 8 substrings of one byte, and each block of the index has a
bucket table per substring. If two codes differ in at most r bits, then with m substrings, a = r // m and
b = r % m, they differ in at most a bits in one of the first b + 1 substrings or in at most a - 1 in one of
the others; probing those buckets finds every code within r, which is then confirmed on the whole code and
ranked by the exact inner product of the original vectors.

The rotation and the radius are fitted on at most ``SAMPLE`` vectors chosen by hash; the radius is the
``REACH`` quantile of the distances between sampled queries and their true neighbours in the sample, and the
neighbours in all vectors are no farther. Every vector is indexed. Equal vectors are one entry with its
smallest ids (as many as can be asked for), so copies cost nothing. Queries meet the index in blocks.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than
most, take no part, neither does a null vec_id; fewer candidates than asked for: all; ties go to the smaller
vec_id; rows with equal vec_id and vector are one; other repeated ids are entries of their own, except the
query's own id; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, store

BITS, SAMPLE, PROBE_SAMPLE, REACH, ROUNDS = 128, 10_000, 200, 0.97, 12
INDEX_BLOCK, QUERY_BLOCK = 8192, 4096
_ONES = np.array([bin(i).count("1") for i in range(256)])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v as doubles, of the vectors that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    out = vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    length = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.where(F.size("v") == (length["n"] if length else 0))


class Coder:
    """Projects vectors and gives their bits."""

    def __init__(self, sample, largest, bits=BITS, seed=5):
        self.largest = largest
        x = self.lifted(sample)
        random = np.random.default_rng(seed)
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        planes = []
        while sum(p.shape[1] for p in planes) < bits:
            p = axes[: min(len(axes), bits)].T
            turn = np.linalg.qr(random.normal(size=(p.shape[1], p.shape[1])))[0]
            y = x @ p
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
                turn = (u @ w).T
            planes.append(p @ turn)
        self.planes = np.concatenate(planes, axis=1)[:, :bits]

    def lifted(self, x):
        x = x / self.largest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)

    def codes(self, x, query=False):
        y = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.lifted(x)
        return np.packbits(y @ self.planes >= 0, axis=1)


def fit(rows: DataFrame, k: int):
    """A coder and a radius from a bounded sample; None without vectors."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return None, 0
    x = np.array(sample.column("v").to_pylist())
    largest = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)))).first()[0]
    coder = Coder(x, largest)
    index, queries = coder.codes(x), x[:PROBE_SAMPLE]
    scores = queries @ x.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, len(x) - 1)]
    if not near.size:
        return coder, coder.planes.shape[1]
    apart = np.bitwise_count(coder.codes(queries, True)[:, None, :] ^ index[near]).sum(axis=2)
    return coder, int(np.quantile(apart, REACH))


class BlockIndex:
    """Bucket tables of one block of codes: for each substring, entries ordered by its value."""

    def __init__(self, codes):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.starts = np.stack([np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)])

    def within(self, code, radius):
        """Entries whose whole code is at most ``radius`` bits away."""
        m = self.codes.shape[1]
        a, b = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            reach = a if j <= b else a - 1
            buckets = np.flatnonzero(_ONES[np.arange(256) ^ code[j]] <= reach)
            # Neighbouring buckets are one run of the order.
            starts, ends = self.starts[j][buckets], self.starts[j][buckets + 1]
            edges = np.zeros(len(seen) + 1, np.int32)
            np.add.at(edges, starts, 1)
            np.add.at(edges, ends, -1)
            seen[self.order[j][np.cumsum(edges[:-1]) > 0]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.codes[found] ^ code).sum(axis=1) <= radius]


def _probe(queries, block, coder, radius, k):
    """For every query of a block of queries, its best entries in one block of the index."""
    out = []
    if len(queries) and len(block):
        x = np.stack(block["v"].to_numpy())
        q = np.stack(queries["v"].to_numpy())
        # From here on in the order of c, so ties are settled alike everywhere.
        index, codes, ids = BlockIndex(coder.codes(x)), coder.codes(q, True), block["c"].to_numpy()
        for i, query in enumerate(queries["c"].to_numpy()):
            found, r = index.within(codes[i], radius), radius
            while len(found) < min(k, len(x)) and r < coder.planes.shape[1]:
                r += 8
                found = index.within(codes[i], r)
            score = x[found] @ q[i]
            if len(found) > k:
                # Ties at the edge stay, the caller ranks them by id.
                edge = np.partition(score, -k)[-k]
                keep = score >= edge
                found, score = found[keep], score[keep]
            out.append(pd.DataFrame({"q": query, "c": ids[found], "score": score}))
    return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})


def search(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row that ``is_query`` (a condition on
    vec_id), among all rows but the query's own id."""
    spark = vectors.sparkSession
    ship(spark)
    rows = store(usable(vectors).distinct())
    coder, radius = fit(rows, k)
    same = Window.partitionBy("v").orderBy("vec_id")
    # Row numbers are limited before the shuffle, so a vector of a third of all rows is a few rows per task.
    first = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    classes = store(first.groupBy("v").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    # A repeated id may stand for different vectors, so entries are numbered by what they are.
    classes = classes.withColumn("c", F.xxhash64("c", "v"))
    asked = store(rows.where(is_query).select("vec_id", "v").join(classes.select("v", "c"), "v").select(F.col("vec_id").alias("query_id"), "c", "v"))
    queries = asked.groupBy("c").agg(F.first("v").alias("v"))
    parts = max(1, -(-classes.count() // INDEX_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    index = classes.select("c", "v", F.pmod(F.xxhash64("c"), F.lit(parts[0])).alias("ib"), F.explode(F.sequence(F.lit(0), F.lit(parts[1] - 1))).alias("qb"))
    queries = queries.select("c", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts[0] - 1).cast("long"))).alias("ib"), F.pmod(F.xxhash64("c"), F.lit(parts[1])).cast("int").alias("qb"))
    probe = partial(_probe, coder=coder, radius=radius, k=k + 1)
    near = queries.groupBy("ib", "qb").cogroup(index.groupBy("ib", "qb")).applyInPandas(lambda a, b: probe(a, b), "q long, c long, score double")
    best = near.withColumn("n", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("n") <= k + 1)
    # Entries to rows: each has at most k + 1 ids, and no query needs more of one.
    named = best.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    best = store(named.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1).drop("n"))
    found = asked.select("query_id", F.col("c").alias("q")).join(best, "q").where("vec_id <> query_id")
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
