"""Hard-negative mining with an inverted multi-index.

Vectors are cut into two halves, each with a codebook of k-means centres; a row belongs to the cell of its two
nearest centres. For an anchor a and a centre c whose rows lie within a radius r of it, half a row's score is at
most a.c + |a| r, so the sum of two such bounds holds for every row of a cell. A heap walks the cells of an anchor
by falling bounds (the multi-sequence algorithm over the two sorted lists). After each round of cells a search is
certified if its k-th best score is above the bound of the next cell, or if no cell left can reach its window of
scores; all others go on with more cells, so results are exact. First the positives of each anchor are searched
among the rows of its label, then, for every positive's score, the window of rows of other labels.

Scores are inner products of whole numbers. Equal vectors of one label are one entry with its smallest ids, as many
as a result can hold, so copies cost nothing. Anchors travel to the runs of ``RUN`` cells next to each other that hold
what they ask for, once per run, and are compared with the entries of the asked cells there; a run with many entries is
cut into parts of about ``BLOCK`` and one with many anchors into lanes of about ``LANE``, so no task grows with the
input. Cells are planned for about ``CHUNK`` anchors at a time; anchors and entries are shuffled, only the numbers
of parts and lanes of each run are broadcast. Only the codebooks are fitted on a sample, of at most ``SAMPLE`` vectors; every row is indexed. Codebooks have
at most ``CODEWORDS`` centres, so the lists of radii and of cells in use that the tasks are sent stay small.

Defined cases: rows with a null vec_id, label or vector, or with a null or non-finite component, and vectors of
another length than most, take no part; equal rows are one; other rows with the same vec_id are rows of their own, but
never a positive or negative of their own id; fewer positives or negatives than asked for: all; a negative positive
score has an empty window; scores of 9e16 and more, whose percentages leave 64 bits, are an error; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import ship, store

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
CODEWORDS, CELL, SAMPLE, TURNS, BLOCK, LANE, FIRST, GROWTH = 128, 256, 10_000, 10, 4096, 2048, 16, 8
RUN, CHUNK = BLOCK // CELL, 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) with v in whole numbers, of the rows that take part."""
    raw = F.col("embedding").cast("array<double>")
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    out = vectors.where(named).where(fine).select("vec_id", F.col("label").cast("long").alias("label"), F.transform(raw, lambda x: F.floor(SCALE * x)).alias("v"))
    length = out.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return out.where(F.size("v") == (length["n"] if length else 0)).distinct()


def _matrix(column, dtype=np.int64):
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(values.flatten()).astype(dtype, copy=False)
    return flat.reshape(len(values), -1) if len(values) else np.empty((0, 0), dtype)


def _nearest(x, centres):
    """The nearest centre of each row and its distance."""
    apart = (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    at = apart.argmin(axis=1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(axis=1))


class Index:
    """Codebooks of both halves; after ``occupy`` also their radii and the cells in use."""

    def __init__(self, sample, words, seed=7):
        self.cut = sample.shape[1] // 2
        random, self.books = np.random.default_rng(seed), []
        for half in (sample[:, : self.cut], sample[:, self.cut :]):
            half = np.unique(half, axis=0) if half.shape[1] else half[:1]
            centres = half[random.permutation(len(half))[:words]]
            for _ in range(TURNS):
                at, _ = _nearest(half, centres)
                number = np.bincount(at, minlength=len(centres))
                total = np.zeros_like(centres)
                np.add.at(total, at, half)
                centres = np.where(number[:, None] > 0, total / np.maximum(1, number)[:, None], centres)
            self.books.append(centres)
        self.words = len(self.books[1])

    def cells(self, x):
        (one, r1), (two, r2) = _nearest(x[:, : self.cut], self.books[0]), _nearest(x[:, self.cut :], self.books[1])
        return one * self.words + two, r1, r2

    def occupy(self, radii, cells):
        self.radii, self.used = radii, frozenset(cells)
        self.reach = [float((np.sqrt((b * b).sum(axis=1)) + r).max(initial=0)) for b, r in zip(self.books, radii, strict=True)]

    def visits(self, anchor):
        """(bound, cell) of all cells in use by falling bounds; no row of a cell scores above its bound."""
        halves = anchor[: self.cut], anchor[self.cut :]
        norms = [math.sqrt(float(h @ h)) for h in halves]
        bounds = [b @ h + n * r for b, h, n, r in zip(self.books, halves, norms, self.radii, strict=True)]
        order = [np.argsort(-b, kind="stable").tolist() for b in bounds]
        one, two = (b[o].tolist() for b, o in zip(bounds, order, strict=True))
        # Room for rounding, on sums of numbers of this size.
        slack = 1 + 1e-9 * sum(n * r for n, r in zip(norms, self.reach, strict=True))
        heap, pushed = [(-(one[0] + two[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            cell = order[0][i] * self.words + order[1][j]
            if cell in self.used:
                yield math.floor(slack - bound), cell
            for a, b in ((i + 1, j), (i, j + 1)):
                # A cell comes into the heap once its neighbours of higher bounds have left it.
                if a < len(one) and b < len(two) and (a, b) not in pushed:
                    pushed.add((a, b))
                    heapq.heappush(heap, (-(one[a] + two[b]), a, b))


_PLANNED = "anchor_id long, a long, label long, v array<long>, windows array<struct<limit:long,floor:long>>, seen int, cells array<array<int>>, bound long"


def _plan(batches, index, size):
    """The next ``size`` cells of each anchor by runs, and the bound of the cell after them (null: none is left)."""
    for batch in (b.slice(at, CHUNK) for b in batches for at in range(0, b.num_rows, CHUNK)):
        cells, bounds = [], []
        for anchor, seen in zip(_matrix(batch.column("v"), np.float64), batch.column("seen").to_pylist(), strict=True):
            mine, bound = {}, None
            for place, (high, cell) in enumerate(index.visits(anchor)):
                if place == seen + size:
                    bound = high
                    break
                if place >= seen:
                    mine.setdefault(cell // RUN, []).append(cell)
            cells.append(list(mine.values()))
            bounds.append(bound)
        seen = pa.array([s + size for s in batch.column("seen").to_pylist()], pa.int32())
        kept = [batch.column(c) for c in ("anchor_id", "a", "label", "v", "windows")]
        yield pa.RecordBatch.from_arrays([*kept, seen, pa.array(cells, pa.list_(pa.list_(pa.int32()))), pa.array(bounds, pa.int64())], [x.split(" ")[0] for x in _PLANNED.split(", ")])


def products(anchors, rows):
    """All inner products of two integer matrices, exact within 64 bits."""
    size = max(int(np.abs(anchors).max(initial=0)), 1) * max(int(np.abs(rows).max(initial=0)), 1) * max(1, rows.shape[1])
    # Doubles hold whole numbers up to 2^53.
    return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64) if size < 1 << 53 else anchors @ rows.T


def _score(left, right, same, k, low, high):
    """The best entries of one part of a run, in the cells asked for, for every anchor and window: at most k ids each."""
    out = []
    if left.num_rows and right.num_rows:
        scores = products(_matrix(left["v"]), _matrix(right["v"]))
        labels, ids, place = np.asarray(right["label"].combine_chunks()), right["ids"].to_pylist(), np.asarray(right["cell"].combine_chunks()) % RUN
        for i, row in enumerate(left.select(["anchor_id", "a", "label", "windows", "cells"]).to_pylist()):
            asked = np.zeros(RUN, bool)
            asked[[cell % RUN for cell in row["cells"]]] = True
            fits = np.flatnonzero(asked[place] & ((labels == row["label"]) if same else (labels != row["label"])))
            own = scores[i, fits]
            for window in row["windows"]:
                limit, floor = window["limit"], window["floor"]
                good = np.ones(len(own), bool) if low is None else (100 * own >= low * limit) & (100 * own <= high * limit)
                if floor is not None:
                    good &= own >= floor
                at, score = fits[good], own[good]
                if len(at) > k + 1:
                    # One more than asked for, as the anchor's own entry may hold no other id.
                    keep = score >= np.partition(score, -k - 1)[-k - 1]
                    at, score = at[keep], score[keep]
                found = sorted((-s, v) for e, s in zip(at.tolist(), score.tolist(), strict=True) for v in ids[e] if v != row["anchor_id"])
                out += [(row["anchor_id"], row["a"], limit, v, -s) for s, v in found[:k]]
    return pa.table([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["anchor_id", "a", "limit", "vec_id", "score"])


def _in_cells(same, k, low, high):
    def score(left, right):
        return _score(left, right, same, k, low, high)

    return score


def _visit(planned: DataFrame, entries: DataFrame, same: bool, k: int, low, high) -> DataFrame:
    """Bring anchors to the parts of the runs that hold the cells they ask for."""
    asked = planned.select("anchor_id", "a", "label", "v", "windows", F.explode("cells").alias("cells")).withColumn("run", F.expr(f"cells[0] div {RUN}"))
    held = entries.select("cell", "label", "v", "ids", F.expr(f"cell div {RUN}").alias("run"))
    parts = held.groupBy("run").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    lanes = asked.groupBy("run").agg(F.ceil(F.count("*") / LANE).alias("lanes"))
    # One row per run, and at most CODEWORDS^2 / RUN of them. By its files ``planned`` looks small enough to be broadcast; exploded it is not.
    shape = F.broadcast(parts.join(lanes, "run"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = asked.join(shape, "run").withColumn("lane", F.pmod("a", "lanes")).withColumn("part", upto("parts")).drop("parts", "lanes")
    held = held.join(shape, "run").withColumn("part", F.pmod(F.xxhash64("v", "label"), "parts")).withColumn("lane", upto("lanes")).drop("parts", "lanes")
    sides = asked.groupBy("run", "part", "lane").cogroup(held.groupBy("run", "part", "lane"))
    return sides.applyInArrow(_in_cells(same, k, low, high), "anchor_id long, a long, limit long, vec_id long, score long")


def _pursue(anchors: DataFrame, entries: DataFrame, index: Index, same: bool, k: int, low=None, high=None) -> DataFrame:
    """(anchor_id, a, limit, vec_id, score): the k best of every window of ``anchors`` (anchor_id, a, label, v, limits)."""
    windows = F.transform("limits", lambda x: F.struct(x.alias("limit"), F.lit(None).cast("long").alias("floor")))
    pending = anchors.select("anchor_id", "a", "label", "v", windows.alias("windows"), F.lit(0).alias("seen"))
    best, size, search = None, FIRST, ["anchor_id", "a", "limit"]
    rank = F.row_number().over(Window.partitionBy(*search).orderBy(F.desc("score"), "vec_id"))
    while True:
        # Few rows that grow a lot: spread by their number, not by their bytes.
        planned = store(pending.repartition(max(1, -(-pending.count() // CHUNK)), "a").mapInArrow(partial(_plan, index=index, size=size), _PLANNED))
        found = _visit(planned, entries, same, k, low, high)
        best = store((found if best is None else best.union(found)).withColumn("n", rank).where(F.col("n") <= k).drop("n"))
        state = best.groupBy(*search).agg(F.count("*").alias("n"), F.min("score").alias("worst"))
        each = planned.select("anchor_id", "a", "label", "v", "seen", "bound", F.explode("windows.limit").alias("limit")).join(state, search, "left")
        certified = F.col("bound").isNull() | F.coalesce((F.col("n") == k) & (F.col("worst") > F.col("bound")), F.lit(False))
        if low is not None:
            certified |= 100 * F.col("bound") < low * F.col("limit")
        rest = F.collect_list(F.struct("limit", F.when(F.col("n") == k, F.col("worst")).alias("floor"))).alias("windows")
        pending = each.where(~certified).groupBy("anchor_id", "a").agg(F.first("label").alias("label"), F.first("v").alias("v"), rest, F.max("seen").alias("seen"))
        pending = store(pending.select("anchor_id", "a", "label", "v", "windows", "seen"))
        if pending.isEmpty():
            return best
        size *= GROWTH


def _celled(batches, index):
    for batch in batches:
        cell, r1, r2 = index.cells(_matrix(batch.column("v"), np.float64))
        arrays = [batch.column(c) for c in ("label", "v", "ids")]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(cell, pa.int32()), pa.array(r1, pa.float64()), pa.array(r2, pa.float64())], ["label", "v", "ids", "cell", "r1", "r2"])


def build(rows: DataFrame, most: int) -> tuple[DataFrame, Index | None]:
    """Entries (label, v, ids, cell) of all rows and their index; None without rows."""
    same = Window.partitionBy("v", "label").orderBy("vec_id")
    # Row numbers are limited before the shuffle, so a vector of a third of all rows is a few rows per task.
    first = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= most)
    entries = store(first.groupBy("v", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    sample = entries.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return entries, None
    index = Index(_matrix(sample["v"], np.float64), min(CODEWORDS, max(1, round(math.sqrt(entries.count() / CELL)))))
    celled = store(entries.select("label", "v", "ids").mapInArrow(partial(_celled, index=index), "label long, v array<long>, ids array<long>, cell int, r1 double, r2 double"))
    radii = [np.zeros(len(b)) for b in index.books]
    found = celled.groupBy("cell").agg(F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()
    for r in found:
        i, j = divmod(r.cell, index.words)
        radii[0][i], radii[1][j] = max(radii[0][i], r.r1), max(radii[1][j], r.r2)
    index.occupy(radii, [r.cell for r in found])
    return celled, index


def mine(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (rows that fulfil ``is_anchor``, a condition on vec_id) and each of its ``positives`` best rows of
    the same label: the ``negatives`` best rows of other labels whose score is ``low`` to ``high`` percent of the
    positive's.
    """
    ship(vectors.sparkSession)
    rows = store(usable(vectors))
    entries, index = build(rows, max(positives, negatives) + 1)
    if index is None:
        return rows.limit(0).selectExpr("vec_id as anchor_id", "vec_id as positive_id", "0 as rank", "vec_id as negative_id", "label as positive_score", "label as negative_score")
    anchors = rows.where(is_anchor).select(F.col("vec_id").cast("long").alias("anchor_id"), F.xxhash64("vec_id", "label", "v").alias("a"), "label", "v")
    top = F.lit((1 << 62) - 1)
    near = _pursue(anchors.withColumn("limits", F.array(top)), entries, index, True, positives).drop("limit")
    scores = near.where(low * F.col("score") <= high * F.col("score")).groupBy("anchor_id", "a").agg(F.collect_set("score").alias("limits"))
    hard = _pursue(anchors.join(scores, ["anchor_id", "a"]), entries, index, False, negatives, low, high)
    pairs = near.select("anchor_id", "a", F.col("vec_id").alias("positive_id"), F.col("score").alias("limit"))
    found = pairs.join(hard.select("anchor_id", "a", "limit", F.col("vec_id").alias("negative_id"), "score"), ["anchor_id", "a", "limit"])
    rank = F.row_number().over(Window.partitionBy("anchor_id", "a", "positive_id").orderBy(F.desc("score"), "negative_id"))
    return found.select("anchor_id", "positive_id", rank.alias("rank"), "negative_id", F.col("limit").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
