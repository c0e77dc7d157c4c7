"""Hard negatives against a plain version."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives

KIND = "vec_id long, embedding array<float>, label int, score string, a int"


def plain(rows, step=100, positives=5, negatives=5, low=80):
    fine = sorted({(i, lab, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, lab, *_ in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    length = Counter(len(v) for *_, v in fine).most_common(1)[0][0] if fine else 0
    fine = [r for r in fine if len(r[2]) == length]
    out = Counter()
    for i, lab, v in fine:
        if i % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, m) for j, m, w in fine if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            hard = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out.update((i, j, r + 1, k, -s, -n) for r, (n, k, _) in enumerate(hard))
    return out


def rows(seed, n, d=8, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(labels, d))
    x = (centres[r.integers(0, labels, n)] + r.normal(size=(n, d))).astype(np.float32)
    out = [(i, x[i].tolist(), int(r.integers(0, labels)), "s", 1) for i in range(n)]
    out += [(5000 + i, x[7].tolist(), 1 + i % 2, "s", 1) for i in range(300)]
    out += [(6000 + i, x[3].tolist(), 0, "s", 1) for i in range(4)] + [out[5]] * 3 + [out[100 % n]] * 2
    out += [(7000, None, 1, "s", 1), (7100, [None] + [1.0] * (d - 1), 1, "s", 1), (7200, [float("nan")] * d, 1, "s", 1), (7300, [float("inf")] * d, 1, "s", 1), (7400, [1.0] * d, None, "s", 1), (7500, [1.0] * 3, 1, "s", 1), (None, [1.0] * d, 1, "s", 1), (7600, [0.0] * d, 1, "s", 1), (7700, [-1.0] * d, 99, "s", 1), (7800, [-9.0] * d, 98, "s", 1), (7801, [9.0] * d, 98, "s", 1)]
    return out


@pytest.mark.parametrize(("n", "d"), [(1500, 8), (300, 1), (400, 16)])
def test_mining_equals_a_plain_version(spark, n, d):
    given = rows(n, n, d)
    df = spark.createDataFrame(given, KIND).repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in got.collect()) == plain(given)


def test_large_components_and_small_tables(spark):
    given = [(100 * i, [float(1 << (12 + i)), 3.5e5, -2.0], i % 2, "s", 1) for i in range(8)]
    df = spark.createDataFrame(given, KIND)
    assert Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, 2, 3, 1).collect()) == plain(given, 100, 2, 3, 1)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hard_negatives.mine(df.limit(1), F.col("vec_id") % 100 == 0).count() == 0


def test_cells_come_by_falling_bounds_that_hold():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.normal(size=(3000, 10)))
    index = hard_negatives.Index(x, 9)
    cell, r1, r2 = index.cells(x)
    radii = [np.zeros(9), np.zeros(9)]
    np.maximum.at(radii[0], cell // 9, r1)
    np.maximum.at(radii[1], cell % 9, r2)
    index.occupy(radii, cell.tolist())
    for anchor in x[:20]:
        visits = list(index.visits(anchor))
        assert sorted(c for _, c in visits) == sorted(set(cell.tolist()))
        assert all(a >= b for (a, _), (b, _) in zip(visits, visits[1:], strict=False))
        best = {c: int((x[cell == c] @ anchor).max()) for _, c in visits}
        assert all(best[c] <= bound for bound, c in visits)


def test_anchors_travel_once_per_run_and_are_not_broadcast(spark):
    r = np.random.default_rng(2)
    n = 12_000
    rows = spark.createDataFrame([(i, int(r.integers(0, 3)), x) for i, x in enumerate(np.floor(256 * r.normal(size=(n, 4))).astype(int).tolist())], "vec_id long, label long, v array<long>")
    entries, index = hard_negatives.build(rows, 6)
    batch = pa.RecordBatch.from_pylist([{"anchor_id": i, "a": i, "label": 0, "v": [300 * i, -5, 7, i], "windows": [{"limit": 9, "floor": None}], "seen": 0} for i in range(600)])
    planned = pa.Table.from_batches(hard_negatives._plan([batch], index, 40))
    assert [len(b) for b in planned.to_batches()] == [256, 256, 88]
    for runs in planned["cells"].to_pylist():
        assert sum(map(len, runs)) == 40 and len({c for run in runs for c in run}) == 40
        assert all(len({c // hard_negatives.RUN for c in run}) == 1 for run in runs) and len({run[0] // hard_negatives.RUN for run in runs}) == len(runs)
    asked = spark.createDataFrame(planned.to_pylist(), hard_negatives._PLANNED)
    # A threshold under which Spark takes the anchors for small.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        plan = hard_negatives._visit(asked, entries, True, 5, None, None)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("rightHint=(strategy=broadcast)") == 2
