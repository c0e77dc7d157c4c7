"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import term_pipeline
from tests.llm import reference as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(R.LOWER))


def plain(docs, items, k=20):
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t, *_ in docs]
    big_n, length = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = Counter()
    for i, text in {(i, t) for i, t, *_ in items}:
        asked, scores = Counter(terms(text)), []
        weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) for t in asked}
        for d, bag, n in bags:
            if d is None:
                continue
            m = 75 + (25 * n * big_n) // max(1, length)
            score = sum(times * weight[t] * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, times in asked.items() if t in bag)
            if score > 0:
                scores.append((-score, d))
        out.update((i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k]))
    return out


def tables():
    r = random.Random(3)
    word = lambda: r.choice(["É", "W", "w"]) + str(int(200 * r.random() ** 3))
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60))), "x") for i in range(400)]
    docs += [(1000 + i, docs[7][1], "x") for i in range(150)] + [(2000, "the " * 30_000 + "rare", "x"), (2001, None, "x"), (2002, "", "x"), (2003, " ., ", "x")]
    docs += [(None, "rare w1 w2 É3", "x")] * 30 + [docs[3]] * 2
    items = [(i, ", ".join(word() for _ in range(r.randrange(1, 25))), 1) for i in range(30)]
    items += [(40, "Rare the the THE", 1), (41, None, 1), (42, "", 1), (43, "unknown terms", 1), (44, docs[7][1], 1), (None, "rare w5", 1), items[0], (1, "w1 W2", 1)]
    return docs, items


@pytest.mark.parametrize(("k", "owners", "shard", "most"), [(20, 4, 16_384, 8_000_000), (5, 3, 16, 8_000_000), (3, 1, 50, 200)])
def test_ranking_equals_a_plain_version(spark, k, owners, shard, most):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string, item string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string, score int")
    got = term_pipeline.search(df, asked, k, owners, shard, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, items, k)


def test_empty_tables(spark):
    docs, items = tables()
    df, asked = spark.createDataFrame(docs, "doc_id long, text string, x string"), spark.createDataFrame(items, "item_id long, text string, x int")
    assert term_pipeline.search(df.limit(0), asked).count() == 0
    assert term_pipeline.search(df, asked.limit(0)).count() == 0
    assert term_pipeline.search(df.where("doc_id >= 2001"), asked).count() == 0


def test_accumulators_are_let_go():
    """In a shard of 3000 documents with one rare and one common term only those that can win are carried on."""
    import numpy as np
    import pyarrow as pa

    from ledgerlens.llm.packed import fold, fold_numbers, unfold

    def postings(number, at, part):
        return {"pass": 0, "numbers": fold_numbers([number]), "lengths": fold_numbers([len(at)]), "at": fold_numbers(at), "part": fold_numbers(part)}

    left = [{"shard": 0, "lane": 0, "keys": [9], "terms": fold(np.array([[0, 0, 0, 0, 5000], [0, 1, 0, 1, 3]])), "held": fold(np.empty((3, 0), np.int64))}]
    rare = postings(0, np.arange(0, 3000, 100), np.arange(30) * 30_000 + 90_000)
    one = term_pipeline._advance(pa.Table.from_pylist(left), pa.Table.from_pylist([rare]), 0, 5, 3000)
    kept = unfold(one.to_pylist()[0]["held"], np.int64).reshape(3, -1)
    assert kept[1].tolist() == [2500, 2600, 2700, 2800, 2900]
    two = term_pipeline._advance(one, pa.Table.from_pylist([postings(1, np.arange(3000), np.full(3000, 500_000))]), 1, 5, 3000)
    kept = unfold(two.to_pylist()[0]["held"], np.int64).reshape(3, -1)
    assert kept[2].tolist() == [5000 * (30_000 * i + 90_000) + 1_500_000 for i in range(25, 30)]
