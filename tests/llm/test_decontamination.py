"""Benchmark windows in documents against a plain version."""

import hashlib
import random
import re
from collections import Counter

import pytest

from ledgerlens.llm import decontamination
from tests.llm import reference as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(R.LOWER))


def text(seed, n, kinds=6):
    r = random.Random(seed)
    return " ".join(r.choice("aAbé")[: 1 + r.randrange(2)] + str(r.randrange(kinds)) for _ in range(n))


def tables():
    items = [(i, text(f"i{i}", 14 + i, 3), "x") for i in range(12)]
    items += [(20, "Short one", "x"), (21, "short, ONE!", "x"), (22, "lone", "x"), (23, "", "x"), (24, None, "x"), (25, " ,.- ", "x"), (None, text("nameless", 12), "x")]
    items += [(0, text("second text of an id", 11), "x"), items[3], (26, text("long", 3000, 900), "x")]
    docs = [(i, text(f"d{i}", 40 + 5 * i, 3), 1) for i in range(40)]
    for k, (_, t, _) in enumerate(items):
        docs.append((100 + k, f"{text(k, 7)}\n{(t or '').upper()}... {text(-k, 5)}", 1))
        w = terms(t)
        docs.append((200 + k, " - ".join(w[3:13]) + "\n\n" + " ".join(w[:9]), 1))
    docs += [(300, None, 1), (301, "", 1), (302, "lone", 1), (303, "alone lonely", 1), (304, "short\tone short", 1), (None, "lone wolf", 1), (None, "lone wolf", 1), (305, "x " * 5000 + (items[2][1] + " ") * 300, 1)]
    docs += [docs[40]] * 3
    return docs, items


def plain(docs, items, size=10):
    windows = {}
    for i, t, _ in items:
        w = terms(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t, _ in docs:
        w, hit, named = terms(t), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    named |= windows[tuple(w[k : k + n])]
        named = sorted(str(i) for i in named if i is not None)
        out.append((d, len(w), len(hit), named, bool(hit)))
    return out


@pytest.mark.parametrize(("most", "size"), [(8_000_000, 10), (4000, 10), (9000, 4)])
def test_hits_equal_a_plain_version(spark, most, size):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string, starts int").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string, words string")
    got = decontamination.judge(df, bench, size, most)
    assert {"doc_id", "text", "starts"} <= set(got.columns)
    rows = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got.collect())
    assert rows == Counter((d, n, h, tuple(i), c) for d, n, h, i, c in plain(docs, items, size))
    assert all(r.n_hit == sum(s["to"] - s["from"] for s in r.spans) for r in got.select("n_hit", "spans").collect())


def test_spans_or_documents_go(spark):
    docs, items = tables()
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, _row int, n_chars int")
    bench = spark.createDataFrame(items, "item_id long, text string, x string")
    judged = plain(docs, items)
    clean = decontamination.decontaminate(df, bench, "documents")
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, *_, c in judged if not c)
    cut = {r.doc_id: r for r in decontamination.decontaminate(df, bench).collect()}
    assert cut[302].text == "" and cut[303].text == "alone lonely" and cut[304].text == " short" and cut[300].text is None
    assert all(len(terms(cut[d].text)) == n - h for d, n, h, *_ in judged if d is not None)
    assert all(r.n_chars == len(r.text or "") for r in cut.values() if r.text is not None)
    with pytest.raises(ValueError):
        decontamination.decontaminate(df, bench, "rows")


def test_empty_tables_and_equal_hashes(spark, monkeypatch):
    docs, items = tables()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, x int"), spark.createDataFrame(items, "item_id long, text string, x string")
    assert decontamination.judge(df.limit(0), bench).count() == 0
    assert decontamination.judge(df, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0
    # In this process: all windows of one length share a hash, only their words tell them apart.
    from ledgerlens.llm import textkernel as K

    monkeypatch.setattr(K, "windows", lambda hashes, n: K.np.zeros(max(0, len(hashes) - n + 1), K.U))
    table = decontamination.WindowSet([("7", "a b c"), ("8", "a b d"), ("9", "a b c")], 3)
    data = b"x a b c a b d"
    found = table.hits(K.Texts(K.np.frombuffer(data, K.np.uint8), K.np.array([0, len(data)])))
    named = [(at, sorted(table.names[table.items[table.items_from[e] : table.items_from[e + 1]]])) for at, e in found.tolist()]
    assert named == [(1, ["7", "9"]), (4, ["8"])]


def test_query_digest(spark, tmp_path):
    docs, items = tables()
    spark.createDataFrame(docs, "doc_id long, text string, x int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, x string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(tuple(r) for r in decontamination.query(spark, str(tmp_path)).collect())
    assert got == Counter((d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for d, n, h, i, c in plain(docs, items))
