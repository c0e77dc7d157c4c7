"""Operators on documents against plain versions, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import katz, mixing, near_dedup, packing, quality, suffix_dedup
from ledgerlens.llm import textkernel as K
from tests.llm import reference as R


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_near_duplicates(mixed, given):
    got = near_dedup.groups(mixed).select("doc_id", "n_shingles", "component_id", "kept")
    ids = {d: R.shingles(t) for d, t, *_ in given if d is not None}
    links = [(a, b) for a in ids for b in ids if a < b and ids[a] and 100 * len(ids[a] & ids[b]) >= 75 * len(ids[a] | ids[b])]
    label = R.components(ids, links)
    want = Counter((d, len(R.shingles(t)), label.get(d), d == label.get(d) or d is None) for d, t, *_ in given)
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == want
    kept = near_dedup.deduplicate(mixed)
    assert kept.columns == mixed.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").select("doc_id").collect()) == sorted(d for d in ids if label[d] == d)


def test_links_stay_within_classes_and_rounds(spark, monkeypatch):
    """800 near copies: every round confirms at most one link per class, and all of them are found."""
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base[: i % 140] + [f"own{i}"] + base[i % 140 + 1 :]) for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked, confirm = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda links, sets: asked.append(links.count()) or confirm(links, sets))
    assert {r.component_id for r in near_dedup.groups(docs).collect()} == {0}
    assert asked and all(n <= 800 for n in asked) and len(asked) <= 1 + near_dedup.STARS


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_patterned_words_keep_apart(spark):
    words = [thue_morse(n).translate(t) for n in (256, 512, 1024, 4096) for t in ({}, str.maketrans("ab", "ba"))]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r.kept for r in near_dedup.groups(docs).collect())
    table = packing.WordTable(None)
    want = [w.ids for w in table.tokenizer.encode_batch(words, add_special_tokens=False)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, length = table.lookup(K.Texts(data, np.array([0, len(data)])))
    assert [table.ids[a : a + n].tolist() for a, n in zip(start, length, strict=True)] == want


def test_words_of_one_hash_keep_their_ids(monkeypatch):
    monkeypatch.setattr(K.Texts, "word_hashes", lambda self: np.ones(len(self.starts), K.U))
    table = packing.WordTable(None)
    data = np.frombuffer(b"one other one thing", np.uint8)
    start, length = table.lookup(K.Texts(data, np.array([0, len(data)])))
    got = [table.ids[a : a + n].tolist() for a, n in zip(start, length, strict=True)]
    assert got == [w.ids for w in table.tokenizer.encode_batch(["one", "other", "one", "thing"], add_special_tokens=False)]


def test_blocks_find_links_that_stars_miss(spark):
    """A chain in which neighbours are similar and ends are not; every pair is compared in small chunks."""
    tokens = [f"t{i}" for i in range(160)]
    texts = [" ".join([f"x{j}" for j in range(4 * i)] + tokens[4 * i :]) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = near_dedup.store(docs.mapInArrow(near_dedup._full_sets, "n_shingles long, d1 long, d2 long, shingles array<long>").select(near_dedup._class(), "shingles"))
    members = sets.selectExpr("1L as t", "7L as a", "c", "c as l")
    chunk = near_dedup.CHUNK
    near_dedup.CHUNK = 8
    try:
        links = near_dedup._blocks(members, sets).collect()
    finally:
        near_dedup.CHUNK = chunk
    of = {r.c: frozenset(r.shingles) for r in sets.collect()}
    want = R.components(of, [(a, b) for a in of for b in of if a < b and 100 * len(of[a] & of[b]) >= 75 * len(of[a] | of[b])])
    assert R.components(of, [(r.x, r.y) for r in links]) == want
    assert len(set(want.values())) < len(of)


def test_quality(mixed, given):
    got = quality.judge(mixed)
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_row(got, "doc_id", *figures) == Counter((d, *R.quality(t)) for d, t, *_ in given)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got.collect())
    assert got.where("base_failed and kept").isEmpty()


def test_common_lines_go_and_copies_do_not_count(spark):
    text = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n))
    docs = [(i, "Share This  page\n" + text(i), "a") for i in range(60)]
    docs += [(100 + i, "copied line here\n" + text("same"), "a") for i in range(60)]
    docs += [(200, "share this page\n" * 3 + "tiny rest", "a"), (201, "share this page now", "a"), (300, "Share this page\n" + text(300), "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in quality.judge(df, min_words=2, min_documents=20, share=0.02).collect()}
    assert all(rows[i].removed_words == 3 for i in range(60)) and all(rows[i].removed_words == 0 for i in range(100, 160))
    assert rows[300].removed_words == 0 and rows[201].removed_words == 0 and not rows[200].kept
    cleaned = {r.doc_id: r.text for r in quality.clean(df, min_words=2).collect()}
    assert 200 not in cleaned and cleaned[5] == text(5) and cleaned[100] == docs[60][1] and cleaned[300] == docs[-1][1]


def test_lines_of_unlike_texts_with_common_words_are_counted(spark):
    # Skewed words: the most frequent ones are in nearly every text.
    r = random.Random(7)
    text = lambda: " ".join(f"w{int(60 * r.random() ** 3)}" for _ in range(60))
    docs = [(i, "all rights are reserved by us\n" + text(), "a") for i in range(40)] + [(100 + i, text(), "a") for i in range(300)]
    # Copies do not raise the limit of their host: 30 of 31 contents hold the line.
    docs += [(1000 + i, "terms of use\n" + text(), "b") for i in range(30)] + [(2000, text(), "b")] * 2000
    # Near copies count as few: each has one word of its own.
    base = [f"b{j}" for j in range(1000)]
    docs += [(5000 + i, "copied line here\n" + " ".join([*base[: 25 * i], f"own{i}", *base[25 * i :]]), "c") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    removed = {row.doc_id: row.removed_words for row in quality.judge(df, min_words=2).collect()}
    assert all(removed[i] == 6 for i in range(40)) and all(removed[1000 + i] == 3 for i in range(30))
    assert not any(removed[100 + i] for i in range(300)) and not any(removed[5000 + i] for i in range(30))


def test_mixing(mixed, given):
    got = mixing.amounts(mixed).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(R.words(t))) for d, t, *_ in given)
    size = Counter()
    for _, t, _, s, *_ in given:
        size[s] += len(R.words(t))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in size if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source]
        assert math.isclose(r.target, min(2 * size[r.source], level * weight[r.source]))
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)
    again = mixing.amounts(mixed.repartition(3))
    assert by_row(again, "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in got)
    mix = mixing.mix(mixed)
    assert mix.columns == mixed.columns
    assert sum(len(R.words(r.text)) for r in mix.collect()) == sum(taken.values())


@pytest.mark.parametrize("capacity", [4096, 256])
def test_packing(mixed, given, capacity):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    rows = packing.pack(mixed, capacity=capacity).collect()
    whole = Counter()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for d, t, *_ in given:
        whole[d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    found = Counter()
    for d, pieces in by_doc.items():
        # Repeated documents follow one another in the stream.
        text = []
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
            assert r.start == len(text)
            text += r.ids
            if len(text) == r.doc_tokens:
                found[d, tuple(text)] += 1
                text = []
        assert not text
    assert found == whole
    sequences, end = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == end.get(r.sequence_id, 0)
        end[r.sequence_id] = r.offset + r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    assert max(end.values()) <= capacity
    padding = sum(0 if n & (n - 1) == 0 else capacity - n for n in end.values())
    assert padding <= 0.2 * sum(end.values())


def test_best_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        position = np.unique(rng.integers(1, 300, 40))
        position = np.unique(np.concatenate([position, np.arange(16, 301, 16)]))
        penalty = rng.integers(0, 9, len(position))
        cuts = packing.best_cuts(position, penalty, 64, True)
        fine = dict(zip(position.tolist(), penalty.tolist(), strict=True))
        cost = lambda cs: sum(64 - (b - a) + fine[b] for a, b in zip([0, *cs[:-1]], cs, strict=True))
        best = {0: 0}
        for p in position.tolist():
            best[p] = min(best[q] + 64 - (p - q) + fine[p] for q in best if p - q <= 64)
        assert cuts[-1] == position[-1] and cost(cuts) == best[position[-1]]


def test_katz(mixed, given):
    tokens = [(d, R.lowered(t) + [None]) for d, t, *_ in given]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for d, t in tokens:
        if not held(d):
            one.update(t)
            two.update(zip(["start"] + t[:-1], [(w,) for w in t], strict=True))
    n, v = sum(one.values()), len(one)

    def discounts(counts):
        of = Counter(counts.values())
        share = 6 * of[6] / of[1] if of[1] else 1
        kept = {}
        for r in range(1, 6):
            d = ((r + 1) * of[r + 1] / (r * of[r]) - share) / (1 - share) if of[r] and share < 1 else 0
            kept[r] = r * d if 0 < d < 1 else r - 0.5
        return lambda c: c - 0.001 if c > 5 else kept[c]

    d1, d2 = discounts(one), discounts(two)
    unknown = 1 - sum(map(d1, one.values())) / n
    low = lambda w: d1(one[w]) / n if w in one else unknown
    total, follow = Counter(), {}
    for (h, w), c in two.items():
        total[h] += c
        follow.setdefault(h, []).append(w)
    alpha = {h: (1 - sum(d2(two[h, w]) for w in ws) / total[h]) / (1 - sum(low(w[0]) for w in ws)) for h, ws in follow.items()}
    chance = lambda h, w: d2(two[h, (w,)]) / total[h] if (h, (w,)) in two else alpha.get(h, 1) * low(w)
    for h in list(follow)[:20]:
        assert math.isclose(sum(chance(h, w) for w in one) + alpha[h] * unknown, 1)
    got = katz.score(mixed, chunk_tokens=2000).collect()
    key = lambda d: (d is None, d)
    got, tokens = sorted(got, key=lambda r: key(r.doc_id)), sorted(tokens, key=lambda x: key(x[0]))
    assert len(got) == len(tokens)
    for r, (d, t) in zip(got, tokens, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, held(d), len(t), sum(w in one for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(chance(h, w)) for h, w in zip(["start"] + t[:-1], t, strict=True)), rel_tol=1e-9)


@pytest.mark.parametrize("chunk", [1500, 12_000_000])
def test_suffix_dedup(mixed, given, chunk):
    last = float("inf")
    rows = [(last if d is None else d, (t or "").encode()) for d, t, *_ in given]
    least = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], last))
    want = Counter()
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[None if d == last else d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.deduplicate(mixed, chunk_bytes=chunk)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert sum(k[2] for k in want) > 0


@pytest.mark.parametrize("operator", [near_dedup.groups, near_dedup.deduplicate, quality.judge, quality.clean, mixing.amounts, mixing.mix, packing.pack, katz.score, suffix_dedup.deduplicate])
def test_empty_tables(nothing, operator):
    assert operator(nothing).count() == 0
