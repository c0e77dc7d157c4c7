"""Benchmark decontamination: a broadcast hash set of test windows, hits verified, spans or documents removed.

Words are the runs of letters, digits and bytes beyond ASCII of a text with A-Z lower-cased. Every ``SIZE``
consecutive words of a benchmark item are a window; an item of fewer words is one window. The windows' hashes go
to all tasks in one sorted table together with the items' words; each task hashes the windows of its documents,
looks them up, and confirms every word of a hit letter by letter before it counts. Documents are read once and
nothing is shuffled.

The table that is broadcast holds at most ``PASS_BYTES`` of benchmark text. A larger benchmark is dealt into as
many passes as needed: items are cut into segments that overlap by ``SIZE`` - 1 words, passes are measured, and
the documents' rows take up the hits of one pass after another (stored after every ``CHAINED`` passes, so that
few tables are in memory at a time). So the driver and the tasks hold one pass, however large the benchmark is.

Defined cases: null and empty texts have no words and no hits; an item without words has no window; equal rows
are judged each; items that share an item_id are one item with the windows of all; an item without item_id hits
words but is not named or counted; an empty benchmark hits nothing, no documents give an empty result; further
columns of the benchmark are ignored, those of the documents pass through unless the result has that name.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import documents, ship, store, unboxed

SIZE, PASS_BYTES, SEGMENT_WORDS, CHAINED = 10, 8_000_000, 20_000, 4

_HIT = "n_words long, starts array<int>, ends array<int>, from_bytes array<int>, to_bytes array<int>, items array<string>"


def _segments(batches, size, most):
    """(item_id, words, n): the words of each item joined by spaces, in segments of at most ``most`` words."""
    for batch in batches:
        for rows, data, offsets in K.blocks(batch, "text"):
            texts = K.Texts(data, offsets, lower=True, space=K.TERM_SPACE)
            ids, out = batch.column("item_id").slice(rows.start, len(texts)), []
            for i in range(len(texts)):
                first, last = int(texts.first[i]), int(texts.first[i + 1])
                for at in range(first, max(first + 1, last - size + 1), most):
                    words = [texts.buffer[a:b].tobytes() for a, b in zip(texts.starts[at : at + most + size - 1].tolist(), texts.ends[at : min(last, at + most + size - 1)].tolist(), strict=False)]
                    if words:
                        out.append((i, b" ".join(words).decode()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in out], pa.int64())), pa.array([w for _, w in out], pa.string())], ["item_id", "words"])


class WindowSet:
    """The distinct windows of some segments: sorted hashes, where each one's words are, and its items."""

    def __init__(self, segments, size):
        data = [w.encode() for _, w in segments]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        texts = K.Texts(np.frombuffer(b"".join(data), np.uint8), offsets, space=K.TERM_SPACE)
        self.buffer, self.starts, self.ends = texts.buffer, texts.starts, texts.ends
        hashes, counts = texts.word_hashes(), np.diff(texts.first)
        first, length, keys, owner = [], [], [], []
        for n in np.unique(np.minimum(counts, size)).tolist():
            whole = np.minimum(counts, size) == n
            number = np.where(whole, counts - n + 1, 0)
            at = K.ranges(texts.first[:-1], number)
            first.append(at)
            length.append(np.full(len(at), n))
            keys.append((K.windows(hashes, n) ^ K.U(n))[at])
            owner.append(np.repeat(np.arange(len(data)), number))
        first, length, keys, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (first, length, keys, owner))
        order = np.lexsort((length, keys))
        first, length, keys, owner = first[order], length[order], keys[order].astype(K.U), owner[order]
        # A window equal to the one before is the same entry; unlike windows of one hash are entries of their own.
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (length[1:] != length[:-1])
        again = np.flatnonzero(~new)
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        new[again] = ~self._equal(self, first[again], first[lead[again]], length[again])
        entry = np.cumsum(new) - 1
        entry[~new] = entry[lead[~new]]
        self.keys, self.first, self.length = keys[new], first[new], length[new]
        self.lengths = np.unique(self.length).tolist()
        names = [i for i, _ in segments]
        self.names = np.array([n for n in dict.fromkeys(names) if n is not None], object)
        number = {n: k for k, n in enumerate(self.names)}
        item = np.array([number.get(n, -1) for n in names], np.int64)[owner]
        pairs = np.unique(np.stack([entry, item], axis=1)[item >= 0], axis=0) if len(entry) else np.empty((0, 2), np.int64)
        self.items, self.items_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1))

    def _equal(self, texts, at, first, length):
        """Whether the ``length`` words of ``texts`` from ``at`` and those here from ``first`` are the same."""
        out = np.ones(len(at), bool)
        for j in range(int(length.max(initial=0))):
            rows = np.flatnonzero(out & (j < length))
            a, b = at[rows] + j, first[rows] + j
            out[rows] = K.same_spans(texts.buffer, texts.starts[a], texts.ends[a], self.buffer, self.starts[b], self.ends[b])
        return out

    def hits(self, texts):
        """(first word, entry) of every window of the texts that is in the set, in order of the words."""
        hashes, text_of = texts.word_hashes(), np.repeat(np.arange(len(texts)), np.diff(texts.first))
        found = [np.empty((0, 2), np.int64)]
        for n in self.lengths:
            if len(hashes) < n:
                continue
            keys = K.windows(hashes, n) ^ K.U(n)
            keys_from, keys_to = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
            at = np.flatnonzero((keys_to > keys_from) & (text_of[: len(keys)] == text_of[n - 1 :]))
            number = keys_to[at] - keys_from[at]
            at, entry = np.repeat(at, number), K.ranges(keys_from[at], number)
            right = self.length[entry] == n
            at, entry = at[right], entry[right]
            right = self._equal(texts, at, self.first[entry], self.length[entry])
            found.append(np.stack([at[right], entry[right]], axis=1))
        found = np.concatenate(found)
        return found[np.argsort(found[:, 0], kind="stable")]


def _strings(column):
    return [set(x) for x in column.to_pylist()]


def _scan(batches, table):
    """Rows with their hits so far, and those with the windows of one table."""
    windows = table.value
    for batch in batches:
        parts = {name: batch.column(batch.schema.get_field_index(name)) for name in batch.schema.names}
        for rows, data, offsets in K.blocks(batch, "text"):
            texts = K.Texts(data, offsets, lower=True, space=K.TERM_SPACE)
            found = windows.hits(texts)
            cover = np.zeros(len(texts.starts) + 1, np.int64)
            np.add.at(cover, found[:, 0], 1)
            np.add.at(cover, found[:, 0] + windows.length[found[:, 1]], -1)
            covered = np.cumsum(cover[:-1]) > 0
            count = len(texts)
            old = {k: v.slice(rows.start, count) for k, v in parts.items()}
            for a, b, i in zip(old["starts"].to_pylist(), old["ends"].to_pylist(), range(count), strict=True):
                for x, y in zip(a, b, strict=True):
                    covered[texts.first[i] + x : texts.first[i] + y] = True
            edge = np.zeros(len(covered) + 1, bool)
            edge[texts.first] = True
            begins = np.flatnonzero(covered & (~np.concatenate([[False], covered[:-1]]) | edge[:-1]))
            ends = np.flatnonzero(covered & (~np.concatenate([covered[1:], [False]]) | edge[1:])) + 1
            owner = np.searchsorted(texts.first, begins, "right") - 1
            per_text = np.bincount(owner, minlength=count)
            items = _strings(old["items"])
            pairs = np.unique(np.stack([np.searchsorted(texts.first, found[:, 0], "right") - 1, found[:, 1]], axis=1), axis=0)
            for i, e in pairs.tolist():
                items[i].update(windows.names[windows.items[windows.items_from[e] : windows.items_from[e + 1]]])
            numbers = {
                "starts": begins - texts.first[owner], "ends": ends - texts.first[owner],
                "from_bytes": texts.starts[begins] - offsets[owner], "to_bytes": texts.ends[ends - 1] - offsets[owner],
            }
            new = {k: K.list_array(v, per_text, pa.int32()) for k, v in numbers.items()}
            new |= {"n_words": pa.array(np.diff(texts.first), pa.int64()), "items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(k, old[k]) for k in parts], list(parts))


def _passes(benchmark: DataFrame, size: int, most: int):
    """Stored segments (item_id as text, words, pass) and the number of passes, none larger than ``most`` bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = min(SEGMENT_WORDS, max(1, most // 100))
    cut = store(items.mapInArrow(partial(_segments, size=size, most=words), "item_id string, words string").distinct())
    length = F.octet_length("words")
    total, largest = cut.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.max(length), F.lit(0))).first()
    # A segment of few but very long words may be larger than a pass; then it is a pass of its own.
    most, number = max(most, largest), max(1, -(-total // max(1, most)))
    while True:
        dealt = cut.withColumn("pass", F.pmod(F.xxhash64("item_id", "words"), F.lit(number)).cast("int"))
        if number == 1 or number > 4 * cut.count() or dealt.groupBy("pass").agg(F.sum(length).alias("n")).agg(F.max("n")).first()[0] <= most:
            return dealt, number
        number *= 2


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most: int = PASS_BYTES) -> DataFrame:
    """(_row, text, n_words, starts, ends, from_bytes, to_bytes, items): hit ranges of every row's words and bytes."""
    spark = docs.sparkSession
    ship(spark)
    dealt, number = _passes(benchmark, size, most)
    # The text travels once, beside the other columns.
    others = F.struct(*(c for c in docs.columns if c != "text"), F.lit(0).alias("_"))
    rows = docs.select(others.alias("_row"), F.col("text").cast("string").alias("text"))
    kinds = [x.split(" ") for x in _HIT.split(", ")]
    rows = rows.select("_row", "text", *((F.lit(0) if kind == "long" else F.array()).cast(kind).alias(name) for name, kind in kinds))
    for k in range(number):
        segments = [(r.item_id, r.words) for r in dealt.where(F.col("pass") == k).select("item_id", "words").collect()]
        table = spark.sparkContext.broadcast(WindowSet(segments, size))
        rows = rows.mapInArrow(partial(_scan, table=table), rows.schema)
        if k % CHAINED == CHAINED - 1 and k < number - 1:
            rows = store(rows)
    return rows


def _text(docs: DataFrame):
    return F.col("text").cast(docs.schema["text"].dataType)


def judge(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, most: int = PASS_BYTES) -> DataFrame:
    """Columns of ``docs``, then n_words, n_hit (words inside a window), items (ids of the items hit, as text),
    spans (from, to: hit ranges of words) and contaminated."""
    found = hits(docs, benchmark, size, most)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    spans = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    added = {"n_words": F.col("n_words"), "n_hit": n_hit, "items": F.col("items"), "spans": spans, "contaminated": F.size("starts") > 0}
    return unboxed(found, [c for c in docs.columns if c not in added], *(v.alias(k) for k, v in added.items()), text=_text(docs))


def _cut(batches):
    for batch in batches:
        text, a, b = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "from_bytes", "to_bytes"))
        out = []
        for t, starts, ends in zip(text, a, b, strict=True):
            if starts:
                data = t.encode()
                kept = [data[x:y] for x, y in zip([0, *ends], [*starts, len(data)], strict=True)]
                t = b"".join(kept).decode()
            out.append(t)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["_row", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", size: int = SIZE, most: int = PASS_BYTES) -> DataFrame:
    """The documents without what the benchmark holds; columns as given.

    ``remove="spans"`` cuts the hit words with all between them out of the texts, ``remove="documents"`` leaves out
    documents with a hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be 'spans' or 'documents', not {remove!r}")
    found = hits(docs, benchmark, size, most)
    if remove == "documents":
        return unboxed(found.where(F.size("starts") == 0), docs.columns, text=_text(docs))
    rest = found.select("_row", "text", "from_bytes", "to_bytes").mapInArrow(_cut, found.select("_row", "text").schema)
    return unboxed(rest, docs.columns, text=_text(docs))


def query(spark, sf_dir):
    judged = judge(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named.alias("items_sha256"), "contaminated")
