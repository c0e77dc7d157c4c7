"""Ranked lexical search by pipelined term partitioning.

Terms are the runs of letters, digits and bytes beyond ASCII of a text, A-Z lower-cased. Documents are read once;
each task keeps the postings of the items' terms for shards of at most ``SHARD`` documents (fewer of long ones). The terms are dealt to
``OWNERS`` owners by document frequency, the rarest first, each with about as many postings. Items travel in
bundles of ``BUNDLE``: for every shard a bundle carries its terms' weights and its sparse accumulators (item,
document, score) from owner to owner, where a cogroup brings it together with that owner's postings of the shard
and the integer contributions are added. After the last owner each shard gives the ``k`` best of an item, and the
best of these are the result.

With postings of the rarest terms added first, an accumulator whose score plus all that the terms to come can add
stays below the k-th score of its item in the shard can't be among the k best, and is let go; nor is one begun that
could not reach that score. This is exact: contributions are not negative, the k-th score only rises, and ties are
kept.

A document's part for a term of weight w = floor(1000 ln((2N+2)/(2df+1))) is w * ((10^9 tf) div (1000 tf + 12 m))
with m = 75 + (25 n N) div L, in 64-bit integers.

The items' terms are broadcast to the scan in passes of at most ``PASS_BYTES`` each; a term found by its hash is
compared letter by letter. Terms of more bytes than that in all take several passes over the documents.

Defined cases: null and empty texts have no terms and do not count in N; a document without doc_id counts in all
statistics and is never returned; repeated rows are documents of their own; equal rows of ``items`` are one item,
other rows with the same item_id are items of their own, an item_id may be null; an item without terms has no
result; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import documents, ship, store
from ledgerlens.llm.packed import fold, fold_numbers, unfold, unfold_numbers

TOP, OWNERS, BUNDLE, LANE, SHARD, SHARD_TERMS, PASS_BYTES = 20, 4, 64, 8, 16_384, 4_000_000, 8_000_000
#: No document adds as much as this for one occurrence of a term of weight 1.
LIMIT = 1_000_000
_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Vocabulary:
    """Some terms by hash; the number of a term is its place in the list given."""

    def __init__(self, terms):
        data = [t.encode() for t in terms]
        ends = np.cumsum([len(d) for d in data], dtype=np.int64)
        self.buffer, self.starts, self.ends = np.frombuffer(b"".join(data), np.uint8), ends - [len(d) for d in data], ends
        keys = K.byte_hash(self.buffer, self.starts, self.ends)
        self.number = np.argsort(keys, kind="stable")
        self.keys = keys[self.number]

    def find(self, texts):
        """(word, number of its term) for the words of a block that are terms here."""
        keys = texts.word_hashes()
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        word = np.flatnonzero(high > low)
        times = high[word] - low[word]
        word, number = np.repeat(word, times), self.number[K.ranges(low[word], times)]
        same = K.same_spans(texts.buffer, texts.starts[word], texts.ends[word], self.buffer, self.starts[number], self.ends[number])
        return word[same], number[same]


_SHARD = "shard long, n_documents long, n_terms long, ids binary, sizes binary, numbers array<int>, dfs array<int>, lengths array<int>, at binary, tf binary"


def _scan(batches, table, shard):
    """One row per shard: its documents and, by term, the documents (places in the shard) with their counts."""
    vocabulary, task, count = table.value, TaskContext.get().partitionId(), 0
    held, size, words = [], 0, 0

    def out():
        nonlocal held, size, words, count
        shift = np.cumsum([0] + [len(h[1]) for h in held])[:-1]
        ids, sizes = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        at, number, tf = np.concatenate([h[2] + s for h, s in zip(held, shift, strict=True)]), *(np.concatenate([h[i] for h in held]) for i in (3, 4))
        order = np.lexsort((at, number))
        at, number, tf = at[order], number[order], tf[order]
        numbers, first = np.unique(number, return_index=True)
        dfs = np.diff(np.append(first, len(number)))
        # Documents without an id are counted, but they are no candidates.
        named = ids[at, 0] == 1
        lengths = np.add.reduceat(named.astype(np.int64), first) if len(first) else dfs
        at, tf = at[named], tf[named]
        # Differences of places; each term begins anew.
        step, begin = np.diff(at, prepend=0), (np.cumsum(lengths) - lengths)[lengths > 0]
        step[begin] = at[begin]
        row = [(task << 32) + count, int((sizes > 0).sum()), int(sizes.sum()), fold(ids), fold_numbers(sizes), numbers.tolist(), dfs.tolist(), lengths.tolist(), fold_numbers(step), fold_numbers(tf)]
        held, size, words, count = [], 0, 0, count + 1
        kinds = [*[pa.int64()] * 3, *[pa.binary()] * 2, *[pa.list_(pa.int32())] * 3, *[pa.binary()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split(" ")[0] for x in _SHARD.split(", ")])

    for batch in batches:
        for rows, data, offsets in K.blocks(batch, "text"):
            texts = K.Texts(data, offsets, lower=True, space=K.TERM_SPACE)
            word, number = vocabulary.find(texts)
            owner = np.searchsorted(texts.first, word, "right") - 1
            pair, tf = np.unique(owner * len(vocabulary.keys) + number, return_counts=True)
            at, number = (pair // len(vocabulary.keys), pair % len(vocabulary.keys)) if len(pair) else (pair, pair)
            ids = batch.column("doc_id").slice(rows.start, len(texts))
            # Two numbers a document: whether it has an id, and the id.
            ids = np.stack([np.asarray(ids.is_valid()).astype(np.int64), ids.fill_null(0).to_numpy()], axis=1)
            for low in range(0, len(texts), shard):
                part = slice(*np.searchsorted(at, [low, low + shard]))
                sizes = np.diff(texts.first)[low : low + shard]
                # By documents and words alone, so that every pass makes the same shards.
                if held and (size + len(sizes) > shard or words > SHARD_TERMS):
                    yield out()
                held.append((ids[low : low + shard], sizes, at[part] - low, number[part], tf[part]))
                size, words = size + len(sizes), words + int(sizes.sum())
    if held:
        yield out()


def _split(batches, owners, total, length):
    """The postings of each shard by owner, with each document's part for weight 1."""
    for batch in batches:
        for row in batch.to_pylist():
            numbers, lengths = np.array(row["numbers"], np.int64), np.array(row["lengths"], np.int64)
            n = unfold_numbers(row["sizes"]).astype(np.int64)
            step, tf = unfold_numbers(row["at"]).astype(np.int64), unfold_numbers(row["tf"]).astype(np.int64)
            first = np.cumsum(lengths) - lengths
            before = np.append(0, np.cumsum(step))
            at = before[1:] - np.repeat(before[first], lengths)
            m = 75 + (25 * n * total) // max(1, length)
            part = (1_000_000_000 * tf) // (1000 * tf + 12 * m[at])
            of = owners.value[numbers]
            out = []
            for owner in np.unique(of).tolist():
                rows = np.flatnonzero(of == owner)
                take = K.ranges(first[rows], lengths[rows])
                out.append((row["shard"], owner, row["pass"], fold_numbers(numbers[rows]), fold_numbers(lengths[rows]), fold_numbers(at[take]), fold_numbers(part[take])))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], ["shard", "owner", "pass", "numbers", "lengths", "at", "part"])


def _kth(scores, k):
    return int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0


def _at_owner(owner, k, shard):
    def step(left, right):
        return _advance(left, right, owner, k, shard)

    return step


def _advance(left, right, owner, k, shard):
    """Bundles at one owner of one shard: its postings are added to their accumulators."""
    postings = {}
    for row in right.to_pylist():
        lengths = unfold_numbers(row["lengths"]).astype(np.int64)
        ends = np.cumsum(lengths)
        at, part = unfold_numbers(row["at"]).astype(np.int64), unfold_numbers(row["part"]).astype(np.int64)
        for number, a, b in zip(unfold_numbers(row["numbers"]).tolist(), (ends - lengths).tolist(), ends.tolist(), strict=True):
            postings[row["pass"], number] = at[a:b], part[a:b]
    dense, out = np.zeros(shard, np.int64), []
    for row in left.to_pylist():
        # Per item: its terms (owner, pass, number, weight) and its accumulators.
        terms, count = unfold(row["terms"], np.int64).reshape(-1, 5), len(row["keys"])
        held = unfold(row["held"], np.int64).reshape(3, -1)
        edges = np.searchsorted(held[0], np.arange(count + 1))
        bounds, new = np.searchsorted(terms[:, 0], np.arange(count + 1)), []
        for i in range(count):
            at, scores = held[1, edges[i] : edges[i + 1]], held[2, edges[i] : edges[i + 1]]
            mine = terms[bounds[i] : bounds[i + 1]]
            here, later = mine[mine[:, 1] == owner], int(mine[mine[:, 1] > owner, 4].sum()) * LIMIT
            found = [(*postings[p, n], w) for _, _, p, n, w in here.tolist() if (p, n) in postings]
            if found:
                dense[at] = scores
                # Documents without an accumulator come in only if all terms left could lift them to the k-th score.
                if int(here[:, 4].sum()) * LIMIT + later >= _kth(scores, k):
                    for places, part, weight in found:
                        dense[places] += weight * part
                    touched = np.flatnonzero(dense)
                else:
                    for places, part, weight in found:
                        known = dense[places] > 0
                        dense[places[known]] += weight * part[known]
                    touched = at
                scores, at = dense[touched], touched
                dense[touched] = 0
            keep = scores + later >= _kth(scores, k)
            new.append(np.stack([np.full(int(keep.sum()), i), at[keep], scores[keep]]))
        out.append((row["shard"], row["lane"], row["keys"], row["terms"], fold(np.concatenate(new, axis=1))))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], ["shard", "lane", "keys", "terms", "held"])


_BUNDLE = "shard long, lane long, keys array<long>, terms binary, held binary"


def _bundles(table):
    """Items of a bundle numbered 0, 1, ... by their keys; (item number, owner, pass, number, weight) of all terms."""
    keys = np.asarray(table["item"])
    items, at = np.unique(keys, return_inverse=True)
    rows = np.stack([at, *(np.asarray(table[c]).astype(np.int64) for c in ("owner", "pass", "number", "weight"))], axis=1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    return pa.table({"bundle": pa.array([table["bundle"][0].as_py()], pa.int64()), "keys": pa.array([items.tolist()], pa.list_(pa.int64())), "terms": pa.array([fold(rows)], pa.binary())})


def _best(batches, k):
    """The k best of each item in a shard: highest score, then smallest doc_id."""
    for batch in batches:
        for row in batch.to_pylist():
            held, ids = unfold(row["held"], np.int64).reshape(3, -1), unfold(row["ids"], np.int64).reshape(-1, 2)
            item, doc, score = held[0], ids[held[1], 1], held[2]
            order = np.lexsort((doc, -score, item))
            item, doc, score = item[order], doc[order], score[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            top = place < k
            keys = np.array(row["keys"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[item[top]], pa.int64()), pa.array(doc[top], pa.int64()), pa.array(score[top], pa.int64())], ["item", "doc_id", "score"])


def _terms(items: DataFrame) -> DataFrame:
    """(item, term, times): the terms of every item. Java matches the pattern by code points, as bytes would."""
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    return items.select("item", F.explode(F.regexp_extract_all(lowered, F.lit(_PATTERN), F.lit(0))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))


def _numbered(terms: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(term, pass, number) of the distinct terms and the number of passes; none has more than ``most`` bytes of terms
    unless a single term is larger."""
    distinct = store(terms.select("term").distinct())
    length = F.octet_length("term")
    total, largest = distinct.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.max(length), F.lit(0))).first()
    most, passes = max(most, largest), max(1, -(-total // max(1, most)))
    while True:
        dealt = distinct.withColumn("pass", F.pmod(F.xxhash64("term"), F.lit(passes)).cast("int"))
        sizes = dealt.groupBy("pass").agg(F.sum(length).alias("n")).agg(F.max("n").alias("n")).first()
        if passes == 1 or sizes["n"] <= most or passes > 4 * distinct.count():
            break
        passes *= 2
    number = F.row_number().over(Window.partitionBy("pass").orderBy("term")) - 1
    return store(dealt.withColumn("number", number)), passes


def _owners(dfs: DataFrame, owners: int) -> list[float]:
    """Bounds of the logarithm of document frequency between owners, so that each has about as many postings."""
    level = F.floor(8 * F.log2("df"))
    rows = sorted(tuple(r) for r in dfs.groupBy(level.alias("level")).agg(F.sum("df").alias("n")).collect())
    total, run, cuts = sum(n for _, n in rows), 0, []
    for level, n in rows:
        run += n
        while len(cuts) < owners - 1 and run * owners >= total * (len(cuts) + 1):
            cuts.append(level)
    # A cut at the commonest level would leave the owner above without postings.
    return sorted({c for c in cuts if c < max(rows)[0]}) if rows else []


def search(docs: DataFrame, items: DataFrame, k: int = TOP, owners: int = OWNERS, shard: int = SHARD, most: int = PASS_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of every item with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    listed = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    listed = store(listed.withColumn("item", F.xxhash64("item_id", "text")))
    terms = store(_terms(listed.select("item", "text")))
    vocabulary, passes = _numbered(terms, most)

    source, shards, sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None, []
    if passes > 1:
        # Stored, so every pass reads the same rows in the same order.
        source = store(source)
    for p in range(passes):
        mine = [r.term for r in vocabulary.where(F.col("pass") == p).select("number", "term").orderBy("number").collect()]
        table = spark.sparkContext.broadcast(Vocabulary(mine))
        scanned = store(source.mapInArrow(partial(_scan, table=table, shard=shard), _SHARD).withColumn("pass", F.lit(p)))
        sizes.append(len(mine))
        shards = scanned if shards is None else shards.union(scanned)
    first = shards.where("pass = 0")
    total, length = first.agg(F.coalesce(F.sum("n_documents"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    counted = shards.select("pass", F.explode(F.arrays_zip("numbers", "dfs")).alias("x")).groupBy("pass", F.col("x.numbers").alias("number")).agg(F.sum("x.dfs").alias("df"))
    counted = store(counted)
    cuts = _owners(counted, owners)
    level = F.floor(8 * F.log2("df"))
    owner = sum((F.when(level > c, 1).otherwise(0) for c in cuts), F.lit(0))
    counted = counted.withColumn("owner", owner)
    split = None
    for p in range(passes):
        of = np.zeros(max(1, sizes[p]), np.int8)
        for r in counted.where(F.col("pass") == p).select("number", "owner").collect():
            of[r.number] = r.owner
        part = shards.where(F.col("pass") == p).mapInArrow(partial(_split, owners=spark.sparkContext.broadcast(of), total=total, length=length), "shard long, owner int, pass int, numbers binary, lengths binary, at binary, part binary")
        split = part if split is None else split.union(part)
    split = store(split)

    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.col("df") + 1)))
    weighted = terms.join(vocabulary, "term").join(counted, ["pass", "number"])
    bundles = max(1, -(-listed.count() // BUNDLE))
    weighted = weighted.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).alias("bundle"), "owner", "pass", "number", (weight * F.col("times")).cast("long").alias("weight")).where("weight > 0")
    packed = store(weighted.groupBy("bundle").applyInArrow(_bundles, "bundle long, keys array<long>, terms binary"))

    # Every bundle starts in every shard; each of its copies serves some hundred shards, so no key is hot.
    lanes, salts = max(1, -(-bundles // LANE)), max(1, -(-first.count() // 256))
    salt = F.pmod(F.xxhash64("shard"), F.lit(salts))
    every = first.select("shard", salt.alias("salt"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long"))).alias("bundle"))
    copies = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    nothing = bytearray(fold(np.empty((3, 0), np.int64)))
    state = every.join(copies, ["bundle", "salt"]).select("shard", F.pmod(F.col("bundle"), F.lit(lanes)).alias("lane"), "keys", "terms", F.lit(nothing).alias("held"))
    for owner in range(len(cuts) + 1):
        here = split.where(F.col("owner") == owner).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
        state = state.groupBy("shard", "lane").cogroup(here.groupBy("shard", "lane")).applyInArrow(_at_owner(owner, k, shard), _BUNDLE)
    best = state.select("shard", "keys", "held").join(first.select("shard", "ids"), "shard").select("keys", "held", "ids").mapInArrow(partial(_best, k=k), "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(listed.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "score")


def query(spark, sf_dir):
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
