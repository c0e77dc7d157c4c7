"""Near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

A document is the set of its distinct five-word shingles. Two small collections A and B of ``GROUPS`` keys are
made from ``HALF`` minhashes each; table (i, j) is keyed by the pair (A_i, B_j). So GROUPS * GROUPS tables of
2 * HALF minhashes need only 2 * GROUPS * HALF minhashes. Documents meet in a table exactly if they share a
key of A and a key of B: with similarity s this fails with a chance below 2 * (1 - s^HALF)^GROUPS (3e-4 at
0.75, 2e-5 at 0.8).

Documents with equal sets form one class before anything is paired, so copies cost nothing. Each table names a
pivot among its members, and each class is confirmed against one of them: the pivot it shares most tables with.
Tables whose members then belong to one component are closed. In each of ``STARS`` further rounds a class of an open
table is confirmed against one member of the largest component that shares a key of A with it. So a round has at most
one link per class.
What is still open is compared whole: its keys of A are dealt into chunks of ``CHUNK`` classes and every two chunks
are compared in one task as blocks, which returns only links that join components. Nothing is capped: the blocks
handle any number of members (the pairs of chunks grow with the square of the classes that one key has and no round
could join).

Defined cases: no words or null text: n_shingles 0, linked with nothing; fewer than five words: the whole
sequence is one shingle; repeated rows share a class; a row without doc_id is a component of its own (null)
and is kept; an empty table gives an empty result; further columns are ignored by ``groups`` and pass through
``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import documents, ship, store
from ledgerlens.llm.graph import components

SHINGLE, GROUPS, HALF, CHUNK, STARS, SALTS = 5, 16, 3, 256, 1, 16
PERCENT = 75

_HASHES = 2 * GROUPS * HALF
_TURN, _FACTOR = K.constants(_HASHES, 21), K.constants(_HASHES, 22) | K.U(1)
_FOLD, _TABLE = K.constants(HALF, 23) | K.U(1), K.constants(2 * GROUPS, 24)


def table_keys(shingles):
    """The 2 * GROUPS keys of a set: GROUPS of collection A, then GROUPS of collection B."""
    least = np.full(_HASHES, ~K.U(0))
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[at : at + 4096][None, :] ^ _TURN[:, None]) * _FACTOR[:, None]).min(axis=1), out=least)
    return K.mix((least.reshape(2 * GROUPS, HALF) * _FOLD).sum(axis=1, dtype=K.U) + _TABLE)


def _sets(batch):
    """(rows, list of shingle sets) for each block of a batch."""
    for rows, data, offsets in K.blocks(batch, "text"):
        texts = K.Texts(data, offsets, lower=True)
        hashes = texts.word_hashes()
        yield rows, [K.shingles(hashes[texts.first[i] : texts.first[i + 1]], SHINGLE) for i in range(len(texts))]


def _digest(shingles):
    """128 bits that stand for a set."""
    return K.mix(shingles ^ K.U(0x5151)).sum(dtype=K.U), np.bitwise_xor.reduce(K.mix(shingles ^ K.U(0xA3A3)), initial=0)


def _signatures(batches):
    names = ["doc_id", "n_shingles", "d1", "d2", "a", "b"]
    for batch in batches:
        for rows, sets in _sets(batch):
            digests = [_digest(s) for s in sets]
            keys = [table_keys(s) if len(s) else np.empty(0, K.U) for s in sets]
            halves = [(k[:GROUPS], k[GROUPS:]) for k in keys]
            lengths = [len(a) for a, _ in halves]
            a, b = (K.list_array(K.signed(np.concatenate([h[i] for h in halves])), lengths, pa.int64()) for i in (0, 1))
            figures = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(K.signed([d[i] for d in digests]), pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, len(sets)), *figures, a, b], names)


def _full_sets(batches):
    for batch in batches:
        for _, sets in _sets(batch):
            digests = [_digest(s) for s in sets]
            figures = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(K.signed([d[i] for d in digests]), pa.int64()) for i in (0, 1))]
            lists = K.list_array(K.signed(np.concatenate(sets)), [len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*figures, lists], ["n_shingles", "d1", "d2", "shingles"])


def _class():
    return F.xxhash64("n_shingles", "d1", "d2").alias("c")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, class c, n_shingles and the keys of both collections for every row."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_signatures, f"doc_id {kind}, n_shingles long, d1 long, d2 long, a array<long>, b array<long>")
    return out.select("doc_id", _class(), "n_shingles", "a", "b")


def _shared(classes: DataFrame, side: str) -> DataFrame:
    """(c, keys): the keys of one collection that another class has too."""
    exploded = classes.select("c", F.explode(side).alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return exploded.join(shared, "key").groupBy("c").agg(F.collect_list("key").alias(side))


def tables(classes: DataFrame) -> DataFrame:
    """(t, a, c): the members of every table entry that more than one class has.

    A pair key can only be shared where both of its halves are, so only those are combined.
    """
    halves = _shared(classes, "a").join(_shared(classes, "b"), "c")
    keyed = halves.select("c", "b", F.explode("a").alias("a")).select("c", "a", F.explode("b").alias("b")).select("c", "a", F.xxhash64("a", "b").alias("t"))
    return keyed


def _verified(links: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (x, y) whose full sets are similar enough."""
    left = sets.select(F.col("c").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("c").alias("y"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    union = F.size("sx") + F.size("sy") - both
    # No two sets of too different sizes can be similar enough.
    return links.join(right, "y").join(left, "x").where(100 * F.least(F.size("sx"), F.size("sy")) >= PERCENT * F.greatest(F.size("sx"), F.size("sy"))).where(100 * both >= PERCENT * union).select("x", "y")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (t, a, c, l) of the tables that still hold more than one component."""
    labelled = members.join(labels.withColumnsRenamed({"node": "c", "label": "l"}), "c", "left").withColumn("l", F.coalesce("l", "c"))
    several = labelled.groupBy("t").agg(F.min("l").alias("lo"), F.max("l").alias("hi")).where("lo <> hi").select("t")
    return labelled.join(several, "t")


def _one_each(choices: DataFrame) -> DataFrame:
    """Of the possible links (c, pivot), one row per table: for each class that to the pivot it meets most often."""
    met = choices.groupBy("c", "pivot").agg(F.count("*").alias("n"))
    chosen = met.groupBy("c").agg(F.max(F.struct("n", "pivot")).alias("m"))
    return chosen.select(F.least("c", "m.pivot").alias("x"), F.greatest("c", "m.pivot").alias("y")).distinct()


def _star(members: DataFrame, turn: int) -> DataFrame:
    """For each class of open tables a link to a member of the largest component under one of its keys of A; which
    member, changes by turn. Keys of A hold whole tables, and a class has GROUPS of them instead of GROUPS^2."""
    rows = members.select("a", "c", "l").distinct()
    groups = rows.groupBy("a", "l").agg(F.count("*").alias("n"), F.max(F.struct(F.xxhash64("c", F.lit(turn)).alias("h"), "c")).alias("p"))
    main = groups.groupBy("a").agg(F.max(F.struct("n", "p", "l")).alias("m"))
    rest = _salted(rows, "c", main, ["a"]).where(F.col("l") != F.col("m.l"))
    return _one_each(rest.select("c", F.col("m.p.c").alias("pivot")))


def _compare_blocks(frame):
    """Links between components among the classes of two chunks, one per joined pair of components."""
    import pandas as pd

    frame = frame.drop_duplicates("c")
    sizes = np.array([len(s) for s in frame["shingles"]])
    _, inverse, counts = np.unique(np.concatenate(list(frame["shingles"])), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(frame)), sizes)
    rank = np.cumsum(counts > 1) - 1
    several = counts[inverse] > 1
    column, owner = rank[inverse[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((len(frame), len(frame)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        span = slice(*np.searchsorted(column, [at, at + 4096]))
        slab = np.zeros((len(frame), 4096), np.float32)
        slab[owner[span], column[span] - at] = 1
        common += slab @ slab.T
    label, node = frame["l"].to_numpy(), frame["c"].to_numpy()
    similar = (100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)) & (label[:, None] < label[None, :])
    parent: dict = {}

    def root(v):
        while v in parent:
            v = parent[v]
        return v

    out = []
    for i, j in zip(*np.nonzero(similar), strict=True):
        u, v = root(label[i]), root(label[j])
        if u != v:
            parent[max(u, v)] = min(u, v)
            out.append((node[i], node[j]))
    return pd.DataFrame(out, columns=["x", "y"], dtype="int64")


def _salted(many: DataFrame, by: str, one: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows to the single row of their key; a key with very many rows is spread over ``SALTS`` tasks."""
    copies = one.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return many.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(copies, [*keys, "salt"]).drop("salt")


def _blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components of open tables, from comparing chunks of their classes.

    A component with more than CHUNK classes under a key of A has chunks of its own, which are not compared
    with each other; all other classes of the key share chunks. Keys with equal members are compared once.
    """
    rows = members.select("a", "c", "l").distinct()
    alike = rows.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("h"), F.sum((F.xxhash64("c") % 1000003)).alias("g"))
    once = alike.groupBy("n", "h", "g").agg(F.min("a").alias("a")).select("a")
    rows = _salted(rows, "c", once, ["a"])
    sizes = rows.groupBy("a", "l").agg(F.count("*").alias("own"))
    pooled = sizes.groupBy("a").agg(F.sum(F.when(F.col("own") <= CHUNK, F.col("own")).otherwise(0)).alias("pool"))
    rows = _salted(rows, "c", _salted(sizes, "l", pooled, ["a"]), ["a", "l"])
    alone = F.col("own") > CHUNK
    parts = F.ceil(F.when(alone, F.col("own")).otherwise(F.col("pool")) / CHUNK)
    rows = rows.withColumn("k", F.xxhash64(F.when(alone, F.col("l")).otherwise(F.lit(0)), F.pmod(F.xxhash64("c"), parts)))
    rows = store(rows.select("a", "c", "l", "k", F.when(alone, F.col("l")).alias("lone")))
    chunks = rows.select("a", "k", "lone").distinct()
    other = chunks.select("a", F.col("k").alias("k2"), F.col("lone").alias("lone2"))
    pairs = chunks.join(other, "a").where("k <= k2").where(F.coalesce(F.col("lone") != F.col("lone2"), F.lit(True)))
    pairs = pairs.select("a", "k", "k2", F.explode(F.array_distinct(F.array("k", "k2"))).alias("side"))
    dealt = rows.select("a", F.col("k").alias("side"), "c", "l").join(pairs, ["a", "side"])
    return dealt.join(sets.select("c", "shingles"), "c").groupBy("a", "k", "k2").applyInPandas(lambda f: _compare_blocks(f), "x long, y long")


def groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, c, n_shingles, component_id (smallest doc_id of the component), kept."""
    signed = store(signatures(docs))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = store(some.groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")))
    keyed = tables(classes)
    several = keyed.groupBy("t").agg(F.count("*").alias("n"), F.min("c").alias("pivot")).where("n > 1")
    members = store(keyed.join(several.select("t", "pivot"), "t").select("t", "a", "c", "pivot"))
    candidates = members.select("c").distinct().join(classes.select("c", "rep"), "c")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(candidates.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_full_sets, "n_shingles long, d1 long, d2 long, shingles array<long>").select(_class(), "shingles")
    sets = store(sets.join(candidates.select("c"), "c", "left_semi").groupBy("c").agg(F.first("shingles").alias("shingles")))

    links = store(_verified(_one_each(members.where("c <> pivot").select("c", "pivot")), sets))
    labels = components(links)
    for turn in range(STARS + 1):
        unsettled = store(_open(members, labels).select("t", "a", "c", "l"))
        if unsettled.isEmpty():
            break
        links = links.union(store(_verified(_star(unsettled, turn), sets) if turn < STARS else _blocks(unsettled, sets)))
        labels = components(links)

    named = classes.select("c", "rep").join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest, "label").select("c", "component_id")
    out = signed.select("doc_id", "c", "n_shingles").join(named, "c", "left")
    own = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row of each component, those without words all; columns as given."""
    judged = groups(docs)
    kept = judged.where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir):
    return groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
