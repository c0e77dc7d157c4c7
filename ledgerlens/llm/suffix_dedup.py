"""Exact repeated byte strings by merging shard Burrows-Wheeler orders.

A byte is removed if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller id.

Which strings can repeat. Every SPAN-byte string has one anchor: its piece of ``ANCHOR`` bytes with the
smallest hash (the leftmost). Equal strings have equal anchors at equal places, so documents only meet at
anchors that another document has too. Texts are cut into chunks; a chunk asks with the sorted hashes of its
anchors, one packed row per bucket, and learns which of them are shared.

Merging. For shared anchors a chunk sends the bytes its strings cover, equal ones once with their smallest
document. A bucket gets such a shard from every chunk, each ordered by anchor and the bytes to its right. The
orders are merged by interleave refinement: the interleave starts as shard after shard, and each round splits
its blocks by the next symbol (the anchor, then words of eight bytes), stably, so nothing is compared in full;
the round in which two neighbours part gives their common prefix. Then the whole order is extended to the left
symbol by symbol, as a Burrows-Wheeler transform is: a stable pass by the preceding byte gives the order of
the strings that start one byte earlier, and their common prefixes are one more than the minimum over the
range between. Intervals with common prefixes of SPAN bytes are the repeated strings; all members above the
interval's smallest document are repeats. No suffix is sorted twice.

A passage of a third of all documents is one string per chunk, so buckets and tasks stay bounded.

Defined cases: a null or empty text has no bytes; a null doc_id counts as the largest; rows with equal ids do
not remove from each other; an empty table gives an empty result; further columns are ignored. Ids are
integers.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import documents, ship, store, store_by
from ledgerlens.llm.packed import bucket_edges, fold, fold_numbers, pack_keys, unfold, unfold_numbers, unpack_keys

SPAN, ANCHOR, CHUNK_BYTES, BUCKET_BYTES = 50, 20, 5_000_000, 8_000_000
#: Anchors are found in blocks of this many bytes: a block takes some ninety times as much memory.
BLOCK_BYTES = 1_000_000
REACH = SPAN - ANCHOR
LAST = np.iinfo(np.int64).max
_FACTORS = K.constants(ANCHOR // 8 + 1, 51) | K.U(1)


def _gram_hash(buffer, size):
    """A hash of the ``size`` bytes at each position that has as many behind it."""
    n = len(buffer) - size + 1
    if n <= 0:
        return np.empty(0, K.U)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    words = np.ndarray(len(buffer) + 1, "<u8", padded, strides=(1,))
    out = np.zeros(n, K.U)
    # Eight bytes at a time; the last eight end with the string.
    for at, factor in zip([*range(0, size - 8, 8), size - 8], _FACTORS, strict=False):
        out += (words[at : at + n] ^ (out >> K.U(29))) * factor
    out ^= out >> K.U(32)
    out *= K.U(0x9E3779B97F4A7C15)
    out ^= out >> K.U(29)
    return out


def anchors(buffer, offsets):
    """(position, first start, last start) of each run of SPAN-byte strings with one anchor, in order.

    Strings do not cross the texts' bounds.
    """
    hashes = _gram_hash(buffer, ANCHOR)
    n = len(buffer) - SPAN + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    # The smallest hash of each window, leftmost first: hash above, position below.
    low = (hashes & ~K.U((1 << 30) - 1)) | np.arange(len(hashes), dtype=K.U)
    width, least = 1, low
    while width < REACH + 1:
        step = min(width, REACH + 1 - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    position = (least[:n] & K.U((1 << 30) - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    lengths = np.diff(offsets)
    fits = lengths >= SPAN
    np.add.at(inside, offsets[:-1][fits], 1)
    np.add.at(inside, np.minimum(offsets[1:][fits] - SPAN + 1, n), -1)
    starts = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    position = position[starts]
    begins = np.flatnonzero(np.concatenate([[True], (position[1:] != position[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(starts) else np.empty(0, np.int64)
    ends = np.append(begins[1:], len(starts)) - 1 if len(begins) else begins
    return position[begins], starts[begins], starts[ends]


class Chunk:
    """The texts of a chunk and its anchors."""

    def __init__(self, row):
        self.ids = np.array([LAST if i is None or i != i else i for i in row["doc_ids"]], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(unfold(row["lengths"], np.int64))])
        self.buffer = unfold(row["text"], np.uint8)
        self.first = np.cumsum(unfold_numbers(row["firsts"]).astype(np.int64))
        self.position, self.last = unfold(row["runs"], np.uint8).reshape(2, -1) + self.first
        self.hash = K.byte_hash(self.buffer, self.position, self.position + ANCHOR)
        self.owner = np.searchsorted(self.offsets, self.first, "right") - 1
        self.keys, self.key_of = np.unique(self.hash, return_inverse=True)

    def strings(self, shared):
        """The distinct strings around shared anchors, by anchor hash: which occurrence stands for each, the
        smallest document, and which string each occurrence is."""
        at = np.flatnonzero(shared[self.key_of])
        spelling = K.byte_hash(self.buffer, self.first[at], self.last[at] + SPAN) ^ K.mix((self.position[at] - self.first[at]).astype(K.U))
        order = np.lexsort((spelling, self.hash[at]))
        key, spell = self.hash[at][order], spelling[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (spell[1:] != spell[:-1])]) if len(at) else np.empty(0, bool)
        of = np.empty(len(at), np.int64)
        of[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[self.owner[at]][order], np.flatnonzero(new)) if len(at) else np.empty(0, np.int64)
        return at, at[order[new]], least, of


def _chunks(batches, chunk_bytes):
    part, number, size, held = TaskContext.get().partitionId(), 0, 0, []

    def out():
        nonlocal number, size
        number += 1
        shift = np.cumsum([0] + [len(h[1]) for h in held])
        ids = [i for h in held for i in h[0]]
        text, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        position, first, last = np.concatenate([np.stack(h[3]) + s for h, s in zip(held, shift, strict=False)], axis=1)
        held.clear()
        size = 0
        # An anchor and its last string begin at most REACH bytes after its first.
        flat = [pa.array([x], pa.binary()) for x in (fold(text), fold(lengths), fold_numbers(np.diff(first, prepend=0)), fold(np.stack([position - first, last - first]).astype(np.uint8)))]
        return pa.RecordBatch.from_arrays([pa.array([part * (1 << 32) + number], pa.int64()), pa.array([ids], pa.list_(kind)), *flat], ["chunk", "doc_ids", "text", "lengths", "firsts", "runs"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for rows, data, offsets in K.blocks(batch, "text", BLOCK_BYTES):
            held.append((batch.column("doc_id").slice(rows.start, rows.stop - rows.start).to_pylist(), data, np.diff(offsets), anchors(data, offsets)))
            size += len(data)
            if size >= chunk_bytes:
                yield out()
    if held:
        yield out()


def _ask(batches, bits):
    """A chunk's anchor hashes and whether two of its documents have them, one row per bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            c = Chunk(row)
            order = np.argsort(c.hash, kind="stable")
            key, doc = c.hash[order], c.owner[order]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
            at = np.flatnonzero(new)
            # Positions ascend, so a key has several documents if its first and last differ.
            several = doc[at] != doc[np.append(at[1:], len(key)) - 1] if len(at) else new
            keys, edges = key[at], bucket_edges(key[at], bits)
            out = [(b, row["chunk"], pack_keys(keys[i:j]), fold(np.packbits(several[i:j]))) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "keys", "several"])


def _shared(frame):
    keys = [unpack_keys(k) for k in frame["keys"]]
    several = [np.unpackbits(unfold(s, np.uint8), count=len(k)) for s, k in zip(frame["several"], keys, strict=True)]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(several) + 1) >= 2
    answers = np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])
    return pd.DataFrame({"bucket": frame["bucket"], "chunk": frame["chunk"], "answer": [fold(np.packbits(a)) for a in answers], "n": [len(k) for k in keys]})


def _read_shared(answers):
    answers = answers.sort_values("bucket")
    parts = [np.unpackbits(unfold(a, np.uint8), count=int(n)).astype(bool) for a, n in zip(answers["answer"], answers["n"], strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def _gather(buffer, starts, lengths):
    ends = np.cumsum(lengths)
    return buffer[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _send(chunk, answers, bits):
    """A chunk's distinct strings around shared anchors: one shard per bucket."""
    c, number = Chunk(chunk.iloc[0]), chunk.iloc[0]["chunk"]
    _, at, least, _ = c.strings(_read_shared(answers))
    keys = c.hash[at]
    edges = bucket_edges(keys, bits)
    out = []
    for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if j > i:
            own = at[i:j]
            length = c.last[own] + SPAN - c.first[own]
            shape = np.stack([c.position[own] - c.first[own], length, c.last[own] - c.first[own]]).astype(np.uint8)
            out.append((b, number, pack_keys(keys[i:j]), fold(shape), fold(least[i:j]), fold(_gather(c.buffer, c.first[own], length))))
    return pd.DataFrame(out, columns=["bucket", "chunk", "keys", "shape", "docs", "bytes"])


def _side(data, begins, lengths, backwards):
    """The bytes on one side of the anchors as rows of REACH + 2 symbols: byte + 1, and 0 where there is none."""
    lengths = np.minimum(lengths, REACH + 2)
    width = np.arange(REACH + 2)
    place = begins[:, None] + (-width if backwards else width)[None, :]
    have = width[None, :] < lengths[:, None]
    # UTF-8 has no byte above 0xF4, so one more still fits.
    return np.where(have, data[np.where(have, place, 0)] + np.uint8(1), np.uint8(0))


def interleave(group, words, shard_order):
    """Merge shard orders: the joint order by group and words, and the symbols each entry has in common with
    the one before it (-1: another group)."""
    order, block = shard_order, np.zeros(len(shard_order), np.int64)
    common = np.full(len(order), 8 * words.shape[1], np.int64)
    common[:1] = -1
    for depth, symbol in enumerate([group, *words.T]):
        # Each shard is in order already, so a stable pass by block and symbol refines the interleave.
        values = symbol[order]
        move = np.lexsort((values, block))
        order, block, values = order[move], block[move], values[move]
        parts = (values[1:] != values[:-1]) & (block[1:] == block[:-1])
        at = np.flatnonzero(parts) + 1
        if depth == 0:
            common[at] = -1
        else:
            differ = values[at] ^ values[at - 1]
            common[at] = 8 * (depth - 1) + sum((differ >> K.U(8 * i) == 0).astype(np.int64) for i in range(7, 0, -1))
        block[1:] = np.cumsum((block[1:] != block[:-1]) | parts)
        if len(block) == 0 or block[-1] == len(block) - 1:
            break
    return order, common


def extend(symbol, group, common):
    """The order of the strings that start one byte earlier, and what neighbours then have in common."""
    move = np.argsort(group * 256 + symbol, kind="stable")
    key = (group * 256 + symbol)[move]
    out = np.where(np.concatenate([[False], group[move][1:] == group[move][:-1]]), 0, -1)
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    if len(same):
        pairs = np.stack([move[same - 1] + 1, move[same] + 1], axis=1).ravel()
        out[same] = np.minimum.reduceat(np.append(common, 0), pairs)[::2] + 1
    return move, out


def _merge(frame):
    """For each string of each shard, which of its SPAN-byte strings a smaller document has: bit o for the one
    that starts o bytes before the anchor."""
    keys = [unpack_keys(k) for k in frame["keys"]]
    count = [len(k) for k in keys]
    key, docs, data = np.concatenate(keys), np.concatenate([unfold(x, np.int64) for x in frame["docs"]]), np.concatenate([unfold(x, np.uint8) for x in frame["bytes"]])
    before, length, room = np.concatenate([unfold(x, np.uint8).reshape(3, -1) for x in frame["shape"]], axis=1).astype(np.int64)
    begin = np.cumsum(length) - length
    mask = np.zeros(len(key), np.uint32)
    # An anchor that one shard string alone has meets nothing.
    _, group, sizes = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(sizes[group] > 1)
    if len(some):
        key_group, before, length, room, begin, doc = group[some], before[some], length[some], room[some], begin[some], docs[some]
        right = _side(data, begin + before + ANCHOR, length - before - ANCHOR, False)
        left = _side(data, begin + before - 1, before, True)
        words = right.reshape(len(some), -1, 8).copy().view(">u8").astype(K.U).reshape(len(some), -1)
        # Each shard's own order, as its transform would give it.
        shard = np.repeat(np.arange(len(count)), count)[some]
        shard_order = np.lexsort((*words.T[::-1], key_group, shard))
        order, common = interleave(key_group, words, shard_order)
        common = np.where(common >= 0, common + ANCHOR, -1)
        hit = np.zeros(len(some), np.uint32)
        for o in range(REACH + 1):
            # Valid: the string starts inside this entry's run, which ends ``room`` bytes after it begins.
            o_min = before - room
            valid = ((o >= o_min) & (o <= before))[order]
            starts = np.flatnonzero(common < SPAN)
            least = np.minimum.reduceat(np.where(valid, doc[order], LAST), starts)
            smaller = np.repeat(least, np.diff(np.append(starts, len(order))))
            found = valid & (doc[order] > smaller)
            hit[order[found]] |= np.uint32(1 << o)
            if o < REACH:
                move, common = extend(left[order, o].astype(np.int64), key_group[order], common)
                order = order[move]
        mask[some] = hit
    answers = np.split(mask, np.cumsum(count)[:-1])
    return pd.DataFrame({"bucket": frame["bucket"], "chunk": frame["chunk"], "mask": [fold(a) for a in answers]})


def _finish(chunk, shared, masks, spans):
    """Removed and kept bytes of every document of a chunk."""
    c = Chunk(chunk.iloc[0])
    at, _, least, of = c.strings(_read_shared(shared))
    masks = masks.sort_values("bucket")
    mask = np.concatenate([unfold(m, np.uint32) for m in masks["mask"]]) if len(masks) else np.empty(0, np.uint32)
    # A document above the smallest of the chunk that has the very same string repeats all of it.
    whole = c.ids[c.owner[at]] > least[of]
    bits = np.where(whole, np.uint32((1 << (REACH + 1)) - 1), mask[of])
    edges = np.zeros(len(c.buffer) + 1, np.int32)
    for o in range(REACH + 1):
        start = c.position[at] - o
        start = start[(bits >> np.uint32(o) & 1 == 1) & (start >= c.first[at]) & (start <= c.last[at])]
        np.add.at(edges, start, 1)
        np.add.at(edges, start + SPAN, -1)
    gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
    rows = []
    for i, given in enumerate(chunk.iloc[0]["doc_ids"]):
        own = slice(c.offsets[i], c.offsets[i + 1])
        lost, data = gone[own], c.buffer[own]
        n = int(lost.sum())
        runs = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if n else 0
        kept = data[~lost].tobytes() if n else data.tobytes()
        row = {"doc_id": None if given is None or given != given else int(given), "n_bytes": len(data), "n_removed": n, "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        if spans:
            steps = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])))
            row |= {"kept": kept, "removed": [list(map(int, s)) for s in steps.reshape(-1, 2)]}
        rows.append(row)
    out = pd.DataFrame(rows)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def deduplicate(docs: DataFrame, spans: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; with ``spans`` also the kept
    bytes and the removed ranges [from, to)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(size // BUCKET_BYTES).bit_length()
    chunks = store_by(rows.mapInArrow(partial(_chunks, chunk_bytes=chunk_bytes), "chunk long, doc_ids array<long>, text binary, lengths binary, firsts binary, runs binary"), "chunk", 1 << bits)
    asked = chunks.mapInArrow(partial(_ask, bits=bits), "bucket int, chunk long, keys binary, several binary")
    shared = store(asked.groupBy("bucket").applyInPandas(lambda f: _shared(f), "bucket int, chunk long, answer binary, n int"))
    send = partial(_send, bits=bits)
    shards = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInPandas(lambda a, b: send(a, b), "bucket int, chunk long, keys binary, shape binary, docs binary, bytes binary")
    masks = shards.groupBy("bucket").applyInPandas(lambda f: _merge(f), "bucket int, chunk long, mask binary")
    # Both answers of a chunk in one table, so its texts move once more only.
    none = lambda kind: F.lit(None).cast(kind)
    answers = shared.select("bucket", "chunk", "answer", "n", none("binary").alias("mask")).unionByName(masks.select("bucket", "chunk", none("binary").alias("answer"), none("int").alias("n"), "mask"))
    finish = partial(_finish, spans=spans)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<array<long>>" * spans
    both = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInPandas(lambda a, b: finish(a, b[b["mask"].isna()], b[b["mask"].notna()]), schema)


def query(spark, sf_dir):
    return deduplicate(documents(spark, sf_dir), spans=False)
