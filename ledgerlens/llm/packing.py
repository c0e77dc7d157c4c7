"""Order-preserving packing of documents into sequences of at most ``capacity`` tokens.

Documents are dealt by ranges of doc_id and kept in that order; their tokens, each document closed by an end
id, form one stream per range. Cuts may fall at document ends (free), at sentence ends (``SENTENCE`` tokens of
penalty) or, inside a run of more than ``RUN`` tokens without either, at every RUN tokens (``INSIDE``). With
f(i) = cost(i) + position(i), the best cost of a cut j is

    cost(j) = capacity - position(j) + penalty(j) + min f(i) over the cuts i at most capacity before j,

padding plus truncation penalties; a monotone queue holds the minimum of the sliding window, so each cut
enters and leaves once. The stream is worked through in buffers of about ``BUFFER`` tokens: cuts are settled
up to the best one near the buffer's end, the rest starts the next buffer, so nothing is padded between
buffers. What is left at the end of a range is cut into powers of two, which need no padding.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; a null doc_id sorts
first and is carried as null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import documents, ship

CAPACITY, END_ID, SENTENCE, INSIDE, RUN, BUFFER = 4096, 2, 24, 96, 64, 1_000_000
#: Sentence cuts closer than this many tokens to the one before are left out.
APART = 24
#: A worker forgets its word table beyond this many words.
WORDS = 3_000_000


class WordTable:
    """Token ids of words, kept in the worker: a word between white space is tokenised once.

    The tokenizer drops white space and never joins across it, so the ids of a text are those of its words in
    order. Words are found again by 64-bit hash.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.clear()

    def clear(self):
        self.keys, self.start, self.length = np.empty(0, K.U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.letters = np.empty(0, np.uint8)
        self.from_, self.to = np.empty(0, np.int64), np.empty(0, np.int64)

    def _tokens(self, texts, rows):
        """Where the ids of some words of the block are, appended to the table, and how many."""
        data = texts.buffer
        words = [data[a:b].tobytes().decode() for a, b in zip(texts.starts[rows].tolist(), texts.ends[rows].tolist(), strict=True)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.array([len(x) for x in found], np.int64)
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], np.uint32)])
        return start, length

    def lookup(self, texts):
        """Ids and their number for every word of a block; a word found by its hash is compared letter by letter."""
        keys, first, inverse = np.unique(texts.word_hashes(), return_index=True, return_inverse=True)
        if len(self.keys) > WORDS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            rows = first[new]
            start, length = self._tokens(texts, rows)
            size = texts.ends[rows] - texts.starts[rows]
            to = len(self.letters) + np.cumsum(size)
            self.letters = np.concatenate([self.letters, texts.buffer[K.ranges(texts.starts[rows], size)]])
            added = (keys[new], start, length, to - size, to)
            self.keys, self.start, self.length, self.from_, self.to = (np.insert(old, at[new], add) for old, add in zip((self.keys, self.start, self.length, self.from_, self.to), added, strict=True))
            at = np.searchsorted(self.keys, keys)
        of = at[inverse]
        start, length = self.start[of], self.length[of]
        other = np.flatnonzero(~K.same_spans(texts.buffer, texts.starts, texts.ends, self.letters, self.from_[of], self.to[of]))
        if len(other):
            start[other], length[other] = self._tokens(texts, other)
        return start, length


_TABLES: dict = {}


def tokenised(texts, table):
    """Ids, tokens of each text, cut positions and their penalties for a block."""
    start, length = table.lookup(texts)
    # A document's end id follows its last word.
    n = len(texts)
    per_word = np.concatenate([[0], np.cumsum(length)])
    words_end = texts.first[1:]
    total = per_word[words_end] - per_word[texts.first[:-1]] + 1
    ends = np.cumsum(total)
    ids = np.empty(int(ends[-1]) if n else 0, np.uint32)
    last = np.zeros(len(ids), bool)
    last[ends - 1] = True
    ids[last] = END_ID
    ids[~last] = table.ids[K.ranges(start, length)]
    # Sentence ends: a word that ends with a mark, or the last word of a line.
    closing = np.isin(texts.buffer[texts.ends - 1], list(b".!?"))
    breaks = np.flatnonzero(texts.buffer == 10)
    if len(breaks) and len(texts.starts):
        before = np.searchsorted(texts.ends, breaks, "right") - 1
        closing[before[before >= 0]] = True
    document = np.repeat(np.arange(n), texts.first[1:] - texts.first[:-1])
    position = per_word[1:] + document
    sentence = position[closing]
    # The last sentence ends with its document, which is the better cut.
    sentence = sentence[~last[np.minimum(sentence, len(ids) - 1)]]
    cuts = np.unique(np.concatenate([sentence, ends]))
    free = np.isin(cuts, ends)
    # Thin sentence cuts by the token raster, keep document ends.
    keep = free | np.concatenate([[True], cuts[1:] // APART != cuts[:-1] // APART])
    cuts, free = cuts[keep], free[keep]
    gaps = np.diff(cuts, prepend=0)
    more = np.maximum((gaps - 1) // RUN, 0)
    inner = K.ranges(np.ones(len(gaps), np.int64), more) * RUN + np.repeat(cuts - gaps, more)
    position = np.concatenate([cuts, inner])
    penalty = np.concatenate([np.where(free, 0, SENTENCE), np.full(len(inner), INSIDE)])
    order = np.argsort(position, kind="stable")
    return ids, total, position[order], penalty[order]


def best_cuts(position, penalty, capacity, whole):
    """The cuts of least padding plus penalty, from 0; positions ascend. The last position is a cut if
    ``whole``, else the last cut is the best one within a capacity of the end."""
    points, fines = [0, *position.tolist()], [0, *penalty.tolist()]
    cost, back = [0] * len(points), [0] * len(points)
    queue, value = deque([0]), deque([0])
    for j in range(1, len(points)):
        p = points[j]
        while points[queue[0]] < p - capacity:
            queue.popleft()
            value.popleft()
        c = capacity - p + fines[j] + value[0]
        cost[j], back[j] = c, queue[0]
        f = c + p
        while value and value[-1] >= f:
            value.pop()
            queue.pop()
        queue.append(j)
        value.append(f)
    j = len(points) - 1
    if not whole:
        near = range(int(np.searchsorted(position, points[-1] - capacity)) + 1, len(points))
        j = min(near, key=lambda i: (cost[i] + points[i], -i))
    cuts = []
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


class Stream:
    """The tokens of a range that have no sequence yet, and the documents they belong to."""

    def __init__(self, capacity, with_ids):
        self.capacity, self.with_ids = capacity, with_ids
        self.parts, self.cuts, self.fines, self.size = [], [], [], 0
        self.docs, self.ends, self.totals = [], [], []
        self.sequence = TaskContext.get().partitionId() << 40

    def add(self, docs, ids, totals, cuts, fines):
        self.parts.append(ids)
        self.cuts.append(cuts + self.size)
        self.fines.append(fines)
        self.docs.extend(docs)
        self.ends.extend((np.cumsum(totals) + self.size).tolist())
        self.totals.extend(totals.tolist())
        self.size += len(ids)

    def flush(self, final):
        """Rows of the settled sequences; what is left stays."""
        if not self.size:
            return None
        ids, cuts, fines = (np.concatenate(x) for x in (self.parts, self.cuts, self.fines))
        chosen = best_cuts(cuts, fines, self.capacity, False)
        if final:
            rest = self.size - chosen[-1]
            chosen += (chosen[-1] + np.cumsum([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1])).tolist() if rest else []
        rows, at, d = [], 0, 0
        for end in chosen:
            start = at
            while at < end:
                stop = min(end, self.ends[d])
                first = self.ends[d] - self.totals[d]
                piece = ids[at:stop]
                rows.append((self.docs[d], at - first, stop - at, zlib.crc32(piece.astype("<u4").tobytes()), self.totals[d], self.sequence, at - start, piece if self.with_ids else None))
                at = stop
                if stop == self.ends[d]:
                    d += 1
            self.sequence += 1
        keep = cuts > at
        self.parts, self.cuts, self.fines, self.size = [ids[at:]], [cuts[keep] - at], [fines[keep]], len(ids) - at
        self.docs, self.ends, self.totals = self.docs[d:], [e - at for e in self.ends[d:]], self.totals[d:]
        return rows


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(batches, path, capacity, with_ids):
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    table = _TABLES[path]
    stream, kind = Stream(capacity, with_ids), None

    def out(rows):
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        names = ["doc_id", *COLUMNS.replace(" long", "").split(", ")]
        if with_ids:
            arrays.append(K.list_array(np.concatenate(columns[7]).astype(np.int32), [len(x) for x in columns[7]], pa.int32()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for rows, data, offsets in K.blocks(batch, "text"):
            docs = batch.column("doc_id").slice(rows.start, rows.stop - rows.start).to_pylist()
            stream.add(docs, *tokenised(K.Texts(data, offsets), table))
            if stream.size >= BUFFER and (made := stream.flush(False)):
                yield out(made)
    if made := stream.flush(True):
        yield out(made)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence: where it starts in its document and in the sequence,
    its length, the CRC-32 of its ids and, ``with_ids``, the ids. Sequences keep the order of doc_id."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The text's hash spreads rows that repeat one doc_id; equal rows are interchangeable.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return rows.mapInArrow(partial(_pack, path=tokenizer_path, capacity=capacity, with_ids=with_ids), f"doc_id {kind}, {COLUMNS}" + ", ids array<int>" * with_ids)


def query(spark, sf_dir):
    return pack(documents(spark, sf_dir), with_ids=False)
