"""Katz backoff language model with Good-Turing discounts, counted and evaluated by packed exchanges.

P(w | h) is d(c) * c / N(h) for a pair seen c times in training and alpha(h) * P(w) for an unseen one, with
alpha(h) = (1 - sum of the seen P(w | h)) / (1 - sum of their P(w)), so each context sums to 1 over the
training vocabulary and one unknown token. P(w) is d(c) * c / N; what its discounts leave is the unknown
token's. d(c) is the Good-Turing ratio with cut-off ``CUT`` (where the counts of counts give none between 0
and 1: half a count is given up); counts above the cut-off give up ``RESERVE`` of a count, so that no context
is left without mass for unseen words. The first token of a text has a start context; a context never seen
in training takes P(w).

Texts are cut into chunks of about ``CHUNK`` tokens. A chunk knows its distinct words and pairs; it asks for
their corpus counts with one packed row per bucket of hashes (sorted keys, so differences of a few bytes), a
bucket adds the rows of all chunks, keeps the sums as the stored table of that bucket and answers in the order
asked. A word or pair of a third of all documents is one entry per chunk. One chunk is named owner of each
pair, which lets chunks sum the seen mass of their contexts, and a second exchange, by context, turns these
sums into alpha and into the documents' missing terms. Buckets grow with the text, chunks do not, so every
task is bounded.

Defined cases: null and empty texts are their end token alone; a null doc_id trains; repeated rows count and
are scored each; without training rows only the unknown token has mass; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

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

CHUNK, BUCKET_BYTES, CUT, RESERVE = 1_000_000, 8_000_000, 5, 0.001
END, START = K.constants(2, 31)
HELD_OUT = 2


def pair_key(h, w):
    return K.mix(h * K.U(0x9E3779B97F4A7C15) + K.mix(w))


def _chunks(batches, chunk_tokens):
    """One row per chunk: its dictionary (sorted word hashes), tokens as places in it, and its documents."""
    part, number = TaskContext.get().partitionId(), 0
    held: list = []

    def out():
        nonlocal number
        words, ids, flags, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, places, counts = np.unique(words, return_inverse=True, return_counts=True)
        # Tokens are written as ranks by frequency, which are small numbers.
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number += 1
        flat = [pa.array([x], pa.binary()) for x in (pack_keys(keys), fold_numbers(order), fold_numbers(rank[places]), fold(flags), fold(lengths))]
        chunk = pa.array([part * (1 << 32) + number], pa.int64())
        held.clear()
        return pa.RecordBatch.from_arrays([chunk, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, kind)), *flat], ["chunk", "doc_ids", "dictionary", "ranks", "tokens", "training", "lengths"])

    size = 0
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for rows, data, offsets in K.blocks(batch, "text"):
            texts = K.Texts(data, offsets, lower=True)
            count = texts.first[1:] - texts.first[:-1]
            words = np.insert(texts.word_hashes(), texts.first[1:], END)
            span = slice(rows.start, rows.stop)
            held.append((words, np.array(batch.column("doc_id").slice(rows.start, len(texts)).to_pylist(), dtype=object), np.array(batch.column("training").to_pylist()[span], bool), count + 1))
            size += len(words)
            if size >= chunk_tokens:
                yield out()
                size = 0
    if held:
        yield out()


class Chunk:
    """The words, pairs and documents of one chunk; pairs are sorted by key and pair_of names each token's."""

    def __init__(self, row):
        self.words = unpack_keys(row["dictionary"])
        tokens = unfold_numbers(row["ranks"]).astype(np.int64)[unfold_numbers(row["tokens"])]
        self.training, self.lengths = unfold(row["training"], bool), unfold(row["lengths"], np.int64)
        self.word_of = tokens
        first = np.cumsum(self.lengths) - self.lengths
        history = np.empty(len(tokens), np.int64)
        history[1:] = tokens[:-1]
        history[first] = len(self.words)  # the start context
        self.document = np.repeat(np.arange(len(self.lengths)), self.lengths)
        both, pair_of = np.unique(history * (len(self.words) + 1) + tokens, return_inverse=True)
        self.contexts = np.append(self.words, START)
        h, w = both // (len(self.words) + 1), both % (len(self.words) + 1)
        keys = pair_key(self.contexts[h], self.words[w])
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.h, self.w, self.pair_of = keys[order], h[order], w[order], place[pair_of]
        self.token_trains = self.training[self.document]


def _ask(batches, bits):
    """A chunk's words and pairs with their training counts (times two, plus one if a held-out document has
    them), one row per kind and bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            c = Chunk(row)
            trains = c.token_trains.astype(np.int64)
            out = []
            for kind, keys, of in ((1, c.words, c.word_of), (2, c.pairs, c.pair_of)):
                n = 2 * np.bincount(of, trains, len(keys)) + (np.bincount(of, 1 - trains, len(keys)) > 0)
                edges = bucket_edges(keys, bits)
                out += [(kind, b, row["chunk"], pack_keys(keys[i:j]), fold_numbers(n[i:j])) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "bucket", "chunk", "keys", "n"])


def _add(frame):
    """The sums of one bucket: its table, its counts of counts, and the answer to every chunk."""
    parts = [(unpack_keys(k), unfold_numbers(n)) for k, n in zip(frame["keys"], frame["n"], strict=True)]
    every, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    keys, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    total = np.bincount(inverse, n >> 1, len(keys)).astype(np.int64)
    held = np.bincount(inverse, n & 1, len(keys)) > 0
    owner = np.zeros(len(every), np.int64)
    owner[first] = 1
    answer = np.split((total * 2 + held)[inverse] * 2 + owner, np.cumsum([len(k) for k, _ in parts])[:-1])
    seen = total[total > 0]
    high = seen > CUT
    figures = [*(int((seen == r).sum()) for r in range(1, CUT + 2)), int(high.sum()), int(seen[high].sum()), len(seen), int(seen.sum())]
    out = pd.DataFrame({"kind": frame["kind"], "bucket": frame["bucket"], "chunk": frame["chunk"], "answer": [fold(a.astype(np.uint64)) for a in answer]})
    out["figures"] = [figures] + [None] * (len(parts) - 1)
    return out


class Discounts:
    """d(c) * c for the counts of one order."""

    def __init__(self, figures):
        n, (self.high_types, self.high_count, self.types, self.tokens) = figures[: CUT + 1], figures[CUT + 1 :]
        share = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
        kept = [0.0]
        for r in range(1, CUT + 1):
            ratio = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
            d = (ratio - share) / (1 - share) if share < 1 else 0.0
            kept.append(r * d if 0 < d < 1 else r - 0.5)
        self.kept = np.array(kept)
        self.mass = float(sum(k * m for k, m in zip(kept[1:], n, strict=False)) + self.high_count - RESERVE * self.high_types)

    def __call__(self, count):
        return np.where(count > CUT, count - RESERVE, self.kept[np.minimum(count, CUT)])


def _evaluate(chunk, answers, bits, words, pairs):
    """Everything about a chunk's documents but the alphas, and what the contexts' alphas need."""
    row = chunk.iloc[0]
    c = Chunk(row)
    answers = answers.sort_values(["kind", "bucket"])
    first, second = (np.concatenate([unfold(a, np.uint64) for a in answers["answer"][answers["kind"] == k]]).astype(np.int64) for k in (1, 2))
    count, asked = first >> 2, first >> 1 & 1 == 1
    pair, owned = second >> 2, second & 1 == 1
    chance = np.where(count > 0, words(count) / max(words.tokens, 1), 1 - words.mass / max(words.tokens, 1))
    # A word is followed as often as it occurs; a text begins as often as there are training texts.
    following = np.append(count, words.ends)
    context_count = following[c.h]
    seen = pair > 0
    with np.errstate(divide="ignore"):
        term = np.where(seen, np.log10(pairs(pair) / np.maximum(context_count, 1)), np.log10(chance[c.w]))
    per = lambda values: np.bincount(c.document, values, len(c.lengths))
    known = count[c.word_of]
    base = np.log10((known + 1) / (words.tokens + words.types + 1))
    docs = [{"kind": 0, "bucket": int(row["chunk"] % 997), "chunk": row["chunk"], "doc_ids": row["doc_ids"], "a": fold(c.training), "b": fold(np.stack([c.lengths.astype(float), per(known > 0), per(base), per(term[c.pair_of])])), "c": None}]
    # Contexts: the seen mass and its lower-order mass from owned pairs, and the unseen pairs that need alpha.
    # Only held-out documents have unseen pairs, so only the contexts that one of them has need sums.
    mine = seen & owned
    size = len(c.contexts)
    mass = np.bincount(c.h[mine], pairs(pair[mine]) / context_count[mine], size)
    lower = np.bincount(c.h[mine], chance[c.w[mine]], size)
    lacking = ~seen[c.pair_of] & (context_count[c.pair_of] > 0)
    h, doc = c.h[c.pair_of[lacking]], c.document[lacking]
    used = np.zeros(size, bool)
    used[c.h[mine]] = True
    used &= np.append(asked, True)
    used[h] = True
    order = np.argsort(c.contexts)
    order = order[used[order]]
    place = np.zeros(size, np.int64)
    place[order] = np.arange(len(order))
    keys, at = c.contexts[order], place[h]
    by = np.argsort(at, kind="stable")
    at, doc = at[by], doc[by]
    edges = bucket_edges(keys, bits)
    cuts = np.searchsorted(at, edges)
    out = [
        {"kind": 1, "bucket": b, "chunk": row["chunk"], "doc_ids": None, "a": pack_keys(keys[i:j]), "b": np.stack([mass[order[i:j]], lower[order[i:j]]]).tobytes(), "c": fold(np.stack([at[s:e] - i, doc[s:e]]).astype(np.int32))}
        for b, (i, j, s, e) in enumerate(zip(edges[:-1], edges[1:], cuts[:-1], cuts[1:], strict=True))
        if j > i
    ]
    return pd.DataFrame(docs + out)


def _alphas(frame):
    """The alphas of one bucket of contexts, added up for the documents that miss them; documents pass."""
    if frame["kind"].iloc[0] == 0:
        return frame[["kind", "chunk", "doc_ids", "a", "b"]]
    keys = [unpack_keys(a) for a in frame["a"]]
    sums = np.concatenate([np.frombuffer(b).reshape(2, -1) for b in frame["b"]], axis=1)
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    mass, lower = (np.bincount(inverse, s) for s in sums)
    alpha = np.log10(np.maximum(1 - mass, 1e-300) / np.maximum(1 - lower, 1e-300))[inverse]
    out, at = [], 0
    for chunk, k, c in zip(frame["chunk"], keys, frame["c"], strict=True):
        place, doc = unfold(c, np.int32).reshape(2, -1)
        if len(doc):
            which, where = np.unique(doc, return_inverse=True)
            out.append({"kind": 1, "chunk": chunk, "doc_ids": None, "a": fold(which), "b": fold(np.bincount(where, alpha[at + place]))})
        at += len(k)
    return pd.DataFrame(out, columns=["kind", "chunk", "doc_ids", "a", "b"])


def _documents(frame, known):
    alphas, row = frame[frame["kind"] == 1], frame[frame["kind"] == 0].iloc[0]
    length, n_known, base, term = unfold(row["b"], float).reshape(4, -1).copy()
    for docs, sums in zip(alphas["a"], alphas["b"], strict=True):
        term[unfold(docs, np.int32)] += unfold(sums, float)
    return pd.DataFrame({"doc_id": list(row["doc_ids"]), "held_out": ~unfold(row["a"], bool), "n_tokens": length.astype(np.int64), "n_known": n_known.astype(np.int64), "train_tokens": known, "base_score": base, "score": term})


def score(docs: DataFrame, chunk_tokens: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != HELD_OUT, F.lit(True))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), training.alias("training"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count_if("training")).first()
    bits = max(0, ((size[0] or 0) // BUCKET_BYTES).bit_length())
    chunks = rows.mapInArrow(partial(_chunks, chunk_tokens=chunk_tokens), f"chunk long, doc_ids array<{kind}>, dictionary binary, ranks binary, tokens binary, training binary, lengths binary")
    chunks = store_by(chunks, "chunk", 1 << bits)
    asked = chunks.drop("doc_ids").mapInArrow(partial(_ask, bits=bits), "kind int, bucket int, chunk long, keys binary, n binary")
    tables = store(asked.groupBy("kind", "bucket").applyInPandas(lambda f: _add(f), "kind int, bucket int, chunk long, answer binary, figures array<long>"))
    # Ten numbers per order.
    sums = {r["kind"]: [r[f"s{i}"] for i in range(CUT + 5)] for r in tables.where("figures is not null").groupBy("kind").agg(*(F.sum(F.col("figures")[i]).alias(f"s{i}") for i in range(CUT + 5))).collect()}
    words, pairs = (Discounts(sums.get(k, [0] * (CUT + 5))) for k in (1, 2))
    words.ends = size[1] or 0
    evaluate, finish = partial(_evaluate, bits=bits, words=words, pairs=pairs), partial(_documents, known=words.tokens)
    answers = tables.select("kind", "bucket", "chunk", "answer")
    parts = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda a, b: evaluate(a, b), f"kind int, bucket int, chunk long, doc_ids array<{kind}>, a binary, b binary, c binary")
    # A chunk's documents travel with the contexts and come back with their alphas.
    summed = parts.groupBy("kind", "bucket").applyInPandas(lambda f: _alphas(f), f"kind int, chunk long, doc_ids array<{kind}>, a binary, b binary")
    columns = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return summed.groupBy("chunk").applyInPandas(lambda f: finish(f), columns)


def query(spark, sf_dir):
    return score(documents(spark, sf_dir))
