"""Quality rules from the frequency of lines across the documents of a host.

Every line is normalised (A-Z lower-cased, words joined by one space) and hashed. A line is common on a host
when the contents that hold it are more than ``min_documents`` and more than ``share`` of the host's
contents. Common lines are removed; a document left with less than ``min_kept`` of its words is depleted and
rejected, as is one that fails the base rules.

Copies must not make their own text common, so documents count by content, for the line and for the host alike:
the smallest hashes of a document's ``SHINGLE``-word windows under ``HASHES`` hash functions stand for it together.
Exact copies share all of them, and near copies of similarity s do with a chance of about s^HASHES. Unlike
texts share one only through a passage that both have, and all of them hardly ever, unless that passage is
most of both. A line of a thousand copies of one text therefore counts as one or a few, while a line in a
thousand different texts counts as many.

Defined cases: a null or empty text has no words and fails the base rules; a null host is a host of its own;
repeated rows are documents of their own, with equal results; lines without a word are ignored; an empty table
gives an empty result; further columns pass through ``clean`` and are ignored by ``judge``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import textkernel as K
from ledgerlens.llm.common import boxed, documents, ship, store, unboxed

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Symbols of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: What stands for a content.
SHINGLE, HASHES = 5, 4
_TURN, _FACTOR, _FOLD = K.constants(HASHES, 51), K.constants(HASHES, 52) | K.U(1), K.constants(HASHES, 53) | K.U(1)
#: What identifies a document and its outcome.
KEYS = ["doc_id", "source", "text_key"]


def _repeated(hashes):
    """How many words lie in windows found at least twice in the text."""
    values = K.windows(hashes, WINDOW)
    if len(values) < 2:
        return 0
    order = np.argsort(values)
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def _content(hashes):
    """The hash that stands for a text: its least windows under each of the hash functions; 0 without words."""
    if not len(hashes):
        return K.U(0)
    values = K.windows(hashes, min(SHINGLE, len(hashes)))
    least = np.array([((values ^ turn) * factor).min() for turn, factor in zip(_TURN, _FACTOR, strict=True)], K.U)
    return K.mix((least * _FOLD).sum(dtype=K.U))


def _line_table(texts):
    """All lines of a block: raw hash, hash of the normalised words, words, first line of each text."""
    starts, ends, first = texts.lines()
    words_from, words_to = np.searchsorted(texts.starts, starts), np.searchsorted(texts.starts, ends)
    lowered = K.byte_hash(K.LOWER[texts.buffer], texts.starts, texts.ends)
    normal = K.span_hash(lowered, words_from, words_to)
    return K.byte_hash(texts.buffer, starts, ends), normal, words_to - words_from, first, lowered


def _measure(batches):
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    for batch in batches:
        for rows, data, offsets in K.blocks(batch, "text"):
            texts = K.Texts(data, offsets)
            raw, normal, words, first, lowered = _line_table(texts)
            hashes = texts.word_hashes()
            dup, repeat, sketch, line_hash, line_words, lengths = [], [], [], [], [], []
            for i in range(len(texts)):
                own = slice(first[i], first[i + 1])
                worded = words[own] > 0
                dup.append(int(worded.sum()) - len(np.unique(raw[own][worded])))
                mine = slice(texts.first[i], texts.first[i + 1])
                repeat.append(_repeated(hashes[mine]))
                sketch.append(_content(lowered[mine]))
                distinct, inverse = np.unique(normal[own][worded], return_inverse=True)
                line_hash.append(distinct)
                line_words.append(np.bincount(inverse, words[own][worded], len(distinct)).astype(np.int32))
                lengths.append(len(distinct))
            base = [texts.first[1:] - texts.first[:-1], texts.total(((texts.buffer & 0xC0) != 0x80) & ~texts.space), texts.total(symbol[texts.buffer]), dup, repeat]
            kept = batch.slice(rows.start, rows.stop - rows.start)
            out = [*(kept.column(k) for k in KEYS), *(pa.array(x, pa.int64()) for x in base)]
            out += [pa.array(K.signed(sketch), pa.int64()), K.list_array(K.signed(np.concatenate(line_hash)), lengths, pa.int64()), K.list_array(np.concatenate(line_words), lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [*KEYS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "sketch", "lines", "line_words"])


def measure(docs: DataFrame) -> DataFrame:
    """Base figures, content sketch and distinct normalised lines (hash, words) of every document."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _measure, f"doc_id {kind}, source string, text_key long, {BASE}, sketch long, lines array<long>, line_words array<int>"
    )


def common_lines(measured: DataFrame, share: float, min_documents: int) -> DataFrame:
    """(source, line, n_documents) of the lines above the limit of their host, all counted in contents.

    Counting combines before the shuffle: first one row for each host, line and content, then one for each
    host and line, so a line of a third of all documents costs a row per task and content.
    """
    contents = measured.select("source", "sketch", F.explode("lines").alias("line")).distinct()
    counts = contents.groupBy("source", "line").agg(F.count("*").alias("n_documents")).where(F.col("n_documents") > min_documents)
    hosts = measured.select("source", "sketch").distinct().groupBy("source").agg(F.count("*").alias("host_documents")).withColumnRenamed("source", "host")
    return counts.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("n_documents") > share * F.col("host_documents")).select("source", "line", "n_documents")




def common_hits(measured: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, removed_words, removed_lines) of the documents that hold common lines.

    Equal repeated rows give equal hits, so the distinct ones are gathered once per key.
    """
    lines = measured.select(*KEYS, F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select(*KEYS, F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    common = common.select(F.col("source").alias("host"), F.col("line").alias("common"))
    hits = lines.join(common, (F.col("line") == F.col("common")) & F.col("source").eqNullSafe(F.col("host")))
    # A text's own common lines: bounded by the text.
    return hits.groupBy(*KEYS).agg(F.collect_set(F.struct("line", "words")).alias("x")).select(
        *KEYS, F.aggregate("x", F.lit(0).cast("long"), lambda n, e: n + e["words"]).alias("removed_words"), F.col("x.line").alias("removed_lines")
    )


def on_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({k: f"r_{k}" for k in KEYS})
    return left.join(right, [left[k].eqNullSafe(F.col(f"r_{k}")) for k in KEYS], "left").drop(*(f"r_{k}" for k in KEYS))


def judge(docs: DataFrame, share: float = 0.02, min_documents: int = 20, min_words: int = 20, min_kept: float = 0.3) -> DataFrame:
    """One row per document: the base figures, removed_words, removed_lines, base_failed and kept."""
    measured = store(measure(docs))
    hits = common_hits(measured, store(common_lines(measured, share, min_documents)))
    out = on_keys(measured.drop("lines", "line_words", "sketch"), hits)
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rest = F.col("n_words") - F.col("removed_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (rest >= min_kept * F.col("n_words")))


def _rewrite(batches):
    """Texts without the lines named beside them; other texts stay as they are."""
    for batch in batches:
        at, lost = batch.schema.get_field_index("text"), batch.column(batch.num_columns - 1).to_pylist()
        texts = batch.column(at).to_pylist()
        for i, lines in enumerate(lost):
            if lines:
                data = texts[i].encode()
                block = K.Texts(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                starts, ends, _ = block.lines()
                _, normal, words, _, _ = _line_table(block)
                stay = ~np.isin(K.signed(normal), np.array(lines, np.int64)) | (words == 0)
                texts[i] = b"\n".join(data[a:b] for a, b in zip(starts[stay], ends[stay], strict=True)).decode()
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents with their common lines removed; all columns stay, n_chars follows the text."""
    judged = judge(docs, **limits)
    # Rejected and changed documents only; an untouched one needs no entry.
    touched = store(judged.where(~F.col("kept") | (F.col("removed_words") > 0)).select(*KEYS, "kept", "removed_lines").distinct())
    keyed = boxed(docs, "doc_id", "source", F.xxhash64("text").alias("text_key"))
    rest = on_keys(keyed, touched).where(F.coalesce("kept", F.lit(True)))
    out = unboxed(rest, docs.columns, F.col("removed_lines").alias("_removed_lines")).mapInArrow(_rewrite, docs.schema)
    return unboxed(boxed(out, "text"), docs.columns, text=F.col("text"))


def query(spark, sf_dir):
    return judge(documents(spark, sf_dir)).select("doc_id", *BASE.replace(" long", "").split(", "), "removed_words", "base_failed", "kept")
