"""The pipeline stage by stage against plain versions, on the smallest documents and on awkward rows."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from ledgerlens.llm import mixing, quality
from ledgerlens.llm.common import store
from tests.llm import reference as R

PRIVATE = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\b\d{1,3}(?:\.\d{1,3}){3}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\bAKIA[A-Z0-9]{16}\b")


def stages(spark, docs, folder):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], folder)))
    return out


def near(texts):
    sets = {d: R.shingles(t) for d, t in texts.items()}
    return [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


@pytest.mark.parametrize("source", ["table", "awkward"])
def test_stages(spark, small, mixed, source):
    docs = spark.read.parquet(f"{small}/documents.parquet") if source == "table" else mixed
    given, clean, single, private, mixture, packed = stages(spark, docs, small)
    assert all(df.columns == docs.columns for df in (clean, single, private, mixture))

    # Quality: what stays is what the judge keeps, shorter by the lines it names.
    judged = Counter((r.doc_id, r.n_words - r.removed_words) for r in quality.judge(given).where("kept").collect())
    assert Counter((r.doc_id, len(R.words(r.text))) for r in clean.collect()) == judged
    failed = {d for d, t in ((r.doc_id, r.text) for r in given.collect()) if R.quality(t)[0] < 20}
    assert not failed & {r.doc_id for r in clean.collect() if r.doc_id is not None}

    # Near-duplicates: the smallest id of every group, and no similar pair is left.
    texts = {r.doc_id: r.text for r in clean.where("doc_id is not null").collect()}
    label = R.components(texts, near(texts))
    kept = [r.doc_id for r in single.where("doc_id is not null").collect()]
    assert sorted(kept) == sorted(d for d in texts if label[d] == d)

    # Personal data: found values are gone, other texts are the same.
    before, after = ({r.doc_id: r.text for r in df.where("doc_id is not null").collect()} for df in (single, private))
    for d, text in before.items():
        found = PRIVATE.findall(text)
        assert not any(value in after[d] for value in found), d
        assert found or not re.search(r"password=|token =", text) and after[d] == text or re.search(r"password=|token =", text)

    # Mix: the words of each source are its target's.
    rows = mixing.amounts(private).collect()
    want, have = Counter(), Counter()
    for r in rows:
        want[r.source] = round(r.target)
    for r in mixture.collect():
        have[r.source] += len(R.words(r.text))
    assert all(abs(have[s] - want[s]) <= 1 for s in want)
    whole = {r.doc_id: r.text for r in private.collect()}
    assert all(whole[r.doc_id].startswith(r.text) for r in mixture.where("doc_id is not null").collect())

    # Packing: every token of every row of the mix, once.
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    ids = Counter()
    for r in mixture.collect():
        ids.update(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2])
    got, filled = Counter(), Counter()
    for r in packed.collect():
        got.update(r.ids)
        filled[r.sequence_id] += r.length
    assert got == ids and max(filled.values()) <= 4096


def test_run_is_the_last_stage(spark, small):
    assert corpus_pipeline.run(spark, small).select("length").groupBy().sum().first()[0] > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "source mix", "packing"]
