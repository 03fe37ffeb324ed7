"""The whole pipeline on a fixture and, stage by stage, on the smallest test table."""

from collections import Counter

import pytest
import tiktoken

import corpus_pipeline
from frondlake.llm import bpe, pii
from frondlake.llm.queries import PATTERN, RANKS

from .test_langid import WORDS
from .test_near_dedup import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    from frondlake.session import cut_lineage

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], FOLDER)))
    return out


def test_order_and_columns(outputs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "source_mix", "byte_bpe"]
    assert all(df.columns == outputs[0].columns for df in outputs[1:-1])


def test_each_stage_by_brute_force(outputs):
    rows = [df.collect() for df in outputs]
    start, tongue, single, clean, mixed, tokens = rows
    assert {r.doc_id for r in tongue} == {r.doc_id for r in start if any(c.isalpha() for c in r.text)}
    want = brute([(r.doc_id, r.text) for r in tongue])
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in want})
    text = {r.doc_id: r for r in clean}
    for r in single:
        redacted = pii.redacted(r.text, pii.find_spans(r.text))
        assert text[r.doc_id].text == redacted and text[r.doc_id].n_chars == len(redacted)
        assert not pii.plain_spans(redacted)
    times = Counter(r.doc_id for r in mixed)
    assert set(times) == set(text) and max(times.values()) <= 2
    theirs = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert Counter(r.doc_id for r in tokens) == times
    for r in tokens:
        assert r.ids == theirs.encode_ordinary(text[r.doc_id].text) and r.n_tokens == len(r.ids)


def test_run_equals_the_stages(spark, outputs):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, got.collect())) == sorted(map(str, outputs[-1].collect()))


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows(spark, empty):
    text = " ".join(WORDS["en"] * 3)
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
            (4, text.upper(), None, "b", 5), (5, " ".join(WORDS["de"]) + " a@b.co", None, None, 9), (None, " ".join(WORDS["de"] * 2), "de", "b", 9)]
    docs = spark.createDataFrame(rows[:0] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    ids = Counter(r.doc_id for r in docs.collect())
    assert set(ids) == (set() if empty else {1, 5, None})
