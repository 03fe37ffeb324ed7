import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from frondlake.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


TEXTS = ["", " ", "\n\n  \n", "Hello world's  end", "a" * 3000, "ab" * 900, "ß ü 漢字 🙂🙂" * 50, "=" * 700,
         "x\x85y\xa0z\x1c\x1d  ᠎​", "<|endoftext|>", "é́ ñandú 12½ Ⅷ ٣", "﻿" * 9 + "q"]


def test_equals_library(own, theirs):
    for text in TEXTS:
        ids = own.encode(text)
        assert ids == theirs.encode_ordinary(text), repr(text[:40])
        assert own.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="thena sti'\n=-01", max_size=200)))
def test_equals_library_on_any_text(text):
    own = bpe.codec(PATH, P.PATTERN)
    theirs = test_equals_library_on_any_text.__dict__.setdefault("enc", tiktoken.Encoding(
        "own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}))
    assert own.encode(text) == theirs.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text


def test_every_token_alone(own, theirs):
    for token in own.transducer.ranks:
        assert own.transducer.encode(token) == [own.transducer.ranks[token]]


def test_random_bytes_of_tokens(own, theirs):
    pick = random.Random(5)
    tokens = list(own.transducer.ranks)
    for _ in range(3000):
        data = b"".join(pick.choices(tokens, k=pick.randint(1, 6)))
        assert own.transducer.encode(data) == theirs._core_bpe.encode_single_piece(data)


def test_character_classes_agree(own, theirs):
    """Letters, numbers and white space of the split are those of the library, for every character."""
    wrong = []
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        text = f"a{chr(point)}1{chr(point)} {chr(point)}\n{chr(point)}!"
        if point % 7 == 0 or point < 0x3000:  # all low ones, every seventh of the rest
            if own.encode(text) != theirs.encode_ordinary(text):
                wrong.append(hex(point))
    assert not wrong, (len(wrong), wrong[:20])


def test_full_caches_change_nothing(theirs):
    small = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    small.transducer.max_states = 20
    for text in TEXTS:
        assert small.encode(text) == theirs.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=40))
def test_utf8_stream_in_chunks(data, cuts):
    stream, out, at = bpe.Utf8Stream(), "", 0
    for cut in cuts:
        out += stream.feed(data[at:at + cut])
        at += cut
    out += stream.feed(data[at:]) + stream.finish()
    assert out == data.decode("utf-8", "replace")


def test_frames(spark, theirs):
    rows = [(1, None, "k"), (2, "", "k"), (3, "the end", None), (3, "the end", None), (4, "ü" * 5000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(docs, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids"]
    got = sorted((r.doc_id, r.ids) for r in out.collect())
    assert got == sorted((i, theirs.encode_ordinary(t or "")) for i, t, _ in rows)
    back = bpe.decode(out, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((i, t or "") for i, t, _ in rows)
    assert bpe.encode(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, theirs):
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op3_byte_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = theirs.encode_ordinary(doc.text or "")
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_pairs_follow_as_merges_say():
    """Pairs of tokens, of which many are cut from a third one, against merging their bytes."""
    own, rng = bpe.Transducer(bpe.read_ranks(PATH)), random.Random(3)
    tokens = list(own.token_bytes)
    seen = set()
    for _ in range(20_000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        whole = own.token_bytes[rng.choice(tokens)]
        if rng.random() < 0.5 and len(whole) > 1:
            cut = rng.randint(1, len(whole) - 1)
            a, b = own.ranks.get(whole[:cut], a), own.ranks.get(whole[cut:], b)
        parts = [own.token_bytes[a], own.token_bytes[b]]
        assert own._may_follow(a, b) == (own._merge(b"".join(parts)) == parts)
        seen.add(own._may_follow(a, b))
    assert seen == {True, False}


def test_emptied_caches_need_no_collector():
    """States refer to each other in circles; they are freed at once, so encoding tasks run without the collector."""
    import gc
    import weakref

    class Watched(bpe.State):
        __slots__ = ("__weakref__",)

    own = bpe.Transducer(bpe.read_ranks(PATH))
    gc.collect()
    gc.disable()
    try:
        own.states = {}
        state = Watched()
        state.paths = own.root.paths
        own.states[state.paths] = own.root = state
        own.encode(b"aaaa" * 50 + b"the end")
        state[0] = 0, state  # a circle
        gone = weakref.ref(state)
        del state
        own._reset()
        assert gone() is None
    finally:
        gc.enable()
