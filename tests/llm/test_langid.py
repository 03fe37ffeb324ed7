import zlib

import numpy as np
import pytest

from frondlake.llm import langid

WORDS = {"en": "the of and to in is that it was for on are with as they at be this from".split(),
         "de": "der die und das von zu den mit sich auf für ist im dem nicht ein eine als auch".split(),
         "fr": "le la les des est une dans que pour qui sur pas plus par être au avec ce où".split()}


def prose(seed, lang, n):
    draw = np.random.default_rng(seed)
    return " ".join(draw.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def model():
    rows = [(prose(i, lang, 40).encode(), lang) for i in range(150) for lang in WORDS]
    return langid.train([r[0] for r in rows], [r[1] for r in rows], epochs=6)


def test_learns(model):
    right = 0
    for i in range(60):
        for lang in WORDS:
            data = np.frombuffer(prose(1000 + i, lang, 30).encode(), np.uint8)
            found = langid.classify(model, data, np.array([0, len(data)]))
            right += model.labels[found[0].argmax()] == lang
    assert right >= 0.97 * 180


def test_responses_are_a_convolution(model):
    block, _ = langid.windows(np.frombuffer(prose(3, "fr", 20).encode(), np.uint8))
    found, _ = langid.responses(model, block)
    padded = np.pad(block, ((0, 0), (0, 4)), constant_values=256)
    for f, width in ((0, 2), (9, 3), (20, 4), (31, 5)):
        kernel = model.filters[:, f].reshape(-1, langid.EMBEDDING)
        assert not kernel[width:].any()
        for p in (0, 7, 250):
            want = sum(model.embedding[padded[0, p + j]] @ kernel[j] for j in range(width))
            assert abs(found[0, p, f] - want) < 1e-3


def test_batches_do_not_matter(model, monkeypatch):
    texts = [prose(i, "de", 5 + 60 * (i % 5)).encode() for i in range(20)] + [b"", prose(9, "en", 9000).encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0] + [len(t) for t in texts])
    want = langid.classify(model, data, ends)
    monkeypatch.setattr(langid, "BATCH_WINDOWS", 7)
    assert np.allclose(want, langid.classify(model, data, ends), atol=1e-5)


def test_same_sample_same_model(spark):
    rows = [(i, prose(i, lang, 30), lang) for i in range(60) for lang in WORDS]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = (langid.fit(f, epochs=1) for f in (frame, frame.repartition(5)))
    assert a.labels == b.labels and all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("embedding", "filters", "weights"))
    assert langid.sample(frame, "text", "lang", "doc_id", 10, 3).groupBy("label").count().where("count > 10").isEmpty()


@pytest.mark.parametrize("rows", [[], [(1, "a text", None), (2, None, "en")]])
def test_nothing_to_learn_from(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr(
        "*", "1 AS letter", "2 AS _letter", "3 AS _label", "4 AS label", "5 AS digest", "6 AS _n", "7 AS windows")
    model = langid.fit(frame)
    assert model.labels == ()
    out = langid.predict(frame, model)
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in out.collect()) == [(r[0], "und", 0.0) for r in rows]


def test_odd_rows(spark, model):
    rows = [(1, None, "en"), (2, "", None), (3, "12 34 !!", "en"), (4, prose(5, "fr", 30), None), (4, prose(5, "fr", 30), None),
            (5, prose(6, "de", 60_000), "de"), (None, "é", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS _x", "3 AS letter")
    out = langid.predict(frame, model)
    assert out.columns == ["doc_id", "text", "lang", "_x", "letter", "lang_pred", "score"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "fr" and got[5][0] == "de" and got[None][1] > 0
    assert langid.predict(frame.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 == 1]
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1) for d in docs)
    accuracy = sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held)
    print("held-out accuracy", accuracy, min(r.score for r in got.values()))
    assert accuracy > 0.97 and all(0 <= r.score <= 1 for r in got.values())
