import duckdb
import pytest

from frondlake.llm import licenses

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files, to deal in the Software without restriction.")
ROWS = [
    (1, None, "x"), (2, "", "x"), (3, "Released UNDER the MIT-License. Under the mit license", None),
    (4, "word " * 70 + MIT + " word" * 500, "x"), (4, "word " * 70 + MIT + " word" * 500, "x"),
    (5, "cc by nc cc by nc, apache license version 2.0", "x"), (6, "apache license version 20", "x"),
    (7, MIT.replace("hereby ", "").replace("charge", "fee").replace("any", "every"), "x"),
    (8, "permission granted to any person", "x"), (9, "ünder the mit license", "x"), (10, " \n ", "x"),
    (11, "the " * 5_000 + "under the mit license", "x"), (12, "é" * 100_000, None),
]
COLUMNS = "doc_id long, text string, labels string"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("doc_id", *licenses.RESULT).collect())


def want(con):
    return sorted(con.execute("SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ("
                              + licenses.sql() + ")").fetchall())


def test_equals_brute_force(frame):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", ROWS)
    got = rows(licenses.scan(frame))
    assert got == want(con)
    by = {r[0]: r for r in got}
    assert by[3][1:6] == (9, 2, 1, 5, "mit") and by[5][2:6] == (3, 0, 6, "apache-2,cc-by-nc")
    assert by[4][6] == "mit" and by[4][7] == 1.0 and by[7][6] == "mit" and 0.8 <= by[7][7] < 1
    assert by[1][1:] == (0, 0, None, None, "", "", 0.0) and by[8][6] == ""


def test_any_order_gives_the_same_result(frame):
    order = licenses.vocabulary(licenses.TEMPLATES)
    assert rows(licenses.scan(frame, order)) == rows(licenses.scan(frame, order[::-1]))


def test_empty_table_and_columns(frame):
    out = licenses.scan(frame.limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "text", *licenses.RESULT, "blocks"]
    mine = frame.selectExpr("*", "1 AS joined", "2 AS split", "3 AS at", "4 AS hits", "5 AS _t", "6 AS n_words")
    got = licenses.scan(mine)
    assert rows(got) == rows(licenses.scan(frame))
    assert set(map(tuple, got.select("joined", "split", "at", "hits", "_t").collect())) == {(1, 2, 3, 4, 5)}


def test_a_notice_is_found_wherever_it_stands(spark):
    """A template spread evenly over a whole block of 64 words, behind 0 to 95 other words; one word more is too far."""
    words = max((t.split() for label, t in licenses.TEMPLATES if label == "unlicense"), key=len)
    gaps = [(i * 63) // (len(words) - 1) for i in range(len(words))]
    spread = ["filler"] * 64
    for at, word in zip(gaps, words):
        spread[at] = word
    exact = [(i, "filler " * i + " ".join(spread) + " filler" * (i % 7)) for i in range(96)]
    n, need = len(set(words)), -(-len(set(words)) * 4 // 5)
    first = sorted(dict.fromkeys(words), key=words.index)[:need]
    apart = " ".join(first[:-1] + ["filler"] * (65 - need) + first[-1:])
    close = " ".join(first[:-1] + ["filler"] * (64 - need) + first[-1:])
    frame = spark.createDataFrame(exact + [(1000, apart), (1001, close)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(frame).collect()}
    assert all(got[i].labels == "unlicense" and got[i].score == 1.0 for i in range(96))
    assert all(min(b.first_word for b in got[i].blocks) == i for i in range(96))
    assert got[1000].labels == "" and got[1001].labels == "unlicense" and got[1001].score == need / n


@pytest.mark.parametrize("k", range(len(licenses.TEMPLATES)))
def test_each_sentence_gives_its_label(k):
    label, text = licenses.TEMPLATES[k]
    assert len(text.split()) <= licenses.BLOCK, label
    assert text == " ".join(text.split()) and not set(text) - set("abcdefghijklmnopqrstuvwxyz0123456789 ")


def test_random_texts_against_every_window(spark):
    """Texts of template words and others, also with repeated words, against all windows of them."""
    import math
    import random

    pick = random.Random(5)
    vocabulary = licenses.vocabulary(licenses.TEMPLATES)
    texts = []
    for i in range(120):
        label, text = pick.choice(licenses.TEMPLATES)
        out = []
        for word in text.split():
            out += [word] * (pick.random() > 0.1) + pick.choices(vocabulary + ["x"] * 200, k=pick.randint(0, 3))
        texts.append((i, " ".join(pick.choices(["x", "of", "the"], k=pick.randint(0, 70)) + out)))
    want = {}
    for i, text in texts:
        words, labels, best = text.split(), set(), 0.0
        for s in range(len(words)):
            inside = set(words[s:s + licenses.BLOCK])
            for label, template in licenses.TEMPLATES:
                own = set(template.split())
                if len(own & inside) >= math.ceil(licenses.THRESHOLD * len(own) - 1e-9):
                    labels.add(label)
                    best = max(best, len(own & inside) / len(own))
        want[i] = (",".join(sorted(labels)), best)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(frame, phrases=[("no such phrase", "x")]).collect()}
    assert got == want and sum(bool(v[0]) for v in want.values()) > 30


def test_no_python_in_the_plan(frame):
    plan = licenses.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("name", ["op4_license_scan"])
def test_query_equals_sql(spark, name):
    from frondlake.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    assert rows(QUERIES[name](spark, "/root/testdata/sf0.01")) == want(con)
