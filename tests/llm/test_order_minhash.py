import hashlib
import random

import pytest

from frondlake.llm import order_minhash as omh


def brute(text, hasher):
    """Samples by plain Python: the elements of every permutation sorted."""
    kmer, element = hasher.elements(text)
    out = []
    for factor in hasher.factors.tolist():
        order = sorted(range(len(element)), key=lambda i: ((int(element[i]) * factor) % (1 << 32), i))
        chosen = sorted(order[:hasher.size])
        chosen = [-1] * (hasher.size - len(chosen)) + chosen
        value = 0
        for i in chosen:
            value = ((value ^ (int(kmer[i]) if i >= 0 else 1)) * 0x94D049BB133111EB) % (1 << 64)
            value ^= value >> 31
        out.append((value >> 16) % (1 << 32))
    return out


def test_samples_against_brute_force(monkeypatch):
    hasher = omh.OrderMinHash()
    pick = random.Random(1)
    for size in (1, 2, 5, 6, 7, 8, 50, 300):
        text = "".join(pick.choices("abé🙂 ", k=size))
        assert hasher.samples(text).tolist() == brute(text, hasher)
    monkeypatch.setattr(omh, "SLICE", 16)
    text = "".join(pick.choices("abcdefghij ", k=200))
    assert hasher.samples(text).tolist() == brute(text, hasher)
    assert hasher.samples("").tolist() == [0] * omh.SAMPLES


def test_occurrences_are_numbered():
    hasher = omh.OrderMinHash()
    _, element = hasher.elements("abcabcabcabcabcabc")
    assert len(set(element.tolist())) == len(element)


def test_order_and_edits_show():
    hasher = omh.OrderMinHash(samples=400)
    pick = random.Random(2)
    words = ["".join(pick.choices("abcdefghijklmnop", k=6)) for _ in range(200)]
    text = " ".join(words)

    def near(other):
        return (hasher.samples(text) == hasher.samples(other)).mean()

    few = list(words)
    for _ in range(4):
        few[pick.randrange(200)] = "changed"
    turned = " ".join(words[100:] + words[:100])  # nearly the same set of k-mers in another order
    assert near(text) == 1 and near(" ".join(few)) > 0.7
    assert near(turned) < 0.7 < near(" ".join(few))
    assert near("x y z " * 50) < 0.02


ROWS = [(5, "abcdef ghij"), (None, "first by null"), (7, None), (7, ""), (9, "é" * 40_001), (9, "é" * 40_001),
        (11, "last 🙂 text of all"), (-3, "negative key"), (8, "a")]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_rows_and_ties(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS k").repartition(3)
        got = omh.fingerprint_edits(frame).collect()
        assert omh.fingerprint_edits(frame.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(((k, t or "") for k, t in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (k, t) in enumerate(order):
        following, half = order[(i + 1) % len(order)][1], len(t) // 2
        want.append((k, len(t), hashlib.sha256((t[:len(t) - half] + following[:half]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)


def test_next_row_beside_columns_of_any_name(spark):
    names = ["k", "part", "at", "own_range", "before", "first", "_p", "_r", "_at", "_before", "_first"]
    frame = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "doc_id long, text string").selectExpr(
        "*", *[f"'{n}' AS {n}" for n in names])
    got = omh.with_next(frame, ["text"])
    assert got.columns == ["doc_id", "text", *names, "next_text"]
    assert sorted(map(tuple, got.collect())) == [(1, "a", *names, "b"), (2, "b", *names, "c"), (3, "c", *names, "a")]


def test_query(spark):
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r.doc_id: r for r in QUERIES["op5_order_minhash"](spark, folder).collect()}
    hasher = omh.OrderMinHash()
    prints = {k: hasher.fingerprint(t).hex() for k, t in docs}

    def near(a, b):
        return sum(a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)) / omh.SAMPLES

    assert len(got) == len(docs)
    for i, (k, t) in enumerate(docs):
        follow, half = docs[(i + 1) % len(docs)], len(t) // 2
        edited = t[:len(t) - half] + follow[1][:half]
        row = got[k]
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == prints[k] and row.edited_fingerprint == hasher.fingerprint(edited).hex()
        assert row.near_edited == near(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == near(prints[k], prints[follow[0]])
    assert sum(r.near_edited for r in got.values()) > 5 * sum(r.near_next for r in got.values())
