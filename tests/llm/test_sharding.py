import zlib
from collections import defaultdict

import pytest

from frondlake.llm import sharding

SHARDS = 8


def check(rows, shards=SHARDS, together=True):
    by, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        by[r.shard].append(r)
        groups[r.text_group].add(r.shard)
    for members in by.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    if together:
        assert all(len(s) == 1 for s in groups.values())
    return {s: (sum(r["size"] for r in m), sum(r.tokens for r in m), len(m)) for s, m in by.items()}


def test_balance_and_groups(spark):
    rows = [(i, f"{'w' * (i % 13)} {i % 3000} " * (1 + i % 7)) for i in range(12_000)]
    rows += [(100_000 + i, "copy of a text") for i in range(600)]
    loads = check(sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert set(loads) == set(range(SHARDS))
    for k in range(3):
        values = [load[k] for load in loads.values()]
        assert max(values) < 1.005 * sum(values) / SHARDS and min(values) > 0.995 * sum(values) / SHARDS


def test_group_larger_than_a_shard(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(6_000)]
    loads = check(sharding.assign(spark.createDataFrame(rows, "doc_id long, text string")).collect(), together=False)
    sizes = [load[0] for load in loads.values()]
    assert max(sizes) < 1.15 * sum(sizes) / SHARDS


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "a"), (None, None), (2, ""), (3, "x" * 300_000), (3, "x" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS shard", "6 AS slot")
    out = sharding.assign(frame)
    check(out.collect(), together=False)
    assert out.count() == len(rows)
    assert sharding.assign(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_pack_is_the_greedy_rule(seed, monkeypatch):
    import random

    pick = random.Random(seed)
    items = [tuple(pick.random() for _ in range(3)) for _ in range(200)]
    total = [sum(i[k] for i in items) for k in range(3)]
    items = [tuple(v / t for v, t in zip(i, total)) for i in items]
    monkeypatch.setattr(sharding, "EXCHANGES", 0)
    placed = sharding.pack(items, 4)
    left = [[0.25] * 3 for _ in range(4)]
    for i in sorted(range(200), key=lambda i: (-max(items[i]), -sum(items[i]), i)):
        dots = [sum(a * b for a, b in zip(items[i], c)) for c in left]
        assert dots[placed[i]] >= max(dots) - 1e-12
        left[placed[i]] = [a - b for a, b in zip(left[placed[i]], items[i])]


def test_write_shards(spark, tmp_path):
    rows = [(i, f"text {i % 40}", "s") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sharding.write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text, r.source) for r in back.collect()) == sorted(rows)
    assert back.groupBy("text").agg({"shard": "max"}).count() == back.select("text", "shard").distinct().count() == 40


def test_columns_of_any_name_pass(spark, tmp_path):
    names = ["text_group", "own", "count", "to", "strip", "number", "start", "row", "_group", "_strip"]
    frame = spark.createDataFrame([(i, f"text {i % 3}") for i in range(30)], "doc_id long, text string").selectExpr(
        "*", *[f"'{n}' AS {n}" for n in names])
    sharding.write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 30 and set(map(tuple, back.select(*names).collect())) == {tuple(names)}
    rows = frame.drop("text_group").selectExpr("*", "text AS text_group", "doc_id % 2 AS shard")
    slots = sharding.with_slots(rows, 30)
    assert sorted(r.slot for r in slots.where("shard = 0").collect()) == list(range(15))
    assert set(map(tuple, slots.select(*names[1:]).collect())) == {tuple(names[1:])}


def test_query(spark):
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op2_shards"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    shard_of = {}
    for doc in docs:
        row, data = got[doc.doc_id], doc.text.encode()
        assert (row["size"], row.text_crc32, row.law, row.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(doc.text, row.shard) == row.shard
    sizes = defaultdict(int)
    for row in got.values():
        sizes[row.shard] += row["size"]
    assert max(sizes.values()) < 1.01 * sum(sizes.values()) / SHARDS
