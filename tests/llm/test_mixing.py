import math
from collections import Counter, defaultdict

import duckdb
import pytest

from frondlake.llm import mixing

COLUMNS = "doc_id long, text string, source string"


def rows(sizes):
    out, n = [], 0
    for name, count in sizes.items():
        for _ in range(count):
            out.append((n, "w " * (1 + n % 9), name))
            n += 1
    return out


@pytest.mark.parametrize("sizes", [{"a": 600, "b": 300, "c": 150}, {"a": 50, "b": 50}, {"a": 2000, "b": 3, None: 40}, {"a": 7}])
def test_repeats_and_weights(spark, sizes):
    data = rows(sizes)
    got = mixing.mix(spark.createDataFrame(data, COLUMNS)).collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) == {d[0] for d in data} and max(times.values()) <= 2
    before, after = Counter(), Counter()
    for d, t, s in data:
        before[s] += len(t.split())
        after[s] += times[d] * len(t.split())
    repeats = {s: after[s] / before[s] for s in before}
    shares = {s: before[s] / sum(before.values()) for s in before}
    alpha = mixing.exponent(spark.createDataFrame(list(before.items()), "source string, tokens long"))
    for s in before:
        want = (max(shares.values()) / shares[s]) ** (1 - alpha)
        assert repeats[s] <= want + 1e-9 and repeats[s] >= want - 60 / before[s] - 0.01


def test_exponent_by_brute_force(spark):
    tokens = {"a": 1000, "b": 200, "c": 50, "d": 0}
    frame = spark.createDataFrame(list(tokens.items()), "source string, tokens long")
    p = [t / 1250 for t in tokens.values() if t]

    def entropy(a):
        z = sum(x ** a for x in p)
        return -sum(x ** a / z * math.log(x ** a / z) for x in p)

    grid = [k / (1 << mixing.STEPS) for k in range((1 << mixing.STEPS) + 1)]
    assert mixing.exponent(frame, 2.0) == min(a for a in grid if (max(p) / min(p)) ** (1 - a) <= 2.0 + 1e-12)
    assert mixing.exponent(frame, entropy=0.9) == max(a for a in grid[:-1] if entropy(a) >= 0.9 - 1e-12)
    assert mixing.exponent(frame, entropy=2.0) == 0 and mixing.exponent(frame, 1.0) == 1
    assert mixing.exponent(frame.limit(0)) == 1
    wanted = min(a for a in grid if max(x ** (a - 1) for x in p) / sum(x ** a for x in p) * 2500 / 1250 <= 3)
    assert mixing.exponent(frame, 3.0, budget=2500) == wanted


def test_budget_drops_and_repeats(spark):
    data = rows({"a": 900, "b": 90})
    total = sum(len(t.split()) for _, t, _ in data)
    got = mixing.mix(spark.createDataFrame(data, COLUMNS), entropy=math.log(2), budget=total).collect()
    used = defaultdict(int)
    for r in got:
        used[r.source] += len(r.text.split())
    assert total / 2 - 40 <= used["a"] <= total / 2 and total / 2 - 40 <= used["b"] <= total / 2


def test_odd_rows(spark):
    data = [(1, None, "a"), (None, "x y", None), (None, "x y", None), (2, "", None), (3, "w " * 50_000, "b"), (4, "w", "b")]
    frame = spark.createDataFrame(data, COLUMNS).selectExpr("*", "9 AS mix_pass", "'z' AS whole")
    out = mixing.mix(frame)
    assert out.columns == ["doc_id", "text", "source", "whole", "mix_pass"]
    assert out.where("mix_pass = 0").count() == len(data)
    assert mixing.mix(frame.limit(0)).count() == 0
    names = ["at", "of", "whole", "last", "_source", "_whole", "_last", "_at", "tokens", "block"]
    mine = spark.createDataFrame(data, COLUMNS).selectExpr("*", *[f"'{n}' AS {n}" for n in names])
    got = mixing.mix(mine)
    assert got.columns == ["doc_id", "text", "source", *names, "mix_pass"] and got.count() == out.count()
    assert set(map(tuple, got.select(*names).collect())) == {tuple(names)}


def test_query_equals_sql(spark):
    from frondlake.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.execute(ORACLE["op6_source_mix"]).fetchall()
    got = QUERIES["op6_source_mix"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(want)
