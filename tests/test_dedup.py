import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from frondlake.operators import dedup


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def _brute(rows, limit):
    seen = {}
    for _, _, h in rows:
        seen[h] = seen.get(h, 0) + 1
    single = [r for r in rows if seen[r[2]] == 1]
    return {
        (a[0], min(a[1], b[1]), max(a[1], b[1]), bin((a[2] ^ b[2]) & ((1 << 64) - 1)).count("1"))
        for a, b in combinations(single, 2)
        if a[0] == b[0] and bin((a[2] ^ b[2]) & ((1 << 64) - 1)).count("1") <= limit
    }


def _clustered(seed, bits, count, flat):
    """Hashes near a few centres; ``flat`` clears the upper half of most of them."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(bits) for _ in range(6)]
    rows = []
    for i in range(count):
        h = rng.choice(centres)
        for b in rng.sample(range(bits), rng.randint(0, 6)):
            h ^= 1 << b
        if flat and rng.random() < 0.7:
            h &= (1 << bits // 2) - 1
        rows.append((rng.randint(1, 2), f"f{i:04d}", _signed(h)))
    return rows


def _pairs(df):
    return {tuple(r) for r in df.select("class_id", "file_a", "file_b", "hamming_distance").collect()}


@pytest.mark.parametrize("bits, limit", [(64, 5), (64, 2), (64, 0), (56, 14), (12, 4), (64, 9)])
@pytest.mark.parametrize("flat, hot", [(False, None), (True, 200), (True, 2), (False, 1)])
def test_near_duplicates_equal_brute_force(spark, bits, limit, flat, hot):
    rows = _clustered(bits * 100 + limit, bits, 90, flat)
    df = spark.createDataFrame(rows, "class_id int, relative_path string, dhash bigint")
    found = dedup.near_duplicates(df, bits=bits, max_distance=limit, hot_value_rows=hot)
    listed = [tuple(r) for r in found.collect()]
    assert len(listed) == len(set(listed))
    assert _pairs(found) == _brute(rows, limit)


def _brute_classes(rows, limit):
    pairs = _brute(rows, limit)
    links, root = {}, {}
    for _, a, b, _ in pairs:
        for x in (a, b):
            links[x] = links.get(x, 0) + 1
            root.setdefault(x, x)
    changed = True
    while changed:
        changed = False
        for _, a, b, _ in pairs:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return {(c, f, root[f], links[f]) for c, f, _ in rows if f in links}


@pytest.mark.parametrize("bits, limit, flat, hot", [(64, 5, False, 200), (56, 14, True, 2), (12, 4, False, 1), (64, 2, True, None)])
def test_near_classes_equal_brute_force(spark, bits, limit, flat, hot):
    rows = _clustered(bits * 7 + limit, bits, 120, flat)
    df = spark.createDataFrame(rows, "class_id int, relative_path string, dhash bigint")
    found = dedup.near_duplicate_classes(df, bits=bits, max_distance=limit, hot_value_rows=hot).collect()
    assert {tuple(r) for r in found} == _brute_classes(rows, limit) and len(found) == len({r[1] for r in found})


def test_near_classes_of_a_chain(spark):
    """One bit a step: every record but the ends has two links, all are one class; nothing near, nothing returned."""
    rows = [(1, f"f{63 - i:02d}", _signed((1 << i) - 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "class_id int, relative_path string, dhash bigint")
    found = dedup.near_duplicate_classes(df, max_distance=1).collect()
    assert {tuple(r) for r in found} == _brute_classes(rows, 1) and {r["near_class"] for r in found} == {"f24"}
    assert dedup.near_duplicate_classes(df.limit(0), max_distance=1).count() == 0


def test_members_of_equal_groups_pair_with_nobody(spark):
    rows = [(1, "a", 0), (1, "b", 0), (1, "c", 1), (1, "d", 3), (2, "e", 7), (1, "f", -1)]
    df = spark.createDataFrame(rows, "class_id int, relative_path string, dhash bigint")
    assert _pairs(dedup.near_duplicates(df)) == {(1, "c", "d", 1)}
    invalid = df.withColumn("valid", F.col("relative_path") != "d")
    assert _pairs(dedup.near_duplicates(invalid)) == set()


def test_distance_limit_is_inclusive(spark):
    rows = [(1, "a", 0b11111), (1, "b", 1 << 40), (1, "c", 0)]
    df = spark.createDataFrame(rows, "class_id int, relative_path string, dhash bigint")
    assert _pairs(dedup.near_duplicates(df)) == {(1, "a", "c", 5), (1, "b", "c", 1)}


def test_more_hot_values_than_any_constant(spark):
    """Every part value is hot: the join must find the pairs all the same."""
    rows = [(c, f"{c}-{i:04d}", (c << 40) ^ i) for c in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "class_id int, relative_path string, dhash bigint")
    plain = {(c, a, b, (x ^ y).bit_count()) for c, a, x in rows for d, b, y in rows
             if c == d and a < b and (x ^ y).bit_count() <= 5 and x != y}
    assert plain and _pairs(dedup.near_duplicates(df, hot_value_rows=1)) == plain


@pytest.fixture(scope="module")
def copies(spark):
    rows = [(True, 2, "p/b", "h1"), (True, 1, "p/z", "h1"), (True, 1, "p/c", "h1"), (True, 3, "q/a", "h2"),
            (True, 3, "q/b", "h2"), (True, 4, "r/a", "h3"), (False, 4, "r/b", "h3"), (True, 4, "r/c", None)]
    return spark.createDataFrame(rows, "valid boolean, class_id int, relative_path string, sha256 string")


def test_duplicate_groups_and_summary(copies):
    groups = {r["sha256"]: r for r in dedup.duplicate_groups(copies, "sha256").collect()}
    assert set(groups) == {"h1", "h2"}
    assert (groups["h1"]["files"], groups["h1"]["cross_class"]) == (3, True)
    assert (groups["h1"]["keep_class_id"], groups["h1"]["keep_relative_path"]) == (1, "p/c")
    row = dedup.duplicate_summary(copies, "sha256").first()
    assert tuple(row) == (3, 2, 3, 1, 1)


def test_plan_keeps_the_first_record_of_each_group(copies):
    plan = {r["relative_path"]: r["status"] for r in dedup.dedup_plan(copies, "sha256").collect()}
    assert plan == {"p/c": "KEEP", "p/z": "DUPLICATE", "p/b": "DUPLICATE", "q/a": "KEEP", "q/b": "DUPLICATE"}
    kept = {r["relative_path"] for r in dedup.keep_first(copies, "sha256").collect()}
    assert kept == {"p/c", "q/a", "r/a", "r/b", "r/c"}


def test_group_join_with_and_without_heavy_groups(spark, copies):
    from frondlake.operators.rows import join_group_rows

    groups = copies.where("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    for heavy in (1, 2, 100):
        joined = join_group_rows(copies, groups, "sha256", "n", heavy)
        assert sorted((r["relative_path"], r["n"]) for r in joined.collect()) == [
            ("p/b", 3), ("p/c", 3), ("p/z", 3), ("q/a", 2), ("q/b", 2), ("r/a", 2), ("r/b", 2)]


def test_cross_class_examples(copies):
    rows = dedup.cross_class_examples(copies, "sha256").collect()
    assert {(r["example"], r["relative_path"]) for r in rows} == {(1, "p/b"), (1, "p/c"), (1, "p/z")}


RECORD = "valid boolean, class_id int, relative_path string, sha256 string, dhash bigint"


def _removed(rows):
    """Brute force: exact copies, then visual ones among what is left."""
    found, left = set(), [r for r in rows if r[0]]
    for stage, at in (("exact", 3), ("visual", 4)):
        groups = {}
        for r in left:
            groups.setdefault(r[at], []).append(r[1:3])
        first = {h: min(g) for h, g in groups.items() if h is not None}
        gone = [r for r in left if r[at] is not None and r[1:3] != first[r[at]]]
        found |= {(stage, *r[1:3], *first[r[at]], len(groups[r[at]])) for r in gone}
        left = [r for r in left if r not in gone]
    return found


def test_removal_plan_judges_visual_duplicates_over_the_exact_survivors(spark):
    rng = random.Random(5)
    rows = [(rng.random() > 0.05, rng.randint(1, 4), f"f{i:04d}",
             rng.choice([None, "hot", "hot", *map(str, range(150))]), rng.choice([None, 7, 7, *range(100, 220)]))
            for i in range(600)]
    df = spark.createDataFrame(rows, RECORD)
    plan = dedup.removal_plan(df)
    got = [tuple(r) for r in plan.collect()]
    assert set(got) == _removed(rows) and len(got) == len(set(got))
    files = [r[1:3] for r in got]
    assert len(files) == len(set(files)) and {r[0] for r in got} == {"exact", "visual"}
    assert tuple(dedup.removal_counts(plan).first()) == tuple(
        sum(r[0] == stage for r in got) for stage in ("exact", "visual"))
    chained = [(True, 1, "a", "x", 1), (True, 1, "b", "x", 2), (True, 1, "c", "y", 2), (True, 1, "a", "x", 1)]
    # b goes as a copy of a, so c has no visual duplicate left; a listed twice is not its own copy.
    assert [r["relative_path"] for r in dedup.removal_plan(spark.createDataFrame(chained, RECORD)).collect()] == ["b"]
    assert dedup.removal_plan(df.where("class_id > 9")).count() == 0
    assert tuple(dedup.removal_counts(dedup.removal_plan(df.where("class_id > 9"))).first()) == (0, 0)


def test_example_classes(copies):
    found = dedup.example_classes(dedup.cross_class_examples(copies, "sha256"), "sha256").collect()
    assert {tuple(r) for r in found} == {(1, "h1", 1, 2, "p/c"), (1, "h1", 2, 1, "p/b")}


def test_empty_input(spark, copies):
    nothing = copies.where("class_id > 99")
    assert tuple(dedup.duplicate_summary(nothing, "sha256").first()) == (0, 0, 0, 0, 0)
    assert dedup.dedup_plan(nothing, "sha256").count() == 0
