import os
import random
import time
from collections import Counter

import numpy as np
import pytest

from frondlake.llm import near_dedup as nd

COLUMNS = "doc_id long, text string, lang string"


def bags(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)))
    return out


def brute(rows, threshold=0.8, plain=False):
    """Class (smallest id) of each row by all pairs; weights as documented."""
    texts = [r[1] for r in rows]
    sets, n = bags(texts), len(rows)
    df = Counter(s for bag in sets for s in bag)
    idf = {s: np.log1p(1 / max(d / n, nd.RARE)) for s, d in df.items()}
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            same = texts[i].lower().split() == texts[j].lower().split()
            a, b = sets[i], sets[j]
            if not same and a and b and a.keys() & b.keys():
                low = sum(idf[s] * min(a[s], b[s]) for s in a.keys() & b.keys())
                high = sum(idf[s] * max(a[s], b[s]) for s in a.keys() | b.keys())
                same = low / high >= threshold or plain and len(a.keys() & b.keys()) / len(a.keys() | b.keys()) >= threshold
            if same:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], least[find(i)]) for i, r in enumerate(rows))


def corpus(seed, groups, hot):
    pick = random.Random(seed)
    vocabulary = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 7))) for _ in range(3000)]
    passage = [pick.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(30, 400))]
        if g % 4 == 0:
            base = passage + base
        for c in range(hot if g == 0 else pick.randint(1, 4)):
            copy = list(base)
            for _ in range(c and int(len(base) * pick.choice([0, .005, .01, .02, .04, .1]))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), "en"))
    return rows


@pytest.mark.parametrize("seed, groups, hot", [(1, 60, 3), (2, 25, 120)])
def test_equals_brute_force(spark, seed, groups, hot):
    rows = corpus(seed, groups, hot)
    got = sorted((r.key, r.class_id) for r in nd.classes(spark.createDataFrame(rows, COLUMNS)).collect())
    want = brute(rows)
    different = sum(g != w for g, w in zip(got, want))
    assert different <= 0.01 * len(rows), (different, len(rows))


def repeated_lines(pick, words):
    """Pairs of plain similarity above 0.9 and weighted similarity near 0.33: one line stands 20 more times."""
    rows = []
    for _ in range(30):
        text = words(204)
        rows += [text, text + text[90:114] * 20]
    return rows


def hot_copies(pick, words):
    """Half of the rows are one text; near copies add rare words, so weighted similarity is about 0.5."""
    hot = words(204)
    return [hot] * 60 + [hot + words(46) for _ in range(20)] + [words(100) for _ in range(40)]


@pytest.mark.parametrize("build", [repeated_lines, hot_copies])
def test_plain_similarity_links_if_asked(spark, build):
    pick = random.Random(11)
    texts = build(pick, lambda n: ["".join(pick.choices("abcdefghij", k=8)) for _ in range(n)])
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)]
    got = sorted((r.key, r.class_id) for r in nd.classes(spark.createDataFrame(rows, COLUMNS), plain=True).collect())
    assert got == brute(rows, plain=True)


def near_copies(pick, rate):
    """A text and copies in which about ``rate`` of the words are others."""
    base = ["".join(pick.choices("abcdefghij", k=6)) for _ in range(300)]
    return [" ".join("".join(pick.choices("klmnop", k=6)) if pick.random() < rate else w for w in base) for _ in range(2)]


def test_recall_by_similarity(spark):
    """Pairs at and above the threshold are found, whatever their similarity; those below are not."""
    pick = random.Random(5)
    texts = [t for i in range(300) for t in near_copies(pick, [0.002, 0.005, 0.01, 0.013, 0.016, 0.02][i % 6])]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r.key: r.class_id for r in nd.classes(spark.createDataFrame(rows, COLUMNS)).collect()}
    sets, hits = bags(texts), {}
    for i in range(0, len(texts), 2):
        a, b = sets[i], sets[i + 1]
        level = len(a.keys() & b.keys()) / len(a.keys() | b.keys())
        found = got[i] == got[i + 1]
        assert found <= (level >= 0.8)
        if level >= 0.8:
            hits.setdefault(int(level * 20) / 20, []).append(found)
    print({k: (sum(v) / len(v), len(v)) for k, v in sorted(hits.items())})
    assert len(hits) >= 3 and all(sum(v) >= 0.9 * len(v) for v in hits.values())


def test_a_third_of_all_rows_are_near_copies(spark):
    """The shingles of a large group of near copies are not common, so its members stay linked."""
    pick = random.Random(6)
    base = ["".join(pick.choices("abcdefghij", k=6)) for _ in range(200)]
    rows = []
    for i in range(300):
        words = list(base) if i % 3 == 0 else ["".join(pick.choices("abcdefghij", k=6)) for _ in range(200)]
        words[pick.randrange(200)] = f"changed{i}"
        rows.append((i, " ".join(words), "en"))
    got = sorted((r.key, r.class_id) for r in nd.classes(spark.createDataFrame(rows, COLUMNS)).collect())
    assert got == brute(rows)
    assert sum(c == 0 for _, c in got) == 100


@pytest.mark.parametrize("parts", [1, 40])
def test_frequent_shingles_do_not_depend_on_tasks(spark, parts):
    rows = corpus(8, 30, 40)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(parts)
    assert len(nd.frequent_shingles(frame).hashes) == sum(
        d >= nd.RARE * len(rows) for d in Counter(s for bag in bags([r[1] for r in rows]) for s in bag).values())


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, "a"), (6, text.upper() + "  \n", "b"), (7, None, None), (8, None, "x"), (9, "", "x"), (10, " \t", "x"),
            (11, "one two", "x"), (12, "two one", "x"), (5, text, "a"), (13, "z" * 500_000 + " " + text + " q" * 900_000, "x"),
            (14, "z" * 500_000 + " " + text + " q" * 900_000 + " end", "x")]
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS root", "2 AS node", "3 AS tag", "4 AS _tag", "5 AS _key",
                                                             "6 AS key", "7 AS tag_", "8 AS key_", "9 AS class_id", "10 AS a", "11 AS _t")
    got = sorted((r.key, r.class_id) for r in nd.classes(frame).collect())
    assert got == [(5, 5), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (10, 9), (11, 11), (12, 12), (13, 13), (14, 13)]
    kept = nd.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [5, 7, 8, 9, 11, 12, 13]
    assert nd.classes(frame.limit(0)).count() == 0 and nd.deduplicate(frame.limit(0)).count() == 0


def test_word_hashes_do_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["alpha beta  gamma", "", None, " beta\talpha", "x" * 9000, "gamma"]
    words = nd.Words()
    hashes, rows = words(*nd.text_bytes(pa.array(texts)))
    alone = [words(*nd.text_bytes(pa.array([t])))[0].tolist() for t in texts]
    assert [hashes[rows == i].tolist() for i in range(6)] == alone
    assert alone[0][0] == alone[3][1] and alone[0][2] == alone[5][0] and len(alone[4]) == 1


def test_samples_agree_as_often_as_weighted_jaccard():
    draw = np.random.default_rng(3)
    value = np.sort(draw.integers(0, 1 << 63, 400, dtype=np.uint64))
    w1 = draw.gamma(2.0, size=400) + 0.01
    w2 = np.where(draw.random(400) < 0.7, w1, draw.gamma(2.0, size=400) + 0.01)
    sample = nd.Sampler(4000)
    a, b = (sample(np.array([0]), value, w)[0] for w in (w1, w2))
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((a == b).mean() - want) < 0.04


def test_frequent_shingles_are_exact(spark):
    rows = corpus(4, 40, 30)
    frequent = nd.frequent_shingles(spark.createDataFrame(rows, COLUMNS).repartition(7))
    df = Counter(s for bag in bags([r[1] for r in rows]) for s in bag)
    assert len(frequent.hashes) == sum(d >= nd.RARE * len(rows) for d in df.values())


def test_query(spark):
    from frondlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op7_near_duplicates"](spark, folder).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


@pytest.mark.parametrize("parts", [1, 9])
def test_document_frequencies_of_all_shingles(spark, parts, monkeypatch):
    """Rare shingles are counted as exactly as frequent ones, whatever the blocks and buckets."""
    monkeypatch.setattr(nd, "CHUNK_BYTES", 3000)
    rows = corpus(9, 20, 30) + [(900, None, "en"), (901, "too short", "en")]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(parts)
    stored = nd.stamped(frame)
    got = nd.counted(stored, nd.bucket_count(stored)).toArrow()
    found = {}
    for name, df in zip(nd.unpack(got["shingle"], got["bucket"]).tolist(), nd.numbers(got["df"]).tolist()):
        assert found.setdefault(name, df) == df
    want = Counter(s for bag in bags([r[1] for r in rows]) for s in bag)
    assert sorted(found.values()) == sorted(want.values()) and len(got["bucket"].unique()) > 5


def test_common_passages_weigh_less(spark):
    """A passage in a twentieth of all documents does not link texts that are otherwise different."""
    pick = random.Random(12)

    def words(n):
        return ["".join(pick.choices("abcdefghij", k=8)) for _ in range(n)]

    passage = words(200)
    rows = [(i, " ".join((passage if i % 20 == 0 else words(200)) + words(20)), "en") for i in range(400)]
    rows.append((400, rows[1][1] + " end", "en"))
    got = {r.key: r.class_id for r in nd.classes(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: 1 if i == 400 else i for i in range(401)}


def test_texts_and_shuffles_do_not_stay(spark):
    """Neither stored copies of the texts nor shuffle files are left once the classes are found."""
    from frondlake.session import SHUFFLE_CLEANUP, checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def shuffles():
        return {f for place in places for _, _, names in os.walk(place.getPath()) for f in names if f.startswith("shuffle_")}

    frame = spark.createDataFrame(corpus(13, 30, 5), COLUMNS)
    held, before = set(os.listdir(folder)), shuffles()
    found = nd.classes(frame)
    with_text = [d for d in set(os.listdir(folder)) - held
                 if {"text", "shingle", "df"} & set(spark.read.parquet(f"file:{folder}/{d}").columns)
                 and "short" not in spark.read.parquet(f"file:{folder}/{d}").columns]
    assert with_text == []
    until = time.time() + 20
    while shuffles() - before and time.time() < until:  # removed by the executors in their own time
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"
    assert found.count() == frame.count()
