"""Spelling variants against a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from frondlake.llm import spelling
from frondlake.llm.queries import QUERIES

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or a[i + 1:] == b[i + 1:]


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(spelling.RUNS, text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_groups(counts):
    form, out = {}, []
    masks = {}
    for word in counts:  # words within one edit share a word with one character less, or one of them is it
        for i in range(len(word)):
            masks.setdefault(word[:i] + word[i + 1:], set()).add(word)
    close = {w: {o for i in range(len(w)) for o in masks[w[:i] + w[i + 1:]]} | masks.get(w, set())
             | ({w[:i] + w[i + 1:] for i in range(len(w))} & set(counts)) for w in counts}
    close = {w: {o for o in others if one_edit(w, o)} for w, others in close.items()}
    for word, n in counts.items():
        best = min(close[word], key=lambda o: (-counts[o], o), default=None)
        form[word] = best if best is not None and counts[best] >= 10 * n else None
    for word, n in counts.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.append((word, form[word], root, n, len(close[word]), counts[form[word]] if form[word] else None))
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_pivots_are_disjoint_and_cheapest():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abcd", k=rng.randint(7, 12)))
        shared = {g: rng.randint(1, 9) for g in map("".join, product("abcd", repeat=2))}
        places, _ = spelling.prefix(word, shared)
        chosen = spelling.pivots(word, places, shared)
        cost = [shared[word[i:i + 2]] for i in chosen]
        assert len(chosen) == 2 and chosen[1] - chosen[0] >= 2 and set(chosen) <= set(places)
        assert sum(cost) == min(shared[word[i:i + 2]] + shared[word[j:j + 2]] for i in places for j in places if j - i >= 2)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcÀÿ", "xyzäöüß×÷"])
def test_pairs_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    counts = {"".join(rng.choices(alphabet, k=rng.randint(7, 12))): 3 ** rng.randint(1, 9) for _ in range(300)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.groups(frame)) == brute_groups(counts)


def test_chains_and_ties(spark):
    """Forms lead over several steps; equal counts go to the first word in code-point order."""
    word, counts = "abcdefghij", {}
    for step in range(12):
        counts[word[:step] + "z" * step + word[step:]] = 10 ** (12 - step) * 5
    counts |= {"mnopqrsta": 2, "mnopqrstÿ": 900, "mnopqrstz": 900, "repeated" * 40: 2, "repeated" * 40 + "s": 70}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling.groups(frame))
    assert got == brute_groups(counts)
    assert {r[0]: r[1] for r in got}["mnopqrsta"] == "mnopqrstz"
    assert max(sum(a == r[2] for r in got) for a in counts) >= 2


def test_odd_rows(spark):
    long = "Straßenbahn " * 20_000 + "straßenbah straßenbah x" + "y" * 2_000
    rows = [(1, None), (None, "Neighbour neighbour neighboürs"), (2, ""), (3, "a b c 123 _!"), (4, long), (4, long), (5, "NEIGHBOURİneighbours")]
    names = ("key", "run", "word", "n", "gram", "at", "a", "b", "form", "root", "best", "x")
    frame = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in names])
    assert found(spelling.variants(frame)) == brute_groups(brute_words(rows))
    assert found(spelling.variants(frame.limit(0))) == []


def test_hot_gram(spark):
    """Thousands of words share their rare bigrams; meetings stay in proportion to the words."""
    words = [f"{a}{b}{c}qzqzqz{a}{c}" for a in "abcdefghijklmn" for b in "abcdefghijklmn" for c in "abcdefghijklmn"]
    counts = {w: 2 + i % 50 for i, w in enumerate(words)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(spelling.groups(frame)) == brute_groups(counts)


def test_words_of_one_end_and_length_are_not_all_compared(spark):
    """The rare bigram stands at the same end of all words: their meetings stay in proportion to them."""
    rng = random.Random(8)
    counts = {"qzj" + "".join(rng.choices("abcdefgh", k=9)): 2 + i for i in range(3000)}
    counts |= {w[:i] + "x" + w[i + 1:]: 40 * n for w, n in list(counts.items())[:200] for i in (rng.randrange(12),)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    shared = spark.createDataFrame(list(Counter(g for w in counts for g in set(spelling.grams(w))).items()), "gram string, words long")
    stored = spelling.described(frame, shared).persist()
    met = spelling.asked_entries(stored).join(spelling.held_entries(stored), F.expr("meet = met"))
    assert met.count() < 100 * len(counts)
    stored.unpersist()
    assert found(spelling.groups(frame)) == brute_groups(counts)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op13_spelling_variants"](spark, folder)) == brute_groups(brute_words(rows))
