"""The Merkle manifest against digests of whole strings, and its odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from frondlake.llm import merkle
from frondlake.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(row):
    text = row[4]
    if row[0] is None or zlib.crc32(str(row[0]).encode()) % 5:
        return None
    return leaf_of((*row[:4], None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))


def climb(level, at, digest, run):
    """All levels of one tree: the root, the siblings met, and the root with ``digest`` at the place."""
    siblings = []
    while len(level) > 1:
        first = at // run * run
        others = level[first:at] + level[at + 1:first + run]
        siblings += others
        digest = sha("".join(level[first:at]) + digest + "".join(level[at + 1:first + run]))
        level = [sha("".join(level[i:i + run])) for i in range(0, len(level), run)]
        at //= run
    return level[0], siblings, digest


def brute(rows, changed, run):
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    roots = [climb([leaf_of(r) for r in trees[n]], 0, "", run)[0] for n in names]
    out = []
    for k, name in enumerate(names):
        leaves = [leaf_of(r) for r in trees[name]]
        for at, row in enumerate(trees[name]):
            subroot, below, folded = climb(leaves, at, changed(row) or leaves[at], run)
            root, above, folded = climb(roots, k, folded, run)
            out.append((row[0], leaves[at], subroot, root, sha("".join(below + above)), folded, folded == root))
    return out


def key(row):
    return tuple((v is not None, v) for v in row)


def verified(spark, rows, changed, run, height, frame=None):
    known = {leaf_of(r): changed(r) for r in rows}
    found = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    own = merkle.leaf([F.col(c) for c in merkle.FIELDS])
    docs = spark.createDataFrame(rows, SCHEMA) if frame is None else frame
    result = merkle.verify(docs, found[own], run=run, height=height)
    return sorted((tuple(r) for r in result.collect()), key=key)


def test_compression_equals_the_standard():
    raw = np.frombuffer(bytes(random.Random(1).randbytes(32 * 40)), np.uint8).reshape(40, 32)
    state = merkle.start(40)
    for blocks in range(1, 4):
        state = merkle.absorb(state, merkle.words(raw))
        got = [bytes(d).hex() for d in merkle.finish(state, np.full(40, blocks))]
        assert got == [sha(bytes(r).hex() * blocks) for r in raw]


@pytest.mark.parametrize("run,height", [(2, 2), (3, 1), (16, 3)])
def test_equals_plain_digests(spark, run, height):
    rng = random.Random(run)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "a", "a", "é", "Z", "", None]), rng.choice(["en", None]), 3,
             rng.choice([None, "", "Ab", "ÄB c"])) for _ in range(70)] + [(5, "alone", None, None, "X" * 300_000)]
    assert verified(spark, rows, lowered, run, height) == sorted(brute(rows, lowered, run), key=key)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_border_sizes(spark, n):
    rows = [(i, None, "en", i, f"Text {i}") for i in range(n)]
    assert verified(spark, rows, lowered, 16, 1) == sorted(brute(rows, lowered, 16), key=key)


def test_every_leaf_matters(spark):
    """Whatever single row changes, no changed row is verified and every other one is."""
    rows = [(i, "ab"[i % 2], "en", i, f"Text {i}") for i in range(37)]
    got = verified(spark, rows, lambda r: "0" * 64 if r[0] % 3 == 0 else None, 4, 2)
    assert [(r[0], r[-1]) for r in got] == [(i, i % 3 != 0) for i in range(37)]


def test_midstates_are_kept_before_each_slot(spark):
    rows = [(f"{i:064x}",) for i in range(21)]
    leaves = spark.createDataFrame(rows, "h string").selectExpr("'' AS tree", "h AS key", "unhex(h) AS digest")
    manifest = merkle.build(leaves, ["key"])
    for node in manifest.passes[0].where("level = 1").collect():
        kids = [node.children[i:i + 32] for i in range(0, len(node.children), 32)]
        assert len(node.states) == len(node.children)
        for slot in range(len(kids)):
            state = merkle.to_state(np.frombuffer(node.states[32 * slot:32 * slot + 32], np.uint8)[None])
            for child in kids[slot:]:
                state = merkle.absorb(state, merkle.words(np.frombuffer(child, np.uint8)[None]))
            assert bytes(merkle.finish(state, np.array([len(kids)]))[0]) == bytes(node.digest)


def test_empty_table(spark):
    assert verified(spark, [], lowered, 16, 3) == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "s", None, None, None)] * 40 + [(None, "s", "x", 1, "y")] * 3
    names = ("tree", "key", "digest", "changed", "at", "n", "part", "tie", "sums", "rows", "total", "_part", "_group",
             "_rows", "_total", "found", "block", "path", "subroot", "level", "top", "row", "leaf", "root")
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(n) for n in names])
    assert verified(spark, rows, lowered, 16, 3, frame) == sorted(brute(rows, lowered, 16), key=key)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*SCHEMA.split()[::2]).collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, folder).collect()), key=key)
    assert got == sorted(brute(rows, lowered, 16), key=key)
