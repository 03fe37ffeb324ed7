"""Merkle manifest of a dataset: a tree of SHA-256 digests that keeps midstates.

A leaf is the digest of a row's fields. Every ``RUN`` consecutive nodes become
their parent: the digest of the children's digests, written as hexadecimal text.
That text is exactly one SHA-256 block, so the hash state before each child slot
is a chaining value of 32 bytes. A parent keeps these copied states (``states``)
and its children's digests (``children``). Folding a changed leaf up the tree
resumes, in each parent, the state kept for its slot, absorbs the replacement and
the siblings to the right, and never touches the siblings to the left.

Each group of rows (``tree``) has a tree of its own over its rows by ascending key;
the roots of the groups, by ascending name (null first, UTF-8 bytes), are the leaves
of the top tree.

On the cluster: rows get their place by ``ordered.ranked`` (a hot group spreads over
partitions), then blocks of ``RUN ** HEIGHT`` consecutive nodes are built together,
one pass for ``HEIGHT`` levels. Downwards each block receives the path from its root
to the top and hands it on; the last pass folds all rows of a block at once. A block
has at most 4,096 rows of some 100 bytes; texts are hashed where they are read and
never move. Nodes and paths are stored tables of ``cut_lineage``.

Rows: a null field counts as ``-`` and a null group is a group of its own, the
first. Rows of equal key are ordered by their leaf; repeated rows are leaves of
their own with equal digests, so their order does not matter. Very long texts are
single values of the digest function. An empty table has no root and gives an
empty result. Only the named columns are read; others are ignored and cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import ranked

RUN = 16
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _roots(primes: list[int], power: int) -> np.ndarray:
    """The first 32 bits of the fractional parts of square (2) or cube roots (3) of primes, as the standard defines its constants."""
    found = []
    for prime in primes:
        goal, root = prime << 32 * power, 1 << 40
        while root ** power > goal:  # Newton's method on integers
            root = ((power - 1) * root + goal // root ** (power - 1)) // power
        found.append(root & 0xFFFFFFFF)
    return np.array(found, np.uint32)


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, int(n ** 0.5) + 1))]
START = _roots(_PRIMES[:8], 2)
ROUND = _roots(_PRIMES, 3)
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 compression of one block for many hashes at once: (8, n) states, (16, n) words."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7]
                     + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def words(raw: np.ndarray) -> np.ndarray:
    """Digests (n, 32) as the words (16, n) of their hexadecimal text."""
    text = np.empty((len(raw), 64), np.uint8)
    text[:, 0::2], text[:, 1::2] = HEX[raw >> 4], HEX[raw & 15]
    return text.view(">u4").astype(np.uint32).T


def to_bytes(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T.astype(">u4")).view(np.uint8)


def to_state(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32).T


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of messages of so many whole blocks."""
    last = np.zeros((16, state.shape[1]), np.uint32)
    last[0] = 0x80000000
    last[14], last[15] = blocks.astype(np.uint64) >> np.uint64(23), blocks << 9
    return to_bytes(absorb(state, last))


def levels(n: int, run: int = RUN) -> int:
    """Levels of parents above ``n`` nodes."""
    count = 0
    while n > 1:
        n, count = -(-n // run), count + 1
    return count


def parents(children: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (n, 32) digests: parents' digests, kept states and children (m, run, 32), number of children."""
    m = -(-len(children) // run)
    held = np.zeros((m, run, 32), np.uint8)
    held.reshape(-1, 32)[:len(children)] = children
    counts = np.full(m, run)
    counts[-1] = len(children) - run * (m - 1)
    states, state = np.zeros((m, run, 32), np.uint8), start(m)
    for slot in range(int(counts.max())):
        here = counts > slot
        states[here, slot] = to_bytes(state[:, here])
        state[:, here] = absorb(state[:, here], words(held[here, slot]))
    return finish(state, counts), states, held, counts


def fold(current: np.ndarray, state: np.ndarray, right: np.ndarray, rights: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One level: resume the states before the slots, absorb replacements and right siblings only."""
    state = absorb(to_state(state), words(current))
    for step in range(int(rights.max(initial=0))):
        here = rights > step
        state[:, here] = absorb(state[:, here], words(right[here, step]))
    return finish(state, counts)


NODE = "tree string, block long, level int, at long, top boolean, n long, digest binary, states binary, children binary"
PATH = "array<struct<state: binary, left: binary, right: binary>>"


def _matrix(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, 32)


def _grow(run: int, height: int):
    """Kernel: one block of nodes to its inner nodes of up to ``height`` levels."""
    def kernel(block: pa.Table) -> pa.Table:
        order = np.argsort(block["at"].to_numpy())
        n, tree, number = block["n"][0].as_py(), block["tree"][0].as_py(), block["block"][0].as_py()
        digests, at = _matrix(block["digest"], len(order))[order], number * run ** height
        rows = []
        rise = min(height, levels(n, run))
        for level in range(1, rise + 1):
            digests, states, held, counts = parents(digests, run)
            n, at = -(-n // run), at // run
            for i, k in enumerate(counts):
                rows.append((tree, number, level, at + i, level == rise, n, digests[i].tobytes(),
                             states[i, :k].tobytes(), held[i, :k].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _NODE_TYPES)], _NODE_NAMES)

    return kernel


_NODE_NAMES = [f.split()[0] for f in NODE.split(", ")]
_NODE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_PATH_TYPE = pa.list_(pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())]))


class Block:
    """Inner nodes of a block, and the path from its root to the top of everything."""

    def __init__(self, nodes: pa.Table, run: int):
        self.run, self.by_level = run, {}
        rows = nodes.to_pylist()
        for row in rows:
            self.by_level.setdefault(row["level"], []).append(row)
        for level in self.by_level.values():
            level.sort(key=lambda r: r["at"])
        self.height = max(self.by_level, default=0)
        self.path = next(r["path"] or [] for r in rows if r["top"])
        self.subroot = next(r["subroot"] for r in rows if r["top"])

    def steps(self, at: int) -> list[dict]:
        """The path of the node at this place below the block, from its parent to the top."""
        steps = []
        for level in range(1, self.height + 1):
            nodes = self.by_level[level]
            slot, at = at % self.run, at // self.run
            node = nodes[at - nodes[0]["at"]]
            steps.append({"state": node["states"][32 * slot:32 * slot + 32], "left": node["children"][:32 * slot],
                          "right": node["children"][32 * slot + 32:]})
        return steps + self.path


def _descend(run: int):
    """Kernel: the path of every node right below a block."""
    def kernel(nodes: pa.Table) -> pa.Table:
        block = Block(nodes, run)
        tree = nodes["tree"][0].as_py()
        rows = []
        for node in block.by_level[1]:
            first = node["at"] * run
            for at in range(first, first + len(node["children"]) // 32):
                rows.append((tree, at, block.steps(at), block.subroot))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), _PATH_TYPE, pa.binary()))],
                        ["tree", "at", "path", "subroot"])

    return kernel


def _fold_path(current: np.ndarray, path: list[dict]) -> np.ndarray:
    """Fold digests that all stand in the same slot, along one path."""
    n = len(current)
    for step in path:
        right = np.frombuffer(step["right"], np.uint8).reshape(1, -1, 32)
        k = len(step["left"]) // 32 + 1 + right.shape[1]
        state = np.repeat(np.frombuffer(step["state"], np.uint8)[None], n, axis=0)
        current = fold(current, state, np.repeat(right, n, axis=0), np.full(n, right.shape[1]), np.full(n, k))
    return current


def _fold_block(run: int):
    """Kernel: all rows of a block; proof digests, and roots from the changed leaves."""
    def kernel(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        n = len(leaves)
        current, at = _matrix(leaves["changed"], n), leaves["at"].to_numpy()
        block = Block(nodes, run)
        proofs = [hashlib.sha256() for _ in range(n)]
        for level in range(1, block.height + 1):
            own = block.by_level[level]
            counts = np.array([len(r["children"]) // 32 for r in own])
            states, held = (np.zeros((len(own), run, 32), np.uint8) for _ in range(2))
            for i, node in enumerate(own):
                states[i, :counts[i]] = np.frombuffer(node["states"], np.uint8).reshape(-1, 32)
                held[i, :counts[i]] = np.frombuffer(node["children"], np.uint8).reshape(-1, 32)
            texts = [r["children"].hex().encode() for r in own]
            slot, at = at % run, at // run
            parent = at - own[0]["at"]
            for proof, p, s in zip(proofs, parent.tolist(), slot.tolist()):
                proof.update(texts[p][:64 * s])
                proof.update(texts[p][64 * s + 64:])
            rights = counts[parent] - slot - 1
            reach = np.minimum(slot[:, None] + 1 + np.arange(run - 1), run - 1)
            current = fold(current, states[parent, slot], held[parent[:, None], reach], rights, counts[parent])
        above = b"".join((step["left"] + step["right"]).hex().encode() for step in block.path)
        for proof in proofs:
            proof.update(above)
        kinds, back = np.unique(current, axis=0, return_inverse=True)  # unchanged rows have met in one digest
        tops = [r.tobytes().hex() for r in _fold_path(kinds, block.path)]
        subroot = block.subroot.hex()
        return pa.table({"key": leaves["key"], "leaf": [d.hex() for d in leaves["digest"].to_pylist()],
                         "subroot": [subroot] * n, "proof": [p.hexdigest() for p in proofs],
                         "folded": [tops[i] for i in back.reshape(-1)]})

    return kernel


@dataclass(frozen=True)
class Manifest:
    """Ranked leaves, the stored inner nodes of each pass, and the root.

    ``leaves``: tree, at, n, key, digest, changed. ``passes[p]``: the nodes (``NODE``) above the nodes of pass p.
    """

    leaves: DataFrame
    passes: tuple[DataFrame, ...]
    roots: DataFrame  # tree, digest: one row a tree
    run: int
    height: int


def leaf(columns: list[Column]) -> Column:
    """Digest of fields in hexadecimal: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
              for c in columns]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def build(leaves: DataFrame, order: list[str], run: int = RUN, height: int = HEIGHT) -> Manifest:
    """Trees over rows of ``tree`` (not null), ``digest`` (binary) and the columns they are ordered by."""
    placed = cut_lineage(ranked(leaves, "tree", [*order, "digest"]))
    counts = cut_lineage(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    placed = placed.join(counts, "tree")
    most = counts.agg(F.max("n")).first()[0] or 0
    base = placed.select("tree", "at", "n", "digest")
    passes, roots = [], base.where("n = 1").select("tree", "digest")
    span = run ** height
    while most > 1:
        grouped = base.where("n > 1").withColumn("block", F.floor(F.col("at") / span).cast("long"))
        nodes = cut_lineage(grouped.groupBy("tree", "block").applyInArrow(_grow(run, height), NODE))
        passes.append(nodes)
        base = nodes.where("top").select("tree", "at", "n", "digest")
        roots = roots.unionByName(base.where("n = 1").select("tree", "digest"))
        most = -(-most // span)
    return Manifest(placed, tuple(passes), cut_lineage(roots), run, height)


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Attach to the top node of each block the path from there; ``paths``: tree, at, path, subroot."""
    keyed = paths.select(F.col("tree").alias("_tree"), F.col("at").alias("_at"), "path", "subroot")
    fits = F.col("top") & (F.col("tree") == F.col("_tree")) & (F.col("at") == F.col("_at"))
    return nodes.join(keyed, fits, "left").drop("_tree", "_at")


def paths_down(manifest: Manifest, top: DataFrame, last: int = 0) -> DataFrame:
    """From the path of each root (tree, at = 0, path, subroot) to those of the nodes that pass ``last`` built.

    The result has the paths of all block roots of pass ``last``, trees without inner nodes included.
    """
    found = top
    for level in range(len(manifest.passes) - 1, last, -1):
        nodes = _with_paths(manifest.passes[level], found)
        below = nodes.groupBy("tree", "block").applyInArrow(
            _descend(manifest.run), f"tree string, at long, path {PATH}, subroot binary")
        ended = manifest.passes[level].select("tree").distinct()
        found = cut_lineage(found.join(ended, "tree", "left_anti").unionByName(below))
    return found


def fold_all(manifest: Manifest, top: DataFrame) -> DataFrame:
    """Per leaf: key, leaf, subroot, proof (digest of all siblings up to the top), folded (the root with ``changed`` in its place)."""
    paths = paths_down(manifest, top)
    leaves = manifest.leaves.withColumn("block", F.floor(F.col("at") / manifest.run ** manifest.height).cast("long"))
    schema = f"key {leaves.schema['key'].dataType.simpleString()}, leaf string, subroot string, proof string, folded string"
    single = leaves.where("n = 1").join(paths, ["tree", "at"]).groupBy("tree").applyInArrow(_fold_single, schema)
    if not manifest.passes:
        return single
    nodes = _with_paths(manifest.passes[0], paths)
    several = leaves.where("n > 1").select("tree", "block", "at", "key", "digest", "changed").groupBy("tree", "block").cogroup(
        nodes.groupBy("tree", "block")).applyInArrow(_fold_block(manifest.run), schema)
    return several.unionByName(single)


def _fold_single(leaves: pa.Table) -> pa.Table:
    """The only leaf of its tree: it is the subroot itself."""
    row = leaves.to_pylist()[0]
    path = row["path"] or []
    folded = _fold_path(np.frombuffer(row["changed"], np.uint8)[None], path)
    above = b"".join((s["left"] + s["right"]).hex().encode() for s in path)
    return pa.table({"key": leaves["key"], "leaf": [row["digest"].hex()], "subroot": [row["subroot"].hex()],
                     "proof": [hashlib.sha256(above).hexdigest()], "folded": [folded[0].tobytes().hex()]})


def verify(docs: DataFrame, changed: Column, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
           run: int = RUN, height: int = HEIGHT) -> DataFrame:
    """Build the manifest of ``docs`` and check every row against it with ``changed`` as the leaf that is found now.

    ``changed`` is a hexadecimal leaf digest or null for an untouched row. Returns the key and ``leaf``, ``subroot``,
    ``root``, ``proof_sha256``, ``folded_root``, ``verified``.
    """
    tree = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("tree")  # null before all others
    own = leaf([F.col(c) for c in fields])
    rows = docs.select(tree, F.col(key).alias("key"), F.unhex(own).alias("digest"), F.unhex(changed).alias("found"))
    leaves = rows.select("tree", "key", "digest", F.coalesce("found", "digest").alias("changed"))
    manifest = build(leaves, ["key"], run, height)
    upper = build(manifest.roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"], run, height)
    root = upper.roots.first()
    summit = upper.roots.select("tree", F.lit(0).cast("long").alias("at"), F.lit(None).cast(PATH).alias("path"),
                                F.col("digest").alias("subroot"))
    down = _leaf_paths(upper, summit).join(upper.leaves.select("at", "key", "digest"), "at")
    top = cut_lineage(down.select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("at"), "path",
                                  F.col("digest").alias("subroot")))
    whole = F.lit(root["digest"].hex() if root else None)
    return fold_all(manifest, top).select(
        F.col("key").alias(key), "leaf", "subroot", whole.alias("root"), F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == whole).alias("verified"))


def _leaf_paths(manifest: Manifest, top: DataFrame) -> DataFrame:
    """The paths of the leaves themselves (used for the tree of trees)."""
    found = paths_down(manifest, top)
    if not manifest.passes:
        return found.select("at", "path")
    nodes = _with_paths(manifest.passes[0], found)
    return nodes.groupBy("tree", "block").applyInArrow(
        _descend(manifest.run), f"tree string, at long, path {PATH}, subroot binary").select("at", "path")


def sql(run: int = RUN) -> str:
    """DuckDB SQL for the rows of the query over ``documents``: plain digests of whole child lists, no kept states."""
    def fields(text: str) -> str:
        return " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in
                           (text if f == "text" else f for f in FIELDS))

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT), lambda c, b: {bits}), 4294967295)"
    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('g' || source, '') AS tree, sha256({fields("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({fields(lowered)}) END AS found
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM rows),
nodes(tree, level, place, n, digest) AS (
  SELECT tree, 0, place, n, leaf FROM ranked
  UNION ALL
  SELECT tree, level + 1, place // {run}, (any_value(n) + {run - 1}) // {run}, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // {run}),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, place, n, digest) AS (
  SELECT 0, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // {run}, (any_value(n) + {run - 1}) // {run}, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY level, place // {run}),
families AS (SELECT tree, level, place // {run} AS parent, list(digest ORDER BY place) AS members FROM nodes WHERE n > 1 GROUP BY ALL),
top_families AS (SELECT level, place // {run} AS parent, list(digest ORDER BY place) AS members FROM tops WHERE n > 1 GROUP BY ALL),
walk(tree, start, level, place, n, digest, proof) AS (
  SELECT tree, place, 0, place, n, coalesce(found, leaf), '' FROM ranked
  UNION ALL
  SELECT w.tree, w.start, w.level + 1, w.place // {run}, (w.n + {run - 1}) // {run},
    sha256(array_to_string(members[:w.place % {run}] || [w.digest] || members[w.place % {run} + 2:], '')),
    w.proof || array_to_string(members[:w.place % {run}] || members[w.place % {run} + 2:], '')
  FROM walk w JOIN families f ON f.tree = w.tree AND f.level = w.level AND f.parent = w.place // {run} WHERE w.n > 1),
climb(tree, start, level, place, n, digest, proof) AS (
  SELECT w.tree, w.start, 0, s.place, s.n, w.digest, w.proof FROM walk w JOIN subroots s ON s.tree = w.tree WHERE w.n = 1
  UNION ALL
  SELECT w.tree, w.start, w.level + 1, w.place // {run}, (w.n + {run - 1}) // {run},
    sha256(array_to_string(members[:w.place % {run}] || [w.digest] || members[w.place % {run} + 2:], '')),
    w.proof || array_to_string(members[:w.place % {run}] || members[w.place % {run} + 2:], '')
  FROM climb w JOIN top_families f ON f.level = w.level AND f.parent = w.place // {run} WHERE w.n > 1)
SELECT r.doc_id, r.leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root,
  c.digest = t.digest AS verified
FROM ranked r JOIN subroots s ON s.tree = r.tree JOIN climb c ON c.tree = r.tree AND c.start = r.place AND c.n = 1
JOIN (SELECT digest FROM tops WHERE n = 1) t ON true"""
