"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Encoding. A sequence of tokens is the BPE encoding of its bytes exactly if each
pair of neighbours is: merges inside different tokens do not influence each
other, so the first merge across a border would show up in the pair alone.
The encodings of all prefixes of a piece are therefore the paths of a
nondeterministic transducer whose states are *(last token, bytes read of the
next token)*, and exactly one path ends at every byte. ``Transducer`` builds
the subset construction of it on demand: a state holds the paths still alive,
a transition yields the token with which the one complete path ends. Reading
these endings backwards gives the tokens; in long pieces they are emitted up to
the last border that all living paths share, so the look-ahead is bounded by
the longest tokens. The cost is linear in the bytes, for a piece of any length.

Decoding. Token bytes pass through ``Utf8Stream``, a state machine over UTF-8
that keeps at most three bytes of an unfinished character between chunks.

Rows: null text counts as empty and gives no ids; null ids decode to an empty
text. Repeated rows are encoded row by row. Other columns pass unchanged; the
added column replaces one of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import output_schema, replace_column, slices, tidy

MAX_STATES = 100_000
LOOK_AHEAD = 256
MAX_PIECES = 250_000
MAX_PIECE_CHARS = 32
DECODE_CHUNK = 4096
SLICE_BYTES = 1 << 20


class State(dict):
    """Transitions of one set of paths: byte to (token that ends there, next state)."""

    __slots__ = ("paths",)


class Transducer:
    """Encoder of single pieces. Its caches are emptied when full, which changes no result."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.max_states = max_states
        # A trie of the tokens: node 0 is the root, children are keyed by (node, byte).
        self.children: dict[int, int] = {}
        self.tokens: list[int | None] = [None]
        self.inner, self.depth = bytearray(1), [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = 1
                below = self.children.get(node << 8 | byte)
                if below is None:
                    below = self.children[node << 8 | byte] = len(self.tokens)
                    self.tokens.append(None)
                    self.inner.append(0)
                    self.depth.append(self.depth[node] + 1)
                node = below
            self.tokens[node] = rank
        self.states: dict[tuple, State] = {}
        self.allowed: dict[int, bool] = {}  # pairs of tokens as one number
        # The last merge that makes each token: its two parts, or itself for a byte and for a token that merges never make.
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():  # states refer to each other: this frees them without the garbage collector
            state.clear()
        self.states = {}
        self.root = self._state(((None, 0),))

    def _state(self, paths: tuple) -> State:
        state = self.states.get(paths)
        if state is None:
            state = self.states[paths] = State()
            state.paths = paths
        return state

    def _merge(self, data: bytes, below: int = 1 << 60) -> list[bytes]:
        """Plain BPE of a few bytes by ranks under ``below``; only used to decide about single tokens."""
        parts = [data[i:i + 1] for i in range(len(data))]
        none, rank_of = 1 << 60, self.ranks.get
        ranks = [rank_of(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank >= below:
                break
            at = ranks.index(rank)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], none)
        return parts

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, itself twice for a byte; None if merges make something else."""
        data = self.token_bytes[token]
        if len(data) == 1:
            parts = token, token
        else:
            last = self._merge(data, token)  # merges of lower rank only
            whole = len(last) == 2 and self._merge(data) == [data]
            parts = (self.ranks[last[0]], self.ranks[last[1]]) if whole else None
        self.halves[token] = parts
        return parts

    def _may_follow(self, last: int | None, token: int) -> bool:
        """Whether the merges of both tokens side by side give these two: no merge across the border comes first.

        The tokens are taken apart in the reverse order of their merges; a pair across the border that
        merges before the merge just undone (ties: from the left) would have come first.
        """
        halves = self.halves
        right = halves[token] if token in halves else self._parts(token)
        if last is None:
            answer = self.allowed[-1 - token] = right is not None
            return answer
        left = halves[last] if last in halves else self._parts(last)
        answer = left is not None and right is not None
        if answer:
            a, b, limit, names, rank_of = last, token, 1 << 60, self.token_bytes, self.ranks.get
            while True:
                rank = rank_of(names[a] + names[b])
                if rank is not None and rank < limit:
                    answer = False
                    break
                # Undo the later of the two last merges; of equal ones the right.
                down_a, down_b = halves[a] if a in halves else self._parts(a), halves[b] if b in halves else self._parts(b)
                rank_a, rank_b = -1 if down_a[0] == a else a, -1 if down_b[0] == b else b
                if rank_a < 0 and rank_b < 0:
                    break
                if rank_a > rank_b:
                    limit, a = rank_a, down_a[1]
                else:
                    limit, b = rank_b + 1, down_b[0]
        self.allowed[last << 20 | token] = answer
        return answer

    def _step(self, state: State, byte: int) -> tuple[int, State]:
        """The token that ends at this byte in the one complete path, and the paths alive after it."""
        if len(self.states) > self.max_states:
            self._reset()
        if len(self.allowed) > 2 * self.max_states:
            self.allowed.clear()
        children, tokens, inner, allowed = self.children, self.tokens, self.inner, self.allowed
        paths, ending = [], None
        for last, node in state.paths:
            node = children.get(node << 8 | byte)
            if node is not None:
                token = tokens[node]
                if token is not None and ending is None:
                    fits = allowed.get(-1 - token if last is None else last << 20 | token)
                    if self._may_follow(last, token) if fits is None else fits:
                        ending = token
                if inner[node]:
                    paths.append((last, node))
        paths.append((ending, 0))
        state[byte] = ending, self._state(tuple(paths))
        return state[byte]

    def encode(self, piece: bytes) -> list[int]:
        """Emit tokens as soon as every path alive has them, at the latest after ``LOOK_AHEAD`` more bytes."""
        if len(piece) <= 2 * LOOK_AHEAD:
            return self._back(self._endings(self.root, piece)[0], len(piece), 0)
        ids: list[int] = []
        state, endings, base = self.root, [], 0
        for at in range(0, len(piece), LOOK_AHEAD):
            more, state = self._endings(state, piece[at:at + LOOK_AHEAD])
            endings += more
            seen = at + len(more)
            # Paths alive begin at these borders; what lies before their common border is decided.
            borders = {seen - self.depth[node] for _, node in state.paths}
            while len(borders) > 1:
                latest = max(borders)
                borders.remove(latest)
                borders.add(latest - self.sizes[endings[latest - 1 - base]])
            border = borders.pop()
            if border > base:
                ids += self._back(endings, border, base)
                endings, base = endings[border - base:], border
        return ids + self._back(endings, len(piece), base)

    def _endings(self, state: State, data: bytes) -> tuple[list[int], State]:
        """For every byte the last token of the encoding that ends there."""
        endings = []
        for byte in data:
            hit = state.get(byte)
            token, state = hit if hit is not None else self._step(state, byte)
            endings.append(token)
        return endings, state

    def _back(self, endings: list[int], end: int, base: int) -> list[int]:
        ids, sizes = [], self.sizes
        while end > base:
            token = endings[end - 1 - base]
            ids.append(token)
            end -= sizes[token]
        ids.reverse()
        return ids
class Utf8Stream:
    """Decodes UTF-8 that arrives in chunks; malformed bytes become U+FFFD as in ``bytes.decode``."""

    def __init__(self):
        self.rest = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Length of the incomplete character at the end (0 to 3)."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte < 0x80:
                return 0
            if byte >= 0xC0:  # a lead byte: is what follows a proper prefix of a character?
                need = 2 if 0xC2 <= byte <= 0xDF else 3 if 0xE0 <= byte <= 0xEF else 4 if 0xF0 <= byte <= 0xF4 else 0
                if back >= need:
                    return 0
                if back >= 2:
                    low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                    high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                    if not low <= data[1 - back] <= high:
                        return 0
                return back
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.rest + chunk
        keep = self._unfinished(data)
        self.rest = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        data, self.rest = self.rest, b""
        return data.decode("utf-8", "replace")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for the standard library, which is faster; equal on texts without ``SPECIAL`` characters."""
    written = (pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]")
               .replace(r"\p{N}", r"\d"))
    return None if r"\p" in written else re.compile(written)


# Characters whose class differs between the two libraries, or may differ between their versions.
SPECIAL = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


class Codec:
    """Splits texts by a pattern, encodes each match, decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split, self.plain_split = regex.compile(pattern), plain_pattern(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.earlier: dict[str, tuple[int, ...]] = {}  # the previous generation of known pieces

    def forget(self) -> None:
        """Empty all caches: workers outlive their tasks, and other stages need the memory."""
        self.known, self.earlier = {}, {}
        self.transducer.allowed.clear()
        self.transducer._reset()
        tidy()

    def encode(self, text: str) -> list[int]:
        known, transducer = self.known, self.transducer
        ids: list[int] = []
        split = self.plain_split if self.plain_split and not SPECIAL.search(text) else self.split
        pieces = split.findall(text) if len(text) < 1 << 20 else (m.group() for m in split.finditer(text))
        for piece in pieces:
            found = known.get(piece)
            if found is None:
                found = self.earlier.get(piece)
                if found is None:
                    found = transducer.encode(piece.encode("utf-8", "replace"))
                if len(piece) <= MAX_PIECE_CHARS:  # short pieces repeat
                    if len(known) >= MAX_PIECES:
                        self.earlier, self.known = known, {}
                        known = self.known
                    known[piece] = found = tuple(found)
            ids += found
        return ids

    def decode_stream(self, ids: list[int]) -> Iterator[str]:
        token = self.transducer.token_bytes.__getitem__
        stream = Utf8Stream()
        for at in range(0, len(ids), DECODE_CHUNK):
            yield stream.feed(b"".join(map(token, ids[at:at + DECODE_CHUNK])))
        yield stream.finish()

    def decode(self, ids: list[int]) -> str:
        return "".join(self.decode_stream(ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a worker process: ranks and trie stay, caches are emptied after each task."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids",
           check: bool = False) -> DataFrame:
    """Add ``ids``: the tokens of ``text``. The rank file at ``path`` must be installed on the workers.

    With ``check`` the ids are decoded again at once, and a text that does not come back is an error.
    """
    schema = output_schema(docs, {ids: T.ArrayType(T.IntegerType())})

    def run(batches):
        own = codec(path, pattern)
        gc.disable()  # its passes over all cached states take a quarter of the time; nothing here needs them
        try:
            for batch in batches:
                for low, high in slices(batch.column(text), SLICE_BYTES):  # the ids of few texts at a time
                    part, found = batch.slice(low, high - low), []
                    for value in part.column(text):
                        whole = value.as_py() or ""
                        ids_of = own.encode(whole)
                        if check and own.decode(ids_of) != whole:
                            raise ValueError("a text is not the decoding of its tokens")
                        found.append(array("i", ids_of))
                    flat = np.concatenate([np.frombuffer(f, np.int32) for f in found]) if found else np.zeros(0, np.int32)
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    yield replace_column(part, {ids: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})
        finally:
            gc.enable()
            own.forget()

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add ``text``: the decoded ``ids``."""
    schema = output_schema(tokens, {text: T.StringType()})

    def run(batches):
        own = codec(path, pattern)
        try:
            for batch in batches:
                values = pa.array([own.decode(i or ()) for i in batch.column(ids).to_pylist()], pa.string())
                yield replace_column(batch, {text: values})
        finally:
            own.forget()

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, digest, schema: T.StructType,
               text: str = "text") -> DataFrame:
    """Encode and decode in one pass; add ``digest(ids, decoded)`` per row instead of the ids.

    ``digest`` returns the values of ``schema``'s fields. Nothing but the
    digests leaves the worker.
    """
    kept = docs.drop(text)
    full = output_schema(kept, {f.name: f.dataType for f in schema})

    def run(batches):
        own = codec(path, pattern)
        gc.disable()  # its passes over all cached states take a quarter of the time; nothing here needs them
        try:
            for batch in batches:
                rows = []
                for value in batch.column(text):  # one text at a time: its ids are the largest object
                    ids = own.encode(value.as_py() or "")
                    rows.append(digest(ids, own.decode(ids)))
                found = {f.name: pa.array([r[i] for r in rows], arrow_type(f)) for i, f in enumerate(schema)}
                yield replace_column(batch.drop_columns([text]), found)
        finally:
            gc.enable()
            own.forget()

    return docs.mapInArrow(run, full)


def arrow_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)
