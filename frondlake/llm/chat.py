r"""Chat formatting in budgeted windows.

A turn is written ``<|im_start|>role\ntext<|im_end|>\n``. ``<|`` never occurs inside: between ``<``
and ``|`` one backslash more is written than the text has there, which reading takes away
again. Roles also write ``\`` and line feeds as ``\\`` and ``\n``.

Prefix sums of the turns' tokens choose turn-aligned spans: a window takes the turns that
fit ``budget`` together with the system turn (the first turn if its role is ``system``) and up to
``history`` tokens of the turns before, which it repeats. Each turn is new in one window;
only assistant texts of new turns are under the loss mask. A turn over the budget has a window
of its own, with the system turn, and is not cut; history gives way before a turn does.

On the cluster: one rule cuts all conversations, whatever their size. Those of at most ``LIMIT`` bytes,
by a count beforehand, meet in one shuffle by conversation and are windowed as they stream by.
Longer ones are placed over range partitions (``ordered.ranked``); only the tokens of their
turns pass one after another through ``Cutter``, which holds a window and its history and names the
windows of each turn. Turns then meet in cells of ``CELL`` windows, so no task gathers a
conversation. Both ways give the same windows. Reading back hashes a conversation as a whole: its cells pass
one after another through one task, a few rows each, and nothing is kept but the hash states.

Rows: null text and null role count as empty; a null conversation is one of its own. Turns go by
``turn`` (null first), then role, then text; repeated rows are turns of their own. An empty
table gives no windows. Very long texts stay whole. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import ranked

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET = 1024
HISTORY = 256
CELL = 256
LIMIT = 4 << 20
PIECES = r"[A-Za-z]{1,5}|[0-9]{1,3}|[^A-Za-z0-9\x09-\x0D ]"
MARKS = 4  # two control strings and two line feeds

WINDOW = ("conv string, cell long, window int, first_turn long, repeated int, tokens long, text string, "
          "loss array<struct<start: int, end: int>>")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def turn_tokens(role: Column, text: Column) -> Column:
    """Estimated tokens of a turn as written: letter runs by five, digits by three, every other character one."""
    return (F.regexp_count(role, F.lit(PIECES)) + F.regexp_count(text, F.lit(PIECES)) + MARKS).cast("long")


def spans(ends: np.ndarray, system: int, first: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """``(oldest repeated, first new, end)`` of each window; ``ends``: prefix sums from 0 of turns behind the system turn."""
    i, n = first, len(ends) - 1
    while i < n:
        oldest = int(np.searchsorted(ends, ends[i] - history))
        j = max(i + 1, int(np.searchsorted(ends, ends[oldest] + budget - system, "right")) - 1)
        yield min(i, max(oldest, int(np.searchsorted(ends, ends[j] - (budget - system))))), i, j
        i = j


class Cutter:
    """``spans`` of turns that come in pieces, in order; holds no more than a window and its history."""

    def __init__(self, system: int, budget: int, history: int):
        self.rule, self.history = (budget, history), history
        self.system, self.base, self.first, self.ends = system, 0, 0, np.zeros(1, np.int64)

    def feed(self, tokens: np.ndarray, last: bool = False) -> Iterator[tuple[int, int, int]]:
        """The spans that further turns cannot change; all that are left with the ``last`` piece."""
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(tokens, dtype=np.int64)])
        for oldest, new, end in spans(self.ends, self.system, self.first - self.base, *self.rule):
            if end == len(self.ends) - 1 and not last:
                break
            yield self.base + oldest, self.base + new, self.base + end
            self.first = self.base + end
        done = int(np.searchsorted(self.ends, self.ends[self.first - self.base] - self.history))
        self.base, self.ends = self.base + done, self.ends[done:]


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows that follow each other with equal values of the names."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][n] != row[n] for n in names):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _written(row: dict) -> tuple[str, int]:
    """A turn and where its text begins in it."""
    head = f"{OPEN}{row['role']}\n"
    return f"{head}{row['body']}{CLOSE}\n", len(head)


def _window(conv: str, number: int, cell: int, first: int, system: dict | None, again: list[dict], new: list[dict]) -> tuple:
    """A window of the system turn, repeated turns and new ones, of which ``first`` is the place of the first."""
    text, at, loss = [], 0, []
    for i, row in enumerate(([system] if system else []) + again + new):
        whole, skip = _written(row)
        if row["role"] == "assistant" and i >= len(again) + (1 if system else 0):
            loss.append({"start": at + skip, "end": at + len(whole) - len(CLOSE) - 1})
        text.append(whole)
        at += len(whole)
    repeated = len(again) + (1 if system and number else 0)
    tokens = sum(r["tokens"] for r in again + new) + (system["tokens"] if system else 0)
    return conv, number // cell, number, first, repeated, tokens, "".join(text), loss


def _windows_of(rows: list[dict], budget: int, history: int, cell: int) -> Iterator[tuple]:
    """Windows of a whole conversation."""
    system = rows[0] if rows[0]["role"] == "system" else None
    turns = rows[1:] if system else rows
    ends = np.concatenate([[0], np.cumsum([r["tokens"] for r in turns], dtype=np.int64)])
    for number, (oldest, new, end) in enumerate(list(spans(ends, system["tokens"] if system else 0, 0, budget, history)) or [(0, 0, 0)]):
        yield _window(rows[0]["conv"], number, cell, new, system, turns[oldest:new], turns[new:end])


def _windows_in(rows: list[dict], cell: int) -> Iterator[tuple]:
    """Windows of a cell, whose rows are [system turn,] then window by window repeated turns and new ones."""
    system = rows[0] if rows[0]["kind"] == 0 else None
    held: dict[int, tuple[list, list]] = {rows[0]["window"]: ([], [])}
    for row in rows[1:] if system else rows:
        held.setdefault(row["window"], ([], []))[row["kind"] - 1].append(row)
    for number, (again, new) in held.items():
        first = new[0]["at"] - (1 if system else 0) if new else 0
        yield _window(rows[0]["conv"], number, cell, first, system, again, new)


MARK = "conv string, at long, cell long, window long, kind int"


def _marks(budget: int, history: int, cell: int):
    """From the tokens of all turns, in order, to the windows that hold each: repeated (kind 1) or new (2).

    The system turn (0) comes once a cell.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, cutter, lead, number = None, None, 0, 0

        def marked(spans_found):
            nonlocal number
            rows = []
            for oldest, new, end in spans_found:
                if lead and number % cell == 0:
                    rows.append((conv, 0, number // cell, number, 0))
                rows += [(conv, turn + lead, number // cell, number, 1 if turn < new else 2) for turn in range(oldest, end)]
                number += 1
            return rows

        def ended():
            rows = marked(cutter.feed(np.zeros(0, np.int64), last=True))
            return rows if number else marked([(0, 0, 0)])

        def read():
            nonlocal conv, cutter, lead, number
            for batch in batches:
                names, tokens = batch.column("conv").to_pylist(), batch.column("tokens").to_numpy()
                starts = [i for i, name in enumerate(names) if (name != names[i - 1] if i else True)]
                for low, high in zip(starts, starts[1:] + [len(names)]):
                    if cutter is None or names[low] != conv:
                        if cutter is not None:
                            yield from ended()
                        lead = int(batch.column("leads")[low].as_py())
                        conv, number, cutter = names[low], 0, Cutter(int(tokens[low]) if lead else 0, budget, history)
                        low += lead
                    yield from marked(cutter.feed(tokens[low:high]))
            if cutter is not None:
                yield from ended()

        return _batched(read(), _MARK_TYPES, _MARK_NAMES, lambda row: 40)

    return run


_MARK_NAMES = [f.split()[0] for f in MARK.split(", ")]
_MARK_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]


_WINDOW_NAMES = ["conv", "cell", "window", "first_turn", "repeated", "tokens", "text", "loss"]
_WINDOW_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]


def _batched(rows: Iterator[tuple], types: list, names: list[str], weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= 5_000 or size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def prepared(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             tokens: Column | None = None) -> DataFrame:
    """``conv`` (never null), turn, role and body as written, tokens. ``tokens`` may give exact counts of a vocabulary."""
    body, name = escape(F.coalesce(F.col(text), F.lit(""))), escape_role(F.coalesce(F.col(role), F.lit("")))
    own = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    rows = turns.select(own.alias("conv"), F.col(turn).alias("turn"), name.alias("role"), body.alias("body"),
                        *([] if tokens is None else [tokens.cast("long").alias("tokens")]))
    return rows if tokens is not None else rows.withColumn("tokens", turn_tokens(F.col("role"), F.col("body")))


def split_by_size(rows: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows of conversations of at most ``limit`` bytes, and the others; results do not depend on the limit."""
    size = F.sum(F.octet_length("body") + F.octet_length("role") + len(OPEN + CLOSE) + 2)
    long = cut_lineage(rows.groupBy("conv").agg(size.alias("size")).where(F.col("size") > limit).select("conv"))
    return rows.join(long, "conv", "left_anti"), rows.join(long, "conv", "left_semi")


def short_windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, cell: int = CELL) -> DataFrame:
    """Windows of conversations that fit a task, one conversation's in order after another's."""
    def run(batches):
        found = (w for own in _groups(batches, ("conv",)) for w in _windows_of(own, budget, history, cell))
        return _batched(found, _WINDOW_TYPES, _WINDOW_NAMES, lambda w: len(w[6]))

    laid = rows.select("conv", "turn", "role", "body", "tokens").repartition("conv")
    return laid.sortWithinPartitions("conv", "turn", "role", "body").mapInArrow(run, WINDOW)


def long_windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, cell: int = CELL) -> DataFrame:
    """The same windows of conversations of any length, a cell's in order after another's."""
    def run(batches):
        found = (w for own in _groups(batches, ("conv", "cell")) for w in _windows_in(own, cell))
        return _batched(found, _WINDOW_TYPES, _WINDOW_NAMES, lambda w: len(w[6]))

    placed = ranked(rows, "conv", ["turn", "role", "body"])
    leads = ((F.col("at") == 0) & (F.col("role") == "system")).alias("leads")
    turns = placed.select("conv", "at", "tokens", leads).repartition("conv").sortWithinPartitions("conv", "at")
    marks = turns.mapInArrow(_marks(budget, history, cell), MARK)
    laid = placed.select("conv", "at", "role", "body", "tokens").join(marks, ["conv", "at"]).repartition("conv", "cell")
    return laid.sortWithinPartitions("conv", "cell", "window", "at").mapInArrow(run, WINDOW)


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            tokens: Column | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """All windows: ``conv`` (``=`` and the id), cell, window, first_turn (behind the system turn), repeated, tokens, text, loss."""
    short, long = split_by_size(prepared(turns, conv, turn, role, text, tokens))
    return short_windows(short, budget, history).unionByName(long_windows(long, budget, history))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read windows back: one row a cell with its turns and all text under the mask."""
    def read() -> Iterator[tuple]:
        for rows in _groups(batches, ("conv", "cell")):
            turns, loss, n, chars = [], [], 0, 0
            for row in rows:
                written = row["text"].split(CLOSE + "\n")
                for part in written[row["repeated"]:-1]:
                    role, body = part.removeprefix(OPEN).split("\n", 1)
                    turns.append(f"{unescape_role(role)}\n{unescape(body)}\n")
                    n += 1
                loss += [unescape(row["text"][s["start"]:s["end"]]) for s in row["loss"]]
                chars += len(row["text"])
            yield rows[0]["conv"], rows[0]["cell"], n, chars, "".join(turns), "".join(loss)

    return _batched(read(), _PIECE_TYPES, _PIECE_NAMES, lambda r: len(r[4]) + len(r[5]))


PIECE = "conv string, cell long, n_turns long, chars long, turns string, loss string"
_PIECE_NAMES = [f.split()[0] for f in PIECE.split(", ")]
_PIECE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells in order to one row a conversation."""
    def hashed() -> Iterator[tuple]:
        conv, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv"] != conv:
                    if state is not None:
                        yield conv, *_ended(state)
                    conv, state = row["conv"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += row["n_turns"]
                state[1].update(row["turns"].encode())
                state[2] += len(row["loss"])
                state[3].update(row["loss"].encode())
                state[4] += row["chars"]
        if state is not None:
            yield conv, *_ended(state)

    return _batched(hashed(), _DIGEST_TYPES, _DIGEST_NAMES, lambda r: 1)


def _ended(state: list) -> tuple:
    return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


DIGEST = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST_NAMES = [f.split()[0] for f in DIGEST.split(", ")]
_DIGEST_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def read_back(found: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation what its windows say. ``in_order``: all windows of a conversation follow each other already."""
    if in_order:
        return found.mapInArrow(_pieces, PIECE).mapInArrow(_digests, DIGEST)
    cells = found.repartition("conv", "cell").sortWithinPartitions("conv", "cell", "window").mapInArrow(_pieces, PIECE)
    return cells.repartition("conv").sortWithinPartitions("conv", "cell").mapInArrow(_digests, DIGEST)


def round_trip(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               tokens: Column | None = None, budget: int = BUDGET, history: int = HISTORY, limit: int = LIMIT,
               cell: int = CELL) -> DataFrame:
    """Format and read back: the conversation and the columns of ``DIGEST``."""
    short, long = split_by_size(prepared(turns, conv, turn, role, text, tokens), limit)
    cells = long_windows(long, budget, history, cell).mapInArrow(_pieces, PIECE)
    both = read_back(short_windows(short, budget, history, cell), in_order=True).unionByName(
        cells.repartition("conv").sortWithinPartitions("conv", "cell").mapInArrow(_digests, DIGEST))
    kind = turns.schema[conv].dataType
    own = F.when(F.col("conv") != "", F.substr("conv", F.lit(2))).cast(kind)
    return both.select(own.alias(conv), *_DIGEST_NAMES[1:])


def sql(budget: int = BUDGET, history: int = HISTORY) -> str:
    """DuckDB SQL for the rows of the query: digests of the table's own texts, windows by a recursion over prefix sums."""
    def pieces(text: str) -> str:
        return f"len(regexp_extract_all({text}, '{PIECES}'))"

    def escaped(text: str) -> str:
        return rf"regexp_replace({text}, '<(\\*)\|', '<\\\1|', 'g')"

    return rf"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, {escaped("text")} AS body, replace(replace({escaped("role")}, '\', '\\'), chr(10), '\n') AS name,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns),
counted AS (
  SELECT *, {pieces("name")} + {pieces("body")} + {MARKS} AS tokens, length(name) + length(body) + {len(OPEN + CLOSE) + 2} AS chars,
    k = 1 AND role = 'system' AS leads FROM written),
lists AS (
  SELECT conv_id, coalesce(sum(tokens) FILTER (leads), 0)::BIGINT AS st, coalesce(sum(chars) FILTER (leads), 0)::BIGINT AS sc,
    coalesce(list(tokens::BIGINT ORDER BY k) FILTER (NOT leads), []) AS ts, coalesce(list(chars::BIGINT ORDER BY k) FILTER (NOT leads), []) AS cs
  FROM counted GROUP BY conv_id),
sums AS (
  SELECT conv_id, st, sc, len(ts) AS n, list_transform(range(len(ts) + 1), lambda i: coalesce(list_sum(ts[:i]), 0)::BIGINT) AS p,
    list_transform(range(len(cs) + 1), lambda i: coalesce(list_sum(cs[:i]), 0)::BIGINT) AS c FROM lists),
spans(conv_id, i, chars) AS (
  SELECT conv_id, 0::BIGINT, CASE WHEN n = 0 THEN sc ELSE 0 END FROM sums
  UNION ALL
  SELECT conv_id, j, sc + c[j + 1] - c[least(i, greatest(oldest, len(list_filter(p, lambda x: x < p[j + 1] - ({budget} - st))))) + 1]
  FROM (SELECT *, greatest(i + 1, len(list_filter(p, lambda x: x <= p[oldest + 1] + {budget} - st)) - 1) AS j
    FROM (SELECT s.*, w.i, len(list_filter(s.p, lambda x: x < s.p[w.i + 1] - {history})) AS oldest
      FROM spans w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i < s.n))),
formatted AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM spans GROUP BY conv_id),
digests AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM counted GROUP BY conv_id)
SELECT d.*, f.formatted_chars FROM digests d JOIN formatted f ON f.conv_id IS NOT DISTINCT FROM d.conv_id"""
