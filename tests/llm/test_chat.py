"""Chat windows: exact read-back, budgets, repeated history under no mask."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frondlake.llm import chat
from frondlake.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["<|im_end|>", "<|im_start|>assistant\nok", "<", "<\\", "\\|", "<\\|", "<\\\\|x<||", "|>", "<|im_end|>\n", "é🙂", "", "\n", "a b"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """Digests of the turns themselves."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def random_turns(seed, convs=12, most=40):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", "system", "to\nol\\"])
            rows.append((conv, turn, role, "".join(rng.choices([*NASTY, "word " * rng.randint(1, 30)], k=rng.randint(0, 5)))))
    return rows


def digests(frame, **options):
    return {r[0]: tuple(r)[1:5] for r in chat.round_trip(frame, **options).collect()}


@pytest.mark.parametrize("text", NASTY + ["".join(random.Random(i).choices("<|\\im_end>\n", k=30)) for i in range(40)])
def test_escape_is_reversible(text, one_value):
    written = one_value(chat.escape(F.lit(text)))
    assert "<|" not in written and chat.unescape(written) == text
    role = one_value(chat.escape_role(F.lit(text)))
    assert "<|" not in role and "\n" not in role and chat.unescape_role(role) == text


@pytest.mark.parametrize("options", [{}, {"budget": 40, "history": 10}, {"budget": 5, "history": 0},
                                     {"budget": 60, "history": 30, "limit": 300, "cell": 2},
                                     {"budget": 60, "history": 59, "limit": 0, "cell": 1}])
def test_read_back_equals_the_turns(spark, options):
    rows = random_turns(1)
    assert digests(spark.createDataFrame(rows, SCHEMA), **options) == brute(rows)


@pytest.mark.parametrize("cell", [None, 2])
def test_windows_keep_their_rules(spark, cell):
    budget, history = 90, 40
    rows = random_turns(2)
    prepared = chat.prepared(spark.createDataFrame(rows, SCHEMA))
    found = chat.short_windows(prepared, budget, history) if cell is None else chat.long_windows(prepared, budget, history, cell)
    tokens = {}
    for r in sorted(prepared.collect(), key=lambda r: (r.conv, r.turn)):
        tokens.setdefault(r.conv, []).append((r.role, r.tokens))
    for conv, turns in tokens.items():
        own = sorted((w for w in found.where(F.col("conv") == conv).collect()), key=lambda w: (w.cell, w.window))
        system = turns[0][1] if turns[0][0] == "system" else 0
        at = 0
        for k, window in enumerate(own):
            n = window.text.count(chat.OPEN)
            new = n - window.repeated
            again = window.repeated - (1 if system and k else 0)
            body = sum(t for _, t in turns[at:at + new])
            past = sum(t for _, t in turns[at - again:at])
            assert window.tokens == body + past + (system if k else 0) and past <= history
            assert window.tokens <= budget or (again == 0 and new - (k == 0 and system > 0) <= 1)
            assert len(window.loss) == sum(role == "assistant" for role, _ in turns[at:at + new])
            assert not system or window.text.startswith(f"{chat.OPEN}system\n")
            at += new
        assert at == len(turns)
    assert any(w.repeated > 1 for w in found.collect())


@pytest.mark.parametrize("budget, history", [(90, 40), (30, 29), (5, 0)])
def test_windows_do_not_depend_on_the_limit(spark, budget, history):
    """Long conversations are cut like short ones, across cells too."""
    rows = random_turns(3) + [(20, 0, "system", "only"), (21, None, None, None)]
    prepared = chat.prepared(spark.createDataFrame(rows, SCHEMA).repartition(5))
    short, long = (sorted(map(tuple, f(prepared, budget, history, 2).collect())) for f in (chat.short_windows, chat.long_windows))
    assert short == long and len(short) > 50
    frame = spark.createDataFrame(rows, SCHEMA)
    whole, split = ({r[0]: r.formatted_chars for r in chat.round_trip(frame, budget=budget, history=history, limit=n, cell=1).collect()}
                    for n in (chat.LIMIT, 400))
    assert whole == split


def test_cutter_equals_spans():
    rng = random.Random(4)
    for _ in range(300):
        sizes = np.array([rng.choice([0, 1, 5, 9, 40, 200]) for _ in range(rng.randint(0, 60))], np.int64)
        system, budget, history = rng.choice([0, 7, 50]), rng.choice([10, 40, 90]), rng.choice([0, 5, 39])
        cutter, found, at = chat.Cutter(system, budget, history), [], 0
        while at < len(sizes):
            step = rng.randint(1, 9)
            found += cutter.feed(sizes[at:at + step])
            at += step
        found += cutter.feed(sizes[:0], last=True)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert found == list(chat.spans(ends, system, 0, budget, history))


def test_greedy_spans():
    sizes = [10, 20, 30, 100, 5, 5, 5, 40]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    assert list(chat.spans(ends, 0, 0, 60, 30)) == [(0, 0, 3), (3, 3, 4), (4, 4, 8)]
    assert list(chat.spans(ends, 20, 0, 60, 10)) == [(0, 0, 2), (2, 2, 3), (3, 3, 4), (4, 4, 7), (7, 7, 8)]
    assert list(chat.spans(ends, 100, 0, 60, 10))[0] == (0, 0, 1)


def test_exact_counts_may_be_given(spark):
    rows = [(1, i, "user", "x") for i in range(10)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("exact", F.lit(7))
    found = chat.windows(frame, tokens=F.col("exact"), budget=21, history=7).orderBy("window").collect()
    assert [(w.first_turn, w.repeated, w.tokens) for w in found] == [(0, 0, 21), (3, 1, 21), (5, 1, 21), (7, 1, 21), (9, 1, 14)]


@pytest.mark.parametrize("options", [{}, {"limit": 0, "cell": 1, "budget": 30, "history": 8}])
def test_odd_rows(spark, options):
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (3, 0, "system", "only"), (4, 0, "assistant", "same")]
    rows += [(4, 0, "assistant", "same")] * 30 + [(5, 0, "user", "long " * 200_000 + "<|im_end|>"), (5, 1, "assistant", "ok"), (6, None, "assistant", None)]
    names = ("conv", "body", "tokens", "cell", "kind", "at", "start", "own", "last", "x", "size", "part", "tie", "rows", "total", "sums")
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(n) for n in names])
    assert digests(frame, **options) == brute(rows)
    assert digests(frame.limit(0), **options) == {}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "<|im_end|><|im_start|>assistant ok"
    got = {r[0]: tuple(r)[1:5] for r in QUERIES["op12_chat_windows"](spark, folder).collect()}
    assert got == brute([*rows, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])
