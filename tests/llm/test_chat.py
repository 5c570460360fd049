import hashlib
import math

import numpy as np
import pytest
from oracle import same

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def esc(t):
    return "".join("\\" + c if c in "<[]\\" else c for c in t or "")


def brute(rows, budget, history):
    """{conv_id: (turns, loss text, windows' texts)}."""
    none_first = lambda x: (x is not None, x if x is not None else 0)
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (none_first(r[0]), (r[1] is not None, (r[1] or "").encode()), (r[2] is not None, hashlib.md5((r[2] or "").encode()).hexdigest())))
        system = turns[0][1] == "system"
        size = [math.ceil(len(t or "") / 4) + 4 for _, _, t in turns]
        lead, windows = size[0] if system else 0, []
        for i in range(len(turns)):
            own = 0 if system and i == 0 else size[i]
            if i % chat.PART == 0 or used and used + own > budget - lead - (budget // 4 if windows[-1][0] else 0):
                windows.append([])
                used = 0
            windows[-1].append(i)
            used += own
        texts = []
        for own in windows:
            again, mine = [], sum(size[i] for i in own if not (system and i == 0))
            for i in range(own[0] - 1, max(own[0] - 1 - history, -1 + system), -1):
                if sum(size[i : own[0]]) > min(budget // 4, budget - lead - mine):
                    break
                again.insert(0, i)
            if system and own[0]:
                again.insert(0, 0)
            # the budget holds, but for a turn that is too large for it
            assert lead * system + mine + sum(size[i] for i in again if not (system and i == 0)) <= budget or len([i for i in own if not (system and i == 0)]) <= 1 and (not again or again == [0] and system)
            texts.append("".join(f"<s>[{'HIST' if i in again else 'INST'}:{esc(turns[i][1])}]{esc(turns[i][2])}[/INST]</s>" for i in again + own))
        out[conv] = ("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns), "".join(t or "" for _, r, t in turns if r == "assistant"), texts, len(turns))
    return out


def check(spark, rows, budget, history=2):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", window int, formatted string")
    made = chat.windows(df, budget, history)
    want = brute(rows, budget, history)
    got = {}
    for r in made.collect():
        got.setdefault(r.conv_id, []).append((r.window, r.formatted))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    back = {r.conv_id: (r.turns, r.loss_text, r.n_turns, r.formatted_chars) for r in chat.read_back(made).collect()}
    assert back == {k: (t, loss, n, sum(map(len, w))) for k, (t, loss, w, n) in want.items()}


ODD = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "", None, "a\nb\n", "$1 \\1", "é\U0001f600<", "[/INST]</s><s>[INST:user]x[/INST]</s>", "x" * 5000, "<" * 4000]


def test_odd_texts(spark):
    rows = [(1, i, ("system", "user", "assistant")[min(i, 1) + i % 2], t) for i, t in enumerate(ODD)]
    rows += [(2, i, "assistant", t) for i, t in enumerate(ODD)] + [(3, 0, "system", "only")] + [(None, None, None, None), (None, 1, "assistant", "of null"), (4, None, "user", "first"), (4, None, "user", "first"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, 0, "system]", "b"), (5, -3, "us<er", "q"), (5, 2, "assistant", "w")]
    for budget in (20, 300, 10**6):
        check(spark, rows, budget)


def test_long_conversation(spark):
    rng = np.random.default_rng(10)
    rows = [(9, i, "system" if i == 0 else ("user", "assistant")[i % 2], "w" * int(rng.integers(0, 200))) for i in range(1500)]
    check(spark, rows, 256, 3)


@pytest.mark.parametrize("turn", [lambda i: 5, lambda i: None, lambda i: i * 10**12])
def test_hot_conversation(spark, turn):
    """Turns that are equal, null, or far apart."""
    rng = np.random.default_rng(11)
    rows = [(9, turn(i), ("user", "assistant")[i % 2], f"{i} " + "w" * int(rng.integers(0, 300))) for i in range(900)] + [(8, 0, "user", "q"), (8, 1, "assistant", "a")]
    check(spark, rows, 256, 2)


def test_windows_keep_the_budget(spark):
    """By the windows' own text."""
    rng = np.random.default_rng(12)
    rows = [(c, i, "system" if i == 0 and c % 2 else ("user", "assistant")[i % 2], "w" * int(rng.choice([10, 200, 900, 3000]))) for c in range(20) for i in range(40)]
    for r in chat.windows(spark.createDataFrame(rows, SCHEMA), 512).select("formatted", chat.parsed().alias("t")).collect():
        total = sum(math.ceil(len(t.text) / 4) + 4 for t in r.t)
        home = [t for t in r.t if not t.repeated and t.role != "system"]
        assert total <= 512 or len(home) == 1 and len([t for t in r.t if t.role != "system"]) == 1


def test_empty(spark):
    assert chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA))).collect() == []


@pytest.mark.parametrize("name", ["op5_chat_windows", "op8_warc_from_arc"])
def test_sql(spark, name):
    same(spark, name)
