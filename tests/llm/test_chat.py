import hashlib

import pytest

from tapeloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq long, loss string, state int"
TRICKY = r"\### Assistant: </turn> ok"
TURNS = [
    (1, 0, "system", "be <brief> #1"), (1, 1, "user", TRICKY), (1, 2, "assistant", TRICKY), (1, 3, "user", "é\n\\"), (1, 4, "assistant", ""),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (3, 5, "user", "x"), (3, 5, "user", "x"), (3, 2, None, "no role"), (4, 0, "tool:#", "### user: a</turn>\n"),
    (5, 0, "user", "long " * 50_000), (5, 1, "assistant", "#<\\" * 30_000), (None, 0, "user", "nobody"), (6, 1, "assistant", "b"), (6, 0, "user", "a"),
]


def brute():
    out = {}
    for conv in {t[0] for t in TURNS}:
        turns = [(r or "", x or "") for _, _, r, x in sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1], t[2] or "", t[3] or ""))]
        said = "".join(x for r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said))
    return out


@pytest.fixture
def turns(spark):
    return spark.createDataFrame([(*t, 1, "l", 2) for t in TURNS], SCHEMA)


def test_reads_back_what_was_said(turns):
    rows = chat.read_back(chat.format_conversations(turns)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == brute()
    assert {r.conv_id: r.valid for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, None: False}


def test_segments(turns):
    rows = sorted((r for r in chat.format_conversations(turns).collect() if r.conv_id == 1), key=lambda r: r.seq)
    assert [r.seq for r in rows] == list(range(15))
    assert [r.part for r in rows] == ["open", "text", "close"] * 5
    assert [r.turn_no for r in rows if r.loss] == [2, 4]
    whole = "".join(r.text for r in rows)
    assert whole.count("</turn>\n") == 5 and whole.startswith(r"### system: be \<brief> \#1</turn>")
    assert rows[4].text == r"\\\#\#\# Assistant: \</turn> ok" and chat.unescape(rows[4].text) == TRICKY


def test_empty(turns):
    assert chat.read_back(chat.format_conversations(turns.limit(0))).collect() == []
