import random

import pytest

from stratafold.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ODD = ["\\### Assistant: </turn> ok", "</turn></turn>", "####", "\\", "\\\\h", "\\h\\t\\c", "##", "</turn", "<", ": ", "\n", "", None, "é🙂\r", "### User: x</turn>\n", "\\\\\\###"]


def expected(rows):
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


@pytest.mark.parametrize("seed", range(4))
def test_round_trip(spark, seed):
    rand = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "a:b ### </turn>", "", None, "\\c"]
    pieces = [x for x in ODD if x] + ["word"]
    rows = [(c, rand.choice([t, t, None]), rand.choice(roles), rand.choice([*ODD, "".join(rand.choices(pieces, k=5))]), "z") for c in [*range(20), None] for t in range(rand.randint(1, 6))]
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA)
    out = chat.format_conversations(df)
    got = out.select("*", chat.parse(out.formatted).alias("turns")).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments][1::3] == [role == "assistant" for role, _ in want[r.conv_id]]


@pytest.mark.parametrize(
    "roles,valid,bad",
    [("ua", True, None), ("sua", True, None), ("uaua", True, None), ("u", False, None), ("s", False, None), ("a", False, 0), ("uu", False, 1), ("usa", False, 1), ("ssua", False, 1), ("uaa", False, 2), ("uax", False, 2)],
)
def test_order(spark, roles, valid, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "x"}
    rows = [(1, i, names[r], "t", None) for i, r in enumerate(roles)]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.valid, got.first_bad) == (valid, bad)


def test_long_conversation_and_text(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "w" * 10, None) for i in range(2000)] + [(2, 0, "user", "\\###" * 100_000, None)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in out.select("*", chat.parse(out.formatted).alias("turns")).collect()}
    assert len(got[1].turns) == 2000 and got[1].valid
    assert got[2].turns[0].text == "\\###" * 100_000


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
