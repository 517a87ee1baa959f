"""Chat windows: exact round trip, loss once, budget and history."""

import hashlib
import random

from pyspark.sql import functions as F

from tracehound.llm import chat


def conversations():
    rng = random.Random(4)
    bits = ["plain words", "\\", "#", "<", "### user:\n", "</turn>\n", "\\s", "\\h\\l", "é漢\U0001f600", "\n", ":", "\\### Assistant: </turn> ok"]
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 7, 60])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "tool:\nx", None])
            text = rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.choice([3, 30, 200])))])
            rows.append((c, t, role, text))
    rows += [(50, t, "assistant" if t % 2 else "user", f"turn {t} " * 3) for t in range(900)]
    return rows + [(60, 1, "user", "tie b"), (60, 1, "user", "tie a"), (60, None, "assistant", "no turn"), (None, 0, "assistant", "no conversation")]


def test_round_trip_and_loss(spark):
    rows = conversations()
    data = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(4)
    got = {r.conv_id: r for r in chat.chat_report(data).collect()}
    rows = rows + [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


def test_windows(spark):
    data = spark.createDataFrame([(1, 0, "system", "be kind")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"text number {t} " * 4) for t in range(1, 60)], "conv_id long, turn long, role string, text string")
    rows = chat.format_windows(data, budget=300, history=60).withColumn("turns", chat.parse_turns(F.col("formatted"))).orderBy("window").collect()
    assert len(rows) > 5
    for k, r in enumerate(rows):
        assert sum(-(-len((t.role + t.text).encode()) // 3) + 6 for t in r.turns) <= 300
        assert r.turns[0].role == "system" and (k == 0 or r.context >= 2)
        seen = [r.formatted[m.start : m.start + m.length] for m in r.mask]
        assert seen == [t.text for t in r.turns[r.context :] if t.role == "assistant"]
    assert [t.text for r in rows for t in r.turns[r.context :]] == ["be kind"] + [f"text number {t} " * 4 for t in range(1, 60)]


def test_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_windows(empty).count() == 0 and [r.conv_id for r in chat.chat_report(empty).collect()] == [-7]
