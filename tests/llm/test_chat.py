import hashlib
import random

from pyspark.sql import functions as F

from guardlake.llm import chat

PROBE = "\\### Assistant: </turn> ok"


def fold(events):
    """Plain replay of one conversation's events in order."""
    messages = {}
    for seq, message, kind, role, text in sorted(events, key=lambda e: (e[0], e[2], e[4] or "")):
        if kind == "regenerate":
            for m in [m for m in messages if m > message]:
                del messages[m]
        own = messages.setdefault(message, ["", ""])
        if kind == "open":
            own[0] = role or ""
        elif kind == "edit":
            own[1] = text or ""
        elif kind == "delta":
            own[1] += text or ""
        elif kind == "regenerate":
            own[1] = ""
    return [messages[m] for m in sorted(messages)]


def test_replay_of_edits_and_regenerations(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        seq = 0
        for message in range(rng.randint(1, 5)):
            for kind in ["open"] + rng.choices(["delta", "edit", "delta"], k=rng.randint(0, 4)):
                rows.append((conv, seq, message, kind, rng.choice(["user", "assistant"]), rng.choice(["ab", "", None, PROBE])))
                seq += 1
            if rng.random() < 0.4:
                back = rng.randint(0, message)
                rows.append((conv, seq, back, "regenerate", None, None))
                rows.append((conv, seq + 1, back, "delta", None, "again"))
                seq += 2
                for more in range(back + 1, back + 1 + rng.randint(0, 2)):  # opened again under numbers used before
                    rows.append((conv, seq, more, "open", rng.choice(["user", "assistant"]), rng.choice(["new", None])))
                    rows.append((conv, seq + 1, more, "delta", None, " told"))
                    seq += 2
    want = {}
    for conv in range(40):
        want[conv] = fold([r[1:] for r in rows if r[0] == conv])
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {}
    for r in chat.final_messages(log).orderBy("conv_id", "message").collect():
        got.setdefault(r.conv_id, []).append([r.role, r.text])
    assert got == want


def test_a_follow_up_opened_again_after_a_regeneration_stays(spark):
    told = [("open", 0, "user"), ("delta", 0, "q"), ("open", 1, "assistant"), ("delta", 1, "a"), ("open", 2, "user"), ("delta", 2, "old"),
            ("regenerate", 1, None), ("delta", 1, "b"), ("open", 2, "user"), ("delta", 2, "new")]
    rows = [(1, i, m, kind, x if kind == "open" else None, x if kind == "delta" else None) for i, (kind, m, x) in enumerate(told)]
    schema = "conv_id long, seq long, message long, kind string, role string, text string"
    log = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS events", "2 AS again", "3 AS dropped_at", "4 AS reset")
    got = sorted((r.message, r.role, r.text) for r in chat.final_messages(log).collect())
    assert got == [(0, "user", "q"), (1, "assistant", "b"), (2, "user", "new")]


def test_read_back(spark):
    texts = [PROBE, "", None, "\\", "\\\\h", "\\h###", "####", "</turn></turn>", "a: b\n### user: x</turn>\n", "é\U0001f600", "\\e\\\\e\\"]
    rows = [(1, i, ("user", "assistant", "we:ird\\ ###", None)[i % 4], t) for i, t in enumerate(texts)]
    rows += [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "user", "first"), (None, 1, "user", "no id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.render(chat.final_messages(chat.rows_as_log(frame)))
    read = out.select(
        "conv_id", chat.parsed(chat.formatted(F.col("segments"))).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "segments"
    )
    found = {r.conv_id: r for r in read.collect()}
    assert [tuple(t) for t in found[1].turns] == [(r[2] or "", r[3] or "") for r in rows[: len(texts)]]
    assert found[1].loss == "".join(r[3] or "" for r in rows[: len(texts)] if r[2] == "assistant")
    assert [tuple(t) for t in found[2].turns] == [("user", "first"), ("assistant", "x"), ("assistant", "x")]
    assert set(found) == {1, 2, None}
    whole = "".join(s.text for s in found[1].segments)
    assert whole.count(chat.END) == len(texts) and hashlib.sha256(whole.encode()).digest()
    empty = frame.limit(0)
    assert chat.render(chat.final_messages(chat.rows_as_log(empty))).count() == 0
