import random

from pyspark.sql import functions as F

from guardlake.operators import sessions


def test_history_equals_brute_force_with_hot_conversation(spark):
    rng = random.Random(8)
    rows = []
    for conv, n in ((1, 200), (2, 3), (3, 12), (None, 5)):
        turns = sorted(rng.sample(range(10**9), n))
        rows += [(conv, t, "user", f"{conv}-{t}") for t in turns]
    df = spark.createDataFrame(rows, "conv bigint, turn bigint, role string, text string").repartition(3)
    for hot_rows, chunk in ((10**6, 4096), (50, 16), (4, 9)):
        got = sessions.last_messages(df, "conv", "turn", "role", "text", hot_rows=hot_rows, chunk=chunk).collect()
        assert len(got) == len(rows)
        for r in got:
            earlier = [t for c, u, _, t in rows if c == r.conv and u <= r.turn][-10:]
            assert [m.content for m in r.history] == earlier


def test_history_and_progression_with_text_and_time_keys(spark):
    rng = random.Random(12)
    rows = [(c, f"t{rng.randrange(10**6):06d}{i:03d}", "user", f"{c}-{i}") for c in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "conv bigint, turn string, role string, text string")
    df = df.withColumn("at", F.timestamp_seconds(F.substring("turn", 2, 9).cast("bigint")))
    for key in ("turn", "at"):
        for hot_rows in (5, 10**6):
            for r in sessions.last_messages(df, "conv", key, "role", "text", hot_rows=hot_rows, chunk=16).collect():
                earlier = sorted((t, m) for c, t, _, m in rows if c == r.conv and t <= r.turn)[-10:]
                assert [m.content for m in r.history] == [m for _, m in earlier]
            hits = F.array(*[F.col("text").endswith(str(i)) for i in range(3)])
            made = sessions.progression(df, "conv", key, hits, 3, hot_rows=hot_rows).collect()
            for conv in (1, 2):
                own = sorted((r for r in made if r.conv == conv), key=lambda r: r.turn)
                level = 0
                for r in own:
                    assert r.level_before == level
                    level += level < 3 and r.text.endswith(str(level))
                    assert r.level_after == level


def play(events, secrets):
    """One session, turn by turn."""
    level, wrong, out = 0, 0, []
    for text, restart in events:
        before, correct = level, False
        if restart:
            level = before = 0
        elif level < len(secrets):
            if text in secrets[level]:
                level, wrong, correct = level + 1, 0, True
            else:
                wrong += 1
        out.append((before, correct, level, wrong, level == len(secrets) and not restart))
    return out


def test_progression_equals_turn_by_turn_play(spark):
    rng = random.Random(9)
    secrets = [["a"], ["b", "x"], ["a", "c"]]
    games = {s: [(rng.choice("abcxz"), rng.random() < 0.1) for _ in range(n)] for s, n in ((1, 300), (2, 5), (3, 40), (4, 1))}
    ids = iter(sorted(rng.sample(range(10**12), 400)))
    rows, want = [], {}
    for session, events in games.items():
        keys = sorted(next(ids) for _ in events)
        for key, (text, restart), state in zip(keys, events, play(events, secrets)):
            rows.append((session, key, text, restart))
            want[key] = state
    df = spark.createDataFrame(rows, "s bigint, k bigint, t string, r boolean").repartition(3)
    hits = sessions.level_hits(F.col("t"), secrets)
    for hot_rows, run in ((10**6, 10**6), (7, 5)):
        got = sessions.progression(df, "s", "k", hits, 3, F.col("r"), hot_rows, run).collect()
        assert {r.k: (r.level_before, r.correct, r.level_after, r.wrong_after, r.finished) for r in got} == want

    plain = df.where("NOT r")
    want = {}
    for session, events in games.items():
        kept = [e for e in events if not e[1]]
        keys = sorted(r[1] for r in rows if r[0] == session and not r[3])
        want |= dict(zip(keys, play(kept, secrets)))
    for hot_rows, run in ((10**6, 10**6), (7, 5)):
        got = sessions.progression(plain, "s", "k", hits, 3, hot_rows=hot_rows, run=run).collect()
        assert {r.k: (r.level_before, r.correct, r.level_after, r.wrong_after, r.finished) for r in got} == want
