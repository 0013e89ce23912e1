import datetime
import os
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from guardlake.operators import sessions
from guardlake.plans import registered
from guardlake.streaming import jobs

DAY = datetime.datetime(2025, 1, 1)
TURNS = "user bigint, k bigint, ok boolean, again boolean, ts timestamp"


def files(spark, tmp_path, parts, schema):
    """One file per list of rows, read one per micro-batch in this order."""
    folder = tmp_path / "in"
    folder.mkdir()
    now = time.time()
    for i, rows in enumerate(parts):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        shutil.copy(f"{part}/{name}", folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (now - 1000 + i, now - 1000 + i))
    return jobs.read_stream(spark, str(folder), schema, files_per_batch=1)


def played(spark, stream, **options):
    moved = jobs.ordered_progression_stream(
        stream, "user", "ts", "k", F.array_repeat(F.col("ok"), 3), 3, restart=F.col("again"), **options
    )
    out = jobs.run_available(moved, "update", ["user"], "ordered", version="version")
    return {r.user: (r.level, r.wrong, r.n_turns, r.n_late) for r in out.where("user >= 0").collect()}


def test_files_out_of_order_give_the_batch_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "HELD_TURNS", 7)
    rng = random.Random(5)
    rows = []
    for k in range(240):  # user 0 is hot, every third time is shared by two turns
        user = rng.choice([0, 0, 0, 1, 2, 3])
        rows.append((user, k, rng.random() < 0.4, rng.random() < 0.05, DAY + datetime.timedelta(minutes=k - (k % 3 == 0))))
    batch = sessions.progression(
        spark.createDataFrame(rows, TURNS), "user", "k", F.array_repeat(F.col("ok"), 3), 3, F.col("again")
    )
    last = batch.groupBy("user").agg(F.max_by(F.struct("level_after", "wrong_after"), "k").alias("s"), F.count("*").alias("n"))
    want = {r.user: (r.s[0], r.s[1], r.n, 0) for r in last.collect()}
    rng.shuffle(rows)
    end = (-1, 0, False, False, DAY + datetime.timedelta(days=9))
    parts = [rows[i::3] for i in range(3)] + [[end]]
    assert played(spark, files(spark, tmp_path, parts, TURNS), delay="1 day", bucket=600_000) == want


def test_late_turns_are_counted_and_ties_over_batches_play(spark, tmp_path):
    at = lambda minutes: DAY + datetime.timedelta(minutes=minutes)
    parts = [
        [(1, 0, True, False, at(0)), (1, 5, True, False, at(5)), (2, 0, False, False, at(200))],
        [(1, 5, False, False, at(5)), (1, 1, True, False, at(1)), (2, 1, False, False, at(201))],
        [(1, 3, True, False, at(3)), (1, 5, True, False, at(5)), (3, 0, None, None, None)],
        [(-1, 0, False, False, at(5000))],
    ]
    # The second batch's watermark plays user 1 up to minute 5; the turn of minute 3 is late, the tie at minute 5 is not.
    assert played(spark, files(spark, tmp_path, parts, TURNS), delay="10 minutes") == {1: (3, 0, 5, 1), 2: (0, 2, 2, 0)}


def test_a_tie_across_batches_is_played(spark, tmp_path):
    parts = [[(1, 4, True, False, DAY)], [(1, 4, True, False, DAY), (1, 3, True, False, DAY)]]
    stream = files(spark, tmp_path, parts, TURNS)
    moved = jobs.progression_stream(stream, "user", "k", F.array_repeat(F.col("ok"), 3), 3)
    got = [(r.level, r.n_turns, r.n_late) for r in jobs.run_available(moved, "update", ["user"]).collect()]
    assert got == [(2, 2, 1)]


EVENTS = "id bigint, ts timestamp, g string"


def test_windows_in_the_state_store_equal_batch(spark, tmp_path):
    rows = [(i, DAY + datetime.timedelta(hours=i), "ab"[i % 2]) for i in range(300)]
    stream = files(spark, tmp_path, [rows[i : i + 100] for i in range(0, 300, 100)], EVENTS)
    counts = jobs.window_counts(stream, "ts", ["g"], "1 day", "2 days")
    got = jobs.run_available(counts, "update", ["window_start", "window_end", "g"], "windows")
    df = spark.createDataFrame(rows, EVENTS)
    want = {(r.d, r.g): r["count"] for r in df.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "g").count().collect()}
    assert {(r.window_start, r.g): r.n_hits for r in got.collect()} == want


def test_late_rows_go_to_the_side_and_none_is_lost(spark, tmp_path):
    rows = [(i, DAY + datetime.timedelta(hours=i), "ab"[i % 2]) for i in range(300)] + [(900, None, "a")]
    parts = [rows[200:300], rows[100:200] + rows[300:], rows[:100], [(901, DAY + datetime.timedelta(days=400), "z")]]
    stream = files(spark, tmp_path, parts, EVENTS)
    out = jobs.run_available(
        jobs.window_counts_and_late(stream, "ts", ["g"], 86_400_000, "3 days", ["id"], salts=3), "update", None, "late"
    ).collect()
    late = {r.id for r in out if r.late}
    newest = {}
    for r in out:
        if not r.late:
            key = (r.window_ms, r.g, r.salt)
            newest[key] = max(newest.get(key, (0, False)), (r.n_hits, r.closed))
    counted = sum(n for n, _ in newest.values())
    mark = rows[299][1] - datetime.timedelta(days=3)
    want = {i for i, t, _ in rows[:200] + rows[300:] if t is None or t.replace(hour=0) + datetime.timedelta(days=1) <= mark}
    assert late == want and counted == len(rows) + 1 - len(want)
    assert all(closed for (_, g, _), (_, closed) in newest.items() if g != "z")


def test_changed_levels_hold_from_the_next_batch(spark, tmp_path):
    level = lambda rail: spark.createDataFrame(
        [(0, False, False, rail, False, "m", "p", ["a@b.de"])], registered.readers.LEVEL_SCHEMA
    )
    path = str(tmp_path / "levels")
    level(False).write.json(path)
    parts = [[(1, 0, "hi", "me: x@y.de")], [(2, 0, "hi", "me: x@y.de")]]
    schema = "turn_id bigint, level int, text string, response string"
    stream, kept = files(spark, tmp_path, parts, schema), {}

    def store(batch, batch_id):
        kept.update({r.turn_id: r.response for r in batch.collect()})
        if batch_id == 0:
            level(True).write.mode("overwrite").json(path)

    guard = jobs.guard_changing(stream, path, F.lit(False), ["turn_id"], store)
    query = stream.writeStream.foreachBatch(guard).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert kept == {1: "me: x@y.de", 2: "me: <EMAIL_ADDRESS>"}


@pytest.mark.parametrize("name", ["stream_progress_ordered", "stream_late_rows"])
def test_registered_streams_run(spark, data, name):
    assert registered.QUERIES[name](spark, data).count() > 0


def test_sessions_of_a_group_keep_their_own_state(spark, tmp_path):
    rng = random.Random(8)
    names = [f"u{i}" for i in range(20)] + ["", "=x"]
    schema = TURNS.replace("user bigint", "user string")
    rows = [(rng.choice(names), k, rng.random() < 0.4, rng.random() < 0.05, DAY + datetime.timedelta(minutes=k)) for k in range(400)]
    batch = sessions.progression(spark.createDataFrame(rows, schema), "user", "k", F.array_repeat(F.col("ok"), 3), 3, F.col("again"))
    last = batch.groupBy("user").agg(F.max_by(F.struct("level_after", "wrong_after"), "k").alias("s"), F.count("*").alias("n"))
    want = {r.user: (r.s[0], r.s[1], r.n, 0) for r in last.collect()}
    hits = F.array_repeat(F.col("ok"), 3)
    rng.shuffle(rows)
    end = ("end", 0, False, False, DAY + datetime.timedelta(days=9))
    stream = files(spark, tmp_path, [rows[::2], rows[1::2], [end]], schema)
    moved = jobs.ordered_progression_stream(stream, "user", "ts", "k", hits, 3, "1 day", F.col("again"), 600_000, groups=2)
    out = jobs.run_available(moved, "update", ["user"], "ordered", version="version").where("user <> 'end'")
    assert {r.user: (r.level, r.wrong, r.n_turns, r.n_late) for r in out.collect()} == want


def test_a_session_is_forgotten_and_its_group_is_not(spark, tmp_path):
    at = lambda minutes: DAY + datetime.timedelta(minutes=minutes)
    parts = [
        [(1, 0, True, False, at(0)), (2, 0, True, False, at(0)), (2, 1, True, False, at(50))], [(-1, 0, False, False, at(75))],
        [(-1, 1, False, False, at(77))], [(1, 2, True, False, at(78)), (2, 2, True, False, at(78))], [(-1, 2, False, False, at(500))],
    ]
    got = played(spark, files(spark, tmp_path, parts, TURNS), delay="1 minute", forget=3_600_000, groups=1)
    assert got == {1: (1, 0, 1, 0), 2: (3, 0, 3, 0)}
