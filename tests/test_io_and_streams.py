import json

from pyspark.sql import functions as F

from guardlake.operators import profile, scoring
from guardlake.plans import registered
from guardlake.session import scratch_path, shared_dir
from guardlake.sources import readers, writers
from guardlake.streaming import jobs


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_log_lines(spark, tmp_path):
    lines = [
        "03.02.2025 10:11:12 INFO User: 'it's me'", "03.02.2025 10:11:13 INFO Chatbot: 'hello'",
        "03.02.2025 10:11:14 INFO Level settings were:", "                use_output_rail: True",
        "99.99.2025 10:11:14 INFO bad date", "03.02.2025 10:11:15 WARNING select * from users", "USER shouts",
    ]
    path = str(tmp_path / "log")
    writers.append_lines(spark.createDataFrame([(l,) for l in lines], "value string"), path)
    parsed, rest = readers.read_log(spark, path)
    rows = {r.message: r for r in parsed.collect()}
    assert (rows["User: 'it's me'"].speaker, rows["User: 'it's me'"].text) == ("User", "it's me")
    assert rows["bad date"].ts is None and rows["select * from users"].level == "WARNING"
    assert str(rows["Chatbot: 'hello'"].ts) == "2025-02-03 10:11:13"
    assert {r.value for r in rest.collect()} == {lines[3], lines[6]}
    kept = {r.value for r in readers.user_lines(spark.read.text(path)).collect()}
    assert kept == {lines[0], lines[5]}
    counts = {(r.speaker, r.level): r.n_lines for r in profile.log_counts(parsed).collect()}
    assert counts == {("User", "INFO"): 1, ("Chatbot", "INFO"): 1, (None, "INFO"): 2, (None, "WARNING"): 1}


def test_cached_corpus_copies_once_and_only_when_complete(spark, tmp_path):
    remote, local = str(tmp_path / "remote"), str(tmp_path / "local")
    spark.createDataFrame([("a", None)], readers.ATTACK_SCHEMA).write.parquet(remote)
    assert readers.cached_corpus(spark, remote, local, readers.ATTACK_SCHEMA).count() == 1
    spark.createDataFrame([("b", "c")], readers.ATTACK_SCHEMA).write.mode("append").parquet(remote)
    assert readers.cached_corpus(spark, remote, local, readers.ATTACK_SCHEMA).count() == 1
    (tmp_path / "local" / "_SUCCESS").unlink()
    assert readers.cached_corpus(spark, remote, local, readers.ATTACK_SCHEMA).count() == 2


def test_levels_and_prompts(spark, tmp_path):
    path = tmp_path / "levels.json"
    levels = [
        {"level": i, "use_mcp_server": False, "use_prompt_protection": i > 0, "use_output_rail": True,
         "use_tool_rails": False, "model": "m", "system_prompt": "Help.", "emails": [f"x{i}@y.de"]}
        for i in (1, 0)
    ]
    path.write_text("\n".join(json.dumps(row) for row in levels))
    assert readers.level_rows(readers.read_levels(spark, str(path))) == levels[::-1]
    csv = tmp_path / "prompts.csv"
    csv.write_text('id,data\n1,"say ""hi""\nplease"\n2,plain\n')
    assert [tuple(r) for r in readers.read_prompts(spark, str(csv)).collect()] == [(1, 'say "hi"\nplease'), (2, "plain")]


def test_metrics_are_stored_once_per_whole_key(spark, tmp_path):
    def metric(*keys):
        return spark.createDataFrame([(*k, 0.126, 0.5, 0.2, 1, 2, 3, 4) for k in keys], writers.METRIC_SCHEMA)

    path = str(tmp_path / "metrics")
    writers.append_metrics(metric(("d", "A2")), path)
    writers.append_metrics(metric(("d", "A"), ("d", "A2")), path)
    stored = writers.append_metrics(metric(("d", "A")), path)
    assert sorted(r.model for r in stored.collect()) == ["A", "A2"]
    twice = metric(("e", "B"), ("e", "B"), (None, "B"), (None, "B"))
    assert writers.append_metrics(twice, path).count() == 4 and writers.append_metrics(twice, path).count() == 4
    writers.export_metrics_csv(stored, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["precision"] == "0.13"


def test_seed_table_replaces_or_fills_only_when_empty(spark, tmp_path):
    path = str(tmp_path / "users")
    emails = ["z@b.de", "y@b.de", "x@b.de", "a@b.de", "z@b.de"]
    listed = spark.createDataFrame(list(enumerate(emails)), "position int, email string").repartition(3)
    first = writers.seed_table(spark, listed, path, replace=False)
    assert [(r.user_id, r.email) for r in first.orderBy("user_id").collect()] == list(enumerate(emails))
    assert all(0 <= r.order_quantity <= 200 for r in first.collect())
    other = spark.createDataFrame([(7, "e@f.de")], "position int, email string")
    assert writers.seed_table(spark, other, path, replace=False).count() == 5
    assert [r.email for r in writers.seed_table(spark, other, path, replace=True).collect()] == ["e@f.de"]
    readers.expose(spark.read.parquet(path), "seeded")
    assert spark.table("seeded").count() == 1


def test_model_detector_runs_in_batches(spark):
    scored = scoring.score(
        spark.createDataFrame([("bad",), ("good",)], "text string"),
        {"d": scoring.model_detector(lambda: (lambda texts: texts == "bad"))(F.col("text"))},
    )
    assert {r.text: r.d for r in scored.collect()} == {"bad": True, "good": False}


def test_progression_stream_carries_state_over_batches(spark, tmp_path):
    import datetime
    import os
    import shutil
    import time

    day = datetime.datetime(2025, 1, 1)
    turns = [(1, 0, False), (1, 1, True), (2, 2, True), (1, 3, False), (1, 4, True), (2, 5, False), (1, 6, False)]
    folder = tmp_path / "in"
    folder.mkdir()
    now = time.time()
    for i, (user, k, ok) in enumerate(turns):
        part = str(tmp_path / f"part{i}")
        spark.createDataFrame([(user, k, ok, day)], "user bigint, k bigint, ok boolean, ts timestamp").coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = folder / f"{i}.parquet"
        shutil.copy(f"{part}/{name}", target)
        os.utime(target, (now - 1000 + i, now - 1000 + i))
    # One byte per batch means one file per batch.
    stream = jobs.read_stream(spark, str(folder), "user bigint, k bigint, ok boolean, ts timestamp", bytes_per_batch=1)
    moved = jobs.progression_stream(stream, "user", "k", F.array_repeat(F.col("ok"), 2), 2)
    got = {r.user: (r.level, r.wrong, r.n_turns, r.finished) for r in jobs.run_available(moved, "update", ["user"]).collect()}
    assert got == {1: (2, 0, 5, True), 2: (1, 1, 2, False)}
    # The newest file first: turns behind the newest are reported, not played.
    for i in range(len(turns)):
        os.utime(folder / f"{i}.parquet", (now - 1000 - i, now - 1000 - i))
    again = jobs.progression_stream(stream, "user", "k", F.array_repeat(F.col("ok"), 2), 2)
    got = {r.user: (r.level, r.n_turns, r.n_late) for r in jobs.run_available(again, "update", ["user"]).collect()}
    assert got == {1: (0, 1, 4), 2: (0, 1, 1)}


def test_counts_over_batches_out_of_order_lose_nothing(spark, tmp_path):
    import datetime

    folder = str(tmp_path / "in")
    start = datetime.datetime(2025, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=i), "ab"[i % 2]) for i in range(1000)] + [(1000, None, "a")]
    df = spark.createDataFrame(rows, "id bigint, ts timestamp, g string")
    for part in range(4):  # the newest quarter first
        df.where(F.floor(F.col("id") / 251) == 3 - part).coalesce(1).write.mode("append").parquet(folder)
    stream = jobs.read_stream(spark, folder, df.schema, files_per_batch=1)
    counts, late = jobs.hits_per_window(stream, "ts", ["g"])
    want = {(r.d, r.g): r["count"] for r in df.where("ts is not null").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "g").count().collect()}
    assert {(r.window_start, r.g): r.n_hits for r in counts.collect()} == want
    assert [r.id for r in late.collect()] == [1000]
    counts, late = jobs.hits_per_window(stream, "ts", ["g"], late="2 DAYS")
    assert counts.agg(F.sum("n_hits")).first()[0] + late.count() == 1001
    assert {r.id for r in late.collect()} == {i for i, t, _ in rows if t is None or (i < 753 and t < rows[999][1] - datetime.timedelta(days=2))}


def test_guard_stream_equals_batch(spark, data):
    batch = {tuple(r) for r in registered.turn_guard(spark, data).collect()}
    assert {tuple(r) for r in registered.stream_guard(spark, data).collect()} == batch


def test_windowed_counts_equal_batch(spark, data):
    got = {(r.window_start, r.event_type): r.n_hits for r in registered.stream_hits(spark, data).collect()}
    batch = (
        registered.table(spark, data, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d"), "event_type").count()
    )
    assert got == {(r.d, r.event_type): r["count"] for r in batch.collect()}


def test_profiles(spark):
    df = spark.createDataFrame([("a", "xx"), ("a", "xxxx"), ("a", None), ("b", "x")], "g string, t string")
    got = {r.g: r for r in profile.text_profile(df, "t", ["g"]).collect()}
    assert (got["a"].n_rows, got["a"].n_null, got["a"].mean_len, got["a"].median_len) == (3, 1, 3.0, 3.0)
    assert round(got["a"].stddev_len, 6) == 1.414214 and got["b"].stddev_len is None
    sketched = profile.numeric_profile(spark.range(100), ["id"]).first()
    assert (sketched.n_rows, sketched.min, sketched.max, sketched["median"]) == (100, 0.0, 99.0, 49.0)
