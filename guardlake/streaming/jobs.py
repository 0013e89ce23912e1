"""Log stream, guarded turns, windowed hit counts and session progression."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from guardlake.plans.turns import guard_turns
from guardlake.session import scratch_path
from guardlake.sources.readers import level_rows, parse_log, path_exists, read_levels


# A micro-batch is bounded, so what one session can bring into one task is too.
BYTES_PER_BATCH = 10 * 1024**3


def read_stream(
    spark: SparkSession, folder: str, schema, format: str = "parquet", pattern: str | None = None,
    bytes_per_batch: int = BYTES_PER_BATCH, files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream, a bounded amount per micro-batch."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def log_stream(spark: SparkSession, folder: str, bytes_per_batch: int = BYTES_PER_BATCH) -> DataFrame:
    """The chat log as a stream of parsed lines."""
    return parse_log(read_stream(spark, folder, "value string", "text", bytes_per_batch=bytes_per_batch))


def guard_stream(turns: DataFrame, levels: Sequence[dict], gate: Column, keys: Sequence[str], **columns) -> DataFrame:
    """Stateless: the batch plan itself, on a stream."""
    return guard_turns(turns, levels, gate, keys, **columns)


def guard_changing(
    turns: DataFrame, levels_path: str, gate: Column, keys: Sequence[str], store: Callable[[DataFrame, int], None], **columns
) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that guards turns by the level table as it is when the batch begins.

    The table of levels and their addresses is static beside the stream, and read again for every micro-batch: a row
    written to it holds from the next batch on. A batch that is repeated after a failure is guarded by
    the table as it is then. ``store`` keeps the guarded batch.
    """
    spark = turns.sparkSession

    def guard(batch: DataFrame, batch_id: int) -> None:
        levels = level_rows(read_levels(spark, levels_path))
        store(guard_turns(batch, levels, gate, keys, **columns), batch_id)

    return guard


def hits_per_window(
    turns: DataFrame, ts: str, by: Sequence[str], window: str = "1 day", late: str | None = None, name: str = "hits"
) -> tuple[DataFrame, DataFrame]:
    """Counts per tumbling window, and the rows that came too late to be counted; no row is in neither.

    Every micro-batch stores its own counts, pre-aggregated, and reading adds
    them up: no state is held, and the order of the files does not matter.
    ``late`` is the caller's watermark: a row that far behind the newest row of
    the batches before goes to the side table. Without it every row counts, but for
    rows without a time. A repeated batch overwrites what it had stored.
    """
    spark = turns.sparkSession
    base = scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = None  # of all batches before, as the one before left it
        if late is not None and batch_id:
            newest = spark.read.schema("newest timestamp").parquet(f"{base}/newest/batch_id={batch_id - 1}").first()[0]
        stamped = batch.withColumn("_at", F.col(ts).cast("timestamp"))
        too_late = F.col("_at").isNull()
        if newest is not None:
            too_late = too_late | (F.col("_at") < F.lit(newest) - F.expr(f"INTERVAL {late}"))
        stamped = stamped.withColumn("_late", too_late).persist()
        counts = stamped.where("NOT _late").groupBy(F.window("_at", window).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n_hits"))
        counts.select("_w.start", "_w.end", *by, "n_hits").write.mode("overwrite").parquet(f"{base}/counts/batch_id={batch_id}")
        stamped.where("_late").drop("_at", "_late").write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
        latest = F.greatest(F.max("_at"), F.lit(newest).cast("timestamp")).alias("newest")
        stamped.agg(latest).write.mode("overwrite").parquet(f"{base}/newest/batch_id={batch_id}")
        stamped.unpersist()

    query = (
        turns.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    keys = [f"`{c}` {turns.schema[c].dataType.simpleString()}" for c in by]
    counted = ", ".join(["start timestamp", "end timestamp", *keys, "n_hits bigint"])
    rows = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in turns.schema.fields)
    found = _stored(spark, f"{base}/counts", counted).groupBy("start", "end", *by).agg(F.sum("n_hits").alias("n_hits"))
    found = found.select(
        F.col("start").cast("timestamp_ntz").alias("window_start"), F.col("end").cast("timestamp_ntz").alias("window_end"),
        *by, "n_hits",
    )
    return found, _stored(spark, f"{base}/late", rows)


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch folders below a path; no rows if no batch ran."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path)


PROGRESS_STATE = "level int, wrong bigint, seen bigint, last string, late bigint"


def progression_stream(
    turns: DataFrame, session: str, order: str, hits: Column, levels: int, restart: Column | None = None,
    session_type: str = "bigint",
) -> DataFrame:
    """Session state across micro-batches: one row per session that moved in the batch.

    The state is five values. Inside a batch a session's turns are put in order
    here, each kept as its order key and flags only. A turn before the
    last one of an earlier batch comes too late to be played: it is counted in
    ``n_late`` and changes nothing else. A restart sets the level back to 0 and leaves
    the wrong counter. ``order`` is a whole number, a text or a time.
    """
    schema = f"{session} {session_type}, level bigint, wrong bigint, n_turns bigint, n_late bigint, finished boolean"
    kind = turns.schema[order].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")

    def fold(key: tuple, frames: "Iterator[pd.DataFrame]", state: GroupState) -> "Iterator[pd.DataFrame]":
        import pandas as pd

        level, wrong, seen, last, late = state.get if state.exists else (0, 0, 0, None, 0)
        newest = before = int(last) if whole and last is not None else last
        moves = []
        for frame in frames:
            for at, again, hit in zip(frame["_order"], frame["_restart"], frame["_hits"]):
                moves.append((int(at) if whole else str(at), bool(again), sum(1 << i for i, h in enumerate(hit) if h)))
        moves.sort()
        for at, again, hit in moves:
            if before is not None and at < before:
                late += 1
                continue
            newest = at
            seen += 1
            if again:
                level = 0
            elif level < levels:
                if hit >> level & 1:
                    level, wrong = level + 1, 0
                else:
                    wrong += 1
        state.update((int(level), int(wrong), int(seen), None if newest is None else str(newest), int(late)))
        yield pd.DataFrame({
            session: [key[0]], "level": [level], "wrong": [wrong], "n_turns": [seen], "n_late": [late],
            "finished": [level == levels],
        })

    again = F.coalesce(restart, F.lit(False)) if restart is not None else F.lit(False)
    keyed = turns.select(session, F.col(order).alias("_order"), again.alias("_restart"), hits.alias("_hits"))
    if not whole:
        keyed = keyed.withColumn("_order", F.col("_order").cast("string"))
    return keyed.groupBy(session).applyInPandasWithState(
        fold, schema, PROGRESS_STATE, "update", GroupStateTimeout.NoTimeout
    )


#: Event-time timers and map state live in a state store of this kind.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD_TURNS = 4_096
#: Sessions are dealt to so many groups. A group's games are one value of some 40 bytes a session, and one call per
#: micro-batch that holds turns of it, so the number of calls does not grow with the sessions; more than some 10,000
#: sessions a group call for more groups.
GROUPS = 4_096
NEW_GAME = (0, 0, 0, 0, None, None, 0, -(2**63))


def state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB, outside the heap; arbitrary state needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _dealt(turns: DataFrame, session: str, groups: int, *columns: Column) -> DataFrame:
    """``who``, the session as a text that is empty for null, and its group, beside ``columns``."""
    who = F.coalesce(F.concat(F.lit("="), F.col(session).cast("string")), F.lit(""))
    dealt = turns.select(who.alias("who"), *columns)
    return dealt.withColumn("party", F.pmod(F.xxhash64("who"), F.lit(groups)))


def _undealt(moved: DataFrame, session: str, kind: str) -> DataFrame:
    own = F.when(F.col("who") != "", F.expr("substring(who, 2)")).cast(kind).alias(session)
    return moved.select(own, *[c for c in moved.columns if c != "who"])


def ordered_progression_stream(
    turns: DataFrame, session: str, ts: str, order: str, hits: Column, levels: int, delay: str,
    restart: Column | None = None, bucket: int = 60_000, forget: int | None = None, groups: int = GROUPS,
) -> DataFrame:
    """Session state over turns that arrive in any order: a turn is played once the watermark has passed its time.

    Turns are played by time, then ``order`` (a whole number), so as long as none comes more than ``delay`` behind the newest
    row, the result is that of the batch operator whatever the files and their order; equal keys play together in an order
    of their own. Until then they wait in map state, keyed by a bucket of ``bucket`` milliseconds and a running number of
    chunks of at most ``HELD_TURNS``; a bucket is what a task holds of a hot session. A
    turn before the last one played is counted in ``n_late`` and not played. A session without turns for ``forget``
    milliseconds of event time is dropped from the state.

    Sessions are dealt to ``groups`` that wait together: buckets, chunks and the event-time timer, one for the earliest
    bucket, are those of a group; its games are one value, read and written when turns play.

    Rows ``(session, level, wrong, n_turns, n_late, finished, version)`` come in update mode; the greatest version of a
    session is its newest. Rows without a session or time are left out.
    """
    from pyspark.sql.streaming import StatefulProcessor

    state_store(turns.sparkSession)
    held_turns = HELD_TURNS
    kind = turns.schema[session].dataType.simpleString()
    columns = ["who", "level", "wrong", "n_turns", "n_late", "finished", "version"]

    class Player(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            #: The watermarks up to which buckets were played and sessions forgotten, and the number of the next chunk.
            self.group = handle.getValueState("group", "played long, forgot long, chunks long")
            #: By session: level, wrong, seen, late, time and place of the last turn, version, end of the newest bucket.
            self.games = handle.getValueState("games", "games string")
            self.held = handle.getMapState("held", "bucket long, chunk long", "turns string")

        def _games(self):
            import json

            return json.loads(self.games.get()[0]) if self.games.exists() else {}

        def _stored(self, games, moved):
            """The games written, and a row with a new version for those that moved."""
            import json

            import pandas as pd

            for who in moved:
                games[who][6] += 1
            self.games.update((json.dumps(games),))
            rows = [(w, *games[w][:4], games[w][0] == levels, games[w][6]) for w in moved]
            return pd.DataFrame(rows, columns=columns)

        def handleInputRows(self, key, rows, timerValues):
            import json

            played, forgot, chunks = self.group.get() if self.group.exists() else (None, None, 0)
            games, late, places = None, {}, set()
            for frame in rows:
                wait = {}
                numbers = [frame[c].astype("int64").tolist() for c in ("at_us", "place", "again", "mask")]
                for who, at, number, again, mask in zip(frame["who"].tolist(), *numbers):
                    place = at // 1000 // bucket
                    end = (place + 1) * bucket
                    # Only what falls into buckets that have been played can be behind the last turn.
                    if forget is not None or (played is not None and end <= played):
                        games = self._games() if games is None else games
                        game = games.setdefault(who, list(NEW_GAME))
                        if game[4] is not None and (at, number) < (game[4], game[5]):
                            game[3] += 1
                            late[who] = True
                            continue
                        game[7] = max(game[7], end)
                    wait.setdefault(place, []).append((at, number, again, mask, who))
                for place, turns in wait.items():
                    for begin in range(0, len(turns), held_turns):
                        self.held.updateValue((place, chunks), (json.dumps(turns[begin : begin + held_turns]),))
                        chunks += 1
                places.update(wait)
            if places:
                self.group.update((played, forgot, chunks))
                self.handle.registerTimer((min(places) + 1) * bucket)
                for place in places if forget is not None else ():
                    self.handle.registerTimer((place + 1) * bucket + forget)
            if games is not None:
                yield self._stored(games, late)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import json

            mark = timerValues.getCurrentWatermarkInMs()
            played, forgot, chunks = self.group.get()
            due, rest = {}, None
            for place, chunk in self.held.keys():
                if (place + 1) * bucket <= mark:
                    due.setdefault(place, []).append(chunk)
                else:
                    rest = place if rest is None else min(rest, place)
            games, moved = self._games() if due or forget is not None else {}, {}
            for place in sorted(due):
                turns = sorted(tuple(t) for chunk in due[place] for t in json.loads(self.held.getValue((place, chunk))[0]))
                for at, number, again, mask, who in turns:
                    game = games.setdefault(who, list(NEW_GAME))
                    moved[who] = True
                    game[2], game[4], game[5] = game[2] + 1, at, number
                    if again:
                        game[0] = 0
                    elif game[0] < levels:
                        game[0], game[1] = (game[0] + 1, 0) if mask >> game[0] & 1 else (game[0], game[1] + 1)
                for chunk in due[place]:
                    self.held.removeKey((place, chunk))
            if due:
                yield self._stored(games, moved)
            if rest is not None:
                self.handle.registerTimer((rest + 1) * bucket)
            if forget is not None and forgot != mark:
                self.games.update((json.dumps({who: game for who, game in games.items() if game[7] + forget > mark}),))
            self.group.update((mark if due else played, mark, chunks))

        def close(self):
            pass

    again = F.coalesce(restart, F.lit(False)) if restart is not None else F.lit(False)
    bits = F.aggregate(F.transform(hits, lambda h, i: F.when(h, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    stamped = turns.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    # The time goes on as a number: a column that carries the watermark would have late turns dropped unseen.
    keyed = _dealt(
        stamped.where(F.col(session).isNotNull() & F.col(ts).isNotNull()), session, groups, F.unix_micros("_ts").alias("at_us"),
        F.col(order).cast("long").alias("place"), again.alias("again"), bits.cast("long").alias("mask"),
    )
    schema = "who string, level bigint, wrong bigint, n_turns bigint, n_late bigint, finished boolean, version bigint"
    moved = keyed.groupBy("party").transformWithStateInPandas(Player(), schema, "Update", "EventTime")
    return _undealt(moved, session, kind)


def window_counts(turns: DataFrame, ts: str, by: Sequence[str], window: str, late: str, name: str = "n_hits") -> DataFrame:
    """Counts per tumbling window from the state store, for update or append mode. The watermark bounds the state: a
    window is dropped from it once ``late`` behind the newest row, and rows of such windows are no longer counted."""
    stamped = turns.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counts = stamped.groupBy(F.window("_at", window).alias("_w"), *by).agg(F.count(F.lit(1)).alias(name))
    return counts.select(
        F.col("_w.start").cast("timestamp_ntz").alias("window_start"), F.col("_w.end").cast("timestamp_ntz").alias("window_end"), *by, name
    )


def window_counts_and_late(
    turns: DataFrame, ts: str, by: Sequence[str], window: int, late: str, keep: Sequence[str], salts: int = 16,
) -> DataFrame:
    """The same counts in update mode, with every row that comes after its window was closed; no row is in neither.

    Rows are ``window_ms, <by>, salt, n_hits, closed`` with a running count, or with ``late`` true and the columns of
    ``keep`` for a row whose window of ``window`` milliseconds had been left by the watermark. State is one number per open
    window, group and salt, removed by a timer when the window closes; ``salts`` deal a hot group to tasks, and readers
    add them up. Rows without a time are late.
    """
    from pyspark.sql.streaming import StatefulProcessor

    state_store(turns.sparkSession)
    kinds = {c: turns.schema[c].dataType.simpleString() for c in (*by, *keep)}
    groups, kept = list(by), list(keep)
    untimed = -(2**63)

    class Counter(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.count = handle.getValueState("count", "n long")

        def _frame(self, key, rows, n, closed, late):
            out = rows[[f"kept_{c}" for c in kept]].rename(columns={f"kept_{c}": c for c in kept})
            for name, value in zip(["window_ms", *groups, "salt"], key):
                out[name] = value
            out["n_hits"], out["closed"], out["late"] = n, closed, late
            return out[["window_ms", *groups, "salt", "n_hits", "closed", "late", *kept]]

        def _nothing_kept(self):
            import pandas as pd

            return pd.DataFrame({f"kept_{c}": [None] for c in kept})

        def handleInputRows(self, key, rows, timerValues):
            end = int(key[0]) + window
            closed = key[0] == untimed or end <= timerValues.getCurrentWatermarkInMs()
            n = self.count.get()[0] if not closed and self.count.exists() else 0
            for frame in rows:
                n += len(frame)
                if closed:
                    yield self._frame(key, frame, 0, True, True)
            if not closed:
                self.count.update((n,))
                self.handle.registerTimer(end)
                yield self._frame(key, self._nothing_kept(), n, False, False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            if self.count.exists():
                n = self.count.get()[0]
                self.count.clear()
                yield self._frame(key, self._nothing_kept(), n, True, False)

        def close(self):
            pass

    stamped = turns.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    at = F.unix_millis("_ts")
    keyed = stamped.select(
        F.coalesce(at - F.pmod(at, F.lit(window)), F.lit(untimed)).alias("window_ms"), *by, F.pmod(F.xxhash64(*turns.columns), F.lit(salts)).cast("int").alias("salt"),
        *[F.col(c).alias(f"kept_{c}") for c in kept],
    )
    fields = ["window_ms bigint", *[f"`{c}` {kinds[c]}" for c in by], "salt int, n_hits bigint, closed boolean, late boolean"]
    fields += [f"`{c}` {kinds[c]}" for c in kept]
    out = keyed.groupBy("window_ms", *by, "salt").transformWithStateInPandas(Counter(), ", ".join(fields), "Update", "EventTime")
    return out.withColumn("window_ms", F.nullif("window_ms", F.lit(untimed)))


def run_available(
    stream: DataFrame, mode: str = "append", latest_by: Sequence[str] | None = None, name: str = "stream", version: str = "batch_id",
) -> DataFrame:
    """Run a stream over what is there now and return its output table.

    Every micro-batch overwrites its own folder, so a batch repeated after a
    failure is not counted twice. In update mode a key's newest batch wins, or its greatest ``version``.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(store)
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields]
    schema = ", ".join(fields + (["batch_id bigint"] if latest_by else []))
    if not path_exists(spark, f"{base}/out"):
        return spark.createDataFrame([], ", ".join(fields))
    out = spark.read.schema(schema).option("basePath", f"{base}/out").parquet(f"{base}/out")
    if not latest_by:
        return out.select(*stream.columns)
    rest = [c for c in stream.columns if c not in latest_by]
    newest = out.groupBy(*latest_by).agg(F.max_by(F.struct(*rest), version).alias("_n"))
    return newest.select(*latest_by, "_n.*").select(*stream.columns)


def start(stream: DataFrame, store: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", **trigger):
    """Start a long-running job; the caller names the durable sink and checkpoint folder."""
    return (
        stream.writeStream.outputMode(mode).foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
    )
