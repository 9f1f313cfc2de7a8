"""Streaming forms of the state operators (survey T01 to T09).

Each takes a streaming DataFrame and gives one. Keyed folds run as ``applyInPandasWithState`` over the rows of a key in
time order; input must come in time order across micro-batches, as the batch forms assume. The state of a key is a few
values and, where only a gap or the watermark gives it a use, goes by an event-time timer (``ingest_events``, ``throttle_stream``,
``ttl_check_stream``); ``deliver_once`` can forget old broadcasts. Results equal the batch operators on a replay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.operators.events import TERMINAL


def append_events(stream: DataFrame, path: str, checkpoint: str):
    """Append the log as Parquet; see ``flag_stream`` for the demo mark."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def flag_stream(stream: DataFrame) -> DataFrame:
    """(id, tg_id, at, kind, payload, demo): events marked as they come.

    ``stream``: the log with the views of accounts in it, as rows of the kind ``view`` with the student's key as payload.
    An event is demo if the account's last view was of a ``demo-`` key.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        demo = state.get[0] if state.exists else False
        out = []
        for r in _rows(frames, "at", "first", "id").itertuples(index=False):
            if r.kind == "view":
                demo = (r.payload or "").startswith("demo-")
            else:
                out.append((r.id, k[0], r.at, r.kind, r.payload, demo))
        state.update((demo,))
        yield pd.DataFrame(out, columns=["id", "tg_id", "at", "kind", "payload", "demo"])

    rows = stream.select("id", "tg_id", F.col("at").cast("timestamp_ntz").alias("at"), "kind", "payload", (F.col("kind") != "view").alias("first"))
    return rows.groupBy("tg_id").applyInPandasWithState(fold, "id long, tg_id long, at timestamp_ntz, kind string, payload string, demo boolean", "demo boolean", "append", GroupStateTimeout.NoTimeout)


# The watermark runs this far ahead of the log's own times: it begins at 1970, and rows of that time or before would be late at once.
SHIFT = 4_000_000_000_000_000


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    """``rows`` with the watermark of their time ``us`` (microseconds), shifted. Rows that it has passed are left out by Spark and counted in
    the query's progress (numRowsDroppedByWatermark); so are rows without a time."""
    return rows.filter("us is not null").withColumn("_wm", F.timestamp_micros(F.col("us") + SHIFT)).withWatermark("_wm", delay)


def _spaced(stream: DataFrame, key: str, ts: str, gap_us: int, delay: str) -> DataFrame:
    """(key, us, kept) of each event; the last kept time of a key is its state, which goes when the watermark is a gap past it."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for us in sorted(int(x) for f in frames for x in f["us"].dropna()):
            kept = last is None or us - last >= gap_us
            last = us if kept else last
            out.append((k[0], us, kept))
        if last is not None:
            until = (last + gap_us + SHIFT) // 1000 + 1
            if until > state.getCurrentWatermarkMs():
                state.update((last,))
                state.setTimeoutTimestamp(until)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[key, "us", "kept"])

    kind = stream.schema[key].dataType.simpleString()
    rows = _timed(stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")), delay)
    return rows.groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, us long, kept boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def ttl_check_stream(requests: DataFrame, ttl_hours: float = 6, delay: str = "10 minutes") -> DataFrame:
    """(url, at, cached): requests for a url; one that comes within the time to live of the last real check is cached.

    Times may be out of order within a micro-batch, and by ``delay`` across them as far as the state goes; a url that nobody asks for is
    forgotten once its check is too old to be used.
    """
    return _spaced(requests, "url", "at", int(ttl_hours * 3_600_000_000), delay).select("url", F.timestamp_micros("us").cast("timestamp_ntz").alias("at"), (~F.col("kept")).alias("cached"))


def ingest_events(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(id, tg_id, at, kind, payload, demo): the log marked in the order of its times, whatever order it arrives in.

    ``stream`` as in ``flag_stream``. The rows of an account wait in its state until the watermark, ``delay`` behind the newest time seen,
    has passed them; an event-time timer wakes the account then, so nothing waits for its next row. They are folded in time order, views
    before events of the same time. A row later than ``delay`` is left out and counted. Of an account that waits for nothing and views
    no demo student, no state is kept.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        demo, kept = (state.get[0], list(zip(*state.get[1:]))) if state.exists else (False, [])
        mark = state.getCurrentWatermarkMs() * 1000 - SHIFT
        rows = kept if state.hasTimedOut else [*kept, *(r for f in frames for r in zip(f["us"].tolist(), f["id"].tolist(), f["kind"].tolist(), f["payload"].tolist()))]
        ripe = sorted((r for r in rows if r[0] <= mark), key=lambda r: (r[0], r[2] != "view", r[1]))
        wait = [r for r in rows if r[0] > mark]
        out = []
        for us, i, kind, payload in ripe:
            if kind == "view":
                demo = (payload or "").startswith("demo-")
            else:
                out.append((i, k[0], us, kind, payload, demo))
        if wait or demo:
            state.update((demo, *([r[c] for r in wait] for c in range(4))))
            if wait:
                state.setTimeoutTimestamp((min(r[0] for r in wait) + SHIFT) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["id", "tg_id", "us", "kind", "payload", "demo"])

    rows = _timed(stream.select("id", "tg_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "kind", "payload"), delay)
    marked = rows.groupBy("tg_id").applyInPandasWithState(
        fold, "id long, tg_id long, us long, kind string, payload string, demo boolean", "demo boolean, us array<long>, ids array<long>, kinds array<string>, payloads array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )
    return marked.withColumn("at", F.timestamp_micros("us")).drop("us")


def append_marked(stream: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes"):
    """S15 and T01 in one query: the log is marked in the order of its times and appended as Parquet."""
    return append_events(ingest_events(stream, delay), path, checkpoint)


def running_totals(stream: DataFrame, by: str = "kind") -> DataFrame:
    """Live counts; write in update or complete mode."""
    return stream.groupBy(by).agg(F.count("*").alias("n"))


def _rows(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(list(order))


def throttle_stream(stream: DataFrame, key: str, ts: str, gap_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """(key, ts) of kept events: at least ``gap_seconds`` after the last kept one of the key. A quiet key's state goes after the gap."""
    return _spaced(stream, key, ts, int(gap_seconds * 1_000_000), delay).filter("kept").select(key, F.timestamp_micros("us").cast("timestamp_ntz").alias(ts))


def identity_stream(stream: DataFrame, value: str) -> DataFrame:
    """(id, tg_id, was, now): first sightings and changes of a value; null and '' are the same."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was = state.get[0] if state.exists else None
        out = []
        for i, v in _rows(frames, "at", "id")[["id", value]].itertuples(index=False):
            now = v or ""
            if was is None or now != was:
                out.append((i, k[0], was, now))
                was = now
        if was is not None:
            state.update((was,))
        yield pd.DataFrame(out, columns=["id", "tg_id", "was", "now"])

    rows = stream.select("id", "tg_id", F.col("at").cast("timestamp_ntz").alias("at"), value)
    return rows.groupBy("tg_id").applyInPandasWithState(fold, "id long, tg_id long, was string, now string", "last string", "append", GroupStateTimeout.NoTimeout)


def binding_stream(attempts: DataFrame) -> DataFrame:
    """Decisions on (id, tg_id, key, at, action, verified), keyed by student.

    The first verified account is bound, later ones are taken; an unverified account makes one pending claim; approving
    fails if another account is bound. Accounts bound to several students are found by ``double_bound``.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, claims = (state.get[0], set(state.get[1] or [])) if state.exists else (None, set())
        out = []
        for r in _rows(frames, "at", "id").itertuples(index=False):
            if owner is not None and owner != r.tg_id:
                what = "taken"
            elif owner == r.tg_id or r.verified or (r.action == "approve" and r.tg_id in claims):
                owner, what = r.tg_id, "bound"
                claims.discard(r.tg_id)
            elif r.action == "approve":
                what = "no_claim"
            else:
                what = "pending" if r.tg_id in claims else "claim"
                claims.add(r.tg_id)
            out.append((r.id, r.tg_id, k[0], what))
        state.update((owner, sorted(claims)))
        yield pd.DataFrame(out, columns=["id", "tg_id", "key", "decision"])

    rows = attempts.select("id", "tg_id", "key", F.col("at").cast("timestamp_ntz").alias("at"), "action", "verified")
    return rows.groupBy("key").applyInPandasWithState(fold, "id long, tg_id long, key string, decision string", "owner long, claims array<long>", "append", GroupStateTimeout.NoTimeout)


def double_bound(decisions: DataFrame) -> DataFrame:
    """Batch check: accounts bound to several students."""
    return decisions.filter(F.col("decision") == "bound").groupBy("tg_id").agg(F.count_distinct("key").alias("n")).filter("n > 1")


def deliver_once(results: DataFrame, ts: str | None = None, keep: str = "30 days") -> DataFrame:
    """The first terminal result of each (broadcast, account); repeated ones are dropped.

    With ``ts``, a timestamp, state is kept for ``keep`` only; a broadcast is over by then. The frozen list and what is
    left of it are in ``events.freeze_targets`` and ``events.delivery_state``.
    """
    rows = results.filter(F.col("status").isin(*TERMINAL)) if "status" in results.columns else results
    if ts:
        return rows.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["broadcast_id", "tg_id"])
    return rows.dropDuplicates(["broadcast_id", "tg_id"])


def application_drafts(answers: DataFrame) -> DataFrame:
    """(tg_id, answers map, rev, submitted): the last answer of each step, number of edits, snapshot at submission."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, values, rev, sent = (list(state.get[0]), list(state.get[1]), state.get[2], state.get[3]) if state.exists else ([], [], 0, False)
        now = dict(zip(steps, values))
        for r in _rows(frames, "at", "id").itertuples(index=False):
            if r.step == "submit":
                sent = True
            else:
                now[r.step], rev = r.value, rev + 1
        state.update((list(now), list(now.values()), rev, sent))
        yield pd.DataFrame({"tg_id": [k[0]], "steps": [list(now)], "vals": [list(now.values())], "rev": [rev], "submitted": [sent]})

    rows = answers.select("id", "tg_id", F.col("at").cast("timestamp_ntz").alias("at"), "step", "value")
    out = rows.groupBy("tg_id").applyInPandasWithState(fold, "tg_id long, steps array<string>, vals array<string>, rev long, submitted boolean", "steps array<string>, vals array<string>, rev long, sent boolean", "update", GroupStateTimeout.NoTimeout)
    return out.select("tg_id", F.map_from_arrays("steps", "vals").alias("answers"), "rev", "submitted")


# Allowed moves of a broadcast: from state and action to state.
MOVES = {("draft", "start"): "sending", ("stalled", "start"): "sending", ("sending", "finish"): "done", ("sending", "restart"): "stalled", ("draft", "cancel"): "cancelled", ("sending", "cancel"): "cancelled", ("stalled", "cancel"): "cancelled"}


def broadcast_lifecycle(actions: DataFrame) -> DataFrame:
    """(id, broadcast_id, action, status, ok): each action with the state after it; others than MOVES change nothing."""

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "draft"
        out = []
        for r in _rows(frames, "at", "id").itertuples(index=False):
            to = MOVES.get((now, r.action))
            now = to or now
            out.append((r.id, k[0], r.action, now, to is not None))
        state.update((now,))
        yield pd.DataFrame(out, columns=["id", "broadcast_id", "action", "status", "ok"])

    rows = actions.select("id", "broadcast_id", F.col("at").cast("timestamp_ntz").alias("at"), "action")
    return rows.groupBy("broadcast_id").applyInPandasWithState(fold, "id long, broadcast_id long, action string, status string, ok boolean", "status string", "append", GroupStateTimeout.NoTimeout)


def diverged_flags(state: DataFrame) -> DataFrame:
    """A flag (kind, payload) for each record of the outbox's state that was given up."""
    payload = F.to_json(F.struct("sink", "entity", F.col("key").cast("string").alias("key"), "rev", "tries"))
    return state.filter("status = 'diverged'").select(F.lit("sync_diverged").alias("kind"), payload.alias("payload"))


def _versions(spark, state_path: str, number: int) -> dict[int, tuple[int, int]]:
    """For each bucket the micro-batch that wrote it last, up to ``number``, and its records that wait for a retry: as many rows as buckets."""
    if number < 0:
        return {}
    return {r["bucket"]: (r["batch"], r["retries"]) for r in spark.read.parquet(f"{state_path}/_buckets/upto={number}").collect()}


def _state_of(spark, state_path: str, versions: dict[int, tuple[int, int]]) -> DataFrame:
    paths = [f"{state_path}/batch={n}/bucket={b}" for b, (n, _) in sorted(versions.items())]
    return spark.read.schema(OUTBOX).parquet(*paths) if paths else spark.createDataFrame([], OUTBOX)


OUTBOX = "sink string, entity string, key string, rev long, tries int, status string, synced_rev long, remote_id string"


def outbox_state(spark, state_path: str, number: int) -> DataFrame:
    """The outbox's records after micro-batch ``number``: the last version of each bucket."""
    return _state_of(spark, state_path, _versions(spark, state_path, number))


def sync_outbox(tasks: DataFrame, state_path: str, send, checkpoint: str, tries: int = 8, buckets: int = 64):
    """Each micro-batch collapsed to the last revision of each (sink, entity, key), sent, and kept as state.

    ``send``: DataFrame of pending tasks to DataFrame with ``ok`` and, if it likes, ``remote_id``; a record keeps the last one it was given.
    Failures come again with the next micro-batch, up to ``tries`` times, then they are marked diverged. State lies in hash buckets: a
    micro-batch reads and writes those of its tasks and of waiting retries only, under its number, so a repeat overwrites itself and
    what is written follows the batch. A small table names the version of each bucket (``outbox_state`` reads them all).
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        bucket = F.pmod(F.xxhash64("sink", "entity", "key"), F.lit(buckets)).cast("int").alias("bucket")
        before = _versions(spark, state_path, number - 1)
        new = df.select("sink", "entity", "key", "rev", F.lit(0).alias("tries"), bucket)
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()} | {b for b, (_, waiting) in before.items() if waiting}
        old = _state_of(spark, state_path, {b: v for b, v in before.items() if b in touched})
        todo = new.drop("bucket").unionByName(old.filter("status = 'retry'").select("sink", "entity", "key", "rev", "tries"))
        last = todo.groupBy("sink", "entity", "key").agg(F.max(F.struct("rev", "tries")).alias("m")).select("sink", "entity", "key", "m.*")
        last = last.join(old.select("sink", "entity", "key", "synced_rev"), ["sink", "entity", "key"], "left").filter(F.col("rev") > F.coalesce("synced_rev", F.lit(-1))).drop("synced_rev")
        done = send(last).withColumn("tries", F.col("tries") + 1)
        remote = F.col("remote_id").cast("string") if "remote_id" in done.columns else F.lit(None).cast("string")
        status = F.when(F.col("ok"), "done").when(F.col("tries") >= tries, "diverged").otherwise("retry")
        now = done.select("sink", "entity", "key", "rev", "tries", status.alias("status"), F.when(F.col("ok"), F.col("rev")).alias("synced_rev"), remote.alias("remote_id"), F.lit(1).alias("o"))
        both = now.unionByName(old.withColumn("o", F.lit(0)))
        rows = both.groupBy("sink", "entity", "key").agg(
            F.max_by(F.struct("rev", "tries", "status"), "o").alias("s"), F.max("synced_rev").alias("synced_rev"), F.max_by("remote_id", F.when(F.col("remote_id").isNotNull(), F.col("o"))).alias("remote_id")
        )
        rows = rows.select("sink", "entity", "key", "s.*", "synced_rev", "remote_id", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state_path}/batch={number}")
        if touched:
            wrote = spark.read.parquet(f"{state_path}/batch={number}").groupBy("bucket").agg(F.count_if(F.col("status") == "retry").alias("n")).collect()
            before |= {r["bucket"]: (number, r["n"]) for r in wrote}
        table = [(b, n, waiting) for b, (n, waiting) in sorted(before.items())]
        spark.createDataFrame(table, "bucket int, batch long, retries long").coalesce(1).write.mode("overwrite").parquet(f"{state_path}/_buckets/upto={number}")

    return tasks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
