"""Greedy spacing of each key's events, with a frequent key's events spread over tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.numbering import in_ranges, tasks

NEVER = np.iinfo(np.int64).min // 4  # a last kept time before all others


def successors(times: np.ndarray, run: np.ndarray, gap: int) -> np.ndarray:
    """For each event of sorted runs the first one of its run at least ``gap`` later, the number of events if there is none.

    Runs are laid side by side on one axis, farther apart than the gap, so a single search serves all of them.
    """
    n = len(times)
    if not n:
        return np.zeros(1, np.int64)
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    inside = times - np.repeat(times[first], np.diff(np.append(first, n)))
    number = np.cumsum(np.append(True, run[1:] != run[:-1])) - 1
    wide = int(inside.max()) + gap + 1
    if wide * (int(number[-1]) + 2) < 1 << 62:
        line = inside + number * wide
        out = np.searchsorted(line, line + gap)
    else:  # the axis would overflow: run by run
        ends = np.append(first[1:], n)
        out = np.concatenate([a + np.searchsorted(inside[a:b], inside[a:b] + gap) for a, b in zip(first, ends)])
    end = np.append(first[1:], n)[number]
    out = np.maximum(out, np.arange(n) + 1)  # without a gap every event is followed by the next
    return np.append(np.where(out < end, out, n), n)


def reached(after: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which events the chains from ``starts`` meet; jumps double, so it takes as many steps as the longest chain has bits."""
    mark = np.zeros(len(after), bool)
    mark[starts] = True
    jump = after
    while True:
        mark[jump[mark]] = True
        longer = jump[jump]
        if (longer == jump).all():
            return mark[:-1]
        jump = longer


def last_of(after: np.ndarray) -> np.ndarray:
    """The last event of the chain from each event."""
    n = len(after) - 1
    jump = np.where(after[:-1] < n, after[:-1], np.arange(n))
    while True:
        longer = jump[jump]
        if (longer == jump).all():
            return jump
        jump = longer


class Chunk:
    """What a stretch of one key's events makes of the last time kept before it.

    ``upto`` and ``leave``: if the earliest time that may be kept is at most ``upto[i]`` (and above the one before), the last time kept
    after the stretch is ``leave[i]``; above all of them nothing in it is kept. Entries that leave alike are one, so few remain where
    a stretch is longer than the gap.
    """

    def __init__(self, gap: int) -> None:
        self.gap, self.first, self.open = gap, None, True
        self.upto = self.leave = np.zeros(0, np.int64)

    def add(self, times: np.ndarray) -> None:
        """Append the next events, in order."""
        if not len(times):
            return
        end = times[last_of(successors(times, np.zeros(len(times), np.int8), self.gap))]
        if len(self.leave):
            at = np.searchsorted(times, self.leave + self.gap)
            self.leave = np.where(at < len(times), end[np.minimum(at, len(times) - 1)], self.leave)
        if self.first is None:
            self.first = times[0]
        if self.open:
            # what is kept before is no later than the first event, so no entry begins after the first one a gap later
            n = int(np.searchsorted(times, self.first + self.gap))
            self.open = n == len(times)
            self.upto, self.leave = np.concatenate([self.upto, times[: n + 1]]), np.concatenate([self.leave, end[: n + 1]])
        if len(self.leave):
            keep = np.append(self.leave[1:] != self.leave[:-1], True)
            self.upto, self.leave = self.upto[keep], self.leave[keep]

    def after(self, last: int) -> int:
        at = int(np.searchsorted(self.upto, last + self.gap))
        return int(self.leave[at]) if at < len(self.upto) else last


def _runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Ranges, numbers of runs of one range and key, times and keys of a batch sorted by range, key and time."""
    part, times, keys = batch.column("_part").to_numpy(), batch.column("_t").to_numpy(), batch.column("_key")
    code = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    run = np.cumsum(np.append(True, (code[1:] != code[:-1]) | (part[1:] != part[:-1]))) - 1
    return part, run, times, keys


def greedy_spacing(events: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """(key, ts) of events that come at least ``gap_seconds`` after the last kept one; null is a key, null times are left out.

    Events are dealt to ranges of (key, time). Only the first key of a range can go on from the range before: what that stretch makes
    of the last time kept is written as a small map (``Chunk``); the maps of all ranges, one row each, are gone through in order, which
    gives each range its start, and then all ranges are thinned at once. A key that holds most events is many ranges.
    """
    gap = max(0, int(gap_seconds * 1_000_000))
    rows = events.select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_t")).filter("_t is not null")
    kind = rows.schema["_key"].dataType.simpleString()
    ranged = in_ranges(rows, "_key", "_t")
    dealt = lambda df: df.repartition(tasks(events), "_part").sortWithinPartitions("_part", "_key", "_t")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each range: its first and last key, the map of the first, and where the last one ends if it is another."""
        now = None  # range, first key, its map, last key, last time kept of it (None: the first key's own)

        def closed() -> pa.RecordBatch:
            part, first, chunk, last, end = now
            of = pa.type_for_alias("int64")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], key_type), pa.array([last], key_type), pa.array([end], of), pa.array([chunk.upto.tolist()], pa.list_(of)), pa.array([chunk.leave.tolist()], pa.list_(of))],
                names=["part", "first", "last", "end", "upto", "leave"],
            )

        for batch in batches:
            if not len(batch):
                continue
            part, run, times, keys = _runs(batch)
            key_type = keys.type
            heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            tails = np.append(heads[1:], len(run))
            edge = np.append(True, part[heads[1:]] != part[heads[:-1]])  # runs that are the first of their range here
            final = np.append(edge[1:], True)
            for a, b, is_first, is_final in zip(heads[edge | final].tolist(), tails[edge | final].tolist(), edge[edge | final], final[edge | final]):
                name, p = keys[a].as_py(), int(part[a])
                if now is None or p != now[0]:
                    if now:
                        yield closed()
                    now = [p, name, Chunk(gap), name, None]
                if now[4] is None and name == now[1]:
                    now[2].add(times[a:b])
                else:
                    last = now[4] if name == now[3] and now[4] is not None and is_first else NEVER
                    at = int(np.searchsorted(times[a:b], last + gap)) if last != NEVER else 0
                    end = last_of(successors(times[a:b], np.zeros(b - a, np.int8), gap))
                    now[3], now[4] = name, int(times[a:b][end[at]]) if at < b - a else last
        if now:
            yield closed()

    chunks = dealt(ranged).mapInArrow(maps, f"part int, first {kind}, last {kind}, end long, upto array<long>, leave array<long>")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last time kept before each range; a row for each range comes in."""
        held, last = None, NEVER
        for batch in batches:
            for r in batch.to_pylist():
                begin = last if held is not None and held[0] == r["first"] else NEVER
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([begin], pa.int64())], names=["_part", "_begin"])
                if r["end"] is not None:
                    held, last = (r["last"],), r["end"]
                else:
                    chunk = Chunk(gap)
                    chunk.upto, chunk.leave = np.array(r["upto"], np.int64), np.array(r["leave"], np.int64)
                    held, last = (r["first"],), chunk.after(begin)

    begins = chunks.repartition(1).sortWithinPartitions("part").mapInArrow(entries, "_part int, _begin long")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = None, NEVER  # range and key, and its last time kept
        for batch in batches:
            if not len(batch):
                continue
            part, run, times, keys = _runs(batch)
            heads = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            starts = heads.copy()
            opens = np.append(True, part[heads[1:]] != part[heads[:-1]])
            end_of = np.append(heads[1:], len(run))
            for h in np.flatnonzero(opens):  # only these can go on from another batch or range
                a, b = int(heads[h]), int(end_of[h])
                name = (int(part[a]), keys[a].as_py())
                if name == of:
                    before = last
                else:
                    before = batch.column("_begin")[a].as_py() if of is None or of[0] != name[0] else NEVER
                starts[h] = a + int(np.searchsorted(times[a:b], before + gap)) if before != NEVER else a
                if starts[h] == b:
                    starts[h] = len(times)
            mark = reached(successors(times, run, gap), starts)
            kept = np.flatnonzero(mark)
            a = int(heads[-1])
            name = (int(part[a]), keys[a].as_py())
            mine = kept[kept >= a]
            if len(mine):
                last = int(times[mine[-1]])
            elif name != of:
                last = batch.column("_begin")[a].as_py() if opens[-1] and (of is None or of[0] != name[0]) else NEVER
            of = name
            if len(kept):
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(kept)), pa.array(times[kept])], names=["_key", "_t"])

    both = ranged.join(F.broadcast(begins), "_part").select("_part", "_key", "_t", "_begin")  # a row for each range
    kept = dealt(both).mapInArrow(thin, f"_key {kind}, _t long")
    return kept.select(F.col("_key").alias(key), F.timestamp_micros("_t").alias(ts))
