"""Hard negatives from blocks of vectors in Hilbert order with zone maps.

Components become integers, so all scores are exact. The rows are ordered along a Hilbert curve through the dimensions
of the largest variance, dealt to range partitions (groups) and packed into blocks of ``BLOCK_ROWS`` rows, a Parquet
table with the least and the largest value of each dimension of each block. For an anchor, interval arithmetic over these
zone maps bounds the products with all rows of a block from both sides. A block is read only where its bounds meet a
window of the anchor: for positives everything from the anchor's present fifth score up, for negatives the scores
between the two parts of a positive's score, and there too only from the present third score up.

Anchors travel in parcels of ``PARCEL`` rows. A parcel is first compared with its own group, whose rows are its
neighbours on the curve; that gives the scores which let other groups be left out. Then it is sent to the groups whose
box meets a window. There are at most ``MOST_BOXES`` boxes on the driver; where there are more groups, neighbouring groups
share a box, which sends a parcel to too many groups but never to too few. A task holds one group and lets parcels
stream by; nothing is computed for pairs outside it, and lists of a parcel are merged by parcel.

Vectors of random directions have wide zone maps, so there every block is read and the work is that of all anchors with all
rows; clustered vectors leave most blocks out (tested).

Rows with a null id, label or vector or with a null or non-finite component take no part, nor do vectors of another length
than most. Exact repeats of a row count once; rows that share an id but differ are rows of their own, and never partners of
each other. Ties go to the smaller id. An anchor without another row of its label gives no rows; fewer positives or
negatives than asked for: all there are. Vectors whose products do not
fit 53 bits raise an error; vectors without components take no part. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Run, read_table

BLOCK_ROWS = 512
GROUP_ROWS = 65_536  # about so many rows in a task's memory
LEAST_GROUP = 4_096
PARCEL = 256
MOST_BOXES = 4_096
CURVE_DIMS, CURVE_BITS = 8, 7  # the key has 56 bits

_BLOCKS = "group int, kind int, at long, ids binary, labels binary, data binary, lo array<long>, hi array<long>, best binary"
_RESULTS = "parcel long, source int, best binary, blocks_read long, blocks long"


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, c): the rows that take part, with components floor(256 x)."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    good = v.filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.filter(F.size("v") == (sizes[0]["n"] if sizes else 0)).select("id", "label", F.transform("v", lambda x: F.floor(x * 256).cast("long")).alias("c"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of rows of cell numbers with ``bits`` bits each (dimensions times bits below 64).

    The usual transform from axes to the transposed index, a column at a time for all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(set_, q - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of each row of ``a`` with any vector of each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T


@dataclass
class Windows:
    """Score windows of anchors and the best ``k`` entries found for each: id and score, missing ones at the end."""

    row: np.ndarray  # the anchor's row in its parcel
    low: np.ndarray
    high: np.ndarray
    k: int
    ids: np.ndarray = field(default=None)
    scores: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        if self.ids is None:
            self.ids, self.scores = np.zeros((len(self.row), self.k), np.int64), np.full((len(self.row), self.k), -np.inf)

    def floor(self) -> np.ndarray:
        """Scores below it change nothing."""
        return np.maximum(self.low, self.scores[:, -1])

    def emptied(self) -> Windows:
        """The same windows without their entries, but with the bounds that these set."""
        return Windows(self.row, self.floor(), self.high, self.k)

    def take(self, window: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge entries (window, id, score) into the lists."""
        touched = np.unique(window)
        old_w, old_k = np.nonzero(self.scores[touched] > -np.inf)
        w = np.concatenate([window, touched[old_w]])
        i = np.concatenate([ids, self.ids[touched][old_w, old_k]])
        s = np.concatenate([scores, self.scores[touched][old_w, old_k]])
        order = np.lexsort((i, -s, w))
        w, i, s = w[order], i[order], s[order]
        starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        place = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
        keep = place < self.k
        self.ids[touched], self.scores[touched] = 0, -np.inf
        self.ids[w[keep], place[keep]], self.scores[w[keep], place[keep]] = i[keep], s[keep]

    def pack(self) -> bytes:
        """Window numbers, ids and scores of the entries found; scores are integers below 2^53, so exact."""
        w, k = np.nonzero(self.scores > -np.inf)
        return np.stack([w, self.ids[w, k], self.scores[w, k].astype(np.int64)]).astype("<i8").tobytes()


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, i, s = np.frombuffer(raw, "<i8").reshape(3, -1)
    return w, i, s.astype(np.float64)


class Block:
    def __init__(self, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        self.ids, self.labels, self.data, self.lo, self.hi = ids, labels, data, lo, hi


def search(blocks: list[Block], a: np.ndarray, ids: np.ndarray, labels: np.ndarray, win: Windows, same: bool) -> int:
    """Look through the blocks whose bounds meet a window; gives how many were read.

    ``a``, ``ids``, ``labels``: the anchors; ``same``: partners have the anchor's label, or another one.
    """
    if not blocks or not len(win.row):
        return 0
    low, up = bounds(a, np.stack([b.lo for b in blocks]), np.stack([b.hi for b in blocks]))
    read = 0
    for n in np.argsort(-up.max(0), kind="stable"):
        floor, b = win.floor(), blocks[n]
        need = np.flatnonzero((up[win.row, n] >= floor) & (low[win.row, n] <= win.high))
        if not len(need):
            continue
        read += 1
        rows, at = np.unique(win.row[need], return_inverse=True)
        s = a[rows] @ b.data.T.astype(np.float64)
        ok = (labels[rows][:, None] == b.labels[None, :]) == same
        ok &= ids[rows][:, None] != b.ids[None, :]
        s[~ok] = -np.inf
        t = s[at]
        t[(t < floor[need][:, None]) | (t > win.high[need][:, None])] = -np.inf
        k = min(win.k, t.shape[1])
        least = np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k]
        w, j = np.nonzero((t >= least[:, None]) & (t > -np.inf))
        if len(w):
            win.take(need[w], b.ids[j], t[w, j])
    return read


def _everything(m: int, k: int) -> Windows:
    return Windows(np.arange(m), np.full(m, -np.inf), np.full(m, np.inf), k)


def _negative_windows(best: bytes, negatives: int, low: int, high: int) -> tuple[Windows, np.ndarray, np.ndarray]:
    """One window for each anchor and positive, with the positives' ids and scores."""
    row, ids, scores = unpack(best)
    p = scores.astype(np.int64)
    return Windows(row, (-((-low * p) // 100)).astype(np.float64), ((high * p) // 100).astype(np.float64), negatives), ids, p


class Miner:
    """One run over a table of vectors."""

    def __init__(self, vectors: DataFrame, is_anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> None:
        self.spark, self.run = vectors.sparkSession, Run(vectors.sparkSession, "hard-negatives")
        self.rows = self.run.written(integers(vectors, id_col, vec_col, label_col), "rows")
        self.is_anchor = is_anchor
        self.moments()

    def moments(self) -> None:
        """Number of rows, and mean, variance and largest size of each dimension: sums of each task, added up by dimension."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if len(batch) and (width := len(batch.column("c")[0])):
                    x = matrix(batch.column("c"), width).astype(np.float64)
                    new = np.stack([np.full(width, len(x), np.float64), x.sum(0), (x * x).sum(0)]), np.abs(x).max(0)
                    total = new if total is None else (total[0] + new[0], np.maximum(total[1], new[1]))
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total[1])), pa.int32()), *map(pa.array, total[0]), pa.array(total[1])], names=["dim", "n", "s", "q", "m"])

        parts = self.rows.select("c").mapInArrow(sums, "dim int, n double, s double, q double, m double")
        table = sorted(parts.groupBy("dim").agg(F.sum("n"), F.sum("s"), F.sum("q"), F.max("m")).collect())  # a row for each dimension
        self.count = self.rows.count()
        self.width = len(table)
        x = np.array(table, float).reshape(self.width, 5)
        self.mean = x[:, 2] / np.maximum(x[:, 1], 1)
        self.scale = np.sqrt(np.maximum(x[:, 3] / np.maximum(x[:, 1], 1) - self.mean**2, 0))
        self.most = float(x[:, 4].max()) if self.width else 0.0
        if self.width * self.most**2 >= 2**53:
            raise ValueError("inner products of these vectors do not fit the exact range of 53 bits")

    def blocks(self, positives: int, least_group: int = LEAST_GROUP) -> None:
        """Write the blocks in Hilbert order, a box for each group, and the parcels with their first positives."""
        spread = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.groups = max(1, min(spread, math.ceil(self.count / least_group)), math.ceil(self.count / GROUP_ROWS))
        width, mean, scale = self.width, self.mean, self.scale
        along = np.argsort(-scale, kind="stable")[:CURVE_DIMS]
        small = np.int16 if self.most < 2**15 else np.int32 if self.most < 2**31 else np.int64

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = matrix(batch.column("c"), width)[:, along]
                    cell = np.clip(((x - mean[along]) / np.maximum(scale[along], 1e-9) / 6 + 0.5) * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
                    keys = hilbert(cell, CURVE_BITS) if len(along) else np.zeros(len(batch), np.int64)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["id", "label", "c", "anchor", "key"])

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, tables = TaskContext.get().partitionId(), [b for b in batches if len(b)]
            if not tables:
                return
            ids, labels = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in ("id", "label"))
            data = np.concatenate([matrix(t.column("c"), width).astype(small) for t in tables])
            anchor = np.concatenate([t.column("anchor").to_numpy(zero_copy_only=False) for t in tables])
            again = np.zeros(len(ids), bool)  # equal rows are neighbours
            again[1:] = (ids[1:] == ids[:-1]) & (labels[1:] == labels[:-1]) & (data[1:] == data[:-1]).all(1)
            ids, labels, data, anchor = ids[~again], labels[~again], data[~again], anchor[~again]
            cuts = range(0, len(ids), BLOCK_ROWS)
            blocks = [Block(ids[s : s + BLOCK_ROWS], labels[s : s + BLOCK_ROWS], d := data[s : s + BLOCK_ROWS], d.min(0).astype(np.int64), d.max(0).astype(np.int64)) for s in cuts]
            for n, b in enumerate(blocks):
                yield _row(group, 0, n, b.ids, b.labels, b.data, b.lo, b.hi, b"")
            at = np.flatnonzero(anchor)
            for n, s in enumerate(range(0, len(at), PARCEL)):
                mine = at[s : s + PARCEL]
                win = _everything(len(mine), positives)
                search(blocks, data[mine].astype(np.float64), ids[mine], labels[mine], win, True)
                yield _row(group, 1, (group << 24) + n, ids[mine], labels[mine], data[mine], None, None, win.pack())

        marked = self.rows.withColumn("anchor", F.coalesce(self.is_anchor, F.lit(False)))
        keyed = marked.mapInArrow(key, "id long, label long, c array<long>, anchor boolean, key long")
        # the hash of the id splits a frequent vector over groups; equal rows of one id stay side by side
        ordered = keyed.repartitionByRange(self.groups, "key", F.xxhash64("id")).sortWithinPartitions("key", F.xxhash64("id"), "id", "label", "c")
        self.small, table = small, self.run.written(ordered.mapInArrow(build, _BLOCKS), "blocks")
        self.table, self.parcels = table.filter("kind = 0"), table.filter("kind = 1")
        last = table.agg(F.max("group")).first()[0]
        self.last = 0 if last is None else last
        self.boxes()

    def boxes(self) -> None:
        """The boxes of runs of groups, MOST_BOXES at most."""
        self.run_of = max(1, math.ceil((self.last + 1) / MOST_BOXES))
        pairs = self.table.select(F.floor(F.col("group") / self.run_of).alias("box"), F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "z"))
        found = pairs.groupBy("box", "dim").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi")).collect()
        self.box = np.array(sorted({r["box"] for r in found}), np.int64)
        at = {b: n for n, b in enumerate(self.box.tolist())}
        self.lo, self.hi = (np.zeros((len(at), self.width)) for _ in range(2))
        for r in found:
            self.lo[at[r["box"]], r["dim"]], self.hi[at[r["box"]], r["dim"]] = r["lo"], r["hi"]

    def visit(self, parcels: DataFrame, windows, same: bool, home: bool, name: str) -> DataFrame:
        """Deal the parcels to the groups that meet a window, look through the groups, and give the parcels' entries.

        ``windows``: makes the windows of a parcel from its row's ``best``; ``home``: whether a parcel meets its own group.
        """
        width, small, box, lo, hi, run_of, last = self.width, self.small, self.box, self.lo, self.hi, self.run_of, self.last

        def opened(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            raw = lambda c, kind: np.frombuffer(batch.column(c)[n].as_py(), kind)
            return raw("ids", np.int64), raw("labels", np.int64), raw("data", small).reshape(-1, width)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(len(batch)):
                    ids, _, data = opened(batch, n)
                    win, own = windows(batch.column("best")[n].as_py(), len(ids)), batch.column("group")[n].as_py()
                    low, up = bounds(data.astype(np.float64), lo, hi)
                    meets = ((up[win.row] >= win.floor()[:, None]) & (low[win.row] <= win.high[:, None])).any(0)
                    for b in box[meets].tolist():
                        for g in range(b * run_of, min((b + 1) * run_of, last + 1)):
                            if home or g != own:
                                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), *(batch.column(c).slice(n, 1) for c in batch.schema.names[1:])], names=batch.schema.names)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, blocks = None, []
            for batch in batches:
                for n in range(len(batch)):
                    group, kind = batch.column("group")[n].as_py(), batch.column("kind")[n].as_py()
                    if group != now:
                        now, blocks = group, []
                    ids, labels, data = opened(batch, n)
                    if kind == 0:
                        blocks.append(Block(ids, labels, data, *(np.array(batch.column(c)[n].as_py(), np.float64) for c in ("lo", "hi"))))
                        continue
                    win = windows(batch.column("best")[n].as_py(), len(ids)).emptied()
                    read = search(blocks, data.astype(np.float64), ids, labels, win, same)
                    yield pa.RecordBatch.from_arrays([batch.column("at").slice(n, 1), pa.array([group], pa.int32()), pa.array([win.pack()], pa.binary()), pa.array([read], pa.int64()), pa.array([len(blocks)], pa.int64())], names=["parcel", "source", "best", "blocks_read", "blocks"])

        both = self.table.unionByName(parcels.mapInArrow(deal, _BLOCKS)).repartition(self.groups, "group").sortWithinPartitions("group", "kind", "at")
        return self.run.written(both.mapInArrow(look, _RESULTS), name)

    def merged(self, parcels: DataFrame, found: DataFrame, windows, name: str) -> DataFrame:
        """The parcels with the best entries of all their visits in ``best``; ``start``: what ``best`` held before."""
        schema = f"{_BLOCKS}, start binary"

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, win = None, None

            def closed() -> pa.RecordBatch:
                head, before = now
                return pa.RecordBatch.from_arrays([*head.columns[:-1], pa.array([win.pack()], pa.binary()), pa.array([before], pa.binary())], names=[*head.schema.names[:-1], "best", "start"])

            for batch in batches:
                for n in range(len(batch)):
                    row = batch.slice(n, 1)
                    if row.column("source")[0].as_py() < 0:
                        if now:
                            yield closed()
                        head = row.select(["group", "kind", "at", "ids", "labels", "data", "lo", "hi", "best"])
                        before = row.column("best")[0].as_py()
                        now, win = (head, before), windows(before, len(row.column("ids")[0].as_py()) // 8)
                    else:
                        w, i, s = unpack(row.column("best")[0].as_py())
                        win.take(w, i, s)
            if now:
                yield closed()

        entries = found.select(F.lit(0).alias("group"), F.lit(1).alias("kind"), F.col("parcel").alias("at"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "data")), *(F.lit(None).cast("array<long>").alias(c) for c in ("lo", "hi")), "best", "source")
        both = parcels.withColumn("source", F.lit(-1)).unionByName(entries).repartition("at").sortWithinPartitions("at", "source")
        return self.run.written(both.mapInArrow(merge, schema), name)

    def mine(self, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
        """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
        shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        if not self.count:
            self.run.clear()
            return self.spark.createDataFrame([], shape)
        self.blocks(positives)

        def first(best: bytes, m: int) -> Windows:
            win = _everything(m, positives)
            if best:
                win.take(*unpack(best))
            return win

        def second(best: bytes, _: int) -> Windows:
            return _negative_windows(best, negatives, low, high)[0]

        self.first = self.visit(self.parcels, first, True, False, "positive-visits")
        ready = self.merged(self.parcels, self.first, first, "positives").drop("start")
        self.second = self.visit(ready, second, False, True, "negative-visits")
        done = self.merged(ready, self.second, second, "negatives")

        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(len(batch)):
                    ids = np.frombuffer(batch.column("ids")[n].as_py(), np.int64)
                    win, positive, score = _negative_windows(batch.column("start")[n].as_py(), negatives, low, high)
                    w, i, s = unpack(batch.column("best")[n].as_py())
                    rank = np.arange(len(w)) - np.searchsorted(w, w) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[win.row[w]]), pa.array(positive[w]), pa.array(rank, pa.int32()), pa.array(i), pa.array(score[w]), pa.array(s.astype(np.int64))], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

        return self.run.finish(done.mapInArrow(explode, shape))


def _row(group: int, kind: int, at: int, ids: np.ndarray, labels: np.ndarray, data: np.ndarray, lo, hi, best: bytes) -> pa.RecordBatch:
    box = [None if x is None else x.tolist() for x in (lo, hi)]
    raw = [np.ascontiguousarray(x).tobytes() for x in (ids, labels, data)]
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int32()), pa.array([kind], pa.int32()), pa.array([at], pa.int64()), *(pa.array([x], pa.binary()) for x in raw), *(pa.array([x], pa.list_(pa.int64())) for x in box), pa.array([best], pa.binary())],
        names=["group", "kind", "at", "ids", "labels", "data", "lo", "hi", "best"],
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; every seventh label is moved on by one first."""
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return Miner(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("id") % 50 == 0).mine()


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), r AS (SELECT DISTINCT id, label, c FROM v),
s AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score
  FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
