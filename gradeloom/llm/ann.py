"""Approximate nearest neighbours with an inverted multi-index.

A vector is cut in two halves and each half is quantised with its own small codebook; a pair of centroids is a cell.
For a query the cells are traversed by summed distance (here the negated inner products with the two centroids) from a
heap, until the cells hold the wanted share of the index; their entries are reranked with exact inner products.

The codebooks are fitted on a bounded sample and have about an eighth of the root of the table's rows; every vector is
indexed. The share is measured: queries of the sample are compared with all of it, and the share is the least with which
the traversal meets the wanted part of their true neighbours. It is small for clustered vectors and large for vectors of
random directions. In a larger table the neighbours are nearer than in the sample, so the recall there is not lower.

Entries lie in blocks of a bounded size, whole cells side by side where they fit, so that one frequent vector never fills
a task. A block is in memory once, and the queries that visit it stream by; products are computed only for the cells
that a query visits. Nothing is copied for each block of queries.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id. An inner product
needs one length, so vectors of another length than most take no part either. Repeated ids: a query is answered once for
each vector it has, merged; a candidate counts once, with its best score. Ties go to the smaller id. Fewer candidates
than asked for: all those found. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Run, read_table

SAMPLE_ROWS = 20_000  # fitted on so many vectors at most, the first by a hash of their id
SAMPLE_QUERIES = 400
MOST_CENTROIDS = 128
BLOCK_ROWS = 4_096
QUERY_ROWS = 256
RECALL = 0.96


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part; v is an array of doubles."""
    v = F.col(vec_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return good.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Plain Lloyd iterations on the sample; empty clusters are drawn anew."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        for j in range(k):
            mine = x[near == j]
            c[j] = mine.mean(0) if len(mine) else x[rng.integers(len(x))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)


def traverse(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, want: float) -> list[tuple[int, int]]:
    """Cells in ascending order of first[i] + second[j], until they hold ``want`` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, out, have = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and have < want:
        _, i, j = heapq.heappop(heap)
        if sizes[a[i], b[j]]:
            out.append((int(a[i]), int(b[j])))
            have += int(sizes[a[i], b[j]])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))
    return out


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed from left to right, so that equal vectors get equal scores in any block."""
    return np.add.accumulate(q * x, axis=-1)[..., -1] if x.shape[-1] else np.zeros(x.shape[:-1])


def best_of(q: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int, met: np.ndarray | None = None) -> list[tuple[int, float]]:
    """The k largest products of one query, ties to the smaller id; each id once; not the query's own.

    ``rough`` holds the products up to rounding, ``met`` which entries count (all, if none is given).
    """
    ok = np.flatnonzero(ids != qid if met is None else met & (ids != qid))
    if len(ok) > 4 * k and np.isfinite(rough[ok]).all():
        cut = np.partition(rough[ok], len(ok) - k)[len(ok) - k]
        near = ok[rough[ok] >= cut - 1e-9 * (1 + abs(cut))]
        # repeated ids may fill the places, then look at all
        ok = near if len(np.unique(ids[near])) >= k else ok
    s = exact_products(q, x[ok])
    out: list[tuple[int, float]] = []
    taken = set()
    for t in np.lexsort((ids[ok], -s)):
        i = int(ids[ok[t]])
        if i not in taken:
            taken.add(i)
            out.append((i, float(s[t])))
            if len(out) == k:
                break
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Index:
    """Two codebooks, the number of entries in each cell, and how many entries a query shall meet."""

    def __init__(self, sample: np.ndarray, centroids: int) -> None:
        self.width, self.half = sample.shape[1], max(1, sample.shape[1] // 2)
        self.books = [kmeans(part.copy(), centroids) for part in (sample[:, : self.half], sample[:, self.half :])]
        self.side = len(self.books[1])
        self.sizes = np.zeros((len(self.books[0]), self.side), np.int64)
        self.want = 0.0

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.books[0]) * self.side + nearest(x[:, self.half :], self.books[1])

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return -(self.books[0] @ q[: self.half]), -(self.books[1] @ q[self.half :])

    def aim(self, sample: np.ndarray, k: int, recall: float) -> None:
        """Set ``want`` from the part of the index that comes before the true neighbours of some of the sample."""
        cell, before = self.cells(sample), []
        for i in range(0, len(sample), max(1, len(sample) // SAMPLE_QUERIES)):
            product = sample @ sample[i]
            product[i] = -np.inf
            true = np.argsort(-product, kind="stable")[: min(k, len(sample) - 1)]
            first, second = self.distances(sample[i])
            order = np.argsort((first[:, None] + second[None, :]).ravel(), kind="stable")
            passed = np.empty(len(order))
            passed[order] = np.cumsum(self.sizes.ravel()[order]) - self.sizes.ravel()[order]
            before += passed[cell[true]].tolist()
        self.want = float(np.quantile(before, recall, method="higher")) + 1 if before else 1.0

    def visits(self, q: np.ndarray) -> list[tuple[int, int]]:
        return traverse(*self.distances(q), self.sizes, self.want)


class _Block:
    """The entries of one block, sorted by cell."""

    def __init__(self, parts: list[pa.RecordBatch], width: int) -> None:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        cell = table.column("cells").flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        self.ids, self.x = table.column("id").to_numpy()[order], matrix(table.column("v"), width)[order]
        self.cells, self.starts = np.unique(cell[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(cell))
        self.at = np.repeat(np.arange(len(self.cells)), self.ends - self.starts)

    def best(self, queries: pa.RecordBatch, width: int, k: int) -> pa.RecordBatch:
        q, lists = matrix(queries.column("v"), width), queries.column("cells")
        row, cell = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        hit = self.cells[at] == cell
        visit = np.zeros((len(q), len(self.cells)), bool)
        visit[row[hit], at[hit]] = True
        rough = np.zeros((len(q), len(self.x)))
        for c in np.flatnonzero(visit.any(0)):
            rows = np.flatnonzero(visit[:, c])
            rough[rows, self.starts[c] : self.ends[c]] = q[rows] @ self.x[self.starts[c] : self.ends[c]].T
        best = [best_of(q[r], i, self.x, self.ids, rough[r], k, visit[r, self.at]) for r, i in enumerate(queries.column("id").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [queries.column("id"), queries.column("block"), pa.array([[b[0] for b in x] for x in best], pa.list_(pa.int64())), pa.array([[b[1] for b in x] for x in best], pa.list_(pa.float64()))],
            names=["query_id", "block", "ids", "scores"],
        )


def _layout(sizes: np.ndarray) -> tuple[list[int], list[int], int]:
    """For each first centroid its first block and its number of blocks, and the number of all blocks.

    Neighbouring centroids share a block while their entries fit; larger ones have several blocks of their own.
    """
    first, many, block, have = [], [], 0, 0
    for n in sizes.sum(1).tolist():
        parts = max(1, math.ceil(n / BLOCK_ROWS))
        if have and (parts > 1 or have + n > BLOCK_ROWS):
            block, have = block + 1, 0
        first.append(block)
        many.append(parts)
        block, have = (block + parts, 0) if parts > 1 else (block, have + n)
    return first, many, block + (1 if have else 0)


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest by inner product for each row where the column ``is_query`` (on the id ``id``) holds.

    ``recall``: the part of the true neighbours among the sample that the traversal shall meet.
    """
    spark = vectors.sparkSession
    run = Run(spark, "ann")
    good = run.written(usable(vectors, id_col, vec_col), "vectors")
    rows = good.count()
    sample = good.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(SAMPLE_ROWS).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], empty)
    x = np.array([r["v"] for r in sample])
    index = Index(x, min(MOST_CENTROIDS, max(4, round(math.sqrt(rows) / 8))))
    width = index.width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cells = index.cells(matrix(batch.column("v"), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["id", "v", "cell"])

    entries = run.written(good.mapInArrow(assign, "id long, v array<double>, cell int"), "entries")
    for r in entries.groupBy("cell").count().collect():  # MOST_CENTROIDS squared rows at most
        index.sizes[r["cell"] // index.side, r["cell"] % index.side] = r["count"]
    index.aim(x, k, recall)
    first, many, blocks = _layout(index.sizes)
    of = lambda table, at: F.element_at(F.array(*[F.lit(n) for n in table]), at + 1)
    lead = F.floor(F.col("cell") / index.side).cast("int")
    left = entries.select((of(first, lead) + F.pmod(F.xxhash64("id", "v"), of(many, lead)).cast("int")).alias("block"), F.lit(0).alias("kind"), "id", "v", F.array("cell").alias("cells"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells, block = [], [], []
            for i, q in enumerate(matrix(batch.column("v"), width)):
                wanted: dict[int, list[int]] = {}
                for a, b in index.visits(q):
                    for n in range(first[a], first[a] + many[a]):
                        wanted.setdefault(n, []).append(a * index.side + b)
                at += [i] * len(wanted)
                block += wanted.keys()
                cells += wanted.values()
            some = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([1] * len(at), pa.int32()), *some.columns, pa.array(cells, pa.list_(pa.int32()))], names=["block", "kind", "id", "v", "cells"])

    shape = "block int, kind int, id long, v array<double>, cells array<int>"
    # the traversal is the costly part, so queries are dealt anew
    right = good.filter(is_query).repartition(max(1, min(blocks, rows // QUERY_ROWS))).mapInArrow(visit, shape)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("block").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if key[a] // 2 != now:
                    now, parts, block = key[a] // 2, [], None
                if key[a] % 2 == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    block = block or _Block(parts, width)
                    for s in range(a, b, QUERY_ROWS):
                        yield block.best(batch.slice(s, min(QUERY_ROWS, b - s)), width, k)

    both = left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "kind")
    parts = both.mapInArrow(rerank, "query_id long, block int, ids array<long>, scores array<double>")
    # k entries at most from each block; merged in two steps, so that no row holds more than the root of them
    best = F.transform(F.arrays_zip("ids", "scores"), lambda z: F.struct((-z["scores"]).alias("s"), z["ids"].alias("i")))
    some = parts.select("query_id", F.pmod("block", F.lit(math.isqrt(blocks) + 1)).alias("part"), best.alias("all"))
    some = some.groupBy("query_id", "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("all"))
    some = some.select("query_id", F.slice(_first_of_each("all"), 1, k).alias("all"))
    merged = some.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("all")))).alias("all"))
    merged = merged.select("query_id", F.slice(_first_of_each("all"), 1, k).alias("all"))
    return run.finish(
        merged.select("query_id", F.posexplode("all").alias("pos", "n")).select(
            "query_id", (F.col("pos") + 1).alias("rank"), F.col("n.i").alias("vec_id"), (-F.col("n.s")).alias("score")
        )
    )


def _first_of_each(name: str):
    """Of sorted (s, i) keep the first for each i. A repeated id with other vectors is the only case that shortens."""
    ids = F.transform(F.col(name), lambda z: z["i"])
    return F.filter(F.col(name), lambda z, p: F.array_position(ids, z["i"]) == (p + 1).cast("long"))


def brute_force(rows: list[tuple[int, list[float]]], queries: set[int], k: int = 20) -> set[tuple[int, int, int]]:
    """(query, rank, id) over all pairs; for tests and for measuring the recall."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = set()
    for q in queries:
        v = x[np.flatnonzero(ids == q)[0]]
        out |= {(q, n + 1, i) for n, (i, _) in enumerate(best_of(v, q, x, ids, x @ v, k))}
    return out


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all others."""
    return search(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
