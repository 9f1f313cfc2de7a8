"""Near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct word shingles; a signature of ``COORDS`` minwise values stands for it. Documents
with equal sets are one class, and only classes are compared. Each of ``TREES`` independent trees branches the classes
by chosen minwise values: the root by one coordinate and then by ``CHILDREN`` coordinates drawn from the node's own
hash, and so on below for large nodes. Nodes of at most ``NODE_ROWS`` classes are compared exhaustively: pairs whose
signatures agree often enough form candidate groups, equal groups of different trees are compared once, and the links
are confirmed on the full sets.

A pair of similarity 0.8 shares the root of one tree with probability 0.8 and a child with 0.96 for each level, so nine
trees miss it with a probability of about 2e-6, if its nodes are small after the first level.

A node that hardly shrinks holds copies of one another, which no token separates. It is cut into blocks that share a few
pivots; blocks and pivots are compared like small nodes, which joins nearly all its members. Members that stay apart
from the node's largest component are then compared with all blocks of the node, so that no link is lost there. This
last step costs the number of such members times the node's size, in blocks of ``DENSE_ROWS``.
Links are emitted as stars of the components of one task. Components of all links come from rounds that join the links
of a task by union-find, give each class the least class it is linked with and keep only links between different ones.

Null and empty texts have an empty set, which is linked with nothing. A text with fewer words than a shingle has one
shingle: all its words. Repeated rows have equal sets, so they share a component. Extra columns are left alone, whatever
their names; empty tables give an empty result. Sets hold 64-bit hashes of shingles, rows are found again by their place
(a 64-bit hash of the file's path, and the row).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Run, chunks, join_unique, matching, read_table, with_locator

COORDS = 64
TREES = 9
CHILDREN = 2
NODE_ROWS = 128
DENSE_ROWS = 512
PIVOTS = 4
MAX_DEPTH = 8
# Rows of two or three numbers and a digest: about 60 bytes each, so a broadcast has at most 12 MB.
BROADCAST_ROWS = 200_000
# Sets of one candidate group that are in memory at once: 32 MB of hashes.
GROUP_SHINGLES = 4_000_000
# Words whose hashes a task keeps: about 20 MB.
KEPT_WORDS = 150_000
# Classes whose links a task keeps before it emits them.
FOREST_ROWS = 500_000
# A pair at the threshold agrees in 0.8 * 64 = 51 of the coordinates, with a deviation of 3.2.
DEVIATIONS = 4.75

_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]


class _Words(dict):
    """64-bit hashes of words; keeps those of the first KEPT_WORDS words, as frequent ones come early."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, width: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of ``width`` words; A-Z count as a-z."""
    found = text.encode().lower().split()  # bytes: only A-Z change, only space and controls 9 to 13 separate
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mixed(out * _MIX[0] + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of COORDS hash functions over the set, as 32-bit integers."""
    a, b = _coefficients_cached()
    best = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        part = shingles[k : k + 2048]
        best = np.minimum(best, (part[None, :] * a[:, None] + b[:, None]).min(1))
    return (best >> np.uint64(16)).astype(np.uint32).view(np.int32)


_COEFFICIENTS: list[tuple[np.ndarray, np.ndarray]] = []


def _coefficients_cached() -> tuple[np.ndarray, np.ndarray]:
    if not _COEFFICIENTS:
        _COEFFICIENTS.append(_coefficients())
    return _COEFFICIENTS[0]


def sketches(docs: DataFrame, place: str, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, loc, n, digest, sig, low): size, identity and signature of each document's set; empty sets have no digest.

    ``low`` holds the last byte of each minwise value: enough to compare two signatures, a quarter of the size.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(place).alias("loc"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch, texts in chunks(batches, "_text", 1_000_000):
            sets = [shingle_set(t, width, words) for t in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s) if len(s) else None for s in sets]
            low = [None if x is None else x.astype(np.uint8).tobytes() for x in sigs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.list_(pa.int32())), pa.array(low, pa.binary())],
                names=["id", "loc", "n", "digest", "sig", "low"],
            )

    return rows.mapInArrow(run, "id long, loc struct<file:bigint,row:bigint>, n long, digest binary, sig array<int>, low binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, pa.Table]]:
    """Rows of equal ``cluster``, from batches that are sorted by it; a cluster has a bounded number of rows."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None and len(rest) else table
        if not len(table):
            continue
        keys = table.column("cluster").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield keys[a], table.slice(a, b - a)
        rest = table.slice(cuts[-2])
    if rest is not None and len(rest):
        yield rest.column("cluster")[0].as_py(), rest


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)

    def groups(self) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for i in range(len(self.up)):
            out.setdefault(self.find(i), []).append(i)
        return [g for g in out.values() if len(g) > 1]


class _Forest:
    """Union-find over keys; the smallest key of a component is its root. Only other keys have an entry."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        root = x
        while root in self.up:
            root = self.up[root]
        while x != root:
            above = self.up[x]
            self.up[x] = root
            x = above
        return root

    def join(self, x, y) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> pa.RecordBatch:
        """(a, b): the root of each key that has one, and forget them."""
        b = list(self.up)
        a = [self.find(x) for x in b]
        self.up.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _bounded(group: list[int], n: list[int], percent: int) -> list[list[int]]:
    """The group, or if its sets are too large to be in memory at once, parts of it that hold every pair of like size."""
    if sum(n[i] for i in group) <= GROUP_SHINGLES:
        return [group]
    parts: list[list[int]] = [[]]
    have = 0
    for i in sorted(group, key=lambda i: n[i]):
        if parts[-1] and have + n[i] > GROUP_SHINGLES // 2:
            parts.append([])
            have = 0
        parts[-1].append(i)
        have += n[i]
    near = lambda p, q: 100 * n[p[-1]] >= percent * n[q[0]]
    pairs = [p + q for k, p in enumerate(parts) for q in parts[k + 1 :] if near(p, q)]
    return pairs + [p for p in parts if len(p) > 1]


def _candidates(least: int, percent: int):
    """Groups of classes in a cluster that agreeing signatures connect, keyed by their content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list] = ([], [])
        for _, table in _runs(batches):
            digest = table.column("digest").to_pylist()
            if len(set(digest)) < len(digest):  # pivots are in their own block too
                first = {d: i for i, d in reversed(list(enumerate(digest)))}
                table = table.take(sorted(first.values()))
                digest = table.column("digest").to_pylist()
            if len(digest) < 2:
                continue
            sig = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(digest), COORDS)
            sets = _Sets(len(digest))
            for i in range(len(digest) - 1):
                for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= least):
                    sets.join(i, i + 1 + int(j))
            n = table.column("n").to_pylist()
            for group in sets.groups():
                for part in _bounded(group, n, percent):
                    members = sorted(digest[i] for i in part)
                    out[0].extend([xxhash.xxh3_64_intdigest(b"".join(members)) - (1 << 63)] * len(members))
                    out[1].extend(members)
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["cluster", "digest"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["cluster", "digest"])

    return run


def _similar(shingles: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions whose sets are similar enough. Larger groups count all intersections by matrix products."""
    n = len(shingles)
    size = np.array([len(s) for s in shingles])
    if n <= 16:
        for i in range(n):
            for j in range(i):
                if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(shingles[i], shingles[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        yield i, j
        return
    _, column, times = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times[column] > 1  # a shingle of one set alone is in no intersection
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):  # a bounded number of shingles at a time
        a, b = np.searchsorted(column, (lo, lo + 8192))
        if a < b:
            part, at = np.unique(column[a:b], return_inverse=True)
            bits = np.zeros((n, len(part)), np.float32)
            bits[row[a:b], at] = 1
            both += bits @ bits.T
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    yield from zip(*(x.tolist() for x in np.nonzero(np.tril(near, -1))))


def _confirm(width: int, percent: int):
    """Links inside candidate groups, checked on full sets; as stars of the components that a task has found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, forest = _Words(), _Forest()
        for _, table in _runs(batches):
            digest = table.column("digest").to_pylist()
            shingles = [shingle_set(t or "", width, words) for t in table.column("text").to_pylist()]
            for i, j in _similar(shingles, percent):
                forest.join(digest[i], digest[j])
            if len(forest.up) > FOREST_ROWS:
                yield forest.stars()
        yield forest.stars()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars of their components."""
    forest = _Forest()
    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            forest.join(a, b)
        if len(forest.up) > FOREST_ROWS:
            yield forest.stars()
    yield forest.stars()


def _small_or_big(run: Run, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes to compare, once for each content, and rows of larger nodes with their size."""
    sizes = run.written(frontier.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    met = run.written(join_unique(run, frontier, sizes, "node", sizes=sizes), "met")  # classes alone in a node are done with it
    small = met.filter(F.col("size") <= NODE_ROWS)
    content = small.groupBy("node", "size").agg(F.bit_xor(F.xxhash64("digest")).alias("x1"), F.bit_xor(F.xxhash64("digest", F.lit(3))).alias("x2"))
    once = content.groupBy("size", "x1", "x2").agg(F.min("node").alias("node")).select("node")
    return small.join(once, "node", "left_semi").select(F.col("node").alias("cluster"), "digest"), met.filter(F.col("size") > NODE_ROWS)


def _children(node, sig: str):
    """Keys of a node's children for a class: its values at CHILDREN coordinates drawn from the node's hash."""
    coord = lambda j: F.pmod(F.xxhash64(node, F.lit(j)), F.lit(COORDS - TREES)).cast("int") + TREES + 1
    return F.array(*[F.xxhash64(node, coord(j), F.element_at(sig, coord(j))) for j in range(CHILDREN)])


def _blocks(dense: DataFrame) -> DataFrame:
    """Blocks of dense nodes with the node's pivots in each: (cluster, digest)."""
    n = F.ceil(F.col("size") / DENSE_ROWS).cast("int")
    own = dense.select(F.xxhash64("node", F.pmod(F.xxhash64("digest"), n)).alias("cluster"), "digest")
    pivots = dense.groupBy("node", "size").agg(*[F.min(F.struct(F.xxhash64("digest", F.lit(k)), "digest")).alias(f"p{k}") for k in range(PIVOTS)])
    every = F.array_distinct(F.array(*[F.col(f"p{k}.digest") for k in range(PIVOTS)]))
    pivots = pivots.select("node", every.alias("every"), F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("block"))
    pivots = pivots.select("node", "block", F.explode("every").alias("digest"))
    return own.unionByName(pivots.select(F.xxhash64("node", "block").alias("cluster"), "digest"))


def _if_few(table: DataFrame) -> DataFrame:
    """A written table of rows of a fixed size, marked for broadcast if it has at most BROADCAST_ROWS of them."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _merged(run: Run, dense: DataFrame) -> DataFrame:
    """Dense nodes that share their least member as one node: a group of copies is a node of most trees.

    A union of nodes holds every pair of each of them.
    """
    dense = run.written(dense, "dense")
    key = run.written(dense.groupBy("node").agg(F.min(F.xxhash64("digest", F.lit(17))).alias("group")), "dense-keys")
    rows = join_unique(run, dense.select("node", "digest"), key, "node").select(F.col("group").alias("node"), "digest").distinct()
    rows = run.written(rows, "dense-rows")
    sizes = run.written(rows.groupBy("node").agg(F.count("*").alias("size")), "dense-sizes")
    return run.written(join_unique(run, rows, sizes, "node", sizes=sizes).select("node", "size", "digest"), "dense-merged")


def _links(run: Run, clusters: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes that meet in a cluster; ``texts`` has the columns loc and text."""
    least = int(percent / 100 * COORDS - DEVIATIONS * (percent / 100 * (1 - percent / 100) * COORDS) ** 0.5)
    rows = clusters.join(classes.select("digest", "n", "low"), "digest").select("cluster", "digest", "n", "low")
    found = rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_candidates(least, percent), "cluster long, digest binary")
    found = run.written(found.dropDuplicates(["cluster", "digest"]), "found")
    # only the texts of candidates are moved; each table here is broadcast if it has few rows, else both sides are shuffled
    wanted = run.written(found.select("digest").distinct().join(classes.select("digest", "loc"), "digest"), "wanted")
    pairs = texts.join(_if_few(wanted), "loc").select("digest", "text").join(_if_few(found), "digest")
    confirmed = pairs.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_confirm(width, percent), "a binary, b binary")
    return run.written(confirmed, "links")


def components(run: Run, links: DataFrame) -> DataFrame:
    """(digest, root) for every class but the roots; the root is the smallest digest of its component.

    In each round the links of a task become stars, dealt by their member, which few tasks share. Then each class stands
    for the least class it is linked with, and links between classes that stand for the same one are settled and go. As
    digests are random, at least about half of the classes go with them; few links are one task's, and done at once.
    """
    rounds = []
    while True:
        edges = run.written(links.repartition("b").mapInArrow(_joined, "a binary, b binary"), "edges")
        if edges.isEmpty():
            break
        least = run.written(edges.groupBy("b").agg(F.min("a").alias("to")), "least")
        rounds.append(least)
        ends = run.written(edges.join(least, "b").select("a", F.col("to").alias("b")), "ends")
        ends = join_unique(run, ends, least.select(F.col("b").alias("a"), "to"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        links = ends.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = edges.select(F.col("b").alias("digest"), F.col("a").alias("root"))  # none
    for least in reversed(rounds):
        onward = join_unique(run, least, labels.withColumnRenamed("digest", "to"), "to", "left")
        own = onward.select(F.col("b").alias("digest"), F.coalesce("root", "to").alias("root"))
        labels = run.written(own.unionByName(labels.join(least, F.col("digest") == F.col("b"), "left_anti")), "labels")
    return labels


def _rest_of_dense(run: Run, dense: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Clusters that bring the members outside a dense node's largest component together with all its members."""
    member = run.written(dense.join(labels, "digest", "left").withColumn("label", F.coalesce("root", "digest")).drop("root"), "members")
    count = member.groupBy("node", "label").agg(F.count("*").alias("count"))
    per_node = count.groupBy("node").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("all"))
    outside = F.col("all") - F.col("m.count")
    half = DENSE_ROWS // 2
    mixed = per_node.filter(outside > 0).select("node", F.col("m.label").alias("main"), F.ceil(outside / half).cast("int").alias("parts"))
    member = run.written(join_unique(run, member, run.written(mixed, "mixed"), "node"), "mixed-members")
    if member.isEmpty():
        return None
    n = F.ceil(F.col("size") / half).cast("int")
    left = member.filter("label != main").select(F.col("node"), F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), "digest")
    right = member.select(F.col("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("digest"), n).alias("block"), "digest")
    return left.unionByName(right).select(F.xxhash64("node", F.col("part").cast("int"), F.col("block").cast("int")).alias("cluster"), "digest")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, loc, n, first): each row's set size and the smallest (id, locator) of its component.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.
    """
    placed, place = with_locator(docs, "near-landed")
    return _near(placed, place, width, percent, id_col, text_col)


def _near(docs: DataFrame, place: str, width: int, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for documents whose place is in the column ``place``."""
    run = Run(docs.sparkSession, "near")
    texts = docs.select(F.col(place).alias("loc"), F.col(text_col).alias("text"))
    rows = run.written(sketches(docs, place, width, id_col, text_col), "sketches")
    some = rows.filter("digest is not null")
    classes = some.groupBy("digest").agg(F.min(F.struct("id", "loc")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"))
    classes = run.written(classes.select("digest", "first", "n", "sig", "low", F.col("first.loc").alias("loc")), "classes")
    roots = F.transform(F.slice("sig", 1, TREES), lambda v, i: _children(F.xxhash64(i, v), "sig"))
    frontier = run.written(classes.select("digest", F.explode(F.flatten(roots)).alias("node"), F.lit(None).cast("long").alias("above")), "frontier")
    clusters, dense = [], []
    for depth in range(1, MAX_DEPTH + 1):
        small, big = _small_or_big(run, frontier)
        clusters.append(small)
        if big.isEmpty():
            break
        still = F.coalesce(F.col("size") * 2 >= F.col("above"), F.lit(False)) | F.lit(depth == MAX_DEPTH)
        dense.append(big.filter(still).select("node", "size", "digest"))
        split = _if_few(run.written(big.filter(~still), "split"))
        split = classes.select("digest", "sig").join(split, "digest")
        frontier = run.written(split.select("digest", F.explode(_children(F.col("node"), "sig")).alias("node"), F.col("size").alias("above")), "frontier")
    dense_rows = _merged(run, reduce(DataFrame.unionByName, dense)) if dense else None
    if dense_rows is not None:
        clusters.append(_blocks(dense_rows))
    links = _links(run, reduce(DataFrame.unionByName, clusters), classes, texts, width, percent)
    labels = components(run, links)
    if dense_rows is not None and (rest := _rest_of_dense(run, dense_rows, labels)) is not None:
        labels = components(run, links.unionByName(_links(run, rest, classes, texts, width, percent)))
    named = classes.join(labels, "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "first")
    named = run.written(named, "named")
    least = run.written(named.groupBy("root").agg(F.min("first").alias("least")), "least-of-root")
    named = join_unique(run, named.select("digest", "root"), least, "root").select("digest", "least")
    found = join_unique(run, some.select("id", "loc", "n", "digest"), run.written(named, "least-of-class"), "digest")
    found = found.select("id", "loc", "n", F.col("least").alias("first"))
    return run.finish(found.unionByName(rows.filter("digest is null").select("id", "loc", "n", F.struct("id", "loc").alias("first"))))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their component by two-word shingles."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), width=2)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), F.col("id").eqNullSafe(F.col("first.id")).alias("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component by five-word shingles stays, the one with the smallest id."""
    placed, place = with_locator(docs, "near-landed")
    kept = _near(placed, place, width=5).filter(F.struct("id", "loc") == F.col("first")).select(F.col("loc").alias(place))
    return matching(placed, kept, place, "left_semi").select(*[placed[f"`{c}`"] for c in docs.columns])


def brute_force(texts: list[tuple[int, str | None]], width: int = 2, percent: int = 80) -> dict[int, int]:
    """Component of each id by comparing all pairs of word tuples; for tests."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    groups = _Sets(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                groups.join(i, j)
    least: dict[int, int] = {}
    for i, (k, _) in enumerate(texts):
        r = groups.find(i)
        least[r] = min(least.get(r, k), k)
    return {k: least[groups.find(i)] for i, (k, _) in enumerate(texts)}
