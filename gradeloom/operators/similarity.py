"""Copied work: handouts, boilerplate, exact groups and an exact set-similarity join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import expr as X
from gradeloom.operators.tables import landed


def stream_boilerplate(cells: DataFrame, min_students: int = 10, min_share: float = 0.3) -> DataFrame:
    """Bodies (hw, body) held by many distinct students (hw, key, body) of a topic.

    Many: at least ``min_students`` and ``min_share`` of the topic's students, rounded half-even.
    """
    n = cells.select("hw", "key").distinct().groupBy("hw").agg(F.count("*").alias("students"))
    held = cells.filter(F.col("body") != "").dropDuplicates(["hw", "key", "body"]).groupBy("hw", "body").agg(F.count("*").alias("holders"))
    need = F.greatest(F.lit(min_students), F.bround(F.col("students") * min_share, 0))
    return held.join(n, "hw").filter(F.col("holders") >= need).select("hw", "body", "holders")


def handout_union(handouts: DataFrame) -> DataFrame:
    """Distinct bodies of all handouts of a topic."""
    return handouts.select("hw", "body").distinct()


def subtract_handout(cells: DataFrame, template: DataFrame) -> DataFrame:
    """Cells whose body is in no handout of their topic."""
    return cells.join(template.select("hw", "body").distinct(), ["hw", "body"], "left_anti")


def fingerprints(cells: DataFrame, least: int = 120) -> DataFrame:
    """(hw, key, fp) of the cells a student added; null fingerprints are left out."""
    return cells.groupBy("hw", "key").agg(X.fingerprint(F.collect_list("body"), least).alias("fp")).filter("fp is not null")


def exact_clusters(works: DataFrame) -> DataFrame:
    """Groups of equal fingerprints as (hw, fp, first, n): their size, without their pairs."""
    return works.groupBy("hw", "fp").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1")


def exact_pairs(works: DataFrame) -> DataFrame:
    """Every unordered pair of works of a topic with the same fingerprint.

    A group of n copies has n (n - 1) / 2 pairs; ``exact_members`` says the same in n rows.
    """
    a, b = works.select("hw", "fp", F.col("key").alias("a")), works.select("hw", "fp", F.col("key").alias("b"))
    return a.join(b, ["hw", "fp"]).filter("a < b").select("hw", "a", "b", F.lit("exact").alias("kind"), F.lit(1.0).alias("similarity"))


def exact_members(works: DataFrame) -> DataFrame:
    """(hw, key, first, n): each copy with the first work of its group; linear in the works."""
    return works.join(exact_clusters(works), ["hw", "fp"]).select("hw", "key", "first", "n")


def hashed_sets(works: DataFrame) -> DataFrame:
    """(hw, key, s): the distinct shingles of each work as sorted 64-bit hashes; shingles that are numbers are hashes already."""
    numbers = works.schema["shingles"].dataType.elementType.typeName() == "long"
    of = F.col("shingles") if numbers else F.transform("shingles", lambda s: F.xxhash64(s))
    return works.select("hw", "key", F.array_sort(F.array_distinct(of)).alias("s"))


def near_pairs(works: DataFrame, t: float = 0.8, min_size: int = 1) -> DataFrame:
    """Pairs (hw, a, b, similarity) of works (hw, key, shingles) with a Jaccard similarity of at least ``t``.

    Exact on 64-bit hashes: shingles have one order for all works; two sets as similar as ``t`` share one of the first
    ``n - ceil(t * n) + 1``, so only these meet, and only in blocks of like lengths, which also cuts a frequent shingle's works apart.
    The order is by hash with the frequent ones last (``frequent``). What two prefixes share and what is left behind them bound the whole
    overlap; pairs that cannot reach it go before any set is read. Candidates are verified on whole sets.
    """
    sets = landed(hashed_sets(works), "near-sets")
    return _near(sets, _keyed(sets, t, min_size), t)


# Only the order of shingles is taken from a share of the works: one in SHARE is counted, at most FREQUENT shingles are told apart.
SHARE, FREQUENT = 32, 100_000
# So many candidates at most are looked up by a broadcast of their numbers.
FEW = 1_000_000


def frequent(sets: DataFrame, share: int = SHARE, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest counts in one of ``share`` works, sorted, with these counts; ``most`` of them at most.

    The share is drawn by hash, so it grows with the works and reruns agree. Any order of shingles gives the same pairs; this one keeps the
    prefixes of different works apart.
    """
    some = sets.filter(F.pmod(F.xxhash64("hw", "key", F.lit("share")), F.lit(share)) == 0)
    counted = landed(some.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").cast("int").alias("c")).filter("c > 1"), "near-frequent")
    sizes = counted.groupBy("c").agg(F.count("*").alias("rows")).collect()  # few distinct counts
    least, room = 2, most
    for r in sorted(sizes, key=lambda r: -r["c"]):
        if r["rows"] > room:
            least = r["c"] + 1
            break
        room -= r["rows"]
    table = counted.filter(F.col("c") >= least).toArrow()
    h, c = (table.column(k).to_numpy() for k in ("h", "c"))
    order = np.argsort(h)
    return h[order], c[order]


def prefixes(offsets: np.ndarray, values: np.ndarray, keep: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``keep`` values of each list; how many of them come before the frequent ones (1 at least); the order's place of the last of these.

    Lists are sorted; values of ``often`` stand behind all others, by their counts. Places are numbers that do not fall as the order rises.
    """
    n = np.diff(offsets)
    of = np.repeat(np.arange(len(n)), n)
    counts = np.zeros(len(values), np.int64)
    if len(often[0]):
        at = np.minimum(np.searchsorted(often[0], values), len(often[0]) - 1)
        counts = np.where(often[0][at] == values, often[1][at], 0)
    values, counts = (x[np.argsort((of << 32) + counts, kind="stable")] for x in (values, counts))
    end = np.clip(np.bincount(of, counts == 0, len(n)).astype(np.int64), 1, keep)
    last = np.cumsum(n) - n + end - 1
    place = np.where(counts[last] > 0, (1 << 30) + np.minimum(counts[last], 1 << 29), values[last] >> 33).astype(np.int32)
    return values[np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(keep, n)], end, place


def _keyed(sets: DataFrame, t: float, min_size: int) -> DataFrame:
    """(hw, key, n, _x, _y, end, last, p): size and two hashes of each set, and its prefix; a table."""
    often = sets.sparkSession.sparkContext.broadcast(frequent(sets))
    known = sets.filter(F.size("s") >= max(1, min_size)).select("hw", "key", F.size("s").alias("n"), F.xxhash64("s").alias("_x"), F.xxhash64(F.lit(1), "s").alias("_y"), "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1_000):
                batch = whole.slice(k, 1_000)
                s, n = batch.column("s"), batch.column("n").to_numpy().astype(np.int64)
                offsets = s.offsets.to_numpy().astype(np.int64)
                keep = n - np.ceil(n * t - 1e-9).astype(np.int64) + 1
                p, end, last = prefixes(offsets - offsets[0], s.values.to_numpy()[offsets[0] : offsets[-1]], keep, often.value)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)), pa.int32()), pa.array(p))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(end.astype(np.int32)), pa.array(last), lists], names=[*batch.schema.names[:5], "end", "last", "p"])

    schema = T.StructType([*known.schema.fields[:5], T.StructField("end", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("p", T.ArrayType(T.LongType()))])
    return landed(known.mapInArrow(run, schema), "near-keys")


def _near(sets: DataFrame, keyed: DataFrame, t: float) -> DataFrame:
    """``near_pairs`` between the works of ``keyed`` (hw, key, n, last, p), from tables. Works and shingles travel as numbers."""
    # sets within the ratio t are in one block of lengths or in neighbouring ones
    block = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(t)) + 1e-9).cast("int") if t < 1 else F.col("n")
    rows = keyed.select(F.xxhash64("hw", "key").alias("id"), "hw", "n", "end", "last", F.posexplode("p").alias("rank", "h"))
    # a shingle counts in its topic only; those that no other prefix has meet nothing
    rows = rows.select(F.xxhash64("hw", "h").alias("h"), "id", "n", "end", "last", (F.col("rank") + 1).alias("rank"))
    prefix = landed(rows.withColumn("_f", F.count("*").over(Window.partitionBy("h"))).filter("_f > 1").drop("_f"), "near-prefixes").withColumn("block", block)
    near = F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)) if t < 1 else F.col("block")
    a = prefix.select("h", F.col("id").alias("ia"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("end").alias("ea"), F.col("last").alias("la"), "block")
    b = prefix.select("h", F.col("id").alias("ib"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("end").alias("eb"), F.col("last").alias("lb"), near.alias("block"))
    close = (F.col("ia") < F.col("ib")) & (F.col("na") >= F.col("nb") * t - 1e-9) & (F.col("nb") >= F.col("na") * t - 1e-9)
    need = F.ceil((F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)
    # sets that share ``need`` share one of their first n - need + 1; frequent shingles behind these are not paired, nor counted below
    counted = (F.col("ra") <= F.col("ea")) & (F.col("rb") <= F.col("eb"))
    first = (F.col("ra") <= F.col("na") - need + 1) & (F.col("rb") <= F.col("nb") - need + 1)
    met = a.join(b, ["h", "block"]).filter(close & (counted | first))
    top = lambda r: F.coalesce(F.max(F.when(counted, F.col(r))), F.lit(0)).alias(r)
    seen = met.groupBy("ia", "ib", "na", "nb", "ea", "eb", "la", "lb").agg(F.count_if(counted).alias("c"), top("ra"), top("rb"))
    # beyond the last counted shingle no more can be shared than stands behind it on either side; and what the part that ends before the
    # other one has not shared is not shared at all
    behind = lambda x: F.col(f"n{x}") - F.col(f"e{x}")
    left = F.when(F.col("la") < F.col("lb"), behind("a")).when(F.col("lb") < F.col("la"), behind("b")).otherwise(F.greatest(behind("a"), behind("b")))
    cand = landed(seen.filter(F.col("c") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb"), left) >= need).select("ia", "ib"), "near-candidates")
    checked = _compared(sets, cand).filter(F.col("hw_a").eqNullSafe(F.col("hw_b")) & (F.col("k_a") != F.col("k_b"))).withColumn("sim", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    return checked.filter(F.col("sim") >= t).select(F.col("hw_a").alias("hw"), F.least("k_a", "k_b").alias("a"), F.greatest("k_a", "k_b").alias("b"), F.lit("near").alias("kind"), F.bround("sim", 3).alias("similarity"))


# Pairs of a work with more partners than this are dealt over CELLS times CELLS cells.
PARTNERS, CELLS = 64, 16


def _compared(sets: DataFrame, cand: DataFrame) -> DataFrame:
    """(hw_a, hw_b, k_a, k_b, na, nb, both) of the candidates (ia, ib): the sizes of their whole sets and of what they share.

    Pairs that hang together are compared in one cell, to which each of their sets goes once and not with each pair. A large group is
    many cells, so none holds more than a part of it.
    """
    w = Window.partitionBy("ib")
    cell = F.when(F.count("*").over(w) > PARTNERS, F.xxhash64(F.pmod("ia", F.lit(CELLS)), F.pmod("ib", F.lit(CELLS)))).otherwise(0)
    pairs = cand.select(F.xxhash64(F.min("ia").over(w), cell).alias("cell"), "ia", "ib")
    ids = landed(cand.select(F.explode(F.array("ia", "ib")).alias("id")).distinct(), "near-ids")
    few = F.broadcast(ids) if ids.count() <= FEW else ids
    picked = sets.withColumn("id", F.xxhash64("hw", "key")).join(few, "id", "left_semi")
    sent = pairs.select("cell", F.explode(F.array("ia", "ib")).alias("id")).distinct().join(picked, "id")
    rows = sent.select("cell", F.col("id").alias("ia"), F.lit(None).cast("long").alias("ib"), "hw", "key", "s").unionByName(pairs, allowMissingColumns=True)

    def run(cell: pa.Table) -> pa.Table:
        whole = cell.column("ib").is_null()
        of, todo = cell.filter(whole), cell.filter(pc.invert(whole))
        of = of.take(pc.sort_indices(of, [("ia", "ascending")]))
        at = of.column("ia").to_numpy()
        s = of.column("s").combine_chunks()
        offsets, values = s.offsets.to_numpy(), s.values.to_numpy()
        span = [np.searchsorted(at, todo.column(c).to_numpy(), side) for c in ("ia", "ib") for side in ("left", "right")]
        found = [(i, j) for a, b, c, d in zip(*span) for i in range(a, b) for j in range(c, d)]  # one, unless a key is repeated
        both = [len(np.intersect1d(values[offsets[i] : offsets[i + 1]], values[offsets[j] : offsets[j + 1]], assume_unique=True)) for i, j in found]
        i, j = (np.array([x[k] for x in found], np.int64) for k in (0, 1))
        n = np.diff(offsets).astype(np.int32)
        return pa.table([of.column("hw").take(i), of.column("hw").take(j), of.column("key").take(i), of.column("key").take(j), pa.array(n[i]), pa.array(n[j]), pa.array(both, pa.int32())], names=["hw_a", "hw_b", "k_a", "k_b", "na", "nb", "both"])

    kind = {f.name: f.dataType for f in sets.schema.fields}
    types = [("hw_a", kind["hw"]), ("hw_b", kind["hw"]), ("k_a", kind["key"]), ("k_b", kind["key"]), *((c, T.IntegerType()) for c in ("na", "nb", "both"))]
    return rows.groupBy("cell").applyInArrow(run, T.StructType([T.StructField(*x) for x in types]))


def near_pairs_of_classes(works: DataFrame, t: float = 0.8, min_size: int = 1) -> tuple[DataFrame, DataFrame]:
    """Near pairs between the first works of equal sets, and the membership (hw, key, first).

    Large groups of copies cost one row for each copy; no link between different sets is lost. Sets are equal if their sizes and two
    64-bit hashes of their sorted members are. Shingles are made once: the sets are landed.
    """
    return near_pairs_of_all(works, t, min_size)[:2]


def near_pairs_of_all(works: DataFrame, t: float = 0.8, min_size: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``near_pairs_of_classes`` and the works (hw, key) without a shingle."""
    sets = landed(hashed_sets(works), "near-sets")
    same = ["hw", "n", "_x", "_y"]
    keyed = _keyed(sets, t, min_size)
    first = keyed.groupBy(*same).agg(F.min("key").alias("first"))
    members = landed(keyed.select("key", *same).join(first, same).select("hw", "key", "first"), "near-members")
    classes = keyed.join(members.filter("key = first").select("hw", "key"), ["hw", "key"], "left_semi")
    return _near(sets, classes, t), members, sets.filter(F.size("s") == 0).select("hw", "key")


def symmetrise(pairs: DataFrame) -> DataFrame:
    """Each pair from both sides."""
    return pairs.select("hw", F.col("a").alias("me"), F.col("b").alias("other")).unionByName(pairs.select("hw", F.col("b").alias("me"), F.col("a").alias("other")))


def order_pairs(pairs: DataFrame) -> DataFrame:
    """K08."""
    return pairs.orderBy(F.desc("similarity"), "hw", "a", "b")


def first_added(log: DataFrame) -> DataFrame:
    """The earliest commit that added a file, by (key, path)."""
    return log.groupBy("key", "path").agg(F.min("at").alias("added_at"))


def who_was_first(pairs: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs with the earlier side, from (hw, key, added_at); null where a time is missing."""
    side = lambda s: added.select("hw", F.col("key").alias(s), F.col("added_at").alias(f"at_{s}"))
    rows = pairs.join(side("a"), ["hw", "a"], "left").join(side("b"), ["hw", "b"], "left")
    return rows.withColumn("first", X.earlier_of(F.col("a").cast("string"), F.col("at_a"), F.col("b").cast("string"), F.col("at_b")))
