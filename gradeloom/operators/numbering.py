"""Ranges of an order with explicit bounds, and numbers made of them; no task sorts more than a range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 20  # rows sampled for each range


def tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounds(df: DataFrame, *order: str, ranges: int | None = None) -> DataFrame:
    """One row with the bounds of about ``ranges`` ranges of ``order``: ``_bounds``, sorted and cut into pieces of about their root.

    They come from a sample of SAMPLES rows for each range, drawn once: the table is local and its rows are literals of every plan that
    uses it, so all uses agree whatever else they read.
    """
    ranges = ranges or tasks(df)
    key = df.select(F.struct(*[F.col(c) for c in order]).alias("b"))
    sample = key.orderBy(F.rand(11)).limit(ranges * SAMPLES).orderBy("b").collect()
    picked = [sample[i]["b"] for i in range(SAMPLES, len(sample), SAMPLES)]
    cut = list(dict.fromkeys(picked))
    step = max(1, math.isqrt(len(cut)))
    kind = key.schema["b"].dataType.simpleString()
    pieces = [cut[i : i + step] for i in range(0, len(cut), step)]
    return df.sparkSession.createDataFrame([(pieces, step)], f"_bounds array<array<{kind}>>, _step int")


def in_ranges(df: DataFrame, *order: str, ranges: int | None = None, name: str = "_part") -> DataFrame:
    """``df`` with the number of its range (``name``): the bounds below the row's key, looked up by piece and then within it."""
    key = F.struct(*[F.col(c) for c in order])
    below = lambda a: F.size(F.filter(a, lambda b: b < key))
    piece = F.size(F.filter("_bounds", lambda p: p[0] < key))
    part = F.when(piece == 0, 0).otherwise((piece - 1) * F.col("_step") + below(F.get("_bounds", piece - 1)))
    # one row, a few bounds for each task
    return df.crossJoin(F.broadcast(bounds(df, *order, ranges=ranges))).withColumn(name, part.cast("int")).drop("_bounds", "_step")


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """1..n in a global order: ranges are sorted apart and offset by the counts of those before."""
    ranged = in_ranges(df, *order)
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    w = Window.partitionBy("_part").orderBy(*order)
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))
    return ranged.join(offsets, "_part").withColumn(name, F.row_number().over(w) + F.col("_before")).drop("_part", "_before")


def numbered_in_groups(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with their place in the group (``_rn``, from 0) and the group's count (``_count``); null is a group too.

    A large group is dealt over several ranges of its order, sorted apart and offset by the counts of the ranges before.
    """
    ranged = in_ranges(rows, group, order)
    counts = ranged.groupBy("_part", group).agg(F.count("*").alias("_n"))  # a row for each range and each group in it
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", F.col(group).alias("_group"), before.alias("_before"), F.sum("_n").over(w).alias("_count"))
    own = F.row_number().over(Window.partitionBy("_part", group).orderBy(order)) - 1
    return ranged.withColumn("_own", own).alias("r").join(offsets.alias("o"), F.expr(f"r._part = o._part AND r.`{group}` <=> o._group")).select("r.*", (F.col("_own") + F.col("_before")).alias("_rn"), "_count").drop("_part", "_own")
