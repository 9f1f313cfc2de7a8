"""Sharding by sampled splitters, with DataFrame operations only.

Records have a composite key: a hash of the text, then of the id, so equal texts are neighbours. A size-weighted sample
of keys gives quantile boundaries; the records are range-partitioned by them, and ranges that turn out overfull (one
text that fills a large part of the table, or an unlucky sample) are subdivided. Inside a range the records are ordered
and their sizes summed up; with the totals of the ranges before it each record knows how many bytes precede it, and
that decides its shard. So shards differ by about the size of one document, however the sample fell.

Law ``bytes``: the shards' sizes are near equal. A null text has size 1 and the checksum of the empty text. Null ids are
hashed like a value of their own. Repeated rows are told apart by nothing, so each takes one of their places. An empty
table gives an empty result. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import free_name, matching, read_table, with_locator, written

RANGES_PER_SHARD = 128
SAMPLES_PER_RANGE = 16
PREFIX_BITS = 12


# The columns of a record that are carried along, without its text; _place only where a place is asked for.
CARRIED = ("doc_id", "size", "text_crc32", "_place")


def carried(rows: DataFrame) -> list[str]:
    return [c for c in CARRIED if c in rows.columns]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", place: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, k1, k2, p): the record without its text; p is the first bits of the key."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1 = F.xxhash64(text)
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        *([F.col(place).alias("_place")] if place else []), k1.alias("k1"), F.xxhash64(F.col(id_col), F.lit(1)).alias("k2"), F.shiftright(k1, 64 - PREFIX_BITS).cast("int").alias("p"),
    )


def splitters(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Ranges (range, low, high) of keys, low exclusive; null ends are open. At most ``ranges`` rows.

    A row is drawn with a probability in proportion to its size, about SAMPLES_PER_RANGE for each range; larger rows
    than a draw's worth are always taken and weigh what they are.
    """
    step = max(1, total // (ranges * SAMPLES_PER_RANGE))
    draw = F.pmod(F.xxhash64("k1", "k2", F.lit(11)), F.lit(step))
    sample = rows.filter(F.col("size") > draw).select(F.struct("k1", "k2").alias("key"), F.greatest("size", F.lit(step)).alias("weight"))
    # the sample has a bounded number of rows, whatever the table holds
    order = Window.orderBy("key")
    cum = sample.select("key", F.sum("weight").over(order).alias("cum"), F.sum("weight").over(Window.partitionBy()).alias("all"))
    ends = cum.groupBy(F.floor(F.col("cum") * ranges / (F.col("all") + 1)).cast("int").alias("range")).agg(F.max("key").alias("high"))
    line = Window.orderBy("range")
    return ends.select(
        F.row_number().over(line).alias("range"), F.lag("high").over(line).alias("low"),
        F.when(F.lead("high").over(line).isNotNull(), F.col("high")).alias("high"),
    )


def ranged(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """Rows with their range and, where it is overfull, a subrange."""
    first, last = -(1 << (PREFIX_BITS - 1)), (1 << (PREFIX_BITS - 1)) - 1
    prefix = lambda c: F.shiftright(c, 64 - PREFIX_BITS).cast("int")
    table = splitters(rows, total, ranges)
    table = table.select("range", "low", "high", F.explode(F.sequence(F.coalesce(prefix(F.col("low.k1")), F.lit(first)), F.coalesce(prefix(F.col("high.k1")), F.lit(last)))).alias("p"))
    key = F.struct("k1", "k2")
    # the table has one row for each range and prefix that meet: ranges + 2^PREFIX_BITS at most
    inside = (F.col("low").isNull() | (key > F.col("low"))) & (F.col("high").isNull() | (key <= F.col("high")))
    out = written(rows.join(F.broadcast(table), "p").filter(inside).select(*carried(rows), "k1", "k2", "range"), "shard-ranges")
    fair = max(1, total // ranges)
    parts = out.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", F.when(F.col("bytes") > 2 * fair, F.ceil(F.col("bytes") / fair)).otherwise(1).cast("int").alias("parts"))
    return out.join(F.broadcast(parts), "range").withColumn("sub", F.pmod(F.xxhash64("k2", F.lit(5)), F.col("parts")).cast("int")).drop("parts")


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", place: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots are gapless from 0 within each shard.

    ``place``: a column that tells all rows apart; it is carried along as ``_place``.
    """
    rows = written(keyed(docs, id_col, text_col, place), "shard-keys")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * RANGES_PER_SHARD
    cut = ranged(rows, total, ranges)
    # the totals of the ranges: a few rows for each range
    totals = cut.groupBy("range", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("range", "sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", "sub", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"))
    within = Window.partitionBy("range", "sub").orderBy("k1", "k2", "size")
    sums = cut.select("*", (F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte"), (F.row_number().over(within) - 1).alias("row"))
    placed = written(
        sums.join(F.broadcast(offsets), ["range", "sub"]).select(
            *carried(rows), (F.col("row0") + F.col("row")).alias("at"),
            F.floor((F.col("byte0") + F.col("byte")) * shards / F.lit(max(1, total))).cast("int").alias("shard"),
        ), "shard-placed",
    )
    starts = placed.groupBy("shard").agg(F.min("at").alias("start"))  # one row for each shard
    return placed.join(F.broadcast(starts), "shard").select(*carried(rows), "shard", (F.col("at") - F.col("start")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as Parquet, one folder for each shard, in slot order, with all their columns.

    A shard is written by as many tasks as the session has shuffle partitions for it, so it never fills one task. Rows meet
    their shard by their place, so null ids and repeated rows are written as they are. The columns ``shard`` and ``slot``
    get longer names where the documents have such columns. An empty table gives an empty folder.
    """
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    landed, place = with_locator(docs, "shard-landed")
    shard, slot = free_name(landed, "shard"), free_name(landed, "slot")
    placed = assign(landed, shards, id_col, text_col, place).select(F.col("_place").alias(place), F.col("shard").alias(shard), F.col("slot").alias(slot))
    out = matching(landed, placed, place, "inner").drop(place)
    out.repartitionByRange(spread * shards, shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards of near equal bytes."""
    out = assign(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
