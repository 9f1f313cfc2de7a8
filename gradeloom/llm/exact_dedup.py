"""Exact deduplication as a stateful stream over the documents.

A stream reads the documents and keeps, for each digest of the normalised text, a state on disk (RocksDB, checkpointed
to the shared folder, never expired): the stable identifier of the copy that stays (the largest), the locator of its
content (file and row) and the number of copies. The files are dealt to micro-batches of ``BATCH_BYTES`` at most and a quarter of the
table at most, so there are at least four and later ones hit the state that earlier ones left; a table of fewer files is landed in four
first. Each micro-batch appends the changed states to a table. The texts of all hits are then fetched by
their locators and compared byte by byte with the text of the copy that stays; a digest that holds different texts is
grouped again by the texts themselves, so that a collision can't merge documents. (The comparison is one join after the
stream, not a look-up on each hit: the copy that stays is known only then, and the join reads each text once.)

Normalisation: A-Z to lower case, nothing else; a null text counts as empty, so null and empty texts are copies of
each other. Null ids are smaller than any other. Of rows that repeat an id and a text, one stays. Empty tables give an
empty result. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Run, ascii_lower, folder_of, free_name, join_unique, matching, read_table, scratch, with_locator, written

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# At most so many rows of a group are compared with the kept text in one task.
SALT_ROWS = 10_000
BATCHES = 4
BATCH_BYTES = 64 << 30


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def _located(docs: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest, locator); the locator is the row's place in its file, the same in every read."""
    text, meta = normalised(F.col(text_col)), docs.metadataColumn("_metadata")
    return docs.select(F.col(id_col).alias("id"), text.alias("t"), digest(text).alias("digest"), F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias("locator"))


def _pattern(path: str) -> str:
    """A pattern for ``path`` alone: as a pattern it may name one file as well as a folder of files."""
    plain = re.sub(r"([*?{}\[\]\\])", r"\\\1", path.rstrip("/"))
    at = max(i for i, c in enumerate(plain) if c.isalnum())
    return f"{plain[:at]}[{plain[at]}]{plain[at + 1 :]}"


def _bytes(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def _in_files(spark: SparkSession, run: Run, path: str) -> str:
    """``path``, or a copy of its table in BATCHES files if it has fewer, as a file is never split between micro-batches."""
    table = spark.read.parquet(path)
    if len(table.inputFiles()) >= BATCHES or table.isEmpty():
        return path
    landed = f"{run.path}/landed"
    table.repartition(BATCHES).write.parquet(landed)
    return landed


def group_states(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, folder: str | None = None) -> DataFrame:
    """Run the stream over the Parquet table at ``path``: (digest, keep, group_size), one row for each digest.

    ``keep`` is the largest (id, locator). Micro-batches are written under their number, so a batch that is run again
    after a failure overwrites itself; they and the checkpoint lie in ``folder``. Without ``files_per_batch`` they are bounded by bytes.
    """
    schema = spark.read.parquet(path).schema
    bound = ("maxFilesPerTrigger", files_per_batch) if files_per_batch else ("maxBytesPerTrigger", max(1, min(BATCH_BYTES, _bytes(spark, path) // BATCHES)))
    folder = folder or scratch(spark, "dedup-states")
    out, checkpoint = f"{folder}/batches", f"{folder}/checkpoint"
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else every partition takes some MB ahead
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "400")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    stream = own.readStream.schema(schema).option(*bound).parquet(_pattern(path))
    states = _located(stream, digest, id_col, text_col).groupBy("digest").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count("*").alias("group_size"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    empty = spark.createDataFrame([], states.schema)
    try:
        seen = spark.read.schema(states.schema).parquet(f"{out}/batch=*")
    except Exception as e:  # no batch ran: the table holds no files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty
    # both only grow while the stream runs, so their maxima are the last state
    return seen.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))


def _grouped(run: Run, path: str, digest: Callable[[Column], Column], id_col: str, text_col: str, files_per_batch: int | None) -> DataFrame:
    """Each document with the state of its digest: id, digest, locator, keep, group_size."""
    spark = run.spark
    states = run.written(group_states(spark, path, digest, id_col, text_col, files_per_batch, f"{run.path}/stream"), "states")
    hashed = run.written(_located(spark.read.parquet(path), digest, id_col, text_col).select("id", "digest", "locator"), "hashed")
    rows = join_unique(run, hashed, states, "digest", sizes=states.select("digest", F.col("group_size").alias("size")))
    return run.written(rows.select("id", "digest", "locator", "keep", "group_size"), "rows")


def _settled(run: Run, docs: DataFrame, rows: DataFrame, members: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with ``kept``, and whether a digest held different texts, so that its documents were grouped again.

    ``members`` are the texts of all groups: t, locator, digest, keep, group_size.
    """
    bad = run.written(_mismatched(members), "collisions")
    if collided := not bad.isEmpty():
        again = run.written(docs.join(bad, "digest", "left_semi"), "again")
        by_text = again.groupBy("digest", "t").agg(F.max(F.struct("id", "locator")).alias("keep"), F.count("*").alias("group_size"))
        rows = rows.join(bad, "digest", "left_anti").unionByName(again.join(by_text, ["digest", "t"]).select(*rows.columns))
    return rows.withColumn("kept", F.col("locator") == F.col("keep.locator")), collided


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """One row for each document of the table at ``path``: id, digest, locator, keep (id, locator), group_size, kept."""
    run = Run(spark, "dedup")
    path = _in_files(spark, run, path)
    rows = _grouped(run, path, digest, id_col, text_col, files_per_batch)
    docs = _located(spark.read.parquet(path), digest, id_col, text_col)
    groups = rows.filter(F.col("group_size") > 1).drop("id")
    # written once, as it is read from both sides; only members of groups are in it
    members = run.written(docs.select("t", "locator").join(groups, "locator"), "members")
    return run.finish(_settled(run, docs, rows, members)[0])


def _mismatched(members: DataFrame) -> DataFrame:
    """Digests of groups in which some text differs from the kept one, compared in full."""
    # a frequent digest is dealt to several tasks; its kept text is copied to each of them
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    hits = members.select("digest", "t", F.pmod(F.xxhash64("locator"), salts).cast("int").alias("salt"))
    kept = members.filter(F.col("locator") == F.col("keep.locator")).select("digest", F.col("t").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    return hits.join(kept, ["digest", "salt"]).filter(F.col("t") != F.col("kept_text")).select("digest").distinct()


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays for their text."""
    return dedup(spark, f"{sf_dir}/documents.parquet").select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group of equal texts stays. Anything but a read of a table is landed for the stream."""
    return deduplicated(spark, docs)


def deduplicated(spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with their columns. Whole documents are moved once, to meet the state of their digest."""
    path = folder_of(docs)
    if path is None:
        path = scratch(spark, "dedup-landed")
        docs.write.parquet(path)
    run = Run(spark, "dedup")
    path = _in_files(spark, run, path)
    rows = _grouped(run, path, digest, "doc_id", "text", None)
    landed, place = with_locator(spark.read.schema(docs.schema).parquet(path), "dedup-landed")
    state = free_name(landed, "_state")
    by_place = lambda of: F.struct(F.xxhash64(F.col("locator.file")).alias("file"), F.col("locator.row").alias("row")).alias(of)
    named = rows.select(by_place(place), F.struct("locator", "digest", "keep", "group_size").alias(state))
    met = written(matching(landed, named, place, "inner"), "dedup-met")
    members = met.filter(F.col(f"{state}.group_size") > 1).select(normalised(F.col("text")).alias("t"), f"{state}.*")
    settled, collided = _settled(run, _located(spark.read.parquet(path), digest, "doc_id", "text"), rows, members)
    if collided:  # which rows stay has changed
        kept = matching(met, written(settled.filter("kept").select(by_place(place)), "dedup-kept"), place, "left_semi")
    else:
        kept = met.filter(F.col(f"{state}.locator") == F.col(f"{state}.keep.locator"))
    run.clear()
    return kept.select(*[met[f"`{c}`"] for c in docs.columns])


ORACLE_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
FROM t
"""
