"""Helpers shared by the training-data operators: scratch folders, materialised tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators of words: space and the ASCII controls 9 to 13; bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a local session gets one temporary folder for the process; a cluster has no folder that
    all its machines see by default, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = _OWN[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared scratch folder and read it back.

    A lost executor then costs only its own tasks, as the table is in shared storage.
    """
    return _write(df, scratch(df.sparkSession, name))


class Run:
    """Tables of one run of an operator, in one scratch folder that ``finish`` removes."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.path, self.tables = spark, name, scratch(spark, name), 0

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.tables += 1
        return _write(df, f"{self.path}/{self.tables:03d}-{name}")

    def clear(self) -> None:
        """Remove the tables of the run."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def finish(self, result: DataFrame) -> DataFrame:
        """The result as a table of its own; those that it was made from go."""
        out = written(result, self.name + "-result")
        self.clear()
        return out


# A key with at least this part of a table's rows is a frequent one; there are no more than HOT_PART such keys.
HOT_PART = 200


def join_unique(run: Run, left: DataFrame, right: DataFrame, key: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """Join the written table ``left`` with ``right``, which holds each key once, when few keys may hold most of ``left``.

    The rows of frequent keys stay where they are and meet a broadcast of at most HOT_PART rows; all others are shuffled.
    ``sizes`` (key, size) are the rows of each key, if they are known. ``how`` is inner or left.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("size")) if sizes is None else sizes
    least = max(2, left.count() / HOT_PART)
    hot = run.written(sizes.filter(F.col("size") >= least).select(key), "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    often = left.join(F.broadcast(hot), key, "left_semi").join(few, key, how)
    return often.unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, how))


def matching(docs: DataFrame, rows: DataFrame, place: str, how: str) -> DataFrame:
    """Join all documents with rows that name some of them by ``place``. Both grow alike, so both are shuffled at every size."""
    return docs.join(rows.hint("merge"), place, how)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(c):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches whose texts hold about ``max_chars`` characters (a longer text is alone).

    Null texts count as empty. Keeps the working memory of numpy code bounded whatever the batch size is: only the texts
    of one slice are Python strings at a time.
    """
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.utf8_length(batch.column(text)).fill_null(0).to_pylist()):
            if i > start and size + n > max_chars:
                yield _portion(batch.slice(start, i - start), text)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield _portion(batch.slice(start), text)


def _portion(rows: pa.RecordBatch, text: str) -> tuple[pa.RecordBatch, list[str]]:
    return rows, [t or "" for t in rows.column(text).to_pylist()]


class WordTable(dict):
    """A bounded table from words to their places in ``codes``.

    The new words of a block of texts get their codes from ``encode`` together, so one look-up a word is enough.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bound: int) -> None:
        self.encode_words, self.bound = encode, bound
        self.codes: list[bytes] = []
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        self.new.append(word)
        return place

    def joined(self, rows: list[list[str]]) -> list[bytes]:
        """For each text, given as its words, their codes in one."""
        if len(self) > self.bound or self.new:  # new words are left where a block broke off
            self.clear()
            self.codes, self.new = [], []
        place = self.__getitem__
        places = [list(map(place, r)) for r in rows]
        self.codes += self.encode_words(self.new)
        self.new = []
        code = self.codes.__getitem__
        return [b"".join(map(code, p)) for p in places]


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows for fitting: columns doc_id, text, label.

    The remainder ``held`` marks held-out rows (crc32 of doc_id as text, modulo ``modulus``); they are
    never returned. Each class gives up to half of the bound, taken by the smallest hash of the id, so reruns agree.
    Labels repeated for an id count as their maximum; null labels and ids are left out.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .filter(F.crc32(F.col("doc_id").cast("string")) % modulus != held)
    )
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for k in (0, 1)]
    # the ids are bounded by max_rows, so their broadcast is too
    ids = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")


def class_counts(labels: DataFrame, label: str, modulus: int, held: int) -> dict[int, int]:
    """How many rows of each class may be learned from, before the bound."""
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .filter(F.crc32(F.col("doc_id").cast("string")) % modulus != held)
        .groupBy(F.col(label).cast("int").alias("k")).count().collect()
    )
    return {r["k"]: r["count"] for r in rows}


def held_out(modulus: int, held: int):
    """True for rows never learned from; null ids count as held out by their missing remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(True))


def with_locator(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with one column more, and its name: the row's place (hash of the file's path, row in it).

    It is the same in every read. Rows of a plain file scan have it already; anything else is written to the scratch
    folder first. A column of the user's with that name, or one called ``_metadata``, stays what it is.
    """
    column = free_name(docs, "_locator")

    def placed(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.withColumn(column, F.struct(F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")))

    try:
        return placed(docs), column
    except AnalysisException:
        return placed(written(docs, name)), column


def folder_of(docs: DataFrame) -> str | None:
    """The folder whose Parquet files ``docs`` reads whole, or None if it is anything but such a read."""
    folders = {f.rsplit("/", 1)[0] for f in docs.inputFiles()}
    if len(folders) != 1 or "%" in (folder := folders.pop()):  # names are escaped in the list of files
        return None
    read = docs.sparkSession.read.schema(docs.schema)
    # reads are the same only if their paths were spelt alike
    spelt = (path + end for path in (folder, urlsplit(folder).path) for end in ("", "/"))
    return folder if any(docs.sameSemantics(read.parquet(path)) for path in spelt) else None
