"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds data frames (the ids of whole documents, about ``FRAME_BYTES`` each), one frame with the document index,
and a skippable frame with the seek table: compressed size, plain size and checksum (lower half of XXH64 of the plain
bytes) of every frame, as in the public seekable layout of zstandard. A reader fetches the table and the index from
the end of the file and then decompresses only the frames of the documents asked for, checking each frame.

Encoding: the words between spaces and newlines are looked up in a bounded table; the unknown ones of a block of texts
are normalised and cut up together, and each new part is encoded by the tokenizers library. The pre-tokeniser drops white space and never joins across it, so the ids are those of the whole
text (tests compare them). The end id follows each document.

Null texts count as empty: only the end id. Null ids come first, in the order of their texts' hashes; repeated rows
follow each other. Files are named by their range and put in place by renaming, so a task that runs again after a lost
executor leaves the same file. An empty table gives no documents. Extra columns are left alone.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import WordTable, chunks, read_table, scratch, written

FRAME_BYTES = 1 << 18
END_ID = 2
CACHE_WORDS = 800_000
BLOCK_WORDS = 200_000
# Fixed values of the seekable layout.
SKIPPABLE_MAGIC, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80


def checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class TokenFileWriter:
    """Appends documents and their ids; ``close`` writes index and seek table."""

    def __init__(self, out, width: int = 2, level: int = 1) -> None:
        self.out, self.width, self.dtype = out, width, np.dtype(f"<u{width}")
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.buffer: list[bytes] = []
        self.buffered = 0
        self.index: list[tuple[int, int, int]] = []  # (has id, id, bytes)
        self.last_frame: list[int] = []  # for each frame the number of documents up to its end

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: the document's ids as little-endian integers of ``width`` bytes."""
        self.buffer.append(ids)
        self.buffered += len(ids)
        self.index.append((doc_id is not None, doc_id or 0, len(ids)))
        if self.buffered >= FRAME_BYTES:
            self._flush()

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), checksum(raw)))

    def _flush(self) -> None:
        if self.buffer:
            self._frame(b"".join(self.buffer))
            self.last_frame.append(len(self.index))
            self.buffer, self.buffered = [], 0

    def close(self) -> None:
        self._flush()
        head = struct.pack("<III", self.width, len(self.index), len(self.last_frame))
        cols = list(zip(*self.index)) if self.index else [(), (), ()]
        self._frame(head + np.array(cols[0], "<u1").tobytes() + np.array(cols[1], "<i8").tobytes() + np.array(cols[2], "<u8").tobytes() + np.array(self.last_frame, "<u8").tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


class TokenFileReader:
    """Random access to a token file through a seekable file object."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, os.SEEK_END)
        size = source.tell()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("not a token file")
        source.seek(size - 9 - 12 * n)
        self.frames = [struct.unpack("<III", source.read(12)) for _ in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).tolist()
        raw = self.frame(n - 1)
        self.width, docs, parts = struct.unpack("<III", raw[:12])
        at = 12
        self.has_id = np.frombuffer(raw, "<u1", docs, at)
        self.ids = np.frombuffer(raw, "<i8", docs, at + docs)
        self.sizes = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.last_frame = np.frombuffer(raw, "<u8", parts, at + 17 * docs).tolist()

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, k: int) -> bytes:
        """Plain bytes of frame ``k``, checked."""
        packed, plain, check = self.frames[k]
        self.source.seek(self.offsets[k])
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=plain)
        if len(raw) != plain or checksum(raw) != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def read(self, n: int) -> np.ndarray:
        """Ids of the ``n``-th document; only its frame is decompressed."""
        k = bisect.bisect_right(self.last_frame, n)
        first = self.last_frame[k - 1] if k else 0
        start = int(self.sizes[first:n].sum())
        return np.frombuffer(self.frame(k)[start : start + int(self.sizes[n])], f"<u{self.width}")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, frame by frame."""
        n = 0
        for k, end in enumerate(self.last_frame):
            raw, at = self.frame(k), 0
            while n < end:
                size = int(self.sizes[n])
                yield (int(self.ids[n]) if self.has_id[n] else None), np.frombuffer(raw[at : at + size], f"<u{self.width}")
                at += size
                n += 1


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder(WordTable):
    """Ids of texts from a tokenizers file whose pre-tokeniser drops white space.

    ``codes`` holds the ids of words as little-endian integers of ``width`` bytes. New words of a block of texts are
    normalised and cut up together, by one call each.
    """

    def __init__(self, path: str) -> None:
        super().__init__(self._codes, CACHE_WORDS)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.lowers = self.normalize("ABCxyz!09") == "abcxyz!09"
        self.tokenize = self.tokenizer.model.tokenize
        special = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = os.path.commonprefix(special) if special else "\n"  # words hold no newline
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.pieces: dict[str, bytes] = {}
        self.find, self.letters = self._pattern(path)

    def _pattern(self, path: str):
        """The pattern of pre-tokens and of the spaces between words, if the file has the usual pair of a pattern and
        byte letters; the regex module is several times faster than the library. None leaves it to the library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["pre_tokenizer"]
        steps = spec.get("pretokenizers", [spec])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            return None, {}
        return regex.compile(f"{steps[0]['pattern']['Regex']}| ").findall, byte_letters()

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, f"<u{self.width}").tobytes()

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
        got = self.pieces[piece] = self._bytes([t.id for t in self.tokenize(letters)])
        return got

    def _words(self, text: str) -> list[bytes]:
        """Codes of the words of a normalised text, one space between two."""
        known, out, parts = self.pieces.get, [], []
        for piece in self.find(text):
            if piece == " ":
                out.append(b"".join(parts))
                parts = []
            else:
                parts.append(known(piece) or self._piece(piece))
        out.append(b"".join(parts))
        return out

    def _codes(self, words: list[str]) -> list[bytes]:
        """Codes of distinct words. One that may hold a special token or white space goes through all of the library."""
        got: dict[str, bytes] = {}
        if self.find is not None:
            plain, other = [], []
            for w in words:
                if self.special not in w and w:
                    if self.lowers and w.isascii() and w.isprintable():
                        plain.append(w)
                    elif w.split() == [w]:
                        other.append(w)
            for some, text in ((plain, " ".join(plain).lower()), (other, self.normalize(" ".join(other)))):
                if some and text.count(" ") == len(some) - 1:
                    got.update(zip(some, self._words(text)))
        return [got[w] if w in got else self._bytes(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids, without an end id."""
        out: list[bytes] = []
        rows: list[list[str]] = []
        held = 0
        for t in texts:
            words = t.replace("\n", " ").split(" ")
            if held + len(words) > BLOCK_WORDS:
                out += self.joined(rows)
                rows, held = [], 0
            if len(words) > BLOCK_WORDS:  # a long text by itself, block by block
                out.append(b"".join(self.joined([words[k : k + BLOCK_WORDS]])[0] for k in range(0, len(words), BLOCK_WORDS)))
            else:
                rows.append(words)
                held += len(words)
        return out + self.joined(rows)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents in ascending order of their ids to files in ``folder``, one for each range of ids.

    Gives (part, file, docs, tokens), one row for each file, in the order of ``part``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        enc = encoder(tokenizer)
        end = np.array([end_id], f"<u{enc.width}").tobytes()
        fs, root = filesystem(folder)
        fs.create_dir(root)
        name, trial = f"{root}/part-{part:06d}.tokens", f"{root}/.part-{part:06d}-{attempt}"
        n = tokens = 0
        with fs.open_output_stream(trial) as out:
            writer = TokenFileWriter(out, enc.width)
            for batch, texts in chunks(batches, "text"):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                    writer.add(doc_id, ids + end)
                    n += 1
                    tokens += len(ids) // enc.width + 1
            writer.close()
        if n:
            fs.move(trial, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([name]), "docs": pa.array([n], pa.int64()), "tokens": pa.array([tokens], pa.int64())})
        else:
            fs.delete_file(trial)

    return ordered.mapInArrow(save, "part int, file string, docs long, tokens long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents in the files, read back frame by frame."""
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    based = files.select("part", "file", F.coalesce(F.sum("tokens").over(line), F.lit(0)).alias("base"))
    spread = based.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                rows: list[tuple] = []
                with fs.open_input_file(name) as source:
                    for doc_id, ids in TokenFileReader(source).documents():
                        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        base += len(ids)
                        if len(rows) == 5_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids and read the files back."""
    import public_tokenizers

    folder = scratch(spark, "token-files")
    files = written(write_token_files(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json")), "token-manifest")
    return read_token_files(files, folder)
