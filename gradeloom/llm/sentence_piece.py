"""SentencePiece encoding and decoding with a shared-prefix Viterbi.

A text becomes marked words (a space is the mark that begins the next word). The distinct marked words of a batch are
sorted, so that they form a trie in depth-first order, and walked with one stack of forward values: the values of the
common prefix of two neighbours are reused. For a unigram model the value of a prefix is its best sum of scores. For a
BPE model a step is allowed only between pieces that the model leaves apart when it meets them together; then each
prefix has exactly one last piece, and the path is the segmentation the model itself makes (tests compare the ids with
the sentencepiece library). The pieces that end at a position come from an automaton over the vocabulary, and whether
two pieces stay apart from the order of the merges that make each of them. Runs of marks, whose pieces share one score, are merged pair by pair instead.

Characters outside the vocabulary become bytes. Null and empty texts have no ids. Decoding gives back the text with its
spaces. Repeated rows get equal ids. Each distinct word is encoded once for each worker, in a bounded table.
"""

from __future__ import annotations

import heapq
import math
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import WordTable, chunks, read_table

MARK = "▁"
MARKED = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
CACHE_WORDS = 600_000
CACHE_PAIRS = 500_000
CACHE_STEPS = 500_000
# Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


class Node(dict):
    """State of the automaton: the longest end of the characters read that begins a piece.

    Maps the next character to its state, filled as characters occur. ``ends`` holds the pieces that end here, longest
    first: (length, piece, score, ids, whether it stands after each last piece met).
    """

    __slots__ = ("ends", "model", "text")

    def __init__(self, model: PieceModel, text: str) -> None:
        self.model, self.text = model, text
        self.ends = tuple(model.entry(text[k:]) for k in range(len(text)) if text[k:] in model.vocab)

    def __missing__(self, char: str) -> Node:
        return self.model.step(self, char)


def _back(stack: list, piece: list[str], at: int) -> list:
    """Entries of ``stack`` at the ends of the pieces that lead to position ``at``."""
    out = []
    while at:
        out.append(stack[at])
        at -= len(piece[at])
    return out[::-1]


class PieceModel:
    """Vocabulary of a .model file with encoder and decoder."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.bpe = proto.trainer_spec.model_type == BPE
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("only models that keep the text as it is are supported")
        self.lead = " " if spec.add_dummy_prefix else ""
        self.vocab: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unk = 0
        for i, p in enumerate(proto.pieces):
            self.scores.append(p.score)
            self.bytes_of.append(p.piece.replace(MARK, " ").encode())
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.bytes_of[-1] = bytes([int(p.piece[3:5], 16)])
            elif p.type == UNKNOWN:
                self.unk, self.bytes_of[-1] = i, " ⁇ ".encode()
            elif p.type == CONTROL:
                self.bytes_of[-1] = b""
            elif p.type == NORMAL:
                self.vocab[sys.intern(p.piece)] = i
            elif p.type == USER_DEFINED:
                raise ValueError("user-defined pieces are not supported")
        self.lowest = min((self.scores[i] for i in self.vocab.values()), default=0.0)
        self.dtype = np.dtype("<u2" if len(self.scores) <= 1 << 16 else "<u4")
        self.nodes: dict[str, Node | None] = {}
        self.moves = self.pairs = 0  # entries kept in nodes and in their pieces' tables
        self.entries: dict[str, tuple[int, str, float, bytes, dict[str, bool]]] = {}
        self.histories: dict[str, tuple] = {}
        self.words = WordTable(self._codes, CACHE_WORDS)
        self.steps = 0  # positions computed, for the tests of the sharing

    # -- single words

    def merge(self, word: str, log: list | None = None) -> list[str]:
        """Pieces by merging the best-scored neighbours, the leftmost of equals, as the model defines it.

        ``log`` gets, for each merge, its score and the first and last part after it.
        """
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []
        final = len(parts) - 1

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < len(parts):
                both = parts[a] + parts[b]
                if both in self.vocab:
                    heapq.heappush(heap, (-self.scores[self.vocab[both]], a, b, both))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            least, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            else:
                final = a
            if log is not None:
                log.append((-least, sys.intern(parts[0]), sys.intern(parts[final])))
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def _history(self, piece: str) -> tuple:
        """Whether the model makes the piece; the scores of its merges, in order; its first and last parts before each
        merge and at the end."""
        got = self.histories.get(piece)
        if got is None:
            log: list[tuple[float, str, str]] = []
            made = len(self.merge(piece, log)) == 1
            got = made, (*(x[0] for x in log), -math.inf), (piece[0], *(x[1] for x in log)), (piece[-1], *(x[2] for x in log))
            if piece in self.vocab:
                self.histories[piece] = got
        return got

    def _apart(self, last: str, piece: str) -> bool:
        """Whether the model leaves the two pieces apart (``last`` empty: whether it makes the piece at all).

        Each side is merged by itself until a pair across the border scores best; the leftmost of equals goes first.
        """
        made, right_scores, firsts, _ = self._history(piece)
        if not made or not last:
            return made
        made, left_scores, _, lasts = self._history(last)
        if not made:
            return False
        vocab, scores, i, j = self.vocab, self.scores, 0, 0
        while True:
            left, right = left_scores[i], right_scores[j]
            across = vocab.get(lasts[i] + firsts[j])
            if across is not None and scores[across] > left and scores[across] >= right:
                return False
            if left == right == -math.inf:
                return True
            if left >= right:
                i += 1
            else:
                j += 1

    def _allowed(self, last: str, piece: str) -> bool:
        if self.pairs >= CACHE_PAIRS:
            for entry in self.entries.values():
                entry[4].clear()
            self.pairs = 0
        self.pairs += 1
        ok = self.entries[piece][4][sys.intern(last)] = self._apart(last, piece)
        return ok

    # -- the automaton over all pieces

    def entry(self, piece: str) -> tuple[int, str, float, bytes, dict[str, bool]]:
        if piece not in self.entries:
            self.entries[piece] = len(piece), sys.intern(piece), self.scores[self.vocab[piece]], self._code(piece), {}
        return self.entries[piece]

    def node(self, text: str) -> Node:
        if not self.nodes:
            self.nodes = dict.fromkeys(p[:k] for p in self.vocab for k in range(len(p) + 1)) | {"": None}
        if self.nodes[text] is None:
            self.nodes[text] = Node(self, text)
        return self.nodes[text]

    def step(self, node: Node, char: str) -> Node:
        """The state after one more character; steps back to the start are not kept."""
        text = node.text + char
        while text not in self.nodes:
            text = text[1:]
        to = self.node(text)
        if text:
            if self.moves >= CACHE_STEPS:
                for n in self.nodes.values():
                    if n is not None:
                        n.clear()
                self.moves = 0
            self.moves += 1
            node[char] = to
        return to

    def _walk(self, words: list[str]) -> Iterator[tuple[str, list[str], list[bytes]]]:
        """(word, last piece of each of its prefixes, ids of these) for sorted distinct words: a depth-first walk of their
        trie.

        The stacks hold for each prefix length the state, the piece that ends there, its ids and, for unigram models,
        the best score.
        """
        nodes, piece, codes, score, previous = [self.node("")], [""], [b""], [0.0], ""
        for word in words:
            if self.bpe and word.startswith(MARK + MARK):
                whole = [p for p in self.merge(word) for _ in p]
                yield word, ["", *whole], [b"", *map(self._code, whole)]
                continue
            keep, least = 0, min(len(previous), len(word))
            while keep < least and previous[keep] == word[keep]:
                keep += 1
            del nodes[keep + 1 :], piece[keep + 1 :], codes[keep + 1 :], score[keep + 1 :]
            self.steps += len(word) - keep
            node, end = nodes[keep], keep
            for char in word[keep:]:
                node, end = node[char], end + 1
                if self.bpe:
                    for size, p, _, code, after in node.ends:
                        ok = after.get(piece[end - size])
                        if ok or ok is None and self._allowed(piece[end - size], p):
                            break
                    else:  # a character outside the vocabulary stands alone
                        p, code = char, self._code(char)
                else:
                    best, p, code = -1e300, char, b""
                    for size, q, value, ids, _ in node.ends:
                        if score[end - size] + value > best:
                            best, p, code = score[end - size] + value, q, ids
                    if not code:
                        best, code = score[end - 1] + self.lowest - 10.0, self._code(char)
                    score.append(best)
                nodes.append(node)
                piece.append(p)
                codes.append(code)
            previous = word
            yield word, piece, codes

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, pieces) for sorted distinct words."""
        for word, piece, _ in self._walk(words):
            yield word, _back(piece, piece, len(word))

    def _codes(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, in the order given."""
        got = {word: b"".join(_back(codes, piece, len(word))) for word, piece, codes in self._walk(sorted(words))}
        return [got[w] for w in words]

    def _code(self, piece: str) -> bytes:
        """Ids of one piece; a character outside the vocabulary becomes bytes."""
        if piece in self.vocab:
            ids = [self.vocab[piece]]
        else:
            ids = [self.byte_ids[b] for b in piece.encode()] if self.byte_ids else [self.unk]
        return np.array(ids, self.dtype).tobytes()

    # -- texts

    def split(self, text: str) -> list[str]:
        """Marked words of a text; empty ones may stand between them."""
        if not text:
            return []
        text = self.lead + text
        if MARK in text or "  " in text:
            return MARKED.findall(text.replace(" ", MARK))
        return text.replace(" ", f" {MARK}").replace("\n", " \n ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of the model's width."""
        return self.words.joined(list(map(self.split, texts)))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.lead and text.startswith(" ") else text


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model for each Python worker, kept between tasks."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, n_tokens) of all documents."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch, texts in chunks(batches, "_text", 1_000_000):
            ids = [np.frombuffer(b, m.dtype) for b in m.encode(texts)]
            sizes = np.array([len(i) for i in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            flat = pa.array(np.concatenate(ids).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(sizes)], names=[id_col, "ids", "n_tokens"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_tokens long")


def decode_documents(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; null arrays give null texts."""
    some = rows.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    kind = some.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [None if i is None else m.decode(i) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return some.mapInArrow(run, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip): each document encoded, its ids summed up, and decoded again.

    The model writes spaces as its mark character, so a text that holds that character itself is not given back.
    """
    rows = docs.select("doc_id", F.col("text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch, texts in chunks(batches, "_text", 1_000_000):
            n, crc, same = [], [], []
            for t, raw in zip(texts, m.encode(texts)):
                ids = np.frombuffer(raw, m.dtype)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                same.append(m.decode(ids.tolist()) == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: number of ids, their checksum, and whether decoding gives the text back."""
    return digests(read_table(spark, sf_dir, "documents"), default_model())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the ids of each document."""
    return encode_documents(docs, default_model())
