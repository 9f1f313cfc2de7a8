"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Each token is hashed to one of ``BUCKETS`` rows. Every row has a sparse random index vector; the vector of a word is
the sum of the index vectors of its neighbours over the whole corpus, counted exactly in integers, so that the order
of tasks does not matter. A document is pooled from its word vectors (mean, spread, agreement of neighbours); a
network with one hidden layer, fitted on a bounded sample of labelled rows and calibrated by a temperature, gives the
score. Ids, language and source are never inputs. Null texts count as empty: their pooled vector is zero and they get
the network's value there. Repeated rows get equal scores. Without two classes of labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gradeloom.llm.common import chunks, class_counts, free_name, held_out, read_table, training_sample, written

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 2, 2
BLOCKS = 64
# Bounds on the memory of a Python worker: characters of a slice, tokens whose vectors are in memory at once, kept tokens.
SLICE_CHARS, GROUP_TOKENS, KEPT_TOKENS = 1_000_000, 50_000, 150_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the index vectors: NONZERO entries for each bucket, from a fixed seed."""
    rng = np.random.default_rng(20_240_501)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


class Buckets(dict):
    """Token to bucket; keeps the first KEPT_TOKENS tokens, as frequent ones come early, and hashes others each time."""

    def __missing__(self, token: str) -> int:
        b = xxhash.xxh32_intdigest(token) % BUCKETS
        if len(self) < KEPT_TOKENS:
            self[token] = b
        return b


def tokens(texts: list[str], buckets: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all tokens of all texts, and where each text starts (one more at the end)."""
    get, find = buckets.__getitem__, TOKEN.findall
    rows = [np.fromiter(map(get, find(t)), np.int64) for t in texts]
    starts = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=starts[1:])
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), starts


def _neighbours(ids: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """Positions whose neighbour at ``distance`` is in the same text."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    return np.flatnonzero(doc[:-distance] == doc[distance:]) if len(ids) > distance else np.zeros(0, np.int64)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sums of neighbours' index vectors, as BLOCKS rows of bytes."""
    pos, sign = index_vectors()
    total, buckets = np.zeros(BUCKETS * DIM), Buckets()
    for _, texts in chunks(batches, "text", SLICE_CHARS):
        ids, starts = tokens(texts, buckets)
        for distance in range(1, WINDOW + 1):
            left = _neighbours(ids, starts, distance)
            a, b = ids[left], ids[left + distance]
            for word, context in ((a, b), (b, a)):
                for k in range(NONZERO):
                    total += np.bincount(word * DIM + pos[context, k], sign[context, k], BUCKETS * DIM)
    parts = total.astype(np.int64).reshape(BLOCKS, -1)
    used = [k for k in range(BLOCKS) if parts[k].any()]
    if used:
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[k].astype(np.int32).tobytes() for k in used], pa.binary())], names=["block", "sums"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the blocks of a task one by one; memory is that of the blocks, whatever the number of rows."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors over all documents: BUCKETS x DIM, rows of length 1 (unseen rows are zero)."""
    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_accumulate, "block int, sums binary")
    rows = parts.repartition(BLOCKS, "block").mapInArrow(_total, "block int, sums binary").collect()  # BLOCKS rows
    out = np.zeros((BLOCKS, BUCKETS // BLOCKS * DIM))
    for r in rows:
        out[r["block"]] = np.frombuffer(r["sums"], np.int64)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """For each text: mean and spread of its word vectors, mean product of neighbouring vectors, their agreement."""
    ids, starts = tokens(texts, buckets)
    n = np.diff(starts)
    out = np.zeros((len(texts), 3 * DIM + 2), np.float32)
    for lo, hi in _groups(starts, GROUP_TOKENS):
        full = np.flatnonzero(n[lo:hi]) + lo
        if not len(full):
            continue
        v = vectors[ids[starts[lo] : starts[hi]]]
        at = starts[full] - starts[lo]
        size = n[full][:, None]
        mean = np.add.reduceat(v, at) / size
        out[full, :DIM] = mean
        out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, at) / size - mean * mean, 0))
        both = np.zeros_like(v)
        both[1:] = v[1:] * v[:-1]
        both[at] = 0
        near = np.add.reduceat(both, at) / size
        out[full, 2 * DIM : 3 * DIM] = near
        out[full, 3 * DIM] = near.sum(1)
        out[full, 3 * DIM + 1] = np.linalg.norm(mean, axis=1)
    return out


def _groups(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``most`` tokens each."""
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.w2 + self.b2) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> QualityModel:
    """Adam on the weighted cross entropy over four fifths of the rows; the temperature on the rest."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    order = rng.permutation(len(z))
    cut = max(1, len(z) // 5)
    check, train = order[:cut], order[cut:] if len(z) > 4 else order
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], hidden)).astype(np.float32), np.zeros(hidden, np.float32), rng.normal(0, hidden**-0.5, hidden).astype(np.float32), np.zeros(1, np.float32)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(train)
        for k in range(0, len(train), 256):
            i = train[k : k + 256]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) * weight[i] / len(i)
            back = np.outer(d, p[2]) * (h > 0)
            grads = [z[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for j, g in enumerate(grads):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.999 * v[j] + 0.001 * g * g
                p[j] = p[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    logit = np.maximum(z[check] @ p[0] + p[1], 0) @ p[2] + p[3]

    def loss(temp: float) -> float:
        s = np.clip(logit / temp, -40, 40)
        return float(np.mean(weight[check] * (np.logaddexp(0, s) - y[check] * s)))

    temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return QualityModel(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), float(temperature))


def pool_documents(docs: DataFrame, vectors: np.ndarray, *keep: str) -> DataFrame:
    """The pooled vectors as bytes of 32-bit floats, beside ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM floats: 2 MB
    out = docs.select(*keep, F.col("text").alias("_text"))
    schema = f"{', '.join(f'`{n}` {t}' for n, t in out.drop('_text').dtypes)}, pooled binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch, texts in chunks(batches, "_text", SLICE_CHARS):
            x = pooled(texts, shared.value, buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], names=[*keep, "pooled"])

    return out.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, max_rows: int = 12_000) -> QualityModel | None:
    """Word vectors from all documents; the network from at most ``max_rows`` labelled rows (half of each class)."""
    sample = written(training_sample(docs, labels, "quality", modulus, held, max_rows), "quality-sample")
    vectors = word_vectors(docs)
    rows = pool_documents(sample, vectors, "doc_id", "label").select("doc_id", "label", "pooled").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["pooled"]))
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = np.stack([np.frombuffer(r["pooled"], np.float32) for r in rows])
    prior = class_counts(labels, "quality", modulus, held)
    weight = np.where(y == 1, prior.get(1, 1) / max(1, (y == 1).sum()), prior.get(0, 1) / max(1, (y == 0).sum()))
    return fit(x, y, (weight / weight.mean()).astype(np.float32), vectors)


def score_documents(docs: DataFrame, model: QualityModel | None, *keep: str, score: str = "quality_score") -> DataFrame:
    """The ``keep`` columns with the column ``score`` (0 to 1); the score of every text when there is no model is 0.5."""
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.5).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: the vectors and a small network
    text = free_name(docs, "_text")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(text))
    schema = StructType([*kept.schema.fields, StructField(score, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, m = Buckets(), shared.value
        for batch, texts in chunks(batches, text, SLICE_CHARS):
            s = m.score(pooled(texts, m.vectors, buckets)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(s)], names=[*keep, score])

    return out.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the model learned from the rows of remainder 1 to 4."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model, "doc_id").select(
        "doc_id", held_out(5, 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted")
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored below 0.3 go; the columns stay."""
    model, score = learn(docs, read_table(spark, sf_dir, "labels")), free_name(docs, "quality_score")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return score_documents(docs, model, *docs.columns, score=score).filter(F.col(score) >= 0.3).select(*columns)
