"""Language-model scores from a log-bilinear model, trained with noise-contrastive estimation.

Outcomes of the model: the end of a text, the ``OUT_WORDS`` most frequent words, and ``CLASSES`` classes that hold all other
words by their last two bytes. The vector that the two outcomes before predict, multiplied with the vectors of all outcomes, gives the
scores of the next one; a softmax over all outcomes makes them probabilities. A word of a class has its class's probability
times (c + 1) / (N + V + 1), with its count c and the class's N tokens and V words; the one place more is for unseen
words. So the probabilities of all that may follow add up to 1.

Counts cover all training texts. Training does too: in each of ``ROUNDS`` rounds every task starts from the shared parameters, goes over
its own part of the training texts with AdaGrad on the distinct triples of outcomes weighted by their counts, and gives its
parameters back; they are averaged by tokens, as integers, so the order of tasks does not matter. Parameters have a fixed size.

Scoring multiplies each context with all outcomes once for each worker, in blocks, keeps the logarithm of the sum, and adds up per text. The
``HEAD`` most frequent words travel to the tasks with their counts; rarer ones meet their counts in a shuffle.

Null texts are empty: only the end token. Null ids are held out, as nothing tells their remainder. Repeated rows are scored each (and
learned from each), up to rounding alike. Long texts are scored whole. Without training texts all outcomes are equally likely. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Run, held_out, read_table, with_locator
from gradeloom.llm.words import gathered, kinds, tokens

KINDS = kinds(b" \t\n\x0b\x0c\r")
END = b" "  # no word can be a space
OUT_WORDS, CLASSES, DIM = 1_023, 512, 24
OUTCOMES = 1 + OUT_WORDS + CLASSES
HEAD, HEAD_BYTES = 200_000, 256  # so many words of so many bytes at most are broadcast
ROUNDS, BATCH, NOISE, RATE = 2, 2_048, 32, 0.08
LEAST_TOKENS, MOST_EPOCHS = 400_000, 6  # a smaller portion is gone over several times
BLOCKS, FIXED = 16, float(1 << 20)
ROWS = 1_000  # rows of an Arrow batch


def ending(dictionary: pa.Array) -> np.ndarray:
    """The class of each word: its last two bytes, hashed."""
    if not len(dictionary):
        return np.zeros(0, np.int64)
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64, len(dictionary) + 1, dictionary.offset * 8)
    data = np.frombuffer(dictionary.buffers()[2], np.uint8, offsets[-1]).astype(np.int64)
    last, two = offsets[1:] - 1, np.diff(offsets) > 1
    return (data[last] + 131 * np.where(two, data[np.maximum(last - 1, 0)], 0)) % CLASSES


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task's texts with class and count, and the end token for each text."""
    for _, texts in gathered(batches, "body"):
        t = tokens(texts, KINDS)
        f = np.bincount(t.word, minlength=len(t.dictionary))
        words = pa.concat_arrays([t.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
        yield pa.RecordBatch.from_arrays([words, pa.array(np.append(ending(t.dictionary), 0), pa.int32()), pa.array(np.append(f, len(texts)), pa.int64())], names=["word", "cls", "f"])


@dataclass
class Vocabulary:
    """The most frequent words (the first OUT_WORDS are outcomes) with their counts, and what the classes hold."""

    words: list[bytes]
    counts: np.ndarray
    ends: int  # training texts
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int  # N
    distinct: int  # V

    def prior(self) -> np.ndarray:
        """Smoothed shares of the outcomes."""
        n = np.zeros(OUTCOMES)
        n[0] = self.ends
        own = self.counts[:OUT_WORDS]
        n[1 : 1 + len(own)] = own
        n[1 + OUT_WORDS :] = self.class_tokens
        n += 1
        return n / n.sum()

    def outcomes(self, dictionary: pa.Array, value_set: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each word its outcome and its place in the head (-1: not there)."""
        head = pc.index_in(dictionary.cast(pa.binary()), value_set=value_set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        own = (head >= 0) & (head < OUT_WORDS)
        return np.where(own, 1 + head, 1 + OUT_WORDS + ending(dictionary)), head


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, cls, f) of all training texts."""
    n, v, ends = counts.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == END, F.col("f"))), F.lit(0))).first()
    short = counts.filter((F.col("word") != END) & (F.octet_length("word") <= HEAD_BYTES))
    head = short.orderBy(F.desc("f"), "word").limit(HEAD).select("word", "f").toArrow()
    words = [w for w in head.column("word").to_pylist()]
    # OUT_WORDS rows, as an Arrow table: rows of Python objects would start further workers in the executors
    own = counts.sparkSession.createDataFrame(pa.table({"word": pa.array([END, *words[:OUT_WORDS]], pa.binary())}))
    rest = counts.join(F.broadcast(own), "word", "left_anti").groupBy("cls").agg(F.sum("f").alias("n"), F.count("*").alias("v")).collect()
    tokens_, words_ = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest:
        tokens_[r["cls"]], words_[r["cls"]] = r["n"], r["v"]
    return Vocabulary(words, head.column("f").to_numpy(), ends, tokens_, words_, n, v)


def log_sums(s: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials of each row; the rows are used up."""
    top = s.max(1)
    if top.size and (top.max() > 60 or top.min() < -60):
        s -= top[:, None]
    else:
        top = np.zeros_like(top)
    np.exp(s, out=s)
    return np.log(s.sum(1)) + top


class Model:
    """Parameters: vectors of outcomes as contexts and as targets, one matrix for each of the two places, and biases."""

    SHAPES = [(OUTCOMES, DIM), (OUTCOMES, DIM), (DIM, DIM), (DIM, DIM), (OUTCOMES,)]

    def __init__(self, prior: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.noise = prior
        self.p = [rng.normal(0, 0.1, s).astype(np.float32) for s in self.SHAPES[:2]] + [np.eye(DIM, dtype=np.float32), 0.5 * np.eye(DIM, dtype=np.float32), np.log(prior).astype(np.float32)]
        self.p[1] *= 0.1
        self.sums: np.ndarray | None = None

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.p]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at, self.sums = 0, None
        for k, s in enumerate(self.SHAPES):
            n = math.prod(s)
            self.p[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n

    def predicted(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.p[0][last] @ self.p[2] + self.p[0][before] @ self.p[3]

    def scores(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Scores of all outcomes for each context, biases included."""
        s = self.predicted(before, last) @ self.p[1].T
        s += self.p[4]
        return s

    def log_probabilities(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Natural logarithms for each context and each outcome; the rows' probabilities add up to 1."""
        s = self.scores(before, last)
        return s - log_sums(s.copy())[:, None]

    def log_sums_of(self, key: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all outcomes, for contexts given as before * OUTCOMES + last.

        A worker works out each context once, in a table with a place for each of them (9 MB), which training leaves behind.
        """
        if self.sums is None:
            self.sums = np.full(OUTCOMES**2, np.nan, np.float32)
        new = np.unique(key[np.isnan(self.sums[key])])
        for k in range(0, len(new), 128):
            some = new[k : k + 128]
            self.sums[some] = log_sums(self.scores(some // OUTCOMES, some % OUTCOMES))
        return self.sums[key]

    def train(self, before: np.ndarray, last: np.ndarray, word: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """Noise-contrastive estimation: tell each word from NOISE draws of the outcomes' shares, which a batch has in common."""
        self.sums = None
        squares = [np.full(s, 1e-4, np.float32) for s in self.SHAPES]
        shift = np.log(NOISE * self.noise).astype(np.float32)
        cdf = np.cumsum(self.noise)
        for _ in range(max(1, min(MOST_EPOCHS, -(-LEAST_TOKENS // max(1, int(weight.sum())))))):
            order = rng.permutation(len(word))
            for k in range(0, len(order), BATCH):
                i = order[k : k + BATCH]
                a, b, w = before[i], last[i], word[i]
                share = (weight[i] / weight[i].sum()).astype(np.float32)
                x = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), OUTCOMES - 1)
                va, vb = self.p[0].take(a, 0), self.p[0].take(b, 0)
                q = vb @ self.p[2] + va @ self.p[3]
                target, drawn = self.p[1].take(w, 0), self.p[1].take(x, 0)
                up = share / (1 + np.exp(np.clip(np.einsum("ij,ij->i", q, target) + self.p[4][w] - shift[w], -30, 30)))
                down = q @ -drawn.T
                down -= self.p[4][x] - shift[x]
                np.exp(np.clip(down, -30, 30, out=down), out=down)
                down += 1
                np.divide(-share[:, None], down, out=down)
                dq = up[:, None] * target + down @ drawn
                to = np.concatenate([w, x])
                rows = np.concatenate([up[:, None] * q, down.T @ q])
                from_ = np.concatenate([b, a])
                back = np.concatenate([dq @ self.p[2].T, dq @ self.p[3].T])
                step = [added(from_, back), added(to, rows), (slice(None), vb.T @ dq), (slice(None), va.T @ dq), (slice(None), np.bincount(to, np.concatenate([up, down.sum(0)]), OUTCOMES).astype(np.float32))]
                for n, (at, g) in enumerate(step):
                    squares[n][at] = total = squares[n][at] + g * g
                    self.p[n][at] += RATE * g / np.sqrt(total)


def added(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and the sums of their rows."""
    order = np.argsort(at.astype(np.uint16), kind="stable")  # numbers of outcomes; short ones are sorted by digits
    sorted_ = at.take(order)
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    return sorted_.take(first), np.add.reduceat(rows.take(order, 0), first, axis=0)


def contexts(outcome: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outcomes of all tokens with an end for each text, their texts, and the two outcomes before each (0 before the first)."""
    n = np.bincount(doc, minlength=texts)
    ends = np.cumsum(n + 1) - 1
    word = np.zeros(len(outcome) + texts, np.int64)
    inside = np.ones(len(word), bool)
    inside[ends] = False
    word[inside] = outcome
    of = np.repeat(np.arange(texts), n + 1)
    last, before = np.zeros_like(word), np.zeros_like(word)
    last[1:], before[2:] = word[:-1], word[:-2]
    begin = ends - n
    last[begin] = before[begin] = 0
    second = begin[n > 0] + 1
    before[second] = 0
    return word, of, last, before


def fit(run: Run, train: DataFrame, vocab: Vocabulary) -> Model:
    """Rounds over all training texts (column body); the parameters of all tasks are averaged after each."""
    model = Model(vocab.prior())
    context = train.sparkSession.sparkContext
    size = len(model.flat())
    edges = np.linspace(0, size, BLOCKS + 1).astype(int)
    words = context.broadcast(vocab.words[:OUT_WORDS])
    light = Vocabulary([], vocab.counts[:OUT_WORDS], vocab.ends, vocab.class_tokens, vocab.class_words, vocab.tokens, vocab.distinct)
    for step in range(ROUNDS):
        shared = context.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, step=step) -> Iterator[pa.RecordBatch]:
            own, seen, rng = Model(light.prior()), 0, np.random.default_rng(100 + step)
            own.load(shared.value.flat())
            value_set = pa.array(words.value, pa.binary())
            for _, texts in gathered(batches, "body"):
                t = tokens(texts, KINDS)
                word, _, last, before = contexts(light.outcomes(t.dictionary, value_set)[0][t.word], t.doc, len(texts))
                key, weight = np.unique((before * OUTCOMES + last) * OUTCOMES + word, return_counts=True)
                own.train(key // OUTCOMES**2, key // OUTCOMES % OUTCOMES, key % OUTCOMES, weight.astype(np.float64), rng)
                seen += len(word)
            if seen:
                share = 1 + seen // 1024
                flat = np.rint(own.flat() * FIXED).astype(np.int64) * share
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([share] * BLOCKS, pa.int64()), pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], names=["block", "share", "sums"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            shares: dict[int, int] = {}
            for batch in batches:
                for k, n, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "share", "sums"))):
                    sums[k] = sums.get(k, 0) + np.frombuffer(raw, np.int64)
                    shares[k] = shares.get(k, 0) + n
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([shares[k] for k in sums], pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "share", "sums"])

        shape = "block int, share long, sums binary"
        rows = train.mapInArrow(learn, shape).repartition(BLOCKS, "block").mapInArrow(total, shape).collect()  # BLOCKS rows
        if not rows:
            break
        flat = np.zeros(size)
        for r in rows:
            flat[edges[r["block"]] : edges[r["block"] + 1]] = np.frombuffer(r["sums"], np.int64) / FIXED / r["share"]
        model.load(flat)
    return model


def text_sums(model: Model, outcome: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """Log10 probability of the outcomes of each text, its end included."""
    word, of, last, before = contexts(outcome, doc, texts)
    out = -model.log_sums_of(before * OUTCOMES + last).astype(np.float64)
    one, two = model.p[0] @ model.p[2], model.p[0] @ model.p[3]
    for k in range(0, len(word), 8_192):
        at = slice(k, k + 8_192)
        out[at] += np.einsum("ij,ij->i", one.take(last[at], 0) + two.take(before[at], 0), model.p[1].take(word[at], 0)) + model.p[4][word[at]]
    return np.bincount(of, out, texts) / math.log(10)


_SCORED = "kind int, file long, row long, word binary, n long, known long, base double, model double"


def score_texts(docs: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """Rows of two kinds: 0 for each text with the sums of its head words, 1 for its words outside the head."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    logs, denominators = np.log10(vocab.counts + 1.0), np.log10(vocab.class_tokens + vocab.class_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        value_set = pa.array(vocab.words, pa.binary())
        for table, texts in gathered(batches, "body"):
            t, m = tokens(texts, KINDS), len(texts)
            file, row = (table.column(c).to_numpy() for c in ("file", "row"))
            outcome, head = vocab.outcomes(t.dictionary, value_set)
            rare = outcome > OUT_WORDS
            log = np.where(head >= 0, logs[np.maximum(head, 0)] if len(logs) else 0.0, 0.0)
            within = np.where(rare, log - denominators[np.where(rare, outcome - 1 - OUT_WORDS, 0)], 0.0)
            n = np.bincount(t.doc, minlength=m) + 1
            known = np.bincount(t.doc, (head >= 0)[t.word], m).astype(np.int64) + (vocab.ends > 0)
            base = np.bincount(t.doc, log[t.word], m) + math.log10(vocab.ends + 1)
            score = text_sums(model, outcome[t.word], t.doc, m) + np.bincount(t.doc, within[t.word], m)
            none = pa.nulls(m, pa.binary())
            yield _scored(0, file, row, none, n, known, base, score)
            out = np.flatnonzero((head < 0)[t.word])
            pair, many = np.unique(t.doc[out].astype(np.int64) * max(1, len(t.dictionary)) + t.word[out], return_counts=True)
            doc, word = pair // max(1, len(t.dictionary)), pair % max(1, len(t.dictionary))
            zero = np.zeros(len(pair))
            yield _scored(1, file[doc], row[doc], t.dictionary.cast(pa.binary()).take(pa.array(word)), many, zero.astype(np.int64), zero, zero)

    return docs.select("file", "row", "body").mapInArrow(run, _SCORED)


def _scored(kind: int, file: np.ndarray, row: np.ndarray, word: pa.Array, n: np.ndarray, known: np.ndarray, base: np.ndarray, model: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(file), kind, np.int32)), pa.array(file), pa.array(row), word, pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(model)], names=["kind", "file", "row", "word", "n", "known", "base", "model"])


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ROWS rows at most while plans run, as a batch holds its rows' whole texts on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    if not 0 < int(was) <= ROWS:
        spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def lm_scores(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for all texts, learned from those not held out."""
    with short_batches(docs.sparkSession):
        return _lm_scores(docs, modulus, held, id_col, text_col)


def _lm_scores(docs: DataFrame, modulus: int, held: int, id_col: str, text_col: str) -> DataFrame:
    run = Run(docs.sparkSession, "neural-lm")
    landed, place = with_locator(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("body")), "lm-docs")
    rows = landed.select("doc_id", "body", F.col(f"{place}.file").alias("file"), F.col(f"{place}.row").alias("row"), held_out(modulus, held).alias("held_out"))
    train = rows.filter(~F.col("held_out")).select("body")
    counts = run.written(train.mapInArrow(count_words, "word binary, cls int, f long").groupBy("word").agg(F.min("cls").alias("cls"), F.sum("f").alias("f")), "counts")
    vocab = vocabulary(counts)
    model = fit(run, train, vocab)
    scored = run.written(score_texts(rows, vocab, model), "scored")
    tail = scored.filter("kind = 1").select("file", "row", "word", "n").join(counts.select("word", "f"), "word")
    more = tail.groupBy("file", "row").agg(F.sum(F.col("n") * F.log10(F.col("f") + 1.0)).alias("log"), F.sum("n").alias("found"))
    # fixed-size rows of all texts on all three sides, so they are shuffled
    texts = scored.filter("kind = 0").drop("kind", "word").join(more.hint("merge"), ["file", "row"], "left").join(rows.select("file", "row", "doc_id", "held_out").hint("merge"), ["file", "row"])
    log = F.coalesce("log", F.lit(0.0))
    each = math.log10(vocab.tokens + vocab.distinct + 1)
    return run.finish(
        texts.select(
            "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + log - F.col("n") * each).alias("base_score"), (F.col("model") + log).alias("score"),
        )
    )


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from those of remainder other than 2."""
    return lm_scores(read_table(spark, sf_dir, "documents"))
