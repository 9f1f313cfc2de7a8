"""Toxicity: a weighted lexicon matched with Aho-Corasick after folding homoglyphs and digit substitutions.

Texts are folded to plain letters (look-alike letters, accents, digits standing for letters), every separator becomes
one space, and lexicon terms are anchored at word starts. The weights of the hits are divided by the length of the
text, hits inside exception phrases are cancelled, and a one-variable logistic curve turns the density into a score.

Lexicon, exceptions and curve are learned from labelled rows only; ids, language and source are never inputs. Exceptions
are phrases of one to three words around a term that are found mostly in clean rows.
Null or empty texts have density 0 and get the curve's value there. Repeated rows get equal scores. Without usable
labels the fixed seed terms and a default curve are used.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import chunks, class_counts, held_out, read_table, training_sample, written

# Letters and digits that stand for another letter.
LOOK_ALIKE = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɡ": "g", "ℓ": "i", "ø": "o", "đ": "d", "ł": "i",
}
# Seed terms, used with a fixed weight beside the learned ones.
SEED = ["idiot", "moron", "stupid", "loser", "worthless", "pathetic", "scum", "disgusting", "dumbass", "bastard", "arschloch", "connard", "imbecile", "pendejo"]


class _Fold(dict):
    """Character table for str.translate, filled by rule as characters occur."""

    def __missing__(self, code: int):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch.lower())[:1] or ch
        base = LOOK_ALIKE.get(base, LOOK_ALIKE.get(ch.lower(), base))
        out = base if base.isalnum() else (None if unicodedata.category(ch) in ("Mn", "Cf") else " ")
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Lower case, look-alikes to plain letters, combining and invisible marks dropped, separators to spaces."""
    return f" {text.translate(_FOLD)} "


@dataclass
class ToxicityModel:
    """Terms start with a space (word start); exceptions are folded phrases that cancel the hits inside them."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.5
    offset: float = 6.0
    smooth: float = 5.0

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for e in self.exceptions:
            a.add_word(e, (len(e), 0.0))
        if len(a):
            a.make_automaton()
        return a

    def score(self, density: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(density + 1e-4) + self.offset, -60, 60)))


def hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms found, the longest for each start, without those inside exception phrases."""
    if not len(automaton):
        return []
    best: dict[int, tuple[int, float]] = {}
    barred: list[tuple[int, int]] = []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w <= 0:
            barred.append((start, end))
        elif start not in best or best[start][0] < end:
            best[start] = (end, w)
    barred.sort()
    starts, reach, most = [a for a, _ in barred], [], -1
    for _, b in barred:
        most = max(most, b)
        reach.append(most)
    # an exception covers a hit if the farthest end of those that start no later is no earlier than the hit's
    return [(s, e, w) for s, (e, w) in best.items() if not (k := bisect_right(starts, s)) or reach[k - 1] < e]


def density(folded: str, automaton: ahocorasick.Automaton, smooth: float) -> float:
    """Weight of the hits for each word of the text; ``smooth`` words are added, so that tiny texts don't explode."""
    return sum(w for *_, w in hits(folded, automaton)) / (folded.count(" ") + smooth)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each candidate term (word prefixes of 4 to 8 letters, whole words), by label."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    for batch, texts in chunks(batches, "text"):
        for text, label in zip(texts, batch.column("label").to_pylist()):
            terms = set()
            for w in set(fold(text).split()):
                terms.update(f" {w[:k]}" for k in range(4, min(len(w), 8) + 1))
                terms.add(f" {w} ")
            found[label].update(terms)
        if len(found[0]) > 500_000:
            yield _count_rows(found)
            found = (Counter(), Counter())
    yield _count_rows(found)


def _count_rows(found: tuple[Counter, Counter]) -> pa.RecordBatch:
    # terms seen in no toxic document of this task and in few others can't become terms or exceptions on their own
    keys = list(found[0].keys() | found[1].keys())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())],
        names=["term", "toxic", "clean"],
    )


def phrases(folded: str, automaton: ahocorasick.Automaton) -> set[str]:
    """The words with a hit, alone and with the word before, the word after and both."""
    out = set()
    for start in {s for s, *_ in hits(folded, automaton)}:
        end = folded.find(" ", start + 1)
        before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
        out |= {folded[a : b + 1] for a in {start, before if 0 <= before < start - 1 else start} for b in {end, after if after > end + 1 else end}}
    return out


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, max_rows: int = 16_000, min_share: float = 0.015, min_precision: float = 0.75) -> ToxicityModel:
    """Learn terms, exceptions and curve from at most ``max_rows`` labelled rows (half of each class).

    A term needs ``min_share`` of the toxic rows (3 at least) and ``min_precision`` among the rows that hold it.
    Phrases around a term that as many clean rows hold, and most of them clean, become exceptions.
    """
    sample = written(training_sample(docs, labels, "toxic", modulus, held, max_rows), "toxicity-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    model = ToxicityModel({f" {fold(t).strip()}": 3.0 for t in SEED})
    if not toxic or not clean:
        return model
    counts = sample.mapInArrow(_term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    need = max(3, math.ceil(min_share * toxic))
    # each toxic row holds a bounded number of terms and a term needs a share of the rows, so few rows come back
    rate = (F.col("a") / toxic) / (F.col("a") / toxic + F.col("b") / clean)
    rows = counts.filter((F.col("a") >= need) & (rate >= min_precision)).orderBy(F.desc("a"), F.length("term").desc(), "term").limit(20_000).collect()
    model.terms |= choose_terms([(r["term"], r["a"], r["b"]) for r in rows], toxic, clean)
    terms = ToxicityModel(dict(model.terms))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, found = terms.automaton(), (Counter(), Counter())
        for batch, texts in chunks(batches, "text"):
            for text, label in zip(texts, batch.column("label").to_pylist()):
                found[label].update(phrases(fold(text), automaton))
        yield _count_rows(found)

    counts = sample.mapInArrow(around, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    model.exceptions = [r["term"] for r in counts.filter((F.col("b") >= need) & (rate < 0.5)).orderBy(F.desc("b"), "term").limit(5_000).select("term").collect()]
    seen = densities(sample, model, "label").select("density", "label").collect()
    prior = class_counts(labels, "toxic", modulus, held)
    d, y = np.array([r[0] for r in seen]), np.array([r[1] for r in seen], float)
    weight = np.where(y == 1, prior.get(1, 1) / toxic, prior.get(0, 1) / clean)
    model.slope, model.offset = _fit_curve(np.log(d + 1e-4), y, weight / weight.mean())
    return model


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms (term, toxic rows, clean rows) to keep, with their log odds as weights.

    Best first by the evidence (rows times log odds); a term whose start or continuation is taken already is left out.
    The counts must reach a chi-square value that rises with the number of rows, against words that a few similar
    rows share.
    """
    least = min(80.0, max(25.0, toxic / 10))

    def weight(a: int, b: int) -> float:
        return math.log(((a + 0.5) / (toxic + 1)) / ((b + 0.5) / (clean + 1)))

    chosen: dict[str, float] = {}
    for t, a, b in sorted(rows, key=lambda r: (-round(r[1] * weight(*r[1:]), 6), r[0].endswith(" "), -len(r[0]), r[0])):
        expected = (a + b) * toxic / (toxic + clean)
        if (a - expected) ** 2 / expected < least or weight(a, b) < 1 or any(t.startswith(c) or c.startswith(t.rstrip()) for c in chosen):
            continue
        chosen[t] = weight(a, b)
    return chosen


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Weighted logistic regression in one variable by halved Newton steps; a ridge keeps separable data finite."""
    mean, scale = float(np.average(x, weights=weight)), float(x.std()) + 1e-9
    z, p = (x - mean) / scale, np.zeros(2)

    def loss(p: np.ndarray) -> float:
        s = p[0] * z + p[1]
        return float(np.sum(weight * (np.logaddexp(0, s) - y * s)) + ridge / 2 * p @ p)

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(p[0] * z + p[1], -40, 40)))
        g = np.array([np.sum(weight * (q - y) * z), np.sum(weight * (q - y))]) + ridge * p
        v = weight * q * (1 - q)
        h = np.array([[np.sum(v * z * z), np.sum(v * z)], [np.sum(v * z), np.sum(v)]]) + ridge * np.eye(2)
        step, t = np.linalg.solve(h, g), 1.0
        while loss(p - t * step) > loss(p) and t > 1e-4:
            t /= 2
        p = p - t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return max(float(p[0]) / scale, 1e-3), float(p[1] - p[0] * mean / scale)


def densities(docs: DataFrame, model: ToxicityModel, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, the ``keep`` columns, density, score and number of hits."""
    out = docs.select(id_col, *keep, F.col(text_col).alias("_text"))
    schema = f"{', '.join(f'`{n}` {t}' for n, t in out.drop('_text').dtypes)}, density double, score double, n_hits int"
    names = [*out.columns[:-1], "density", "score", "n_hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch, texts in chunks(batches, "_text"):
            d, n = [], []
            for t in texts:
                folded = fold(t)
                got = hits(folded, automaton)
                n.append(len(got))
                d.append(sum(w for *_, w in got) / (folded.count(" ") + model.smooth))
            dens = np.array(d, float)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(dens), pa.array(model.score(dens)), pa.array(n, pa.int32())], names=names)

    return out.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the model learned from the rows of remainder 0 and 2."""
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    return densities(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits")
