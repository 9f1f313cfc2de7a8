"""Phrases, language-model scores and hard negatives against brute force."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import hard_negatives, neural_lm, phrases, words

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, word string, f long, fp long, file long, row long, body string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", 1, 2, 3, 4, "y", 5) for i, t, lang in rows], SHAPE)


ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t. , ;", None), (None, "A b. a B a", None), (4, "a b c d a b c d", "en"), (4, "a b c d a b c d", "en"), (4, "a b c d a b c d", "en"),
    (5, "a\tb c!d e\x0bf a b 3.14", "en"), (6, "é É a b c d é É a b c d", "fr"), (7, "x" * 100_000 + " a b " * 30_000, "fr"), (8, "a b\nc d", ""), (9, "a b a b c d e", "en"),
]


# -- phrases


def plain_phrases(rows, least, longest, top, nested=80):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for k in range(len(w) - n + 1):
                    counts[lang, tuple(w[k : k + n])] += 1
    often = {k: f for k, f in counts.items() if f >= least}
    out = {}
    for (lang, p), a in often.items():
        if len(p) < 2:
            continue
        inside = [f for (o, q), f in often.items() if o == lang and len(q) > len(p) and any(q[s : s + len(p)] == p for s in range(len(q)))]
        if any(100 * f >= nested * a for f in inside):
            continue
        score, _, left, right = min((2_000_000 * a // (often[lang, p[:k]] + often[lang, p[k:]]), k, often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, n + 1, p.decode(), -a, left, right, totals[lang], -s) for lang, found in out.items() for n, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("longest", [2, 3, 5])
def test_phrases_equal_counting(spark, longest):
    got = phrases.mine(table(spark, ODD), least=3, longest=longest, top=6)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == plain_phrases([(t, lang) for _, t, lang in ODD], 3, longest, 6)


def test_phrases_of_no_rows(spark):
    assert phrases.mine(table(spark, [])).count() == 0
    assert phrases.mine(table(spark, ODD[:3])).count() == 0


def test_phrases_with_colliding_fingerprints(spark, monkeypatch):
    """With fingerprints of a few bits most n-grams collide; the counts stay exact."""
    few, whole = (lambda x: x & np.uint64(0xF0)), phrases.mix
    at = [t for _, t, _ in ODD if t and len(t) < 1000]
    monkeypatch.setattr(phrases.Grams, "second", lambda g, a, n: (whole(g.checks.of(a, a + n)) >> np.uint64(32)).astype(np.uint32).view(np.int32))
    monkeypatch.setattr(phrases, "mix", few)
    grams = phrases.Grams([t.encode() for t in at], ["en"] * len(at))
    starts = grams.starts(2)
    fp, check, f, place = grams.counted(starts, 2, np.arange(len(at), dtype=np.int64))
    texts = {grams.text(a, 2): int(grams.second(np.array([a]), 2)[0]) for a in starts.tolist()}
    assert len(set(fp.tolist())) < len(texts) == len(set(texts.values()))  # the first fingerprint collides, the second does not
    want, got = Counter(texts[grams.text(a, 2)] for a in starts.tolist()), Counter()
    for n, c in zip(f.tolist(), check.tolist()):
        got[c] += n
    assert got == want


def test_bitmap_holds_all(spark):
    fps = [(n * 0x9E3779B97F4A7C15 % 2**64) - 2**63 for n in range(500)]
    bits = phrases.bitmap(spark.createDataFrame([(x,) for x in fps], "fp long"))
    assert bits.has(np.array(fps, np.int64).view(np.uint64)).all()
    assert bits.has(np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)).mean() < 0.2
    small = phrases.bitmap(spark.createDataFrame([(x,) for x in fps], "fp long"), most=1024)  # full of bits, but none is missing
    assert small.has(np.array(fps, np.int64).view(np.uint64)).all()


def test_words_and_portions():
    t = words.tokens([b"One two", b"", b"  TWO\tone.one"], phrases.KINDS)
    assert [t.dictionary[w].as_py() for w in t.word] == [b"one", b"two", b"two", b"one", b"one"]
    assert t.doc.tolist() == [0, 0, 2, 2, 2] and len(set(t.piece.tolist())) == 3
    import pyarrow as pa

    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array(x, pa.binary())], names=["k", "body"])
    parts = [(table.column("k").to_pylist(), texts) for table, texts in words.gathered(iter([batch(b"aa", b"bbb"), batch(b"c" * 9, b"", b"d")]), "body", 5)]
    assert parts == [([0, 1], [b"aa", b"bbb"]), ([0], [b"c" * 9]), ([1, 2], [b"", b"d"])]


# -- language model


def plain_base(rows):
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update([*split(t), b" "])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = [*split(t), b" "]
        out.append((i, held(i), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


def same_base(got, want):
    key = lambda r: repr(r[:5])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a[:5]) == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("head", [200_000, 4])
def test_base_scores(spark, monkeypatch, head):
    """Also with a head of four words, where most words meet their counts in the shuffle."""
    monkeypatch.setattr(neural_lm, "HEAD", head)
    rows = [(i, t) for i, t, _ in ODD]
    got = neural_lm.lm_scores(table(spark, ODD)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    same_base([tuple(r)[:6] for r in got], plain_base(rows))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert len({round(r["score"], 3) for r in got if r["doc_id"] == 4}) == 1


def test_no_training_texts(spark):
    assert neural_lm.lm_scores(table(spark, [])).count() == 0
    r = neural_lm.lm_scores(table(spark, [(None, "a b", "en")])).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0) and r["score"] < 0


def test_held_out_texts_are_likelier_than_by_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = neural_lm.op12_lm_score(spark, SF).collect()
    same_base([tuple(r)[:6] for r in got], plain_base([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


def test_probabilities_add_up():
    vocab = neural_lm.Vocabulary([b"a", b"bb", b"cab"], np.array([5, 3, 2]), 2, np.arange(neural_lm.CLASSES), np.ones(neural_lm.CLASSES), 100, 50)
    model = neural_lm.Model(vocab.prior())
    rng = np.random.default_rng(2)
    a, b, w = (rng.integers(0, 20, 4000) for _ in range(3))
    w[b % 2 == 0] = 7  # something to learn
    before = model.log_probabilities(a[:50], b[:50] // 2 * 2)[:, 7].mean()
    for _ in range(20):
        model.train(a, b, w, np.ones(4000), rng)
    after = model.log_probabilities(a[:50], b[:50] // 2 * 2)
    assert np.exp(after.astype(float)).sum(1) == pytest.approx(np.ones(50), abs=1e-4) and after[:, 7].mean() > before + 1


def test_text_sums_by_hand():
    model = neural_lm.Model(np.full(neural_lm.OUTCOMES, 1 / neural_lm.OUTCOMES))
    outcome, doc = np.array([3, 4, 3, 5]), np.array([0, 0, 0, 2])
    got = neural_lm.text_sums(model, outcome, doc, 3)
    log = lambda a, b, w: float(model.log_probabilities(np.array([a]), np.array([b]))[0, w]) / math.log(10)
    want = [log(0, 0, 3) + log(0, 3, 4) + log(3, 4, 3) + log(4, 3, 0), log(0, 0, 0), log(0, 0, 5) + log(0, 5, 0)]
    assert got == pytest.approx(want, abs=1e-4)


def test_a_worker_sums_each_context_once(monkeypatch):
    model, seen = neural_lm.Model(np.full(neural_lm.OUTCOMES, 1 / neural_lm.OUTCOMES)), []
    of = neural_lm.Model.scores
    monkeypatch.setattr(neural_lm.Model, "scores", lambda self, a, b: seen.extend(zip(a.tolist(), b.tolist())) or of(self, a, b))
    first = neural_lm.text_sums(model, np.array([3, 4, 3, 4]), np.array([0, 0, 1, 1]), 2)
    again = neural_lm.text_sums(model, np.array([3, 4, 3]), np.array([0, 0, 1]), 2)
    assert sorted(seen) == [(0, 0), (0, 3), (3, 4)] and first[0] == first[1] == again[0]
    one = np.array([3])
    model.train(one, one, one, np.ones(1), np.random.default_rng(1))
    assert model.sums is None  # other parameters have other sums


# -- hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    rows = list(dict.fromkeys((i, lab, tuple(v)) for i, lab, v in rows))
    out = []
    for i, lab, v in rows:
        if not anchors(i):
            continue
        s = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i]
        for p, j, m in sorted(x for x in s if x[2] == lab)[:positives]:
            fit = sorted(x for x in s if x[2] != lab and -low * p <= -100 * x[0] <= -high * p)[:negatives]
            out += [(i, j, k + 1, n, -p, -q) for k, (q, n, _) in enumerate(fit)]
    return sorted(out)


def floored(rows):
    return [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]


COLUMNS = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, lab, v in rows], "vec_id long, embedding array<double>, label int, id long, c string")
    miner = hard_negatives.Miner(df, F.col("id") % 10 == 0)
    return miner, sorted(map(tuple, miner.mine(**settings).select(*COLUMNS).collect()))


def test_hilbert_curve_visits_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    key = hard_negatives.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, a = rng.integers(-50, 50, (4, 20, 6)), rng.integers(-50, 50, (9, 6)).astype(float)
    low, up = hard_negatives.bounds(a, x.min(1).astype(float), x.max(1).astype(float))
    s = np.einsum("ad,bnd->abn", a, x)
    assert (s.min(2) >= low).all() and (s.max(2) <= up).all()


def test_clustered_vectors_leave_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "LEAST_GROUP", 100)
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (12, 10))
    rows = [(n, int(rng.integers(0, 3)), (centre[n % 12] * 2 + rng.normal(0, 0.05, 10)).tolist()) for n in range(1200)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id long, embedding array<double>, label int")
    miner = hard_negatives.Miner(df, F.col("id") % 10 == 0)
    miner.blocks(5, least_group=100)

    def started(best, m):
        win = hard_negatives._everything(m, 5)
        if best:
            win.take(*hard_negatives.unpack(best))
        return win

    miner.visit(miner.parcels, started, True, False, "seen")
    parcels, groups = miner.parcels.count(), miner.table.select("group").distinct().count()
    dealt = miner.spark.read.parquet(f"{miner.run.path}/003-seen")
    assert dealt.count() < 0.7 * parcels * (groups - 1)
    miner2 = hard_negatives.Miner(df, F.col("id") % 10 == 0)
    assert sorted(map(tuple, miner2.mine().select(*COLUMNS).collect())) == plain_negatives(floored(rows), lambda i: i % 10 == 0)


def test_odd_vectors(spark):
    v = [0.5, -0.25, 1.0]
    rows = [
        (0, 1, v), (10, 1, v), (10, 1, v), (1, 1, [0.4, 0.0, 0.9]), (2, 2, [0.3, -0.2, 0.6]), (3, 2, [0.3, -0.2, 0.6]), (3, 2, [0.3, -0.2, 0.6]), (4, 2, [0.5, -0.2, 0.7]), (5, None, v), (None, 1, v), (6, 1, None),
        (7, 2, [float("nan"), 1.0, 1.0]), (8, 2, [None, 1.0, 1.0]), (9, 2, [1.0]), (11, 2, []), (12, 3, [0.0, 0.0, 0.0]), (20, 4, v), (30, 3, [-1.0, 0.0, -1.0]),
    ]
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and len(r[2]) == 3 and all(x is not None and math.isfinite(x) for x in r[2])]
    assert mined(spark, rows)[1] == plain_negatives(floored(good), lambda i: i % 10 == 0)
    assert mined(spark, rows, positives=1, negatives=1, low=20, high=100)[1] == plain_negatives(floored(good), lambda i: i % 10 == 0, 1, 1, 20, 100)
    assert mined(spark, [])[1] == [] and mined(spark, [(11, 2, [])])[1] == []
    assert mined(spark, [(0, 1, v)])[1] == []


def test_equal_vectors_fill_no_task(spark):
    """A vector that a third of all rows hold is dealt to several groups, and ties go to the smaller id."""
    rng = np.random.default_rng(5)
    rows = [(n, n % 4, [0.5] * 8 if n % 3 == 0 else rng.normal(0, 0.3, 8).tolist()) for n in range(900)]
    df = spark.createDataFrame([(i, v, lab) for i, lab, v in rows], "vec_id long, embedding array<double>, label int")
    miner = hard_negatives.Miner(df, F.col("id") % 10 == 0)
    miner.blocks(5, least_group=100)
    most = max(r["n"] for r in miner.table.groupBy("group").agg(F.sum(F.octet_length("ids") / 8).alias("n")).collect())
    assert most < 450
    assert mined(spark, rows)[1] == plain_negatives(floored(rows), lambda i: i % 10 == 0)


def test_query_equals_sql_on_small_tables(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    got = hard_negatives.op13_hard_negatives(spark, SMALL).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({hard_negatives.ORACLE_SQL})").fetchall())


def test_texts_reach_the_language_model_in_short_batches(spark, monkeypatch):
    name, seen, of = "spark.sql.execution.arrow.maxRecordsPerBatch", [], neural_lm.fit
    was = spark.conf.get(name)
    monkeypatch.setattr(neural_lm, "fit", lambda *a: seen.append(int(spark.conf.get(name))) or of(*a))
    assert neural_lm.op12_lm_score(spark, SF).count() > 0
    assert seen == [neural_lm.ROWS] and spark.conf.get(name) == was
