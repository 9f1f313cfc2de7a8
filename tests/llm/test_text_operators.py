"""Toxicity, quality, SentencePiece, token files and personal data."""

import io
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from gradeloom.llm import pii, quality, sentence_piece, token_file, toxicity
from gradeloom.llm.common import chunks

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a"), (4, "a"), (None, "no id"), (5, "\x00 ퟿ 😀 é"), (6, "   ")]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double, _text string")


def accuracy(df, labels, name, held):
    rows = df.filter(held).join(labels.filter(F.col(name).isNotNull()), "doc_id").select("predicted", name).collect()
    return np.mean([r[0] == r[1] for r in rows])


def ranking(df, labels, name, held):
    """Precision and recall of label 1 among held-out rows, and the area under the curve of the score."""
    rows = df.filter(held).join(labels.filter(F.col(name).isNotNull()), "doc_id").select("predicted", name, "score").collect()
    hit = sum(r[0] == 1 == r[1] for r in rows)
    ones, zeros = [r[2] for r in rows if r[1] == 1], [r[2] for r in rows if r[1] == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    return hit / max(1, sum(r[0] for r in rows)), hit / len(ones), auc


def id_text(spark, sf=SF):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# -- toxicity


def test_folding():
    assert toxicity.fold("1D10T Ідіот".replace("Ідіот", "іdiоt")) == " idiot idiot "
    assert toxicity.fold("é, É") == " e  e "


def test_exceptions_and_density():
    m = toxicity.ToxicityModel({" bad": 2.0}, [" badger "])
    a = m.automaton()
    assert [h[:2] for h in toxicity.hits(toxicity.fold("a badger"), a)] == []
    assert len(toxicity.hits(toxicity.fold("bad b4d badly"), a)) == 3
    assert toxicity.density(toxicity.fold("bad"), a, 5) > toxicity.density(toxicity.fold("bad " + "ok " * 50), a, 5) > 0


def test_toxicity_on_held_out_rows(spark):
    out = toxicity.op1_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert out.count() == 1000 and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert accuracy(out, labels, "toxic", F.col("held_out")) > 0.93


def plain_density(text, model):
    """Every term and exception tried at every place, without the automaton."""
    f, best, barred = toxicity.fold(text), {}, []
    lengths = {len(t) for t in model.terms}
    for s in [i for i, c in enumerate(f) if c == " "]:
        ends = [s + n - 1 for n in lengths if f[s : s + n] in model.terms]
        if ends:
            best[s] = (max(ends), model.terms[f[s : max(ends) + 1]])
    for e in model.exceptions:
        at = f.find(e)
        while at >= 0:
            barred.append((at, at + len(e) - 1))
            at = f.find(e, at + 1)
    kept = [w for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in barred)]
    return sum(kept) / (f.count(" ") + model.smooth), len(kept)


def test_toxicity_equals_plain_search(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels)
    model.exceptions += [" of the ", " the ", " a bad day "]
    model.terms |= {" th": 0.5, " the ": 0.7}
    got, texts = toxicity.densities(docs, model).collect(), id_text(spark)
    for r in got:
        d, n = plain_density(texts[r["doc_id"]], model)
        assert r["density"] == pytest.approx(d) and r["n_hits"] == n
    assert len(got) == len(texts) and sum(r["n_hits"] for r in got) > 100


def test_exception_phrases_are_learned(spark):
    assert toxicity.phrases(" the rotten appie feii ", toxicity.ToxicityModel({" rotten": 2.0}).automaton()) == {" rotten ", " the rotten ", " rotten appie ", " the rotten appie "}
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("bcdfgh"), 9))
    rows = [(i, f"{word()} rotten {word()}" if i < 300 else f"{word()} rotten apple {word()}" if i < 400 else f"{word()} {word()}") for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i < 300)) for i, _ in rows], "doc_id long, toxic int"))
    assert model.terms and " rotten appie " in model.exceptions and " rotten " not in model.exceptions
    found = [len(toxicity.hits(toxicity.fold(t), model.automaton())) for t in ("a r0tten apple", "a rotten thing, a rotten apple", "rotten")]
    assert found == [0, 1, 1]


def test_covered_hits_of_many_exceptions():
    rng = np.random.default_rng(0)
    words = ["bad", "good", "badly", "ok", "so"]
    model = toxicity.ToxicityModel({" bad": 1.0, " so ": 2.0}, [" ok bad ", " badly so ", " good "])
    for _ in range(300):
        t = " ".join(rng.choice(words, 12))
        got = toxicity.hits(toxicity.fold(t), model.automaton())
        assert (sum(w for *_, w in got) / (toxicity.fold(t).count(" ") + model.smooth), len(got)) == pytest.approx(plain_density(t, model))


def test_toxicity_ranks_held_out_rows(spark):
    precision, recall, auc = ranking(toxicity.op1_toxicity(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "toxic", F.col("held_out"))
    assert precision > 0.8 and recall > 0.6 and auc > 0.9


def test_toxicity_odd_rows(spark):
    got = toxicity.densities(odd_docs(spark), toxicity.ToxicityModel({" word": 3.0})).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.learn(odd_docs(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")).terms
    assert toxicity.densities(odd_docs(spark).limit(0), toxicity.ToxicityModel()).count() == 0


# -- quality


def test_word_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    assert np.array_equal(quality.word_vectors(docs.repartition(1)), quality.word_vectors(docs.repartition(5)))


def test_memory_of_quality_workers_is_bounded():
    """One batch of 600,000 tokens, most of them different."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 2_000)) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    vectors = rng.normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    buckets, rows = quality.Buckets(), []
    tracemalloc.start()
    try:
        for _, part in chunks(iter([batch]), "text", quality.SLICE_CHARS):
            rows.append(quality.pooled(part, vectors, buckets))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
    assert len(buckets) == quality.KEPT_TOKENS
    assert np.array_equal(np.concatenate(rows), quality.pooled(texts, vectors, quality.Buckets()))


def test_quality_on_held_out_rows(spark):
    out = quality.op2_quality(spark, SF)
    assert out.count() == 1000 and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert accuracy(out, spark.read.parquet(f"{SF}/labels.parquet"), "quality", F.col("held_out")) > 0.9


def plain_tokens(text):
    """As the operator cuts texts; each token's row of the table."""
    b = quality.Buckets()
    return [b[t] for t in quality.TOKEN.findall(text.lower())] if quality_lowers() else [b[t] for t in quality.TOKEN.findall(text)]


def quality_lowers():
    ids, _ = quality.tokens(["ABC", "abc"], quality.Buckets())
    return ids[0] == ids[1]


def test_word_vectors_pooling_and_network_equal_plain_loops(spark):
    texts = [t for t in id_text(spark, "/root/testdata/sf0.001").values()][:40] + ["", "one", "two words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pos, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        ids = plain_tokens(t)
        for i in range(len(ids)):
            for j in range(max(0, i - quality.WINDOW), min(len(ids), i + quality.WINDOW + 1)):
                if i != j:
                    for k in range(quality.NONZERO):
                        want[ids[i], pos[ids[j], k]] += sign[ids[j], k]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, want, atol=1e-6)
    pooled = quality.pooled(texts, vectors, quality.Buckets())
    for t, got in zip(texts, pooled):
        v = want[plain_tokens(t)]
        if not len(v):
            assert not got.any()
            continue
        near = (v[1:] * v[:-1]).sum(0) / len(v)
        plain = np.concatenate([v.mean(0), v.std(0), near, [near.sum(), np.linalg.norm(v.mean(0))]])
        assert np.allclose(got, plain, atol=2e-3)
    rng = np.random.default_rng(1)
    n = pooled.shape[1]
    m = quality.QualityModel(vectors, rng.normal(size=n), rng.uniform(1, 2, n), rng.normal(size=(n, 4)), rng.normal(size=4), rng.normal(size=4), 0.3, 1.7)
    for x, got in zip(pooled, m.score(pooled)):
        hidden = [max(0.0, sum((x[i] - m.mean[i]) / m.scale[i] * m.w1[i, j] for i in range(n)) + m.b1[j]) for j in range(4)]
        assert got == pytest.approx(1 / (1 + np.exp(-(sum(h * w for h, w in zip(hidden, m.w2)) + m.b2) / m.temperature)), rel=1e-4)
    rows = {r["doc_id"]: r["quality_score"] for r in quality.score_documents(docs, m, "doc_id").collect()}
    assert np.allclose([rows[i] for i in range(len(texts))], m.score(pooled), atol=1e-6)


def test_quality_ranks_held_out_rows(spark):
    precision, recall, auc = ranking(quality.op2_quality(spark, SF), spark.read.parquet(f"{SF}/labels.parquet"), "quality", F.col("held_out"))
    assert precision > 0.8 and recall > 0.8 and auc > 0.9


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (4, 1, 0), (6, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = quality.learn(odd_docs(spark), labels)
    got = quality.score_documents(odd_docs(spark), model, *odd_docs(spark).columns).collect()
    assert len(got) == len(ODD) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert quality.learn(odd_docs(spark), labels.limit(0)) is None
    assert {r["quality_score"] for r in quality.score_documents(odd_docs(spark), None, "doc_id").collect()} == {0.5}
    assert quality.score_documents(odd_docs(spark).limit(0), model, "doc_id").count() == 0


# -- SentencePiece


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(300).collect()]


EXTRA = ["", "   ", " a", "a  b   c", "foo\n\n\tbar  ", "ﬁ① Ünïcödé 你好 😀😀", "<s> <0x0A> </s> <|endoftext|>x", "a" * 50, " " * 37 + "x", "it's we'll DON'T 123 45"]


def test_ids_are_those_of_the_library(texts):
    import sentencepiece

    path = sentence_piece.default_model()
    m, ref = sentence_piece.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    every = EXTRA + texts
    got = [np.frombuffer(b, m.dtype).tolist() for b in m.encode(every)]
    assert got == ref.encode(every)
    assert [m.decode(i) for i in got] == every
    assert m.steps < 0.5 * sum(map(len, m.words))  # common prefixes are walked once


def test_pairs_of_pieces_are_judged_without_merging_both(texts):
    """Each piece is merged once by itself; merging every new pair took a third of op5's search."""
    m, calls = sentence_piece.PieceModel(sentence_piece.default_model()), []
    merge = m.merge
    m.merge = lambda *a: calls.append(a[0]) or merge(*a)
    m.encode(texts)
    assert len(calls) <= len(set(calls)) + sum(w.startswith("▁▁") for w in m.words)
    assert all(w in m.vocab or len(w) == 1 or w.startswith("▁▁") for w in calls)


def test_pieces_apart_equal_merging_both(texts):
    m = sentence_piece.PieceModel(sentence_piece.default_model())
    words = sorted(set(" ".join(texts[:60]).split()))
    pieces = sorted({p for _, ps in m.segment(words) for p in ps})
    rng = np.random.default_rng(9)
    for a, b in rng.choice(pieces, (20_000, 2)).tolist():
        assert m._apart(a, b) == (m.merge(a + b) == [a, b])
    every = sorted(m.vocab)[::11]
    assert [m._apart("", p) for p in every] == [m.merge(p) == [p] for p in every]


def test_odd_texts_and_small_caches_give_the_ids_of_the_library(monkeypatch):
    import sentencepiece

    path = sentence_piece.default_model()
    rng, signs = np.random.default_rng(10), [*"aBcthenrsßé\u0301\u00a0\u3000 \t\r'0½한가🙂\n\x00▁的了", "  ", "    ", "the", "ation", "▁▁", "..."]
    odd = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(2_000)]
    want = sentencepiece.SentencePieceProcessor(model_file=path).encode(odd)
    for name in ("CACHE_WORDS", "CACHE_PAIRS", "CACHE_STEPS", None):
        m = sentence_piece.PieceModel(path)
        assert [np.frombuffer(b, m.dtype).tolist() for k in range(0, 2_000, 500) for b in m.encode(odd[k : k + 500])] == want
        if name:
            monkeypatch.setattr(sentence_piece, name, 50)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "." * 1_000_000, " " * 200_000, "한" * 300_000, "é1" * 300_000])
def test_long_words_take_memory_by_their_length(text):
    m = sentence_piece.PieceModel(sentence_piece.default_model())
    began = time.process_time()
    assert m.decode(np.frombuffer(m.encode([text])[0], m.dtype).tolist()) == text and time.process_time() - began < 30


def test_unigram_viterbi_equals_plain_search():
    m = sentence_piece.PieceModel(sentence_piece.default_model())
    m.bpe, m.vocab, m.scores = False, {"a": 0, "b": 1, "ab": 2, "ba": 3, "aba": 4}, [-3.0, -3.0, -4.0, -2.5, -5.9]
    m.longest, m.lowest = 3, -5.9

    def best(w):
        if not w:
            return 0.0, []
        return max((best(w[k:])[0] + m.scores[m.vocab[w[:k]]], [w[:k], *best(w[k:])[1]]) for k in range(1, len(w) + 1) if w[:k] in m.vocab)

    words = sorted({"aba", "abab", "baab", "ababa", "bbba", "a"})
    for w, pieces in m.segment(words):
        assert sum(m.scores[m.vocab[p]] for p in pieces) == pytest.approx(best(w)[0]) and "".join(pieces) == w


def test_round_trip_of_odd_rows(spark):
    path = sentence_piece.default_model()
    docs = odd_docs(spark)
    ids = sentence_piece.encode_documents(docs, path)
    back = sentence_piece.decode_documents(ids, path)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == sorted((i or 0, t or "") for i, t in ODD)
    assert sentence_piece.digests(docs, path).filter("not round_trip").count() == 0
    assert sentence_piece.encode_documents(docs.limit(0), path).count() == 0


def test_query_of_pieces_on_all_documents(spark):
    import sentencepiece

    ref, texts = sentencepiece.SentencePieceProcessor(model_file=sentence_piece.default_model()), id_text(spark)
    rows = sentence_piece.op5_sentence_piece(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = ref.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"], r["round_trip"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ref.decode(ids) == texts[r["doc_id"]])


def test_a_text_with_the_mark_is_not_given_back(spark):
    docs = spark.createDataFrame([(1, "a▁b"), (2, "a b")], "doc_id long, text string")
    assert {r["doc_id"]: r["round_trip"] for r in sentence_piece.digests(docs, sentence_piece.default_model()).collect()} == {1: False, 2: True}


# -- token files


def test_query_of_token_files_on_all_documents(spark):
    from tokenizers import Tokenizer

    texts, start = id_text(spark), 0
    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = token_file.op7_token_file(spark, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        ids = [*ref.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_word_encoder_equals_whole_texts(texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    every = EXTRA + texts
    got = [np.frombuffer(b, "<u2").tolist() for b in token_file.WordEncoder(path).encode(every)]
    assert got == [e.ids for e in Tokenizer.from_file(path).encode_batch(every, add_special_tokens=False)]


def test_new_words_are_normalised_together():
    """One call for the new words of a block, not one for each word, which took most of op7's time."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, calls = token_file.WordEncoder(path), []
    normalize = enc.normalize
    enc.normalize = lambda t: calls.append(t) or normalize(t)
    text = " ".join(f"É{k}ß" for k in range(1_000))
    assert np.frombuffer(enc.encode([text])[0], "<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert len(calls) <= 2


def test_word_encoder_on_odd_words_and_small_blocks(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng, signs = np.random.default_rng(8), [*"aBcΣσİßée\u0301\u00a0\u3000\x1c\t\r\x0b '<|0½Ⅷ한가🙂\u200d\n\x00", "'ll", "<|endoftext|>", "  "]
    odd = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(2_000)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)]
    for block, cache in ((200_000, 800_000), (3, 5)):
        monkeypatch.setattr(token_file, "BLOCK_WORDS", block)
        monkeypatch.setattr(token_file, "CACHE_WORDS", cache)
        enc = token_file.WordEncoder(path)
        assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(odd)] == want
        assert len(enc) == len(enc.codes) <= cache + block + 1


class Counting(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def test_file_is_read_by_frames():
    rng, out = np.random.default_rng(0), io.BytesIO()
    docs = [rng.integers(0, 60_000, n).astype("<u2") for n in (3, 0, 200_000, 5, 400_000, 7)]
    w = token_file.TokenFileWriter(out)
    for i, d in enumerate(docs):
        w.add(None if i == 1 else i, d.tobytes())
    w.close()
    source = Counting(out.getvalue())
    r = token_file.TokenFileReader(source)
    assert all(np.array_equal(a, b) for (_, a), b in zip(r.documents(), docs)) and [i for i, _ in r.documents()] == [0, None, 2, 3, 4, 5]
    source.read_bytes = 0
    assert np.array_equal(r.read(5), docs[5]) and source.read_bytes < 1_000
    import zstandard

    plain = zstandard.ZstdDecompressor().decompressobj()
    assert plain.decompress(out.getvalue())  # frames are ordinary
    broken = bytearray(out.getvalue())
    broken[50] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or ours
        list(token_file.TokenFileReader(io.BytesIO(bytes(broken))).documents())


def test_token_files_of_odd_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/tokens"
    files = token_file.write_token_files(odd_docs(spark), folder, path)
    files.write.parquet(f"{tmp_path}/manifest")
    got = token_file.read_token_files(spark.read.parquet(f"{tmp_path}/manifest"), folder).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 6]
    t, start = Tokenizer.from_file(path), 0
    for r, text in zip(got, ["no id", "", "", "word " * 30_000, "a", "a", ODD[6][1], "   "]):
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# -- personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


TRICKY = ["a@b.c d@e", "x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.4", "4111 1111-1111 1111 4111111111111112", "+1 (555) 123-4567 +12", "..@x.y a@-.-", "é@a.b +1 2 3 4 5 6 7 8 9 0"]


def test_base_spans_equal_the_patterns(texts):
    for t in TRICKY + texts:
        assert pii.base_spans(t) == plain_spans(t)


def test_field_is_exact_and_learns_its_table():
    field, rows = pii.train(pii.labelled_rows()), pii.labelled_rows()
    wrong = 0
    for text, spans in rows:
        t = pii.tokenize(text)
        e = sum(field.emission[f] for f in pii.features(t))
        e[t.shape == pii.N_SHAPES - 2, 1:] = -1e6
        score, back = e[0] + field.transition[0], []
        for x in e[1:]:
            step = score[:, None] + field.transition
            back.append(step.argmax(0))
            score = step.max(0) + x
        path = [int((score + field.transition[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert pii.decode(t, field).tolist() == path[::-1]
        gold = np.zeros(len(t.start), int)
        for a, b, k in spans:
            gold[(t.start >= a) & (t.end <= b)] = k
        wrong += int((gold != path[::-1]).sum())
    assert wrong <= 5


def test_field_adds_spans_and_leaves_plain_text_alone(texts):
    field = pii.train(pii.labelled_rows())
    held_out = ["reach me on 555-987-6543 thanks", "mail tom at example dot com now", "call 030 9876 5432 office"]
    base = [pii.base_spans(t) for t in held_out]
    found = pii.added_spans(held_out, base, field)
    assert [f[0][0] for f in found if f] == ["phone", "email", "phone"]
    clean = [t for t in texts if not re.search("[0-9@]", t)]
    assert not any(pii.added_spans(clean, [[] for _ in clean], field))
    assert pii.redact("a 555-987-6543 b", [("phone", 2, 14)]) == "a [phone] b"


def test_pii_odd_rows(spark):
    got = pii.find(odd_docs(spark), pii.train(pii.labelled_rows())).collect()
    assert len(got) == len(ODD) and not any(r["base"] for r in got)


def test_query_of_personal_data_on_all_documents(spark):
    import hashlib

    texts = id_text(spark)
    rows = pii.op8_pii(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = sorted(plain_spans(texts[r["doc_id"]]), key=lambda x: (list(BASE).index(x[0]), x[1]))
        line = [f"{k}:{a}:{b}" for k, a, b in base]
        assert hashlib.sha256(",".join(line).encode()).hexdigest() == r["base_sha256"]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in base) for k in BASE]
        every = r["spans"].split(",") if r["spans"] else []
        assert set(line) <= set(every) and len(every) == len(line) + r["n_added"]


# -- texts of megabytes

LONG = {"digits": "7" * 1_000_000, "dots": "." * 1_000_000, "numbers": "1." * 500_000, "plus": "+" * 1_000_000, "word": "a" * 1_000_000, "ats": "a@b." * 250_000}


@pytest.mark.parametrize("name", LONG)
def test_long_texts_take_seconds(name):
    """Runs of one kind of character cost their length, not its square."""
    field, text = pii.train(pii.labelled_rows(), epochs=20), LONG[name]
    began = time.process_time()
    base = pii.base_spans(text)
    pii.added_spans([text], [base], field)
    assert time.process_time() - began < 30
    assert len(base) == {"numbers": 125_000, "ats": 250_000 - 1}.get(name, 0) or name == "ats"
    began = time.process_time()
    folded = toxicity.fold(text)
    assert toxicity.hits(folded, toxicity.ToxicityModel({" 7": 1.0, " a": 2.0}, ["a b"]).automaton()) is not None
    enc = token_file.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert len(enc.encode([text])[0]) > 0 and time.process_time() - began < 30


def test_long_stretches_decode_like_short_ones():
    field, rng = pii.train(pii.labelled_rows(), epochs=20), np.random.default_rng(6)
    for n in (1, 2, 9, 500):
        e = rng.normal(0, 2, (n, pii.K))
        assert pii._long_viterbi(e, field.transition).tolist() == pii._viterbi(e, np.array([0]), np.array([n]), n, field.transition)[0].tolist()


def test_ip_pattern_equals_the_plain_one():
    plain = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
    rng = np.random.default_rng(7)
    for _ in range(3000):
        t = "".join(rng.choice(list("19.. a"), rng.integers(1, 40)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in plain.finditer(t)]
