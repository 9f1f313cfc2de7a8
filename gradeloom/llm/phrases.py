"""Phrase collocations by Rabin-Karp fingerprints.

Texts are split into pieces and words; the fingerprint of every n-gram comes from prefix polynomials over its words' hashes,
mixed with its language and its number of words. A task counts the n-grams of about 2 MB of text at a time: occurrences with one
fingerprint are compared by their words, so one counted row stands for one text only. It has a second, independent
fingerprint (other word hashes, another multiplier) and a pointer to a document with an occurrence. The shuffle adds up the rows of
both fingerprints, so phrases that collide in the first are counted apart, and drops rare ones. Only then are phrases made:
each fingerprint that is left is looked up in the text of the document its pointer names. No rare phrase is ever written out.
(Rows of different tasks are not compared by text: that took 40 million look-ups on 0.5 GB. They agree in 93 bits.)

An n-gram is no more frequent than its parts: bigrams are counted only where both words are frequent, longer ones only
where all their bigrams are. The frequent fingerprints are handed to the tasks as a bitmap of a fixed size at most
(``FILTER_BITS``); bits shared with others let too much through, never too little.

Null texts are empty; a null language counts as ``und``. Repeated rows count each. Ids are not used, so null or repeated ones
do not matter. A text longer than a task's portion is taken alone. Ties end in the order of the phrases' bytes. Extra
columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Run, matching, read_table, with_locator
from gradeloom.llm.words import WORD_BASE, Polynomial, Tokens, gathered, kinds, mix, tokens, word_hashes

KINDS = kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
FILTER_BITS = 1 << 26  # 8 MB
SALTS = 16
PORTION = 2_000_000  # bytes of text counted at a time; the rows of a task's portions are added up before they are shuffled
_ROWS = "fp long, check int, f long, place long"
CHECK_BASE = 0xA0761D6478BD642F  # odd
FEW_PLACES = 1_000_000  # so many pointed documents may be broadcast as numbers


class Grams:
    """Fingerprints of the n-grams of some texts. The lowest three bits of a fingerprint are n."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        self.t: Tokens = tokens(texts, KINDS)
        names = sorted(set(langs))
        at = {name: n for n, name in enumerate(names)}
        self.langs, self.lang = names, np.array([at[x] for x in langs], np.int64)
        self.seed = mix(np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64))
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.t.dictionary.to_pylist()], np.uint64)
        values = [h[self.t.word] if len(self.t.word) else np.zeros(0, np.uint64) for h in (word_hashes(self.t.dictionary), own)]
        self.sums, self.checks = Polynomial(values[0], WORD_BASE), Polynomial(values[1], CHECK_BASE)

    def starts(self, n: int) -> np.ndarray:
        """Where n-grams begin: n words within one piece."""
        piece = self.t.piece
        return np.flatnonzero(piece[: len(piece) - n + 1] == piece[n - 1 :]) if len(piece) >= n else np.zeros(0, np.int64)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        raw = mix(self.sums.of(at, at + n) ^ self.seed[self.lang[self.t.doc[at]]] ^ np.uint64(n))
        return (raw & ~np.uint64(7)) | np.uint64(n)

    def second(self, at: np.ndarray, n: int) -> np.ndarray:
        return (mix(self.checks.of(at, at + n)) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def empty_print(self, lang: int) -> int:
        """Stands for all words of a language."""
        return int(mix(self.seed[lang : lang + 1])[0] & ~np.uint64(7))

    def counted(self, at: np.ndarray, n: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both fingerprints, number and least place of the documents of the distinct n-grams that begin at ``at``."""
        fp = self.prints(at, n)
        order = np.argsort(fp)
        at, fp = at[order], fp[order]
        doc = self.t.doc[at]
        lang, new = self.lang[doc], np.ones(len(at), bool)
        if len(at):
            same = (fp[1:] == fp[:-1]) & (lang[1:] == lang[:-1])
            for k in range(n):  # the words themselves, so that a row stands for one text
                w = self.t.word[at + k]
                same &= w[1:] == w[:-1]
            new[1:] = ~same
        first = np.flatnonzero(new)
        if not len(first):
            return fp, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # the least place of all, so that many phrases point to few documents
        return fp[first], self.second(at[first], n), np.diff(np.append(first, len(at))), np.minimum.reduceat(place[doc], first)

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.t.joined[s:e].tobytes() for s, e in zip(self.t.start[at : at + n], self.t.end[at : at + n]))


class Bits:
    """A bitmap of fingerprints."""

    def __init__(self, words: np.ndarray, size: int) -> None:
        self.words, self.mask = words, np.uint64(size - 1)

    def has(self, fp: np.ndarray) -> np.ndarray:
        pos = (fp >> np.uint64(3)) & self.mask
        return (self.words[pos >> np.uint64(6)] >> (pos & np.uint64(63))) & np.uint64(1) != 0


def bitmap(table: DataFrame, most: int = FILTER_BITS) -> Bits:
    """Of the fingerprints in ``table``: about 16 bits for each row, ``most`` bits at most."""
    size = 1 << 10
    rows = table.count()
    while size < min(most, 16 * rows):
        size *= 2
    pos = F.shiftrightunsigned("fp", 3).bitwiseAND(F.lit(size - 1))
    words = table.groupBy(F.shiftright(pos, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), pos.bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    out = np.zeros(size // 64, np.uint64)
    got = words.toArrow()  # size / 64 rows at most
    out[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return Bits(out, size)


def count_rows(batches: Iterator[pa.RecordBatch], orders: tuple[int, ...], part: int, frequent: Bits | None) -> Iterator[pa.RecordBatch]:
    """Counted n-grams of the given orders whose parts of ``part`` words are all in ``frequent``."""
    for table, texts in gathered(batches, "body", PORTION):
        grams = Grams(texts, table.column("lang").to_pylist())
        place = table.column("place").to_numpy()
        known = None
        if frequent:
            known = np.zeros(len(grams.t.word), bool)
            at = grams.starts(part)
            known[at] = frequent.has(grams.prints(at, part))
        for n in orders:
            at = grams.starts(n)
            if known is not None:
                ok = np.ones(len(at), bool)
                for k in range(n - part + 1):
                    ok &= known[at + k]
                at = at[ok]
            yield _batch(*grams.counted(at, n, place))
        if orders == (1,):
            words = np.bincount(grams.lang[grams.t.doc], minlength=len(grams.langs))
            found, first = np.unique(grams.lang, return_index=True)
            yield _batch(np.array([grams.empty_print(k) for k in found], np.uint64), np.zeros(len(found), np.int32), words[found], place[first])


def _batch(fp: np.ndarray, check: np.ndarray, f: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(check), pa.array(f.astype(np.int64)), pa.array(place)], names=["fp", "check", "f", "place"])


def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Look up fingerprints in the documents they point to: (fp, check, lang, n, phrase, f)."""
    for table, texts in gathered(batches, "body", PORTION):
        grams = Grams(texts, table.column("lang").to_pylist())
        lists = table.column("rows").combine_chunks()
        doc = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        flat = lists.flatten()
        fp, check, f = flat.field("fp").to_numpy().view(np.uint64), flat.field("check").to_numpy(), flat.field("f").to_numpy()
        out = [(int(fp[k].view(np.int64)), 0, grams.langs[grams.lang[doc[k]]], 0, "", int(f[k])) for k in np.flatnonzero((fp & np.uint64(7)) == 0)]
        for n in range(1, 8):
            want = np.flatnonzero((fp & np.uint64(7)) == n)
            if not len(want):
                continue
            at = grams.starts(n)
            have = grams.prints(at, n)
            ok = np.isin(have, fp[want])
            at, have = at[ok], have[ok]
            where = dict(zip(zip(grams.t.doc[at].tolist(), have.tolist(), grams.second(at, n).tolist()), at.tolist()))
            for k in want.tolist():
                # absent only in another document that has the same place number
                if (a := where.get((int(doc[k]), int(fp[k]), int(check[k])))) is not None:
                    out.append((int(fp[k].view(np.int64)), int(check[k]), grams.langs[grams.lang[doc[k]]], n, grams.text(a, n).decode("utf-8", "surrogateescape"), int(f[k])))
        kinds_ = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds_)], names=["fp", "check", "lang", "n", "phrase", "f"])


def frequent_counts(run: Run, docs: DataFrame, least: int, longest: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, n, phrase, f): all phrases of 1 to ``longest`` words with f >= ``least``, and with n = 0 the words of each language."""
    landed, place = with_locator(docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).cast("binary").alias("body")), "phrase-docs")
    rows = landed.select("lang", "body", F.xxhash64(F.col(place)).alias("place"))
    context, kept, bits = run.spark.sparkContext, [], None
    for orders, part in (((1,), 0), ((2,), 1), (tuple(range(3, longest + 1)), 2)):
        if not orders or max(orders) > longest:
            break
        shared = context.broadcast(bits) if bits else None

        def count(batches: Iterator[pa.RecordBatch], orders=orders, part=part, shared=shared) -> Iterator[pa.RecordBatch]:
            return count_rows(batches, orders, part, shared.value if shared else None)

        sums = rows.mapInArrow(count, _ROWS).groupBy("fp", "check").agg(F.sum("f").alias("f"), F.min("place").alias("place"))
        kept.append(run.written(sums.filter((F.col("f") >= least) | (F.col("fp").bitwiseAND(F.lit(7)) == 0)), f"prints-{orders[0]}"))
        if max(orders) < longest:
            bits = bitmap(kept[-1].select("fp").distinct())
    wanted = kept[0]
    for more in kept[1:]:
        wanted = wanted.unionByName(more)
    wanted = run.written(wanted.groupBy("place").agg(F.collect_list(F.struct("fp", "check", "f")).alias("rows")), "pointers")
    if wanted.count() <= FEW_PLACES:
        # documents that nothing points to need not move
        rows = rows.join(F.broadcast(wanted.select("place")), "place", "left_semi")
    found = matching(rows, wanted, "place", "inner").select("lang", "body", "rows").mapInArrow(resolve, "fp long, check int, lang string, n int, phrase string, f long")
    return run.written(found.dropDuplicates(["fp", "check"]).select("lang", "n", "phrase", "f"), "counts")


def mine(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2_000, nested: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``longest`` words (7 at most).

    score is floor(2000000 a / (l + r)) of the cut with the lowest one. A phrase goes where a longer frequent one that holds
    it has at least ``nested`` percent of its count.
    """
    if not 2 <= longest <= 7:
        raise ValueError("longest is from 2 to 7")
    run = Run(docs.sparkSession, "phrases")
    counts = frequent_counts(run, docs, least, longest, lang_col, text_col)
    parts = counts.filter("n between 1 and " + str(longest - 1)).select("lang", "phrase", "f")
    cand = counts.filter("n >= 2").withColumn("words", F.split("phrase", " ", -1))
    join = lambda a, n: F.array_join(F.slice("words", a, n), " ")
    cuts = cand.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda k: F.struct(k.alias("k"), join(F.lit(1), k).alias("left"), join(k + 1, F.col("n") - k).alias("right")))).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut.*")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = F.expr("(CAST(2000000 AS DECIMAL(38, 0)) * a) div (CAST(l AS DECIMAL(20, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    inner = F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda s: join(s, m)))
    longer = cand.filter("n >= 3").select("lang", "f", F.explode(F.array_distinct(F.flatten(inner))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("longer") < F.lit(nested).cast("decimal(20,0)") * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # first within parts of a language, so that its last step orders SALTS times ``top`` rows at most
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = counts.filter("n = 0").select("lang", F.col("f").alias("n"))
    return run.finish(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all documents."""
    return mine(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT doc, lang, piece, text FROM (
    SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts
    FROM documents
  ), unnest(parts) WITH ORDINALITY AS u(text, piece)
), words AS (
  SELECT doc, lang, piece, pos, word FROM pieces, unnest(regexp_extract_all(text, '[^\x20\x09]+')) WITH ORDINALITY AS u(word, pos)
), runs AS (
  SELECT lang, word AS w1, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3, lead(word, 3) OVER w AS w4
  FROM words WINDOW w AS (PARTITION BY doc, piece ORDER BY pos)
), grams AS (
  SELECT lang, 1 AS n, w1 AS phrase FROM runs
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
), counts AS (
  SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
cand AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE n >= 2),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, 2000000::HUGEINT * c.a // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, n)) AS k FROM cand) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[k + 1:], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(words[s:s + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, n - m + 2)) AS s FROM (SELECT *, unnest(range(2, n)) AS m FROM cand WHERE n >= 3))
), longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.longer IS NULL OR 100::HUGEINT * o.longer < 80::HUGEINT * b.a
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
       k.phrase, k.a, CAST(k.l AS BIGINT) AS l, CAST(k.r AS BIGINT) AS r, t.n, CAST(k.score AS BIGINT) AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
