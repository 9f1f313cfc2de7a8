"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

The words of all documents are shared among the sources by weight; a target stops at ``cap`` times its source's size
and the excess is shared again by weight. Every document of a source is taken a whole number of times for certain. What
is missing of the target is a sample with unequal probabilities: the inclusion probability of a document is in proportion
to its size (or to ``weight_col``), such that the expected words are those missing. Where it would reach 1, one more copy
is certain and the others' probabilities are raised. The rest are ranked by their random odds divided by their inclusion
odds (Pareto order sampling) and taken in this order up to the words that are missing; one more document closes the gap
best.

The random number of a document is a hash of its id and a seed, so reruns agree. Ranks are not computed in one window:
documents are counted by bins of their rank value, those of the bin in which a source's target is reached by finer bins,
and only those of one fine bin are ordered. The rows of large sources are not brought together: they meet one row for
each source by broadcast (``join_unique``). Only the table of one row for each source is ordered as a whole.

Null texts have no words, null sources are a source of their own (the last), null ids count as one id. Documents
without words (or weight) are never drawn, their certain copies stay. Weights count to four significant digits. Repeated
rows share their rank and are taken one by one. An empty table gives an empty result. Extra columns are left alone,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import WORD, Run, free_name, join_unique, matching, read_table, with_locator

BINS = 4096  # and as many fine bins in each
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_number(id_col: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit(":" + seed))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(key, source, source_size, target) from (key, source, source_size): one row for each source.

    In ascending order of size by weight, a source is at its cap if its share of what is left would be larger.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("most", F.col("source_size") * cap)
    line = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = w.select(
        "*", F.coalesce(F.sum("most").over(line), F.lit(0)).alias("most0"), F.coalesce(F.sum("w").over(line), F.lit(0)).alias("w0"),
        F.sum("source_size").over(every).alias("all"), F.sum("w").over(every).alias("all_w"),
    )
    w = w.withColumn("capped", (F.col("all") - F.col("most0")) * F.col("w") > F.col("most") * (F.col("all_w") - F.col("w0")))
    left = F.col("all") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0)).over(every)
    left_w = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every)
    share = left.cast("double") / F.when(left_w > 0, left_w) * F.col("w")
    return w.select("key", "source", "source_size", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.coalesce(share, F.lit(0.0))).alias("target"))


def inclusion_odds(levels: DataFrame) -> DataFrame:
    """(key, limit, slope) from (key, m, words, rest): documents with m above ``limit`` are certain, others have slope * m.

    The probability is min(1, slope * m), with the slope for which the expected words are ``rest``. In descending order of
    m a level is certain if it would be so with all above it; the first that is not decides.
    """
    down = Window.partitionBy("key").orderBy(F.desc("m"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    measure = F.sum(F.col("m") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    first = levels.select("key", "m", "rest", above.alias("above"), measure.alias("measure")).filter(F.col("m") * (F.col("rest") - F.col("above")) < F.col("measure"))
    first = first.groupBy("key").agg(F.max(F.struct("m", "rest", "above", "measure")).alias("f"))
    return first.select("key", F.col("f.m").alias("limit"), ((F.col("f.rest") - F.col("f.above")) / F.col("f.measure")).alias("slope"))


def _edge(bins: DataFrame, before) -> DataFrame:
    """(key, bin, before) of the bin in which the words of a source reach ``rest``, with the words before it."""
    cum = F.sum("words").over(Window.partitionBy("key").orderBy("bin")) + before
    bins = bins.select("key", "bin", "rest", (cum - F.col("words")).alias("before"), cum.alias("cum"))
    bins = bins.filter((F.col("before") <= F.col("rest")) & (F.col("cum") > F.col("rest")))
    return bins.groupBy("key").agg(F.min(F.struct("bin", "before")).alias("e")).select("key", F.col("e.bin").alias("bin"), F.col("e.before").alias("before"))


def mix(docs: DataFrame, *keep: str, cap: int = 3, seed: str = SEED, weight_col: str | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents (``keep`` columns) with size, source_size, target and copies: how often the mix takes each."""
    run = Run(docs.sparkSession, "mix")
    w = F.col(weight_col).cast("double") if weight_col else None
    unit = F.pow(F.lit(10.0), F.floor(F.log10(w)) - 3) if weight_col else None
    base = docs.select(
        F.struct(*(keep or (id_col,))).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), source_col)).alias("key"),
        n_words(F.col(text_col)).alias("size"), random_number(F.col(id_col), seed).alias("u"),
        F.coalesce(F.when(w > 0, F.round(w / unit) * unit), F.lit(0.0)).alias("m") if weight_col else F.lit(None).cast("double").alias("m"),
    )
    base = run.written(base, "base").withColumn("m", F.coalesce("m", F.col("size").cast("double")))
    sources = base.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = run.written(sources, "sources")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.least(F.floor(ratio), F.lit(cap)).cast("int")
    targets = source_targets(sources.select("key", "source", "source_size"), cap).drop("source").withColumn("whole", whole)
    targets = run.written(targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "targets")
    # one row for each source and size
    levels = base.filter((F.col("size") > 0) & (F.col("m") > 0)).groupBy("key", "m").agg(F.sum("size").alias("words"))
    odds = inclusion_odds(levels.join(targets.filter("rest > 0").select("key", "rest"), "key"))
    terms = run.written(targets.join(odds, "key", "left"), "terms")
    rows_of = sources.select("key", F.col("n").alias("size"))
    ranked = join_unique(run, base, terms, "key", sizes=rows_of)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("slope") * F.col("m")))
    q = F.when(F.col("m") > F.coalesce("limit", F.lit(0.0)), 0.0).otherwise((F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
    can = (F.col("rest") > 0) & (F.col("size") > 0) & (F.col("m") > 0)
    fine = F.floor(F.col("q") / (1 + F.col("q")) * BINS * BINS)
    ranked = ranked.withColumn("can", can).withColumn("q", q).withColumn("fine", fine)
    ranked = run.written(ranked.drop("source", "m", "u", "limit", "slope"), "ranked")
    drawable = ranked.filter("can")
    bins = drawable.groupBy("key", F.floor(F.col("fine") / BINS).alias("bin"), "rest").agg(F.sum("size").alias("words"))  # BINS + 1 rows a source at most
    coarse = run.written(_edge(bins, F.lit(0)).withColumnRenamed("bin", "coarse"), "edges")
    inside = join_unique(run, drawable, coarse, "key", sizes=rows_of).filter(F.floor(F.col("fine") / BINS) == F.col("coarse"))
    bins = inside.groupBy("key", F.col("fine").alias("bin"), "rest", "before").agg(F.sum("size").alias("words"))
    edge = run.written(_edge(bins, F.col("before")).withColumnRenamed("bin", "edge"), "edges")
    marked = run.written(join_unique(run, ranked, edge, "key", "left", sizes=rows_of), "marked")
    at_edge = F.coalesce(F.col("can") & (F.col("fine") == F.col("edge")), F.lit(False))
    outside = marked.filter(~at_edge).withColumn("drawn", F.col("can") & (F.col("edge").isNull() | (F.col("fine") < F.col("edge"))))
    line = F.sum("size").over(Window.partitionBy("key").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    within = marked.filter(at_edge).withColumn("drawn", F.col("before") + line <= F.col("rest"))
    drawn = run.written(outside.unionByName(within).drop("edge", "before", "fine"), "drawn")
    # the one document more that closes the gap best, if any does
    have = run.written(drawn.groupBy("key").agg(F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0)).alias("have")), "have")
    gap = F.col("rest") - F.col("have")
    closer = join_unique(run, drawn, have, "key", sizes=rows_of).filter(F.col("can") & ~F.col("drawn") & (F.abs(gap - F.col("size")) < gap))
    closer = closer.groupBy("key").agg(F.min(F.struct(F.abs(gap - F.col("size")).alias("miss"), "q", "id", "size", "row")).alias("c")).select("key", "c")
    closer = run.written(closer, "closer")
    final = join_unique(run, drawn, closer, "key", "left", sizes=rows_of)
    closes = F.coalesce(~F.col("drawn") & F.struct("q", "id", "size", "row").eqNullSafe(F.struct("c.q", "c.id", "c.size", "c.row")), F.lit(False))
    # of rows that repeat an id, a text and all else, only one closes the gap
    same = final.filter(closes).withColumn("drawn", F.row_number().over(Window.partitionBy("key").orderBy("q")) == 1)
    out = final.filter(~closes).unionByName(same)
    return run.finish(out.select("row.*", "size", "source_size", "target", (F.col("whole") + F.col("drawn").cast("int")).alias("copies")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    out = mix(read_table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it; the columns stay, documents that it does not take go."""
    placed, place = with_locator(docs, "mix-landed")
    copies, copy = free_name(placed, "copies"), free_name(placed, "copy")
    taken = mix(placed, place).filter(F.col("copies") > 0).select(place, F.col("copies").alias(copies))
    out = matching(placed, taken, place, "inner").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`"))))
    return out.select(*[out[f"`{c}`"] for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents of the mix, repeated as often as it takes them."""
    return mixed(docs)


ORACLE_SQL = """
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':mix-1'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, source_size * 3 AS most FROM s0),
s2 AS (SELECT *, coalesce(sum(most) OVER l, 0)::BIGINT AS most0, coalesce(sum(w) OVER l, 0)::BIGINT AS w0,
              (sum(source_size) OVER ())::BIGINT AS every, (sum(w) OVER ())::BIGINT AS every_w
       FROM s1 WINDOW l AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (every - most0) * w > most * (every_w - w0) AS capped FROM s2),
s4 AS (SELECT *, (every - (sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())::BIGINT)::DOUBLE
                 / nullif((sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT, 0) * w AS share FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS target FROM s4),
s6 AS (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3)::BIGINT AS whole FROM s5),
s7 AS (SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM s6),
l0 AS (SELECT source, size, sum(size)::BIGINT AS words FROM base WHERE size > 0 GROUP BY source, size),
l1 AS (SELECT l.source, l.size, s.rest,
              coalesce(sum(l.words) OVER (PARTITION BY l.source ORDER BY l.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
              sum(l.size::DOUBLE * l.words) OVER (PARTITION BY l.source ORDER BY l.size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS measure
       FROM l0 l JOIN s7 s ON l.source IS NOT DISTINCT FROM s.source WHERE s.rest > 0),
l2 AS (SELECT source, max(size) AS size FROM l1 WHERE size * (rest - above) < measure GROUP BY source),
l3 AS (SELECT l1.source, l1.size AS most_drawn, (l1.rest - l1.above) / l1.measure AS slope
       FROM l1 JOIN l2 ON l1.source IS NOT DISTINCT FROM l2.source AND l1.size = l2.size),
r0 AS (SELECT b.doc_id, b.size, b.u, s.*, b.size > coalesce(l3.most_drawn, 0) AS certain,
              greatest(1e-12::DOUBLE, least(1::DOUBLE - 1e-12::DOUBLE, l3.slope * b.size)) AS p
       FROM base b JOIN s7 s ON b.source IS NOT DISTINCT FROM s.source LEFT JOIN l3 ON b.source IS NOT DISTINCT FROM l3.source),
r1 AS (SELECT *, CASE WHEN certain THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS q, rest > 0 AND size > 0 AS can FROM r0),
r2 AS (SELECT *, can AND sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q, doc_id, size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS drawn FROM r1),
r3 AS (SELECT *, rest - sum(CASE WHEN drawn THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN can AND NOT drawn AND abs(gap - size) < gap THEN 0 ELSE 1 END,
                 abs(gap - size), q, doc_id, size) AS n, can AND NOT drawn AND abs(gap - size) < gap AS closes FROM r3)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN drawn OR (closes AND n = 1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r4
"""
