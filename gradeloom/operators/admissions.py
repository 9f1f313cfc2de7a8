"""Tracks, homeworks, applications and their recipients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.functions.udf import nfc


def track_recipients(tracks: DataFrame, enrollments: DataFrame, people: DataFrame) -> DataFrame:
    """Each person of some tracks once, labelled by name, handle or id."""
    who = enrollments.join(F.broadcast(tracks.select("track")), "track", "left_semi").select("tg_id").distinct()
    return who.join(people, "tg_id", "left").select("tg_id", F.coalesce(F.nullif("fio", F.lit("")), F.nullif("username", F.lit("")), F.col("tg_id").cast("string")).alias("label"))


def visible_homeworks(enrollments: DataFrame, homework_tracks: DataFrame, homeworks: DataFrame) -> DataFrame:
    """(tg_id, homework): published homeworks of a person's tracks, each once."""
    pub = homeworks.filter(F.col("status") == "published").select("homework", "num")
    return enrollments.join(homework_tracks, "track").select("tg_id", "homework").distinct().join(pub, "homework").select("tg_id", "homework", "num")


def applications_view(applications: DataFrame, people: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Submitted applications with the person and the sorted tracks."""
    t = enrollments.groupBy("tg_id").agg(F.array_join(F.array_sort(F.collect_set("track")), "; ").alias("tracks"))
    return applications.filter(F.col("status") == "submitted").join(people, "tg_id", "left").join(t, "tg_id", "left").withColumn("tracks", X.text(F.col("tracks")))


def track_counts(tracks: DataFrame, enrollments: DataFrame) -> DataFrame:
    """People by track, empty tracks kept."""
    n = enrollments.groupBy("track").agg(F.count_distinct("tg_id").alias("n"))
    return tracks.select("track").join(n, "track", "left").select("track", F.coalesce("n", F.lit(0)).alias("n"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Keys only here, only there and on both sides, counted."""
    a, b = ours.select(key).distinct().withColumn("_a", F.lit(1)), theirs.select(key).distinct().withColumn("_b", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_ours"), F.count_if(F.col("_a").isNull()).alias("only_theirs"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def enroll_replace(enrollments: DataFrame, submitted: DataFrame) -> DataFrame:
    """The tracks of people who submitted are replaced by the submitted ones."""
    kept = enrollments.join(submitted.select("tg_id").distinct(), "tg_id", "left_anti")
    return kept.select("tg_id", "track").unionByName(submitted.select("tg_id", "track")).dropDuplicates()


def missing_answers(answers: DataFrame, steps: DataFrame, conditions: dict[str, Column] | None = None) -> DataFrame:
    """(tg_id, missing[]): required steps without an answer; multi-choice steps below their minimum.

    ``conditions``: for some steps a condition on the answers without which they are not asked (a faculty, only where the
    university has faculties); a null condition counts as false.

    ``answers``: tg_id, answers map<string,string> (several choices joined by ';'); ``steps``: step, ord, required, least.
    """
    rows = answers.crossJoin(F.broadcast(steps.filter("required")))  # steps are a form's few rows
    value = X.text(F.element_at("answers", F.col("step")))
    n = F.size(F.filter(F.split(value, ";"), lambda v: F.trim(v) != ""))
    asked = F.lit(True)
    for step, cond in (conditions or {}).items():
        asked = asked & ((F.col("step") != step) | F.coalesce(cond, F.lit(False)))
    lack = F.when(asked & (n < F.greatest(F.col("least"), F.lit(1))), F.struct("ord", "step"))
    return rows.groupBy("tg_id").agg(F.transform(F.array_sort(F.collect_list(lack)), lambda s: s["step"]).alias("missing"))


def place_materials(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Destination of every file (name, hash): the rule of the best priority, a copy of a placed one, or 'extra'.

    ``rules``: name, destination, priority. No file disappears; rules without a file come back as 'not found'.
    """
    norm = lambda c: F.lower(F.trim(c))
    r = rules.withColumn("_n", norm(F.col("name"))).groupBy("_n").agg(F.min(F.struct("priority", "destination")).alias("r"))
    got = files.withColumn("_n", norm(F.col("name"))).join(r, "_n", "left")
    placed = got.filter("r is not null").groupBy("hash").agg(F.min("name").alias("twin"))
    out = got.join(placed, "hash", "left").select("name", "hash", F.coalesce("r.destination", F.when(F.col("twin").isNotNull(), F.concat(F.lit("copy of "), "twin")), F.lit("extra")).alias("destination"))
    lost = rules.withColumn("_n", norm(F.col("name"))).join(files.select(norm(F.col("name")).alias("_n")).distinct(), "_n", "left_anti")
    return out.unionByName(lost.select("name", F.lit(None).cast("string").alias("hash"), F.lit("not found").alias("destination")))


def route_materials(files: DataFrame, routes: DataFrame, aliases: DataFrame | None = None, withheld: DataFrame | None = None, data_suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(name, destination, kind) of files (name, hash): no file disappears.

    ``routes`` (name, destination, wanted): a file goes to each of its destinations; of equal contents at one destination
    the first name is ``placed``, the others are a ``copy``. Files without a route are an ``alias`` (name, of) of another
    one, ``withheld`` (name), ``data`` by their suffix, else ``extra``, in that order. Routes without a file come back as
    ``not found`` where they are wanted. Names are compared in Unicode NFC; repeated rows count once, null names are left out.
    """
    keyed = lambda df, *more: df.filter("name is not null").select(nfc(F.col("name")).alias("name"), *more).distinct()
    f, r = keyed(files, "hash"), keyed(routes, "destination", "wanted")
    met = f.join(r.select("name", "destination").distinct(), "name")
    first = met.groupBy(F.col("destination").alias("_to"), F.col("hash").alias("_hash")).agg(F.min("name").alias("_first"))
    same = met.join(first, F.col("destination").eqNullSafe(F.col("_to")) & F.col("hash").eqNullSafe(F.col("_hash")))
    placed = same.select("name", "destination", F.when(F.col("name") == F.col("_first"), "placed").otherwise("copy").alias("kind"))
    rest = f.select("name").distinct().join(r.select("name").distinct(), "name", "left_anti")
    twin, held = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    if aliases is not None:
        rest, twin = rest.join(keyed(aliases, F.col("of").alias("_of")).groupBy("name").agg(F.min("_of").alias("_of")), "name", "left"), F.col("_of")
    if withheld is not None:
        rest, held = rest.join(keyed(withheld, F.lit(True).alias("_held")), "name", "left"), F.col("_held")
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    kind = F.when(twin.isNotNull(), "alias").when(held, "withheld").when(suffix.isin(*data_suffixes) if data_suffixes else F.lit(False), "data").otherwise("extra")
    rest = rest.select("name", twin.alias("destination"), kind.alias("kind"))
    lost = r.filter("wanted").join(f.select("name").distinct(), "name", "left_anti").select("name", "destination", F.lit("not found").alias("kind"))
    return placed.unionByName(rest).unionByName(lost)


def articles_index(catalog: DataFrame) -> DataFrame:
    """Articles by topic, common ones first, by title."""
    group = F.when(F.col("hw") == "common", F.lit("")).otherwise(F.col("hw"))
    return catalog.groupBy("hw").agg(F.min(group).alias("ord"), F.transform(F.array_sort(F.collect_list(F.struct("title", "code"))), lambda s: s["title"]).alias("titles")).orderBy("ord").drop("ord")


def allowed_urls(catalog: DataFrame) -> DataFrame:
    """(url) that a portrait may point to: every external link of the catalog, once."""
    return links_by_topic(catalog).select("url").distinct()


def links_by_topic(catalog: DataFrame) -> DataFrame:
    """(hw, url, title): external links of a topic's articles once, with their first title."""
    links = catalog.select("hw", F.explode(X.external_links(X.extract_links(F.col("body")))).alias("x"))
    return links.groupBy("hw", F.col("x.url").alias("url")).agg(F.min("x.title").alias("title"))
