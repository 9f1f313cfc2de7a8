"""People across imperfect lists: tiered linkage, shared handles, keys, repositories and fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.functions.udf import indel_ratio
from gradeloom.operators.numbering import numbered_in_groups


NAMED = 20


def _tokens(df: DataFrame, alphabet: str) -> DataFrame:
    t = X.name_tokens(F.col("fio"), alphabet)
    return df.withColumn("t", t).withColumn("t1", F.get("t", F.lit(0))).withColumn("t2", F.get("t", F.lit(1)))


def link_people(roster: DataFrame, registrations: DataFrame, alphabet: str = "а-я") -> DataFrame:
    """(key, fio, reg, username, match, note) for roster (key, fio) and registrations (reg, fio, username).

    Tier 1: the unordered pair of the first two tokens. Tier 2: exact surname with a confirmed given name, in the first
    of the two orders that has exactly one candidate. Tier 3: a lone surname that occurs once. Candidates that gave one
    and the same handle are one person; other namesakes stay unmatched. A tier counts its candidates by equi-joins.
    """
    r, g = _tokens(roster.select("key", "fio"), alphabet), _tokens(registrations.select("reg", "fio", "username"), alphabet)
    pair = lambda: F.array_sort(F.array_distinct(F.array("t1", "t2")))
    two = lambda df: df.filter(F.size("t") >= 2)
    summary = [F.count("*").alias("n"), F.min_by("reg", "reg").alias("reg"), F.min_by("username", "reg").alias("username"), F.count_distinct(X.text(F.col("username"))).alias("handles")]
    t1 = two(g).withColumn("p", pair()).groupBy("p").agg(*summary)
    tier1 = two(r).withColumn("p", pair()).join(t1, "p").select("key", F.lit(1).alias("tier"), "n", "reg", "username", "handles", F.lit("exact").alias("kind"))
    # only those without a pair are asked further; surnames meet with a key of the given name, never alone
    surnames = two(g).select(F.col("t1").alias("surname"), F.col("t2").alias("given"), "reg", "username", F.explode(X.given_name_keys(F.col("t2"), True)).alias("k"))
    rest = two(r).join(tier1.select("key"), "key", "left_anti")
    asked = rest.select("key", F.explode(F.array(F.struct(F.lit(2).alias("tier"), F.col("t1").alias("surname"), F.col("t2").alias("asked")), F.struct(F.lit(3).alias("tier"), F.col("t2").alias("surname"), F.col("t1").alias("asked")))).alias("o")).select("key", "o.*")
    asked = asked.withColumn("k", F.explode(X.given_name_keys(F.col("asked"), True)))
    met = asked.join(surnames, ["surname", "k"]).drop("k").distinct()
    tier2 = met.filter(X.confirms_given_name(F.col("given"), F.col("asked")) != "").groupBy("key", "tier").agg(*summary).filter("n = 1")
    tier2 = tier2.select("key", "tier", "n", "reg", "username", "handles", F.lit("diminutive").alias("kind"))
    alone = g.filter(F.size("t") >= 1).groupBy(F.col("t1").alias("surname")).agg(*summary).filter("n = 1")
    tier3 = r.filter(F.size("t") == 1).select("key", F.col("t1").alias("surname")).join(alone, "surname").select("key", F.lit(4).alias("tier"), "n", "reg", "username", "handles", F.lit("surname").alias("kind"))
    best = tier1.unionByName(tier2).unionByName(tier3).groupBy("key").agg(F.min(F.struct("tier", "n", "reg", "username", "handles", "kind")).alias("b"))
    rows = roster.select("key", "fio").join(best, "key", "left").select("key", "fio", "b.*")
    one = (F.col("n") == 1) | ((F.col("handles") == 1) & (X.text(F.col("username")) != ""))
    return rows.select(
        "key", "fio", F.when(one, F.col("reg")).alias("reg"), F.when(one, X.text(F.col("username"))).otherwise("").alias("username"),
        F.when(one, F.col("kind")).otherwise("none").alias("match"),
        F.when(F.col("n").isNull(), "not registered").when(~one, F.concat(F.col("n").cast("string"), F.lit(" namesakes"))).when(X.text(F.col("username")) == "", "handle not recognised").otherwise("").alias("note"),
    )


def invalidate_shared_usernames(links: DataFrame) -> DataFrame:
    """A handle (by lower case) that several people gave is trusted for none of them; the note names them.

    Of many people the first ``NAMED`` by key are named and the others counted, so that a note has a bounded length.
    """
    given = links.filter(F.col("username") != "").select(F.lower("username").alias("u"), "key", "fio")
    first = given.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("key"))).filter(F.col("n") <= NAMED)
    names = first.groupBy("u").agg(X.ordered_join(F.col("key"), F.col("fio"), ", ").alias("who"))
    shared = given.groupBy("u").agg(F.count("*").alias("c")).filter("c > 1").join(names, "u")
    rows = links.join(shared, F.lower("username") == F.col("u"), "left")
    bad = F.col("c").isNotNull()
    more = F.when(F.col("c") > NAMED, F.concat(F.lit(" and "), F.col("c") - NAMED, F.lit(" more"))).otherwise("")
    note = F.concat(F.lit("handle @"), F.col("u"), F.lit(" given by several people: "), F.col("who"), more)
    return rows.select("key", "fio", "reg", F.when(bad, "").otherwise(F.col("username")).alias("username"), F.when(bad, "none").otherwise(F.col("match")).alias("match"), F.when(bad, note).otherwise(F.col("note")).alias("note"))


def usable_contact(c: DataFrame) -> DataFrame:
    """F25."""
    return c.filter((X.text(F.col("username")) != "") & (F.col("match") != "none") & (X.text(F.col("exists")) != "no"))


def link_quality_counts(links: DataFrame) -> DataFrame:
    """A19."""
    return links.groupBy("match").agg(F.count("*").alias("n"), F.count_if(F.col("username") != "").alias("with_username"))


def contact_counts(contacts: DataFrame) -> DataFrame:
    """(part, value, n) of contacts (key, username, match, exists): by kind of match, by existence, with a handle, usable.

    Nulls count as ''. All four come from one pass: counts by (match, exists, handle) first, then over those few rows.
    """
    rows = contacts.select(X.text(F.col("match")).alias("match"), X.text(F.col("exists")).alias("exists"), (X.text(F.col("username")) != "").alias("found"))
    few = rows.groupBy("match", "exists", "found").agg(F.count("*").alias("n"))
    usable = F.col("found") & (F.col("match") != "none") & (F.col("exists") != "no")
    word = lambda c: F.when(c, "yes").otherwise("no")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in (("match", F.col("match")), ("exists", F.col("exists")), ("username", word(F.col("found"))), ("usable", word(usable)))])
    return few.select(F.explode(parts).alias("p"), "n").groupBy("p.part", "p.value").agg(F.sum("n").alias("n"))


def assign_keys(rows: DataFrame, order: str = "ord") -> DataFrame:
    """A key for each person (ord, owner, repo, fio): the login, else the name.

    In a collision all members get the repository's name, or their place among them, at the end.
    """
    base = F.lower(F.coalesce(F.nullif(F.col("owner"), F.lit("")), F.nullif(F.regexp_replace(X.text(F.col("fio")), r"(?U)\W+", "_"), F.lit("")), F.lit("unknown")))
    # everyone without login and name has one base, so a base may be a large group
    rows = numbered_in_groups(rows.withColumn("_base", base), "_base", order)
    tail = F.regexp_replace(F.lower(F.coalesce(F.nullif(F.col("repo"), F.lit("")), F.col("_rn").cast("string"))), r"(?U)\W+", "-")
    return rows.withColumn("key", F.when(F.col("_count") > 1, F.concat(F.col("_base"), F.lit("__"), tail)).otherwise(F.col("_base"))).drop("_base", "_count", "_rn")


def find_by_repo(queries: DataFrame, students: DataFrame) -> DataFrame:
    """(q, key): the student whose link equals the asked one, else whose owner and repository do."""
    norm = lambda c: F.lower(X.normalize_repo_url(F.col(c)))
    two = lambda c: F.array_join(F.slice(F.split(F.col(c), "/"), 1, 2), "/")
    q = queries.select("q", norm("url").alias("u")).withColumn("s", two("u"))
    s = students.select("key", norm("url").alias("u")).filter("u <> ''").withColumn("s", two("u"))
    whole, short = s.groupBy("u").agg(F.min("key").alias("k1")), s.groupBy("s").agg(F.min("key").alias("k2"))
    return q.join(whole, "u", "left").join(short, "s", "left").select("q", F.coalesce("k1", "k2").alias("key"))


def best_profile_repo(owners: DataFrame, repos: DataFrame) -> DataFrame:
    """For a profile link the repository (owner, repo, ord) of the best name, the first of equals; 0 is missing."""
    scored = repos.withColumn("score", X.score_repo_name(F.col("repo")))
    best = scored.groupBy("owner").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "repo")).alias("b"))
    return owners.join(best, "owner", "left").select(*owners.columns, F.when(F.col("b.score") > 0, F.col("b.repo")).alias("repo"), F.coalesce("b.score", F.lit(0)).alias("score"))


CONFIDENT = 80  # fixed value: names that score less are no hint


def rename_hints(excluded: DataFrame, repos: DataFrame) -> DataFrame:
    """(fio, owner, repo): for people left out, the owner's best repository, where its name scores high enough for a renamed one."""
    best = best_profile_repo(excluded.select("fio", "owner").filter("owner is not null"), repos)
    return best.filter(F.col("score") >= CONFIDENT).select("fio", "owner", "repo")


def resolve_roster(roster: DataFrame, repo_meta: DataFrame, owner_meta: DataFrame) -> DataFrame:
    """Status of each link from fetched metadata: ok with the canonical name, missing_repo, owner_missing, no_url."""
    meta = repo_meta.select(F.lower("full_name").alias("_slug"), F.col("full_name").alias("canonical"), "pushed_at")
    own = owner_meta.select(F.lower("owner").alias("_own"), F.lit(True).alias("_known"))
    rows = roster.withColumn("_slug", F.lower(F.concat_ws("/", "owner", "repo"))).withColumn("_own", F.lower("owner")).join(meta, "_slug", "left").join(own, "_own", "left")
    status = F.when(F.col("owner").isNull(), "no_url").when(F.col("canonical").isNotNull(), "ok").when(F.col("_known"), "missing_repo").otherwise("owner_missing")
    return rows.withColumn("status", status).drop("_slug", "_own", "_known")


def plan_fetch(roster: DataFrame, stamps: DataFrame, force: bool = False) -> DataFrame:
    """Cached if the stamp equals the time of the last push."""
    rows = roster.join(stamps, "key", "left")
    return rows.withColumn("action", F.when(F.col("stamp").eqNullSafe(F.coalesce(F.col("pushed_at").cast("string"), F.lit(""))) & F.lit(not force), "cached").otherwise("fetch"))


def qgrams(c, q: int = 2):
    """Distinct q-grams of a string; a shorter string has none."""
    made = F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.substring(c, i, F.lit(q)))
    return F.when(F.length(c) >= q, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _grams(df: DataFrame, key: str, value: str, cutoff: float) -> DataFrame:
    """(key, value, g, n, need) of the grams a string may be joined by; need is how many of the rarest are enough.

    A ratio of c percent lets a string of length n lose at most n (200 - 2c) / (200 - c) characters, each of which is in
    q grams. Strings that could lose all their pairs are joined by single characters as well.
    """
    lost = F.floor(F.length(value) * ((200 - 2 * cutoff) / (200 - cutoff)) + 1e-9)
    rows = df.select(key, value, lost.alias("_lost"), qgrams(F.col(value), 2).alias("_two"), qgrams(F.col(value), 1).alias("_one"))
    two = rows.select(key, value, F.explode("_two").alias("g"), F.size("_two").alias("n"), (2 * F.col("_lost") + 1).alias("need"))
    one = rows.filter(F.size("_two") <= 2 * F.col("_lost")).select(key, value, F.explode("_one").alias("g"), F.size("_one").alias("n"), F.when(F.size("_one") <= F.col("_lost"), F.size("_one")).otherwise(F.col("_lost") + 1).alias("need"))
    return two.unionByName(one)


def fuzzy_join(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs (l, r, score) of (l, a) and (r, b) with an Indel ratio of at least ``cutoff`` (percent), without loss.

    Grams are ordered by frequency, rare first, and each string is joined by as few of them as its length allows; the
    lengths are filtered by c / (200 - c), the bound of the length ratio. Candidates are verified.
    """
    bound = cutoff / (200 - cutoff)
    lg, rg = _grams(left, "l", "a", cutoff), _grams(right, "r", "b", cutoff)
    freq = lg.select("g").unionByName(rg.select("g")).groupBy("g").agg(F.count("*").alias("f"))

    def rarest(df: DataFrame, key: str, value: str) -> DataFrame:
        w = Window.partitionBy(key, F.length("g")).orderBy("f", "g")
        return df.join(freq, "g").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= F.col("need")).select(key, value, "g")

    close = (F.length("a") >= F.length("b") * bound - 1e-9) & (F.length("b") >= F.length("a") * bound - 1e-9)
    cand = rarest(lg, "l", "a").join(rarest(rg, "r", "b"), "g").filter(close).select("l", "a", "r", "b").distinct()
    return cand.withColumn("score", indel_ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= cutoff).select("l", "r", "score")


def fuzzy_find(queries: DataFrame, names: DataFrame, k: int = 5, cutoff: float = 60.0, confident: float = 82.0) -> DataFrame:
    """The best ``k`` names for each query of 4 characters or more, by token-sorted Indel ratio."""
    flat = lambda c: F.array_join(F.array_sort(F.split(X.simple_name(F.col(c)), " ")), " ")
    l = queries.filter(F.length("q") >= 4).select(F.col("q").alias("l"), flat("q").alias("a"))
    found = fuzzy_join(l, names.select(F.col("key").alias("r"), flat("fio").alias("b")), cutoff)
    w = Window.partitionBy("l").orderBy(F.desc("score"), "r")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select(F.col("l").alias("q"), F.col("r").alias("key"), "score", "place", (F.col("score") >= confident).alias("confident"))


def match_awards(files: DataFrame, holders: DataFrame, cutoff: float = 88.0) -> DataFrame:
    """(key, file, how): files (file, name, ord) to holders (key, fio): same name, same words, best similarity.

    The first file wins for a holder; how is 'none' for files nobody matches.
    """
    f = files.withColumn("a", X.letters_only(F.col("name"))).withColumn("w", F.array_join(F.array_sort(F.array_distinct(F.split(X.simple_name(F.col("name")), " "))), " "))
    h = holders.withColumn("b", X.letters_only(F.col("fio"))).withColumn("w", F.array_join(F.array_sort(F.array_distinct(F.split(X.simple_name(F.col("fio")), " "))), " "))
    exact = f.join(h.select("key", "b"), F.col("a") == F.col("b")).select("file", "key", F.lit(0).alias("tier"), F.lit(100.0).alias("score"))
    words = f.join(h.select("key", "w"), "w").select("file", "key", F.lit(1).alias("tier"), F.lit(100.0).alias("score"))
    near = fuzzy_join(f.select(F.col("file").alias("l"), "a"), h.select(F.col("key").alias("r"), "b"), cutoff).select(F.col("l").alias("file"), F.col("r").alias("key"), F.lit(2).alias("tier"), "score")
    w = Window.partitionBy("file").orderBy("tier", F.desc("score"), "key")
    best = exact.unionByName(words).unionByName(near).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").join(files.select("file", "ord"), "file")
    first = best.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ord")))
    how = F.when(F.col("tier").isNull(), "none").when(F.col("n") > 1, "duplicate").otherwise(F.element_at(F.array(F.lit("exact"), F.lit("words"), F.lit("similar")), F.col("tier") + 1))
    return files.join(first.drop("ord"), "file", "left").select("file", F.when(F.col("n") == 1, F.col("key")).alias("key"), how.alias("how"))


def expected_username(contacts: DataFrame, students: DataFrame) -> DataFrame:
    """(key, username) by student: the handle a binding should come from; '' if none is usable."""
    known = usable_contact(contacts).select("key", F.lower("username").alias("username"))
    return students.select("key").join(known, "key", "left").select("key", X.text(F.col("username")).alias("username"))


def username_index(contacts: DataFrame, students: DataFrame) -> DataFrame:
    """Handles of known students in lower case."""
    return usable_contact(contacts).join(students.select("key"), "key", "left_semi").select(F.lower("username").alias("username"), "key")


def merge_contacts(students: DataFrame, contacts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Confirmed by a binding, else by a usable form entry, else none."""
    b = bindings.select("key", F.col("username").alias("bound"))
    c = usable_contact(contacts).select("key", F.col("username").alias("form"))
    rows = students.select("key").join(b, "key", "left").join(c, "key", "left")
    return rows.select("key", F.coalesce("bound", "form", F.lit("")).alias("username"), F.when(F.col("bound").isNotNull(), "bot").when(F.col("form").isNotNull(), "form").otherwise("none").alias("source"))
