"""Cohort statistics, rankings and study plans over (students, hw, topics, findings, catalog)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.operators.numbering import numbered


def active(students: DataFrame) -> DataFrame:
    return students.filter(F.col("status") == "ok")


def active_results(hw: DataFrame, students: DataFrame) -> DataFrame:
    return hw.join(active(students).select("key"), "key", "left_semi")


def topic_stats(hw: DataFrame, students: DataFrame, topics: DataFrame) -> DataFrame:
    """Submitted and passed by topic; topics without any are kept. Topics are a small dimension."""
    counted = active_results(hw, students).groupBy("hw").agg(F.count_if(F.col("status") != "missing").alias("submitted"), F.count_if(F.col("status") == "passed").alias("passed"))
    return topics.join(counted, "hw", "left").select("hw", "graded", F.coalesce("submitted", F.lit(0)).alias("submitted"), F.coalesce("passed", F.lit(0)).alias("passed"))


def code_counts(findings: DataFrame, students: DataFrame) -> DataFrame:
    return findings.join(active(students).select("key"), "key", "left_semi").groupBy("hw", "code").agg(F.count("*").alias("n"))


def top_codes(counts: DataFrame, n: int) -> DataFrame:
    """The most frequent codes of each topic, ties by code."""
    w = Window.partitionBy("hw").orderBy(F.desc("n"), "code")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def topic_overview(hw: DataFrame, students: DataFrame, topics: DataFrame, findings: DataFrame, n: int = 2) -> DataFrame:
    """Submissions, passes and the ``n`` most frequent codes of every topic in one row."""
    best = top_codes(code_counts(findings, students), n).groupBy("hw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda s: s["code"]), ",").alias("codes"))
    return topic_stats(hw, students, topics).join(best, "hw", "left").withColumn("share", F.bround(F.col("passed") / F.greatest(F.col("submitted"), F.lit(1)), 4))


def typical_errors(hw: DataFrame, students: DataFrame, findings: DataFrame, catalog: DataFrame, n: int = 12) -> DataFrame:
    """Findings by code with their share of the topic's submissions; topics without submissions are left out."""
    subs = active_results(hw, students).filter(F.col("status") != "missing").groupBy("hw").agg(F.count("*").alias("submissions"))
    rows = top_codes(code_counts(findings, students).join(subs, "hw"), n).join(catalog.select("code", "title"), "code", "left")
    return rows.select("hw", "code", F.coalesce("title", F.lit("other")).alias("title"), "n", "submissions", F.bround(F.col("n") / F.col("submissions"), 3).alias("share"), "place")


def passed_counts(hw: DataFrame, students: DataFrame, topics: DataFrame) -> DataFrame:
    """Passed graded topics of each active student, zero included, and whether that makes a certificate."""
    graded = topics.filter("graded").select("hw")
    n = F.count_if(F.col("st") == "passed")
    done = hw.join(graded, "hw", "left_semi").select("key", F.col("status").alias("st")).groupBy("key").agg(n.alias("passed"))
    total = graded.agg(F.count("*").alias("total"))  # one row
    rows = active(students).select("key", "fio").join(done, "key", "left").crossJoin(F.broadcast(total))
    return rows.select("key", "fio", F.coalesce("passed", F.lit(0)).alias("passed"), "total").withColumn("certified", F.col("passed") >= X.required_for(F.lit(X.CERTIFICATE_RATIO), F.col("total")))


def distribution(passed: DataFrame, only: Column | None = None) -> DataFrame:
    """People by number of passed topics."""
    return (passed if only is None else passed.filter(only)).groupBy("passed").agg(F.count("*").alias("people"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """A06."""
    return findings.groupBy("key").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")])


def median_passed(passed: DataFrame) -> DataFrame:
    """0 for an empty cohort."""
    return passed.agg(F.coalesce(F.median("passed"), F.lit(0.0)).alias("median_passed"))


def cohort_summary(students: DataFrame, hw: DataFrame, passed: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """One row of totals; with ``bindings`` also the active students that have an account bound."""
    a = students.agg(F.count("*").alias("in_form"), F.count_if(F.col("status") == "ok").alias("active"), F.count_if(F.col("status") != "ok").alias("excluded"))
    b = active_results(hw, students).agg(F.count_if(F.col("status") != "missing").alias("submissions"), F.count_if(F.col("status") == "passed").alias("passed"))
    c = passed.agg(F.count_if("certified").alias("certificates"), F.coalesce(F.median("passed"), F.lit(0.0)).alias("median_passed"))
    out = a.crossJoin(b).crossJoin(c)  # one row each
    if bindings is None:
        return out
    return out.crossJoin(passed.join(bindings.select("key"), "key", "left_semi").agg(F.count("*").alias("bound")))


def percentile(passed: DataFrame) -> DataFrame:
    """Share of active students with at most as many passed topics, in whole percent, half-even.

    Counted by distinct value first, so the running sum goes over a few rows.
    """
    by = passed.groupBy("passed").agg(F.count("*").alias("n"))
    cum = by.select("passed", F.sum("n").over(Window.orderBy("passed")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("every"))
    pct = F.bround(100 * F.col("upto") / F.col("every"), 0).cast("int")
    return passed.join(F.broadcast(cum), "passed").select("key", "passed", pct.alias("percentile"), X.place_bucket(pct).alias("place"))


def number_certified(passed: DataFrame) -> DataFrame:
    rows = passed.filter("certified").withColumn("_name", F.lower("fio"))
    return numbered(rows, "_name", "key").select("number", "key", "fio", "passed", "total")


def passed_matrix(hw: DataFrame, students: DataFrame, ids: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """A status column for each topic; with ``pairs`` (me, hw, other), seen from both sides, also how many a student is in."""
    cells = [F.coalesce(F.max(F.when(F.col("hw") == i, F.col("status"))), F.lit("missing")).alias(f"t{i}") for i in ids]
    got = active(students).select("key", "fio").join(hw.select("key", "hw", "status"), "key", "left")
    out = got.groupBy("key", "fio").agg(*cells)
    if pairs is None:
        return out
    n = pairs.groupBy(F.col("me").alias("key")).agg(F.count("*").alias("similar"))
    return out.join(n, "key", "left").withColumn("similar", F.coalesce("similar", F.lit(0)))


def enrich_findings(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Title and kind from the catalog, the code where it has none."""
    return findings.join(catalog, "code", "left").select("key", "hw", "code", "severity", F.coalesce("title", "code").alias("title"), "kind")


def enrich_whole(findings: DataFrame, articles: DataFrame) -> DataFrame:
    """Findings (key, hw, code, severity, title) with what their article (code, title, kind, links) says.

    Without an article the finding keeps its own title, or its code; ``article`` is the code of the one there is.
    """
    a = articles.select("code", F.col("title").alias("_title"), "kind", "links", F.col("code").alias("article"))
    title = F.coalesce("_title", F.nullif(F.col("title"), F.lit("")), F.col("code"))
    links = F.coalesce("links", F.array().cast(articles.schema["links"].dataType))
    return findings.join(a, "code", "left").select("key", "hw", "code", "severity", title.alias("title"), "kind", links.alias("links"), "article")


def plan_weights(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """Weight of each methodology code of a student, number of hygiene codes, first topic."""
    rows = findings.join(catalog.select("code", "kind"), "code")
    return rows.groupBy("key", "kind", "code").agg(F.sum(X.severity_weight(F.col("severity"))).alias("weight"), F.count("*").alias("n"), F.min("hw").alias("first_hw"))


def plan_top(weights: DataFrame, n: int = 3) -> DataFrame:
    """The heaviest methodology codes and the most frequent hygiene codes of each student."""
    value = F.when(F.col("kind") == "methodology", F.col("weight")).otherwise(F.col("n"))
    w = Window.partitionBy("key", "kind").orderBy(F.desc("value"), "code")
    return weights.withColumn("value", value).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("key", "kind", "place", "code", "value", "first_hw")


def critical_titles(findings: DataFrame) -> DataFrame:
    """(key, hw, criticals): titles of the critical findings of a student's topic, by code; the code where there is no title."""
    one = F.struct("code", F.coalesce("title", "code").alias("t"))
    return findings.filter(F.col("severity") == "critical").groupBy("key", "hw").agg(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["t"]).alias("criticals"))


def _titles() -> Column:
    return F.coalesce("criticals", F.array().cast("array<string>"))


def failed_topics(hw: DataFrame, topics: DataFrame, findings: DataFrame) -> DataFrame:
    """Graded failed topics with their reasons, in topic order. ``findings``: key, hw, code, severity, title."""
    rows = hw.filter(F.col("status") == "failed").join(topics.filter("graded").select("hw"), "hw", "left_semi").join(critical_titles(findings), ["key", "hw"], "left")
    line = F.concat(F.col("hw"), F.lit(": "), X.why_failed(F.col("required_passed"), F.col("required_total"), _titles()))
    return rows.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(line)), " | ").alias("topics"), F.count("*").alias("n"))


def sort_findings(findings: DataFrame) -> DataFrame:
    """Place of each finding in its topic, by severity, then code."""
    w = Window.partitionBy("key", "hw").orderBy(X.severity_rank(F.col("severity")), "code")
    return findings.withColumn("place", F.row_number().over(w))


def summary_top(passed: DataFrame, n: int) -> DataFrame:
    """The first rows of the summary."""
    return passed.orderBy(F.desc("passed"), "fio", "key").limit(n)


def example_students(passed: DataFrame) -> DataFrame:
    """One certified and one uncertified example."""
    best = F.min(F.struct((-F.col("passed")).alias("p"), "fio", "key"))
    pick = lambda c: F.min(F.when(c, F.struct((-F.col("passed")).alias("p"), "fio", "key")))["key"]
    return passed.agg(F.coalesce(pick(F.col("certified")), best["key"]).alias("with_certificate"), F.coalesce(pick(~F.col("certified") & (F.col("passed") > 0)), pick(~F.col("certified")), best["key"]).alias("without"))


def student_digest(hw: DataFrame, findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """One text for each student: topics in order with points and findings; no name in it."""
    rows = findings.join(catalog.select("code", "kind"), "code", "left")
    line = F.concat(F.lit("- "), F.col("code"), F.lit(" ["), F.coalesce("kind", F.lit("?")), F.lit("] "), F.col("severity"))
    found = rows.groupBy("key", "hw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(X.severity_rank(F.col("severity")).alias("r"), "code", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    head = F.concat(F.lit("## "), F.col("hw"), F.lit(" "), F.col("status"), F.lit(" "), F.col("required_passed"), F.lit("/"), F.col("required_total"))
    topic = hw.join(found, ["key", "hw"], "left").select("key", "hw", F.concat_ws("\n", head, "lines").alias("t"))
    return topic.groupBy("key").agg(X.ordered_join(F.col("hw"), F.col("t"), "\n\n").alias("digest"))


def digest_whole(students: DataFrame, hw: DataFrame, findings: DataFrame, catalog: DataFrame, topics: DataFrame, ratio: float = X.PASS_RATIO) -> DataFrame:
    """A24 with all its parts: (key, digest) for students (key, passed, total, certified) with some submission.

    ``hw``: key, hw, status, required_passed, required_total, summary, strengths. ``findings``: key, hw, code, severity,
    title, comment. ``topics``: hw, title, graded. Comments are cut at 200 characters and kept for methodology only.
    Findings are those of one topic of one student, topics those of a course.
    """
    kind = F.coalesce("kind", F.lit("methodology"))
    rows = findings.join(catalog.select("code", "kind"), "code", "left")
    comment = F.when((kind == "methodology") & (X.text(F.col("comment")) != ""), F.concat(F.lit(": "), F.substring("comment", 1, 200))).otherwise("")
    line = F.concat(F.lit("- "), "code", F.lit(" — "), "title", F.lit(" ["), "severity", F.lit(", "), kind, F.lit("]"), comment)
    listed = F.array_sort(F.collect_list(F.struct(X.severity_rank(F.col("severity")).alias("r"), "code", line.alias("line"), F.concat("code", F.lit(" — "), "title").alias("why"))))
    found = rows.groupBy("key", "hw").agg(listed.alias("f"))
    need = X.points_needed(F.lit(ratio), F.col("required_total"))
    some = F.col("required_total") > 0
    why = F.concat(F.when(some & (F.col("required_passed") < need), F.array(F.lit("too few points"))).otherwise(F.array().cast("array<string>")), F.transform(F.filter(F.coalesce("f", F.array().cast(found.schema["f"].dataType)), lambda x: x["r"] == 0), lambda x: x["why"]))
    head = F.concat(F.lit("## "), "hw", F.lit(" · "), F.coalesce("title", "hw"), F.when(F.coalesce("graded", F.lit(True)), "").otherwise(" (not graded)"))
    text = lambda label, c: F.when(X.text(F.col(c)) != "", F.concat(F.lit(label), F.col(c)))
    body = F.concat_ws(
        "\n", F.concat(head, F.lit(" — "), "status"), F.when(some, F.concat(F.lit("Items: "), "required_passed", F.lit(" of "), "required_total", F.lit(" (needed "), need.cast("int"), F.lit(")"))),
        F.when(F.col("status") == "failed", F.concat(F.lit("Why failed: "), F.array_join(why, "; "))), text("Summary: ", "summary"), text("Strengths: ", "strengths"),
        F.when(F.size("f") > 0, F.concat(F.lit("Findings:\n"), F.array_join(F.transform("f", lambda x: x["line"]), "\n"))),
    )
    topic = hw.join(found, ["key", "hw"], "left").join(F.broadcast(topics), "hw", "left")
    topic = topic.select("key", "hw", F.when(F.col("status") == "missing", F.concat(head, F.lit("\nnot submitted"))).otherwise(body).alias("t"), (F.col("status") != "missing").alias("there"))
    per = topic.groupBy("key").agg(X.ordered_join(F.col("hw"), F.col("t"), "\n\n").alias("topics"), F.max("there").alias("there")).filter("there")
    first = F.concat(F.lit("# Student "), F.col("key").cast("string"), F.lit("\nPassed: "), "passed", F.lit(" of "), "total", F.lit(". Certificate: "), F.when(F.col("certified"), "yes").otherwise("no"))
    return per.join(students, "key").select("key", F.concat_ws("\n\n", first, "topics").alias("digest"))


def chapters(hw: DataFrame, topics: DataFrame, topic_links: DataFrame, handbook: str = "handbook", n: int = 5) -> DataFrame:
    """(key, place, hw, title, url): a chapter for each failed graded topic, the handbook's first, each once.

    ``topic_links``: hw, title, url.
    """
    best = topic_links.groupBy("hw").agg(F.min(F.struct((~F.col("url").contains(handbook)).alias("o"), "title", "url")).alias("b"))
    failed = hw.filter(F.col("status") == "failed").join(topics.filter("graded").select("hw"), "hw", "left_semi").select("key", "hw")
    rows = failed.join(F.broadcast(best), "hw").select("key", "hw", F.col("b.title").alias("title"), F.col("b.url").alias("url"))
    once = rows.groupBy("key", "title", "url").agg(F.min("hw").alias("hw"))
    w = Window.partitionBy("key").orderBy("hw", "url")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("key", "place", "hw", "title", "url")


def plan_lines(top: DataFrame, growth: DataFrame, n: int = 5) -> DataFrame:
    """(key, place, title, source): a portrait's growth points (key, pos, title) where there are some, else the top codes (plan_top)."""
    grown = growth.filter(F.col("pos") < n).select("key", (F.col("pos") + 1).alias("place"), "title", F.lit("portrait").alias("source"))
    codes = top.filter("kind = 'methodology'").join(growth.select("key").distinct(), "key", "left_anti")
    return grown.unionByName(codes.select("key", "place", F.col("code").alias("title"), F.lit("codes").alias("source")))


def unbound_names(passed: DataFrame, bindings: DataFrame, n: int = 40, certified: bool = True) -> DataFrame:
    """The first ``n`` active students without a binding, by name: those who have earned a certificate, or all of them."""
    rows = passed.filter("certified") if certified else passed
    return rows.join(bindings.select("key"), "key", "left_anti").select("key", "fio").orderBy("fio", "key").limit(n)


def demo_audience(bindings: DataFrame) -> DataFrame:
    """(tg_id, label) of accounts that are bound to demo students only (bindings: tg_id, tg_name, demo)."""
    real = bindings.filter(~F.coalesce("demo", F.lit(False))).select("tg_id")
    rows = bindings.filter(F.coalesce("demo", F.lit(False))).join(real, "tg_id", "left_anti")
    return rows.groupBy("tg_id").agg(F.coalesce(F.nullif(F.min("tg_name"), F.lit("")), F.first(F.col("tg_id").cast("string"))).alias("label"))


def own_audience(bindings: DataFrame, who: int | None) -> DataFrame:
    """(tg_id, label) of the sender alone; nobody if there is none."""
    me = bindings.sparkSession.createDataFrame([(who, "you")] if who else [], "tg_id long, label string")
    return me


def audience(passed: DataFrame, bindings: DataFrame, who: str) -> DataFrame:
    """(key, tg_id or null) of an audience: all, cert or nocert; null is unreachable. See also demo_audience, own_audience."""
    pick = {"all": F.lit(True), "cert": F.col("certified"), "nocert": ~F.col("certified")}[who]
    return passed.filter(pick).join(bindings, "key", "left").select("key", "tg_id", F.col("tg_id").isNotNull().alias("reachable"))


def binding_coverage(passed: DataFrame, bindings: DataFrame) -> DataFrame:
    """Bound and unbound active students."""
    rows = passed.join(bindings, "key", "left")
    return rows.agg(F.count("*").alias("active"), F.count("tg_id").alias("bound"), F.count_if(F.col("tg_id").isNull()).alias("unbound"), F.count_if(F.col("tg_id").isNull() & F.col("certified")).alias("unbound_certified"))


def compare_builds(before: DataFrame, after: DataFrame, students: DataFrame, findings: DataFrame) -> DataFrame:
    """Topics whose status differs between two builds, for active students with results in both, and why.

    ``findings``: key, hw, code, severity, title of the later build; its critical ones are named in the reason.
    """
    b = before.select("key", "hw", F.col("status").alias("was"))
    both = after.join(b, ["key", "hw"]).filter(F.col("status") != F.col("was")).join(active(students).select("key"), "key", "left_semi")
    both = both.join(critical_titles(findings), ["key", "hw"], "left")
    return both.select("key", "hw", "was", F.col("status").alias("now"), X.why_failed(F.col("required_passed"), F.col("required_total"), _titles()).alias("why"))


def diff_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Of two tables of passed_counts, students compared, certificates and changes."""
    b = before.select("key", F.col("passed").alias("p0"), F.col("certified").alias("c0"))
    j = after.join(b, "key")
    return j.agg(
        F.count("*").alias("compared"), F.count_if("c0").alias("certificates_before"), F.count_if("certified").alias("certificates_after"),
        F.count_if(F.col("certified") & ~F.col("c0")).alias("gained"), F.count_if(~F.col("certified") & F.col("c0")).alias("lost"),
        F.count_if(F.col("passed") > F.col("p0")).alias("more"), F.count_if(F.col("passed") < F.col("p0")).alias("fewer"),
    )


def topic_passes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(hw, passed_before, passed_after, gained, lost) of two builds (key, hw, status), for students in both."""
    b = before.select("key", "hw", (F.col("status") == "passed").alias("p0"))
    j = after.select("key", "hw", (F.col("status") == "passed").alias("p1")).join(b, ["key", "hw"])
    return j.groupBy("hw").agg(F.count_if("p0").alias("passed_before"), F.count_if("p1").alias("passed_after"), F.count_if(F.col("p1") & ~F.col("p0")).alias("gained"), F.count_if(F.col("p0") & ~F.col("p1")).alias("lost"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, people) of two tables of passed_counts: how many students gained or lost how many topics."""
    j = after.select("key", "passed").join(before.select("key", F.col("passed").alias("p0")), "key")
    return j.groupBy((F.col("passed") - F.col("p0")).cast("int").alias("change")).agg(F.count("*").alias("people"))


def strengths_list(hw: DataFrame) -> DataFrame:
    """Non-empty strengths (key, hw, strengths) of each student in topic order."""
    rows = hw.filter(F.trim(X.text(F.col("strengths"))) != "")
    return rows.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("hw", "strengths"))), lambda s: s["strengths"]).alias("strengths"))


def best_links(findings: DataFrame, article_links: DataFrame, topic_links: DataFrame, handbook: str = "handbook") -> DataFrame:
    """The best link of each finding (key, hw, code): its article's, else its topic's; the handbook first, then by title.

    ``article_links``: code, title, url. ``topic_links``: hw, title, url.
    """
    order = lambda: F.struct((~F.col("url").contains(handbook)).alias("o"), "title", "url")
    own = article_links.groupBy("code").agg(F.min(order()).alias("a"))
    topic = topic_links.groupBy("hw").agg(F.min(order()).alias("t"))
    rows = findings.join(own, "code", "left").join(topic, "hw", "left")
    return rows.select("key", "hw", "code", F.coalesce("a.title", "t.title").alias("title"), F.coalesce("a.url", "t.url").alias("url"))


AUDIENCES: dict = {}


def register_audience(name: str, pick) -> None:
    """An audience of the user's own: a function from the tables passed to ``targets`` to a DataFrame with ``key``."""
    AUDIENCES[name] = pick


def targets(name: str, passed: DataFrame, bindings: DataFrame, **tables: DataFrame) -> DataFrame:
    """(key, tg_id, reachable) of a registered audience or of one of ``audience``'s own."""
    if name not in AUDIENCES:
        return audience(passed, bindings, name)
    keys = AUDIENCES[name](passed=passed, bindings=bindings, **tables).select("key").distinct()
    return keys.join(bindings, "key", "left").select("key", "tg_id", F.col("tg_id").isNotNull().alias("reachable"))


def fetch_counts(results: DataFrame) -> DataFrame:
    """Cloned, cached, empty and failed works."""
    return results.groupBy("outcome").agg(F.count("*").alias("n"))
