"""Merging automatic and reviewer results into verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import expr as X

UNCONFIRMED = "(reviewer's opinion, not confirmed by the rule) "


def apply_review_checks(checks: DataFrame, reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings (key, hw, code, severity, title, comment, minus) of judged items that a review did not pass.

    ``checks``: hw, check_id, title, required. ``reviews``: key, hw, check_id, passed, comment. A missing or passed item
    gives nothing; a failed required item takes one point.
    """
    failed = reviews.filter(~F.coalesce("passed", F.lit(True)))
    rows = failed.join(F.broadcast(checks), ["hw", "check_id"]).withColumn("code", F.concat_ws(".", "hw", "check_id"))
    rows = rows.join(F.broadcast(catalog.select("code", F.col("severity").alias("_s"), F.col("title").alias("_t"))), "code", "left")
    return rows.select("key", "hw", "code", F.coalesce("_s", F.lit("major")).alias("severity"), F.coalesce("_t", "title").alias("title"), "comment", F.col("required").cast("int").alias("minus"))


def normalize_codes(items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Codes of review items (key, hw, pos, code, comment) as catalog codes: as written, common, or the topic's; null if unknown.

    Case counts. The catalog is a course's, a small dimension.
    """
    known = lambda name: catalog.select(F.col("code").alias(name))
    bare = F.trim(X.text(F.col("code")))
    rows = items.withColumn("c1", bare).withColumn("c2", F.concat(F.lit("common."), bare)).withColumn("c3", F.concat_ws(".", "hw", bare))
    for c in ("c1", "c2", "c3"):
        rows = rows.join(F.broadcast(known(c).withColumn(f"_{c}", F.col(c))), c, "left")
    return rows.select("key", "hw", "pos", "comment", F.coalesce("_c1", "_c2", "_c3").alias("code"))


def merge_review_findings(rule_findings: DataFrame, items: DataFrame, catalog: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Rule findings (key, hw, code, severity, comment) with those of a review (key, hw, pos, code, comment).

    ``judged``: findings of judged items (J07), which come before the review's own. Unknown codes become one minor
    ``other`` for a topic, the first by position; a critical code that a rule checks and did not find counts as major,
    with a note. A code is there once: a rule's finding before a judged one before the review's.
    """
    named = normalize_codes(items, catalog).withColumn("code", F.coalesce("code", F.concat(F.col("hw"), F.lit(".other"))))
    w = Window.partitionBy("key", "hw", "code").orderBy("pos")
    first = named.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    rows = first.join(F.broadcast(catalog.select("code", F.col("severity").alias("_s"), F.col("detector").alias("_d"))), "code", "left")
    capped = (F.col("_d") == "rule") & (F.col("_s") == "critical")
    rows = rows.select(
        "key", "hw", "code", F.when(capped, "major").otherwise(F.coalesce("_s", F.lit("minor"))).alias("severity"),
        F.when(capped, F.concat(F.lit(UNCONFIRMED), X.text(F.col("comment")))).otherwise(X.text(F.col("comment"))).alias("comment"), F.lit("review").alias("source"),
    )
    if judged is not None:
        rows = rows.join(judged.select("key", "hw", "code"), ["key", "hw", "code"], "left_anti")
        rows = rows.unionByName(judged.select("key", "hw", "code", "severity", "comment", F.lit("review").alias("source")))
    rows = rows.join(rule_findings.select("key", "hw", "code"), ["key", "hw", "code"], "left_anti")
    return rule_findings.withColumn("source", F.lit("rule")).unionByName(rows)


def verdicts(results: DataFrame, findings: DataFrame, minus: DataFrame | None = None, ratio: float = X.PASS_RATIO) -> DataFrame:
    """P23 for (key, hw, required_passed, required_total): status, and points clamped at 0 after reviews took some."""
    crit = findings.filter(F.col("severity") == "critical").select("key", "hw").distinct().withColumn("_c", F.lit(True))
    rows = results.join(crit, ["key", "hw"], "left")
    if minus is not None:
        rows = rows.join(minus.groupBy("key", "hw").agg(F.sum("minus").alias("_m")), ["key", "hw"], "left").withColumn("required_passed", F.col("required_passed") - F.coalesce("_m", F.lit(0))).drop("_m")
    status = X.verdict(F.coalesce("_c", F.lit(False)), F.col("required_passed"), F.col("required_total"), ratio)
    return rows.withColumn("status", status).withColumn("required_passed", F.greatest("required_passed", F.lit(0))).drop("_c")


def review_progress(expected: DataFrame, results: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row of expected, done, broken and left works; broken are unparsable or name unknown codes (see ``foreign_codes``)."""
    known = F.broadcast(catalog.select("code", F.lit(True).alias("_k")))
    codes = results.select("key", "hw", F.explode("codes").alias("code")).join(known, "code", "left").filter("_k is null").select("key", "hw").distinct().withColumn("_bad", F.lit(True))
    rows = results.join(codes, ["key", "hw"], "left").withColumn("broken", F.col("parsed").isNull() | ~F.col("parsed") | F.col("_bad").isNotNull())
    done = rows.filter(~F.col("broken")).select("key", "hw")
    left = expected.select("key", "hw").join(done, ["key", "hw"], "left_anti").agg(F.count("*").alias("left"))
    return expected.agg(F.count("*").alias("expected")).crossJoin(rows.agg(F.count_if(~F.col("broken")).alias("done"), F.count_if("broken").alias("broken"))).crossJoin(left)  # one row each


def foreign_codes(results: DataFrame, catalog: DataFrame, n: int = 3) -> DataFrame:
    """(key, hw, codes): the first ``n`` codes of each review (codes, an array in its order) that the catalog lacks."""
    known = catalog.select("code").distinct().withColumn("_k", F.lit(True))
    rows = results.select("key", "hw", F.posexplode("codes").alias("pos", "code")).join(F.broadcast(known), "code", "left").filter("_k is null")
    return rows.groupBy("key", "hw").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]), 1, n).alias("codes"))


def catalog_coverage(expected: DataFrame, catalog: DataFrame) -> DataFrame:
    """(code, side): expected codes without an article and articles nobody expects."""
    e, c = expected.select("code").distinct(), catalog.select("code").distinct()
    return e.subtract(c).withColumn("side", F.lit("no_article")).unionByName(c.subtract(e).withColumn("side", F.lit("unexpected")))


def portrait_prompt(links: DataFrame, titles: DataFrame, head: str, tail: str, common: str = "Common mistakes") -> DataFrame:
    """P39 for portraits: one row (prompt): the allowed links (hw, url, title) by topic, between ``head`` and ``tail``.

    Topics (hw, title) and links are those of a course's catalog, so one text holds them; the common ones have the title ``common``.
    """
    rows = links.join(F.broadcast(titles.select("hw", F.col("title").alias("_t"))), "hw", "left")
    name = F.when(F.col("hw") == "common", common).otherwise(F.coalesce("_t", "hw"))
    line = F.concat(F.lit("- "), "title", F.lit(" — "), "url")
    block = rows.groupBy("hw", name.alias("_name")).agg(X.ordered_join(F.struct("title", "url"), line).alias("_lines"))
    text = X.ordered_join(F.col("hw"), F.concat(F.lit("### "), "hw", F.lit(" · "), "_name", F.lit("\n"), "_lines"), "\n\n")
    return block.agg(F.concat_ws("\n\n", F.lit(head), text, F.lit(tail)).alias("prompt"))


def topic_prompts(checks: DataFrame, catalog: DataFrame, rubrics: DataFrame, mode: str = "grading", head: str = "", tail: str = "") -> DataFrame:
    """(hw, prompt): task, judged items with their mark, and all allowed codes: the common ones and the topic's own, by code.

    ``checks``: hw, check_id, title, required, kind, in their order by ``ord`` if they have it. ``catalog``: code, title. ``rubrics``: hw,
    title and, if there is one, task. Another mode than ``grading`` leaves items and codes out. ``head`` and ``tail`` stand around it.
    All three are a course's, a few rows for each topic.
    """
    prefix = F.substring_index("code", ".", 1)
    mark = F.when(F.coalesce("required", F.lit(True)), "required").otherwise("optional")
    item = F.concat(F.lit("* `"), "check_id", F.lit("` — "), "title", F.lit(" ("), mark, F.lit(")"))
    order = F.struct("ord", "check_id") if "ord" in checks.columns else F.col("check_id")
    items = checks.filter(F.col("kind") == "llm").groupBy("hw").agg(X.ordered_join(order, item).alias("items"))
    named = catalog.filter(F.col("code").contains(".")).withColumn("hw", prefix).withColumn("line", F.concat(F.lit("* `"), "code", F.lit("` — "), "title"))
    listed = F.collect_list(F.struct("code", "line"))
    own = named.filter("hw <> 'common'").groupBy("hw").agg(listed.alias("own"))
    common = named.filter("hw = 'common'").agg(listed.alias("common"))  # one row
    rows = rubrics.join(items, "hw", "left").join(own, "hw", "left").crossJoin(F.broadcast(common))
    codes = F.array_sort(F.concat("common", F.coalesce("own", F.array().cast(common.schema["common"].dataType))))
    codes = F.array_join(F.transform(codes, lambda c: c["line"]), "\n")
    task = F.nullif(F.trim(X.text(F.col("task"))), F.lit("")) if "task" in rubrics.columns else F.lit(None).cast("string")
    grading = F.lit(mode == "grading")
    part = lambda title, c, when=F.lit(True): F.when(when & (X.text(c) != ""), F.concat(F.lit(f"## {title}\n\n"), c))
    text = F.concat_ws("\n\n", F.nullif(F.lit(head), F.lit("")), F.concat(F.lit("# "), "hw", F.lit(": "), "title"), part("Task", task), part("Items to judge", F.col("items"), grading), part("Allowed codes", codes, grading), F.nullif(F.lit(tail), F.lit("")))
    return rows.select("hw", text.alias("prompt"))
