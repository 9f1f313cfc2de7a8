"""Registered queries over mixed views: catalog coverage, review progress, contacts, keys, rubric checks, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import classify as K
from gradeloom.operators import events as E
from gradeloom.operators import linkage as L
from gradeloom.operators import rules as R
from gradeloom.operators import similarity as S
from gradeloom.operators import verdict as V_
from gradeloom.plans import cohort_queries as CQ
from gradeloom.plans import event_queries as EQ
from gradeloom.plans import jobs
from gradeloom.plans import views as V
from gradeloom.plans.views import table, with_sql

# Checks over texts: (check_id, any, all, none, least bullets).
CHECKS = [("any", ["idiot", "the "], [], [], None), ("all", [], ["der ", "die "], [], None), ("none", [], [], ["est ", "una "], None)]


def _articles(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("title"), F.col("p_type").alias("body"))


def _contacts(s, d):
    c = table(s, d, "customer")
    return c.select(
        F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit("User"), F.col("c_custkey").cast("string"))).alias("username"),
        F.when(F.col("c_custkey") % 5 == 0, "none").otherwise("exact").alias("match"), F.when(F.col("c_custkey") % 7 == 0, "no").otherwise("yes").alias("exists"),
    )


def _bindings(s, d):
    return V.events(s, d).select(F.col("tg_id").alias("key")).distinct().withColumn("username", F.concat(F.lit("bot"), F.col("key").cast("string")))


def _facts(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("nb"), F.col("text").alias("src"), F.lit("").alias("md"))


def _checks(s):
    return s.createDataFrame(CHECKS, "check_id string, any_regex array<string>, all_regex array<string>, none_regex array<string>, bullets_min int")


def _results(s, d):
    f = V.findings(s, d).groupBy("key", "hw").agg(F.collect_set("code").alias("codes"))
    return f.filter("hw <> '3'").withColumn("parsed", ~F.array_contains("codes", "Brand#22"))


def _catalog(s, d):
    return V.catalog(s, d).filter("code <> 'Brand#11'")


def _owners(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand")).alias("owner"), F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.regexp_replace(F.initcap("p_name"), " ", ".")).alias("repo"), F.col("p_name").alias("fio"))


def queries() -> dict:
    return {
        "search_articles": lambda s, d: K.search_articles(_articles(s, d), "Gea"),
        "catalog_coverage": lambda s, d: V_.catalog_coverage(V.findings(s, d).select("code").filter("code < 'Brand#3'"), _catalog(s, d)),
        "review_progress": lambda s, d: V_.review_progress(V.hw(s, d).filter("status <> 'missing'"), _results(s, d), _catalog(s, d)),
        "username_index": lambda s, d: L.username_index(_contacts(s, d), CQ.C.active(V.students(s, d))),
        "merge_contacts": lambda s, d: L.merge_contacts(V.students(s, d), _contacts(s, d), _bindings(s, d)),
        "assign_keys": lambda s, d: L.assign_keys(_owners(s, d)).select("ord", "key"),
        "first_added": lambda s, d: S.first_added(V.events(s, d).select(F.col("tg_id").alias("key"), F.col("kind").alias("path"), F.col("at").alias("at"))).withColumnRenamed("added_at", "first_at"),
        "rubric_checks": lambda s, d: R.rubric_checks(_facts(s, d), _checks(s)),
        "usage_totals": lambda s, d: jobs.usage_dashboard(V.events(s, d), EQ._views(s, d), "click")[0],
        "plan_broadcast": lambda s, d: jobs.plan_broadcast(CQ._passed(s, d), CQ._bindings(s, d), V.events(s, d).filter("kind = 'purchase' and at < '2024-01-02'"), "all"),
        "user_kinds": lambda s, d: E.status_counts(V.events(s, d), "tg_id", "kind"),
    }


def oracle_sql() -> dict[str, str]:
    good = "username <> '' AND match <> 'none' AND exists_ <> 'no'"
    contacts = "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'User' || c_custkey END AS username, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'exact' END AS match, CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'yes' END AS exists_ FROM customer"
    owners = "SELECT p_partkey AS ord, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS owner, CASE WHEN p_size % 3 = 0 THEN NULL ELSE replace(p_name, ' ', '.') END AS repo, p_name AS fio FROM part"
    return {
        "search_articles": "SELECT p_partkey AS code, p_name AS title, p_type AS body FROM part WHERE contains(lower(p_name), 'gea') OR contains(lower(p_type), 'gea') ORDER BY title, code LIMIT 30",
        "catalog_coverage": with_sql("findings catalog", """SELECT code, 'no_article' AS side FROM (SELECT DISTINCT code FROM e EXCEPT SELECT code FROM c) UNION ALL SELECT code, 'unexpected' FROM (SELECT code FROM c EXCEPT SELECT code FROM e)""",
                                     e="SELECT DISTINCT code FROM findings WHERE code < 'Brand#3'", c="SELECT code FROM catalog WHERE code <> 'Brand#11'"),
        "review_progress": with_sql("hw findings", """SELECT (SELECT count(*) FROM e) AS expected, count(*) FILTER (NOT broken) AS done, count(*) FILTER (broken) AS broken,
            (SELECT count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.key = e.key AND r.hw = e.hw AND NOT r.broken)) AS "left" FROM r""",
            e="SELECT key, hw FROM hw WHERE status <> 'missing'", r="SELECT key, hw, bool_or(code IN ('Brand#11', 'Brand#22')) AS broken FROM findings WHERE hw <> '3' GROUP BY key, hw"),
        "username_index": with_sql("students", f"SELECT lower(username) AS username, key FROM c WHERE {good} AND key IN (SELECT key FROM students WHERE status = 'ok')", c=contacts),
        "merge_contacts": with_sql("students", f"""SELECT s.key, coalesce('bot' || b.key, c.username, '') AS username, CASE WHEN b.key IS NOT NULL THEN 'bot' WHEN c.key IS NOT NULL THEN 'form' ELSE 'none' END AS source
            FROM students s LEFT JOIN (SELECT DISTINCT user_id AS key FROM events) b ON b.key = s.key LEFT JOIN (SELECT * FROM c WHERE {good}) c ON c.key = s.key""", c=contacts),
        "assign_keys": with_sql("", f"""WITH o AS ({owners}), b AS (SELECT *, lower(coalesce(nullif(owner, ''), nullif(regexp_replace(fio, '\\W+', '_', 'g'), ''), 'unknown')) AS base FROM o),
            n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) - 1 AS i FROM b) SELECT ord, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '__' || regexp_replace(lower(coalesce(nullif(repo, ''), i::VARCHAR)), '\\W+', '-', 'g') ELSE base END AS key FROM n"""),
        "first_added": "SELECT user_id AS key, event_type AS path, min(ts) AS first_at FROM events GROUP BY 1, 2",
        "rubric_checks": """SELECT doc_id AS nb, check_id, CASE check_id WHEN 'any' THEN regexp_matches(text, 'idiot', 'i') OR regexp_matches(text, 'the ', 'i')
            WHEN 'all' THEN regexp_matches(text, 'der ', 'i') AND regexp_matches(text, 'die ', 'i') ELSE NOT (regexp_matches(text, 'est ', 'i') OR regexp_matches(text, 'una ', 'i')) END AS passed
            FROM documents, (VALUES ('any'), ('all'), ('none')) AS v(check_id)""",
        "usage_totals": EQ.oracle_sql()["flag_demo"].replace("SELECT id, tg_id, \"at\", coalesce(now LIKE 'demo-%', false) AS demo FROM", "SELECT kind, count(*) AS n FROM ev WHERE id IN (SELECT id FROM (SELECT id, coalesce(now LIKE 'demo-%', false) AS demo FROM", 1) + " ) WHERE NOT demo) GROUP BY kind",
        "plan_broadcast": with_sql("students", "SELECT user_id AS tg_id FROM (SELECT DISTINCT user_id FROM events) JOIN students ON key = user_id AND status = 'ok' WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts < '2024-01-02')"),
        "user_kinds": "SELECT user_id AS tg_id, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2",
    }
