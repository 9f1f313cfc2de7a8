"""Registered queries over events, orders and conversations, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gradeloom.operators import admissions as A
from gradeloom.operators import events as E
from gradeloom.plans import views as V
from gradeloom.plans.views import table, with_sql

GAP = 6 * 3600.0


def _views(s, d):
    """Signups and errors as changes of the viewed key: odd ids view a demo key, even ones a real one."""
    ev = V.events(s, d).filter(F.col("kind").isin("signup", "error"))
    return ev.select("id", "tg_id", "at", F.when(F.col("id") % 2 == 1, F.concat(F.lit("demo-"), "id")).otherwise(F.col("id").cast("string")).alias("student_key"))


def _enrollments(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("tg_id"), F.col("o_orderpriority").alias("track"))


def _tasks(s, d):
    return V.events(s, d).select(F.col("kind").alias("sink"), F.lit("row").alias("entity"), (F.col("tg_id") % 97).alias("key"), F.col("id").alias("rev"), "id")


def _synced(s, d):
    return _tasks(s, d).filter("sink <> 'view'").groupBy("sink", "entity", "key").agg(F.max("rev").alias("synced_rev"))


def _people(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("tg_id"), F.col("c_name").alias("fio"), F.lit("").alias("username"))


def _attempts(s, d):
    return V.events(s, d).filter(F.col("kind") == "click").select("id", "tg_id", (F.col("tg_id") % 40).alias("key"), F.concat(F.lit("user"), (F.col("tg_id") % 80).cast("string")).alias("username"))


def _bound(s, d):
    return _attempts(s, d).groupBy("key").agg(F.min_by("tg_id", "id").alias("tg_id"))


def queries() -> dict:
    return {
        "event_totals": lambda s, d: E.event_totals(V.events(s, d)),
        "top_payloads": lambda s, d: E.top_payloads(V.events(s, d), "click", 10, "$.k"),
        "user_profile": lambda s, d: E.profile(V.events(s, d)),
        "latest_state": lambda s, d: E.latest_state(V.events(s, d), "tg_id", "at", "id").select("tg_id", "id", "kind", "first_seen", "last_seen"),
        "identity_changes": lambda s, d: E.identity_changes(V.events(s, d), "kind"),
        "arrival_number": lambda s, d: E.arrival_number(V.events(s, d)),
        "greedy_spacing": lambda s, d: E.greedy_spacing(V.events(s, d), "tg_id", "at", GAP),
        "view_intervals": lambda s, d: E.view_intervals(_views(s, d)),
        "flag_demo": lambda s, d: E.flag_demo(V.events(s, d), _views(s, d)),
        "swap_cohort": lambda s, d: E.swap_cohort(V.events(s, d), _views(s, d)),
        "pending_targets": lambda s, d: E.pending_targets(_people(s, d).select("tg_id"), V.events(s, d), "tg_id"),
        "status_counts": lambda s, d: E.status_counts(table(s, d, "orders").select("o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus"),
        "recent_events": lambda s, d: E.recent(V.events(s, d).filter(F.col("kind") == "error").select("id", "tg_id"), 50),
        "latest_revision": lambda s, d: E.latest_revision(_tasks(s, d), _synced(s, d)),
        "decide_binding": lambda s, d: E.decide_binding(_attempts(s, d), _bound(s, d), _bound(s, d).select("key", F.concat(F.lit("USER"), F.col("key").cast("string")).alias("username"))),
        "forget_user": lambda s, d: E.forget({"events": V.events(s, d)}, 7)[0]["events"].select("id", "tg_id"),
        "current_binding": lambda s, d: E.lookup(_people(s, d).select(F.col("tg_id").alias("key")), _bound(s, d), "key", "tg_id", -1),
        "review_batch_stats": lambda s, d: E.review_batch_stats(table(s, d, "conversations").select(F.when(F.col("role") == "assistant", "succeeded").otherwise("errored").alias("status"), F.col("text").alias("body"), F.length("text").cast("long").alias("tokens"))),
        "health_counts": lambda s, d: E.health_counts({"students": V.students(s, d), "bindings": _bound(s, d), "events": V.events(s, d)}),
        "track_recipients": lambda s, d: A.track_recipients(_enrollments(s, d).select("track").distinct().filter("track < '3'"), _enrollments(s, d), _people(s, d)),
        "visible_homeworks": lambda s, d: A.visible_homeworks(
            _enrollments(s, d), table(s, d, "nation").select(F.col("n_nationkey").alias("homework"), F.lit(None).alias("x")).drop("x").crossJoin(_enrollments(s, d).select("track").distinct()).filter("homework % 5 = cast(substring(track, 1, 1) as int) - 1"),
            table(s, d, "nation").select(F.col("n_nationkey").alias("homework"), F.col("n_regionkey").alias("num"), F.when(F.col("n_nationkey") % 4 == 0, "draft").otherwise("published").alias("status"))),
        "applications_view": lambda s, d: A.applications_view(table(s, d, "orders").select(F.col("o_custkey").alias("tg_id"), F.col("o_orderkey").alias("app"), F.when(F.col("o_orderstatus") == "O", "submitted").otherwise("draft").alias("status")), _people(s, d).select("tg_id", "fio"), _enrollments(s, d)),
        "track_counts": lambda s, d: A.track_counts(_enrollments(s, d).select("track").distinct(), _enrollments(s, d)),
        "reconcile": lambda s, d: A.reconcile(table(s, d, "orders"), table(s, d, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey"),
    }


_VIEWS = "SELECT id, tg_id, at, CASE WHEN id % 2 = 1 THEN 'demo-' || id ELSE id::VARCHAR END AS student_key FROM ev WHERE kind IN ('signup', 'error')"
_DEMO = """SELECT id, tg_id, at, coalesce(now LIKE 'demo-%', false) AS demo FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY tg_id ORDER BY at, o, id ROWS UNBOUNDED PRECEDING) AS now
  FROM (SELECT id, tg_id, at, NULL AS v, 1 AS o FROM ev UNION ALL SELECT id, tg_id, at, student_key, 0 FROM v)) WHERE o = 1"""
_ATT = "SELECT id, tg_id, tg_id % 40 AS key, 'user' || (tg_id % 80) AS username FROM ev WHERE kind = 'click'"
_BOUND = "SELECT key, arg_min(tg_id, id) AS tg_id FROM att GROUP BY key"
_ENR = "SELECT o_custkey AS tg_id, o_orderpriority AS track FROM orders"
_TASKS = "SELECT kind AS sink, 'row' AS entity, tg_id % 97 AS key, id AS rev, id FROM ev"


def oracle_sql() -> dict[str, str]:
    # "at" is a word of the SQL dialect's own
    return {name: re.sub(r'(?<![\w"])at(?![\w"])', '"at"', sql) for name, sql in _oracle_sql().items()}


def _oracle_sql() -> dict[str, str]:
    return {
        "event_totals": with_sql("ev", "SELECT kind, count(*) AS n FROM ev GROUP BY kind"),
        "top_payloads": with_sql("ev", "SELECT coalesce(json_extract_string(payload, '$.k'), payload) AS code, count(*) AS n FROM ev WHERE kind = 'click' GROUP BY 1 ORDER BY n DESC, code LIMIT 10"),
        "user_profile": with_sql("ev", "SELECT tg_id, kind, count(*) AS n, min(at) AS first, max(at) AS last FROM ev GROUP BY tg_id, kind"),
        "latest_state": with_sql("ev", "SELECT tg_id, id, kind, f AS first_seen, at AS last_seen FROM (SELECT *, min(at) OVER (PARTITION BY tg_id) AS f, row_number() OVER (PARTITION BY tg_id ORDER BY at DESC, id DESC) AS rn FROM ev) WHERE rn = 1"),
        "identity_changes": with_sql("ev", "SELECT id, tg_id, at, was, now FROM (SELECT id, tg_id, at, lag(kind) OVER (PARTITION BY tg_id ORDER BY at, id) AS was, kind AS now FROM ev) WHERE was IS NULL OR was <> now"),
        "arrival_number": with_sql("ev", "SELECT tg_id, at, count(*) OVER (ORDER BY at) AS number FROM (SELECT tg_id, min(at) AS at FROM ev GROUP BY tg_id)"),
        "greedy_spacing": """WITH RECURSIVE e AS (SELECT user_id AS tg_id, ts AS at FROM events), k AS (SELECT tg_id, min(at) AS at FROM e GROUP BY tg_id
            UNION ALL SELECT k.tg_id, (SELECT min(e.at) FROM e WHERE e.tg_id = k.tg_id AND e.at >= k.at + INTERVAL 6 HOUR) FROM k WHERE k.at IS NOT NULL) SELECT tg_id, at FROM k WHERE at IS NOT NULL""",
        "view_intervals": with_sql("ev", "SELECT tg_id, student_key, at AS since, lead(at) OVER (PARTITION BY tg_id ORDER BY at, id) AS until FROM v", v=_VIEWS),
        "flag_demo": with_sql("ev", _DEMO, v=_VIEWS),
        "swap_cohort": with_sql("ev", f"SELECT id, tg_id, CASE WHEN demo THEN 'demo' ELSE 'real' END AS cohort FROM ({_DEMO})", v=_VIEWS),
        "pending_targets": "SELECT c_custkey AS tg_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)",
        "status_counts": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
        "recent_events": with_sql("ev", "SELECT id, tg_id FROM ev WHERE kind = 'error' ORDER BY id DESC LIMIT 50"),
        "latest_revision": with_sql("ev", """SELECT sink, entity, key, max(rev) AS rev, arg_max(id, rev) AS id, count(*) AS n, max(rev) FILTER (sink <> 'view') AS synced_rev,
            CASE WHEN max(rev) <= coalesce(max(rev) FILTER (sink <> 'view'), -1) THEN 'stale' ELSE 'pending' END AS status FROM t GROUP BY sink, entity, key""", t=_TASKS),
        "decide_binding": with_sql("ev", """SELECT att.id, att.tg_id, att.key, CASE WHEN b.tg_id IS NOT NULL AND b.tg_id <> att.tg_id THEN 'taken' WHEN b.key IS NULL OR 'user' || b.key <> att.username THEN 'claim' ELSE 'bind' END AS decision
            FROM att LEFT JOIN b ON b.key = att.key""", att=_ATT, b=_BOUND),
        "forget_user": with_sql("ev", "SELECT id, tg_id FROM ev WHERE tg_id <> 7 OR tg_id IS NULL"),
        "current_binding": with_sql("ev", "SELECT c_custkey AS key, coalesce(b.tg_id, -1) AS tg_id FROM customer LEFT JOIN b ON b.key = c_custkey", att=_ATT, b=_BOUND),
        "review_batch_stats": "SELECT count(*) FILTER (role = 'assistant') AS succeeded, count(*) FILTER (role <> 'assistant') AS errored, 0 AS canceled, 0 AS expired, count(*) FILTER (text IS NOT NULL AND NOT json_valid(text)) AS unparsed, sum(length(text))::BIGINT AS tokens FROM conversations",
        "health_counts": with_sql("ev", "SELECT 'students' AS name, count(*) AS n FROM customer UNION ALL SELECT 'bindings', count(*) FROM b UNION ALL SELECT 'events', count(*) FROM ev", att=_ATT, b=_BOUND),
        "track_recipients": with_sql("", f"WITH e AS ({_ENR}) SELECT DISTINCT tg_id, coalesce(nullif(c_name, ''), tg_id::VARCHAR) AS label FROM e LEFT JOIN customer ON c_custkey = tg_id WHERE track < '3'"),
        "visible_homeworks": f"WITH e AS ({_ENR}) SELECT DISTINCT tg_id, n_nationkey AS homework, n_regionkey AS num FROM e JOIN nation ON n_nationkey % 5 = CAST(substr(track, 1, 1) AS INT) - 1 WHERE n_nationkey % 4 <> 0",
        "applications_view": f"WITH e AS ({_ENR}), t AS (SELECT tg_id, string_agg(DISTINCT track, '; ' ORDER BY track) AS tracks FROM e GROUP BY tg_id) SELECT o_custkey AS tg_id, o_orderkey AS app, 'submitted' AS status, c_name AS fio, coalesce(tracks, '') AS tracks FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN t ON t.tg_id = o_custkey WHERE o_orderstatus = 'O'",
        "track_counts": f"WITH e AS ({_ENR}) SELECT track, count(DISTINCT tg_id) AS n FROM e GROUP BY track",
        "reconcile": "SELECT count(*) FILTER (b IS NULL) AS only_ours, count(*) FILTER (a IS NULL) AS only_theirs, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both FROM (SELECT DISTINCT o_orderkey AS a FROM orders) FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_linestatus = 'F') ON a = b",
    }
