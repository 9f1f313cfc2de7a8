"""Registered cohort queries and their SQL."""

from __future__ import annotations

from gradeloom.operators import cohort as C
from gradeloom.plans import views as V
from gradeloom.plans.views import with_sql
from pyspark.sql import functions as F

IDS = ["1", "2", "3", "4", "5"]


def _s(s, d):
    return V.students(s, d)


def _passed(s, d, before=None):
    return C.passed_counts(V.hw(s, d, before), V.students(s, d), V.topics(s, d))


def _bindings(s, d):
    """Accounts as bindings: an event user is bound to the student of the same number."""
    return V.events(s, d).select("tg_id").distinct().withColumn("key", F.col("tg_id"))


ACTIVE = "(SELECT key FROM students WHERE status = 'ok')"
PASSED = f"""SELECT s.key, s.fio, count(*) FILTER (h.status = 'passed' AND t.graded) AS passed, (SELECT count(*) FROM topics WHERE graded) AS total,
  count(*) FILTER (h.status = 'passed' AND t.graded) >= greatest(1, floor(0.66 * (SELECT count(*) FROM topics WHERE graded))) AS certified
  FROM students s LEFT JOIN hw h ON h.key = s.key LEFT JOIN topics t ON t.hw = h.hw WHERE s.status = 'ok' GROUP BY s.key, s.fio"""
STATS = f"""SELECT t.hw, t.graded, count(*) FILTER (h.status <> 'missing') AS submitted, count(*) FILTER (h.status = 'passed') AS passed
  FROM topics t LEFT JOIN (SELECT * FROM hw WHERE key IN {ACTIVE}) h ON h.hw = t.hw GROUP BY t.hw, t.graded"""
COUNTS = f"SELECT hw, code, count(*) AS n FROM findings WHERE key IN {ACTIVE} GROUP BY hw, code"
RANKED = "SELECT *, row_number() OVER (PARTITION BY hw ORDER BY n DESC, code) AS place FROM counts"
WEIGHTS = """SELECT key, kind, code, sum(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END)::BIGINT AS weight, count(*) AS n, min(hw) AS first_hw
  FROM findings JOIN catalog USING (code) GROUP BY key, kind, code"""
BINDINGS = "SELECT DISTINCT user_id AS tg_id, user_id AS key FROM events"


CRITICAL = "SELECT key, hw, list(coalesce(title, code) ORDER BY code)[1:2] AS titles FROM findings LEFT JOIN catalog USING (code) WHERE severity = 'critical' GROUP BY key, hw"
WHY = "coalesce(nullif(concat_ws(', ', CASE WHEN h.required_total > 0 THEN 'items ' || h.required_passed || '/' || h.required_total END, CASE WHEN titles IS NOT NULL THEN 'critical: ' || array_to_string(titles, '; ') END), ''), '—')"


def titled(s, d):
    """Findings with their titles."""
    return V.findings(s, d).join(V.catalog(s, d).select("code", "title"), "code", "left")


def queries() -> dict:
    return {
        "topic_overview": lambda s, d: C.topic_overview(V.hw(s, d), _s(s, d), V.topics(s, d), V.findings(s, d)),
        "topic_stats": lambda s, d: C.topic_stats(V.hw(s, d), _s(s, d), V.topics(s, d)),
        "top_codes": lambda s, d: C.top_codes(C.code_counts(V.findings(s, d), _s(s, d)), 12),
        "typical_errors": lambda s, d: C.typical_errors(V.hw(s, d), _s(s, d), V.findings(s, d), V.catalog(s, d)),
        "passed_counts": lambda s, d: _passed(s, d),
        "passed_distribution": lambda s, d: C.distribution(_passed(s, d)),
        "certificate_distribution": lambda s, d: C.distribution(_passed(s, d), F.col("certified")),
        "severity_counts": lambda s, d: C.severity_counts(V.findings(s, d)),
        "median_passed": lambda s, d: C.median_passed(_passed(s, d)),
        "cohort_summary": lambda s, d: C.cohort_summary(_s(s, d), V.hw(s, d), _passed(s, d)),
        "percentile": lambda s, d: C.percentile(_passed(s, d)),
        "number_certified": lambda s, d: C.number_certified(_passed(s, d)),
        "passed_matrix": lambda s, d: C.passed_matrix(V.hw(s, d), _s(s, d), IDS),
        "enrich_findings": lambda s, d: C.enrich_findings(V.findings(s, d), V.catalog(s, d)),
        "plan_weights": lambda s, d: C.plan_weights(V.findings(s, d), V.catalog(s, d)),
        "plan_top": lambda s, d: C.plan_top(C.plan_weights(V.findings(s, d), V.catalog(s, d))),
        "failed_topics": lambda s, d: C.failed_topics(V.hw(s, d), V.topics(s, d), titled(s, d)),
        "sort_findings": lambda s, d: C.sort_findings(V.findings(s, d)),
        "summary_top": lambda s, d: C.summary_top(_passed(s, d), 100),
        "example_students": lambda s, d: C.example_students(_passed(s, d)),
        "student_digest": lambda s, d: C.student_digest(V.hw(s, d), V.findings(s, d), V.catalog(s, d)),
        "audience_nocert": lambda s, d: C.audience(_passed(s, d), _bindings(s, d), "nocert"),
        "binding_coverage": lambda s, d: C.binding_coverage(_passed(s, d), _bindings(s, d)),
        "compare_builds": lambda s, d: C.compare_builds(V.hw(s, d, V.BUILD_DATE), V.hw(s, d), _s(s, d), titled(s, d)),
        "diff_summary": lambda s, d: C.diff_summary(_passed(s, d, V.BUILD_DATE), _passed(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    base, found = "students topics hw", "students findings catalog"
    return {
        "topic_overview": with_sql(base + " findings", "SELECT s.*, b.codes, round_even(s.passed / greatest(s.submitted, 1), 4) AS share FROM stats s LEFT JOIN best b USING (hw)",
                                   stats=STATS, counts=COUNTS, ranked=RANKED, best="SELECT hw, string_agg(code, ',' ORDER BY place) AS codes FROM ranked WHERE place <= 2 GROUP BY hw"),
        "topic_stats": with_sql(base, STATS),
        "top_codes": with_sql(found, "SELECT * FROM ranked WHERE place <= 12", counts=COUNTS, ranked=RANKED),
        "typical_errors": with_sql(base + " findings catalog", "SELECT hw, code, coalesce(title, 'other') AS title, n, submissions, round_even(n / submissions, 3) AS share, place FROM ranked JOIN subs USING (hw) LEFT JOIN catalog USING (code) WHERE place <= 12",
                                   counts=COUNTS, ranked=RANKED, subs=f"SELECT hw, count(*) AS submissions FROM hw WHERE status <> 'missing' AND key IN {ACTIVE} GROUP BY hw"),
        "passed_counts": with_sql(base, PASSED),
        "passed_distribution": with_sql(base, "SELECT passed, count(*) AS people FROM p GROUP BY passed", p=PASSED),
        "certificate_distribution": with_sql(base, "SELECT passed, count(*) AS people FROM p WHERE certified GROUP BY passed", p=PASSED),
        "severity_counts": with_sql("findings", "SELECT key, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor FROM findings GROUP BY key"),
        "median_passed": with_sql(base, "SELECT coalesce(median(passed), 0.0)::DOUBLE AS median_passed FROM p", p=PASSED),
        "cohort_summary": with_sql(base, f"""SELECT (SELECT count(*) FROM students) AS in_form, (SELECT count(*) FROM students WHERE status = 'ok') AS active,
            (SELECT count(*) FROM students WHERE status <> 'ok') AS excluded, (SELECT count(*) FROM hw WHERE status <> 'missing' AND key IN {ACTIVE}) AS submissions,
            (SELECT count(*) FROM hw WHERE status = 'passed' AND key IN {ACTIVE}) AS passed, (SELECT count(*) FROM p WHERE certified) AS certificates,
            (SELECT median(passed)::DOUBLE FROM p) AS median_passed""", p=PASSED),
        "percentile": with_sql(base, "SELECT key, passed, pct AS percentile, CASE WHEN pct >= 90 THEN 'top10' WHEN pct >= 75 THEN 'top25' WHEN pct >= 50 THEN 'upper_half' ELSE 'below' END AS place FROM c",
                               p=PASSED, c="SELECT key, passed, round_even(100 * cume_dist() OVER (ORDER BY passed), 0)::INT AS pct FROM p"),
        "number_certified": with_sql(base, "SELECT row_number() OVER (ORDER BY lower(fio), key) AS number, key, fio, passed, total FROM p WHERE certified", p=PASSED),
        "passed_matrix": with_sql("students hw line_sums".replace(" line_sums", ""), "SELECT s.key, s.fio, " + ", ".join(f"coalesce(max(h.status) FILTER (h.hw = '{i}'), 'missing') AS t{i}" for i in IDS) + " FROM students s LEFT JOIN hw h ON h.key = s.key WHERE s.status = 'ok' GROUP BY s.key, s.fio"),
        "enrich_findings": with_sql("findings catalog", "SELECT key, hw, f.code, severity, coalesce(title, f.code) AS title, kind FROM findings f LEFT JOIN catalog c ON c.code = f.code"),
        "plan_weights": with_sql("findings catalog", WEIGHTS),
        "plan_top": with_sql("findings catalog", "SELECT key, kind, place, code, value, first_hw FROM r WHERE place <= 3", w=WEIGHTS, v="SELECT *, CASE kind WHEN 'methodology' THEN weight ELSE n END AS value FROM w",
                             r="SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY value DESC, code) AS place FROM v"),
        "failed_topics": with_sql("topics hw findings catalog", "SELECT key, string_agg(line, ' | ' ORDER BY line) AS topics, count(*) AS n FROM l GROUP BY key",
                                  crit=CRITICAL, l=f"SELECT h.key, h.hw || ': ' || {WHY} AS line FROM hw h JOIN topics t USING (hw) LEFT JOIN crit c ON c.key = h.key AND c.hw = h.hw WHERE status = 'failed' AND graded"),
        "sort_findings": with_sql("findings", "SELECT *, row_number() OVER (PARTITION BY key, hw ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, code) AS place FROM findings"),
        "summary_top": with_sql(base, "SELECT * FROM p ORDER BY passed DESC, fio, key LIMIT 100", p=PASSED),
        "example_students": with_sql(base, """SELECT coalesce((SELECT key FROM p WHERE certified ORDER BY passed DESC, fio, key LIMIT 1), (SELECT key FROM p ORDER BY passed DESC, fio, key LIMIT 1)) AS with_certificate,
            coalesce((SELECT key FROM p WHERE NOT certified AND passed > 0 ORDER BY passed DESC, fio, key LIMIT 1), (SELECT key FROM p WHERE NOT certified ORDER BY passed DESC, fio, key LIMIT 1), (SELECT key FROM p ORDER BY passed DESC, fio, key LIMIT 1)) AS without""", p=PASSED),
        "student_digest": with_sql("hw findings catalog", "SELECT key, string_agg(t, chr(10) || chr(10) ORDER BY hw) AS digest FROM d GROUP BY key",
                                   f="""SELECT key, hw, string_agg('- ' || code || ' [' || coalesce(kind, '?') || '] ' || severity, chr(10) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, code) AS lines
                                        FROM findings LEFT JOIN catalog USING (code) GROUP BY key, hw""",
                                   d="SELECT h.key, h.hw, '## ' || h.hw || ' ' || status || ' ' || required_passed || '/' || required_total || coalesce(chr(10) || lines, '') AS t FROM hw h LEFT JOIN f ON f.key = h.key AND f.hw = h.hw"),
        "audience_nocert": with_sql(base, "SELECT p.key, b.tg_id, b.tg_id IS NOT NULL AS reachable FROM p LEFT JOIN b ON b.key = p.key WHERE NOT certified", p=PASSED, b=BINDINGS),
        "binding_coverage": with_sql(base, "SELECT count(*) AS active, count(tg_id) AS bound, count(*) FILTER (tg_id IS NULL) AS unbound, count(*) FILTER (tg_id IS NULL AND certified) AS unbound_certified FROM p LEFT JOIN b ON b.key = p.key", p=PASSED, b=BINDINGS),
        "compare_builds": with_sql("students hw hw_before findings catalog", f"SELECT h.key, h.hw, b.status AS was, h.status AS now, {WHY} AS why FROM hw h JOIN hw_before b ON h.key = b.key AND h.hw = b.hw LEFT JOIN crit c ON c.key = h.key AND c.hw = h.hw WHERE h.status <> b.status AND h.key IN {ACTIVE}", crit=CRITICAL),
        "diff_summary": with_sql("students topics hw hw_before", """SELECT count(*) AS compared, count(*) FILTER (q.certified) AS certificates_before, count(*) FILTER (p.certified) AS certificates_after,
            count(*) FILTER (p.certified AND NOT q.certified) AS gained, count(*) FILTER (NOT p.certified AND q.certified) AS lost, count(*) FILTER (p.passed > q.passed) AS more, count(*) FILTER (p.passed < q.passed) AS fewer
            FROM p JOIN q USING (key)""", p=PASSED, q=PASSED.replace("JOIN hw h", "JOIN hw_before h")),
    }
