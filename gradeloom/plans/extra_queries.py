"""Registered queries of review merging, reports, delivery, plans, admissions and registries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.operators import admissions as A
from gradeloom.operators import cohort as C
from gradeloom.operators import events as E
from gradeloom.operators import linkage as L
from gradeloom.operators import similarity as S
from gradeloom.operators import verdict as V_
from gradeloom.plans import cohort_queries as CQ
from gradeloom.plans import more_queries as MQ
from gradeloom.plans import views as V
from gradeloom.plans.views import table, with_sql
from gradeloom.sources import readers, sinks

NOW = "2024-01-20 12:00:00"
STEPS = [("name", 1, True, 1), ("segment", 2, True, 1), ("tracks", 3, True, 2), ("note", 4, False, 1)]


# -- reviews


def _orders_lines(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.substring("o_orderpriority", 1, 1).alias("hw"))
    return table(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def _items(s, d):
    """A review's findings: the type of each part as a bare code, a brand as a whole one, with capitals as they are."""
    code = F.when(F.col("l_linenumber") == 1, F.col("p_brand")).otherwise(F.concat(F.lit(" "), "p_type", F.lit(" ")))
    return _orders_lines(s, d).select("key", "hw", ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("pos"), code.alias("code"), F.col("p_name").alias("comment"))


def _review_catalog(s, d):
    """Brands with a detector; some types are common codes, some a topic's own, some unknown."""
    brands = table(s, d, "part").select(F.col("p_brand").alias("code"), F.lit("critical").alias("severity"), F.when(F.length("p_brand") == 7, "rule").otherwise("llm").alias("detector")).distinct()
    common = table(s, d, "part").filter("p_type < 'M'").select(F.concat(F.lit("common."), "p_type").alias("code"), F.lit("minor").alias("severity"), F.lit("llm").alias("detector")).distinct()
    own = table(s, d, "part").filter("p_type >= 'S'").select(F.concat(F.lit("2."), "p_type").alias("code"), F.lit("critical").alias("severity"), F.lit("rule").alias("detector")).distinct()
    return brands.unionByName(common).unionByName(own).withColumn("title", F.col("code"))


def _judged(s, d):
    checks = s.createDataFrame([(str(k), "task", "The task", k != 5) for k in range(1, 6)], "hw string, check_id string, title string, required boolean")
    reviews = V.hw(s, d).select("key", "hw", F.lit("task").alias("check_id"), (F.col("status") == "passed").alias("passed"), F.lit("no").alias("comment"))
    return V_.apply_review_checks(checks, reviews, _review_catalog(s, d))


def _merged(s, d):
    rules = V.findings(s, d).filter("severity <> 'minor'").withColumn("comment", F.lit(""))
    return V_.merge_review_findings(rules, _items(s, d), _review_catalog(s, d), _judged(s, d))


def reviewed_verdicts(s, d):
    """P23 after J07 and J08."""
    results = V.hw(s, d).select("key", "hw", "required_passed", "required_total")
    return V_.verdicts(results, _merged(s, d), _judged(s, d)).select("key", "hw", "required_passed", "required_total", "status")


def grading_prompts(s, d):
    """A prompt for each topic, with a judged item, the task and all allowed codes: common types and the topic's own."""
    checks = s.createDataFrame([(str(k), f"item{n}", f"Item {n}", n == 1, "llm" if k != 3 else "rule") for k in range(1, 6) for n in (2, 1)], "hw string, check_id string, title string, required boolean, kind string")
    rubrics = V.topics(s, d).select("hw", F.concat(F.lit("Topic "), "hw").alias("title"), F.when(F.col("graded"), F.concat(F.lit("Solve "), "hw")).alias("task"))
    return V_.topic_prompts(checks, _review_catalog(s, d), rubrics, head="Review the work.", tail="Answer in JSON.")


def foreign(s, d):
    rows = _items(s, d).groupBy("key", "hw").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("code").alias("code")))), lambda x: x["code"]).alias("codes"))
    return V_.foreign_codes(rows, _review_catalog(s, d)).select("key", "hw", F.array_join("codes", ",").alias("codes"))


# -- reports


def report_round_trip(s, d):
    """Documents written as JSON text and read with the reader's schema."""
    docs = sinks.report_documents(V.students(s, d), V.hw(s, d), V.findings(s, d))
    raw = docs.select(F.from_json("json", readers.REPORT_SCHEMA).alias("r")).select("r.*")
    topics = raw.select("key", F.explode("homeworks").alias("hw", "h"))
    codes = F.array_join(F.transform("h.findings", lambda f: F.concat(f["code"], F.lit(":"), f["severity"])), ",")
    return topics.select(F.col("key").cast("long").alias("key"), "hw", "h.status", F.col("h.required_passed").alias("required_passed"), codes.alias("codes"))


def digest_whole(s, d):
    """Summaries come from the number of a student, comments from the title."""
    hw = V.hw(s, d).withColumn("summary", F.when(F.col("status") == "failed", F.concat(F.lit("see "), "hw"))).withColumn("strengths", F.when(F.col("status") == "passed", "careful"))
    cat = V.catalog(s, d)
    f = V.findings(s, d).join(cat.select("code", "title"), "code").withColumn("comment", F.repeat(F.concat("title", F.lit("; ")), 20))
    topics = V.topics(s, d).withColumn("title", F.concat(F.lit("Topic "), "hw"))
    return C.digest_whole(CQ._passed(s, d), hw, f, cat, topics)


def manifest(s, d):
    """S13 over documents: the longest of each source and language is chosen, empty languages are not met."""
    docs = table(s, d, "documents").select(F.col("source").alias("key"), F.col("lang").alias("topic"), F.col("doc_id").alias("rel"), F.lit(1).alias("rank"))
    chosen = docs.groupBy("key", "topic").agg(F.min("rel").alias("rel")).withColumn("rank", F.lit(1))
    other = docs.join(chosen.select("rel"), "rel", "left_anti").filter("topic = 'fr'").withColumn("rank", F.lit(2)).select("key", "topic", "rel", "rank")
    out = sinks.manifest(chosen.unionByName(other), docs.filter("topic = 'de'"), docs.filter("topic = 'xx'"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("submissions")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("key", pairs.alias("submissions"), text(F.col("alternatives")).alias("alternatives"), text(F.col("unmatched")).alias("unmatched"), F.col("broken").isNull().alias("none_broken"))


# -- delivery


def _results(s, d):
    status = F.when(F.col("kind") == "purchase", "sent").when(F.col("kind") == "error", "blocked").otherwise("retry")
    return V.events(s, d).select(F.lit(1).cast("long").alias("broadcast_id"), "tg_id", "at", "id", status.alias("status"))


def _targets(s, d):
    people = V.events(s, d).filter("kind in ('signup', 'view')").select("tg_id", F.col("kind").alias("label"))
    return E.freeze_targets(people, 1)


def _checks(s, d):
    return V.events(s, d).select(F.concat("kind", F.lit("/"), F.col("tg_id") % 50).alias("url"), "at", F.col("payload").alias("found"))


# -- plans and catalog


def _links(s, d):
    p = table(s, d, "part")
    site = F.when(F.col("p_size") > 40, "http://handbook/").otherwise("http://other/")
    return p.select(F.substring(F.regexp_extract("p_brand", r"(\d+)$", 1), 1, 1).alias("hw"), F.col("p_name").alias("title"), F.concat(site, F.col("p_size")).alias("url"))


def _articles(s, d):
    body = F.concat(F.lit("Text\n- ["), "p_name", F.lit("](http://x/"), "p_size", F.lit(")\n- [inside](#a)\nno [link](http://no)"))
    hw = F.when(F.col("p_brand") == "Brand#1", "common").otherwise(F.col("p_type"))
    return table(s, d, "part").select(hw.alias("hw"), F.col("p_partkey").alias("code"), F.col("p_name").alias("title"), body.alias("body"))


def plan_lines(s, d):
    top = C.plan_top(C.plan_weights(V.findings(s, d), V.catalog(s, d)))
    growth = V.hw(s, d).filter("status = 'passed'").select("key", (F.col("hw").cast("int") - 1).alias("pos"), F.concat(F.lit("grow "), "hw").alias("title"))
    return C.plan_lines(top, growth, 3)


# -- admissions


def _applications(s, d):
    c = table(s, d, "customer")
    tracks = F.when(F.col("c_acctbal") > 5000, "a;b").when(F.col("c_acctbal") > 0, "a").otherwise("")
    return c.select(F.col("c_custkey").alias("tg_id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("tracks"), tracks).alias("answers"))


def missing(s, d):
    steps = s.createDataFrame(STEPS, "step string, ord int, required boolean, least int")
    return A.missing_answers(_applications(s, d), steps).select("tg_id", F.array_join("missing", ",").alias("missing"))


def enrolled(s, d):
    from gradeloom.plans.event_queries import _enrollments

    sent = V.events(s, d).filter("kind = 'signup'").select("tg_id", F.col("payload").alias("track"))
    return A.enroll_replace(_enrollments(s, d), sent)


def fields(s, d):
    p = table(s, d, "part")
    name, mail = F.initcap("p_name"), F.concat(F.element_at(F.split("p_name", " "), 1), F.when(F.col("p_size") > 9, "@example.org").otherwise(" at example"))
    return p.select("p_partkey", X.validate_fio(F.regexp_replace(name, " ", F.when(F.col("p_size") > 25, " ").otherwise("_"))).alias("fio"), X.validate_email(mail).alias("email"), X.validate_free(F.repeat("p_name", F.col("p_size")), 300).alias("free"))


def fetch_plan(s, d):
    roster = table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("pushed_at"))
    stamps = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("stamp")).filter("stamp < '1998-01-01'")
    stamps = stamps.join(roster.select("key", F.col("pushed_at").alias("p")), "key").select("key", F.when(F.substring("stamp", 6, 2) < F.lit("07"), F.col("p")).otherwise(F.col("stamp")).alias("stamp"))
    return L.plan_fetch(roster, stamps).groupBy("action").agg(F.count("*").alias("n"), F.max("key").alias("last"))


def pairs_both_ways(s, d):
    """U01 over the equal sets of two parts of an order that share a brand and a size."""
    x = table(s, d, "part").groupBy("p_brand", "p_size", "p_type").agg(F.min("p_partkey").alias("a"), F.max("p_partkey").alias("b")).filter("a < b")
    return S.symmetrise(x.select(F.col("p_brand").alias("hw"), "a", "b"))


def queries() -> dict:
    return {
        "merged_findings": lambda s, d: _merged(s, d).select("key", "hw", "code", "severity", "source", "comment"),
        "reviewed_verdicts": reviewed_verdicts,
        "foreign_codes": foreign,
        "grading_prompts": grading_prompts,
        "report_round_trip": report_round_trip,
        "student_digest_whole": digest_whole,
        "notebook_manifest": manifest,
        "delivery_state": lambda s, d: E.delivery_state(_targets(s, d), _results(s, d)).select("tg_id", "label", "status"),
        "fresh_checks": lambda s, d: E.fresh_checks(_checks(s, d), F.lit(NOW).cast("timestamp"), 24).select("url", "found"),
        "expected_username": lambda s, d: L.expected_username(MQ._contacts(s, d), V.students(s, d)),
        "unbound_names": lambda s, d: C.unbound_names(CQ._passed(s, d), CQ._bindings(s, d), certified=False),
        "unbound_certified": lambda s, d: C.unbound_names(CQ._passed(s, d), CQ._bindings(s, d)),
        "topic_passes": lambda s, d: C.topic_passes(V.hw(s, d, V.BUILD_DATE), V.hw(s, d)),
        "passed_changes": lambda s, d: C.changes(CQ._passed(s, d, V.BUILD_DATE), CQ._passed(s, d)),
        "study_chapters": lambda s, d: C.chapters(V.hw(s, d), V.topics(s, d), _links(s, d)),
        "study_plan_lines": plan_lines,
        "links_by_topic": lambda s, d: A.links_by_topic(_articles(s, d)),
        "allowed_urls": lambda s, d: A.allowed_urls(_articles(s, d)),
        "articles_index": lambda s, d: A.articles_index(_articles(s, d)).select("hw", F.sha1(F.array_join("titles", "|").cast("binary")).alias("titles")),
        "missing_answers": missing,
        "enrolled_tracks": enrolled,
        "field_errors": fields,
        "fetch_plan": fetch_plan,
        "pairs_both_ways": pairs_both_ways,
    }


_ROWS = "SELECT o_custkey AS key, substr(o_orderpriority, 1, 1) AS hw, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CASE WHEN l_linenumber = 1 THEN p_brand ELSE p_type END AS code, p_name AS comment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
_REVIEW = {
    "cat": """SELECT DISTINCT p_brand AS code, 'critical' AS severity, CASE WHEN length(p_brand) = 7 THEN 'rule' ELSE 'llm' END AS detector FROM part
        UNION ALL SELECT DISTINCT 'common.' || p_type, 'minor', 'llm' FROM part WHERE p_type < 'M' UNION ALL SELECT DISTINCT '2.' || p_type, 'critical', 'rule' FROM part WHERE p_type >= 'S'""",
    "items": _ROWS,
    "named": """SELECT key, hw, pos, comment, CASE WHEN code IN (SELECT code FROM cat) THEN code WHEN 'common.' || code IN (SELECT code FROM cat) THEN 'common.' || code
        WHEN hw || '.' || code IN (SELECT code FROM cat) THEN hw || '.' || code ELSE hw || '.other' END AS code FROM items""",
    "judged": "SELECT key, hw, hw || '.task' AS code, 'major' AS severity, 'no' AS comment, CASE WHEN hw <> '5' THEN 1 ELSE 0 END AS minus FROM hw WHERE status <> 'passed'",
    "own": """SELECT n.key, n.hw, n.code, CASE WHEN detector = 'rule' AND severity = 'critical' THEN 'major' ELSE coalesce(severity, 'minor') END AS severity,
        CASE WHEN detector = 'rule' AND severity = 'critical' THEN '(reviewer''s opinion, not confirmed by the rule) ' ELSE '' END || comment AS comment
        FROM (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY key, hw, code ORDER BY pos) = 1) n LEFT JOIN cat USING (code)""",
    "ruled": "SELECT key, hw, code, severity FROM findings WHERE severity <> 'minor'",
    "merged": """SELECT key, hw, code, severity, 'rule' AS source, '' AS comment FROM ruled UNION ALL
        SELECT key, hw, code, severity, 'review', comment FROM (SELECT key, hw, code, severity, comment FROM judged UNION ALL SELECT key, hw, code, severity, comment FROM own) x
        WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.key = x.key AND r.hw = x.hw AND r.code = x.code)""",
}


def oracle_sql() -> dict[str, str]:
    good = "username <> '' AND match <> 'none' AND exists_ <> 'no'"
    contacts = "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'User' || c_custkey END AS username, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'exact' END AS match, CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'yes' END AS exists_ FROM customer"
    before = CQ.PASSED.replace("JOIN hw h", "JOIN hw_before h")
    links = """SELECT substr(regexp_extract(p_brand, '(\\d+)$', 1), 1, 1) AS hw, p_name AS title, CASE WHEN p_size > 40 THEN 'http://handbook/' ELSE 'http://other/' END || p_size AS url FROM part"""
    topic = "CASE WHEN p_brand = 'Brand#1' THEN 'common' ELSE p_type END"
    need = "greatest(1, ceil(0.7 * required_total))"
    return {
        "merged_findings": with_sql("findings hw", "SELECT * FROM merged", **_REVIEW),
        "reviewed_verdicts": with_sql("findings hw", """SELECT h.key, h.hw, greatest(required_passed - coalesce(m, 0), 0)::BIGINT AS required_passed, required_total,
            CASE WHEN NOT coalesce(c, false) AND coalesce((required_passed - coalesce(m, 0)) / nullif(required_total, 0), 1.0) >= 0.7 THEN 'passed' ELSE 'failed' END AS status
            FROM hw h LEFT JOIN (SELECT key, hw, sum(minus)::BIGINT AS m FROM judged GROUP BY key, hw) USING (key, hw)
            LEFT JOIN (SELECT DISTINCT key, hw, true AS c FROM merged WHERE severity = 'critical') USING (key, hw)""", **_REVIEW),
        "foreign_codes": with_sql("hw", """SELECT key, hw, array_to_string(list(code ORDER BY pos, code)[1:3], ',') AS codes FROM items WHERE code NOT IN (SELECT code FROM cat) GROUP BY key, hw""", cat=_REVIEW["cat"], items=_ROWS),
        "grading_prompts": with_sql("topics", """SELECT hw, 'Review the work.' || n || '# ' || hw || ': Topic ' || hw || CASE WHEN graded THEN n || '## Task' || n || 'Solve ' || hw ELSE '' END
            || CASE WHEN hw <> '3' THEN n || '## Items to judge' || n || '* `item1` — Item 1 (required)' || chr(10) || '* `item2` — Item 2 (optional)' ELSE '' END
            || coalesce(n || '## Allowed codes' || n || (SELECT string_agg('* `' || code || '` — ' || code, chr(10) ORDER BY code) FROM cat WHERE starts_with(code, 'common.') OR starts_with(code, hw || '.')), '')
            || n || 'Answer in JSON.' AS prompt FROM (SELECT *, chr(10) || chr(10) AS n FROM topics)""", cat=_REVIEW["cat"]),
        "report_round_trip": with_sql("findings hw students", """SELECT h.key, h.hw, h.status, required_passed::INT AS required_passed, coalesce(codes, '') AS codes FROM hw h JOIN students s USING (key)
            LEFT JOIN (SELECT key, hw, string_agg(code || ':' || severity, ',' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, code) AS codes FROM findings GROUP BY key, hw) USING (key, hw)"""),
        "student_digest_whole": with_sql("students topics hw findings catalog", f"""SELECT key, '# Student ' || key || chr(10) || 'Passed: ' || passed || ' of ' || total || '. Certificate: ' || CASE WHEN certified THEN 'yes' ELSE 'no' END || chr(10) || chr(10) || t AS digest
            FROM p JOIN (SELECT key, string_agg(t, chr(10) || chr(10) ORDER BY hw) AS t FROM b GROUP BY key HAVING bool_or(status <> 'missing')) USING (key)""",
            p=CQ.PASSED,
            f="""SELECT f.key, f.hw, string_agg('- ' || code || ' — ' || title || ' [' || severity || ', ' || kind || ']' || CASE WHEN kind = 'methodology' THEN ': ' || substr(repeat(title || '; ', 20), 1, 200) ELSE '' END, chr(10)
                  ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, code) AS lines,
                  list(code || ' — ' || title ORDER BY code) FILTER (severity = 'critical') AS why FROM findings f JOIN catalog USING (code) GROUP BY 1, 2""",
            b=f"""SELECT key, h.hw, status, CASE WHEN status = 'missing' THEN head || chr(10) || 'not submitted' ELSE concat_ws(chr(10), head || ' — ' || status,
                CASE WHEN required_total > 0 THEN 'Items: ' || required_passed || ' of ' || required_total || ' (needed ' || {need}::INT || ')' END,
                CASE WHEN status = 'failed' THEN 'Why failed: ' || array_to_string(list_concat(CASE WHEN required_total > 0 AND required_passed < {need} THEN ['too few points'] ELSE [] END, coalesce(why, [])), '; ') END,
                CASE WHEN status = 'failed' THEN 'Summary: see ' || h.hw END, CASE WHEN status = 'passed' THEN 'Strengths: careful' END, 'Findings:' || chr(10) || lines) END AS t
                FROM (SELECT *, '## ' || hw || ' · Topic ' || hw || CASE WHEN hw = '4' THEN ' (not graded)' ELSE '' END AS head FROM hw) h LEFT JOIN f USING (key, hw)"""),
        "notebook_manifest": """WITH c AS (SELECT source AS key, lang, min(doc_id) AS rel FROM documents GROUP BY 1, 2)
            SELECT key, (SELECT string_agg(lang || '=' || rel, ',' ORDER BY lang) FROM c WHERE c.key IS NOT DISTINCT FROM k.key) AS submissions,
              coalesce((SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM documents WHERE source IS NOT DISTINCT FROM k.key AND lang = 'fr' AND doc_id NOT IN (SELECT rel FROM c)), '') AS alternatives,
              (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM documents WHERE source IS NOT DISTINCT FROM k.key AND lang = 'de') AS unmatched, true AS none_broken FROM (SELECT DISTINCT key FROM c) k""",
        "delivery_state": """SELECT tg_id, label, coalesce(status, 'pending') AS status FROM (SELECT user_id AS tg_id, min(event_type) AS label FROM events WHERE event_type IN ('signup', 'view') GROUP BY 1)
            LEFT JOIN (SELECT user_id AS tg_id, CASE arg_min(event_type, (ts, event_id)) WHEN 'purchase' THEN 'sent' ELSE 'blocked' END AS status FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1) USING (tg_id)""",
        "fresh_checks": f"""SELECT url, props AS found FROM (SELECT event_type || '/' || user_id % 50 AS url, ts, props FROM events)
            QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, props DESC) = 1 AND ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR""",
        "expected_username": with_sql("students", f"SELECT s.key, coalesce(lower(username), '') AS username FROM students s LEFT JOIN (SELECT * FROM c WHERE {good}) c USING (key)", c=contacts),
        "unbound_names": with_sql("students topics hw", "SELECT key, fio FROM p WHERE key NOT IN (SELECT user_id FROM events) ORDER BY fio, key LIMIT 40", p=CQ.PASSED),
        "unbound_certified": with_sql("students topics hw", "SELECT key, fio FROM p WHERE certified AND key NOT IN (SELECT user_id FROM events) ORDER BY fio, key LIMIT 40", p=CQ.PASSED),
        "topic_passes": with_sql("hw hw_before", """SELECT hw, count(*) FILTER (b.status = 'passed') AS passed_before, count(*) FILTER (a.status = 'passed') AS passed_after,
            count(*) FILTER (a.status = 'passed' AND b.status <> 'passed') AS gained, count(*) FILTER (a.status <> 'passed' AND b.status = 'passed') AS lost FROM hw a JOIN hw_before b USING (key, hw) GROUP BY hw"""),
        "passed_changes": with_sql("students topics hw hw_before", "SELECT (p.passed - q.passed)::INT AS change, count(*) AS people FROM p JOIN q USING (key) GROUP BY 1", p=CQ.PASSED, q=before),
        "study_chapters": with_sql("hw topics", """SELECT key, row_number() OVER (PARTITION BY key ORDER BY hw, url)::INT AS place, hw, title, url FROM (SELECT key, title, url, min(h.hw) AS hw FROM hw h JOIN topics t ON t.hw = h.hw AND graded JOIN b ON b.hw = h.hw WHERE status = 'failed' GROUP BY 1, 2, 3)""",
            l=links, b="SELECT hw, title, url FROM l QUALIFY row_number() OVER (PARTITION BY hw ORDER BY NOT contains(url, 'handbook'), title, url) = 1"),
        "study_plan_lines": with_sql("hw findings catalog", """SELECT key, hw::INT AS place, 'grow ' || hw AS title, 'portrait' AS source FROM hw WHERE status = 'passed' AND hw <= '3'
            UNION ALL SELECT key, place, code, 'codes' FROM (SELECT key, code, row_number() OVER (PARTITION BY key ORDER BY sum(CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 2 ELSE 1 END) DESC, code)::INT AS place
              FROM findings JOIN catalog USING (code) WHERE kind = 'methodology' GROUP BY key, code) WHERE place <= 3 AND key NOT IN (SELECT key FROM hw WHERE status = 'passed')"""),
        "links_by_topic": f"SELECT {topic} AS hw, 'http://x/' || p_size AS url, min(p_name) AS title FROM part GROUP BY 1, 2",
        "allowed_urls": "SELECT DISTINCT 'http://x/' || p_size AS url FROM part",
        "articles_index": f"SELECT {topic} AS hw, sha1(string_agg(p_name, '|' ORDER BY p_name)) AS titles FROM part GROUP BY 1",
        "missing_answers": """SELECT c_custkey AS tg_id, array_to_string(list_filter([CASE WHEN trim(c_name) = '' THEN 'name' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN c_acctbal <= 5000 THEN 'tracks' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer""",
        "enrolled_tracks": "SELECT DISTINCT o_custkey AS tg_id, o_orderpriority AS track FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup') UNION SELECT user_id, props FROM events WHERE event_type = 'signup'",
        "field_errors": """SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'not_a_name' END AS fio, CASE WHEN p_size <= 9 THEN 'not_an_email' END AS email, CASE WHEN length(p_name) * p_size > 300 THEN 'too_long' END AS free FROM part""",
        "fetch_plan": """SELECT action, count(*) AS n, max(key) AS last FROM (SELECT o_orderkey AS key, CASE WHEN s IS NOT NULL AND (strftime(s, '%m') < '07' OR strftime(s, '%Y-%m-%d') = strftime(o_orderdate, '%Y-%m-%d')) THEN 'cached' ELSE 'fetch' END AS action
            FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS s FROM lineitem GROUP BY 1 HAVING min(l_shipdate) < TIMESTAMP '1998-01-01') ON l_orderkey = o_orderkey) GROUP BY action""",
        "pairs_both_ways": """WITH x AS (SELECT p_brand AS hw, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY p_brand, p_size, p_type HAVING min(p_partkey) < max(p_partkey))
            SELECT hw, a AS me, b AS other FROM x UNION ALL SELECT hw, b, a FROM x""",
    }
