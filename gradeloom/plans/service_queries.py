"""Registered queries of accounts, service health, counts, materials and prompts in their whole form, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.operators import admissions as A
from gradeloom.operators import classify as K
from gradeloom.operators import cohort as C
from gradeloom.operators import events as E
from gradeloom.operators import linkage as L
from gradeloom.operators import similarity as S
from gradeloom.operators import verdict as V_
from gradeloom.plans import cohort_queries as CQ
from gradeloom.plans import event_queries as EQ
from gradeloom.plans import extra_queries as XQ
from gradeloom.plans import jobs
from gradeloom.plans import more_queries as MQ
from gradeloom.plans import text_queries as TQ
from gradeloom.plans import views as V
from gradeloom.plans.views import table, with_sql

DATA = (".csv", ".json")


# -- accounts: orders as tickets (answered once finished), urgent ones as claims


def _tickets(s, d):
    return table(s, d, "orders").select(F.col("o_custkey").alias("tg_id"), (F.col("o_orderstatus") == "F").alias("answered"))


def _claims(s, d):
    urgent = table(s, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return urgent.select(F.col("o_custkey").alias("tg_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("approved").alias("status"))


def _broadcasts(s, d):
    return table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "stalled").otherwise("done").alias("status"))


def _revisions(s, d):
    remote = F.when(F.col("kind") != "click", F.concat(F.lit("r"), "id"))
    return V.events(s, d).select(F.lit("sheet").alias("sink"), F.lit("row").alias("entity"), F.col("tg_id").alias("key"), F.col("id").alias("rev"), remote.alias("remote_id"), "kind")


# -- findings and the matrix


def _articles(s, d):
    """Articles of most brands, with the links of their parts' sizes; those of brand 11 have none."""
    p = table(s, d, "part").filter("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("code"))
    links = F.array_sort(F.collect_set(F.concat(F.lit("http://x/"), F.col("p_size").cast("string"))))
    return p.agg(F.min("p_name").alias("title"), links.alias("links")).join(V.catalog(s, d).select("code", "kind"), "code")


def enriched(s, d):
    own = V.findings(s, d).withColumn("title", F.when(F.col("severity") == "minor", F.concat(F.lit("own "), "hw")))
    return C.enrich_whole(own, _articles(s, d)).withColumn("links", F.array_join("links", ","))


def _pairs(s, d):
    """The first and the last student who ordered on a day with one priority."""
    o = table(s, d, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("hw"), "o_orderdate")
    return o.agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b")).filter("a < b").select("hw", "a", "b")


# -- notebooks


def classified(s, d):
    """Short documents are broken; students are the sources and the customers, who have no document."""
    docs = table(s, d, "documents").select(F.col("doc_id").alias("nb"), F.col("source").alias("key"), "text")
    broken = docs.filter("length(text) < 200").select("nb")
    students = docs.select("key").unionByName(table(s, d, "customer").select(F.col("c_name").alias("key")))
    good = K.accepted(TQ._scores(s, d)).join(broken, "nb", "left_anti")
    return K.classification_counts(good, docs, broken, students)


# -- materials


def _files(s, d):
    p = table(s, d, "part")
    name = F.concat_ws(" ", "p_partkey", "p_name")
    suffix = F.when(F.col("p_size") > 45, ".CSV").otherwise(".pdf")
    return p.select(F.concat(name, suffix).alias("name"), F.concat_ws("|", "p_brand", "p_type").alias("hash"), "p_brand", "p_size")


def routed(s, d):
    """Small parts go to their brand, some to the guests too; suppliers' names are wanted but there are no such files."""
    f = _files(s, d)
    routes = f.filter("p_size < 30").select("name", F.col("p_brand").alias("destination"), F.lit(True).alias("wanted"))
    routes = routes.unionByName(f.filter("p_size between 20 and 29").select("name", F.lit("guests").alias("destination"), F.lit(False).alias("wanted")))
    routes = routes.unionByName(table(s, d, "supplier").select(F.col("s_name").alias("name"), F.lit("lessons").alias("destination"), F.lit(True).alias("wanted")))
    aliases = f.filter("p_size = 40 or p_size = 50").select("name", F.col("p_brand").alias("of"))
    return A.route_materials(f.select("name", "hash"), routes, aliases, f.filter("p_size in (40, 41, 47)").select("name"), DATA)


# -- forms and prompts


def asked(s, d):
    """As missing_answers, but the segment is asked only of people with a positive balance (who have a track)."""
    steps = s.createDataFrame(XQ.STEPS, "step string, ord int, required boolean, least int")
    found = A.missing_answers(XQ._applications(s, d), steps, {"segment": F.element_at("answers", F.lit("tracks")) != ""})
    return found.select("tg_id", F.array_join("missing", ",").alias("missing"))


def prompt(s, d):
    titles = table(s, d, "part").filter("p_type < 'M'").select(F.col("p_type").alias("hw"), F.concat(F.lit("About "), "p_type").alias("title")).distinct()
    return V_.portrait_prompt(A.links_by_topic(XQ._articles(s, d)), titles, "Write a portrait.", "Name no other links.").select(F.sha1(F.col("prompt").cast("binary")).alias("prompt"))


def queries() -> dict:
    return {
        "account_profile": lambda s, d: E.account_profile(V.events(s, d), EQ._bound(s, d), _tickets(s, d), _claims(s, d)),
        "service_health": lambda s, d: E.service_health(V.students(s, d), CQ._passed(s, d), CQ._bindings(s, d), _tickets(s, d), _claims(s, d), _broadcasts(s, d)),
        "synced_state": lambda s, d: E.synced_state(_revisions(s, d).filter("kind <> 'view'").drop("kind"), _revisions(s, d).filter("kind = 'view'")),
        "enriched_findings": enriched,
        "cohort_summary_bound": lambda s, d: C.cohort_summary(V.students(s, d), V.hw(s, d), CQ._passed(s, d), CQ._bindings(s, d)),
        "passed_matrix_similar": lambda s, d: C.passed_matrix(V.hw(s, d), V.students(s, d), CQ.IDS, S.symmetrise(_pairs(s, d))),
        "classification_whole": classified,
        "contact_counts": lambda s, d: L.contact_counts(MQ._contacts(s, d)),
        "routed_materials": routed,
        "asked_answers": asked,
        "portrait_prompt": prompt,
        "usage_payloads": lambda s, d: jobs.usage_dashboard(V.events(s, d), EQ._views(s, d), "click", 10, "$.k")[1],
    }


def oracle_sql() -> dict[str, str]:
    contacts = "SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'User' || c_custkey END AS username, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'exact' END AS match, CASE WHEN c_custkey % 7 = 0 THEN 'no' ELSE 'yes' END AS exists_ FROM customer"
    tickets = "SELECT o_custkey AS tg_id, o_orderstatus = 'F' AS answered FROM orders"
    claims = "SELECT o_custkey AS tg_id, o_orderstatus = 'O' AS pending FROM orders WHERE o_orderpriority = '1-URGENT'"
    files = "SELECT p_partkey || ' ' || p_name || CASE WHEN p_size > 45 THEN '.CSV' ELSE '.pdf' END AS name, p_brand || '|' || p_type AS hash, p_brand, p_size FROM part"
    topic = "CASE WHEN p_brand = 'Brand#1' THEN 'common' ELSE p_type END"
    demo = EQ.oracle_sql()["flag_demo"]
    return {
        "account_profile": f"""WITH e AS (SELECT user_id AS tg_id, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1), t AS ({tickets}), c AS ({claims}),
            b AS (SELECT user_id % 40 AS key, arg_min(user_id, event_id) AS tg_id FROM events WHERE event_type = 'click' GROUP BY 1),
            ids AS (SELECT tg_id FROM e UNION SELECT tg_id FROM t)
            SELECT i.tg_id, (SELECT min(key::VARCHAR) FROM b WHERE b.tg_id = i.tg_id) AS student_key, coalesce(events, 0) AS events, first_at, last_at, coalesce(tickets, 0) AS tickets,
              coalesce(open_tickets, 0) AS open_tickets, coalesce(claims, 0) AS claims, coalesce(pending_claims, 0) AS pending_claims FROM ids i LEFT JOIN e USING (tg_id)
            LEFT JOIN (SELECT tg_id, count(*) AS tickets, count(*) FILTER (NOT answered) AS open_tickets FROM t GROUP BY 1) USING (tg_id)
            LEFT JOIN (SELECT tg_id, count(*) AS claims, count(*) FILTER (pending) AS pending_claims FROM c GROUP BY 1) USING (tg_id)""",
        "service_health": with_sql("students topics hw", """SELECT (SELECT count(*) FROM students) AS students, (SELECT count(*) FROM p) AS active, (SELECT count(*) FROM p WHERE certified) AS certified,
            (SELECT count(DISTINCT user_id) FROM events) AS bindings, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS open_tickets,
            (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O') AS pending_claims, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS stalled""", p=CQ.PASSED),
        "synced_state": """SELECT 'sheet' AS sink, 'row' AS entity, user_id AS key, max(event_id) AS rev, 'r' || max(event_id) FILTER (event_type <> 'click') AS remote_id FROM events GROUP BY user_id""",
        "enriched_findings": with_sql("findings catalog", """SELECT key, hw, f.code, severity, coalesce(a.title, CASE WHEN severity = 'minor' THEN 'own ' || hw END, f.code) AS title, a.kind, coalesce(links, '') AS links, a.code AS article
            FROM findings f LEFT JOIN a ON a.code = f.code""", a="""SELECT p_brand AS code, min(p_name) AS title, any_value(kind) AS kind, string_agg(DISTINCT 'http://x/' || p_size, ',' ORDER BY 'http://x/' || p_size) AS links
            FROM part JOIN catalog ON catalog.code = p_brand WHERE p_brand <> 'Brand#11' GROUP BY p_brand"""),
        "cohort_summary_bound": CQ.oracle_sql()["cohort_summary"].replace("AS in_form,", "AS in_form, (SELECT count(*) FROM p WHERE key IN (SELECT user_id FROM events)) AS bound,", 1),
        "passed_matrix_similar": with_sql("students hw", "SELECT s.key, s.fio, " + ", ".join(f"coalesce(max(h.status) FILTER (h.hw = '{i}'), 'missing') AS t{i}" for i in CQ.IDS)
            + ", coalesce(any_value(n), 0) AS similar FROM students s LEFT JOIN hw h ON h.key = s.key LEFT JOIN m ON m.key = s.key WHERE s.status = 'ok' GROUP BY s.key, s.fio",
            o="SELECT min(o_custkey) AS a, max(o_custkey) AS b FROM orders GROUP BY o_orderpriority, o_orderdate HAVING min(o_custkey) < max(o_custkey)", m="SELECT key, count(*) AS n FROM (SELECT a AS key FROM o UNION ALL SELECT b FROM o) GROUP BY key"),
        "classification_whole": f"""WITH scores AS ({TQ._SCORES}), a AS ({TQ._ACCEPTED}), bad AS (SELECT doc_id FROM documents WHERE length(text) < 200)
            SELECT topic, count(*) AS n FROM a WHERE nb NOT IN (SELECT doc_id FROM bad) GROUP BY topic UNION ALL SELECT 'unmatched', count(*) FROM documents WHERE doc_id NOT IN (SELECT nb FROM a) AND doc_id NOT IN (SELECT doc_id FROM bad)
            UNION ALL SELECT 'broken', count(*) FROM bad UNION ALL SELECT 'empty', count(DISTINCT c_name) FROM customer WHERE c_name NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)""",
        "contact_counts": f"""WITH c AS ({contacts}) SELECT 'match' AS part, match AS value, count(*) AS n FROM c GROUP BY match UNION ALL SELECT 'exists', exists_, count(*) FROM c GROUP BY exists_
            UNION ALL SELECT 'username', CASE WHEN username <> '' THEN 'yes' ELSE 'no' END, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'usable', CASE WHEN username <> '' AND match <> 'none' AND exists_ <> 'no' THEN 'yes' ELSE 'no' END, count(*) FROM c GROUP BY 2""",
        "routed_materials": f"""WITH f AS ({files}), met AS (SELECT name, hash, p_brand AS destination FROM f WHERE p_size < 30 UNION ALL SELECT name, hash, 'guests' FROM f WHERE p_size BETWEEN 20 AND 29)
            SELECT name, destination, CASE WHEN name = min(name) OVER (PARTITION BY destination, hash) THEN 'placed' ELSE 'copy' END AS kind FROM met
            UNION ALL SELECT name, CASE WHEN p_size IN (40, 50) THEN p_brand END, CASE WHEN p_size IN (40, 50) THEN 'alias' WHEN p_size IN (41, 47) THEN 'withheld' WHEN p_size > 45 THEN 'data' ELSE 'extra' END FROM f WHERE p_size >= 30
            UNION ALL SELECT DISTINCT s_name, 'lessons', 'not found' FROM supplier""",
        "asked_answers": """SELECT c_custkey AS tg_id, array_to_string(list_filter([CASE WHEN trim(c_name) = '' THEN 'name' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 0 THEN 'segment' END, CASE WHEN c_acctbal <= 5000 THEN 'tracks' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer""",
        "portrait_prompt": f"""WITH l AS (SELECT {topic} AS hw, 'http://x/' || p_size AS url, min(p_name) AS title FROM part GROUP BY 1, 2), b AS (SELECT hw, '### ' || hw || ' · ' || CASE WHEN hw = 'common' THEN 'Common mistakes' WHEN hw < 'M' THEN 'About ' || hw ELSE hw END
              || chr(10) || string_agg('- ' || title || ' — ' || url, chr(10) ORDER BY title, url) AS t FROM l GROUP BY hw)
            SELECT sha1('Write a portrait.' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY hw) || chr(10) || chr(10) || 'Name no other links.') AS prompt FROM b""",
        "usage_payloads": f"SELECT coalesce(json_extract_string(props, '$.k'), props) AS code, count(*) AS n FROM events WHERE event_type = 'click' AND event_id NOT IN (SELECT id FROM ({demo}) WHERE demo) GROUP BY 1 ORDER BY n DESC, code LIMIT 10",
    }
