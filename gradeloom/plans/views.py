"""Analog views (survey section 5.3): the review tables that the registered queries read, in Spark and in SQL.

Each view is derived from the given tables only. ``CTE`` holds the same definitions for the SQL oracle; ``with_sql``
puts the needed ones before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import expr as X


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def students(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("fio"), F.when(F.col("c_acctbal") < 0, "excluded").otherwise("ok").alias("status"))


def topics(spark: SparkSession, sf: str) -> DataFrame:
    """The five topics; topic 4 is not graded."""
    hw = F.substring("o_orderpriority", 1, 1).alias("hw")
    return table(spark, sf, "orders").select(hw).distinct().withColumn("graded", F.col("hw") != "4")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """(key, hw, code, severity): one row for each code of a student's topic, with its worst severity."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("hw"))
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("code"))
    rank = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45), 0).when(F.col("l_returnflag").isin("R", "A"), 1).otherwise(2)
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    worst = rows.groupBy(F.col("o_custkey").alias("key"), "hw", "code").agg(F.min(rank).alias("r"))
    return worst.select("key", "hw", "code", F.element_at(F.array(*map(F.lit, ("critical", "major", "minor"))), F.col("r") + 1).alias("severity"))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """(code, title, kind): odd brand numbers are methodology, even ones hygiene."""
    part = table(spark, sf, "part").groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("title"))
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("int")
    return part.withColumn("kind", F.when(number % 2 == 1, "methodology").otherwise("hygiene"))


def hw(spark: SparkSession, sf: str, before: str | None = None, ratio: float = X.PASS_RATIO) -> DataFrame:
    """(key, hw, required_total, required_passed, status): the verdict of each student's latest order of a topic."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), F.substring("o_orderpriority", 1, 1).alias("hw"), "o_orderdate", "o_orderstatus")
    if before:
        o = o.filter(F.col("o_orderdate") < F.lit(before).cast("timestamp"))
    last = o.groupBy("key", "hw").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m")).select("key", "hw", F.col("m.o_orderkey").alias("o_orderkey"), F.col("m.o_orderstatus").alias("st"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("required_total"), F.count_if(F.col("l_linestatus") == "F").alias("required_passed"),
        F.max((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)).alias("critical"),
    )
    rows = last.join(lines, "o_orderkey", "left")
    status = F.when(F.col("st") == "P", "missing").when(F.col("st") == "F", F.when(F.col("critical"), "failed").otherwise("passed")).otherwise(
        X.verdict(F.coalesce("critical", F.lit(False)), F.col("required_passed"), F.coalesce("required_total", F.lit(0)), ratio)
    )
    return rows.select("key", "hw", F.coalesce("required_total", F.lit(0)).alias("required_total"), F.coalesce("required_passed", F.lit(0)).alias("required_passed"), status.alias("status"))


BUILD_DATE = "1997-01-01"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, hw, idx, body): the lines of the documents, by language."""
    d = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("hw"), F.posexplode(F.split("text", "\n")).alias("idx", "body"))
    return d


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(nb, idx, kind, source, ec): conversation turns as notebook cells."""
    kind = F.when(F.col("role") == "assistant", "code").when(F.col("role") == "user", "markdown").otherwise("raw")
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("nb"), F.col("turn").alias("idx"), kind.alias("kind"), F.col("text").alias("source"), (F.length("text") % 50).alias("ec"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("tg_id"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("at"))


def people(spark: SparkSession, sf: str) -> DataFrame:
    """(key, fio, side): names made of parts; even keys are the roster, odd ones registrations in swapped order."""
    word = lambda n: F.element_at(F.split("p_name", " "), n)
    number = F.regexp_extract("p_brand", r"(\d+)$", 1)
    a, b = F.concat(word(2), number), word(1)
    even = F.col("p_partkey") % 2 == 0
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.when(even, F.concat_ws(" ", a, b)).otherwise(F.concat_ws(" ", b, a)).alias("fio"), F.when(even, "roster").otherwise("registration").alias("side"))


CTE = {
    "students": "SELECT c_custkey AS key, c_name AS fio, CASE WHEN c_acctbal < 0 THEN 'excluded' ELSE 'ok' END AS status FROM customer",
    "topics": "SELECT DISTINCT substr(o_orderpriority, 1, 1) AS hw, substr(o_orderpriority, 1, 1) <> '4' AS graded FROM orders",
    "findings": """SELECT o_custkey AS key, substr(o_orderpriority, 1, 1) AS hw, p_brand AS code,
        CASE min(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 0 WHEN l_returnflag IN ('R', 'A') THEN 1 ELSE 2 END)
          WHEN 0 THEN 'critical' WHEN 1 THEN 'major' ELSE 'minor' END AS severity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "catalog": """SELECT p_brand AS code, min(p_name) AS title,
        CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 2 = 1 THEN 'methodology' ELSE 'hygiene' END AS kind FROM part GROUP BY p_brand""",
    "line_sums": """SELECT l_orderkey AS o_orderkey, count(*) AS required_total, count(*) FILTER (l_linestatus = 'F') AS required_passed,
        bool_or(l_returnflag = 'R' AND l_quantity >= 45) AS critical FROM lineitem GROUP BY 1""",
    "hw": """SELECT key, hw, coalesce(required_total, 0) AS required_total, coalesce(required_passed, 0) AS required_passed,
        CASE st WHEN 'P' THEN 'missing' WHEN 'F' THEN CASE WHEN critical THEN 'failed' ELSE 'passed' END
          ELSE CASE WHEN NOT coalesce(critical, false) AND coalesce(required_passed / nullif(required_total, 0), 1.0) >= 0.7 THEN 'passed' ELSE 'failed' END END AS status
        FROM (SELECT o_custkey AS key, substr(o_orderpriority, 1, 1) AS hw, o_orderkey, o_orderstatus AS st,
                row_number() OVER (PARTITION BY o_custkey, substr(o_orderpriority, 1, 1) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
        LEFT JOIN line_sums USING (o_orderkey) WHERE rn = 1""",
    "lines": """SELECT doc_id, lang AS hw, unnest(range(len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS body FROM documents""",
    "cells": """SELECT conv_id AS nb, turn AS idx, CASE role WHEN 'assistant' THEN 'code' WHEN 'user' THEN 'markdown' ELSE 'raw' END AS kind,
        text AS source, length(text) % 50 AS ec FROM conversations""",
    "ev": "SELECT event_id AS id, user_id AS tg_id, event_type AS kind, props AS payload, ts AS at FROM events",
    "people": """SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN a || ' ' || b ELSE b || ' ' || a END AS fio,
        CASE WHEN p_partkey % 2 = 0 THEN 'roster' ELSE 'registration' END AS side
        FROM (SELECT p_partkey, string_split(p_name, ' ')[2] || regexp_extract(p_brand, '(\\d+)$', 1) AS a, string_split(p_name, ' ')[1] AS b FROM part)""",
}
CTE["hw_before"] = CTE["hw"].replace("AS rn FROM orders)", f"AS rn FROM orders WHERE o_orderdate < TIMESTAMP '{BUILD_DATE}')")
NEEDS = {"hw": ["line_sums"], "hw_before": ["line_sums"]}


def with_sql(names: str, body: str, **more: str) -> str:
    """``body`` after the definitions of the views in ``names`` (by spaces) and then ``more``."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in (*NEEDS.get(n, []), n) if x not in order]
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)}\n{body}" if parts else body
