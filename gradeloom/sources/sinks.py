"""Sinks (survey S10 to S17): reports, tables, documents, manifests, projections, state schemas and review requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import expr as X


def report_documents(students: DataFrame, hw: DataFrame, findings: DataFrame) -> DataFrame:
    """(key, json): one nested document per student, findings in order inside topics, topics as a map."""
    f = findings.withColumn("_r", X.severity_rank(F.col("severity")))
    cols = [c for c in findings.columns if c not in ("key", "hw")]
    per = f.groupBy("key", "hw").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", *cols))), lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias("findings"))
    rest = [c for c in hw.columns if c not in ("key", "hw")]
    topic = F.struct(*rest, F.coalesce("findings", F.array().cast(per.schema["findings"].dataType)).alias("findings"))
    # topics are few for each student; a struct may hold what has no order, so entries are sorted by their name alone
    entries = F.array_sort(F.collect_list(F.struct(F.col("hw"), topic.alias("v"))), lambda a, b: F.when(a["hw"] < b["hw"], -1).when(a["hw"] > b["hw"], 1).otherwise(0))
    topics = hw.join(per, ["key", "hw"], "left").groupBy("key").agg(F.map_from_entries(entries).alias("homeworks"))
    parsed = students.join(topics, "key", "left")
    head = [F.col(c) for c in students.columns]
    return parsed.select("key", F.to_json(F.struct(*head, "homeworks"), {"ignoreNullFields": "false"}).alias("json"))


def write_reports(documents: DataFrame, path: str, buckets: int = 64) -> None:
    """Reports as text lines in ``buckets`` folders by the hash of the key: not one file for each key.

    ``readers.read_reports`` reads them back with ``lines``.
    """
    rows = documents.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    rows.select(F.col("json").alias("value"), "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").text(path)


def write_table(df: DataFrame, path: str, *order: str) -> None:
    """A CSV table with a header; with ``order`` the files, by name, hold ascending ranges of these columns."""
    if order:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("header", True).csv(path)


def render_student(students: DataFrame, digest: DataFrame) -> DataFrame:
    """(doc_id, text): a student's page from head and digest (key, digest)."""
    head = F.concat(F.lit("# "), F.col("fio"), F.lit("\n\nstatus: "), F.col("status"))
    return students.join(digest, "key", "left").select(F.col("key").cast("string").alias("doc_id"), F.concat_ws("\n\n", head, "digest").alias("text"))


def render_diff(flips: DataFrame) -> DataFrame:
    """(doc_id, text): for each student whose topics changed (key, hw, was, now, why) the changes in topic order."""
    line = F.concat(F.lit("- "), "hw", F.lit(": "), "was", F.lit(" → "), "now", F.when(X.text(F.col("why")) != "", F.concat(F.lit(" ("), "why", F.lit(")"))).otherwise(""))
    return flips.groupBy("key").agg(X.ordered_join(F.col("hw"), line).alias("t")).select(F.col("key").cast("string").alias("doc_id"), F.concat(F.lit("# "), F.col("key").cast("string"), F.lit("\n\n"), F.col("t")).alias("text"))


def render_comparison(summary: DataFrame, changes: DataFrame, passes: DataFrame) -> DataFrame:
    """(part, text): the head of a comparison of two builds, from A14's bounded tables: totals, changes, topics."""
    one = lambda name, df: df.select(F.lit(name).alias("part"), F.col("t").alias("text"))
    total = F.concat(F.lit("Students compared: "), "compared", F.lit("\nCertificates: "), "certificates_before", F.lit(" → "), "certificates_after", F.lit(" (gained "), "gained", F.lit(", lost "), "lost", F.lit(")"))
    change = F.concat(F.lit("| "), F.when(F.col("change") >= 0, "+").otherwise(""), "change", F.lit(" | "), "people", F.lit(" |"))
    topic = F.concat(F.lit("| "), "hw", F.lit(" | "), "passed_before", F.lit(" | "), "passed_after", F.lit(" |"))
    listed = lambda df, head, key, line: df.agg(F.concat(F.lit(head), X.ordered_join(F.col(key), line)).alias("t"))
    out = one("1 totals", summary.select(total.alias("t")))
    out = out.unionByName(one("2 changes", listed(changes, "| change | people |\n|---|---|\n", "change", change)))
    return out.unionByName(one("3 topics", listed(passes, "| topic | before | after |\n|---|---|---|\n", "hw", topic)))


def flip_lines(flips: DataFrame) -> DataFrame:
    """(section, hw, fio, key, line): the rows of the verdicts that changed; lost passes first, then gained ones, then the rest.

    As many rows as changes, so they stay rows; ``write_table(…, "section", "hw", "fio", "key")`` puts them in order.
    """
    section = F.when(F.col("was") == "passed", "1 lost").when(F.col("now") == "passed", "2 gained").otherwise("3 other")
    line = F.concat(F.lit("| "), "fio", F.lit(" | "), "hw", F.lit(" | "), "was", F.lit(" | "), "now", F.lit(" | "), "why", F.lit(" |"))
    return flips.select(section.alias("section"), "hw", "fio", "key", line.alias("line"))


def render_errors(errors: DataFrame) -> DataFrame:
    """(doc_id, text): one document for each topic of its typical errors (A03), which are a bounded list."""
    line = F.concat("place", F.lit(". "), "title", F.lit(" — "), "n", F.lit(" of "), "submissions")
    return errors.groupBy("hw").agg(X.ordered_join(F.col("place"), line).alias("t")).select(F.col("hw").alias("doc_id"), F.concat(F.lit("# "), "hw", F.lit("\n\n"), "t").alias("text"))


def manifest(chosen: DataFrame, unmatched: DataFrame, broken: DataFrame) -> DataFrame:
    """(key, submissions map, alternatives, unmatched, broken) of each student."""
    sub = chosen.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("rank") == 1, F.struct("topic", "rel"))))).alias("submissions"), F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.col("rel")))).alias("alternatives"))
    names = lambda df, c: df.groupBy("key").agg(F.array_sort(F.collect_list("rel")).alias(c))
    return sub.join(names(unmatched, "unmatched"), "key", "full_outer").join(names(broken, "broken"), "key", "full_outer")


def project_applications(applications: DataFrame, labels: dict[str, dict[str, str]], order: list[str]) -> DataFrame:
    """The whole projection, never an append: codes as labels, lists joined, line breaks as spaces."""
    out = ["tg_id"]
    for c in order:
        v = F.element_at("answers", F.lit(c))
        if c in labels:
            table = F.create_map(*[F.lit(x) for kv in labels[c].items() for x in kv])
            v = X.labels_of(F.filter(F.split(X.text(v), ";"), lambda x: x != ""), table)
        out.append(F.regexp_replace(X.text(v), r"\s*\n\s*", " ").alias(c))
    return applications.select(*out)


STATE_SCHEMAS = {
    "bindings": "tg_id bigint, student_key string, username string, tg_name string, bound_at timestamp, demo boolean",
    "events": "id bigint, tg_id bigint, kind string, payload string, at timestamp, demo boolean",
    "test_views": "tg_id bigint, student_key string, since timestamp",
    "claims": "id bigint, tg_id bigint, student_key string, username string, tg_name string, expected string, at timestamp, status string",
    "support": "id bigint, tg_id bigint, username string, text string, at timestamp, answered boolean",
    "broadcasts": "id bigint, created_by bigint, audience string, audience_arg string, kind string, body string, status string, sandbox boolean, created_at timestamp, finished_at timestamp",
    "broadcast_targets": "broadcast_id bigint, tg_id bigint, label string, status string, error string, at timestamp",
    "people": "tg_id bigint, username string, tg_name string, fio string, email string, first_seen timestamp, last_seen timestamp",
    "identity_history": "id bigint, tg_id bigint, username string, tg_name string, at timestamp",
    "applications": "tg_id bigint, status string, step string, answers map<string,string>, rev bigint, created_at timestamp, updated_at timestamp, submitted_at timestamp",
    "enrollments": "tg_id bigint, track_id string, at timestamp",
    "repos": "tg_id bigint, url string, owner string, repo string, at timestamp",
    "repo_checks": "url string, exists_ boolean, code int, at timestamp",
    "homeworks": "id bigint, num int, title string, body string, deadline timestamp, materials string, status string, created_by bigint, created_at timestamp, published_at timestamp",
    "homework_tracks": "homework_id bigint, track_id string",
    "deliveries": "homework_id bigint, tg_id bigint, status string, error string, at timestamp",
    "flags": "id bigint, kind string, payload string, at timestamp, seen boolean",
    "sync_outbox": "id bigint, sink string, entity string, key string, rev bigint, tries int, status string, error string, at timestamp",
    "sync_state": "sink string, entity string, key string, remote_id string, synced_rev bigint, at timestamp",
}


def state_schema(name: str) -> T.StructType:
    """S16."""
    return T.StructType.fromDDL(STATE_SCHEMAS[name])


# Additive steps, in order: version, table, column, default for rows that were stored before. Version 1 has every other column.
STEPS: list[tuple[int, str, str, object]] = [(2, "bindings", "demo", False), (2, "events", "demo", False)]


def latest_version(steps: list[tuple[int, str, str, object]] = STEPS) -> int:
    return max((v for v, *_ in steps), default=1)


def evolve_schema(df: DataFrame, name: str, version: int | None = None, steps: list[tuple[int, str, str, object]] = STEPS, schema: T.StructType | None = None) -> DataFrame:
    """A stored table in the shape of ``version`` (the latest, if not given), in the schema's order.

    The steps up to the version are taken one after the other: each adds its column with its default where a row has none. Columns of
    later steps are not there; what the schema has without a step and the table lacks is null. Nothing is ever lost from a row.
    """
    version = latest_version(steps) if version is None else version
    mine = {column: (v, default) for v, table, column, default in steps if table == name}
    fields = [f for f in (schema or state_schema(name)).fields if mine.get(f.name, (1, None))[0] <= version]
    have = set(df.columns)

    def column(f: T.StructField):
        stored = F.col(f.name) if f.name in have else F.lit(None)
        default = mine.get(f.name, (1, None))[1]
        return (stored if default is None else F.coalesce(stored, F.lit(default))).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in fields])


def read_state(spark: SparkSession, path: str, name: str, version: int | None = None, steps: list[tuple[int, str, str, object]] = STEPS, schema: T.StructType | None = None) -> DataFrame:
    """A state table whose files were written under several versions, read at once and brought to one version.

    The newest schema is given to the scan, so a file that lacks a column yields nulls there and no file's schema has to be merged.
    """
    return evolve_schema(spark.read.schema(schema or state_schema(name)).parquet(path), name, version, steps, schema)


def review_requests(texts: DataFrame, prompts: DataFrame, codes: DataFrame) -> DataFrame:
    """(custom_id, json): one request for each submission (key, hw, text, truncated) with its topic's prompt and allowed codes."""
    allowed = codes.groupBy("hw").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rows = texts.join(F.broadcast(prompts), "hw").join(F.broadcast(allowed), "hw", "left")
    cid = F.concat_ws("|", "key", "hw")
    return rows.select(cid.alias("custom_id"), F.to_json(F.struct(cid.alias("custom_id"), "prompt", "text", "truncated", F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))).alias("json"))
