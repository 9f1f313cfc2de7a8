"""Sources (survey S01 to S09): forms, registrations, notebooks, reports, catalog, rubrics, reviews and registries."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import expr as X

# Folders without submitted work.
SKIP_DIRS = (".git", ".ipynb_checkpoints", ".venv", "venv", "env", "site-packages", "node_modules", "__pycache__", ".idea", ".vscode", "catboost_info")

FINDING = "struct<code:string,severity:string,title:string,detail:string,comment:string,source:string,cells:array<int>,links:array<array<string>>,article:string>"
REPORT_SCHEMA = f"""key string, fio string, repo string, status string, reason string, certificate boolean, passed_hw int, total_hw int,
  homeworks map<string,struct<title:string,status:string,notebook:string,required_passed:int,required_total:int,reviewed_by_model:boolean,
  strengths:string,summary:string,findings:array<{FINDING}>>>, similarity array<map<string,string>>,
  portrait struct<portrait:string,growth:array<struct<topic:string,title:string,why:string,codes:array<string>,links:array<struct<title:string,url:string>>>>,next_steps:string>"""
REVIEW_SCHEMA = "checks array<struct<id:string,passed:boolean,comment:string>>, findings array<struct<code:string,comment:string>>, strengths string, summary string"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; names and values are trimmed, nulls become ''. A file's rows keep their order in ``ord``."""
    df = spark.read.option("header", True).option("multiLine", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    df = df.select(*[F.trim(X.text(F.col(f"`{c}`"))).alias(c.strip().lstrip("﻿")) for c in df.columns])
    return df.withColumn("ord", F.monotonically_increasing_id())


def read_form(spark: SparkSession, path: str, name_col: str, url_col: str, time_col: str = "Timestamp") -> DataFrame:
    """(ord, fio, submitted_at, raw_url, owner, repo, status); missing columns are empty."""
    df = _csv(spark, path)
    get = lambda c: F.col(f"`{c}`") if c in df.columns else F.lit("")
    return df.select("ord", get(name_col).alias("fio"), get(time_col).alias("submitted_at"), get(url_col).alias("raw_url"), X.split_slug(get(url_col)).alias("s")).select("ord", "fio", "submitted_at", "raw_url", "s.*")


def read_registration(spark: SparkSession, path: str, name_col: str, handle_word: str = "Telegram") -> DataFrame:
    """(row, fio, raw_username, username) from the first column whose header holds ``handle_word``; rows count from 2."""
    df = _csv(spark, path)
    handle = next((c for c in df.columns if handle_word in c), None)
    raw = F.col(f"`{handle}`") if handle else F.lit("")
    rows = df.select((F.col("ord") + 2).alias("row"), F.col(f"`{name_col}`").alias("fio"), raw.alias("raw_username"), X.clean_username(raw).alias("username"))
    return rows.filter("fio <> ''")


def notebook_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, text, error) of the notebooks under ``root``, without service folders.

    Names that begin with ``_`` or ``.`` and files without a byte are not listed by file sources; use a manifest there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").load(root)
    return _notebooks(files.select("path", F.col("content").cast("string").alias("text")), root)


def notebook_manifest(spark: SparkSession, manifest: DataFrame, root: str = "") -> DataFrame:
    """The same from a table (path, text), for files that a scan would not list."""
    return _notebooks(manifest.select("path", "text"), root)


def read_paths(paths: DataFrame, col: str = "path", tasks: int | None = None) -> DataFrame:
    """(path, text, error) of the files named in ``paths``, read by the executors from the file system they share.

    Names that begin with ``_`` or ``.`` and files without a byte are read like any other; a file that cannot be read has an error in
    place of its text, a null path too. Paths may have any scheme that Arrow knows; without one they are local to the executors. A task
    holds one file at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                text = error = None
                try:
                    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
                    with fs.open_input_stream(at) as f:
                        text = f.read().decode("utf-8", "replace")
                except Exception as e:  # any file system's own errors; the row says so and the scan goes on
                    error = type(e).__name__ if path is not None else "no path"
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string()), pa.array([error], pa.string())], names=["path", "text", "error"])

    rows = paths.select(F.col(col).cast("string").alias("path"))
    return (rows.repartition(tasks) if tasks else rows).mapInArrow(read, "path string, text string, error string")


def notebooks_at(paths: DataFrame, root: str = "", col: str = "path") -> DataFrame:
    """S03 from a table of paths: (path, rel, error, cells), hidden names and empty files included; unreadable files are error rows."""
    found = read_paths(paths, col)
    good = _notebooks(found.filter("error is null").select("path", "text"), root)
    bad = _notebooks(found.filter("error is not null").select("path", F.lit(None).cast("string").alias("text")), root)
    why = found.filter("error is not null").select("path", F.concat(F.lit("cannot be read: "), "error").alias("_why")).distinct()
    return good.unionByName(bad.join(why, "path").withColumn("error", F.col("_why")).drop("_why"))


def _notebooks(files: DataFrame, root: str) -> DataFrame:
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.replace("file://", "").rstrip("/") + "/", "")
    skip = F.lit(False)
    for d in SKIP_DIRS:
        skip = skip | F.concat(F.lit("/"), rel).contains(f"/{d}/")
    v = F.try_parse_json("text")
    cells = F.coalesce(F.try_variant_get(v, "$.cells", "array<variant>"), F.try_variant_get(v, "$.worksheets[0].cells", "array<variant>"))
    error = F.when(F.length(F.trim(X.text(F.col("text")))) == 0, "empty file").when(v.isNull(), "not valid JSON").when(cells.isNull() | (F.size(cells) == 0), "no cells")
    return files.select("path", rel.alias("rel"), error.alias("error"), cells.alias("cells")).filter(~skip)


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """(path, rel, idx, kind, source, ec, errors, outputs) of readable notebooks; old layouts are read too."""
    v = lambda p, t: F.try_variant_get("cell", p, t)
    lines = lambda p: F.coalesce(F.array_join(v(p, "array<string>"), ""), v(p, "string"))
    rows = notebooks.filter("error is null").select("path", "rel", F.posexplode("cells").alias("idx", "cell"))
    outputs = F.coalesce(v("$.outputs", "array<variant>"), F.array().cast("array<variant>"))
    error = lambda o: F.when(F.try_variant_get(o, "$.output_type", "string").isin("error", "pyerr"), F.concat(X.text(F.try_variant_get(o, "$.ename", "string")), F.lit(": "), F.substring(X.text(F.try_variant_get(o, "$.evalue", "string")), 1, 60)))
    return rows.select(
        "path", "rel", "idx", v("$.cell_type", "string").alias("kind"), X.text(F.coalesce(lines("$.source"), lines("$.input"))).alias("source"),
        F.coalesce(v("$.execution_count", "int"), v("$.prompt_number", "int")).alias("ec"), F.array_compact(F.transform(outputs, error)).alias("errors"), outputs.alias("outputs"),
    )


def render_outputs(cells: DataFrame, limit: int = 700) -> DataFrame:
    """P20: (path, idx, text): images as a tag, tracebacks whole without colours, other text clipped."""
    get = lambda o, p, t="string": F.try_variant_get(o, p, t)
    joined = lambda o, p: F.coalesce(F.array_join(get(o, p, "array<string>"), ""), get(o, p))

    def one(o):
        trace = X.without_ansi(F.array_join(get(o, "$.traceback", "array<string>"), "\n"))
        return (
            F.when(get(o, "$.output_type") == "error", F.concat(F.lit("[error] "), X.text(get(o, "$.ename")), F.lit(": "), X.text(get(o, "$.evalue")), F.lit("\n"), trace))
            .when(get(o, "$.output_type") == "stream", X.clip(joined(o, "$.text"), limit))
            .when(get(o, "$.data['image/png']").isNotNull() | get(o, "$.data['image/svg+xml']").isNotNull() | get(o, "$.data['image/jpeg']").isNotNull(), "[plot]")
            .otherwise(X.clip(joined(o, "$.data['text/plain']"), limit))
        )

    return cells.select("path", "idx", F.array_join(F.filter(F.transform("outputs", one), lambda t: t != ""), "\n").alias("text"))


def review_text(cells: DataFrame, rendered: DataFrame, limit: int) -> DataFrame:
    """(path, text, truncated): the whole notebook as one text, cut at ``limit`` characters."""
    rows = cells.join(rendered.withColumnRenamed("text", "out"), ["path", "idx"], "left")
    head = F.concat(F.lit("### ["), F.col("idx"), F.lit("] "), F.col("kind"))
    part = F.concat_ws("\n", head, F.rtrim("source"), F.when(X.text(F.col("out")) != "", F.concat(F.lit("--- output ---\n"), "out")))
    whole = rows.filter(F.col("kind").isin("code", "markdown")).groupBy("path").agg(X.ordered_join(F.col("idx"), part, "\n\n").alias("t"))
    return whole.select("path", F.substring("t", 1, limit).alias("text"), (F.length("t") > limit).alias("truncated"))


def read_reports(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(students, hw_results, findings) from one JSON document per student; the key is the file's name.

    ``lines``: the documents are lines, as ``sinks.write_reports`` leaves them, and hold their key.
    """
    if lines:
        raw = spark.read.schema(REPORT_SCHEMA).json(folder)
    else:
        stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
        raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(folder).withColumn("key", stem)
    students = raw.select("key", "fio", "repo", "status", "reason", "certificate", "passed_hw", "total_hw", "portrait")
    hw = raw.select("key", F.explode("homeworks").alias("hw", "h")).select("key", "hw", "h.*")
    findings = hw.select("key", "hw", F.explode("findings").alias("f")).select("key", "hw", "f.*")
    return students, hw.drop("findings"), findings


CATALOG_FIELDS = ("code", "hw", "title", "severity", "detector")
CATALOG_KINDS = ("methodology", "hygiene")


def _refused(rows: DataFrame, problem) -> DataFrame:
    """``rows``, with an error where ``problem`` (a text) is not null; a filter, so that no column pruning removes the check."""
    return rows.filter(F.when(problem.isNotNull(), F.raise_error(problem).cast("boolean")).otherwise(True))


def read_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """(code, hw, title, severity, detector, kind, body, links, path), one row for each file with front matter.

    kind defaults to hygiene for common articles, else methodology. A file without front matter, without one of the fields, with an
    unknown kind or with a code that another file has is an error that names the file. Of a field given twice the last counts.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    text = F.regexp_replace("value", "\r\n?", "\n")
    shape = r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$"
    pairs = F.transform(
        F.filter(F.split(F.regexp_extract(text, shape, 1), "\n"), lambda l: l.contains(":")),
        lambda l: F.struct(F.trim(F.substring_index(l, ":", 1)).alias("k"), F.trim(F.regexp_replace(l, "^[^:]*:", "")).alias("v")),
    )
    df = raw.select(F.col("_metadata.file_path").alias("path"), text.rlike(shape).alias("front"), pairs.alias("m"), X.squash_ends(F.regexp_extract(text, shape, 2)).alias("body"))
    get = lambda k: F.try_element_at(F.filter("m", lambda p: p["k"] == k), F.lit(-1))["v"]
    df = df.select("path", "front", *[get(k).alias(k) for k in CATALOG_FIELDS], F.nullif(get("kind"), F.lit("")).alias("given"), "body")
    kind = F.coalesce("given", F.when(F.col("hw") == "common", "hygiene").otherwise("methodology"))
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.col(k).isNull(), k) for k in CATALOG_FIELDS])), ", ")
    problem = F.when(~F.col("front"), F.concat("path", F.lit(": no front matter"))).when(lacks != "", F.concat("path", F.lit(": lacks "), lacks))
    problem = problem.when(~kind.isin(*CATALOG_KINDS), F.concat("path", F.lit(": unknown kind "), kind))
    df = _refused(df, problem).select(*CATALOG_FIELDS, kind.alias("kind"), "body", X.extract_links(F.col("body")).alias("links"), "path")
    twice = df.groupBy("code").agg(F.min("path").alias("_a"), F.max("path").alias("_b"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return _refused(df.join(twice, "code", "left"), F.when(F.col("_a").isNotNull(), F.concat(F.lit("code "), "code", F.lit(" is given twice: "), "_a", F.lit(" and "), "_b"))).drop("_a", "_b")


def load_rubrics(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rubrics, checks, signatures) from rows (id, title, check_scope, graded, checks[], signature); defaults filled in.

    kind, template, task, extra_templates[] and leakage_exempt[] are kept if they are there.
    """
    none = F.array().cast("array<string>")
    lists = [F.coalesce(c, none).alias(c) for c in ("leakage_exempt", "extra_templates") if c in rows.columns]
    given = [F.col(c) for c in ("kind", "template", "task") if c in rows.columns]
    rubrics = rows.select(F.col("id").alias("hw"), "title", F.coalesce("check_scope", F.lit("delta")).alias("scope"), F.coalesce("graded", F.lit(True)).alias("graded"), *given, *lists)
    c = rows.select(F.col("id").alias("hw"), F.explode("checks").alias("c"))
    checks = c.select(
        "hw", F.col("c.id").alias("check_id"), F.col("c.title").alias("title"), F.coalesce("c.required", F.lit(True)).alias("required"), F.coalesce("c.kind", F.lit("rule")).alias("kind"),
        *[F.coalesce(F.col(f"c.{k}"), none).alias(k) for k in ("any_regex", "all_regex", "none_regex")], F.col("c.bullets_min").alias("bullets_min"),
    )
    signatures = rows.select(F.col("id").alias("topic"), *[F.coalesce(F.col(f"signature.{k}"), none).alias(k) for k in ("strong", "weak", "filename")])
    return rubrics, checks, signatures


def read_reviews(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): reviews by (key, hw) from files key__hw.json; unreadable ones are reported, never fatal."""
    schema = T.StructType.fromDDL(REVIEW_SCHEMA + ", _corrupt_record string")
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(folder)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    rows = raw.withColumn("key", F.regexp_extract(stem, r"^(.*)__[^_]*$", 1)).withColumn("hw", F.regexp_extract(stem, r"__([^_]*)$", 1))
    broken = F.col("_corrupt_record").isNotNull() | F.col("checks").isNull()
    return rows.filter(~broken).drop("_corrupt_record"), rows.filter(broken).select("key", "hw", X.text(F.col("_corrupt_record")).alias("raw"))


def read_registry(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A CSV registry with the columns named in ``columns``, found by the header wherever they stand.

    Nulls and columns that the file lacks become '' (null where they are no text), a missing file is an empty table; others are left out.
    """
    schema = T.StructType.fromDDL(columns)
    try:
        df = spark.read.option("header", True).option("multiLine", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    have = {c.strip().lstrip("\ufeff"): c for c in df.columns}
    return df.select(*[(df[f"`{have[f.name]}`"] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]).na.fill("")


def read_pairs(spark: SparkSession, path: str, kind: str, hw: str, a: str, b: str, first: str) -> DataFrame:
    """Exact pairs of a similarity table from both sides: (me, hw, other, first). Column names are the caller's."""
    df = spark.read.option("header", True).csv(path).filter(F.col(f"`{kind}`") == "exact")
    one = lambda x, y: df.select(F.col(f"`{x}`").alias("me"), F.col(f"`{hw}`").alias("hw"), F.col(f"`{y}`").alias("other"), F.col(f"`{first}`").alias("first"))
    return one(a, b).unionByName(one(b, a))
