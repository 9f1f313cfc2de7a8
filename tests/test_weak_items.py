"""Catalogs, registries, paths, versions, numbering, spacing and prompts: whole behaviour on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.operators import classify, cohort, events, linkage, numbering, verdict
from gradeloom.plans import jobs
from gradeloom.sources import readers, sinks

# -- S05


def article(folder, name, code="hw1.a", hw="hw1", body="First.\n\n- [Doc](http://x/1)\n", **more):
    fields = {"code": code, "hw": hw, "title": f"Title: of {code}", "severity": "major", "detector": "rule"} | more
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("---\n" + "".join(f"{k}: {v}\n" for k, v in fields.items() if v is not None) + "---\n" + body, encoding="utf-8")


def test_catalog_is_read_by_files(spark, tmp_path):
    article(tmp_path / "hw1", "a.md")
    article(tmp_path / "hw1", "b.md", "hw1.b", kind="hygiene", body="Two\nlines\n---\nand a rule\n")
    article(tmp_path / "common", "c.md", "common.c", "common", body="")
    (tmp_path / "hw1" / "d.md").write_bytes(b"---\r\ncode: hw1.d\r\nhw: hw1\r\ntitle: D\r\nseverity: minor\r\ndetector: llm\r\nkind:\r\n---\r\nText\r\n")
    (tmp_path / "notes.txt").write_text("no article")
    rows = {r["code"]: r for r in readers.read_catalog(spark, str(tmp_path)).collect()}
    assert set(rows) == {"hw1.a", "hw1.b", "common.c", "hw1.d"}
    assert {c: r["kind"] for c, r in rows.items()} == {"hw1.a": "methodology", "hw1.b": "hygiene", "common.c": "hygiene", "hw1.d": "methodology"}
    assert rows["hw1.a"]["title"] == "Title: of hw1.a" and [tuple(x) for x in rows["hw1.a"]["links"]] == [("Doc", "http://x/1")]
    assert rows["hw1.b"]["body"] == "Two\nlines\n---\nand a rule" and rows["hw1.d"]["body"] == "Text" and rows["common.c"]["links"] == []


@pytest.mark.parametrize("fault", ["front", "field", "kind", "twice"])
def test_catalog_errors_name_the_file(spark, tmp_path, fault):
    article(tmp_path, "good.md")
    if fault == "front":
        (tmp_path / "bad.md").write_text("just text")
    else:
        article(tmp_path, "bad.md", "hw1.a" if fault == "twice" else "hw1.x", title=None if fault == "field" else "T", kind="odd" if fault == "kind" else None)
    with pytest.raises(Exception) as e:
        readers.read_catalog(spark, str(tmp_path)).count()  # also where no column is asked for
    assert "bad.md" in str(e.value) and {"front": "front matter", "field": "title", "kind": "odd", "twice": "hw1.a"}[fault] in str(e.value)


# -- S09, S02, S08


def test_registry_is_read_by_header(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿fio,extra, key\n"Ann\nLee",x,k1\nBob,,\n', encoding="utf-8")
    got = readers.read_registry(spark, str(tmp_path / "r.csv"), "key string, fio string, note string, size int").collect()
    assert [tuple(r) for r in got] == [("k1", "Ann\nLee", "", None), ("", "Bob", "", None)]


def test_registration_and_pairs(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Name,Your Telegram,Other\n Ann Lee , https://t.me/AnnLee ,1\n,@x,2\nBob,,3\n", encoding="utf-8")
    got = [tuple(r) for r in readers.read_registration(spark, str(tmp_path / "f.csv"), "Name").select("row", "fio", "username").collect()]
    assert got == [(2, "Ann Lee", "AnnLee"), (4, "Bob", "")]
    (tmp_path / "p.csv").write_text("kind,topic,a,b,who\nexact,h1,x,y,x\nnear,h1,x,z,x\n")
    got = {tuple(r) for r in readers.read_pairs(spark, str(tmp_path / "p.csv"), "kind", "topic", "a", "b", "who").collect()}
    assert got == {("x", "h1", "y", "x"), ("y", "h1", "x", "x")}


# -- S03 by paths


def test_notebooks_at_paths(spark, tmp_path):
    nb = json.dumps({"cells": [{"cell_type": "code", "source": ["x = 1\n", "y"], "execution_count": 1, "outputs": []}]})
    for name, text in {"_h.ipynb": nb, ".dot.ipynb": nb, "empty.ipynb": "", "bad.ipynb": "{", "sub/ok.ipynb": nb, ".git/no.ipynb": nb}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = [(str(tmp_path / n),) for n in ("_h.ipynb", ".dot.ipynb", "empty.ipynb", "bad.ipynb", "sub/ok.ipynb", ".git/no.ipynb", "none.ipynb")]
    found = readers.notebooks_at(spark.createDataFrame(paths, "path string"), str(tmp_path))
    assert {r["rel"]: r["error"] for r in found.collect()} == {
        "_h.ipynb": None, ".dot.ipynb": None, "empty.ipynb": "empty file", "bad.ipynb": "not valid JSON", "sub/ok.ipynb": None, "none.ipynb": "cannot be read: FileNotFoundError",
    }
    assert {r["rel"]: r["source"] for r in readers.notebook_cells(found).collect()} == dict.fromkeys(("_h.ipynb", ".dot.ipynb", "sub/ok.ipynb"), "x = 1\ny")


def test_images_of_cells(spark):
    cells = [("a", [{"output_type": "display_data", "data": {"image/png": "x", "text/plain": "p"}}]), ("b", [{"output_type": "stream", "text": "image/png"}]), ("c", []), ("d", None)]
    df = spark.createDataFrame([(k, json.dumps(o)) for k, o in cells], "k string, o string").withColumn("o", F.try_variant_get(F.parse_json("o"), "$", "array<variant>"))
    assert {r["k"]: r["i"] for r in df.select("k", X.has_image(F.col("o")).alias("i")).collect()} == {"a": True, "b": False, "c": False, "d": False}


# -- S16


def test_state_of_three_versions_is_one_table(spark, tmp_path):
    from pyspark.sql import types as T

    steps = [(2, "bindings", "demo", False), (3, "bindings", "origin", "form"), (3, "events", "origin", "x")]
    schema = T.StructType.fromDDL(sinks.STATE_SCHEMAS["bindings"] + ", origin string")
    path = f"file://{tmp_path}/bindings"
    full = spark.createDataFrame([(1, "k", "u", "n", None, True, "chat")], schema)
    for version, drop in ((1, ("demo", "origin")), (2, ("origin",)), (3, ())):
        full.withColumn("tg_id", F.lit(version).cast("long")).drop(*drop).write.mode("append").parquet(path)
    got = {r["tg_id"]: (r["demo"], r["origin"]) for r in sinks.read_state(spark, path, "bindings", steps=steps, schema=schema).collect()}
    assert got == {1: (False, "form"), 2: (True, "form"), 3: (True, "chat")}
    two = sinks.read_state(spark, path, "bindings", 2, steps, schema)
    assert "origin" not in two.columns and {r["tg_id"]: r["demo"] for r in two.collect()} == {1: False, 2: True, 3: True}
    assert "demo" not in sinks.evolve_schema(full, "bindings", 1).columns and sinks.latest_version() == 2


# -- W05, W06, W08, W09, W07


def test_nothing_is_kept_in_executors(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.col("id").alias("key"), F.sha1(F.col("id").cast("string")).alias("name"))
    got = sorted((r["number"], r["name"]) for r in numbering.numbered(rows, "name", "key").collect())
    assert [n for n, _ in got] == list(range(1, 30_001)) and [x for _, x in got] == sorted(x for _, x in got)
    assert classify.chunk_batches(rows, "g", "key", 50).count() == 30_000 and classify.systematic_sample(rows, "g", "key", 7).count() == 21
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_ranges_cut_where_their_bounds_say(spark):
    rows = spark.createDataFrame([(k, None if i % 9 == 0 else i) for i in range(2_000) for k in ([None, "a"][i % 2],)], "k string, v int")
    got = numbering.in_ranges(rows, "k", "v", ranges=7).groupBy("_part").agg(F.min(F.struct("k", "v")).alias("lo"), F.max(F.struct("k", "v")).alias("hi"), F.count("*").alias("n")).orderBy("_part").collect()
    key = lambda s: (s["k"] is not None, s["k"] or "", s["v"] is not None, s["v"] or 0)
    assert 5 <= len(got) <= 7 and sum(r["n"] for r in got) == 2_000 and max(r["n"] for r in got) < 800
    assert all(key(a["hi"]) < key(b["lo"]) for a, b in zip(got, got[1:]))
    assert numbering.in_ranges(rows.limit(0), "k", ranges=3).count() == 0
    same = spark.range(500).select(F.lit(1).alias("v"), F.col("id").alias("key"))
    assert sorted(r["number"] for r in numbering.numbered(same, "v", "key").collect()) == list(range(1, 501))


def test_keys_of_a_large_nameless_group(spark):
    rows = spark.range(1_000).select(F.col("id").alias("ord"), *(F.lit(None).cast("string").alias(c) for c in ("owner", "repo", "fio")))
    assert {r["key"] for r in linkage.assign_keys(rows).collect()} == {f"unknown__{i}" for i in range(1_000)}


# -- W16


def plain_spacing(rows, gap):
    out, last = [], {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k not in last or t - last[k] >= gap:
            out.append((k, t))
            last[k] = t
    return sorted(out, key=repr)


@pytest.mark.parametrize("gap", [0, 1, 7, 60, 5_000])
def test_spacing_equals_the_plain_fold(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3, 900 + rng.randrange(50)]), rng.randrange(0, 3_000)) for _ in range(4_000)]
    df = spark.createDataFrame(rows, "k int, s long").select("k", F.timestamp_seconds("s").alias("at"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)  # stretches cross batches
    try:
        got = events.greedy_spacing(df, "k", "at", float(gap)).select("k", F.unix_seconds("at").alias("t")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=repr) == plain_spacing(rows, gap)


def test_a_frequent_key_is_spread_and_few_entries_are_kept(spark):
    import numpy as np

    from gradeloom.operators import spacing

    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), F.timestamp_seconds("id").alias("at"))
    spread = numbering.in_ranges(rows.withColumn("t", F.unix_micros("at")), "k", "t").filter("k = 7").groupBy("_part").count()
    assert spread.count() > 2
    chunk = spacing.Chunk(50)
    for part in np.array_split(np.sort(np.random.default_rng(1).integers(0, 100_000, 5_000)), 40):
        chunk.add(part)
    assert len(chunk.upto) < 10  # chains that start within a gap of each other soon meet
    assert events.greedy_spacing(rows.limit(0), "k", "at", 5.0).count() == 0


# -- J05, P34, K07, A26, P39


def test_reasons_name_points_and_criticals(spark):
    rows = [(1, 3, ["a", "b", "c"]), (2, 2, []), (0, 0, ["x"]), (0, 0, [])]
    df = spark.createDataFrame(rows, "p int, t int, c array<string>")
    assert [r[0] for r in df.select(X.why_failed(F.col("p"), F.col("t"), F.col("c"))).collect()] == ["items 1/3, critical: a; b", "items 2/2", "critical: x", "—"]
    blocked = df.select(X.blockers(F.col("p"), F.col("t"), F.col("c")).alias("b")).collect()
    assert [[tuple(x) for x in r["b"]] for r in blocked] == [[("points", "1/3"), ("critical", "a"), ("critical", "b"), ("critical", "c")], [], [("critical", "x")], []]


def builds(spark):
    hw = "key string, hw string, status string, required_passed int, required_total int"
    students = spark.createDataFrame([("k1", "Ann", "ok"), ("k2", "Bob", "ok"), ("k3", "Cid", "excluded")], "key string, fio string, status string")
    topics = spark.createDataFrame([("1", True), ("2", True)], "hw string, graded boolean")
    before = spark.createDataFrame([("k1", "1", "passed", 2, 2), ("k1", "2", "failed", 0, 2), ("k2", "1", "missing", 0, 2), ("k3", "1", "passed", 1, 1)], hw)
    after = spark.createDataFrame([("k1", "1", "failed", 2, 2), ("k1", "2", "passed", 2, 2), ("k2", "1", "failed", 1, 2), ("k3", "1", "failed", 1, 1)], hw)
    found = spark.createDataFrame([("k1", "1", "c2", "critical", "Second"), ("k1", "1", "c1", "critical", "First"), ("k1", "1", "c0", "major", "No"), ("k2", "1", "c3", "critical", None)], "key string, hw string, code string, severity string, title string")
    return students, topics, before, after, found


def test_comparison_of_builds(spark):
    students, topics, before, after, found = builds(spark)
    out = jobs.compare((students, before), (students, after), topics, found)
    assert {(r["key"], r["hw"]): (r["was"], r["now"], r["why"]) for r in out["flips"].collect()} == {
        ("k1", "1"): ("passed", "failed", "items 2/2, critical: First; Second"), ("k1", "2"): ("failed", "passed", "items 2/2"), ("k2", "1"): ("missing", "failed", "items 1/2, critical: c3"),
    }
    assert [(r["section"], r["line"]) for r in out["lines"].orderBy("section", "hw", "fio").collect()] == [
        ("1 lost", "| Ann | 1 | passed | failed | items 2/2, critical: First; Second |"), ("2 gained", "| Ann | 2 | failed | passed | items 2/2 |"), ("3 other", "| Bob | 1 | missing | failed | items 1/2, critical: c3 |"),
    ]
    head = {r["part"]: r["text"] for r in out["head"].collect()}
    assert head["1 totals"].startswith("Students compared: 2\n") and head["2 changes"].endswith("| +0 | 2 |") and "| 1 | 1 | 0 |" in head["3 topics"]
    assert {r["doc_id"] for r in out["pages"].collect()} == {"k1", "k2"} and out["certificates"].count() == 0
    line = cohort.failed_topics(after, topics, found).filter("key = 'k1'").first()
    assert (line["topics"], line["n"]) == ("1: items 2/2, critical: First; Second", 1)


def test_only_certified_people_are_named_as_unbound(spark):
    passed = spark.createDataFrame([("k1", "Bob", True), ("k2", "Ann", True), ("k3", "Cid", False), ("k4", "Dan", True)], "key string, fio string, certified boolean")
    bound = spark.createDataFrame([("k4", 1)], "key string, tg_id long")
    assert [r["fio"] for r in cohort.unbound_names(passed, bound).collect()] == ["Ann", "Bob"]


def test_grading_prompt(spark):
    checks = spark.createDataFrame([("h1", "b", "Second", True, "llm", 2), ("h1", "a", "First", False, "llm", 1), ("h1", "r", "Rule", True, "rule", 0)], "hw string, check_id string, title string, required boolean, kind string, ord int")
    catalog = spark.createDataFrame([("h1.x", "X"), ("common.c", "C"), ("h2.y", "Y"), ("h1.other", "O")], "code string, title string")
    rubrics = spark.createDataFrame([("h1", "One", "Do it."), ("h2", "Two", " "), ("h3", "Three", None)], "hw string, title string, task string")
    got = {r["hw"]: r["prompt"] for r in verdict.topic_prompts(checks, catalog, rubrics, head="Role", tail="End").collect()}
    assert got["h1"] == "Role\n\n# h1: One\n\n## Task\n\nDo it.\n\n## Items to judge\n\n* `a` — First (optional)\n* `b` — Second (required)\n\n## Allowed codes\n\n* `common.c` — C\n* `h1.other` — O\n* `h1.x` — X\n\nEnd"
    assert got["h3"] == "Role\n\n# h3: Three\n\n## Allowed codes\n\n* `common.c` — C\n\nEnd" and "h2.y" in got["h2"] and "Task" not in got["h2"]
    other = {r["hw"]: r["prompt"] for r in verdict.topic_prompts(checks, catalog, rubrics.drop("task"), "discovery").collect()}
    assert other["h1"] == "# h1: One"


# -- C02, C07, A17, J23, K08, A28


def test_classification_of_a_stream(spark):
    books = spark.createDataFrame([("n1", "k1", "a.ipynb", "a", "the and with"), ("n2", "k1", "hw02/b.ipynb", "b", "nothing"), ("n3", "k2", "c.ipynb", "c", "nothing"), ("n4", "k2", "d.ipynb", "d", "")], "nb string, key string, rel string, name string, text string")
    measures = spark.createDataFrame([(f"n{i}", 1.0, 5, 5, 5, 5) for i in range(1, 5)], "nb string, own_share double, own_cells int, non_empty int, executed int, md_len int")
    signatures = spark.createDataFrame([("hw01", ["the", "and"], ["with"], ["zzz"]), ("hw02", ["qqq"], ["www"], ["yyy"])], "topic string, strong array<string>, weak array<string>, filename array<string>")
    out = jobs.classify_stream(books, measures, signatures, spark.createDataFrame([("n4",)], "nb string"), spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string"))
    assert {r["nb"] for r in out["chosen"].collect()} == {"n1"} and {r["nb"] for r in out["by_folder"].collect()} == {"n2"} and {r["nb"] for r in out["unmatched"].collect()} == {"n3"}
    assert {r["topic"]: r["n"] for r in out["counts"].collect()} == {"hw01": 1, "hw02": 1, "unmatched": 1, "broken": 1, "empty": 1}


def test_contacts_and_hints(spark):
    roster = spark.createDataFrame([(1, "Иванов Пётр"), (2, "Нет Такого")], "key int, fio string")
    regs = spark.createDataFrame([(1, "Петр Иванов", "u1")], "reg int, fio string, username string")
    links, counts = jobs.link_contacts(roster, regs)
    assert links.count() == 2 and {(r["part"], r["value"]): r["n"] for r in counts.collect()}[("usable", "yes")] == 1
    repos = spark.createDataFrame([("a", "ml-course", 0), ("a", "zzz", 1), ("b", "famcs", 0)], "owner string, repo string, ord int")
    out = spark.createDataFrame([("Ann", "a"), ("Bob", "b"), ("Cid", None)], "fio string, owner string")
    assert [tuple(r) for r in linkage.rename_hints(out, repos).collect()] == [("Ann", "a", "ml-course")]
    assert {r["outcome"]: r["n"] for r in cohort.fetch_counts(spark.createDataFrame([("cloned",), ("cloned",), ("failed",)], "outcome string")).collect()} == {"cloned": 2, "failed": 1}


def test_volume_of_texts(spark):
    df = spark.createDataFrame([("x" * 10, False), ("x" * 40, False), (None, None), ("x" * 7, True)], "text string, truncated boolean")
    r = classify.estimate_volume(df, limit=30).first()
    assert (r["works"], r["input_tokens"], r["truncated"], r["digest_median"], r["digest_max"], r["output_tokens"]) == (4, 3 + 10 + 0 + 2, 2, 10, 40, 3_600)
    empty = classify.estimate_volume(df.limit(0)).first()
    assert (empty["works"], empty["cost"], empty["digest_median"]) == (0, 0.0, None)


# -- S06, S13, F03, F11


def test_rubrics_get_their_defaults(spark):
    check = "struct<id:string,title:string,required:boolean,kind:string,any_regex:array<string>,all_regex:array<string>,none_regex:array<string>,bullets_min:int>"
    rows = spark.createDataFrame(
        [("h1", "One", None, None, [("a", "A", None, None, ["x"], None, None, None), ("b", "B", False, "llm", None, None, None, 3)], (["s"], None, ["f"])), ("h2", "Two", "full", False, [], None)],
        f"id string, title string, check_scope string, graded boolean, checks array<{check}>, signature struct<strong:array<string>,weak:array<string>,filename:array<string>>",
    )
    rubrics, checks, signatures = readers.load_rubrics(rows)
    assert sorted(map(tuple, rubrics.collect())) == [("h1", "One", "delta", True), ("h2", "Two", "full", False)]
    got = {r["check_id"]: (r["required"], r["kind"], r["any_regex"], r["none_regex"], r["bullets_min"]) for r in checks.collect()}
    assert got == {"a": (True, "rule", ["x"], [], None), "b": (False, "llm", [], [], 3)}
    assert {r["topic"]: (r["strong"], r["weak"], r["filename"]) for r in signatures.collect()} == {"h1": (["s"], [], ["f"]), "h2": ([], [], [])}


def test_manifest_of_students(spark):
    chosen = spark.createDataFrame([("k1", "t1", "a.ipynb", 1), ("k1", "t1", "b.ipynb", 2), ("k1", "t2", "c.ipynb", 1)], "key string, topic string, rel string, rank int")
    out = {r["key"]: r for r in sinks.manifest(chosen, spark.createDataFrame([("k2", "z"), ("k2", "y")], "key string, rel string"), spark.createDataFrame([("k1", "bad")], "key string, rel string")).collect()}
    assert out["k1"]["submissions"] == {"t1": "a.ipynb", "t2": "c.ipynb"} and out["k1"]["alternatives"] == ["b.ipynb"] and out["k1"]["broken"] == ["bad"]
    assert out["k2"]["submissions"] is None and out["k2"]["unmatched"] == ["y", "z"]


def test_blank_cells_and_conclusions_in_comments(spark):
    from gradeloom.operators import rules

    marker = X.CELL_MARKERS[0]
    prose = "# " + "вывод о качестве модели " * 2
    cells = [("n1", 0, "code", f"# {marker}", None, []), ("n1", 1, "code", "x = 1", 1, []), ("n2", 0, "code", prose, None, []), ("n2", 1, "code", "y = 2", 1, []), ("n3", 0, "code", "z = 3", 1, [])]
    facts = rules.notebook_facts(spark.createDataFrame(cells, "nb string, idx int, kind string, source string, ec int, errors array<string>"))
    found = {(r["nb"], r["code"]): (r["severity"], r["cells"]) for r in rules.run_rules(facts).collect()}
    assert found["n1", "common.blank_template_cells"] == ("critical", [0]) and found["n2", "common.conclusions_in_code_comments"] == ("major", [0])
    assert ("n3", "common.blank_template_cells") not in found and ("n1", "common.conclusions_in_code_comments") not in found


def test_all_unbound_people_are_named_by_the_query(spark):
    from gradeloom.plans import registry

    passed = spark.createDataFrame([("k1", "Bob", True), ("k2", "Ann", True), ("k3", "Cid", False), ("k4", "Dan", True)], "key string, fio string, certified boolean")
    bound = spark.createDataFrame([("k4", 1)], "key string, tg_id long")
    assert [r["fio"] for r in cohort.unbound_names(passed, bound, certified=False).collect()] == ["Ann", "Bob", "Cid"]
    run = lambda name: {r["key"] for r in registry.queries()[name](spark, "/root/testdata/sf0.001").collect()}
    sure = {r["key"] for r in registry.queries()["passed_counts"](spark, "/root/testdata/sf0.001").filter("certified").collect()}
    assert run("unbound_names") - sure and run("unbound_certified") <= sure
