import json

from pyspark.sql import functions as F

from gradeloom.operators import admissions as A
from gradeloom.operators import classify as K
from gradeloom.operators import linkage as L
from gradeloom.operators import similarity as S
from gradeloom.operators import verdict as V
from gradeloom.sources import readers, sinks


def test_near_pairs_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit("t").alias("hw"), F.col("doc_id").alias("key"), F.split(F.lower("text"), " ").alias("shingles"))
    rows = {r["key"]: set(r["shingles"]) for r in docs.collect()}
    for t in (0.8, 0.5):
        want = {(a, b) for a in rows for b in rows if a < b and len(rows[a] & rows[b]) / len(rows[a] | rows[b]) >= t}
        found = S.near_pairs(docs, t)
        assert {(r["a"], r["b"]) for r in found.collect()} == want
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan


def test_exact_groups_stay_linear(spark):
    works = spark.createDataFrame([("t", i, "f") for i in range(50)] + [("t", 99, "g")], "hw string, key int, fp string")
    assert S.exact_members(works).count() == 50 and S.exact_pairs(works).count() == 1225


def test_boilerplate_scales_with_the_cohort(spark):
    def held(n, of):
        cells = [("t", s, "same" if s < n else f"own{s}") for s in range(of)]
        return S.stream_boilerplate(spark.createDataFrame(cells, "hw string, key int, body string")).count()

    assert held(5, 50) == 0 and held(20, 50) == 1


def test_linkage_refuses_when_unsure(spark):
    roster = spark.createDataFrame([(1, "Иванов Пётр"), (2, "Лиза Котова"), (3, "Ким"), (4, "Седов Олег"), (5, "Нет Такого"), (6, "Мир Анна")], "key int, fio string")
    regs = spark.createDataFrame([(1, "Петр Ивaнов", "u1"), (2, "Котова Елизавета", "u2"), (3, "Ким Юрий", "u3"), (4, "Седов Олег", "a1"), (5, "Седов Олег", "a2"), (6, "Мир Анна", "s"), (7, "Мир Анна", "s")], "reg int, fio string, username string")
    got = {r["key"]: (r["match"], r["username"]) for r in L.link_people(roster, regs).collect()}
    assert got == {1: ("exact", "u1"), 2: ("diminutive", "u2"), 3: ("surname", "u3"), 4: ("none", ""), 5: ("none", ""), 6: ("exact", "s")}


def test_keys_repos_and_fuzzy_names(spark):
    rows = spark.createDataFrame([(0, "Bob", "r1", "x"), (1, "bob", "r2", "y"), (2, "", None, "Имя Ф"), (3, None, None, None)], "ord int, owner string, repo string, fio string")
    assert [r["key"] for r in L.assign_keys(rows).orderBy("ord").collect()] == ["bob__r1", "bob__r2", "имя_ф", "unknown"]
    three = spark.createDataFrame([(0, "Bob", "My.Repo", ""), (1, "bob", None, ""), (2, "BOB", "", "")], "ord int, owner string, repo string, fio string")
    assert [r["key"] for r in L.assign_keys(three).orderBy("ord").collect()] == ["bob__my-repo", "bob__1", "bob__2"]
    owners = spark.createDataFrame([("a",), ("b",)], "owner string")
    repos = spark.createDataFrame([("a", "notes", 0), ("a", "ml-course", 1), ("b", "zzz", 0)], "owner string, repo string, ord int")
    assert {r["owner"]: r["repo"] for r in L.best_profile_repo(owners, repos).collect()} == {"a": "ml-course", "b": None}
    names = spark.createDataFrame([(1, "Anna Smith"), (2, "Bob Stone")], "key int, fio string")
    found = L.fuzzy_find(spark.createDataFrame([("smith ana",), ("bo",)], "q string"), names).collect()
    assert [(r["key"], r["confident"]) for r in found] == [(1, True)]
    files = spark.createDataFrame([("f1", "Smith Anna", 0), ("f2", "Smith Anna", 1), ("f3", "Anna Smyth", 2), ("f4", "Nobody", 3)], "file string, name string, ord int")
    assert {r["file"]: r["how"] for r in L.match_awards(files, names).collect()} == {"f1": "words", "f2": "duplicate", "f3": "duplicate", "f4": "none"}


def test_submissions_and_folders(spark):
    rows = [("k", "t", False, 0.2, 9, 9, 9, 9, 1.0, "a"), ("k", "t", True, 0.1, 1, 1, 1, 1, 1.0, "b")]
    m = spark.createDataFrame(rows, "key string, topic string, filename_hit boolean, own_share double, own_cells int, non_empty int, executed int, md_len int, score double, rel string")
    assert {r["rel"]: r["rank"] for r in K.pick_submissions(m).collect()} == {"b": 1, "a": 2}
    un = spark.createDataFrame([("k", "hw2/x.ipynb", 1, 1, 1, 1), ("k", "hw02 b/y.ipynb", 5, 1, 1, 1), ("j", "hw1/z.ipynb", 1, 1, 1, 1)], "key string, rel string, own_cells int, non_empty int, executed int, md_len int")
    topics = spark.createDataFrame([("hw01",), ("hw02",)], "topic string")
    chosen = spark.createDataFrame([("j", "hw01")], "key string, topic string")
    assert [r["rel"] for r in K.folder_fallback(un, chosen, topics).collect()] == ["hw02 b/y.ipynb"]


def test_review_merge(spark):
    catalog = spark.createDataFrame([("hw1.a", "A", "major", "llm"), ("hw1.b", "B", "critical", "rule"), ("common.c", "C", "minor", "rule")], "code string, title string, severity string, detector string")
    rules = spark.createDataFrame([("k", "hw1", "common.c", "minor", "")], "key string, hw string, code string, severity string, comment string")
    items = spark.createDataFrame([("k", "hw1", 0, "a", "x"), ("k", "hw1", 1, "hw1.b", "y"), ("k", "hw1", 2, "c", "z"), ("k", "hw1", 3, "??", "first"), ("k", "hw1", 4, "!!", "second")], "key string, hw string, pos int, code string, comment string")
    got = {r["code"]: (r["severity"], r["comment"]) for r in V.merge_review_findings(rules, items, catalog).collect()}
    assert got["hw1.a"] == ("major", "x") and got["hw1.b"] == ("major", V.UNCONFIRMED + "y") and got["hw1.other"] == ("minor", "first") and len(got) == 4
    checks = spark.createDataFrame([("hw1", "a", "item", True)], "hw string, check_id string, title string, required boolean")
    reviews = spark.createDataFrame([("k", "hw1", "a", False, "no"), ("j", "hw1", "a", None, "")], "key string, hw string, check_id string, passed boolean, comment string")
    failed = V.apply_review_checks(checks, reviews, catalog)
    assert [(r["key"], r["severity"], r["minus"]) for r in failed.collect()] == [("k", "major", 1)]
    results = spark.createDataFrame([("k", "hw1", 0, 10), ("j", "hw1", 0, 0)], "key string, hw string, required_passed int, required_total int")
    out = {r["key"]: (r["status"], r["required_passed"]) for r in V.verdicts(results, rules, failed).collect()}
    assert out == {"k": ("failed", 0), "j": ("passed", 0)}


def test_materials_never_disappear(spark):
    files = spark.createDataFrame([("A.pdf", "1"), ("b.pdf", "1"), ("c.txt", "2")], "name string, hash string")
    rules = spark.createDataFrame([("a.pdf", "lessons", 1), ("zz.pdf", "lessons", 1)], "name string, destination string, priority int")
    assert {r["name"]: r["destination"] for r in A.place_materials(files, rules).collect()} == {"A.pdf": "lessons", "b.pdf": "copy of A.pdf", "c.txt": "extra", "zz.pdf": "not found"}


def test_notebooks(spark, tmp_path):
    (tmp_path / "hw01").mkdir()
    (tmp_path / "venv").mkdir()
    nb = {"cells": [{"cell_type": "code", "source": ["a = 1\n", "b"], "execution_count": 3, "outputs": [{"output_type": "error", "ename": "E", "evalue": "boom", "traceback": ["\u001b[31mT"]}]}, {"cell_type": "markdown", "source": "text"}], "nbformat": 4}
    old = {"worksheets": [{"cells": [{"cell_type": "code", "input": "x", "prompt_number": 1}]}], "nbformat": 3}
    for name, body in (("hw01/a.ipynb", json.dumps(nb)), ("hw01/b.ipynb", "{broken"), ("hw01/d.ipynb", json.dumps(old)), ("venv/e.ipynb", json.dumps(nb))):
        (tmp_path / name).write_text(body)
    found = readers.notebook_files(spark, str(tmp_path))
    assert {r["rel"]: r["error"] for r in found.select("rel", "error").collect()} == {"hw01/a.ipynb": None, "hw01/b.ipynb": "not valid JSON", "hw01/d.ipynb": None}
    named = readers.notebook_manifest(spark, spark.createDataFrame([("_h.ipynb", json.dumps(nb)), ("c.ipynb", "")], "path string, text string"))
    assert {r["path"]: r["error"] for r in named.select("path", "error").collect()} == {"_h.ipynb": None, "c.ipynb": "empty file"}
    cells = readers.notebook_cells(found)
    got = {(r["rel"], r["idx"]): (r["kind"], r["source"], r["ec"], r["errors"]) for r in cells.drop("outputs").collect()}
    assert got["hw01/a.ipynb", 0] == ("code", "a = 1\nb", 3, ["E: boom"]) and got["hw01/d.ipynb", 0] == ("code", "x", 1, [])
    text = {r["path"].rsplit("/", 1)[1]: (r["text"], r["truncated"]) for r in readers.review_text(cells, readers.render_outputs(cells), 1000).collect()}
    assert "[error] E: boom\nT" in text["a.ipynb"][0] and not text["a.ipynb"][1]


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "form.csv").write_text("﻿Timestamp , Name,URL\n1, Ann ,https://github.com/a/b\n2,Bob,\n", encoding="utf-8")
    form = readers.read_form(spark, str(tmp_path / "form.csv"), "Name", "URL").orderBy("ord").collect()
    assert [(r["fio"], r["owner"], r["status"], r["submitted_at"]) for r in form] == [("Ann", "a", "ok", "1"), ("Bob", None, "no_url", "2")]
    assert readers.read_registry(spark, str(tmp_path / "none.csv"), "key string, fio string").count() == 0
    students = spark.createDataFrame([("k", "Ann", "ok")], "key string, fio string, status string")
    hw = spark.createDataFrame([("k", "hw1", "passed", 1, 2)], "key string, hw string, status string, required_passed int, required_total int")
    f = spark.createDataFrame([("k", "hw1", "z", "minor"), ("k", "hw1", "a", "critical")], "key string, hw string, code string, severity string")
    doc = json.loads(sinks.report_documents(students, hw, f).first()["json"])
    assert [x["code"] for x in doc["homeworks"]["hw1"]["findings"]] == ["a", "z"]
    sinks.write_reports(sinks.report_documents(students, hw, f), str(tmp_path / "out"), 2)
    back = readers.read_reports(spark, str(tmp_path / "out"), lines=True)
    assert [(r["key"], r["fio"]) for r in back[0].collect()] == [("k", "Ann")]
    assert [(r["hw"], r["status"], r["required_passed"], r["required_total"]) for r in back[1].collect()] == [("hw1", "passed", 1, 2)]
    assert [(r["key"], r["hw"], r["code"], r["severity"]) for r in back[2].collect()] == [("k", "hw1", "a", "critical"), ("k", "hw1", "z", "minor")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/stem.json").write_text(json.dumps(doc | {"portrait": {"portrait": "p", "growth": [{"topic": "hw1", "title": "t", "why": "w", "codes": ["a"], "links": []}], "next_steps": "n"}}))
    one = readers.read_reports(spark, str(tmp_path / "one"))
    assert one[0].first()["key"] == "stem" and one[0].first()["portrait"]["growth"][0]["codes"] == ["a"] and one[2].count() == 2
    sinks.write_table(spark.range(50).repartition(7).withColumn("last", -F.col("id")), str(tmp_path / "table"), "last")
    files = sorted((tmp_path / "table").glob("part-*.csv"))
    assert [int(line.split(",")[0]) for x in files for line in x.read_text().splitlines()[1:]] == list(range(49, -1, -1))
    old = spark.createDataFrame([(1, "k")], "tg_id bigint, student_key string")
    assert sinks.evolve_schema(old, "bindings").first()["demo"] is False
    (tmp_path / "r").mkdir()
    (tmp_path / "r/k__hw1.json").write_text('{"checks": [], "findings": [], "strengths": "", "summary": "s"}')
    (tmp_path / "r/k__hw2.json").write_text("{oops")
    good, bad = readers.read_reviews(spark, str(tmp_path / "r"))
    assert [(r["key"], r["hw"]) for r in good.collect()] == [("k", "hw1")] and [(r["key"], r["hw"]) for r in bad.collect()] == [("k", "hw2")]


def test_links_strengths_and_audiences(spark):
    from gradeloom.operators import cohort as C

    f = spark.createDataFrame([("k", "h1", "c1"), ("k", "h1", "c2")], "key string, hw string, code string")
    own = spark.createDataFrame([("c1", "B", "http://x"), ("c1", "Z", "http://handbook/z")], "code string, title string, url string")
    topic = spark.createDataFrame([("h1", "T", "http://t")], "hw string, title string, url string")
    assert {r["code"]: r["url"] for r in C.best_links(f, own, topic).collect()} == {"c1": "http://handbook/z", "c2": "http://t"}
    hw = spark.createDataFrame([("k", "2", "b"), ("k", "1", "a"), ("k", "3", " ")], "key string, hw string, strengths string")
    assert C.strengths_list(hw).first()["strengths"] == ["a", "b"]
    passed = spark.createDataFrame([("k", 3, True), ("j", 0, False)], "key string, passed int, certified boolean")
    bind = spark.createDataFrame([("k", 1)], "key string, tg_id int")
    C.register_audience("idle", lambda passed, **_: passed.filter("passed = 0"))
    assert [tuple(r) for r in C.targets("idle", passed, bind).collect()] == [("j", None, False)]
    assert C.targets("cert", passed, bind).count() == 1 and K.sample_article(f, 1).count() == 1


def test_topic_scores_keep_case_and_fold_names(spark):
    nb = spark.createDataFrame([(1, "hw/Log-Reg v1.ipynb", "m = KNeighborsClassifier()"), (2, "x.ipynb", "kneighborsclassifier"), (3, "svm/nb.ipynb", None)], "nb int, name string, text string")
    sig = spark.createDataFrame([("t", ["KNeighborsClassifier"], [], ["LOG reg"]), ("u", [], ["m", "zz", "yy"], ["ipynb"]), ("v", [], [], ["svm/nb"])], "topic string, strong array<string>, weak array<string>, filename array<string>")
    got = {(r["nb"], r["topic"]): (r["score"], r["strong_hits"], r["filename_hit"]) for r in K.score_topics(nb, sig).collect()}
    assert got[1, "t"] == (2.6, 1, True) and got[2, "t"] == (0.0, 0, False) and got[1, "u"] == (0.333, 0, False) and got[3, "v"] == (0.6, 0, True)


def test_review_codes_once_and_as_written(spark):
    catalog = spark.createDataFrame([("common.x", "X", "minor", "llm"), ("hw1.x", "Y", "major", "llm"), ("hw1.Caps", "C", "major", "llm"), ("hw1.task", "T", "major", "llm"), ("hw1.r", "R", "major", "rule")], "code string, title string, severity string, detector string")
    rules = spark.createDataFrame([("k", "hw1", "hw1.r", "major", "")], "key string, hw string, code string, severity string, comment string")
    items = spark.createDataFrame([("k", "hw1", 0, " x ", "common first"), ("k", "hw1", 1, "caps", "no such"), ("k", "hw1", 2, "Caps", "as written"), ("k", "hw1", 3, "task", "again"), ("k", "hw1", 4, "r", "again")], "key string, hw string, pos int, code string, comment string")
    judged = spark.createDataFrame([("k", "hw1", "hw1.task", "major", "T", "no", 1), ("k", "hw1", "hw1.r", "major", "R", "no", 1)], "key string, hw string, code string, severity string, title string, comment string, minus int")
    got = sorted((r["code"], r["source"], r["comment"]) for r in V.merge_review_findings(rules, items, catalog, judged).collect())
    assert got == [("common.x", "review", "common first"), ("hw1.Caps", "review", "as written"), ("hw1.other", "review", "no such"), ("hw1.r", "rule", ""), ("hw1.task", "review", "no")]
    seen = spark.createDataFrame([("k", "hw1", ["a", "hw1.x", "b", "c", "d"])], "key string, hw string, codes array<string>")
    assert V.foreign_codes(seen, catalog).first()["codes"] == ["a", "b", "c"]


def test_shared_handles_name_the_people(spark):
    links = spark.createDataFrame([(k, f"P{k}", k, "Same" if k < 25 else f"u{k}", "exact", "") for k in range(30)], "key int, fio string, reg int, username string, match string, note string")
    got = {r["key"]: (r["username"], r["note"]) for r in L.invalidate_shared_usernames(links).collect()}
    assert got[3] == ("", "handle @same given by several people: " + ", ".join(f"P{k}" for k in range(20)) + " and 5 more") and got[27] == ("u27", "")
    regs = spark.createDataFrame([(1, "Иванов Пётр", None), (2, "Иванов Пётр", "u")], "reg int, fio string, username string")
    roster = spark.createDataFrame([(1, "Иванов Пётр")], "key int, fio string")
    assert L.link_people(roster, regs).first()["match"] == "none"


def test_prefix_keys_find_what_confirms(spark):
    from gradeloom.functions import expr as X

    names = ["лиза", "елизавета", "саша", "александр", "алекс", "александра", "ян", "яна", "ива", "иван"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    bad = pairs.filter((X.confirms_given_name(F.col("a"), F.col("b")) != "") & ~F.arrays_overlap(X.given_name_keys(F.col("a"), True), X.given_name_keys(F.col("b"), True)))
    assert bad.count() == 0


def test_delivery_is_frozen_exact_and_terminal(spark):
    from gradeloom.operators import events as E

    then = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d")], "tg_id long, label string")
    targets = E.freeze_targets(then, 9)
    results = spark.createDataFrame([(9, 1, 1, 1, "sent"), (9, 2, 1, 2, "blocked"), (9, 2, 2, 3, "sent"), (9, 3, 1, 4, "retry"), (8, 4, 1, 5, "sent"), (9, 77, 1, 6, "sent")], "broadcast_id long, tg_id long, at int, id long, status string")
    got = {r["tg_id"]: r["status"] for r in E.delivery_state(targets, results).collect()}
    assert got == {1: "sent", 2: "blocked", 3: "pending", 4: "pending"}
    views = spark.createDataFrame([(1, 5, "demo-x", 10), (2, 5, "real", 20)], "id long, tg_id long, student_key string, n int").withColumn("at", F.timestamp_seconds("n")).drop("n")
    asked = spark.createDataFrame([(1, 5, 5), (2, 5, 15), (3, 5, 25)], "id long, tg_id long, n int").withColumn("at", F.timestamp_seconds("n")).drop("n")
    for v in (views, E.view_intervals(views)):
        assert [r["cohort"] for r in E.swap_cohort(asked, v).orderBy("id").collect()] == ["real", "demo", "real"]


def test_audiences_plans_and_paragraphs(spark):
    from gradeloom.functions import expr as X
    from gradeloom.operators import cohort as C

    bind = spark.createDataFrame([(1, "A", True), (2, "", True), (2, "B", False), (3, None, True)], "tg_id long, tg_name string, demo boolean")
    assert sorted(map(tuple, C.demo_audience(bind).collect())) == [(1, "A"), (3, "3")]
    assert [tuple(r) for r in C.own_audience(bind, 7).collect()] == [(7, "you")] and C.own_audience(bind, None).count() == 0
    body = f"# T\n\nfirst\n\n**Note.** no\n\n{X.WHY} because \n\nlast"
    rows = spark.createDataFrame([(body,), ("a\n\n b ",), ("alone",), (None,)], "body string")
    assert [r[0] for r in rows.select(X.why_paragraph(F.col("body"))).collect()] == ["because", "b", "", ""]


def test_rendered_documents(spark):
    flips = spark.createDataFrame([("k", "2", "failed", "passed", ""), ("k", "1", "passed", "failed", "items 1/3")], "key string, hw string, was string, now string, why string")
    assert sinks.render_diff(flips).first()["text"] == "# k\n\n- 1: passed → failed (items 1/3)\n- 2: failed → passed"
    errors = spark.createDataFrame([("1", 2, "B", 1, 9), ("1", 1, "A", 4, 9)], "hw string, place int, title string, n int, submissions int")
    assert sinks.render_errors(errors).first()["text"] == "# 1\n\n1. A — 4 of 9\n2. B — 1 of 9"


def test_indel_equals_plain_recursion():
    import random

    from gradeloom.functions.udf import indel

    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
        return 100.0 if not a and not b else 200.0 * t[-1][-1] / (len(a) + len(b))

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert indel(a, b) == plain(a, b)


def test_fuzzy_join_loses_nothing(spark):
    import random

    from gradeloom.functions.udf import indel

    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["aaaa", "aaaaa", "axbxcxd", "abcd"]
    left, right = spark.createDataFrame(list(enumerate(words[::2])), "l int, a string"), spark.createDataFrame(list(enumerate(words[1::2])), "r int, b string")
    for cutoff in (60.0, 88.0):
        want = {(i, j) for i, a in enumerate(words[::2]) for j, b in enumerate(words[1::2]) if indel(a, b) >= cutoff}
        assert {(r["l"], r["r"]) for r in L.fuzzy_join(left, right, cutoff).collect()} == want


def test_near_join_moves_prefixes_and_loses_no_pair(spark, monkeypatch):
    import os
    import random

    rng = random.Random(3)
    base = [[rng.getrandbits(62) for _ in range(400)] for _ in range(60)]
    common = [rng.getrandbits(62) for _ in range(30)]
    sets = []
    for b in base:  # each with a near copy, an exact copy and one of another length; all hold the common shingles
        sets += [b + common, b[:-20] + [rng.getrandbits(62) for _ in range(20)] + common, b + common, b[:345] + common]
    sets += [common, common[:25], common[:24] + [7], [5], []]
    works = spark.createDataFrame([("t", k, s) for k, s in enumerate(sets)], "hw string, key int, shingles array<long>")
    rows = [set(s) for s in sets]
    near = {(a, b) for a in range(len(rows)) for b in range(a) if rows[a] and len(rows[a] & rows[b]) / len(rows[a] | rows[b]) >= 0.8}
    first = {k: rows.index(s) for k, s in enumerate(rows)}
    want = {(b, a) for a, b in near if first[a] == a and first[b] == b and rows[a] != rows[b]}
    tables, put = [], S.landed

    def landed(df, name):
        out = put(df, name)
        tables.append((name, out.columns, sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())))
        return out

    monkeypatch.setattr(S, "landed", landed)
    pairs, members = S.near_pairs_of_classes(works)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and members.count() == len(sets) - 1
    # whole sets are written once
    assert [name for name, columns, _ in tables if "s" in columns] == ["near-sets"]
    size = {name: n for name, _, n in tables}
    assert size["near-keys"] < 0.4 * size["near-sets"]
    # any order of shingles and both ways to look candidates up give the same
    of = S.frequent
    monkeypatch.setattr(S, "FEW", 0)
    monkeypatch.setattr(S, "PARTNERS", 1)
    for most in (0, 3, 1_000):
        monkeypatch.setattr(S, "frequent", lambda s, most=most: of(s, 1, most))
        assert {(r["a"], r["b"]) for r in S.near_pairs_of_classes(works)[0].collect()} == want
