"""Composite jobs on small tables of their own."""

from pyspark.sql import functions as F

from gradeloom.plans import jobs
from gradeloom.plans import views as V

SF = "/root/testdata/sf0.001"


def test_roster(spark):
    form = spark.createDataFrame([(0, "Ann", "A", "ml-course", "ok"), (1, "Bob", "b", None, "profile"), (2, "Cy", None, None, "no_url"), (3, "Di", "zz", "q", "ok")], "ord long, fio string, owner string, repo string, status string")
    repos = spark.createDataFrame([("b", "hw-ml", 0)], "owner string, repo string, ord int")
    meta = spark.createDataFrame([("a/ML-course", "2026"), ("b/hw-ml", None)], "full_name string, pushed_at string")
    ok, bad = jobs.build_roster(form, repos, meta, spark.createDataFrame([("a",), ("b",)], "owner string"))
    assert {r["key"]: r["canonical"] for r in ok.collect()} == {"a": "a/ML-course", "b": "b/hw-ml"}
    assert {r["fio"]: r["status"] for r in bad.collect()} == {"Cy": "no_url", "Di": "owner_missing"}


def test_copies(spark):
    handout = "import numpy as np\nprint('the handout')"
    own = "\n".join(f"value_{i} = fit(data_{i}, {i})" for i in range(60))
    renamed = own.replace("value_", "result_").replace("data_", "table_")
    other = "\n".join(f"for i in range({i}): print(i + {i} * len(x[{i}]))" for i in range(60))
    works = {"ann": own, "bob": own, "cat": renamed, "dan": other}
    cells = [("hw1", k, f"{k}.ipynb", 0, handout) for k in works] + [("hw1", k, f"{k}.ipynb", 1, t) for k, t in works.items()]
    df = spark.createDataFrame(cells, "hw string, key string, path string, idx int, source string")
    handouts = spark.createDataFrame([("hw1", "importnumpyasnpprint('thehandout')")], "hw string, body string")
    log = spark.createDataFrame([("ann", "ann.ipynb", "2026-01-02"), ("cat", "cat.ipynb", "2026-01-01")], "key string, path string, at string")
    out = jobs.find_copies(df, handouts, log, min_tokens=50)
    assert {(r["key"], r["first"], r["n"]) for r in out["exact"].collect()} == {("ann", "ann", 2), ("bob", "ann", 2)}
    # anonymised tokens make the renamed copy equal: one class of three, and no pair with the other work
    assert {(r["key"], r["first"]) for r in out["groups"].collect()} == {("ann", "ann"), ("bob", "ann"), ("cat", "ann"), ("dan", "dan")} and out["near"].count() == 0


def test_grading(spark):
    prose = "x" * 250
    cells = [("n1", 0, "markdown", prose, None, []), ("n1", 1, "code", "model = KNN()", 1, []), ("n2", 0, "code", "# todo", None, []), ("n3", 0, "markdown", prose, None, []), ("n3", 1, "code", "y = 1", 1, ["E: x"])]
    df = spark.createDataFrame(cells, "nb string, idx int, kind string, source string, ec int, errors array<string>").withColumn("source", F.regexp_replace("source", "KNN\\(\\)", "dict(KNN=1)"))
    broken = spark.createDataFrame([("n4", "not valid JSON")], "nb string, error string")
    subs = spark.createDataFrame([("k1", "hw1", "n1"), ("k2", "hw1", "n2"), ("k3", "hw1", "n3"), ("k4", "hw1", "n4")], "key string, hw string, nb string")
    checks = spark.createDataFrame([("hw1", "knn", "uses KNN", True, "rule", ["knn"], [], [], None), ("hw1", "idea", "explains", True, "llm", [], [], [], None)], "hw string, check_id string, title string, required boolean, kind string, any_regex array<string>, all_regex array<string>, none_regex array<string>, bullets_min int")
    reviews = spark.createDataFrame([("k1", "hw1", "idea", True, "")], "key string, hw string, check_id string, passed boolean, comment string")
    items = spark.createDataFrame([("k1", "hw1", 0, "unknown", "note")], "key string, hw string, pos int, code string, comment string")
    catalog = spark.createDataFrame([("common.no_seed", "Seed", "minor", "rule", "common")], "code string, title string, severity string, detector string, hw string")
    out = jobs.grade(df, broken, checks, reviews, items, catalog, subs)
    status = {r["key"]: (r["status"], r["required_passed"], r["required_total"]) for r in out["verdicts"].collect()}
    assert status["k1"] == ("passed", 2, 2) and status["k2"][0] == status["k3"][0] == status["k4"][0] == "failed"
    found = {(r["key"], r["code"]) for r in out["findings"].collect()}
    rows = [(r["key"], r["code"]) for r in out["findings"].collect()]
    assert len(rows) == len(set(rows)) and not [c for k, c in rows if k in ("k2", "k4") and c.startswith("hw1.")]
    assert status["k2"] == ("failed", 0, 2) and status["k4"] == ("failed", 0, 2)
    assert {("k1", "hw1.other"), ("k2", "common.nothing_done"), ("k3", "common.error_output"), ("k3", "hw1.knn"), ("k4", "common.notebook_unreadable")} <= found


def test_views_through_jobs(spark, tmp_path):
    students, hw, topics, findings, catalog = (f(spark, SF) for f in (V.students, V.hw, V.topics, V.findings, V.catalog))
    dash = jobs.cohort_dashboard(students, hw, topics)
    assert dash["topics"].count() == 5 and dash["summary"].count() == 1
    out = jobs.compare((students, V.hw(spark, SF, V.BUILD_DATE)), (students, hw), topics, findings.join(catalog.select("code", "title"), "code"))
    assert out["flips"].count() == out["lines"].count() > 0 and out["summary"].first()["compared"] > 0 and out["head"].count() == 3
    assert out["flips"].filter("why LIKE '%critical: %'").count() > 0
    jobs.publish(students, hw, findings, topics, catalog, str(tmp_path), ["1", "2", "3", "4", "5"], digest=hw.select("key", F.lit("d").alias("digest")).distinct())
    assert spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/student_pages").count() == students.count() and spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/error_pages").count() == 5
    assert spark.read.text(f"{tmp_path}/reports").count() == students.count()
    top, failed = jobs.study_plan(findings, catalog, hw, topics)
    assert top.count() > 0 and failed.count() > 0


def test_review_cycle(spark):
    texts = spark.createDataFrame([(f"k{i}", "hw1", "word " * i, False) for i in range(1, 8)], "key string, hw string, text string, truncated boolean")
    prompts, codes = spark.createDataFrame([("hw1", "judge")], "hw string, prompt string"), spark.createDataFrame([("hw1", "hw1.a")], "hw string, code string")
    results = spark.createDataFrame([("succeeded", "{}", 5), ("succeeded", "{", 5), ("errored", None, None)], "status string, body string, tokens long")
    answers = spark.createDataFrame([("k1", "hw1", True, ["hw1.a"]), ("k2", "hw1", True, ["x", "hw1.a", "y"]), ("k3", "hw1", False, [])], "key string, hw string, parsed boolean, codes array<string>")
    catalog = spark.createDataFrame([("hw1.a",)], "code string")
    out = jobs.review_cycle(texts, prompts, codes, results, answers, catalog, size=3, calibration=2)
    assert {r["custom_id"]: r["batch"] for r in out["requests"].collect()} == {f"k{i}|hw1": f"hw1_{(i + 2) // 3:02d}" for i in range(1, 8)}
    assert sorted((r["key"], r["place"]) for r in out["sample"].collect()) == [("k1", 1), ("k4", 2)]
    assert (out["stats"].first()["succeeded"], out["stats"].first()["unparsed"], out["stats"].first()["tokens"]) == (2, 1, 10)
    p = out["progress"].first()
    assert (p["expected"], p["done"], p["broken"], p["left"]) == (7, 1, 2, 6) and [tuple(r) for r in out["foreign"].collect()] == [("k2", "hw1", ["x", "y"])]
    empty = jobs.review_cycle(texts.limit(0), prompts, codes, results.limit(0), answers.limit(0), catalog)
    assert empty["requests"].count() == empty["sample"].count() == empty["foreign"].count() == 0 and empty["progress"].first()["expected"] == 0


ARTICLES = "code string, hw string, title string, severity string, kind string, body string"


def _articles(spark):
    link = "Text\n- [{}](https://{})"
    rows = [("common.seed", "common", "Seed", "minor", "hygiene", link.format("Seeds", "a.org/1")), ("1.split", "1", "Split", "major", "methodology", link.format("Book", "handbook.org/s") + "\n- [Other](https://b.org/2)"), ("1.plot", "1", "Plot", "minor", "methodology", "no links")]
    return spark.createDataFrame(rows, ARTICLES)


def test_portraits_and_study_pages(spark):
    students = spark.createDataFrame([(1, 0, 1, False)], "key long, passed long, total long, certified boolean")
    hw = spark.createDataFrame([(1, "1", "failed", 1, 4, "", "tidy")], "key long, hw string, status string, required_passed long, required_total long, summary string, strengths string")
    findings = spark.createDataFrame([(1, "1", "1.split", "critical", "Split", "late"), (1, "1", "1.plot", "minor", "Plot", ""), (1, "1", "common.seed", "minor", "Seed", "x")], "key long, hw string, code string, severity string, title string, comment string")
    topics = spark.createDataFrame([("1", "Trees", True)], "hw string, title string, graded boolean")
    answers = spark.createDataFrame([(1,)], "key long").select("key", F.expr("named_struct('portrait', 'You are tidy.', 'growth', array(named_struct('topic', '1', 'title', 'Split', 'why', 'w', 'codes', array('1.split'), 'links', array(named_struct('title', 'B', 'url', 'https://evil.org'), named_struct('title', 'Book', 'url', 'https://handbook.org/s')))), 'next_steps', 'go')").alias("p"))
    out = jobs.portrait_cycle(students, hw, findings, _articles(spark), topics, answers, "Write.", "End.")
    prompt = out["prompt"].first()["prompt"]
    assert prompt.startswith("Write.\n\n### 1 · Trees\n- Book — https://handbook.org/s\n- Other — https://b.org/2\n\n### common · Common mistakes\n- Seeds") and prompt.endswith("End.")
    urls = [x["url"] for g in out["portraits"].first()["portrait"]["growth"] for x in g["links"]]
    assert urls == ["https://handbook.org/s"] and "Strengths: tidy" in out["digests"].first()["digest"]
    none = spark.createDataFrame([], "key long, pos int, title string")
    pages = jobs.study_pages(findings, _articles(spark), hw, topics, none)
    assert sorted((r["place"], r["title"]) for r in pages["lines"].collect()) == [(1, "1.split"), (2, "1.plot")]
    assert [r["url"] for r in pages["chapters"].collect()] == ["https://handbook.org/s"] and pages["failed"].count() == 1
    assert {r["code"]: r["url"] for r in pages["links"].collect()} == {"1.split": "https://handbook.org/s", "1.plot": "https://handbook.org/s", "common.seed": "https://a.org/1"}
    grown = jobs.study_pages(findings, _articles(spark), hw, topics, spark.createDataFrame([(1, 0, "Grow")], "key long, pos int, title string"))
    assert [(r["title"], r["source"]) for r in grown["lines"].collect()] == [("Grow", "portrait")]


def test_admissions_cycle(spark):
    drafts = spark.createDataFrame([(1, {"name": "old"}, 1, False), (1, {"name": "Ann\n A", "tracks": "ml;da"}, 2, True), (2, {"name": "Bob"}, 1, False)], "tg_id long, answers map<string,string>, rev long, submitted boolean")
    people = spark.createDataFrame([(1, "Ann A", "ann"), (2, "", "bob")], "tg_id long, fio string, username string")
    enrolled = spark.createDataFrame([(1, "ml"), (1, "da"), (2, "ml")], "tg_id long, track string")
    tracks = spark.createDataFrame([("ml",), ("da",), ("none",)], "track string")
    homeworks = spark.createDataFrame([(7, 1, "published"), (8, 2, "draft")], "homework long, num int, status string")
    on = spark.createDataFrame([(7, "ml"), (7, "da"), (8, "ml")], "homework long, track string")
    out = jobs.admissions_cycle(drafts, people, enrolled, tracks, homeworks, on, spark.createDataFrame([(1,), (9,)], "tg_id long"), {"tracks": {"ml": "Learning", "da": "Data"}}, ["name", "tracks"])
    assert {r["track"]: r["n"] for r in out["tracks"].collect()} == {"ml": 2, "da": 1, "none": 0} and tuple(out["reconciled"].first()) == (0, 1, 1)
    assert [(r["tg_id"], r["tracks"]) for r in out["applications"].collect()] == [(1, "da; ml")]
    assert sorted(tuple(r) for r in out["recipients"].collect()) == [(1, "Ann A"), (2, "bob")] and sorted(r["tg_id"] for r in out["homeworks"].collect()) == [1, 2]
    (row,) = out["projection"].collect()
    assert row["name"] == "Ann A" and "Learning" in row["tracks"] and "Data" in row["tracks"]


def test_materials(spark):
    acute = "caf\u00e9.pdf"
    files = [("cafe\u0301.pdf", "x"), ("b.pdf", "x"), ("same.pdf", "y"), ("secret.pdf", "z"), ("t.csv", "1"), ("left.txt", "2"), (None, "3")]
    routes = [(acute, "lesson", True), ("b.pdf", "lesson", True), ("b.pdf", "guests", False), ("gone.pdf", "lesson", True), ("maybe.pdf", "hw", False)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    out = jobs.assemble_materials(frame(files, "name string, content string"), frame(routes, "name string, destination string, wanted boolean"), _articles(spark), frame([("same.pdf", "b.pdf")], "name string, of string"), frame([("secret.pdf",)], "name string"), (".csv",))
    got = {(r["name"], r["destination"], r["kind"]) for r in out["files"].collect()}
    assert got == {("b.pdf", "lesson", "placed"), (acute, "lesson", "copy"), ("b.pdf", "guests", "placed"), ("same.pdf", "b.pdf", "alias"), ("secret.pdf", None, "withheld"), ("t.csv", None, "data"), ("left.txt", None, "extra"), ("gone.pdf", "lesson", "not found")}
    assert {r["kind"]: r["n"] for r in out["counts"].collect()}["placed"] == 2 and [r["hw"] for r in out["articles"].collect()] == ["common", "1"]
    bare = jobs.assemble_materials(frame([], "name string, content string"), frame([], "name string, destination string, wanted boolean"), _articles(spark))
    assert bare["files"].count() == 0


def test_publish_with_pairs(spark, tmp_path):
    students, hw, topics, findings, catalog = (f(spark, SF) for f in (V.students, V.hw, V.topics, V.findings, V.catalog))
    a, b = sorted(r["key"] for r in students.filter("status = 'ok'").limit(2).collect())
    pairs = spark.createDataFrame([("1", a, b), ("2", a, b)], "hw string, a long, b long")
    jobs.publish(students, hw, findings, topics, catalog, str(tmp_path), ["1", "2", "3", "4", "5"], pairs)
    got = {r["key"]: r["similar"] for r in spark.read.option("header", True).csv(f"{tmp_path}/summary").filter("similar <> '0'").collect()}
    assert got == {str(a): "2", str(b): "2"} and spark.read.option("header", True).csv(f"{tmp_path}/similarity").count() == 2


def test_diverged_flags(spark):
    from gradeloom.streaming import streams

    state = spark.createDataFrame([("s", "row", 1, 5, 8, "diverged"), ("s", "row", 2, 6, 1, "done")], "sink string, entity string, key long, rev long, tries int, status string")
    assert [tuple(r) for r in streams.diverged_flags(state).collect()] == [("sync_diverged", '{"sink":"s","entity":"row","key":"1","rev":5,"tries":8}')]
