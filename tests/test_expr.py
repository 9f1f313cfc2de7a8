import datetime as dt

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import expr as X


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema).select(column).collect()]


def test_repo_urls(spark):
    rows = ["https://github.com/A/b.git", " www.github.com/a/b/tree/main/x ", "a/b.git?x", "github.com/a", None, "https://GitHub.com/a/b/"]
    assert values(spark, X.normalize_repo_url(F.col("v")), rows) == ["A/b", "a/b", "a/b.git", "a", "", "a/b"]
    assert values(spark, X.split_slug(F.col("v"))["status"], rows) == ["ok", "ok", "ok", "profile", "no_url", "ok"]
    assert values(spark, X.strict_repo(F.col("v")), ["https://github.com/a/b.git", "gitlab.com/a/b", "github.com/-a/b"]) == ["a/b", None, None]


def test_repo_name_scores(spark):
    assert values(spark, X.score_repo_name(F.col("v")), ["ML-Course-homework", "hw-ml", "notes", None]) == [100, 25, 0, 0]


def test_cells(spark):
    rows = ["# only a comment\n  # more", "%matplotlib inline\npass", "x = 1  # keep", "", "None", None]
    assert values(spark, X.is_empty_cell(F.col("v")), rows) == [True, True, False, True, True, True]
    assert values(spark, X.has_marker(F.col("v")), ["# YOUR CODE HERE", "# Ваш код здесь", "x"]) == [True, True, False]
    assert values(spark, X.bullet_count(F.col("v")), ["- a\n* b\n1. c\ntext\n 2) d", ""]) == [4, 0]


def test_clip(spark):
    assert values(spark, F.length(X.clip(F.col("v"), 10)), ["x" * 10, "x" * 11]) == [10, 10 + len("\n… (clipped, 11 characters)")]


def test_names_fold_alphabets(spark):
    assert values(spark, X.norm_person_name(F.col("v")), ["Ёлкин  Пётр", "Cидоров", " "]) == ["елкин петр", "сидоров", ""]
    assert values(spark, X.name_tokens(F.col("v")), ["Иванов И. Петр"]) == [["иванов", "петр"]]
    assert values(spark, X.clean_username(F.col("v")), ["https://t.me/some_one", "@name_1.", "Сat_name", "a b", None]) == ["some_one", "name_1", "Cat_name", "", ""]
    pairs = [("анна", "анна"), ("елизавета", "лиза"), ("лиза", "елизавета"), ("александра", "алекс"), ("анна", "мария")]
    assert values(spark, X.confirms_given_name(F.col("a"), F.col("b")), pairs, "a string, b string") == ["exact", "diminutive", "diminutive", "diminutive", ""]


def test_shingles_and_jaccard(spark):
    got = values(spark, X.shingles(X.plain_words(F.col("v")), 2), ["a b c", "a", "", "x y x y"])
    assert [sorted(g) for g in got] == [["a b", "b c"], [], [], ["x y", "y x"]]
    d = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(X.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]


@pytest.mark.parametrize(("ratio", "n", "want"), [(0.66, 12, 7), (0.5, 12, 6), (0.75, 12, 9), (0.0, 12, 1)])
def test_required_for(spark, ratio, n, want):
    assert spark.range(1).select(X.required_for(F.lit(ratio), F.lit(n))).first()[0] == want


def test_verdict_bounds(spark):
    rows = [(False, 7, 10), (False, 6, 10), (True, 10, 10), (False, 0, 0)]
    d = spark.createDataFrame(rows, "c boolean, p int, t int")
    assert [r[0] for r in d.select(X.verdict(F.col("c"), F.col("p"), F.col("t"))).collect()] == ["passed", "failed", "failed", "passed"]
    assert spark.range(1).select(X.points_needed(F.lit(0.28), F.lit(25))).first()[0] == 7


def test_deadlines(spark):
    now = F.lit(dt.datetime(2026, 11, 5, 12)).cast("timestamp")
    got = values(spark, F.date_format(X.parse_deadline(F.col("v"), now), "yyyy-MM-dd HH:mm"), ["срок: 10.12", "Срок: 1.2 9:30", "срок: 31.2", "later"])
    assert got == ["2026-12-10 20:59", "2027-02-01 06:30", None, None]
    post = values(spark, X.parse_homework_post(F.col("v"), now), ["Title\nline\nсрок: 10.12\n\n"])[0]
    assert (post["title"], post["body"]) == ("Title", "line") and post["deadline"] is not None


def test_labels_links_and_portraits(spark):
    table = F.create_map(F.lit("a"), F.lit("Alpha"))
    assert values(spark, X.label_of(F.col("v"), table), ["a", "z", None]) == ["Alpha", "z", "—"]
    assert [tuple(x) for x in values(spark, X.external_links(X.extract_links(F.col("v"))), ["- [t](http://x)\n- [u](local)"])[0]] == [("t", "http://x")]
    kind = "struct<portrait:string,growth:array<struct<topic:string,title:string,why:string,codes:array<string>,links:array<struct<title:string,url:string>>>>,next_steps:string>"
    d = spark.createDataFrame([(("p" * 1300, [("hw01", "t", "w", ["c1", "bad", "hw01.other"], [("l", "http://ok"), ("l", "http://no")]), ("hw99", "t", "w", [], [])], "n"),), ((None, [], "n"),)], f"p {kind}")
    good, none = [r[0] for r in d.select(X.sanitize_portrait(F.col("p"), ["http://ok"], ["hw01"], ["c1"])).collect()]
    assert none is None and len(good["portrait"]) == 1200 and len(good["growth"]) == 1
    assert good["growth"][0]["codes"] == ["c1", "hw01.other"] and len(good["growth"][0]["links"]) == 1
    said = [r[0] for r in d.select(X.validate_portrait(F.col("p"), ["http://ok"], ["hw01"], ["c1"])).collect()]
    assert "portrait too long" in said[0] and "foreign link http://no" in said[0] and "unknown code bad" in said[0] and said[1] == ["portrait missing"]
