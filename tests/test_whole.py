"""Queries and jobs that do the whole job, on tables that a cut would show in."""

import json

from gradeloom.plans import jobs, registry


def landed(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_review_requests_hold_whole_conversations(spark, tmp_path):
    turns = [(1, 0, "system", "rules"), (1, 1, "user", "a" * 3_000), (1, 2, "assistant", "b" * 5_000 + "END"), (2, 0, "user", "c" * 130_000)]
    part = [("Brand#11", "x"), ("Brand#12", "y")]
    d = landed(spark, tmp_path, conversations=(turns, "conv_id long, turn long, role string, text string"), part=(part, "p_brand string, p_name string"))
    got = {r["custom_id"]: json.loads(r["json"]) for r in registry.queries()["review_requests"](spark, d).collect()}
    one, two = got["1|guided"], got["2|plain"]
    assert one["text"].endswith("END") and "--- output ---\nrules" in one["text"] and not one["truncated"] and one["codes"] == ["Brand#11", "Brand#12"]
    assert len(two["text"]) == 120_000 and two["truncated"] and two["codes"] == ["Brand#12"] and one["prompt"] != two["prompt"]


def test_review_volume_and_slug(spark, tmp_path):
    docs = [(1, "a" * 5_000, "en", "s"), (2, "b " * 100_000, "en", "s"), (3, "c" * 30, "en", "s"), (4, "d" * 60, "de", "s")]
    d = landed(spark, tmp_path, documents=(docs, DOCUMENTS))
    v = registry.queries()["review_volume"](spark, d).first()
    assert (v["works"], v["truncated"], v["input_tokens"], v["output_tokens"], v["digest_median"], v["digest_max"]) == (4, 1, 1_666 + 40_000 + 10 + 20, 3_600, 5_000, 200_000)
    assert abs(v["cost"] - (41_696 * 2 + 3_600 * 10) / 1e6) < 1e-9 and abs(v["batch_cost"] - v["cost"] / 2) < 1e-9
    slugs = {r["doc_id"]: r["slug"] for r in registry.queries()["text_measures"](spark, d).collect()}
    assert slugs[1] == "a" * 5_000 and slugs[2] == "_".join("b" * 100_000)


def test_every_document_is_in_a_near_class(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    texts = {1: words, 2: words + " x", 3: words, 4: "p q r s t u", 5: "p q r s t u", 6: "short", 7: "other words that stand here alone"}
    d = landed(spark, tmp_path, documents=([(k, t, "en", "s") for k, t in texts.items()], DOCUMENTS))
    got = {r["doc_id"]: (r["first"], r["copies"], r["links"]) for r in registry.queries()["near_members"](spark, d).collect()}
    assert got == {1: (1, 2, 1), 2: (2, 1, 1), 3: (1, 2, 1), 4: (4, 2, 0), 5: (4, 2, 0), 6: (6, 1, 0), 7: (7, 1, 0)}


def test_grading_sees_only_additions(spark):
    prose, given, split = "p" * 250, "knn = KNN()\nscaler.fit_transform(X)", "a, b = train_test_split(X, random_state=1)"
    cells = [(nb, i, kind, source, 1 + i, []) for nb in ("n1", "n2", "n4") for i, (kind, source) in enumerate([("markdown", prose), ("code", given), ("code", split)])]
    cells += [("n3", 0, "markdown", prose, None, []), ("n3", 1, "code", given, 1, [])] + [("n4", 3, "code", "imputer.fit_transform(X)", 9, []), ("n4", 4, "markdown", "o" * 250, None, []), ("n4", 5, "code", "mine = knn.predict(a)", 10, [])]
    df = spark.createDataFrame(cells, "nb string, idx int, kind string, source string, ec int, errors array<string>")
    subs = spark.createDataFrame([("k1", "hw1", "n1"), ("k2", "hw2", "n2"), ("k3", "hw1", "n3"), ("k4", "hw1", "n4"), ("k5", "hw3", "n1")], "key string, hw string, nb string")
    handouts = spark.createDataFrame([(h, k, t) for h in ("hw1", "hw2") for k, t in (("markdown", prose + " "), ("code", given))], "hw string, kind string, source string")
    rubrics = spark.createDataFrame([("hw1", "delta", []), ("hw2", "full", []), ("hw3", "delta", ["scaler"])], "hw string, scope string, leakage_exempt array<string>")
    checks = spark.createDataFrame([(h, "knn", "uses KNN", True, "rule", ["knn"], [], [], None) for h in ("hw1", "hw2", "hw3")], "hw string, check_id string, title string, required boolean, kind string, any_regex array<string>, all_regex array<string>, none_regex array<string>, bullets_min int")
    none = lambda ddl: spark.createDataFrame([], ddl)
    catalog = spark.createDataFrame([("common.no_seed", "Seed", "minor", "rule", "common")], "code string, title string, severity string, detector string, hw string")
    args = (df, none("nb string, error string"), checks, none("key string, hw string, check_id string, passed boolean, comment string"), none("key string, hw string, pos int, code string, comment string"), catalog, subs)
    out = jobs.grade(*args, handouts=handouts, rubrics=rubrics)
    passed = {r["key"]: r["required_passed"] for r in out["verdicts"].collect()}
    # k2 has the full scope, k4 its own use, k5 the same notebook as k1 for a topic without a handout
    assert passed == {"k1": 0, "k2": 1, "k3": 0, "k4": 1, "k5": 1}
    found = {(r["key"], r["code"]) for r in out["findings"].collect()}
    assert {k for k, c in found if c.endswith(".knn")} == {"k1", "k3"}
    assert {k for k, c in found if c == "common.no_own_conclusions"} == {"k1", "k2", "k3"}
    assert {k for k, c in found if c == "common.fit_before_split"} == set()
    bare = jobs.grade(*args, rubrics=rubrics.drop("leakage_exempt"))
    assert {r["key"] for r in bare["findings"].collect() if r["code"] == "common.fit_before_split"} == {"k1", "k2", "k4", "k5"}


def test_a_large_group_is_numbered_in_several_tasks(spark):
    from gradeloom.operators import classify
    from pyspark.sql import functions as F

    rows = spark.range(4_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.lit(None).cast("string")).otherwise("en").alias("lang"))
    got = classify.numbered_in_groups(rows, "lang", "doc_id").withColumn("task", F.spark_partition_id())
    assert got.filter("lang = 'en'").select("task").distinct().count() > 1
    places = {r["lang"]: (r["n"], r["lo"], r["hi"], r["c"]) for r in got.groupBy("lang").agg(F.count_distinct("_rn").alias("n"), F.min("_rn").alias("lo"), F.max("_rn").alias("hi"), F.max("_count").alias("c")).collect()}
    assert places == {"en": (3_960, 0, 3_959, 3_960), None: (40, 0, 39, 40)}
    assert classify.systematic_sample(rows, "lang", "doc_id", 20).count() == 40 and classify.chunk_batches(rows, "lang", "doc_id", 50).count() == 4_000


def test_spacing_holds_no_key_in_one_row(spark):
    from gradeloom.operators import events
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.when(F.col("id") % 100 > 0, 7).alias("k"), F.timestamp_seconds("id").alias("at"))
    got = events.greedy_spacing(rows, "k", "at", 150.0)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    # key 7 lacks every hundredth second: a kept time is 150 s after the last, or 151; null is a key too
    want, last = [], None
    for t in range(60_000):
        if t % 100 and (last is None or t - last >= 150):
            want.append(t)
            last = t
    assert sorted(r["t"] for r in got.filter("k = 7").select(F.unix_seconds("at").alias("t")).collect()) == want and got.filter("k is null").count() == 300


def test_numbers_are_whole_where_bounds_are_sampled(spark):
    from gradeloom.operators import cohort, events
    from pyspark.sql import functions as F

    # more rows than a sample of the bounds holds, after a shuffle and with a column that the order does not need
    rows = spark.range(120_000).select(F.sha1(F.col("id").cast("string")).alias("name"), F.col("id").alias("key"), F.repeat(F.lit("x"), 20).alias("fio"))
    rows = rows.groupBy("name", "key").agg(F.max("fio").alias("fio"))
    got = sorted((r["number"], r["name"]) for r in cohort.numbered(rows, "name", "key").select("number", "name", "fio").collect())
    assert [n for n, _ in got] == list(range(1, 120_001)) and [x for _, x in got] == sorted(x for _, x in got)
    log = spark.range(60_000).select(F.col("id").alias("tg_id"), F.timestamp_seconds(F.xxhash64("id") % 1_000_000).alias("at"), "id")
    by = sorted((r["at"], r["number"]) for r in events.arrival_number(log).collect())
    last = {at: n for n, (at, _) in enumerate(by, 1)}
    assert all(number == last[at] for at, number in by)


def test_batches_beyond_ninety_nine_are_named_as_in_the_sql(spark, tmp_path):
    import duckdb
    from gradeloom.operators import classify

    docs = [(k, "t", "en", "s") for k in range(5_120)] + [(k, "t", None, "s") for k in range(6_000, 6_060)]
    d = landed(spark, tmp_path, documents=(docs, DOCUMENTS))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet/*.parquet')")
    want = con.execute(registry.oracle_sql()["chunk_batches"]).fetchall()
    got = registry.queries()["chunk_batches"](spark, d)
    assert sorted(map(tuple, got.select("doc_id", "lang", "batch").collect()), key=repr) == sorted(want, key=repr)
    # names by themselves stay apart
    assert {r["batch"] for r in classify.chunk_batches(got.select("doc_id", "lang"), "lang", "doc_id", 50).filter("doc_id in (4999, 5000, 5119)").collect()} == {"en_100", "en_101", "en_103"}
