"""A replay of the event table through the streaming forms gives the batch results."""

from pyspark.sql import functions as F

from gradeloom.operators import events as E
from gradeloom.plans import views as V
from gradeloom.streaming import streams as S

SF = "/root/testdata/sf0.001"


def replay(spark, df, tmp_path, name, order="at"):
    """The rows in three files in time order, as a stream of three micro-batches."""
    path = f"{tmp_path}/{name}"
    rows = df.withColumn("_q", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy(order))).persist()
    for k in (1, 2, 3):
        rows.filter(F.col("_q") == k).drop("_q").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def collect(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck_{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_totals(spark, tmp_path):
    ev = V.events(spark, SF)
    got = collect(S.running_totals(replay(spark, ev, tmp_path, "a")), tmp_path, "totals", "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in E.event_totals(ev).collect()}


def test_throttle(spark, tmp_path):
    ev = V.events(spark, SF)
    got = collect(S.throttle_stream(replay(spark, ev, tmp_path, "b"), "tg_id", "at", 6 * 3600.0), tmp_path, "kept")
    want = E.greedy_spacing(ev, "tg_id", "at", 6 * 3600.0).select("tg_id", F.col("at").cast("timestamp_ntz"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_identity(spark, tmp_path):
    ev = V.events(spark, SF)
    got = collect(S.identity_stream(replay(spark, ev, tmp_path, "c"), "kind"), tmp_path, "ident")
    want = E.identity_changes(ev, "kind").select("id", "tg_id", "was", "now")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_binding_and_lifecycle(spark, tmp_path):
    rows = [(1, 10, "s", 1, "ask", False), (2, 10, "s", 2, "ask", False), (3, 10, "s", 3, "approve", False), (4, 11, "s", 4, "ask", True), (5, 11, "t", 5, "ask", True)]
    df = spark.createDataFrame(rows, "id long, tg_id long, key string, n int, action string, verified boolean").withColumn("at", F.timestamp_seconds("n")).drop("n")
    got = collect(S.binding_stream(replay(spark, df, tmp_path, "d")), tmp_path, "bind")
    assert [r[3] for r in sorted(map(tuple, got.collect()))] == ["claim", "pending", "bound", "taken", "bound"]
    acts = spark.createDataFrame([(1, 7, 1, "start"), (2, 7, 2, "restart"), (3, 7, 3, "finish"), (4, 7, 4, "start"), (5, 7, 5, "finish")], "id long, broadcast_id long, n int, action string").withColumn("at", F.timestamp_seconds("n")).drop("n")
    got = collect(S.broadcast_lifecycle(replay(spark, acts, tmp_path, "e")), tmp_path, "life")
    assert [r[3] for r in sorted(map(tuple, got.collect()))] == ["sending", "stalled", "stalled", "sending", "done"]


def test_drafts_and_delivery(spark, tmp_path):
    rows = [(1, 1, "name", "a"), (2, 1, "name", "b"), (3, 1, "mail", "m"), (4, 1, "submit", None)]
    df = spark.createDataFrame(rows, "id long, tg_id long, step string, value string").withColumn("at", F.timestamp_seconds("id"))
    got = collect(S.application_drafts(replay(spark, df, tmp_path, "f")), tmp_path, "drafts", "update").orderBy(F.desc("rev"), F.desc("submitted")).first()
    assert got["answers"] == {"name": "b", "mail": "m"} and got["rev"] == 3 and got["submitted"]
    res = spark.createDataFrame([(1, 5, "sent", 1), (1, 5, "sent", 2), (1, 6, "blocked", 3)], "broadcast_id long, tg_id long, status string, at int")
    assert collect(S.deliver_once(replay(spark, res, tmp_path, "g")), tmp_path, "once").count() == 2


def test_marks_and_checks_as_they_come(spark, tmp_path):
    log = spark.createDataFrame([(1, 5, 1, "click", "a"), (2, 5, 2, "view", "demo-x"), (3, 5, 2, "click", "b"), (4, 6, 3, "click", "c"), (5, 5, 4, "view", "real"), (6, 5, 5, "click", "d")], "id long, tg_id long, n int, kind string, payload string").withColumn("at", F.timestamp_seconds("n")).drop("n")
    got = collect(S.flag_stream(replay(spark, log, tmp_path, "m")), tmp_path, "marks")
    assert {r["id"]: r["demo"] for r in got.collect()} == {1: False, 3: True, 4: False, 6: False}
    asked = spark.createDataFrame([("u", 0), ("u", 3600), ("u", 6 * 3600), ("u", 7 * 3600), ("v", 100)], "url string, n int").withColumn("at", F.timestamp_seconds("n")).drop("n")
    got = collect(S.ttl_check_stream(replay(spark, asked, tmp_path, "t")), tmp_path, "ttl")
    assert [(r["url"], r["cached"]) for r in got.orderBy("url", "at").collect()] == [("u", False), ("u", True), ("u", False), ("u", True), ("v", False)]


def test_outbox(spark, tmp_path):
    rows = spark.createDataFrame([("n", "p", "1", 1, 1), ("n", "p", "1", 2, 2), ("n", "p", "2", 3, 3), ("n", "p", "1", 4, 4)], "sink string, entity string, key string, rev long, at int")
    stream = replay(spark, rows, tmp_path, "h")
    state = f"file://{tmp_path}/state"
    send = lambda df: df.withColumn("ok", F.col("key") == "1")
    S.sync_outbox(stream, state, send, f"{tmp_path}/ck", tries=2).awaitTermination()
    last = {r["key"]: (r["rev"], r["status"]) for r in spark.read.parquet(f"{state}/batch=2").collect()}
    assert last["1"] == (4, "done") and last["2"][1] in ("retry", "diverged")


def test_shuffled_log_is_marked_in_time_order(spark, tmp_path):
    """Rows arrive in any order within an hour and over three micro-batches; the marks equal the batch form."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(900):
        view = rng.random() < 0.2
        rows.append((i, rng.randrange(12), 40 * i, "view" if view else "click", rng.choice(["demo-a", "real", None]) if view else "x"))
    end = [(10_000 + k, 99, 40 * 900 + 90_000 * k, "click", "end") for k in (1, 2)]  # moves the watermark past all others
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(3_000)) + end
    schema = "id long, tg_id long, n long, kind string, payload string, ord int"
    log = spark.createDataFrame([(*r, k) for k, r in enumerate(shuffled)], schema).withColumn("at", F.timestamp_seconds("n")).drop("n")
    path = f"{tmp_path}/marked"
    S.append_marked(replay(spark, log, tmp_path, "shuffled", "ord"), path, f"{tmp_path}/ck_marked", "2 hours").awaitTermination()
    got = {r["id"]: r["demo"] for r in spark.read.parquet(path).collect()}
    plain = log.filter("kind <> 'view'").select("id", "tg_id", "at")
    views = log.filter("kind = 'view'").select("id", "tg_id", "at", F.col("payload").alias("student_key"))
    want = {r["id"]: r["demo"] for r in E.flag_demo(plain, views).collect()}
    assert {i for i in want if i < 10_000} <= set(got) and all(want[i] == d for i, d in got.items())


def test_state_of_quiet_keys_goes_after_the_gap(spark, tmp_path):
    rows = [(k, 10 * k) for k in range(50)] + [(7, 400), (7, 520)] + [(99, 50_000 + 10_000 * k) for k in range(3)]
    df = spark.createDataFrame(rows, "k int, n int").withColumn("at", F.timestamp_seconds("n")).drop("n")
    kept = S.throttle_stream(replay(spark, df, tmp_path, "quiet"), "k", "at", 100.0, "1 second")
    q = kept.writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck_quiet").trigger(availableNow=True).start()
    q.awaitTermination()
    left = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(left) >= 15 and left[-1] <= 1  # only the last key may still matter
    want = E.greedy_spacing(df, "k", "at", 100.0).select("k", F.col("at").cast("timestamp_ntz"))
    assert {tuple(r) for r in spark.table("quiet").collect()} == {tuple(r) for r in want.collect()}


def test_accounts_bound_twice_are_found(spark):
    rows = [(1, 10, "s", "bound"), (2, 10, "t", "bound"), (3, 11, "s", "taken"), (4, 11, "u", "bound"), (5, 11, "u", "bound")]
    got = S.double_bound(spark.createDataFrame(rows, "id long, tg_id long, key string, decision string")).collect()
    assert [tuple(r) for r in got] == [(10, 2)]


def test_outbox_writes_the_buckets_it_touches(spark, tmp_path):
    """Three micro-batches: many records, then one, then none that is new; revisions, remote ids and retries of all are right."""
    rows = [("n", "p", str(k), 1, 1) for k in range(300)] + [("n", "p", "7", 2, 1_000)] + [("n", "p", "7", 1, 2_000), ("n", "p", "8", 5, 2_000)]
    df = spark.createDataFrame(rows, "sink string, entity string, key string, rev long, at int")
    path = f"{tmp_path}/log"
    for k, (lo, hi) in enumerate(((0, 10), (10, 1_500), (1_500, 9_999))):
        df.filter((F.col("at") > lo) & (F.col("at") <= hi)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    state = f"file://{tmp_path}/state"
    send = lambda d: d.withColumn("ok", F.col("key") != "9").withColumn("remote_id", F.when(F.col("rev") == 1, F.concat(F.lit("r"), "key")))
    S.sync_outbox(stream, state, send, f"{tmp_path}/ck_buckets", tries=2, buckets=16).awaitTermination()
    wrote = [spark.read.parquet(f"{state}/batch={n}").select("bucket").distinct().count() for n in range(3)]
    assert wrote[0] == 16 and wrote[1] <= 2 and wrote[2] <= 2
    last = {r["key"]: (r["rev"], r["status"], r["synced_rev"], r["remote_id"]) for r in S.outbox_state(spark, state, 2).collect()}
    assert len(last) == 300 and last["7"] == (2, "done", 2, "r7") and last["8"] == (5, "done", 5, "r8") and last["50"] == (1, "done", 1, "r50")
    assert last["9"][1] == "diverged" and last["9"][2] is None
    assert S.diverged_flags(S.outbox_state(spark, state, 2)).count() == 1
