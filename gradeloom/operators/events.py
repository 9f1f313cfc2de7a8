"""Event logs and keyed state: totals, latest state, identity changes, spacing, deliveries and bindings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.operators.numbering import in_ranges
from gradeloom.operators.spacing import greedy_spacing  # noqa: F401  part of this module's interface


def event_totals(events: DataFrame, by: str = "kind") -> DataFrame:
    """A09."""
    return events.groupBy(by).agg(F.count("*").alias("n"))


def top_payloads(events: DataFrame, kind: str, n: int, path: str = "$.code") -> DataFrame:
    """The most frequent payload codes of a kind; ties by code."""
    rows = events.filter(F.col("kind") == kind).groupBy(X.payload_code(F.col("payload"), path).alias("code")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "code").limit(n)


def seen_count(events: DataFrame, tg_id: int, kind: str, like: str) -> DataFrame:
    return events.filter((F.col("tg_id") == tg_id) & (F.col("kind") == kind) & F.col("payload").like(like)).agg(F.count("*").alias("n"))


def profile(events: DataFrame) -> DataFrame:
    """A10 for all users: count, first and last time of each kind."""
    return events.groupBy("tg_id", "kind").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))


def account_profile(events: DataFrame, bindings: DataFrame, tickets: DataFrame, claims: DataFrame) -> DataFrame:
    """A10 with the rest of an account: bound student, events, tickets (answered) and claims (status), for all accounts.

    The tables are merged and grouped once; an account that is only in one of them has zeros for the others.
    """
    none = lambda t: F.lit(None).cast(t)
    part = lambda df, what, key=None, at=None, is_open=None: df.select("tg_id", F.lit(what).alias("_what"), (none("string") if key is None else key.cast("string")).alias("_key"), (none("timestamp") if at is None else at).alias("_at"), (F.lit(False) if is_open is None else is_open).alias("_open"))
    rows = part(events, "event", at=F.col("at")).unionByName(part(bindings, "binding", key=F.col("key")))
    rows = rows.unionByName(part(tickets, "ticket", is_open=~F.col("answered"))).unionByName(part(claims, "claim", is_open=F.col("status") == "pending"))
    count = lambda what, cond=F.lit(True): F.count_if((F.col("_what") == what) & cond)
    return rows.groupBy("tg_id").agg(
        F.min("_key").alias("student_key"), count("event").alias("events"), F.min("_at").alias("first_at"), F.max("_at").alias("last_at"),
        count("ticket").alias("tickets"), count("ticket", F.col("_open")).alias("open_tickets"), count("claim").alias("claims"), count("claim", F.col("_open")).alias("pending_claims"),
    )


def latest_state(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key, with the times it was first and last seen."""
    rest = [c for c in events.columns if c != key]
    got = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s"), F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen"))
    return got.select(key, "s.*", "first_seen", "last_seen")


def lookup(keys: DataFrame, state: DataFrame, key: str, value: str, default) -> DataFrame:
    """Current values of keys, a default where there is none."""
    return keys.join(state.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def identity_changes(events: DataFrame, value: str) -> DataFrame:
    """The first sighting and every change of a value; null and '' are the same."""
    w = Window.partitionBy("tg_id").orderBy("at", "id")
    rows = events.withColumn("_v", X.text(F.col(value))).withColumn("_p", F.lag("_v").over(w))
    return rows.filter(F.col("_p").isNull() | (F.col("_v") != F.col("_p"))).select("id", "tg_id", "at", F.col("_p").alias("was"), F.col("_v").alias("now"))


def arrival_number(events: DataFrame) -> DataFrame:
    """How many users had arrived when each did; ties share the higher number.

    Counted by moment first; the running sum is made of ranges of moments with offsets, not in one task for all rows.
    """
    first = events.groupBy("tg_id").agg(F.min("at").alias("at"))
    by = first.groupBy("at").agg(F.count("*").alias("n"))
    ranged = in_ranges(by, "at").withColumnRenamed("_part", "_p")
    sums = ranged.groupBy("_p").agg(F.sum("n").alias("s"))  # one row for each partition
    base = sums.select("_p", F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    numbered = ranged.join(F.broadcast(base), "_p").select("at", (F.sum("n").over(Window.partitionBy("_p").orderBy("at")) + F.col("b")).alias("number"))
    return first.join(numbered, "at").select("tg_id", "at", "number")


def view_intervals(views: DataFrame) -> DataFrame:
    """(tg_id, student_key, since, until) of each view, open at the end."""
    w = Window.partitionBy("tg_id").orderBy("at", "id")
    return views.select("tg_id", "student_key", F.col("at").alias("since"), F.lead("at").over(w).alias("until"))


def flag_demo(events: DataFrame, views: DataFrame) -> DataFrame:
    """An event is demo iff its account views a ``demo-`` key at that moment.

    The log and the views are merged and the last view is carried forward: one shuffle, no range join.
    """
    both = events.select("id", "tg_id", "at", F.lit(None).cast("string").alias("v"), F.lit(1).alias("o"))
    both = both.unionByName(views.select(F.col("id"), "tg_id", "at", X.text(F.col("student_key")).alias("v"), F.lit(0).alias("o")))
    w = Window.partitionBy("tg_id").orderBy("at", "o", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("now", F.last("v", ignorenulls=True).over(w)).filter("o = 1").select("id", "tg_id", "at", F.coalesce(F.col("now").like("demo-%"), F.lit(False)).alias("demo"))


def swap_cohort(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """The cohort each request reads: demo for accounts that view a demo key.

    ``intervals``: views (id, tg_id, student_key, at) or what ``view_intervals`` makes of them (since in place of at).
    """
    views = intervals if "at" in intervals.columns else intervals.withColumnRenamed("since", "at")
    views = views if "id" in views.columns else views.withColumn("id", F.unix_micros(F.col("at").cast("timestamp")))
    return flag_demo(requests, views).select("id", "tg_id", F.when(F.col("demo"), "demo").otherwise("real").alias("cohort"))


# Results after which nothing is sent again.
TERMINAL = ("sent", "blocked", "failed")


def freeze_targets(audience: DataFrame, broadcast_id: int) -> DataFrame:
    """The recipients (tg_id, label) of a broadcast as they are now, each once; a later binding does not join it."""
    return audience.groupBy("tg_id").agg(F.min("label").alias("label")).select(F.lit(broadcast_id).cast("long").alias("broadcast_id"), "tg_id", "label")


def delivery_state(targets: DataFrame, results: DataFrame) -> DataFrame:
    """Frozen targets with the first terminal result (broadcast_id, tg_id, at, id, status), else pending.

    Someone who blocked the sender is done with; the pending ones are exactly the remainder to send.
    """
    done = results.filter(F.col("status").isin(*TERMINAL)).groupBy("broadcast_id", "tg_id").agg(F.min(F.struct("at", "id", "status")).alias("r"))
    return targets.join(done, ["broadcast_id", "tg_id"], "left").select("broadcast_id", "tg_id", "label", F.coalesce("r.status", F.lit("pending")).alias("status"))


def fresh_checks(checks: DataFrame, now, ttl_hours: float = 6) -> DataFrame:
    """The latest check of each url (url, at, found) that is younger than the time to live at ``now``, a timestamp column."""
    last = checks.groupBy("url").agg(F.max(F.struct("at", "found")).alias("c")).select("url", "c.*")
    return last.filter(F.unix_micros("at") > F.unix_micros(now) - int(ttl_hours * 3_600_000_000))


def pending_targets(targets: DataFrame, delivered: DataFrame, *keys: str) -> DataFrame:
    """Frozen targets that nothing was delivered to."""
    return targets.join(delivered.select(*keys).distinct(), list(keys), "left_anti")


def status_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """A11."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, n: int, order: str = "id", newest: bool = True) -> DataFrame:
    """K04."""
    return rows.orderBy(F.desc(order) if newest else F.asc(order)).limit(n)


def latest_revision(tasks: DataFrame, synced: DataFrame) -> DataFrame:
    """One task for each (sink, entity, key), its last revision; stale where that is synced already."""
    last = tasks.groupBy("sink", "entity", "key").agg(F.max("rev").alias("rev"), F.max_by("id", "rev").alias("id"), F.count("*").alias("n"))
    rows = last.join(synced.select("sink", "entity", "key", "synced_rev"), ["sink", "entity", "key"], "left")
    return rows.withColumn("status", F.when(F.col("rev") <= F.coalesce("synced_rev", F.lit(-1)), "stale").otherwise("pending"))


def synced_state(state: DataFrame, done: DataFrame) -> DataFrame:
    """Stored revisions (sink, entity, key, rev, remote_id) with finished tasks put in.

    The last revision stays, and the remote identifier of the last revision that has one: a null never replaces it.
    """
    rows = state.unionByName(done.select(*state.columns))
    known = F.max(F.when(F.col("remote_id").isNotNull(), F.struct("rev", "remote_id")))
    return rows.groupBy("sink", "entity", "key").agg(F.max("rev").alias("rev"), known["remote_id"].alias("remote_id"))


def decide_binding(attempts: DataFrame, bindings: DataFrame, contacts: DataFrame) -> DataFrame:
    """Bind, claim (no handle known, or another one) or taken (the student has another account)."""
    b, c = bindings.select("key", F.col("tg_id").alias("owner")), contacts.select("key", F.lower("username").alias("expected"))
    rows = attempts.join(b, "key", "left").join(c, "key", "left")
    known = X.text(F.col("expected"))
    return rows.select("id", "tg_id", "key", F.when(F.col("owner").isNotNull() & (F.col("owner") != F.col("tg_id")), "taken").when((known == "") | (known != F.lower(X.text(F.col("username")))), "claim").otherwise("bind").alias("decision"))


def forget(tables: dict[str, DataFrame], tg_id: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The tables without one user's rows, and the number of rows each loses."""
    keep = {n: t.filter((F.col("tg_id") != tg_id) | F.col("tg_id").isNull()) for n, t in tables.items()}
    return keep, {n: t.filter(F.col("tg_id") == tg_id).agg(F.count("*").alias("n")) for n, t in tables.items()}


def health_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each part, in one table."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def service_health(students: DataFrame, passed: DataFrame, bindings: DataFrame, tickets: DataFrame, claims: DataFrame, broadcasts: DataFrame) -> DataFrame:
    """One row of students, checked ones, certificates, bindings, open tickets, pending claims and stalled broadcasts."""
    one = lambda df, c, name: df.agg(c.alias(name))
    parts = [
        one(students, F.count("*"), "students"), passed.agg(F.count("*").alias("active"), F.count_if("certified").alias("certified")), one(bindings, F.count("*"), "bindings"),
        one(tickets, F.count_if(~F.col("answered")), "open_tickets"), one(claims, F.count_if(F.col("status") == "pending"), "pending_claims"), one(broadcasts, F.count_if(F.col("status") == "stalled"), "stalled"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def review_batch_stats(results: DataFrame) -> DataFrame:
    """Results (status, body, tokens) by outcome, with tokens and bodies that are no JSON."""
    bad = F.col("body").isNotNull() & F.try_parse_json("body").isNull()
    return results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("succeeded", "errored", "canceled", "expired")], F.count_if(bad).alias("unparsed"), F.sum("tokens").alias("tokens"))
