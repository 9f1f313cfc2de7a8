"""Composite jobs (survey section 2.11): chains of operators as one lazy plan each. Tables go in, tables come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.operators import admissions, classify, cohort, events, linkage, rules, similarity, verdict
from gradeloom.sources import sinks


def build_roster(form: DataFrame, repos: DataFrame, repo_meta: DataFrame, owner_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(roster with keys, excluded). Profile links get the owner's best repository first."""
    named = linkage.best_profile_repo(form.drop("repo", "status"), repos).withColumnRenamed("repo", "_best").drop("score")
    rows = form.join(named.select("ord", "_best"), "ord", "left").withColumn("repo", F.coalesce("repo", "_best")).drop("_best", "status")
    keyed = linkage.assign_keys(linkage.resolve_roster(rows, repo_meta, owner_meta))
    return keyed.filter("status = 'ok'"), keyed.filter("status <> 'ok'")


def classify_stream(notebooks: DataFrame, measures: DataFrame, signatures: DataFrame, broken: DataFrame | None = None, students: DataFrame | None = None) -> dict[str, DataFrame]:
    """Notebooks (nb, key, rel, name, text) to submissions, alternatives, folder picks, unmatched ones and counts; ``measures`` by nb.

    ``broken`` (nb) are unreadable and neither matched nor unmatched; ``students`` (key) are everyone asked. A folder pick is a submission
    of its topic and no longer unmatched. Counts: submissions by topic, 'unmatched' and, if they are given, 'broken' and 'empty'.
    """
    matches = classify.accepted(classify.score_topics(notebooks, signatures)).join(notebooks.select("nb", "key", "rel"), "nb").join(measures, "nb")
    ranked = classify.pick_submissions(matches)
    chosen = ranked.filter("rank = 1")
    whole = notebooks if broken is None else notebooks.join(broken.select("nb"), "nb", "left_anti")
    left = whole.join(matches.select("nb").distinct(), "nb", "left_anti").join(measures, "nb")
    by_folder = classify.folder_fallback(left, chosen, signatures.select("topic"))
    picked = chosen.select("nb", "topic").unionByName(by_folder.select("nb", "topic"))
    met = matches.select("nb").unionByName(by_folder.select("nb"))
    counts = classify.classification_counts(picked, notebooks, broken, students, met)
    return {"chosen": chosen, "alternatives": ranked.filter("rank > 1"), "by_folder": by_folder, "unmatched": whole.join(met.distinct(), "nb", "left_anti"), "counts": counts}


def find_copies(cells: DataFrame, handouts: DataFrame, commits: DataFrame, min_students: int = 10, min_share: float = 0.3, t: float = 0.8, min_tokens: int = 300) -> dict[str, DataFrame]:
    """Cells (hw, key, path, idx, source) to exact groups and near pairs after the handouts are subtracted.

    Exact groups come as members (linear in the copies), near pairs between one work of each equal set.
    """
    body = cells.withColumn("body", X.strip_ws(F.col("source"))).filter("body <> ''")
    theirs = similarity.handout_union(handouts).unionByName(similarity.stream_boilerplate(body.select("hw", "key", "body"), min_students, min_share).select("hw", "body"))
    own = similarity.subtract_handout(body, theirs)
    members = similarity.exact_members(similarity.fingerprints(own))
    code = own.groupBy("hw", "key").agg(X.ordered_join(F.struct("path", "idx"), F.col("source")).alias("code"))
    tokens = code.select("hw", "key", X.regex_tokens(F.col("code")).alias("tokens")).filter(F.size("tokens") >= min_tokens)
    pairs, groups = similarity.near_pairs_of_classes(tokens.select("hw", "key", X.shingle_hashes(F.col("tokens"), 5).alias("shingles")), t)
    added = similarity.first_added(commits).join(body.select("hw", "key", "path").distinct(), ["key", "path"]).groupBy("hw", "key").agg(F.min("added_at").alias("added_at"))
    return {"exact": members.join(added, ["hw", "key"], "left"), "near": similarity.who_was_first(pairs, added), "groups": groups}


def grade(cells: DataFrame, broken: DataFrame, checks: DataFrame, reviews: DataFrame, items: DataFrame, catalog: DataFrame, submissions: DataFrame, handouts: DataFrame | None = None, rubrics: DataFrame | None = None) -> dict[str, DataFrame]:
    """Cells of submissions (nb, …) with (nb, key, hw) to findings and verdicts.

    ``handouts``: cells (hw, kind, source) of each topic's template; ``rubrics``: (hw, scope) and, if there is one,
    leakage_exempt, an array of words. Checks see only what the student added (F27), unless the scope is full or the
    topic has no handout; a topic without a rubric has the scope delta.
    """
    # a notebook is judged once for each topic that it is submitted for
    works = submissions.select("nb", "hw").distinct()
    own = cells.drop("hw").join(works, "nb")
    prose = lines = words = None
    if handouts is not None:
        prose, lines = rules.template_prose(handouts), rules.template_lines(handouts)
    if rubrics is not None and "leakage_exempt" in rubrics.columns:
        words = rubrics.select("hw", F.explode("leakage_exempt").alias("word"))
    by_work = lambda df: df.withColumn("nb", F.struct("nb", "hw"))
    of_work = lambda df: df.withColumn("hw", F.col("nb.hw")).withColumn("nb", F.col("nb.nb"))
    keyed = by_work(own)
    facts = rules.notebook_facts(keyed, prose)
    found = rules.run_rules(facts, by_work(broken.select("nb", "error").join(works, "nb")))
    alive = facts.filter("n_full > 0").select("nb")
    for more in (rules.leakage(keyed, lines, exempt_words=words), rules.no_effect_calls(keyed), rules.undefined_names(keyed)):
        found = found.unionByName(more.join(alive, "nb", "left_semi").select(found.columns))
    found = of_work(found)
    target = facts.select("nb", "src", "md")
    if handouts is not None:
        template = similarity.handout_union(handouts.select("hw", X.strip_ws(F.col("source")).alias("body")).filter("body <> ''"))
        if rubrics is not None:
            template = template.join(F.broadcast(rubrics.filter("scope = 'full'").select("hw")), "hw", "left_anti")
        added = similarity.subtract_handout(keyed.withColumn("body", X.strip_ws(F.col("source"))), template).drop("body")
        # a work without any cell of its own still has its checks, over empty texts
        target = facts.select("nb").join(rules.notebook_facts(added).select("nb", "src", "md"), "nb", "left").na.fill("", ["src", "md"])
    rule_checks = checks.filter("kind = 'rule'")
    # empty and broken works have no items: neither findings nor credit
    target = target.join(alive, "nb", "left_semi").withColumn("hw", F.col("nb.hw"))
    named = rule_checks.select("hw", "check_id", "any_regex", "all_regex", "none_regex", "bullets_min")
    passed = rules.rubric_checks(target, named).withColumn("nb", F.col("nb.nb"))
    passed = passed.join(submissions, ["nb", "hw"]).join(F.broadcast(rule_checks.select("hw", "check_id", "required", "title")), ["hw", "check_id"])
    missed = passed.filter(~F.col("passed")).select("key", "hw", F.concat_ws(".", "hw", "check_id").alias("code"), F.when(F.col("required"), "major").otherwise("minor").alias("severity"), F.col("title").alias("comment"))
    rule_findings = found.join(submissions, ["nb", "hw"]).select("key", "hw", "code", "severity", F.col("detail").alias("comment")).unionByName(missed)
    judged = verdict.apply_review_checks(checks.filter("kind = 'llm'"), reviews, catalog)
    merged = verdict.merge_review_findings(rule_findings, items, catalog, judged)
    required = checks.filter("required").groupBy("hw").agg(F.count("*").alias("required_total"))
    llm_required = checks.filter("required and kind = 'llm'").groupBy("hw").agg(F.count("*").alias("_llm"))
    done = passed.filter("required and passed").groupBy("key", "hw").agg(F.count("*").alias("_done"))
    credit = of_work(alive).withColumn("_alive", F.lit(1))
    results = submissions.select("key", "hw", "nb").join(F.broadcast(required), "hw", "left").join(F.broadcast(llm_required), "hw", "left").join(done, ["key", "hw"], "left")
    results = results.join(credit, ["nb", "hw"], "left").withColumn("_llm", F.col("_llm") * F.col("_alive"))
    results = results.select("key", "hw", (F.coalesce("_done", F.lit(0)) + F.coalesce("_llm", F.lit(0))).alias("required_passed"), F.coalesce("required_total", F.lit(0)).alias("required_total"))
    return {"findings": cohort.sort_findings(merged), "verdicts": verdict.verdicts(results, merged, judged)}


def publish(students: DataFrame, hw: DataFrame, findings: DataFrame, topics: DataFrame, catalog: DataFrame, path: str, ids: list[str], pairs: DataFrame | None = None, digest: DataFrame | None = None) -> None:
    """Matrix, certificates, typical errors with their pages (S12) and reports.

    With ``pairs`` (hw, a, b) also the similar works and their numbers, with ``digest`` (key, digest) a page for each student.
    """
    passed = cohort.passed_counts(hw, students, topics)
    sinks.write_table(cohort.passed_matrix(hw, students, ids, None if pairs is None else similarity.symmetrise(pairs)).join(passed.select("key", "passed"), "key").withColumn("last", -F.col("passed")), f"{path}/summary", "last", "fio", "key")
    sinks.write_table(cohort.number_certified(passed), f"{path}/certificates", "number")
    sinks.write_table(cohort.typical_errors(hw, students, findings, catalog), f"{path}/typical_errors", "hw", "place")
    sinks.write_reports(sinks.report_documents(students, hw, findings), f"{path}/reports")
    errors = sinks.render_errors(cohort.typical_errors(hw, students, findings, catalog))
    sinks.write_table(errors, f"{path}/error_pages", "doc_id")
    if digest is not None:
        sinks.write_table(sinks.render_student(students, digest), f"{path}/student_pages", "doc_id")
    if pairs is not None:
        sinks.write_table(pairs, f"{path}/similarity", "hw", "a", "b")


def compare(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], topics: DataFrame, findings: DataFrame) -> dict[str, DataFrame]:
    """Of two builds, each (students, hw): flips, summary, changes, topics, gained and lost certificates by name, and the pages.

    ``findings``: key, hw, code, severity, title of the later build.
    """
    both = after[0].join(cohort.active(before[0]).select("key"), "key", "left_semi")
    flips = cohort.compare_builds(before[1], after[1], both, findings)
    p0, p1 = cohort.passed_counts(before[1], before[0], topics), cohort.passed_counts(after[1], after[0], topics)
    there = cohort.active(both).select("key")
    only = lambda hw: hw.join(there, "key", "left_semi")
    summary, changes, passes = cohort.diff_summary(p0, p1), cohort.changes(p0, p1), cohort.topic_passes(only(before[1]), only(after[1]))
    held = p1.select("key", "fio", "certified").join(p0.select("key", F.col("certified").alias("_was")), "key").filter(F.col("certified") != F.col("_was"))
    certificates = held.select(F.when(F.col("certified"), "gained").otherwise("lost").alias("change"), "fio", "key")
    lines = sinks.flip_lines(flips.join(after[0].select("key", "fio"), "key"))
    return {"flips": flips, "summary": summary, "changes": changes, "topics": passes, "certificates": certificates, "head": sinks.render_comparison(summary, changes, passes), "lines": lines, "pages": sinks.render_diff(flips)}


def link_contacts(roster: DataFrame, registrations: DataFrame, alphabet: str = "а-я") -> tuple[DataFrame, DataFrame]:
    """(links, counts by kind of match, existence, handle and use). ``exists`` is '' until someone has asked."""
    links = linkage.invalidate_shared_usernames(linkage.link_people(roster, registrations, alphabet))
    return links, linkage.contact_counts(links.withColumn("exists", F.lit("")))


def match_certificates(files: DataFrame, holders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, problems)."""
    found = linkage.match_awards(files, holders)
    return found.filter("key is not null"), found.filter("key is null")


def review_io(texts: DataFrame, prompts: DataFrame, codes: DataFrame, size: int = 25) -> tuple[DataFrame, DataFrame]:
    """(requests with their batch, volume)."""
    requests = classify.chunk_batches(texts.select("key", "hw"), "hw", "key", size)
    volume = classify.estimate_volume(texts.select("text", "truncated"))
    return sinks.review_requests(texts, prompts, codes).join(requests.withColumn("custom_id", F.concat_ws("|", "key", "hw")), "custom_id"), volume


def review_cycle(texts: DataFrame, prompts: DataFrame, codes: DataFrame, results: DataFrame, answers: DataFrame, catalog: DataFrame, size: int = 25, calibration: int = 10) -> dict[str, DataFrame]:
    """C09 as a whole: requests by batch, volume, a calibration sample of each topic, then what came back.

    ``results``: (status, body, tokens) of the batches; ``answers``: (key, hw, parsed, codes) of the works that were read.
    """
    requests, volume = review_io(texts, prompts, codes, size)
    sample = classify.systematic_sample(texts.select("key", "hw"), "hw", "key", calibration)
    return {"requests": requests, "volume": volume, "sample": sample, "stats": events.review_batch_stats(results), "progress": verdict.review_progress(texts, answers, catalog), "foreign": verdict.foreign_codes(answers, catalog)}


def portraits(hw: DataFrame, findings: DataFrame, catalog: DataFrame, answers: DataFrame, urls: list[str], topics: list[str], codes: list[str]) -> tuple[DataFrame, DataFrame]:
    """(digests to send, cleaned portraits with complaints) for answers (key, p)."""
    cleaned = answers.select("key", X.sanitize_portrait(F.col("p"), urls, topics, codes).alias("portrait"), X.validate_portrait(F.col("p"), urls, topics, codes).alias("complaints"))
    return cohort.student_digest(hw, findings, catalog), cleaned


def portrait_cycle(students: DataFrame, hw: DataFrame, findings: DataFrame, articles: DataFrame, topics: DataFrame, answers: DataFrame, head: str, tail: str) -> dict[str, DataFrame]:
    """C10 as a whole: the prompt with the allowed links, whole digests, and answers (key, p) cleaned and checked.

    ``articles``: (code, hw, title, kind, body). Links, topics and codes that an answer may name come from the catalog; they
    are a course's, so they are collected for the checks.
    """
    links = admissions.links_by_topic(articles)
    allowed = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None)
    urls, ids, codes = allowed(links, "url"), allowed(topics, "hw"), allowed(articles, "code")
    cleaned = answers.select("key", X.sanitize_portrait(F.col("p"), urls, ids, codes).alias("portrait"), X.validate_portrait(F.col("p"), urls, ids, codes).alias("complaints"))
    return {"prompt": verdict.portrait_prompt(links, topics, head, tail), "digests": cohort.digest_whole(students, hw, findings, articles, topics), "portraits": cleaned}


def cohort_dashboard(students: DataFrame, hw: DataFrame, topics: DataFrame) -> dict[str, DataFrame]:
    """C11."""
    passed = cohort.passed_counts(hw, students, topics)
    return {"topics": cohort.topic_stats(hw, students, topics), "passed": cohort.distribution(passed), "summary": cohort.cohort_summary(students, hw, passed), "places": cohort.percentile(passed)}


def usage_dashboard(log: DataFrame, views: DataFrame, kind: str, n: int = 10, path: str = "$.code") -> tuple[DataFrame, DataFrame]:
    """Totals and top payloads of what was not demo."""
    real = log.join(events.flag_demo(log, views).filter("not demo").select("id"), "id", "left_semi")
    return events.event_totals(real), events.top_payloads(real, kind, n, path)


def study_plan(findings: DataFrame, catalog: DataFrame, hw: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(top codes of each student, failed topics with reasons)."""
    named = findings if "title" in findings.columns else findings.join(catalog.select("code", "title"), "code", "left")
    return cohort.plan_top(cohort.plan_weights(findings, catalog)), cohort.failed_topics(hw, topics, named)


def study_pages(findings: DataFrame, articles: DataFrame, hw: DataFrame, topics: DataFrame, growth: DataFrame) -> dict[str, DataFrame]:
    """C13 as a whole: what to do first (a portrait's growth points, else the top codes), failed topics, chapters, best links.

    ``articles``: (code, hw, title, kind, body); ``growth``: (key, pos, title).
    """
    top, failed = study_plan(findings, articles, hw, topics)
    own = articles.select("code", F.explode(X.external_links(X.extract_links(F.col("body")))).alias("x")).select("code", F.col("x.title").alias("title"), F.col("x.url").alias("url"))
    links = admissions.links_by_topic(articles)
    return {"lines": cohort.plan_lines(top, growth), "failed": failed, "chapters": cohort.chapters(hw, topics, links), "links": cohort.best_links(findings, own, links)}


def plan_broadcast(passed: DataFrame, bindings: DataFrame, delivered: DataFrame, who: str) -> DataFrame:
    """C14: reachable targets of an audience that nothing was delivered to."""
    targets = cohort.audience(passed, bindings, who).filter("reachable").select("tg_id")
    return events.pending_targets(targets, delivered, "tg_id")


def admissions_view(applications: DataFrame, people: DataFrame, enrollments: DataFrame, tracks: DataFrame, remote: DataFrame) -> dict[str, DataFrame]:
    """C15."""
    view = admissions.applications_view(applications, people, enrollments)
    return {"applications": view, "tracks": admissions.track_counts(tracks, enrollments), "reconciled": admissions.reconcile(view, remote, "tg_id")}


def admissions_cycle(drafts: DataFrame, people: DataFrame, enrollments: DataFrame, tracks: DataFrame, homeworks: DataFrame, homework_tracks: DataFrame, remote: DataFrame, labels: dict[str, dict[str, str]], order: list[str]) -> dict[str, DataFrame]:
    """C15 as a whole: drafts (tg_id, answers, rev, submitted; T08's output, of which the last revision counts) to views.

    Recipients are those of each track, homeworks those that a person may see, and the projection is written anew each time.
    """
    last = drafts.groupBy("tg_id").agg(F.max_by(F.struct("answers", "submitted"), "rev").alias("d"))
    applications = last.select("tg_id", "d.answers", F.when(F.col("d.submitted"), "submitted").otherwise("draft").alias("status"))
    out = admissions_view(applications, people, enrollments, tracks, remote)
    sent = applications.filter("status = 'submitted'")
    return out | {"recipients": admissions.track_recipients(tracks, enrollments, people), "homeworks": admissions.visible_homeworks(enrollments, homework_tracks, homeworks), "projection": sinks.project_applications(sent, labels, order)}


def assemble_materials(files: DataFrame, routes: DataFrame, catalog: DataFrame, aliases: DataFrame | None = None, withheld: DataFrame | None = None, data_suffixes: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Files (name, content) with their destinations (J24), how many of each kind, and the index of the catalog's articles."""
    hashed = files.select("name", X.content_hash(F.col("content")).alias("hash"))
    placed = admissions.route_materials(hashed, routes, aliases, withheld, data_suffixes)
    return {"files": placed, "counts": placed.groupBy("kind").agg(F.count("*").alias("n")), "articles": admissions.articles_index(catalog)}
