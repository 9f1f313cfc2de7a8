"""Column helpers (survey section 2.2). All are built-in expressions, so they stay in generated code.

Patterns that must fold case beyond ASCII carry ``(?iU)``: Java's ``(?i)`` alone does not fold Cyrillic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hints in repository names with their scores.
NAME_HINTS = (
    ("ml-course-homework", 100), ("ml_course_homework", 100), ("ml-course", 80), ("ml_course", 80), ("mlcourse", 80),
    ("famcs", 70), ("bsu", 50), ("fpmi", 50), ("homework", 40), ("hw", 25), ("ml", 20),
)
# Latin letters and the Cyrillic ones they look like, both ways.
LATIN, CYRILLIC = "aeocpyxikmthb", "аеосрухикмтнв"
LATIN_CAPS, CYRILLIC_CAPS = "AEOCPYXKMTHB", "АЕОСРУХКМТНВ"
# Short given names.
SHORT_NAMES = {
    "лиза": "елизавета", "влад": "владислав", "саша": "александр", "женя": "евгений", "дима": "дмитрий",
    "миша": "михаил", "ваня": "иван", "катя": "екатерина", "настя": "анастасия", "маша": "мария", "даша": "дарья",
    "лёша": "алексей", "леша": "алексей", "коля": "николай", "толя": "анатолий", "паша": "павел", "юля": "юлия",
    "оля": "ольга", "таня": "татьяна", "света": "светлана", "сережа": "сергей", "андрюша": "андрей",
    "костя": "константин", "тимур": "тимур", "макс": "максим", "рома": "роман", "артем": "артём",
}
# Marks of an unfilled cell and bodies that count as empty.
CELL_MARKERS = ("your code here", "ваш код здесь", "todo", "# ...")
EMPTY_BODIES = ("", "pass", "...", "None")
# Names that keep their spelling when tokens are anonymised.
KEEP_TOKENS = (
    "fit", "predict", "transform", "fit_transform", "score", "self", "np", "pd", "plt", "sns", "px", "sklearn",
    "train_test_split", "DataFrame", "print", "range", "len", "import", "from", "as", "def", "class", "return", "for",
    "in", "if", "else", "None", "True", "False", "and", "or", "not", "lambda", "with", "try", "except", "while",
)
PASS_RATIO, CERTIFICATE_RATIO = 0.70, 0.66


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# -- links and names of repositories


def normalize_repo_url(c: Column) -> Column:
    """owner/repo or owner; the steps run in a fixed order, so a query after ``.git`` keeps ``.git``."""
    u = F.trim(text(c))
    for pattern in ("(?i)^https?://", r"(?i)^(www\.)?github\.com/", r"/(tree|blob)/.*$", r"\.git$", r"[?#].*$"):
        u = F.regexp_replace(u, pattern, "")
    return F.trim(u, F.lit("/ "))


def split_slug(c: Column) -> Column:
    """struct(owner, repo, status) of a normalised link."""
    u = normalize_repo_url(c)
    parts = F.split(u, "/")
    owner = F.when(u != "", F.element_at(parts, 1))
    repo = F.when(F.size(parts) > 1, F.element_at(parts, 2))
    return F.struct(owner.alias("owner"), repo.alias("repo"), F.when(u == "", "no_url").when(repo.isNull(), "profile").otherwise("ok").alias("status"))


def strict_repo(c: Column) -> Column:
    """owner/repo of a well-formed link, else null."""
    shape = r"(?i)^(?:https?://)?(?:www\.)?github\.com/([a-z0-9](?:[a-z0-9-]{0,38}))/([a-z0-9._-]{1,100}?)(?:\.git)?/?$"
    u = F.trim(text(c))
    return F.when(u.rlike(shape), F.concat_ws("/", F.regexp_extract(u, shape, 1), F.regexp_extract(u, shape, 2)))


def score_repo_name(c: Column) -> Column:
    """The best score of the hints that the name contains."""
    low = F.lower(text(c))
    return F.greatest(*[F.when(low.contains(h), s).otherwise(0) for h, s in NAME_HINTS])


def looks_like_repo(c: Column) -> Column:
    """P05."""
    return text(c).contains("github.com") | text(c).rlike(r"^[\w.-]+/[\w.-]+$")


# -- white space, lines and cells


def strip_ws(c: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), r"(?U)\s+", "")


def squash_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def norm_code_line(c: Column) -> Column:
    """A line up to its comment, without white space."""
    return strip_ws(F.substring_index(text(c), "#", 1))


def cell_body(c: Column) -> Column:
    """Code without comment lines and magics."""
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"(?m)^\s*#.*$", ""), r"(?m)^\s*[%!].*$", ""), F.lit(" \n\t\r"))


def is_empty_cell(c: Column) -> Column:
    return cell_body(c).isin(*EMPTY_BODIES)


def has_marker(c: Column) -> Column:
    low = F.lower(text(c))
    out = F.lit(False)
    for m in CELL_MARKERS:
        out = out | low.contains(m)
    return out


def has_image(outputs: Column) -> Column:
    """Whether some output of a cell (an array of variants) is an image."""
    keys = lambda o: F.map_keys(F.coalesce(F.try_variant_get(o, "$.data", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    return F.coalesce(F.exists(outputs, lambda o: F.exists(keys(o), lambda k: k.startswith("image/"))), F.lit(False))


def ordered_join(index: Column, value: Column, sep: str = "\n") -> Column:
    """Values of a group in the order of an index. An aggregate; bounded by the size of one notebook."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), value.alias("v")))), lambda s: s["v"]), sep)


def bullet_count(c: Column) -> Column:
    """Bullets and numbered items of a markdown text."""
    return F.regexp_count(text(c), F.lit(r"(?mU)^\s*(?:[-*+•]|\d+[.)])\s+\S")).cast("int")


def clip(c: Column, limit: int = 700) -> Column:
    """P20: at most ``limit`` characters, with a note of the whole length."""
    t = F.rtrim(text(c))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit), F.lit("\n… (clipped, "), F.length(t).cast("string"), F.lit(" characters)")))


def without_ansi(c: Column) -> Column:
    return F.regexp_replace(text(c), "\u001b\\[[0-9;]*m", "")


def estimate_tokens(c: Column) -> Column:
    """A third of the characters."""
    return F.floor(F.length(text(c)) / 3).cast("long")


# -- people


def norm_person_name(c: Column, alphabet: str = "а-я") -> Column:
    """Lower case, one alphabet, letters with spaces and hyphens only."""
    low = F.translate(F.lower(F.trim(text(c))), "ё", "е")
    low = F.translate(low, LATIN, CYRILLIC) if alphabet == "а-я" else low
    return F.trim(F.regexp_replace(F.regexp_replace(low, rf"[^{alphabet}\s-]", " "), r"\s+", " "))


def letters_only(c: Column, alphabet: str = "а-яa-z") -> Column:
    """P09b."""
    return F.regexp_replace(F.translate(F.lower(text(c)), "ё", "е"), rf"[^{alphabet}]", "")


def simple_name(c: Column) -> Column:
    """P09c."""
    return squash_ws(F.lower(text(c)))


def name_tokens(c: Column, alphabet: str = "а-я") -> Column:
    """P10: tokens of more than one character, in order."""
    return F.filter(F.split(norm_person_name(c, alphabet), " "), lambda t: F.length(t) > 1)


def name_word_set(c: Column, alphabet: str = "а-я") -> Column:
    return F.array_sort(F.array_distinct(name_tokens(c, alphabet)))


def clean_username(c: Column) -> Column:
    """A handle from a free field, '' if there is none."""
    link = r"(?i)(?:https?://)?(?:t|telegram)\.me/(?:s/)?([A-Za-z0-9_]+)"
    raw = F.trim(text(c))
    raw = F.when(raw.rlike(link), F.regexp_extract(raw, link, 1)).otherwise(raw)
    raw = F.trim(F.trim(F.ltrim(raw, F.lit("@"))), F.lit(".,;"))
    raw = F.regexp_extract(raw, r"^\s*(\S+)", 1)
    ok = r"^[A-Za-z0-9_]{4,32}$"
    latin = F.translate(raw, CYRILLIC + CYRILLIC_CAPS, LATIN + LATIN_CAPS)
    return F.when(raw.rlike(ok), raw).when(latin.rlike(ok), latin).otherwise("")


def given_name_keys(c: Column, both: bool) -> Column:
    """Keys that two given names share if ``confirms_given_name`` holds; ``both`` adds the full forms of short names."""
    table = F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv])
    keys = [F.concat(F.lit("="), c), F.when(F.length(c) >= 4, F.concat(F.lit("^"), F.substring(c, 1, 4)))]
    return F.array_compact(F.array(*keys, F.concat(F.lit("="), F.element_at(table, c)))) if both else F.array_compact(F.array(*keys))


def confirms_given_name(a: Column, b: Column) -> Column:
    """Exact, diminutive or ''."""
    table = F.create_map(*[F.lit(x) for kv in SHORT_NAMES.items() for x in kv])
    short = F.coalesce(F.element_at(table, b) == a, F.lit(False)) | F.coalesce(F.element_at(table, a) == b, F.lit(False))
    starts = ((F.length(b) >= 4) & F.startswith(a, b)) | ((F.length(a) >= 4) & F.startswith(b, a))
    return F.when(a == b, "exact").when(short | starts, "diminutive").otherwise("")


def validate_fio(c: Column) -> Column:
    """An error code, or null for a valid value."""
    t = squash_ws(c)
    return F.when(F.length(t) > 120, "too_long").when(~t.rlike(r"(?U)^[\p{L}'’.-]+(?: [\p{L}'’.-]+)+$"), "not_a_name")


def validate_email(c: Column) -> Column:
    return F.when(~F.trim(text(c)).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "not_an_email")


def validate_free(c: Column, limit: int = 1000) -> Column:
    return F.when(F.length(F.trim(text(c))) > limit, "too_long")


# -- paths, slugs and hashes


def path_key(c: Column) -> Column:
    """A path in lower case without the notebook suffix, its words joined by underscores; folders stay apart."""
    return name_hint(F.regexp_replace(F.lower(text(c)), r"\.ipynb$", ""))


def squash_ends(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def name_hint(c: Column) -> Column:
    """A name or hint to compare: lower case, spaces, hyphens and dots as underscores; slashes stay."""
    return F.regexp_replace(F.lower(c), r"[\s\-.]+", "_")


def folder_topic(c: Column) -> Column:
    """hwNN from a directory name, null if there is none."""
    n = F.regexp_extract(F.lower(text(c)), r"(?:^|/)hw[_\s-]?0?(\d{1,2})[^/]*/", 1)
    return F.when(n != "", F.concat(F.lit("hw"), F.lpad(n, 2, "0")))


def slugify(c: Column) -> Column:
    """P29."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"(?U)[^\w\s-]", ""), r"(?U)[\s_-]+", "_"), F.lit("_"))


def topic_folder(hw: Column, title: Column) -> Column:
    return F.concat_ws("_", hw, slugify(title))


def content_hash(c: Column) -> Column:
    """P18."""
    return F.sha1(c.cast("binary"))


# -- sets of tokens


def regex_tokens(c: Column) -> Column:
    """P14 for text: words (kept or V) and single marks."""
    words = F.regexp_extract_all(text(c), F.lit(r"(?U)(\w+|\S)"), F.lit(1))
    return F.transform(words, lambda w: F.when(w.isin(*KEEP_TOKENS), w).otherwise("V"))


def plain_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(text(c)), r"\s+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, although ``body`` names it several times or in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(tokens: Column, n: int) -> Column:
    """The set of windows of ``n`` tokens."""

    def windows(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))
        return F.when(F.size(t) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(tokens, windows)


def shingle_hashes(tokens: Column, n: int) -> Column:
    """P15 as 64-bit hashes of the windows, made without their texts."""

    def windows(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.xxhash64(F.slice(t, i, F.lit(n))))
        return F.when(F.size(t) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))

    return let(tokens, windows)


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprint(bodies: Column, least: int = 120) -> Column:
    """Hash of the sorted bodies of an array, null below ``least`` characters."""
    blob = F.array_join(F.array_sort(bodies), "\n")
    return F.when((F.size(bodies) > 0) & (F.length(blob) >= least), F.sha2(blob, 256))


# -- verdicts


def required_for(ratio: Column, total: Column) -> Column:
    """Topics needed, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(ratio * total)).cast("long")


def points_needed(ratio: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.ceil(ratio * total - 1e-9)).cast("long")


def verdict(has_critical: Column, passed: Column, total: Column, ratio: float = PASS_RATIO) -> Column:
    """No critical finding and enough required items; nothing required counts as all of them."""
    share = F.when(total == 0, 1.0).otherwise(passed / total)
    return F.when(~has_critical & (share >= ratio), "passed").otherwise("failed")


def place_bucket(pct: Column) -> Column:
    """P24."""
    return F.when(pct >= 90, "top10").when(pct >= 75, "top25").when(pct >= 50, "upper_half").otherwise("below")


def severity_rank(c: Column) -> Column:
    """P25."""
    return F.when(c == "critical", 0).when(c == "major", 1).when(c == "minor", 2).otherwise(3)


def severity_weight(c: Column) -> Column:
    return F.when(c == "critical", 3).when(c == "major", 2).otherwise(1)


# -- labels, payloads, dates


def label_of(value: Column, labels: Column) -> Column:
    """Label of one code, unknown codes kept, empty as a dash."""
    return F.when(text(value) == "", "—").otherwise(F.coalesce(labels[value], value))


def labels_of(values: Column, labels: Column) -> Column:
    """Labels of an array of codes, joined."""
    return F.when(F.size(values) <= 0, "—").otherwise(F.array_join(F.transform(values, lambda v: F.coalesce(labels[v], v)), "; "))


def json_answers(c: Column) -> Column:
    """P27."""
    return F.from_json(c, "map<string,string>")


def payload_code(c: Column, path: str = "$.code") -> Column:
    return F.coalesce(F.get_json_object(c, path), c)


def parse_deadline(line: Column, now: Column) -> Column:
    """A deadline line with day.month and perhaps hours, local at UTC+3, as a UTC timestamp; null if invalid.

    A month earlier than the current one means the next year.
    """
    shape = r"(?iU)^\s*срок\s*:\s*(\d{1,2})\.(\d{1,2})(?:\s+(\d{1,2}):(\d{2}))?\s*$"
    part = lambda n: F.nullif(F.regexp_extract(text(line), shape, n), F.lit("")).cast("int")
    local_now = now + F.expr("INTERVAL 3 HOURS")
    year = F.year(local_now) + F.when(part(2) < F.month(local_now), 1).otherwise(0)
    made = F.try_make_timestamp(year, part(2), part(1), F.coalesce(part(3), F.lit(23)), F.coalesce(part(4), F.lit(59)), F.lit(0).cast("decimal(16,6)"))
    return F.when(text(line).rlike(shape), made - F.expr("INTERVAL 3 HOURS"))


def show_deadline(ts: Column) -> Column:
    return F.date_format(ts + F.expr("INTERVAL 3 HOURS"), "dd.MM HH:mm")


def extract_links(body: Column) -> Column:
    """Array of (title, url) of list items."""
    shape = r"(?m)^- \[([^\]]+)\]\(([^)]+)\)"
    title, url = F.regexp_extract_all(text(body), F.lit(shape), F.lit(1)), F.regexp_extract_all(text(body), F.lit(shape), F.lit(2))
    return F.zip_with(title, url, lambda t, u: F.struct(t.alias("title"), u.alias("url")))


def external_links(links: Column) -> Column:
    return F.filter(links, lambda x: x["url"].startswith("http"))


# Fixed value: the heading of the paragraph that says why a finding matters.
WHY = "**Почему это важно.**"


def why_paragraph(body: Column, heading: str = WHY) -> Column:
    """The paragraph under the heading, without it; else the second paragraph; else ''."""
    parts = F.split(text(body), "\n\n")
    found = F.get(F.filter(parts, lambda p: F.startswith(p, F.lit(heading))), F.lit(0))
    return F.when(found.isNotNull(), squash_ends(F.substring(found, len(heading) + 1, 1 << 30))).otherwise(squash_ends(text(F.get(parts, F.lit(1)))))


def earlier_of(a_name: Column, a: Column, b_name: Column, b: Column) -> Column:
    """Who was first; null if a time is missing or they are equal."""
    return F.when(a < b, a_name).when(b < a, b_name)


def why_failed(passed: Column, total: Column, criticals: Column) -> Column:
    """Reasons of a verdict: points where some are required, the first two critical titles (an array), a dash without either."""
    points = F.when(total > 0, F.concat(F.lit("items "), passed.cast("string"), F.lit("/"), total.cast("string")))
    worst = F.when(F.size(criticals) > 0, F.concat(F.lit("critical: "), F.array_join(F.slice(criticals, 1, 2), "; ")))
    return F.coalesce(F.nullif(F.concat_ws(", ", points, worst), F.lit("")), F.lit("—"))


def blockers(passed: Column, total: Column, criticals: Column, ratio: float = PASS_RATIO) -> Column:
    """Array of (kind, what): too few points, then every critical finding."""
    short = F.struct(F.lit("points").alias("kind"), F.concat(passed.cast("string"), F.lit("/"), points_needed(F.lit(ratio), total).cast("string")).alias("what"))
    few = F.when(passed < points_needed(F.lit(ratio), total), F.array(short)).otherwise(F.array().cast("array<struct<kind:string,what:string>>"))
    return F.concat(few, F.transform(criticals, lambda t: F.struct(F.lit("critical").alias("kind"), t.alias("what"))))


# -- portraits


def _allowed(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def sanitize_portrait(p: Column, urls: Sequence[str], topics: Sequence[str], codes: Sequence[str]) -> Column:
    """Null without the required fields; unknown topics, links and codes dropped; lengths and counts limited."""
    links = lambda g: F.slice(F.filter(g["links"], lambda x: F.array_contains(_allowed(urls), x["url"])), 1, 3)
    good_codes = lambda g: F.filter(g["codes"], lambda c: F.array_contains(_allowed(codes), c) | c.endswith(".other"))
    grown = F.transform(
        F.filter(p["growth"], lambda g: g.isNotNull() & F.array_contains(_allowed(topics), g["topic"])),
        lambda g: F.struct(g["topic"].alias("topic"), F.substring(g["title"], 1, 120).alias("title"), F.substring(g["why"], 1, 500).alias("why"), good_codes(g).alias("codes"), links(g).alias("links")),
    )
    return F.when(
        p["portrait"].isNotNull() & p["growth"].isNotNull() & p["next_steps"].isNotNull(),
        F.struct(F.substring(p["portrait"], 1, 1200).alias("portrait"), F.slice(grown, 1, 5).alias("growth"), F.substring(p["next_steps"], 1, 600).alias("next_steps")),
    )


def validate_portrait(p: Column, urls: Sequence[str], topics: Sequence[str], codes: Sequence[str]) -> Column:
    """Complaints as an array of strings."""
    top = F.array_compact(F.array(
        F.when(p["portrait"].isNull(), "portrait missing"), F.when(F.length(p["portrait"]) > 1200, "portrait too long"),
        F.when(p["next_steps"].isNull(), "next_steps missing"), F.when(F.length(p["next_steps"]) > 600, "next_steps too long"),
        F.when(p["growth"].isNull(), "growth missing"), F.when(F.size(p["growth"]) > 5, "too many growth items"),
    ))
    bad = lambda ok, say, v: F.when(~ok, F.concat(F.lit(say + " "), text(v)))
    each = F.flatten(F.transform(F.coalesce(p["growth"], F.array().cast("array<struct<topic:string,title:string,why:string,codes:array<string>,links:array<struct<title:string,url:string>>>>")), lambda g: F.array_compact(F.concat(
        F.array(bad(F.array_contains(_allowed(topics), g["topic"]), "unknown topic", g["topic"])),
        F.transform(g["links"], lambda x: bad(F.array_contains(_allowed(urls), x["url"]), "foreign link", x["url"])),
        F.transform(g["codes"], lambda c: bad(F.array_contains(_allowed(codes), c) | c.endswith(".other"), "unknown code", c)),
    ))))
    return F.concat(top, each)


def parse_homework_post(post: Column, now: Column) -> Column:
    """struct(title, body, deadline) of a post."""
    lines = F.split(F.regexp_replace(text(post), r"\s+$", ""), "\n")
    deadline = parse_deadline(F.element_at(lines, -1), now)
    n = F.size(lines) - F.when(deadline.isNotNull(), 1).otherwise(0)
    return F.struct(F.element_at(lines, 1).alias("title"), F.trim(F.array_join(F.slice(lines, F.lit(2), F.greatest(n - 1, F.lit(0))), "\n"), F.lit("\n ")).alias("body"), deadline.alias("deadline"))
