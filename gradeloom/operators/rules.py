"""Rules over notebooks, cells, lines and texts. Findings are (nb, code, severity, detail, cells).

All text rules are one pass: a ``select`` builds an array of findings for each notebook, one ``explode`` unfolds it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import expr as X
from gradeloom.functions.udf import call_args, py_names

# Patterns of the rules.
SEED = r"random_state|np\.random\.seed|default_rng\s*\(\s*\d|set_seed|random\.seed"
STOCHASTIC = (
    r"train_test_split|KFold|ShuffleSplit|cross_val|\.sample\s*\(|np\.random|random\.|RandomForest|GradientBoosting|XGB|LGBM|CatBoost|"
    r"KMeans|DBSCAN|TSNE|umap|SGD|MLP|bootstrap|shuffle\s*="
)
ABS_PATH = r"""read_(?:csv|excel|parquet|json)\s*\(\s*["'](/(?!content/)[^"']+|[A-Za-z]:[\\/][^"']+)["']"""
COLAB_PATH = r"""(read_\w+\s*\(\s*["']/content/[^"']+["'])"""
WARN_OFF = r"""warnings\.filterwarnings\s*\(\s*['"]ignore"""
INJECTION = (
    r"(?iU)(?:игн[оа]рируй|ингорируй|забудь)\s+(?:все\s+)?предыдущие\s+инструкц|ignore\s+(?:all\s+)?(?:previous|prior)\s+instructions|"
    r"disregard\s+(?:all\s+)?(?:previous|prior)\s+instructions"
)
SHOW_NO_CALL = r"(?m)^\s*(?:plt|pyplot|fig)\.show\s*$"
NO_EFFECT = r"""^\s*[\w\]\['"\.]+\.(dropna|drop_duplicates|fillna|drop|rename|replace|sort_values|reset_index|astype|set_index)\s*\([^=]*\)\s*$"""
SECRETS = (
    ("kaggle api", r"\bKGAT_[A-Za-z0-9]{20,}"), ("openai", r"\bsk-[A-Za-z0-9]{32,}"), ("github", r"\bgh[pousr]_[A-Za-z0-9]{36}"),
    ("aws", r"\bAKIA[0-9A-Z]{16}\b"), ("kaggle json", r'"username"\s*:\s*"[^"]+"\s*,\s*"key"\s*:\s*"[a-f0-9]{32}"'),
)
STAT = r"(?:\w*(?:scaler|imputer|pca|normalizer|discretizer|selector|vectorizer|svd|kbins|quantiletransformer|powertransformer))"
STAT_CLASS = (
    r"(?:StandardScaler|MinMaxScaler|RobustScaler|MaxAbsScaler|Normalizer|SimpleImputer|KNNImputer|IterativeImputer|PCA|TruncatedSVD|"
    r"KBinsDiscretizer|QuantileTransformer|PowerTransformer|TfidfVectorizer|CountVectorizer|SelectKBest|SelectFromModel)"
)
TARGET_ENC = r"(?:TargetEncoder|CatBoostEncoder|WOEEncoder|LeaveOneOutEncoder|JamesSteinEncoder|MEstimateEncoder)"
FILLNA_STAT = r"(?i)\.fillna\s*\([^()]*\.\s*(?:mean|median|mode|quantile)\s*\("
FIT_STAT = rf"(?i)\b{STAT}\s*\.\s*fit(?:_transform)?\s*\("
FIT_STAT_INLINE = rf"(?i)\b{STAT_CLASS}\s*\([^()]*\)\s*\.\s*fit(?:_transform)?\s*\("
FIT_TARGET_ENC = rf"(?i)\b{TARGET_ENC}\b(?=.*\.\s*fit)"
FIT_WITH_Y = r"""(?i)\b\w*encoder\s*\.\s*fit(?:_transform)?\s*\([^()]*,\s*[\w\[\]'"\.]*\s*\)"""
SPLIT = r"\b(?:train_test_split|StratifiedShuffleSplit|TimeSeriesSplit)\s*\("
PIPELINE = r"\b(?:make_pipeline|Pipeline)\s*\("
ON_TRAIN = r"(?i)\.\s*fit(?:_transform)?\s*\(\s*[^()]*train"
TRANSDUCTIVE = r"(?i)\b(?:tsne|t_sne|umap|manifold)\w*\s*\."
ON_TEST = r"(?i)\.\s*fit(?:_transform)?\s*\(\s*(?:X_?test|x_?test|test_X|df_test)\b"


@dataclass(frozen=True)
class Rule:
    """A rule on the columns of ``notebook_facts``: severity is null where it does not fire."""

    code: str
    severity: Callable[[], Column]
    detail: Callable[[], Column] = lambda: F.lit("")
    cells: Callable[[], Column] = lambda: F.array().cast("array<int>")

    def column(self) -> Column:
        return F.when(self.severity().isNotNull(), F.struct(F.lit(self.code).alias("code"), self.severity().alias("severity"), self.detail().alias("detail"), self.cells().alias("cells")))


def order_breaks(cells: DataFrame) -> DataFrame:
    """(nb, idx) of code cells whose execution number is not above the one before."""
    w = Window.partitionBy("nb").orderBy("idx")
    run = cells.filter((F.col("kind") == "code") & F.col("ec").isNotNull())
    return run.withColumn("prev", F.lag("ec", 1, 0).over(w)).filter("ec <= prev").select("nb", "idx")


def notebook_measures(cells: DataFrame) -> DataFrame:
    """F02, F08 and W03 as measures of each notebook."""
    breaks = order_breaks(cells).groupBy("nb").agg(F.count("*").alias("order_breaks"))
    code = F.col("kind") == "code"
    rows = cells.groupBy("nb").agg(F.count_if(code).alias("code_cells"), (F.count_if(code & (F.trim("source") != "")) == 0).alias("nothing_done"), (F.coalesce(F.sum(F.when(F.col("kind") == "markdown", F.length("source"))), F.lit(0)) < 200).alias("no_conclusions"))
    return rows.join(breaks, "nb", "left").withColumn("order_breaks", F.coalesce("order_breaks", F.lit(0)))


def template_prose(handouts: DataFrame) -> DataFrame:
    """(hw, body): squashed prose of the handouts (hw, kind, source)."""
    return handouts.filter("kind = 'markdown'").select("hw", X.squash_ws(F.col("source")).alias("body")).filter("body <> ''").distinct()


def template_lines(handouts: DataFrame) -> DataFrame:
    """(hw, norm_line): code lines of the handouts (hw, kind, source) without comments and white space."""
    lines = handouts.filter("kind = 'code'").select("hw", F.explode(F.split("source", "\r?\n")).alias("line"))
    return lines.select("hw", X.norm_code_line(F.col("line")).alias("norm_line")).filter("norm_line <> ''").distinct()


def _by_topic(rows: DataFrame, template: DataFrame) -> list[str]:
    """Columns that bind a template to rows: the topic where both have it."""
    return ["hw"] if "hw" in rows.columns and "hw" in template.columns else []


def notebook_facts(cells: DataFrame, template_md: DataFrame | None = None) -> DataFrame:
    """One row for each notebook: texts and counts that the rules read.

    ``cells``: nb, idx, kind, source, ec, errors (array of strings). ``template_md``: squashed prose of the handout
    (body), of each topic if it and the cells have ``hw``.
    """
    code = F.col("kind") == "code"
    c = cells.withColumn("empty", X.is_empty_cell(F.col("source"))).withColumn("mark", X.has_marker(F.col("source")))
    if template_md is not None:
        on = _by_topic(c, template_md)
        c = c.withColumn("_md", X.squash_ws(F.col("source"))).join(F.broadcast(template_md.select(*on, F.col("body").alias("_md"), F.lit(True).alias("_theirs")).distinct()), [*on, "_md"], "left")
    else:
        c = c.withColumn("_theirs", F.lit(None).cast("boolean"))
    idx = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("idx").cast("int"))))
    w = Window.partitionBy("nb").orderBy("idx")
    ran = code & F.col("ec").isNotNull()
    prev = F.coalesce(F.last(F.when(ran, F.col("ec")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("brk", ran & (F.col("ec") <= prev))
    text_of = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("idx", "source")))), lambda s: s["source"]), "\n")
    return c.groupBy("nb").agg(
        text_of(code).alias("src"), text_of(F.col("kind") == "markdown").alias("md"), text_of((F.col("kind") == "markdown") & F.col("_theirs").isNull()).alias("own_md"),
        F.count_if(code).alias("n_code"), F.count_if(code & ~F.col("empty")).alias("n_full"), F.count_if(ran & ~F.col("empty")).alias("n_run"),
        idx(code & F.col("empty") & F.col("mark")).alias("blank"), idx(code & ~F.col("empty") & F.col("ec").isNull()).alias("not_run"), idx(F.col("brk")).alias("breaks"),
        idx(code & F.regexp_replace("source", "\r", "").rlike(SHOW_NO_CALL)).alias("shown"),
        idx(code & F.col("empty") & (F.regexp_count("source", F.lit("(?iU)[а-яё]")) >= 20)).alias("prose_cells"), F.array_distinct(F.flatten(F.collect_list("errors"))).alias("errors"),
        F.max(F.col("_theirs").isNotNull()).alias("has_template"),
    )


def _when(cond: Column, severity: str) -> Callable[[], Column]:
    return lambda: F.when(cond, severity)


def _share(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(0.0)


def _split_args(src: Column) -> Column:
    """Arguments of the splits: by a pattern down to three levels of brackets; only other notebooks go to Python."""
    inner = r"[^()]*+"
    for _ in range(3):
        inner = rf"[^()]*+(?:\({inner}\)[^()]*+)*+"
    native = F.regexp_extract_all(src, F.lit(rf"train_test_split\s*\(({inner})\)"), F.lit(1))
    whole = F.size(native) == F.regexp_count(src, F.lit(r"train_test_split\s*\("))
    return F.when(whole, native).otherwise(call_args(F.when(~whole, src), "train_test_split"))


def base_rules() -> list[Rule]:
    """F03 to F18 without those that need lines; the earlier ones short-circuit nothing, see ``run_rules``."""
    col = F.col
    text_both = F.concat_ws("\n", "src", "md")
    secret = F.array_sort(F.array_compact(F.array(*[F.when(col("src").rlike(p), k) for k, p in SECRETS])))
    abs_, colab = col("src").rlike(ABS_PATH), col("src").rlike(COLAB_PATH)
    blank, lost = F.size("blank"), F.size("not_run")
    return [
        Rule("common.blank_template_cells", lambda: F.when(blank > 0, F.when(_share(blank, col("n_code")) >= 0.3, "critical").otherwise("major")), cells=lambda: col("blank")),
        Rule("common.not_executed", _when((col("n_full") > 0) & (col("n_run") == 0), "critical")),
        Rule("common.partially_executed", lambda: F.when((col("n_run") > 0) & (lost > 0), F.when(_share(lost, col("n_full")) >= 0.5, "critical").otherwise("major")), cells=lambda: col("not_run")),
        Rule("common.error_output", _when(F.size("errors") > 0, "critical"), lambda: F.substring(F.array_join("errors", "; "), 1, 300)),
        Rule("common.execution_out_of_order", _when((F.size("breaks") > 0) & (col("n_run") > 0), "major"), cells=lambda: col("breaks")),
        Rule("common.no_conclusions", _when(F.length("md") < 200, "major")),
        Rule("common.no_own_conclusions", _when((F.length("md") >= 200) & col("has_template") & (F.length("own_md") < 200), "major")),
        Rule("common.no_seed", _when(col("src").rlike(STOCHASTIC) & ~col("src").rlike(SEED), "minor")),
        Rule("common.conclusions_in_code_comments", _when(F.size("prose_cells") > 0, "major"), cells=lambda: col("prose_cells")),
        Rule("common.absolute_path", lambda: F.when(abs_, "major").when(colab, "minor"), lambda: F.substring(F.when(abs_, F.regexp_extract("src", ABS_PATH, 0)).otherwise(F.regexp_extract("src", COLAB_PATH, 0)), 1, 90)),
        Rule("common.prompt_injection_attempt", _when(text_both.rlike(INJECTION), "critical")),
        Rule("common.secret_in_repo", _when(F.size(secret) > 0, "critical"), lambda: F.array_join(secret, ", ")),
        Rule("common.show_without_call", _when(F.size("shown") > 0, "major"), cells=lambda: col("shown")),
        Rule("common.warnings_suppressed", _when(col("src").rlike(WARN_OFF), "minor")),
        Rule("common.split_without_seed", _when(F.exists(_split_args(col("src")), lambda a: ~F.contains(a, F.lit("random_state"))), "major")),
    ]


def register_rule(code: str, severity: str, predicate: Column) -> Rule:
    """A rule of the user's own: a predicate over the columns of ``notebook_facts``."""
    return Rule(code, lambda: F.when(predicate, severity))


def run_rules(facts: DataFrame, broken: DataFrame | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """(nb, code, severity, detail, cells). A broken notebook or one with nothing done has only that finding."""
    only = F.array(F.struct(F.lit("common.nothing_done").alias("code"), F.lit("critical").alias("severity"), F.lit("").alias("detail"), F.array().cast("array<int>").alias("cells")))
    found = F.array_compact(F.array(*[r.column() for r in (rules if rules is not None else base_rules())]))
    out = facts.select("nb", F.explode(F.when(F.col("n_full") == 0, only).otherwise(found)).alias("f")).select("nb", "f.*")
    if broken is not None:
        bad = broken.select("nb", F.lit("common.notebook_unreadable").alias("code"), F.lit("critical").alias("severity"), F.col("error").alias("detail"), F.array().cast("array<int>").alias("cells"))
        out = out.unionByName(bad)
    return out


def code_lines(cells: DataFrame) -> DataFrame:
    """(nb, pos, idx, line): non-empty lines of code up to their comment, in cell order; pos orders them."""
    topic = [c for c in cells.columns if c == "hw"]
    lines = cells.filter(F.col("kind") == "code").select("nb", *topic, "idx", F.posexplode(F.split("source", "\r?\n")).alias("no", "raw"))
    line = F.substring_index("raw", "#", 1)
    return lines.select("nb", *topic, F.struct("idx", "no").alias("pos"), "idx", "raw", line.alias("line")).filter(F.trim("line") != "")


def is_statistical_fit(line: Column) -> Column:
    fit = F.replace(line, F.lit(" ")).contains(".fit") & (line.rlike(FIT_TARGET_ENC) | line.rlike(FIT_WITH_Y) | line.rlike(FIT_STAT) | line.rlike(FIT_STAT_INLINE))
    return line.rlike(FILLNA_STAT) | fit


def leakage(cells: DataFrame, template: DataFrame | None = None, exempt: tuple[str, ...] = (), exempt_words: DataFrame | None = None) -> DataFrame:
    """Fits before the split (without a pipeline) and on the test part.

    Lines that fit on the training part, transductive methods, exempt words and handout lines (``template``:
    norm_line, of each topic if it and the cells have ``hw``) are skipped. ``exempt_words``: (hw, word) of each topic.
    """
    rows = code_lines(cells)
    if template is not None:
        on = _by_topic(rows, template)
        rows = rows.withColumn("_n", X.norm_code_line(F.col("line"))).join(F.broadcast(template.select(*on, F.col("norm_line").alias("_n"), F.lit(True).alias("_t")).distinct()), [*on, "_n"], "left")
    else:
        rows = rows.withColumn("_t", F.lit(None).cast("boolean"))
    line, low = F.col("line"), F.lower("line")
    skip = line.rlike(ON_TRAIN) | line.rlike(TRANSDUCTIVE) | F.col("_t").isNotNull()
    for word in exempt:
        skip = skip | low.contains(word)
    if exempt_words is not None:
        rows = rows.join(F.broadcast(exempt_words.groupBy("hw").agg(F.collect_set("word").alias("_words"))), "hw", "left")
        skip = skip | F.coalesce(F.exists("_words", lambda x: F.contains(low, x)), F.lit(False))
    w = Window.partitionBy("nb")
    rows = rows.withColumn("split_at", F.min(F.when(line.rlike(SPLIT), F.col("pos"))).over(w)).withColumn("piped", F.max(line.rlike(PIPELINE)).over(w))
    fits = rows.filter(is_statistical_fit(line) & ~skip)
    early = (F.col("pos") < F.col("split_at")) & ~F.col("piped")
    kinds = F.array_compact(F.array(F.when(early, "common.fit_before_split"), F.when(line.rlike(ON_TEST), "common.fit_on_test")))
    found = fits.select("nb", "pos", "idx", F.trim("line").alias("line"), F.explode(kinds).alias("code")).groupBy("nb", "code").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("pos", "line"))), 1, 3).alias("l"), F.array_sort(F.collect_set(F.col("idx").cast("int"))).alias("cells")
    )
    return found.select("nb", "code", F.when(F.col("code") == "common.fit_on_test", "critical").otherwise("major").alias("severity"), F.array_join(F.transform("l", lambda x: F.substring(x["line"], 1, 90)), "; ").alias("detail"), "cells")


def no_effect_calls(cells: DataFrame) -> DataFrame:
    """calls whose result is dropped; the first three lines."""
    rows = code_lines(cells).filter(F.col("line").rlike(NO_EFFECT) & ~F.col("raw").contains("inplace"))
    found = rows.groupBy("nb").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", X.squash_ends(F.col("raw")).alias("line")))), 1, 3).alias("l"), F.array_sort(F.collect_set(F.col("idx").cast("int"))).alias("cells"))
    return found.select("nb", F.lit("common.no_effect_call").alias("code"), F.lit("major").alias("severity"), F.substring(F.array_join(F.transform("l", lambda x: x["line"]), "; "), 1, 200).alias("detail"), "cells")


def undefined_names(cells: DataFrame, builtins: tuple[str, ...] | None = None) -> DataFrame:
    """names used and never defined; silent for notebooks in which some cell can't be analysed."""
    import builtins as b

    known = builtins or (*dir(b), "__file__", "__name__", "display", "get_ipython", "In", "Out", "exit", "quit")
    names = cells.filter(F.col("kind") == "code").select("nb", py_names(F.col("source")).alias("n"))
    per = names.groupBy("nb").agg(F.array_distinct(F.flatten(F.collect_list("n.defined"))).alias("defined"), F.array_distinct(F.flatten(F.collect_list("n.used"))).alias("used"), F.max("n.bail").alias("bail"))
    left = F.filter(F.array_sort(F.array_except(F.array_except("used", "defined"), F.array(*map(F.lit, known)))), lambda x: ~x.startswith("_"))
    out = per.filter(~F.col("bail")).withColumn("left", left).filter(F.size("left") > 0)
    return out.select("nb", F.lit("common.undefined_name").alias("code"), F.lit("critical").alias("severity"), F.array_join(F.slice("left", 1, 6), ", ").alias("detail"), F.array().cast("array<int>").alias("cells"))


def rubric_checks(facts: DataFrame, checks: DataFrame) -> DataFrame:
    """(nb, check_id, passed) for checks (check_id, any_regex[], all_regex[], none_regex[], bullets_min), a dimension.

    Where facts and checks have the topic ``hw``, a notebook meets its topic's checks only. A minimum of bullets decides
    alone; otherwise any, all and none of the patterns over code and prose.
    """
    facts, on = facts.withColumn("_t", F.concat_ws("\n", "src", "md")), _by_topic(facts, checks)
    rows = facts.join(F.broadcast(checks), on) if on else facts.crossJoin(F.broadcast(checks))
    hit = lambda p: F.regexp(F.col("_t"), F.concat(F.lit("(?iUm)"), p))
    patterns = ((F.size("any_regex") <= 0) | F.exists("any_regex", hit)) & F.forall("all_regex", hit) & ~F.exists("none_regex", hit)
    return rows.select("nb", *on, "check_id", F.when(F.col("bullets_min").isNotNull(), X.bullet_count(F.col("md")) >= F.col("bullets_min")).otherwise(patterns).alias("passed"))
