"""Vector search, exact and near deduplication, sharding, mixing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gradeloom.llm import ann, chosen_path, common, exact_dedup, mixing, queries, sharding

SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, digest string")


ODD = [(1, None, "a"), (2, "", "a"), (3, "Same TEXT", "b"), (4, "same text", "b"), (4, "same text", "b"), (None, "no id", None), (5, "x " * 40_000, "c"), (6, "É", "c"), (7, "é", ""), (8, "one", "c")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


# -- vector search


def test_recall_and_order(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("id") % 20 == 0).collect()
    want = ann.brute_force(rows, {i for i, _ in rows if i % 20 == 0})
    pairs = {(q, i) for q, _, i in want}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & pairs) / len(pairs) >= 0.9
    x = {i: np.array(v, float) for i, v in rows}
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-12)
        by[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) and len(v) == 20 for v in by.values())


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 1), (20, 2, 2), (20, 3, 0)]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.normal(size=5), rng.normal(size=6), rng.integers(0, 4, (5, 6))
    order = ann.traverse(a, b, sizes, float("inf"))
    assert order == sorted(((i, j) for i in range(5) for j in range(6) if sizes[i, j]), key=lambda c: a[c[0]] + b[c[1]])


def test_blocks_of_hot_cells_and_repeated_ids(spark, monkeypatch):
    """Thousands of equal vectors fill several blocks; ids that repeat with other vectors count once."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    rows = [(i, (hot if i % 3 == 0 else rng.normal(size=8)).tolist()) for i in range(900)] + [(7, hot.tolist())] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(df, F.col("id") % 20 == 0, recall=1.0).collect()}
    want = ann.brute_force(rows, {i for i, _ in rows if i % 20 == 0})
    assert len(got & want) / len(want) > 0.97 and len(got) == len(want)


def test_layout_holds_every_centroid_once(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    first, many, blocks = ann._layout(np.array([[3], [4], [2], [35], [0], [9], [5]]))
    assert (first, many, blocks) == ([0, 0, 0, 1, 5, 5, 6], [1, 1, 1, 4, 1, 1, 1], 7)


# -- exact dedup


def landed(spark, rows, tmp_path, files=3):
    path = f"file://{tmp_path}/docs"
    docs_of(spark, rows).repartition(files).write.parquet(path)
    return path


def test_state_over_several_batches_and_odd_rows(spark, tmp_path):
    got = exact_dedup.dedup(spark, landed(spark, ODD, tmp_path), files_per_batch=1).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for r in got:
        groups[r["keep"]["id"]].append((r["id"], r["group_size"], r["kept"]))
    assert sorted(groups[2], key=str) == [(1, 2, False), (2, 2, True)]
    assert sorted((i, n) for i, n, _ in groups[4]) == [(3, 3), (4, 3), (4, 3)] and sum(k for *_, k in groups[4]) == 1
    assert groups[None] == [(None, 1, True)] and groups[6] == [(6, 1, True)] and groups[7] == [(7, 1, True)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables_come_in_four_batches_at_least(spark, tmp_path, sf):
    run = common.Run(spark, "batches")
    path = exact_dedup._in_files(spark, run, f"/root/testdata/{sf}/documents.parquet")
    states = exact_dedup.group_states(spark, path, folder=f"file://{tmp_path}/stream")
    batches = spark.read.parquet(f"file://{tmp_path}/stream/batches").groupBy("batch").count().collect()
    assert len(batches) >= 4
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert states.agg(F.sum("group_size")).first()[0] == docs.count()
    # states that an earlier batch left were hit: some digest is in several batches
    again = spark.read.parquet(f"file://{tmp_path}/stream/batches").groupBy("digest").agg(F.countDistinct("batch").alias("n"))
    assert again.filter("n > 1").count() > 0
    run.clear()


def test_colliding_digests_do_not_merge_texts(spark, tmp_path):
    rows = [(i, f"text {i % 5}", "s") for i in range(40)]
    got = exact_dedup.dedup(spark, landed(spark, rows, tmp_path), digest=lambda t: F.lit("same")).collect()
    assert {r["id"] for r in got if r["kept"]} == {35, 36, 37, 38, 39} and all(r["group_size"] == 8 and r["keep"]["id"] % 5 == r["id"] % 5 for r in got)


def test_stage_with_colliding_digests_reads_a_table_in_place(spark, tmp_path):
    rows = [(i, f"text {i % 5}", "s") for i in range(40)]
    path = landed(spark, rows, tmp_path)
    table = spark.read.parquet(path)
    for spelt in (path, path + "/", f"{tmp_path}/docs", f"{tmp_path}/docs/"):
        assert common.folder_of(spark.read.parquet(spelt)).endswith(f"{tmp_path}/docs")
    for docs in (table.filter("doc_id > 3"), table.limit(4), table.select("text"), docs_of(spark, rows), table.unionAll(table), spark.read.json(table.toJSON())):
        assert common.folder_of(docs) is None
    for docs in (table, docs_of(spark, rows)):
        for digest in (exact_dedup.sha256, lambda t: F.lit("same")):
            got = exact_dedup.deduplicated(spark, docs, digest)
            assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [35, 36, 37, 38, 39]


def test_empty_table(spark, tmp_path):
    assert exact_dedup.dedup(spark, landed(spark, ODD, tmp_path / "e", 1).replace("/e/", "/e/")).count() == len(ODD)
    docs_of(spark, ODD).limit(0).write.parquet(f"file://{tmp_path}/none")
    assert exact_dedup.dedup(spark, f"file://{tmp_path}/none").count() == 0


# -- near dedup


def test_components_equal_brute_force(spark):
    got = {r["doc_id"]: r["component_id"] for r in chosen_path.op6_near_duplicates(spark, SF).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == chosen_path.brute_force(texts)


def near_group(n, words=150, edits=12, seed=0):
    """Texts that differ from one source in a few words each, so that many pairs are just below the threshold."""
    rng = np.random.default_rng(seed)
    source = [f"w{rng.integers(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(source)
        for p in rng.choice(words, rng.integers(1, edits), replace=False):
            t[p] = f"e{rng.integers(100_000)}"
        out.append(" ".join(t))
    return out


def test_dense_groups_and_popular_shingles(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "NODE_ROWS", 16)
    monkeypatch.setattr(chosen_path, "DENSE_ROWS", 24)
    rng = np.random.default_rng(3)
    texts = near_group(120) + [f"the very common start {i} " + " ".join(f"r{rng.integers(10**6)}" for _ in range(6)) for i in range(80)] + near_group(30, seed=5)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    got = {r["id"]: r["first"]["id"] for r in chosen_path.near_duplicates(docs_of(spark, rows), width=2).collect()}
    assert got == chosen_path.brute_force([(i, t) for i, t, _ in rows])


def test_matrix_counts_equal_pairwise():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    want = {(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 40 * len(np.union1d(sets[i], sets[j]))}
    assert set(chosen_path._similar(sets, 40)) == want and want


def test_near_odd_rows(spark):
    got = {(r["id"], r["n"]): r["first"]["id"] for r in chosen_path.near_duplicates(docs_of(spark, ODD), width=2).collect()}
    assert got == {(1, 0): 1, (2, 0): 2, (3, 1): 3, (4, 1): 3, (None, 1): None, (5, 1): 5, (6, 1): 6, (7, 1): 7, (8, 1): 8}
    assert chosen_path.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0
    stage = chosen_path.near_dedup_stage(spark, docs_of(spark, ODD), "")
    assert sorted(r["doc_id"] or 0 for r in stage.collect()) == [0, 1, 2, 3, 5, 6, 7, 8] and stage.columns == docs_of(spark, ODD).columns


# -- sharding


def check_shards(rows, texts, n):
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        t = texts[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert set(slots) <= set(range(n)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size


def test_shards_are_near_equal(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = sharding.op9_sharding(spark, SF).collect()
    size = check_shards(rows, texts, 8)
    most = max(r["size"] for r in rows)
    assert len(rows) == 1000 and max(size.values()) - min(size.values()) <= 2 * most
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.op9_sharding(spark, SF).collect()))


def test_one_hot_text_is_divided(spark):
    rows = [(i, "hot" * 10 if i % 3 else f"cold {i} " * 3, "s") for i in range(600)] + [(None, None, "s"), (1, "hot" * 10, "s")]
    got = sharding.assign(docs_of(spark, rows), 4).collect()
    size = check_shards(got, {i: t for i, t, _ in rows}, 4)
    assert len(got) == 602 and max(size.values()) - min(size.values()) < 100
    assert sharding.assign(docs_of(spark, rows).limit(0), 4).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, f"text {i}", "s") for i in range(100)]
    sharding.write_shards(docs_of(spark, rows), f"file://{tmp_path}/out", 4)
    assert spark.read.parquet(f"file://{tmp_path}/out").select("shard").distinct().count() == 4


def test_written_shards_hold_odd_rows_and_all_columns(spark, tmp_path):
    rows = [*ODD, *[(None, "no id", None)] * 3, *[(4, "same text", "b")] * 5]
    docs = docs_of(spark, rows).withColumns({"shard": F.lit("mine"), "slot": F.lit(7), "_place": F.lit(1), "_locator": F.lit("here")})
    for n, given in enumerate((docs, docs.limit(0))):
        path = f"file://{tmp_path}/{n}"
        sharding.write_shards(given, path, 3)
        got = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, slot_ int, shard_ int").parquet(path)
        count = lambda df: Counter(map(tuple, df.select(*docs.columns).collect()))
        assert count(got) == count(given)
    slots = defaultdict(list)
    for r in spark.read.parquet(f"file://{tmp_path}/0").select("shard_", "slot_").collect():
        slots[r["shard_"]].append(r["slot_"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


# -- mixing


def plain_targets(sizes, cap=3):
    """Share by weight, cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: cap * sizes[s] for s in capped} | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_bounds(spark):
    rows = [(i, "w " * (1 + i % 7), ["a", "b", None, "c"][min(3, i // (1 if i < 3 else 20) % 5)]) for i in range(200)] + [(900, "w " * 3, "d"), (901, None, "e"), (902, "", "e")]
    out = mixing.mix(docs_of(spark, rows), "doc_id", "source").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 4 for s in sizes)
    again = mixing.mix(docs_of(spark, rows).repartition(7), "doc_id", "source").collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_unequal_odds_favour_heavier_rows(spark):
    rows = [(i, "w w w", "a" if i < 400 else "b") for i in range(600)]
    df = docs_of(spark, rows).withColumn("score", F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0))
    got = mixing.mix(df, "doc_id", weight_col="score").filter("doc_id < 400").collect()
    even, odd = (sum(r["copies"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1))
    assert even > 2 * odd > 0


def test_mixing_odd_rows(spark):
    assert mixing.mix(docs_of(spark, ODD), "doc_id").count() == len(ODD)
    assert mixing.mix(docs_of(spark, ODD).limit(0), "doc_id").count() == 0
    out = mixing.mixed(docs_of(spark, ODD))
    assert out.columns == docs_of(spark, ODD).columns and out.count() > 0


# -- odd columns and tables in every stage

CLASHES = ["loc", "locator", "copies", "copy", "_copy", "_locator", "_locator_", "quality_score", "_text", "digest", "row", "first", "_metadata", "key.with.dot"]


def test_stages_with_clashing_columns_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(i, t, "en", s, 0, *[f"{c}-{n}" for c in CLASHES]) for n, (i, t, s) in enumerate(ODD)],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES),
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SF).collect()
        assert rows and rows[0].__fields__ == docs.columns, name
        assert set(map(tuple, rows)) <= set(map(tuple, docs.collect())), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    encode = corpus_pipeline.STAGES[-1][1]
    assert encode(spark, docs, SF).count() == len(ODD) and encode(spark, docs.limit(0), SF).count() == 0


def test_very_long_texts_in_every_stage(spark):
    """Several MB without any space, and several MB of words, twice each."""
    rng = np.random.default_rng(8)
    words = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 400_000))
    rows = [(1, "x" * 3_000_000, "a"), (2, "x" * 3_000_000, "a"), (3, words, "b"), (4, words + " end", "b"), (5, "short text of a few words", "b")]
    docs = docs_of(spark, rows)
    assert sorted(r["doc_id"] for r in exact_dedup.exact_dedup_stage(spark, docs, SF).collect()) == [2, 3, 4, 5]
    assert sorted(r["doc_id"] for r in chosen_path.near_dedup_stage(spark, docs, SF).collect()) == [1, 3, 5]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() >= 0, name


def test_large_sets_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "GROUP_SHINGLES", 2_000)
    rows = [(i, t, "s") for i, t in enumerate(near_group(60))]
    group = chosen_path._bounded(list(range(6)), [900, 10, 950, 1000, 20, 990], 80)
    pairs = {frozenset((p[i], p[j])) for p in group for i in range(len(p)) for j in range(i)}
    assert {frozenset(x) for x in [(0, 2), (0, 3), (0, 5), (2, 3), (2, 5), (3, 5)]} <= pairs and max(map(len, group)) < 6
    got = {r["id"]: r["first"]["id"] for r in chosen_path.near_duplicates(docs_of(spark, rows), width=2).collect()}
    assert got == chosen_path.brute_force([(i, t) for i, t, _ in rows])


@pytest.mark.parametrize("most", [3, 500_000])
def test_components_of_paths_and_stars(spark, monkeypatch, most):
    """Long paths and stars in random order, also when a task may keep hardly any links."""
    monkeypatch.setattr(chosen_path, "FOREST_ROWS", most)
    names = [np.random.default_rng(k).bytes(16) for k in range(160)]
    edges = [(names[k], names[k + 1]) for k in range(59)] + [(names[60], names[k]) for k in range(61, 120)]
    links = spark.createDataFrame([(bytearray(min(e)), bytearray(max(e))) for e in edges], "a binary, b binary").repartition(7)
    got = {bytes(r["digest"]): bytes(r["root"]) for r in chosen_path.components(common.Run(spark, "t"), links).collect()}
    want = {n: min(names[:60]) for n in names[:60]} | {n: min(names[60:120]) for n in names[60:120]}
    assert got == {n: r for n, r in want.items() if n != r}


def test_scratch_needs_a_shared_folder_on_clusters(monkeypatch):
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.scratch(Cluster, "x")


def test_odd_paths_of_the_stream():
    assert exact_dedup._pattern("s3a://b/docs/") == "s3a://b/doc[s]" and exact_dedup._pattern("/a[1]/x*") == "/a\\[1\\]/[x]\\*"


# -- pipeline


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").select("doc_id", "n_tokens").collect()
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, docs.select("doc_id", "n_tokens").collect()))


def test_pipeline_stages(spark, tmp_path):
    from gradeloom.llm import sentence_piece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, left = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        left[name] = docs.count()
        if k == 1:
            want = {}
            for r in before.collect():
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
                want[key] = max(want.get(key, -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(want.values())
        if k == 2:
            brute = chosen_path.brute_force([(r["doc_id"], r["text"]) for r in before.collect()], width=5)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(set(brute.values()))
        if k == 3:
            assert {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    m = sentence_piece.model(sentence_piece.default_model())
    assert all(m.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())
    assert 500 < left["quality classifier"] < 1000
