"""Queries and operators on inputs on which they were wrong or too slow before."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def put(folder, **frames):
    """The frames as tables of a folder of inputs, each one file."""
    for name, df in frames.items():
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def sql(folder, name):
    """What the query's SQL gives on these tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)


def test_image_cleanup_with_equal_names(spark, tmp_path):
    parts = spark.createDataFrame([(1, "red"), (2, "red"), (3, "blue"), (4, "red")], "p_partkey long, p_name string")
    lines = spark.createDataFrame([(1, "R"), (2, "A"), (3, "R")], "l_partkey long, l_returnflag string")
    d = put(tmp_path, part=parts, lineitem=lines)
    assert rows(entry.queries()["image_cleanup"](spark, d)) == sql(tmp_path, "image_cleanup") == [("red",), ("red",)]


def test_semantic_breaks_of_copies_and_gaps(spark, tmp_path):
    """Similarities of copies tie: what a root more or less leaves decides."""
    rnd = random.Random(3)
    kinds = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    vectors = [(25 * doc + i, kinds[rnd.randrange(6)]) for doc in range(40) for i in range(25)]
    vectors += [(25 * doc + i, kinds[i // 5]) for doc in range(40, 80) for i in range(25) if doc % 3 or i not in (0, 9)]
    vectors += [(25 * 80 + i, [rnd.gauss(0, 1) for _ in range(64)]) for i in range(6)]
    d = put(tmp_path, embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    assert rows(entry.queries()["chunk_semantic_breaks"](spark, d)) == sql(tmp_path, "chunk_semantic_breaks")


def test_path_expand_has_all_targets(spark, tmp_path):
    """60 parts of one supplier and those of its neighbour: more than any first 50."""
    lines = spark.createDataFrame([(50, p) for p in range(60)] + [(51, p) for p in range(59, 140)] + [(52, 139)], "l_suppkey long, l_partkey long")
    d = put(tmp_path, lineitem=lines, supplier=spark.range(50, 53).withColumnRenamed("id", "s_suppkey"), part=spark.range(140).withColumnRenamed("id", "p_partkey"))
    got = rows(entry.queries()["path_expand_3hop"](spark, d))
    assert got == sql(tmp_path, "path_expand_3hop") and sum(r[0] == "s50" for r in got) > 50


def test_bm25_deals_pairs_by_their_number(spark, monkeypatch):
    """Of 50 documents and 20 queries, all of the same two terms, there are 2,000 pairs."""
    from lexiloom.operators import retrieval

    docs = spark.createDataFrame([(i, "a b " + "c " * (i % 7)) for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, "a b") for i in range(20)], "query_id long, query string")
    whole = rows(retrieval.bm25(docs, asked))
    monkeypatch.setattr(retrieval, "PAIR_ROWS", 100, raising=False)
    found = retrieval.bm25(docs, asked)
    assert "hashpartitioning(doc_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
    assert rows(found) == whole and len(whole) == 200


def test_probed_queries_leave_python_once(spark, tmp_path):
    """What a worker gives Spark has a row for each query, not for each of its cells."""
    import numpy as np

    from lexiloom.operators.vector_index import VectorIndex

    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(30)] + [(30, None)], "query_id long, embedding array<float>").coalesce(1)
    index = VectorIndex(spark, f"file://{tmp_path}", rng.normal(size=(40, 8)))
    probed = index.probed(queries, 25)
    got = probed.collect()
    assert len(got) == 750 and all(sorted(r.near for r in got if r.query_id == q) == list(range(1, 26)) for q in range(30))
    node = probed._jdf.queryExecution().executedPlan()
    while node.nodeName() != "MapInPandas":
        node = node.children().head()
    counted = spark._jvm.org.apache.spark.api.java.JavaRDD.fromRDD(node.execute(), spark._jvm.scala.reflect.ClassTag.Any()).count()
    assert counted == 30


def test_best_reached_is_the_best_of_all_paths(spark):
    from lexiloom.operators import graph

    rnd = random.Random(5)
    for seed in range(3):
        edges = [(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.choice([0.3, 0.5, 0.7, 0.9, 1.0])) for _ in range(45)]
        frame, starts = spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame([(f"n{i}",) for i in range(9)], "name string")
        every = graph.expand_paths(starts, frame).groupBy("target").agg(F.max("score"))
        assert rows(graph.best_reached(starts, frame)) == rows(every)


def test_bridge_rank_goes_with_its_edges(spark, tmp_path):
    """Two starts of each node go on, however many there are: under these edges
    every start reaches every node."""
    n = 40
    lines = spark.range(n * n).select((50 * F.floor(F.col("id") / n)).alias("l_suppkey"), (50 * (F.col("id") % n)).alias("l_partkey"), (F.col("id") % 100).alias("l_orderkey"))
    d = put(tmp_path, lineitem=lines, supplier=spark.range(n).select((50 * F.col("id")).alias("s_suppkey")), part=spark.range(n).select((50 * F.col("id")).alias("p_partkey")))
    from lexiloom import session

    known = len(session._written)
    assert rows(entry.queries()["bridge_rank"](spark, d)) == sql(tmp_path, "bridge_rank")
    assert max(spark.read.parquet(p).count() for p in session._written[known:] if "front" in p) <= 2 * 2 * n


def test_bm25_shuffles_postings_not_pairs(spark):
    """Pairs of a query and a document are summed where their document's postings are."""
    from lexiloom.operators import retrieval

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 7, F.col("id") % 5).alias("text"))
    asked = spark.range(20).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("a b"), F.col("id") % 7).alias("query"))
    found = retrieval.bm25(docs, asked, 3, 0.3)
    assert found.count() == 60
    dealt = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(query_id" in x]
    assert not [x for x in dealt if "doc_id" in x.split("hashpartitioning")[1].split(")")[0]]


def test_long_runs_are_cut_in_linear_time(spark):
    """A run of 60,000 characters: arrays that are copied for every character took minutes."""
    import time

    from lexiloom.operators import segmentation

    rnd = random.Random(7)
    words = ["一二", "二三一", "三", "一"]
    run = "".join(rnd.choice(words) for _ in range(30_000))
    dictionary = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    runs = spark.createDataFrame([(run,), (run[:40],)], "run string")
    start = time.time()
    got = {r.run: r.words for r in segmentation.best_paths(runs, dictionary).collect()}
    assert time.time() - start < 30 and "".join(got[run]) == run
    few = runs.where("length(run) = 40")
    assert segmentation.best_paths(few, dictionary, 0).first().words == got[run[:40]]
    cut = spark.createDataFrame([(1, got[run])], "key long, words array<string>")
    start = time.time()
    n = len(got[run])
    assert rows(segmentation.boundary_scores(cut, cut)) == [(n, n, n)] and time.time() - start < 30


def test_knn_compares_in_small_blocks():
    """A worker's scores of one block of queries and vectors."""
    from lexiloom.operators import retrieval

    assert retrieval.QUERY_ROWS * retrieval.VECTOR_ROWS * 8 <= 10 << 20


def test_louvain_writes_one_table_a_round(spark, monkeypatch):
    """A round is bound by its jobs: its labels, moves and modularity come from one."""
    from lexiloom.operators import louvain

    pairs = [(a, b, 1.0) for a in range(12) for b in range(a) if a // 4 == b // 4 or (a + b) % 7 == 0]
    edges = spark.createDataFrame(pairs, "a long, b long, weight double")
    links, written = louvain._links(edges), []
    keep = louvain.materialize
    monkeypatch.setattr(louvain, "materialize", lambda df, name: written.append(name) or keep(df, name))
    start = links.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("community"))
    labels, score = louvain._settled(links, start, 2.0 * len(pairs), 3, "round")
    assert len(written) == 4
    assert score == pytest.approx(louvain.modularity(edges, labels))


def test_text_operators_take_small_batches(spark):
    """Long texts of one scan: a worker got all of them, and what it made of them, at once."""
    import pandas as pd

    from lexiloom.operators import chunking

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words. ', 8000)").alias("text"))
    chunks = chunking.chunk_documents(docs, chunking.fixed_size)
    seen = F.pandas_udf(lambda s: pd.Series([int(s.str.len().sum())] * len(s)), "long")
    assert docs.select(seen("text").alias("n")).agg(F.max("n")).first()[0] <= 8 << 20
    assert chunks.groupBy("doc_id").count().select("count").distinct().count() == 1
    spark.conf.unset(key)
    for name in ("html_text", "html_markdown", "chunk_fixed", "chunk_recursive"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 4 << 20
        spark.conf.unset(key)


def test_candidates_of_a_group_are_not_sorted_by_query(spark, tmp_path):
    """All pairs of a group went through an aggregate, an anti join and a window by query."""
    from lexiloom.operators import retrieval

    hits = spark.createDataFrame([(1, 7, 0.9, 1), (1, 30, 0.8, 2), (1, 99, 0.7, 3), (2, 5, 0.9, 1), (4, 5, 0.1, 1)], "query_id long, doc_id long, score double, rank int")
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, None), (5, 9)], "query_id long, group int")
    members = spark.range(40).select((F.col("id") % 2).cast("int").alias("group"), F.col("id").alias("doc_id")).union(spark.createDataFrame([(None, 50)], "group int, doc_id long"))
    met = asked.join(members, "group").select("query_id", "doc_id", F.lit(0.5).alias("score"))
    got = retrieval.group_candidates(hits, asked, members, 0.5, 3)
    assert rows(got) == rows(retrieval.graph_candidates(hits, met)) and got.count() == 5 + 19 + 19 + 20
    vectors = spark.range(240).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 11 > 0, F.col("id") % 3).cast("int").alias("label"), F.expr("array(sin(id), cos(id * id), sin(id * 7))").cast("array<float>").alias("embedding"))
    folder = put(tmp_path, embeddings=vectors)
    found = entry.queries()["candidate_union"](spark, folder)
    assert rows(found) == sql(tmp_path, "candidate_union")
    assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()


def test_ir_metrics_gathers_nothing(spark):
    """Distinct sources were gathered from three copies of each row; nulls and repeats count as they did."""
    from lexiloom.operators import evaluation

    runs = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (1, 3, 6), (1, 4, None), (2, 1, 9), (4, 1, 1), (None, 1, 5)], "query_id long, rank int, source long")
    qrels = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (1, None), (2, 8), (3, 1), (None, 5)], "query_id long, source long")
    found = evaluation.ir_metrics(runs, qrels, 3)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert rows(found) == [(1, 1.0, round(2 / 3, 6), 1.0, 0.5, round((1 + 1 / math.log2(3)) / ideal, 6), round(2 / 3, 6)), (2, *[0.0] * 6), (3, *[0.0] * 6), (None, *[0.0] * 6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan


def test_label_propagation_sorts_no_links(spark, monkeypatch):
    """Links were sorted by node in every round."""
    from lexiloom.operators import graph

    plans, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    found = graph.label_propagation(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5)], "a long, b long"), 2)
    assert rows(found) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert [n for n, _ in plans].count("labels") == 2 and all("ShuffledHashJoin" in p and p.count("REPARTITION_BY_NUM") >= 2 for n, p in plans if n == "labels")


def test_pagerank_shuffles_links_of_numbers_once(spark, tmp_path, monkeypatch):
    """Links were pairs of strings with a degree, which the last round's filter shuffled a second time."""
    from lexiloom.operators import graph

    written, keep = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.update({name: df}) or keep(df, name))
    lines = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (2, 1), (3, 1), (0, 0), (-1, -1), (-1, 0), (7, 10**15)], "l_suppkey long, l_partkey long")
    found = entry.queries()["pagerank"](spark, put(tmp_path, lineitem=lines))
    assert rows(found) == sql(tmp_path, "pagerank") and len(rows(found)) == 11
    assert [t for _, t in written["pagerank-links"].dtypes] == ["bigint", "bigint"]
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 2 and final.count("ReusedExchange") == 9


def test_prompt_context_has_whole_texts_of_all_hits(spark, tmp_path):
    """It had two hits of each source, and their numbers for texts."""
    texts = [(1, "alpha beta gamma", "a"), (2, "alpha beta", "a"), (3, "alpha beta", "a"), (4, "Alpha, beta and more", None), (5, "alpha", "b"), (6, "other words", "b"), (7, None, "b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    d = put(tmp_path, documents=docs, benchmark=spark.createDataFrame([(1, "alpha beta"), (2, "none")], "item_id long, text string"))
    got = rows(entry.queries()["prompt_context"](spark, d))
    assert got == sql(tmp_path, "prompt_context") and [q for q, _ in got] == [1]
    assert got[0][1].split("\n\n") == ["[a]\nalpha beta", "[a]\nalpha beta", "[a]\nalpha beta gamma", "[]\nAlpha, beta and more", "[b]\nalpha"]
    from lexiloom.operators import verification

    hits = spark.createDataFrame([(1, "a", 1, "x", "P"), (1, "a", 2, "y", "P"), (1, "a", 3, "z", None), (1, "a", 4, "z", None), (1, "b", 5, "w", None)], "query_id long, source string, rank int, text string, parent_text string")
    assert rows(verification.prompt_context(hits)) == [(1, "[a]\nP\n\n[a]\nz\n\n[b]\nw")]
    assert rows(verification.prompt_context(hits, None)) == [(1, "[a]\nP\n\n[a]\nz\n\n[a]\nz\n\n[b]\nw")]


def test_path_expand_deals_ways_by_their_number(spark, tmp_path, monkeypatch):
    """All ways of a hop from a small front went through one task, and every way through a sum."""
    from lexiloom.operators import graph

    plans, keep = {}, graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, name))
    n = 40
    lines = spark.range(n * n).select((50 * F.floor(F.col("id") / n) - 100).alias("l_suppkey"), (50 * (F.col("id") % n)).alias("l_partkey")).union(spark.createDataFrame([(None, 50), (50, None)], "a long, b long"))
    d = put(tmp_path, lineitem=lines, supplier=spark.range(n).select((50 * F.col("id") - 100).alias("s_suppkey")), part=spark.range(n).select((50 * F.col("id")).alias("p_partkey")))
    want = sql(tmp_path, "path_expand_3hop")
    assert rows(entry.queries()["path_expand_3hop"](spark, d)) == want and len(want) > 2 * n * n
    plans.clear()
    monkeypatch.setattr(graph, "PATH_ROWS", 1000)
    monkeypatch.setattr(graph, "WAYS_AT_ONCE", 70)
    assert rows(entry.queries()["path_expand_3hop"](spark, d)) == want
    assert ["CoGroup" in p for p in plans["path-front"]] == [False, True, True] and ", 128), REPARTITION_BY_NUM" in plans["path-front"][2]


def test_best_ways_by_cells_and_by_order():
    import numpy as np

    from lexiloom.operators import graph

    rng = np.random.default_rng(2)
    for starts, ends, n in ((5, 7, 400), (1000, 1000, 400), (3, 3, 0), (1, 1, 9)):
        start, end, score = rng.integers(0, starts, n), rng.integers(0, ends, n), rng.random(n)
        want = {}
        for a, b, s in zip(start, end, score, strict=True):
            if s >= 0.2:
                want[a, b] = max(s, want.get((a, b), 0))
        assert {(a, b): s for a, b, s in zip(*graph._best_ways(start, end, score, 0.2), strict=True)} == want


def test_label_propagation_shuffles_links_once(spark, tmp_path, monkeypatch):
    """Each round shuffled all links, then their votes, and then what these came to."""
    from lexiloom.operators import graph

    plans, keep = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    lines = spark.range(300).select((F.col("id") % 17).alias("l_suppkey"), (F.col("id") * F.col("id") % 41).alias("l_partkey"))
    d = put(tmp_path, lineitem=lines)
    assert rows(entry.queries()["communities"](spark, d)) == sql(tmp_path, "communities")
    later = [p for n, p in plans if n == "labels"]
    assert len(later) == 5
    for p in later:
        own, kept = p.split("InMemoryRelation")
        assert "hashpartitioning(b#" in kept and "hashpartitioning(a#" in own and "Exchange hashpartitioning(b#" not in own
        assert not [x for x in own.split("hashpartitioning(a#")[1:] if "community" in x.split(")")[0]]
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_substrings_are_counted_on_the_way(spark, monkeypatch):
    """Every substring was a row of its own, cut from its run's first character on."""
    from lexiloom.operators import segmentation

    rnd = random.Random(4)
    texts = {"".join(rnd.choice("一二三") for _ in range(rnd.randrange(1, 30))): rnd.choice([1, 1, 7]) for _ in range(60)}
    want = {}
    for run, n in texts.items():
        for at in range(len(run)):
            for word in {run[at:end] for end in range(at + 1, min(at + 3, len(run)) + 1)}:
                want[word] = want.get(word, 0) + n
    frame = spark.createDataFrame(list(texts.items()), "run string, n long").coalesce(1)
    for most in (200_000, 4):
        monkeypatch.setattr(segmentation, "GRAMS_AT_ONCE", most)
        told = segmentation.gram_counts(frame, 3)
        assert {(r.word, r.size): r.n for r in told.groupBy("word", "size").agg(F.sum("n").alias("n")).collect()} == {(w, len(w)): n for w, n in want.items()}
        assert most == 4 or told.count() == len(want)


def test_unspaced_texts_are_written_once(spark, monkeypatch):
    """Words were spelt anew by every job that read them."""
    from lexiloom.plans import indexes

    known = len(indexes.materialize.__globals__["_written"])
    got = indexes._unspaced(spark.createDataFrame([(1, "The the, cat."), (2, ""), (3, None), (4, "12")], "doc_id long, text string"), "doc_id")
    assert "unspaced" in indexes.materialize.__globals__["_written"][known]
    said = {r.doc_id: (r.words, r.text) for r in got.collect()}
    the, cat = indexes._as_hanzi("the"), indexes._as_hanzi("cat")
    assert said == {1: ([the, the, "，", cat, "，"], f"{the}{the}，{cat}，"), 2: ([], ""), 3: (None, None), 4: ([], "")}
