"""Segmentation, stored indexes and communities against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import graph, louvain, retrieval, search_index, segmentation, vector_index

RNG = random.Random(3)
HAN = "".join(chr(0x4E00 + 11 * i) for i in range(200))


def sentences(n):
    words = ["".join(RNG.choice(HAN) for _ in range(RNG.choice([1, 2, 2, 3]))) for _ in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [[RNG.choices(words, weights)[0] for _ in range(RNG.randint(4, 12))] for _ in range(n)]


def test_best_paths_equal_all_paths(spark):
    counts = {"中": 5, "国": 4, "中国": 9, "国人": 3, "中国人": 2, "人": 6, "大": 1, "人大": 7}
    runs = ["".join(RNG.choice("中国人大外") for _ in range(RNG.randint(1, 9))) for _ in range(60)] + ["外", "中国人大" * 40]
    dictionary = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.run: r.words for r in segmentation.best_paths(spark.createDataFrame([(r,) for r in runs], "run string"), dictionary).collect()}
    total = sum(counts.values())
    assert set(got) == set(runs)
    for run, words in got.items():
        assert "".join(words) == run

        def cost(cut):
            return sum(math.log(total / counts[w]) if w in counts else (math.log(2 * total / min(counts.values())) if len(w) == 1 else math.inf) for w in cut)

        if len(run) < 10:
            every = []
            for marks in itertools.product([0, 1], repeat=len(run) - 1):
                at = [0, *(i + 1 for i, m in enumerate(marks) if m), len(run)]
                every.append(cost([run[a:b] for a, b in itertools.pairwise(at)]))
            assert cost(words) == pytest.approx(min(every))


def test_segmentation_held_out(spark):
    said = sentences(700)
    texts = spark.createDataFrame([(i, "".join(s) + "，abc 1。") for i, s in enumerate(said)] + [(9000, None), (9001, "no such Text"), (9002, "")], "doc_id long, text string")
    words = segmentation.learn_dictionary(texts.where("doc_id % 4 != 0"))
    cut = {r.doc_id: r.terms for r in segmentation.segmented(texts, words).collect()}
    assert cut[9000] == [] == cut[9002] and cut[9001] == ["no", "such", "text"] and len(cut) == 703
    assert all(t[-2:] == ["abc", "1"] and "".join(t[:-2]) == "".join(said[i]) for i, t in cut.items() if i < 700)
    held = [(i, said[i], cut[i][:-2]) for i in range(0, 700, 4)]
    scores = [segmentation.boundary_scores(spark.createDataFrame([(i, x) for i, x in rows], "key long, words array<string>"), spark.createDataFrame([(i, s) for i, s, _ in held], "key long, words array<string>")).first() for rows in ([(i, c) for i, _, c in held], [(i, list("".join(s))) for i, s, _ in held])]
    by_word, by_character = (2 * r.n_both / (r.n_found + r.n_true) for r in scores)
    assert by_word > 0.9 > by_character
    assert segmentation.learn_dictionary(texts.where("doc_id > 8999")).count() == 0


def test_bm25_by_words_finds_words_not_characters(spark):
    words = spark.createDataFrame([("中国", 50), ("国中", 50), ("中", 5), ("国", 5), ("人", 5)], "word string, n long")
    docs = spark.createDataFrame([(1, "中国人"), (2, "国中人")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "中国")], "query_id long, text string")
    hits = retrieval.bm25_terms(segmentation.segmented(docs, words), segmentation.segmented(asked, words, "query_id")).collect()
    assert [r.doc_id for r in hits] == [1]
    assert {r.doc_id for r in retrieval.bm25(docs, asked.withColumnRenamed("text", "query")).collect()} == {1, 2}


VOCABULARY = [f"w{i}" for i in range(120)]


def random_text(most=60):
    return " ".join(RNG.choices(VOCABULARY, [1 / (i + 1) for i in range(120)], k=RNG.randint(0, most)))


def test_index_follows_its_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 4)
    schema = "doc_id long, text string"
    now = {i: random_text() for i in range(150)} | {150: None, 151: "", 152: "w0 " * 500}
    queries = spark.createDataFrame([(i, random_text(5) + " w0 unheard") for i in range(25)] + [(25, ""), (26, "unheard of")], "query_id long, query string")
    index = search_index.SearchIndex.open(spark, f"file://{tmp_path}/index")
    assert index.search(queries).collect() == []

    def frame(docs):
        return spark.createDataFrame(list(docs.items()), schema)

    def check(index):
        for k, least in ((3, 0.0), (10, 0.7)):
            want = retrieval.bm25(frame(now), queries, k, least).select("query_id", "doc_id", "matched", "score", "rank").collect()
            assert sorted(index.search(queries, k, least).collect()) == sorted(want) and want

    index = index.sync(frame(now))
    check(index)
    judged = index.search_blocks(queries, 3, 0.0)[1].groupBy("kept").count().collect()
    assert any(not r["kept"] for r in judged)
    old = index
    now |= {3: random_text(), 150: "w1 w2", 400: random_text(), 401: "w0"}
    index = index.upsert(frame({i: now[i] for i in (3, 150, 400, 401)}))
    del now[7], now[401]
    index = index.delete(spark.createDataFrame([(7,), (401,), (999,)], "doc_id long"))
    check(index)
    now |= {5: "w3 w3", 500: random_text()}
    del now[8]
    states = {r.doc_id: r.state for r in index.compare(frame(now)).collect()}
    assert {i: s for i, s in states.items() if s != "unchanged"} == {5: "changed", 500: "added", 8: "deleted"}
    index = index.sync(frame(now))
    assert index.sync(frame(now)) is index
    check(index)
    assert old.documents().count() == 153
    index = index.compact()
    assert len(index.segments) == 1 and not index.deletions
    check(index)
    check(search_index.SearchIndex.open(spark, f"file://{tmp_path}/index"))
    with pytest.raises(Exception, match="(?i)exists"):
        old.delete(spark.createDataFrame([(1,)], "doc_id long"))


def test_index_blocks_of_few_and_many(spark, tmp_path, monkeypatch):
    """Only terms of more postings than a block are sized by frequency and length,
    and postings then wait for no shuffle but that by block."""
    monkeypatch.setattr(search_index, "BLOCK", 4)
    sized, plain = [], search_index.materialize

    def kept(df, label):
        sized.extend([plain(df, label)] if label == "index-sizes" else [])
        return sized[-1] if label == "index-sizes" else plain(df, label)

    monkeypatch.setattr(search_index, "materialize", kept)
    docs = [(i, "the " * (1 + i % 3) + f"rare{i // 2} " * 2 + "pad " * (i % 5 == 0) * 9) for i in range(20)]
    index = search_index.SearchIndex.open(spark, f"file://{tmp_path}/index").sync(spark.createDataFrame(docs, "doc_id long, text string"))
    counts = {r.term: r.df for r in index.frequencies().collect()}
    assert counts == {"the": 20, "pad": 4} | {f"rare{i}": 2 for i in range(10)}
    assert {r.term for r in sized[0].collect()} == {"the"}
    stored = index._read(index.segments, "postings", search_index.POSTINGS).collect()
    assert sorted((r.term, d, t) for r in stored for d, t in zip(r.doc_ids, r.tfs, strict=True)) == sorted((w, i, t.split().count(w)) for i, t in docs for w in set(t.split()))
    assert all((r.block == "all.0") == (r.term != "the") and len(set(r.tfs)) == 1 and r.most_tf == max(r.tfs) and r.least_length == min(r.lengths) for r in stored)
    assert sum(r.term == "the" for r in stored) > 4


def test_vector_index(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(30, 16))
    rows = [(i, (centers[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(900)] + [(900 + i, [1.0] * 16) for i in range(400)] + [(2000, [0.0] * 16), (2001, None)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(3)
    queries = vectors.where("doc_id % 50 = 0 and embedding is not null").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(vector_index, "PIECE_ROWS", 100)
    index = vector_index.VectorIndex.build(vectors, f"file://{tmp_path}/vectors", sample=800)
    assert index.cells().count() == 1301
    again = vector_index.VectorIndex.open(spark, f"file://{tmp_path}/vectors")
    assert np.array_equal(again.centroids, index.centroids)
    exact = retrieval.knn(vectors.where("embedding is not null"), queries).collect()
    assert sorted(again.search(queries, 10, 10**6).collect()) == sorted(exact)
    probes = index.probes_for(queries)
    assert probes < len(index.centroids)
    got = vector_index.recall(index.search(queries, 10, probes), spark.createDataFrame(exact)).first()
    assert got.recall >= 0.9 and got.n == len(exact)


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = vectors.where("doc_id % 7 = 0").withColumnRenamed("doc_id", "query_id")
    found = retrieval.top_k(retrieval._block_knn(vectors, queries, queries.count(), 5, 40), 5).collect()
    assert sorted(found) == sorted(retrieval.knn(vectors, queries, 5).collect()) == sorted(retrieval.knn(vectors, queries, 5, 0).collect())


def modularity_brute(edges, label):
    degree, inside, twice = {}, 0.0, 0.0
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
        twice += 2 * w
        inside += 2 * w * (label[a] == label[b])
    sums = {}
    for n, d in degree.items():
        sums[label[n]] = sums.get(label[n], 0) + d
    return inside / twice - sum((s / twice) ** 2 for s in sums.values())


def test_louvain(spark):
    def planted(k, n, near, far):
        return [(i, j, 1.0) for i in range(k * n) for j in range(i) if RNG.random() < (near if i // n == j // n else far)]

    graphs = [
        planted(4, 10, 0.9, 0.03),
        [(0, i, 1.0) for i in range(1, 20)],
        [(RNG.randrange(25), RNG.randrange(25), float(RNG.randint(1, 4))) for _ in range(60)],
    ]
    for i, edges in enumerate(graphs):
        frame = spark.createDataFrame(edges, "a long, b long, weight double")
        found = louvain.louvain(frame)
        label = {r.node: r.community for r in found.collect()}
        assert set(label) == {x for e in edges for x in e[:2]}
        assert all(label[c] == c == min(n for n in label if label[n] == c) for c in label.values())
        score = louvain.modularity(frame, found)
        assert score == pytest.approx(modularity_brute(edges, label))
        assert score >= louvain.modularity(frame, graph.label_propagation(frame)) - 1e-9
        if i == 0:
            assert sorted(sorted(n for n in label if label[n] == c) for c in set(label.values())) == [list(range(10 * c, 10 * c + 10)) for c in range(4)]
            assert {r.node: r.community for r in louvain.louvain(frame.repartition(7)).collect()} == label


def test_louvain_edge_cases(spark):
    schema = "a string, b string, weight double"
    assert louvain.louvain(spark.createDataFrame([], schema)).collect() == []
    rows = [("x", "y", None), ("y", "x", 2.0), ("z", "z", 1.0), ("u", None, 1.0), ("v", "w", 0.0), ("v", "w", -1.0)]
    assert {r.node: r.community for r in louvain.louvain(spark.createDataFrame(rows, schema)).collect()} == {"x": "x", "y": "x", "z": "z"}


def test_term_frequencies(spark):
    docs = spark.createDataFrame([(["b", "a", "b"],), (["b"],), ([],)], "terms array<string>")
    assert sorted(map(tuple, retrieval.term_frequencies(docs).select("term", "df", "cf").collect())) == [("a", 1, 1), ("b", 2, 3)]
    assert docs.where(F.size("terms") == 0).count() == 1
