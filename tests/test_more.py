"""Lifecycle, datasets, enrichment, search and time slices on small literal tables."""

import io
import json
import random
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiloom import session
from lexiloom.functions import text as T
from lexiloom.functions.models import Models
from lexiloom.operators import datasets, enrichment, evaluation, graph, lifecycle, retrieval, verification
from lexiloom.sources import readers
from lexiloom.streaming import tasks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_index_lifecycle(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shelf LOCATION '{tmp_path}/shelf'")
    assert not lifecycle.index_exists(spark, "shelf.chunks")
    lifecycle.create_index(spark, "shelf.chunks")
    lifecycle.create_index(spark, "shelf.chunks")
    new = spark.sql("select cast(null as string) chunk_id, tenant tenant_id, 'k' kb_id, 's' source, '' section, i chunk_index, text, array(cast(1 as float), cast(2 as float)) embedding, map('a', 'b') metadata, timestamp'2024-01-01' created_at from values ('t1', 1, 'x'), ('t2', 2, 'y'), ('t1', 3, null), (null, 4, 'z') v(tenant, i, text)")
    good, bad = lifecycle.checked_inserts(new, 2)
    assert sorted(r["error"] for r in bad.collect()) == ["no tenant", "no text"] and lifecycle.checked_inserts(new, 3)[0].count() == 0
    good.select(*spark.table("shelf.chunks").columns).write.insertInto("shelf.chunks")
    assert spark.table("shelf.chunks").where("tenant_id = 't1'").count() == 1 and spark.table("shelf.chunks").count() == 2
    lifecycle.clear_index(spark, "shelf.chunks")
    assert lifecycle.index_exists(spark, "shelf.chunks") and spark.table("shelf.chunks").count() == 0
    lifecycle.drop_index(spark, "shelf.chunks")
    assert not lifecycle.index_exists(spark, "shelf.chunks")


def test_conversations(spark):
    c = spark.createDataFrame([("a", "u1", "A", None), ("b", "u2", "B", "old")], "conv_id string, user_id string, title string, share_token string")
    m = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "y")], "conv_id string, turn int, role string, text string")
    ids = lambda df: sorted(r[0] for r in df.select("conv_id").collect())
    gone = lifecycle.delete_conversations(c, m, spark.createDataFrame([("a", "u2"), ("b", "u2")], "conv_id string, user_id string"))
    assert [ids(x) for x in gone] == [["a"], ["a"]]
    copies = lifecycle.duplicate_conversations(c, m, spark.createDataFrame([("b", "u2", "n")], "conv_id string, user_id string, new_id string"))
    assert ids(copies[0]) == ids(copies[1]) == ["a", "b", "n"] and copies[0].where("conv_id = 'n'").first()["share_token"] is None
    wanted = spark.createDataFrame([("a", "u1"), ("b", "u2")], "conv_id string, user_id string")
    once = lifecycle.share_conversations(c, wanted, "k")
    tokens = dict(rows(once.select("conv_id", "share_token")))
    assert tokens["b"] == "old" and len(tokens["a"]) == 32 and rows(lifecycle.share_conversations(once, wanted, "other")) == rows(once)


def test_members(spark):
    m = spark.createDataFrame([("o", "t", "owner", "active", None), ("n", "t", "normal", "active", "o"), ("p", "t", "normal", "pending", "o")], "user_id string, tenant_id string, role string, status string, inviter_id string")

    def after(*requests):
        asked = spark.createDataFrame([("t", u, by, action, role) for u, by, action, role in requests], "tenant_id string, user_id string, by string, action string, role string")
        return {r["user_id"]: (r["role"], r["status"]) for r in lifecycle.change_members(m, asked).collect()}

    same = {"o": ("owner", "active"), "n": ("normal", "active"), "p": ("normal", "pending")}
    assert after(("p", "o", "accept", None), ("n", "p", "remove", None), ("o", "o", "remove", None)) == same
    assert after(("n", "o", "role", "king")) == same
    assert after(("p", "p", "accept", None), ("n", "o", "role", "owner")) == same | {"p": ("normal", "active"), "n": ("owner", "active")}
    assert set(after(("p", "p", "reject", None), ("n", "o", "remove", None))) == {"o"}
    assert rows(lifecycle.primary_tenant(m)) == [("n", "t"), ("o", "t")]


def test_records(spark, tmp_path):
    names = spark.createDataFrame([("a.md", "text/markdown"), ("a.md", "image/png"), ("a.exe", None), (" ", None), (None, None), ("x" * 300 + ".txt", "text/plain")], "n string, t string")
    assert [r[0] for r in names.select(lifecycle.valid_upload(F.col("n"), F.col("t"))).collect()] == [[], ["type does not match"], ["unsupported format"], ["no name", "unsupported format"], ["no name", "unsupported format"], ["name too long"]]
    (tmp_path / "report1.json").write_text('{"a": 1}')
    (tmp_path / "report2.json").write_text("{broken")
    (tmp_path / "other.json").write_text("{}")
    assert [r["name"] for r in lifecycle.read_reports(spark, str(tmp_path)).collect()] == ["report1.json"]
    paths = spark.createDataFrame([("report1.json",), ("../report1.json",), ("report..json",), (None,)], "n string")
    assert [r[0] for r in paths.select(lifecycle.is_report_name(F.col("n"))).collect()] == [True, False, False, False]
    e = spark.sql("select timestamp'2024-01-01' ts, 'INFO' level, 'web' logger, 'hi' message, 7 user_id, 'secret' password")
    line = json.loads(lifecycle.log_lines(e, ["user_id", "missing"]).first()[0])
    assert line["user_id"] == 7 and "password" not in line and line["message"] == "hi"
    images = spark.createDataFrame([("a",), ("b",)], "image string")
    assert [rows(x) for x in lifecycle.referenced(images, spark.createDataFrame([("a",), (None,)], "image string"))] == [[("a",)], [("b",)]]
    messages = lifecycle.queue_upload(spark.createDataFrame([("d", "f.md", 3)], "doc_id string, name string, size int"), "t", "k")[1].first()
    assert messages["file_path"] == "t/k/d/f.md" and messages["priority"] == "high"


def test_datasets(spark, tmp_path):
    samples = [{"question": "q", "expected_sources": ["s"], "expected_keywords": [], "reference_answer": "a"}, {"question": "q", "query_type": "odd"}]
    (tmp_path / "d.json").write_text(json.dumps(samples))
    assert [r["question"] for r in datasets.read_dataset(spark, f"{tmp_path}/d.json").collect()] == ["q", "q"]
    lines = spark.createDataFrame([*((i, json.dumps(x)) for i, x in enumerate(samples)), (2, "[1]"), (3, "{")], "sample_no int, json string")
    assert rows(datasets.validate(lines)) == [(1, "invalid query_type: odd"), (1, "lacks expected_keywords"), (1, "lacks expected_sources"), (1, "lacks reference_answer"), (2, "not an object"), (3, "not JSON")]
    plan = datasets.question_plan(spark.createDataFrame([("t1", "a"), ("t2", "b")], "topic string, source string"), 10)
    got = plan.collect()
    assert len(got) == 12 and {r["topic"] for r in got} == {"t1", "t2"} and [r["id"] for r in sorted(got)] == list(range(1, 13))
    assert datasets.question_plan(plan.select("topic", "source").where("false"), 95).where("topic is null").count() == 95
    assert T.coerced("3") == 3 and T.coerced("0.5") == 0.5 and T.coerced("True") is True and T.coerced("x") == "x"


def test_models(spark):
    chunks = spark.createDataFrame([("c1", "Ann met Bob"), ("c2", None), ("c3", "Ann met Bob")], "chunk_id string, text string")
    calls = []

    def model(prompts):
        return ["(entity|Ann|Law|who)\n(relation|Ann|Bob|met|3|a;b)" if "more" not in p else "(entity|Bob|Law|x)" for p in prompts]

    e, r = enrichment.extract(chunks, model)
    assert rows(e) == [("c1", "Ann", "Law", "who"), ("c3", "Ann", "Law", "who")] and r.first()["keywords"] == ["a", "b"] and r.first()["weight"] == 3
    two = enrichment.extract(chunks, lambda p: ["(entity|B|Law|x)" if "(entity" in x else "(entity|A|Law|x)" for x in p], more=1)[0]
    assert {x["name"] for x in two.collect()} == {"A", "B"}
    e, r = enrichment.extract_json(chunks, lambda p: ['```json\n[{"name": " A ", "type": "Law"}, {"name": "B", "type": "Dog"}]```'] * len(p), lambda p: ['[{"subject": "A", "predicate": "制定", "object": "C"}, {"subject": "A", "predicate": "likes", "object": "C"}]'] * len(p))
    assert {x["name"] for x in e.collect()} == {"A"} and {x["predicate"] for x in r.collect()} == {"制定"}
    tagged = enrichment.tag_chunks(spark.createDataFrame([("1", "about spark"), ("2", "other"), ("3", "none")], "chunk_id string, text string"), ["Spark"], lambda p: ['{"x": 3, "y": 0, "z": "-1"}' if "other" in q.split("\n")[-1] and "about spark -> " in q else "no" for q in p])
    assert {x["chunk_id"]: x["tags"] for x in tagged.collect()} == {"1": {"Spark": 8}, "2": {"x": 3}, "3": {}}
    pairs = spark.createDataFrame([("t", f"a{i:03}", f"b{i:03}") for i in range(250)], "type string, a string, b string")
    kept = enrichment.confirm_pairs(pairs, lambda p: [json.dumps([int(x.split(":")[0]) for x in q.split("\n") if x.endswith("7")]) for q in p])
    assert {x["a"][-1] for x in kept.collect()} == {"7"} and kept.count() == 25
    pages = spark.createDataFrame([(1, 0, "x" * 300, "i0"), (1, 1, "", "json"), (2, 0, None, "plain")], "doc_id int, page int, text string, image string")
    regions = enrichment.regions(pages, lambda p: ['{"regions": [{"type": "table", "content": "t", "confidence": "bad"}, {"type": "odd", "content": "o"}]}' if x == "json" else "just text" for x in p])
    assert {(x["doc_id"], x["page"], x["type"], x["confidence"]) for x in regions.collect()} == {(1, 0, "text", 1.0), (1, 1, "table", 0.5), (2, 0, "text", 0.5)}
    answers = spark.createDataFrame([(1, "analytical", "q", "old", "c"), (2, "factoid", "q", "old", "c"), (3, "exploratory", "q", "old", "c")], "answer_id int, intent_type string, question string, answer string, context string")
    said = verification.reflect(answers, lambda b: ['{"supported": false, "revised": "new"}' if i == 1 else "?" for i in b["answer_id"]])
    assert rows(said) == [(1, "new", True), (2, "old", False), (3, "old", False)] and not calls


def test_summary_tree(spark):
    texts = [(1, i, ("aaa " if i < 4 else "zzz ") + str(i)) for i in range(8)] + [(2, 0, "alone")]
    encode = lambda ts: np.array([[t.count("a"), t.count("z")] for t in ts], float) + np.arange(len(ts))[:, None] * 1e-3
    got = enrichment.summary_tree(spark.createDataFrame(texts, "doc_id int, node int, text string"), encode, lambda p: [x[:7] for x in p]).collect()
    first = [r for r in got if r["doc_id"] == 1 and r["level"] == 0]
    assert len(first) == 8 and len({r["parent"] for r in first}) == 2 and len({r["parent"] for r in first if r["node"] < 4}) == 1
    assert {r["parent"] for r in got if r["doc_id"] == 2} == {None} and max(r["level"] for r in got) >= 1
    x = np.vstack([np.random.default_rng(i).normal(10 * i, 1, (40, 3)) for i in range(3)])
    assert len(set(enrichment.best_groups(x))) == 3


def test_search_as_data(spark):
    docs = spark.createDataFrame([(1, "red apple", "a", [1.0, 0.0]), (2, "green apple", "b", [0.0, 1.0]), (3, "red car", "a", [1.0, 1.0])], "doc_id long, text string, source string, embedding array<float>")
    text = spark.createDataFrame([(7, "red apple")], "query_id long, query string")
    dense = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    ids = lambda df: [r["doc_id"] for r in df.orderBy("rank").collect()]
    assert ids(retrieval.search(docs, retrieval.Search(text=text, k=1))) == [1]
    assert ids(retrieval.search(docs, retrieval.Search(dense=dense))) == [1, 3, 2]
    assert ids(retrieval.search(docs, retrieval.Search(text=text, dense=dense, method="rrf", k=2))) == [1, 3]
    assert ids(retrieval.search(docs, retrieval.Search(dense=dense, where={"source": "b"}))) == [2]
    assert ids(retrieval.search(docs, retrieval.Search(dense=dense, order=(("source", False),), fields=("source",)))) == [2, 1, 3]
    assert ids(retrieval.search(docs, retrieval.Search(k=1, offset=1))) == [2]
    hits = spark.createDataFrame([(7, "red", 1, "red x", 0.1, 2), (7, "red", 2, "blue", 0.9, 1)], "query_id long, query string, doc_id long, text string, score double, rank int")
    assert ids(retrieval.rerank_by("w", {"w": retrieval.word_overlap}, hits, 1)) == [1] and ids(retrieval.rerank_by("none", {}, hits, 2)) == [2, 1]
    assert ids(retrieval.rerank_by("hybrid", {"w": retrieval.word_overlap, "z": lambda b: pd.Series(np.zeros(len(b)))}, hits, 2)) == [1, 2]
    assert ids(retrieval.rerank_by("hybrid", {"w": retrieval.word_overlap}, hits, 1)) == [1]


def test_graph_retrieval(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", None), ("b", "c", "y")], "source string, target string, description string")
    got = rows(graph.n_hop_paths(spark.createDataFrame([("a",)], "name string"), edges, 2))
    assert set(got) == {("a", "a →(x)→ b", 1), ("a", "a →(x)→ b →(y)→ c", 2)}
    tables = graph.ingest(spark.sql("select 's' source, 'c1' chunk_id, array(named_struct('name', 'A', 'type', 'Law', 'aliases', array('a1', 'A'))) entities, array(named_struct('subject', 'A', 'predicate', '上位法', 'object', 'B'), named_struct('subject', 'A', 'predicate', '?', 'object', 'B')) relations union all select 's', 'c2', array(named_struct('name', 'A', 'type', 'Organization', 'aliases', null)), array()"))
    assert rows(tables["entities"]) == [("A", "Law")] and rows(tables["aliases"]) == [("a1", "A")] and rows(tables["documents"]) == [("s", 2)]
    assert {(r["predicate"], r["weight"]) for r in tables["relates"].collect()} == {("上位法", 0.9), ("?", 0.5)} and tables["mentions"].count() == 2


@pytest.mark.parametrize("n", [0, 1, 2, 3, 500])
def test_order_statistics(spark, n):
    rng = random.Random(n)
    values = [("k", float(rng.choice([1, 2, 3, rng.random() * 100]))) for _ in range(n)] + [("one", 5.0), ("one", None)]
    got = {r["k"]: r for r in evaluation.latency_report(spark.createDataFrame(values, "k string, v double"), "k", "v").collect()}
    assert got["one"]["p95_index"] == got["one"]["p50"] == 5.0
    own = sorted(v for k, v in values if k == "k")
    if own:
        r = got["k"]
        assert (r["p95_index"], r["p99_index"], r["median_index"]) == tuple(round(own[i], 4) for i in (int(n * 0.95), int(n * 0.99), n // 2))
        assert r["p50"] == pytest.approx(np.quantile(own, 0.5), abs=1e-4) and r["p95"] == pytest.approx(np.quantile(own, 0.95), abs=1e-4)


def test_running_numbers_in_slices(spark):
    """Counts and means by slices of time are those of whole keys, whatever the slices."""
    rng = random.Random(2)
    data = [(i, rng.choice("ab"), rng.randrange(10**6), rng.random(), rng.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(data, "event_id int, k string, s int, value double, bad boolean").withColumn("ts", F.timestamp_seconds("s"))
    for width in ("1 hour", "10 days"):
        got = {r["event_id"]: (r["mean"], r["n"]) for r in tasks.rolling(df, "k", "value", 25, width).collect()}
        alerts = set(rows(tasks.error_alerts(df, F.col("bad"), "k", width=width)))
        want = set()
        for key in "ab":
            own = sorted((s, i, v, bad) for i, k, s, v, bad in data if k == key)
            for j, (_, i, _, _) in enumerate(own):
                last = [v for *_, v, _ in own[max(0, j - 24) : j + 1]]
                assert got[i] == (pytest.approx(np.mean(last)), len(last))
                errors = sum(bad for *_, bad in own[: j + 1])
                if j + 1 >= 20 and (j + 1) % 10 == 0 and errors / (j + 1) >= 0.05:
                    want.add((key, i, j + 1, errors))
        assert alerts == want


def test_readers_of_pages_and_models():
    page = "<body><div class='navbar'><p>no</p></div><div class='main content'><h2>T</h2><ul><li>a</li><li>b <a href='/x'>c</a><ol><li>d</li></ol></li></ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table><pre>k  l</pre></div><p>out</p></body>"
    assert readers.html_markdown(page) == "## T\n\n- a\n- b [c](/x)\n1. d\n| h | i |\n| --- | --- |\n| 1 | 2 |\n\n```\nk  l\n```"
    assert "no" not in readers.html_text(page).split() and "out" not in readers.html_text(page)
    assert readers.is_scanned(["x" * 10, "y" * 60]) and not readers.is_scanned(["x" * 60]) and readers.is_scanned([])
    image = readers.image_reader(lambda b: " text ", lambda b: "")
    assert image(b"") == "[OCR 文字内容]\ntext" and readers.image_reader()(b"") == ""
    pages = [readers.PdfPage("long " * 20, figures=(b"f",), tables=([["a", "b"], ["1"]],)), readers.PdfPage("", b"scan")]
    read = readers.pdf_reader(lambda b: pages, lambda b: b.decode(), lambda b: "a figure")
    assert read(b"").split("\n\n")[1:] == ["a figure", "| a | b |\n| --- | --- |\n| 1 |  |", "scan"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", "<s xmlns:a='a'><a:p><a:r><a:t>one</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:txBody><a:p><a:t>x</a:t></a:p></a:txBody></a:tc><a:tc><a:p><a:t>y</a:t></a:p></a:tc></a:tr></a:tbl></s>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", "<s xmlns:a='a'><a:p><a:t>note</a:t></a:p></s>")
    assert readers.pptx_text(out.getvalue()) == "## Slide 1\none\nx | y\n[备注] note"
    models = Models()
    models.add("rerank", "words", retrieval.word_overlap)
    assert models.get("rerank", "words") is retrieval.word_overlap and models.names("chat") == [] and list(models.of_kind("rerank")) == ["words"]
    with pytest.raises(KeyError):
        models.get("chat", "none")
    with pytest.raises(ValueError):
        models.add("odd", "x", len)


def test_clear_scratch(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", [])
    df = session.materialize(spark.range(3), "x")
    assert df.count() == 3 and session.clear_scratch(spark) == 1 and session.clear_scratch(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|not found|FILE_NOT_EXIST"):
        spark.read.parquet(df.inputFiles()[0]).count()


def test_bounded_paths_equal_all_paths(spark):
    rng = random.Random(8)
    for _ in range(3):
        edges = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.choice([0.05, 0.3, 0.5, 0.5, 0.9, 1.0])) for _ in range(40)]
        frame = spark.createDataFrame(edges, "source string, target string, weight double")
        starts = spark.createDataFrame([(f"n{i}",) for i in range(9)], "name string")
        best = {}

        def walk(start, at, score, n, edges=edges, best=best):
            for a, b, w in edges:
                if a == at and score * w >= 0.1 and n < 3:
                    if b != start:
                        key = (-score * w, n + 1)
                        best[start, b] = min(best.get((start, b), key), key)
                    walk(start, b, score * w, n + 1)

        for i in range(9):
            walk(f"n{i}", f"n{i}", 1.0, 0)
        every = {(r.start, r.target): (-r.score, r.hops) for r in graph.expand_paths(starts, frame).collect()}
        assert every == best
        for k in (1, 3):
            want = {(s, t): best[s, t] for s in {x for x, _ in best} for _, t in sorted(((*v, t), t) for (x, t), v in best.items() if x == s)[:k]}
            assert {(r.start, r.target): (-r.score, r.hops) for r in graph.expand_paths(starts, frame, k=k).collect()} == want


def test_merge_numbers_across_ranges(spark):
    parts = [spark.range(50).select(((F.col("id") * 7) % 50).alias("id"), F.lit("a").alias("t")), spark.range(0).select("id", F.lit("b").alias("t")), spark.range(30).select("id", F.lit("c").alias("t"))]
    got = datasets.merge([p.withColumnRenamed("id", "key") for p in parts], "key").orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 81)) and [(r.t, r.key) for r in got] == [("a", i) for i in range(50)] + [("c", i) for i in range(30)]
