"""Operators on small literal tables."""

import io
import math
import random
import time
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import chunking, evaluation, graph, retrieval, tables, verification
from lexiloom.operators.components import connected_components
from lexiloom.sources import readers
from lexiloom.streaming import tasks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (2, 5), (None, 1)], "a long, b long")
    assert rows(connected_components(edges)) == [(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)]
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r[1] for r in rows(connected_components(chain))} == {0}
    star = spark.range(1, 200).select(F.lit(0).alias("a"), F.col("id").alias("b"))
    for few in (0, 1000):
        assert {r[1] for r in rows(connected_components(star, small_edges=few))} == {0}
        assert rows(connected_components(edges, small_edges=few)) == [(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)]
    assert connected_components(edges.where("false")).count() == 0


def test_ir_metrics(spark):
    runs = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x")], "query_id int, rank int, source string")
    qrels = spark.createDataFrame([(1, "b"), (1, "c"), (2, "y"), (3, "z")], "query_id int, source string")
    got = {r["query_id"]: r for r in evaluation.ir_metrics(runs, qrels, 3).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["recall_at_k"] == 1.0
    ideal = 1 + 1 / math.log2(3)
    assert got[1]["ndcg_at_k"] == pytest.approx((1 / math.log2(3) + 0.5) / ideal, abs=1e-6)
    assert got[1]["average_precision"] == pytest.approx((0.5 + 2 / 3) / 2, abs=1e-6)
    assert got[2]["hit_rate"] == 0.0 and got[3]["precision"] == 0.0


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.0733880), (12.7062, 1, 0.05), (0.0, 5, 1.0), (2.0452, 29, 0.05)])
def test_t_test(t, df, p):
    assert evaluation.t_test_p(t, df) == pytest.approx(p, abs=1e-5)


def test_paired_t(spark):
    pairs = spark.createDataFrame([("m", 1.0, 1.0), ("m", 2.0, 2.0), ("n", 1.0, 2.0), ("n", 2.0, 2.5), ("n", 3.0, 4.5)], "metric string, a double, b double")
    got = {r["metric"]: r for r in evaluation.paired_t(pairs, "metric").collect()}
    assert got["m"]["p_value"] == 1.0 and got["n"]["difference"] == pytest.approx(1.0)
    assert got["n"]["p_value"] == pytest.approx(0.0741799, abs=1e-5)


def test_confidence_and_gate(spark):
    hits = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 12, 0.7, 3), (2, 10, 0.2, 1)], "query_id int, doc_id int, score double, rank int")
    got = {r["query_id"]: r for r in retrieval.confidence(hits).collect()}
    assert not got[1]["needs_refetch"] and got[2]["needs_refetch"]
    assert rows(retrieval.relevance_gate(hits, 0.75, 2).select("query_id", "doc_id")) == [(1, 10), (1, 11), (2, 10)]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 1.0, 1), (1, 2, 0.5, 2)], "query_id int, doc_id int, score double, rank int")
    b = spark.createDataFrame([(1, 2, 1.0, 1), (1, 3, 0.5, 2)], "query_id int, doc_id int, score double, rank int")
    assert [r["doc_id"] for r in retrieval.rrf([(a, 0.5), (b, 0.5)], 3).orderBy("rank").collect()] == [2, 1, 3]
    with pytest.raises(ValueError):
        retrieval.blend(a, b, 0.6, 0.6)


def test_text_functions(spark):
    df = spark.createDataFrame([("如何部署?",), ("hello there",), ("ok",), ("f()",), ("为什么 A，B；C 比 D、E 和 F 更快，请分析它们的底层机制与实现原理差异以及利弊",)], "q string")
    got = df.select(T.intent(F.col("q"))["intent_type"], T.complexity(F.col("q")), T.is_small_talk(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [("procedural", "simple", False), ("factoid", "simple", True), ("factoid", "simple", True), ("factoid", "medium", False), ("analytical", "complex", False)]
    cited = spark.createDataFrame([("发布于[2020年修订] 见[3, 第二节 [ 4]",), ("参考 7 见[12] 【来源 3】[来源 5][5] [99999999999]",), (None,)], "a string").select(T.citations(F.col("a")), T.citation_marks(F.col("a"))).collect()
    assert cited[0][0] == [] == cited[0][1] and cited[1][0] == [5, 12, None, 3, 7] and cited[2][0] is None
    assert [tuple(x) for x in cited[1][1]][:2] == [(5, "[来源 5]", 17), (12, "[12]", 6)]
    one = spark.createDataFrame([("see [2] and [来源 1] [2]", 'x ```json\n{"a": 1}\n``` y')], "a string, j string")
    assert one.select(T.citations(F.col("a"))).first()[0] == [1, 2]
    assert one.select(T.lenient_json(F.col("j"), "a int")["a"]).first()[0] == 1
    kept = spark.range(1).select(T.greedy_distinct(F.array(F.lit("a b c"), F.lit("a b c d"), F.lit("x y")))).first()[0]
    assert kept == ["a b c", "x y"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n。", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunkers_end_bound_and_cover(text, size, overlap):
    for split in (chunking.fixed_size, chunking.recursive):
        spans = split(text, size, overlap)
        chunks = [c for _, _, c in chunking.sliced(text, spans)]
        assert all(0 < e - s <= size for s, e in spans if s < e) and bool(chunks) == bool(text.strip())
        covered = {i for s, e in spans for i in range(s, e)}
        marks = set("".join(chunking.SEPARATORS))
        assert all(i in covered or text[i] in marks for i in range(len(text)))
        assert [s for s, _ in spans] == sorted(s for s, _ in spans)
    spans = chunking.parent_child(text)
    assert bool(spans) == bool(text.strip())


def test_chunkers_by_example():
    text = "一二三四五。六七八九十！甲乙丙丁"
    assert [c for *_, c in chunking.sliced(text, chunking.fixed_size(text, 10, 2))] == ["一二三四五。", "五。", "六七八九十！甲乙丙丁"]
    text = "aa bb\n\ncc dd ee ff\ngg"
    assert [c for *_, c in chunking.sliced(text, chunking.recursive(text, 8, 0))] == ["aa bb", "cc dd ee", "ff", "gg"]
    assert [c for *_, c in chunking.sliced(text, chunking.recursive(text, 8, 3))] == ["aa bb", "cc dd ee", "ee ff", "gg"]
    assert chunking.recursive("x" * 20, 8, 2) == [(0, 8), (6, 14), (12, 20)]
    assert [text[s:e] for text in ["A. B! C? D"] for s, e in chunking.parent_child(text)] == ["A. B! C?", "C? D"]
    for bad in (chunking.fixed_size, chunking.recursive):
        with pytest.raises(ValueError):
            bad("x", 5, 5)


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "s", "# A\nx\n## B\ny"), (2, "s", None), (3, "s", "  ")], "doc_id int, source string, text string")
    assert docs.where("doc_id = 1").select(chunking.heading_sections(F.col("text"))).first()[0] == ["# A\nx", "## B\ny"]
    assert rows(chunking.chunk_documents(docs, chunking.recursive)) == [(1, 0, 0, 12, "# A\nx\n## B\ny")]
    sized = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([30, 30, 50, 10, 200])], "g int, o int, t string")
    got = chunking.budget_batches(sized, "g", "o", F.char_length("t"), 80)
    assert [r["batch"] for r in got.orderBy("o").collect()] == [0, 0, 1, 1, 2]
    lines = spark.createDataFrame([(1, "A one. B two. C three. D four. E five. F six. G seven. H eight. I nine. J ten.")], "doc_id int, text string")
    got = chunking.with_parents(chunking.chunk_documents(lines, chunking.parent_child), lines).orderBy("chunk_index").collect()
    assert [r["content"] for r in got] == ["A one. B two. C three.", "C three. D four. E five.", "E five. F six. G seven.", "G seven. H eight. I nine.", "I nine. J ten."]
    assert [r["parent"] for r in got] == [0, 0, 0, 0, 1] and got[1]["parent_text"] == lines.first()["text"][:-7] and got[4]["parent_text"] == "I nine. J ten."


def test_document_pipeline(spark):
    text = "intro one。\n# A\nfirst。second！\nthird\n```\na。b\n```\n# B\n\n## C\nlast"
    docs = spark.createDataFrame([(1, "f.md", text), (2, "g.md", None)], "doc_id int, source string, text string")
    assert [tuple(r) for r in chunking.sections(docs).select("heading", "body").collect()] == [("概述", "intro one。"), ("A", "first。second！\nthird\n```\na。b\n```"), ("C", "last")]
    got = chunking.process_documents(docs).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["section"], r["text"]) for r in got] == [(0, "概述", "[f.md - 概述]\nintro one。"), (1, "A", "[f.md - A]\nfirst。\nsecond！"), (2, "A", "[f.md - A]\nthird\n```\na。b\n```"), (3, "C", "[f.md - C]\nlast")]
    got = chunking.process_documents(docs, 2, chunking.recursive).orderBy("chunk_index").collect()
    assert [r["section"] for r in got] == ["概述", "A", "C"] and got[1]["text"].endswith("```\na。b\n```")
    regions = [(1, "d", 0, "text", "before", None), (1, "d", 1, "header", "H", None), (1, "d", 2, "text", "one. two.", None), (1, "d", 3, "table", "| a |", "x"), (1, "d", 4, "figure", "pic", "p.png"), (2, "e", 0, "equation", "x=y", None)]
    got = chunking.chunk_regions(spark.createDataFrame(regions, "doc_id int, source string, pos int, type string, content string, image string"), chunking.recursive)
    assert [tuple(r) for r in got.orderBy("doc_id", "chunk_index").collect()] == [(1, 0, "", "text", None, "[d]\nbefore"), (1, 1, "H", "text", None, "[d - H]\none. two."), (1, 2, "H", "table", None, "[d - H]\n| a |"), (1, 3, "H", "figure", "p.png", "[d - H]\npic"), (2, 0, "", "equation", None, "[e]\nx=y")]


def test_graph(spark):
    e = spark.createDataFrame([(1, " Ann ", "p", "likes tea", "c1"), (2, "ann", "q", "tea", "c2"), (3, "ANN", "p", "walks", "c1")], "ord int, name string, type string, description string, source_id string")
    assert rows(graph.merge_entities(e)) == [("ann", " Ann ", "p", "likes tea<SEP>walks", ["c1", "c2"])]
    r = spark.createDataFrame([(1, "b", "a", 2, "x", ["k"]), (2, "a", "b", None, "is Unrelated", ["z"]), (3, "a", "b", None, "y", ["j"])], "ord int, source string, target string, weight int, description string, keywords array<string>")
    assert rows(graph.merge_relations(r)) == [("a", "b", 3, "x<SEP>y", ["j", "k"])]
    names = spark.createDataFrame([("t", x) for x in ("spark", "sparks", "spork", "flink", "民法典条例", "民法典条例例")], "type string, name string")
    assert {tuple(x)[1:] for x in graph.entity_candidates(names).collect()} == {("spark", "sparks"), ("spark", "spork"), ("sparks", "spork"), ("民法典条例", "民法典条例例")}
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("a", "c", 0.3), ("c", "a", 1.0)], "source string, target string, weight double")
    got = {x["target"]: (round(x["score"], 6), x["hops"]) for x in graph.expand_paths(spark.createDataFrame([("a",)], "name string"), edges).collect()}
    assert got == {"b": (0.9, 1), "c": (0.45, 2)}
    ranks = {x["node"]: x["rank"] for x in graph.pagerank(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int"), 30).collect()}
    assert sum(ranks.values()) == pytest.approx(1) and max(ranks, key=ranks.get) == 1
    asked = spark.createDataFrame([(1, "What does big data law say?"), (2, "bigdata")], "query_id int, query string")
    aliases = spark.createDataFrame([("Big Data", "BD"), ("law", "L")], "alias string, canonical string")
    assert rows(graph.resolve_aliases(asked, aliases)) == [(1, "big data", "BD"), (1, "law", "L")]


def test_entity_candidates_equal_all_pairs(spark):
    rng = random.Random(1)
    names = {("t", "".join(rng.choice("ab民法典条例规") for _ in range(rng.randint(1, 6)))) for _ in range(250)} | {("t", "abcde"), ("t", "abcde法"), ("u", "abcde")}
    df = spark.createDataFrame(sorted(names), "type string, name string")
    zh = lambda x: any("一" <= c <= "鿿" for c in x)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    def alike(a, b):
        return len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) if zh(a) or zh(b) else edits(a, b) <= 2

    want = {(t, a, b) for t, a in names for u, b in names if t == u and a < b and alike(a, b)}
    assert set(rows(graph.entity_candidates(df))) == want and ("t", "abcde", "abcde法") in want


def test_chinese(spark):
    """Text without blanks is found: by search, by alias and by the names of laws."""
    queries = [(1, "数据安全法有什么规定？"), (2, "劳动合同法适用于哪些情形？"), (3, "今天天气怎么样？"), (4, "中华人民共和国民法典实施细则（2020）是什么")]
    asked = spark.createDataFrame(queries, "query_id int, query string")
    aliases = spark.createDataFrame([("数据安全法", "中华人民共和国数据安全法"), ("劳动合同法", "中华人民共和国劳动合同法"), ("合同法", "合同法")], "alias string, canonical string")
    assert {(q, c) for q, _, c in rows(graph.resolve_aliases(asked, aliases))} == {(1, "中华人民共和国数据安全法"), (2, "中华人民共和国劳动合同法"), (2, "合同法")}
    assert (4, "中华人民共和国民法典实施细则（2020）") in rows(graph.resolve_entities(asked, aliases))
    docs = spark.createDataFrame([(1, "本规定依据数据安全法制定，Spark SQL 3"), (2, "天气很好"), (3, None)], "doc_id int, text string")
    assert docs.where("doc_id = 1").select(T.tokens(F.col("text"))).first()[0] == [*"本规定依据数据安全法制定", "spark", "sql", "3"]
    assert [(r["query_id"], r["doc_id"]) for r in retrieval.bm25(docs, asked, 1).orderBy("query_id").collect()] == [(1, 1)]
    assert retrieval.bm25(docs, asked.where("false"), 3).count() == 0 and retrieval.bm25(docs.where("false"), asked, 3).count() == 0


def test_tables(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "f string, h string")
    b = spark.createDataFrame([("y", "1"), ("z", "2"), ("w", "1")], "f string, h string")
    assert rows(tables.change_detection(a, b, "f", "h")) == [("w", "added"), ("x", "deleted"), ("y", "unchanged"), ("z", "modified")]
    assert rows(tables.upsert(a, b, ["f"])) == [("w", "1"), ("x", "1"), ("y", "1"), ("z", "2")]
    assert rows(tables.delete_where(a, {"f": ["x", "y"]})) == [("z", "1")]
    d, m, e = tables.delete_source(spark.createDataFrame([("s1",), ("s2",)], "source string"), spark.createDataFrame([("s1", "p"), ("s2", "q")], "source string, name string"), spark.createDataFrame([("p",), ("q",)], "name string"), spark.createDataFrame([("s1",)], "source string"))
    assert rows(d) == [("s2",)] and rows(m) == [("s2", "q")] and rows(e) == [("q",)]


def test_verification(spark):
    answers = spark.createDataFrame([(1, "spark joins tables。nothing known here at all")], "answer_id int, answer string")
    contexts = spark.createDataFrame([(1, "spark joins big tables")], "answer_id int, text string")
    got = verification.claim_support(answers, contexts).first()
    assert (got["claims"], got["supported"]) == (2, 1)


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    page = "<html><nav>no</nav><body><p>out</p><article><h2>T</h2><p>a <b>b</b></p><pre>x  y</pre><script>no</script></article></body></html>"
    assert readers.html_text(page) == "## T\n\na b\n\n```\nx  y\n```"
    assert readers.csv_text(b"a,b\n1\n\n2,3,4\n").splitlines()[2:] == ["| 1 |  |", "| 2 | 3 |"]
    assert readers.json_text(b'{"a": {"b": [1, null]}, "c": []}') == "a.b[0]: 1\na.b[1]: None\nc: []"
    assert readers.decode("你好".encode("gbk")) == "你好"
    assert readers.docx_text(archive(word__document_xml="<d xmlns:w='w'><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></d>")) == "one\ntwo"
    book = archive(xl__workbook_xml="<w><sheets><sheet name='S'/></sheets></w>", xl__sharedStrings_xml="<s><si><t>h</t></si></s>", xl__worksheets__sheet1_xml="<w><row><c r='A1' t='s'><v>0</v></c><c r='B1'><v>2</v></c></row><row><c r='B2'><v>5</v></c></row></w>")
    assert readers.xlsx_text(book) == "## S\n\n| h | 2 |\n| --- | --- |\n|  | 5 |"
    (tmp_path / "a.txt").write_text("hi")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.xyz").write_bytes(b"?")
    got = {r["extension"]: r for r in readers.read_texts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["txt"]["text"] == "hi" and "BadZipFile" in got["docx"]["error"] and "unsupported" in got["xyz"]["error"]
    assert readers.directory_state(spark, str(tmp_path)).count() == 3


def test_task_stream(spark, tmp_path):
    messages = [("t1", "b", "started", 1.0, 0, None), ("t1", "b", "completed", 2.0, 7, None), ("t2", "b", "started", 1.0, 0, None), ("t2", "b", "failed", 2.0, 0, "boom")]
    schema = "task_id string, batch_id string, event string, at double, chunks int, error string"
    spark.createDataFrame(messages, schema).write.parquet(str(tmp_path / "in"))
    query = tasks.task_states(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(40):  # timers keep such a query from ending by itself
        if spark.table("states").count() >= 2 or not query.isActive:
            break
        time.sleep(1)
    query.stop()
    got = {r["task_id"]: r for r in spark.table("states").collect()}
    assert (got["t1"]["status"], got["t1"]["chunks"]) == ("completed", 7)
    assert (got["t2"]["status"], got["t2"]["retry"], got["t2"]["error"]) == ("pending", 1, "boom")


def test_windows_stream(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 600) as ts, 'x' as event_type, cast(id as double) as value from range(12)")
    events.write.parquet(str(tmp_path / "in"))
    stream = tasks.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour", late="10 minutes")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert rows(spark.table("windows").select("n", "total")) == [(6, 15.0), (6, 51.0)]
