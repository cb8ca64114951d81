"""Chunkers as (start, end) offsets of a text, sliced and exploded by Spark."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import small_batches

Spans = list[tuple[int, int]]

# Where a fixed-size chunk is cut back to, and what a recursive one is cut at, best first.
STOPS = ["。", "！", "？", "\n"]
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", " "]
# Fixed value: the section of text before any heading.
NO_HEADING = "概述"


def occurrences(text: str, mark: str, start: int = 0, end: int | None = None) -> list[int]:
    """Offsets of a mark, none overlapping."""
    return [m.start() for m in re.compile(re.escape(mark)).finditer(text, start, len(text) if end is None else end)]


def _checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")


def fixed_size(text: str, size: int = 512, overlap: int = 50) -> Spans:
    """Windows of ``size`` characters. One that isn't the last ends after the last
    of the best kind of stop in it, its first character aside; the next begins
    ``overlap`` before that, or at it if that were no step on."""
    _checked(size, overlap)
    stops, spans, at = [occurrences(text, s) for s in STOPS], [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            last = (own[bisect_right(own, end - 1) - 1] if own and own[0] < end else -1 for own in stops)
            end = next((p + 1 for p in last if p > at), end)
        spans.append((at, end))
        at = end if end == len(text) or end - overlap <= at else end - overlap
    return spans


def _packed(text: str, start: int, end: int, mark: str, size: int, overlap: int) -> Spans:
    """The parts of a range between marks, neighbours in one span while it is
    within ``size``; the next one reaches back by ``overlap`` where that fits."""
    marks = occurrences(text, mark, start, end)
    begins, ends = [start, *(m + len(mark) for m in marks)], [*marks, end]
    spans, i, begin = [], 0, start
    while i < len(begins):
        last = max(i, bisect_right(ends, begin + size) - 1)
        spans.append((begin, ends[last]))
        i, back = last + 1, max(begin, ends[last] - overlap)
        if i < len(begins):
            reaches = overlap and ends[last] - begin <= size and ends[i] - back <= size
            begin = back if reaches else begins[i]
    return spans


def recursive(text: str, size: int = 512, overlap: int = 50, separators: tuple[str, ...] = tuple(SEPARATORS)) -> Spans:
    """One pass for each separator, coarsest first: ranges that are too long and
    have it are cut there and packed anew. What no separator cuts is cut by length."""
    _checked(size, overlap)
    spans: Spans = [(0, len(text))]
    for mark in separators:
        if all(e - s <= size for s, e in spans):
            break
        spans = [x for s, e in spans for x in (_packed(text, s, e, mark, size, overlap) if e - s > size else [(s, e)])]
    step = size - overlap
    return [x for s, e in spans for x in ([(s, e)] if e - s <= size else [(a, min(a + size, e)) for a in range(s, max(e - overlap, s + 1), step)])]


def sentences(text: str, ends: str = "。！？.!?") -> Spans:
    """Sentences: up to an end mark or a line's end, without outer blanks."""
    return [m.span() for m in re.finditer(rf"[^\s{ends}][^\n{ends}]*[{ends}]?|[{ends}]", text)]


def parent_child(text: str, per_child: int = 3, overlap: int = 1) -> Spans:
    """Children of three sentences, the last of each shared with the next."""
    own = sentences(text)
    starts = range(0, max(len(own) - overlap, 1), per_child - overlap) if own else []
    return [(own[i][0], own[min(i + per_child, len(own)) - 1][1]) for i in starts]


def sliced(text: str, spans: Spans) -> list[tuple[int, int, str]]:
    """(start, end, content) of spans, content without outer blanks; blank ones are left out."""
    return [(s, e, text[s:e].strip()) for s, e in spans if text[s:e].strip()]


def chunk_documents(docs: DataFrame, split: Callable[[str], Spans]) -> DataFrame:
    """(doc_id, text) -> (doc_id, chunk_index, start, end, content) by any chunker;
    a null or blank text has no chunks."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [{"start": s, "end": e, "content": c} for s, e, c in sliced(t, split(t))] if t else [])

    small_batches(docs.sparkSession)
    each = F.pandas_udf(run, "array<struct<start:int,end:int,content:string>>")
    return docs.select("doc_id", F.posexplode(each(F.col("text"))).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.*")


def with_parents(children: DataFrame, docs: DataFrame, per_parent: int = 4) -> DataFrame:
    """Children (doc_id, chunk_index, start, end, content) with their parent, four
    in a row, and its text: the slice from its first child to its last, so what
    children share stands once."""
    keyed = children.withColumn("parent", F.floor(F.col("chunk_index") / per_parent))
    reach = keyed.groupBy("doc_id", "parent").agg(F.min("start").alias("_s"), F.max("end").alias("_e")).join(docs.select("doc_id", "text"), "doc_id")
    parents = reach.select("doc_id", "parent", F.substring("text", F.col("_s") + 1, F.col("_e") - F.col("_s")).alias("parent_text"))
    return keyed.join(parents, ["doc_id", "parent"])


def heading_sections(text: Column) -> Column:
    """A text's sections, each from a Markdown heading to the next."""
    return F.filter(F.transform(F.split(text, r"(?m)(?=^#{1,6}\s)"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, section_index, heading, body) of sections that have a body."""
    each = docs.select("doc_id", F.posexplode(heading_sections(F.col("text"))).alias("section_index", "s"))
    heading = F.trim(F.regexp_extract("s", r"\A#{1,6}\s+([^\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("s", r"\A#{1,6}\s[^\n]*\n?", ""), r"\A\s+|\s+\z", "")
    return each.select("doc_id", "section_index", F.when(heading == "", NO_HEADING).otherwise(heading).alias("heading"), body.alias("body")).where("body != ''")


CODE = r"```[\s\S]*?```"


def code_blocks(text: Column) -> Column:
    """Fenced blocks in order."""
    return F.regexp_extract_all(text, F.lit(f"({CODE})"), F.lit(1))


def section_sentences(body: Column) -> Column:
    """Sentences of a section: fenced blocks whole, other text by stops and lines."""
    fenced = F.regexp_replace(body, CODE, "\u0001$0\u0001")

    def cut(x: Column) -> Column:
        return F.when(x.startswith("```"), F.array(x)).otherwise(F.split(x, r"(?<=[。？！\n])"))

    parts = F.flatten(F.transform(F.split(fenced, "\u0001"), cut))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")


def process_documents(docs: DataFrame, per_chunk: int = 2, split: Callable[[str], Spans] | None = None) -> DataFrame:
    """(doc_id, source, text) -> (doc_id, chunk_index, section, text): every
    section's sentences, ``per_chunk`` to a chunk, or its chunks by ``split``
    where it has more than that; each with source and section in front, counted
    through the document."""
    found = sections(docs).withColumn("s", section_sentences(F.col("body")))
    few = found if split is None else found.where(F.size("s") <= per_chunk)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("s") / per_chunk) - 1, F.lit(0)).cast("int")), lambda i: F.array_join(F.slice("s", i * per_chunk + 1, per_chunk), "\n"))
    pieces = few.select("doc_id", "section_index", "heading", F.posexplode(groups).alias("piece", "content"))
    if split is not None:
        key = F.struct("doc_id", "section_index", "heading")
        more = chunk_documents(found.where(F.size("s") > per_chunk).select(key.alias("doc_id"), F.col("body").alias("text")), split)
        pieces = pieces.unionByName(more.select("doc_id.*", F.col("chunk_index").alias("piece"), "content"))
    order = Window.partitionBy("doc_id").orderBy("section_index", "piece")
    numbered = pieces.where("trim(content) != ''").withColumn("chunk_index", F.row_number().over(order) - 1).join(docs.select("doc_id", "source"), "doc_id")
    return numbered.select("doc_id", "chunk_index", F.col("heading").alias("section"), F.concat(F.lit("["), "source", F.lit(" - "), "heading", F.lit("]\n"), "content").alias("text"))


def chunk_regions(regions: DataFrame, split: Callable[[str], Spans]) -> DataFrame:
    """(doc_id, source, pos, type, content, image) -> (doc_id, chunk_index, section,
    region_type, image, text): text regions by ``split``, tables, equations and
    figures whole, each under the last header before it, which is no chunk itself."""
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = regions.withColumn("section", F.coalesce(F.last(F.when(F.col("type") == "header", F.col("content")), ignorenulls=True).over(so_far), F.lit(""))).where("type != 'header'")
    key = F.struct("doc_id", "source", "pos", "section")
    text = chunk_documents(held.where("type = 'text'").select(key.alias("doc_id"), F.col("content").alias("text")), split)
    text = text.select("doc_id.*", F.col("chunk_index").alias("piece"), F.lit("text").alias("region_type"), F.lit(None).cast("string").alias("image"), "content")
    whole = held.where("type != 'text'").select("doc_id", "source", "pos", "section", F.lit(0).alias("piece"), F.col("type").alias("region_type"), F.when(F.col("type") == "figure", F.col("image")).alias("image"), "content")
    order = Window.partitionBy("doc_id").orderBy("pos", "piece")
    prefix = F.concat(F.lit("["), F.col("source"), F.when(F.col("section") != "", F.concat(F.lit(" - "), "section")).otherwise(""), F.lit("]\n"))
    return text.unionByName(whole).select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "section", "region_type", "image", F.concat(prefix, "content").alias("text"))


def _folded(rows: DataFrame, group: list[str], order: str, kind: str, step: Callable, start: dict) -> DataFrame:
    """Runs a fold over each group's rows in order, a sorted stream in one task
    that keeps the state of one group: (group, order, value) for every row."""
    names = [*group, order, "value"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in [*group, order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, dict(start)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                key = tuple(r[: len(group)])
                if key != held:
                    held, state = key, dict(start)
                out.append(step(state, r))
            yield batch[[*group, order]].assign(value=out)[names]

    return rows.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(run, f"{fields}, value {kind}")


def semantic_breaks(sims: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(doc_id, pos, sim to the next) -> (doc_id, pos, chunk): a chunk ends where
    the similarity is under the document's 25th percentile and it has
    ``least`` sentences, or where it has ``most``."""
    threshold = sims.groupBy("doc_id").agg(F.percentile("sim", 0.25).alias("t"))
    rows = sims.join(threshold, "doc_id").select("doc_id", "pos", F.coalesce(F.col("sim") < F.col("t"), F.lit(False)).alias("low"))

    def step(state: dict, r: tuple) -> int:
        chunk, state["size"] = state["chunk"], state["size"] + 1
        if (r.low and state["size"] >= least) or state["size"] >= most:
            state.update(chunk=chunk + 1, size=0)
        return chunk

    return _folded(rows, ["doc_id"], "pos", "int", step, {"chunk": 0, "size": 0}).withColumnRenamed("value", "chunk")


def budget_batches(rows: DataFrame, group: str, order: str, size: Column, budget: int = 4000) -> DataFrame:
    """Consecutive rows of a group in batches of at most ``budget``; a larger row
    is a batch of its own. Adds ``batch``."""

    def step(state: dict, r: tuple) -> int:
        if state["sum"] and state["sum"] + r.n > budget:
            state.update(batch=state["batch"] + 1, sum=0)
        state["sum"] += int(r.n)
        return state["batch"]

    sized = rows.select(group, order, size.cast("long").alias("n"))
    return _folded(sized, [group], order, "int", step, {"batch": 0, "sum": 0}).withColumnRenamed("value", "batch")


def pooled_embeddings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, embedding) -> mean vector of each chunk, of length 1."""
    each = chunks.select("chunk_id", F.posexplode("embedding").alias("i", "x")).groupBy("chunk_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = each.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return vectors.select("chunk_id", F.transform(F.col("v.m"), lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(x)).alias("embedding"))
