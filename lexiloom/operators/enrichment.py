"""What models add to chunks: extraction, tags, keywords, summaries. A model is a
function of a batch of prompts; what it replies is read by Spark's functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import entity_lines, lenient_json, match_tags, positive_counts, relation_lines, split_keywords
from lexiloom.operators.graph import PREDICATES
from lexiloom.session import materialize

Model = Callable[[list[str]], list[str]]
# Kinds of entities that are kept.
ENTITY_TYPES = ["Law", "Organization"]
REGION_TYPES = ["text", "table", "figure", "equation", "header"]


def replies(prompts: DataFrame, model: Model) -> DataFrame:
    """(prompt) -> (prompt, reply) for each distinct prompt that isn't null, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"prompt": batch["prompt"], "reply": model(batch["prompt"].tolist())})

    return prompts.select("prompt").where("prompt is not null").distinct().mapInPandas(run, "prompt string, reply string")


def asked(rows: DataFrame, prompt: Column, model: Model) -> DataFrame:
    """``rows`` with the model's reply to each row's prompt."""
    marked = rows.withColumn("prompt", prompt)
    return marked.join(replies(marked, model), "prompt", "left").drop("prompt")


def extract(chunks: DataFrame, model: Model, prompt: str = "{text}", more: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, text) -> entities and relations that a model's replies list line
    by line, with up to ``more`` further rounds that get the replies so far."""
    said = asked(chunks.select("chunk_id", "text"), F.replace(F.lit(prompt), F.lit("{text}"), F.col("text")), model)
    said = said.withColumn("reply", F.coalesce("reply", F.lit("")))
    for _ in range(more):
        again = asked(said.withColumnRenamed("reply", "so_far"), F.concat("text", F.lit("\n"), "so_far"), model)
        said = again.select("chunk_id", "text", F.concat_ws("\n", "so_far", "reply").alias("reply"))
    entities = said.select(F.col("chunk_id").alias("source_id"), F.inline(entity_lines(F.col("reply")))).distinct()
    relations = said.select(F.col("chunk_id").alias("source_id"), F.inline(relation_lines(F.col("reply")))).distinct()
    return entities, relations


def extract_json(chunks: DataFrame, entity_model: Model, relation_model: Model, most: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Two steps with JSON replies: entities of the kept kinds, then relations
    between them of known predicates; the model sees ``most`` characters of a chunk."""
    head = F.left("text", F.lit(most))
    said = asked(chunks.select("chunk_id", "text"), head, entity_model)
    listed = "array<struct<name:string,type:string,aliases:array<string>>>"
    e = said.select("chunk_id", F.explode(_json_array(F.col("reply"), listed)).alias("e")).select("chunk_id", F.trim("e.name").alias("name"), "e.type", F.transform(F.coalesce("e.aliases", F.array().cast("array<string>")), lambda a: F.trim(a)).alias("aliases"))
    e = e.where(F.col("type").isin(ENTITY_TYPES) & (F.col("name") != ""))
    known = e.groupBy("chunk_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "type")))).alias("known"))
    second = asked(chunks.select("chunk_id", "text").join(known, "chunk_id"), F.concat("known", F.lit("\n"), head), relation_model)
    r = second.select("chunk_id", F.explode(_json_array(F.col("reply"), "array<struct<subject:string,predicate:string,object:string>>")).alias("r")).select("chunk_id", F.trim("r.subject").alias("subject"), "r.predicate", F.trim("r.object").alias("object"))
    return e, r.where(F.col("predicate").isin(list(PREDICATES)) & (F.col("subject") != "") & (F.col("object") != ""))


def _json_array(reply: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), schema)


def name_mentions(chunks: DataFrame, pattern: str, kind: str, least: int = 2) -> DataFrame:
    """(chunk_id, text) -> (chunk_id, pos, name, type) by a pattern, names of two characters or more."""
    each = chunks.select("chunk_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("pos", "name"))
    return each.where(F.char_length("name") >= least).withColumn("type", F.lit(kind))


def confirm_pairs(pairs: DataFrame, model: Model, batch: int = 100) -> DataFrame:
    """Candidate pairs (type, a, b) that a model confirms: prompts of up to ``batch``
    numbered pairs each, replies a JSON list of the numbers that are the same."""
    order = Window.partitionBy("type", "_g").orderBy("a", "b")
    sizes = pairs.groupBy("type").agg(F.count("*").alias("_n"))
    grouped = pairs.join(sizes, "type").withColumn("_g", F.pmod(F.xxhash64("a", "b"), F.greatest(F.lit(1), F.ceil(2 * F.col("_n") / batch)))).withColumn("_i", F.row_number().over(order) - 1)
    grouped = grouped.withColumns({"_g2": F.floor(F.col("_i") / batch), "_i": F.col("_i") % batch})
    prompts = grouped.groupBy("type", "_g", "_g2").agg(F.array_sort(F.collect_list(F.struct("_i", F.concat(F.col("_i").cast("string"), F.lit(": "), "a", F.lit(" = "), "b").alias("t")))).alias("l"))
    said = asked(prompts, F.array_join(F.col("l.t"), "\n"), model)
    same = said.select("type", "_g", "_g2", F.explode(_json_array(F.col("reply"), "array<int>")).alias("_i")).distinct()
    return grouped.join(same, ["type", "_g", "_g2", "_i"], "left_semi").select("type", "a", "b")


def tag_chunks(chunks: DataFrame, tags: list[str], model: Model, examples: int = 2, most: int = 3) -> DataFrame:
    """(chunk_id, text) -> (chunk_id, tags map): tags that a text contains weigh 8;
    for texts with none a model is asked, shown two tagged ones, and its counts
    over 0 are kept."""
    contained = F.transform(match_tags(F.col("text"), tags, most), lambda t: F.struct(t.alias("key"), F.lit(8).alias("value")))
    first = chunks.select("chunk_id", "text", F.map_from_entries(contained).alias("tags"))
    shown = first.where(F.size("tags") > 0).orderBy("chunk_id").limit(examples).select(F.concat("text", F.lit(" -> "), F.to_json("tags")).alias("s"))
    prefix = shown.agg(F.array_join(F.array_sort(F.collect_list("s")), "\n").alias("shown"))
    rest = first.where(F.size("tags") == 0).drop("tags").join(F.broadcast(prefix))
    said = asked(rest, F.concat_ws("\n", "shown", "text"), model)
    return first.where(F.size("tags") > 0).select("chunk_id", "tags").unionByName(said.select("chunk_id", positive_counts(F.col("reply")).alias("tags")))


def tag_rows(lines: DataFrame) -> DataFrame:
    """(content, tags) of a tag file -> (content, tag): comma lists, dots in tags become underscores."""
    return lines.select("content", F.explode(split_keywords(F.replace("tags", F.lit("."), F.lit("_")))).alias("tag")).distinct()


def keywords(chunks: DataFrame, model: Model, most: int = 1000) -> DataFrame:
    """(chunk_id, keywords) of replies that part them by commas; the model sees ``most`` characters."""
    said = asked(chunks.select("chunk_id", "text"), F.left("text", F.lit(most)), model)
    return said.select("chunk_id", split_keywords(F.coalesce("reply", F.lit(""))).alias("keywords"))


def metadata(chunks: DataFrame, model: Model, schema: str, most: int = 1000) -> DataFrame:
    """(chunk_id, ...) of the fields of JSON replies; null where a reply can't be read."""
    said = asked(chunks.select("chunk_id", "text"), F.left("text", F.lit(most)), model)
    return said.select("chunk_id", lenient_json(F.col("reply"), schema).alias("m")).select("chunk_id", "m.*")


def regions(pages: DataFrame, model: Model, short: int = 200) -> DataFrame:
    """(doc_id, page, text, image) -> (doc_id, page, pos, type, content, confidence):
    a page of over 200 characters is one text region; of others the model tells
    regions (JSON, or JSON in a fence); a reply that is neither is text of
    confidence 0.5. Unknown types are left out, a missing confidence is 0.5."""
    told = "regions array<struct<type:string,content:string,confidence:string>>"
    long = pages.where(F.char_length(F.coalesce("text", F.lit(""))) >= short).select("doc_id", "page", F.lit(0).alias("pos"), F.lit("text").alias("type"), F.col("text").alias("content"), F.lit(1.0).alias("confidence"))
    said = asked(pages.where(F.char_length(F.coalesce("text", F.lit(""))) < short), F.col("image"), model)
    parsed = lenient_json(F.col("reply"), told)["regions"]
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("reply").alias("content"), F.lit("0.5").alias("confidence")))
    each = said.select("doc_id", "page", F.posexplode(F.coalesce(parsed, plain)).alias("pos", "r"))
    confidence = F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.5))
    return long.unionByName(each.where(F.col("r.type").isin(REGION_TYPES)).select("doc_id", "page", "pos", "r.type", "r.content", confidence.alias("confidence")))


def needs_recognition(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, page, text) -> (doc_id, scanned): whether a document has under 50 characters a page."""
    size = F.avg(F.char_length(F.trim(F.coalesce("text", F.lit("")))))
    return pages.groupBy("doc_id").agg((size < least).alias("scanned"))


# ---- a tree of summaries


def mixture(x: np.ndarray, k: int, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Groups of a diagonal Gaussian mixture by EM, and its BIC. Starts are the
    rows farthest from those before."""
    n, d = x.shape
    starts = [int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))]
    while len(starts) < k:
        starts.append(int(np.argmax(np.min([((x - x[s]) ** 2).sum(1) for s in starts], axis=0))))
    mean, var, share = x[starts].copy(), np.tile(x.var(0) + 1e-6, (k, 1)), np.full(k, 1 / k)
    log_p = np.zeros((n, k))
    for _ in range(rounds):
        log_p = np.log(share) - 0.5 * (np.log(2 * np.pi * var).sum(1) + ((x[:, None, :] - mean) ** 2 / var).sum(2))
        top = log_p.max(1, keepdims=True)
        r = np.exp(log_p - top)
        r /= r.sum(1, keepdims=True)
        weight = r.sum(0) + 1e-9
        share, mean = weight / weight.sum(), (r.T @ x) / weight[:, None]
        var = (r.T @ x**2) / weight[:, None] - mean**2
        var = np.maximum(var, 1e-6)
    likelihood = float((top[:, 0] + np.log(np.exp(log_p - top).sum(1))).sum())
    return log_p.argmax(1), -2 * likelihood + (k * 2 * d + k - 1) * np.log(n)


def best_groups(x: np.ndarray, most: int = 8) -> np.ndarray:
    """The grouping of least BIC among up to ``most`` groups."""
    if len(x) < 3:
        return np.zeros(len(x), int)
    return min((mixture(x, k) for k in range(1, min(most, len(x) - 1) + 1)), key=lambda f: f[1])[0]


def summary_tree(nodes: DataFrame, encode: Callable[[list[str]], np.ndarray], summarize: Model, depth: int = 3, collapse: int = 8, block: int = 400) -> DataFrame:
    """(doc_id, node, text) -> the nodes of all levels (doc_id, level, node, parent,
    text): each level's nodes are grouped within their document by their
    vectors, and every group of two or more gets a summary that is a node of the
    next. A document of over ``block`` nodes is grouped in blocks of neighbours.
    It ends at ``depth`` levels, at one node, or where nothing is grouped."""

    def grouped(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        return part[["doc_id", "node", "text"]].assign(g=best_groups(np.asarray(encode(part["text"].tolist()), float), collapse) + key[1] * collapse)

    kind = nodes.schema["doc_id"].dataType.simpleString()
    level = nodes.select("doc_id", F.col("node").cast("long").alias("node"), "text")
    levels: list[DataFrame] = []
    for i in range(depth):
        at = F.row_number().over(Window.partitionBy("doc_id").orderBy("node")) - 1
        blocked = level.withColumn("b", F.floor(at / block))
        found = materialize(blocked.groupBy("doc_id", "b").applyInPandas(grouped, f"doc_id {kind}, node long, text string, g long"), f"summary-level-{i}")
        sizes = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("g").alias("groups")).where("groups < n")
        parents = found.join(sizes.select("doc_id"), "doc_id", "left_semi")
        joined = parents.groupBy("doc_id", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "text"))), lambda x: x["text"]), "\n").alias("t"))
        said = materialize(asked(joined, F.col("t"), summarize).select("doc_id", F.col("g").alias("node"), F.col("reply").alias("text")), f"summary-nodes-{i}")
        marked = found.join(sizes.select("doc_id", F.lit(True).alias("goes_on")), "doc_id", "left")
        levels.append(marked.select("doc_id", F.lit(i).alias("level"), "node", F.when(F.col("goes_on"), F.col("g")).alias("parent"), "text"))
        level = said
        if level.isEmpty():
            break
    levels.append(level.select("doc_id", F.lit(len(levels)).alias("level"), "node", F.lit(None).cast("long").alias("parent"), "text"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out
