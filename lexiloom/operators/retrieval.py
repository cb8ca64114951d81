"""Search, fusion and what follows a search, as joins and windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import tokens
from lexiloom.operators.tables import condition
from lexiloom.session import materialize, spread

K1, B = 1.2, 0.75
RRF_K = 60
NO_TERM = ""
QUERY_BYTES = 32 << 20
BLOCK_ROWS = 20_000
QUERY_ROWS, VECTOR_ROWS = 1000, 1000
MEMBER_ROWS = 2000
PAIR_ROWS = 8_000_000
HITS = "query_id long, doc_id long, score double"


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, least_match: float = 0.7) -> DataFrame:
    """(doc_id, text) and (query_id, query) -> (query_id, doc_id, matched, score, rank), by ``tokens``."""
    sized = spread(docs.select("doc_id", "text")).select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    return bm25_terms(sized, queries.select("query_id", tokens(F.col("query")).alias("terms")), k, least_match)


def bm25_terms(docs: DataFrame, queries: DataFrame, k: int = 10, least_match: float = 0.7) -> DataFrame:
    """(doc_id, terms) and (query_id, terms) -> (query_id, doc_id, matched, score, rank).

    One pass over the documents: only query terms leave the tokenised scan, and
    for every document one empty term, whose postings are the number of
    documents and their lengths. Counts are summed before they meet the queries,
    and these postings, all that is read again, are written. They are dealt by
    document, so that pairs of a query and a document, which are many more, are
    summed and ranked where they arise, some PAIR_ROWS of a query's term and a
    posting in a task. A hit matches at least ``least_match`` of
    the query's distinct terms, rounded down. Which side is broadcast is left to
    Spark, which knows the size of the queries' terms, since they are written too.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    needed = wanted.groupBy("query_id").agg(F.floor(F.count("*") * least_match).alias("needed"))
    every = queries.select(F.lit(NO_TERM).alias("term")).limit(1)
    each = docs.select("doc_id", F.size("terms").alias("length"), F.explode(F.array_append("terms", F.lit(NO_TERM))).alias("term"))
    postings = each.join(wanted.select("term").union(every).distinct(), "term", "left_semi").groupBy("term", "doc_id", "length").agg(F.count("*").alias("tf"))
    postings = materialize(postings, "postings")
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    whole = df.where(F.col("term") == NO_TERM).select(F.col("df").alias("n"), "mean")
    idf = df.where(F.col("term") != NO_TERM).drop("mean").join(F.broadcast(whole)).select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf"), "mean")
    asked = materialize(wanted.join(idf, "term"), "query-terms")
    pairs = asked.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIR_ROWS))
    met = postings.where(F.col("term") != NO_TERM).repartition(parts, "doc_id").join(asked.drop("df"), "term")
    weight = F.col("idf") * saturation(F.col("tf"), F.col("length"), F.col("mean"))
    scored = met.groupBy("query_id", "doc_id").agg(F.count("*").alias("matched"), F.round(F.sum(weight), 6).alias("score"))
    scored = scored.join(needed, "query_id").where(F.col("matched") >= F.col("needed")).drop("needed")
    return top_k(scored, k)


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(terms) -> term, df, cf: documents with a term and its occurrences. Each
    document's terms are sorted, so the first of equal ones counts for df."""
    ordered = docs.where(F.size("terms") > 0).select(F.array_sort("terms").alias("t"))
    flagged = F.transform("t", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (x != F.get(F.col("t"), i - 1))).cast("long").alias("first")))
    return ordered.select(F.inline(flagged)).groupBy("term").agg(F.sum("first").alias("df"), F.count("*").alias("cf"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    """What a term's frequency counts for in a document of that length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def top_k(scored: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """Rows of each query by score, ties by doc_id; adds rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > offset) & (F.col("rank") <= offset + k))


def _best(found: tuple[np.ndarray, np.ndarray], q: np.ndarray, docs: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) by query of the best ``k`` so far, with those among more vectors."""
    norm, length = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1, keepdims=True)
    score = np.round((q / np.where(length == 0, 1, length)) @ v.T / np.where(norm == 0, 1, norm), 6)
    ids = np.broadcast_to(docs, score.shape)
    if found[1].size:
        ids, score = np.hstack([found[0], ids]), np.hstack([found[1], score])
    order = np.lexsort((ids, -score))[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _hits(ids: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(ids, found[1].shape[1]), "doc_id": found[0].ravel(), "score": found[1].ravel()})


def best_in_groups(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, doc_id, embedding) and (keys, query_id, embedding) -> query_id,
    doc_id, score: the best ``k`` of each query in each group by exact cosine. A
    group is held by one task: keys are to bound it."""

    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(v):
            docs, rows = v["doc_id"].to_numpy(), _matrix(v["embedding"])
            for at in range(0, len(q), QUERY_ROWS):
                part = q.iloc[at : at + QUERY_ROWS]
                found, asked = (np.zeros((0, 0), np.int64), np.zeros((0, 0))), _matrix(part["embedding"])
                for i in range(0, len(rows), VECTOR_ROWS):
                    found = _best(found, asked, docs[i : i + VECTOR_ROWS], rows[i : i + VECTOR_ROWS], k)
                parts.append(_hits(part["query_id"].to_numpy(), found))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, HITS)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, most_broadcast: int = QUERY_BYTES) -> DataFrame:
    """(doc_id, embedding) and (query_id, embedding) -> (query_id, doc_id, score,
    rank): exact cosine; a zero vector scores 0. Queries of up to
    ``most_broadcast`` bytes are broadcast, and a task keeps the best k of its
    rows for each of them. More stay in Spark: blocks of queries meet blocks of
    vectors, each some tens of thousands of rows, and a pair of blocks keeps its best."""
    asked = queries.select("query_id", "embedding")
    n, width = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n * (width or 0) * 8 > most_broadcast:
        return top_k(_block_knn(vectors, asked, n, k), k)
    part = asked.toPandas()
    shared = vectors.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), _matrix(part["embedding"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros((0, 0), np.int64), np.zeros((0, 0)))] * -(-len(ids) // QUERY_ROWS)
        for batch in batches:
            if len(batch):
                docs, v = batch["doc_id"].to_numpy(), _matrix(batch["embedding"])
                for at in range(0, len(docs), VECTOR_ROWS):
                    best = [_best(b, q[QUERY_ROWS * i : QUERY_ROWS * (i + 1)], docs[at : at + VECTOR_ROWS], v[at : at + VECTOR_ROWS], k) for i, b in enumerate(best)]
        for i, found in enumerate(best):
            if found[1].size:
                yield _hits(ids[QUERY_ROWS * i : QUERY_ROWS * (i + 1)], found)

    return top_k(vectors.select("doc_id", "embedding").mapInPandas(run, HITS), k)


def _block_knn(vectors: DataFrame, queries: DataFrame, n: int, k: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Every block of vectors meets every block of queries: blocks, not rows, are paired."""
    v_blocks, q_blocks = -(-vectors.count() // block), -(-n // block)

    def dealt(df: DataFrame, key: str, name: str, blocks: int) -> DataFrame:
        return df.withColumn(name, F.pmod(F.xxhash64(key, "embedding"), F.lit(max(1, blocks))).cast("int"))

    def each(name: str, blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))).alias(name)

    v = dealt(vectors.select("doc_id", "embedding"), "doc_id", "v_block", v_blocks).select("*", each("q_block", q_blocks))
    q = dealt(queries, "query_id", "q_block", q_blocks).select("*", each("v_block", v_blocks))
    return best_in_groups(v, q, ["v_block", "q_block"], k)


def weighted_sum(text: DataFrame, vector: DataFrame, text_weight: float, vector_weight: float, k: int) -> DataFrame:
    """Hits of both legs (query_id, doc_id, score), missing scores 0."""
    both = text.select("query_id", "doc_id", F.col("score").alias("a")).join(vector.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"], "full_outer")
    scored = both.select("query_id", "doc_id", F.round(text_weight * F.coalesce("a", F.lit(0.0)) + vector_weight * F.coalesce("b", F.lit(0.0)), 8).alias("score"))
    return top_k(scored, k)


def rrf(legs: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked hits (query_id, doc_id, rank)."""
    parts = [df.select("query_id", "doc_id", (w / (RRF_K + F.col("rank"))).alias("s")) for df, w in legs]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    return top_k(union.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score")), k)


def source_cap(hits: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` hits of each source of a query, ranked anew."""
    within = Window.partitionBy("query_id", "source").orderBy("rank")
    again = Window.partitionBy("query_id").orderBy("rank")
    kept = hits.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("rank", F.row_number().over(again))


def relevance_gate(hits: DataFrame, threshold: float, k: int) -> DataFrame:
    """Only passing hits where a query has over k hits and k of them pass."""
    w = Window.partitionBy("query_id")
    counted = hits.withColumns({"_n": F.count("*").over(w), "_p": F.sum((F.col("score") >= threshold).cast("int")).over(w)})
    return counted.where(~((F.col("_n") > k) & (F.col("_p") >= k)) | (F.col("score") >= threshold)).drop("_n", "_p")


def blend(a: DataFrame, b: DataFrame, weight_a: float = 0.6, weight_b: float = 0.4) -> DataFrame:
    """Two rerankers' scores (query_id, doc_id, score), joined by document."""
    if abs(weight_a + weight_b - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    return weighted_sum(a, b, weight_a, weight_b, 1 << 30)


def confidence(hits: DataFrame, threshold: float = 0.6, least_docs: int = 3) -> DataFrame:
    """(query_id, score) -> confidence of each query's hits and whether to search again."""
    w = hits.groupBy("query_id").agg(F.max("score").alias("hi"), F.min("score").alias("lo"), F.avg("score").alias("mean"), F.var_pop("score").alias("var"), F.count("*").alias("n"))
    stability = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), 1 - 10 * F.col("var"))).otherwise(0.5)
    value = F.least(F.lit(1.0), 0.5 * F.col("hi") + 0.2 * F.least(F.col("n") / least_docs, F.lit(1.0)) + 0.2 * F.col("mean") + 0.1 * stability)
    again = (F.col("hi") < threshold) | (F.col("n") < least_docs) | (F.col("mean") < 0.8 * threshold)
    wider = F.least(F.lit(30).cast("long"), F.col("n") * F.greatest(F.lit(2).cast("long"), F.floor(1 / F.greatest(value, F.lit(0.1)))))
    return w.select("query_id", F.round(value, 3).alias("confidence"), again.alias("needs_refetch"), F.when(again, wider).otherwise(F.col("n")).alias("suggested_top_k"))


def merge_results(first: DataFrame, second: DataFrame, key: Column, k: int) -> DataFrame:
    """Both result lists, the first one's wins where ``key`` agrees."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1))).withColumn("_key", key)
    once = Window.partitionBy("query_id", "_key").orderBy("_from", "rank")
    order = Window.partitionBy("query_id").orderBy("_from", "rank")
    kept = both.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_n", "_from", "_key")


# ---- what stands around a search


@dataclass(frozen=True)
class Search:
    """A search as data: text and vector queries (query_id, query) and (query_id,
    embedding), how to fuse them, a filter, an order, and which rows to return."""

    text: DataFrame | None = None
    dense: DataFrame | None = None
    method: str = "weighted_sum"
    weights: tuple[float, float] = (0.3, 0.7)
    where: dict[str, object] | None = None
    fields: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    k: int = 10
    offset: int = 0


def search(rows: DataFrame, asked: Search) -> DataFrame:
    """Rows (doc_id, text, embedding, ...) as a ``Search`` asks for them. The
    filter holds for both legs; without a query every row that passes has score
    1. Multi-key order, then score and doc_id, decides ranks; ``fields`` are
    joined to the hits."""
    kept = rows.where(condition(asked.where)) if asked.where else rows
    reach = asked.k + asked.offset
    legs = []
    if asked.text is not None:
        legs.append((bm25(kept, asked.text, reach), asked.weights[0]))
    if asked.dense is not None:
        legs.append((knn(kept, asked.dense, reach), asked.weights[1]))
    if not legs:
        hits = kept.select(F.lit(0).cast("long").alias("query_id"), "doc_id", F.lit(1.0).alias("score"))
    elif len(legs) == 1:
        hits = legs[0][0].select("query_id", "doc_id", "score")
    elif asked.method == "rrf":
        hits = rrf(legs, 1 << 30).drop("rank")
    else:
        hits = weighted_sum(legs[0][0], legs[1][0], *asked.weights, 1 << 30).drop("rank")
    if not asked.order and not asked.fields:
        return top_k(hits, asked.k, asked.offset)
    names = list(dict.fromkeys([*asked.fields, *(n for n, _ in asked.order if n not in ("doc_id", "score"))]))
    met = hits.join(kept.select("doc_id", *names), "doc_id")
    chain = [F.col(n).asc() if up else F.col(n).desc() for n, up in asked.order]
    order = Window.partitionBy("query_id").orderBy(*chain, F.desc("score"), "doc_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > asked.offset) & (F.col("rank") <= reach))
    return ranked.select("query_id", "doc_id", "score", *asked.fields, "rank")


def graph_candidates(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, score, rank) and what a graph adds (query_id,
    doc_id, score): those a query has not, behind its own."""
    new = candidates.dropDuplicates(["query_id", "doc_id"]).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    last = hits.groupBy("query_id").agg(F.max("rank").alias("_last"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    placed = new.join(last, "query_id", "left").withColumn("rank", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    return hits.select("query_id", "doc_id", "score", "rank").unionByName(placed.select("query_id", "doc_id", "score", "rank"))


def numbered(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Distinct rows with their place (``at``, from 1) by ``key`` in their group: ranges
    are counted apart and begin where the earlier ones of a group end, so no task sorts a group."""
    ranged = materialize(rows.distinct().repartitionByRange(F.col(group), F.col(key)).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n")).select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key))
    return ranged.withColumn("_at", within).join(F.broadcast(starts), [group, "_part"]).select(*rows.columns, (F.col("_start") + F.col("_at")).alias("at"))


def group_candidates(hits: DataFrame, asked: DataFrame, members: DataFrame, score: float, block: int = MEMBER_ROWS) -> DataFrame:
    """Hits (query_id, doc_id, score, rank), and behind a query's own all others of
    its group, by doc_id: ``graph_candidates`` where they are (query_id, group) met with
    (group, doc_id) and score the same. Ranks follow from places in the group and
    from those of the hits in it, so pairs are neither sorted nor shuffled: queries
    meet ``block`` members of their group at a time."""
    placed = materialize(numbered(members.select("group", "doc_id").where("group is not null"), "group", "doc_id").withColumn("block", F.floor((F.col("at") - 1) / block)), "group-places")
    blocks = placed.select("group", "block").distinct()
    asked = asked.select("query_id", "group").where("group is not null").distinct()
    met = hits.select("query_id", "doc_id", "rank").join(asked, "query_id").join(placed.select("group", "doc_id", "at"), ["group", "doc_id"], "left")
    taken = met.groupBy("query_id", "group").agg(F.max("rank").alias("last"), F.collect_list("at").alias("taken"))
    known = asked.join(taken, ["query_id", "group"], "left").select("query_id", "group", F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("taken", F.array().cast("array<bigint>")).alias("taken"))
    wanted = materialize(known, "group-asked").join(blocks, "group")
    pairs = wanted.hint("merge").join(placed, ["group", "block"]).where("not array_contains(taken, at)")
    rank = F.col("last") + F.col("at") - F.size(F.filter("taken", lambda t: t < F.col("at")))
    return hits.select("query_id", "doc_id", "score", "rank").unionByName(pairs.select("query_id", "doc_id", F.lit(score).alias("score"), rank.cast("int").alias("rank")))


def variant_search(docs: DataFrame, variants: DataFrame, k: int = 10, least_match: float = 0.7) -> DataFrame:
    """(query_id, variant, query): every distinct variant of a query is searched,
    and its ranked lists are fused by reciprocal rank."""
    once = variants.dropDuplicates(["query_id", "query"]).withColumn("_v", F.struct("query_id", "variant"))
    hits = bm25(docs, once.select(F.col("_v").alias("query_id"), "query"), k, least_match)
    fused = hits.select(F.col("query_id.query_id").alias("query_id"), "doc_id", (1 / (RRF_K + F.col("rank"))).alias("s"))
    return top_k(fused.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score")), k)


def rerank(hits: DataFrame, score: Callable[[pd.DataFrame], pd.Series], k: int) -> DataFrame:
    """Hits (query_id, query, doc_id, text) by a scorer of query and text batches,
    such as a cross-encoder. Equal pairs are scored once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(score=np.asarray(score(batch), float))[["query", "text", "score"]]

    scored = hits.select("query", "text").distinct().mapInPandas(run, "query string, text string, score double")
    return top_k(hits.select("query_id", "query", "doc_id", "text").join(scored, ["query", "text"]).select("query_id", "doc_id", F.round("score", 6).alias("score")), k)


def word_overlap(batch: pd.DataFrame) -> pd.Series:
    """A scorer that needs no model: the share of a query's words that a text has."""
    words = [set(re.findall(r"\w+", q.lower())) for q in batch["query"]]
    return pd.Series([len(w & set(re.findall(r"\w+", t.lower()))) / max(1, len(w)) for w, t in zip(words, batch["text"], strict=True)], dtype=float)


def rerank_by(strategy: str, scorers: dict[str, Callable[[pd.DataFrame], pd.Series]], hits: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """A strategy by name: one scorer, or ``hybrid`` of the first two, blended by
    document. With one scorer left hybrid is that one; without any, or for an
    unknown name, hits keep their order (query_id, doc_id, score, rank)."""
    if strategy == "hybrid" and len(scorers) >= 2:
        a, b = list(scorers.values())[:2]
        return blend(rerank(hits, a, 1 << 30), rerank(hits, b, 1 << 30), *weights).where(F.col("rank") <= k)
    chosen = scorers.get(strategy) or (next(iter(scorers.values()), None) if strategy == "hybrid" else None)
    if chosen is None:
        return hits.select("query_id", "doc_id", "score", "rank").where(F.col("rank") <= k)
    return rerank(hits, chosen, k)


def embed(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], most: int = 8192, batch: int = 64) -> DataFrame:
    """(text) -> (text, embedding) for each distinct text, by an encoder of
    batches; texts are cut to ``most`` characters for the model, vectors have length 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch):
                part = frame["text"].iloc[at : at + batch]
                v = np.asarray(encode([t[:most] for t in part]), float)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                yield pd.DataFrame({"text": part.to_numpy(), "embedding": list((v / np.where(norm == 0, 1, norm)).astype(np.float32))})

    return texts.select("text").where("text is not null").distinct().mapInPandas(run, "text string, embedding array<float>")


def refetch(hits: DataFrame, again: Callable[[DataFrame], DataFrame], threshold: float = 0.6, least_docs: int = 3) -> DataFrame:
    """Hits (query_id, doc_id, score, rank) of a first search; queries of too
    little confidence are searched once more by ``again``, which gets (query_id,
    suggested_top_k), and both results are merged, the first one's in front."""
    unsure = confidence(hits, threshold, least_docs).where("needs_refetch").select("query_id", "suggested_top_k")
    second = again(unsure).select("query_id", "doc_id", "score", "rank")
    both = merge_results(hits.select("query_id", "doc_id", "score", "rank"), second, F.col("doc_id"), 1 << 30)
    return both.join(unsure, "query_id", "left").where(F.col("rank") <= F.coalesce("suggested_top_k", F.lit(1 << 30))).drop("suggested_top_k")
