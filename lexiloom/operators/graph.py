"""Knowledge-graph operators over entity, relation and mention tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import jaccard, law_names
from lexiloom.session import materialize

# Weights of known predicates; others weigh 0.5.
PREDICATES = {
    "制定": 1.0,
    "上位法": 0.9,
    "隶属于": 0.9,
    "实施细则": 0.8,
    "修订": 0.8,
    "定义了": 0.7,
    "适用于": 0.6,
    "解释": 0.6,
    "细化": 0.6,
    "援引": 0.5,
    "废止": 0.4,
    "抵触": 0.3,
}
# Descriptions that deny a relation.
DENIALS = ["no clear relationship", "not directly linked", "no direct relationship", "unrelated", "no relationship", "无明确关系", "无直接关联", "没有关系", "没有关联", "不相关"]
SEPARATOR = "<SEP>"
LINKS = 500_000
PATH_ROWS = 8_000_000
WAYS_AT_ONCE = 1_000_000
# Headings of what a graph tells of entities, relations, paths and communities.
HEADINGS = ["## 知识图谱 - 相关实体", "## 知识图谱 - 相关关系", "## 知识图谱 - 关联路径", "## 知识图谱 - 社区报告"]


def predicate_weight(predicate: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PREDICATES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, predicate), F.lit(0.5))


def _joined(descriptions: Column) -> Column:
    """Descriptions in order, each unless what is there contains it."""
    return F.aggregate(
        descriptions,
        F.lit(""),
        lambda got, d: F.when((d == "") | F.contains(got, d), got).when(got == "", d).otherwise(F.concat(got, F.lit(SEPARATOR), d)),
    )


def _described(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, description) -> each key's joined descriptions. Equal ones meet
    before any is gathered, so an array holds a key's distinct texts only."""
    told = rows.select(*keys, "ord", F.trim(F.coalesce("description", F.lit(""))).alias("d")).where("d != ''").groupBy(*keys, "d").agg(F.min("ord").alias("ord"))
    gathered = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "d"))).alias("r"))
    return gathered.select(*keys, _joined(F.col("r.d")).alias("description"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """(ord, name, type, description, source_id) -> one row for each name without
    case and outer blanks: first name and type, joined descriptions, sources."""
    keyed = entities.withColumn("key", F.lower(F.trim("name"))).where("key != ''")
    first = keyed.groupBy("key").agg(F.min_by(F.struct("name", "type"), F.struct("ord", "name", "type")).alias("f"), F.array_sort(F.collect_set(F.when(F.col("source_id") != "", F.col("source_id")))).alias("source_ids"))
    joined = first.join(_described(keyed, ["key"]), "key", "left")
    return joined.select("key", "f.name", "f.type", F.coalesce("description", F.lit("")).alias("description"), "source_ids")


def merge_relations(relations: DataFrame) -> DataFrame:
    """(ord, source, target, weight, description, keywords) -> one row for each
    unordered pair; rows whose description denies a relation are left out."""
    described = F.lower(F.coalesce("description", F.lit("")))
    kept = relations.where(~F.exists(F.array(*map(F.lit, DENIALS)), lambda p: F.contains(described, p)))
    kept = kept.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target")})
    sums = kept.groupBy("a", "b").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("weight"))
    words = kept.select("a", "b", F.explode("keywords").alias("w")).distinct().groupBy("a", "b").agg(F.array_sort(F.collect_list("w")).alias("keywords"))
    out = sums.join(_described(kept, ["a", "b"]), ["a", "b"], "left").join(words, ["a", "b"], "left")
    return out.select("a", "b", "weight", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))


def similar_names(a: Column, b: Column) -> Column:
    """Within two edits; with Chinese characters about, character sets that
    agree to 80 %."""
    chinese = a.rlike("[一-鿿]") | b.rlike("[一-鿿]")

    def characters(x: Column) -> Column:
        return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))

    return F.when(chinese, jaccard(characters(a), characters(b)) >= 0.8).otherwise(F.levenshtein(a, b) <= 2)


def entity_candidates(entities: DataFrame) -> DataFrame:
    """(name, type) -> pairs a < b of one type with similar names, blocked so
    that a type never meets as a whole: names share a variant with up to two
    characters deleted (two edits always do), or, with Chinese in one of them,
    one of their rarest characters. Sets that agree to 80 % have four fifths of
    the larger one in common, so of n characters the n - ceil(0.8 n) + 1 rarest
    hold a shared one on either side; common characters block nothing."""
    names = entities.select("type", "name").where("name is not null").distinct()

    def deleted(xs: Column) -> Column:
        return F.flatten(F.transform(xs, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.char_length(x))))))

    once = F.array_distinct(deleted(F.array("name")))
    variants = F.array_distinct(F.concat(F.array("name"), once, deleted(once)))
    plain = names.where(~F.col("name").rlike("[一-鿿]")).select("type", "name", F.explode(variants).alias("k"))
    each = names.select("type", "name", F.explode(F.array_distinct(F.filter(F.split("name", ""), lambda c: c != ""))).alias("c"))
    common = each.groupBy("type", "c").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("type", "name").orderBy("n", "c"))
    size = F.count("*").over(Window.partitionBy("type", "name"))
    rare = each.join(common, ["type", "c"]).withColumns({"r": rank, "size": size}).where(F.col("r") <= F.col("size") - F.ceil(F.round(0.8 * F.col("size"), 6)) + 1).select("type", "name", F.concat(F.lit("\u0001"), "c").alias("k"))
    rare = rare.withColumn("zh", F.col("name").rlike("[一-鿿]"))
    met = [(plain, plain), (rare.where("zh"), rare)]
    pairs = [x.select("type", "k", F.col("name").alias("x")).join(y.select("type", "k", F.col("name").alias("y")), ["type", "k"]).where("x != y") for x, y in met]
    pairs = pairs[0].union(pairs[1]).select("type", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.where(similar_names(F.col("a"), F.col("b")))


def resolve_aliases(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, query) and (alias, canonical) -> aliases that stand in a query,
    without case: every run of characters as long as some alias meets the
    aliases by equality. Where a query begins or ends a run within a word of
    letters without Chinese, it doesn't stand there."""
    lowered = aliases.where("alias != ''").select(F.lower("alias").alias("alias"), "canonical").distinct()
    lengths = [r[0] for r in lowered.select(F.char_length("alias")).distinct().collect()]
    q = queries.select("query_id", F.lower("query").alias("q"))
    runs = F.flatten(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("q") - n + 1, F.lit(1))), lambda i: F.struct(F.substring("q", i, n).alias("alias"), i.alias("i")))))
    edge = r"[\p{L}\p{N}&&[^一-鿿]]"
    found = q.select("query_id", "q", F.explode(runs).alias("r")).select("query_id", "q", "r.*").join(lowered, "alias")
    before, after = F.substring("q", F.col("i") - 1, F.lit(1)), F.substring("q", F.col("i") + F.char_length("alias"), F.lit(1))
    starts = (F.col("i") == 1) | ~(before.rlike(edge) & F.col("alias").rlike(rf"\A{edge}"))
    ends = ~(after.rlike(edge) & F.col("alias").rlike(rf"{edge}\z"))
    return found.where(starts & ends).select("query_id", "alias", "canonical").distinct()


def resolve_entities(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, query) -> (query_id, name): canonical names of the aliases in a
    query, and of the laws it names, or these names themselves."""
    known = resolve_aliases(queries, aliases).select("query_id", F.col("canonical").alias("name"))
    laws = queries.select("query_id", F.explode(law_names(F.col("query"))).alias("law"))
    named = laws.join(aliases.select(F.col("alias").alias("law"), "canonical"), "law", "left").select("query_id", F.coalesce("canonical", "law").alias("name"))
    return known.union(named).distinct()


def expand_paths(starts: DataFrame, edges: DataFrame, hops: int = 3, least_weight: float = 0.1, k: int | None = None) -> DataFrame:
    """(name) and (source, target, weight) -> (start, target, score, hops): the
    best product of weights over directed paths of at most ``hops`` edges, and
    the edges of the shortest path that has it. As weights are at most 1, only
    the best way to each end goes on, and ways under ``least_weight`` end.

    With ``k``, the first k targets of each start by score, hops and name. What
    goes on is bounded then: a node outranked by k others after as many edges
    leads to nothing that these don't outrank, so k nodes of a start go on; and
    a node's edges behind its k + 1 heaviest lead nowhere new either. Results
    are the same as of all paths.

    A task has some ``PATH_ROWS`` ways of a hop, counted before they are made,
    and tells the best of those that join the same two ends (``_onward``). Ends
    keep a score for each hop, so that one sum over plain numbers tells the best
    and its hop, and what the last hop finds is shuffled once. Keys that are
    numbers are faster than strings."""
    edges = edges.where("source is not null and target is not null").groupBy("source", "target").agg(F.max("weight").alias("weight")).where(F.col("weight") >= least_weight)
    if k:
        heaviest = Window.partitionBy("source").orderBy(F.desc("weight"), "target")
        edges = edges.withColumn("_n", F.row_number().over(heaviest)).where(F.col("_n") <= k + 1).drop("_n")
    step = materialize(edges.select(F.col("source").alias("at"), "target", "weight"), "path-edges")
    degrees = materialize(step.groupBy("at").agg(F.count("*").alias("ways")), "path-degrees")
    front = materialize(starts.select(F.col("name").alias("start"), F.col("name").alias("at"), F.lit(1.0).alias("score")).where("start is not null").distinct(), "path-front")
    cores, scores = front.sparkSession.sparkContext.defaultParallelism, [f"_s{hop}" for hop in range(1, hops + 1)]

    def reached(rows: DataFrame, hop: int) -> DataFrame:
        return rows.select("start", "at", *((F.col("score") if i == hop else F.lit(None).cast("double")).alias(s) for i, s in enumerate(scores, 1)))

    found = None
    for hop in range(1, hops + 1):
        ways = front.join(degrees, "at").agg(F.coalesce(F.sum("ways"), F.lit(0))).first()[0]
        parts = max(cores, -(-ways // PATH_ROWS))
        met = _onward(front, step, parts, least_weight)
        if hop < hops or k:
            front = met.groupBy("start", "at").agg(F.max("score").alias("score"))
            met = front = materialize(_first(front, ["start"], [F.desc("score"), F.col("at")], k) if k else front, "path-front")
        found = reached(met, hop) if found is None else found.union(reached(met, hop))
    best = found.groupBy("start", F.col("at").alias("target")).agg(*(F.max(s).alias(s) for s in scores))
    score = F.greatest(*scores) if hops > 1 else F.col(scores[0])
    first = F.coalesce(*(F.when(F.col(s) == F.col("score"), i) for i, s in enumerate(scores, 1)))
    best = best.withColumn("score", score).select("start", "target", "score", first.alias("hops"))
    return _first(best, ["start"], [F.desc("score"), F.col("hops"), F.col("target")], k) if k else best


def _onward(front: DataFrame, step: DataFrame, parts: int, least_weight: float) -> DataFrame:
    """(start, at, score) and (at, target, weight) -> (start, at, score) one edge
    on: nodes are dealt into ``parts`` by hash, and a part tells the best way of
    its own to each end, WAYS_AT_ONCE of them at a time."""
    schema = T.StructType([T.StructField("start", front.schema["start"].dataType), T.StructField("at", step.schema["target"].dataType), T.StructField("score", T.DoubleType())])

    def run(ways: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if ways.empty or edges.empty:
            return pd.DataFrame({"start": ways["start"][:0], "at": edges["target"][:0], "score": ways["score"][:0]})
        ways, edges = ways.sort_values("start"), edges.sort_values("at")
        starts, ends = pd.factorize(ways["start"]), pd.factorize(edges["target"])
        first, behind = (edges["at"].searchsorted(ways["at"], side) for side in ("left", "right"))
        score, weight, many, found = ways["score"].to_numpy(), edges["weight"].to_numpy(), behind - first, []
        cuts = np.searchsorted(np.cumsum(many), np.arange(1, many.sum() // WAYS_AT_ONCE + 1) * WAYS_AT_ONCE)
        for rows in np.split(np.arange(len(ways)), cuts):
            n = many[rows]
            edge = np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append(_best_ways(np.repeat(starts[0][rows], n), ends[0][edge], np.repeat(score[rows], n) * weight[edge], least_weight))
        start, end, best = (np.concatenate(x) for x in zip(*found, strict=True))
        names = [np.asarray(known)[x] for known, x in ((starts[1], start), (ends[1], end))]
        kept = names[0] != names[1]
        return pd.DataFrame({c: pd.Series(x[kept], dtype=x.dtype) for c, x in (("start", names[0]), ("at", names[1]), ("score", best))})

    part = F.pmod(F.xxhash64("at"), F.lit(parts)).alias("part")
    dealt = [df.select("*", part).repartition(parts, "part").groupBy("part") for df in (front, step)]
    return dealt[0].cogroup(dealt[1]).applyInPandas(run, schema)


def _best_ways(start: np.ndarray, end: np.ndarray, score: np.ndarray, least_weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of ends once, with its best score, if that isn't under ``least_weight``."""
    kept = score >= least_weight
    start, end, score = start[kept], end[kept], score[kept]
    if not len(score):
        return start, end, score
    low, width = start.min(), int(end.max()) + 1
    key, cells = (start - low) * width + end, (int(start.max() - low) + 1) * width
    if cells <= 2 * len(key):
        best = np.full(cells, -np.inf)
        np.maximum.at(best, key, score)
        key = np.flatnonzero(best > -np.inf)
        return key // width + low, key % width, best[key]
    order = np.argsort(key)
    key, score = key[order], score[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at] // width + low, key[at] % width, np.maximum.reduceat(score, at)


def best_reached(starts: DataFrame, edges: DataFrame, hops: int = 3, least_weight: float = 0.1) -> DataFrame:
    """(name) and (source, target, weight) -> (name, score): every node's best
    score in ``expand_paths`` by whichever start but itself, without the paths of
    all the others. A node's two best starts go on: of what a third leads to, one
    of these two is another node and has led there no worse."""
    edges = edges.groupBy("source", "target").agg(F.max("weight").alias("weight")).where(F.col("weight") >= least_weight)
    step = materialize(edges.select(F.col("source").alias("at"), "target", "weight"), "reach-edges")
    front = starts.select(F.col("name").alias("start"), F.col("name").alias("at"), F.lit(1.0).alias("score")).distinct()
    found = None
    for _ in range(hops):
        met = front.join(step, "at").select("start", F.col("target").alias("at"), (F.col("score") * F.col("weight")).alias("score"))
        met = met.where(F.col("score") >= least_weight).groupBy("start", "at").agg(F.max("score").alias("score"))
        front = materialize(_first(met, ["at"], [F.desc("score"), F.col("start")], 2), "reach-front")
        found = front if found is None else found.union(front)
    return found.where("start != at").groupBy(F.col("at").alias("name")).agg(F.max("score").alias("score"))


def _first(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def n_hop_paths(starts: DataFrame, edges: DataFrame, hops: int = 2, k: int = 50) -> DataFrame:
    """(name) and (source, target, description) -> (start, path_text, hops): the
    ``k`` first directed paths of every start by length and text, none using an
    edge twice nor ending where it began. A start that has k goes no further."""
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), F.coalesce("description", F.lit("related")).alias("d"))
    front = starts.select(F.col("name").alias("start"), F.col("name").alias("at"), F.array().cast("array<string>").alias("used"), F.col("name").cast("string").alias("path_text"))
    found = None
    for hop in range(1, hops + 1):
        edge = F.concat_ws("\u0001", "at", "d", "to")
        front = front.join(step, "at").where(~F.array_contains("used", edge)).select("start", F.col("to").alias("at"), F.array_append("used", edge).alias("used"), F.concat("path_text", F.lit(" →("), "d", F.lit(")→ "), F.col("to").cast("string")).alias("path_text"))
        if hop < hops:
            front = materialize(front, "paths-front")
        done = front.where("start != at").select("start", "path_text", F.lit(hop).alias("hops"))
        found = done if found is None else found.union(done)
        if hop < hops:
            full = found.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= k)
            front = front.join(full, "start", "left_anti")
    return _first(found, ["start"], [F.col("hops"), F.col("path_text")], k)


def touching_edges(edges: DataFrame, nodes: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` heaviest edges (source, target, weight) with an end among ``nodes`` (name)."""
    ends = [edges.join(nodes.select(F.col("name").alias(end)).distinct(), end, "left_semi").select(*edges.columns) for end in ("source", "target")]
    return ends[0].union(ends[1]).distinct().orderBy(F.coalesce("weight", F.lit(1)).desc(), "source", "target").limit(k)


def search_entities(entities: DataFrame, names: list[str], types: list[str], k: int = 10) -> DataFrame:
    """Entities (name, type, pagerank) whose name contains one of ``names`` (any
    if none is given) and whose type is among ``types``, by rank; a missing rank is 0.001."""
    named = F.exists(F.array(*map(F.lit, names)), lambda x: F.contains(F.col("name"), x)) if names else F.lit(True)
    typed = F.col("type").isin(types) if types else F.lit(True)
    return ranked_entities(entities.where(named & typed), k)


def ranked_entities(entities: DataFrame, k: int) -> DataFrame:
    ranked = entities.withColumn("pagerank", F.coalesce("pagerank", F.lit(0.001)))
    return ranked.orderBy(F.desc("pagerank"), "name").limit(k)


def visual_graph(entities: DataFrame, edges: DataFrame, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """The ``k`` entities of the highest rank, and the edges among them."""
    nodes = ranked_entities(entities, k)
    return nodes, induced_edges(edges, nodes)


def graph_stats(entities: DataFrame, relations: DataFrame, communities: DataFrame) -> DataFrame:
    """(kind, n) of entities, relations and communities."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in (("entities", entities), ("relations", relations), ("communities", communities))]
    return counts[0].union(counts[1]).union(counts[2])


def community_weights(members: DataFrame) -> DataFrame:
    """(node, community) -> (community, weight): how many members each has."""
    return members.groupBy("community").agg(F.count("*").alias("weight"))


def community_reports(members: DataFrame, reports: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """Reports (community, report, weight) of the communities that ``nodes`` are
    in, the ``k`` heaviest."""
    mine = members.join(nodes.select(F.col("name").alias("node")), "node", "left_semi").select("community").distinct()
    return reports.join(mine, "community", "left_semi").orderBy(F.desc("weight"), "community").limit(k)


def graph_context(queries: DataFrame, entities: DataFrame, relations: DataFrame, paths: DataFrame, reports: DataFrame, most_paths: int = 5) -> DataFrame:
    """One text for each query of what a graph tells: entities (query_id, name,
    type, description, pagerank), relations (query_id, source, target,
    description, weight), the first paths (query_id, path_text) and community
    reports (query_id, report), each kind under its heading if there is any."""
    e = entities.select("query_id", F.lit(0).alias("part"), F.format_string("- **%s** (%s): %s [重要性: %.3f]", "name", F.coalesce("type", F.lit("")), F.coalesce("description", F.lit("")), F.coalesce("pagerank", F.lit(0.0))).alias("t"))
    r = relations.select("query_id", F.lit(1).alias("part"), F.format_string("- %s → %s: %s (权重: %s)", "source", "target", F.coalesce("description", F.lit("")), F.coalesce("weight", F.lit(1)).cast("string")).alias("t"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("path_text"))
    p = paths.withColumn("n", first).where(F.col("n") <= most_paths).select("query_id", F.lit(2).alias("part"), F.concat(F.lit("- "), "path_text").alias("t"))
    c = reports.select("query_id", F.lit(3).alias("part"), F.concat(F.lit("- "), "report").alias("t"))
    parts = e.union(r).union(p).union(c).groupBy("query_id", "part").agg(F.array_join(F.array_sort(F.collect_list("t")), "\n").alias("t"))
    heading = F.get(F.array(*(F.lit(x + "\n") for x in HEADINGS)), F.col("part"))
    joined = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("part", F.concat(heading, "t").alias("t")))).alias("p"))
    return queries.select("query_id").join(joined.select("query_id", F.array_join(F.col("p.t"), "\n\n").alias("context")), "query_id", "left")


def ingest(chunks: DataFrame) -> dict[str, DataFrame]:
    """Extraction results (source, chunk_id, entities array<struct<name, type,
    aliases>>, relations array<struct<subject, predicate, object>>) -> tables
    documents, entities, aliases, mentions and relates, one row for each natural
    key; a relation weighs what its predicate does."""
    e = chunks.select("source", "chunk_id", F.explode("entities").alias("e")).select("source", "chunk_id", "e.*").where("name != ''")
    r = chunks.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", "r.*")
    return {
        "documents": chunks.groupBy("source").agg(F.countDistinct("chunk_id").alias("chunk_count")),
        "entities": e.groupBy("name").agg(F.min_by("type", F.struct("chunk_id", "type")).alias("type")),
        "aliases": e.select(F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("alias"), F.col("name").alias("canonical")).where("alias != canonical").groupBy("alias").agg(F.min("canonical").alias("canonical")),
        "mentions": e.select("name", "chunk_id", "source").distinct(),
        "relates": r.groupBy(F.col("subject").alias("source"), "predicate", F.col("object").alias("target")).agg(F.min("chunk_id").alias("chunk_id")).withColumn("weight", predicate_weight(F.col("predicate"))),
    }


def bridge_chunks(scored: DataFrame, mentions: DataFrame, k: int = 20) -> DataFrame:
    """(name, score) and (name, chunk_id) -> chunks by how many entities they
    bridge, then by the best of them."""
    met = mentions.join(scored, "name").groupBy("chunk_id").agg(F.countDistinct("name").alias("bridges"), F.max("score").alias("score"))
    return met.orderBy(F.desc("bridges"), F.desc("score"), "chunk_id").limit(k)


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """(a, b) undirected -> (node, rank). Nodes without edges don't occur, so no
    mass dangles. Links of both directions are two keys alone (numbers are much
    faster than strings), written once in the order of the node that they lead
    to, so that a task's sums meet a node's links together. They are shuffled by
    the other node once: every round's join reads that exchange again, and sums
    leave ranks parted by node as the next round needs them. A node hears from
    each neighbour once, so what it hears tells its degree too. Ranks are written
    every tenth round."""
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    links = materialize(both.repartition("b").sortWithinPartitions("b"), "pagerank-links")
    # Said of both ends, or the last round's scan would lack a filter of the others' and its exchange be another.
    links = links.where("a is not null and b is not null")
    ranks = materialize(links.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("d")), "pagerank-degrees")
    n = max(ranks.count(), 1)
    ranks = ranks.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        shares = ranks.select("node", (F.col("rank") / F.col("d")).alias("share")).hint("shuffle_hash")
        heard = links.join(shares, links.a == shares.node).groupBy(F.col("b").alias("node")).agg(F.count("*").alias("d"), F.sum("share").alias("s"))
        ranks = heard.select("node", "d", ((1 - alpha) / n + alpha * F.col("s")).alias("rank"))
        if i % 10 == 9 and i + 1 < rounds:
            ranks = materialize(ranks, "pagerank-ranks")
    return ranks.select("node", "rank")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(a, b) undirected -> (node, community): each node takes the commonest
    label of its neighbours and itself, the least on ties, all at once. Labels are
    what a task holds for its links' join, which therefore aren't sorted; a task
    has about ``LINKS`` of these, or of their votes, however many there are. Links
    are shuffled once and kept on the executors' disks until labels are found; a
    round's votes are shuffled once, to the node that counts them."""
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    both = materialize(both.union(both.select("a", F.col("a").alias("b")).distinct()), "labels-links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    parts = max(both.sparkSession.sparkContext.defaultParallelism, -(-both.count() // LINKS))
    links = both.repartition(parts, "b").persist(StorageLevel.DISK_ONLY)
    links.count()  # Until it is there, Spark doesn't know how it is dealt, and would deal it again.
    for _ in range(rounds):
        labels = labels.repartition(parts, "node").hint("shuffle_hash")
        votes = links.join(labels, links.b == labels.node).select("a", "community").repartition(parts, "a").groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("v"))
        labels = materialize(best.select(F.col("a").alias("node"), (-F.col("v.c")).alias("community")), "labels")
    links.unpersist()
    return labels


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """(chunk_id, pos, name) -> (a, b, chunks): names that meet in a chunk, in
    the order of the first."""
    first = mentions.groupBy("chunk_id", "name").agg(F.min("pos").alias("pos"))
    x = first.select("chunk_id", F.col("name").alias("a"), F.col("pos").alias("i"))
    y = first.select("chunk_id", F.col("name").alias("b"), F.col("pos").alias("j"))
    return x.join(y, "chunk_id").where("i < j").groupBy("a", "b").agg(F.count("*").alias("chunks"))


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (name)."""
    return edges.join(nodes.select(F.col("name").alias("source")), "source", "left_semi").join(nodes.select(F.col("name").alias("target")), "target", "left_semi")


def merge_nodes(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges rewired by (name, kept); parallel edges' weights are added, self
    loops dropped, direction kept."""
    m = mapping.select("name", "kept")
    s = edges.join(m.select(F.col("name").alias("source"), F.col("kept").alias("_s")), "source", "left")
    t = s.join(m.select(F.col("name").alias("target"), F.col("kept").alias("_t")), "target", "left")
    out = t.select(F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target"), "weight")
    return out.where("source != target").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
