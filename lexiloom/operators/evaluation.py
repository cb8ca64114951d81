"""Retrieval metrics, reports and paired tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialize


def ir_metrics(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, source) and (query_id, source) -> one row for each query
    with relevant sources: hit_rate, recall_at_k, mrr, precision, ndcg_at_k,
    average_precision. Repeated sources in a run count each time, but in
    precision once. Runs and what is relevant are shuffled by query once, one
    after the other: along a source what is relevant comes first, and counts go on
    from row to row, so nothing is joined and no distinct sources are gathered."""
    asked = qrels.select("query_id", F.lit(None).cast(runs.schema["rank"].dataType).alias("rank"), "source", F.lit(1).alias("asked"))
    both = runs.select("query_id", "rank", "source", F.lit(0).alias("asked")).union(asked).repartition("query_id")
    along = Window.partitionBy("query_id", "source").orderBy(F.desc("asked"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    known, met = F.col("source").isNotNull(), F.col("asked") == 0
    judged = both.select("*", F.when(met & known, F.max("asked").over(along)).otherwise(0).alias("rel"), F.count_if(met).over(along).alias("nth"), F.count_if(~met).over(along).alias("nth_asked"))
    judged = judged.where(met | (F.col("nth_asked") == 1))
    so_far = Window.partitionBy("query_id").orderBy("rank", "source").rowsBetween(Window.unboundedPreceding, 0)
    judged = judged.withColumn("hits", F.sum("rel").over(so_far))
    at, once = F.when(F.col("rank") <= k, F.col("rel")).otherwise(0), met & known & (F.col("nth") == 1)
    joined = judged.groupBy("query_id").agg(
        F.sum("asked").alias("n_relevant"), F.max("rel").alias("hit"), F.sum(at).alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.count_if(once).alias("retrieved"), F.count_if(once & (F.col("rel") == 1)).alias("right"),
        F.sum(at / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("rel") * F.col("hits") / F.col("rank")).alias("ap"),
    ).where("n_relevant > 0")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))

    def value(x: Column) -> Column:
        return F.round(F.coalesce(F.when(F.col("query_id").isNotNull(), x), F.lit(0.0)), 6)

    return joined.select(
        "query_id", value(F.col("hit").cast("double")).alias("hit_rate"), value(F.col("found") / F.col("n_relevant")).alias("recall_at_k"), value(1 / F.col("first")).alias("mrr"),
        value(F.try_divide("right", "retrieved")).alias("precision"), value(F.col("dcg") / ideal).alias("ndcg_at_k"), value(F.col("ap") / F.col("n_relevant")).alias("average_precision"),
    )


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, out = 1.0, 0.0, 1.0
    for i in range(300):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c or 1e-300
        out *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (out - 1) if front else 0.0


def t_test_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if math.isinf(t):
        return 0.0
    return _beta(df / 2, 0.5, df / (df + t * t))


def paired_t(pairs: DataFrame, by: str) -> DataFrame:
    """(by, a, b) -> mean_a, mean_b, difference, percent, t, p_value, significant
    for each ``by``. Equal values everywhere have p 1. The sums are Spark's;
    the p-value is worked out for one row of each metric."""
    agg = pairs.where("a is not null and b is not null").groupBy(by).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(F.col("b") - F.col("a")).alias("difference"), F.stddev_samp(F.col("b") - F.col("a")).alias("sd"), F.count("*").alias("n"))

    @F.pandas_udf("double")
    def p_value(mean, sd, n):
        import pandas as pd

        return pd.Series([1.0 if c < 2 or (not s and not m) else t_test_p(m / (s / math.sqrt(c)) if s else math.inf, c - 1) for m, s, c in zip(mean, sd.fillna(0), n, strict=True)])

    out = agg.withColumn("p_value", p_value("difference", "sd", "n"))
    percent = F.when(F.col("mean_a") == 0, 0.0).otherwise(100 * F.col("difference") / F.col("mean_a"))
    return out.select(by, "n", "mean_a", "mean_b", "difference", percent.alias("percent"), F.try_divide(F.col("difference"), F.col("sd") / F.sqrt("n")).alias("t"), "p_value", (F.col("p_value") < 0.05).alias("significant"))


def order_statistics(rows: DataFrame, by: str, value: str, at: dict[str, Callable[[Column], Column]], pieces: int = 64) -> DataFrame:
    """For each ``by`` the values that stand at given places (from 0) of its sorted
    values, as functions of their number: exact. Equal values are counted before
    anything is sorted, so a common one is one row. A key's distinct values are
    cut into pieces at approximate quantiles, counts are carried on from piece to
    piece, and only pieces that hold a place are sorted: no task sorts a key whole."""
    counted = materialize(rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n")), "order-counts")
    cuts = counted.groupBy(by).agg(F.percentile_approx(value, F.array(*(F.lit(i / pieces) for i in range(1, pieces))), 1000).alias("_cuts"))
    placed = counted.join(cuts, by).select(by, value, "n", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_p"))
    sums = placed.groupBy(by, "_p").agg(F.sum("n").alias("_m"))
    whole, rising = Window.partitionBy(by), Window.partitionBy(by).orderBy("_p")
    sums = sums.select(by, "_p", (F.sum("_m").over(rising) - F.col("_m")).alias("_before"), "_m", F.sum("_m").over(whole).alias("_n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), f(F.col("_n")).cast("long").alias("place")) for name, f in at.items()))
    asked = sums.withColumn("w", F.filter(wanted, lambda w: (w["place"] >= F.col("_before")) & (w["place"] < F.col("_before") + F.col("_m")))).where(F.size("w") > 0)
    met = placed.join(asked.select(by, "_p", "_before", "w"), [by, "_p"])
    within = Window.partitionBy(by, "_p").orderBy(value)
    met = met.withColumn("_to", F.sum("n").over(within) + F.col("_before")).select(by, value, "_to", "n", F.explode("w").alias("w"))
    met = met.where((F.col("w.place") < F.col("_to")) & (F.col("w.place") >= F.col("_to") - F.col("n")))
    return met.groupBy(by).agg(*(F.max(F.when(F.col("w.name") == name, F.col(value))).alias(name) for name in at))


def latency_report(events: DataFrame, by: str, value: str) -> DataFrame:
    """Number, mean, least and most; exact p50 and p95 with linear interpolation;
    p95, p99 and median by index: int(0.95 n), int(0.99 n), n // 2."""

    def low(q: float) -> Callable[[Column], Column]:
        return lambda n: F.floor(q * (n - 1))

    def high(q: float) -> Callable[[Column], Column]:
        return lambda n: F.ceil(q * (n - 1))

    at = {"_l50": low(0.5), "_h50": high(0.5), "_l95": low(0.95), "_h95": high(0.95), "p95_index": lambda n: F.floor(n * 0.95), "p99_index": lambda n: F.floor(n * 0.99), "median_index": lambda n: F.floor(n / 2)}
    sums = events.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("_mean"), F.min(value).alias("_least"), F.max(value).alias("_most"))
    joined = sums.join(order_statistics(events, by, value, at), by)

    def linear(q: float, x: str) -> Column:
        part = q * (F.col("n") - 1)
        return F.round(F.col(f"_l{x}") + (part - F.floor(part)) * (F.col(f"_h{x}") - F.col(f"_l{x}")), 4)

    return joined.select(
        by, "n", F.round("_mean", 4).alias("mean"), linear(0.5, "50").alias("p50"), linear(0.95, "95").alias("p95"), *(F.round(x, 4).alias(x) for x in ("p95_index", "p99_index", "median_index")),
        F.round("_least", 4).alias("least"), F.round("_most", 4).alias("most"),
    )


def set_metrics(runs: DataFrame, qrels: DataFrame, samples: DataFrame) -> DataFrame:
    """(query_id, rank, source), (query_id, source) and (query_id) -> recall,
    precision, mrr and hit_rate of every sample by sets of sources; null for a
    sample without relevant ones, so that means leave it out."""
    relevant = qrels.select("query_id", "source").distinct()
    size = relevant.groupBy("query_id").agg(F.count("*").alias("m"))
    first = runs.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    judged = first.join(relevant.withColumn("rel", F.lit(1)), ["query_id", "source"], "left")
    found = judged.groupBy("query_id").agg(F.count("*").alias("got"), F.count("rel").alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    joined = samples.select("query_id").distinct().join(size, "query_id", "left").join(found, "query_id", "left")

    def value(x: Column) -> Column:
        return F.when(F.col("m").isNotNull(), F.round(F.coalesce(x, F.lit(0.0)), 6))

    return joined.select("query_id", value(F.col("hits") / F.col("m")).alias("recall"), value(F.col("hits") / F.col("got")).alias("precision"), value(1 / F.col("first")).alias("mrr"), value((F.col("hits") > 0).cast("double")).alias("hit_rate"))


def mean_report(results: DataFrame, *metrics: str, by: list[str] | None = None) -> DataFrame:
    """Means of metrics that are told, and how many samples there are."""
    return results.groupBy(*(by or [])).agg(F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def paired_samples(a: DataFrame, b: DataFrame, metrics: list[str], key: str = "query_id") -> DataFrame:
    """Two runs' results (key, metrics) -> (metric, a, b) of samples that both have."""
    x = a.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("a")) for m in metrics))).alias("m")).select(key, "m.*")
    y = b.select(key, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("b")) for m in metrics))).alias("m")).select(key, "m.*")
    return x.join(y, [key, "metric"]).select("metric", "a", "b")


def composite(mrr: Column, recall: Column, faithfulness: Column) -> Column:
    """A configuration's score; faithfulness is told from 1 to 5."""
    return 0.4 * mrr + 0.3 * recall + 0.3 * faithfulness / 5


def config_grid(**values: DataFrame) -> DataFrame:
    """Every combination of the settings' small tables, one column each."""
    out = None
    for name, df in values.items():
        one = df.select(F.col(df.columns[0]).alias(name)).distinct()
        out = one if out is None else out.join(F.broadcast(one))
    return out


def best_config(scored: DataFrame, baseline: Column) -> DataFrame:
    """Configurations (score, ...), the baseline first, then by score; ``best`` marks the highest."""
    order = Window.orderBy(F.when(baseline, 0).otherwise(1), F.desc("score"), *scored.columns)
    top = scored.agg(F.max("score").alias("_top"))
    return scored.withColumn("place", F.row_number().over(order)).join(F.broadcast(top)).withColumn("best", F.col("score") == F.col("_top")).drop("_top")


def improvement(base: Column, new: Column) -> Column:
    """Percent by which ``new`` is more than ``base``; 0 where that is 0."""
    return F.when(base == 0, 0.0).otherwise(100 * (new - base) / base)


def cache_effect(pairs: DataFrame, share: float = 0.5) -> DataFrame:
    """(cold, hot) latencies of the same queries -> hits (hot under half of cold), rate, means and speedup."""
    agg = pairs.agg(F.count("*").alias("total"), F.sum((F.col("hot") < share * F.col("cold")).cast("long")).alias("hits"), F.avg("cold").alias("cold_mean"), F.avg("hot").alias("hot_mean"))
    return agg.withColumns({"hit_rate": F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0), "speedup": F.when(F.col("hot_mean") > 0, F.col("cold_mean") / F.col("hot_mean")).otherwise(0.0)})


def throughput(requests: DataFrame, by: str) -> DataFrame:
    """(by, ts) -> requests a second between a key's first and last."""
    agg = requests.groupBy(by).agg(F.count("*").alias("n"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    return agg.select(by, "n", F.when(F.col("us") > 0, F.col("n") * 1e6 / F.col("us")).otherwise(0.0).alias("per_second"))


def chunk_stats(hits: DataFrame) -> DataFrame:
    """(query_id, text) -> mean number of chunks a query got, and their mean length."""
    each = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("size"))
    return each.agg(F.avg("n").alias("avg_chunks_retrieved"), (F.sum("size") / F.sum("n")).alias("avg_chunk_size"))


def judge(samples: DataFrame, ask: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    """(query_id, question, answer, context) -> faithfulness and relevancy from 1
    to 5 by a model's replies (JSON); null where a reply doesn't tell."""
    from lexiloom.functions.text import lenient_json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"query_id": batch["query_id"], "reply": ask(batch)})

    said = samples.select("query_id", "question", "answer", "context").mapInPandas(run, f"query_id {samples.schema['query_id'].dataType.simpleString()}, reply string")
    told = said.select("query_id", lenient_json(F.col("reply"), "faithfulness double, relevancy double").alias("r"))
    return told.select("query_id", *(F.when(F.col(f"r.{x}").between(1, 5), F.col(f"r.{x}")).alias(x) for x in ("faithfulness", "relevancy")))
