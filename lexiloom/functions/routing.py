"""Where a classified query goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Intent, complexity, hyde, queries, reranked, vector weight, text weight.
ROUTES = [
    ("factoid", "simple", False, 1, 15, 0.7, 0.3),
    ("factoid", "medium", False, 1, 15, 0.6, 0.4),
    ("factoid", "complex", True, 2, 20, 0.5, 0.5),
    ("analytical", "simple", False, 1, 15, 0.6, 0.4),
    ("analytical", "medium", True, 2, 20, 0.6, 0.4),
    ("analytical", "complex", True, 3, 25, 0.5, 0.5),
    ("procedural", "simple", False, 1, 15, 0.6, 0.4),
    ("procedural", "medium", True, 2, 20, 0.6, 0.4),
    ("procedural", "complex", True, 3, 25, 0.5, 0.5),
    ("exploratory", "simple", True, 2, 20, 0.5, 0.5),
    ("exploratory", "medium", True, 3, 25, 0.5, 0.5),
    ("exploratory", "complex", True, 4, 30, 0.5, 0.5),
]
DEFAULT = (False, 1, 10, 0.7, 0.3)
NAMES = ["use_hyde", "num_queries", "rerank_top_k", "vector_weight", "text_weight"]


def route(spark: SparkSession, queries: DataFrame) -> DataFrame:
    """Adds the settings of each query's (intent_type, complexity)."""
    table = spark.createDataFrame(ROUTES, "intent_type string, complexity string, use_hyde boolean, num_queries int, rerank_top_k int, vector_weight double, text_weight double")
    joined = queries.join(F.broadcast(table), ["intent_type", "complexity"], "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(d)) for n, d in zip(NAMES, DEFAULT, strict=True)})
