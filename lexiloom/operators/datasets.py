"""Evaluation datasets: loading, checking, merging, profiles and question plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.session import materialize

SAMPLE = "id int, question string, query_type string, difficulty string, expected_sources array<string>, expected_keywords array<string>, reference_answer string"
# Fields that a sample must have, kinds and difficulties of questions, and how many of each are wanted of a hundred or so.
REQUIRED = ["question", "expected_sources", "expected_keywords", "reference_answer"]
QUERY_TYPES = ["factoid", "analytical", "procedural", "exploratory"]
DIFFICULTIES = ["easy", "medium", "hard"]
TARGETS = {"factoid": (10, 10, 10), "analytical": (8, 10, 7), "procedural": (8, 10, 7), "exploratory": (5, 5, 5)}


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of samples; fields that aren't told are null."""
    return spark.read.schema(SAMPLE).option("multiLine", "true").json(path)


def sample_errors(sample: Column) -> Column:
    """What is wrong with a sample (a variant): not an object, fields that are lacking, unknown kinds."""

    def field(name: str) -> Column:
        return F.try_variant_get(sample, f"$.{name}", "string")

    def among(name: str, values: list[str]) -> Column:
        return F.when(field(name).isNotNull() & ~field(name).isin(values), F.concat(F.lit(f"invalid {name}: "), field(name)))

    lacking = [F.when(F.try_variant_get(sample, f"$.{n}", "variant").isNull(), f"lacks {n}") for n in REQUIRED]
    listed = F.array_compact(F.array(*lacking, among("query_type", QUERY_TYPES), among("difficulty", DIFFICULTIES)))
    return F.when(F.schema_of_variant(sample).startswith("OBJECT"), listed).otherwise(F.array(F.lit("not an object")))


def validate(lines: DataFrame) -> DataFrame:
    """(sample_no, json) -> (sample_no, error), one row for each thing that is wrong."""
    parsed = F.try_parse_json(F.col("json"))
    errors = F.when(parsed.isNull(), F.array(F.lit("not JSON"))).otherwise(sample_errors(parsed))
    return lines.select("sample_no", F.explode(errors).alias("error"))


def merge(parts: list[DataFrame], order: str) -> DataFrame:
    """Datasets one after another, numbered anew from 1. Rows are dealt by ranges
    of (part, order), each range is numbered within and set on by the sizes of
    those before it, so no dataset is sorted in one task."""
    marked = None
    for i, part in enumerate(parts):
        one = part.withColumn("_part", F.lit(i))
        marked = one if marked is None else marked.unionByName(one)
    ranges = materialize(marked.repartitionByRange("_part", order).withColumn("_range", F.spark_partition_id()), "datasets-merged")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_part", order))
    return ranges.withColumn("_k", within).join(F.broadcast(starts), "_range").withColumn("id", F.col("_start") + F.col("_k")).drop("_part", "_range", "_k", "_start")


def profile(samples: DataFrame) -> DataFrame:
    """(query_type, difficulty, n, percent) by each of both, and by neither (n of all)."""
    kinds = samples.select(F.coalesce("query_type", F.lit("unknown")).alias("query_type"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"))
    grouped = kinds.groupingSets([["query_type"], ["difficulty"], []], "query_type", "difficulty").agg(F.count("*").alias("n"))
    total = kinds.agg(F.count("*").alias("_all"))
    return grouped.join(F.broadcast(total)).select("query_type", "difficulty", "n", F.round(100 * F.col("n") / F.col("_all"), 1).alias("percent"))


def keyword_profile(samples: DataFrame) -> DataFrame:
    """How many keywords there are in all, how many different ones, and how many a sample has."""
    words = samples.select(F.explode("expected_keywords").alias("k")).agg(F.count("*").alias("keywords"), F.countDistinct("k").alias("distinct_keywords"))
    n = samples.agg(F.count("*").alias("n"))
    return words.join(F.broadcast(n)).select("n", "keywords", "distinct_keywords", F.round(F.col("keywords") / F.col("n"), 1).alias("per_sample"))


def question_plan(topics: DataFrame, count: int = 95, seed: int = 42) -> DataFrame:
    """Topics (topic, source) -> (id, query_type, difficulty, topic, source): as
    many questions of each kind and difficulty as the targets ask, scaled to
    ``count``, one at least, on topics drawn by hash."""
    spark = topics.sparkSession
    scale = count / sum(map(sum, TARGETS.values()))
    cells = [(t, d, max(1, round(n * scale))) for t, row in TARGETS.items() for d, n in zip(DIFFICULTIES, row, strict=True)]
    wanted = [(i, t, d) for i, (t, d) in enumerate((t, d) for t, d, n in cells for _ in range(n))]
    plan = spark.createDataFrame(wanted, "slot int, query_type string, difficulty string")
    drawn = topics.withColumn("_h", F.xxhash64("topic", "source", F.lit(seed))).orderBy("_h", "topic", "source").limit(len(wanted))
    placed = drawn.withColumn("_p", F.row_number().over(Window.orderBy("_h", "topic", "source")) - 1)
    n = placed.agg(F.count("*").alias("_n"))
    asked = plan.join(F.broadcast(n)).withColumn("_p", F.when(F.col("_n") > 0, F.pmod(F.col("slot"), F.col("_n"))))
    return asked.join(placed, "_p", "left").select((F.col("slot") + 1).alias("id"), "query_type", "difficulty", "topic", "source")
