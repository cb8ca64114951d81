"""A stored inverted-file index of vectors: cells around centroids, several of
which a query probes, and exact scores within them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.retrieval import QUERY_ROWS, VECTOR_ROWS, best_in_groups, knn, top_k
from lexiloom.session import materialize

SAMPLE = 20_000
ITERATIONS = 12
PIECE_ROWS = 50_000
CELLS = "cell int, doc_id long, embedding array<float>"


def pieces(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The batches' rows, at most so many at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


def fit_centroids(sample: np.ndarray, cells: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means from rows spread evenly over the sample; a cell that
    runs empty takes the row that is worst served. Deterministic."""
    rows = unit(sample)
    centroids = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    for _ in range(iterations):
        score = rows @ centroids.T
        cell = score.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, rows)
        empty = np.flatnonzero(np.bincount(cell, minlength=cells) == 0)
        sums[empty] = rows[np.argsort(score.max(1), kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """Cells of vectors in a shared folder, one folder for each cell, so that a
    search reads the probed ones only; and their centroids."""

    spark: SparkSession
    root: str
    centroids: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """(doc_id, embedding) -> the index, with every vector in it. Centroids
        are fitted on the ``sample`` vectors of the least hash, which is all that
        the driver sees; by default there are as many cells as the root of the
        vectors' number, and at most a twentieth of the sample. Null vectors are
        left out."""
        spark, known = vectors.sparkSession, vectors.select("doc_id", "embedding").where("embedding is not null")
        total = known.count()
        chosen = known.orderBy(F.xxhash64("doc_id", "embedding")).limit(sample).toPandas()
        cells = min(cells or math.ceil(math.sqrt(max(1, total))), max(1, len(chosen) // 20))
        fitted = fit_centroids(np.stack(chosen["embedding"].to_numpy()).astype(np.float64), cells) if len(chosen) else np.zeros((1, 1))
        shared = spark.sparkContext.broadcast(fitted)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces(batches, VECTOR_ROWS):
                rows = unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
                yield batch.assign(cell=(rows @ shared.value.T).argmax(1).astype(np.int32))[["cell", "doc_id", "embedding"]]

        assigned = materialize(known.mapInPandas(assign, CELLS), "vector-cells")
        parts = assigned.groupBy("cell").agg(F.ceil(F.count("*") / PIECE_ROWS).alias("pieces"))
        dealt = assigned.join(F.broadcast(parts), "cell").withColumn("piece", F.pmod(F.xxhash64("doc_id", "embedding"), F.col("pieces")).cast("int"))
        dealt.drop("pieces").repartition("cell", "piece").write.partitionBy("cell").parquet(f"{root}/cells")
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(fitted)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{root}/centroids")
        return cls(spark, root, fitted)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VectorIndex:
        rows = spark.read.parquet(f"{root}/centroids").orderBy("cell").collect()
        return cls(spark, root, np.array([r.centroid for r in rows]))

    def cells(self) -> DataFrame:
        return self.spark.read.schema("doc_id long, embedding array<float>, piece int, cell int").parquet(f"{self.root}/cells")

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, embedding) -> the same with each of the ``probes`` nearest
        cells, and which of them it is (``near``, from 1). A query leaves Python once,
        with its list of cells."""
        shared, most = self.spark.sparkContext.broadcast(self.centroids), min(probes, len(self.centroids))

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces(batches, QUERY_ROWS):
                rows = unit(np.stack(batch["embedding"].to_numpy()).astype(np.float64))
                cells = np.argsort(-(rows @ shared.value.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                yield batch.assign(cells=list(cells))[["query_id", "embedding", "cells"]]

        listed = queries.select("query_id", "embedding").where("embedding is not null").mapInPandas(near, "query_id long, embedding array<float>, cells array<int>")
        return listed.select("query_id", "embedding", F.posexplode("cells").alias("at", "cell")).select("query_id", "embedding", "cell", (F.col("at") + 1).alias("near"))

    def probes_for(self, queries: DataFrame, k: int = 10, least_recall: float = 0.95, sample: int = 1000) -> int:
        """The least number of probes that finds ``least_recall`` of the exact
        best ``k`` of up to ``sample`` of the queries: where in its query's order
        the cell of each exact hit stands."""
        asked = materialize(queries.select("query_id", "embedding").orderBy(F.xxhash64("query_id", "embedding")).limit(sample), "vector-sample")
        stored = self.cells().select("doc_id", "embedding", "cell")
        hits = knn(stored, asked, k).join(stored.select("doc_id", "cell"), "doc_id")
        order = self.probed(asked, len(self.centroids)).select("query_id", "cell", "near")
        counts = hits.join(order, ["query_id", "cell"]).groupBy("near").count().orderBy("near").collect()
        reached, total = 0, sum(r["count"] for r in counts)
        for r in counts:
            reached += r["count"]
            if reached >= least_recall * total:
                return r.near
        return 1

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """(query_id, embedding) -> query_id, doc_id, score, rank: the best by
        exact cosine among the vectors of the ``probes`` nearest cells. All cells
        give the exact result. Queries meet cells piece by piece, and a piece
        gives its best k for each query, so no task holds a whole cell."""
        asked = materialize(self.probed(queries, probes), "vector-probes")
        cells = self.cells().join(F.broadcast(asked.select("cell").distinct()), "cell")
        pieces = materialize(cells.select("cell", "piece").distinct(), "vector-pieces")
        return top_k(best_in_groups(cells, asked.join(pieces, "cell"), ["cell", "piece"], k), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id) twice -> n, n_found, recall: how many of the exact ones were found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("n"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
