"""Index lifecycle, change detection and keyed updates over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(where: dict[str, object]) -> Column:
    """Equality for a scalar, membership for a list, all of them together."""
    out = F.lit(True)
    for name, value in where.items():
        out &= F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value
    return out


def delete_where(df: DataFrame, where: dict[str, object]) -> DataFrame:
    """Rows that don't match; a null doesn't match."""
    return df.where(~F.coalesce(condition(where), F.lit(False)))


def update_where(df: DataFrame, where: dict[str, object], new: dict[str, object]) -> DataFrame:
    hit = F.coalesce(condition(where), F.lit(False))
    return df.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in new.items()})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` replaces ``old`` rows of its keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def change_detection(indexed: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """added, deleted, modified and unchanged keys of two states."""
    a, b = indexed.select(key, F.col(digest).alias("_old")), current.select(key, F.col(digest).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def delete_source(documents: DataFrame, mentions: DataFrame, entities: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A source's documents (source), their mentions (source, name) and then the
    entities (name) that no mention is left of."""
    kept = mentions.join(gone, "source", "left_anti")
    return documents.join(gone, "source", "left_anti"), kept, entities.join(kept.select("name").distinct(), "name", "left_semi")
