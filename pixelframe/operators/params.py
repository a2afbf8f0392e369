"""Parameters as rows (pid, path, ordinal, value, liquid, step, lower, upper, maxstep, shared_key): freezing, indexing, priors, bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freeze(params: DataFrame, pattern: str) -> DataFrame:
    """Freeze every parameter whose path matches."""
    return params.withColumn("liquid", F.col("liquid") & ~F.col("path").rlike(pattern))


def thaw(params: DataFrame, pattern: str) -> DataFrame:
    """Thaw matches; a path is reached through its ancestors, so these count as thawed with it."""
    return params.withColumn("liquid", F.col("liquid") | F.col("path").rlike(pattern))


def freeze_all_but(params: DataFrame, pattern: str) -> DataFrame:
    return params.withColumn("liquid", F.col("path").rlike(pattern))


def liquid_index(params: DataFrame) -> DataFrame:
    """index of each parameter among the thawed ones, -1 where frozen. One owner's parameters are numbered together."""
    w = Window.partitionBy("owner", "liquid").orderBy("ordinal")
    return params.withColumn("idx", F.when(F.col("liquid"), F.row_number().over(w) - 1).otherwise(F.lit(-1)).cast("int"))


def updated(params: DataFrame, new: DataFrame) -> DataFrame:
    """Values replaced by those of new (pid, value) where liquid."""
    n = new.select("pid", F.col("value").alias("_v"))
    return params.join(n, "pid", "left").withColumn("value", F.when(F.col("liquid"), F.coalesce("_v", "value")).otherwise(F.col("value"))).drop("_v")


def log_prior(value: Column, mu: Column, sigma: Column) -> Column:
    z = (value - mu) / sigma
    return -0.5 * z * z


def legal_or_inf(logp: Column, legal: Column) -> Column:
    """-infinity outside the legal region and for NaN."""
    return F.when(legal & ~F.isnan(logp), logp).otherwise(F.lit(float("-inf")))


def shared_index(params: DataFrame) -> DataFrame:
    """Column number of each liquid parameter after shared ones are merged, by first appearance."""
    key = F.coalesce(F.col("shared_key"), F.col("pid"))
    first = params.where("liquid").withColumn("k", key).groupBy("owner", "k").agg(F.min("ordinal").alias("first"))
    w = Window.partitionBy("owner").orderBy("first")
    cols = first.withColumn("col", (F.row_number().over(w) - 1).cast("int"))
    return params.where("liquid").withColumn("k", key).join(cols.select("owner", "k", "col"), ["owner", "k"]).drop("k")
