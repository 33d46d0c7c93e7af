"""Span algebra: which of several spans stand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactry.functions.rules import COMPETING


def best_per_span(spans: DataFrame, id_col: str) -> DataFrame:
    """One row per (id, start, end): the highest score, of equal ones the first in ``ord``, then by type."""
    w = Window.partitionBy(id_col, "span_start", "span_end").orderBy(F.col("score").desc_nulls_last(), F.col("ord"), "entity_type")
    return spans.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_overlapping(spans: DataFrame, id_col: str) -> DataFrame:
    """(id, span_start, span_end, entity_type, score): overlapping spans become one; touching ones stay apart.

    A span opens a new island if it starts at or behind the furthest end so far.
    Type and score are those of the best span, of equal ones the earliest.
    """
    order = Window.partitionBy(id_col).orderBy("span_start", "span_end", "ord", "entity_type")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.when(reach.isNull() | (F.col("span_start") >= reach), 1).otherwise(0))
    islands = islands.withColumn("_island", F.sum("_new").over(order)).withColumn("_at", F.row_number().over(order))
    best = F.max_by("entity_type", F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("_at")))
    return islands.groupBy(id_col, "_island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), best.alias("entity_type"), F.max("score").alias("score")).drop("_island")


def drop_overlapped(base: DataFrame, deep: DataFrame, id_col: str, types: tuple[str, ...] = COMPETING) -> DataFrame:
    """Rows of ``base`` except those of a competing type that a competing span of ``deep`` overlaps; touching is no overlap."""
    d = deep.where(F.col("entity_type").isin(*types)).select(F.col(id_col).alias("__deep_id"), F.col("span_start").alias("__deep_a"), F.col("span_end").alias("__deep_b"))
    hit = (F.col(id_col) == F.col("__deep_id")) & (F.col("span_start") < F.col("__deep_b")) & (F.col("__deep_a") < F.col("span_end")) & F.col("entity_type").isin(*types)
    return base.join(d, hit, "left_anti")


def merge_deep(base: DataFrame, deep: DataFrame, id_col: str) -> DataFrame:
    """Deep spans replace competing ones they overlap and are added without regard to a threshold."""
    return drop_overlapped(base, deep, id_col).unionByName(deep, allowMissingColumns=True)
