"""Masking and deletion of spans, and the rule that nothing is given out half redacted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.functions import expressions
from redactry.functions.rules import TOPICS
from redactry.operators.resolve import union_overlapping


def mask(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, tag: bool = True) -> DataFrame:
    """(id, masked): each span replaced by ``<TYPE>`` (or deleted), the rest unchanged; topic flags are never masked.

    Overlapping spans are united first. Texts without spans come out as they are,
    null texts as null. Ids must be unique in ``docs``.
    """
    some = union_overlapping(spans.where(~F.col("entity_type").isin(*TOPICS)), id_col)
    grouped = some.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end", "entity_type"))).alias("_spans"))
    joined = docs.select(id_col, F.col(text_col).alias("_text")).join(grouped, id_col, "left")
    return joined.select(id_col, F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(expressions.masked(F.col("_text"), F.col("_spans"), tag)).alias("masked"))


def fail_closed(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, status, redacted): a document with a span that lies outside its text fails as a whole and has no output."""
    size = docs.select(id_col, F.length(text_col).alias("_n"))
    bad = spans.join(size, id_col).where((F.col("span_start") < 0) | (F.col("span_end") > F.col("_n")) | (F.col("span_start") >= F.col("span_end"))).select(id_col).distinct().withColumn("_bad", F.lit(True))
    out = mask(docs, spans, id_col, text_col).join(bad, id_col, "left")
    return out.select(id_col, F.when(F.col("_bad"), "redaction_failed").otherwise("redacted").alias("status"), F.when(F.col("_bad").isNull(), F.col("masked")).alias("redacted"))
