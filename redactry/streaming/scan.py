"""Detection and usage windows on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactry.functions.rules import RULES, THRESHOLD, Rule
from redactry.operators.detect import detect
from redactry.sources.shipping import ship


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def detect_stream(docs: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The batch operator on a stream: it keeps no state, so it needs no watermark."""
    return detect(docs, id_col, text_col, rules, threshold)


def calls_per_window(events: DataFrame, key_col: str, time_col: str, id_col: str, late: str = "1 day", size: str = "60 seconds") -> DataFrame:
    """(window_start, key, calls): each event once although delivered twice, rows later than ``late`` dropped.

    State is one row per id and one per key and window until the watermark passes.
    """
    seen = events.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])
    return seen.groupBy(F.window(time_col, size).alias("w"), key_col).agg(F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), key_col, "calls")
