"""Whole jobs: scan a table or a folder, redact a folder, assess a corpus."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactry.functions.rules import CORPUS_THRESHOLD, RULES, THRESHOLD, TOPICS, Rule, active
from redactry.operators import detect, govern, mask, resolve, risk
from redactry.sources import files


def checked(threshold: float) -> float:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return threshold


def scan(
    docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, anonymize: bool = False, language_col: str | None = None,
    languages: tuple[str, ...] = ("en",), rules: tuple[Rule, ...] = RULES, deep: bool = False, extract: Callable | None = None,
) -> DataFrame:
    """(id, status, detected_entities, anonymized_content, deep_scan_status), one row per document with a unique id.

    Documents that are not scanned say why in ``status`` and have no entities. Per
    span the best candidate stands; deep spans replace those they overlap and are
    not held to the threshold. Entities are sorted by start. With ``anonymize`` the
    text comes out with tags, but for topic flags.
    """
    language = F.col(language_col) if language_col else None
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), detect.status(F.col(text_col), language, languages).alias("_status"))
    good = rows.where("_status = 'ok'")
    found = resolve.best_per_span(detect.detect(good, "_id", "_text", rules, checked(threshold)), "_id")
    statuses = None
    if deep:
        passed = govern.deep_scan(good, "_id", "_text", extract)
        statuses = passed.groupBy("_id").agg(F.max("status").alias("deep_scan_status"))
        spans = passed.where("entity_type IS NOT NULL").withColumn("ord", F.lit(1_000_000))
        found = resolve.merge_deep(found, spans.select(*found.columns), "_id")
    entity = F.struct("span_start", "span_end", "ord", "entity_type", "text_val", "score", "context_snippet")
    nested = F.transform(F.sort_array(F.collect_list(entity)), lambda e: F.struct(e["entity_type"].alias("entity_type"), F.struct(e["span_start"].alias("start"), e["span_end"].alias("end"), F.lit(None).cast("int").alias("page")).alias("location"), e["text_val"].alias("text_val"), F.round(e["score"], 3).alias("score"), e["context_snippet"].alias("context_snippet")))
    out = rows.join(found.groupBy("_id").agg(nested.alias("detected_entities")), "_id", "left")
    if anonymize:
        out = out.join(mask.mask(good, found.where(~F.col("entity_type").isin(*TOPICS)), "_id", "_text").withColumnRenamed("masked", "_masked"), "_id", "left")
    if statuses is not None:
        out = out.join(statuses, "_id", "left")
    return out.select(
        F.col("_id").alias(id_col), F.col("_status").alias("status"), F.coalesce("detected_entities", F.array().cast(dict(out.dtypes)["detected_entities"])).alias("detected_entities"),
        F.when(F.lit(anonymize) & (F.col("_status") == "ok"), F.struct((F.col("_masked") if anonymize else F.lit(None).cast("string")).alias("text"))).alias("anonymized_content"),
        (F.col("deep_scan_status") if deep else F.lit(None).cast("string")).alias("deep_scan_status"),
    )


def as_json(responses: DataFrame) -> DataFrame:
    """(response): each row as one JSON document, ready for ``write.text``."""
    return responses.select(F.to_json(F.struct(*responses.columns)).alias("response"))


def scan_files(spark: SparkSession, path: str, pdf: Callable | None = None, **options) -> DataFrame:
    """The files of a folder, scanned; an unreadable file has its error and no entities."""
    texts = files.extract_text(files.read_files(spark, path), pdf)
    found = scan(texts, "path", "text", **options)
    meta = texts.select("path", F.struct("file_type", "total_pages", "processing_mode").alias("document_metadata"), "error")
    return meta.join(found, "path").withColumn("status", F.when(F.col("error").isNotNull(), "unreadable").otherwise(F.col("status")))


def redact_files(spark: SparkSession, path: str, threshold: float = THRESHOLD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Redacted text and DOCX files of a folder; without the guards on language and length."""
    used = active(rules, checked(threshold))

    def load():
        compiled = tuple((r, [re.compile(p.regex, re.I | re.M | re.S) for p in r.patterns]) for r in used)

        def find(text: str) -> list[tuple[int, int, str]]:
            out: list[list] = []
            for kind, a, b, score, _ in sorted(detect.matches(text, compiled, threshold), key=lambda m: (m[1], m[2], m[4])):
                if out and a < out[-1][1]:
                    last = out[-1]
                    out[-1] = [last[0], max(last[1], b), *(last[2:] if last[3] >= score else (kind, score))]
                else:
                    out.append([a, b, kind, score])
            return [(a, b, kind) for a, b, kind, _ in out]

        return find

    return files.redact_files(files.read_files(spark, path), load)


def write_files(redacted: DataFrame, folder: str) -> None:
    """Each redacted file under its name; files that failed are not written. The folder must be shared by the executors."""

    def save(rows) -> None:
        from pathlib import Path

        for r in rows:
            if r.content is not None:
                (Path(folder) / r.name).write_bytes(bytes(r.content))

    redacted.foreachPartition(save)


def assess(docs: DataFrame, id_col: str, text_col: str, threshold: float = CORPUS_THRESHOLD, dedup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(risk per document, totals per type). Without ``dedup`` a number that fits several types counts for each."""
    found = detect.detect(docs, id_col, text_col, threshold=checked(threshold))
    found = resolve.best_per_span(found, id_col) if dedup else found
    return risk.document_risk(docs, found, id_col), risk.corpus_totals(found)
