"""Words and lines with boxes: their text, the boxes of a span, and boxes read from a model's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactry.functions import expressions


def word_spans(words: DataFrame, id_col: str, order_col: str, line_cols: tuple[str, ...], text_col: str) -> DataFrame:
    """The words with ``span_start``, ``span_end`` and ``sep``: their place in the page's text.

    Blank words are left out, outer white space is not part of a word. A new line
    (any of ``line_cols`` changes) is separated by a line feed, else by a blank.
    """
    w = Window.partitionBy(id_col).orderBy(order_col)
    line = F.struct(*line_cols)
    rows = words.withColumn("_t", expressions.stripped(F.col(text_col))).where(F.length("_t") > 0)
    rows = rows.withColumn("_n", F.row_number().over(w)).withColumn("_same", line.eqNullSafe(F.lag(line).over(w)))
    rows = rows.withColumn("sep", F.when(F.col("_n") == 1, "").when(F.col("_same"), " ").otherwise("\n"))
    upto = F.sum(F.length("_t") + F.length("sep")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("span_end", upto.cast("int")).withColumn("span_start", (F.col("span_end") - F.length("_t")).cast("int")).withColumn(text_col, F.col("_t")).drop("_t", "_n", "_same")


def joined_text(placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) from :func:`word_spans` or :func:`line_spans`."""
    pieces = F.sort_array(F.collect_list(F.struct("span_start", F.concat("sep", text_col).alias("s"))))
    return placed.groupBy(id_col).agg(F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("text"))


def line_spans(lines: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """Lines with their places in the text that joins them by line feeds; empty lines count."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    rows = lines.withColumn("sep", F.when(F.row_number().over(w) == 1, "").otherwise("\n"))
    end = F.sum(F.length(text_col) + F.length("sep")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("span_end", end.cast("int")).withColumn("span_start", (F.col("span_end") - F.length(text_col)).cast("int"))


def boxes_of_spans(spans: DataFrame, placed: DataFrame, id_col: str) -> DataFrame:
    """(id, span_start, span_end, entity_type, n_words, x0, y0, x1, y1): the box around all words a span overlaps.

    Spans that overlap no word come out with n_words 0 and null boxes, so a caller can fail closed.
    """
    s = spans.select(id_col, "span_start", "span_end", "entity_type").distinct()
    w = placed.select(F.col(id_col).alias("__word_id"), F.col("span_start").alias("__word_a"), F.col("span_end").alias("__word_b"), "x0", "y0", "x1", "y1")
    hit = (s[id_col] == w["__word_id"]) & (w["__word_a"] < s["span_end"]) & (w["__word_b"] > s["span_start"])
    return s.join(w, hit, "left").groupBy(id_col, "span_start", "span_end", "entity_type").agg(F.count("__word_id").alias("n_words"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def located(boxes: DataFrame, id_col: str) -> DataFrame:
    """(id, located): false for a document with a span that no word covers."""
    return boxes.groupBy(id_col).agg(F.min(F.col("n_words") > 0).alias("located"))


ITEM = "array<struct<text: string, label: string, box_2d: string, box: string, bbox: string>>"


def words_from_json(raw: Column, width: Column, height: Column, y_first: bool, scale: int) -> Column:
    """ARRAY<STRUCT<text, x0, y0, x1, y1>> from a model's answer.

    A Markdown fence around the JSON is taken off, raw control characters in strings
    are allowed, field names may drift (text or label; box_2d, box or bbox). Items
    without text or without four numbers are skipped; an answer that is no list gives
    null. Coordinates run from 0 to ``scale``, ``y_first`` or x first.
    """
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json|JSON)?\s*\n?|\n?\s*```$", "")
    items = F.from_json(bare, ITEM, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})
    word = expressions.stripped
    rows = F.transform(items, lambda i: F.struct(word(F.coalesce(F.when(i["text"] != "", i["text"]), i["label"], F.lit(""))).alias("text"), F.from_json(F.coalesce(i["box_2d"], i["box"], i["bbox"]), "array<string>").alias("b")))
    rows = F.transform(rows, lambda r: F.struct(r["text"].alias("text"), F.transform(r["b"], lambda v: v.try_cast("double")).alias("b")))
    good = F.filter(rows, lambda r: (F.length(r["text"]) > 0) & (F.size(r["b"]) == 4) & ~F.exists(r["b"], lambda v: v.isNull()))
    order = (1, 0, 3, 2) if y_first else (0, 1, 2, 3)
    names = ("x0", "y0", "x1", "y1")
    return F.transform(good, lambda r: F.struct(r["text"].alias("text"), *((r["b"][k] / scale * (width if n[0] == "x" else height)).alias(n) for k, n in zip(order, names))))
