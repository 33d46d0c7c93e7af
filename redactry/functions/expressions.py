"""Column expressions: spans of a pattern, snippets, check digits, folds. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's flags for the registry's: ignore case with Unicode folding, Unicode classes and boundaries, "." crosses lines.
FLAGS = "(?iuUsm)"


def spans(text: Column, regex: str) -> Column:
    """ARRAY<STRUCT<span_start, span_end, text_val>> of all matches, in code points.

    Spark gives matches without places, so the places are summed from the pieces
    between them: one pass of an aggregate that carries the end of the last match.
    The pattern must not match the empty string. Null gives null.
    """
    rx = FLAGS + regex
    found = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(text, rx, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))
    kind = "array<struct<span_start: int, span_end: int, text_val: string>>"
    start = lambda a, x: a["end"] + F.length(x["gap"])
    step = lambda a, x: F.struct(
        (start(a, x) + F.length(x["hit"])).alias("end"),
        F.concat(a["out"], F.array(F.struct(start(a, x).alias("span_start"), (start(a, x) + F.length(x["hit"])).alias("span_end"), x["hit"].alias("text_val")))).alias("out"),
    )
    first = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out"))
    return F.aggregate(pairs, first, step, lambda a: a["out"])


def snippet(text: Column, start: Column, end: Column, width: int = 40) -> Column:
    """The span with so many code points on either side, clipped to the text."""
    left = F.greatest(start - width, F.lit(0))
    return F.substring(text, left + 1, F.least(F.length(text), end + width) - left)


def stripped(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; null and other strings give null."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.when(digits.rlike("^[0-9]+$"), F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0)


def iban_remainder(iban: Column) -> Column:
    """The number modulo 97 of an IBAN in capitals without blanks; 1 if it is valid."""
    moved = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    return F.aggregate(moved, F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int"))


def masked(text: Column, spans: Column, tag: bool = True) -> Column:
    """Replace sorted spans that don't overlap by ``<TYPE>``, or by nothing."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        label = F.concat(F.lit("<"), x["entity_type"], F.lit(">")) if tag else F.lit("")
        return F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["span_start"] - a["at"]), label).alias("out"), x["span_end"].alias("at"))

    return F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def collapsed(text: Column) -> Column:
    """Runs of four or more of one mark become three."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s])\1{3,}", "$1$1$1")


def composed(outer: Column, inner: Column) -> Column:
    """One offset map after another; -1, an inserted character, stays -1."""
    return F.transform(outer, lambda i: F.when(i == -1, F.lit(-1)).otherwise(F.element_at(inner, i + 1)))
