"""Detection: documents and rules give scored spans."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactry.functions import expressions
from redactry.functions.rules import BOOST, HINTS, LONGEST, NEIGHBOURS, RULES, SNIPPET, THRESHOLD, Pattern, Rule, active
from redactry.sources.tables import spread

TOKEN = re.compile(r"\w+")
HINTED = {name: re.compile(rx, re.I) for name, rx in HINTS.items()}


def words_before(text: str, at: int, n: int = NEIGHBOURS) -> list[str]:
    """The n words before a place, however long; the window grows until it holds one more, so none is cut."""
    room = 100
    while True:
        found = TOKEN.findall(text[max(0, at - room) : at])
        if len(found) > n or room >= at:
            return found[-n:]
        room *= 4


def matches(text: str, rules: tuple[tuple[Rule, list[re.Pattern]], ...], threshold: float) -> list[tuple]:
    """(entity_type, start, end, score, ord) of one text. ``ord`` numbers the patterns, so ties have an order."""
    out, order, holds = [], 0, {}
    for r, compiled in rules:
        for p, rx in zip(r.patterns, compiled):
            order += 1
            if p.hint:
                if p.hint not in holds:
                    holds[p.hint] = HINTED[p.hint].search(text) is not None
                if not holds[p.hint]:
                    continue
            for m in rx.finditer(text):
                a, b = m.span()
                score = p.score
                if r.validate:
                    checked = r.validate(m.group())
                    if checked is None:
                        continue
                    score = checked
                if r.context and score < 1:
                    before, after = words_before(text, a), [t.group() for t in islice(TOKEN.finditer(text, b), NEIGHBOURS)]
                    # a long match may hold its context; its first two words are its own keyword
                    own = TOKEN.findall(m.group())[2:]
                    if any(t.lower() in r.context for t in (*before, *own, *after)):
                        score = min(1.0, score + BOOST)
                if score >= threshold:
                    out.append((r.entity_type, a, b, round(score, 3), order))
    return out


def detect(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, entity_type, span_start, span_end, text_val, score, context_snippet, ord), one row per candidate.

    One Arrow pass evaluates all rules that can reach the threshold, with places,
    context and validators; nothing is shuffled. Null and empty texts give no row.
    Only the two named columns are read, so other columns cannot clash.
    """
    kind = dict(df.dtypes)[id_col]
    used = active(rules, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = tuple((r, [re.compile(p.regex, re.I | re.M | re.S) for p in r.patterns]) for r in used)
        for batch in batches:
            row, cols = [], [[] for _ in range(7)]
            for k, text in enumerate(batch.column(1).to_pylist()):
                for t, a, b, s, o in matches(text, compiled, threshold):
                    row.append(k)
                    for c, v in zip(cols, (t, a, b, text[a:b], s, text[max(0, a - SNIPPET) : b + SNIPPET], o)):
                        c.append(v)
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int32())), *map(pa.array, cols, types)], names=["id", *NAMES])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return (rows if rows.isStreaming else spread(rows)).mapInArrow(run, f"id {kind}, entity_type string, span_start int, span_end int, text_val string, score double, context_snippet string, ord int").withColumnRenamed("id", id_col)


NAMES = ["entity_type", "span_start", "span_end", "text_val", "score", "context_snippet", "ord"]


def detect_type(df: DataFrame, id_col: str, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, entity_type, span_start, span_end, text_val, score): base scores by column expressions alone, without context or validators."""
    def found(r: Rule, p: Pattern) -> Column:
        fields = ("span_start", "span_end", "text_val")
        return F.transform(expressions.spans(F.col("text"), p.regex), lambda x: F.struct(F.lit(r.entity_type).alias("entity_type"), *(x[f].alias(f) for f in fields), F.lit(p.score).alias("score")))

    every = [found(r, p) for r in rules for p in r.patterns]
    rows = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return rows.select(id_col, F.explode(F.concat(*every)).alias("s")).select(id_col, "s.*")


def status(text: Column, language: Column | None = None, allowed: tuple[str, ...] = ("en",), longest: int = LONGEST) -> Column:
    """'ok', or why a text is not scanned: 'empty', 'unsupported_language', 'too_long'. Nothing is dropped in silence."""
    out = F.when(text.isNull() | (F.length(text) < 1), "empty")
    if language is not None:
        out = out.when(~F.coalesce(language.isin(*allowed), F.lit(False)), "unsupported_language")
    return out.when(F.length(text) > longest, "too_long").otherwise("ok")
