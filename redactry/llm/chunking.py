"""Problem 7: pieces under a size limit, cut at natural boundaries, with overlap."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.llm.arrow import map_batches

#: Code points a request may have before it must be cut.
LIMIT = 50_000
#: From the coarsest to the finest boundary; a cut is made behind the match.
SEPARATORS = (
    re.compile(r"\n[ \t]*\n(?=[^\n]*\n[ \t]*\n)|\f"),  # section: a lone line between blank ones, or a form feed
    re.compile(r"\n\s*\n"),  # paragraph
    re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+|\n"),  # sentence or line
    re.compile(r"\s+"),  # word
)


def boundaries(text: str, lo: int, hi: int, size: int, level: int = 0) -> list[int]:
    """Ends of atoms that tile text[lo:hi], none longer than ``size``, split no finer than needed.

    The loop goes one separator deeper only inside an atom that is too long;
    below words it falls back to code points, never inside a combining run if avoidable.
    """
    if hi - lo <= size:
        return [hi]
    if level == len(SEPARATORS):
        ends, at = [], lo
        while hi - at > size:
            cut = at + size
            while cut > at + 1 and cut < hi and re.match(r"[̀-ͯ‍️]", text[cut]):
                cut -= 1
            if cut == at + 1 and size > 1:
                cut = at + size
            ends.append(cut)
            at = cut
        return [*ends, hi]
    cuts = [m.end() for m in SEPARATORS[level].finditer(text, lo, hi) if lo < m.end() < hi]
    out, at = [], lo
    for end in [*cuts, hi]:
        out.extend(boundaries(text, at, end, size, level + 1))
        at = end
    return out


def split_spans(text: str, limit: int = LIMIT, overlap: int = 0) -> list[tuple[int, int]]:
    """Half-open spans of the pieces.

    Atoms are packed greedily. Each piece after the first starts exactly
    ``overlap`` code points before the end of the one before it, so
    ``text == p[0] + "".join(p[i][overlap:])`` holds for every text.
    An empty text gives one empty piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    if len(text) <= limit:
        return [(0, len(text))]
    spans, start, end, room = [], 0, 0, limit
    for b in boundaries(text, 0, len(text), limit - overlap):
        if b - start > limit:
            spans.append((start, end))
            start = end - overlap
        end = b
    return [*spans, (start, end)]


def split_pieces(df: DataFrame, id_col: str = "scan_id", text_col: str = "text", limit: int = LIMIT, overlap: int = 0, all_rows: bool = False) -> DataFrame:
    """(id, piece_no, n_pieces, span_start, span_end, overlap, piece), one row per piece.

    By default only texts over the limit are cut; with ``all_rows`` the others come
    out as one piece. Null texts give no row, empty ones (``all_rows``) one empty piece.
    The length filter runs in the JVM, so short texts never reach Python.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if not all_rows:
        rows = rows.where(F.length("text") > limit)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, cols = [], [[] for _ in range(6)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = split_spans(text, limit, overlap)
                for k, (a, b) in enumerate(spans):
                    ids.append(i)
                    for c, v in zip(cols, (k, len(spans), a, b, overlap if k else 0, text[a:b])):
                        c.append(v)
            t = pa.int32()
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c in cols[:5]), pa.array(cols[5], pa.string())], names=["id", "piece_no", "n_pieces", "span_start", "span_end", "overlap", "piece"])

        return step

    out = map_batches(rows, make, f"id {kind}, piece_no int, n_pieces int, span_start int, span_end int, overlap int, piece string")
    return out.withColumnRenamed("id", id_col)
