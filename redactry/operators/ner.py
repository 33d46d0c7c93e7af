"""Named entities from a tagger's tokens: repair of the text before, merging and scoring after.

The tagging model itself is a parameter. :func:`simple_tagger` is a substitute that
marks runs of capitalised words; it claims no parity with any model.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags, marks stripped from words, sentence marks, administrative units, day names, scores and bounds.
TAGS = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION"}
STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~—–“”"
STOPS = ".-—–"
UNITS = ("phường", "quận", "huyện", "tỉnh", "xã", "thị trấn", "thành phố")
DAYS = ("thứ hai", "thứ ba", "thứ tư", "thứ năm", "thứ sáu", "thứ bảy", "chủ nhật")
BASE, SEVERAL, KNOWN_WORD, INITIAL = 0.5, 0.15, 0.25, 0.1
LONGEST_SYLLABLE, FAR = 8, 100


def syllables(words: DataFrame, word_col: str) -> DataFrame:
    """(syllable, n): parts of two letters and more of the words, in lower case, hyphens as blanks."""
    parts = F.explode(F.split(F.lower(F.regexp_replace(word_col, "-", " ")), "\\s+"))
    return words.select(parts.alias("syllable")).where(F.length("syllable") >= 2).groupBy("syllable").agg(F.count("*").alias("n"))


def segmented(word: str, counts: dict[str, int]) -> list[str] | None:
    """The likeliest way to read a word as two or more known syllables, or None.

    A shortest path from the end: each position keeps the cheapest way to finish.
    """
    low, n, total = word.lower(), len(word), math.log(sum(counts.values()) or 1)
    rest: list[tuple[float, int]] = [(math.inf, 0)] * n + [(0.0, n)]
    for i in range(n - 1, -1, -1):
        steps = ((total - math.log(counts[low[i:j]]) + rest[j][0], j) for j in range(i + 1, min(n, i + LONGEST_SYLLABLE) + 1) if counts.get(low[i:j]))
        rest[i] = min(steps, default=(math.inf, 0))
    if rest[0][0] == math.inf:
        return None
    parts, i = [], 0
    while i < n:
        parts.append(word[i : rest[i][1]])
        i = rest[i][1]
    return parts if len(parts) > 1 else None


def expand_fused(text: str, counts: dict[str, int]) -> tuple[str, list[int]]:
    """(text with fused words parted, for each of its characters the place it had, -1 for an inserted blank)."""
    out, places, at = [], [], 0
    if counts:
        for m in re.finditer(r"\S+", text):
            core = m.group().strip(STRIP)
            if not core or not core.isalpha() or core.lower() in counts:
                continue
            parts = segmented(core, counts)
            if parts:
                a = m.start() + m.group().index(core)
                for part in parts[:-1]:
                    b = a + len(part)
                    out.append(text[at:b] + " ")
                    places += [*range(at, b), -1]
                    at = a = b
    return "".join(out) + text[at:], [*places, *range(at, len(text))]


def collapse_marks(text: str) -> tuple[str, list[int]]:
    """Runs of four and more of one mark become three; the map never inserts."""
    out, places, at = [], [], 0
    for m in re.finditer(r"(.)\1{3,}", text, re.S):
        if not (m[1].isalnum() or m[1].isspace()):
            out.append(text[at : m.start() + 3])
            places += range(at, m.start() + 3)
            at = m.end()
    return "".join(out) + text[at:], [*places, *range(at, len(text))]


def compose(outer: list[int], inner: list[int]) -> list[int]:
    return [-1 if i < 0 else inner[i] for i in outer]


def map_back(start: int, end: int, places: list[int]) -> tuple[int, int] | None:
    """The span before the map, without inserted characters at its ends; None if nothing is left."""
    kept = [p for p in places[start:end] if p >= 0]
    return (kept[0], kept[-1] + 1) if kept else None


def find_token(text: str, token: str, at: int) -> tuple[int, int] | None:
    """The token within FAR characters of a place: as it is, else with any white space for its blanks."""
    window = text[at : at + FAR + len(token)]
    m = re.search(re.escape(token), window) or re.search(r"\s+".join(map(re.escape, token.split())), window) if token.strip() else None
    return (at + m.start(), at + m.end()) if m and m.start() <= FAR else None


def merge_bio(text: str, tagged: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, type) of B and I runs; a token that isn't found is passed over, any other tag closes a run."""
    spans: list[list] = []
    at, alive = 0, False
    for word, tag in tagged:
        place = find_token(text, word, at)
        if place is None:
            continue
        at = place[1]
        head, _, name = tag.partition("-")
        kind = TAGS.get(name)
        if head == "B" and kind:
            spans.append([*place, kind])
            alive = True
        elif head == "I" and alive and spans[-1][2] == kind:
            spans[-1][1] = place[1]
        else:
            alive = False
    return [tuple(s) for s in spans]


def words_of(span: str) -> list[str]:
    return [w for w in (x.strip(STRIP) for x in span.split()) if w]


def corrected(span: str, kind: str) -> str:
    """LOCATION if the span begins with an administrative unit."""
    low = " ".join(words_of(span)).lower()
    return "LOCATION" if any(low == u or low.startswith(u + " ") for u in UNITS) else kind


def sentence_initial(text: str, start: int) -> bool:
    at = start
    while at and text[at - 1].isspace():
        at -= 1
    return at == 0 or text[at - 1] in STOPS or "\n" in text[at:start]


def score(span: str, text: str, start: int, counts: dict[str, int]) -> float:
    words = words_of(span)
    if not words or any(c.isdigit() for c in span) or " ".join(words).lower() in DAYS or not all(len(w) > 1 and w.istitle() for w in words):
        return 0.0
    s = BASE + SEVERAL if len(words) > 1 else BASE - KNOWN_WORD * (words[0].lower() in counts)
    return round(min(1.0, max(0.0, s - INITIAL * sentence_initial(text, start))), 3)


def entities(text: str, tagger: Callable[[str], list[tuple[str, str]]], counts: dict[str, int]) -> list[tuple[int, int, str, float]]:
    """(start, end, type, score) in the given text; a tagger that fails gives none."""
    wide, first = expand_fused(text, counts)
    short, second = collapse_marks(wide)
    places = compose(second, first)
    try:
        tagged = tagger(short)
    except Exception:  # noqa: BLE001 - a model's failure on one text must not fail the job
        return []
    out = []
    for a, b, kind in merge_bio(short, tagged):
        for m in re.finditer(r"[^\n]*\S[^\n]*", short[a:b]):
            piece = m.group().strip()
            x = a + m.start() + m.group().index(piece)
            s = score(piece, short, x, counts)
            span = map_back(x, x + len(piece), places) if s > 0 else None
            if span:
                out.append((*span, corrected(piece, kind), s))
    return out


def simple_tagger(text: str) -> list[tuple[str, str]]:
    """Capitalised runs as PER, after an administrative unit as LOC, with a company word as ORG."""
    out, alive = [], ""
    for m in re.finditer(r"\w+|[^\w\s]", text):
        w = m.group()
        if w[:1].isupper() and w.isalpha():
            kind = alive or ("ORG" if w in ("Công", "Cty", "CTCP") else "LOC" if w.lower() in ("phường", "quận", "huyện", "tỉnh", "xã") else "PER")
            out.append((w, f"{'I' if alive else 'B'}-{kind}"))
            alive = kind
        else:
            out.append((w, "O"))
            alive = ""
    return out


def named_entities(df: DataFrame, id_col: str, text_col: str, load_tagger: Callable[[], Callable] = lambda: simple_tagger, counts: dict[str, int] | None = None) -> DataFrame:
    """(id, entity_type, span_start, span_end, text_val, score). The tagger is loaded once per task; null and empty texts give no row."""
    kind = dict(df.dtypes)[id_col]
    known = counts or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = load_tagger()
        for pdf in frames:
            rows = [(i, k, a, b, t[a:b], s) for i, t in zip(pdf["id"], pdf["text"]) for a, b, k, s in entities(t, tagger, known)]
            yield pd.DataFrame(rows, columns=["id", "entity_type", "span_start", "span_end", "text_val", "score"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return rows.mapInPandas(run, f"id {kind}, entity_type string, span_start int, span_end int, text_val string, score double").withColumnRenamed("id", id_col)
