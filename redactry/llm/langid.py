"""Problem 5: languages of texts and of their one-language segments."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactry.llm.arrow import Memo, map_batches
from redactry.llm.layout import Repairer

LANGUAGES = ("de", "en", "es", "fr", "pt", "ru", "vi")
#: Customary names of the languages (two- and three-letter codes, English and own names).
NAMES = {
    "de": "de deu ger german deutsch alemán alemão allemand немецкий",
    "en": "en eng english englisch inglés inglês anglais английский",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol испанский",
    "fr": "fr fra fre french français francais französisch francés francês французский",
    "pt": "pt por portuguese português portugues portugiesisch portugués portugais португальский",
    "ru": "ru rus russian русский russisch ruso russo russe",
    "vi": "vi vie vietnamese tiếng việt việt tiengviet vietnamesisch vietnamita vietnamien вьетнамский",
}
BY_NAME = {name: lang for lang, names in NAMES.items() for name in names.split()}
#: Orders of the blended spectrum (and the whole word), ridge.
ORDERS, RIDGE = (1, 2, 3, 4, 5), 1e-4
#: Bounds of the labelled sample: rows and sentences per language, characters read of a row; landmarks.
SAMPLE_ROWS, SAMPLE_SENTENCES, SAMPLE_CHARS, LANDMARKS = 400, 1200, 5000, 700
#: Words by which a sentence shows its language, at least; and how far its score must lead.
LEAST_WORDS, LEAD = 3, 0.6
#: A lead of this many score units is a confidence of about 0.73.
SOFTNESS = 0.4
TRIM = " .,;:!?()[]{}\"“”«»„…*•/|"
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Abbreviations after which no sentence ends.
SHORT = frozenset("ул г д кв пр стр bât nº no av st rd str nr tel vs etc approx dr mr mrs ms prof corp inc ltd co jr sr".split())
#: Begins with a class of few characters, so the scan for it is fast; no form that a word's end may have is longer than ENDING.
STOP = re.compile(r"[.!?…\n](?:(?<=\n)\s*+|(?<!\n)(?<![.!?…][.!?…])[.!?…]*+[\"'”’»)\]]*+\s++)")
ENDING, BEFORE = 5, re.compile(r"[^\s.!?…]*+\Z")
ITEM = re.compile(r"\s*(?:[-–—*•·]|\d{1,3}[.)])\s")


def label_language(label: str | None) -> str | None:
    """The language a label names, in any customary spelling, else None."""
    if not label:
        return None
    low = label.strip().lower()
    return BY_NAME.get(low) or BY_NAME.get(re.split(r"[-_\s(,;/]", low)[0])


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Half-open spans of sentences and lines."""
    at = 0
    for m in STOP.finditer(text):
        a, b = m.span()
        if text[a] != "\n":
            word = BEFORE.search(text, max(0, a - ENDING), a).group()
            if len(word) <= 1 or word.lower() in SHORT or len(word) <= 3 and word[0].isupper() and not word.isupper() or word.isupper() and len(word) <= 2:
                continue
            after = text[b : b + 1]
            if after and after.islower() and after.isascii():
                continue
        if b > at:
            yield at, b
        at = b
    if at < len(text):
        yield at, len(text)


def page_lines(text: str) -> list[tuple[int, int]]:
    """Spans of running headers, footers and page numbers, which are no sentences of the text."""
    lines = text.split("\n")
    out, at = [], 0
    plain = PAGES.furniture(lines)
    for k, s in enumerate(lines):
        if k in plain:
            out.append((at, at + len(s)))
        at += len(s) + 1
    return out


PAGES = Repairer({}, 1, 1)


def telling(sentence: str) -> list[str]:
    """The different words that show a language: written small, or all words of a line in capitals. Names are passed over."""
    tokens = sentence.split()
    small = list(filter(None, map(SMALL.__getitem__, tokens)))
    if len(tokens) - len(small) >= max(LEAST_WORDS, len(small) + 1):  # as many may be in capitals
        big = list(filter(None, map(BIG.__getitem__, tokens)))
        if len(big) > len(small) and len(big) >= LEAST_WORDS:
            small += big
    return list(dict.fromkeys(small))


def _shape(token: str) -> tuple[str, int]:
    """(word, 1 if written small, 2 if in capitals, else 0)."""
    w = token.strip(TRIM)
    if not WORD.fullmatch(w):
        return "", 0
    return (w, 1) if w.islower() else (w.lower(), 2) if w.isupper() and len(w) > 1 else ("", 0)


#: token -> its word if it is written small, in capitals; else the empty string.
SMALL, BIG = (Memo(lambda t, kind=kind: w[0] if (w := _shape(t))[1] == kind else "") for kind in (1, 2))


def grams(word: str) -> set[str]:
    """Blended spectrum of a word with its ends: which n-grams are present."""
    w = f" {word} "
    return {w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)} | {w}


class Classifier:
    """One-versus-rest kernel ridge regression on Nyström landmarks.

    The kernel of two sentences adds the blended-spectrum presence kernels of their
    different words. It is linear in the gram presences, so the landmarks' part is
    multiplied out once: each gram gets a vector of scores, a word the sum of its
    grams', and a batch of sentences is one product of a sparse word matrix with
    the word scores.
    """

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights
        self.rows = np.zeros((1024, len(LANGUAGES) + 1), np.float32)
        self.memo = Memo(self._word, 10**9, 10**9)  # a word's number must last for a call

    def _word(self, word: str) -> int:
        k = len(self.memo)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        gs = grams(word)
        row = self.rows[k]
        row[:] = 0
        row[-1] = len(gs)
        get = self.weights.get
        for g in gs:
            v = get(g)
            if v is not None:
                row[:-1] += v
        return k

    def score(self, batches: list[list[str]]) -> np.ndarray:
        """Scores of sentences given by their telling words; none may be empty.

        The memo is emptied only between calls: within one, the numbers of its words' rows are still in use.
        """
        if len(self.memo) > 150_000:
            self.memo.clear()
        ids = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(batches)), np.int64)
        starts = np.cumsum([0, *map(len, batches[:-1])])
        sums = np.add.reduceat(self.rows[ids], starts, axis=0)
        return sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1))


def fit(labelled: list[tuple[str, list[str]]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """``labelled``: (language, telling words). Sentences whose label the first fit contradicts are left out of the second."""
    labelled = [(y, ws) for y, ws in labelled if ws]
    if not labelled:
        return Classifier({})
    use = labelled
    for _ in range(2):
        vocabulary: dict[str, int] = {}
        rows, cols = [], []
        norms = np.zeros(len(use), np.float64)
        for i, (_, ws) in enumerate(use):
            for w in ws:
                gs = grams(w)
                norms[i] += len(gs)
                for g in gs:
                    rows.append(i)
                    cols.append(vocabulary.setdefault(g, len(vocabulary)))
        norms = np.sqrt(np.maximum(norms, 1))
        rows, cols = np.array(rows), np.array(cols)
        step = max(1, len(use) // landmarks)
        marks = np.arange(0, len(use), step)[:landmarks]
        place = np.full(len(use), -1)
        place[marks] = np.arange(len(marks))
        at = place[rows] >= 0
        lmat = np.zeros((len(marks), len(vocabulary)), np.float32)
        np.add.at(lmat, (place[rows[at]], cols[at]), 1)
        lmat /= norms[marks, None]
        starts = np.searchsorted(rows, np.arange(len(use) + 1))
        kernel = np.empty((len(use), len(marks)))
        for i in range(0, len(use), 64):  # every sentence against every landmark, in small blocks
            j = min(len(use), i + 64)
            kernel[i:j] = np.add.reduceat(lmat.T[cols[starts[i] : starts[j]]], starts[i:j] - starts[i], axis=0)
        kernel /= norms[:, None]
        kmm = kernel[marks]
        target = np.array([[1.0 if y == lang else -1.0 for lang in LANGUAGES] for y, _ in use])
        alpha = np.linalg.solve(kernel.T @ kernel + ridge * len(use) * (kmm + 1e-3 * np.eye(len(marks))), kernel.T @ target)
        g = lmat.T @ alpha.astype(np.float32)
        model = Classifier(dict(zip(vocabulary, g)))
        guess = np.argmax(model.score([ws for _, ws in labelled]), axis=1)
        use = [x for x, k in zip(labelled, guess) if LANGUAGES[k] == x[0]]
    return model


def train(df: DataFrame, id_col: str = "scan_id", text_col: str = "text", label_col: str = "scan_language") -> Classifier:
    """Fit on a bounded labelled sample: for each language the rows of the least hashed ids, of each its first
    SAMPLE_CHARS characters (less a sentence cut there), then evenly spread sentences."""
    names = F.create_map(*[F.lit(x) for pair in BY_NAME.items() for x in pair])
    label = F.element_at(names, F.split(F.lower(F.trim(label_col)), "[-_ ]")[0])
    ranked = df.select(label.alias("lang"), F.xxhash64(id_col).alias("h")).where(F.col("lang").isNotNull())
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    # ids and labels settle which rows, so the texts of the others are never read
    last = ranked.withColumn("place", place).where(F.col("place") <= SAMPLE_ROWS).groupBy("lang").agg(F.max("h").alias("h")).collect()
    picked = reduce(lambda x, y: x | y, [(F.col("lang") == r.lang) & (F.col("h") <= r.h) for r in last], F.lit(False))
    rows = df.select(label.alias("lang"), F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, SAMPLE_CHARS + 1).alias("text")).where(picked & F.col(text_col).isNotNull())
    pools: dict[str, list[list[str]]] = {x: [] for x in LANGUAGES}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.h, r.text)):
        for a, b in sentences(r.text):
            ws = telling(r.text[a:b])
            if len(ws) >= LEAST_WORDS and b <= SAMPLE_CHARS:
                pools[r.lang].append(ws)
    labelled = []
    for lang, pool in pools.items():
        step = max(1, len(pool) // SAMPLE_SENTENCES)
        labelled += [(lang, ws) for ws in pool[::step][:SAMPLE_SENTENCES]]
    # landmarks are taken at even steps, so languages are dealt in turn
    by = Counter()
    keyed = []
    for y, ws in labelled:
        keyed.append((by[y], y, ws))
        by[y] += 1
    return fit([(y, ws) for _, y, ws in sorted(keyed)])


def segments(df: DataFrame, model: Classifier, id_col: str = "scan_id", text_col: str = "text") -> DataFrame:
    """(id, seg_no, span_start, span_end, lang, confidence, n_sentences) of each one-language segment.

    Sentences that don't tell (list items, names, addresses, numbers) belong to the
    segment they stand in and don't count. A text of only such has one segment with
    the language of all its words and n_sentences 0; with no letters at all lang is
    null and the confidence 0. Null texts give no row.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    def make():
        c = Classifier(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, out = [], [[] for _ in range(6)]
            words, spans, owner = [], [], []
            texts = batch.column(1).to_pylist()
            for k, text in enumerate(texts):
                furniture = page_lines(text) if "\n" in text else []
                for a, b in sentences(text):
                    if furniture and any(x <= a and b <= y + 1 for x, y in furniture):
                        continue
                    s = text[a:b]
                    ws = telling(s)
                    if len(ws) >= LEAST_WORDS and not ITEM.match(s):
                        words.append(ws)
                        spans.append((a, b))
                        owner.append(k)
            scores = c.score(words) if words else np.zeros((0, len(LANGUAGES)))
            top = np.argsort(-scores, axis=1)[:, :2]
            best = np.take_along_axis(scores, top, axis=1)
            found: list[list[tuple]] = [[] for _ in texts]
            for k, span, y, lead in zip(owner, spans, top[:, 0].tolist(), (best[:, 0] - best[:, 1]).tolist()):
                found[k].append((*span, LANGUAGES[y], lead))
            for k, (i, text) in enumerate(zip(batch.column(0).to_pylist(), texts)):
                for row in merged(text, found[k], c):
                    ids.append(i)
                    for col, v in zip(out, row):
                        col.append(v)
            types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32())
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), *map(pa.array, out, types)], names=["id", "seg_no", "span_start", "span_end", "lang", "confidence", "n_sentences"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return map_batches(rows, make, f"id {kind}, seg_no int, span_start int, span_end int, lang string, confidence double, n_sentences int").withColumnRenamed("id", id_col)


def merged(text: str, found: list[tuple], c: Classifier) -> list[tuple]:
    """Runs of sentences of one language; a sentence without a clear lead goes with the clear ones around it."""
    clear = [f for f in found if f[3] >= LEAD]
    if not clear:
        ws = list(dict.fromkeys(w.lower() for w in WORD.findall(text)))
        if not ws:
            return [(0, 0, len(text), None, 0.0, 0)]
        s = c.score([ws])[0]
        best, second = np.argsort(-s)[:2]
        return [(0, 0, len(text), LANGUAGES[best], sure(float(s[best] - s[second])), len(found))]
    runs: list[list] = []
    for a, b, lang, lead in clear:
        if runs and runs[-1][2] == lang:
            runs[-1][1] = b
            runs[-1][3].append(lead)
        else:
            runs.append([a, b, lang, [lead]])
    out = []
    for k, (a, _, lang, leads) in enumerate(runs):
        start = a if k else 0
        end = runs[k + 1][0] if k + 1 < len(runs) else len(text)
        out.append((k, start, end, lang, sure(sum(leads) / len(leads)), len(leads)))
    return out


def sure(lead: float) -> float:
    return round(1 / (1 + float(np.exp(-lead / SOFTNESS))), 4)
