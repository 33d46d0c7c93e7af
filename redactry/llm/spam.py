"""Problem 10: keyword-stuffed pages and link lists."""

from __future__ import annotations

import codecs
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, compress, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.llm.arrow import map_batches
from redactry.sources.tables import checkpointed

#: Frequent function words of the languages, by which sentences are told from lists.
FUNCTION_WORDS = {
    "en": "the a an of in to and for is are was be been that which by with on at as from or it this these those has have may can not when where after before than then if you your we our such each one no yet so said",
    "de": "der die das den dem des ein eine einer eines einem einen und oder in im zu zum zur für ist sind wird werden wurde bei mit nach von vom aus auf an am über unter durch wobei dass sich nicht auch als wie es er sie wenn so lang etwa bis",
    "fr": "le la les un une des du de d l et ou en dans pour par sur avec sans est sont a été que qui dont au aux ce cette ces se s il elle on ne pas plus comme à y si tant où",
    "es": "el la los las un una unos unas de del y o en para por con sin sobre es son se que cuyo como al a su sus este esta lo no si cuando donde está entre ha más según hasta",
    "pt": "o a os as um uma de do da dos das e ou em no na nos nas para por com sem sobre é são se que como ao à seu sua este esta não quando onde entre mais",
    "it": "il lo la i gli le un una di del della dei delle e o in nel nella per con senza su è sono si che come al alla suo sua questo questa non quando dove tra più",
}
WORDS = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
#: Words a window holds.
WINDOW = 50
#: Of a language's median window, the part below which a window is too poor in function words, or in different words.
POOR, REPETITIVE = 0.4, 0.56
#: Words of an n-gram; least limits of a page's top-word, repeated n-gram and duplicate-line share, and the part of the
#: way from a language's third quartile of documents to 1 at which they lie if that is more.
GRAM, LEAST_LIMITS, ABOVE = 5, (0.15, 0.6, 0.3), 0.1
#: Words in a row of list-like lines that make more than a heading, and the part of a page that makes it spam.
RUN, SHARE = 16, 0.5
#: Kinds of function words that lists of terms hold too ("cuerpo de válvula").
FEW = 3
LINK = re.compile(r"\[[^\]\n]*\]\(\S*\)|<a\s[^>]*>.*?</a>|(?:https?://|www\.)\S+", re.I)
TAG = re.compile(r"#[^\W\d]\w*")
#: White space between a sentence's end and a letter, or line feeds; begins with a class, so that what is none is passed over fast.
CUT = re.compile(r"\s(?:(?<=[.!?]\s)\s*+(?=[^\W\d_])|(?<=\n)\n*+)")
#: The first of these, found by the sentence's end, as few signs are one.
END = re.compile(r"[.!?]\s+(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")
#: A page of bytes for lower-case texts: ASCII, frequent signs, and the small letters of Latin-1, Greek and Latin Extended-A.
PAGE = "".join(map(chr, range(128))) + ("–—“”„’…" + "".join(chr(c) for part in ((0xAA, 0x100), (0x3B1, 0x3CA), (0x101, 0x180)) for c in range(*part) if WORD.match(chr(c)) and chr(c) == chr(c).lower()))[:128]
PAGE = PAGE.ljust(256, "\ufffe")
TO_PAGE = codecs.charmap_build(PAGE)
#: Of its bytes those of WORD's letters and line feeds, blanks for the others.
LETTERS = bytes(b if b == 10 or WORD.match(PAGE[b]) else 32 for b in range(256))
#: What marks a patent's own lists: reference signs, classes, cited works, sequences, formulas; and how a
#: claim refers to others, by a number, a range or any of them.
OWN = re.compile(r"^\(?\d{1,4}[a-z]?\)?[\s:–-]+[^\d,.;|»›/#]{2,60}$|^\[\d+\]\s.*|^[A-H]\d\d[A-Z]\s?\d+/\d+.*|^SEQ ID.*", re.I | re.S)
CLAIM = re.compile(r"\b(?:claims?|ansprüche?n?|anspruch|patentansprüche?n?|revendications?|reivindicaci(?:ón|ones)|reivindicaç(?:ão|ões))\b", re.I)
#: Parts of lower-case texts one of which CLAIM needs, as re.I takes a dotless i for i and a long s for s.
CLAIM_PARTS = ("claim", "spruch", "sprüch", "revendication", "reivindica", "ı", "ſ", "i\u0307")
#: Documents of a label that a language without a list needs, before its function words are learned from them, the share
#: of these documents and the part of all their words that such a word makes up.
LEARNED_FROM, IN_DOCUMENTS, OF_WORDS = 100, 0.5, 0.005
SEQUENCE = re.compile(r"\b(?:[acgtun]{9,}|[ACDEFGHIKLMNPQRSTVWY]{9,})\b")
#: The letters of sequences by their kinds, line feeds, blanks for other bytes; and what a SEQUENCE needs of them.
RUNS = bytes(b if b == 10 else 97 if chr(b) in "acgtun" else 65 if chr(b) in "ACDEFGHIKLMNPQRSTVWY" else 32 for b in range(256))
SMALL, CAPITALS = b"a" * 9, b"A" * 9
SIGNS = "|›»/•·,;#>"
DASHES = (" - ", " – ", " — ")
SEPARATOR = re.compile(rf"[{SIGNS}]| [-–—] ")


@cache
def languages_of(*known: tuple[str, frozenset[str]]) -> dict[str, list[str]]:
    """Function word -> the languages it is one of."""
    return {w: [x for x, ws in known if w in ws] for w in frozenset().union(*(ws for _, ws in known))}


def language(words: list[str], lang: str | None, known: dict[str, frozenset[str]] = WORDS) -> str:
    """The language whose function words fill most of the text; the label only decides where hardly any occur, as labels
    are often wrong. '' if the label names none that is known: its function words say nothing then."""
    of, counts = languages_of(*known.items()), dict.fromkeys(known, 0)
    for w, n in Counter(filter(of.__contains__, words)).items():
        for x in of[w]:
            counts[x] += n
    best, n = max(counts.items(), key=lambda x: (x[1], x[0] == lang))
    return best if n * 12 > len(words) else lang if lang in known else ""


def windows(text: str, lang: str | None, known: dict[str, frozenset[str]] = WORDS) -> tuple[str, list[tuple[int, int]]]:
    """(language, (per cent of function words, per cent of different words) of each window)."""
    w = text.lower().split()
    lang = language(w, lang, known)
    known = known.get(lang, frozenset())
    out = []
    for i in range(0, len(w) - WINDOW + 1, WINDOW):
        s = w[i : i + WINDOW]
        out.append((100 * sum(map(known.__contains__, s)) // WINDOW, 100 * len(set(s)) // WINDOW))
    return lang, out


def cut(text: str) -> list[str]:
    """What CUT leaves of the text but for blank parts."""
    out, at = [], 0
    for m in END.finditer(text):
        out += text[at : m.start() + 1].split("\n")
        at = m.end()
    out += text[at:].split("\n")
    return [u for u in out if u and not u.isspace()]


def blank(error: UnicodeError) -> tuple[str, int]:
    """A blank for signs that PAGE lacks, if none is a letter."""
    if WORD.search(error.object, error.start, error.end):
        raise error
    return " ", error.end


codecs.register_error("redactry.blank", blank)


def words_of(lines: str) -> list[list[str]]:
    """WORD's words of each line of a lower-case text; by a table of bytes, many times faster than the pattern, but in
    lines with letters that PAGE lacks."""
    try:
        page = codecs.charmap_encode(lines, "redactry.blank", TO_PAGE)[0]
    except UnicodeEncodeError:
        each = lines.split("\n")
        return [WORD.findall(lines)] if len(each) == 1 else [words for line in each for words in words_of(line)]
    return list(map(str.split, codecs.charmap_decode(page.translate(LETTERS), "strict", PAGE)[0].split("\n")))


def separators(unit: str) -> int:
    """How many SEPARATORs a unit has; counted sign by sign where no dash stands alone."""
    if any(map(unit.__contains__, DASHES)):
        return len(SEPARATOR.findall(unit))
    return sum(map(unit.count, SIGNS))


def grams(words: list[str]) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(GRAM)))


def shares(words: list[str], units: list[str], known: frozenset[str], least_top: float = -1.0, least_grams: float = -1.0) -> tuple[float, float, float, str]:
    """Top-word share of the words, share of repeated n-grams (either 0 if it can't be beyond its ``least``), share of
    duplicate units (copies beyond the first), and the top word. All 0 for texts of less than a window of words."""
    if len(words) < WINDOW:
        return 0.0, 0.0, 0.0, ""
    counts = Counter(words)
    most, top = 0, ""
    for w, n in counts.items() if max(counts.values()) / len(words) > least_top else ():
        if n >= most and (n > most or w > top) and w not in known and len(w) > 1:
            most, top = n, w
    # each word's first occurrence ends an n-gram that is new, so a page of enough different words needs no count of them
    all_grams = len(words) - GRAM + 1
    few = 1 - (len(counts) - GRAM + 1) / all_grams > least_grams
    total = sum(map(len, units)) or 1
    return most / len(words), 1 - len(set(grams(words))) / all_grams if few else 0.0, 1 - sum(map(len, set(units))) / total, top


def function_words(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, frozenset[str]]:
    """The lists above, and for each other label of at least LEARNED_FROM documents the words that stand in most of them
    and make up OF_WORDS of all their words: at most 1 / OF_WORDS a label, of at most as many labels as have that share
    of the documents. Only texts of such labels are counted."""
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where((F.length("text") > 0) & F.col("lang").isNotNull() & ~F.col("lang").isin(*WORDS))
    labels = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEARNED_FROM).collect()}
    if not labels:
        return WORDS

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, total = Counter(), Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = WORD.findall(text.lower())
                total.update((lang, w) for w in ws)
                docs.update((lang, w) for w in set(ws))
            keys = list(docs)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "w", "docs", "n"])

        return step

    counts = map_batches(rows.where(F.col("lang").isin(*labels)), make, "lang string, w string, docs bigint, n bigint").groupBy("lang", "w").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    counts = checkpointed(counts)
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    least = F.create_map(*[F.lit(x) for k in totals for x in (k, OF_WORDS * totals[k])]), F.create_map(*[F.lit(x) for k in labels for x in (k, IN_DOCUMENTS * labels[k])])
    learned: dict[str, set[str]] = defaultdict(set)
    for r in counts.where((F.col("n") >= least[0][F.col("lang")]) & (F.col("docs") >= least[1][F.col("lang")])).collect():
        learned[r.lang].add(r.w)
    return WORDS | {k: frozenset(ws) for k, ws in learned.items()}


def calibrate(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, tuple]:
    """language -> (its function words, least share of them, least share of different words), from the windows of all
    documents, then the most a page may have as top-word, repeated n-gram and duplicate-line share, from all documents.
    '' stands for texts of no known language, which are not judged by function words.

    Histograms of whole per cents are summed per task and then over all tasks, so the
    driver gets a table whose size does not depend on the corpus.
    """
    known = function_words(df, text_col, lang_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hist: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    lang, found = windows(text, lang, known)
                    for f, d in found:
                        hist[lang, 0, f] += 1
                        hist[lang, 1, d] += 1
                    if found:
                        units = list(map(str.strip, cut(text)))
                        words = list(chain.from_iterable(words_of(text.lower())))
                        for what, x in enumerate(shares(words, units, known.get(lang, frozenset()))[:3], 2):
                            hist[lang, what, int(100 * x)] += 1
            keys = list(hist)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([hist[k] for k in keys], pa.int64())], names=["lang", "what", "bin", "n"])

        return step

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.length("text") > 0)
    hist = defaultdict(list)
    for r in map_batches(rows, make, "lang string, what int, bin int, n bigint").groupBy("lang", "what", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.lang, r.what].append((r.bin, r.n))

    def quantile(key, part: float = 0.5) -> float | None:
        seen, enough = 0, sum(n for _, n in hist[key]) * part
        for b, n in sorted(hist[key]):
            seen += n
            if seen >= enough:
                return b / 100
        return None

    out = {}
    for lang in (*known, ""):
        f, d = quantile((lang, 0)), quantile((lang, 1))
        most = ((quantile((lang, k), 0.75) or 0.0, least) for k, least in enumerate(LEAST_LIMITS, 2))
        # a median of a language that is mostly spam, or that hardly occurs, is no measure
        out[lang] = (known.get(lang, frozenset()), POOR * min(0.5, f or 0.35) if lang else 0.0, REPETITIVE * min(0.75, max(0.55, d or 0.65)), *(max(least, q + ABOVE * (1 - q)) for q, least in most))
    return out


def measure(text: str, lang: str | None, limits: dict[str, tuple]) -> dict[str, float]:
    """Shares of the text's characters: links, lists (missing function words and dense separators or repeated
    words), repetition (few different words, or units that make up a top-word or repeated n-gram share beyond its
    limit), duplicate lines, and ``spam``, their union; of duplicate lines the copies beyond the first count, if
    the page's share of them is beyond its limit.

    A patent's own lists, by their form, are never spam.
    """
    out = dict.fromkeys(("links", "lists", "repeats", "duplicates", "spam"), 0.0)
    whole = text.lower()
    lang = language(whole.split(), lang, {k: v[0] for k, v in limits.items() if k})
    known, least_f, least_d, *most = limits.get(lang) or (frozenset(), 0.0, REPETITIVE * 0.65)
    most_top, most_grams, most_copies = most or LEAST_LIMITS
    units = cut(text)
    if not units:
        return out
    linked = ("](" in text or "<a" in whole or "://" in text or "www." in whole) and LINK.search(text) is not None
    lines = "\n".join(units)  # no unit has a line feed
    low_lines = lines.lower()
    lower, bare = low_lines.split("\n"), list(map(str.strip, units))
    words = words_of("\n".join([LINK.sub(" ", u) for u in units]).lower() if linked else low_lines)
    size = list(map(len, bare))
    common = [list(filter(known.__contains__, w)) for w in words]
    # a claim is known by the word and the sentence around it, never by the word alone
    runs = lines.encode("ascii", "replace").translate(RUNS)
    sequences = [SMALL in r or CAPITALS in r for r in runs.split(b"\n")] if SMALL in runs or CAPITALS in runs else repeat(False)
    claims, enough = [part for part in CLAIM_PARTS if part in whole], max(least_f, 0.15)
    own = [bool(OWN.match(t)) or r and bool(SEQUENCE.search(u)) or bool(claims) and len(w) > 4 and len(f) >= enough * len(w) and any(map(low.__contains__, claims)) and bool(CLAIM.search(u)) for u, t, low, w, f, r in zip(units, bare, lower, words, common, sequences)]
    link = [linked and not o and sum(len(m.group()) for m in LINK.finditer(u)) > 0.4 * n for u, n, o in zip(units, size, own)]
    tags = ["#" in u and sum(len(m.group()) for m in TAG.finditer(u)) > 0.5 * n for u, n in zip(units, size)]
    thin = []
    there = "".join(s for s in SIGNS if s in text)
    dashes = [d for d in DASHES if d in text]
    signs = [separators(u) if dashes and any(map(u.__contains__, dashes)) else sum(map(u.count, there)) for u in units]
    for u, w, o, t, f, s in zip(units, words, own, tags, common, signs):
        dense = s * 5 > len(w)
        # without a known language only separators tell a list from a sentence
        poor = len(f) / (len(w) or 1) < least_f or len(set(f)) <= min(FEW, len(w) // 8) and (len(w) > 12 or dense) if lang else dense or len(w) <= FEW
        thin.append(t or not o and len(w) > 0 and poor)
    listed = [False] * len(units)
    i = 0
    while i < len(units):
        if not (thin[i] or link[i]):
            i += 1
            continue
        j = i
        while j < len(units) and (thin[j] or link[j] or not words[j]):
            j += 1
        row = [x for k in range(i, j) for x in words[k]]
        marks = sum(signs[i:j]) + (j - i)
        if len(row) >= RUN and (len(set(row)) < 0.8 * len(row) or marks * 8 > len(row)):
            listed[i:j] = [thin[k] for k in range(i, j)]
        i = j
    repeats = [False] * len(units)
    judged = [i for i, (w, o) in enumerate(zip(words, own)) if w and not o]
    theirs = list(chain.from_iterable(map(words.__getitem__, judged)))
    begins = [0, *accumulate(len(words[i]) for i in judged)]
    # how many words up to each unit stood less than two windows before too: a part of the text repeats no more than these
    last, again, repeated = {}, 0, [0]
    for i, a in zip(judged, begins):
        for at, w in enumerate(words[i], a):
            if at - last.get(w, -2 * WINDOW) < 2 * WINDOW:
                again += 1
            last[w] = at
        repeated.append(again)

    def said(i: int, others: list[str]) -> bool:
        mine = set(words[i])
        return len(mine.difference(others)) <= 0.35 * len(mine)

    for k, (i, a, b) in enumerate(zip(judged, begins, begins[1:])):
        if b - a >= WINDOW:
            continue  # it fills a window, so there are no others that say the same
        # the unit with whole units before it, the last of them cut at its end, or behind it, until they fill a window
        before = max(0, bisect_right(begins, b - WINDOW) - 1)
        first, second = begins[before], begins[before + 1]
        n = b - first
        full = n if n < 2 * WINDOW else 2 * WINDOW
        if n >= 0.6 * WINDOW and (n > 2 * WINDOW or n - repeated[k + 1] + repeated[before] < least_d * n):
            part = theirs[first:b] if n <= 2 * WINDOW else theirs[second:b] + theirs[first : max(first, 2 * WINDOW - b + second + first)]
            if len(set(part)) < least_d * full and said(i, theirs[first:a]):
                repeats[i] = True
                continue
        after = min(bisect_left(begins, a + WINDOW), len(begins) - 1)
        n = begins[after] - a
        full = n if n < 2 * WINDOW else 2 * WINDOW
        if n >= 0.6 * WINDOW and full - repeated[after] + repeated[k] < least_d * full and len(set(theirs[a : a + full])) < least_d * full:
            repeats[i] = said(i, theirs[b : begins[after]])
    top_share, gram_share, copy_share, top = shares(theirs, [u for u, o in zip(bare, own) if not o], known, most_top, most_grams)
    if top_share > most_top:
        repeats = [r or not o and w.count(top) > most_top * len(w) for r, w, o in zip(repeats, words, own)]
    if gram_share > most_grams:
        # an n-gram may run over units, so each word is marked by the n-grams it stands in
        often, marked, at = Counter(grams(theirs)), bytearray(len(theirs)), 0
        for i, g in enumerate(grams(theirs)):
            if often[g] > 1:
                marked[i : i + GRAM] = b"\1" * GRAM
        for i, (w, o) in enumerate(zip(words, own)):
            if w and not o:
                repeats[i] = repeats[i] or sum(marked[at : at + len(w)]) * 2 > len(w)
                at += len(w)
    seen = Counter(bare)
    copies, before = [False] * len(units), set()
    if copy_share > most_copies:
        for i, (u, o) in enumerate(zip(bare, own)):
            copies[i] = u in before and not o
            before.add(u)
    total = sum(size)
    out["links"] = sum(compress(size, link)) / total
    out["lists"] = sum(compress(size, listed)) / total
    out["repeats"] = sum(compress(size, repeats)) / total
    if len(seen) < len(bare):
        out["duplicates"] = sum(n for u, n, o in zip(bare, size, own) if seen[u] > 1 and not o) / total
    out["spam"] = sum(compress(size, (a or b or c or d for a, b, c, d in zip(link, listed, repeats, copies)))) / total
    return out


def score_pages(df: DataFrame, limits: dict[str, tuple], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, links, lists, repeats, duplicates, spam) of each document with text; null and blank ones give no row. No shuffle."""
    kind = dict(df.dtypes)[id_col]
    names = ("links", "lists", "repeats", "duplicates", "spam")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measure(t, lang, limits) for t, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return pa.record_batch([batch.column(0), *(pa.array([x[n] for x in found], pa.float64()) for n in names)], names=["id", *names])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.trim("text") != "")
    return map_batches(rows, make, f"id {kind}, " + ", ".join(f"{n} double" for n in names)).withColumnRenamed("id", id_col)
