"""Problem 2: text that looks the same but differs in its characters."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactry.llm.arrow import Memo
from redactry.sources.tables import spread

#: Letters of other scripts that look like Latin ones, in the order of the Latin letters beside them.
CYRILLIC, AS_LATIN = "АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝ", "ABEKMHOPCTXYIJSaeopcyxijshdqw"
GREEK, GREEK_AS_LATIN = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο", "ABEZHIKMNOPTYXvo"
#: Characters that look exactly like a plain one but have no decomposition: hyphens, and eth for d with stroke.
EXACT = {"‐": "-", "‑": "-", "Ð": "Đ", "Ɖ": "Đ"}
#: Characters without width or ink.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: A joiner in an emoji or in a script that joins letters with it is no disguise; it is set aside under this private code.
JOINER = re.compile("(?<=[←-⯿\ufe0f\U0001f000-\U0001faff])\u200d(?=[←-⯿\U0001f000-\U0001faff])|(?<=[\u0590-\u08ff\u0900-\u0dffក-\u17ff])[\u200c\u200d]")
ASIDE = "\ue000"

LATIN_CLASS = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
CYRILLIC_ONLY = re.compile("[" + "".join(c for c in map(chr, range(0x400, 0x530)) if c not in CYRILLIC) + "]")
GREEK_ONLY = "[" + "".join(c for c in map(chr, range(0x370, 0x400)) if c not in GREEK) + "]"
GREEK_TEXT, GREEK_LETTER = re.compile(GREEK_ONLY + "[Ͱ-Ͽ]"), re.compile(GREEK_ONLY)
LATIN, LATIN_ONLY = re.compile(f"[{LATIN_CLASS}]"), re.compile("[bdfgklmnqrtuwzDFGLQRUVWÀ-ÖØ-öø-ɏḀ-ỿ]")
FOREIGN = re.compile(f"[{CYRILLIC}{GREEK}Ѐ-ԯ]")
ANY_CYRILLIC = re.compile(f"[{CYRILLIC}]")
MIXED = re.compile(f"[{LATIN_CLASS}][{CYRILLIC}{GREEK}]|[{CYRILLIC}{GREEK}][{LATIN_CLASS}]|[Ѐ-ԯ][A-Za-z]|[A-Za-z][Ѐ-ԯ]")
GREEK_ALONE = re.compile(rf"[{GREEK}]\d|\d[{GREEK}]|[{GREEK}]{{2}}|^[{GREEK[:14]}]\.\W*$")
UNSEEN = str.maketrans("", "", INVISIBLE)
TOKEN = re.compile("[^\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*+(?:[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|$)")


def plain(c: str) -> str | None:
    """What the character stands for, fully decomposed; None if it is its own plain form.

    Canonical decompositions, and those compatibility ones that keep the look:
    wide, narrow, font, no-break and letter ligatures. Ordinals, fractions,
    superscripts, the ellipsis and the like look different and stay.
    """
    if c in INVISIBLE:
        return ""
    if c in EXACT:
        return EXACT[c]
    if c != " " and unicodedata.category(c) == "Zs":
        return " "
    if "가" <= c <= "힣":
        return None
    tag = unicodedata.decomposition(c)
    if not tag:
        return None
    kind = tag.split(">")[0].lstrip("<") if tag[0] == "<" else ""
    if kind in ("wide", "narrow", "font", "noBreak") or kind == "compat" and unicodedata.category(c)[0] in "LN" and unicodedata.normalize("NFKD", c).isalpha():
        return unicodedata.normalize("NFKD", c)
    return unicodedata.normalize("NFD", c) if not kind else None


@cache
def tables() -> tuple[list, list]:
    """(c, parts, latin, cyrillic) of each mapped character and (nfd, nfc) of each composed one: bounded by Unicode."""
    latin = dict(zip(CYRILLIC + GREEK, AS_LATIN + GREEK_AS_LATIN))
    cyrillic = {a: c for c, a in zip(CYRILLIC, AS_LATIN)}
    mapped, composed = [], []
    special = {*INVISIBLE, *EXACT, *latin, *cyrillic}
    for n in range(sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF:
            continue
        c = chr(n)
        if not (unicodedata.decomposition(c) or unicodedata.combining(c) or c in special or unicodedata.category(c) == "Zs"):
            continue  # most code points: nothing below holds for them
        to = plain(c)
        if to is not None or unicodedata.combining(c) or c in latin or c in cyrillic:
            mapped.append((c, [(p, unicodedata.combining(p)) for p in (c if to is None else to)], latin.get(c), cyrillic.get(c)))
        nfd = unicodedata.normalize("NFD", c)
        if len(nfd) > 1 and unicodedata.normalize("NFC", nfd) == c and not "가" <= c <= "힣":
            composed.append((nfd, c))
    return mapped, composed


def frames(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    mapped, composed = tables()
    return (
        spark.createDataFrame(mapped, "c string, parts array<struct<p: string, ccc: int>>, latin string, cyrillic string"),
        spark.createDataFrame(composed, "nfd string, nfc string"),
    )


class Suspect:
    """Finds the characters that normalising may change: those not their own recomposed plain form, and marks.

    Two patterns, as a class within the Basic Multilingual Plane is one bitmap and a wider one a list of ranges.
    """

    def __init__(self):
        codes = sorted(ord(c) for c, parts, _, _ in tables()[0] if unicodedata.combining(c) or unicodedata.normalize("NFC", "".join(p for p, _ in parts)) != c)
        self.low, self.high = (self.pattern([n for n in codes if (n > 0xFFFF) == wide]) for wide in (False, True))
        self.wide = re.compile("[\U00010000-\U0010ffff]")
        self.either = self.pattern(sorted({n for n in codes if n <= 0xFFFF} | {ord(c) for c in GREEK} | set(range(0x400, 0x530))))

    def any(self, text: str) -> bool:
        """Whether a text holds a suspect character or one of a foreign script; one scan of it."""
        return self.either.search(text) is not None or self.wide.search(text) is not None

    @staticmethod
    def pattern(codes: list[int]) -> re.Pattern:
        ranges: list[list[int]] = []
        for n in codes:
            if ranges and n == ranges[-1][1] + 1:
                ranges[-1][1] = n
            else:
                ranges.append([n, n])
        return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")

    def search(self, text: str):
        return self.low.search(text) or (self.high.search(text) if self.wide.search(text) else None)


@cache
def suspect() -> Suspect:
    return Suspect()


def odd_tokens(text: str) -> Iterator[tuple[int, str, str | None]]:
    """(offset, token with the blank behind it, script to bring it to) of the tokens that may change."""
    odd = suspect()
    if text.isascii() or not odd.any(text):
        return
    if "\u200d" in text or "\u200c" in text:
        text = JOINER.sub(ASIDE, text)
    foreign = FOREIGN.search(text) is not None
    if not foreign and not odd.search(text):
        return
    cyrillic = foreign and CYRILLIC_ONLY.search(text) is not None
    greek = foreign and GREEK_TEXT.search(text) is not None
    verdicts = judged(foreign, cyrillic, greek)
    for m in TOKEN.finditer(text):
        t = m.group()
        if t.isascii():
            continue
        may_change, script = verdicts[t]
        if may_change:
            yield m.start(), t, script


@cache
def judged(foreign: bool, cyrillic: bool, greek: bool) -> Memo:
    """token -> (whether it may change, script to bring it to), for texts with a foreign letter, or with ones that are only Cyrillic or Greek."""
    odd = suspect()

    def judge(t: str) -> tuple[bool, str | None]:
        script = None
        if foreign and FOREIGN.search(t):
            only_c, only_g = CYRILLIC_ONLY.search(t), GREEK_LETTER.search(t)
            if MIXED.search(t.translate(UNSEEN)):
                script = "L" if not only_c and not only_g else "C" if only_c and not LATIN_ONLY.search(t) else None
            elif not LATIN.search(t) and (not cyrillic and not only_c and ANY_CYRILLIC.search(t) or not greek and not only_g and GREEK_ALONE.search(t)):
                script = "L"
        return bool(script or odd.search(t)), script

    return Memo(judge, 50_000)


def candidates(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, at, token, script): every token that may change, of every row. One pass; null and ASCII texts stay in the JVM."""
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, token, script = [], [], [], []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                for a, t, s in odd_tokens(text):
                    row.append(k)
                    at.append(a)
                    token.append(t)
                    script.append(s)
            index = pa.array(row, pa.int32())
            yield pa.record_batch([*(batch.column(j).take(index) for j in range(len(keys))), pa.array(at, pa.int32()), pa.array(token, pa.string()), pa.array(script, pa.string())], names=[*keys, "at", "token", "script"])

    rows = df.select(*keys, F.col(text_col).alias("text")).where(F.length("text") < F.octet_length("text"))
    return spread(rows).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", at int, token string, script string")


def normalise(df: DataFrame, keys: list[str], text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """(keys, plain) of the rows whose text changes; without ``rebuild`` only the keys.

    Candidate texts are cut into tokens, and only tokens with a suspect character or
    mixed scripts are exploded into positioned code points. These meet the
    decomposition and look-alike tables in a broadcast join, marks are ordered by
    class behind their starter, starters with marks are recomposed, and tokens and
    texts are put together again by position.

    A word that mixes Latin with look-alikes becomes Latin, or Cyrillic if only its
    Cyrillic letters are unmistakable; one made of look-alikes alone becomes Latin
    where its text has no unmistakable Cyrillic. A single Greek letter is a symbol.
    Null, empty and ASCII texts never change; repeated keys are repeated rows and
    must be made unique by the caller if they stand for different texts.
    """
    inner = [f"_key{k}" for k in range(len(keys))]  # so that a key may have any name
    out = _normalise(df.select(*(F.col(k).alias(n) for k, n in zip(keys, inner)), F.col(text_col).alias("text")), inner, rebuild)
    return out.toDF(*keys, *(["plain"] if rebuild else []))


def _normalise(df: DataFrame, keys: list[str], rebuild: bool) -> DataFrame:
    text_col = "text"
    mapped, composed = (F.broadcast(x) for x in frames(df.sparkSession))
    cps = candidates(df, keys, text_col).select(*keys, "at", "script", F.posexplode(F.split("token", "")).alias("i", "c"))
    cps = cps.join(mapped, "c", "left")
    one = lambda x: F.array(F.struct(x.alias("p"), F.lit(0).alias("ccc")))
    parts = F.when((F.col("script") == "L") & F.col("latin").isNotNull(), one(F.col("latin"))).when((F.col("script") == "C") & F.col("cyrillic").isNotNull(), one(F.col("cyrillic"))).otherwise(F.coalesce("parts", one(F.col("c"))))
    cps = cps.select(*keys, "at", "i", "c", F.posexplode_outer(parts).alias("k", "part"))
    cps = cps.select(*keys, "at", "i", F.coalesce("k", F.lit(0)).alias("k"), F.when(F.coalesce("k", F.lit(0)) == 0, F.col("c")).otherwise("").alias("c"), F.coalesce("part.p", F.lit("")).alias("p"), F.coalesce("part.ccc", F.lit(0)).alias("ccc"))
    # one shuffle by token; the window and both aggregates keep its partitioning
    cps = cps.repartition(*keys, "at")
    order = Window.partitionBy(*keys, "at").orderBy("i", "k")
    groups = cps.withColumn("g", F.sum(F.when((F.col("ccc") == 0) & (F.col("p") != ""), 1).otherwise(0)).over(order))
    text_of = lambda x, f: F.array_join(F.transform(F.sort_array(x), lambda e: e[f]), "")
    sequences = groups.groupBy(*keys, "at", "g").agg(text_of(F.collect_list(F.struct("ccc", "i", "k", "p")), "p").alias("nfd"), text_of(F.collect_list(F.struct("i", "k", "c")), "c").alias("old"))
    sequences = sequences.join(composed, "nfd", "left").withColumn("s", F.coalesce("nfc", "nfd"))
    made = sequences.groupBy(*keys, "at").agg(text_of(F.collect_list(F.struct("g", "s")), "s").alias("new"), text_of(F.collect_list(F.struct("g", "old")), "old").alias("token"))
    changed = made.where(F.col("new") != F.col("token"))
    if not rebuild:
        return changed.select(*keys).distinct()
    edits = changed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", F.length("token").alias("n"), "new"))).alias("edits"))
    texts = df.select(*keys, F.col(text_col).alias("text")).join(edits, keys)
    kinds = dict(df.dtypes)

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, todo in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()):
                parts, end = [], 0
                for e in todo:
                    parts += (text[end : e["at"]], e["new"].replace(ASIDE, "\u200d"))
                    end = e["at"] + e["n"]
                out.append("".join(parts) + text[end:])
            yield pa.record_batch([*(batch.column(j) for j in range(len(keys))), pa.array(out, pa.string())], names=[*keys, "plain"])

    return texts.mapInArrow(splice, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", plain string")
