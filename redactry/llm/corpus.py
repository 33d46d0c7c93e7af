"""Corpus statistics that several text operators share; counted over every text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.sources.tables import checkpointed, spread

#: Distinct words a task holds before it hands on its partial counts.
HELD = 400_000
#: A word or n-gram is kept in a model if it makes up at least this share of all;
#: so a lexicon has at most 1 / SHARE entries however large the corpus is.
WORD_SHARE, GRAM_SHARE = 1e-6, 2e-6
#: Copies of one text beyond this share of all rows, and this many, count once; so at most 1 / COPIES texts are looked up.
COPIES, COPIES_LEAST = 1e-3, 20
EDGE = "\x02"
#: Trigrams whose log probability a worker keeps.
LOGS = 200_000
#: Longer strings between blanks (encoded data, keys) are no words and don't enter the character counts.
LONGEST = 60


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                counts.update(text.split())
        if len(counts) > HELD:
            yield _table(counts)
            counts = Counter()
    if counts:
        yield _table(counts)


def _table(counts: dict) -> pa.RecordBatch:
    return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["key", "n"])


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, n): words between white space and how often they occur; null and blank texts have none.

    Copies of a text that make up more than COPIES of all rows count as one, or what is
    misread or garbled on a page that is copied often would look like a frequent word.
    Counted per task before the shuffle, so a word in every text costs one row per task.
    The result is checkpointed, as its users read it more than once.
    """
    texts = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).where(F.length(text_col) > 0)
    hot = [r.h for r in texts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(COPIES_LEAST, COPIES * df.count())).collect()]
    once = texts.select("text")
    if hot:  # the first of each, taken in every task before the shuffle
        firsts = texts.where(F.col("h").isin(hot)).groupBy("h").agg(F.first("text").alias("text"))
        once = texts.where(~F.col("h").isin(hot)).select("text").unionByName(firsts.select("text"))
    partial = spread(once).mapInArrow(_counted, "key string, n bigint")
    return checkpointed(partial.groupBy("key").agg(F.sum("n").alias("n")))


def gram_counts(words: DataFrame, order: int = 3) -> DataFrame:
    """(key, n): character n-grams of the words, each word padded with an edge mark on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(word) > LONGEST:
                    continue
                w = EDGE * (order - 1) + word + EDGE
                for i in range(len(w) - order + 1):
                    counts[w[i : i + order]] += n
            if len(counts) > HELD:
                yield _table(counts)
                counts = Counter()
        if counts:
            yield _table(counts)

    return words.select("key", "n").mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, share: float, least: int = 1) -> dict[str, int]:
    """The entries that make up at least ``share`` of the total: at most 1 / share, whatever the input."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(share * total, least)).toPandas()
    return dict(zip(rows["key"], rows["n"].astype(int)))


class CharModel:
    """Character trigram model, interpolated with its lower orders (Dirichlet smoothing)."""

    def __init__(self, trigrams: dict[str, int], strength: float = 20.0):
        self.three, self.two, self.one = dict(trigrams), Counter(), Counter()
        self.ctx2, self.ctx1, self.k = Counter(), Counter(), strength
        for g, n in trigrams.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.ctx2[g[:2]] += n
            self.ctx1[g[1]] += n
        self.total = sum(self.one.values())
        self.logs: dict[str, float] = {}

    def word(self, word: str) -> float:
        """Log probability of the word with its end."""
        return self.behind(EDGE + EDGE + word + EDGE)

    def behind(self, text: str) -> float:
        """Log probability of a text behind its first two characters."""
        out, logs = 0.0, self.logs
        for i in range(len(text) - 2):
            g = text[i : i + 3]
            x = logs.get(g)
            out += self._log(g) if x is None else x
        return out

    def _log(self, g: str) -> float:
        """Log probability of a trigram's last character behind the others; kept, as trigrams repeat."""
        k = self.k
        p = (self.one.get(g[2], 0) + 0.01) / (self.total + 1000)
        p = (self.two.get(g[1:], 0) + k * p) / (self.ctx1.get(g[1], 0) + k)
        p = (self.three.get(g, 0) + k * p) / (self.ctx2.get(g[:2], 0) + k)
        if len(self.logs) >= LOGS:
            self.logs.clear()
        x = self.logs[g] = math.log(p)
        return x
