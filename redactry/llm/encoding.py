"""Problem 1: text that was decoded with the wrong character encoding."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.llm import corpus, lookalike
from redactry.llm.arrow import Memo, map_batches
from redactry.sources.tables import checkpointed, discard

#: The single-byte code pages a text may have been read in, and may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "cp1250", "cp1258")
#: Log-likelihood a restored word must gain. Validation on all clean words of the texts may lower it, not below the second figure.
MARGIN, LEAST_MARGIN = 7.0, 4.0
#: Of the clean words of the validation, the share that may gain more than the margin.
FALSE = 1e-3
#: Times a restored word must be more frequent in the corpus than the word as it stands.
RATIO = 5
PUNCTUATION = " .,;:!?()[]{}\"'“”‘’«»„…–—-*•"
ASCII_PUNCTUATION = PUNCTUATION.encode("ascii", "ignore")
LOST = "\N{REPLACEMENT CHARACTER}"
#: UTF-8 has no lone byte beyond ASCII, so a word with a lone character beyond it is none read as a page.
LONE = re.compile(r"(?<![^\x00-\x7f])[^\x00-\x7f](?![^\x00-\x7f])")
#: Characters beyond ASCII, with single ones of it between them.
BEYOND = re.compile(r"[^\x00-\x7f]+(?:[\x00-\x7f][^\x00-\x7f]+)*")
#: Starts only behind white space and never backtracks, so a long ASCII token is passed over once.
WORD = re.compile(r"(?<![^ \t\n\r\f\v])[^\x80-\U0010ffff \t\n\r\f\v]*+[^\x00-\x7f][^ \t\n\r\f\v]*+")


@cache
def table(page: str) -> dict[int, int]:
    """Code point -> byte of a code page; bytes it leaves undefined stand for the control of that number, as browsers read them."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(page)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(ord(c), b)
    return out


@cache
def reading(page: str) -> list[str]:
    back = {b: chr(c) for c, b in table(page).items()}
    return [back.get(b, chr(b)) for b in range(256)]


def to_bytes(word: str, page: str) -> bytes | None:
    try:
        return bytes(map(table(page).__getitem__, map(ord, word)))
    except KeyError:
        return None


def unpacked(word: str, depth: int = 3) -> dict[str, str]:
    """text -> chain, for UTF-8 that was read as a single-byte page, nested up to ``depth`` deep."""
    out: dict[str, str] = {word: ""}
    front = [word]
    for _ in range(depth):
        step = []
        for w in front:
            if w.isascii() or LONE.search(w):
                continue
            for page in READ_AS:
                raw = to_bytes(w, page)
                if raw is None:
                    continue
                try:
                    got = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if got not in out:
                    out[got] = f"{out[w]} {page}>utf-8".strip()
                    step.append(got)
        front = step
    del out[word]
    return out


#: Chains of one step, which a run of words may share without any word that is known.
DIRECT = frozenset(f"{a}>{b}" for a in READ_AS for b in READ_AS)


@cache
def rereadings() -> list[tuple[frozenset, list[tuple[str, dict[int, str], frozenset]]]]:
    """Of each page its characters, and of each other page the chain, what they stand for in it, and those that stand for
    what no word holds."""
    out = []
    for page in READ_AS:
        turns = [(f"{page}>{true}", {c: reading(true)[b] for c, b in table(page).items() if c > 127}) for true in READ_AS if page != true]
        out.append((frozenset(map(chr, table(page))), [(chain, to, frozenset(chr(c) for c, x in to.items() if not x.isalpha() and x not in PUNCTUATION + "-'’")) for chain, to in turns]))
    return out


@cache
def look_alikes() -> dict[int, str]:
    """Letters of other scripts, and the Icelandic capital taken for the Vietnamese one, as what they look like."""
    return str.maketrans(lookalike.CYRILLIC + lookalike.GREEK + "Ðð", lookalike.AS_LATIN + lookalike.GREEK_AS_LATIN + "Đđ")


@cache
def crossings() -> list[tuple[str, bytes]]:
    """(chain, byte -> byte) of every two pages: what a byte read in the first is in the second; 255, never valid UTF-8, if nothing."""
    return [(f"{a}>{b}", bytes(table(b).get(ord(c), 255) for c in reading(a))) for a in READ_AS for b in READ_AS if a != b]


def crossed(word: str) -> dict[str, str]:
    """text -> chain, for UTF-8 read in one page, written in another and read in a third."""
    out: dict[str, str] = {}
    if LONE.search(word):
        return out
    for page in READ_AS:
        raw = to_bytes(word, page)
        if raw is None:
            continue
        for chain, to in crossings():
            try:
                got = raw.translate(to).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if got != word and got.isprintable():
                out.setdefault(got, f"{page}>{chain}>utf-8")
    return out


@cache
def has_plain_form(c: str) -> bool:
    """Blanks, marks, controls and compatibility characters: the normaliser's, not this operator's. C1 controls only come
    from a wrong decoding."""
    if "\x80" <= c <= "\x9f":
        return False
    return c in PUNCTUATION or c in "†‡°" or unicodedata.category(c)[0] in "ZCM" or unicodedata.normalize("NFKC", c) != c


def transcoded(word: str) -> dict[str, str]:
    """text -> chain, for one single-byte page that was read as another; only texts spelled like words."""
    out: dict[str, str] = {}
    # ASCII stays what it is, so a word with a digit or a sign inside its ASCII is spelled like none in any page
    inner = word.encode("ascii", "ignore").strip(ASCII_PUNCTUATION).translate(None, b"-'")
    if inner and not inner.isalpha():
        return out
    chars = set(word)
    if all(c.isascii() or has_plain_form(c) for c in chars):
        return out
    for page, turns in rereadings():
        for chain, to, never in turns if chars <= page else ():
            if not chars.isdisjoint(never):
                continue
            got = word.translate(to)
            if got != word and got not in out:
                inner = got.strip(PUNCTUATION).replace("-", "").replace("'", "").replace("’", "")
                if inner.isalpha() and (inner.islower() or inner.istitle() or inner.isupper()):
                    out[got] = chain
    return out


def core(word: str) -> str:
    return word.strip(PUNCTUATION).lower()


class Restorer:
    """word -> (gain, chain, text, alone); memoised, as words repeat.

    ``alone`` says that the word suffices to call its text garbled: its gain exceeds
    the margin and, for a page read as another page, where every byte string is
    valid, the restored word is one the corpus knows far better.
    """

    def __init__(self, model: corpus.CharModel, lexicon: dict[str, int], margin: float = MARGIN):
        self.model, self.lexicon, self.margin = model, lexicon, margin
        self.memo = Memo(self.best)
        self.flags = Memo(self._flag)
        self.by_length: dict[int, list[str]] | None = None

    def best(self, word: str) -> tuple[float, str, str, bool]:
        """Every chain is scored: UTF-8 read as a page up to three deep, a page read as another, and both in either order."""
        known, size = self.lexicon.get(core(word), 0), self.model.word
        deep = unpacked(word)
        paged = dict(transcoded(word))
        for t, c in deep.items():
            for t2, c2 in transcoded(t).items():
                paged.setdefault(t2, f"{c} {c2}")
        crossing = not deep and not known and not word.isascii() and crossed(word)
        if not deep and not paged and not crossing:
            return 0.0, "", word, False
        own = self.model.word(word)
        score, text, chain, alone = own, word, "", False
        for t, c in deep.items():
            if (s := size(t)) > score:
                score, text, chain, alone = s, t, c, s - own > self.margin
        if not chain and not known and not word.isascii():
            paged = (crossed(word) if deep else crossing) | paged
        alike = core(word.translate(look_alikes()))
        for t, c in paged.items():
            # in a single-byte page every byte string is valid, so the corpus must know the word far better; and a letter
            # that only looks like another was typed, not garbled
            times = self.lexicon.get(core(t), 0)
            if known and not times:
                continue  # a word of the corpus does not stand for one it does not know
            often = self.knows_better(t, word, alike, known)
            if (often or not chain and c in DIRECT) and (s := size(t)) > score:
                score, text, chain, alone = s, t, c, often and s - own > self.margin
        return score - own if chain else 0.0, chain, text, alone

    def knows_better(self, text: str, word: str, alike: str, known: int) -> bool:
        """Whether the corpus knows a reading far better than the word, which it knows ``known`` times and which looks like ``alike``."""
        low = core(text)
        return len(low) > 2 and self.lexicon.get(low, 0) > RATIO * known and low != alike and (alike == core(word) or not self.lexicon.get(alike))

    def refilled(self, word: str, begins: bool) -> str:
        """A word with lost letters, filled in if the corpus knows one word that fits far better than any other; else as it is.

        ``begins`` says that the word begins a sentence, where a lost first letter is a capital.
        """
        low = core(word)
        if LOST not in low or len(low) < 3 or all(c == LOST for c in low):
            return word
        if self.by_length is None:
            self.by_length = {}
            for w in self.lexicon:
                self.by_length.setdefault(len(w), []).append(w)
        form = re.compile("".join("[^\\x00-\\x7f]" if c == LOST else re.escape(c) for c in low))
        fits = sorted((w for w in self.by_length.get(len(low), ()) if form.fullmatch(w)), key=self.lexicon.get, reverse=True)
        if not fits or len(fits) > 1 and self.lexicon[fits[0]] < RATIO * 4 * self.lexicon[fits[1]]:
            return word
        at = word.lower().index(low)
        inner, best = word[at : at + len(low)], fits[0]
        loud = inner.replace(LOST, "").isupper() and len(inner) > 2
        letters = (b.upper() if loud or k == 0 and begins else b if a == LOST else a for k, (a, b) in enumerate(zip(inner, best)))
        return word[:at] + "".join(x if a == LOST else a for a, x in zip(inner, letters)) + word[at + len(low) :]

    def may_be_garbled(self, text: str, tokens: list[str]) -> bool:
        """Whether :meth:`restore` needs to look at a text that was already cut at blanks and line feeds."""
        return not text.isascii() and (any(map(self.flags.__getitem__, tokens)) or LOST in text)

    def _flag(self, token: str) -> bool:
        return not token.isascii() and (bool(self.memo[token][1]) or "\t" in token or "\r" in token)

    def restore(self, text: str) -> tuple[bool, str, str]:
        """(garbled, chains, restored). Beside a word that is garbled on its own, words of the same kind of chain
        follow with any gain; a run of three that gain twice the margin together also counts.
        U+FFFD marks a text as garbled; what it stands for is filled in where the corpus leaves no doubt."""
        if text.isascii():
            return False, "", text
        memo, found = self.memo, []
        if LOST not in text and not any(memo[w][1] for w in WORD.findall(text)):
            return False, "", text
        for m in WORD.finditer(text):
            got = memo[m.group()]
            if got[1]:
                found.append((m.start(), m.end(), *got))
        chains = {f[3] for f in found if f[5]}
        keep, i = [], 0
        while i < len(found):
            j = i + 1
            while j < len(found) and found[j][3] == found[i][3] and found[j][0] - found[j - 1][1] <= 2:
                j += 1
            run = found[i:j]
            if run[0][3] in chains:
                keep.extend(f for f in run if f[2] > 0.5)
            elif j - i > 2 and sum(f[2] for f in run) > 2 * self.margin and sum(core(f[4]) in self.lexicon for f in run) * 2 > len(run):
                keep.extend(run)
            i = j
        lost = LOST in text
        if lost:
            taken = {f[0] for f in keep}
            for m in WORD.finditer(text):
                if LOST in m.group() and m.start() not in taken:
                    before = text[: m.start()].rstrip()
                    new = self.refilled(m.group(), not before or before[-1] in ".!?:")
                    if new != m.group():
                        keep.append((m.start(), m.end(), 0.0, LOST, new, False))
            keep.sort()
        if not keep:
            return lost, LOST if lost else "", text
        out, at = [], 0
        for a, b, _, _, new, _ in keep:
            out += (text[at:a], new)
            at = b
        return True, ", ".join(dict.fromkeys(f[3] for f in keep)), "".join(out) + text[at:]


def train(words: DataFrame) -> tuple[corpus.CharModel, dict[str, int], float]:
    """(model, lexicon, margin) of the clean words in :func:`corpus.word_counts`.

    Words that a UTF-8 chain changes, or that hold controls or U+FFFD, are left
    out. The margin is validated on words garbled here, which must pass it, and on the words as they are, which must not.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([clean(w) for w in batch.column(0).to_pylist()]))

        return step

    good = map_batches(words.select("key", "n"), make, "key string, n bigint")
    grams = checkpointed(corpus.gram_counts(good))
    model = corpus.CharModel(corpus.frequent(grams, corpus.GRAM_SHARE))
    lexicon: dict[str, int] = {}
    for w, n in corpus.frequent(words, corpus.WORD_SHARE, 2).items():
        if clean(w):
            lexicon[core(w)] = lexicon.get(core(w), 0) + n
    return model, lexicon, validated(words, model, lexicon)


def losses(model: corpus.CharModel, word: str) -> list[float]:
    """Log likelihood that a word loses as UTF-8 read in each page. ASCII stays what it is, so only characters beyond it and the two behind are weighed."""
    text = corpus.EDGE * 2 + word + corpus.EDGE
    parts = [text[m.start() - 2 : m.end() + 2] for m in BEYOND.finditer(text)]
    own = sum(map(model.behind, parts))
    return [own - sum(model.behind("".join(map(reading(page).__getitem__, part.encode()))) for part in parts) for page in READ_AS]


def validated(words: DataFrame, model: corpus.CharModel, lexicon: dict[str, int]) -> float:
    """The margin that 99 of 100 words garbled in every page pass, and of the words as they are hardly any; of every clean
    word beyond ASCII in :func:`corpus.word_counts`, however rare, in tasks.

    A word that may be garbled itself, as another page gives a far more frequent word, is no measure, nor is, of words not
    in the lexicon, one that any chain turns into such a word. A reading that the corpus doesn't know is never taken.
    """
    sc = words.sparkSession.sparkContext
    shared = sc.broadcast((model, lexicon))

    def cores():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = [(core(w), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if clean(w)]
            return pa.record_batch([pa.array([w for w, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], names=["word", "n"])

        return step

    def make():
        model, lexicon = shared.value
        r, longest = Restorer(model, lexicon), max(map(len, lexicon), default=0)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            low, high, n = [], [], 0
            for w, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                alike = core(w.translate(look_alikes()))
                taken = [t for t in crossed(w) if r.knows_better(t, w, alike, 0)]
                # a page read as another leaves the length as it is, so of a longer word nothing is in the lexicon
                if len(w) <= longest and any(lexicon.get(t, 0) > RATIO * times for t in transcoded(w)):
                    continue
                if w not in lexicon and any(lexicon[core(t)] > RATIO * times for t in taken):
                    continue
                n += 1
                # gains on the near side of the limits can't move the margin, so they are only counted
                low += (max(x, LEAST_MARGIN) for x in losses(model, w) if x < MARGIN)
                own = model.word(w) if taken else 0.0
                high += (x for x in [max((model.word(t) - own for t in taken), default=0.0)] if x > LEAST_MARGIN)
            garbled = [True] * len(low) + [False] * len(high) + [None]
            return pa.record_batch([pa.array(garbled, pa.bool_()), pa.array([*low, *high, None], pa.float64()), pa.array([0] * (len(garbled) - 1) + [n], pa.int64())], names=["garbled", "gain", "n"])

        return step

    beyond = map_batches(words.select("key", "n").where(F.length("key") < F.octet_length("key")), cores, "word string, n bigint")
    tasks = 4 * sc.defaultParallelism  # given, as by bytes these words would go into one
    whole = beyond.where(F.length("word") < F.octet_length("word")).repartition(tasks, "word").groupBy("word").agg(F.sum("n").alias("n"))
    gains = checkpointed(map_batches(whole, make, "garbled boolean, gain double, n bigint"))
    n = gains.agg(F.sum("n")).first()[0] or 0
    low = ranked(gains.where("garbled"), n * len(READ_AS) // 100)
    margin = MARGIN if low is None else low
    high = ranked(gains.where(~F.col("garbled") & (F.col("gain") > margin)).select((-F.col("gain")).alias("gain")), int(FALSE * n))
    discard(gains)
    return margin if high is None else -high


def ranked(gains: DataFrame, k: int) -> float | None:
    """The k-th least gain, from 0, or None if there are not as many; counted in steps of an eighth, so that only one step's are sorted."""
    step = F.floor(F.col("gain") * 8)
    for r in gains.groupBy(step.alias("at")).agg(F.count("*").alias("n"), F.min("gain").alias("least"), F.max("gain").alias("most")).orderBy("at").collect():
        if k < r.n:
            return r.least if r.least == r.most else gains.where(step == r["at"]).orderBy("gain").offset(k).first().gain
        k -= r.n
    return None


def clean(word: str) -> bool:
    if word.isascii():
        return True
    if LOST in word or re.search("[\x80-\x9f]", word):
        return False
    for page in READ_AS:
        raw = to_bytes(word, page)
        if raw is not None:
            try:
                raw.decode("utf-8")
                return False
            except UnicodeDecodeError:
                pass
    return True


def restore_texts(df: DataFrame, trained, id_col: str = "scan_id", text_col: str = "text") -> DataFrame:
    """(id, chains, restored) of the garbled rows only; ``restored`` keeps U+FFFD where letters are lost.

    Null, empty and pure ASCII texts are never garbled and do not leave the JVM.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(trained)

    def make():
        r = Restorer(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, chains, texts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bad, chain, new = r.restore(t)
                if bad:
                    ids.append(i)
                    chains.append(chain)
                    texts.append(new)
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(chains, pa.string()), pa.array(texts, pa.string())], names=["id", "chains", "restored"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") < F.octet_length("text"))
    return map_batches(rows, make, f"id {kind}, chains string, restored string").withColumnRenamed("id", id_col)
