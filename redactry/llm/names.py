"""Problem 3: variant spellings of the names of persons and organisations."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactry.llm.arrow import Memo, map_batches
from redactry.llm.encoding import unpacked
from redactry.llm.lookalike import AS_LATIN, CYRILLIC, GREEK, GREEK_AS_LATIN, INVISIBLE
from redactry.sources.tables import checkpointed, discard

#: Given names and their customary short forms.
NICKNAMES = """
agatha aggie|alexander alex sasha sandy al xander|andrew andy drew|anthony tony|beatrice bea trixie bee|benjamin ben benny benji
catherine cathy kate katie kitty cat|charles charlie chuck|christopher chris kit|clifford cliff|daniel dan danny|deborah deb debbie debby
dominic dom nick|edward ed eddie ted teddy ned|elizabeth liz lizzie beth betty eliza bess lisa|florence flo florrie flossie|frederick fred freddie freddy fritz rick
gertrude gertie trudy trude|gregory greg|harold harry hal|henrietta etta hettie hetty henny|ignatius iggy nate|isabella bella izzy isa belle
jacqueline jackie jacqui|james jim jimmy jamie|jennifer jen jenny|john jack johnny|joseph joe joey jo|katharina kathi katja kati katrin|kenneth ken kenny
lawrence larry laurie lorry|ludmila mila lida luda|margaret maggie meg peggy greta marge madge|maximilian max maxim|michael mike mick mikey
natascha tascha nata|nathaniel nat nate nathan|nicholas nick nicky|oliver ollie olly noll|ottilie tilly otti tilda|patricia pat patty trish tricia patsy
peter pete|philippe phil pip|rebecca becky becca|richard rick dick rich richie ricky|robert rob bob bobby bert|samuel sam sammy|stephen steve
susanna sue susie susan suzy sanna|theodore theo ted teddy|thomas tom tommy|thomasina tamsin tommie tamzin tomasina|valentin val|victoria vicky tori vic vicki
william will bill billy liam willy|winifred winnie freda win fred|zachary zack zach zak|zuzanna zuza zuzia suzanna
"""
#: Common Vietnamese family names, without marks.
FAMILY = frozenset("nguyen tran le pham hoang huynh phan vu vo dang bui do ho ngo duong ly luong dinh trinh doan mai dao cao ha lam truong ta quach".split())
#: Legal forms and their words, without marks or stops.
FORMS = frozenset("ltd limited inc incorporated llc corp corporation gmbh sa jsc plc ag kg sarl sas bv nv oy co company the ctcp cty cong ty cp tnhh phan joint stock societe anonyme gesellschaft mit beschrankter haftung mbh l c s a".split())
MARKERS = re.compile(r"\b(?:ltd|limited|inc|incorporated|l ?l ?c|corp|corporation|gmbh|jsc|plc|company|ctcp|cty|cong ty|societe anonyme|gesellschaft|mbh|joint stock)\b|\bs ?a$|^the ")
INNER = re.compile("[a-zß-ÿ\u0100-\u1eff][A-ZÀ-Þ\u0100-\u1eff]")
ODD = re.compile(r"[\d@!|†$]")
FUSED = re.compile(r"^[A-Z][a-z]{2,}(?:van|von|de) [A-Z]")
PARTICLES = frozenset("de van von der den da di du la le del".split())
#: What recognition makes of letters; both sides are folded to the right-hand form.
FOLDS = (("vv", "w"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("ii", "u"), ("c", "e"))
SIGN = str.maketrans("@!|†$0513946", "ailtsoslegab")
#: Words of fewer letters also give features with the words beside them, as they have few n-grams (of GRAM characters).
SHORT, GRAM = 6, 3
#: Features rarer than this share of all names weigh alike, so the table of weights is bounded by the n-grams of a name / RARE.
RARE = 1e-3
#: A shared class of given names counts as so many n-grams.
CLASS = 3
#: Cosine below which no pair is linked, and the average link at which clusters stop merging.
COSINE, LINK = 0.25, 0.12
#: A word this frequent among all names is no misspelling of another such word; at most 1 / share words.
COMMON = 1e-4
#: Names of one group that share a feature are compared in blocks of about this many, and rows of one cluster paired so;
#: groups below the share are not looked up, so that at most 1 / share are known to every task.
BLOCK, HOT = 2000, 1e-3
#: Names of the groups that a task links, on average, and shared features of two names that it sums at once.
TASK_NAMES, AT_ONCE = 20_000, 500_000


@cache
def short_forms() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for group in re.split(r"[|\n]", NICKNAMES):
        name, *short = group.split() or [""]
        for s in (name, *short):
            out.setdefault(s, set()).add(name)
    return {k: frozenset(v) for k, v in out.items()}


@cache
def latin_map() -> dict[int, str]:
    return str.maketrans(CYRILLIC + GREEK, AS_LATIN + GREEK_AS_LATIN) | dict.fromkeys(map(ord, INVISIBLE), "")


def bare(text: str) -> str:
    """Lower case without marks."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFD", text.lower().replace("đ", "d")) if not unicodedata.combining(c)).replace("ø", "o").replace("ł", "l").replace("ß", "ss")


def marks(word: str) -> str:
    """The word's marks wherever they stand, so that thuỷ and thủy agree."""
    if word.isascii():
        return ""
    w = word.lower()
    return "".join(sorted(c for c in unicodedata.normalize("NFD", w) if unicodedata.combining(c))) + "-" * w.count("đ")


def from_telex(word: str) -> str:
    """A Vietnamese syllable typed in Telex or VNI keys, without its marks."""
    w = re.sub(r"(?<=\D)\d", "", word)
    w = re.sub(r"([aeod])\1", r"\1", w)
    w = re.sub(r"(?<=[uoa])w", "", w)
    if re.search("[aeiouy]", w):
        w = re.sub(r"(?<=[aeiouy])([mnptc]?[hgc]?)[sfrxj]$", r"\1", w)
        w = re.sub(r"(?<=[aeiouy])[sfrxj](?=[aeiouymnptc])", "", w)
    return w


def parse(text: str) -> tuple[str, list[str], list[str]]:
    """(kind, words without marks, marks of each word); kind is 'org', 'vi' or ''.

    Undoes garbling, look-alikes, line breaks and fused words first, then drops
    legal forms. Null is handled by the caller; a text without letters has no words.
    """
    if not text.isascii():
        fixed = unpacked(text)
        if fixed:
            text = min(fixed, key=lambda t: (sum(not (c.isalnum() or c in " .,'-&\n") for c in t), len(t)))
        text = unicodedata.normalize("NFKC", text.translate(dict.fromkeys(map(ord, INVISIBLE), "")))
        if re.search("[A-Za-z]", text):
            text = text.translate(latin_map())
    if "\n" in text:
        text = re.sub(r"[-¬]\n", "", text)
    if ODD.search(text):
        text = re.sub(r"(?<=[^\W\d_])[@!|†$](?=[^\W\d_]|$)|(?<=[^\W\d_]{2})\d(?=[^\W\d_])|\d(?=[^\W\d_]{3})", lambda m: m.group().translate(SIGN), text)
    text = re.sub(r"['’`´]", "", text)
    comma = re.fullmatch(r"\s*([^,]+),\s*([^,]+?)\s*", text)
    plain = " ".join(re.findall(r"[^\W_]+", bare(text)))
    org = MARKERS.search(plain) is not None
    if comma and not org:
        text = f"{comma[2]} {comma[1]}"
    if not org:
        if INNER.search(text):
            text = "".join(f" {b}" if a.islower() and b.isupper() else b for a, b in zip(" " + text, text))
        text = re.sub(r"(?<=\w{4})(van|von|de)(?= [A-Z])", r" \1", text) if FUSED.search(text) else text
    words = re.findall(r"[^\W_]+", text)
    if org:
        words = [w for w in words if bare(w) not in FORMS]
    names = [bare(w) for w in words]
    if org:
        return "org", names, [marks(w) for w in words]
    if not 2 <= len(names) <= 5 or any(len(n) > 10 for n in names):
        return "", names, [marks(w) for w in words]
    telex = [from_telex(w) for w in names]
    if 2 <= len(names) <= 5 and any(t in FAMILY for t in (telex[0], telex[-1], names[0], names[-1], *telex[1:2])) and all(len(t) <= 7 for t in names):
        if not any(n in FAMILY for n in names) or any(t != n and not re.search("[aeiouy][mnptc]?[hg]?$", n) for t, n in zip(telex, names)):
            return "vi", telex, [""] * len(telex)
        return "vi", names, [marks(w) for w in words]
    return "", names, [marks(w) for w in words]


def word_features(word: str, kind: str) -> list[str]:
    """Character n-grams of a word with its ends, and the given names it may stand for."""
    p = f"#{word}#"
    return [p[i : i + GRAM] for i in range(len(p) - GRAM + 1)] + (["@" + c for c in given(word)] if kind != "org" else [])


class Vectors:
    """name -> {feature: squared weight}, its n-gram vector.

    Features are n-grams and classes of the words, pairs of short words (an n-gram
    with a gap) and an initial with a short word. A feature weighs the square of its
    rarity among all names; what ``counts`` lacks is rarer than RARE. How often two
    words stand together is estimated from how often each does.
    """

    def __init__(self, counts: dict[str, int], total: int):
        self.counts, self.least, self.total = counts, max(2.0, RARE * total), max(1, total)
        self.of_word = Memo(lambda key: {f: self.weight(f) * (CLASS if f[0] == "@" else 1) for f in word_features(*key)})
        self.memo = Memo(lambda name: self.vector(*unpacked_name(name)[:2]), 20_000, 256)

    def count(self, feature: str) -> float:
        return max(self.counts.get(feature, 0), self.least)

    def most(self, feature: str) -> float:
        """A bound on the names that hold the feature."""
        a, bar, b = feature.partition("|") if "|" in feature else feature.partition("~")
        return max(self.least, min(self.count("=" + x) for x in (a, b) if len(x) > 1)) if bar else self.count(feature)

    def weight(self, feature: str, count: float | None = None) -> float:
        return math.log(1 + self.total / (count or self.count(feature))) ** 2

    def vector(self, kind: str, words: list[str]) -> dict[str, float]:
        # a particle inside a name says nothing, one at its end may be a family name
        ws = [w for k, w in enumerate(words) if w not in PARTICLES or k in (0, len(words) - 1)]
        out: dict[str, float] = {}
        for w in ws:
            if len(w) > 1:
                out |= self.of_word[w, kind]
        for i, a in enumerate(ws):
            for b in ws[i + 1 :]:
                x, y = (a, b) if a < b else (b, a)
                if 1 < len(x) < SHORT and 1 < len(y) < SHORT:
                    out[f"{x}|{y}"] = self.weight("", max(self.count("=" + x) * self.count("=" + y) / self.total, self.least))
                if kind != "org":
                    for x, y in ((a, b), (b, a)):
                        if 1 < len(y) < SHORT:
                            out[f"{x[0]}~{y}"] = self.weight("", max(self.count("=" + y) / 16, self.least))
        return out or {"=" + " ".join(sorted(words)): self.weight("", self.least)}

    def cosine(self, a: str, b: str) -> float:
        x, y = self.memo[a], self.memo[b]
        if len(y) < len(x):
            x, y = y, x
        both = sum(w for f, w in x.items() if f in y)
        return both / math.sqrt(sum(x.values()) * sum(y.values())) if both else 0.0

    def prefix(self, name: str) -> list[str]:
        """The rarest features, up to where what is left has a norm below COSINE: a pair beyond it shares one of them."""
        v = self.memo[name]
        left, out = sum(v.values()), []
        least = COSINE**2 * left
        for f in sorted(v, key=lambda f: (-v[f] / (CLASS if f[0] == "@" else 1), f)):
            if left < least:
                break
            out.append(f)
            left -= v[f]
        return out


def cosines(names: list[str], groups: np.ndarray, vectors: Vectors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places i < j, cosines) of all pairs of a group that share a feature, some names' pairs at a time."""
    found, n = [vectors.memo[x] for x in names], len(names)
    code: dict[str, int] = {}
    rows = np.repeat(np.arange(n), np.fromiter(map(len, found), np.int64, n))
    weight = np.fromiter((w for v in found for w in v.values()), np.float64, len(rows))
    key = np.fromiter((code.setdefault(f, len(code)) for v in found for f in v), np.int64, len(rows))
    key += groups[rows] * len(code)
    norm = np.bincount(rows, weight, n)
    order = np.argsort(key, kind="stable")
    key, rows, weight = key[order], rows[order], weight[order]
    behind = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
    part = (np.cumsum(np.bincount(rows, behind, n)).astype(np.int64) // AT_ONCE)[rows]
    for p in np.unique(part[behind > 0]):
        at = np.flatnonzero((part == p) & (behind > 0))
        times = behind[at]
        left = np.repeat(at, times)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        pair, back = np.unique(rows[left] * n + rows[right], return_inverse=True)
        i, j = pair // n, pair % n
        yield i, j, np.bincount(back, weight[left]) / np.sqrt(norm[i] * norm[j])


def near(a: str, b: str, most: int) -> bool:
    """At most so many edits apart; two neighbours swapped count once."""
    if abs(len(a) - len(b)) > most:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= 1 or len(a) == 2 and a == b[::-1]:
        return True
    if most < 2:
        return False
    before, row = None, list(range(len(b) + 1))
    for x, ca in enumerate(a, 1):
        new = [x]
        for y, cb in enumerate(b, 1):
            v = min(row[y] + 1, new[-1] + 1, row[y - 1] + (ca != cb))
            if before is not None and y > 1 and ca == b[y - 2] and a[x - 2] == cb:
                v = min(v, before[y - 2] + 1)
            new.append(v)
        before, row = row, new
    return row[-1] <= most


def fold(word: str) -> str:
    return reduce(lambda w, f: w.replace(*f), FOLDS, word)


@cache
def given(word: str) -> frozenset[str]:
    """The given names a word may stand for, itself perhaps misspelled."""
    known = short_forms()
    if word in known or len(word) < 4:
        return known.get(word, frozenset())
    return frozenset().union(*(known[k] for k in known if len(k) > 3 and near(word, k, 1)))


def shortened(short: str, full: str) -> bool:
    """'labs' of laboratories, 'ins' of insurance, 'intl' of international."""
    if len(short) < 2 or len(full) < len(short) + 2 or short[0] != full[0]:
        return False
    if full.startswith(short.rstrip("s")) and len(short) > 2:
        return True
    it = iter(full)
    return len(full) >= 8 and 3 <= len(short) <= 5 and all(c in it for c in short)


def agree(a: tuple[str, list[str], list[str]], b: tuple[str, list[str], list[str]], common: frozenset[str] | set[str]) -> float:
    """How well two parsed names fit one bearer, 0 if they don't: an exact check behind the cosine join."""
    (ka, wa, ma), (kb, wb, mb) = a, b
    if (ka == "org") != (kb == "org") and "vi" in (ka, kb):
        return 0.0
    org = "org" in (ka, kb)
    left_a, left_b = list(range(len(wa))), list(range(len(wb)))
    marked = any(ma) and any(mb)
    total = strong = 0.0

    def pair(i: int, j: int, worth: float, sure: float) -> None:
        nonlocal total, strong
        left_a.remove(i)
        left_b.remove(j)
        total += worth
        strong += sure

    for i in list(left_a):
        for j in left_b:
            if wa[i] == wb[j] and (not marked or not ma[i] or not mb[j] or ma[i] == mb[j]):
                pair(i, j, 1.0, len(wa[i]) > 1)
                break
    nick = short_forms()
    for level in range(4):
        for i in list(left_a):
            for j in list(left_b):
                x, y = wa[i], wb[j]
                if level == 0:
                    fit = len(x) > 2 and len(y) > 2 and not org and (x in nick or y in nick) and bool(given(x) & given(y))
                elif level == 1:
                    size = min(len(x), len(y))
                    both = x in common and y in common
                    fit = x != y and not both and (size >= 3 and near(x, y, 2 if size >= 7 else 1) and (size > 3 or x[0] == y[0]) or size >= 4 and fold(x) == fold(y))
                elif level == 2:
                    fit = org and (shortened(x, y) or shortened(y, x))
                else:
                    fit = not org and min(len(x), len(y)) == 1 and x[0] == y[0]
                if fit:
                    pair(i, j, (0.95, 0.85, 0.9, 0.8)[level], (1, 1, 1, 0)[level])
                    break
    rest_a = [i for i in left_a if wa[i] not in PARTICLES]
    rest_b = [j for j in left_b if wb[j] not in PARTICLES]
    if strong < 1 or total < 1.5 and not (len(wa) == len(wb) == 1):
        return 0.0
    if rest_a and rest_b:
        joined = "".join(wa[i] for i in rest_a), "".join(wb[j] for j in rest_b)
        if max(len(rest_a), len(rest_b)) > 2 or min(map(len, joined)) < 6 or joined[0] != joined[1]:
            return 0.0
    elif rest_a or rest_b:
        rest, words, n = (rest_a, wa, len(wb)) if rest_a else (rest_b, wb, len(wa))
        if org:
            return 0.0
        if any(len(words[i]) > 1 for i in rest):
            if not ("vi" in (ka, kb) and len(rest) == 1 and n >= 2 and len(words) == 3 and strong >= 2):
                return 0.0
    return total / max(len(wa) - len(left_a) + len(rest_a) * 0.5, 1)


def packed(name: tuple[str, list[str], list[str]]) -> str:
    return "|".join((name[0], " ".join(name[1]), " ".join(m or "0" for m in name[2])))


def unpacked_name(s: str) -> tuple[str, list[str], list[str]]:
    kind, words, signs = s.split("|")
    return kind, words.split(" "), ["" if m == "0" else m for m in signs.split(" ")]


def parsed(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, text_val, name) of each row with a word in its text; null texts give none."""
    kinds = dict(df.dtypes)

    def make():
        def one(text: str) -> str:
            name = parse(text)
            return packed(name) if name[1] else ""

        memo = Memo(one, 50_000, 256)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = pa.array([memo[t] for t in batch.column(len(keys)).to_pylist()], pa.string())
            out = pa.record_batch([*(batch.column(j) for j in range(len(keys) + 1)), got], names=[*keys, "text_val", "name"])
            return out.filter(pa.compute.not_equal(got, ""))

        return step

    rows = df.select(*keys, F.col(text_col).alias("text_val")).where(F.col(text_col).isNotNull())
    return map_batches(rows, make, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", text_val string, name string")


def counted_features(words: DataFrame) -> DataFrame:
    """(f, n): how many names hold a feature of their words; '=' and a word for the word itself."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for w, org, n in zip(*(c.to_pylist() for c in batch.columns)):
                for f in (*word_features(w, "org" if org else ""), "=" + w):
                    seen[f] += n
            return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["f", "n"])

        return step

    return map_batches(words.select("w", "org", "n"), make, "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n"))


def hashed(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")


def posted(nodes: DataFrame, weights: tuple[dict[str, int], int], hot: dict[int, int]) -> DataFrame:
    """(node, key): a row for each prefix feature of a node; names of one group that share a feature share a key.

    ``hot`` tells the sizes of large groups (by hash). Where a feature may have more
    than BLOCK names in such a group its names are dealt to blocks, and every two
    blocks get a key of their own, so no task holds them all and no pair is lost.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((*weights, hot))

    def make():
        counts, total, sizes = shared.value
        vectors = Vectors(counts, total)
        code = Memo(hashed)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, features, cells = [], [], []
            owners, groups = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, name in enumerate(batch.column(2).to_pylist()):
                prefix, size = vectors.prefix(name), sizes.get(groups[k], 0)
                for f in prefix:
                    blocks = -(-min(size, int(vectors.most(f))) // BLOCK) if size else 1
                    own = owners[k] % blocks if blocks > 1 else 0
                    for other in range(max(1, blocks)):
                        at.append(k)
                        features.append(code[f])
                        cells.append(min(own, other) * blocks + max(own, other))
            index = np.array(at, np.int64)
            group = np.array(groups, np.int64).view(np.uint64)[index]
            key = (np.array(features, np.uint64) ^ group * np.uint64(0x9E3779B97F4A7C15)) + np.array(cells, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            return pa.record_batch([batch.column(0).take(pa.array(index)), pa.array(key.view(np.int64))], names=["node", "key"])

        return step

    return map_batches(nodes.select("node", F.xxhash64("grp"), "name"), make, "node bigint, key bigint")


def similar(nodes: DataFrame, weights: tuple[dict[str, int], int], hot: dict[int, int], common: frozenset[str], top_n: int | None = None) -> DataFrame:
    """(a, b, sim): the pairs of a group with a cosine of at least COSINE that :func:`agree` confirms; ``sim`` is the
    cosine times how well they agree.

    A sparse similarity join: nodes that share a prefix feature are candidates, each
    once, and their vectors' cosine is summed over the shared features. ``top_n``
    keeps each node's so many best pairs; None, as in production, keeps all, since
    the threshold bounds them and a cap would lose links.
    """
    posts = posted(nodes.where(F.col("grp").isNotNull()), weights, hot)
    pairs = posts.toDF("a", "key").join(posts.toDF("b", "key"), "key").where("a < b").select("a", "b").distinct()
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(s), F.col("grp").alias(f"grp_{s}"), F.col("name").alias(f"name_{s}")), s)
    shared = nodes.sparkSession.sparkContext.broadcast(weights)

    def make():
        vectors, memo = Vectors(*shared.value), Memo(unpacked_name, 20_000, 256)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sims = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                c = vectors.cosine(x, y)
                sims.append(c * agree(memo[x], memo[y], common) if c >= COSINE else 0.0)
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])
            return out.filter(pa.array([s > 0 for s in sims]))

        return step

    # two groups can share a key only by chance
    links = map_batches(pairs.where("grp_a = grp_b").select("a", "b", "name_a", "name_b"), make, "a bigint, b bigint, sim double")
    if top_n is not None:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
        links = both.withColumn("n", place).where(F.col("n") <= top_n).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()
    return links


def tie(a: int, b: int) -> int:
    """Spark's xxhash64 of the lesser and the greater number, as :func:`average_linkage` orders equal links."""
    mask, h = (1 << 64) - 1, 42
    for x in (min(a, b), max(a, b)):
        k = x * 0xC2B2AE3D27D4EB4F & mask
        h = (h + 0x27D4EB2F165667C5 + 8 & mask) ^ ((k << 31 | k >> 33) * 0x9E3779B185EBCA87 & mask)
        h = ((h << 27 | h >> 37) * 0x9E3779B185EBCA87 + 0x85EBCA77C2B2AE63) & mask
        h = (h ^ h >> 33) * 0xC2B2AE3D27D4EB4F & mask
        h = (h ^ h >> 29) * 0x165667B19E3779F9 & mask
        h ^= h >> 32
    return h - (h >> 63 << 64)


def merged(links: dict[tuple[int, int], float], threshold: float = LINK) -> dict[int, int]:
    """node -> cluster of every node with a link: the rounds of :func:`average_linkage` for links that one task holds."""
    clusters = {x: x for ab in links for x in ab}
    sizes, edges = dict.fromkeys(clusters, 1), links
    while True:
        best: dict[int, tuple[float, int]] = {}
        for (a, b), s in edges.items():
            mean = round(s / sizes[a] / sizes[b], 9)
            if mean >= threshold:
                for x, y in ((a, b), (b, a)):
                    m, z = best.get(x, (0.0, y))
                    if mean > m or mean == m and (tie(x, y), y) > (tie(x, z), z):
                        best[x] = mean, y
        merges = {b: a for a, (_, b) in best.items() if a < b and best[b][1] == a}
        if not merges:
            return clusters
        clusters = {x: merges.get(c, c) for x, c in clusters.items()}
        for b, a in merges.items():
            sizes[a] += sizes.pop(b)
        sums: dict[tuple[int, int], float] = {}
        for (a, b), s in edges.items():
            a, b = merges.get(a, a), merges.get(b, b)
            if a != b:
                ab = (a, b) if a < b else (b, a)
                sums[ab] = sums.get(ab, 0.0) + s
        edges = sums


def linked_in_tasks(nodes: DataFrame, weights: tuple[dict[str, int], int], common: frozenset[str], tasks: int) -> DataFrame:
    """(node, cluster) of every node with a link, for groups of no more than BLOCK names.

    A task holds such a group whole, so all its cosines are summed there and its links merged, by the definitions of
    :func:`similar` and :func:`average_linkage` but without a shuffle of features, of pairs or of rounds.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, memo = Vectors(*shared.value), Memo(unpacked_name, 20_000, 256)

        def linked(ids: list[int], groups: list, names: list[str]) -> pa.RecordBatch:
            group = np.cumsum([a != b for a, b in zip(groups, [groups[0], *groups])])
            links = {}
            for *pairs, cosine in cosines(names, group, vectors):
                some = cosine >= COSINE
                for i, j, c in zip(*(x[some].tolist() for x in (*pairs, cosine))):
                    sim = c * agree(memo[names[i]], memo[names[j]], common)
                    if sim > 0:
                        links[ids[i], ids[j]] = sim
            clusters = merged(links)
            return pa.record_batch([pa.array(x, pa.int64()) for x in (clusters.keys(), clusters.values())], names=["node", "cluster"])

        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for own, column in zip(held, batch.columns):
                own += column.to_pylist()
            groups = held[1]
            if groups and groups[0] != groups[-1]:  # the last group may go on in the next batch
                end = groups.index(groups[-1])
                yield linked(*(own[:end] for own in held))
                held = tuple(own[end:] for own in held)
        if held[0]:
            yield linked(*held)

    # an explicit number of tasks, as by bytes these rows would go into one or two; by node too, as agree() looks at the lesser first
    whole = nodes.select("node", "grp", "name").repartition(tasks, "grp").sortWithinPartitions("grp", "node")
    return whole.mapInArrow(run, "node bigint, cluster bigint")


def link(rows: DataFrame, id_col: str, group_col: str, text_col: str) -> DataFrame:
    """(id, group, text_val, cluster): every row whose text names something, with its cluster within its group.

    Names become weighted vectors of character n-grams, joined by cosine within
    their group (:func:`similar`), and average linkage over the cosines gives the
    clusters; groups of no more than BLOCK names have both in one task. Rows with
    equal names are one node, so copies cost nothing. Rows without a group are
    linked with none. Repeated ids must be removed before.
    """
    source = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(text_col).alias("text"))
    named = checkpointed(parsed(source, ["id", "grp"], "text").withColumn("node", F.xxhash64("grp", "name")))
    nodes = checkpointed(named.groupBy("node").agg(F.first("grp").alias("grp"), F.first("name").alias("name")))
    total = nodes.count()
    part = F.split("name", "[|]")
    words = nodes.select(F.explode(F.array_distinct(F.split(part[1], " "))).alias("w"), (part[0] == "org").alias("org"))
    words = checkpointed(words.groupBy("w", "org").agg(F.count("*").alias("n")))
    common = frozenset(r.w for r in words.groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= max(3, COMMON * total)).collect())
    counts = {r.f: r.n for r in counted_features(words).where(F.col("n") > max(2, RARE * total)).collect()}
    grouped = nodes.where(F.col("grp").isNotNull())
    large = checkpointed(grouped.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    clusters = checkpointed(linked_in_tasks(grouped.join(large, "grp", "left_anti"), (counts, total), common, -(-total // TASK_NAMES) or 1))
    if not large.isEmpty():
        hot = {r.g: r.n for r in large.where(F.col("n") > HOT * total).select(F.xxhash64("grp").alias("g"), "n").collect()}
        links = checkpointed(similar(grouped.join(large, "grp", "left_semi"), (counts, total), hot, common))
        clusters = clusters.unionByName(average_linkage(links))
    return named.join(clusters, "node", "left").select(F.col("id").alias(id_col), F.col("grp").alias(group_col), "text_val", F.coalesce("cluster", "node").alias("cluster"))


def average_linkage(links: DataFrame, threshold: float = LINK) -> DataFrame:
    """(node, cluster) of every node with a link, by average linkage; absent links count as 0.

    In each round all clusters that are each other's best merge: average linkage is
    reducible, so this gives the clusters of the sequential method. Ties go by a
    hash of the pair, which is the same for both. Everything stays distributed.
    """
    both = links.select("a", "b", "sim").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    nodes = checkpointed(both.select(F.col("a").alias("node")).distinct().withColumn("cluster", F.col("node")))
    edges, old = both, []
    while True:
        sizes = nodes.groupBy("cluster").agg(F.count("*").alias("n"))
        sums = edges.groupBy("a", "b").agg(F.sum("sim").alias("sim"))
        means = sums.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
        means = means.withColumn("mean", F.round(F.col("sim") / F.col("na") / F.col("nb"), 9)).where(F.col("mean") >= threshold)
        best = means.groupBy("a").agg(F.max(F.struct("mean", F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        merges = best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b").select(F.col("b").alias("old"), F.col("a").alias("new"))
        merges = checkpointed(merges)
        if merges.isEmpty():
            return nodes
        last = [nodes, merges, *old]
        nodes = checkpointed(nodes.join(merges, nodes["cluster"] == merges["old"], "left").select("node", F.coalesce("new", "cluster").alias("cluster")))
        edges = sums
        for end in "ab":
            edges = edges.join(merges, edges[end] == merges["old"], "left").withColumn(end, F.coalesce("new", end)).drop("old", "new")
        edges = checkpointed(edges.where("a <> b"))
        discard(*last)  # only the round's own tables are read by the next
        old = [edges]


def same_bearer(linked: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """(id_a, id_b), smaller first: rows of one cluster with different texts.

    Rows of a cluster above BLOCK are dealt to blocks, and every two blocks meet in a
    task of their own, so a large cluster is spread over many.
    """
    keys = [group_col, "cluster"]
    sizes = linked.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = linked.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64(id_col), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
    rows = rows.withColumn("home", F.col("own") == F.col("other"))
    a, b = (rows.select(*keys, "cell", F.col("own").alias(f"own_{s}"), F.col("home").alias(f"home_{s}"), F.col(id_col).alias(f"{id_col}_{s}"), F.col("text_val").alias(f"t_{s}")) for s in "ab")
    pairs = a.join(b, [*keys, "cell"]).where((F.col(f"{id_col}_a") < F.col(f"{id_col}_b")) & (F.col("t_a") != F.col("t_b")))
    # two rows of one block also meet beside other blocks; they count where the block meets itself
    return pairs.where((F.col("own_a") != F.col("own_b")) | F.col("home_a")).select(f"{id_col}_a", f"{id_col}_b")
