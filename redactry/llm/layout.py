"""Problem 6: page layout and misrecognised characters in text from scanned pages."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactry.llm import corpus
from redactry.llm.arrow import Memo, map_batches

#: What recognition makes of letters. Signs and digits never stand inside a word; letters may.
SIGNS = {"@": "a", "!": "il", "|": "li", "†": "t", "$": "s", "0": "o", "1": "li", "3": "e", "4": "a", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g"}
LETTERS = {"rn": "m", "li": "h", "cl": "d", "c|": "d", "c": "e", "ii": "u", "ri": "n", "vv": "w", "tl": "d", "rri": "m", "iii": "m", "lc": "k", "m": "rn"}
HYPHENS = "-¬\N{SOFT HYPHEN}\N{HYPHEN}"
EDGE = " .,;:?!()[]{}\"'“”‘’«»„…–—*•"
#: A letter confusion is accepted if the corpus knows the word it gives this many times better.
RATIO = 20.0
#: What the steps of the decoder cost beside the words: a sign inside an unknown word, a missing or added blank; and what
#: joining halves over a hyphen at a line's end saves.
SIGN, CUT, JOINED = 0.1, 6.0, 1.0
#: Words that stand before a page number.
PAGE_WORDS = "page|seite|página|pagina|pág|pag|trang|страница|стр|blatt|folio|folha|feuillet|hoja|sheet|tờ|лист|p|s"
PAGE = re.compile(rf"\W*(?:(?:{PAGE_WORDS})\b\.?\s*)?(?:n[.ºo°]*\s*)?\d{{1,4}}(?:\s*(?:/|of|von|de|sur|di|trên|из|\|)\s*\d{{1,4}})?\W*", re.I)
SIGNED = re.compile(r"(?:[^\W\d_]|\|)[@!|†$\d](?:[^\W\d_]|\|)|^[@!|†$\d](?:[^\W\d_]|\|){2,}$|(?:[^\W\d_]|\|){2}[@!|†$\d]$")
CODE = re.compile(r"\d\D*\d|@.*\.|^[A-ZĐ]{2,6}\d|^[A-ZĐ]\d+(?:\W|$)|^\d+[A-Za-z]$|^\d+(?:st|nd|rd|th|er|re|e|ème|ª|º|h|m|kg|mm|cm|km|g|l)$|^[\W\d_]+$|://|^www\.|_")
LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]+")
MARKS = " \t.,;:!?()[]{}<>|/*#-–—_=~•·"
BROKEN = re.compile(f"[{HYPHENS}]\n")
BULLET = re.compile(r"[-*•] ")
#: Company forms, whose full stop ends no sentence.
COMPANY = re.compile(r"\b(?:Inc|Ltd|Corp|Co|L\.L\.C|S\.A)\.$")
DIGIT, DASHED, NUMBERED = re.compile(r"\d"), re.compile(r"[-–—]\s*\d{1,4}\s*[-–—]"), re.compile(r"\d{1,4}[.)]?")
END = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


#: Signs and letters that recognition takes for one another, as one letter; then groups of letters, the longest first.
LIKE = str.maketrans("@4!|1i†$50368c9", "aalllltssoebbeg")
GROUPS = (("rrl", "m"), ("lll", "m"), ("ll", "h"), ("u", "h"), ("rn", "m"), ("vv", "w"), ("el", "d"), ("tl", "d"), ("le", "k"), ("rl", "n"))
#: Letters and signs that a signature keeps as they are, so equal signatures have equally many of each.
KEPT = "pyf,."
ALONE = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])")


def signature(line: str) -> str:
    """The line as recognition may blur it: equal for a line and what it is misread as; numbers don't count."""
    out = ALONE.sub("#", line.lower()).translate(LIKE)
    for group, one in GROUPS:
        if group in out:
            out = out.replace(group, one)
    return out


class Repairer:
    """Decodes texts with corpus word counts; ``least`` is the count below which a word was left out of them."""

    def __init__(self, lexicon: dict[str, int], total: int, least: float):
        self.lexicon, self.total, self.floor = lexicon, max(1, total), max(0.5, least / 2)
        self.longest = max(map(len, lexicon), default=0)
        self.misread = Memo(self._misread)
        self.open = Memo(self._open)

    def count(self, word: str) -> float:
        return self.lexicon.get(word.lower(), 0)

    def cost(self, word: str) -> float:
        """Negative log probability of a word in the corpus."""
        return -math.log(max(self.count(word), self.floor) / self.total)

    def variants(self, part: str) -> set[str]:
        """What the word may have been: one or two confusions undone."""
        out, front = set(), {part}
        for _ in range(2):
            step = set()
            for w in front:
                low = w.lower()
                for seen, true in LETTERS.items():
                    i = low.find(seen.lower())
                    while i >= 0:
                        step.add(w[:i] + true + w[i + len(seen) :])
                        i = low.find(seen.lower(), i + 1)
                for i, c in enumerate(w):
                    for true in SIGNS.get(c, ""):
                        step.add(w[:i] + true + w[i + 1 :])
            out |= step
            front = {w for w in step if any(c in SIGNS for c in w)} if any(c in SIGNS for c in part) else set()
        return out

    def _misread(self, token: str) -> str | None:
        """The token as it was printed, if a character in it was misrecognised, else None."""
        core = token.strip(EDGE) if token[-1:] not in "|†" else token.lstrip(EDGE)
        if len(core) < 3 or CODE.search(core):
            return None
        # a frequent form is a word of its own, unless what it may stand for is far more frequent still
        often = self.count(core) * RATIO > self.total * 1e-4
        out = []
        for part in re.split(r"([-/'’])", core):
            new = part
            if len(part) > 2 and not part.isdigit():
                known = self.count(part)
                # two confusions undone shorten a word by four letters at most, so beyond that it can't be one of the corpus
                best = max(self.variants(part), key=lambda w: (self.count(w), w), default=part) if len(part) <= self.longest + 4 else part
                n = self.count(best)
                if often and n < 10 * RATIO * known:
                    pass
                elif SIGNED.search(part):
                    plain = "".join(SIGNS.get(c, c)[0] for c in part)
                    if n > known:
                        new = best
                    elif plain.isalpha() and LATIN.fullmatch(plain) and not part[0].isdigit() and not known and sum(map(str.isdigit, part)) < 2:
                        if not part[-1].isdigit() and not (part[-1] in "!|" and token.rstrip(EDGE).endswith(part[-1])):
                            new = plain
                elif part.isalpha() and n > RATIO * max(known, self.floor):
                    new = best
            out.append(new)
        new = "".join(out)
        return None if new == core else token.replace(core, new, 1)

    def broken(self, left: str, right: str) -> str | None:
        """The word whose halves end one line and begin the next, else None."""
        a, b = left.lstrip(EDGE), right.rstrip(EDGE)
        stem = a.rstrip(HYPHENS)
        if not stem or not b or not b[0].isalpha() or "@" in b and "." in b or not stem[-1].isalpha() and stem[-1] not in SIGNS:
            return None
        joined = stem + b
        if a[-1] != "-":
            return joined
        if b[0].isupper() and not stem.isupper():
            return None
        whole, natural = self.count(joined), self.count(f"{stem}-{b}")
        if whole or natural:
            return joined if whole >= natural else None
        if "-" in b and (self.count(stem + b.split("-")[0]) or self.count(f"{stem}-{b.split('-')[0]}") == 0):
            return joined
        fixed = self.misread[joined]
        if fixed and self.count(fixed):
            return fixed
        parts = min(self.count(stem), self.count(b))
        return None if parts > self.floor * 4 and len(stem) > 3 and len(b) > 3 else joined

    def furniture(self, lines: list[str]) -> dict[int, str]:
        """line -> 'page' or 'header' of the lines that belong to the page and not to the text.

        Page numbers by their form; a lone number where it cuts a sentence, stands by
        a header, or continues such a number. Headers and footers repeat, but for
        numbers and misread characters, and cut a sentence, stand by a page number, or
        stand between sentences without being one. Linear in the lines, of any length.
        """
        out: dict[int, str] = {}
        lone: dict[int, int] = {}
        groups: dict[str, list[int]] = defaultdict(list)
        kin: dict[tuple, list[int]] = defaultdict(list)
        blanks = [s.count(" ") if s and not s[-1].isspace() and not s[0].isspace() else s.strip().count(" ") for s in lines]
        alike = Counter(blanks)
        for i, s in enumerate(lines):
            t = s.strip()
            if not t:
                continue
            if (m := DASHED.match(t)) and (not END.search(t[m.end() :]) or COMPANY.search(t)):
                out[i] = "page"
                continue
            if DIGIT.search(t) and len(t.strip(MARKS)) < 30:  # no form of a page number is longer
                if PAGE.fullmatch(t) and not NUMBERED.fullmatch(t):
                    out[i] = "page"
                    continue
                if t.isdigit() and len(t) < 5:
                    lone[i] = int(t)
                    continue
            if len(t) > 3 and alike[blanks[i]] > 1:  # equal signatures have equally many blanks
                low = t.lower()
                kin[blanks[i], *map(low.count, KEPT)].append(i)
        for at in kin.values():
            for i in at if len(at) > 1 else ():
                groups[signature(lines[i].strip())].append(i)
        if lone:
            cut = self.cutting(lines, out)
            out |= {i: "page" for i in lone if cut(i)}
        heads = [at for at in sorted(groups.values()) if len(at) > 1 and not next(filter(str.isalnum, lines[at[0]]), "a").islower() and not BULLET.match(lines[at[0]].strip())]
        repeated = {i: "" for at in heads for i in at} | dict.fromkeys(lone, "") | out
        width, cut = max(map(len, lines)), self.cutting(lines, repeated)
        for at in heads:
            head = lines[at[0]].strip()
            proof = sum(cut(i) or i - 1 in out or i + 1 in out for i in at)
            if proof and proof * 2 >= len(at) - 1 or len(head) > 11 and " " in head and all(cut(i) or self.apart(lines, i, width) for i in at):
                out |= dict.fromkeys(at, "header")
        numbers = {i: n for i, n in lone.items() if i in out or i - 1 in out or i + 1 in out or i in (0, len(lines) - 1) and out}
        if numbers:  # pages are numbered upwards
            for i, n in lone.items():
                if i in numbers or any(j < i and m < n <= m + i - j or j > i and n < m <= n + j - i for j, m in numbers.items()):
                    out[i] = "page"
        elif len(lone) > 1 and all(b - a == 1 for a, b in zip(lone.values(), list(lone.values())[1:])):
            out |= dict.fromkeys(lone, "page")
        return out

    @staticmethod
    def apart(lines: list[str], i: int, width: int) -> bool:
        """Is line i no sentence, and broken off where the next line's first word would have had room?"""
        s = lines[i].rstrip()
        if END.search(s) and not COMPANY.search(s):
            return False
        after = lines[i + 1].split(" ")[0] if i + 1 < len(lines) else ""
        return len(s) + 1 + len(after) <= width

    @staticmethod
    def cutting(lines: list[str], skip: dict) -> Callable[[int], bool]:
        """Tells of a line whether the sentence before it goes on behind it, passing over the lines in ``skip``."""
        before, after, k = [-1] * len(lines), [len(lines)] * len(lines), -1
        for i in range(len(lines)):
            before[i] = k
            k = k if i in skip else i
        k = len(lines)
        for i in range(len(lines) - 1, -1, -1):
            after[i] = k
            k = k if i in skip else i

        def cut(i: int) -> bool:
            a, b = before[i], after[i]
            if a < 0 or b >= len(lines) or not lines[a].strip() or not lines[b].strip():
                return False
            return not END.search(lines[a].strip()) and (lines[b].lstrip()[0].islower() or lines[a].rstrip()[-1] in HYPHENS)

        return cut

    def hypotheses(self, token: str) -> tuple[tuple[float, str, str], ...]:
        """(cost, word, kind) of what a token may stand for: itself, itself misread; the first is the token as it is.

        Words cost their rarity in the corpus. Only confusions that make a word RATIO
        times likelier, or undo a sign inside an unknown word, are offered.
        """
        new = self.misread[token]
        own = self.cost(token.strip(EDGE))
        if not new:
            return ((own, token, ""),)
        return (own + SIGN, token, ""), (min(self.cost(new.strip(EDGE)), own), new, "misread")

    def _open(self, token: str) -> int:
        """What the lattice may do with a token: 0 keep it, 1 join it with another unknown one, 2 read or cut it differently."""
        if self.misread[token] or self.cut(token):
            return 2
        return int(bool(token) and token.strip(EDGE).isalpha() and not self.count(token.strip(EDGE)))

    def cut(self, token: str) -> tuple[float, int] | None:
        """(cost, place) of the best cut of an unknown token into two frequent words."""
        if not 6 <= len(token) <= 2 * self.longest or not token.isalpha() or self.count(token):
            return None
        sure = self.floor * 20
        return min(((self.cost(token[:k]) + self.cost(token[k:]) + CUT, k) for k in range(2, len(token) - 1) if self.count(token[:k]) > sure and self.count(token[k:]) > sure), default=None)

    def decode(self, tokens: list[str], line: list[int], ends: list[int] | None = None) -> list[tuple[int, int, str, str]]:
        """(first token, token behind, text, kind) wherever the likeliest reading of the stream differs from it.

        The lines' characters form one stream. A shortest path over its places chooses
        between keeping, correcting, splitting and merging words and joining halves over
        a hyphen at a line's end. Places where only one reading is possible part the
        lattice, so it is laid out only between them. ``ends`` tells the tokens that begin a line, if known.
        """
        kinds = list(map(self.open.__getitem__, tokens))
        n, out = len(tokens), []
        # only these can begin a stretch with more than one reading
        begins = {i for i, k in enumerate(kinds) if k} | {i - 1 for i in ([i for i in range(1, n) if line[i] != line[i - 1]] if ends is None else ends) if tokens[i - 1] and tokens[i - 1][-1] in HYPHENS}

        def linked(i: int) -> bool:
            """May token i be joined with the next?"""
            if i + 1 >= n or not tokens[i] or not tokens[i + 1]:
                return False
            return line[i + 1] == line[i] + 1 and tokens[i][-1] in HYPHENS if line[i] != line[i + 1] else kinds[i] > 0 and kinds[i + 1] > 0

        done = -1
        for i in sorted(begins):
            if i <= done:
                continue
            j = i
            while linked(j):
                j += 1
            if j > i or kinds[i] == 2:
                out += self.path(tokens[i : j + 1], line[i : j + 1], i)
            done = j
        return out

    def path(self, tokens: list[str], line: list[int], first: int) -> list[tuple[int, int, str, str]]:
        """The shortest path over a stretch of the stream; places are those of its characters."""
        starts = [0]
        for t in tokens:
            starts.append(starts[-1] + len(t) + 1)  # a blank or line feed stands between
        owner = {p: k for k, p in enumerate(starts)}
        best: dict[int, tuple[float, int, str, str]] = {0: (0.0, 0, "", "")}

        def offer(a: int, b: int, cost: float, text: str, kind: str) -> None:
            total = best[a][0] + cost
            if b not in best or total < best[b][0]:
                best[b] = (total, a, text, kind)

        for p in range(starts[-1]):
            if p not in best or p not in owner:
                continue
            k = owner[p]
            token, end = tokens[k], starts[k + 1]
            options = self.hypotheses(token)
            for cost, text, kind in options:
                offer(p, end, cost, text, kind)
            if cut := self.cut(token):
                offer(p, end, cut[0], f"{token[: cut[1]]} {token[cut[1] :]}", "fused")
            if k + 1 < len(tokens):
                after, end = tokens[k + 1], starts[k + 2]
                bare = after.strip(EDGE)
                if line[k] != line[k + 1]:
                    if joined := self.broken(token, after):
                        lead, tail = token[: len(token) - len(token.lstrip(EDGE))], after[len(after.rstrip(EDGE)) :]
                        # halves cost at most as much as the first alone, since a hyphen ends no line by itself
                        offer(p, end, min(self.cost(joined), options[0][0]) - JOINED, lead + joined + tail, "broken")
                elif token.isalpha() and bare.isalpha() and not self.count(token) and not self.count(bare) and self.count(token + bare):
                    offer(p, end, self.cost(token + bare) + CUT, token + after, "parted")
        out, p = [], starts[-1]
        while p:
            _, a, text, kind = best[p]
            if kind:
                out.append((first + owner[a], first + owner[p], text, kind))
            p = a
        return out[::-1]

    def is_noisy(self, text: str, tokens: list[str]) -> bool:
        """Whether :meth:`noisy` finds anything, for a text already cut into its tokens."""
        if any(map(self.misread.__getitem__, tokens)):
            return True
        if "\n" not in text:
            return False
        # without a misread token only page furniture and halves at a line's end are left to find
        return bool(self.furniture(text.split("\n"))) or BROKEN.search(text) is not None and bool(self.noisy(text))

    def stream(self, text: str) -> tuple[list[str], list[int], list[int], dict[int, str], list[str], list[int]]:
        """(tokens, their lines, their numbers in the text, number -> kind of the tokens of page furniture, lines, tokens that
        begin a line) of the text's body."""
        lines = text.split("\n")
        plain = self.furniture(lines) if len(lines) > 1 else {}
        tokens, line, number, marks, body, ends, at = [], [], [], {}, [], [], 0
        for i, s in enumerate(lines):
            parts = s.split(" ")
            if i in plain:
                marks |= {at + k: plain[i] for k, t in enumerate(parts) if t}
            else:
                if s:
                    if tokens:
                        ends.append(len(tokens))
                    tokens += parts
                    line += [len(body)] * len(parts)
                    number += range(at, at + len(parts))
                body.append(s)
            at += len(parts)
        return tokens, line, number, marks, body, ends

    def noisy(self, text: str) -> dict[int, str]:
        """token number -> kind of noise ('broken', 'misread', 'header', 'page'): where the decoded text differs from the
        given one in its letters or lines. Tokens are cut at blanks and line feeds. A missing or added blank is repaired
        but no noise of a page."""
        if "\n" not in text:
            tokens = text.split(" ")
            line, number, out, ends = [0] * len(tokens), range(len(tokens)), {}, []
        else:
            tokens, line, number, out, _, ends = self.stream(text)
        for a, b, _, kind in self.decode(tokens, line, ends):
            if kind in ("misread", "broken"):
                out |= dict.fromkeys(number[a:b], kind)
        return out

    def repair(self, text: str) -> str:
        """The text in paragraphs, without page furniture, with words joined, parted and corrected as :meth:`decode` reads them."""
        tokens, line, _, _, body, ends = self.stream(text)
        breaks = self.paragraphs(body)
        changed = {a: (b, new) for a, b, new, _ in self.decode(tokens, line, ends)}
        out, last, i = [], 0, 0
        while i < len(tokens):
            b, word = changed.get(i, (i + 1, tokens[i]))
            if word:
                if out:
                    out.append("\n\n" if any(breaks[last : line[i]]) else " ")
                out.append(word)
                last = line[b - 1]
            i = b
        return "".join(out)

    @staticmethod
    def paragraphs(lines: list[str]) -> list[bool]:
        """Does a paragraph end after each line? Chosen by dynamic programming over the lines.

        Inside a paragraph all lines but the last should be full and may end anywhere;
        its last line should end a sentence. Every paragraph costs something.
        """
        width = max((len(s) for s in lines), default=0) or 1

        def inner(k: int) -> float:
            s = lines[k].rstrip()
            room = width - len(s)
            after = lines[k + 1].split(" ")[0] if k + 1 < len(lines) and lines[k + 1] else ""
            return 0.0 if s and room <= len(after) else min(4.0, 8.0 * room / width) * (2.0 if END.search(s) else 0.5)

        n = len(lines)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        a, total = 0, 0.0  # the cheapest begin of a paragraph that holds line b; what follows costs the same for every begin
        for b in range(n):
            if best[b] < best[a] + total:
                a, total = b, 0.0
            s = lines[b].strip()
            end = 1.5 + (0.0 if END.search(s) else 3.0)
            if not s or b + 1 < n and (not lines[b + 1].strip() or re.match(r"\s*[-*•]\s", lines[b + 1])):
                end = 0.0
            best[b + 1], back[b + 1] = best[a] + total + end, a
            total += inner(b) if s else 50.0
        out, i = [False] * n, n
        while i:
            out[i - 1] = True
            i = back[i]
        return out


def train(words: DataFrame) -> tuple[dict[str, int], int, float]:
    """(lexicon, total, least) for :class:`Repairer` from :func:`corpus.word_counts`; at most 1 / share entries."""
    total = words.agg(F.sum("n")).first()[0] or 0
    counts: Counter = Counter()
    for w, n in corpus.frequent(words, corpus.WORD_SHARE, 2).items():
        counts[w.strip(EDGE).lower()] += n
    return dict(counts), total, max(corpus.WORD_SHARE * total, 2)


def find_noise(df: DataFrame, trained, id_col: str = "scan_id", text_col: str = "text") -> DataFrame:
    """(id, token_no, kind) of the noisy tokens, counted from 0 over blanks and line feeds; null and empty texts have none."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(trained)

    def make():
        r = Repairer(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, numbers, kinds = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, what in r.noisy(t).items() if t else ():
                    ids.append(i)
                    numbers.append(k)
                    kinds.append(what)
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(kinds, pa.string())], names=["id", "token_no", "kind"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return map_batches(rows, make, f"id {kind}, token_no int, kind string").withColumnRenamed("id", id_col)


def repair_texts(df: DataFrame, trained, id_col: str = "scan_id", text_col: str = "text") -> DataFrame:
    """(id, repaired) of the texts in which noise is found; the others need no repair."""
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast(trained)

    def make():
        r = Repairer(*shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(i, r.repair(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t and r.noisy(t)]
            return pa.record_batch([pa.array([i for i, _ in found], batch.schema.field(0).type), pa.array([t for _, t in found], pa.string())], names=["id", "repaired"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return map_batches(rows, make, f"id {kind}, repaired string").withColumnRenamed("id", id_col)


def noisy_words(words: DataFrame, noise: DataFrame) -> DataFrame:
    """word_id of the rows of ``words`` that :func:`find_noise` names, by their place in the order of word_id."""
    place = words.select("scan_id", "word_id").dropDuplicates(["word_id"]).withColumn("token_no", F.row_number().over(Window.partitionBy("scan_id").orderBy("word_id")) - 1)
    return place.join(noise.select("scan_id", "token_no"), ["scan_id", "token_no"], "left_semi").select("word_id")
