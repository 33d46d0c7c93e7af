"""Problem 4: personal information inside free text."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactry.llm import corpus, encoding, layout, lookalike, names
from redactry.llm.arrow import Memo, map_batches
from redactry.sources.tables import checkpointed

UPPER = "".join(chr(c) for c in range(0x1F00) if chr(c).isupper())
L = r"[^\W\d_]"
#: Bits of information that a term must give away about the entities listed: how much likelier than any word of the corpus
#: such a term is listed. One threshold for all types.
DISCLOSED = 3.5
#: Mentions that the estimate behind a context (of its last word, its form, its type) counts for.
PRIOR = 8.0
#: Forms with contexts of at least this share of all mentions are known to every task: at most 1 / SHARE of them.
SHARE = 1e-4
#: Share of a word's occurrences that must stand in a person's name before it counts as part of names.
NAME_SHARE = 0.25
#: Words rarer than this among all words can be surnames; the more frequent ones are looked up (at most 1 / share).
COMMON = 2e-5

S = r"[ \n]+"
CAP = rf"[{UPPER}](?:{L}|['’])*(?:-{L}+)*"
JOIN = rf"(?:(?:do|da|dos|das|de|del|la|las|los|el|le|les|du|des|d['’]|l['’]|am|an|der|dem|den|im|bei|sur|sous|y|e){S})"
NAME = rf"{CAP}(?:{S}{JOIN}*(?![A-Z]{{1,2}}\d){CAP}(?!\d)){{0,3}}"
#: The words by which streets and their parts are known in the languages.
EN_STREET = "Street|Lane|Hill|Row|Bend|Quay|Yard|Road|Avenue|Drive|Court|Close|Way|Place|Square|Terrace|Crescent|Gardens|Walk|Mews|Grove|Rise|Green|Boulevard|Parade|Wharf|Alley|St|Rd|Ave|Ln|Dr|Blvd"
DE_STREET = "straße|strasse|str\\.|weg|gasse|platz|allee|ufer|damm|ring|stieg|acker|graben|berg|hof|markt|steig|pfad|kamp|garten|wall|chaussee|feld|winkel"
DE_LAST = "a-zäöüß."
FR_STREET = "rue|quai|allée|chemin|avenue|boulevard|place|impasse|route|cours|square|passage|sentier|faubourg|ruelle|esplanade|venelle|montée"
ES_STREET = "Calle|Avenida|Avda\\.|Paseo|Travesía|Plaza|Camino|Carretera|Ronda|Callejón|Pasaje|Cuesta|Glorieta|Vía"
PT_STREET = "Rua|Avenida|Av\\.|Travessa|Largo|Praça|Estrada|Alameda|Beco|Calçada|Rampa|Ladeira"
#: (words of which the text must hold one, the address from its number or keyword on); each begins with a digit or a fixed word, so the scan is fast.
FORMS = tuple(
    (tuple(need.split("|")), re.compile(form))
    for need, form in (
        (EN_STREET, rf"(?<![\w/.-])\d+[A-Z]?{S}(?:{CAP}{S}){{1,3}}(?:{EN_STREET})\b\.?,{S}{NAME}(?:,?{S}[A-Z]{{1,2}}\d[A-Z\d]?{S}\d[A-Z]{{2}}|,?{S}[A-Z]{{2}}{S}\d{{5}}(?:-\d{{4}})?)?"),
        (FR_STREET, rf"(?<![\w/.-])\d+(?:{S}(?:bis|ter|quater))?,?{S}(?:{FR_STREET}){S}{JOIN}*{NAME}(?:,{S}bât\.?{S}\w+)?,{S}(?:\d{{5}}{S})?{NAME}"),
        (f"{ES_STREET}|{PT_STREET}".replace("\\", ""), rf"(?<!\w)(?:{ES_STREET}|{PT_STREET}){S}{JOIN}*{NAME}(?:,|{S})?{S}?(?:n[º°o.]{{1,2}}{S})?\d+[A-Za-z]?(?:,{S}\d+\.?[ºª°]{S}?[A-Z]\w*|,{S}(?:apto|ap\.|apt\.|piso|andar){S}\d+\w*)?,{S}(?:\d{{5}}{S}|\d{{4,5}}-\d{{3}}{S})?{NAME}"),
        ("phường|xã|trấn|phuong|xa|tran|P.|X.", rf"(?<![\w/.-])\d+[A-Za-z]?(?:/\d+)*,?{S}(?:(?:đường|phố|duong|pho|ngõ|ngo){S})?{NAME},{S}(?:phường|xã|thị{S}trấn|phuong|xa|thi{S}tran|P\.|X\.){S}{NAME}(?:,{S}(?:quận|huyện|thị{S}xã|quan|huyen|thi{S}xa|Q\.|H\.){S}{NAME})?,{S}(?:thành{S}phố|tỉnh|thanh{S}pho|tinh|TP\.?|T\.){S}{NAME}"),
        ("г.", rf"(?<!\w)г\.{S}?{NAME},{S}ул\.{S}?{NAME},{S}(?:д\.|дом){S}?\d+\w?(?:,{S}кв\.{S}?\d+)?"),
        ("ул.", rf"(?<!\w)ул\.{S}?{NAME},{S}(?:(?:д\.|дом){S}?)?\d+\w?(?:,{S}кв\.{S}?\d+)?(?:,{S}(?:г\.{S}?)?{NAME})?"),
        ("ул.", rf"\d{{5,6}},{S}(?:г\.{S}?)?{NAME},{S}{NAME}{S}ул\.,{S}(?:дом|д\.){S}?\d+\w?(?:,{S}кв\.{S}?\d+)?"),
    )
)
#: Of FORMS, those that begin with a number, the head of any of them, and what any match of form 2 holds.
NUMBERED, HOUSE = (0, 1, 3), re.compile(r"(?<![\w/.-])\d+[A-Za-z]?(?:/\d+)*,?[ \n]")
KEYWORD = re.compile(rf"(?:{ES_STREET}|{PT_STREET})[ \n]")
#: A number behind a street's name, and what stands before it; and what may precede a match of FORMS.
DE_NUMBER = re.compile(rf"(?<=[{DE_LAST}])[ \n]\d+(?:[ \n]?[a-z]\b|/\d+)?,{S}(?:D-)?(?:\d{{5}}{S})?{NAME}")
DE_NAME = re.compile(rf"(?:(?:Am|An|Im|Auf|Zum|Zur|In)(?:{S}(?:der|dem|den))?(?:{S}{CAP}){{1,3}}|(?:{CAP}{S}){{0,2}}[{UPPER}]{L}*(?:{DE_STREET}))$")
LEAD = re.compile(r"(?:(?:Apt|Flat|Unit|Suite)\.?\s+\d+[A-Z]?,\s+|S[ốo]\s+|\d{6},\s+)$")


def back(text: str, at: int, words: int) -> int:
    """Where so many words, cut at blanks and line feeds, begin before a place."""
    while words and at > 0:
        before = at
        at = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at))
        if at < 0:
            return 0
        words -= before - at > 1
    return at


def matches(form: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """What ``form.finditer`` gives, for a form that can only match at these places, which ascend."""
    end = 0
    for i in places:
        if i >= end and (m := form.match(text, i)):
            end = m.end()
            yield m


def addresses(text: str, rule_out: bool = True, runs: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, form) of street addresses; with ``rule_out`` forms none of whose words the text holds are not looked for,
    and those that begin with a number or hold one behind a blank are tried at the text's numbers alone, which begin at ``runs``."""
    out = []
    if runs is None:
        runs = [m.start() for m in RUN.finditer(text)]
    houses = [i for i in runs if HOUSE.match(text, i)]
    for k, (need, form) in enumerate(FORMS):
        if not rule_out:
            got = form.finditer(text)
        elif k in NUMBERED:
            got = matches(form, text, houses)
        elif KEYWORD.search(text) if k == 2 else any(map(text.__contains__, need)):
            got = form.finditer(text)
        else:
            continue
        for m in got:
            lead = LEAD.search(text, back(text, m.start(), 3), m.start())
            out.append((lead.start() if lead else m.start(), m.end(), str(k)))
    for m in matches(DE_NUMBER, text, [i - 1 for i in runs if i and text[i - 1] in " \n"]) if rule_out else DE_NUMBER.finditer(text):
        name = DE_NAME.search(text, back(text, m.start(), 6), m.start())
        if name:
            out.append((name.start(), m.end(), "de"))
    return out


DOT, AT = r"(?:\.|\s*[\(\[\{<]\s*(?:dot|punkt|punto|ponto|point|chấm)\s*[\)\]\}>]\s*)", r"(?:@|[\(\[\{<]\s*(?:at|arroba|arobase|@)\s*[\)\]\}>])"
AT_SIGN = re.compile(AT, re.I)
LOCAL = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|{DOT}(?=[A-Za-z0-9]))*(?=\s*$)", re.I)
DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]|{DOT}(?=[A-Za-z0-9]))*{DOT}[A-Za-z]{{2,}}", re.I)


def emails(text: str) -> list[tuple[int, int, str]]:
    """(start, end, form) of addresses around each @, or the sign written as a word in brackets; of any length."""
    out = []
    for m in AT_SIGN.finditer(text):
        a, b = m.span()
        if m.group() != "@":
            while b < len(text) and text[b].isspace():
                b += 1
        room = 80
        while (left := LOCAL.search(text, max(0, a - room), a)) and left.start() <= a - room + 8 and room < a:
            room *= 2  # it may begin before the window
        right = DOMAIN.match(text, b)
        if left and right and (left.end() == a or m.group() != "@"):
            out.append((left.start(), right.end(), "plain" if m.group() == "@" else "spelled"))
    return out


DIGITS = re.compile(r"[+(]?\d[\d \n().+/-]{5,}\d")
RUN = re.compile(r"\d+")


SSN = re.compile(r"(?<![\w.+/-])(?!000|666|9\d\d)\d{3}([- \n])(?!00)\d\d\1(?!0000)\d{4}(?![\w/-]|\.\d)")
B = r"(?<![\w.,+/@-])"
E = r"(?![\w/@-]|[.,]\d)"
P = r"[ \n.-]"
PHONE = re.compile(
    rf"(?<![\w+.])(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{{3}}){P}?(?:\(0?\d{{0,4}}\){P}?)?\d(?:{P}?\d){{6,11}}{E}"
    rf"|(?<![\w+.])\(0?\d{{2,4}}\){P}?\d{{3,4}}{P}?\d{{3,4}}{E}"
    rf"|{B}0[35789]\d{P}?\d{{3}}{P}?\d{{4}}{E}|{B}0[35789]\d\d{P}\d{{3}}{P}\d{{3}}{E}|{B}07\d{{3}}{P}\d{{6}}{E}|{B}[2-9]\d\d[-.][2-9]\d\d[-.]\d{{4}}{E}"
    rf"|{B}0[1-79](?:{P}\d\d){{4}}{E}|{B}01[5-7]\d[- \n/]\d{{7,8}}{E}|{B}0[2-9]\d{{1,3}}[ \n/-]\d{{4,8}}(?:[ \n]\d{{2,4}})?{E}|{B}8[ \n]?\(\d{{3}}\)[ \n]?\d{{3}}[- ]\d\d[- ]\d\d{E}"
)
NATIONAL = re.compile(rf"{B}(?:\d{{12}}|\d{{9}}|\d{{3}}(?:[ \n]\d{{3}}){{2,3}}){E}")
INITIAL = re.compile(rf"[{UPPER}]\.(?:[{UPPER}]\.)*")
SMALL_INITIAL = re.compile("[a-z]\\.")
LETTERS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
FUSED = re.compile(r"[^\W\d_]{2}[A-ZÀ-ÞĐĂƠƯ](?:[^\W\d_]|['’])")
#: Characters that part tokens as white space does.
PARTING = ",;:!?()[]{}\"“”«»„<>…•/|"
TRAIL = ".'’-–—"


def _plain(cluster: str) -> str:
    return unicodedata.normalize("NFC", "".join(c if (p := lookalike.plain(c)) is None else p for c in cluster))


#: A character with its marks without disguises; and whether a character belongs to the one before.
PLAIN, ATTACHED = Memo(_plain), Memo(lambda c: bool(unicodedata.combining(c) or c in lookalike.INVISIBLE))


def tokens(text: str) -> list[str]:
    """The text's tokens; a sign replaced by a blank leaves all places as they are."""
    for c in PARTING:
        text = text.replace(c, " ")
    return text.split()


def flatten(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """(text without disguises, start and end in the given text of each of its characters or None if they agree)."""
    odd = list(lookalike.odd_tokens(text))
    if not odd:
        return text, None, None
    latin, out, start, end, at = names.latin_map(), [], [], [], 0

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        start.extend(range(a, b))
        end.extend(range(a + 1, b + 1))

    for a, token, script in odd:
        copy(at, a)
        i, b = a, a + len(token)
        while i < b:
            j = i + 1
            while j < b and ATTACHED[text[j]]:
                j += 1
            s = PLAIN[text[i:j]]
            if script == "L":
                s = s.translate(latin)
            out.append(s)
            start.extend([i] * len(s))
            end.extend([j] * len(s))
            i = j
        at = b
    copy(at, len(text))
    return "".join(out), start, end


class Tokens:
    """(start, end, word, kind) of a text's tokens, made when asked for."""

    def __init__(self, text: str, raws: list[str], info: dict[str, tuple[str, int, str]]):
        self.text, self.ends, self.raws, self.info = text, [], raws, info

    def __len__(self) -> int:
        return len(self.raws)

    def __getitem__(self, i: int) -> tuple[int, int, str, str]:
        raw, ends = self.raws[i], self.ends
        if i >= len(ends):  # no letter of a token stands between tokens, so each is the next place of its letters
            find, at = self.text.find, ends[-1] if ends else 0
            ends += [at := find(x, at) + len(x) for x in self.raws[len(ends) : i + 1]]
        word, lead, kind = self.info[raw]
        a = ends[i] - len(raw) + lead
        return a, a + len(word), word, kind


class Finder:
    """Finds mentions; knows which words are given names, surnames and plain words from corpus counts."""

    def __init__(self, given: frozenset[str], vi_given: frozenset[str], persons: frozenset[str], plain: frozenset[str]):
        self.given_names, self.vi_given, self.persons, self.plain = given, vi_given, persons, plain
        self.fused = re.compile("(?:" + "|".join(sorted((g for g in given if len(g) > 5), key=len, reverse=True)) + ")(?:van|von|de)$")
        self.info = Memo(self._info)
        self.code = Memo(lambda raw: self.info[raw][2] or " ")

    def _info(self, raw: str) -> tuple[str, int, str]:
        """(word, where it starts in the token, kind)."""
        word = _trim(raw)
        return (word, raw.index(word[0]), self._kind(word)) if word else ("", 0, "")

    def _kind(self, token: str) -> str:
        """g given name, f Vietnamese family name, F fused name, i initials, s possible surname, v Vietnamese given name or middle, p particle, '' other."""
        t = token.strip("'’-–—").rstrip(".") if not INITIAL.fullmatch(token) else token
        if not t:
            return ""
        if INITIAL.fullmatch(token):
            return "i"
        if SMALL_INITIAL.fullmatch(token):
            return "j"
        low = t.lower()
        if low in names.PARTICLES:
            return "p"
        if not LETTERS.fullmatch(t):
            return ""
        flat = names.bare(t)
        cap = t[0].isupper()
        if cap and not t.isupper() and FUSED.search(t) and not t.startswith(("Mc", "Mac", "Gmb")):
            head = "".join(f" {b}" if a.islower() and b.isupper() else b for a, b in zip(" " + t, t)).split()
            if names.bare(head[0]) in self.given_names or names.bare(head[0]) in names.FAMILY or names.bare(head[-1]) in self.vi_given and names.bare(head[-1]) != flat:
                return "F"
        if flat in names.FAMILY and (cap or len(flat) > 3 and low not in self.plain):
            return "f" if low not in self.plain or low in self.persons or flat not in SHORT_FAMILY else "d"
        if flat in self.given_names and (cap or len(flat) > 4 and low not in self.plain):
            return "g" if low not in self.plain or low in self.persons else "h"
        if cap and flat in self.vi_given:
            return "v"
        if cap and len(flat) > 4 and low not in self.plain and low not in self.persons and any(names.near(flat, g, 1) for g in self._alike(flat)):
            return "g"
        telex = names.from_telex(flat)
        if cap and telex != flat and telex in names.FAMILY and low not in self.plain and len(flat) > len(telex):
            return "f"
        if cap and telex != flat and telex in self.vi_given and low not in self.plain:
            return "v"
        if cap and len(flat) > 4 and self.fused.match(flat):
            return "g"
        if low not in self.plain or low in self.persons:
            return "s" if len(t) > 3 else "v" if cap and len(t) > 1 else ""
        return ""

    def _alike(self, flat: str) -> list[str]:
        if not hasattr(self, "_by"):
            self._by: dict[str, list[str]] = {}
            for g in self.given_names:
                if len(g) > 4:
                    for k in {g[:2], g[-3:]}:
                        self._by.setdefault(k, []).append(g)
        return [*self._by.get(flat[:2], ()), *self._by.get(flat[-3:], ())]

    def persons_in(self, text: str, raws: list[str], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
        """(start, end, kinds of the words, first word) of persons' names outside ``taken``; ``raws`` are the text's tokens."""
        kinds = "".join(map(self.code.__getitem__, raws))
        heads = [m.start() for m in HEADS.finditer(kinds)]
        if not heads:
            return []
        toks = Tokens(text, raws, self.info)
        n, out, used = len(kinds), [], -1
        bad = sorted(taken)
        ends = [y for _, y in bad]

        def free(i: int) -> bool:
            k = bisect_right(ends, toks[i][0])
            return k == len(bad) or bad[k][0] >= toks[i][1]

        def gap(i: int) -> str:
            return text[toks[i][1] : toks[i + 1][0]] if i + 1 < n else "\0"

        def spaced(i: int) -> bool:
            g = gap(i)
            return g != "" and not g.strip() and "\n\n" not in g

        def is_name(i: int) -> bool:
            return i < n and toks[i][3] in ("s", "g", "F") and free(i)

        def surname(i: int) -> int:
            """Index of the last token of (initials, particles, surname) from i, or -1."""
            j, small = i, i > 0 and toks[i - 1][2][:1].islower()  # the word before may be empty (a lone dash) or missing
            while j < n and (toks[j][3] in ("i", "p") or toks[j][3] == "j" and small) and (j == i or spaced(j - 1)):
                j += 1
            if j < n and (j == i or spaced(j - 1)) and is_name(j) and (toks[j][2][0].isupper() or small):
                return j
            return -1

        def particles(k: int) -> int:
            """The first token of the particles before a surname, without a preposition of the sentence."""
            j = k
            while j - 1 > used and toks[j - 1][3] == "p" and spaced(j - 1):
                j -= 1
            if k - j > 1:
                j = k - 2 if (toks[k - 2][2].lower(), toks[k - 1][2].lower()) in DOUBLE else k - 1
            elif j < k and toks[j][2] in PREPOSITIONS and (toks[j][2] == "von" or not (j and toks[j - 1][2].lower() in ("a", "à", "para", "pour", "con", "por", "com")) and any(toks[x][2].lower() in ROMANCE for x in range(max(0, j - 4), j))):
                j += 1
            return j

        for i in heads:
            if i <= used or not free(i):
                continue
            a, b, word, kind = toks[i]
            first = last = -1
            if kind in ("f", "v", "F", "d"):
                first, last = self._vietnamese(toks, i, kind, spaced, gap, free)
                if last < 0 and kind != "v" and names.bare(word) in self.vi_given:
                    first, last = self._vietnamese(toks, i, "v", spaced, gap, free)
            if last < 0 and kind in "gh":
                j = surname(i + 1) if spaced(i) else -1
                if j > 0:
                    first, last = i, j
                elif i - 1 > used and toks[i - 1][3] == "s" and free(i - 1) and (kind == "g" and spaced(i - 1) or gap(i - 1).strip() == "," and "\n\n" not in gap(i - 1)) and toks[i - 1][2][0].isupper() == word[0].isupper():
                    first, last = i - 1, i
                    first = particles(first)
                    if i + 1 < n and spaced(i) and toks[i + 1][3] == "i":
                        last = i + 1
            elif last < 0 and kind == "F":
                flat = names.bare(word)
                if any(flat.startswith(g) for g in self.given_names):
                    first = last = i
                    if i + 1 < n and spaced(i) and toks[i + 1][3] in ("p",) and surname(i + 1) > 0:
                        last = surname(i + 1)
            elif last < 0 and kind == "i":
                j = surname(i)
                if j > i and toks[j][2][0].isupper() and len(toks[j][2]) > 4 and text[a - 1 : a] != ".":
                    first, last = i, j
            elif last < 0 and kind == "s" and word[0].isupper() and i + 1 < n and toks[i + 1][3] == "i" and gap(i).strip() == "," and "\n\n" not in gap(i):
                first, last = particles(i), i + 1
            if last < 0:
                continue
            end = toks[last][1]
            if ORG_AFTER.match(text, end) or ORG_BEFORE.search(text, back(text, toks[first][0], 6), toks[first][0]):
                continue
            if toks[last][3] != "i":
                end = toks[last][0] + len(toks[last][2].rstrip(TRAIL))
            form = kinds[first : last + 1].replace(" ", "") + (toks[last][2] if kinds[last] == "i" else "")
            out.append((toks[first][0], end, form, names.bare(toks[first][2])))
            used = last
        return out

    def _vietnamese(self, toks, i, kind, spaced, gap, free) -> tuple[int, int]:
        """Family, middle and given name in either order, with a comma or initials, fused or in Telex."""
        n = len(toks)
        syllable = lambda k: k < n and (toks[k][3] in ("f", "v", "F", "g", "s", "d") or names.bare(toks[k][2]) == "van") and toks[k][2][0].isupper() and len(toks[k][2].rstrip(TRAIL)) <= (14 if toks[k][3] == "F" else 10 if toks[k][3] == "v" else 7) and free(k)
        if kind == "F" and names.bare(toks[i][2])[:3] not in {f[:3] for f in names.FAMILY}:
            return -1, -1
        if kind == "v":
            # given name first: then a family name must follow, with or without a comma, and a middle name
            if i + 1 < n and toks[i + 1][3] in ("f", "d") and free(i + 1) and toks[i + 1][2][0].isupper() and (spaced(i) or gap(i).strip() == "," and "\n\n" not in gap(i)):
                comma = "," in gap(i)
                if names.bare(toks[i][2]) not in self.vi_given and not comma:
                    return -1, -1
                j = i + 1
                while j - i < 3 and spaced(j) and syllable(j + 1) and toks[j + 1][3] != "s":
                    j += 1
                if j > i + 1:
                    normal = j - i >= 3
                    if normal and not comma:
                        return -1, -1
                    return i, j
            return -1, -1
        if kind == "d" and not (i + 1 < n and spaced(i) and (toks[i + 1][3] == "v" or toks[i + 1][3] == "i" and i + 2 < n and toks[i + 2][3] == "v")):
            return -1, -1
        j = i
        if toks[i][3] == "F" and len(re.findall(rf"[{UPPER}]", toks[i][2])) > 2:
            return i, i
        while j - i < 3 and j + 1 < n and spaced(j) and (syllable(j + 1) or toks[j + 1][3] == "i") and not toks[j][2].endswith("\0"):
            j += 1
            if toks[j][3] == "F":
                break
        if j == i:
            low = toks[i][2].islower()
            if low:
                k = i
                while k - i < 2 and k + 1 < n and spaced(k) and toks[k + 1][2].islower() and names.bare(toks[k + 1][2]) in self.vi_given:
                    k += 1
                return (i, k) if k - i == 2 else (-1, -1)
            return -1, -1
        if j - i == 3 and not (toks[j][3] == "v" and names.bare(toks[j][2]) in self.vi_given):
            j -= 1
        return i, j


#: Kinds of words that may begin a name, each a character.
HEADS = re.compile("[ghfFivd]|s(?=i)")
#: Prepositions that may also be particles of a surname, and words by which a Romance sentence shows.
PREPOSITIONS = frozenset(("de", "von", "di", "du", "del", "da"))
DOUBLE = frozenset((("van", "der"), ("van", "den"), ("van", "de"), ("von", "der"), ("de", "la"), ("de", "los"), ("de", "las")))
ROMANCE = frozenset("el la le les los las o os as un una une um uma que fue foi était documento carte pida peça merci demander et y e para pour a à se por".split())
#: Family names that are words of some language without their marks; a Vietnamese name must follow.
SHORT_FAMILY = frozenset("do le la ha ho ly ta dao cao mai lam phan dang dinh vu vo ngo doan".split())
ORG_AFTER = re.compile(r",?\s+(?:Ltd|Limited|Inc|Corp|Corporation|LLC|L\.L\.C|GmbH|S\.A|SA\b|JSC|PLC|AG\b|Co\.|Company|Group|Holding|Gesellschaft|Société)")
ORG_BEFORE = re.compile(r"(?:Công\s+ty(?:\s+(?:Cổ\s+phần|CP|TNHH))?|CTCP|Cty(?:\s+(?:CP|cổ\s+phần))?|CÔNG\s+TY(?:\s+CỔ\s+PHẦN)?|Cong\s+ty(?:\s+Co\s+phan)?)\s+$")


def _trim(token: str) -> str:
    m = INITIAL.match(token)
    if m and not token[m.end() :].strip("."):
        return m.group()
    return token if SMALL_INITIAL.fullmatch(token) else token.strip(TRAIL)


def mentions(text: str, finder: Finder) -> list[tuple[int, int, str, str, str]]:
    """(start, end, type, form, context) of each term that may be personal; :func:`disclosed` decides which are."""
    flat, starts, ends = flatten(text)
    raws = tokens(flat)
    found: list[tuple[int, int, str, str, str]] = []
    taken: list[tuple[int, int]] = []

    def take(a: int, b: int, kind: str, form: str = "", context: str = "") -> None:
        if not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            found.append((a, b, kind, form, context))

    if "@" in flat or "(" in flat or "[" in flat or "{" in flat:
        for a, b, form in emails(flat):
            take(a, b, "EMAIL_ADDRESS", form)
    if runs := [m.start() for m in RUN.finditer(flat)]:
        for a, b, form in addresses(flat, runs=runs):
            take(a, b, "FULL_ADDRESS", form)
        # a number begins with the first digit of a run, or a sign before it
        places = [i - (i > 0 and flat[i - 1] in "+(") for i in runs]
        if numbers := [m.span() for m in matches(DIGITS, flat, places) if sum(map(str.isdigit, m.group())) >= 8]:
            for form, kind in ((SSN, "US_SSN"), (PHONE, "PHONE_NUMBER"), (NATIONAL, "VN_NATIONAL_ID")):
                for x, y in numbers:
                    while x < y:
                        m = form.search(flat, x, min(len(flat), y + 8))
                        if not m or m.start() >= y:
                            break
                        x = m.end()
                        runs = [str(len(r)) for r in RUN.findall(m.group())]
                        if kind != "PHONE_NUMBER" or 8 <= sum(map(int, runs)) <= 15:
                            before = re.findall(rf"{L}+", flat[back(flat, m.start(), 3) : m.start()].lower())
                            take(*m.span(), kind, " ".join(runs), " ".join(names.bare(w) for w in before[-2:]))
    for a, b, form, first in finder.persons_in(flat, raws, taken):
        take(a, b, "PERSON", form, first)
    if starts is not None:
        found = [(starts[a], ends[b - 1], *rest) for a, b, *rest in found]
    return sorted(found)


def learn(words: DataFrame, entities: DataFrame) -> tuple[frozenset[str], ...]:
    """(given names, Vietnamese given names, words of persons' names, plain words) from corpus counts.

    A word reveals a person as strongly as the share of its occurrences that the
    entity rows list inside a PERSON. Names in first place whose share is high are
    given names; frequent words whose share is low are plain. Each list is bounded
    by a minimal share of all words.
    """

    def make():
        memo = Memo(lambda t: names.parse(t)[:2], 50_000)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                kind, ws = memo[text]
                for w in {x.strip(TRAIL + ",") for x in text.split()}:
                    seen["w", w.lower()] += 1
                if kind == "vi" and len(ws) == 3:
                    seen["v", ws[-1]] += 1
                elif kind == "" and len(ws) in (2, 3, 4) and "," not in text and len(ws[0]) > 2:
                    seen["g", ws[0]] += 1
            keys = list(seen)
            return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["what", "w", "n"])

        return step

    people = entities.where((F.col("entity_type") == "PERSON") & F.col("text_val").isNotNull()).dropDuplicates(["entity_id"]).select("text_val")
    counts = map_batches(people, make, "what string, w string, n bigint").groupBy("what", "w").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    listed = counts.where("what = 'w'").select(F.col("w").alias("key"), F.col("n").alias("named"))
    total = words.agg(F.sum("n")).first()[0] or 0
    low = words.select(F.lower(F.regexp_replace("key", "^[\\p{P}]+|[\\p{P}]+$", "")).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    usual = low.where(F.col("n") >= max(3, COMMON * total)).join(listed, "key", "left").toPandas()
    share = usual["named"].fillna(0) / usual["n"]
    persons = frozenset(usual["key"][share >= NAME_SHARE])
    plain = frozenset(usual["key"][share < NAME_SHARE]) - {""}
    people_total = max(1, counts.where("what <> 'w'").agg(F.sum("n")).first()[0] or 0)
    often = counts.where((F.col("what") != "w") & (F.col("n") >= max(2, 5e-4 * people_total))).collect()
    known = frozenset(names.short_forms())
    given = known | {r.w for r in often if r.what == "g" and len(r.w) > 3 and r.w in persons}
    vi = frozenset(r.w for r in often if r.what == "v") | VI_MIDDLE
    return given, vi, persons, plain


#: Common Vietnamese middle names, without marks.
VI_MIDDLE = frozenset("van thi minh duc huu xuan ngoc thanh quoc bich".split())


def find(df: DataFrame, finder_parts, garbled=None, noisy=None, id_col: str = "scan_id", text_col: str = "text") -> DataFrame:
    """(id, span_start, span_end, pii_type, form, context), one row per mention.

    With ``garbled`` (of :func:`encoding.train`) and ``noisy`` (of :func:`layout.train`),
    texts that problems 1 and 6 find are passed over in the same pass. Null texts give no row.
    """
    kind = dict(df.dtypes)[id_col]
    shared = df.sparkSession.sparkContext.broadcast((finder_parts, garbled, noisy))

    def make():
        parts, g, q = shared.value
        finder = Finder(*parts)
        restorer = encoding.Restorer(*g) if g else None
        repairer = layout.Repairer(*q) if q else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, rows = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if repairer:
                    tokens = text.replace("\n", " ").split(" ")
                    if repairer.is_noisy(text, tokens) or restorer.may_be_garbled(text, tokens) and restorer.restore(text)[0]:
                        continue
                got = mentions(text, finder)
                ids.extend([i] * len(got))
                rows.extend(got)
            types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            cols = list(zip(*rows)) if rows else [[]] * 5
            return pa.record_batch([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(cols, types))], names=["id", "span_start", "span_end", "pii_type", "form", "context"])

        return step

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return map_batches(rows, make, f"id {kind}, span_start int, span_end int, pii_type string, form string, context string").withColumnRenamed("id", id_col)


KINDS = ("EMAIL_ADDRESS", "PHONE_NUMBER", "VN_NATIONAL_ID", "US_SSN", "FULL_ADDRESS", "PERSON")


def information(found: DataFrame, entities: DataFrame, n_words: int, id_col: str = "scan_id") -> DataFrame:
    """(pii_type, form, context, n, bits): what the corpus says each kind of term gives away.

    The entity rows list the mentions in part. The share of a kind's mentions that
    they list estimates how likely such a term is an entity of its type: of those
    behind the same words, smoothed by those behind the last word alone, these by
    the form and that by the type. ``bits`` is its pointwise mutual information with
    the entities: how much likelier that is than for any word of the corpus. A place
    listed with several types counts for each in part; null types and places list nothing.
    """
    place = [id_col, "span_start", "span_end"]
    # the six types have a bit of their own, so no other type is taken for one of them; the others share the rest
    own = " ".join(f"WHEN '{kind}' THEN {k}" for k, kind in enumerate(KINDS))
    bit = lambda c: F.expr(f"shiftleft(1L, CASE {c} {own} ELSE CAST({len(KINDS)} + pmod(xxhash64({c}), {63 - len(KINDS)}) AS INT) END)")
    listed = entities.where(F.col("entity_type").isNotNull()).groupBy(*place).agg(F.bit_or(bit("entity_type")).alias("types"))
    told = F.when(F.col("types").bitwiseAND(bit("pii_type")) != 0, 1 / F.bit_count("types")).otherwise(0.0)
    hits = found.join(listed, place, "left").groupBy("pii_type", "form", "context").agg(F.count("*").alias("n"), F.sum(told).alias("l"))
    hits = checkpointed(hits.withColumn("last", F.element_at(F.split("context", " "), -1)))
    base = entities.where(F.col("entity_type").isin(*KINDS)).select(*place).distinct().count() / max(1, n_words)
    share = lambda n, hit, prior: (F.col(hit) + PRIOR * prior) / (F.col(n) + PRIOR)
    out = hits
    for k, keys in enumerate((["pii_type"], ["pii_type", "form"], ["pii_type", "last"])):
        out = out.join(hits.groupBy(*keys).agg(F.sum("n").alias(f"n{k}"), F.sum("l").alias(f"l{k}")), keys)
    p = F.col("l0") / F.col("n0")
    for n, hit in (("n1", "l1"), ("n2", "l2"), ("n", "l")):
        p = share(n, hit, p)
    return out.select("pii_type", "form", "context", "n", F.log2(p / max(base, 1e-12)).alias("bits"))


def disclosed(found: DataFrame, entities: DataFrame, n_words: int, id_col: str = "scan_id") -> DataFrame:
    """The mentions whose kind of term gives away at least DISCLOSED bits; these are generalised to their type.

    Kinds of term that make up SHARE of the mentions are looked up in a broadcast of
    at most 1 / SHARE rows; only the others, which are no hot keys, are joined by them.
    """
    keys = ["pii_type", "form", "context"]
    known = checkpointed(information(found, entities, n_words, id_col).withColumn("reveals", F.col("bits") >= DISCLOSED))
    often = F.col("n") >= max(2.0, SHARE * (known.agg(F.sum("n")).first()[0] or 0))
    marked = found.join(F.broadcast(known.where(often).select(*keys, "reveals")), keys, "left")
    rare = marked.where("reveals IS NULL").select(*found.columns).join(known.where(~often & F.col("reveals")).select(*keys), keys, "left_semi")
    return marked.where("reveals").select(*found.columns).unionByName(rare.select(*found.columns))


def masked(df: DataFrame, kept: DataFrame, id_col: str = "scan_id", text_col: str = "text") -> DataFrame:
    """(id, masked) of the texts with a mention: ``<TYPE>`` in place of each, otherwise unchanged."""
    kind = dict(df.dtypes)[id_col]
    spans = kept.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end", "pii_type"))).alias("spans"))
    rows = df.select(id_col, F.col(text_col).alias("text")).join(spans, id_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for s in todo:
                    parts += (text[at : s["span_start"]], f"<{s['pii_type']}>")
                    at = s["span_end"]
                out.append("".join(parts) + text[at:])
            return pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["id", "masked"])

        return step

    return map_batches(rows, make, f"id {kind}, masked string").withColumnRenamed("id", id_col)
