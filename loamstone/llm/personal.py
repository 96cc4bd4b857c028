"""Personal information in free text: e-mail and street addresses, phone and identity numbers, names.

Texts are normalised by small transducers that keep, for every character they put out, the stretch of
source it came from: width and compatibility forms, invisible characters, letters of other scripts that look
Latin inside a Latin word, digits spelled out in a row, and at/dot disguises. Identifiers are detected in the
normalised text and their spans mapped back, so that the source stays as it is around its placeholders.

Names are learnt from the column itself: words after cues such as a signature or a form of address are counted
against all their occurrences, over the whole data, in count-min tables of fixed size.

Defined results: NULL and empty texts hold nothing and come out unchanged; repeated rows of a key count
once; where matches overlap, the earlier type in ``TYPES`` holds. A street address is looked for in the seven words before
and the eight after a word that tells one, an e-mail address in the whole word around its sign; phone numbers have 9 to 16 digits, or 7 on
with a plus sign or a cue, as have spelled ones. A name that no cue of the column
goes before isn't learnt (``CUED``).
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions
from loamstone.plans.tables import spread

TYPES = ("email", "street_address", "phone", "id_number", "name")
BUCKETS = 1 << 20
_CHUNK = 400
_ANY_WORD = re.compile(r"[^\W\d_]+")
#: Times a word must follow a cue to count as a name, and the least share of its occurrences that do; the fewer cues, the larger the share.
CUED = ((3, 0.12), (2, 0.2), (1, 0.34))
#: A word this frequent (per million words) is no unknown surname.
COMMON_PER_MILLION = 12.0

# ---- transducers ---------------------------------------------------------------------------------------

# Letters that look like Latin ones.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһɡАВЕКМНОРСТХІЈЅαοιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhgABEKMHOPCTXIJSaoiABEZHIKMNOPTYX"))
_INVISIBLE = "​‌‍⁠﻿­"
# Digits spelled out.
_SPELLED = {w: str(i) for ws in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(ws.split())} | {"oh": "0", "zwo": "2"}
_SPELLED_RUN = re.compile(rf"(?i)\b(?:{'|'.join(sorted(_SPELLED, key=len, reverse=True))})(?:[\s,\-]+(?:{'|'.join(sorted(_SPELLED, key=len, reverse=True))})\b){{5,}}")
_AT = r"(?:\s*[\(\[\{<]\s*(?:at|@|arroba|ät|klammeraffe|arobase)\s*[\)\]\}>]\s*|\s+(?:at|arroba|arobase|\(a\))\s+|\s*＠\s*|&#64;|&commat;)"
_DOT = r"(?:\s*[\(\[\{<]\s*(?:dot|punkt|punto|point|\.)\s*[\)\]\}>]\s*|\s+(?:dot|punkt|punto|point)\s+)"
_HIDDEN_MAIL = re.compile(rf"(?i)(?<![\w.+\-])[\w.+\-]+(?:{_DOT}[\w+\-]+)*(?P<at>{_AT}|@)[\w\-]+(?:(?:{_DOT}|\.)[\w\-]+)+")
_AT_ONLY, _DOT_ONLY = re.compile(rf"(?i){_AT}"), re.compile(rf"(?i){_DOT}")
# cheap signs that a text needs the transducers at all
_BRACKETED = re.compile(r"(?i)[\(\[\{<]\s*(?:at|@|dot|arroba|punto|punkt|point|ät|arobase|klammeraffe|a|\.)\s*[\)\]\}>]|&#64;|&commat;")
_ODD = re.compile(rf"[{_INVISIBLE}\u00a0\u2000-\u200a\u202f\u2070-\u2089\u2460-\u2473\uff01-\uff5e\U0001d400-\U0001d7ff]+")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f]+")
_DOT_WORD = r"\s(?:dot|punkt|punto|point)\s"
_AT_WORD = re.compile(rf"(?i)\s(?:at|arroba|arobase|\(a\))\s+[\w\-]+(?:\s*{_DOT_WORD}|\s*[\(\[\{{<]|\.\w)")
# a bare dot word after or before an at sign
_DOT_AFTER, _DOT_BEFORE = re.compile(rf"(?i)@[\w\-]+(?:\.[\w\-]+)*\s*{_DOT_WORD}"), re.compile(rf"(?i){_DOT_WORD}\s*[\w+\-]+$")


def _signs(s: str, low: str) -> Iterator[int]:
    """Places that may need normalising, spelled digits aside."""
    for p in (_BRACKETED, _ODD):
        for m in p.finditer(s):
            yield m.start()
    for m in _OTHER_SCRIPT.finditer(s):
        if re.match(r"[A-Za-z]", s[m.start() - 1 : m.start()] or " ") or re.match(r"[A-Za-z@]", s[m.end() : m.end() + 1]):
            yield m.start()
    for w in ("at", "arroba", "arobase", "(a)"):
        for a, b in itertools.product(" \n\t", repeat=2):
            i = low.find(a + w + b)
            while i >= 0:
                if _AT_WORD.match(s, i):
                    yield i
                i = low.find(a + w + b, i + 1)
    i = low.find("@")
    while i >= 0:
        if _DOT_AFTER.match(s, i) or _DOT_BEFORE.search(s[_back(s, i, 3) : i]):
            yield i
        i = low.find("@", i + 1)


def _back(s: str, i: int, words: int) -> int:
    """Where the ``words`` words before place ``i`` begin; a NUL ends a text."""
    first = s.rfind("\x00", 0, i) + 1
    for _ in range(words):
        while i > first and s[i - 1].isspace():
            i -= 1
        j = max(s.rfind(" ", first, i), s.rfind("\n", first, i), s.rfind("\t", first, i))
        if j < 0:
            return first
        i = j
    return i


def _ahead(s: str, i: int, words: int) -> int:
    """Where the ``words`` words from place ``i`` on end."""
    last = s.find("\x00", i)
    last = len(s) if last < 0 else last
    for _ in range(words):
        m = _WORD_AHEAD.match(s, i, last)
        if not m:
            return last
        i = m.end()
    return i


_WORD_AHEAD = re.compile(r"\s*[^\s\x00]+")


_DIGIT_WORDS = frozenset(_SPELLED)


def _spelled(low: str) -> bool:
    """Whether ``_SPELLED_RUN`` may match: four digit words in a row, as other signs may be at the first and the last of six."""
    return b"\x01" * 4 in bytes(map(_DIGIT_WORDS.__contains__, low.replace("\x00", " \x00 ").replace("-", " ").replace(",", " ").split()))


def _tokens(low: str) -> list[str]:
    return low.replace("\x00", " \x00 ").split(" ") if "\t" not in low and "\n" not in low else low.replace("\x00", " \x00 ").split()


def _distinct(tokens: list[str]) -> list[str]:
    """The distinct words in tokens; punctuation is taken off each distinct token once."""
    return list({w for t in set(tokens) for w in _ANY_WORD.findall(t)})


def normalise(text: str) -> tuple[str, np.ndarray | None]:
    """The text as detectors read it, and for each of its characters the source position (one more at the end); None for identity."""
    low = text.lower()
    spelled = _spelled(low) and _SPELLED_RUN.search(text)
    if not spelled and next(_signs(text, low if len(low) == len(text) else text), None) is None:
        return text, None
    out: list[str] = []
    src: list[int] = []
    plain = not _ODD.search(text) and not _OTHER_SCRIPT.search(text)
    if plain:
        out, src = [text], list(range(len(text)))
    for i, c in enumerate(text if not plain else ""):
        if c in _INVISIBLE:
            continue
        d = unicodedata.normalize("NFKC", c) if ord(c) >= 128 and not c.isalpha() or ord(c) > 0x2000 else c
        if c in _LOOKALIKE and (re.match(r"[A-Za-z@.]", text[i - 1 : i] or " ") or re.match(r"[A-Za-z@]", text[i + 1 : i + 2] or " ")):
            d = _LOOKALIKE[c]
        out += d
        src += [i] * len(d)
    s = "".join(out)
    src.append(len(text))

    def rewrite(pattern: re.Pattern[str], put) -> None:
        nonlocal s, src
        made, at, where = [], 0, []
        for m in pattern.finditer(s):
            pieces = put(m)
            made.append(s[at : m.start()])
            where += src[at : m.start()]
            for a, b, t in pieces:
                made.append(t)
                where += [src[a + min(k, b - a - 1)] if t == s[a:b] else src[a] for k in range(len(t))]
            at = m.end()
        made.append(s[at:])
        s, src = "".join(made), where + src[at:]

    def digits(m: re.Match[str]) -> list[tuple[int, int, str]]:
        found = list(re.finditer(r"\w+", m[0]))
        n = len(found)
        # numbers of the usual lengths are set in the usual groups, others as international ones, unless they are said to be an identity
        gaps = {11: {2: " ", 6: " "}, 10: {2: "-", 5: "-"}}.get(n, {}) if n != 11 or _SPELLED[found[0][0].lower()] == "0" else {}
        sign = ""
        if 7 <= n <= 15 and not gaps and not any(_ID_CUE.match(f"{x.group()} 12345678") for x in re.finditer(r"[^\W\d_][^\d\x00]*$", s[_back(s, m.start(), 4) : m.start()].rstrip(" :=#.-"))):
            sign, gaps = "+", {i: " " for i in range(1, n - 2, 4)}
        return [(m.start() + w.start(), m.start() + w.end(), (sign if not i else "") + _SPELLED[w[0].lower()] + gaps.get(i, "")) for i, w in enumerate(found)]

    def mail(m: re.Match[str]) -> list[tuple[int, int, str]]:
        pieces, at = [], m.start()
        marks = sorted([(x.start(), x.end(), ".") for x in _DOT_ONLY.finditer(s, m.start(), m.end())] + [(m.start("at"), m.end("at"), "@")])
        for a, b, t in marks:
            if a < at:
                continue
            if a > at:
                pieces.append((at, a, s[at:a]))
            pieces.append((a, b, t))
            at = b
        if at < m.end():
            pieces.append((at, m.end(), s[at : m.end()]))
        return pieces

    if spelled:
        rewrite(_SPELLED_RUN, digits)
    rewrite(_HIDDEN_MAIL, mail)
    return s, np.array(src)


# ---- detectors -----------------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+\-])[\w](?:[\w.+\-']*[\w+\-])?@(?:[\w](?:[\w\-]*[\w])?\.)+[^\W\d_]{2,24}(?![\w@])")
_LEFT, _RIGHT = r"(?<![\w\-./+])", r"(?![\w]|[\-./]\d)"
_PHONE = re.compile(
    rf"(?<![\w\-/+])(?<!\d\.)(?:\+\d{{1,3}}(?:[\s.\-/]?\(?\d{{1,5}}\)?){{2,6}}|00[1-9]\d(?:[ .\-/]?\d{{1,8}}){{2,5}}"
    rf"|(?:1[\-. ])?(?:\(\d{{3}}\)[ ]?|\d{{3}}[\-. ])\d{{3}}[\-. ]\d{{4}}(?:\s?(?:ext\.?|x|Durchwahl)\s?\d{{1,5}})?"
    rf"|0\d(?:[ .]\d\d){{4}}|\(?0\d{{2,4}}\)?[ ]?[/\-][ ]?\d{{4,8}}(?:-\d{{1,4}})?|0\d\d \d{{4}} \d{{4}}|0\d{{3,4}} \d{{5,7}}){_RIGHT}"
)
_PHONE_CUE = re.compile(r"(?i)\b(?:tel(?:efon|ephone|éfono|\.)?|tél|phone|mobile|móvil|handy|fax|fon|whatsapp)\b[\w.]{0,6}[ :.]{0,3}(?P<v>\+?\(?\d[\d ().\-/]{5,18}\d)(?![\w])")
_ID = re.compile(
    rf"{_LEFT}(?:\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}} \d{{2}} \d{{4}}|[A-Z]{{2}} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{{2}}\d{{7}}|\d\d[A-Z]{{2}}\d{{5}}|[A-Z]\d[A-Z]\d\d[A-Z]\d{{3}}|\d{{8}}-?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z]"
    rf"|[12] \d\d (?:0[1-9]|1\d|[2-9]\d) \d[\dAB] \d{{3}} \d{{3}} \d\d|[12]\d{{14}}|\d\d \d{{3}} \d{{3}} \d{{3}}){_RIGHT}"
)
# Words that announce an identity number.
_ID_CUE = re.compile(
    r"(?i)(?<![^\W_])(?:ssn|social security(?: number| no\.?)?|passport(?: number| no\.?)?|national identity(?: number| no\.?)?|identity (?:number|card)|id(?: no\.?| number|-nr\.?)?|doc|steuer-?id(?:entifikationsnummer)?|personalausweis(?:-?nr\.?|nummer)?|reisepass(?:-?nr\.?)?|sozialversicherungsnummer"
    r"|carte d.identité|(?:numéro de )?sécurité sociale|nir|passeport|dni|nie|nif|(?:número de )?identidad|documento|pasaporte|insurance number|nino)\b[ :=#.\-]{0,4}(?:(?:is|lautet|es|est|n[°º]|no\.?|nr\.?|nummer|number)[ :]{0,3})?(?P<v>(?-i:[A-Z]{0,2}[ \-]?\d[\dA-Z]*(?:[ \-](?:\d[\dA-Z]*|[A-D](?![\w]))){0,7}))(?![\w])"
)
_CAP = r"[A-ZÀ-ÖØ-Þ][\w’'\-]+"
_STREET = re.compile(
    rf"(?<![\w])(?:"
    # English
    rf"(?:(?:[Uu]nit|UNIT|[Ff]lat|FLAT) \d{{1,4}}, )?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|STREET|St\.|Avenue|AVENUE|Ave\.?|AVE\.?|Road|ROAD|Rd\.|Lane|LANE|Close|CLOSE|Court|COURT|Drive|Boulevard|Blvd\.?|Place|Square|Terrace|Crescent)(?![\w])(?:, (?:Flat|FLAT|Apt\.?|APT\.?|Suite|Unit) ?\w+)?"
    rf"|\d{{1,5}}[A-Za-z]? (?:[\w’'\-]+ ){{1,2}}(?i:street|avenue|ave\.|road|lane)(?![\w]), (?i:flat|apt\.?|suite|unit) ?\w+"
    rf"|(?:[Uu]nit|UNIT) \d{{1,4}}, \d{{1,5}} [\w’'\-]+ (?i:close|lane|street|court)(?![\w])"
    rf"|\d{{1,5}} (?i:old) [\w’'\-]+ (?i:road|lane|street)(?![\w])"
    rf"|[Pp]\.? ?[Oo]\.? ?(?i:box) \d{{1,6}}(?:, [\w’'\-]+ (?i:court|house|road|street|lane) \d{{1,4}})?"
    # German
    rf"|[A-ZÄÖÜ][\w\-]*(?i:straße|strasse|str\.|weg|platz|allee|gasse|ufer)[ ]\d{{1,4}} ?[a-zA-Z]?(?![\w])"
    rf"|(?i:[a-zäöü\-]{{3,}}(?:straße|strasse|str\.)) ?\d{{1,4}} ?[a-z]?(?![\w])"
    # French
    rf"|\d{{1,4}}(?: ?(?:bis|ter|BIS|TER))?,? (?i:rue|avenue|av\.|boulevard|bd|impasse|place|chemin|allée|quai|route) (?:(?i:de la|de l[’']|du|des|de|d[’']) ?)?[A-ZÀ-Öa-z][\w’'\-]+"
    # Spanish
    rf"|(?i:calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda) (?:(?i:del|de la|de) )?[\w’'\-]+,? (?:(?i:n\.?º|núm\.) ?)?\d{{1,4}}(?![\w])(?:, \d+\.?º(?: \w)?)?"
    rf")"
)
_WORD = r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*"
# What comes before a person's name.
_NAME_CUE = re.compile(
    rf"(?:(?i:\b(?:signed|signé|firmado|gez\.|gezeichnet|unterzeichnet|inspector|prüfer|inspecteur|vérificateur|contact|kontakt|holder|inhaber|titulaire|titular|author)\b\"?\s?[:=]?\s?\"?|\bmy name is |\bmein name ist |\bje m[’']appelle |\bme llamo |\bich heiße |\bmi nombre es |\bmon nom est )|\b(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Sr|Sra|Mme)\.? |\b(?:señora|señor|Frau|Herrn?|Madame|Monsieur) |\bDemandez à M(?:me)?\.? )"
    rf"(?P<a>{_WORD}|[A-Z]\.)(?P<s>,? )(?:(?P<i>[A-Za-z]\. ))?(?P<b>{_WORD})"
)


def _hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    h = pd.util.hash_array(np.array(words, dtype=object))
    return (h % np.uint64(BUCKETS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


# The literals that the cues above begin with; a literal is searched far faster than the whole pattern.
_NAME_LITERALS = ("signed", "signé", "firmado", "gez.", "gezeichnet", "unterzeichnet", "inspector", "prüfer", "inspecteur", "vérificateur", "contact", "kontakt", "holder", "inhaber", "titula", "author", "my name is", "mein name ist", "je m’appelle", "je m'appelle", "me llamo", "ich heiße", "mi nombre es", "mon nom est", "dr. ", "dr ", "mr. ", "mr ", "mrs. ", "mrs ", "ms. ", "ms ", "prof. ", "prof ", "herr ", "herr. ", "herrn ", "frau ", "frau. ", "sr. ", "sr ", "sra. ", "sra ", "mme ", "mme. ", "señora ", "señor ", "madame ", "monsieur ", "demandez à m")
_ID_LITERALS = ("ssn", "social security", "passport", "identity", "id ", "id:", "id=", "id.", "id#", "id-", "doc ", "doc=", "doc:", "doc.", "doc#", "doc-", "steuer", "personalausweis", "reisepass", "sozialversicherung", "carte d", "sécurité sociale", "numéro de s", "nir", "passeport", "dni", "nie", "nif", "número de id", "identidad", "documento", "pasaporte", "insurance number", "nino")
_PHONE_LITERALS = ("tel", "tél", "phone", "mobile", "móvil", "handy", "fax", "fon", "whatsapp")
_STREET_LITERALS = ("street", " st.", "avenue", " ave", "road", " rd.", " lane", " close", " court", " drive", "boulevard", "blvd", " square", "terrace", "crescent", " place", "box ", "straße", "strasse", "str.", "str ", "weg ", "platz ", "allee ", "gasse ", "ufer ", "rue ", "av. ", "bd ", "impasse", "place ", "chemin", "allée", "quai ", "route ", "calle ", "c/", "avda", "avenida", "plaza", "paseo", "camino", "ronda")
_NUMBERISH = re.compile(r"\d[\dA-Z\s().\-/+]{5,}")


def _lower(s: str) -> str:
    low = s.lower()
    return low if len(low) == len(s) else "".join(c if len(c.lower()) != 1 else c.lower() for c in s)


def _places(low: str, literals: tuple[str, ...] | list[str], bounded: bool = False) -> list[int]:
    """Where any of the literals begins, ascending; ``bounded``: only at the start of a word."""
    out = []
    for w in literals:
        i = low.find(w)
        while i >= 0:
            if not bounded or not i or not (low[i - 1].isalnum() or low[i - 1] == "_"):
                out.append(i)
            i = low.find(w, i + 1)
    return sorted(set(out))


@functools.cache
def _automaton():
    """All fixed literals in one automaton, each with its groups: (group, length, only at the start of a word)."""
    import ahocorasick

    found: dict[str, list[tuple[str, int, bool]]] = {}
    for group, literals, bounded in (("name", _NAME_LITERALS, True), ("id", _ID_LITERALS, False), ("phone", _PHONE_LITERALS, True), ("street", _STREET_LITERALS, False), ("at", ("@",), False)):
        for w in literals:
            found.setdefault(w, []).append((group, len(w), bounded))
    a = ahocorasick.Automaton()
    for w, v in found.items():
        a.add_word(w, v)
    a.make_automaton()
    return a


def _literal_places(low: str) -> dict[str, list[int]]:
    """Where the literals of each group begin, ascending."""
    out: dict[str, set[int]] = {g: set() for g in ("name", "id", "phone", "street", "at")}
    for end, groups in _automaton().iter(low):
        for g, n, bounded in groups:
            i = end - n + 1
            if not bounded or not i or not (low[i - 1].isalnum() or low[i - 1] == "_"):
                out[g].add(i)
    return {g: sorted(x) for g, x in out.items()}


def _windows(s: str, places: list[int], before: int, after: int) -> list[tuple[int, int]]:
    """Stretches of whole words around the places: so many before it and after it."""
    out: list[list[int]] = []
    for i in places:
        if out and i < out[-1][2]:
            continue  # in the same word as the place before
        a, b = _back(s, i, before), _ahead(s, i, after)
        if out and a <= out[-1][1]:
            out[-1][1], out[-1][2] = max(b, out[-1][1]), _ahead(s, i, 1)
        else:
            out.append([a, b, _ahead(s, i, 1)])
    return [(a, b) for a, b, _ in out]


def _cue_matches(s: str, places: list[int]) -> Iterator[re.Match[str]]:
    for i in places:
        m = _NAME_CUE.match(s, i)
        if m:
            yield m


def _cued(s: str, places: list[int]) -> Iterator[tuple[str, str]]:
    """(given, family) of every cue that two words, or an initial and a word, follow."""
    for m in _cue_matches(s, places):
        a, b = m["a"], m["b"]
        if m["s"] == ", ":
            a, b = b, a
        if a[:1].isupper() == b[:1].isupper() and (len(a) > 2 or a.endswith(".")) and len(b) > 2:
            yield a, b


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(6 * BUCKETS, np.int64)  # all words, given names, family names; two tables each
    counts: list[Counter[str]] = [Counter(), Counter(), Counter()]

    tally: Counter[str] = Counter()

    def flush() -> None:
        for t, k in tally.items():
            for w in _ANY_WORD.findall(t):
                counts[0][w] += k
        tally.clear()
        for j, n in enumerate(counts):
            if n:
                a, b = _hashes(list(n))
                v = np.fromiter(n.values(), np.int64, len(n))
                np.add.at(total, a + 2 * j * BUCKETS, v)
                np.add.at(total, b + (2 * j + 1) * BUCKETS, v)
                n.clear()

    for pdf in batches:
        texts = pdf["t"].tolist()
        for lo, hi in portions(list(map(len, texts)), _CHUNK):
            s = "\x00".join(texts[lo:hi])
            low = _lower(s)
            tally.update(_tokens(low))
            for a, b in _cued(s, _literal_places(low)["name"]):
                if not a.endswith("."):
                    counts[1][a.lower()] += 1
                counts[2][b.lower()] += 1
        if len(tally) > 400_000:
            flush()
    flush()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


class Names:
    """What the column's words say of being names."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.common = max(4.0, COMMON_PER_MILLION * float(table[:BUCKETS].sum()) / 1e6)
        self._memo: dict[str, tuple[bool, bool, bool]] = {}

    def _get(self, words: list[str], j: int) -> np.ndarray:
        a, b = _hashes(words)
        return np.minimum(self.table[a + 2 * j * BUCKETS], self.table[b + (2 * j + 1) * BUCKETS])

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self._memo]
        if len(self._memo) > 500_000:
            self._memo.clear()
            new = words
        if new:
            n, g, f = (self._get(new, j) for j in range(3))
            given, family = (np.logical_or.reduce([(c >= k) & (c >= share * n) for k, share in CUED]) for c in (g, f))
            for w, *x in zip(new, given.tolist(), family.tolist(), (n <= self.common).tolist()):
                self._memo[w] = tuple(x)

    def given(self, w: str) -> bool:
        return self._memo.get(w, (False, False, False))[0]

    def family(self, w: str) -> bool:
        return self._memo.get(w, (False, False, False))[1]

    def rare(self, w: str) -> bool:
        return self._memo.get(w, (False, False, True))[2]


_GIVEN_FIRST = re.compile(rf"(?P<g>{_WORD}) (?:(?:[A-Z]|[a-z](?=\. [a-z]))\. ?)?(?P<b>{_WORD})(?![\w@])")
_GIVEN_INITIAL = re.compile(rf"(?P<g>{_WORD}) [A-Z]\.?(?= ?[\(\)|\"\n\x00;,]|$)")
_FAMILY_BEFORE = re.compile(rf"(?<![\w.@+\-])(?P<b>{_WORD}), $")
_INITIAL_BEFORE = re.compile(r"(?<![\w.@+\-])[A-Z]\. ?$")


def _names(s: str, low: str, words: list[str], names: Names, cues: list[int]) -> Iterator[tuple[int, int]]:
    names.learn(words)

    def family_like(b: str) -> bool:
        return len(b) > 2 and (names.family(b.lower()) or names.rare(b.lower()) and b[0].isupper() and not names.given(b.lower()))

    for g in (w for w in words if names.given(w)):
        for i in _places(low, [g], True):
            e = i + len(g)
            if s[i - 1 : i] in (".", "@", "+", "-") and i or s[e : e + 1].isalnum() or s[e : e + 1] in ("@", "_"):
                continue
            m = _GIVEN_FIRST.match(s, i)
            if m and m.end("g") == e:
                b = m["b"]
                lower = s[i].islower() and b[0].islower() and names.rare(b.lower()) and len(b) > 3
                if s[i].isupper() == b[0].isupper() and (family_like(b) or lower):
                    yield m.span()
                    continue
            m = _GIVEN_INITIAL.match(s, i)
            if m and m.end("g") == e and s[i].isupper():
                yield m.span()
            m = _FAMILY_BEFORE.search(s, _back(s, i, 1), i) if s[i - 2 : i] == ", " else None
            if m and m.end() == i and (family_like(m["b"]) or names.family(m["b"].lower())):
                yield m.start("b"), e
    for f in (w for w in words if names.family(w)):
        for i in _places(low, [f], True):
            e = i + len(f)
            m = _INITIAL_BEFORE.search(s, max(0, i - 4), i)
            if m and not s[e : e + 1].isalnum() and s[e : e + 1] != "@":
                yield m.start(), e
    for m in _cue_matches(s, cues):
        a, b = m["a"], m["b"]
        x, y = (b, a) if m["s"] == ", " else (a, b)
        known = names.given(x.lower()) or x.endswith(".")
        if (known and len(y) > 2 and (names.family(y.lower()) or names.rare(y.lower()))) or (names.family(y.lower()) and names.rare(x.lower())):
            yield m.start("a"), m.end("b")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def detect(s: str, low: str, words: list[str], names: Names) -> list[tuple[int, int, str]]:
    """Spans of a normalised text (or of several, joined by NUL), without overlaps. ``words``: its distinct words."""
    n = len(s)
    found: list[tuple[int, int, str]] = []
    places = _literal_places(low)

    def within(pattern: re.Pattern[str], windows: list[tuple[int, int]]) -> Iterator[re.Match[str]]:
        for a, b in windows:
            yield from pattern.finditer(s, a, b)

    found += [(*m.span(), "email") for m in within(_EMAIL, _windows(s, places["at"], 1, 1))]
    found += [(*m.span(), "street_address") for m in within(_STREET, _windows(s, places["street"], 7, 8))]
    for i in places["id"]:
        m = _ID_CUE.match(s, i)
        if m and (not m.start() or not s[m.start() - 1].isalnum()) and 7 <= sum(c.isalnum() for c in m["v"]) <= 18 and _digits(m["v"]) >= 5 and not _PHONE.fullmatch(m["v"].strip()):
            found.append((*m.span("v"), "id_number"))
    numbers = [(max(0, m.start() - 6), min(n, m.end() + 20)) for m in _NUMBERISH.finditer(s) if _digits(m[0]) >= 5]
    for m in within(_PHONE, numbers):
        if (7 if m[0][0] == "+" else 9) <= _digits(m[0]) <= 16:
            a, b = m.span()
            if m[0].count(")") > m[0].count("("):
                b = a + m[0].rindex(")")
            elif m[0].count("(") > m[0].count(")"):
                a += m[0].index("(") + 1
            found.append((a, b, "phone"))
    for i in places["phone"]:
        m = _PHONE_CUE.match(s, i)
        if m and 7 <= _digits(m["v"]) <= 15:
            found.append((*m.span("v"), "phone"))
    found += [(*m.span(), "id_number") for m in within(_ID, numbers)]
    found += [(a, b, "name") for a, b in _names(s, low, words, names, places["name"])]
    rank = {t: i for i, t in enumerate(TYPES)}
    taken: list[tuple[int, int, str]] = []
    busy = bytearray(n + 1)
    for a, b, t in sorted(found, key=lambda f: (rank[f[2]], f[0], -f[1])):
        if not any(busy[a:b]):
            busy[a:b] = b"\x01" * (b - a)
            taken.append((a, b, t))
    return sorted(taken)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, t in spans:
        out += [text[at:a], f"[{t.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def find_in(texts: list[str], names: Names) -> list[list[tuple[int, int, str]]]:
    """Spans in source positions, of each text."""
    s = "\x00".join(texts)
    low = _lower(s)
    normal: list[tuple[str, np.ndarray | None]] = [(t, None) for t in texts]
    ends = np.cumsum([len(t) + 1 for t in texts])
    odd = range(len(texts)) if _spelled(low) else np.unique(np.searchsorted(ends, np.fromiter(_signs(s, low), np.int64), "right")).tolist()
    if odd:
        for i in odd:
            normal[i] = normalise(texts[i])
        s = "\x00".join(t for t, _ in normal)
        low = _lower(s)
    tokens = _tokens(low)
    starts = np.cumsum([0, *(len(t) + 1 for t, _ in normal)])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for a, b, t in detect(s, low, _distinct(tokens), names):
        i = int(np.searchsorted(starts, a, "right")) - 1
        src = normal[i][1]
        x, y = int(a - starts[i]), int(b - starts[i])
        if src is not None:
            x, y = int(src[x]), int(src[y - 1]) + 1 if y < len(src) and src[y] <= src[y - 1] + 1 else int(src[y])
        out[i].append((x, y, t))
    return out


def _find(table: np.ndarray, texts: bool):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names(table)
        for pdf in batches:
            keys, fields, values = pdf["k"].tolist(), pdf["field"].tolist(), pdf["t"].tolist()
            out = []
            for lo, hi in portions(list(map(len, values)), _CHUNK):
                part = values[lo:hi]
                for i, spans in enumerate(find_in(part, names)):
                    if spans:
                        k, f = keys[lo + i], fields[lo + i]
                        if texts:
                            out.append((k, f, sorted({t for _, _, t in spans}), len(spans), mask(part[i], spans)))
                        else:
                            out += [(k, f, t) for t in sorted({t for _, _, t in spans})]
            yield pd.DataFrame(out, columns=["k", "field", "types", "n_items", "masked_text"] if texts else ["k", "field", "pii_type"])

    return go


def name_table(rows: DataFrame) -> np.ndarray:
    """Count-min tables of the words of column ``t`` (six times ``BUCKETS`` sums at most reach the driver)."""
    table = np.zeros(6 * BUCKETS, np.int32)
    got = rows.select("t").mapInPandas(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table[got["bucket"].to_numpy().astype(np.int64)] = np.minimum(got["n"].to_numpy().astype(np.int64), 2**31 - 1)
    return table


def long_form(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(k, field, t) of every non-empty text."""
    parts = [df.where(F.col(key).isNotNull() & (F.length(f) > 0)).select(F.col(key).cast("string").alias("k"), F.lit(f).alias("field"), F.col(f).alias("t")) for f in fields]
    out = spread(parts[0])
    for p in parts[1:]:
        out = out.unionByName(spread(p))
    return out


def personal_types(rows: DataFrame) -> DataFrame:
    """(k, field, pii_type), distinct, for the rows (k, field, t)."""
    return rows.mapInPandas(_find(name_table(rows), False), "k string, field string, pii_type string").distinct()


def masked(rows: DataFrame) -> DataFrame:
    """(k, field, types, n_items, masked_text) of every text that holds something, with typed placeholders."""
    return rows.mapInPandas(_find(name_table(rows), True), "k string, field string, types array<string>, n_items int, masked_text string").dropDuplicates(["k", "field"])
