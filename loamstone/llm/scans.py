"""Repairing text from scanned pages with averaged perceptrons.

Three parts, all trained here on a bounded sample (``TRAIN_ROWS`` texts, least hash of the key first):

* furniture: lines that may be a running header or a page number by their form are told from text by a perceptron
  over their wording, their place on the page (lines above and below, width beside the others) and whether the sentence around them runs on;
* line joins: a perceptron chooses between joining the halves of a word and keeping the mark as its hyphen;
* letters: a structured perceptron scores edit sequences (keep, or replace a read unit by the letters it
  may stand for, which covers deletion and insertion) for words that the column hardly holds, against
  word counts of the whole column; keeping a word has a score of its own, digits or not.

Word counts are kept in a count-min table of fixed size; equal lines of the column count once. ``confidence`` is a rough hint only and decides
nothing by itself.

Defined results: NULL or empty texts have no noise and stay as they are; repeated rows of a key count once;
texts without line breaks can hold misread words only. Tables and code are no running text and stay as they are, as their lines
and signs mean something. Not tried are words of more than ``_LONGEST`` letters, or of more errors than ``edits`` allows
(two, and one more for each digit or sign in the word up to five), and headers of over 120 characters.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions
from loamstone.plans.tables import spread

TRAIN_ROWS = 3000
BUCKETS = 1 << 20
#: A word this frequent (per million words of the column) is taken as read.
USUAL_PER_MILLION = 40.0
#: How many times as frequent as the word itself a correction must be to be scored at all.
RATIO = 2
_LONGEST = 40

# What a reader may put for which letters, read unit first.
CONFUSIONS = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("6", "g"), ("4", "a"), ("3", "e"), ("7", "t"), ("2", "z"),
    ("c", "e"), ("e", "c"), ("l", "i"), ("i", "l"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("l", "t"), ("!", "l"), ("|", "l"), ("$", "s"), ("ii", "u"), ("ll", "u"), ("li", "u"), ("il", "u"), ("cl", "d"), ("c1", "d"), ("d", "cl"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("n", "ri"), ("ri", "n"), ("li", "h"), ("h", "li"), ("in", "m"), ("m", "in"), ("nn", "m"), ("fi", "h"), ("ß", "b"), ("b", "ß"),
)
_CONFUSIONS = [(a, b) for a, b in CONFUSIONS if not b.isdigit()]
_BY_FIRST: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _a, _b in _CONFUSIONS:
    _BY_FIRST[_a[0]].append((_a, _b))
_FOLD = str.maketrans("015983", "olsgbe")

# signs that a wrong encoding leaves inside words count as part of them, so that no half is taken for a word
_TOKEN = re.compile(r"(?:[^\W_]|[^\x00-\x7f\s–—“”„‘’«»…°·•])+(?:[!|$][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_MARKED = re.compile(r"([^\W\d_](?:[^\W_]|[-’'])*|[^\W_])([-‐¬\xad]) ?$")
_MARKS = frozenset("-‐¬\xad")
_TAIL = re.compile(r"[^\W_]+(?:-[^\W_]+)*$")
_HALF = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def _hashes(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    h = pd.util.hash_array(np.array(list(words), dtype=object))
    return (h % np.uint64(BUCKETS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n: Counter[str] = Counter()
    total = np.zeros(2 * BUCKETS, np.int64)

    def flush() -> None:
        if n:
            a, b = _hashes(n)
            v = np.fromiter(n.values(), np.int64, len(n))
            np.add.at(total, a, v)
            np.add.at(total, b + BUCKETS, v)
            n.clear()

    for pdf in batches:
        for t in pdf["t"]:
            n.update(_LETTERS.findall(t.lower()))
        if len(n) > 500_000:
            flush()
    flush()
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


class Lexicon:
    """Count-min table of the column's words."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.words = max(1, int(table[:BUCKETS].sum()))
        self.usual = max(3.0, USUAL_PER_MILLION * self.words / 1e6)

    def counts(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.int64)
        a, b = _hashes(words)
        return np.minimum(self.table[a], self.table[b + BUCKETS])


class Perceptron:
    """Averaged perceptron over sparse features; weights are averaged over all steps."""

    def __init__(self) -> None:
        self.w: dict[object, float] = defaultdict(float)
        self._sum: dict[object, float] = defaultdict(float)
        self._step = 0

    def score(self, features: Iterable[object]) -> float:
        return sum(self.w.get(f, 0.0) for f in features)

    def update(self, right: Iterable[object], wrong: Iterable[object]) -> None:
        for fs, v in ((right, 1.0), (wrong, -1.0)):
            for f in fs:
                self.w[f] += v
                self._sum[f] += v * self._step

    def tick(self) -> None:
        self._step += 1

    def averaged(self) -> dict[object, float]:
        n = max(1, self._step)
        return {f: v - self._sum[f] / n for f, v in self.w.items() if v or self._sum[f]}


# ---- letters -------------------------------------------------------------------------------------------


def edits(word: str, most: int = 2) -> dict[str, tuple[tuple[int, str, str], ...]]:
    """Words that ``word`` may stand for, with the edits that lead there, in up to ``most`` edits."""
    out: dict[str, tuple[tuple[int, str, str], ...]] = {word: ()}
    states = [("", 0, ())]
    done: list[tuple[str, tuple[tuple[int, str, str], ...]]] = []
    n = len(word)
    digits = sum(c.isdigit() or c in "!|$" for c in word)
    most = max(most, min(digits + 1, 5)) if n <= 16 else max(2, min(digits + 1, 4))
    frontier: list[tuple[str, int, tuple[tuple[int, str, str], ...]]] = states  # type: ignore[assignment]
    while frontier:
        nxt = []
        for made, i, path in frontier:
            if i == n:
                done.append((made, path))
                continue
            if not (word[i].isdigit() or word[i] in "!|$"):  # a digit in a word never stands
                nxt.append((made + word[i], i + 1, path))
            if len(path) < most:
                for a, b in _BY_FIRST.get(word[i], ()):
                    if word.startswith(a, i):
                        nxt.append((made + b, i + len(a), (*path, (i, a, b))))
        if len(nxt) > 4000:
            nxt = sorted(nxt, key=lambda s: len(s[2]))[:4000]
        frontier = nxt
    for made, path in done:
        if made not in out or len(path) < len(out[made]):
            out[made] = path
    return out


def _edit_features(word: str, path: tuple[tuple[int, str, str], ...], count: float, own: float) -> list[object]:
    f: list[object] = [("n", len(path)), ("c", min(12, int(math.log2(count + 1)))), ("gain", max(-3, min(10, int(math.log2((count + 0.5) / (own + 0.5))))))]
    for i, a, b in path:
        before, after = word[i - 1 : i] or "^", word[i + len(a) : i + len(a) + 1] or "$"
        f += [("e", a, b), ("l", before, a, b), ("r", a, b, after), ("k", a.isdigit())]
    if not path:
        f += [("keep", min(4, int(math.log2(own + 1)))), ("digits", sum(c.isdigit() for c in word), len(word) < 5), ("ends", word[:1].isdigit(), word[-1:].isdigit(), word[-2:].isdigit())]
        f += [("keep3", word[i : i + 3]) for i in range(max(1, len(word) - 2)) if own < 3]
    return f


class Editor:
    def __init__(self, lexicon: Lexicon, weights: dict[object, float]):
        self.lexicon, self.weights = lexicon, weights
        self.memo: dict[str, str | None] = {}

    def learn(self, words: set[str]) -> None:
        """Decides all new ``words`` (lower case) at once."""
        new = [w for w in words if w not in self.memo]
        if len(self.memo) > 400_000:
            self.memo.clear()
            new = list(words)
        pure = [w for w in new if w.isalpha()]
        own = dict(zip(pure, self.lexicon.counts(pure).tolist()))
        rare = []
        for w in new:
            self.memo[w] = None
            if own.get(w, 0) < self.lexicon.usual and 3 <= len(w) <= _LONGEST and sum(c.isalpha() for c in w) >= max(2, len(w) // 2):
                rare.append(w)
        flat: list[str] = []
        made = []
        for w in rare:
            e = edits(w)
            made.append(e)
            flat += e
        counts = self.lexicon.counts(flat).tolist()
        at = 0
        for w, e in zip(rare, made):
            n = own.get(w, 0)
            best, score = None, self._score(w, (), n, n)
            for (c, path), k in zip(e.items(), counts[at : at + len(e)]):
                if path and k >= max(2, RATIO * n):
                    s = self._score(w, path, k, n)
                    if s > score:
                        best, score = c, s
            at += len(e)
            self.memo[w] = best

    def _score(self, w: str, path: tuple[tuple[int, str, str], ...], count: float, own: float) -> float:
        return sum(self.weights.get(f, 0.0) for f in _edit_features(w, path, count, own))


def _corrupt(word: str, rng: random.Random) -> str:
    spots = [(i, b, a) for a, b in _CONFUSIONS for i in range(len(word)) if word.startswith(b, i) and a not in "!|$"]
    if not spots:
        return word
    for _ in range(1 if rng.random() < 0.85 else 2):
        i, b, a = rng.choice(spots)
        if word.startswith(b, i):
            word = word[:i] + a + word[i + len(b) :]
    return word


def train_editor(texts: list[str], lexicon: Lexicon, seed: int = 7, words: int = 2500) -> dict[object, float]:
    """Words of the sample, some of them corrupted by the confusions, as examples of what to edit and what to keep."""
    rng = random.Random(seed)
    seen = Counter(w for t in texts for w in _LETTERS.findall(t.lower()) if 3 <= len(w) <= 20 and "-" not in w)
    # the rarest words of the sample may be misread themselves, and are left out
    pool = sorted(w for w, n in seen.items() if n >= 2) or sorted(seen)
    if not pool:
        return {}
    p = Perceptron()
    examples = []
    # what has digits by right: the sample's own codes, and made ones
    codes = sorted({w for t in texts for w in _TOKEN.findall(t.lower()) if not w.isalpha() and 3 <= len(w) <= 20 and sum(c.isalpha() for c in w) >= max(2, len(w) // 2)})
    # words that are hardly there, as if read for the first time
    unseen = set()
    for _ in range(words):
        gold = rng.choice(pool)
        how = rng.random()
        if how < 0.6:
            examples.append((_corrupt(gold, rng), gold))
        elif how < 0.7:
            letters = "".join(rng.choice("abcdefghiklmnoprstuvxz") for _ in range(rng.randint(2, 3)))
            code = rng.choice(codes) if codes and rng.random() < 0.5 else rng.choice((f"{letters}{rng.randint(1, 99)}", f"{rng.randint(1, 9)}{letters}", f"{letters}{rng.randint(1, 9)}{letters[:1]}"))
            examples.append((code, code))
        else:
            if how > 0.85:
                unseen.add(len(examples))
            examples.append((gold, gold))
    made = [edits(noisy, 2) for noisy, _ in examples]
    counts = lexicon.counts([c for e in made for c in e])
    own = lexicon.counts([noisy for noisy, _ in examples])
    at, table = 0, []
    for e in made:
        table.append({c: float(k) for c, k in zip(e, counts[at : at + len(e)])})
        at += len(e)
    for _ in range(2):
        order = list(range(len(examples)))
        rng.shuffle(order)
        for i in order:
            (noisy, gold), e, t = examples[i], made[i], table[i]
            p.tick()
            if gold not in e:
                continue
            n = float(own[i]) if noisy.isalpha() else 0.0
            if noisy == gold and noisy.isalpha():
                n = float(rng.randint(1, 3)) if i in unseen else max(n, 1.0)
            options = [(c, _edit_features(noisy, path, t[c], n)) for c, path in e.items() if c == gold or c == noisy or t[c] >= max(2, RATIO * n)]
            best = max(options, key=lambda o: p.score(o[1]))
            if best[0] != gold:
                p.update(_edit_features(noisy, e[gold], t[gold], n), best[1])
    return p.averaged()


# ---- line joins ----------------------------------------------------------------------------------------


def join_features(mark: str, left: str, right: str, whole: int, kept: int, a: int, b: int, usual: float) -> list[object]:
    size = lambda n: min(8, int(math.log2(n + 1)))
    often = lambda n: int(n > usual / 20) + int(n > usual / 4) + int(n > 4 * usual)
    return [
        "bias", ("mark", mark if mark in "-‐" else "soft"), ("left", min(len(left), 6)), ("right", min(len(right), 6)), ("whole", size(whole)), ("kept", size(kept)),
        ("more", (whole > kept) - (kept > whole)), ("halves", often(a), often(b)), ("new", whole == 0 and kept == 0, often(a), often(b)), ("case", right[:1].isupper(), left[-1:].isupper()),
    ]


def train_joins(texts: list[str], lexicon: Lexicon, seed: int = 7, examples: int = 3000) -> dict[object, float]:
    """Words of the sample broken anywhere, and words with a hyphen broken there, some as if never seen before."""
    rng = random.Random(seed)
    seen = Counter(w for t in texts for w in _LETTERS.findall(t.lower()) if len(w) >= 4)
    plain = sorted(w for w, n in seen.items() if "-" not in w and (n >= 2 or len(seen) < 50))
    hyphened = sorted(w for w in seen if "-" in w.strip("-"))
    if not plain:
        return {}
    made = []
    for _ in range(examples):
        if rng.random() < 0.6:
            w = rng.choice(plain)
            k = rng.randint(1, len(w) - 1)
            made.append((rng.choice("---‐¬\xad"), w[:k], w[k:], "join", rng.random() < 0.25))
        elif hyphened and rng.random() < 0.5:
            left, _, right = rng.choice(hyphened).partition("-")
            if left and right:
                made.append((rng.choice("--‐"), left, right, "keep", rng.random() < 0.25))
        else:
            made.append((rng.choice("--‐"), rng.choice(plain), rng.choice(plain), "keep", True))
    counts = lexicon.counts([x for _, a, b, _, _ in made for x in (a + b, f"{a}-{b}", a, b)]).reshape(-1, 4).tolist()
    p = Perceptron()
    for _ in range(3):
        order = list(range(len(made)))
        rng.shuffle(order)
        for i in order:
            mark, a, b, gold, new = made[i]
            whole, kept, na, nb = counts[i]
            f = join_features(mark, a, b, 0 if new else whole, 0 if new else kept, na, nb, lexicon.usual)
            p.tick()
            best = max(("join", "keep"), key=lambda c: p.score((c, x) for x in f))
            if best != gold:
                p.update([(gold, x) for x in f], [(best, x) for x in f])
    return p.averaged()


# ---- furniture -----------------------------------------------------------------------------------------

_ROMAN = r"(?=[ivxl])(?:x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER_LINE = re.compile(
    r"(?ix)^[\s\-–—\[(.|/]*(?:(?:page|seite|p|pag|pg|s|página|pág|pagina|feuille|blatt|страница|стр)\b[.:]?\s*)?[-–—\[(.|/]*\s*"
    rf"(?:[0-9]{{1,4}}|{_ROMAN})\s*[-–—\])|/.]*\s*(?:(?:of|von|de|sur|из|/)?\s*[0-9]{{1,4}})?\s*[-–—\])]*\s*$"
)
_SENTENCE_END = re.compile(rf"(?i)^\s*(?:\d+(?:[.,]\d+)?|{_ROMAN})[.,;:]\s*$")
# Words that come before the number of an issue.
_ISSUE_WORDS = ("issue", "no", "nr", "rev", "revision", "ausgabe", "ausg", "fassung", "stand", "édition", "éd", "n°", "nº", "num", "núm", "edición", "version", "versión", "vol", "ed", "edition", "выпуск")
_ISSUE = re.compile(r"^(?P<title>.*?\S)(?:\s*[|/·•]\s*|\s+[-–—]\s*|\s*[–—]\s+|,\s+)(?P<word>[^\W\d][\w°º]{0,10})\.?\s*(?P<n>[0-9olsg]{1,4})(?P<rest>\s.*)?$", re.I)


def _folded(word: str) -> str:
    """The word with signs that a reader confuses made equal."""
    return word.lower().translate(_FOLD).replace("i", "l").replace("c", "e").replace("f", "t").strip(".")


_ISSUE_FOLDED = {_folded(w) for w in _ISSUE_WORDS}


def _issue(line: str) -> re.Match[str] | None:
    if len(line) > 120:
        return None
    m = _ISSUE.match(line)
    return m if m and _folded(m["word"]) in _ISSUE_FOLDED else None


def _page_number(s: str) -> bool:
    s = s.strip()
    return bool(s) and len(s) <= 24 and bool(_NUMBER_LINE.match(s)) and not _SENTENCE_END.match(s)


def line_features(lines: list[str], i: int) -> list[object]:
    s = lines[i]
    t = s.strip()
    n = len(t)
    words = t.split()
    m = _issue(t)
    # a reader's digits in a word are folded, so that the wording counts
    word = _folded(m["word"]) if m else ""
    above, below = lines[i - 1].strip() if i else "", lines[i + 1].strip() if i + 1 < len(lines) else ""
    others = [len(x) for k, x in enumerate(lines) if k != i]
    width = n / max(1, sorted(others)[len(others) // 2]) if others else 1
    # whether the sentence runs on over the line, or through it
    open_above, lower_below = bool(above) and above[-1] not in ".!?:", below[:1].islower()
    place = ("only" if len(lines) == 1 else "first" if i == 0 else "last" if i == len(lines) - 1 else "in", min(i, 3), min(len(lines) - 1 - i, 3))
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "0", t))[:12] if n <= 24 else "long"
    f: list[object] = ["bias", ("place", place[0]), ("from top", place[1]), ("from end", place[2]), ("width", min(6, int(width * 4))), ("column", page := min(6, max(map(len, lines)) // 8), n and place[0]), ("number in column", page, t.isdigit(), open_above), ("runs on", open_above, lower_below, place[0]), ("number runs on", _page_number(t), t.isdigit(), open_above, lower_below, place[0]), ("size", min(8, n // 10)), ("number", _page_number(t)), ("shape", shape), ("issue", word), ("has issue", bool(m))]
    if m:
        rest = (m["rest"] or "").strip()
        f += [("title words", min(8, len(m["title"].split()))), ("rest", "none" if not rest else "number" if _page_number(rest) else "text"), ("caps", t.upper() == t), ("stop", bool(re.search(r"[.;!?]\s", m["title"]))), ("first", _folded(words[0]))]
    f += [("ends", t[-1:] if not t[-1:].isalnum() else "0" if t[-1:].isdigit() else "a"), ("starts", "A" if t[:1].isupper() else "0" if t[:1].isdigit() else "a" if t[:1].isalpha() else t[:1])]
    return f


_CLASSES = ("text", "header", "number")


class Furniture:
    def __init__(self, weights: dict[object, float]):
        self.weights = weights

    def tag(self, lines: list[str]) -> list[str]:
        out = []
        for i, s in enumerate(lines):
            t = s.strip()
            issue = _issue(t)
            number = _page_number(t)
            if not (issue or number):  # neither form: text, whatever the weights
                out.append("text")
                continue
            f = line_features(lines, i)
            scores = {c: sum(self.weights.get((c, x), 0.0) for x in f) for c in _CLASSES if c == "text" or (c == "header" and issue) or (c == "number" and number)}
            out.append(max(scores, key=lambda c: scores[c]))
        return out


def train_furniture(texts: list[str], titles: list[str], seed: int = 7, rounds: int = 2) -> dict[object, float]:
    """Pages made of the sample's sentences, with headers and page numbers set among their lines."""
    rng = random.Random(seed)
    bodies = [t for t in texts if len(t) > 60 and "|" not in t] or ["No text at all was given for this page, so that there is little to learn from it."]
    heads = [t for t in titles if 8 <= len(t) <= 70] or ["Operating handbook drive unit"]
    # How page numbers and issues are commonly written.
    numbers = ("{n}", "- {n} -", "– {n} –", "-{n}-", "[{n}]", "({n})", ". {n} .", "p. {n}", "Page {n}", "PAGE {n}", "Seite {n}", "Página {n}", "Pág. {n}", "Page {n} of {m}", "Seite {n} von {m}", "{n} / {m}", "{n}/{m}", "{r}")
    issues = ("issue", "no.", "rev.", "nr.", "Ausgabe", "édition", "n°", "edición", "núm.", "version", "vol.", "ed.")
    romans = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
    p = Perceptron()
    for _ in range(rounds):
        for _ in range(1200):
            body = rng.choice(bodies)
            # in narrow columns numbers of the sentence stand on lines of their own
            width = rng.randint(38, 72) if rng.random() < 0.9 else rng.randint(5, 16)
            lines, gold = [], []
            line = ""
            for w in body.split()[:120]:
                w = str(rng.randint(1, 999)) if width < 20 and rng.random() < 0.15 else w
                if line and len(line) + len(w) + 1 > width:
                    lines.append(line)
                    line = w
                else:
                    line = f"{line} {w}".strip()
            if line:
                lines.append(line)
            gold = ["text"] * len(lines)
            n = rng.randint(1, 60)
            number = rng.choice(numbers).format(n=n, m=n + rng.randint(0, 30), r=rng.choice(romans))
            if rng.random() < 0.6:
                h = f"{rng.choice(heads)} {rng.choice('–-|/·')} {rng.choice(issues)} {rng.randint(1, 60)}"
                h = h.upper() if rng.random() < 0.3 else h.replace(" ", "  ", 1) if rng.random() < 0.2 else h
                if rng.random() < 0.25:
                    h = f"{h}   {number}"
                if rng.random() < 0.2:
                    k = rng.randrange(len(h))
                    h = h[:k] + {"o": "0", "l": "1", "s": "5", "e": "c", "i": "l"}.get(h[k], h[k]) + h[k + 1 :]
                k = rng.randint(0, len(lines))
                lines.insert(k, h)
                gold.insert(k, "header")
            if rng.random() < 0.5:
                k = rng.choice((0, len(lines), rng.randint(0, len(lines))))
                lines.insert(k, number)
                gold.insert(k, "number")
            if rng.random() < 0.15:  # a number that ends a sentence on a line of its own
                lines.append(f"{rng.randint(1, 999)}.")
                gold.append("text")
            for i, g in enumerate(gold):
                t = lines[i].strip()
                p.tick()
                if g == "text" and not (_issue(t) or _page_number(t)):
                    continue
                f = line_features(lines, i)
                best = max(_CLASSES, key=lambda c: p.score((c, x) for x in f))
                if best != g:
                    p.update([(g, x) for x in f], [(best, x) for x in f])
    return p.averaged()


# ---- whole texts ---------------------------------------------------------------------------------------


class Repairer:
    def __init__(self, lexicon: Lexicon, editor: dict[object, float], furniture: dict[object, float], joins: dict[object, float]):
        self.lexicon = lexicon
        self.editor = Editor(lexicon, editor)
        self.furniture = Furniture(furniture)
        self.joins = joins
        self._broken: dict[tuple[str, str, str], bool] = {}

    def _is_broken(self, left: str, mark: str, right: str) -> bool:
        """Whether a mark at a line's end breaks a word, or is a hyphen that the word has anyway."""
        if mark != "-" and mark != "‐":
            return True
        k = (left, mark, right)
        if k not in self._broken:
            if len(self._broken) > 200_000:
                self._broken.clear()
            a, b = left.lower(), right.lower()
            whole, kept, na, nb = self.lexicon.counts([a + b, f"{a}-{b}", a, b]).tolist()
            if not whole and not kept:  # the word may be misread as well
                self.editor.learn({a + b})
                if (c := self.editor.memo[a + b]) is not None:
                    whole = int(self.lexicon.counts([c])[0])
            f = join_features(mark, left, right, whole, kept, na, nb, self.lexicon.usual)
            self._broken[k] = sum(self.joins.get(("join", x), 0.0) - self.joins.get(("keep", x), 0.0) for x in f) >= 0
        return self._broken[k]

    def layout(self, text: str) -> tuple[str, set[str]]:
        """The text without furniture, its broken words and lines joined; and the kinds of noise found so far."""
        lines = text.split("\n")
        tags = self.furniture.tag(lines)
        kinds: set[str] = set()
        body: list[str] = []
        for s, tag in zip(lines, tags):
            if tag == "header":
                kinds.add("running_header")
                m = _issue(s.strip())
                if m and m["rest"] and _page_number(m["rest"]):
                    kinds.add("page_number")
            elif tag == "number":
                kinds.add("page_number")
            else:
                body.append(s)
        out = ""
        for i, s in enumerate(body):
            if not i:
                out = s
                continue
            m = _MARKED.search(out, max(0, len(out) - 60)) if out[-2:].rstrip(" ")[-1:] in _MARKS else None
            right = _HALF.match(s.lstrip()) if m else None
            if m and right and (m[2] not in "-‐" or right[0][0].islower() or right[0].isdigit() is False and right[0][0].isalpha() and m[1][-1:].isupper()):
                left = _TAIL.search(out, max(0, m.start(2) - 60), m.start(2))
                if left and self._is_broken(left[0], m[2], right[0]):
                    kinds.add("hyphenation")
                    out = out[: m.start(2)] + s.lstrip()
                else:
                    out = out.rstrip() + s.lstrip()
                continue
            if not s.strip() or not out or out.endswith("\n"):
                out += "\n" if s.strip() == "" else s
            elif re.match(r"\s*(?:[-*•]|\d+[.)])\s", s):
                out += "\n" + s
            else:
                out = out.rstrip(" ") + " " + s.lstrip(" ")
        return out, kinds

    def run(self, texts: list[str], flat: list[bool]) -> list[tuple[str, set[str]]]:
        """``flat``: texts whose lines are not to be touched (tables, code)."""
        laid = [(t, set()) if f or "\n" not in t else self.layout(t) for t, f in zip(texts, flat)]
        tokens: list[set[str]] = [set(_TOKEN.findall(t)) if not f else set() for (t, _), f in zip(laid, flat)]
        lower = set()
        for s in tokens:
            lower |= s
        self.editor.learn({w.lower() for w in lower})
        memo = self.editor.memo
        wrong = {w: c for w in lower if (c := memo.get(w.lower())) is not None}
        names = set(wrong)
        out = []
        for (t, kinds), s in zip(laid, tokens):
            bad = {w: wrong[w] for w in s & names}
            if bad:
                kinds.add("misread")

                def put(m: re.Match[str]) -> str:
                    c = bad.get(m[0])
                    if c is None:
                        return m[0]
                    return c.upper() if m[0].isupper() and len(m[0]) > 1 else c[:1].upper() + c[1:] if m[0][:1].isupper() else c

                t = _TOKEN.sub(put, t)
            out.append((t, kinds))
        return out


def _repair(table: np.ndarray, editor: dict[object, float], furniture: dict[object, float], joins: dict[object, float]):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Repairer(Lexicon(table), editor, furniture, joins)
        for pdf in batches:
            keys, texts, kinds = pdf["k"].tolist(), pdf["t"].tolist(), pdf["kind"].tolist()
            out = []
            for lo, hi in portions(list(map(len, texts)), 1000):
                part = texts[lo:hi]
                done = r.run(part, [k in ("TABLE", "CODE") for k in kinds[lo:hi]])
                out += [(keys[lo + i], sorted(noise), t, fixed) for i, (t, (fixed, noise)) in enumerate(zip(part, done)) if noise or fixed != t]
            yield pd.DataFrame(out, columns=["k", "noise", "text", "repaired_text"])

    return go


def word_table(df: DataFrame, text: str) -> np.ndarray:
    """Count-min table of a column's words: twice ``BUCKETS`` sums at most reach the driver."""
    table = np.zeros(2 * BUCKETS, np.int64)
    # each line once: copies of a page, or deliveries of a row, would make its misreadings usual
    lines = df.where(F.col(text).isNotNull()).select(F.explode(F.split(F.lower(text), "\n")).alias("t")).select(F.trim(F.regexp_replace("t", r"\s+", " ")).alias("t")).where("t <> ''").distinct()
    rows = spread(lines).mapInPandas(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    table[rows["bucket"].to_numpy().astype(np.int64)] = rows["n"].to_numpy().astype(np.int64)
    return table


def repair_scans(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, noise, text, repaired_text) of every record whose text changes; noise lists the kinds found.

    ``kind`` names the column whose values TABLE, CODE and HEADING tell tables, code and titles apart.
    """
    table = word_table(df, text)
    lexicon = Lexicon(table)
    sample = df.where(F.length(text).between(8, 3000)).select(F.col(text).alias("t"), F.col(kind).alias("kind"), F.xxhash64(key).alias("h"))
    rows = sample.where(F.col("kind").isNull() | ~F.col("kind").isin("TABLE", "CODE", "HEADING") & ~F.col("t").contains("\n")).orderBy("h", "t").limit(TRAIN_ROWS).collect()
    titles = sample.where(F.col("kind") == "HEADING").orderBy("h", "t").limit(TRAIN_ROWS // 4).collect()
    texts = list(dict.fromkeys(r["t"] for r in rows))  # a page that is copied often teaches once
    editor = train_editor(texts, lexicon)
    furniture = train_furniture(texts, [r["t"] for r in titles])
    joins = train_joins(texts, lexicon)
    todo = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(F.col(kind), F.lit("")).alias("kind"))
    return (
        spread(todo).mapInPandas(_repair(table, editor, furniture, joins), f"k {dict(todo.dtypes)['k']}, noise array<string>, text string, repaired_text string")
        .dropDuplicates(["k"]).withColumnRenamed("k", key)
    )
