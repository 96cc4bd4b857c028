"""Text garbled by a wrong character encoding.

1. Counts of adjacent character pairs with a character beyond ASCII, over the whole column, into a table of
   fixed size. Runs that an inverse mapping turns into valid UTF-8 are left out of the counts, so that
   damage does not teach the table that it is normal. One-byte misreadings show only against the counts: the words of
   texts that an inverse mapping makes likelier are taken out of them, found at most ``PASSES`` - 1 times, each time under the
   counts before. A misreading that most texts of its language share is taken for normal.
2. Each pair has its part in the corpus's mutual information, p(x,y)·log(p(x,y)/p(x)p(y)). A pair
   scores by how far that part lies below ``FLOOR``; the maximum-scoring segments of a text are its improbable runs.
3. Only inside those runs inverse mappings are tried (written as A, read as B: encode in B, decode as A), again and
   again for repeated damage. One is taken if it makes the run far more likely under the pair counts.
   The replacement character, and control characters left from a wrong reading, are damage that nothing restores.

Defined results: NULL, empty and ASCII texts are unaffected; repeated rows count once; with no texts at all
the result is empty.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions
from loamstone.plans.tables import spread

#: Buckets of the pair table (counts of pairs that share a bucket add up); it is what is sent to tasks.
BUCKETS = 1 << 19
#: A pair whose part in the mutual information is less, in nats per character, is improbable.
FLOOR = 6e-5
#: Nats by which an inverse mapping must raise the likelihood of a run.
MARGIN_UTF8, MARGIN_BYTE, MARGIN_BYTE_EACH = 3.0, 5.0, 0.6
#: Nats that each pair of adjacent accented Latin letters counts against a reading: languages rarely have any.
ACCENTS = 1.0
#: Nats, in all and per character beyond ASCII, by which an inverse must raise a text's likelihood to keep words out of the counts.
SEEN_LEAST, SEEN_EACH = 0.5, 0.3
#: Least gain of a word, so that one odd word does not outweigh a text; and counts of the column at most.
_WORST, PASSES = -3.0, 4
#: Characters of text whose words are judged at once.
_WORDS_OF = 1_000_000
#: Characters of a stretch whose inverse is remembered, at most: longer ones hardly come again.
_KEPT = 500
#: Score of a pair of ASCII characters: a run goes over a few of them, not over many.
_PLAIN = -1.5
_CHUNK = 500

# Encodings in which text is commonly misread, and those in which it was written.
_READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp866")
_WRITTEN_AS = ("utf-8", "cp1252", "cp1251", "mac_roman", "cp850", "cp437", "koi8-r", "cp866")
# Pairs of one-byte encodings that are worth a test.
_ONE_BYTE = [("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("latin-1", "cp850"), ("latin-1", "cp437"), ("cp1251", "cp1252"), ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("cp1250", "cp1252"), ("latin-1", "mac_roman"), ("cp1252", "cp866"), ("latin-1", "cp866")]
_HIGH = re.compile(r"[^\x00-\x7f]+")
_UNITS = (re.compile(r"(?s).+"), re.compile(r"\S+"), _HIGH)
_ACCENTED = re.compile("[\u00c0-\u00ff](?=[\u00c0-\u00ff])")
#: What text in the languages at hand consists of beyond ASCII; a reading as UTF-8 must give it to keep a run out of the counts.
_USUAL = re.compile("[\u00a1-\u017f\u0400-\u045f\u2010-\u2044\u20ac\u2122]+")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


def _table(encoding: str) -> dict[str, int]:
    """Character → byte, with the bytes an encoding leaves undefined read as control characters."""
    out = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


_BYTES = {e: _table(e) for e in dict.fromkeys((*_READ_AS, *(a for a, _ in _ONE_BYTE)))}


def _moves(read: str, written: str) -> dict[int, str]:
    """Character → what its byte in ``read`` is in ``written``, without those that become damage or nothing."""
    out = {}
    for c, b in _BYTES[read].items():
        try:
            d = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        if not _LOST.search(d):
            out[ord(c)] = d
    return out


def _bits(tables: list[set[str]]) -> dict[str, int]:
    """Character → the tables that have it, a bit each."""
    return {c: sum(1 << k for k, t in enumerate(tables) if c in t) for c in set().union(*tables)}


_MOVES = [_moves(*pair) for pair in _ONE_BYTE]
_PAIR_OF = {pair: k for k, pair in enumerate(_ONE_BYTE)}
_READABLE = _bits([set(_BYTES[e]) for e in _READ_AS])
_MOVABLE = _bits([set(map(chr, m)) for m in _MOVES])


def _fitting(s: str, bits: dict[str, int]) -> int:
    """The tables that have all characters of ``s``, a bit each."""
    out = -1
    for c in set(s):
        out &= bits.get(c, 0)
        if not out:
            break
    return out


def _as_utf8(s: str) -> list[str]:
    out = []
    fit = _fitting(s, _READABLE)
    for k, e in enumerate(_READ_AS):
        if fit >> k & 1:
            try:
                d = bytes(map(_BYTES[e].__getitem__, s)).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if d != s:
                out.append(d)
    return out


def as_utf8(s: str) -> list[str]:
    """What ``s`` says if it is UTF-8 read in a one-byte encoding, once or any number of times over; each reading is shorter than the one before."""
    out: dict[str, None] = {}
    level = [s]
    while level:
        level = list(dict.fromkeys(d for x in level for d in _as_utf8(x) if d not in out and d != s))
        out.update(dict.fromkeys(level))
    return list(out)


def _bucket(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + y.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(45)).astype(np.int64) % BUCKETS


def _bucket_of(x: int, y: int) -> int:
    """``_bucket`` of one pair."""
    k = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return (((k ^ (k >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 45) % BUCKETS


#: Second member of the "pair" under which a character by itself is counted, and the key of all characters.
_ALONE, _ALL = 0x110000, 0x110001


def _join(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts, a null character before, between and after them; its characters; and where the null after each text is."""
    s = "\x00".join(["", *(t or "" for t in texts), ""])
    return s, np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(t or "") + 1 for t in texts])


def _stretches(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values; the first and the last value are false."""
    at = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return at[::2], at[1::2]


class _Utf8:
    """Runs that an inverse mapping turns into valid UTF-8; they aren't counted."""

    def __init__(self) -> None:
        self.known: dict[str, bool] = {}

    def __call__(self, r: str) -> bool:
        bad = self.known.get(r)
        if bad is None:
            bad = any(_USUAL.fullmatch(d) or d == "\xa0" for d in as_utf8(r))
            if len(self.known) < 100_000:
                self.known[r] = bad
        return bad

    def mark(self, skip: np.ndarray, s: str, starts: np.ndarray, ends: np.ndarray) -> None:
        long = ends - starts > 1
        for i, j in zip(starts[long].tolist(), ends[long].tolist()):
            if self(s[i:j]):
                skip[i:j] = True


def _add(total: np.ndarray, chars: np.ndarray, x: np.ndarray, y: np.ndarray, sign: int = 1) -> None:
    """Adds characters, and pairs of them, to the counts."""
    one, n = np.unique(chars, return_counts=True)
    np.add.at(total, _bucket(one, np.full(len(one), _ALONE)), sign * n)
    total[_bucket(np.array([_ALL]), np.array([_ALL]))] += sign * len(chars)
    two, n = np.unique(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64), return_counts=True)
    np.add.at(total, _bucket(two >> np.uint64(32), two & np.uint64(0xFFFFFFFF)), sign * n)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of characters and pairs."""
    total, utf8 = np.zeros(BUCKETS, np.int64), _Utf8()
    for pdf in batches:
        texts = pdf["t"].tolist()
        for lo, hi in portions(list(map(len, texts)), _CHUNK):
            s, c, _ = _join(texts[lo:hi])
            high, skip = c >= 128, np.zeros(len(c), bool)
            utf8.mark(skip, s, *_stretches(high))
            p = np.flatnonzero((high[:-1] | high[1:]) & ~skip[:-1] & ~skip[1:])
            _add(total, c[1:][~skip[1:]], c[p], c[p + 1])
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


def _taking_out(counts: np.ndarray):
    """What the words that look misread under ``counts`` have added to the counts of all, as negative counts."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, utf8, misread = np.zeros(BUCKETS, np.int64), _Utf8(), _Misread(Pairs(counts))
        for pdf in batches:
            texts = pdf["t"].tolist()
            for lo, hi in portions(list(map(len, texts)), _CHUNK, _WORDS_OF):
                s, c, ends = _join(texts[lo:hi])
                out, hit = misread(s, c, ends)
                if not len(hit):
                    continue
                high, skip = c >= 128, np.zeros(len(c), bool)
                starts, stops = _stretches(high)
                there = np.isin(np.searchsorted(ends, starts), hit)  # elsewhere nothing changes
                utf8.mark(skip, s, starts[there], stops[there])
                out &= ~skip
                p = np.flatnonzero((high[:-1] | high[1:]) & (out[:-1] | out[1:]) & ~skip[:-1] & ~skip[1:])
                _add(total, c[out], c[p], c[p + 1], -1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return go


class _Given(dict):
    """Pair of characters → log of the second's probability after the first; kept once computed."""

    def __init__(self, pairs: Pairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, k: tuple[str, str]) -> float:
        v = self.pairs.given(*k)
        if len(self) < 500_000:
            self[k] = v
        return v


class Pairs:
    """Corpus counts of characters and pairs."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.total = float(counts[_bucket(np.array([_ALL]), np.array([_ALL]))][0]) + 1
        self._given = _Given(self)
        self.inverse: dict[tuple[object, ...], _Found | None] = {}
        self.repaired: dict[tuple[object, ...], tuple[str, set[tuple[str, str]]] | None] = {}

    def alone(self, x: np.ndarray) -> np.ndarray:
        return (self.counts[_bucket(x, np.full(len(x), _ALONE))] + 0.02) / self.total

    def improbable(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Score of each pair: positive where its part in the mutual information is below the floor."""
        p = (self.counts[_bucket(x, y)] + 0.02) / self.total
        part = p * np.log(p / (self.alone(x) * self.alone(y)))
        return np.clip(np.log(FLOOR / np.maximum(part, 1e-9)), -6, 6)

    def given(self, x: str, y: str) -> float:
        a, b = ord(x), ord(y)
        base = (int(self.counts[_bucket_of(b, _ALONE)]) + 0.02) / self.total
        if a < 128 and b < 128:
            return math.log(base)
        n, nx = int(self.counts[_bucket_of(a, b)]), int(self.counts[_bucket_of(a, _ALONE)])
        return math.log((n + 5 * base) / (max(n, nx) + 5))

    def likelihood(self, s: str) -> float:
        return sum(map(self._given.__getitem__, zip(s, s[1:])))


class _Misread:
    """Words of a text that some pair of one-byte encodings makes likelier, judged over the whole text.

    Where the damage is frequent the gain of one character is small (0.7 nats at a third of the column), while what is
    right loses by every inverse; so gains are summed over the text, and the margins are low.
    """

    def __init__(self, pairs: Pairs):
        self.pairs = pairs
        self.row: dict[str, int] = {}
        self.table = np.empty((1 << 12, len(_ONE_BYTE)))

    def gains(self, w: str) -> np.ndarray | float:
        fit = _fitting(w, _MOVABLE)
        if not fit:
            return _WORST
        said = lambda t: self.pairs.likelihood(f" {t} ") - ACCENTS * len(_ACCENTED.findall(t))
        own, made = said(w), {}
        g = np.full(len(_ONE_BYTE), _WORST)
        for k, moves in enumerate(_MOVES):
            if fit >> k & 1:
                d = w.translate(moves)
                if d not in made:
                    made[d] = max(_WORST, said(d) - own)
                g[k] = made[d]
        return g

    def rows(self, words: list[str]) -> np.ndarray:
        """Where in the table the words' gains are."""
        if len(self.row) > 200_000:
            self.row.clear()
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            r = self.row.get(w)
            if r is None:
                r = self.row[w] = len(self.row)
                if r == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[r] = self.gains(w)
            out[i] = r
        return out

    def __call__(self, s: str, c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which characters of the joined texts are in such words, and the texts that have any."""
        high = c >= 128
        starts, stops = _stretches(high | ((c | 32) - 97 < 26))  # c has no sign: what is below "a" is far above
        before = np.concatenate([[0], np.cumsum(high)])
        n = before[stops] - before[starts]
        starts, stops, n = starts[n > 0], stops[n > 0], n[n > 0]
        out = np.zeros(len(c), bool)
        if not len(starts):
            return out, starts
        rows = self.rows([s[i:j] for i, j in zip(starts.tolist(), stops.tolist())])
        text = np.searchsorted(ends, starts)
        first = np.flatnonzero(np.diff(text, prepend=-1))
        total = np.add.reduceat(self.table[rows], first, axis=0)
        best = total.argmax(1)
        found = total[np.arange(len(first)), best] >= np.maximum(SEEN_LEAST, SEEN_EACH * np.add.reduceat(n, first))
        of = np.cumsum(np.diff(text, prepend=-1) > 0) - 1
        take = found[of] & (self.table[rows, best[of]] > 0)
        for i, j in zip(starts[take].tolist(), stops[take].tolist()):
            out[i:j] = True
        return out, np.unique(text[take])


def segments(at: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments (start, stop), in linear time; positions not in ``at`` score ``_PLAIN``."""
    out: list[tuple[int, int, float, float]] = []  # start, stop, sum before, sum up to the end
    total, last = 0.0, -1
    for i, v in zip(at.tolist(), score.tolist()):
        before = total + _PLAIN * (i - last - 1)
        total, last = before + v, i
        if v <= 0:
            continue
        start, left, right = i, before, total
        while True:
            k = len(out) - 1
            while k >= 0 and out[k][2] >= left:
                k -= 1
            if k < 0 or out[k][3] >= right:
                out.append((start, i + 1, left, right))
                break
            start, left = out[k][0], out[k][2]
            del out[k:]
    return [(a, b) for a, b, _, _ in out]


#: A restored stretch and the pair of one-byte encodings it took (None for UTF-8).
_Found = tuple[str, tuple[str, str] | None]


def _better(s: str, before: str, after: str, pairs: Pairs, known: frozenset[tuple[str, str]] | None) -> _Found | None:
    """The likeliest inverse of ``s`` between its neighbours, if it is likely enough; words come again and again."""
    if len(s) > _KEPT:
        return _inverse(s, before, after, pairs, known)
    k = (s, before, after, known)
    if k not in pairs.inverse:
        if len(pairs.inverse) > 100_000:
            pairs.inverse.clear()
        pairs.inverse[k] = _inverse(s, before, after, pairs, known)
    return pairs.inverse[k]


def _inverse(s: str, before: str, after: str, pairs: Pairs, known: frozenset[tuple[str, str]] | None) -> _Found | None:
    """``known``: the one-byte pairs that the text is known to have suffered, once there is something known of it."""
    said = lambda t: pairs.likelihood(before + t + after) - ACCENTS * len(_ACCENTED.findall(t))
    readings, fit = as_utf8(s), _fitting(s, _MOVABLE)
    if not readings and not fit:
        return None
    own = said(s)
    best: _Found | None = None
    gain = 0.0
    for d in readings:
        g = said(d) - own
        if g >= MARGIN_UTF8 and g > gain:
            best, gain = (d, None), g
    if best is not None:
        return best
    high = sum(ord(c) >= 128 for c in s)
    need = max(MARGIN_BYTE, MARGIN_BYTE_EACH * high) if known is None else 0.1
    tried = {s}
    for pair in _ONE_BYTE if known is None else known:
        if fit >> _PAIR_OF[pair] & 1:
            d = s.translate(_MOVES[_PAIR_OF[pair]])
            if d not in tried:
                tried.add(d)
                g = said(d) - own
                if g >= need and g > gain:
                    best, gain = (d, pair), g
    return best


def repair_run(text: str, a: int, b: int, pairs: Pairs, known: frozenset[tuple[str, str]] | None = None) -> tuple[str, set[tuple[str, str]]] | None:
    """``text`` with its run a:b restored and the one-byte pairs it took, or None. Tries the run, then its words, then each stretch beyond ASCII."""
    k = (text[a:b], text[a - 1 : a] or "\x00", text[b : b + 1] or "\x00", known)
    if k in pairs.repaired:
        found = pairs.repaired[k]
    else:
        found = _repaired(*k, pairs)
        if b - a <= _KEPT:
            if len(pairs.repaired) > 100_000:
                pairs.repaired.clear()
            pairs.repaired[k] = found
    return found and (text[:a] + found[0] + text[b:], found[1])


def _repaired(run: str, before: str, after: str, known: frozenset[tuple[str, str]] | None, pairs: Pairs) -> tuple[str, set[tuple[str, str]]] | None:
    for unit in _UNITS:
        out, at = [], 0
        used: set[tuple[str, str]] = set()
        for m in unit.finditer(run):
            s = m.group()
            if not _HIGH.search(s):
                continue
            x = run[m.start() - 1] if m.start() else before
            y = run[m.end()] if m.end() < len(run) else after
            found = _better(s, x, y, pairs, known)
            if found is not None:
                out += [run[at : m.start()], found[0]]
                at = m.end()
                if found[1]:
                    used.add(found[1])
        if at:
            return "".join(out) + run[at:], used
    return None


def _runs(text: str, pairs: Pairs) -> list[tuple[int, int]]:
    _, c, _ = _join([text])
    p = np.flatnonzero((c[:-1] >= 128) | (c[1:] >= 128))
    return _runs_of(text, p, pairs.improbable(c[p], c[p + 1]))


def _runs_of(text: str, p: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
    """The improbable runs of ``text`` by the scores of its pairs; pair i joins characters i-1 and i."""
    out: list[tuple[int, int]] = []
    for a, b in segments(p, score):
        a, b = max(0, a - 1), min(len(text), b)
        while a > 0 and ord(text[a - 1]) >= 128 and a < len(text) and ord(text[a]) >= 128:
            a -= 1
        while b < len(text) and ord(text[b]) >= 128 and ord(text[b - 1]) >= 128:
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif b > a:
            out.append((a, b))
    return out


def restore(text: str, pairs: Pairs, runs: list[tuple[int, int]] | None = None) -> tuple[str, str | None]:
    """The text restored as far as it can be, and its status: restored, partly, lost or None for unaffected. ``runs``: its improbable runs, if known."""
    now, known, seen = text, None, set()
    while now not in seen:
        seen.add(now)
        changed: set[tuple[str, str]] | None = None
        for a, b in reversed(runs if runs is not None and now == text else _runs(now, pairs)):
            better = repair_run(now, a, b, pairs, known)
            if better is not None:
                now = better[0]
                changed = (changed or set()) | better[1]
        if changed is None:
            break
        # what was restored isn't taken for other damage afterwards
        known = frozenset(changed | (known or set()))
    lost = bool(_LOST.search(now))
    if now != text:
        return now, "partly" if lost else "restored"
    return text, "lost" if lost else None


def _restore(counts: np.ndarray):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = Pairs(counts)
        for pdf in batches:
            keys, texts = pdf["k"].tolist(), pdf["t"].tolist()
            out = []
            for lo, hi in portions(list(map(len, texts)), _CHUNK):
                part = texts[lo:hi]
                _, c, ends = _join(part)
                p = np.flatnonzero((c[:-1] >= 128) | (c[1:] >= 128))
                score = pairs.improbable(c[p], c[p + 1])
                low = np.searchsorted(ends, np.concatenate([p[score > 0], np.flatnonzero(c == 0xFFFD)]), "right")
                at = np.concatenate([[0], ends])
                bounds = np.searchsorted(p, at)
                for i in np.unique(low).tolist():
                    of = slice(bounds[i], bounds[i + 1])
                    fixed, status = restore(part[i], pairs, _runs_of(part[i], p[of] - at[i], score[of]))
                    if status:
                        out.append((keys[lo + i], status, part[i], fixed))
            yield pd.DataFrame(out, columns=["k", "status", "text", "restored_text"])

    return go


def pair_counts(df: DataFrame, text: str) -> np.ndarray:
    """The pair table of a column: partial tables are summed by bucket; at most ``BUCKETS`` rows a pass reach the driver."""
    texts = spread(df.where(F.col(text).isNotNull()).select(F.col(text).alias("t")))
    beyond = texts.where(F.col("t").rlike(r"[^\x00-\x7F]"))

    def added(rows: DataFrame, count) -> np.ndarray:
        counts = np.zeros(BUCKETS, np.int64)
        t = rows.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[t["bucket"].to_numpy().astype(np.int64)] = t["n"].to_numpy().astype(np.int64)
        return counts

    counts = every_text = added(texts, _count)
    every = _bucket(np.array([_ALL]), np.array([_ALL]))
    for _ in range(PASSES - 1):
        before, counts = counts, every_text + added(beyond, _taking_out(counts))
        if abs(int(counts[every][0] - before[every][0])) <= 1e-5 * int(before[every][0]):
            break
    return counts


def repair_encoding(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, status, text, restored_text) of every affected record; status is restored, partly or lost."""
    counts = pair_counts(df, text)
    rows = df.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x00-\x7F]")).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return spread(rows).mapInPandas(_restore(counts), f"k {dict(rows.dtypes)['k']}, status string, text string, restored_text string").dropDuplicates(["k"]).withColumnRenamed("k", key)
