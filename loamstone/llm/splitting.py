"""Splitting oversized texts at natural boundaries, by pointer doubling over boundary tables.

Every boundary of a text is joined to its farthest legal successor: the start of the next piece if a piece
started there. Squaring that table marks all greedy cuts of all texts of a batch at once, in as many
rounds as the logarithm of the longest chain.

Defined results: NULL texts and texts within the limit give no pieces; repeated rows of an id count once; a text
without boundaries is cut at the limit, though never between a character and its combining marks
where another cut is in reach.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions

LIMIT, OVERLAP = 2000, 100

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+")
_CLAUSE = re.compile(r"[;:,]\s+")
_WORD = re.compile(r"\s+")
#: Strongest first; a weaker kind is used only where no stronger one lies in the last part of a piece.
_KINDS = (_PARAGRAPH, _LINE, _SENTENCE, _CLAUSE, _WORD)
#: A stronger boundary is preferred as long as the piece stays at least this full.
_FULL = (0.5, 0.6, 0.6, 0.8, 0.0)


def _successors(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate starts, and for each the end of its piece and the index of the next start (own index at the end)."""
    n = len(text)
    kinds = [np.array([m.end() for m in k.finditer(text)], np.int64) for k in _KINDS]
    hard = np.arange(0, n + 1, max(1, overlap // 2), dtype=np.int64)  # where no boundary is in reach
    starts = np.unique(np.concatenate([[0], *kinds, hard]))
    starts = starts[starts < n]
    end = np.full(len(starts), -1, np.int64)
    end[starts + limit >= n] = n
    for cuts, full in zip(kinds, _FULL):
        if len(cuts):
            far = cuts[np.maximum(0, np.searchsorted(cuts, starts + limit, "right") - 1)]
            ok = (end < 0) & (far <= starts + limit) & (far > starts + np.maximum(overlap, full * limit))
            end[ok] = far[ok]
    forced = np.flatnonzero(end < 0)
    end[forced] = starts[forced] + limit
    for i in forced:
        e = int(end[i])
        while e > starts[i] + limit // 2 and re.match(r"[̀-ͯ‍️]", text[e]):
            e -= 1
        end[i] = e
    # the next piece begins at the strongest boundary within the overlap, else exactly one overlap back
    begin = np.maximum(end - overlap, starts + 1)
    nxt = np.full(len(starts), -1, np.int64)
    for cuts in kinds:
        if len(cuts):
            k = np.searchsorted(cuts, begin, "left")
            c = cuts[np.minimum(k, len(cuts) - 1)]
            ok = (nxt < 0) & (k < len(cuts)) & (c < end) & (c > starts)
            nxt[ok] = c[ok]
    left = nxt < 0
    k = np.minimum(np.searchsorted(starts, begin, "left"), len(starts) - 1)
    nxt[left] = np.where(starts[k] <= end, starts[k], end)[left]
    succ = np.searchsorted(starts, nxt, "left")
    succ = np.where(end >= n, np.arange(len(starts)), np.minimum(succ, len(starts) - 1))
    return starts, end, succ


def _chosen(succ: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """All indices reached from ``heads``, by squaring the successor table."""
    on = np.zeros(len(succ), bool)
    on[heads] = True
    jump = succ.copy()
    while True:
        before = on.sum()
        on[jump[on]] = True
        nxt = jump[jump]
        if on.sum() == before and np.array_equal(nxt, jump):
            return on
        jump = nxt


def split_texts(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces of each text."""
    tables = [_successors(t, limit, overlap) for t in texts]
    heads = np.cumsum([0, *(len(s) for s, _, _ in tables)])
    if not tables:
        return []
    succ = np.concatenate([s + h for (_, _, s), h in zip(tables, heads)])
    on = _chosen(succ, heads[:-1][np.diff(heads) > 0])
    return [[(int(a), int(b)) for a, b in zip(s[w], e[w])] for (s, e, _), h in zip(tables, heads) for w in [on[h : h + len(s)]]]


def pieces(df: DataFrame, key: str, text: str, page: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, page, piece_no, n_pieces, start, stop, text) of every text longer than ``limit`` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    long = df.where(F.col(key).isNotNull() & (F.length(text) > limit)).select(F.col(key).alias("k"), page.alias("page"), F.col(text).alias("t")).dropDuplicates(["k"])
    kinds = dict(long.dtypes)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, hi in portions(list(map(len, pdf["t"])), 256):
                part = pdf.iloc[lo:hi]
                out = [
                    (k, p, i, len(cuts), s, e, t[s:e])
                    for k, p, t, cuts in zip(part["k"], part["page"], part["t"], split_texts(list(part["t"]), limit, overlap))
                    for i, (s, e) in enumerate(cuts)
                ]
                made = pd.DataFrame(out, columns=["k", "page", "piece_no", "n_pieces", "start", "stop", "text"])
                made["page"] = made["page"].astype("Int64")
                yield made

    return long.mapInPandas(go, f"k {kinds['k']}, page {kinds['page']}, piece_no int, n_pieces int, start int, stop int, text string").withColumnRenamed("k", key)
