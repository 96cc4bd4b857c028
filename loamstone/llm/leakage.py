"""Evaluation items leaking into a corpus: BM25 over test items with block-max WAND.

The test items form an inverted index with BM25 weights. Every passage of every document (``PASSAGE``
words, each ``STRIDE`` words, so that any ``run`` successive words lie within one passage) is a query to
it. Per item the threshold is the least score that ``run`` successive words of that item can have, so
retrieval of all items above their threshold loses no passage that holds such words. Retrieved candidates
are then verified word by word, and the shares of the item's question and of its answer in the verified runs are reported. The
question is what comes up to the last question mark (all of an item without one), the answer what follows.

WAND runs in two levels: a bound from the words' largest weights, taken for all passages of a batch
at once, drops those that can reach no threshold; the others walk the postings in item blocks, whose
own largest weights let whole blocks be passed over.

Words are runs of letters or digits, compared by their folded case. Defined results: NULL or empty texts
match nothing; items of fewer than ``run`` words cannot leak; repeated rows count once.

The index is shipped to every task, so its size is checked: more than ``SHIPPED`` bytes of item text
are cut into groups of items, and the corpus is read once per group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions
from loamstone.plans.tables import spread

RUN, PASSAGE, STRIDE = 12, 24, 12
SHIPPED = 32_000_000
_WORD = re.compile(r"[^\W_]+")
_K1, _B = 1.2, 0.75
#: Items of one block of a posting list.
_BLOCK = 16


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


class Index:
    def __init__(self, items: list[tuple[object, list[str]]], run: int = RUN, asked: list[int] | None = None):
        self.run = run
        #: Words of each item's question.
        self.asked = asked or [len(w) for _, w in items]
        self.keys = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.vocab: dict[str, int] = {}
        for w in self.words:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab))
        n, average = len(items), sum(map(len, self.words)) / max(1, len(items))
        tf: list[dict[int, int]] = [{} for _ in range(len(self.vocab))]
        for d, w in enumerate(self.words):
            for x in w:
                t = tf[self.vocab[x]]
                t[d] = t.get(d, 0) + 1
        self.items: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.blocks: list[dict[int, float]] = []
        for t in tf:
            ds = np.fromiter(t, np.int64, len(t))
            f = np.fromiter(t.values(), float, len(t))
            size = np.array([len(self.words[d]) for d in ds])
            weight = math.log(1 + (n - len(t) + 0.5) / (len(t) + 0.5)) * f * (_K1 + 1) / (f + _K1 * (1 - _B + _B * size / average))
            self.items.append(ds)
            self.weights.append(weight)
            best: dict[int, float] = {}
            for d, x in zip((ds // _BLOCK).tolist(), weight.tolist()):
                best[d] = max(best.get(d, 0.0), x)
            self.blocks.append(best)
        self.most = np.array([w.max() for w in self.weights] + [0.0])  # the last: words of no item
        weight_of = [dict(zip(d.tolist(), w.tolist())) for d, w in zip(self.items, self.weights)]
        self.threshold = np.full(n, np.inf)
        self.ids: list[list[int]] = []
        self.starts: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for d, w in enumerate(self.words):
            ids = [self.vocab[x] for x in w]
            self.ids.append(ids)
            for i in range(len(ids) - run + 1):
                self.starts.setdefault(tuple(ids[i : i + run]), []).append((d, i))
                self.threshold[d] = min(self.threshold[d], sum(weight_of[x][d] for x in set(ids[i : i + run])))
        self.threshold -= 1e-9
        self.weight_of = weight_of
        self.least = float(self.threshold.min(initial=np.inf))
        blocks = -(-n // _BLOCK)
        self.block_least = [float(self.threshold[b * _BLOCK : (b + 1) * _BLOCK].min(initial=np.inf)) for b in range(blocks)]

    def search(self, terms: set[int]) -> list[int]:
        """Items whose score for the query ``terms`` reaches their threshold."""
        order = sorted(terms, key=lambda t: -self.most[t])
        bound: dict[int, float] = {}
        for t in order:
            for b, x in self.blocks[t].items():
                bound[b] = bound.get(b, 0.0) + x
        found = []
        for b, x in bound.items():
            if x < self.block_least[b]:
                continue  # no item of the block can reach its threshold
            for d in range(b * _BLOCK, min((b + 1) * _BLOCK, len(self.keys))):
                if x < self.threshold[d]:
                    continue
                score, rest = 0.0, x
                for t in order:
                    rest -= self.blocks[t].get(b, 0.0)
                    score += self.weight_of[t].get(d, 0.0)
                    if score + rest < self.threshold[d] - 1e-6:
                        break
                if score >= self.threshold[d]:
                    found.append(d)
        return found

    def verify(self, ids: list[int], candidates: list[int]) -> dict[int, tuple[int, int, int]]:
        """Of the candidate items, those with ``run`` successive words in ``ids``: words of its question and of its answer in such runs, and where the first begins."""
        wanted, first, found = set(candidates), {}, {}
        for i in range(len(ids) - self.run + 1):
            for d, j in self.starts.get(tuple(ids[i : i + self.run]), ()):
                if d in wanted:
                    first.setdefault(d, i)
                    found.setdefault(d, bytearray(len(self.ids[d])))[j : j + self.run] = b"\x01" * self.run
        return {d: (f[: self.asked[d]].count(1), f[self.asked[d] :].count(1), first[d]) for d, f in found.items()}


def _search(items: list[tuple[object, str]], run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([(k, words(t)) for k, t in items], run, [len(words(t[: t.rindex("?") + 1] if "?" in t else t)) for _, t in items])
        unknown = len(index.vocab)
        get = index.vocab.get
        passage, stride = 2 * run, run
        for batch in batches:
            found: list[tuple[object, ...]] = []
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in portions(pc.binary_length(texts).to_pylist(), 500):
                ids: list[int] = []
                sizes = []
                for t in texts.slice(lo, hi - lo).to_pylist():
                    w = words(t)
                    ids += map(get, w)  # type: ignore[arg-type]
                    sizes.append(len(w))
                arr = np.array([unknown if x is None else x for x in ids], np.int32)
                off = np.concatenate([[0], np.cumsum(sizes)])
                total = np.concatenate([[0.0], np.cumsum(index.most[arr])])
                owner = np.repeat(np.arange(len(sizes)), [max(1, -(-n // stride)) for n in sizes])
                first = np.concatenate([np.arange(max(1, -(-n // stride))) * stride for n in sizes]) if sizes else np.zeros(0, int)
                start = off[owner] + first
                stop = np.minimum(start + passage, off[owner + 1])
                hopeful = np.flatnonzero(total[stop] - total[start] >= index.least)
                by_doc: dict[int, set[int]] = {}
                score_terms = 0
                for p in hopeful.tolist():
                    terms = set(arr[start[p] : stop[p]].tolist())
                    terms.discard(unknown)
                    if sum(index.most[t] for t in terms) >= index.least:
                        score_terms += 1
                        hits = index.search(terms)
                        if hits:
                            by_doc.setdefault(int(owner[p]), set()).update(hits)
                for o, cand in by_doc.items():
                    for d, (q, a, at) in index.verify(arr[off[o] : off[o + 1]].tolist(), list(cand)).items():
                        n, asked = len(index.words[d]), index.asked[d]
                        found.append((keys[lo + o], index.keys[d], q + a, (q + a) / n, q / asked if asked else None, a / (n - asked) if n > asked else None, at))
            types = (batch.column(0).type, pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=["doc", "item", "shared_words", "item_share", "question_share", "answer_share", "at_word"])

    return go


def item_groups(items: DataFrame, key: str, text: str, shipped: int = SHIPPED) -> list[list[tuple[object, str]]]:
    """The items in groups of at most ``shipped`` characters, each small enough to send to every task."""
    groups: list[list[tuple[object, str]]] = [[]]
    size = 0
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long"), text).distinct().orderBy(key)
    for k, t in rows.toLocalIterator():
        if size + len(t) > shipped and groups[-1]:
            groups.append([])
            size = 0
        groups[-1].append((k, t))
        size += len(t)
    return groups


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str, run: int = RUN) -> DataFrame:
    """(doc, item, shared_words, item_share, question_share, answer_share, at_word): documents that hold ``run`` successive words of an item.

    Shares are of the words of the item, its question and its answer that lie in such runs; a part without words has none (NULL).
    """
    d = spread(docs.where(F.col(doc_key).isNotNull() & F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("t")))
    out = None
    for group in item_groups(items, item_key, item_text):
        part = d.mapInArrow(_search(group, run), f"doc {dict(d.dtypes)['doc']}, item long, shared_words int, item_share double, question_share double, answer_share double, at_word int")
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["doc", "item"])
