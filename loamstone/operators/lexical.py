"""BM25 over whitespace terms, and reciprocal-rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.plans.tables import cut, spread

K1, B, EPSILON = 1.5, 0.75, 0.25


def terms(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[Counter[str]]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            counts = []
            for t in part.column(1).to_pylist():
                n = Counter(_SPACE.split(t))
                n.pop("", None)
                counts.append(n)
            yield part, counts


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, counts in _texts(batches):
        row, length = np.repeat(np.arange(len(counts)), [len(n) for n in counts]), np.array([sum(n.values()) for n in counts], np.int32)
        words, tf = pa.array([w for n in counts for w in n], pa.string()), pa.array([k for n in counts for k in n.values()], pa.int32())
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), words, tf, pa.array(length[row], pa.int32())], names=["id", "term", "tf", "dl"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(df), pa.string()), pa.array(list(df.values()), pa.int64())], names=["term", "df"])
        df.clear()
        return out

    for _, counts in _texts(batches):
        for n in counts:
            df.update(n.keys())
        if len(df) > 500_000:
            yield flush()
    yield flush()


def _read(docs: DataFrame) -> DataFrame:
    return spread(docs.where("t is not null").select("id", "t"))


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of docs (id, t), as an index holds them. A text's terms are counted where the text is, so nothing is shuffled for it."""
    return _read(docs).mapInArrow(_postings, f"id {dict(docs.dtypes)['id']}, term string, tf int, dl int")


def statistics(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (n, avgdl, mean_idf) and (term, df, idf) over all terms; a negative idf becomes a share of the mean.

    Document frequencies are summed up in each task before they are shuffled.
    """
    size = docs.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.size(terms(F.col("t")))), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    df = cut(_read(docs).mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")))
    raw = df.join(F.broadcast(size)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # one row on the small side
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return size.join(F.broadcast(mean)), idf


#: Terms of queries sent to the tasks at once (some 100 bytes each); more make more passes over the documents.
SHIPPED_TERMS = 500_000
#: Queries and documents whose scores are in memory at once.
_QUERIES, _DOCS = 1024, 500


class _Asked:
    """A block of weighted queries, and which of them ask for a term."""

    def __init__(self, rows: list[tuple[object, str, float]]):
        self.ids = list(dict.fromkeys(r[0] for r in rows))
        at = {q: i for i, q in enumerate(self.ids)}
        self.parts: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
        for lo in range(0, len(self.ids), _QUERIES):
            found: dict[str, list[tuple[int, float]]] = {}
            for q, t, w in rows:
                if lo <= at[q] < lo + _QUERIES:
                    found.setdefault(t, []).append((at[q] - lo, w))
            self.parts.append({t: (np.array([i for i, _ in x]), np.array([w for _, w in x])) for t, x in found.items()})
        self.terms = {t for p in self.parts for t in p}
        self.kind: pa.DataType = pa.int64()


def _score(asked: _Asked, avgdl: float, k: int, keep_self: bool, kind: pa.DataType):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = np.array(asked.ids, dtype=object)
        least = np.full(len(queries), -np.inf)  # the k-th best score that this task has met
        for batch in batches:
            for lo in range(0, batch.num_rows, _DOCS):
                part = batch.slice(lo, _DOCS)
                ids = np.array(part.column(0).to_pylist(), dtype=object)
                held: dict[str, tuple[list[int], list[float]]] = {}
                for d, t in enumerate(part.column(1).to_pylist()):
                    n = Counter(_SPACE.split(t))
                    n.pop("", None)
                    norm = K1 * (1 - B + B * sum(n.values()) / avgdl) if avgdl else K1
                    for w in n.keys() & asked.terms:
                        docs, parts = held.setdefault(w, ([], []))
                        docs.append(d)
                        parts.append(n[w] * (K1 + 1) / (n[w] + norm))
                arrays = {w: (np.array(x), np.array(y)) for w, (x, y) in held.items()}
                for j, mine in enumerate(asked.parts):
                    base = j * _QUERIES
                    names = queries[base : base + _QUERIES]
                    score, met = np.zeros((len(names), len(ids))), np.zeros((len(names), len(ids)), bool)
                    for w in mine.keys() & arrays.keys():
                        (q, weight), (d, tf) = mine[w], arrays[w]
                        cell = np.ix_(q, d)
                        score[cell] += weight[:, None] * tf
                        met[cell] = True
                    if not keep_self:
                        met &= names[:, None] != ids[None, :]
                    score = np.where(met, np.round(score, 6), -np.inf)
                    if len(ids) > k:
                        least[base : base + len(names)] = np.maximum(least[base : base + len(names)], np.partition(score, -k, axis=1)[:, -k])
                    # all that reach it, ties too
                    q, d = np.nonzero((score >= least[base : base + len(names), None]) & met)
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(names[q].tolist(), asked.kind), pa.array(ids[d].tolist(), kind), pa.array(score[q, d])], names=["query_id", "id", "score"])

    return go


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, keep_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the k best of docs (id, t) for queries (id, t).

    A term that occurs twice in a query counts twice. Documents that share no term with the query aren't ranked. Scores are
    rounded to six places, ties go to the least id.

    The queries are set against all documents in blocks of bounded size: each task scores its documents where their texts are and
    gives only what may be among a query's k best, so that neither postings nor scores of frequent words are shuffled.
    """
    q = queries.select(F.col("id").alias("query_id"), F.explode(terms(F.col("t"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    size, idf = statistics(docs)
    wanted = cut(q.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")))
    avgdl = float(size.first()["avgdl"])
    kinds = {"id": dict(docs.dtypes)["id"], "query_id": dict(queries.dtypes)["id"]}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    read, out = _read(docs), None

    def one(rows: list[tuple[object, str, float]]) -> DataFrame:
        asked = _Asked(rows)
        asked.kind = arrow[kinds["query_id"]]
        return read.mapInArrow(_score(asked, avgdl, k, keep_self, arrow[kinds["id"]]), f"query_id {kinds['query_id']}, id {kinds['id']}, score double")

    block: list[tuple[object, str, float]] = []
    for r in wanted.orderBy("query_id", "term").toLocalIterator():
        if len(block) >= SHIPPED_TERMS and r["query_id"] != block[-1][0]:
            done = cut(one(block))
            out, block = done if out is None else out.unionByName(done), []
        block.append((r["query_id"], r["term"], r["weight"]))
    if block:
        out = one(block) if out is None else out.unionByName(one(block))
    if out is None:
        return docs.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, id {kinds['id']}, score double, rank long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.distinct().withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


class _Block:
    """Texts that are searched for in others, and others in them."""

    GRAM = 8

    def __init__(self, texts: list[str]):
        import ahocorasick

        self.joined = "\x00".join(texts)
        self.automaton = ahocorasick.Automaton()
        for t in texts:
            self.automaton.add_word(t, t)
        self.automaton.make_automaton()
        self.hashes = self._grams(self.joined)
        self.order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[self.order]
        self._short: dict[str, bool] = {}

    def _grams(self, s: str) -> np.ndarray:
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(c) - self.GRAM + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(self.GRAM):
                h = h * np.uint64(0x9E3779B97F4A7C15) + c[j : j + n]
        return h

    def within(self, t: str) -> bool:
        """Whether one of the block's texts holds ``t``."""
        if len(t) < self.GRAM:
            if t not in self._short:
                if len(self._short) > 100_000:
                    self._short.clear()
                self._short[t] = t in self.joined
            return self._short[t]
        g = self._grams(t)
        # the rarest of its grams tells where it may stand
        lo, hi = np.searchsorted(self.hashes, g), np.searchsorted(self.hashes, g, "right")
        k = int((hi - lo).argmin())
        return any(self.joined.startswith(t, int(p) - k) for p in self.order[lo[k] : hi[k]] if p >= k)

    def holds_one(self, t: str) -> bool:
        """Whether ``t`` holds one of the block's texts."""
        return next(self.automaton.iter(t), None) is not None


#: Characters of texts searched for that are sent to the tasks at once; more make more passes.
SEARCHED = 4_000_000


def highlights(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of rows (id, t) whose text holds, or lies in, the text of one of ``chunks`` (t), whatever the case.

    Empty and NULL texts meet nothing. The chunks are searched for in blocks of bounded size.
    """
    out, block, size = None, [], 0
    rows = rows.where("t <> ''").select("id", F.lower("t").alias("t"))
    kind = dict(rows.dtypes)["id"]

    def one(texts: list[str]) -> DataFrame:
        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = _Block(texts)
            for pdf in batches:
                yield pdf.loc[[b.holds_one(t) or b.within(t) for t in pdf["t"]], ["id"]]

        return rows.mapInPandas(go, f"id {kind}")

    for r in chunks.where("t <> ''").select(F.lower("t").alias("t")).distinct().orderBy("t").toLocalIterator():
        if block and size + len(r["t"]) > SEARCHED:
            done = cut(one(block))
            out, block, size = done if out is None else out.unionByName(done), [], 0
        block.append(r["t"])
        size += len(r["t"])
    if block:
        out = one(block) if out is None else out.unionByName(one(block))
    return out.distinct() if out is not None else rows.select("id").limit(0)


def fuse(lists: list[DataFrame], weights: list[float], k: int, rrf_k: int = 60, text: str = "text") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (query_id, id, text, rank): (query_id, id, text, score, rank).

    Equal texts are one entry, also within a list, where their shares add up; the entry's id is the least. Ties go to the
    list that comes first, then to its order.
    """
    rows = None
    for i, (d, w) in enumerate(zip(lists, weights)):
        part = d.select("query_id", "id", text, (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("share"), (F.lit(i * 1_000_000) + F.col("rank")).alias("pos"))
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.groupBy("query_id", text).agg(F.round(F.sum("share"), 9).alias("score"), F.min("id").alias("id"), F.min("pos").alias("pos"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "pos", "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).drop("pos")
