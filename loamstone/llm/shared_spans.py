"""Long exact spans shared between records.

Units are hashed, digests grouped over all records, and every later occurrence is tied back to the
others with its offsets kept. Lines or paragraphs cannot serve as units here, as a shared span may begin
and end inside a line; the units are windows of ``gram`` bytes picked by their content (the local minimum
of their hashes), of which every run of ``run`` characters holds at least one in both records.

Pairs whose shared units chain up to ``run`` characters on one diagonal are proven by offsets alone; the
others are compared as texts. A unit found in more than ``HOT`` records is replaced by all windows of
the full ``run`` around each of its places, so that only records that share a whole run meet.

Defined results: NULL and short texts share nothing; repeated rows of an id count once; records with equal
texts of enough length are pairs like any others; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.llm.lookup import needed, portions, sorted_groups, with_texts
from loamstone.llm.winnow import Winnower, mix
from loamstone.plans.tables import cut, spread

RUN, GRAM = 300, 200
#: Records of a group that are paired by their units alone.
HOT = 64
#: Records of one batch from which a unit is set apart before the others are grouped in tasks.
LOCAL_HOT = 32


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; NULL is empty."""
    col = pa.compute.fill_null(col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _characters(data: np.ndarray, off: np.ndarray, i: np.ndarray, p: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size, in whole characters, of the units at byte ``p`` of text ``i``."""
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = off[i] + p
    stop = at + gram
    broken = (stop < len(data)) & ((data[np.minimum(stop, len(data) - 1)] & 0xC0) == 0x80)
    return (lead[at] - lead[off[i]]).astype(np.int64), lead[stop] - broken - lead[at]


def _units(run: int, gram: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Winnower(run, gram)
        for batch in (b.slice(lo, hi - lo) for b in batches for lo, hi in portions(pc.binary_length(b.column(1)).to_pylist(), 20_000)):
            data, off = text_buffers(batch.column(1))
            i, p, h = w(data, off)
            if not len(i):
                continue
            first = pd.Series(np.arange(len(i))).groupby([i, h], sort=False).first().to_numpy()  # one occurrence a record
            i, p, h = i[first], p[first], h[first]
            start, size = _characters(data, off, i, p, gram)
            _, which, n = np.unique(h, return_inverse=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column(0).take(pa.array(i)), pa.array(start << 10 | size), pa.array(n[which] >= LOCAL_HOT)], names=["h", "doc", "place", "hot"]
            )

    return go


def _meet(kind: pa.DataType):
    """Pairs of records per unit, for rows sorted by unit; rows of larger groups come out unpaired (b NULL)."""
    names = ["h", "a", "b", "place", "other"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False  # the first group of a portion has begun to come out unpaired
        for r, ended in sorted_groups(batches, ("h",), HOT):
            h, doc, place = r["h"], r["doc"], r["place"]
            begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            size = np.diff(np.r_[begin, len(h)])
            large = size > HOT
            large[0] |= begun
            large[-1] |= not ended
            if large.any():
                apart = np.repeat(large, size)
                apart[0] &= not begun  # has come out already
                x = np.flatnonzero(apart)
                yield pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(doc[x], kind), pa.nulls(len(x), kind), pa.array(place[x]), pa.array(place[x])], names=names)
            begun = not ended
            small = ~large & (size > 1)
            for n in np.unique(size[small]).tolist():
                rows = begin[small & (size == n)][:, None] + np.arange(n)
                x, y = np.triu_indices(n, 1)
                step = max(1, 200_000 // len(x))
                for lo in range(0, len(rows), step):
                    p, q = rows[lo : lo + step][:, x].reshape(-1), rows[lo : lo + step][:, y].reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(h[p]), pa.array(doc[p], kind), pa.array(doc[q], kind), pa.array(place[p]), pa.array(place[q])], names=names)

    return go


def grams(text: str, run: int) -> np.ndarray:
    """Hashes of every ``run`` characters of ``text``."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(c) < run:
        return np.zeros(0, np.uint64)
    from loamstone.llm.winnow import _powers

    p, q = _powers(len(c) + 1)
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * p[:-1])])
        return mix((s[run:] - s[:-run]) * q[: len(c) - run + 1])


def stretches(ga: np.ndarray, gb: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, n): the ``n`` windows of a from i on are those of b from j on; together they hold every window of a that b has."""
    order = np.argsort(gb, kind="stable")
    at = np.searchsorted(gb[order], ga)
    hits = np.flatnonzero(gb[order][np.minimum(at, len(gb) - 1)] == ga) if len(gb) else np.zeros(0, int)
    k = 0
    while k < len(hits):
        i = int(hits[k])
        j = int(order[at[i]])
        n = min(len(ga) - i, len(gb) - j)
        unlike = np.flatnonzero(ga[i : i + n] != gb[j : j + n])
        n = int(unlike[0]) if len(unlike) else n
        yield i, j, n
        k = int(np.searchsorted(hits, i + n))


def _compare(run: int, spans: bool):
    """Which pairs share ``run`` characters; or (``spans``) what each of the two holds of the other."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                ga, gb = grams(ta, run), grams(tb, run)
                in_b = np.flatnonzero(np.isin(ga, gb))
                if not len(in_b) or ta[in_b[0] : in_b[0] + run] not in tb:
                    continue
                if spans:
                    for x, y, gx, gy in ((a, b, ga, gb), (b, a, gb, ga)):
                        for i, j, n in stretches(gx, gy):
                            head = int(gx[i : i + 1].view(np.int64)[0])
                            out += [(x, y, i, i + n - 1 + run, head), (y, x, j, j + n - 1 + run, head)]
                else:
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["doc", "other", "start", "stop", "head"] if spans else ["a", "b"])

    return go


def _hot_windows(run: int, gram: int):
    """All windows of ``run`` characters that hold one of the record's hot units, wherever in the record the unit stands."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = Winnower(run, gram)
        for pdf in batches:
            for doc, text, units in zip(pdf["doc"], pdf["text"], pdf["units"]):
                data, off = text_buffers(pa.array([text]))
                i, p, h = w(data, off)
                here = np.isin(h.view(np.int64), units)
                start, size = _characters(data, off, i[here], p[here], gram)
                g = grams(text, run)
                # +1 where the windows around a unit begin, -1 behind them
                edge = np.zeros(len(g) + 1, np.int64)
                np.add.at(edge, np.clip(start + size - run, 0, len(g)), 1)
                np.add.at(edge, np.clip(start + 1, 0, len(g)), -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                yield pd.DataFrame({"h": g[at].view(np.int64), "doc": doc, "at": at.astype(np.int32)})

    return go


class _Meetings:
    """Records that meet: ``pairs`` by cold units, with the longest stretch proven (a, b, best); ``windows`` of hot ones."""

    def __init__(self, df: DataFrame, key: str, text: str, run: int, gram: int):
        self.docs = docs = df.where(F.col(key).isNotNull() & (F.length(text) >= run)).select(F.col(key).alias("doc"), F.col(text).alias("text"))
        self.kind = kind = dict(docs.dtypes)["doc"]
        units = cut(spread(docs).mapInArrow(_units(run, gram), f"h long, doc {kind}, place long, hot boolean"))
        # units that are frequent even within a batch are set apart, so that no task below gathers a large group
        apart = units.where("hot").select("h").distinct()
        cold = units.join(apart, "h", "left_anti").select("h", "doc", "place")
        met = cut(cold.repartition("h").sortWithinPartitions("h").mapInArrow(_meet(_arrow(kind)), f"h long, a {kind}, b {kind}, place long, other long"))
        at, size = lambda c: F.shiftright(c, 10), lambda c: F.col(c).bitwiseAND(1023)
        found = met.where("b is not null").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.when(F.col("a") < F.col("b"), 1).otherwise(-1) * (at("place") - at("other"))).alias("diagonal"),
            at(F.when(F.col("a") < F.col("b"), F.col("place")).otherwise(F.col("other"))).cast("int").alias("start"), size("place").cast("int").alias("size"),
        ).where("a <> b")
        # the longest stretch of one diagonal that overlapping units cover without a gap
        longest = F.expr(
            "aggregate(array_sort(collect_list(struct(start, start + size as stop))), struct(0 as s, -1 as e, 0 as best),"
            " (m, u) -> case when u.start <= m.e then struct(m.s as s, greatest(m.e, u.stop) as e, greatest(m.best, greatest(m.e, u.stop) - m.s) as best)"
            " else struct(u.start as s, u.stop as e, greatest(m.best, u.stop - u.start) as best) end, m -> m.best)"
        )
        self.pairs = cut(found.groupBy("a", "b", "diagonal").agg(longest.alias("best")).groupBy("a", "b").agg(F.max("best").alias("best")))
        hot = met.where("b is null").select("h", F.col("a").alias("doc")).unionByName(units.join(apart, "h", "left_semi").select("h", "doc"))
        self.windows = None
        if not hot.isEmpty():
            around = hot.groupBy("doc").agg(F.collect_set("h").alias("units"))
            # distinct, as a record delivered twice would count twice among the holders and cancel itself out of their xors
            self.windows = cut(needed(docs, around.select("doc")).join(around, "doc").mapInPandas(_hot_windows(run, gram), f"h long, doc {kind}, at int").distinct())

    def holders(self) -> DataFrame:
        """Per hot window in several records: their number and least, and what tells their set (x, y)."""
        w = self.windows.select("h", "doc").distinct()
        return w.groupBy("h").agg(F.count("*").alias("n"), F.min("doc").alias("first"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).where("n > 1")


def shared_pairs(df: DataFrame, key: str, text: str, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """Distinct (a, b), a < b, of records whose texts have ``run`` successive characters in common."""
    m = _Meetings(df, key, text, run, gram)
    sure = m.pairs.where(F.col("best") >= run).select("a", "b")
    unsure = m.pairs.where(F.col("best") < run).select("a", "b")
    compared = with_texts(unsure, m.docs).select("a", "b", "ta", "tb").mapInPandas(_compare(run, False), f"a {m.kind}, b {m.kind}")
    if m.windows is None:
        return sure.unionByName(compared).distinct()
    # Neighbouring windows are mostly held by the same records, so one window stands for all that have the same holders. Records
    # that share one meet because they share a whole run: each pair is a result.
    one = m.holders().groupBy("n", "x", "y").agg(F.min("h").alias("h")).select("h")
    w = cut(m.windows.select("h", "doc").distinct().join(one, "h", "left_semi"))
    from_hot = w.select("h", F.col("doc").alias("a")).join(w.select("h", F.col("doc").alias("b")), "h").where("a < b").select("a", "b").distinct()
    return sure.unionByName(compared).unionByName(from_hot).distinct()


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _stretches(df: DataFrame, key: str, text: str, run: int, gram: int) -> DataFrame:
    """(doc, start, stop, head, first): stretches of ``doc`` that other records hold; ``first`` is the least of those known to.

    Of a hot group no pairs are made: a stretch of it is a row of windows with the same holders. ``head`` is the hash of the
    first window, which with the length tells equal stretches.
    """
    m = _Meetings(df, key, text, run, gram)
    cold = with_texts(m.pairs.select("a", "b"), m.docs).select("a", "b", "ta", "tb").mapInPandas(_compare(run, True), f"doc {m.kind}, other {m.kind}, start int, stop int, head long")
    out = cold.groupBy("doc", "start", "stop", "head").agg(F.least("doc", F.min("other")).alias("first"))
    if m.windows is None:
        return out
    w = m.windows.join(m.holders(), "h")
    row = F.row_number().over(Window.partitionBy("doc", "n", "x", "y").orderBy("at"))
    hot = w.withColumn("row", F.col("at") - row).groupBy("doc", "n", "x", "y", "row").agg(F.min("at").alias("start"), (F.max("at") + run).alias("stop"), F.min_by("h", "at").alias("head"), F.min("first").alias("first"))
    return out.unionByName(hot.select("doc", "start", "stop", "head", "first"))


def shared_spans(df: DataFrame, key: str, text: str, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """(span_id, doc, start, stop, n_docs): the spans that several records hold, and each record that holds one, with its place there.

    Rows grow with the number of records, not of pairs. A record may hold parts of a span as spans shared with further ones.
    """
    s = cut(_stretches(df, key, text, run, gram).select("doc", "start", "stop", F.xxhash64("head", F.col("stop") - F.col("start")).alias("span_id")).distinct())
    return s.join(s.groupBy("span_id").agg(F.countDistinct("doc").alias("n_docs")), "span_id").select("span_id", "doc", "start", "stop", "n_docs")


def shared_portion(df: DataFrame, key: str, text: str, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """Per record: its characters, how many lie in a span shared elsewhere and in how many stretches, and what isn't kept here.

    ``kept_elsewhere`` counts the characters whose earliest holder (least id) is another record: what a
    removal that keeps the earliest occurrence would take out.
    """
    spans = cut(_stretches(df, key, text, run, gram).select("doc", "start", "stop", "first"))

    def covered(s: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("doc").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
        seen = s.withColumn("seen", F.coalesce(F.max("stop").over(w), F.lit(-1)))
        return seen.groupBy("doc").agg(
            F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("seen", "start"))).alias(name), F.count_if(F.col("start") > F.col("seen")).alias(f"{name}_in")
        )

    both = covered(spans.select("doc", "start", "stop").distinct(), "shared_chars").join(
        covered(spans.where("first < doc").select("doc", "start", "stop").distinct(), "kept_elsewhere"), "doc", "left"
    )
    sizes = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc")).agg(F.max(F.coalesce(F.length(text), F.lit(0))).alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return sizes.join(both, "doc", "left").select(
        F.col("doc").alias(key), "n_chars", zero("shared_chars").alias("shared_chars"), zero("shared_chars_in").alias("n_stretches"), zero("kept_elsewhere").alias("kept_elsewhere"),
        F.round(zero("shared_chars") / F.greatest("n_chars", F.lit(1)), 6).alias("shared_fraction"),
    )
