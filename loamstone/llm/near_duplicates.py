"""Near-duplicate texts: all pairs whose word-shingle sets reach a similarity, without pairwise comparison.

PartEnum signatures were tried first and measured: at Jaccard 0.7 they need 60 to 165 signatures a record,
and as small partitions often hold common shingles only, the candidates grow with the square of the data (README).
The signatures here take the partition of the domain to its finest, single shingles, and choose them by
rarity: of two sets A and B with similarity t or more, the |A| - ceil(t|A|) + 1 rarest shingles of A and those of B, by any
common order, have one in common, and the closer their sizes, the more they must have. No pair is lost by it, whatever the order; counts of all shingles of the whole column (in
a table of fixed size) make the order a good one.

A signature whose count in that table tells it to be in an uncommon share of all sets (``COMMON``), or that turns out to be in more
than ``BLOCK`` sets when its sets are gathered in sorted order, is counted exactly; its sets form blocks, of which each two
are compared by themselves. What is sent for a set thus doesn't depend on how full the count table is.

Records that share a signature are compared in arrays: sizes, and a parity sketch of 128 bits, whose differing bits never
outnumber the differing shingles, rule out most others, as does a shingle whose places in both orders are too far apart; how many signatures a pair shares in all rules out nearly all
the rest before the exact comparison. Sets that are equal are handled as one set with several members.

Defined results: NULL texts and texts of fewer than ``least_words`` words are in no pair; repeated rows of a key
count once; equal texts are pairs of similarity 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions, sorted_groups, with_texts
from loamstone.llm.winnow import mix
from loamstone.plans.tables import cut, spread

SHINGLE, SIMILARITY, LEAST_WORDS = 5, 0.8, 1
#: Buckets of the table of shingle counts.
BUCKETS = 1 << 20
#: Sets that may share one signature in one task; more are compared block against block in several.
BLOCK = 3000
#: Share of the texts from which on a signature is set apart before its sets are gathered.
COMMON = 1 / 200
#: Low bits of a shingle's hash that its signature leaves out; 44 bits tell signatures apart.
_SPARE = np.uint64(20)
_CHUNK = 1000
_PAIRS = 1_000_000


class Shingler:
    """Hashes of the word n-grams of many texts at once; words are looked up, not hashed, when seen before."""

    def __init__(self, n: int):
        self.n = n
        self._ids: dict[str, int] = {}
        self._hash = np.zeros(0, np.uint64)
        rng = np.random.default_rng(11)
        self._mult = rng.integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and hash of every n-gram, and the number of words of each text."""
        if len(self._ids) > 1_000_000:
            self._ids = {}
        ids: list[int] = []
        sizes = np.zeros(len(texts), np.int64)
        add = self._ids.setdefault
        have = self._ids
        for i, t in enumerate(texts):
            w = t.lower().split()
            sizes[i] = len(w)
            ids += [add(x, len(have)) for x in w]
        if len(self._hash) != len(have):
            self._hash = pd.util.hash_array(np.array(list(have), dtype=object)) if have else np.zeros(0, np.uint64)
        h = self._hash[np.array(ids, np.int64)] if ids else np.zeros(0, np.uint64)
        m = len(h) - self.n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), sizes
        with np.errstate(over="ignore"):
            g = np.zeros(m, np.uint64)
            for j in range(self.n):
                g += h[j : j + m] * self._mult[j]
            g = mix(g)
        row = np.repeat(np.arange(len(texts)), sizes)
        whole = row[:m] == row[self.n - 1 :]
        return row[:m][whole], g[whole], sizes


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    for lo, hi in portions(pc.binary_length(batch.column(1)).to_pylist(), _CHUNK):
        yield lo, batch.column(1).slice(lo, hi - lo).to_pylist()


def _count(n: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, texts in _texts(batch):
                _, g, _ = shingle(texts)
                total += np.bincount((g >> _SPARE).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int32))], names=["bucket", "n"])

    return go


def prefix_length(size: np.ndarray, similarity: float) -> np.ndarray:
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def _signatures(n: int, similarity: float, least_words: int, counts: np.ndarray, common: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        told: set[int] = set()
        for batch in batches:
            for lo, texts in _texts(batch):
                row, g, words = shingle(texts)
                keep = words[row] >= least_words
                row, g = row[keep], g[keep]
                if not len(row):
                    continue
                often = counts[(g >> _SPARE).astype(np.int64) % BUCKETS]
                order = np.lexsort((g, often, row))
                row, g, often = row[order], g[order], often[order]
                first = np.r_[True, (row[1:] != row[:-1]) | (g[1:] != g[:-1])]
                row, g, often = row[first], g[first], often[first]
                begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                size = np.diff(np.r_[begin, len(row)])
                with np.errstate(over="ignore"):
                    whole = mix(np.add.reduceat(mix(g + np.uint64(7)), begin) + size.astype(np.uint64))
                sketch = [np.bitwise_xor.reduceat(np.where((g & np.uint64(64)) == w, np.uint64(1) << (g & np.uint64(63)), np.uint64(0)), begin) for w in (0, 64)]
                rank = np.arange(len(row)) - np.repeat(begin, size)
                prefix = prefix_length(size, similarity)
                new = []
                for s in whole.tolist():  # a set's signatures are sent once a task, however many copies there are
                    new.append(s not in told)
                    told.add(s)
                if len(told) > 1_000_000:
                    told.clear()
                new_arr = np.array(new)
                # a shingle counted once is in no other set
                take = (rank < np.repeat(prefix, size)) & np.repeat(new_arr, size) & (often > 1)
                n_take = np.add.reduceat(take.astype(np.int64), begin)
                offsets = pa.array(np.r_[0, np.cumsum(n_take)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(lo + row[begin])), pa.array(whole.view(np.int64)), pa.array(size.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in sketch),
                        pa.ListArray.from_arrays(offsets, pa.array((g[take] >> _SPARE).astype(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(often[take] > common)), pa.ListArray.from_arrays(offsets, pa.array(rank[take].astype(np.int32))),
                    ],
                    names=["doc", "set", "size", "sketch", "sketch2", "tokens", "apart", "ranks"],
                )

    return go


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray, early: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with its sum of n and whether any was early."""
    order = np.lexsort((b, a))
    a, b, n, need, early = a[order], b[order], n[order], need[order], early[order]
    begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[begin], b[begin], np.add.reduceat(n, begin), need[begin], np.logical_or.reduceat(early, begin)


_MET = "a long, b long, n int, need int, early boolean"
_ASIDE = ", token long, place long, sketch long, sketch2 long"


def _candidates(similarity: float, first: bool):
    """Pairs of sets (a, b), how many signatures of this partition they share (n), and how many they must share in all (need).

    Rows, sorted by token and block: token, set, place, sketch; place holds the set's size and the rank of the
    signature in it. Of two similar sets with o or more shingles in common, at least o - max(ceil(t|A|), ceil(t|B|)) + 1 of
    these are among the signatures of both, and the first of them leaves o - 1 or more shingles after it in each (early).

    ``first``: rows of groups of more than ``BLOCK`` sets come out as they are (b NULL). Otherwise the rows have a block that
    says which two blocks of sets meet (below 0: one within itself), and ``own``, the block of the set.
    """
    share = similarity / (1 + similarity)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        names = ["a", "b", "n", "need", "early", *(["token", "place", "sketch", "sketch2"] if first else [])]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if out:
                a, b, n, need, early = _summed(*(np.concatenate(x) for x in zip(*out)))
                out.clear()
                held = 0
                cols = [pa.array(a), pa.array(b), pa.array(n.astype(np.int32)), pa.array(need.astype(np.int32)), pa.array(early)]
                yield pa.RecordBatch.from_arrays(cols + [pa.nulls(len(a), pa.int64())] * (4 if first else 0), names=names)

        def aside(r: dict[str, np.ndarray]) -> pa.RecordBatch:
            none = [pa.nulls(len(r["token"]), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(r["set"]), *none, *(pa.array(r[c]) for c in names[5:])], names=names)

        begun = False  # the first group of a portion has begun to come out as it is
        for r, ended in sorted_groups(batches, ("token",) if first else ("token", "block"), BLOCK if first else math.inf):
            changes = r["token"][1:] != r["token"][:-1]
            if not first:
                changes = changes | (r["block"][1:] != r["block"][:-1])
            begin = np.flatnonzero(np.r_[True, changes])
            m = np.diff(np.r_[begin, len(r["token"])])
            keep = np.repeat(m > 1, m)
            if first:
                large = m > BLOCK
                large[0] |= begun
                large[-1] |= not ended
                if large.any():
                    apart = np.repeat(large, m)
                    keep &= ~apart
                    apart[0] &= not begun  # has come out already
                    yield aside({c: v[apart] for c, v in r.items()})
                begun = not ended
            if not keep.any():
                continue
            m = m[keep[begin]]
            r = {c: v[keep] for c, v in r.items()}
            group = np.repeat(np.arange(len(m)), m)
            order = np.lexsort((r["set"], group))
            # copies of a set sent by several tasks are one
            again = (np.diff(group[order]) == 0) & (np.diff(r["set"][order]) == 0)
            order = order[np.r_[True, ~again]]
            m = np.bincount(group[order])
            begin = np.cumsum(m) - m
            r = {c: v[order] for c, v in r.items()}
            token, ident, place = r["token"], r["set"], r["place"]
            sketch, sketch2 = r["sketch"].view(np.uint64), r["sketch2"].view(np.uint64)
            size, rank = place >> 24, place & ((1 << 24) - 1)
            floor = np.ceil(similarity * size - 1e-9).astype(np.int64)
            # row r is paired with the rows after it in its group; rows are taken in runs of about _PAIRS pairs
            last = np.repeat(begin + m, m)
            ahead = last - np.arange(len(token)) - 1
            ends = np.cumsum(ahead)
            lo = 0
            while lo < len(token):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PAIRS, "right")))
                k = ahead[lo:hi]
                x = np.repeat(np.arange(lo, hi), k)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
                lo = hi
                if not len(x):
                    continue
                a, b = size[x], size[y]
                ok = (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9) & (ident[x] != ident[y])
                if not first:
                    ok &= (r["block"][x] < 0) | (r["own"][x] != r["own"][y])
                x, y, a, b = x[ok], y[ok], a[ok], b[ok]
                common = np.ceil(share * (a + b) - 1e-9).astype(np.int64)
                i, j = rank[x], rank[y]
                ok = np.minimum(i, j) + 1 + np.minimum(a - i - 1, b - j - 1) >= common
                x, y, a, b, common = x[ok], y[ok], a[ok], b[ok], common[ok]
                apart = np.bitwise_count(sketch[x] ^ sketch[y]).astype(np.int64) + np.bitwise_count(sketch2[x] ^ sketch2[y])
                ok = apart <= a + b - 2 * common
                x, y, common = x[ok], y[ok], common[ok]
                if len(x):
                    need = np.maximum(1, common - np.maximum(floor[x], floor[y]) + 1)
                    early = np.minimum(size[x] - rank[x], size[y] - rank[y]) >= common
                    out.append(_summed(np.minimum(ident[x], ident[y]), np.maximum(ident[x], ident[y]), np.ones(len(x), np.int64), need, early))
                    held += len(out[-1][0])
                    if held > 1_000_000:
                        yield from flush()
        yield from flush()

    return go


def _verify(n: int, similarity: float):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sa, sb, ta, tb in zip(pdf["sa"], pdf["sb"], pdf["ta"], pdf["tb"]):
                a, b = ta.lower().split(), tb.lower().split()
                x, y = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}, {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
                both = len(x & y)
                either = len(x) + len(y) - both
                if either and both >= similarity * either - 1e-9:
                    out.append((sa, sb, both / either))
            yield pd.DataFrame(out, columns=["sa", "sb", "similarity"])

    return go


class Similar:
    """``members`` (doc, set): which records have which set; ``links`` (sa, sb, similarity): pairs of different sets."""

    def __init__(self, df: DataFrame, key: str, text: str, n: int = SHINGLE, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS):
        docs = spread(df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc"), F.col(text).alias("text")))
        kind = dict(docs.dtypes)["doc"]
        rows = docs.mapInArrow(_count(n), "bucket int, n int").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(BUCKETS, np.int64)
        counts[rows["bucket"].to_numpy().astype(np.int64)] = rows["n"].to_numpy().astype(np.int64)
        # above what chance puts into a bucket, and above an uncommon share of the texts
        common = max(BLOCK, int(COMMON * docs.count()), 4 * int(counts.sum()) // BUCKETS)
        sets = cut(docs.mapInArrow(_signatures(n, similarity, max(least_words, n), np.minimum(counts, 2**31 - 1).astype(np.int32), common), f"doc {kind}, set long, size int, sketch long, sketch2 long, tokens array<long>, apart array<boolean>, ranks array<int>"))
        self.members = sets.groupBy("doc").agg(F.min("set").alias("set"))
        sent = sets.where(F.size("tokens") > 0).select("set", "size", "sketch", "sketch2", F.explode(F.arrays_zip("tokens", "apart", "ranks")).alias("t")).select(
            F.col("t.tokens").alias("token"), F.col("t.apart").alias("apart"), "set", (F.shiftleft(F.col("size").cast("long"), 24) + F.col("t.ranks")).alias("place"), "sketch", "sketch2"
        )
        ours = ["token", "set", "place", "sketch", "sketch2"]
        gathered = cut(sent.where("not apart").select(ours).repartition("token").sortWithinPartitions("token").mapInArrow(_candidates(similarity, True), _MET + _ASIDE))
        # signatures of very many sets: their sets form blocks, by their true number, and each pair of blocks is compared by itself
        many = sent.where("apart").select(ours).unionByName(gathered.where("b is null").select("token", F.col("a").alias("set"), "place", "sketch", "sketch2"))
        parts = many.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        own = F.pmod(F.xxhash64("set"), F.col("parts"))
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.when(F.col("own") == j, -1 - j).otherwise(F.least("own", j) * F.col("parts") + F.greatest("own", j)))
        blocks = many.join(parts, "token").withColumn("own", own).select(*ours, "own", F.explode(cells).alias("block"))
        compared = blocks.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(_candidates(similarity, False), _MET)
        shared = gathered.where("b is not null").select("a", "b", "n", "need", "early").unionByName(compared)
        enough = shared.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need"), F.max("early").alias("early")).where("n >= need and early")
        met = cut(enough.select("a", "b"))
        holder = sets.groupBy("set").agg(F.min("doc").alias("doc"))
        named = met.select(F.col("a").alias("sa"), F.col("b").alias("sb")).join(holder.select(F.col("set").alias("sa"), F.col("doc").alias("a")), "sa").join(holder.select(F.col("set").alias("sb"), F.col("doc").alias("b")), "sb")
        self.links = cut(with_texts(cut(named), docs).select("sa", "sb", "ta", "tb").mapInPandas(_verify(n, similarity), "sa long, sb long, similarity double").dropDuplicates(["sa", "sb"]))

    def pairs(self) -> DataFrame:
        """(a, b, similarity), a < b, of all records: linked sets by their members, and the members of one set."""
        m = self.members
        ma, mb = m.select(F.col("set").alias("sa"), F.col("doc").alias("a")), m.select(F.col("set").alias("sb"), F.col("doc").alias("b"))
        across = self.links.join(ma, "sa").join(mb, "sb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
        several = m.groupBy("set").count().where("count > 1").select(F.col("set").alias("sa"))
        same = several.join(ma, "sa").join(mb.withColumnRenamed("sb", "sa"), "sa").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
        return across.unionByName(same)

    def groups(self) -> DataFrame:
        """(doc, group_id, n_links) of every record in a pair: the least key of its connected group, its pairs."""
        m = self.members
        sizes = m.groupBy("set").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
        both = self.links.select("sa", "sb").unionByName(self.links.select(F.col("sb").alias("sa"), F.col("sa").alias("sb")))
        near = both.join(sizes.select(F.col("set").alias("sb"), "n"), "sb").groupBy(F.col("sa").alias("set")).agg(F.sum("n").alias("near"))
        label = components(self.links.select(F.col("sa").alias("u"), F.col("sb").alias("v"))).select(F.col("node").alias("set"), "label")
        named = sizes.join(label, "set", "left").join(near, "set", "left").select("set", "n", "first", F.coalesce("label", "set").alias("label"), F.coalesce("near", F.lit(0)).alias("near")).where("n > 1 or near > 0")
        group = named.groupBy("label").agg(F.min("first").alias("group_id"))
        return m.join(named, "set").join(group, "label").select("doc", "group_id", (F.col("near") + F.col("n") - 1).alias("n_links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of every node's connected component, by alternating star contractions.

    Rounds grow with the logarithm of the longest chain; each is cut off from its history.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        e = both(now)
        least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = e.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and itself, go to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u")
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == told:
            break
        before = told
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()).groupBy("node").agg(F.min("label").alias("label"))
