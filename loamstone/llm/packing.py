"""Packing texts into containers of a fixed number of tokens.

Items of one size are interchangeable, so the packing is planned from the histogram of sizes alone (at most
``capacity`` numbers, whatever the data) and then carried out in parallel:

1. Linear grouping: the sizes above ``SMALL`` are put into ``GROUPS`` groups of equal cardinality and
   rounded up to the largest of their group.
2. The few-size problem is solved by column generation (simplex over container patterns, priced by a
   knapsack); fractional patterns are rounded down and the few items left over are packed best-fit.
3. The groups' actual sizes are substituted in descending order; what rounding left free becomes gaps.
4. Small items are packed best-fit into the gaps, the largest first, and into new containers when none has room.

The plan is a list of runs: ranks r0..r1 of size s go to containers c0, c0+1, ... at one offset. Every item gets its
rank among its size by two levels of counting, and looks up its run.

A text longer than a container is cut into whole containers and a rest. Defined results: a NULL text has no
container; an empty one needs no room and is put at the start of container 0; repeated rows of a key
count once; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamstone.llm.lookup import portions
from loamstone.plans.tables import cut, spread

CAPACITY, GROUPS, SMALL_SHARE = 2048, 96, 8
#: Parts into which the items of one size are ranked; no size is gathered in one task.
RANK_PARTS = 64
#: Rows of a plan (40 bytes each) that are sent to every task.
PLAN_ROWS = 500_000
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """A counter of tokens from a vocabulary file of ranks; the file is a parameter and stays where it is."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---- plan ----------------------------------------------------------------------------------------------


@dataclass
class Run:
    """``n`` containers from ``first`` on, alike in the sizes they hold: (size, rank of the first's item)."""

    first: int
    n: int
    items: list[tuple[int, int]]
    used: int


def _patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Container patterns (columns) and how often each is used, by the simplex method with knapsack pricing."""
    k = len(sizes)
    a = np.diag(capacity // sizes).astype(float)
    x = demand / np.diag(a)
    before = np.arange(capacity + 1)[:, None] - sizes
    fits = before >= 0
    before = np.maximum(before, 0)
    for _ in range(most):
        y = np.linalg.solve(a.T, np.ones(k))
        # the best pattern for the prices y: one more item a round, over all fillings at once
        best, picks = np.zeros(capacity + 1), []
        for _ in range(int(capacity // sizes.min())):
            v = np.where(fits, best[before] + y, -1.0)
            i = v.argmax(axis=1)
            got = v[np.arange(capacity + 1), i]
            better = got > best + 1e-12
            if not better.any():
                break
            picks.append(np.where(better, i, -1))
            best = np.where(better, got, best)
        if best[capacity] <= 1 + 1e-7:
            break
        col = np.zeros(k)
        c = capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                col[pick[c]] += 1
                c -= int(sizes[pick[c]])
        d = np.linalg.solve(a, col)
        ok = d > 1e-9
        ratio = np.full(k, np.inf)
        ratio[ok] = x[ok] / d[ok]
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        a[:, out] = col
    return a.astype(np.int64), x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    histogram = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    small = capacity // SMALL_SHARE
    taken = dict.fromkeys(histogram, 0)
    runs: list[Run] = []
    containers = 0

    def take(s: int, n: int) -> int:
        r = taken[s]
        taken[s] += n
        return r

    large = sorted((s for s in histogram if s > small), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        # groups of equal cardinality; a size may lie across two
        per = -(-total // groups)
        parts: list[list[list[int]]] = [[]]
        room = per
        for s in large:
            n = histogram[s]
            while n:
                m = min(n, room)
                parts[-1].append([s, m])
                n -= m
                room -= m
                if not room:
                    parts.append([])
                    room = per
        merged: dict[int, list[list[int]]] = {}  # groups rounded up to one size are one
        for p in parts:
            if p:
                merged.setdefault(p[0][0], []).extend(p)
        tops = sorted(merged, reverse=True)
        sizes = np.array(tops)
        demand = np.array([sum(m for _, m in merged[t]) for t in tops], float)
        a, x = _patterns(sizes, demand, capacity)
        counts = np.floor(x + 1e-6).astype(np.int64)

        def give(g: int, n: int) -> list[tuple[int, int]]:
            """The next n items of group g, largest first, as (size, how many)."""
            out, q = [], merged[tops[g]]
            while n and q:
                m = min(n, q[0][1])
                out.append((q[0][0], m))
                q[0][1] -= m
                n -= m
                if not q[0][1]:
                    q.pop(0)
            return out

        for j in np.argsort(-counts, kind="stable").tolist():
            n = int(counts[j])
            slots = [g for g in range(len(tops)) for _ in range(int(a[g, j]))]
            left = {g: sum(m for _, m in merged[tops[g]]) for g in set(slots)}
            n = min([n, *(left[g] // slots.count(g) for g in left)])
            if not n:
                continue
            filled = [give(g, n) for g in slots]
            bounds = sorted({0, n, *(int(b) for f in filled for b in np.cumsum([m for _, m in f]))})
            at = [0] * len(filled)
            rest = [list(f[0]) for f in filled]
            for lo, hi in zip(bounds, bounds[1:]):
                items = []
                for i, f in enumerate(filled):
                    if not rest[i][1]:
                        at[i] += 1
                        rest[i] = list(f[at[i]])
                    items.append((rest[i][0], take(rest[i][0], hi - lo)))
                    rest[i][1] -= hi - lo
                runs.append(Run(containers + lo, hi - lo, items, sum(s for s, _ in items)))
            containers += n
        leftover = sorted(((s, m) for t in tops for s, m in merged[t] if m), reverse=True)
    else:
        leftover = []

    # best fit: gaps in ascending order, each with its runs
    free: dict[int, list[Run]] = {}
    order: list[int] = []

    def offer(r: Run) -> None:
        gap = capacity - r.used
        if gap not in free:
            bisect.insort(order, gap)
            free[gap] = []
        free[gap].append(r)

    for r in runs:
        offer(r)
    for s, n in [*leftover, *((s, histogram[s]) for s in sorted((s for s in histogram if s <= small), reverse=True))]:
        while n:
            i = bisect.bisect_left(order, s)
            if i == len(order):
                q = capacity // s
                whole = n // q
                for m, per_container in ((whole, q), (1, n - whole * q)):
                    if m and per_container:
                        r = Run(containers, m, [(s, take(s, m)) for _ in range(per_container)], s * per_container)
                        containers += m
                        runs.append(r)
                        offer(r)
                break
            gap = order[i]
            r = free[gap].pop()
            if not free[gap]:
                del free[gap]
                order.pop(i)
            m = min(n, r.n)
            if m < r.n:
                rest = Run(r.first + m, r.n - m, [(z, k + m) for z, k in r.items], r.used)
                r.n = m
                runs.append(rest)
                offer(rest)
            r.items.append((s, take(s, m)))
            r.used += s
            offer(r)
            n -= m
    return runs


def intervals(runs: list[Run]) -> pd.DataFrame:
    """One row per run and item: ranks r0 to r1 of a size, the container of the first, and the offset."""
    rows = []
    for r in runs:
        offset = 0
        for s, k in r.items:
            rows.append((s, k, k + r.n, r.first, offset))
            offset += s
    return pd.DataFrame(rows, columns=["size", "r0", "r1", "c0", "position"], dtype="int64")


# ---- carrying it out -----------------------------------------------------------------------------------


def _measure(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(path).encode_ordinary
        for batch in batches:
            sizes = [None if t is None else len(count(t)) for lo, hi in portions(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 200) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=["k", "tokens"])

    return go


def pack(df: DataFrame, key: str, text: str, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(key, piece_no, n_pieces, token_start, n_tokens, container_id, position): every piece's container and place."""
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]
    sized = cut(spread(rows).mapInArrow(_measure(tokenizer or tokenizer_path()), f"k {kind}, tokens int").groupBy("k").agg(F.max("tokens").alias("tokens")))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    pieces = sized.where("tokens > 0").select("k", n_pieces.alias("n_pieces"), "tokens", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece_no")).select(
        "k", "piece_no", "n_pieces", (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("tokens") - F.col("piece_no") * capacity).cast("int").alias("size")
    )
    parts = pieces.withColumn("part", F.pmod(F.xxhash64("k", "piece_no"), F.lit(RANK_PARTS)))
    # at most capacity * RANK_PARTS rows
    counts = cut(parts.groupBy("size", "part").agg(F.count("*").alias("n")))
    base = counts.withColumn("base", F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).select("size", "part", "base")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    planned = intervals(plan(histogram, capacity))
    where = spark.createDataFrame(planned, "size long, r0 long, r1 long, c0 long, position long")
    # the plan's size depends on the capacity and the number of groups; a larger one is joined by its key
    where = F.broadcast(where) if len(planned) <= PLAN_ROWS else where
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("size", "part").orderBy("k", "piece_no")) - 1).join(base, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(where, (ranked["size"] == where["size"]) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).select(
        "k", "piece_no", "n_pieces", "token_start", ranked["size"].alias("n_tokens"), (F.col("c0") + F.col("rank") - F.col("r0")).alias("container_id"), F.col("position").cast("int").alias("position")
    )
    none = F.col("tokens").isNull()
    empty = sized.where("tokens is null or tokens = 0").select(
        "k", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"),
        F.when(~none, F.lit(0)).cast("long").alias("container_id"), F.when(~none, F.lit(0)).alias("position"),
    )
    return placed.unionByName(empty).withColumnRenamed("k", key)


def container_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, the least possible number of containers, and the share of space used."""
    used = packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest")).withColumn(
        "least_containers", F.ceil(F.col("tokens") / capacity)
    ).withColumn("space_used", F.round(F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1)), 6))
