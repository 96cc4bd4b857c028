"""Bringing a few records' texts to where they are needed without moving the whole table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters (or bytes) of text that are worked on at once; arrays of several times that are in memory.
AT_ONCE = 4_000_000


def portions(sizes: Sequence[int], most: int, at_once: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` texts with about ``at_once`` characters; a longer text is one by itself."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and (i - lo >= most or total + n > at_once):
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: float) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Sorted rows in portions that end where a group (equal ``keys``) ends (True), or inside one of over ``most`` rows (False).

    The portion after such a one begins with the last row of it. No more than a batch, and a group up to ``most``, is held.
    """
    held: list[dict[str, np.ndarray]] = []
    rows = 0

    def joined() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([p[c] for p in held]) for c in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        new = np.zeros(batch.num_rows, bool)
        for c in keys:
            new[1:] |= now[c][1:] != now[c][:-1]
            new[0] |= bool(held) and held[-1][c][-1] != now[c][0]
        cuts = np.flatnonzero(new)
        at = int(cuts[-1]) if len(cuts) else 0
        if len(cuts):
            held.append({c: v[:at] for c, v in now.items()})
            yield joined(), True
            held, rows = [], 0
        held.append({c: v[at:] for c, v in now.items()})
        rows += batch.num_rows - at
        if rows > most:
            yield joined(), False
            held, rows = [{c: v[-1:] for c, v in now.items()}], int(most)
    if held:
        yield joined(), True


#: Bits of the filter that keeps the records whose texts are needed; 1 MB, whatever the data.
FILTER_BITS = 1 << 23


def _bits(x: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(np.asarray(x)) % np.uint64(FILTER_BITS)


def needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (first column: the key) without most records that are not in ``ids``, by a hash filter of fixed size."""
    name = ids.columns[0]

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros(FILTER_BITS // 64, np.uint64)
        for pdf in batches:
            b = np.unique(_bits(pdf[name].to_numpy()))
            np.bitwise_or.at(words, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pd.DataFrame({"word": at, "mask": words[at].view(np.int64)})

    rows = ids.mapInPandas(bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(FILTER_BITS // 64, np.uint64)
    words[rows["word"].to_numpy().astype(np.int64)] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            hit = (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return docs.mapInArrow(keep, docs.schema)


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the texts ta and tb from ``docs`` (doc, text)."""
    t = needed(docs.select("doc", "text"), pairs.select(F.explode(F.array("a", "b")).alias("doc")))
    return pairs.join(t.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")
