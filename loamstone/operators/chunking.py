"""Recursive splitting of texts by a list of separators, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", ";", ",", " ", "")


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    """Adjacent parts joined up to ``size``; each chunk begins with the last parts of the one before, up to ``overlap``."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            out.append("".join(held))
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if held:
        out.append("".join(held))
    return out


def split_recursive(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters: split at the first separator that occurs, longer parts at the next ones."""
    if len(text) <= size:
        return [text] if text.strip() else []
    i = next(k for k, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[i], separators[i + 1 :] or ("",)
    if sep:
        raw = text.split(sep)
        parts = [x + sep for x in raw[:-1]] + [raw[-1]]
    else:
        parts = list(text)
    out: list[str] = []
    fit: list[str] = []
    for p in parts:
        if len(p) <= size:
            fit.append(p)
            continue
        out += _merge(fit, size, overlap)
        fit = []
        out += split_recursive(p, size, overlap, rest)
    out += _merge(fit, size, overlap)
    return [c for c in (x.strip() for x in out) if c]


def chunks(df: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """(key, pos, chunk) of every text; NULL and blank texts give none."""
    rows = df.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    # short texts need no Python
    short = rows.where(F.length("t") <= size).where(F.length(F.regexp_replace("t", r"\s", "")) > 0).select("k", F.lit(0).alias("pos"), F.col("t").alias("chunk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, i, c) for k, t in zip(pdf["k"], pdf["t"]) for i, c in enumerate(split_recursive(t, size, overlap))]
            yield pd.DataFrame(out, columns=["k", "pos", "chunk"])

    long = rows.where(F.length("t") > size).mapInPandas(run, f"k {dict(rows.dtypes)['k']}, pos int, chunk string")
    return short.unionByName(long).withColumnRenamed("k", key)
