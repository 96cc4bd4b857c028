"""Exact vector search: stated queries against all rows, in blocks of queries."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamstone.plans.tables import cut

#: Bytes of query vectors sent to the tasks at once; more queries make more passes over the rows.
SHIPPED = 64_000_000
#: Query vectors, and rows, that are compared in one product: some matrices of its size (8 MB) are in memory.
BLOCK = 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.greatest(norm(a) * norm(b), F.lit(1e-9))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def cosine_topk(rows: DataFrame, queries: DataFrame, k: int, same: str | None = None, min_score: float | None = None, keep_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of ``rows`` (id, v, ...) for each of ``queries`` (id, v, ...).

    ``same``: a column in which row and query must agree, checked before the ranking. Each batch of rows keeps its own k best a
    query, so that little is shuffled. Scores are rounded to six places before they are ranked, ties go to the least id. Rows
    without a vector, or with one of another length, are left out; an empty side gives an empty result.
    """
    kinds = dict(rows.dtypes)
    out = None
    block: list[tuple[object, list[float], object]] = []

    def one(block: list[tuple[object, list[float], object]]) -> DataFrame:
        ids = np.array([q[0] for q in block])
        dim = len(block[0][1])
        mat = _unit(np.array([q[1] for q in block], np.float64))
        marks = np.array([q[2] for q in block], dtype=object)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            least = np.full(len(ids), -np.inf)
            for pdf in batches:
                pdf = pdf[[v is not None and len(v) == dim for v in pdf["v"]]]
                if not len(pdf):
                    continue
                got = pdf["id"].to_numpy()
                unit = _unit(np.stack(pdf["v"].to_numpy()).astype(np.float64))
                mark = pdf["mark"].to_numpy(object) if same else None
                for lo, at in itertools.product(range(0, len(ids), BLOCK), range(0, len(got), BLOCK)):
                    part, here = ids[lo : lo + BLOCK], got[at : at + BLOCK]
                    score = np.round(unit[at : at + BLOCK] @ mat[lo : lo + BLOCK].T, 6)
                    if same:
                        score[mark[at : at + BLOCK, None] != marks[None, lo : lo + BLOCK]] = -np.inf
                    if not keep_self:
                        score[here[:, None] == part[None, :]] = -np.inf
                    if min_score is not None:
                        score[score < min_score] = -np.inf
                    # all that reach the k-th best that this task has met, ties with it too
                    if len(here) > k:
                        least[lo : lo + BLOCK] = np.maximum(least[lo : lo + BLOCK], np.partition(score, -k, axis=0)[-k])
                    r, j = np.nonzero((score >= least[lo : lo + BLOCK]) & np.isfinite(score))
                    if len(r):
                        yield pd.DataFrame({"query_id": part[j], "id": here[r], "score": score[r, j]})

        return rows.select("id", "v", *([F.col(same).alias("mark")] if same else [])).mapInPandas(search, f"query_id {kinds['id']}, id {kinds['id']}, score double")

    wanted = queries.where("v is not null").select("id", "v", (F.col(same) if same else F.lit(None).cast("int")).alias("mark")).orderBy("id")
    for q in wanted.toLocalIterator():
        if block and (len(block) * len(block[0][1]) * 8 >= SHIPPED or len(q["v"]) != len(block[0][1])):
            done = cut(one(block))  # one pass a block: the plan doesn't grow with the queries
            out = done if out is None else out.unionByName(done)
            block = []
        block.append((q["id"], q["v"], q["mark"]))
    if block:
        out = one(block) if out is None else out.unionByName(one(block))
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kinds['id']}, id {kinds['id']}, score double, rank long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def project(rows: DataFrame, scale: float = 7.0) -> DataFrame:
    """(id, x, y, z): the three main components of the vectors, scaled so that the largest is ``scale``.

    Sums and products of partitions are added up, so only a matrix of the dimension's size is solved in one place. The sign
    of a component is set so that its largest loading is positive. Fewer than three rows are set out on a line.
    """
    rows = rows.where("v is not null and size(v) > 0")
    n = rows.count()
    if n < 3:
        w = Window.orderBy("id")
        return rows.select("id", ((F.row_number().over(w) - 1 - F.lit((n - 1) / 2)) * 4.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, outer, n = None, None, 0
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                total = m.sum(0) if total is None else total + m.sum(0)
                outer = m.T @ m if outer is None else outer + m.T @ m
                n += len(m)
        if n:
            yield pd.DataFrame({"i": np.arange(len(total) + 1), "row": [*outer.tolist(), total.tolist()], "n": n})

    parts = rows.select("v").mapInPandas(moments, "i int, row array<double>, n long")
    sums = parts.select("i", F.posexplode("row").alias("j", "x"), "n").groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    dim = int(sums["j"].max()) + 1
    full = np.zeros((dim + 1, dim))
    full[sums["i"], sums["j"]] = sums["x"]
    mean = full[dim] / n
    cov = (full[:dim] - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(values)[::-1][:3]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])

    def to_axes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = (np.stack(pdf["v"].to_numpy()).astype(np.float64) - mean) @ axes
                yield pd.DataFrame({"id": pdf["id"], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    placed = rows.select("id", "v").mapInPandas(to_axes, f"id {dict(rows.dtypes)['id']}, x double, y double, z double")
    most = placed.agg(F.max(F.greatest(F.abs("x"), F.abs("y"), F.abs("z")))).first()[0] or 1.0
    return placed.select("id", *[(F.col(c) / most * scale).alias(c) for c in "xyz"])
