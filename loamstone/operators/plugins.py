"""Embedding and language models as plug-ins, with deterministic stand-ins."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.streaming.breaker import Breaker

DIMENSION = 64


def hash_embed(texts: list[str], dim: int = DIMENSION) -> np.ndarray:
    """Signed hashes of words and word pairs, of unit length: no model, but equal words come near each other."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        w = t.lower().split()
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        if grams:
            h = pd.util.hash_array(np.array(grams, dtype=object))
            np.add.at(out[i], (h % np.uint64(dim)).astype(int), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(c: Column, model: Callable[[list[str]], np.ndarray] = hash_embed) -> Column:
    """Vectors of texts; the model is made once a worker and called by batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())), index=s.index)

    return run(c)


def embed_new(rows: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Vectors of ``rows``; those in ``known`` (key, v) aren't made again."""
    fresh = rows.join(known.select(key), key, "left_anti").select(key, embed(F.col(text)).alias("v"))
    return known.join(rows.select(key), key, "left_semi").select(key, "v").unionByName(fresh)


class Model(Protocol):
    def __call__(self, prompt: str, context: str) -> str: ...


def extractive(prompt: str, context: str) -> str:
    """The sentence of the context that shares most words with the prompt; stands in for a language model."""
    want = set(prompt.lower().split())
    best = max((s.strip() for s in context.replace("\n", ". ").split(". ")), key=lambda s: len(want & set(s.lower().split())), default="")
    return best


def plain_rewrite(question: str) -> str:
    """The question in lower case without punctuation; stands in for a model that rewrites a poor query."""
    return " ".join(re.sub(r"[^\w\s]", " ", question.lower()).split())


def rewritten(c: Column, model: Callable[[str], str] = plain_rewrite) -> Column:
    """Questions rewritten for a second search; what a model fails on stays as it is."""

    def one(q: str | None) -> str | None:
        try:
            return model(q) if q is not None else None
        except Exception:  # any failure of a remote model leaves the question as it was
            return q

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(one)

    return run(c)


def corrected(draft: Column, context: Column, is_grounded: Column) -> Column:
    """Ungrounded drafts without the sentences whose words the context doesn't hold; a draft of which nothing is left stays. Stands in for a correcting model."""
    have = F.array_distinct(F.split(F.lower(context), r"\W+"))
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"\W+"), lambda x: F.length(x) > 3))
    kept = F.filter(F.split(draft, r"(?<=[.!?])\s+"), lambda s: F.size(F.array_except(words(s), have)) <= 0.5 * F.size(words(s)))
    return F.when(is_grounded | (F.size(kept) == 0), draft).otherwise(F.array_join(kept, " "))


def backoff_wait(attempt: int, base: float = 1.0, most: float = 10.0, jitter: float | None = None) -> float:
    return min(base * 2**attempt, most) * (0.5 + (random.random() if jitter is None else jitter))


def call_with_fallback(
    models: list[tuple[str, Model]], prompt: str, context: str, tries: int = 3, wait: Callable[[float], None] = time.sleep, breakers: dict[str, Breaker] | None = None, clock: Callable[[], float] = time.monotonic
) -> tuple[str | None, str]:
    """Answer and the model that gave it: each model is tried again with growing waits before the next has its turn.

    ``breakers`` keeps one breaker a model over many calls: a model whose breaker is open is passed over.
    """
    for name, model in models:
        breaker = breakers.setdefault(name, Breaker()) if breakers is not None else None
        for attempt in range(tries):
            if breaker and not breaker.allows(clock()):
                break
            try:
                answer = model(prompt, context)
                if breaker:
                    breaker.call(clock(), True)
                return answer, name
            except Exception:  # any failure of a remote model counts as one try
                if breaker:
                    breaker.call(clock(), False)
                if attempt + 1 < tries:
                    wait(backoff_wait(attempt))
    return None, "failed"


class Traced:
    """A model that counts its calls, failures, words and seconds; the counts are the worker's."""

    def __init__(self, model: Model, clock: Callable[[], float] = time.perf_counter):
        self.model, self.clock = model, clock
        self.calls = self.failures = self.words_in = self.words_out = 0
        self.seconds = 0.0

    def __call__(self, prompt: str, context: str) -> str:
        began = self.clock()
        self.calls += 1
        self.words_in += len(prompt.split()) + len(context.split())
        try:
            answer = self.model(prompt, context)
        except Exception:
            self.failures += 1
            raise
        finally:
            self.seconds += self.clock() - began
        self.words_out += len(answer.split())
        return answer


def retry_graph(process: Callable[[dict], dict], retry_limit: int = 3) -> Callable[[dict], dict]:
    """A loop of process, then success, retry or error, over a state with messages; each failed round adds its error."""

    def run(state: dict) -> dict:
        state = {"messages": [], "error": None, "retry_count": 0, "success": False, **state}
        while True:
            try:
                state = {**state, **process(state), "error": None, "success": True}
                return state
            except Exception as e:
                state = {**state, "error": str(e), "retry_count": state["retry_count"] + 1, "messages": [*state["messages"], f"error: {e}"]}
            if state["retry_count"] >= retry_limit:
                return state

    return run


def generate(rows: DataFrame, prompt: str, context: str, models: list[tuple[str, Model]] | None = None) -> DataFrame:
    """``rows`` with (answer, answered_by)."""
    use = models or [("extractive", extractive)]
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breakers: dict[str, Breaker] = {}  # a worker's own: what fails for one row is likely to fail for the next
        for pdf in batches:
            got = [call_with_fallback(use, p or "", c or "", breakers=breakers) for p, c in zip(pdf[prompt], pdf[context])]
            yield pdf.assign(answer=[a for a, _ in got], answered_by=[n for _, n in got])

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.select(*names).schema.fields, T.StructField("answer", T.StringType()), T.StructField("answered_by", T.StringType())]))


def grounded(answer: Column, context: Column, least: float = 0.5) -> Column:
    """Whether enough of an answer's words come from the context; stands in for a model's verdict. NULL counts as grounded."""
    w = F.array_distinct(F.filter(F.split(F.lower(answer), r"\W+"), lambda x: F.length(x) > 3))
    have = F.array_distinct(F.split(F.lower(context), r"\W+"))
    return F.coalesce((F.size(w) == 0) | (F.size(F.array_intersect(w, have)) >= least * F.size(w)), F.lit(True))
