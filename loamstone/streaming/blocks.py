"""Streamed answers cut into blocks: a fold over the tokens of each stream, in a batch or with state."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_BLANK = re.compile(r"\n\s*\n")
_HEADER = re.compile(r"(?<=[^\n#])(?=#{2,6}[^#])|(?<=\n)(?=#{1,6}\s)")
OUT = "stream string, block int, content string"
_STATE = "buffer string, block int, seen long"


class BlockStreamer:
    """Commits a block when a blank line or a header ends it and two more characters have come; one a token at most."""

    def __init__(self, buffer: str = "", block: int = 0):
        self.buffer, self.block = buffer, block

    def feed(self, token: str) -> list[tuple[int, str]]:
        self.buffer += token
        # a header at the very start opens the block that is being read; what ends it comes after
        skip = len(self.buffer) - len(self.buffer.lstrip("#")) if self.buffer.startswith("#") else 0
        ends = [m for p in (_BLANK, _HEADER) if (m := p.search(self.buffer, skip))]
        if not ends:
            return []
        m = min(ends, key=lambda x: x.start())
        if len(self.buffer) <= m.end() + 2:
            return []
        done, self.buffer = self.buffer[: m.start()].strip(), self.buffer[m.end() :].lstrip("\n")
        if not done:
            return []
        self.block += 1
        return [(self.block, done)]

    def flush(self) -> list[tuple[int, str]]:
        done, self.buffer = self.buffer.strip(), ""
        if not done:
            return []
        self.block += 1
        return [(self.block, done)]


def _rows(stream: str, events: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame([(stream, b, c) for b, c in events], columns=["stream", "block", "content"])


def fold_blocks(tokens: DataFrame) -> DataFrame:
    """Blocks of complete streams (stream, seq, token). One answer's tokens are few and go to one task."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        s = BlockStreamer()
        events = [e for t in pdf.sort_values("seq")["token"] if t for e in s.feed(t)] + s.flush()
        return _rows(pdf["stream"].iloc[0], events)

    return tokens.groupBy("stream").applyInPandas(fold, OUT)


def stream_blocks(tokens: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """The same over a streaming DataFrame: buffer and number of blocks are kept as state.

    A stream's NULL token ends it, as does ``idle_ms`` without a token: what is left is flushed and the state dropped. A query
    over what is available now needs None, as waiting for the time to pass would keep it from ending.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        buffer, block, seen = state.get if state.exists else ("", 0, 0)
        s = BlockStreamer(buffer, block)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq") if not state.hasTimedOut else pd.DataFrame({"seq": [], "token": []})
        events: list[tuple[int, str]] = []
        ended = state.hasTimedOut
        for t in rows["token"]:
            if t is None or t != t:
                ended = True
            elif t:
                events += s.feed(t)
        if ended:
            events += s.flush()
            state.remove()
        else:
            state.update((s.buffer, s.block, seen + len(rows)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if events:
            yield _rows(key[0], events)

    return tokens.groupBy("stream").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


EVENTS = "stream string, seq long, kind string, payload string"
_EVENT_STATE = "buffer string, block int, seq long, said string"


class AnswerEvents:
    """The events of an answer as it is told: its stages, every token, every block that is finished, and the whole at the end."""

    def __init__(self, buffer: str = "", block: int = 0, seq: int = 0, said: str = ""):
        self.blocks, self.seq, self.said = BlockStreamer(buffer, block), seq, said

    def _event(self, kind: str, payload: str) -> tuple[int, str, str]:
        self.seq += 1
        return self.seq, kind, payload

    def _committed(self, done: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
        return [self._event("block_commit", json.dumps({"id": b, "content": c}, ensure_ascii=False)) for b, c in done]

    def feed(self, token: str) -> list[tuple[int, str, str]]:
        first = [self._event("stage", "generating")] if not self.seq else []
        self.said += token
        return [*first, self._event("token", token), *self._committed(self.blocks.feed(token))]

    def end(self) -> list[tuple[int, str, str]]:
        return [*self._committed(self.blocks.flush()), self._event("stage", "done"), self._event("final_transformed", json.dumps({"content": self.said.strip()}, ensure_ascii=False))]


def _events(stream: str, events: list[tuple[int, str, str]]) -> pd.DataFrame:
    return pd.DataFrame([(stream, *e) for e in events], columns=["stream", "seq", "kind", "payload"])


def fold_events(tokens: DataFrame) -> DataFrame:
    """Events (stream, seq, kind, payload) of complete streams (stream, seq, token)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        a = AnswerEvents()
        return _events(pdf["stream"].iloc[0], [e for t in pdf.sort_values("seq")["token"] if t for e in a.feed(t)] + a.end())

    return tokens.groupBy("stream").applyInPandas(fold, EVENTS)


def stream_events(tokens: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """The same over a streaming DataFrame; a NULL token, or ``idle_ms`` without one, ends a stream (see ``stream_blocks``)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a = AnswerEvents(*state.get) if state.exists else AnswerEvents()
        ended, events = state.hasTimedOut, []
        rows = [] if ended else pd.concat(list(batches), ignore_index=True).sort_values("seq")["token"]
        for t in rows:
            if t is None or t != t:
                ended = True
            elif t:
                events += a.feed(t)
        if ended:
            events += a.end()
            state.remove()
        else:
            state.update((a.blocks.buffer, a.blocks.block, a.seq, a.said))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        if events:
            yield _events(key[0], events)

    return tokens.groupBy("stream").applyInPandasWithState(step, EVENTS, _EVENT_STATE, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
