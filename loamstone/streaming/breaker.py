"""A circuit breaker as an ordered fold per service, in a batch or with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

THRESHOLD, RECOVERY_S = 3, 30.0
OUT = "service string, seq long, allowed boolean, state string"
_STATE = "failures int, last double, state string"


class Breaker:
    """Failures add up while closed; a success resets them only when half open, unless ``consecutive``."""

    def __init__(self, failures: int = 0, last: float = 0.0, state: str = "closed", threshold: int = THRESHOLD, recovery: float = RECOVERY_S, consecutive: bool = False):
        self.failures, self.last, self.state = failures, last, state
        self.threshold, self.recovery, self.consecutive = threshold, recovery, consecutive

    def allows(self, at: float) -> bool:
        """Whether a call at time ``at`` would be let through."""
        return self.state != "open" or at - self.last > self.recovery

    def call(self, at: float, ok: bool) -> bool:
        """Whether the call at time ``at`` is let through; its outcome counts only then."""
        if self.state == "open":
            if at - self.last <= self.recovery:
                return False
            self.state = "half-open"
        if ok:
            if self.state == "half-open" or self.consecutive:
                self.state, self.failures = "closed", 0
        else:
            self.failures += 1
            self.last = at
            if self.failures >= self.threshold:
                self.state = "open"
        return True


def _run(b: Breaker, pdf: pd.DataFrame) -> pd.DataFrame:
    out = [(s, q, b.call(t, bool(ok)), b.state) for s, q, t, ok in zip(pdf["service"], pdf["seq"], pdf["at"], pdf["ok"])]
    return pd.DataFrame(out, columns=["service", "seq", "allowed", "state"])


def fold_breaker(calls: DataFrame) -> DataFrame:
    """Calls (service, seq, at in seconds, ok) in the order of seq: whether each was let through and the state after it.

    The calls of a service are read in sorted batches and only the breaker is kept between them, so a service may have any number.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, b = None, Breaker()
        for pdf in batches:
            out = []
            for s, q, t, ok in zip(pdf["service"], pdf["seq"], pdf["at"], pdf["ok"]):
                if s != now:
                    now, b = s, Breaker()
                out.append((s, q, b.call(t, bool(ok)), b.state))
            yield pd.DataFrame(out, columns=["service", "seq", "allowed", "state"])

    ordered = calls.select("service", "seq", "at", "ok").repartition("service").sortWithinPartitions("service", "seq")
    return ordered.mapInPandas(fold, OUT)


def stream_breaker(calls: DataFrame) -> DataFrame:
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        b = Breaker(*state.get) if state.exists else Breaker()
        yield _run(b, pd.concat(list(batches), ignore_index=True).sort_values("seq"))
        state.update((b.failures, b.last, b.state))

    return calls.groupBy("service").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
