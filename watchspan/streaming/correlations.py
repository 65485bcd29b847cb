"""Correlations on a stream of hits, with the rows that the batch job would give.

Per correlation and group, hits wait until the watermark has passed them and are then taken in order of time. State
per group is what lies within one span of the newest hit: hits in the window (or, for sequences, since the oldest start that is still
undecided), those that wait, and at most one open burst. Timers at event time hand out what can no longer change and clear the rest,
so nothing is kept for longer than one span and the lateness. Hits that come later than that are dropped, as by any watermark.

One group is the work of one task, so a correlation without group-by is too; the batch job has no such limit.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchspan.operators.bursts import with_alert_id
from watchspan.operators.correlation import Correlation, members

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "rule string, grp_json string, first_us bigint, trigger_us bigint, last_us bigint, n_matches bigint"
HIT = "ts_us bigint, match_id string, rule string, value string"


class Burst:
    """Counts and distinct counts: ``past`` is the window of the newest hit, ``open`` (first, trigger, last, n) or None."""

    def __init__(self, correlation: Correlation, past: list, open_):
        self.span, self.distinct = correlation.span_us, correlation.distinct
        self.op, self.threshold = correlation.limit
        self.past, self.open = deque(past), open_
        self.live = Counter(h.value for h in past if h.value is not None)

    def _fires(self) -> bool:
        n = len(self.live) if self.distinct else len(self.past)
        return n >= self.threshold if self.op == "gte" else n == self.threshold

    def take(self, hit) -> Iterator[tuple]:
        """The next hit in order; gives the burst that ends before it."""
        if self.open and hit.ts_us - self.open[2] > self.span:
            yield self.open
            self.open = None
        self.forget(hit.ts_us)
        self.past.append(hit)
        if hit.value is not None:
            self.live[hit.value] += 1
        if self.open:
            self.open = (*self.open[:2], hit.ts_us, self.open[3] + 1)
        elif self._fires():
            self.open = (self.past[0].ts_us, hit.ts_us, hit.ts_us, len(self.past))

    def forget(self, now: int) -> None:
        while self.past and now - self.past[0].ts_us > self.span:
            value = self.past.popleft().value
            if value is not None:
                self.live[value] -= 1
                if not self.live[value]:
                    del self.live[value]

    def settle(self, upto: int) -> Iterator[tuple]:
        """All hits up to ``upto`` have been taken."""
        if self.open and upto >= self.open[2] + self.span:
            yield self.open
            self.open = None
        self.forget(upto)

    def wakes(self) -> int | None:
        last = self.open[2] if self.open else self.past[-1].ts_us if self.past else None
        return None if last is None else last + self.span


class Sequence:
    """Chains: ``past`` are the hits since the oldest undecided start, ``open`` holds the end of the last chain."""

    def __init__(self, correlation: Correlation, past: list, open_):
        self.span, self.rules = correlation.span_us, correlation.rules
        self.past, self.open = list(past), open_

    def take(self, hit) -> Iterator[tuple]:
        self.past.append(hit)
        yield from ()

    def _chain(self, start: int) -> int | None:
        """Where the earliest chain from a start ends, among the hits so far."""
        at, limit = start, self.past[start].ts_us + self.span
        for rule in self.rules[1:]:
            at = next((k for k, h in enumerate(self.past) if h.rule == rule and k != at and self.past[at].ts_us <= h.ts_us <= limit), None)
            if at is None:
                return None
        return at

    def settle(self, upto: int) -> Iterator[tuple]:
        undecided = None
        for k, start in enumerate(self.past):
            if start.rule != self.rules[0] or (self.open and start.ts_us <= self.open[2]):
                continue
            end = self._chain(k)
            if end is not None:
                last = self.past[end].ts_us
                self.open = (start.ts_us, last, last, len(self.rules))
                yield self.open
            elif upto < start.ts_us + self.span:
                undecided = start.ts_us
                break
        # The end of the last chain matters to starts that may still come, so not once the time is past it.
        self.past = [] if undecided is None else [h for h in self.past if h.ts_us >= undecided]
        if self.open and upto >= self.open[2]:
            self.open = self.open if self.past and self.past[0].ts_us <= self.open[2] else None

    def wakes(self) -> int | None:
        return self.past[0].ts_us + self.span if self.past else None


class Correlating(StatefulProcessor):
    def __init__(self, correlations: list[Correlation]):
        self.by_name = {c.name: c for c in correlations}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", HIT)
        self.past = handle.getListState("past", HIT)
        self.open = handle.getValueState("open", "first_us bigint, trigger_us bigint, last_us bigint, n bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [Row(ts_us=r.ts_us, match_id=r.match_id, rule=r.rule, value=r.value) for r in rows]
        self.waiting.appendList([tuple(h) for h in new])
        self._wake(min(h.ts_us for h in new), timerValues)
        return iter([])

    def _wake(self, ts_us: int, timerValues) -> None:
        """At the first millisecond from which on the watermark is behind ``ts_us``."""
        self.handle.registerTimer(max(ts_us // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        correlation, upto = self.by_name[key[0]], timerValues.getCurrentWatermarkInMs() * 1000
        hits = sorted(self._hits(self.waiting), key=lambda h: (h.ts_us, h.match_id))
        ready = [h for h in hits if h.ts_us <= upto]
        rest = hits[len(ready):]
        walk = (Sequence if correlation.kind == "temporal_ordered" else Burst)(
            correlation, self._hits(self.past), tuple(self.open.get()) if self.open.exists() else None)
        found = [burst for hit in ready for burst in walk.take(hit)]
        found += walk.settle(upto)
        self._store(self.waiting, rest)
        self._store(self.past, list(walk.past))
        self.open.update(tuple(walk.open)) if walk.open else self.open.clear()
        for ts_us in {rest[0].ts_us if rest else None, walk.wakes()} - {None}:
            self._wake(ts_us, timerValues)
        return iter([Row(rule=key[0], grp_json=key[1], first_us=b[0], trigger_us=b[1], last_us=b[2], n_matches=b[3]) for b in found])

    @staticmethod
    def _hits(state) -> list[Row]:
        return [Row(ts_us=h[0], match_id=h[1], rule=h[2], value=h[3]) for h in state.get()] if state.exists() else []

    @staticmethod
    def _store(state, hits: list[Row]) -> None:
        state.put([tuple(h) for h in hits]) if hits else state.clear()

    def close(self) -> None:
        pass


def correlation_stream(hits: DataFrame, correlations: list[Correlation], lateness: str = "10 minutes") -> DataFrame:
    """Bursts and chains of the given correlations, each once it can no longer change.

    ``hits`` has the columns of matches. The session's state store must be the one named in ``STORE``.
    """
    rows = (members(hits, correlations)
            .select("corr", F.to_json("grp").alias("grp_json"), "ts_us", "match_id", "rule", "value", F.timestamp_micros("ts_us").alias("ts"))
            .withWatermark("ts", lateness))
    found = rows.groupBy("corr", "grp_json").transformWithState(
        Correlating(correlations), FOUND, outputMode="append", timeMode="EventTime")
    return with_alert_id(found.withColumn("grp", F.from_json("grp_json", "array<string>")).drop("grp_json"))
