"""The watch loop as a keyed stream: changes of a project, gathered, scanned and tried again.

``watch_actions`` turns a stream of signals into what a synchroniser has to do, project by project: ``scan`` everything
or ``refresh`` the changed paths. Changes are gathered until ``STEP`` has passed without another, but no longer than
``DEBOUNCE`` after the first. A project is scanned whole at its first signal, then at the first gathering or
timer at least ``RECONCILE`` after the last scan, upon a change of its root, and after a scan that failed. After a failed
synchronisation nothing is sent until a wait has passed that doubles with each failure, up to ``LONGEST``; what is
due then goes out as one refresh.

All is decided in event time. Signals wait in the state until the watermark has passed them and are then taken in the
order of their time and name, so how they were cut into micro-batches changes nothing, and a replay gives the same
actions. Signals later than the watermark are dropped by the engine, as in any such stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds.
STEP, DEBOUNCE, RECONCILE, LONGEST = 200, 1000, 60_000, 30_000
#: Kinds of signals: a path changed, the root itself did, a synchronisation failed or went through, a scan failed.
SIGNALS = ("change", "root", "failed", "done", "scan_failed")
SIGNAL_ROWS = "project_id string, at timestamp, kind string, path string"
ACTIONS = "project_id string, at long, action string, paths array<string>, attempt int, delay long"


@dataclass
class Watch:
    """One project's state; ``signal`` and ``advance`` must be called in order of time and give (at, action, paths, attempt, delay)."""

    step: int = STEP
    debounce: int = DEBOUNCE
    reconcile: int = RECONCILE
    longest: int = LONGEST
    first: int | None = None
    last: int | None = None
    paths: list[str] = field(default_factory=list)
    root: bool = False
    scan_at: int | None = None
    retry_at: int | None = None
    attempts: int = 0

    def due(self) -> int | None:
        """The next moment at which something happens by itself."""
        times = [t for t in (self.retry_at, None if self.retry_at is not None else self.scan_at) if t is not None]
        if self.first is not None:
            gathered = min(self.last + self.step, self.first + self.debounce)
            times.append(gathered if self.retry_at is None else max(gathered, self.retry_at))
        return min(times, default=None)

    def advance(self, now: int) -> Iterator[tuple]:
        """What happens by itself up to and including ``now``."""
        while (at := self.due()) is not None and at <= now:
            yield self._act(at)

    def _act(self, at: int) -> tuple:
        whole = self.root or self.scan_at is None or at >= self.scan_at
        out = (at, "scan" if whole else "refresh", [] if whole else sorted(self.paths), self.attempts, 0)
        if whole:
            self.scan_at = at + self.reconcile
        self.first = self.last = self.retry_at = None
        self.paths, self.root = [], False
        return out

    def signal(self, at: int, kind: str, path: str | None) -> Iterator[tuple]:
        yield from self.advance(at)
        if self.scan_at is None:
            yield self._act(at)
        if kind in ("change", "root"):
            self.root |= kind == "root"
            if path is not None and path not in self.paths:
                self.paths.append(path)
            self.first, self.last = at if self.first is None else self.first, at
        elif kind == "failed":
            self.attempts += 1
            delay = min(1000 * 2 ** min(self.attempts - 1, 5), self.longest)
            self.retry_at = at + delay
            yield (at, "retry", [], self.attempts, delay)
        elif kind == "done":
            self.attempts, self.retry_at = 0, None
        elif kind == "scan_failed":
            self.scan_at = at


def replay(signals: list[tuple[int, str, str | None]], until: int, **limits: int) -> list[tuple]:
    """The actions of one project for all its signals (at, kind, path), in order of time; the plain form of the stream."""
    watch, out = Watch(**limits), []
    for at, kind, path in sorted(signals, key=lambda s: (s[0], s[1], s[2] or "")):
        out += watch.signal(at, kind, path)
    return out + list(watch.advance(until))


class _Watcher(StatefulProcessor):
    """Keeps a project's ``Watch`` and the signals the watermark has not passed."""

    def __init__(self, limits: dict[str, int]) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", "state string")
        self.waiting = handle.getListState("waiting", "at long, kind string, path string")

    def _run(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        watch = Watch(**json.loads(known[0])) if known else Watch(**self.limits)
        held = sorted(((int(w[0]), w[1], w[2]) for w in self.waiting.get()), key=lambda s: (s[0], s[1], s[2] or ""))
        passed, left = [w for w in held if w[0] <= watermark], [w for w in held if w[0] > watermark]
        out = [a for w in passed for a in watch.signal(*w)] + list(watch.advance(watermark))
        if passed:
            self.waiting.put(left) if left else self.waiting.clear()
        self.state.update((json.dumps(asdict(watch)),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        times = [t for t in (left[0][0] if left else None, watch.due()) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), watermark + 1))
        if out:
            yield pd.DataFrame([(key[0], *a) for a in out], columns=["project_id", "at", "action", "paths", "attempt", "delay"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at.value // 1_000_000), kind, path) for df in rows for at, kind, path in zip(df["at"], df["kind"], df["path"], strict=True)]
        self.waiting.appendList(new)
        yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def watch_actions(signals: DataFrame, lateness: str = "10 seconds", step: int = STEP, debounce: int = DEBOUNCE, reconcile: int = RECONCILE, longest: int = LONGEST) -> DataFrame:
    """project_id, at (milliseconds), action, paths, attempt, delay for a stream of ``SIGNAL_ROWS``.

    The state of a project is its watch and the signals of the last ``lateness``. The stream needs a state store that
    keeps more than one column family (``spark.sql.streaming.stateStore.providerClass``, RocksDB).
    """
    limits = {"step": step, "debounce": debounce, "reconcile": reconcile, "longest": longest}
    keyed = signals.select("project_id", "at", "kind", "path").withWatermark("at", lateness).groupBy("project_id")
    return keyed.transformWithStateInPandas(_Watcher(limits), ACTIONS, "Append", "EventTime")
