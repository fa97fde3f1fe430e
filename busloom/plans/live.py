"""The latched engine as one exact fold per trace and channel, for traces that need its resets.

The relational rules (operators.rules) cover traces in order. Late frames reset the engine's own
state, which no window can express; such a trace is folded record by record, with the fold's state
bounded by its identifiers and traces spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Settings:
    """All thresholds are explicit; times in microseconds."""

    learn_us: int
    min_intervals: int
    window_us: int
    missing: float
    period: float
    frequency: float
    sigmas: float
    burst: float
    burst_frames: int
    ignore: tuple[int, ...] = ()
    gap_us: int = 10_000_000
    scan_us: int = 10_000


@dataclass
class _Id:
    last: int | None = None
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    run: int = 0
    held: set = field(default_factory=set)


class Fold:
    """Reads (kind, ts, can_id) records in order. Kinds: frame, short_frame (a frame whose length is
    wrong: it isn't learnt from), tick (only time passes), gap (records were lost: what the rules measure
    starts over) and session (time starts over as well). A frame before its identifier's last one or
    in a window that is closed is reported, starts the rules over and counts for nothing else; so does a
    pause of more than ``gap_us``. All but a gap drop what is learnt so far; a learnt profile stays."""

    def __init__(self, settings: Settings, profile: dict[int, tuple[float, float]] | None = None):
        self.s, self.profile = settings, profile
        self.out: list[tuple] = []
        self.now: int | None = None
        self.ids: dict[int, _Id] = {}
        self.restart(True)

    def restart(self, learning: bool) -> None:
        drop = learning and self.profile is None
        self.ids = {} if drop else {k: _Id(None, v.n, v.mean, v.m2) for k, v in self.ids.items()}
        if drop:
            self.begin = None
        self.from_ts = self.scanned = None
        self.window, self.counts = 0, {}

    def latch(self, key, state: _Id, bad: bool, row: tuple) -> None:
        if bad and key not in state.held:
            self.out.append(row)
        (state.held.add if bad else state.held.discard)(key)

    def time(self, ts: int, current: int | None) -> None:
        s = self.s
        if self.now is not None and ts - self.now > s.gap_us:
            self.restart(True)
        self.now = now = ts if self.now is None else max(ts, self.now)
        if self.profile is None:
            if self.begin is None or now - self.begin < s.learn_us:
                return
            self.profile = {i: (x.mean, (x.m2 / x.n) ** 0.5) for i, x in self.ids.items() if x.n >= s.min_intervals}
        if self.from_ts is None:
            self.from_ts, self.window, self.counts = now, 0, {}
        while now >= self.from_ts + (self.window + 1) * s.window_us:
            end = self.from_ts + (self.window + 1) * s.window_us
            for i, (period, _) in self.profile.items():
                expected, n, x = s.window_us / period, self.counts.get(i, 0), self.ids.setdefault(i, _Id())
                margin = max(1.0, s.frequency * expected)
                self.latch("up", x, n > expected + margin, ("frequency_increase", end, i, float(n)))
                self.latch("down", x, n < expected - margin, ("frequency_decrease", end, i, float(n)))
            self.window, self.counts = self.window + 1, {}
        if self.scanned is None or now - self.scanned >= s.scan_us:
            self.scanned = now
            for i, (period, _) in self.profile.items():
                x = self.ids.setdefault(i, _Id())
                since = x.last if x.last is not None else self.from_ts
                if i != current:
                    self.latch("gone", x, now - since > s.missing * period, ("missing_frame", now, i, float(now - since)))

    def read(self, kind: str, ts: int | None, can_id: int | None) -> None:
        s = self.s
        if kind in ("gap", "session"):
            self.restart(kind == "session")
            self.now = None if kind == "session" else self.now
        if ts is None:
            return
        if kind not in ("frame", "short_frame") or can_id in s.ignore:
            self.time(ts, None)
            return
        last = self.ids.setdefault(can_id, _Id()).last
        closed = self.from_ts is not None and self.window > 0 and ts < self.from_ts + self.window * s.window_us
        if last is not None and ts < last or closed:
            self.out.append(("late_frame", ts, can_id, None))
            self.restart(True)
            return
        tested = self.profile is not None
        self.time(ts, can_id)
        x = self.ids.setdefault(can_id, _Id())
        last = x.last  # none after a pause
        if self.profile is None:
            if kind == "short_frame":
                return
            self.begin = ts if self.begin is None else self.begin
            if last is not None and ts > last:
                x.n += 1
                step = ts - last - x.mean
                x.mean += step / x.n
                x.m2 += step * (ts - last - x.mean)
        elif tested:
            self.counts[can_id] = self.counts.get(can_id, 0) + 1
            x.held.discard("gone")
            if last is not None and can_id in self.profile:
                period, std = self.profile[can_id]
                dt = ts - last
                self.latch("period", x, abs(dt - period) > s.period * period, ("period_violation", ts, can_id, float(dt)))
                if std > 0:
                    self.latch("sigma", x, abs(dt - period) > s.sigmas * std, ("statistical_deviation", ts, can_id, float(dt)))
                x.run = x.run + 1 if dt < s.burst * period else 0
                self.latch("burst", x, x.run >= s.burst_frames - 1, ("burst", ts, can_id, float(x.run + 1)))
        x.last = ts


def fold_traces(records: DataFrame, settings: Settings) -> DataFrame:
    """Events of each (trace, channel): ``records`` has trace, channel, ord, kind, ts_us, can_id.

    Spark sorts every group by ``ord`` and hands it over in Arrow batches, so a long trace needs
    the fold's small state and one batch at a time, whatever its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folds: dict[tuple, Fold] = {}
        newest = None
        for batch in batches:
            for r in batch.itertuples():
                key = (r.trace, r.channel)
                if key != newest:  # groups follow each other
                    folds, newest = {key: Fold(settings)}, key
                folds[key].read(r.kind, None if pd.isna(r.ts_us) else int(r.ts_us), None if pd.isna(r.can_id) else int(r.can_id))
                if folds[key].out:
                    rows = pd.DataFrame(folds[key].out, columns=["type", "ts_us", "can_id", "measured"])
                    folds[key].out = []
                    yield rows.assign(trace=r.trace, channel=r.channel)[["trace", "channel", "type", "ts_us", "can_id", "measured"]]

    rows = records.select("trace", "channel", "ord", "kind", "ts_us", "can_id")
    grouped = rows.repartition("trace", "channel").sortWithinPartitions("trace", "channel", "ord")
    return grouped.mapInPandas(run, "trace string, channel int, type string, ts_us long, can_id long, measured double")
