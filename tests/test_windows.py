"""Windows anchored at data and exact count deviations, against plain loops."""

import random
from fractions import Fraction

import pytest

from busloom.operators import features
from busloom.operators.timeline import Timeline

LINE = Timeline(("channel",), ("ord",), "ord div 5")


def plain(rows, width):
    """Record by record: (channel, ord) -> segment, anchor, window."""
    out, state = {}, {}
    for channel, order, session, ts in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if ts is None:
            continue
        n, was, anchor, start = state.get(channel, (0, None, None, None))
        if anchor is None or was != session or ts < start:
            n, anchor, start = n + 1, ts, ts
        while ts >= start + width:
            start += width
        state[channel] = n, session, anchor, start
        out[channel, order] = n, anchor, (start - anchor) // width
    return out


def test_anchored_windows_equal_a_plain_loop(spark):
    rng = random.Random(8)
    rows = []
    for channel in (1, 2, None):
        ts, session = -50, 0
        for order in range(150):
            ts += rng.choice([0, 1, 3, 9, 40, -2, -6, -120 if rng.random() < 0.2 else 4])
            session = None if rng.random() < 0.02 else (session or 0) + (rng.random() < 0.04)
            rows.append((channel, order, session, None if rng.random() < 0.05 else ts))
    table = spark.createDataFrame(rows, "channel int, ord long, session long, ts_us long").repartition(4)
    got = {(r.channel, r.ord): (r.segment, r.anchor_us, r.window) for r in features.anchored_windows(table, LINE, "session", 10).collect()}
    assert got == plain(rows, 10)
    assert features.anchored_windows(table.filter("ord < 0"), LINE, "session", 10).count() == 0
    with pytest.raises(ValueError):
        features.anchored_windows(table, LINE, "session", 0)


def test_counts_at_the_bound_are_inside_however_dealt(spark):
    learnt = {141: [2, 2, 2, 3, 1, 2, 0, 0], 7: [4, 4, 4], 9: [10**9], 11: [0, 10**6, 3]}
    rng = random.Random(1)
    learnt |= {i: [rng.randint(0, 6) for _ in range(rng.randint(1, 9))] for i in range(20, 60)}
    counts = [(i, w, n) for i in learnt for w, n in enumerate([0, 1, 2, 3, 4, 5, 9, 2 * 10**6])]
    want = set()
    for i, w, n in counts:
        N, S, Q = len(learnt[i]), sum(learnt[i]), sum(x * x for x in learnt[i])
        spread = N * Q - S * S
        if spread == 0:
            want.add((i, None, None, "disabled"))
        elif (N * n - S) ** 2 > Fraction(9, 4) * spread:
            want.add((i, w, n, "deviation"))
    base = spark.createDataFrame([(i, n) for i, ns in learnt.items() for n in ns], "can_id long, n long")
    tested = spark.createDataFrame(counts, "can_id long, window long, n long")
    for parts in (1, 7):
        got = features.count_deviations(tested, features.count_moments(base.repartition(parts)), "1.5").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
