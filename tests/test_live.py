"""The exact fold on hand-made traces, and against the relational rules."""

import random

from busloom.plans.live import Fold, Settings, fold_traces

S = Settings(learn_us=300_000, min_intervals=2, window_us=10**9, missing=3.0, period=0.3, frequency=0.5, sigmas=3.0, burst=0.25, burst_frames=4)


def events(records, settings=S, profile=None):
    fold = Fold(settings, profile)
    for r in records:
        fold.read(*r)
    return fold


def test_learning_freezes_once_and_finds_the_late_frame():
    ms = 1000
    fold = events([("frame", t * ms, 1) for t in (1000, 1100, 1200, 1300, 1400, 1600)])
    assert fold.profile == {1: (100_000.0, 0.0)}
    assert [e[:3] for e in fold.out] == [("period_violation", 1_600_000, 1)]  # no deviation: the sigma rule is off


def test_missing_is_raised_once_and_armed_again():
    profile = {1: (100_000.0, 0.0)}
    fold = events([("frame", 1_000_000, 1), ("tick", 1_400_000, None), ("tick", 1_500_000, None)], profile=profile)
    assert [e[:3] for e in fold.out] == [("missing_frame", 1_400_000, 1)]
    fold.read("frame", 1_600_000, 1)
    fold.read("tick", 2_000_000, None)
    assert [e[0] for e in fold.out].count("missing_frame") == 2


def test_lost_records_reset_intervals():
    profile = {1: (100_000.0, 10.0)}
    fold = events([("frame", 1_000_000, 1), ("gap", None, None), ("frame", 1_500_000, 1)], profile=profile)
    assert [e for e in fold.out if e[0] in ("period_violation", "statistical_deviation")] == []


def test_bursts_and_late_frames():
    profile = {1: (100_000.0, 0.0)}
    fold = events([("frame", 1_000_000 + k * 1000, 1) for k in range(6)] + [("frame", 900_000, 1)], profile=profile)
    assert [e[0] for e in fold.out].count("burst") == 1 and fold.out[-1][0] == "late_frame"


def test_frequency_counts_silent_windows():
    s = Settings(**{**S.__dict__, "window_us": 1_000_000, "missing": 1e9})
    fold = events([("frame", k * 100_000, 1) for k in range(11)] + [("tick", 4_100_000, None)], s, {1: (100_000.0, 0.0)})
    assert [e[:2] for e in fold.out] == [("frequency_decrease", 2_000_000)]


def test_a_learnt_profile_outlives_gaps_late_frames_and_pauses():
    ms = 1000
    learnt = [("frame", t * ms, 1) for t in (1000, 1100, 1200, 1300, 1400)]
    for cut in ([("gap", None, None)], [("frame", 1350 * ms, 1)], [("session", None, None)], [("tick", 20_000 * ms, None)]):
        fold = events([*learnt, *cut])
        assert fold.profile == {1: (100_000.0, 0.0)}
        fold.read("frame", 21_000 * ms, 1)
        before = len(fold.out)
        fold.read("frame", 21_200 * ms, 1)
        assert [e[:2] for e in fold.out[before:]] == [("period_violation", 21_200 * ms)]


def test_the_first_interval_after_learning_is_tested():
    ms = 1000
    fold = events([("frame", t * ms, 1) for t in (1000, 1100, 1200, 1300, 1500)])
    assert [e[:3] for e in fold.out] == [("period_violation", 1_500_000, 1)]


def test_gaps_keep_what_is_learnt_so_far_and_short_frames_teach_nothing():
    ms = 1000
    head = [("frame", 1000 * ms, 1), ("frame", 1100 * ms, 1), ("frame", 1200 * ms, 1)]
    tail = [("frame", 1260 * ms, 1), ("frame", 1310 * ms, 1)]
    assert events([*head, ("gap", None, None), *tail]).profile == {1: (100_000.0, 0.0)}
    assert events([*head, ("session", None, None), *tail]).profile is None
    assert events([*head[:2], ("short_frame", 1150 * ms, 1), *head[2:], ("frame", 1300 * ms, 1)]).profile == {1: (100_000.0, 0.0)}


def test_a_late_frame_is_only_reported():
    profile = {1: (100_000.0, 0.0)}
    fold = events([("frame", 1_000_000, 1), ("frame", 900_000, 1), ("frame", 1_250_000, 1)], profile=profile)
    assert [e[0] for e in fold.out] == ["late_frame"]  # no interval from or to it


def test_traces_in_parallel(spark):
    rng = random.Random(2)
    rows = []
    for trace in ("a", "b", "c"):
        for channel in (1, 2):
            ts = 0
            for k in range(300):
                ts += rng.choice([90_000, 100_000, 110_000, 400_000 if k > 50 else 100_000])
                rows.append((trace, channel, k, "frame", ts, rng.choice([1, 1, 2])))
    df = spark.createDataFrame(rows, "trace string, channel int, ord long, kind string, ts_us long, can_id long").repartition(7)
    got = sorted(tuple(r) for r in fold_traces(df, S).collect())
    want = []
    for trace in ("a", "b", "c"):
        for channel in (1, 2):
            own = [(k, t, c) for tr, ch, _, k, t, c in rows if (tr, ch) == (trace, channel)]
            want += [(trace, channel, *e) for e in events(own).out]
    assert got == sorted(want) and got
