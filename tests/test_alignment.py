"""Alignment of frames in order against a plain walk over lists."""

import random
import time

import pytest
from pyspark.sql import functions as F

from busloom.operators.alignment import align_in_order, alignment_summary, order_totals

SCHEMA = "session string, no long, t_us long, sig int"


def plain(tx, rx, tolerance, reach=12):
    """Outcomes of one session, frame after frame."""
    near = lambda i, j: tx[i][1] == rx[j][1] and None not in (tx[i][0], rx[j][0]) and abs(rx[j][0] - tx[i][0]) <= tolerance
    i = j = 0
    matched, stopped = {}, False
    while i < len(tx) and j < len(rx):
        ahead = [
            (a + b, abs(rx[j + b][0] - tx[i + a][0]), a, b)
            for a in range(min(reach, len(tx) - i)) for b in range(min(reach, len(rx) - j)) if near(i + a, j + b)
        ]
        if not ahead:
            stopped = True
            break
        _, _, a, b = min(ahead)
        matched[i + a] = j + b
        i, j = i + a + 1, j + b + 1
    out = set()
    for k in range(len(tx)):
        choices = sum(near(k, m) for m in range(len(rx)))
        if k in matched:
            out.add(("matched", k, matched[k], rx[matched[k]][0] - tx[k][0], choices))
        else:
            out.add(("unresolved" if stopped and k >= i else "missing", k, None, None, choices))
    used = set(matched.values())
    return out | {("unresolved" if stopped and m >= j else "extra", None, m, None, 0) for m in range(len(rx)) if m not in used}


def traffic(rng, n, loss, more, kinds, run=0):
    tx = [(k * 10 + rng.randrange(5), rng.randrange(kinds)) for k in range(n)]
    rx = []
    for k, (t, s) in enumerate(tx):
        if rng.random() >= loss and not (run and 40 <= k < 40 + run):
            rx.append((t + rng.randrange(-6, 7), s))
        while rng.random() < more:
            rx.append((t + rng.randrange(4), rng.randrange(kinds)))
    return tx, rx


def table(spark, sides, which):
    rows = [(name, no, *frame) for name, pair in sides.items() for no, frame in enumerate(pair[which])]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("block", [13, 1024])
def test_alignment_is_the_plain_walk(spark, block):
    rng = random.Random(11)
    sides = {f"s{k}": traffic(rng, rng.randrange(20, 260), loss, more, kinds, run) for k, (loss, more, kinds, run) in enumerate(
        [(0, 0, 1, 0), (0, 0, 9, 0), (0.1, 0, 1, 0), (0.1, 0.05, 2, 0), (0.3, 0.2, 3, 0), (0.02, 0.02, 20, 30), (0.5, 0.4, 2, 0), (0, 0, 2, 11)])}
    sides["tx only"], sides["rx only"] = ([(5, 1), (6, 1)], []), ([], [(1, 1)])
    sides["nulls"] = ([(5, None), (None, 1), (30, 2), (31, 2)], [(6, None), (7, 1), (30, 2), (31, 2), (32, 2)])
    sides["unlike"] = ([(0, 1), (1, 1)], [(0, 2)])
    sides[None] = ([(0, 4), (10, 4)], [(10, 4)])
    got = align_in_order(table(spark, sides, 0), table(spark, sides, 1), ["sig"], 12, block=block)
    rows = got.collect()
    for name, (tx, rx) in sides.items():
        mine = [(r.outcome, r.tx_no, r.rx_no, r.residual_us, r.choices) for r in rows if r.session == name]
        assert len(mine) == len(set(mine)) and set(mine) == plain(tx, rx, 12), name
    told = {r.session: r for r in alignment_summary(got).collect()}
    assert told["s1"].exact_full_order and not told["s2"].exact_full_order and told["s5"].unresolved and not told["s0"].unresolved
    assert (told["unlike"].unresolved, told["tx only"].missing, told["rx only"].extra, told["nulls"].ambiguous) == (3, 2, 1, 2)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert align_in_order(none, none, ["sig"], 12).count() == 0


def test_work_grows_with_frames_not_with_pairs(spark):
    """400 million pairs could match here; the walk and the counts need none of them as rows."""
    n = 20_000
    frames = spark.range(n).selectExpr("'s' AS session", "id AS no", "id % 10 AS t_us", "1 AS sig")
    start = time.monotonic()
    got = align_in_order(frames, frames, ["sig"], 12, block=8192)
    told = got.groupBy("outcome").agg(F.count("*").alias("n"), F.min("choices"), F.max("choices"), F.sum(F.abs(F.col("tx_no") - F.col("rx_no")))).collect()
    assert [tuple(r) for r in told] == [("matched", n, n, n, 0)] and time.monotonic() - start < 60


def test_totals_of_dense_traffic(spark):
    n = 20_000
    frames = spark.range(n).selectExpr("'s' AS session", "id AS no", "id % 10 AS t_us", "1 AS sig")
    start = time.monotonic()
    told = alignment_summary(align_in_order(frames, frames.filter("no < 15000"), ["sig"], 12)).first()
    assert (told.matched, told.missing, told.extra, told.unresolved, told.ambiguous, told.max_residual_us) == (15_000, 5_000, 0, 0, 15_000, 0)
    assert not told.exact_full_order and time.monotonic() - start < 60


def test_totals_without_a_row_for_every_frame(spark):
    """As the summary of all frames: sessions that stop, of one side only, without a name, with frames without a time or signature."""
    rng = random.Random(29)
    sides = {f"s{k}": traffic(rng, rng.randrange(1, 90), loss, more, kinds, run) for k, (loss, more, kinds, run) in enumerate(
        [(0, 0, 1, 0), (0.1, 0.05, 2, 0), (0.3, 0.2, 3, 0), (0.02, 0.02, 20, 30), (0, 0, 2, 11)] * 2)}
    sides["tx only"], sides["rx only"] = ([(5, 1), (6, 1)], []), ([], [(1, 1)])
    sides["nulls"] = ([(5, None), (None, 1), (30, 2), (31, 2)], [(6, None), (7, 1), (30, 2), (31, 2), (32, 2)])
    sides["unlike"], sides[None] = ([(0, 1), (1, 1)], [(0, 2)]), ([(0, 4), (10, 4)], [(10, 4)])
    both = table(spark, sides, 0), table(spark, sides, 1)
    got, told = order_totals(*both, ["sig"], 12, block=32), alignment_summary(align_in_order(*both, ["sig"], 12, block=32))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == told.columns and len(rows) == len(sides) and set(rows) == {tuple(r) for r in told.collect()}
