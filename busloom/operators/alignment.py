"""Order alignment of sent and received frames: a greedy walk over both sequences, cut into rounds.

The walk's state is the pair it matched last, and the next pair follows from that one and at most ``reach`` frames ahead on
either side. So no table of all pairs that could match is needed (they grow with the square of the traffic's
density): each round walks the next ``block`` frames of every session from the pair at which the round before left it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.sources.streams import shared_folder, stored

from .ranges import count_in_ranges
from .timeline import join_null_safe

#: Pairs of the path; ``more`` is null but in the last row of a session that goes on, which is where it goes on.
PATH = "session string, i long, j long, residual_us long, more boolean"
#: The start comes before the first pair.
START = -1


def _walk(signature: list[str], tolerance: int, reach: int, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The walk over the next ``block`` frames of both sides of one session, after the pair (``i``, ``j``)."""

    def same(rows: pd.DataFrame) -> np.ndarray:
        """Equal numbers for equal signatures; nulls equal each other."""
        codes = np.zeros(len(rows), "int64")
        for c in signature:
            for values in (rows[c], rows[f"_null_{c}"]):
                codes = pd.factorize(codes * len(rows) + pd.factorize(values, use_na_sentinel=False)[0])[0].astype("int64")
        return codes

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        session, i, j = rows["session"].iat[0], int(rows["i"].iat[0]), int(rows["j"].iat[0])
        rows = rows.assign(_sig=same(rows))
        tx, rx = (rows[rows["_side"] == k].sort_values("no") for k in (0, 1))
        # Frames without a time match nothing.
        tx_sig, rx_sig = (side["_sig"].where(side["_timed"], none).tolist() for side, none in ((tx, -1), (rx, -2)))
        tx_t, rx_t = tx["t_us"].tolist(), rx["t_us"].tolist()
        n_tx, n_rx, found, more, x, y = len(tx), len(rx), [], False, 0, 0
        while True:
            if (n_tx == block and x + reach > n_tx) or (n_rx == block and y + reach > n_rx):
                more = True  # the window reaches beyond the block
                break
            best, wide, high = None, min(reach, n_tx - x), min(reach, n_rx - y)
            for skipped in range(wide + high - 1 if wide and high else 0):
                for a in range(max(0, skipped - high + 1), min(wide, skipped + 1)):
                    b = skipped - a
                    if tx_sig[x + a] == rx_sig[y + b]:
                        residual = rx_t[y + b] - tx_t[x + a]
                        if abs(residual) <= tolerance and (best is None or abs(residual) < abs(best[2])):
                            best = a, b, residual
                if best is not None:
                    break
            if best is None:
                break
            x, y = x + best[0] + 1, y + best[1] + 1
            found.append((i + x, j + y, best[2], None))
        if more:
            found.append((i + x, j + y, None, True))
        out = pd.DataFrame(found, columns=["i", "j", "residual_us", "more"], dtype=object)
        out = out.astype({"i": "int64", "j": "int64", "residual_us": "Int64", "more": "boolean"})
        out.insert(0, "session", pd.Series([session] * len(out), dtype=object))
        return out

    return walk


def _cut(frames: DataFrame, signature: list[str], block: int) -> DataFrame:
    """The frames in the shared folder, in parts of ``block`` of each session, so that a round reads the parts that it needs."""
    rows = frames.select(
        "session", F.col("no").cast("long").alias("no"), F.coalesce(F.col("t_us").cast("long"), F.lit(0)).alias("t_us"), F.col("t_us").isNotNull().alias("_timed"),
        *signature, *[F.col(c).isNull().alias(f"_null_{c}") for c in signature], F.floor(F.col("no") / block).alias("_part"),
    )
    path = shared_folder(rows.sparkSession)
    rows.write.partitionBy("_part").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def greedy_path(tx: DataFrame, rx: DataFrame, signature: list[str], tolerance: int, reach: int, block: int) -> DataFrame:
    """The pairs (session, i, j, residual_us) that the walk matches, of frames cut into parts of ``block``: from a pair on, of the pairs at most ``reach`` frames on, on both
    sides, the one with the fewest frames skipped, then the smaller residual, then the earlier sent frame.

    A round takes up to ``block`` frames of either side of each session, so no task gets more, and there are
    about as many rounds as the longest session has blocks. The driver gets four numbers a round.
    """
    sides = {"i": tx, "j": rx}
    both = tx.select("session").unionByName(rx.select("session")).distinct()
    at = both.select("session", *[F.lit(START).cast("long").alias(c) for c in sides])
    ends = {c: (START, START) for c in sides}
    rounds = []
    while ends is not None:
        parts = []
        for k, (c, frames) in enumerate(sides.items()):
            first, last = (ends[c][0] + 1) // block, (ends[c][1] + block) // block
            near = join_null_safe(frames.filter(F.col("_part").between(first, last)).drop("_part"), at, ["session"])
            parts.append(near.filter((F.col("no") > F.col(c)) & (F.col("no") <= F.col(c) + block)).withColumn("_side", F.lit(k)))
        steps = stored(parts[0].unionByName(parts[1]).groupBy("session").applyInPandas(_walk(signature, tolerance, reach, block), PATH))
        rounds.append(steps.filter("more is null").drop("more"))
        at = steps.filter("more").select("session", *sides)
        least = at.agg(*[f(c) for c in sides for f in (F.min, F.max)]).first()  # four numbers
        ends = None if least[0] is None else {"i": (least[0], least[1]), "j": (least[2], least[3])}
    return reduce(DataFrame.unionByName, rounds)


def align_in_order(tx: DataFrame, rx: DataFrame, signature: list[str], tolerance: int, reach: int = 12, block: int = 2**18) -> DataFrame:
    """Every frame of both sides with what became of it: ``session``, ``outcome``, ``tx_no``, ``rx_no``,
    ``residual_us`` and ``choices`` (received frames that the sent one could have been matched with).

    ``tx`` and ``rx`` have session (string), ``no`` (position from 0 in the session's order), ``t_us`` (on one clock) and the
    ``signature`` columns. Frames are matched in order and one to one: after a pair comes, of the pairs fewer
    than ``reach`` frames ahead on both sides, that which skips fewest frames, with residual at
    most ``tolerance``. Outcomes: matched, missing (sent only), extra (received only), and unresolved for all frames after
    a place where nothing within reach matches while both sides still have frames. Null signatures
    equal each other, frames without a time match nothing, and a session of one side only is all missing or extra.

    ``choices`` are counted by running sums, not from pairs. No session of more than ``block`` frames passes one task whole.
    """
    block = max(block, reach)
    tx, rx = (_cut(df, signature, block) for df in (tx, rx))
    sides = {"tx": tx, "rx": rx}
    keys, width = ["session", *signature], 4 * max(tolerance, 1)
    told = count_in_ranges(rx.filter("_timed"), "t_us", tx.filter("_timed"), F.col("t_us") - tolerance, F.col("t_us") + tolerance, keys, ["session", "no"], width).withColumnRenamed("n", "choices")
    sessions = tx.select("session").unionByName(rx.select("session")).distinct()
    path = greedy_path(tx, rx, signature, tolerance, reach, block)
    ends = path.groupBy("session").agg(F.max("i").alias("tx_end"), F.max("j").alias("rx_end"))
    counts = [df.groupBy("session").agg(F.count("*").alias(f"{s}_all")).withColumnRenamed("session", f"_{s}") for s, df in sides.items()]
    stop = sessions.join(ends.withColumnRenamed("session", "_p"), F.col("session").eqNullSafe(F.col("_p")), "left")
    for s, n in zip(sides, counts):
        stop = stop.join(n, F.col("session").eqNullSafe(F.col(f"_{s}")), "left").withColumn(f"{s}_end", F.coalesce(f"{s}_end", F.lit(-1)) + 1)
    open_ = (F.col("tx_end") < F.coalesce("tx_all", F.lit(0))) & (F.col("rx_end") < F.coalesce("rx_all", F.lit(0)))
    stop = stop.filter(open_).select(F.col("session").alias("_session"), "tx_end", "rx_end")  # one row a session that stops

    chosen = path.select("session", F.col("i").alias("no"), F.col("j").alias("rx_no"), "residual_us")
    sent = join_null_safe(join_null_safe(tx.select("session", "no"), told, ["session", "no"], "left"), chosen, ["session", "no"], "left")
    sent = _stopped(sent, stop, "tx_end", F.col("rx_no").isNotNull(), "missing").withColumnRenamed("no", "tx_no")
    used = path.select(F.col("session").alias("_session"), F.col("j").alias("_no"))
    rest = rx.select("session", "no").join(used, F.col("session").eqNullSafe(F.col("_session")) & (F.col("no") == F.col("_no")), "left_anti")
    rest = _stopped(rest, stop, "rx_end", F.lit(False), "extra").withColumnRenamed("no", "rx_no")
    out = sent.unionByName(rest, allowMissingColumns=True)
    return out.select("session", "outcome", "tx_no", "rx_no", "residual_us", F.coalesce("choices", F.lit(0)).alias("choices"))


def order_totals(tx: DataFrame, rx: DataFrame, signature: list[str], tolerance: int, reach: int = 12, block: int = 2**18) -> DataFrame:
    """The rows of ``alignment_summary(align_in_order(...))``, without a row for every frame: outcomes follow from the sessions'
    numbers of frames and from their pairs' number and last one, and ``choices`` are counted for matched frames only.
    """
    block = max(block, reach)
    tx, rx = (_cut(df, signature, block) for df in (tx, rx))
    path = greedy_path(tx, rx, signature, tolerance, reach, block)
    sent = join_null_safe(tx.select("session", "no", "t_us", *signature), path.select("session", F.col("i").alias("no")), ["session", "no"], "left_semi")
    near = F.col("t_us") - tolerance, F.col("t_us") + tolerance
    told = count_in_ranges(rx.filter("_timed"), "t_us", sent, *near, ["session", *signature], ["session", "no"], 4 * max(tolerance, 1))
    parts = [
        *[df.groupBy("session").agg(F.count("*").alias(f"{s}_all")) for s, df in (("tx", tx), ("rx", rx))],
        path.groupBy("session").agg(F.count("*").alias("matched"), (F.max("i") + 1).alias("tx_end"), (F.max("j") + 1).alias("rx_end"), F.max(F.abs("residual_us")).alias("max_residual_us")),
        told.filter("n > 1").groupBy("session").agg(F.count("*").alias("ambiguous")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)  # four rows a session at most
    rows = every.groupBy("session").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in every.columns if c != "session"])
    stops = (F.col("tx_end") < F.col("tx_all")) & (F.col("rx_end") < F.col("rx_all"))
    rows = rows.withColumns({f"{s}_until": F.when(stops, F.col(f"{s}_end")).otherwise(F.col(f"{s}_all")) for s in ("tx", "rx")})
    return _exact(rows.select(
        "session", "matched", (F.col("tx_until") - F.col("matched")).alias("missing"), (F.col("rx_until") - F.col("matched")).alias("extra"),
        (F.col("tx_all") - F.col("tx_until") + F.col("rx_all") - F.col("rx_until")).alias("unresolved"), "ambiguous", "max_residual_us",
    ))


def _exact(totals: DataFrame) -> DataFrame:
    return totals.withColumn("exact_full_order", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("unresolved") == 0))


def _stopped(frames: DataFrame, stop: DataFrame, end: str, matched: Column, otherwise: str) -> DataFrame:
    outcome = F.when(matched, "matched").when(F.col("no") >= F.col("_end"), "unresolved").otherwise(otherwise)
    ends = stop.select(F.col("_session"), F.col(end).alias("_end"))
    return frames.join(ends, F.col("session").eqNullSafe(F.col("_session")), "left").withColumn("outcome", outcome).drop("_session", "_end")


def alignment_summary(frames: DataFrame) -> DataFrame:
    """Per session of ``align_in_order``: frames by outcome, ambiguous matches, whether all frames matched in
    order, and the largest residual of a match."""
    of = lambda name: F.count(F.when(F.col("outcome") == name, 1))
    out = frames.groupBy("session").agg(
        *[of(name).alias(name) for name in ("matched", "missing", "extra", "unresolved")],
        F.count(F.when((F.col("outcome") == "matched") & (F.col("choices") > 1), 1)).alias("ambiguous"),
        F.coalesce(F.max(F.abs("residual_us")), F.lit(0)).alias("max_residual_us"),
    )
    return _exact(out)
