"""The guard and the sequential test over live streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spindrift.operators.guard import Levels

EVENT = "episode_id string, step int, t double, level string, changed boolean"
STATE = "level int, above int, below int, stopped boolean, next_step int, held array<struct<step:int,t:double,score:double,threshold:double,violation:boolean>>"


def guard_levels(steps: DataFrame, patience: int = 3, hysteresis: float = 0.1, idle: str = "10 minutes") -> DataFrame:
    """Levels of a stream of (episode_id, step, t, score, threshold, violation, ts).

    Steps may arrive out of order: an episode's state holds those that are ahead
    and emits the contiguous run from the next one due, so the fold sees the same
    order as in a batch.  A repeated step is ignored.  State is dropped when an
    episode has been silent for `idle` of event time; what it still held is then
    folded in order.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, above, below, stopped, due, held = state.get if state.exists else (0, 0, 0, False, 0, [])
        waiting = {int(h["step"] if isinstance(h, dict) else h[0]): tuple(h.values()) if isinstance(h, dict) else tuple(h) for h in held}
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if r.step >= due:
                    score = None if pd.isna(r.score) else float(r.score)
                    waiting.setdefault(int(r.step), (int(r.step), float(r.t), score, float(r.threshold), bool(r.violation)))
        fsm, out = Levels(patience, hysteresis, level, above, below, stopped), []
        before = "stop" if stopped else ("ok", "slow", "handover")[level]
        last = state.hasTimedOut
        for s in sorted(waiting):
            if s != due and not last:
                break
            _, t, score, threshold, violation = waiting.pop(s)
            now = fsm.step(score, threshold, violation)
            out.append((key[0], s, t, now, now != before))
            before, due = now, s + 1
        if last:
            state.remove()
        else:
            state.update((fsm.level, fsm.above, fsm.below, fsm.stopped, due, [waiting[s] for s in sorted(waiting)]))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 1 + _milliseconds(idle))
        yield pd.DataFrame(out, columns=["episode_id", "step", "t", "level", "changed"])

    marked = steps.withWatermark("ts", idle)
    return marked.groupBy("episode_id").applyInPandasWithState(run, EVENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(float(n) * {"second": 1e3, "minute": 6e4, "hour": 3.6e6}[unit.rstrip("s")])


def running_comparison(pairs: DataFrame, alpha: float = 0.05, margin: float = 0.0, least: int = 5) -> DataFrame:
    """The anytime-valid comparison over a stream of (comparison, a, b): after each batch a row (comparison, n, estimate, lower, upper, decision).

    The interval holds at every time at once, so it may be looked at after any batch.
    """
    log_term = math.log(2 / alpha)

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s1, s2, slx, sl, sv, decision = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, "undecided")
        low, high, centre = 0.0, 1.0, 0.5
        for pdf in frames:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, mu = (b - a + 1) / 2, (0.5 + s1) / (n + 1)
                var = max((0.25 + s2 - 2 * mu * s1 + n * mu * mu) / (n + 1), 1e-12)
                n += 1
                lam = min(math.sqrt(2 * log_term / (var * n * math.log(n + 1))), 0.5)
                sv += 4 * (x - mu) ** 2 * (-math.log1p(-lam) - lam) / 4
                slx, sl, s1, s2 = slx + lam * x, sl + lam, s1 + x, s2 + x * x
                centre, radius = slx / sl, (log_term + sv) / sl
                low, high = max(0.0, centre - radius), min(1.0, centre + radius)
                if n >= least:
                    inside = margin > 0 and 2 * low - 1 > -margin and 2 * high - 1 < margin
                    decision = "B_better" if 2 * low - 1 > margin else "A_better" if 2 * high - 1 < -margin else "no_difference_within_margin" if inside else decision
        state.update((n, s1, s2, slx, sl, sv, decision))
        yield pd.DataFrame([(key[0], n, 2 * centre - 1, 2 * low - 1, 2 * high - 1, decision)], columns=["comparison", "n", "estimate", "lower", "upper", "decision"])

    return pairs.select("comparison", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")).groupBy("comparison").applyInPandasWithState(
        run, "comparison string, n long, estimate double, lower double, upper double, decision string", "n long, s1 double, s2 double, slx double, sl double, sv double, decision string", "update", GroupStateTimeout.NoTimeout
    )
