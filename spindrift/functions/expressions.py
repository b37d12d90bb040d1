"""Column expressions: intervals, vectors as arrays, labels and decisions. No Python runs on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.special import norm_ppf


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def wilson(k, n, alpha: float = 0.05) -> Column:
    """struct(estimate, lower, upper) of a binomial proportion by the score interval; null without trials."""
    k, n = _c(k).cast("double"), _c(n).cast("double")
    z = F.lit(norm_ppf(1 - alpha / 2))
    p, scale = k / n, 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    low = F.when(k == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(k == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return F.when(n > 0, F.struct(p.alias("estimate"), low.alias("lower"), high.alias("upper")))


def newcombe(k1, n1, k2, n2, alpha: float = 0.05) -> Column:
    """struct(estimate, lower, upper) of p2 - p1 by the hybrid score interval."""
    a, b = wilson(k1, n1, alpha), wilson(k2, n2, alpha)
    est = b["estimate"] - a["estimate"]
    low = est - F.sqrt(F.pow(b["estimate"] - b["lower"], 2) + F.pow(a["upper"] - a["estimate"], 2))
    high = est + F.sqrt(F.pow(b["upper"] - b["estimate"], 2) + F.pow(a["estimate"] - a["lower"], 2))
    return F.struct(est.alias("estimate"), F.greatest(F.lit(-1.0), low).alias("lower"), F.least(F.lit(1.0), high).alias("upper"))


def psi_e(lam) -> Column:
    lam = _c(lam)
    return (-F.log1p(-lam) - lam) / 4.0


def sigmoid(z) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), _c(z)))))


# vectors as array<double>
def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def difference(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def distance(a, b) -> Column:
    return norm(difference(a, b))


def mean(v) -> Column:
    v = _c(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def mean_vector(m) -> Column:
    """Mean over the rows of an array of equal-length arrays."""
    m = _c(m)
    zero = F.transform(F.element_at(m, 1), lambda x: F.lit(0.0))
    total = F.aggregate(m, zero, lambda s, row: F.zip_with(s, row, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(m))


def chunk_variance(m) -> Column:
    """Summed variance (over n) of the columns of an array of equal-length arrays."""
    m = _c(m)
    centre = mean_vector(m)
    squares = F.aggregate(m, F.lit(0.0), lambda s, row: s + F.aggregate(F.zip_with(row, centre, lambda x, c: (x - c) * (x - c)), F.lit(0.0), lambda a, x: a + x))
    return squares / F.size(m)


def row_steps(m) -> Column:
    """Distances between consecutive rows of an array of arrays."""
    m = _c(m)
    return F.transform(F.sequence(F.lit(2), F.size(m)), lambda i: distance(F.element_at(m, i), F.element_at(m, i - 1)))


def quaternion_of_yaw(degrees) -> Column:
    half = F.radians(_c(degrees)) / 2
    return F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))


def binary_label(v) -> Column:
    """1 or 0 of a success or failure word; anything else but null raises."""
    s = F.lower(F.trim(_c(v).cast("string")))
    return (
        F.when(s.isin("success", "succeeded", "1", "true", "pass"), 1)
        .when(s.isin("failure", "fail", "failed", "0", "false"), 0)
        .when(s.isNotNull(), F.raise_error(F.concat(F.lit("unrecognised label "), s)).cast("int"))
    )


def grade(delta, warn: float, fail: float) -> Column:
    size = F.abs(_c(delta))
    return F.when(size >= fail, "fail").when(size >= warn, "warn").otherwise("ok")


def is_unknown(v) -> Column:
    s = _c(v).cast("string")
    return s.isNull() | s.isin("", "unknown", "[]")


def abstain_decision(score, t_fail, t_succ, strict: bool = False) -> Column:
    """success, failure or abstain of a score against two thresholds; fitting neither goes to the nearer one unless strict."""
    s, f, t = _c(score), _c(t_fail), _c(t_succ)
    neither = F.lit("abstain") if strict else F.when(s >= 0.5 * (f + t), "success").otherwise("failure")
    return F.when((s >= t) & (s > f), "success").when((s <= f) & (s < t), "failure").when((s >= t) & (s <= f), "abstain").otherwise(neither)


def plain_decision(score, parse_error, fused) -> Column:
    """Without calibration: half decides, an unparsed reply without fusion abstains."""
    return F.when(_c(parse_error) & ~_c(fused), "abstain").when(_c(score) >= 0.5, "success").otherwise("failure")


def standardised(x, centre, scale) -> Column:
    return (_c(x) - _c(centre)) / _c(scale)


def weighted_composite(values: list, weights: list[float]) -> Column:
    """Weighted mean of the components that are not null; null if none is."""
    cols = [_c(v) for v in values]
    top = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in zip(cols, weights, strict=True)), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(cols, weights, strict=True)), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def head_excess(scores: list, thresholds: list) -> Column:
    """Largest of score minus threshold over the heads that have a score."""
    return F.greatest(*[_c(s) - _c(t) for s, t in zip(scores, thresholds, strict=True)]) if len(scores) > 1 else _c(scores[0]) - _c(thresholds[0])


def normalised(x, kind: str, a, b) -> Column:
    """mean_std: (x - a) / b; min_max: to [-1, 1] between a and b; identity."""
    x, a, b = _c(x), _c(a), _c(b)
    return {"mean_std": (x - a) / F.greatest(b, F.lit(1e-8)), "min_max": 2 * (x - a) / F.greatest(b - a, F.lit(1e-8)) - 1, "identity": x}[kind]


def unnormalised(x, kind: str, a, b) -> Column:
    x, a, b = _c(x), _c(a), _c(b)
    return {"mean_std": x * F.greatest(b, F.lit(1e-8)) + a, "min_max": (x + 1) / 2 * F.greatest(b - a, F.lit(1e-8)) + a, "identity": x}[kind]


def iso_to_ns(v) -> Column:
    """Nanoseconds since the epoch of an ISO-8601 string; 0 if it is none."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(_c(v))) * 1000, F.lit(0)).cast("long")


def policy_seed(seed, scenario_hash) -> Column:
    """First four bytes, big-endian, of sha256('seed:hash')."""
    digest = F.sha2(F.concat_ws(":", _c(seed).cast("string"), _c(scenario_hash)).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def leading_bits(text, start: int = 0) -> Column:
    """Four bytes, big-endian, of the text's sha1 from byte `start` on, as a long."""
    return F.conv(F.substring(F.sha1(_c(text).cast("binary")), 2 * start + 1, 8), 16, 10).cast("long")


def unit_float(text) -> Column:
    """A stable number of a text: the first eight bytes of its sha1 over 2**64, rounded to the nearest double.

    Rounding may reach the next multiple of 2**-32; what must agree with the
    digest's own bytes takes `leading_bits`.
    """
    return leading_bits(text) / math.pow(2, 32) + leading_bits(text, 4) / math.pow(2, 64)


def evenly(n, k: int) -> Column:
    """Indices of k of n frames, first and last included, by half-even rounding, without repeats."""
    n = _c(n)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / float(max(k - 1, 1))).cast("int")))
    return F.when(n <= k, F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(spread)
