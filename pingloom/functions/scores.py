"""Column expressions of scores. Missing evidence is null and takes no part; it never counts as 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the evidence policies.
EVIDENCE_WEIGHTS = {"detector": 0.30, "persistence": 0.25, "physics": 0.18, "quality": 0.15, "anomaly": 0.07, "artificiality": 0.05}
PRIORITY_WEIGHTS = {"confidence": 0.30, "persistence": 0.20, "anomaly_evidence": 0.15, "footprint": 0.15, "class_weight": 0.12, "newness": 0.08}
CLASS_WEIGHTS = {"DERELICT_FISHING_GEAR": 1.00, "WRECK_OR_STRUCTURAL_DEBRIS": 0.70, "PIPELINE": 0.60, "ENGINEERING_STRUCTURE": 0.50}
UNKNOWN_CLASS_WEIGHT = 0.75
NEWNESS = {"NEW": 1.00, "MOVED": 0.80, "UNCHANGED": 0.40, "NOT_REOBSERVED": 0.30, "OUT_OF_COVERAGE": 0.50}
NO_COMPARISON = 0.60
FOOTPRINT_CAP_M2 = 200.0
NEUTRAL_PERSISTENCE = 0.5
WILSON_Z = 1.6448536269514722
DISPLAY_LOWER, DISPLAY_UPPER, DISPLAY_CENTRE, DISPLAY_STEEPNESS = 0.70, 0.90, 0.3139777305538386, 28.0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def display_confidence(raw: Column) -> Column:
    """Bounded increasing presentation of a raw score in [0, 1]; null outside it."""
    value = DISPLAY_LOWER + (DISPLAY_UPPER - DISPLAY_LOWER) / (1 + F.exp(-DISPLAY_STEEPNESS * (raw - DISPLAY_CENTRE)))
    return F.when(raw.between(0, 1) & ~F.isnan(raw), value)


def wilson_lower(successes: Column, trials: Column) -> Column:
    p = successes / trials
    zz = WILSON_Z * WILSON_Z
    radius = WILSON_Z * F.sqrt((p * (1 - p) + zz / (4 * trials)) / trials)
    return clamp((p + zz / (2 * trials) - radius) / (1 + zz / trials))


def weighted_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the available values, their weights scaled to 1; null if none is there."""
    total = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), F.lit(weights[k])).otherwise(0.0) for k, v in values.items()])
    part = reduce(lambda a, b: a + b, [F.coalesce(v * weights[k], F.lit(0.0)) for k, v in values.items()])
    return F.when(total > 0, part / total)


def missing(values: dict[str, Column]) -> Column:
    """Names of null values in alphabetical order."""
    return F.array_compact(F.array(*[F.when(values[k].isNull(), F.lit(k)) for k in sorted(values)]))


def noisy_or(supports: list[tuple[Column, float]], agreement: float) -> Column:
    """1 - prod(1 - w s) over positive supports, raised by the mean product of their pairs."""
    s = [F.when(v > 0, v).otherwise(0.0) for v, _ in supports]
    base = 1 - reduce(lambda a, b: a * b, [1 - w * x for x, (_, w) in zip(s, supports, strict=True)])
    n = reduce(lambda a, b: a + b, [F.when(v > 0, 1).otherwise(0) for v, _ in supports])
    total = reduce(lambda a, b: a + b, s)
    squares = reduce(lambda a, b: a + b, [x * x for x in s])
    signal = F.when(n > 1, (total * total - squares) / (n * (n - 1))).otherwise(0.0)
    return clamp(base + (1 - base) * agreement * signal)
