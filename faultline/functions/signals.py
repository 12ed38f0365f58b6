"""Bounded signals, similarities and edge weights as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clamp

#: Attenuation and priority of the relation families, and the prior of each in the weight of an edge.
FAMILIES = {
    "FAULT_SOURCE": (0.10, 7),
    "CONTROL": (0.14, 6),
    "MATERIAL_FLOW": (0.20, 5),
    "ENERGY_TRANSFER": (0.26, 4),
    "PHASE_CHANGE": (0.30, 3),
    "COMPOSITION": (0.24, 2),
    "OBSERVATION": (0.32, 1),
}
PRIORS = {
    "FAULT_SOURCE": 1.65,
    "CONTROL": 1.35,
    "MATERIAL_FLOW": 1.05,
    "ENERGY_TRANSFER": 0.75,
    "PHASE_CHANGE": 0.55,
    "COMPOSITION": 0.70,
    "OBSERVATION": 0.35,
}


def of_family(family: Column, values: dict, otherwise: float = 0.0) -> Column:
    """The family's value of a small table; of a family that it does not have: `otherwise`."""
    out = F.lit(otherwise)
    for name, value in values.items():
        out = F.when(family == name, F.lit(value)).otherwise(out)
    return out


def excess(value: Column, threshold: float, scale: float) -> Column:
    """How far above the threshold, in scales, from 0 to 1."""
    return F.round(clamp((value - threshold) / scale), 8)


def abs_excess(value: Column, threshold: float, scale: float) -> Column:
    return excess(F.abs(value), threshold, scale)


def shortfall(value: Column, threshold: float, scale: float) -> Column:
    """How far below the threshold, in scales, from 0 to 1."""
    return F.round(clamp((F.lit(threshold) - value) / scale), 8)


def band(value: Column, low: float, high: float) -> Column:
    """1 in the middle of the band, 0 at its ends and beyond."""
    middle, half = (low + high) / 2, (high - low) / 2
    return F.round(clamp(F.lit(1.0) - F.abs(value - middle) / half), 8)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def edge_weight(family: Column, confidence: Column, support: Column, has_prior: Column, sources: Column, lifted: Column, head: Column, tail: Column) -> Column:
    """The weight of a propagation edge: a logit of its family's prior, confidence, support and agreement."""
    quality = clamp(F.log1p(support) / F.log1p(F.lit(8.0)))
    agreement = F.when(has_prior, F.lit(1.0)).when(sources > 1, F.lit(0.75)).otherwise(F.lit(0.55))
    projection = F.when(lifted, F.lit(1.0)).otherwise(F.lit(0.7))
    aligned = (F.coalesce(head, F.lit(0.5)) + F.coalesce(tail, F.lit(0.5))) / 2
    logit = of_family(family, PRIORS) + 1.20 * (confidence - 0.5) + 0.75 * (quality - 0.5) + 0.45 * (agreement - 0.5) + 0.30 * (projection - 0.5) + 0.45 * (aligned - 0.5)
    return F.round(clamp(sigmoid(logit)), 6)


def calibrated_confidence(score: Column, threshold: Column) -> Column:
    """1 from the threshold on, 0 below it; without a threshold the score itself, within the unit interval."""
    return F.when(threshold.isNull(), clamp(score)).when(score.isNotNull(), (score >= threshold).cast("double"))


def calibrated_label(score: Column, threshold: Column) -> Column:
    """anomalous from the threshold on, normal below it; null if either is."""
    return F.when(score >= threshold, "anomalous").when(score < threshold, "normal")
