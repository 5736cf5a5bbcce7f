"""Ranking features and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fusion weights, weights of the conceptual score, time constant in seconds, boosted tags.
FUSION = (0.6, 0.4)
CONCEPT = (0.7, 0.2, 0.1)
TAU = 604800.0
BOOST_TAGS = ("core", "critical", "schema")


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def log_length(text: Column) -> Column:
    return F.log(F.greatest(F.length(text), F.lit(1)).cast("double"))


def linear(features: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted sum; missing weights of a given list count 0, surplus ones are ignored, no list means ones."""
    w = [1.0] * len(features) if not weights else [*weights, *[0.0] * len(features)][: len(features)]
    total = F.lit(0.0)
    for x, f in zip(w, features, strict=True):
        total = total + F.lit(float(x)) * f
    return total


def fusion_weights(ltr: Column, concept: Column) -> tuple[Column, Column]:
    total = ltr + concept
    return F.when(total <= 0, 0.5).otherwise(ltr / total), F.when(total <= 0, 0.5).otherwise(concept / total)


def recency(timestamp: Column, now: Column | None = None, tau: float = TAU) -> Column:
    """0.5 without a time stamp (null or 0), 1 without a present time, else exp(-age / tau)."""
    known = F.lit(1.0) if now is None else F.exp(-F.greatest(F.lit(0.0), now - timestamp) / tau)
    return F.when(timestamp.isNull() | (timestamp == 0), 0.5).otherwise(known)


def tag_boost(tags: Column) -> Column:
    """Share of the boosting tags that a row has; 0 without tags."""
    tags = F.coalesce(tags, F.expr("CAST(array() AS array<string>)"))
    return F.size(F.array_intersect(tags, F.array(*map(F.lit, BOOST_TAGS)))) / 3.0


def conceptual(distance: Column, timestamp: Column, tags: Column, now: Column | None = None) -> Column:
    a, b, c = CONCEPT
    return a * similarity(distance) + b * recency(timestamp, now) + c * tag_boost(tags)


#: The names of the first version's features, in order.
FEATURES = ("similarity_primary", "log_length", "bias")


def named_features(near: Column, length: Column) -> Column:
    """The feature vector as a map from name to value."""
    return F.map_from_arrays(F.array(*map(F.lit, FEATURES)), F.array(near, length, F.lit(1.0)))
