"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the distance reward.
EARTH_RADIUS_KM = 6371.393
NEAR_KM = 1.0
FAR_REWARD = 0.76


def arc_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column, formula: str = "reference") -> Column:
    """Great-circle distance in km.

    ``reference`` gives the two coordinates each other's role, which is what the
    published weights rest on; ``haversine`` is the geographic distance.
    """
    if formula == "reference":
        along0, along1, across0, across1 = lon0, lon1, lat0, lat1
    elif formula == "haversine":
        along0, along1, across0, across1 = lat0, lat1, lon0, lon1
    else:
        raise ValueError(f"unknown distance formula: {formula}")
    half_along = F.sin(F.radians((along1 - along0) / 2))
    half_across = F.sin(F.radians((across1 - across0) / 2))
    chord = half_along * half_along + (
        F.cos(F.radians(along0)) * F.cos(F.radians(along1)) * half_across * half_across
    )
    # Not least(), which would turn a missing coordinate into 1.
    bounded = F.when(chord > 1, F.lit(1.0)).otherwise(chord)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(bounded))


def distance_reward(km: Column) -> Column:
    return F.when(km < NEAR_KM, F.lit(1.0)).otherwise(F.lit(FAR_REWARD) / F.tanh(km))


def time_period(hour: Column) -> Column:
    # The ranges of hours and their names.
    return (
        F.when(hour < 6, "0-5").when(hour < 12, "6-11").when(hour < 18, "12-17").otherwise("18-23")
    )


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def dot(vector: Column, weights: Sequence[float]) -> Column:
    """Inner product of an array column with fixed weights."""
    products = F.zip_with(vector, F.array(*[F.lit(float(w)) for w in weights]), lambda x, w: x * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def blend(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    """Element-wise ``weight_a * a + weight_b * b`` of two array columns."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * weight_a + y.cast("double") * weight_b)


def owner(trajectory: Column) -> Column:
    """The user part of a trajectory id: the text before the first underscore."""
    return F.split(trajectory, "_")[0]
