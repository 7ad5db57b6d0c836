"""Half-up settlement of decimal temperatures and the risk that it flips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settle(x: Column) -> Column:
    """Half-up integer: 14.5 gives 15, -2.5 gives -2."""
    return F.floor(x + 0.5).cast("long")


def boundary_distance(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(0.5 - F.abs(x - settle(x)), 6))


def flip_risk(x: Column) -> Column:
    """Struct of boundary_distance, nearest_boundary, direction and flip_risk."""
    part = x - F.floor(x)
    direction = (
        F.when(F.abs(part - 0.5) < 1e-9, "stable").when(F.abs(part) < 1e-9, "either").when(x < settle(x), "down").otherwise("up")
    )
    return F.struct(
        boundary_distance(x).alias("boundary_distance"),
        (F.floor(x) + 0.5).cast("double").alias("nearest_boundary"),
        F.when(x.isNotNull(), direction).alias("direction"),
        (0.5 - boundary_distance(x)).alias("flip_risk"),
    )


def day_flip_distance(x: Column) -> Column:
    """Distance to the rounding boundary as daily labels carry it, ten decimals."""
    return F.round(0.5 - F.abs(x - F.bround(x)), 10)
