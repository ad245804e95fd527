"""Display stretches as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stretch(value: Column, low: float, high: float, gamma: float = 1.0) -> Column:
    """Clip to [low, high], scale to [0, 1] and raise to ``gamma``."""
    return F.pow(F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)), gamma)


def saturate(red: Column, green: Column, blue: Column, boost: float) -> tuple[Column, Column, Column]:
    """Move each channel away from the luminance by ``boost``, clipped to [0, 1]."""
    grey = 0.299 * red + 0.587 * green + 0.114 * blue
    return tuple(F.least(F.greatest(grey + (c - grey) * boost, F.lit(0.0)), F.lit(1.0)) for c in (red, green, blue))
