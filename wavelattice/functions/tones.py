"""A deterministic acknowledgement tone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ease(p: Column) -> Column:
    """The smoothstep polynomial on [0, 1]."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return p * p * (3.0 - 2.0 * p)


def wake_tone(
    spark: SparkSession, rate: int = 48000, ms: int = 260, fade_ms: int = 34, gain: float = 0.18, base_hz: float = 660.0, lift_hz: float = 260.0, shimmer_hz: float = 1320.0
) -> DataFrame:
    """(i, v, pcm): a rising tone and a fainter partial above it; ``pcm`` is truncated.

    A phase is the sum of all frequencies up to its sample. Those rise by the
    smoothstep polynomial, so sums of squares and cubes give it for each
    sample by itself.
    """
    if rate <= 0 or ms <= 0 or not 0 <= 2 * fade_ms < ms or not 0 < gain <= 1 or base_hz <= 0 or lift_hz < 0 or shimmer_hz <= 0:
        raise ValueError("a tone's parameters are out of range")
    span, fade = ms / 1000, fade_ms / 1000
    n, whole = int(rate * span), rate * span
    i = F.col("id").cast("double")
    risen = 3 * (i * (i + 1) * (2 * i + 1) / 6) / whole**2 - 2 * (i * (i + 1) / 2) ** 2 / whole**3
    phase = lambda hz, lift: 2 * math.pi / rate * (hz * (i + 1) + lift * risen)
    edge = _ease(F.least(i / rate, span - i / rate) / fade) if fade else F.lit(1.0)
    tone = F.sin(phase(base_hz, lift_hz)) * 0.78 + F.sin(phase(shimmer_hz, lift_hz * 0.35)) * 0.22
    v = tone * edge * (1.0 - 0.28 * _ease(i / whole)) * gain
    v = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    return spark.range(n).select(F.col("id").alias("i"), v.alias("v")).withColumn("pcm", (F.col("v") * 32767).cast("int"))
