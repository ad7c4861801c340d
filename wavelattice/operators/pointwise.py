"""Maps of one frame to one frame as Catalyst expressions.

Arithmetic is in double and stored as float. A result outside [-1, 1] rejects
the whole frame, except for the limiter, which saturates by design, and the
offset removal, which asks only for finite numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import accepted, valid

_S = "samples"


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _with(frames: DataFrame, samples: Column, channels: int | None = None, check: bool = True) -> DataFrame:
    out = frames.withColumn(_S, samples.cast("array<float>"))
    if channels is not None:
        out = out.withColumn("channels", F.lit(channels))
    return out.filter(valid()) if check else out


def _each(frames: DataFrame, f) -> DataFrame:
    return _with(accepted(frames), F.transform(_S, lambda x: f(x.cast("double"))))


def gain(frames, linear: float = 1.0):
    _require(math.isfinite(linear) and linear >= 0, "gain must be finite and >= 0")
    return _each(frames, lambda x: x * linear)


def compressor(frames, threshold: float = 0.5, ratio: float = 4.0, makeup: float = 1.0):
    _require(0 < threshold < 1 and ratio > 1 and 0 < makeup <= 4, "compressor parameters are out of range")
    return _each(frames, lambda x: F.when(F.abs(x) > threshold, F.signum(x) * (threshold + (F.abs(x) - threshold) / ratio)).otherwise(x) * makeup)


def expander(frames, threshold: float = 0.05, ratio: float = 2.0):
    _require(0 < threshold < 1 and ratio > 1, "expander parameters are out of range")
    return _each(frames, lambda x: F.when(F.abs(x) < threshold, F.signum(x) * threshold * F.pow(F.abs(x) / threshold, F.lit(ratio))).otherwise(x))


def limiter(frames, threshold: float = 1.0):
    _require(0 < threshold <= 1, "limiter threshold is out of range")
    t = F.lit(threshold).cast("float")
    return _with(accepted(frames, ranged=False), F.transform(_S, lambda x: F.least(F.greatest(x, -t), t)), check=False)


def noise_gate(frames, threshold: float = 0.02, closed_gain: float = 0.0):
    _require(0 <= threshold <= 1 and 0 <= closed_gain <= 1, "gate parameters are out of range")
    return _each(frames, lambda x: F.when(F.abs(x) < threshold, x * closed_gain).otherwise(x))


def normalize(frames, target_peak: float = 0.9, silence: float = 1e-4):
    _require(0 < target_peak <= 1 and 0 <= silence < target_peak, "normalize parameters are out of range")
    rows = accepted(frames).withColumn("__peak", F.array_max(F.transform(_S, lambda x: F.abs(x))).cast("double"))
    scaled = F.transform(_S, lambda x: F.when(F.col("__peak") < silence, x.cast("double")).otherwise(x.cast("double") * F.try_divide(F.lit(target_peak), F.col("__peak"))))
    return _with(rows, scaled).drop("__peak")


def window(frames, kind: str = "hann", expected_frames: int = 512):
    _require(kind in ("hann", "hamming") and expected_frames > 1, "window must be hann or hamming over more than one frame")
    rows = accepted(frames).filter(F.size(_S) == expected_frames * F.col("channels"))
    a, b = (0.5, 0.5) if kind == "hann" else (0.54, 0.46)
    step = 2 * math.pi / (expected_frames - 1)
    return _with(rows, F.transform(_S, lambda x, i: x.cast("double") * (a - b * F.cos(F.floor(i / F.col("channels")) * step))))


def trim(frames, leading: int = 16, trailing: int = 16):
    _require(leading >= 0 and trailing >= 0 and leading + trailing > 0, "nothing to trim")
    left = F.size(_S) - (leading + trailing) * F.col("channels")
    rows = accepted(frames).filter(left > 0)
    return rows.withColumn(_S, F.slice(_S, F.lit(leading) * F.col("channels") + 1, F.size(_S) - (leading + trailing) * F.col("channels")))


def dc_offset_removal(frames):
    """Each channel's mean over the frame is subtracted."""
    rows = accepted(frames, ranged=False)
    total = lambda c: F.aggregate(F.filter(_S, lambda x, i: i % F.col("channels") == c), F.lit(0.0), lambda a, x: a + x.cast("double"))
    means = F.transform(F.sequence(F.lit(0), F.col("channels") - 1), lambda c: total(c) / (F.size(_S) / F.col("channels")))
    rows = rows.withColumn("__means", means)
    # ``__means`` is named twice: what is named once could be computed anew for every sample
    corrected = F.transform(_S, lambda x, i: x.cast("double") - F.element_at("__means", (i % F.col("channels") + 1).cast("int")))
    return _with(rows.filter(F.size("__means") > 0), corrected, check=False).drop("__means").filter(valid(ranged=False))


def declick(frames, delta: float = 0.25, max_samples: int = 1):
    """Runs of up to ``max_samples`` that leap from both neighbours become their mean; the scan reads the input."""
    _require(0 < delta <= 2 and max_samples > 0, "declick parameters are out of range")
    s = F.col(_S)
    at = lambda i: F.get(s, i).cast("double")

    def run_end(i: Column, c: Column) -> Column:
        """Length of the click that begins at sample ``i`` (0: none): the shortest that fits."""
        out = F.lit(0)
        for n in range(max_samples, 0, -1):
            before, after = at(i - c), at(i + n * c)
            leaps = F.lit(True)
            for k in range(n):
                x = at(i + k * c)
                leaps = leaps & (F.abs(x - before) > delta) & (F.abs(x - after) > delta)
            out = F.when((i >= c) & (i + n * c < F.size(s)) & leaps, n).otherwise(out)
        return out

    c = F.col("channels")

    def step(acc: Column, i: Column) -> Column:
        # next[ch]: first sample frame of the channel that may begin a click; left/mean of the click in progress
        ch = (i % c).cast("int")
        held = F.element_at(acc["held"], ch + 1)
        n = F.when(held["left"] > 0, F.lit(0)).otherwise(run_end(i, c))
        mean = F.when(n > 0, (at(i - c) + at(i + n * c)) / 2).otherwise(held["mean"])
        left = F.when(n > 0, n).otherwise(held["left"])
        y = F.when(left > 0, mean).otherwise(at(i))
        new = F.struct((F.greatest(left - 1, F.lit(0))).cast("int").alias("left"), mean.alias("mean"))
        return F.struct(
            F.transform(acc["held"], lambda h, k: F.when(k == ch, new).otherwise(h)).alias("held"),
            F.concat(acc["out"], F.array(y)).alias("out"),
        )

    first = F.struct(
        F.transform(F.sequence(F.lit(1), c), lambda _: F.struct(F.lit(0).alias("left"), F.lit(0.0).alias("mean"))).alias("held"),
        F.array().cast("array<double>").alias("out"),
    )
    return _with(accepted(frames), F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), first, step)["out"])


def pan(frames, position: float = 0.0):
    _require(-1 <= position <= 1, "pan position is out of range")
    angle = (position + 1) * math.pi / 4
    return _with(accepted(frames).filter("channels = 2"), F.transform(_S, lambda x, i: x.cast("double") * F.when(i % 2 == 0, math.cos(angle)).otherwise(math.sin(angle))))


def stereo_widening(frames, width: float = 1.0):
    _require(0 <= width <= 4, "width is out of range")
    pair = lambda i: (F.get(_S, i - i % 2).cast("double"), F.get(_S, i - i % 2 + 1).cast("double"))

    def one(x, i):
        left, right = pair(i)
        mid, side = (left + right) / 2, (left - right) / 2 * width
        return F.when(i % 2 == 0, mid + side).otherwise(mid - side)

    return _with(accepted(frames).filter("channels = 2"), F.transform(_S, one))


def _sample_frames():
    return F.sequence(F.lit(0), (F.size(_S) / F.col("channels")).cast("int") - 1)


def _channel_mean(i: Column, which) -> Column:
    part = F.filter(F.slice(_S, (i * F.col("channels") + 1).cast("int"), F.col("channels")), which)
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(part)


def downmix(frames, mode: str = "pair_average_to_stereo"):
    _require(mode in ("average_to_mono", "pair_average_to_stereo"), "unknown downmix mode")
    rows = accepted(frames)
    if mode == "average_to_mono":
        return _with(rows, F.transform(_sample_frames(), lambda i: _channel_mean(i, lambda x: F.lit(True))), 1)
    both = F.flatten(F.transform(_sample_frames(), lambda i: F.array(_channel_mean(i, lambda x, k: k % 2 == 0), _channel_mean(i, lambda x, k: k % 2 == 1))))
    return _with(rows.filter("channels >= 2 AND channels % 2 = 0"), both, 2)


def upmix(frames, mode: str = "mono_duplicate", channels: int = 2):
    _require(mode in ("mono_duplicate", "stereo_pair_duplicate") and channels > 0, "unknown upmix mode")
    if mode == "mono_duplicate":
        return _with(accepted(frames).filter("channels = 1"), F.flatten(F.transform(_S, lambda x: F.array_repeat(x, channels))), channels)
    _require(channels % 2 == 0, "pairs need an even number of channels")
    pairs = F.transform(_sample_frames(), lambda i: F.flatten(F.array_repeat(F.slice(_S, 2 * i + 1, 2), channels // 2)))
    return _with(accepted(frames).filter("channels = 2"), F.flatten(pairs), channels)


def beamforming(frames, weights: list[float]):
    _require(len(weights) > 0 and all(map(math.isfinite, weights)) and sum(map(abs, weights)) > 0, "weights must be finite and not all zero")
    n = len(weights)
    mixed = lambda i: sum((F.get(_S, i * n + k).cast("double") * w for k, w in enumerate(weights)), F.lit(0.0))
    return _with(accepted(frames).filter(F.col("channels") == n), F.transform(_sample_frames(), mixed), 1)


def to_pcm16(frames):
    """``pcm``: negative samples times 32768, others times 32767, half away from zero."""
    return accepted(frames).withColumn("pcm", F.transform(_S, lambda x: F.round(x.cast("double") * F.when(x < 0, 32768.0).otherwise(32767.0)).cast("int")))


def from_pcm(frames, bits: int = 16):
    """``samples`` of the integers in ``pcm``."""
    _require(bits in (16, 32), "PCM is of 16 or 32 bits")
    return _with(frames, F.transform("pcm", lambda x: x.cast("double") / float(1 << (bits - 1))))


def bit_depth(frames):
    """PCM of 16 bits to 32 bits."""
    return frames.withColumn("pcm", F.transform("pcm", lambda x: F.shiftleft(x.cast("int"), 16)))


def channel_convert(frames, mode: str = "mono_to_stereo_duplicate"):
    _require(mode in ("mono_to_stereo_duplicate", "stereo_to_mono_average"), "unknown conversion")
    return upmix(frames) if mode.startswith("mono") else downmix(frames.filter("channels = 2"), "average_to_mono")


def interleave(frames, to: str = "planar"):
    _require(to in ("planar", "interleaved"), "layout must be planar or interleaved")
    c, n = F.col("channels"), (F.size(_S) / F.col("channels")).cast("int")
    source = (lambda i: (i % n) * c + F.floor(i / n)) if to == "planar" else (lambda i: (i % c) * n + F.floor(i / c))
    return _with(accepted(frames), F.transform(_S, lambda x, i: F.get(_S, source(i).cast("int"))))


def latency_compensation(frames, offset_ms: float = 0.0):
    moved = frames.withColumn("stamp_ns", F.try_add("stamp_ns", F.lit(int(round(offset_ms * 1e6)))))
    return moved.filter("stamp_ns >= 0")


def time_alignment(frames, period_ms: float = 20.0, phase_ms: float = 0.0, max_adjust_ms: float = 2.0):
    _require(period_ms > 0 and 0 <= phase_ms < period_ms and max_adjust_ms >= 0, "alignment parameters are out of range")
    period, phase, most = (int(round(x * 1e6)) for x in (period_ms, phase_ms, max_adjust_ms))
    half = F.expr(f"(stamp_ns - {phase} + {period // 2} * CASE WHEN stamp_ns < {phase} THEN -1 ELSE 1 END) div {period}")
    snapped = F.lit(phase) + half * period
    return frames.withColumn("__to", snapped).filter(F.abs(F.col("__to") - F.col("stamp_ns")) <= most).withColumn("stamp_ns", F.col("__to")).drop("__to")


def passthrough(frames, stream_id: str | None = None):
    """Identity with the contract check (also what the neural echo canceller's and denoiser's pass-through do)."""
    out = accepted(frames)
    return out if stream_id is None else out.withColumn("stream_id", F.lit(stream_id))


loopback = passthrough


def bus_router(frames, outputs: list[str]):
    _require(len(outputs) == len(set(outputs)) > 0, "outputs must be distinct")
    return accepted(frames, ranged=False).withColumn("stream_id", F.explode(F.array(*map(F.lit, outputs))))


def patchbay(frames, routes: list[tuple[str, str]]):
    """``routes``: (stream_id in, stream_id out), N to M; a table of literal size, so it is broadcast."""
    table = frames.sparkSession.createDataFrame(routes, "stream_id string, __out string")
    return accepted(frames, ranged=False).join(F.broadcast(table), "stream_id").withColumn("stream_id", F.col("__out")).drop("__out")


def rms(samples: Column | str = _S) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(samples))


def sidechain(frames, threshold_rms: float = 0.05, active_gain_db: float = -12.0, inactive_gain_db: float = 0.0):
    """A control frame of one sample: the gain that the frame's level selects."""
    _require(0 < threshold_rms <= 1, "threshold is out of range")
    db = lambda x: 10 ** (x / 20)
    return _with(accepted(frames), F.array(F.when(rms() >= threshold_rms, db(active_gain_db)).otherwise(db(inactive_gain_db))), check=False)


def loudness(frames, db_floor: float = -120.0):
    """rms, peak, their decibels (not below the floor) and the crest factor."""
    _require(-300 <= db_floor < 0, "floor is out of range")
    rows = accepted(frames).withColumns({"rms": rms(), "peak": F.array_max(F.transform(_S, lambda x: F.abs(x))).cast("double")})
    db = lambda c: F.when(F.col(c) > 0, F.greatest(20 * F.log10(c), F.lit(db_floor))).otherwise(db_floor)
    return rows.withColumns({"rms_dbfs": db("rms"), "peak_dbfs": db("peak"), "crest": F.coalesce(F.try_divide("peak", "rms"), F.lit(0.0))})
