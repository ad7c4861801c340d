"""Filters with state over the frames of a stream.

A kernel advances many streams side by side: samples come as an array (sample
frames, lanes), a lane being one channel of one stream, and states are arrays
whose last axis is the lane. :func:`run_filters` deals streams to tasks, takes
the frames of a task's streams in common order, and puts frames of equal shape
from different streams into one kernel call. :meth:`Filter.step` is the same
for a single frame; streaming and tests use it.

A rejected frame changes nothing. A stream is one ordered task; scale is
across streams, and what a task holds is the states of its streams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FRAME

#: Of a state: a tuple of arrays, the last axis of each is the lane.
State = tuple[np.ndarray, ...]
#: (state, x, sample rate) to (state, y, lanes whose inner state stayed in range).
Kernel = Callable[[State, np.ndarray, int], tuple[State, np.ndarray, np.ndarray | bool]]


@dataclass(frozen=True)
class Filter:
    """``start(rate, lanes)`` makes a state.

    ``epoch``: "next" drops a seq not above the last and starts anew after a
    gap; "generation" drops older generations and starts anew when they rise;
    "none" keeps the state. ``ranged``: input and output must be in [-1, 1],
    else finite alone.
    """

    start: Callable[[int, int], State]
    kernel: Kernel
    epoch: str = "next"
    ranged: bool = True

    def admits(self, x: np.ndarray, channels: int) -> bool:
        return bool(len(x) and len(x) % channels == 0 and np.isfinite(x).all() and (not self.ranged or (np.abs(x) <= 1).all()))

    def mark(self, row: dict) -> int:
        return row["seq"] if self.epoch == "next" else row.get("generation", 0)

    def state_for(self, held, row: dict):
        """The state a frame meets, or None where it comes too late."""
        rate, channels, mark = int(row["sample_rate"]), int(row["channels"]), self.mark(row)
        if held is None:
            return self.start(rate, channels)
        state, last, form = held
        if self.epoch == "next" and mark <= last or self.epoch == "generation" and mark < last:
            return None
        anew = self.epoch == "next" and mark != last + 1 or self.epoch == "generation" and mark > last or form != (rate, channels)
        return self.start(rate, channels) if anew else state

    def advance(self, state: State, x: np.ndarray, rate: int) -> tuple[State, np.ndarray, np.ndarray]:
        """(state, float32 samples, lanes that are sound)."""
        state, y, sound = self.kernel(state, x, rate)
        with np.errstate(over="ignore"):
            y = y.astype(np.float32)
        good = np.isfinite(y).all(axis=0) & sound
        return state, y, good & (np.abs(y) <= 1).all(axis=0) if self.ranged else good

    def step(self, held, row: dict):
        x = np.asarray(row["samples"], np.float64)
        channels = int(row["channels"])
        if not self.admits(x, channels) or (state := self.state_for(held, row)) is None:
            return held, []
        state, y, good = self.advance(state, x.reshape(-1, channels), int(row["sample_rate"]))
        if not good.all():
            return held, []
        return (state, self.mark(row), (int(row["sample_rate"]), channels)), [{**row, "samples": y.ravel()}]

    __call__ = step


_GROUPS = 32


def run_filters(frames: DataFrame, made: Filter, order: str = "seq") -> DataFrame:
    """``frames`` (columns of ``FRAME``) after a filter. Streams are (source_id, stream_id)."""
    names = [c.split()[0] for c in FRAME.split(", ")]

    def waves(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Rows of equal order and shape, no stream twice."""
        keys = [batch.column(c).to_numpy(False) for c in ("__group", order, "sample_rate", "channels")]
        samples = batch.column("samples")
        keys.append(np.diff(samples.offsets.to_numpy()))
        streams = list(zip(batch.column("source_id").to_pylist(), batch.column("stream_id").to_pylist()))
        cut = np.zeros(batch.num_rows, bool)
        for k in keys:
            cut[1:] |= k[1:] != k[:-1]
        first, met = 0, set()
        for i, stream in enumerate(streams):
            if i and (cut[i] or stream in met):
                yield np.arange(first, i)
                first, met = i, set()
            met.add(stream)
        if streams:
            yield np.arange(first, batch.num_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, states = None, {}
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("__group", "source_id", "stream_id", "seq", "generation", "sample_rate", "channels")}
            samples = batch.column("samples")
            offsets, flat = samples.offsets.to_numpy(), samples.values.to_numpy(False)
            kept, outputs = [], []
            for rows in waves(batch):
                if columns["__group"][rows[0]] != group:
                    group, states = columns["__group"][rows[0]], {}
                rate, channels = columns["sample_rate"][rows[0]], columns["channels"][rows[0]]
                live, met = [], []
                for i in rows.tolist():
                    key = (columns["source_id"][i], columns["stream_id"][i])
                    row = {c: columns[c][i] for c in ("seq", "generation", "sample_rate", "channels")}
                    if not samples[i].is_valid or not made.admits(flat[offsets[i] : offsets[i + 1]], channels):
                        continue
                    state = made.state_for(states.get(key), row)
                    if state is not None:
                        live.append((i, key, made.mark(row)))
                        met.append(state)
                if not live:
                    continue
                x = np.concatenate([flat[offsets[i] : offsets[i + 1]].reshape(-1, channels) for i, _, _ in live], axis=1).astype(np.float64)
                joint = tuple(np.concatenate(parts, axis=-1) for parts in zip(*met))
                joint, y, good = made.advance(joint, x, rate)
                for k, (i, key, mark) in enumerate(live):
                    own = slice(k * channels, (k + 1) * channels)
                    if good[own].all():
                        states[key] = (tuple(part[..., own].copy() for part in joint), mark, (rate, channels))
                        kept.append(i)
                        outputs.append(np.ascontiguousarray(y[:, own]).ravel())
            if kept:
                took = pa.array(kept, pa.int64())
                ends = np.concatenate([[0], np.cumsum([len(o) for o in outputs])]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(outputs)))
                yield pa.RecordBatch.from_arrays([values if c == "samples" else batch.column(c).take(took) for c in names], names)

    stream = ["source_id", "stream_id"]
    rows = frames.select(*names, F.pmod(F.xxhash64(*stream), F.lit(_GROUPS)).cast("int").alias("__group"))
    rows = rows.repartition(*stream).sortWithinPartitions("__group", order, "sample_rate", "channels", F.size("samples"), *stream)
    return rows.mapInArrow(run, FRAME)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _rc(cutoff: float, rate: int) -> tuple[float, float]:
    _need(0 < cutoff < rate / 2, "a cutoff must be between 0 and half the sample rate")
    rc, dt = 1 / (2 * math.pi * cutoff), 1 / rate
    return dt / (rc + dt), rc / (rc + dt)


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _single(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32).astype(np.float64)


def _low(last: np.ndarray, x: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray]:
    """First-order low pass; the output, kept as float32, is the state; a lane begins (NaN) at its first sample."""
    y = np.empty(x.shape)
    for i in range(len(x)):
        out = last + a * (x[i] - last)
        last = _single(np.where(np.isnan(last), x[i], out) if not i else out)
        y[i] = last
    return last, y


def _high(before: np.ndarray, last: np.ndarray, x: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First-order high pass; a lane begins (NaN) at 0."""
    y = np.empty(x.shape)
    for i in range(len(x)):
        out = a * (last + x[i] - before)
        last = _single(np.where(np.isnan(before), 0.0, out) if not i else out)
        before = x[i]
        y[i] = last
    return before, last, y


def _none(lanes: int) -> np.ndarray:
    return np.full(lanes, np.nan)


def low_pass(cutoff: float = 3400.0) -> Filter:
    def kernel(state, x, rate):
        last, y = _low(state[0], x, _rc(cutoff, rate)[0])
        return (last,), y, True

    return Filter(lambda rate, n: (_none(n),), kernel)


def high_pass(cutoff: float = 80.0) -> Filter:
    def kernel(state, x, rate):
        before, last, y = _high(*state, x, _rc(cutoff, rate)[1])
        return (before, last), y, True

    return Filter(lambda rate, n: (_none(n), np.zeros(n)), kernel, "generation", ranged=False)


def band_pass(low_cut: float = 80.0, high_cut: float = 3400.0) -> Filter:
    _need(0 < low_cut < high_cut, "the low cut must be below the high cut")

    def kernel(state, x, rate):
        before, last, y = _high(*state[:2], x, _rc(low_cut, rate)[1])
        low, y = _low(state[2], y, _rc(high_cut, rate)[0])
        return (before, last, low), y, True

    return Filter(lambda rate, n: (_none(n), np.zeros(n), _none(n)), kernel)


def _notch(state: State, x: np.ndarray, f0: float, q: float, rate: int) -> tuple[State, np.ndarray]:
    """Two zeros on the unit circle, two poles near them; doubles all through. The zeros' part is one array sum."""
    w = 2 * math.pi * f0 / rate
    alpha = math.sin(w) / (2 * q)
    b0, b1, a2 = 1 / (1 + alpha), -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)
    x1, x2, y1, y2 = state
    before = np.concatenate([x2[None], x1[None], x])
    fed = b0 * x + b1 * before[1:-1] + b0 * before[:-2]
    y = np.empty(x.shape)
    for i in range(len(x)):
        y1, y2 = fed[i] - b1 * y1 - a2 * y2, y1
        y[i] = y1
    return (before[-1], before[-2], y1, y2), y


def notch(center: float = 60.0, q: float = 30.0) -> Filter:
    _need(center > 0 and q > 0, "center and q must be above 0")

    def kernel(state, x, rate):
        state, y = _notch(state, x, center, q, rate)
        return state, y, True

    return Filter(lambda rate, n: (np.zeros(n),) * 4, kernel, ranged=False)


def hum(frequency: float = 60.0, harmonics: int = 4, q: float = 30.0) -> Filter:
    """A cascade of notches at the multiples below the Nyquist frequency."""
    _need(frequency > 0 and harmonics > 0 and q > 0, "frequency, harmonics and q must be above 0")

    def kernel(state, x, rate):
        new = []
        for k in range(len(state) // 4):
            part, x = _notch(state[4 * k : 4 * k + 4], x, (k + 1) * frequency, q, rate)
            new += part
        return tuple(new), x, True

    return Filter(lambda rate, n: (np.zeros(n),) * (4 * sum(k * frequency < rate / 2 for k in range(1, harmonics + 1))), kernel, "generation")


def eq(low_cutoff: float = 250.0, high_cutoff: float = 4000.0, low_db: float = 0.0, mid_db: float = 0.0, high_db: float = 0.0) -> Filter:
    _need(0 < low_cutoff < high_cutoff, "the low cutoff must be below the high cutoff")
    low_gain, mid_gain, high_gain = (10 ** (d / 20) for d in (low_db, mid_db, high_db))

    def kernel(state, x, rate):
        last, low = _low(state[0], x, _rc(low_cutoff, rate)[0])
        before, out, high = _high(*state[1:], x, _rc(high_cutoff, rate)[1])
        return (last, before, out), low_gain * low + mid_gain * (x - low - high) + high_gain * high, True

    return Filter(lambda rate, n: (_none(n), _none(n), np.zeros(n)), kernel)


def deesser(cutoff: float = 4500.0, threshold: float = 0.08, attenuation_db: float = -9.0) -> Filter:
    _need(cutoff > 0 and 0 < threshold <= 1 and attenuation_db <= 0, "deesser parameters are out of range")
    g = 10 ** (attenuation_db / 20)

    def kernel(state, x, rate):
        a, low = 1 - math.exp(-2 * math.pi * cutoff / rate), state[0]
        lows = np.empty(x.shape)
        for i in range(len(x)):
            low = low + a * (x[i] - low)
            lows[i] = low
        high = x - lows
        return (low,), lows + np.where(np.abs(high) >= threshold, high * g, high), True

    return Filter(lambda rate, n: (np.zeros(n),), kernel, "none")


def echo(delay_ms: float = 250.0, feedback: float = 0.35, wet: float = 0.4, dry: float = 0.8) -> Filter:
    """A line of float32 samples, its oldest first; a block is as long as the line at most, so it reads only what was there."""
    _need(abs(feedback) < 1 and delay_ms > 0, "feedback must be below 1, the delay above 0")

    def kernel(state, x, rate):
        line, y, sound = state[0], np.empty(x.shape), True
        for at in range(0, len(x), len(line)):
            part = x[at : at + len(line)]
            late = line[: len(part)].astype(np.float64)
            y[at : at + len(part)] = dry * part + wet * late
            new = (part + feedback * late).astype(np.float32)
            sound = sound & (np.abs(new) <= 1).all(axis=0)
            line = np.concatenate([line[len(part) :], new])
        return (line,), y, sound

    return Filter(lambda rate, n: (np.zeros((max(1, _half_up(delay_ms * rate / 1000)), n), np.float32),), kernel, "none")


#: Delays of the reverberator's four lines in milliseconds (fixed values).
REVERB_MS = (29.7, 37.1, 41.1, 43.7)


def reverb(room: float = 0.72, damping: float = 0.35, wet: float = 0.32, dry: float = 0.68) -> Filter:
    """Four lines side by side, each fed back through a low pass. Lines and filter states are float32 and stay in [-1, 1]."""
    _need(0 <= room <= 1 and 0 <= damping < 1 and wet >= 0 and dry >= 0, "reverb parameters are out of range")
    feedback = 0.20 + 0.65 * room

    def kernel(state, x, rate):
        lines, damp, y, sound = list(state[:-1]), state[-1], np.empty(x.shape), True
        block = min(map(len, lines))
        for at in range(0, len(x), block):
            part = x[at : at + block]
            m = len(part)
            late = np.stack([line[:m] for line in lines]).astype(np.float64)
            fed = np.empty(late.shape)
            for i in range(m):
                fed[:, i] = (1 - damping) * late[:, i] + damping * damp
                damp = _single(fed[:, i])
            new = ((1 - feedback) * part + feedback * fed).astype(np.float32)
            sound = sound & (np.abs(new) <= 1).all(axis=(0, 1)) & (np.abs(fed.astype(np.float32)) <= 1).all(axis=(0, 1))
            lines = [np.concatenate([line[m:], new[k]]) for k, line in enumerate(lines)]
            y[at : at + m] = dry * part + wet * late.sum(axis=0) / len(lines)
        return (*lines, damp), y, sound

    return Filter(lambda rate, n: (*(np.zeros((max(1, _half_up(ms * rate / 1000)), n), np.float32) for ms in REVERB_MS), np.zeros((len(REVERB_MS), n))), kernel, "none")


def delay(samples: int) -> Filter:
    """A line of ``samples`` zero sample frames before the stream."""
    _need(samples > 0, "the delay must be above 0")

    def kernel(state, x, rate):
        whole = np.concatenate([state[0], x])
        return (whole[len(x) :],), whole[: len(x)], True

    return Filter(lambda rate, n: (np.zeros((samples, n)),), kernel, "none")
