"""Band-limited resampling by a windowed sinc, in exact integer phase.

What the linear resampler of :mod:`timeline` does cheaply is done here with a
kernel of ``2 * half`` input samples (more where the rate falls) under a
seven-term cosine window. Outputs leave once all samples that they need have
come: the delay is ``half`` input samples, and what the last frame still
waits for at a stream's end stays inside.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from ..model import FRAME, accepted
from .stateful import Step, ordered_fold

#: Coefficients of the seven-term Blackman-Harris window (fixed values).
WINDOW = (0.27105140069342, 0.43329793923448, 0.21812299954311, 0.06592544638803, 0.01081174209837, 0.00077658482522, 0.00001388721735)


def width(rate: int, target: int, half: int) -> int:
    """Input samples on either side of an output."""
    return math.ceil(half * max(1.0, rate / target))


@lru_cache(maxsize=16)
def kernel(rate: int, target: int, half: int) -> np.ndarray:
    """Weights of the input samples around an output, a row for each phase; every row adds up to one."""
    step = math.gcd(rate, target)
    phases, reach, cut = target // step, width(rate, target, half), min(1.0, target / rate)
    t = np.arange(phases)[:, None] / phases - np.arange(-reach + 1, reach + 1)[None, :]
    shape = sum(c * np.cos(np.pi * k * t / reach) for k, c in enumerate(WINDOW))
    rows = np.sinc(cut * t) * np.where(np.abs(t) < reach, shape, 0.0)
    return rows / rows.sum(axis=1, keepdims=True)


def sinc_step(target: int, half: int = 32) -> Step:
    if target <= 0 or half <= 0:
        raise ValueError("the target rate and the kernel must be above 0")

    def step(state, row):
        rate, channels = int(row["sample_rate"]), int(row["channels"])
        x = np.asarray(row["samples"], np.float64).reshape(-1, channels)
        held, came, given, form = state or (None, 0, 0, None)
        reach = width(rate, target, half)
        if form != (rate, channels):  # a stream begins in silence; another format begins a stream
            held, came, given, form = np.zeros((reach - 1, channels)), 0, 0, (rate, channels)
        held, before = np.concatenate([held, x]), came - len(held)  # ``held`` begins with sample number ``before``
        came += len(x)
        last = max(given, ((came - reach) * target - 1) // rate + 1) if came > reach else given  # outputs k with k * rate div target + reach < came
        k = np.arange(given, last)
        at, phase = k * rate // target, (k * rate % target) // math.gcd(rate, target)
        y = np.empty((len(k), channels))
        weights = kernel(rate, target, half)
        for part in range(0, len(k), 4096):
            some = slice(part, part + 4096)
            index = at[some, None] - reach + 1 - before + np.arange(2 * reach)[None, :]
            y[some] = np.einsum("kt,ktc->kc", weights[phase[some]], held[index])
        keep = max(0, last * rate // target - reach + 1 - before)
        out = y.astype(np.float32).ravel()
        state = (held[keep:], came, last, form)
        if not len(out) or not (np.abs(out) <= 1).all():
            return state, []
        return state, [{**row, "sample_rate": target, "samples": out}]

    return step


def resample_sinc(frames: DataFrame, target_rate: int = 16000, half: int = 32) -> DataFrame:
    """Frames at the target rate. A frame whose output leaves [-1, 1] (a loud edge may overshoot) gives no row, as do those that only wait."""
    names = [c.split()[0] for c in FRAME.split(", ")]
    return ordered_fold(accepted(frames).select(*names), sinc_step(target_rate, half), FRAME, key=("source_id", "stream_id"))
