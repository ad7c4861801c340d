"""Spectral features of single frames, batched through Arrow.

All need mono frames of at least ``n_fft`` samples whose rest is a multiple of
the hop; others give no row. Frames of equal length go through numpy together,
and rows leave as Arrow arrays; tables (windows, filters, kernels) are made
once for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..model import accepted
from .stateful import arrow_schema

#: Samples (frames, length) to columns whose first axes are (frames, rows of a frame).
Make = Callable[[], Callable[[np.ndarray], dict[str, np.ndarray] | None]]


def framed(x: np.ndarray, n: int, hop: int) -> np.ndarray | None:
    """(frames, parts, n) windows of the samples, or None where they don't fit."""
    if x.shape[1] < n or (x.shape[1] - n) % hop:
        return None
    return np.lib.stride_tricks.sliding_window_view(x, n, axis=1)[:, ::hop]


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values.ravel(), kind)
    width, rows = values.shape[-1], int(np.prod(values.shape[:-1]))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), kind.value_type))


def per_frame(frames: DataFrame, make: Make, schema: str) -> DataFrame:
    """source_id, seq, frame and the columns of ``schema`` for the parts of each frame; ``make`` builds the tables in the task."""
    whole = f"source_id string, seq long, frame int, {schema}"
    kinds = arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            samples = batch.column("samples")
            offsets, flat = samples.offsets.to_numpy(), samples.values.to_numpy(False)
            lengths = np.diff(offsets)
            for n in np.unique(lengths).tolist():
                mine = np.nonzero(lengths == n)[0]
                for at in range(0, len(mine), max(1, (1 << 20) // max(1, n))):
                    rows = mine[at : at + max(1, (1 << 20) // max(1, n))]
                    made = one(flat[offsets[rows][:, None] + np.arange(n)])
                    if made is None:
                        continue
                    parts = next(iter(made.values())).shape[1]
                    took = pa.array(np.repeat(rows, parts))
                    columns = [batch.column("source_id").take(took), batch.column("seq").take(took), pa.array(np.tile(np.arange(parts, dtype=np.int32), len(rows)))]
                    columns += [_column(made[f.name], f.type) for f in list(kinds)[3:]]
                    yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    rows = accepted(frames).filter("channels = 1").select("source_id", "seq", "samples")
    return rows.mapInArrow(run, whole)


def hann(n: int, kind: str = "hann") -> np.ndarray:
    if kind not in ("hann", "rectangular"):
        raise ValueError("window must be hann or rectangular")
    return np.hanning(n).astype(np.float32) if kind == "hann" else np.ones(n, np.float32)


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _check(n_fft: int, hop: int, rate: int) -> None:
    _need(n_fft > 1 and 0 < hop <= n_fft and rate > 0, "n_fft, hop or rate is out of range")


def spectra(x: np.ndarray, n_fft: int, hop: int, window: np.ndarray) -> np.ndarray | None:
    parts = framed(x, n_fft, hop)
    return None if parts is None else np.fft.rfft((parts * window).astype(np.float64), axis=-1)


def stft(frames: DataFrame, n_fft: int = 400, hop: int = 160, kind: str = "hann") -> DataFrame:
    _check(n_fft, hop, 1)

    def make():
        w = hann(n_fft, kind)

        def one(x):
            z = spectra(x, n_fft, hop, w)
            return None if z is None else {"re": z.real.astype(np.float32), "im": z.imag.astype(np.float32)}

        return one

    return per_frame(frames, make, "re array<float>, im array<float>")


def mel_filters(n_mels: int, n_fft: int, rate: int, low: float, high: float) -> np.ndarray:
    """Triangles even on the mel scale, each divided by half its width in Hz."""
    mel, hz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = hz(np.linspace(mel(low), mel(high), n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    shape = np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid)))
    return (shape * 2 / (right - left)).astype(np.float32)


def log_mel_of(x, n_fft, hop, w, filters, floor):
    z = spectra(x, n_fft, hop, w)
    return None if z is None else np.log(np.maximum((np.abs(z).astype(np.float32) ** 2).astype(np.float64) @ filters.T, floor)).astype(np.float32)


def log_mel(frames: DataFrame, n_fft: int = 400, hop: int = 160, n_mels: int = 80, low: float = 0.0, high: float = 8000.0, floor: float = 1e-10, rate: int = 16000) -> DataFrame:
    _check(n_fft, hop, rate)

    def make():
        w, filters = hann(n_fft), mel_filters(n_mels, n_fft, rate, low, high)

        def one(x):
            m = log_mel_of(x, n_fft, hop, w, filters, floor)
            return None if m is None else {"mel": m}

        return one

    return per_frame(frames, make, "mel array<float>")


def dct2(n_out: int, n: int) -> np.ndarray:
    k, i = np.arange(n_out)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def mfcc(frames: DataFrame, n_fft: int = 400, hop: int = 160, n_mels: int = 40, n_mfcc: int = 13, low: float = 0.0, high: float = 8000.0, floor: float = 1e-10, rate: int = 16000) -> DataFrame:
    _check(n_fft, hop, rate)

    def make():
        w, filters, d = hann(n_fft), mel_filters(n_mels, n_fft, rate, low, high), dct2(n_mfcc, n_mels)

        def one(x):
            m = log_mel_of(x, n_fft, hop, w, filters, floor)
            return None if m is None else {"mfcc": (m.astype(np.float64) @ d.T).astype(np.float32)}

        return one

    return per_frame(frames, make, "mfcc array<float>")


def smart_turn_mel(frames: DataFrame, n_fft: int = 400, hop: int = 160, n_mels: int = 80, rate: int = 16000) -> DataFrame:
    """The turn model's own mel: reflected ends, periodic Hann, every part that fits, log10, at most 8 below the top, (x + 4) / 4."""
    _check(n_fft, hop, rate)

    def make():
        w, filters = np.hanning(n_fft + 1)[:-1].astype(np.float32), mel_filters(n_mels, n_fft, rate, 0.0, rate / 2)

        def one(x):
            if x.shape[1] <= n_fft // 2:
                return None
            padded = np.pad(x, ((0, 0), (n_fft // 2,) * 2), mode="reflect")
            parts = np.lib.stride_tricks.sliding_window_view(padded, n_fft, axis=1)[:, ::hop]
            power = np.abs(np.fft.rfft((parts * w).astype(np.float64), axis=-1)) ** 2
            m = np.log10(np.maximum(power @ filters.T.astype(np.float64), 1e-10))
            m = (np.maximum(m, m.max(axis=(1, 2), keepdims=True) - 8.0) + 4.0) / 4.0
            return {"mel": m.astype(np.float32)}

        return one

    return per_frame(frames, make, "mel array<float>")


def cqt(frames: DataFrame, frame_length: int = 4096, hop: int = 512, bins: int = 48, per_octave: int = 12, f_min: float = 130.8128, rate: int = 16000) -> DataFrame:
    """Constant-Q transform: Hann kernels of unit norm in the middle of the frame; the conjugate kernel answers."""
    _check(frame_length, hop, rate)
    _need(bins > 0 and per_octave > 0 and f_min > 0 and f_min * 2 ** ((bins - 1) / per_octave) <= rate / 2, "bins exceed the Nyquist frequency")
    q = 1 / (2 ** (1 / per_octave) - 1)
    _need(int(np.ceil(q * rate / f_min)) <= frame_length, "f_min needs a longer frame")

    def make():
        kernels = np.zeros((bins, frame_length), complex)
        for k in range(bins):
            f = f_min * 2 ** (k / per_octave)
            n = int(np.ceil(q * rate / f))
            at = (frame_length - n) // 2
            part = np.hanning(n) * np.exp(2j * np.pi * f * np.arange(n) / rate)
            kernels[k, at : at + n] = part / np.linalg.norm(part)

        def one(x):
            parts = framed(x, frame_length, hop)
            if parts is None:
                return None
            z = parts @ kernels.T
            return {"re": z.real.astype(np.float32), "im": z.imag.astype(np.float32)}

        return one

    return per_frame(frames, make, "re array<float>, im array<float>")


def flux(x, n_fft, hop, w) -> np.ndarray | None:
    """Half-wave rectified spectral flux (frames, parts); the first part follows silence."""
    z = spectra(x, n_fft, hop, w)
    if z is None:
        return None
    m = np.abs(z).astype(np.float32)
    return np.maximum(np.diff(m, axis=1, prepend=np.zeros_like(m[:, :1])), 0).sum(axis=2, dtype=np.float64).astype(np.float32)


def onset(frames: DataFrame, n_fft: int = 400, hop: int = 160, threshold: float = 0.1, min_interval: float = 0.05, rate: int = 16000) -> DataFrame:
    """Parts whose flux reaches the threshold and no neighbour exceeds, more than the least interval after the last one."""
    _check(n_fft, hop, rate)
    _need(threshold > 0 and min_interval >= 0, "onset parameters are out of range")
    apart = int(np.ceil(min_interval * rate / hop))

    def make():
        w = hann(n_fft)

        def one(x):
            f = flux(x, n_fft, hop, w)
            if f is None:
                return None
            edge = np.full((len(f), 1), -np.inf, np.float32)
            peak = (f >= threshold) & (f >= np.concatenate([edge, f[:, :-1]], 1)) & (f >= np.concatenate([f[:, 1:], edge], 1))
            hit, last = np.zeros(f.shape, bool), np.full(len(f), -apart - 1)
            for k in range(f.shape[1]):
                hit[:, k] = peak[:, k] & (k - last > apart)
                last[hit[:, k]] = k
            return {"flux": f, "onset": hit}

        return one

    return per_frame(frames, make, "flux float, onset boolean")


def pitch(frames: DataFrame, n_fft: int = 400, hop: int = 160, f_min: float = 80.0, f_max: float = 800.0, threshold: float = 0.3, rate: int = 16000) -> DataFrame:
    """Lag of the greatest autocorrelation of the windowed part; its share of the energy, in [0, 1], is the confidence.

    The frequency is given whether or not the part counts as voiced; a silent part has none (0).
    """
    _check(n_fft, hop, rate)
    _need(0 < f_min < f_max <= rate / 2 and 0 <= threshold <= 1, "pitch parameters are out of range")
    low, high = int(np.floor(rate / f_max)), int(np.ceil(rate / f_min))
    _need(low >= 1 and high < n_fft, "f_min needs a longer frame")

    def make():
        w = hann(n_fft)

        def one(x):
            parts = framed(x, n_fft, hop)
            if parts is None:
                return None
            mean = parts.mean(axis=-1, keepdims=True, dtype=np.float64).astype(np.float32)
            p = ((parts - mean) * w).astype(np.float64)
            energy = np.einsum("...i,...i", p, p)
            r = np.stack([np.einsum("...i,...i", p[..., :-lag], p[..., lag:]) for lag in range(low, high + 1)], -1)
            best = r.argmax(axis=-1)
            silent = energy <= 1e-12
            share = np.take_along_axis(r, best[..., None], -1)[..., 0] / np.where(silent, 1, energy)
            share = np.where(silent, 0, np.clip(share, 0, 1))
            return {"f0": np.where(silent, 0, rate / (low + best)), "confidence": share, "voiced": share.astype(np.float32) >= threshold}

        return one

    return per_frame(frames, make, "f0 double, confidence double, voiced boolean")


def tempo(frames: DataFrame, n_fft: int = 400, hop: int = 160, bpm_min: float = 60.0, bpm_max: float = 180.0, threshold: float = 0.2, rate: int = 16000) -> DataFrame:
    """Beats per minute from the autocorrelation of the flux, over lags inside the asked range, and the parts that beats fall on.

    Beats begin at the strongest part of the first period and follow each other by the period found.
    """
    _check(n_fft, hop, rate)
    _need(0 < bpm_min < bpm_max and 0 <= threshold <= 1, "tempo parameters are out of range")
    shortest, longest = 60 * rate / (bpm_max * hop), 60 * rate / (bpm_min * hop)
    _need(shortest >= 1, "bpm_max is too high for the rate and hop")
    low, high = int(np.ceil(shortest)), int(np.floor(longest))

    def make():
        w = hann(n_fft)

        def one(x):
            f = flux(x, n_fft, hop, w)
            if f is None:
                return None
            n = f.shape[1]
            e = f.astype(np.float64)
            e -= e.mean(axis=1, keepdims=True)
            energy, top = np.einsum("ij,ij->i", e, e), min(high, n - 1)
            silent = energy <= 1e-12
            bpm, share, lag = np.zeros(len(f)), np.zeros(len(f)), np.zeros(len(f), np.int64)
            if top >= low:
                r = np.stack([np.einsum("ij,ij->i", e[:, :-k], e[:, k:]) for k in range(low, top + 1)], 1) / np.where(silent, 1, energy)[:, None]
                r = np.maximum(r, 0)
                lag = np.where(silent, 0, low + r.argmax(axis=1))
                share = np.where(silent, 0, np.minimum(r.max(axis=1), 1))
                bpm = np.where(silent, 0, 60 * rate / (np.maximum(lag, 1) * hop))
            found = share >= threshold
            beats = np.zeros((len(f), n), bool)
            for i in np.nonzero(found & (lag > 0))[0].tolist():
                beats[i, int(f[i, : lag[i]].argmax()) :: lag[i]] = True
            return {"bpm": np.where(found, bpm, 0)[:, None], "confidence": share[:, None], "detected": found[:, None], "beats": beats[:, None]}

        return one

    return per_frame(frames, make, "bpm double, confidence double, detected boolean, beats array<boolean>").drop("frame")
