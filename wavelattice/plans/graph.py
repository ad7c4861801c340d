"""A declared graph of operators, checked along its edges, as lazy DataFrames.

The registry knows every operator that takes frames: maps of one frame,
windows over a stream, filters with state, machines and mixes of several
inputs. An entry says how many inputs there are, the channels it needs and
those it leaves, and whether frames come out, so that a wrong graph is an
error before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import asof, features, filters, pointwise, resample, stateful, timeline


@dataclass(frozen=True)
class Op:
    """``run(inputs..., **params)``; ``inputs`` 0 means one or more, given as a list. ``frames``: whether whole frames come out."""

    run: Callable[..., DataFrame]
    inputs: int = 1
    needs: int | None = None
    leaves: int | None = None
    frames: bool = True


def _filter(make: Callable[..., filters.Filter]) -> Op:
    return Op(lambda frames, **params: filters.run_filters(frames, make(**params)))


def _machine(make: Callable[..., stateful.Step], schema: str, order: tuple[str, ...] = ("seq",)) -> Op:
    return Op(lambda rows, **params: stateful.ordered_fold(rows, make(**params), schema, order=order), frames=False)


def _ducked(program: DataFrame, side: DataFrame, max_age_ms: int = 100, **params) -> DataFrame:
    return stateful.ordered_fold(asof.sidechain_level(program, side, max_age_ms), stateful.ducking(**params), stateful.OUT)


_MAPS = ("gain", "compressor", "expander", "limiter", "noise_gate", "normalize", "window", "trim", "dc_offset_removal", "declick", "interleave", "passthrough", "loopback", "time_alignment", "latency_compensation", "bus_router", "patchbay")
_FILTERS = ("low_pass", "high_pass", "band_pass", "notch", "hum", "eq", "deesser", "echo", "reverb", "delay")
_WINDOWS = ("frame_buffer", "chunk_overlap", "overlap_add", "fade", "resample_linear")
_FEATURES = ("stft", "log_mel", "mfcc", "smart_turn_mel", "cqt", "onset", "pitch", "tempo")

REGISTRY: dict[str, Op] = {
    **{name: Op(getattr(pointwise, name)) for name in _MAPS},
    **{name: _filter(getattr(filters, name)) for name in _FILTERS},
    **{name: Op(getattr(timeline, name)) for name in _WINDOWS},
    **{name: Op(getattr(features, name), needs=1, frames=False) for name in _FEATURES},
    "resample_sinc": Op(resample.resample_sinc),
    "pan": Op(pointwise.pan, needs=2, leaves=2),
    "stereo_widening": Op(pointwise.stereo_widening, needs=2, leaves=2),
    "downmix": Op(pointwise.downmix),
    "upmix": Op(pointwise.upmix),
    "channel_convert": Op(pointwise.channel_convert),
    "beamforming": Op(pointwise.beamforming, leaves=1),
    "sidechain": Op(pointwise.sidechain),
    "loudness": Op(pointwise.loudness),
    "packet_loss_concealment": Op(timeline.packet_loss_concealment, frames=False),
    "agc": _machine(stateful.agc, stateful.OUT),
    "silence_removal": _machine(stateful.silence_removal, stateful.OUT),
    "clock_drift": _machine(stateful.clock_drift, "source_id string, seq long, stamp_ns long"),
    "jitter_buffer": _machine(stateful.jitter_buffer, "source_id string, seq long, arrival_ns long, released_ns long", ("arrival_ns",)),
    "mix": Op(asof.mix, inputs=0, frames=False),
    "monitor_mix": Op(asof.monitor_mix, inputs=0, frames=False),
    "aec_linear": Op(asof.aec_linear, inputs=2, frames=False),
    "ducking": Op(_ducked, inputs=2, frames=False),
    "crossfade": Op(asof.crossfade, inputs=2, needs=1, frames=False),
    "kws_vad_gate": Op(asof.vad_gate, inputs=2, frames=False),
}


@dataclass(frozen=True)
class Node:
    """``input``: the id of a source or node, or a tuple of them."""

    id: str
    op: str
    input: str | tuple[str, ...]
    params: Mapping[str, object] = field(default_factory=dict)

    @property
    def inputs(self) -> tuple[str, ...]:
        return (self.input,) if isinstance(self.input, str) else tuple(self.input)


def check(nodes: list[Node], sources: Mapping[str, object], channels: Mapping[str, int] | None = None) -> None:
    """Unknown operators and inputs, repeated ids, wrong numbers of inputs, inputs without frames and channel mismatches are errors."""
    known, width, whole = set(sources), dict(channels or {}), set(sources)
    for node in nodes:
        if node.op not in REGISTRY:
            raise ValueError(f"{node.id}: unknown operator {node.op!r}")
        op = REGISTRY[node.op]
        for name in node.inputs:
            if name not in known:
                raise ValueError(f"{node.id}: unknown input {name!r}")
            if name not in whole:
                raise ValueError(f"{node.id}: {name} gives no frames")
        if node.id in known:
            raise ValueError(f"{node.id}: id is taken")
        if len(node.inputs) < 1 or op.inputs and op.inputs != len(node.inputs):
            raise ValueError(f"{node.id}: takes {op.inputs or 'one or more'} inputs")
        have = {width[name] for name in node.inputs if name in width}
        if len(have) > 1 or op.needs and have and have != {op.needs}:
            raise ValueError(f"{node.id}: needs {op.needs or 'equal'} channels, inputs have {sorted(have)}")
        known.add(node.id)
        if op.frames:
            whole.add(node.id)
        leaves = {"upmix": node.params.get("channels", 2), "downmix": 1 if node.params.get("mode") == "average_to_mono" else 2, "channel_convert": 1 if node.params.get("mode") == "stereo_to_mono_average" else 2}.get(node.op, op.leaves)
        if leaves or have:
            width[node.id] = leaves or have.pop()


def build(nodes: list[Node], sources: Mapping[str, DataFrame], channels: Mapping[str, int] | None = None) -> dict[str, DataFrame]:
    """Every node's output, after :func:`check`."""
    check(nodes, sources, channels)
    made = dict(sources)
    for node in nodes:
        op, inputs = REGISTRY[node.op], [made[name] for name in node.inputs]
        made[node.id] = op.run(*([inputs] if op.inputs == 0 else inputs), **node.params)
    return made
