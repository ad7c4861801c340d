"""The batch steps under Structured Streaming: one state value per key.

``step`` is the very function of :mod:`wavelattice.operators.stateful`,
:mod:`filters` or :mod:`models`; windows that have a batch plan have a step
here (:func:`chunk_step`). State is pickled into the state store and goes when
a key has been idle for ``idle_ms``. A micro-batch's rows of a key are sorted
before they are taken, so its size is what bounds a task: limit it with the
source's own options.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.stateful import Step


def live_fold(rows: DataFrame, step: Step, schema: str, key: str | tuple[str, ...] = "source_id", order: tuple[str, ...] = ("seq",), idle_ms: int | None = None) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    keys = [key] if isinstance(key, str) else list(key)

    def run(_, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = pickle.loads(held.get[0]) if held.exists else None
        parts = list(batches)
        if not parts:
            return
        rows = (parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)).sort_values(list(order), kind="stable")
        columns = {c: rows[c].tolist() for c in rows.columns}
        for at in range(0, len(rows), 1024):
            out: list[dict] = []
            for values in zip(*(columns[c][at : at + 1024] for c in columns)):
                state, made = step(state, dict(zip(columns, values)))
                out += made
            yield pd.DataFrame(out, columns=names)
        held.update((pickle.dumps(state),))
        if idle_ms is not None:
            held.setTimeoutDuration(idle_ms)

    timeout = "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout"
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", timeout)


def chunk_step(size: int = 512, hop: int | None = None) -> Step:
    """``frame_buffer`` (and with a hop ``chunk_overlap``) for a stream that goes on: chunks with the header of their first sample's frame.

    A frame of another format than the one before drops what is buffered.
    """
    hop = size if hop is None else hop
    if size <= 0 or not 0 < hop <= size:
        raise ValueError("chunk size and hop must be above 0, the hop not above the size")
    head = ("stamp_ns", "arrival_ns", "generation")

    def step(state, row):
        x, channels = np.asarray(row["samples"], np.float32), int(row["channels"])
        if not len(x) or len(x) % channels or not np.isfinite(x).all():
            return state, []
        held, heads, form, n = state or (np.zeros(0, np.float32), (), None, 0)
        now = (int(row["sample_rate"]), channels)
        if form is not None and form != now:
            held, heads = np.zeros(0, np.float32), ()
        held = np.concatenate([held, x])
        heads = (*heads, (len(x) // channels, {c: row[c] for c in head}))
        out = []
        while len(held) >= size * channels:
            first = {"source_id": row["source_id"], "stream_id": row["stream_id"], "seq": n, "sample_rate": now[0], "channels": channels}
            out.append({**first, **heads[0][1], "samples": held[: size * channels]})
            held, n, left = held[hop * channels :], n + 1, hop
            while left and heads:
                count, header = heads[0]
                heads = heads[1:] if count <= left else ((count - left, header), *heads[1:])
                left -= min(left, count)
        return (held, heads, now, n), out

    return step
