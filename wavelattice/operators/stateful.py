"""Ordered machines with state, as one streaming fold per key.

``step(state, row) -> (state, rows)`` is pure: it returns a new state and
leaves the old one alone, so batch, streaming and tests share it. Rows are
dealt by key and sorted; a task holds one row and one state at a time, never a
key's rows. Filters over samples are in :mod:`filters`, which advance many
streams side by side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Step = Callable[[object, dict], tuple[object, list[dict]]]
OUT = "source_id string, seq long, samples array<float>"


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def ordered_fold(rows: DataFrame, step: Step, schema: str, key: str | tuple[str, ...] = "source_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    keys = (key,) if isinstance(key, str) else key
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if (now := tuple(row[k] for k in keys)) != at:
                    at, state = now, None
                state, made = step(state, row)
                out += made
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def good(x: np.ndarray) -> bool:
    return len(x) > 0 and bool(np.isfinite(x).all()) and bool((np.abs(x) <= 1.0).all())


def _emit(row: dict, y: np.ndarray) -> list[dict]:
    return [{"source_id": row["source_id"], "seq": row["seq"], "samples": y.astype(np.float32)}]


def agc(target: float = 0.1, min_gain: float = 0.25, max_gain: float = 4.0, attack_ms: float = 10.0, release_ms: float = 250.0) -> Step:
    """Gain follows target / RMS of the frame, quicker when it falls."""

    def step(gain, row):
        x, c = np.asarray(row["samples"], np.float64), int(row["channels"])
        if not good(x) or len(x) % c:
            return gain, []
        now = 1.0 if gain is None else gain
        level = math.sqrt(float((x * x).mean()))
        want = min(max(target / level, min_gain), max_gain) if level > 0 else max_gain
        tau = (attack_ms if want < now else release_ms) / 1000
        now += (1 - math.exp(-(len(x) // c) / row["sample_rate"] / tau)) * (want - now)
        y = (x * now).astype(np.float32)
        return (now, _emit(row, y)) if good(y) else (gain, [])

    return step


def ducking(threshold: float = 0.05, gain_db: float = -12.0, attack_ms: float = 10.0, release_ms: float = 250.0) -> Step:
    """Rows of ``sidechain_level``: the gain falls while the side is loud and recovers otherwise, between the ducked gain and 1."""
    low = 10 ** (gain_db / 20)

    def step(gain, row):
        x = np.asarray(row["samples"], np.float64)
        now, level = 1.0 if gain is None else gain, row["level"]
        want = low if level is not None and level >= threshold else 1.0
        tau = (attack_ms if want < now else release_ms) / 1000
        now += (1 - math.exp(-(len(x) // row["channels"]) / row["sample_rate"] / tau)) * (want - now)
        now = min(1.0, max(low, now))
        y = (x * now).astype(np.float32)
        return (now, _emit(row, y)) if good(y) else (gain, [])

    return step


def silence_removal(threshold: float = 0.02, hangover_ms: float = 200.0) -> Step:
    def step(left, row):
        x = np.asarray(row["samples"], np.float64)
        if not good(x):
            return left, []
        n, c = len(x), int(row["channels"])
        left = 0 if left is None else left
        if math.sqrt(float((x * x).mean())) >= threshold:
            return int(hangover_ms * row["sample_rate"] / 1000), _emit(row, x)
        return (max(0, left - n // c), _emit(row, x)) if left > 0 else (0, [])

    return step


def clock_drift(alpha: float = 0.1, max_correction_ms: float = 2.0, reset_ms: float = 50.0) -> Step:
    """Stamps follow the sample count; the drift's moving average corrects them within bounds.

    A correction never takes back all of the frame before: at most its
    duration less a nanosecond. Stamps are carried in extended precision and
    rounded, half away from zero, in the output alone. A change of format
    starts the timeline anew.
    """
    wide = np.longdouble
    most, far = wide(max_correction_ms) * wide(1e6), wide(reset_ms) * wide(1e6)

    def step(state, row):
        form = (int(row["sample_rate"]), int(row["channels"]))
        span = wide(len(row["samples"]) // form[1]) / wide(form[0]) * wide(1e9)
        stamp = wide(int(row["stamp_ns"]))
        if state is not None and state[3] != form:
            state = None
        expected = None if state is None else state[0] + state[1]
        if expected is None or abs(stamp - expected) > far:
            out, drift = stamp, wide(0)
        else:
            drift = (1 - wide(alpha)) * state[2] + wide(alpha) * (stamp - expected)
            down = wide(0) if state[1] <= 1 else min(most, state[1] - 1)
            out = expected + max(-down, min(most, drift))
        if out < 0:
            return None, []
        return (out, span, drift, form), [{"source_id": row["source_id"], "seq": row["seq"], "stamp_ns": int(np.floor(out + wide(0.5)))}]

    return step


def jitter_buffer(target: int = 2, max_depth: int = 8, reset_on_regression: bool = False) -> Step:
    """Reorder by seq holding ``target`` frames.

    Repeats of a held frame or of the last one released go; frames before that
    go too, or reset the buffer. A frame that finds ``max_depth`` held resets
    the buffer and is lost with it.
    """
    if not 0 <= target < max_depth:
        raise ValueError("the target depth must be below the greatest depth")

    def step(state, row):
        held, last = state or ({}, None)
        seq = int(row["seq"])
        if seq in held or seq == last:
            return state, []
        if last is not None and seq < last:
            if not reset_on_regression:
                return state, []
            held, last = {}, None
        if len(held) >= max_depth:
            return ({}, None), []
        held = {**held, seq: row["arrival_ns"]}
        out = []
        while len(held) > target:
            last = min(held)
            out.append({"source_id": row["source_id"], "seq": last, "arrival_ns": held.pop(last), "released_ns": row["arrival_ns"]})
        return (held, last), out

    return step


def vad_estimator(speech: float = 0.55, silence: float = 0.35, start_delta: float = 0.2, end_delta: float = 0.2, min_start: float = 0.35, max_end: float = 0.45, smoothing: float = 0.35, start_windows: int = 2, end_windows: int = 4, min_speech_ms: int = 120, sample_rate: int = 16000) -> Step:
    """Voice start and end from rows (probability, start_sample, end_sample), a window each; the moving average is an output alone.

    Speech lasts from the start of the window that confirms it; the window
    that starts it may count towards its end.
    """
    if not 0 <= silence <= speech <= 1 or start_windows < 1 or end_windows < 1 or min_speech_ms < 0:
        raise ValueError("estimator parameters are out of range")
    least = int(sample_rate * min_speech_ms / 1000)

    def step(state, row):
        smooth, last, active, since, up, down = state or (0.0, 0.0, False, 0, 0, 0)
        p = max(0.0, min(1.0, float(row["probability"])))
        smooth = smoothing * p + (1 - smoothing) * smooth
        started = ended = False
        up = 0 if active or not (p >= speech or p >= min_start and p - last >= start_delta) else up + 1
        if not active and up >= start_windows:
            started = active = True
            since, down = int(row["start_sample"]), 0
        down = 0 if not active or not (p <= silence or p <= max_end and last - p >= end_delta) else down + 1
        if active and down >= end_windows and int(row["end_sample"]) - since >= least:
            ended, active, up = True, False, 0
        made = {"source_id": row["source_id"], "seq": row["seq"], "smoothed": smooth, "active": active, "started": started, "ended": ended}
        return (smooth, p, active, since, up, down), [made]

    return step


GATED = "source_id string, seq long, arrival_ns long, segment long, opened boolean, merged boolean, closed boolean, samples array<float>"


def stream_gate(pre_roll_ms: int = 500, hangover_ms: int = 900, merge_gap_ms: int = 400, sample_rate: int = 16000) -> Step:
    """Segments of keyword audio from rows (active, arrival_ns, samples).

    Voice opens a segment with the audio just before it. Silence passes on for
    the hangover, is held back for the merge gap after it, and then closes the
    segment; voice within the gap goes on with it.
    """
    room = int(sample_rate * pre_roll_ms / 1000)

    def step(state, row):
        is_open, segment, voice, waiting, held = state or (False, 0, None, False, np.zeros(0, np.float32))
        x, now = np.asarray(row["samples"], np.float32), int(row["arrival_ns"])
        opened = merged = closed = False
        out = None
        if row["active"]:
            voice = now
            if is_open:
                merged, out = waiting, x
            else:
                segment, opened, out = segment + 1, True, np.concatenate([held, x])
            is_open, waiting = True, False
        elif is_open:
            quiet = now - voice
            waiting = quiet > hangover_ms * 1_000_000
            if not waiting:
                out = x
            elif quiet > (hangover_ms + merge_gap_ms) * 1_000_000:
                is_open, waiting, closed = False, False, True
        held = np.concatenate([held, x])[-room:] if room else held
        made = {"source_id": row["source_id"], "seq": row["seq"], "arrival_ns": now, "segment": segment, "opened": opened, "merged": merged, "closed": closed, "samples": out}
        return (is_open, segment, voice, waiting, held), [made] if out is not None or closed else []

    return step


def cooldown(ms: float = 1500.0) -> Step:
    """Detections that come too soon after one that passed go."""

    def step(last, row):
        now = row["arrival_ns"]
        if last is not None and now - last < ms * 1e6:
            return last, []
        return now, [{"source_id": row["source_id"], "seq": row["seq"]}]

    return step


DIALOGUE = "source_id string, now_ms long, session_id string, turn long, kind string, reason string, request_id long, asr string"


def dialogue(min_active_ms: int = 3000, no_speech_ms: int = 6000, quiet_ms: int = 1200, threshold: float = 0.65, fallback_ms: int = 3500, max_active_ms: int = 30000, prefix: str = "session-", wake_max_age_ms: int = 1000, allow_zero_stamp: bool = True) -> Step:
    """Turns from events that carry ``now_ms``; a decision (``DIALOGUE``) for each.

    Events: wake (with keyword and stamp_ms, 0 for none), speech, quiet,
    candidate (session_id, user_turn_id, request_id, probability) and tick. A
    fresh wake opens a turn. Time passes with ticks alone: they end a turn
    that is too long or without speech, ask the turn detector once for each
    quiet stretch, and end a turn that stays quiet. A candidate must answer
    the pending request.
    """
    if not 0 <= min_active_ms <= min(no_speech_ms, max_active_ms) or not 0 < quiet_ms <= fallback_ms or not 0 <= threshold <= 1:
        raise ValueError("dialogue parameters are out of range")
    start = {"session": "", "sessions": 1, "turns": 1, "requests": 1, "turn": 0, "since": None, "spoke": False, "quiet": None, "pending": 0, "checked": None}

    def fresh(row, now):
        stamp = row.get("stamp_ms")
        if not stamp:
            return None if allow_zero_stamp else "zero_stamp_disallowed"
        return "future_stamp" if now < stamp else "stale_stamp" if now - stamp > wake_max_age_ms else None

    def decide(s, row):
        """(kind, reason); ``s`` is this step's own."""
        now, event = int(row["now_ms"]), row["event"]

        def end(reason):
            s.update(turn=0, since=None, spoke=False, quiet=None, pending=0, checked=None)
            return "ended", reason

        if event == "wake":
            if not (row.get("keyword") or "").strip():
                return "ignored", "empty_keyword"
            if stale := fresh(row, now):
                return "rejected", stale
            if s["turn"]:
                return "ignored", "turn_active"
            if not s["session"]:
                s.update(session=f"{prefix}{s['sessions']}", sessions=s["sessions"] + 1)
            s.update(turn=s["turns"], turns=s["turns"] + 1, since=now, spoke=False, quiet=None, pending=0, checked=None)
            return "accepted", "wake"
        if not s["turn"]:
            return "ignored", "turn_not_active"
        age = max(0, now - s["since"])
        if event == "speech":
            s.update(spoke=True, quiet=None, pending=0, checked=None)
            return "accepted", "speech_active"
        if event == "quiet":
            if not s["spoke"]:
                return "ignored", "waiting_for_speech"
            if s["quiet"] is not None:
                return "ignored", "quiet_continues"
            s.update(quiet=now, pending=0, checked=None)
            return "accepted", "quiet_started"
        if event == "candidate":
            if row["session_id"] != s["session"]:
                return "ignored", "session_mismatch"
            if int(row["user_turn_id"]) != s["turn"]:
                return "ignored", "turn_mismatch"
            if not s["pending"]:
                return "ignored", "no_pending_td_request"
            if int(row["request_id"]) != s["pending"]:
                return "ignored", "td_request_mismatch"
            s["pending"] = 0
            if s["quiet"] is None:
                return "ignored", "speech_resumed"
            s["checked"] = s["quiet"]
            return end("td_end") if row["probability"] >= threshold and age >= min_active_ms else ("accepted", "td_not_end")
        if age >= max_active_ms:
            return end("max_active_timeout")
        if not s["spoke"]:
            return end("no_speech_timeout") if age >= no_speech_ms else ("ignored", "waiting_for_speech")
        if s["quiet"] is None:
            return "ignored", "speech_active"
        silent = now - s["quiet"]
        if age >= min_active_ms:
            if silent >= quiet_ms and not s["pending"] and s["checked"] != s["quiet"]:
                s.update(pending=s["requests"], requests=s["requests"] + 1)
                return "accepted", "turn_end_requested"
            if silent >= fallback_ms:
                return end("quiet_fallback")
        return "ignored", "waiting_for_end"

    def step(state, row):
        s = dict(state or start)
        before = s["turn"]
        kind, reason = decide(s, row)
        asr = "start" if reason == "wake" else "stop" if kind == "ended" else None
        request = s["pending"] if reason == "turn_end_requested" else None
        return s, [{"source_id": row["source_id"], "now_ms": row["now_ms"], "session_id": s["session"], "turn": s["turn"] or before, "kind": kind, "reason": reason, "request_id": request, "asr": asr}]

    return step


PLAYED = "source_id string, seq long, event string, accepted boolean, message string, epoch long, paused boolean, depth long"


def playback(max_queue: int = 8) -> Step:
    """The bounded output queue and its control, from rows (event, epoch).

    Events: frame, done (the device took the oldest frame), stop, pause and
    resume. A stop begins the next epoch and empties the queue; frames of
    older epochs are refused; a full queue fails the sink for good.
    """

    def step(state, row):
        queue, epoch, paused, failed = state or ((), 0, False, False)
        event, ok, message = row["event"], True, "ok"
        if failed:
            ok, message = False, "failed closed"
        elif event == "frame":
            if row["epoch"] < epoch:
                ok, message = False, "stale epoch"
            elif len(queue) >= max_queue:
                ok, message, failed, queue = False, "queue overflow", True, ()
            else:
                queue = (*queue, row["seq"])
        elif event == "done":
            if paused or not queue:
                ok, message = False, "paused" if paused else "empty"
            else:
                message, queue = f"played {queue[0]}", queue[1:]
        elif event == "stop":
            if epoch == 2**32 - 1:
                ok, message, failed = False, "playback epoch overflow", True
            else:
                queue, epoch, paused, message = (), epoch + 1, False, "playback stopped"
        elif event in ("pause", "resume"):
            paused, message = event == "pause", f"playback {event}d"
        else:
            ok, message = False, f"unsupported playback control command: {event}"
        made = {"source_id": row["source_id"], "seq": row["seq"], "event": event, "accepted": ok, "message": message, "epoch": epoch, "paused": paused, "depth": len(queue)}
        return (queue, epoch, paused, failed), [made]

    return step
