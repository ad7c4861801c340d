"""What surrounds a model: windows, chunks, deadlines and checks, with the model itself given by the caller.

A model is any callable that can be shipped to a task; ``make`` builds it
there. No weights are part of this library. Everything is a ``step`` for
:func:`stateful.ordered_fold`, keyed by stream and ordered by arrival.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stateful import Step, arrow_schema

Samples = np.ndarray


@lru_cache(maxsize=8)
def _made(make: Callable):
    return make()


def _mono(row: dict) -> np.ndarray | None:
    x = np.asarray(row["samples"] if row["samples"] is not None else (), np.float32)
    return np.clip(x, -1, 1) if len(x) and np.isfinite(x).all() else None


WINDOWS = "source_id string, seq long, probability double, start_sample long, end_sample long"


def vad_windows(make: Callable[[], Callable[[Samples], float]], window: int = 512) -> Step:
    """A probability for each ``window`` samples of a stream; the rest waits for the next frame."""

    def step(state, row):
        pending, done, n = state or (np.zeros(0, np.float32), 0, 0)
        x = _mono(row)
        if x is None:
            return state, []
        pending, out = np.concatenate([pending, x]), []
        while len(pending) >= window:
            p = float(_made(make)(pending[:window]))
            if not 0 <= p <= 1:
                raise ValueError("a voice model's probability must be in [0, 1]")
            out.append({"source_id": row["source_id"], "seq": n, "probability": p, "start_sample": done, "end_sample": done + window})
            pending, done, n = pending[window:], done + window, n + 1
        return (pending, done, n), out

    return step


KEYWORDS = "source_id string, seq long, segment long, keyword string, score double"


def keyword(make: Callable[[], Callable[[object, Samples], tuple[object, tuple[str, float] | None]]], threshold: float = 0.5, cooldown_ms: float = 1500.0) -> Step:
    """Detections over the rows of ``stateful.stream_gate``.

    The model takes (its state or None, samples) and gives (its state, a
    keyword with its score or None). It starts anew with each segment; a hit
    of a blank keyword, below the threshold, or too soon after one that passed
    (in any segment) goes.
    """
    if not 0 <= threshold <= 1 or cooldown_ms < 0:
        raise ValueError("keyword parameters are out of range")

    def step(state, row):
        model, last = state or (None, None)
        if row["closed"] or row["opened"]:
            model = None
        if row["samples"] is None or not len(row["samples"]):
            return (model, last), []
        model, hit = _made(make)(model, np.asarray(row["samples"], np.float32))
        now = row["arrival_ns"]
        if hit is None or not hit[0].strip() or hit[1] < threshold or last is not None and now - last < cooldown_ms * 1e6:
            return (model, last), []
        return (model, now), [{"source_id": row["source_id"], "seq": row["seq"], "segment": row["segment"], "keyword": hit[0], "score": float(hit[1])}]

    return step


TRANSCRIPTS = "source_id string, seq long, session_id string, user_turn_id long, text string, is_final boolean, accepted_samples long"


def asr_stream(make: Callable[[], Callable[[object, Samples, bool], tuple[object, str]]], chunk: int = 16000, right: int = 4000, pre_roll_ms: int = 500, sample_rate: int = 16000) -> Step:
    """Recognition between start and stop events.

    The model takes (its state or None, samples, whether they are the last)
    and gives (its state, the text so far). Its first call takes a chunk and
    its right context, later ones a chunk. A start sends the last samples
    heard before it; partial texts that are empty or repeat the one before are
    left out; a stop sends what is left and gives the final text; a cancel
    gives none.
    """
    room = int(sample_rate * pre_roll_ms / 1000)
    idle = {"on": False, "heard": np.zeros(0, np.float32), "pending": np.zeros(0, np.float32), "model": None, "steps": 0, "accepted": 0, "text": "", "shown": "", "session": "", "turn": 0}

    def step(state, row):
        s, out = dict(state or idle), []

        def say(text, final):
            out.append({"source_id": row["source_id"], "seq": row["seq"], "session_id": s["session"], "user_turn_id": s["turn"], "text": text, "is_final": final, "accepted_samples": s["accepted"]})

        def decode(x, last):
            model, text = _made(make)(s["model"], x, last)
            s.update(model=model, text=text, steps=s["steps"] + 1, accepted=s["accepted"] + len(x))

        def push(x):
            s["pending"] = np.concatenate([s["pending"], x])
            while len(s["pending"]) >= (need := chunk + (0 if s["steps"] else right)):
                part, s["pending"] = s["pending"][:need], s["pending"][need:]
                decode(part, False)
                text = s["text"].strip()
                if text and text != s["shown"]:
                    s["shown"] = text
                    say(s["text"], False)

        event = row["event"]
        if event == "start":
            if not row["session_id"] or row["user_turn_id"] <= 0:
                raise ValueError("a start needs a session and a turn")
            heard = s["heard"]
            s = {**idle, "on": True, "session": row["session_id"], "turn": row["user_turn_id"]}
            if len(heard):
                push(heard)
        elif event in ("stop", "cancel"):
            if s["on"] and event == "stop":
                if len(s["pending"]):
                    decode(s["pending"], True)
                say(s["text"], True)
            s = {**idle, "heard": s["heard"]}
        elif (x := _mono(row)) is not None:
            if s["on"]:
                push(x)
            elif room:
                s["heard"] = np.concatenate([s["heard"], x])[-room:]
        return s, out

    return step


def partial_dedup(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Partial texts without those that are blank or, trimmed, repeat the last one kept."""
    by = Window.partitionBy(key).orderBy(order)
    said = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    before = F.lag(F.trim(text)).over(by)
    return said.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.trim(text))).drop("__before")


TURN_ENDS = "source_id string, seq long, session_id string, user_turn_id long, request_id long, probability double, is_end boolean, n_samples long"


def turn_detector(make: Callable[[], Callable[[Samples], float]], min_samples: int = 1600, max_samples: int = 128000, threshold: float = 0.5) -> Step:
    """Answers to requests about the audio of the active turn.

    Events: context (session_id, user_turn_id, active), audio, and request
    (session_id, user_turn_id, request_id). A new turn, or none, empties the
    buffer; requests for another turn and those with too little audio get no
    answer; the model sees the newest samples.
    """

    def step(state, row):
        session, turn, held = state or ("", 0, np.zeros(0, np.float32))
        event = row["event"]
        if event == "context":
            now = (row["session_id"], row["user_turn_id"]) if row["active"] and row["session_id"] else ("", 0)
            return (*now, held if now == (session, turn) and session else np.zeros(0, np.float32)), []
        if not session:
            return (session, turn, held), []
        if event == "audio":
            x = _mono(row)
            return (session, turn, held if x is None else np.concatenate([held, x])[-max_samples:]), []
        if (row["session_id"], row["user_turn_id"]) != (session, turn) or row["request_id"] <= 0 or len(held) < min_samples:
            return (session, turn, held), []
        p = float(_made(make)(held))
        if not 0 <= p <= 1:
            raise ValueError("a turn model's probability must be in [0, 1]")
        made = {"source_id": row["source_id"], "seq": row["seq"], "session_id": session, "user_turn_id": turn, "request_id": row["request_id"], "probability": p, "is_end": p >= threshold, "n_samples": len(held)}
        return (session, turn, held), [made]

    return step


def embeddings(frames: DataFrame, make: Callable[[], Callable[[Samples, int], np.ndarray]], model_id: str, dimension: int) -> DataFrame:
    """source_id, stream_id, seq, model_id, embedding of each frame; a vector of another length or with non-finite numbers is an error."""
    if not model_id.strip() or dimension <= 0:
        raise ValueError("a model needs an id and a dimension")
    schema = "source_id string, stream_id string, seq long, model_id string, embedding array<float>"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (x := _mono(row)) is None or row["sample_rate"] <= 0:
                    continue
                vector = np.asarray(_made(make)(x, row["sample_rate"]), np.float32)
                if vector.shape != (dimension,) or not np.isfinite(vector).all():
                    raise ValueError(f"an embedding must be {dimension} finite numbers")
                out.append({k: row[k] for k in ("source_id", "stream_id", "seq")} | {"model_id": model_id, "embedding": vector})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return frames.select("source_id", "stream_id", "seq", "sample_rate", "samples").mapInArrow(run, schema)


def speech_key(text: str, voice: str) -> str:
    return hashlib.sha256(f"{voice}\n{text}".encode()).hexdigest()


def speak(requests: DataFrame, make: Callable[[], Callable[[str, str], np.ndarray]], sample_rate: int, voice: str = "default") -> DataFrame:
    """request_id, ok, message, cache_key, hit, sample_rate, samples for requests (request_id, text, voice_id, cache_key, play, volume_db).

    Equal keys are synthesised once: the request with the least id is the
    miss, all others take its audio. Playback and gain belong to other
    operators and are refused.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    key = F.coalesce(F.nullif("cache_key", F.lit("")), F.sha2(F.concat_ws("\n", F.coalesce(F.nullif("voice_id", F.lit("")), F.lit(voice)), text), 256))
    why = F.when(text == "", "text is empty").when(F.col("play"), "playback is not part of synthesis").when(F.col("volume_db") != 0, "gain is not part of synthesis").when(~key.rlike("^[A-Za-z0-9_.-]+$"), "cache key is not valid")
    rows = requests.select("request_id", text.alias("text"), F.coalesce(F.nullif("voice_id", F.lit("")), F.lit(voice)).alias("voice"), key.alias("cache_key"), F.coalesce(why, F.lit("ok")).alias("message"))
    first = rows.filter("message = 'ok'").groupBy("cache_key").agg(F.min(F.struct("request_id", "text", "voice")).alias("x"))
    schema = "cache_key string, first long, samples array<float>"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [{"cache_key": r["cache_key"], "first": r["first"], "samples": np.asarray(_made(make)(r["text"], r["voice"]), np.float32)} for r in batch.to_pylist()]
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=kinds)

    spoken = first.select("cache_key", F.col("x.request_id").cast("long").alias("first"), "x.text", "x.voice").mapInArrow(run, schema)
    ok = F.col("message") == "ok"
    out = rows.join(spoken, "cache_key", "left")
    return out.select("request_id", ok.alias("ok"), "message", "cache_key", (ok & (F.col("request_id") != F.col("first"))).alias("hit"), F.lit(sample_rate).alias("sample_rate"), F.when(ok, F.col("samples")).alias("samples"))
