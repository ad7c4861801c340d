"""Clips of a retained range as named WAV files with metadata.

A clip's name follows from what it holds and how it was asked for, so a task
that runs again makes the same files.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.timeline import range_query
from .pcm import wav_bytes

#: Fixed values of the clip names: the 64-bit FNV-1a hash, and the operations' long names.
_FNV_START, _FNV_PRIME = 14695981039346656037, 1099511628211
OPERATIONS = {"export": "export_audio_window", "archive": "archive_audio_window"}

CLIP = "source_id string, status string, clip_id string, start_ns long, stop_ns long, duration_ns long, wav binary, content_sha256 string, metadata string, metadata_sha256 string"


def fnv64(text: str) -> str:
    value = _FNV_START
    for byte in text.encode():
        value = (value ^ byte) * _FNV_PRIME % (1 << 64)
    return f"{value:016x}"


def clip_id(operation: str, window: str, epoch: int, source: str, stream: str, scope: str, start: int, stop: int, reason: str = "") -> str:
    """Readable fields and a hash of all of them with their lengths."""
    form = ("pcm_s16le", "wav", "pcm16le")
    fields = {"operation": OPERATIONS[operation], "window_id": window, "window_epoch": epoch, "source_id": source, "stream_id": stream, "audio_scope": scope, "start_unix_ns": start, "end_unix_ns": stop}
    fields |= dict(zip(("codec", "container", "payload_format"), form))
    if operation == "archive":
        fields["reason"] = reason
    whole = "".join(f"{k}:{len(str(v).encode())}:{v}\n" for k, v in fields.items())
    safe = lambda v: re.sub(rb"[^A-Za-z0-9-]", b"_", v.encode()).decode() or "audio"
    named = [safe(OPERATIONS[operation]), safe(window), f"epoch{epoch}", safe(source), safe(stream), str(start), str(stop), *map(safe, form), fnv64(whole)]
    return "_".join(named)


def clips(frames: DataFrame, start_ns: int, end_ns: int, operation: str = "export", window: str = "window", epoch: int = 0, stream: str = "audio", scope: str = "source", reason: str = "") -> DataFrame:
    """A row (``CLIP``) for each source; only sources that cover the range have a clip.

    ``metadata`` is JSON for archived clips and null for exported ones.
    """
    if operation == "archive" and not reason.strip():
        raise ValueError("an archived clip needs a reason")
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation {operation}")

    def row(r) -> tuple:
        if r.status != "ok":
            return (r.source_id, r.status, *[None] * 8)
        name = clip_id(operation, window, epoch, r.source_id, stream, scope, r.start_ns, r.stop_ns, reason)
        wav, span = wav_bytes(r.samples, r.sample_rate, r.channels), r.stop_ns - r.start_ns
        about = about_sha = None
        if operation == "archive":
            held = {"clip_id": name, "sample_rate": r.sample_rate, "channels": r.channels, "duration_ns": span}
            about = json.dumps({"window_id": window, "window_epoch": epoch, "audio_scope": scope, "reason": reason, "time_range": {"start_unix_ns": r.start_ns, "end_unix_ns": r.stop_ns}, "audio_clip_ref": held})
            about_sha = hashlib.sha256(about.encode()).hexdigest()
        return r.source_id, r.status, name, r.start_ns, r.stop_ns, span, wav, hashlib.sha256(wav).hexdigest(), about, about_sha

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CLIP.split(", ")]
        for batch in batches:
            made = pd.DataFrame([row(r) for r in batch.itertuples(index=False)], columns=names, dtype=object)
            for c in ("start_ns", "stop_ns", "duration_ns"):
                made[c] = made[c].astype("Int64")
            yield made

    return range_query(frames, start_ns, end_ns).mapInPandas(run, CLIP)


def publish(found: DataFrame, uri: str) -> DataFrame:
    """Write each clip (and its metadata) below ``uri``, a folder that all executors share; (clip_id, uri, content_sha256).

    A file appears whole by a rename. A file of that name with other content is
    an error and is left alone; one with equal content counts as published.
    """

    def put(system, path: str, content: bytes) -> bool:
        """Whether the file is new."""
        from pyarrow import fs

        if system.get_file_info(path).type != fs.FileType.NotFound:
            with system.open_input_stream(path) as f:
                if f.read() != content:
                    raise FileExistsError(path)
            return False
        part = f"{path}.{hashlib.sha256(content).hexdigest()[:16]}.part"
        with system.open_output_stream(part) as f:
            f.write(content)
        system.move(part, path)
        return True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(uri)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, wav, about in zip(batch["clip_id"], batch["wav"], batch["metadata"]):
                new = put(system, f"{folder}/{name}.wav", bytes(wav))
                try:
                    if about is not None:
                        put(system, f"{folder}/{name}.wav.metadata.json", about.encode())
                except Exception:
                    if new:  # no clip without its metadata
                        system.delete_file(f"{folder}/{name}.wav")
                    raise
            yield pd.DataFrame({"clip_id": batch["clip_id"], "uri": [f"{uri}/{n}.wav" for n in batch["clip_id"]], "content_sha256": batch["content_sha256"]})

    return found.filter("status = 'ok'").mapInPandas(run, "clip_id string, uri string, content_sha256 string")
