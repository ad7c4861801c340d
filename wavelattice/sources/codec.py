"""Encoded chunks: numbering and media time, with the codec given by the caller.

A codec is a pair of callables over bytes. :func:`command` makes one half from
a program that reads its input and writes its output, within a deadline and a
greatest size; none is part of this library.
"""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME
from ..operators.stateful import arrow_schema
from . import pcm

CHUNK = "source_id string, stream_id string, seq long, generation long, stamp_ns long, sample_rate int, channels int, codec string, sequence long, media_time_ns long, duration_ns long, data binary"


def command(args: list[str], timeout_s: float = 10.0, most_bytes: int = 1 << 26) -> Callable[[bytes], bytes]:
    if not args or timeout_s <= 0 or most_bytes <= 0:
        raise ValueError("a command needs arguments, a deadline and a size")

    def run(data: bytes) -> bytes:
        done = subprocess.run(args, input=data, capture_output=True, timeout=timeout_s, check=False)
        if done.returncode:
            raise RuntimeError(f"{args[0]} failed with {done.returncode}: {done.stderr[-300:].decode(errors='replace')}")
        if len(done.stdout) > most_bytes:
            raise RuntimeError(f"{args[0]} wrote more than {most_bytes} bytes")
        return done.stdout

    return run


def numbered(frames: DataFrame) -> DataFrame:
    """``sequence``, ``media_time_ns`` and ``duration_ns``; the first two begin anew with each generation."""
    own = Window.partitionBy("source_id", "stream_id", "generation").orderBy("seq")
    span = F.expr("cast(size(samples) div channels * 1000000000 div sample_rate as bigint)")
    rows = frames.withColumn("duration_ns", span).filter("duration_ns > 0")
    before = F.coalesce(F.sum("duration_ns").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"sequence": (F.row_number().over(own) - 1).cast("long"), "media_time_ns": before})


def encode_frames(frames: DataFrame, codec: str, coder: Callable[[bytes], bytes], encoding: str = "PCM16LE") -> DataFrame:
    """``CHUNK`` rows of the frames' PCM bytes; a frame that encodes to nothing gives no row and takes no number."""
    kinds = arrow_schema(CHUNK)
    held = "source_id string, stream_id string, seq long, generation long, stamp_ns long, sample_rate int, channels int, samples array<float>, data binary"
    held_kinds = arrow_schema(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [coder(pcm.encode(x, encoding, "interleaved", c)) for x, c in zip(batch.column("samples").to_pylist(), batch.column("channels").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if f.name == "data" else batch.column(f.name) for f in held_kinds], schema=held_kinds)

    rows = frames.select(*(f.name for f in held_kinds if f.name != "data")).mapInArrow(run, held).filter("octet_length(data) > 0")
    return numbered(rows).withColumn("codec", F.lit(codec)).select(*kinds.names)


def decode_chunks(chunks: DataFrame, codec: str, decoder: Callable[[bytes], bytes], encoding: str = "PCM16LE", most_bytes: int = 1 << 26) -> DataFrame:
    """Frames of the chunks of that codec; PCM that is empty, too long or not whole sample frames is an error."""
    kinds = arrow_schema(FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = decoder(row["data"])
                if not data or len(data) > most_bytes:
                    raise ValueError(f"chunk {row['sequence']} of {row['source_id']} decodes to {len(data)} bytes")
                samples = pcm.decode(data, encoding, "interleaved", row["channels"])
                out.append({**{k: row[k] for k in ("source_id", "stream_id", "seq", "generation", "stamp_ns", "sample_rate", "channels")}, "arrival_ns": row["stamp_ns"], "samples": samples})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return chunks.filter(F.col("codec") == codec).mapInArrow(run, FRAME)
