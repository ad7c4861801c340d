"""PCM and WAV at the edges, and frames as bytes.

``WIRE`` is the frame record as it travels: the header of ``model.FRAME`` with
encoding, bit depth, layout and bytes. :func:`from_wire` admits frames of the
expected identity and format alone and :func:`refused` says why others aren't;
:func:`to_wire` goes back. Files are read in ranges and written stream by
stream in order, never a stream in one row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import FRAME
from ..operators.stateful import arrow_schema

WIRE = "source_id string, stream_id string, seq long, generation long, stamp_ns long, arrival_ns long, sample_rate int, channels int, encoding string, bit_depth int, layout string, data binary"
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
WIRE_KINDS = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in WIRE.split(", "))])
#: encoding: (numpy type, bits, what a sample is divided by).
ENCODINGS = {"PCM16LE": ("<i2", 16, 32768.0), "PCM32LE": ("<i4", 32, 2147483648.0), "FLOAT32LE": ("<f4", 32, 1.0)}
LAYOUTS = ("interleaved", "planar")
_STREAM = ["source_id", "stream_id"]


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def decode(data: bytes, encoding: str, layout: str = "interleaved", channels: int = 1) -> np.ndarray:
    kind, bits, scale = ENCODINGS[encoding]
    if len(data) % (bits // 8 * channels):
        raise ValueError("bytes are not whole sample frames")
    x = (np.frombuffer(data, kind) / scale).astype(np.float32)
    return x if layout == "interleaved" else x.reshape(channels, -1).T.ravel()


def encode(samples, encoding: str, layout: str = "interleaved", channels: int = 1) -> bytes:
    """Negative samples times the full scale, others times one less, half away from zero; floats as they are."""
    kind, bits, scale = ENCODINGS[encoding]
    x = np.asarray(samples, np.float64)
    if layout == "planar":
        x = x.reshape(-1, channels).T.ravel()
    if encoding == "FLOAT32LE":
        return x.astype(kind).tobytes()
    scaled = x * np.where(x < 0, scale, scale - 1)
    whole = np.sign(scaled) * np.floor(np.abs(scaled) + 0.5)
    return np.clip(whole, -scale, scale - 1).astype(kind).tobytes()


def _fault(expected: dict) -> Column:
    """Why a wire frame isn't admitted; null if it is."""
    width = F.when(F.col("bit_depth") > 0, F.col("bit_depth") / 8 * F.col("channels"))
    bits = F.create_map(*(x for name, (_, b, _) in ENCODINGS.items() for x in (F.lit(name), F.lit(b))))
    why = F.when((F.coalesce("source_id", F.lit("")) == "") | (F.coalesce("stream_id", F.lit("")) == ""), "identity is missing")
    for name, value in expected.items():
        why = why.when(~F.col(name).eqNullSafe(F.lit(value)), f"{name} differs")
    why = why.when(~F.col("encoding").isin(*ENCODINGS) | (bits[F.col("encoding")] != F.col("bit_depth")) | ~F.col("layout").isin(*LAYOUTS) | (F.col("channels") < 1) | (F.col("sample_rate") < 1), "format is not known")
    return why.when(F.coalesce(F.octet_length("data"), F.lit(0)) == 0, "empty").when(F.octet_length("data") % width != 0, "not frame aligned")


def refused(wire: DataFrame, **expected) -> DataFrame:
    return wire.withColumn("reason", _fault(expected)).filter("reason IS NOT NULL").select(*_STREAM, "seq", "reason")


def from_wire(wire: DataFrame, **expected) -> DataFrame:
    """Frames of ``FRAME``. ``expected``: columns and the values that frames must have, such as stream_id or sample_rate."""
    names = [c.split()[0] for c in FRAME.split(", ")]
    kinds = arrow_schema(FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("data", "encoding", "layout", "channels")))
            samples = pa.array([decode(*row) for row in rows], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([samples if c == "samples" else batch.column(c) for c in names], schema=kinds)

    return wire.filter(_fault(expected).isNull()).select(*(c.split()[0] for c in WIRE.split(", "))).mapInArrow(run, FRAME)


def to_wire(frames: DataFrame, encoding: str = "FLOAT32LE", layout: str = "interleaved") -> DataFrame:
    _need(encoding in ENCODINGS and layout in LAYOUTS, "format is not known")
    kinds = WIRE_KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            own = {"encoding": pa.array([encoding] * n, pa.string()), "bit_depth": pa.array([ENCODINGS[encoding][1]] * n, pa.int32()), "layout": pa.array([layout] * n, pa.string())}
            own["data"] = pa.array([encode(x, encoding, layout, c) for x, c in zip(batch.column("samples").to_pylist(), batch.column("channels").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else batch.column(f.name) for f in kinds], schema=kinds)

    return frames.select(*(c.split()[0] for c in FRAME.split(", "))).mapInArrow(run, WIRE)


def read_pcm(spark: SparkSession, path: str, encoding: str = "PCM16LE", rate: int = 16000, channels: int = 1, chunk: int = 512, stream: str = "pcm", loops: int = 1, split_frames: int = 1 << 20) -> DataFrame:
    """Wire frames of ``chunk`` sample frames of headerless files; stamps go on by frames / rate, over ``loops`` rounds.

    Tasks read ranges, not files. An empty file, or one that isn't whole
    sample frames, is an error. The source of a frame is its file's path.
    """
    _need(encoding in ENCODINGS and rate > 0 and channels > 0 and chunk > 0 and loops > 0, "source parameters are out of range")
    bits = ENCODINGS[encoding][1]
    width, step = bits // 8 * channels, max(1, split_frames // chunk) * chunk
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") / width).alias("n"))
    whole = F.when((F.col("n") > 0) & (F.floor("n") == F.col("n")), F.col("n").cast("long")).otherwise(F.raise_error(F.concat(F.lit("not whole sample frames: "), F.col("path"))))
    ranges = files.withColumn("n", whole).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
    ranges = ranges.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))).repartition(F.col("path"), F.col("at"), F.col("turn"))
    kinds = WIRE_KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                system, name = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(name) as f:
                    f.seek(row["at"] * width)
                    data = f.read(min(step, row["n"] - row["at"]) * width)
                out = []
                for k in range(0, len(data), chunk * width):
                    at = row["turn"] * row["n"] + row["at"] + k // width
                    seq = row["turn"] * -(-row["n"] // chunk) + row["at"] // chunk + k // (chunk * width)
                    stamp = at * 10**9 // rate
                    out.append(dict(zip(kinds.names, (row["path"], stream, seq, 0, stamp, stamp, rate, channels, encoding, bits, "interleaved", data[k : k + chunk * width]))))
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return ranges.mapInArrow(run, WIRE)


def wav_header(n_bytes: int, rate: int, channels: int, encoding: str = "PCM16LE") -> bytes:
    bits, tag = ENCODINGS[encoding][1], 3 if encoding == "FLOAT32LE" else 1
    if n_bytes + 36 >= 1 << 32:
        raise ValueError("a WAV file holds less than 4 GiB")
    width = bits // 8 * channels
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n_bytes, b"WAVE", b"fmt ", 16, tag, channels, rate, rate * width, width, bits, b"data", n_bytes)


def wav_bytes(samples, rate: int, channels: int = 1, encoding: str = "PCM16LE") -> bytes:
    data = encode(samples, encoding, "interleaved", channels)
    return wav_header(len(data), rate, channels, encoding) + data


def read_wav(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples, rate, channels) of a WAV file of the encodings known here."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and form:
            encoding = {(1, 16): "PCM16LE", (1, 32): "PCM32LE", (3, 32): "FLOAT32LE"}[form[0], form[5]]
            return decode(data[at + 8 : at + 8 + size], encoding), form[2], form[1]
        at += 8 + size + size % 2
    raise ValueError("a chunk is missing")


def _in_order(frames: DataFrame) -> DataFrame:
    """Frames of the format that their stream begins with, by stream and seq, with the stream's total of samples."""
    form = F.struct("sample_rate", "channels")
    begins = frames.groupBy(*_STREAM).agg(F.min_by(form, "seq").alias("form"))
    kept = frames.join(begins, _STREAM).filter(form == F.col("form")).drop("form")
    totals = kept.groupBy(*_STREAM).agg(F.sum(F.size("samples")).alias("total"))
    return kept.join(totals, _STREAM).repartition(*_STREAM).sortWithinPartitions(*_STREAM, "seq")


def write_files(frames: DataFrame, folder: str, kind: str = "wav", encoding: str = "PCM16LE", overwrite: bool = False) -> DataFrame:
    """A ``kind`` (wav or pcm) file for each stream below ``folder``, a URI all executors reach: (source_id, stream_id, uri, n_bytes, sha256).

    A task appends frame after frame; a file appears whole by a rename. A
    frame whose format differs from its stream's first one is left out. An
    existing file is an error unless ``overwrite``.
    """
    import hashlib

    _need(kind in ("wav", "pcm") and encoding in ENCODINGS, "file kind or encoding is not known")
    schema = "source_id string, stream_id string, uri string, n_bytes long, sha256 string"
    kinds = arrow_schema(schema)
    safe = lambda s: re.sub(r"[^A-Za-z0-9-]", lambda m: f"_{ord(m.group()):x}_", s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        at, sink, done = None, None, []

        def put(data: bytes) -> None:
            sink.write(data)
            sha.update(data)
            state["n"] += len(data)

        def close() -> None:
            sink.close()
            system.move(state["part"], state["path"])
            done.append({"source_id": at[0], "stream_id": at[1], "uri": f"{folder}/{state['name']}", "n_bytes": state["n"], "sha256": sha.hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["source_id"], row["stream_id"])) != at:
                    if at is not None:
                        close()
                    at, sha = now, hashlib.sha256()
                    name = f"{safe(now[0])}__{safe(now[1])}.{kind}"
                    state = {"name": name, "path": f"{root}/{name}", "part": f"{root}/.{name}.{np.random.default_rng().integers(1 << 62)}.part", "n": 0}
                    if not overwrite and system.get_file_info(state["path"]).type != fs.FileType.NotFound:
                        raise FileExistsError(state["path"])
                    sink = system.open_output_stream(state["part"])
                    if kind == "wav":
                        put(wav_header(row["total"] * ENCODINGS[encoding][1] // 8, row["sample_rate"], row["channels"], encoding))
                put(encode(row["samples"], encoding, "interleaved", row["channels"]))
        if at is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    return _in_order(frames).mapInArrow(run, schema)


def recorded(frames: DataFrame, controls: DataFrame) -> DataFrame:
    """Frames between a start and the next stop, ``stream_id`` telling the recording.

    ``controls``: source_id, arrival_ns, action (start or stop). A start while
    one runs, and a stop while none does, changes nothing; frames arrive before
    a control of the same moment. Files of the recordings: :func:`write_files`.
    """
    by = Window.partitionBy("source_id").orderBy("arrival_ns")
    changes = controls.filter(F.col("action").isin("start", "stop")).withColumn("before", F.lag("action").over(by)).filter("action <> coalesce(before, 'stop')")
    marks = changes.select("source_id", "arrival_ns", F.lit(1).alias("side"), F.col("action"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in frames.schema if f.name not in ("source_id", "arrival_ns")))
    rows = frames.withColumns({"side": F.lit(0), "action": F.lit(None).cast("string")})
    order = Window.partitionBy("source_id").orderBy("arrival_ns", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumns({"now": F.last("action", ignorenulls=True).over(order), "number": F.sum((F.col("action") == "start").cast("int")).over(order)})
    live = both.filter("side = 0 AND now = 'start'")
    return live.withColumn("stream_id", F.concat("stream_id", F.lit("-"), F.col("number"))).select(*frames.columns)


def pipe(frames: DataFrame, args: list[str], encoding: str = "PCM16LE", timeout_s: float = 60.0) -> DataFrame:
    """Each stream's PCM, frame after frame, into a program of its own: (source_id, stream_id, n_bytes, code).

    A change of format within a stream, a program that ends early or with
    another code than 0, and one that outlives the deadline after its input
    has ended are errors.
    """
    _need(bool(args) and encoding in ENCODINGS and timeout_s > 0, "a pipe needs arguments, an encoding and a deadline")
    schema = "source_id string, stream_id string, n_bytes long, code int"
    kinds = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import subprocess

        at, form, program, n, done = None, None, None, 0, []

        def close() -> None:
            program.stdin.close()
            code = program.wait(timeout_s)
            if code:
                raise RuntimeError(f"{args[0]} ended with {code} for {at}")
            done.append({"source_id": at[0], "stream_id": at[1], "n_bytes": n, "code": code})

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    now, fits = (row["source_id"], row["stream_id"]), (row["sample_rate"], row["channels"])
                    if now != at:
                        if program is not None:
                            close()
                        at, form, n = now, fits, 0
                        program = subprocess.Popen(args, stdin=subprocess.PIPE, stdout=subprocess.DEVNULL)
                    if fits != form:
                        raise ValueError(f"format of {now} changes from {form} to {fits}")
                    n += program.stdin.write(encode(row["samples"], encoding, "interleaved", row["channels"]))
            if program is not None:
                close()
        finally:
            if program is not None and program.poll() is None:
                program.kill()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kinds)

    return frames.repartition(*_STREAM).sortWithinPartitions(*_STREAM, "seq").mapInArrow(run, schema)


def record_wav(frames: DataFrame, encoding: str = "PCM16LE") -> DataFrame:
    """(source_id, stream_id, wav, sha256): streams short enough for a row (below 2 GiB) as WAV bytes; :func:`write_files` for others."""
    schema = "source_id string, stream_id string, wav binary"
    kinds = arrow_schema(schema)
    most = (1 << 31) // (ENCODINGS[encoding][1] // 8) - 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"source_id": at[0], "stream_id": at[1], "wav": b"".join(parts)}], schema=kinds)

        for batch in batches:
            for row in batch.to_pylist():
                if (now := (row["source_id"], row["stream_id"])) != at:
                    if parts:
                        yield made()
                    if row["total"] > most:
                        raise ValueError(f"stream {now} is too long for a row")
                    at, parts = now, [wav_header(row["total"] * ENCODINGS[encoding][1] // 8, row["sample_rate"], row["channels"], encoding)]
                parts.append(encode(row["samples"], encoding, "interleaved", row["channels"]))
        if parts:
            yield made()

    return _in_order(frames).mapInArrow(run, schema).withColumn("sha256", F.sha2("wav", 256))


def write_frames(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """Frames as Parquet by stream; an existing target is an error unless ``overwrite``."""
    frames.write.partitionBy("stream_id").mode("overwrite" if overwrite else "errorifexists").parquet(path)
