"""Streams at the edges: a PCM file that grows as a streaming source, and a sink that survives replays.

``spark.dataSource.register(PcmFrames)`` makes ``readStream.format("pcm_frames")``
(and ``read``) give wire frames of fixed chunks. Offsets are sample frames; a
chunk is given once it is whole, so a file may still be written to. Bytes that
aren't whole sample frames when a bounded read ends are an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import pcm


class _Range(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class _Reader:
    """Options: path, encoding, rate, channels, chunk (sample frames), stream, most (sample frames of a batch and partition)."""

    def __init__(self, options: dict):
        self.path, self.encoding = options["path"].removeprefix("file://"), options.get("encoding", "PCM16LE")
        self.rate, self.channels, self.chunk = int(options.get("rate", 16000)), int(options.get("channels", 1)), int(options.get("chunk", 512))
        self.stream, self.most = options.get("stream", "pcm"), int(options.get("most", 1 << 20))
        if self.encoding not in pcm.ENCODINGS or min(self.rate, self.channels, self.chunk, self.most) < 1:
            raise ValueError("source options are out of range")
        self.width = pcm.ENCODINGS[self.encoding][1] // 8 * self.channels

    def whole(self) -> int:
        """Sample frames of whole chunks that the file has now."""
        return os.path.getsize(self.path) // self.width // self.chunk * self.chunk if os.path.exists(self.path) else 0

    def ranges(self, first: int, stop: int) -> list[_Range]:
        step = max(1, self.most // self.chunk) * self.chunk
        return [_Range(at, min(at + step, stop)) for at in range(first, stop, step)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        kinds = pcm.WIRE_KINDS
        with open(self.path, "rb") as f:
            f.seek(part.first * self.width)
            for at in range(part.first, part.stop, self.chunk):
                data = f.read(min(self.chunk, part.stop - at) * self.width)
                stamp = at * 10**9 // self.rate
                row = (self.path, self.stream, at // self.chunk, 0, stamp, stamp, self.rate, self.channels, self.encoding, pcm.ENCODINGS[self.encoding][1], "interleaved", data)
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, row))], schema=kinds)


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        size = os.path.getsize(self.path)
        if not size or size % self.width:
            raise ValueError(f"{self.path} is not whole sample frames")
        return self.ranges(0, size // self.width)


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        return {"frames": self.whole()}

    def partitions(self, start: dict, end: dict):
        return self.ranges(start["frames"], end["frames"])


class PcmFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm_frames"

    def schema(self) -> str:
        return pcm.WIRE

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def drain(frames: DataFrame, folder: str, checkpoint: str, kind: str = "pcm", encoding: str = "FLOAT32LE"):
    """A streaming writer: the files of each micro-batch below a folder of its number, which a replay writes anew; started by the caller."""

    def put(batch: DataFrame, number: int) -> None:
        pcm.write_files(batch, f"{folder}/batch-{number:08d}", kind, encoding, overwrite=True).collect()  # a row a stream

    return frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
