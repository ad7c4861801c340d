"""Operators over the samples of a whole stream, as window plans over frames.

A stream is (source_id, stream_id). :func:`positions` numbers sample frames;
buffers, overlap and resampling are arithmetic on those numbers and on slices
of whole arrays. No plan has a row for each sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import FRAME, accepted
from .stateful import arrow_schema

STREAM = ("source_id", "stream_id")


def _count() -> Column:
    return F.expr("size(samples) div channels")


def positions(frames: DataFrame) -> DataFrame:
    """``first``: number of sample frames before each frame in its stream."""
    before = Window.partitionBy(*STREAM).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("first", F.coalesce(F.sum(_count()).over(before), F.lit(0)))


_HEAD = ("stamp_ns", "arrival_ns", "generation", "sample_rate", "channels")


def _chunks(frames: DataFrame, size: int, hop: int) -> DataFrame:
    """Chunk k holds the sample frames from k * hop on; each has the header of the frame that its first sample comes from."""
    if size <= 0 or not 0 < hop <= size:
        raise ValueError("chunk size and hop must be above 0, the hop not above the size")
    rows = positions(frames).withColumn("stop", F.col("first") + _count())
    low, high = F.greatest(F.expr(f"(first - {size} + {hop}) div {hop}"), F.lit(0)), F.expr(f"(stop - 1) div {hop}")
    low = F.when(F.col("first") >= size, low).otherwise(F.lit(0))
    rows = rows.filter(low <= high).withColumn("chunk", F.explode(F.sequence(low.cast("long"), high)))
    start = F.greatest(F.col("chunk") * hop, F.col("first"))
    n = F.least(F.col("chunk") * hop + size, F.col("stop")) - start
    piece = F.slice("samples", ((start - F.col("first")) * F.col("channels") + 1).cast("int"), (n * F.col("channels")).cast("int"))
    parts = rows.filter(n > 0).select(*STREAM, "chunk", F.struct(start.alias("start"), *_HEAD, piece.alias("piece")).alias("part"))
    whole = parts.groupBy(*STREAM, "chunk").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    head = F.col("parts")[0]
    out = whole.select(*STREAM, F.col("chunk").alias("seq"), *(head[c].alias(c) for c in _HEAD), F.flatten("parts.piece").alias("samples"))
    return out.filter(F.size("samples") == size * F.col("channels"))


def _one_format(frames: DataFrame) -> DataFrame:
    """Frames of the format that their stream begins with."""
    form = F.struct("sample_rate", "channels")
    begins = F.first(form).over(Window.partitionBy(*STREAM).orderBy("seq"))
    return frames.withColumn("__form", begins).filter(form == F.col("__form")).drop("__form")


def frame_buffer(frames: DataFrame, size: int = 512) -> DataFrame:
    """Tumbling chunks by sample count; an incomplete rest is not emitted. ``seq`` counts chunks, generation and stamps are the first sample's."""
    return _chunks(_one_format(accepted(frames, ranged=False)), size, size)


def chunk_overlap(frames: DataFrame, size: int = 512, hop: int = 256) -> DataFrame:
    """Sliding chunks by sample count."""
    return _chunks(_one_format(accepted(frames)), size, hop)


def overlap_add(chunks: DataFrame, size: int = 512, hop: int = 256, kind: str = "hann") -> DataFrame:
    """Weighted synthesis, one hop for each chunk; the last size - hop sample frames stay inside.

    Repeated chunks go; a gap in seq starts anew. Stamps go on from the first
    chunk's by whole hops.
    """
    if size <= 0 or not 0 < hop <= size or kind not in ("hann", "rectangular"):
        raise ValueError("overlap parameters are out of range")
    rows = accepted(chunks).filter(F.size("samples") == size * F.col("channels")).dropDuplicates([*STREAM, "seq"])
    in_order = Window.partitionBy(*STREAM).orderBy("seq")
    rows = rows.withColumn("run", F.col("seq") - F.row_number().over(in_order))
    run = Window.partitionBy(*STREAM, "run").orderBy("seq")
    back = -(-size // hop) - 1
    near = F.collect_list(F.struct("seq", "samples")).over(run.rowsBetween(-back, 0))
    rows = rows.withColumns({"near": near, "begins": F.first("stamp_ns").over(run), "at": F.row_number().over(run) - 1})
    place = lambda x, i: (F.col("seq") - x["seq"]) * hop + F.floor(i / F.col("channels"))
    weight = lambda x, i: F.lit(1.0) if kind == "rectangular" else 0.5 - 0.5 * F.cos(2 * 3.141592653589793 * (place(x, i) + 0.5) / size)
    held = lambda i: F.filter("near", lambda x: place(x, i) < size)
    value = lambda x, i: F.get(x["samples"], (place(x, i) * F.col("channels") + i % F.col("channels")).cast("int")).cast("double")
    add = lambda a, y: a + y
    total = lambda i: F.aggregate(F.transform(held(i), lambda x: value(x, i) * weight(x, i)), F.lit(0.0), add)
    share = lambda i: F.aggregate(F.transform(held(i), lambda x: weight(x, i)), F.lit(0.0), add)
    samples = F.transform(F.sequence(F.lit(0), F.lit(hop) * F.col("channels") - 1), lambda i: (total(i) / share(i)).cast("float"))
    stamp = F.col("begins") + F.col("at") * F.floor(F.lit(hop * 1e9) / F.col("sample_rate") + 0.5).cast("long")
    # ``near`` is named twice: what is named once could be computed anew for every sample
    out = rows.filter(F.size("near") > 0).withColumn("samples", samples)
    return out.withColumn("stamp_ns", stamp).drop("near", "begins", "at", "run")


def fade(frames: DataFrame, mode: str = "fade_in", duration: int = 16000, start: int = 0) -> DataFrame:
    """Linear gain by the position in the stream."""
    if mode not in ("fade_in", "fade_out") or duration <= 0 or start < 0:
        raise ValueError("fade parameters are out of range")
    rows = positions(accepted(frames))
    share = lambda i: F.least((F.col("first") + start + F.floor(i / F.col("channels"))) / duration, F.lit(1.0))
    level = share if mode == "fade_in" else (lambda i: 1.0 - share(i))
    return rows.withColumn("samples", F.transform("samples", lambda x, i: (x.cast("double") * level(i)).cast("float"))).drop("first")


def resample_linear(frames: DataFrame, target_rate: int = 16000) -> DataFrame:
    """Linear interpolation at positions k * source rate / target rate of the whole stream, exact integer phase.

    A frame gives the outputs that lie after the last sample of the frame
    before and not after its own last one; a frame without any gives no row.
    """
    if target_rate <= 0:
        raise ValueError("the target rate must be above 0")
    in_order = Window.partitionBy(*STREAM).orderBy("seq")
    rows = positions(_one_format(accepted(frames)))
    rows = rows.withColumn("__tail", F.lag(F.expr("slice(samples, size(samples) - channels + 1, channels)")).over(in_order))
    names = [c.split()[0] for c in FRAME.split(", ")]
    kinds = arrow_schema(FRAME)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("first", "sample_rate", "channels")))
            samples, tails = batch.column("samples"), batch.column("__tail")
            flat, ends = samples.values.to_numpy(False), samples.offsets.to_numpy()
            kept, out = [], []
            for i, (first, rate, channels) in enumerate(columns):
                x = flat[ends[i] : ends[i + 1]].reshape(-1, channels)
                begin = first
                if tails[i].is_valid:
                    x, begin = np.concatenate([np.asarray(tails[i].as_py(), np.float32)[None, :], x]), first - 1
                last = begin + len(x) - 1
                k = np.arange((first - 1) * target_rate // rate + 1 if first else 0, last * target_rate // rate + 1)
                if len(k):
                    at = k * rate // target_rate
                    share = ((k * rate - at * target_rate) / float(target_rate))[:, None]
                    x = x.astype(np.float64)
                    kept.append(i)
                    out.append(((1 - share) * x[at - begin] + share * x[np.minimum(at + 1, last) - begin]).astype(np.float32).ravel())
            if kept:
                took = pa.array(kept, pa.int64())
                made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(y) for y in out])]).astype(np.int32)), pa.array(np.concatenate(out)))
                own = {"samples": made, "sample_rate": pa.array(np.full(len(kept), target_rate, np.int32))}
                yield pa.RecordBatch.from_arrays([own[c] if c in own else batch.column(c).take(took) for c in names], schema=kinds)

    return rows.select(*names, "first", "__tail").mapInArrow(run, FRAME)


def packet_loss_concealment(frames: DataFrame, max_gap: int = 3, attenuation: float = 0.7) -> DataFrame:
    """Gaps of up to ``max_gap`` frames are filled with the one before, fading; late and repeated frames go.

    Frames come in order of arrival_ns; a frame whose seq is not above all before is late.
    """
    if max_gap < 0 or not 0 < attenuation <= 1:
        raise ValueError("concealment parameters are out of range")
    arrival = Window.partitionBy(*STREAM).orderBy("arrival_ns")
    seen = F.max("seq").over(arrival.rowsBetween(Window.unboundedPreceding, -1))
    rows = accepted(frames).withColumn("seen", seen).filter("seen IS NULL OR seq > seen")
    order = Window.partitionBy(*STREAM).orderBy("seq")
    rows = rows.withColumns({"before": F.lag("samples").over(order), "gap": F.coalesce(F.col("seq") - F.col("seen") - 1, F.lit(0))})
    fill = rows.filter((F.col("gap") > 0) & (F.col("gap") <= max_gap)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("gap"))))
    fill = fill.select(*STREAM, (F.col("seen") + F.col("k")).alias("seq"), F.transform("before", lambda x: (x.cast("double") * F.pow(F.lit(attenuation), F.col("k"))).cast("float")).alias("samples"), F.lit(True).alias("concealed"))
    return rows.select(*STREAM, "seq", "samples", F.lit(False).alias("concealed")).unionByName(fill)


def range_pieces(frames: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """The parts of [start_ns, end_ns) that each frame holds, in order of ``seq``: a row a frame.

    Frames that overlap a retained one are not stored; both ends snap up to
    whole samples. ``stop_ns`` is the piece's end, ``next_ns`` the stamp of
    the frame after it (null: none within the range).
    """
    if start_ns >= end_ns:
        raise ValueError("range is empty")
    span = F.expr("size(samples) div channels * 1000000000 div sample_rate")
    rows = accepted(frames).withColumn("end_ns", F.col("stamp_ns") + span)
    order = Window.partitionBy(*STREAM).orderBy("stamp_ns", "seq")
    reach = F.max("end_ns").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = rows.withColumn("reach", reach).filter("reach IS NULL OR stamp_ns >= reach")
    hit = kept.filter((F.col("end_ns") > start_ns) & (F.col("stamp_ns") < end_ns))
    low = F.expr(f"greatest(0, ({start_ns} - stamp_ns) * sample_rate + 999999999) div 1000000000")
    high = F.expr(f"least(size(samples) div channels, (({end_ns} - stamp_ns) * sample_rate + 999999999) div 1000000000)")
    cut = hit.withColumns({"lo": low, "hi": high, "next_ns": F.lead("stamp_ns").over(order)}).filter("hi > lo")
    piece = F.slice("samples", (F.col("lo") * F.col("channels") + 1).cast("int"), ((F.col("hi") - F.col("lo")) * F.col("channels")).cast("int"))
    return cut.select(
        *STREAM, "seq", "sample_rate", "channels", F.col("stamp_ns").alias("low"), F.col("end_ns").alias("high"), "next_ns",
        F.expr("stamp_ns + lo * 1000000000 div sample_rate").alias("start_ns"), F.expr("stamp_ns + hi * 1000000000 div sample_rate").alias("stop_ns"), piece.alias("samples"),
    )


def range_status(pieces: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """source_id, stream_id, status, start_ns, stop_ns, sample_rate, channels, n_samples of each stream's pieces: full and continuous cover is ok."""
    gap = F.max((F.col("next_ns").isNotNull() & (F.col("next_ns") != F.col("high"))).cast("int"))
    whole = pieces.groupBy(*STREAM).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), gap.alias("gap"), F.min("sample_rate").alias("sample_rate"), F.min("channels").alias("channels"),
        F.min("start_ns").alias("start_ns"), F.max("stop_ns").alias("stop_ns"), F.sum(F.size("samples")).alias("n_samples"),
    )
    status = F.when((F.col("low") > start_ns) | (F.col("high") < end_ns), "range_outside_window").when(F.col("gap") == 1, "range_not_continuous").otherwise("ok")
    return whole.select(*STREAM, status.alias("status"), "start_ns", "stop_ns", "sample_rate", "channels", "n_samples")


#: Samples that one row may hold; longer ranges are for :func:`range_pieces`.
MOST_SAMPLES = 1 << 26


def range_query(frames: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """The samples of [start_ns, end_ns) of each stream in one row, or why there are none.

    A range of more than ``MOST_SAMPLES`` samples is ``range_too_long``.
    """
    pieces = range_pieces(frames, start_ns, end_ns)
    status = range_status(pieces, start_ns, end_ns)
    short = F.col("n_samples") <= MOST_SAMPLES
    status = status.withColumn("status", F.when((F.col("status") == "ok") & ~short, "range_too_long").otherwise(F.col("status")))
    good = status.filter("status = 'ok'").select(*STREAM)
    parts = pieces.join(good, list(STREAM), "left_semi").groupBy(*STREAM).agg(F.sort_array(F.collect_list(F.struct("low", "samples"))).alias("parts"))
    joined = parts.select(*STREAM, F.flatten("parts.samples").alias("samples"))
    return status.join(joined, list(STREAM), "left").select("source_id", "stream_id", "status", "samples", "sample_rate", "channels", "start_ns", "stop_ns")
