"""Bytes at the edges, codecs and the stages around models."""

import struct
import sys
import zlib

import numpy as np
import pytest

from wavelattice.functions import commands
from wavelattice.model import FRAME
from wavelattice.operators import models
from wavelattice.operators import pointwise as pw
from wavelattice.sources import codec, pcm


def run(step, rows):
    state, out = None, []
    for r in rows:
        state, made = step(state, r)
        out += made
    return out


def test_a_file_goes_through_a_gain_to_float_bytes(spark, tmp_path):
    values = [0, 8192, -8192, 16383, -16384, 1] * 10
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcm").write_bytes(struct.pack("<60h", *values))
    wire = pcm.read_pcm(spark, str(tmp_path / "in"), chunk=16, stream="in", split_frames=32, loops=2)
    rows = wire.orderBy("seq").collect()
    assert [(r.seq, r.stamp_ns, len(r.data)) for r in rows] == [(0, 0, 32), (1, 10**6, 32), (2, 2 * 10**6, 32), (3, 3 * 10**6, 24), (4, 3_750_000, 32), (5, 4_750_000, 32), (6, 5_750_000, 32), (7, 6_750_000, 24)]
    frames = pcm.from_wire(wire, stream_id="in", encoding="PCM16LE", sample_rate=16000, channels=1)
    made = pcm.write_files(pw.gain(frames, 2.0).filter("seq < 4"), f"file://{tmp_path}/out", "pcm", "FLOAT32LE").collect()
    data = (tmp_path / "out" / made[0].uri.rpartition("/")[2]).read_bytes()
    assert np.frombuffer(data, "<f4").tolist() == [v / 32768 * 2 for v in values] and made[0].n_bytes == 240
    with pytest.raises(Exception, match="FileExistsError"):
        pcm.write_files(frames, f"file://{tmp_path}/out", "pcm").collect()
    assert pcm.write_files(frames, f"file://{tmp_path}/out", "pcm", overwrite=True).first().n_bytes == 240
    (tmp_path / "in" / "b.pcm").write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole sample frames"):
        pcm.read_pcm(spark, str(tmp_path / "in")).count()


def test_wave_files_of_streams(spark, tmp_path):
    frames = spark.createDataFrame([("a/b", "m", k, 0, 0, 0, 8000, 2, [0.5, -0.5]) for k in (1, 0)] + [("a/b", "m", 2, 0, 0, 0, 8000, 1, [0.1])], FRAME)
    for encoding, size in (("PCM16LE", 2), ("FLOAT32LE", 4)):
        made = pcm.write_files(frames, f"file://{tmp_path}/{encoding}", "wav", encoding).first()
        data = open(made.uri.removeprefix("file://"), "rb").read()
        x, rate, channels = pcm.read_wav(data)
        assert (rate, channels, len(data)) == (8000, 2, 44 + 4 * size) and x == pytest.approx([0.5, -0.5, 0.5, -0.5], abs=1e-4)
        assert struct.unpack_from("<HH", data, 20) == (3 if size == 4 else 1, 2)
    assert bytes(pcm.record_wav(frames).first().wav)[44:] == struct.pack("<4h", 16384, -16384, 16384, -16384)


def test_wire_frames_are_checked(spark):
    def one(seq, **more):
        base = dict(source_id="s", stream_id="m", seq=seq, generation=0, stamp_ns=0, arrival_ns=0, sample_rate=16000, channels=2, encoding="PCM16LE", bit_depth=16, layout="planar", data=bytearray(struct.pack("<4h", 1, 2, 3, 4)))
        return tuple({**base, **more}.values())

    wire = spark.createDataFrame([one(0), one(1, source_id=""), one(2, encoding="MP3"), one(3, bit_depth=24), one(4, data=bytearray()), one(5, data=bytearray(b"abc")), one(6, sample_rate=8000)], pcm.WIRE)
    assert {r.seq: r.reason for r in pcm.refused(wire, sample_rate=16000).collect()} == {1: "identity is missing", 2: "format is not known", 3: "format is not known", 4: "empty", 5: "not frame aligned", 6: "sample_rate differs"}
    frame = pcm.from_wire(wire, sample_rate=16000).first()
    assert [v * 32768 for v in frame.samples] == [1, 3, 2, 4]  # planar bytes, interleaved samples
    assert bytes(pcm.to_wire(pcm.from_wire(wire, sample_rate=16000), "PCM32LE", "planar").first().data) == struct.pack("<4i", *(min(round(v / 32768 * (2**31 - 1)), 2**31 - 1) for v in (1, 2, 3, 4)))


def test_codecs_number_chunks(spark):
    frames = spark.createDataFrame([("s", "m", k, k // 2, 10 * k, 0, 16000, 1, [0.25] * 16) for k in range(4)], FRAME)
    chunks = codec.encode_frames(frames, "z", zlib.compress)
    assert [(r.sequence, r.media_time_ns, r.duration_ns) for r in chunks.orderBy("seq").collect()] == [(0, 0, 10**6), (1, 10**6, 10**6)] * 2
    assert codec.decode_chunks(chunks, "z", zlib.decompress).first().samples == [0.25] * 16
    assert codec.encode_frames(frames, "none", lambda data: b"").count() == 0
    cat = codec.command([sys.executable, "-c", "import sys; sys.stdout.buffer.write(sys.stdin.buffer.read())"])
    assert cat(b"abc") == b"abc"
    with pytest.raises(RuntimeError):
        codec.command([sys.executable, "-c", "raise SystemExit(3)"])(b"")
    with pytest.raises(RuntimeError):
        codec.command([sys.executable, "-c", "print('x' * 99)"], most_bytes=9)(b"")


def heard():
    return lambda state, x, last: ((state or 0) + len(x), f" {((state or 0) + len(x)) // 4} ")


def test_recognition_buffers_by_samples():
    step = models.asr_stream(heard, chunk=4, right=2, pre_roll_ms=3, sample_rate=1000)
    audio = lambda k, n: {"source_id": "s", "seq": k, "event": "audio", "samples": [0.1] * n, "session_id": None, "user_turn_id": None}
    event = lambda k, e: {"source_id": "s", "seq": k, "event": e, "samples": None, "session_id": "x", "user_turn_id": 7}
    out = run(step, [audio(0, 9), event(1, "start"), audio(2, 2), audio(3, 1), audio(4, 4), audio(5, 1), event(6, "stop"), audio(7, 2), event(8, "start"), event(9, "cancel")])
    # three samples from before the start; the first step takes 6, the next 4, the stop what is left
    assert [(o["seq"], o["text"], o["is_final"], o["accepted_samples"]) for o in out] == [(3, " 1 ", False, 6), (4, " 2 ", False, 10), (6, " 2 ", True, 11)]
    assert {(o["session_id"], o["user_turn_id"]) for o in out} == {("x", 7)}


def loudness():
    return lambda x: float(np.abs(x).max())


def test_turn_detector_answers_the_active_turn():
    step = models.turn_detector(loudness, min_samples=2, max_samples=3, threshold=0.3)
    base = {"source_id": "s", "session_id": "x", "user_turn_id": 1, "request_id": 5, "active": True, "samples": None}
    rows = [("audio", {"samples": [0.9] * 9}), ("context", {}), ("request", {}), ("audio", {"samples": [0.9, 0.1, 0.2, 0.4]}), ("request", {}), ("request", {"user_turn_id": 2}), ("request", {"request_id": 0}), ("context", {"user_turn_id": 2}), ("request", {"user_turn_id": 2}), ("context", {"active": False}), ("request", {})]
    out = run(step, [{**base, "seq": k, "event": e, **more} for k, (e, more) in enumerate(rows)])
    assert [(o["seq"], o["request_id"], round(o["probability"], 3), o["is_end"], o["n_samples"]) for o in out] == [(4, 5, 0.4, True, 3)]


def test_voice_windows_cross_frames():
    out = run(models.vad_windows(loudness, 4), [{"source_id": "s", "samples": x} for x in ([0.1, 0.2, 0.3], [float("nan")], [0.4, 0.5], [2.0, 0.1, 0.1])])
    assert [(o["start_sample"], o["end_sample"], round(o["probability"], 3)) for o in out] == [(0, 4, 0.4), (4, 8, 1.0)]


def test_embeddings_have_their_dimension(spark):
    frames = spark.createDataFrame([("s", "m", 0, 0, 0, 0, 16000, 1, [0.1])], FRAME)
    short = lambda: (lambda x, rate: [1.0])
    assert models.embeddings(frames, short, "m1", 1).first().embedding == [1.0]
    with pytest.raises(Exception, match="must be 2 finite numbers"):
        models.embeddings(frames, short, "m1", 2).collect()


def test_commands_take_what_follows(spark):
    texts = ["start", "\tSTOP now please ", "status x", "mode Dictation", "mode a b", "mode", "go", "", None, "\u3000start"]
    rows = commands.route(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert [(r.action, r.mode) for r in rows] == [("start", None), ("stop", None), ("status", None), ("mode", "dictation"), (None, None), (None, None), (None, None), (None, None), (None, None), ("start", None)]


def test_a_growing_file_is_a_stream(spark, tmp_path):
    from wavelattice.sources.live import PcmFrames, drain

    spark.dataSource.register(PcmFrames)
    path = tmp_path / "x.pcm"
    values = [k * 100 for k in range(10)]
    path.write_bytes(struct.pack("<5h", *values[:5]))

    def go():
        wire = spark.readStream.format("pcm_frames").options(path=str(path), chunk=2, most=2).load()
        query = drain(pw.gain(pcm.from_wire(wire), 2.0), f"file://{tmp_path}/out", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        files = sorted((tmp_path / "out").glob("batch-*/*.pcm"))
        return [v for f in files for v in np.frombuffer(f.read_bytes(), "<f4").tolist()]

    assert go() == [v / 32768 * 2 for v in values[:4]]  # the fifth sample waits for its chunk
    path.write_bytes(struct.pack("<10h", *values))
    assert go() == [v / 32768 * 2 for v in values]
    rows = spark.read.format("pcm_frames").options(path=str(path), chunk=4).load().orderBy("seq").collect()
    assert [(r.seq, r.stamp_ns, len(r.data)) for r in rows] == [(0, 0, 8), (1, 250_000, 8), (2, 500_000, 4)]
    path.write_bytes(b"abc")
    with pytest.raises(Exception, match="not whole sample frames"):
        spark.read.format("pcm_frames").options(path=str(path)).load().count()


def test_recordings_start_and_stop(spark):
    frames = spark.createDataFrame([("s", "m", k, 0, 0, k, 16000, 1, [k / 10]) for k in range(9)], FRAME)
    controls = spark.createDataFrame([("s", 0, "stop"), ("s", 1, "start"), ("s", 2, "start"), ("s", 4, "stop"), ("s", 5, "start"), ("s", 6, "other"), ("t", 0, "start")], "source_id string, arrival_ns long, action string")
    rows = pcm.recorded(frames, controls).orderBy("seq").collect()
    assert [(r.seq, r.stream_id) for r in rows] == [(2, "m-1"), (3, "m-1"), (4, "m-1"), (6, "m-2"), (7, "m-2"), (8, "m-2")]


def test_streams_are_piped_in_order(spark, tmp_path):
    frames = spark.createDataFrame([("s", "m", k, 0, 0, 0, 16000, 1, [k / 32767]) for k in (2, 0, 1)], FRAME)
    code = f"import sys; open({str(tmp_path / 'got')!r}, 'wb').write(sys.stdin.buffer.read())"
    assert [tuple(r) for r in pcm.pipe(frames, [sys.executable, "-c", code]).collect()] == [("s", "m", 6, 0)]
    assert (tmp_path / "got").read_bytes() == struct.pack("<3h", 0, 1, 2)
    odd = frames.unionByName(spark.createDataFrame([("s", "m", 3, 0, 0, 0, 8000, 1, [0.0])], FRAME))
    with pytest.raises(Exception, match="changes from"):
        pcm.pipe(odd, ["cat"]).collect()
    with pytest.raises(Exception, match="ended with 3"):
        pcm.pipe(frames, [sys.executable, "-c", "import sys; sys.stdin.read(); raise SystemExit(3)"]).collect()


def growing():
    return lambda state, x: ((state or 0) + len(x), ("hey" if (state or 0) + len(x) < 9 else " ", 0.1 * ((state or 0) + len(x))))


def test_keywords_start_anew_and_cool_down():
    rows = [{"source_id": "s", "seq": k, "arrival_ns": k * 10**6, "segment": 1 + (k > 4), "opened": k in (0, 5), "closed": k == 4, "samples": None if k == 4 else [0.0, 0.0]} for k in range(9)]
    out = run(models.keyword(growing, 0.35, 3.0), rows)
    # sums 2, 4 (0.4: a hit), 6 and 8 (too soon); anew: 2, 4 (a hit), 6, 8 (too soon)
    assert [(o["seq"], o["segment"], round(o["score"], 1)) for o in out] == [(1, 1, 0.4), (6, 2, 0.4)]
