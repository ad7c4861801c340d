import math

import pytest

from wavelattice.model import FRAME, accepted, rejects
from wavelattice.operators import pointwise as pw

F32 = 1e-6


def frames(spark, *rows, channels=1, stamp=0):
    return spark.createDataFrame([("s", "m", k, 0, stamp, stamp, 16000, channels, list(r) if r is not None else None) for k, r in enumerate(rows)], FRAME)


def out(df):
    return [list(r.samples) for r in df.orderBy("seq").collect()]


def test_contract_and_rejects(spark):
    df = frames(spark, [0.5, -0.5], [float("nan")], [1.25], [], None, [float("inf")])
    assert [r.seq for r in accepted(df).collect()] == [0]
    assert {r.seq: r.reason for r in rejects(df, "gain").collect()} == {1: "not finite", 2: "out of range", 3: "empty", 4: "empty", 5: "not finite"}


def test_dynamics_by_hand(spark):
    df = frames(spark, [0.75, -0.75, 0.25])
    assert out(pw.compressor(df, 0.5, 4.0)) == [pytest.approx([0.5625, -0.5625, 0.25])]
    assert out(pw.compressor(df, 0.5, 2.0, 1.5)) == [pytest.approx([0.9375, -0.9375, 0.375])]
    assert out(pw.gain(df, 2.0)) == []
    assert out(pw.limiter(df, 0.5)) == [[0.5, -0.5, 0.25]]
    assert out(pw.noise_gate(df, 0.5)) == [[0.75, -0.75, 0.0]]
    assert out(pw.normalize(df)) == [pytest.approx([0.9, -0.9, 0.3], abs=F32)]
    assert out(pw.normalize(frames(spark, [0.0, 0.0]))) == [[0.0, 0.0]]
    with pytest.raises(ValueError):
        pw.compressor(df, 1.5)


def test_shapes_and_channels(spark):
    df = frames(spark, [0.1, 0.2, 0.3, 0.4], channels=2)
    assert out(pw.interleave(df)) == [pytest.approx([0.1, 0.3, 0.2, 0.4])]
    assert out(pw.interleave(pw.interleave(df), "interleaved")) == [pytest.approx([0.1, 0.2, 0.3, 0.4])]
    assert out(pw.downmix(df, "average_to_mono")) == [pytest.approx([0.15, 0.35])]
    assert out(pw.stereo_widening(df, 1.0)) == [pytest.approx([0.1, 0.2, 0.3, 0.4])]
    assert out(pw.pan(df, 0.0)) == [pytest.approx([x * math.sqrt(0.5) for x in (0.1, 0.2, 0.3, 0.4)])]
    assert out(pw.beamforming(df, [1.0, 0.0])) == [pytest.approx([0.1, 0.3])]
    assert out(pw.dc_offset_removal(df)) == [pytest.approx([-0.1, -0.1, 0.1, 0.1])]
    assert out(pw.trim(df, 1, 0)) == [pytest.approx([0.3, 0.4])]


def test_pcm_rounds_half_away_from_zero(spark):
    df = pw.to_pcm16(frames(spark, [1.0, -1.0, 0.5, -0.5 / 32768]))
    assert df.first().pcm == [32767, -32768, 16384, -1]


def test_declick_replaces_single_leaps(spark):
    assert out(pw.declick(frames(spark, [0.0, 0.9, 0.1, 0.1]))) == [pytest.approx([0.0, 0.05, 0.1, 0.1])]
    assert out(pw.declick(frames(spark, [0.0, 0.9, 0.9, 0.1]))) == [pytest.approx([0.0, 0.9, 0.9, 0.1])]
    assert out(pw.declick(frames(spark, [0.0, 0.9, 0.9, 0.1]), max_samples=2)) == [pytest.approx([0.0, 0.05, 0.05, 0.1])]


def test_time(spark):
    df = frames(spark, [0.1], stamp=21_000_000)
    assert pw.time_alignment(df).first().stamp_ns == 20_000_000
    assert pw.time_alignment(frames(spark, [0.1], stamp=25_000_000)).count() == 0
    assert pw.latency_compensation(df, -30.0).count() == 0
