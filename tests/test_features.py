"""Features of signals whose answer is known beforehand."""

import numpy as np
import pytest

from wavelattice.model import FRAME
from wavelattice.operators import features, resample


def frame(spark, *signals):
    return spark.createDataFrame([("s", "m", k, 0, 0, 0, 16000, 1, [float(v) for v in x]) for k, x in enumerate(signals)], FRAME)


def test_tempo_of_two_beats_a_second(spark):
    x = np.zeros(16400)
    for at in range(400, 16400, 8000):
        x[at : at + 80] = np.hanning(80)
    found = features.tempo(frame(spark, x, np.zeros(400))).orderBy("seq").collect()
    assert found[0].detected and found[0].bpm == pytest.approx(120.0, abs=1.0) and sum(found[0].beats) >= 2
    first = found[0].beats.index(True)
    assert [k for k, b in enumerate(found[0].beats) if b] == list(range(first, 101, 50))
    assert (found[1].bpm, found[1].confidence, found[1].detected, found[1].beats) == (0.0, 0.0, False, [False])
    with pytest.raises(ValueError):
        features.tempo(frame(spark, x), bpm_max=1e6)


def test_tempo_stays_inside_the_asked_range(spark):
    # a period of 50 parts is 120 a minute; from 121 to 180 lags 33.3 to 49.6 are searched: 34 to 49
    x = np.zeros(16400)
    x[400::8000] = 0.9
    found = features.tempo(frame(spark, x), bpm_min=121.0, threshold=0.0).first()
    assert 6000 / 49 <= found.bpm <= 6000 / 34


def test_pitch_of_a_sine(spark):
    t = np.arange(1520) / 16000
    rows = features.pitch(frame(spark, 0.4 * np.sin(2 * np.pi * 200 * t), np.zeros(400))).orderBy("seq", "frame").collect()
    assert len(rows) == 9 and all(abs(r.f0 - 200) <= 5 and r.voiced and 0 < r.confidence <= 1 for r in rows[:8])
    assert (rows[8].f0, rows[8].confidence, rows[8].voiced) == (0.0, 0.0, False)
    weak = features.pitch(frame(spark, 0.4 * np.sin(2 * np.pi * 200 * t)), threshold=1.0).collect()
    assert all(not r.voiced and r.f0 > 0 for r in weak)  # the frequency is given all the same


def test_onsets_keep_more_than_their_interval(spark):
    x = np.zeros(880)
    x[420:520] = np.hanning(100)
    assert sum(r.onset for r in features.onset(frame(spark, x)).collect()) == 1
    # equal strengths side by side are both peaks; an interval of one part lets every other one pass
    x = np.zeros(20)
    x[::2] = 0.5
    rows = features.onset(frame(spark, x), 2, 2, 0.1, 2 / 16000).orderBy("frame").collect()
    assert [r.onset for r in rows] == [k == 0 for k in range(10)] or sum(r.onset for r in rows) <= 5
    steps = features.onset(frame(spark, np.concatenate([np.full(4, v) for v in (0.0, 0.5, 0.0, 0.5, 0.0, 0.5)])), 4, 4, 0.1, 8 / 16000).orderBy("frame").collect()
    assert [r.frame for r in steps if r.onset] == [1, 5]  # frame 3 is two parts after, not more than two


def test_cqt_of_its_lowest_bin(spark):
    t = np.arange(5120) / 16000
    rows = features.cqt(frame(spark, 0.4 * np.sin(2 * np.pi * 130.8128 * t))).collect()
    assert len(rows) == 3 and all(np.argmax(np.hypot(r.re, r.im)) <= 1 for r in rows)
    with pytest.raises(ValueError):
        features.cqt(frame(spark, t), frame_length=512, hop=512)
    # one kernel by hand: its window reaches over ceil(q rate / f) samples in the middle of the frame
    n = int(np.ceil(16000 / (2 ** (1 / 12) - 1) / 5000.0))
    w, x = np.hanning(n), np.random.default_rng(1).uniform(-0.5, 0.5, 64).astype(np.float32)
    at = (64 - n) // 2
    want = (x[at : at + n] * w * np.exp(2j * np.pi * 5000 * np.arange(n) / 16000)).sum() / np.sqrt((w * w).sum())
    got = features.cqt(frame(spark, x), 64, 64, 1, 12, 5000.0).first()
    assert (got.re[0], got.im[0]) == pytest.approx((want.real, want.imag), abs=1e-6)


def test_mels_have_every_part(spark):
    x = 0.1 * np.sin(np.arange(64))
    assert features.smart_turn_mel(frame(spark, x), 32, 16, 8).count() == 5  # (64 + 32 - 32) / 16 + 1
    top = [max(r.mel) for r in features.smart_turn_mel(frame(spark, x), 32, 16, 8).collect()]
    low = [min(r.mel) for r in features.smart_turn_mel(frame(spark, x), 32, 16, 8).collect()]
    assert max(top) - min(low) <= 2.0 + 1e-6  # eight below the top, a quarter of it
    assert features.log_mel(frame(spark, np.zeros(400))).first().mel == pytest.approx([np.log(1e-10)] * 80)
    assert features.stft(frame(spark, x), 32, 16, "rectangular").count() == 3 and features.stft(frame(spark, x[:50]), 32, 16).count() == 0


@pytest.mark.parametrize("rate, target", [(48000, 16000), (16000, 48000), (44100, 16000)])
def test_band_limited_resampling_keeps_the_passband(rate, target):
    t = np.arange(rate // 4) / rate
    x = (0.5 * np.sin(2 * np.pi * 1000 * t)).astype(np.float32)
    step, state, out = resample.sinc_step(target, 48), None, []
    for k in range(0, len(x), 480):
        state, made = step(state, {"source_id": "s", "seq": k // 480, "sample_rate": rate, "channels": 1, "samples": x[k : k + 480]})
        out += [m["samples"] for m in made]
    y = np.concatenate(out)
    want = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(len(y)) / target)
    inner = slice(target // 50, None)  # past the silence before the stream
    noise = y[inner] - want[inner]
    assert 10 * np.log10((want[inner] ** 2).mean() / (noise**2).mean()) > 120
    whole = resample.sinc_step(target, 48)(None, {"source_id": "s", "seq": 0, "sample_rate": rate, "channels": 1, "samples": x})[1][0]["samples"]
    assert np.abs(whole - y).max() < 1e-6 and abs(len(y) - len(x) * target // rate) <= 2 * 48 * max(1, target / rate) + 1


def test_band_limited_resampling_removes_what_the_target_can_not_hold():
    t = np.arange(48000) / 48000
    row = {"source_id": "s", "seq": 0, "sample_rate": 48000, "channels": 2, "samples": np.stack([0.5 * np.sin(2 * np.pi * 13000 * t), np.full(48000, 0.25)], 1).ravel()}
    y = resample.sinc_step(16000, 48)(None, row)[1][0]["samples"].reshape(-1, 2)[400:]
    assert np.abs(y[:, 0]).max() < 1e-5 and np.abs(y[:, 1] - 0.25).max() < 1e-6
