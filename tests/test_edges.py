"""Clips, their files, and the acknowledgement tone."""

import hashlib
import json
import math

import pytest

from wavelattice.functions.tones import wake_tone
from wavelattice.model import FRAME
from wavelattice.sources import clips, pcm


def frames(spark, stamps, source="mic a"):
    return spark.createDataFrame([(source, "s", k, 0, t, t, 1000, 1, [0.5, -0.5, 0.25, 0.0]) for k, t in enumerate(stamps)], FRAME)


def test_fnv_of_known_texts():
    assert clips.fnv64("") == "cbf29ce484222325" and clips.fnv64("a") == "af63dc4c8601ec8c"


def test_archived_clip_is_published_once(spark, tmp_path):
    found = clips.clips(frames(spark, [0, 4_000_000]), 2_000_000, 6_000_000, "archive", reason="kept")
    row = found.collect()[0]
    assert row.clip_id.startswith("archive_audio_window_window_epoch0_mic_a_audio_2000000_6000000_")
    assert (row.status, row.duration_ns, row.wav) == ("ok", 4_000_000, bytearray(pcm.wav_bytes([0.25, 0.0, 0.5, -0.5], 1000)))
    assert json.loads(row.metadata)["audio_clip_ref"]["clip_id"] == row.clip_id
    for _ in range(2):  # a repeated task finds its own file
        done = clips.publish(found, f"file://{tmp_path}").collect()[0]
    file = tmp_path / f"{row.clip_id}.wav"
    assert hashlib.sha256(file.read_bytes()).hexdigest() == done.content_sha256 == row.content_sha256
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == [file.name, f"{file.name}.metadata.json"]
    file.write_bytes(b"other")
    with pytest.raises(Exception, match="FileExistsError"):
        clips.publish(found, f"file://{tmp_path}").collect()
    assert file.read_bytes() == b"other"


def test_uncovered_range_has_no_clip(spark):
    row = clips.clips(frames(spark, [0, 8_000_000]), 2_000_000, 10_000_000).collect()[0]
    assert row.status == "range_not_continuous" and row.clip_id is None and row.wav is None
    with pytest.raises(ValueError):
        clips.clips(frames(spark, [0]), 0, 1, "archive")


def test_raw_pcm_is_read_in_chunks(spark, tmp_path):
    (tmp_path / "x.pcm").write_bytes(pcm.wav_bytes([0.5, -0.5, 0.25, 0.0, -1.0], 16000)[44:])
    rows = pcm.from_wire(pcm.read_pcm(spark, f"{tmp_path}/*.pcm", chunk=2)).orderBy("seq").collect()
    assert [r.stamp_ns for r in rows] == [0, 125_000, 250_000] and list(rows[2].samples) == [-1.0]


def test_wake_tone_phase_is_the_running_sum(spark):
    rows = wake_tone(spark).orderBy("i").collect()
    low = high = 0.0
    assert len(rows) == 12480 and rows[0].pcm == 0
    for r in rows:
        t = r.i / 48000
        p = t / 0.26
        lift = p * p * (3 - 2 * p)
        low += 2 * math.pi * (660 + 260 * lift) / 48000
        high += 2 * math.pi * (1320 + 91 * lift) / 48000
        f = min(1.0, t / 0.034, (0.26 - t) / 0.034)
        assert math.isclose(r.v, (0.78 * math.sin(low) + 0.22 * math.sin(high)) * f * f * (3 - 2 * f) * (1 - 0.28 * lift) * 0.18, abs_tol=1e-9)
