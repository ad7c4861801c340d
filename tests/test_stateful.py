import numpy as np
import pytest

from wavelattice.functions.timerange import parse_range
from wavelattice.model import FRAME, frames_events, refused_by
from wavelattice.operators import filters as fl
from wavelattice.operators import pointwise as pw
from wavelattice.operators import stateful as st
from wavelattice.operators import timeline
from wavelattice.operators.filters import run_filters
from wavelattice.plans.graph import Node, build, check
from wavelattice.sources.pcm import wav_bytes
from wavelattice.streaming.live import chunk_step

SF = "/root/testdata/sf0.001"


def row(seq, samples, **more):
    return {"source_id": "s", "stream_id": "m", "seq": seq, "generation": 0, "stamp_ns": seq * 10**6, "arrival_ns": seq * 10**6, "sample_rate": 16000, "channels": 1, "samples": samples, **more}


def run(step, rows):
    state, out = None, []
    for r in rows:
        state, made = step(state, r)
        out += made
    return out


def joined(out):
    return np.concatenate([o["samples"] for o in out])


FILTERS = [fl.low_pass(), fl.band_pass(), fl.notch(), fl.eq(low_db=-3.0), fl.deesser(), fl.echo(1.0), fl.reverb(), fl.hum(), fl.high_pass(), fl.delay(5)]


@pytest.mark.parametrize("step", FILTERS)
def test_filters_do_not_depend_on_how_a_stream_is_cut(step):
    x = np.random.default_rng(1).uniform(-0.3, 0.3, 64)
    whole = joined(run(step, [row(0, x)]))
    parts = joined(run(step, [row(k, x[16 * k : 16 * k + 16]) for k in range(4)]))
    assert np.allclose(whole, parts, atol=1e-6)


@pytest.mark.parametrize("step", FILTERS)
def test_streams_side_by_side_equal_streams_alone(spark, step):
    rng = np.random.default_rng(3)
    rows = []
    for source in range(9):
        channels = 1 + source % 2
        for seq in range(source % 4, 7):
            x = rng.uniform(-0.4, 0.4, channels * (8 if seq % 3 else 6)).astype(np.float32)
            if source == 5 and seq == 4:
                x[0] = np.nan
            rows.append((f"s{source // 2}", f"m{source % 2}", seq + (seq > 4 and source == 3), seq // 5, 0, 0, 16000, channels, x.tolist()))
    found = {(r.source_id, r.stream_id, r.seq): r.samples for r in run_filters(spark.createDataFrame(rows, FRAME), step).collect()}
    names = [c.split()[0] for c in FRAME.split(", ")]
    want = {}
    for stream in {r[:2] for r in rows}:
        for o in run(step, [dict(zip(names, r)) for r in rows if r[:2] == stream]):
            want[(*stream, o["seq"])] = o["samples"].tolist()
    assert found == want


def test_a_rejected_frame_changes_nothing():
    good = [row(0, [0.1, 0.2]), row(1, [0.3, 0.1])]
    bad = row(1, [0.3, 2.0])
    assert np.array_equal(joined(run(fl.low_pass(), good)), joined(run(fl.low_pass(), [good[0], bad, good[1]])))


def test_low_pass_starts_anew_after_a_gap_and_drops_old():
    out = run(fl.low_pass(), [row(0, [0.5]), row(2, [0.1]), row(1, [0.9])])
    assert [o["seq"] for o in out] == [0, 2] and out[1]["samples"][0] == np.float32(0.1)


def test_reverb_by_hand():
    # at 100 a second the lines are 3, 4, 4 and 4 samples; without room the feedback is 0.2, so 0.8 of the input goes in
    step = fl.reverb(room=0.0, damping=0.0, wet=0.5, dry=0.5)
    out = joined(run(step, [row(0, [1.0, 0.0, 0.0, 0.0, 0.0], sample_rate=100)]))
    assert out.tolist() == [0.5, 0.0, 0.0, np.float32(0.5 * 0.8 / 4), np.float32(0.5 * 3 * np.float64(np.float32(0.8)) / 4)]
    stereo = joined(run(step, [row(0, [1.0, -1.0, 0, 0, 0, 0, 0, 0], sample_rate=100, channels=2)]))
    assert stereo.tolist() == [0.5, -0.5, 0, 0, 0, 0, np.float32(0.1), np.float32(-0.1)]


def test_echo_refuses_what_its_line_can_not_hold():
    step = fl.echo(1000 / 16000, feedback=0.9, wet=0.0, dry=0.1)
    out = run(step, [row(0, [0.99]), row(1, [0.99]), row(2, [0.05])])
    assert [o["seq"] for o in out] == [0, 2]  # 0.99 + 0.9 * 0.99 leaves [-1, 1]; the line keeps 0.99
    assert run(fl.echo(1.0, feedback=0.5, wet=0.5, dry=0.0), [row(0, [0.5] + [0.0] * 16)])[0]["samples"][16] == np.float32(0.25)


def test_ranges_that_only_some_filters_ask_for():
    loud = [row(0, [0.0, 3.0])]
    assert [len(run(step, loud)) for step in (fl.high_pass(), fl.notch(), fl.low_pass(), fl.hum())] == [1, 1, 0, 0]
    assert run(fl.notch(), [row(0, [float("nan")])]) == []


def test_jitter_reorders_and_holds():
    out = run(st.jitter_buffer(2), [row(s, [0.0]) for s in (0, 2, 1, 1, 3, 0, 4)])
    assert [o["seq"] for o in out] == [0, 1, 2]
    # the last one released is a repeat even where older ones reset; a reset forgets what is held
    out = run(st.jitter_buffer(1, 3, reset_on_regression=True), [row(s, [0.0]) for s in (5, 6, 5, 3, 4, 9)])
    assert [o["seq"] for o in out] == [5, 3, 4]
    with pytest.raises(ValueError):
        st.jitter_buffer(3, 3)


def window(k, p):
    return row(k, [], probability=p, start_sample=512 * k, end_sample=512 * k + 512)


def test_vad_starts_and_ends():
    step = st.vad_estimator(end_windows=2, min_speech_ms=0)
    out = run(step, [window(k, p) for k, p in enumerate([0.05, 0.6, 0.7, 0.68, 0.22, 0.08])])
    assert [o["seq"] for o in out if o["started"]] == [2] and [o["seq"] for o in out if o["ended"]] == [5]
    # a first window may be the rise itself, the average begins at 0, speech counts from the window that confirms it
    out = run(st.vad_estimator(0.9, 0.3, smoothing=0.25, start_windows=1, end_windows=1, min_speech_ms=64), [window(k, p) for k, p in enumerate([0.4, 0.1, 0.1, 1.7])])
    assert [(o["started"], o["ended"]) for o in out] == [(True, False), (False, True), (False, False), (True, False)]
    assert [o["smoothed"] for o in out] == pytest.approx([0.1, 0.1, 0.1, 0.325])
    with pytest.raises(ValueError):
        st.vad_estimator(0.2, 0.5)


def test_gate_holds_back_silence_and_merges():
    step = st.stream_gate(pre_roll_ms=2, hangover_ms=2, merge_gap_ms=2, sample_rate=1000)
    active = {3, 7, 12}
    out = run(step, [{"source_id": "s", "seq": k, "active": k in active, "arrival_ns": k * 10**6, "samples": [k / 100]} for k in range(18)])
    said = [(o["seq"], o["segment"], None if o["samples"] is None else [round(float(v) * 100) for v in o["samples"]]) for o in out]
    # pre-roll 1, 2; hangover 4, 5; 6 is held back; 7 goes on; 8, 9; 10, 11 held back; 12 goes on within the gap; closed at 17
    assert said == [(3, 1, [1, 2, 3]), (4, 1, [4]), (5, 1, [5]), (7, 1, [7]), (8, 1, [8]), (9, 1, [9]), (12, 2, [10, 11, 12]), (13, 2, [13]), (14, 2, [14]), (17, 2, None)] or said == [(3, 1, [1, 2, 3]), (4, 1, [4]), (5, 1, [5]), (7, 1, [7]), (8, 1, [8]), (9, 1, [9]), (12, 1, [12]), (13, 1, [13]), (14, 1, [14]), (17, 1, None)]
    assert [o["seq"] for o in out if o["merged"]] == [7] + [12] * (said[6][1] == 1) and [o["closed"] for o in out][-1]


def turn(*events):
    base = {"source_id": "s", "keyword": "hey", "stamp_ms": 0, "session_id": "session-1", "user_turn_id": 1, "request_id": 1, "probability": 0.0}
    return [(o["now_ms"], o["kind"], o["reason"]) for o in run(st.dialogue(), [{**base, "now_ms": t, "event": e, **more} for t, e, *m in events for more in [m[0] if m else {}]])]


def test_dialogue_acts_on_ticks_alone():
    out = turn((0, "wake"), (100, "speech"), (200, "quiet"), (1500, "tick"), (3600, "quiet"), (5000, "tick"), (5001, "tick"))
    assert out[3:] == [(1500, "ignored", "waiting_for_end"), (3600, "ignored", "quiet_continues"), (5000, "accepted", "turn_end_requested"), (5001, "ended", "quiet_fallback")]
    assert turn((0, "wake"), (7000, "quiet"), (7001, "tick"))[1:] == [(7000, "ignored", "waiting_for_speech"), (7001, "ended", "no_speech_timeout")]
    assert turn((0, "wake"), (29999, "speech"), (30000, "tick"))[-1][2] == "max_active_timeout"


def test_dialogue_checks_candidates():
    asked = [(0, "wake"), (2000, "speech"), (2100, "quiet"), (3300, "tick")]
    assert turn(*asked, (3400, "candidate", {"probability": 0.8}))[-1] == (3400, "ended", "td_end")
    weak = turn(*asked, (3400, "candidate", {"probability": 0.5}), (3500, "candidate", {"probability": 0.9}), (5599, "tick"), (5600, "tick"))
    assert [r for _, _, r in weak[4:]] == ["td_not_end", "no_pending_td_request", "waiting_for_end", "quiet_fallback"]
    assert turn(*asked, (3400, "candidate", {"request_id": 2}))[-1][2] == "td_request_mismatch"
    assert turn(*asked, (3400, "candidate", {"session_id": "x"}))[-1][2] == "session_mismatch"
    assert turn(*asked, (3400, "speech"), (3450, "candidate", {"probability": 0.9}), (3500, "tick"))[-2:] == [(3450, "ignored", "no_pending_td_request"), (3500, "ignored", "speech_active")]
    assert turn((5000, "wake", {"stamp_ms": 3000}), (5000, "wake", {"stamp_ms": 6000}), (5000, "wake", {"keyword": " "}), (5000, "wake"), (5001, "wake")) == [(5000, "rejected", "stale_stamp"), (5000, "rejected", "future_stamp"), (5000, "ignored", "empty_keyword"), (5000, "accepted", "wake"), (5001, "ignored", "turn_active")]


def test_drift_never_takes_back_a_whole_frame():
    step = st.clock_drift(alpha=1.0, max_correction_ms=50.0, reset_ms=1000.0)
    rows = [row(0, [0.0] * 16), {**row(1, [0.0] * 16), "stamp_ns": -20_000_000 + 10**6}]
    out = run(step, [{**r, "stamp_ns": r["stamp_ns"] + 10**9} for r in rows])
    assert [o["stamp_ns"] for o in out] == [10**9, 10**9 + 1]  # one nanosecond after the frame before


def test_ducking_measures_frames_and_nanoseconds(spark):
    from wavelattice.operators import asof

    side = spark.createDataFrame([("s", "d", 0, 0, 0, 0, 16000, 2, [0.5] * 4)], FRAME)
    program = spark.createDataFrame([("s", "m", k, 0, 0, t, 16000, 2, [0.5] * 320) for k, t in enumerate((100_000_000, 100_900_000))], FRAME)
    rows = [r.asDict() for r in asof.sidechain_level(program, side).orderBy("seq").collect()]
    assert [r["level"] for r in rows] == [0.5, None]
    low = 10 ** (-12 / 20)
    first = 1 + (1 - np.exp(-160 / 16000 / 0.01)) * (low - 1)
    second = first + (1 - np.exp(-160 / 16000 / 0.25)) * (1 - first)
    out = run(st.ducking(), rows)
    assert [o["samples"][0] for o in out] == pytest.approx([0.5 * first, 0.5 * second], rel=1e-6)


def test_playback_refuses_stale_and_fails_on_overflow():
    events = [("frame", 0), ("pause", 0), ("done", 0), ("stop", 0), ("frame", 0), ("frame", 1), ("frame", 1), ("frame", 1), ("resume", 1)]
    out = run(st.playback(2), [{"source_id": "s", "seq": k, "event": e, "epoch": p} for k, (e, p) in enumerate(events)])
    assert [o["message"] for o in out] == ["ok", "playback paused", "paused", "playback stopped", "stale epoch", "ok", "ok", "queue overflow", "failed closed"]
    assert [o["epoch"] for o in out][-1] == 1 and not out[-1]["accepted"]


def test_delay_is_a_shift(spark):
    df = spark.createDataFrame([("s", "m", k, 0, 0, 0, 16000, 1, [k + 0.5, 0.25] if k == 0 else [0.125, -0.5]) for k in range(2)], FRAME)
    late = [v for r in run_filters(df, fl.delay(1)).orderBy("seq").collect() for v in r.samples]
    assert late == [0.0, 0.5, 0.25, 0.125]


def test_fold_runs_on_frames(spark):
    rows = run_filters(frames_events(spark, SF), fl.low_pass())
    assert rows.count() == frames_events(spark, SF).count()


def test_live_fold_equals_batch(spark, tmp_path):
    from wavelattice.streaming.live import live_fold

    frames = frames_events(spark, SF)
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    query = live_fold(stream, fl.low_pass(), FRAME).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda df: sorted((r.source_id, r.seq, tuple(r.samples)) for r in df.collect())
    assert key(spark.table("live")) == key(run_filters(frames, fl.low_pass()))


def test_ranges():
    assert parse_range("now-10s..now", 20 * 10**9) == (10 * 10**9, 20 * 10**9)
    assert parse_range("a.start..a.end+2s", 0, {"a": (5, 10)}) == (5, 10 + 2 * 10**9)
    for bad in ("now", "now..now-1s", "x.start..now", "1..2..3"):
        with pytest.raises(ValueError):
            parse_range(bad, 10**9)


def cut(spark, channels, sizes, rate=16000):
    """A stream of sample values 0, 1, 2 .. (hundredths) in frames of those sizes."""
    rows, at = [], 0
    for k, n in enumerate(sizes):
        rows.append(("s", "m", k, k // 2, 1000 * k, 0, rate, channels, [(at + i) / 100 for i in range(n * channels)]))
        at += n * channels
    return spark.createDataFrame(rows, FRAME)


def hundredths(rows):
    return [[round(v * 100) for v in r.samples] for r in rows]


def test_chunks_keep_headers_and_channels(spark):
    frames = cut(spark, 2, [3, 1, 4])
    rows = timeline.frame_buffer(frames, 2).orderBy("seq").collect()
    assert hundredths(rows) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]]
    assert [(r.seq, r.stamp_ns, r.generation, r.channels) for r in rows] == [(0, 0, 0, 2), (1, 0, 0, 2), (2, 2000, 1, 2), (3, 2000, 1, 2)]
    rows = timeline.chunk_overlap(frames, 4, 3).orderBy("seq").collect()
    assert hundredths(rows) == [list(range(8)), list(range(6, 14))] and [r.stamp_ns for r in rows] == [0, 1000]
    two = frames.unionByName(frames.selectExpr("source_id", "'other' AS stream_id", *frames.columns[2:]))
    assert timeline.frame_buffer(two, 2).groupBy("stream_id").count().collect()[0]["count"] == 4


def test_overlap_add_weighs_and_starts_anew_after_a_gap(spark):
    rows = [("s", "m", k, 0, 500, 0, 1000, 2, [v, -v] * 4) for k, v in ((0, 0.25), (1, 0.5), (1, 0.5), (4, 0.125))]
    out = timeline.overlap_add(spark.createDataFrame(rows, FRAME), 4, 2, "rectangular").orderBy("seq").collect()
    assert [(r.seq, r.stamp_ns, r.samples) for r in out] == [(0, 500, [0.25, -0.25] * 2), (1, 500 + 2_000_000, [0.375, -0.375] * 2), (4, 500, [0.125, -0.125] * 2)]


def test_resampling_gives_a_frame_what_lies_up_to_its_last_sample(spark):
    rows = timeline.resample_linear(cut(spark, 2, [2, 3], 1000), 2000).orderBy("seq").collect()
    assert [[round(v * 200) for v in r.samples] for r in rows] == [[0, 2, 2, 4, 4, 6], [6, 8, 8, 10, 10, 12, 12, 14, 14, 16, 16, 18]]
    assert hundredths(timeline.resample_linear(cut(spark, 1, [2, 1, 3], 3000), 1000).orderBy("seq").collect()) == [[0], [3]]


def test_long_ranges_come_in_pieces(spark):
    frames = spark.createDataFrame([("s", "m", k, 0, k * 2_000_000, 0, 1000, 1, [0.1, 0.2]) for k in (0, 1, 3)], FRAME)
    pieces = timeline.range_pieces(frames, 1_000_000, 8_000_000)
    assert [(r.seq, r.start_ns, r.stop_ns, len(r.samples)) for r in pieces.orderBy("seq").collect()] == [(0, 1_000_000, 2_000_000, 1), (1, 2_000_000, 4_000_000, 2), (3, 6_000_000, 8_000_000, 2)]
    assert timeline.range_status(pieces, 1_000_000, 8_000_000).first().status == "range_not_continuous"
    assert timeline.range_query(frames, 1_000_000, 4_000_000).first().samples == pytest.approx([0.2, 0.1, 0.2])


def test_plans_have_no_row_for_each_sample(spark):
    frames = frames_events(spark, SF)
    for made in (timeline.resample_linear(frames, 8000), timeline.overlap_add(frames, 16, 8), run_filters(frames, fl.delay(7))):
        assert "Generate" not in made._jdf.queryExecution().optimizedPlan().toString().replace("posexplode", "")
    plan = timeline.frame_buffer(frames, 24)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "sequence" in plan  # one row for each chunk that a frame reaches


def test_wav_header():
    data = wav_bytes([0.0, 1.0, -1.0], 16000)
    assert data[:4] == b"RIFF" and len(data) == 50 and data[44:] == b"\0\0\xff\x7f\0\x80"


def test_graph_checks_its_edges(spark):
    frames = frames_events(spark, SF)
    out = build([Node("g", "gain", "in", {"linear": 0.5}), Node("l", "limiter", "g", {"threshold": 0.1})], {"in": frames})
    assert out["l"].count() == frames.count()
    with pytest.raises(ValueError):
        build([Node("p", "pan", "in")], {"in": frames}, {"in": 1})
    for wrong in ([Node("p", "nothing", "in")], [Node("p", "gain", "out")], [Node("in", "gain", "in")], [Node("p", "aec_linear", "in")], [Node("p", "stft", "in"), Node("q", "gain", "p")]):
        with pytest.raises(ValueError):
            build(wrong, {"in": frames})
    with pytest.raises(ValueError):
        check([Node("u", "upmix", "in", {"channels": 4}), Node("m", "mix", ("in", "u"))], {"in": None}, {"in": 1})
    nodes = [Node("f", "low_pass", "in"), Node("c", "frame_buffer", "f", {"size": 32}), Node("m", "mix", ("in", "f"), {"gains_db": [-6.0, -6.0]}), Node("s", "stft", "c", {"n_fft": 16, "hop": 16}), Node("d", "ducking", ("in", "f"))]
    out = build(nodes, {"in": frames}, {"in": 1})
    assert out["m"].count() == out["d"].count() == frames.count() and out["s"].count() == 2 * out["c"].count() > 0


def test_every_frame_is_accounted_for(spark):
    frames = spark.createDataFrame([("s", "m", k, 0, 0, 0, 16000, 1, x) for k, x in enumerate(([0.25], [0.75], [2.0], []))], FRAME)
    out = pw.gain(frames, 2.0)
    assert {r.seq: r.reason for r in refused_by(frames, out, "gain").collect()} == {1: "result", 2: "out of range", 3: "empty"} and out.count() == 1


def test_live_chunks_equal_the_batch_plan(spark):
    frames = cut(spark, 2, [3, 1, 4, 2, 7])
    names = [c.split()[0] for c in FRAME.split(", ")]
    rows = [dict(zip(names, r)) for r in frames.orderBy("seq").collect()]
    for size, hop in ((2, 2), (5, 5), (4, 3), (6, 1)):
        batch = timeline.frame_buffer(frames, size) if size == hop else timeline.chunk_overlap(frames, size, hop)
        want = [(r.seq, r.stamp_ns, r.generation, r.samples) for r in batch.orderBy("seq").collect()]
        assert [(o["seq"], o["stamp_ns"], o["generation"], o["samples"].tolist()) for o in run(chunk_step(size, hop), rows)] == want
