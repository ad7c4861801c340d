"""The registered queries and their DuckDB equivalents.

The tables hold no audio: frames are the synthetic views of ``model``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import commands, tones
from .model import EMBEDDINGS_SQL, EVENTS_SQL, digest, digest_sql, digest_tail, frames_embeddings, frames_events, rejects
from .operators import asof, features, filters, models, resample, stateful, timeline
from .operators import pointwise as pw
from .operators.filters import run_filters
from .operators.stateful import OUT, ordered_fold
from .sources import clips, codec, pcm

QUERIES: dict = {}
ORACLES: dict = {}


def _register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _map(name: str, op, sql: str | None, of: str = "emb", channels: int = 1, where: str = "true", **params) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = frames_embeddings(spark, sf_dir, channels) if of == "emb" else frames_events(spark, sf_dir)
        return digest(op(frames, **params))

    _register(name, query, sql and digest_sql(sql, of, where))


def _each(expr: str) -> str:
    return f"list_transform(samples, lambda x, i: CAST({expr.replace('{x}', 'x::DOUBLE')} AS FLOAT))"


# -- one frame to one frame ---------------------------------------------------
_map("gain", pw.gain, _each("{x} * 1.5"), linear=1.5)
_map("compressor", pw.compressor, _each("CASE WHEN abs({x}) > 0.1 THEN sign({x}) * (0.1 + (abs({x}) - 0.1) / 4) ELSE {x} END * 1.25"), threshold=0.1, ratio=4.0, makeup=1.25)
_map("expander", pw.expander, _each("CASE WHEN abs({x}) < 0.05 THEN sign({x}) * 0.05 * pow(abs({x}) / 0.05, 2) ELSE {x} END"))
_map("limiter", pw.limiter, _each("least(greatest({x}, -0.1::FLOAT), 0.1::FLOAT)"), threshold=0.1)
_map("noise_gate", pw.noise_gate, _each("CASE WHEN abs({x}) < 0.05 THEN {x} * 0.5 ELSE {x} END"), threshold=0.05, closed_gain=0.5)
_map("normalize", pw.normalize, _each("{x} * 0.9 / list_max(list_transform(samples, lambda y: abs(y)))"))
for _kind, _a, _b in (("hann", 0.5, 0.5), ("hamming", 0.54, 0.46)):
    _map(f"window_{_kind}", pw.window, _each(f"{{x}} * ({_a} - {_b} * cos(2 * pi() * (i - 1) / 63))"), kind=_kind, expected_frames=64)
_map("trim", pw.trim, "samples[9:60]", leading=8, trailing=4)
_map("dc_offset_removal", pw.dc_offset_removal, _each("{x} - list_avg(list_transform(samples, lambda y: y::DOUBLE))"))
_map("dc_offset_removal_stereo", pw.dc_offset_removal, _each("{x} - list_avg(list_transform(list_filter(samples, lambda y, j: j % 2 = i % 2), lambda y: y::DOUBLE))"), channels=2)
_CLICK = " OR ".join(f"(i + {n} <= 64 AND " + " AND ".join(f"abs(s[i + {k}]::DOUBLE - s[i - 1]) > 0.2 AND abs(s[i + {k}]::DOUBLE - s[i + {n}]) > 0.2" for k in range(n)) + ")" for n in (1,))
_CLICK2 = "(i + 2 <= 64 AND abs(s[i]::DOUBLE - s[i - 1]) > 0.2 AND abs(s[i]::DOUBLE - s[i + 2]) > 0.2 AND abs(s[i + 1]::DOUBLE - s[i - 1]) > 0.2 AND abs(s[i + 1]::DOUBLE - s[i + 2]) > 0.2)"
_map("declick", pw.declick, None, delta=0.2, max_samples=2)
ORACLES["declick"] = f"""WITH RECURSIVE {EMBEDDINGS_SQL}, e AS (SELECT source_id, seq, samples AS s FROM emb),
f AS (SELECT source_id, seq, 1 AS i, s, 0 AS left_over, 0.0::DOUBLE AS mean, s[1]::DOUBLE AS y FROM e
 UNION ALL SELECT source_id, seq, i, s, greatest(now - 1, 0), new_mean, CASE WHEN now > 0 THEN new_mean ELSE s[i]::DOUBLE END FROM (
  SELECT *, CASE WHEN n = 1 THEN (s[i - 1]::DOUBLE + s[i + 1]) / 2 WHEN n = 2 THEN (s[i - 1]::DOUBLE + s[i + 2]) / 2 ELSE mean END AS new_mean, CASE WHEN n > 0 THEN n ELSE left_over END AS now FROM (
   SELECT source_id, seq, i, s, left_over, mean, CASE WHEN left_over > 0 THEN 0 WHEN {_CLICK} THEN 1 WHEN {_CLICK2} THEN 2 ELSE 0 END AS n FROM (SELECT source_id, seq, i + 1 AS i, s, left_over, mean FROM f WHERE i < 64)))),
o AS (SELECT source_id, seq, list(CAST(y AS FLOAT) ORDER BY i) AS samples FROM f GROUP BY source_id, seq)
{digest_tail("o")}"""
_c, _s = math.cos(1.25 * math.pi / 4), math.sin(1.25 * math.pi / 4)
_map("pan", pw.pan, _each(f"{{x}} * CASE WHEN i % 2 = 1 THEN {_c!r} ELSE {_s!r} END"), channels=2, position=0.25)
_map("stereo_widening", pw.stereo_widening, _each("CASE WHEN i % 2 = 1 THEN (samples[i]::DOUBLE + samples[i + 1]) / 2 + (samples[i]::DOUBLE - samples[i + 1]) / 2 * 1.5 ELSE (samples[i - 1]::DOUBLE + samples[i]) / 2 - (samples[i - 1]::DOUBLE - samples[i]) / 2 * 1.5 END"), channels=2, width=1.5)
_quad = "list_transform(range(0, 16), lambda k: CAST((samples[4 * k + 1]::DOUBLE + samples[4 * k + 2] + samples[4 * k + 3] + samples[4 * k + 4]) / 4 AS FLOAT))"
_map("downmix_mono", pw.downmix, _quad, channels=4, mode="average_to_mono")
_map("downmix_stereo", pw.downmix, "list_transform(range(0, 32), lambda k: CAST((samples[4 * (k // 2) + 1 + k % 2]::DOUBLE + samples[4 * (k // 2) + 3 + k % 2]) / 2 AS FLOAT))", channels=4)
_map("upmix_mono", pw.upmix, "list_transform(range(0, 128), lambda k: samples[k // 2 + 1])")
_register("upmix_stereo", lambda s, d: digest(pw.upmix(frames_embeddings(s, d, 2), "stereo_pair_duplicate", 4)), digest_sql("list_transform(range(0, 128), lambda k: samples[2 * (k // 4) + k % 2 + 1])"))
_map("beamforming", pw.beamforming, "list_transform(range(0, 16), lambda k: CAST(samples[4 * k + 1]::DOUBLE * 0.5 + samples[4 * k + 2]::DOUBLE * 0.25 - samples[4 * k + 3]::DOUBLE * 0.125 AS FLOAT))", channels=4, weights=[0.5, 0.25, -0.125, 0.0])
_map("channel_convert_stereo", pw.channel_convert, "list_transform(range(0, 128), lambda k: samples[k // 2 + 1])")
_map("channel_convert_mono", pw.channel_convert, "list_transform(range(0, 32), lambda k: CAST((samples[2 * k + 1]::DOUBLE + samples[2 * k + 2]) / 2 AS FLOAT))", channels=2, mode="stereo_to_mono_average")
_map("interleave_planar", pw.interleave, "list_transform(range(0, 64), lambda k: samples[(k % 32) * 2 + k // 32 + 1])", channels=2)
_map("interleave_back", pw.interleave, "list_transform(range(0, 64), lambda k: samples[(k % 2) * 32 + k // 2 + 1])", channels=2, to="interleaved")
for _name in ("aec_nn_passthrough", "denoise_passthrough", "loopback"):
    _map(_name, pw.passthrough, "samples", stream_id="out")
_map("sample_format_round_trip", lambda f: pw.from_pcm(pw.to_pcm16(f)), _each("round({x} * CASE WHEN {x} < 0 THEN 32768 ELSE 32767 END) / 32768"))
_map("bit_depth", lambda f: pw.from_pcm(pw.bit_depth(pw.to_pcm16(f)), 32), _each("round({x} * CASE WHEN {x} < 0 THEN 32768 ELSE 32767 END) / 32768"))
_map("sidechain", pw.sidechain, f"[CAST(CASE WHEN sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x)) / len(samples)) >= 0.06 THEN {10 ** -0.6!r} ELSE 1.0 END AS FLOAT)]", of="ev", threshold_rms=0.06)


def latency_compensation(spark, sf_dir):
    return pw.latency_compensation(frames_embeddings(spark, sf_dir), -10.5).select("source_id", "seq", "stamp_ns")


_register("latency_compensation", latency_compensation, f"WITH {EMBEDDINGS_SQL} SELECT source_id, seq, seq * 4000000 - 10500000 AS stamp_ns FROM emb WHERE seq * 4000000 - 10500000 >= 0")


def time_alignment(spark, sf_dir):
    return pw.time_alignment(frames_embeddings(spark, sf_dir), 10.0, 1.0, 2.0).select("source_id", "seq", "stamp_ns")


_register("time_alignment", time_alignment, f"WITH {EMBEDDINGS_SQL}, t AS (SELECT source_id, seq, seq * 4000000 AS s, (1000000 + round((seq * 4000000 - 1000000) / 10000000.0) * 10000000)::BIGINT AS stamp_ns FROM emb) SELECT source_id, seq, stamp_ns FROM t WHERE abs(stamp_ns - s) <= 2000000")


def bus_router(spark, sf_dir):
    return pw.bus_router(frames_embeddings(spark, sf_dir), ["a", "b", "c"]).groupBy("stream_id", "source_id").agg(F.count("*").alias("n"))


_register("bus_router", bus_router, "SELECT unnest(['a', 'b', 'c']) AS stream_id, CAST(label AS VARCHAR) AS source_id, count(*) AS n FROM embeddings GROUP BY label")


def patchbay(spark, sf_dir):
    both = frames_embeddings(spark, sf_dir).unionByName(frames_events(spark, sf_dir))
    return pw.patchbay(both, [("emb", "x"), ("emb", "y"), ("ev", "y"), ("none", "z")]).groupBy("stream_id").agg(F.count("*").alias("n"))


_register("patchbay", patchbay, f"WITH {EMBEDDINGS_SQL}, {EVENTS_SQL} SELECT r AS stream_id, count(*) AS n FROM (SELECT unnest(['x', 'y']) AS r FROM emb UNION ALL SELECT 'y' FROM ev) GROUP BY r")


def loudness(spark, sf_dir):
    out = pw.loudness(frames_events(spark, sf_dir))
    return out.select("source_id", "seq", *(F.round(c, 5).alias(c) for c in ("rms", "peak", "rms_dbfs", "peak_dbfs", "crest")))


_register("loudness", loudness, f"""WITH {EVENTS_SQL}, m AS (SELECT source_id, seq, sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x)) / len(samples)) AS rms, list_max(list_transform(samples, lambda x: abs(x)))::DOUBLE AS peak FROM ev)
SELECT source_id, seq, round(rms, 5) AS rms, round(peak, 5) AS peak, round(CASE WHEN rms > 0 THEN greatest(20 * log10(rms), -120) ELSE -120 END, 5) AS rms_dbfs, round(CASE WHEN peak > 0 THEN greatest(20 * log10(peak), -120) ELSE -120 END, 5) AS peak_dbfs, round(CASE WHEN rms > 0 THEN peak / rms ELSE 0 END, 5) AS crest FROM m""")


def minimum_slice(spark, sf_dir):
    """Events to frames, contract, half gain, level, and a summary for each source with its rejects."""
    frames = frames_events(spark, sf_dir, 256.0)
    level = pw.loudness(pw.gain(frames, 0.5)).groupBy("source_id").agg(F.count("*").alias("n"), F.round(F.avg("rms"), 5).alias("avg_rms"), F.round(F.max("peak"), 5).alias("max_peak"))
    lost = rejects(frames, "gain").groupBy("source_id").agg(F.count("*").alias("rejected"))
    return level.join(lost, "source_id", "full").select("source_id", F.coalesce("n", F.lit(0)).alias("n"), "avg_rms", "max_peak", F.coalesce("rejected", F.lit(0)).alias("rejected"))


_register("minimum_slice", minimum_slice, f"""WITH {EVENTS_SQL.replace('1024.0', '256.0')}, g AS (SELECT source_id, list_bool_and(list_transform(samples, lambda x: x BETWEEN -1 AND 1)) AS ok, list_transform(samples, lambda x: x::DOUBLE * 0.5) AS s FROM ev)
SELECT source_id, count(*) FILTER (ok) AS n, round(avg(sqrt(list_sum(list_transform(s, lambda x: x * x)) / 16)) FILTER (ok), 5) AS avg_rms, round(max(list_max(list_transform(s, lambda x: abs(x)))) FILTER (ok), 5) AS max_peak, count(*) FILTER (NOT ok) AS rejected FROM g GROUP BY source_id""")

# -- windows over samples -----------------------------------------------------
_LONG = f"{EVENTS_SQL}, l AS (SELECT source_id, seq, seq * 16 + i - 1 AS pos, samples[i] AS v FROM (SELECT *, unnest(range(1, 17)) AS i FROM ev))"


def _packed_sql(rows: str, size: int | None, more: str = "") -> str:
    having = f"HAVING count(*) = {size}" if size else ""
    return f"""WITH {_LONG}, r AS ({rows}), p AS (SELECT source_id, seq, list(v ORDER BY pos) AS samples{more and f", min({more}) AS {more}"} FROM r GROUP BY source_id, seq {having})
    {digest_tail("p", more and f"{more}, ")}"""


def _events_op(name: str, op, sql: str | None, more: tuple[str, ...] = (), **params) -> None:
    _register(name, lambda spark, sf_dir: digest(op(frames_events(spark, sf_dir), **params), *more), sql)


# a chunk's stamp is that of the frame its first sample comes from
_events_op("frame_buffer", timeline.frame_buffer, _packed_sql("SELECT source_id, pos // 24 AS seq, pos, v, (pos // 24 * 24 // 16) * 1000000 AS stamp_ns FROM l", 24, "stamp_ns"), ("stamp_ns",), size=24)
_events_op("chunk_overlap", timeline.chunk_overlap, _packed_sql("SELECT source_id, c AS seq, pos, v, (c * 12 // 16) * 1000000 AS stamp_ns FROM (SELECT *, unnest(range(greatest((pos - 24 + 12) // 12, 0), pos // 12 + 1)) AS c FROM l) WHERE pos >= c * 12 AND pos < c * 12 + 24", 24, "stamp_ns"), ("stamp_ns",), size=24, hop=12)
_events_op("delay", lambda f: run_filters(f, filters.delay(20)), _packed_sql("SELECT source_id, seq, pos, coalesce(lag(v, 20) OVER (PARTITION BY source_id ORDER BY pos), 0) AS v FROM l", None))
_events_op("fade", timeline.fade, _packed_sql("SELECT source_id, seq, pos, CAST(v::DOUBLE * least(pos / 100.0, 1) AS FLOAT) AS v FROM l", None), duration=100)


def overlap_add(spark, sf_dir):
    return digest(timeline.overlap_add(timeline.chunk_overlap(frames_events(spark, sf_dir), 32, 16), 32, 16), "stamp_ns")


# what overlaps is the same signal, so its weighted mean is the signal
_register("overlap_add", overlap_add, _packed_sql("SELECT source_id, pos // 16 AS seq, pos, v, (pos // 16) * 1000000 AS stamp_ns FROM (SELECT *, max(pos) OVER (PARTITION BY source_id) AS top FROM l) WHERE pos // 16 <= (top + 1 - 32) // 16", 16, "stamp_ns"))


def resample_linear(spark, sf_dir):
    return digest(timeline.resample_linear(frames_events(spark, sf_dir), 24000))


# output k stands between samples k * 16000 // 24000 and the next; a frame gives what lies after the frame before it and not after its own last sample
_register("resample_linear", resample_linear, _packed_sql("""SELECT source_id, (k * 16000 + 23999) // 24000 // 16 AS seq, k AS pos, CAST((1 - frac) * v + frac * coalesce(nv, v) AS FLOAT) AS v
    FROM (SELECT source_id, k, v::DOUBLE AS v, nv::DOUBLE AS nv, (k * 16000 - pos * 24000) / 24000.0::DOUBLE AS frac
          FROM (SELECT *, unnest(range((pos * 24000 + 15999) // 16000, ((pos + 1) * 24000 + 15999) // 16000)) AS k FROM (SELECT *, lead(v) OVER (PARTITION BY source_id ORDER BY pos) AS nv FROM l)))
    WHERE nv IS NOT NULL OR frac = 0""", None))


def resample_stereo(spark, sf_dir):
    """Pairs of events as stereo, from 16000 to 8000 a second: every other pair."""
    return digest(timeline.resample_linear(frames_events(spark, sf_dir).withColumn("channels", F.lit(2)), 8000))


_register("resample_stereo", resample_stereo, _packed_sql("SELECT source_id, seq, pos, v FROM l WHERE pos // 2 % 2 = 0", None))


_HALF = 12
_shape = " + ".join(f"{c!r}::DOUBLE * cos(pi() * {k} * t / {{reach}})" for k, c in enumerate(resample.WINDOW))


def _sinc_sql(rate: int, target: int) -> str:
    """Sums over the samples around each output; a frame gives the outputs whose last sample it brings."""
    reach, cut = resample.width(rate, target, _HALF), min(1.0, target / rate)
    t = f"(k * {rate} % {target} / {float(target)!r}::DOUBLE - j)"
    w = f"CASE WHEN abs(t) >= {reach} THEN 0 ELSE ({_shape.format(reach=reach)}) * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * {cut!r}::DOUBLE * t) / (pi() * {cut!r}::DOUBLE * t) END END"
    return f"""WITH {_LONG}, n AS (SELECT source_id, max(pos) AS top FROM l GROUP BY source_id),
    q AS (SELECT source_id, k, top FROM (SELECT *, unnest(range(0, (top + 1) * {target} // {rate} + 1)) AS k FROM n) WHERE k * {rate} // {target} + {reach} <= top),
    ks AS (SELECT DISTINCT k FROM q), ws AS (SELECT k, j, {t} AS t FROM (SELECT k, unnest(range({1 - reach}, {reach + 1})) AS j FROM ks)),
    wn AS (SELECT k, j, w / sum(w) OVER (PARTITION BY k) AS w FROM (SELECT k, j, {w} AS w FROM ws)),
    y AS (SELECT q.source_id, q.k, (q.k * {rate} // {target} + {reach}) // 16 AS seq, CAST(sum(wn.w * coalesce(l.v::DOUBLE, 0)) AS FLOAT) AS v
          FROM q JOIN wn ON wn.k = q.k LEFT JOIN l ON l.source_id = q.source_id AND l.pos = q.k * {rate} // {target} + wn.j GROUP BY q.source_id, q.k),
    o AS (SELECT source_id, seq, list(v ORDER BY k) AS samples FROM y GROUP BY source_id, seq)
    SELECT source_id, seq, len(samples) AS n, round(list_sum(list_transform(samples, lambda x: x::DOUBLE)), 4) + 0.0 AS total FROM o"""


for _target in (24000, 8000):
    _register(f"resample_sinc_{_target}", lambda s, d, t=_target: digest(resample.resample_sinc(frames_events(s, d), t, _HALF)).select("source_id", "seq", "n", "total"), _sinc_sql(16000, _target))


def _dup_frames(spark, sf_dir) -> DataFrame:
    """Lines of orders as frames with gaps, repeats and disorder: seq is the line number, arrival a total order."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    arrival = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return rows.select(
        F.col("l_orderkey").cast("string").alias("source_id"), F.lit("li").alias("stream_id"), F.col("l_linenumber").cast("long").alias("seq"), F.lit(0).cast("long").alias("generation"),
        (F.col("l_linenumber").cast("long") * 1000000).alias("stamp_ns"), arrival.cast("long").alias("arrival_ns"), F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"),
        F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100).cast("array<float>").alias("samples"),
    )


_DUP = "d AS (SELECT l_orderkey, l_linenumber AS seq, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS arr, [l_discount::FLOAT, l_tax::FLOAT, (l_quantity / 100)::FLOAT] AS s FROM lineitem)"
_register(
    "packet_loss_concealment",
    lambda spark, sf_dir: digest(timeline.packet_loss_concealment(_dup_frames(spark, sf_dir)), "concealed"),
    f"""WITH {_DUP}, k AS (SELECT *, max(seq) OVER (PARTITION BY l_orderkey ORDER BY arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d),
    g AS (SELECT *, lag(s) OVER (PARTITION BY l_orderkey ORDER BY seq) AS prev FROM k WHERE seen IS NULL OR seq > seen),
    o AS (SELECT l_orderkey, seq, s, false AS concealed FROM g UNION ALL SELECT l_orderkey, seen + j, list_transform(prev, lambda x: CAST(x::DOUBLE * pow(0.7, j) AS FLOAT)), true FROM (SELECT *, unnest(range(1, seq - seen)) AS j FROM g WHERE seq - seen - 1 BETWEEN 1 AND 3))
    {digest_tail("(SELECT CAST(l_orderkey AS VARCHAR) AS source_id, seq, concealed, s AS samples FROM o)", "concealed, ")}""",
)


def range_query(spark, sf_dir):
    out = timeline.range_query(frames_embeddings(spark, sf_dir), 6_000_000, 26_000_001)
    return out.select("source_id", "status", F.size("samples").cast("long").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


_register("audio_window_range", range_query, f"WITH {EMBEDDINGS_SQL}, l AS (SELECT source_id, seq * 64 + i - 1 AS pos, samples[i]::DOUBLE AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM emb)) SELECT source_id, 'ok' AS status, count(*) AS n, round(sum(v), 4) AS total FROM l WHERE pos >= 96 AND pos < 417 GROUP BY source_id")


# -- several inputs -----------------------------------------------------------
def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    frames = frames_embeddings(spark, sf_dir)
    late = frames.filter("seq % 3 <> 1").withColumns({"stamp_ns": F.col("stamp_ns") - 1_500_000, "arrival_ns": F.col("arrival_ns") - 700_000, "samples": F.transform("samples", lambda x: (x * F.lit(0.5).cast("float")).cast("float"))})
    return frames, late


def _asof_sql(expr: str) -> str:
    return f"""WITH {EMBEDDINGS_SQL}, o AS (SELECT a.source_id, a.seq, {expr} AS samples FROM emb a JOIN emb b ON a.source_id = b.source_id AND b.seq = CASE WHEN a.seq % 3 = 1 THEN a.seq - 1 ELSE a.seq END)
    {digest_tail("o")} WHERE list_bool_and(list_transform(samples, lambda x: x BETWEEN -1 AND 1))"""


_register("mix", lambda s, d: digest(asof.mix(list(_two(s, d)), [0.0, -6.0])), _asof_sql(f"list_transform(a.samples, lambda x, i: CAST(x + CAST((b.samples[i] * 0.5::FLOAT)::DOUBLE * {10 ** -0.3!r} AS FLOAT) AS FLOAT))"))
_register("monitor_mix", lambda s, d: digest(asof.monitor_mix(list(_two(s, d)), [-6.0, 0.0])), _asof_sql(f"list_transform(a.samples, lambda x, i: CAST(CAST(x::DOUBLE * {10 ** -0.3!r} AS FLOAT) + b.samples[i] * 0.5::FLOAT AS FLOAT))"))
_register("aec_linear", lambda s, d: digest(asof.aec_linear(*_two(s, d), gain=0.8)), _asof_sql("list_transform(a.samples, lambda x, i: CAST(x::DOUBLE - (b.samples[i] * 0.5::FLOAT)::DOUBLE * 0.8 AS FLOAT))"))
_slow64, _quick64 = (1 - math.exp(-64 / 16000 / tau) for tau in (0.25, 0.01))
_register("ducking", lambda s, d: digest(ordered_fold(asof.sidechain_level(*_two(s, d)), stateful.ducking(), OUT)), f"""WITH RECURSIVE {EMBEDDINGS_SQL},
w AS (SELECT a.source_id, a.seq, a.samples, CASE WHEN sqrt(list_sum(list_transform(b.samples, lambda x: (x * 0.5::FLOAT)::DOUBLE * (x * 0.5::FLOAT))) / 64) >= 0.05 THEN {10 ** -0.6!r}::DOUBLE ELSE 1.0::DOUBLE END AS want
      FROM emb a JOIN emb b ON a.source_id = b.source_id AND b.seq = CASE WHEN a.seq % 3 = 1 THEN a.seq - 1 ELSE a.seq END),
f AS (SELECT source_id, seq, 1 + CASE WHEN want < 1 THEN {_quick64!r}::DOUBLE ELSE {_slow64!r}::DOUBLE END * (want - 1) AS g FROM w WHERE seq = 0
      UNION ALL SELECT w.source_id, w.seq, least(1.0::DOUBLE, greatest({10 ** -0.6!r}::DOUBLE, g + CASE WHEN want < g THEN {_quick64!r}::DOUBLE ELSE {_slow64!r}::DOUBLE END * (want - g))) FROM f JOIN w ON w.source_id = f.source_id AND w.seq = f.seq + 1),
o AS (SELECT source_id, seq, list_transform(samples, lambda x: CAST(x::DOUBLE * g AS FLOAT)) AS samples FROM f JOIN w USING (source_id, seq))
{digest_tail("o")}""")


def crossfade(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return digest(asof.crossfade(a, b, 16))


_register("crossfade", crossfade, f"""WITH {EMBEDDINGS_SQL}, h AS (SELECT source_id, seq, samples AS a, list_transform(samples, lambda x: x * 0.5::FLOAT) AS b FROM emb WHERE seq % 3 <> 1),
 o AS (SELECT source_id, seq, list_concat(list_concat(a[1:48], list_transform(range(1, 17), lambda i: CAST(a[48 + i]::DOUBLE * (1 - i / 17.0) + b[i]::DOUBLE * (i / 17.0) AS FLOAT))), b[17:64]) AS samples FROM h)
 {digest_tail("o")}""")


def vad_gate(spark, sf_dir):
    frames = frames_embeddings(spark, sf_dir)
    vad = frames.filter("seq % 5 = 0").select("source_id", "arrival_ns", (F.col("seq") % 10 == 0).alias("active"))
    return asof.vad_gate(frames, vad, 10)


_register("kws_vad_gate", vad_gate, f"WITH {EMBEDDINGS_SQL} SELECT source_id, seq, CASE WHEN (seq % 5) * 4 <= 10 THEN (seq // 5) % 2 = 0 ELSE false END AS active FROM emb")


def turn_correlation(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.floor((F.col("turn") + 1) / 2).alias("user_turn_id"), F.lit(1).alias("request_id"), "role")
    ask, end = rows.filter("role = 'user'").drop("role").distinct(), rows.filter("role = 'assistant'").drop("role").distinct()
    return asof.turn_correlation(ask, end).select("session_id", "user_turn_id", "request_id")


_register("turn_correlation", turn_correlation, "WITH r AS (SELECT DISTINCT conv_id AS session_id, (turn + 1) // 2 AS user_turn_id, 1 AS request_id, role FROM conversations) SELECT a.session_id, a.user_turn_id, a.request_id FROM r a JOIN r b USING (session_id, user_turn_id, request_id) WHERE a.role = 'user' AND b.role = 'assistant'")

# -- ordered folds ------------------------------------------------------------
def _rc_share(cutoff: float) -> float:
    return (1 / 16000) / (1 / (2 * math.pi * cutoff) + 1 / 16000)


def _walk_sql(first: str, then: str, lag: int = 1) -> str:
    """A recursion over the samples x of a source: ``first`` and ``then`` give y and further columns; p<name> is a column ``lag`` samples ago."""
    names = [c.rpartition(" AS ")[2].strip() for c in first.split(", ") if " AS " in c] + ["x"]
    before = ", ".join(f"f.{n} AS p{n}" for n in names)
    return f"""WITH RECURSIVE {_LONG}, s AS (SELECT source_id, pos, v::DOUBLE AS x FROM l), f AS (SELECT source_id, pos, x, {first} FROM s WHERE pos < {lag}
    UNION ALL SELECT source_id, pos, x, {then} FROM (SELECT s.source_id, s.pos, s.x, {before} FROM f JOIN s ON s.source_id = f.source_id AND s.pos = f.pos + {lag})),
    o AS (SELECT source_id, pos // 16 AS seq, list(CAST(y AS FLOAT) ORDER BY pos) AS samples FROM f GROUP BY source_id, pos // 16)
    {digest_tail("o")}"""


def _high_sql(cutoff: float, x: str, y: str) -> str:
    return f"CAST({1 - _rc_share(cutoff)!r} * (p{y} + {x} - p{x}) AS FLOAT)::DOUBLE"


def _low_sql(cutoff: float, x: str, y: str) -> str:
    return f"CAST(p{y} + {_rc_share(cutoff)!r} * ({x} - p{y}) AS FLOAT)::DOUBLE"


def _notch_sql(f0: float, q: float, x: str, y: str) -> str:
    w = 2 * math.pi * f0 / 16000
    alpha = math.sin(w) / (2 * q)
    b0, b1, a2 = 1 / (1 + alpha), -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)
    return f"{b0!r} * {x} + {b1!r} * p{x} + {b0!r} * pp{x} - {b1!r} * p{y} - {a2!r} * pp{y}"


def _cascade_sql(stages: list[tuple[float, float]]) -> str:
    """Notches one after another: u0 is the input, each stage keeps its last two values."""
    n = len(stages)
    first = ["x AS u0", "0.0::DOUBLE AS q0"]
    then = ["x AS u0", "pu0 AS q0"]
    for k, (f0, q) in enumerate(stages, 1):
        w = 2 * math.pi * f0 / 16000
        alpha = math.sin(w) / (2 * q)
        b0, b1, a2 = 1 / (1 + alpha), -2 * math.cos(w) / (1 + alpha), (1 - alpha) / (1 + alpha)
        scale = math.prod(1 / (1 + math.sin(2 * math.pi * f / 16000) / (2 * r)) for f, r in stages[:k])
        first += [f"{scale!r} * x AS u{k}", f"0.0::DOUBLE AS q{k}"]
        then += [f"{b0!r} * u{k - 1} + {b1!r} * pu{k - 1} + {b0!r} * pq{k - 1} - {b1!r} * pu{k} - {a2!r} * pq{k} AS u{k}", f"pu{k} AS q{k}"]
    return _walk_sql(", ".join([*first, f"u{n} AS y"]), ", ".join([*then, f"u{n} AS y"]))


_less = 1 - math.exp(-2 * math.pi * 4500.0 / 16000)
_split = "CAST(low + CASE WHEN abs(x - low) >= 0.08 THEN (x - low) * {g!r} ELSE x - low END AS FLOAT)::DOUBLE".format(g=10 ** (-9.0 / 20))
_rms_sql = "sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x)) / len(samples))"
_slow, _quick = (1 - math.exp(-16 / 16000 / tau) for tau in (0.25, 0.01))
_EQ = (10 ** (-3.0 / 20), 1.0, 10 ** (-6.0 / 20))
_eq_sum = f"{_EQ[0]!r} * lo + {_EQ[1]!r} * (x - lo - hi) + {_EQ[2]!r} * hi AS y"
#: At 200 samples a second the reverberator's lines are this long.
_LINES = (6, 7, 8, 9)
_room, _damp = 0.20 + 0.65 * 0.72, 0.35
_zeros = lambda n: "[" + ", ".join(["0.0::DOUBLE"] * n) + "]"
_fed = lambda k, late, damp: f"CAST({1 - _room!r} * x + {_room!r} * ({1 - _damp!r} * {late} + {_damp!r} * {damp}) AS FLOAT)::DOUBLE"
_REVERB = f"""WITH RECURSIVE {_LONG}, s AS (SELECT source_id, pos, v::DOUBLE AS x FROM l), f AS (
    SELECT source_id, pos, 0.68 * x AS y, {", ".join(f"list_append({_zeros(n - 1)}, {_fed(k, '0.0', '0.0')}) AS d{k}, 0.0::DOUBLE AS m{k}" for k, n in enumerate(_LINES))} FROM s WHERE pos = 0
    UNION ALL SELECT s.source_id, s.pos, 0.68 * s.x + 0.32 * ((d0[1] + d1[1] + d2[1] + d3[1]) / 4),
      {", ".join(f"list_append(d{k}[2:], {_fed(k, f'd{k}[1]', f'm{k}').replace(' x ', ' s.x ')}), CAST({1 - _damp!r} * d{k}[1] + {_damp!r} * m{k} AS FLOAT)::DOUBLE" for k in range(4))}
    FROM f JOIN s ON s.source_id = f.source_id AND s.pos = f.pos + 1),
    o AS (SELECT source_id, pos // 16 AS seq, list(CAST(y AS FLOAT) ORDER BY pos) AS samples FROM f GROUP BY source_id, pos // 16)
    {digest_tail("o")}"""
_FILTERS = {
    "low_pass": (filters.low_pass(), _walk_sql("x AS y", f"{_low_sql(3400.0, 'x', 'y')} AS y")),
    "high_pass": (filters.high_pass(), _walk_sql("0.0::DOUBLE AS y", f"{_high_sql(80.0, 'x', 'y')} AS y")),
    "band_pass": (filters.band_pass(), _walk_sql("0.0::DOUBLE AS hi, 0.0::DOUBLE AS y", f"{_high_sql(80.0, 'x', 'hi')} AS hi, {_low_sql(3400.0, 'hi', 'y')} AS y")),
    "notch": (filters.notch(), _cascade_sql([(60.0, 30.0)])),
    "hum": (filters.hum(), _cascade_sql([(60.0 * k, 30.0) for k in range(1, 5)])),
    "eq": (filters.eq(low_db=-3.0, high_db=-6.0), _walk_sql(f"x AS lo, 0.0::DOUBLE AS hi, {_eq_sum}", f"{_low_sql(250.0, 'x', 'lo')} AS lo, {_high_sql(4000.0, 'x', 'hi')} AS hi, {_eq_sum}")),
    "deesser": (filters.deesser(), _walk_sql(f"{_less!r} * x AS low, {_split} AS y", f"plow + {_less!r} * (x - plow) AS low, {_split} AS y")),
    "echo": (filters.echo(2.0), _walk_sql("CAST(0.8 * x AS FLOAT)::DOUBLE AS y, CAST(x AS FLOAT)::DOUBLE AS line", "CAST(0.8::DOUBLE * x + 0.4::DOUBLE * pline AS FLOAT)::DOUBLE AS y, CAST(x + 0.35::DOUBLE * pline AS FLOAT)::DOUBLE AS line", lag=32)),
    "reverb": (filters.reverb(), _REVERB),
}
for _name, (_filter, _sql) in _FILTERS.items():
    _register(_name, lambda s, d, f=_filter, r=200 if _name == "reverb" else 16000: digest(run_filters(frames_events(s, d).withColumn("sample_rate", F.lit(r)), f)), _sql)
_register("agc", lambda s, d: digest(ordered_fold(frames_events(s, d), stateful.agc(), OUT)), f"""WITH RECURSIVE {EVENTS_SQL}, w AS (SELECT *, least(greatest(0.1::DOUBLE / {_rms_sql}, 0.25), 4.0) AS want FROM ev),
    f AS (SELECT source_id, seq, 1 + CASE WHEN want < 1 THEN {_quick!r} ELSE {_slow!r} END * (want - 1) AS g FROM w WHERE seq = 0
          UNION ALL SELECT w.source_id, w.seq, g + CASE WHEN want < g THEN {_quick!r} ELSE {_slow!r} END * (want - g) FROM f JOIN w ON w.source_id = f.source_id AND w.seq = f.seq + 1),
    o AS (SELECT source_id, seq, list_transform(samples, lambda x: CAST(x::DOUBLE * g AS FLOAT)) AS samples FROM f JOIN ev USING (source_id, seq))
    {digest_tail("o")}""")
_register("silence_removal", lambda s, d: digest(ordered_fold(frames_events(s, d), stateful.silence_removal(0.1, 1.0), OUT)), f"""WITH {EVENTS_SQL}, loud AS (SELECT *, max(CASE WHEN {_rms_sql} >= 0.1 THEN seq END) OVER (PARTITION BY source_id ORDER BY seq) AS loudest FROM ev),
    o AS (SELECT source_id, seq, samples FROM loud WHERE seq - loudest <= 1) {digest_tail("o")}""")

_drifted = lambda s, d: frames_events(s, d).withColumn("stamp_ns", F.col("stamp_ns") + F.col("seq") * 150001 - F.when(F.col("seq") % 4 == 3, 900000).otherwise(0))
_register("clock_drift", lambda s, d: ordered_fold(_drifted(s, d), stateful.clock_drift(0.3, 0.1, 5.0), "source_id string, seq long, stamp_ns long", key=("source_id", "stream_id")), f"""WITH RECURSIVE {EVENTS_SQL},
 t AS (SELECT source_id, seq, (seq * 1150001 - CASE WHEN seq % 4 = 3 THEN 900000 ELSE 0 END)::DOUBLE AS st FROM ev),
 f AS (SELECT source_id, seq, st AS o, 0.0::DOUBLE AS dr FROM t WHERE seq = 0
  UNION ALL SELECT source_id, seq, CASE WHEN abs(st - ex) > 5000000 THEN st ELSE ex + greatest(-100000.0, least(100000.0, 0.7 * dr + 0.3 * (st - ex))) END, CASE WHEN abs(st - ex) > 5000000 THEN 0 ELSE 0.7 * dr + 0.3 * (st - ex) END
  FROM (SELECT t.source_id, t.seq, t.st, f.o + 1000000 AS ex, f.dr FROM f JOIN t ON t.source_id = f.source_id AND t.seq = f.seq + 1))
 SELECT source_id, seq, floor(o + 0.5)::BIGINT AS stamp_ns FROM f""")
_register("jitter_buffer", lambda s, d: ordered_fold(_dup_frames(s, d), stateful.jitter_buffer(), "source_id string, seq long, arrival_ns long, released_ns long", order=("arrival_ns",)), f"""WITH RECURSIVE {_DUP},
 f AS (SELECT l_orderkey, arr, [{{'seq': seq, 'arr': arr}}] AS held, NULL::BIGINT AS last, NULL::BIGINT AS out_seq, NULL::BIGINT AS out_arr FROM d WHERE arr = 1
  UNION ALL SELECT l_orderkey, arr, CASE WHEN len(more) > 2 THEN list_sort(more)[2:] ELSE more END, CASE WHEN len(more) > 2 THEN list_sort(more)[1].seq ELSE last END, CASE WHEN len(more) > 2 THEN list_sort(more)[1].seq END, CASE WHEN len(more) > 2 THEN list_sort(more)[1].arr END
  FROM (SELECT d.l_orderkey, d.arr, f.last, CASE WHEN coalesce(d.seq <= f.last, false) OR list_contains(list_transform(f.held, lambda h: h.seq), d.seq) THEN f.held ELSE list_append(f.held, {{'seq': d.seq, 'arr': d.arr}}) END AS more
        FROM f JOIN d ON d.l_orderkey = f.l_orderkey AND d.arr = f.arr + 1))
 SELECT CAST(l_orderkey AS VARCHAR) AS source_id, out_seq AS seq, out_arr AS arrival_ns, arr AS released_ns FROM f WHERE out_seq IS NOT NULL""")


def _probabilities(spark, sf_dir) -> DataFrame:
    """A window for each frame, as loud as the frame."""
    p = F.least(pw.rms() * 4, F.lit(1.0)).alias("probability")
    return frames_events(spark, sf_dir).select("source_id", "seq", "arrival_ns", "samples", p, (F.col("seq") * 512).alias("start_sample"), (F.col("seq") * 512 + 512).alias("end_sample"))


_PROB = f"{EVENTS_SQL}, p AS (SELECT source_id, seq, samples, least({_rms_sql} * 4, 1.0) AS p FROM ev)"
_register("vad_estimator", lambda s, d: ordered_fold(_probabilities(s, d), stateful.vad_estimator(0.3, 0.22, min_start=0.15, max_end=0.28, start_delta=0.1, end_delta=0.05, end_windows=1, start_windows=1, min_speech_ms=40), "source_id string, seq long, smoothed double, active boolean, started boolean, ended boolean").withColumn("smoothed", F.round("smoothed", 6)), f"""WITH RECURSIVE {_PROB},
 f AS (SELECT source_id, -1::BIGINT AS seq, 0.0::DOUBLE AS sm, 0.0::DOUBLE AS last, false AS act, 0::BIGINT AS since, 0 AS up, 0 AS down, false AS st, false AS en FROM (SELECT DISTINCT source_id FROM p)
  UNION ALL SELECT source_id, seq, sm, p, act2 AND NOT en2, since2, CASE WHEN act2 OR en2 THEN 0 ELSE up2 END, CASE WHEN act2 THEN down2 ELSE 0 END, st2, en2 FROM (
   SELECT *, act2 AND down2 >= 1 AND seq * 512 + 512 - since2 >= 640 AS en2 FROM (
    SELECT *, CASE WHEN act2 AND (p <= 0.22 OR p <= 0.28 AND last - p >= 0.05) THEN CASE WHEN st2 THEN 0 ELSE down END + 1 ELSE 0 END AS down2 FROM (
     SELECT *, act OR st2 AS act2, CASE WHEN st2 THEN seq * 512 ELSE since END AS since2 FROM (
      SELECT *, NOT act AND up2 >= 1 AS st2 FROM (
       SELECT p.source_id, p.seq, p.p, f.last, f.act, f.since, f.down, 0.35 * p.p + 0.65 * f.sm AS sm, CASE WHEN f.act THEN 0 WHEN p.p >= 0.3 OR p.p >= 0.15 AND p.p - f.last >= 0.1 THEN f.up + 1 ELSE 0 END AS up2
       FROM f JOIN p ON p.source_id = f.source_id AND p.seq = f.seq + 1))))))
 SELECT source_id, seq, round(sm, 6) AS smoothed, act AS active, st AS started, en AS ended FROM f WHERE seq >= 0""")
_register("kws_stream_gate", lambda s, d: digest(ordered_fold(_probabilities(s, d).withColumn("active", F.expr("probability > 0.33")), stateful.stream_gate(2, 1, 1), stateful.GATED), "segment", "opened", "merged", "closed"), f"""WITH RECURSIVE {_PROB}, a AS (SELECT source_id, seq, p > 0.33 AS act FROM p),
 f AS (SELECT source_id, -1::BIGINT AS seq, false AS op, 0::BIGINT AS seg, NULL::BIGINT AS voice, false AS wait, false AS opened, false AS merged, false AS closed, false AS pass FROM (SELECT DISTINCT source_id FROM a)
  UNION ALL SELECT source_id, seq, act OR op AND quiet <= 2, seg + CASE WHEN act AND NOT op THEN 1 ELSE 0 END, CASE WHEN act THEN seq ELSE voice END, NOT act AND op AND quiet > 1 AND quiet <= 2, act AND NOT op, act AND op AND wait, NOT act AND op AND quiet > 2, act OR op AND quiet <= 1
  FROM (SELECT a.source_id, a.seq, a.act, f.op, f.seg, f.voice, f.wait, a.seq - f.voice AS quiet FROM f JOIN a ON a.source_id = f.source_id AND a.seq = f.seq + 1)),
 w AS (SELECT f.*, list(e.samples ORDER BY e.seq) AS parts FROM f JOIN ev e ON e.source_id = f.source_id AND (e.seq = f.seq AND pass OR opened AND e.seq BETWEEN f.seq - 2 AND f.seq - 1) GROUP BY ALL),
 o AS (SELECT source_id, seq, seg AS segment, opened, merged, closed, flatten(parts) AS samples FROM w UNION ALL SELECT source_id, seq, seg, opened, merged, closed, NULL FROM f WHERE closed)
 {digest_tail("o", "segment, opened, merged, closed, ")}""")
_register("kws_cooldown", lambda s, d: ordered_fold(_probabilities(s, d).filter("probability > 0.25"), stateful.cooldown(2.0), "source_id string, seq long"), f"""WITH RECURSIVE {_PROB}, a AS (SELECT source_id, seq FROM p WHERE p > 0.25),
 f AS (SELECT source_id, min(seq) AS seq FROM a GROUP BY source_id UNION ALL SELECT source_id, min(seq) FROM (SELECT a.source_id, a.seq FROM f JOIN a ON a.source_id = f.source_id AND a.seq >= f.seq + 2) GROUP BY source_id)
 SELECT source_id, seq FROM f""")


def _louder():
    """A stand-in for a keyword model: the loudest sample since its segment began is the score."""

    def model(state, x):
        top = max(state or 0.0, float(abs(x).max()))
        return top, ("word", min(1.0, 2 * top)) if top > 0.1 else None

    return model


def kws_keyword(spark, sf_dir):
    gated = ordered_fold(_probabilities(spark, sf_dir).withColumn("active", F.expr("probability > 0.33")), stateful.stream_gate(0, 1, 1), stateful.GATED)
    return ordered_fold(gated, models.keyword(_louder, 0.35, 2.0), models.KEYWORDS).withColumn("score", F.round("score", 5))


# segments as in kws_stream_gate, without pre-roll; the score is the loudest sample since the segment's first row
_register("kws_keyword", kws_keyword, f"""WITH RECURSIVE {_PROB}, a AS (SELECT source_id, seq, p > 0.33 AS act, list_max(list_transform(samples, lambda x: abs(x)))::DOUBLE AS top FROM p),
 f AS (SELECT source_id, -1::BIGINT AS seq, false AS op, 0::BIGINT AS seg, NULL::BIGINT AS voice, false AS pass, 0.0::DOUBLE AS top, NULL::BIGINT AS last, false AS hit FROM (SELECT DISTINCT source_id FROM a)
  UNION ALL SELECT source_id, seq, op2, seg, voice, pass, top2, CASE WHEN hit THEN seq ELSE last END, hit FROM (
   SELECT *, pass AND top2 > 0.1 AND least(1.0::DOUBLE, 2 * top2) >= 0.35 AND (last IS NULL OR seq - last >= 2) AS hit FROM (
    SELECT source_id, seq, act OR op AND quiet <= 2 AS op2, seg + CASE WHEN act AND NOT op THEN 1 ELSE 0 END AS seg, CASE WHEN act THEN seq ELSE voice END AS voice, act OR op AND quiet <= 1 AS pass, last,
      CASE WHEN act AND NOT op THEN now ELSE CASE WHEN act OR op AND quiet <= 1 THEN greatest(top, now) ELSE top END END AS top2
    FROM (SELECT a.source_id, a.seq, a.act, a.top AS now, f.op, f.seg, f.voice, f.top, f.last, a.seq - f.voice AS quiet FROM f JOIN a ON a.source_id = f.source_id AND a.seq = f.seq + 1))))
 SELECT source_id, seq, seg AS segment, 'word' AS keyword, round(least(1.0::DOUBLE, 2 * top), 5) AS score FROM f WHERE hit""")


def _counting_model():
    """A stand-in for a recogniser: its text is the number of whole groups of 32 samples heard."""

    def model(state, x, last):
        n = (state or 0) + len(x)
        return n, f"{n // 32}" + "." * last

    return model


def asr_control(spark, sf_dir):
    event = "CASE WHEN seq % 7 = 3 THEN 'start' WHEN seq % 14 = 6 THEN 'stop' WHEN seq % 14 = 13 THEN 'cancel' ELSE 'audio' END"
    rows = frames_events(spark, sf_dir, size=2).withColumns({"event": F.expr(event), "session_id": F.lit("s"), "user_turn_id": F.floor(F.col("seq") / 7).cast("long") + 1})
    return ordered_fold(rows, models.asr_stream(_counting_model, chunk=4, right=1, pre_roll_ms=1, sample_rate=3000), models.TRANSCRIPTS)


# two samples a frame; a start (3, 10, 17 ..) hears three samples from before, then two or three frames follow until a stop (6, 20 ..) or cancel (13, 27 ..)
_register("asr_control", asr_control, """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS source_id, count(*) // 2 AS k FROM events GROUP BY user_id),
 q AS (SELECT source_id, k, unnest(range(0, k)) AS seq FROM n),
 st AS (SELECT source_id, seq - 3 AS base, seq FROM q WHERE seq % 7 = 3),
 heard AS (SELECT a.source_id, a.base, 3 + 2 * (b.seq - a.seq) AS total, b.seq FROM st a JOIN q b ON b.source_id = a.source_id AND b.seq > a.seq AND b.seq < a.seq + 3),
 partial AS (SELECT source_id, base, seq, CASE WHEN total >= 5 AND total < 9 THEN 5 WHEN total >= 9 THEN 9 END AS accepted, lag(CASE WHEN total >= 5 AND total < 9 THEN 5 WHEN total >= 9 THEN 9 END) OVER (PARTITION BY source_id, base ORDER BY seq) AS before FROM heard),
 said AS (SELECT source_id, base, seq, (accepted // 32)::VARCHAR AS text, false AS is_final, accepted FROM partial WHERE accepted IS NOT NULL AND before IS NULL),
 final AS (SELECT a.source_id, a.base, a.seq + 3 AS seq, '0.' AS text, true AS is_final, 7 AS accepted FROM st a JOIN q b ON b.source_id = a.source_id AND b.seq = a.seq + 3 WHERE b.seq % 14 = 6)
 SELECT source_id, seq, 's' AS session_id, base // 7 + 1 AS user_turn_id, text, is_final, accepted::BIGINT AS accepted_samples FROM (SELECT * FROM said UNION ALL SELECT * FROM final)""")


def _mean_model():
    return lambda x: float(abs(x.astype("float64")).mean())


_register("vad_windows", lambda s, d: ordered_fold(frames_events(s, d), models.vad_windows(_mean_model, 24), models.WINDOWS).withColumn("probability", F.round("probability", 5)),
          f"WITH {_LONG} SELECT source_id, pos // 24 AS seq, round(avg(abs(v::DOUBLE)), 5) AS probability, min(pos) AS start_sample, min(pos) + 24 AS end_sample FROM l GROUP BY source_id, pos // 24 HAVING count(*) = 24")


def turn_detector(spark, sf_dir):
    """A turn of eight rows: its context, audio, a request at the fourth and the eighth; turns of odd number have no audio before their first request."""
    rows = frames_events(spark, sf_dir, size=2).withColumns({"event": F.expr("CASE seq % 8 WHEN 0 THEN 'context' WHEN 3 THEN 'request' WHEN 7 THEN 'request' ELSE 'audio' END"), "session_id": F.lit("s"), "user_turn_id": F.floor(F.col("seq") / 8).cast("long") + 1, "request_id": F.col("seq"), "active": F.expr("seq % 24 <> 16")})
    return ordered_fold(rows, models.turn_detector(_mean_model, 4, 6, 0.2), models.TURN_ENDS).withColumn("probability", F.round("probability", 5))


_register("turn_detector", turn_detector, """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS source_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS idx, CAST(value / 1024.0 AS FLOAT) AS v, count(*) OVER (PARTITION BY user_id) AS k FROM events),
 q AS (SELECT source_id, idx // 2 AS seq, idx, v FROM e WHERE idx // 2 * 2 + 1 < k),
 r AS (SELECT DISTINCT source_id, seq FROM q WHERE seq % 8 IN (3, 7) AND seq // 8 * 8 % 24 <> 16),
 h AS (SELECT r.source_id, r.seq, list(q.v ORDER BY q.idx) AS held FROM r JOIN q ON q.source_id = r.source_id AND q.seq // 8 = r.seq // 8 AND q.seq < r.seq AND q.seq % 8 IN (1, 2, 4, 5, 6) GROUP BY ALL),
 m AS (SELECT source_id, seq, held[greatest(1, len(held) - 5):] AS held FROM h WHERE len(held) >= 4)
 SELECT source_id, seq, 's' AS session_id, seq // 8 + 1 AS user_turn_id, seq AS request_id, round(list_avg(list_transform(held, lambda x: abs(x)::DOUBLE)), 5) AS probability, list_avg(list_transform(held, lambda x: abs(x)::DOUBLE)) >= 0.2 AS is_end, len(held) AS n_samples FROM m""")


def _two_numbers():
    return lambda x, rate: [float(x.max()), float(x.min())]


_register("audio_embedding", lambda s, d: models.embeddings(frames_embeddings(s, d), _two_numbers, "extremes", 2).select("source_id", "seq", "model_id", *(F.round(F.get("embedding", k).cast("double"), 6).alias(f"e{k}") for k in range(2))),
          f"WITH {EMBEDDINGS_SQL} SELECT source_id, seq, 'extremes' AS model_id, round(list_max(samples)::DOUBLE, 6) AS e0, round(list_min(samples)::DOUBLE, 6) AS e1 FROM emb")


def _letters():
    return lambda text, voice: [len(text) / 1000, len(voice) / 1000]


def tts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ask = rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.concat(F.lit(" "), F.substring("text", 1, 2)).alias("text"), F.when(F.col("turn") % 2 == 0, "v").alias("voice_id"), F.lit(None).cast("string").alias("cache_key"), (F.col("turn") == 3).alias("play"), F.lit(0.0).alias("volume_db"))
    return models.speak(ask, _letters, 16000).select("request_id", "ok", "message", "hit", F.round(F.get("samples", 0).cast("double") * 1000).cast("long").alias("n_text"), F.round(F.get("samples", 1).cast("double") * 1000).cast("long").alias("n_voice"))


_register("tts_cache", tts, """WITH r AS (SELECT conv_id * 1000 + turn AS request_id, trim(' ' || substr(text, 1, 2)) AS t, CASE WHEN turn % 2 = 0 THEN 'v' ELSE 'default' END AS voice, turn = 3 AS play FROM conversations),
 m AS (SELECT *, CASE WHEN t = '' THEN 'text is empty' WHEN play THEN 'playback is not part of synthesis' ELSE 'ok' END AS message FROM r)
 SELECT request_id, message = 'ok' AS ok, message, message = 'ok' AND request_id <> min(CASE WHEN message = 'ok' THEN request_id END) OVER (PARTITION BY t, voice) AS hit, CASE WHEN message = 'ok' THEN length(t) END AS n_text, CASE WHEN message = 'ok' THEN length(voice) END AS n_voice FROM m""")


def _dialogue(spark, sf_dir):
    """A wake each sixth turn, speech of the user, quiet of the assistant, a tick after each, and now and then an answer to the first request."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    base = F.col("turn") * 4000
    common = [F.col("conv_id").cast("string").alias("source_id")]
    rest = [F.lit("wake").alias("keyword"), F.lit(0).cast("long").alias("stamp_ms"), F.lit("session-1").alias("session_id"), F.lit(1).cast("long").alias("user_turn_id"), F.lit(1).cast("long").alias("request_id"), F.lit(0.7).alias("probability")]
    event = lambda after, name: rows.select(*common, (base + after).alias("now_ms"), F.expr(name).alias("event"), *rest)
    events = event(0, "CASE WHEN turn % 6 = 0 THEN 'wake' ELSE 'tick' END").unionByName(event(100, "CASE WHEN role = 'user' THEN 'speech' ELSE 'quiet' END")).unionByName(event(1500, "'tick'")).unionByName(event(1600, "CASE WHEN conv_id % 2 = 0 THEN 'candidate' ELSE 'tick' END")).unionByName(event(3900, "'tick'"))
    return ordered_fold(events, stateful.dialogue(), stateful.DIALOGUE, order=("now_ms",))


_register("dialogue", _dialogue, """WITH RECURSIVE e0 AS (SELECT conv_id, turn * 4000 AS now, CASE WHEN turn % 6 = 0 THEN 'wake' ELSE 'tick' END AS ev FROM conversations UNION ALL SELECT conv_id, turn * 4000 + 100, CASE WHEN role = 'user' THEN 'speech' ELSE 'quiet' END FROM conversations
  UNION ALL SELECT conv_id, turn * 4000 + 1500, 'tick' FROM conversations UNION ALL SELECT conv_id, turn * 4000 + 1600, CASE WHEN conv_id % 2 = 0 THEN 'candidate' ELSE 'tick' END FROM conversations UNION ALL SELECT conv_id, turn * 4000 + 3900, 'tick' FROM conversations),
 e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY now) AS n FROM e0),
 f AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS now, '' AS sess, 1::BIGINT AS next_turn, 1::BIGINT AS next_req, 0::BIGINT AS turn, NULL::BIGINT AS since, false AS spoke, NULL::BIGINT AS quiet, 0::BIGINT AS pending, NULL::BIGINT AS checked, '' AS reason, 0::BIGINT AS shown FROM (SELECT DISTINCT conv_id FROM e)
  UNION ALL SELECT conv_id, n, now, CASE WHEN reason = 'wake' THEN 'session-1' ELSE sess END, next_turn + CASE WHEN reason = 'wake' THEN 1 ELSE 0 END, next_req + CASE WHEN reason = 'turn_end_requested' THEN 1 ELSE 0 END,
   CASE WHEN reason = 'wake' THEN next_turn WHEN ended THEN 0 ELSE turn END, CASE WHEN reason = 'wake' THEN now WHEN ended THEN NULL ELSE since END,
   CASE WHEN reason = 'wake' OR ended THEN false WHEN reason = 'speech_active' AND ev = 'speech' THEN true ELSE spoke END,
   CASE WHEN reason = 'wake' OR ended OR reason = 'speech_active' AND ev = 'speech' THEN NULL WHEN reason = 'quiet_started' THEN now ELSE quiet END,
   CASE WHEN reason = 'wake' OR ended OR reason IN ('quiet_started', 'td_not_end', 'speech_resumed') OR reason = 'speech_active' AND ev = 'speech' THEN 0 WHEN reason = 'turn_end_requested' THEN next_req ELSE pending END,
   CASE WHEN reason = 'wake' OR ended OR reason = 'quiet_started' OR reason = 'speech_active' AND ev = 'speech' THEN NULL WHEN reason = 'td_not_end' THEN quiet ELSE checked END,
   reason, CASE WHEN reason = 'wake' THEN next_turn ELSE turn END
  FROM (SELECT *, reason IN ('td_end', 'max_active_timeout', 'no_speech_timeout', 'quiet_fallback') AS ended FROM (
   SELECT *, CASE WHEN ev = 'wake' THEN CASE WHEN turn > 0 THEN 'turn_active' ELSE 'wake' END WHEN turn = 0 THEN 'turn_not_active' WHEN ev = 'speech' THEN 'speech_active'
     WHEN ev = 'quiet' THEN CASE WHEN NOT spoke THEN 'waiting_for_speech' WHEN quiet IS NOT NULL THEN 'quiet_continues' ELSE 'quiet_started' END
     WHEN ev = 'candidate' THEN CASE WHEN sess <> 'session-1' THEN 'session_mismatch' WHEN turn <> 1 THEN 'turn_mismatch' WHEN pending = 0 THEN 'no_pending_td_request' WHEN pending <> 1 THEN 'td_request_mismatch' WHEN quiet IS NULL THEN 'speech_resumed' WHEN now - since >= 3000 THEN 'td_end' ELSE 'td_not_end' END
     WHEN now - since >= 30000 THEN 'max_active_timeout' WHEN NOT spoke THEN CASE WHEN now - since >= 6000 THEN 'no_speech_timeout' ELSE 'waiting_for_speech' END WHEN quiet IS NULL THEN 'speech_active'
     WHEN now - since >= 3000 AND now - quiet >= 1200 AND pending = 0 AND checked IS DISTINCT FROM quiet THEN 'turn_end_requested' WHEN now - since >= 3000 AND now - quiet >= 3500 THEN 'quiet_fallback' ELSE 'waiting_for_end' END AS reason
   FROM (SELECT e.conv_id, e.n, e.now, e.ev, f.sess, f.next_turn, f.next_req, f.turn, f.since, f.spoke, f.quiet, f.pending, f.checked FROM f JOIN e ON e.conv_id = f.conv_id AND e.n = f.n + 1))))
 SELECT CAST(conv_id AS VARCHAR) AS source_id, now AS now_ms, sess AS session_id, shown AS turn, CASE WHEN reason IN ('td_end', 'max_active_timeout', 'no_speech_timeout', 'quiet_fallback') THEN 'ended' WHEN reason IN ('wake', 'quiet_started', 'td_not_end', 'turn_end_requested') OR reason = 'speech_active' AND now % 4000 = 100 THEN 'accepted' ELSE 'ignored' END AS kind,
   reason, CASE WHEN reason = 'turn_end_requested' THEN pending END AS request_id, CASE WHEN reason = 'wake' THEN 'start' WHEN reason IN ('td_end', 'max_active_timeout', 'no_speech_timeout', 'quiet_fallback') THEN 'stop' END AS asr FROM f WHERE n > 0""")


def playback(spark, sf_dir):
    """Lines of orders as frames for a sink; one of seven is a control or the device's answer."""
    event = "CASE l_linenumber WHEN 3 THEN 'done' WHEN 4 THEN 'stop' WHEN 6 THEN 'pause' WHEN 7 THEN 'done' ELSE 'frame' END"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").cast("long").alias("seq"), F.expr(event).alias("event"), (F.col("l_linenumber") % 2).cast("long").alias("epoch"))
    distinct = rows.groupBy("source_id", "seq").agg(F.max("event").alias("event"), F.max("epoch").alias("epoch"))
    return ordered_fold(distinct, stateful.playback(1), stateful.PLAYED).groupBy("event", "accepted", "message", "epoch", "paused", "depth").agg(F.count("*").alias("n"))


_register("playback_control", playback, """WITH RECURSIVE d0 AS (SELECT DISTINCT l_orderkey, l_linenumber AS seq FROM lineitem), d AS (SELECT *, CASE seq WHEN 3 THEN 'done' WHEN 4 THEN 'stop' WHEN 6 THEN 'pause' WHEN 7 THEN 'done' ELSE 'frame' END AS ev, seq % 2 AS ep, row_number() OVER (PARTITION BY l_orderkey ORDER BY seq) AS n FROM d0),
 f AS (SELECT l_orderkey, 0::BIGINT AS n, '' AS ev, true AS ok, '' AS msg, 0::BIGINT AS epoch, false AS paused, 0::BIGINT AS head, 0::BIGINT AS depth, false AS failed FROM (SELECT DISTINCT l_orderkey FROM d)
  UNION ALL SELECT l_orderkey, n, ev, msg IN ('ok', 'playback stopped', 'playback paused') OR msg LIKE 'played%', msg, epoch + CASE WHEN msg = 'playback stopped' THEN 1 ELSE 0 END, CASE WHEN msg = 'playback stopped' THEN false WHEN msg = 'playback paused' THEN true ELSE paused END,
   CASE WHEN msg = 'ok' THEN seq ELSE head END, CASE WHEN msg = 'ok' THEN 1 WHEN msg IN ('queue overflow', 'playback stopped') OR msg LIKE 'played%' THEN 0 ELSE depth END, failed OR msg = 'queue overflow'
  FROM (SELECT d.l_orderkey, d.n, d.ev, d.seq, f.epoch, f.paused, f.head, f.depth, f.failed, CASE WHEN f.failed THEN 'failed closed' WHEN d.ev = 'frame' THEN CASE WHEN d.ep < f.epoch THEN 'stale epoch' WHEN f.depth >= 1 THEN 'queue overflow' ELSE 'ok' END
    WHEN d.ev = 'done' THEN CASE WHEN f.paused THEN 'paused' WHEN f.depth = 0 THEN 'empty' ELSE 'played ' || f.head END WHEN d.ev = 'stop' THEN 'playback stopped' ELSE 'playback paused' END AS msg FROM f JOIN d ON d.l_orderkey = f.l_orderkey AND d.n = f.n + 1))
 SELECT ev AS event, ok AS accepted, msg AS message, epoch, paused, depth, count(*) AS n FROM f WHERE n > 0 GROUP BY ALL""")


def asr_partials(spark, sf_dir):
    """Partial texts (here the turns' first letters, those of every third turn blank) that are blank or repeat the one before are left out."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.when(F.col("turn") % 3 == 2, " ").otherwise(F.lower(F.substring("text", 1, 1)))
    return models.partial_dedup(rows.select("conv_id", "turn", text.alias("text")), "conv_id", "turn")


_register("asr_partial_dedup", asr_partials, "WITH t AS (SELECT conv_id, turn, lower(substr(text, 1, 1)) AS text FROM conversations WHERE turn % 3 <> 2 AND trim(substr(text, 1, 1)) <> '') SELECT conv_id, turn, text FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM t) WHERE prev IS NULL OR prev <> text")


def command_router(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("CASE event_id % 5 WHEN 0 THEN ' Start ' WHEN 1 THEN 'mode DICTATION' WHEN 2 THEN 'mode none' WHEN 3 THEN 'STOP' ELSE 'stop now' END").alias("text"))
    return commands.route(rows).groupBy("action", "mode", "ok").agg(F.count("*").alias("n"))


# what follows start, stop or status is let be; only a mode must be known
_register("command_router", command_router, "SELECT CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'mode' WHEN 3 THEN 'stop' WHEN 4 THEN 'stop' END AS action, CASE WHEN event_id % 5 = 1 THEN 'dictation' END AS mode, event_id % 5 <> 2 AS ok, count(*) AS n FROM events GROUP BY ALL")


def reject_counts(spark, sf_dir):
    return rejects(frames_events(spark, sf_dir, 256.0), "contract").groupBy("op", "reason").agg(F.count("*").alias("n"))


_register("reject_counters", reject_counts, f"WITH {EVENTS_SQL.replace('1024.0', '256.0')} SELECT 'contract' AS op, 'out of range' AS reason, count(*) AS n FROM ev WHERE NOT list_bool_and(list_transform(samples, lambda x: x BETWEEN -1 AND 1)) HAVING count(*) > 0")


# -- spectra ------------------------------------------------------------------
def _sums(df: DataFrame, *arrays: str) -> DataFrame:
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3).alias(c)
    return df.select("source_id", "seq", "frame", *map(total, arrays))


_register(
    "stft",
    lambda s, d: _sums(features.stft(frames_embeddings(s, d), 16, 8, "rectangular"), "re", "im"),
    f"""WITH {EMBEDDINGS_SQL}, k AS (SELECT source_id, seq, samples, unnest(range(0, 7)) AS frame FROM emb)
    SELECT source_id, seq, frame, round(list_sum(list_transform(range(0, 9), lambda b: (b + 1) * CAST(list_sum(list_transform(range(0, 16), lambda t: samples[frame * 8 + t + 1]::DOUBLE * cos(2 * pi() * b * t / 16))) AS FLOAT)::DOUBLE)), 3) + 0.0 AS re,
           round(list_sum(list_transform(range(0, 9), lambda b: -(b + 1) * CAST(list_sum(list_transform(range(0, 16), lambda t: samples[frame * 8 + t + 1]::DOUBLE * sin(2 * pi() * b * t / 16))) AS FLOAT)::DOUBLE)), 3) + 0.0 AS im FROM k""",
)
def _parts_sql(n: int, hop: int) -> str:
    """k: the parts of the embeddings' frames; z: their spectra under the Hann window as lists of magnitudes (m)."""
    count = (64 - n) // hop + 1
    w = f"(CAST(0.5 - 0.5 * cos(2 * pi() * t / {n - 1}) AS FLOAT))::DOUBLE"
    part = lambda f: f"list_sum(list_transform(range(0, {n}), lambda t: x[t + 1] * {f}(2 * pi() * b * t / {n})))"
    return f"""{EMBEDDINGS_SQL}, k AS (SELECT source_id, seq, frame, list_transform(range(0, {n}), lambda t: CAST(samples[frame * {hop} + t + 1] * CAST({w} AS FLOAT) AS FLOAT)::DOUBLE) AS x FROM (SELECT *, unnest(range(0, {count})) AS frame FROM emb)),
    z AS (SELECT source_id, seq, frame, list_transform(range(0, {n // 2 + 1}), lambda b: CAST(sqrt(pow({part("cos")}, 2) + pow({part("sin")}, 2)) AS FLOAT)) AS m FROM k)"""


def _mel_sql(n: int, mels: int, high: float = 8000.0) -> str:
    """fb: one row, the filters as a list of lists of weights."""
    edge = f"(700 * (pow(10, (2595 * log10(1 + {high} / 700) * (j) / {mels + 1}) / 2595) - 1))"
    e = lambda j: edge.replace("(j)", f"({j})")
    f = f"(b * 16000.0 / {n})"
    return f"""fb0 AS (SELECT list_transform(range(0, {mels}), lambda i: list_transform(range(0, {n // 2 + 1}), lambda b: (greatest(0, least(({f} - {e("i")}) / ({e("i + 1")} - {e("i")}), ({e("i + 2")} - {f}) / ({e("i + 2")} - {e("i + 1")}))) * 2 / ({e("i + 2")} - {e("i")})))) AS w0), fb AS (SELECT list_transform(w0, lambda f: list_transform(f, lambda v: CAST(v AS FLOAT)::DOUBLE)) AS w FROM fb0)"""


_weighted = lambda c: f"round(list_sum(list_transform({c}, lambda v, i: v * i)), 3) + 0.0"
_mels = "list_transform(w, lambda f: CAST(ln(greatest(list_sum(list_transform(f, lambda v, b: v * (m[b] * m[b])::DOUBLE)), 1e-10)) AS FLOAT)::DOUBLE)"
_register("log_mel", lambda s, d: _sums(features.log_mel(frames_embeddings(s, d), 32, 16, 8), "mel"), f"WITH {_parts_sql(32, 16)}, {_mel_sql(32, 8)}, q AS (SELECT source_id, seq, frame, {_mels} AS mel FROM z, fb) SELECT source_id, seq, frame, {_weighted('mel')} AS mel FROM q")
_register("mfcc", lambda s, d: _sums(features.mfcc(frames_embeddings(s, d), 32, 16, 8, 5), "mfcc"), f"""WITH {_parts_sql(32, 16)}, {_mel_sql(32, 8)}, q AS (SELECT source_id, seq, frame, {_mels} AS mel FROM z, fb),
    c AS (SELECT source_id, seq, frame, list_transform(range(0, 5), lambda k: CAST(list_sum(list_transform(mel, lambda v, i: v * cos(pi() * k * (2 * i - 1) / 16))) * sqrt(2 / 8.0) * CASE WHEN k = 0 THEN sqrt(0.5) ELSE 1 END AS FLOAT)::DOUBLE) AS c FROM q)
    SELECT source_id, seq, frame, {_weighted('c')} AS mfcc FROM c""")
# reflected ends: sample t of the padded frame is sample |t - 16| of the frame, mirrored again at its end
_turn = "list_transform(range(0, 32), lambda t: CAST(samples[CASE WHEN abs(frame * 16 + t - 16) > 63 THEN 126 - abs(frame * 16 + t - 16) ELSE abs(frame * 16 + t - 16) END + 1] * CAST(0.5 - 0.5 * cos(2 * pi() * t / 32) AS FLOAT) AS FLOAT)::DOUBLE)"
_spectrum = lambda f: f"list_sum(list_transform(range(0, 32), lambda t: x[t + 1] * {f}(2 * pi() * b * t / 32)))"
_register("smart_turn_mel", lambda s, d: _sums(features.smart_turn_mel(frames_embeddings(s, d), 32, 16, 8), "mel"), f"""WITH {EMBEDDINGS_SQL}, {_mel_sql(32, 8)}, k AS (SELECT source_id, seq, frame, {_turn} AS x FROM (SELECT *, unnest(range(0, 5)) AS frame FROM emb)),
    z AS (SELECT source_id, seq, frame, list_transform(range(0, 17), lambda b: pow({_spectrum("cos")}, 2) + pow({_spectrum("sin")}, 2)) AS m FROM k),
    q AS (SELECT source_id, seq, frame, list_transform(w, lambda f: log10(greatest(list_sum(list_transform(f, lambda v, b: v * m[b])), 1e-10))) AS mel FROM z, fb),
    t AS (SELECT *, max(list_max(mel)) OVER (PARTITION BY source_id, seq) - 8 AS low FROM q),
    o AS (SELECT source_id, seq, frame, list_transform(mel, lambda v: (greatest(v, low) + 4) / 4) AS mel FROM t)
    SELECT source_id, seq, frame, {_weighted('mel')} AS mel FROM o""")
_q = 1 / (2 ** (1 / 12) - 1)
_bins = [(k, 5000.0 * 2 ** (k / 12), math.ceil(_q * 16000 / (5000.0 * 2 ** (k / 12)))) for k in range(6)]
_kernel = lambda f: " UNION ALL ".join(f"SELECT source_id, seq, {k} AS k, list_sum(list_transform(range(0, {n}), lambda t: samples[{(64 - n) // 2} + t + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * t / {n - 1})) * {f}(2 * pi() * {hz!r} * t / 16000))) / sqrt(list_sum(list_transform(range(0, {n}), lambda t: pow(0.5 - 0.5 * cos(2 * pi() * t / {n - 1}), 2)))) AS v FROM emb" for k, hz, n in _bins)
_register("cqt", lambda s, d: _sums(features.cqt(frames_embeddings(s, d), 64, 64, 6, 12, 5000.0), "re", "im"), f"""WITH {EMBEDDINGS_SQL}, c AS ({_kernel("cos")}), s AS ({_kernel("sin")})
    SELECT source_id, seq, 0 AS frame, round(sum((k + 1) * CAST(c.v AS FLOAT)::DOUBLE), 3) + 0.0 AS re, round(sum((k + 1) * CAST(s.v AS FLOAT)::DOUBLE), 3) + 0.0 AS im FROM c JOIN s USING (source_id, seq, k) GROUP BY source_id, seq""")
_flux = lambda n, hop: f"{_parts_sql(n, hop)}, fl AS (SELECT source_id, seq, frame, CAST(list_sum(list_transform(m, lambda v, b: greatest(v - coalesce(pm[b], 0::FLOAT), 0::FLOAT)::DOUBLE)) AS FLOAT) AS flux FROM (SELECT *, lag(m) OVER (PARTITION BY source_id, seq ORDER BY frame) AS pm FROM z))"
_register("onset", lambda s, d: features.onset(frames_embeddings(s, d), 16, 8, 0.5, 0.001).withColumn("flux", F.round(F.col("flux").cast("double"), 4)), f"""WITH RECURSIVE {_flux(16, 8)},
    pk AS (SELECT *, flux >= 0.5 AND flux >= coalesce(lag(flux) OVER w, 0) AND flux >= coalesce(lead(flux) OVER w, 0) AS peak FROM fl WINDOW w AS (PARTITION BY source_id, seq ORDER BY frame)),
    f AS (SELECT source_id, seq, frame, flux, peak AS hit, CASE WHEN peak THEN frame ELSE -3 END AS last FROM pk WHERE frame = 0
          UNION ALL SELECT pk.source_id, pk.seq, pk.frame, pk.flux, pk.peak AND pk.frame - f.last > 2, CASE WHEN pk.peak AND pk.frame - f.last > 2 THEN pk.frame ELSE f.last END FROM f JOIN pk ON pk.source_id = f.source_id AND pk.seq = f.seq AND pk.frame = f.frame + 1)
    SELECT source_id, seq, frame, round(flux::DOUBLE, 4) AS flux, hit AS onset FROM f""")
_register("pitch", lambda s, d: features.pitch(frames_embeddings(s, d), 32, 16, 1000.0, 4000.0, 0.2).withColumns({"f0": F.round("f0", 4), "confidence": F.round("confidence", 5)}), f"""WITH {EMBEDDINGS_SQL}, k AS (SELECT source_id, seq, frame, samples[frame * 16 + 1 : frame * 16 + 32] AS s FROM (SELECT *, unnest(range(0, 3)) AS frame FROM emb)),
    c AS (SELECT source_id, seq, frame, list_transform(s, lambda v, t: CAST((v - CAST(list_avg(list_transform(s, lambda y: y::DOUBLE)) AS FLOAT)) * CAST(0.5 - 0.5 * cos(2 * pi() * (t - 1) / 31) AS FLOAT) AS FLOAT)::DOUBLE) AS p FROM k),
    r AS (SELECT source_id, seq, frame, list_sum(list_transform(p, lambda v: v * v)) AS e, list_transform(range(4, 17), lambda lag: list_sum(list_transform(range(1, 33 - lag), lambda t: p[t] * p[t + lag]))) AS r FROM c),
    b AS (SELECT *, list_max(r) AS top, list_position(r, list_max(r)) + 3 AS lag FROM r)
    SELECT source_id, seq, frame::INTEGER AS frame, round(16000.0 / lag, 4) AS f0, round(least(greatest(top / e, 0), 1), 5) AS confidence, least(greatest(top / e, 0), 1) >= 0.2 AS voiced FROM b""")
_register("tempo", lambda s, d: features.tempo(frames_embeddings(s, d), 16, 2, 40000.0, 250000.0, 0.05).select("source_id", "seq", F.round("bpm", 3).alias("bpm"), F.round("confidence", 4).alias("confidence"), "detected", F.array_join(F.transform("beats", lambda b: b.cast("int")), "").alias("beats")), f"""WITH {_flux(16, 2)},
    e AS (SELECT source_id, seq, list(flux::DOUBLE ORDER BY frame) AS f FROM fl GROUP BY source_id, seq), c AS (SELECT *, list_transform(f, lambda v: v - list_avg(f)) AS e FROM e),
    r AS (SELECT *, list_transform(range(2, 13), lambda lag: greatest(list_sum(list_transform(range(1, 26 - lag), lambda t: e[t] * e[t + lag])) / list_sum(list_transform(e, lambda v: v * v)), 0)) AS r FROM c),
    b AS (SELECT *, least(list_max(r), 1) AS share, list_position(r, list_max(r)) + 1 AS lag FROM r), a AS (SELECT *, list_position(f[1:lag], list_max(f[1:lag])) AS anchor FROM b)
    SELECT source_id, seq, CASE WHEN share >= 0.05 THEN round(60.0 * 16000 / (lag * 2), 3) ELSE 0 END AS bpm, round(share, 4) AS confidence, share >= 0.05 AS detected,
      array_to_string(list_transform(range(1, 26), lambda t: CASE WHEN share >= 0.05 AND t >= anchor AND (t - anchor) % lag = 0 THEN '1' ELSE '0' END), '') AS beats FROM a""")


# -- edges --------------------------------------------------------------------
def _wav_sums(files: DataFrame) -> DataFrame:
    """What reading the column ``wav`` gives: sizes, format and exact sums of the 16-bit samples."""
    schema = "source_id string, n_bytes long, rate int, channels int, n long, sum long, weighted long"
    kinds = stateful.arrow_schema(schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, rate, channels = pcm.read_wav(data)
                whole = np.round(x.astype(np.float64) * 32768).astype(np.int64)
                out.append((source, len(data), rate, channels, len(x), int(whole.sum()), int((whole * np.arange(1, len(x) + 1)).sum())))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in out], schema=kinds)

    return files.select("source_id", "wav").mapInArrow(run, schema)


def wav_record(spark, sf_dir):
    return _wav_sums(pcm.record_wav(frames_embeddings(spark, sf_dir)))


_SHORT = "(CASE WHEN v < 0 THEN v::DOUBLE * 32768 ELSE v::DOUBLE * 32767 END)"
_register("wav_record", wav_record, f"""WITH {EMBEDDINGS_SQL}, l AS (SELECT source_id, seq * 64 + i AS pos, samples[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM emb)),
q AS (SELECT source_id, pos, (sign({_SHORT}) * floor(abs({_SHORT}) + 0.5))::BIGINT AS x FROM l)
SELECT source_id, 44 + 2 * count(*) AS n_bytes, 16000 AS rate, 1 AS channels, count(*) AS n, sum(x)::BIGINT AS sum, sum(x * pos)::BIGINT AS weighted FROM q GROUP BY source_id""")


def record_clips(spark, sf_dir):
    """Recordings from a start at each tenth frame to a stop four frames later, as WAV bytes read back."""
    frames = frames_embeddings(spark, sf_dir)
    action = F.when(F.col("seq") % 10 == 2, "start").when(F.col("seq") % 10 == 5, "start").when(F.col("seq") % 10 == 6, "stop").when(F.col("seq") % 10 == 8, "stop")
    controls = frames.select("source_id", (F.col("arrival_ns") + 1).alias("arrival_ns"), action.alias("action"))
    made = pcm.record_wav(pcm.recorded(frames, controls))
    return _wav_sums(made.select(F.concat_ws("/", "source_id", "stream_id").alias("source_id"), "wav"))


# a control comes just after a frame: 3, 4, 5 and 6 of each ten are recorded
_register("record_clips", record_clips, f"""WITH {EMBEDDINGS_SQL}, r AS (SELECT source_id || '/emb-' || (seq // 10 + 1) AS source_id, seq % 10 - 3 AS k, samples FROM emb WHERE seq % 10 BETWEEN 3 AND 6),
l AS (SELECT source_id, k * 64 + i AS pos, samples[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM r)),
q AS (SELECT source_id, pos, (sign({_SHORT}) * floor(abs({_SHORT}) + 0.5))::BIGINT AS x FROM l)
SELECT source_id, 44 + 2 * count(*) AS n_bytes, 16000 AS rate, 1 AS channels, count(*) AS n, sum(x)::BIGINT AS sum, sum(x * pos)::BIGINT AS weighted FROM q GROUP BY source_id""")


def file_pipeline(spark, sf_dir):
    """PCM16 bytes in, checked, to float, gain 2, out as FLOAT32 bytes: exact sums of what is written."""
    wire = pcm.to_wire(frames_embeddings(spark, sf_dir), "PCM16LE")
    frames = pcm.from_wire(wire, stream_id="emb", encoding="PCM16LE", bit_depth=16, sample_rate=16000, channels=1, layout="interleaved")
    out = pcm.to_wire(pw.gain(frames, 2.0), "FLOAT32LE")
    back = pcm.from_wire(out, encoding="FLOAT32LE", bit_depth=32)
    return digest(back.join(out.select("source_id", "seq", F.octet_length("data").cast("long").alias("n_bytes")), ["source_id", "seq"]), "n_bytes")


_short_of = "(CASE WHEN x < 0 THEN x::DOUBLE * 32768 ELSE x::DOUBLE * 32767 END)"
_register("file_pipeline", file_pipeline, f"""WITH {EMBEDDINGS_SQL}, q AS (SELECT source_id, seq, list_transform(samples, lambda x: CAST(CAST(sign({_short_of}) * floor(abs({_short_of}) + 0.5) / 32768 AS FLOAT)::DOUBLE * 2 AS FLOAT)) AS samples FROM emb),
o AS (SELECT *, 4 * len(samples) AS n_bytes FROM q WHERE list_bool_and(list_transform(samples, lambda x: x BETWEEN -1 AND 1))) {digest_tail("o", "n_bytes, ")}""")


def refused_frames(spark, sf_dir):
    """Of frames in two encodings, those that a sink for one of them refuses."""
    frames = frames_embeddings(spark, sf_dir)
    both = pcm.to_wire(frames.filter("seq % 3 > 0"), "PCM16LE").unionByName(pcm.to_wire(frames.filter("seq % 3 = 0"), "FLOAT32LE", "planar"))
    odd = both.withColumn("data", F.when(F.col("seq") % 3 == 1, F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data")))
    return pcm.refused(odd, encoding="PCM16LE").groupBy("reason").agg(F.count("*").alias("n"))


_register("refused_frames", refused_frames, f"WITH {EMBEDDINGS_SQL} SELECT CASE WHEN seq % 3 = 0 THEN 'encoding differs' ELSE 'not frame aligned' END AS reason, count(*) AS n FROM emb WHERE seq % 3 < 2 GROUP BY 1")


def encode_media_time(spark, sf_dir):
    """Chunk numbers and media time begin anew with each generation; decoding gives the samples back."""
    import zlib

    frames = frames_events(spark, sf_dir).withColumn("generation", F.floor(F.col("seq") / 4))
    chunks = codec.encode_frames(frames, "deflate", zlib.compress)
    back = codec.decode_chunks(chunks, "deflate", zlib.decompress)
    return digest(back.join(chunks.select("source_id", "seq", "sequence", "media_time_ns", "duration_ns"), ["source_id", "seq"]), "sequence", "media_time_ns", "duration_ns")


_register("encode_media_time", encode_media_time, f"""WITH {EVENTS_SQL}, o AS (SELECT source_id, seq, list_transform(samples, lambda x: CAST(sign({_short_of}) * floor(abs({_short_of}) + 0.5) / 32768 AS FLOAT)) AS samples, seq % 4 AS sequence, (seq % 4) * 1000000 AS media_time_ns, 1000000 AS duration_ns FROM ev)
{digest_tail("o", "sequence, media_time_ns, duration_ns, ")}""")


def clip_archive(spark, sf_dir):
    """A range of every stream as an archived clip, its WAV bytes read back."""
    found = clips.clips(frames_embeddings(spark, sf_dir), 6_000_000, 26_000_001, "archive", reason="kept")
    about = found.select("source_id", "status", "start_ns", "stop_ns", "duration_ns", (F.sha2("wav", 256) == F.col("content_sha256")).alias("digest_ok"), F.regexp_replace("clip_id", "_[0-9a-f]{16}$", "").alias("name"))
    return about.join(_wav_sums(found), "source_id")


_register("clip_archive", clip_archive, f"""WITH {EMBEDDINGS_SQL}, l AS (SELECT source_id, seq * 64 + i - 1 AS pos, samples[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM emb)),
q AS (SELECT source_id, pos - 95 AS pos, (sign({_SHORT}) * floor(abs({_SHORT}) + 0.5))::BIGINT AS x FROM l WHERE pos >= 96 AND pos < 417)
SELECT source_id, 'ok' AS status, 6000000 AS start_ns, 6000000 + count(*) * 62500 AS stop_ns, count(*) * 62500 AS duration_ns, true AS digest_ok, 'archive_audio_window_window_epoch0_' || source_id || '_audio_6000000_' || (6000000 + count(*) * 62500) || '_pcm_s16le_wav_pcm16le' AS name,
44 + 2 * count(*) AS n_bytes, 16000 AS rate, 1 AS channels, count(*) AS n, sum(x)::BIGINT AS sum, sum(x * pos)::BIGINT AS weighted FROM q GROUP BY source_id""")

_register("wake_tone", lambda s, d: tones.wake_tone(s).select("i", F.round("v", 6).alias("v")), """WITH t AS (SELECT i, i / 48000.0::DOUBLE AS t, i / 12480.0::DOUBLE AS p FROM range(0, 12480) r(i)),
e AS (SELECT *, p * p * (3 - 2 * p) AS lift, least(1.0::DOUBLE, least(t, 0.26 - t) / 0.034) AS f FROM t),
w AS (SELECT *, f * f * (3 - 2 * f) AS env, sum(2 * pi() * (660 + 260 * lift) / 48000) OVER o AS low, sum(2 * pi() * (1320 + 91 * lift) / 48000) OVER o AS high FROM e WINDOW o AS (ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT i, round((sin(low) * 0.78 + sin(high) * 0.22) * env * (1 - 0.28 * lift) * 0.18, 6) AS v FROM w""")
