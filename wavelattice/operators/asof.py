"""As-of combination of several inputs.

No relational join: inputs are united, and the latest value of each side is
carried forward over arrival order (``last`` ignoring nulls), one window per
key. Ages are whole milliseconds, truncated toward zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import accepted
from .pointwise import rms


def _latest(master: DataFrame, others: list[DataFrame], key: str = "source_id") -> DataFrame:
    """Rows of ``master`` (x) with o0, o1, ...: the newest frame of each other input that arrived no later, of the same rate and channels."""
    frame = F.struct("stamp_ns", "arrival_ns", "seq", "sample_rate", "channels", "samples")
    sides = [master.select(key, "stream_id", "arrival_ns", F.lit(len(others)).alias("side"), frame.alias("x"))]
    sides += [o.select(key, "stream_id", "arrival_ns", F.lit(k).alias("side"), frame.alias("x")) for k, o in enumerate(others)]
    united = reduce(DataFrame.unionByName, sides)
    order = Window.partitionBy(key).orderBy("arrival_ns", "side", "x.seq").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(len(others)):
        united = united.withColumn(f"o{k}", F.last(F.when(F.col("side") == k, F.col("x")), ignorenulls=True).over(order))
    rows = united.filter(F.col("side") == len(others))
    for k in range(len(others)):
        same = (F.col(f"o{k}.sample_rate") == F.col("x.sample_rate")) & (F.col(f"o{k}.channels") == F.col("x.channels"))
        rows = rows.withColumn(f"o{k}", F.when(same, F.col(f"o{k}")))
    return rows


def _age_ms(newer: str, older: str) -> Column:
    return F.expr(f"({newer} - {older}) div 1000000")


def _inside(samples: Column) -> Column:
    return F.forall(samples, lambda v: v.between(-1.0, 1.0))


def _scaled(name: str, gain: float) -> Column:
    return F.transform(F.col(f"{name}.samples"), lambda v: (v.cast("double") * gain).cast("float"))


def mix(inputs: list[DataFrame], gains_db: list[float], max_age_ms: int = 60, master: int = 0) -> DataFrame:
    """Sum of every input at the master's pace, in input order; all must be fresh by stamp."""
    frames = [accepted(f) for f in inputs]
    others = [f for k, f in enumerate(frames) if k != master]
    rows = _latest(frames[master], others)
    place = iter(range(len(others)))
    names = ["x" if k == master else f"o{next(place)}" for k in range(len(frames))]
    total = None
    for name, db in zip(names, gains_db, strict=True):
        part = _scaled(name, 10 ** (db / 20))
        total = part if total is None else F.zip_with(total, part, lambda a, b: (a + b).cast("float"))
    for k in range(len(others)):
        rows = rows.filter(f"o{k} IS NOT NULL AND size(o{k}.samples) = size(x.samples)").filter(_age_ms("x.stamp_ns", f"o{k}.stamp_ns").between(0, max_age_ms))
    seqs = [F.col(f"{n}.seq") for n in names]
    seq = F.greatest(*seqs) if len(seqs) > 1 else seqs[0]
    out = rows.select("source_id", F.col("x.seq").alias("master_seq"), seq.alias("seq"), total.alias("samples"))
    return out.filter(_inside(F.col("samples")))


def monitor_mix(inputs: list[DataFrame], gains_db: list[float], max_age_ms: int = 100) -> DataFrame:
    """Like :func:`mix`, but ages by arrival and the range is checked after each addition, master first."""
    frames = [accepted(f) for f in inputs]
    rows = _latest(frames[0], frames[1:])
    total = _scaled("x", 10 ** (gains_db[0] / 20))
    good = _inside(total)
    for k in range(len(frames) - 1):
        rows = rows.filter(f"o{k} IS NOT NULL AND size(o{k}.samples) = size(x.samples)").filter(_age_ms("x.arrival_ns", f"o{k}.arrival_ns").between(0, max_age_ms))
        total = F.zip_with(total, _scaled(f"o{k}", 10 ** (gains_db[k + 1] / 20)), lambda a, b: (a + b).cast("float"))
        good = good & _inside(total)
    return rows.filter(good).select("source_id", F.col("x.seq").alias("seq"), total.alias("samples"))


def aec_linear(mic: DataFrame, ref: DataFrame, gain: float = 1.0, timeout_ms: int = 200) -> DataFrame:
    """Microphone minus ``gain`` times the latest reference; without a fresh one of equal length the frame goes."""
    rows = _latest(accepted(mic), [accepted(ref)]).filter("o0 IS NOT NULL AND size(o0.samples) = size(x.samples)")
    rows = rows.filter(_age_ms("x.stamp_ns", "o0.stamp_ns").between(0, timeout_ms))
    out = F.zip_with("x.samples", "o0.samples", lambda a, b: (a.cast("double") - b.cast("double") * gain).cast("float"))
    return rows.select("source_id", F.col("x.seq").alias("seq"), out.alias("samples")).filter(_inside(F.col("samples")))


def sidechain_level(program: DataFrame, side: DataFrame, max_age_ms: int = 100) -> DataFrame:
    """Program frames with ``level``: RMS of the latest side frame by arrival; null if there is none, or it is invalid or older (in nanoseconds) than allowed."""
    rows = _latest(accepted(program), [side])
    age = F.col("x.arrival_ns") - F.col("o0.arrival_ns")
    fresh = age.between(0, max_age_ms * 1_000_000) & (F.size("o0.samples") > 0) & _inside(F.col("o0.samples"))
    return rows.select("source_id", "stream_id", *(F.col(f"x.{c}").alias(c) for c in ("seq", "sample_rate", "channels", "samples")), F.when(fresh, rms(F.col("o0.samples"))).alias("level"))


def crossfade(a: DataFrame, b: DataFrame, overlap: int = 1600, curve: str = "linear") -> DataFrame:
    """Pairs of equal seq joined over ``overlap`` samples; mono."""
    if overlap <= 0 or curve not in ("linear", "equal_power"):
        raise ValueError("crossfade parameters are out of range")
    left = accepted(a).select("source_id", "seq", F.col("samples").alias("a"))
    rows = left.join(accepted(b).select("source_id", "seq", F.col("samples").alias("b")), ["source_id", "seq"])
    rows = rows.filter((F.size("a") >= overlap) & (F.size("b") >= overlap))
    p = lambda i: (i + 1) / F.lit(overlap + 1.0)
    up = p if curve == "linear" else (lambda i: F.sin(p(i) * 1.5707963267948966))
    down = (lambda i: 1 - p(i)) if curve == "linear" else (lambda i: F.cos(p(i) * 1.5707963267948966))
    tail, head = F.slice("a", F.size("a") - overlap + 1, F.lit(overlap)), F.slice("b", 1, overlap)
    both = F.transform(F.arrays_zip(tail.alias("x"), head.alias("y")), lambda z, i: (z["x"].cast("double") * down(i) + z["y"].cast("double") * up(i)).cast("float"))
    joined = F.concat(F.slice("a", F.lit(1), F.size("a") - overlap), both, F.slice("b", F.lit(overlap + 1), F.size("b") - overlap))
    return rows.select("source_id", "seq", joined.alias("samples")).filter(_inside(F.col("samples")))


def vad_gate(audio: DataFrame, vad: DataFrame, max_age_ms: int = 500, default: bool = False) -> DataFrame:
    """Audio with ``active``: the latest voice decision by arrival, or the default when it is old or missing."""
    rows = audio.select("source_id", "arrival_ns", "seq", F.lit(1).alias("side"), F.lit(None).cast("boolean").alias("v"))
    rows = rows.unionByName(vad.select("source_id", "arrival_ns", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("side"), F.col("active").alias("v")))
    order = Window.partitionBy("source_id").orderBy("arrival_ns", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("arrival_ns", "v")), ignorenulls=True).over(order)
    rows = rows.withColumn("last", last).filter("side = 1")
    fresh = _age_ms("arrival_ns", "last.arrival_ns") <= max_age_ms
    return rows.select("source_id", "seq", F.coalesce(F.when(fresh, F.col("last.v")), F.lit(default)).alias("active"))


def turn_correlation(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """Turn ends that answer a request: equal session, user turn and request."""
    return requests.join(ends, ["session_id", "user_turn_id", "request_id"])
