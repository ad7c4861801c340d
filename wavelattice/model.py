"""The frame record, its contract, and views of relational tables as frames.

A frame is one row: identity (source_id, stream_id), order (seq, generation),
event and arrival time in nanoseconds, format, and ``samples`` in [-1, 1].
The views are synthetic stand-ins: the tables hold no audio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME = "source_id string, stream_id string, seq long, generation long, stamp_ns long, arrival_ns long, sample_rate int, channels int, samples array<float>"


def valid(samples: Column | str = "samples", channels: Column | str = "channels", ranged: bool = True) -> Column:
    """The contract: not empty, whole sample frames, finite, in [-1, 1]."""
    s = F.col(samples) if isinstance(samples, str) else samples
    c = F.col(channels) if isinstance(channels, str) else channels
    inside = (lambda x: x.between(-1.0, 1.0)) if ranged else (lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(s) > 0) & (F.size(s) % c == 0) & F.forall(s, inside), F.lit(False))


def accepted(frames: DataFrame, ranged: bool = True) -> DataFrame:
    return frames.filter(valid(ranged=ranged))


def rejects(frames: DataFrame, op: str, ranged: bool = True) -> DataFrame:
    """(op, source_id, seq, reason) of the frames the contract turns away."""
    s = F.col("samples")
    reason = (
        F.when(s.isNull() | (F.size(s) == 0), "empty")
        .when(F.size(s) % F.col("channels") != 0, "not frame aligned")
        .when(F.exists(s, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .otherwise("out of range")
    )
    return frames.filter(~valid(ranged=ranged)).select(F.lit(op).alias("op"), "source_id", "seq", reason.alias("reason"))


def refused_by(frames: DataFrame, out: DataFrame, op: str, ranged: bool = True) -> DataFrame:
    """(op, source_id, seq, reason) of the frames that an operator of one frame to one turned away, by the contract or by its own result."""
    inside = accepted(frames, ranged).join(out.select("source_id", "stream_id", "seq"), ["source_id", "stream_id", "seq"], "left_anti")
    return rejects(frames, op, ranged).unionByName(inside.select(F.lit(op).alias("op"), "source_id", "seq", F.lit("result").alias("reason")))


def frames_embeddings(spark: SparkSession, sf_dir: str, channels: int = 1) -> DataFrame:
    """One frame per embedding, ordered by vec_id within its label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    seq = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1
    return rows.select(
        F.col("label").cast("string").alias("source_id"), F.lit("emb").alias("stream_id"), seq.alias("seq"), F.lit(0).cast("long").alias("generation"),
        F.col("embedding").cast("array<float>").alias("samples"),
    ).select(
        "source_id", "stream_id", "seq", "generation", (F.col("seq") * 4_000_000).alias("stamp_ns"), (F.col("seq") * 4_000_000 + 1_000_000).alias("arrival_ns"),
        F.lit(16000).alias("sample_rate"), F.lit(channels).alias("channels"), "samples",
    )


def frames_events(spark: SparkSession, sf_dir: str, scale: float = 1024.0, size: int = 16) -> DataFrame:
    """``size`` consecutive events of a user are a frame; a shorter rest is left out."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    cut = rows.select("user_id", at.alias("at"), (F.col("value") / scale).cast("float").alias("v"))
    packed = cut.groupBy("user_id", F.floor(F.col("at") / size).alias("seq")).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("p")).filter(F.size("p") == size)
    return packed.select(
        F.col("user_id").cast("string").alias("source_id"), F.lit("ev").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.lit(0).cast("long").alias("generation"),
        (F.col("seq") * 1_000_000).cast("long").alias("stamp_ns"), (F.col("seq") * 1_000_000 + 500_000).cast("long").alias("arrival_ns"),
        F.lit(16000).alias("sample_rate"), F.lit(1).alias("channels"), F.col("p.v").alias("samples"),
    )


def digest(frames: DataFrame, *more: str) -> DataFrame:
    """A frame's samples as numbers that compare well: count, sum, index-weighted sum (no negative zeros), and an exact sum.

    ``exact`` takes each sample times 2 ** 24, rounded down, times its place:
    two frames agree in it only if their samples do, but for errors below
    2 ** -24 that cross no boundary.
    """
    s = F.col("samples")
    add = lambda a, x: a + x.cast("double")
    return frames.select(
        "source_id", "seq", *more, F.size(s).cast("long").alias("n"),
        (F.round(F.aggregate(s, F.lit(0.0), add), 4) + 0.0).alias("total"),
        (F.round(F.aggregate(F.transform(s, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), add), 3) + 0.0).alias("weighted"),
        F.aggregate(F.transform(s, lambda x, i: F.floor(x.cast("double") * 16777216.0).cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("exact"),
    )


EMBEDDINGS_SQL = "emb AS (SELECT CAST(label AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, CAST(embedding AS FLOAT[]) AS samples FROM embeddings)"
EVENTS_SQL = (
    "ev0 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, CAST(value / 1024.0 AS FLOAT) AS v FROM events), "
    "ev AS (SELECT CAST(user_id AS VARCHAR) AS source_id, pos // 16 AS seq, list(v ORDER BY pos) AS samples FROM ev0 GROUP BY user_id, pos // 16 HAVING count(*) = 16)"
)


def digest_tail(rows: str, more: str = "") -> str:
    """DuckDB SQL: the digest of rows (source_id, seq, samples)."""
    return f"""SELECT source_id, seq, {more}len(samples) AS n, round(list_sum(list_transform(samples, lambda x: x::DOUBLE)), 4) + 0.0 AS total,
           round(list_sum(list_transform(samples, lambda x, i: x::DOUBLE * i)), 3) + 0.0 AS weighted,
           list_sum(list_transform(samples, lambda x, i: i * floor(x::DOUBLE * 16777216)::BIGINT))::BIGINT AS exact FROM {rows}"""


def digest_sql(samples: str, of: str = "emb", where: str = "true", more: str = "") -> str:
    """DuckDB SQL: the digest of an expression over the frames of a view."""
    view = EMBEDDINGS_SQL if of == "emb" else EVENTS_SQL
    return f"""WITH {view}, o AS (SELECT * REPLACE ({samples} AS samples) FROM {of} WHERE {where})
    {digest_tail("o", more)} WHERE list_bool_and(list_transform(samples, lambda x: x BETWEEN -1 AND 1))"""
