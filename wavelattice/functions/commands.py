"""Voice commands: ``start``, ``stop`` and ``status``, whatever follows them, and ``mode X``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("standby", "command", "dictation", "mute")


def parse(text: Column, modes: tuple[str, ...] = MODES) -> Column:
    """struct(action, mode, ok) of a command text."""
    words = F.split(F.regexp_replace(F.lower(text), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    action, mode = F.get(words, 0), F.replace(F.get(words, 1), F.lit("-"), F.lit("_"))
    simple = action.isin("start", "stop", "status")
    switch = (action == "mode") & (F.size(words) == 2) & mode.isin(*modes)
    ok = F.coalesce(simple | switch, F.lit(False))
    return F.struct(F.when(ok, action).alias("action"), F.when(switch, mode).alias("mode"), ok.alias("ok"))


def route(rows: DataFrame, text: str = "text", modes: tuple[str, ...] = MODES) -> DataFrame:
    return rows.withColumn("command", parse(F.col(text), modes)).select("*", "command.*").drop("command")
