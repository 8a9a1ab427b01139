"""Event-condition-action rules over a stream (an extension: the batch semantics of reason.fire, window by window)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.functions.text import ngrams


def fired(events: DataFrame, triggers: DataFrame, window: str = "1 hour", late: str = "2 hours", least_overlap: int = 2) -> DataFrame:
    """(window, event_type, trigger, n) per tumbling window of a stream of events (ts, event_type).

    triggers (name, text) is a static table.  State is one counter per window, type and trigger; the watermark drops it
    `late` after the window's end.  An event of an older window is dropped."""
    grams = lambda c: F.array_distinct(ngrams(F.lower(c), 2))
    t = triggers.select(F.col("name").alias("trigger"), grams(F.col("text")).alias("tg")).withColumn("g", F.explode("tg"))
    e = events.withWatermark("ts", late).withColumn("eg", grams(F.col("event_type"))).withColumn("g", F.explode("eg"))
    # joined on single bigrams; the first shared one of a pair stands for the pair, so that it counts once
    j = e.join(t, "g").withColumn("both", F.array_intersect("eg", "tg")).where((F.size("both") >= least_overlap) & (F.col("g") == F.get("both", F.lit(0))))
    return j.groupBy(F.window("ts", window), "event_type", "trigger").agg(F.count(F.lit(1)).alias("n"))
