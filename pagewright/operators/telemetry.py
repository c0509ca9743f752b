"""Roll-ups of the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.session import materialize


def timings() -> Column:
    """Milliseconds by stage, from the fields of an event."""
    return F.try_variant_get("fields", "$.timings_ms", "map<string,double>")


def exact_percentiles(
    rows: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 1024, few: int = 65_536
) -> DataFrame:
    """The keys, ``share`` and ``found``: the least value that at least ``share`` of a group's
    values do not exceed, exactly. Null values don't count; groups of nulls alone have no row.

    No task holds a group's values. Equal values are counted before the shuffle. Then the range
    that holds the wanted rank is cut into ``bins``, the bins are counted, and the one with the
    rank becomes the range, until it holds ``few`` different values at most; those are ranked.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v"))
    counted = materialize(counted.agg(F.count("*").alias("c")), "value-counts")
    sizes = counted.groupBy(*keys).agg(
        F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("different")
    )
    every = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n"))).cast("bigint").alias("rank")
    targets = sizes.select(*keys, "n", "lo", "hi", "different", every).select(*keys, "share", rank, "lo", "hi", "different")
    targets = materialize(targets, "percentile-ranges")
    by = [*keys, "share"]
    while True:
        wide = targets.filter(F.col("different") > few)
        if wide.isEmpty():
            break
        place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
        inside = counted.join(wide, keys).filter("v between lo and hi")
        binned = inside.groupBy(*by, "rank", F.least(place, F.lit(bins - 1)).alias("bin")).agg(
            F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("different")
        )
        so_far = F.sum("n").over(Window.partitionBy(*by).orderBy("bin"))  # of ``bins`` rows
        hit = binned.withColumn("so_far", so_far).filter((F.col("so_far") >= F.col("rank")) & (F.col("so_far") - F.col("n") < F.col("rank")))
        narrowed = hit.select(*by, (F.col("rank") - F.col("so_far") + F.col("n")).alias("rank"), "lo", "hi", "different")
        targets = materialize(targets.filter(F.col("different") <= few).unionByName(narrowed), "percentile-ranges")
    left = counted.join(targets, keys).filter("v between lo and hi")
    so_far = F.sum("c").over(Window.partitionBy(*by).orderBy("v"))  # of ``few`` rows
    return left.withColumn("so_far", so_far).filter("so_far >= rank").groupBy(*by).agg(F.min("v").alias("found"))


def stage_timings(events: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per event and stage: count, mean and percentiles of the stage's milliseconds.
    Percentiles are exact; with ``accuracy`` they come from a sketch of fixed size, which is
    off by up to 1 / ``accuracy`` of the events."""
    stages = events.select("event", F.explode(timings()).alias("stage", "ms"))
    sketched = accuracy is not None
    sums = stages.groupBy("event", "stage").agg(
        F.count("*").alias("events"),
        F.round(F.avg("ms"), 4).alias("mean_ms"),
        *([F.percentile_approx("ms", 0.5, accuracy).alias("p50_ms")] if sketched else []),
        *([F.percentile_approx("ms", 0.95, accuracy).alias("p95_ms")] if sketched else []),
        F.max("ms").alias("max_ms"),
    )
    if sketched:
        return sums
    # Event names may be null.
    exact = exact_percentiles(stages.withColumn("event", F.struct("event")), ["event", "stage"], "ms", [0.5, 0.95])
    exact = exact.groupBy(F.col("event.event").alias("event"), "stage").agg(
        F.max(F.when(F.col("share") == 0.5, F.col("found"))).alias("p50_ms"),
        F.max(F.when(F.col("share") == 0.95, F.col("found"))).alias("p95_ms"),
    )
    same = sums["event"].eqNullSafe(exact["event"]) & (sums["stage"] == exact["stage"])
    return sums.join(exact, same, "left").select(
        sums["event"], sums["stage"], "events", "mean_ms", "p50_ms", "p95_ms", "max_ms"
    )


# Events that end a question.
ABSTAINED_EVENTS = [
    "query_abstained_retrieval_threshold",
    "query_abstained_empty_context",
    "query_abstained_after_overview_fallback",
]
ANSWERED_EVENTS = ["query_generation_completed", "query_document_level_completed"]


def query_outcomes(events: DataFrame) -> DataFrame:
    """One row: finished questions, share abstained, and time in retrieval and generation."""
    done = events.filter(F.col("event").isin(ABSTAINED_EVENTS + ANSWERED_EVENTS))
    timing = timings()

    def total(stage: str):
        return F.round(F.coalesce(F.sum(F.try_element_at(timing, F.lit(stage))), F.lit(0.0)), 2)

    return done.agg(
        F.count("*").alias("questions"),
        F.count_if(F.col("event").isin(ABSTAINED_EVENTS)).alias("abstained"),
        F.round(F.avg(F.col("event").isin(ABSTAINED_EVENTS).cast("double")), 6).alias("abstention_rate"),
        total("retrieval_ms").alias("retrieval_ms"),
        total("generation_ms").alias("generation_ms"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event", "level").agg(
        F.count("*").alias("events"),
        F.round(F.avg(F.try_variant_get("fields", "$.latency_ms", "double")), 4).alias("mean_latency_ms"),
    )
