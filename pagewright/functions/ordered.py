"""Order-dependent totals over groups of any size.

A window over a whole group sorts that group in one task. Here the group is first summed
per span of positions, the window runs over the few spans, and a second window runs inside
each span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(
    df: DataFrame, keys: list[str], position: str, totals: dict[str, str], span: int
) -> DataFrame:
    """Add, per group and in order of the whole-number ``position``, the totals of all
    earlier rows. ``totals`` maps value columns to the new columns. ``position`` is unique
    within a group."""
    marked = df.withColumn("_span", F.floor(F.col(position) / span).cast("long"))
    per_span = marked.groupBy(*keys, "_span").agg(
        *[F.sum(value).alias(f"_of_{value}") for value in totals]
    )
    over_spans = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_span.select(
        *keys,
        "_span",
        *[
            F.coalesce(F.sum(f"_of_{value}").over(over_spans), F.lit(0)).alias(f"_before_{value}")
            for value in totals
        ],
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    out = marked.join(offsets, [*keys, "_span"])
    for value, name in totals.items():
        out = out.withColumn(
            name, F.col(f"_before_{value}") + F.coalesce(F.sum(value).over(inside), F.lit(0))
        )
    return out.drop("_span", *[f"_before_{value}" for value in totals])


def rows_at_positions(
    df: DataFrame, keys: list[str], order: str, wanted: DataFrame, span: int = 1024
) -> DataFrame:
    """Pick rows by their 0-based rank within a group, in order of the whole number ``order``.

    ``wanted`` has the keys and a ``position``; its size must be bounded by the caller, since
    it is broadcast. Only the spans that hold a wanted rank are ranked row by row.
    """
    marked = df.withColumn("_span", F.floor(F.col(order) / span).cast("long"))
    groups = F.broadcast(wanted.select(*keys).distinct())
    sizes = marked.join(groups, keys, "left_semi").groupBy(*keys, "_span").count()
    over_spans = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_first", F.coalesce(F.sum("count").over(over_spans), F.lit(0)))
    hits = (
        F.broadcast(wanted)
        .join(starts, keys)
        .filter((F.col("position") >= F.col("_first")) & (F.col("position") < F.col("_first") + F.col("count")))
        .select(*keys, "_span", "_first", "position")
    )
    inside = Window.partitionBy(*keys, "_span").orderBy(order)
    spans_hit = F.broadcast(hits.select(*keys, "_span").distinct())
    ranked = marked.join(spans_hit, [*keys, "_span"], "left_semi").withColumn(
        "_rank", F.row_number().over(inside) - 1
    )
    return (
        ranked.join(F.broadcast(hits), [*keys, "_span"])
        .filter(F.col("_first") + F.col("_rank") == F.col("position"))
        .drop("_span", "_first", "_rank")
    )
