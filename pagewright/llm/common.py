"""Durable intermediate tables and connected components, shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import scratch_path, ship_package


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps don't repeat the work,
    survive lost executors, and are planned with the true size."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(df: DataFrame) -> DataFrame:
    """Make the package importable in the Python workers of ``df``'s session."""
    ship_package(df.sparkSession)
    return df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning stars of the links of one task."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        links = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.record_batch(
            [pa.array([x for x, _ in links], pa.int64()), pa.array([r for _, r in links], pa.int64())], ["a", "b"]
        )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the links ``a``, ``b`` (whole numbers): one row per linked node,
    ``id`` and ``component``, the smallest node that can be reached.

    Links shrink to stars inside each task first; then every node's larger neighbours are
    linked to its smallest one, and its smaller neighbours likewise, in turn, until nothing
    changes. No group is gathered in one task.
    """
    schema = "a bigint, b bigint"
    # a > b throughout
    now = stored(edges.select("a", "b").mapInArrow(_forest, schema).distinct(), "links")
    for _ in range(rounds):
        # Stars only: every node sees one centre, and a centre sees itself.
        seen = now.select(F.col("a").alias("id"), "b").unionByName(now.select(F.col("b").alias("id"), "b"))
        labels = seen.groupBy("id").agg(F.min("b").alias("component"), F.max("b").alias("other"))
        if labels.filter("component != other").limit(1).count() == 0:
            return labels.drop("other")
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        sides = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(least, "a").select(F.explode(sides).alias("x")).select("x.a", "x.b")
        now = stored(small.filter("a != b").distinct(), "links")
    raise RuntimeError(f"components did not settle within {rounds} rounds")
