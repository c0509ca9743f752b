"""Documents whose pages arrive in parts, over several micro-batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.config import EngineConfig
from pagewright.operators.embedding import Embedder
from pagewright.plans.ingest import ingest
from pagewright.session import materialize, scratch_scope
from pagewright.sources.files_api import Files
from pagewright.sources.store import ChunkStore
from pagewright.streaming.ingest import stream_identity

WAITING = "upload_id string, document_id string, filename string, since int, newest timestamp"
DIFFER, MISSING = "DOCUMENT_PAGES_DIFFER", "DOCUMENT_PARTS_MISSING"


@dataclass(frozen=True)
class WaitingRoom:
    """Pages that came but whose document is not whole yet, below one folder: ``pages/batch=<n>``
    as they came, each written once, and ``waiting/<n>``, a narrow row per upload that still
    waits after micro-batch ``n``. Texts of a document are not state of a task; they are read
    again when its last page is there."""

    files: Files
    batch: int

    def path(self, kind: str, batch: int) -> str:
        return f"{self.files.root}/{kind}/batch={batch:012d}"

    def batches(self, kind: str) -> list[int]:
        return [int(name.partition("=")[2]) for name in self.files.names(kind)]

    def before(self, spark) -> DataFrame:
        """Who waited when this micro-batch began; the same when it is run again."""
        earlier = [n for n in self.batches("waiting") if n < self.batch]
        if not earlier:
            return spark.createDataFrame([], WAITING)
        return spark.read.schema(WAITING).parquet(self.path("waiting", max(earlier)))

    def pages(self, spark, since: int, schema) -> DataFrame:
        paths = [self.path("pages", n) for n in self.batches("pages") if since <= n <= self.batch]
        return spark.read.schema(schema).option("basePath", f"{self.files.root}/pages").parquet(*paths)

    def forget(self, since: int) -> None:
        """Drop what neither this micro-batch, run again, nor a later one reads."""
        for n in self.batches("pages"):
            if n < since:
                self.files.delete(f"pages/batch={n:012d}")
        for n in [n for n in self.batches("waiting") if n < self.batch][:-1]:
            self.files.delete(f"waiting/batch={n:012d}")


def _judged(pages: DataFrame, waiting: DataFrame, wait: str | None) -> DataFrame:
    """Per waiting upload: ``whole``, ``repeats``, and an ``error_code``. ``pages`` are narrow."""
    stated = F.coalesce(F.max("page_count"), F.max(F.when(F.col("last"), F.col("page_number"))))
    counted = pages.join(waiting.select("upload_id", "since"), "upload_id")
    # A page that came twice counts once; sums combine before the shuffle.
    counted = counted.filter(F.col("batch") >= F.col("since")).groupBy("upload_id", "page_number").agg(
        F.max("page_count").alias("page_count"), F.max("last").alias("last"), F.count("*").alias("n"),
        F.min("document_id").alias("least"), F.max("document_id").alias("most"),
    )
    counted = counted.groupBy("upload_id").agg(
        stated.alias("stated"), F.count("*").alias("pages"), F.max("page_number").alias("high"),
        (F.count_if(F.coalesce("page_number", F.lit(0)) < 1) > 0).alias("unplaced"), (F.max("n") > 1).alias("repeats"),
        (F.min("least") != F.max("most")).alias("mixed"),
    )
    wrong = F.col("unplaced") | F.col("mixed") | F.coalesce(F.col("high") > F.col("stated"), F.lit(False))
    code = F.when(wrong, F.lit(DIFFER))
    whole = F.col("stated").isNotNull() & (F.col("pages") == F.col("stated"))
    judged = waiting.join(counted, "upload_id")
    if wait is not None:
        clock = waiting.agg(F.max("newest")).first()[0]
        late = F.col("newest") < F.lit(clock).cast("timestamp") - F.expr(f"interval {wait}")
        code = F.when(wrong, F.lit(DIFFER)).when(~whole & late, F.lit(MISSING))
    code = code.alias("error_code")
    return judged.select(*waiting.columns, "pages", "repeats", code, whole.alias("whole"))


def _each_once(pages: DataFrame) -> DataFrame:
    """Of pages that came several times the first; of several in one micro-batch the least text."""
    rest = [c for c in pages.columns if c not in ("upload_id", "page_number")]
    first = F.min_by(F.struct(*rest), F.struct("batch", "text")).alias("_first")
    return pages.groupBy("upload_id", "page_number").agg(first).select("upload_id", "page_number", "_first.*")


def _refusals(uploads: DataFrame) -> DataFrame:
    none = F.lit(0)
    return uploads.select(
        F.col("upload_id"), "document_id", "filename", F.col("pages").cast("int").alias("page_count"),
        none.alias("empty_page_count"), none.alias("chunk_count"), none.alias("indexed_count"),
        F.lit("rejected").alias("status"), F.col("error_code").alias("message"), "error_code",
    )


def ingest_parts_stream(
    pages: DataFrame,
    store: ChunkStore,
    checkpoint: str,
    reports: str,
    embedder: Embedder | None = None,
    cfg: EngineConfig | None = None,
    wait: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Ingest each upload once all its pages came, in whatever order and micro-batches.

    ``pages`` has ``document_id``, ``filename``, ``page_number`` and ``text``; how many pages
    there are is told by ``page_count`` on any page (the largest counts), or by ``last``, true on the last one.
    ``upload_id`` (default: the document) tells uploads of one document apart, and ``sent_at``
    is when the page was sent.

    Results by case: a page that comes twice counts once. An upload with a page beyond the stated
    count, below 1 or without number, or of two documents, is refused with DOCUMENT_PAGES_DIFFER, and so are pages that
    come after their upload was reported. With ``wait`` (such as "2 hours") an upload whose newest
    page is older by that than the newest page of all that wait is refused with
    DOCUMENT_PARTS_MISSING; without it, or without ``sent_at``, it waits on. Pages without
    upload or document id cannot be put together: one row of the report refuses them.

    A micro-batch that runs again gives what it gave: it reads who waited before it and reports
    of earlier ones only, and its batch has its own name in the store.
    """
    spark = store.spark
    identity = stream_identity(spark, checkpoint)
    if "upload_id" not in pages.columns:
        pages = pages.withColumn("upload_id", F.col("document_id"))
    for name, kind in (("page_count", "int"), ("last", "boolean"), ("sent_at", "timestamp")):
        pages = pages.withColumn(name, F.col(name).cast(kind) if name in pages.columns else F.lit(None).cast(kind))
    known = ["upload_id", "document_id", "filename", "page_number", "text", "page_count", "last", "sent_at"]
    pages = pages.withColumn("upload_id", F.col("upload_id").cast("string")).select(*known)
    narrow = ["upload_id", "document_id", "page_number", "page_count", "last", "batch"]
    told = Files(spark, reports)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        name = f"stream-{identity}-{batch_id:012d}"
        room = WaitingRoom(Files(spark, f"{checkpoint.rstrip('/')}-parts"), batch_id)
        with scratch_scope(spark):
            batch.write.mode("overwrite").parquet(room.path("pages", batch_id))
            came = spark.read.schema(batch.schema).parquet(room.path("pages", batch_id))
            uploads = came.groupBy("upload_id").agg(
                F.min("document_id").alias("document_id"), F.min("filename").alias("filename"),
                F.max("sent_at").alias("newest"), F.count("*").alias("pages"), F.count_if(F.col("document_id").isNull()).alias("unnamed"),
            )
            uploads = materialize(uploads, "uploads-of-parts")
            refused = [uploads.filter("upload_id is null or unnamed > 0").withColumn("error_code", F.lit(DIFFER))]
            uploads = uploads.filter("upload_id is not null and unnamed = 0")
            done = [n for n in told.names("") if n.startswith(f"stream-{identity}-") and n < name]
            if done:
                ended = spark.read.parquet(*[f"{reports}/{n}" for n in done]).select("upload_id").filter("upload_id is not null")
                refused.append(uploads.join(ended, "upload_id", "left_semi").withColumn("error_code", F.lit(DIFFER)))
                uploads = uploads.join(ended, "upload_id", "left_anti")
            before = room.before(spark)
            both = before.unionByName(
                uploads.select("upload_id", "document_id", "filename", F.lit(batch_id).alias("since"), "newest")
            )
            waiting = both.groupBy("upload_id").agg(
                *[F.min(c).alias(c) for c in ("document_id", "filename", "since")], F.max("newest").alias("newest")
            )
            waiting = materialize(waiting, "waiting")
            oldest = waiting.agg(F.min("since")).first()[0]
            oldest = batch_id if oldest is None else oldest
            kept = room.pages(spark, oldest, f"{_ddl(came)}, batch int")
            judged = materialize(_judged(kept.select(*narrow), waiting, wait), "judged-parts")
            ready = judged.filter("error_code is null and whole").select("upload_id", "since", "repeats")
            found = kept.join(ready, "upload_id").filter("batch >= since")
            whole = found.filter("not repeats").unionByName(_each_once(found.filter("repeats")).select(*found.columns))
            report = ingest(whole.drop("page_count", "last", "sent_at", "batch", "since", "repeats"), store, embedder, cfg, name)
            refused.append(judged.filter("error_code is not null"))
            for part in refused:
                report = report.unionByName(_refusals(part))
            left = judged.filter("error_code is null and not whole").select(*waiting.columns)
            left.write.mode("overwrite").parquet(room.path("waiting", batch_id))
            report.write.mode("overwrite").parquet(f"{reports}/{name}")
            room.forget(oldest)

    return (
        pages.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
