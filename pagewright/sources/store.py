"""The chunk table: append-only batches of parquet made visible by a manifest.

Layout below the root folder::

    chunks/folder=<folder>/  one directory per attempt to write a batch, a folder per bucket of
                           document ids inside
    documents/<folder>/    the directory of the batch: a row per document, with its bucket
    tombstones/<folder>/   ids of documents deleted, or unusable, at one version
    rejected/<folder>/     documents of a batch that were not stored, with their codes
    manifest/<version>     one JSON line per change, published last and at once
    checkpoints/<version>  the whole snapshot, every ``CHECKPOINT_EVERY`` changes

A reader takes the newest checkpoint and the lines after it, and so sees one consistent
version. A batch that fails before its line is never seen. Of two writers of one version the
second finds its name taken, looks at the new version, and tries again. ``vacuum`` removes
what no reader of the current version needs.

Whatever asks for documents, not texts, reads the directory alone: which ids are stored, how
many chunks and pages they have, where they lie. Chunks of given documents are then read from
their folders and buckets only, and a few ids are pushed down to the row groups, which are
sorted by document.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagewright.functions.vectors import is_finite_vector
from pagewright.operators.embedding import document_vector_errors
from pagewright.schemas import DIRECTORY, STORED_CHUNK, STORED_COLUMNS
from pagewright.session import materialize
from pagewright.sources.files_api import Files

REJECTED = "document_fingerprint string, error_code string"
PLACED = StructType([*STORED_CHUNK.fields, StructField("folder", StringType()), StructField("bucket", IntegerType())])
EMPTY_RULE = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
BUCKETS = 16
PUSHED_IDS = 256
CHECKPOINT_EVERY = 32
ATTEMPTS = 20


class StoreError(RuntimeError):
    def __init__(self, code: str, details: dict[str, object]):
        super().__init__(f"{code}: {json.dumps(details, sort_keys=True)}")
        self.code = code
        self.details = details


@dataclass(frozen=True)
class Snapshot:
    """What a reader needs to know of one version. ``batches`` has version, name and folder of
    each batch, ``tombstones`` version and folder, ``refusals`` batch name and folder; ``names``
    are all batches committed since the last reset, also those that ``compact`` merged."""

    version: int = 0
    batches: tuple[tuple[int, str, str], ...] = ()
    tombstones: tuple[tuple[int, str], ...] = ()
    refusals: tuple[tuple[str, str], ...] = ()
    dimension: int | None = None
    names: tuple[str, ...] = ()

    def after(self, line: dict) -> Snapshot:
        """The snapshot once a manifest line is applied."""
        snap = replace(self, version=line["version"])
        if line["action"] in ("reset", "compact"):
            snap = Snapshot(line["version"])
            if line["action"] == "compact":
                snap = replace(snap, refusals=self.refusals, names=self.names)
        if line.get("rows"):
            snap = replace(
                snap,
                batches=(*snap.batches, (snap.version, line["batch"], line["folder"])),
                dimension=line["dimension"],
                names=(*snap.names, line["batch"]) if line["action"] == "append" else snap.names,
            )
        if line.get("tombstone"):
            snap = replace(snap, tombstones=(*snap.tombstones, (snap.version, line["tombstone"])))
        if line.get("rejected"):
            snap = replace(snap, refusals=(*snap.refusals, (line["batch"], line["rejected"])))
        return snap


def insert_if_absent(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New chunks whose id is not stored yet, each id once."""
    return new.dropDuplicates(["chunk_id"]).join(existing.select("chunk_id"), "chunk_id", "left_anti")


def count_mismatches(written: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents whose stored number of chunks is not the expected one."""
    actual = written.groupBy("document_fingerprint").agg(F.count("*").alias("actual"))
    wanted = expected.groupBy("document_fingerprint").agg(F.count("*").alias("expected"))
    return (
        wanted.join(actual, "document_fingerprint", "full_outer")
        .select(
            "document_fingerprint",
            F.coalesce("expected", F.lit(0)).alias("expected"),
            F.coalesce("actual", F.lit(0)).alias("actual"),
        )
        .filter(F.col("expected") != F.col("actual"))
        .withColumn("error_code", F.lit("INDEX_COUNT_MISMATCH"))
    )


class ChunkStore:
    """``buckets`` is the number of folders that a writer deals documents to; readers take it from
    the directory, so it may change from batch to batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self._files = Files(spark, self.root)

    # -- manifest ---------------------------------------------------------------

    def snapshot(self) -> Snapshot:
        snap = Snapshot()
        saved = self._files.names("checkpoints")
        if saved:
            told = json.loads(self._files.read(f"checkpoints/{saved[-1]}"))
            lists = {k: tuple(map(tuple, told[k])) for k in ("batches", "tombstones", "refusals")}
            snap = Snapshot(told["version"], dimension=told["dimension"], names=tuple(told.get("names", ())), **lists)
        for name in self._files.names("manifest"):
            if int(name) > snap.version:
                snap = snap.after(json.loads(self._files.read(f"manifest/{name}")))
        return snap

    def _commit(self, snap: Snapshot, action: str, **values) -> int | None:
        """Publish the change that follows ``snap``; none if another writer was first."""
        line = {"version": snap.version + 1, "action": action, **values}
        if not self._files.write_new(f"manifest/{line['version']:012d}", json.dumps(line)):
            return None
        if line["version"] % CHECKPOINT_EVERY == 0:
            self._files.write_new(f"checkpoints/{line['version']:012d}", json.dumps(asdict(snap.after(line))))
        return line["version"]

    def _retried(self, change) -> int:
        for _ in range(ATTEMPTS):
            version = change(self.snapshot())
            if version is not None:
                return version
        raise StoreError("STORE_BUSY", {"attempts": ATTEMPTS})

    def vacuum(self) -> list[str]:
        """Remove folders that the current version does not use, and manifest lines that its
        checkpoint covers. No reader of an older version, and no writer, may be at work."""
        snap = self.snapshot()
        used = {
            "chunks": {f"folder={folder}" for _, _, folder in snap.batches},
            "documents": {folder for _, _, folder in snap.batches},
            "tombstones": {folder for _, folder in snap.tombstones},
            "rejected": {folder for _, folder in snap.refusals},
        }
        if snap.version:
            name = f"{snap.version:012d}"
            self._files.write_new(f"checkpoints/{name}", json.dumps(asdict(snap)))
            used |= {"checkpoints": {name}, "manifest": {name}}
        gone = [f"{kind}/{name}" for kind, live in used.items() for name in self._files.names(kind) if name not in live]
        for name in gone:
            self._files.delete(name)
        return gone

    # -- reading ----------------------------------------------------------------

    def _live(
        self, kind: str, schema: StructType, snap: Snapshot, narrowed: Callable[[DataFrame], DataFrame], only: set[str] | None = None
    ) -> DataFrame:
        """Rows of ``chunks`` or ``documents`` without those deleted later, each scan narrowed
        first; of all batches or of those in the folders of ``only``."""
        batches = [(v, folder) for v, _, folder in snap.batches if only is None or folder in only]
        if not batches:
            return narrowed(self.spark.createDataFrame([], schema))
        last_delete = max((v for v, _ in snap.tombstones), default=0)

        def scan(names: list[str]) -> DataFrame:
            paths = [self._chunk_folder(n) if kind == "chunks" else f"{self.root}/{kind}/{n}" for n in names]
            return narrowed(self.spark.read.schema(schema).option("basePath", f"{self.root}/{kind}").parquet(*paths))

        # Batches newer than every deletion are read as they are.
        untouched = [folder for v, folder in batches if v > last_delete]
        parts = [scan(untouched)] if untouched else []
        touched = [(v, folder) for v, folder in batches if v <= last_delete]
        bounds = sorted({min(t for t, _ in snap.tombstones if t >= v) for v, _ in touched})
        for i, bound in enumerate(bounds):
            # Batches between two deletions are affected by the same later ones.
            low = bounds[i - 1] if i else 0
            names = [b for v, b in touched if low < v <= bound]
            later = [f"{self.root}/tombstones/{folder}" for t, folder in snap.tombstones if t >= bound]
            gone = self.spark.read.schema("document_fingerprint string").parquet(*later).distinct()
            parts.append(scan(names).join(gone, "document_fingerprint", "left_anti"))
        live = parts[0]
        for part in parts[1:]:
            live = live.unionByName(part)
        return live

    def directory(self, snapshot: Snapshot | None = None) -> DataFrame:
        """One narrow row per live document: where it lies, its batch, and its counts."""
        snap = snapshot or self.snapshot()
        return self._live("documents", DIRECTORY, snap, lambda df: df.select(*DIRECTORY.names))

    def chunks(self, document_ids: DataFrame | None = None, snapshot: Snapshot | None = None) -> DataFrame:
        """Live chunks, of all documents or of those in ``document_ids``. Given documents are
        looked up in the directory at once; only their folders and buckets are read."""
        snap = snapshot or self.snapshot()
        if document_ids is None:
            return self._live("chunks", PLACED, snap, lambda df: df.select(*STORED_COLUMNS))
        wanted = document_ids.select("document_fingerprint").distinct()
        found = self.directory(snap).join(wanted, "document_fingerprint", "left_semi")
        found = materialize(found.select("document_fingerprint", "folder", "bucket"), "located-documents")
        places = found.select("folder", "bucket").distinct().collect()  # a row per folder and bucket
        few = found.select("document_fingerprint").limit(PUSHED_IDS + 1).collect()
        near = F.col("bucket").isin(sorted({p.bucket for p in places}))
        if len(few) <= PUSHED_IDS:
            near &= F.col("document_fingerprint").isin([r[0] for r in few])

        def narrowed(df: DataFrame) -> DataFrame:
            return df.filter(near).select(*STORED_COLUMNS)

        live = self._live("chunks", PLACED, snap, narrowed, {p.folder for p in places})
        if len(few) > PUSHED_IDS:
            live = live.join(found.select("document_fingerprint"), "document_fingerprint", "left_semi").select(*STORED_COLUMNS)
        return live

    def _one(self, document_fingerprint: str) -> DataFrame:
        return self.spark.createDataFrame([(document_fingerprint,)], "document_fingerprint string")

    def chunk_ids(self, document_fingerprint: str) -> DataFrame:
        return self.chunks(self._one(document_fingerprint)).select("chunk_id")

    def document_chunks(self, document_fingerprint: str) -> DataFrame:
        """One document in reading order."""
        return self.chunks(self._one(document_fingerprint)).orderBy("sequence")

    def documents(self, snapshot: Snapshot | None = None) -> DataFrame:
        """One summary per document, as ``document_summaries`` makes from all chunks."""
        named = self.directory(snapshot).filter(F.coalesce("document_fingerprint", F.lit("")) != "")
        return named.select(F.col("document_fingerprint").alias("document_id"), "filename", "chunk_count", "page_count")

    def count(self) -> int:
        return self.directory().agg(F.sum("chunk_count")).first()[0] or 0

    def is_empty(self) -> bool:
        return self.directory().isEmpty()

    def dimension(self) -> int | None:
        """Length of the stored vectors, None when the store is empty."""
        snap = self.snapshot()
        if snap.tombstones and self.directory(snap).isEmpty():
            return None
        return snap.dimension

    # -- changing ---------------------------------------------------------------

    def append(
        self, chunks: DataFrame, batch: str | None = None, empty_ok: bool = False, documents: DataFrame | None = None
    ) -> int:
        """Add chunks with vectors and return the new version, or the current one for a batch
        already committed under its name, or for one with nothing to add.

        Documents the store holds already are left out (DOCUMENT_ALREADY_INDEXED), and a chunk
        id is stored once. Rows are counted while they are written and again in the written
        files; a mismatch leaves the batch invisible. Documents with a bad vector stay invisible
        too. ``rejected`` names all documents that were not stored.

        ``documents`` (``document_fingerprint``), where these ids are cheaper to read than the
        chunks, names every document that has chunks here. They are looked up first: chunks are
        shuffled for those that are stored only if there are any, and not at all if all are.
        """
        batch = batch or uuid.uuid4().hex
        source = chunks.select(*STORED_COLUMNS)
        for _ in range(ATTEMPTS):
            snap = self.snapshot()
            if batch in snap.names:
                return snap.version
            folder = f"{batch}-{uuid.uuid4().hex[:12]}"
            version = self._append(source, batch, folder, snap, empty_ok, documents)
            if version is not None:
                return version
            if f"folder={folder}" not in self._files.names("chunks"):
                continue
            source = self.spark.read.schema(STORED_CHUNK).parquet(self._chunk_folder(folder))
        raise StoreError("STORE_BUSY", {"attempts": ATTEMPTS})

    @contextmanager
    def _observed(self, df: DataFrame) -> Iterator[None]:
        """Keep the observed part of a plan, even if a later part turns out to be empty. A
        micro-batch has a session of its own."""
        key, conf = "spark.sql.adaptive.optimizer.excludedRules", df.sparkSession.conf
        before = conf.get(key, None)
        conf.set(key, ",".join(filter(None, [before, EMPTY_RULE])))
        try:
            yield
        finally:
            conf.unset(key) if before is None else conf.set(key, before)

    def _chunk_folder(self, folder: str) -> str:
        return f"{self.root}/chunks/folder={folder}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("document_fingerprint"), F.lit(self.buckets)).cast("int")

    def _write_chunks(self, chunks: DataFrame, path: str) -> None:
        """Deal documents to buckets. Spark splits a bucket that is too large for a task, and
        puts small ones together."""
        dealt = chunks.select(*STORED_COLUMNS, self._bucket().alias("bucket")).hint("rebalance", F.col("bucket"))
        dealt.sortWithinPartitions("bucket", "document_fingerprint", "sequence").write.partitionBy("bucket").parquet(path)

    def _write_directory(self, written: DataFrame, folder: str, batch: str) -> None:
        rows = written.groupBy("document_fingerprint").agg(
            F.min_by("filename", F.struct("sequence", "chunk_id")).alias("filename"),
            F.count("*").cast("int").alias("chunk_count"),
            F.greatest(F.max("end_page"), F.max("document_page_count")).alias("page_count"),
            F.max("document_page_count").alias("stored_pages"),
        )
        rows = rows.select("*", F.lit(folder).alias("folder"), self._bucket().alias("bucket"), F.lit(batch).alias("batch"))
        rows.select(*DIRECTORY.names).write.parquet(f"{self.root}/documents/{folder}")

    def _append(
        self, source: DataFrame, batch: str, folder: str, snap: Snapshot, empty_ok: bool, documents: DataFrame | None
    ) -> int | None:
        path = self._chunk_folder(folder)
        offered, sent = Observation(), Observation()
        fresh = source.observe(offered, F.count(F.lit(1)).alias("rows"))
        known = None
        if snap.batches:
            known = self.directory(snap).select("document_fingerprint")
        if known is not None and documents is not None:
            named = documents.select("document_fingerprint").distinct()
            stored = named.join(known.withColumn("stored", F.lit(True)).distinct(), "document_fingerprint", "left")
            stored = materialize(stored, "looked-up-documents")
            known = stored.filter("stored").select("document_fingerprint")
            told = stored.agg(F.count("stored").alias("held"), F.count(F.lit(1)).alias("all")).first()
            if told["held"] and told["held"] == told["all"] and not source.isEmpty():
                refused = known.withColumn("error_code", F.lit("DOCUMENT_ALREADY_INDEXED"))
                refused.write.parquet(f"{self.root}/rejected/{folder}")
                return self._commit(
                    snap, "append", batch=batch, folder=folder, rows=0, dimension=snap.dimension, tombstone=None,
                    rejected=folder,
                )
            known = known if told["held"] else None
        if known is not None:
            fresh = fresh.join(known, "document_fingerprint", "left_anti").select(*STORED_COLUMNS)
        with self._observed(fresh):
            self._write_chunks(fresh.observe(sent, F.count(F.lit(1)).alias("rows")), path)
        written = self.spark.read.schema(STORED_CHUNK).parquet(path)
        finite = is_finite_vector(F.col("embedding"))
        found = written.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~finite).alias("invalid"),
            F.min(F.when(finite, F.size("embedding"))).alias("low"),
            F.max(F.when(finite, F.size("embedding"))).alias("high"),
        ).first()
        expected = sent.get["rows"]
        if found.rows != expected:
            raise StoreError("INDEX_COUNT_MISMATCH", {"expected": expected, "actual": found.rows})
        came = offered.get["rows"]
        if came == 0 and not empty_ok:
            raise StoreError("NO_CHUNKS_TO_INDEX", {"batch": batch})
        if came == 0:
            return snap.version
        rows = found.rows
        if rows and written.select("chunk_id").distinct().count() != rows:
            folder = f"{folder}-once"
            path = self._chunk_folder(folder)
            self._write_chunks(written.dropDuplicates(["chunk_id"]), path)
            written = self.spark.read.schema(STORED_CHUNK).parquet(path)
            rows = written.count()
        self._write_directory(written, folder, batch)
        refused = []
        if known is not None and found.rows < came:
            held = source.select("document_fingerprint").distinct().join(known, "document_fingerprint", "left_semi")
            refused.append(held.withColumn("error_code", F.lit("DOCUMENT_ALREADY_INDEXED")))
        tombstone = None
        # A store whose documents are all deleted takes vectors of any dimension.
        dimension = None if self.directory(snap).isEmpty() else snap.dimension
        if rows and not (found.invalid == 0 and found.low == found.high and dimension in (None, found.low)):
            checked = document_vector_errors(written, dimension)
            bad = checked.filter(F.col("error_code").isNotNull())
            refused.append(bad.select("document_fingerprint", "error_code"))
            tombstone = folder
            bad.select("document_fingerprint").write.parquet(f"{self.root}/tombstones/{folder}")
            kept = checked.filter(F.col("error_code").isNull()).agg(F.max("dimension").alias("d")).first().d
            dimension = kept if dimension is None else dimension
        elif rows:
            dimension = found.low
        if refused:
            told = refused[0] if len(refused) == 1 else refused[0].unionByName(refused[1])
            told.write.parquet(f"{self.root}/rejected/{folder}")
        return self._commit(
            snap, "append", batch=batch, folder=folder, rows=rows, dimension=dimension, tombstone=tombstone,
            rejected=folder if refused else None,
        )

    def rejected(self, batch: str) -> DataFrame:
        """Documents of a batch that were not stored: ``document_fingerprint, error_code``."""
        folders = [folder for name, folder in self.snapshot().refusals if name == batch]
        if not folders:
            return self.spark.createDataFrame([], REJECTED)
        return self.spark.read.schema(REJECTED).parquet(*[f"{self.root}/rejected/{f}" for f in folders])

    def delete(self, document_ids: DataFrame) -> int:
        """Remove all chunks of the documents in ``document_fingerprint``."""
        folder = f"delete-{uuid.uuid4().hex}"
        document_ids.select("document_fingerprint").distinct().write.parquet(f"{self.root}/tombstones/{folder}")
        return self._retried(lambda snap: self._commit(snap, "delete", tombstone=folder))

    def reset(self) -> int:
        return self._retried(lambda snap: self._commit(snap, "reset"))

    def compact(self) -> int:
        """Rewrite the live chunks as one batch, ordered by document for data skipping. The
        directory keeps the batch that brought each document."""

        def rewrite(snap: Snapshot) -> int | None:
            folder = f"compact-{uuid.uuid4().hex}"
            path = self._chunk_folder(folder)
            self._write_chunks(self.chunks(snapshot=snap), path)
            held = self.directory(snap).withColumns({"folder": F.lit(folder), "bucket": self._bucket()})
            held.write.parquet(f"{self.root}/documents/{folder}")
            rows = self.spark.read.schema(STORED_CHUNK).parquet(path).count()
            return self._commit(snap, "compact", batch=folder, folder=folder, rows=rows, dimension=snap.dimension)

        return self._retried(rewrite)
