"""The registered queries: one per operator or small group of operators.

Arrays are joined into strings and floating values rounded, so that results of different
engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import prompts
from pagewright.functions import text as tx
from pagewright.functions import vectors as vx
from pagewright.functions.routing import fold_question
from pagewright.operators import admission, documents, embedding, evaluation, overview, telemetry
from pagewright.operators.chunking import chunk_documents
from pagewright.operators.context import build_context, retrieval_diagnostics, rounded_distance
from pagewright.operators.knn import accept, knn, rank_candidates, split_finite
from pagewright.operators.routing import route_questions
from pagewright.operators.units import normalize_pages, page_units
from pagewright.plans import index
from pagewright.plans.answer import answer_batch, with_chunk_columns
from pagewright.plans.ingest import first_uploads, ingest, uploads_to_index
from pagewright.plans.ingest import ingest_files as ingest_uploads
from pagewright.session import materialize, scratch_path
from pagewright.sources.sinks import answer_payloads, write_listing
from pagewright.sources.store import ChunkStore, count_mismatches, insert_if_absent
from pagewright.sources.tables import parse_log, questions_from_requests, scan_log, scan_pages
from pagewright.streaming.answer import answer_stream
from pagewright.streaming.answer import store_overview as live_overview
from pagewright.streaming.ingest import ingest_stream
from pagewright.streaming.parts import ingest_parts_stream
from verification import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def joined(array: Column) -> Column:
    return F.array_join(array.cast("array<string>"), ",")


def millionths(array: Column) -> Column:
    """A vector as text: every element in millionths."""
    return joined(F.transform(array, lambda x: F.round(x.cast("double") * 1e6).cast("long")))


CHUNK_VIEW = [
    "chunk_id",
    "document_fingerprint",
    "filename",
    "text",
    "start_page",
    "end_page",
    "sequence",
    "word_count",
    "source_boundaries",
    "document_page_count",
]


def chunk_view(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("source_boundaries", tx.joined_boundaries(F.col("source_boundaries"))).select(*CHUNK_VIEW)


# --- text and chunking ---------------------------------------------------------


@query
def scanned_pages(spark, sf_dir):
    """Pages written as a table and scanned from there."""
    path = scratch_path(spark, "pages")
    fx.decorated_pages(spark, sf_dir).select("document_id", "filename", "page_number", "text").write.parquet(path)
    return normalize_pages(scan_pages(spark, path)).select("document_id", "page_number", "text", "empty", "blank")


@query
def normalized_pages(spark, sf_dir):
    return normalize_pages(fx.decorated_pages(spark, sf_dir)).select(
        "document_id", "page_number", "text", "empty", "blank"
    )


@query
def page_text_units(spark, sf_dir):
    units = page_units(fx.decorated_pages(spark, sf_dir), fx.CFG.chunk_size)
    return units.select("document_id", "page_number", F.col("unit_no").alias("unit_no"), "kind", "n", "text")


@query
def headings(spark, sf_dir):
    """Every line of every page as a heading candidate."""
    lines = normalize_pages(fx.decorated_pages(spark, sf_dir)).select(
        F.explode(tx.normalized_lines(F.col("text"))).alias("line")
    )
    # Judged once per different line.
    counted = lines.groupBy("line").agg(F.count("*").alias("lines"))
    return counted.select("line", tx.is_section_heading(F.col("line"), stripped=True).alias("heading"), "lines")


@query
def text_scalars(spark, sf_dir):
    """Fingerprint, token estimate and truncation of whole texts."""
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.fingerprint(F.col("text")).alias("fingerprint"),
        tx.estimate_tokens(F.col("text")).alias("tokens"),
        F.size(tx.words(F.col("text"))).alias("words"),
        F.size(tx.sentences(F.col("text"))).alias("sentences"),
        tx.truncate_words(F.col("text"), F.lit(40)).alias("excerpt"),
    )


@query
def document_chunks(spark, sf_dir):
    return chunk_view(fx.chunks(spark, sf_dir))


@query
def long_document_chunks(spark, sf_dir):
    """All documents through the path for overlong ones."""
    cfg = fx.EngineConfig(
        chunk_size=fx.CFG.chunk_size,
        chunk_overlap=fx.CFG.chunk_overlap,
        long_document_pages=1,
        folio_words=150,
        folios_per_span=2,
    )
    return chunk_view(chunk_documents(fx.decorated_pages(spark, sf_dir), cfg))


@query
def single_page_chunks(spark, sf_dir):
    """Default chunk size on whole one-page documents; equal texts are gathered first."""
    pages = fx.single_page_docs(spark, sf_dir)
    first = first_uploads(pages.select("document_id", "upload_id"))
    kept = pages.join(first.select("upload_id"), "upload_id", "left_semi")
    return chunk_view(chunk_documents(kept, fx.EngineConfig()))


@query
def long_page_chunks(spark, sf_dir):
    """The same documents, of which those of over 2 000 characters are cut inside their page."""
    pages = fx.single_page_docs(spark, sf_dir)
    first = first_uploads(pages.select("document_id", "upload_id"))
    kept = pages.join(first.select("upload_id"), "upload_id", "left_semi")
    cfg = fx.EngineConfig(long_document_characters=2_000, folio_words=1_000, folios_per_span=2)
    return chunk_view(chunk_documents(kept, cfg))


@query
def page_labels(spark, sf_dir):
    return fx.chunks(spark, sf_dir).select(
        "chunk_id",
        tx.page_label(F.col("start_page"), F.col("end_page")).alias("label"),
        tx.source_id(F.col("document_fingerprint"), F.col("chunk_id")).alias("source_id"),
    )


# --- validation ------------------------------------------------------------------


@query
def document_gate(spark, sf_dir):
    gate = admission.document_gate(fx.decorated_pages(spark, sf_dir))
    return gate.select(
        "document_id", "filename", "page_count", "empty_page_count", F.coalesce("error_code", F.lit("")).alias("error_code")
    )


@query
def page_gate(spark, sf_dir):
    """Every page as a document of its own, so that the empty ones are rejected."""
    pages = fx.decorated_pages(spark, sf_dir).withColumn(
        "document_id", F.concat_ws("#", "document_id", "page_number")
    )
    gate = admission.document_gate(pages)
    return gate.select(
        "document_id",
        "empty_page_count",
        F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce("error_status", F.lit(0)).alias("error_status"),
    )


@query
def file_admission(spark, sf_dir):
    checked = admission.file_errors(fx.uploaded_files(spark, sf_dir), fx.FILE_CFG)
    return checked.select(
        "doc_id",
        F.coalesce("clean_filename", F.lit("")).alias("clean_filename"),
        F.coalesce("bare_type", F.lit("")).alias("bare_type"),
        F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce("error_status", F.lit(0)).alias("error_status"),
    )


@query
def question_validation(spark, sf_dir):
    checked = admission.question_errors(
        fx.raw_questions(spark, sf_dir), fx.table(spark, sf_dir, "documents"), fx.CFG
    )
    return checked.select(
        "question_id",
        F.coalesce("cleaned", F.lit("")).alias("cleaned"),
        F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce("error_status", F.lit(0)).alias("error_status"),
        F.coalesce(F.try_element_at("error_details", F.lit("type")), F.lit("")).alias("detail"),
    )


@query
def engine_question_validation(spark, sf_dir):
    """The tests behind the request level, against an empty store."""
    questions = fx.raw_questions(spark, sf_dir)
    nothing = fx.table(spark, sf_dir, "documents").filter(F.lit(False))
    checked = admission.question_errors(questions, nothing, fx.CFG, request_level=False)
    return checked.groupBy("error_code", "error_status").agg(F.count("*").alias("questions"))


@query
def question_requests(spark, sf_dir):
    """Turns as JSON request bodies, some of the wrong shape."""
    kind = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("question"))))
        .when(kind == 1, F.to_json(F.struct(F.col("conv_id").alias("question"))))
        .when(kind == 2, F.to_json(F.struct("text")))
        .when(kind == 3, F.concat(F.lit('{"question":null,"n":'), F.col("turn").cast("string"), F.lit("}")))
        .otherwise(F.lit("not json"))
    )
    requests = fx.table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("question_id"), body.alias("body")
    )
    return questions_from_requests(requests).select(
        "question_id", F.coalesce("question", F.lit("")).alias("question"), "question_type"
    )


@query
def error_triage(spark, sf_dir):
    return admission.triage(fx.errors(spark, sf_dir)).select(
        "event_id", "category", "shown_code", "shown_message", "retryable"
    )


@query
def error_summary(spark, sf_dir):
    return admission.triage_summary(fx.errors(spark, sf_dir))


# --- vectors ---------------------------------------------------------------------


@query
def hash_embedding(spark, sf_dir):
    embedded = embedding.embed(fx.single_page_docs(spark, sf_dir), "text", embedding.hash_embedder())
    return embedded.select("upload_id", millionths(F.col("embedding")).alias("vector"))


@query
def unit_vectors(spark, sf_dir):
    halved = F.transform("embedding", lambda x, i: (x * (i % 3)).cast("float"))
    return fx.vectors(spark, sf_dir).select("chunk_id", millionths(vx.l2_normalize(halved)).alias("vector"))


def _damaged(spark, sf_dir):
    kind = F.col("question_id") % 6
    bad = (
        F.when(kind == 0, F.lit(None).cast("array<float>"))
        .when(kind == 1, F.array().cast("array<float>"))
        .when(kind == 2, F.array_append("embedding", F.lit(float("nan")).cast("float")))
        .when(kind == 3, F.array_append("embedding", F.lit(float("inf")).cast("float")))
        .when(kind == 4, F.array_append("embedding", F.lit(0.5).cast("float")))
        .otherwise(F.col("embedding"))
    )
    return fx.vectors(spark, sf_dir).withColumn("embedding", bad)


@query
def vector_validity(spark, sf_dir):
    return embedding.vector_errors(_damaged(spark, sf_dir), stored_dimension=64).select(
        "chunk_id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_status", F.lit(0)).alias("error_status")
    )


@query
def dimension_check(spark, sf_dir):
    checked = embedding.document_vector_errors(_damaged(spark, sf_dir), stored_dimension=64)
    return checked.select(
        "document_fingerprint", "vectors", "invalid_vectors", F.coalesce("error_code", F.lit("")).alias("error_code")
    )


@query
def vector_pairing(spark, sf_dir):
    """Chunks and vectors of a batch in which the vector of every empty text is missing."""
    chunks = fx.vectors(spark, sf_dir)
    usable = chunks.filter(F.col("embedding")[0] > 0).withColumn(
        "model_id", F.when(F.col("label") > 7, F.lit("b")).otherwise(F.lit("a"))
    )
    missing = embedding.missing_vectors(chunks, usable)
    mixed = embedding.mixed_models(usable).select("document_fingerprint", F.lit(True).alias("mixed"))
    return missing.join(mixed, "document_fingerprint", "left").select(
        "document_fingerprint", "chunks", "vectors", F.coalesce("mixed", F.lit(False)).alias("mixed")
    )


def _knn(metric: str) -> Query:
    def run(spark, sf_dir):
        vectors = fx.vectors(spark, sf_dir)
        questions = vectors.select("question_id", "embedding")
        hits = knn(questions, vectors, fx.CFG.top_k, metric, fx.CFG, exclude_self=True)
        return rank_candidates(hits).select(
            "question_id", "rank", "chunk_id", "source_id", rounded_distance(F.col("distance")).alias("distance")
        )

    run.__name__ = f"knn_{metric}"
    return run


for _metric in ("cosine", "l2", "ip"):
    query(_knn(_metric))


@query
def knn_grid(spark, sf_dir):
    """The way for question tables too large to broadcast at once: one pass per block."""
    cfg = fx.EngineConfig(broadcast_questions=150)
    vectors = fx.vectors(spark, sf_dir)
    questions = vectors.select("question_id", "embedding")
    hits = knn(questions, vectors, fx.CFG.top_k, "cosine", cfg, exclude_self=True)
    return rank_candidates(hits).select(
        "question_id", "rank", "chunk_id", "source_id", rounded_distance(F.col("distance")).alias("distance")
    )


def _vector_candidates(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    return rank_candidates(
        knn(vectors.select("question_id", "embedding"), vectors, fx.CFG.top_k, "cosine", fx.CFG, exclude_self=True)
    )


@query
def relevance_accept(spark, sf_dir):
    return accept(_vector_candidates(spark, sf_dir), 0.6).select(
        "question_id", "rank", "chunk_id", rounded_distance(F.col("distance")).alias("distance")
    )


@query
def threshold_sweep(spark, sf_dir):
    labels = fx.vectors(spark, sf_dir).select("chunk_id", "label")
    asked = fx.vectors(spark, sf_dir).select("question_id", F.col("label").alias("asked"))
    scored = (
        _vector_candidates(spark, sf_dir)
        .join(labels, "chunk_id")
        .join(asked, "question_id")
        .select("distance", (F.col("label") == F.col("asked")).alias("relevant"))
    )
    return evaluation.threshold_sweep(scored, fx.THRESHOLDS).withColumn(
        "precision", F.coalesce("precision", F.lit(-1.0))
    )


def _chunk_table(spark, sf_dir):
    """The chunk table as it would lie in the store: written once, read by the query."""
    return materialize(fx.chunks(spark, sf_dir), "query-chunks")


# --- corpus views ------------------------------------------------------------------


@query
def document_summaries(spark, sf_dir):
    return documents.document_listing(_chunk_table(spark, sf_dir))


@query
def corpus_summary(spark, sf_dir):
    return documents.corpus_summary(_chunk_table(spark, sf_dir))


@query
def corpus_signature(spark, sf_dir):
    return documents.corpus_signature(fx.single_page_docs(spark, sf_dir).withColumnRenamed("document_id", "document_fingerprint"))


@query
def store_dimension(spark, sf_dir):
    return documents.store_dimension(fx.vectors(spark, sf_dir))


# --- store ---------------------------------------------------------------------------


def _new_store(spark) -> ChunkStore:
    return ChunkStore(spark, scratch_path(spark, "store"))


@query
def ingest_dedup(spark, sf_dir):
    report = ingest(fx.single_page_docs(spark, sf_dir), _new_store(spark), cfg=fx.CFG)
    return report.withColumn("error_code", F.coalesce("error_code", F.lit("")))


@query
def ingest_files(spark, sf_dir):
    """Uploaded files with their pages, a tenth of them without: a report row for every file."""
    files = fx.uploaded_files(spark, sf_dir).withColumn("path", F.concat(F.lit("in/"), F.col("doc_id").cast("string")))
    pages = fx.table(spark, sf_dir, "documents").filter("doc_id % 10 <> 3").select(
        F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), F.lit(1).alias("page_number"), "text"
    )
    report = ingest_uploads(files, pages, _new_store(spark), cfg=fx.UPLOAD_CFG)
    return report.select(
        "upload_id", F.coalesce("document_id", F.lit("")).alias("document_id"), "filename", "page_count", "chunk_count",
        "indexed_count", "status", "message", F.coalesce("error_code", F.lit("")).alias("error_code"),
    )


@query
def embedder_faults(spark, sf_dir):
    """Texts of which some are blank and others make the embedder fail, in batches of sixteen."""
    number = F.col("doc_id")
    texts = fx.table(spark, sf_dir, "documents").select("doc_id", F.when(number % 17 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("text"))
    made = embedding.embedding_errors(embedding.embed(texts, "text", fx.FAULTY, refuse_blank=True))
    return made.select(
        "doc_id", F.coalesce("error_code", F.lit("")).alias("error_code"), F.coalesce("error_status", F.lit(0)).alias("error_status"),
        F.coalesce(F.get("embedding", F.lit(0)).cast("int"), F.lit(-1)).alias("first"),
    )


@query
def uploads_chosen(spark, sf_dir):
    """Uploads to index when all French documents are stored already."""
    pages = fx.single_page_docs(spark, sf_dir)
    french = fx.table(spark, sf_dir, "documents").filter("lang = 'fr'")
    stored = french.select(tx.fingerprint(F.col("text")).alias("document_fingerprint"))
    return uploads_to_index(pages.select("document_id", "upload_id"), stored)


def _stored(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        "chunk_id",
        "document_fingerprint",
        F.concat("document_fingerprint", F.lit(".pdf")).alias("filename"),
        F.lit("-").alias("text"),
        F.lit(1).alias("start_page"),
        F.lit(1).alias("end_page"),
        "sequence",
        F.lit(1).alias("word_count"),
        F.array(F.lit("sentence")).alias("source_boundaries"),
        F.lit(1).alias("document_page_count"),
        "embedding",
        F.lit("m").alias("model_id"),
    )


@query
def store_round_trip(spark, sf_dir):
    """Append, delete the documents of one label, append more, delete again, compact."""
    store = _new_store(spark)
    rows = fx.vectors(spark, sf_dir).withColumn(
        "document_fingerprint", F.concat_ws("-", "document_fingerprint", "label")
    )
    store.append(_stored(rows.filter("label < 5")))
    store.delete(rows.filter("label = 2").select("document_fingerprint"))
    store.append(_stored(rows.filter("label >= 5")))
    store.delete(rows.filter("label = 7").select("document_fingerprint"))
    store.compact()
    return store.chunks().select(
        "chunk_id", "document_fingerprint", "sequence", millionths(F.col("embedding")).alias("vector")
    )


@query
def store_append_twice(spark, sf_dir):
    """Real chunks appended in overlapping parts, and every chunk once more: each is kept once,
    with its text, pages and boundaries."""
    store = _new_store(spark)
    chunks = materialize(fx.stored_chunks(spark, sf_dir), "query-chunks")
    low = F.col("document_fingerprint") < "a"
    store.append(chunks.filter(low).unionByName(chunks.filter(low)), "low")
    store.append(chunks, "all", documents=chunks)
    store.append(chunks, "again", documents=chunks)
    return chunk_view(store.chunks())


@query
def refused_appends(spark, sf_dir):
    """Documents that a second append found stored already."""
    store = _new_store(spark)
    rows = _stored(fx.vectors(spark, sf_dir))
    store.append(rows.filter("sequence % 2 = 0 and document_fingerprint < 'd15'"), "first")
    store.append(rows, "second")
    return store.rejected("second")


@query
def question_vectors(spark, sf_dir):
    """Damaged vectors as questions: an error each, and neighbours for the sound ones."""
    good, bad = embedding.validate_vectors(_damaged(spark, sf_dir), stored_dimension=64)
    corpus = fx.vectors(spark, sf_dir).drop("question_id")
    hits, undefined = split_finite(knn(good, corpus, fx.CFG.top_k, "cosine", fx.CFG, check=False))
    found = hits.groupBy("question_id").agg(F.count("*").cast("int").alias("neighbours"))
    answered = found.select("question_id", "neighbours", F.lit("").alias("error_code"), F.lit(0).alias("error_status"))
    failed = bad.select("question_id", "error_code", "error_status").unionByName(undefined)
    return answered.unionByName(failed.select("question_id", F.lit(0).alias("neighbours"), "error_code", "error_status"))


def _unit_faults(spark, sf_dir):
    """Chunks and vectors in units of seven, each kind of unit with a fault of its own: a vector
    missing, of another chunk, twice, or not finite; no chunk; a chunk of another document; a
    document that a smaller unit has too."""
    number = F.col("question_id")
    unit, kind, place = F.floor(number / 7), F.floor(number / 7) % 9, number % 7
    rows = fx.vectors(spark, sf_dir).withColumns({"batch_id": unit, "kind": kind, "place": place})
    own = F.concat(F.lit("u"), F.when(kind == 8, unit - 8).otherwise(unit).cast("string"))
    chunks = _stored(rows.withColumn("document_fingerprint", F.when((kind == 6) & (place == 0), F.lit("other")).otherwise(own)))
    chunks = chunks.drop("embedding", "model_id").join(rows.select("chunk_id", "batch_id", "kind"), "chunk_id")
    nan = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 2, 1000))
    vectors = rows.filter((kind != 3) | (place != 0)).select(
        "batch_id",
        F.when((kind == 4) & (place == 0), F.concat(F.lit("stranger"), "chunk_id")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when((kind == 2) & (place == 0), nan).otherwise(F.col("embedding")).alias("embedding"),
        F.lit("m").alias("model_id"),
        F.when((kind == 7) & (place == 1), 2).otherwise(1).alias("times"),
    )
    vectors = vectors.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "again")
    return chunks.filter("kind <> 5").drop("kind"), vectors


@query
def index_with_vectors(spark, sf_dir):
    """Units of chunks and vectors from two tables: a report row each, and a checksum over the
    vectors that were stored with their chunks."""
    store = _new_store(spark)
    chunks, vectors = _unit_faults(spark, sf_dir)
    report = index.index_with_vectors(chunks, vectors, store)
    first = F.round(F.get("embedding", F.lit(0)).cast("double") * 1e6).cast("bigint") * F.substring("chunk_id", 2, 18).cast("bigint")
    sums = store.chunks().groupBy("document_fingerprint").agg(F.sum(first).alias("checksum"))
    told = report.join(sums, "document_fingerprint", "left")
    return told.select(
        "batch_id", "chunk_count", "vector_count", "indexed_count", F.coalesce("error_code", F.lit("")).alias("error_code"),
        F.coalesce("error_status", F.lit(0)).alias("error_status"),
        F.when(F.col("indexed_count") > 0, F.col("checksum")).otherwise(0).alias("checksum"),
    )


@query
def document_lookup(spark, sf_dir):
    """Chunks of a third of all documents, found by the directory of a store that was filled in
    two parts, lost some documents and got one part of them back."""
    store = _new_store(spark)
    chunks = materialize(fx.stored_chunks(spark, sf_dir), "query-chunks")
    doc = F.col("document_fingerprint")
    store.append(chunks.filter(doc < "9"), "low")
    high = chunks.filter(doc >= "9")
    store.append(high, "high", documents=high)
    gone = chunks.filter(F.substring(doc, 2, 1).isin("0", "1", "2", "3"))
    store.delete(gone.select(doc))
    back = gone.filter(F.substring(doc, 2, 1) < "2")
    store.append(back, "back", documents=back)
    wanted = chunks.filter(F.substring(doc, 3, 1) < "5").select(doc)
    listed = store.documents().select(F.col("document_id").alias("document_fingerprint"), "chunk_count", "page_count")
    found = store.chunks(wanted).join(listed, "document_fingerprint")
    return found.select("chunk_id", "document_fingerprint", "sequence", "text", "chunk_count", "page_count")


@query
def store_reset(spark, sf_dir):
    """A store that was reset holds only what came after; its listing as the sink writes it."""
    store = _new_store(spark)
    rows = _stored(fx.vectors(spark, sf_dir))
    store.append(rows, "first")
    store.reset()
    store.append(rows.filter("document_fingerprint < 'd15'"), "first")
    path = scratch_path(spark, "listing")
    write_listing(store.chunks(), path)
    return spark.read.schema("document_id string, filename string, chunk_count int, page_count int, total_chunks bigint").json(path)


@query
def store_overview(spark, sf_dir):
    """The overview made from the directory and the chunks of the shown documents."""
    store = _new_store(spark)
    store.append(fx.stored_chunks(spark, sf_dir))
    return live_overview(store, fx.CFG).select("total_documents", "estimated_tokens", "rendered")


@query
def absent_inserts(spark, sf_dir):
    """Two overlapping halves of the vector table, the second inserted where absent."""
    vectors = fx.vectors(spark, sf_dir)
    first, second = vectors.filter("label < 6"), vectors.filter("label > 3")
    return insert_if_absent(second, first).select("chunk_id", "document_fingerprint", "sequence")


@query
def count_verification(spark, sf_dir):
    vectors = fx.vectors(spark, sf_dir)
    return count_mismatches(vectors.filter("label <> 3"), vectors)


# --- retrieval over chunks ---------------------------------------------------------------


def _retrieved(spark, sf_dir):
    chunks = materialize(fx.stored_chunks(spark, sf_dir), "query-chunks")
    questions = fx.questions(spark, sf_dir)
    asked = embedding.embed(questions, "question", embedding.hash_embedder())
    hits = knn(asked, chunks, fx.CFG.top_k, fx.CFG.metric, fx.CFG)
    return chunks, questions, materialize(rank_candidates(hits), "query-candidates")


@query
def diagnostics(spark, sf_dir):
    _, questions, candidates = _retrieved(spark, sf_dir)
    found = retrieval_diagnostics(questions, candidates, fx.CFG.relevance_threshold)
    return found.select(
        "question_id",
        "question_length",
        "candidate_count",
        "accepted_count",
        "threshold",
        joined(F.transform("candidate_distances", lambda d: F.round(d * 1e6).cast("long"))).alias("distances"),
        joined(F.col("accepted_ranks")).alias("accepted_ranks"),
        joined(F.col("accepted_chunk_ids")).alias("accepted_chunk_ids"),
    )


def _contexts(spark, sf_dir):
    chunks, _, candidates = _retrieved(spark, sf_dir)
    accepted = accept(candidates, fx.CFG.relevance_threshold)
    return build_context(with_chunk_columns(accepted, chunks, fx.CFG), fx.CFG.max_context_tokens)


@query
def context_budget(spark, sf_dir):
    return _contexts(spark, sf_dir).select(
        "question_id",
        "accepted_count",
        "estimated_tokens",
        joined(F.col("blocks.chunk_id")).alias("block_chunks"),
        joined(F.col("sources.chunk_id")).alias("source_chunks"),
        joined(F.col("sources.rank")).alias("source_ranks"),
    )


@query
def context_rendered(spark, sf_dir):
    return _contexts(spark, sf_dir).select("question_id", "rendered")


@query
def retrieval_quality(spark, sf_dir):
    """Benchmark passages should find the documents that contain them."""
    chunks, questions, candidates = _retrieved(spark, sf_dir)
    accepted = accept(candidates, fx.CFG.relevance_threshold).select(
        "question_id", F.col("document_fingerprint").alias("chunk_id"), "rank"
    )
    per_document = accepted.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    # A passage is expected where all its words stand in a chunk one after another.
    held = evaluation.passages_in(chunks, questions.select(F.col("question").alias("passage")))
    asked = questions.select(
        "question_id",
        F.when(F.col("question_id") < 1_000_000_000, F.lit("passage"))
        .when(F.col("question_id") < 2_000_000_000, F.lit("turn"))
        .otherwise(F.lit("template"))
        .alias("scenario"),
        F.col("question").alias("passage"),
    )
    held = held.withColumnRenamed("document_fingerprint", "chunk_id")
    expected = asked.join(held, "passage", "left").select("question_id", "scenario", "chunk_id")
    return evaluation.retrieval_quality(per_document, expected).withColumn(
        "precision_at_k", F.coalesce("precision_at_k", F.lit(-1.0))
    )


# --- overview -----------------------------------------------------------------------------


@query
def overview_positions(spark, sf_dir):
    """Sampled positions for every document of the corpus."""
    summaries = documents.document_summaries(_chunk_table(spark, sf_dir))
    return summaries.select(
        "document_id",
        "chunk_count",
        joined(overview.even_positions(F.col("chunk_count"), F.lit(4))).alias("positions"),
    )


@query
def overview_excerpts(spark, sf_dir):
    built = overview.build_overview(_chunk_table(spark, sf_dir), fx.CFG)
    return built.select("doc_index", "document_id", "token_budget", "total_documents", F.explode("excerpts").alias("e")).select(
        "doc_index", "document_id", "token_budget", "total_documents", "e.position", "e.chunk_id", "e.text", "e.tokens"
    )


@query
def overview_sources(spark, sf_dir):
    built = overview.build_overview(_chunk_table(spark, sf_dir), fx.CFG)
    return overview.overview_sources(built)


@query
def overview_rendered(spark, sf_dir):
    built = overview.build_overview(_chunk_table(spark, sf_dir), fx.CFG)
    return overview.render_overview(built).select("total_documents", "estimated_tokens", "rendered")


# --- questions and answers ------------------------------------------------------------------


@query
def question_folding(spark, sf_dir):
    return fx.questions(spark, sf_dir).select("question_id", fold_question(F.col("question")).alias("folded"))


@query
def question_route(spark, sf_dir):
    return route_questions(fx.questions(spark, sf_dir)).select(
        "question_id", "document_level", (F.col("document_level") == F.col("expected")).alias("as_expected")
    )


@query
def grounded_prompts(spark, sf_dir):
    """Prompts around each turn, with the turn itself as evidence."""
    q = F.col("text")
    return fx.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.sha2(F.concat(prompts.grounded_system(), prompts.grounded_user(q, q)), 256).alias("grounded"),
        F.sha2(
            F.concat(prompts.overview_system(F.col("turn") % 2 == 0), prompts.overview_user(q, q)), 256
        ).alias("document_level"),
        prompts.echo_answer(prompts.grounded_user(q, q)).alias("answer"),
        prompts.is_abstention(
            F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" insufficient_Evidence "), q)).otherwise(q)
        ).alias("abstained"),
    )


def _flat_answers(answers: DataFrame) -> DataFrame:
    return answers.select(
        "question_id",
        "answer",
        "status",
        "mode",
        "candidate_count",
        "accepted_count",
        "top_k",
        "relevance_threshold",
        "context_token_estimate",
        joined(F.col("sources.chunk_id")).alias("source_chunks"),
        joined(F.col("sources.rank")).alias("source_ranks"),
    )


@query
def answers(spark, sf_dir):
    chunks = materialize(fx.stored_chunks(spark, sf_dir), "answer-chunks")
    answered, _ = answer_batch(fx.questions(spark, sf_dir), chunks, cfg=fx.CFG)
    return _flat_answers(answered)


@query
def answers_without_fallback(spark, sf_dir):
    chunks = materialize(fx.stored_chunks(spark, sf_dir), "answer-chunks")
    answered, _ = answer_batch(fx.questions(spark, sf_dir), chunks, cfg=fx.NO_FALLBACK)
    return _flat_answers(answered)


PAYLOAD = (
    "answer string, status string, sources array<struct<source_id string, filename string, chunk_id string, "
    "start_page int, end_page int, sequence int, rank int, distance double>>, retrieval struct<candidates int, "
    "accepted int, top_k int, relevance_threshold double, context_token_estimate int, mode string>"
)


@query
def answer_json(spark, sf_dir):
    """The JSON payloads, read back."""
    chunks = materialize(fx.stored_chunks(spark, sf_dir), "answer-chunks")
    answered, _ = answer_batch(fx.questions(spark, sf_dir), chunks, cfg=fx.CFG)
    told = answer_payloads(answered).select("question_id", F.from_json("payload", PAYLOAD).alias("p"))
    return _flat_answers(
        told.select(
            "question_id",
            "p.answer",
            "p.status",
            "p.retrieval.mode",
            F.col("p.retrieval.candidates").alias("candidate_count"),
            F.col("p.retrieval.accepted").alias("accepted_count"),
            "p.retrieval.top_k",
            "p.retrieval.relevance_threshold",
            "p.retrieval.context_token_estimate",
            "p.sources",
        )
    )


# --- telemetry ----------------------------------------------------------------------------------


@query
def stage_timings(spark, sf_dir):
    return telemetry.stage_timings(parse_log(fx.log_lines(spark, sf_dir)))


@query
def scanned_log(spark, sf_dir):
    """Log lines written to files and scanned from there."""
    path = scratch_path(spark, "log")
    fx.log_lines(spark, sf_dir).write.text(path)
    counts = telemetry.event_counts(scan_log(spark, path))
    return counts.withColumn("mean_latency_ms", F.coalesce("mean_latency_ms", F.lit(-1.0)))


@query
def query_outcomes(spark, sf_dir):
    return telemetry.query_outcomes(parse_log(fx.log_lines(spark, sf_dir)))


@query
def event_counts(spark, sf_dir):
    counts = telemetry.event_counts(parse_log(fx.log_lines(spark, sf_dir)))
    return counts.withColumn("mean_latency_ms", F.coalesce("mean_latency_ms", F.lit(-1.0)))


# --- streaming ---------------------------------------------------------------------------------


def _in_steps(spark, rows: DataFrame, steps: int, start) -> None:
    """Rows arrive by their ``step``, a micro-batch each, in as many files as there are tasks: no
    task writes a whole step. ``start`` takes the source and a folder; the stream goes on after each step."""
    incoming, work = scratch_path(spark, "incoming"), scratch_path(spark, "stream")
    for step in range(steps):
        arriving = rows.filter(F.col("step") == step).drop("step")
        arriving.write.mode("append").parquet(incoming)
        start(spark.readStream.schema(arriving.schema).parquet(incoming), work).awaitTermination()


@query
def stream_ingest(spark, sf_dir):
    """Documents arriving in three steps; the store must equal the one-shot result."""
    pages = fx.decorated_pages(spark, sf_dir)
    store = _new_store(spark)
    dealt = pages.withColumn("step", F.pmod(F.xxhash64("document_id"), F.lit(3)))
    _in_steps(spark, dealt, 3, lambda source, work: ingest_stream(source, store, f"{work}/checkpoint", f"{work}/reports", cfg=fx.CFG))
    return chunk_view(store.chunks())


@query
def stream_split_documents(spark, sf_dir):
    """Pages of every document spread over three micro-batches; some pages come twice. Together
    they are what one batch would be."""
    pages = fx.decorated_pages(spark, sf_dir)
    counts = pages.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
    parts = pages.join(counts, "document_id").withColumn("step", F.pmod(F.xxhash64("text", "page_number"), F.lit(3)))
    again = parts.filter("page_number = 1").withColumn("step", F.lit(2).cast("long"))
    both, store = parts.unionByName(again), _new_store(spark)
    _in_steps(
        spark, both, 3,
        lambda source, work: ingest_parts_stream(source, store, f"{work}/checkpoint", f"{work}/reports", cfg=fx.CFG),
    )
    return chunk_view(store.chunks())


@query
def stream_two_sources(spark, sf_dir):
    """Two streams feed one store: together they hold what one batch would."""
    pages = fx.decorated_pages(spark, sf_dir)
    store = _new_store(spark)
    for part, rows in (("low", pages.filter("document_id < 'a'")), ("high", pages.filter("document_id >= 'a'"))):
        incoming, work = scratch_path(spark, f"incoming-{part}"), scratch_path(spark, f"stream-{part}")
        rows.repartition(2, "document_id").write.parquet(incoming)
        source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
        ingest_stream(source, store, f"{work}/checkpoint", f"{work}/reports", cfg=fx.CFG).awaitTermination()
    return chunk_view(store.chunks())


@query
def stream_answers(spark, sf_dir):
    store = _new_store(spark)
    ingest(fx.decorated_pages(spark, sf_dir), store, cfg=fx.CFG)
    questions = fx.questions(spark, sf_dir)
    incoming, work = scratch_path(spark, "incoming"), scratch_path(spark, "stream")
    questions.repartition(2).write.parquet(incoming)
    source = spark.readStream.schema(questions.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    answer_stream(source, store, f"{work}/checkpoint", f"{work}/answers", cfg=fx.CFG).awaitTermination()
    return _flat_answers(spark.read.parquet(f"{work}/answers"))
