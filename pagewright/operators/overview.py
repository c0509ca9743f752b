"""A representative view of whole documents: profiles plus evenly sampled excerpts.

The view depends on the chunk table only. Its size is bounded by the configuration
(documents x excerpts), never by the corpus, so it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.functions import text as tx
from pagewright.functions.ordered import rows_at_positions
from pagewright.operators.documents import document_summaries

# Lower bounds of a document's budgets.
LEAST_DOCUMENT_TOKENS = 400
LEAST_DOCUMENT_CHUNKS = 3


def even_positions(total: Column, limit: Column) -> Column:
    """All positions, or ``limit`` evenly spaced ones including both ends, halves to even."""
    spread = F.transform(
        F.sequence(F.lit(0), limit - 1),
        # A limit of one takes the first position.
        lambda i: F.rint(i.cast("double") * (total - 1) / F.greatest(limit - 1, F.lit(1))).cast("int"),
    )
    return F.when(total <= limit, F.sequence(F.lit(0), total - 1)).otherwise(spread)


def select_documents(summaries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The first documents of the listing (from ``document_summaries``, or a store's directory)
    with their budgets and sampled positions."""
    total = summaries.agg(F.count("*").alias("total_documents")).withColumn("_one", F.lit(1))
    first = summaries.orderBy(F.lower("filename"), "document_id").limit(cfg.overview_max_documents)
    most = cfg.overview_max_chunks_per_document
    # At most ``overview_max_documents`` rows from here on.
    listed = first.agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.lower("filename").alias("key"), "document_id", "filename", "page_count", "chunk_count")
            )
        ).alias("documents")
    ).withColumn("n", F.size("documents"))
    return (
        listed.select(
            F.posexplode("documents").alias("doc_index", "d"),
            F.col("n"),
        )
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(total), "_one")
        .select(
            (F.col("doc_index") + 1).alias("doc_index"),
            "d.document_id",
            "d.filename",
            "d.page_count",
            "d.chunk_count",
            "total_documents",
            F.greatest(
                F.lit(LEAST_DOCUMENT_TOKENS), F.floor(F.lit(cfg.max_context_tokens) / F.col("n")).cast("int")
            ).alias("token_budget"),
            F.greatest(
                F.lit(LEAST_DOCUMENT_CHUNKS),
                F.least(F.lit(most), F.floor(F.lit(2 * most) / F.col("n")).cast("int")),
            ).alias("chunk_limit"),
        )
        .withColumn("positions", even_positions(F.col("chunk_count"), F.col("chunk_limit")))
    )


def sample_excerpts(chunks: DataFrame, documents: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per sampled position, with the truncated text."""
    wanted = documents.select(
        F.col("document_id").alias("document_fingerprint"), F.explode("positions").alias("position")
    )
    picked = rows_at_positions(
        chunks.select(
            "document_fingerprint", "sequence", "chunk_id", "text", "start_page", "end_page", "word_count"
        ),
        ["document_fingerprint"],
        "sequence",
        wanted,
    )
    limit = F.when(F.col("position") == 0, F.lit(2 * cfg.overview_excerpt_words)).otherwise(
        F.lit(cfg.overview_excerpt_words)
    )
    return (
        picked.withColumn("text", tx.truncate_words(F.col("text"), limit))
        .withColumn("tokens", tx.estimate_tokens(F.col("text")))
        .withColumnRenamed("document_fingerprint", "document_id")
    )


def trim_interior(excerpts: Column, budget: Column, most: int) -> Column:
    """Drop the middle excerpt while more than two remain and they exceed the budget."""

    def step(kept: Column, _: Column) -> Column:
        over = F.aggregate(kept, F.lit(0), lambda a, e: a + e["tokens"]) > budget
        middle = F.floor(F.size(kept) / 2).cast("int")
        without = F.concat(
            F.slice(kept, F.lit(1), middle), F.slice(kept, middle + 2, F.size(kept) - middle - 1)
        )
        return F.when((F.size(kept) > 2) & over, without).otherwise(kept)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), excerpts, step)


def build_overview(chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """One row per shown document: profile and excerpts in reading order."""
    return overview_of(select_documents(document_summaries(chunks), cfg), chunks, cfg)


def overview_of(documents: DataFrame, chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The overview of selected documents; ``chunks`` need hold no others."""
    per_document = (
        sample_excerpts(chunks, documents, cfg)
        .groupBy("document_id")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "position", "chunk_id", "sequence", "start_page", "end_page", "word_count", "text", "tokens"
                    )
                )
            ).alias("excerpts")
        )
    )
    most = max(LEAST_DOCUMENT_CHUNKS, cfg.overview_max_chunks_per_document)
    return (
        F.broadcast(documents)
        .join(per_document, "document_id")
        .withColumn("excerpts", trim_interior(F.col("excerpts"), F.col("token_budget"), most))
        .select(
            "doc_index",
            "document_id",
            "filename",
            "page_count",
            "chunk_count",
            "total_documents",
            "token_budget",
            "excerpts",
        )
    )


def overview_sources(overview: DataFrame) -> DataFrame:
    """All excerpts as sources, ranked from 1 across documents, at distance 0."""
    return render_overview(overview).select(F.explode("sources").alias("s")).select("s.*")


def render_overview(overview: DataFrame) -> DataFrame:
    """One row: the rendered view, its sources, token estimate and number of documents.
    No row when nothing is indexed."""
    profiles = overview.groupBy("total_documents").agg(
        F.array_sort(
            F.collect_list(
                F.struct("doc_index", "document_id", "filename", "page_count", "chunk_count", "excerpts")
            )
        ).alias("profiles")
    )

    def profile_line(p: Column) -> Column:
        pages = F.when(p["page_count"] != 0, p["page_count"].cast("string")).otherwise(F.lit("unknown"))
        return F.concat(
            F.format_string("document %d: filename=", p["doc_index"]),
            p["filename"],
            F.lit(" | total_pages="),
            pages,
            F.format_string(
                " | indexed_sections=%d | excerpts_shown=%d", p["chunk_count"], F.size(p["excerpts"])
            ),
        )

    def excerpt_block(p: Column, e: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.concat(
                F.format_string("[EXCERPT document %d: ", p["doc_index"]), p["filename"], F.lit("]")
            ),
            F.format_string("pages: %d-%d", e["start_page"], e["end_page"]),
            F.format_string("position: section %d of %d", e["position"] + 1, p["chunk_count"]),
            F.lit("<document_chunk>"),
            e["text"],
            F.lit("</document_chunk>"),
        )

    shown = F.size("profiles")
    omitted = F.when(
        F.col("total_documents") > shown,
        F.array(
            F.format_string("documents_shown_below: %d (the rest are omitted for length)", shown)
        ),
    ).otherwise(F.array().cast("array<string>"))
    header = F.array_join(
        F.concat(
            F.array(
                F.lit("<document_profile>"),
                F.format_string("indexed_documents_total: %d", F.col("total_documents")),
            ),
            omitted,
            F.transform("profiles", profile_line),
            F.array(F.lit("</document_profile>")),
        ),
        "\n",
    )
    excerpt_texts = F.flatten(
        F.transform("profiles", lambda p: F.transform(p["excerpts"], lambda e: excerpt_block(p, e)))
    )
    sources = F.flatten(
        F.transform(
            "profiles",
            lambda p: F.transform(
                p["excerpts"],
                lambda e: F.struct(
                    tx.source_id(p["document_id"], e["chunk_id"]).alias("source_id"),
                    p["filename"].alias("filename"),
                    e["chunk_id"].alias("chunk_id"),
                    e["start_page"].alias("start_page"),
                    e["end_page"].alias("end_page"),
                    e["sequence"].alias("sequence"),
                    e["tokens"].alias("tokens"),
                ),
            ),
        )
    )
    return (
        profiles.withColumn("_sources", sources)
        .select(
            "total_documents",
            F.array_join(F.concat(F.array(header), excerpt_texts), "\n\n").alias("rendered"),
            F.aggregate("_sources", F.lit(0), lambda a, s: a + s["tokens"]).alias("estimated_tokens"),
            F.transform(
                "_sources",
                lambda s, i: F.struct(
                    (i + 1).alias("rank"),
                    s["source_id"].alias("source_id"),
                    s["filename"].alias("filename"),
                    s["chunk_id"].alias("chunk_id"),
                    s["start_page"].alias("start_page"),
                    s["end_page"].alias("end_page"),
                    s["sequence"].alias("sequence"),
                    F.lit(0.0).alias("distance"),
                ),
            ).alias("sources"),
        )
    )
