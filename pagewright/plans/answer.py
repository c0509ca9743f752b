"""Answering a table of questions against a chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.config import EngineConfig
from pagewright.functions import prompts
from pagewright.operators.admission import validate_questions
from pagewright.operators.context import build_context
from pagewright.operators.embedding import Embedder, embed, hash_embedder, validate_vectors
from pagewright.operators.knn import accept, knn, rank_candidates, split_finite
from pagewright.operators.overview import build_overview, render_overview
from pagewright.operators.routing import route_questions
from pagewright.session import materialize

TEXT_COLUMNS = ["chunk_id", "document_fingerprint", "filename", "text", "start_page", "end_page"]
ANSWER_COLUMNS = [
    "question_id",
    "question",
    "answer",
    "status",
    "sources",
    "candidate_count",
    "accepted_count",
    "top_k",
    "relevance_threshold",
    "context_token_estimate",
    "mode",
]
_SOURCES = (
    "array<struct<rank:int,source_id:string,filename:string,chunk_id:string,start_page:int,"
    "end_page:int,sequence:int,distance:double>>"
)


@dataclass(frozen=True)
class Generator:
    """``generate`` maps a batch of (system message, user message) to answers."""

    generate: Callable[[Sequence[tuple[str, str]]], Sequence[str]]
    batch: int = 16


def generate(prompts_df: DataFrame, generator: Generator | None) -> DataFrame:
    """Add ``answer``. Without a generator, the question's first line is echoed. A prompt that
    the generator fails on, or gives no answer for, has a null answer."""
    if generator is None:
        return prompts_df.withColumn("answer", prompts.echo_answer(F.col("user_message")))
    call, batch = generator.generate, generator.batch

    def ask(pairs: list[tuple[str, str]]) -> list[str | None]:
        try:
            got = list(call(pairs))
        except Exception:  # noqa: BLE001  a user's model may raise anything
            got = []
        if len(got) == len(pairs):
            return got
        # One by one, so that a failure costs its own prompt only.
        return [None] if len(pairs) == 1 else [x for pair in pairs for x in ask([pair])]

    def answers(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for systems, users in batches:
            pairs = list(zip(systems, users, strict=True))
            out: list[str | None] = []
            for start in range(0, len(pairs), batch):
                out.extend(ask(pairs[start : start + batch]))
            yield pd.Series(out, index=users.index, dtype=object)

    column = F.pandas_udf(answers, T.StringType())
    return prompts_df.withColumn("answer", column(F.col("system_message"), F.col("user_message")))


def with_chunk_columns(candidates: DataFrame, chunks: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Join text and pages back on to the candidates, a small written table.

    The ids are counted first. Up to a bound they are broadcast as a filter, so that only
    the texts asked for leave the chunk table's scan; the join proper then moves few rows.
    Beyond it both sides are shuffled.
    """
    keys = ["chunk_id", "document_fingerprint"]
    texts = chunks.select(*TEXT_COLUMNS)
    ids = candidates.select(*keys).distinct()
    if ids.count() <= cfg.broadcast_chunk_ids:
        texts = texts.join(F.broadcast(ids), keys, "left_semi")
    return candidates.join(texts, keys)


def _dimension(chunks: DataFrame) -> int | None:
    """Length of the stored vectors."""
    row = chunks.select(F.size("embedding").alias("d")).filter("d > 0").limit(1).first()
    return row.d if row else None


def _answered(df: DataFrame, mode: str, cfg: EngineConfig, **columns: Column) -> DataFrame:
    return df.select(
        "question_id",
        "question",
        columns.get("answer", F.col("answer")).alias("answer"),
        columns["status"].alias("status"),
        columns["sources"].cast(_SOURCES).alias("sources"),
        columns["candidates"].cast("int").alias("candidate_count"),
        columns["accepted"].cast("int").alias("accepted_count"),
        columns["top_k"].cast("int").alias("top_k"),
        F.lit(cfg.relevance_threshold).alias("relevance_threshold"),
        columns["tokens"].cast("int").alias("context_token_estimate"),
        F.lit(mode).alias("mode"),
    )


def _abstained(df: DataFrame, cfg: EngineConfig, accepted: Column) -> DataFrame:
    return _answered(
        df,
        "retrieval",
        cfg,
        answer=F.lit(prompts.ABSTENTION_MESSAGE),
        status=F.lit("abstained"),
        sources=F.array(),
        candidates=F.col("candidate_count"),
        accepted=accepted,
        top_k=F.least(F.lit(cfg.top_k), F.col("candidate_count")),
        tokens=F.lit(0),
    )


def _overview_prompts(questions: DataFrame, overview: DataFrame, fallback: bool) -> DataFrame:
    """Attach the one rendered overview, whose size the configuration bounds."""
    one_row = F.broadcast(overview.withColumn("_one", F.lit(1)))
    return (
        questions.withColumn("_one", F.lit(1))
        .join(one_row, "_one")
        .drop("_one")
        .withColumn("system_message", prompts.overview_system(F.lit(fallback)))
        .withColumn("user_message", prompts.overview_user(F.col("question"), F.col("rendered")))
    )


def _overview_answers(df: DataFrame, cfg: EngineConfig) -> DataFrame:
    shown = F.size("sources")
    return _answered(
        df,
        "document_overview",
        cfg,
        status=F.lit("answered"),
        sources=F.col("sources"),
        candidates=shown,
        accepted=shown,
        top_k=shown,
        tokens=F.col("estimated_tokens"),
    )


def answer_batch(
    questions: DataFrame,
    chunks: DataFrame,
    embedder: Embedder | None = None,
    generator: Generator | None = None,
    cfg: EngineConfig | None = None,
    overview: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Answers for the valid questions, and the rejected questions with their errors.

    ``overview`` is the rendered overview of ``chunks``, where the caller keeps one.
    The small tables that several branches share (routed questions, candidates, the
    overview) are written once.
    """
    cfg = cfg or EngineConfig()
    embedder = embedder or hash_embedder()
    valid, rejected = validate_questions(questions, chunks, cfg)

    routed = materialize(
        route_questions(valid.select("question_id", "question")).drop("normalized"), "routed-questions"
    )
    if overview is None:
        overview = materialize(render_overview(build_overview(chunks, cfg)), "overview")
    has_overview = not overview.isEmpty()

    by_overview = routed.filter("document_level").drop("document_level") if has_overview else None
    by_content = (routed.filter("not document_level") if has_overview else routed).drop("document_level")

    # Retrieval reads keys and vectors; texts join later, on the few accepted chunks.
    embedded = materialize(embed(by_content, "question", embedder), "question-vectors")
    # A bad vector costs its own question an answer, and no other.
    asked, unusable = validate_vectors(embedded, _dimension(chunks))
    hits = materialize(knn(asked, chunks, cfg.top_k, cfg.metric, cfg, check=False), "hits")
    hits, undefined = split_finite(hits)
    failed = unusable.select("question_id", "error_code", "error_status").unionByName(undefined)
    failed = materialize(failed, "failed-questions")
    rejected = rejected.unionByName(
        by_content.join(failed, "question_id").select("question_id", "question", "error_code", "error_status"),
        allowMissingColumns=True,
    )
    by_content = by_content.join(failed.select("question_id"), "question_id", "left_anti")
    candidates = materialize(rank_candidates(hits), "candidates")
    accepted = accept(candidates, cfg.relevance_threshold)
    contexts = build_context(with_chunk_columns(accepted, chunks, cfg), cfg.max_context_tokens)
    counted = candidates.groupBy("question_id").agg(F.count("*").cast("int").alias("candidate_count"))
    retrieved = materialize(
        by_content.join(counted, "question_id", "left")
        .join(contexts, "question_id", "left")
        .withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
        .withColumn("accepted_count", F.coalesce("accepted_count", F.lit(0))),
        "retrieved",
    )
    answers = _branches(retrieved, by_overview, overview if has_overview else None, generator, cfg)
    if generator is not None:
        # A model is asked once, however often the answers are read.
        answers = materialize(answers, "answers")
        silent = answers.filter("answer is null").select(
            "question_id", "question", F.lit("GENERATION_FAILED").alias("error_code"), F.lit(502).alias("error_status")
        )
        rejected = rejected.unionByName(silent, allowMissingColumns=True)
        answers = answers.filter("answer is not null")
    return answers, rejected


def _branches(
    retrieved: DataFrame,
    by_overview: DataFrame | None,
    overview: DataFrame | None,
    generator: Generator | None,
    cfg: EngineConfig,
) -> DataFrame:
    nothing_accepted = retrieved.filter("accepted_count = 0").select(
        "question_id", "question", "candidate_count"
    )
    nothing_fits = retrieved.filter("accepted_count > 0 and size(blocks) = 0")
    with_context = (
        retrieved.filter("accepted_count > 0 and size(blocks) > 0")
        .withColumn("system_message", prompts.grounded_system())
        .withColumn("user_message", prompts.grounded_user(F.col("question"), F.col("rendered")))
    )
    results = [
        _answered(
            generate(with_context, generator),
            "retrieval",
            cfg,
            status=F.lit("answered"),
            sources=F.col("sources"),
            candidates=F.col("candidate_count"),
            accepted=F.col("accepted_count"),
            top_k=F.least(F.lit(cfg.top_k), F.col("candidate_count")),
            tokens=F.col("estimated_tokens"),
        ),
        _abstained(nothing_fits, cfg, F.col("accepted_count")),
    ]
    if by_overview is not None:
        results.append(
            _overview_answers(generate(_overview_prompts(by_overview, overview, False), generator), cfg)
        )
    if overview is not None and cfg.enable_overview_fallback:
        tried = generate(_overview_prompts(nothing_accepted, overview, True), generator)
        if generator is not None:
            # A model is asked once; its answers decide between two branches.
            tried = materialize(tried, "fallback-answers")
        gave_up = F.coalesce(prompts.is_abstention(F.col("answer")), F.lit(False))
        results.append(_overview_answers(tried.filter(~gave_up), cfg))
        results.append(_abstained(tried.filter(gave_up), cfg, F.lit(0)))
    else:
        results.append(_abstained(nothing_accepted, cfg, F.lit(0)))

    answers = results[0]
    for branch in results[1:]:
        answers = answers.unionByName(branch)
    return answers.select(*ANSWER_COLUMNS)
