"""From accepted candidates to a token-bounded, rendered context per question.

A question has at most ``top_k`` candidates, so its rows fit into one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx

SOURCE_FIELDS = [
    "rank",
    "source_id",
    "filename",
    "chunk_id",
    "start_page",
    "end_page",
    "sequence",
    "distance",
]


def _within_budget(items: Column, max_tokens: int) -> Column:
    """Take items in order, skipping (not stopping at) any that would exceed the budget."""
    item_type = (
        "struct<rank:int,source_id:string,filename:string,chunk_id:string,start_page:int,"
        "end_page:int,sequence:int,distance:double,text:string,tokens:int>"
    )
    start = F.struct(
        F.lit(0).alias("total"), F.array().cast(f"array<{item_type}>").alias("kept")
    )

    def take(state: Column, item: Column) -> Column:
        return F.when(
            state["total"] + item["tokens"] <= max_tokens,
            F.struct(
                (state["total"] + item["tokens"]).alias("total"),
                F.array_append(state["kept"], item).alias("kept"),
            ),
        ).otherwise(state)

    return F.aggregate(items, start, take)


def reading_order(blocks: Column) -> Column:
    """Blocks by filename, start page and sequence; ranks settle what is left."""
    keyed = F.transform(
        blocks,
        lambda b: F.struct(
            b["filename"].alias("a"),
            b["start_page"].alias("b"),
            b["sequence"].alias("c"),
            b["rank"].alias("d"),
            b.alias("block"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["block"])


def render_context(blocks: Column) -> Column:
    def one(b: Column, i: Column) -> Column:
        return F.concat_ws(
            "\n",
            F.format_string("[SOURCE %d]", i + 1),
            F.concat(F.lit("source_id: "), b["source_id"]),
            F.concat(F.lit("filename: "), b["filename"]),
            F.format_string("pages: %d-%d", b["start_page"], b["end_page"]),
            F.concat(F.lit("chunk_id: "), b["chunk_id"]),
            F.format_string("sequence: %d", b["sequence"]),
            F.format_string("distance: %.6f", b["distance"]),
            F.lit("text:"),
            F.lit("<document_chunk>"),
            b["text"],
            F.lit("</document_chunk>"),
        )

    return F.array_join(F.transform(blocks, one), "\n\n")


def build_context(accepted: DataFrame, max_tokens: int) -> DataFrame:
    """One row per question with accepted chunks.

    ``blocks`` are in reading order, as numbered in the rendered context; ``sources`` are
    the same chunks in order of distance, with their rank among the candidates.
    """
    items = F.array_sort(F.collect_list(F.struct(*SOURCE_FIELDS, "text", tx.estimate_tokens(F.col("text")).alias("tokens"))))
    picked = accepted.groupBy("question_id").agg(items.alias("items")).select(
        "question_id",
        F.size("items").alias("accepted_count"),
        _within_budget(F.col("items"), max_tokens).alias("picked"),
    )
    return picked.select(
        "question_id",
        "accepted_count",
        reading_order(F.col("picked.kept")).alias("blocks"),
        F.transform("picked.kept", lambda s: F.struct(*[s[f].alias(f) for f in SOURCE_FIELDS])).alias("sources"),
        F.col("picked.total").alias("estimated_tokens"),
    ).withColumn("rendered", render_context(F.col("blocks")))


def rounded_distance(c: Column) -> Column:
    """Six decimals, halves up."""
    return F.floor(c * 1e6 + 0.5) / 1e6


def retrieval_diagnostics(questions: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Per question: length, counts, and what was found and accepted, in rank order."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "distance", "chunk_id")))
    per_question = candidates.groupBy("question_id").agg(ranked.alias("found"))
    within = F.filter("found", lambda c: c["distance"] <= threshold)
    none = F.array()
    return (
        questions.select("question_id", tx.utf16_length(F.col("question")).alias("question_length"))
        .join(per_question, "question_id", "left")
        .withColumn("within", within)
        .select(
            "question_id",
            "question_length",
            F.coalesce(F.size("found"), F.lit(0)).alias("candidate_count"),
            F.coalesce(F.size("within"), F.lit(0)).alias("accepted_count"),
            F.lit(threshold).alias("threshold"),
            F.coalesce(
                F.transform("found", lambda c: rounded_distance(c["distance"])), none.cast("array<double>")
            ).alias("candidate_distances"),
            F.coalesce(F.transform("within", lambda c: c["rank"]), none.cast("array<int>")).alias("accepted_ranks"),
            F.coalesce(F.transform("within", lambda c: c["chunk_id"]), none.cast("array<string>")).alias(
                "accepted_chunk_ids"
            ),
        )
    )
