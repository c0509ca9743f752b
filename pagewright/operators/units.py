"""Pages to text units: headings, sentences and parts of overlong sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as tx

UNIT = "struct<kind:string,n:int,text:string>"
# Stands for the space before a sentence; normalized text holds no control characters.
MARK = "\x01"


def _unit(kind: str, text: Column, n: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), n.alias("n"), text.alias("text"))


def _word_count(text: Column) -> Column:
    """Words of a stripped, non-empty piece of normalized text: they stand one space apart."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _no_units() -> Column:
    return F.array().cast(f"array<{UNIT}>")


def _parts(sentence: Column, target_words: int) -> Column:
    """An overlong sentence in parts of ``target_words`` words."""

    def parts(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(target_words))
        return F.transform(
            starts,
            lambda i: tx.let(
                F.slice(w, i + 1, F.lit(target_words)),
                lambda part: _unit("word", F.array_join(part, " "), F.size(part)),
            ),
        )

    return tx.let(F.split(sentence, " ", -1), parts)


def _block_units(block: Column) -> Column:
    """A heading in the first line is a unit of its own; the other lines form a paragraph. A
    heading doesn't end as a sentence does, so no mark follows it."""

    def paragraph_units(part: Column) -> Column:
        spaced = F.replace(F.replace(part, F.lit("\n" + MARK), F.lit(MARK)), F.lit("\n"), F.lit(" "))
        return F.transform(F.split(spaced, MARK, -1), lambda s: _unit("sentence", s, _word_count(s)))

    def on_first(first: Column) -> Column:
        rest = F.substring(block, F.length(first) + 2, F.length(block))
        section = F.array(_unit("section", first, _word_count(first)))
        headed = tx.let(
            rest, lambda r: F.when(r == "", section).otherwise(F.concat(section, paragraph_units(r)))
        )
        return F.when(tx.is_section_heading(first, stripped=True), headed).otherwise(paragraph_units(block))

    return tx.let(F.replace(F.substring_index(block, "\n", 1), F.lit(MARK), F.lit(" ")), on_first)


def unit_array(text: Column, target_words: int) -> Column:
    """Units of one normalized page, in reading order.

    Normalized text has no whitespace beside a newline or at its ends, no two spaces, and no more
    than two newlines in a row, so nothing needs to be stripped. Sentences are marked in the
    whole page at once.
    """
    marked = F.regexp_replace(text, tx.NORMALIZED_SENTENCE_BREAK, "$0" + MARK)
    marked = F.replace(marked, F.lit(" " + MARK), F.lit(MARK))

    def on_page(page: Column) -> Column:
        blocks = F.split(page, "\n\n", -1)
        return F.when(page == "", _no_units()).otherwise(F.flatten(F.transform(blocks, _block_units)))

    def overlong(unit: Column) -> Column:
        return (unit["n"] > target_words) & (unit["kind"] == "sentence")

    def short(units: Column) -> Column:
        split = F.transform(
            units, lambda u: F.when(overlong(u), _parts(u["text"], target_words)).otherwise(F.array(u))
        )
        return F.when(F.exists(units, overlong), F.flatten(split)).otherwise(units)

    return tx.let(tx.let(marked, on_page), short)


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Normalized text per page. ``empty`` tells whether the extracted text was blank,
    ``blank`` whether the normalized text is."""
    return (
        pages.withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("empty", tx.is_blank(F.col("text")))
        .withColumn("text", tx.normalize_text(F.col("text")))
        .withColumn("blank", tx.is_blank(F.col("text")))
    )


def with_units(normalized: DataFrame, target_words: int) -> DataFrame:
    return normalized.withColumn("units", unit_array(F.col("text"), target_words)).drop("text")


def page_units(pages: DataFrame, target_words: int) -> DataFrame:
    """One row per unit of every page."""
    units = with_units(normalize_pages(pages), target_words)
    # The outer form keeps the optimizer from computing the array twice; see chunking.
    return (
        units.select("document_id", "page_number", F.posexplode_outer("units").alias("unit_no", "unit"))
        .filter(F.col("unit").isNotNull())
        .select("document_id", "page_number", "unit_no", "unit.kind", "unit.n", "unit.text")
    )
