"""Glossary of communities and host descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharelens.functions import text as T
from sharelens.operators.membership import keep_listed
from sharelens.operators.positions import with_position
from sharelens.session import settle, settle_small

GLOSSARY_DIMENSIONS = ["age", "gender", "partisan"]


def merge_lists(lists: list[DataFrame]) -> DataFrame:
    """Distinct non-empty names of all lists as ``id`` with their letter bucket."""
    merged = lists[0].select("id")
    for names in lists[1:]:
        merged = merged.union(names.select("id"))
    distinct = merged.where("id is not null and id <> ''").distinct()
    return distinct.withColumn("first_letter", T.letter_bucket(F.col("id")))


def sorted_names(names: DataFrame) -> DataFrame:
    return names.orderBy(F.lower("id"), "id")


def with_description(names: DataFrame, metadata: DataFrame, additional: DataFrame) -> DataFrame:
    """Description from the metadata, else from the additional table."""
    extra = additional.select("id", F.col("description").alias("__extra"))
    joined = names.join(metadata.select("id", "description"), "id", "left").join(extra, "id", "left")
    return joined.withColumn("description", F.coalesce("description", "__extra")).drop("__extra")


def short_description(text, width: int = 130):
    """First line of a cleaned text, escaped for LaTeX, status sentences replaced."""
    return T.replace_status(T.tex_escape(T.first_line(text, width)))


def glossary_lines(names: DataFrame, bins: DataFrame, width: int = 130) -> DataFrame:
    """``first_letter, position, id, line`` for names with a description.

    ``names`` has ``id, first_letter, description``; ``bins`` has ``id`` and one
    truncated z column per glossary dimension. Lines alternate their separator
    by position within the letter.
    """
    # ids alone are ranked; the texts are cut to their first line before they meet the positions
    keys = names.select("id", "first_letter", F.lower("id").alias("sort_key"))
    placed = with_position(keys, ["sort_key", "id"], ["first_letter"])
    # cleaned in a step of its own: the first line looks at its text several times
    clean = names.select("id", T.clean_description(F.coalesce("description", F.lit(""))).alias("clean"))
    short = clean.select("id", short_description(F.col("clean"), width).alias("short"))
    placed = placed.join(short, "id").join(bins.select("id", *GLOSSARY_DIMENSIONS), "id", "left")
    tags = [
        F.concat(F.lit("{gstd_"), T.score_tag(d, F.coalesce(F.col(d), F.lit(0))), F.lit("}"))
        for d in GLOSSARY_DIMENSIONS
    ]
    title = F.replace(F.col("id"), F.lit("_"), F.lit(r"\_"))
    ending = F.when(F.col("position") % 2 == 1, F.lit("&")).otherwise(F.lit("\\\\"))
    line = F.concat(
        F.lit(r"\glossarytitle{"), title, F.lit("}"), *tags,
        F.lit(r" \newline \glossarydesc{"),
        F.col("short"),
        F.lit("}"), ending,
    )
    return placed.select("first_letter", "position", "id", line.alias("line"))


def glossary_sections(lines: DataFrame) -> DataFrame:
    """The glossary file as ordered rows ``first_letter, position, line``.

    Each letter starts with a header at position -1; after an even number of
    lines the last one gets a closing break. Rows stay rows, so no letter has
    to fit into one task. Sort by letter and position to write the file.
    """
    lines = settle(lines)
    totals = settle_small(lines.groupBy("first_letter").agg(F.count(F.lit(1)).alias("__n")))
    n = F.col("__n")
    closing = F.when((F.col("position") == n - 1) & (n % 2 == 0), F.lit("\\\\")).otherwise(F.lit(""))
    body = lines.join(totals, "first_letter").select(
        "first_letter", "position", F.concat("line", closing).alias("line")
    )
    heads = totals.select(
        "first_letter",
        F.lit(-1).cast("bigint").alias("position"),
        F.concat(F.lit(r"\glossaryheader{"), "first_letter", F.lit("} &")).alias("line"),
    )
    return heads.unionByName(body)


def write_order(sections: DataFrame) -> DataFrame:
    return sections.orderBy("first_letter", "position").select("line")


def page_descriptions(pages: DataFrame) -> DataFrame:
    """``host, desc`` from a stored page table ``host, html``."""
    return pages.select("host", T.page_description(F.col("html")).alias("desc"))


def attach_descriptions(hosts: DataFrame, descriptions: DataFrame) -> DataFrame:
    return hosts.join(descriptions, "host", "left")


def drop_missing(descriptions: DataFrame) -> DataFrame:
    """Descriptions that exist; an empty text counts as missing once read from CSV."""
    return descriptions.where("desc is not null and desc <> ''")


def keep_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return keep_listed(words, vocabulary, "word")
