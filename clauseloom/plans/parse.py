"""The whole parse: documents in, segments out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.sentences import context
from clauseloom.functions.text import clean_text
from clauseloom.functions.words import ABBREVIATIONS, STOP_WORDS
from clauseloom.operators.keywords import TOP, with_keywords, with_keywords_in_chunks
from clauseloom.operators.lines import classify, explode_lines
from clauseloom.operators.segments import group_lines, with_parents
from clauseloom.operators.split import group_lines_in_chunks, with_parents_in_chunks
from clauseloom.sources.documents import named
from clauseloom.sources.lines import read_lines


def classified_lines(docs: DataFrame) -> DataFrame:
    return classify(explode_lines(docs.select("doc_id", clean_text("text").alias("text"))))


def grouped_documents(docs: DataFrame) -> DataFrame:
    """Segments with depth and level alone."""
    return group_lines(classified_lines(docs))


def segment_documents(docs: DataFrame) -> DataFrame:
    """Segments with level and parent, without keywords and context."""
    return with_parents(grouped_documents(docs))


def parse_documents(docs: DataFrame, top_n: int = TOP, stop_words: tuple[str, ...] = STOP_WORDS, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """(doc_id, seg_no, file_name, clause_id, level, title, text, parent_clause, keywords, context).

    ``docs`` has doc_id (one per document), file_name and text. All steps are keyed by doc_id, so one shuffle carries
    them, that of :func:`clauseloom.sources.documents.spread` where the documents come from there; nothing runs in Python.
    """
    named = F.coalesce(F.col("file_name"), F.lit(""))
    # the name travels on each document's lines, so no join is needed
    lines = explode_lines(docs.select("doc_id", named.alias("file_name"), clean_text("text").alias("text")), carried=("file_name",))
    segments = with_parents(group_lines(classify(lines), carried=("file_name",)))
    segments = with_keywords(segments, top_n, stop_words).withColumn("context", context("text", abbreviations=abbreviations))
    return segments.select("doc_id", "seg_no", "file_name", "clause_id", "level", "title", "text", "parent_clause", "keywords", "context")


def parse_files(spark: SparkSession, path: str, top_n: int = TOP, stop_words: tuple[str, ...] = STOP_WORDS, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> DataFrame:
    """The rows of :func:`parse_documents` for text files of any size (doc_id is the path): one file may be the work of many tasks.

    More shuffles than the parse by documents, which is the way for many small ones.
    """
    segments = segment_files(spark, path)
    segments = with_keywords_in_chunks(segments, top_n, stop_words).withColumn("context", context("text", abbreviations=abbreviations))
    return segments.select("doc_id", "seg_no", named(F.col("doc_id")), "clause_id", "level", "title", "text", "parent_clause", "keywords", "context")


def segment_files(spark: SparkSession, path: str) -> DataFrame:
    """Segments with level and parent of text files of any size."""
    return with_parents_in_chunks(group_lines_in_chunks(classify(read_lines(spark, path))))
