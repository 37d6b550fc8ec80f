"""Lines of text files that are read by byte range: one file may be the work of many tasks.

The rows are those that the whole text gives when it is cleaned and split. What a line's number depends on beyond
its own chunk of lines comes from one row for each chunk: how many lines it keeps, and whether it begins and ends
with an empty line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions.text import WS, replace, strip
from clauseloom.sources.documents import file_name, named
from clauseloom.sources.storage import written

#: 2**CHUNK_BITS lines of one byte range are numbered together.
CHUNK_BITS = 14
CHUNK = ["doc_id", "block", "chunk"]


def raw_lines(spark: SparkSession, path: str, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(doc_id, block, chunk, row, raw): a file's lines, ended by \\n, \\r\\n or \\r, in the order of block (the byte range's start) and row."""
    row = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), row.alias("row"), F.col("value").alias("raw"))
    return lines.withColumn("chunk", F.shiftright("row", chunk_bits))


def numbered_lines(raw: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, stripped) of the lines that aren't blank, as they stand in the cleaned text.

    Of a run of empty lines one counts, lines of white space count each, and numbers begin at the first line that isn't blank. The
    last one loses the white space at its end, as the whole text does.
    """
    rows = written(raw.select(*CHUNK, "row", (F.col("raw") == "").alias("empty"), replace("raw", "[ \\t]+", " ").alias("line")))
    in_chunk = Window.partitionBy(*CHUNK).orderBy("row")
    kept = ~F.col("empty") | ~F.coalesce(F.lag("empty").over(in_chunk), F.lit(False))
    rows = rows.withColumns({"stripped": strip("line"), "kept": kept.cast("long")})
    rows = rows.withColumn("k", F.sum("kept").over(in_chunk.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.col("stripped") != ""
    chunks = rows.groupBy(*CHUNK).agg(
        F.sum("kept").alias("n"), F.min_by("empty", "row").alias("opens_empty"), F.max_by("empty", "row").alias("ends_empty"), F.min(F.when(said, F.col("k"))).alias("first"), F.max(F.when(said, F.col("k"))).alias("last")
    )
    by_doc = Window.partitionBy("doc_id")
    before = by_doc.orderBy("block", "chunk")
    # a chunk that goes on with a run of empty lines counts one less
    chunks = chunks.withColumn("less", (F.col("opens_empty") & F.coalesce(F.lag("ends_empty").over(before), F.lit(False))).cast("long"))
    chunks = chunks.withColumn("at", F.coalesce(F.sum(F.col("n") - F.col("less")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("less"))
    chunks = chunks.withColumns({"begin": F.min(F.col("at") + F.col("first")).over(by_doc), "stop": F.max(F.col("at") + F.col("last")).over(by_doc)})
    found = rows.where(said).join(chunks.select(*CHUNK, "at", "begin", "stop"), CHUNK).withColumn("place", F.col("at") + F.col("k"))
    line = F.when(F.col("place") == F.col("stop"), replace("line", rf"[{WS}]+\z", "")).otherwise(F.col("line"))
    return found.select("doc_id", (F.col("place") - F.col("begin")).alias("line_no"), line.alias("line"), "stripped")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, line_no, line, stripped): what :func:`explode_lines` gives of cleaned whole texts, without any text in one row.

    A byte order mark in front of a file is no part of its text. Files without a line that isn't blank have no row; :func:`files` lists all.
    """
    lines = numbered_lines(raw_lines(spark, path))
    return lines.select("doc_id", named(F.col("doc_id")), "line_no", "line", "stripped")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, n_bytes) of all files that have a byte, whose content isn't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("doc_id"), file_name(), F.col("length").alias("n_bytes"))
