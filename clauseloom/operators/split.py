"""Segments of documents that are too large for one task: the same rows as the steps by document give.

No step is keyed by a document alone. Lines are dealt out in chunks of neighbours; what a chunk needs of those before it
(the open heading's number, kept segments, the last segment of each set of depths) is a running value over one
row for each chunk. A segment's text is put together from its chunks' parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.segments import _joined, depth, level, named_groups, place_rows
from clauseloom.sources.storage import written

#: 2**CHUNK_BITS neighbours (lines, groups or segments) are one chunk.
CHUNK_BITS = 12


def _earlier(chunks: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Adds ``earlier``: the sum of ``value`` over the chunks of the same keys before."""
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("earlier", F.coalesce(F.sum(value).over(before), F.lit(0))).select(*keys, "chunk", "earlier")


def group_lines_in_chunks(lines: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """As :func:`group_lines`."""
    columns = ["doc_id", "line_no", "stripped", "kind", "heading_id", "title"]
    rows = written(lines.select(*columns).withColumns({"chunk": F.shiftright(F.col("line_no").cast("long"), chunk_bits), "head": (F.col("kind") == "heading").cast("long")}))
    heads = _earlier(rows.groupBy("doc_id", "chunk").agg(F.sum("head").alias("n")), ["doc_id"], F.col("n"))
    own = F.sum("head").over(Window.partitionBy("doc_id", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    grouped = rows.withColumn("own", own).join(heads, ["doc_id", "chunk"]).withColumn("grp", F.col("earlier") + F.col("own"))

    body, text = F.col("kind") == "body", F.col("kind") != "heading"
    parts = grouped.groupBy("doc_id", "grp", "chunk").agg(
        F.max("heading_id").alias("heading_id"),
        F.max("title").alias("title"),
        F.count_if(text).alias("n_lines"),
        F.min(F.when(body, F.struct("line_no", "stripped"))).alias("first_body"),
        F.min(F.when(text, F.col("line_no"))).alias("first_line"),
        F.array_sort(F.collect_list(F.when(text, F.struct("line_no", "stripped")))).alias("lines"),
    )
    part = F.when(F.col("n_lines") > 0, F.struct("chunk", F.array_join("lines.stripped", "\n").alias("text")))
    groups = parts.withColumn("part", part).groupBy("doc_id", "grp").agg(
        F.max("heading_id").alias("heading_id"),
        F.max("title").alias("title"),
        F.sum("n_lines").alias("n_lines"),
        F.min("first_body").alias("first_body"),
        F.min("first_line").alias("first_line"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    segments = named_groups(groups.withColumn("text", F.array_join("parts.text", "\n")))
    segments = written(segments.withColumn("chunk", F.shiftright("grp", chunk_bits)))
    kept = _earlier(segments.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n")), ["doc_id"], F.col("n"))
    number = F.row_number().over(Window.partitionBy("doc_id", "chunk").orderBy("grp"))
    segments = segments.withColumn("own", number).join(kept, ["doc_id", "chunk"]).withColumn("seg_no", (F.col("earlier") + F.col("own")).cast("int"))
    segments = segments.withColumn("depth", depth(F.col("clause_id"))).withColumn("level", level(F.col("depth")))
    return segments.select("doc_id", "seg_no", "clause_id", "level", "depth", "title", "text", "first_line")


def with_parents_in_chunks(segments: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """As :func:`with_parents`."""
    keys = ["doc_id", "j", "i"]
    rows = place_rows(segments).withColumn("chunk", F.shiftright("seg_no", chunk_bits))
    # a row with the segment's own columns stands for no set: it would bring all of a document's texts together
    own, rows = rows.where("j = -2").drop("chunk"), rows.where("j > -2").drop("own")
    before = lambda *by: Window.partitionBy(*keys, *by).rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(*keys, "chunk").agg(F.max("candidate").alias("last"))
    far = last.withColumn("far", F.last("last", ignorenulls=True).over(before().orderBy("chunk"))).select(*keys, "chunk", "far")
    near = rows.withColumn("near", F.last("candidate", ignorenulls=True).over(before("chunk").orderBy("seg_no"))).where("asks")
    found = near.join(far, [*keys, "chunk"]).withColumn("found", F.coalesce("near", "far"))
    found = found.withColumn("own", F.lit(None).cast(own.schema["own"].dataType))
    return _joined(own.withColumn("found", F.lit(None).cast(found.schema["found"].dataType)).unionByName(found.select("doc_id", "seg_no", "j", "i", "asks", "candidate", "own", "found")), segments.columns)
