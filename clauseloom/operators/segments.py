"""Clauses from classified lines: grouping, preamble, text, depth and parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.text import strip

PREAMBLE_TITLE = 80


def depth(clause_id: Column) -> Column:
    """1 for 'Section ...', letter ids and preambles; else the number of dot-separated parts."""
    return F.when(clause_id.startswith("Section") | clause_id.rlike("^[A-Z]-"), 1).otherwise(F.size(F.split(clause_id, r"\.", -1)))


def level(of: Column) -> Column:
    return F.when(of == 1, "clause").when(of == 2, "sub-clause").otherwise("sub-sub-clause")


def group_lines(lines: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Segments (doc_id, seg_no, clause_id, title, text, depth, level, first_line) from classified lines.

    A heading opens a group. A group of other lines alone stands for a preamble if it has a body line,
    else it is dropped; headings without any line below are dropped too. ``seg_no`` counts from 1 in
    document order. ``carried`` names columns that are the same in all lines of a document; its segments have them too.
    """
    by_line = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grouped = lines.withColumn("grp", F.sum((F.col("kind") == "heading").cast("int")).over(by_line))
    body, text = F.col("kind") == "body", F.col("kind") != "heading"
    segments = grouped.groupBy("doc_id", "grp").agg(
        F.max("heading_id").alias("heading_id"),
        F.max("title").alias("title"),
        F.count_if(text).alias("n_lines"),
        F.min(F.when(body, F.struct("line_no", "stripped"))).alias("first_body"),
        F.min(F.when(text, F.col("line_no"))).alias("first_line"),
        F.array_sort(F.collect_list(F.when(text, F.struct("line_no", "stripped")))).alias("lines"),
        *[F.first(c).alias(c) for c in carried],
    )
    segments = named_groups(segments.withColumn("text", F.array_join(F.col("lines.stripped"), "\n")), carried)
    seg_no = F.row_number().over(Window.partitionBy("doc_id").orderBy("grp"))
    segments = segments.withColumns({"seg_no": seg_no, "depth": depth(F.col("clause_id"))})
    return segments.withColumn("level", level(F.col("depth"))).select("doc_id", "seg_no", "clause_id", "level", "depth", "title", "text", "first_line", *carried)


def named_groups(groups: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, grp, first_line, clause_id, title, text) of the groups that are segments, and the columns ``carried``."""
    groups = groups.where(F.when(F.col("grp") == 0, F.col("first_body").isNotNull()).otherwise(F.col("n_lines") > 0))
    head = F.col("grp") > 0
    clause_id = F.when(head, F.col("heading_id")).otherwise(F.concat(F.lit("PREAMBLE-"), F.col("first_body.line_no")))
    title = F.when(head, F.col("title")).otherwise(strip(F.substring("first_body.stripped", 1, PREAMBLE_TITLE)))
    return groups.select("doc_id", "grp", "first_line", clause_id.alias("clause_id"), title.alias("title"), "text", *carried)


def _places(of: Column, asks: bool) -> Column:
    """The sets of depths that a depth belongs to, or those that make up all lesser depths.

    Sets are the octaves (2**s to 2**(s+1) - 1, as (-1, s)) and, in an octave, runs of 2**j depths that begin at an even
    multiple (as (j, first / 2**j)). A depth is in one octave, and has a set for each zero among its lower binary digits; the
    depths below it are whole octaves, and a set for each one among those digits. So both are as many as it has digits.
    """
    top = F.char_length(F.bin(of)) - 1
    lower = F.when(top > 0, F.sequence(F.lit(0), top - 1)).otherwise(F.array().cast("array<int>"))
    shifted = lambda j: F.call_function("shiftright", of, j)
    place = lambda j, i: F.struct(j.cast("int").alias("j"), i.cast("int").alias("i"), F.lit(asks).alias("asks"))
    octaves = F.transform(lower, lambda s: place(F.lit(-1), s)) if asks else F.array(place(F.lit(-1), top))
    runs = F.transform(F.filter(lower, lambda j: shifted(j) % 2 == int(asks)), lambda j: place(j, shifted(j) - int(asks)))
    return F.concat(octaves, runs)


def place_rows(segments: DataFrame) -> DataFrame:
    """(doc_id, seg_no, j, i, asks, own, candidate): a row with a segment's other columns (j = -2), and one for each set of :func:`_places`."""
    own = [c for c in segments.columns if c not in ("doc_id", "seg_no")]
    first = F.array(F.struct(F.lit(-2).alias("j"), F.lit(0).alias("i"), F.lit(False).alias("asks")))
    at = F.explode(F.concat(first, _places(F.col("depth"), False), _places(F.col("depth"), True))).alias("at")
    rows = segments.select("doc_id", "seg_no", F.struct(*own).alias("own"), at).select("doc_id", "seg_no", "at.*", "own")
    candidate = F.when(~F.col("asks") & (F.col("j") > -2), F.struct("seg_no", F.col("own.clause_id").alias("clause_id")))
    return rows.withColumns({"candidate": candidate, "own": F.when(F.col("j") == -2, F.col("own"))})


def with_parents(segments: DataFrame) -> DataFrame:
    """Adds parent_clause: the id of the last segment before that is less deep; null if there is none.

    Depth has no bound: the lesser depths are a few sets (:func:`_places`), and in each the last segment before is a running
    value. Rows are as many as segments times the digits of their depths, and all steps are served by the
    partitioning by document.
    """
    before = Window.partitionBy("doc_id", "j", "i").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = place_rows(segments).withColumn("found", F.last("candidate", ignorenulls=True).over(before))
    return _joined(rows, segments.columns)


def _joined(rows: DataFrame, columns: list[str]) -> DataFrame:
    out = rows.groupBy("doc_id", "seg_no").agg(F.first("own", ignorenulls=True).alias("own"), F.max(F.when(F.col("asks"), F.col("found"))).alias("parent"))
    return out.select("doc_id", "seg_no", "own.*", F.col("parent.clause_id").alias("parent_clause")).select(*columns, "parent_clause")
