"""A corpus of policy documents rendered from plain ones: the same rule in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.sources.documents import spread


def rendered_line(doc_id: Column, i: Column, line: Column) -> Column:
    first = F.array_join(F.slice(F.split(line, " ", -1), 1, 3), " ")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    forms = [
        text(i + 1, " ", first, "\n", line),
        text(i, ".", doc_id % 7 + 1, " ", first, "\n", line),
        text(i, ".1.", doc_id % 5 + 1, ": ", first, "\n", line),
        text("- ", line),
        text("Section ", i + 1, ". ", first, "\n", line),
        text("A-", i + 1, " ", first),
        text(i + 1, ". ", F.lower(first), "\n", line),
        text("2024 ", first, "\n", i + 31, "\n", line),
        text("\t\t", line, "\r\n\n\n\n"),
    ]
    # what looks like a heading but for its spaces, its first character, its length or its colon
    vetoed = [
        text(i + 1, ".\u00a0 ", F.lower(first), "\n", line),
        text(i + 1, " *", first, "\n", line),
        text(i + 1, " T ", first, " ", first, " ", first, "\n", line),
        text(i + 1, " Terms:\n", line),
    ]
    out, r, q = line, (doc_id + i) % 10, F.floor((doc_id + i) / 10) % 5
    for k, form in enumerate(vetoed):
        out = F.when((r == len(forms)) & (q == k), form).otherwise(out)
    for k, form in enumerate(forms):
        out = F.when(r == k, form).otherwise(out)
    return out


def rendered(docs: DataFrame) -> DataFrame:
    """(doc_id, file_name, text) from (doc_id, text): each line becomes a heading, a bullet, noise or stays."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line, i: rendered_line(F.col("doc_id"), i.cast("long"), line))
    return docs.select("doc_id", F.concat(F.lit("policy-"), F.col("doc_id"), F.lit(".txt")).alias("file_name"), F.array_join(lines, "\n").alias("text"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
