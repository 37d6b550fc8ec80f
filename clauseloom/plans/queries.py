"""The registered queries of the segmentation library, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.text import clean_text
from clauseloom.operators.abbreviations import judged_types, type_counts, with_context
from clauseloom.operators.keywords import with_keywords_in_chunks
from clauseloom.operators.lines import classify
from clauseloom.operators.segments import group_lines
from clauseloom.plans.parse import classified_lines, grouped_documents, parse_documents, segment_documents, segment_files
from clauseloom.sources import documents as io
from clauseloom.sources.corpus import policies, rendered
from clauseloom.sources.lines import read_lines
from clauseloom.sources.named_files import read_files, settled_names, write_files
from clauseloom.sources.storage import new_folder, written
from clauseloom.streaming.requests import published, request_stream
from clauseloom.streaming.segments import segment_stream

CORE = ("doc_id", "seg_no", "clause_id", "level", "title", "text")


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: segments of each document by level."""
    return grouped_documents(policies(spark, sf_dir)).groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n_segments"))


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies(spark, sf_dir).select("doc_id", clean_text("text").alias("clean"))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_lines(policies(spark, sf_dir)).select("doc_id", "line_no", "kind", "heading_id", "title", "veto")


def heading_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_lines(policies(spark, sf_dir)).where("veto is not null").groupBy("veto").agg(F.count(F.lit(1)).alias("n_lines"))


def segments_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_documents(policies(spark, sf_dir)).select(*CORE, "depth")


def segment_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_documents(policies(spark, sf_dir)).select("doc_id", "seg_no", "clause_id", "parent_clause")


def preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents as they are and as rendered."""
    raw = io.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = [group_lines(classified_lines(docs)).where("clause_id like 'PREAMBLE-%'").select(F.lit(name).alias("corpus"), "doc_id", "clause_id", "title") for name, docs in (("raw", raw), ("rendered", policies(spark, sf_dir)))]
    return found[0].unionByName(found[1])


def segment_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(policies(spark, sf_dir)).select("doc_id", "seg_no", F.array_join("keywords", " ").alias("keywords"))


def segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_documents(policies(spark, sf_dir)).select("doc_id", "seg_no", "context")


def abbreviation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type of the rendered corpus, its counts, and whether it is an abbreviation."""
    return judged_types(type_counts(policies(spark, sf_dir)))


def learned_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts by the abbreviations of the corpus itself."""
    docs = policies(spark, sf_dir)
    types = judged_types(written(type_counts(docs)))
    return with_context(grouped_documents(docs), types).select("doc_id", "seg_no", "context")


def document_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = policies(spark, sf_dir)
    found = io.envelopes(docs, parse_documents(docs))
    return found.select("doc_id", "file_name", "total_segments", F.array_join(F.col("segments.clause_id"), " ").alias("clause_ids"))


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents as files, with names and texts that fail in turn, half as text requests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = F.col("doc_id") % 10
    text = F.when(r.isin(4, 5, 6), F.lit(" \n\t  ")).otherwise(F.col("text"))
    ending = F.when(r.isin(0, 4), ".PDF").when(r.isin(2, 6), ".docx").otherwise(".pdf")
    files = docs.where("doc_id % 2 = 0").select("doc_id", F.concat(F.lit("f"), F.col("doc_id"), ending).alias("file_name"), text.alias("text"))
    asked = docs.where("doc_id % 2 = 1").select("doc_id", F.lit(io.INLINE_NAME).alias("file_name"), text.alias("text"))
    found = io.routed(io.check_files(files))[1].unionByName(io.routed(io.check_requests(asked))[1])
    return found.select("doc_id", "file_name", "status")


def segment_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.preview(grouped_documents(policies(spark, sf_dir)))


def text_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON requests, some without a name or a text, and read again; status 200 for those that are accepted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("d"), "doc_id", F.lit(".txt"))).alias("file_name"), F.when(F.col("doc_id") % 7 > 0, F.col("text")).alias("text"))
    path = new_folder(spark)
    docs.write.json(path)
    return io.check_requests(io.read_requests(spark, path)).select("file_name", F.coalesce("status", F.lit(200)).alias("status"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def segments_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = policies(spark, sf_dir)
    return io.documents_json(io.envelopes(docs, parse_documents(docs)))


def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered corpus read as a stream of files, through foreachBatch; the written segments."""
    out = new_folder(spark)
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/documents.parquet*")
    segment_stream(stream, f"{out}/out", f"{out}/state", lambda batch: io.check_requests(rendered(batch))).awaitTermination()
    return spark.read.parquet(f"{out}/out/segments").select(*CORE)


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's segments in a JSON file of its own, under a chosen name that several documents share; the files as they are read back."""
    docs, out, lists = policies(spark, sf_dir), new_folder(spark), new_folder(spark)
    chosen = F.concat(F.lit("policy "), F.col("doc_id") % 250, F.lit(".json"))
    write_files(settled_names(io.documents_json(io.envelopes(docs, parse_documents(docs)), chosen)), out, lists=lists)
    return read_files(spark, out, lists).select("file_name", F.col("content").cast("string").alias("json"))


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, some with another ending, blank, or with bytes that aren't UTF-8, read as bytes and checked; status 200 for those accepted."""
    docs, r = io.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), F.col("doc_id") % 7
    bad = F.when(r == 3, "E282").when(r == 5, "C0AF").when(r == 6, "EDA080").otherwise("")  # cut short, overlong, half a pair
    text = F.when(F.col("doc_id") % 6 == 2, F.lit(" \n\t ")).otherwise(F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("né+ "), "doc_id", F.when(F.col("doc_id") % 5 == 1, ".docx").otherwise(".TXT"))
    out = new_folder(spark)
    write_files(docs.select(name.alias("name"), F.concat(text.cast("binary"), F.unhex(bad)).alias("content")), out, "name", "content")
    checked = io.check_files(io.read_bytes(spark, out), ".txt")
    return checked.select("file_name", F.coalesce("status", F.lit(200)).alias("status"), F.when(F.col("status").isNull(), F.md5("text")).alias("text_md5"))


def binders(spark: SparkSession, sf_dir: str) -> str:
    """A folder with rendered documents bound together: a file for each source and thousand of ids."""
    rows = policies(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "doc_id")
    name = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.floor(F.col("doc_id") / 1000), F.lit(".txt"))
    bound = rows.groupBy(name.alias("name")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "text")))["text"], "\n").alias("text"))
    out = new_folder(spark)
    write_files(bound, out, "name", "text")
    return out


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of large files, read by byte range."""
    lines = classify(read_lines(spark, binders(spark, sf_dir)))
    return lines.select("file_name", F.col("line_no").cast("int").alias("line_no"), "kind", "heading_id", F.md5("stripped").alias("line_md5"))


def split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of large files, found in chunks of their lines."""
    found = segment_files(spark, binders(spark, sf_dir))
    return found.select(io.named(F.col("doc_id")), "seg_no", "clause_id", "level", "title", "parent_clause", F.md5("text").alias("text_md5"))


def split_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of segments counted in chunks of their lines."""
    return with_keywords_in_chunks(grouped_documents(policies(spark, sf_dir))).select("doc_id", "seg_no", F.array_join("keywords", " ").alias("keywords"))


def envelope_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes in parts of 2,000 characters."""
    docs = policies(spark, sf_dir)
    found = io.envelope_parts(docs, parse_documents(docs), most_chars=2_000)
    return found.select("doc_id", "file_name", "total_segments", "from_segment", F.array_join("segments.clause_id", " ").alias("clause_ids"))


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents as JSON requests, some malformed, blank or without a name, read as a stream; what it has published of both tables."""
    docs = policies(spark, sf_dir)
    name = F.when(F.col("doc_id") % 3 > 0, F.col("file_name"))
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(" ")).otherwise(F.col("text"))
    asked = F.when(F.col("doc_id") % 11 == 4, F.concat(F.lit("{not json "), "doc_id")).otherwise(F.to_json(F.struct(text.alias("text"), name.alias("file_name"))))
    out = new_folder(spark)
    docs.select(asked.alias("value")).write.text(f"{out}/in")
    request_stream(spark, f"{out}/in", f"{out}/out", f"{out}/state").awaitTermination()
    segments = published(spark, f"{out}/out", "segments").select("file_name", F.lit(200).alias("status"), "seg_no", "clause_id", "parent_clause", F.md5("text").alias("text_md5"))
    rejects = published(spark, f"{out}/out", "rejects").select("file_name", "status")
    return segments.unionByName(rejects.withColumn("seg_no", F.lit(0)), allowMissingColumns=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (level_counts, clean_documents, line_kinds, heading_vetoes, segments_core, segment_parents, preambles, segment_keywords, segment_context, abbreviation_types, learned_context, document_envelope, rejects, segment_preview, segments_json, text_requests, stream_segments, json_files, file_checks, split_lines, split_segments, split_keywords, envelope_parts, stream_requests)
}
