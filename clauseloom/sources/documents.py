"""Reading documents and text requests, validating them, and writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions.text import is_blank

INLINE_NAME = "inline.txt"
REQUEST = "text STRING, file_name STRING, _corrupt_record STRING"
#: Names of a segment's fields where it is written; an absent parent is left out.
FIELDS = ("file_name", "clause_id", "level", "title", "text", "parent_clause", "keywords", "context")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def named(path: Column) -> Column:
    """The name of a file by its path as Spark gives it, which is a URI's."""
    return F.url_decode(F.replace(base_name(path), F.lit("+"), F.lit("%2B"))).alias("file_name")


def file_name() -> Column:
    """The name of the file that a row was read from."""
    return named(F.col("_metadata.file_path"))


#: Bytes of a table's files that one partition of :func:`spread` holds, about.
PART_BYTES = 16 << 20


def spread(docs: DataFrame, *keys: str) -> DataFrame:
    """``docs`` dealt out by doc_id, which all steps by document use again, or by other ``keys``, or by whole rows where there is no doc_id; a stream stays as it is.

    How a table is read tells little: a file of one row group is one task's work, however many splits it has, and all patterns
    that lines are matched with would run there. Partitions grow in number with the files, so what a task sorts doesn't.
    """
    if docs.isStreaming:
        return docs
    by = keys or (["doc_id"] if "doc_id" in docs.columns else docs.columns)
    if not docs.inputFiles():
        return docs.repartition(*by)
    files = docs.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("n"))  # no column is read
    n_bytes = files.agg(F.sum("n")).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // PART_BYTES)), *by)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, text): whole text files; the id is the path, so that equal names stay apart. Spark passes over files of no bytes."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), file_name(), F.coalesce("value", F.lit("")).alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, text, undecodable): whole files, whose bytes are checked to be UTF-8; the text of others is null.

    No byte is ever replaced: :func:`check_files` rejects what can't be decoded.
    """
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), file_name(), F.when(valid, text).alias("text"), (~valid).alias("undecodable"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file_name, text, malformed): JSON lines ``{"text": ..., "file_name": ...}``; the name is optional."""
    rows = spark.read.schema(REQUEST).option("mode", "PERMISSIVE").json(path)
    return requests(rows.select("*", F.col("_metadata.file_path").alias("path")))


def requests(rows: DataFrame) -> DataFrame:
    """Requests from a batch of rows (path, text, file_name, _corrupt_record).

    Ids are made from a request's file and content, and number equal requests of one file: they stay the
    same when a batch runs again, and differ between files.
    """
    said = F.to_json(F.struct("path", "text", "file_name", "_corrupt_record"))
    named = rows.withColumn("_digest", F.sha2(said, 256))
    number = F.row_number().over(Window.partitionBy("_digest").orderBy("_digest"))
    doc_id = F.concat(F.col("_digest"), F.lit("-"), number).alias("doc_id")
    return named.select(doc_id, F.coalesce("file_name", F.lit(INLINE_NAME)).alias("file_name"), "text", F.col("_corrupt_record").isNotNull().alias("malformed"))


def check_files(docs: DataFrame, extension: str = ".pdf") -> DataFrame:
    """Adds status and detail: null for accepted documents, else those of the first check that fails.

    The name's ending is looked at before the text, whose bytes (:func:`read_bytes`) have to be text, and not blank.
    """
    failed = F.when(~F.lower("file_name").endswith(extension.lower()), F.struct(F.lit(400).alias("status"), F.lit(f"Only {extension} files are accepted.").alias("detail")))
    if "undecodable" in docs.columns:
        failed = failed.when(F.col("undecodable"), F.struct(F.lit(500).alias("status"), F.lit("The file isn't UTF-8 text.").alias("detail")))
    failed = failed.when(is_blank("text"), F.struct(F.lit(422).alias("status"), F.lit("No text could be extracted from the file.").alias("detail")))
    return docs.withColumn("_failed", failed).withColumns({"status": F.col("_failed.status"), "detail": F.col("_failed.detail")}).drop("_failed")


def check_requests(docs: DataFrame) -> DataFrame:
    """The same for text requests: malformed JSON and blank texts fail."""
    malformed = F.col("malformed") if "malformed" in docs.columns else F.lit(False)
    failed = F.when(malformed, F.struct(F.lit(500).alias("status"), F.lit("The request isn't valid JSON.").alias("detail")))
    failed = failed.when(is_blank("text"), F.struct(F.lit(400).alias("status"), F.lit("The text must not be empty.").alias("detail")))
    return docs.withColumn("_failed", failed).withColumns({"status": F.col("_failed.status"), "detail": F.col("_failed.detail")}).drop("_failed")


def routed(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted documents, rejects (doc_id, file_name, status, detail))."""
    accepted = checked.where("status is null").drop("status", "detail")
    return accepted, checked.where("status is not null").select("doc_id", "file_name", "status", "detail")


def envelopes(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, file_name, total_segments, segments): one row for each document, those without segments included."""
    own = F.struct("seg_no", *[F.col(c) for c in FIELDS])
    lists = segments.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_segments"), F.array_sort(F.collect_list(own)).alias("segments"))
    joined = docs.select("doc_id", "file_name").join(lists, "doc_id", "left")
    plain = F.transform("segments", lambda s: F.struct(*[s[c].alias(c) for c in FIELDS]))
    empty = F.array().cast(segments_type(segments))
    return joined.select("doc_id", "file_name", F.coalesce("total_segments", F.lit(0)).alias("total_segments"), F.coalesce(plain, empty).alias("segments"))


def envelope_parts(docs: DataFrame, segments: DataFrame, most_chars: int = 1 << 20, chunk_bits: int = 12) -> DataFrame:
    """(doc_id, file_name, total_segments, from_segment, segments): envelopes in parts of at most ``most_chars`` characters of text.

    A document's parts, by ``from_segment``, hold its segments in order. Texts laid end to end, a part is what lies in one stretch of
    that length, and a segment that reaches over a stretch's end is a part by itself; so only one that is longer makes a larger row.
    A document without segments has one part without any. Places are running sums in two levels, so no window holds a document.
    """
    sized = segments.select("doc_id", "seg_no", F.char_length("text").cast("long").alias("n"), F.shiftright("seg_no", chunk_bits).alias("chunk"))
    over = lambda *by: Window.partitionBy("doc_id", *by).rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("doc_id", "chunk").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy("doc_id")).cast("int").alias("total_segments")
    sums = sums.select("doc_id", "chunk", total, F.coalesce(F.sum("n").over(over().orderBy("chunk")), F.lit(0)).alias("n"))
    own = segments.select("doc_id", "seg_no", F.char_length("text").cast("long").alias("n"), F.shiftright("seg_no", chunk_bits).alias("chunk"), F.struct("seg_no", *[F.col(c) for c in FIELDS]).alias("own"))
    # a chunk's row of sums stands in front of its segments, so nothing is joined, and documents stay where they are
    rows = own.unionByName(sums, allowMissingColumns=True)
    in_chunk = over("chunk").orderBy(F.asc_nulls_first("seg_no"))
    rows = rows.withColumns({"begin": F.sum("n").over(in_chunk), "total_segments": F.first("total_segments").over(in_chunk)}).where("own is not null")
    stretch = lambda at: F.floor(at / F.lit(most_chars)).cast("long")
    placed = rows.select("doc_id", "seg_no", "own", "total_segments", stretch(F.col("begin")).alias("first"), stretch(F.col("begin") + F.greatest(F.col("n") - 1, F.lit(0))).alias("last"))
    parts = placed.groupBy("doc_id", "first", "last").agg(F.first("total_segments").alias("total_segments"), F.min("seg_no").alias("from_segment"), F.array_sort(F.collect_list("own")).alias("segments"))
    plain = F.transform("segments", lambda s: F.struct(*[s[c].alias(c) for c in FIELDS]))
    empty = F.array().cast(segments_type(segments))
    return docs.select("doc_id", "file_name").join(parts, "doc_id", "left").select("doc_id", "file_name", F.coalesce("total_segments", F.lit(0)).alias("total_segments"), F.coalesce("from_segment", F.lit(0)).alias("from_segment"), F.coalesce(plain, empty).alias("segments"))


def segments_type(segments: DataFrame) -> str:
    return "array<struct<" + ", ".join(f"{c}: {segments.schema[c].dataType.simpleString()}" for c in FIELDS) + ">>"


def preview(segments: DataFrame, first: int = 5, title: int = 45) -> DataFrame:
    """The first segments of each document, with titles cut."""
    return segments.where(F.col("seg_no") <= first).select("doc_id", "seg_no", "level", "clause_id", F.substring("title", 1, title).alias("title"))


def output_name(file_name: Column, chosen: Column | None = None) -> Column:
    """``chosen`` where it isn't null; else ``name.ext`` becomes ``name_output.json``. A leading dot starts no extension."""
    own = F.concat(F.regexp_replace(file_name, r"(?<=[^/])\.[^./]*$", ""), F.lit("_output.json"))
    return own if chosen is None else F.coalesce(chosen, own)


def documents_json(enveloped: DataFrame, chosen: Column | None = None) -> DataFrame:
    """(doc_id, output_name, json): each document's segments as one JSON array; absent parents are left out."""
    return enveloped.select("doc_id", output_name(F.col("file_name"), chosen).alias("output_name"), F.to_json("segments").alias("json"))


def write_segments(segments: DataFrame, path: str, form: str = "parquet", partitions: int | None = None) -> None:
    """One row per segment; ``form`` is any of Spark's file formats."""
    (segments.repartition(partitions, "doc_id") if partitions else segments).write.mode("overwrite").format(form).save(path)
