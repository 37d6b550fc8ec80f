"""Text requests as a stream: each batch publishes its segments and its rejects together.

A batch writes both into a folder of its own attempt. Then one file in the manifest, named by the batch's number, points
there: it is put in place whole (:mod:`clauseloom.sources.named_files`), and readers follow the manifest only. So they see both
tables of a batch or neither, and a batch that runs again takes the place of its earlier attempt.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.plans.parse import parse_documents
from clauseloom.sources.documents import REQUEST, check_requests, requests, routed
from clauseloom.sources.named_files import write_files

TABLES = ("segments", "rejects")


def publish(batch: DataFrame, number: int, out: str) -> None:
    """Writes the tables of a batch of requests (path, text, file_name, _corrupt_record) and points to them."""
    spark, attempt = batch.sparkSession, f"data/{number}-{uuid.uuid4().hex}"
    checked = check_requests(requests(batch))
    checked.write.parquet(f"{out}/{attempt}/checked")  # numbers of equal requests are given once for both tables
    accepted, rejects = routed(spark.read.schema(checked.schema).parquet(f"{out}/{attempt}/checked"))
    for name, table in zip(TABLES, (parse_documents(accepted), rejects), strict=True):
        table.write.parquet(f"{out}/{attempt}/{name}")
    entry = spark.createDataFrame([(f"{number}.json", json.dumps({"batch": number, "folder": attempt}))], "name string, content string")
    write_files(entry.coalesce(1), f"{out}/manifest", "name", "content")


#: A batch reads files of so many bytes, or one larger file: what has piled up doesn't decide what a task holds.
BATCH_BYTES = 256 << 20


def request_stream(spark: SparkSession, path: str, out: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Reads JSON requests (``{"text": ..., "file_name": ...}``, one a line) as they arrive at ``path``; malformed ones become rejects."""
    rows = spark.readStream.schema(REQUEST).option("mode", "PERMISSIVE").option("maxBytesPerTrigger", BATCH_BYTES).json(path).select("*", F.col("_metadata.file_path").alias("path"))
    run = lambda batch, number: publish(batch, number, out)
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def published(spark: SparkSession, out: str, name: str) -> DataFrame:
    """'segments' or 'rejects' of all batches in the manifest (one row of which is read for each batch), with ``batch``."""
    manifest = spark.read.schema("batch long, folder string").json(f"{out}/manifest")
    folders = sorted((r.batch, r.folder) for r in manifest.collect())
    if not folders:
        raise ValueError(f"no batch has been published in {out}")
    number = F.regexp_extract(F.col("_metadata.file_path"), rf"/data/(\d+)-[0-9a-f]+/{name}/", 1).cast("long")
    return spark.read.parquet(*[f"{out}/{folder}/{name}" for _, folder in folders]).select("*", number.alias("batch"))
