"""A sink with one file for each row, under the row's own name.

Each task writes a file in a folder of its own attempt below ``_temporary`` and moves it to its name once it is whole.
So readers see whole files only, whatever becomes of a task, and a task that runs again puts the same file in the same
place. ``_SUCCESS`` is written when all tasks have ended; what lost tasks left in ``_temporary`` goes then.

Where it is asked for, a task lists the names that it wrote in another folder, where the lists of the tasks that count are kept.
By these tasks read the files back: a listing of the folder, as Spark's readers make it, holds all files in the driver.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import RecordBatch, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

TEMPORARY, DONE = "_temporary", "_SUCCESS"
FORMAT = "named_files"
#: Files that one task reads back, about, and bytes of them that it hands on together, but for one larger file.
FILES, AT_ONCE = 4096, 16 << 20


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, local where it names none, and the path in it."""
    if re.match(r"file:/", folder) or "://" not in folder:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", folder)
    return fs.FileSystem.from_uri(folder)


def place_of(name: str) -> str:
    """A name as a place below the folder: it can't lead out of it."""
    return "/".join(part for part in name.split("/") if part not in ("", ".", "..")) or "unnamed"


@dataclass
class Wrote(WriterCommitMessage):
    """A task's attempt, which its list of names is called by."""

    attempt: str


class NamedFileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, lists: str | None = None) -> None:
        self.folder, self.lists = folder, lists

    def write(self, iterator: Iterator[RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.folder)
        attempt = uuid.uuid4().hex
        own = f"{root}/{TEMPORARY}/{attempt}"
        system.create_dir(own, recursive=True)
        made = set()
        with self.listed(attempt) as names:
            for batch in iterator:
                for name, content in zip(batch.column("name"), batch.column("content"), strict=True):
                    place = place_of(name.as_py())
                    with system.open_output_stream(f"{own}/now") as file:
                        file.write(content.as_py() or b"")
                    if (parent := f"{root}/{place}".rpartition("/")[0]) not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    self.put(system, f"{own}/now", f"{root}/{place}")
                    names.write(json.dumps({"place": place}).encode() + b"\n")
        system.delete_dir(own)
        return Wrote(attempt)

    def listed(self, attempt: str) -> BinaryIO:
        """Where the list of a task's names goes to."""
        if self.lists is None:
            return open(os.devnull, "wb")
        system, root = opened(self.lists)
        system.create_dir(f"{root}/{TEMPORARY}", recursive=True)
        return system.open_output_stream(f"{root}/{TEMPORARY}/{attempt}.json")

    @staticmethod
    def put(system: fs.FileSystem, temporary: str, place: str) -> None:
        try:
            system.move(temporary, place)
        except OSError:  # some stores don't move onto a file that another attempt has put there
            system.delete_file(place)
            system.move(temporary, place)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.lists is not None:
            system, root = opened(self.lists)
            system.create_dir(root, recursive=True)
            for message in messages:
                if message is not None:
                    system.move(f"{root}/{TEMPORARY}/{message.attempt}.json", f"{root}/{message.attempt}.json")
        system, root = opened(self.folder)
        self.abort(messages)
        with system.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for folder in filter(None, (self.folder, self.lists)):
            system, root = opened(folder)
            if system.get_file_info(f"{root}/{TEMPORARY}").type == fs.FileType.Directory:
                system.delete_dir(f"{root}/{TEMPORARY}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"], self.options.get("lists"))


def settled_names(rows: DataFrame, name: str = "output_name", key: str = "doc_id") -> DataFrame:
    """``rows`` with names that are theirs alone: of those with one name the least ``key`` keeps it, the others get a digest of theirs in front of the ending.

    Keys are distinct. No rows of one name come together: each is compared with its name's least key.
    """
    firsts = rows.groupBy(F.col(name).alias("_name")).agg(F.min(key).alias("_first"))
    joined = rows.join(firsts, F.col(name) == F.col("_name"))
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    own = F.concat(stem, F.lit("-"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 12), F.substring(F.col(name), F.char_length(stem) + 1, F.char_length(name)))
    return joined.withColumn(name, F.when(F.col(key) == F.col("_first"), F.col(name)).otherwise(own)).select(*rows.columns)


def write_files(rows: DataFrame, folder: str, name: Column | str = "output_name", content: Column | str = "json", lists: str | None = None) -> None:
    """A file for each row, with the bytes of ``content`` (null: none); names are distinct (:func:`settled_names`). ``lists``: a folder for lists of the names (:func:`read_files`)."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows.sparkSession.dataSource.register(NamedFiles)
    named = rows.select(column(name).alias("name"), column(content).cast("binary").alias("content")).write.format(FORMAT).mode("append")
    (named.option("lists", lists) if lists else named).save(folder)


def read_files(spark: SparkSession, folder: str, lists: str) -> DataFrame:
    """(file_name, content): the files that :func:`write_files` has put into ``folder``, each once; tasks find them by its ``lists``, so the driver holds none."""
    places = spark.read.schema("place string").json(lists)
    n = max(spark.sparkContext.defaultParallelism, -(-places.count() // FILES))

    def run(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        system, root = opened(folder)
        made = lambda names, contents: RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["file_name", "content"])
        for batch in batches:
            names, contents, size = [], [], 0
            for place in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{place}") as file:
                    content = file.read()
                if names and size + len(content) > AT_ONCE:
                    yield made(names, contents)
                    names, contents, size = [], [], 0
                names.append(place.rpartition("/")[2])
                contents.append(content)
                size += len(content)
            if names:
                yield made(names, contents)

    return places.repartition(n, "place").dropDuplicates(["place"]).mapInArrow(run, "file_name string, content binary")
