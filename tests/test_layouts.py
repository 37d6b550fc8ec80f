"""How work is dealt out to tasks, whatever the layout of a table and however common a key."""

import json

import pytest
from pyspark.sql import functions as F

from clauseloom.llm.common import table
from clauseloom.llm.forest import usable
from clauseloom.llm.queries import op1_main_text, op6_hash_forest, op8_format_chats, op11_prefix_trie
from clauseloom.operators.abbreviations import with_context
from clauseloom.plans import queries
from clauseloom.plans.parse import grouped_documents
from clauseloom.sources import documents as io
from clauseloom.sources import named_files
from clauseloom.streaming.segments import segment_stream
from tests.test_large_documents import small_splits  # noqa: F401


def test_a_table_of_one_row_group_is_dealt_out(spark, tmp_path, small_splits):  # noqa: F811
    """Before, its splits were counted, of which all but one are empty."""
    rows = spark.createDataFrame([(i, f"{i} Title\nline") for i in range(2000)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "docs.parquet"))
    table = spark.read.parquet(str(tmp_path / "docs.parquet"))
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    held = io.spread(table).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert len(held) >= spark.sparkContext.defaultParallelism and held.max() < 1000


def test_partitions_grow_with_the_table(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(io, "PART_BYTES", 1 << 12)
    assert io.spread(docs).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("query", [queries.document_envelope, queries.segments_json, queries.envelope_parts])
def test_texts_are_moved_once(spark, sf_dir, query):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # every exchange is that of the documents themselves
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_pieces_that_ask_for_no_type_have_keys_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "1 A\nOne etc. Two. Three."), (2, "1 B\nFour five.")], "doc_id long, text string")
    types = spark.createDataFrame([("etc", True, 0, 0)], "type string, abbreviation boolean, small long, capital_inside long")
    segments, seen, join = grouped_documents(docs), {}, type(docs).join

    def watched(left, right, on=None, how=None):
        if on in ("asked", "follows"):
            seen[on] = left.select(F.col(on)).collect()
        return join(left, right, on, how)

    monkeypatch.setattr(type(docs), "join", watched)
    found = with_context(segments, types).orderBy("doc_id").collect()
    assert [r.context for r in found] == ["One etc. Two. Three.", "Four five."]
    assert set(seen) == {"asked", "follows"} and all(len(set(keys)) == len(keys) == 4 and (None,) not in keys for keys in seen.values())


def test_a_batch_of_a_stream_is_dealt_out_before_it_is_checked(spark, tmp_path):
    spark.createDataFrame([(1, "a", "1 A\nb"), (2, "b", "- x")], "doc_id long, file_name string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []

    def check(batch):
        seen.append(batch._jdf.queryExecution().executedPlan().toString())
        return io.check_requests(batch)

    stream = spark.readStream.schema("doc_id long, file_name string, text string").parquet(str(tmp_path / "in"))
    segment_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), check).awaitTermination()
    assert seen and all("Exchange hashpartitioning(doc_id" in plan for plan in seen)
    assert spark.read.parquet(str(tmp_path / "out/segments")).count() == 1


def test_files_are_written_by_tasks_of_equal_work(spark, sf_dir, monkeypatch):
    plans, write = [], queries.write_files

    def watched(rows, *args):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, *args)

    monkeypatch.setattr(queries, "write_files", watched)
    assert queries.file_checks(spark, sf_dir).count() == 200
    assert all("Exchange hashpartitioning(doc_id" in plan for plan in plans) and plans


def test_folders_of_any_name_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "PART_BYTES", 1 << 9)
    for name in ("a b%20é", "x[1]{2}"):
        path = str(tmp_path / name)
        spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).coalesce(1).write.parquet(path)
        read = spark.read.parquet(path.replace("[", "\\[").replace("{", "\\{"))
        docs = io.spread(read.select("doc_id", "text"))
        assert docs.count() == 100 and 1 < docs.rdd.getNumPartitions() < 20
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert io.spread(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_tables_without_documents_are_dealt_out_by_rows(spark, sf_dir, tmp_path, small_splits):  # noqa: F811
    """Before, every table was dealt out by doc_id, which pages, conversations and embeddings don't have."""
    for name in ("pages", "conversations", "embeddings"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        held = table(spark, sf_dir, name)
        assert sorted(held.rdd.map(repr).collect()) == sorted(rows.rdd.map(repr).collect())
    # rows without a key don't come together
    spark.range(2000).select(F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.lit("<p>x").alias("html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    held = table(spark, str(tmp_path), "pages").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert held.sum() == 2000 and held.max() < 1000


def test_op1_of_the_table(spark, sf_dir):
    assert op1_main_text(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def test_vectors_are_dealt_out_by_the_id_they_are_grouped_by(spark, sf_dir):
    plan = usable(table(spark, sf_dir, "embeddings", "vec_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert op6_hash_forest(spark, sf_dir).groupBy("query_id").count().where("count = 20").count() == 25


def test_turns_are_moved_once(spark, sf_dir):
    found = op8_format_chats(spark, sf_dir)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert found.where("conv_id >= 0").count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()


def test_op11_of_the_table(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null").select("conv_id").distinct().count()
    assert op11_prefix_trie(spark, sf_dir).where("depth = 0").first().n_convs == conversations


def test_named_files_are_read_back_without_a_listing(spark, tmp_path, monkeypatch):
    """Before, Spark's reader of whole texts held every file's name in the driver, and gave 32 files to a task."""
    monkeypatch.setattr(named_files, "FILES", 20)
    monkeypatch.setattr(named_files, "AT_ONCE", 64)
    out, lists = str(tmp_path / "out"), str(tmp_path / "lists")
    rows = [(i, f"a b%20é/{i}\n.json" if i % 2 else f"{i}.json", f"[{i}é]".encode()) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, name string, content binary")
    for _ in range(2):  # names that are written again count once
        named_files.write_files(frame, out, "name", "content", lists)
    (tmp_path / "lists/_temporary").mkdir()
    (tmp_path / "lists/_temporary/lost.json").write_text(json.dumps({"place": "none"}))
    found = named_files.read_files(spark, out, lists)
    assert all("/lists/" in f for f in found.inputFiles())
    assert found.rdd.getNumPartitions() >= 50
    assert sorted(map(tuple, found.collect())) == sorted((n.rpartition("/")[2], c) for _, n, c in rows)
    named_files.write_files(frame.limit(0), str(tmp_path / "none"), "name", "content", str(tmp_path / "no"))
    assert named_files.read_files(spark, str(tmp_path / "none"), str(tmp_path / "no")).count() == 0
