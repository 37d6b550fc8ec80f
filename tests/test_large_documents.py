"""Documents over many tasks, files as sources and sinks, requests as a stream, learned sentence ends."""

import json
import math
import os
import random
import re
import time
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.functions.text import clean_text
from clauseloom.operators import keywords, split
from clauseloom.operators.abbreviations import judged_types, type_counts, with_context
from clauseloom.operators.lines import classify, explode_lines
from clauseloom.operators.segments import with_parents
from clauseloom.plans.parse import parse_documents, parse_files, segment_documents, segment_files
from clauseloom.sources import documents as io
from clauseloom.sources import lines as split_lines
from clauseloom.sources import named_files
from clauseloom.streaming import requests
from tests.test_segments import SAMPLE, fold


@pytest.fixture
def small_splits(spark):
    """Byte ranges of a few kilobytes."""
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def odd_file(rng, n, ends):
    lines = []
    for i in range(n):
        r = rng.random()
        forms = [(0.3, ""), (0.35, " "), (0.4, "\t "), (0.43, "- "), (0.55, f"{rng.randint(1, 9)} Title"), (0.65, f"{rng.randint(1, 9)}.{rng.randint(1, 9)} Title"), (0.7, f"1.1.{i} Deep")]
        line = next((text for p, text in forms if r < p), None)
        lines.append(line if line is not None else "- item  " if r < 0.75 else "body  text é " * rng.randint(1, 20) if r < 0.98 else "long " * 1200)
    return "".join(line + rng.choice(ends) for line in lines)


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(7)
    texts = [odd_file(rng, 150, ends) for ends in (["\n"], ["\n", "\r\n", "\r"], ["\r\n"])]
    texts += ["\n\n \n\n" + texts[0] + "\n\n- \n\n\n \n", " \n" * 2000, texts[1].rstrip(), "- ", "x"]
    for i, text in enumerate(texts):
        (tmp_path / f"file {i}+é.txt").write_bytes(text.encode())
    return str(tmp_path)


@pytest.mark.parametrize("bits", [14, 3])
def test_lines_by_byte_range_are_those_of_whole_texts(spark, small_splits, folder, bits):
    want = explode_lines(io.read_documents(spark, folder).select("doc_id", clean_text("text").alias("text")))
    raw = split_lines.raw_lines(spark, folder, bits)
    assert raw.rdd.getNumPartitions() > 8
    columns = ["doc_id", "line_no", "line", "stripped"]
    got = split_lines.numbered_lines(raw)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_segments_of_split_files_are_those_of_whole_texts(spark, small_splits, folder, monkeypatch):
    monkeypatch.setattr(split, "CHUNK_BITS", 3)
    whole = parse_documents(io.read_documents(spark, folder))
    assert sorted(map(str, parse_files(spark, folder).select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    assert {r.file_name for r in whole.collect()} == {f"file {i}+é.txt" for i in (0, 1, 2, 3, 5, 6, 7)}
    assert {r.file_name: r.n_bytes for r in split_lines.files(spark, folder).collect()}["file 7+é.txt"] == 1


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_chunks_of_any_size(spark, bits):
    rng = random.Random(bits)
    texts = ["", "- a\n- b", SAMPLE, "Intro\n\n- x\n1 A\n\n2 B\n2.1 C\ny", odd_file(rng, 60, ["\n"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = classify(explode_lines(docs.select("doc_id", clean_text("text").alias("text"))))
    found = split.with_parents_in_chunks(split.group_lines_in_chunks(lines, bits), bits)
    want = segment_documents(docs)
    assert sorted(map(str, found.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert split.with_parents_in_chunks(split.group_lines_in_chunks(lines.limit(0), bits), bits).collect() == []


def test_no_step_is_keyed_by_a_document_alone(spark, folder):
    """In a large file no exchange of lines or segments but those of chunk summaries has the document as its only key."""
    (line,) = [r for r in [segment_files(spark, folder)._jdf.queryExecution().executedPlan().toString()]]
    assert not re.search(r"Window \[(?:sum|row_number)[^\n]*\], \[doc_id#\d+\], \[(?:line_no|seg_no|grp)#", line)


def test_large_documents_have_linear_parents(spark):
    took = {}
    for n in (80_000, 320_000):
        depths = [random.Random(n + i).randint(1, 7) for i in range(n)]
        rows = spark.createDataFrame([(1, i + 1, f"c{i}", d) for i, d in enumerate(depths)], "doc_id long, seg_no int, clause_id string, depth int").cache()
        rows.count()
        began = time.monotonic()
        found = with_parents(rows).select("seg_no", "parent_clause").toPandas().sort_values("seg_no").parent_clause
        took[n] = time.monotonic() - began
        rows.unpersist()
        assert found.where(found.notna(), None).tolist() == fold([(f"c{i}", d) for i, d in enumerate(depths)])
    assert took[80_000] < 30 and took[320_000] < 8 * took[80_000] + 10


def test_files_by_name(spark, tmp_path):
    rows = [(1, "a b é.txt", b"1 A\nx"), (2, "a b é.txt", b"\xff\xfe"), (3, "../up.txt", b"up"), (4, "sub/e.txt", None), (5, "sub/x.pdf", b"\xc3"), (6, "n%20+.txt", b" "), (7, "a b é.txt", b"z")]
    frame = spark.createDataFrame(rows, "doc_id long, output_name string, json binary").withColumn("name", F.lit("n"))
    for _ in range(2):  # a job that runs again puts the same files in place
        named_files.write_files(named_files.settled_names(frame), str(tmp_path / "out"))
    found = {os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, names in os.walk(tmp_path / "out") for f in names}
    assert len(found) == 8 and {"a b é.txt", "up.txt", "sub/e.txt", "sub/x.pdf", "n%20+.txt", "_SUCCESS"} < found
    checked = {r.file_name: (r.status, r.text) for r in io.check_files(io.read_bytes(spark, str(tmp_path / "out/*.txt")), ".txt").collect()}
    assert checked["a b é.txt"] == (None, "1 A\nx") and checked["up.txt"] == (None, "up") and checked["n%20+.txt"] == (422, " ")
    assert sorted(str(s) for s, _ in checked.values()) == ["422", "500", "None", "None", "None"]


def test_a_lost_task_leaves_no_partial_file(tmp_path):
    def rows():
        yield pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [b"whole", b"too"]})
        raise RuntimeError("the executor is lost")

    writer = named_files.NamedFileWriter(str(tmp_path))
    with pytest.raises(RuntimeError):
        writer.write(rows())
    # what is in place is whole; what isn't, is out of readers' sight
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir() if p.is_file()} == {"a": b"whole", "b": b"too"}
    assert [p.name for p in tmp_path.iterdir() if p.is_dir()] == ["_temporary"]
    writer.write(iter([pa.RecordBatch.from_pydict({"name": ["a", "b", "c"], "content": [b"whole", b"too", b"c"]})]))
    writer.commit([])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["_SUCCESS", "a", "b", "c"]


def ask(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))


def test_requests_publish_both_tables_or_none(spark, tmp_path, monkeypatch):
    ask(tmp_path / "in", "1.json", {"text": "1 A\nb"}, {"text": " ", "file_name": "x"}, "not json", {"text": "1 A\nb"})
    run = lambda: requests.request_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = lambda name: sorted(map(tuple, requests.published(spark, str(tmp_path / "out"), name).select("file_name", "batch").collect()))
    run()
    assert rows("segments") == [("inline.txt", 0)] * 2 and rows("rejects") == [("inline.txt", 0), ("x", 0)]
    ask(tmp_path / "in", "2.json", {"text": "2 B\nc", "file_name": "y"}, "{")

    def lost(*_args):
        raise RuntimeError("between the tables and the manifest")

    with monkeypatch.context() as patch:
        patch.setattr(requests, "write_files", lost)
        with pytest.raises(Exception, match="between the tables"):
            run()
    assert rows("segments") == [("inline.txt", 0)] * 2 and rows("rejects") == [("inline.txt", 0), ("x", 0)]
    run()
    assert rows("segments") == [("inline.txt", 0)] * 2 + [("y", 1)] and rows("rejects") == [("inline.txt", 0), ("inline.txt", 1), ("x", 0)]


def brute_types(texts):
    with_period, without, total, periods = Counter(), Counter(), 0, 0
    for text in texts:
        for token in text.split():
            core = re.sub("^[\"'“”‘’(\\[{]+|[\"'“”‘’)\\]},;:!?]+$", "", token)
            ends = core.endswith(".") and not core.endswith("..")
            total, periods = total + 1, periods + ends
            word = (core[:-1] if ends else core).lower()
            if re.fullmatch(r"[^\W\d_]+(\.[^\W\d_]+)*", word):
                (with_period if ends else without)[word] += 1
    p, out = periods / total, set()
    for word, k in with_period.items():
        rest, inner = without[word], word.count(".")
        letters = len(word) - inner
        likelihood = lambda rate: k * math.log(rate) + rest * math.log(1 - rate)  # noqa: B023, E731
        if 2 * (likelihood(0.99) - likelihood(p)) * math.exp(-letters) * (inner + 1) / letters**rest >= 0.3:
            out.add(word)
    return with_period, without, out


TEXTS = ["We met Dr. Smith at appr. five. He left. The sum appr. doubled in May.", "Ask Dr. Jones, e.g. about the files. The appr. date is known.", "(See appr. three.) The end... He said the word. \"Doubled,\" he said.", "Then e.g. The Hague, appr. There it ends. there were two. Smith went. He met Smith."] * 6


def test_abbreviations_are_learned(spark):
    counts = type_counts(spark.createDataFrame([(t,) for t in [*TEXTS, None, ""]], "text string"))
    rows = {r.type: r for r in judged_types(counts).collect()}
    with_period, without, short = brute_types(TEXTS)
    assert {t: (r.with_period, r.without_period) for t, r in rows.items()} == {t: (with_period[t], without[t]) for t in {*with_period, *without}}
    assert {t for t, r in rows.items() if r.abbreviation} == short and {"dr", "appr", "e.g"} <= short and "left" not in short
    assert (rows["there"].small, rows["there"].capital_inside) == (6, 0) and rows["the"].small > 0
    none = judged_types(type_counts(spark.createDataFrame([("no period",)], "text string")))
    assert {r.abbreviation for r in none.collect()} == {False} and judged_types(counts.limit(0)).collect() == []


def test_contexts_by_learned_abbreviations(spark):
    types = judged_types(type_counts(spark.createDataFrame([(t,) for t in TEXTS], "text string")))
    said = ["We saw appr. Smith there. Then Dr. Jones left. Third.", "It came to appr. He left. Third.", "", "One only", " . ", "J. Doe came. No. 5. then left! Gone."]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "doc_id long, seg_no int, text string")
    found = [r.context for r in with_context(rows, types).orderBy("seg_no").collect()]
    # 'he' is written small elsewhere and never capital inside a sentence; 'Smith' is never small
    assert found == ["We saw appr. Smith there. Then Dr. Jones left.", "It came to appr. He left.", "", "One only", ".", "J. Doe came. No."]


def test_keywords_of_segments_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(keywords, "LINES", 3)
    monkeypatch.setattr(keywords, "SHARES", 4)
    rng = random.Random(5)
    vocabulary = [*(f"{a}{b}ord" for a in "bcdfgl" for b in "aeiou"), "the", "etc.", "isn't", "U.S.", "one,\ntwo", "fig.\n", "a\n\nb"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 5, 60, 3_000)] + ["", "etc.", "see fig.\netc.", "1 2 3"]
    rows = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "doc_id long, seg_no int, text string").withColumn("chunk", F.lit("c"))
    for n in (1, 5, 40):
        want = {tuple(r) for r in keywords.with_keywords(rows.drop("chunk"), n).selectExpr("seg_no", "array_join(keywords, ' ')").collect()}
        assert {tuple(r) for r in keywords.with_keywords_in_chunks(rows, n).selectExpr("seg_no", "array_join(keywords, ' ')").collect()} == want


def test_a_segment_of_very_many_words(spark):
    """Nearly all of its words differ, so that no window may hold them; the most frequent ones come first all the same."""
    line = "concat('first second first ', array_join(transform(sequence(0, 97), k -> concat('w', translate(cast(id * 98 + k as string), '0123456789', 'abcdefghij'))), ' '))"
    text = spark.range(2_000).selectExpr(f"{line} as line").groupBy().agg(F.array_join(F.collect_list("line"), "\n").alias("text"))
    (row,) = keywords.with_keywords_in_chunks(text.select(F.lit(1).alias("doc_id"), F.lit(1).alias("seg_no"), "text"), 2).select("keywords").collect()
    assert row.keywords == ["first", "second"]


@pytest.mark.parametrize(("most", "bits"), [(5, 12), (40, 1), (10**6, 12)])
def test_parts_of_envelopes_make_the_whole(spark, most, bits):
    docs = spark.createDataFrame([(0, "a", SAMPLE), (1, "b", "- x"), (2, "c", "\n".join(f"{i} Title\n{'x' * (i % 9)}y" for i in range(1, 60)))], "doc_id long, file_name string, text string")
    segments = parse_documents(docs)
    parts = {}
    for r in io.envelope_parts(docs, segments, most, bits).orderBy("doc_id", "from_segment").collect():
        assert len(r.segments) == 1 or sum(len(s.text) for s in r.segments) <= most
        whole = parts.setdefault(r.doc_id, (r.file_name, r.total_segments, []))
        assert whole[:2] == (r.file_name, r.total_segments)
        whole[2].extend(r.segments)
    assert parts == {r.doc_id: (r.file_name, r.total_segments, r.segments) for r in io.envelopes(docs, segments).collect()}


def test_requests_that_have_piled_up_come_in_batches_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(requests, "BATCH_BYTES", 100)
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / f"in/{k}.json").write_text('{"text": "1 A\\nb"}\n' * 4)
    requests.request_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = requests.published(spark, str(tmp_path / "out"), "segments").collect()
    assert len(rows) == 20 and len({r.batch for r in rows}) > 1
