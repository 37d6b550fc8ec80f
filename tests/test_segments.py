"""Hand-derived documents, lines and gates; invariants; the plan."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauseloom.functions.sentences import context
from clauseloom.functions.text import BLANKS, WS, clean_text, is_blank, strip
from clauseloom.functions.words import STOP_WORDS, key_words, letter_words, marks_apart, word_tokens
from clauseloom.operators.keywords import with_keywords
from clauseloom.operators.lines import VETOES, classify, explode_lines
from clauseloom.plans.parse import classified_lines, parse_documents, segment_documents
from clauseloom.sources import documents as io
from clauseloom.sources.corpus import policies
from clauseloom.streaming.segments import segment_stream

SAMPLE = """1 Library Loans
Members borrow books from every branch.

1.1 Loan Periods
A loan runs for three weeks. It may be renewed once.
- Renewed loans run for two weeks.
- Reserved books cannot be renewed.

1.2 Late Books
Late books cost a fee per day.
• Fees stop after 60 days.

2 Reading Rooms
Reading rooms are quiet.

2.1 Group Rooms
Group rooms are booked online, rooms for two included.
* Bookings end after 2 hours.
* Unused bookings end after 15 minutes.

B-2 Lost Cards
Section 4 Visitors
Visitors sign the guest book.
"""


def parsed(spark, *texts):
    rows = [(i, "a.txt", t) for i, t in enumerate(texts)]
    return parse_documents(spark.createDataFrame(rows, "doc_id long, file_name string, text string")).orderBy("doc_id", "seg_no").collect()


def test_sample(spark):
    rows = parsed(spark, SAMPLE)
    assert [(r.clause_id, r.level, r.parent_clause, r.title, r.keywords) for r in rows] == [
        ("1", "clause", None, "Library Loans", ["members", "borrow", "books", "every", "branch"]),
        ("1.1", "sub-clause", "1", "Loan Periods", ["renewed", "weeks", "loan", "runs", "three"]),
        ("1.2", "sub-clause", "1", "Late Books", ["late", "books", "cost", "fee", "per"]),
        ("2", "clause", None, "Reading Rooms", ["reading", "rooms", "quiet"]),
        ("2.1", "sub-clause", "2", "Group Rooms", ["rooms", "bookings", "end", "group", "booked"]),
        ("Section 4", "clause", None, "Visitors", ["visitors", "sign", "guest", "book"]),
    ]
    assert rows[1].context == "A loan runs for three weeks. It may be renewed once."


STRUCTURES = [
    ("Intro text\n1.1 Scope\nbody", [("PREAMBLE-0", "clause", None), ("1.1", "sub-clause", "PREAMBLE-0")]),
    ("- a\n\nIntro\n1 Scope\nbody", [("PREAMBLE-2", "clause", None), ("1", "clause", None)]),
    ("- a\n- b", []),
    ("- a\n1 Scope\nbody", [("1", "clause", None)]),
    ("1 A\nx\n2 B\n2.1 C\ny", [("1", "clause", None), ("2.1", "sub-clause", "1")]),
    ("1.2.3.4 Deep\nx\n1.1 Up\ny", [("1.2.3.4", "sub-sub-clause", None), ("1.1", "sub-clause", None)]),
    ("1 A\nx\n1.1.1 B\ny\n1.2 C\nz\n1.2.1 D\nw", [("1", "clause", None), ("1.1.1", "sub-sub-clause", "1"), ("1.2", "sub-clause", "1"), ("1.2.1", "sub-sub-clause", "1.2")]),
    ("Section 3.1 A\nx\nA-1.2 B\ny\n4.1 C\nz", [("Section 3.1", "clause", None), ("A-1.2", "clause", None), ("4.1", "sub-clause", "A-1.2")]),
    ("1 A\n- only bullet", [("1", "clause", None)]),
    ("", []),
]


def test_structures(spark):
    rows = parsed(spark, *[t for t, _ in STRUCTURES])
    for i, (_, wanted) in enumerate(STRUCTURES):
        assert [(r.clause_id, r.level, r.parent_clause) for r in rows if r.doc_id == i] == wanted
    assert next(r for r in rows if r.doc_id == 1).text == "- a\nIntro"


LINES = {
    "1 Data Security": ("heading", "1", "Data Security"), "1. Introduction": ("heading", "1", "Introduction"), "3. the bank shall": "body",
    "3.1": ("heading", "3.1", ""), "3.1.": "body", "3.": "body", "7": "bare_integer", "90 Days Notice": ("heading", "90", "Days Notice"),
    "Section 3. Auditing": ("heading", "Section 3.", "Auditing"), "Section 3 the bank": "body", "SECTION 4 X": "body",
    "A-1 Special Provisions": ("heading", "A-1", "Special Provisions"), "3.1 . the": ("heading", "3.1", ". the"), "3.1: Scope": ("heading", "3.1", "Scope"),
    "3.1 : Scope": ("heading", "3.1", "Scope"), "3 été": "lowercase_title", "3 Été": ("heading", "3", "Été"), "4 A B C D E F G": ("heading", "4", "A B C D E F G"),
    '5 "Quoted" Title': "noise", "3.2 Data & Privacy": "noise", "3.5% of": "body", "3.5 % of": "noise", "3.1 90 days": "body", "3.1 été": ("heading", "3.1", "été"),
    "1) Item": "body", "A-1. Foo": ("heading", "A-1.", "Foo"), "12.Foo": "body", "3.1  the": ("heading", "3.1", "the"), "3.1 the scope": "body",
    "2024 Annual Report": "year", "2. The key elements are:": "colon_end", "3.2 Key elements are:": ("heading", "3.2", "Key elements are:"),
    "4 A B C D E F G H": "long_title", "5 (Optional) Title": "noise", "3.2 Governance and oversight, etc": ("heading", "3.2", "Governance and oversight, etc"),
    "- x": "bullet", "• x": "bullet", "a) x": "bullet", "iv) x": "bullet", "(2) x": "bullet", "- ": "bullet", "-": "body", "-x": "body", "(a) x": "body", "A) x": "body",
}


def test_lines(spark):
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "doc_id long, text string")
    found = {r.doc_id: r for r in classify(explode_lines(docs)).collect()}
    for i, (line, wanted) in enumerate(LINES.items()):
        r = found[i]
        if isinstance(wanted, tuple):
            assert (r.kind, r.heading_id, r.title) == wanted, line
        else:
            assert wanted in ((r.kind,) if r.veto is None else (r.veto,)) and r.heading_id is None, line


def test_cleaning(spark):
    cases = {"a\r\nb\rc": "a\nb\nc", "a\n\n\n\nb": "a\n\nb", "a\n \n \nb": "a\n \n \nb", "a\t \tb": "a b", "\xa0a\xa0": "a", "a\xa0\xa0b": "a\xa0\xa0b", None: ""}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", clean_text("text").alias("c")).collect()
    assert all(r.c == cases[r.text] for r in rows)


def test_gates(spark):
    files = spark.createDataFrame([(0, "a.PDF", "x"), (1, "a.docx", " "), (2, "a.pdf", " \n\t "), (3, "b.pdf", None)], "doc_id long, file_name string, text string")
    accepted, rejected = io.routed(io.check_files(files))
    assert [r.doc_id for r in accepted.collect()] == [0]
    assert {r.doc_id: r.status for r in rejected.collect()} == {1: 400, 2: 422, 3: 422}


def test_requests_and_names(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"text": "1 A\\nb"}\n{"text": " ", "file_name": "x"}\nnot json\n')
    checked = io.check_requests(io.read_requests(spark, str(tmp_path))).collect()
    assert sorted((r.file_name, r.status) for r in checked if r.status) == [("inline.txt", 500), ("x", 400)]
    names = spark.createDataFrame([("d/a.b.txt",), (".hidden",), ("plain",)], "n string").select(io.output_name(F.col("n")).alias("o")).collect()
    assert [r.o for r in names] == ["d/a.b_output.json", ".hidden_output.json", "plain_output.json"]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/p.txt").write_text("1 A\nb")
    assert [(r.file_name, r.text) for r in io.read_documents(spark, str(tmp_path / "docs")).collect()] == [("p.txt", "1 A\nb")]


def test_envelopes_keep_documents_without_segments(spark):
    docs = spark.createDataFrame([(0, "a", "1 A\nb"), (1, "a", "- x")], "doc_id long, file_name string, text string")
    rows = {r.doc_id: r for r in io.envelopes(docs, parse_documents(docs)).collect()}
    assert rows[0].total_segments == 1 and rows[1].total_segments == 0 and rows[1].segments == []


def test_words_and_sentences(spark):
    row = spark.range(1).select(
        key_words(F.lit("The U.S. bank's and/or role-based cannot: policy, policy 1,000 don't end.")).alias("w"),
        context(F.lit("Dr. Smith met J. Doe at No. 5. then left. He won! Third one.")).alias("c"),
        context(F.lit("")).alias("e"),
    ).first()
    assert row.w == ["bank", "policy", "policy", "end"] and "must" not in STOP_WORDS
    assert row.c == "Dr. Smith met J. Doe at No. 5. then left. He won!" and row.e == ""


def fold(segments):
    out, stack = [], []
    for clause, depth in segments:
        out.append(next((c for c, d in reversed(stack) if d < depth), None))
        while stack and stack[-1][1] >= depth:
            stack.pop()
        stack.append((clause, depth))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(1, 16), min_size=1, max_size=14), min_size=1, max_size=6))
def test_parents_equal_a_stack_at_any_depth(spark, docs):
    texts = ["\n".join(f"{'.'.join(['1'] * (d - 1) + [str(i + 1)])} Title\nbody" for i, d in enumerate(ds)) for ds in docs]
    rows = segment_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "seg_no").collect()
    for i in range(len(texts)):
        own = [r for r in rows if r.doc_id == i]
        assert [r.parent_clause for r in own] == fold([(r.clause_id, r.depth) for r in own])


def test_invariants(spark, sf_dir):
    docs = policies(spark, sf_dir)
    rows = parse_documents(docs).collect()
    for r in rows:
        assert r.text and len(r.keywords) <= 5 and all(k == k.lower() and k.isalpha() for k in r.keywords)
        assert not r.clause_id.startswith("PREAMBLE") or r.seg_no == 1
    assert sum(e.total_segments for e in io.envelopes(docs, parse_documents(docs)).collect()) == len(rows)


def test_long_inner_spaces_and_deep_documents(spark):
    padded = "x" + " " * 1_000_000 + "x"
    began = time.monotonic()
    row = spark.createDataFrame([(padded,), (" " * 1_000_000,)], "t string").select(F.length(strip("t")).alias("n"), is_blank("t").alias("b")).collect()
    assert [tuple(r) for r in row] == [(1_000_002, False), (0, True)]
    text = "\n".join(f"{'.'.join(['1'] * (13 + i % 5))} Title\nbody" for i in range(20_000))
    rows = segment_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("seg_no", "clause_id", "depth", "parent_clause").orderBy("seg_no").collect()
    assert [r.parent_clause for r in rows] == fold([(r.clause_id, r.depth) for r in rows])
    assert time.monotonic() - began < 90


def test_corpus_reaches_every_veto(spark, sf_dir):
    found = classified_lines(policies(spark, sf_dir)).where("veto is not null").select("veto").distinct().collect()
    assert {r.veto for r in found} == set(VETOES)


def test_request_ids_stay_when_read_again(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"text": "1 A\\nb"}\n{"text": "1 A\\nb"}\n{"text": "c", "file_name": "x"}\n')
    (tmp_path / "b.json").write_text('{"text": "1 A\\nb"}\n')
    ids = [sorted(r.doc_id for r in io.read_requests(spark, str(tmp_path)).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 4


def test_chosen_output_names(spark):
    rows = spark.createDataFrame([("a.txt", None), ("a.txt", "b.json")], "n string, o string").select(io.output_name(F.col("n"), F.col("o")).alias("o")).collect()
    assert [r.o for r in rows] == ["a_output.json", "b.json"]


def test_one_shuffle_and_no_python(spark, sf_dir):
    found = parse_documents(policies(spark, sf_dir))
    plan = found._jdf.queryExecution().sparkPlan().toString(), found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan[1])) == 1
    assert not re.search("Python|ArrowEval|Pandas", plan[1])


def test_stream_equals_batch_and_can_run_again(spark, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.createDataFrame([(0, "a.txt", SAMPLE), (1, "b.txt", " "), (2, "c.txt", "1 A\nb")], "doc_id long, file_name string, text string")
    docs.write.parquet(source)
    stream = spark.readStream.schema(docs.schema).parquet(source)
    for k in range(2):
        segment_stream(stream, str(tmp_path / "out"), str(tmp_path / f"state{k}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/segments")).drop("batch")
    want = parse_documents(docs.where("doc_id <> 1"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()] == [1]


def test_extra_columns_and_equal_names(spark):
    docs = spark.createDataFrame([(0, "same", "1 A\nb", 5), (1, "same", "1 C\nd", 6), (2, None, None, 7)], "doc_id long, file_name string, text string, line_no int")
    assert [(r.doc_id, r.text) for r in parse_documents(docs).orderBy("doc_id").collect()] == [(0, "b"), (1, "d")]
    assert parse_documents(docs.limit(0)).collect() == []


@pytest.mark.parametrize("path", ["sf0.001"])
def test_entry(spark, path):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_white_space_is_the_same_as_characters_and_as_a_class(spark):
    rows = spark.range(0xD800).union(spark.range(0xE000, 0x10000)).select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"), "id")
    found = rows.select("id", F.col("c").rlike(f"[{WS}]").alias("in_class"), (strip("c") == "").alias("stripped")).where("in_class or stripped").collect()
    assert "".join(chr(r.id) for r in found) == BLANKS and all(r.in_class and r.stripped for r in found)


def test_words_are_counted_inside_a_row(spark):
    """No word of a segment becomes a row of its own, and keywords are those of a plain count."""
    texts = ["a", "", "bbb ccc bbb ddd ccc eee", " ".join(f"w{chr(97 + k % 23) * (k % 5)}x" for k in range(900)), "Don't can't x'd've 'quoted' abc'.'' fig. etc."]
    segments = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "doc_id long, seg_no int, text string")
    got = with_keywords(segments, 3)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    for r in got.select("keywords", key_words("text").alias("w")).collect():
        assert r.keywords == sorted(dict.fromkeys(r.w), key=lambda w: (-r.w.count(w), r.w.index(w)))[:3]


def test_key_words_by_one_pattern(spark):
    """As all tokens cut first, and those of letters kept, give."""
    parts = ["etc.", "Prof.", "'etc.", "etc.'", "etc..", "Mrs", "abc", "ab", "a-b", "x--yzz", "isn't", "‘Haus’", "don’t", "cannot", "Straße.'", "no.'.'", "7up", "ÉTÉ,", "\U0001d400bcd", "a bcd", "(inc.)", "ΟΔΟΣ", "\n", "...", "''"]
    texts = ["", *parts, *(f"{a}{gap}{b}{end}" for a in parts for b in parts for gap in (" ", "", " \t") for end in ("", " ", "."))]
    rows = spark.createDataFrame([(t, e) for t in texts for e in (True, False)], "text string, last boolean")

    def plainly(ends):
        letters = F.filter(word_tokens("text", ends=ends), lambda t: t.rlike(r"^\p{L}{3,}\z"))
        return F.filter(F.transform(letters, lambda t: F.lower(t)), lambda t: ~t.isin(*STOP_WORDS))

    for ends in (None, F.col("last")):
        assert rows.where(~key_words("text", ends=ends).eqNullSafe(plainly(ends))).count() == 0
    assert spark.range(1).select(letter_words(marks_apart(F.lit("the etc. and Inc.")), ("etc", "inc"), True)).first()[0] == ["the", "and", "Inc"]
