"""Prefix trie, spelling variants and token files, against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseloom.llm import queries, spelling, token_files, trie
from clauseloom.llm.common import shared_folder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def brute_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), role, tie, text))
    convs = {c: [(r, x) for _, r, _, x in sorted(turns)] for c, turns in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members, kids, leaves, saved, out = {}, {}, {}, {}, []
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    for node in sorted(members, key=len, reverse=True):
        if node:
            kids.setdefault(node[:-1], []).append(node)
        own = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in own) or 1
        saved[node] = sum(saved[k] for k in own) + ((len(members[node]) - 1) * len(node[-1][1].encode().split()) if node else 0)
        ends = ",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(own), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(turns):
    return sorted((tuple(r) for r in trie.prefix_trie(turns).collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_prefix_trie(spark, sf_dir).collect()), key=str) == brute_trie(rows)


@pytest.mark.parametrize("bits", [trie.CHUNK_BITS, 2])
def test_trie_of_odd_rows(spark, monkeypatch, bits):
    """Null and equal turns, roles and texts, repeated rows, absent and short families, turnless and long conversations, negative ids."""
    monkeypatch.setattr(trie, "CHUNK_BITS", bits)
    rows = [(i % 7 * 20 if i % 11 else -45, None if i % 5 == 0 else i % 13, ["user", "assistant", None][i % 3], ["a b", "", "x", None, "a b"][i % 5]) for i in range(300)]
    rows += [(c, t, "u", "the same words here") for c in range(60, 140) for t in range(30)]
    rows += [(None, 1, "u", "x"), (None, None, None, None)] + [(c, t, "u", f"t{t // 2}") for c in (401, 402, 421) for t in range(3)]
    rows += [(500, t, "u", "x" * (t % 2) + "y " * 50_000 * (t == 7)) for t in range(9)]
    turns = spark.createDataFrame(rows, TURNS).withColumns({"block": F.lit(1), "depth": F.lit("d"), "x1": F.lit(0)})
    assert trie_rows(turns) == brute_trie(rows)
    assert trie_rows(turns.limit(0)) == []
    assert trie_rows(turns.where("conv_id is null")) == []


def test_trie_of_one_hot_conversation_and_many_equal_ones(spark):
    """A third of all rows are one conversation, a third equal conversations: no chunk of either is large."""
    rows = [(1, t, "u", f"t {t}") for t in range(9_000)] + [(100 + c // 3, c % 3, "u", "said by all") for c in range(9_000)]
    assert trie_rows(spark.createDataFrame(rows, TURNS).repartition(4)) == brute_trie(rows)


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_groups(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and brute_near(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items())


def test_words_of_odd_texts(spark):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(["Straße straße ÀÉ×÷ñandú", None, "", "naïve Naïve NAÏVE don't łódźniks abćdefgh", "x" * 100_000 + " İstanbul", "wordwordword " * 5_000] * 20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w"))
    assert {r.word: r.n for r in spelling.corpus_words(frame, garble_every=97).collect()} == brute_words(rows)
    assert spelling.corpus_words(frame.limit(0)).count() == 0


def test_spelling_groups_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = brute_groups(brute_words(rows))
    assert sorted(tuple(r) for r in queries.op12_spelling_groups(spark, sf_dir).collect()) == want and any(r[1] for r in want)


@pytest.mark.parametrize(("cell", "leaf", "askers"), [(8, 2, 5), (20, 3, 2_000), (4096, 12, 2_000)])
def test_spelling_groups_of_near_words(spark, monkeypatch, cell, leaf, askers):
    """Few letters, so that words have many near ones; chains of forms; any script; cells and leaves of any size."""
    for name, value in (("CELL", cell), ("LEAF", leaf), ("ASKERS", askers), ("SAMPLE", 150)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(cell)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))): rng.choice([3, 4, 7, 20, 90, 500]) for letters in ("ab", "abcé", "ŝ漢a😀") for _ in range(150)}
    words |= {"a" * k: 3 * 2**k for k in range(1, 15)} | {"ba" * 200: 5, "ba" * 200 + "b": 11}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").withColumns({"length": F.lit(1), "near": F.lit("x")})
    found = spelling.spelling_groups(frame)
    assert sorted(tuple(r) for r in found.collect()) == brute_groups(words)
    assert spelling.spelling_groups(frame.limit(0)).count() == 0


def test_branches_reach_all_near_words():
    """From every split tree, no near word is lost, and no leaf is reached twice."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdef") for _ in range(6)) for _ in range(900)})
    vectors = spelling.counted(spelling.spelt(words))
    *tree, leaves = spelling.fitted(vectors, 6)
    any_edit = np.full(len(words), -1)
    asker, leaf, _, _ = spelling.reached(vectors, any_edit, any_edit, tuple(tree), 6)
    reached = set(zip(asker.tolist(), leaf.tolist(), strict=True))
    assert len(reached) == len(asker) < 20 * len(words)
    for i, w in enumerate(words):
        for j, v in enumerate(words):
            assert not brute_near(w, v) or (i, leaves[j]) in reached


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_packed_values_come_back(values, block):
    before, token_files.BLOCK = token_files.BLOCK, block
    try:
        array = np.array(values, np.uint64)
        content = token_files.packed(array)
        assert (token_files.unpacked(content) == array).all() and len(token_files.unpacked(content)) == len(array)
        for first in range(0, -(-len(array) // block)):
            part = token_files.unpacked(content, first, first + 1)
            assert part.tolist() == values[first * block : (first + 1) * block]
    finally:
        token_files.BLOCK = before


def brute_files(rows):
    tokenizer, out, start = Tokenizer.from_file(WORD_BPE), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = queries.op13_token_files(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(brute_files(rows))


ODD = ["<|endoftext|> a<|startoftext|>b", "<|ENDOFTEXT|>’<|EndOfText|>", "ΑΣ ΑΣ. Σ", "é ́x J̌ H̱", "a b c\x1cd\x85e", "İstanbul ŉ ß", "don't I'LL 'S !'s .\"' '' a'", "  ", "\n\t\x0b\x0c x"]
ODD += ["😀 👨‍👩‍👧 क्षि", "ﬁ Å Å", "1²½ a_b 12ab3", "«abc».", "abł łab ab,ł", "x" * 50_000, " ".join(["word", "Other,"] * 20_000), None, None, "same", "same"]


def test_token_files_of_odd_rows(spark):
    rows = [(None if i % 9 == 3 else i % 10, t) for i, t in enumerate(ODD * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(3), "turn": F.lit(3), "row": F.lit("r"), "no": F.lit(0)})
    got, want = token_files.through_files(docs, WORD_BPE).orderBy("start").collect(), brute_files(rows)
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert [r.doc_id for r in got] == [r[0] for r in want] and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    assert token_files.through_files(docs.limit(0), WORD_BPE).count() == 0


def test_documents_over_several_rows(spark):
    """A document of more ids than a row of a file holds, whose parts' checksums are put together."""
    rows = [(1, "one " * 300_000), (0, "zero"), (2, "two " * 10)]
    got = token_files.through_files(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), WORD_BPE).collect()
    assert sorted(map(tuple, got)) == brute_files(rows)
    folder = f"{shared_folder(spark)}/one-file"
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, WORD_BPE, end=7, parts=1)
    assert spark.read.parquet(folder).count() == 2
    ids = {r.doc_id: r.ids for r in token_files.read_tokens(spark, folder, digest=False).collect()}
    tokenizer = Tokenizer.from_file(WORD_BPE)
    assert ids == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 7] for i, t in rows}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aJHé ÀΣσ'st.,!\"<|>9½̱̌́«×\n\x1c"), max_size=25), max_size=4))
def test_pieces_have_the_ids_of_whole_texts(texts):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    found = token_files.encoder(WORD_BPE).encode([t.encode() for t in texts])
    assert [x.tolist() for x in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_few_remembered_pieces_are_enough(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 3)
    own, tokenizer = token_files.Encoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for texts in (["one two three four", "two five"], ["one six"], [], ["two two seven one nine ten"], ["one"]):
        assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_control_characters_go_with_the_marks_beside_them():
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = [f"{left}{chr(c)}{right}" for c in (*range(0x20), 0x7F) for left in ("", "<", "a", "9", "a.") for right in ("", "<", "a", "9", " b")]
    assert [x.tolist() for x in token_files.encoder(WORD_BPE).encode([t.encode() for t in texts])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé9.,!ß \n\x0b|"), max_size=25), max_size=4))
def test_plain_texts_are_cut_by_spaces(texts):
    """A run of letters, a digit or a run of marks is a piece, as the pattern that found them one by one gave."""
    pieces = re.compile(rb"[A-Za-z\x80-\xff]++|[!-/:-@\[-`{-~]++|[^\s]")
    texts = [t.encode() for t in texts]
    assert list(token_files.plain_pieces(texts))[: len(texts)] == [pieces.findall(t) for t in texts]
