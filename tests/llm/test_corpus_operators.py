"""Mixing, SimHash, nearest neighbours, passages, repeated strings and the pipeline, against brute force."""

import base64
import hashlib
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from clauseloom.llm import components, forest, mixing, near_copies, passages, queries, simhash, substrings, suffixes
from clauseloom.llm.common import written
from tests.conftest import DATA


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, None if i % 9 == 4 else "w " * (i % 7) * 3 + f"x{i}", None, None if i % 5 == 0 else f"s{i % 3}", 1) for i in range(60)]
    rows += [rows[1], rows[1], (1, "another text", "en", "s1", None), (None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5)]
    return docs_frame(spark, rows)


def water_level(sizes, weights):
    total, open_, target = sum(sizes), set(range(len(sizes))), {}
    while True:
        left = total - sum(target.values())
        level = left / sum(weights[i] for i in open_) if open_ else 0
        over = [i for i in open_ if level * weights[i] >= 3 * sizes[i]]
        if not over:
            return [target.get(i, level * weights[i]) for i in range(len(sizes))]
        for i in over:
            target[i] = 3 * sizes[i]
            open_.discard(i)


def test_mix(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = queries.op3_mix_sources(spark, sf_dir).join(docs.select("doc_id", "source", "text"), "doc_id").toPandas()
    sizes = rows.groupby("source")["size"].sum().sort_index()
    wanted = water_level(sizes.tolist(), [1 + i % 3 for i in range(len(sizes))])
    found = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first")).sort_index()
    assert len(rows) == docs.count() and np.allclose(found.target, wanted) and (found["size"] == sizes).all()
    assert (abs(found.taken - found.target) <= 1).all() and (rows.taken <= 3 * rows["size"]).all()
    assert (rows["size"] == [len(t.encode().split()) for t in rows.text]).all()
    again = queries.op3_mix_sources(spark, sf_dir).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == rows.sort_values("doc_id").taken.tolist()


def test_mix_spreads_sources_evenly(spark, sf_dir):
    mix = mixing.schedule(queries.table(spark, sf_dir, "documents"), block_words=64).where("slot is not null").select("slot", "source").distinct().toPandas()
    half = mix[mix.slot < mix.slot.max() / 2].source.value_counts()
    assert (abs(half - mix.source.value_counts() / 2) <= 4).all()
    assert mix.slot.is_unique


def brute_schedule(targets, n_blocks):
    """Source and block by slot, one point after the other."""
    out, used, total = [], [0] * len(targets), sum(targets)
    phi = Fraction(math.isqrt(5 * 10**60) - 10**30, 2 * 10**30)
    for i in range(sum(n_blocks)):
        point, k = ((i + 1) * phi) % 1 * Fraction(total), 0
        while k < len(targets) - 1 and (targets[k] == 0 or point >= sum(map(Fraction, targets[: k + 1]))):
            k += 1
        if used[k] < n_blocks[k]:
            out.append((i, k, used[k]))
        used[k] += 1
    late = sorted((b, k) for k in range(len(targets)) for b in range(used[k], n_blocks[k]))
    return out + [(sum(n_blocks) + j, k, b) for j, (b, k) in enumerate(late)]


def test_schedule_equals_point_by_point(spark):
    targets = [1500.5, 3.25, 40_000.0, 0.0, 9000.0, 777.0]
    n_blocks = [math.ceil(round(t) / 16) for t in targets]
    mixed = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(targets, n_blocks, strict=True))], "src int, target double, n_blocks long")
    got = mixing.slots(mixed, sum(n_blocks), cells=64, chunk_bits=7).orderBy("slot").collect()
    assert [tuple(r) for r in got] == brute_schedule(targets, n_blocks)


def test_schedule_decides_what_is_taken(spark, sf_dir, monkeypatch):
    docs = queries.table(spark, sf_dir, "documents")
    mix = mixing.schedule(docs, block_words=256).where("n_words > 0")
    assert mix.where("slot is null").count() == 0
    blocks = mix.groupBy("source", "block").agg(F.sum("n_words").alias("n"), F.countDistinct("slot").alias("slots"), F.first("target").alias("target")).toPandas()
    assert (blocks.slots == 1).all()
    for _, own in blocks.sort_values("block").groupby("source"):
        assert own.block.tolist() == list(range(len(own))) and (own.n[:-1] == 256).all() and own.n.sum() == round(own.target.iloc[0])
    whole = mixing.slots
    monkeypatch.setattr(mixing, "slots", lambda mixed, n, **o: whole(mixed, n, **o).where("block < 2"))
    less = mixing.taken(mixing.schedule(docs, block_words=256)).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
    assert all(r.n == min(512, round(r.target)) for r in less) and any(r.target > 600 for r in less)


def test_mixed_documents_come_in_slot_order(spark, sf_dir, odd):
    docs = queries.table(spark, sf_dir, "documents")
    rows = mixing.mixed_documents(docs, name="at", block_words=64).collect()
    assert [r["at"] for r in rows] == sorted(r["at"] for r in rows)
    mix = mixing.schedule(docs, keep=("doc_id", "text"), block_words=64).where("n_words > 0").toPandas()
    assert len(rows) == len(mix.groupby(["doc_id", "epoch"]))
    same = spark.createDataFrame([(1, "a b c", "s", 1, "x"), (1, "a b c", "s", 2, "y"), (1, "a b c", "t", 3, "z")], "doc_id long, text string, source string, slot int, cut string")
    assert {r.slot for r in mixing.mixed_documents(same).collect()} <= {1, 2, 3}
    assert sum(len(r.text.split()) for r in mixing.mixed_documents(same).collect()) == 9


def test_mix_pieces_cover_what_is_taken(spark, odd):
    mix = mixing.schedule(odd, block_words=4)
    rows = mix.toPandas()
    assert mix.select("row_id").distinct().count() == odd.count()
    for _, own in rows[rows.n_words > 0].groupby(["row_id", "epoch"]):
        spans = sorted(zip(own.from_word, own.from_word + own.n_words, strict=True))
        assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans)) and spans[-1][1] <= own["size"].iloc[0]
    assert mixing.schedule(odd.limit(0)).count() == 0 and mixing.mixed_documents(odd).columns == odd.columns
    total = mixing.mixed_documents(odd.dropDuplicates(["doc_id", "text"])).select(F.sum(mixing.words())).first()[0]
    assert total == mixing.taken(mixing.schedule(odd.dropDuplicates(["doc_id", "text"]))).select(F.sum("taken")).first()[0]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    all_ = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in all_]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints, names):
    out, u = {}, np.array(prints, np.uint64)
    left = set(range(len(u)))
    while left:
        todo = [left.pop()]
        own = list(todo)
        while todo:
            x = todo.pop()
            near = [y for y in left if int(u[x] ^ u[y]).bit_count() <= 4]
            left -= set(near)
            todo += near
            own += near
        named = [names[i] for i in own if names[i] is not None]
        out |= {i: min(named, default=None) for i in own}
    return [out[i] for i in range(len(u))]


def brute_near_copies(docs):
    """({doc: the least of its group}, pairs of documents with different words): groups by 0.8 of the five-word shingles; no words are one group."""
    words, first = {i: tuple((t or "").encode().lower().split()) for i, t in docs}, {}
    for i in sorted(words):
        first.setdefault(words[i], i)
    shingles = {i: {w[k : k + 5] for k in range(len(w) - 4)} for w, i in first.items()}
    holding, pairs, root = {}, set(), {i: i for i in shingles}
    for i, own in shingles.items():
        for s in own:
            holding.setdefault(s, []).append(i)
    for a, b in {(a, b) for ids in holding.values() for a, b in itertools.combinations(ids, 2)}:
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
            pairs.add((a, b))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(first[w]) for i, w in words.items()}, pairs


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_near_copies_of_the_tables(spark, folder):
    """Of pairs of different texts at 0.8 or more at least 0.95 are found, and nothing else is dropped."""
    docs = queries.table(spark, f"{DATA}/{folder}", "documents")
    groups, pairs = brute_near_copies(docs.select("doc_id", "text").collect())
    kept = {r.doc_id for r in near_copies.without_copies(docs).select("doc_id").collect()}
    assert kept >= set(groups.values()) and sum(a in kept and b in kept for a, b in pairs) <= 0.05 * len(pairs) and pairs


@pytest.mark.parametrize("small", [simhash.SMALL, 3])
def test_near_copies_in_large_groups(spark, monkeypatch, small):
    """Groups of copies of a base, each with words of its own replaced; whole repeats, texts of few words, extra columns, ties."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for n_words, copies in ((120, 60), (300, 25), (90, 3)):
        base = [word() for _ in range(n_words)]
        texts.append(" ".join(base))
        for _ in range(copies):
            own = list(base)
            for at in rng.sample(range(n_words), max(1, n_words // 120)):
                own[at] = word()
            texts.append(" ".join(own))
    texts += [texts[0].upper(), texts[0].replace(" ", "\n "), "few words", "few  WORDS", "few word", "", None, " ", " ".join(word() for _ in range(40_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "another text of the same id"), (None, "without an id"), (None, texts[5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_key": F.lit(1), "said": F.lit("x"), "group": F.lit("g"), "fingerprint": F.lit(0), "row": F.lit("r")})
    kept = near_copies.without_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r.doc_id), (r.text or "")[:20]) for r in kept.collect()) == sorted([("0", texts[0][:20]), ("61", texts[61][:20]), ("87", texts[87][:20]), ("93", "few words"), ("95", "few word"), ("96", ""), ("99", texts[99][:20]), ("3", "another text of the s"[:20]), ("None", "without an id")])
    assert near_copies.without_copies(frame.limit(0)).count() == 0


def test_simhash_query(spark, sf_dir):
    texts = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    prints = [brute_fingerprint(t) for _, t in texts]
    wanted = {(i, f"{p:016x}", c) for (i, _), p, c in zip(texts, prints, brute_components(prints, [i for i, _ in texts]), strict=True)}
    assert {tuple(r) for r in queries.op5_simhash_components(spark, sf_dir).collect()} == wanted


@pytest.mark.parametrize("forced", [None, (2, 1), (1, 0, 1), (0, 0, 1, 0), (-1, 2, 1)])
def test_simhash_links_under_any_thresholds(spark, monkeypatch, forced):
    rng = np.random.default_rng(0)
    prints = set()
    for x in rng.integers(-(2**63), 2**63 - 1, 12):
        for _ in range(60):
            y = np.uint64(np.int64(x))
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                y ^= np.uint64(1 << int(b))
            prints.add(int(y.view(np.int64)))
    prints = sorted(prints)
    frame = spark.createDataFrame(pd.DataFrame({"fingerprint": prints}))
    if forced:
        monkeypatch.setattr(simhash, "plan", lambda n, t, d: [(p, k) for p, k in zip(simhash.grouped_bits(n, t, len(forced)), forced, strict=True) if k >= 0])
    roots = dict(components.components(simhash.links(frame)).collect())
    wanted = brute_components([p % (1 << 64) for p in prints], prints)
    assert [roots.get(p, p) for p in prints] == wanted


def test_simhash_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    prints = [brute_fingerprint(t) for _, t in texts]
    wanted = sorted((str(i), p, str(c)) for (i, _), p, c in zip(texts, prints, brute_components(prints, [i for i, _ in texts]), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint % (1 << 64), str(r.component_id)) for r in rows) == wanted
    kept = simhash.without_copies(odd)
    assert kept.count() == len({brute for brute in brute_components(prints, [i if i is not None else 10**9 for i, _ in texts])}) and kept.columns == odd.columns
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 2000 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_forest_recall_and_order(spark):
    vectors = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    rows = queries.op6_hash_forest(spark, f"{DATA}/sf0.1").toPandas()
    ids, x = zip(*vectors.select("vec_id", "embedding").collect(), strict=True)
    ids, x = np.array(ids), np.array(x, float)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        scores = (x * x[ids == q][0]).sum(1)
        own = rows[rows.query_id == q].sort_values("rank")
        order = np.lexsort((ids, -scores))
        best = ids[[i for i in order if ids[i] != q][:20]]
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 20
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, [scores[ids == v][0] for v in own.vec_id], atol=1e-12)
        assert sorted(zip(-own.score, own.vec_id, strict=True)) == list(zip(-own.score, own.vec_id, strict=True))
    assert hits / total >= 0.9


def test_forest_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (1, [1.0, None]), (2, [float("nan"), 1.0]), (3, [2.0, 1.0]), (4, [2.0, -1.0]), (5, [1.0]), (6, [float("inf"), 1.0]), (0, [1.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<float>, score double, rank int")
    found = forest.nearest(frame, F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 3, 2.0), (0, 2, 4, 2.0)]
    assert forest.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(2)
    for _ in range(60):
        h = rng.integers(0, 12, rng.integers(0, 40)).astype(np.uint64)
        least = int(rng.integers(1, 8))
        wanted = {}
        for i, j in ((i, j) for i in range(len(h)) for j in range(i + least, len(h) + 1)):
            c = i + int(h[i:j].argmin())
            low, high = wanted.get(c, (i, j - 1))
            wanted[c] = (min(low, i), max(high, j - 1))
        assert passages.compact_windows(h, least) == sorted((c, *ends) for c, ends in wanted.items())


def test_passages_query(spark):
    folder = f"{DATA}/sf0.01"
    texts = dict(queries.table(spark, folder, "documents").select("doc_id", "text").collect())
    own, places, pairs = {i: passages.shingles(t) for i, t in texts.items()}, {}, {}
    for i, s in own.items():
        for x in set(s.tolist()):
            places.setdefault(x, []).append(i)
    for at in places.values():
        for p in itertools.combinations(at, 2):
            pairs[p] = pairs.get(p, 0) + 1
    flagged = {x for (a, b), n in pairs.items() if n >= 30 and passages.covered(own[a], own[b]) and passages.covered(own[b], own[a]) for x in (a, b)}
    rows = {r.doc_id: r for r in queries.op7_near_passages(spark, folder).collect()}
    assert set(rows) <= flagged and len(rows) >= 0.99 * len(flagged)
    # pairs, by words instead of the operator's shingles
    said = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    grams = {i: np.array([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)], np.int64) for i, w in said.items()}
    true = [(a, b) for (a, b), n in pairs.items() if n >= 30 and passages.covered(grams[a], grams[b]) and passages.covered(grams[b], grams[a])]
    joined = [a in rows and b in rows and rows[a].class_id == rows[b].class_id for a, b in true]
    assert len(true) > 100 and sum(joined) >= 0.95 * len(true)
    assert all(p.stop - p.start >= 50 for r in rows.values() for p in r.passages)


def test_passages_planted(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(60)]
    edited = passage[:30] + ["changed"] + passage[31:]
    fill = lambda n: [word() for _ in range(n)]
    texts = {0: fill(80) + passage + fill(40), 1: fill(10) + passage + fill(200), 2: fill(300), 3: fill(20) + edited + fill(20), 4: fill(70) + passage[:40] + fill(70), 5: [], 6: fill(3)}
    frame = spark.createDataFrame([(i, " ".join(t), 1) for i, t in texts.items()] + [(7, None, 1), (None, " ".join(texts[0]), 1)], "doc_id long, text string, start int")
    rows = {r.doc_id: (r.class_id, [(p.start, p.stop) for p in r.passages]) for r in passages.repeated_passages(frame).collect()}
    assert rows == {0: (0, [(80, 140)]), 1: (0, [(10, 70)]), 3: (0, [(20, 80)])}
    assert passages.repeated_passages(frame.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(3000):
        s = bytes(rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 40)))
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows, length=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            if data[s : s + length] in seen:
                gone[s : s + length] = True
            seen.add(data[s : s + length])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((str(i), len(data), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_repeats_query(spark, sf_dir):
    rows = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, sf_dir).collect())
    assert got == brute_repeats([tuple(r) for r in rows])


@pytest.mark.parametrize(("many", "gathered"), [(20_000, 400_000), (3, 400_000), (3, 150), (20_000, 150)])
def test_repeats_odd_rows(spark, monkeypatch, many, gathered):
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "GATHERED", gathered)
    rng = random.Random(5)
    stock = ["".join(rng.choice("abcd é") for _ in range(rng.randint(90, 300))) for _ in range(6)]
    rows = []
    for i in range(120):
        text = ""
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(stock)
            text += p[rng.randint(0, 30) : len(p) - rng.randint(0, 60)] if rng.random() < 0.7 else "".join(rng.choice("xyz") for _ in range(rng.randint(0, 50)))
        if rng.random() < 0.15:
            text = rng.choice(["a", "ab"]) * rng.randint(50, 400)
        rows.append((None if i % 37 == 5 else rng.randint(0, 90), None if i % 50 == 7 else text))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, doc string")
    found = substrings.without_repeats(frame).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans) n_spans", "sha2(kept, 256) kept").collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found) == brute_repeats(rows)
    assert substrings.without_repeats(frame.limit(0)).count() == 0


def test_repeats_of_very_many_rows_without_id(spark):
    """One text in 300,000 rows that have no id: all but the first row lose it."""
    said = "The same hundred and twenty bytes of text stand in every row here, and none of these rows has got an id to go by at all."
    rows = spark.range(300_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(said).alias("text"))
    found = substrings.without_repeats(rows).groupBy("n_bytes", "n_removed").count().collect()
    assert sorted((r.n_bytes, r.n_removed, r["count"]) for r in found) == [(len(said), 0, 1), (len(said), len(said), 299_999)]


def test_one_core_in_very_many_contexts(spark, monkeypatch):
    """85 bytes that all documents share, in surroundings of their own: nothing is removed but true repeats."""
    monkeypatch.setattr(substrings, "MANY", 500)
    core = "".join(random.Random(3).choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(85))
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.substring(F.md5((F.col("id") % 19_990).cast("string")), 1, 20), F.lit(core), F.substring(F.md5((F.col("id") % 19_990 + 10**6).cast("string")), 1, 20)).alias("text"))
    found = substrings.without_repeats(rows).where("n_removed > 0").collect()
    assert {(r.doc_id, r.n_removed) for r in found} == {(19_990 + i, 125) for i in range(10)}


def test_pipeline_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    labels = dict(queries.table(spark, sf_dir, "labels").select("doc_id", "toxic").collect())
    names, now = [n for n, _ in corpus_pipeline.STAGES], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now.toPandas(), stage(spark, now, sf_dir)
        assert now.dtypes == docs.dtypes
        after = now.toPandas()
        now = spark.createDataFrame(after, docs.schema)
        if name == "toxicity":
            gone = set(before.doc_id) - set(after.doc_id)
            assert all(labels.get(i, 1) for i in gone)
        elif name == "simhash_dedup":
            groups, pairs = brute_near_copies(list(zip(before.doc_id, before.text, strict=True)))
            kept = set(after.doc_id)
            # nothing goes but for a near copy that stays, and of near copies one stays
            assert kept >= set(groups.values()) and all(groups[i] in kept for i in before.doc_id)
            assert sum(a in kept and b in kept for a, b in pairs) <= 0.05 * len(pairs)
        elif name == "suffix_dedup":
            assert sorted(after.doc_id) == sorted(before.doc_id)
            wanted = {int(i): gone for i, _, gone, _, _ in brute_repeats(list(zip(before.doc_id, before.text, strict=True)))}
            left = dict(zip(after.doc_id, after.text, strict=True))
            # a character that loses a byte goes as a whole
            assert all(len(left[i].encode()) <= len(t.encode()) - wanted[i] and (wanted[i] or left[i] == t) for i, t in zip(before.doc_id, before.text, strict=True))
            assert sum(len(t.encode()) for t in before.text) - sum(wanted.values()) - sum(len(t.encode()) for t in after.text) <= 8 * len(before)
        elif name == "mix_sources":
            sizes, taken = (d.text.map(lambda t: len(t.encode().split())).groupby(d.source).sum().sort_index() for d in (before, after))
            assert np.allclose(taken.reindex(sizes.index, fill_value=0), water_level(sizes.tolist(), [1 + i % 3 for i in range(len(sizes))]), atol=1)
    assert names == ["toxicity", "simhash_dedup", "suffix_dedup", "mix_sources", "byte_bpe"]
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = sorted((i, s, len(ids), ids) for i, s, ids in zip(after.doc_id, after.source, map(encoding.encode_ordinary, after.text), strict=True))
    assert sorted(map(tuple, last.collect())) == wanted


def test_pipeline_odd_rows(spark, odd, sf_dir):
    now, rows = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
        now = written(stage(spark, now, sf_dir))
        rows[name] = now.collect()
    assert len(rows["toxicity"]) == odd.count()
    kept = {}  # rows of one id may have different texts
    for r in odd.collect():
        kept.setdefault((r.text or "").lower().strip() or "", []).append(r.doc_id)
    assert sorted(map(str, (r.doc_id for r in rows["simhash_dedup"]))) == sorted(str(min((i for i in own if i is not None), default=None)) for own in kept.values())
    assert sorted(map(str, (r.doc_id for r in rows["suffix_dedup"]))) == sorted(map(str, (r.doc_id for r in rows["simhash_dedup"])))
    sizes, taken = {}, {}
    for r in rows["suffix_dedup"]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in rows["mix_sources"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = dict(zip(order, water_level([sizes[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
    assert all(abs(taken.get(s, 0) - wanted[s]) <= 1 for s in order)
    assert [r.n_tokens for r in rows["byte_bpe"]] == [len(r.ids) for r in rows["byte_bpe"]] and len(rows["byte_bpe"]) == len(rows["mix_sources"])


def test_passages_of_one_function_are_linked(spark, monkeypatch):
    """Groups of edited copies whose windows differ beside their min-hash: one link is enough, in any order."""
    monkeypatch.setattr(passages, "FUNCTIONS", 1)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = [[word() for _ in range(rng.randint(0, 30))] + passage + [word() for _ in range(rng.randint(0, 30))] for _ in range(40)]
    texts += [[word() for _ in range(80)] for _ in range(5)]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in passages.repeated_passages(frame).collect()} == {(i, 0) for i in range(40)}


def test_large_buckets_are_split_without_losing_links(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 200)
    rng = np.random.default_rng(11)
    for distance in (4, 8):
        chains = [rng.integers(0, 1 << 63, 400, dtype=np.uint64)]
        for _ in range(3):
            flips = np.uint64(1) << rng.integers(0, 64, (3, 400)).astype(np.uint64)
            chains.append(chains[-1] ^ np.bitwise_or.reduce(flips))
        prints = rng.permutation(np.unique(np.concatenate(chains)))
        probing = np.arange(len(prints)) >= len(prints) * 3 // 4
        got = joined_up(prints, [(a, b) for x, y in simhash.bucket_links(np.zeros(len(prints), np.int64), prints.view(np.int64), probing, distance) for a, b in zip(x.view(np.uint64).tolist(), y.view(np.uint64).tolist(), strict=True)])
        pairs = [(prints[i], prints[j]) for i in np.flatnonzero(~probing) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance)]
        assert got == joined_up(prints, pairs) and len(set(got.values())) < 500


def joined_up(nodes, pairs):
    root = {int(x): int(x) for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(int(a)), top(int(b))))
        root[b] = a
    return {x: top(x) for x in root}


def test_mix_of_one_id(spark):
    rows = [(None, "a b c", "s", 1)] * 9000 + [(None, "a b", "s", 2)] * 50 + [(None, "x", "t", 3)] * 5 + [(4, "", "s", 4)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_equal int")
    found = mixing.taken(mixing.schedule(docs, block_words=64)).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("taken").alias("most"), F.first("target").alias("target")).collect()
    assert {(r.doc_id, r.source, r["size"]): r.n for r in found} == {(None, "s", 3): 9000, (None, "s", 2): 50, (None, "t", 1): 5, (4, "s", 0): 2}
    for source in "st":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.most <= 3 * r["size"] for r in own)
    dealt = mixing.told_apart(spark.createDataFrame([("a", 10_000), ("b", 1)], "k string, n long"), "n", at_once=64)
    assert [tuple(r) for r in dealt.groupBy("k").agg(F.count(F.lit(1)), F.countDistinct("copy"), F.max("copy")).orderBy("k").collect()] == [("a", 10_000, 10_000, 9999), ("b", 1, 1, 0)]


def test_near_copies_in_one_large_bucket_are_all_found(spark):
    """Texts of the same words in other orders have one fingerprint; each has one near copy, which no forest need link it to."""
    rng, texts = random.Random(3), []
    for _ in range(20):
        words = [f"word{k}" for k in range(60)]
        rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words, words[0]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.without_copies(docs).collect()) == list(range(0, 40, 2))
    # and over several fingerprints within the distance: brute force over all links
    texts = []
    for k in range(30):
        words = [f"term{j}" for j in range(80)]
        rng.shuffle(words)
        texts += [" ".join([*words, f"own{k}"]), " ".join([*words, f"other{k}"])]
    rows, _ = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    groups = {r.doc_id: r.group for r in rows.collect()}
    prints = [near_copies.word_print(t.encode().split()) for t in texts]
    assert all((groups[i] == groups[i + 1]) == (((prints[i] ^ prints[i + 1]) & (1 << 64) - 1).bit_count() <= 8) for i in range(0, 60, 2))
    assert len(set(groups.values())) >= 30


def test_near_copies_of_many_texts_of_the_same_words(spark, monkeypatch):
    """Texts of one fingerprint aren't all compared: what is joined and verified grows with the texts, not with their pairs."""
    rng, texts = random.Random(5), []
    for _ in range(100):
        words = [f"word{k}" for k in range(60)]
        rng.shuffle(words)
        texts += [" ".join(words), " ".join([*words, words[0]])]
    verified, seen = near_copies.verified, []

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_copies, "verified", counted)
    rows, _ = near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    groups = {r.doc_id: r.group for r in rows.collect()}
    assert len(set(groups.values())) == 100 and all(groups[i] == groups[i + 1] for i in range(0, 200, 2))
    assert sum(seen) <= 4 * len(texts)


def test_counts_leave_out_no_similar_text():
    """Brute force: what :class:`near_copies.Bucket` tells to be dissimilar has a Jaccard similarity below 0.8."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(400)[: 400 - k]], rng.integers(0, 1 << 63, k * m, dtype=np.uint64)])) for k in range(0, 120, 4) for m in (0, 1)]
    rows = pa.table({"key": [0] * len(sets), "probing": [False] * len(sets), "said": list(map(str, range(len(sets)))), "fingerprint": pa.array([0] * len(sets), pa.int64()), "label": range(len(sets)), "n": list(map(len, sets)), "counts": list(map(near_copies.class_counts, sets))})
    alike = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (s := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - s)}
    for small in (3, 1000):
        found = [(int(a), int(b)) for i, j in near_copies.Bucket(rows, 8, 0.8).links(False, small) for a, b in zip(i, j, strict=True)]
        assert alike and alike <= set(found) and len(found) == len(set(found)) < len(sets) * (len(sets) - 1) / 2


@pytest.mark.parametrize("block", [4096, 3])
def test_passages_between_windows_of_other_passages(spark, monkeypatch, block):
    """Families that share a line of 40 words with others: each window has windows of other families on both sides, in both orders."""
    monkeypatch.setattr(passages, "FUNCTIONS", 1)
    monkeypatch.setattr(passages, "BLOCK", block)
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]
    texts, wanted = {}, {}
    for _ in range(6):
        line = words(40)
        while not (14 <= (h := passages.hashed(passages.shingles(" ".join(line)), 0)).argmin() < 22 and h.min() < 2**64 // 400):
            line = words(40)
        ids = [len(texts) + k for k in range(9)]
        own = {f: (words(8), words(8)) for f in range(3)}
        for i in ids:
            before, behind = own[i % 3]
            fill = words(rng.randint(60, 90))
            texts[i] = fill + before + line + behind + words(rng.randint(60, 90))
            wanted[i] = (ids[i % 3 - ids[0] % 3], [(len(fill), len(fill) + 56)])
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, [(p.start, p.stop) for p in r.passages]) for r in passages.repeated_passages(frame).collect()} == wanted


def test_compared_windows_add_what_all_pairs_add():
    rng = random.Random(11)
    draw = lambda n: [rng.randrange(1 << 32) for _ in range(n)]
    for _ in range(30):
        shared = [draw(80) for _ in range(3)]
        own, doc = [], []
        for _ in range(rng.randint(2, 40)):
            x = list(rng.choice(shared))
            for k in rng.sample(range(80), rng.randint(0, 12)):
                x[k] = rng.randrange(1 << 32)
            low, high = rng.randint(0, 30), rng.randint(50, 80)
            own.append(np.array(draw(rng.randint(0, 60)) + x[low:high] + rng.choice([[], shared[0][:20]]) + draw(rng.randint(0, 60)), np.uint32))
            doc.append(rng.randrange(15))
        for side in (np.zeros(len(own), int), np.arange(len(own)) % 2):
            marked, edges = [[set() for _ in own] for _ in range(2)], [set(), set()]
            for i, j in itertools.combinations(range(len(own)), 2):
                if doc[i] != doc[j] and (side.max() == 0 or side[i] != side[j]) and (mine := passages.covered(own[i], own[j])) and (theirs := passages.covered(own[j], own[i])):
                    for x, spans in ((i, mine), (j, theirs)):
                        marked[0][x] |= {k for span in spans for k in range(*span)}
                    edges[0].add((doc[i], doc[j]))
            for i, j, mine, theirs in passages.compared(own, np.array(doc), side):
                for x, spans in ((i, mine), (j, theirs)):
                    marked[1][x] |= {k for span in spans for k in range(*span)}
                edges[1].add((doc[i], doc[j]))
            assert marked[0] == marked[1]
            roots = []
            for found in edges:
                root = {d: d for d in doc}
                for _ in root:
                    for a, b in found:
                        root[a] = root[b] = min(root[a], root[b])
                roots.append(root)
            assert roots[0] == roots[1]


def test_equal_windows_meet_another_document():
    rng = random.Random(12)
    for _ in range(300):
        rows = sorted((rng.randrange(4), rng.randrange(3), rng.randrange(4)) for _ in range(rng.randint(0, 40)))  # key, body, document
        key, body, doc = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        partner, stands = passages.equals(key, doc, body)
        groups = {}
        for i, (k, b, d) in enumerate(rows):
            groups.setdefault((k, b), []).append((i, d))
        for members in groups.values():
            docs = sorted({d for _, d in members})
            for i, d in members:
                p = int(partner[i])
                assert (p < 0) == (len(docs) == 1)
                assert p < 0 or (rows[p][:2] == rows[i][:2] and rows[p][2] != d)
            standing = [d for i, d in members if stands[i]]
            assert len(standing) == len(members) if len(docs) == 1 else standing == docs[:2]
            # what is linked is connected
            root = {d: d for d in docs}
            for _ in docs:
                for i, d in members:
                    if partner[i] >= 0:
                        root[d] = root[rows[partner[i]][2]] = min(root[d], root[rows[partner[i]][2]])
            assert len(set(root.values())) == 1
