"""One document of each group of near copies: SimHash finds the candidates, shared shingles decide.

Near copies have a Jaccard similarity of ``SIMILARITY`` or more on five-word shingles. A fingerprint of shingles that differ
in a fifth is 9 bits off on average and up to 14, too far to search for; one of the distinct words is 3 bits off, and within
``DISTANCE`` for nearly all. So fingerprints of distinct words are searched by the generalised pigeonhole principle
(:mod:`.simhash`), and each link is verified on the shingles of its texts. Which texts have a link at all comes first; these
carry counts of their shingles in ``CLASSES`` classes by hash. Texts differ in at least as many shingles as their counts differ
by, so most pairs that aren't similar are told by the counts alone, and no similar one is left out. What remains are spanning
forests of each large bucket; then all links between texts that are still in different groups are verified, so that none
is lost; neither copies nor groups are expanded into pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mapped, written
from .components import components
from .passages import Hasher
from .simhash import BITS, bit_counts, links, plan, probes

SIMILARITY, DISTANCE = 0.8, 8
AT_ONCE = 1 << 20
#: Classes that a text's shingles are counted in (a byte each, at most 255), and pairs that counts are compared of at once.
CLASSES, COMPARED = 256, 1 << 12
#: A bucket of no more rows gives all its links.
SMALL = 24


def word_print(words: list[bytes], seed: int = 42) -> int:
    """SimHash of the distinct words, as a signed 64-bit integer; 0 without words."""
    own = set(words)
    counts = np.zeros(BITS, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in own), np.uint64, len(own))
    for k in range(0, len(hashes), AT_ONCE):
        counts += np.unpackbits(hashes[k : k + AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own), bitorder="little").view("<i8")[0])


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, said, fingerprint) of each row: ``said`` is a digest of the lower-cased words in order."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text_key long, said string, fingerprint long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                words = [(t.as_py() or b"").lower().split() for t in part.column(2).cast(pa.binary())]
                said = [hashlib.blake2b(b" ".join(w), digest_size=16).hexdigest() for w in words]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(said), pa.array([word_print(w) for w in words], pa.int64())], schema.names)

    return mapped(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), run, schema)


def class_counts(shingles: np.ndarray) -> bytes:
    """How many of a text's distinct shingles are in each class."""
    return np.minimum(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % CLASSES, minlength=CLASSES), 255).astype(np.uint8).tobytes()


def shingled(texts: DataFrame) -> DataFrame:
    """(said, shingles, counts): the distinct five-word shingles' hashes of rows (said, text), and :func:`class_counts`; shorter texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for start in range(0, len(batch), 200):
                part = batch.slice(start, 200)
                found = [np.unique(h) for h in hasher(part.column(1).to_pylist())]
                ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(map(class_counts, found), pa.binary())], ["said", "shingles", "counts"])

    return mapped(texts.select("said", "text"), run, "said string, shingles array<long>, counts binary")


class Bucket:
    """Rows (key, probing, said, fingerprint, label, n, counts) of whole buckets; within one, those that don't probe come first."""

    def __init__(self, rows: pa.Table, max_distance: int, similarity: float) -> None:
        self.key, self.probing, prints, self.label, self.n = (rows.column(c).to_numpy() for c in ("key", "probing", "fingerprint", "label", "n"))
        self.prints = prints.view(np.uint64)
        self.counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).reshape(-1, CLASSES)
        self.max_distance, self.similarity = max_distance, similarity

    def close(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs may be similar: A and B, of whose union 1 - s is in one alone at most, differ in (1 - s) / (1 + s) of their sizes' sum."""
        most = (1 - self.similarity) * (self.n[i] + self.n[j]) + 1e-3
        out = (1 + self.similarity) * np.abs(self.n[i] - self.n[j]) <= most
        for k in range(0, len(i), COMPARED):
            at = slice(k, k + COMPARED)
            apart = np.abs(self.counts[i[at]].astype(np.int16) - self.counts[j[at]]).sum(1)
            out[at] &= (1 + self.similarity) * apart <= most[at]
        return out

    def links(self, forest: bool, small: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows of one bucket with different labels that may be similar; of a larger bucket, a forest that joins the same labels if asked for."""
        cuts = np.flatnonzero(np.diff(self.key)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(self.key)]])
        several = np.minimum.reduceat(self.label, starts) != np.maximum.reduceat(self.label, starts)
        sizes = stops - starts
        few = np.repeat(several & (sizes <= small), sizes)
        for lag in range(1, min(small, int(sizes.max()))):
            i = np.flatnonzero(few[:-lag] & (self.key[:-lag] == self.key[lag:]) & ~self.probing[:-lag] & (self.label[:-lag] != self.label[lag:]))
            i = i[np.bitwise_count(self.prints[i] ^ self.prints[i + lag]) <= self.max_distance]
            i = i[self.close(i, i + lag)]
            yield i, i + lag
        for start, stop in zip(starts[several & (sizes > small)].tolist(), stops[several & (sizes > small)].tolist(), strict=True):
            label = self.label[start:stop].copy()
            for i in range(start, start + int((~self.probing[start:stop]).sum())):
                own = label[i - start]
                j = np.flatnonzero((np.bitwise_count(self.prints[i + 1 : stop] ^ self.prints[i]) <= self.max_distance) & (label[i + 1 - start :] != own)) + i + 1
                j = j[self.close(np.full(len(j), i), j)] if len(j) else j
                if forest and len(j):
                    joined, first = np.unique(label[j - start], return_index=True)
                    j = j[first]
                    label[np.isin(label, joined)] = own
                if len(j):
                    yield np.full(len(j), i), j


def text_links(texts: DataFrame, max_distance: int, similarity: float, forest: bool) -> DataFrame:
    """(a, b), a < b, distinct: texts (said, fingerprint, label, n, counts) within ``max_distance`` that may be similar and whose labels differ.

    All of them; or, as a forest, some that join the same labels, where a bucket has more than ``SMALL`` rows.
    """
    n, together = bit_counts(texts)
    parts, small = plan(n, together, max_distance), SMALL
    columns = ["said", "fingerprint", "label", "n", "counts"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, at, asks in probes(batch.column(1).to_numpy(zero_copy_only=False), parts):
                rows = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(at), asks)), *rows.columns], ["key", "probing", *columns])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last bucket, which may go on

        def found(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts).combine_chunks()
            if len(rows):
                said = rows.column("said").combine_chunks()
                out, n_out = [], 0
                for pair in Bucket(rows, max_distance, similarity).links(forest, small):
                    out.append(pair)
                    n_out += len(pair[0])
                    if n_out > AT_ONCE >> 4:
                        yield taken(said, out)
                        out, n_out = [], 0
                if n_out:
                    yield taken(said, out)

        def taken(said: pa.Array, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([said.take(pa.array(np.concatenate(side))) for side in zip(*pairs, strict=True)], ["a", "b"])

        for batch in batches:
            if len(batch):
                keys = batch.column(0).to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))
                if held and (last or held[-1].column(0)[-1].as_py() != keys[0]):
                    yield from found([*held, batch.slice(0, last)])
                    held = []
                elif last:
                    yield from found([batch.slice(0, last)])
                held.append(batch.slice(last))
        if held:
            yield from found(held)

    dealt = mapped(texts.select(*columns), spread, "key long, probing boolean, said string, fingerprint long, label long, n int, counts binary")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "probing", "fingerprint")
    return mapped(dealt, meet, "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts share enough shingles."""
    of = lambda c: shingles.select(F.col("said").alias(c), F.col("shingles").alias(f"{c}_shingles"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    # texts of very different sizes can't be that similar
    n = [F.size(f"{c}_shingles") for c in "ab"]
    shared = F.size(F.array_intersect("a_shingles", "b_shingles"))
    close = F.least(*n) >= similarity * F.greatest(*n)
    return both.where((F.least(*n) > 0) & close).where(shared >= similarity * (n[0] + n[1] - shared)).select("a", "b")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, max_distance: int = DISTANCE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_key, said, group) for each row of ``docs``, verified links (a, b) between ``said``).

    Rows whose words are the same, in order, are of one group, and so are those of texts that verified links join. Null texts
    count as empty; all rows without words are one group.
    """
    rows = written(marked(docs))
    texts = cut(rows.groupBy("said", "fingerprint").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least")))
    prints = cut(texts.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_texts")))
    # texts with a neighbour: one of their fingerprint, or of one within the distance
    far = links(prints, max_distance)
    linked = far.select(F.col("a").alias("fingerprint")).union(far.select("b")).union(prints.where("n_texts > 1").select("fingerprint"))
    asked = texts.join(linked.distinct(), "fingerprint").select("said", "fingerprint", F.col("least.doc_id").alias("_id"), F.col("least.text_key").alias("_text"))
    asked = cut(asked)
    named = docs.select("doc_id", "text").withColumn("_key", F.xxhash64("text"))
    found = named.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")))
    shingles = written(shingled(found.dropDuplicates(["said"])))
    sized = written(shingles.select("said", F.size("shingles").alias("n"), "counts").where("n > 0").join(asked.select("said", "fingerprint"), "said"))
    pairs = written(text_links(sized.withColumn("label", F.xxhash64("said")), max_distance, similarity, forest=True))
    near = cut(verified(pairs, shingles, similarity))
    # forests leave out links, and those of them that fail may part a group: all links between what they left apart are looked at
    roots = cut(components(near))
    labelled = sized.join(roots, F.col("said") == F.col("node"), "left").withColumn("label", F.xxhash64(F.coalesce("root", "said")))
    apart = text_links(labelled, max_distance, similarity, forest=False)
    more = verified(apart.join(pairs, ["a", "b"], "left_anti"), shingles, similarity)
    near = cut(near.unionByName(more))
    roots = components(near)
    group = F.coalesce("root", "said").alias("group")
    return rows.join(roots, rows["said"] == roots["node"], "left").select("doc_id", "text_key", "said", group), near


def without_copies(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that stand for their group of :func:`near_copies`: that of the least doc_id (ties: any text of it, once).

    Rows without a doc_id stay only where their group has no other; null texts are in the group of those without words; repeated rows are
    there once; an empty table stays empty. Other columns stay as they are, whatever their names.
    """
    marks, _ = near_copies(docs, **options)
    best = marks.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("doc_id"), F.col("best.text_key").alias("text_key"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    stay = whole.join(best, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi")
    return stay.dropDuplicates(["id", "key"]).select("row.*")
