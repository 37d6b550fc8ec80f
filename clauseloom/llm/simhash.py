"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in ``max_distance`` bits or fewer. The bits are grouped into
partitions so that correlated bits share one, from co-occurrence counts over all distinct fingerprints.
If partition ``i`` has threshold ``t_i`` and the thresholds add up to ``max_distance - m + 1``, two linked
fingerprints are within ``t_i`` of each other in at least one partition. The number of partitions and
the thresholds (-1: the partition isn't used) come from a dynamic program over estimated numbers of
candidates and probes. Each fingerprint is listed under its value in a partition and probes the values
within the threshold; what meets there is verified on all 64 bits.

Only distinct fingerprints take part, and a bucket yields a spanning forest of its links instead of all
its pairs; what is linked already leaves the search, so dense buckets cost little. A large bucket whose
members are far apart is split by further bits, by the same principle. Components are then found over
these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mapped
from .components import components

BITS = 64
#: Buckets of up to so many members are compared all together, larger ones one by one; parts of a split one, whose members are far apart, up to more.
SMALL, SMALL_PART = 24, 96
#: A bucket that still has more than so many members after so many comparisons with one of them is split.
LARGE, STEPS = 1 << 14, 64
#: Shingles that are hashed at once.
AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the shingles of a text, as a signed 64-bit integer; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, AT_ONCE):
        hashes = np.array([digest(line[i:j], seed) for i, j in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE], strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: Column | str = "text", **options: int) -> DataFrame:
    """``keep`` and ``fingerprint`` (long)."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fingerprint", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                prints = [fingerprint(t, **options) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(prints, pa.int64())], schema.names)

    return mapped(docs.select(*keep, text), run, schema)


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and how often each two bits are set together (64 x 64 sums come to the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, together = 0, np.zeros((BITS, BITS))
        for batch in batches:
            bits = unpacked(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float32)
            total += len(bits)
            together += bits.T @ bits
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(together.ravel(), total).astype(np.int64))], ["cell", "n"])

    rows = prints.select("fingerprint").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1, np.int64)
    for cell, n in rows:
        out[cell] = n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def unpacked(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def grouped_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """The bits in ``m`` partitions of nearly equal width, correlated bits together."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    alike = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(left, key=lambda b: (alike[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (alike[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def within(p: np.ndarray, most: int) -> list[float]:
    """Chance that two fingerprints with independent bits of these rates differ in at most 0, 1, ... most of them."""
    ways = np.zeros(len(p) + 1)
    ways[0] = 1
    for q in 2 * p * (1 - p):
        ways[1:] = ways[1:] * (1 - q) + ways[:-1] * q
        ways[0] *= 1 - q
    return np.cumsum(ways)[: most + 1].tolist()


def plan(n: int, together: np.ndarray, max_distance: int, probe_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """Partitions and thresholds with the least estimated cost; a probe costs as much as so many candidates."""
    rates, best = np.diag(together) / max(n, 1), None
    for m in range(1, max_distance + 2):
        parts = grouped_bits(n, together, m)
        # cost[k][s]: the first k partitions have thresholds that add up to s - k (each -1 at least)
        cost: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
        for part in parts:
            near, step = within(rates[part], max_distance), {}
            for used, (so_far, chosen) in cost[-1].items():
                for t in range(-1, min(max_distance - used, len(part)) + 1):
                    probes = sum(comb(len(part), k) for k in range(t + 1))
                    c = so_far + (probe_cost * n * probes + n * (n - 1) / 2 * near[t] if t >= 0 else 0.0)
                    if used + t + 1 not in step or c < step[used + t + 1][0]:
                        step[used + t + 1] = (c, [*chosen, t])
            cost.append(step)
        # m partitions: the thresholds add up to max_distance - m + 1, so s = max_distance + 1
        if (found := cost[-1].get(max_distance + 1)) and (best is None or found[0] < best[0]):
            best = (found[0], parts, found[1])
    return [(part, t) for part, t in zip(best[1], best[2], strict=True) if t >= 0]


def probes(prints: np.ndarray, parts: list[tuple[list[int], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, which fingerprints, probing?) for each partition and each set of flipped bits."""
    for k, (part, threshold) in enumerate(parts):
        mask = np.uint64(sum(1 << b for b in part))
        # masked bits of one partition, told apart from others by mixing in the partition's number
        values = prints.astype(np.uint64) & mask
        every = np.arange(len(prints))
        for flips in range(threshold + 1):
            for chosen in combinations(part, flips):
                flip = np.uint64(sum(1 << b for b in chosen))
                # of two fingerprints that differ in one bit, the one that has it probes
                at = every[(values & flip) != 0] if flips == 1 else every
                yield ((values[at] ^ flip) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)).view(np.int64), at, flips > 0


def bucket_links(keys: np.ndarray, prints: np.ndarray, probing: np.ndarray, max_distance: int, levels: tuple[int, ...] = (), free: int = (1 << BITS) - 1, small: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within runs of equal keys; the rows of a run are listed ones first. Whole runs only.

    A small run gives all its links, a larger one a forest that spans them; lesser distances in ``levels`` have forests of their own.
    ``free`` are the bits that runs weren't made by.
    """
    prints = prints.view(np.uint64)  # bitwise_count takes absolute values
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    sizes = stops - starts
    size_at = np.repeat(sizes, sizes)
    few = size_at <= small
    for lag in range(1, min(small, int(sizes.max()))):
        i = np.flatnonzero(few[:-lag] & (keys[:-lag] == keys[lag:]) & ~probing[:-lag])
        i = i[np.bitwise_count(prints[i] ^ prints[i + lag]) <= max_distance]
        yield prints[i].view(np.int64), prints[i + lag].view(np.int64)
    for start, stop in zip(starts[sizes > small].tolist(), stops[sizes > small].tolist(), strict=True):
        own = int((~probing[start:stop]).sum())
        for distance in (*levels, max_distance):
            yield from spanning(prints[start : start + own], prints[start + own : stop], distance, free)


def spanning(listed: np.ndarray, asking: np.ndarray, max_distance: int, free: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A forest of the links between listed fingerprints, and of these with those that ask (forests of parts, where it is split)."""
    steps = 0
    while len(listed):
        queue, listed = [(listed[0], False)], listed[1:]
        while queue:
            steps += 1
            if steps > STEPS and len(listed) + len(asking) > LARGE:
                # what was compared is done; the others, queued or not, meet again in the parts
                back = [np.array([y for y, a in queue if a is asks], np.uint64) for asks in (False, True)]
                parts = split(np.concatenate([listed, back[0]]), np.concatenate([asking, back[1]]), max_distance, free)
                if parts is not None:
                    yield from parts
                    return
                steps = -BITS * STEPS
            x, asks = queue.pop()
            near = np.bitwise_count(listed ^ x) <= max_distance
            found = listed[near]
            listed = listed[~near]
            queue += [(y, False) for y in found]
            if not asks:
                near = np.bitwise_count(asking ^ x) <= max_distance
                queue += [(y, True) for y in asking[near]]
                found = np.concatenate([found, asking[near]])
                asking = asking[~near]
            if len(found):
                yield np.full(len(found), x).view(np.int64), found.view(np.int64)


def split(listed: np.ndarray, asking: np.ndarray, max_distance: int, free: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """Links by parts: of ``max_distance + 1`` groups of the bits that vary, two linked fingerprints agree in one. None with too few such bits."""
    every = np.concatenate([listed, asking])
    vary = int(np.bitwise_or.reduce(every ^ every[0])) & free
    bits = [b for b in range(BITS) if vary >> b & 1]
    if len(bits) <= max_distance:
        return None
    probing = np.arange(len(every)) >= len(listed)

    def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(max_distance + 1):
            mask = sum(1 << b for b in bits[k :: max_distance + 1])
            keys = every & np.uint64(mask)
            order = np.lexsort((probing, keys))
            yield from bucket_links(keys[order], every[order].view(np.int64), probing[order], max_distance, free=free & ~mask, small=SMALL_PART)

    return parts()


def links(prints: DataFrame, max_distance: int = 4, levels: tuple[int, ...] = ()) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span every component of the graph of all links, and those within each lesser distance of ``levels``."""
    n, together = bit_counts(prints)
    parts = plan(n, together, max_distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            for keys, at, asks in probes(own, parts):
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(at), asks)), pa.array(own[at])], ["key", "probing", "fingerprint"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last bucket, which may go on

        def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(rows[0]):
                for a, b in bucket_links(rows[0], rows[2], rows[1], max_distance, levels):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if len(batch):
                rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                if last or held and held[-1][0][0] != rows[0][0]:
                    yield from found([np.concatenate(c) for c in zip(*held, [r[:last] for r in rows], strict=True)])
                    held = []
                held.append([r[last:] for r in rows])
        if held:
            yield from found([np.concatenate(c) for c in zip(*held, strict=True)])

    dealt = mapped(prints.select("fingerprint"), spread, "key long, probing boolean, fingerprint long")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "probing", "fingerprint")
    return mapped(dealt, meet, "a long, b long")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = (), max_distance: int = 4) -> DataFrame:
    """doc_id, ``keep``, fingerprint (long) and component_id for each row.

    component_id is the least doc_id that links lead to, the row's own included; rows without a doc_id
    take part but don't name a component (null if it has no other rows). Null and empty texts have the
    fingerprint 0, which links like any other. Repeated rows stay; other columns are ignored; an empty
    table gives an empty result.
    """
    marked = cut(fingerprints(docs, ("doc_id", *keep)))
    nodes = cut(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, max_distance))
    joined = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(named, "root").select("fingerprint", "component_id")
    return marked.join(named, "fingerprint").select("doc_id", *keep, "fingerprint", "component_id")


def without_copies(docs: DataFrame, max_distance: int = 4) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the least doc_id (ties: any text of it, once)."""
    named = docs.withColumn("_text_key", F.xxhash64("text"))
    marked = near_duplicates(named, ("_text_key",), max_distance)
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_text_key")
    best = marked.groupBy(F.coalesce("component_id", "fingerprint").alias("c"), F.col("component_id").isNull().alias("n")).agg(F.min(own).alias("best"))
    best = best.select(F.col("best.doc_id").alias("doc_id__"), F.col("best._text_key").alias("_text_key__"))
    stay = named.join(best, F.col("doc_id").eqNullSafe(F.col("doc_id__")) & (F.col("_text_key") == F.col("_text_key__")), "left_semi")
    return stay.dropDuplicates(["doc_id", "_text_key"]).select(*docs.columns)
