"""Exact removal of repeated byte strings, by suffix arrays over the corpus' repeated contexts.

Every string of ``length`` bytes has an anchor: the least of its k-grams by hash (ties: the rightmost).
Equal strings have equal anchors at equal offsets, so rows can meet by anchor: neighbouring strings
with one anchor make one context row (anchor, hash of the bytes, document, place). Of equal contexts only
the first may stay; all strings of the others start earlier elsewhere. The distinct contexts of an
anchor that has several are fetched from their documents and cut, at fixed distances from the anchor,
into pieces whose strings share one core; pieces with a shared core are suffix-sorted together, and
equal strings lie side by side there. A string is removed unless it is the first of its kind.

No group is gathered whatever its size: equal contexts of a batch are settled before the shuffle, those
of an anchor as they stream by. An anchor with more than ``MANY`` distinct contexts has its pieces dealt out
by core instead, and a core with more than ``GATHERED`` bytes of distinct pieces has them cut finer and
dealt out again, by longer cores, down to single strings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written
from .suffixes import suffix_array

K = 16
#: Neighbouring strings that share a core, at first and where pieces are cut finer.
STEP, FINER = 16, 4
MANY = 20_000  # contexts of one anchor that a task gathers
#: Bytes that are hashed at once, and that are suffix-sorted together; distinct pieces of one core that are gathered.
AT_ONCE, SORTED, GATHERED = 1_000_000, 40_000, 400_000
NO_ID = (1 << 63) - 1
#: A place packs (start, offset of the anchor, number of strings - 1): 31, 7 and 7 bits.
SPAN = 1 << 14


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, which text, start, offset of the anchor, number of strings)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    n, w = len(buffer), length - K + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if n < length or not (sizes >= length).any():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, base, m = buffer.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while m < K:
        h = h[:-m] * np.uint64(base) + h[m:]
        base, m = base * base % (1 << 64), 2 * m
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    least = (h >> np.uint64(30)).astype(np.int64) << 29 | (n - np.arange(len(h)))
    m = 1
    while 2 * m <= w:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    if m < w:
        least = np.minimum(least[: len(least) - (w - m)], least[w - m :])
    at = n - (least & ((1 << 29) - 1))
    inside = np.zeros(len(at) + 1, np.int32)
    long_enough = sizes >= length
    np.add.at(inside, starts[long_enough], 1)
    np.add.at(inside, ends[long_enough] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
    a = at[s]
    of = np.searchsorted(ends, s, side="right")
    new = np.flatnonzero(np.concatenate([[True], (np.diff(a) != 0) | (np.diff(of) != 0)]))
    first, final = s[new], s[np.concatenate([new[1:] - 1, [len(s) - 1]])]
    return h[a[new]].view(np.int64), of[new], first - starts[of[new]], a[new] - first, final - first + 1


def hashed(values: np.ndarray) -> np.ndarray:
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of AT_ONCE bytes, or one longer text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > AT_ONCE:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def pieces(context: bytes, offset: int, count: int, length: int, width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first string, number of strings, step, core) for the strings of a context, cut at fixed distances from the anchor.

    String ``i`` of the context starts ``offset - i`` bytes before the anchor; ``width`` neighbours share a core.
    """
    r = offset - count + 1
    while r <= offset:
        step = r // width
        top = min(offset, width * step + width - 1)
        core = offset - width * step
        yield offset - top, top - r + 1, step, context[core : core + length - width + 1]
        r = top + 1


Piece = tuple[bytes, int, int, int, int, int]  # bytes, document, copy, start, number of strings, offset of the anchor


def distinct_pieces(rows: list[Piece]) -> tuple[list[Piece], list[Piece]]:
    """The first of each bytes, and the others."""
    rows.sort()
    first, others = [], []
    for row in rows:
        (others if first and first[-1][0] == row[0] else first).append(row)
    return first, others


def sorted_repeats(batch: list[Piece], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Strings of distinct pieces that start earlier in another one: (document, copy, start, 1), by the order of all suffixes."""
    text = b"\0".join(p[0] for p in batch) + b"\0"
    begin = np.cumsum([0] + [len(p[0]) + 1 for p in batch])
    order = np.array(suffix_array(text))
    which = np.searchsorted(begin, order, side="right") - 1
    within = order - begin[which]
    counts = np.array([p[4] for p in batch])
    is_start = within < counts[which]
    order, which, within = order[is_start].tolist(), which[is_start].tolist(), within[is_start].tolist()
    before, group = b"", []

    def close() -> Iterator[tuple[int, int, int, int]]:
        if len(group) > 1:
            group.sort()
            for doc, copy, start in group[1:]:
                yield doc, copy, start, 1

    for i, k, j in zip(order, which, within, strict=True):
        string = text[i : i + length]
        if string != before:
            yield from close()
            before, group = string, []
        _, doc, copy, start, _, _ = batch[k]
        group.append((doc, copy, start + j))
    yield from close()


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``_doc`` and ``_copy``: documents go by id, those without one last; equal ids by their texts."""
    named = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    if not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return named.withColumn("_copy", F.lit(0).cast("long"))
    # all rows in ranges of (id, text), so that neither an id nor a repeated row has to fit one task; places there rise with the order
    tied = named.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("_doc", "text", "_tie")
    return written(tied.sortWithinPartitions("_doc", "text", "_tie").withColumn("_copy", F.monotonically_increasing_id()).drop("_tie"))


def contexts(docs: DataFrame, length: int) -> DataFrame:
    """(anchor, context, doc, copy, at) of all strings of ``length`` bytes.

    Of equal contexts in one batch all but the first are settled here: their ``at`` is inverted, and in
    place of the anchor they have a hash of their own, so that frequent passages don't meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for from_row in range(0, len(batch), 1000):
                some = [(t or "").encode("utf-8", "replace") for t in batch.column(2).slice(from_row, 1000).to_pylist()]
                for begin, texts in parts(some):
                    anchor, of, start, offset, count = anchors(texts, length)
                    if not len(of):
                        continue
                    hashes = np.array([digest(texts[i][j:k]) for i, j, k in zip(of.tolist(), start.tolist(), (start + count - 1 + length).tolist(), strict=True)], np.uint64)
                    own = from_row + begin + of
                    at = start << 14 | offset << 7 | (count - 1)
                    order = np.lexsort((at, copies[own], ids[own], hashes, anchor))
                    again = order[1:][(np.diff(anchor[order]) == 0) & (hashes[order[1:]] == hashes[order[:-1]])]
                    anchor[again] = hashed(ids[own[again]] ^ copies[own[again]] ^ at[again])
                    at[again] = ~at[again]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, hashes.view(np.int64), ids[own], copies[own], at)], ["anchor", "context", "doc", "copy", "at"])

    return mapped(docs.select("_doc", "_copy", "text"), run, "anchor long, context long, doc long, copy long, at long")


def classes(found: DataFrame) -> DataFrame:
    """(anchor, doc, copy, at, kind): 0 an equal context comes before, 1 a first context beside others of its anchor, 2 beside very many."""
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "copy", "at")

    def rows(columns: list[np.ndarray], kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(columns[0]), kind, np.int32))], ["anchor", "doc", "copy", "at", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 4
        held, last, many = none, None, None  # first contexts of the last anchor; the last row; the last anchor if it has very many
        for batch in batches:
            if not len(batch):
                continue
            a, c, d, n, p = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            settled = p < 0
            if settled.any():
                yield rows([a[settled], d[settled], n[settled], ~p[settled]], 0)
                a, c, d, n, p = (x[~settled] for x in (a, c, d, n, p))
                if not len(a):
                    continue
            new = np.concatenate([[last is None or last != (a[0], c[0])], (a[1:] != a[:-1]) | (c[1:] != c[:-1])])
            last = (a[-1], c[-1])
            yield rows([x[~new] for x in (a, d, n, p)], 0)
            firsts = [x[new] for x in (a, d, n, p)]
            if many is not None:
                wide = firsts[0] == many
                yield rows([x[wide] for x in firsts], 2)
                firsts = [x[~wide] for x in firsts]
                if a[-1] != many:
                    many = None
            held = [np.concatenate([x, y]) for x, y in zip(held, firsts, strict=True)]
            if not len(held[0]):
                continue
            cut_at = int(np.flatnonzero(held[0] == held[0][-1])[0]) if many is None else len(held[0])
            done, held = [x[:cut_at] for x in held], [x[cut_at:] for x in held]
            edge = np.flatnonzero(np.diff(done[0])) + 1
            sizes = np.diff(np.concatenate([[0], edge, [cut_at]])) if cut_at else np.zeros(0, np.int64)
            several = np.repeat(sizes > 1, sizes)
            yield rows([x[several] for x in done], 1)
            if len(held[0]) > MANY:
                yield rows(held, 2)
                held, many = none, held[0][0]
        if len(held[0]) > 1:
            yield rows(held, 1)

    return mapped(dealt, run, "anchor long, doc long, copy long, at long, kind int")


PIECES = "key long, width int, doc long, copy long, at long, bytes binary"


def dealt_out(context: bytes, doc: int, copy: int, at: int, length: int, width: int) -> Iterator[tuple]:
    """Rows of PIECES: the pieces of a context, under the hash of their core."""
    start, offset, count = at >> 14, at >> 7 & 127, (at & 127) + 1
    for i, n, step, core in pieces(context, offset, count, length, width):
        yield xxhash.xxh3_64_intdigest(core, step) - (1 << 63), width, doc, copy, (start + i) << 14 | (offset - i) << 7 | (n - 1), context[i : i + n - 1 + length]


def piece_rows(rows: list[tuple]) -> pa.RecordBatch:
    key, width, doc, copy, at, data = zip(*rows, strict=True)
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((key, width, doc, copy, at, data), types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])


def fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Rows of PIECES: whole contexts of kind 1 under their anchor (width 0), and pieces of those of kind 2."""
    lists = wanted.groupBy("doc", "copy").agg(F.collect_list(F.struct("anchor", "at", "kind")).alias("wanted"))
    joined = docs.select("_doc", "_copy", "text").join(lists, (F.col("_doc") == F.col("doc")) & (F.col("_copy") == F.col("copy")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 200):
                out: list[tuple] = []
                part = batch.slice(row, 200)
                for doc, copy, text, own in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                    data = text.encode("utf-8", "replace")
                    for w in own:
                        at = w["at"]
                        start, count = at >> 14, (at & 127) + 1
                        context = data[start : start + count - 1 + length]
                        if w["kind"] == 1:
                            out.append((w["anchor"], 0, doc, copy, at, context))
                        else:
                            out += dealt_out(context, doc, copy, at, length, STEP)
                for k in range(0, len(out), 20_000):
                    yield piece_rows(out[k : k + 20_000])

    return mapped(joined.select("doc", "copy", "text", "wanted"), run, PIECES)


def ordered(found: DataFrame, length: int) -> DataFrame:
    """(doc, copy, start, stop) of repeated strings among the pieces of each key; where ``bytes`` isn't null, a row of PIECES to be dealt out again."""
    dealt = found.repartition("key", "width").sortWithinPartitions("key", "width", "bytes", "doc", "copy", "at")
    names = [*(x.split()[0] for x in PIECES.split(", ")), "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[Piece] = []  # distinct pieces to be suffix-sorted; a batch may hold several cores
        size, out, again = 0, [], []

        def sort_waiting() -> None:
            nonlocal waiting, size
            out.extend(sorted_repeats(waiting, length))
            waiting, size = [], 0

        def by_core(rows: list[Piece], width: int) -> None:
            cores = defaultdict(list)
            for context, doc, copy, start, count, offset in rows:
                for i, n, step, core in pieces(context, offset, count, length, width):
                    cores[step, core].append((context[i : i + n - 1 + length], doc, copy, start + i, n, offset - i))
            for own in cores.values():
                if len(own) > 1:
                    first, others = distinct_pieces(own)
                    out.extend(x[1:5] for x in others)
                    settle(first, width)

        def settle(first: list[Piece], width: int) -> None:
            """Distinct pieces of one core."""
            nonlocal size
            if len(first) < 2:
                return
            more = sum(len(x[0]) for x in first)
            if more > GATHERED and width > 1:
                by_core(first, width // FINER)
                return
            waiting.extend(first)
            size += more
            if size > SORTED:
                sort_waiting()

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                doc, copy, start, n = (np.array(x, np.int64) for x in zip(*out, strict=True))
                none = pa.nulls(len(doc), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.nulls(len(doc), pa.int32()), pa.array(doc), pa.array(copy), none, pa.nulls(len(doc), pa.binary()), pa.array(start), pa.array(start + n - 1 + length)], names)
                out.clear()
            for k in range(0, len(again), 20_000):
                rows = piece_rows(again[k : k + 20_000])
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, none, none], names)
            again.clear()

        now, group, gathered, many = (None, None), [], 0, False
        for batch in batches:
            for key, width, doc, copy, at, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, width) != now:
                    if now[1]:
                        settle(group, now[1])
                    else:  # whole contexts of an anchor, MANY at most
                        by_core(group, STEP)
                    now, group, gathered, many, last = (key, width), [], 0, False, None
                row = (data, doc, copy, at >> 14, (at & 127) + 1, at >> 7 & 127)
                if width and data == last:
                    out.append(row[1:5])
                    continue
                last = data
                if many:
                    again += dealt_out(data, doc, copy, at, length, width // FINER)
                    continue
                group.append(row)
                gathered += len(data)
                if width > 1 and gathered > GATHERED:
                    many = True
                    for x in group:
                        again += dealt_out(x[0], x[1], x[2], x[3] << 14 | x[5] << 7 | (x[4] - 1), length, width // FINER)
                    group = []
            yield from flush()
        if now[1]:
            settle(group, now[1])
        else:
            by_core(group, STEP)
        if waiting:
            sort_waiting()
        yield from flush()

    return mapped(dealt, run, f"{PIECES}, start long, stop long")


def repeats(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc, copy, start, stop) of repeated strings among the contexts of kinds 1 and 2."""
    found, out = written(ordered(fetched(docs, wanted, length), length)), []
    while True:  # widths go down to 1, whose pieces are single strings
        out.append(found.where("bytes is null").select("doc", "copy", "start", "stop"))
        again = found.where("bytes is not null").select(*[x.split()[0] for x in PIECES.split(", ")])
        if again.isEmpty():
            return reduce(DataFrame.unionByName, out)
        found = written(ordered(again, length))


def joined_spans(docs: DataFrame, length: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep``, _text and _spans (array of long, packed start and size; null if nothing goes) for each row."""
    named = numbered(docs.select(F.struct(*keep).alias("_own"), "doc_id", "text"))
    found = written(classes(contexts(named, length)))
    start = F.shiftright("at", 14)
    whole = found.where("kind = 0").select("doc", "copy", start.alias("start"), (start + F.col("at").bitwiseAND(127) + length).alias("stop"))
    spans = whole.unionByName(repeats(named, found.where("kind > 0"), length))
    spans = spans.groupBy("doc", "copy").agg(F.collect_list(F.shiftleft("start", 14) + (F.col("stop") - F.col("start"))).alias("spans"))
    joined = named.join(spans, (F.col("_doc") == F.col("doc")) & (F.col("_copy") == F.col("copy")), "left")
    return joined.select("_own.*", F.col("text").alias("_text"), F.col("spans").alias("_spans"))


def merged(spans: list[int] | None) -> list[list[int]]:
    """Packed spans as runs (start, stop), overlapping and touching ones joined."""
    out: list[list[int]] = []
    for x in sorted(spans or ()):
        i, j = x >> 14, (x >> 14) + (x & SPAN - 1)
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return out


def without(data: bytes, runs: list[list[int]]) -> bytes:
    edges = [0, *[e for run in runs for e in run], len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def without_repeats(docs: DataFrame, length: int = 100, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_bytes, n_removed, spans (array of start, stop) and kept (binary) for each row.

    A byte goes if a string of ``length`` bytes that covers it starts earlier as well: in a document of
    smaller id, or in the same one before. Rows without a doc_id come last; rows of equal ids are
    documents of their own, in the order of their texts. Null texts are empty; texts under ``length``
    bytes stay whole; other columns are ignored; an empty table gives an empty result.
    """
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 500):
                part = batch.slice(row, 500)
                data = [(t or "").encode("utf-8", "replace") for t in part.column(len(keep)).to_pylist()]
                runs = [merged(s) for s in part.column(len(keep) + 1).to_pylist()]
                kept = [without(d, r) for d, r in zip(data, runs, strict=True)]
                gone = [len(d) - len(k) for d, k in zip(data, kept, strict=True)]
                spans = pa.array([[{"start": i, "stop": j} for i, j in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(map(len, data), pa.int64()), pa.array(gone, pa.int64()), spans, pa.array(kept, pa.binary())], [*keep, "n_bytes", "n_removed", "spans", "kept"])

    schema = f"{types}, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary"
    return mapped(joined_spans(docs, length, keep), run, schema)


def without_passages(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeated strings cut from ``text``; a character that loses a byte goes (``n_chars`` is set anew).

    Every row stays, null texts as null; what counts as repeated: see :func:`without_repeats`.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, len(batch), 500):
                part = batch.slice(row, 500)
                texts, spans = (part.column(len(names) + i).to_pylist() for i in (0, 1))
                texts = [without(t.encode("utf-8", "replace"), merged(s)).decode("utf-8", "ignore") if s else t for t, s in zip(texts, spans, strict=True)]
                columns = dict(zip(names, part.columns, strict=False)) | {"text": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    out = mapped(joined_spans(docs, length, tuple(names)), run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
