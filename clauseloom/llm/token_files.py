"""Token ids in files, by Simple-8b word-aligned coding.

A 64-bit word holds a selector in its upper four bits and as many ids as the widest of them allows in the other
60: the ``k``-th layout has ``COUNTS[k]`` places of ``60 // COUNTS[k]`` bits. Values of more than 60 bits are
escapes: selector 0 stands for one of them, and their values follow behind all words. Words are chosen from the left,
the most ids that fit. Ids are cut into blocks of ``BLOCK``; a block begins with a word of its own, at an offset that
is written down, so the words of all blocks are chosen side by side, and each can be decoded alone. Places behind
a block's last id hold zeros.

A file is a Parquet table (Spark commits its parts, so a lost executor leaves none half written). A row has the blocks
of up to ``ROW`` ids and the documents they belong to, the row's place and how many ids its file has before it. A
long document goes on over several rows, and no row needs another to be decoded.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, shared_folder, whole

#: Places of each layout, from most to least: all numbers of equal places that 60 bits can be cut into.
COUNTS = sorted({60 // width for width in range(1, 61)}, reverse=True)
WIDTHS = [60 // n for n in COUNTS]
#: Bits of small values.
SMALL_BITS = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)
BLOCK, ROW = 1024, 1 << 18
#: Pieces of text whose ids a worker remembers (twice as many at most), bytes of text that are encoded at once.
REMEMBERED, AT_ONCE = 500_000, 4_000_000
ROWS = "part int, row int, first long, n_ids long, bytes binary"


def layouts(values: np.ndarray) -> np.ndarray:
    """For each position the layout of a word that begins there: the first, with most places, that holds what follows; len(COUNTS) for an escape.

    ``values`` has a block in each row, with zeros behind it.
    """
    # a value's bits, as far as layouts tell them apart
    if values.max(initial=0) < len(SMALL_BITS):
        bits = SMALL_BITS[values.astype(np.int64)]
    else:
        bits = np.zeros(values.shape, np.uint8)
        for width in sorted({1, *(w + 1 for w in WIDTHS)}):
            bits[values >= np.uint64(1 << (width - 1))] = width
    n = values.shape[1] - COUNTS[0]
    out, most, reach = np.full((len(values), n), len(COUNTS), np.int8), bits, 1
    for k in reversed(range(len(COUNTS))):
        while reach < COUNTS[k]:  # most[:, i] becomes the largest of COUNTS[k] values from i on
            step = min(reach, COUNTS[k] - reach)
            most = np.maximum(most[:, :-step], most[:, step:])
            reach += step
        fits = most[:, :n] <= WIDTHS[k]
        if not fits.any():  # nor do more places of fewer bits
            break
        out[fits] = k
    return out


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values: how many, how many words, the offsets of the blocks' words, the words, the escaped values."""
    values = np.asarray(values, np.uint64)
    n_blocks = -(-len(values) // BLOCK)
    blocks = np.zeros((n_blocks, BLOCK + COUNTS[0]), np.uint64)
    last = len(values) - (n_blocks - 1) * BLOCK
    if n_blocks:
        blocks[:-1, :BLOCK] = values[: len(values) - last].reshape(-1, BLOCK)
        blocks[-1, :last] = values[len(values) - last :]
    layout = layouts(blocks)
    # all blocks go on by one word at a time
    sizes, ends = np.array([*COUNTS, 1])[layout], np.full(n_blocks, BLOCK)
    ends[-1:] = last
    begin, at, which = np.zeros((n_blocks, BLOCK), bool), np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    while len(which):
        begin[which, at] = True
        at = at + sizes[which, at]
        on = at < ends[which]
        which, at = which[on], at[on]
    row, place = np.nonzero(begin)
    chosen, flat = layout[row, place], row * blocks.shape[1] + place
    words, padded = np.zeros(len(row), np.uint64), blocks.ravel()
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        rows = np.flatnonzero(chosen == k)
        word = np.full(len(rows), (k + 1) << 60, np.uint64)
        for j in range(count) if len(rows) else ():
            word |= padded[flat[rows] + j] << np.uint64(j * width)
        words[rows] = word
    offsets = np.searchsorted(row, np.arange(n_blocks))
    return b"".join(x.astype("<u8").tobytes() for x in (np.array([len(values), len(words)]), offsets, words, padded[flat[chosen == len(COUNTS)]]))


def unpacked(content: bytes, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The values of the blocks from ``first`` to before ``stop`` (all of them): every layout's words are cut at once and put to their places."""
    n, n_words = np.frombuffer(content, "<u8", 2).astype(np.int64).tolist()
    n_blocks = -(-n // BLOCK)
    offsets = np.append(np.frombuffer(content, "<u8", n_blocks, 16).astype(np.int64), n_words)
    stop = n_blocks if stop is None else min(stop, n_blocks)
    words = np.frombuffer(content, "<u8", n_words, 16 + 8 * n_blocks)
    escaped = np.frombuffer(content, "<u8", offset=16 + 8 * (n_blocks + n_words))
    if len(escaped):
        before = int((words[: offsets[first]] >> np.uint64(60) == 0).sum())
        escaped = escaped[before:]
    words, offsets = words[offsets[first] : offsets[stop]], offsets[first:stop] - offsets[first]
    layout = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(np.array([1, *COUNTS])[layout])
    begins = ends - np.array([1, *COUNTS])[layout]
    # from the places that words have to those of their blocks, whose last words may reach over the end
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    begins += (np.arange(len(offsets)) * BLOCK - begins[offsets])[block] if len(offsets) else 0
    out = np.zeros(max(len(offsets), 1) * BLOCK + COUNTS[0], np.uint64)
    for k, (count, width) in list(enumerate(zip(COUNTS, WIDTHS, strict=True)))[::-1]:
        rows = np.flatnonzero(layout == k + 1)
        for j in range(count) if len(rows) else ():
            at, value = begins[rows] + j, words[rows] >> np.uint64(j * width) & np.uint64((1 << width) - 1)
            inside = at < (block[rows] + 1) * BLOCK if j else slice(None)
            out[at[inside]] = value[inside]
    at = np.flatnonzero(layout == 0)
    out[begins[at]] = escaped[: len(at)]
    return out[: min(n - first * BLOCK, len(offsets) * BLOCK)]


class Remembered:
    """A bounded cache in two generations: what the younger doesn't hold is taken over from the older one, if that does."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set[bytes]) -> list[bytes]:
        """Those of ``keys``, none of which ``young`` holds, that aren't known at all; ``young`` holds the others now."""
        kept = keys & self.old.keys()
        self.young.update((k, self.old[k]) for k in kept)
        return list(keys - kept)

    def grow_old(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


#: Latin letters, and ASCII marks but the apostrophe, which can begin a token with letters.
_LETTER, _MARK = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])", rb"[!-&(-/:-@\[-`{-~]"
#: A text's pieces: a word up to an ASCII mark or white space, a digit, marks up to a word, digit or white space; else all up to white space.
PIECE = re.compile(_LETTER + rb"++(?=[\s!-@\[-`{-~]|\Z)|[0-9]|" + _MARK + rb"++(?=[\s0-9]|" + _LETTER + rb"|\Z)|\S+")
#: Texts of these bytes alone have no apostrophe, no other letters and no control characters (which go with marks): all that is cut where letters, digits and marks meet.
PLAIN = bytes([*range(0x09, 0x0E), *(b for b in range(0x20, 0x7F) if b != 0x27)]) + b"\xc3" + bytes(b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7))
#: What a byte of such a text is: a letter, a mark, white space or the end of a text, a digit.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F], KIND[[0, *range(0x09, 0x0E), 0x20]], KIND[ord("0") : ord("9") + 1] = 1, 2, 3
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 0
SIMPLE = re.compile(_LETTER + rb"+|[0-9]|" + _MARK + rb"+")
#: A simple piece that is the same when it is normalised, and whose bytes stand for themselves in the vocabulary.
NORMAL = re.compile(rb"[a-z]+|[0-9]|" + _MARK + rb"+")


def plain_pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The pieces of texts of ``PLAIN`` bytes: a space is put wherever they meet, so that all are what white space leaves."""
    buffer = np.frombuffer(b"\0".join(texts), np.uint8)
    kind = KIND[buffer]
    meet = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
    meet &= (kind[1:] != 2) & (kind[:-1] != 2)
    spaced = np.insert(buffer, np.flatnonzero(meet) + 1, 32)
    return map(bytes.split, spaced.tobytes().split(b"\0"))


class Encoder:
    """The ids of texts by a tokenizer file that drops white space and lower-cases, and whose words end with ``</w>``.

    Its tokens hold a run of letters, a digit or a run of marks, or an apostrophe with letters. So a text's ids are those of
    the pieces that it is cut into at white space and between letters and marks. The library encodes a piece once, and
    what it gave is remembered; pieces of a single token each are encoded many at a time, as one text, in which
    each has one id that ends it. In most of these nothing is left to normalise, so they are cut at the spaces alone.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.at_spaces = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.at_spaces.normalizer, self.at_spaces.pre_tokenizer = None, pre_tokenizers.Split(" ", "removed")
        vocabulary = self.tokenizer.get_vocab()
        added = "|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile((added or "(?!)").encode())  # texts with these aren't cut
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known = Remembered(REMEMBERED)

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        self.known.grow_old()
        plain, cut, new = [], [], set()
        for text in texts:
            lower = text.lower()
            # small letters and combining marks can meet in one character where capital ones don't
            apart = b"\xcc" in text or b"\xcd" in text
            if self.added.search(lower):
                cut.append(None)
            elif lower.translate(None, PLAIN):
                cut.append(PIECE.findall(text if apart else lower))
            else:
                plain.append(lower)
                cut.append(plain)
        pieces_of, known = plain_pieces(plain), self.known.young.get
        cut = [next(pieces_of) if x is plain else x for x in cut]
        found = [list(map(known, pieces or ())) for pieces in cut]
        gaps = [[k for k, i in enumerate(ids) if i is None] for ids in found]
        for pieces, gap in zip(cut, gaps, strict=True):
            new.update([pieces[k] for k in gap])
        self.learn(self.known.missing(new))
        for text, pieces, ids, gap in zip(texts, cut, found, gaps, strict=True):
            for k in gap:
                ids[k] = self.known.young[pieces[k]]
            yield self.whole([text])[0] if pieces is None else np.frombuffer(b"".join(ids), "<u4")

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        normal = [p for p in new if NORMAL.fullmatch(p)]
        others = list(set(new).difference(normal))
        simple = [p for p in others if SIMPLE.fullmatch(p)]
        self.learn_words(normal, self.at_spaces)
        self.learn_words(simple, self.tokenizer)
        others = list(set(others).difference(simple))
        for start in range(0, len(others), 10_000):
            some = others[start : start + 10_000]
            self.known.young.update((p, ids.tobytes()) for p, ids in zip(some, self.whole(some), strict=True))

    def learn_words(self, new: list[bytes], tokenizer) -> None:  # noqa: ANN001
        groups = [new[start : start + 500] for start in range(0, len(new), 500)]
        for start in range(0, len(groups), 20):
            some = groups[start : start + 20]
            found = tokenizer.encode_batch_fast([b" ".join(g).decode() for g in some], add_special_tokens=False)
            for group, e in zip(some, found, strict=True):
                ids = np.array(e.ids, "<u4")
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                raw = ids.tobytes()
                self.known.young.update((w, raw[i:j]) for w, i, j in zip(group, [0, *stops], stops, strict=False))
                if len(stops) != len(group):
                    raise ValueError("a word has not exactly one id that ends it: this tokenizer's words can't be encoded together")


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids with the end id) of rows (doc_id, text)."""
    closing = np.array([end], "<u4")
    for batch in batches:
        held, size = [], 0
        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= AT_ONCE or i == len(batch) - 1:
                ids = batch.column(0).slice(i + 1 - len(held), len(held)).to_pylist()
                for doc_id, found in zip(ids, encoder(path).encode(held), strict=True):
                    yield doc_id, np.concatenate([found, closing])
                held, size = [], 0


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 1, parts: int | None = None) -> None:
    """Writes the ids of all texts to ``folder``, in ascending order of doc_id; each text's ids are followed by ``end``.

    ``path`` is a tokenizer file on every machine. Null texts are empty; rows without a doc_id come last; rows of one id go
    by a hash of their texts, and equal rows in any order, so neither an id nor a repeated row has to fit one task. An
    empty table gives a folder without blocks. Other columns are ignored.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_last(), "turn", "row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumns({"turn": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first, row, held, size, docs_of = 0, 0, [], 0, []  # docs_of: (doc_id, number in the part, ids of it in this row)

        def out() -> pa.RecordBatch:
            nonlocal first, row, held, size, docs_of
            ids, no, shares = zip(*docs_of, strict=True)
            head = [np.array([len(ids)]), np.array([0 if i is None else i for i in ids]), np.array([i is None for i in ids]), np.array(no), np.array(shares)]
            content = b"".join(x.astype("<i8").tobytes() for x in head) + packed(np.concatenate(held))
            made = [pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), pa.array([content], pa.binary())]
            first, row, held, size, docs_of = first + size, row + 1, [], 0, []
            return pa.RecordBatch.from_arrays(made, ["part", "row", "first", "n_ids", "bytes"])

        for no, (doc_id, ids) in enumerate(encoded(batches, path, end)):
            at = 0
            while at < len(ids):
                share = ids[at : at + ROW - size]
                held.append(share)
                docs_of.append((doc_id, no, len(share)))
                at, size = at + len(share), size + len(share)
                if size == ROW:
                    yield out()
        if size:
            yield out()

    mapped(rows, run, ROWS).write.option("compression", "none").parquet(folder)


def shares_of(content: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(doc ids, which are null, numbers, shares) of a row's documents, and its ids."""
    n = int(np.frombuffer(content, "<i8", 1)[0])
    columns = np.frombuffer(content, "<i8", 4 * n, 8).reshape(4, n)
    return list(columns), unpacked(content[8 + 32 * n :])


def crc_of_both(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings end to end, from theirs and the size of the second: a CRC is linear in its start and its bytes."""
    zeros, step, nothing = first, 1 << 20, 0
    for at in range(0, size, step):
        some = bytes(min(step, size - at))
        zeros, nothing = zlib.crc32(some, zeros), zlib.crc32(some, nothing)
    return zeros ^ nothing ^ second


def read_tokens(spark, folder: str, digest: bool = True) -> DataFrame:  # noqa: ANN001
    """doc_id, start, n_tokens and ids_crc32 (or, without ``digest``, ids as an array) of each document, read from its files.

    ``start`` counts the ids of all documents before, over all files.
    """
    rows = spark.read.schema(ROWS).parquet(folder)
    own = T.StructType([*T.StructType.fromDDL("part int, no long, doc_id long, row int, start long, n long, crc long").fields, *([] if digest else [T.StructField("ids", T.ArrayType(T.LongType()))])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                (ids, null, no, sizes), values = shares_of(row["bytes"])
                ends = np.cumsum(sizes)
                raw = values.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                same = lambda x: pa.array(np.full(len(ids), x, np.int32))
                columns = [same(row["part"]), pa.array(no), pa.array(ids, mask=null != 0), same(row["row"]), pa.array(row["first"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())]
                if not digest:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, own.names)

    shares = mapped(rows, run, own)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    pieces = F.array_sort(F.collect_list(F.struct("row", "n", "crc", *([] if digest else ["ids"]))))  # of one document
    joined = shares.groupBy("part", "no").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), pieces.alias("pieces"))
    result = F.when(F.size("pieces") == 1, F.col("pieces.crc")[0]).otherwise(crc_of(F.col("pieces.n"), F.col("pieces.crc"))).alias("ids_crc32") if digest else F.flatten("pieces.ids").alias("ids")
    return joined.join(F.broadcast(parts), "part").select("doc_id", (F.col("earlier") + F.col("start")).alias("start"), "n_tokens", result)


@F.pandas_udf(T.LongType())
def crc_of(sizes: pd.Series, crcs: pd.Series) -> pd.Series:
    """CRC-32 of documents from the sizes (ids) and CRCs of their shares."""

    def joined(ns: np.ndarray, cs: np.ndarray) -> int:
        out = int(cs[0])
        for n, c in zip(ns[1:].tolist(), cs[1:].tolist(), strict=True):
            out = crc_of_both(out, c, 4 * n)
        return out

    return sizes.combine(crcs, joined)


def through_files(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """What :func:`read_tokens` reads back after :func:`write_tokens` has written ``docs`` to the shared folder."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, end)
    return read_tokens(docs.sparkSession, folder)
