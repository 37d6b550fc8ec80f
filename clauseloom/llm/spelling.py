"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word's vector counts its letters (code points folded to ``LETTERS`` kinds). One replaced letter takes one off
one count and adds one to another, one inserted letter adds one: an L1 distance of at most two. So each length has a
k-d tree over the vectors of its words; a word asks the tree of its own length (one count up, one down) and that of
the next length (one up), and a branch is entered only if the edits left can still reach its box. What a leaf holds
is compared by the parities of its counts, then by the order of the letters, which decides.

The upper levels of a tree are fitted on a bounded sample and deal words and askers out to cells; every word is stored
in one cell. Within a cell the tree goes on over all stored words, and askers stream through it.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, whole, written

LETTERS = 64
#: Words of a cell (about; and of the shorter words that ask it), and of a leaf of its tree.
CELL, LEAF = 4096, 12
#: Words that the upper levels of all trees are fitted on.
SAMPLE = 65_536
#: Words that a task counts before it hands them on, askers that are looked up at once, code points compared at once.
HELD, ASKERS, COMPARED = 200_000, 2_000, 4_000_000
NONE = LETTERS  # a letter that no branch asks for

_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def garbled(run: bytes, doc: int, every: int) -> bytes:
    """``run`` (Latin-1), without one letter where ``every`` divides the CRC-32 of ``<doc_id>:<run>``; ``doc`` is the CRC of what is before the run."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def corpus_words(docs: DataFrame, least_letters: int = 5, least_count: int = 3, garble_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of whole texts, with their counts.

    ``garble_every`` plants misspellings: about one in so many (document, run) pairs loses a letter. Null texts have no
    words; a missing doc_id counts as an empty one; repeated rows count each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            counts = pa.array(held.values(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found, n in Counter(text.as_py().encode("latin-1", "replace").translate(_RUNS).split()).items():
                    if len(found) >= least_letters:
                        word = garbled(found, doc, garble_every) if garble_every else found
                        if len(word) >= least_letters:
                            held[word] += n
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    counted = mapped(docs.select("doc_id", whole().alias("text")), run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def spelt(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def counted(codes: np.ndarray) -> np.ndarray:
    out, rows = np.zeros((len(codes), LETTERS), np.int32), np.arange(len(codes))
    for column in codes.T:
        out[rows, column % LETTERS] += 1
    return out


def parities(counts: np.ndarray) -> np.ndarray:
    return ((counts & 1).astype(np.uint64) << np.arange(LETTERS, dtype=np.uint64)).sum(1, dtype=np.uint64)


def best_split(counts: np.ndarray) -> tuple[int, int]:
    """(letter, t): the split 'count <= t' that comes nearest to halves; (0, -2), with nothing on its left, where all vectors are equal."""
    best, most = (0, -2), len(counts)
    for t in range(int(counts.max(initial=0))):
        left = (counts <= t).sum(0)
        letter = int(np.abs(2 * left - len(counts)).argmin())
        if abs(2 * left[letter] - len(counts)) < most:
            best, most = (letter, t), abs(2 * int(left[letter]) - len(counts))
    return best


def fitted(counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, thresholds, leaves): a complete tree of ``depth`` levels, node i above 2i + 1 and 2i + 2, and each vector's leaf."""
    letters, thresholds = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, -2, np.int64)
    at = np.zeros(len(counts), np.int64)
    for level in range(depth):
        order = np.argsort(at, kind="stable")
        nodes, starts = np.unique(at[order], return_index=True)
        for node, rows in zip(nodes.tolist(), np.split(order, starts[1:]), strict=True):
            letters[node], thresholds[node] = best_split(counts[rows])
        at = 2 * at + 1 + (counts[np.arange(len(at)), letters[at]] > thresholds[at])
    return letters, thresholds, at - ((1 << depth) - 1)


def reached(counts: np.ndarray, up: np.ndarray, down: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, ...]:
    """(asker, leaf, up, down) of the leaves within an asker's edits.

    ``up`` and ``down`` name the letter that an edit is known to add or take, -1 for an edit that isn't decided, ``NONE`` for none.
    An edit is decided where it crosses a split; from there on the letter's count is the changed one.
    """
    letters, thresholds = tree
    asker, node = np.arange(len(counts)), np.zeros(len(counts), np.int64)
    for _ in range(depth):
        letter, t = letters[node], thresholds[node]
        c = counts[asker, letter] + (up == letter) - (down == letter)
        more = (c == t) & (up == -1) & (down != letter)
        less = (c == t + 1) & (down == -1) & (up != letter)
        node = 2 * node + 1
        over = np.flatnonzero(more), np.flatnonzero(less)
        asker = np.concatenate([asker, asker[over[0]], asker[over[1]]])
        up, down = np.concatenate([up, letter[over[0]], up[over[1]]]), np.concatenate([down, down[over[0]], letter[over[1]]])
        node = np.concatenate([node + (c > t), node[over[0]] + 1, node[over[1]]])
    return asker, node - ((1 << depth) - 1), up, down


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which rows differ by exactly one replaced (equal lengths) or one inserted code point."""
    if short.shape[1] == long.shape[1]:
        return (short != long).sum(1) == 1
    n = short.shape[1]
    head = np.minimum.accumulate(short == long[:, :n], axis=1).sum(1)
    tail = np.minimum.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


class Cell:
    """The stored words of one cell: a k-d tree that askers are looked up in."""

    def __init__(self, words: list[str], counts: list[int]) -> None:
        vectors = counted(spelt(words))
        self.depth = max(0, int(np.ceil(np.log2(len(words) / LEAF))))
        letters, thresholds, leaves = fitted(vectors, self.depth)
        self.tree, order = (letters, thresholds), np.argsort(leaves, kind="stable")
        self.starts = np.searchsorted(leaves[order], np.arange((1 << self.depth) + 1))
        self.order = order  # the places of the words, which are in their own order, by leaves
        self.codes, self.parities = spelt(words), parities(vectors)
        self.words, self.counts = words, np.array(counts, np.int64)

    def near(self, codes: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asker, word) one edit apart."""
        vectors = counted(codes)
        parity = parities(vectors)
        asker, leaf, _, _ = reached(vectors, up, down, self.tree, self.depth)
        sizes = self.starts[leaf + 1] - self.starts[leaf]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # so many leaves at a time that what they hold stays within COMPARED
        turn = (np.cumsum(sizes) * 8) // COMPARED
        for part in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(turn)) + 1):
            size = sizes[part]
            i = np.repeat(asker[part], size)
            j = self.order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.starts[leaf[part]], size)]
            close = np.flatnonzero(np.bitwise_count(parity[i] ^ self.parities[j]) <= 2)
            step = max(1, COMPARED // self.codes.shape[1])
            for k in range(0, len(close), step):
                a, b = i[close[k : k + step]], j[close[k : k + step]]
                same = one_edit(codes[a], self.codes[b])
                found.append((a[same], b[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def best_of(own: np.ndarray, other: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``own``: how many others, and the one of largest count (ties: the least)."""
    order = np.lexsort((other, -counts[other], own))
    rows, starts, sizes = np.unique(own[order], return_index=True, return_counts=True)
    return rows, sizes, other[order[starts]]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near): for words that have near ones; near is the struct (minus its n, word) of the most frequent, ties by code points."""
    spark = words.sparkSession
    sized = words.select("word", "n", F.char_length("word").alias("length"))
    sizes = {r["length"]: r["count"] for r in sized.groupBy("length").count().where(F.col("count") > CELL).collect()}
    sample: dict[int, list[str]] = defaultdict(list)
    # twice as many as needed have a hash below the bound, so that no task sends the driver as many as that
    bound = int(min(1.0, 2 * SAMPLE / max(1, sized.count())) * (1 << 64)) - (1 << 63) - 1
    for r in sized.select("word", "length", F.xxhash64("word").alias("turn")).where(F.col("turn") <= bound).orderBy("turn", "word").limit(SAMPLE).collect():
        sample[r["length"]].append(r["word"])
    trees = {}
    for length in {*sizes, *(x + 1 for x in sizes)}:
        depth = int(np.ceil(np.log2(max(sizes.get(length, 0), sizes.get(length - 1, 0)) / CELL)))
        if words_of := sample.get(length):
            trees[length] = (*fitted(counted(spelt(words_of)), depth)[:2], depth)
    single = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    shared = spark.sparkContext.broadcast(trees)  # a few numbers for every CELL words

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == length)))
                for start in range(0, len(part), 10_000):
                    yield from dealt(part.slice(start, 10_000), length)

    def dealt(part: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
        vectors = counted(spelt(part.column(0).to_pylist()))
        undecided, none = np.full(len(part), -1), np.full(len(part), NONE)
        for longer, asks, up, down in ((0, False, none, none), (0, True, undecided, undecided), (1, True, undecided, none)):
            *tree, depth = shared.value.get(length + longer, single)
            asker, leaf, up, down = reached(vectors, up, down, tuple(tree), depth)
            rows = part.take(pa.array(asker))
            columns = [np.full(len(asker), length + longer, np.int32), leaf.astype(np.int32), np.full(len(asker), asks), up.astype(np.int8), down.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), rows.column(0), rows.column(1)], ["length", "leaf", "asks", "up", "down", "word", "n"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, stored = None, None, ([], [])
        for batch in batches:
            keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:3]], axis=1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if key != (now := tuple(keys[start, :2].tolist())):
                    key, cell, stored = now, None, ([], [])
                part = batch.slice(start, stop - start)
                if not keys[start, 2]:
                    stored[0].extend(part.column(5).to_pylist())
                    stored[1].extend(part.column(6).to_pylist())
                elif stored[0]:
                    cell = cell or Cell(*stored)
                    for k in range(0, len(part), ASKERS):
                        yield from answers(cell, part.slice(k, ASKERS), key[0])

    def answers(cell: Cell, part: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
        names = np.array(part.column(5).to_pylist(), object)
        up, down, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4, 6))
        own = np.array([len(w) for w in names]) == length
        for which, shorter in ((np.flatnonzero(own), False), (np.flatnonzero(~own), True)):
            if not len(which):
                continue
            asker, word = cell.near(spelt(names[which].tolist()), up[which], down[which])
            asker = which[asker]
            rows, sizes, best = best_of(asker, word, cell.counts)
            yield told(names[rows].tolist(), sizes, cell.counts[best], [cell.words[i] for i in best.tolist()])
            if shorter:  # the stored word doesn't ask in turn: it has its answer here
                order = np.argsort(names)
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                rows, sizes, best = best_of(word, place[asker], n[order])
                yield told([cell.words[i] for i in rows.tolist()], sizes, n[order[best]], names[order[best]].tolist())

    def told(names: list[str], sizes: np.ndarray, n: np.ndarray, best: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes.astype(np.int64)), pa.array(-n), pa.array(best, pa.string())], ["word", "n_near", "minus_n", "near"])

    rows = mapped(sized, deal, "length int, leaf int, asks boolean, up byte, down byte, word string, n long")
    rows = rows.repartition("length", "leaf").sortWithinPartitions("length", "leaf", "asks", "word")
    found = mapped(rows, ask, "word string, n_near long, minus_n long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus_n", "near")).alias("near"))


def followed(links: DataFrame) -> DataFrame:
    """(word, root) from links (word, form): where following forms ends.

    Each round doubles the steps that are taken. A form is at least ``ratio`` times as frequent as its word, so
    chains are no longer than the logarithm of the largest count.
    """
    now = cut(links.select("word", F.col("form").alias("root"), F.lit(False).alias("ended")))
    while now.where("not ended").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("ended").alias("ended_there"))
        step = now.where("not ended").join(on, "root", "left")
        step = step.select("word", F.coalesce("further", "root").alias("root"), F.coalesce("ended_there", F.lit(True)).alias("ended"))
        now = cut(step.unionByName(now.where("ended")))
    return now.select("word", "root")


def spelling_groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n; distinct, not empty).

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its most frequent near word
    (ties: the least in code-point order), if that is at least ``ratio`` times as frequent; root is where forms lead to. Words
    without a near one stay, with n_near 0 and no form; a table without words gives an empty result. Other columns are ignored.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")))
    best = F.struct((-F.col("near.minus_n")).alias("n"), F.col("near.near").alias("word"))
    joined = words.join(near_words(words), "word", "left").withColumn("best", best)
    taken = F.col("best.n") >= ratio * F.col("n")
    joined = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, F.col("best.n")).alias("form_n")))
    roots = followed(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
