"""Byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern and each match is merged on its own. The merge loop keeps
one bucket of linked-list positions per merge rank and a two-level bitmap of the ranks whose bucket
isn't empty; find-first-set gives the next rank, and positions whose pair has changed meanwhile are
skipped. So a match of n bytes takes O(n log n) steps however long it is. All matches of a batch that
a worker doesn't know yet share one linked list and one queue, so that a bucket's positions are merged
at once with numpy.

Texts are cut at lone spaces before the pattern runs: with a pattern of the usual byte-level kind no
match reaches over such a cut. Pieces repeat a lot, so each task keeps a bounded table of encoded
pieces; the table changes the speed only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

WORD_BITS = 256
#: Encoded pieces and pair ranks that a task remembers at most, before it starts anew.
REMEMBERED = 150_000
#: So few matches are merged one by one.
FEW = 50
#: Characters of text that are encoded at once, but for one text at least.
AT_ONCE = 3_000_000


class BytePairEncoder:
    """``ranks``: token bytes to id, where ids are merge ranks too."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.vocabulary: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        self.size = len(self.vocabulary)
        self.pairs: dict[int, int] = {}
        self.matches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.tokens = pa.array(self.vocabulary, pa.large_binary())
        self.byte_ids = np.array(self.of_byte, np.int64)

    @cached_property
    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all pairs that merge, sorted, and their ranks."""
        ranks = self.ranks
        known = sorted((ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        keys, ids = np.array(known, np.int64).reshape(-1, 2).T.copy()
        return keys, ids

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        table, ids = self.pair_table
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, ids[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each of many matches."""
        if len(pieces) < FEW and sum(map(len, pieces)) < 20 * FEW:
            return [np.array(self.merge(p), "<i4").tobytes() for p in pieces]
        lengths = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts + lengths - 1] = -1
        before[starts] = -1
        rank_at, alive = np.full(n, -1, np.int64), np.ones(n, bool)
        inner = np.flatnonzero(after >= 0)
        rank_at[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        words: dict[int, int] = {}
        top = 0
        anew: list[np.ndarray] = []  # positions in matches where a merge made a pair of lower rank

        def push(positions: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            firsts = [0, *cuts.tolist()]
            for rank, i, j in zip(ranks[firsts].tolist(), firsts, [*firsts[1:], len(ranks)], strict=True):
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [positions[i:j]]
                    w, bit = divmod(rank, WORD_BITS)
                    words[w] = words.get(w, 0) | 1 << bit
                    top |= 1 << w
                else:
                    bucket.append(positions[i:j])

        inner = np.flatnonzero(rank_at >= 0)
        if len(inner):
            push(inner, rank_at[inner])
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w * WORD_BITS + (word & -word).bit_length() - 1
            words[w] = word & (word - 1)
            if not words[w]:
                top &= top - 1
            bucket = buckets.pop(rank)
            at = np.unique(np.concatenate(bucket))
            at = at[rank_at[at] == rank]  # the others are stale
            if not len(at):
                continue
            right = after[at]
            if (rank_at[right] == rank).any():  # overlaps: the left one of two merges
                free, chosen = -1, []
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != free:
                        chosen.append(p)
                        free = q
                at = np.array(chosen)
                right = after[at]
            end = after[right]
            ids[at] = rank
            rank_at[right] = -1
            alive[right] = False
            after[at] = end
            more = end >= 0
            before[end[more]] = at[more]
            rank_at[at] = -1
            left = before[at]
            left = left[left >= 0]
            changed = np.concatenate([at[more], left])
            if len(changed):
                ranks = self.pair_ranks(ids[changed], ids[after[changed]])
                rank_at[changed] = ranks
                if (low := (ranks >= 0) & (ranks < rank)).any():
                    anew.append(changed[low])
                if (real := ranks >= 0).any():
                    push(changed[real], ranks[real])
        packed = ids[alive].astype("<i4").tobytes()
        counts = np.concatenate([[0], np.cumsum(alive)])
        ends = 4 * counts[starts + lengths]
        begins = 4 * counts[starts]
        out = [packed[i:j] for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]
        if anew:  # one bucket was merged at once where the order within a match mattered
            for k in np.unique(np.searchsorted(starts, np.concatenate(anew), side="right") - 1).tolist():
                out[k] = np.array(self.merge(pieces[k]), "<i4").tobytes()
        return out

    def pair_rank(self, left: int, right: int) -> int:
        """Rank of the merged pair; -1 if the pair doesn't merge."""
        key = left * self.size + right
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.vocabulary[left] + self.vocabulary[right], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        of_byte, pair_rank = self.of_byte, self.pair_rank
        ids = [of_byte[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [-1] * n  # of the pair that starts there
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0

        def push(position: int, rank: int) -> None:
            nonlocal top
            rank_at[position] = rank
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket is None:
                    buckets[rank] = [position]
                    w, bit = divmod(rank, WORD_BITS)
                    words[w] = words.get(w, 0) | 1 << bit
                    top |= 1 << w
                else:
                    heappush(bucket, position)

        for i in range(n - 1):
            push(i, pair_rank(ids[i], ids[i + 1]))
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            rank = w * WORD_BITS + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            position = heappop(bucket)  # leftmost first
            if not bucket:
                del buckets[rank]
                word &= word - 1
                words[w] = word
                if not word:
                    top &= top - 1
            if rank_at[position] != rank:
                continue  # stale
            right = after[position]
            end = after[right]
            ids[position] = rank
            rank_at[right] = -1
            after[position] = end
            if end < n:
                before[end] = position
                push(position, pair_rank(rank, ids[end]))
            else:
                rank_at[position] = -1
            left = before[position]
            if left >= 0:
                push(left, pair_rank(ids[left], rank))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def forget(self) -> None:
        """Empties the tables of pieces and pairs; a worker that is used again keeps the vocabulary alone."""
        self.pieces.clear()
        self.matches.clear()
        self.pairs.clear()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each whole text as packed little-endian 32-bit integers."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        if len(self.matches) > REMEMBERED:
            self.matches.clear()
        known, new = self.pieces, {}
        found = [[known.get(p) or new.setdefault(p, p) for p in lone_space_pieces(t)] if t else [] for t in texts]
        split = {p: self.pattern.findall(p) for p in new}
        unknown = list({m for ms in split.values() for m in ms if m not in self.matches})
        encoded = [m.encode("utf-8", "replace") for m in unknown]
        rest = []
        for m, piece in zip(unknown, encoded, strict=True):
            rank = self.ranks.get(piece)
            if rank is None:
                rest.append((m, piece))
            else:
                self.matches[m] = rank.to_bytes(4, "little")
        self.matches.update(zip([m for m, _ in rest], self.merge_all([p for _, p in rest]), strict=True))
        ids = self.matches
        made = {p: b"".join([ids[m] for m in ms]) for p, ms in split.items()}
        out = [b"".join([p if type(p) is bytes else made[p] for p in f]) for f in found]
        known.update((p, x) for p, x in made.items() if len(p) < 64)
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids; null for null."""
        flat = ids.flatten()
        taken = self.tokens.take(flat)
        starts = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts[ends]), taken.buffers()[2]])
        return pa.compute.if_else(ids.is_valid(), whole, pa.scalar(None, pa.large_binary())) if ids.null_count else whole


BESIDE = re.compile(r"\s |^ | \s| \Z|\x00")
CUT = re.compile(r"(?<=\S)(?= \S)")


def lone_space_pieces(text: str) -> list[str]:
    """The text in pieces, cut before each space that stands alone between two other characters.

    Each piece but the first starts with its space.
    """
    if BESIDE.search(text):
        return CUT.split(text)
    return text.replace(" ", "\0 ").split("\0")


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> BytePairEncoder:
    with open(path, "rb") as file:  # a vocabulary that is installed on every machine, not an input
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return BytePairEncoder(ranks, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``ids`` (array of int) for each row; ``path`` is the rank file on every machine.

    Null and empty texts give an empty list. Rows are independent: repeats stay, other columns are
    ignored, an empty table gives an empty result.
    """
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        try:
            yield from encoded(encoder, batches)
        finally:
            encoder.forget()

    def encoded(encoder: BytePairEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(len(keep))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = (np.cumsum(sizes) - sizes) // AT_ONCE
            for start, size in zip(*np.unique(turn, return_index=True, return_counts=True)[1:], strict=True):
                part = batch.slice(int(start), int(size))
                ids = encoder.encode(part.column(len(keep)).to_pylist())
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(pa.array(ends), values)], [*keep, "ids"])

    return mapped(docs.select(*keep, F.col(text)), run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``keep`` and ``decoded`` (binary): the bytes of the column ``ids``; null for null, empty for empty."""
    fields = [encoded.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                texts = encoder.decode(part.column(len(keep))).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], [*keep, "decoded"])

    return mapped(encoded.select(*keep, F.col("ids").alias("_ids")), run, schema)
