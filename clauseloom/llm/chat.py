"""Chat formatting by columnar byte assembly.

A turn is written ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings inside texts get a backslash
behind their first character, one more than they had, so that texts of any content can be read back.
For all turns of a batch, segment lengths and cumulative offsets are computed in numpy; headers, texts
and footers are then scattered into one buffer, which becomes the values of an Arrow string column.
Long texts are copied as they are, so that only short ones have an index for each byte.

Rows of a conversation are brought together and sorted by turn; a task streams through them. A
conversation is one output row, unless it is longer than ``max_turns`` rows or ``max_bytes``: then it goes
on in further parts, so that no task ever holds a whole huge conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_HEADS = sorted({c[0] for c in CONTROL})
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
ESCAPE = rf"([{re.escape(''.join(_HEADS))}])(\\*)({_TAILS})"
UNESCAPE = re.compile(rf"([{re.escape(''.join(_HEADS))}])\\(\\*)({_TAILS})")
TURN = re.compile(rf"{re.escape(START)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(END)}\n", re.S)

PARTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.LongType(), False),
        T.StructField("n_turns", T.LongType(), False),
        T.StructField("formatted", T.StringType(), False),
        T.StructField("loss_starts", T.ArrayType(T.LongType(), False), False),
        T.StructField("loss_ends", T.ArrayType(T.LongType(), False), False),
    ]
)


#: Texts of more bytes are copied as a whole; of shorter ones so many bytes are scattered at once.
LONG, AT_ONCE = 1 << 12, 1 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text) if "\\" in text else text


def role_name(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def role_read(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name) if "\\" in name else name


def scatter(out: np.ndarray, into: np.ndarray, source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copies ``sizes`` bytes from each of ``starts`` to each of ``into``: short runs by index, at most ``AT_ONCE`` bytes of them together."""
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[into[i] : into[i] + sizes[i]] = source[starts[i] : starts[i] + sizes[i]]
    short = np.flatnonzero(sizes <= LONG)
    turn = np.cumsum(sizes[short]) // AT_ONCE
    for some in np.split(short, np.flatnonzero(np.diff(turn)) + 1):
        size = sizes[some]
        shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(into[some], size) + shift] = source[np.repeat(starts[some], size) + shift]


def assemble(roles: pa.Array, texts: pa.Array, breaks: np.ndarray, learned: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted text of each run of turns (run ``i`` ends before turn ``breaks[i]``), and its loss spans in code points.

    ``roles`` is dictionary-encoded, without nulls; the loss covers the texts of the role ``learned``.
    """
    names = roles.dictionary.to_pylist()
    headers = [f"{START}{role_name(r)}\n".encode() for r in names] + [f"{END}\n".encode()]
    header_at = np.concatenate([[0], np.cumsum([len(h) for h in headers])])
    pool = np.frombuffer(b"".join(headers), np.uint8)
    texts = escape(texts).cast(pa.large_string())
    text_at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    content = np.frombuffer(texts.buffers()[2] or b"", np.uint8)

    n, which = len(texts), roles.indices.to_numpy(zero_copy_only=False)
    lengths = np.empty((n, 3), np.int64)  # header, text, footer of each turn
    lengths[:, 0] = np.diff(header_at)[which]
    lengths[:, 1] = np.diff(text_at)
    lengths[:, 2] = len(headers[-1])
    at = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(at[-1], np.uint8)
    for column, starts, source in ((0, header_at[which], pool), (1, text_at[:-1], content), (2, np.full(n, header_at[len(names)]), pool)):
        scatter(out, at[column:-1:3], source, starts, lengths[:, column])
    shown = np.array([len(h.decode()) for h in headers], np.int64)
    inside = np.stack([shown[which], pc.utf8_length(texts).to_numpy(zero_copy_only=False), np.full(n, shown[-1])], axis=1)
    points = np.concatenate([[0], np.cumsum(inside)])  # code points before each segment
    first = np.concatenate([[0], breaks[:-1]]).astype(np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(breaks), pa.py_buffer(np.concatenate([[0], at[3 * breaks]]).astype(np.int64)), pa.py_buffer(out))
    wanted = np.flatnonzero(which == names.index(learned)) if learned in names else np.zeros(0, np.int64)
    run = np.searchsorted(breaks, wanted, side="right")
    origin = points[3 * first[run]]
    edges = pa.array(np.searchsorted(run, np.arange(len(breaks) + 1)).astype(np.int32))
    spans = [pa.ListArray.from_arrays(edges, pa.array(points[3 * wanted + k] - origin)) for k in (1, 2)]
    return formatted.cast(pa.string()), *spans


def format_chats(turns: DataFrame, learned: str = "assistant", max_turns: int = 4096, max_bytes: int = 1 << 24) -> DataFrame:
    """Formats (conv_id, turn, role, text): rows of ``PARTS``, a conversation's parts in a row and in order.

    ``loss_starts`` and ``loss_ends`` mark, in code points of ``formatted``, the texts to learn from.
    Null texts and roles count as empty; rows of one turn number go by role and text, repeats stay; rows
    without a conv_id make one conversation without an id; null turns come first. Other columns are ignored.
    A task holds ``max_bytes`` of text and one turn, beside the batch that Spark hands it.
    """
    whole = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = whole.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def flush(table: pa.Table, part: int) -> pa.RecordBatch:
        """The rows are whole conversations, but for the first (``part`` parts of it are out) and the last."""
        ids = table.column("conv_id").combine_chunks()
        keys, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        breaks = np.concatenate([np.flatnonzero((np.diff(keys) != 0) | (np.diff(null.astype(int)) != 0)) + 1, [len(ids)]])
        roles = table.column("role").combine_chunks().dictionary_encode()
        formatted, starts, ends = assemble(roles, table.column("text").combine_chunks(), breaks, learned)
        parts = np.zeros(len(breaks), np.int64)
        parts[0] = part
        return pa.RecordBatch.from_arrays([ids.take(pa.array(breaks - 1)), pa.array(parts), pa.array(np.diff(np.concatenate([[0], breaks]))), formatted, starts, ends], PARTS.names)

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        """Runs of at most ``max_turns`` rows and ``max_bytes`` of text; a longer turn has one of its own."""
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + max_bytes, side="right"))
            stop = min(max(stop, start + 1), start + max_turns)
            yield start, stop
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, 0  # the rows of the last conversation that aren't out yet; how many parts of it are
        out_of: list = []  # the conversation whose parts are out
        for batch in batches:
            for start, stop in slices(batch):
                some = pa.Table.from_batches([batch.slice(start, stop - start)]).select(["conv_id", "role", "text"])
                some = pa.concat_tables([held, some]).combine_chunks() if held is not None else some
                ids = some.column("conv_id").to_pylist()
                if out_of != ids[:1]:
                    part = 0
                last = len(ids) - 1
                while last and ids[last - 1] == ids[-1]:
                    last -= 1
                if last:
                    yield flush(some.slice(0, last), part)
                    part = 0
                held = some.slice(last)
                if len(held) >= max_turns or pc.sum(pc.binary_length(held.column("text"))).as_py() >= max_bytes:
                    yield flush(held, part)
                    held, part, out_of = held.slice(len(held)), part + 1, ids[-1:]
        if held is not None and len(held):
            yield flush(held, part)

    return mapped(dealt, run, PARTS)


def read_back(parts: DataFrame, learned: str = "assistant") -> DataFrame:
    """Digests of each conversation, read from the rows of :func:`format_chats` (same partitions, same order)."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        for batch in batches:
            done = []
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(len(batch))):
                if now is None or row["part"] == 0:
                    if now is not None:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, turn in (m.groups() for m in TURN.finditer(text)):
                    now[1] += 1
                    now[2].update(f"{role_read(role)}\n{unescape(turn)}\n".encode())
                for i, j in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    learnt = unescape(text[i:j])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode())
                now[5] += len(text)
            if done:
                yield result(done)
        if now is not None:
            yield result([now])

    def result(rows: list) -> pa.RecordBatch:
        plain = [[x.hexdigest() if hasattr(x, "hexdigest") else x for x in row] for row in rows]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*plain, strict=True), types, strict=True)], names)

    return mapped(parts, run, schema)
