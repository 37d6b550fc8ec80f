"""The prefix trie of conversations, by ROLLUP over positional turn-id columns.

A turn's id is a digest of its role and text. A conversation is laid out in blocks of ``BLOCK`` turns, a row for
each block with one turn-id column for each place, and one ROLLUP over these columns, with grouping_id,
aggregates the prefixes of all lengths together. A longer conversation goes on in further blocks, which are
grouped by the node at which the block before ends. A node is named by its depth and the XOR of 128-bit hashes of
(place, turn id) along its path; such names add up in any order, so all blocks are rolled up in one job,
however long a conversation is.

What a node sums over its subtree comes from its members: each node belongs to its least member, and that
conversation's nodes are the end of its path. So the members' totals add up to the subtree's, but for what the
node's own conversation has above it. A second ROLLUP adds the totals, a running sum gives the rest.

No group is gathered. Running values along one conversation are taken in two levels, over chunks of places and
within them; the ids that end at one node are joined by ranges, and ranges stream through the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, mapped, written

#: Turn-id columns of a block.
BLOCK = 8
#: Places (or conversation ids) of 2**CHUNK_BITS neighbours are one chunk.
CHUNK_BITS = 12
#: Every FAMILY-th conversation is one that others begin with; they take fewer than HEADS of its turns.
FAMILY, HEADS = 20, 4
NODE = ("depth", "x1", "x2")


def numbered_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, chunk, turn, role, tid, words), (conv_id, chunk, earlier, total)): turns by id, and how many stand before each chunk."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # the role's length in front keeps (role, text) pairs apart
    tid = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turn = F.col("turn").cast("long")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), tid.alias("tid"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = written(rows.withColumn("chunk", F.coalesce(F.shiftright("turn", CHUNK_BITS), F.lit(-(1 << 62)))))
    counts = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("conv_id")
    earlier = F.coalesce(F.sum("n").over(over.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows, cut(counts.select("conv_id", "chunk", earlier.alias("earlier"), F.sum("n").over(over).alias("total")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, d, tid, words), (conv_id)): the turns of each rebuilt conversation from d = 1, and all conversations.

    Conversation c begins with the first crc32(c) % 4 turns of the conversation c - c % 20, and goes on with its own behind as many.
    """
    rows, chunks = numbered_turns(turns)
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    chunks = chunks.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % HEADS})
    sizes = chunks.where(F.col("conv_id") == F.col("base")).select("base", F.col("total").alias("base_total")).distinct()
    chunks = chunks.join(sizes, "base", "left").withColumn("g", F.least("h", F.coalesce("base_total", F.lit(0))))
    within = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "tid")
    numbered = rows.withColumn("k", F.row_number().over(within)).join(chunks, ["conv_id", "chunk"]).withColumn("place", F.col("earlier") + F.col("k"))
    own = numbered.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("g")).alias("d"), "tid", "words")
    convs = chunks.select("conv_id", "base", "g").distinct()
    heads = numbered.where((F.col("conv_id") == F.col("base")) & (F.col("place") < HEADS)).select("base", F.col("place").alias("d"), "tid", "words")
    taken = convs.where("g > 0").join(heads, "base").where("d <= g").select("conv_id", "d", "tid", "words")
    return own.unionByName(taken), convs.select("conv_id")


def mix(seed: int, place: Column, tid: Column) -> Column:
    return F.xxhash64(F.lit(seed), place.cast("long"), tid)


def before(rows: DataFrame, key: str, place: str, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds aggregates ('sum' or 'bit_xor') over the rows of the same key at lesser places; 0 where there are none.

    In two levels, chunks of places and the places of a chunk, so that no window holds all rows of a key.
    """
    of = {"sum": F.sum, "bit_xor": F.bit_xor}
    both = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    chunked = rows.withColumns({"_chunk": F.shiftright(F.col(place).cast("long"), CHUNK_BITS), **{f"_{n}": v for n, (v, _) in values.items()}})
    sums = chunked.groupBy(key, "_chunk").agg(*[of[how](f"_{n}").alias(f"_{n}") for n, (_, how) in values.items()])
    over = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    sums = sums.select(key, "_chunk", *[zero(of[how](f"_{n}").over(over(key).orderBy("_chunk"))).alias(f"_far_{n}") for n, (_, how) in values.items()])
    near = chunked.select(*rows.columns, "_chunk", *[zero(of[how](f"_{n}").over(over(key, "_chunk").orderBy(place))).alias(f"_near_{n}") for n, (_, how) in values.items()])
    return near.join(sums, [key, "_chunk"]).select(*[near[c] for c in rows.columns], *[both[how](F.col(f"_far_{n}"), F.col(f"_near_{n}")).alias(n) for n, (_, how) in values.items()])


def blocks_of(path: DataFrame) -> DataFrame:
    """(conv_id, block, t1.., x1, x2, n, k1, k2): turn-id columns of each block; k1 and k2 name the node where the block before ends."""
    at = path.withColumns({"block": F.floor((F.col("d") - 1) / BLOCK), "j": (F.col("d") - 1) % BLOCK})
    turn = F.struct("tid", "words")
    columns = [F.max(F.when(F.col("j") == k, turn)).alias(f"t{k + 1}") for k in range(BLOCK)]
    names = [F.bit_xor(mix(s, F.col("d"), F.col("tid"))).alias(f"x{s}") for s in (1, 2)]
    return before(at.groupBy("conv_id", "block").agg(*columns, *names, F.count(F.lit(1)).alias("n")), "conv_id", "block", {f"k{s}": (F.col(f"x{s}"), "bit_xor") for s in (1, 2)})


def rolled_up(blocks: DataFrame, *aggregates: str) -> DataFrame:
    """depth, x1, x2, p1, p2 (the parent's name), words of the last turn and the aggregates, for every prefix of ``blocks``."""
    turns = [f"t{k + 1}" for k in range(BLOCK)]
    found = blocks.sparkSession.sql(
        f"SELECT block, k1, k2, {', '.join(turns)}, CAST({BLOCK} - bit_count(grouping_id()) AS INT) AS j, {', '.join(aggregates)} FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP({', '.join(turns)})",
        blocks=blocks,
    )
    # the level above the first column is the block before, and a conversation that ends before a column has no node there
    last = F.try_element_at(F.array(*turns), F.col("j"))
    found = found.where((F.col("j") > 0) & last.isNotNull())
    name = lambda s, most: F.col(f"k{s}").bitwiseXOR(_xor([F.when(F.lit(k + 1) <= most, mix(s, F.col("block") * BLOCK + k + 1, F.col(t)["tid"])).otherwise(F.lit(0).cast("long")) for k, t in enumerate(turns)]))
    names = [name(s, F.col("j")).alias(f"x{s}") for s in (1, 2)] + [name(s, F.col("j") - 1).alias(f"p{s}") for s in (1, 2)]
    return found.select((F.col("block") * BLOCK + F.col("j")).cast("long").alias("depth"), *names, last["words"].alias("words"), *[a.rpartition(" ")[2] for a in aggregates])


def _xor(values: list[Column]) -> Column:
    out = values[0]
    for v in values[1:]:
        out = out.bitwiseXOR(v)
    return out


def ends_of(ends: DataFrame) -> DataFrame:
    """The node and ends_sha256 from rows (depth, x1, x2, conv_id): a digest of the ids in ascending order."""
    ranges = ends.groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("range"))
    joined = ranges.agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))  # 4096 ids at most
    dealt = joined.repartition(*NODE).sortWithinPartitions(*NODE, "range")
    schema = "depth long, x1 long, x2 long, ends_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ids.encode())
            if done:
                yield out()
                done.clear()
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield out()

    return mapped(dealt, run, schema)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text. Turns go by number (null first), then by role and a digest of role and
    text; equal rows stay and count each. Null roles and texts are empty ones, of which a turn may consist. Rows
    without a conv_id belong to no conversation and are left out. An empty table has no node, not even the root.
    Other columns are ignored.
    """
    path, convs = rebuilt(turns)
    convs, blocks = cut(convs), written(blocks_of(path))
    first, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()

    nodes = written(rolled_up(blocks, "count(*) AS n_convs", "min(conv_id) AS conv_id"))
    kids = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = nodes.join(kids, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = written(valued.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))

    owned = valued.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    summed = rolled_up(blocks.join(owned, "conv_id", "left"), "sum(coalesce(saved, 0)) AS members_saved", "sum(coalesce(leaves, 0)) AS n_leaves").drop("words", "p1", "p2")
    above = before(valued, "conv_id", "depth", {"saved_above": (F.col("saved"), "sum"), "n_above": (F.lit(1).cast("long"), "sum")})

    # a conversation's first node alone has a parent that isn't its own
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    inner = above.where("n_above > 0 or depth = 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first)).otherwise(F.col("conv_id")).cast("long"))
    topmost = above.where("n_above = 0 and depth > 1").join(parents, ["depth", "p1", "p2"])
    inside = inner.unionByName(topmost).select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "saved_above").join(summed, list(NODE))
    inside = inside.withColumn("saved_tokens", F.col("members_saved") - F.col("saved_above")).drop("members_saved", "saved_above")

    at_root = valued.agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    null = F.lit(None).cast("long")
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]
    root = at_root.select(*zero, F.lit(first).cast("long").alias("conv_id"), null.alias("parent_conv_id"), F.lit(total).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens").where(F.lit(total) > 0)

    whole = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), *[F.bit_xor(f"x{s}").alias(f"x{s}") for s in (1, 2)])
    ends = convs.join(whole, "conv_id", "left").na.fill(0, list(NODE))
    found = inside.unionByName(root).join(ends_of(ends), list(NODE), "left")
    none = F.lit(hashlib.sha256().hexdigest())
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return found.select(*long, F.coalesce("ends_sha256", none).alias("ends_sha256"))
