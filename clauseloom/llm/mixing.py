"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The mix is a sequence of slots. Slot ``i`` has the golden-ratio point ``frac((i + 1) * phi)``; the
point falls into one source's share of the cumulative target weights, so that every stretch of the
schedule holds the sources nearly in proportion. The ``k``-th slot of a source takes that source's
``k``-th block. Blocks have one length over all sources; they are cut from a source's shuffled documents
laid end to end (and again from the start, up to ``max_epochs`` times). A source's last block ends with
its target. What a document gives to the mix are its words in blocks that have a slot.

Only DataFrame functions are used. Running totals over a source and ranks over the schedule are taken
in two levels (within hash buckets or slot chunks, and over their totals), so no window partition
holds a whole source or the whole schedule. Rows that are equal in id and size are counted before they
are ordered and told apart behind it, so no window holds the rows of one id either, only its sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, whole

#: frac(phi) and frac(2**20 * phi): a slot number is split in two parts so that doubles stay exact enough.
GOLDEN = 0.6180339887498949
GOLDEN_20 = 0.607787409740351


def words(text: str = "text") -> Column:
    """Number of words, as long; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """Adds ``src``, ``weight``, ``target`` to rows (source, source_size), one per source.

    Sources in code-point order, null last, take the weights in turn. A target stops at
    ``max_epochs * source_size``; what is over goes to the others by weight. Ordered by cap/weight
    the capped sources come first, so one pass of running sums finds the level. The windows hold one
    row per source, never documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("src", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src") % len(weights) + 1).cast("int"))
    listed = listed.withColumns({"weight": weight, "cap": (F.col("source_size") * max_epochs).cast("double")})
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    listed = listed.withColumns({"level": level})
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(Window.partitionBy(F.lit(0)))
    target = F.when(open_level.isNull(), F.col("cap")).otherwise(F.least("cap", open_level["level"] * F.col("weight")))
    return listed.withColumn("target", target).select("source", "src", "source_size", "weight", "target")


def slots(mixed: DataFrame, n_slots: int, cells: int = 4096, chunk_bits: int = 16) -> DataFrame:
    """(slot, src, block): the schedule; ``block`` is the slot's rank within its source.

    ``mixed`` has (src, target, n_blocks). Points beyond a source's blocks are passed over; the few blocks that
    the first ``n_slots`` points leave out (no more than the sequence's discrepancy, which grows with the
    logarithm of its length) stand behind them.
    """
    spark = mixed.sparkSession
    ahead = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy(F.lit(0)))
    shares = mixed.where("target > 0").withColumn("high", F.sum("target").over(ahead) / total)
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0.0)))
    last = F.max("src").over(Window.partitionBy(F.lit(0)))
    shares = shares.withColumn("high", F.when(F.col("src") == last, F.lit(2.0)).otherwise(F.col("high")))
    # each share is listed under the cells of [0, 1) that it meets, so that points find it by an equi-join
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1)).cast("long")
    shares = shares.select("src", "n_blocks", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    part = lambda c, f: F.col(c) * F.lit(f)
    points = spark.range(n_slots).withColumns({"hi": F.shiftright("id", 20), "lo": (F.col("id") + 1) - F.shiftleft(F.shiftright("id", 20), 20)})
    points = points.withColumn("point", F.pmod(part("hi", GOLDEN_20) + part("lo", GOLDEN), F.lit(1.0)))
    points = points.select(F.col("id").alias("slot"), "point", F.least(F.floor(F.col("point") * cells), F.lit(cells - 1)).cast("long").alias("cell"))
    hit = points.join(shares, "cell").where("low <= point and point < high").select("slot", "src", "n_blocks")
    hit = hit.withColumn("chunk", F.shiftright("slot", chunk_bits))
    counts = hit.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("src", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("earlier"))
    rank = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("rank", rank).join(before, ["src", "chunk"]).withColumn("block", (F.col("earlier") + F.col("rank")).cast("long"))
    placed = ranked.where("block < n_blocks").select("slot", "src", "block")
    short = mixed.join(counts.groupBy("src").agg(F.sum("n").alias("n")), "src", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < n_blocks")
    late = short.select("src", F.explode(F.sequence("n", F.col("n_blocks") - 1)).alias("block"))
    slot = F.row_number().over(Window.orderBy("block", "src")) - 1 + n_slots  # of the few blocks left out
    return placed.unionByName(late.select(slot.cast("long").alias("slot"), "src", F.col("block").cast("long").alias("block")))


def turn_of(ids: list[Column], seed: int) -> Column:
    """Where a row stands in the shuffled order of its source: 32 hexadecimal digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def told_apart(counted: DataFrame, n: str, at_once: int = 4096) -> DataFrame:
    """Each row ``n`` times, with ``copy`` from 0: in runs of ``at_once``, which are dealt out anew where there are several."""
    few = counted.where(F.col(n) <= at_once).withColumn("first_copy", F.lit(0).cast("long"))
    many = counted.where(F.col(n) > at_once).withColumn("first_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(at_once).cast("long"))))
    runs = few.unionByName(many.repartition(*counted.columns, "first_copy"))
    last = F.least(F.col(n), F.col("first_copy") + at_once) - 1
    return runs.withColumn("copy", F.explode(F.sequence("first_copy", last))).drop("first_copy", n)


def schedule(
    docs: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    size: Column | None = None,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    share: float = 1.0,
    max_epochs: int = 3,
    block_words: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """The mix of ``docs`` (text, source and the columns ``keep``), one row per piece of a document.

    ``size`` stands for the number of words of the text, where that is known.

    Returns ``keep``, row_id (struct; names the input row), source, size, source_size, target, and for
    a piece: slot, block, epoch, from_word, n_words. Pieces without a slot, and the one row of a document that
    isn't reached, have no slot and 0 words.

    Null text has size 0, null source is a source of its own, repeated rows and ids stay separate rows
    and count each. Documents without words and sources without words take nothing. An empty table
    gives an empty result. Other columns are ignored. Results depend on ids, sizes and sources alone.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("src_key")
    ids = [F.col(c) for c in keep]
    sized = docs.select(*ids, "source", key, (words() if size is None else size).alias("size"), turn_of(ids, seed).alias("turn"))
    # buckets go by the first digits, so that their order is that of the turns
    sized = sized.withColumn("bucket", F.conv(F.substring("turn", 1, 3), 16, 10).cast("int"))
    sized = cut(sized.groupBy("src_key", "bucket", "turn", *keep, "source", "size").agg(F.count(F.lit(1)).alias("n_equal")))
    sums = sized.groupBy("src_key", "bucket").agg(F.sum(F.col("size") * F.col("n_equal")).alias("bucket_size"), F.first("source").alias("source"))
    mixed = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    mixed = mixed.withColumn("line", F.round("target").cast("long"))
    mixed = cut(mixed.withColumn("n_blocks", F.ceil(F.col("line") / block_words).cast("long")))
    n = mixed.agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    order = slots(mixed.select("src", "target", "n_blocks"), n)

    over = Window.partitionBy("src_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src_key", "bucket", F.coalesce(F.sum("bucket_size").over(over), F.lit(0)).alias("bucket_at"))
    within = Window.partitionBy("src_key", "bucket").orderBy("turn", *ids, "size")
    earlier = lambda c: F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumns({"rows_at": earlier("n_equal"), "at": earlier(F.col("size") * F.col("n_equal"))})
    placed = told_apart(placed, "n_equal").withColumns({"row_no": F.col("rows_at") + F.col("copy") + 1, "at": F.col("at") + F.col("copy") * F.col("size")})
    placed = placed.join(sums, ["src_key", "bucket"]).withColumn("at", F.col("at") + F.col("bucket_at"))
    line = mixed.withColumn("src_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source")
    placed = placed.join(line, "src_key")
    block = lambda at: ((at - at % block_words) / block_words).cast("long")

    def pieces(epoch: Column) -> Column:
        start = epoch * F.col("source_size") + F.col("at")
        stop = F.least(start + F.col("size"), F.col("line"))
        piece = lambda k: F.struct(k.alias("block"), epoch.alias("epoch"), (F.greatest(start, k * block_words) - start).alias("from_word"), (F.least(stop, (k + 1) * block_words) - F.greatest(start, k * block_words)).alias("n_words"))
        return F.when((stop > start) & (F.col("size") > 0), F.transform(F.sequence(block(start), block(stop - 1)), piece))

    empty = F.array().cast("array<struct<block:bigint,epoch:bigint,from_word:bigint,n_words:bigint>>")
    cutting = F.flatten(F.array(*[F.coalesce(pieces(F.lit(e).cast("long")), empty) for e in range(max_epochs)]))
    row = F.struct("src", "bucket", "row_no").alias("row_id")
    cut_up = placed.select(*keep, row, "source", "src", "size", "source_size", "target", F.inline_outer(cutting))
    out = cut_up.join(order, ["src", "block"], "left")
    n_words = F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_words")
    return out.select(*keep, "row_id", "source", "size", "source_size", "target", "slot", "block", "epoch", "from_word", n_words)


def taken(mix: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row of :func:`schedule`, with the words that the mix takes, repeats counted."""
    return mix.groupBy(*keep, "row_id", "source", "size", "source_size", "target").agg(F.sum("n_words").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, name: str | None = None, **options: object) -> DataFrame:
    """The documents of the mix in the schedule's order, with the columns of ``docs``: a row for each time one is taken.

    A document stands at the slot of its first word; ``name`` adds the slot as a column. Each partition
    holds one stretch of the schedule, in order. A document at the end of its source's line is cut behind
    the last word taken (``n_chars``, where the table has it, is set anew); all others keep their whole
    texts. Repeated rows count each; documents that the mix takes nothing of, as those without words, have
    no row; an empty table gives an empty result.
    """
    key = ["_key", "_key2"]
    named = docs.withColumns({"_key": F.xxhash64("doc_id", "text", "source"), "_key2": F.xxhash64(F.lit(1), "source", "text", "doc_id")})
    mix = schedule(named.select(*key, "source", "text"), keep=tuple(key), **options)
    times = mix.where("n_words > 0").groupBy(*key, "row_id", "size", "epoch").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("slot"))
    times = times.groupBy(*key, "row_id").agg(F.collect_list(F.struct(F.col("slot").alias("_slot"), F.when(F.col("taken") < F.col("size"), F.col("taken")).alias("_cut"))).alias("_times"))  # max_epochs entries at most
    row = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("_row")
    times = cut(times.select(*key, row("row_id"), "_times"))
    n_slots = times.select(F.max(F.array_max("_times._slot"))).first()[0]
    # the rank needs the rows of a key together and in order, as the join does
    joined = named.select("*", row("_key")).join(times, [*key, "_row"]).select("*", F.inline("_times"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.coalesce("_cut", F.lit(0)).cast("int")), "")
    out = joined.withColumn("text", F.when(F.col("_cut").isNotNull(), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("_slot") * parts / F.lit((n_slots or 0) + 1)).cast("int")
    out = out.repartitionById(parts, stretch).sortWithinPartitions("_slot", *key)
    return out.select(*docs.columns, *([F.col("_slot").alias(name)] if name else []))
