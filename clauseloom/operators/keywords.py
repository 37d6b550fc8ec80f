"""The most frequent words of each segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.words import STOP_WORDS, key_words, top_words
from clauseloom.sources.storage import written

TOP = 5


def with_keywords(segments: DataFrame, top_n: int = TOP, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """Adds keywords: up to ``top_n`` words of ``text``, the most frequent first, ties by first occurrence.

    A segment's words are sorted and counted inside its row, so words are never rows of their own, and nothing is shuffled.
    """
    return segments.withColumn("keywords", top_words(key_words("text", stop_words), top_n))


#: Neighbouring lines of a segment that are cut into words together, and shares that its words are ranked in. A segment of
#: no more lines, nor characters, is counted inside its row.
LINES, SHARES, CHARS = 256, 64, 1 << 20


def with_keywords_in_chunks(segments: DataFrame, top_n: int = TOP, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """As :func:`with_keywords`, for segments of any size: the lines of a large one are dealt out and no row or window holds its words.

    Its words are counted by (segment, word). The first ``top_n`` are those of the first ``top_n`` of each share by the word's hash.
    """
    keys = ["doc_id", "seg_no"]
    split = F.split("text", "\n", -1)
    few = (F.size(split) <= LINES) & (F.char_length("text") <= CHARS)
    marked = written(segments.select(*keys, F.struct(*segments.columns).alias("own"), few.alias("few")))
    own = marked.where("few").select("own.*")
    large = marked.where("not few").select("own.*")
    lines = large.select(*keys, (F.size(split) - 1).alias("last"), F.posexplode(split).alias("line_no", "line"))
    lines = lines.withColumn("chunk", F.floor(F.col("line_no") / LINES)).repartition(*keys, "chunk")
    words = key_words("line", stop_words, F.col("line_no") == F.col("last"))
    rows = lines.select(*keys, "line_no", F.posexplode(words).alias("pos", "word"))
    counts = rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_no", "pos")).alias("place"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(F.desc("n"), "place"))
    some = counts.withColumn("share", F.pmod(F.xxhash64("word"), F.lit(SHARES))).withColumn("rank", rank("share")).where(F.col("rank") <= top_n)
    top = some.withColumn("rank", rank()).where(F.col("rank") <= top_n)
    found = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "word")))["word"].alias("keywords"))
    found = large.join(found, keys, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return with_keywords(own, top_n, stop_words).unionByName(found)
