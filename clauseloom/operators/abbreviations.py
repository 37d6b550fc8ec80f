"""Sentence ends learned from a corpus, after Kiss & Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006).

A type is an abbreviation if it has its final period more surely than chance gives: the log-likelihood ratio of the two
rates, scaled by the type's length, its inner periods and how often it stands without the final one. Behind an abbreviation a
sentence still ends where the next word's spelling says so: it is capital there, is written small elsewhere, and is never
capital inside a sentence.

Counts are one aggregation by type over all tokens. Types are joined to the tokens that ask for them; no list of them
is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.sentences import BOUNDARY, INITIAL, MARK, NUMBER
from clauseloom.functions.text import WS, replace, strip

# Fixed values of the method: the rate of final periods that abbreviations have, and the least score of one.
RATE, LEAST_SCORE = 0.99, 0.3
#: What may stand around a token: quotes and brackets, and marks behind it.
BEFORE, BEHIND = "\"'“”‘’([{", "\"'“”‘’)]},;:!?"
TYPE = r"^\p{L}+(?:\.\p{L}+)*\z"
#: Tokens behind which a word may be capital for another reason than its own spelling.
ENDS = r"[.?!:;][\"'”’)\]}]*\z"


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(text, rf"[{WS}]+", -1), lambda t: t != "")


def bare(token: Column) -> Column:
    return F.rtrim(F.ltrim(token, F.lit(BEFORE)), F.lit(BEHIND))


def has_period(core: Column) -> Column:
    """Whether a token, without what stands around it, ends with one period."""
    return core.endswith(".") & ~core.endswith("..")


def type_of(core: Column) -> Column:
    """The lower-cased token without its final period; null if it isn't letters with single periods inside."""
    word = F.lower(F.when(has_period(core), F.substring(core, F.lit(1), F.char_length(core) - 1)).otherwise(core))
    return F.when(word.rlike(TYPE), word)


def type_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(type, with_period, without_period, small, capital_inside) for each type of all texts.

    ``small`` counts its tokens with a small first letter, ``capital_inside`` those with a capital one that aren't a text's first
    token or behind one that may end a sentence. Null texts have no tokens.
    """
    listed = docs.select(tokens(F.coalesce(F.col(text), F.lit(""))).alias("ts"))
    pairs = F.transform("ts", lambda t, i: F.struct(t.alias("token"), F.when(i > 0, F.try_element_at(F.col("ts"), i)).alias("before")))
    rows = listed.select(F.explode(pairs).alias("at")).select(bare(F.col("at.token")).alias("core"), F.coalesce(~F.col("at.before").rlike(ENDS), F.lit(False)).alias("inside"))
    # the forms of a token are told apart once, however often it is there
    rows = rows.groupBy("core", "inside").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select(type_of(F.col("core")).alias("type"), has_period(F.col("core")).alias("ends"), F.substring("core", 1, 1).alias("letter"), "inside", "n")
    capital = F.col("letter").rlike(r"\p{IsUppercase}") & F.col("inside")
    count = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    # tokens that are no type count as well: they are in the corpus' rate of final periods
    return rows.groupBy("type").agg(count(F.col("ends"), "with_period"), count(~F.col("ends"), "without_period"), count(F.col("letter").rlike(r"\p{IsLowercase}"), "small"), count(capital, "capital_inside"))


def judged_types(counts: DataFrame) -> DataFrame:
    """Types of :func:`type_counts` with ``abbreviation``: whether the score reaches ``LEAST_SCORE``."""
    total = counts.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without_period")).alias("n")).first()
    periods, n = total["periods"] or 0, total["n"] or 0
    if not 0 < periods < n:
        return counts.where("type is not null").withColumn("abbreviation", F.lit(False))
    p, k, rest = F.lit(periods / n), F.col("with_period"), F.col("without_period")
    by_chance = k * F.log(p) + rest * F.log(1 - p)
    as_one = k * F.log(F.lit(RATE)) + rest * F.log(F.lit(1 - RATE))
    inner = F.char_length("type") - F.char_length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = F.char_length("type") - inner
    score = 2 * (as_one - by_chance) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -rest)
    return counts.where("type is not null").withColumn("abbreviation", (k > 0) & (score >= LEAST_SCORE))


def with_context(segments: DataFrame, types: DataFrame, sentences: int = 2) -> DataFrame:
    """Adds ``context``: the first sentences of ``text`` by the types of :func:`judged_types`, joined by a space; '' for none.

    Pieces between possible ends are rows by segment; those that an abbreviation ends ask for the next word's spelling. As with
    a given list, a single capital with a period goes on, and a number before a small letter.
    """
    keys = ["doc_id", "seg_no"]
    pieces = F.split(replace("text", BOUNDARY, f"$1{MARK}$2"), MARK, -1)
    rows = segments.select(*keys, F.posexplode(pieces).alias("i", "piece"))
    last, first = F.element_at(tokens("piece"), -1), F.element_at(tokens("piece"), 1)
    rows = rows.withColumns({"last": F.when(F.size(tokens("piece")) > 0, bare(last)), "first": F.when(F.size(tokens("piece")) > 0, replace(bare(first), r"\.\z", ""))})
    after = Window.partitionBy(*keys).orderBy("i")
    rows = rows.withColumns({"next": F.lead("first").over(after), "next_piece": F.lead("piece").over(after)})
    # most pieces ask for nothing: by one key for all of them they would come together in one task; no type has a space
    nothing = F.concat(F.lit(" "), F.xxhash64(*keys, "i"))
    asked = F.when(has_period(F.col("last")), type_of(F.col("last")))
    found = types.where("abbreviation").select(F.col("type").alias("asked"), F.lit(True).alias("short"))
    rows = rows.withColumn("asked", F.coalesce(asked, nothing)).join(found, "asked", "left").withColumn("short", F.coalesce("short", F.lit(False)))
    spelt = types.where("small > 0 and capital_inside = 0").select(F.col("type").alias("follows"), F.lit(True).alias("new"))
    follows = F.when(F.col("short") & F.substring("next", 1, 1).rlike(r"\p{IsUppercase}"), F.lower("next"))
    rows = rows.withColumn("follows", F.coalesce(follows, nothing)).join(spelt, "follows", "left")
    initial, number = F.col("piece").rlike(INITIAL), F.col("piece").rlike(NUMBER) & F.coalesce(F.col("next_piece").rlike(rf"^[{WS}]*\p{{IsLowercase}}"), F.lit(False))
    goes_on = (F.col("short") & F.col("new").isNull()) | initial | number
    before = after.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s", F.coalesce(F.sum((~goes_on).cast("int")).over(before), F.lit(0))).where(F.col("s") < sentences)
    joined = rows.groupBy(*keys, "s").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "piece")))["piece"], "").alias("sentence"))
    joined = joined.withColumn("sentence", strip("sentence")).where("sentence <> ''")
    contexts = joined.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("s", "sentence")))["sentence"], " ").alias("context"))
    return segments.join(contexts, keys, "left").select(*segments.columns, F.coalesce("context", F.lit("")).alias("context"))
